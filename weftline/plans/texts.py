"""Queries over texts: quality, cues, classes, keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import values as V
from weftline.operators import scoring as S
from weftline.operators.entity import digest
from weftline.plans.registry import query, table
from weftline.plans.timeline import TURNS, turns
from weftline.sources.readers import flatten_words, parse_captions, parse_progress, parse_srt
from weftline.sources.writers import to_srt

CLEAN = r"trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'))"
TIDY = r"regexp_replace(trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g')), '\s+([,.;:!?])', '\1', 'g')"
WORDS = r"list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')"
ALNUM = r"CASE WHEN t = '' THEN 0.0 ELSE length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) / length(t) END"
NOISE = r"CASE WHEN t = '' THEN 1.0 ELSE length(regexp_replace(t, '[^|\[\]{}<>~_=]', '', 'g')) / length(t) END"
SHAPES = "list_transform(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> ''), lambda w: length(regexp_replace(w, '[^A-Za-zÁÉÍÓÚáéíóúÑñÜü0-9]', '', 'g')))"


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


CUES = ["the|and|of", "der|die|das", "que|les|des"]


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)\b(?:the|and|of)\b')) + len(regexp_extract_all(text, '(?i)\b(?:der|die|das)\b')) + len(regexp_extract_all(text, '(?i)\b(?:que|les|des)\b')) AS INTEGER) AS hits,
    CAST(regexp_matches(text, '(?i)\b(?:the|and|of)\b') AS INTEGER) + CAST(regexp_matches(text, '(?i)\b(?:der|die|das)\b') AS INTEGER) + CAST(regexp_matches(text, '(?i)\b(?:que|les|des)\b') AS INTEGER) AS patterns FROM documents""")
def cue_counts(spark: SparkSession, d: str) -> DataFrame:
    patterns = [T.word(x) for x in CUES]
    return documents(spark, d).select("doc_id", T.pattern_hits(F.col("text"), patterns).alias("hits"), T.patterns_present(F.col("text"), patterns).alias("patterns"))


def _cue_sql() -> str:
    parts = []
    for kind, section, rx in T.TEXT_CUES:
        quoted = rx.replace("'", "''")
        parts.append(f"SELECT doc_id, '{kind}' AS kind, '{section}' AS section FROM c WHERE regexp_matches(t, '(?i)(?:{quoted})')")
    return rf"WITH c AS (SELECT doc_id, {CLEAN.format('text')} AS t FROM documents), k AS (SELECT * FROM c WHERE t <> '' AND NOT regexp_matches(t, '(?i)^am[eé]n\.?$')) " + " UNION ALL ".join(p.replace("FROM c", "FROM k") for p in parts)


@query(_cue_sql())
def cue_rows_explode(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.inline(T.cues(F.col("text"))))


@query(rf"""WITH {TURNS}, s AS (SELECT key, count(*) AS n, avg(CAST(regexp_matches(text, '^\s*\.+\s*$') AS INTEGER)) AS dots, avg(CAST(length(trim(text)) = 0 AS INTEGER)) AS empty, avg(CAST(length(trim(text)) <= 2 AS INTEGER)) AS tiny FROM turns GROUP BY key)
    SELECT *, dots >= 0.8 OR empty >= 0.5 OR (tiny >= 0.9 AND dots >= 0.5) AS broken FROM s""")
def broken_text_verdict(spark: SparkSession, d: str) -> DataFrame:
    return S.broken_transcript(turns(spark, d), ["key"])


@query(rf"""WITH c AS (SELECT doc_id, {TIDY.format('text')} AS t FROM documents) SELECT doc_id, CASE WHEN t = '' THEN 0.0 ELSE length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) / length(t) END AS alpha, {ALNUM} AS alnum,
    CASE WHEN t = '' THEN 1.0 ELSE length(regexp_replace(t, '[\p{{L}}\p{{N}}\s]', '', 'g')) / length(t) END AS symbols, {NOISE} AS noise FROM c""")
def text_quality(spark: SparkSession, d: str) -> DataFrame:
    t = T.tidy(F.col("text"))
    rows = documents(spark, d).select("doc_id", t.alias("t"))
    c = F.col("t")
    return rows.select("doc_id", T.alpha_ratio(c).alias("alpha"), T.alnum_ratio(c).alias("alnum"), T.symbol_ratio(c).alias("symbols"), T.noise_ratio(c).alias("noise"))


@query(rf"""WITH c AS (SELECT doc_id, {TIDY.format('text')} AS t FROM documents), m AS (SELECT doc_id, t, len({WORDS}) AS n, len(list_filter({SHAPES}, lambda x: x >= 3)) AS l, {ALNUM} AS a, {NOISE} AS z, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS letters FROM c)
    SELECT doc_id, CASE WHEN t = '' THEN 0.0 ELSE round(greatest(0.0, least(1.0, 0.30::DOUBLE * a + 0.22::DOUBLE * (1.0 - z) + 0.16::DOUBLE * greatest(0, least(1, length(t) / 120.0::DOUBLE)) + 0.12::DOUBLE * greatest(0, least(1, n / 10.0::DOUBLE)) + 0.10::DOUBLE * greatest(0, least(1, l / 6.0::DOUBLE)) + 0.10::DOUBLE * greatest(0, least(1, letters / 60.0::DOUBLE)))), 6) END AS score FROM m""")
def lexical_score(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", T.lexical_score(F.col("text")).alias("score"))


@query(rf"""WITH c AS (SELECT doc_id, {TIDY.format('text')} AS t FROM documents), m AS (SELECT doc_id, t, len({WORDS}) AS n, len(list_filter({SHAPES}, lambda x: x >= 3)) AS l, {ALNUM} AS a, {NOISE} AS z, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS letters FROM c)
    SELECT doc_id, t <> '' AND a >= 0.7 AND z <= 0.05 AND NOT (n < 2 AND letters < 8) AND NOT (length(t) >= 18 AND n < 2) AND NOT (l = 0 AND letters < 10) AS kept FROM m""")
def hard_quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", T.keep_hard(F.col("text"), 0.7, 0.05, 2, 8).alias("kept"))


def _section_sql(source: str) -> str:
    rules = [(T.CALL_TO_WORSHIP, "congregational_music"), (T.PRAYER, "prayer"), (T.MUSIC, "congregational_music"), (T.SERMON, "sermon"), (T.OFFERING, "offering"), (T.ANNOUNCEMENT, "announcement"), (T.GREETING, "welcome")]
    plain = lambda rx: rx.replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b").replace("(?<![A-Za-z0-9])", "").replace("(?![A-Za-z0-9])", "")
    cases = " ".join(f"WHEN regexp_matches(t, '(?i)(?:{plain(rx)})') THEN '{kind}'" for rx, kind in rules)
    return f"CASE WHEN t = '' THEN 'other' {cases} ELSE 'other' END"


@query(rf"""WITH c AS (SELECT conv_id, turn, lower({CLEAN.format('text')}) AS t FROM conversations) SELECT conv_id, turn, {_section_sql('c')} AS kind FROM c""")
def text_classify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.section_type(F.col("text"), F.lit("other")).alias("kind"))


SAMPLES = [
    ("Salmos 23:1-4", "slide"), ("Tema: la gracia", "full"), ("Pr. Juan Soto", "lower_third"), ("Ana María", "lower_third"), ("Cantemos al Señor con gloria", "slide"), ("Aviso", "full"), ("", "slide"),
]


@query(None)
def on_screen_types(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", F.col("text").alias("t"), F.when(F.col("doc_id") % 2 == 0, "slide").otherwise("lower_third").alias("region"))
    return docs.select("doc_id", T.on_screen_types(F.col("t"), F.col("region")).alias("_k")).select("doc_id", "_k.kind", "_k.slide", "_k.lyrics")


@query(r"""WITH s AS (SELECT doc_id, lower(strip_accents(coalesce(text, ''))) AS t FROM documents),
    k AS (SELECT doc_id, regexp_replace(regexp_replace(trim(regexp_replace(t, '[^a-z0-9\s-]', ' ', 'g')), '[\s_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM s) SELECT doc_id, CASE WHEN slug = '' THEN 'post' ELSE slug END AS slug FROM k""")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", T.slug(F.col("text"), "post").alias("slug"))


_URL = "CASE page_id % 4 WHEN 0 THEN concat('https://www.youtube.com/watch?v=', lpad(CAST(page_id AS {0}), 11, 'a')) WHEN 1 THEN concat('https://youtu.be/', lpad(CAST(page_id AS {0}), 11, 'b'), '?t=3') WHEN 2 THEN concat('http://youtube.com/shorts/', lpad(CAST(page_id AS {0}), 11, '_')) ELSE url END"


@query(rf"""WITH u AS (SELECT page_id, {_URL.format('VARCHAR')} AS u FROM pages) SELECT page_id, coalesce(nullif(regexp_extract(u, 'youtube\.com/watch\?v=([A-Za-z0-9_-]{{11}})', 1), ''), nullif(regexp_extract(u, 'youtu\.be/([A-Za-z0-9_-]{{11}})', 1), ''), nullif(regexp_extract(u, 'youtube\.com/shorts/([A-Za-z0-9_-]{{11}})', 1), ''), '') AS video FROM u""")
def url_id_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.video_id(F.expr(_URL.format("STRING"))).alias("video"))


@query("""SELECT o_orderkey, substr(sha1(concat_ws('|', CAST(o_custkey AS VARCHAR), printf('%.3f', o_totalprice), printf('%.3f', o_totalprice + 30.0), trim(o_orderpriority), '')), 1, 24) AS source_key,
    'clip_' || substr(sha1(concat_ws('|', CAST(o_custkey AS VARCHAR), printf('%.2f', o_totalprice), printf('%.2f', o_totalprice + 30.0), trim(o_orderpriority), '')), 1, 12) AS asset_id FROM orders""")
def deterministic_keys(spark: SparkSession, d: str) -> DataFrame:
    job, start, title = F.col("o_custkey").cast("string"), F.col("o_totalprice"), F.col("o_orderpriority")
    none = F.lit(None).cast("string")
    return table(spark, d, "orders").select("o_orderkey", V.clip_key(job, start, start + 30.0, title, none).alias("source_key"), V.asset_id(job, start, start + 30.0, title, none).alias("asset_id"))


@query("""SELECT conv_id, sha256(string_agg(concat_ws('|', CAST(turn AS VARCHAR), role, text), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""")
def row_digest(spark: SparkSession, d: str) -> DataFrame:
    return digest(table(spark, d, "conversations"), ["conv_id"], F.concat_ws("|", F.col("turn").cast("string"), "role", "text"), ["turn"])


@query(rf"""WITH {TURNS} SELECT key, speaker, max(CASE WHEN text <> '' THEN length(text) END) AS longest, count(*) AS n, count(CASE WHEN regexp_matches(text, '[.!?]$') THEN 1 END) AS stops FROM turns GROUP BY key, speaker""")
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).groupBy("key", "speaker").agg(F.max(F.when(F.col("text") != "", F.length("text"))).alias("longest"), F.count("*").alias("n"), F.count_if(F.col("text").rlike("[.!?]$")).alias("stops"))


@query(rf"""WITH {TURNS}, tail AS (SELECT key, string_agg(text, ' ' ORDER BY id) AS tail FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id DESC) AS r FROM turns) WHERE r <= 2 GROUP BY key)
    SELECT key, CASE WHEN tail = '' THEN 0.4 WHEN regexp_matches(tail, '[.!?]["'')]?\s*$') THEN 1.0 WHEN regexp_matches(tail, '(?i)\b(?:amé?n|gracias|oramos|oremos)\b') THEN 0.9 WHEN regexp_matches(tail, '[,;:]\s*$') THEN 0.45 ELSE 0.65 END::DOUBLE AS completeness FROM tail""")
def ending_completeness(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    last = turns(spark, d).withColumn("r", F.row_number().over(W.partitionBy("key").orderBy(F.desc("id")))).where("r <= 2")
    packed = F.array_sort(F.collect_list(F.struct("id", "text")))
    tails = last.groupBy("key").agg(F.array_join(F.transform(packed, lambda x: x["text"]), " ").alias("tail"))
    return tails.select("key", S.ending_completeness(F.col("tail")).alias("completeness"))


@query(rf"""WITH {TURNS} SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY start, id) AS INTEGER) AS block, (start // 1000)::DOUBLE + (start % 1000) / 1000.0::DOUBLE AS start, ("end" // 1000)::DOUBLE + ("end" % 1000) / 1000.0::DOUBLE AS "end", text FROM turns WHERE text <> ''""")
def srt_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows = turns(spark, d).where("text <> ''").withColumn("start", F.col("start") / 1000.0).withColumn("end", F.col("end") / 1000.0)
    return parse_srt(to_srt(rows, ["key"]))


@query(r"""WITH l AS (SELECT user_id AS key, event_id AS n, event_id % 7200 AS s, CASE WHEN event_type = 'view' THEN '[música]' ELSE event_type END AS text FROM events WHERE event_id % 3 <> 0)
    SELECT key, n, CAST(s AS DOUBLE) AS start, coalesce(lead(s) OVER (PARTITION BY key ORDER BY s, n), s + 5.0)::DOUBLE AS "end", text FROM l""")
def captions_parse(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("event_id") % 7200
    clock = F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))
    text = F.when(F.col("event_type") == "view", "[música]").otherwise(F.col("event_type"))
    line = F.when(F.col("event_id") % 3 == 0, F.lit("not a caption")).otherwise(F.concat(F.lit("**"), clock, F.lit("** · "), text))
    lines = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("n"), line.alias("line"))
    return parse_captions(lines, ["key"])


@query("""SELECT CAST(event_id AS DOUBLE) AS percent, CAST(value AS DOUBLE) AS eta_sec, event_id % 2 = 0 AS targeted FROM events WHERE event_id % 5 <> 0""")
def progress_log_scan(spark: SparkSession, d: str) -> DataFrame:
    numbers = ["sampled", "total_samples", "observations", "scene_cuts", "ocr_calls", "roi_candidates", "samples_per_sec", "frames_per_sec", "video_speed_x"]
    fields = [F.lit("ocr_progress").alias("type"), F.col("event_id").alias("percent"), (F.col("event_id") % 2 == 0).alias("targeted"), F.col("value").alias("eta_sec"), *(F.lit(1.5).alias(n) for n in numbers)]
    good = F.concat(F.lit("12:00 [ocr-events-progress] "), F.to_json(F.struct(*fields)))
    bad = F.when(F.col("event_id") % 10 == 0, F.lit("[ocr-events-progress] {broken")).otherwise(F.lit('[ocr-events-progress] {"type": "ocr_progress", "percent": 3}'))
    lines = table(spark, d, "events").select(F.when(F.col("event_id") % 5 == 0, bad).otherwise(good).alias("value"))
    return parse_progress(lines).select("percent", "eta_sec", "targeted")


@query("""SELECT o_orderkey AS key, o_orderstatus AS text, CAST(o_custkey AS DOUBLE) AS start, 0 AS channel_index FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT o_orderkey AS key, o_orderpriority AS text, CAST(o_custkey AS DOUBLE) AS start, 1 AS channel_index FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT o_orderkey AS key, o_orderpriority AS text, CAST(o_custkey AS DOUBLE) AS start, NULL AS channel_index FROM orders WHERE o_orderkey % 2 <> 0""")
def words_flatten(spark: SparkSession, d: str) -> DataFrame:
    def word(c):
        return F.struct(F.col(c).alias("text"), F.col("o_custkey").cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.lit("word").alias("type"), F.lit(None).cast("string").alias("speaker_id"), F.lit(None).cast("int").alias("channel_index"))

    channels = F.array(F.struct(F.lit(0).alias("channel_index"), F.array(word("o_orderstatus")).alias("words")), F.struct(F.lit(1).alias("channel_index"), F.array(word("o_orderpriority")).alias("words")))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.array(word("o_orderpriority")).alias("words"), F.when(F.col("o_orderkey") % 2 == 0, channels).alias("transcripts"))
    return flatten_words(rows, ["key"]).select("key", "text", "start", "channel_index")


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'music' WHEN event_type = 'click' THEN 'noenergy' WHEN event_type = 'error' THEN 'speech' ELSE 'noise' END AS label,
    CASE WHEN user_id % 4 = 0 THEN 'SPEAKER_UNKNOWN' WHEN user_id % 4 = 1 THEN 'SPEAKER_' || user_id WHEN user_id % 4 = 2 THEN 'SPEAKER_A_B' ELSE 'SPEAKER_07' END AS speaker FROM events""")
def labels_normalize(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    raw = F.when(kind == "view", "(Piano Music)").when(kind == "click", "[pausa]").when(kind == "error", "Habla").otherwise("door")
    u = F.col("user_id")
    who = F.when(u % 4 == 0, " ").when(u % 4 == 1, u.cast("string")).when(u % 4 == 2, "a b").otherwise("speaker_07")
    return table(spark, d, "events").select("event_id", T.audio_label(raw).alias("label"), T.speaker_label(who).alias("speaker"))


@query(r"""SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, printf('%02d:%02d:%02d', (event_id * 7 // 3600), (event_id * 7 % 3600 // 60), event_id * 7 % 60) AS clock FROM events""")
def json_and_clock(spark: SparkSession, d: str) -> DataFrame:
    seconds = (F.col("event_id") * 7).cast("double")
    return table(spark, d, "events").select("event_id", V.first_present(F.col("props"), "$.missing", "$.k").cast("int").alias("k"), V.clock(seconds).alias("clock"))


@query(None)
def text_similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = turns(spark, d)
    a = rows.select("key", "id", T.normal_key(F.col("text")).alias("a"))
    b = rows.select("key", (F.col("id") - 1).alias("id"), T.normal_key(F.col("text")).alias("b"))
    return a.join(b, ["key", "id"]).select("key", "id", T.similarity("a", "b").alias("ratio"))
