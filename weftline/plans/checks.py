"""Queries over gates, writers and small measures that no other query reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import values as V
from weftline.operators import entity as E
from weftline.operators import scoring
from weftline.operators import sections as O
from weftline.plans.entities import JOBS, jobs
from weftline.plans.registry import query
from weftline.plans.sections import K, SECTIONS, SPOKEN, orders, sections, spoken
from weftline.plans.texts import ALNUM, NOISE, SHAPES, WORDS
from weftline.sources import readers, writers

ALPHA = r"CASE WHEN t = '' THEN 0.0 ELSE length(regexp_replace(t, '[^\p{L}]', '', 'g')) / length(t) END"
SYMBOLS = r"CASE WHEN t = '' THEN 1.0 ELSE length(regexp_replace(t, '[\p{L}\p{N}\s]', '', 'g')) / length(t) END"
TIDY = r"regexp_replace(text, '\s+([,.;:!?])', '\1', 'g')"
_MEASURES = rf"""m AS (SELECT *, {ALPHA} AS alpha, {ALNUM} AS alnum, {SYMBOLS} AS symbols, {NOISE} AS noise, len({WORDS}) AS n, len(list_filter({SHAPES}, lambda x: x >= 3)) AS long, len(list_filter({SHAPES}, lambda x: x <= 1)) AS short FROM c)"""


@query(rf"""WITH {SPOKEN}, c AS (SELECT key, id, {TIDY} AS t, (id % 10) / 10.0::DOUBLE AS conf, start, "end" FROM spoken), {_MEASURES}
    SELECT key, id, length(t) >= 3 AND regexp_matches(t, '[A-Za-zÁÉÍÓÚáéíóúÑñ0-9]') AND alpha >= 0.7 AND alnum >= 0.75 AND symbols <= 0.2 AND conf >= 0.3 AS text, "end" - start >= 2 AND conf >= 0.2 AND length(t) >= 20 AND n >= 4 AND long >= 3 AND short <= greatest(2, n // 3) AND alnum >= 0.7 AND noise <= 0.1 AS fullscreen,
    length(t) >= 10 AND conf >= 0.5 AND (id % 3 = 0 OR regexp_matches(t, '(?i)(?:anuncios|predicación)')) AS rescued FROM m""")
def text_gates(spark: SparkSession, d: str) -> DataFrame:
    rows = spoken(spark, d).withColumn("conf", F.col("id") % 10 / 10.0)
    c = F.col
    kind = F.when(c("id") % 3 == 0, " Title ").otherwise("x")
    return rows.select(
        "key", "id", T.keep_text(c("text"), c("conf"), 3, 0.3, 0.7, 0.75, 0.2).alias("text"), T.keep_fullscreen(c("text"), c("start"), c("end"), c("conf"), 2.0, 0.2, 20, 4, 3, 0.7, 0.1).alias("fullscreen"),
        T.keep_rescued(c("text"), c("conf"), kind, 0.5, 10, ["title"], "anuncios|predicación").alias("rescued"),
    )


SOUND = f"CASE {K} % 8 WHEN 0 THEN '[música]' WHEN 1 THEN 'Piano suave' WHEN 2 THEN '(risas)' WHEN 3 THEN ' Amén ' WHEN 4 THEN 'música' WHEN 5 THEN 'musical' WHEN 6 THEN 'Hola' END"


@query(rf"""WITH r AS (SELECT {K}, lower(trim(coalesce({SOUND}, ''))) AS t FROM orders) SELECT {K}, t = '' OR t IN ('music', 'música', 'piano', 'silence', 'silencio') OR regexp_matches(t, '^\[.*\]$|^\(.*\)$') OR regexp_matches(t, '^(?:music|música|piano|instrumental|aplausos|applause|silence|silencio)\b') AS silent, t IN ('', 'amén', 'música') AS exact FROM r""")
def non_speech_flags(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).select(K, T.non_speech(F.expr(SOUND)).alias("silent"), T.non_speech_exact(F.expr(SOUND), ["amén", "música"]).alias("exact"))


@query(f"""SELECT {K}, (o_orderkey % 100)::DOUBLE AS start, (o_orderkey % 100)::DOUBLE + 5 AS "end", 'a b' AS text FROM orders WHERE {K} % 3 <> 0 AND {K} % 5 <> 0""")
def clean_timeline(spark: SparkSession, d: str) -> DataFrame:
    k = F.col(K)
    start = F.when(k % 3 != 0, (k % 100).cast("double"))
    end = F.when(k % 5 == 0, F.lit(float("nan"))).otherwise((k % 100).cast("double") + 5)
    return readers.normalize_timeline(orders(spark, d).select(K, start.alias("start"), end.alias("end"), F.lit(" a \n b").alias("text")))


@query(f"""SELECT o_custkey AS key, 'e' || {K} AS source, CASE WHEN {K} % 2 = 0 THEN 500.0::DOUBLE ELSE ({K} % 40)::DOUBLE + 3 END AS duration, 'music' AS label, ({K} % 40)::DOUBLE AS start, ({K} % 40)::DOUBLE + 3 AS "end" FROM orders""")
def audio_event_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col(K)
    event = lambda a, b: F.struct(F.lit("Music").alias("label"), a.alias("start"), b.alias("end"))
    a = (k % 40).cast("double")
    body = F.struct(F.concat(F.lit("e"), k.cast("string")).alias("source"), F.when(k % 2 == 0, F.lit(500.0)).alias("duration_sec"), F.array(event(a, a + 3), event(F.lit(None).cast("double"), a)).alias("events"))
    return readers.parse_audio_events(orders(spark, d).select(F.col("o_custkey").alias("key"), F.to_json(body).alias("json")), ["key"], "json")


@query(f"""SELECT {K}, {K} % 50 + 0.5::DOUBLE AS start, {K} % 50 + 2.0::DOUBLE AS "end", 'deep' AS text FROM orders UNION ALL SELECT {K}, 7.0::DOUBLE, 8.0::DOUBLE, 'flat' FROM orders WHERE {K} % 2 = 0""")
def turn_walk(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col(K) % 50).cast("string")
    deep = F.concat(F.lit('{"a":{"b":[1,{"start_time":'), n, F.lit('.5,"end_time":'), (F.col(K) % 50 + 2).cast("string"), F.lit(',"transcript":"deep"}]},"c":[{"start":true,"end":2,"text":"no"}'))
    flat = F.when(F.col(K) % 2 == 0, F.lit(',{"start":7,"end":8,"text":"flat"}]}')).otherwise(F.lit(',{"start":7,"text":"no end"}]}'))
    return readers.walk_turns(orders(spark, d).select(K, F.concat(deep, flat).alias("j")), [K], "j")


@query(f"""WITH {SECTIONS}, s AS (SELECT key, count(*) AS n FROM sec GROUP BY key) SELECT key, string_agg('## ' || title || ' (' || printf('%02d:%02d:%02d', CAST(floor(start) AS BIGINT) // 3600, CAST(floor(start) AS BIGINT) % 3600 // 60, CAST(floor(start) AS BIGINT) % 60) || ' - ' || printf('%02d:%02d:%02d', CAST(floor("end") AS BIGINT) // 3600, CAST(floor("end") AS BIGINT) % 3600 // 60, CAST(floor("end") AS BIGINT) % 60) || ')' || chr(10) || chr(10) || type, chr(10) || chr(10) ORDER BY start, id) AS content FROM sec GROUP BY key""")
def section_report(spark: SparkSession, d: str) -> DataFrame:
    return writers.to_markdown(sections(spark, d).withColumn("text", F.col("type")), ["key"])


@query(f"""WITH {SECTIONS}, f AS (SELECT *, type = 'sermon' AS f, bool_or(type = 'sermon') OVER (PARTITION BY key) AS anyf FROM sec) SELECT key, count(*) AS total, count(CASE WHEN f THEN 1 END) AS flagged, count(CASE WHEN f OR NOT anyf THEN 1 END) AS packed, min(CASE WHEN f OR NOT anyf THEN start END) AS first FROM f GROUP BY key""")
def package_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = sections(spark, d).select("key", "start", "end", F.col("title").alias("text"), (F.col("type") == "sermon").alias("flag"))
    made = writers.package(rows, ["key"], "flag")
    body = F.from_json("events", "array<struct<start: double>>")
    return made.select("key", "total", "flagged", F.size(body).alias("packed"), F.get(body, F.lit(0))["start"].alias("first"))


@query(f"""SELECT {K}, coalesce(CASE WHEN {K} % 2 = 0 THEN o_orderstatus END, 'none') AS kind, CASE WHEN {K} % 3 = 0 THEN o_totalprice END AS v FROM orders""")
def event_row_defaults(spark: SparkSession, d: str) -> DataFrame:
    k = F.col(K)
    v = F.when(k % 3 == 0, F.col("o_totalprice")).when(k % 3 == 1, F.lit(float("inf")))
    return writers.event_rows(orders(spark, d).select(K, F.when(k % 2 == 0, F.col("o_orderstatus")).alias("kind"), v.alias("v")), {"kind": F.lit("none")}, ["v"])


@query(rf"""WITH {SPOKEN} SELECT key, id, CASE WHEN length(text) > 40 THEN substr(text, 1, 39) || '…' ELSE text END AS short, regexp_matches(text, '(?i)oremos|oraci[oó]n') AS prayer, regexp_replace(text, '^\s*```(?:json)?\s*|\s*```\s*$', '') AS plain FROM spoken""")
def short_texts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    fenced = F.concat(F.lit("```json\n"), c, F.lit("\n```"))
    return spoken(spark, d).select("key", "id", T.shorten(c, 40).alias("short"), c.rlike(T.anywhere("oremos|oraci[oó]n")).alias("prayer"), V.unfenced(fenced).alias("plain"))


@query(rf"""WITH {SPOKEN}, w AS (SELECT key, id, list_filter(string_split(text, ' '), lambda x: x <> '') || [')', ','] AS w FROM spoken) SELECT key, id, regexp_replace(regexp_replace('( ' || array_to_string(w, ' '), '\s+([,.;:!?)\]}}])', '\1', 'g'), '([(\[{{])\s+', '\1', 'g') AS text FROM w""")
def joined_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.concat(F.array(F.lit("(")), F.filter(F.split("text", " "), lambda x: x != ""), F.array(F.lit(")"), F.lit(",")))
    return spoken(spark, d).select("key", "id", T.join_tokens(tokens).alias("text"))


_IW = "greatest(0, least(x + 20, ox + 25) - greatest(x, ox)) * greatest(0, least(y + 15, oy + 10) - greatest(y, oy))"


@query(f"""WITH r AS (SELECT {K}, {K} % 40 AS x, {K} % 30 AS y, {K} * 7 % 40 AS ox, {K} * 11 % 30 AS oy, {K} * 1234567 AS a, {K} * 7654321 AS b FROM orders) SELECT {K}, round(({_IW})::DOUBLE / (300 + 250 - {_IW}), 9) AS iou, bit_count(xor(a, b))::INTEGER AS bits FROM r""")
def boxes_and_hashes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col(K)
    iou = V.box_iou([k % 40, k % 30, F.lit(20), F.lit(15)], [k * 7 % 40, k * 11 % 30, F.lit(25), F.lit(10)])
    return orders(spark, d).select(K, F.round(iou, 9).alias("iou"), V.hamming(k * 1234567, k * 7654321).alias("bits"))


@query(f"""WITH {JOBS}, c AS (SELECT id, CASE WHEN id % 2 = 0 THEN 't' || id ELSE 'other' END AS token, 900000000 + greatest(30, 45) * 1000000 AS lease FROM jobs WHERE status = 'pending')
    SELECT id, CASE WHEN id % 2 = 0 THEN 'completed' ELSE 'processing' END AS status, CASE WHEN id % 2 = 0 THEN NULL ELSE lease END AS lease_expires_at, CASE WHEN id % 2 = 0 THEN NULL ELSE token END AS claim_token, 1 AS attempt_count FROM c""")
def claimed_and_finished(spark: SparkSession, d: str) -> DataFrame:
    token = F.when(F.col("id") % 2 == 0, F.concat(F.lit("t"), F.col("id").cast("string"))).otherwise("other")
    claimed = E.claim(jobs(spark, d).where("status = 'pending'"), "w", token, F.lit(900_000_000), 45)
    return E.finish(claimed, F.concat(F.lit("t"), F.col("id").cast("string")), "completed").select("id", "status", "lease_expires_at", "claim_token", "attempt_count")


@query(f"""WITH r AS (SELECT {K}, ['congregational_music', 'sermon', 'welcome', 'other'][CAST({K} % 4 AS INTEGER) + 1] AS kind, ({K} % 11)::DOUBLE / 10 AS c, ({K} % 7)::DOUBLE / 10 AS m, ({K} % 9)::DOUBLE / 9 AS s, ({K} % 5)::DOUBLE / 5 AS p FROM orders)
    SELECT {K}, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN kind = 'congregational_music' AND m < 0.12 AND s > 0.7 THEN least(c, 0.45) WHEN kind = 'sermon' AND m > 0.35 THEN least(c, 0.55) WHEN kind = 'welcome' AND p > 0.65 THEN least(c, 0.5) ELSE c END)), 2) AS confidence FROM r""")
def calibrated(spark: SparkSession, d: str) -> DataFrame:
    k = F.col(K)
    kind = F.element_at(F.array(*map(F.lit, ["congregational_music", "sermon", "welcome", "other"])), (k % 4 + 1).cast("int"))
    part = lambda n, of: (k % n).cast("double") / of
    return orders(spark, d).select(K, scoring.calibrate(kind, part(11, 10), part(7, 10), part(9, 9), part(5, 5)).alias("confidence"))


@query(rf"""WITH {SPOKEN}, p AS (SELECT a.key, a.id, {TIDY.replace('text', 'a.text')} AS x, {TIDY.replace('text', 'b.text')} AS y, (a.id % 10) / 10.0::DOUBLE AS cx, (b.id * 3 % 10) / 10.0::DOUBLE AS cy FROM spoken a JOIN spoken b ON b.key = a.key AND b.id = a.id + 1), c AS (SELECT key, id, 'x' AS side, x AS t FROM p UNION ALL SELECT key, id, 'y', y FROM p),
    z AS (SELECT *, {ALNUM} AS al, {NOISE} AS no, len({WORDS}) AS n, len(list_filter({SHAPES}, lambda v: v >= 3)) AS l, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS letters FROM c),
    q AS (SELECT key, id, side, CASE WHEN t = '' THEN 0.0 ELSE round(greatest(0.0, least(1.0, 0.30::DOUBLE * al + 0.22::DOUBLE * (1.0 - no) + 0.16::DOUBLE * greatest(0, least(1, length(t) / 120.0::DOUBLE)) + 0.12::DOUBLE * greatest(0, least(1, n / 10.0::DOUBLE)) + 0.10::DOUBLE * greatest(0, least(1, l / 6.0::DOUBLE)) + 0.10::DOUBLE * greatest(0, least(1, letters / 60.0::DOUBLE)))), 6) END AS s FROM z),
    w AS (SELECT key, id, max(CASE WHEN side = 'x' THEN s END) AS qx, max(CASE WHEN side = 'y' THEN s END) AS qy FROM q GROUP BY key, id)
    SELECT key, id, y <> '' AND (x = '' OR qy >= qx + 0.05::DOUBLE OR (cy >= cx + 0.14::DOUBLE AND qy >= qx - 0.02::DOUBLE) OR (length(y) >= floor(length(x) * 1.35) AND qy >= qx)) AS replace FROM p JOIN w USING (key, id)""")
def text_overrides(spark: SparkSession, d: str) -> DataFrame:
    rows = spoken(spark, d).select("key", "id", "text")
    after = rows.select("key", (F.col("id") - 1).alias("id"), F.col("text").alias("other"))
    both = rows.join(after, ["key", "id"])
    found = T.cloud_override(F.col("text"), F.col("id") % 10 / 10.0, F.col("other"), (F.col("id") + 1) * 3 % 10 / 10.0, 0.05)
    return both.select("key", "id", found.alias("replace"))


@query(f"""WITH s AS (SELECT o_custkey AS key, {K} AS id, ({K} % 90)::DOUBLE AS t, ({K} % 97) / 97.0::DOUBLE AS text, ({K} % 53) / 397.0::DOUBLE AS motion FROM orders), b AS (SELECT DISTINCT key, i AS "window", i * 30.0::DOUBLE AS start, i * 30.0::DOUBLE + 30 AS "end" FROM s, (VALUES (0), (1), (2)) v(i)),
    m AS (SELECT b.key, b."window", count(*) AS n, avg(text) AS avg_text, avg(motion) AS avg_motion FROM b JOIN s ON s.key = b.key AND s.t BETWEEN b.start AND b."end" GROUP BY ALL)
    SELECT key, "window", n, round(avg_text, 6) AS text, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - avg_motion / 0.12::DOUBLE)), 6) AS still, round(0.62::DOUBLE * avg_text + 0.38::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - avg_motion / 0.12::DOUBLE)), 6) AS score FROM m""")
def interval_metrics(spark: SparkSession, d: str) -> DataFrame:
    k = F.col(K)
    samples = orders(spark, d).select(F.col("o_custkey").alias("key"), k.alias("id"), (k % 90).cast("double").alias("t"), (k % 97 / 97.0).alias("text"), (k % 53 / 397.0).alias("motion"))
    spans = samples.select("key").distinct().withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(2)))).select("key", "window", (F.col("window") * 30.0).alias("start"), (F.col("window") * 30.0 + 30).alias("end"))
    return scoring.interval_metrics(spans, samples, ["key"], 30.0)


@query(rf"""WITH {SPOKEN} SELECT key, id, regexp_matches(text, '(?i)(?:{T.PRAYER_TEXT.replace("(?<![A-Za-z0-9_])", chr(92) + "b").replace("(?![A-Za-z0-9_])", chr(92) + "b")})') AS prayer, regexp_matches(text, '(?i)(?:{T.WORSHIP_TEXT})') AS worship, regexp_matches(text, '(?i)(?:{T.CALL_TO_WORSHIP})') AS call, regexp_matches(text, '(?i)(?:{T.KICKOFF_TEXT})') AS kickoff FROM spoken""")
def text_predicates(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    found = {"prayer": T.PRAYER_TEXT, "worship": T.WORSHIP_TEXT, "call": T.CALL_TO_WORSHIP, "kickoff": T.KICKOFF_TEXT}
    return spoken(spark, d).select("key", "id", *(c.rlike(T.anywhere(rx)).alias(n) for n, rx in found.items()))


@query(f"""WITH r AS (SELECT o_custkey AS key, {K} AS id, {K} % 4 = 0 AS rep, {K} % 3 = 0 AS applied, CASE WHEN {K} % 5 = 0 THEN '' ELSE repeat('abc ', CAST({K} % 9 AS INTEGER)) END AS text, ({K} % 10) / 10.0::DOUBLE AS c FROM orders), h AS (SELECT key, arg_min({{'id': id, 'applied': applied, 'text': trim(text), 'c': c}}, (NOT rep, id)) AS h FROM r GROUP BY key)
    SELECT key, id, CASE WHEN x THEN h.text ELSE text END AS text, CASE WHEN x THEN round(greatest(c, h.c), 3) ELSE c END AS c, x AS propagated FROM (SELECT r.*, h, h.applied AND h.text <> '' AND id <> h.id AND NOT applied AND length(h.text) > length(trim(text)) AS x FROM r JOIN h USING (key))""")
def group_propagation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col(K)
    rows = orders(spark, d).select(
        F.col("o_custkey").alias("key"), k.alias("id"), (k % 4 == 0).alias("representative"), (k % 3 == 0).alias("applied"), F.when(k % 5 == 0, "").otherwise(F.expr(f"repeat('abc ', cast({K} % 9 as int))")).alias("text"), (k % 10 / 10.0).alias("confidence")
    )
    longer = lambda local, own, other, theirs: F.length(T.clean(other)) > F.length(T.clean(local))  # noqa: E731, ARG005
    made = O.propagated(rows, ["key"], longer)
    return made.select("key", "id", "text", F.col("confidence").alias("c"), "propagated")


@query(f"""WITH {SECTIONS} SELECT key, count(*) AS events, count(DISTINCT type) AS kinds, sum("end" - start) AS seconds, round(avg(confidence), 6) AS confidence, count(CASE WHEN confidence < 0.5 THEN 1 END) AS weak, max("end") AS last FROM sec GROUP BY key""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return O.summary(sections(spark, d), ["key"])
