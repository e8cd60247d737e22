"""Queries over sections, clips and identities: conversations stand in for transcripts, users' events for sounds and slides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import islands as L
from weftline.operators import scoring
from weftline.operators import sections as O
from weftline.operators import selection as P
from weftline.operators.intervals import interval_join, touches
from weftline.plans.registry import query, table
from weftline.plans.timeline import TL, TURNS, lasting, turns

K = "o_orderkey"
SAID = [
    "", "Feliz sábado familia.", "Oremos, te lo pedimos en el nombre de Jesús, amén.", "Vamos a cantar un himno de alabanza.", "Abran sus biblias, el mensaje de hoy.",
    "Anuncios: esta tarde hay convivio.", "Predicación: el tema de hoy.", "Llegó el momento de alabar.", "Quiero comenzar diciéndote algo.", "Les queremos agradecer, gracias pastor.", "El equipo de alabanza, amén.", "",
]
_SAID = "[" + ", ".join(f"'{x}'" for x in SAID) + "]"
#: The turns of conversations, in seconds, each with a phrase at its end.
SPOKEN = TURNS + f""", spoken AS (SELECT key, id, speaker, start / 1000.0::DOUBLE AS start, "end" / 1000.0::DOUBLE AS "end", trim(text || ' ' || ({_SAID})[CAST((id * 5 + key) % 12 AS INTEGER) + 1]) AS text FROM turns)"""
_SPEECH = "NOT (text = '' OR text IN ('music', 'música', 'piano', 'silence', 'silencio') OR regexp_matches(lower(text), '^\\[.*\\]$|^\\(.*\\)$') OR regexp_matches(lower(text), '^(?:music|música|piano|instrumental|aplausos|applause|silence|silencio)\\b'))"


def spoken(spark: SparkSession, d: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, SAID)), ((F.col("id") * 5 + F.col("key")) % 12 + 1).cast("int"))
    text = F.trim(F.concat("text", F.lit(" "), said))
    return turns(spark, d).select("key", "id", "speaker", (F.col("start") / 1000.0).alias("start"), (F.col("end") / 1000.0).alias("end"), text.alias("text"))


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders")


def _hits(text: str, patterns: list[str]) -> str:
    return " + ".join(f"len(regexp_extract_all({text}, '{rx}'))" for rx in patterns)


def _says(text: str, patterns: list[str]) -> str:
    return " OR ".join(f"regexp_matches({text}, '{rx}')" for rx in patterns)


# --- proposed rows ----------------------------------------------------------------------------------

RAW = {
    "start": f"CASE {K} % 9 WHEN 0 THEN 'x' WHEN 1 THEN '-5' ELSE CAST({K} % 700 AS VARCHAR(9)) END", "end": f"CASE {K} % 11 WHEN 0 THEN NULL WHEN 1 THEN 'NaN' ELSE CAST({K} % 700 + {K} % 400 AS VARCHAR(9)) || '.5' END",
    "title": f"CASE WHEN {K} % 13 = 0 THEN '  ' ELSE ' Parte  ' || CAST({K} AS VARCHAR(19)) END", "type": f"CASE {K} % 6 WHEN 0 THEN 'Song' WHEN 1 THEN ' announcements' WHEN 2 THEN 'child_segment' WHEN 3 THEN 'SERMON' WHEN 4 THEN 'dance' END",
    "confidence": f"CASE {K} % 4 WHEN 0 THEN '0.7' WHEN 1 THEN '3' WHEN 2 THEN 'sure' END", "reason": f"CASE WHEN {K} % 2 = 0 THEN ' a  b ' END",
}
_RAW = ", ".join(f'{x} AS "{n}"' for n, x in RAW.items())
_OLD = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in O.OLD_TYPES.items())


@query(rf"""WITH r AS (SELECT {K}, {_RAW} FROM orders), n AS (SELECT {K}, TRY_CAST(start AS DOUBLE) AS s, TRY_CAST("end" AS DOUBLE) AS e, trim(regexp_replace(title, '\s+', ' ', 'g')) AS title, lower(trim(coalesce(type, 'other'))) AS k, TRY_CAST(confidence AS DOUBLE) AS c, trim(regexp_replace(coalesce(reason, ''), '\s+', ' ', 'g')) AS reason FROM r),
    m AS (SELECT *, CASE k {_OLD} ELSE k END AS kind FROM n WHERE isfinite(s) AND isfinite(e) AND e > s AND title <> '')
    SELECT {K}, greatest(0.0::DOUBLE, least(600.0::DOUBLE, s)) AS start, greatest(0.0::DOUBLE, least(600.0::DOUBLE, e)) AS "end", title, CASE WHEN kind IN ({', '.join(map(repr, O.SECTION_TYPES))}) THEN kind ELSE 'other' END AS type, CASE WHEN c IS NULL THEN 0.6::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, c)) END AS confidence, reason FROM m""")
def section_row_checks(spark: SparkSession, d: str) -> DataFrame:
    return O.valid_sections(orders(spark, d).select(K, *(F.expr(x).alias(n) for n, x in RAW.items())), F.lit(600.0))


CLIP = {
    "start": f"CASE WHEN {K} % 17 = 0 THEN NULL ELSE CAST({K} % 700 AS DOUBLE) / 3 END", "end": f"CAST({K} % 700 AS DOUBLE) / 3 + CAST({K} % 250 AS DOUBLE)", "title": f"CASE WHEN {K} % 3 = 0 THEN ' ' ELSE 'Clip ' || CAST({K} AS VARCHAR(19)) END",
    "excerpt": f"CASE WHEN {K} % 2 = 0 THEN ' e  f' END", "hook": "' h '", "hook_type": f"CASE {K} % 3 WHEN 0 THEN 'Promise ' WHEN 1 THEN 'joke' END", "confidence": f"CASE WHEN {K} % 4 <> 0 THEN CAST({K} % 13 AS DOUBLE) / 10 END",
    "score": f"CASE WHEN {K} % 5 <> 0 THEN CAST({K} % 11 AS DOUBLE) / 10 END", "hook_strength": f"CASE WHEN {K} % 6 = 0 THEN CAST({K} % 7 AS DOUBLE) / 5 END", "spiritual_impact": f"CASE WHEN {K} % 4 = 0 THEN CAST({K} % 9 AS DOUBLE) / 8 END", "shareability": "CAST(NULL AS DOUBLE)",
}
_CLIP = ", ".join(f'{x} AS "{n}"' for n, x in CLIP.items())
_UNIT = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, {}))"


@query(rf"""WITH r AS (SELECT {K}, {_CLIP} FROM orders), b AS (SELECT *, greatest(20.0::DOUBLE, least(210.0::DOUBLE, start)) AS a, least(greatest(20.0::DOUBLE, least(210.0::DOUBLE, "end")), greatest(20.0::DOUBLE, least(210.0::DOUBLE, start)) + 120) AS z, hook_strength IS NOT NULL OR spiritual_impact IS NOT NULL AS new FROM r WHERE start IS NOT NULL)
    SELECT {K}, round(a, 2) AS start, round(z, 2) AS "end", CASE WHEN trim(title) = '' THEN 'Sermon Highlight' ELSE title END AS title, trim(regexp_replace(coalesce(excerpt, ''), '\s+', ' ', 'g')) AS excerpt, 'h' AS hook, CASE WHEN lower(trim(hook_type)) = 'promise' THEN 'promise' ELSE 'none' END AS hook_type,
        {_UNIT.format("coalesce(confidence, 0.55::DOUBLE)")} AS confidence, {_UNIT.format("CASE WHEN new THEN coalesce(hook_strength, 0.5::DOUBLE) ELSE 0.5::DOUBLE END")} AS hook_strength, {_UNIT.format("CASE WHEN new THEN coalesce(spiritual_impact, 0.5::DOUBLE) ELSE coalesce(score, confidence, 0.5::DOUBLE) END")} AS spiritual_impact, 0.5::DOUBLE AS shareability
    FROM b WHERE z > a AND z - a >= 30""")
def clip_row_checks(spark: SparkSession, d: str) -> DataFrame:
    return O.valid_clips(orders(spark, d).select(K, *(F.expr(x).alias(n) for n, x in CLIP.items())), F.lit(20.0), F.lit(210.0), 30.0, 120.0)


@query(rf"""WITH r AS (SELECT {K}, {_CLIP} FROM orders) SELECT {K}, greatest(0.0::DOUBLE, start) AS start, greatest(greatest(0.0::DOUBLE, start) + 1, least("end", 180.0::DOUBLE)) AS "end", CASE WHEN trim(title) = '' THEN 'Sermon Highlight' ELSE trim(title) END AS title,
    CASE WHEN confidence IS NULL THEN 0.5::DOUBLE ELSE {_UNIT.format("confidence")} END AS confidence, CASE WHEN score IS NULL THEN CASE WHEN confidence IS NULL THEN 0.5::DOUBLE ELSE {_UNIT.format("confidence")} END ELSE {_UNIT.format("score")} END AS score FROM r WHERE start IS NOT NULL""")
def clip_second_pass(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).select(K, *(F.expr(CLIP[n]).alias(n) for n in ("start", "end", "title", "confidence", "score")))
    return O.renormalized_clips(rows, F.lit(180.0))


@query(f"""WITH r AS (SELECT {K}, list_transform(range(0, CAST({K} % 8 AS BIGINT)), lambda i: {{'o': CASE WHEN ({K} + i) % 5 = 0 THEN -1.0::DOUBLE WHEN ({K} + i) % 5 = 1 THEN NULL ELSE ({K} % 50 + i)::DOUBLE / 3 END, 'n': ({K} + i) % 7}}) AS c FROM orders),
    g AS (SELECT {K}, list_filter(c, lambda x: coalesce(x.o, 0) >= 0 AND x.n > 0)[1:4] AS c FROM r)
    SELECT {K}, len(c) AS n, array_to_string(list_transform(c, lambda x: CAST(round(coalesce(x.o, 0.0), 2) AS DECIMAL(9, 2)) || ':' || least(4, x.n)), ' ') AS cues FROM g""")
def clip_cues(spark: SparkSession, d: str) -> DataFrame:
    k = F.col(K)
    none = F.lit(None).cast("double")

    def cue(i: F.Column) -> F.Column:
        offset = F.when((k + i) % 5 == 0, F.lit(-1.0)).when((k + i) % 5 == 1, none).otherwise((k % 50 + i).cast("double") / 3)
        words = F.transform(F.filter(F.sequence(F.lit(0), F.lit(6)), lambda j: j < (k + i) % 7), lambda j: F.concat(F.lit(" w "), j.cast("string")))
        return F.struct(offset.alias("offset_sec"), none.alias("at_seconds"), F.concat(words, F.array(F.lit(" "))).alias("keywords"), F.lit(" d ").alias("description"))

    numbers = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda i: i < k % 8)
    found = O.valid_cues(F.transform(numbers, cue))
    text = F.transform(found, lambda c: F.concat(c["offset_sec"].cast("decimal(9,2)").cast("string"), F.lit(":"), F.size(c["keywords"]).cast("string")))
    return orders(spark, d).select(K, found.alias("c"), F.array_join(text, " ").alias("cues")).select(K, F.size("c").alias("n"), "cues")


NAMES = ["Llamado al altar", "Oración y bendición", "Canto de entrada", "Sermón de hoy", "Sermon Introduction", "Announcements & Sermon Introduction", "Respuesta", "Parte"]
_NAME = f"({'[' + ', '.join(repr(x) for x in NAMES) + ']'})[CAST({{0}} % 8 AS INTEGER) + 1]"
KINDS = ["sermon", "offering", "closing", "other", "special_music", "announcement", "prayer", "post_sermon_response", "congregational_music"]
_KIND = f"({'[' + ', '.join(repr(x) for x in KINDS) + ']'})[CAST({{0}} % 9 AS INTEGER) + 1]"


def _nth(values: list[str], k: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def _contains(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


@query(f"""WITH r AS (SELECT {K}, {_KIND.format(K)} AS t, lower({_NAME.format(K)}) AS n FROM orders) SELECT {K}, t = 'post_sermon_response' OR {_contains('n', O.ALTAR_WORDS)} AS altar, t IN ('prayer', 'closing', 'benediction') OR {_contains('n', O.PRAYER_WORDS)} AS prayer,
    t IN ('congregational_music', 'special_music') OR (t = 'offering' AND {_contains('n', O.OFFERING_WORDS)}) OR {_contains('n', O.MUSIC_WORDS)} AS music FROM r""")
def section_kinds(spark: SparkSession, d: str) -> DataFrame:
    found = O.section_classes(_nth(KINDS, F.col(K)), _nth(NAMES, F.col(K)))
    return orders(spark, d).select(K, *(c.alias(n) for n, c in found.items()))


@query(rf"""WITH {SPOKEN} SELECT key, id, start + key % 5 AS start, "end" + key % 5 AS "end", CASE WHEN key % 2 = 0 THEN 'p' || key || ':' || speaker ELSE speaker END AS speaker FROM spoken""")
def shifted_turns(spark: SparkSession, d: str) -> DataFrame:
    prefix = F.when(F.col("key") % 2 == 0, F.concat(F.lit("p"), F.col("key").cast("string")))
    return O.shifted(spoken(spark, d), F.col("key") % 5, prefix).drop("text")


@query(f"""WITH r AS (SELECT o_custkey, {K}, {K} % 7 = 0 AND o_custkey % 3 = 0 AS x, {K} % 5 = 0 AND o_custkey % 2 = 0 AS y FROM orders), f AS (SELECT *, bool_or(x) OVER (PARTITION BY o_custkey) AS ax, bool_or(y) OVER (PARTITION BY o_custkey) AS ay FROM r)
    SELECT o_custkey, {K} FROM f WHERE CASE WHEN o_custkey % 11 = 0 THEN true WHEN ax THEN x WHEN ay THEN y ELSE true END""")
def package_choice(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).select("o_custkey", K, ((F.col(K) % 7 == 0) & (F.col("o_custkey") % 3 == 0)).alias("extract"), ((F.col(K) % 5 == 0) & (F.col("o_custkey") % 2 == 0)).alias("representative"))
    return O.chosen_for_package(rows, ["o_custkey"], F.col("o_custkey") % 11 == 0).select("o_custkey", K)


SHOWN = {"text": f"CASE {K} % 5 WHEN 0 THEN 'Tema: la fe' WHEN 1 THEN ' ab' WHEN 2 THEN 'Mensaje' WHEN 3 THEN 'Juan Soto' END", "kind": f"CASE {K} % 4 WHEN 0 THEN 'sermon_title' WHEN 1 THEN 'Speaker_Name' WHEN 2 THEN 'on_screen_text' END", "lane": f"CASE WHEN {K} % 3 = 0 THEN 'Slides' END", "c": f"CAST({K} % 10 AS DOUBLE) / 10"}
_SHOWN = ", ".join(f"{x} AS {n}" for n, x in SHOWN.items())


@query(rf"""WITH r AS (SELECT {K}, {_SHOWN}, ({K} % 6)::DOUBLE AS len FROM orders), t AS (SELECT *, trim(coalesce(text, '')) AS t, coalesce(kind, '') AS k FROM r)
    SELECT {K}, t <> '' AND (k = 'sermon_title' OR (lane IS NOT NULL AND regexp_matches(t, '(?i)\b(tema|t[íi]tulo|mensaje|serm[óo]n|predicaci[óo]n)\b'))) AS title, lower(k) = 'speaker_name' AND c >= 0.4::DOUBLE AND length(t) >= 3 AS speaker, k <> 'on_screen_text' OR len >= 3.0 AS kept FROM t""")
def positive_findings(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).select(K, *(F.expr(x).alias(n) for n, x in SHOWN.items()), (F.col(K) % 6).cast("double").alias("len"))
    c = F.col
    kept = O.lasting_text(F.coalesce("kind", F.lit("")), F.lit(0.0), c("len"), 2.0)
    return rows.select(K, O.title_candidate(c("text"), c("kind"), c("lane")).alias("title"), O.sure_speaker(c("text"), c("kind"), c("c"), 0.4).alias("speaker"), kept.alias("kept"))


HINT = {"s": f"CAST({K} % 3 * {K} AS DOUBLE)", "e": f"CASE WHEN {K} % 4 > 0 THEN CAST({K} * 2 - 4000 AS DOUBLE) END", "fs": f"CASE WHEN {K} % 5 > 0 THEN CAST({K} % 50 - 10 AS DOUBLE) END", "fe": f"CASE WHEN {K} % 7 > 0 THEN CAST({K} % 60 AS DOUBLE) END"}
_HINT = ", ".join(f"{x} AS {n}" for n, x in HINT.items())


@query(f"""WITH r AS (SELECT {K}, {_HINT} FROM orders) SELECT {K}, CASE WHEN s > 0 THEN s WHEN fs IS NOT NULL THEN greatest(0, fs) END AS start, CASE WHEN s > 0 THEN CASE WHEN e > s THEN e END WHEN fs IS NOT NULL THEN CASE WHEN fe > fs THEN fe END END AS "end" FROM r""")
def window_hints(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).select(K, *(F.expr(x).alias(n) for n, x in HINT.items()))
    c = F.col
    return rows.select(K, O.window_hint(c("s"), c("e"), c("fs"), c("fe")).alias("w")).select(K, "w.start", "w.end")


# --- documents --------------------------------------------------------------------------------------

#: Sections of conversations: runs of three turns.
SECTIONS = SPOKEN + f""", parts AS (SELECT key, (id - min(id) OVER (PARTITION BY key)) // 3 AS id, start, "end" FROM spoken), sec AS (SELECT key, id, min(start) AS start, max("end") AS "end", {_NAME.format('(key + id)')} AS title, {_KIND.format('(key * 2 + id)')} AS type, ((key + id) % 10) / 10.0::DOUBLE AS confidence FROM parts GROUP BY key, id)"""


def sections(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    part = F.floor((F.col("id") - F.min("id").over(W.partitionBy("key"))) / 3)
    made = spoken(spark, d).withColumn("id", part).groupBy("key", "id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return made.select("key", "id", "start", "end", _nth(NAMES, F.col("key") + F.col("id")).alias("title"), _nth(KINDS, F.col("key") * 2 + F.col("id")).alias("type"), ((F.col("key") + F.col("id")) % 10 / 10.0).alias("confidence"))


@query(f"""WITH {SECTIONS}, b AS (SELECT key, max("end") * 0.25::DOUBLE AS low, max("end") * 0.6::DOUBLE AS high FROM sec GROUP BY key)
    SELECT sec.key, 'chapters' AS part, sec.start, sec."end", title FROM sec JOIN b USING (key) WHERE sec."end" >= low AND sec.start <= high UNION ALL SELECT s.key, 'paragraphs', s.start, s."end", text FROM spoken s JOIN b USING (key) WHERE s."end" >= low AND s.start <= high""")
def context_in_bounds(spark: SparkSession, d: str) -> DataFrame:
    chapters = sections(spark, d).groupBy("key").agg(F.collect_list(F.struct("start", "end", "title", "type", "confidence")).alias("chapters"), F.max("end").alias("last"))
    paragraphs = spoken(spark, d).groupBy("key").agg(F.collect_list(F.struct("start", "end", F.lit(1).alias("chapter_index"), F.lit("").alias("chapter_title"), "text")).alias("paragraphs"))
    rows = chapters.join(paragraphs, "key").select("key", "last", F.to_json(F.struct("chapters", "paragraphs")).alias("json"))
    low, high = F.col("last") * 0.25, F.col("last") * 0.6
    found = [O.polished_context(rows, ["key"], "json", low, high, part).select("key", F.lit(part).alias("part"), "start", "end", F.col(text).alias("title")) for part, text in (("chapters", "title"), ("paragraphs", "text"))]
    return found[0].unionByName(found[1])


@query(f"""WITH {SECTIONS} SELECT key, type, count(*) AS n, sum("end" - start) AS seconds FROM sec GROUP BY key, type""")
def slide_event_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = sections(spark, d).groupBy("key").agg(F.to_json(F.struct(F.collect_list(F.struct("start", "end", "type", F.col("title").alias("text"))).alias("events"))).alias("json"))
    found = O.slide_events(rows, ["key"], "json")
    return found.groupBy("key", "type").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("seconds"))


# --- joins ------------------------------------------------------------------------------------------


@query(f"""WITH {SECTIONS} SELECT sec.key, sec.id, string_agg(text, ' ' ORDER BY s.start, s.id) AS text, count(*) AS n FROM sec JOIN spoken s ON s.key = sec.key AND s."end" >= sec.start AND s.start <= sec."end" GROUP BY sec.key, sec.id""")
def section_texts(spark: SparkSession, d: str) -> DataFrame:
    right = spoken(spark, d).select("key", F.col("id").alias("rid"), "text", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    pairs = interval_join(sections(spark, d).select("key", "id", "start", "end"), right, ["key"], 60.0, touches)
    packed = F.array_sort(F.collect_list(F.struct("r_start", "rid", "text")))
    return pairs.groupBy("key", "id").agg(F.array_join(F.transform(packed, lambda x: x["text"]), " ").alias("text"), F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT o_custkey, {K}, {K} % 300 AS s, {K} % 300 + {K} % 40 AS e FROM orders) SELECT o_custkey, {K}, EXISTS (SELECT 1 FROM orders b WHERE b.o_orderstatus = 'F' AND b.o_custkey = c.o_custkey AND b.{K} % 300 = s AND b.{K} % 300 + b.{K} % 40 = e) AS in_budget FROM c""")
def budget_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).select("o_custkey", K, "o_orderstatus", (F.col(K) % 300).alias("start"), (F.col(K) % 300 + F.col(K) % 40).alias("end"))
    picked = rows.where("o_orderstatus = 'F'").select("o_custkey", "start", "end").distinct().withColumn("in_budget", F.lit(True))
    return rows.join(picked, ["o_custkey", "start", "end"], "left").select("o_custkey", K, F.coalesce("in_budget", F.lit(False)).alias("in_budget"))


@query(f"""WITH f AS (SELECT '/tmp/out/clip_' || lpad(CAST({K} AS VARCHAR), 8, '0') || '_final.mp4' AS file FROM orders WHERE {K} % 3 = 0) SELECT o.{K}, f.file FROM orders o LEFT JOIN f ON regexp_extract(f.file, 'clip_[0-9]+') = 'clip_' || lpad(CAST(o.{K} AS VARCHAR), 8, '0')""")
def rendered_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of clips, joined by the clip id inside their names instead of a search of every name for every id."""
    name = F.concat(F.lit("clip_"), F.lpad(F.col(K).cast("string"), 8, "0"))
    files = orders(spark, d).where(f"{K} % 3 = 0").select(F.concat(F.lit("/tmp/out/"), name, F.lit("_final.mp4")).alias("file"))
    files = files.withColumn("clip", F.regexp_extract("file", "clip_[0-9]+", 0))
    return orders(spark, d).select(K, name.alias("clip")).join(files, "clip", "left").select(K, "file")


# --- signals ----------------------------------------------------------------------------------------

_SIDES = {"before": ("greatest(0, p.t - {b})", "greatest(0, p.t - 8)"), "after": ("greatest(0, p.t - 8)", "p.t + {a}"), "near": ("greatest(0, p.t - 95)", "p.t + 95")}


def _signal_sql(at_start: bool) -> str:
    before, after = (180, 210) if at_start else (160, 170)
    point = "start" if at_start else '"end"'
    texts = ", ".join(
        f"""(SELECT coalesce(string_agg(lower(text), ' ' ORDER BY s.start, s."end", s.id), '') FROM spoken s WHERE s.key = p.key AND s."end" >= {low.format(b=before, a=after)} AND s.start <= {high.format(b=before, a=after)} {"" if side == "near" else "AND " + _SPEECH}) AS {side}_text"""
        for side, (low, high) in _SIDES.items()
    )
    scores = ", ".join(f"round(({_hits('after_text', rx)}) * {O.CUE_WEIGHTS[n][0]}::DOUBLE + ({_hits('before_text', rx)}) * {O.CUE_WEIGHTS[n][1]}::DOUBLE, 6) AS {n}" for n, rx in O.CUES.items())
    return f"""WITH {SPOKEN}, p AS (SELECT key, id, {point} AS t FROM spoken), x AS (SELECT key, id, t, {texts} FROM p), y AS (SELECT *, {scores}, regexp_matches(after_text, '{O.GREETING}') AS greeting FROM x),
    z AS (SELECT *, prayer >= 2.2 AND sermon < 1.2 AS prayer_dominant, worship >= 1.9 AND sermon < 1.2 AS worship_dominant, announcement >= 1.7 AND sermon < 1.2 AS announcement_dominant FROM y)
    SELECT key, id, t, {', '.join(O.CUES)}, greeting, prayer_dominant, worship_dominant, announcement_dominant, round(sermon + CASE WHEN greeting THEN 1.2::DOUBLE ELSE 0.0::DOUBLE END, 6) >= 1.8 AND NOT (prayer_dominant OR worship_dominant OR announcement_dominant) AS sermon_likely,
        closing >= 1.3 OR (closing >= 0.8 AND handoff >= 0.8) AS closing_likely, handoff >= 1.0 OR {_says('near_text', O.HANDOFF_NEAR)} AS handoff_likely FROM z"""


@query(_signal_sql(True))
def text_signal_start(spark: SparkSession, d: str) -> DataFrame:
    rows = spoken(spark, d)
    return O.text_signal(rows.select("key", "id", F.col("start").alias("t")), rows, ["key"], True)


@query(_signal_sql(False))
def text_signal_end(spark: SparkSession, d: str) -> DataFrame:
    rows = spoken(spark, d)
    return O.text_signal(rows.select("key", "id", F.col("end").alias("t")), rows, ["key"], False)


def _candidates_sql(at_start: bool) -> str:
    cues = O.START_CUES + O.START_REJECTS if at_start else O.END_CUES
    score = " + ".join(f"CASE WHEN regexp_matches(lower(text), '{rx}') THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for w, rx in cues)
    t, guess, least = ("s.start", "ga", 1.2) if at_start else ('s."end"', "gb", 1.0)
    low, high = ("greatest(0, ga - 420)", "greatest(greatest(0, ga - 420) + 30, least(gb - 30, ga + 1800))") if at_start else ("greatest(ga + 60, gb - 1600)", "gb + 500")
    return f"""WITH RECURSIVE {SPOKEN}, g AS (SELECT key, max("end") * 0.3::DOUBLE AS ga, max("end") * 0.8::DOUBLE AS gb FROM spoken GROUP BY key),
    c AS (SELECT s.key, {t} AS t, round(0.0::DOUBLE + {score} + greatest(0.0::DOUBLE, 1 - abs({t} - {guess}) / 900), 6) AS score FROM spoken s JOIN g USING (key) WHERE {t} BETWEEN {low} AND {high} AND {_SPEECH}),
    r AS (SELECT key, t, row_number() OVER (PARTITION BY key ORDER BY score DESC, t) AS n FROM c WHERE score >= {least}),
    w AS (SELECT DISTINCT key, 0::BIGINT AS n, []::DOUBLE[] AS taken FROM r UNION ALL SELECT w.key, r.n, CASE WHEN len(taken) < 8 AND len(list_filter(taken, lambda x: abs(x - r.t) < 15)) = 0 THEN list_append(taken, r.t) ELSE taken END FROM w JOIN r ON r.key = w.key AND r.n = w.n + 1)
    SELECT key, unnest(arg_max(taken, n)) AS t FROM w GROUP BY key"""


def _guesses(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg((F.max("end") * 0.3).alias("guess_start"), (F.max("end") * 0.8).alias("guess_end"))


@query(_candidates_sql(True))
def start_cue_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = spoken(spark, d)
    return O.cue_candidates(rows, _guesses(rows), ["key"], True)


@query(_candidates_sql(False))
def end_cue_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = spoken(spark, d)
    return O.cue_candidates(rows, _guesses(rows), ["key"], False)


_DAY = 86_400_000_000
_SHOWN_TYPES = {"view": "song_lyric", "click": "sermon_title", "error": "bible_verse", "purchase": "speaker_name", "signup": "on_screen_text"}
_TYPE_SQL = "CASE label " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _SHOWN_TYPES.items()) + " END"
_TEXT_SQL = "CASE id % 4 WHEN 0 THEN 'Pastor Juan' WHEN 1 THEN 'Anciano: la gracia' WHEN 2 THEN 'hoy el pastor habla de la gracia sin medida' ELSE 'nada' END"
_GROUPS = {"cue": "type IN ('sermon_title', 'bible_verse')", "lyric": "type = 'song_lyric'", "name": "type = 'speaker_name'", "speaker": "named", "phrase": "phrase"}


def _share_sql(side: str, which: str) -> str:
    low, high = (f"greatest(p.t - {_DAY}, 0)", "p.t") if side == "before" else ("p.t", f"p.t + {_DAY}")
    return f"""round(coalesce(sum(CASE WHEN {which} THEN greatest(0, least(e."end", {high}) - greatest(e.start, {low})) / {_DAY}::DOUBLE END), 0), 6)"""


@query(rf"""WITH {TL}, e AS (SELECT key, start, "end", {_TYPE_SQL} AS type, id % 4 <> 3 AS named, id % 4 IN (1, 2) AS phrase FROM tl), p AS (SELECT key, id, start AS t FROM tl WHERE label = 'signup'),
    s AS (SELECT p.key, p.id, p.t, {', '.join(f'{_share_sql(side, w)} AS {side}_{n}' for side in ('before', 'after') for n, w in _GROUPS.items())} FROM p JOIN e ON e.key = p.key GROUP BY p.key, p.id, p.t)
    SELECT *, before_lyric >= 0.12 AND after_cue >= 0.08 AS lyric_to_sermon, before_cue >= 0.08 AND after_lyric >= 0.12 AS sermon_to_lyric, (before_lyric + after_lyric) / 2 >= 0.2 AS lyric_dominant, before_cue >= 0.08 OR after_cue >= 0.08 AS cue_near,
        before_name >= 0.08 OR after_name >= 0.08 OR before_speaker >= 0.08 OR after_speaker >= 0.08 AS name_near, before_phrase >= 0.1 OR after_phrase >= 0.1 AS phrase_near FROM s""")
def slide_signal(spark: SparkSession, d: str) -> DataFrame:
    rows = lasting(spark, d)
    kinds = F.create_map(*[F.lit(x) for pair in _SHOWN_TYPES.items() for x in pair])
    events_ = rows.select("key", kinds[F.col("label")].alias("type"), F.expr(_TEXT_SQL).alias("text"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return O.type_signal(rows.where("label = 'signup'").select("key", "id", F.col("start").alias("t")), events_, ["key"], _DAY, _DAY)


_SOUND = "CASE label WHEN 'view' THEN 'music' WHEN 'click' THEN 'speech' WHEN 'error' THEN 'noenergy' WHEN 'purchase' THEN 'male' ELSE 'other' END"


@query(f"""WITH {TL}, e AS (SELECT key, start, "end", {_SOUND} AS sound FROM tl), s AS (SELECT key, start // {_DAY} AS id, (start // {_DAY}) * {_DAY} AS start, (start // {_DAY} + 1) * {_DAY} AS "end" FROM tl GROUP BY ALL),
    x AS (SELECT s.key, s.id, s.start, s."end", {', '.join(f'''coalesce(sum(CASE WHEN sound IN ({names}) THEN greatest(0, least(e."end", s."end") - greatest(e.start, s.start)) END), 0) / {_DAY}::DOUBLE AS {n}''' for n, names in (('speech', "'speech', 'male'"), ('music', "'music'"), ('pause', "'noenergy'")))} FROM s JOIN e ON e.key = s.key GROUP BY s.key, s.id, s.start, s."end")
    SELECT key, id, start, "end", round(speech, 3) AS speech_ratio, round(music, 3) AS music_ratio, round(pause, 3) AS pause_ratio, music >= 0.2 AS has_music, pause >= 0.08 AS has_long_pause FROM x""")
def section_sound(spark: SparkSession, d: str) -> DataFrame:
    rows = lasting(spark, d)
    day = F.expr(f"start div {_DAY}").alias("id")
    parts = rows.select("key", day).distinct().select("key", "id", (F.col("id") * _DAY).alias("start"), ((F.col("id") + 1) * _DAY).alias("end"))
    sounds = rows.select("key", F.expr(_SOUND).alias("label"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return O.section_signals(parts, sounds, ["key"], _DAY)


def _rx(pattern: str) -> str:
    return pattern.replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b").replace("'", "''")


@query(rf"""WITH {SECTIONS}, m AS (SELECT *, type = 'sermon' OR {_contains('lower(title)', O.START_WORDS)} AS b, type IN ('sermon', 'post_sermon_response', 'closing', 'benediction') OR {_contains('lower(title)', O.END_WORDS)} AS z FROM sec WHERE "end" > start),
    l AS (SELECT m.key, m.id, {', '.join(f"count(CASE WHEN regexp_matches(text, '(?i)(?:{_rx(rx)})') THEN 1 END) AS {n}" for n, rx in (('k', T.KICKOFF_TEXT), ('p', T.PRAYER_TEXT), ('w', T.WORSHIP_TEXT), ('c', T.CALL_TO_WORSHIP)))} FROM m JOIN spoken s ON s.key = m.key AND s."end" >= m.start AND s.start <= least(m."end", m.start + 240) WHERE b GROUP BY m.key, m.id),
    x AS (SELECT m.*, b AND NOT coalesce(c > 0 OR p + w > k + 2, false) AS clean FROM m LEFT JOIN l USING (key, id)), y AS (SELECT *, CASE WHEN bool_or(clean) OVER (PARTITION BY key) THEN clean ELSE b END AS pool FROM x)
    SELECT key, min(CASE WHEN pool THEN start END) AS start, max(CASE WHEN z THEN "end" END) AS "end", round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, sum(CASE WHEN pool THEN confidence ELSE 0.0 END + CASE WHEN z THEN confidence ELSE 0.0 END) / sum(pool::INTEGER + z::INTEGER))), 6) AS confidence
    FROM y GROUP BY key HAVING min(CASE WHEN pool THEN start END) IS NOT NULL AND max(CASE WHEN z THEN "end" END) IS NOT NULL""")
def sermon_hints(spark: SparkSession, d: str) -> DataFrame:
    return O.sermon_hint(sections(spark, d), spoken(spark, d), ["key"])


@query(rf"""WITH {SPOKEN}, x AS (SELECT key, arg_min(start, (start, "end", id)) FILTER (WHERE {_contains('lower(text)', O.START_KEYWORDS)}) AS a, arg_max("end", (start, "end", id)) FILTER (WHERE {_contains('lower(text)', O.END_KEYWORDS)}) AS b, arg_max("end", (start, "end", id)) AS last FROM spoken GROUP BY key), y AS (SELECT key, coalesce(a, 0) AS a, coalesce(b, last) AS b, last FROM x)
    SELECT key, CASE WHEN a >= b THEN 0 ELSE a END AS start, CASE WHEN a >= b THEN last ELSE b END AS "end" FROM y""")
def keyword_bounds(spark: SparkSession, d: str) -> DataFrame:
    return O.keyword_bounds(spoken(spark, d), ["key"])


# --- cuts and titles --------------------------------------------------------------------------------


@query(rf"""WITH {SECTIONS}, f AS (SELECT sec.key, sec.id, min({{'s': s.start, 'i': s.id}}) FILTER (WHERE regexp_matches(text, '(?i)(?:{O.INTRO_CUE})')) AS c, min({{'s': s.start, 'i': s.id}}) FILTER (WHERE regexp_matches(text, '(?i)(?:{O.NOTICE_CUE})')) AS n FROM sec JOIN spoken s ON s.key = sec.key AND s."end" >= sec.start AND s.start <= sec."end" GROUP BY sec.key, sec.id),
    x AS (SELECT sec.*, greatest(start, least("end", c.s)) AS t, c.s IS NOT NULL AND (regexp_matches(title, '(?i)(?:{O.MIXED_TITLE})') OR (type = 'announcement' AND coalesce(n < c, false))) AS split FROM sec LEFT JOIN f USING (key, id)), y AS (SELECT *, split AND t - start >= 10 AND "end" - t >= 10 AS two FROM x)
    SELECT key, id, start, "end", CASE WHEN split THEN 'Sermon Introduction' ELSE title END AS title, CASE WHEN split THEN 'sermon' ELSE type END AS type, confidence FROM y WHERE NOT coalesce(two, false)
    UNION ALL SELECT key, id, start, t, 'Announcements', 'announcement', round(greatest(0.5::DOUBLE, confidence - 0.05::DOUBLE), 2) FROM y WHERE two UNION ALL SELECT key, id, t, "end", 'Sermon Introduction', 'sermon', confidence FROM y WHERE two""")
def split_notices(spark: SparkSession, d: str) -> DataFrame:
    return O.split_notices_from_sermon(sections(spark, d), spoken(spark, d), ["key"])


@query(rf"""WITH {SECTIONS}, b AS (SELECT *, max("end") OVER (PARTITION BY key) + key % 5 - 2 AS boundary FROM sec), f AS (SELECT sec.key, sec.id, min(s.start) FILTER (WHERE regexp_matches(text, '(?i)(?:{O.PRE_INTRO_CUE})')) AS c FROM sec JOIN spoken s ON s.key = sec.key AND s."end" >= sec.start AND s.start <= sec."end" GROUP BY sec.key, sec.id),
    x AS (SELECT b.*, greatest(start, least("end", c)) AS t, coalesce(c IS NOT NULL AND abs("end" - boundary) <= 2 AND start < boundary AND type <> 'sermon' AND NOT regexp_matches(title, '(?i)sermon introduction'), false) AS here FROM b LEFT JOIN f USING (key, id)),
    y AS (SELECT *, here AND t - start >= 20 AND "end" - t >= 20 AS two, here AND t - start < 20 AND "end" - t >= 120 AS whole FROM x)
    SELECT key, id, boundary, start, "end", CASE WHEN whole THEN 'Sermon Introduction' ELSE title END AS title, CASE WHEN whole THEN 'sermon' ELSE type END AS type, CASE WHEN whole THEN round(greatest(0.75::DOUBLE, confidence), 2) ELSE confidence END AS confidence FROM y WHERE NOT coalesce(two, false)
    UNION ALL SELECT key, id, boundary, start, t, title, type, confidence FROM y WHERE two UNION ALL SELECT key, id, boundary, t, "end", 'Sermon Introduction', 'sermon', round(greatest(0.75::DOUBLE, confidence), 2) FROM y WHERE two""")
def split_at_sermon(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    rows = sections(spark, d).withColumn("boundary", F.max("end").over(W.partitionBy("key")) + F.col("key") % 5 - 2)
    return O.split_before_sermon(rows, spoken(spark, d), ["key"], "boundary")


@query(f"""WITH {SECTIONS}, n AS (SELECT *, lag(type) OVER w AS p, lead(type) OVER w AS q FROM sec WINDOW w AS (PARTITION BY key ORDER BY start, id)) SELECT key, id, start, "end", CASE WHEN confidence >= 0.78 THEN title WHEN type = 'congregational_music' AND (p = 'sermon' OR q = 'sermon') THEN 'Continuación del sermón'
    WHEN type = 'other' AND p = 'sermon' THEN 'Transición posterior al sermón' WHEN type = 'prayer' THEN 'Oración congregacional' ELSE 'Sección por revisar' END AS title, type, confidence FROM n""")
def neighbour_titles(spark: SparkSession, d: str) -> DataFrame:
    return O.titles_by_neighbours(sections(spark, d), ["key"])


# --- choices ----------------------------------------------------------------------------------------


def _flag(k: int, name: str, unit: str) -> str:
    """The k-th evidence of a candidate: a score for the names that carry one, else a condition."""
    if name.endswith("cue") or name in ("prayer", "worship", "announcement", "closing", "handoff"):
        return f"({K} % {k + 3})::DOUBLE / 4.0::DOUBLE" if unit == "sql" else f"CAST({K} % {k + 3} AS DOUBLE) / 4.0D"
    return f"({K} % {k + 2} = 0)"


def _scored_sql(weights: list[tuple[float, str]]) -> str:
    terms = " + ".join(f"{w}::DOUBLE * ({_flag(k, n, 'sql')})::DOUBLE" for k, (w, n) in enumerate(weights))
    dragged = f"{K} % 4 = 0 AND ({K} % 5 = 0 OR {K} % 6 = 0) AND {K} % 3 = 0"
    return f"""WITH r AS (SELECT o_custkey AS key, {K}, ({K} % 900)::DOUBLE AS seed, CASE WHEN {dragged} THEN ({K} % 900)::DOUBLE ELSE ({K} % 900)::DOUBLE - ({K} % 4 = 0)::INTEGER * 30 END AS t, {K} % 7 = 0 AS strong FROM orders),
    s AS (SELECT r.*, round(0.0::DOUBLE + {terms.replace(K, 'r.' + K)} - abs(t - 450.0::DOUBLE) / 90, 6) AS score FROM r), b AS (SELECT key, arg_max({{'t': t, 'strong': strong, 'seed': seed}}, (score, -{K})) AS x, max(score) AS score FROM s GROUP BY key), f AS (SELECT key, x.t AS t, x.strong AS strong, x.seed AS seed, score, CASE WHEN key % 3 > 0 THEN (key * 13 % 900)::DOUBLE END AS back FROM b)
    SELECT key, seed, score, CASE WHEN NOT strong AND back IS NOT NULL AND abs(back - t) <= 360 AND key % 2 = 0 THEN back ELSE t END AS t, CASE WHEN strong OR back IS NULL THEN 'scored' WHEN abs(back - t) <= 360 AND key % 2 = 0 THEN 'fallback' ELSE 'fallback_rejected' END AS chosen FROM f"""


def _scored(spark: SparkSession, d: str, weights: list[tuple[float, str]]) -> DataFrame:
    k = F.col(K)
    flags = {n: F.expr(_flag(i, n, "spark")) for i, (_, n) in enumerate(weights)}
    rows = orders(spark, d).select(F.col("o_custkey").alias("key"), K, (k % 900).cast("double").alias("seed"), (k % 7 == 0).alias("strong"), *(c.alias(n) for n, c in flags.items()))
    moved = F.col("seed") - F.when(k % 4 == 0, 30.0).otherwise(0.0)
    rows = rows.withColumn("t", scoring.undragged(F.col("seed"), moved, (k % 5 == 0) | (k % 6 == 0), k % 3 == 0))
    rows = rows.withColumn("score", F.round(scoring.candidate_score(weights, F.col("t"), F.lit(450.0), rows.columns), 6))
    best = rows.groupBy("key").agg(F.max_by(F.struct("t", "strong", "seed", "score"), F.struct("score", -k)).alias("x")).select("key", "x.*")
    back = F.when(F.col("key") % 3 > 0, (F.col("key") * 13 % 900).cast("double"))
    final = scoring.with_fallback(F.col("t"), F.col("strong"), back, F.col("key") % 2 == 0, 360.0)
    return best.select("key", "seed", "score", final["t"].alias("t"), final["chosen"].alias("chosen"))


@query(_scored_sql(scoring.START_WEIGHTS))
def start_choice(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, scoring.START_WEIGHTS)


@query(_scored_sql(scoring.END_WEIGHTS))
def end_choice(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, scoring.END_WEIGHTS)


@query(f"""SELECT {K}, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({K} % 10)::DOUBLE / 10 * 0.20::DOUBLE + ({K} % 7)::DOUBLE / 7 * 0.30::DOUBLE + ({K} % 3)::DOUBLE / 3 * 0.15::DOUBLE + ({K} % 5)::DOUBLE / 5 * 0.35::DOUBLE)), 3) AS score FROM orders""")
def clip_scores(spark: SparkSession, d: str) -> DataFrame:
    part = lambda n: (F.col(K) % n).cast("double") / n
    return orders(spark, d).select(K, scoring.clip_score(part(10), part(7), part(3), part(5)).alias("score"))


@query(f"""WITH RECURSIVE c AS (SELECT o_custkey AS key, {K}, ({K} * 37 % 600)::DOUBLE AS s, ({K} * 37 % 600 + 20 + {K} % 60)::DOUBLE AS e, row_number() OVER (PARTITION BY o_custkey ORDER BY {K} % 2, o_orderdate, {K}) AS n FROM orders),
    w AS (SELECT DISTINCT key, 0::BIGINT AS n, []::STRUCT(s DOUBLE, e DOUBLE)[] AS taken FROM c UNION ALL SELECT w.key, c.n, CASE WHEN len(taken) < 6 AND len(list_filter(taken, lambda x: x.s < c.e + 2 AND c.s < x.e + 2)) = 0 THEN list_append(taken, {{'s': c.s, 'e': c.e}}) ELSE taken END FROM w JOIN c ON c.key = w.key AND c.n = w.n + 1),
    k AS (SELECT key, unnest(arg_max(taken, n)) AS x FROM w GROUP BY key) SELECT key, x.s AS start, x.e AS "end" FROM k""")
def accepted_clips(spark: SparkSession, d: str) -> DataFrame:
    """Clips in the order in which they were proposed, those of a second pass after all of the first."""
    k = F.col(K)
    rows = orders(spark, d).select(F.col("o_custkey").alias("key"), K, (k % 2).alias("turn"), F.col("o_orderdate").alias("proposed"), (k * 37 % 600).cast("double").alias("start"), (k * 37 % 600 + 20 + k % 60).cast("double").alias("end"))
    kept = P.disjoint(rows, ["key"], ["turn", "proposed", K], 2.0, 6)
    return kept.select("key", F.explode("kept").alias("k")).select("key", "k.start", "k.end")


# --- identities -------------------------------------------------------------------------------------

#: Hits of identities: the events of a user are a recording, their types identities.
HITS = TL + """, hits AS (SELECT key, label AS cluster, start / 1e6::DOUBLE AS t, (id % 10) / 10.0::DOUBLE AS center, (id % 7) / 100.0::DOUBLE AS area FROM tl), zero AS (SELECT key, min(t) AS z, max(t) - min(t) AS d FROM hits GROUP BY key), h AS (SELECT key, cluster, t - z AS t, center, area, d FROM hits JOIN zero USING (key)),
    runs AS (SELECT key, cluster, min(t) AS start, max(t) + 600 AS "end" FROM (SELECT *, sum(new) OVER (PARTITION BY key, cluster ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY key, cluster ORDER BY t) <= 172800 THEN 0 ELSE 1 END AS new FROM h)) GROUP BY key, cluster, run)"""


def _hit_rows(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    rows = lasting(spark, d).select("key", "id", F.col("label").alias("cluster"), (F.col("start") / 1e6).alias("t"), (F.col("id") % 10 / 10.0).alias("center"), (F.col("id") % 7 / 100.0).alias("area"), F.lit(600.0).alias("step"))
    w = W.partitionBy("key")
    return rows.withColumn("_z", F.min("t").over(w)).withColumn("d", F.max("t").over(w) - F.col("_z")).withColumn("t", F.col("t") - F.col("_z")).drop("_z")


def _run_rows(rows: DataFrame) -> DataFrame:
    points = rows.select("key", "cluster", "id", F.col("t").alias("start"), F.col("t").alias("end"))
    return L.merge(points, ["key", "cluster"], 172_800.0).select("key", "cluster", "start", (F.col("end") + 600).alias("end"))


@query(f"""WITH {HITS}, s AS (SELECT key, cluster, count(*) * 600.0::DOUBLE AS presence, avg(center) AS c, avg(area) AS a, avg((t BETWEEN 0.2::DOUBLE * d AND 0.8::DOUBLE * d)::INTEGER) AS m, max(greatest(1.0::DOUBLE, d)) AS d FROM h GROUP BY key, cluster), l AS (SELECT key, cluster, max("end" - start) AS longest FROM runs GROUP BY key, cluster)
    SELECT key, cluster, presence, longest, round(0.45::DOUBLE * least(1.0::DOUBLE, longest / d) + 0.30::DOUBLE * least(1.0::DOUBLE, presence / d) + 0.10::DOUBLE * c + 0.10::DOUBLE * least(1.0::DOUBLE, a * 12.0::DOUBLE) + 0.05::DOUBLE * m, 6) AS score FROM s JOIN l USING (key, cluster)""")
def identity_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _hit_rows(spark, d)
    return O.identity_scores(rows, _run_rows(rows), ["key"], F.col("d"))


@query(f"""WITH {HITS}, m AS (SELECT key, cluster, arg_max(start, ("end" - start, -start)) AS ms, max("end" - start) AS ml FROM runs GROUP BY key, cluster), r AS (SELECT runs.*, ms, ml, "end" - start >= greatest(3600.0::DOUBLE, greatest(1.0::DOUBLE, ml) * 0.4::DOUBLE) AS sig FROM runs JOIN m USING (key, cluster))
    SELECT key, cluster, coalesce(min(CASE WHEN sig AND start >= ms - 604800 THEN start END), min(CASE WHEN sig THEN start END), min(ms)) AS start, coalesce(max(CASE WHEN sig THEN "end" END), min(ms + ml)) AS "end" FROM r GROUP BY key, cluster""")
def identity_bounds(spark: SparkSession, d: str) -> DataFrame:
    return O.significant_bounds(_run_rows(_hit_rows(spark, d)), ["key", "cluster"], 3600.0, 0.4, 604_800.0)


FACE = {n: f"CAST({K} * {m} % 100 AS DOUBLE) / 100" for n, m in (("identity", 7), ("height", 3), ("active", 11), ("prev", 13), ("center", 17), ("area", 19), ("talk", 23), ("motion", 29))}
_FACE = ", ".join(f"{x} AS {n}" for n, x in FACE.items())


@query(f"""WITH f AS (SELECT o_custkey AS key, {K} AS id, CAST(month(o_orderdate) AS INTEGER) AS t, {_FACE} FROM orders), w AS (SELECT *, max(identity) OVER (PARTITION BY key, t) AS bi, max(height) OVER (PARTITION BY key, t) AS bh FROM f), k AS (SELECT *, identity >= bi - 0.06::DOUBLE AND (height >= 0.2 OR height >= bh * 0.85::DOUBLE) AS keep FROM w), a AS (SELECT *, bool_or(keep) OVER (PARTITION BY key, t) AS anyk FROM k),
    c AS (SELECT *, talk / greatest(0.000001::DOUBLE, max(talk) OVER (PARTITION BY key, t)) AS ts FROM a WHERE keep OR NOT anyk), s AS (SELECT key, t, id, round(0.50::DOUBLE * identity + 0.08::DOUBLE * active + 0.14::DOUBLE * prev + 0.06::DOUBLE * center + 0.10::DOUBLE * area + 0.12::DOUBLE * ts + 0.05::DOUBLE * motion, 6) AS score FROM c)
    SELECT key, t, arg_max(id, (score, -id)) AS id, max(score) AS score FROM s GROUP BY key, t""")
def face_picks(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).select(F.col("o_custkey").alias("key"), F.col(K).alias("id"), F.month("o_orderdate").alias("t"), *(F.expr(x).alias(n) for n, x in FACE.items()))
    return O.pick_faces(rows, ["key"], "t", least_height=0.2)


@query(f"""WITH {SPOKEN}, a AS (SELECT key, speaker, max("end") * 0.3::DOUBLE AS around_start, max("end") * 0.7::DOUBLE AS around_end FROM spoken GROUP BY key, speaker), x AS (SELECT s.key, s.speaker, around_start, around_end, start, "end", start <= around_start AND "end" >= around_start AS ha, start <= around_end AND "end" >= around_end AS hb FROM spoken s JOIN a USING (key, speaker))
    SELECT key, speaker, around_start, around_end, arg_min(start, (CASE WHEN ha THEN 0 ELSE 1 END, CASE WHEN ha THEN 0.0::DOUBLE ELSE abs(start - around_start) END, start, "end")) AS start, arg_min("end", (CASE WHEN hb THEN 0 ELSE 1 END, CASE WHEN hb THEN 0.0::DOUBLE ELSE abs("end" - around_end) END, start, "end")) AS "end" FROM x GROUP BY ALL""")
def speaker_bounds(spark: SparkSession, d: str) -> DataFrame:
    rows = spoken(spark, d)
    asked = rows.groupBy("key", "speaker").agg((F.max("end") * 0.3).alias("around_start"), (F.max("end") * 0.7).alias("around_end"))
    return O.speaker_bounds(rows, asked, ["key"])


@query(f"""WITH {SPOKEN}, g AS (SELECT *, row_number() OVER (PARTITION BY key, speaker ORDER BY start, id) AS nth, lag("end") OVER (PARTITION BY key, speaker ORDER BY start, id) AS was FROM spoken),
    n AS (SELECT key, speaker, id, start, "end", was IS NULL OR start - was > 1.5 OR EXISTS (SELECT 1 FROM spoken o WHERE o.key = g.key AND o.speaker <> g.speaker AND least(o."end", greatest(was, g.start) + 0.2::DOUBLE) - greatest(o.start, least(was, g.start) - 0.2::DOUBLE) >= 0.35) AS new FROM g),
    c AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY key, speaker ORDER BY start, id ROWS UNBOUNDED PRECEDING) AS chain FROM n), a AS (SELECT key, speaker, max("end") * 0.5::DOUBLE AS guess FROM spoken GROUP BY key, speaker),
    p AS (SELECT a.key, a.speaker, guess, c.start, c.chain, CASE WHEN c.start <= guess AND c."end" >= guess THEN 0 WHEN c.start >= guess THEN 1 ELSE 2 END AS kind FROM a JOIN c ON c.key = a.key AND c.speaker = a.speaker AND c."end" >= guess - 120 AND c.start <= guess + 25),
    h AS (SELECT key, speaker, guess, arg_min({{'at': start, 'chain': chain}}, (kind, CASE WHEN kind < 2 THEN start ELSE -start END)) AS x FROM p GROUP BY ALL), w AS (SELECT h.key, h.speaker, min(p.start) AS start FROM h JOIN p ON p.key = h.key AND p.speaker = h.speaker AND p.chain = h.x.chain AND p.start <= h.x.at GROUP BY ALL)
    SELECT a.key, a.speaker, a.guess, coalesce(w.start, a.guess) AS start FROM a LEFT JOIN w ON w.key = a.key AND w.speaker = a.speaker""")
def anchored_chains(spark: SparkSession, d: str) -> DataFrame:
    rows = spoken(spark, d)
    asked = rows.groupBy("key", "speaker").agg((F.max("end") * 0.5).alias("guess"))
    return O.chain_starts(rows, asked, ["key"])
