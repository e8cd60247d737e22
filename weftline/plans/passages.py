"""Queries over passages: paragraphs in sections, walks from a guess, texts of tracks, regions of samples, heads and tails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators import bounds as B
from weftline.operators import folds
from weftline.operators import islands as L
from weftline.operators import sections as O
from weftline.operators import selection as P
from weftline.plans.checks import TIDY
from weftline.plans.registry import query
from weftline.plans.sections import SPOKEN, spoken
from weftline.plans.timeline import EV, HOUR, STOP, TURNS, events, turns


@query(f"""
    WITH {SPOKEN}, g AS (
        SELECT *, lag("end") OVER (PARTITION BY key, speaker ORDER BY start, id) AS was FROM spoken
    ), n AS (
        SELECT key, speaker, id, start, "end", was IS NULL OR start - was > 1.5 OR EXISTS (
                   SELECT 1 FROM spoken o WHERE o.key = g.key AND o.speaker <> g.speaker
                   AND least(o."end", greatest(was, g.start) + 0.2::DOUBLE) - greatest(o.start, least(was, g.start) - 0.2::DOUBLE) >= 0.35) AS new
        FROM g
    ), c AS (
        SELECT *, sum(new::INTEGER) OVER (PARTITION BY key, speaker ORDER BY start, id ROWS UNBOUNDED PRECEDING) AS chain FROM n
    ), a AS (
        SELECT key, speaker, max("end") * 0.4::DOUBLE AS guess FROM spoken GROUP BY key, speaker
    ), p AS (
        SELECT a.key, a.speaker, guess, c.id, c.start, c."end", c.chain, CASE WHEN c.start <= guess AND c."end" >= guess THEN 0 WHEN c."end" <= guess THEN 1 ELSE 2 END AS kind
        FROM a JOIN c ON c.key = a.key AND c.speaker = a.speaker AND c."end" >= guess - 40 AND c.start <= guess + 120
    ), h AS (
        SELECT key, speaker, guess, arg_min({{'at': start, 'chain': chain}}, (kind, CASE WHEN kind = 1 THEN -start ELSE start END, id)) AS x FROM p GROUP BY ALL
    ), w AS (
        SELECT h.key, h.speaker, arg_max(p."end", (p.start, p.id)) AS "end"
        FROM h JOIN p ON p.key = h.key AND p.speaker = h.speaker AND p.chain = h.x.chain AND p.start >= h.x.at GROUP BY ALL
    )
    SELECT a.key, a.speaker, a.guess, coalesce(w."end", a.guess) AS "end" FROM a LEFT JOIN w ON w.key = a.key AND w.speaker = a.speaker""")
def anchored_chain_ends(spark: SparkSession, d: str) -> DataFrame:
    rows = spoken(spark, d)
    asked = rows.groupBy("key", "speaker").agg((F.max("end") * 0.4).alias("guess"))
    return O.chain_ends(rows, asked, ["key"])


@query(rf"""
    WITH {TURNS}, marked AS (
        SELECT *, CASE WHEN start - lag("end") OVER w > 1400 OR regexp_matches(lag(text) OVER w, '[.!?]["'')\]]?$') OR lag(id) OVER w IS NULL THEN 1 ELSE 0 END AS is_new
        FROM turns WHERE text <> '' WINDOW w AS (PARTITION BY key ORDER BY start, "end", id)
    ), numbered AS (
        SELECT *, sum(is_new) OVER (PARTITION BY key ORDER BY start, "end", id ROWS UNBOUNDED PRECEDING) AS island FROM marked
    ), par AS (
        SELECT key, CAST(island AS BIGINT) AS island, min(start) AS start, arg_max("end", (start, "end", id)) AS "end", string_agg(text, ' ' ORDER BY start, "end", id) AS text FROM numbered GROUP BY key, island
    ), sec AS (
        SELECT key, i AS "index", i * 90000 + 20000 AS start, i * 90000 + 80000 AS "end", 'Part ' || i AS title, i = max(i) OVER (PARTITION BY key) AS is_last
        FROM (SELECT key, max("end") AS e FROM turns WHERE key % 7 <> 0 GROUP BY key), unnest(range(0, CAST(e // 90000 AS BIGINT) + 1)) u(i)
    ), cand AS (
        SELECT par.key, island, s."index", s.title, CASE WHEN par.start >= s.start AND (par.start < s."end" OR (s.is_last AND par.start = s."end")) THEN 0 ELSE 1 END AS o,
               least(abs(par.start - s.start), abs(par.start - s."end")) AS dist FROM par JOIN sec s USING (key)
    ), best AS (
        SELECT key, island, arg_min({{'i': "index", 't': title}}, (o, CASE WHEN o = 0 THEN 0 ELSE dist END, "index")) AS x FROM cand GROUP BY key, island
    )
    SELECT par.*, x.i AS section, coalesce(x.t, 'Sin capítulo') AS section_title FROM par LEFT JOIN best USING (key, island)""")
def paragraphs_in_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = turns(spark, d)
    ends = rows.where("key % 7 <> 0").groupBy("key").agg(F.max("end").alias("e"))
    sections = ends.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("e div 90000"))).alias("index"))
    sections = sections.withColumns({"start": F.col("index") * 90_000 + 20_000, "end": F.col("index") * 90_000 + 80_000, "title": F.concat(F.lit("Part "), F.col("index").cast("string"))})
    paragraphs = L.paragraphs(rows, ["key"], 1400, STOP).drop("n")
    return O.paragraph_sections(paragraphs, sections, ["key"])


@query(rf"""
    WITH {SPOKEN}, t AS (
        SELECT key, speaker AS track_key, CASE WHEN speaker = 'user' THEN 'lower_third' ELSE 'slide' END AS region, min(start) AS start, max("end") AS "end", count(*) AS n,
               arg_max(text, (length(text), -id)) AS text, (max(id) % 10) / 10::DOUBLE AS confidence FROM spoken GROUP BY key, speaker
    ), c AS (
        SELECT *, {TIDY} AS tidied FROM t
    ), m AS (
        SELECT *, length(regexp_replace(tidied, '[^\p{{L}}]', '', 'g')) / length(tidied) AS alpha, length(regexp_replace(tidied, '[^\p{{L}}\p{{N}}]', '', 'g')) / length(tidied) AS alnum,
               length(regexp_replace(tidied, '[\p{{L}}\p{{N}}\s]', '', 'g')) / length(tidied) AS symbols FROM c WHERE tidied <> ''
    )
    SELECT key, track_key, region, start + 1 AS start, "end", tidied AS text, confidence FROM m
    WHERE alpha >= 0.5 AND alnum >= 0.6 AND symbols <= 0.2 AND (n >= 2 OR confidence >= 0.8) AND (confidence >= 0.4 OR confidence >= 0.8)""")
def fused_track_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = spoken(spark, d)
    region = F.when(F.col("speaker") == "user", "lower_third").otherwise("slide")
    own = rows.groupBy("key", F.col("speaker").alias("track_key"), region.alias("region")).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.max_by("text", F.struct(F.length("text"), -F.col("id"))).alias("text"), (F.max("id") % 10 / 10).alias("confidence")
    )
    fused = own.select("key", "track_key", "text", "confidence", "n", (F.col("start") + 1).alias("start"), (F.col("end") + 1).alias("end"))
    return O.fused_segments(own.select("key", "track_key", "region", "start", "end"), fused, ["key"], O.TextGates(confidence=0.4)).drop("type")


@query(f"""
    WITH RECURSIVE {EV}, s AS (
        SELECT key, start // {6 * HOUR} AS t, label AS region, max(cents) / 30000::DOUBLE AS score, bool_or(label = 'error' AND cents % 7 = 0) AS cut FROM ev GROUP BY ALL
    ), f AS (
        SELECT key, t, list({{'s': -score, 'r': region}} ORDER BY -score, region) AS regions, greatest(0, 0.5::DOUBLE - CASE WHEN bool_or(cut) THEN 0.1::DOUBLE ELSE 0 END) AS least,
               row_number() OVER (PARTITION BY key ORDER BY t) AS n FROM s GROUP BY key, t
    ), w AS (
        SELECT DISTINCT key, 0::BIGINT AS n, NULL::BIGINT AS t, []::STRUCT(s DOUBLE, r VARCHAR)[] AS taken, false AS forced FROM f
        UNION ALL
        SELECT key, n, t, CASE WHEN len(good) = 0 AND n % 10 = 0 THEN regions[1:1] ELSE good[1:2] END, len(good) = 0 AND n % 10 = 0
        FROM (SELECT f.*, list_filter(f.regions, lambda x: -x.s >= CASE WHEN list_contains(list_transform(w.taken, lambda y: y.r), x.r) THEN f.least * 0.7::DOUBLE ELSE f.least END) AS good
              FROM w JOIN f ON f.key = w.key AND f.n = w.n + 1)
    )
    SELECT key, t, x.r AS region, forced FROM (SELECT key, t, unnest(taken) AS x, forced FROM w)""")
def regions_taken(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("t", F.expr(f"start div {6 * HOUR}"))
    cut = (F.col("label") == "error") & (F.col("cents") % 7 == 0)
    samples = rows.groupBy("key", "t", F.col("label").alias("region")).agg((F.max("cents") / 30000).alias("score"), F.max(cut).alias("cut"))
    return folds.region_gate(samples, ["key"])


@query(f"""
    WITH {TURNS}, r AS (
        SELECT key, id, start, row_number() OVER (PARTITION BY key ORDER BY start, id) AS place, row_number() OVER (PARTITION BY key ORDER BY start DESC, id DESC) AS back FROM turns
    )
    SELECT key, id, start, place FROM r WHERE place <= 2 OR back <= 1""")
def heads_and_tails(spark: SparkSession, d: str) -> DataFrame:
    return P.head_and_tail(turns(spark, d).select("key", "id", "start"), ["key"], ["start", "id"], 2, 1)


@query(f"""
    WITH {EV}, faces AS (
        SELECT key, id, start // {24 * HOUR} AS frame, label AS identity, cents FROM ev
    ), top AS (
        SELECT *, row_number() OVER (PARTITION BY key, frame ORDER BY cents DESC, id) AS rank FROM faces
    ), scores AS (
        SELECT key, identity, CAST(sum(cents) AS BIGINT) AS score, count(*) AS n FROM top WHERE rank <= 3 GROUP BY key, identity
    )
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, identity) AS rank FROM scores) WHERE rank <= 3""")
def best_identities(spark: SparkSession, d: str) -> DataFrame:
    """The surest faces of each frame, then the identities of a user that have most of them."""
    faces = events(spark, d).select("key", "id", F.expr(f"start div {24 * HOUR}").alias("frame"), F.col("label").alias("identity"), "cents")
    kept = P.top(faces, ["key", "frame"], [F.desc("cents"), F.asc("id")], 3)
    scores = kept.groupBy("key", "identity").agg(F.sum("cents").alias("score"), F.count("*").alias("n"))
    return P.top(scores, ["key"], [F.desc("score"), F.asc("identity")], 3)


@query(None)
def talk_bounds(spark: SparkSession, d: str) -> DataFrame:
    """From segments to bounds: conversations as recordings, their roles as voices, what they say as sounds and slides."""
    rows = spoken(spark, d)
    text = F.lower("text")
    sings = text.rlike("cantar|himno|alabar")
    voice = F.when(sings, "music").when(F.col("speaker") == "user", "male").otherwise("female")
    sounds = rows.select("key", voice.alias("label"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    next_start = F.lead("start").over(W.partitionBy("key").orderBy("start", "id"))
    pauses = rows.select("key", F.lit("noenergy").alias("label"), F.col("end").alias("r_start"), next_start.alias("r_end")).where("r_end > r_start")
    sounds = sounds.unionByName(pauses)
    kind = F.when(sings, "song_lyric").when(text.rlike("mensaje|tema"), "sermon_title").when(text.contains("biblias"), "bible_verse").otherwise("on_screen_text")
    slides = rows.select("key", kind.alias("type"), "text", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    ends = rows.groupBy("key").agg((F.max("end") * 0.3).alias("guess_start"), (F.max("end") * 0.8).alias("guess_end"), F.max_by("speaker", "start").alias("start_speaker"), F.min_by("speaker", "start").alias("end_speaker"))
    return B.talk_bounds(rows, sounds, slides, rows.select("key", "id", "start", "end", "speaker"), ends, ["key"])


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Two sections for each conversation: all but its last 50 seconds, and those."""
    ends = spoken(spark, d).groupBy("key").agg(F.max("end").alias("e"))
    part = lambda n, a, b, kind: F.struct(F.lit(n).alias("id"), a.alias("start"), b.alias("end"), F.lit("Part").alias("title"), F.lit(kind).alias("type"), F.lit(0.8).alias("confidence"))
    e = F.col("e")
    return ends.where("e > 60").select("key", F.explode(F.array(part(1, F.lit(0.0), e - 50, "sermon"), part(2, e - 50, e, "sermon"))).alias("s")).select("key", "s.*")


@query(f"""
    WITH {SPOKEN}, sec AS (
        SELECT key, id, CASE id WHEN 1 THEN 0::DOUBLE ELSE e - 50 END AS start, CASE id WHEN 1 THEN e - 50 ELSE e END AS "end"
        FROM (SELECT key, max("end") AS e FROM spoken GROUP BY key), (VALUES (1), (2)) v(id) WHERE e > 60
    ), p AS (
        SELECT sec.key, sec.id, sec.start, sec."end", s.start AS s, s.text,
               min(CASE WHEN regexp_matches(s.text, '(?i)(?:{O.PRELUDE_INTRO})') THEN s.start END) OVER (PARTITION BY sec.key, sec.id) AS cut
        FROM sec JOIN spoken s ON s.key = sec.key AND s."end" >= sec.start AND s.start <= sec."end"
    ), f AS (
        SELECT key, id, max(greatest(start, least("end", cut))) AS t, count(*) AS n, count(*) FILTER (WHERE s < greatest(start, least("end", cut))) AS pre,
               count(*) FILTER (WHERE s < greatest(start, least("end", cut)) AND regexp_matches(text, '(?i)(?:{O.PRELUDE_PRAYER})')) AS pr,
               count(*) FILTER (WHERE s < greatest(start, least("end", cut)) AND regexp_matches(text, '(?i)(?:{O.PRELUDE_WORSHIP})')) AS wo
        FROM p GROUP BY key, id
    ), x AS (
        SELECT sec.*, t, pr, wo, coalesce(cut_ok AND n >= 6 AND "end" - start >= 120 AND t - start >= 25 AND "end" - t >= 90 AND pre >= 2 AND pr + wo >= 1 AND (pr + wo) / pre >= 0.25, false) AS two
        FROM sec LEFT JOIN (SELECT *, t IS NOT NULL AND EXISTS (SELECT 1 FROM p WHERE p.key = f.key AND p.id = f.id AND cut IS NOT NULL) AS cut_ok FROM f) USING (key, id)
    )
    SELECT key, id, start, "end", 'Part' AS title, 'sermon' AS type, 0.8::DOUBLE AS confidence FROM x WHERE NOT two
    UNION ALL
    SELECT key, id, start, t, CASE WHEN wo > pr THEN 'Alabanza congregacional' WHEN wo > 0 THEN 'Oración y transición de adoración' ELSE 'Oración congregacional' END,
           CASE WHEN wo > pr THEN 'congregational_music' ELSE 'prayer' END, 0.72::DOUBLE FROM x WHERE two
    UNION ALL
    SELECT key, id, t, "end", 'Sermón principal', 'sermon', 0.8::DOUBLE FROM x WHERE two""")
def prelude_splits(spark: SparkSession, d: str) -> DataFrame:
    return O.split_prelude(_spans(spark, d), spoken(spark, d), ["key"])


@query(None)
def greeting_splits(spark: SparkSession, d: str) -> DataFrame:
    return O.split_at_greeting(_spans(spark, d), spoken(spark, d), ["key"])
