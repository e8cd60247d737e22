"""Queries over timelines: the events of users, and conversations whose turns follow one another.

Times are whole microseconds for events and milliseconds for conversations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions.values import SECOND, micros
from weftline.operators import folds
from weftline.operators import intervals as I
from weftline.operators import islands as L
from weftline.operators import nearest as N
from weftline.operators import scoring as S
from weftline.operators import selection as P
from weftline.plans.registry import query, table

HOUR = 3600 * SECOND
DAY = 24 * HOUR


def events(spark: SparkSession, d: str) -> DataFrame:
    """key, id, start, end (the same), label, cents."""
    t = micros("ts").alias("start")
    cents = F.round(F.col("value") * 100).cast("long").alias("cents")
    return table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), t, F.col("event_type").alias("label"), cents).withColumn("end", F.col("start"))


def lasting(spark: SparkSession, d: str, most: int = 12 * HOUR) -> DataFrame:
    """Events that last until the user's next one, at most ``most``."""
    found = L.end_from_next(events(spark, d).drop("end"), ["key"], 5 * SECOND)
    return found.withColumn("end", F.least("end", F.col("start") + most))


def turns(spark: SparkSession, d: str) -> DataFrame:
    """key, id, start, end, speaker, text: turns one after the other, 100 ms a character with a pause of a tenth."""
    base = table(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("id"), F.col("role").alias("speaker"), T.clean(F.col("text")).alias("text"))
    base = base.withColumn("_n", F.length("text").cast("long"))
    from pyspark.sql import Window as W

    start = (F.sum("_n").over(W.partitionBy("key").orderBy("id")) - F.col("_n")) * 100
    return base.withColumn("start", start).withColumn("end", F.col("start") + F.col("_n") * 90).drop("_n")


EV = """ev AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) AS start, epoch_us(ts) AS "end", event_type AS label, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"""
TL = EV + """, tl AS (SELECT key, id, start, label, cents, least(coalesce(lead(start) OVER (PARTITION BY key ORDER BY start, id), start + 5000000), start + 43200000000) AS "end" FROM ev)"""
TURNS = r"""base AS (SELECT conv_id AS key, turn AS id, role AS speaker, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS text FROM conversations),
    turns AS (SELECT key, id, speaker, text, CAST((sum(length(text)) OVER (PARTITION BY key ORDER BY id) - length(text)) * 100 AS BIGINT) AS start,
              CAST((sum(length(text)) OVER (PARTITION BY key ORDER BY id) - length(text)) * 100 + length(text) * 90 AS BIGINT) AS "end" FROM base)"""
REACH = 'max("end") OVER (PARTITION BY {keys} ORDER BY start, "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)'


def _islands(source: str, keys: str, gap: int, aggs: str, more: str = "") -> str:
    reach = REACH.format(keys=keys)
    return f"""marked AS (SELECT *, CASE WHEN start - {reach} > {gap} OR {reach} IS NULL THEN 1 ELSE 0 END AS is_new FROM {source}),
    numbered AS (SELECT *, sum(is_new) OVER (PARTITION BY {keys} ORDER BY start, "end", id ROWS UNBOUNDED PRECEDING) AS island FROM marked)
    SELECT {aggs} FROM numbered GROUP BY {keys}, island {more}"""


@query(f"WITH {EV}, " + _islands("ev", "key", 3600_000000, 'key, min(start) AS start, max("end") AS "end", count(*) AS n'))
def sessions_gap_merge(spark: SparkSession, d: str) -> DataFrame:
    return L.merge(events(spark, d), ["key"], HOUR)


_RUNS = 'runs AS (SELECT *, sum(change) OVER (PARTITION BY key ORDER BY start, "end", id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN {label} IS NOT DISTINCT FROM lag({label}) OVER w AND lag(id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS change FROM {source} WINDOW w AS (PARTITION BY key ORDER BY start, "end", id)))'


@query(f"WITH {TL}, {_RUNS.format(label='label', source='tl')}, " + _islands("runs", "key, run, label", 0, 'key, label, min(start) AS start, max("end") AS "end", count(*) AS n'))
def label_runs_two_level(spark: SparkSession, d: str) -> DataFrame:
    return L.merge(lasting(spark, d), ["key"], 0, "label")


@query(f"""WITH {TL}, marked AS (SELECT *, CASE WHEN label = lag(label) OVER w AND abs(start - lag("end") OVER w) <= 50000 THEN 0 ELSE 1 END AS is_new
    FROM tl WINDOW w AS (PARTITION BY key ORDER BY start, "end", id)),
    numbered AS (SELECT *, sum(is_new) OVER (PARTITION BY key ORDER BY start, "end", id ROWS UNBOUNDED PRECEDING) AS run FROM marked)
    SELECT key, label, min(start) AS start, arg_max("end", (start, "end", id)) AS "end", count(*) AS n FROM numbered GROUP BY key, label, run""")
def rle_adjacent(spark: SparkSession, d: str) -> DataFrame:
    return L.run_length(lasting(spark, d), ["key"], "label", 50_000)


@query(f"""WITH {TL}, marked AS (SELECT *, CASE WHEN start - lag("end") OVER w < 1000000 THEN 0 ELSE 1 END AS is_new
    FROM (SELECT * FROM tl WHERE label = 'view') WINDOW w AS (PARTITION BY key ORDER BY start, "end", id)),
    numbered AS (SELECT *, sum(is_new) OVER (PARTITION BY key ORDER BY start, "end", id ROWS UNBOUNDED PRECEDING) AS island FROM marked)
    SELECT key, min(start) AS start, arg_max("end", (start, "end", id)) AS "end", count(*) AS n FROM numbered GROUP BY key, island""")
def caption_music_merge(spark: SparkSession, d: str) -> DataFrame:
    return L.chain_last_end(lasting(spark, d).where("label = 'view'"), ["key"], SECOND)


@query(f"""WITH {TL}, rel AS (SELECT key, id, label, start - min(start) OVER (PARTITION BY key) AS start, least("end", start + 600000000) - min(start) OVER (PARTITION BY key) AS "end" FROM tl),
    cur AS (SELECT *, greatest(coalesce(max("end") OVER (PARTITION BY key ORDER BY start, "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS c FROM rel)
    SELECT key, label, start, "end" FROM rel
    UNION ALL SELECT key, 'noenergy' AS label, c AS start, start AS "end" FROM cur WHERE start - c >= 700000
    UNION ALL SELECT key, 'noenergy' AS label, max("end") AS start, 2592000000000 AS "end" FROM rel GROUP BY key HAVING 2592000000000 - max("end") >= 700000""")
def gap_fill_silence(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    first = F.min("start").over(W.partitionBy("key"))
    rel = lasting(spark, d).withColumn("_zero", first)
    rel = rel.select("key", "id", "label", (F.col("start") - F.col("_zero")).alias("start"), (F.least("end", F.col("start") + 600 * SECOND) - F.col("_zero")).alias("end"))
    return L.fill_gaps(rel, ["key"], "label", 700_000, "noenergy", F.lit(30 * DAY))


@query(f"""WITH {EV} SELECT key, id, start, coalesce(lead(start) OVER (PARTITION BY key ORDER BY start, id), start + 5000000) AS "end" FROM ev""")
def lead_end(spark: SparkSession, d: str) -> DataFrame:
    return L.end_from_next(events(spark, d).select("key", "id", "start"), ["key"], 5 * SECOND)


STOP = r"""[.!?]["')\]]?$"""


@query(rf"""WITH {TURNS}, marked AS (SELECT *, CASE WHEN start - lag("end") OVER w > 1400 OR regexp_matches(lag(text) OVER w, '[.!?]["'')\]]?$') OR lag(id) OVER w IS NULL THEN 1 ELSE 0 END AS is_new
    FROM turns WHERE text <> '' WINDOW w AS (PARTITION BY key ORDER BY start, "end", id)),
    numbered AS (SELECT *, sum(is_new) OVER (PARTITION BY key ORDER BY start, "end", id ROWS UNBOUNDED PRECEDING) AS island FROM marked)
    SELECT key, CAST(island AS BIGINT) AS island, min(start) AS start, arg_max("end", (start, "end", id)) AS "end", string_agg(text, ' ' ORDER BY start, "end", id) AS text, count(*) AS n FROM numbered GROUP BY key, island""")
def paragraph_islands(spark: SparkSession, d: str) -> DataFrame:
    return L.paragraphs(turns(spark, d), ["key"], 1400, STOP)


@query(f"WITH {TURNS}, {_RUNS.format(label='speaker', source='turns')}, " + _islands("runs", "key, run, speaker", 1200, """key, speaker, min(start) AS start, max("end") AS "end", count(*) AS n, string_agg(text, ' ' ORDER BY start, "end", id) AS text""", 'HAVING max("end") > min(start)'))
def speaker_turns(spark: SparkSession, d: str) -> DataFrame:
    return L.split_words(turns(spark, d), ["key"], 1200, "speaker")


@query(f"WITH {EV}, " + _islands("ev", "label, key", 6 * 3600_000000, 'label, key, min(start) AS start, max("end") AS "end", count(*) AS n, avg(cents) AS avg_score, max(cents) AS peak_score', 'HAVING max("end") - min(start) >= 3600000000'))
def presence_by_region_min_duration(spark: SparkSession, d: str) -> DataFrame:
    return L.presence(events(spark, d), ["label", "key"], 6 * HOUR, HOUR, "cents")


@query(f"""WITH {EV}, marked AS (SELECT *, CASE WHEN label = lag(label) OVER w AND region = lag(region) OVER w AND start - lag("end") OVER w <= 864000000000 THEN 0 ELSE 1 END AS is_new
    FROM (SELECT *, id % 2 AS region FROM ev) WINDOW w AS (PARTITION BY key ORDER BY start, "end", id)),
    numbered AS (SELECT *, sum(is_new) OVER (PARTITION BY key ORDER BY start, "end", id ROWS UNBOUNDED PRECEDING) AS island FROM marked)
    SELECT key, label, region, min(start) AS start, max("end") AS "end", avg(cents) AS confidence, count(*) AS n FROM numbered GROUP BY key, label, region, island""")
def identity_merge_global_order(spark: SparkSession, d: str) -> DataFrame:
    return L.keyed_order_merge(events(spark, d).withColumn("region", F.col("id") % 2), ["key"], ["label", "region"], 10 * DAY, "cents")


@query(f"""WITH {EV}, marked AS (SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY key, label ORDER BY start, id) <= 86400000000 THEN 0 ELSE 1 END AS is_new FROM ev),
    numbered AS (SELECT *, sum(is_new) OVER (PARTITION BY key, label ORDER BY start, id ROWS UNBOUNDED PRECEDING) AS island FROM marked)
    SELECT key, label, min(start) AS start, max("end") AS "end", max(cents) AS confidence, count(*) AS n FROM numbered GROUP BY key, label, island""")
def repeat_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return L.repeats(events(spark, d), ["key"], "label", DAY, "cents")


@query(f"""WITH {TL}, marked AS (SELECT *, sum(CASE WHEN label = 'error' OR start - lag_end > 172800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY start, "end", id ROWS UNBOUNDED PRECEDING) AS broken
    FROM (SELECT *, lag("end") OVER (PARTITION BY key ORDER BY start, "end", id) AS lag_end FROM tl)) SELECT key, id, start, "end", label FROM marked WHERE broken = 0""")
def closing_chain(spark: SparkSession, d: str) -> DataFrame:
    rows = lasting(spark, d).withColumn("eligible", F.col("label") != "error")
    return L.chain_prefix(rows, ["key"], "eligible", 2 * DAY).select("key", "id", "start", "end", "label")


@query(f"""WITH {TURNS}, cuts AS (SELECT *, start + CAST(strpos(lower(text), ', ') AS BIGINT) * 90 AS cut, strpos(text, ', ') AS pos FROM turns),
    ok AS (SELECT *, pos > 0 AND cut - start >= 2000 AND "end" - cut >= 4000 AS inside FROM cuts)
    SELECT key, id, start, "end", 0 AS part FROM ok WHERE NOT inside
    UNION ALL SELECT key, id, start, cut AS "end", 0 AS part FROM ok WHERE inside
    UNION ALL SELECT key, id, cut AS start, "end", 1 AS part FROM ok WHERE inside""")
def split_at_cue(spark: SparkSession, d: str) -> DataFrame:
    at = F.instr("text", ", ")
    rows = turns(spark, d).withColumn("cut", F.when(at > 0, F.col("start") + at.cast("long") * 90)).select("key", "id", "start", "end", "cut")
    return L.split_at(rows, "cut", 2000, 4000)


@query(f"""WITH {EV}, kept AS (SELECT key, start, coalesce(start - lag(start) OVER (PARTITION BY key ORDER BY start) >= 10000, true) AS keep FROM (SELECT DISTINCT key, start FROM ev)),
    pairs AS (SELECT key, start, lead(start) OVER (PARTITION BY key ORDER BY start) AS "end", row_number() OVER (PARTITION BY key ORDER BY start) AS number FROM kept WHERE keep)
    SELECT key, start, "end", number FROM pairs WHERE "end" IS NOT NULL""")
def bounds_to_segments(spark: SparkSession, d: str) -> DataFrame:
    return L.pairs_of_bounds(events(spark, d), ["key"], "start", 10_000)


@query(f"""WITH {TURNS}, was AS (SELECT *, lag(speaker) OVER w AS was, lag("end") OVER w AS was_end FROM turns WINDOW w AS (PARTITION BY key ORDER BY start, "end", id))
    SELECT key, max(CASE WHEN was <> 'assistant' AND speaker = 'assistant' THEN start END) AS latest_into, min(CASE WHEN was = 'assistant' AND speaker <> 'assistant' THEN was_end END) AS earliest_out
    FROM was WHERE was IS NOT NULL GROUP BY key""")
def transition_search(spark: SparkSession, d: str) -> DataFrame:
    return L.transitions(turns(spark, d), ["key"], "speaker", "assistant")


def _windows(spark: SparkSession, d: str) -> DataFrame:
    """key, window, start, end: the days of each user from the first event to the last."""
    first = events(spark, d).groupBy("key").agg(F.min("start").alias("zero"), F.max("start").alias("last"))
    days = first.withColumn("window", F.explode(F.sequence(F.lit(0), F.expr(f"cast((last - zero) div {DAY} as int)"))))
    return days.select("key", "window", (F.col("zero") + F.col("window") * DAY).alias("start"), (F.col("zero") + (F.col("window") + 1) * DAY).alias("end"))


WINDOWS = """win AS (SELECT key, w AS "window", zero + w * 86400000000 AS start, zero + (w + 1) * 86400000000 AS "end" FROM (SELECT key, min(start) AS zero, unnest(range(0, (max(start) - min(start)) // 86400000000 + 1)) AS w FROM ev GROUP BY key))"""


@query(f"""WITH {TL}, {WINDOWS} SELECT win.key, CAST("window" AS INTEGER) AS "window", lower(label) AS label, CAST(sum(least(win."end", tl."end") - greatest(win.start, tl.start)) AS BIGINT) AS length
    FROM win JOIN tl ON win.key = tl.key AND win.start < tl."end" AND tl.start < win."end" WHERE least(win."end", tl."end") - greatest(win.start, tl.start) > 0 GROUP BY ALL""")
def window_label_seconds(spark: SparkSession, d: str) -> DataFrame:
    right = lasting(spark, d).select("key", "label", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return I.label_seconds(_windows(spark, d), right, ["key"], DAY)


@query(f"""WITH {TL}, {WINDOWS}, sums AS (SELECT win.key, "window", label, sum(least(win."end", tl."end") - greatest(win.start, tl.start)) AS len, min(tl.start) AS seen
    FROM win JOIN tl ON win.key = tl.key AND win.start < tl."end" AND tl.start < win."end" GROUP BY ALL)
    SELECT key, CAST("window" AS INTEGER) AS "window", arg_max(label, (len, -seen)) AS best FROM sums GROUP BY key, "window" """)
def anchor_argmax(spark: SparkSession, d: str) -> DataFrame:
    right = lasting(spark, d).select("key", "label", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    pairs = I.interval_join(_windows(spark, d), right, ["key"], DAY)
    length = I.overlap_length(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
    sums = pairs.groupBy("key", "window", "label").agg(F.sum(length).alias("len"), F.min("r_start").alias("seen"))
    return P.arg_max(sums, ["key", "window"], F.col("label"), [F.col("len"), -F.col("seen")])


LABELS = {"view": "music", "click": "speech", "error": "noenergy", "purchase": "male", "signup": "female"}
LABEL_SQL = "CASE label WHEN 'view' THEN 'music' WHEN 'click' THEN 'speech' WHEN 'error' THEN 'noenergy' WHEN 'purchase' THEN 'male' ELSE 'female' END"


def _part(side: str, names: str) -> str:
    low, high = ("greatest(t - 172800000000, 0)", "t") if side == "before" else ("t", "t + 172800000000")
    return f"coalesce(sum(CASE WHEN lab IN ({names}) THEN greatest(0, least(e.\"end\", {high}) - greatest(e.start, {low})) END), 0)"


_SHARES = ", ".join(f"{_part(s, n)} / 172800000000.0 AS {s}_{c}" for s in ("before", "after") for c, n in (("music", "'music'"), ("noenergy", "'noenergy'"), ("speech", "'male', 'female', 'speech'")))
_GENDERS = ", ".join(f"{_part(s, repr(g))} AS {s}_{g}" for s in ("before", "after") for g in ("male", "female"))


@query(f"""WITH {TL}, lab AS (SELECT key, id, start, "end", {LABEL_SQL} AS lab FROM tl), pts AS (SELECT key, id, start AS t FROM tl),
    sig AS (SELECT pts.key, pts.id, t, {_SHARES}, {_GENDERS} FROM pts JOIN lab e ON e.key = pts.key GROUP BY pts.key, pts.id, t),
    g AS (SELECT *, CASE WHEN before_male > 0 AND before_male >= before_female THEN 'male' WHEN before_female > 0 THEN 'female' END AS before_gender,
        CASE WHEN after_male > 0 AND after_male >= after_female THEN 'male' WHEN after_female > 0 THEN 'female' END AS after_gender FROM sig)
    SELECT key, id, t, before_music, before_noenergy, before_speech, after_music, after_noenergy, after_speech, before_gender, after_gender,
        coalesce(before_gender <> after_gender, false) AS gender_change, before_music >= 0.35 AND after_speech >= 0.45 AS music_to_speech, before_speech >= 0.45 AND after_music >= 0.35 AS speech_to_music,
        before_noenergy >= 0.22 AND after_speech >= 0.45 AS pause_to_speech, before_speech >= 0.45 AND after_noenergy >= 0.22 AS speech_to_pause FROM g""")
def before_after_signal(spark: SparkSession, d: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    rows = lasting(spark, d).select("key", "id", kind[F.col("label")].alias("label"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    points = rows.select("key", "id", F.col("r_start").alias("t"))
    return S.audio_signal(points, rows.drop("id"), ["key"], DAY, S.SignalParams(frame=2 * DAY))


@query(f"""WITH {TURNS}, top AS (SELECT key, max("end") AS last FROM turns GROUP BY key),
    bins AS (SELECT key, CAST(b AS BIGINT) AS bin, CAST(b * 30000 AS BIGINT) AS start, CAST((b + 1) * 30000 AS BIGINT) AS "end" FROM top, unnest(range(0, greatest(1, CAST(ceil(last / 30000.0) AS BIGINT)))) u(b))
    SELECT bins.key, bin, bins.start, bins."end", count(turns.id) AS n, coalesce(CAST(sum(length(text)) AS BIGINT), 0) AS chars, count(CASE WHEN speaker = 'assistant' THEN 1 END) / greatest(1, count(turns.id)) AS share
    FROM bins LEFT JOIN turns ON turns.key = bins.key AND turns."end" >= bins.start AND turns.start <= bins."end" GROUP BY bins.key, bin, bins.start, bins."end" """)
def bins_text_ratio(spark: SparkSession, d: str) -> DataFrame:
    rows = turns(spark, d)
    bins = I.bins(rows, ["key"], 30_000)
    right = rows.select("key", "speaker", "text", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    pairs = I.interval_join(bins, right, ["key"], 30_000, I.touches)
    found = pairs.groupBy("key", "bin").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("speaker") == "assistant").alias("a"))
    out = bins.join(found, ["key", "bin"], "left").fillna(0, ["n", "chars", "a"])
    return out.withColumn("share", F.col("a") / F.greatest(F.lit(1), F.col("n"))).drop("a")


@query(f"""WITH {TL}, focus AS (SELECT key, start, start + 3600000000 AS "end" FROM ev WHERE label = 'purchase') SELECT key, id, start, "end", label FROM tl
    WHERE label <> 'purchase' AND EXISTS (SELECT 1 FROM focus f WHERE f.key = tl.key AND tl.start < f."end" AND f.start < tl."end")""")
def focus_bins_semi(spark: SparkSession, d: str) -> DataFrame:
    focus = events(spark, d).where("label = 'purchase'").select("key", F.col("start").alias("r_start"), (F.col("start") + HOUR).alias("r_end"))
    rows = lasting(spark, d).where("label <> 'purchase'").select("key", "id", "start", "end", "label")
    return I.semi(rows, focus, ["key"], 6 * HOUR, "id")


SECTIONS = f"""WITH {EV}, marked AS (SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY key ORDER BY start, id) > 21600000000 OR lag(start) OVER (PARTITION BY key ORDER BY start, id) IS NULL THEN 1 ELSE 0 END AS is_new FROM ev),
    isl AS (SELECT key, sum(is_new) OVER (PARTITION BY key ORDER BY start, id ROWS UNBOUNDED PRECEDING) AS island, start, "end" FROM marked),
    sec AS (SELECT key, CAST(island - 1 AS INTEGER) AS "index", min(start) AS start, max("end") AS "end" FROM isl GROUP BY key, island),
    numb AS (SELECT *, "index" = max("index") OVER (PARTITION BY key) AS is_last FROM sec)"""


@query(SECTIONS + """, cand AS (SELECT e.key, e.id, e.start AS t, n."index", CASE WHEN e.start >= n.start AND (CASE WHEN n.is_last THEN e.start <= n."end" ELSE e.start < n."end" END) THEN 0 ELSE 1 END AS o,
        least(abs(e.start - n.start), abs(e.start - n."end")) AS dist FROM ev e JOIN numb n USING (key))
    SELECT key, id, t, arg_min("index", (o, CASE WHEN o = 0 THEN 0 ELSE dist END, "index")) AS "index" FROM cand GROUP BY key, id, t""")
def point_in_interval_nearest(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    merged = L.merge(events(spark, d), ["key"], 6 * HOUR)
    sections = merged.withColumn("index", F.row_number().over(W.partitionBy("key").orderBy("start")) - 1)
    points = events(spark, d).select("key", "id", F.col("start").alias("t"))
    return I.locate(points, sections, ["key"])


@query(f"""WITH {EV}, p AS (SELECT key, start FROM ev WHERE label = 'purchase') SELECT ev.key, ev.id, ev.start, max(CASE WHEN p.start <= ev.start + 1000 THEN p.start END) AS prev_start, min(CASE WHEN p.start >= ev.start - 1000 THEN p.start END) AS next_start
    FROM ev LEFT JOIN p ON p.key = ev.key WHERE ev.label = 'error' GROUP BY ev.key, ev.id, ev.start""")
def asof_prev_next(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    left = rows.where("label = 'error'").select("key", "id", "start")
    right = rows.where("label = 'purchase'").select("key", "start")
    back = N.as_of(left, right, ["key"], "start", "start", ["start"], tolerance=1000, prefix="prev_")
    return N.as_of(back, right, ["key"], "start", "start", ["start"], forward=True, tolerance=1000, prefix="next_")


@query(f"""WITH {EV}, s AS (SELECT key, start, start + 60000000 AS "end" FROM ev WHERE label <> 'view'), v AS (SELECT key, id, start, start + 30000000 AS "end" FROM ev WHERE label = 'view'),
    n AS (SELECT v.key, v.id, v.start, v."end", max(CASE WHEN s."end" <= v.start THEN s."end" END) AS prev_end, min(CASE WHEN s.start >= v."end" THEN s.start END) AS next_start FROM v LEFT JOIN s ON s.key = v.key GROUP BY ALL)
    SELECT key, id, start, "end", prev_end, next_start, greatest(0, start - least(600000000, greatest(0, start - coalesce(prev_end, 0)))) AS clip_start,
        "end" + least(600000000, CASE WHEN next_start IS NULL THEN 600000000 ELSE greatest(0, next_start - "end") END) AS clip_end FROM n""")
def pad_to_neighbours(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    speech = rows.where("label <> 'view'").select("key", "start", (F.col("start") + 60 * SECOND).alias("end"))
    clips = rows.where("label = 'view'").select("key", "id", "start", (F.col("start") + 30 * SECOND).alias("end"))
    return N.pad_to_neighbours(clips, speech, ["key"], 600 * SECOND)


@query(f"""WITH {EV}, p AS (SELECT key, start FROM ev WHERE label = 'signup') SELECT c.key, c.id, c.start AS t, arg_min(p.start, (abs(c.start - p.start), p.start)) AS snapped FROM ev c LEFT JOIN p ON p.key = c.key WHERE c.label = 'click' GROUP BY ALL""")
def snap_nearest(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    left = rows.where("label = 'click'").select("key", "id", F.col("start").alias("t"))
    return N.nearest(left, rows.where("label = 'signup'").select("key", F.col("start").alias("r")), ["key"], "t", "r", "snapped")


@query(f"""WITH {EV} SELECT key, id, start AS t, EXISTS (SELECT 1 FROM ev c WHERE c.key = e.key AND c.label = 'error' AND abs(c.start - e.start) <= 7200000000) AS near FROM ev e WHERE label = 'click'""")
def near_cut_exists(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    left = rows.where("label = 'click'").select("key", "id", F.col("start").alias("t"))
    return N.near_any(left, rows.where("label = 'error'").select("key", F.col("start").alias("cut")), ["key"], "t", "cut", 2 * HOUR)


@query(f"""WITH {EV}, mixed AS (SELECT key, id, start, label FROM ev) SELECT m.key, m.id, m.start, EXISTS (SELECT 1 FROM tl t WHERE t.key = m.key AND t.label <> m.label AND least(t."end", m.start + 3600000000) - greatest(t.start, m.start - 3600000000) >= 350000) AS other FROM mixed m""".replace(f"WITH {EV}", f"WITH {TL}"))
def other_speaker_around(spark: SparkSession, d: str) -> DataFrame:
    rows = lasting(spark, d)
    asked = rows.select("key", "id", F.col("start").alias("at"), F.col("label").alias("own"), (F.col("start") - HOUR).alias("start"), (F.col("start") + HOUR).alias("end"))
    right = rows.select("key", "label", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    pairs = I.interval_join(asked, right, ["key"], 6 * HOUR).where("label <> own")
    hit = I.overlap_length(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")) >= 350_000
    ids = pairs.where(hit).select("key", "id").distinct().withColumn("other", F.lit(True))
    return asked.select("key", "id", F.col("at").alias("start")).join(ids, ["key", "id"], "left").fillna(False, ["other"])


@query(f"""WITH {TL}, b AS (SELECT key, id, start, start + 600000000 AS "end" FROM ev WHERE label = 'purchase') SELECT b.key, b.id, string_agg(t.label, ' ' ORDER BY t.start, t.id) AS labels, count(*) AS n FROM b JOIN tl t ON t.key = b.key AND least(t."end", b."end") - greatest(t.start, b.start) > 200000 GROUP BY b.key, b.id""")
def overlap_text_gather(spark: SparkSession, d: str) -> DataFrame:
    rows = lasting(spark, d)
    left = events(spark, d).where("label = 'purchase'").select("key", "id", "start", (F.col("start") + 600 * SECOND).alias("end"))
    right = rows.select("key", F.col("id").alias("rid"), "label", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    pairs = I.interval_join(left, right, ["key"], 6 * HOUR).where(I.overlap_length(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")) > 200_000)
    packed = F.array_sort(F.collect_list(F.struct("r_start", "rid", "label")))
    return pairs.groupBy("key", "id").agg(F.array_join(F.transform(packed, lambda x: x["label"]), " ").alias("labels"), F.count("*").alias("n"))


@query(f"""WITH {EV}, grid AS (SELECT key, unnest(range(min(start) // 1000000, max(start) // 1000000 + 1, 43200)) AS g FROM ev GROUP BY key),
    pts AS (SELECT key, start // 1000000 AS p, max(cents) AS v FROM ev GROUP BY ALL),
    lo AS (SELECT g.key, g.g, max(p) AS lp FROM grid g JOIN pts ON pts.key = g.key AND p <= g.g GROUP BY ALL), hi AS (SELECT g.key, g.g, min(p) AS hp FROM grid g JOIN pts ON pts.key = g.key AND p >= g.g GROUP BY ALL)
    SELECT lo.key, lo.g AS t, CASE WHEN hp = lp THEN a.v ELSE a.v + (b.v - a.v) * ((lo.g - lp) / (hp - lp)) END AS value FROM lo JOIN hi ON lo.key = hi.key AND lo.g = hi.g JOIN pts a ON a.key = lo.key AND a.p = lp JOIN pts b ON b.key = lo.key AND b.p = hp""")
def resample_linear(spark: SparkSession, d: str) -> DataFrame:
    points = events(spark, d).groupBy("key", F.expr("start div 1000000").alias("t")).agg(F.max("cents").alias("value"))
    return N.resample(points, ["key"], "t", "value", 43_200)


@query(f"""WITH RECURSIVE {EV}, cuts AS (SELECT DISTINCT key, start FROM ev WHERE label = 'click'), kept AS (SELECT key, min(start) AS t FROM cuts GROUP BY key
    UNION ALL SELECT k.key, (SELECT min(c.start) FROM cuts c WHERE c.key = k.key AND c.start >= k.t + 86400000000) AS t FROM kept k WHERE k.t IS NOT NULL)
    SELECT key, t FROM kept WHERE t IS NOT NULL""")
def greedy_min_spacing(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).where("label = 'click'").select("key", "start").distinct()
    return folds.spaced(rows, ["key"], "start", DAY).select("key", F.col("start").alias("t"))


@query(f"""WITH RECURSIVE {TL}, r AS (SELECT key, start, "end", row_number() OVER (PARTITION BY key ORDER BY start, "end", id) AS n FROM tl),
    kept AS (SELECT key, n, start, "end" FROM r WHERE n = 1 UNION ALL SELECT x.key, x.n, x.start, x."end" FROM kept k JOIN r x ON x.key = k.key AND x.n = (SELECT min(y.n) FROM r y WHERE y.key = k.key AND y.n > k.n AND y.start >= k."end" + 2000000))
    SELECT key, start, "end" FROM kept""")
def greedy_nonoverlap(spark: SparkSession, d: str) -> DataFrame:
    return folds.disjoint(lasting(spark, d), ["key"], 2 * SECOND, "id")


@query(f"""WITH {EV}, c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start, id) - 1 AS nth, count(*) OVER (PARTITION BY key) AS n FROM ev)
    SELECT key, id, start FROM c WHERE nth % greatest(1, n // 10) = 0 AND nth // greatest(1, n // 10) < 10""")
def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    return P.systematic(events(spark, d), ["key"], ["start", "id"], 10).select("key", "id", "start")


@query(f"""WITH {EV}, c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start, id) - 1 AS nth, count(*) OVER (PARTITION BY key) AS n FROM ev) SELECT key, id, start FROM c WHERE nth % 8 = 0 OR nth = n - 1""")
def stride_keep_last(spark: SparkSession, d: str) -> DataFrame:
    return P.every_nth(events(spark, d), ["key"], ["start", "id"], 8).select("key", "id", "start")


@query(rf"""WITH {TURNS}, u AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY key ORDER BY start, id ROWS UNBOUNDED PRECEDING) AS used FROM turns) SELECT key, id, text, CAST(used AS BIGINT) AS used FROM u WHERE used <= 900""")
def char_budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    return P.prefix_by_size(turns(spark, d), ["key"], ["start", "id"], F.length("text") + 1, 900).select("key", "id", "text", "used")


@query(f"""WITH {EV}, s AS (SELECT key, start, cents, (start - lag(start) OVER w) / 1000000.0 AS dt, cents - lag(cents) OVER w AS dx FROM (SELECT key, start, max(cents) AS cents FROM ev GROUP BY ALL) WINDOW w AS (PARTITION BY key ORDER BY start)),
    v AS (SELECT *, dx / dt AS v FROM s), a AS (SELECT *, (v - lag(v) OVER (PARTITION BY key ORDER BY start)) / dt AS a FROM v)
    SELECT key, count(v) AS steps, round(sqrt(avg(v * v)), 6) AS rms_velocity, round(sqrt(avg(a * a)), 6) AS rms_acceleration FROM a GROUP BY key""")
def path_rms(spark: SparkSession, d: str) -> DataFrame:
    points = events(spark, d).groupBy("key", (F.col("start") / 1_000_000.0).alias("t"), F.col("start")).agg(F.max("cents").alias("x"))
    exact = points.withColumn("t", F.col("start"))
    found = S.path_metrics(exact.select("key", "t", "x"), ["key"], "t", "x")
    return found.select("key", "steps", F.round(F.col("rms_velocity") * 1e6, 6).alias("rms_velocity"), F.round(F.col("rms_acceleration") * 1e12, 6).alias("rms_acceleration"))


@query(f"""WITH {EV}, o AS (SELECT key, list(cents ORDER BY cents) AS v FROM ev GROUP BY key) SELECT key, v[CAST(floor(0.9 * (len(v) - 1)) AS INTEGER) + 1] AS quantile FROM o""")
def lower_quantile(spark: SparkSession, d: str) -> DataFrame:
    return S.lower_quantile(events(spark, d), ["key"], "cents", 0.9)


@query(f"""WITH {EV}, r AS (SELECT key, id, start, count(*) OVER w AS n, count(CASE WHEN label <> 'error' THEN 1 END) OVER w AS good, bool_or(label = 'purchase') OVER w AS kick FROM ev WINDOW w AS (PARTITION BY key ORDER BY start RANGE BETWEEN CURRENT ROW AND 160000000000 FOLLOWING))
    SELECT key, min(start) AS start FROM r WHERE kick AND good >= 4 GROUP BY key""")
def forward_frame_first_hit(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("key").orderBy("start").rangeBetween(0, 160_000 * SECOND)
    rows = events(spark, d).withColumn("good", F.count_if(F.col("label") != "error").over(w)).withColumn("kick", F.max((F.col("label") == "purchase").cast("int")).over(w))
    return rows.where("kick = 1 and good >= 4").groupBy("key").agg(F.min("start").alias("start"))


@query(f"""WITH {EV} SELECT key, label, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, grouping(key, label) AS level FROM ev GROUP BY ROLLUP (key, label)""")
def rollup_telemetry(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).rollup("key", "label").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"), F.grouping_id().alias("level"))
