"""Signals around points in time, and scores built from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions.values import clamp, rounded
from weftline.operators.intervals import interval_join, overlap_length


@dataclass(frozen=True)
class SignalParams:
    """Frame before and after a point, and the shares from which a frame counts as music, speech or pause."""

    frame: float = 12.0
    music: float = 0.35
    speech: float = 0.45
    pause: float = 0.22


def first_largest(values: list[tuple[str, Column]]) -> Column:
    """The name of the largest positive value, the first one on ties; null without any."""
    out = F.lit(None).cast("string")
    for k in range(len(values) - 1, -1, -1):
        name, value = values[k]
        larger = value > 0
        for j, (_, other) in enumerate(values):
            if j != k:
                larger = larger & ((value > other) if j < k else (value >= other))
        out = F.when(larger, F.lit(name)).otherwise(out)
    return out


def audio_signal(points: DataFrame, events: DataFrame, keys: list[str], width, p: SignalParams = SignalParams()) -> DataFrame:
    """Adds to points (keys, id, t) the shares of labels before and after, and what follows from them.

    A point meets its events once, for both sides, and what it meets is added up by point: a row a point and bucket is shuffled.
    """
    t, zero = F.col("t"), F.lit(0)
    sides = {"before": (F.greatest(t - p.frame, zero), t), "after": (t, t + p.frame)}
    frames = points.select(*keys, "id", "t", sides["before"][0].alias("start"), sides["after"][1].alias("end"))
    names = {"music": ["music"], "noenergy": ["noenergy"], "male": ["male"], "female": ["female"], "speech": T.SPEECH_LABELS}
    heard = events.select(*keys, F.lower("label").alias("label"), "r_start", "r_end").where(F.col("label").isin(sorted({x for some in names.values() for x in some})))
    pairs = interval_join(frames, heard, keys, width)
    lengths = {side: overlap_length(a, b, F.col("r_start"), F.col("r_end")) for side, (a, b) in sides.items()}
    sums = [F.sum(F.when(F.col("label").isin(some) & (length > 0), length)).alias(f"_{side}_{n}") for side, length in lengths.items() for n, some in names.items()]
    out = points.join(pairs.groupBy(*keys, "id").agg(*sums), [*keys, "id"], "left").dropna(subset=keys)
    for side, (a, b) in sides.items():
        for n in names:
            value = F.coalesce(f"_{side}_{n}", zero)
            out = out.withColumn(f"{side}_{n}", value / F.greatest(F.lit(0.001), b - a) if n in ("music", "noenergy", "speech") else value)
    out = out.drop(*(f"_{side}_{n}" for side in sides for n in names))
    c = F.col
    out = out.withColumn("before_gender", first_largest([("male", c("before_male")), ("female", c("before_female"))]))
    out = out.withColumn("after_gender", first_largest([("male", c("after_male")), ("female", c("after_female"))]))
    return out.withColumns({
        "gender_change": F.coalesce(c("before_gender") != c("after_gender"), F.lit(False)),
        "music_to_speech": (c("before_music") >= p.music) & (c("after_speech") >= p.speech),
        "speech_to_music": (c("before_speech") >= p.speech) & (c("after_music") >= p.music),
        "pause_to_speech": (c("before_noenergy") >= p.pause) & (c("after_speech") >= p.speech),
        "speech_to_pause": (c("before_speech") >= p.speech) & (c("after_noenergy") >= p.pause),
    }).drop("before_male", "before_female", "after_male", "after_female")


def weighted(terms: list[tuple[float, Column]]) -> Column:
    """Sum of weights times numbers or conditions, in the order given; null conditions count as false."""
    out = F.lit(0.0)
    for weight, term in terms:
        out = out + F.lit(weight) * F.coalesce(term.cast("double"), F.lit(0.0))
    return out


# Weights of the start and end scores of a candidate, by the name of a column.
START_WEIGHTS = [
    (3.0, "speaker_change"), (1.8, "gender_supported"), (1.25, "music_to_speech"), (1.5, "pause_to_speech"), (1.6, "lyric_to_talk"),
    (1.1, "after_talk_cue"), (0.8, "title_near"), (0.55, "verse_near"), (0.45, "name_near"), (0.85, "phrase_near"), (1.2, "lyric_after"),
    (-0.6, "lyric_dominant"), (-0.45, "prayer"), (-0.4, "worship"), (-0.35, "announcement"), (1.2, "talk_cue"), (1.6, "greeting"),
    (-2.2, "prayer_dominant"), (-2.0, "worship_dominant"), (-1.4, "announcement_dominant"),
]
END_WEIGHTS = [
    (3.0, "speaker_change"), (1.8, "gender_supported"), (1.25, "speech_to_music"), (1.0, "speech_to_pause"), (1.8, "handoff_cue"),
    (1.7, "talk_to_lyric"), (0.9, "after_lyric"), (0.35, "after_name"), (0.25, "name_near"), (1.2, "before_lyric"), (-0.8, "after_talk_cue"),
    (-0.9, "closing"), (1.0, "handoff"), (-0.8, "talk_cue_strong"),
]


def candidate_score(weights: list[tuple[float, str]], t: Column, guess: Column, columns: list[str]) -> Column:
    """Weighted evidence less the distance from the guess, a point for 90 seconds. Every name needs its column."""
    absent = [n for _, n in weights if n not in columns]
    if absent:
        raise ValueError(f"no columns for {absent}")
    return weighted([(w, F.col(n)) for w, n in weights]) - F.abs(t - guess) / 90


def undragged(seed: Column, moved: Column, dominant: Column, likely: Column) -> Column:
    """A candidate that was moved back over 10 seconds into song, prayer or notices stays at its seed if the talk seems to begin there."""
    return F.when((moved < seed - 10) & dominant & likely, seed).otherwise(moved)


def with_fallback(t: Column, strong: Column, back: Column, supported: Column, drift: float) -> Column:
    """Struct (t, chosen): the best candidate if it is strong; else the fallback, if there is one, it is supported and lies within the drift."""
    near = F.coalesce(F.abs(back - t) <= drift, F.lit(False)) & supported
    chosen = F.when(strong | back.isNull(), "scored").when(near, "fallback").otherwise("fallback_rejected")
    return F.struct(F.when(~strong & near, back).otherwise(t).alias("t"), chosen.alias("chosen"))


def ending_completeness(tail: Column) -> Column:
    """How well a text ends: full stop 1, a closing word .9, a comma .45, other .65, no text .4."""
    return (
        F.when(tail == "", F.lit(0.4))
        .when(tail.rlike(r"""[.!?]["')]?\s*$"""), F.lit(1.0))
        .when(tail.rlike(T.word(r"amé?n|gracias|oramos|oremos")), F.lit(0.9))
        .when(tail.rlike(r"[,;:]\s*$"), F.lit(0.45))
        .otherwise(F.lit(0.65))
    )


def clip_score(hook: Column, impact: Column, share: Column, ending: Column) -> Column:
    return rounded(clamp(hook * 0.20 + impact * 0.30 + share * 0.15 + ending * 0.35, 0.0, 1.0), 3)


def priority(score: Column, text: Column, still: Column, start: Column, end: Column, body_start: float | None = None, body_end: float | None = None) -> Column:
    """Priority of a candidate: weighted scores and length, more inside the main part, less long before or after it."""
    length = clamp(clamp(end - start, 0.0, 45.0) / 45.0, 0.0, 1.0)
    out = 0.55 * score + 0.20 * text + 0.15 * still + 0.10 * length
    center = 0.5 * (start + end)
    if body_start is not None and body_start >= 0:
        lead = body_start - center
        inside = 0.12 + 0.08 * clamp((center - body_start) / 1800.0, 0.0, 1.0)
        out = out + F.when(center >= body_start, inside).when(lead > 120, F.lit(-0.10)).when(lead > 45, F.lit(-0.05)).otherwise(F.lit(0.0))
    if body_end is not None and body_end > 0:
        out = out + F.when(center - body_end > 300, F.lit(-0.05)).otherwise(F.lit(0.0))
    return F.round(clamp(out, 0.0, 1.0), 6)


def stillness(motion: Column) -> Column:
    return clamp(1 - motion / 0.12, 0.0, 1.0)


def segment_score(text: Column, motion: Column) -> Column:
    return 0.62 * text + 0.38 * stillness(motion)


def gates(length: Column, text: Column, still: Column, score: Column) -> tuple[Column, Column]:
    """The base gate, and the override for texts that dominate."""
    base = length.between(2.5, 220) & (text >= 0.18) & (still >= 0.28) & (score >= 0.32)
    override = (length >= 5) & (text >= 0.58) & (score >= 0.42)
    return base, override


def broken_transcript(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, n, dots, empty, tiny (shares) and broken: whether a transcript is mostly placeholders."""
    t = F.coalesce(F.col(text), F.lit(""))
    share = lambda c: F.avg(c.cast("int"))
    trimmed = F.length(F.trim(t))
    out = texts.groupBy(*keys).agg(F.count("*").alias("n"), share(t.rlike(r"^\s*\.+\s*$")).alias("dots"), share(trimmed == 0).alias("empty"), share(trimmed <= 2).alias("tiny"))
    c = F.col
    return out.withColumn("broken", (c("dots") >= 0.8) | (c("empty") >= 0.5) | ((c("tiny") >= 0.9) & (c("dots") >= 0.5)))


def with_and_without(df: DataFrame, keys: list[str], score: Column, part: Column, value: str, unique: str) -> DataFrame:
    """keys, winner, winner_without, changed: the best row by score, and by score less one part of it."""
    best = lambda s: F.max_by(value, F.struct(s, -F.col(unique)))
    out = df.groupBy(*keys).agg(best(score).alias("winner"), best(score - part).alias("winner_without"))
    return out.withColumn("changed", F.col("winner") != F.col("winner_without"))


def calibrate(kind: Column, confidence: Column, music: Column, speech: Column, pause: Column) -> Column:
    """Confidence of a section, lowered where its audio contradicts its kind."""
    c = F.when((kind == "congregational_music") & (music < 0.12) & (speech > 0.7), F.least(confidence, F.lit(0.45))).otherwise(confidence)
    c = F.when((kind == "sermon") & (music > 0.35), F.least(c, F.lit(0.55))).otherwise(c)
    c = F.when(kind.isin("welcome", "closing") & (pause > 0.65), F.least(c, F.lit(0.5))).otherwise(c)
    return rounded(clamp(c, 0.0, 1.0), 2)


def path_metrics(df: DataFrame, keys: list[str], t: str, x: str) -> DataFrame:
    """keys, steps and the root mean squares of velocity and acceleration of a path."""
    from pyspark.sql import Window as W

    order = W.partitionBy(*keys).orderBy(t)
    step = df.withColumn("_dt", F.col(t) - F.lag(t).over(order)).withColumn("_v", (F.col(x) - F.lag(x).over(order)) / F.col("_dt"))
    step = step.withColumn("_a", (F.col("_v") - F.lag("_v").over(order)) / F.col("_dt"))
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    return step.groupBy(*keys).agg(F.count("_v").alias("steps"), rms("_v").alias("rms_velocity"), rms("_a").alias("rms_acceleration"))


def lower_quantile(df: DataFrame, keys: list[str], x: str, q: float) -> DataFrame:
    """keys, quantile: the element at floor(q * (n - 1)) of the ascending values."""
    values = F.array_sort(F.collect_list(x))
    return df.groupBy(*keys).agg(values.alias("_v")).select(*keys, F.element_at("_v", (F.floor(q * (F.size("_v") - 1)) + 1).cast("int")).alias("quantile"))


def interval_metrics(spans: DataFrame, samples: DataFrame, keys: list[str], width) -> DataFrame:
    """keys, window, n, text, still, score of the samples (t, text, motion) in each span (window, start, end), borders included."""
    from weftline.operators.intervals import interval_join, touches

    points = samples.select(*keys, F.col("t").alias("r_start"), F.col("t").alias("r_end"), "text", "motion")
    found = interval_join(spans, points, keys, width, touches).groupBy(*keys, "window").agg(F.count("*").alias("n"), F.avg("text").alias("_text"), F.avg("motion").alias("_motion"))
    made = {"text": F.col("_text"), "still": stillness(F.col("_motion")), "score": segment_score(F.col("_text"), F.col("_motion"))}
    return found.select(*keys, "window", "n", *(F.round(c, 6).alias(n) for n, c in made.items()))
