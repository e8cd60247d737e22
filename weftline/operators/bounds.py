"""From a guess to the bounds of a talk: candidates, evidence around each, scores, choice, fallback, padding.

Every key (recording) goes through joins on its keys alone: walks along turns, frames of text, sound and slides, and as-of joins. What
several steps share is written to the shared folder once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import sections as O
from weftline.operators.nearest import as_of
from weftline.operators.scoring import END_WEIGHTS, START_WEIGHTS, audio_signal, candidate_score, undragged


@dataclass(frozen=True)
class BoundsParams:
    """confirm: seconds to a neighbour of another speaker that confirm a change. slides: seconds of slides before and after. start_drift,
    end_drift: how far a fallback may lie from the best candidate. pad: most seconds added in front and behind. width: buckets of interval joins."""

    confirm: float = 30.0
    slides: float = 18.0
    start_drift: float = 360.0
    end_drift: float = 420.0
    pad: float = 10.0
    width: float = 60.0


def settled(df: DataFrame) -> DataFrame:
    """df, written to the folder of ``spark.checkpoint.dir`` (in tests without one, to a folder of the warehouse)."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        conf = df.sparkSession.conf
        context.setCheckpointDir(conf.get("spark.checkpoint.dir", None) or f"{conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return df.checkpoint()


def seeds(segments: DataFrame, asked: DataFrame, keys: list[str], at_start: bool) -> DataFrame:
    """keys, id, seed, guess, speaker: the guess and the candidates by cues, numbered with the guess first."""
    guess, speaker = ("guess_start", "start_speaker") if at_start else ("guess_end", "end_speaker")
    own = asked.select(*keys, F.col(guess).alias("guess"), F.col(speaker).alias("speaker"))
    found = O.cue_candidates(segments, asked.select(*keys, "guess_start", "guess_end"), keys, at_start).select(*keys, F.col("t").alias("seed"))
    rows = own.withColumn("seed", F.col("guess")).unionByName(found.join(own, keys).where("seed <> guess").distinct())
    order = W.partitionBy(*keys).orderBy(F.when(F.col("seed") == F.col("guess"), 0).otherwise(1), "seed")
    return rows.withColumn("id", F.row_number().over(order).cast("long"))


def speaker_change(points: DataFrame, turns: DataFrame, keys: list[str], at_start: bool, gap: float) -> DataFrame:
    """points (keys, id, t, speaker) with speaker_change: whether the turn before (the one after) is another speaker's and near."""
    side = "end" if at_start else "start"
    near = turns.select(*keys, F.col(side).alias("turn"), F.col("speaker").alias("who"), F.col("id").alias("nth"))
    found = as_of(points, near, keys, "t", "turn", ["turn", "who"], forward=not at_start, tolerance=0.001, prefix="_", unique="nth")
    away = F.col("t") - F.col("_turn") if at_start else F.col("_turn") - F.col("t")
    return found.withColumn("speaker_change", F.coalesce((F.col("_who") != F.col("speaker")) & (away <= gap), F.lit(False))).drop("_turn", "_who")


def evidence(points: DataFrame, segments: DataFrame, sounds: DataFrame, slides: DataFrame, turns: DataFrame, keys: list[str], at_start: bool, p: BoundsParams) -> DataFrame:
    """points (keys, id, t, speaker, and cue scores of ``text_signal``) with a column for each weight of the score."""
    c = F.col
    one = [*keys, "id"]
    at = points.select(*one, "t")
    heard = audio_signal(at, sounds, keys, p.width).select(*one, "gender_change", "music_to_speech", "speech_to_music", "pause_to_speech", "speech_to_pause")
    shown = O.type_signal(at, slides, keys, p.slides, p.width).drop("t", "cue_near")
    titles, verses = (O.type_signal(at, slides.where(F.lower("type") == kind), keys, p.slides, p.width).select(*one, c("cue_near").alias(name)) for kind, name in (("sermon_title", "title_near"), ("bible_verse", "verse_near")))
    rows = speaker_change(points, turns, keys, at_start, p.confirm)
    for more in (heard, shown, titles, verses):
        rows = rows.join(more, one)
    if at_start:
        context = c("sermon_likely") | c("greeting") | c("music_to_speech") | c("pause_to_speech") | c("lyric_to_sermon")
        return rows.withColumns({
            "gender_supported": c("gender_change") & (c("music_to_speech") | c("pause_to_speech")), "lyric_to_talk": c("lyric_to_sermon"), "after_talk_cue": c("after_cue") >= 0.1,
            "lyric_after": ~c("lyric_to_sermon") & (c("after_lyric") >= 0.18), "lyric_dominant": ~c("lyric_to_sermon") & c("lyric_dominant"),
            "talk_cue": c("sermon"), "name_near": c("name_near") & context, "phrase_near": c("phrase_near") & context, "phrase_seen": c("phrase_near"),
        })
    near = O.gathered(at.select(*keys, c("id").alias("pid"), F.greatest(F.lit(0.0), c("t") - 110).alias("start"), (c("t") + 110).alias("end")), segments, keys, ["pid"], p.width)
    rows = rows.join(near.select(*keys, c("pid").alias("id"), O.says(c("text"), O.HANDOFF_NEAR).alias("_handoff")), one, "left")
    return rows.withColumns({
        "gender_supported": c("gender_change") & (c("speech_to_music") | c("speech_to_pause")), "handoff_cue": F.coalesce("_handoff", F.lit(False)), "talk_to_lyric": c("sermon_to_lyric"),
        "after_lyric": c("after_lyric") >= 0.16, "after_name": c("after_name") >= 0.08, "before_lyric": c("before_lyric") >= 0.2, "after_talk_cue": c("after_cue") >= 0.16,
        "talk_cue_strong": c("sermon") >= 1.6,
    }).drop("_handoff")


def _dominant() -> Column:
    return F.col("prayer_dominant") | F.col("worship_dominant") | F.col("announcement_dominant")


def candidates(segments: DataFrame, sounds: DataFrame, slides: DataFrame, turns: DataFrame, asked: DataFrame, keys: list[str], at_start: bool, p: BoundsParams = BoundsParams()) -> DataFrame:
    """keys, id, seed, guess, speaker, t, the evidence, strong and score of each candidate: its place after the walk along the speaker's turns.

    A start that was walked back into song, prayer or notices although the talk seems to begin at its seed stays there.
    """
    rows = settled(seeds(segments, asked, keys, at_start))
    own = rows.select(*keys, "speaker", F.col("seed").alias("guess")).distinct()
    walked = O.chain_starts(turns, own, keys) if at_start else O.chain_ends(turns, own, keys)
    moved = settled(rows.join(walked.select(*keys, "speaker", F.col("guess").alias("seed"), F.col("start" if at_start else "end").alias("moved")), [*keys, "speaker", "seed"]))
    places = moved.select(*keys, (2 * F.col("id")).alias("id"), F.col("moved").alias("t"))
    if at_start:
        places = places.unionByName(moved.select(*keys, (2 * F.col("id") + 1).alias("id"), F.col("seed").alias("t")))
    said = settled(O.text_signal(places, segments, keys, at_start, p.width))
    at_moved = said.where("id % 2 = 0").withColumn("id", F.expr("id div 2"))
    if at_start:
        at_seed = said.where("id % 2 = 1").withColumn("id", F.expr("id div 2"))
        likely = at_seed.select(*keys, "id", (F.col("sermon_likely") | F.col("greeting") | (F.col("sermon") >= 1.6)).alias("_likely"))
        judged = moved.join(at_moved.select(*keys, "id", _dominant().alias("_dominant")), [*keys, "id"]).join(likely, [*keys, "id"])
        chosen = judged.withColumn("t", undragged(F.col("seed"), F.col("moved"), F.col("_dominant"), F.col("_likely")))
        signals = at_seed.withColumn("_at", F.lit("seed")).unionByName(at_moved.withColumn("_at", F.lit("moved"))).drop("t")
        side = F.when((F.col("t") == F.col("seed")) & (F.col("moved") != F.col("seed")), "seed").otherwise("moved")
        points = chosen.withColumn("_at", side).drop("_dominant", "_likely", "moved")
        points = points.join(signals, [*keys, "id", "_at"]).drop("_at")
    else:
        points = moved.withColumn("t", F.col("moved")).drop("moved").join(at_moved.drop("t"), [*keys, "id"])
    points = settled(points)
    full = evidence(points, segments, sounds, slides, turns, keys, at_start, p)
    c = F.col
    if at_start:
        strong = c("speaker_change") | c("music_to_speech") | c("pause_to_speech") | c("sermon_likely") | (c("phrase_seen") & c("greeting"))
        weights = START_WEIGHTS
    else:
        strong = c("speaker_change") | c("speech_to_music") | c("speech_to_pause") | c("closing_likely") | c("handoff_likely")
        weights = END_WEIGHTS
    return full.withColumn("strong", strong).withColumn("score", F.round(candidate_score(weights, c("t"), c("guess"), full.columns), 6))


def choose(scored: DataFrame, segments: DataFrame, turns: DataFrame, keys: list[str], at_start: bool, p: BoundsParams = BoundsParams()) -> DataFrame:
    """keys, seed, score, speaker, t, chosen: the best candidate (of equal ones the first), or, if its evidence is weak, the change of speakers nearest to it
    if the speech there supports it. chosen: scored, fallback or fallback_rejected."""
    best = scored.groupBy(*keys).agg(F.max_by(F.struct("id", "seed", "t", "speaker", "strong", "score"), F.struct("score", -F.col("id"))).alias("_b")).select(*keys, "_b.*")
    order = W.partitionBy(*keys).orderBy("start", "id")
    rows = turns.withColumn("_was", F.lag("speaker").over(order)).withColumn("_was_end", F.lag("end").over(order)).where("_was <> speaker")
    changes = rows.select(*keys, "speaker", F.col("start").alias("change")) if at_start else rows.select(*keys, F.col("_was").alias("speaker"), F.col("_was_end").alias("change"))
    found = settled(as_of(best, changes, [*keys, "speaker"], "t", "change", ["change"], forward=not at_start, tolerance=15.0, prefix="_"))
    weak = found.where("not strong and _change is not null")
    said = O.text_signal(weak.select(*keys, "id", F.col("_change").alias("t")), segments, keys, at_start, p.width)
    supported = (F.col("sermon_likely") | F.col("greeting")) & ~_dominant() if at_start else F.col("closing_likely") | F.col("handoff_likely")
    asked = weak.select(*keys, "speaker", F.col("_change").alias("guess"))
    walked = (O.chain_starts if at_start else O.chain_ends)(turns, asked, keys).select(*keys, F.col("start" if at_start else "end").alias("_walked"))
    more = said.select(*keys, supported.alias("_supported")).join(walked, keys)
    near = F.coalesce(F.abs(F.col("_change") - F.col("t")) <= (p.start_drift if at_start else p.end_drift), F.lit(False)) & F.coalesce("_supported", F.lit(False))
    chosen = F.when(F.col("strong") | F.col("_change").isNull(), "scored").when(near, "fallback").otherwise("fallback_rejected")
    out = found.join(more, keys, "left").withColumn("chosen", chosen)
    return out.select(*keys, "seed", "score", "speaker", F.when(F.col("chosen") == "fallback", F.col("_walked")).otherwise(F.col("t")).alias("t"), "chosen")


def padded(bounds: DataFrame, segments: DataFrame, turns: DataFrame, keys: list[str], most: float = 10.0) -> DataFrame:
    """bounds (keys, start, end, start_speaker, end_speaker) with clip_start and clip_end: up to ``most`` more on each side, not into speech nor into another
    speaker's turn."""
    speech = segments.where(~T.non_speech(F.col("text"))).select(*keys, "start", "end")
    turns = turns.select(*keys, "speaker", "start", "end")
    before = turns.join(bounds.select(*keys, "start_speaker"), keys).where("speaker <> start_speaker").select(*keys, "start", "end")
    after = turns.join(bounds.select(*keys, "end_speaker"), keys).where("speaker <> end_speaker").select(*keys, "start", "end")
    ends = speech.unionByName(before).select(*keys, F.col("end").alias("prev"))
    starts = speech.unionByName(after).select(*keys, F.col("start").alias("next"))
    rows = as_of(bounds, ends, keys, "start", "prev", ["prev"], prefix="_")
    rows = as_of(rows, starts, keys, "end", "next", ["next"], forward=True, prefix="_")
    room = F.greatest(F.lit(0.0), F.col("start") - F.coalesce("_prev", F.lit(0.0)))
    low = F.greatest(F.lit(0.0), F.col("start") - F.least(F.lit(most), room))
    high = F.col("end") + F.when(F.col("_next").isNull(), F.lit(most)).otherwise(F.least(F.lit(most), F.greatest(F.lit(0.0), F.col("_next") - F.col("end"))))
    return rows.withColumn("clip_start", low).withColumn("clip_end", high).drop("_prev", "_next")


def talk_bounds(segments: DataFrame, sounds: DataFrame, slides: DataFrame, turns: DataFrame, asked: DataFrame, keys: list[str], p: BoundsParams = BoundsParams()) -> DataFrame:
    """keys, start, start_chosen, end, end_chosen, clip_start, clip_end for each row of asked (keys, guess_start, guess_end, start_speaker, end_speaker).

    segments: keys, id, start, end, text. turns: keys, id, start, end, speaker. sounds: keys, label, r_start, r_end. slides: keys, type, text, r_start,
    r_end. Times are seconds. Keys without segments, turns, sounds or slides keep what the rest says; without any of them the guess stays.
    """
    sides = []
    for at_start, name in ((True, "start"), (False, "end")):
        scored = settled(candidates(segments, sounds, slides, turns, asked, keys, at_start, p))
        chosen = choose(scored, segments, turns, keys, at_start, p)
        sides.append(settled(chosen.select(*keys, F.col("t").alias(name), F.col("chosen").alias(f"{name}_chosen"), F.col("speaker").alias(f"{name}_speaker"))))
    both = sides[0].join(sides[1], keys)
    return padded(both, segments, turns, keys, p.pad).select(*keys, "start", "start_chosen", "end", "end_chosen", "clip_start", "clip_end")
