"""Bounds of a talk from end to end: small recordings whose right bounds are known, and scores added up again by hand."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import bounds as B
from weftline.operators.scoring import END_WEIGHTS, START_WEIGHTS, audio_signal

SEGMENT = "key int, id long, start double, end double, text string"
TURN = "key int, id long, start double, end double, speaker string"
SHOWN = "key int, type string, text string, r_start double, r_end double"
SOUND = "key int, label string, r_start double, r_end double"
ASKED = "key int, guess_start double, guess_end double, start_speaker string, end_speaker string"


def recording(key, talk, end, speaker="A"):
    """Song until a pause before the talk of a speaker, then another one who hands over to song."""
    said = [(0.0, talk - 30, "B", "vamos a cantar un himno de alabanza"), (talk, talk + 20, speaker, "Feliz sábado, abran sus biblias, el mensaje de hoy es la gracia"), (talk + 20.5, talk + 60, speaker, "vamos a estudiar la palabra de dios")]
    t = talk + 60.5
    while t + 40 < end:
        said.append((t, t + 39.5, speaker, "y entonces dijo el hijo a su padre"))
        t += 40
    said += [(t, end, speaker, "oremos, amén."), (end + 1, end + 30, "B", "les queremos agradecer, gracias pastor, vamos a cantar"), (end + 31, end + 300, "B", "himno")]
    segments = [(key, i, a, b, text) for i, (a, b, _, text) in enumerate(said)]
    turns = [(key, i, a, b, who) for i, (a, b, who, _) in enumerate(said)]
    sounds = [(key, "music", 0.0, talk - 15), (key, "noenergy", talk - 15, talk), (key, "male", talk, end), (key, "music", end + 1, end + 300)]
    slides = [(key, "song_lyric", "Cantad", 0.0, talk - 10), (key, "sermon_title", "Tema: la gracia", talk + 2, talk + 12), (key, "song_lyric", "Santo", end + 2, end + 100)]
    return segments, turns, sounds, slides


@pytest.fixture(scope="module")
def parts(spark):
    made = [recording(1, 300.0, 1500.0), recording(2, 700.0, 2000.0)]
    rows = [sum(x, []) for x in zip(*made)]
    return [spark.createDataFrame(r, s) for r, s in zip(rows, (SEGMENT, TURN, SOUND, SHOWN))]


def test_bounds_are_found_from_wrong_guesses(spark, parts):
    segments, turns, sounds, slides = parts
    asked = spark.createDataFrame([(1, 380.0, 1450.0, "A", "A"), (2, 640.0, 2050.0, "A", "A"), (9, 10.0, 50.0, "A", "A")], ASKED)
    got = {r.key: r for r in B.talk_bounds(segments, sounds, slides, turns, asked, ["key"]).collect()}
    nothing = got.pop(9)  # a key without segments, turns, sounds and slides keeps its guess
    assert (nothing.start, nothing.end, nothing.clip_start, nothing.clip_end, nothing.start_chosen) == (10.0, 50.0, 0.0, 60.0, "scored")
    assert {k: (r.start, r.end) for k, r in got.items()} == {1: (300.0, 1500.0), 2: (700.0, 2000.0)}
    assert all(r.start_chosen == r.end_chosen == "scored" for r in got.values())
    assert {k: (r.clip_start, r.clip_end) for k, r in got.items()} == {1: (290.0, 1501.0), 2: (690.0, 2001.0)}


@pytest.mark.parametrize("at_start, weights", [(True, START_WEIGHTS), (False, END_WEIGHTS)])
def test_scores_are_the_sum_of_the_evidence(spark, parts, at_start, weights):
    segments, turns, sounds, slides = parts
    asked = spark.createDataFrame([(1, 380.0, 1450.0, "A", "A"), (2, 900.0, 1400.0, "A", "A")], ASKED)
    scored = B.settled(B.candidates(segments, sounds, slides, turns, asked, ["key"], at_start))
    rows = [r.asDict() for r in scored.collect()]
    assert len(rows) > 3
    for r in rows:
        assert abs(r["score"] - (sum(w * float(r[n]) for w, n in weights) - abs(r["t"] - r["guess"]) / 90)) < 1e-5
    best = {r.key: r for r in B.choose(scored, segments, turns, ["key"], at_start).collect()}
    for key in (1, 2):
        want = max((r for r in rows if r["key"] == key), key=lambda r: (r["score"], -r["id"]))
        assert (best[key].seed, best[key].score) == (want["seed"], want["score"])


def weak(t=100.0):
    return (1, 1, t, t, "A", False, 1.0)


@pytest.mark.parametrize("text, drift, wanted", [("feliz sábado, el mensaje de hoy, abran sus biblias", 360.0, (300.0, "fallback")), ("nada", 360.0, (290.0, "fallback_rejected")), ("feliz sábado, el mensaje de hoy, abran sus biblias", 5.0, (290.0, "fallback_rejected"))])
def test_weak_starts_fall_back_where_speech_supports_it(spark, text, drift, wanted):
    segments = spark.createDataFrame([(1, 0, 0.0, 250.0, "hola"), (1, 1, 300.0, 340.0, text)], SEGMENT)
    turns = spark.createDataFrame([(1, 0, 0.0, 250.0, "B"), (1, 1, 300.0, 400.0, "A")], TURN)
    scored = spark.createDataFrame([weak(290.0)], "key int, id long, seed double, t double, speaker string, strong boolean, score double")
    (row,) = B.choose(scored, segments, turns, ["key"], True, B.BoundsParams(start_drift=drift)).collect()
    assert (row.t, row.chosen) == wanted


def test_no_change_of_speakers_leaves_the_best(spark):
    segments = spark.createDataFrame([(1, 0, 0.0, 250.0, "hola")], SEGMENT)
    turns = spark.createDataFrame([(1, 0, 0.0, 250.0, "A")], TURN)
    scored = spark.createDataFrame([weak()], "key int, id long, seed double, t double, speaker string, strong boolean, score double")
    for at_start in (True, False):
        (row,) = B.choose(scored, segments, turns, ["key"], at_start).collect()
        assert (row.t, row.chosen) == (100.0, "scored")


def test_audio_signal_adds_up_once(spark):
    """One aggregate by point, both sides and all labels together; a point without sounds has shares of 0."""
    points = spark.createDataFrame([(1, 1, 20.0), (1, 2, 500.0), (2, 3, 5.0)], "key int, id int, t double")
    sounds = spark.createDataFrame([(1, "Music", 8.0, 20.0), (1, "male", 20.0, 26.0), (1, "male", 18.0, 19.0)], "key int, label string, r_start double, r_end double")
    made = audio_signal(points, sounds, ["key"], 60.0)
    assert made._jdf.queryExecution().analyzed().toString().count("Aggregate [") == 1
    got = {r.id: r for r in made.collect()}
    assert (got[1].before_music, got[1].after_speech, got[1].before_gender, got[1].music_to_speech) == (1.0, 0.5, "male", True)
    assert all((got[k].before_music, got[k].after_speech, got[k].before_gender) == (0.0, 0.0, None) for k in (2, 3))
