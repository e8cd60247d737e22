"""Hand-made cases: borders of gaps, ties, empty and odd texts."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import values as V
from weftline.operators import entity as E
from weftline.operators import folds
from weftline.operators import intervals as I
from weftline.operators import islands as L
from weftline.operators import nearest as N
from weftline.operators import scoring as S
from weftline.operators import selection as P
from weftline.sources import readers, writers


def tuples(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def one(spark, column, **values):
    kinds = {str: "string", float: "double", int: "int", bool: "boolean"}
    schema = ", ".join(f"{k} {kinds[type(v)] if v is not None else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


LABELLED = "key int, id int, label string, start double, end double"


def test_gap_at_the_border_still_joins(spark):
    df = spark.createDataFrame([(1, 1, "a", 0.0, 10.0), (1, 2, "a", 11.25, 12.0), (1, 3, "a", 13.5, 14.0)], LABELLED)
    assert tuples(L.merge(df, ["key"], 1.25), "start", "end", "n") == [(0.0, 12.0, 2), (13.5, 14.0, 1)]
    assert tuples(L.merge(df, ["key"], 1.25, strict=True), "start", "end", "n") == [(0.0, 10.0, 1), (11.25, 12.0, 1), (13.5, 14.0, 1)]


def test_label_islands_are_two_level(spark):
    df = spark.createDataFrame([(1, 1, "music", 0.0, 100.0), (1, 2, "speech", 10.0, 12.0), (1, 3, "speech", 50.0, 52.0)], LABELLED)
    assert len(L.merge(df, ["key"], 0.08, "label").collect()) == 3


def test_runs_overwrite_the_end(spark):
    df = spark.createDataFrame([(1, 1, "a", 0.0, 10.0), (1, 2, "a", 9.98, 9.99), (1, 3, "b", 9.99, 20.0)], LABELLED)
    assert tuples(L.run_length(df, ["key"], "label", 0.05), "label", "start", "end") == [("a", 0.0, 9.99), ("b", 9.99, 20.0)]
    assert tuples(L.chain_last_end(df, ["key"], 1.0), "start", "end") == [(0.0, 20.0)]


def test_gap_of_exactly_the_least_is_filled(spark):
    df = spark.createDataFrame([(1, 1, "s", 0.75, 2.0), (1, 2, "s", 2.5, 3.0)], LABELLED)
    got = tuples(L.fill_gaps(df, ["key"], "label", 0.75, "gap", F.lit(4.0)), "label", "start", "end")
    assert got == [("gap", 0.0, 0.75), ("gap", 3.0, 4.0), ("s", 0.75, 2.0), ("s", 2.5, 3.0)]


def test_overlap_kinds_at_touching_borders(spark):
    a, b = (F.lit(0.0), F.lit(5.0)), (F.lit(5.0), F.lit(9.0))
    assert one(spark, I.touches(*a, *b), z=1) and not one(spark, I.overlaps(*a, *b), z=1) and one(spark, I.overlaps(*a, *b, 2), z=1)
    assert one(spark, I.overlap_length(*a, *b), z=1) == 0


def test_interval_join_finds_each_pair_once(spark):
    left = spark.createDataFrame([(1, k, float(k * 7 % 50), float(k * 7 % 50 + k % 13)) for k in range(60)], "key int, id int, start double, end double")
    right = spark.createDataFrame([(1, k, float(k * 5 % 60), float(k * 5 % 60 + k % 17)) for k in range(60)], "key int, rid int, r_start double, r_end double")
    for rule in (I.overlaps, I.touches):
        naive = left.join(right, "key").where(rule(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")))
        assert tuples(I.interval_join(left, right, ["key"], 4.0, rule), "id", "rid") == tuples(naive, "id", "rid")


def test_points_on_section_borders(spark):
    sections = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 10.0, 20.0), (1, 2, 30.0, 40.0)], "key int, index int, start double, end double")
    points = spark.createDataFrame([(1, k, t) for k, t in enumerate([0.0, 10.0, 20.0, 25.0, 40.0, 99.0])], "key int, id int, t double")
    assert [x for _, x in tuples(I.locate(points, sections, ["key"]), "id", "index")] == [0, 1, 1, 1, 2, 2]


def test_as_of_sides_tolerance_and_nothing(spark):
    left = spark.createDataFrame([(1, 1, 5.0), (1, 2, 0.5), (2, 3, 5.0)], "key int, id int, t double")
    right = spark.createDataFrame([(1, 5.0, "a"), (1, 5.001, "b"), (1, 9.0, "c")], "key int, at double, v string")
    assert tuples(N.as_of(left, right, ["key"], "t", "at", ["v"]), "id", "r_v") == [(1, "a"), (2, None), (3, None)]
    assert tuples(N.as_of(left, right, ["key"], "t", "at", ["v"], tolerance=0.0015), "id", "r_v")[0] == (1, "b")
    assert tuples(N.as_of(left, right, ["key"], "t", "at", ["v"], forward=True), "id", "r_v") == [(1, "a"), (2, "a"), (3, None)]
    near = N.nearest(left, spark.createDataFrame([(1, 4.0), (1, 6.0)], "key int, at double"), ["key"], "t", "at")
    assert tuples(near, "id", "nearest") == [(1, 4.0), (2, 4.0), (3, None)]


def test_padding_stops_at_neighbours(spark):
    clip = spark.createDataFrame([(1, 100.0, 200.0)], "key int, start double, end double")
    speech = spark.createDataFrame([(1, 50.0, 96.0), (1, 230.0, 240.0)], "key int, start double, end double")
    assert tuples(N.pad_to_neighbours(clip, speech, ["key"], 10.0), "clip_start", "clip_end") == [(96.0, 210.0)]


@pytest.mark.parametrize(("text", "silent"), [("", True), (None, True), ("[música]", True), ("(aplausos)", True), ("Music playing", True), ("musical", False), ("amén", False), ("[a] b", False)])
def test_non_speech(spark, text, silent):
    assert one(spark, T.non_speech(F.col("t")), t=text) is silent
    assert one(spark, T.non_speech_exact(F.col("t"), ["amen", "amén"]), t="Amén") is True


def test_clean_texts(spark):
    assert one(spark, T.clean(F.col("t")), t=" a  b\n") == "a b"
    assert one(spark, T.clean_bracketed(F.col("t")), t="[x y]") == ""
    assert one(spark, T.tidy(F.col("t")), t="a , b !") == "a, b!"
    assert one(spark, T.normal_key(F.col("t")), t="Él, DIJO: sí!") == "él dijo sí"
    assert one(spark, T.shorten(F.col("t"), 4), t="abcdef") == "abc…"
    assert one(spark, T.slug(F.col("t"), "post"), t="Fe, Coraje y Proceso!") == "fe-coraje-y-proceso"
    assert one(spark, T.slug(F.col("t"), "post"), t="!!") == "post"
    assert one(spark, T.references(F.col("t")), t="Santiago 1:2-4, Romanos 5:3-5, x") == ["Santiago 1:2-4", "Romanos 5:3-5"]


@pytest.mark.parametrize(("text", "region", "kind"), [("Juan 3:16", "slide", "bible_verse"), ("Tema: fe", "full", "sermon_title"), ("Tema: fe", "slide", "on_screen_text"), ("Ana Soto", "lower_third", "speaker_name"), ("Pastor Juan Pérez Soto", "slide", "speaker_name"), ("alabemos al señor siempre juntos", "full", "song_lyric"), ("hola", "full", "on_screen_text")])
def test_on_screen_types(spark, text, region, kind):
    assert one(spark, T.on_screen_type(F.col("t"), F.col("r")), t=text, r=region) == kind


def test_section_types_and_cues(spark):
    kind = lambda t: one(spark, T.section_type(F.col("t"), F.lit("other")), t=t)
    assert [kind(t) for t in ("Oremos hermanos", "CANTEMOS", "los diezmos", "feliz sábado", "FELIZ SÁBADO", "nada")] == ["prayer", "congregational_music", "offering", "welcome", "welcome", "other"]
    found = one(spark, T.cues(F.col("t")), t="Cantemos y oremos")
    assert [c.kind for c in found] == ["invite_pray", "invite_sing"] and one(spark, T.cues(F.col("t")), t="Amén.") == []


def test_labels(spark):
    assert [one(spark, T.audio_label(F.col("t")), t=t) for t in ("(Piano)", "[Pausa]", "voice", "", "door")] == ["music", "noenergy", "speech", "noise", "noise"]
    assert [one(spark, T.speaker_label(F.col("t")), t=t) for t in ("speaker_1", "7", "ana b", " ", None)] == ["SPEAKER_1", "SPEAKER_7", "SPEAKER_ANA_B", "SPEAKER_UNKNOWN", "SPEAKER_UNKNOWN"]
    assert one(spark, T.similarity(F.col("a"), F.col("b")), a="abcd", b="abxd") == pytest.approx(0.75)


def test_clocks_and_keys(spark):
    assert [one(spark, V.clock_seconds(F.col("t")), t=t) for t in ("1:23:37", "0:29", "x", "5")] == [5017.0, 29.0, 0.0, 0.0]
    assert one(spark, V.srt_clock(F.col("t")), t=90061.0625) == "01:01:01,063"
    assert one(spark, V.clock(F.col("t")), t=3661.9) == "01:01:01"
    assert [one(spark, V.fixed(F.col("t"), 2), t=t) for t in (1.005, 0.125, 1234.5)] == ["1.00", "0.12", "1234.50"]
    import hashlib

    want = hashlib.sha1(b"job|1.000|2.500|T|").hexdigest()[:24]
    assert one(spark, V.clip_key(F.lit("job"), F.lit(1.0), F.lit(2.5), F.lit(" T "), F.lit(None).cast("string")), z=1) == want


def test_status(spark):
    parts = lambda s: (one(spark, V.status_stage(F.col("s")), s=s), one(spark, V.status_percent(F.col("s")), s=s), one(spark, V.status_progress(F.col("s")), s=s))
    assert parts("pending") == ("pending", 0.0, 0.0) and parts("completed")[2] == 100.0
    assert parts("processing:ingest:x:40%") == ("ingest", 40.0, 6.0) and parts("processing:transcribe:30/120") == ("transcribe", 25.0, 21.25) and parts("processing")[2] == 0.0


def test_greedy_choices(spark):
    df = spark.createDataFrame([(1, 0.0, -3.0), (1, 10.0, -9.0), (1, 15.0, -1.0), (1, 25.0, -8.0)], "key int, t double, bad double")
    assert P.spaced(df, ["key"], "t", ["bad", "t"], 15.0, 8).first().kept == [10.0, 25.0]
    clips = spark.createDataFrame([(1, 1, 0.0, 30.0), (1, 2, 31.0, 60.0), (1, 3, 32.0, 60.0)], "key int, nth int, start double, end double")
    assert [tuple(x) for x in P.disjoint(clips, ["key"], ["nth"], 2.0, 5).first().kept] == [(0.0, 30.0), (32.0, 60.0)]


def test_upsert_twice_is_once(spark):
    schema = "id int, v string, made string"
    table, rows = spark.createDataFrame([(1, "a", "t1"), (2, "b", None)], schema), spark.createDataFrame([(2, "B", "t2"), (3, "c", "t2"), (1, None, "t2")], schema)
    once = E.upsert(table, rows, ["id"], keep=("made",))
    assert tuples(once, "id", "v", "made") == [(1, None, "t1"), (2, "B", "t2"), (3, "c", "t2")]
    assert tuples(E.upsert(once, rows, ["id"], keep=("made",)), "id", "v", "made") == tuples(once, "id", "v", "made")


def test_queue_states(spark):
    schema = "id int, created_at long, status string, lease_expires_at long, attempt_count int, claim_token string"
    rows = [(1, 5, "processing", 100, 1, "x"), (2, 9, "pending", None, 0, None), (3, 1, "processing", None, 1, "y"), (4, 2, "failed", 1, 1, None), (5, 3, "processing:a", 99, 1, "z")]
    jobs = spark.createDataFrame(rows, schema)
    assert [r.id for r in E.queue_head(jobs, F.lit(100), 5).collect()] == [5, 2]
    taken = E.claim(E.queue_head(jobs, F.lit(100)), "w", F.lit("t"), F.lit(100), 1).first()
    assert taken.lease_expires_at == 100 + 30_000_000 and taken.attempt_count == 2 and taken.claimed_by == "w"
    done = {r.id: r for r in E.finish(jobs, F.lit("x"), "completed").collect()}
    assert done[1].status == "completed" and done[1].claim_token is None and done[3].status == "processing" and done[5].lease_expires_at == 99


def test_scores(spark):
    assert [one(spark, S.ending_completeness(F.col("t")), t=t) for t in ("Fin.", 'Sí!"', "y amén", "pero,", "pero", "")] == [1.0, 1.0, 0.9, 0.45, 0.65, 0.4]
    pick = S.first_largest([("a", F.col("a")), ("b", F.col("b"))])
    assert [one(spark, pick, a=a, b=b) for a, b in ((1, 1), (1, 2), (0, 0))] == ["a", "b", None]
    assert one(spark, S.calibrate(F.lit("congregational_music"), F.lit(0.9), F.lit(0.1), F.lit(0.8), F.lit(0.0)), z=1) == 0.45


def test_folds(spark):
    words = [(1, 0.0, 0.4, "Hola", "A", "word"), (1, 0.4, 0.5, ",", "A", "word"), (1, 0.6, 1.0, "amigos", "A", "word"), (1, 1.0, 1.4, "sí", "B", "word"), (1, 3.0, None, "fin", "B", "word"), (1, 3.1, 3.5, "(risa)", None, "audio_event")]
    got = folds.captions(spark.createDataFrame(words, "key int, start double, end double, text string, speaker string, kind string"), ["key"])
    assert tuples(got, "text", "start", "end") == [("(risa)", 3.1, 3.5), ("Hola, amigos", 0.0, 1.0), ("fin", 3.0, 3.05), ("sí", 1.0, 1.4)]
    events = [(1, 1, 31.0, "abc def", 0, 0.66, "t"), (1, 2, 53.0, "xyz qrs", 1, 0.573, "t"), (1, 3, 60.0, "abc def", 0b11111, 0.9, "t"), (1, 4, 70.0, "zzzzzz", 0b11111, 0.9, "u"), (1, 5, 80.0, "other", 1 << 40 | 0xFFF, 0.1, "t")]
    df = spark.createDataFrame(events, "key int, id long, start double, text string, hash long, confidence double, type string")
    assert tuples(folds.duplicate_groups(df, ["key"]), "id", "leader", "group", "is_representative") == [(1, 1, 1, False), (2, 1, 1, False), (3, 1, 1, True), (4, 4, 2, True), (5, 5, 3, True)]
    path = spark.createDataFrame([(1, float(k), float(k % 2)) for k in range(5)], "key int, t double, x double")
    assert [x for _, x in tuples(folds.smooth(path, ["key"], 0.5, False), "t", "x")] == [0.0, 0.5, 0.25, 0.625, 0.3125]
    assert [t for t, _ in tuples(folds.simplify(path.withColumn("x", F.col("t") * 2), ["key"], 0.1), "t", "x")] == [0.0, 4.0]


def test_readers_and_writers(spark, tmp_path):
    srt = "1\n00:00:00,000 --> 00:00:10,500\nHello\nworld\n\n2\n00:00:11,000 --> 00:00:12,000\n\n\nx\nno time\ny\n\n4\n01:00:00,250 --> 01:00:01,000\nend"
    got = readers.parse_srt(spark.createDataFrame([(1, srt), (2, srt.replace("\n", "\r\n"))], "key int, content string"))
    assert tuples(got.where("key = 1"), "start", "end", "text") == [(0.0, 10.5, "Hello world"), (3600.25, 3601.0, "end")]
    assert tuples(got.where("key = 2"), "start", "text")[0] == (0.0, "Hello world")
    lines = spark.createDataFrame([(1, 1, "**0:29** · [música]"), (1, 2, "x"), (1, 3, "**1:00:01** · \\[música\\]\r")], "key int, n int, line string")
    captions = readers.parse_captions(lines, ["key"])
    assert tuples(captions, "start", "end", "text") == [(29.0, 3601.0, "[música]"), (3601.0, 3606.0, "\\[música\\]")] and readers.music_captions(captions).count() == 2
    (tmp_path / "a.json").write_text('{"source": "s", "events": [{"label": "Music", "start": 1, "end": 4}, {"label": "x", "start": null, "end": 2}]}')
    assert tuples(readers.read_audio_events(spark, str(tmp_path / "a.json")), "label", "start", "end", "duration") == [("music", 1.0, 4.0, 4.0)]
    deep = spark.createDataFrame([(1, '{"a": [{"start": 1, "end": 2, "text": "x", "n": {"start_time": 3, "end_time": 4, "transcript": "y"}}], "b": {"start": 1}}'), (2, "{bad"), (3, None)], "key int, j string")
    assert tuples(readers.walk_turns(deep, ["key"], "j"), "key", "start", "end", "text") == [(1, 1.0, 2.0, "x"), (1, 3.0, 4.0, "y")]
    sections = spark.createDataFrame([(1, 1, 0.0, 5.0, "A", "x")], "key int, id int, start double, end double, title string, text string")
    assert writers.to_markdown(sections, ["key"]).first().content == "## A (00:00:00 - 00:00:05)\n\nx"


def test_speaker_bounds_match_a_full_comparison(spark):
    """Turns of one speaker that overlap, enclose each other or tie."""
    import random

    from weftline.operators import sections

    rnd = random.Random(6)
    turns = [(k, s, float(a), float(a + rnd.choice([0, 1, 5, 30]))) for k in range(3) for s in "ab" for a in rnd.sample(range(100), 12)]
    asked = [(k, s, float(rnd.randint(-5, 140)), float(rnd.randint(-5, 140))) for k in range(4) for s in "abc" for _ in range(10)]
    asked = sorted(set(asked))
    df = spark.createDataFrame(turns, "key int, speaker string, start double, end double")
    got = sections.speaker_bounds(df, spark.createDataFrame(asked, "key int, speaker string, around_start double, around_end double"), ["key"]).collect()
    want = set()
    for k, s, a, b in asked:
        own = [(x, y) for q, w, x, y in turns if (q, w) == (k, s)]
        if own:
            start = min(own, key=lambda t: (not t[0] <= a <= t[1], 0.0 if t[0] <= a <= t[1] else abs(t[0] - a), t))[0]
            end = min(own, key=lambda t: (not t[0] <= b <= t[1], 0.0 if t[0] <= b <= t[1] else abs(t[1] - b), t))[1]
            want.add((k, s, a, b, start, end))
    assert {(r.key, r.speaker, r.around_start, r.around_end, r.start, r.end) for r in got} == want and len(got) == len(want)


def test_fingerprints_of_files(spark, tmp_path):
    import os

    from weftline.sources import readers

    (tmp_path / "a b.bin").write_bytes(b"x" * 17)
    os.utime(tmp_path / "a b.bin", (1_700_000_000.9, 1_700_000_000.9))
    (row,) = readers.file_fingerprints(spark, str(tmp_path)).collect()
    assert row.fingerprint.endswith(":17:1700000000") and row.fingerprint.split(":")[0] in ("a b.bin", "a%20b.bin")


def test_regions_are_forced_and_relaxed(spark):
    from weftline.operators import folds

    p = folds.RegionParams(threshold=0.5, cut_boost=0.1, relax=0.5, probe_every=3, most=1)
    rows = [(1, 1, "a", 0.6, False), (1, 1, "b", 0.7, False), (1, 2, "a", 0.3, False), (1, 2, "b", 0.3, False), (1, 3, "a", 0.1, False), (1, 3, "b", 0.1, False), (1, 4, "a", 0.45, True), (1, 5, "a", 0.1, False), (1, 6, "a", 0.2, False)]
    got = folds.region_gate(spark.createDataFrame(rows, "key int, t int, region string, score double, cut boolean"), ["key"], p).orderBy("t").collect()
    assert [(r.t, r.region, r.forced) for r in got] == [(1, "b", False), (2, "b", False), (3, "a", True), (4, "a", False), (6, "a", True)]
