"""Functions, readers, writers and folds by their values: small cases, and loops in plain Python beside the folds."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import values as V
from weftline.operators import entity as E
from weftline.operators import folds
from weftline.operators import islands as L
from weftline.operators import scoring
from weftline.operators import sections as O
from weftline.sources import readers, writers


def all_of(spark, expression, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_gates_of_texts(spark):
    rows = [("Hola a todos", 0.9, "slide"), ("|| ~~ [] ab", 0.9, "slide"), ("Hola", 0.1, "slide"), ("", 0.9, "slide"), (None, 0.9, "x"), ("Tema: la gracia de Dios para hoy", 0.5, " Title ")]
    schema = "t string, c double, k string"
    t, c, k = F.col("t"), F.col("c"), F.col("k")
    assert all_of(spark, T.keep_text(t, c, 3, 0.4, 0.5, 0.5, 0.3), rows, schema) == [True, False, False, False, False, True]
    assert all_of(spark, T.keep_fullscreen(t, F.lit(0.0), F.lit(3.0), c, 2.0, 0.4, 10, 3, 2, 0.6, 0.1), rows, schema) == [True, False, False, False, False, True]
    assert all_of(spark, T.keep_fullscreen(t, F.lit(0.0), F.lit(1.0), c, 2.0, 0.4, 10, 3, 2, 0.6, 0.1), rows, schema) == [False] * 6
    assert all_of(spark, T.keep_rescued(t, c, k, 0.4, 4, ["title"], "hola"), rows, schema) == [True, False, False, False, False, True]


def test_second_reading_of_a_text(spark):
    rows = [("", 0.1, "La gracia", 0.1), ("La gracia", 0.9, "", 0.9), ("|~ x", 0.5, "La gracia de Dios", 0.5), ("La gracia de Dios", 0.9, "|~ x", 0.2), ("La gracia de Dios", 0.5, "La gracia de Dios", 0.7)]
    expression = T.cloud_override(F.col("a"), F.col("ca"), F.col("b"), F.col("cb"), 0.05)
    assert all_of(spark, expression, rows, "a string, ca double, b string, cb double") == [True, False, True, False, True]


def test_small_functions(spark):
    one = lambda e, **v: all_of(spark, e, [tuple(v.values())], ", ".join(f"{k} {'string' if isinstance(x, str) else 'long' if isinstance(x, int) else 'array<string>'}" for k, x in v.items()))[0]
    assert [one(T.title_of(F.col("k")), k=k) for k in ("prayer", "welcome", "x")] == ["Oración congregacional", "Bienvenida", "Transición"]
    assert [one(T.hook_type(F.col("k")), k=k) for k in (" Promise", "joke", "")] == ["promise", "none", "none"]
    assert one(T.string_list(F.col("t"), 4), t=" fe, , esperanza y  amor,") == ["fe", "espe"]
    assert one(T.references(F.col("t")), t="Juan 3:16, ab, Salmo 23") == ["Juan 3:16", "Salmo 23"]
    assert one(T.join_tokens(F.col("w")), w=["Hola", ",", "(", "amigos", ")", "!"]) == "Hola, (amigos)!"
    assert one(T.slug(F.col("t"), "post"), t="Ế Ǽ ¡Fe, Coraje y Proceso! ñandú é") == "e-fe-coraje-y-proceso-nandu-e"
    assert one(V.hamming(F.col("a"), F.col("b")), a=0b1011, b=0b0110) == 3 and one(V.hamming(F.col("a"), F.col("b")), a=-1, b=0) == 64
    assert one(V.unfenced(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    box = lambda *v: [F.lit(x) for x in v]
    assert one(V.box_iou(box(0, 0, 10, 10), box(5, 0, 10, 10)), z=1) == pytest.approx(50 / 150) and one(V.box_iou(box(0, 0, 1, 1), box(5, 5, 1, 1)), z=1) == 0
    assert one(scoring.clip_score(F.lit(0.5), F.lit(1.0), F.lit(0.0), F.lit(1.0)), z=1) == 0.75
    with pytest.raises(ValueError, match="absent_name"):
        scoring.candidate_score([(1.0, "absent_name")], F.lit(0.0), F.lit(0.0), ["t"])
    assert all_of(spark, T.similarity("a", "b"), [("abcd", "bcde"), ("", "a")], "a string, b string") == [0.75, 0.0]


def test_readers_of_odd_files(spark, tmp_path):
    (tmp_path / "t.srt").write_text("1\n00:00:00,000 --> 00:00:02,000\nHello\n")
    (tmp_path / "t.json").write_text('[{"start": 1, "end": 2, "text": "x"}]')
    assert [tuple(r) for r in readers.read_transcript(spark, str(tmp_path / "t.json"), str(tmp_path / "t.srt")).collect()] == [(1.0, 2.0, "x")]
    assert [tuple(r) for r in readers.read_transcript(spark, str(tmp_path / "none.json"), str(tmp_path / "t.srt")).collect()] == [(0.0, 2.0, "Hello")]
    odd = spark.createDataFrame([(1, '{"x": [{"start": true, "end": 2, "text": "a"}, {"start": NaN, "end": 2, "text": "b"}, {"start": 1, "end": 2, "text": "c"}]}')], "key int, j string")
    assert [r.text for r in readers.walk_turns(odd, ["key"], "j").collect()] == ["c"]
    rows = spark.createDataFrame([(2.0, 3.0, " a  b "), (None, 1.0, "x"), (float("nan"), 1.0, "y")], "start double, end double, text string")
    assert [tuple(r) for r in readers.normalize_timeline(rows).collect()] == [(2.0, 3.0, "a b")]
    both = readers.bounds_of(F.col("j"))
    docs = spark.createDataFrame([('{"boundaries": {"start": 3, "end": "9"}}',), ('{"clip_start_sec": 1, "start": 5, "end": 7}',), ('{"x": 1}',)], "j string")
    assert [tuple(r) for r in docs.select(both[0].alias("a"), both[1].alias("b")).collect()] == [(3.0, 9.0), (1.0, 7.0), (None, None)]
    assert not readers.table_exists(spark, "no_such_table_here")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, float("nan"))], "id int, v double")
    for _ in range(2):
        writers.write_json(df, str(tmp_path / "j"))
        writers.append_json_lines(df, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2 and spark.read.json(str(tmp_path / "l")).count() == 4
    rows = writers.event_rows(spark.createDataFrame([(None, float("inf")), ("x", 1.0)], "kind string, v double"), {"kind": F.lit("other")}, ["v"])
    assert [tuple(r) for r in rows.collect()] == [("other", None), ("x", 1.0)]
    events = spark.createDataFrame([(1, 0.0, 1.0, "a", True), (1, 2.0, 3.0, "b", False), (2, 0.0, 1.0, "c", False)], "key int, start double, end double, text string, flag boolean")
    made = {r.key: (r.total, r.flagged, r.events) for r in writers.package(events, ["key"], "flag").collect()}
    assert made == {1: (2, 1, '[{"start":0.0,"end":1.0,"text":"a"}]'), 2: (1, 0, '[{"start":0.0,"end":1.0,"text":"c"}]')}


def test_latest_and_split_words(spark):
    rows = spark.createDataFrame([(1, 1, "old"), (1, 3, "new"), (2, 2, "only")], "key int, v int, t string")
    assert sorted(r.t for r in E.latest(rows, ["key"], [F.desc("v")]).collect()) == ["new", "only"]
    words = spark.createDataFrame([(1, 1, 0.0, 0.4, "a"), (1, 2, 0.9, 1.2, "b"), (1, 3, 1.8, 2.0, "c"), (1, 4, 9.0, 9.0, "d")], "key int, id int, start double, end double, text string")
    assert sorted((r.start, r.end, r.text) for r in L.split_words(words, ["key"], 0.55).collect()) == [(0.0, 1.2, "a b"), (1.8, 2.0, "c")]


def test_locate_matches_all_pairs(spark):
    """Gaps, touching borders and empty sections, against a loop over all of them."""
    from weftline.operators.intervals import locate

    r = random.Random(3)
    at, sections = 0, []
    for k in range(40):
        length = r.choice([0, 1, 5, 9])
        sections.append((1, k, at, at + length))
        at += length + r.choice([0, 1, 4])
        at += not length  # two sections don't begin at one time
    points = [(1, k, r.randrange(-3, at + 5)) for k in range(300)]

    def wanted(t):
        inside = [k for _, k, a, b in sections if a <= t and (t < b or k == 39 and t <= b)]
        return inside[0] if inside else min(sections, key=lambda s: (min(abs(t - s[2]), abs(t - s[3])), s[1]))[1]

    got = locate(spark.createDataFrame(points, "key int, id int, t long"), spark.createDataFrame(sections, "key int, index int, start long, end long"), ["key"])
    assert {x["id"]: x["index"] for x in got.collect()} == {k: wanted(t) for _, k, t in points}


# --- folds beside plain loops -----------------------------------------------------------------------


def same(a, b, least):
    return bool(a and b) and SequenceMatcher(None, a, b).ratio() >= least


def test_merge_similar(spark):
    r = random.Random(1)
    texts = ["santo santo", "santo santi", "gloria a dios", "otra cosa", ""]
    rows = [(k % 3, k, float(k), float(k) + r.choice([0.5, 3.0]), r.choice(texts), r.randrange(64), r.random()) for k in range(90)]
    got = folds.merge_similar(spark.createDataFrame(rows, "key int, id long, start double, end double, text string, hash long, confidence double"), ["key"], folds.MergeParams(gap=4.0, bits=1)).collect()
    want = []
    for key in range(3):
        runs = []
        for _, _, a, b, t, h, c in sorted((x for x in rows if x[0] == key), key=lambda x: x[2]):
            if runs and a - runs[-1]["end"] <= 4.0 and (same(runs[-1]["text"], t, 0.88) or bin(runs[-1]["hash"] ^ h).count("1") <= 1):
                now = runs[-1]
                now["end"], now["n"] = max(now["end"], b), now["n"] + 1
                if c > now["c"]:
                    now["text"], now["c"] = t, c
            else:
                runs.append({"start": a, "end": b, "text": t, "hash": h, "c": c, "n": 1})
        want += [(key, k, x["start"], x["end"], x["text"], x["hash"], x["c"], x["n"]) for k, x in enumerate(runs, 1)]
    assert sorted((x.key, x.number, x.start, x.end, x.text, x.hash, x.confidence, x.n) for x in got) == want


def test_fuse_takes_the_largest_cluster(spark):
    rows = [(1, "a", 1, 0.0, 1.0, "juan soto", 0.5), (1, "a", 2, 1.0, 2.0, "juan sota", 0.9), (1, "a", 3, 2.0, 3.0, "tema", 0.99), (1, "b", 4, 0.0, 1.0, "x", 1.0)]
    got = folds.fuse(spark.createDataFrame(rows, "key int, track string, id long, start double, end double, text string, confidence double"), ["key"], "track").collect()
    assert [(x.track, x.text, x.confidence, x.n, x.start, x.end) for x in got] == [("a", "juan sota", pytest.approx(0.7), 2, 0.0, 2.0)]


def test_online_centroids(spark):
    r = np.random.default_rng(1)
    vectors = [(1, k, k, (np.eye(4)[k % 3] + r.normal(size=4) * 0.2).tolist()) for k in range(40)] + [(1, 99, 99, [0.0] * 4)]
    got = {x.id: x.cluster for x in folds.online_centroids(spark.createDataFrame(vectors, "key int, id long, t long, vector array<double>"), ["key"]).collect()}
    sums, want = [], {}
    for _, k, _, v in vectors:
        v = np.array(v)
        cosine = [float(s @ v / (np.linalg.norm(s) * np.linalg.norm(v))) if np.linalg.norm(v) else -1.0 for s in sums]
        best = int(np.argmax(cosine)) if cosine else -1
        if not cosine or cosine[best] < 0.48:
            sums.append(v)
            best = len(sums) - 1
        else:
            sums[best] = sums[best] + v
        want[k] = best
    assert got == want and len(sums) >= 3


def test_track_boxes(spark):
    """Two boxes that move slowly, one that leaves and comes back too late, one that comes back in time."""
    rows = []
    for t in range(12):
        rows.append((1, 10 * t, t, 5.0 * t / 4, 0.0, 10.0, 10.0))
        if t not in (3, 4, 5, 6):
            rows.append((1, 10 * t + 1, t, 100.0, 0.0, 10.0, 10.0))
        if t not in (3, 4):
            rows.append((1, 10 * t + 2, t, 200.0, 0.0, 10.0, 10.0))
    got = {x.id: (x.track, x.hits) for x in folds.track_boxes(spark.createDataFrame(rows, "key int, id long, t int, x double, y double, w double, h double"), ["key"]).collect()}
    assert {got[10 * t][0] for t in range(12)} == {1} and got[110][1] == 12
    assert {got[10 * t + 1][0] for t in range(3)} == {2} and {got[10 * t + 1][0] for t in range(7, 12)} == {4}
    assert {got[10 * t + 2][0] for t in range(12) if t not in (3, 4)} == {3} and got[112][1] == 10


def test_rescue_neighbours(spark):
    rows = [(1, 1, 0.0, 10.0, 0.5, 0.5, 0.5, True), (1, 2, 20.0, 25.0, 0.9, 0.6, 0.5, False), (1, 3, 30.0, 35.0, 0.9, 0.8, 0.5, False), (1, 4, 40.0, 45.0, 0.9, 0.7, 0.5, False), (1, 5, 50.0, 55.0, 0.4, 0.9, 0.5, False), (1, 6, 71.0, 75.0, 0.9, 0.9, 0.5, False), (1, 7, 301.0, 305.0, 0.9, 0.9, 0.5, False)]
    got = folds.rescue_neighbours(spark.createDataFrame(rows, "key int, id long, start double, end double, score double, text_score double, priority double, picked boolean"), ["key"])
    assert sorted(x.id for x in got.collect()) == [3, 4]


def test_chains_from_a_guess(spark):
    turns = [(1, 1, "A", 0.0, 5.0), (1, 2, "A", 6.0, 10.0), (1, 3, "B", 12.0, 13.0), (1, 4, "A", 14.0, 20.0), (1, 5, "A", 21.4, 25.0), (2, 1, "A", 0.0, 5.0), (2, 2, "B", 5.1, 5.9), (2, 3, "A", 6.0, 10.0), (3, 1, "B", 0.0, 1.0)]
    asked = [(1, "A", 8.0), (1, "A", 12.0), (1, "A", 22.0), (1, "A", 900.0), (2, "A", 8.0), (3, "A", 4.0)]
    got = O.chain_starts(spark.createDataFrame(turns, "key int, id long, speaker string, start double, end double"), spark.createDataFrame(asked, "key int, speaker string, guess double"), ["key"])
    assert {(r.key, r.guess): r.start for r in got.collect()} == {(1, 8.0): 0.0, (1, 12.0): 14.0, (1, 22.0): 14.0, (1, 900.0): 900.0, (2, 8.0): 6.0, (3, 4.0): 4.0}


def test_section_borders(spark):
    a, b = (F.lit(x) for x in (10.0, 20.0))
    df = spark.range(1)
    assert [df.select(O.window_hint(F.lit(s), F.lit(e), a, b).alias("w")).first().w[:] for s, e in ((5.0, 4.0), (0.0, 99.0), (5.0, 8.0))] == [(5.0, None), (10.0, 20.0), (5.0, 8.0)]
    texts = ["Feliz sábado", "feliz sabados", "xfeliz sábado", "amén.", "amén.ya", "amén"]
    found = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", F.lower("t").rlike(O.ascii_borders(O.GREETING)).alias("g"), O.hits(F.lower("t"), [O.CUES["closing"][0]]).alias("n"))
    assert [(r.g, r.n) for r in found.orderBy("k").collect()] == [(True, 0), (False, 0), (False, 0), (False, 0), (False, 1), (False, 1)]


def test_clock_from_a_hundred_hours_on(spark):
    rows = spark.createDataFrame([(1, 360_003.0), (2, 3_600_000.0), (3, 59.9), (4, 359_999.0)], "id int, s double")
    got = {r.id: r.c for r in rows.select("id", V.clock(F.col("s")).alias("c")).collect()}
    assert got == {1: "100:00:03", 2: "1000:00:00", 3: "00:00:59", 4: "99:59:59"}
