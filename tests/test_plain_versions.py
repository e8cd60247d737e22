"""Operators that SQL can't express against plain loops over small tables."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import folds


def alike(a, b):
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def test_captions(spark):
    rnd, p = random.Random(1), folds.CaptionParams(longest=3.0, least_chars=8, most_chars=30)
    rows = []
    for key in range(4):
        t = 0.0
        for i in range(120):
            t += rnd.choice([0.1, 0.2, 0.6, 0.55])
            end = None if rnd.random() < 0.1 else t + rnd.choice([0.1, 0.4])
            rows.append((key, t, end, rnd.choice(["hola", "amén", ",", "(", ")", "muy", "bien.", "", None]), rnd.choice(["a", "a", "a", "b", None]), rnd.choice(["word"] * 9 + ["audio_event"]), i))
    df = spark.createDataFrame([r[:6] for r in rows], "key int, start double, end double, text string, speaker string, kind string")
    got = [(r.key, round(r.start, 6), round(r.end, 6), r.text) for r in folds.captions(df, ["key"], p).collect()]
    assert sorted(got) == sorted(plain_captions(rows, p))


def plain_captions(rows, p):
    out = []
    for key in sorted({r[0] for r in rows}):
        now = None
        for _, a, b, text, who, kind, _ in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2] is None, r[2] or 0)):
            text = (text or "").strip()
            if not text:
                continue
            if now and (a - now[1] > p.gap or (who and now[3] and who != now[3]) or (b is not None and b - now[0] > p.longest and len(now[2]) >= p.least_chars) or len(now[2]) >= p.most_chars or kind == "audio_event"):
                out.append((key, round(now[0], 6), round(max(now[0] + 0.05, now[1]), 6), " ".join(now[2].split())))
                now = None
            if not now:
                now = (a, a if b is None else b, text, who)
                continue
            glue = "" if text[0] in ",.;:!?)]}" or now[2][-1] in "([{" else " "
            now = (min(now[0], a), now[1] if b is None else max(now[1], b), now[2] + glue + text, now[3] or who)
        if now:
            out.append((key, round(now[0], 6), round(max(now[0] + 0.05, now[1]), 6), " ".join(now[2].split())))
    return out


def test_fused_texts(spark):
    rnd = random.Random(2)
    texts = ["salmos 23", "salmos 28", "salmo 23", "pastor juan", "pastor luan", "gloria"]
    rows = [(k, rnd.randint(0, 3), float(i), i + rnd.random(), rnd.choice(texts), rnd.choice([0.3, 0.5, 0.9])) for k in range(3) for i in range(25)]
    got = {(r.key, r.track): (r.text, round(r.confidence, 9), r.n, r.start, r.end) for r in folds.fuse(spark.createDataFrame(rows, "key int, track int, start double, end double, text string, confidence double"), ["key"], "track").collect()}
    want = {}
    for key in range(3):
        for track in range(4):
            own = sorted((r for r in rows if r[:2] == (key, track)), key=lambda r: (r[2], r[3]))
            groups = []
            for r in own:
                home = next((g for g in groups if alike(g[0][4], r[4]) >= 0.84), None)
                if home is None:
                    groups.append([r])
                else:
                    home.append(r)
            if len(own) >= 2:
                big = max(groups, key=len)
                best = max(big, key=lambda r: (r[5], len(r[4])))
                want[key, track] = (best[4], round(sum(r[5] for r in big) / len(big), 9), len(big), min(r[2] for r in big), max(r[3] for r in big))
    assert got == want


def test_simplified_lines(spark):
    rnd = random.Random(3)
    rows = [(k, float(t), rnd.choice([0.0, 1.0, 5.0, 5.2])) for k in range(5) for t in sorted(rnd.sample(range(200), 40))]

    def plain(line, tolerance):
        if len(line) < 3:
            return line
        (a, x), (b, y) = line[0], line[-1]
        off = [abs(v - (x + (y - x) * (t - a) / (b - a))) for t, v in line[1:-1]]
        k = max(range(len(off)), key=off.__getitem__) + 1
        return plain(line[: k + 1], tolerance)[:-1] + plain(line[k:], tolerance) if off[k - 1] > tolerance else [line[0], line[-1]]

    got = folds.simplify(spark.createDataFrame(rows, "key int, t double, x double"), ["key"], 1.5).orderBy("key", "t").collect()
    for key in range(5):
        assert [(r.t, r.x) for r in got if r.key == key] == plain([(t, x) for k, t, x in rows if k == key], 1.5)


@pytest.mark.parametrize("most", [30, 3])
def test_rescued_neighbours(spark, most):
    rnd, p = random.Random(most), folds.RescueParams(bucket=100.0, window=20.0, most=most)
    rows = [(k, i, float(rnd.randint(0, 400)), rnd.choice([0.3, 0.5, 0.7]), rnd.choice([0.3, 0.5, 0.6]), rnd.random(), rnd.random() < 0.3) for k in range(3) for i in range(60)]
    rows = [(k, i, s, s + 5.0, a, b, c, d) for k, i, s, a, b, c, d in rows]
    got = sorted((r.key, r.id) for r in folds.rescue_neighbours(spark.createDataFrame(rows, "key int, id long, start double, end double, score double, text_score double, priority double, picked boolean"), ["key"], p).collect())
    want = []
    for key in range(3):
        taken = []
        for bucket in range(5):
            own = sorted((r for r in rows if r[0] == key and int(r[2] // 100) == bucket), key=lambda r: (r[2], r[1]))
            for anchor in [r for r in own if r[7]]:
                near = [r for r in own if not r[7] and r[4] >= p.score and r[5] >= p.text and anchor[3] <= r[2] <= anchor[3] + p.window and r[1] not in taken]
                near.sort(key=lambda r: (-r[5], -r[4], -r[6], r[2]))
                taken += [r[1] for r in near[: p.per_anchor]]
        want += [(key, i) for i in taken[:most]]
    assert got == sorted(want)


def test_on_screen_types(spark):
    rnd = random.Random(4)
    pieces = ["Salmos 23:1", "Tema", "tema:", "Pr. Juan", "pastor", "Ana María Soto", "Cantemos", "gloria", "al Señor", "Mensaje", "aviso", "el", "12", "Jesús", "x", "Iglesia", "santo", "título"]
    rows = [(i, " ".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 6))), rnd.choice(["slide", "lower_third", "full"])) for i in range(400)]
    flags = re.IGNORECASE

    def plain(text, region):
        t = re.sub(r"\s+([,.;:!?])", r"\1", " ".join(text.split()))
        words = t.split()
        if not t:
            return "on_screen_text"
        if re.search(rf"\b{T.VERSE}\b", t, flags):
            return "bible_verse"
        if region != "slide" and re.search(rf"\b({T.TITLE_CUE})\b", t, flags):
            return "sermon_title"
        named = bool(re.search(rf"\b({T.NAME_CUE})\b", t, flags))
        shape = 2 <= len(words) <= 7 and all(len(w) >= 2 for w in words) and any(w[0].isupper() for w in words)
        if region == "lower_third" and (named or shape):
            return "speaker_name"
        two = re.search(r"\b[A-ZÁÉÍÓÚÑ][a-záéíóúñü]+(?:\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñü]+){1,3}\b", t) or len(re.findall("[A-Za-zÁÉÍÓÚáéíóúÑñÜü]+", t)) >= 6
        if region == "slide" and named and two:
            return "speaker_name"
        return "song_lyric" if re.search(rf"\b({T.LYRIC_CUE})\b", t, flags) and len(words) >= 4 else "on_screen_text"

    df = spark.createDataFrame(rows, "id int, t string, region string").select("id", T.on_screen_type(F.col("t"), F.col("region")).alias("kind"))
    got = {r.id: r.kind for r in df.collect()}
    assert got == {i: plain(t, region) for i, t, region in rows}
    assert len(set(got.values())) == 5


def test_similarity_of_texts(spark):
    rnd = random.Random(5)
    words = ["feliz", "sabado", "himno", "a", "todos", ""]
    rows = [tuple(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 5))) for _ in range(2)) for _ in range(200)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", T.similarity("a", "b").alias("r")).collect()
    assert all(abs(r.r - alike(r.a, r.b)) < 1e-12 for r in got)
    assert all(folds.ratio(a, b, 0.8) in (0.0, alike(a, b)) and (folds.ratio(a, b, 0.8) >= 0.8) == (alike(a, b) >= 0.8) for a, b in rows)


def test_texts_are_tidied_once(spark):
    """Measures and types of whole documents share one pass of cleaning, and no word of a long text is taken apart."""
    df = spark.createDataFrame([("a", "slide")], "t string, r string")
    for made in (T.lexical_score(F.col("t")), T.keep_hard(F.col("t"), 0.7, 0.05, 2, 8), T.on_screen_types(F.col("t"), F.col("r"))):
        plan = df.select(made.alias("x"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("([,.;:!?])") == 1


def test_on_screen_types_are_those_of_each_function(spark):
    rnd = random.Random(5)
    some = ["Pr.", "Juan", "santo", "¡Gloria!", "(tu)", "Salmos", "23:1-4", "tema", "biblia", "texto bíblico", "iglesia", "a", "xyz", "amor,", "'mi'", "Ana", "1.5", "ALELUYA"]
    rows = [(k, " ".join(rnd.choices(some, k=rnd.randrange(0, 14))), rnd.choice(["slide", "lower_third", "full"])) for k in range(300)] + [(301, None, "slide"), (302, " \n", "full")]
    df = spark.createDataFrame(rows, "id int, t string, r string")
    c = F.col
    got = df.select("id", T.on_screen_types(c("t"), c("r")).alias("k")).select("id", "k.*")
    want = df.select("id", T.on_screen_type(c("t"), c("r")).alias("kind"), T.slide_type(c("t"), c("r")).alias("slide"), T.lyrics_type(c("t"), c("r")).alias("lyrics"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_shapes_of_words(spark):
    texts = ["", "a", "ab abc abcd", "¡¡¡ --- a1é", "x-y-z (ñ) ábc", "a b c d e f g h", "--- ... ñü", "abc " * 200 + "end", "-" * 600 + "abc " * 7]
    rows = [(k, " ".join(x.split())) for k, x in enumerate(texts)]
    letter = re.compile("[A-Za-zÁÉÍÓÚáéíóúÑñÜü0-9]")
    n, long, short = T.word_shapes(F.col("t"))
    df = spark.createDataFrame(rows, "id int, t string").select("id", n.alias("n"), long.alias("long"), short.alias("short"), T._up_to(F.col("t"), 6, lambda x: T._words_with(x, 3)).alias("six"))
    for r in df.collect():
        sizes = [len(letter.findall(w)) for w in rows[r.id][1].split()]
        assert (r.n, r.long, r.short) == (len(sizes), sum(x >= 3 for x in sizes), sum(x <= 1 for x in sizes))
        assert r.six == min(6, r.long)
