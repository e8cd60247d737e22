"""Collocations against a plain count of every n-gram."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, longest=5):
    counts, words = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            words[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return counts, words


def plain(rows, least, longest=5, top=2000, covered=100):
    counts, words = plain_counts(rows, longest)
    out = []
    for lang, c in counts.items():
        n = words[lang]
        found = {x: a for x, a in c.items() if len(x) > 1 and a >= least}
        held = []
        for x, a in found.items():
            if any(100 * b >= covered * a for y, b in found.items() if len(y) > len(x) and any(y[i : i + len(x)] == x for i in range(len(y) - len(x) + 1))):
                continue
            s, k = min((1000 * a * n // (c[x[:k]] * c[x[k:]]), k) for k in range(1, len(x)))
            held.append((-s, -a, " ".join(x).encode(), c[x[:k]], c[x[k:]]))
        out += [(lang, r, x.decode(), -a, ll, rr, n, -s) for r, (s, a, x, ll, rr) in enumerate(sorted(held)[:top], 1)]
    return sorted(out)


def texts(seed, n):
    rnd = random.Random(seed)
    words = ["New", "york", "CITY", "é", "ÉA", "the", "of", "a\x1cb", " ", "x|y", "日本", "un"]
    seps = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", " ; ", "\x0b"]
    rows = [("".join(rnd.choice(words) + rnd.choice(seps) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "fr", None, "und"])) for _ in range(n)]
    rows += [("the cat sat on the mat. the cat sat", "en")] * 40 + [(None, "en"), (None, None), ("", "fr"), ("la la la la la la", "fr"), ("... , ;", "de")]
    return rows


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("p", [C.CollocationParams(least=12), C.CollocationParams(least=5, longest=3, top=7, covered=60), C.CollocationParams(least=12, cell_bytes=1 << 40, most_bits=4, slice_bytes=64), C.CollocationParams(least=3, longest=2)])
def test_collocations_match_plain(spark, p):
    rows = texts(p.least, 300)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    assert got(C.collocations(df, p)) == plain(rows, p.least, p.longest, p.top, p.covered)


def test_nothing_frequent_is_lost_and_little_else_is_counted(spark):
    rows = texts(1, 200)
    counts, words = plain_counts(rows)
    found = C.frequent(spark.createDataFrame(rows, "text string, lang string").repartition(3), C.CollocationParams(least=10)).collect()
    want = {(lang, " ".join(x)): a for lang, c in counts.items() for x, a in c.items() if a >= 10} | {(lang, ""): n for lang, n in words.items() if n}
    assert {(r.lang, r.phrase): r.n for r in found} == want


def test_filter_prunes():
    """A sketch with room keeps the few frequent pairs of many rare ones."""
    data = b" ".join(b"w%d x%d" % (k, k) for k in range(20_000)) + b" hot pair" * 200
    grams = C.Grams("en", data)
    at = np.flatnonzero(grams.starts(2))
    hashes = grams.hashes(2, at)
    bits = []
    for r in range(2):
        full = np.bincount(C._cells(hashes, r, 20).astype(int), minlength=1 << 20) >= 100
        bits.append(np.packbits(full, bitorder="little"))
    ok = C.Passed(bits, 20, 0)(hashes)
    assert {grams.words[i] for i in at[ok]} == {b"hot", b"pair"}
    coarse = C.Passed([np.packbits(np.unpackbits(b, bitorder="little").reshape(-1, 8).any(axis=1), bitorder="little") for b in bits], 20, 3)
    assert (coarse(hashes) >= ok).all()


def test_slices_are_whole_pieces():
    text = "A b, c\td.  " * 50
    batch = pa.RecordBatch.from_pydict({"lang": ["en", None, "en"], "text": [text, "x" * 500, None]})
    for most in (1, 7, 100, 1 << 20):
        out = list(C.slices(iter([batch]), most))
        pieces = [x.split() for lang, data in out if lang == "en" for x in data.split(b"\xff") if x.split()]
        assert pieces == [[b"a", b"b"], [b"c", b"d"]] * 50
        assert [data for lang, data in out if lang == "und"] == [b"x" * 500]


def test_score_is_exact(spark):
    rows = [(10**13 + 7, 3 * 10**15 + 1, 10**13 + 9, 2 * 10**14 + 3), (100, 2**60, 10_001, 100_003), (9 * 10**15, 9 * 10**15, 9 * 10**15, 9 * 10**15)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long").select(C.score(*map(F.col, "anlr")).alias("s"))
    assert [r.s for r in df.collect()] == [1000 * a * n // (ll * rr) for a, n, ll, rr in rows]


def test_odd_tables(spark):
    assert got(C.collocations(spark.createDataFrame([], "text string, lang string"))) == []
    wide = spark.createDataFrame([("a b " * 200, None, 1, 2, "z")], "text string, lang string, phrase int, n int, a string")
    assert got(C.collocations(wide)) == plain([("a b " * 200, None)], 100)
