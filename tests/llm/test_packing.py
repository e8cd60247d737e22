"""Packing: ids against the library, pieces and places against their definition, the search against what it promises."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from weftline.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, length string, sequence_id int"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def strings(seed, n, longest):
    rnd = random.Random(seed)
    parts = ["a", "B", "é", "ß", "word", "Étoile", " ", " ", " ", "  ", "\n", "\n\n", "\t", "'s", "'", "'re", "'l", ".", ",", "\"'", "<|endoftext|>", "<", "|>", "日", "本語", "١", "²", "Ⅷ", "́", "\xa0", "\x85"]
    parts += [" ", "\x1c", "\x00", "3", "42", "_", "-", "~", "😀", "ſ", "ı", "ª", "µ", "\r\n", "﻿", "Привет"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("most", [3 << 18, 5])
def test_ids_are_the_library_s(library, most):
    encode = P.Encoder(PATH, most)
    assert encode.fast
    texts = strings(1, 20_000, 30) + ["", " ", "  a", "a ", "x" * 5000, "ab " * 5000]
    for k in range(0, len(texts), 1000):
        part = texts[k : k + 1000]
        assert [x.tolist() for x in encode(part)] == [library.encode(t, add_special_tokens=False).ids for t in part]


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    encode, library = P.Encoder(path), tokenizers.Tokenizer.from_file(path)
    assert not encode.fast
    texts = strings(2, 300, 20)
    assert [x.tolist() for x in encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def first_fit(lengths, size):
    rooms = []
    for n in lengths:
        k = next((k for k, room in enumerate(rooms) if room >= n), None)
        if k is None:
            rooms.append(size - n)
        else:
            rooms[k] -= n
    return len(rooms)


@pytest.mark.parametrize("size, partitions", [(2048, 3), (64, 5), (7, 1)])
def test_pieces_and_places(spark, library, size, partitions):
    texts = strings(size, 300, 120) + [None, "", "same text here"] + ["same text here"] * 40 + ["long " * 3000]
    rows = [(k if k % 17 else None, t, "x", 1) for k, t in enumerate(texts)]
    out = P.pack(spark.createDataFrame(rows, SCHEMA).repartition(partitions), P.PackingParams(PATH, size), keep_ids=True)
    found = out.collect()
    want = Counter()
    for doc, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % size + 1
        cuts = [0, *range(first, len(ids), size), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in found)
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    assert -(-sum(r.length for r in found) // size) <= len(bins) <= first_fit(sorted((r.length for r in found), reverse=True), size)


def test_search_keeps_all_pieces_and_never_adds_bins():
    for seed in range(12):
        rnd = random.Random(seed)
        low, high, n = rnd.choice([(1, 64, 300), (20, 40, 200), (22, 33, 100), (30, 40, 50), (1, 5, 500)])
        counts = Counter(rnd.randint(low, high) for _ in range(n))
        first = P.best_fit(dict(counts), 64)
        before = sum(k.n for k in first)
        after = P.improve(first, 64, 100_000)
        held = Counter()
        for kind in after:
            assert 0 < kind.fill <= 64 and kind.n > 0
            for length, k in kind.items.items():
                held[length] += k * kind.n
        assert held == counts
        assert sum(k.n for k in after) <= before
        squares = lambda kinds: sum(k.n * k.fill**2 for k in kinds)
        assert squares(after) >= squares(first)


def test_search_empties_a_bin():
    """Best fit leaves 10 + 5 + 5 and 7 + 6 + 6 of room 20 each apart from 1: two for one brings them together."""
    kinds = [P.Kind({11: 1, 5: 1}, 3), P.Kind({8: 1, 9: 1}, 3), P.Kind({3: 1, 4: 1}, 1)]
    after = P.improve(kinds, 20, 10_000)
    assert sum(k.n for k in after) == 6


def test_exchange_is_the_best_one():
    rnd = random.Random(3)
    for _ in range(300):
        a, b = (P.Kind(dict(Counter(rnd.randint(1, 12) for _ in range(rnd.randint(1, 5)))), 1) for _ in range(2))
        size = max(a.fill, b.fill) + rnd.randint(0, 6)
        sums = lambda k: {(): 0} | {(x,): x for x in k.items} | {(x, y): x + y for x in k.items for y in k.items if x < y or x == y and k.items[x] > 1}
        gains = [s - t for m, s in sums(a).items() for r, t in sums(b).items() if m and len(m) + len(r) < 4 and 0 < s - t <= size - b.fill and b.fill + s - t > a.fill]
        found = P.exchange(a, b, size)
        assert (sum(found[0]) - sum(found[1]) if found else None) == (max(gains) if gains else None)


def test_plan_places_each_rank_once():
    counts = {5: 1000, 3: 777, 9: 50, 1: 1, 16: 3}
    plan = P.plan(counts, 16, 10_000)
    length = np.concatenate([np.full(n, k) for k, n in counts.items()])
    rank = np.concatenate([np.arange(n) for n in counts.values()])
    sequence, offset = plan.places(length, rank)
    taken = sorted(zip(sequence.tolist(), offset.tolist(), length.tolist()))
    for (s, o, n), (t, q, _) in zip(taken, taken[1:]):
        assert q == (o + n if s == t else 0)
    assert set(sequence.tolist()) == set(range(plan.sequences))


def test_odd_tables(spark):
    assert P.pack(spark.createDataFrame([], SCHEMA), P.PackingParams(PATH)).collect() == []
    (row,) = P.pack(spark.createDataFrame([(None, None, None, None)], SCHEMA), P.PackingParams(PATH)).collect()
    assert tuple(row) == (None, 0, 0, 1, zlib.crc32(bytes(4)), 0, 0)
