"""Operators on documents against brute force, and their edge cases."""

import hashlib
import json
import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from weftline.llm.decontaminate import contaminated
from weftline.llm.lang_id import LangParams, identify
from weftline.llm.mixing import MixParams, entropy, find_exponent, mix, sums_of, tempered
from weftline.llm.near_dup import NearDupParams, least_matches, near_duplicates
from weftline.llm.quality import score_quality
from weftline.llm.substring import SubstringParams, counted_windows, remove_repeats, repeated_spans, window_anchors
from weftline.llm.token_counts import TokenCountParams, _plain_specials, count_tokens, encoder, pieces

WORDS = [f"w{k}" for k in range(400)]
DOC = "doc_id long, text string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text: str, seed: int, share: float) -> str:
    r = random.Random(seed)
    return " ".join(f"x{r.randrange(10**6)}" if r.random() < share else w for w in text.split())


def odd_documents() -> list[tuple]:
    long = prose(99, 20_000)
    return [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, long), (906, long), (None, prose(1, 60)), (None, None), (907, "ÀÉ ñ"), (907, "ÀÉ ñ")]


def with_clashes(df):
    """The same rows with further columns, named like the operators' own."""
    names = ["kept", "n_words", "n_removed", "doc_key", "anchors", "spans", "row", "component_id", "n_tokens", "sig", "keys", "words", "hash", "label", "score"]
    return df.select("*", *(F.lit(1).alias(n) for n in names if n not in df.columns))


# --- near duplicates ------------------------------------------------------------------------------


def brute_components(rows, width: int, percent: int = 80):
    sets = []
    for _, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        k = min(width, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (unique, _) in enumerate(rows):
        least[find(i)] = min(unique, least.get(find(i), unique))
    return [(u, len(sets[i]), least[find(i)]) for i, (u, _) in enumerate(rows)]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_match_brute_force(spark, width):
    rows = [(k, prose(k, 5 + k % 90)) for k in range(60)]
    rows += [(100 + k, edited(prose(k % 6, 80 + 5 * (k % 6)), k, 0.01 * (k % 5))) for k in range(80)]  # chains and families
    rows += [(300 + k, prose(3, 8)) for k in range(30)] + [(400, None), (401, ""), (402, "a"), (403, "A"), (404, "a b")]
    random.Random(5).shuffle(rows)
    got = near_duplicates(spark.createDataFrame(rows, DOC), NearDupParams(shingle=width)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows, width))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_group_without_a_center(spark):
    """A large family whose members are near some others but not the first one."""
    base = prose(7, 120).split()
    rows = []
    for k in range(120):  # a sliding chain: neighbours are alike, the ends are not
        rows.append((k, " ".join(base[:60] + [f"c{k + j}" for j in range(60)])))
    got = near_duplicates(spark.createDataFrame(rows, DOC), NearDupParams(shingle=2)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows, 2))


@pytest.mark.parametrize("block", [3, 7])
def test_mixed_buckets_in_blocks(spark, monkeypatch, block):
    """Families without a common center, dealt out in blocks of a few rows."""
    from weftline.llm import near_dup

    monkeypatch.setattr(near_dup, "BLOCK", block)
    rows = []
    for f in range(4):
        base = prose(70 + f % 2, 100).split()
        rows += [(100 * f + k, " ".join(base[:50] + [f"f{f}c{k + j}" for j in range(50)])) for k in range(25)]
    rows += [(900 + k, prose(70, 100)) for k in range(20)]  # copies
    got = near_duplicates(spark.createDataFrame(rows, DOC), NearDupParams(shingle=2)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows, 2))


def test_near_duplicates_of_a_small_table_leave_few_files(spark):
    """The tasks follow the rows, not the shuffle partitions: each one leaves files, however few rows it has."""
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")) if spark.sparkContext.getCheckpointDir() else None
    files = lambda: sum(1 for _ in folder.rglob("part-*")) if folder else 0
    rows = [(k, " ".join(prose(7, 120).split()[:60] + [f"c{k + j}" for j in range(60)])) for k in range(60)]
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in held}
    left = files()
    try:
        for name, value in held.items():
            spark.conf.set(name, value)
        got = near_duplicates(spark.createDataFrame(rows, DOC), NearDupParams(shingle=2)).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows, 2))
    assert files() - left < 1000


def test_near_duplicates_edges(spark):
    docs = with_clashes(spark.createDataFrame(odd_documents(), DOC))
    got = near_duplicates(docs).collect()
    assert len(got) == len(odd_documents())
    by = {r.doc_id: r for r in got}
    assert by[900].n_shingles == by[901].n_shingles == by[902].n_shingles == 0 and by[900].component_id == 900
    assert by[904].component_id == 903 and by[906].component_id == 905
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert near_duplicates(spark.createDataFrame([], DOC)).collect() == []


def test_least_matches_is_a_safe_bound():
    p = NearDupParams()
    assert 0 < least_matches(32, p) < 0.8 * 32 and least_matches(160, p) < 0.8 * 160
    assert least_matches(160, NearDupParams(miss=1e-3)) >= least_matches(160, p)


# --- repeated passages ----------------------------------------------------------------------------


def brute_removal(rows, window: int):
    words = [(t or "").encode().split() for _, t in rows]
    counts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (unique, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((unique, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("window", "anchor", "hot"), [(35, 8, 2000), (12, 4, 3), (5, 5, 0), (35, 8, 4)])
def test_removal_matches_brute_force(spark, window, anchor, hot):
    shared = [prose(1000 + k, window + 7 * k) for k in range(5)]
    r = random.Random(3)
    rows = [(k, " ".join([prose(k, r.randrange(0, 80)), shared[k % 5], prose(500 + k, r.randrange(0, 60)), *(shared[(k + 1) % 5].split()[: window + k % 3])])) for k in range(40)]
    rows += [(100, "a b " * 60), (101, "z " * (window + 1)), (102, "q " * window), (103, None), (104, ""), (105, prose(7, window - 1)), (106, prose(7, window - 1))]
    rows += [(107, rows[0][1]), (107, rows[0][1])]
    phrase = prose(2000, window - 3)  # stands in many documents, but no window recurs
    rows += [(200 + k, f"{prose(3000 + k, 20)} {phrase} {prose(4000 + k, 20)}") for k in range(12)]
    rows += [(None, rows[5][1]), (None, rows[5][1]), (None, prose(5000, 60)), (None, None), (None, "")] + [(None, prose(5001, 50))] * 6
    got = remove_repeats(with_clashes(spark.createDataFrame(rows, DOC)), SubstringParams(window=window, anchor=anchor, shard=3, hot=hot, held=5))
    found = [(x.doc_id, x.n_words, x.n_removed, hashlib.sha256(x.kept.encode()).hexdigest()) for x in got.collect()]
    order = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(found, key=order) == sorted(brute_removal(rows, window), key=order)


def test_windows_of_a_frequent_passage_are_joined_inside_tasks(spark):
    """A passage of 300 different segments is known to recur in their task: none of its windows is left for a join, and every segment has its stretch."""
    p = SubstringParams(window=20, anchor=4)
    passage = prose(1, 40)
    texts = [f"{prose(100 + k, 25)} {passage} {prose(900 + k, 25)}" for k in range(300)] + [f"{prose(2000, 25)} {passage} {prose(2001, 25)}"]
    least, _ = window_anchors(passage.encode().split(), p)
    hot = np.sort(np.unique(least))
    rows = counted_windows(spark.createDataFrame([(x,) for x in texts], "text string").coalesce(1), hot, p).toPandas()
    single = rows[rows.win_a.notna() & rows.seg_a.notna()]
    assert (single.n == 1).all() and not single.duplicated(["win_a", "win_b"]).any()
    assert rows.n.max() == 301 and (rows[rows.n > 1].seg_a.isna()).all()
    stretches = rows[rows.win_a.isna()]
    assert len(stretches.drop_duplicates(["seg_a", "seg_b"])) == len(stretches) >= 301
    assert (stretches.high - stretches.low >= p.window).all()


def test_removal_edges(spark):
    docs = with_clashes(spark.createDataFrame(odd_documents(), DOC))
    got = remove_repeats(docs, SubstringParams(untouched=True), carry=("label",)).collect()
    assert len(got) == len(odd_documents())
    by = {r.doc_id: r for r in got}
    assert by[905].n_removed == by[906].n_removed == 20_000 and by[905].kept == ""
    assert by[900].kept is None and by[902].kept == " \t\n" and by[903].label == 1
    assert remove_repeats(spark.createDataFrame([], DOC)).collect() == []


def test_spans_join_and_count_occurrences():
    a, b = b"a b c d e f".split(), b"x b c d y".split()
    assert repeated_spans([a, b], [1, 1], 3) == [[(1, 4)], [(1, 4)]]
    assert repeated_spans([a], [2], 3) == [[(0, 6)]]
    assert repeated_spans([a], [1], 3) == [[]]


# --- benchmark items ------------------------------------------------------------------------------


def test_contamination_matches_brute_force(spark):
    items = [(k, prose(2000 + k, 12 + 3 * k)) for k in range(12)] + [(50, "short one"), (51, None), (52, ""), (None, prose(1, 9)), (3, prose(2003, 21))]
    rows = [(k, prose(k, 50 + k)) for k in range(30)]
    for k in range(12):
        rows.append((100 + k, f"{prose(k, 20)} {items[k][1].upper()}! {prose(k + 1, 9)}"))
    rows.append((200, " ".join(items[11][1].split()[:-4])))  # most of an item
    rows.append((201, " ".join(items[11][1].split()[: len(items[11][1].split()) // 2])))  # half of it
    rows += [(300, "A short, ONE here"), (301, None), (302, ""), (None, items[0][1]), (303, items[0][1]), (303, "nothing")]
    got = {r.doc_id: r for r in contaminated(with_clashes(spark.createDataFrame(rows, DOC)), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(not got[k].contaminated and got[k].items == [] for k in range(30))
    assert all(got[100 + k].items == [k] and got[100 + k].similarity == pytest.approx(1.0) for k in range(12))
    assert not got[201].contaminated and got[300].items == [50] and got[303].items == [0]
    assert not got[None].contaminated and not got[301].contaminated and not got[302].contaminated


def test_contamination_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], DOC), spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in contaminated(docs, none).collect()] == [False]
    assert contaminated(spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).collect() == []


def brute_contamination(rows, items, width: int = 5, least: float = 0.8):
    """doc_id: (items, similarity) of every window against every item, without hashes or indexes."""

    def words(text):
        return re.findall(r"[^\W_]+", (text or "").lower())

    def shingles(w, k):
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    texts = {tuple(words(t)) for i, t in items if i is not None} - {()}
    sets = {t: shingles(t, min(width, len(t))) for t in texts}
    held = Counter(s for found in sets.values() for s in found)
    rarity = {s: 1 + math.log((len(texts) + 1) / (1 + n)) for s, n in held.items()}
    other = 1 + math.log((len(texts) + 1) / 2)
    out = {}
    for unique, text in rows:
        w, hits = words(text), out.setdefault(unique, {})
        for t, own in sets.items():
            n = min(len(t), len(w))
            for start in range(len(w) - n + 1):
                window = shingles(w[start : start + n], min(width, len(t)))
                for weight in (lambda s: 1, lambda s: rarity.get(s, other)):
                    shared = sum(weight(s) * k for s, k in (window & own).items())
                    total = sum(weight(s) * k for s, k in (window | own).items())
                    if shared >= (least - 1e-9) * total:
                        hits[t] = max(hits.get(t, 0), shared / total)
    found = {}
    for unique, hits in out.items():
        ids = sorted({i for i, t in items if i is not None and tuple(words(t)) in hits})
        found[unique] = (ids, pytest.approx(max(hits.values())) if hits else None)
    return found


def judged(spark, rows, items):
    got = contaminated(spark.createDataFrame(rows, DOC), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == sorted(u for u, _ in rows)
    assert all(r.contaminated == bool(r.items) for r in got)
    return {r.doc_id: (r.items, r.similarity) for r in got}


def test_contamination_of_shortened_and_edited_items(spark):
    items = [(k, prose(2000 + k, 6 + 4 * k)) for k in range(12)] + [(50, "short one"), (60, "a b c a b c a b c a b c a b c a b c a b c")]
    rows = []
    for k in range(12):
        w = items[k][1].split()
        for at, cut_words in enumerate([w[:-1], w[1:], w[2:-2], w[: len(w) // 2], w[:-4], w[4:], w[len(w) // 2 :] + w[: len(w) // 2], w[:3] + ["x"] + w[3:], w[:7] + w[8:]]):
            rows.append((1000 + 20 * k + at, " ".join(cut_words)))  # the row is shorter than the item, or about as long
            rows.append((2000 + 20 * k + at, f"{prose(k, 30)} {' '.join(cut_words)}"))
            rows.append((3000 + 20 * k + at, f"{' '.join(cut_words)} {prose(k, 30)}"))
        rows += [(4000 + 10 * k + e, f"{prose(k, 15)} {edited(items[k][1], 10 * k + e, 0.03)} {prose(k + 1, 15)}") for e in range(5)]
    rows += [(200, " ".join(items[11][1].split()[:-4])), (300, "short"), (301, "a b c a b c a b c a b c a b c a b c"), (302, "b c a b c")]
    got, wanted = judged(spark, rows, items), brute_contamination(rows, items)
    assert got == wanted
    assert got[200][0] == [11] and sum(bool(found) for found, _ in got.values()) > 100


def test_contamination_of_repeated_ids(spark):
    items = [(k, prose(2000 + k, 40)) for k in range(4)]
    rows = [(1, items[0][1]), (1, items[0][1]), (2, items[1][1]), (2, prose(9, 200)), (2, f"{prose(8, 3)} {items[2][1]}"), (3, prose(7, 60)), (3, prose(7, 60))]
    got = judged(spark, rows, items)
    assert got[1] == ([0], pytest.approx(1.0)) and got[2] == ([1, 2], pytest.approx(1.0)) and got[3] == ([], None)


def test_contamination_of_edited_items_that_share_texts(spark):
    """One changed word in an item, where a third of the items have one text and others share a template."""
    shared, template = prose(2500, 64), prose(2600, 58)
    items = [(k, shared) for k in range(40)] + [(100 + k, f"{template} {prose(2700 + k, 6)}") for k in range(30)] + [(200 + k, prose(2800 + k, 50)) for k in range(30)]
    rows = []
    for k, text in enumerate([shared, items[45][1], items[80][1]]):
        for at in (0, 10, 30):
            w = text.split()
            rows.append((100 * k + at, " ".join([*w[:at], "changed", *w[at + 1 :]])))
    rows.append((99, f"{template} {prose(1, 6)}"))
    got = judged(spark, rows, items)
    assert got == brute_contamination(rows, items)
    assert all(found for u, (found, _) in got.items() if u != 99) and got[10][0] == list(range(40))


def test_pipeline_with_repeated_and_null_ids(spark, tmp_path):
    import corpus_pipeline

    item, texts = prose(5000, 50), [prose(5100 + k, 80) for k in range(9)]
    rows = [(k, texts[k]) for k in range(9)]
    rows += [(0, texts[0]), (None, texts[1]), (None, texts[1]), (2, prose(5200, 70)), (2, prose(5201, 70)), (8, texts[7])]
    rows += [(None, prose(5300, 60)), (None, prose(5300, 60)), (None, f"{prose(5301, 20)} {item}"), (4, f"{prose(5302, 20)} {item} {prose(5303, 9)}"), (7, None), (None, "")]
    docs = spark.createDataFrame([(u, t, "en", f"s{k % 2}", len(t or "")) for k, (u, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    near = corpus_pipeline.near_dedup(spark, docs, folder)
    wanted = [(k, texts[k]) for k in range(9)] + [(2, prose(5200, 70)), (2, prose(5201, 70)), (None, prose(5300, 60)), *rows[-4:]]
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in near.collect()), key=order) == sorted(wanted, key=order)
    clean = corpus_pipeline.decontamination(spark, near, folder).collect()
    assert sorted(((r.doc_id, r.text) for r in clean), key=order) == sorted((r for r in wanted if item not in (r[1] or "")), key=order)
    got = {(r.doc_id, r.text) for r in corpus_pipeline.run(spark, folder).collect()}
    assert {r for r in wanted if r[1] and item not in r[1]} <= got and not any(item in (t or "") for _, t in got)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Empty tables, and every stage on null, empty and blank texts, a very long one and further columns."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    for name, kind in (("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n", "en", "a", 2), (4, prose(6000, 20_000), "en", None, 9), (None, prose(6001, 60), None, "b", 9), (5, prose(6001, 60), "en", "b", 9)]
    odd = spark.createDataFrame(rows, schema)
    for name in ("row_key", "n", "kept", "block", "weight", "label", "spans"):
        odd = odd.withColumn(name, F.lit(1))
    key = lambda x: (x.doc_id is None, x.doc_id or 0)
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = sorted(stage(spark, odd, str(tmp_path)).collect(), key=key)
        want = [1, 2, 3, 4, 5] if name == "minhash near-dedup" else [1, 2, 3, 4, 5, None]
        assert [x.doc_id for x in got] == want, name
    mixed = corpus_pipeline.mixing(spark, odd, str(tmp_path)).select("doc_id", "text").collect()
    assert {x.doc_id for x in mixed} >= {1, 2, 3}  # those without words cost nothing


# --- mixing ---------------------------------------------------------------------------------------

MIX = "doc_id long, text string, source string"


def mixed_documents():
    return [(k, "w " * (1 + k % 17), "hot" if k % 3 == 0 else f"s{k % 5}") for k in range(600)]


def exponent_of(tokens, p):
    total = sum(tokens)
    return find_exponent(sums_of([t / total for t in tokens]), len(tokens), min(tokens) / total, 1.0 if p.budget is None else p.budget / total, p)


def test_exponent_meets_entropy_and_repeats():
    tokens = [10_000, 500, 300, 20]
    shares = [t / sum(tokens) for t in tokens]
    p = MixParams(entropy=0.6, repeats=None)
    assert entropy(tempered(shares, exponent_of(tokens, p))) == pytest.approx(0.6 * 1.3862943611198906, abs=1e-6)
    q = MixParams(entropy=1.0, repeats=3.0)
    weights = tempered(shares, exponent_of(tokens, q))
    assert max(w * sum(tokens) / t for w, t in zip(weights, tokens, strict=True)) == pytest.approx(3.0, abs=1e-6)
    assert exponent_of([5, 5], MixParams()) == 1.0
    assert exponent_of(tokens, MixParams(entropy=None, repeats=None)) == 1.0


def plain_exponent(tokens, p):
    """Halving, one exponent at a time."""
    total = sum(tokens)
    shares = [t / total for t in tokens]
    budget = total if p.budget is None else p.budget
    wide = lambda a: p.entropy is None or entropy(tempered(shares, a)) >= p.entropy * math.log(len(shares)) - 1e-12
    few = lambda a: p.repeats is None or all(w * budget <= p.repeats * t * (1 + 1e-12) for w, t in zip(tempered(shares, a), tokens, strict=True))

    def search(ok, rising):
        low, high = 0.0, 1.0
        if ok(high) and not rising:
            return high
        for _ in range(50):
            middle = (low + high) / 2
            if ok(middle) != rising:
                low = middle
            else:
                high = middle
        return high if rising else low

    found = search(wide, False)
    return found if few(found) else max(found, search(few, True))


def brute_mix(spark, rows, p):
    """doc_id and epoch of every row of the mixture, by loops; only the hashes come from Spark."""
    words = {u: len(t.split()) for u, t, _ in rows}
    sources = sorted({x for *_, x in rows})
    tokens = {x: sum(words[u] for u, _, y in rows if y == x) for x in sources}
    total = sum(tokens.values())
    budget = total if p.budget is None else p.budget
    weights = dict(zip(sources, tempered([tokens[x] / total for x in sources], plain_exponent([tokens[x] for x in sources], p)), strict=True))
    ids = spark.createDataFrame([(u,) for u in words], "doc_id long")
    deal = {r.doc_id: (r.a, r.b) for r in ids.selectExpr("doc_id", f"xxhash64(doc_id, {p.seed}L) a", f"xxhash64({p.seed + 1}L, doc_id) b").collect()}
    out = []
    for x in sources:
        own = [u for u, _, y in rows if y == x]
        quota = int(weights[x] * budget + 1e-6)
        passes, rest = divmod(quota, tokens[x])
        blocks = max(1, math.ceil(math.sqrt(len(own) / p.block_docs)))
        block = {u: deal[u][0] % blocks for u in own}
        out += [(u, e) for u in own for e in range(passes)]
        keys = spark.createDataFrame([(f"={x}", k) for k in range(blocks)], "_key string, block long")
        order = [r.block for r in keys.selectExpr("block", f"xxhash64({p.seed}L, {passes}L, _key, block) h").orderBy("h", "block").collect()]
        for k in order:
            members = sorted((u for u in own if block[u] == k), key=lambda u: (deal[u][1], u))
            for u in members:
                if sum(words[m] for m in members) <= rest or words[u] <= rest:
                    out.append((u, passes))
                    rest -= words[u]
                else:
                    rest = 0
                    break
            if rest <= 0:
                break
    return sorted(out)


@pytest.mark.parametrize("p", [MixParams(entropy=0.999, block_docs=8), MixParams(entropy=0.7, block_docs=2, budget=3000), MixParams(entropy=1.0, repeats=1.5, block_docs=1), MixParams(entropy=None, repeats=None, budget=20_000, block_docs=3)])
def test_mix_matches_brute_force(spark, p):
    rows = mixed_documents()
    got = mix(spark.createDataFrame(rows, MIX), p).collect()
    assert sorted((r.doc_id, r.epoch) for r in got) == brute_mix(spark, rows, p)


def test_mix_realises_the_weights(spark):
    rows = mixed_documents()
    got = mix(spark.createDataFrame(rows, MIX), MixParams(entropy=0.999, block_docs=8)).collect()
    available, taken = Counter(), Counter()
    for _, text, source in rows:
        available[source] += len(text.split())
    total = sum(available.values())
    weight = {r.source: r.weight for r in got}
    for r in got:
        taken[r.source] += r.n_tokens
    assert sum(weight.values()) == pytest.approx(1.0)
    for s in available:
        assert 0 <= weight[s] * total - taken[s] <= 17  # less than one document short of its quota
    once = Counter((r.doc_id, r.epoch) for r in got)
    assert max(once.values()) == 1
    epochs = Counter(r.doc_id for r in got)
    for s in available:  # every document is passed floor or ceil times
        passes = weight[s] * total / available[s]
        assert all(int(passes) <= epochs[u] <= int(passes) + 1 for u, _, x in rows if x == s)


def test_mix_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (3, "x y", None), (None, "z", "b"), (4, "w " * 30_000, "c")]
    docs = spark.createDataFrame(rows, MIX).withColumn("block", F.lit(1)).withColumn("weight", F.lit(2)).withColumn("rest", F.lit(3))
    got = mix(docs, MixParams(entropy=None, repeats=None)).collect()
    assert sorted((r.doc_id or 0, r.source or "", r.n_tokens) for r in got) == [(0, "b", 1), (1, "a", 0), (2, "a", 0), (3, "", 2), (3, "", 2), (4, "c", 30_000)]
    assert mix(spark.createDataFrame([], MIX)).collect() == []


# --- quality, language, tokens --------------------------------------------------------------------


def test_quality_separates_classes(spark):
    good = [(k, ". ".join(prose(k * 9 + j, 9).capitalize() for j in range(5))) for k in range(200)]
    bad = [(1000 + k, ("!! ".join(prose(k, 40).upper().split()) if k % 2 else "spam " * 60)) for k in range(80)]
    labels = [(u, 1) for u, _ in good] + [(u, 0) for u, _ in bad] + [(5, None), (77777, 1), (6, 7)]
    docs = spark.createDataFrame(good + bad + odd_documents(), DOC)
    got = score_quality(with_clashes(docs), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(good) + len(bad) + len(odd_documents())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 1100 and r.doc_id not in range(900, 908)]
    assert len(held) > 30 and all(r.predicted == int(r.doc_id < 900) for r in held)


def test_quality_matches_brute_force(spark):
    """Class means, shrunk covariances and densities from their definitions, with inverse matrices instead of factors."""
    import numpy as np
    import zlib

    from weftline.llm.quality import QualityParams, statistics

    r, p = random.Random(12), QualityParams()
    rows = [(k, " ".join(r.choice(["Word", "and", "12", "go!", "aa", "the"]) for _ in range(r.randrange(0, 60)))) for k in range(160)] + [(200, None), (201, "x" * 5000)]
    labels = [(k, int(r.random() < 0.7)) for k in range(160)]
    got = {x.doc_id: x for x in score_quality(spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    x = {k: np.array(statistics(t.encode() if t is not None else None)) for k, t in rows}
    own = [np.array([x[k] for k, q in labels if q == c and not held(k)]) for c in (0, 1)]
    covs = [np.cov(o.T, bias=True) for o in own]
    pooled = sum(len(o) * c for o, c in zip(own, covs, strict=True)) / sum(map(len, own))
    scale = np.sqrt(np.diag(pooled) + 1e-9)
    shrunk = []
    for c in covs:
        c = ((1 - p.pooled) * c + p.pooled * pooled) / np.outer(scale, scale)
        shrunk.append(((1 - p.ridge) * c + p.ridge * np.trace(c) / len(c) * np.eye(len(c))) * np.outer(scale, scale))
    odds = min(p.odds, max(1 / p.odds, (len(own[1]) + 1) / (len(own[0]) + 1)))
    for k, v in x.items():
        density = [-0.5 * (v - o.mean(axis=0)) @ np.linalg.inv(c) @ (v - o.mean(axis=0)) - 0.5 * np.linalg.slogdet(c)[1] for o, c in zip(own, shrunk, strict=True)]
        want = 1 / (1 + math.exp(-(density[1] - density[0] + math.log(odds))))
        assert got[k].score == pytest.approx(want, abs=1e-7) and got[k].held_out == held(k) and got[k].predicted == int(got[k].score >= 0.3)


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = score_quality(spark.createDataFrame([(1, "a"), (2, None)], DOC), none).collect()
    assert [r.score for r in got] == [0.5, 0.5]
    assert score_quality(spark.createDataFrame([], DOC), none).collect() == []


LANG = LangParams(public_tokenizers.path("piece_bpe_32k.model"), docs_per_lang=50)


def test_language_held_out(spark):
    english = "the of and to in that was with for this from which have been their would about there other".split()
    german = "der die und das nicht eine werden auch sich mit auf ist dem wird für einem durch haben können".split()
    r = random.Random(1)
    rows = [(k, " ".join(r.choice(english if k % 2 else german) for _ in range(30)), "en" if k % 2 else "de") for k in range(120)]
    rows += [(500, None, "en"), (501, "", "de"), (502, "123 --- 4", None), (503, "the and of that", None), (None, "der die das", "de")]
    rows += [(504, "½ ² ³", "en"), (505, "which have been " * 20_000, None), (506, "whichtheirwould" * 400, None), (507, "eine werden auch", None), (507, "eine werden auch", None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("score", "n", "nth", "rank", "word", "chance", "reach", "held_out"):
        odd = odd.withColumn(name, F.lit("x"))
    got = identify(odd, LANG).collect()
    by = {x.doc_id: x for x in got}
    assert all(by[u].lang_pred == lang for u, _, lang in rows[:120])
    assert [by[u].lang_pred for u in (500, 501, 502, 504)] == ["und"] * 4 and by[504].score == 0.0 and by[505].lang_pred == by[506].lang_pred == "en"
    assert [x.lang_pred for x in got if x.doc_id == 507] == ["de", "de"]
    assert by[503].lang_pred == "en" and by[None].lang_pred == "de"
    assert any(x.held_out for x in got) and all(0 <= x.score <= 1 for x in got) and not by[None].held_out


def test_language_without_training(spark):
    got = identify(spark.createDataFrame([(1, "hello", None)], "doc_id long, text string, lang string"), LANG).collect()
    assert got[0].lang_pred == "und"
    assert identify(spark.createDataFrame([], "doc_id long, text string, lang string"), LANG).collect() == []


def plain_forward(word, chance, longest, unknown):
    """Log of the sum over all segmentations, with exact fractions of two to the power of scale left out: plain Python."""
    from fractions import Fraction

    marked, sums = "▁" + word, [Fraction(1)]
    for end in range(1, len(marked) + 1):
        total = Fraction(0)
        for n in range(1, min(longest, end) + 1):
            piece = marked[end - n : end]
            total += sums[end - n] * Fraction(chance.get(piece, unknown if n == 1 else 0))
        sums.append(total)
    return math.log(sums[-1].numerator) - math.log(sums[-1].denominator)


def own_pieces(texts):
    import numpy as np

    from weftline.llm.common import MULTIPLIER, mix as mixed
    from weftline.llm.lang_id import Pieces

    hashes = []
    for t in texts:
        h = 0
        for c in t:
            h = (h * MULTIPLIER + ord(c)) % (1 << 64)
        hashes.append(h)
    own = mixed(np.array(hashes, np.uint64))
    pieces = Pieces(own, max(map(len, texts)))
    return pieces, {t: int(np.searchsorted(pieces.hashes, h)) for t, h in zip(texts, own, strict=True)}


def test_word_probability_sums_all_segmentations():
    import numpy as np

    from weftline.llm.lang_id import Lattice

    texts = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "bab"]
    pieces, at = own_pieces(texts)
    chance, p = np.zeros((len(texts) + 1, 2)), {}
    for k, t in enumerate(texts):
        p[t] = 0.05 * (k + 1) / 2
        chance[at[t]] = p[t], 0.01
    r = random.Random(2)
    words = ["ab", "a", "xyz", "".join(r.choice("ab") for _ in range(500)), "".join(r.choice("abx") for _ in range(777))]
    got = Lattice(words, pieces).log_chance(chance, 1e-7, 24)
    for k, w in enumerate(words):
        assert got[k, 0] == pytest.approx(plain_forward(w, p, 4, 1e-7))
        assert got[k, 1] == pytest.approx(plain_forward(w, dict.fromkeys(texts, 0.01), 4, 1e-7))


def test_expected_pieces_match_all_segmentations():
    import numpy as np

    from weftline.llm.lang_id import Lattice

    texts = ["▁", "▁a", "a", "b", "ab", "▁ab"]
    pieces, at = own_pieces(texts)
    chance = np.zeros(len(texts) + 1)
    p = {t: 0.05 * (k + 1) for k, t in enumerate(texts)}
    for t in texts:
        chance[at[t]] = p[t]
    ways = [["▁ab"], ["▁a", "b"], ["▁", "ab"], ["▁", "a", "b"]]
    total = sum(math.prod(p[x] for x in way) for way in ways)
    got = Lattice(["ab", "b"], pieces).expected(chance, 1e-7, np.array([3.0, 0.0]))
    for t in texts:
        assert got[at[t]] == pytest.approx(3 * sum(way.count(t) * math.prod(p[x] for x in way) for way in ways) / total)
    long = Lattice(["ab" * 600], pieces).expected(chance, 1e-7, np.array([1.0]))  # no underflow
    assert long.sum() > 600 and np.isfinite(long).all()


TOKENIZERS = ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"]


@pytest.mark.parametrize("name", TOKENIZERS)
def test_token_counts_match_the_library(spark, name):
    path = public_tokenizers.path(name)
    texts = [prose(k, 40) for k in range(20)] + ["Don't stop, it's 3.14!", "É é É, «ñ» x\u0301y", "<|endoftext|> a<|ENDOFTEXT|>b <|endoftext|>,", "\u00a0a\u2003b ", "Σας ΟΔΟΣ.", "a.b,c!!! ???x", "e\u0301, n\u0303.", "İ% İ;"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100, None), (101, ""), (102, prose(5, 30_000)), (103, "東京" * 20_000), (None, "x y"), (0, texts[0])]
    got = count_tokens(with_clashes(spark.createDataFrame(rows, DOC)), TokenCountParams(path, piece_bytes=4096, batch_bytes=10_000)).collect()
    library = encoder(path)
    wanted = sorted((u or -1, len((t or "").encode()), library([t or ""])[0]) for u, t in rows)
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == wanted
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert count_tokens(spark.createDataFrame([], DOC), TokenCountParams(path)).collect() == []


@pytest.mark.parametrize("name", TOKENIZERS)
def test_token_counts_of_cut_texts(name):
    """Random texts over an alphabet of marks, cases, digits, spaces and other scripts, cut into tiny pieces."""
    path, r = public_tokenizers.path(name), random.Random(11)
    alphabet = list("abzABZ019  '.,!%;-_<|>\n\tİıßéÉΣσςЖ½²³東ก\u0301\u0307\u00a0") + ["'s", "'LL", "<|endoftext|>", "the ", " a b ", "  "]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 60))) for _ in range(20_000)]
    cut_texts = [[x.decode() for x in pieces(t.encode(), 5, path.endswith(".model"))] for t in texts]
    library = encoder(path)
    sizes = iter(library([x for parts in cut_texts for x in parts]))
    assert [sum(next(sizes) for _ in parts) for parts in cut_texts] == library(texts)
    assert sum(len(x) > 1 for x in cut_texts) > 2000


def test_token_counts_without_normalisation():
    """Plain texts leave out the normalisation of the library, with its counts for every character up to U+0250 and for all that isn't plain."""
    import tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    signs = [chr(c) for c in range(0x300)]
    texts = ["".join(signs[:0x250]), "".join(f"a{c}B {c}x" for c in signs[:0x250]), *(f"Da{c}E'S {c}{c} 1{c}2" for c in signs)]
    texts += ["", " ", "A\u00a0B\t\tC\u0085d\x1ce", "<|startoftext|>", "x<|STARTOFTEXT|>y", "<|EndOfText|> I'M <|endoftext|>", "e\u0301 \u00c9T\u00c9", "\u03a3\u03a3 \u0130\u0049", "\u4e2d\u6587 Text"]
    assert encoder(path)(texts) == [len(library.encode(x, add_special_tokens=False)) for x in texts]
    assert _plain_specials(json.loads(library.to_str())) == ["<|startoftext|>", "<|endoftext|>"]
