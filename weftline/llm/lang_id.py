"""Language of a text by unigram models over pieces, summed over all ways to cut each word.

The pieces come from a public vocabulary. A language gives each piece a probability; a word's
probability is the sum over all its segmentations of the product of their pieces, computed by the
forward recursion. Words are runs of letters of any length, pieces never reach over their ends, so a
text's probability is the product over its words, and each distinct word is summed once for all languages.
The piece probabilities are learned by expectation maximisation over a bounded sample of labelled
documents, one language to a task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import MULTIPLIER, groups, mix
from weftline.llm.quality import held_out

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters, in order. ``_WORD`` also takes signs like a half or a raised two, which end a word here."""
    found = _WORD.findall((text or "").lower())
    if not found or "".join(found).isalpha():
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


@dataclass(frozen=True)
class LangParams:
    """vocabulary: a .model of sentencepiece, read on the driver. docs_per_lang: labelled documents that
    a language learns from, those with the smallest hashes; all their words count. piece: longest piece in
    characters, with the mark of a word's beginning. block: characters of a word after which its forward
    sums are scaled anew. prior: pieces added to each language, spread evenly. unknown: probability of a
    character without a piece. memo: words kept by a worker."""

    vocabulary: str
    docs_per_lang: int = 1500
    rounds: int = 4
    piece: int = 9
    block: int = 24
    prior: float = 300.0
    unknown: float = 1e-7
    memo: int = 400_000


@dataclass
class Pieces:
    """Finds pieces by a 64-bit hash of their characters, in arrays."""

    hashes: np.ndarray
    longest: int
    table: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.hashes = np.sort(self.hashes)
        self.table = np.searchsorted(self.hashes, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 if there is none. Few pieces share the first 16 bits."""
        at = self.table[(hashes >> np.uint64(48)).astype(np.int64)]
        out = np.full(len(hashes), -1)
        going = np.arange(len(hashes))
        while len(going):
            inside = at[going] < len(self.hashes)
            going = going[inside]
            value, wanted = self.hashes[at[going]], hashes[going]
            out[going[value == wanted]] = at[going[value == wanted]]
            going = going[value < wanted]
            at[going] += 1
        return out


def load_pieces(p: LangParams) -> Pieces:
    """Lower-case pieces of letters, with or without the mark of a word's beginning."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=p.vocabulary)
    texts = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    texts = {t for t in texts if len(t) <= p.piece and t != "▁" and t.removeprefix("▁").isalpha()}
    hashes = []
    for text in texts:
        h = 0
        for c in text:
            h = (h * MULTIPLIER + ord(c)) % (1 << 64)
        hashes.append(h)
    return Pieces(mix(np.array(hashes, np.uint64)), p.piece)


class Lattice:
    """All pieces in a batch of words, by their length and the place where they start."""

    def __init__(self, words: list[str], pieces: Pieces):
        marked = ["▁" + w for w in words]
        self.sizes = np.array([len(w) for w in marked])
        width = int(self.sizes.max(initial=1))
        flat = np.frombuffer("".join(w.ljust(width, "\0") for w in marked).encode("utf-32-le"), np.uint32)
        chars = flat.reshape(len(words), width).astype(np.uint64)
        self.width, self.found = width, []  # found[l - 1][:, start]
        rolled = np.zeros((len(words), width), np.uint64)
        for length in range(1, min(pieces.longest, width) + 1):
            rolled = rolled[:, : width - length + 1] * np.uint64(MULTIPLIER) + chars[:, length - 1 :]
            ids = np.full(rolled.shape, -1, np.int32)
            inside = np.arange(rolled.shape[1])[None, :] + length <= self.sizes[:, None]
            ids[inside] = pieces.find(mix(rolled[inside]))
            self.found.append(ids)

    def _step(self, chance: np.ndarray, unknown: float, start: int, length: int) -> np.ndarray:
        """Chance of the piece of this length at this start, for each word (and language)."""
        ids = self.found[length - 1][:, start]
        step = chance[ids]
        if length == 1:
            step = np.where((ids < 0).reshape(-1, *[1] * (chance.ndim - 1)), unknown, step)
        return step

    def log_chance(self, chance: np.ndarray, unknown: float, block: int) -> np.ndarray:
        """Log of the summed probability of each word in each language; chance has a last row of zeros for no piece.

        Only the last sums are held, as many as a piece is long. After each block they are divided by the
        largest of them, so a word may have any length.
        """
        n, k, reach = len(self.sizes), chance.shape[1], len(self.found)
        ahead = np.zeros((reach + 1, n, k))  # a ring: the sums at end are at end % (reach + 1)
        ahead[0] = 1.0
        scale, out = np.zeros((n, k)), np.zeros((n, k))
        for end in range(1, self.width + 1):
            total = np.zeros((n, k))
            for length in range(1, min(reach, end) + 1):
                total += ahead[(end - length) % (reach + 1)] * self._step(chance, unknown, end - length, length)
            ahead[end % (reach + 1)] = total
            done = self.sizes == end
            if done.any():
                out[done] = np.log(total[done]) + scale[done]
            if end % block == 0:
                top = ahead.max(axis=0)
                top[top == 0] = 1.0  # words that have ended
                ahead /= top
                scale += np.log(top)
        return out

    def expected(self, chance: np.ndarray, unknown: float, weight: np.ndarray) -> np.ndarray:
        """Expected number of each piece over all segmentations, words weighted (one language), in logarithms."""
        n, reach = len(self.sizes), len(self.found)
        with np.errstate(divide="ignore"):
            log_p, log_unknown = np.log(chance), np.log(unknown)
        steps = [np.where(ids < 0, log_unknown if length == 0 else -np.inf, log_p[ids]) for length, ids in enumerate(self.found)]
        ahead = np.full((n, self.width + 1), -np.inf)
        ahead[:, 0] = 0.0
        for end in range(1, self.width + 1):
            ahead[:, end] = _log_sum([ahead[:, end - m] + steps[m - 1][:, end - m] for m in range(1, min(reach, end) + 1)])
        back = np.full((n, self.width + 1), -np.inf)
        rows = np.arange(n)
        for start in range(self.width, -1, -1):
            if start < self.width:
                back[:, start] = _log_sum([steps[m - 1][:, start] + back[:, start + m] for m in range(1, min(reach, self.width - start) + 1)])
            back[rows[self.sizes == start], start] = 0.0
        whole = ahead[rows, self.sizes]
        out = np.zeros(len(chance))
        for m, ids in enumerate(self.found, 1):
            share = np.exp(ahead[:, : ids.shape[1]] + steps[m - 1] + back[:, m : m + ids.shape[1]] - whole[:, None]) * weight[:, None]
            known = ids >= 0
            out += np.bincount(ids[known], share[known], len(chance))
        return out


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    stacked = np.array(terms)
    top = stacked.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(stacked - safe).sum(axis=0))


def _batches(words: list[str], most: int = 1 << 16) -> Iterator[np.ndarray]:
    """Places of the words in batches of about equal length, each of at most ``most`` characters with its padding."""
    order = np.argsort([len(w) for w in words], kind="stable")
    start = 0
    for k in range(1, len(order) + 1):
        if k == len(order) or (k - start + 1) * (len(words[order[k]]) + 1) > most:
            yield order[start:k]
            start = k


@dataclass
class LangModel:
    langs: list[str]
    pieces: Pieces
    chance: np.ndarray
    p: LangParams

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.zeros((len(words), len(self.langs)))
        for some in _batches(words):
            out[some] = Lattice([words[i] for i in some], self.pieces).log_chance(self.chance, self.p.unknown, self.p.block)
        return out


def learn_pieces(words: list[str], counts: np.ndarray, pieces: Pieces, p: LangParams) -> np.ndarray:
    """Piece probabilities of a language from its words and how often each was seen, by expectation maximisation."""
    size = len(pieces.hashes)
    lattices = [(Lattice([words[i] for i in some], pieces), counts[some]) for some in _batches(words)]
    now = np.append(np.full(size, 1 / size), 0.0)
    for _ in range(p.rounds):
        seen = sum(x.expected(now, p.unknown, w) for x, w in lattices)
        now = (seen + p.prior / size) / (seen.sum() + p.prior)
        now[-1] = 0.0
    return now


def sampled(docs: DataFrame, p: LangParams) -> DataFrame:
    """lang, text of at most docs_per_lang rows of each language, those with the smallest hashes of doc_id.

    A first cut by the hash leaves little more than that, so no task gets all rows of a language.
    """
    known = docs.where("lang is not null and doc_id is not null").select("doc_id", "text", "lang").withColumn("nth", F.expr("pmod(xxhash64(doc_id), 2147483648L)"))
    most = p.docs_per_lang + 4 * p.docs_per_lang**0.5 + 20
    shares = known.groupBy("lang").agg((F.lit(most) / F.count("*") * 2147483648).cast("long").alias("reach"))
    low = known.join(F.broadcast(shares), "lang").where("nth <= reach")  # a row for each language: as many as the model has
    by_hash = W.partitionBy("lang").orderBy("nth", "doc_id", "text")
    return low.withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= p.docs_per_lang).select("lang", "text")


def train(docs: DataFrame, p: LangParams) -> LangModel:
    """From rows (doc_id, text, lang): word counts of the bounded sample, and one task for each language that learns it."""
    pieces = load_pieces(p)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[tuple[str, str]] = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.update((lang, w) for w in words_of(text))
            columns = [pa.array(x, pa.string()) for x in (zip(*found, strict=True) if found else ([], []))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found.values(), pa.int64())], names=["lang", "word", "n"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in groups(batches, ["lang"]):
            chance = learn_pieces(own.column("word").to_pylist(), own.column("n").to_numpy().astype(float), pieces, p)
            yield pa.RecordBatch.from_arrays([own.column("lang")[:1].combine_chunks(), pa.array([chance.tobytes()], pa.binary())], names=["lang", "chance"])

    counts = sampled(docs, p).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    dealt = counts.repartition("lang").sortWithinPartitions("lang", "word")
    found = sorted((r["lang"], r["chance"]) for r in dealt.mapInArrow(learn, "lang string, chance binary").collect())  # a row for each language
    chance = np.array([np.frombuffer(x, float) for _, x in found]).T if found else np.zeros((len(pieces.hashes) + 1, 0))
    return LangModel([lang for lang, _ in found], pieces, chance, p)


def predict(docs: DataFrame, model: LangModel) -> DataFrame:
    """doc_id, lang_pred, score of each whole text; score is the posterior of lang_pred under even priors."""
    p = model.p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        scores = np.zeros((0, len(model.langs)))
        for batch in batches:
            langs: list[str] = []
            out: list[float] = []
            texts = batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                held, weight = [], 0  # about a megabyte of text at a time
                while at < len(texts) and weight < 1 << 20:
                    held.append(words_of(texts[at]))
                    weight += len(texts[at] or "")
                    at += 1
                new = {w for words in held for w in words}.difference(memo)
                if len(memo) + len(new) > p.memo:
                    memo, scores = {}, scores[:0]
                    new = {w for words in held for w in words}
                fresh = list(new)
                memo.update(zip(fresh, range(len(scores), len(scores) + len(fresh)), strict=True))
                scores = np.concatenate([scores, model.word_scores(fresh)])
                for words in held:
                    if not words or not model.langs:
                        langs.append("und")
                        out.append(0.0)
                        continue
                    total = scores[np.fromiter(map(memo.__getitem__, words), np.int64, len(words))].sum(axis=0)
                    best = int(total.argmax())
                    langs.append(model.langs[best])
                    out.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(langs, pa.string()), pa.array(out, pa.float64())], names=["doc_id", "lang_pred", "score"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, p: LangParams) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Learns from text and lang of the documents that aren't held out (crc32 of doc_id modulo 4 is 2)
    and have a lang and a doc_id. lang_pred is ``und`` with score 0 if the text is null or has no letter, or
    if there is nothing to learn from. Of equally likely languages the first in order of name wins.
    Texts and words of any length are scored whole; a language without words in its sample gives every piece
    the same probability. Repeated rows give repeated results; other columns are not read.
    """
    out = held_out(F.col("doc_id"), 4, 2)
    model = train(docs.where(~out), p)
    return predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
