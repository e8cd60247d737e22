"""Token counts of whole texts with a public tokenizer, encoded in batches inside Arrow functions.

Only lengths leave the workers. Texts are gathered into batches of about equal bytes and a batch is
encoded at once. A long text is cut into pieces first, only in front of a single space between two
ASCII letters or digits: there the tokenizers of both libraries always end a token, and no
normalisation, contraction or special token reaches over it. Sentencepiece puts that space in front of
each text itself, so for it the space is dropped.

A quarter of the library's time can go into normalisation, which keeps the place of every character. Texts without
characters from U+0250 on need none where it is only NFC, white space and lower case, and only lengths are asked for.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.common import as_bytes


@dataclass(frozen=True)
class TokenCountParams:
    """path: a .json of tokenizers or a .model of sentencepiece, as every executor sees it. limit: tokens
    up to which a text isn't over the limit. batch_bytes: text encoded at once. piece_bytes: a text longer
    than this is cut at the next safe place after so many bytes."""

    path: str
    limit: int = 2048
    batch_bytes: int = 1 << 19
    piece_bytes: int = 1 << 16


_SAFE_CUT = re.compile(rb"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


#: Below it no character changes under NFC, and each one has the lower case of the library in Python too.
_FAR = re.compile("[^\x00-\u024f]")

#: Words, digits and runs of other signs, none of which holds white space; the rest is dropped.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _plain_specials(made: dict) -> list[str] | None:
    """The special tokens in lower case if the tokenizer normalises by NFC, white space to one space and lower case, and white space is
    in no token; else None. A text that holds one of them in any case isn't plain."""
    steps = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    split = {"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True}
    if (made["normalizer"] or {}).get("normalizers") != steps or ((made["pre_tokenizer"] or {}).get("pretokenizers") or [None])[0] != split:
        return None
    return [t["content"].lower() for t in made["added_tokens"]]


def encoder(path: str) -> Callable[[list[str]], list[int]]:
    """Texts to numbers of tokens, without begin, end or other added special tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import tokenizers

    tokenizer = tokenizers.Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    count = lambda t, texts: [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)]
    specials = _plain_specials(made := json.loads(tokenizer.to_str()))
    if specials is None:
        return lambda texts: count(tokenizer, texts)
    plain = tokenizers.Tokenizer.from_str(json.dumps(made | {"normalizer": None}))

    def run(texts: list[str]) -> list[int]:
        lower = [None if _FAR.search(x) or any(s in x.lower() for s in specials) else x.lower() for x in texts]
        totals = [0] * len(texts)
        for t, rows in ((plain, [k for k, x in enumerate(lower) if x is not None]), (tokenizer, [k for k, x in enumerate(lower) if x is None])):
            for k, n in zip(rows, count(t, [lower[k] if t is plain else texts[k] for k in rows]), strict=True):
                totals[k] = n
        return totals

    return run


def pieces(text: bytes, most: int, drop: bool = False) -> Iterator[bytes]:
    """The text in order, cut at the first safe place after each ``most`` bytes; the space there begins the next piece or is dropped."""
    start = 0
    while len(text) - start > most and (found := _SAFE_CUT.search(text, start + most)):
        yield text[start : found.start()]
        start = found.end() if drop else found.start()
    yield text[start:]


def count_tokens(docs: DataFrame, p: TokenCountParams) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    A null text counts as empty: no bytes, no tokens. A long text without a safe place is encoded whole. A
    null doc_id stays null; repeated rows give repeated results; other columns are not read. An empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(p.path)
        drop = p.path.endswith(".model")
        for batch in batches:
            sizes, totals = [0] * batch.num_rows, [0] * batch.num_rows
            held: list[tuple[int, str]] = []
            weight = 0

            def flush() -> None:
                for (row, _), n in zip(held, encode([piece for _, piece in held]), strict=True):
                    totals[row] += n
                held.clear()

            for row, text in enumerate(as_bytes(batch.column("text"))):
                sizes[row] = len(text or b"")
                for piece in pieces(text or b"", p.piece_bytes, drop):
                    held.append((row, piece.decode()))
                    weight += len(piece)
                    if weight >= p.batch_bytes:
                        flush()
                        weight = 0
            flush()
            over = [n > p.limit for n in totals]
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array(over, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
