"""Token counts by a given tokenizer file: lengths only, texts in Arrow batches.

Texts are split at safe boundaries: before a space that follows a visible character, where the
byte-level pre-tokeniser always ends a piece and no special token can be cut. The pieces of a batch
that this worker has not met are encoded together, in lists of about ``batch_bytes`` bytes, and only
their lengths are kept; a long text never reaches the tokenizer whole unless it has no such boundary. What a worker
keeps is bounded in bytes, and pieces of more than ``LONG_PIECE`` bytes (text without blanks) are not kept.

Results in special cases: a NULL text counts as empty, with 0 bytes and 0 tokens; strings of special
tokens inside a text are read as the library does by default; repeated rows each get a row; an empty
table gives an empty result; input columns named like a result are replaced.
"""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shelfwatch.llm.common import map_batches, without

LIMIT = 512
BATCH_BYTES = 1 << 18
CACHE_BYTES = 1 << 26  # of pieces, each with the bytes of its place in the table
LONG_PIECE, PLACE_BYTES = 64, 128
RESULTS = ["n_bytes", "n_tokens", "over_limit"]

# White space in any engine's reading, and invisible characters; a space after anything else is a safe boundary.
_BLANK = r"\s\x00-\x20\x7f-\xa0 ᠎ -‏ -  -⁤　﻿"
_SAFE = re.compile(rf"(?<=[^{_BLANK}])(?= )")
_UNSAFE_SPACE = re.compile(rf"[{_BLANK}] ")


def pieces_of(text: str) -> list[str]:
    """Parts that add up to ``text`` and can be encoded one by one."""
    if text.startswith(" ") or _UNSAFE_SPACE.search(text):
        return _SAFE.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + w for w in rest]]


def bytes_of(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


class Counter:
    """Piece lengths of one worker process; forgotten when they take too many bytes."""

    def __init__(self, path: str, batch_bytes: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.batch_bytes, self.lengths, self.kept_bytes = Tokenizer.from_file(path), batch_bytes, {}, 0

    def counts(self, texts: list[str]) -> list[int]:
        split = [pieces_of(t) for t in texts]
        if self.kept_bytes > CACHE_BYTES:
            self.lengths.clear()
            self.kept_bytes = 0
        held: list[str] = []
        once: list[str] = []
        size = 0
        for piece in {p for parts in split for p in parts if p not in self.lengths}:
            held.append(piece)
            n = bytes_of(piece)
            size += n
            if n > LONG_PIECE:
                once.append(piece)
            else:
                self.kept_bytes += n + PLACE_BYTES
            if size >= self.batch_bytes:
                self._encode(held)
                held, size = [], 0
        self._encode(held)
        length = self.lengths.__getitem__
        out = [sum(map(length, parts)) for parts in split]
        for piece in once:
            del self.lengths[piece]
        return out

    def _encode(self, pieces: list[str]) -> None:
        for piece, found in zip(pieces, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)):
            self.lengths[piece] = len(found)


_COUNTERS: dict[tuple[str, int], Counter] = {}


def _counter(path: str, batch_bytes: int) -> Counter:
    key = (path, batch_bytes)
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(path, batch_bytes)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``docs`` without the text, with n_bytes, n_tokens and over_limit. ``tokenizer`` is a file that
    every executor has at this path."""
    docs = without(docs, RESULTS)
    kept = [i for i, c in enumerate(docs.columns) if c.lower() != "text"]
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")
    schema = StructType([*[docs.schema.fields[i] for i in kept], StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])

    def count(batch: pa.RecordBatch) -> list[pa.Array]:
        counter = _counter(tokenizer, batch_bytes)
        texts = [t or "" for t in batch.column(at).to_pylist()]
        n_bytes = list(map(bytes_of, texts))
        tokens: list[int] = []
        start = size = 0
        for i, n in enumerate(n_bytes):  # parts of about equal bytes, however the rows are cut
            size += n
            if size >= 4 * batch_bytes or i + 1 == len(texts):
                tokens += counter.counts(texts[start:i + 1])
                start, size = i + 1, 0
        return [*[batch.column(i) for i in kept], pa.array(n_bytes, pa.int64()),
                pa.array(tokens, pa.int64())]

    return map_batches(docs, count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
