"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Tokenizer A is a byte-level BPE file read by ``tokenizers``, B a piece file read by ``sentencepiece``, which puts a
space in front of a text; A gets the space with the text. A group is what lies between two byte offsets
where tokens of both end. Groups are found by pointer jumping: a token of A points to the token of B
that holds its last byte, a token of B to the token of A that holds its last byte if that one reaches
farther, else to itself. ``succ = succ[succ]`` over whole arrays then doubles the way until nothing changes, and the
token that a token ends at is its group.

Texts are cut before a space that follows a visible character. Neither tokenizer has a token across such a
place (for B its pieces are looked through when it is loaded; if one holds a space behind another sign,
texts stay whole), so parts are encoded and aligned once, and a worker keeps the short ones it has met, up
to a bound in bytes. Rows are taken in batches of about ``batch_bytes`` of text.

Links (pairs of tokens that share bytes) leave a batch as a row per id pair, with the rows of the batch
that hold it. Counts of id pairs are one aggregate with map-side sums; the join with them has a narrow row per
pair and batch, so a pair that every text has is not one long group; its results meet the links again batch by
batch, where sums per document are formed. The best count per id of B is a table of at most its vocabulary and is broadcast.

Results in special cases: texts that are NULL, empty, or that one tokenizer changes (its tokens do not add up to
space + text) have no tokens: zeros and an empty ``groups_sha256``; repeated rows each get a row and count
each time; strings of special tokens are plain text; an empty table gives an empty result; input columns named
like a result are replaced. A text without any space is one part and is encoded whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from shelfwatch.llm.common import columns_of, map_batches, pin, without

BATCH_BYTES = 1 << 22
BATCH_ROWS = 1 << 16
CACHE_BYTES = 3 << 23
TEXT_CHARS = 1 << 14  # parts encoded in one text
LONG_PART = 64  # characters; longer parts are not kept
RESULTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

_BLANK = r"\s\x00-\x20\x7f-\xa0 ᠎ -‏ -  -⁤　﻿"
_CUT = re.compile(rf"(?<=[^{_BLANK}])(?= )")
_ODD_SPACE = re.compile(rf"[{_BLANK}] ")
_BLANK_END = re.compile(rf"[{_BLANK}]\Z")
_BYTE_PIECE = re.compile(r"<0x[0-9A-Fa-f]{2}>")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: visible ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Both tokenizers of one worker process, and the parts it has aligned."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        self.bytes_a = []
        for i in range(self.a.get_vocab_size()):
            token = self.a.id_to_token(i) or ""
            known = all(c in letters for c in token)
            self.bytes_a.append(bytes(letters[c] for c in token) if known else token.encode())
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if _BYTE_PIECE.fullmatch(p) else p.replace("▁", " ").encode() for p in pieces]
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.n_b = len(pieces)
        self.blank = self.b.piece_to_id("▁")
        self.cuts = self.bytes_b[self.blank] == b" " and not any(re.search("[^▁]▁", p) for p in pieces)
        width = len(str(max(len(self.bytes_a), self.n_b)))
        digits = [str(i) for i in range(max(len(self.bytes_a), self.n_b))]
        self.digits = np.frombuffer("".join(d.rjust(width, "0") + "," for d in digits).encode(), np.uint8).reshape(-1, width + 1)
        self.n_digits = np.array([len(d) for d in digits], np.int64)
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.held_bytes = 0
        self.shown: list[bytes] = []
        self.valid = np.zeros(0, bool)
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links
        self.link_start = np.zeros(1, np.int64)
        self.links = np.zeros(0, np.int64)  # places in pairs
        self.pairs = np.zeros(0, np.int64)  # id of A * n_b + id of B, ascending

    def parts_of(self, text: str) -> list[str]:
        """Parts of space + text, each without the space that it begins with."""
        if not self.cuts:
            return [text]
        if text.startswith(" ") or _ODD_SPACE.search(text):
            return [part[1:] for part in _CUT.split(" " + text)]
        return text.split(" ")

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b = [ids if t else [self.blank] for t, ids in zip(texts, self.b.encode(texts, num_threads=1))]
        return a, b

    def encoded(self, parts: list[str]) -> tuple[list[str], list[str], list[list[int]], list[list[int]]]:
        """(parts in a new order, parts that a tokenizer changes, ids of A, ids of B).

        Parts are encoded many in one text, as calls for single words cost more than the words; each ends in a visible
        character, so their bounds are bounds of tokens. A text that comes back changed is encoded part by part.
        """
        texts, held, size = [], [], 0
        for part in parts:
            if not self.cuts or not part or _BLANK_END.search(part):
                texts.append([part])
                continue
            held.append(part)
            size += len(part)
            if size >= TEXT_CHARS:
                texts.append(held)
                held, size = [], 0
        if held:
            texts.append(held)
        order, changed, all_a, all_b = [], [], [], []
        while texts:
            again = []
            joined = [" ".join(t) for t in texts]
            for own, text, a, b in zip(texts, joined, *self.encode(joined)):
                data = b" " + text.encode("utf-8", "surrogatepass")
                if b"".join(map(self.bytes_a.__getitem__, a)) == data == b"".join(map(self.bytes_b.__getitem__, b)):
                    order += own
                    all_a.append(a)
                    all_b.append(b)
                elif len(own) > 1:
                    again += [[part] for part in own]
                else:
                    changed += own
            texts = again
        return order, changed, all_a, all_b

    def aligned(self, ids_a: list[list[int]], ids_b: list[list[int]]) -> dict[str, np.ndarray]:
        """Tokens of all given parts in a row, their groups and links. The tokens of a part must cover the same bytes."""
        a = np.fromiter(chain.from_iterable(ids_a), np.int64)
        b = np.fromiter(chain.from_iterable(ids_b), np.int64)
        n = len(a)
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        start_a, start_b = end_a - self.size_a[a], end_b - self.size_b[b]
        last_b = np.searchsorted(end_b, end_a, "left")  # the token of B that holds the last byte of each of A
        last_a = np.searchsorted(end_a, end_b, "left")
        farther = end_a[last_a] > end_b if n else np.zeros(0, bool)
        succ = np.concatenate((n + last_b, np.where(farther, last_a, n + np.arange(len(b)))))
        while True:
            doubled = succ[succ]
            if np.array_equal(doubled, succ):
                break
            succ = doubled
        terminal = np.zeros(n + len(b), bool)
        terminal[succ] = True
        group = (np.cumsum(terminal) - 1)[succ]
        first_b = np.searchsorted(end_b, start_a, "right")
        per_a = last_b - first_b + 1
        link_a = np.repeat(np.arange(n), per_a)
        link_b = np.arange(per_a.sum()) - np.repeat(np.cumsum(per_a) - per_a, per_a) + np.repeat(first_b, per_a)
        return {"a": a, "b": b, "group_a": group[:n], "group_b": group[n:], "link_a": link_a, "link_b": link_b,
                "start_a": start_a, "end_a": end_a, "end_b": end_b}

    def _shown(self, x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All groups as text, ``a1,a2|b1;`` and so on, and how long the text of each token is, in the order shown."""
        groups = int(x["group_b"].max(initial=-1)) + 1
        in_a, in_b = np.bincount(x["group_a"], minlength=groups), np.bincount(x["group_b"], minlength=groups)
        place_a = np.arange(len(x["a"])) + (np.cumsum(in_b) - in_b)[x["group_a"]]
        place_b = np.arange(len(x["b"])) + np.cumsum(in_a)[x["group_b"]]
        ids = np.empty(len(x["a"]) + len(x["b"]), np.int64)
        ids[place_a], ids[place_b] = x["a"], x["b"]
        rows = self.digits[ids]
        rows[place_a[np.cumsum(in_a) - 1], -1] = ord("|")
        rows[place_b[np.cumsum(in_b) - 1], -1] = ord(";")
        seen = np.arange(rows.shape[1]) >= rows.shape[1] - 1 - self.n_digits[ids][:, None]
        return rows[seen], self.n_digits[ids] + 1

    def learn(self, parts: list[str]) -> None:
        """Encodes and aligns parts not met before; they get the next codes."""
        order, changed, ids_a, ids_b = self.encoded(parts)
        x = self.aligned(ids_a, ids_b)
        ends = np.cumsum(np.fromiter((len(p.encode("utf-8", "surrogatepass")) + 1 for p in order), np.int64, len(order)))
        upto_a, upto_b = np.searchsorted(x["end_a"], ends, "right"), np.searchsorted(x["end_b"], ends, "right")
        none = np.zeros(len(changed), np.int64)
        n_a, n_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        part_a, part_b = np.repeat(np.arange(len(order)), n_a), np.repeat(np.arange(len(order)), n_b)
        last = np.concatenate((x["group_b"][1:] != x["group_b"][:-1], [True])) if len(x["b"]) else np.zeros(0, bool)
        n_groups = np.bincount(part_b[last], minlength=len(order))
        n_links = np.bincount(part_a[x["link_a"]], minlength=len(order))
        text, sizes = self._shown(x)
        upto = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], upto_a + upto_b))]
        data = text.tobytes()
        self.shown += [data[s:e] for s, e in zip(upto[:-1].tolist(), upto[1:].tolist())]
        self.shown += [b""] * len(changed)
        for part in (*order, *changed):
            self.codes[part] = len(self.codes)
        self.held_bytes += sum(map(len, parts)) + len(data)
        self.valid = np.concatenate((self.valid, np.ones(len(order), bool), none.astype(bool)))
        counts = [np.concatenate((c, none)) for c in (n_a, n_b, n_groups, n_links)]
        self.counts = np.concatenate((self.counts, np.stack(counts, 1)))
        self.link_start = np.concatenate((self.link_start, self.link_start[-1] + np.cumsum(counts[3])))
        links = x["a"][x["link_a"]] * self.n_b + x["b"][x["link_b"]]
        pairs = np.union1d(self.pairs, links)
        self.links = np.concatenate((np.searchsorted(pairs, self.pairs)[self.links], np.searchsorted(pairs, links)))
        self.pairs = pairs

    def forget(self, kept: int) -> None:
        """Back to the first ``kept`` parts."""
        for part in list(self.codes)[kept:]:
            del self.codes[part]
        del self.shown[kept:]
        self.valid, self.counts = self.valid[:kept], self.counts[:kept]
        self.link_start = self.link_start[:kept + 1]
        self.links = self.links[:self.link_start[-1]]

    def batch(self, texts: list[str | None]) -> dict:
        """Counts and digests per text, and per id pair the texts that hold it."""
        split = [self.parts_of(t) if t else [] for t in texts]
        if self.held_bytes + 8 * len(self.pairs) > CACHE_BYTES:
            self.clear()
        fresh = set(chain.from_iterable(split)) - self.codes.keys()
        self.learn([p for p in fresh if len(p) <= LONG_PART])
        kept, kept_bytes = len(self.codes), self.held_bytes
        self.learn([p for p in fresh if len(p) > LONG_PART])
        n_parts = np.fromiter(map(len, split), np.int64, len(split))
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(split)), np.int64, int(n_parts.sum()))
        row = np.repeat(np.arange(len(texts)), n_parts)
        good = (np.bincount(row[~self.valid[codes]], minlength=len(texts)) == 0) & (n_parts > 0)
        codes, row = codes[good[row]], row[good[row]]
        sums = [np.bincount(row, self.counts[codes, k], len(texts)).astype(np.int64) for k in range(4)]
        digests, at = [], 0
        for ok, n in zip(good.tolist(), n_parts.tolist()):
            digests.append(self._digest(codes[at:at + n]) if ok else "")
            at += n if ok else 0
        # Parts of a text once each, then their links, then the links of a text once each.
        both, times = np.unique(row * len(self.codes) + codes, return_counts=True)
        part_row, part = both // max(1, len(self.codes)), both % max(1, len(self.codes))
        n_links = self.counts[part, 3]
        link = self.links[np.arange(n_links.sum()) - np.repeat(np.cumsum(n_links) - n_links, n_links) + np.repeat(self.link_start[part], n_links)]
        held, n = _summed(link * len(texts) + np.repeat(part_row, n_links), np.repeat(times, n_links))
        place = held // max(1, len(texts))
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        pairs = self.pairs[place[starts]]
        starts = np.append(starts, len(held))
        self.forget(kept)
        self.held_bytes = kept_bytes
        return {"sums": sums, "digests": digests, "pairs": pairs, "starts": starts, "rows": held % max(1, len(texts)), "n": n}

    def _digest(self, codes: np.ndarray) -> str:
        state, step = hashlib.sha256(), 1 << 16
        for i in range(0, len(codes), step):
            text = b"".join(map(self.shown.__getitem__, codes[i:i + step].tolist()))
            state.update(text if i + step < len(codes) else text[:-1])
        return state.hexdigest()


def _summed(keys: np.ndarray, amounts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sum of their amounts. Key and amount go into one number, as sorting numbers
    is far quicker than sorting places, unless they don't fit."""
    bits = int(amounts.max(initial=0)).bit_length()
    if int(keys.max(initial=0)).bit_length() + bits > 62:
        held, inverse = np.unique(keys, return_inverse=True)
        return held, np.bincount(inverse, amounts, len(held)).astype(np.int64)
    packed = np.sort(keys << bits | amounts)
    keys, amounts = packed >> bits, packed & ((1 << bits) - 1)
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[starts], np.add.reduceat(amounts, starts) if len(starts) else amounts


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    key = (path_a, path_b)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(path_a, path_b)
    return _ALIGNERS[key]


_OF_ROW = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_OF_PAIR = "pair long, n long, held_rows binary, held_n binary"


def _scan(docs: DataFrame, path_a: str, path_b: str, batch_bytes: int) -> DataFrame:
    """Rows of ``docs`` without the text, numbered by batch and place, and rows of id pairs per batch."""
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")
    kept = [i for i in range(len(docs.columns)) if i != at]
    fields = [StructField(f"c{i}", docs.schema.fields[i].dataType) for i in kept]
    schema = StructType([*StructType.fromDDL("batch long, place int").fields, *fields,
                         *StructType.fromDDL(_OF_ROW).fields, *StructType.fromDDL(_OF_PAIR).fields])

    def done(number: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for b in held for t in b.column(at).to_pylist()]
        found = aligner(path_a, path_b).batch(texts)
        rows = pa.Table.from_batches(held).combine_chunks()
        own = [rows.column(i).combine_chunks() for i in kept]
        own = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in own]

        def nothing(n: int, kinds) -> list[pa.Array]:
            return [pa.nulls(n, k) for k in kinds]

        pair_types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(texts), number)), pa.array(np.arange(len(texts), dtype=np.int32)), *own,
             *[pa.array(s) for s in found["sums"]], pa.array(found["digests"], pa.string()), *nothing(len(texts), pair_types)], names=schema.names)
        pairs, starts, step = found["pairs"], found["starts"], 1 << 14
        for i in range(0, len(pairs), step):
            part = starts[i:i + step + 1]
            n = len(part) - 1
            offsets = pa.py_buffer(((part - part[0]) * 4).astype(np.int32))
            blobs = [pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(values[part[0]:part[-1]].astype("<u4"))])
                     for values in (found["rows"], found["n"])]
            total = np.add.reduceat(found["n"][part[0]:part[-1]], part[:-1] - part[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, number)), *nothing(n, [pa.int32(), *[c.type for c in own], *[pa.int64()] * 4, pa.string()]),
                 pa.array(pairs[i:i + n]), pa.array(total), *blobs], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size, rows = [], 0, 0
        for batch in batches:
            held.append(batch)
            size, rows = size + batch.column(at).nbytes, rows + batch.num_rows
            if size >= batch_bytes or rows >= BATCH_ROWS:
                yield from done(number, held)
                number, held, size, rows = number + 1, [], 0, 0
        if held:
            yield from done(number, held)

    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(run, schema)


def align(docs: DataFrame, path_a: str, path_b: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``docs`` without the text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    The files must be at these paths on every executor.
    """
    docs = without(docs, RESULTS)
    names = [c for c in docs.columns if c.lower() != "text"]
    inner = [f"c{i}" for i, c in enumerate(docs.columns) if c.lower() != "text"]
    scanned = pin(_scan(docs, path_a, path_b, batch_bytes), "alignment")
    rows, held = scanned.where("pair IS NULL"), scanned.where("pair IS NOT NULL")
    of_b = F.lit(aligner(path_a, path_b).n_b)
    counts = pin(held.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.pmod("pair", of_b)), "pair-counts")
    best = counts.groupBy("b").agg(F.max("count").alias("highest"))
    marked = counts.join(F.broadcast(best), "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    of_batch = held.select(F.col("batch").alias("of_batch"), F.col("pair").alias("of_pair"))
    of_batch = of_batch.join(marked, F.col("of_pair") == F.col("pair")).select("of_batch", "of_pair", "count", "best")

    def sums(links: pa.Table, table: pa.Table) -> pa.Table:
        """The sums of a batch's rows. Both sides have every pair of the batch once; only the narrow one went through the join."""
        links, table = links.sort_by("pair"), table.sort_by("of_pair")
        ends = np.cumsum([len(x.as_py()) // 4 for x in links["held_rows"]])
        sizes = np.diff(ends, prepend=0)
        place = np.frombuffer(b"".join(links["held_rows"].to_pylist()), "<u4").astype(np.int64)
        n = np.frombuffer(b"".join(links["held_n"].to_pylist()), "<u4").astype(np.int64)
        count, is_best = np.repeat(table["count"].to_numpy(), sizes), np.repeat(table["best"].to_numpy(), sizes)
        best_n, total = np.zeros(place.max() + 1, np.int64), np.zeros(place.max() + 1, np.int64)
        np.add.at(best_n, place[is_best], n[is_best])
        np.add.at(total, place, n * count)
        seen = np.unique(place)
        return pa.table({"sum_batch": pa.array(np.full(len(seen), links["batch"][0].as_py())), "sum_place": pa.array(seen.astype(np.int32)),
                         "n_best": pa.array(best_n[seen]), "count_sum": pa.array(total[seen])})

    by_batch = held.select("batch", "pair", "held_rows", "held_n").groupBy("batch").cogroup(of_batch.groupBy("of_batch"))
    of_row = by_batch.applyInArrow(sums, "sum_batch long, sum_place int, n_best long, count_sum long")
    joined = rows.join(of_row, (rows["batch"] == of_row["sum_batch"]) & (rows["place"] == of_row["sum_place"]), "left")
    return joined.select(*[F.col(i) for i in inner], "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
                         F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256").toDF(*names, *RESULTS)


def token_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``docs`` (columns kept) with ``groups``: per group its bytes in space + text (stop excluded) and the token ids of both sides."""
    docs = without(docs, ["groups"])
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")
    kind = "array<struct<start:long,stop:long,a:array<int>,b:array<int>>>"
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def groups(text: str | None) -> list[dict]:
        tool = aligner(path_a, path_b)
        parts = tool.parts_of(text) if text else []
        ids_a, ids_b = tool.encode(parts)
        data = b" " + (text or "").encode("utf-8", "surrogatepass")
        if not all(b"".join(table[i] for ids in side for i in ids) == data for table, side in ((tool.bytes_a, ids_a), (tool.bytes_b, ids_b))):
            return []
        x = tool.aligned(ids_a, ids_b)
        out = [{"start": None, "stop": None, "a": [], "b": []} for _ in range(int(x["group_b"].max(initial=-1)) + 1)]
        for g, i, s in zip(x["group_a"].tolist(), x["a"].tolist(), x["start_a"].tolist()):
            out[g]["a"].append(i)
            out[g]["start"] = s if out[g]["start"] is None else out[g]["start"]
        for g, i, e in zip(x["group_b"].tolist(), x["b"].tolist(), x["end_b"].tolist()):
            out[g]["b"].append(i)
            out[g]["stop"] = e
        return out

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        return [*batch.columns, pa.array([groups(t) for t in batch.column(at).to_pylist()], arrow)]

    return map_batches(docs.select(*columns_of(docs)), run, StructType([*docs.schema.fields, *StructType.fromDDL(f"groups {kind}").fields]))
