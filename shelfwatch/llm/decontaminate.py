"""Benchmark decontamination: exact runs of benchmark words inside documents.

Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. Windows of an
item are its runs of ``width`` words; an item with fewer words is one window. The hash set of
windows is broadcast, at most ``max_windows`` of them at a time: a larger benchmark is taken in
blocks of items, one pass over the documents each, and hits of all blocks are merged per row.
A document is scanned once per block: words unknown to the benchmark end a run at once, and a
window is looked up by the tuple of its word numbers, so a find in the set is already verified.

Results in special cases: NULL or empty texts have no words and no hits; items without words are
ignored; an item without id marks words but is not counted; items that repeat count once; an empty
benchmark hits nothing; repeated documents each get a row; input columns named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from shelfwatch.llm.common import ROW_FILE, ROW_INDEX, columns_of, identified, map_batches, pin, shield, without

WIDTH = 13
MAX_WINDOWS = 200_000
PART, WHOLE = 20, 1  # contaminated: PART * n_hit >= WHOLE * n_words

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
RESULTS = ["n_words", "n_hit", "item_ids", "hit_spans", "contaminated"]
_ADDED = "n_words long, hit_spans array<struct<start:int,stop:int>>, item_ids array<string>"
_NO_SPANS = "array<struct<start:int,stop:int>>"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


class Windows:
    """The windows of some items, for scanning."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        self.words: dict[bytes, int] = {}
        self.by_size: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words)) for w in words_of(text or "")]
            size = min(width, len(ids))
            if size:
                held = self.by_size.setdefault(size, {})
                for i in range(len(ids) - size + 1):
                    held.setdefault(tuple(ids[i:i + size]), set()).add(item)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, hit spans (word numbers, stop excluded), ids of items found."""
        words = words_of(text or "")
        if not self.by_size:
            return len(words), [], []
        ids = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        known = np.concatenate(([False], ids >= 0, [False]))
        edges = np.flatnonzero(known[1:] != known[:-1])
        least = min(self.by_size)
        starts, stops = edges[::2], edges[1::2]
        long = stops - starts >= least
        found: list[tuple[int, int]] = []
        items: set = set()
        for a, b in zip(starts[long].tolist(), stops[long].tolist()):
            run = ids[a:b].tolist()
            for size, held in self.by_size.items():
                for i in range(len(run) - size + 1):
                    hit = held.get(tuple(run[i:i + size]))
                    if hit:
                        found.append((a + i, a + i + size))
                        items |= hit
        return len(words), merged(found), sorted(x for x in items if x is not None)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _passes(benchmark: DataFrame, max_windows: int) -> int:
    """How many blocks of items are needed; an item has at most as many windows as words."""
    words = F.size(F.split(F.coalesce("text", F.lit("")), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))
    total = benchmark.agg(F.sum(words)).first()[0]
    return max(1, -(-int(total or 0) // max_windows))


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` (columns kept) with n_words, n_hit, item_ids, hit_spans and contaminated."""
    docs = without(docs, RESULTS)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    passes = _passes(items, max_windows)
    if passes == 1:
        return _verdict(_scanned(docs, items, width))
    rows = identified(docs)
    keys = [ROW_FILE, ROW_INDEX]
    found = None
    for block in range(passes):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == block)
        one = pin(_scanned(rows.select(*keys, "text"), own, width).where(F.size("hit_spans") > 0)
                  .select(*keys, "hit_spans", "item_ids"), "hits")
        found = one if found is None else found.unionByName(one)
    of_row = found.groupBy(*keys).agg(
        F.flatten(F.collect_list("hit_spans")).alias("__spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("__items"))
    counted = _scanned(rows, items.limit(0), width).drop("hit_spans", "item_ids")
    joined = counted.join(of_row, keys, "left").select(
        *columns_of(docs), "n_words",
        _merge_columns(F.coalesce("__spans", F.array().cast(_NO_SPANS))).alias("hit_spans"),
        F.coalesce("__items", F.array().cast("array<string>")).alias("item_ids"))
    return _verdict(joined)


def _merge_columns(spans: Column) -> Column:
    """Overlapping spans joined, in order."""
    def add(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        widened = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(
            F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))))
        return F.when(F.coalesce(s["start"] <= last["stop"], F.lit(False)), widened).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(_NO_SPANS), add)


def _verdict(df: DataFrame) -> DataFrame:
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["stop"] - s["start"]))
    return (df.withColumn("n_hit", n_hit)
            .withColumn("contaminated", (F.col("n_hit") > 0) & (PART * F.col("n_hit") >= WHOLE * F.col("n_words"))))


def _scanned(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """One pass over ``docs`` with the windows of ``items``, whose size the caller has bounded."""
    held = docs.sparkSession.sparkContext.broadcast([(r["item"], r["text"]) for r in items.distinct().collect()])
    at = docs.columns.index(next(c for c in docs.columns if c.lower() == "text"))
    cached: dict = {}

    def scan(batch: pa.RecordBatch) -> list[pa.Array]:
        if "w" not in cached:
            cached["w"] = Windows(held.value, width)
        got = [cached["w"].scan(t) for t in batch.column(at).to_pylist()]
        return [*batch.columns, pa.array([g[0] for g in got], pa.int64()),
                pa.array([[{"start": a, "stop": b} for a, b in g[1]] for g in got],
                         pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                pa.array([g[2] for g in got], pa.list_(pa.string()))]

    return map_batches(docs, scan, StructType([*docs.schema.fields, *StructType.fromDDL(_ADDED).fields]))


def remove_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the words in ``spans`` (word numbers) and what stands between them."""
    if text is None or not spans:
        return text
    data = text.encode("utf-8", "surrogatepass")
    flags = np.frombuffer(data.translate(_LOWER), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False]))))
    out, last = [], 0
    for a, b in spans:
        out.append(data[last:edges[2 * a]])
        last = edges[2 * b - 1]
    return b"".join([*out, data[last:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, drop_documents: bool = True,
                  max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The columns of ``docs``: contaminated documents are dropped, or with ``drop_documents=False``
    every hit span is cut out of the texts."""
    docs, back = shield(docs, RESULTS)
    found = find_hits(docs, benchmark, width, max_windows)
    if drop_documents:
        return back(found.where(~F.col("contaminated")))
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")

    def cut(batch: pa.RecordBatch) -> list[pa.Array]:
        columns = list(batch.columns)
        spans = columns.pop()
        texts = [remove_spans(t, [(x["start"], x["stop"]) for x in s or ()]) for t, s in zip(columns[at].to_pylist(), spans.to_pylist())]
        columns[at] = pa.array(texts, columns[at].type)
        return columns

    return back(map_batches(found.select(*columns_of(docs), "hit_spans"), cut, docs.schema))
