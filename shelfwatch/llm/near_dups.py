"""Near-duplicate documents by b-bit MinHash, with every link confirmed on full shingle sets.

1. One pass over the texts: word shingles, ``HASHES`` minima, band keys from the full minima, and the
   low ``BITS`` bits of every minimum packed into a signature. Texts with equal words are one
   class from here on, so copies cost nothing further.
2. Classes that share a band key are tied to the smallest one there (a star, not pairs). Connected
   stars are clusters: any two classes with a common band key are in one cluster.
3. Inside a cluster classes are compared in blocks of bounded size: by length, by the signatures'
   equal lanes, counted in bits and corrected for chance collisions, and last on the shingle sets
   themselves. A block hands out a spanning forest of its confirmed links, never its pairs.
   A cluster of one block is then done. A larger one first compares every block with itself and with
   block 0; what is outside the largest component after that is compared with the whole cluster. So
   a huge group of alike texts costs in proportion to its size.
4. Components of the confirmed links; the smallest doc_id of a component names it.

The estimate drops a pair only ``SIGMAS`` standard errors below the threshold. A link at the threshold
shares no band with a probability of ``MISS`` at most; above it the chance falls fast.

Results in special cases: NULL, empty and blank texts have no shingles, are alone, and are kept; a text
with fewer words than a shingle is one shingle; rows with equal words are in one component; the
component of rows without doc_id is NULL unless it has another row; kept marks the rows whose doc_id
is the component's, so repeated rows of one doc_id are all marked (``dedupe`` keeps one); an empty
table gives an empty result; input columns named like a result are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from shelfwatch.llm.common import ROW_FILE, ROW_INDEX, identified, joinable, pin, shield
from shelfwatch.llm.components import connected

HASHES, BITS = 128, 4  # lanes of BITS bits fill eight words
MISS = 1e-6  # the most a link at the threshold may miss all bands by
SIGMAS = 6
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 19
PAIRS = 256  # pairs of lines compared at a time
RESULTS = ["n_shingles", "component_id", "kept"]

_rng = np.random.default_rng(20)
_MULT = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | 1).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_BAND = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_P, _Q, _R = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], size: int) -> set[tuple]:
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(size)]))


def minima(words: list[bytes], size: int) -> np.ndarray:
    """The least value of every hash function over the shingles."""
    one = np.fromiter(map(crc32, words), np.uint64, len(words))
    size = min(size, len(words))
    mixed = one[:len(one) - size + 1].copy()
    for i in range(1, size):
        mixed = (mixed * _P ^ (mixed >> np.uint64(29))) * _Q + one[i:len(one) - size + 1 + i]
    mixed = ((mixed ^ (mixed >> np.uint64(32))) * _R >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(mixed), 2048):
        np.minimum(least, (mixed[i:i + 2048, None] * _MULT + _ADD).min(axis=0), out=least)
    return least


def signature(least: np.ndarray) -> bytes:
    """The low bits of the minima, packed."""
    lanes = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, 64 // BITS)
    return (lanes << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).tobytes()


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): as many rows to a band as leave a link at the threshold a miss of ``MISS`` at most."""
    for rows in range(HASHES, 0, -1):
        if (1 - (percent / 100) ** rows) ** (HASHES // rows) <= MISS:
            return HASHES // rows, rows
    return HASHES, 1


def band_keys(least: np.ndarray, bands: int, rows: int) -> list[int]:
    used = ((least[:bands * rows].astype(np.uint64) + _P) * _BAND[:bands * rows]).reshape(bands, rows)
    keys = used.sum(axis=1, dtype=np.uint64)
    keys = (keys ^ (keys >> np.uint64(31))) * _Q + np.arange(bands, dtype=np.uint64)
    return (keys ^ (keys >> np.uint64(29))).view(np.int64).tolist()


def equal_lanes(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """How many lanes of ``one`` signature each of ``many`` repeats, by bit counts."""
    odd = np.bitwise_xor(one, many)
    for shift in (1 << i for i in range(BITS.bit_length() - 1)):
        odd |= odd >> np.uint64(shift)
    low = np.uint64(sum(1 << i for i in range(0, 64, BITS)))
    return HASHES - np.bitwise_count(odd & low).sum(axis=1, dtype=np.int64)


def similarity(equal_share):
    """The Jaccard similarity behind a share of equal lanes: unlike minima agree by chance in 1 of 2^b."""
    chance = 2.0 ** -BITS
    return (equal_share - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    s, chance = percent / 100, 2.0 ** -BITS
    share = s + (1 - s) * chance
    return s - SIGMAS * (share * (1 - share) / HASHES) ** 0.5 / (1 - chance)


def sketches(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Row identity, doc_id, and per text: class digest, n_shingles, sig, bands (NULL without words)."""
    rows = rows.select(ROW_FILE, ROW_INDEX, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bands, width = banding(percent)
    fields = [("n_shingles", pa.int64()), ("words", pa.binary()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(3).to_pylist():
                words = words_of(text)
                if not words:
                    out.append((0, None, None, None))
                    continue
                least = minima(words, size)
                out.append((len(shingles(words, size)), hashlib.md5(b" ".join(words)).digest(), signature(least), band_keys(least, bands, width)))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(list(c), t) for c, (_, t) in zip(cols, fields)]],
                                             names=[*batch.schema.names[:3], *[n for n, _ in fields]])

    ddl = f"{ROW_FILE} long, {ROW_INDEX} long, doc_id long, n_shingles long, words binary, sig binary, bands array<long>"
    return rows.mapInArrow(sketch, StructType.fromDDL(ddl))


def clusters(classes: DataFrame) -> DataFrame:
    """(id, cluster) of the classes that share a band key with another one."""
    # By sorting: after an explode the optimizer counts an array of bands as one, and would broadcast all of them.
    banded = classes.select("id", F.explode("bands").alias("key")).hint("merge")
    shared = banded.groupBy("key").agg(F.min("id").alias("center"), F.max("id").alias("other")).where("center <> other")
    stars = banded.join(shared.select("key", "center"), "key").where("id <> center").select("id", "center")
    return connected(stars, "id", "center").select(F.col("node").alias("id"), F.col("root").alias("cluster"))


class TextMatcher:
    """Which texts of a block are near a text by signature and size, and which are linked to it."""

    def __init__(self, rows: dict[str, np.ndarray], size: int, percent: int):
        self.size, self.percent, self.cut = size, percent, least_estimate(percent)
        self.sigs = np.frombuffer(b"".join(rows["sig"]), np.uint64).reshape(len(rows["id"]), -1)
        self.counts, self.texts, self.ids = rows["n_shingles"], rows["text"], rows["id"].tolist()
        self.sets: dict[int, set] = {}

    def near(self, k: int) -> np.ndarray:
        """Places after ``k``, the nearest first."""
        guess = similarity(equal_lanes(self.sigs[k], self.sigs[k + 1:]) / HASHES)
        less, more = np.minimum(self.counts[k], self.counts[k + 1:]), np.maximum(self.counts[k], self.counts[k + 1:])
        fits = np.flatnonzero((guess >= self.cut) & (100 * less >= self.percent * more))
        return fits[np.argsort(-guess[fits], kind="stable")] + k + 1

    def linked(self, k: int, j: int) -> bool:
        both = len(self._set(k) & self._set(j))
        return 100 * both >= self.percent * (self.counts[k] + self.counts[j] - both)

    def _set(self, k: int) -> set:
        own = self.ids[k]
        if own not in self.sets:
            self.sets[own] = shingles(words_of(self.texts[k]), self.size)
        return self.sets[own]


def _compare(matcher, halves: bool):
    """Compares the rows of each cluster in a task's frame, whole small clusters or a pair of blocks of
    a large one, and returns a spanning forest of the links found.

    With ``halves`` the rows with side 0 are compared with all; else every row with every other."""
    def links(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["cluster", "side", "id"])
        columns = {c: rows[c].to_numpy() for c in ("cluster", "side", "id", "label", "n_shingles", "sig", "text")}
        new = np.flatnonzero(np.diff(columns["cluster"])) + 1
        out: list[tuple[int, int]] = []
        for a, b in zip([0, *new.tolist()], [*new.tolist(), len(rows)]):
            out += _forest({c: v[a:b] for c, v in columns.items()}, matcher, halves)
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return links


def _forest(rows: dict[str, np.ndarray], matcher, halves: bool) -> list[tuple[int, int]]:
    ids = rows["id"]
    root = list(range(len(ids)))
    seen: dict = {}
    for k, label in enumerate(rows["label"].tolist()):  # rows of one label are linked already
        root[k] = root[seen.setdefault(label, k)]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    match = matcher(rows)
    out = []
    first = range(int((rows["side"] == 0).sum()) if halves else len(ids) - 1)
    if hasattr(match, "linked_pairs"):
        for k, j in _pair_links(match, first, find):
            root[max(find(k), find(j))] = min(find(k), find(j))
            out.append((ids[k], ids[j]))
        return out
    for k in first:
        own = find(k)
        for j in match.near(k).tolist():
            y = find(j)
            if own != y and match.linked(k, j):
                root[max(own, y)] = own = min(own, y)
                out.append((ids[k], ids[j]))
    return out


def _pair_links(match, first: range, find) -> Iterator[tuple[int, int]]:
    """The linked pairs that ``find`` does not yet tie together when their turn comes. The nearest come first, many at a time,
    so that most of the others are tied together before."""
    near = [match.near(k) for k in first]
    k, j = np.repeat(np.arange(len(near)), [len(x) for x in near]), np.concatenate([*near, np.zeros(0, np.int64)]).astype(np.int64)
    order = np.argsort(match.nearness(k, j), kind="stable")
    k, j = k[order], j[order]
    while len(k):
        tops = {x: find(x) for x in {*k.tolist(), *j.tolist()}}
        apart = np.array([tops[x] != tops[y] for x, y in zip(k.tolist(), j.tolist())], bool)
        k, j = k[apart], j[apart]
        linked = match.linked_pairs(k[:PAIRS], j[:PAIRS])
        for x, y in zip(k[:PAIRS][linked].tolist(), j[:PAIRS][linked].tolist()):
            if find(x) != find(y):
                yield x, y
        k, j = k[PAIRS:], j[PAIRS:]


def _blocks(rows: str, shingle: str):
    return F.greatest(F.ceil(F.col(rows) / BLOCK_ROWS), F.ceil(F.col(shingle) / BLOCK_SHINGLES), F.lit(1)).cast("int")


def confirmed(members: DataFrame, matcher) -> DataFrame:
    """(a, b): links that connect exactly what the links inside the clusters connect.

    ``members``: id, cluster, n_shingles (the weight of a row), sig, text; a written table. ``matcher``
    takes a pandas frame of them and says what is near and what is linked, as ``TextMatcher`` does.
    """
    shape = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("__n"), F.sum("n_shingles").alias("__s"))
    # Of large clusters only, so few rows of known size: texts need not move for it.
    shape = pin(shape.select("cluster", _blocks("__n", "__s").alias("blocks")).where("blocks > 1"), "shapes")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = members.join(shape, "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", block)
    # Block 0 meets every block; any other meets itself and block 0 at its own place. Clusters of one
    # block share tasks, about BLOCK_ROWS rows in each.
    own = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    total = members.agg(F.count(F.lit(1)).alias("__n"), F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("__s"))
    bins = total.select(_blocks("__n", "__s")).first()[0]
    group = F.when(F.col("blocks") == 1, -1 - F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.col("cluster"))
    first = (dealt.withColumn("at", F.explode(own)).withColumn("label", F.col("id")).withColumn("side", F.lit(0))
             .groupBy(group.alias("group"), "at").applyInPandas(_compare(matcher, False), "a long, b long"))
    first = pin(first, "links")
    large = pin(members.join(shape.select("cluster"), "cluster"), "large")
    if large.isEmpty():
        return first
    return first.unionByName(_rest(large, first, matcher))


def _rest(large: DataFrame, first: DataFrame, matcher) -> DataFrame:
    """What is outside the largest component of its cluster, compared with the whole cluster."""
    roots = joinable(connected(first, "a", "b"))
    labelled = pin(large.join(roots.withColumnRenamed("node", "id"), "id", "left")
                   .withColumn("label", F.coalesce("root", "id")).drop("root"), "labelled")
    sums = labelled.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    largest = sums.groupBy("cluster").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("all_n"), F.sum("s").alias("all_s"),
                                          F.count(F.lit(1)).alias("labels"))
    rest = sums.join(largest.select("cluster", F.col("most.label").alias("main")), "cluster").where("label <> main").groupBy("cluster").agg(
        F.sum("n").alias("rest_n"), F.sum("s").alias("rest_s"))
    shape = (largest.where("labels > 1").join(rest, "cluster")
             .select("cluster", F.col("most.label").alias("main"), _blocks("all_n", "all_s").alias("blocks"),
                     _blocks("rest_n", "rest_s").alias("rests")))
    rows = labelled.join(shape, "cluster")
    whole = rows.withColumn("side", F.lit(1)).withColumn("j", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)))
    outside = rows.where("label <> main").withColumn("side", F.lit(0)).withColumn(
        "i", F.pmod(F.xxhash64("id"), F.col("rests")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    names = ["cluster", "i", "j", "id", "label", "side", "n_shingles", "sig", "text"]
    return (whole.select(*names).unionByName(outside.select(*names)).groupBy("cluster", "i", "j")
            .applyInPandas(_compare(matcher, True), "a long, b long"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Row identity, doc_id, n_shingles, component_id, kept and the class digest, a row per document.

    ``docs`` needs doc_id and text; links need ``percent`` of the union of ``size``-word shingles.
    """
    return _labelled(identified(docs.select("doc_id", "text")), size, percent)


def _labelled(rows: DataFrame, size: int, percent: int) -> DataFrame:
    sketched = pin(sketches(rows, size, percent), "sketches")
    classes = sketched.where("words IS NOT NULL").dropDuplicates(["words"])
    classes = pin(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    grouped = joinable(clusters(classes))
    wanted = classes.select("id", "n_shingles", "sig", ROW_FILE, ROW_INDEX).join(grouped, "id")
    members = pin(wanted.join(rows.select(ROW_FILE, ROW_INDEX, "text"), [ROW_FILE, ROW_INDEX]).drop(ROW_FILE, ROW_INDEX), "members")
    roots = joinable(connected(confirmed(members, lambda block: TextMatcher(block, size, percent)), "a", "b"))
    named = classes.select("id", "words").join(roots.withColumnRenamed("node", "id"), "id").select("words", "root")
    plain = sketched.select(ROW_FILE, ROW_INDEX, "doc_id", "n_shingles", "words").join(named, "words", "left")
    # A component is named by its root class, a class without links by itself.
    plain = pin(plain.withColumn("__component", F.coalesce(F.col("root").cast("string"), F.hex("words"))).drop("root"), "labelled")
    # Written down, so that the join can split a component that holds most documents.
    least = pin(plain.where("__component IS NOT NULL").groupBy("__component").agg(F.min("doc_id").alias("component_id")), "least")
    out = plain.join(joinable(least), "__component", "left")
    out = out.withColumn("component_id", F.when(F.col("words").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def dedupe(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The columns of ``docs``, one document of each component. Documents without words all stay."""
    docs, back = shield(docs, [*RESULTS, "words", "__component"])
    rows = identified(docs)
    found = pin(_labelled(rows, size, percent).where("kept").select(ROW_FILE, ROW_INDEX, "words", "__component"), "kept")
    # Rows that share the smallest doc_id: one stays, whatever their number.
    best = found.where("words IS NOT NULL").groupBy("__component").agg(F.min(F.struct(ROW_FILE, ROW_INDEX)).alias("r"))
    stay = best.select("r.*").unionByName(found.where("words IS NULL").select(ROW_FILE, ROW_INDEX))
    return back(rows.join(joinable(found, stay), [ROW_FILE, ROW_INDEX], "left_semi"))
