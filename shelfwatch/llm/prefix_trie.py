"""Conversation prefix trie: every distinct beginning of a conversation, as a burst trie.

A turn is known by a 128-bit id of role and text, so rows are narrow; texts are read once. Conversations with equal
turns are one class with a weight. A container holds the suffixes of all classes below one trie head. A container
of more than ``limit`` turns bursts by next turn id: its head becomes a node, its classes go to a container for each
id, and a class that ends there leaves. Rounds go on while a container is too large, so their number is
the depth to which *different* conversations of an oversized container agree; copies do not count, as they are
one class. The containers left are dealt out by head, sorted, and swept one after another: a sweep holds one container
and yields its nodes. A container with a single class needs no sweep: it is a chain of any length, and its rows
are its nodes. Sums of subtrees go from the containers to all heads above them in one aggregate.

The ids of conversations that end at a node are hashed in order: sorted runs of ids become texts of ``RUN`` ids, and
these, in order, one digest, of which only the state is held.

Results in special cases: NULL role or text is empty; a NULL turn comes first; turns of equal number are ordered by turn
id; rows that repeat are turns of their own; rows without conv_id belong to no conversation; an empty table
gives an empty result; other columns, whatever their names, play no part. A turn is one turn however long its text is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfwatch.llm.common import before, pin

LIMIT = 4096
RUN = 4096
NODES = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends long, n_ends long"


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv, pos, tid, bytes): the turns of every conversation, numbered from 0."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    narrow = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), F.unhex(F.substring(F.sha2(named, 256), 1, 32)).alias("tid"),
        F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("one"))
    return before(narrow, ["conv"], ["turn", "tid"], {"pos": "one"}, "turns").select("conv", "pos", "tid", "bytes")


def rebuilt(turns: DataFrame, family: int = 5, spread: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conversations, turn rows) after every conversation c got the first h turns of conversation c - c % family in
    place of its own first h; h is the crc32 of its decimal id, modulo ``spread``."""
    turns = pin(turns, "turn-rows")
    lengths = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    head = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(spread))
    convs = lengths.select("conv", head.alias("h"), (F.col("conv") - F.expr(f"conv % {family}")).alias("base"))
    of_base = lengths.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = pin(convs.join(of_base, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))), "rebuilt-heads")
    own = turns.join(convs, "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "tid", "bytes")
    heads = turns.where(F.col("pos") < spread).withColumnRenamed("conv", "base")
    first = heads.join(convs, "base").where("pos < h").select("conv", "pos", "tid", "bytes")
    return convs.select("conv"), own.unionByName(first)


def _swept(depth: int, parent: int | None, suffixes: list[tuple]) -> list[list]:
    """The nodes of one container, parents first. A suffix is (turn ids, bytes, class, weight), its first turn the container's head."""
    suffixes.sort(key=itemgetter(0))
    nodes: list[list] = []  # the columns of NODES, with the parent's place for its conversation
    costs: list[int] = []
    stack: list[int] = []
    last: tuple = ()
    for tids, sizes, conv, weight in suffixes:
        keep = next((i for i, (x, y) in enumerate(zip(last, tids)) if x != y), min(len(last), len(tids)))
        del stack[keep:]
        for i in range(keep, len(tids)):
            nodes.append([depth + i, conv, stack[-1] if stack else None, 0, 0, 0, 0, None, None])
            costs.append(sizes[i])
            stack.append(len(nodes) - 1)
        nodes[stack[-1]][7:] = conv, weight
        for i in stack:
            nodes[i][1] = min(nodes[i][1], conv)
            nodes[i][3] += weight
        last = tids
    for node, cost in zip(reversed(nodes), reversed(costs)):
        node[5] = node[5] or 1
        node[6] += (node[3] - 1) * cost
        if node[2] is not None:
            above = nodes[node[2]]
            above[4] += 1
            above[5] += node[5]
            above[6] += node[6]
    for node in nodes:
        node[2] = parent if node[2] is None else nodes[node[2]][1]
    return nodes


def _sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
    names = [part.split()[0] for part in NODES.split(", ")]
    held: list[list] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], names=names)

    for (depth, _, parent), own in groupby(rows, itemgetter(0, 1, 2)):
        suffixes = []
        for (conv, weight), turns in groupby(own, itemgetter(3, 4)):
            turns = list(turns)
            suffixes.append((tuple(t[6] or b"" for t in turns), [t[7] for t in turns], conv, weight))
        held += _swept(depth, parent, suffixes)
        if len(held) >= 1 << 14:
            yield out()
            held = []
    if held:
        yield out()


def _digests(members: DataFrame) -> DataFrame:
    """(class, ends_sha256) for classes of several conversations; ``members`` has (class, conv)."""
    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns]))
        for key, own in groupby(rows, itemgetter(0)):
            while ids := [c for _, (_, c) in zip(range(RUN), own)]:
                yield pa.RecordBatch.from_pydict({"class": [key], "first": [ids[0]], "ids": [",".join(map(str, ids))]})

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns]))
        for key, own in groupby(rows, itemgetter(0)):
            state = hashlib.sha256()
            for i, (_, _, ids) in enumerate(own):
                state.update((b"," if i else b"") + ids.encode())
            yield pa.RecordBatch.from_pydict({"class": [key], "ends_sha256": [state.hexdigest()]})

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = (members.repartitionByRange(parts, "class", "conv").sortWithinPartitions("class", "conv")
             .mapInArrow(runs, "class long, first long, ids string"))
    return texts.repartition("class").sortWithinPartitions("class", "first").mapInArrow(digests, "class long, ends_sha256 string")


def trie_nodes(convs: DataFrame, turns: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of the trie of ``turns (conv, pos, tid, bytes)``, ``pos`` counting from 0 in each conversation; ``convs (conv)``
    names all conversations, those without turns too.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. A node is
    known by depth and conv_id.
    """
    spark = convs.sparkSession
    turns = pin(turns, "trie-turns")
    # Two 64-bit sums of positions and ids with the length stand for the sequence.
    seen = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("len"), F.bit_xor(F.xxhash64("pos", "tid")).alias("x"),
                                     F.bit_xor(F.xxhash64(F.lit(1), "tid", "pos")).alias("y"))
    keys = ["len", "x", "y"]
    seen = pin(convs.select("conv").distinct().join(seen, "conv", "left").na.fill(0, keys), "sequences")
    classes = pin(seen.groupBy(*keys).agg(F.min("conv").alias("class"), F.count(F.lit(1)).alias("weight")), "classes")
    root = classes.agg(F.min("class").alias("head"), F.sum("weight").alias("n"), F.sum("len").alias("turns"), F.count(F.lit(1)).alias("k")).first()
    if root["head"] is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    # A row at -1 is the textless root, so every container begins with the row of its head.
    rows = turns.join(classes.select(F.col("class").alias("conv")), "conv", "left_semi").select(F.col("conv").alias("class"), "pos", "tid", "bytes")
    rows = pin(rows.unionByName(classes.select("class", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("tid"),
                                               F.lit(0).cast("long").alias("bytes"))), "class-turns")

    large = (F.col("turns") > limit) & (F.col("k") > 1)
    top = F.lit(root["head"]).cast("long")
    placed = classes.select("class", "weight", "len", F.lit(0).cast("long").alias("depth"), top.alias("head"), F.lit(None).cast("long").alias("parent"),
                            F.lit(root["n"]).cast("long").alias("n"), F.lit(0).cast("long").alias("bytes"), F.lit(root["turns"]).cast("long").alias("turns"),
                            F.lit(root["k"]).cast("long").alias("k"), F.array().cast("array<long>").alias("path"))
    containers = spark.range(1, numPartitions=1).select(
        F.lit(0).cast("long").alias("depth"), top.alias("head"), F.lit(None).cast("long").alias("parent"), F.lit(root["n"]).cast("long").alias("n"),
        F.lit(0).cast("long").alias("bytes"), F.lit(root["turns"]).cast("long").alias("turns"), F.lit(root["k"]).cast("long").alias("k"),
        F.array().cast("array<long>").alias("path"))
    swept, leaves, heads, depth = [], [], [], 0
    while True:
        swept.append(placed.where(~large))
        leaves.append(containers.where(~large))
        burst = containers.where(large)
        if burst.isEmpty():
            break
        inside = placed.where(large)
        heads.append(burst.join(inside.where(F.col("len") == depth).select("head", F.col("class").alias("ends"), F.col("weight").alias("n_ends")), "head", "left")
                     .select(*burst.columns, "ends", "n_ends"))
        step = inside.join(rows.where(F.col("pos") == depth).select("class", "tid", F.col("bytes").alias("next_bytes")), "class")
        step = pin(step.select("class", "weight", "len", F.col("head").alias("parent"), "tid", "next_bytes"), "burst")
        depth += 1
        kids = step.groupBy("parent", "tid").agg(
            F.min("class").alias("head"), F.sum("weight").alias("n"), F.max("next_bytes").alias("bytes"),
            F.sum(F.col("len") - depth).alias("turns"), F.count(F.lit(1)).alias("k"))
        paths = burst.select(F.col("head").alias("parent"), F.concat("path", F.array("head")).alias("path"))
        kids = pin(kids.join(paths, "parent"), "containers")
        placed = pin(step.drop("next_bytes").join(kids, ["parent", "tid"]).withColumn("depth", F.lit(depth).cast("long"))
                     .select("class", "weight", "len", "depth", "head", "parent", "n", "bytes", "turns", "k", "path"), "placed")
        containers = kids.withColumn("depth", F.lit(depth).cast("long")).select("depth", "head", "parent", "n", "bytes", "turns", "k", "path")

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out

    classed = union(swept).select("class", "weight", "len", "depth", "head", "parent", "k")
    inside = classed.join(rows, "class").where(F.col("pos") >= F.col("depth") - 1)
    several = inside.where("k > 1").select("depth", "head", "parent", "class", "weight", "pos", "tid", "bytes")
    nodes = several.repartition("depth", "head").sortWithinPartitions("depth", "head", "class", "pos").mapInArrow(_sweep, NODES)
    nodes = pin(nodes.unionByName(_chains(inside.where("k = 1"))), "trie-nodes")
    if heads:
        above = _heads(union(heads), union(leaves), nodes)
        nodes = nodes.unionByName(above)
    shared = seen.join(classes.where("weight > 1"), keys).select("class", "conv")
    digests = _digests(shared).withColumnRenamed("class", "ends")
    alone = F.sha2(F.col("ends").cast("string"), 256)
    digest = F.when(F.col("n_ends").isNull(), F.sha2(F.lit(""), 256)).when(F.col("n_ends") == 1, alone).otherwise(F.col("ends_sha256"))
    return nodes.join(digests, "ends", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                                                       digest.alias("ends_sha256"))


def _chains(rows: DataFrame) -> DataFrame:
    """The nodes of containers with one class, a row each; what a long chain saves is a running sum over blocks of it."""
    cost = (F.col("weight") - 1) * F.col("bytes")
    last = F.col("pos") + 1 == F.col("len")

    def shaped(frame: DataFrame, saved) -> DataFrame:
        return frame.select(
            (F.col("pos") + 1).alias("depth"), F.col("class").alias("conv_id"),
            F.when(F.col("pos") < F.col("depth"), F.col("parent")).otherwise(F.col("class")).alias("parent_conv_id"), F.col("weight").alias("n_convs"),
            F.when(last, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
            saved.cast("long").alias("saved_tokens"), F.when(last, F.col("class")).alias("ends"), F.when(last, F.col("weight")).alias("n_ends"))

    alone = shaped(rows.where("weight = 1"), F.lit(0))
    copies = rows.where("weight > 1").select("class", "weight", "len", "depth", "parent", "pos", cost.alias("cost"))
    total = copies.groupBy(F.col("class").alias("of_class")).agg(F.sum("cost").alias("all"))
    summed = before(copies, ["class"], ["pos"], {"earlier": "cost"}, "chains")
    summed = summed.join(total, F.col("class") == F.col("of_class"))
    return alone.unionByName(shaped(summed, F.col("all") - F.col("earlier")))


def _heads(heads: DataFrame, leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes that burst, with what the containers below them add up to."""
    own = (F.col("n") - 1) * F.col("bytes")
    found = nodes.select(F.col("depth"), F.col("conv_id").alias("head"), "n_leaves", "saved_tokens")
    below = leaves.select("depth", "head", "path").join(found, ["depth", "head"]).select("path", "n_leaves", "saved_tokens")
    at_head = heads.select(F.concat("path", F.array("head")).alias("path"), F.lit(0).cast("long").alias("n_leaves"), own.alias("saved_tokens"))
    sums = (below.unionByName(at_head).select(F.posexplode("path").alias("of_depth", "of_head"), "n_leaves", "saved_tokens")
            .groupBy("of_depth", "of_head").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
    kids = (leaves.select("depth", "parent").unionByName(heads.select("depth", "parent")).where("parent IS NOT NULL")
            .groupBy((F.col("depth") - 1).alias("kid_depth"), F.col("parent").alias("kid_parent")).agg(F.count(F.lit(1)).alias("n_children")))
    joined = heads.join(sums, (F.col("depth") == F.col("of_depth")) & (F.col("head") == F.col("of_head")))
    joined = joined.join(kids, (F.col("depth") == F.col("kid_depth")) & (F.col("head") == F.col("kid_parent")))
    return joined.select("depth", F.col("head").alias("conv_id"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
                         "n_leaves", "saved_tokens", "ends", "n_ends")
