"""Resharding by minimum-cost flow: the fewest bytes that fill new shards from old ones.

Old shards are supplies, new capacities are demands, and a byte costs 1 where it changes its shard
(or what ``cost`` says). The flow is solved on the driver over one number per shard pair, never over
rows. A flow is a block: a stretch of an old shard in the order of its keys. Cuts between blocks are
found as keys (one row per cut), so every row gets its new shard from a broadcast list of at most
(old + new) cuts, and texts are shuffled once, by range, straight into the order of the new files.
Shards that neither lose nor gain rows can be left as they are (``reshard_files``).

Results in special cases: a row of size s is whole on one side of a cut, so a shard misses its capacity
by about one row per block; rows with equal doc_id and text are told apart by file and place in it, so copies of one
row can be cut, between shards as between tasks; NULL doc_ids come first;
a NULL text is size 1 like an empty one; an empty table gives no files and an empty result; empty
old shards and more shards than rows are allowed; input columns named like a result are replaced.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from shelfwatch.llm.common import ROW_FILE, ROW_INDEX, before, columns_of, identified, pin, without
from shelfwatch.session import scratch_path

FILE_BYTES = 128 << 20
RESULTS = ["shard", "slot"]
_ORDER = ["__key", "__hash", ROW_FILE, ROW_INDEX]  # of the rows of a shard
_INNER = [ROW_FILE, ROW_INDEX, "__old", "__size", "__key", "__hash", "__block", "__from", "__cuts"]


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def min_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Flows (i, j) -> amount of least total cost. Successive shortest paths with potentials;
    the sums of supply and demand must agree."""
    m, n = len(supply), len(demand)
    flow: dict[tuple[int, int], int] = {}
    left, need = list(supply), list(demand)
    height = [0] * (m + n)
    while any(left):
        far = [None] * (m + n)
        came = [-1] * (m + n)
        queue = [(0, i) for i in range(m) if left[i]]
        for d, i in queue:
            far[i] = 0
        heapq.heapify(queue)
        done = [False] * (m + n)
        while queue:
            d, u = heapq.heappop(queue)
            if done[u]:
                continue
            done[u] = True
            steps = (((m + j), cost(u, j)) for j in range(n)) if u < m else (
                (i, -cost(i, u - m)) for i in range(m) if flow.get((i, u - m)))
            for v, c in steps:
                step = d + c + height[u] - height[v]
                if not done[v] and (far[v] is None or step < far[v]):
                    far[v], came[v] = step, u
                    heapq.heappush(queue, (step, v))
        end = min((m + j for j in range(n) if need[j] and far[m + j] is not None), key=lambda v: (far[v] + height[v], v))
        top = max(x for x in far if x is not None)
        height = [h + (top if f is None else f) for h, f in zip(height, far)]
        path = [end]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        path.reverse()
        amount = min([left[path[0]], need[end - m], *[flow[v, u - m] for u, v in zip(path, path[1:]) if u >= m]])
        for u, v in zip(path, path[1:]):
            if u < m:
                flow[u, v - m] = flow.get((u, v - m), 0) + amount
            else:
                flow[v, u - m] -= amount
        left[path[0]] -= amount
        need[end - m] -= amount
    return {k: v for k, v in flow.items() if v}


def plan_blocks(old_sizes: list[int], capacities: list[int], cost=None) -> list[tuple[int, int, int, int]]:
    """(old shard, new shard, first byte, last byte + 1), what stays first. The fewest bytes move."""
    flow = min_cost_flow(old_sizes, capacities, cost or (lambda i, j: int(i != j)))
    blocks = []
    for i in range(len(old_sizes)):
        at = 0
        for j in sorted((j for a, j in flow if a == i), key=lambda j: (j != i, j)):
            blocks.append((i, j, at, at + flow[i, j]))
            at += flow[i, j]
    return blocks


def _keyed(docs: DataFrame, old_shard: Column) -> DataFrame:
    rows = identified(docs.select(*columns_of(docs), old_shard.cast("int").alias("__old")))
    return rows.select(*columns_of(docs), "__old", ROW_FILE, ROW_INDEX, row_size(F.col("text")).alias("__size"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("__key"),
                       F.xxhash64("text").alias("__hash"))


def assign(docs: DataFrame, old_shard: Column, old_shards: int, shards: int, cost=None) -> tuple[DataFrame, list]:
    """``docs`` with its new shard (``__block`` orders it inside), and the plan. One narrow pass for the
    sizes, one for the cuts."""
    spark = docs.sparkSession
    keyed = _keyed(docs, old_shard)
    narrow = keyed.select("__old", "__size", *_ORDER)
    sizes = {r[0]: r[1] for r in narrow.groupBy("__old").agg(F.sum("__size")).collect()}  # a row per old shard
    old_sizes = [sizes.get(i, 0) for i in range(old_shards)]
    blocks = plan_blocks(old_sizes, equal_capacities(sum(old_sizes), shards), cost)
    cuts = [(i, b, j) for b, (i, j, start, _) in enumerate(blocks) if start > 0]
    wanted = spark.createDataFrame([(i, blocks[b][2], b) for i, b, _ in cuts] or [], "c_old int, c_at long, c_block int")
    found = {}
    if cuts:
        placed = before(narrow, ["__old"], _ORDER, {"__from": "__size"}, "shards")
        hit = placed.join(F.broadcast(wanted), (F.col("__old") == F.col("c_old")) & (F.col("__from") <= F.col("c_at"))
                          & (F.col("c_at") < F.col("__from") + F.col("__size")))
        right = F.col("__from") * 2 + F.col("__size") >= F.col("c_at") * 2
        found = {r["c_block"]: (tuple(r[c] for c in _ORDER), r["right"]) for r in hit.select("c_block", *_ORDER, right.alias("right")).collect()}
    lists = [(i, [(b, blocks[b][1], *found.get(b, (None, True))) for b in range(len(blocks)) if blocks[b][0] == i]) for i in range(old_shards)]
    held = spark.createDataFrame(
        lists, "__of int, __cuts array<struct<block:int,shard:int,at:struct<key:long,hash:long,file:long,row:long>,own:boolean>>")
    here = F.struct(*[F.col(c).alias(n) for c, n in zip(_ORDER, ("key", "hash", "file", "row"))])

    def later(best: Column, c: Column) -> Column:
        after = (here > c["at"]) | ((here == c["at"]) & c["own"])
        return F.when(c["at"].isNull() | after, F.struct(c["block"].alias("block"), c["shard"].alias("shard"))).otherwise(best)

    nowhere = F.struct(F.lit(None).cast("int").alias("block"), F.lit(None).cast("int").alias("shard"))
    joined = keyed.join(F.broadcast(held), F.col("__old") == F.col("__of"))
    at = F.aggregate("__cuts", nowhere, later)
    marked = joined.withColumn("__at", at)
    return marked.select(*columns_of(docs), *_ORDER, F.col("__at.block").alias("__block"),
                         F.col("__at.shard").alias("shard")), blocks


def write_shards(assigned: DataFrame, total_bytes: int, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Files under ``path/shard=N/``, in the order of blocks and keys; one shuffle by range."""
    parts = max(int(assigned.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // file_bytes))
    order = ["shard", "__block", *_ORDER]
    (assigned.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop(*order[1:])
     .write.partitionBy("shard").parquet(path))


def read_shards(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of the files with shard and slot: the place in the shard, by file number and place in the file.
    The files' starts are written down, so the join knows that they are few and leaves the texts where they are."""
    files = spark.read.schema(schema).parquet(path)
    rows = files.select(*columns_of(files), F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__in"))
    number = F.regexp_extract("__file", "^part-(\\d+)", 1).cast("long")
    counts = rows.groupBy("shard", "__file").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("shard").orderBy(number, "__file").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("shard").alias("__s"), F.col("__file").alias("__f"),
                           F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    joined = rows.join(pin(counts, "starts"), (F.col("shard") == F.col("__s")) & (F.col("__file") == F.col("__f")))
    return joined.select(*[c for c in columns_of(files)], (F.col("__start") + F.col("__in")).cast("long").alias("slot"))


def reshard(docs: DataFrame, old_shard: Column, old_shards: int, shards: int, cost=None,
            file_bytes: int = FILE_BYTES) -> DataFrame:
    """``docs`` written into new shard files of near equal bytes, and read back with shard and slot."""
    spark = docs.sparkSession
    docs = without(docs, [*RESULTS, *_INNER])
    assigned, blocks = assign(docs, old_shard, old_shards, shards, cost)
    path = scratch_path(spark, "shards")
    write_shards(assigned, sum(b[3] - b[2] for b in blocks), path, file_bytes)
    return read_shards(spark, path, assigned.drop(*_ORDER, "__block").schema)


def affected(blocks: list[tuple[int, int, int, int]]) -> set[int]:
    """Shards that lose or gain rows."""
    return {s for i, j, _, _ in blocks if i != j for s in (i, j)}


def reshard_files(spark: SparkSession, old_path: str, old_shards: int, shards: int, cost=None,
                  file_bytes: int = FILE_BYTES) -> list[str]:
    """Reshard files that already lie under ``old_path/shard=N/``. Only affected shards are rewritten;
    returns the folder of every new shard, old or new."""
    docs = spark.read.parquet(old_path)
    assigned, blocks = assign(docs.withColumnRenamed("shard", "__was"), F.col("__was"), old_shards, shards, cost)
    changed = affected(blocks) | set(range(old_shards, shards))
    path = scratch_path(spark, "shards")
    moved = assigned.where(F.col("shard").isin(sorted(changed))).drop("__was")
    write_shards(moved, sum(b[3] - b[2] for b in blocks if b[1] in changed), path, file_bytes)
    return [f"{path if s in changed else old_path}/shard={s}" for s in range(shards)]
