import zlib
from itertools import product

from hypothesis import given, settings, strategies as st
from odd import documents, empty, prose
from pyspark.sql import functions as F

from shelfwatch.llm import sharding


def test_rows_sizes_and_slots(spark):
    docs = documents(spark, [(100 + i, prose(5 + i % 40, i), "en", f"s{i % 3}") for i in range(300)])
    old = F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(6))
    got = sharding.reshard(docs, old, 6, 8).collect()
    key = lambda r: (str(r["doc_id"]), zlib.crc32((r["text"] or "").encode()))
    assert sorted(map(key, got)) == sorted(map(key, docs.collect()))
    assert {r["a.b"] for r in got} == {1.5}
    sizes, slots = [0] * 8, [[] for _ in range(8)]
    for r in got:
        sizes[r["shard"]] += len((r["text"] or "").encode()) + 1
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    mean, most = sum(sizes) / 8, max(len((r["text"] or "").encode()) for r in got)
    assert all(abs(s - mean) <= 2 * most for s in sizes)


def test_even_shards_without_a_huge_document(spark):
    docs = spark.createDataFrame([(i, prose(30, i), f"s{i % 3}") for i in range(2000)], "doc_id long, text string, source string")
    got = sharding.reshard(docs, F.pmod(F.crc32("source"), F.lit(6)), 6, 8)
    sizes = [r[1] for r in got.groupBy("shard").agg(F.sum(sharding.row_size(F.col("text")))).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 0.02 * max(sizes)


def test_more_shards_than_rows_and_none(spark):
    few = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, None, None)], "doc_id long, text string, source string")
    got = sharding.reshard(few, F.lit(0), 1, 8).collect()
    assert len(got) == 3 and all(r["slot"] >= 0 for r in got)
    assert sharding.reshard(empty(spark), F.lit(0), 6, 8).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=3), st.integers(1, 3), st.lists(st.integers(0, 3), min_size=9, max_size=9))
def test_flow_is_of_least_cost(old, shards, prices):
    new = sharding.equal_capacities(sum(old), shards)
    cost = lambda i, j: prices[3 * i + j]
    flow = sharding.min_cost_flow(old, new, cost)
    assert [sum(v for (i, _), v in flow.items() if i == a) for a in range(len(old))] == old
    assert [sum(v for (_, j), v in flow.items() if j == b) for b in range(shards)] == new

    def best(rest, need):
        if not rest:
            return 0
        i = len(old) - len(rest)
        return min((sum(n * cost(i, j) for j, n in enumerate(split)) + best(rest[1:], tuple(x - y for x, y in zip(need, split)))
                    for split in product(*[range(min(rest[0], x) + 1) for x in need]) if sum(split) == rest[0]), default=10 ** 9)

    assert sum(v * cost(i, j) for (i, j), v in flow.items()) == best(tuple(old), tuple(new))


def test_stays_are_kept():
    blocks = sharding.plan_blocks([100, 40, 60], [50, 50, 50, 50])
    assert sum(b[3] - b[2] for b in blocks if b[0] == b[1]) == 50 + 40 + 50
    assert sharding.affected(sharding.plan_blocks([50, 50, 80, 0], [50, 50, 50, 30])) == {2, 3}


def test_only_affected_files_are_rewritten(spark, tmp_path):
    rows = [(i, "x" * 9, 0 if i < 50 else 1 if i < 100 else 2) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, shard int").write.partitionBy("shard").parquet(str(tmp_path / "old"))
    folders = sharding.reshard_files(spark, str(tmp_path / "old"), 3, 4)
    assert folders[:2] == [f"{tmp_path}/old/shard={i}" for i in range(2)] and "old" not in folders[2].rsplit("/", 2)[-2]
    got = [{r["doc_id"] for r in spark.read.parquet(f).collect()} for f in folders]
    assert [len(g) for g in got] == [50] * 4 and set().union(*got) == set(range(200))


def test_copies_without_id_are_cut(spark, tmp_path):
    """A third of the rows is one text without doc_id: its copies go to several shards, and all stay near equal."""
    rows = [(None, "copy of one long line " * 20)] * 300 + [(i, prose(40 + i % 30, i)) for i in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    out = sharding.reshard(docs, F.lit(0), 1, 8).withColumn("size", sharding.row_size(F.col("text")))
    assert sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, docs.collect()))
    sizes = [r["b"] for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2 * max(len(t) + 1 for _, t in rows)
    assert out.where("doc_id IS NULL").select("shard").distinct().count() >= 2


def test_reading_shards_back_shuffles_no_texts(spark):
    """Only the write shuffles texts: the plan over the files joins them with the starts without an exchange."""
    docs = spark.createDataFrame([(i, prose(30, i), f"s{i % 3}") for i in range(500)], "doc_id long, text string, source string")
    out = sharding.reshard(docs, F.pmod(F.crc32("source"), F.lit(6)), 6, 8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and out.count() == 500
