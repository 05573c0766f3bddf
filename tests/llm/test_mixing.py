from collections import defaultdict

from odd import documents, empty, prose
from pyspark.sql import functions as F

from shelfwatch.llm import mixing


def targets(sizes, weights=(1, 2, 3), cap=3):
    """Water filling, step by step."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        for s in over or free:
            out[s] = cap * sizes[s] if over else level * weight[s]
        left -= sum(out[s] for s in over)
        free = free - over if over else set()
    return out


def sized(docs):
    return docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))


def test_targets_and_copies(spark):
    more = [(100 + i, prose(5 + i % 50, i), "en", f"s{i % 7}" if i % 3 else "hot") for i in range(400)]
    docs = documents(spark, more)
    rows = mixing.plan_copies(sized(docs)).collect()
    again = mixing.plan_copies(sized(docs.repartition(7))).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == docs.count()
    sizes, taken, most, doc_target = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        doc_target[r["source"]] = r["target"]
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
    want = targets(dict(sizes))
    for s in sizes:
        assert abs(doc_target[s] - want[s]) <= 1e-9 * max(1, want[s])
        assert abs(taken[s] - want[s]) <= 2 * most[s]
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6


def test_mix_emits_the_copies(spark):
    docs = documents(spark)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    drawn = defaultdict(int)
    for r in mixing.plan_copies(sized(docs)).collect():
        drawn[r["doc_id"]] += r["copies"]
    got = defaultdict(int)
    for r in out.collect():
        got[r["doc_id"]] += 1
    assert {k: v for k, v in drawn.items() if v} == dict(got)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.plan_copies(sized(empty(spark))).count() == 0


def test_no_words_at_all(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r["target"], r["taken"]) for r in mixing.plan_copies(sized(docs)).collect()} == {(0.0, 0)}
