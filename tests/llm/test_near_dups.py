import random
from itertools import combinations

import numpy as np
import pytest
from odd import documents, empty, prose
from pyspark.sql import functions as F

from shelfwatch import session
from shelfwatch.llm import common, components, near_dups


def sets(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(size)]))


def brute(rows, size, percent):
    """doc_id per position -> smallest doc_id reachable."""
    own = [sets(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(own[a] & own[b])
        if own[a] and own[b] and 100 * both >= percent * (len(own[a]) + len(own[b]) - both):
            root[find(b)] = find(a)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(own[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


def edits(base, n, rate, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = base.split()
        for i in rng.sample(range(len(words)), max(1, int(rate * len(words)))):
            words[i] = f"edit{k}x{i}"
        out.append(" ".join(words))
    return out


def check(docs, size, percent):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted(brute(rows, size, percent), key=str)
    got = near_dups.near_duplicates(docs, size, percent).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, size, percent):
    more, at = [], 100
    for base in range(4):
        for rate in (0.01, 0.03, 0.06):
            for text in edits(prose(120, 50 + base), 6, rate, base):
                more.append((at, text, "en", "a"))
                at += 1
    check(documents(spark, more), size, percent)


def test_large_cluster_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK_ROWS", 8)
    base = prose(100, 77)
    more = [(200 + i, t, "en", "a") for i, t in enumerate(edits(base, 40, 0.02, 5) + edits(base, 30, 0.05, 6))]
    check(documents(spark, more), 3, 85)


def test_dedupe_keeps_one_of_each(spark):
    docs = documents(spark, [(3, prose(80, 2), "en", None)])
    out = near_dups.dedupe(docs, 3, 85)
    assert out.columns == docs.columns
    ids = sorted((r["doc_id"] for r in out.collect()), key=str)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    groups = {c if n else ("alone", i) for i, (_, n, c) in enumerate(brute(rows, 3, 85))}
    # A group of rows without doc_id has no name, but one row of it stays.
    assert len(ids) == len(groups) + 1 and ids.count(3) == 2  # two groups bear the name 3
    assert near_dups.near_duplicates(empty(spark)).count() == 0
    assert near_dups.dedupe(empty(spark)).count() == 0


def test_signature_estimate():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 32, near_dups.HASHES, dtype=np.uint64).astype(np.uint32)
    b = a.copy()
    b[: near_dups.HASHES // 4] ^= 1
    one, two = (np.frombuffer(near_dups.signature(x), np.uint64) for x in (a, b))
    assert near_dups.equal_lanes(one, two[None])[0] == near_dups.HASHES * 3 // 4
    assert abs(near_dups.similarity(0.75) - (0.75 - 1 / 16) / (1 - 1 / 16)) < 1e-12


def test_links_are_not_pairs(spark):
    base = prose(100, 5)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(edits(base, 60, 0.01, 9))], "doc_id long, text string")
    rows = near_dups.identified(docs)
    classes = near_dups.sketches(rows, 3, 85).withColumn("id", F.monotonically_increasing_id())
    members = near_dups.pin(classes.join(near_dups.clusters(near_dups.pin(classes, "c")), "id").join(
        rows.select(near_dups.ROW_FILE, near_dups.ROW_INDEX, "text"), [near_dups.ROW_FILE, near_dups.ROW_INDEX]), "m")
    assert members.count() == 60


def test_banding_holds_the_bound():
    assert near_dups.banding(85) == (25, 5) and near_dups.banding(80) == (32, 4)


def test_exploded_bands_are_not_broadcast(spark, monkeypatch):
    """A table of bands is many times what the optimizer takes it for after the explode."""
    classes = near_dups.pin(spark.range(300).withColumn("bands", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.xxhash64(F.floor(F.col("id") / 3), i))), "classes")
    plans = []
    monkeypatch.setattr(near_dups, "connected", lambda links, a, b: plans.append(links._jdf.queryExecution().toString()) or components.connected(links, a, b))
    found = {(r["id"], r["cluster"]) for r in near_dups.clusters(classes).collect()}
    assert found == {(i, i // 3 * 3) for i in range(300)}
    assert "BroadcastExchange" not in plans[0] and "SortMergeJoin" in plans[0]


def test_large_written_tables_are_joined_by_sorting(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    plans = []
    monkeypatch.setattr(components, "pin", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or common.pin(df, name))
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9], "a long, b long")
    assert {(r["node"], r["root"]) for r in components.connected(links, "a", "b").collect()} == {(i, i // 10 * 10) for i in range(40)}
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastExchange" in p for p in plans)
    check(documents(spark, [(100 + i, t, "en", "a") for i, t in enumerate(edits(prose(120, 50), 6, 0.01, 1))]), 3, 85)
