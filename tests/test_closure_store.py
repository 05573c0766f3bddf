"""A kept closure, updated from added links, is what a full run gives."""

import random

import pytest
from pyspark.sql import functions as F

from shelfwatch.plans import closure_store as C


def plain(edges, seeds):
    hops, todo = {s: 0 for s in seeds}, list(seeds)
    while todo:
        at = todo.pop(0)
        for a, b in edges:
            if a == at and b not in hops:
                hops[b] = hops[at] + 1
                todo.append(b)
    return hops


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def seeds_of(spark, urls):
    return spark.createDataFrame([(u,) for u in urls], "url string")


def rows(df):
    return {r["url"]: r["hop"] for r in df.collect()}


def test_updates_equal_a_full_run(spark, tmp_path):
    rng = random.Random(5)
    edges = [(f"u{rng.randrange(60)}", f"u{rng.randrange(60)}") for _ in range(110)]
    edges = [e for e in edges if e[0] != e[1]]
    path = str(tmp_path / "store")
    assert rows(C.start_closure(frame(spark, edges[:50]), seeds_of(spark, ["u0"]), path, buckets=8)) == plain(edges[:50], ["u0"])
    assert rows(C.add_to_closure(frame(spark, edges[50:90]), path)) == plain(edges[:90], ["u0"])
    more = frame(spark, [*edges[90:], edges[90], (None, "u1"), ("u1", None), ("", "u1")])
    assert rows(C.add_to_closure(more, path, seeds_of(spark, ["u59?x=1"]))) == plain(edges, ["u0", "u59"])
    assert rows(C.add_to_closure(frame(spark, edges[:5]), path)) == plain(edges, ["u0", "u59"])  # nothing new


def test_shorter_way_lowers_all_that_follows(spark, tmp_path):
    chain = [(f"u{i}", f"u{i + 1}") for i in range(9)]
    path = str(tmp_path / "store")
    C.start_closure(frame(spark, chain), seeds_of(spark, ["u0"]), path, buckets=4)
    got = rows(C.add_to_closure(frame(spark, [("u0", "u6"), ("u5", "u2"), ("lost", "u1")]), path))
    assert got == plain([*chain, ("u0", "u6")], ["u0"]) and got["u9"] == 4


def test_hub_takes_several_files_and_no_seed_gives_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    hub = [("hub", f"u{i}") for i in range(3000)]
    got = C.start_closure(frame(spark, hub), seeds_of(spark, ["hub"]), path, buckets=4)
    assert got.count() == 3001
    assert C.start_closure(frame(spark, hub), seeds_of(spark, []), str(tmp_path / "none"), buckets=4).count() == 0
    with pytest.raises(ValueError):
        C.add_to_closure(frame(spark, hub), str(tmp_path / "missing"))


def test_an_update_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    chain = [(f"u{i}", f"u{i + 1}") for i in range(6)]
    path = str(tmp_path / "store")
    before = rows(C.start_closure(frame(spark, chain), seeds_of(spark, ["u0"]), path, buckets=4))
    monkeypatch.setattr(C, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        C.add_to_closure(frame(spark, [("u0", "u5"), ("u0", "x")]), path)
    monkeypatch.undo()
    assert rows(C.read_closure(spark, path)) == before
    assert rows(C.add_to_closure(frame(spark, [("u0", "y")]), path)) == {**before, "y": 1}


def test_update_reads_only_the_buckets_it_needs(spark, tmp_path, monkeypatch):
    """Links of sources that keep their hop are not scanned: the folders of their buckets are pruned."""
    edges = [(f"u{i // 3}", f"u{i + 1}") for i in range(600)]
    path = str(tmp_path / "store")
    C.start_closure(frame(spark, edges), seeds_of(spark, ["u0"]), path, buckets=64)
    read = []
    original = C._edges

    def watched(spark, path, loads, touched=None):
        found = original(spark, path, loads, touched)
        read.append((touched, found._jdf.queryExecution().executedPlan().toString(), found.select(F.input_file_name()).distinct().count()))
        return found

    monkeypatch.setattr(C, "_edges", watched)
    C.add_to_closure(frame(spark, [("u599", "new1"), ("new1", "new2")]), path)
    assert len(read) == 2 and all(len(touched) == 1 for touched, _, _ in read)
    assert all("PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] for _, plan, _ in read)
    assert all(files <= 4 for _, _, files in read)
