"""Redirect chains end where a browser ends."""

import os
import random

from shelfwatch.operators.frontier import redirect_ends, resolve_redirects
from shelfwatch.session import scratch_path

AD = "ad:"


def plain(rows):
    step = {}
    for url, target in rows:
        if url is not None and target is not None and url.startswith(AD):
            step.setdefault(url, set()).add(target)
    ends = set()
    for url in step:
        seen, todo = set(), [url]
        while todo:
            at = todo.pop()
            for target in step.get(at, ()):
                if not target.startswith(AD):
                    ends.add((url, target))
                elif target not in seen:
                    seen.add(target)
                    todo.append(target)
    return ends


def ends_of(spark, rows):
    return {tuple(r) for r in redirect_ends(spark.createDataFrame(rows, "url string, target string"), AD).collect()}


def test_chain_cycle_and_hot_target(spark):
    rows = [(f"{AD}{i}", f"{AD}{i + 1}") for i in range(10)] + [(f"{AD}10", "http://end")]
    rows += [(f"{AD}c{i}", f"{AD}c{(i + 1) % 7}") for i in range(7)] + [(f"{AD}in", f"{AD}c3")]  # a cycle, and a way into it
    rows += [(f"{AD}self", f"{AD}self"), (f"{AD}lost", f"{AD}nowhere"), (f"{AD}null", None), (None, "x"), ("plain", "http://other")]
    rows += [(f"{AD}h{i}", f"{AD}0") for i in range(300)]  # a hot target
    rows += rows[:20]
    got = ends_of(spark, rows)
    assert got == plain(rows) and len(got) == 311


def test_random_graphs_with_several_targets(spark):
    for seed in range(3):
        rng = random.Random(seed)
        node = lambda: f"{AD}{rng.randrange(40)}" if rng.random() < 0.85 else f"http://{rng.randrange(6)}"
        rows = [(f"{AD}{rng.randrange(40)}", node()) for _ in range(45)]
        assert ends_of(spark, rows) == plain(rows)


def test_rounds_follow_the_logarithm(spark, monkeypatch):
    from shelfwatch.operators import frontier

    paths = []
    monkeypatch.setattr(frontier, "scratch_path", lambda s, n: paths.append(scratch_path(s, n)) or paths[-1])
    rows = [(f"{AD}{i}", f"{AD}{i + 1}") for i in range(40)] + [(f"{AD}40", "http://end")]
    assert ends_of(spark, rows) == {(f"{AD}{i}", "http://end") for i in range(41)}
    assert max(int(name.split("-")[1]) for name in os.listdir(paths[0]) if name.startswith("jumps-")) <= 6


def test_resolve_takes_ends(spark):
    links = spark.createDataFrame([(f"{AD}1",), (f"{AD}x",), ("http://plain",), (f"{AD}1",)], "href string")
    table = spark.createDataFrame([(f"{AD}1", f"{AD}2"), (f"{AD}2", "http://shop"), (f"{AD}x", f"{AD}x")], "url string, target string")
    got = resolve_redirects(links, table, AD).collect()
    assert sorted(tuple(r) for r in got) == [(f"{AD}1", "http://shop"), ("http://plain", "http://plain")]
