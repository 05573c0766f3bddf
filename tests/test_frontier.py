"""Frontier operators on small states and link graphs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfwatch.operators import frontier as R
from shelfwatch.plans.crawl import closure_of, crawl_closure, expand_frontier, page_edges
from shelfwatch.schemas import CRAWL_STATE

NOW = dt.datetime(2026, 1, 1, 12)


def minutes(n):
    return NOW + dt.timedelta(minutes=n)


@pytest.fixture(scope="module")
def state(spark):
    return spark.createDataFrame([
        (1, "u1", "ACTIVE", minutes(-10), None, 30), (2, "u2", "ACTIVE", minutes(0), None, 60),
        (3, "u3", "ACTIVE", minutes(1), None, 30), (4, "u4", "PAUSED", minutes(-99), None, 30),
        (5, "u5", "ACTIVE", minutes(-10), minutes(-70), 0), (6, "u6", "ACTIVE", None, None, 30)], CRAWL_STATE)


def test_claim_orders_by_wait_then_id(state):
    assert [tuple(r) for r in R.claim_due(state, NOW, 10).collect()] == [(1, "u1"), (5, "u5"), (2, "u2")]
    assert [r["id"] for r in R.claim_due(state, NOW, 2).collect()] == [1, 5]


def test_advance_touches_the_claimed_rows_only(state):
    claimed = R.claim_due(state, NOW, 2)
    after = R.advance_schedule(state, claimed, NOW)
    assert after.schema == state.schema or after.columns == state.columns
    changed = {r["id"]: (r["next_crawled_at"], r["last_crawled_at"]) for r in after.exceptAll(state).collect()}
    assert changed == {1: (minutes(30), NOW), 5: (minutes(0), NOW)}
    assert after.count() == state.count()
    assert {r["id"] for r in R.claimed_rows(state, claimed).collect()} == {1, 5}


def test_worker_batches_are_disjoint(spark):
    rows = [(i, f"u{i}", "ACTIVE", minutes(-(i % 7) - 1), None, 1) for i in range(50)]
    out = R.assign_workers(spark.createDataFrame(rows, CRAWL_STATE), NOW, 12, 3).collect()
    assert len(out) == 36 and len({r["id"] for r in out}) == 36
    assert sorted(r["worker"] for r in out) == [0] * 12 + [1] * 12 + [2] * 12


def test_merge_inserts_unknown_urls_once(spark, state):
    urls = spark.createDataFrame([("u1",), ("n1",), ("n2",), ("n1",), ("n3",)], "url string")
    merged = R.merge_frontier(state, urls, NOW, interval_minutes=90)
    again = R.merge_frontier(merged, urls, NOW)
    fresh = {r["url"]: r for r in merged.where("id > 6").collect()}
    assert set(fresh) == {"n1", "n2", "n3"} and {r["id"] for r in fresh.values()} == {7, 8, 9}
    assert {(r["status"], r["next_crawled_at"], r["last_crawled_at"], r["crawl_interval"]) for r in fresh.values()} == {
        ("ACTIVE", NOW, None, 90)}
    assert again.count() == merged.count() == 9


def test_merge_into_an_empty_state(spark):
    empty = spark.createDataFrame([], CRAWL_STATE)
    merged = R.merge_frontier(empty, spark.createDataFrame([("a",), ("b",)], "url string"), NOW)
    assert {r["id"] for r in merged.collect()} == {1, 2}


def test_numbers_are_consecutive_and_repeatable(spark):
    df = spark.range(5000).select(F.concat(F.lit("u"), "id").alias("url"))
    one = R.number_rows(df, "url", F.lit(100), buckets=64)
    two = R.number_rows(df.repartition(7), "url", F.lit(100), buckets=64)
    assert sorted(r["id"] for r in one.collect()) == list(range(101, 5101))
    assert sorted(one.collect()) == sorted(two.collect())
    with pytest.raises(ValueError):
        R.number_rows(df, "url", F.lit(0), buckets=10)


def page(url, *hrefs):
    return url, "<html>" + "".join(f'<a class="product-item" href="{h}">x</a>' for h in hrefs) + "</html>"


AD = "https://ads.example/"
SITE = [
    page("https://s/a", "/b", "/a", "/b?utm=1", f"{AD}1"),
    page("https://s/b", "https://s/c", f"{AD}2"),
    page("https://s/c", "/a"),
    page("https://s/d", "/e"),
    page("https://s/e", "/f"),
    page("https://s/f?x=1", "/g", ""),
]


@pytest.fixture(scope="module")
def site(spark):
    return spark.createDataFrame(SITE, "url string, html string")


@pytest.fixture(scope="module")
def redirects(spark):
    return spark.createDataFrame([(f"{AD}1", "https://s/d?from=ad"), (f"{AD}3", "https://s/zzz")], "url string, target string")


def urls(df):
    return {r["url"].removeprefix("https://s/") for r in df.collect()}


def test_one_hop(spark, site, redirects):
    visited = spark.createDataFrame([("https://s/a",)], "url string")
    first = site.where("url in ('https://s/a', 'https://s/b')")
    assert urls(expand_frontier(first, visited, redirects, AD)) == {"b", "c", "d"}
    assert urls(expand_frontier(first, visited, None, AD)) == {"b", "c"}
    assert urls(expand_frontier(first, visited)) == {"b", "c", f"{AD}1", f"{AD}2"}


def test_closure(spark, site, redirects):
    seeds = spark.createDataFrame([("https://s/a?seed=1",)], "url string")
    found = crawl_closure(site, seeds, redirects=redirects, redirect_prefix=AD)
    hops = {r["url"].removeprefix("https://s/"): r["hop"] for r in found.collect()}
    assert hops == {"a": 0, "b": 1, "d": 1, "c": 2, "e": 2, "f": 3, "g": 4}
    assert urls(crawl_closure(site, seeds, max_hops=1, redirects=redirects, redirect_prefix=AD)) == {"a", "b", "d"}
    shuffled = site.orderBy(F.desc("url")).repartition(3)
    again = crawl_closure(shuffled, seeds, redirects=redirects, redirect_prefix=AD)
    assert sorted(again.collect()) == sorted(found.collect())


def test_closure_of_a_hub_matches_brute_force(spark):
    """One page holds a third of all links."""
    edges = [(0, i) for i in range(1, 300)] + [(i, (i * 7) % 900) for i in range(600)]
    df = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in edges], "src string, dst string")
    seen, level = {"n5"}, ["n5"]
    while level:
        level = [f"n{b}" for a, b in edges if f"n{a}" in level and f"n{b}" not in seen]
        seen.update(level)
    got = closure_of(df, spark.createDataFrame([("n5",)], "url string")).collect()
    assert {r["url"] for r in got} == seen and len(got) == len(seen)


def test_edges_are_distinct_and_without_self_links(site, redirects):
    edges = {(r["src"][-1], r["dst"][-1]) for r in page_edges(site, redirects, AD).collect()}
    assert edges == {("a", "b"), ("a", "d"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "f"), ("f", "g")}


def test_union(spark):
    a = spark.createDataFrame([("x",), ("y",), ("x",)], "url string")
    b = spark.createDataFrame([("y",), ("z",)], "url string")
    assert sorted(r["url"] for r in R.union_urls(a, b, a).collect()) == ["x", "y", "z"]
