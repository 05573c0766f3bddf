"""Discovery: one hop of the frontier, and everything reachable; the refresh step."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from shelfwatch.functions.text import normalize_url
from shelfwatch.operators.extract import extract_links
from shelfwatch.operators.frontier import advance_schedule, claim_due, merge_frontier, resolve_redirects, unseen_urls, with_targets
from shelfwatch.session import scratch_path


def link_targets(links: DataFrame, redirects: DataFrame | None = None,
                 redirect_prefix: str | None = None) -> DataFrame:
    """Distinct normalised URLs that the links lead to."""
    targets = resolve_redirects(links, redirects, redirect_prefix)
    return targets.select(normalize_url(F.col("target")).alias("url")).distinct()


def expand_frontier(
    pages: DataFrame,
    visited: DataFrame,
    redirects: DataFrame | None = None,
    redirect_prefix: str | None = None,
    class_token: str | None = "product-item",
    resolve: bool = True,
) -> DataFrame:
    """New URLs one hop away from ``pages (url, html)``, given the ``visited`` ones."""
    links = extract_links(pages, class_token=class_token, resolve=resolve)
    return unseen_urls(link_targets(links, redirects, redirect_prefix), visited)


def page_edges(
    pages: DataFrame,
    redirects: DataFrame | None = None,
    redirect_prefix: str | None = None,
    class_token: str | None = "product-item",
    resolve: bool = True,
) -> DataFrame:
    """Distinct ``(src, dst)`` links between normalised URLs."""
    links = extract_links(pages, class_token=class_token, resolve=resolve)
    reached = with_targets(links.select("page", "href").distinct(), redirects, redirect_prefix)
    edges = reached.select(normalize_url(F.col("page")).alias("src"),
                           normalize_url(F.col("target")).alias("dst"))
    return edges.where(F.col("src") != F.col("dst")).distinct()


def closure_of(edges: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """URLs reachable from ``seeds (url)`` over ``edges (src, dst)``, with the hop they appear at.

    Breadth first, one job per hop. Edges and hops are written as tables to shared storage: a
    hop reads finished files instead of a growing lineage, parsing happens once, and a lost
    executor costs its tasks only. Edges lie in buckets of ``src``, so a hop shuffles its frontier and
    not the edges. The driver sees one flag per hop.
    """
    spark = edges.sparkSession
    root = scratch_path(spark, "closure")
    edge_path, hop_path = f"{root}/edges", f"{root}/hops"
    name = "edges_" + root.rsplit("-", 1)[-1]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (edges.repartition(buckets, "src").write.bucketBy(buckets, "src").sortBy("src")
     .option("path", edge_path).saveAsTable(name))
    try:
        return _hops(spark.table(name), seeds, max_hops, hop_path)
    finally:
        spark.sql(f"DROP TABLE {name}")  # the entry only; the files are the caller's to clean up


def _hops(edges: DataFrame, seeds: DataFrame, max_hops: int | None, hop_path: str) -> DataFrame:
    spark = edges.sparkSession

    def write_hop(df, hop):
        df.write.parquet(f"{hop_path}/hop={hop}")

    def read_hops(*path):
        reader = spark.read.option("basePath", hop_path)
        return reader.schema("url string, hop int").parquet(*path)

    start = seeds.select(normalize_url(F.col("url")).alias("url")).distinct()
    write_hop(start, 0)
    hop = 0
    while max_hops is None or hop < max_hops:
        frontier = read_hops(f"{hop_path}/hop={hop}")
        if frontier.isEmpty():
            break
        reached = edges.join(frontier, edges["src"] == frontier["url"]).select(F.col("dst").alias("url"))
        hop += 1
        write_hop(unseen_urls(reached, read_hops(hop_path)), hop)
    return read_hops(hop_path)


def crawl_closure(pages: DataFrame, seeds: DataFrame, max_hops: int | None = None, **links) -> DataFrame:
    """URLs reachable from the seeds over the links of a page table, page by page."""
    return closure_of(page_edges(pages, **links), seeds, max_hops)


def discover(state: DataFrame, pages: DataFrame, seeds: DataFrame, now: datetime | Column, state_path: str,
             max_hops: int | None = None, interval_minutes: int = 1440, **links) -> DataFrame:
    """Everything reachable from the seeds, inserted into the crawl state where it is new.

    The new state is written to ``state_path``, which must not be where ``state`` is read from, and
    returned as read back. Running it again inserts nothing.
    """
    found = crawl_closure(pages, seeds, max_hops, **links)
    merge_frontier(state, found, now, interval_minutes=interval_minutes).write.parquet(state_path)
    return state.sparkSession.read.parquet(state_path)


def refresh_step(state: DataFrame, now: datetime | Column, n: int, batch_path: str, state_path: str,
                 status: str = "ACTIVE") -> tuple[DataFrame, DataFrame]:
    """Claim the ``n`` rows due longest and reschedule exactly these: (claimed rows, new state).

    The claimed rows are written before the new state is made from them, so neither changes when
    it is evaluated again. Both paths must be new. The caller crawls the claimed rows, and
    ``to_messages`` takes the pages on; the next step starts from the new state and claims others.
    """
    spark = state.sparkSession
    claim_due(state, now, n, status).write.parquet(batch_path)
    claimed = spark.read.parquet(batch_path)
    advance_schedule(state, claimed, now).write.parquet(state_path)
    return claimed, spark.read.parquet(state_path)
