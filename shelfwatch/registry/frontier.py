"""The crawl frontier, on orders as crawl state and on the links of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwatch.functions.text import normalize_url
from shelfwatch.operators import frontier as R
from shelfwatch.operators.extract import extract_links
from shelfwatch.plans.closure_store import add_to_closure, start_closure
from shelfwatch.plans.crawl import crawl_closure, discover, expand_frontier, page_edges, refresh_step
from shelfwatch.registry import query
from shelfwatch.registry.tables import (
    SQL_DISCOVERED,
    SQL_STATE,
    crawl_state,
    discovered_urls,
    instant,
    sql_stamp,
    stamp,
    table,
)
from shelfwatch.session import scratch_path

_NOW = "1997-01-01 00:00:00"
_SQL_DUE = f"""
SELECT * FROM state WHERE status = 'ACTIVE' AND next_at <= TIMESTAMP '{_NOW}' ORDER BY next_at, id"""

@query("due_urls", f"WITH {SQL_STATE} SELECT id, url FROM ({_SQL_DUE} LIMIT 500)")
def due_urls(spark, d):
    return R.claim_due(crawl_state(spark, d), instant(_NOW), 500)


@query("advance_schedule", f"""
WITH {SQL_STATE}, claimed AS ({_SQL_DUE} LIMIT 500)
SELECT s.id, s.url, s.status, s.every,
       {sql_stamp(f"CASE WHEN c.id IS NULL THEN s.next_at ELSE TIMESTAMP '{_NOW}' + to_minutes(s.every) END")} AS next_at,
       {sql_stamp(f"CASE WHEN c.id IS NULL THEN s.last_at ELSE TIMESTAMP '{_NOW}' END")} AS last_at
FROM state s LEFT JOIN claimed c ON s.id = c.id""")
def advance_schedule(spark, d):
    state = crawl_state(spark, d)
    moved = R.advance_schedule(state, R.claim_due(state, instant(_NOW), 500), instant(_NOW))
    return moved.select("id", "url", "status", F.col("crawl_interval").alias("every"),
                        stamp("next_crawled_at").alias("next_at"), stamp("last_crawled_at").alias("last_at"))


@query("worker_batches", f"""
WITH {SQL_STATE}, claimed AS ({_SQL_DUE} LIMIT 600)
SELECT id, url, CAST((row_number() OVER (ORDER BY next_at, id) - 1) // 200 AS INTEGER) AS worker FROM claimed""")
def worker_batches(spark, d):
    return R.assign_workers(crawl_state(spark, d), instant(_NOW), 200, 3)


@query("claimed_rows", f"""
WITH {SQL_STATE}, claimed AS ({_SQL_DUE} LIMIT 500)
SELECT id, status, {sql_stamp('next_at')} AS next_at FROM state WHERE id IN (SELECT id FROM claimed)""")
def claimed_rows(spark, d):
    state = crawl_state(spark, d)
    rows = R.claimed_rows(state, R.claim_due(state, instant(_NOW), 500))
    return rows.select("id", "status", stamp("next_crawled_at").alias("next_at"))


@query("new_urls", f"""
WITH {SQL_STATE}, {SQL_DISCOVERED}
SELECT url FROM discovered WHERE url NOT IN (SELECT url FROM state)""")
def new_urls(spark, d):
    return R.unseen_urls(discovered_urls(spark, d), crawl_state(spark, d))


@query("url_union", f"""
WITH {SQL_STATE}, {SQL_DISCOVERED}
SELECT url FROM discovered UNION SELECT url FROM state
UNION SELECT split_part(url, '?', 1) FROM pages""")
def url_union(spark, d):
    pages = table(spark, d, "pages").select(normalize_url(F.col("url")).alias("url"))
    return R.union_urls(discovered_urls(spark, d), crawl_state(spark, d), pages)


@query("merge_frontier", f"""
WITH {SQL_STATE}, {SQL_DISCOVERED},
fresh AS (SELECT url FROM discovered WHERE url NOT IN (SELECT url FROM state))
SELECT url, status, {sql_stamp('next_at')} AS next_at, every, TRUE AS known FROM state
UNION ALL
SELECT url, 'ACTIVE', '{_NOW}', 1440, FALSE FROM fresh""")
def merge_frontier(spark, d):
    """New ids depend on a hash and are left out; that they follow the old ones is shown."""
    state = crawl_state(spark, d)
    merged = R.merge_frontier(state, discovered_urls(spark, d), instant(_NOW))
    highest = state.agg(F.max("id")).scalar()
    return merged.select("url", "status", stamp("next_crawled_at").alias("next_at"),
                         F.col("crawl_interval").alias("every"), (F.col("id") <= highest).alias("known"))


_SQL_ROOTED = """links AS (
    SELECT url AS page, regexp_extract(url, '^(https?://[^/]+)', 1) || href AS href FROM (
        SELECT url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
    WHERE href <> '')"""


@query("link_frontier", f"""
WITH {_SQL_ROOTED}
SELECT DISTINCT split_part(href, '?', 1) AS url FROM links
WHERE split_part(href, '?', 1) NOT IN (SELECT split_part(url, '?', 1) FROM pages)""")
def link_frontier(spark, d):
    pages = table(spark, d, "pages")
    visited = pages.select(normalize_url(F.col("url")).alias("url"))
    return expand_frontier(pages, visited, class_token=None)


def _redirects(spark, d):
    """Targets of secure links whose address has even length; the others stay unresolved."""
    links = extract_links(table(spark, d, "pages"), class_token=None)
    known = links.where(F.startswith("href", F.lit("https://")) & (F.length("href") % 2 == 0))
    target = F.regexp_replace("href", "^https://", "http://landing.")
    return known.select(F.col("href").alias("url"), F.concat(target, F.lit("?from=ad")).alias("target")).distinct()


@query("link_frontier_redirects", f"""
WITH {_SQL_ROOTED},
resolved AS (
    SELECT href AS target FROM links WHERE NOT starts_with(href, 'https://')
    UNION SELECT 'http://landing.' || substr(href, 9) FROM links
    WHERE starts_with(href, 'https://') AND length(href) % 2 = 0)
SELECT DISTINCT split_part(target, '?', 1) AS url FROM resolved
WHERE split_part(target, '?', 1) NOT IN (SELECT split_part(url, '?', 1) FROM pages)""")
def link_frontier_redirects(spark, d):
    pages = table(spark, d, "pages")
    visited = pages.select(normalize_url(F.col("url")).alias("url"))
    return expand_frontier(pages, visited, _redirects(spark, d), "https://", class_token=None)


_CHAIN = 10


@query("link_frontier_chains", f"""
WITH {SQL_STATE},
ends AS (SELECT DISTINCT l_partkey AS k, l_partkey // {_CHAIN} * {_CHAIN} + {_CHAIN} AS k_end FROM lineitem WHERE l_returnflag = 'R')
SELECT DISTINCT 'https://shop.example/p' || CAST(target AS VARCHAR) AS url FROM (
    SELECT l_partkey AS target FROM lineitem WHERE l_returnflag <> 'R'
    UNION SELECT k_end FROM ends WHERE (k // {_CHAIN}) % 7 NOT IN (3, 5))
WHERE 'https://shop.example/p' || CAST(target AS VARCHAR) NOT IN (SELECT url FROM state)""")
def link_frontier_chains(spark, d):
    """Ads that lead to the ad of the next product, ten in a row, the last to a product. Of every seven chains one ends
    in a cycle and one at an ad that is not known."""
    part, chain = F.col("p_partkey"), F.floor(F.col("p_partkey") / _CHAIN)
    last = part % _CHAIN == _CHAIN - 1
    ad = lambda n: F.concat(F.lit("https://ads.example/"), n.cast("string"))
    end = (F.when(chain % 7 == 3, ad(chain * _CHAIN)).when(chain % 7 == 5, ad(-part))
           .otherwise(F.concat(F.lit("https://shop.example/p"), (part + 1).cast("string"), F.lit("?ad=1"))))
    # The last chain of the table may be cut off, so it is filled up.
    rows = table(spark, d, "part").select("p_partkey").unionByName(
        table(spark, d, "part").groupBy().agg(F.max("p_partkey").alias("p")).select(
            F.explode(F.sequence(F.lit(0), F.lit(_CHAIN))).alias("i"), "p").select((F.col("p") + F.col("i")).alias("p_partkey"))).distinct()
    redirects = rows.select(ad(part).alias("url"), F.when(last, end).otherwise(ad(part + 1)).alias("target"))
    return expand_frontier(_listing_pages(spark, d), crawl_state(spark, d), redirects, "https://ads.example/")


def _listing_pages(spark, d):
    """A listing page per order line: its product as a marked link, directly or through an ad."""
    part = F.col("l_partkey").cast("string")
    href = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("https://ads.example/"), part)).otherwise(
        F.concat(F.lit("/p"), part, F.lit("?seller="), F.col("l_suppkey").cast("string")))
    html = F.concat(F.lit('<div><a class="product-item wide" href="'), href,
                    F.lit('">product</a><a class="menu" href="/home">home</a></div>'))
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("https://shop.example/o"), F.col("l_orderkey").cast("string")).alias("url"), html.alias("html"))


@query("product_link_frontier", f"""
WITH {SQL_STATE},
reached AS (
    SELECT l_partkey FROM lineitem WHERE l_returnflag <> 'R'
    UNION SELECT l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey
          WHERE l_returnflag = 'R' AND p_size >= 10)
SELECT 'https://shop.example/p' || CAST(l_partkey AS VARCHAR) AS url FROM reached
WHERE 'https://shop.example/p' || CAST(l_partkey AS VARCHAR) NOT IN (SELECT url FROM state)""")
def product_link_frontier(spark, d):
    """Marked links only; ads of small parts have no known target and are dropped."""
    part = F.col("p_partkey").cast("string")
    redirects = table(spark, d, "part").where(F.col("p_size") >= 10).select(
        F.concat(F.lit("https://ads.example/"), part).alias("url"),
        F.concat(F.lit("https://shop.example/p"), part, F.lit("?ad=1")).alias("target"))
    return expand_frontier(_listing_pages(spark, d), crawl_state(spark, d), redirects, "https://ads.example/")


@query("crawl_closure", """
WITH RECURSIVE links AS (
    SELECT split_part(url, '?', 1) AS page, split_part(href, '?', 1) AS href FROM (
        SELECT url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
    WHERE href <> ''),
edges AS (SELECT page AS src, href AS dst FROM links UNION SELECT href, page FROM links),
reach(url) AS (
    SELECT split_part(url, '?', 1) FROM pages WHERE page_id = (SELECT min(page_id) FROM pages)
    UNION
    SELECT dst FROM reach JOIN edges ON src = url)
SELECT url FROM reach""")
def closure_query(spark, d):
    """Everything reachable from the first page, when each link target lists its pages in turn."""
    site, first = _two_way_site(spark, d)
    return crawl_closure(site, first, class_token=None, resolve=False).select("url")


def _two_way_site(spark, d, prefix=""):
    """The pages' links as a site of plain pages, with a listing for every target; and the first page."""
    pages = table(spark, d, "pages")
    links = extract_links(pages, class_token=None, resolve=False).select(
        normalize_url(F.col("page")).alias("page"), normalize_url(F.col("href")).alias("href"))
    anchor = lambda to: F.concat(F.lit(f'<a href="{prefix}'), F.col(to), F.lit('">go</a>'))
    site = links.select(F.col("page").alias("url"), anchor("href").alias("html")).unionByName(
        links.select(F.col("href").alias("url"), anchor("page").alias("html")))
    return site, pages.groupBy().agg(F.min_by("url", "page_id").alias("url"))


_SQL_REACH = """links AS (
    SELECT split_part(url, '?', 1) AS page, split_part(href, '?', 1) AS href FROM (
        SELECT url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
    WHERE href <> ''),
edges AS (SELECT page AS src, href AS dst FROM links UNION SELECT href, page FROM links),
reach(url) AS (
    SELECT split_part(url, '?', 1) FROM pages WHERE page_id = (SELECT min(page_id) FROM pages)
    UNION
    SELECT dst FROM reach JOIN edges ON src = url)"""


@query("crawl_closure_added", f"""
WITH RECURSIVE {_SQL_REACH},
steps(url, hop) AS (
    SELECT split_part(url, '?', 1), 0 FROM pages WHERE page_id = (SELECT min(page_id) FROM pages)
    UNION
    SELECT dst, hop + 1 FROM steps JOIN edges ON src = url WHERE hop < 12)
SELECT url, CAST(min(hop) AS INTEGER) AS hop FROM steps GROUP BY url""")
def closure_added(spark, d):
    """The same site when two thirds of its links are known at first and the rest comes in two updates: every hop as in one run."""
    site, first = _two_way_site(spark, d)
    edges = page_edges(site, class_token=None, resolve=False)
    part = F.pmod(F.xxhash64("src", "dst"), F.lit(6))
    path = scratch_path(spark, "closure-store")
    start_closure(edges.where(part < 4), first, path, buckets=16)
    add_to_closure(edges.where(part == 4), path)
    return add_to_closure(edges.where(part == 5), path)


@query("discover", f"""
WITH RECURSIVE {_SQL_REACH},
known AS (SELECT split_part(url, '?', 1) AS url FROM pages WHERE page_id % 2 = 0)
SELECT url, FALSE AS fresh FROM known UNION ALL
SELECT url, TRUE FROM reach WHERE url NOT IN (SELECT url FROM known)""")
def discover_query(spark, d):
    """Pages with even numbers are known; what can be reached from the first page is added, once."""
    site, first = _two_way_site(spark, d)
    known = table(spark, d, "pages").where(F.col("page_id") % 2 == 0)
    state = known.select(
        F.col("page_id").alias("id"), normalize_url(F.col("url")).alias("url"), F.lit("ACTIVE").alias("status"),
        F.lit("2024-01-01").cast("timestamp").alias("next_crawled_at"), F.lit(None).cast("timestamp").alias("last_crawled_at"),
        F.lit(60).alias("crawl_interval"))
    now = F.lit("2024-02-01").cast("timestamp")
    for _ in range(2):  # the second time adds nothing
        state = discover(state, site, first, now, scratch_path(spark, "state"), class_token=None, resolve=False)
    return state.select("url", (F.col("next_crawled_at") == now).alias("fresh"))


@query("crawl_closure_redirects", """
WITH RECURSIVE links AS (
    SELECT split_part(url, '?', 1) AS page, split_part(href, '?', 1) AS href FROM (
        SELECT url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
    WHERE href <> ''),
edges AS (SELECT page AS src, href AS dst FROM links WHERE length(href) % 3 > 0 UNION
          SELECT href, page FROM links WHERE length(page) % 3 > 0),
reach(url) AS (
    SELECT split_part(url, '?', 1) FROM pages WHERE page_id = (SELECT min(page_id) FROM pages)
    UNION
    SELECT dst FROM reach JOIN edges ON src = url)
SELECT url FROM reach""")
def closure_redirects(spark, d):
    """The same site when every link goes through a redirect, and a third of the redirects are not known."""
    site, first = _two_way_site(spark, d, "ad:")
    targets = site.select("url").union(extract_links(site, class_token=None, resolve=False).select(F.expr("substr(href, 4)")))
    known = targets.select(normalize_url(F.col("url")).alias("target")).distinct().where(F.length("target") % 3 > 0)
    redirects = known.select(F.concat(F.lit("ad:"), F.col("target")).alias("url"), "target")
    return crawl_closure(site, first, redirects=redirects, redirect_prefix="ad:", class_token=None, resolve=False).select("url")


@query("refresh_steps", f"""
WITH {SQL_STATE},
due AS (SELECT id, url, row_number() OVER (ORDER BY next_at, id) AS r FROM state
        WHERE status = 'ACTIVE' AND next_at <= TIMESTAMP '1999-01-01 00:00:00')
SELECT CAST((r - 1) // 50 AS INTEGER) AS step, id, url FROM due WHERE r <= 100""")
def refresh_steps(spark, d):
    """Two refresh steps in a row claim different rows, and each batch stays as it was claimed."""
    now = F.lit("1999-01-01").cast("timestamp")
    first, state = refresh_step(crawl_state(spark, d), now, 50, scratch_path(spark, "batch"), scratch_path(spark, "state"))
    second, _ = refresh_step(state, now, 50, scratch_path(spark, "batch"), scratch_path(spark, "state"))
    return first.select(F.lit(0).alias("step"), "id", "url").unionByName(second.select(F.lit(1).alias("step"), "id", "url"))
