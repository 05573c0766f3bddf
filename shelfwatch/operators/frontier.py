"""The crawl frontier as tables: claim, reschedule, split, resolve, merge."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F, Window

from shelfwatch.functions import text as T
from shelfwatch.functions.time import add_minutes
from shelfwatch.session import scratch_path


def is_due(now: Column, status: str = "ACTIVE") -> Column:
    return (F.col("status") == status) & (F.col("next_crawled_at") <= now)


def due_urls(state: DataFrame, now: datetime | Column, n: int, status: str = "ACTIVE") -> DataFrame:
    """The ``n`` due rows that wait longest; equal times are ordered by id."""
    now = now if isinstance(now, Column) else F.lit(now)
    return state.where(is_due(now, status)).orderBy("next_crawled_at", "id").limit(n)


def claim_due(state: DataFrame, now: datetime | Column, n: int, status: str = "ACTIVE") -> DataFrame:
    return due_urls(state, now, n, status).select("id", "url")


def advance_schedule(state: DataFrame, claimed: DataFrame, now: datetime | Column) -> DataFrame:
    """New state: claimed rows were crawled at ``now`` and are due again after their interval."""
    now = now if isinstance(now, Column) else F.lit(now)
    marks = claimed.select(F.col("id").alias("_claimed")).distinct()
    joined = state.join(marks, state["id"] == marks["_claimed"], "left")
    hit = F.col("_claimed").isNotNull()
    changed = {
        "next_crawled_at": F.when(hit, add_minutes(now, F.col("crawl_interval"))).otherwise(F.col("next_crawled_at")),
        "last_crawled_at": F.when(hit, now).otherwise(F.col("last_crawled_at")),
    }
    return joined.withColumns(changed).select(*state.columns)


def claimed_rows(state: DataFrame, claimed: DataFrame) -> DataFrame:
    """State rows whose id was claimed."""
    return state.join(claimed.select("id"), "id", "left_semi")


def assign_workers(state: DataFrame, now: datetime | Column, n: int, workers: int,
                   status: str = "ACTIVE") -> DataFrame:
    """Disjoint batches of ``n`` URLs for each worker, longest waiting first.

    The numbering runs over the claimed rows only, of which there are at most ``n * workers``.
    """
    claimed = due_urls(state, now, n * workers, status)
    rank = F.row_number().over(Window.orderBy("next_crawled_at", "id"))
    return claimed.select("id", "url", F.floor((rank - 1) / n).cast("int").alias("worker"))


def redirect_ends(redirects: DataFrame, prefix: str) -> DataFrame:
    """Where the redirects ``(url, target)`` end: ``(url, target)`` with targets that are no redirect links themselves.

    A URL is a redirect link if it has the prefix. A chain that leads to one without a known target, or into a cycle, has no
    end; a URL with several targets has several. Chains are followed by pointer jumping: after round k the
    ends within 2^k steps are known, and every pointer spans 2^k steps. A round that finds nothing new is the
    last: an end farther away than 2^k steps would have one at 2^k + 1 steps on its way. So rounds follow the logarithm of the
    longest chain, and cycles end with the first round that only they would go on. Rounds are written to shared
    storage. A target that very many URLs share is a hot key on one side of the joins only, which the adaptive join splits.
    """
    step = (redirects.select("url", "target").where(F.col("target").isNotNull() & T.has_prefix(F.col("url"), prefix)).distinct())
    onward = T.has_prefix(F.col("target"), prefix)
    ends = step.where(~onward)
    if step.where(onward).isEmpty():
        return ends
    spark = redirects.sparkSession
    path = scratch_path(spark, "redirects")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    ends, jumps, k = written(ends, "ends-0"), written(step.where(onward), "jumps-0"), 0
    while True:
        k += 1
        known = ends.select(F.col("url").alias("_via"), F.col("target").alias("_end"))
        found = jumps.join(known, F.col("target") == F.col("_via")).select("url", F.col("_end").alias("target")).distinct()
        found = written(found.join(ends, ["url", "target"], "left_anti"), f"ends-{k}")
        if found.isEmpty():
            return ends
        ends = ends.unionByName(found)
        far = jumps.select(F.col("url").alias("_via"), F.col("target").alias("_to"))
        jumps = written(jumps.join(far, F.col("target") == F.col("_via")).select("url", F.col("_to").alias("target")).distinct(), f"jumps-{k}")


def resolve_redirects(links: DataFrame, redirects: DataFrame | None, prefix: str | None) -> DataFrame:
    """Distinct hrefs with the targets they end at; redirect links without a known end are dropped.

    ``redirects`` has ``(url, target)``. Equal links are merged before the join, so a link that
    every page carries reaches it once.
    """
    return with_targets(links.select("href").distinct(), redirects, prefix)


def with_targets(links: DataFrame, redirects: DataFrame | None, prefix: str | None) -> DataFrame:
    """``links`` with the target that every href ends at, in one left join, so that ``links`` is computed once.

    The redirect side, from ``redirect_ends``, has a row per href, so the adaptive join can split a link that very many rows carry.
    """
    if prefix is None:
        return links.withColumn("target", F.col("href"))
    through = T.has_prefix(F.col("href"), prefix)
    if redirects is None:
        return links.where(~through).withColumn("target", F.col("href"))
    known = redirect_ends(redirects, prefix).select(F.col("url").alias("_from"), F.col("target").alias("_to"))
    joined = links.join(known, (F.col("href") == F.col("_from")) & through, "left")
    target = F.when(through, F.col("_to")).otherwise(F.col("href"))
    return joined.withColumn("target", target).where(F.col("target").isNotNull()).drop("_from", "_to")


def _named(urls: DataFrame) -> DataFrame:
    """Rows that hold a URL at all."""
    return urls.select("url").where(F.col("url") != "")


def union_urls(*frames: DataFrame) -> DataFrame:
    """Set union of URL frames; NULL and empty ones are left out."""
    urls = _named(frames[0])
    for frame in frames[1:]:
        urls = urls.unionByName(_named(frame))
    return urls.dropDuplicates(["url"])


def unseen_urls(urls: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct URLs that ``known`` does not hold; NULL and empty ones are left out."""
    return _named(urls).distinct().join(known.select("url"), "url", "left_anti")


def number_rows(df: DataFrame, key: str, start: Column, name: str = "id", buckets: int = 4096) -> DataFrame:
    """Consecutive numbers after ``start`` for rows with distinct keys, without a global sort.

    Rows are hashed into ``buckets`` (a power of two) and numbered inside them; bucket offsets
    are running sums over at most ``buckets`` counts. Numbers depend on the data only, so a
    re-run task gives the same ones.
    """
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    hashed = df.withColumn("_bucket", F.xxhash64(key).bitwiseAND(buckets - 1))
    counts = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    # A window without partitions, over at most ``buckets`` rows.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    numbered = hashed.withColumn("_place", place).join(F.broadcast(offsets), "_bucket")
    return numbered.select(*df.columns, (start + F.col("_offset") + F.col("_place")).alias(name))


def merge_frontier(
    state: DataFrame,
    urls: DataFrame,
    now: datetime | Column,
    status: str = "ACTIVE",
    interval_minutes: int = 1440,
) -> DataFrame:
    """Insert if absent: known URLs keep their row, new ones are due at once."""
    now = now if isinstance(now, Column) else F.lit(now)
    highest = F.coalesce(state.agg(F.max("id")).scalar(), F.lit(0))
    fresh = number_rows(unseen_urls(urls, state), "url", highest)
    rows = fresh.select(
        F.col("id").cast("long").alias("id"),
        "url",
        F.lit(status).alias("status"),
        now.cast("timestamp").alias("next_crawled_at"),
        F.lit(None).cast("timestamp").alias("last_crawled_at"),
        F.lit(interval_minutes).cast("int").alias("crawl_interval"),
    )
    return state.select(*rows.columns).unionByName(rows)
