"""What a hop of the closure shuffles."""

from pyspark.sql import functions as F

from shelfwatch.plans import crawl


def test_edges_are_not_shuffled_by_a_hop(spark, tmp_path, monkeypatch):
    """Edges lie in buckets of their source: only the frontier moves to them."""
    plans = []
    original = crawl.unseen_urls

    def watched(urls, known):
        plans.append(urls._jdf.queryExecution().executedPlan().toString())
        return original(urls, known)

    monkeypatch.setattr(crawl, "unseen_urls", watched)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.range(20).select(F.col("id").cast("string").alias("src"), (F.col("id") + 1).cast("string").alias("dst"))
        got = crawl.closure_of(edges, spark.createDataFrame([("17",)], "url string"))
        assert {r["url"]: r["hop"] for r in got.collect()} == {"17": 0, "18": 1, "19": 2, "20": 3}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert plans and all("hashpartitioning(src" not in p and "hashpartitioning(url" in p for p in plans)
