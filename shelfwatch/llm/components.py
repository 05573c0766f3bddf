"""Connected components of a link table, in Spark, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfwatch.llm.common import joinable, pin


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with a link; root is one node of its component.

    Contraction: every node joins its smallest neighbour, links are drawn between what the nodes have
    become, and this repeats until no link is left. Tables shrink by a factor each round and are
    written to the shared folder; then the rounds' answers are put together from the last to the
    first. Self links make a node known without linking it.
    """
    links = pin(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct(), "links")
    rounds = []
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = joinable(pin(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to")), "step"))
        rounds.append(step)
        to_a, to_b = step.select(F.col("node").alias("a"), F.col("to").alias("na")), step.select(F.col("node").alias("b"), F.col("to").alias("nb"))
        links = pin(links.join(to_a, "a").join(to_b, "b").where("na <> nb")
                    .select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(), "links")
        if links.isEmpty():
            break
    roots = rounds[-1].select("node", F.col("to").alias("root"))
    for step in reversed(rounds[:-1]):
        later = roots.select(F.col("node").alias("to"), "root")
        roots = step.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return pin(roots, "roots")
