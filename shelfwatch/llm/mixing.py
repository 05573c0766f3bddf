"""Mixing sources to target weights by systematic sampling.

The targets share out all words by source weight, none above ``CAP`` times what its source has; the
excess goes to the others by weight (water filling, computed over one row per source). A document is
expected ``target / source size`` times. Within a source the expected copies are added up along the
documents in order of size, one offset drawn from the seed is added, and a document is emitted once
for every whole number its interval crosses: as often as expected, rounded down or up. The order by
size makes the words taken come within about one document of the target.

Expected copies are whole numbers of 1 / ``UNIT``, so sums are exact in any order and reruns agree.
A source may hold most rows: the running sum is the two-step one of ``common.before``.

Results in special cases: a NULL text has size 0 and may still be emitted; the NULL source is a source
of its own, last in order; a source without words has target 0 and no copies; repeated rows are
sampled one by one; an empty table gives an empty result; input columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfwatch.llm.common import ROW_FILE, ROW_INDEX, before, identified, pin, shield, without

CAP = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
UNIT = 1 << 28
SPACE = "[\\x20\\x09-\\x0D]+"
RESULTS = ["source_size", "target", "copies", "taken"]
_INNER = ["size", "__weight", "__units", "__smaller", "__before", "__offset", "__at"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE), "")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: source, source_size, target."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(place - 1, F.lit(len(weights))) + 1)
    per = per.select("source", "source_size", weight.alias("w"), place.alias("__place"))
    # In order of room per weight the capped sources come first.
    fill = Window.orderBy(F.col("source_size") / F.col("w"), "__place")
    prior, whole = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total, weight_sum = F.sum("source_size").over(whole), F.sum("w").over(whole)
    filled = F.coalesce(F.sum("source_size").over(prior), F.lit(0)) * cap
    passed = F.coalesce(F.sum("w").over(prior), F.lit(0))
    capped = ((total - filled).cast("double") * F.col("w") > (cap * F.col("source_size")).cast("double") * (weight_sum - passed))
    per = per.select("*", capped.alias("__capped"), total.alias("__total"), weight_sum.alias("__sum"))
    held = F.sum(F.when(F.col("__capped"), cap * F.col("source_size")).otherwise(0)).over(whole)
    gone = F.sum(F.when(F.col("__capped"), F.col("w")).otherwise(0)).over(whole)
    level = (F.col("__total") - held) / (F.col("__sum") - gone)
    target = F.when(F.col("__capped"), (cap * F.col("source_size")).cast("double")).otherwise(level * F.col("w"))
    return per.select("source", "source_size", target.cast("double").alias("target"))


def plan_copies(rows: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``rows`` (doc_id, source, size and other narrow columns) with source_size, target, copies and taken."""
    rows = without(rows, [*RESULTS, *_INNER[1:]])
    kept = rows.columns
    targets = source_targets(rows, weights, cap).withColumnRenamed("source", "__source")
    share = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT + 0.5)).otherwise(0)
    joined = rows.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    joined = joined.select("*", share.cast("long").alias("__units"), (-F.col("size")).alias("__smaller"))
    placed = before(joined, ["source"], ["__smaller", "doc_id"], {"__before": "__units"}, "mix")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce("source", F.lit("")))), 1, 7), 16, 10).cast("long")
    start = offset + F.col("__before")
    copies = F.shiftright(start + F.col("__units"), 28) - F.shiftright(start, 28)
    return placed.select(*[F.col(c) for c in kept], "source_size", "target", copies.alias("copies"),
                         (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mixed corpus, with the columns of ``docs``: every document as often as it was drawn."""
    docs, back = shield(docs, [*RESULTS, *_INNER])
    rows = identified(docs)
    sized = rows.select(ROW_FILE, ROW_INDEX, "doc_id", "source", word_count(F.col("text")).alias("size"))
    drawn = plan_copies(pin(sized, "sizes"), seed, weights, cap).where("copies > 0")  # words are counted once
    joined = rows.join(drawn.select(ROW_FILE, ROW_INDEX, "copies"), [ROW_FILE, ROW_INDEX])
    return back(joined.withColumn("__at", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))))
