"""Newest snapshot per key and change between snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from shelfwatch.session import scratch_path


def _match(columns: dict[str, str]):
    """Null-safe equality of column pairs."""
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in columns.items()])


def latest_snapshot(
    df: DataFrame,
    keys: Sequence[str] = ("urlId",),
    ts: str = "timestamp",
    ties: str = "keep",
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Rows carrying the newest timestamp of their key.

    ``ties="keep"`` returns every row at the newest timestamp. The newest timestamps come
    from a two-column scan aggregated before its shuffle, and the rows are then matched on
    key *and* timestamp: a key that holds a third of the table is spread over its timestamps,
    and what is still uneven is split by the adaptive skew join. No task sorts a whole key.

    ``ties="one"`` returns one row per key: the newest, then the smallest by ``tie_break``.
    Each map task passes on at most one row per key (window group limit), so hot keys cost
    one row per task.
    """
    if ties == "one":
        order = [F.col(ts).desc(), *[F.col(c).asc() for c in tie_break]]
        ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        return ranked.where(F.col("_rank") == 1).drop("_rank")
    if ties != "keep":
        raise ValueError("ties must be 'keep' or 'one'")
    newest = df.groupBy(*keys).agg(F.max(ts).alias("_newest"))
    renamed = {k: f"_key_{k}" for k in keys}
    newest = newest.select(*[F.col(k).alias(r) for k, r in renamed.items()], "_newest")
    return df.join(newest, _match({**renamed, ts: "_newest"}), "left_semi")


def snapshot_change(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = ("urlId",),
    ts: str = "timestamp",
    tie_break: Sequence[str] = (),
    deltas: Sequence[str] = (),
) -> DataFrame:
    """Add ``prev_<column>`` from the key's preceding snapshot and ``<column>_delta``.

    Rows are ordered by time, then ``tie_break``, then the columns themselves; NULL is a key like
    any other. Rows are dealt by range of key and order, with a mark that parts even equal rows, so
    the history of a key is as many blocks as its size asks for. Inside a block the preceding row
    is a plain ``lag``; the first row of a block takes the last row of the key's block before it,
    from a summary with a row per key and block. The ranges are written to the shared folder, as a
    second evaluation could cut them elsewhere. Every key takes this one path. Marks count rows in the
    order they come in, so ``df`` should be a read of files: a task that is run again must meet its
    rows in the same order.
    """
    spark = df.sparkSession
    order = list(dict.fromkeys([ts, *tie_break, *columns]))
    by = [*keys, *order, "_mark"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "change")
    (df.withColumn("_mark", F.monotonically_increasing_id()).repartitionByRange(parts, *by)
     .withColumn("_block", F.spark_partition_id()).write.parquet(path))
    rows = spark.read.parquet(path)
    own = F.struct(*columns)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order, "_mark")
    in_block = rows.withColumns({"_before": F.lag(own).over(inside), "_place": F.row_number().over(inside)})

    renamed = {k: f"_key_{k}" for k in keys}
    last = rows.groupBy(*keys, "_block").agg(F.max(F.struct(*order, "_mark")).alias("_last"))
    earlier = F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block"))
    carry = last.select(*[F.col(k).alias(r) for k, r in renamed.items()], F.col("_block").alias("_key_block"),
                        earlier.alias("_carry")).where(F.col("_carry").isNotNull())
    joined = in_block.join(carry, _match({**renamed, "_block": "_key_block"}), "left")
    carried = F.when(F.col("_carry").isNotNull(), F.struct(*[F.col("_carry")[c].alias(c) for c in columns]))
    before = F.when(F.col("_place") == 1, carried).otherwise(F.col("_before"))
    out = joined.withColumn("_prev", before).select(*df.columns, *[F.col("_prev")[c].alias(f"prev_{c}") for c in columns])
    return out.select("*", *[(F.col(c) - F.col(f"prev_{c}")).alias(f"{c}_delta") for c in deltas])
