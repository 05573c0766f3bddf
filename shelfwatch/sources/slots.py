"""Parts of a table that are replaced as a whole: two slots for each and a log that names the one to read.

A part is a folder ``rows/<column>=<value>/slot=<a or b>``. A replacement reads the current slot, writes the other, and
counts from the moment a line per part is in ``commits``. A job that dies before that, be it in the middle of its
own commit, has changed nothing that is read. One load of a table at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

SLOTS, NO_SLOT = ("a", "b"), "-"
_COMMITS = "loadNo long, part string, slot string"


def current_parts(spark: SparkSession, root: str) -> dict[str, Row]:
    """Per part the slot of its newest finished load; a row per part reaches the driver."""
    try:
        commits = spark.read.schema(_COMMITS).parquet(f"{root}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    newest = commits.groupBy("part").agg(F.max_by("slot", "loadNo").alias("slot"), F.max("loadNo").alias("loadNo"))
    return {r["part"]: r for r in newest.collect()}


def read_parts(spark: SparkSession, root: str, schema: StructType, column: str, parts: dict[str, Row] | None = None) -> DataFrame:
    """Rows of the current slots; filters on ``column`` prune folders. ``parts`` may be a choice of ``current_parts``."""
    parts = current_parts(spark, root) if parts is None else parts
    if not parts:
        return spark.createDataFrame([], schema)
    wanted = F.concat_ws("/", F.col(column).cast("string"), "slot").isin([f"{p}/{r['slot']}" for p, r in parts.items()])
    with_slot = StructType([*schema.fields, StructField("slot", StringType())])
    return spark.read.schema(with_slot).parquet(f"{root}/rows").where(wanted).select(*schema.fieldNames())


def replace_parts(rows: DataFrame, root: str, column: str, names: Iterable[str], emptied: Iterable[str] = (),
                  sort: Sequence[str] = ()) -> None:
    """The parts ``names`` of the table now hold the ``rows`` of these parts, the parts ``emptied`` none.

    Rebalancing writes files of even size: it merges small partitions and splits a large one, be it a hot key or
    copies of one row. Sorted files let readers skip row groups.
    """
    spark, names, emptied = rows.sparkSession, sorted(names), set(emptied)
    if not names and not emptied:
        return
    parts = current_parts(spark, root)
    load = max((r["loadNo"] for r in parts.values()), default=0) + 1
    free = {p: SLOTS[1] if p in parts and parts[p]["slot"] == SLOTS[0] else SLOTS[0] for p in names}
    if names:
        slots = F.create_map(*[F.lit(x) for p, s in free.items() for x in (p, s)])
        mine = F.col(column).cast("string")
        (rows.where(mine.isin(names)).withColumn("slot", slots[mine])
             .hint("rebalance", F.col(column), *[F.col(c) for c in sort[:1]]).sortWithinPartitions(column, *sort)
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column, "slot").parquet(f"{root}/rows"))
    lines = [F.struct(F.lit(load).cast("long").alias("loadNo"), F.lit(p).alias("part"), F.lit(s).alias("slot"))
             for p, s in [*free.items(), *[(p, NO_SLOT) for p in sorted(emptied)]]]
    commit = spark.range(1, numPartitions=1).select(F.explode(F.array(*lines)).alias("line")).select("line.*")
    commit.write.mode("append").parquet(f"{root}/commits")
