"""Metric alignment on a live stream of points."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import ArrayType, DoubleType, IntegralType, LongType, StructField, StructType

from shelfwatch.operators.align import align_delta, align_mean, last_in_bucket

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Settings of the query that ``write_series_stream`` starts. Buckets are narrow rows, unlike the pages that the session's batches are cut for.
QUERY_CONF = {STATE_STORE: ROCKSDB, "spark.sql.execution.arrow.maxRecordsPerBatch": "10000"}
# Groups that the series are dealt to by hash; fixed for the life of a checkpoint.
SERIES_PARTS = 1024


class CounterChange(StatefulProcessor):
    """Changes of counters from bucket to bucket: the state is the last value of each counter's bucket that closed last.

    A call has a group of series, so that state is read and written once for all of them; what it costs in Python goes
    by rows and groups, not by series. In a group a series column is NULL in all rows or in none; ``holes`` has a bit for each. Buckets reach it closed and, over all batches, in order of time: the watermark only rises, and those
    that one batch closes are sorted here. A counter that fell was reset and counts from zero; the first bucket of a
    series, and one next to a bucket without a value, has no change.
    """

    def __init__(self, ids: Sequence[str], columns: Sequence[str]):
        self.ids, self.columns = list(ids), list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("lastValues", "table binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        buckets = pd.concat(list(rows), ignore_index=True).sort_values("timestamp", ignore_index=True)
        holes = int(key[1])
        ids = [c for i, c in enumerate(self.ids) if not holes >> i & 1]
        known = buckets[ids].assign(one=0, last=buckets["last"].astype("float64"))
        held = 0
        if self.state.exists():
            before = pa.ipc.open_stream(bytes(self.state.get()[0])).read_pandas()
            held, known = len(before), pd.concat([before, known], ignore_index=True)
        change = known["last"] - known.groupby([*ids, "one"], sort=False, dropna=False)["last"].shift()
        buckets["last"] = change.mask(change < 0, known["last"]).iloc[held:].to_numpy()
        newest = pa.Table.from_pandas(known.drop_duplicates([*ids, "one"], keep="last"), preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, newest.schema) as out:
            out.write_table(newest)
        self.state.update((sink.getvalue().to_pybytes(),))
        yield buckets[self.columns]

    def close(self) -> None:
        pass


def align_stream(points: DataFrame, series: Sequence[str], value: str = "metric_value", ts: str = "ts",
                 period: str = "1 minute", late: str = "10 minutes", aligner: str = "mean", kind: str = "delta") -> DataFrame:
    """Aligned buckets, each emitted once, when the watermark has passed its end.

    State is one partial aggregate per open bucket and series; the watermark closes them. For
    ``aligner="delta"``, ``kind`` is that of ``align_delta``: a cumulative counter keeps one more value per series,
    its last one, in a second stage behind the closed buckets; so Python sees a row per bucket, not per point. The series are dealt
    to ``SERIES_PARTS`` groups, each with its last values as one entry of state. Checkpoints that had an entry per series do not fit.
    That stage needs the state store that ``write_series_stream`` sets for its query.
    """
    marked = points.withWatermark(ts, late)
    if aligner == "mean":
        return align_mean(marked, series, value, ts, period)
    if kind != "cumulative":
        return align_delta(marked, series, value, ts, period, kind)
    closed = last_in_bucket(marked, series, value, ts, period)
    inner = [f"series{i}" for i in range(len(series))]  # the names of series and value are the caller's and may clash
    closed = closed.toDF("timestamp", *inner, "last")
    schema = StructType(closed.schema.fields[:-1] + [StructField("last", DoubleType())])
    # Lists and structs are told apart by their text, as a table in Python cannot group by them.
    nested = {c: f"text{i}" for i, c in enumerate(inner) if isinstance(closed.schema[c].dataType, (ArrayType, StructType))}
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}
    holes = sum((F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(0) for i, c in enumerate(inner)), F.lit(0)).cast("long")
    closed = closed.withColumns({**{t: F.to_json(F.struct(c), exact) for c, t in nested.items()}, "holes": holes,
                                 "part": F.pmod(F.xxhash64(*inner), F.lit(SERIES_PARTS)).cast("int") if inner else F.lit(0)})
    # A batch of whole numbers with NULL among them would reach Python as floats.
    whole = [c for c in inner if isinstance(closed.schema[c].dataType, IntegralType)]
    closed = closed.withColumns({c: F.coalesce(c, F.lit(0).cast(closed.schema[c].dataType)) for c in whole})
    schema = StructType([*schema.fields, StructField("holes", LongType())])
    changes = closed.groupBy("part", "holes").transformWithStateInPandas(
        CounterChange([nested.get(c, c) for c in inner], schema.names), schema, outputMode="Append", timeMode="None")
    filled = {c: F.when(F.col("holes").bitwiseAND(1 << inner.index(c)) == 0, F.col(c)) for c in whole}
    return changes.withColumns(filled).drop("holes").toDF("timestamp", *series, value)


def write_series_stream(series: DataFrame, path: str, checkpoint: str,
                        trigger: dict | None = None) -> StreamingQuery:
    """Start the stream. Its session is copied at the start, so ``QUERY_CONF`` is set for this query only."""
    conf = series.sparkSession.conf
    held = {key: conf.get(key) for key in QUERY_CONF}
    try:
        for key, setting in QUERY_CONF.items():
            conf.set(key, setting)
        return (series.writeStream.format("parquet")
                .option("path", path)
                .option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"processingTime": "10 seconds"}))
                .outputMode("append")
                .start())
    finally:
        for key, setting in held.items():
            conf.set(key, setting)
