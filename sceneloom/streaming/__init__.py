"""Structured Streaming counterparts, and the batch form of early stopping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_log(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A stream over a folder of JSON lines that other jobs append to."""
    return spark.readStream.schema(schema).json(path)


def windowed_counts(stream: DataFrame, ts: str, by: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, by, n, total for each window; rows later than ``late`` behind the newest are left out."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("w.start").alias("start"), by, "n", "total")


def first_deliveries(stream: DataFrame, key: str, ts: str, late: str = "7 days") -> DataFrame:
    """Each key once, as first seen within the watermark: redeliveries are dropped and state stays bounded."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def early_stop(log: DataFrame, run: str, loss: str, order: list[str], patience: int = 2) -> DataFrame:
    """run, stop_at, evaluations: the number of the evaluation after which a run stops, because ``patience`` of them in a
    row brought no new minimum; null if it goes on. A run is one log, so a window holds no more than that."""
    w = Window.partitionBy(run).orderBy(*order)
    before = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = log.select(run, *order, F.row_number().over(w).cast("bigint").alias("k"), (before.isNull() | (F.col(loss) < before)).alias("better"))
    last = F.max(F.when(F.col("better"), F.col("k"))).over(Window.partitionBy(run).orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("idle", F.col("k") - last)
    return rows.groupBy(run).agg(F.min(F.when(F.col("idle") >= patience, F.col("k"))).alias("stop_at"), F.count(F.lit(1)).alias("evaluations"))
