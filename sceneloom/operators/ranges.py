"""Numbers, neighbours and running sums within groups of any size.

A group (a scene, a split) may hold a third of all rows, so that no window is ever partitioned by it alone. Rows are
numbered by sorted ranges, whose counts are added up; once they have numbers, a window is partitioned by the group and a
stretch of numbers, and the few rows that a frame needs from the stretches beside it are sent there too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import materialise

#: Rows of a stretch.
WIDTH = 20_000


def numbered(df: DataFrame, by: str, *order: str, number: str, weight: str | None = None, before: str | None = None, name: str = "numbered") -> DataFrame:
    """df with ``number``: how many rows of the same ``by`` come before in ``order``; and, with a column ``weight``, in
    ``before`` the sum of their weights. A null ``by`` is a group of its own.

    Rows are range-partitioned by group and order, counted within their sorted partition, and written once, since ranges
    come from a sample: a second pass could draw other ones. What is added is a sum for each group and partition.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_n", T.LongType()), T.StructField("_w", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, count, total = TaskContext.get().partitionId(), object(), 0, 0
        for b in batches:
            size = b.num_rows
            if not size:
                continue
            keys = np.array([*b.column(by).to_pylist(), None], object)[:size]
            w = np.array(b.column(weight).to_pylist(), np.int64) if weight else np.zeros(size, np.int64)
            new = np.ones(size, bool)
            new[1:] = keys[1:] != keys[:-1]
            new[0] = keys[0] != last
            group = np.cumsum(new)
            begins = np.flatnonzero(new)
            if not new[0]:
                begins = np.concatenate(([0], begins))
                group = group + 1
            rank = np.arange(size) - begins[group - 1]
            sums = np.cumsum(w) - w
            sums = sums - sums[begins][group - 1]
            if not new[0]:
                rank[group == 1] += count
                sums[group == 1] += total
            last, count, total = keys[-1], int(rank[-1]) + 1, int(sums[-1] + w[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(size, part, np.int32)), pa.array(rank.astype(np.int64)), pa.array(sums.astype(np.int64))], names=schema.names)

    local = materialise(df.repartitionByRange(by, *order).sortWithinPartitions(by, *order).mapInArrow(run, schema), name)
    w = F.lit(0) if weight is None else F.col(weight)
    sizes = local.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_count"), F.sum(w).alias("_sum"))
    parts = Window.partitionBy("_by").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = sizes.select("_by", "_p", F.coalesce(F.sum("_count").over(parts), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_sum").over(parts), F.lit(0)).alias("_w0"))
    joined = local.join(offsets, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p")))
    out = joined.withColumn(number, F.col("_n") + F.col("_n0"))
    if before:
        out = out.withColumn(before, F.col("_w") + F.col("_w0"))
    return out.drop("_part", "_n", "_w", "_by", "_p", "_n0", "_w0")


def with_halo(df: DataFrame, number: str, before: int, after: int, width: int = WIDTH) -> DataFrame:
    """df (numbered from 0 within a group) with _stretch and _own: each row in its own stretch of ``width`` numbers and, not
    its own, where frames of ``before`` rows back and ``after`` rows on reach over the edge of the neighbouring one."""
    if max(before, after) > width:
        raise ValueError("a frame may not be wider than a stretch")
    home, at = F.floor(F.col(number) / width), F.col(number) % width
    places = F.array_compact(F.array(home, F.when((at < after) & (home > 0), home - 1), F.when(at >= width - before, home + 1)))
    return df.withColumn("_stretch", F.explode(places)).withColumn("_own", F.col("_stretch") == home)


def stretch(by: str, number: str) -> Window:
    """The window over a stretch of ``with_halo``, in order."""
    return Window.partitionBy(by, "_stretch").orderBy(number)


def own(df: DataFrame) -> DataFrame:
    """The rows in their own stretches."""
    return df.where("_own").drop("_own", "_stretch")


def running_sum(df: DataFrame, by: str, number: str, value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """df (numbered from 0 within ``by``) with the sum of ``value`` over the rows before in ``by``."""
    rows = df.withColumn("_v", value).withColumn("_stretch", F.floor(F.col(number) / width))
    sums = rows.groupBy(by, "_stretch").agg(F.sum("_v").alias("_s"))
    parts = Window.partitionBy(by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    offsets = sums.select(F.col(by).alias("_by"), F.col("_stretch").alias("_at"), F.coalesce(F.sum("_s").over(parts), F.lit(0)).alias("_before"))
    inner = F.coalesce(F.sum("_v").over(stretch(by, number).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = rows.withColumn("_inner", inner).join(offsets, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_stretch") == F.col("_at")))
    return joined.withColumn(name, F.col("_inner") + F.col("_before")).drop("_v", "_stretch", "_by", "_at", "_before", "_inner")
