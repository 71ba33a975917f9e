"""Picks by order: the longest and the median row, the first rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import upper_median


def longest_and_median(df: DataFrame, value: str, key: str) -> DataFrame:
    """pick, key, value: the longest row and the one at place n // 2 in the order of value and key. Rows with the median value
    are told apart by how many rows lie below it, so that nothing but those rows is ever sorted."""
    m = df.agg(upper_median(value).alias("m"), F.count(F.lit(1)).alias("n"))
    rows = df.withColumn("_one", F.lit(1)).join(m.withColumn("_one", F.lit(1)), "_one")  # one row
    below = rows.agg(F.count_if(F.col(value) < F.col("m")).alias("b"), F.first("n").alias("n"), F.first("m").alias("m")).withColumn("_one", F.lit(1))
    same = df.withColumn("_one", F.lit(1)).join(below, "_one").where(F.col(value) == F.col("m"))
    place = (F.floor(F.col("n") / 2) - F.col("b") + 1).cast("int")
    mid = same.groupBy("m").agg(F.sort_array(F.collect_list(key)).alias("k"), F.first(place).alias("p")).select(F.lit("median").alias("pick"), F.element_at("k", F.col("p")).alias(key), F.col("m").alias(value))
    top = df.agg(F.max(F.struct(value, key)).alias("t")).where("t is not null").select(F.lit("longest").alias("pick"), F.col(f"t.{key}").alias(key), F.col(f"t.{value}").alias(value))
    return top.union(mid)


def first_rows(df: DataFrame, k: int, *order: str) -> DataFrame:
    """The first ``k`` rows in order; all of them for 0."""
    return df.orderBy(*order).limit(k) if k else df
