"""Order-keeping array aggregates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_order(value: Column, *order: Column) -> Column:
    """Aggregate: the values as an array, sorted by ``order``. Null values are kept."""
    keys = [o.alias(f"o{k}") for k, o in enumerate(order)]
    return F.transform(F.array_sort(F.collect_list(F.struct(*keys, value.alias("v")))), lambda s: s["v"])


def ordered_distinct(arrays: Column) -> Column:
    """The distinct elements of an array of arrays, in order of first occurrence. Null inner arrays hold nothing."""
    return F.array_distinct(F.flatten(F.array_compact(arrays)))


def upper_median(column: str) -> Column:
    """Aggregate: element n // 2 of the sorted non-null values, the larger of the middle pair where n is even.

    The discrete percentile takes the smaller of the pair; of the negated values, that is the larger of the values. It
    keeps a count for each different value, so that its state grows with the values and not with the rows.
    """
    return -F.expr(f"percentile_disc(0.5) within group (order by -({column}))")
