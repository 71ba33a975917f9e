"""Integrity rules as data: each rule is a query that returns the violating rows, and passes if there are none.

Eight types: unique key, reference, order, derived field, leakage, constant, pattern, and total. ``audit`` runs a list
of them and returns one row a rule; ``violations`` gives the keys. Rules on single rows of one table (``of_rows``) are
evaluated together, in one pass over the table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """name, type and a query of violating rows with a column ``key`` of strings."""

    name: str
    kind: str
    query: Callable[[], DataFrame]
    #: Of rules on rows: the pass they share (see ``of_rows``).
    shared: Rows | None = None


@dataclass(frozen=True, eq=False)
class Rows:
    """A table, its key and the conditions that its rows must meet, by name with type."""

    df: DataFrame
    key: str
    conditions: dict[str, tuple[str, Column]]

    def audit(self) -> DataFrame:
        counts = [F.struct(F.lit(n).alias("check"), F.lit(k).alias("type"), F.count_if(~F.coalesce(c, F.lit(False))).alias("violations")) for n, (k, c) in self.conditions.items()]
        x = self.df.agg(F.array(*counts).alias("x")).select(F.inline("x"))
        return x.select("check", "type", (F.col("violations") == 0).alias("passed"), "violations")

    def violations(self) -> DataFrame:
        broken = [F.when(~F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("check"), F.lit(k).alias("type"))) for n, (k, c) in self.conditions.items()]
        return self.df.select(_key(self.key), F.explode(F.array_compact(F.array(*broken))).alias("x")).select("x.check", "x.type", "key")


def of_rows(df: DataFrame, key: str, conditions: list[tuple[str, str, Column]]) -> list[Rule]:
    """A rule for each (name, type, condition) that must be true of every row; null counts as not true."""
    shared = Rows(df, key, {n: (k, c) for n, k, c in conditions})
    return [Rule(n, k, lambda c=c: df.where(~F.coalesce(c, F.lit(False))).select(_key(key)), shared) for n, k, c in conditions]


def _key(*columns: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]).alias("key")


def unique(name: str, df: DataFrame, *columns: str) -> Rule:
    """Keys that occur more than once."""
    return Rule(name, "unique", lambda: df.groupBy(*columns).count().where("count > 1").select(_key(*columns)))


def references(name: str, df: DataFrame, column: str, to: DataFrame, to_column: str) -> Rule:
    """Non-null values without a row to refer to."""
    return Rule(name, "reference", lambda: df.select(F.col(column).alias("k")).where("k is not null").distinct().join(to.select(F.col(to_column).alias("k")), "k", "left_anti").select(F.col("k").cast("string").alias("key")))


def same_keys(name: str, a: DataFrame, b: DataFrame, column: str) -> Rule:
    """Values that stand on one side only."""
    return Rule(name, "reference", lambda: a.select(column).distinct().join(b.select(column).distinct(), column, "left_anti").union(b.select(column).distinct().join(a.select(column).distinct(), column, "left_anti")).select(_key(column)))


def holds(name: str, kind: str, df: DataFrame, key: str, condition: Column) -> Rule:
    """Keys of rows for which the condition isn't true (null counts as not true)."""
    return Rule(name, kind, lambda: df.where(~F.coalesce(condition, F.lit(False))).select(_key(key)))


def derived(name: str, df: DataFrame, key: str, column: str, expected: Column) -> Rule:
    """Keys of rows whose column differs from the recomputed value."""
    return Rule(name, "derived", lambda: df.where(~F.col(column).eqNullSafe(expected)).select(_key(key)))


def one_split(name: str, df: DataFrame, group: str, split: str) -> Rule:
    """Groups that show more than one split."""
    return Rule(name, "leakage", lambda: df.where(F.col(group).isNotNull() & F.col(split).isNotNull()).groupBy(group).agg(F.min(split).alias("a"), F.max(split).alias("b")).where("a <> b").select(_key(group)))


def constant(name: str, df: DataFrame, key: str, column: str, *allowed: object) -> Rule:
    """Keys of rows with another value than the allowed ones; None allows null."""
    some = [a for a in allowed if a is not None]
    ok = F.coalesce(F.col(column).isin(*some), F.lit(False)) if some else F.lit(False)
    return Rule(name, "constant", lambda: df.where(~(ok | (F.col(column).isNull() if None in allowed else F.lit(False)))).select(_key(key)))


def pattern(name: str, df: DataFrame, key: str, column: str, regex: str, present: bool) -> Rule:
    """Keys of rows where the pattern is absent though it must be present, or the other way round; nulls violate presence."""
    hit = F.coalesce(F.col(column).rlike(regex), F.lit(False))
    return Rule(name, "pattern", lambda: df.where(~hit if present else hit).select(_key(key)))


def ordered(name: str, mismatches: Callable[[], DataFrame], by: str) -> Rule:
    """Lists that differ in order, from ``order_mismatches``."""
    return Rule(name, "order", lambda: mismatches().select(_key(by)).distinct())


def equal_totals(name: str, a: DataFrame, a_value: Column, b: DataFrame, b_value: Column) -> Rule:
    """One row if the sums of two tables differ."""
    return Rule(name, "total", lambda: a.agg(F.coalesce(F.sum(a_value), F.lit(0)).alias("n")).join(b.agg(F.coalesce(F.sum(b_value), F.lit(0)).alias("n")), "n", "left_anti").select(F.col("n").cast("string").alias("key")))


def _passes(rules: list[Rule]) -> tuple[list[Rows], list[Rule]]:
    """The passes that rules on rows share, narrowed to the rules asked for, and the other rules."""
    passes: dict[int, tuple[Rows, list[str]]] = {}
    for r in rules:
        if r.shared is not None:
            passes.setdefault(id(r.shared), (r.shared, []))[1].append(r.name)
    return [Rows(x.df, x.key, {n: x.conditions[n] for n in names}) for x, names in passes.values()], [r for r in rules if r.shared is None]


def violations(rules: list[Rule]) -> DataFrame:
    """check, type, key of every violating row of all rules, as one plan: its parts run side by side."""
    passes, others = _passes(rules)
    rows = [r.query().select(F.lit(r.name).alias("check"), F.lit(r.kind).alias("type"), "key") for r in others]
    return reduce(DataFrame.union, [x.violations() for x in passes] + rows)


def audit(rules: list[Rule]) -> DataFrame:
    """check, type, passed, violations: a row for each rule, in one plan with a pass for each table of row rules and one small
    aggregate for each other rule."""
    passes, others = _passes(rules)
    rows = [r.query().agg(F.count(F.lit(1)).alias("violations")).select(F.lit(r.name).alias("check"), F.lit(r.kind).alias("type"), (F.col("violations") == 0).alias("passed"), "violations") for r in others]
    return reduce(DataFrame.union, [x.audit() for x in passes] + rows)
