"""Joins with guards, and theta joins rewritten so that they are equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def total_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of tables that must have the same keys; a key on one side only raises an error when it is read."""
    a, b = left.withColumn("_l", F.lit(1)), right.withColumn("_r", F.lit(1))
    both = a.join(b, key, "full_outer")
    lonely = F.col("_l").isNull() | F.col("_r").isNull()
    return both.withColumn("_l", F.when(lonely, F.raise_error(F.concat(F.lit("key on one side only: "), F.coalesce(F.col(key), F.lit("null"))))).otherwise(0)).where("_l = 0").drop("_l", "_r")


def lonely_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side of keys that stand on one side only."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").select(key, F.lit("left").alias("side")).union(b.join(a, key, "left_anti").select(key, F.lit("right").alias("side")))


def attach_issues(segments: DataFrame, issues: DataFrame) -> DataFrame:
    """segment_id, issue_id: an issue belongs to a segment that holds one of its events or its source atom.

    "Arrays overlap or array contains" would be a nested loop; exploded, it is two equi-joins whose union is made distinct.
    """
    e = segments.select("segment_id", F.explode("event_ids").alias("event"))
    a = segments.select("segment_id", F.explode("source_atom_ids").alias("source_atom_id"))
    by_event = issues.select("issue_id", F.explode("affected_event_ids").alias("event")).join(e, "event").select("segment_id", "issue_id")
    by_atom = issues.select("issue_id", "source_atom_id").join(a, "source_atom_id").select("segment_id", "issue_id")
    return by_event.union(by_atom).distinct()


def attach_headings(scenes: DataFrame, headings: DataFrame) -> DataFrame:
    """work_id, scene_xpath, heading_xpath: headings directly below a scene. The prefix test becomes an equi-join on the
    heading's parent path."""
    parent = F.regexp_extract("source_xpath", r"^(.*)/t:head\[\d+\]$", 1)
    h = headings.select("work_id", parent.alias("scene_xpath"), F.col("source_xpath").alias("heading_xpath")).where("scene_xpath <> ''")
    return scenes.select("work_id", F.col("source_xpath").alias("scene_xpath")).distinct().join(h, ["work_id", "scene_xpath"])


def conditions(cases: DataFrame, seeds: list[int], names: list[str]) -> DataFrame:
    """case_id, seed, condition: every case under every condition. The lists are literals, so this is an explode."""
    return cases.select("case_id", F.explode(F.array(*map(F.lit, seeds))).alias("seed")).select("case_id", "seed", F.explode(F.array(*map(F.lit, names))).alias("condition"))
