"""Queries on sinks that are read again, locks, guards and further forms of operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import finite, sha256
from ..operators import joins, release, sequence, splits
from ..scratch import scratch_dir
from ..sources import jsonl, tei
from . import markup
from .base import *


def _folder(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s7_append_log", f"SELECT segment_id, count(*) AS lines, sha256(any_value(target_text)) AS sha FROM {sql_segments('target_text')} GROUP BY 1")
def s7(spark, root):
    """A log that is added to twice, first of one half of the segments (by hash), then of the other, and read as one table."""
    path = _folder(spark, "log")
    s = segments(spark, root, "target_text")
    half = F.pmod(F.xxhash64("segment_id"), F.lit(2))
    for k in (0, 1):
        jsonl.append_jsonl(s.where(half == k), path)
    return jsonl.read_jsonl(spark, path, "segment_id string, target_text string").groupBy("segment_id").agg(F.count(F.lit(1)).alias("lines"), sha256(F.max("target_text")).alias("sha"))


@query("s2_json_document", f"SELECT scene_group_id, min({sql_split()}) AS split FROM scenes WHERE scene_group_id IS NOT NULL AND split IS NOT NULL GROUP BY 1")
def s2(spark, root):
    """The frozen split plan as JSON documents with a map, one for each work, read again as rows."""
    path = _folder(spark, "plan")
    s = table(spark, root, "scenes").where("scene_group_id is not null and split is not null").groupBy("work_id", "scene_group_id").agg(F.min(split_name(F.col("split"))).alias("split"))
    plan = s.groupBy("work_id").agg(F.map_from_entries(F.collect_list(F.struct("scene_group_id", "split"))).alias("group_assignment"))
    plan.select("group_assignment").write.option("maxRecordsPerFile", 1).json(path)  # a file is one document
    return jsonl.read_map(spark, path, "group_assignment", "scene_group_id", "split").groupBy("scene_group_id").agg(F.min("split").alias("split"))


@query("x2_write_splits", f"SELECT {sql_split()} AS split, count(*) AS n, max(sha256(instruction_de)) AS prompts, max(sha256(target_text)) AS completions FROM {sql_pairs('split', 'instruction_de', 'target_text')} WHERE split IS NOT NULL GROUP BY 1")
def x2(spark, root):
    """The export by split, read again."""
    path = _folder(spark, "splits")
    p = pairs(spark, root, "split", "instruction_de", "target_text").where("split is not null")
    splits.write_splits(p.withColumn("split", split_name(F.col("split"))), path)
    back = spark.read.schema("prompt string, completion string, split string").json(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.max(sha256(F.col("prompt"))).alias("prompts"), F.max(sha256(F.col("completion"))).alias("completions"))


@query("x3_lock", "SELECT doc_id::VARCHAR AS path, sha256(coalesce(text, '')) AS expected, CASE WHEN lang IS NOT NULL THEN sha256(trim(coalesce(text, ''), ' ')) END AS found FROM documents WHERE lang IS NULL OR sha256(coalesce(text, '')) <> sha256(trim(coalesce(text, ''), ' '))")
def x3(spark, root):
    """Locked texts against those of a later state, in which texts are trimmed and those without a language are missing."""
    d = table(spark, root, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    return release.lock_violations(d.select("path", sha256(F.col("text")).alias("sha256")), d.where("lang is not null").select("path", sha256(F.trim("text")).alias("sha256")))


@query("x7_for_training", f"SELECT split, count(*) AS n FROM (SELECT {sql_split()} AS split FROM {sql_pairs('split')}) WHERE split IN ('train', 'validation') GROUP BY 1")
def x7(spark, root):
    """What training may read."""
    p = pairs(spark, root, "split").withColumn("split", split_name(F.col("split")))
    return splits.for_training(p, "train").union(splits.for_training(p, "validation")).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("n17_finite_totals", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def n17(spark, root):
    """Totals of values that must all be finite: any other is an error."""
    e = table(spark, root, "events").select("event_type", finite(F.col("value")).alias("value"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    "w9_latched_verses",
    f"""SELECT source_atom_id, count(*) AS changed FROM (SELECT *, max(CASE WHEN contains(text, '(ab)') THEN 1 ELSE 0 END) OVER (PARTITION BY atom_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latched FROM {SQL_EVENTS})
    WHERE latched = 1 AND kind = 'verse' AND NOT contains(text, '(ab)') GROUP BY 1""",
)
def w9(spark, root):
    """The form of the latch that sets verses only."""
    e = events(spark, root).withColumnsRenamed({"source_atom_id": "parent", "atom_id": "source_atom_id"}).withColumn("speaker", F.lit("someone"))
    out = sequence.latch(e, F.contains("text", F.lit("(ab)")), F.lit("offstage"), "speaker", ("verse",)).where("speaker = 'offstage'")
    return out.groupBy(F.col("parent").alias("source_atom_id")).agg(F.count(F.lit(1)).alias("changed"))


@query("j7_headings", markup._SQL + f"SELECT DISTINCT work_id, '{markup._BODY}/t:div[1]' AS scene_xpath, '{markup._BODY}/t:div[1]/t:head[1]' AS heading_xpath FROM ev WHERE part = 0")
def j7_headings(spark, root):
    """The headings directly below a scene's division."""
    rows = tei.marks(markup.documents(spark, root), largest=None)
    s = tei.events(rows).select("work_id", F.col("scene_xpath").alias("source_xpath")).distinct()
    return joins.attach_headings(s, tei.headings(rows).select("work_id", F.col("xpath").alias("source_xpath")))
