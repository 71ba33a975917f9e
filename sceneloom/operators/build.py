"""The two builds as whole dataflows: from ordered events and cuts to segments, atoms and a boundary ledger; from
segments and annotations to pairs of instruction and target with their export index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import char_count, in_order, ordered_distinct, strip, word_count
from ..scratch import materialise
from . import encode, joins, sequence, splits


@dataclass(frozen=True)
class Corpus:
    """segments, atoms and the boundary ledger of a corpus build."""

    segments: DataFrame
    atoms: DataFrame
    ledger: DataFrame


def corpus(events: DataFrame, cuts: DataFrame, plan: DataFrame, issues: DataFrame | None = None) -> Corpus:
    """Segments between reviewed cuts.

    events: work_id, scene_id, scene_group_id, atom_number, source_atom_id, event_id, scene_ord, kind, stanza_ids, text,
    source_xpath, speakers; cuts: scene_id, cut_ord (from 1), marker, reason; plan: scene_group_id, split; issues: issue_id,
    source_atom_id, affected_event_ids. A marker or cut that is not valid and a group without a split are errors.
    """
    events = materialise(events, "build-events")
    stops = sequence.resolve_anchors(cuts.select("scene_id", "marker"), events).join(cuts.select("scene_id", "marker", "cut_ord", "reason"), ["scene_id", "marker"])
    stops = materialise(sequence.checked_cuts(stops.select("scene_id", "cut_ord", "stop", "reason"), events), "build-stops")
    e = sequence.assign_segments(events, stops).withColumn("segment_id", F.format_string("%s_P%03d", "scene_id", "segment_number"))

    at = Window.partitionBy("scene_id", "source_atom_id").orderBy("scene_ord")
    # an atom is a bounded unit; everything below starts from these rows
    e = materialise(e.withColumn("event_index", F.row_number().over(at)), "build-segmented")
    slices = sequence.atom_slices(e).select("segment_id", "source_atom_id", "atom_id", "whole")
    o = F.col("scene_ord")
    ids = [F.first(c).alias(c) for c in ("work_id", "scene_id", "scene_group_id")]
    parts = e.groupBy("segment_id", "source_atom_id").agg(*ids, F.min("scene_ord").alias("_o"), in_order(F.col("event_id"), o).alias("event_ids"), ordered_distinct(in_order(F.col("speakers"), o)).alias("speakers"), F.min_by("source_xpath", "scene_ord").alias("source_xpath"))
    parts = parts.join(slices, ["segment_id", "source_atom_id"]).join(sequence.render(e, ["segment_id", "source_atom_id"], "scene_ord"), ["segment_id", "source_atom_id"])

    of_parts = parts.groupBy("segment_id").agg(in_order(F.col("atom_id"), F.col("_o")).alias("atom_ids"), in_order(F.col("source_atom_id"), F.col("_o")).alias("source_atom_ids"), ordered_distinct(in_order(F.col("speakers"), F.col("_o"))).alias("speakers"))
    labels = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "speaker", F.struct(o.alias("o"), F.col("text").alias("t"))))), lambda x: x["t"])
    head = e.groupBy("segment_id").agg(
        *ids, F.first("segment_number").alias("segment_number"), in_order(F.col("event_id"), o).alias("event_ids"), F.min_by("source_xpath", "scene_ord").alias("source_xpath_start"), F.max_by("source_xpath", "scene_ord").alias("source_xpath_end"),
        F.count_if(F.col("kind") == "verse").cast("int").alias("verse_element_count"), F.count_if(F.col("kind") == "prose").cast("int").alias("prose_element_count"), labels.alias("speaker_labels_in_source"),
    )
    text = sequence.render(e, ["segment_id"], "scene_ord").withColumnRenamed("text", "target_text")
    around = sequence.context(e).drop("scene_id").withColumnsRenamed({"context_before": "context_before_event_ids", "context_after": "context_after_event_ids"})
    last = head.groupBy("scene_id").agg(F.max("segment_number").alias("_last"))
    rows = head.join(of_parts, "segment_id").join(text, "segment_id").join(around, "segment_id").join(sequence.continues(e).drop("scene_id"), "segment_id").join(last, "scene_id")
    k, t = F.col("segment_number"), F.col("target_text")
    rows = rows.withColumn("previous_segment_id", F.when(k > 1, F.format_string("%s_P%03d", "scene_id", k - 1))).withColumn("next_segment_id", F.when(k < F.col("_last"), F.format_string("%s_P%03d", "scene_id", k + 1)))
    rows = rows.select("*", F.sha2(t, 256).alias("target_text_sha256"), word_count(t).alias("word_count"), char_count(t).alias("character_count"), F.lit(None).cast("int").alias("token_count"), F.lit(True).alias("context_after_is_reference_only")).withColumnRenamed("continues", "continues_source_speech")
    rows = rows.withColumn("recommended_task", F.when(F.col("continues_source_speech"), "continuation_or_description").otherwise("description_to_original"))
    if issues is not None:
        found = joins.attach_issues(rows, issues).groupBy("segment_id").agg(F.array_sort(F.collect_set("issue_id")).alias("source_issue_ids"))
        rows = rows.join(found, "segment_id", "left").withColumn("source_issue_ids", F.coalesce("source_issue_ids", F.array().cast("array<string>")))
    rows = splits.frozen(rows.drop("segment_number", "_last"), plan, "scene_group_id")

    reasons = stops.join(e.select("scene_id", F.col("scene_ord").alias("stop"), "segment_id"), ["scene_id", "stop"]).select("segment_id", "reason")
    ledger = sequence.boundary_ledger(e).join(reasons, "segment_id", "left")
    ledger = ledger.select(F.concat("segment_id", F.lit("_END")).alias("boundary_id"), "segment_id", "scene_id", F.when(F.col("next_event").isNull(), "original_scene_end").otherwise("internal_reviewed").alias("boundary_type"), F.col("cut_after").alias("cut_after_event_id"), F.col("next_event").alias("next_event_id"), "left_context", "right_context", "reason")
    return Corpus(rows, parts.drop("_o").withColumn("is_source_atom_slice", ~F.col("whole")).drop("whole"), ledger)


def pairs(segments: DataFrame, annotations: DataFrame, intro: str = encode.INTRO) -> DataFrame:
    """segment_id, split, instruction_de, target_text, instruction_sha256, target_text_sha256, ending_state_de,
    row_index_zero_based. segments: segment_id, split, target_text; annotations: segment_id, form_de, situation_de, beats_de,
    target_text_sha256. Keys must be the same on both sides, hashes must agree, fields be filled and beats be 3 to 9; anything
    else is an error."""
    a = annotations.select("segment_id", "form_de", "situation_de", "beats_de", F.col("target_text_sha256").alias("_sha"))
    rows = joins.total_join(segments.select("segment_id", "split", "target_text"), a, "segment_id")
    blank = lambda c: F.coalesce(strip(c), F.lit("")) == ""
    faults = F.concat_ws(", ", *[F.when(F.coalesce(c, F.lit(True)), n) for n, c in {
        "hash": F.sha2("target_text", 256) != F.col("_sha"), "form": blank(F.col("form_de")), "situation": blank(F.col("situation_de")),
        "number of beats": ~F.size("beats_de").between(3, 9), "blank beat": F.exists("beats_de", blank),
    }.items()])
    text = encode.instruction(F.col("form_de"), F.col("situation_de"), F.col("beats_de"), intro)
    text = F.when(faults != "", F.raise_error(F.concat("segment_id", F.lit(": "), faults))).otherwise(text)
    rows = rows.select("segment_id", "split", text.alias("instruction_de"), "target_text", F.try_element_at("beats_de", F.lit(-1)).alias("ending_state_de"))
    rows = rows.withColumn("instruction_sha256", F.sha2("instruction_de", 256)).withColumn("target_text_sha256", F.sha2("target_text", 256))
    return sequence.row_index(rows, "split", "segment_id")
