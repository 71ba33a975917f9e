"""The two builds over the tables: segments, atoms and ledger from the atoms' events, pairs from annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sha256
from ..operators import build
from ..operators.encode import INTRO
from .base import *

_STEP = 25  # a cut behind every so many atoms, but for the last


def _events(spark, root):
    e = scene_events(spark, root).drop("source_atom_id", "segment_id").withColumn("source_atom_id", F.col("atom_id"))
    a = atoms(spark, root, "atom_id", "source_xpath", "effective_speakers").groupBy("atom_id").agg(F.min("source_xpath").alias("source_xpath"), F.min(F.array_sort(F.coalesce("effective_speakers", F.array().cast("array<string>")))).alias("speakers"))
    return e.join(a, "atom_id").withColumn("scene_group_id", F.concat(F.lit("G_"), "scene_id"))


def _corpus(spark, root):
    e = _events(spark, root)
    n = e.groupBy("scene_id").agg(F.max("atom_number").alias("n")).where(F.col("n") > _STEP)
    k = F.explode(F.sequence(F.lit(1), F.floor((F.col("n") - 1) / _STEP).cast("int")))
    cuts = n.select("scene_id", k.alias("cut_ord")).select("scene_id", "cut_ord", (F.col("cut_ord") * _STEP).cast("string").alias("marker"), F.concat(F.lit("Grund "), "cut_ord").alias("reason"))
    plan = e.select("scene_group_id").distinct().withColumn("split", F.lit("train"))
    return build.corpus(e, cuts, plan, table(spark, root, "source_annotations"))


_SQL = f"""WITH a AS (SELECT atom_id, min(source_xpath) AS xpath, min(list_sort(coalesce(effective_speakers, []))) AS speakers FROM partition_atoms GROUP BY 1),
  n AS (SELECT * EXCLUDE (segment_id, source_atom_id), max(atom_number) OVER (PARTITION BY scene_id) AS atoms, max(scene_ord) OVER (PARTITION BY scene_id) AS total FROM {SQL_SCENE_EVENTS} JOIN a USING (atom_id)),
  e AS (SELECT *, 1 + (atom_number - 1) // {_STEP} AS k, printf('%s_P%03d', scene_id, 1 + (atom_number - 1) // {_STEP}) AS segment_id FROM n),
  s AS (SELECT scene_id, segment_id, k, min(scene_ord) AS lo, max(scene_ord) AS hi, any_value(total) AS total, any_value(work_id) AS work_id, string_agg(event_id, ',' ORDER BY scene_ord) AS event_ids, list(DISTINCT atom_id) AS la, list(event_id) AS le,
    count(*) FILTER (kind = 'verse')::INT AS verses, count(*) FILTER (kind = 'prose')::INT AS proses, arg_min(xpath, scene_ord) AS x0, arg_max(xpath, scene_ord) AS x1, coalesce(string_agg(text, '|' ORDER BY scene_ord) FILTER (kind = 'speaker'), '') AS labels FROM e GROUP BY ALL),
  g AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN '' WHEN kind = 'verse' AND lag(kind) OVER w = 'verse' AND atom_id = lag(atom_id) OVER w THEN chr(10) ELSE chr(10) || chr(10) END || text AS x FROM e WINDOW w AS (PARTITION BY segment_id ORDER BY scene_ord)),
  t AS (SELECT segment_id, string_agg(x, '' ORDER BY scene_ord) AS t FROM g GROUP BY 1),
  sp AS (SELECT segment_id, string_agg(p, ',' ORDER BY o) AS speakers FROM (SELECT segment_id, p, min(o) AS o FROM (SELECT segment_id, unnest(speakers) AS p, scene_ord * 100000 + generate_subscripts(speakers, 1) AS o FROM e) GROUP BY ALL) GROUP BY 1),
  c AS (SELECT s.segment_id, coalesce(string_agg(e.event_id, ',' ORDER BY e.scene_ord) FILTER (e.scene_ord < lo), '') AS before, coalesce(string_agg(e.event_id, ',' ORDER BY e.scene_ord) FILTER (e.scene_ord > hi), '') AS after FROM s LEFT JOIN e ON e.scene_id = s.scene_id AND (e.scene_ord BETWEEN lo - 18 AND lo - 1 OR e.scene_ord BETWEEN hi + 1 AND hi + 12) GROUP BY 1)"""


@query(
    "build_segments",
    _SQL + f""" SELECT segment_id, scene_id, work_id, sha256(t) AS target_text_sha256, len(regexp_extract_all(t, '[^{W}]+'))::INT AS word_count, length(t)::INT AS character_count, event_ids, list_aggregate(list_sort(la), 'string_agg', ',') AS atom_ids, verses AS verse_element_count, proses AS prose_element_count, x0 AS source_xpath_start, x1 AS source_xpath_end, labels,
    coalesce(speakers, '') AS speakers, before AS context_before, after AS context_after, CASE WHEN k > 1 THEN printf('%s_P%03d', scene_id, k - 1) END AS previous_segment_id, CASE WHEN hi < total THEN printf('%s_P%03d', scene_id, k + 1) END AS next_segment_id, false AS continues, 'train' AS split,
    coalesce((SELECT string_agg(DISTINCT issue_id, ',' ORDER BY issue_id) FROM source_annotations i WHERE list_contains(la, i.source_atom_id) OR list_has_any(i.affected_event_ids, le)), '') AS issues FROM s JOIN t USING (segment_id) JOIN c USING (segment_id) LEFT JOIN sp USING (segment_id)""",
)
def build_segments(spark, root):
    """Events and cuts to segments: text, hash, counts, ids, speakers, contexts, neighbours, task, split, issues."""
    s = _corpus(spark, root).segments
    j = lambda c, by=",": F.array_join(c, by)
    return s.select(
        "segment_id", "scene_id", "work_id", "target_text_sha256", "word_count", "character_count", j("event_ids").alias("event_ids"), j("atom_ids").alias("atom_ids"), "verse_element_count", "prose_element_count", "source_xpath_start", "source_xpath_end", j("speaker_labels_in_source", "|").alias("labels"), j("speakers").alias("speakers"),
        j("context_before_event_ids").alias("context_before"), j("context_after_event_ids").alias("context_after"), "previous_segment_id", "next_segment_id", F.col("continues_source_speech").alias("continues"), "split", j("source_issue_ids").alias("issues"),
    )


@query(
    "build_ledger",
    _SQL + """ SELECT segment_id || '_END' AS boundary_id, CASE WHEN hi < total THEN 'internal_reviewed' ELSE 'original_scene_end' END AS boundary_type, (SELECT event_id FROM e WHERE e.scene_id = s.scene_id AND scene_ord = hi) AS cut_after_event_id, (SELECT event_id FROM e WHERE e.scene_id = s.scene_id AND scene_ord = hi + 1) AS next_event_id,
    CASE WHEN hi < total THEN 'Grund ' || k END AS reason FROM s""",
)
def build_ledger(spark, root):
    return _corpus(spark, root).ledger.select("boundary_id", "boundary_type", "cut_after_event_id", "next_event_id", "reason")


@query("build_atoms", _SQL + " SELECT atom_id, any_value(segment_id) AS segment_id, count(*)::INT AS events, sha256(string_agg(y, '' ORDER BY scene_ord)) AS sha FROM (SELECT *, CASE WHEN row_number() OVER w = 1 THEN '' WHEN kind = 'verse' AND lag(kind) OVER w = 'verse' THEN chr(10) ELSE chr(10) || chr(10) END || text AS y FROM e WINDOW w AS (PARTITION BY atom_id ORDER BY scene_ord)) GROUP BY 1")
def build_atoms(spark, root):
    return _corpus(spark, root).atoms.select("atom_id", "segment_id", F.size("event_ids").alias("events"), sha256(F.col("text")).alias("sha"))


_FILLED = "scene_specification.form_de IS NOT NULL AND scene_specification.situation_de IS NOT NULL AND len(scene_specification.beats_de) BETWEEN 3 AND 9"


@query(
    "build_pairs",
    f"""SELECT segment_id, split, row_number() OVER (PARTITION BY split ORDER BY segment_id) - 1 AS row_index_zero_based, sha256('{INTRO}' || chr(10) || chr(10) || 'Form: ' || spec.form_de || chr(10) || 'Ausgangslage: ' || spec.situation_de || chr(10) || 'Ablauf: ' || array_to_string(spec.beats_de, ' ')) AS instruction_sha256,
    sha256(t) AS target_text_sha256, spec.beats_de[-1] AS ending_state_de FROM (SELECT segment_id, {sql_split()} AS split, target_text AS t FROM {sql_segments('split', 'target_text')}) JOIN (SELECT segment_id, scene_specification AS spec FROM {sql_pairs('scene_specification')} WHERE {_FILLED}) USING (segment_id)""",
)
def build_pairs(spark, root):
    """Segments and their annotations (the filled ones among the specifications) to pairs with their export index."""
    a = pairs(spark, root, "scene_specification").where(F.expr("scene_specification.form_de is not null and scene_specification.situation_de is not null and size(scene_specification.beats_de) between 3 and 9"))
    m = segments(spark, root, "split", "target_text").join(a.select("segment_id"), "segment_id", "left_semi").withColumn("split", split_name(F.col("split")))
    a = a.select("segment_id", *[f"scene_specification.{c}" for c in ("form_de", "situation_de", "beats_de")]).join(m.select("segment_id", F.sha2("target_text", 256).alias("target_text_sha256")), "segment_id")
    return build.pairs(m, a).select("segment_id", "split", "row_index_zero_based", "instruction_sha256", "target_text_sha256", "ending_state_de")
