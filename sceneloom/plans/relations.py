"""Queries on joins, ordered events, overlap, splits, encoding and rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lexical_words, overlap_words, sha256, strip
from ..operators import encode, joins, overlap, release, rules, runs, sequence, splits
from ..streaming import early_stop
from . import catalogue, texts  # noqa: F401  # some rules reuse its SQL
from .base import *

# --- joins


@query(
    "j1_lonely_keys",
    "SELECT segment_id, 'left' AS side FROM (SELECT segment_id FROM master_segments WHERE segment_id IS NOT NULL EXCEPT SELECT segment_id FROM sft_pairs) UNION ALL SELECT segment_id, 'right' FROM (SELECT segment_id FROM sft_pairs WHERE segment_id IS NOT NULL EXCEPT SELECT segment_id FROM master_segments)",
)
def j1_lonely(spark, root):
    m, p = (table(spark, root, t).select("segment_id").where("segment_id is not null") for t in ("master_segments", "sft_pairs"))
    return joins.lonely_keys(m, p, "segment_id")


@query("j1_lonely_groups", "SELECT scene_group_id, 'left' AS side FROM (SELECT scene_group_id FROM master_segments WHERE scene_group_id IS NOT NULL EXCEPT SELECT scene_group_id FROM scenes) UNION ALL SELECT scene_group_id, 'right' FROM (SELECT scene_group_id FROM scenes WHERE scene_group_id IS NOT NULL EXCEPT SELECT scene_group_id FROM master_segments)")
def j1_groups(spark, root):
    """Groups as delivered, in all their spellings, against those of the scenes."""
    m, p = (table(spark, root, t).select("scene_group_id").where("scene_group_id is not null") for t in ("master_segments", "scenes"))
    return joins.lonely_keys(m, p, "scene_group_id")


@query("j1_pair_join", f"SELECT m.segment_id, m.target_text = p.target_text AS same_text, m.sha = p.target_text_sha256 AS same_hash FROM (SELECT segment_id, target_text, target_text_sha256 AS sha FROM {sql_segments('target_text', 'target_text_sha256')}) m JOIN {sql_pairs('target_text', 'target_text_sha256')} p USING (segment_id)")
def j1_pairs(spark, root):
    m = segments(spark, root, "target_text", "target_text_sha256").select("segment_id", F.col("target_text").alias("t"), F.col("target_text_sha256").alias("s"))
    p = pairs(spark, root, "target_text", "target_text_sha256")
    return m.join(p, "segment_id").select("segment_id", (F.col("t") == F.col("target_text")).alias("same_text"), (F.col("s") == F.col("target_text_sha256")).alias("same_hash"))


def _ordered_ids(df, by, ids):
    return df.select(by, F.posexplode(ids).alias("ord", "id"))


@query(
    "j2_positional_join",
    f"""WITH a AS (SELECT segment_id, unnest(event_ids) AS id, generate_subscripts(event_ids, 1) - 1 AS ord FROM {sql_segments('event_ids')}), b AS (SELECT segment_id, unnest(e) AS id, generate_subscripts(e, 1) - 1 AS ord FROM (SELECT segment_id, source.event_ids AS e FROM {sql_pairs('source')}))
    SELECT segment_id, ord::INT AS ord, a.id AS left_id, b.id AS right_id FROM a FULL JOIN b USING (segment_id, ord) WHERE a.id IS DISTINCT FROM b.id""",
)
def j2(spark, root):
    a = _ordered_ids(segments(spark, root, "event_ids"), "segment_id", "event_ids")
    b = _ordered_ids(pairs(spark, root, "source"), "segment_id", "source.event_ids")
    return sequence.order_mismatches(a, b, "segment_id")


@query(
    "j3_event_lookup",
    f"SELECT issue_id, count(DISTINCT event) AS affected, count(DISTINCT atom_id) AS atoms, count(DISTINCT segment_id) AS segments FROM (SELECT DISTINCT issue_id, unnest(affected_event_ids) AS event FROM source_annotations) i LEFT JOIN (SELECT atom_id, segment_id, unnest(event_ids) AS event FROM {sql_atoms('atom_id', 'segment_id', 'event_ids')}) e USING (event) GROUP BY 1",
)
def j3(spark, root):
    i = table(spark, root, "source_annotations").select("issue_id", F.explode("affected_event_ids").alias("event")).distinct()
    e = atoms(spark, root, "atom_id", "segment_id", "event_ids").select("atom_id", "segment_id", F.explode("event_ids").alias("event"))
    return i.join(e, "event", "left").groupBy("issue_id").agg(F.count_distinct("event").alias("affected"), F.count_distinct("atom_id").alias("atoms"), F.count_distinct("segment_id").alias("segments"))


def _plan(spark, root):
    s = table(spark, root, "scenes").where("scene_group_id is not null and split is not null").select("scene_group_id", split_name(F.col("split")).alias("split"))
    return s.groupBy("scene_group_id").agg(F.min("split").alias("split"))


_SQL_PLAN = f"(SELECT scene_group_id, min({sql_split()}) AS planned FROM scenes WHERE scene_group_id IS NOT NULL AND split IS NOT NULL GROUP BY 1)"


@query("j4_x1_frozen_split", f"SELECT planned AS split, count(*) AS segments FROM {sql_segments('scene_group_id')} JOIN {_SQL_PLAN} USING (scene_group_id) GROUP BY 1")
def j4(spark, root):
    plan = _plan(spark, root)
    s = segments(spark, root, "scene_group_id").join(plan.select("scene_group_id"), "scene_group_id", "left_semi")
    return splits.frozen(s, plan, "scene_group_id").groupBy("split").agg(F.count(F.lit(1)).alias("segments"))


@query("j4_unplanned", f"SELECT scene_group_id, count(*) AS segments FROM {sql_segments('scene_group_id')} WHERE scene_group_id NOT IN (SELECT scene_group_id FROM {_SQL_PLAN}) GROUP BY 1")
def j4_guard(spark, root):
    s = segments(spark, root, "scene_group_id").where("scene_group_id is not null")
    return s.join(_plan(spark, root), "scene_group_id", "left_anti").groupBy("scene_group_id").agg(F.count(F.lit(1)).alias("segments"))


_LINKS = sql_segments("scene_id", "previous_segment_id", "next_segment_id")


@query("j5_unmutual_links", f"SELECT a.segment_id, a.next_segment_id FROM {_LINKS} a LEFT JOIN {_LINKS} b ON b.segment_id = a.next_segment_id WHERE a.next_segment_id IS NOT NULL AND b.previous_segment_id IS DISTINCT FROM a.segment_id")
def j5(spark, root):
    return sequence.unmutual(segments(spark, root, "scene_id", "previous_segment_id", "next_segment_id"))


@query("j5_neighbours", f"SELECT segment_id, lag(segment_id) OVER w AS previous_segment_id, lead(segment_id) OVER w AS next_segment_id FROM {sql_segments('scene_id')} WHERE scene_id IS NOT NULL WINDOW w AS (PARTITION BY scene_id ORDER BY segment_id)")
def j5_build(spark, root):
    return sequence.neighbours(segments(spark, root, "scene_id").where("scene_id is not null"))


@query(
    "j6_issue_join",
    f"SELECT DISTINCT segment_id, issue_id FROM {sql_segments('event_ids', 'source_atom_ids')} s JOIN source_annotations i ON list_has_any(i.affected_event_ids, s.event_ids) OR list_contains(s.source_atom_ids, i.source_atom_id)",
)
def j6(spark, root):
    return joins.attach_issues(segments(spark, root, "event_ids", "source_atom_ids"), table(spark, root, "source_annotations"))


@query(
    "j7_prefix_join",
    f"SELECT DISTINCT s.segment_id, c.scene_id FROM {sql_segments('work_id', 'source_xpath_start')} s JOIN scenes c ON c.work_id = s.work_id AND starts_with(s.source_xpath_start, c.source_xpath || '/')",
)
def j7(spark, root):
    """The scene whose path is a prefix of the segment's: every prefix of the path becomes a key of an equi-join."""
    s = segments(spark, root, "work_id", "source_xpath_start")
    parts = F.split("source_xpath_start", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    keys = s.where("source_xpath_start is not null").select("segment_id", "work_id", F.explode(prefixes).alias("source_xpath"))
    c = table(spark, root, "scenes").select("work_id", "source_xpath", "scene_id").distinct()
    return keys.join(c, ["work_id", "source_xpath"]).select("segment_id", "scene_id").distinct()


@query("j8_semi_anti", f"SELECT source_kind, count(*) AS atoms, count(*) FILTER (segment_id IN (SELECT segment_id FROM sft_pairs WHERE segment_id IS NOT NULL)) AS paired FROM {sql_atoms('atom_id', 'source_kind', 'segment_id')} WHERE segment_id IS NOT NULL GROUP BY 1")
def j8(spark, root):
    p = table(spark, root, "sft_pairs").select("segment_id", F.lit(1).alias("hit")).distinct()
    a = atoms(spark, root, "atom_id", "source_kind", "segment_id").where("segment_id is not null")
    return a.join(p, "segment_id", "left").groupBy("source_kind").agg(F.count(F.lit(1)).alias("atoms"), F.count("hit").alias("paired"))


@query("j10_conditions", "SELECT case_id, seed, condition FROM eval_scenes, (SELECT unnest([11, 23, 47]) AS seed), (SELECT unnest(['base', 'tuned']) AS condition)")
def j10(spark, root):
    return joins.conditions(table(spark, root, "eval_scenes"), [11, 23, 47], ["base", "tuned"])


@query(
    "j11_reconcile",
    f"SELECT p.segment_id AS path, CASE WHEN m.now IS NOT DISTINCT FROM p.sha256 THEN 'skip' WHEN m.now IS NULL THEN 'write' ELSE 'conflict' END AS action FROM (SELECT segment_id, sha256(target_text) AS sha256 FROM {sql_pairs('target_text')}) p LEFT JOIN (SELECT segment_id, target_text_sha256 AS now FROM {sql_segments('target_text_sha256')}) m USING (segment_id)",
)
def j11(spark, root):
    """Pairs as a payload over the segments present: what is there already, what is new, what differs."""
    payload = pairs(spark, root, "target_text").select(F.col("segment_id").alias("path"), sha256(F.col("target_text")).alias("sha256"), F.lit(None).cast("string").alias("previous_sha256"))
    present = segments(spark, root, "target_text_sha256").select(F.col("segment_id").alias("path"), F.col("target_text_sha256").alias("sha256"))
    return release.reconcile(payload, present)


# --- ordered events


_SQL_MARKED = f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY scene_id, atom_number ORDER BY scene_ord) - 1 AS i FROM {SQL_SCENE_EVENTS}),
    l AS (SELECT scene_id, atom_number, max(i) AS last, max(i) FILTER (kind IN ('verse', 'prose')) AS spoken, arg_max(kind, i) AS last_kind FROM e GROUP BY ALL),
    m AS (SELECT *, CASE WHEN last_kind = 'stage' AND last > 0 THEN '!' WHEN spoken IS NULL THEN '' WHEN atom_number % 3 = 0 THEN '^' WHEN atom_number % 3 = 1 THEN '@0' ELSE '' END AS sign FROM l),
    r AS (SELECT m.scene_id, m.atom_number, m.atom_number || sign AS marker, e.event_id, e.scene_ord::INT AS stop FROM m JOIN e USING (scene_id, atom_number) WHERE e.i = CASE sign WHEN '!' THEN last - 1 WHEN '^' THEN spoken WHEN '@0' THEN 0 ELSE last END)"""


def _marked(spark, root):
    """(events, a marker for every atom in one of the four spellings of the grammar, resolved)."""
    e = scene_events(spark, root)
    a = e.groupBy("scene_id", "atom_number").agg(F.max(F.when(F.col("kind").isin("verse", "prose"), 1)).alias("spoken"), F.max_by("kind", "scene_ord").alias("last"), F.count(F.lit(1)).alias("n"))
    k = F.col("atom_number") % 3
    sign = F.when((F.col("last") == "stage") & (F.col("n") > 1), "!").when(F.col("spoken").isNull(), "").when(k == 0, "^").when(k == 1, "@0").otherwise("")
    return e, sequence.resolve_anchors(a.select("scene_id", F.concat("atom_number", sign).alias("marker")), e)


@query("w1_anchors", _SQL_MARKED + " SELECT scene_id, marker, event_id, stop FROM r")
def w1(spark, root):
    return _marked(spark, root)[1]


@query(
    "w2_invalid_cuts",
    _SQL_MARKED + """, c AS (SELECT *, lag(stop) OVER (PARTITION BY scene_id ORDER BY atom_number) AS before FROM r), n AS (SELECT scene_id, count(*) AS n FROM e GROUP BY 1)
    SELECT scene_id, stop FROM c JOIN n USING (scene_id) WHERE coalesce(stop <= before, false) OR stop <= 0 OR stop >= n""",
)
def w2(spark, root):
    """The cuts behind every atom as they stand: those at the end of a scene don't lie inside it."""
    e, cuts = _marked(spark, root)
    return sequence.invalid_cuts(cuts.select("scene_id", F.regexp_extract("marker", r"^\d+", 0).cast("int").alias("cut_ord"), "stop"), e)


@query(
    "w3_segment_assignment",
    f"SELECT scene_id, segment_number, count(*) AS events, min(event_id) AS first FROM (SELECT *, 1 + sum(CASE WHEN kind = 'stage' AND source_kind = 'stage' THEN 1 ELSE 0 END) OVER (PARTITION BY scene_id ORDER BY scene_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM {SQL_SCENE_EVENTS}) t, LATERAL (SELECT coalesce(n, 1)::BIGINT AS segment_number) GROUP BY ALL",
)
def w3(spark, root):
    e = scene_events(spark, root)
    stops = e.where("kind = 'stage'").select("scene_id", F.col("scene_ord").alias("stop"))
    return sequence.assign_segments(e, stops).groupBy("scene_id", "segment_number").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first"))


@query(
    "w4_atom_slices",
    f"""SELECT atom_id, count(*) AS n FROM (SELECT source_atom_id || CASE WHEN whole THEN '' ELSE printf('_e%04d-%04d', a, b) END AS atom_id FROM (SELECT p.*, (a = low AND b = high) AS whole FROM
    (SELECT segment_id, source_atom_id, min(k) AS a, max(k) AS b FROM e GROUP BY ALL) p JOIN (SELECT source_atom_id, min(k) AS low, max(k) AS high FROM e GROUP BY ALL) q USING (source_atom_id))) GROUP BY ALL""".replace(
        "FROM e GROUP", f"FROM (SELECT segment_id, source_atom_id, CAST(regexp_extract(ev, '_E(\\d+)$', 1) AS INT) AS k FROM (SELECT segment_id, source_atom_id, unnest(event_ids) AS ev FROM {sql_atoms('atom_id', 'segment_id', 'source_atom_id', 'event_ids')} WHERE segment_id IS NOT NULL)) GROUP"
    ),
)
def w4(spark, root):
    e = atoms(spark, root, "atom_id", "segment_id", "source_atom_id", "event_ids").where("segment_id is not null").select("segment_id", "source_atom_id", F.explode("event_ids").alias("e"))
    e = e.withColumn("event_index", F.regexp_extract("e", r"_E(\d+)$", 1).cast("int"))
    return sequence.atom_slices(e).groupBy("atom_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "w5_render",
    f"""SELECT scene_id, ((scene_ord - 1) // 1000)::INT AS piece, sha256(string_agg(glue || text, '' ORDER BY scene_ord)) AS sha, sum(length(glue || text))::BIGINT AS chars FROM (SELECT *, CASE WHEN scene_ord = 1 THEN '' WHEN kind = 'verse' AND lag(kind) OVER w = 'verse' AND stanza_ids = lag(stanza_ids) OVER w AND source_atom_id = lag(source_atom_id) OVER w THEN chr(10) ELSE chr(10) || chr(10) END AS glue
    FROM {SQL_SCENE_EVENTS} WINDOW w AS (PARTITION BY scene_id ORDER BY scene_ord)) GROUP BY 1, 2""",
)
def w5(spark, root):
    """The texts of all scenes, in pieces of a thousand events."""
    r = sequence.render_scenes(scene_events(spark, root))
    return r.select("scene_id", "piece", sha256(F.col("text")).alias("sha"), F.length("text").cast("bigint").alias("chars"))


@query(
    "w5b_render_parser_form",
    f"""SELECT atom_id, sha256(string_agg(glue || text, '' ORDER BY event_index)) AS sha FROM (SELECT *, CASE WHEN row_number() OVER w = 1 THEN '' WHEN kind = 'verse' AND lag(kind) OVER w = 'verse' AND stanza_ids = lag(stanza_ids) OVER w THEN chr(10) ELSE chr(10) || chr(10) END AS glue
    FROM {SQL_EVENTS} WINDOW w AS (PARTITION BY atom_id ORDER BY event_index)) GROUP BY 1""",
)
def w5b(spark, root):
    """The text of each atom by the rule that doesn't look at the source atom."""
    return sequence.render(events(spark, root), ["atom_id"], "event_index", across_atoms=True).select("atom_id", sha256(F.col("text")).alias("sha"))


@query(
    "filters_predicates",
    f"""SELECT work_id, count(*) AS atoms, count(*) FILTER (starts_with(source_xpath, '/t:TEI/t:text[1]/t:body[1]')) AS in_body, count(*) FILTER (split IS NULL) AS unsplit, count(*) FILTER (len([e FOR e IN event_ids IF contains(e, '_E0001')]) > 0) AS with_first,
    count(*) FILTER (len([s FOR s IN effective_speakers IF length(s) > 6]) = len(effective_speakers)) AS long_names FROM {sql_atoms('atom_id', 'work_id', 'source_xpath', 'split', 'event_ids', 'effective_speakers')} GROUP BY 1""",
)
def filters(spark, root):
    """Prefix, null, any and all predicates over atoms."""
    a = atoms(spark, root, "atom_id", "work_id", "source_xpath", "split", "event_ids", "effective_speakers")
    return a.groupBy("work_id").agg(
        F.count(F.lit(1)).alias("atoms"),
        F.count_if(F.col("source_xpath").startswith("/t:TEI/t:text[1]/t:body[1]")).alias("in_body"),
        F.count_if(F.col("split").isNull()).alias("unsplit"),
        F.count_if(F.exists("event_ids", lambda e: F.contains(e, F.lit("_E0001")))).alias("with_first"),
        F.count_if(F.forall("effective_speakers", lambda s: F.length(s) > 6)).alias("long_names"),
    )


def _sql_context(before, after):
    return f"""WITH e AS {SQL_SCENE_EVENTS}, s AS (SELECT scene_id, segment_id, min(scene_ord) AS lo, max(scene_ord) AS hi FROM e WHERE segment_id IS NOT NULL GROUP BY ALL)
    SELECT s.scene_id, s.segment_id, coalesce(string_agg(e.event_id, ',' ORDER BY e.scene_ord) FILTER (e.scene_ord < lo), '') AS context_before, coalesce(string_agg(e.event_id, ',' ORDER BY e.scene_ord) FILTER (e.scene_ord > hi), '') AS context_after
    FROM s LEFT JOIN e ON e.scene_id = s.scene_id AND (e.scene_ord BETWEEN lo - {before} AND lo - 1 OR e.scene_ord BETWEEN hi + 1 AND hi + {after}) GROUP BY s.scene_id, s.segment_id"""


@query("w6_context", _sql_context(18, 12))
def w6(spark, root):
    rows = sequence.context(scene_events(spark, root))
    return rows.select("scene_id", "segment_id", F.array_join("context_before", ",").alias("context_before"), F.array_join("context_after", ",").alias("context_after"))


@query(
    "w7_ledger",
    f"""WITH e AS {SQL_SCENE_EVENTS}, h AS (SELECT scene_id, segment_id, max(scene_ord) AS hi, arg_max(event_id, scene_ord) AS cut_after FROM e WHERE segment_id IS NOT NULL GROUP BY ALL),
    n AS (SELECT h.scene_id, h.segment_id, hi, cut_after, e.event_id, e.scene_ord, e.kind, e.source_atom_id, e.text, (e.scene_ord > hi) AS behind FROM h JOIN e ON e.scene_id = h.scene_id AND e.scene_ord BETWEEN hi - 11 AND hi + 12 WHERE e.scene_ord > hi OR e.segment_id = h.segment_id),
    g AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN '' WHEN kind = 'verse' AND lag(kind) OVER w = 'verse' AND source_atom_id = lag(source_atom_id) OVER w THEN chr(10) ELSE chr(10) || chr(10) END || text AS x FROM n WINDOW w AS (PARTITION BY scene_id, segment_id, behind ORDER BY scene_ord))
    SELECT scene_id, segment_id, any_value(cut_after) AS cut_after, max(event_id) FILTER (scene_ord = hi + 1) AS next_event, coalesce(string_agg(event_id, ',' ORDER BY scene_ord) FILTER (NOT behind), '') AS left_events, coalesce(string_agg(event_id, ',' ORDER BY scene_ord) FILTER (behind), '') AS right_events,
    sha256(coalesce(string_agg(x, '' ORDER BY scene_ord) FILTER (NOT behind), '')) AS left_sha, sha256(coalesce(string_agg(x, '' ORDER BY scene_ord) FILTER (behind), '')) AS right_sha FROM g GROUP BY ALL""",
)
def w7(spark, root):
    """The end of every segment with up to twelve events of the segment before it and of the scene behind it."""
    r = sequence.boundary_ledger(scene_events(spark, root))
    return r.select("scene_id", "segment_id", "cut_after", "next_event", F.array_join("left_events", ",").alias("left_events"), F.array_join("right_events", ",").alias("right_events"), sha256(F.col("left_context")).alias("left_sha"), sha256(F.col("right_context")).alias("right_sha"))


@query(
    "w8_continues",
    f"SELECT scene_id, segment_id, (k = 'verse' AND coalesce(same, false)) AS continues FROM (SELECT scene_id, segment_id, arg_min(kind, scene_ord) AS k, arg_min(coalesce(before = source_atom_id, false), scene_ord) AS same FROM (SELECT *, lag(source_atom_id) OVER (PARTITION BY scene_id ORDER BY scene_ord) AS before FROM {SQL_SCENE_EVENTS}) WHERE segment_id IS NOT NULL GROUP BY 1, 2)",
)
def w8(spark, root):
    return sequence.continues(scene_events(spark, root))


@query(
    "w9_latched_speaker",
    f"""SELECT source_atom_id, count(*) AS changed FROM (SELECT *, max(CASE WHEN contains(text, '(ab)') THEN 1 ELSE 0 END) OVER (PARTITION BY source_atom_id, segment_id, atom_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latched FROM {SQL_EVENTS})
    WHERE latched = 1 AND kind IN ('verse', 'prose') AND NOT contains(text, '(ab)') GROUP BY 1""",
)
def w9(spark, root):
    """Lines spoken in an atom after someone left in it."""
    e = events(spark, root).drop("source_atom_id").withColumnRenamed("atom_id", "source_atom_id").withColumn("speaker", F.lit("someone"))
    out = sequence.latch(e, F.contains("text", F.lit("(ab)")), F.lit("offstage"), "speaker").where("speaker = 'offstage'")
    return out.select(F.regexp_replace("source_atom_id", r"_e\d+-\d+$", "").alias("source_atom_id")).groupBy("source_atom_id").agg(F.count(F.lit(1)).alias("changed"))


@query("w10_first_last", f"SELECT segment_id, arg_min(source_xpath, atom_id) AS first, arg_max(source_xpath, atom_id) AS last FROM {sql_atoms('atom_id', 'segment_id', 'source_xpath')} WHERE source_xpath IS NOT NULL GROUP BY 1")
def w10(spark, root):
    a = atoms(spark, root, "atom_id", "segment_id", "source_xpath").where("source_xpath is not null")
    return a.groupBy("segment_id").agg(F.min_by("source_xpath", "atom_id").alias("first"), F.max_by("source_xpath", "atom_id").alias("last"))


_SQL_FIFTHS = f"(SELECT * REPLACE (scene_id || '-' || (scene_ord - 1) // 5 AS segment_id) FROM {SQL_SCENE_EVENTS})"


@query(
    "w11_bad_cuts",
    f"SELECT scene_id, event_id, kind = 'speaker' AS after_label, (kind = 'verse' AND next_kind = 'verse' AND next_atom = source_atom_id) AS inside_stanza FROM (SELECT *, lead(kind) OVER w AS next_kind, lead(source_atom_id) OVER w AS next_atom, lead(segment_id) OVER w AS next_segment FROM {_SQL_FIFTHS} WINDOW w AS (PARTITION BY scene_id ORDER BY scene_ord)) WHERE next_segment <> segment_id AND (kind = 'speaker' OR (kind = 'verse' AND next_kind = 'verse' AND next_atom = source_atom_id))",
)
def w11(spark, root):
    """Cut behind every fifth event, the bad places among the cuts (the delivered cuts are all good)."""
    e = scene_events(spark, root)
    return sequence.bad_cuts(e.withColumn("segment_id", F.concat_ws("-", "scene_id", F.floor((F.col("scene_ord") - 1) / 5))))


@query(
    "w12_order_equality",
    f"""WITH a AS (SELECT segment_id, unnest(atom_ids) AS id, generate_subscripts(atom_ids, 1) - 1 AS ord FROM {sql_segments('atom_ids')}), b AS (SELECT segment_id, atom_id AS id, row_number() OVER (PARTITION BY segment_id ORDER BY atom_id) - 1 AS ord FROM {sql_atoms('atom_id', 'segment_id')})
    SELECT segment_id, ord::INT AS ord, a.id AS left_id, b.id AS right_id FROM a FULL JOIN b USING (segment_id, ord) WHERE a.id IS DISTINCT FROM b.id""",
)
def w12(spark, root):
    a = _ordered_ids(segments(spark, root, "atom_ids"), "segment_id", "atom_ids")
    w = Window.partitionBy("segment_id").orderBy("atom_id")
    b = atoms(spark, root, "atom_id", "segment_id").select("segment_id", (F.row_number().over(w) - 1).alias("ord"), F.col("atom_id").alias("id"))
    return sequence.order_mismatches(a, b, "segment_id")


@query(
    "w13_x2_export_index",
    f"SELECT split, segment_id, row_number() OVER (PARTITION BY split ORDER BY segment_id) - 1 AS row_index_zero_based, sha256(instruction_de) AS instruction_sha256, sha256(target_text) AS target_text_sha256 FROM (SELECT segment_id, {sql_split()} AS split, instruction_de, target_text FROM {sql_pairs('split', 'instruction_de', 'target_text')})",
)
def w13(spark, root):
    p = pairs(spark, root, "split", "instruction_de", "target_text").withColumn("split", split_name(F.col("split")))
    return splits.export_index(p)


@query(
    "w14_early_stop",
    """WITH r AS (SELECT user_id, event_id, ts, value, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    b AS (SELECT *, max(CASE WHEN best IS NULL OR value < best THEN k END) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS last_better FROM r)
    SELECT user_id, min(k) FILTER (k - last_better >= 2) AS stop_at, count(*) AS evaluations FROM b GROUP BY 1""",
)
def w14(spark, root):
    """Where a run of evaluations would stop after two without improvement; the event table stands in for a log."""
    return early_stop(table(spark, root, "events"), "user_id", "value", ["ts", "event_id"], patience=2)


# --- overlap


def _sql_runs(n, prompts, targets):
    gram = "array_to_string(w[p:p + {0}], ' ')".format(n - 1)
    grams = "SELECT {k}, p, {g} AS g FROM (SELECT {k}, w, unnest(range(1, len(w) - {m})) AS p FROM {t})"
    return f"""ps AS ({prompts}), ts AS ({targets}), pg AS ({grams.format(k='case_id', g=gram, m=n - 2, t='ps')}), tg AS ({grams.format(k='segment_id', g=gram, m=n - 2, t='ts')}),
    hits AS (SELECT case_id, segment_id, pg.p AS p, tg.p - pg.p AS d FROM pg JOIN tg USING (g)), runs AS (SELECT *, p - row_number() OVER (PARTITION BY case_id, segment_id, d ORDER BY p) AS run FROM hits),
    found AS (SELECT case_id, segment_id, p - 1 AS pos, p + d - 1 AS target_pos, max(p) OVER (PARTITION BY case_id, segment_id, d, run) - p + {n} AS length FROM runs)"""


_PROMPTS = f"SELECT case_id, {LEXICAL.format('instruction_de')} AS w FROM eval_scenes WHERE instruction_de IS NOT NULL"
_TARGETS = f"SELECT segment_id, {LEXICAL.format('target_text')} AS w FROM {sql_pairs('target_text')} WHERE target_text IS NOT NULL"


def _runs(spark, root):
    e = table(spark, root, "eval_scenes").where("instruction_de is not null")
    t = pairs(spark, root, "target_text").where("target_text is not null")
    return e, overlap.matches(e, "case_id", lexical_words(F.col("instruction_de")), t, "segment_id", lexical_words(F.col("target_text")), 4)


@query("l1_l2_word_runs", f"WITH {_sql_runs(4, _PROMPTS, _TARGETS)} SELECT case_id, segment_id, pos::INT AS pos, target_pos::INT AS target_pos, length::INT AS length FROM found")
def l2(spark, root):
    return _runs(spark, root)[1]


@query("l3_a14_gate", f"WITH {_sql_runs(4, _PROMPTS, _TARGETS)} SELECT case_id, coalesce(max(length), 0)::INT AS longest_any, coalesce(max(length) FILTER (segment_id = case_id), 0)::INT AS longest_own, coalesce(max(length), 0) < 6 AS passes FROM eval_scenes LEFT JOIN found USING (case_id) WHERE instruction_de IS NOT NULL GROUP BY 1")
def l3(spark, root):
    e, found = _runs(spark, root)
    return overlap.longest(e, found, "case_id", "segment_id")


_PAIR_PROMPTS = f"SELECT segment_id AS case_id, {LEXICAL.format('instruction_de')} AS w FROM {sql_pairs('instruction_de')} WHERE instruction_de IS NOT NULL"


def _pair_texts(spark, root):
    """The screen of the training prompts: every pair's instruction against the targets of all pairs, its own among them."""
    e = pairs(spark, root, "instruction_de").where("instruction_de is not null").withColumnRenamed("segment_id", "case_id")
    t = pairs(spark, root, "target_text").where("target_text is not null")
    return e, "case_id", lexical_words(F.col("instruction_de")), t, "segment_id", lexical_words(F.col("target_text")), 4


@query("l1_l2_pair_word_runs", f"WITH {_sql_runs(4, _PAIR_PROMPTS, _TARGETS)} SELECT case_id, segment_id, pos::INT AS pos, target_pos::INT AS target_pos, length::INT AS length FROM found")
def l2_pairs(spark, root):
    return runs.matches(*_pair_texts(spark, root))


@query(
    "l3_a14_pair_gate",
    f"""WITH {_sql_runs(4, _PAIR_PROMPTS, _TARGETS)} SELECT case_id, coalesce(max(length), 0)::INT AS longest_any, coalesce(max(length) FILTER (segment_id = case_id), 0)::INT AS longest_own, coalesce(max(length), 0) < 6 AS passes FROM ps LEFT JOIN found USING (case_id) GROUP BY 1""",
)
def l3_pairs(spark, root):
    return runs.longest(*_pair_texts(spark, root))


@query(
    "l4_reuse_ratio",
    f"""WITH g AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM (SELECT doc_id, {OVERLAP.format('text')} AS w FROM documents))),
    t AS (SELECT DISTINCT array_to_string(w[p:p + 7], ' ') AS g FROM (SELECT w, unnest(range(1, len(w) - 6)) AS p FROM (SELECT {OVERLAP.format('target_text')} AS w FROM {sql_pairs('split', 'target_text')} WHERE {sql_split()} = 'train')))
    SELECT d.doc_id, count(g.g) AS grams, count(t.g) AS reused, count(t.g) / greatest(1, count(g.g)) AS ratio FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN t ON t.g = g.g GROUP BY 1""",
)
def l4(spark, root):
    pool = pairs(spark, root, "split", "target_text").where(split_name(F.col("split")) == "train")
    return overlap.reuse(table(spark, root, "documents").select("doc_id", "text"), "doc_id", overlap_words(F.col("text")), pool, overlap_words(F.col("target_text")), 8)


_POOL = f"(SELECT segment_id, scene_specification.form_de AS form, target_text AS text FROM {sql_pairs('split', 'scene_specification', 'target_text')} WHERE {sql_split()} = 'train' AND target_text IS NOT NULL)"


@query(
    "l5_reference_pick",
    f"""SELECT case_id, segment_id FROM (SELECT case_id, segment_id, row_number() OVER (PARTITION BY case_id ORDER BY (form_de IS DISTINCT FROM form)::INT, abs(length(text) - 1500), segment_id) AS k FROM eval_scenes, {_POOL} p) WHERE k = 1""",
)
def l5(spark, root):
    pool = pairs(spark, root, "split", "scene_specification", "target_text").where(split_name(F.col("split")) == "train").select("segment_id", F.col("scene_specification.form_de").alias("form"), F.col("target_text").alias("text"))
    return overlap.pick_reference(table(spark, root, "eval_scenes").select("case_id", F.col("form_de").alias("form")), pool)


# --- encoding


def _encoded(spark, root):
    p = pairs(spark, root, "split", "instruction_de", "target_text").where((strip(F.col("instruction_de")) != "") & (strip(F.col("target_text")) != ""))
    ids, mask, labels = encode.masked(encode.code_points(encode.training_prompt(F.col("instruction_de"))), encode.code_points(F.col("target_text")), 0)
    return p.select("segment_id", split_name(F.col("split")).alias("split"), ids.alias("input_ids"), mask.alias("attention_mask"), labels.alias("labels"))


_SQL_ENCODED = f"(SELECT segment_id, {sql_split()} AS split, instruction_de, target_text, length(instruction_de) + 29 AS prompt, length(target_text) + 1 AS completion FROM {sql_pairs('split', 'instruction_de', 'target_text')} WHERE {NORM.format('instruction_de')} <> '' AND {NORM.format('target_text')} <> '')"


@query("x4_x5_encoded_lengths", f"SELECT segment_id, (prompt + completion)::INT AS total, prompt::INT AS prompt, completion::INT AS completion FROM {_SQL_ENCODED}")
def x5(spark, root):
    return encode.lengths(_encoded(spark, root))


_CODES = "[unicode(c) FOR c IN string_split({0}, '')]"
_PROMPT = "'### Aufgabe' || chr(10) || instruction_de || chr(10) || chr(10) || '### Textauszug' || chr(10)"


@query(
    "x4_encoded",
    f"""SELECT segment_id, sha256(array_to_string(list_concat({_CODES.format(_PROMPT)}, {_CODES.format('target_text')}, [0]), ',')) AS ids, sha256(array_to_string([1 FOR x IN range(prompt + completion)], ',')) AS mask,
    sha256(array_to_string(list_concat([-100 FOR x IN range(prompt)], {_CODES.format('target_text')}, [0]), ',')) AS labels FROM {_SQL_ENCODED}""",
)
def x4(spark, root):
    """Ids, mask and labels of every sample, element by element."""
    h = lambda c: sha256(F.array_join(F.transform(c, lambda x: x.cast("string")), ","))
    return _encoded(spark, root).select("segment_id", h("input_ids").alias("ids"), h("attention_mask").alias("mask"), h("labels").alias("labels"))


@query("x6_padding", f"SELECT batch, segment_id, max(prompt + completion) OVER (PARTITION BY batch)::INT AS padded, (prompt + completion)::INT AS attended, completion::INT AS learned FROM (SELECT *, substr(sha256(segment_id), 1, 3) AS batch FROM {_SQL_ENCODED})")
def x6(spark, root):
    rows = _encoded(spark, root).withColumn("batch", F.substring(F.sha2("segment_id", 256), 1, 3))
    p = encode.padded(rows, "batch", 0)
    return p.select("batch", "segment_id", F.size("input_ids").alias("padded"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("attended"), F.size(F.filter("labels", lambda x: x != encode.IGNORED)).alias("learned"))


@query("n15_x8_length_budget", f"SELECT least(16384, (ceil(max(prompt + completion) / 64) * 64)::INT) AS budget FROM {_SQL_ENCODED} WHERE split IN ('train', 'validation')")
def x8(spark, root):
    rows = _encoded(spark, root).where("split in ('train', 'validation')")
    return rows.agg(F.max(F.size("input_ids")).alias("m")).select(encode.budget(F.col("m"), 16384).alias("budget"))


@query("x9_blind_order", "SELECT case_id, condition, chr(64 + (row_number() OVER (PARTITION BY case_id ORDER BY sha256('7|' || case_id || '|' || condition), condition))::INT) AS label FROM eval_scenes, (SELECT unnest(['base', 'tuned', 'human']) AS condition)")
def x9(spark, root):
    c = joins.conditions(table(spark, root, "eval_scenes"), [7], ["base", "tuned", "human"]).select("case_id", "condition")
    return splits.blind_order(c, "case_id", "condition", "7").select("case_id", "condition", "label")


@query("x1_hashed_split", "SELECT split, count(*) AS documents, count(DISTINCT source) AS sources FROM (SELECT source, CASE WHEN b < 'cc' THEN 'train' WHEN b < 'e6' THEN 'validation' ELSE 'test' END AS split FROM (SELECT source, substr(sha256(source), 1, 2) AS b FROM documents WHERE source IS NOT NULL)) GROUP BY 1")
def x1(spark, root):
    d = table(spark, root, "documents").where("source is not null").select("source", splits.hashed_split(F.col("source")).alias("split"))
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("source").alias("sources"))


# --- sets


@query(
    "sets_speakers",
    f"""SELECT work_id, count(DISTINCT s) FILTER (a AND b) AS both_splits, count(DISTINCT s) FILTER (a AND NOT b) AS train_only, count(DISTINCT s) FILTER (b AND NOT a) AS other_only FROM (SELECT work_id, s, bool_or(split = 'train') AS a, bool_or(split <> 'train') AS b
    FROM (SELECT work_id, {sql_split()} AS split, unnest(effective_speakers) AS s FROM partition_atoms WHERE split IS NOT NULL) GROUP BY 1, 2) GROUP BY 1""",
)
def sets(spark, root):
    """Intersection and differences of two sets of speakers for each work."""
    a = table(spark, root, "partition_atoms").where("split is not null").select("work_id", split_name(F.col("split")).alias("split"), F.explode("effective_speakers").alias("s"))
    side = lambda c: F.collect_set(F.when(c, F.col("s")))  # noqa: E731  # speakers of a work: as many as it has roles
    g = a.groupBy("work_id").agg(side(F.col("split") == "train").alias("a"), side(F.col("split") != "train").alias("b"))
    n = lambda c: F.size(c).cast("bigint")
    return g.select("work_id", n(F.array_intersect("a", "b")).alias("both_splits"), n(F.array_except("a", "b")).alias("train_only"), n(F.array_except("b", "a")).alias("other_only"))


# --- rules


def _rules(spark, root):
    m = table(spark, root, "master_segments")
    p = table(spark, root, "sft_pairs")
    a = table(spark, root, "partition_atoms")
    s = table(spark, root, "scenes")
    i = table(spark, root, "source_annotations")
    d = table(spark, root, "documents")
    w = table(spark, root, "works")
    li, o = table(spark, root, "lineitem"), table(spark, root, "orders")
    named = m.select("segment_id", "scene_id", "scene_group_id", split_name(F.col("split")).alias("split"))
    paired = p.select("segment_id", "scene_group_id", split_name(F.col("split")).alias("split"))
    texts = p.select(F.sha2("target_text", 256).alias("t"), F.sha2("instruction_de", 256).alias("i"), "segment_id", split_name(F.col("split")).alias("split"))
    last, last_pair = segments(spark, root, "target_text", "split", "event_ids", "verse_element_count"), pairs(spark, root, "target_text", "split", "source")
    both = last.select("segment_id", F.col("target_text").alias("t"), split_name(F.col("split")).alias("s"), F.col("event_ids").alias("e")).join(last_pair, "segment_id")
    return catalogue.row_rules(spark, root) + [
        rules.unique("segments_unique", m, "segment_id"),
        rules.unique("atoms_unique", a, "atom_id"),
        rules.unique("scenes_unique", s, "scene_id"),
        rules.unique("issues_unique", i, "issue_id"),
        rules.unique("documents_unique", d, "doc_id"),
        rules.unique("works_unique", w, "work_id"),
        rules.unique("scene_numbers_unique", s.select("work_id", "scene_index", "scene_id").distinct(), "work_id", "scene_index"),
        rules.unique("pair_targets_unique", texts.select("t", "segment_id").where("t is not null").distinct(), "t"),
        rules.unique("instructions_unique", texts.select("i", "segment_id").where("i is not null").distinct(), "i"),
        rules.references("segment_scenes_exist", m, "scene_id", s, "scene_id"),
        rules.references("segment_works_exist", m, "work_id", w, "work_id"),
        rules.references("scene_works_exist", s, "work_id", w, "work_id"),
        rules.references("document_works_exist", d, "work_ref", w, "work_id"),
        rules.references("atom_segments_exist", a, "segment_id", m, "segment_id"),
        rules.references("previous_segments_exist", m, "previous_segment_id", m, "segment_id"),
        rules.references("next_segments_exist", m, "next_segment_id", m, "segment_id"),
        rules.references("issue_atoms_exist", i, "source_atom_id", a, "source_atom_id"),
        rules.references("segment_issues_exist", m.select(F.explode("source_issue_ids").alias("issue_id")), "issue_id", i, "issue_id"),
        rules.references("segment_atoms_exist", m.select(F.explode("atom_ids").alias("atom_id")), "atom_id", a, "atom_id"),
        rules.references("issue_events_exist", i.select(F.explode("affected_event_ids").alias("e")), "e", a.select(F.explode("event_ids").alias("e")), "e"),
        rules.references("lineitem_orders_exist", li, "l_orderkey", o, "o_orderkey"),
        rules.same_keys("pairs_match_segments", m.where("segment_id is not null"), p.where("segment_id is not null"), "segment_id"),
        rules.one_split("scenes_in_one_split", named, "scene_id", "split"),
        rules.one_split("groups_in_one_split", named, "scene_group_id", "split"),
        rules.one_split("segments_in_one_split", named, "segment_id", "split"),
        rules.one_split("pair_groups_in_one_split", paired, "scene_group_id", "split"),
        rules.one_split("targets_in_one_split", texts, "t", "split"),
        *rules.of_rows(both, "segment_id", [("pair_targets_as_in_segments", "derived", F.col("t").eqNullSafe(F.col("target_text"))), ("pair_splits_as_in_segments", "derived", F.col("s").eqNullSafe(split_name(F.col("split")))), ("pair_events_as_in_segments", "order", F.col("e").eqNullSafe(F.col("source.event_ids")))]),
        rules.ordered("atom_order", lambda: w12(spark, root), "segment_id"),
        rules.equal_totals("events_conserved", segments(spark, root, "event_ids"), F.size("event_ids"), atoms(spark, root, "atom_id", "event_ids"), F.size("event_ids")),
    ]


def _sql_rules() -> dict[str, tuple[str, str]]:
    named = f"(SELECT segment_id, scene_id, scene_group_id, {sql_split()} AS split FROM master_segments)"
    texts = f"(SELECT sha256(target_text) AS t, sha256(instruction_de) AS i, segment_id, scene_group_id, {sql_split()} AS split FROM sft_pairs)"
    both = f"(SELECT m.segment_id, m.target_text AS t, {sql_split('m.split')} AS s, m.event_ids AS e, p.target_text, {sql_split('p.split')} AS split, p.source FROM {sql_segments('target_text', 'split', 'event_ids', 'verse_element_count')} m JOIN {sql_pairs('target_text', 'split', 'source')} p USING (segment_id))"

    def unique(of, *keys):
        shown = " || '|' || ".join(f"coalesce({k}::VARCHAR, 'null')" for k in keys)
        return ("unique", f"SELECT {shown} AS key FROM {of} GROUP BY {', '.join(keys)} HAVING count(*) > 1")

    def known(of, column, to, to_column):
        return ("reference", f"SELECT DISTINCT {column}::VARCHAR AS key FROM {of} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {to_column} FROM {to} WHERE {to_column} IS NOT NULL)")

    def one(of, group):
        return ("leakage", f"SELECT {group} AS key FROM {of} WHERE {group} IS NOT NULL AND split IS NOT NULL GROUP BY 1 HAVING min(split) <> max(split)")

    order = "SELECT DISTINCT segment_id AS key FROM (" + REGISTRY["w12_order_equality"][1] + ")"
    return catalogue.sql_row_rules() | {
        "segments_unique": unique("master_segments", "segment_id"),
        "atoms_unique": unique("partition_atoms", "atom_id"),
        "scenes_unique": unique("scenes", "scene_id"),
        "issues_unique": unique("source_annotations", "issue_id"),
        "documents_unique": unique("documents", "doc_id"),
        "works_unique": unique("works", "work_id"),
        "scene_numbers_unique": unique("(SELECT DISTINCT work_id, scene_index, scene_id FROM scenes)", "work_id", "scene_index"),
        "pair_targets_unique": unique(f"(SELECT DISTINCT t, segment_id FROM {texts} WHERE t IS NOT NULL)", "t"),
        "instructions_unique": unique(f"(SELECT DISTINCT i, segment_id FROM {texts} WHERE i IS NOT NULL)", "i"),
        "segment_scenes_exist": known("master_segments", "scene_id", "scenes", "scene_id"),
        "segment_works_exist": known("master_segments", "work_id", "works", "work_id"),
        "scene_works_exist": known("scenes", "work_id", "works", "work_id"),
        "document_works_exist": known("documents", "work_ref", "works", "work_id"),
        "atom_segments_exist": known("partition_atoms", "segment_id", "master_segments", "segment_id"),
        "previous_segments_exist": known("master_segments", "previous_segment_id", "master_segments", "segment_id"),
        "next_segments_exist": known("master_segments", "next_segment_id", "master_segments", "segment_id"),
        "issue_atoms_exist": known("source_annotations", "source_atom_id", "partition_atoms", "source_atom_id"),
        "segment_issues_exist": known("(SELECT unnest(source_issue_ids) AS i FROM master_segments)", "i", "source_annotations", "issue_id"),
        "segment_atoms_exist": known("(SELECT unnest(atom_ids) AS i FROM master_segments)", "i", "partition_atoms", "atom_id"),
        "issue_events_exist": known("(SELECT unnest(affected_event_ids) AS e FROM source_annotations)", "e", "(SELECT unnest(event_ids) AS x FROM partition_atoms)", "x"),
        "lineitem_orders_exist": known("lineitem", "l_orderkey", "orders", "o_orderkey"),
        "pairs_match_segments": ("reference", "SELECT segment_id AS key FROM (" + REGISTRY["j1_lonely_keys"][1] + ")"),
        "scenes_in_one_split": one(named, "scene_id"),
        "groups_in_one_split": one(named, "scene_group_id"),
        "segments_in_one_split": one(named, "segment_id"),
        "pair_groups_in_one_split": one(texts, "scene_group_id"),
        "targets_in_one_split": one(texts, "t"),
        "pair_targets_as_in_segments": ("derived", f"SELECT segment_id AS key FROM {both} WHERE t IS DISTINCT FROM target_text"),
        "pair_splits_as_in_segments": ("derived", f"SELECT segment_id AS key FROM {both} WHERE s IS DISTINCT FROM split"),
        "pair_events_as_in_segments": ("order", f"SELECT segment_id AS key FROM {both} WHERE e IS DISTINCT FROM source.event_ids"),
        "atom_order": ("order", order),
        "events_conserved": ("total", "SELECT in_segments::VARCHAR AS key FROM (" + REGISTRY["a13_conserved_totals"][1] + ") WHERE in_segments <> in_atoms"),
    }


_RULES = _sql_rules()


@query("rules_audit", " UNION ALL ".join(f"SELECT '{n}' AS \"check\", '{k}' AS type, count(*) = 0 AS passed, count(*) AS violations FROM ({q})" for n, (k, q) in _RULES.items()))
def audit(spark, root):
    return rules.audit(_rules(spark, root))


@query("rules_violations", " UNION ALL ".join(f"SELECT '{n}' AS \"check\", '{k}' AS type, coalesce(key, 'null') AS key FROM ({q})" for n, (k, q) in _RULES.items()))
def violations(spark, root):
    return rules.violations(_rules(spark, root))
