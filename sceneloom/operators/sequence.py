"""Operators over ordered events: rendering, segmentation, context windows, latches, order checks.

Events are rows of a scene with a running number ``scene_ord`` (from 1; ``number_events`` gives it). A scene may hold a
large part of all rows, so no window is partitioned by scene alone: what looks at neighbours goes by stretches of
numbers with a halo, what adds up goes by sums of stretches (``ranges``). An atom is a bounded unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import in_order
from .ranges import numbered, own, running_sum, stretch, with_halo


def _glue(kind: Column, kind_before: Column, same: Column) -> Column:
    return F.when(F.coalesce((kind == "verse") & (kind_before == "verse") & same, F.lit(False)), "\n").otherwise("\n\n")


def render(df: DataFrame, by: list[str], order: str, *, across_atoms: bool = False) -> DataFrame:
    """by, text: the events of a bounded unit (an atom, a segment) joined in order. Consecutive verses of the same stanza list
    are joined by a line end, anything else by a blank line; unless ``across_atoms``, the verses must be of the same source
    atom too. Events need kind, stanza_ids, text (and source_atom_id). Equal null stanza lists count as the same."""
    w = Window.partitionBy(*by).orderBy(order)
    same = F.col("stanza_ids").eqNullSafe(F.lag("stanza_ids").over(w))
    if not across_atoms:
        same = same & (F.col("source_atom_id") == F.lag("source_atom_id").over(w))
    glue = F.when(F.row_number().over(w) == 1, "").otherwise(_glue(F.col("kind"), F.lag("kind").over(w), same))
    rows = df.select("*", F.concat(glue, F.coalesce("text", F.lit(""))).alias("_piece"))
    return rows.groupBy(*by).agg(F.array_join(in_order(F.col("_piece"), F.col(order)), "").alias("text"))


def render_scenes(events: DataFrame, rows: int = 1000) -> DataFrame:
    """scene_id, piece, text: the texts of scenes of any size in pieces of ``rows`` events, which joined in order without
    anything between them are the scene's text by the rule of ``render``."""
    e = with_halo(events.select("scene_id", "kind", "stanza_ids", "source_atom_id", "text", (F.col("scene_ord") - 1).alias("_k")), "_k", 1, 0)
    w = stretch("scene_id", "_k")
    same = F.col("stanza_ids").eqNullSafe(F.lag("stanza_ids").over(w)) & (F.col("source_atom_id") == F.lag("source_atom_id").over(w))
    e = e.withColumn("_glue", _glue(F.col("kind"), F.lag("kind").over(w), same))
    piece = F.concat(F.when(F.col("_k") == 0, "").otherwise(F.col("_glue")), F.coalesce("text", F.lit("")))
    return own(e).groupBy("scene_id", F.floor(F.col("_k") / rows).cast("int").alias("piece")).agg(F.array_join(in_order(piece, F.col("_k")), "").alias("text"))


def number_events(atoms: DataFrame, lines: Column, *columns: str) -> DataFrame:
    """The events of atoms (scene_id, atom_id, columns) whose lines are the given array of structs with an event_index: a row
    an event with atom_number and scene_ord (both from 1). Atoms are numbered before they are exploded, so that a text moves
    once and events never do."""
    a = atoms.select("scene_id", "atom_id", *columns, lines.alias("_lines")).withColumn("_events", F.size("_lines")).where("_events > 0")
    a = numbered(a, "scene_id", "atom_id", number="_atom", weight="_events", before="_before", name="scene-atoms")
    e = a.select("scene_id", "atom_id", *columns, (F.col("_atom") + 1).cast("int").alias("atom_number"), "_before", F.posexplode("_lines").alias("_i", "_l"))
    return e.select("scene_id", "atom_id", *columns, "atom_number", (F.col("_before") + F.col("_i") + 1).cast("int").alias("scene_ord"), "_l.*")


def resolve_anchors(cuts: DataFrame, events: DataFrame) -> DataFrame:
    """scene_id, marker, event_id, stop: the event each cut falls behind and the number of events before the cut.

    A marker names an atom by number N: ``N`` its last event, ``N@i`` its event i (from 0), ``N!`` the event before a
    closing stage direction, ``N^`` its last spoken event (verse or prose). Events need scene_id, atom_number, kind,
    event_id, scene_ord (from 1). A marker of another form or one that resolves to nothing raises an error.
    """
    w = Window.partitionBy("scene_id", "atom_number").orderBy("scene_ord")
    e = events.select("scene_id", "atom_number", "kind", "event_id", "scene_ord", (F.row_number().over(w) - 1).alias("i"))
    atoms = e.groupBy("scene_id", "atom_number").agg(
        F.max("i").alias("last"), F.max_by("kind", "i").alias("last_kind"), F.max(F.when(F.col("kind").isin("verse", "prose"), F.col("i"))).alias("spoken")
    )
    form = r"^(\d+)(?:@(\d+)|([!^]))?\z"
    number, at, sign = (F.regexp_extract("marker", form, k) for k in (1, 2, 3))
    c = cuts.select("scene_id", "marker", number.try_cast("int").alias("atom_number"), at.alias("at"), sign.alias("sign"))
    c = c.join(atoms, ["scene_id", "atom_number"], "left")
    i = F.when(F.col("at") != "", F.col("at").try_cast("int")).when((F.col("sign") == "!") & (F.col("last_kind") == "stage"), F.col("last") - 1).when(F.col("sign") == "^", F.col("spoken")).when(F.col("sign") == "", F.col("last"))
    c = c.withColumn("i", i).join(e.select("scene_id", "atom_number", "i", "event_id", "scene_ord"), ["scene_id", "atom_number", "i"], "left")
    ok = F.when(F.col("event_id").isNull(), F.raise_error(F.concat(F.lit("no event for cut "), F.coalesce("scene_id", F.lit("null")), F.lit(" "), F.coalesce("marker", F.lit("null"))))).otherwise(F.col("event_id"))
    # whichever of the two is read, an error shows
    return c.select("scene_id", "marker", ok.alias("event_id"), F.when(ok.isNotNull(), F.col("scene_ord")).alias("stop"))


def invalid_cuts(stops: DataFrame, events: DataFrame, order: str = "cut_ord") -> DataFrame:
    """scene_id, stop: cuts that don't rise strictly in their given order (1, 2, ... without gaps) or don't lie inside the
    scene. Empty is valid."""
    n = events.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))
    last = stops.select("scene_id", (F.col(order) + 1).alias(order), F.col("stop").alias("before"))
    rows = stops.join(last, ["scene_id", order], "left").join(n, "scene_id", "left")
    bad = F.coalesce(F.col("stop") <= F.col("before"), F.lit(False)) | (F.col("stop") <= 0) | (F.col("stop") >= F.coalesce("n", F.lit(0)))
    return rows.where(bad).select("scene_id", "stop")


def checked_cuts(stops: DataFrame, events: DataFrame, order: str = "cut_ord") -> DataFrame:
    """The stops; an invalid one raises an error when they are read."""
    bad = invalid_cuts(stops, events, order).withColumn("_bad", F.lit(True)).distinct()
    rows = stops.join(bad, ["scene_id", "stop"], "left")
    fine = F.when(F.col("_bad").isNull(), F.col("stop")).otherwise(F.raise_error(F.concat(F.lit("invalid cut in "), "scene_id", F.lit(": "), F.col("stop").cast("string"))))
    return rows.withColumn("stop", fine).drop("_bad")


def assign_segments(events: DataFrame, stops: DataFrame) -> DataFrame:
    """events with segment_number (from 1): intervals between the stops, closed on the right."""
    s = stops.select("scene_id", F.col("stop").alias("scene_ord"), F.lit(1).alias("is_cut")).distinct()
    rows = events.join(s, ["scene_id", "scene_ord"], "left").withColumn("_k", F.col("scene_ord") - 1)
    out = running_sum(rows, "scene_id", "_k", F.coalesce("is_cut", F.lit(0)), "_cuts")
    return out.withColumn("segment_number", 1 + F.col("_cuts")).drop("is_cut", "_k", "_cuts")


def atom_slices(events: DataFrame) -> DataFrame:
    """segment_id, source_atom_id, first, last, whole, atom_id: the part of each atom a segment holds. A part has the
    atom's id with the range of its events, numbered from 1."""
    part = events.groupBy("segment_id", "source_atom_id").agg(F.min("event_index").alias("first"), F.max("event_index").alias("last"))
    full = events.groupBy("source_atom_id").agg(F.min("event_index").alias("low"), F.max("event_index").alias("high"))
    whole = (F.col("first") == F.col("low")) & (F.col("last") == F.col("high"))
    name = F.when(whole, F.col("source_atom_id")).otherwise(F.format_string("%s_e%04d-%04d", "source_atom_id", "first", "last"))
    return part.join(full, "source_atom_id").select("segment_id", "source_atom_id", "first", "last", whole.alias("whole"), name.alias("atom_id"))


def context(events: DataFrame, before: int = 18, after: int = 12) -> DataFrame:
    """scene_id, segment_id, context_before, context_after: ids of the events around each segment, clipped to its scene.

    Windows over stretches of the scene collect the neighbours of every event in frames of a fixed width; the first and the
    last row of a segment hold what is wanted.
    """
    e = with_halo(events.select("scene_id", "segment_id", "event_id", (F.col("scene_ord") - 1).alias("_k")), "_k", before, after)
    w = stretch("scene_id", "_k")
    left = F.collect_list("event_id").over(w.rowsBetween(-before, -1))
    right = F.collect_list("event_id").over(w.rowsBetween(1, after))
    rows = own(e.select("*", left.alias("l"), right.alias("r"))).where("segment_id is not null")
    return rows.groupBy("scene_id", "segment_id").agg(F.min_by("l", "_k").alias("context_before"), F.max_by("r", "_k").alias("context_after"))


def boundary_ledger(events: DataFrame, width: int = 12) -> DataFrame:
    """scene_id, segment_id, cut_after, next_event, left_events, right_events, left_context, right_context: the end of every
    segment, with the segment's last events up to it and the scene's first events behind it, as ids and rendered."""
    e = events.select("scene_id", "segment_id", "event_id", "source_atom_id", "kind", "stanza_ids", "text", (F.col("scene_ord") - 1).alias("_k"))
    ends = e.where("segment_id is not null").groupBy("scene_id", "segment_id").agg(F.max("_k").alias("_end"), F.max_by("event_id", "_k").alias("cut_after"))
    at = ends.select("scene_id", "segment_id", "_end", "cut_after", F.explode(F.sequence(F.col("_end") - width + 1, F.col("_end") + width)).alias("_k"))
    near = at.join(e.withColumnRenamed("segment_id", "_of"), ["scene_id", "_k"]).where("_k > _end or _of = segment_id")
    near = near.withColumn("side", F.when(F.col("_k") > F.col("_end"), "right").otherwise("left"))
    texts = render(near, ["scene_id", "segment_id", "side"], "_k").groupBy("scene_id", "segment_id").agg(*[F.coalesce(F.max(F.when(F.col("side") == x, F.col("text"))), F.lit("")).alias(f"{x}_context") for x in ("left", "right")])
    side = lambda x: F.array_compact(in_order(F.when(F.col("side") == x, F.col("event_id")), F.col("_k"))).alias(f"{x}_events")
    ids = near.groupBy("scene_id", "segment_id").agg(F.first("cut_after").alias("cut_after"), F.max(F.when(F.col("_k") == F.col("_end") + 1, F.col("event_id"))).alias("next_event"), side("left"), side("right"))
    return ids.join(texts, ["scene_id", "segment_id"])


def continues(events: DataFrame) -> DataFrame:
    """scene_id, segment_id, continues: the segment's first event is a verse and the event before it is of the same atom."""
    e = with_halo(events.select("scene_id", "segment_id", "source_atom_id", "kind", (F.col("scene_ord") - 1).alias("_k")), "_k", 1, 0)
    same = F.lag("source_atom_id").over(stretch("scene_id", "_k")) == F.col("source_atom_id")
    rows = own(e.withColumn("same", same)).where("segment_id is not null")
    first = rows.groupBy("scene_id", "segment_id").agg(F.min_by(F.struct("kind", "same"), "_k").alias("f"))
    return first.select("scene_id", "segment_id", ((F.col("f.kind") == "verse") & F.coalesce("f.same", F.lit(False))).alias("continues"))


def bad_cuts(events: DataFrame) -> DataFrame:
    """scene_id, event_id, after_label, inside_stanza: ends of segments behind a speaker's label, or between verses of one atom."""
    e = with_halo(events.select("scene_id", "event_id", "segment_id", "source_atom_id", "kind", (F.col("scene_ord") - 1).alias("_k")), "_k", 0, 1)
    w = stretch("scene_id", "_k")
    inside = (F.col("kind") == "verse") & (F.lead("kind").over(w) == "verse") & (F.lead("source_atom_id").over(w) == F.col("source_atom_id"))
    rows = own(e.select("*", F.lead("segment_id").over(w).alias("next"), F.coalesce(inside, F.lit(False)).alias("inside_stanza")))
    return rows.where("next <> segment_id").where("kind = 'speaker' or inside_stanza").select("scene_id", "event_id", (F.col("kind") == "speaker").alias("after_label"), "inside_stanza")


def latch(events: DataFrame, trigger: Column, value: Column, target: str, kinds: tuple[str, ...] = ("verse", "prose")) -> DataFrame:
    """events with ``target`` set to ``value`` on rows of the given kinds behind the first triggering row of their atom."""
    w = Window.partitionBy("source_atom_id").orderBy("event_index").rowsBetween(Window.unboundedPreceding, -1)
    on = F.coalesce(F.max(F.coalesce(trigger, F.lit(False)).cast("int")).over(w), F.lit(0)) == 1
    # a further triggering row is a trigger again, not a target
    on = on & F.col("kind").isin(*kinds) & ~F.coalesce(trigger, F.lit(False))
    return events.withColumn(target, F.when(on, value).otherwise(F.col(target)))


def checked_latch(events: DataFrame, trigger: Column, value: Column, target: str, kinds: tuple[str, ...] = ("verse", "prose")) -> DataFrame:
    """``latch``, or an error if it changes no row: a rule that applies nowhere is a mistake. Runs a query to find out."""
    out = latch(events, trigger, value, "_new", kinds) if "_new" in events.columns else latch(events.withColumn("_new", F.col(target)), trigger, value, "_new", kinds)
    if out.where(~F.col("_new").eqNullSafe(F.col(target))).isEmpty():
        raise ValueError("the latch changes no row")
    return out.withColumn(target, F.col("_new")).drop("_new")


def neighbours(segments: DataFrame) -> DataFrame:
    """segment_id, previous_segment_id, next_segment_id by order within the scene."""
    s = with_halo(numbered(segments.select("scene_id", "segment_id"), "scene_id", "segment_id", number="_k", name="neighbours"), "_k", 1, 1)
    w = stretch("scene_id", "_k")
    s = s.select("*", F.lag("segment_id").over(w).alias("previous_segment_id"), F.lead("segment_id").over(w).alias("next_segment_id"))
    return own(s).select("segment_id", "previous_segment_id", "next_segment_id")


def unmutual(segments: DataFrame) -> DataFrame:
    """segment_id, next_segment_id of links that the next segment doesn't return."""
    back = segments.select(F.col("segment_id").alias("next_segment_id"), F.col("previous_segment_id").alias("back"))
    rows = segments.where("next_segment_id is not null").join(back, "next_segment_id", "left")
    return rows.where(~F.col("back").eqNullSafe(F.col("segment_id"))).select("segment_id", "next_segment_id")


def order_mismatches(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """by, ord, left_id, right_id wherever two ordered lists (by, ord, id) differ, also in length."""
    a, b = left.select(by, "ord", F.col("id").alias("left_id")), right.select(by, "ord", F.col("id").alias("right_id"))
    return a.join(b, [by, "ord"], "full_outer").where(~F.col("left_id").eqNullSafe(F.col("right_id")))


def row_index(df: DataFrame, by: str, order: str) -> DataFrame:
    """df with row_index_zero_based within ``by``, by ``order``."""
    return numbered(df, by, order, number="row_index_zero_based", name="row-index")
