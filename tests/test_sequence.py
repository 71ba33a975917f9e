import pytest
from pyspark.sql import functions as F

from sceneloom.operators import sequence as s

E = "scene_id string, atom_number int, source_atom_id string, segment_id string, event_id string, scene_ord int, event_index int, kind string, stanza_ids array<string>, text string"


def events(spark):
    rows = [
        ("S", 1, "A1", "P1", "e1", 1, 1, "speaker", [], "WIRTIN."),
        ("S", 1, "A1", "P1", "e2", 2, 2, "verse", ["g1"], "eins"),
        ("S", 1, "A1", "P1", "e3", 3, 3, "verse", ["g1"], "zwei"),
        ("S", 1, "A1", "P2", "e4", 4, 4, "verse", ["g2"], "drei"),
        ("S", 2, "A2", "P2", "e5", 5, 1, "verse", ["g2"], "vier"),
        ("S", 2, "A2", "P2", "e6", 6, 2, "prose", [], "fünf"),
        ("S", 2, "A2", "P2", "e7", 7, 3, "stage", [], "(ab)"),
    ]
    return spark.createDataFrame(rows, E)


def test_both_separator_rules(spark):
    e = events(spark)
    assert s.render(e, ["scene_id"], "scene_ord").first().text == "WIRTIN.\n\neins\nzwei\n\ndrei\n\nvier\n\nfünf\n\n(ab)"
    assert s.render(e, ["scene_id"], "scene_ord", across_atoms=True).first().text == "WIRTIN.\n\neins\nzwei\n\ndrei\nvier\n\nfünf\n\n(ab)"
    assert s.render(e.limit(0), ["scene_id"], "scene_ord").count() == 0
    pieces = s.render_scenes(e, 3).orderBy("piece").collect()
    assert len(pieces) == 3 and "".join(r.text for r in pieces) == s.render(e, ["scene_id"], "scene_ord").first().text


def test_anchor_grammar(spark):
    cuts = spark.createDataFrame([("S", "1"), ("S", "1@1"), ("S", "2!"), ("S", "2^"), ("S", "2@0")], "scene_id string, marker string")
    assert {r.marker: (r.event_id, r.stop) for r in s.resolve_anchors(cuts, events(spark)).collect()} == {"1": ("e4", 4), "1@1": ("e2", 2), "2!": ("e6", 6), "2^": ("e6", 6), "2@0": ("e5", 5)}
    for bad in ("1!", "3", "2@9", "x", "1@x", "1@0!", "1 ", "", None):
        with pytest.raises(Exception, match="no event for cut"):
            s.resolve_anchors(spark.createDataFrame([("S", bad)], "scene_id string, marker string"), events(spark)).collect()


def test_cut_validity(spark):
    stops = spark.createDataFrame([("S", 1, 3), ("S", 2, 3), ("S", 3, 7), ("S", 4, 5)], "scene_id string, cut_ord int, stop int")
    assert sorted(r.stop for r in s.invalid_cuts(stops, events(spark)).collect()) == [3, 5, 7]


def test_segments_slices_context_and_continuation(spark):
    e = events(spark)
    stops = spark.createDataFrame([("S", 3)], "scene_id string, stop int")
    assert [r.segment_number for r in s.assign_segments(e, stops).orderBy("scene_ord").collect()] == [1, 1, 1, 2, 2, 2, 2]
    assert {(r.segment_id, r.atom_id, r.whole) for r in s.atom_slices(e).collect()} == {("P1", "A1_e0001-0003", False), ("P2", "A1_e0004-0004", False), ("P2", "A2", True)}
    assert {r.segment_id: (r.context_before, r.context_after) for r in s.context(e, 2, 1).collect()} == {"P1": ([], ["e4"]), "P2": (["e2", "e3"], [])}
    assert {(r.segment_id, r.cut_after, r.next_event, *r.left_events, "|", *r.right_events, r.left_context, r.right_context) for r in s.boundary_ledger(e, 2).collect()} == {
        ("P1", "e3", "e4", "e2", "e3", "|", "e4", "e5", "eins\nzwei", "drei\n\nvier"), ("P2", "e7", None, "e6", "e7", "|", "fünf\n\n(ab)", "")
    }
    with pytest.raises(Exception, match="invalid cut"):
        s.checked_cuts(spark.createDataFrame([("S", 1, 3), ("S", 2, 7)], "scene_id string, cut_ord int, stop int"), e).collect()
    assert s.checked_cuts(spark.createDataFrame([("S", 1, 3), ("S", 2, 6)], "scene_id string, cut_ord int, stop int"), e).count() == 2
    assert {r.segment_id: r.continues for r in s.continues(e).collect()} == {"P1": False, "P2": True}


def test_latch(spark):
    e = events(spark).withColumn("who", F.lit("wirtin"))
    out = s.latch(e, F.col("text") == "zwei", F.lit("bote"), "who", ("verse",))
    assert {r.event_id for r in out.where("who = 'bote'").collect()} == {"e4"}
    assert {r.event_id for r in s.checked_latch(e, F.col("text") == "zwei", F.lit("bote"), "who", ("verse",)).where("who = 'bote'").collect()} == {"e4"}
    with pytest.raises(ValueError, match="changes no row"):
        s.checked_latch(e, F.col("text") == "niemand", F.lit("bote"), "who")


def test_links_order_and_index(spark):
    seg = spark.createDataFrame([("P1", "S", None, "P2"), ("P2", "S", "P1", "P3"), ("P3", "S", "P1", None)], "segment_id string, scene_id string, previous_segment_id string, next_segment_id string")
    assert [tuple(r) for r in s.unmutual(seg).collect()] == [("P2", "P3")]
    assert [tuple(r) for r in s.neighbours(seg).orderBy("segment_id").collect()] == [("P1", None, "P2"), ("P2", "P1", "P3"), ("P3", "P2", None)]
    a = spark.createDataFrame([("x", 0, "a"), ("x", 1, "b")], "by string, ord int, id string")
    b = spark.createDataFrame([("x", 0, "a"), ("x", 1, "c"), ("x", 2, "d")], "by string, ord int, id string")
    assert {(r.ord, r.left_id, r.right_id) for r in s.order_mismatches(a, b, "by").collect()} == {(1, "b", "c"), (2, None, "d")}
    rows = spark.createDataFrame([("train" if k % 10 else None, f"P{k:05d}") for k in range(20_000)], "split string, segment_id string").withColumn("more", F.col("segment_id"))
    got = s.row_index(rows, "split", "segment_id").collect()
    for split in ("train", None):
        mine = sorted((r.segment_id, r.row_index_zero_based) for r in got if r.split == split)
        assert [n for _, n in mine] == list(range(len(mine)))


def test_ranges_equal_plain_windows(spark, monkeypatch):
    """Numbers, halos and running sums over stretches against windows over whole groups."""
    from pyspark.sql import Window

    from sceneloom.operators import ranges

    rows = spark.range(3000).select(F.when(F.col("id") % 7 < 4, "hot").when(F.col("id") % 7 == 4, None).otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"), F.format_string("k%05d", (F.col("id") * 7919) % 3000).alias("k"), (F.col("id") % 5).cast("int").alias("w"))
    w = Window.partitionBy("g").orderBy("k")
    want = {(r.g, r.k): (r.n, r.s, r.a, r.b) for r in rows.select("g", "k", (F.row_number().over(w) - 1).alias("n"), F.coalesce(F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s"), F.lag("k", 2).over(w).alias("a"), F.lead("k").over(w).alias("b")).collect()}
    n = ranges.numbered(rows, "g", "k", number="n", weight="w", before="s")
    h = ranges.with_halo(n, "n", 2, 1, width=10)
    x = ranges.stretch("g", "n")
    got = ranges.own(h.select("*", F.lag("k", 2).over(x).alias("a"), F.lead("k").over(x).alias("b")))
    assert {(r.g, r.k): (r.n, r.s, r.a, r.b) for r in got.collect()} == want
    assert {(r.g, r.k): r.t for r in ranges.running_sum(n, "g", "n", F.col("w"), "t", width=10).collect()} == {k: v[1] for k, v in want.items()}
    assert ranges.numbered(rows.limit(0), "g", "k", number="n").count() == 0
