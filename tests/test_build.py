import pytest
from pyspark.sql import functions as F

from sceneloom.operators import build, encode


def events(spark):
    rows = [
        ("W", "S", "G", 1, "S_A0001", "e1", 1, "speaker", ["x"], "WIRTIN.", "/a[1]", ["wirtin"]),
        ("W", "S", "G", 1, "S_A0001", "e2", 2, "verse", ["x"], "eins", "/a[1]", ["wirtin"]),
        ("W", "S", "G", 1, "S_A0001", "e3", 3, "verse", ["x"], "zwei", "/a[1]", ["wirtin"]),
        ("W", "S", "G", 2, "S_A0002", "e4", 4, "prose", [], "drei vier", "/a[2]", ["bote", "wirtin"]),
        ("W", "S", "G", 2, "S_A0002", "e5", 5, "stage", [], "(ab)", "/a[2]", ["bote", "wirtin"]),
    ]
    return spark.createDataFrame(rows, "work_id string, scene_id string, scene_group_id string, atom_number int, source_atom_id string, event_id string, scene_ord int, kind string, stanza_ids array<string>, text string, source_xpath string, speakers array<string>")


def test_corpus(spark):
    plan = spark.createDataFrame([("G", "test")], "scene_group_id string, split string")
    issues = spark.createDataFrame([("I1", None, "S_A0001"), ("I2", ["e5"], None)], "issue_id string, affected_event_ids array<string>, source_atom_id string")
    cut = lambda *m: spark.createDataFrame([("S", k + 1, x, "weil") for k, x in enumerate(m)], "scene_id string, cut_ord int, marker string, reason string")
    c = build.corpus(events(spark), cut("1@1"), plan, issues)
    a, b = c.segments.orderBy("segment_id").collect()
    assert (a.segment_id, a.target_text, a.atom_ids, a.source_atom_ids, a.speakers, a.next_segment_id, a.previous_segment_id) == ("S_P001", "WIRTIN.\n\neins", ["S_A0001_e0001-0002"], ["S_A0001"], ["wirtin"], "S_P002", None)
    assert (b.target_text, b.atom_ids, b.speakers, b.word_count, b.verse_element_count, b.prose_element_count) == ("zwei\n\ndrei vier\n\n(ab)", ["S_A0001_e0003-0003", "S_A0002"], ["wirtin", "bote"], 4, 1, 1)
    assert b.continues_source_speech and b.recommended_task == "continuation_or_description" and b.context_before_event_ids == ["e1", "e2"] and a.context_after_event_ids == ["e3", "e4", "e5"]
    assert (a.source_issue_ids, b.source_issue_ids, a.split) == (["I1"], ["I1", "I2"], "test") and b.source_xpath_end == "/a[2]" and a.speaker_labels_in_source == ["WIRTIN."]
    assert {(r.boundary_id, r.boundary_type, r.cut_after_event_id, r.next_event_id, r.reason, r.right_context) for r in c.ledger.collect()} == {("S_P001_END", "internal_reviewed", "e2", "e3", "weil", "zwei\n\ndrei vier\n\n(ab)"), ("S_P002_END", "original_scene_end", "e5", None, None, "")}
    assert {(r.atom_id, r.is_source_atom_slice, r.text) for r in c.atoms.collect()} == {("S_A0001_e0001-0002", True, "WIRTIN.\n\neins"), ("S_A0001_e0003-0003", True, "zwei"), ("S_A0002", False, "drei vier\n\n(ab)")}
    for bad in (("2",), ("1", "1@1"), ("1@x",), ("9",)):
        with pytest.raises(Exception):
            build.corpus(events(spark), cut(*bad), plan).segments.collect()
    with pytest.raises(Exception, match="no split for group"):
        build.corpus(events(spark), cut("1"), plan.where("false")).segments.collect()
    whole = build.corpus(events(spark), cut("1").where("false"), plan).segments.collect()
    assert len(whole) == 1 and whole[0].next_segment_id is None


def test_pairs(spark):
    m = spark.createDataFrame([("A", "train", "x y"), ("B", "train", "z")], "segment_id string, split string, target_text string")
    rows = [("A", "Lied", "Lage", ["1", "2", "3"]), ("B", "Rede", "Ort", ["a", "b", "c"])]
    sha = {"A": "x y", "B": "z"}

    def notes(*rows):
        df = spark.createDataFrame([(*r, sha[r[0]]) for r in rows], "segment_id string, form_de string, situation_de string, beats_de array<string>, t string")
        return df.withColumn("target_text_sha256", F.sha2("t", 256)).drop("t")

    got = {r.segment_id: r for r in build.pairs(m, notes(*rows)).collect()}
    assert got["A"].instruction_de == encode.INTRO + "\n\nForm: Lied\nAusgangslage: Lage\nAblauf: 1 2 3" and got["B"].row_index_zero_based == 1 and got["B"].ending_state_de == "c"
    for bad in ([rows[0]], [rows[0], ("B", " ", "Ort", ["a", "b", "c"])], [rows[0], ("B", "Rede", "Ort", ["a", "b"])], [rows[0], ("B", "Rede", "Ort", ["a", " ", "c"])], [rows[0], ("B", "Rede", None, ["a", "b", "c"])]):
        with pytest.raises(Exception):
            build.pairs(m, notes(*bad)).collect()
    with pytest.raises(Exception, match="hash"):
        build.pairs(m, notes(*rows).withColumn("target_text_sha256", F.lit("0"))).collect()
