import pytest
from pyspark.sql import functions as F

from sceneloom import streaming
from sceneloom.sources import jsonl, tei

HEAD = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><person xml:id="wirtin"><persName>Die  Wirtin</persName></person></teiHeader><text>'

PLAY = (
    HEAD
    + """<front><div><p>Vorwort</p><note>nicht <hi>das</hi></note></div></front><body>
<div type="Szene"><head>Wald</head>
  <div><head>Lichtung</head><sp who="#wirtin #bote"><speaker>WIRTIN.</speaker><lg><l n="1">Ein <choice><sic>Wrot</sic><orig>Wort</orig></choice></l><l>zwei<lb/>drei</l></lg><l>vier</l><l> </l></sp>
  <stage>Lärm</stage></div>
  lose
  <sp who="#geist"><l>fünf <stage>leise</stage> sechs</l><app><rdg>b</rdg><lem><p>gewählt</p></lem></app></sp>
  <div><head>Nur Kopf</head></div>
</div>
<div><head>Haus</head><head>innen</head><p>Prosa <emph>stark</emph></p>schwebend<castList><p>weg</p></castList></div>
</body></text></TEI>"""
)


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.createDataFrame([("F1", bytearray(PLAY.encode())), ("F2", None)], "work_id string, content binary")
    return tei.marks(docs)


@pytest.fixture(scope="module")
def ev(rows):
    return tei.events(rows).cache()


def of(spark, *bodies, head=HEAD):
    docs = spark.createDataFrame([(f"W{k}", bytearray((head + b + "</text></TEI>").encode())) for k, b in enumerate(bodies)], "work_id string, content binary")
    return tei.marks(docs)


def test_events_in_order(ev):
    e = ev.orderBy("ord").collect()
    assert [(x.scene_id, x.atom_id[-5:], x.kind, x.text) for x in e] == [
        ("F1_S001", "A0001", "prose", "Vorwort"),
        ("F1_S002", "A0001", "speaker", "WIRTIN."),
        ("F1_S002", "A0001", "verse", "Ein Wort"),
        ("F1_S002", "A0001", "verse", "zwei drei"),
        ("F1_S002", "A0001", "verse", "vier"),
        ("F1_S002", "A0002", "stage", "Lärm"),
        ("F1_S003", "A0001", "verse", "fünf leise sechs"),
        ("F1_S003", "A0001", "prose", "gewählt"),
        ("F1_S004", "A0001", "prose", "Prosa stark"),
    ]
    assert [x.verse_index_in_work for x in e if x.kind == "verse"] == [1, 2, 3, 4]
    assert e[1].speakers == ["wirtin", "bote"] and e[6].stages == ["leise"] and e[8].speakers == []
    assert e[1].scene_group_id == e[6].scene_group_id != e[8].scene_group_id
    assert e[6].scene_xpath == "/t:TEI/t:text[1]/t:body[1]/t:div[1]/block[2]"
    assert e[2].stanza_ids == ["/t:TEI/t:text[1]/t:body[1]/t:div[1]/t:div[1]/t:sp[1]/t:lg[1]"] and e[4].stanza_ids == []
    assert [h.title for h in e[1].hierarchy] == ["Wald", "Lichtung"] and [h.type for h in e[6].hierarchy] == ["Szene"] and e[0].region == "front"


def test_scenes_atoms_and_logs(rows, ev):
    a = tei.atoms(ev)
    first = a.where("atom_id = 'F1_S002_A0001'").first()
    assert first.text == "WIRTIN.\n\nEin Wort\nzwei drei\n\nvier" and first.kind == "speech" and first.verse_indices == [1, 2, 3] and first.source_line_numbers == ["1", None, None] and first.speaker_labels == ["WIRTIN."]
    s = {r.scene_id: r for r in tei.scenes(ev, a).collect()}
    assert [s[k].scene_title for k in sorted(s)] == ["front", "Lichtung", "Wald", "Haus / innen"]
    assert s["F1_S002"].atom_ids == ["F1_S002_A0001", "F1_S002_A0002"] and s["F1_S002"].word_count == 7
    assert {(r.tag, r.text, r.requires_review) for r in tei.exclusions(rows).collect()} == {("note", "nicht das", True), ("castList", "weg", False)}
    assert {(r.selected_tag, r.tag) for r in tei.choices(rows).collect()} == {("orig", "choice"), ("lem", "app")}
    assert [(r.person_id, r.names) for r in tei.persons(rows).collect()] == [("wirtin", ["Die Wirtin"])]
    assert [r.text for r in tei.inline_markup(rows).collect()] == ["stark"]
    assert sorted(tuple(r.direct_titles) for r in tei.structure(rows).collect()) == [("Haus", "innen"), ("Lichtung",), ("Nur Kopf",), ("Wald",)]
    assert tei.headings(rows).count() == 5
    assert tei.uncovered_lines(rows, ev).count() == 0
    assert tei.uncovered_lines(rows, ev.where("text <> 'vier'")).count() == 2
    assert [(r.work_id, r.unknown) for r in tei.unknown_speakers(rows, ev).collect()] == [("F1", ["bote", "geist"])]


@pytest.mark.parametrize("bad", ['<!DOCTYPE x><TEI/>', "<html/>", '<TEI xmlns="http://www.tei-c.org/ns/1.0"/>', "<TEI", HEAD + "<body><div><p><choice><x/></choice></p></div></body></text></TEI>"])
def test_refused_documents(bad):
    with pytest.raises(Exception):
        list(tei.Marks().read(bad.encode()))
    with pytest.raises(ValueError):
        list(tei.Marks().read((HEAD + "</text></TEI>").encode(), largest=10))


def test_loose_text_breaks_and_nested_parts(spark):
    rows = of(
        spark,
        "<body><div><sp>los<l>a</l>mehr</sp></div></body>",
        "<body><div><lg><l>a <hi>b</hi> <hi>c</hi><lb/>d</l><l><note>x</note></l></lg><app><rdg><l>weg</l></rdg></app><p>q<choice><corr>1</corr><sic>2<choice><reg>3</reg><orig>4</orig></choice></sic></choice>r</p></div></body>",
        "<body><head>Stück</head><p>ohne Teilung</p></body>",
        "<body><div><head/><div><p> </p></div></div></body>",
    )
    e = {}
    for r in tei.events(rows).orderBy("work_id", "ord").collect():
        e.setdefault(r.work_id, []).append((r.kind, r.text, r.xpath.split("/t:div[1]/")[-1], r.scene_title))
    assert e["W0"] == [("unclassified_text", "los", "t:sp[1]/text()", "body"), ("verse", "a", "t:sp[1]/t:l[1]", "body"), ("unclassified_text", "mehr", "t:sp[1]/t:l[1]/following-sibling::text()[1]", "body")]
    assert [x[:2] for x in e["W1"]] == [("verse", "a b c d"), ("verse", "weg"), ("prose", "q24r")]
    assert [(k, t, s) for k, t, _, s in e["W2"]] == [("prose", "ohne Teilung", "Stück")] and "W3" not in e
    assert {(r.xpath[-12:], r.selected_tag) for r in tei.choices(rows).collect()} == {("div[1]/t:app[1]"[-12:], "rdg"), ("t:choice[1]", "sic")[:0] or ("]/t:choice[1]"[-12:], "sic"), ("]/t:choice[1]"[-12:], "orig")}
    assert tei.uncovered_lines(rows, tei.events(rows)).count() == 0


def test_jsonl(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": "ü", "n": null}\n\n{"a": "b", "n": 3}\n', encoding="utf-8")
    assert sorted((r.a, r.n) for r in jsonl.read_jsonl(spark, str(p), "a string, n int").collect()) == [("b", 3), ("ü", None)]
    p.write_text('{"a": "ü"}\n\n[1]\n{"a"\n', encoding="utf-8")
    assert [(r.line, r.value) for r in jsonl.bad_lines(spark, str(p)).orderBy("line").collect()] == [(3, "[1]"), (4, '{"a"')]
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, str(p), "a string").collect()
    jsonl.write_jsonl(spark.createDataFrame([("b", None), ("ä", 1)], "a string, n int"), str(tmp_path / "out"), "a", one_file=True)
    text = next((tmp_path / "out").glob("*.json")).read_text(encoding="utf-8")
    assert text == '{"a":"b","n":null}\n{"a":"ä","n":1}\n'
    d = tmp_path / "plan.json"
    d.write_text('{"group_assignment": {"G1": "train",\n "G2": "test"}}')
    assert {tuple(r) for r in jsonl.read_map(spark, str(d), "group_assignment", "g", "split").collect()} == {("G1", "train"), ("G2", "test")}
    rep = spark.createDataFrame([("s", 2, "b"), ("s", 1, "a")], "g string, o int, l string")
    assert jsonl.report(rep, ["g"], F.col("l"), "o").first().text == "a\nb"


def test_streams(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = [("k1", "2024-01-01 00:10:00", 1.0), ("k2", "2024-01-01 00:20:00", 2.0), ("k1", "2024-01-01 00:30:00", 5.0)]
    df = spark.createDataFrame(rows, "k string, ts string, v double").select("k", F.to_timestamp("ts").alias("ts"), "v")
    jsonl.append_jsonl(df, log)
    jsonl.append_jsonl(df.where("k = 'k2'"), log)
    stream = streaming.read_log(spark, log, df.schema)
    for name, q, mode in (("first", streaming.first_deliveries(stream, "k", "ts"), "append"), ("win", streaming.windowed_counts(stream, "ts", "k", "v"), "complete")):
        s = q.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        s.processAllAvailable()
        s.stop()
    assert sorted(r.k for r in spark.table("first").collect()) == ["k1", "k2"]
    assert {(r.k, r.n, r.total) for r in spark.table("win").collect()} == {("k1", 2, 6.0), ("k2", 2, 4.0)}
    runs = spark.createDataFrame([("r", k, v) for k, v in enumerate([3.0, 2.0, 2.5, 2.0, 1.0])] + [("s", 0, 1.0)], "run string, k int, loss double")
    assert {r.run: (r.stop_at, r.evaluations) for r in streaming.early_stop(runs.withColumnRenamed("k", "step"), "run", "loss", ["step"]).collect()} == {"r": (4, 5), "s": (None, 1)}
