import hashlib
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from sceneloom.functions import lexical_words, overlap_words
from sceneloom.operators import encode, joins, overlap, release, splits


def test_word_runs_and_gate(spark):
    target = "eins zwei drei vier fünf sechs sieben"
    prompts = spark.createDataFrame([("a", "eins zwei drei"), ("b", "x eins zwei drei vier y"), ("c", "zwei drei vier fünf sechs"), ("t", "drei vier fünf sechs sieben eins"), ("d", "eins zwei drei vier fünf sechs"), ("n", None)], "case_id string, x string")
    targets = spark.createDataFrame([("t", target)], "segment_id string, x string")
    found = overlap.matches(prompts, "case_id", lexical_words(F.col("x")), targets, "segment_id", lexical_words(F.col("x")), 4)
    assert sorted(tuple(r) for r in found.collect()) == [("b", "t", 1, 0, 4), ("c", "t", 0, 1, 5), ("c", "t", 1, 2, 4), ("d", "t", 0, 0, 6), ("d", "t", 1, 1, 5), ("d", "t", 2, 2, 4), ("t", "t", 0, 2, 5), ("t", "t", 1, 3, 4)]
    got = {r.case_id: (r.longest_any, r.longest_own, r.passes) for r in overlap.longest(prompts, found, "case_id", "segment_id").collect()}
    assert got == {"a": (0, 0, True), "b": (4, 0, True), "c": (5, 0, True), "t": (5, 5, True), "d": (6, 0, False), "n": (0, 0, True)}


def test_reuse_and_reference(spark):
    words = overlap_words(F.col("x"))
    texts = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "a b"), (3, None)], "id int, x string")
    pool = spark.createDataFrame([("b c d e f g h i j",), (None,)], "x string")
    assert {r.id: (r.grams, r.reused, r.ratio) for r in overlap.reuse(texts, "id", words, pool, words).collect()} == {1: (2, 1, 0.5), 2: (0, 0, 0.0), 3: (0, 0, 0.0)}
    cases = spark.createDataFrame([("c1", "lied"), ("c2", "brief"), ("c3", None)], "case_id string, form string")
    pool = spark.createDataFrame([("P2", "lied", "x" * 10), ("P1", "lied", "x" * 10), ("P3", "rede", "x" * 1500), ("P4", "lied", None)], "segment_id string, form string, text string")
    assert {r.case_id: r.segment_id for r in overlap.pick_reference(cases, pool).collect()} == {"c1": "P1", "c2": "P3", "c3": "P3"}


def test_encoding_padding_and_budget(spark):
    df = spark.createDataFrame([("A", "ab", "xyz"), ("B", "é", "\u00a0.")], "segment_id string, p string, t string")
    for bad in ((None, "x"), ("x", None), ("\t\n", "x"), ("x", "\u00a0")):
        with pytest.raises(Exception, match="blank"):
            encode.encoded(spark.createDataFrame([("A", *bad)], df.schema), "p", "t", lambda: lambda s: [ord(c) for c in s], eos=0).collect()
    rows = encode.encoded(df, "p", "t", lambda: lambda s: [ord(c) for c in s], eos=0)
    got = {r.segment_id: r for r in rows.collect()}
    assert set(got) == {"A", "B"} and got["A"].input_ids == [97, 98, 120, 121, 122, 0] and got["A"].labels == [-100, -100, 120, 121, 122, 0]
    assert {r.segment_id: (r.total, r.prompt, r.completion) for r in encode.lengths(rows).collect()} == {"A": (6, 2, 4), "B": (4, 1, 3)}
    p = {r.segment_id: r for r in encode.padded(rows.withColumn("batch", F.lit(1)), "batch", 0).collect()}
    assert p["B"].input_ids == [233, 160, 46, 0, 0, 0] and p["B"].attention_mask == [1, 1, 1, 1, 0, 0] and p["B"].labels == [-100, 160, 46, 0, -100, -100]
    assert [r.segment_id for r in encode.over_limit(rows, 5).collect()] == ["A"]
    one = spark.createDataFrame([(65,), (64,), (1900,)], "n int")
    assert [r.b for r in one.select(encode.budget(F.col("n"), 1920).alias("b")).collect()] == [128, 64, 1920]
    with pytest.raises(Exception, match="over the limit"):
        one.select(encode.budget(F.col("n"), 1000)).collect()
    with pytest.raises(Exception, match="blank instruction"):
        spark.createDataFrame([("\t\n",)], "x string").select(encode.training_prompt(F.col("x"))).collect()
    assert spark.createDataFrame([(" tu ",)], "x string").select(encode.training_prompt(F.col("x"), F.lit("r")).alias("x")).first().x == "### Vergleichstext (nicht abschreiben)\nr\n\n### Aufgabe\n tu \n\n### Textauszug\n"


def test_splits(spark, tmp_path):
    df = spark.createDataFrame([("A", "G1", "x"), ("B", "G2", "y")], "segment_id string, g string, split string")
    plan = spark.createDataFrame([("G1", "train"), ("G2", "test")], "g string, split string")
    assert {r.segment_id: r.split for r in splits.frozen(df, plan, "g").collect()} == {"A": "train", "B": "test"}
    with pytest.raises(Exception, match="no split for group"):
        splits.frozen(df, plan.limit(1), "g").collect()
    with pytest.raises(ValueError):
        splits.for_training(df, "test")
    names = spark.createDataFrame([(" Train ",), ("dev",), ("VAL\r\n",), (" Validation",), (None,)], "s string")
    assert [r.s for r in names.select(splits.split_name(F.col("s")).alias("s")).collect()] == ["train", "validation", "validation", "validation", None]
    cases = joins.conditions(spark.createDataFrame([("c1",), ("c2",)], "case_id string"), [1], ["base", "tuned"])
    a, b = ({(r.case_id, r.condition): r.label for r in splits.blind_order(cases, "case_id", "condition", "7").collect()} for _ in range(2))
    assert a == b and {v for (c, _), v in a.items() if c == "c1"} == {"A", "B"}


def test_joins(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, a int")
    b = spark.createDataFrame([("x", 3), ("y", 4)], "k string, b int")
    assert joins.total_join(a, b, "k").count() == 2
    with pytest.raises(Exception, match="one side only"):
        joins.total_join(a, b.limit(1), "k").collect()
    seg = spark.createDataFrame([("P1", ["e1", "e2"], ["A1"]), ("P2", ["e3"], ["A1", "A2"])], "segment_id string, event_ids array<string>, source_atom_ids array<string>")
    iss = spark.createDataFrame([("I1", None, "A1"), ("I2", ["e3", "e9"], None), ("I3", ["e9"], "A9")], "issue_id string, affected_event_ids array<string>, source_atom_id string")
    assert {tuple(r) for r in joins.attach_issues(seg, iss).collect()} == {("P1", "I1"), ("P2", "I1"), ("P2", "I2")}
    sc = spark.createDataFrame([("W", "/t:TEI/t:div[1]"), ("W", "/t:TEI/t:div[1]/t:div[1]")], "work_id string, source_xpath string")
    hd = spark.createDataFrame([("W", "/t:TEI/t:div[1]/t:head[1]"), ("W", "/t:TEI/t:div[10]/t:head[1]")], "work_id string, source_xpath string")
    assert [tuple(r) for r in joins.attach_headings(sc, hd).collect()] == [("W", "/t:TEI/t:div[1]", "/t:TEI/t:div[1]/t:head[1]")]


def package(path, files, parents=(), members=None, extra=(), kind="delta"):
    manifest = {"release_id": "r2", "parent_release_id": "r1", "package_type": kind, "files": [{"path": n, "bytes": len(d), "sha256": hashlib.sha256(d).hexdigest(), **({"previous_sha256": hashlib.sha256(p).hexdigest()} if p is not None else {})} for n, d, p in files], "requires": {"parent_files": [{"path": n, "sha256": hashlib.sha256(d).hexdigest()} for n, d in parents]}}
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("manifest.json", json.dumps(manifest))
        for n, d in members or [(n, d) for n, d, _ in files]:
            z.writestr(n, d)
        for n, d in extra:
            z.writestr(n, d)
    return str(path)


def test_release(spark, tmp_path):
    root = tmp_path / "root"
    (root / "data").mkdir(parents=True)
    (root / "data/a.txt").write_bytes(b"old")
    (root / "data/b.txt").write_bytes(b"same")
    files = [("data/a.txt", b"new", b"old"), ("data/b.txt", b"same", None), ("data/c.txt", b"more", None)]
    d = release.Delta(package(tmp_path / "p.zip", files, [("data/a.txt", b"old")]), ("data",))
    want = [("data/a.txt", "write"), ("data/b.txt", "skip"), ("data/c.txt", "write")]
    assert d.apply(spark, str(root)) == want and (root / "data/a.txt").read_bytes() == b"old"
    assert d.apply(spark, str(root), dry_run=False) == want and (root / "data/a.txt").read_bytes() == b"new"
    with pytest.raises(ValueError, match="parent files differ"):
        d.apply(spark, str(root))
    (root / "STATE.json").write_text('{"release_id": "r7"}')
    with pytest.raises(ValueError, match="another release"):
        release.Delta(package(tmp_path / "q.zip", files), ("data",)).apply(spark, str(root))
    (root / "STATE.json").write_text('{"release_id": "r1"}')
    again = release.Delta(package(tmp_path / "q.zip", files), ("data",))
    assert {a for _, a in again.apply(spark, str(root))} == {"skip"}
    (root / "data/c.txt").write_bytes(b"edited")
    with pytest.raises(ValueError, match="unexpected content"):
        again.apply(spark, str(root), dry_run=False)


def test_release_refuses(tmp_path, monkeypatch):
    ok = [("data/a.txt", b"x", None)]
    for n, args in enumerate(({"members": [("data/a.txt", b"y")]}, {"extra": [("data/z.txt", b"")]}, {"members": [("data/a.txt", b"x"), ("manifest2/manifest.json", b"{}")]})):
        with pytest.raises(ValueError):
            release.Delta(package(tmp_path / f"{n}.zip", ok, **args), ("data",))
    with pytest.raises(ValueError, match="not a delta"):
        release.Delta(package(tmp_path / "full.zip", ok, kind="snapshot"), ("data",))
    monkeypatch.setattr(release, "MOST_MEMBER", 3)
    with pytest.raises(ValueError, match="too large"):
        release.Delta(package(tmp_path / "large.zip", [("data/a.txt", b"1234", None)]), ("data",))
    (tmp_path / "root").mkdir()
    (tmp_path / "root/data").symlink_to(tmp_path)
    with pytest.raises(ValueError, match="links"):
        release.Folder(str(tmp_path / "root")).bytes("data/x")
    for bad in ("../a.txt", "/etc/a", "other/a.txt", "data/../b", "data\\a"):
        with pytest.raises(ValueError):
            release.safe_path(bad, ("data",))


def test_rollback(spark, tmp_path, monkeypatch):
    (tmp_path / "data").mkdir()
    (tmp_path / "data/a.txt").write_bytes(b"old")
    d = release.Delta(package(tmp_path / "p.zip", [("data/a.txt", b"new", b"old"), ("data/b.txt", b"new", None)]), ("data",))
    real, calls = release.write_atomically, []

    def failing(path, data):
        calls.append(path.name)
        if path.name == "b.txt":
            raise OSError("full")
        real(path, data)

    monkeypatch.setattr(release, "write_atomically", failing)
    with pytest.raises(OSError):
        d.apply(spark, str(tmp_path), dry_run=False)
    assert (tmp_path / "data/a.txt").read_bytes() == b"old" and not (tmp_path / "data/b.txt").exists()


def test_digests_locks_and_runs(spark, tmp_path):
    assert release.canonical_digest({"b": 1, "a": "ü"}) == hashlib.sha256('{"a": "ü", "b": 1}'.encode()).hexdigest()
    (tmp_path / "x.bin").write_bytes(b"abc")
    got = release.file_digests(spark, str(tmp_path)).first()
    assert (got.bytes, got.sha256) == (3, hashlib.sha256(b"abc").hexdigest())
    locked = spark.createDataFrame([("p", "1"), ("q", "2")], "path string, sha256 string")
    assert [r.path for r in release.lock_violations(locked, locked.where("path = 'p'")).collect()] == ["q"]
    runs = release.Runs(str(tmp_path / "runs"))
    f = runs.fingerprint("prepare", data="d1")
    with pytest.raises(ValueError):
        runs.require("prepare", f)
    runs.finish("prepare", f, rows=3)
    runs.require("prepare", f)
    runs.finish("train", f, status="failed")
    with pytest.raises(ValueError):
        runs.require("train", f)
    assert not runs.done("prepare", runs.fingerprint("prepare", data="d2"))


def test_reuse_moves_windows_once_and_broadcasts_none(spark, tmp_path):
    words = F.split("x", " ")
    texts = spark.createDataFrame([(1, "a b c a b c"), (1, "c a b d"), (2, None), (3, "a b")], "id int, x string")
    pool = spark.createDataFrame([("x a b c x",), ("a b c",), (None,)], "x string")
    texts.write.parquet(f"{tmp_path}/texts")
    pool.write.parquet(f"{tmp_path}/pool")  # files, whose size Spark takes for that of the windows
    df = overlap.reuse(spark.read.parquet(f"{tmp_path}/texts"), "id", words, spark.read.parquet(f"{tmp_path}/pool"), words, 3)
    assert sorted(tuple(r) for r in df.collect()) == [(1, 4, 1, 0.25), (1, 4, 1, 0.25), (2, 0, 0, 0.0), (3, 0, 0, 0.0)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BroadcastHashJoin \[h1#", plan)
    assert len(re.findall(r"Exchange hashpartitioning\([^)]*h1#", plan.rpartition("Initial Plan")[2])) == 2


def test_pair_gate_screens_training_prompts(spark, tmp_path):
    from sceneloom import plans

    rows = [("A", "eins zwei drei vier fünf sechs sieben", "der Anfang eins zwei drei vier fünf sechs und Schluss", 1), ("B", "nichts davon steht hier", "vorn eins zwei drei vier hinten", 1), ("C", "a b c d", None, 1), ("D", None, "ganz ohne Treffer in jedem Ziel", 1), ("A", "alt", "alt", 0)]
    spark.createDataFrame(rows, "segment_id string, target_text string, instruction_de string, delivered_at int").write.parquet(f"{tmp_path}/sft_pairs.parquet")
    got = {tuple(r) for r in plans.queries()["l3_a14_pair_gate"](spark, str(tmp_path)).collect()}
    assert got == {("A", 6, 6, False), ("B", 4, 0, True), ("D", 0, 0, True)}
    runs = {tuple(r) for r in plans.queries()["l1_l2_pair_word_runs"](spark, str(tmp_path)).collect()}
    assert runs == {("A", "A", 2, 0, 6), ("A", "A", 3, 1, 5), ("A", "A", 4, 2, 4), ("B", "A", 1, 0, 4)}


def test_swap_and_changed_meanwhile(spark, tmp_path, monkeypatch):
    for name in ("new", "old"):
        spark.createDataFrame([(name,)], "x string").write.parquet(f"file://{tmp_path}/{name}")
    release.swap_table(spark, f"file://{tmp_path}/new", f"file://{tmp_path}/old")
    assert spark.read.parquet(f"file://{tmp_path}/old").first().x == "new" and sorted(p.name for p in tmp_path.iterdir()) == ["old"]
    with pytest.raises(Exception):
        release.swap_table(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/old")
    assert spark.read.parquet(f"file://{tmp_path}/old").count() == 1
    (tmp_path / "data").mkdir()
    (tmp_path / "data/a.txt").write_bytes(b"old")
    d = release.Delta(package(tmp_path / "p.zip", [("data/a.txt", b"new", b"old")]), ("data",))
    real = d.plan

    def plan(*args):
        out = real(*args)
        (tmp_path / "data/a.txt").write_bytes(b"edited")
        return out

    monkeypatch.setattr(d, "plan", plan)
    with pytest.raises(ValueError, match="changed meanwhile"):
        d.apply(spark, str(tmp_path), dry_run=False)
    assert (tmp_path / "data/a.txt").read_bytes() == b"edited"
