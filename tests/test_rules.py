from pyspark.sql import functions as F

from sceneloom.operators import rules as r
from sceneloom.operators.sequence import order_mismatches


def every_type(spark, **change):
    """A sound table, in which one value of one row can be corrupted, and a rule of each type over it."""
    rows = [{"id": f"P{k}", "grp": f"G{k // 2}", "split": "train" if k < 4 else "test", "text": f"text {k}", "sha": None, "status": "ok", "n": 1} for k in range(6)]
    for row in rows:
        row["sha"] = __import__("hashlib").sha256(row["text"].encode()).hexdigest()
    if change:
        rows[3].update(change)
    df = spark.createDataFrame([tuple(x.values()) for x in rows], "id string, grp string, split string, text string, sha string, status string, n int")
    ids = spark.createDataFrame([(f"P{k}",) for k in range(6)], "id string")
    seq = df.select(F.lit("all").alias("by"), (F.substring("text", 6, 1).cast("int")).alias("ord"), "id")
    want = spark.createDataFrame([("all", k, f"P{k}") for k in range(6)], "by string, ord int, id string")
    return [
        r.unique("unique", df, "id"),
        r.references("known", df, "id", ids, "id"),
        r.same_keys("same", df, ids, "id"),
        r.derived("hash", df, "id", "sha", F.sha2("text", 256)),
        r.one_split("split", df, "grp", "split"),
        r.constant("status", df, "id", "status", "ok", None),
        r.pattern("text", df, "id", "text", "^text", present=True),
        r.holds("positive", "constant", df, "id", F.col("n") > 0),
        r.ordered("order", lambda: order_mismatches(seq, want, "by"), "by"),
        r.equal_totals("total", df, F.col("n"), ids, F.lit(1)),
    ]


def failed(rules):
    return {x.check: x.violations for x in r.audit(rules).collect() if not x.passed}


def test_sound_table_passes(spark):
    assert failed(every_type(spark)) == {} and r.violations(every_type(spark)).count() == 0


def test_each_corruption_is_named(spark):
    assert failed(every_type(spark, id="P2")).keys() == {"unique", "same", "order"}
    assert failed(every_type(spark, id="X")).keys() == {"known", "same", "order"}
    assert failed(every_type(spark, sha="0")) == {"hash": 1}
    assert failed(every_type(spark, split="test")) == {"split": 1}
    assert failed(every_type(spark, status="bad")) == {"status": 1} and failed(every_type(spark, status=None)) == {}
    assert failed(every_type(spark, text=None)).keys() == {"hash", "text", "order"}
    assert failed(every_type(spark, n=None)).keys() == {"positive", "total"}
    assert [x.key for x in r.violations(every_type(spark, sha="0")).collect()] == ["P3"]


def test_rules_on_rows_share_a_pass_and_are_named(spark):
    df = spark.createDataFrame([("A", 1, "x"), ("B", None, "x"), ("C", -1, None), (None, 2, "y")], "id string, n int, t string")
    every = r.of_rows(df, "id", [("positive", "constant", F.col("n") > 0), ("filled", "constant", F.col("t").isNotNull()), ("sound", "constant", F.lit(True))])
    more = [r.unique("unique", df, "t")]
    assert {x.check: (x.passed, x.violations) for x in r.audit(every + more).collect()} == {"positive": (False, 2), "filled": (False, 1), "sound": (True, 0), "unique": (False, 1)}
    assert {(x.check, x.key) for x in r.violations(every + more).collect()} == {("positive", "B"), ("positive", "C"), ("filled", "C"), ("unique", "x")}
    assert r.audit(every[:1]).count() == 1 and r.audit(every)._jdf.queryExecution().toString().count("LogicalRDD") <= 4


def test_catalogue(spark):
    from sceneloom.plans import catalogue
    from sceneloom.plans.relations import _RULES

    names = [n for _, n, _, _ in catalogue.ROW_RULES]
    assert len(names) == len(set(names)) and len(_RULES) >= 150
    assert catalogue.spelled("not #has(#lower(x), #re'a(b)') and #size(#distinct(y)) > 0", "spark").startswith("not regexp_like(lower(regexp_replace(x,")
    # a row of each kind of fault in one table, each named by its rule
    ok = {"case_id": "K", "eval_set": "dev", "form_de": "Lied", "instruction_de": "Tu.", "description_zh": "门", "fictional": True, "target_text": None}
    faults = {"case_sets_known": {"eval_set": "other"}, "case_instructions_present": {"instruction_de": " \n"}, "case_forms_given": {"form_de": None}, "cases_fictional": {"fictional": False}, "cases_without_target": {"target_text": "x"}, "case_descriptions_have_han": {"description_zh": "Tor"}, "no_han_in_case_instructions": {"instruction_de": "门"}}
    rows = [tuple((ok | {"case_id": n} | f).values()) for n, f in faults.items()] + [tuple(ok.values())]
    df = spark.createDataFrame(rows, "case_id string, eval_set string, form_de string, instruction_de string, description_zh string, fictional boolean, target_text string")
    mine = r.of_rows(df, "case_id", [(n, k, F.expr(catalogue.spelled(c, "spark"))) for t, n, k, c in catalogue.ROW_RULES if t == "eval_scenes"])
    assert {(x.check, x.key) for x in r.violations(mine).collect()} == {(n, n) for n in faults}
