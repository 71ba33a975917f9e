import random
from collections import Counter, defaultdict

from sceneloom.llm import grouped_split as g

SCHEMA = "segment_id string, work_id string, scene_id string, scene_group_id string, split string, recommended_task string, unit string, root string, label string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "u", "r", "l") for r in rows], SCHEMA)


def groups(rows):
    """Union-find over segments, scenes and groups."""
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for i, _, s, n, *_ in rows:
        if i is None:
            continue
        me = top(("x", i))
        for kind, v in (("s", s), ("g", n.strip().lower() if n else None)):
            if v is not None:
                up[top((kind, v))] = top(me)
    return {i: top(("x", i)) for i, *_ in rows if i}


def random_rows(seed, n=300, scenes=60, nodes=40):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        s = r.randrange(scenes)
        rows.append((f"P{k:04d}", f"F{s % 7}", None if r.random() < 0.1 else f"S{s}", None if r.random() < 0.2 else r.choice([" G{}", "g{} ", "G{}"]).format(s % nodes), r.choice(["train", "Test", "dev", None]), r.choice(["a", "b", None])))
    for _ in range(25):  # delivered again under another scene or group
        o = r.choice(rows)
        rows.append((o[0], o[1], f"S{r.randrange(scenes)}", o[3], "train", o[5]))
    return rows


def test_units_equal_union_find(spark):
    for seed in (1, 2):
        rows = random_rows(seed)
        want = groups(rows)
        got = {r.segment_id: r.unit for r in g.units(table(spark, rows))[0].collect()}
        assert set(got) == set(want)
        assert len(set(got.values())) == len(set(want.values())) == len({(got[i], want[i]) for i in got})


def test_long_chain(spark):
    rows = [(f"P{k}", "F1", f"S{k}", f"G{k + 1}", "train", None) for k in range(40)] + [(f"Q{k}", "F1", f"S{k}", f"G{k}", "test", None) for k in range(40)]
    assert {r.unit_id for r in g.torn(table(spark, rows)).collect()} == {"g0"}


def test_torn(spark):
    rows = [("A", "F1", "S1", " G1 ", "train", None), ("B", "F1", "S1", None, "val", None), ("C", "F1", "S2", "g1", None, None), ("D", "F1", "S3", "g3", "train", None), ("E", "F1", None, None, "train", None), ("E", "F1", None, None, "test", None), ("F", "F1", "S9", None, "dev", None), ("F", "F1", "S9", None, "validation", None), (None, "F1", "S3", None, "test", None)]
    assert {tuple(r) for r in g.torn(table(spark, rows)).collect()} == {("A", "g1"), ("B", "g1"), ("C", "g1"), ("E", None)}


def test_assignment_keeps_units_and_shares(spark):
    rows = [(f"P{k:05d}", f"F{k % 5}", f"S{k // 3}", None, None, "rare" if k % 50 == 0 else "often") for k in range(3000)]
    rows += [(f"H{k:04d}", "F0", "HOT", None, None, "often") for k in range(1000)] + rows[:30]
    got = g.assign(table(spark, rows), g.Params(shard_units=300)).collect()
    assert len(got) == len({r.segment_id for r in got}) == 4000
    by = defaultdict(set)
    for r in got:
        by[r.unit].add(r.split)
    assert all(len(x) == 1 for x in by.values())
    n = Counter(r.split for r in got)
    assert abs(n["train"] / 4000 - 0.8) < 0.02 and abs(n["test"] / 4000 - 0.1) < 0.015
    rare = Counter(r.split for r in got if r.segment_id[0] == "P" and int(r.segment_id[1:]) % 50 == 0)
    assert 40 <= rare["train"] <= 56 and rare["test"] >= 2 and rare["validation"] >= 2


def test_place_takes_the_rarest_label_first():
    units = [("a", 2, {"x": 2}), ("b", 2, {"x": 2, "y": 1}), ("c", 2, {"x": 2})]
    got = g.place(units, {"x": [3.0, 1.5, 1.5], "y": [0.0, 1.0, 0.0]}, [3.0, 1.5, 1.5])
    assert got["b"] == 1


def test_empty_and_null_labels(spark):
    assert g.assign(table(spark, [])).count() == 0 and g.torn(table(spark, [])).count() == 0 and g.balance(table(spark, [])).count() == 0
    assert {r.segment_id for r in g.assign(table(spark, [("A", None, None, None, None, None), ("B", None, None, "", None, None)])).collect()} == {"A", "B"}


def test_labels_stay_balanced_on_either_side_of_the_shards(spark):
    """The shares of every label, with all units in one shard and with many shards."""
    r = random.Random(3)
    rows = [(f"P{k:05d}", f"F{min(r.randrange(12), r.randrange(12))}", f"S{k // r.choice([1, 2, 5, 9])}", None, None, r.choice(["a", "a", "a", "b"])) for k in range(6000)]
    rows += [(f"Q{k:03d}", "selten", f"T{k}", None, None, None) for k in range(100)]  # about one in each small shard
    df = table(spark, rows)
    for p in (g.Params(), g.Params(shard_units=200)):
        for x in g.label_balance(df, p).collect():
            assert abs(x.train - 0.8) < 0.05 and abs(x.test - 0.1) < 0.04, (p, x)
        assert tuple(g.check(df, p).first()) == (6100, 0, 0, True)


def test_labels_without_end_are_refused(spark):
    import pytest

    rows = [(f"P{k}", f"F{k}", None, None, None, None) for k in range(30)]
    with pytest.raises(ValueError, match="too many"):
        g.assign(table(spark, rows), g.Params(most_labels=20))
