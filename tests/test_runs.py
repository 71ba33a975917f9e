import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sceneloom import plans
from sceneloom.operators import overlap, runs


def texts(seed, n):
    r = random.Random(seed)
    long = random.Random(0).choices("abcdefgh", k=60)  # the same for all seeds
    out = [[r.choice("abc") for _ in range(r.randrange(0, 30))] for _ in range(n)]
    return out + [long[5:50], ["x", *long], [*long, "y"], None, ["a", "b", "c"], ["a"] * 12]


@pytest.fixture(scope="module")
def sides(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("runs")
    made = []
    for key, seed in (("case_id", 1), ("segment_id", 2)):
        rows = [(f"s{k}", None if t is None else " ".join(t)) for k, t in enumerate(texts(seed, 60))]
        spark.createDataFrame(rows, f"{key} string, x string").write.parquet(f"file://{root}/{key}")
        made += [spark.read.parquet(f"file://{root}/{key}"), key, F.split("x", " ")]
    return [*made, 4]


def test_word_runs_equal_the_join_and_move_no_hit(spark, sides):
    df = runs.matches(*sides)
    want = overlap.matches(*sides)
    assert df.columns == want.columns and [t for _, t in df.dtypes] == [t for _, t in want.dtypes]
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(tuple(r) for r in want.collect()) and max(r[4] for r in got) > 40


def test_pair_queries_move_no_hit(spark, tmp_path):
    """Texts are shuffled to find the last delivery and to make blocks; hits neither by a join nor by a window."""
    rows = [("A", "eins zwei drei vier", "eins zwei drei vier", 1)]
    spark.createDataFrame(rows, "segment_id string, target_text string, instruction_de string, delivered_at int").write.parquet(f"{tmp_path}/sft_pairs.parquet")
    df = plans.queries()["l1_l2_pair_word_runs"](spark, str(tmp_path))
    assert [tuple(r) for r in df.collect()] == [("A", "A", 0, 0, 4)]
    gate = plans.queries()["l3_a14_pair_gate"](spark, str(tmp_path))
    assert [tuple(r) for r in gate.collect()] == [("A", 4, 4, True)]
    for x in (df, gate):
        plan = x._jdf.queryExecution().executedPlan().toString().rpartition("Initial Plan")[2]
        assert plan.count("Exchange") <= 2 and "Window" not in plan and "Join" not in plan


def test_gate_equals_the_longest_of_all_runs(spark, sides):
    got = runs.longest(*sides)
    want = overlap.longest(sides[0], overlap.matches(*sides), "case_id", "segment_id")
    assert got.dtypes == want.dtypes
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(tuple(r) for r in want.collect()) and {r[1] == r[2] for r in rows if r[1]} == {True, False}


def test_small_blocks_batches_and_hits(tmp_path, monkeypatch):
    """Results don't depend on where blocks, batches and lots of hits end."""
    sides = [texts(seed, 40) for seed in (3, 4)]
    number = {w: (k * 2 + 1) << 40 for k, w in enumerate("abcdefghxy")}
    columns = [[pa.array([f"s{k}" for k in range(len(s))]), pa.array([t and [number[w] for w in t] for t in s], pa.list_(pa.int64()))] for s in sides]
    pq.write_table(pa.table(columns[1], ["t", "w"]), tmp_path / "t.parquet")

    def found():
        out = []
        for block in runs._blocks(iter([pa.RecordBatch.from_arrays(columns[0], ["p", "w"])]), 4):
            for keys, w, starts, count in runs._stored([f"file://{tmp_path}/t.parquet"]):
                at, text, k = block.known(w, starts, count)
                for row, x in runs._spans(block.first[k], block.size[k]):
                    p, t = block.text[x], text[row]
                    n = runs.lengths(block.w, block.at[x], w, at[row], 4)
                    out += zip(block.keys.take(pa.array(p)).to_pylist(), keys.take(pa.array(t)).to_pylist(), (block.at[x] - block.starts[p]).tolist(), (at[row] - starts[t]).tolist(), n.tolist(), strict=True)
        return sorted(out)

    def gate():
        out = []
        for block in runs._blocks(iter([pa.RecordBatch.from_arrays(columns[0], ["p", "w"])]), 4):
            most = np.zeros(len(block.keys), np.int32)
            for _, w, starts, count in runs._stored([f"file://{tmp_path}/t.parquet"]):
                at, _, k = block.known(w, starts, count)
                block.reach(most, w, at, k)
            out += zip(block.keys.to_pylist(), most.tolist(), strict=True)
        return dict(out)

    def brute():
        for a, x in enumerate(sides[0]):
            for b, y in enumerate(sides[1]):
                for i in range(len(x or [])):
                    for j in range(len(y or [])):
                        n = 0
                        while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                            n += 1
                        if n >= 4:
                            yield f"s{a}", f"s{b}", i, j, n

    want = sorted(brute())
    most = {f"s{a}": max([0, *(n for p, *_, n in want if p == f"s{a}")]) for a in range(len(sides[0]))}
    assert found() == want and gate() == most
    for name, value in (("BLOCK", 50), ("BATCH", 3), ("HITS", 7)):
        monkeypatch.setattr(runs, name, value)
        assert found() == want and gate() == most
