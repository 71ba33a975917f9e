import random

from sceneloom.llm import cross_split as c
from sceneloom.llm.text import body, words

SCHEMA = "segment_id string, work_id string, split string, target_text string, instruction_de string, field string, side string, rep string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def brute(rows, p=c.Params()):
    """All pairs of records on different sides, compared by their word sequences."""
    names = {"val": "h", "dev": "h", "validation": "h", "test": "h", "train": "t"}
    of = {}
    for i, _, s, t, d in rows:
        side = names.get((s or "").strip(" \t\r\n ").lower())
        if i and side:
            grams = [{tuple(w[k : k + p.gram]) for k in range(len(w) - p.gram + 1)} for w in (words(t), words(body(d)))]
            of[i, side] = grams
    out = set()
    for (a, sa), ga in of.items():
        for (b, sb), gb in of.items():
            if sa == "t" and sb == "h" and a != b and any(x and y and len(x & y) >= p.similarity * len(x | y) - 1e-9 for x, y in zip(ga, gb)):
                out.add((min(a, b), max(a, b)))
    return out


def records(seed=1, n=120):
    r = random.Random(seed)
    vocabulary = [f"wort{k}" for k in range(300)]
    rows = []
    for k in range(n):
        text = [r.choice(vocabulary) for _ in range(r.choice([12, 40, 90]))]
        rows.append((f"S{k:04d}", "F1", r.choice(["train", " Train", "TEST", "val", "dev", None, "other"]), " ".join(text), "Intro\n\nForm: x\n" + " ".join(r.choice(vocabulary) for _ in range(50))))
    for k in range(60):  # copies of earlier records with more and more words changed
        old = rows[r.randrange(n)]
        text = old[3].split(" ")
        for _ in range(r.randrange(0, max(1, len(text) // 6))):
            text[r.randrange(len(text))] = r.choice(vocabulary)
        rows.append((f"T{k:04d}", "F2", r.choice(["test", "train"]), "  ".join(text).upper(), old[4] if k % 3 else None))
    return rows


def test_equals_brute_force(spark):
    rows = records()
    rows += rows[:5]  # delivered again
    want = brute(rows)
    assert len(want) > 20
    assert {tuple(r) for r in c.found_pairs(table(spark, rows)).collect()} == want


def test_hot_group_of_copies_and_report(spark):
    text = " ".join(f"zeile{k}" for k in range(60))
    rows = [(f"A{k:03d}", "F1", "train", text, None) for k in range(60)] + [(f"B{k}", "F2", "test", text, "") for k in range(3)] + [("C", "F2", "test", "ganz anderer text hier", "a\n\nb")]
    assert c.found_pairs(table(spark, rows)).count() == 180
    got = {(r.split, r.work_id): (r.records, r.overlapping) for r in c.report(table(spark, rows)).collect()}
    assert got == {("test", "F2"): (4, 3)}


def test_nulls_short_long_and_empty(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(None, None, "train", "a b c d", None), ("A", None, "train", None, None), ("B", None, "test", None, None), ("C", None, None, "a b c d", None), ("D", None, "train", "zwei worte", ""), ("E", None, "test", "zwei worte", "   "), ("F", None, "train", long, None), ("G", None, "test", long + " ende", None)]
    assert [tuple(r) for r in c.found_pairs(table(spark, rows)).collect()] == [("F", "G")]
    assert c.found_pairs(table(spark, [])).count() == 0 and c.report(table(spark, [])).count() == 0


def test_scattered_changes_that_leave_few_chunks_whole(spark):
    r = random.Random(4)
    vocabulary = [f"wort{k}" for k in range(3000)]
    rows = []
    for k in range(500):
        text = [r.choice(vocabulary) for _ in range(r.choice([14, 30, 60]))]
        rows.append((f"A{k:03d}", "F1", "train", " ".join(text), None))
        for at in range(r.randrange(9), len(text), 13):
            text[at] = "neu"
        rows.append((f"B{k:03d}", "F2", "test", " ".join(text), None))
    want = brute(rows)
    assert len(want) > 200
    assert {tuple(x) for x in c.found_pairs(table(spark, rows)).collect()} == want


def test_no_near_pair_is_missed_at_any_length(spark):
    """Records of 6 to 160 words with as many changed words as the similarity allows, and more."""
    r = random.Random(11)
    rows = []
    for n in (6, 8, 10, 12, 16, 24, 40, 80, 160):
        for k in range(40):
            text = [f"w{r.randrange(40_000)}" for _ in range(n)]
            rows.append((f"A{n:03d}-{k:02d}", "F1", "train", " ".join(text), None))
            for at in r.sample(range(n), r.randrange(0, max(2, n // 8 + 1))):
                text[at] = "neu"
            rows.append((f"B{n:03d}-{k:02d}", "F2", "test", " ".join(text), None))
    want = brute(rows)
    least = {n: sum(a.startswith(f"A{n:03d}") for a, _ in want) for n in (6, 8, 10, 12, 16, 24, 40, 80, 160)}
    assert min(least.values()) >= 20
    assert {tuple(x) for x in c.found_pairs(table(spark, rows)).collect()} == want


def test_record_overlaps_are_sums_of_shared_chunks(spark):
    rows = records(5)
    p = c.Params()

    def chunks(text, f):
        import numpy as np

        w = words(text)
        if not w:
            return None
        h, off = c.TokenHashes().of([w])
        digest, length, _ = c._chunks(c.Rolling(h), off, np.array([f]), p)
        return list(zip(digest.tolist(), length.tolist()))

    train, held = {0: set(), 1: set()}, {}
    for i, _, s, t, d in rows:
        side = {"train": "t", "test": "h", "val": "h", "dev": "h"}.get((s or "").strip().lower())
        for f, text in enumerate((t, body(d))):
            x = chunks(text, f)
            if x and side == "t":
                train[f] |= {k for k, _ in x}
            elif x and side == "h":
                held[i, "instruction_de" if f else "target_text"] = (f, x)
    want = {k: sum(n for x, n in xs if x in train[f]) / sum(n for _, n in xs) for k, (f, xs) in held.items()}
    got = {(r.segment_id, r.field): r.overlap for r in c.record_overlaps(table(spark, rows)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and max(want.values()) > 0.5


def test_classes_and_links_expand_to_the_pairs(spark):
    rows = records(7) + [(f"H{k}", "F1", s, "immer der gleiche text in allen diesen zeilen", None) for k, s in enumerate(["train", "train", "test", "val"])]
    df = table(spark, rows)
    of = {}
    for r in c.classes(df).collect():
        of.setdefault((r.field, r.rep, r.side), set()).add(r.segment_id)
    got = set()
    for x in c.links(df).collect():
        got |= {(min(a, b), max(a, b)) for a in of.get((x.field, x.rep_a, "train"), ()) for b in of.get((x.field, x.rep_b, "held out"), ()) if a != b}
    assert got == brute(rows) and {r.rep for r in c.links(df).where("rep_a = rep_b").selectExpr("rep_a as rep").collect()} >= {"H0"}


def test_overlaps_below_the_candidates(spark):
    common = " ".join(f"gleich{k}" for k in range(40))
    rows = [("A", "F1", "train", common + " " + " ".join(f"a{k}" for k in range(360)), None), ("B", "F2", "test", " ".join(f"b{k}" for k in range(360)) + " " + common, None), ("C", "F2", "test", "ganz anderer text hier", None), ("D", "F1", "train", "allein auf beiden seiten hier", None), ("D", "F1", "test", "allein auf beiden seiten hier", None)]
    got = {r.segment_id: (r.overlap, r.near) for r in c.record_overlaps(table(spark, rows)).collect()}
    assert 0 < got["B"][0] < 0.2 and got["C"] == (0.0, False)
    assert {(r.work_id, r.records, r.overlapping) for r in c.report(table(spark, rows)).collect()} == {("F2", 2, 0), ("F1", 1, 0)}
