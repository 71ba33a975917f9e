import random
from collections import defaultdict

from sceneloom.llm import shared_spans as s
from sceneloom.llm.text import body, tokens

SCHEMA = "segment_id string, target_text string, instruction_de string, bucket string, win string, text_key string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "b", "w", "k") for r in rows], SCHEMA)


def brute(rows, k):
    held = defaultdict(set)
    fields = {}
    for i, t, d in rows:
        if i is not None:
            fields[i] = (tokens(t), tokens(body(d)))
    for i, both in fields.items():
        for w in both:
            for j in range(len(w) - k + 1):
                held[tuple(w[j : j + k])].add(i)
    pairs = {(a, b) for x in held.values() for a in x for b in x if a < b}
    cover = {}
    for i, both in fields.items():
        for f, w in zip(("target_text", "instruction_de"), both):
            if len(w) >= k:
                mark = [False] * len(w)
                for j in range(len(w) - k + 1):
                    if len(held[tuple(w[j : j + k])]) > 1:
                        mark[j : j + k] = [True] * k
                cover[i, f] = (len(w), sum(mark))
    return pairs, cover


def check(spark, rows, p):
    pairs, cover = brute(rows, p.k)
    df = table(spark, rows)
    assert {tuple(r) for r in s.found_pairs(df, p).collect()} == pairs
    assert {(r.segment_id, r.field): (r.n_tokens, r.shared_tokens) for r in s.coverage(df, p).collect()} == cover
    linked = defaultdict(set)
    for r in s.groups(df, p).collect():
        linked[r.span].add(r.segment_id)
    assert {(a, b) for x in linked.values() for a in x for b in x if a < b} == pairs
    return pairs


def records(seed, n=80, vocabulary=400):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        rows.append((f"S{k:03d}", " ".join(f"w{r.randrange(vocabulary)}" for _ in range(r.randrange(10, 90))), "Intro\n \nForm " + " ".join(f"w{r.randrange(vocabulary)}" for _ in range(40))))
    for k in range(40):
        a, b = r.choice(rows[:n]), r.choice(rows[:n])
        w = a[1].split(" ")
        j = r.randrange(max(1, len(w) - 14))
        rows.append((f"T{k:03d}", "neu " + " ".join(w[j : j + r.choice([15, 16, 17, 40])]) + " \r\nalt", b[2] if k % 4 == 0 else None))
    return rows


def test_equals_brute_force(spark):
    rows = records(3)
    rows += rows[:4]  # delivered again
    assert len(check(spark, rows, s.Params())) > 10


def test_small_windows_few_words_and_hot_minimisers(spark):
    r = random.Random(5)
    rows = [(f"S{k}", " ".join(r.choice("ab") for _ in range(r.randrange(3, 30))), None) for k in range(30)] + [("same", "a a a a a a a a a", "x\n\na a a a a a a")]
    check(spark, rows, s.Params(k=5, m=2, bucket=20, every=1, partition=7))
    check(spark, rows, s.Params(k=5, m=2))


def test_hot_passage_in_a_third_of_the_records(spark):
    r = random.Random(6)
    passage = " ".join(f"formel{k}" for k in range(20))
    rows = [(f"S{k:03d}", " ".join(f"w{r.randrange(5000)}" for _ in range(30)) + (" " + passage + f" e{k}" if k % 3 == 0 else ""), None) for k in range(90)]
    assert len(check(spark, rows, s.Params(bucket=10, every=2))) == 30 * 29 // 2


def test_nulls_copies_long_and_empty(spark):
    long = " ".join(f"w{k}" for k in range(20_000))
    rows = [(None, long, None), ("A", None, None), ("B", "", "no body"), ("C", long, None), ("D", long, None), ("E", "kurz", "x\n\n" + long), ("F", "  \r\n", "\n\n\n")]
    assert check(spark, rows, s.Params()) == {("C", "D"), ("C", "E"), ("D", "E")}
    # a span in both fields of one record is no sharing
    one = " ".join(f"v{k}" for k in range(20))
    assert check(spark, [("A", one, "x\n\n" + one + " mehr"), ("B", "etwas anderes", None)], s.Params()) == set()
    assert s.found_pairs(table(spark, [])).count() == 0 and s.coverage(table(spark, [])).count() == 0
