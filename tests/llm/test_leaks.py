import random

from sceneloom.llm import leaks as k
from sceneloom.llm.text import body, words

DOCS = "doc_id bigint, text string, block string, term string, case_id string"
CASES = "case_id string, target_text string, instruction_de string, places string, doc_id bigint"


def tables(spark, docs, cases):
    return spark.createDataFrame([(*d, "b", "t", "c") for d in docs], DOCS), spark.createDataFrame([(*c, "p", 7) for c in cases], CASES)


def brute(docs, cases, n=13):
    held = {}
    for c, *fields in cases:
        for x in (words(fields[0]), words(body(fields[1]))):
            for j in range(len(x) - n + 1):
                held.setdefault(tuple(x[j : j + n]), set()).add(c)
    return {(d, c) for d, t in docs for x in [words(t)] for j in range(len(x) - n + 1) for c in held.get(tuple(x[j : j + n]), ()) if d is not None and c is not None}


def data(seed=2):
    r = random.Random(seed)
    text = lambda n, v=60: [f"w{r.randrange(v)}" for _ in range(n)]
    cases = [(f"C{k:02d}", " ".join(text(60)), "Vorspann\n\n" + " ".join(text(30))) for k in range(12)]
    docs = []
    for k in range(150):
        x = text(r.randrange(0, 60))
        if k % 3 == 0:
            c = r.choice(cases)
            source = words(c[1]) if r.random() < 0.5 else words(body(c[2]))
            j = r.randrange(len(source) - 12)
            part = source[j : j + r.choice([11, 12, 13, 20])]
            if r.random() < 0.3:
                part[len(part) // 2] = "anders"
            at = r.choice([0, len(x)])
            x = x[:at] + part + x[at:]
        docs.append((k, " ".join(x).upper()))
    return docs, cases


def test_equals_brute_force_over_blocks_and_chunks(spark):
    docs, cases = data()
    want = brute(docs, cases)
    assert len(want) > 10
    for p in (k.Params(), k.Params(block_rows=7, query_bytes=700)):
        assert {tuple(r) for r in k.found(*tables(spark, docs, cases + cases[:2]), p).collect()} == want
    d, c = tables(spark, docs, cases)
    stored = k.index(d)
    half = c.where("case_id < 'C06'")
    assert {tuple(r) for r in k.found(d, half, stored=stored).collect()} == {x for x in want if x[1] < "C06"}
    assert {(r.doc_id, r.case_id) for r in k.proximity(d, half, stored=stored).collect()} >= {x for x in want if x[1] < "C06"}


def brute_near(docs, cases, p):
    out = {}
    for d, t in docs:
        w = words(t)
        where = {}
        for j, x in enumerate(w):
            where.setdefault(x, []).append(j)
        for c, *fields in cases:
            for name, x in (("target_text", words(fields[0])), ("instruction_de", words(body(fields[1])))):
                windows = best = 0
                for j in range(len(x) - p.least + 1):
                    seen = 0
                    passage = x[j : j + p.least]
                    for at in {q - o + e for o, y in enumerate(passage) for q in where.get(y, ()) for e in range(-p.slack, p.slack + 1)}:
                        seen = max(seen, sum(any(abs(q - at - o) <= p.slack for q in where.get(y, ())) for o, y in enumerate(passage)))
                    windows += seen >= p.near
                    best = max(best, seen)
                if windows:
                    out[d, c, name] = (windows, best)
    return out


def test_proximity_equals_brute_force(spark):
    r = random.Random(9)
    docs, cases = data(3)
    docs, cases = docs[:60], [(c, " ".join(f"v{r.randrange(900)}" for _ in range(30)), None) for c, *_ in cases[:4]]
    for n, (c, t, _) in enumerate(cases):
        x = t.split()
        docs += [(900 + 10 * n, " ".join(x[3:18])), (901 + 10 * n, " ".join(x[2:9] + ["neu"] + x[9:20])), (902 + 10 * n, " ".join(x[4:16] + ["ende"])), (903 + 10 * n, " ".join(x[::-1]))]
    p = k.Params()
    want = brute_near(docs, cases, p)
    got = {(r.doc_id, r.case_id, r.field): (r.windows, r.best) for r in k.proximity(*tables(spark, docs, cases), p).collect()}
    assert want and got == want
    assert {(d, c) for d, c, _ in got} >= brute(docs, cases)


def test_nulls_long_and_empty(spark):
    passage = " ".join(f"p{j}" for j in range(13))
    docs = [(1, None), (2, ""), (3, "  "), (None, passage), (4, "z " * 50_000 + passage), (5, passage), (5, passage)]
    cases = [("A", passage, None), ("B", None, None), (None, passage, None), ("D", "kurz", "a\n\n" + passage + " mehr")]
    assert {tuple(r) for r in k.found(*tables(spark, docs, cases)).collect()} == {(d, c) for d in (4, 5) for c in "AD"}
    for a, b in ((docs, []), ([], cases), ([], [])):
        assert k.found(*tables(spark, a, b)).count() == 0 and k.proximity(*tables(spark, a, b)).count() == 0
