import random

from sceneloom.llm import truncation as t

SCHEMA = "doc_id bigint, source string, text string, cut string, ending string, unit string, chars string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)


def sentence(r):
    return " ".join(["Der"] + ["".join(r.choice("abcdeünöß") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(4, 12))]) + r.choice([".", "!", "?"])


def text(r, n):
    out = sentence(r)
    while len(out) < n:
        out += r.choice([" ", "\n"]) + sentence(r)
    return out


def test_endings(spark):
    whole = ["Er geht.", "Geht er?", "„Ja.“", "Sie geht …!", "Ein Satz.\n(ab)", "Ein Satz.\n* * *", "走。", "Er geht. …", "Ein Satz.  ​\n", "...", "Gut. [...]"]
    bare = ["Er geht nach", "Er ge", "Er geht, ", "und dann –", "X (leise", "die Stadt:", "Er sagte. Dann kam d", "Ein Satz.\n— Lioba", "Ein Satz.\n\nENDE", "Blatt 3 von 4"]
    marked = ["Er geht …", "Er geht…", "Er geht [...]", "Er geht..."]
    blank = [None, "", " \n "]
    every = [(x, k) for k, xs in (("complete", whole), ("bare", bare), ("marked", marked), (None, blank)) for x in xs]
    got = {r.doc_id: r.ending for r in t.endings(table(spark, [(i, "s", x) for i, (x, _) in enumerate(every)]), t.Params()).collect()}
    assert [(every[i], got[i]) for i in got if got[i] != every[i][1]] == []


def corpus():
    r = random.Random(8)
    rows, cut = [], set()
    for k in range(2400):
        source = ["free", "chars", "bytes", "word", "marks", None][k % 6]
        x = text(r, r.randrange(40, 900))
        full = x
        if source == "chars" and len(x) > 400:
            x = x[:400]
        elif source == "bytes":
            x = x.encode()[:512].decode(errors="ignore")
        elif source == "word" and len(x) > 300:
            x = x[:300].rsplit(" ", 1)[0]
        elif source == "marks" and len(x) > 250:
            x = x[:249] + "…"
        elif source == "free" and k % 60 == 0:
            x = x[: r.randrange(20, len(x) - 1)]
        elif source == "free" and k % 42 == 0:
            x = x[:-1] + " …"  # style
        elif k % 25 == 0:
            x += "\n\nProbenplan der Woche"  # a closing line
        if x != full and source and not x.endswith("Woche") and not (source == "free" and x.endswith(" …")) and x.rstrip("…").rstrip()[-1] not in ".!?":
            cut.add(k)
        rows.append((k, source, x))
    return rows, cut


def test_finds_cut_texts_and_limits(spark):
    rows, cut = corpus()
    copy = next(k for k, s, x in rows if s == "marks" and k in cut)
    rows.append((9000, "free", rows[copy][2].replace(" ", "  ")))
    df = table(spark, rows)
    got = {r.doc_id for r in t.found(df).collect()}
    assert got == cut | {9000}
    limits = {(r.source, r.unit, r.length, r.band) for r in t.limits(df).collect()}
    assert {("chars", "chars", 400, 1), ("bytes", "bytes", 512, 1), ("marks", "chars", 250, 1)} <= limits
    assert any(s == "word" and u == "chars" and abs(n - 300) < 13 for s, u, n, _ in limits)
    assert not any(s in ("free", None) for s, *_ in limits)
    rates = {r.source: r for r in t.rates(df).collect()}
    assert sum(r.documents for r in rates.values()) == len(rows) and sum(r.cut for r in rates.values()) == len(got)
    assert all(r.cut == r.at_limit + r.broken for r in rates.values()) and rates["free"].broken > 0
    assert rates[None].cut == 0 and rates["chars"].at_limit > 0


def other_corpus(n, seed):
    """Another language, other closing lines, a list at the end; a limit of 300 code points and broken transfers."""
    r = random.Random(seed)
    names = ["Ilona", "Béla", "Márta", "Géza", "Ottó"]
    closing = [lambda: f"sgd. {r.choice(names)} {r.choice(names)}", lambda: f"p. {r.randrange(1, 9)} / 9", lambda: "Filed under: " + ", ".join(r.sample(names, 2)), lambda: "FINIS", lambda: "Cast\n" + "\n".join(r.sample([f"{x}, a clerk" for x in names], 3))]
    rows, cut = [], {"field limit": set(), "broken transfer": set()}
    for k in range(n):
        x = text(r, r.randrange(60, 700))
        source = ["press", "archive", "blog"][k % 3]
        if source == "press" and len(x) > 300:
            x = x[:300]
            if x.rstrip()[-1] not in ".!?":
                cut["field limit"].add(k)
        elif k % 37 == 0:
            x = x[: r.randrange(30, len(x) - 1)].rstrip(".!? \n")
            cut["broken transfer"].add(k)
        elif k % 5 == 0:
            x += "\n\n" + r.choice(closing)()
        rows.append((k, source, x))
    return rows, cut


def test_closing_lines_are_learned_at_any_size(spark):
    for n in (600, 3000):
        rows, cut = other_corpus(n, n)
        got = {"field limit": set(), "broken transfer": set()}
        for x in t.judged(table(spark, rows)).where("cut").collect():
            got[x.reason].add(x.doc_id)
        # a broken text may be as long as the limit by chance
        assert got["field limit"] | got["broken transfer"] == cut["field limit"] | cut["broken transfer"]
        assert cut["field limit"] <= got["field limit"]


def test_hazard_test_is_an_upper_bound():
    """The bound used for the p-value is never below the binomial tail."""
    import math

    for n, k, h in ((50, 5, 0.01), (200, 20, 0.05), (30, 30, 0.5)):
        tail = sum(math.comb(n, j) * h**j * (1 - h) ** (n - j) for j in range(k, n + 1))
        a = k / n
        bound = math.exp(-n * (a * math.log(a / h) + ((1 - a) * math.log((1 - a) / (1 - h)) if a < 1 else 0)))
        assert tail <= bound * (1 + 1e-9)


def test_nulls_and_empty(spark):
    rows = [(None, "s", "Er geht nach"), (1, None, None), (2, "s", ""), (3, None, "x" * 300_000), (4, "s", "Er geht."), (4, "s", "Er geht.")]
    assert [r.doc_id for r in t.found(table(spark, rows)).collect()] == [3]
    assert t.found(table(spark, [])).count() == 0 and t.rates(table(spark, [])).count() == 0 and t.limits(table(spark, [])).count() == 0
