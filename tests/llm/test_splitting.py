import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sceneloom.llm import splitting as s

SCHEMA = "segment_id string, scene_id string, target_text string, piece string, start string, boundary string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "p", "s", "b") for r in rows], SCHEMA)


def units(text, level):
    """Units of a text cut at a level, by splitting it."""
    lines = re.split(r"\r\n|\n|\r", text)
    if level == "paragraph":
        out, at, start, end = [], 0, None, 0
        for m in [*re.finditer(r"\r\n|\n|\r", text), None]:
            stop = m.start() if m else len(text)
            if text[at:stop].strip(s.WHITE):
                start, end = at if start is None else start, stop
            elif start is not None:
                out.append(text[start:end])
                start = None
            at = m.end() if m else at
        return out + ([text[start:end]] if start is not None else [])
    if level == "line":
        return lines
    if level == "sentence":
        return [u for x in lines for u in re.split(r"(?<=[.!?…])[ \t ]+", x)]
    return re.split(r"[ \t\r\n ]+", text)


def level(text, limit):
    return next((x for x in ("paragraph", "line", "sentence", "word") if max((len(u.strip(s.WHITE)) for u in units(text, x)), default=0) <= limit), "none")


texts = st.text(alphabet=st.sampled_from(list("ab.!…  \t\n\r ")), max_size=120)


@settings(max_examples=400, deadline=None)
@given(texts, st.integers(1, 30))
def test_level_equals_splitting(text, limit):
    if text.strip(s.WHITE):
        assert s.NAMES[s.level_of(text, limit)] == level(text, limit)


@settings(max_examples=400, deadline=None)
@given(texts, st.integers(4, 30), st.integers(0, 1))
def test_pieces_cover_the_text(text, limit, overlap):
    p = s.Params(limit=limit, overlap=overlap, fill=0.5)
    got = s.pieces_of(text, p)
    assert all(0 < e - a <= limit for a, e, _ in got) or not text
    for (a, e, _), (b, f, _) in zip(got, got[1:]):
        assert a < b and e < f and b >= e - overlap
        assert not text[e : max(e, b)].strip(s.WHITE)  # only white space lies between pieces
    if text:
        assert got[0][0] == 0 and got[-1][1] == len(text) or not text[got[-1][1] :].strip(s.WHITE)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=70), st.data())
def test_range_max_is_rightmost(values, data):
    import numpy as np

    lo = data.draw(st.integers(0, len(values) - 1))
    hi = data.draw(st.integers(lo + 1, len(values)))
    best = max(values[lo:hi])
    assert s.RangeMax(np.array(values, np.int8), len(values)).best(lo, hi) == max(k for k in range(lo, hi) if values[k] == best)


def test_strongest_cut_and_overlap():
    text = "eins zwei.\n\ndrei vier fünf sechs\nsieben acht. neun zehn elf zwölf"
    p = s.Params(limit=30, overlap=6, fill=0.3)
    got = [(text[a:e], s.NAMES[k]) for a, e, k in s.pieces_of(text, p)]
    assert got[0] == ("eins zwei.", "paragraph") and got[1][0].startswith("zwei.\n\ndrei")


def test_operators(spark):
    long = "wort " * 1000
    rows = [("A", "S", "x" * 2400), ("B", "S", "x" * 2401), ("C", None, long), ("C", "S", long), ("D", "S", None), ("E", "S", ""), (None, "S", long), ("F", "S", " \n" * 2000), ("G", "S", ("satz " * 300 + ".\n\n") * 40)]
    assert {tuple(r) for r in s.found(table(spark, rows)).collect()} == {("B", "none"), ("C", "word"), ("F", "paragraph"), ("G", "paragraph")}
    got = s.pieces(table(spark, rows)).collect()
    assert {r.segment_id for r in got} == {"A", "B", "C", "E", "F", "G"}
    assert all(r.end - r.start == len(r.text) <= 2400 for r in got)
    assert [r.scene_id for r in got if r.segment_id == "C"] == ["S"] * 3
    assert s.found(table(spark, [])).count() == 0 and s.pieces(table(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcdeß.", min_size=1, max_size=40), min_size=300, max_size=900), st.lists(st.sampled_from([" ", "\n", "\n\n", "\r\n", "\u00a0"]), min_size=900, max_size=900))
def test_pieces_share_the_stated_overlap(words, gaps):
    text = "".join(w + g for w, g in zip(words, gaps))
    p = s.Params()
    got = s.pieces_of(text, p)
    for (_, e, _), (b, _, _) in zip(got, got[1:]):
        # words are shorter than the overlap, so a piece begins at the first word of the last 200 code points
        starts = [m.start() for m in re.finditer(f"[^{s.WHITE}]+", text) if e - p.overlap <= m.start() < e]
        assert b == starts[0] and p.overlap - 40 - 2 <= e - b <= p.overlap


def test_without_a_gap_in_the_window_the_strongest_earlier_one_is_cut():
    p = s.Params(limit=20, overlap=2, fill=0.5)
    text = "aa bb.\ncc d" + "e" * 30
    (_, end, strength), *_ = s.pieces_of(text, p)
    assert (end, strength) == (6, s.LINE)


def test_check_counts_what_is_wrong(spark, monkeypatch):
    rows = [("A", "S", "wort " * 900), ("A", "S", "wort " * 900), ("B", None, "x" * 5000), ("C", "S", " \n "), ("D", "S", None), (None, "S", "y"), ("E", "S", "")]
    df = table(spark, rows)
    assert tuple(s.check(df).first()) == (4, 0, 0, 0)
    assert tuple(s.check(table(spark, [])).first()) == (0, 0, 0, 0)
    real = s.pieces
    monkeypatch.setattr(s, "pieces", lambda d, p: real(d, p).where("piece <> 1"))
    # A has two pieces and loses its end; B has three, so that its last is also in the wrong place
    assert tuple(s.check(df).first())[2:] == (2, 1)
