import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sceneloom.functions import char_count, containment, finite, fold, has_han, lexical_words, norm, ordered_distinct, overlap_words, prefix_suffix, sha256, upper_median, word_count

TRICKY = ["", " ", "a b  c", " x\t\n", "a b c", "ab c", "x\x1cy", "Straße ẞ", "Geht’s don't 12a_b", "😀 a", "界 wort", "  \x1c a \r\n b ", None]


def fold_py(s):
    return s.lower().replace("ß", "ss")


def test_against_python(spark):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(TRICKY)], "k int, t string")
    t = F.col("t")
    for r in df.select("t", norm(t).alias("norm"), word_count(t).alias("words"), char_count(t).alias("chars"), sha256(t).alias("sha"), lexical_words(t).alias("lex"), overlap_words(t).alias("over"), has_han(t).alias("han"), fold(t).alias("fold")).collect():
        if r.t is None:
            assert all(x is None for x in r)
            continue
        assert r.norm == re.sub(r"[\t\r\n ]+", " ", r.t).strip()
        assert (r.words, r.chars, r.fold) == (len(r.t.split()), len(r.t), fold_py(r.t))
        assert r.lex == re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+", fold_py(r.t))
        assert r.over == re.findall(r"\w+", fold_py(r.t))
        assert r.han == bool(re.search("[㐀-鿿]", r.t))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aßÉ1'’_ \t\n\r\x1c\x85 　界")), max_size=20), min_size=1, max_size=60))
def test_random_texts(spark, texts):
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    for r in df.select("t", norm(F.col("t")).alias("norm"), word_count(F.col("t")).alias("words")).collect():
        assert (r.norm, r.words) == (re.sub(r"[\t\r\n ]+", " ", r.t).strip(), len(r.t.split()))


def test_containment_and_prefix(spark):
    df = spark.createDataFrame([("abc\n\ndef\n\ng", "def"), ("abc", None), (None, "x")], "t string, p string")
    a, b = prefix_suffix(F.col("t"))
    assert [tuple(r) for r in df.select(containment(F.col("t"), F.col("p"), F.lit("zz")), a, b).collect()] == [(True, "abc", "def\n\ng"), (False, "abc", None), (None, None, None)]


def test_upper_median_and_ordered_distinct(spark):
    for values in ([5], [1, 2], [3, 1, 2], [4, 1, 3, 2], [2, 2, 9, 9, 9, 1]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v int")
        assert df.agg(upper_median("v").alias("m")).first().m == sorted(values)[len(values) // 2]
    one = spark.createDataFrame([([["b", "a"], None, ["a", "c", "b"]],)], "x array<array<string>>")
    assert one.select(ordered_distinct(F.col("x")).alias("x")).first().x == ["b", "a", "c"]


def test_finite(spark):
    df = spark.createDataFrame([(1.5,), (None,), (-0.0,)], "v double")
    assert [r.v for r in df.select(finite(F.col("v")).alias("v")).collect()] == [1.5, None, 0.0]
    for bad in (float("nan"), float("inf"), float("-inf")):
        with pytest.raises(Exception, match="not finite"):
            spark.createDataFrame([(bad,)], "v double").select(finite(F.col("v")).alias("v")).collect()
