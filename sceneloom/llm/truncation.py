"""Problem 7: texts cut off by a field limit or a broken transfer.

For each source, and for lengths in code points and in bytes, the discrete hazard of a length is the share of the texts
at least that long that end just there. Window functions give the number at risk and the hazard of the neighbouring
lengths; the hazard of a length (and of a band of lengths below it, since some cut at the last white space before the
limit) is tested against its neighbours with the Chernoff bound of the binomial tail, an upper bound of the p-value, and
lengths are significant at a false discovery rate over all tests of all sources (Benjamini-Hochberg).

A text is cut if its ending is incomplete and its length is a significant one of its source ("field limit"). An ending
is complete with a sentence's final mark and what may close behind it, a bracketed direction, a line of signs only, or a
closing line. Closing lines (sign-offs, headings, lists) are learned from the table by the same test: of all lines that
begin with the same one, two or three words, a share of at least ``closing_rate`` are last lines of texts without a final
mark at no significant length, and that share is significantly above the one of all other lines. No list of formulas is given,
and neither share depends on the size of the table. A mark of omission behind an unfinished sentence can be style, so
that such a text is cut only at a significant length; so is every copy of it in another source.

A broken transfer has no typical length: an incomplete ending without a mark of omission at no significant length is the
second result, "broken transfer". It rests on the closing lines learned, not on hazards, and is told apart everywhere.

Scale: texts are read twice, for their endings and for how their lines begin; they leave narrow rows. Counts by source
and length and by first words are aggregated before they are shuffled, the latter only for words that last lines begin
with; the step-up rule works on a bounded number of bins of p-values.

Defined results: null and blank texts aren't cut and are counted as documents in the rates; a null source is a source
of its own; copies are rows of their own; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise


@dataclass(frozen=True)
class Params:
    """reach: neighbouring lengths on each side; bands: widths of the bands tested; rate: false discovery rate; least:
    texts a significant length must have; closing_least, closing_rate: different texts that end on a line beginning with the
    same words, and their share of all lines beginning so, that make it a closing line; closing_words: words of a line's
    beginning at most."""

    reach: int = 25
    bands: tuple[int, ...] = (1, 12)
    rate: float = 0.01
    least: int = 5
    closing_least: int = 3
    closing_rate: float = 0.1
    closing_words: int = 3


UNITS = ("chars", "bytes")

# Characters without ink that may trail a text; marks of omission; what ends a sentence and what may follow.
_TRAILING = " \t\r\n\x0b\x0c\u0085\u00a0\u00ad\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u200c\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
_OMISSION = r"(?:…|\.\.\.|\[(?:…|\.\.\.)\])$"
_FINAL = r"[.!?…。！？][\s\x{a0}]*[\"'“”‘’»«›‹)\]）」』】]*$"
_DIRECTION = r"[(\[（][^()\[\]（）]*[)\]）]$"
_SIGNS = r"^[^\p{L}\p{N}]+$"


def _stripped(c: Column) -> Column:
    return F.rtrim(c, F.lit(_TRAILING))


def _trimmed(line: Column) -> Column:
    return _stripped(F.ltrim(line, F.lit(_TRAILING)))


def _beginnings(line: Column, p: Params) -> Column:
    """Hashes of the first word, the first two, ... of a line; empty for a blank one."""
    # a limited split looks at no more of the line than is needed; it may begin with an empty string
    w = F.slice(F.filter(F.split(line, r"\s+", p.closing_words + 2), lambda x: x != ""), 1, p.closing_words)
    return F.transform(w, lambda _, k: F.xxhash64(F.slice(w, 1, k + 1)))


def endings(df: DataFrame, p: Params) -> DataFrame:
    """doc_id, source, chars, bytes, ending (complete, bare, marked, null for blank), begins, key_a, key_b. begins: hashes of
    the beginnings of a bare last line; keys: of the text without regard to white space, where it isn't complete."""
    rows = df.select("doc_id", "source", "text").where("doc_id is not null")
    s = rows.withColumn("s", _stripped(F.col("text")))
    s = s.withColumn("marked", F.col("s").rlike(_OMISSION))
    s = s.withColumn("rest", F.when(F.col("marked"), _stripped(F.regexp_replace("s", _OMISSION, ""))).otherwise(F.col("s")))
    s = s.withColumn("line", _trimmed(F.substring_index(F.translate("rest", "\r", "\n"), "\n", -1)))
    line = F.col("line")
    whole = F.col("rest").rlike(_FINAL) | (~F.col("marked") & (line.rlike(_DIRECTION) | line.rlike(_SIGNS)))
    kind = F.when(F.coalesce(F.col("s"), F.lit("")) == "", None).when(whole | (F.col("rest") == ""), "complete").when(F.col("marked"), "marked").otherwise("bare")
    s = s.withColumn("ending", kind)
    clean = F.regexp_replace("text", r"\s+", " ")
    open_ = F.col("ending") != "complete"
    return s.select(
        "doc_id", "source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), "ending",
        F.when(F.col("ending") == "bare", _beginnings(line, p)).alias("begins"), F.when(open_, F.xxhash64(clean)).alias("key_a"), F.when(open_, F.xxhash64(F.lit(1), clean)).alias("key_b"),
    )


def _ln_p(hazard: Column, n: Column, expected: Column) -> Column:
    """Logarithm of the Chernoff bound for a share of ``n`` above the expected one; 0 where it isn't above."""
    a, h = hazard, expected
    rest = F.when(a < 1, (1 - a) * F.ln((1 - a) / (1 - h))).otherwise(F.lit(0.0))
    return F.when(a > h, -n * (a * F.ln(a / h) + rest)).otherwise(F.lit(0.0))


def _step_up(tests: DataFrame, name: str, rate: float) -> DataFrame:
    """The tests (with ln_p) that are significant at a false discovery rate. The rule goes by bins of a hundredth of a power
    of ten, at most 32,001 of them; a bin counts as its largest p-value."""
    tests = materialise(tests.withColumn("bin", F.least(F.lit(32_000), F.floor(-43.4294 * F.col("ln_p"))).cast("int")), name)
    bins = tests.groupBy("bin").agg(F.count(F.lit(1)).alias("m"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = bins.select("bin", F.sum("m").over(Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)).alias("k"), F.sum("m").over(every).alias("m"))
    cut = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / 100) <= rate * F.col("k") / F.col("m")).agg(F.min("bin").alias("bin")).first()["bin"]
    return tests.where(F.col("bin") >= (32_001 if cut is None else cut)).drop("bin")


def _tests(rows: DataFrame, p: Params, bands: tuple[int, ...]) -> DataFrame:
    """source, unit, length, band, texts, at_risk, hazard, neighbours, ln_p of the significant lengths (band: and those
    just below) among all lengths that occur in doc_id, source, chars, bytes."""
    lengths = F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).cast("bigint").alias("length")) for u in UNITS])
    n = rows.select("source", F.explode(lengths).alias("x")).groupBy("source", "x.unit", "x.length").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("source", "unit").orderBy("length")
    tests = None
    for band in bands:
        inside = F.sum("n").over(by.rangeBetween(-(band - 1), 0))
        risk = F.sum("n").over(by.rangeBetween(-(band - 1), Window.unboundedFollowing))
        below = F.coalesce(F.sum("n").over(by.rangeBetween(-(band - 1) - p.reach, -band)), F.lit(0))
        above = F.coalesce(F.sum("n").over(by.rangeBetween(1, p.reach)), F.lit(0))
        x = n.select("source", "unit", "length", F.lit(band).alias("band"), inside.alias("texts"), risk.alias("at_risk"), below.alias("below"), above.alias("above"))
        tests = x if tests is None else tests.union(x)
    # texts times lengths at risk around the band; a pseudo-text keeps the neighbours' hazard above zero
    exposure = p.reach * (2 * F.col("at_risk") - F.col("texts") + (F.col("below") - F.col("above")) / 2)
    tests = tests.withColumn("hazard", F.col("texts") / F.col("at_risk"))
    tests = tests.withColumn("neighbours", F.least(F.lit(0.999), (F.col("below") + F.col("above") + 1) / F.greatest(exposure, F.lit(1.0)) * F.col("band")))
    tests = tests.withColumn("ln_p", _ln_p(F.col("hazard"), F.col("at_risk"), F.col("neighbours")))
    return _step_up(tests, "p7-tests", p.rate).where(F.col("texts") >= p.least).drop("below", "above")


def _attributed(rows: DataFrame, tests: DataFrame, p: Params) -> DataFrame:
    """doc_id and the significant length that tells most of it: one limit shows in both units and in many bands, and all
    but one of them fall away here for want of texts of their own."""
    at = tests.select("source", "unit", F.col("length").alias("limit"), "band", "texts", "at_risk", "hazard", "neighbours", "ln_p", F.explode(F.sequence(F.col("length") - F.col("band") + 1, F.col("length"))).alias("length"))
    key = [F.coalesce(F.col("source"), F.lit("")).alias("src"), F.col("source").isNull().alias("none")]
    lengths = F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).cast("bigint").alias("length")) for u in UNITS])
    texts = rows.select("doc_id", *key, F.explode(lengths).alias("x")).select("doc_id", "src", "none", "x.unit", "x.length")
    what = F.struct("unit", "limit", "band", "texts", "at_risk", "hazard", "neighbours", "ln_p")
    best = texts.join(at.select(*key, "unit", "length", what.alias("what")), ["src", "none", "unit", "length"]).groupBy("doc_id").agg(F.min_by("what", F.struct("what.ln_p", "what.band", "what.limit", F.col("what.unit") != "chars")).alias("what"))
    best = materialise(best.join(rows.select("doc_id", "source"), "doc_id"), "p7-attributed")
    own = best.select("source", *[F.col(f"what.{c}").alias(c) for c in ("unit", "limit", "band")], "doc_id", "what")
    kept = own.groupBy(F.col("source").alias("s"), F.col("unit").alias("u"), F.col("limit").alias("l"), F.col("band").alias("b")).agg(F.count(F.lit(1)).alias("own")).where(F.col("own") >= p.least)
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("unit") == F.col("u")) & (F.col("limit") == F.col("l")) & (F.col("band") == F.col("b"))
    return own.join(kept, same).select("doc_id", "source", "what.*", "own")


def at_limits(rows: DataFrame, p: Params) -> DataFrame:
    """doc_id, source, unit, limit, band, texts, at_risk, hazard, neighbours, ln_p, own: the texts whose length is a
    significant one of their source. Single lengths come first; bands are tested on the texts these leave."""
    rows = rows.where("ending is not null").select("doc_id", "source", "chars", "bytes")
    single = materialise(_attributed(rows, _tests(rows, p, (1,)), p), "p7-single")
    rest = rows.join(single.select("doc_id"), "doc_id", "left_anti")
    wide = tuple(b for b in p.bands if b > 1)
    return single.union(_attributed(rest, _tests(rest, p, wide), p)) if wide else single


def closings(df: DataFrame, rows: DataFrame, limit: DataFrame, p: Params) -> DataFrame:
    """begin, final, inner, ln_p: beginnings (as hashes) of closing lines; the texts that end on such a line, and the other
    lines beginning so. rows: endings of df; limit: doc_id of texts at a significant length, which are no evidence."""
    free = rows.where("begins is not null").join(limit.select("doc_id"), "doc_id", "left_anti")
    final = free.select(F.explode("begins").alias("begin"), "key_a", "key_b").groupBy("begin").agg(F.count_distinct("key_a", "key_b").alias("final")).where(F.col("final") >= p.closing_least)
    final = materialise(final, "p7-final")
    lines = df.where("doc_id is not null and text is not null").select(F.filter(F.split("text", r"[\r\n]+"), lambda x: F.trim(x) != "").alias("x"))
    inner = lines.where(F.size("x") > 1).select(F.explode(F.slice("x", 1, F.size("x") - 1)).alias("x")).select(F.explode(_beginnings(F.col("x"), p)).alias("begin"))
    inner = inner.join(final.select("begin"), "begin", "left_semi").groupBy("begin").agg(F.count(F.lit(1)).alias("inner"))
    share = F.col("final") / (F.col("final") + F.col("inner"))
    tests = materialise(final.join(inner, "begin", "left").select("begin", "final", F.coalesce("inner", F.lit(0)).alias("inner")).where(share >= p.closing_rate), "p7-begins")
    n = lines.agg(F.coalesce(F.sum(F.size("x")), F.lit(0)).alias("n")).first()["n"]
    # what is usual is told by the texts that end on none of these lines
    other = free.count() - free.select("doc_id", F.explode("begins").alias("begin")).join(tests.select("begin"), "begin", "left_semi").agg(F.count_distinct("doc_id").alias("n")).first()["n"]
    tests = tests.withColumn("ln_p", _ln_p(share, F.col("final") + F.col("inner"), F.lit((other + 1) / (n + 2))))
    return _step_up(tests, "p7-closings", p.rate)


def judged(df: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, source, ending, cut, reason (field limit, broken transfer; null if not cut)."""
    rows = materialise(endings(df, p), "p7-endings")
    limit = materialise(at_limits(rows, p).select("doc_id", F.lit(True).alias("limit")), "p7-limits")
    bare = rows.where("begins is not null").select("doc_id", F.explode("begins").alias("begin"))
    closed = bare.join(closings(df, rows, limit, p).select("begin"), "begin", "left_semi").select("doc_id", F.lit(True).alias("closing")).distinct()
    open_ = rows.where("ending in ('bare', 'marked')").join(limit, "doc_id", "left").join(closed, "doc_id", "left")
    open_ = materialise(open_.select("doc_id", "ending", "key_a", "key_b", F.coalesce("limit", F.lit(False)).alias("limit"), F.coalesce("closing", F.lit(False)).alias("closing")), "p7-open")
    copied = open_.where("ending = 'marked' and limit").select("key_a", "key_b", F.lit(True).alias("copied")).distinct()
    open_ = open_.join(copied, ["key_a", "key_b"], "left")
    limited = F.col("limit") | F.coalesce("copied", F.lit(False))
    reason = F.when(~F.col("closing") & limited, "field limit").when(~F.col("closing") & (F.col("ending") == "bare"), "broken transfer")
    open_ = open_.select("doc_id", reason.alias("reason"))
    return rows.select("doc_id", "source", "ending").join(open_, "doc_id", "left").select("doc_id", "source", "ending", F.col("reason").isNotNull().alias("cut"), "reason")


def found(df: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id of the cut texts."""
    return judged(df, p).where("cut").select("doc_id")


def reasons(df: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, source, ending, reason of the cut texts."""
    return judged(df, p).where("cut").select("doc_id", "source", "ending", "reason")


def rates(df: DataFrame, p: Params = Params()) -> DataFrame:
    """source, documents, cut, at_limit, broken, rate."""
    n = F.count(F.lit(1))
    return judged(df, p).groupBy("source").agg(n.alias("documents"), F.count_if("cut").alias("cut"), F.count_if(F.col("reason") == "field limit").alias("at_limit"), F.count_if(F.col("reason") == "broken transfer").alias("broken"), (F.count_if("cut") / n).alias("rate"))


def limits(df: DataFrame, p: Params = Params()) -> DataFrame:
    """source, unit, length, band, texts, at_risk, hazard, neighbours, ln_p: the significant lengths of every source;
    ``texts`` that end there and at no more telling length. Hazards to six decimals, logarithms to three."""
    found = at_limits(materialise(endings(df, p), "p7-endings"), p)
    return found.select("source", "unit", F.col("limit").alias("length"), "band", F.col("own").alias("texts"), "at_risk", F.round("hazard", 6).alias("hazard"), F.round("neighbours", 6).alias("neighbours"), F.round("ln_p", 3).alias("ln_p")).distinct()
