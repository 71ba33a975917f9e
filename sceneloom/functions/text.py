"""Text normal forms, counts, hashes and patterns as column expressions.

Null in, null out, everywhere. Java's own ``\\s`` and ``trim`` know other white space than the results call for, so the
class is spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space by Unicode as string splitting sees it, in a regular expression's class.
SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# A word with inner apostrophes, or a number; a run of word characters; Han characters; style requests.
LEXICAL = r"[\p{L}\p{Nl}\p{No}]+(?:['’][\p{L}\p{Nl}\p{No}]+)*|\p{Nd}+"
OVERLAP = r"[\p{L}\p{N}_]+"
HAN = r"[\x{3400}-\x{9fff}]"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def norm(c: Column) -> Column:
    """Runs of tab, CR, LF and space become one space; then stripped of all white space."""
    return strip(F.regexp_replace(c, r"[\t\r\n ]+", " "))


def fold(c: Column) -> Column:
    """Case folded: lower case, ß as ss."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def word_count(c: Column) -> Column:
    """Number of runs of anything but white space."""
    return F.regexp_count(c, F.lit(f"[^{SPACE}]+"))


def char_count(c: Column) -> Column:
    """Number of code points."""
    return F.length(c)


def sha256(c: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the UTF-8 bytes."""
    return F.sha2(c, 256)


def lexical_words(c: Column) -> Column:
    """Folded words, with inner apostrophes, and numbers."""
    return F.regexp_extract_all(fold(c), F.lit(LEXICAL), F.lit(0))


def overlap_words(c: Column) -> Column:
    """Folded runs of letters, digits and underscores."""
    return F.regexp_extract_all(fold(c), F.lit(OVERLAP), F.lit(0))


def has_han(c: Column) -> Column:
    """Whether a Han character occurs."""
    return c.rlike(HAN)


def containment(text: Column, *parts: Column) -> Column:
    """Whether any of the parts stands in the text; null parts don't."""
    hits = [F.coalesce(F.contains(text, p), F.lit(False)) for p in parts]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return F.when(text.isNotNull(), out)


def prefix_suffix(c: Column, separator: str = "\n\n") -> tuple[Column, Column]:
    """What stands before and after the first separator; the suffix is null where there is none."""
    at = F.instr(c, F.lit(separator))
    return F.when(at > 0, F.substring_index(c, separator, 1)).otherwise(c), F.when(at > 0, F.substr(c, at + len(separator)))


def finite(c: Column) -> Column:
    """The number as it is; NaN and the infinities are an error, null stays null."""
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.raise_error(F.lit("number is not finite"))).otherwise(c)
