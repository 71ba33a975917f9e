"""Column functions. Everything here stays in the JVM and inside generated code."""

from .arrays import in_order, ordered_distinct, upper_median
from .text import char_count, containment, finite, fold, has_han, lexical_words, norm, overlap_words, prefix_suffix, sha256, strip, word_count

__all__ = ["char_count", "containment", "finite", "fold", "has_han", "in_order", "lexical_words", "norm", "ordered_distinct", "overlap_words", "prefix_suffix", "sha256", "strip", "upper_median", "word_count"]
