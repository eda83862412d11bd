"""Column functions on strings. All are native expressions; none needs Python workers."""

from pyspark.sql import Column, functions as F

from .constants import DIGIT_CLASS, WHITESPACE

_WS_RUN = "[" + "".join(rf"\x{{{ord(c):x}}}" for c in WHITESPACE) + "]{2,}"


def bigint(col: Column) -> Column:
    return col.cast("bigint")


def strip(col: Column) -> Column:
    """Remove Unicode white space at both ends (`trim` alone removes only blanks)."""
    return F.btrim(col, F.lit(WHITESPACE))


def collapse_whitespace(col: Column) -> Column:
    """Runs of two or more white-space characters become one blank; single ones stay."""
    return F.regexp_replace(col, _WS_RUN, " ")


def count_char(col: Column, char: str) -> Column:
    """Occurrences of an ASCII character; in bytes, which need no walk over the text."""
    return bigint(F.octet_length(col) - F.octet_length(F.replace(col, F.lit(char), F.lit(""))))


def count_digits(col: Column) -> Column:
    return bigint(F.length(col) - F.length(F.regexp_replace(col, DIGIT_CLASS + "+", "")))


def count_special(col: Column) -> Column:
    """Characters outside a-z, A-Z, 0-9; one per code point.

    What is left after removing the others: `regexp_count` would build an array of matches.
    """
    return bigint(F.length(F.regexp_replace(col, "[a-zA-Z0-9]+", "")))


def count_labels(col: Column) -> Column:
    """Non-empty labels between dots."""
    marked = F.regexp_replace(col, "[^.]+", "x")
    return bigint(F.length(F.replace(marked, F.lit("."), F.lit(""))))


def count_words_present(col: Column, words) -> Column:
    """How many of `words` occur at least once in the lower-cased text."""
    low = F.lower(col)
    total = F.lit(0)
    for word in words:
        total = total + F.contains(low, F.lit(word)).cast("int")
    return bigint(total)


def shannon_entropy(col: Column) -> Column:
    """Entropy in bits of the character distribution; 0.0 for an empty string."""
    size = F.length(col).cast("double")

    def term(char):
        p = (F.length(col) - F.length(F.replace(col, char, F.lit("")))) / size
        return p * F.log2(p)

    chars = F.array_distinct(F.split(col, ""))
    entropy = F.aggregate(chars, F.lit(0.0), lambda acc, char: acc - term(char))
    return F.when(F.length(col) > 0, entropy).otherwise(F.lit(0.0))
