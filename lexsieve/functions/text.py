"""Row-level text functions. Each takes a column (or its name) and gives a column.

Null in, null out. Everything stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 32 ASCII punctuation characters, and the characters that
# count as white space in Unicode text (the ASCII ones, the four separators
# 0x1C-0x1F, NEL, and categories Zs, Zl, Zp), one by one and as a regex class.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACES = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)])
) + "\u2028\u2029\u202f\u205f\u3000"
SPACE = "[\\t-\\r\\x1C-\\x20\\x85\\p{Z}]"
ASCII_SPACE = " \t\n\x0b\f\r"


def to_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lower(c: Column | str) -> Column:
    """Lower-case text."""
    return F.lower(to_column(c))


def replace(c: Column | str, pattern: str, repl: str, literal: bool = False) -> Column:
    """Replace every match of a regex, or of a plain string with ``literal``."""
    if literal:
        return F.replace(to_column(c), F.lit(pattern), F.lit(repl))
    return F.regexp_replace(to_column(c), pattern, repl)


def strip_punct(c: Column | str) -> Column:
    """Delete ASCII punctuation."""
    return F.translate(to_column(c), PUNCTUATION, "")


def strip_non_ascii(c: Column | str) -> Column:
    """Delete every character beyond U+007F."""
    return F.regexp_replace(to_column(c), "[^\\x00-\\x7F]+", "")


def strip_digits(c: Column | str) -> Column:
    """Delete decimal digits of any script."""
    return F.regexp_replace(to_column(c), "\\p{Nd}+", "")


def strip_tags(c: Column | str) -> Column:
    """Delete ``<...>`` tags that open and close on one line; the text inside stays."""
    # A stretch that does not close is kept whole, so it is not searched again from each "<".
    return F.regexp_replace(to_column(c), "<[^>\\n]*+>|(<[^>\\n]*+)", "$1")


def words(c: Column | str) -> Column:
    """Non-empty pieces between Unicode white space."""
    return F.filter(F.split(to_column(c), SPACE + "+"), lambda w: w != "")


def extract_emails(c: Column | str) -> Column:
    """White-space separated pieces with an ``@`` that is neither first nor last.

    Testing whole pieces finds the same addresses as searching the text for
    ``\\S+@\\S+``, but without that regex's backtracking over long pieces. Text without
    any ``@`` is not split.
    """
    c = to_column(c)
    found = F.filter(F.split(c, SPACE + "+"), lambda w: w.like("_%@%_"))
    nothing = F.array().cast("array<string>")
    return F.when(c.contains("@"), found).when(c.isNotNull(), nothing)


def extract_urls(c: Column | str) -> Column:
    """All http and https addresses, in order.

    ``$-_`` is a range (0x24-0x5F) and so takes digits, capitals and most marks.
    """
    return F.regexp_extract_all(to_column(c), F.lit("(https?://[a-zA-Z!$-_]+)"), 1)


def avg_word_length(c: Column | str) -> Column:
    """Mean length of the words; null if there are none."""
    c = to_column(c)
    letters = F.length(F.regexp_replace(c, SPACE + "+", ""))
    count = F.size(F.split(F.btrim(c, F.lit(SPACES)), SPACE + "+"))
    return F.when(letters > 0, letters / count)


def word_count(c: Column | str) -> Column:
    """Pieces between single spaces: empty pieces count, so ``''`` has one."""
    return F.size(F.split(to_column(c), " ", -1)).cast("bigint")


def char_count(c: Column | str) -> Column:
    """Characters other than the space; tabs and line ends count."""
    return F.length(F.translate(to_column(c), " ", "")).cast("bigint")


def special_char_count(c: Column | str) -> Column:
    """Number of ASCII punctuation characters."""
    c = to_column(c)
    return (F.length(c) - F.length(strip_punct(c))).cast("bigint")
