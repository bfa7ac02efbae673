"""Scalar text and label expressions, all evaluated inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as whitespace when a Unicode string is
# stripped or split. The regex class \s misses U+001C to U+001F.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Label numbers and their names.
LABEL_NAMES = {0: "irrelevant", 1: "partially", 2: "relevant"}

# (?U) lets \\s cover the Unicode spaces; a class that lists them is four times slower.
_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
_CONTROL = r"[\x00-\x1f\x7f]"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then(value)` with `value` evaluated once, however often `then` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def blank(c: Column) -> Column:
    """Whether only whitespace is in the text; looks no further than the first other character."""
    return ~c.rlike("[^" + WHITESPACE + "]")


def strip(c: Column) -> Column:
    """Trim every Unicode whitespace character from both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def split_words(c: Column) -> Column:
    """Split on runs of whitespace; the empty string gives an empty array."""
    return F.filter(F.split(strip(c), _SPACE_RUN), lambda w: w != "")


def to_bigint(c: Column) -> Column:
    """Integer text to BIGINT, null where the text is not an integer.

    A sign and single underscores between digits are allowed.
    """
    digits = F.when(c.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(c, F.lit("_"), F.lit("")))
    return digits.try_cast("bigint")


def clean_text(c: Column) -> Column:
    """Control characters to spaces, whitespace runs to one space, trimmed."""
    return strip(F.regexp_replace(F.regexp_replace(c, _CONTROL, " "), _SPACE_RUN, " "))


def score_from_label(label: Column) -> Column:
    return label.cast("double")


def label_name(label: Column) -> Column:
    """0, 1, 2 to the label's name; anything else to null."""
    out = F.lit(None).cast("string")
    for number, name in LABEL_NAMES.items():
        out = F.when(label == number, F.lit(name)).otherwise(out)
    return out


def label_id(name: Column) -> Column:
    """Label name (any case, padded) to 0, 1, 2; anything else to null."""
    key = F.lower(strip(name))
    out = F.lit(None).cast("int")
    for number, known in LABEL_NAMES.items():
        out = F.when(key == known, F.lit(number)).otherwise(out)
    return out


def sample_id(query_id: Column, docid: Column) -> Column:
    return F.concat_ws(":", query_id, docid)


def run_id(ts: Column, hint: Column) -> Column:
    """`yyyyMMdd_HHmmss_<hint>`; the hint keeps letters, digits, - and _, 30 at most."""
    safe = F.substring(F.regexp_replace(hint, r"[^\p{L}\p{N}_-]", ""), 1, 30)
    return F.concat_ws("_", F.date_format(ts, "yyyyMMdd_HHmmss"), safe)


def token_estimate(text: Column) -> Column:
    """Four characters per token, rounded up."""
    return F.ceil(F.length(text) / 4).cast("bigint")
