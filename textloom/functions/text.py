"""String functions with the whitespace and rounding rules of Python strings.

``F.trim`` strips only U+0020 and Java's ``\\s`` is ASCII, so every function here spells the
Unicode whitespace class out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the 29 code points Python treats as whitespace (the Unicode White_Space property
# plus the four ASCII separators), as a Java regex class.
WS_CLASS = r"[\p{IsWhite_Space}\x1c-\x1f]"
WS = WS_CLASS + "+"

# Fixed value: a token is two or more letters, digits or underscores.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column | str) -> Column:
    """Remove whitespace at both ends."""
    c = as_column(c)
    # Two anchored passes; the possessive tail keeps the scan linear on long inner runs.
    head = F.regexp_replace(c, "^" + WS_CLASS + "++", "")
    return F.regexp_replace(head, "(?<!" + WS_CLASS + ")" + WS_CLASS + "++\\z", "")


def squeeze(c: Column | str) -> Column:
    """Every whitespace run becomes one space."""
    return F.regexp_replace(as_column(c), WS, " ")


def words(c: Column | str) -> Column:
    """Split on whitespace; never yields an empty word."""
    return F.array_remove(F.split(as_column(c), WS), "")


def normalise_query(c: Column | str) -> Column:
    """Words of the query joined by single spaces."""
    return F.array_join(words(c), " ")


def is_blank(c: Column | str) -> Column:
    """True for null, empty and whitespace-only strings."""
    return F.coalesce(strip(c) == "", F.lit(True))


def contains_any(c: Column | str, markers: Sequence[str]) -> Column:
    """Whether the lower-cased string holds one of the markers as a plain substring."""
    lowered = F.lower(as_column(c))
    hit = F.lit(False)
    for marker in markers:
        hit = hit | F.contains(lowered, F.lit(marker))
    return hit


def tokens(c: Column | str) -> Column:
    """Lower-cased tokens of two or more word characters, in text order."""
    return F.regexp_extract_all(F.lower(as_column(c)), F.lit(TOKEN_PATTERN), F.lit(0))


def unigrams_and_bigrams(token_array: Column | str) -> Column:
    """The tokens followed by all adjacent pairs joined by one space."""

    def with_pairs(t: Column) -> Column:
        n_pairs = F.greatest(F.size(t) - 1, F.lit(0))
        pairs = F.zip_with(
            F.slice(t, F.lit(1), n_pairs),
            F.slice(t, F.lit(2), n_pairs),
            lambda a, b: F.concat(a, F.lit(" "), b),
        )
        return F.concat(t, pairs)

    return let(as_column(token_array), with_pairs)


def percent(c: Column | str, digits: int = 1) -> Column:
    """A share as a percentage, half-even rounded and without a thousands separator."""
    shown = F.format_number(as_column(c) * F.lit(100.0), digits)
    return F.concat(F.replace(shown, F.lit(","), F.lit("")), F.lit("%"))
