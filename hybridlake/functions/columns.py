"""Scalar helpers: every one is a built-in column expression, so plans stay inside the JVM."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

from hybridlake.schemas import NA_TOKENS

# White space as Python strings define it.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_SPACE_RUN = f"[{WHITE_SPACE}]+"
_NOT_A_WORD = r"[^\p{L}\p{N}]+"


def fill(template: str, **parts: Column) -> Column:
    """Fill a ``{name}`` template with columns, as one ``concat``."""
    out = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            out.append(F.lit(literal))
        if name is not None:
            out.append(parts[name])
    return F.concat(*out)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression used inside a lambda is otherwise computed again for every element, also when it
    was a column of its own before the optimizer merged two projections.
    """
    return F.get(F.transform(F.array(value), body), 0)


def strip(text: Column) -> Column:
    """Strip all Unicode white space (``trim`` removes only the blank)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def words(text: Column) -> Column:
    """Split on white space, without empty tokens."""
    return F.array_remove(F.split(text, _SPACE_RUN), "")


def terms(text: Column) -> Column:
    """Lower-case letter and digit runs: the tokens of text search."""
    return F.array_remove(F.split(F.lower(text), _NOT_A_WORD), "")


def missing_to_null(text: Column) -> Column:
    """NA tokens become NULL."""
    return F.when(~text.isin(NA_TOKENS), text)


def to_year(text: Column) -> Column:
    """``2021`` and ``2021.0`` both become 2021; anything else NULL."""
    return text.try_cast("double").try_cast("int")


def money(value: Column) -> Column:
    """``$1,234.50``"""
    return F.concat(F.lit("$"), F.format_number(value.cast("double"), 2))


def percent(value: Column) -> Column:
    """``12.34%`` from a fraction, without thousands separators."""
    shown = F.format_number(value.cast("double") * F.lit(100.0), 2)
    return F.concat(F.replace(shown, F.lit(","), F.lit("")), F.lit("%"))


def mean(total: Column, count: Column) -> Column:
    """Mean from an exact decimal sum: the same double whatever the partitioning."""
    return F.when(count > 0, total.cast("double") / count)


def or_nan(text: Column) -> Column:
    """A missing field prints as ``nan``."""
    return F.coalesce(text.cast("string"), F.lit("nan"))


def slug(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit("_"))


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    """True when the text holds one of the needles."""
    found = F.lit(False)
    for needle in needles:
        found = found | text.contains(needle)
    return found


def first_contained(text: Column, vocabulary: Iterable[str]) -> Column:
    """The first vocabulary entry whose lower-case form the (lower-case) text holds, else NULL."""
    return F.coalesce(*[F.when(text.contains(v.lower()), F.lit(v)) for v in vocabulary])


def first_match(text: Column, pattern: str) -> Column:
    """Group 1 of the first match, else NULL."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def missing_keywords(text: Column, keywords: Column) -> Column:
    """The keywords that the text does not hold, ignoring case."""
    return let(F.lower(text), lambda t: F.filter(keywords, lambda k: ~F.contains(t, F.lower(k))))
