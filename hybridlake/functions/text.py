"""Text cleaning, file classification and overlapping word windows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hybridlake.functions.columns import contains_any, let, strip, words
from hybridlake.schemas import CHUNK_OVERLAP, CHUNK_WORDS, MIN_CHUNK_CHARS

# File name parts of each document class; the first class that matches wins.
SOURCE_TYPE_PARTS = {
    "presentation": ["presentation", "ppt", "slide"],
    "irs_form": ["1040", "form", "instruction"],
    "tax_law": ["usc", "statute", "law"],
}
OTHER_SOURCE_TYPE = "financial_report"


def clean(text: Column) -> Column:
    """Form feeds and carriage returns to line feeds, long gaps shortened, edges stripped."""
    # The replacements, in order.
    for old in ["\f", "\r\n", "\r"]:
        text = F.replace(text, F.lit(old), F.lit("\n"))
    for pattern, new in [(r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")]:
        text = F.regexp_replace(text, pattern, new)
    return strip(text)


def source_type(filename: Column) -> Column:
    name = F.lower(filename)
    branches = [F.when(contains_any(name, parts), F.lit(label)) for label, parts in SOURCE_TYPE_PARTS.items()]
    return F.coalesce(*branches, F.lit(OTHER_SOURCE_TYPE))


def window_step(size: int, overlap: int) -> int:
    if size < 1 or overlap < 0 or overlap >= size:
        raise ValueError(f"need 0 <= overlap < size, got size={size}, overlap={overlap}")
    return size - overlap


def word_span(words: Column, first: Column, last: Column) -> Column:
    """Words ``first..last`` (0-based, inclusive) as text; linear in the span, not in the array."""
    return F.array_join(F.transform(F.sequence(first, last), lambda i: F.get(words, i)), " ")


def word_windows(text: Column, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Overlapping word windows of a text, short ones dropped."""
    step = window_step(size, overlap)

    def windows(w: Column) -> Column:
        n = F.size(w)
        starts = F.sequence(F.lit(0), F.floor((n - 1) / F.lit(step)).cast("int"))
        spans = F.transform(starts, lambda i: word_span(w, i * step, F.least(i * step + size, n) - 1))
        kept = F.filter(spans, lambda c: F.length(c) > MIN_CHUNK_CHARS)
        return F.when(n > 0, kept).otherwise(F.array().cast("array<string>"))

    return let(words(text), windows)
