"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Unicode calls white space, with the four separators that \\s leaves out.
BLANK = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{BLANK}+", ""), f"{BLANK}+$", "")


def snippet(text: Column, size: int = 200) -> Column:
    return F.substring(text, 1, size)


def basename(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def percent(score: Column) -> Column:
    """A whole percentage, half up; null unless the score is a finite number above zero."""
    usable = score.isNotNull() & ~F.isnan(score) & (score > 0) & (score < float("inf"))
    return F.when(usable, F.floor(score * 100 + 0.5))


def title(text: Column, size: int = 40) -> Column:
    """A stripped text cut to ``size`` code points, with an ellipsis where it was cut."""
    flat = strip(text)
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit("…"))).otherwise(flat)


def paragraphs(text: Column) -> Column:
    """Lines of every paragraph; two or more newlines part paragraphs, empty ones are dropped."""
    return F.transform(F.filter(F.split(text, "\n\n+", -1), lambda p: p != ""), lambda p: F.split(p, "\n", -1))
