"""Half-open block intervals ``[start, start + len)``. Intervals that touch count as overlapping."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def end(start: Column | str, length: Column | str) -> Column:
    return _c(start) + _c(length)


def overlaps(a_start, a_len, b_start, b_len) -> Column:
    return (_c(a_start) <= end(b_start, b_len)) & (_c(b_start) <= end(a_start, a_len))


def merge(a_start, a_len, b_start, b_len) -> Column:
    """struct(start, len): the hull where the two overlap or touch, else a unchanged."""
    lo = F.least(_c(a_start), _c(b_start))
    hi = F.greatest(end(a_start, a_len), end(b_start, b_len))
    hull = F.struct(lo.alias("start"), (hi - lo).alias("len"))
    return F.when(overlaps(a_start, a_len, b_start, b_len), hull).otherwise(F.struct(_c(a_start).alias("start"), _c(a_len).alias("len")))


def equal(a_start, a_len, b_start, b_len) -> Column:
    return (_c(a_start) == _c(b_start)) & (_c(a_len) == _c(b_len))


def as_text(start, length) -> Column:
    return F.format_string("(%d, %d)", _c(start), _c(length))
