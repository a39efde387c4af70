"""Filters and highlights as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowlens.functions.patterns import compile_filter
from rowlens.model import FilterSpec

#: Stands between fields when a literal is sought in all of them at once.
_BETWEEN = "\x1e"


def cell_matches(cell: Column, spec: FilterSpec, spark=None) -> Column:
    """Whether one cell matches; invert is not looked at."""
    if not spec.regex and spec.case_sensitive:
        return cell.contains(spec.query)
    return cell.rlike(compile_filter(spec, spark))


def any_matches(cells: Sequence[Column], spec: FilterSpec, spark=None, extra: Column | None = None) -> Column:
    """Whether any cell, or any of an array of further cells, matches.

    A literal that doesn't hold the separator can't match across it, so one
    search of the joined cells does for all of them. A regular expression may
    have anchors, so it is applied to each.
    """
    if not cells:
        found = F.lit(False)
    elif not spec.regex and not spec.case_sensitive and len(cells) > 1 and _BETWEEN not in spec.query:
        found = cell_matches(F.concat_ws(_BETWEEN, *cells), spec, spark)
    else:
        found = reduce(lambda a, b: a | b, (cell_matches(c, spec, spark) for c in cells))
    if extra is not None:
        found = found | F.coalesce(F.exists(extra, lambda c: cell_matches(c, spec, spark)), F.lit(False))
    return found


def row_filter(cells: Sequence[Column], spec: FilterSpec, spark=None, extra: Column | None = None) -> Column:
    found = any_matches(cells, spec, spark, extra)
    return ~found if spec.invert else found
