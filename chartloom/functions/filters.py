"""Row filters from plain data, as a search request or a configuration states them.

A filter is a dictionary with one key: ``{"eq": {column: value}}``, ``{"in": {column: [values]}}``, ``{"range": {column: {"gte": a, "gt": a,
"lte": b, "lt": b}}}``, ``{"null": column}``, ``{"match": {column: regular expression}}``, ``{"and": [filters]}``, ``{"or": [filters]}`` or
``{"not": filter}``. An empty ``and`` holds for all rows, an empty ``or`` for none. What is unknown because a value is null does not hold,
nor does its negation hold for want of a value: ``not`` is true where the filter is false or unknown. Unknown names raise when the filter is built.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUNDS = {"gte": Column.__ge__, "gt": Column.__gt__, "lte": Column.__le__, "lt": Column.__lt__}


def _of_columns(spec: dict, test) -> Column:
    """All columns of a specification pass ``test``."""
    return reduce(and_, (test(F.col(c), v) for c, v in spec.items()), F.lit(True))


def _between(column: Column, bounds: dict) -> Column:
    if unknown := set(bounds) - set(BOUNDS):
        raise ValueError(f"no bounds {sorted(unknown)}")
    return reduce(and_, (BOUNDS[name](column, F.lit(v)) for name, v in bounds.items()), F.lit(True))


def payload_filter(spec: dict) -> Column:
    """The filter as a condition on columns; equality and range tests are plain comparisons, so they reach the scan."""
    if len(spec) != 1:
        raise ValueError(f"a filter has one key, not {sorted(spec)}")
    ((kind, value),) = spec.items()
    if kind in ("and", "or"):
        return reduce(and_ if kind == "and" else or_, map(payload_filter, value), F.lit(kind == "and"))
    if kind == "not":
        return ~F.coalesce(payload_filter(value), F.lit(False))
    if kind == "null":
        return F.col(value).isNull()
    tests = {"eq": lambda c, v: c == F.lit(v), "in": lambda c, v: c.isin(list(v)), "range": _between, "match": lambda c, v: c.rlike(v)}
    if kind not in tests:
        raise ValueError(f"no filter {kind!r}")
    return _of_columns(value, tests[kind])
