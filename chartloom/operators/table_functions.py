"""Segmenters as table functions for SQL: ``SELECT d.id, s.* FROM notes d, LATERAL segment_text(d.text, 'sentence') s``.

``register`` adds ``segment_text(text, kind)``, ``segment_pattern(text, pattern, least)`` and
``segment_window(text, size, overlap)``. They give seg_no from 1, text, start and end; null texts have no segments. What a
segmenter is made from must be constant; it is checked when the query is analysed.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import segments

SCHEMA = StructType().add("seg_no", IntegerType()).add("text", StringType()).add("start", IntegerType()).add("end", IntegerType())


def _constant(name: str, arg: AnalyzeArgument):
    if not arg.isConstantExpression:
        raise ValueError(f"{name} must be a constant")
    return arg.value


class _Segments:
    """One segmenter a query: made by the first row, from arguments that do not change."""

    def __init__(self):
        self.segment = None

    def rows(self, text: str | None, make, *settings):
        self.segment = self.segment or make(*settings)
        for no, (part, start, end) in enumerate(self.segment(text or ""), 1):
            yield no, part, start, end


class SegmentText(_Segments):
    @staticmethod
    def analyze(text: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
        try:
            segments.factory(_constant("kind", kind))
        except KeyError:
            raise ValueError(f"no segmenter {kind.value!r}") from None
        return AnalyzeResult(SCHEMA)

    def eval(self, text: str, kind: str):
        yield from self.rows(text, segments.factory, kind)


class SegmentPattern(_Segments):
    @staticmethod
    def analyze(text: AnalyzeArgument, pattern: AnalyzeArgument, least: AnalyzeArgument) -> AnalyzeResult:
        re.compile(_constant("pattern", pattern))
        if _constant("least", least) < 0:
            raise ValueError("least must not be negative")
        return AnalyzeResult(SCHEMA)

    def eval(self, text: str, pattern: str, least: int):
        yield from self.rows(text, segments.by_pattern, pattern, least)


class SegmentWindow(_Segments):
    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        segments.by_window(_constant("size", size), _constant("overlap", overlap))
        return AnalyzeResult(SCHEMA)

    def eval(self, text: str, size: int, overlap: int):
        yield from self.rows(text, segments.by_window, size, overlap)


def register(spark: SparkSession) -> None:
    for name, cls in (("segment_text", SegmentText), ("segment_pattern", SegmentPattern), ("segment_window", SegmentWindow)):
        spark.udtf.register(name, udtf(cls))
