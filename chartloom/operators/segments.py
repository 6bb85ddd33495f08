"""Text segmenters: windows as expressions; separators with carried state as Arrow table functions.

A segment is (seg_no, text, start, end): its text is stripped, its offsets are of the unstripped part.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import map_arrow

#: Segments that a task holds before it hands them on.
SEGMENT_ROWS = 4096

Segment = tuple[str, int, int]
Segmenter = Callable[[str], Iterator[Segment]]

SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9])")
TITLE, TITLE_CHARS = re.compile(r"\b(?:Dr|Mr|Mrs|Ms|Prof|St)\.$"), 8
# The patterns that say what a header, a title with a name, an end and a labelled block of a note are.
MARKDOWN_HEADER = re.compile(r"^(\s*#+)\s*+[a-zA-Z0-9\-'\"_\* ]{1,32}:?\s*$")
COLON_HEADER = re.compile(r"^[a-zA-Z0-9\-'\"_\* ]{1,32}:\s*$")
NAMED = re.compile(r"\b([A-Z][a-z]+)\.\s([A-Z][a-zA-Z]*)\b")
NOTE_END = re.compile(r"(?<=[.!?])\s+|\r\n|\n")
BLOCK = re.compile(r"(\b[A-Z]{1,}\b:)([\s\S]*?)(?=\r\n[A-Z]{1,}\b:|\Z)", re.DOTALL)
BULLET = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+", re.M)


def by_window(size: int, overlap: int) -> Segmenter:
    """Windows of ``size`` characters, each starting ``size - overlap`` after the one before; blanks at their ends go, blank ones too."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")

    def segment(text: str) -> Iterator[Segment]:
        for start in range(0, len(text), size - overlap):
            part = text[start : start + size].strip(" ")
            if part:
                yield part, start, min(start + size, len(text))

    return segment


def windows(text: Column, size: int, overlap: int) -> Column:
    """Array of (text, start, end) of ``by_window``, cut in one Arrow pass; null texts have none."""
    cut = by_window(size, overlap)
    kind = pa.list_(pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def parts(texts: pa.Array) -> pa.Array:
        rows = [list(cut(t or "")) for t in texts.to_pylist()]
        return pa.array([[{"text": p, "start": s, "end": e} for p, s, e in row] for row in rows], kind)

    # not made again by a filter on the windows
    return F.arrow_udf(parts, "array<struct<text:string,start:int,end:int>>").asNondeterministic()(text)


def document(text: str) -> Iterator[Segment]:
    if text.strip():
        yield text.strip(), 0, len(text)


def by_pattern(pattern: str | re.Pattern, least: int = 1) -> Segmenter:
    """Cut at the starts of matches; parts under ``least`` characters join what follows."""
    cut = re.compile(pattern)

    def segment(text: str) -> Iterator[Segment]:
        start = 0
        for place in sorted({m.start() for m in cut.finditer(text)} | {len(text)}):
            part = text[start:place]
            if len(part.strip()) >= least:
                yield part.strip(), start, place
                start = place

    return segment


def sentences(least: int = 6) -> Segmenter:
    """Cut after sentence ends (not after titles), before bullets; the last part must be longer than ``least``."""

    def segment(text: str) -> Iterator[Segment]:
        places = {m.end() for m in SENTENCE_END.finditer(text) if not TITLE.search(text, max(0, m.start() - TITLE_CHARS), m.start())} | {m.start() for m in BULLET.finditer(text)}
        start = 0
        for place in [*sorted(places), len(text)]:
            part = text[start:place].strip()
            if len(part) >= least + (place == len(text)):
                yield part, start, place
                start = place

    return segment


def is_header(text: str) -> bool:
    """A Markdown header, or a short line that ends in a colon."""
    return bool(MARKDOWN_HEADER.match(text) or COLON_HEADER.match(text))


def note_sentences(least: int = 6) -> Segmenter:
    """Sentences and lines of a patient note; labelled blocks (``XX: ...``, up to a line that begins another)
    are cut at each end once their whole text is read, names after a title are not split.

    Short parts join what follows; the last part must be longer than ``least``.
    """

    def segment(text: str) -> Iterator[Segment]:
        blocks = [m.span() for m in BLOCK.finditer(text)]
        starts, names = [s for s, _ in blocks], [m.span() for m in NAMED.finditer(text)]
        start, n = 0, 0
        for place in sorted({m.start() for m in NOTE_END.finditer(text)}):
            while n < len(names) and names[n][1] < place:
                n += 1
            named = n < len(names) and names[n][0] <= place
            part = text[start:place].strip()
            here = bisect_right(starts, place) - 1
            whole = False
            if here >= 0 and place <= blocks[here][1]:  # inside a block, or at its end
                left = start + len(text[start:place]) - len(text[start:place].lstrip())
                first = bisect_left(starts, left)
                whole = first < len(blocks) and blocks[first][1] <= left + len(part)
            if whole or (not named and len(part) >= least):
                yield part, start, place
                start = place
        part = text[start:].strip()
        if len(part) > least:
            yield part, start, len(text)

    return segment


def gate(test: Callable[[str], bool], inner: Segmenter) -> Segmenter:
    """``inner`` where the test holds, else the text as it is."""
    return lambda text: inner(text) if test(text) else document(text)


def stripped(chars: str = " \t\r\n-*•") -> Segmenter:
    def segment(text: str) -> Iterator[Segment]:
        left = len(text) - len(text.lstrip(chars))
        body = text.strip(chars)
        if body:
            yield body, left, left + len(body)

    return segment


def chain(*steps: Segmenter) -> Segmenter:
    """Each step cuts what the one before gave; offsets stay those of the whole text."""

    def segment(text: str) -> Iterator[Segment]:
        parts = [(text, 0, len(text))]
        for step in steps:
            parts = [(t, a + s, a + e) for _, a, b in parts for t, s, e in step(text[a:b])]
        yield from parts

    return segment


def factory(kind: str) -> Segmenter:
    """document, sentence, or raw_ variants that first cut at blank lines and rules."""
    base = {"document": document, "sentence": sentences(), "nbme": note_sentences()}[kind.removeprefix("raw_")]
    first = by_pattern(r"\n\s*\n|\n-{3,}") if kind.startswith("raw_") else stripped()
    long = gate(lambda t: len(t) > 120, by_pattern(r"[,;]\s"))
    return chain(first, base, stripped(), long)


def segment_table(df: DataFrame, id_col: str, text_col: str, segmenter: Segmenter) -> DataFrame:
    """id, seg_no from 1, text, start, end; null texts have no segments."""
    schema = T.StructType([df.schema[id_col], T.StructField("seg_no", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])

    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32()]

    def part_of(batch, rows, out):
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=schema.fieldNames())

    def run(batches):
        for batch in batches:
            rows, out = [], []
            for i in range(batch.num_rows):
                for no, (part, start, end) in enumerate(segmenter(batch.column(1)[i].as_py() or ""), 1):
                    rows.append(i)
                    out.append((no, part, start, end))
                    if len(out) == SEGMENT_ROWS:
                        yield part_of(batch, rows, out)
                        rows, out = [], []
            yield part_of(batch, rows, out)

    return map_arrow(df.select(id_col, text_col), run, schema)
