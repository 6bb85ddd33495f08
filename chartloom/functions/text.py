"""Text columns: spans, ids in names, clean-up, prompts, formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract_or_null(text: Column, pattern: str, group: int = 1) -> Column:
    """``regexp_extract`` that gives null, not an empty string, without a match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def slice_inclusive(text: Column, start: Column, end: Column) -> Column:
    """Characters start..end, both included, counted from 0."""
    return F.substring(text, start + 1, end - start + 1)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open intervals meet."""
    return (a_start < b_end) & (b_start < a_end)


def trim_span(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Shrink an inclusive span by one where its first or last character is punctuation or blank."""
    edge = r"[\p{Punct}\s]"
    at = lambda i: F.substring(text, i + 1, F.lit(1))
    return F.when(at(start).rlike(edge), start + 1).otherwise(start), F.when(at(end).rlike(edge), end - 1).otherwise(end)


def evidence_text(text: Column, spans: Column) -> Column:
    """Inclusive slices of (start, end) spans, joined by blanks."""
    return F.array_join(F.transform(spans, lambda s: slice_inclusive(text, s["start"].cast("int"), s["end"].cast("int"))), " ")


def find_span(text: Column, piece: Column) -> Column:
    """0-based first occurrence, -1 if there is none."""
    return F.position(piece, text) - 1


def location_bounds(location: Column) -> tuple[Column, Column]:
    """(least start, largest end) of ``a b;c d``."""
    numbers = F.transform(F.split(location, "[; ]+"), lambda x: x.cast("int"))
    return F.array_min(numbers), F.array_max(numbers)


def literal_list(text: Column) -> Column:
    """A Python list literal of strings as an array; nothing is evaluated."""
    return F.from_json(F.regexp_replace(text, r"'", '"'), "array<string>")


def literal_map(text: Column) -> Column:
    return F.from_json(F.regexp_replace(text, r"'", '"'), "map<string,string>")


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9_\-.]", "-")


def printable_json(value: Column) -> Column:
    return F.to_json(F.struct(F.regexp_replace(value, r"[^\x20-\x7E]", " ").alias("v")))


def human_number(x: Column) -> Column:
    scaled = F.when(F.abs(x) >= 1e9, F.format_string("%.2fB", x / 1e9)).when(F.abs(x) >= 1e6, F.format_string("%.2fM", x / 1e6))
    return scaled.when(F.abs(x) >= 1e3, F.format_string("%.2fK", x / 1e3)).otherwise(F.format_string("%.2f", x.cast("double")))


def human_bytes(x: Column, largest: str = "GB") -> Column:
    """Bytes in the greatest unit that they reach, ``largest`` (KB, MB or GB) at most."""
    units = ("KB", "MB", "GB")
    out = F.format_string("%d B", x.cast("long"))
    for i, unit in enumerate(units[: units.index(largest) + 1], 1):
        out = F.when(x >= 2 ** (10 * i), F.format_string(f"%.2f {unit}", x / 2.0 ** (10 * i))).otherwise(out)
    return out


def string_seed(text: Column) -> Column:
    """A stable number below 2**32 from a string."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def instruct(task: str, query: Column) -> Column:
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), query)


def render(template: str, **columns: Column) -> Column:
    """Fill ``{{ name }}`` places of a template; unknown names raise."""
    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    missing = set(parts[1::2]) - columns.keys()
    if missing:
        raise KeyError(f"no value for {sorted(missing)}")
    return F.concat(*(F.lit(p) if i % 2 == 0 else F.coalesce(columns[p].cast("string"), F.lit("")) for i, p in enumerate(parts)))


def template_names(template: str) -> list[str]:
    return sorted(set(re.findall(r"\{\{\s*(\w+)\s*\}\}", template)))


def numbered_list(items: Column, start: int = 1) -> Column:
    """``1. a`` lines for prompts."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + start).cast("string"), F.lit(". "), x)), "\n")
