"""XML releases of code systems as adjacency rows, one file a task row.

Files come through Spark's ``binaryFile`` reader, so any path that Spark reads will do; each is parsed
in the task that holds it (a release is a handful of files of some MB).
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

NOTES = {"notes": "notes", "includes": "includes", "inclusionTerm": "inclusion_term", "excludes1": "excludes1", "excludes2": "excludes2", "useAdditionalCode": "use_additional_code", "codeFirst": "code_first", "codeAlso": "code_also"}
CODE_SCHEMA = "id string, parent_id string, kind string, name string, description string, assignable boolean, " + ", ".join(f"{c} array<string>" for c in NOTES.values()) + ", seventh array<struct<char:string,text:string>>"
TERM_SCHEMA = "id string, parent_id string, title string, code string, manifestation_code string, see string, see_also string, assignable boolean, optional_modifiers array<string>"
AXIS_SCHEMA = "table_no int, row_no int, declared int, pos int, title string, labels array<struct<code:string,label:string>>, fixed boolean"


def _text(el: ET.Element | None) -> str:
    return " ".join(" ".join(el.itertext()).split()) if el is not None else ""


def _notes(el: ET.Element) -> dict[str, list[str]]:
    return {col: [t for block in el.findall(tag) for n in block.findall("note") if (t := _text(n))] for tag, col in NOTES.items()}


def tabular_rows(data: bytes) -> Iterator[dict]:
    """Chapters, sections and codes of a diagnosis tabular; a code without codes below is assignable."""

    def codes(el: ET.Element, parent: str) -> Iterator[dict]:
        for diag in el.findall("diag"):
            name = _text(diag.find("name"))
            below = diag.findall("diag")
            seventh = [{"char": x.get("char", ""), "text": _text(x)} for x in diag.findall("sevenChrDef/extension")]
            yield {"id": name, "parent_id": parent, "kind": "code", "name": name, "description": _text(diag.find("desc")), "assignable": not below, **_notes(diag), "seventh": seventh}
            yield from codes(diag, name)

    for chapter in ET.fromstring(data).iter("chapter"):
        top = f"chapter {_text(chapter.find('name'))}"
        yield {"id": top, "parent_id": None, "kind": "chapter", "name": _text(chapter.find("name")), "description": _text(chapter.find("desc")), "assignable": False, **_notes(chapter), "seventh": []}
        for section in chapter.findall("section"):
            name = section.get("id", "")
            name = name if "-" in name else f"{name}-{name}"
            yield {"id": name, "parent_id": top, "kind": "category", "name": name, "description": _text(section.find("desc")), "assignable": False, **_notes(section), "seventh": []}
            yield from codes(section, name)


def index_rows(data: bytes) -> Iterator[dict]:
    """Terms of an alphabetic index: zero-padded main ids, dotted ids below, cells as id with X and column."""
    root = ET.fromstring(data)
    heads = {h.get("col", ""): _text(h) for h in root.iter("head")}

    def term(el: ET.Element, ident: str, parent: str | None) -> Iterator[dict]:
        title = el.find("title")
        optional = [_text(n).strip("() ") for n in title.findall("nemod")] if title is not None else []
        whole = _text(title)
        for n in title.findall("nemod") if title is not None else []:
            whole = whole.replace(_text(n), "")
        code = _text(el.find("code"))
        yield {
            "id": ident, "parent_id": parent, "title": " ".join(whole.split()), "code": code.rstrip("-.") or None, "manifestation_code": _text(el.find("manif")) or None,
            "see": _text(el.find("see")) or None, "see_also": _text(el.find("seeAlso")) or None, "assignable": bool(code) and "-" not in code, "optional_modifiers": optional,
        }
        for cell in el.findall("cell"):
            value = _text(cell)
            if value not in ("", "-"):
                col = cell.get("col", "")
                yield {"id": f"{ident}X{col}", "parent_id": ident, "title": heads.get(col, col), "code": value.rstrip("-."), "manifestation_code": None, "see": None, "see_also": None, "assignable": "-" not in value, "optional_modifiers": []}
        for i, sub in enumerate(el.findall("term")):
            yield from term(sub, f"{ident}.{i}", ident)

    for i, main in enumerate(root.iter("mainTerm")):
        yield from term(main, f"{i:05d}", None)


def axis_rows(data: bytes) -> Iterator[dict]:
    """Axes of procedure tables: the table's fixed axes and each row's own."""
    for t, tab in enumerate(ET.fromstring(data).iter("pcsTable")):
        for r, row in enumerate(tab.findall("pcsRow")):
            for fixed, axes in ((True, tab.findall("axis")), (False, row.findall("axis"))):
                for axis in axes:
                    labels = [{"code": x.get("code", ""), "label": _text(x)} for x in axis.findall("label")]
                    yield {"table_no": t, "row_no": r, "declared": int(row.get("codes", "0")), "pos": int(axis.get("pos", "0")), "title": _text(axis.find("title")), "labels": labels, "fixed": fixed}


def read_xml(spark: SparkSession, path: str, parse: Callable[[bytes], Iterator[dict]], ddl: str) -> DataFrame:
    kind = T.StructType.fromDDL(ddl)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                yield pa.RecordBatch.from_pylist(list(parse(content.as_py())), schema=arrow)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, kind)


def read_tabular(spark: SparkSession, path: str) -> DataFrame:
    return read_xml(spark, path, tabular_rows, CODE_SCHEMA)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return read_xml(spark, path, index_rows, TERM_SCHEMA)


def read_axes(spark: SparkSession, path: str) -> DataFrame:
    return read_xml(spark, path, axis_rows, AXIS_SCHEMA)
