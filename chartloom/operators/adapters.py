"""Schema dispatch: the first adapter whose columns a frame has turns it into examples."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lists import clean_codes, null_safe_union


@dataclass(frozen=True)
class Adapter:
    name: str
    needs: frozenset[str]
    translate: Callable[[DataFrame], DataFrame]

    def can_handle(self, df: DataFrame) -> bool:
        return self.needs <= set(df.columns)


@dataclass(frozen=True)
class DatasetConfig:
    name: str
    path: str = ""
    subset: str | None = None
    size: int | None = None
    seed: int = 0
    options: dict = field(default_factory=dict)

    def fingerprint(self) -> str:
        return sha256(repr(sorted(asdict(self).items())).encode()).hexdigest()


def _annotated(df: DataFrame) -> DataFrame:
    """Targets in first-occurrence order, spans by code."""
    return df.select(
        F.concat_ws("_", "hadm_id", "note_id").alias("aid"), F.col("text").alias("note"), "note_type",
        F.array_distinct(F.transform("annotations", lambda a: a["code"])).alias("targets"), F.col("annotations").alias("evidence_spans"),
    )


def _coded(df: DataFrame) -> DataFrame:
    cols = [c for c in ("diagnosis_codes", "procedure_codes") if c in df.columns]
    return df.select(F.col("note_id").cast("string").alias("aid"), F.col("text").alias("note"), F.col("note_type"), clean_codes(null_safe_union(*map(F.col, cols))).alias("targets"), F.lit(None).cast("array<struct<code:string>>").alias("evidence_spans"))


def _identity(df: DataFrame) -> DataFrame:
    return df.select("aid", "note", "note_type", "targets", "evidence_spans")


ADAPTERS = [
    Adapter("identity", frozenset({"aid", "note", "note_type", "targets", "evidence_spans"}), _identity),
    Adapter("annotated", frozenset({"hadm_id", "note_id", "text", "note_type", "annotations"}), _annotated),
    Adapter("coded", frozenset({"note_id", "text", "note_type", "diagnosis_codes"}), _coded),
]


def adapt(df: DataFrame, name: str | None = None) -> DataFrame:
    """Dispatch by columns, or by name; no data is read."""
    for a in ADAPTERS:
        if a.name == name or (name is None and a.can_handle(df)):
            return a.translate(df)
    raise ValueError(f"no adapter for columns {df.columns}" if name is None else f"no adapter {name!r}")


def validate(df: DataFrame, **rules) -> tuple[DataFrame, DataFrame]:
    """(rows that meet all rules, the others with the names of the rules they break)."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(n)) for n, rule in rules.items())), lambda x: x.isNotNull())
    marked = df.withColumn("broken", broken)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)
