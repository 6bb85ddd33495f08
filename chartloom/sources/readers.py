"""Readers and writers: explicit schemas, never inferred for code columns."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.feather as feather
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import schema

LOADERS: dict[str, Callable[..., DataFrame]] = {}


def loader(name: str):
    """Register a data set loader: ``f(spark, path, **options) -> DataFrame``."""

    def add(f):
        LOADERS[name] = f
        return f

    return add


def load(spark: SparkSession, name: str, path: str, subset: str | None = None, **options) -> DataFrame:
    df = LOADERS[name](spark, path, **options)
    return df.where(F.col("code_type").contains(subset)) if subset and "code_type" in df.columns else df


def read_csv(spark: SparkSession, path: str, name_or_ddl: str, sep: str = ",", header: bool = True, quoted: bool = True, multiline: bool = True) -> DataFrame:
    """CSV or TSV (gzip by suffix). Quoted fields may hold line feeds; without quoting, rows may be ragged."""
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(name_or_ddl) if " " in name_or_ddl else schema(name_or_ddl)
    r = spark.read.schema(kind).option("sep", sep).option("header", header).option("enforceSchema", "false" if header and quoted else "true")
    r = r.option("multiLine", multiline).option("escape", '"') if quoted else r.option("quote", "").option("mode", "PERMISSIVE")
    return r.csv(path)


@loader("parquet")
def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@loader("notes")
def read_notes(spark: SparkSession, path: str) -> DataFrame:
    raw = read_csv(spark, path, "note_events")
    return raw.select(F.col("SUBJECT_ID").alias("subject_id"), F.col("HADM_ID").alias("hadm_id"), F.col("ROW_ID").cast("string").alias("note_id"), F.col("CATEGORY").alias("note_type"), F.col("DESCRIPTION").alias("note_subtype"), "CHARTTIME", "CHARTDATE", F.col("TEXT").alias("text"))


def read_id_list(spark: SparkSession, path: str, name: str = "hadm_id") -> DataFrame:
    """One number a line without a header; the first line counts."""
    return spark.read.schema(f"{name} bigint").csv(path)


def read_name_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")


@loader("lexicon")
def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated lexicon without quoting; the empty last field is dropped."""
    return read_csv(spark, path, "lexicon", sep="|", header=False, quoted=False)


def preferred_english(lexicon: DataFrame) -> DataFrame:
    return lexicon.where("LAT = 'ENG' and ISPREF = 'Y'")


ANNOTATED_JSON = "hadm_id bigint, notes array<struct<note_id:bigint,category:string,description:string,annotations:array<struct<code:string,code_system:string,begin:bigint,end:bigint>>>>"


@loader("annotated_json")
def read_annotated_json(spark: SparkSession, path: str) -> DataFrame:
    """Folders of nested JSON -> one row per note and code with its spans; a code's last system wins."""
    raw = spark.read.schema(ANNOTATED_JSON).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    notes = raw.select("hadm_id", F.explode("notes").alias("n")).select("hadm_id", F.col("n.note_id").cast("string").alias("note_id"), F.posexplode("n.annotations").alias("pos", "a"))
    return notes.groupBy("hadm_id", "note_id", F.col("a.code").alias("code")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "a.begin", "a.end"))), lambda s: F.struct(s["begin"].alias("start"), s["end"].alias("end"))).alias("spans"),
        F.max_by("a.code_system", "pos").alias("code_type"),
    )


DECISION_JSON = "annotator_id string, discharge_summary_id string, annotations array<struct<start_offset:string,end_offset:string,category:string,decision:string,annotation_id:string>>"


@loader("decision_json")
def read_decision_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file a summary; ids come from ``subject_hadm_row`` names, categories from ``Category N: name``."""
    raw = spark.read.schema(DECISION_JSON).option("multiLine", True).option("pathGlobFilter", "*.json").json(path).withColumn("file_name", F.col("_metadata.file_name"))
    rows = raw.select("file_name", "annotator_id", "discharge_summary_id", F.explode("annotations").alias("a"))
    part = lambda i: F.try_element_at(F.split("discharge_summary_id", "_"), F.lit(i)).try_cast("bigint")
    known = F.col("a.category").rlike(r"^Category \d+:")
    return rows.select(
        "file_name", "annotator_id", part(1).alias("subject_id"), part(2).alias("hadm_id"), part(3).alias("row_id"),
        F.col("a.start_offset").try_cast("bigint").alias("start"), F.col("a.end_offset").try_cast("bigint").alias("end"), F.col("a.decision").alias("decision"),
        F.when(known, F.regexp_extract("a.category", r"^Category (\d+):", 1).cast("int")).otherwise(0).alias("category_id"),
        F.when(known, F.regexp_extract("a.category", r"^Category \d+:\s*(.*)$", 1)).otherwise("Unknown").alias("category"),
    )


def read_split(spark: SparkSession, path: str, id_name: str = "hadm_id") -> DataFrame:
    """Feather (Arrow file) split tables (_id, split), read in the tasks, a file each; a folder or a pattern may be given."""
    schema = pa.schema([(id_name, pa.int64()), ("split", pa.string())])

    def rows(batches):
        for batch in batches:
            for content in batch.column(0):
                found = feather.read_table(pa.BufferReader(content.as_buffer())).select(["_id", "split"])
                yield from found.rename_columns(schema.names).cast(schema).to_batches()

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, f"`{id_name}` long, split string")


def read_runs(spark: SparkSession, path: str, pattern: str = r"(.+?)_neg(\d+)_seed(\d+)", files: str = "*.json") -> DataFrame:
    """JSON metric files; experiment, negatives and seed from the folder's name. ``files``: which ones, as ``averages.json`` or ``responses.json``."""
    raw = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", files).json(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return raw.withColumns({"experiment": F.regexp_extract(name, pattern, 1), "negatives": F.regexp_extract(name, pattern, 2).try_cast("int"), "seed": F.regexp_extract(name, pattern, 3).try_cast("int")})


def release_files(spark: SparkSession, folder: str, patterns: dict[str, str]) -> dict[str, str]:
    """The first file, by name, of each glob in a folder of any store that Spark reads; a missing one raises."""
    out = {}
    for key, pattern in patterns.items():
        found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).agg(F.min("path").alias("p")).first()["p"]
        if found is None:
            raise FileNotFoundError(f"no {pattern} in {folder}")
        out[key] = found
    return out


# ---- sinks -----------------------------------------------------------------------
def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, columns: list[str] | None = None, one_per_file: bool = False) -> None:
    w = (df.select(*columns) if columns else df).write.mode("overwrite")
    (w.option("maxRecordsPerFile", 1) if one_per_file else w).json(path)


@loader("scored_notes")
def read_scored_notes(spark: SparkSession, path: str) -> DataFrame:
    """patient_notes, features and train CSVs of a folder -> one row per note with its features, annotations and places.

    List literals are parsed as JSON, never evaluated; lists follow the feature's number.
    """
    from ..functions.text import literal_list

    notes = read_csv(spark, f"{path}/patient_notes.csv", "pn_num bigint, case_num bigint, pn_history string")
    features = read_csv(spark, f"{path}/features.csv", "feature_num bigint, case_num bigint, feature_text string")
    train = read_csv(spark, f"{path}/train.csv", "id string, pn_num bigint, case_num bigint, feature_num bigint, annotation string, location string")
    named = train.join(features, ["feature_num", "case_num"], "left")
    item = F.struct("feature_num", "feature_text", literal_list(F.col("annotation")).alias("annotation"), literal_list(F.col("location")).alias("location"))
    grouped = named.groupBy("pn_num", "case_num").agg(F.array_sort(F.collect_list(item)).alias("features"))
    return grouped.join(notes, ["pn_num", "case_num"], "left")


@loader("code_titles")
def read_code_titles(spark: SparkSession, path: str) -> DataFrame:
    """ICD9_CODE, LONG_TITLE of a dictionary CSV, dotted as diagnoses."""
    from ..functions.codes import dot_diagnosis9

    return read_csv(spark, path, "code_titles").select(dot_diagnosis9(F.col("ICD9_CODE")).alias("code"), F.col("LONG_TITLE").alias("title"))
