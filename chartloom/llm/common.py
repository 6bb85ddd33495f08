"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import map_arrow  # noqa: F401

# Whitespace as the operators' contracts define it: space and bytes 9 to 13.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, as ``spark.checkpoint.dir`` names it.

    A temporary folder serves a local session without that setting; on a cluster each machine would write to
    its own disk, so there its lack is an error.
    """
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="chartloom-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/chartloom-{name}-{uuid.uuid4().hex}"


def spill(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives executors."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, *paths: str) -> None:
    """Delete work tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    hconf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(hconf).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class Scratch:
    """Work tables in the shared folder, deleted when no later plan reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def spill(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        out = spill(df, name, path)
        self.paths[id(out)] = (out, path)
        return out

    def free(self, *tables: DataFrame) -> None:
        drop_path(self.spark, *(self.paths.pop(id(t))[1] for t in tables))


def let_go_of_shuffles(spark: SparkSession) -> None:
    """Ask for a collection in the driver: Spark deletes a finished plan's shuffle files when the plan itself is collected,
    and a driver with little to do keeps them all until then."""
    spark.sparkContext._jvm.System.gc()


def keep_rows(docs: DataFrame, fates: DataFrame, key: Column, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns. ``fates``: id, key, kept of every row of ``docs``.

    A row is named by its id and a key of its text, so a text that only shares its id with a dropped one
    stays; of rows that are equal in both one stays.
    """
    id_, key_, whole = scratch_names(docs, "row_id", "row_key", "row_whole")
    of_id, of_key, stays = scratch_names(docs, "fate_id", "fate_key", "fate_stays")
    news = fates.groupBy(F.col("id").alias(of_id), F.col("key").alias(of_key)).agg(F.max("kept").alias(stays), F.count("*").alias("n"))
    news = spill(news.where(f"not {stays} or n > 1").drop("n"), "fates")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(whole), F.col(id_col).alias(id_), key.alias(key_))
    same = F.col(id_).eqNullSafe(F.col(of_id)) & (F.col(key_) == F.col(of_key))
    kept = rows.join(news, same, "left_anti").select(f"{whole}.*")
    twins = news.where(stays)
    if not twins.limit(1).count():
        return kept
    folded = rows.join(twins, same, "left_semi").groupBy(id_, key_).agg(F.first(whole).alias(whole))
    return kept.unionByName(folded.select(f"{whole}.*"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MEMO: dict = {}


def worker_memo(key, make):
    """The memo of a Python worker's current operator; that of an earlier one is let go."""
    if key not in _MEMO:
        _MEMO.clear()
        _MEMO[key] = make()
    return _MEMO[key]


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def n_slices(df: DataFrame) -> int:
    """Input partitions of a frame: the measure by which later partition counts grow with the data."""
    return max(1, df.rdd.getNumPartitions())


def scratch_names(df: DataFrame, *names: str) -> list[str]:
    """Column names not used by ``df``, so callers' extra columns cannot clash with ours."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
