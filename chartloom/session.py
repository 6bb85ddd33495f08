"""Session defaults and table access."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(name: str = "chartloom", **conf: str) -> SparkSession:
    """A session with the defaults; keyword ``conf`` keys use __ for dots."""
    builder = SparkSession.builder.appName(name)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of a batch that Python tasks are handed.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def map_arrow(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``mapInArrow`` for long rows: a session's batches are held to BATCH_ROWS rows and BATCH_BYTES bytes from here on
    (results do not depend on it), and a Python worker returns Arrow's memory at the end of a task."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def lean(batches):
        import pyarrow as pa

        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(lean, schema)


def shared_folder(spark: SparkSession, name: str) -> str:
    """``name`` below the folder that all machines share (``spark.checkpoint.dir``).

    A temporary folder serves a local session without that setting; elsewhere its lack is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="chartloom-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}"
