"""Exact deduplication over keyed streaming state.

Arrivals (digest, id, content locator) are appended to a log in the shared folder; a Structured
Streaming query folds them into keyed state on disk (RocksDB, no watermark, so no expiry): per digest
the smallest id, its locator and the number of rows. The state's checkpoint lives in the shared
folder, so a later run with new arrivals continues from it; a stated home also keeps the texts of its
runs, so that keepers and groups of earlier runs are there in full. A call may name its batch: a batch that is in the log is not
taken in again, one whose writing broke off is written anew, so a retry changes nothing. Each hit (a digest seen more than once)
is then checked on its full bytes against the keeper's content; rows whose bytes differ, a digest
collision, are grouped by their bytes instead.

Null texts count as empty, so null and empty texts are equal; a row without an id stays only if no equal one
has an id; rows that repeat both id and text share that id's fate;
an empty frame gives an empty frame.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, keep_rows, new_path, path_exists, spill, text_or_empty

#: State on disk; its changes are checkpointed as a log; no file is allocated ahead, as many small stores would fill disks.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text_col: str = "text"):
    return F.regexp_replace(text_or_empty(text_col), SPACE_CLASS, " ")


class StreamingDeduper:
    """Digest state that outlives a run: ``home`` in shared storage holds arrivals, checkpoint and state rows."""

    def __init__(self, spark, home: str | None = None, files_per_batch: int = 4096):
        self.spark = spark
        self.home = home or new_path(spark, "dedup")
        self.files_per_batch = files_per_batch

    def ingest(self, arrivals: DataFrame, batch: str | None = None) -> DataFrame:
        """Append (digest, id, locator) rows, run the stream over what is new, return the state of all digests.

        A ``batch`` that was written whole is not written again; the stream only starts once it is.
        """
        spark, log, state = self.spark, f"{self.home}/arrivals", f"{self.home}/state"
        place = f"{log}/batch-{batch or uuid.uuid4().hex}"
        if not path_exists(spark, f"{place}/_SUCCESS"):
            arrivals.write.mode("overwrite").parquet(place)
        before = {k: spark.conf.get(k, None) for k in STATE_CONF}
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        try:
            folded = (
                spark.readStream.schema(arrivals.schema)
                .option("maxFilesPerTrigger", self.files_per_batch)
                .option("recursiveFileLookup", True)
                .parquet(log)
                .groupBy("digest")
                .agg(F.min(F.struct("id", "locator")).alias("first"), F.count("*").alias("n"))
            )

            def write(batch: DataFrame, batch_id: int) -> None:
                batch.select("digest", "first", "n").write.mode("overwrite").parquet(f"{state}/batch={batch_id}")

            query = folded.writeStream.outputMode("update").option("checkpointLocation", f"{self.home}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
            query.awaitTermination()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        rows = spark.read.parquet(state)
        if rows.select("batch").distinct().limit(2).count() > 1:  # a digest's latest state counts
            rows = rows.groupBy("digest").agg(F.max_by(F.struct("first", "n"), "batch").alias("s")).select("digest", "s.*")
        return rows.select("digest", F.col("first.id").alias("keep"), F.col("first.locator").alias("locator"), "n")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", home: str | None = None, batch: str | None = None) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256. Of equal texts the smallest id stays.

    With a ``home`` that earlier calls used, groups are those of all calls; the rows are those of ``docs``. A call that
    is made again with its ``batch`` counts once.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("body"))
    log = texts.select(F.unhex(F.sha2("body", 256)).alias("digest"), "id", F.struct(F.input_file_name().alias("file"), F.col("id").alias("row_id")).alias("locator"))
    arrivals = spill(log, "dedup-digests")
    full = texts.withColumn("digest", F.unhex(F.sha2("body", 256)))
    if home:
        run = f"r{batch or uuid.uuid4().hex}"
        full.write.mode("overwrite").option("compression", "zstd").parquet(f"{home}/contents/run={run}")
        full = spark.read.parquet(f"{home}/contents").withColumn("here", F.col("run") == run).drop("run")
    else:
        full = full.withColumn("here", F.lit(True))
    state = StreamingDeduper(spark, home).ingest(arrivals, batch)

    hits = state.where("n > 1").select("digest", "keep")
    if home:
        hits = hits.join(arrivals.select("digest").distinct(), "digest", "left_semi")
    # full bytes of every hit, the keepers' among them; a hot digest is only on the side that a skew join can split
    bodies = spill(full.join(hits, "digest"), "dedup-bodies")
    keepers = bodies.where("id = keep").groupBy("digest").agg(F.min("body").alias("kept_body"))
    checked = bodies.join(keepers, "digest", "left")
    # rows that fail the check are classed by their own bytes
    odd = F.when(F.col("body") == F.col("kept_body"), F.lit(None)).otherwise(F.col("body"))
    # written, so that a hot digest's part of the join is split and its rows are counted before they meet
    classed = spill(checked.select("digest", "id", "here", odd.alias("odd")), "dedup-classed")
    groups = classed.groupBy(F.col("digest").alias("g_digest"), F.col("odd").alias("g_odd")).agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    many = classed.where("here").join(groups, (F.col("digest") == F.col("g_digest")) & F.col("odd").eqNullSafe(F.col("g_odd"))).select("digest", "id", "keep_id", "group_size")
    ones = arrivals.join(state.where("n = 1").select("digest"), "digest").select("digest", "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return ones.unionByName(many).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts: that with the smallest id (no id: the last choice)."""
    found = exact_dedup(docs, id_col, text_col)
    fates = found.select(F.col(id_col).alias("id"), F.unhex("text_sha256").alias("key"), "kept")
    return keep_rows(docs, fates, F.unhex(F.sha2(normalised(text_col), 256)), id_col)
