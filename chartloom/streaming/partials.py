"""Aggregates that merge over runs: partial states in shared storage, one folder a batch, written again by a retry.

A state has by key the count, sum and maximum of values that are neither null nor NaN, and the sums of vectors by place. Folders are
named by the batch's id, so a batch that is added twice counts once; merging adds states up, so the results of
runs together are those of one run over all their rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def partial_state(rows: DataFrame, key: str, value: str, vector: str | None = None) -> DataFrame:
    """key, place (null for the value), n, total, high: what merges. ``vector``: an array column whose places are summed."""
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    each = rows.select(F.col(key).alias("key"), F.lit(None).cast("int").alias("place"), number(value).alias("x"))
    if vector:
        parts = rows.select(F.col(key).alias("key"), F.posexplode(vector).alias("place", "y"))
        each = each.unionByName(parts.select("key", "place", number("y").alias("x")))
    return each.groupBy("key", "place").agg(F.count("x").alias("n"), F.sum("x").alias("total"), F.max("x").alias("high"))


class PartialStore:
    """States below ``home``, by batch."""

    def __init__(self, spark: SparkSession, home: str, key: str, value: str, vector: str | None = None):
        self.spark, self.home, self.key, self.value, self.vector = spark, home, key, value, vector

    def add(self, batch: DataFrame, batch_id: int | str) -> None:
        """Usable as ``foreachBatch``."""
        partial_state(batch, self.key, self.value, self.vector).write.mode("overwrite").parquet(f"{self.home}/batch={batch_id}")

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Take in what is there and stop."""
        stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def _states(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.home)
        except AnalysisException:  # nothing was added
            return None

    def values(self) -> DataFrame:
        """key, n, mean, high, total over all batches; keys without a number have n 0 and nulls."""
        states = self._states()
        if states is None:
            return self.spark.createDataFrame([], f"{self.key} string, n long, mean double, high double, total double")
        merged = states.where("place is null").groupBy(F.col("key").alias(self.key)).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("high").alias("high"))
        return merged.select(self.key, "n", (F.col("total") / F.when(F.col("n") > 0, F.col("n"))).alias("mean"), "high", "total")

    def vectors(self) -> DataFrame:
        """key and its vector sum, place by place."""
        states = self._states()
        if states is None:
            return self.spark.createDataFrame([], f"{self.key} string, total array<double>")
        sums = states.where("place is not null").groupBy("key", "place").agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("x"))
        return sums.groupBy(F.col("key").alias(self.key)).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda p: p["x"]).alias("total"))
