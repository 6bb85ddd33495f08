"""An inverted-file index of vectors in shared storage: k-means cells, one partition each, under the fingerprint of its rows.

``ensure_index`` builds an index only where none stands under the fingerprint of rows and settings. The centroids are fitted on a
bounded sample (SAMPLE rows, by a hash of their ids), all rows are indexed. A build writes a version of its own and
publishes it last, by a manifest; of two builds at once the first to publish is used. ``search`` looks through the
cells nearest to each query; with all cells it is exact. Ids do not repeat; rows without a vector are not indexed, queries without
one find nothing; an empty table gives an index without cells.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vectors import ITEM_BLOCK, QUERY_BLOCK, _hits_schema, _matrix, _ranked, blocks_topk

#: Rows that centroids are fitted on, passes over them, and the most cells of an index.
SAMPLE, PASSES, MAX_CELLS = 16384, 12, 4096


def fit_cells(df: DataFrame, id_col: str, vec_col: str, cells: int, seed: int = 0, sample: int = SAMPLE) -> np.ndarray:
    """Centroids (Lloyd's k-means) of a bounded sample of the vectors; the rows of least hash, so it depends on no partition."""
    if not 0 < cells <= MAX_CELLS:
        raise ValueError(f"an index has 1 to {MAX_CELLS} cells")
    known = df.where(F.col(vec_col).isNotNull()).select(F.col(vec_col).alias("v"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"))
    x = np.array([r["v"] for r in known.orderBy("h", "v").limit(sample).collect()], np.float64)  # bounded
    if not len(x):
        return np.zeros((0, 0))
    centres = x[: min(cells, len(x))].copy()
    for _ in range(PASSES):
        own = _nearest(x, centres, 1)[:, 0]
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """The cells with the nearest centroids (Euclidean), nearest first, ties by number."""
    far = (centres**2).sum(axis=1) / 2 - x @ centres.T
    return np.argsort(far, axis=1, kind="stable")[:, :probes] if probes > 1 else far.argmin(axis=1)[:, None]


def with_cells(df: DataFrame, vec_col: str, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """``df`` with a column ``cell``, once for each of the ``probes`` nearest cells; at most MAX_CELLS centroids travel along."""
    schema = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType())])
    at = df.columns.index(vec_col)

    def assign(batches):
        for batch in batches:
            if batch.num_rows and len(centres):
                near = _nearest(_matrix(batch.column(at)), centres, probes)
                rows = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([*batch.take(rows).columns, pa.array(near.ravel().astype(np.int32))], names=schema.fieldNames())

    return df.where(F.col(vec_col).isNotNull()).mapInArrow(assign, schema)


def cells_topk(looks: DataFrame, items: DataFrame, sizes: dict[int, int], k: int, schema: T.StructType, exclude_same: bool = False, digits: int = 6) -> DataFrame:
    """The k best ``items`` (cell, x, v) of each row of ``looks`` (cell, q, v) in its cell; ``sizes``: rows of the items' cells.

    Cells of many rows or looks are split into blocks that meet pair by pair; items of other cells are not read.
    """
    asked = {r["cell"]: r["n"] for r in looks.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most MAX_CELLS
    plan = [(c, -(-n // QUERY_BLOCK), -(-sizes[c] // ITEM_BLOCK)) for c, n in sorted(asked.items()) if sizes.get(c)]
    blocks = F.broadcast(looks.sparkSession.createDataFrame(plan, "cell int, rows int, cols int"))  # at most MAX_CELLS
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = looks.join(blocks, "cell").withColumn("row", deal("q", "rows")).withColumn("col", every("cols")).select("cell", "row", "col", "q", "v")
    held = items.where(F.col("cell").isin([c for c, _, _ in plan])).join(blocks, "cell")
    right = held.withColumn("col", deal("x", "cols")).withColumn("row", every("rows")).select("cell", "row", "col", "x", "v")
    return blocks_topk(left, right, ["cell", "row", "col"], k, schema, exclude_same, digits)


def rows_fingerprint(df: DataFrame, id_col: str, vec_col: str, *settings) -> str:
    """A digest of a set of rows, in any order, and of settings: the count and two sums of 64-bit hashes of the rows."""
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(i), F.col(id_col), F.col(vec_col)).cast("decimal(38,0)")), F.lit(0)).cast("string") for i in (1, 2)]
    one = df.agg(F.md5(F.concat_ws("|", F.count("*").cast("string"), *sums, *(F.lit(str(s)) for s in settings))).alias("f"))
    return one.first()["f"]


@dataclass
class VectorIndex:
    """A published index: its fingerprint, its folder, and its cells' centroids and sizes (at most MAX_CELLS)."""

    spark: SparkSession
    fingerprint: str
    folder: str
    centres: np.ndarray
    sizes: dict[int, int]

    def vectors(self) -> DataFrame:
        """x, v and cell of all rows; a filter on the cell reads its folders alone."""
        return self.spark.read.schema("x long, v array<double>, cell int").parquet(f"{self.folder}/vectors")

    def search(self, queries: DataFrame, k: int, query_id: str, query_vec: str, probes: int, item_id: str = "x_id", digits: int = 6, exclude_same: bool = False) -> DataFrame:
        """query_id, item_id, score, rank of the k best items by dot product among those of the ``probes`` nearest cells.

        Any number of queries; see ``cells_topk``.
        """
        q = queries.select(F.col(query_id).cast("long").alias("q"), F.col(query_vec).cast("array<double>").alias("v"))
        looks = with_cells(q, "v", self.centres, min(probes, max(1, len(self.centres))))
        found = cells_topk(looks, self.vectors(), self.sizes, k, _hits_schema(query_id, item_id), exclude_same, digits)
        return _ranked(found, query_id, item_id, k)


def _published(spark: SparkSession, home: str, fingerprint: str) -> VectorIndex | None:
    try:
        found = spark.read.schema("version string, published timestamp").json(f"{home}/{fingerprint}/manifest").orderBy("published", "version").first()
    except AnalysisException:  # no such folder
        return None
    if found is None:
        return None
    folder = f"{home}/{fingerprint}/{found['version']}"
    cells = spark.read.schema("cell int, n long, centre array<double>").parquet(f"{folder}/cells").orderBy("cell").collect()  # at most MAX_CELLS
    centres = np.array([r["centre"] for r in cells], np.float64) if cells else np.zeros((0, 0))
    return VectorIndex(spark, fingerprint, folder, centres, {r["cell"]: r["n"] for r in cells if r["n"]})


def ensure_index(df: DataFrame, id_col: str, vec_col: str, home: str, cells: int = 64, seed: int = 0, sample: int = SAMPLE) -> VectorIndex:
    """The index of ``df``'s rows under ``home`` (shared storage): the published one, or a new one where there is none."""
    spark = df.sparkSession
    fingerprint = rows_fingerprint(df, id_col, vec_col, "ivf", cells, seed, sample, PASSES)
    if index := _published(spark, home, fingerprint):
        return index
    version = f"v-{uuid.uuid4().hex}"
    folder = f"{home}/{fingerprint}/{version}"
    centres = fit_cells(df, id_col, vec_col, cells, seed, sample)
    rows = df.select(F.col(id_col).cast("long").alias("x"), F.col(vec_col).cast("array<double>").alias("v"))
    # rebalanced, so that a cell is a few files and a crowded one is split over tasks
    with_cells(rows, "v", centres).hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{folder}/vectors")
    sizes = {r["cell"]: r["n"] for r in spark.read.schema("x long, v array<double>, cell int").parquet(f"{folder}/vectors").groupBy("cell").agg(F.count("*").alias("n")).collect()}
    spark.createDataFrame([(i, sizes.get(i, 0), c.tolist()) for i, c in enumerate(centres)], "cell int, n long, centre array<double>").coalesce(1).write.parquet(f"{folder}/cells")
    spark.sql("select 1").select(F.lit(version).alias("version"), F.current_timestamp().alias("published")).write.mode("append").json(f"{home}/{fingerprint}/manifest")
    return _published(spark, home, fingerprint)
