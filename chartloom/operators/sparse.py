"""Sparse vectors with idf weights: top-k search over an inverted index with block maxima.

A vector is a row: id, terms, weights. An index row is a block of items of about the same total weight: its terms, the greatest weight and the
number of items of each, and their posting lists side by side. A query's bound in a block is the sum, over its
terms, of query weight, idf and block maximum; it is read without any posting. The k best items of each query's most
promising blocks give a score that the answer's k-th cannot fall below, and a query's lists are read only in blocks whose bound reaches it.

Queries of at most MAX_QUERY_TERMS terms in all go to the tasks, which stream through the blocks; only a query's bounds and k best items of a task are
shuffled. Beyond that size queries and lists are joined on block and term. Building takes one shuffle of the vectors.

Weights are positive; other weights, null terms and rows without an id are left out, repeated terms of a row are summed; ids do not
repeat. Queries without a known term find nothing; items that share no term with a query are not found. Empty tables give no rows.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow
from .vectors import _ranked

#: Items of a block; terms of all queries that tasks are sent.
BLOCK_ITEMS, MAX_QUERY_TERMS = 32, 1 << 18
#: Texts whose words are counted at once.
TEXT_ROWS = 256
#: Hits that a task holds before it keeps the best alone.
HELD_ROWS = 1 << 18
#: Room for sums that are rounded elsewhere than the bound.
SLACK = 1e-9
VECTOR = "id long, terms array<string>, weights array<double>"
BLOCK = "block long, ids array<long>, terms array<string>, tops array<double>, counts array<int>, items array<int>, weights array<double>"


@dataclass
class SparseIndex:
    """blocks: the index's rows (see BLOCK; ``items`` are places in ``ids``, term by term). n: items of the index."""

    blocks: DataFrame
    n: int

    def postings(self) -> DataFrame:
        """block, term, top, n, items (ids), weights: a row for each list."""

        def lists(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    block, ids, terms, tops, counts, items, weights = (batch.column(c)[i] for c in range(7))
                    ends = pa.array(np.append(0, np.cumsum(counts.values.to_numpy())), pa.int32())
                    of = lambda values: pa.ListArray.from_arrays(ends, values)  # noqa: B023, E731
                    columns = [pa.array(np.full(len(terms), block.as_py(), np.int64)), terms.values, tops.values, counts.values, of(ids.values.take(items.values)), of(weights.values)]
                    yield pa.RecordBatch.from_arrays(columns, names=["block", "term", "top", "n", "items", "weights"])

        return map_arrow(self.blocks, lists, "block long, term string, top double, n int, items array<long>, weights array<double>")


def word_vectors(df: DataFrame, id_col: str, text_col: str, pattern: str = "[A-Za-z]+") -> DataFrame:
    """Vectors of the matches of ``pattern`` in texts: a word's weight is 1 + ln of its count."""
    words = re.compile(pattern)

    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXT_ROWS):
                part = batch.slice(at, TEXT_ROWS)
                found = [Counter(words.findall(t or "")) for t in part.column(1).to_pylist()]
                ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                terms, counts = pa.array(list(chain.from_iterable(found)), pa.string()), np.fromiter(chain.from_iterable(c.values() for c in found), np.int64)
                lists = [pa.ListArray.from_arrays(ends, v) for v in (terms, pa.array(1 + np.log(counts)))]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=["id", "terms", "weights"])

    return map_arrow(df.select(F.col(id_col).cast("long").alias("id"), text_col), count, VECTOR)


def _block(no: int, ids: pa.Array, terms: pa.ListArray, weights: pa.ListArray, schema: pa.Schema) -> pa.RecordBatch:
    """One row of the index of a few items; none where no item has a term."""
    names, w = terms.flatten(), weights.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(ids)), pc.fill_null(pc.list_value_length(terms), 0).to_numpy())
    with np.errstate(invalid="ignore"):
        good = (w > 0) & names.is_valid().to_numpy(zero_copy_only=False)
    coded = names.filter(pa.array(good)).dictionary_encode()
    n = len(coded.dictionary)
    if not n:
        return pa.RecordBatch.from_pylist([], schema=schema)
    held, place = np.unique(row[good], return_inverse=True)
    # a cell for each term and item; a term that a row repeats is summed
    cells, at = np.unique(coded.indices.to_numpy().astype(np.int64) * len(held) + place, return_inverse=True)
    total = np.bincount(at, w[good], len(cells))
    term, item = cells // len(held), (cells % len(held)).astype(np.int32)
    counts = np.bincount(term, minlength=n).astype(np.int32)
    tops = np.maximum.reduceat(total, np.cumsum(counts) - counts)
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    columns = [pa.array([no]), one(ids.take(pa.array(held))), one(coded.dictionary), *(one(pa.array(v)) for v in (tops, counts, item, total))]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def sparse_index(vectors: DataFrame, home: str, block_items: int = BLOCK_ITEMS) -> SparseIndex:
    """An index of the vectors, written below ``home`` (shared storage).

    Items are dealt by the hash of their ids; a task cuts its items, sorted by total weight, into blocks.
    """
    spark, folder = vectors.sparkSession, f"{home}/{uuid.uuid4().hex}"
    arrow = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("tops", pa.list_(pa.float64())), ("counts", pa.list_(pa.int32())), ("items", pa.list_(pa.int32())), ("weights", pa.list_(pa.float64()))])

    def cut(batches):
        no, rest = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch.cast(rest.schema)]).combine_chunks()
            for at in range(0, rows.num_rows - block_items + 1, block_items):
                yield _block(no, *(c.combine_chunks() for c in rows.slice(at, block_items).columns), arrow)
                no += 1
            rest = rows.slice(rows.num_rows - rows.num_rows % block_items)
        if rest is not None and rest.num_rows:
            yield _block(no, *(c.combine_chunks() for c in rest.columns), arrow)

    total = F.aggregate("weights", F.lit(0.0), lambda s, w: s + F.coalesce(w, F.lit(0.0)))
    dealt = vectors.select("id", "terms", "weights").where("id is not null").withColumn("total", total).repartition(F.xxhash64("id")).sortWithinPartitions("total")
    map_arrow(dealt.select("id", "terms", "weights"), cut, BLOCK).write.option("compression", "zstd").parquet(folder)
    blocks = spark.read.schema(BLOCK).parquet(folder)
    return SparseIndex(blocks, blocks.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0])


class _Queries:
    """A stated set of queries for the tasks: by term the queries that have it, with their weights times idf."""

    def __init__(self, ids: list[int], terms: list[str], entries: list[tuple[int, int, float]]):
        self.ids, self.terms = np.array(ids, np.int64), pa.array(terms, pa.string())
        entries = sorted(entries)  # term, query, weight
        t, self.q, self.w = (np.array([e[i] for e in entries], k) for i, k in ((0, np.int64), (1, np.int64), (2, np.float64)))
        self.first = np.searchsorted(t, np.arange(len(terms) + 1))

    def met(self, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(entries, places in ``terms``) of all entries whose term is in the list."""
        at = pc.index_in(terms, self.terms).to_numpy(zero_copy_only=False)
        place = np.flatnonzero(~np.isnan(at)) if at.dtype.kind == "f" else np.arange(len(at))
        t = at[place].astype(np.int64)
        n = self.first[t + 1] - self.first[t]
        ends = np.cumsum(n)
        entry = np.arange(n.sum()) - np.repeat(ends - n, n) + np.repeat(self.first[t], n)
        return entry, np.repeat(place, n)

    def bounds(self, terms: pa.Array, tops: np.ndarray) -> np.ndarray:
        entry, place = self.met(terms)
        return np.bincount(self.q[entry], self.w[entry] * tops[place], len(self.ids))


def _query_terms(index: SparseIndex, queries: DataFrame) -> DataFrame:
    """q, term, w (weight times idf) of the queries' known terms. idf is ln(1 + (N - n + 0.5) / (n + 0.5)) for a term of n of N items."""
    each = queries.where("id is not null").select(F.col("id").alias("q"), F.explode(F.arrays_zip("terms", "weights")).alias("t")).select("q", F.col("t.terms").alias("term"), F.col("t.weights").alias("w"))
    own = each.where("term is not null and w > 0").groupBy("q", "term").agg(F.sum("w").alias("w"))
    # an index's counts are read for the queries' terms alone
    held = index.blocks.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
    df = held.join(own.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
    return own.join(df, "term").select("q", "term", (F.col("w") * F.log(1 + (F.lit(index.n) - F.col("n") + 0.5) / (F.col("n") + 0.5))).alias("w"))


def _best(q: np.ndarray, x: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, by query, score and item."""
    order = np.lexsort((x, -s, q))
    q, x, s = q[order], x[order], s[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if q.size else np.zeros(0, np.int64)
    keep = np.arange(q.size) - np.repeat(first, np.diff(np.append(first, q.size))) < k
    return q[keep], x[keep], s[keep]


def _scores(index: SparseIndex, q: _Queries, k: int, digits: int, chosen, floor: np.ndarray | None = None) -> DataFrame:
    """q, x, score, read: each task's k best items of each query, over the queries that ``chosen`` picks in a block by their
    bounds; scores below a query's floor go. ``read``, on a query's first row, is the number of postings looked at."""

    def search(batches) -> Iterator[pa.RecordBatch]:
        held, size, read = [], 0, np.zeros(len(q.ids), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                terms, tops, counts, items, weights = (batch.column(c)[i].values for c in ("terms", "tops", "counts", "items", "weights"))
                entry, place = q.met(terms)
                bound = np.bincount(q.q[entry], q.w[entry] * tops.to_numpy()[place], len(q.ids))
                keep = chosen(batch.column("block")[i].as_py(), bound)[q.q[entry]]
                entry, place = entry[keep], place[keep]
                if not entry.size:
                    continue
                own, n, start = q.q[entry], counts.to_numpy()[place], np.cumsum(counts.to_numpy()) - counts.to_numpy()
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[place], n)
                ids = batch.column("ids")[i].values.to_numpy()
                # a place for every chosen query and item of the block
                asked, row = np.unique(own, return_inverse=True)
                cell = np.repeat(row, n) * len(ids) + items.to_numpy()[at]
                met = np.bincount(cell, minlength=len(asked) * len(ids)) > 0
                total = np.round(np.bincount(cell, np.repeat(q.w[entry], n) * weights.to_numpy()[at], len(met)), digits)
                read += np.bincount(own, n, len(q.ids)).astype(np.int64)
                cells = np.flatnonzero(met if floor is None else met & (total >= np.repeat(floor[asked], len(ids))))
                held.append((asked[cells // len(ids)], ids[cells % len(ids)], total[cells]))
                size += len(cells)
                if size > HELD_ROWS:
                    held = [_best(*map(np.concatenate, zip(*held, strict=True)), k)]
                    size = len(held[0][0]) // 2  # what stays is not gone through again at once
        own, x, s = _best(*map(np.concatenate, zip(*held, strict=True)), k) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        first = np.concatenate([[True], own[1:] != own[:-1]]) if own.size else np.zeros(0, bool)
        columns = [pa.array(q.ids[own]), pa.array(x), pa.array(s), pa.array(np.where(first, read[own], 0))]
        yield pa.RecordBatch.from_arrays(columns, names=["q", "x", "score", "read"])

    return map_arrow(index.blocks, search, "q long, x long, score double, read long")


def _floors(hits: DataFrame, k: int) -> DataFrame:
    return _ranked(hits, "q", "x", k).where(F.col("rank") == k).select("q", F.col("score").alias("floor"))


def _reach(bound, digits: int):
    return bound * (1 + SLACK) + 0.5 * 10.0**-digits


def _search_in_tasks(index: SparseIndex, rows: list, k: int, digits: int, seeds: int, prune: bool) -> DataFrame:
    terms, ids = sorted({r["term"] for r in rows}), sorted({r["q"] for r in rows})
    of_term, of_id = {t: i for i, t in enumerate(terms)}, {q: i for i, q in enumerate(ids)}
    q = _Queries(ids, terms, [(of_term[r["term"]], of_id[r["q"]], r["w"]) for r in rows])
    if not prune:
        return _scores(index, q, k, digits, lambda block, bound: bound > 0)

    def bounds(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                bound = q.bounds(batch.column("terms")[i].values, batch.column("tops")[i].values.to_numpy())
                own = np.flatnonzero(bound)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), batch.column("block")[i].as_py(), np.int64)), pa.array(bound[own])], names=["q", "block", "score"])

    # ``seeds`` blocks and one score a query come back
    first = _ranked(map_arrow(index.blocks.select("block", "terms", "tops"), bounds, "q long, block long, score double"), "q", "block", seeds).collect()
    picked: dict[int, list[int]] = {}
    for r in first:
        picked.setdefault(r["block"], []).append(r["q"])

    def seeded(block, bound):
        use = np.zeros(len(ids), bool)
        use[picked.get(block, [])] = True
        return use

    some = SparseIndex(index.blocks.where(F.col("block").isin(list(picked))), index.n)
    floor = np.full(len(ids), -np.inf)
    for r in _floors(_scores(some, q, k, digits, seeded), k).collect():
        floor[of_id[r["q"]]] = r["floor"]
    return _scores(index, q, k, digits, lambda block, bound: (bound > 0) & (_reach(bound, digits) >= floor), floor)


def _search_by_joins(index: SparseIndex, terms: DataFrame, k: int, digits: int, seeds: int, prune: bool) -> DataFrame:
    lists = index.postings()
    bounds = terms.join(lists.select("block", "term", "top"), "term").groupBy("q", "block").agg(F.sum(F.col("w") * F.col("top")).alias("bound"))

    def read(looks: DataFrame) -> DataFrame:
        met = looks.select("q", "block").join(terms, "q").join(lists.select("block", "term", "items", "weights"), ["block", "term"])
        return met.groupBy("q", "block").applyInArrow(score, "q long, x long, score double, read long")

    def score(table: pa.Table) -> pa.Table:
        items = table.column("items").combine_chunks()
        sizes = np.diff(items.offsets.to_numpy())
        x, w = items.flatten().to_numpy(), table.column("weights").combine_chunks().flatten().to_numpy()
        found, at = np.unique(x, return_inverse=True)
        total = np.round(np.bincount(at, w * np.repeat(table.column("w").to_numpy(), sizes), len(found)), digits)
        first = np.lexsort((found, -total))[:k]
        n = np.zeros(len(first), np.int64)
        n[:1] = len(x)
        return pa.table({"q": pa.array(np.full(len(first), table.column("q")[0].as_py(), np.int64)), "x": pa.array(found[first]), "score": pa.array(total[first]), "read": pa.array(n)})

    if not prune:
        return read(bounds)
    blocks = _ranked(bounds.withColumnRenamed("bound", "score"), "q", "block", 1 << 30).withColumnRenamed("score", "bound")
    first = read(blocks.where(F.col("rank") <= seeds))
    rest = blocks.where(F.col("rank") > seeds).join(_floors(first, k), "q", "left").where(F.col("floor").isNull() | (_reach(F.col("bound"), digits) >= F.col("floor")))
    return first.unionByName(read(rest))


def sparse_hits(index: SparseIndex, queries: DataFrame, k: int, digits: int = 6, seeds: int = 4, prune: bool = True, most: int = MAX_QUERY_TERMS) -> DataFrame:
    """q, x, score, read: hits that hold the k best items of each query; ``read`` sums to the postings looked at."""
    terms = _query_terms(index, queries)
    rows = terms.limit(most + 1).collect()  # bounded
    if len(rows) > most:
        return _search_by_joins(index, terms, k, digits, seeds, prune)
    return _search_in_tasks(index, rows, k, digits, seeds, prune)


def sparse_search(index: SparseIndex, queries: DataFrame, k: int, **options) -> DataFrame:
    """q, x, score, rank: the k best items of each query vector by the sum over shared terms of query weight, item weight and
    idf (rounded, ties by item)."""
    return _ranked(sparse_hits(index, queries, k, **options).drop("read"), "q", "x", k)
