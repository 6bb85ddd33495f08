"""Fuzzy lookup of names by normalised insert/delete similarity: an exact signature join, then bounded blocks.

Names are compared as distinct processed texts. Texts within two insertions and deletions have a text in common that takes at most
two deletions from both together, so short ones are first joined on what deletions leave; of titles that leave the same no more
than the k first ids count, however dense the names are. For a distance d a title is cut into d + 1 segments; a query within d insertions
and deletions of it holds one of them unchanged, at most d places away (pigeonhole), so an equality join on length, segment
number and segment finds every such pair. d is raised until a query's k best score more than any title farther away can.
Queries that are left, as their nearest titles are far, meet the titles in blocks, in which common letters bound the similarity and only pairs
whose bound reaches the k-th best are compared. Any number of queries and titles; nothing passes through the driver but counts.

Null queries are left out; null titles count as empty; equal titles each count, the smaller id first; queries that are
equal once processed find the same.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder

#: Distances of the signature join, in turn, and the sizes of blocks of queries and titles.
DISTANCES, QUERY_BLOCK, TITLE_BLOCK = (1, 3), 512, 8192
#: Titles with a segment of a query beyond which its pairs are left to the blocks.
MOST_CANDIDATES = 2000
#: Characters of queries that are joined on what deletions leave.
SHORT = 64
#: Counts of letters by which a pair is bounded; letters share a place by their code.
LETTERS = 64
#: What rounding to six digits may add.
SLACK = 1e-6


def processed(text: str) -> str:
    """Lower case, other than letters and digits to blanks, trimmed."""
    return re.sub(r"(?u)[\W_]", " ", text.lower()).strip()


def indel_ratio(a: str, b: str) -> float:
    """100 (1 - (|a| + |b| - 2 LCS) / (|a| + |b|)); the LCS runs on the bits of whole integers."""
    if not a and not b:
        return 100.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 100.0 * 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


@F.pandas_udf(T.StringType())
def _processed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: processed(t or ""))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([round(indel_ratio(x, y), 6) for x, y in zip(a, b, strict=True)], dtype="float64")


def segments(length: int, d: int) -> list[tuple[int, int]]:
    """Places and lengths of d + 1 segments of a text of ``length`` characters."""
    edges = [length * i // (d + 1) for i in range(d + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _signatures(df: DataFrame, col: str, cut) -> DataFrame:
    """``col`` with length, no and segment: what ``cut`` gives for it."""

    def run(batches):
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column(0).to_pylist()):
                own = cut(text)
                rows += [i] * len(own)
                out += own
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=[col, "length", "no", "segment"])

    return df.select(col).mapInArrow(run, f"{col} string, length int, no int, segment string")


def signature_pairs(queries: DataFrame, titles: DataFrame, d: int, most: int = MOST_CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """(looked, pairs): the queries q whose segments stand in at most ``most`` titles, and distinct pairs q, t of these,
    among them all with at most d insertions and deletions between them."""

    def of_title(t: str) -> list[tuple[int, int, str]]:
        if len(t) <= d:  # too short to be cut
            return [(len(t), -1, "")]
        return [(len(t), no, t[a : a + n]) for no, (a, n) in enumerate(segments(len(t), d))]

    def of_query(q: str) -> list[tuple[int, int, str]]:
        out = set()
        for length in range(max(0, len(q) - d), len(q) + d + 1):
            if length <= d:
                out.add((length, -1, ""))
                continue
            for no, (a, n) in enumerate(segments(length, d)):
                out |= {(length, no, q[p : p + n]) for p in range(max(0, a - d), min(len(q) - n, a + d) + 1)}
        return sorted(out)

    key = ["length", "no", "segment"]
    asked, cut = _signatures(queries, "q", of_query), _signatures(titles, "t", of_title)
    # a segment that very many titles hold (a common prefix) would pair all with all: such queries are for the blocks
    sizes = cut.groupBy(*key).agg(F.count("*").alias("n"))
    looked = asked.join(sizes, key, "left").groupBy("q").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).where(F.col("n") <= most).select("q")
    return looked, asked.join(looked, "q", "left_semi").join(cut, key).select("q", "t").distinct()


def _deletions(df: DataFrame, col: str, wanted: dict[int, set[int]]) -> DataFrame:
    """Rows of ``df`` with variant and gone: the distinct texts that ``gone`` deletions leave, the numbers by the text's length."""
    once = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    ways = {0: lambda t: F.array(t), 1: once, 2: lambda t: F.flatten(F.transform(once(t), once))}
    out = []
    for gone, make in ways.items():
        lengths = [n for n, gones in wanted.items() if gone in gones and n >= gone]
        if lengths:
            out.append(df.where(F.length(col).isin(lengths)).withColumn("variant", F.explode(F.array_distinct(make(F.col(col))))).withColumn("gone", F.lit(gone)))
    return reduce(DataFrame.unionByName, out)


def within_two(queries: DataFrame, held: DataFrame, limit: int) -> tuple[DataFrame, DataFrame] | None:
    """(looked, found): the queries q of at most SHORT characters, and of titles (t, id) within two insertions and deletions of these
    the ``limit`` best by score and id, perhaps more, as q, id and score. None if there are none.

    Titles of one length that leave the same text are as far from a query that leaves it too, or equal to it; so a title behind ``limit`` ids
    of these is not among the best.
    """
    short = queries.where(F.length("q") <= SHORT)
    asked = [r[0] for r in short.select(F.length("q")).distinct().collect()]  # SHORT + 1 at most
    there = {r[0] for r in held.select(F.length("t")).where(F.length("t") <= SHORT + 2).distinct().collect()}
    of_query, of_title = {}, {}
    for n in asked:
        for i, j in ((0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (0, 2)):
            if n - i >= 0 and n - i + j in there:
                of_query.setdefault(n, set()).add(i)
                of_title.setdefault(n - i + j, set()).add(j)
    if not of_query:
        return None
    left = _deletions(short.select("q"), "q", of_query)
    right = _deletions(held.select("t", "id"), "t", of_title)
    first = Window.partitionBy("variant", "gone").orderBy("id")
    kept = right.withColumn("no", F.row_number().over(first)).where(F.col("no") <= limit).select("variant", F.col("gone").alias("lost"), "t", "id")
    near = left.join(kept, "variant").where(F.col("gone") + F.col("lost") <= 2).groupBy("q", "id", "t").agg(F.min(F.col("gone") + F.col("lost")).alias("far"))
    total = F.length("q") + F.length("t")
    return short, near.select("q", "id", F.when(total == 0, 100.0).otherwise(F.round(100.0 * (total - F.col("far")) / total, 6)).alias("score"))


def _letters(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), LETTERS), np.int32)
    for i, t in enumerate(texts):
        np.add.at(out[i], np.frombuffer(t.encode("utf-32-le"), np.uint32) % LETTERS, 1)
    return out


def _nearest_in_blocks(queries: DataFrame, titles: DataFrame, limit: int, query_block: int, title_block: int) -> DataFrame:
    """q, t, score, tried: the ``limit`` best titles (t, id) of each query and block; ``tried`` sums to the pairs compared."""
    rows, cols = max(1, -(-queries.count() // query_block)), max(1, -(-titles.count() // title_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # both sides' keys are of one type, as groups of keys of other types are dealt to other tasks
    left = queries.select("q", F.pmod(F.xxhash64("q"), F.lit(rows)).cast("int").alias("row"), every(cols).alias("col"))
    right = titles.select("t", "id", F.pmod(F.xxhash64("t"), F.lit(cols)).cast("int").alias("col"), every(rows).alias("row"))

    def search(_, a, b):
        b = b.sort_by("id")  # ties by id: the place in this order
        texts = b.column("t").to_pylist()
        counts, sizes = _letters(texts), np.array([len(t) for t in texts], np.int64)
        out = []
        for q in a.column("q").to_pylist() if texts else []:
            common = np.minimum(counts, _letters([q])[0]).sum(axis=1)
            total = sizes + len(q)
            bound = np.where(total > 0, 200.0 * common / np.maximum(total, 1), 100.0) + SLACK
            best, tried = [], 0
            for i in np.argsort(-bound, kind="stable").tolist():
                if len(best) >= limit and bound[i] < -best[limit - 1][0]:
                    break
                best.append((-round(indel_ratio(q, texts[i]), 6), i))
                best.sort()
                del best[limit:]
                tried += 1
            out += [(q, texts[i], -s, tried if n == 0 else 0) for n, (s, i) in enumerate(best)]
        cols_ = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.table({"q": pa.array(cols_[0], pa.string()), "t": pa.array(cols_[1], pa.string()), "score": pa.array(cols_[2], pa.float64()), "tried": pa.array(cols_[3], pa.int64())})

    return left.groupBy("row", "col").cogroup(right.groupBy("row", "col")).applyInArrow(search, "q string, t string, score double, tried long")


def find_terms(queries: DataFrame, query: str, terms: DataFrame, term_id: str, title: str, limit: int, distances: tuple[int, ...] = DISTANCES, query_block: int = QUERY_BLOCK, title_block: int = TITLE_BLOCK) -> DataFrame:
    """query, term_id, score, rank of the most similar titles of each distinct query (ties by id)."""
    spark = terms.sparkSession
    home = shared_folder(spark, f"fuzzy-{uuid.uuid4().hex}")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{home}/{name}")
        return spark.read.schema(df.schema).parquet(f"{home}/{name}")

    names = written(queries.select(F.col(query).alias("name")).where("name is not null").distinct().withColumn("q", _processed("name")), "names")
    # of equal titles no more than ``limit`` can be among the best, those with the smallest ids
    ids = terms.select(F.col(term_id).alias("id"), _processed(title).alias("t"))
    held = written(ids.withColumn("no", F.row_number().over(Window.partitionBy("t").orderBy("id"))).where(F.col("no") <= limit), "titles")
    titles = held.where("no = 1").select("t", "id")
    left, parts = names.select("q").distinct(), []
    large = titles.count() > title_block  # one block of titles is looked through at once
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")

    def settled(near: DataFrame, looked: DataFrame, d: int, name: str) -> None:
        """Queries whose answer is in ``near`` (q, id, score), which has all titles within d that may be in it, leave ``left``."""
        nonlocal left
        kth = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == limit)
        # a title at d + 1 or more has at most that many characters more than the query
        farther = 200.0 * F.length("q") / (2 * F.length("q") + d + 1)
        done = written(kth.where(F.col("score") > farther + SLACK).select("q").join(looked, "q", "left_semi"), name)
        parts.append(near.join(done, "q", "left_semi"))
        left = left.join(done, "q", "left_anti")

    near = within_two(left, held, limit) if large else None
    if near:
        settled(written(near[1].withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).drop("rank"), "deletions"), near[0], 2, "done-deletions")
    for d in distances if large else ():
        if left.isEmpty():
            break
        looked, pairs = signature_pairs(left, titles, d)
        settled(written(pairs.withColumn("score", _ratio("q", "t")), f"within-{d}").join(held, "t").select("q", "id", "score"), looked, d, f"done-{d}")
    if not parts or not left.isEmpty():
        parts.append(_nearest_in_blocks(left, titles, limit, query_block, title_block).join(held, "t").select("q", "id", "score"))
    w = Window.partitionBy(query).orderBy(F.desc("score"), term_id)
    out = reduce(DataFrame.unionByName, parts).join(names, "q").select(F.col("name").alias(query), F.col("id").alias(term_id), "score")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
