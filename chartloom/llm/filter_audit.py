"""What each filter removes in every order of a filter chain: aggregation over the edges of the subset lattice.

A row contributes to the edges (filters already applied, next filter) of the lattice: 80 for five filters.
Rows are first counted by part and set of failed filters (a bit mask), so tasks send at most 2**n counts a part;
the counts then go to the edges, and an order of the filters is a path of n edges, to which the summed edges are
joined. No order is ever run over the rows.

Copies: a row fails the copy filter if a row with a smaller id has the same text (compared by SHA-256), whether
or not that one was removed. Rows without an id neither fail it nor make others fail it. Null texts count as
empty; null parts as ''; rows that repeat an id are counted each, and are copies only of a smaller id. An id with
several label rows has a mark if any of them has it. An empty table gives no parts, so no rows. Texts of any length are
read whole; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, Scratch, text_or_empty

#: Capitals and marks that the filters count.
CAPITALS, MARKS = "[A-Z]", r"[#$%&*|]"
#: Filters beyond which permutations (n!) would be no small table.
MOST_FILTERS = 6


def quality_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions by letter, over a text and the array of its words: short, repetitive, loud, marked."""
    n, loud = F.size(words), F.length(text) - F.length(F.regexp_replace(text, CAPITALS, ""))
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * loud.cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike(MARKS),
    }


def failure_counts(docs: DataFrame, marks: DataFrame, part_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, mask, n and the sums of ``marks``' 0/1 columns: rows by the filters that they fail.

    Bit i of the mask is the i-th filter; the copies' filter is the last one. ``marks``: the id and any 0/1 columns.
    """
    flags = [c for c in marks.columns if c != id_col]
    words = F.array_remove(F.split(F.col("_text"), SPACE_CLASS), "")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_or_empty(text_col).alias("_text"))
    rows = rows.withColumn("_words", words)
    fails = quality_filters(F.col("_text"), F.col("_words"))
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails.values())), F.lit(0))
    narrow = rows.select("_id", "part", mask.alias("mask"), F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("_digest"))
    # each id, text and part once, with its count, so that repeated ids and hot texts reach the joins as single rows
    once = narrow.groupBy("_id", "_digest", "part", "mask").agg(F.count("*").alias("_n"))
    known = marks.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(*(F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(c) for c in flags))
    nameless = once.where("_id is null").select("*", *(F.lit(0).alias(c) for c in flags))
    flagged = once.where("_id is not null").join(known, "_id", "left").fillna(0, flags).unionByName(nameless)
    # of a text: rows, the smallest id by part and marks with its rows; partial sums meet before the shuffle
    least = F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", F.col("_n").alias("n"))))
    work = Scratch(docs.sparkSession)
    texts = flagged.groupBy("_digest", "part", "mask", *flags).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_id").isNull(), F.col("_n")).otherwise(0)).alias("_nameless"), least.alias("_least"))
    # written, so that the texts are read once and a text that many parts share is split at the join
    texts = work.spill(texts, "audit-texts")
    first = texts.groupBy("_digest").agg(F.min("_least._id").alias("_first"))
    met = texts.join(first, "_digest")
    kept = F.col("_nameless") + F.when(F.col("_least._id") == F.col("_first"), F.col("_least.n")).otherwise(0)
    copy_bit = 1 << len(fails)
    ways = F.array(F.struct(F.col("mask"), kept.alias("n")), F.struct((F.col("mask") + copy_bit).alias("mask"), (F.col("n") - kept).alias("n")))
    both = met.select("part", *flags, F.explode(ways).alias("w")).select("part", *flags, "w.mask", "w.n")
    counts = work.spill(both.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.col(c)).alias(c) for c in flags)), "audit-counts")
    work.free(texts)
    return counts


def lattice_edges(counts: DataFrame, letters: str, flags: list[str]) -> DataFrame:
    """part, applied (bit mask), next (letter) and the sums over the rows that reach that edge, for all parts and edges."""
    n, size = len(letters), lambda s: bin(s).count("1")
    edges = [(s, i) for i in range(n) for s in range(1 << n) if not s >> i & 1]
    each = [F.struct(F.lit(s).alias("applied"), F.lit(letters[i]).alias("next"), F.lit(1 << i).alias("bit"), F.lit(factorial(size(s)) * factorial(n - 1 - size(s))).alias("orders")) for s, i in edges]
    met = counts.select("*", F.explode(F.array(*each)).alias("edge")).select("part", "mask", "n", *flags, "edge.*")
    failed = (F.col("mask").bitwiseAND(F.col("bit"))) != 0
    clear = F.col("mask").bitwiseAND(F.col("applied")) == 0
    total = lambda when, c="n": F.sum(F.when(when, F.col(c)).otherwise(0)).cast("long")
    return met.groupBy("part", "applied", "next", "orders").agg(
        total(clear & ~failed).alias("kept"),
        total(clear & failed).alias("removed"),
        total(~clear & failed).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        *(total(clear & failed, c).alias(f"{c}_lost") for c in flags),
    )


def order_paths(spark, letters: str) -> DataFrame:
    """filter_order, step, applied, next: every order as a path of edges."""
    rows = []
    for order in permutations(letters):
        applied = 0
        for step, letter in enumerate(order, 1):
            rows.append(("".join(order), step, applied, letter))
            applied |= 1 << letters.index(letter)
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, next string")


def audit_orders(counts: DataFrame, letters: str, flags: list[str]) -> DataFrame:
    """Per part, order and step: what the step keeps and removes, and its filter's removals over all orders."""
    if len(letters) > MOST_FILTERS:
        raise ValueError(f"more than {MOST_FILTERS} filters: their orders are no small table")
    edges = lattice_edges(counts, letters, flags)
    # an edge lies on as many orders as its two ends have paths to the lattice's bottom and top
    shares = edges.groupBy("part", "next").agg(F.sum(F.col("removed") * F.col("orders")).cast("long").alias("shapley"))
    walked = edges.drop("orders").join(F.broadcast(order_paths(counts.sparkSession, letters)), ["applied", "next"])
    return walked.join(shares, ["part", "next"]).drop("applied", "next")
