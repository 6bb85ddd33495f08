"""Hierarchies whose codes hold their ancestors as prefixes: nested-set numbers instead of a closure.

Nodes are codes, and where wanted their prefixes of stated lengths. Sorted by code, the nodes below a node follow it
without a gap, so a node's number ``entry`` and the last number below it, ``exit``, say all: ancestor tests are range
predicates. Numbers come from a range partition: tasks number their own part, and the parts' sizes, one row a task, give the offsets.
Parents and subtree sizes come from an equality join with each node's prefixes, at most its length in rows; no chain is followed level by
level. Codes are compared by their UTF-8 bytes; null and empty codes are left out, repeated ones are one node. An empty table gives none.
"""

from __future__ import annotations

import uuid
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder


def prefixes(code: Column, lengths: list[int] | None = None) -> Column:
    """Proper prefixes of a code, shortest first, or those of stated lengths."""
    own = F.filter(F.array(*map(F.lit, lengths)), lambda n: n < F.length(code)) if lengths else F.when(F.length(code) > 1, F.sequence(F.lit(1), F.length(code) - 1))
    return F.transform(own, lambda n: F.substring(code, F.lit(1), n))


def _numbered(codes: DataFrame) -> DataFrame:
    """``code`` with its place in the order of all codes."""
    spark, path = codes.sparkSession, shared_folder(codes.sparkSession, f"prefix-tree-{uuid.uuid4().hex}")

    def number(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], names=["code", "part", "no"])
            at += n

    # written, so that every later reader sees the same parts
    codes.repartitionByRange("code").sortWithinPartitions("code").mapInArrow(number, "code string, part int, no long").write.parquet(path)
    rows = spark.read.schema("code string, part int, no long").parquet(path)
    sizes = sorted(map(tuple, rows.groupBy("part").agg(F.count("*")).collect()))  # one row a task
    starts = [0, *accumulate(n for _, n in sizes)]
    offsets = spark.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts, strict=False)], "part int, first long")
    return rows.join(F.broadcast(offsets), "part").select("code", (F.col("first") + F.col("no")).alias("entry"))


def prefix_tree(codes: DataFrame, code: str = "code", lengths: list[int] | None = None) -> DataFrame:
    """code, parent (the longest prefix that is a node, else null), depth (0 for roots), entry, exit, n_leaves (below it; none below a
    leaf), given (a code of the table, not only a prefix of one). ``lengths``: those of the prefixes that become nodes too."""
    own = codes.select(F.col(code).alias("code")).where("code <> ''").select("code", F.lit(True).alias("given"))
    if lengths:
        inner = own.select(F.explode(prefixes(F.col("code"), lengths)).alias("code"), F.lit(False).alias("given"))
        own = own.unionByName(inner)
    nodes = own.groupBy("code").agg(F.max("given").alias("given"))
    numbered = _numbered(nodes.select("code"))
    above = ancestors(nodes)
    ups = above.groupBy("code").agg(F.max_by("ancestor", F.length("ancestor")).alias("parent"), F.count("*").cast("int").alias("depth"))
    below = above.groupBy(F.col("ancestor").alias("code")).agg(F.count("*").alias("n"))
    tips = above.join(below.select("code"), "code", "left_anti").groupBy(F.col("ancestor").alias("code")).agg(F.count("*").alias("n_leaves"))
    out = nodes.join(numbered, "code").join(ups, "code", "left").join(below, "code", "left").join(tips, "code", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("code", "parent", zero("depth").alias("depth"), "entry", (F.col("entry") + zero("n")).alias("exit"), zero("n_leaves").alias("n_leaves"), "given")


def ancestors(nodes: DataFrame) -> DataFrame:
    """code and each ancestor among the nodes."""
    return nodes.select("code", F.explode(prefixes(F.col("code"))).alias("ancestor")).join(nodes.select(F.col("code").alias("ancestor")), "ancestor").select("code", "ancestor")


def is_below(entry: Column, of_entry: Column, of_exit: Column) -> Column:
    """Whether a node lies below another one: for filters, and for joins that have an equality besides or a side of a checked size."""
    return (entry > of_entry) & (entry <= of_exit)


def is_leaf() -> Column:
    return F.col("entry") == F.col("exit")


def rolled_up(tree: DataFrame, facts: DataFrame, code: str = "code", value: str = "value") -> DataFrame:
    """code and the sum of the values of a node's code and of all codes below it; nodes without any get null.

    ``facts`` are summed by code before they go up.
    """
    own = facts.groupBy(F.col(code).alias("code")).agg(F.sum(value).alias("value"))
    up = own.select(F.explode(F.concat(F.coalesce(prefixes(F.col("code")), F.array().cast("array<string>")), F.array("code"))).alias("code"), "value")
    return tree.select("code").join(up.groupBy("code").agg(F.sum("value").alias("value")), "code", "left")


def roots(tree: DataFrame) -> DataFrame:
    """code and the root above it (its chapter); a root is its own."""
    tops = tree.where("parent is null").select(F.col("code").alias("root"))
    each = tree.select("code", F.explode(F.concat(F.coalesce(prefixes(F.col("code")), F.array().cast("array<string>")), F.array("code"))).alias("root"))
    return each.join(tops, "root").select("code", "root")


def read_code_file(spark, path: str) -> DataFrame:
    """Rows ``code;description`` of a legacy code file: id, code, description, low, high and kind (code or category).

    A row without a code is a category, whose description ends in its range, as in ``Chapter: Name [A00-B99]``: the range gives
    its id, the words before a colon go from descriptions of chapters.
    """
    rows = spark.read.csv(path, sep=";", schema="code string, text string", quote='"')
    bounds = F.split(F.rtrim(F.element_at(F.split("text", r"\["), -1)), "-")
    low, high = (F.trim(F.regexp_replace(bounds[i], r"\]", "")) for i in (0, 1))
    name = F.when(F.col("text").contains("Kap."), F.concat_ws(" ", F.slice(F.split("text", ":"), 2, 1000))).otherwise(F.col("text"))
    is_code = F.coalesce(F.col("code"), F.lit("")) != ""
    return rows.select(
        F.when(is_code, F.col("code")).otherwise(F.concat_ws("-", low, high)).alias("id"),
        F.when(is_code, F.col("code")).otherwise(low).alias("code"),
        F.when(is_code, F.trim("text")).otherwise(F.trim(F.element_at(F.split(name, r"\["), 1))).alias("description"),
        F.when(is_code, F.col("code")).otherwise(low).alias("low"),
        F.when(is_code, F.col("code")).otherwise(high).alias("high"),
        F.when(is_code, "code").otherwise("category").alias("kind"),
    )
