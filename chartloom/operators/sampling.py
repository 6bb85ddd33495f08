"""Deterministic sampling: every choice is an order by md5(seed | key), equal on any number of partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sample_key(seed: int | str, *keys: str | Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(k if isinstance(k, Column) else F.col(k).cast("string") for k in keys)))


def uniform(key: Column) -> Column:
    """A number in (0, 1) from a hexadecimal key."""
    return (F.conv(F.substring(key, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def subset(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement."""
    return df.orderBy(sample_key(seed, key), key).limit(n)


def fraction(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """Each row with probability ``share``, by its key."""
    return df.where(uniform(sample_key(seed, key)) < share)


def stratified(df: DataFrame, key: str, stratum: str, size: int, seed: int = 0) -> DataFrame:
    """The same number of rows, at least one, from each stratum.

    The number is known before the plan is made, so each task keeps that many rows of a stratum before any are moved.
    """
    each = max(1, size // max(1, df.select(stratum).distinct().count()))
    w = Window.partitionBy(stratum).orderBy(sample_key(seed, key), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= each).drop("_r")


def group_split(df: DataFrame, group: str, n_train: int, seed: int = 0) -> DataFrame:
    """``split``: train for n groups, test for the others."""
    chosen = df.select(group).distinct().orderBy(sample_key(seed, group), group).limit(n_train).withColumn("split", F.lit("train"))
    return df.join(F.broadcast(chosen), group, "left").withColumn("split", F.coalesce("split", F.lit("test")))  # n_train rows


def shuffled(items: Column, seed: int | str) -> Column:
    return F.transform(F.sort_array(F.transform(items, lambda x: F.struct(sample_key(seed, x.cast("string")).alias("k"), x.alias("v")))), lambda p: p["v"])


def remap(targets: Column, classes: Column) -> Column:
    """1-based places of the targets in the class list; none gives [0]."""
    at = F.filter(F.transform(targets, lambda t: F.array_position(classes, t).cast("int")), lambda i: i > 0)
    return F.when(F.size(at) > 0, at).otherwise(F.array(F.lit(0)))


def once(value: Column) -> Column:
    """A value that depends on no row, as a scalar subquery: worked out once a query instead of row by row."""
    return SparkSession.active().range(0, 1, 1, 1).select(value).scalar()


def negatives(classes: Column | Sequence[str], targets: Column, n: int, seed: int | str, hard: Column | None = None, hard_ratio: float = 0.0) -> Column:
    """Positives with sampled negatives, sorted: n < 0 all classes, 0 positives only, else a share of hard ones.

    ``classes`` are a list of each row's own, or a Python sequence that serves all rows; that is shuffled only once.
    """
    positives = F.array_distinct(targets)
    if n == 0:
        return F.sort_array(positives)
    if isinstance(classes, Column):
        soft = shuffled(F.array_except(classes, positives), seed)
    else:
        order = once(F.array_distinct(shuffled(F.lit(list(classes)).cast("array<string>"), seed)))
        # a positive keeps out one class at most, so the first n + |positives| classes hold the n that are taken
        soft = F.array_except(F.slice(order, F.lit(1), F.size(positives) + n) if n > 0 else order, positives)
    if n < 0:
        return F.sort_array(F.array_union(positives, soft))
    n_hard = round(n * hard_ratio) if hard is not None else 0
    if not n_hard:
        return F.sort_array(F.concat(positives, F.slice(soft, 1, n)))
    tough = F.slice(shuffled(F.array_except(hard, positives), seed), 1, n_hard)
    rest = F.array_except(soft, tough)
    return F.sort_array(F.concat(positives, tough, F.slice(rest, F.lit(1), F.lit(n) - F.size(tough))))


def decayed_keys(key: Column, rank: Column, decay: float = 0.5) -> Column:
    """Efraimidis-Spirakis keys of weights exp(-decay * rank): the m largest are a weighted sample of m."""
    return F.ln(uniform(key)) / F.exp(-F.lit(decay) * rank)


def weighted_negatives(ranked: DataFrame, row: str, code: str, rank: str, m: int, seed: int = 0, decay: float = 0.5) -> DataFrame:
    """m codes a row without replacement, by exponentially decaying weights of their rank from 0."""
    k = F.round(decayed_keys(sample_key(seed, row, code), F.col(rank), decay), 6)
    w = Window.partitionBy(row).orderBy(F.desc("_k"), code)
    return ranked.withColumn("_k", k).withColumn("place", F.row_number().over(w)).where(F.col("place") <= m).drop("_k")


def fair_shares(lists: DataFrame, positives: DataFrame, row: str, lst: str, code: str, rank: str, per_positive: int, seed: int = 0, decay: float = 0.5) -> DataFrame:
    """row, lst, code: ``per_positive`` negatives for each positive of a row, dealt evenly over its lists.

    ``lists``: row, lst, code, rank from 0. A row that wants m of n lists takes m // n from each and one more from
    the first m % n (by name), by exponentially decaying weights of the rank among the codes that are no
    positives; a code of several lists counts for the first. Lists that are too short give what they have.
    """
    wants = positives.groupBy(row).agg((F.count("*") * per_positive).alias("_want"))
    open_ = lists.join(positives.select(row, code).distinct(), [row, code], "left_anti")
    open_ = open_.groupBy(row, code).agg(F.min(F.struct(lst, rank)).alias("_f")).select(row, code, f"_f.{lst}", f"_f.{rank}")
    names = lists.select(row, lst).distinct().withColumn("_i", F.row_number().over(Window.partitionBy(row).orderBy(lst)))
    numbers = names.groupBy(row).agg(F.count("*").alias("_n"))
    share = F.floor(F.col("_want") / F.col("_n")) + (F.col("_i") <= F.col("_want") % F.col("_n")).cast("int")
    shares = names.join(numbers, row).join(wants, row).select(row, lst, share.alias("_share"))
    place = F.row_number().over(Window.partitionBy(row, lst).orderBy(rank, code)) - 1
    keyed = open_.withColumn("_p", place).withColumn("_k", F.round(decayed_keys(sample_key(seed, row, code), F.col("_p"), decay), 6))
    chosen = keyed.withColumn("_c", F.row_number().over(Window.partitionBy(row, lst).orderBy(F.desc("_k"), code)))
    return chosen.join(shares, [row, lst]).where("_c <= _share").select(row, lst, code)


def capped_negatives(pairs: DataFrame, codes: DataFrame, chapters: DataFrame, code: str, other: str, rank: str, top_k: int, n: int, within: bool | None = None, seed: int = 0, decay: float = 0.5) -> DataFrame:
    """code, other: n negatives for each of ``codes`` from its ``top_k`` nearest (``pairs``: code, other, rank).

    ``within``: only those of the code's own chapter (true), of another (false), or any (none).
    ``chapters``: code, chapter.
    """
    near = pairs.join(codes.select(code).distinct(), code, "left_semi")
    if within is not None:
        own = chapters.select(F.col(code), F.col("chapter").alias("_c"))
        their = chapters.select(F.col(code).alias(other), F.col("chapter").alias("_d"))
        near = near.join(own, code).join(their, other).where((F.col("_c") == F.col("_d")) == F.lit(within)).drop("_c", "_d")
    place = F.row_number().over(Window.partitionBy(code).orderBy(rank, other))
    capped = near.withColumn("_p", place).where(F.col("_p") <= top_k).withColumn("_p", F.col("_p") - 1)
    return weighted_negatives(capped, code, other, "_p", n, seed, decay).select(code, other)


def expanded(rows: DataFrame, row: str, targets: str, sampled: DataFrame, code: str, other: str) -> DataFrame:
    """row, pos, code, candidates: one list per target code, its sampled negatives and the code itself last."""
    lists = sampled.groupBy(code).agg(F.sort_array(F.collect_list(other)).alias("_n"))
    items = rows.select(row, F.posexplode(targets).alias("pos", code))
    return items.join(lists, code, "left").select(row, "pos", code, F.concat(F.coalesce("_n", F.array().cast("array<string>")), F.array(code)).alias("candidates"))


def fewshot_pool(df: DataFrame, key: str, case: str, per_case: int, seed: int = 0) -> DataFrame:
    """For each case: all its rows, and ``per_case`` rows of every other case."""
    w = Window.partitionBy(case).orderBy(sample_key(seed, key), key)
    few = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_case).drop("_r")
    cases = df.select(F.col(case).alias("for_case")).distinct()
    other = cases.join(few, F.col("for_case") != F.col(case))  # cases x (cases x per_case) rows
    same = df.withColumn("for_case", F.col(case))
    return same.unionByName(other.select(*same.columns))


def siblings(codes: DataFrame, code: str, nodes: DataFrame, prefix: int = 3) -> DataFrame:
    """Hard negatives: the other children of the code's parent, else codes of the same prefix; none gives []."""
    n = nodes.select(F.col("id").alias("_id"), F.col("parent_id").alias("_p"))
    own = codes.select(F.col(code).alias("c")).distinct().join(n, F.col("c") == F.col("_id"), "left").select("c", F.col("_p").alias("p"))
    by_parent = own.join(n.select(F.col("_id").alias("o"), F.col("_p").alias("p")), "p").where("o <> c").select("c", "o", F.lit(0).alias("k"))
    by_prefix = own.where("p is null").join(n.select(F.col("_id").alias("o")), F.substring("c", 1, prefix) == F.substring("o", 1, prefix)).where("o <> c").select("c", "o", F.lit(1).alias("k"))
    grouped = by_parent.unionByName(by_prefix).groupBy("c").agg(F.sort_array(F.collect_set("o")).alias("hard"))
    return own.select("c").join(grouped, "c", "left").select(F.col("c").alias(code), F.coalesce("hard", F.array().cast("array<string>")).alias("hard"))


def flatten_fewshots(shots: DataFrame, key: str, segments: str, targets: str, limit: int = 1000, seed: int = 0) -> DataFrame:
    """(key, segment, target) rows of parallel lists, at most ``limit`` of them: a sampling operator."""
    rows = shots.select(key, F.posexplode(F.arrays_zip(F.col(segments).alias("segment"), F.col(targets).alias("target"))).alias("pos", "z")).select(key, "pos", "z.segment", "z.target")
    return rows.orderBy(sample_key(seed, key, "pos"), key, "pos").limit(limit)
