"""Admissions, codes and notes: grouping to lists, frequency filters, merges, de-duplication."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lists import clean_codes, null_safe_union, sorted_distinct


def code_lists(rows: DataFrame, id_col: str, code_col: str, type_col: str | None = None) -> DataFrame:
    """One sorted list of distinct codes per id (and code type); null codes go."""
    keys = [id_col] + ([type_col] if type_col else [])
    return rows.where(F.col(code_col).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_set(code_col)).alias("codes"))


def full_join_lists(a: DataFrame, b: DataFrame, key: str, a_col: str, b_col: str, out: str = "codes") -> DataFrame:
    """Full join on one key; ``out`` is the null-safe union of both lists."""
    joined = a.select(key, F.col(a_col).alias("_a")).join(b.select(key, F.col(b_col).alias("_b")), [key], "full")
    return joined.select(key, F.col("_a").alias(a_col), F.col("_b").alias(b_col), null_safe_union(F.col("_a"), F.col("_b")).alias(out))


def merge_notes(notes: DataFrame, keys: Sequence[str], text_col: str, order: Sequence[Column], id_col: str | None = None, sep: str = " ") -> DataFrame:
    """Texts (and ids, joined by +) of a group in the given order."""
    ordering = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.col(text_col).alias("t"), (F.col(id_col) if id_col else F.lit(None)).cast("string").alias("i"))
    rows = F.sort_array(F.collect_list(ordering))
    out = notes.groupBy(*keys).agg(rows.alias("_r")).withColumn(text_col, F.array_join(F.transform("_r", lambda x: x["t"]), sep))
    if id_col:
        out = out.withColumn(id_col, F.array_join(F.transform("_r", lambda x: x["i"]), "+"))
    return out.drop("_r")


def code_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Occurrences of each code over list columns, counted as often as they occur."""
    parts = [df.select(F.explode(c).alias("code")) for c in cols]
    return reduce(DataFrame.unionByName, parts).where("code is not null").groupBy("code").agg(F.count("*").alias("n"))


def remove_rare_codes(df: DataFrame, id_col: str, cols: Sequence[str], min_count: int) -> DataFrame:
    """Keep codes seen ``min_count`` times or more, column by column; ids left without a code in a column go.

    Lists are regrouped by id, so several rows of an id get the concatenation of their lists.
    """
    out = df
    for c in cols:
        items = df.select(id_col, F.explode(c).alias("code"))
        common = items.groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") >= min_count).select("code")
        kept = items.join(common, "code", "left_semi").groupBy(id_col).agg(F.sort_array(F.collect_list("code")).alias(c))
        out = out.drop(c).join(kept, id_col)
    return out


def keep_top_codes(df: DataFrame, id_col: str, cols: Sequence[str], k: int) -> DataFrame:
    """Keep the k most frequent codes of all columns together (ties by code); ids left without one get null."""
    top = code_counts(df, cols).orderBy(F.desc("n"), "code").limit(k).select("code")
    out = df
    for c in cols:
        kept = df.select(id_col, F.explode(c).alias("code")).join(F.broadcast(top), "code", "left_semi").groupBy(id_col).agg(F.sort_array(F.collect_list("code")).alias(c))  # at most k rows
        out = out.drop(c).join(kept, id_col, "left")
    return out


def group_structs(rows: DataFrame, keys: Sequence[str], cols: Sequence[str], out: str = "items") -> DataFrame:
    """A sorted list of structs per group."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(out))


def onehot_name(cols: Sequence[str], default: str | None = None) -> Column:
    """The name of the first column that is 1."""
    return F.coalesce(*(F.when(F.col(c) == 1, F.lit(c)) for c in cols), F.lit(default))


def distinct_texts(notes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per (id, text)."""
    return notes.dropDuplicates([id_col, text_col])


def priority_dedupe(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of sources of equal columns; of rows with one key the earliest source's stays."""
    cols = sources[0].columns
    marked = [s.select(*cols).withColumn("_prio", F.lit(i)) for i, s in enumerate(sources)]
    best = reduce(DataFrame.unionByName, marked).groupBy(key).agg(F.min(F.struct("_prio", *[c for c in cols if c != key])).alias("_b"))
    return best.select(*(F.col(key) if c == key else F.col(f"_b.{c}").alias(c) for c in cols))


def shared_texts(notes: DataFrame, text_col: str, author_col: str) -> DataFrame:
    """Hashes of texts that more than one author has."""
    return notes.groupBy(F.sha2(F.col(text_col), 512).alias("text_hash")).agg(F.countDistinct(author_col).alias("n_authors"), F.count("*").alias("n_rows")).where("n_authors > 1")


def drop_shared_texts(notes: DataFrame, text_col: str, author_col: str) -> DataFrame:
    shared = shared_texts(notes, text_col, author_col).select("text_hash")
    return notes.withColumn("text_hash", F.sha2(F.col(text_col), 512)).join(shared, "text_hash", "left_anti").drop("text_hash")


def targets_of(df: DataFrame, cols: Sequence[str], out: str = "targets") -> DataFrame:
    return df.withColumn(out, clean_codes(null_safe_union(*(F.col(c) for c in cols))))


def unique_targets(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.explode(col).alias("code")).where("code is not null").distinct().orderBy("code")


def filter_known_targets(df: DataFrame, id_col: str, col: str, known: DataFrame, code_col: str = "code") -> tuple[DataFrame, DataFrame]:
    """(rows with the known codes of ``col`` in order, counts of the dropped codes)."""
    items = df.select(id_col, F.posexplode(col).alias("pos", "_code"))
    names = known.select(F.col(code_col).alias("_code")).distinct()
    kept = items.join(names, "_code", "left_semi").groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", "_code"))).alias("_k"))
    rows = df.drop(col).join(kept, id_col, "left").withColumn(col, F.coalesce(F.transform("_k", lambda x: x["_code"]), F.array().cast("array<string>"))).drop("_k")
    return rows, items.join(names, "_code", "left_anti").groupBy(F.col("_code").alias("code")).agg(F.count("*").alias("n"))


def row_key(*cols: str) -> Column:
    """md5 of the row as JSON."""
    return F.md5(F.to_json(F.struct(*cols)))


def combine(inputs) -> DataFrame:
    """Union by name of frames nested in lists, tuples and dictionaries."""
    if isinstance(inputs, DataFrame):
        return inputs
    parts = [combine(x) for x in (inputs.values() if isinstance(inputs, dict) else inputs)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs as columns named by their path."""
    from pyspark.sql.types import StructType

    def walk(kind: StructType, path: tuple[str, ...]):
        for f in kind.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, StructType):
                yield from walk(f.dataType, here)
            else:
                yield F.col(".".join(f"`{p}`" for p in here)).alias(sep.join(here))

    return df.select(*walk(df.schema, ()))


def distinct_union_sorted(col: str) -> Column:
    return sorted_distinct(F.flatten(F.collect_list(col)))


def dictionary(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key and its last value in the given order (ties by the largest value): what a dictionary that is written row by row holds."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, F.struct(order, value)).alias(value))


def length_histogram(rows: DataFrame, split: str, code: str) -> DataFrame:
    """split, length, n: distinct codes by their length without the dot."""
    n = F.length(F.replace(F.col(code), F.lit("."), F.lit(""))).alias("length")
    return rows.select(split, code).distinct().groupBy(split, n).agg(F.count("*").alias("n"))


def row_set_digest(df: DataFrame, *cols: str) -> DataFrame:
    """n and an order-insensitive digest of a set of rows: four sums of 32 bits of the rows' keys."""
    key = row_key(*cols)
    piece = lambda i: F.conv(F.substring(key, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")
    sums = df.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(piece(i)), F.lit(0).cast("decimal(30,0)")).cast("string").alias(f"s{i}") for i in range(4)))
    return sums.select("n", F.md5(F.concat_ws("|", "s0", "s1", "s2", "s3")).alias("digest"))


def missed_phrases(targets: DataFrame, predictions: DataFrame, keys: list[str], text: str, phrase: str = "phrase") -> DataFrame:
    """phrase, n: lower-cased evidence texts (line feeds as blanks) of targets that no prediction has."""
    missed = targets.join(predictions.select(*keys).distinct(), keys, "left_anti")
    clean = F.lower(F.replace(F.col(text), F.lit("\n"), F.lit(" "))).alias(phrase)
    return missed.groupBy(clean).agg(F.count("*").alias("n"))
