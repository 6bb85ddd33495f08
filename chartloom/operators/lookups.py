"""Dictionary lookups: list lookups, fallbacks, prefix cascades."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a dictionary that is sent to the tasks; a larger one meets the items in a shuffle.
SENT_BYTES = 256 << 20


def _entries_in_order(df: DataFrame, keys: Sequence[str], list_col: str, entries: DataFrame) -> DataFrame:
    """Rows of ``df`` for each item of their lists (one for an empty list): ``_pos``, ``_turn`` and in ``_all`` a struct of
    ``_pos``, ``_k`` and ``_e`` for every item of the rows with these keys, in order.

    ``entries``: ``_k`` and an array ``_e``, a row a key. The items are sorted before they meet their entries and keep that
    order, so where the dictionary is sent to the tasks, nothing that it adds is shuffled or sorted.
    """
    same, at = Window.partitionBy(*keys, "_pos", "_k").orderBy("_k"), Window.partitionBy(*keys).orderBy("_pos", "_k")
    items = df.select("*", F.posexplode_outer(list_col).alias("_pos", "_k")).withColumn("_copy", F.row_number().over(same))
    size = entries.agg(F.sum(F.length(F.to_json(F.struct("_k", "_e"))))).first()[0] or 0
    found = items.join(F.broadcast(entries) if size <= SENT_BYTES else entries, "_k", "left")
    item = F.when(F.col("_pos").isNotNull() & (F.col("_copy") == 1), F.struct("_pos", "_k", "_e"))
    whole = at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return found.select("*", F.collect_list(item).over(whole).alias("_all"), F.row_number().over(at).alias("_turn"))


def lookup_list(df: DataFrame, id_col: str, list_col: str, names: DataFrame, key: str, value: str, default: str | None, out: str, order: str | None = None) -> DataFrame:
    """``out``: the values of the list's items in order, ``default`` where the dictionary lacks one; empty stays empty.

    Values of one key follow each other, those with the greatest ``order`` first (without it, the least value first).
    """
    entry = F.struct(F.col(order or value).alias("o"), F.coalesce(value, F.lit(default)).alias("v"))
    entries = names.groupBy(F.col(key).alias("_k")).agg(F.transform(F.sort_array(F.collect_list(entry), asc=order is None), lambda x: x["v"]).alias("_e"))
    rows = _entries_in_order(df, list(dict.fromkeys((id_col, list_col))), list_col, entries).where("_pos is null or _pos = 0")
    values = F.flatten(F.transform("_all", lambda x: F.coalesce(x["_e"], F.array(F.lit(default).cast("string")))))
    return rows.select(*(c for c in df.columns if c != out), values.alias(out))


def lookup_fallback(df: DataFrame, key: str, dictionaries: Sequence[DataFrame], out: str, dict_key: str = "key", dict_value: str = "value") -> DataFrame:
    """The first dictionary's value that is there, else null."""
    cols = []
    for i, d in enumerate(dictionaries):
        df = df.join(d.select(F.col(dict_key).alias(key), F.col(dict_value).alias(f"_v{i}")), key, "left")
        cols.append(f"_v{i}")
    return df.withColumn(out, F.coalesce(*cols)).drop(*cols)


#: (prefix length or None for the whole code, root) in order of preference.
CASCADE = [(None, "cm"), (None, "pcs"), (6, "pcs"), (5, "cm"), (4, "pcs"), (3, "cm")]


def prefix_cascade(codes: DataFrame, code_col: str, nodes: DataFrame, steps: Sequence[tuple[int | None, str]] = tuple(CASCADE)) -> DataFrame:
    """Per distinct code the node (name, root) of the first step that has one; none gives nulls.

    ``nodes``: columns name and root.
    """
    wanted = codes.select(F.col(code_col).alias("code")).distinct()
    tries = [wanted.select("code", (F.col("code") if n is None else F.substring("code", 1, n)).alias("name"), F.lit(root).alias("root"), F.lit(i).alias("prio")) for i, (n, root) in enumerate(steps)]
    hits = reduce(DataFrame.unionByName, tries).join(nodes.select("name", "root").distinct(), ["name", "root"])
    best = hits.groupBy("code").agg(F.min(F.struct("prio", "name", "root")).alias("b")).select("code", "b.name", "b.root")
    return wanted.join(best, "code", "left")


def longest_prefix(codes: DataFrame, code_col: str, known: DataFrame, known_col: str, least: int = 1) -> DataFrame:
    """Per distinct code the longest known code that it starts with; none gives null."""
    wanted = codes.select(F.col(code_col).alias("code")).distinct()
    tries = wanted.where(F.length("code") >= least).select("code", F.explode(F.transform(F.sequence(F.lit(least), F.length("code")), lambda n: F.substring("code", F.lit(1), n))).alias("prefix"))
    hits = tries.join(known.select(F.col(known_col).alias("prefix")).distinct(), "prefix")
    best = hits.groupBy("code").agg(F.max_by("prefix", F.length("prefix")).alias("mapped"))
    return wanted.join(best, "code", "left")


def first_by_code(df: DataFrame, id_col: str, list_col: str, terms: DataFrame, term_id: str, code: str, order: str | None = None) -> DataFrame:
    """Data of a list of term ids in order, the first term of each code only.

    Of rows with one term and code, that with the greatest ``order`` counts (without it, the least row).
    """
    rest = [c for c in terms.columns if c not in (term_id, code)]
    row = F.struct(F.lit(0).alias("_least"), *rest)
    best = terms.groupBy(F.col(term_id).alias("_k"), F.col(code).alias("_c")).agg((F.max_by(row, order) if order else F.min(row)).alias("_r"))
    entries = best.groupBy("_k").agg(F.collect_list(F.struct("_c", "_r")).alias("_e"))
    rows = _entries_in_order(df.select(id_col, list_col), [id_col], list_col, entries).where("_turn = 1")
    flat = F.flatten(F.transform("_all", lambda x: F.transform(F.coalesce(x["_e"], F.array().cast(entries.schema["_e"].dataType)), lambda e: F.struct(e["_c"].alias("c"), x["_pos"].alias("pos"), x["_k"].alias("k"), e["_r"].alias("r")))))
    ordered = rows.select(id_col, F.sort_array(flat).alias("_s"))
    first = F.filter("_s", lambda x, i: (i == 0) | ~x["c"].eqNullSafe(F.try_element_at("_s", F.greatest(i, F.lit(1)))["c"]))
    found = ordered.select(id_col, F.explode(first).alias("f"))
    return found.select(id_col, F.col("f.c").alias(code), "f.pos", F.col("f.k").alias(term_id), *(F.col("f.r")[c].alias(c) for c in rest))
