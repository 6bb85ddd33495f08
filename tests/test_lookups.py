"""Dictionaries with several entries a key, against plain versions."""

import os
import random

import pytest

from chartloom.operators import lookups
from chartloom.plans import catalog, more  # noqa: F401
from tests.compare import same, tables

DATA = "/root/testdata/sf0.001"


def entries(rng, n):
    """k, v, o: keys with none to many entries, null keys and null values."""
    return [(rng.choice([None, *"abcdefgh"]), rng.choice([None, "x", "y", "z"]), i) for i in range(n)]


def rows(rng, n):
    return [(rng.choice([None, *range(n)]), rng.choice([[], None, rng.sample("abcdefghij", rng.randint(1, 9)), ["a", None, "a"]])) for _ in range(n)]


def moved_after_join(df):
    """Shuffles and sorts between the meeting with the dictionary and the result."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    join = next(i for i, line in enumerate(plan) if "BroadcastHashJoin" in line)
    return [line for line in plan[:join] if "Exchange" in line or "Sort " in line]


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_lookup_list_with_many_entries(spark, monkeypatch, sent):
    """Each row has its own list's values, the latest entry of a key first; null and empty lists stay, as do equal rows."""
    monkeypatch.setattr(lookups, "SENT_BYTES", sent)
    rng = random.Random(3)
    names, data = entries(rng, 60), rows(rng, 40)
    data += data[:5]
    of = {k: [v or "none" for _, v in sorted(((o, v) for key, v, o in names if key == k), reverse=True)] for k in "abcdefghij"}
    want = [(i, [v for k in x or [] for v in (of.get(k) or ["none"])]) for i, x in data]
    df = spark.createDataFrame(data, "id int, codes array<string>").repartition(3)
    got = lookups.lookup_list(df, "id", "codes", spark.createDataFrame(names, "k string, v string, o int").repartition(3), "k", "v", "none", "out", order="o")
    assert sorted(((r["id"], r["out"]) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_entries_are_not_moved(spark):
    """A result that is a hundred times its lists is neither shuffled nor sorted, as lists times entries would fill the disks."""
    names = spark.range(20_000).selectExpr("cast(id % 200 as string) as k", "concat('value ', id) as v", "id as o")
    ids = spark.range(5000).selectExpr("id % 1000 as id", "cast(id % 200 as string) as code")
    lists = catalog.cohort.code_lists(ids, "id", "code")
    out = lookups.lookup_list(lists, "id", "codes", names, "k", "v", "none", "out")
    assert not moved_after_join(out) and out.selectExpr("sum(size(out))").first()[0] == sum(len(r["codes"]) for r in lists.collect()) * 100


# ---- first by code ----------------------------------------------------------------------------------
@pytest.mark.parametrize("sent", [0, 1 << 20])
@pytest.mark.parametrize("order", [None, "o"])
def test_first_by_code_with_many_entries(spark, monkeypatch, order, sent):
    """Of a term's rows with one code the latest counts; null codes are one code; lists of one id are one."""
    monkeypatch.setattr(lookups, "SENT_BYTES", sent)
    rng = random.Random(5)
    terms, data = [(k, rng.choice([None, "c", "d"]), v, o) for k, v, o in entries(rng, 60)], [r for r in rows(rng, 40) if r[0] is not None]
    best = {}
    for i, x in data:
        for pos, k in enumerate(x or []):
            for t, c, v, o in terms:
                if t is not None and t == k:
                    rank = (pos, k, (-o,) if order else (v is not None, v or "", o))
                    new = (rank, (i, c, pos, k, v, o))
                    best[i, c] = min(best.get((i, c), new), new, key=lambda p: p[0])
    df = spark.createDataFrame(data, "id int, codes array<string>").repartition(3)
    got = lookups.first_by_code(df, "id", "codes", spark.createDataFrame(terms, "t string, code string, v string, o int").repartition(3), "t", "code", order)
    assert got.columns == ["id", "code", "pos", "t", "v", "o"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted((row for _, row in best.values()), key=repr)


def test_first_entries_are_not_moved(spark):
    terms = spark.range(20_000).selectExpr("cast(id % 200 as string) as t", "cast(id div 200 as string) as code", "concat('value ', id) as v")
    lists = catalog.cohort.code_lists(spark.range(5000).selectExpr("id % 1000 as id", "cast(id % 200 as string) as code"), "id", "code")
    out = lookups.first_by_code(lists, "id", "codes", terms, "t", "code")
    assert not moved_after_join(out) and out.count() == 1000 * 100


# ---- keys above 99,999, which are cut to five digits --------------------------------------------------
def cut_keys(spark, path):
    """Ten parts a code, four of them of one brand, and orders of up to two codes, so no list has 24 titles."""
    spark.range(100_000, 100_400).selectExpr("id as p_partkey", "concat('Brand#', id % 3) as p_brand", "concat('TYPE ', id % 7) as p_type", "cast(20 as int) as p_size").coalesce(1).write.parquet(f"{path}/part.parquet")
    spark.range(3000).selectExpr("id div 2 as l_orderkey", "100000 + id * 37 % 400 as l_partkey", "'A' as l_returnflag", "cast(1 as int) as l_linenumber").coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["first_by_code", "desc_lookup_default"])
def test_codes_that_parts_share(spark, tmp_path, name):
    d = cut_keys(spark, tmp_path)
    same(catalog.QUERIES[name](spark, d), tables(d), catalog.SQL[name])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", ["first_by_code", "desc_lookup_default"])
def test_queries_do_not_move_entries(spark, name):
    assert not moved_after_join(catalog.QUERIES[name](spark, DATA))
