"""Sweeps, passages and fuzzy names against plain versions."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from chartloom.operators import fuzzy, intervals
from chartloom.plans import catalog, retrieval  # noqa: F401

DATA = "/root/testdata/sf0.001"


def overlaps(left, right):
    good = lambda r: None not in r[:3] and r[2] >= r[1]
    return sorted((a[0], a[3], b[3]) for a in left for b in right if good(a) and good(b) and a[0] == b[0] and a[1] < b[2] and b[1] < a[2])


def pairs(spark, left, right, width):
    df = lambda rows, key: spark.createDataFrame(rows, f"doc string, start int, end int, {key} string").repartition(3)
    return sorted(tuple(r) for r in intervals.overlap_pairs(df(left, "seg"), df(right, "code"), "doc", "seg", "code", width).collect())


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_overlap_pairs(spark, width):
    """Nested, touching, empty, reversed and repeated intervals, before 0 too, over many bins; nulls."""
    rng = random.Random(width)
    side = lambda n: [(rng.choice("ab"), s, s + rng.choice([0, 0, 1, 3, 10, 60, -2]), f"k{i % 40}") for i in range(n) for s in [rng.randint(-20, 60)]]
    left, right = side(70), side(60)
    odd = [(None, 1, 5, "x"), ("a", None, 5, "x"), ("a", 1, None, "x"), ("only", 1, 5, "x")]
    assert pairs(spark, left + odd, right + odd[:3], width) == overlaps(left, right)
    assert pairs(spark, [], right, width) == []


def test_one_long_document_is_swept_in_linear_time(spark):
    """100,000 segments and 100,000 spans of one document, and a few spans over all of it."""
    n = 100_000
    segs = spark.range(n, numPartitions=4).selectExpr("'d' AS doc", "id * 40 AS start", "id * 40 + 40 AS end", "id AS seg")
    spans = spark.range(n, numPartitions=4).selectExpr("'d' AS doc", "id * 40 + 10 AS start", "id * 40 + 50 AS end", "concat('c', id % 10) AS code")
    whole = spark.range(3).selectExpr("'d' AS doc", f"0L AS start", f"{40 * n}L AS end", "concat('w', id) AS code")  # noqa: F541
    began = time.time()
    got = intervals.segment_targets(segs, spans.unionByName(whole), "doc", "seg")
    assert got.where("size(targets) = 5").count() == n - 1 and got.count() == n
    assert time.time() - began < 60


def test_places_of_passages(spark):
    """Places that overlap, passages inside passages, equal passages, code points beyond 16 bits, empty and null texts."""
    rng = random.Random(4)
    say = lambda n: "".join(rng.choice(["aa", "b", " ", "é", "\U0001f600", "a b"]) for _ in range(n))
    docs = [(i, say(rng.randint(0, 80))) for i in range(30)] + [(90, None), (91, ""), (92, "aaaaaa " * 300)]
    items = [(f"p{i}", p) for i, p in enumerate(["a", "aa", "aaa", "b\U0001f600", "a b", "a b", say(9), say(4), " ", "", None, "aaaaaa aaaaaa aaaaaa aaaaaa aaaaaa aaaaaa aaaaaa aaaaaa aaaaaa"])]
    want = sorted((d, p, i, i + len(t)) for d, text in docs for p, t in items if text and t for i in range(len(text) - len(t) + 1) if text.startswith(t, i))
    got = intervals.passage_places(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item string, passage string"), "doc_id", "text", "item", "passage")
    assert sorted(tuple(r) for r in got.collect()) == want


# ---- fuzzy names -------------------------------------------------------------------------
def names(n, seed):
    rng = random.Random(seed)
    roots = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(3, 18))) for _ in range(max(2, n // 6))]
    out = []
    for _ in range(n):
        t = list(rng.choice(roots))
        for _ in range(rng.randint(0, 4)):
            if t and rng.random() < 0.5:
                del t[rng.randrange(len(t))]
            else:
                t.insert(rng.randint(0, len(t)), rng.choice("abcdefgh"))
        out.append("".join(t))
    return out


def plain_terms(queries, terms, limit):
    out = set()
    for q in {q for q in queries if q is not None}:
        best = sorted((-round(fuzzy.indel_ratio(fuzzy.processed(q), fuzzy.processed(t or "")), 6), i) for i, t in terms)[:limit]
        out |= {(q, i, -s, r) for r, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("most", [10**9, 6, 0])
def test_find_terms(spark, monkeypatch, most):
    """Both ways: by segments first, by blocks alone, and some of each; short, empty, null and repeated names."""
    monkeypatch.setattr(fuzzy.signature_pairs, "__defaults__", (most,))
    titles = [*names(150, 1), "", "a", "A!", None, "b", "the same", "The Same", "the-same", "the same"]
    terms = [(f"t{i:03}", t) for i, t in enumerate(titles)]
    queries = [*names(40, 1), *names(20, 2), "", "a", "ab", "the same", "THE SAME", None, titles[0], titles[0]]
    got = fuzzy.find_terms(spark.createDataFrame([(q,) for q in queries], "q string"), "q", spark.createDataFrame(terms, "id string, title string"), "id", "title", 4, query_block=9, title_block=20)
    assert {tuple(r) for r in got.collect()} == plain_terms(queries, terms, 4)


@pytest.mark.parametrize("d", [0, 1, 2, 3])
def test_segments_find_every_near_pair(spark, d):
    a, b = sorted(set(names(80, 7))), sorted(set(names(120, 7)) | {"", "x"})
    df = lambda rows, c: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    looked, got = fuzzy.signature_pairs(df(a, "q"), df(b, "t"), d, 10**9)
    found = {tuple(r) for r in got.collect()}
    lcs = lambda x, y: round(fuzzy.indel_ratio(x, y) * (len(x) + len(y)) / 200)
    assert {(x, y) for x in a for y in b if len(x) + len(y) - 2 * lcs(x, y) <= d} <= found and looked.count() == len(a)
    assert len(found) < 0.5 * len(a) * len(b)


def test_few_pairs_are_compared(spark):
    """Of names in blocks only those whose letters may reach the best are compared."""
    a, b = sorted(set(names(60, 3))), sorted(set(names(400, 3)))
    q, t = spark.createDataFrame([(x,) for x in a], "q string"), spark.createDataFrame([(x, i) for i, x in enumerate(b)], "t string, id int")
    tried = fuzzy._nearest_in_blocks(q, t, 3, 512, 8192).agg(F.sum("tried")).first()[0]
    assert tried < 0.25 * len(a) * len(b)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_fuzzy_names(spark):
    """All customers against a plain search."""
    terms = [(r["c_custkey"], r["c_name"]) for r in spark.read.parquet(f"{DATA}/customer.parquet").collect()]
    got = {(r["query"], r["c_custkey"], r["score"], r["rank"]) for r in catalog.QUERIES["fuzzy_names"](spark, DATA).collect()}
    assert got == plain_terms([n for k, n in terms if k % 20 == 0], terms, 3) and got
