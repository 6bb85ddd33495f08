"""Recall of the line signatures, totals in real tokens, deduplication over runs."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chartloom.llm import chunk_bpe, exact_dedup, line_dedup, mixing, ngram_join

DOCS = "doc_id long, text string"


# ---- 10 ---------------------------------------------------------------------------------------
def test_line_signatures_reach_the_stated_recall(spark):
    """Pairs of lines at similarity 0.8 by their 5-character shingles share a band in 99 of 100 cases."""
    rng, lines, pairs = random.Random(11), [], 3000
    for i in range(pairs):
        head, a, b = ("".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(n)) for n in (164, 20, 20))
        lines += [(2 * i, head + a), (2 * i + 1, head + b)]  # 160 shingles shared, 20 on each side
    sig = line_dedup.signatures(spark.createDataFrame(lines, "h long, line string").repartition(8)).collect()
    of = {r["h"]: [r[f"m{i}"] for i in range(len(line_dedup.MASKS))] for r in sig}
    met = sum(any(all(of[2 * i][c] == of[2 * i + 1][c] for c in band) for band in line_dedup.BANDS) for i in range(pairs))
    assert met >= 0.99 * pairs


# ---- 5 ----------------------------------------------------------------------------------------
def test_mixing_meets_targets_in_tokens(spark):
    """Domains with different numbers of tokens in a word: the rated tokenizer's totals meet the targets."""
    rng = random.Random(4)
    words = {"plain": ["the", "house", "water", "people"], "rare": ["xqzvkjw", "zzqxwvkk", "qjxvzwkqpz", "vkxqzz"]}
    rows, labels = [], []
    for i in range(200):
        kind = ("plain", "rare")[i % 2]
        rows.append((i, " ".join(rng.choice(words[kind]) for _ in range(rng.randint(20, 60)))))
        labels.append((i, kind))
    rows.append((900, "x" * 3000))  # a long text without blanks
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, domain string")
    model, members = mixing.fit_mixing(docs, known, {"plain": 0.5, "rare": 0.5})
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in rows}
    got = mixing.with_rates(model, members).collect()
    assert {r["id"]: r["n_tokens"] for r in got} == n
    totals = sum(r["rate"] * n[r["id"]] * np.array(r["posterior"]) for r in got)
    assert np.allclose(totals, sum(n.values()) / 2, rtol=1e-3)


# ---- 9 ----------------------------------------------------------------------------------------
def test_exact_dedup_over_two_runs(spark, tmp_path):
    """A later call with the same home groups its rows with those of the earlier one."""
    first = [(5, "a b"), (6, "c"), (7, "c"), (8, None), (9, "alone")]
    later = [(1, "c"), (20, "a  b"), (21, "a\tb"), (22, ""), (23, "new"), (24, "new"), (25, "single")]
    home, seen = f"file://{tmp_path}/home", []
    for part in (first, later):
        seen += [(i, " ".join((t or "").split())) for i, t in part]
        want = []
        for i, _ in part:
            same = [j for j, t in seen if t == dict(seen)[i]]
            want.append((i, min(same), len(same), i == min(same)))
        got = exact_dedup.exact_dedup(spark.createDataFrame(part, DOCS), home=home).collect()
        assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == sorted(want)


# ---- 8 ----------------------------------------------------------------------------------------
def test_a_crowded_family_takes_few_rounds(spark, monkeypatch):
    """200 sets of which none link, all in one group: the sets that face the rest multiply from round to round."""
    schema = "key long, id long, n long, lo double, hi double"
    large = spark.createDataFrame([(1, i, 40, 0.5, 0.5) for i in range(200)], schema)
    sketches = spark.createDataFrame([(i, 40, [0] * 32) for i in range(200)], "id long, n long, sketch array<long>")
    few = ngram_join._Verifier(sketches, None, 3, 90, 100, 1)
    few.sets = spark.createDataFrame([(i, [i * 100 + j for j in range(40)]) for i in range(200)], "id long, shingles array<long>")
    few.done = spark.createDataFrame([], "a long, b long, lo double, hi double, link boolean")
    monkeypatch.setattr(ngram_join, "SMALL", 2)
    faces, rounds = 2, 0
    while large.limit(1).count():
        large, faces, rounds = few.across(large, faces), faces * 4, rounds + 1
    assert rounds <= 5
    pairs = {(r["a"], r["b"]) for r in few.done.collect()}
    assert len(pairs) == 200 * 199 // 2  # all were compared


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_a_crowded_family_takes_pairs_in_proportion(spark, monkeypatch, k, num):
    """Sets about two centres, at all distances: those near to one link by their differences from it, the others meet few."""
    monkeypatch.setattr(ngram_join, "SMALL", 4)
    rng = random.Random(k)
    sets = {}
    for i in range(200):
        own = [1000 * (i % 4 == 0) + j for j in range(120)]
        for edit in range(rng.choice([0, 1, 2, 2, 3, 4, 6])):
            at = rng.randrange(120 - k)
            own[at : at + k] = [10_000 * rng.choice([1, 1, 2, i + 3]) + at + j for j in range(k)]
        sets[i] = sorted(set(own[: rng.choice([120, 120, 118])]))
    n = {i: len(s) for i, s in sets.items()}
    few = ngram_join._Verifier(spark.createDataFrame([(i, n[i], [0] * 32) for i in sets], "id long, n long, sketch array<long>"), None, k, num, 100, 1)
    few.sets = spark.createDataFrame(list(sets.items()), "id long, shingles array<long>")
    few.done = spark.createDataFrame([], "a long, b long, lo double, hi double, link boolean")
    large = spark.createDataFrame([(1, i, n[i], 0.0, 1.0) for i in sets], "key long, id long, n long, lo double, hi double")
    for _ in range(ngram_join.PIVOTS):
        if large.limit(1).count():
            large = few.apart(large)
    assert not large.limit(1).count()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in range(a):
            both = len(set(sets[a]) & set(sets[b]))
            if 100 * both >= num * (n[a] + n[b] - both):
                root[max(top(a), top(b))] = min(top(a), top(b))
    found = {r["node"]: r["component"] for r in ngram_join.connected_components(few.links()).collect()}
    assert {i: found.get(i, i) for i in sets} == {i: top(i) for i in sets}
    assert few.done.count() < 200 * 20  # of 19,900 pairs


def test_groups_that_share_sets_are_told_apart_once(spark, monkeypatch):
    """Sets near one centre, in one group or in nine overlapping ones of two families: the keys add no rows."""
    monkeypatch.setattr(ngram_join, "SMALL", 4)
    rng = random.Random(8)
    sets = {i: sorted({10_000 * (j in own) * (i % 5 + 1) + 1000 * (i >= 30) + j for j in range(60)}) for i in range(60) for own in [rng.sample(range(60), rng.choice([1, 3, 5]))]}
    wrote = {}

    def links(keys):
        few = ngram_join._Verifier(spark.createDataFrame([(i, 60, [0] * 32) for i in sets], "id long, n long, sketch array<long>"), None, 3, 90, 100, 1)
        few.sets = spark.createDataFrame(list(sets.items()), "id long, shingles array<long>")
        few.done = spark.createDataFrame([], "a long, b long, lo double, hi double, link boolean")
        put = few.put

        def counted(df, name, path=None):
            out = put(df, name, path)
            wrote.setdefault(name, []).append(out.count() if name == "ngram-differ" else None)
            return out

        few.put = counted
        rows = [(k, i, 60) for i in sets for k in keys(i)]
        large = few.apart(spark.createDataFrame(rows, "key long, id long, n long"), whole=True)
        while large.limit(1).count():
            large = few.across(large, 1000)
        return {r["node"]: r["component"] for r in ngram_join.connected_components(few.links()).collect()}

    half = lambda i: i // 30
    assert links(lambda i: [half(i)]) == links(lambda i: [half(i), *(10 + 10 * half(i) + j for j in range(7) if (i + j) % 4)])
    assert wrote["ngram-differ"][0] == wrote["ngram-differ"][1]


# ---- 1 ----------------------------------------------------------------------------------------
def test_prefix_counts_try_only_lengths_that_tokens_have():
    bpe = chunk_bpe.ChunkBpe(public_tokenizers.path("word_bpe_49k.json"))
    numbers, lengths = bpe.ending
    for s in [*bpe.inner, *bpe.final]:
        assert numbers[s] == (bpe.inner.get(s), bpe.final.get(s)) and len(s) in lengths[s[-3:]]
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdluzq") for _ in range(rng.randint(1, 20))) for _ in range(200)]
    for word, counts in bpe._piece_counts(words).items():
        assert counts == bpe._library_counts(word)


def test_sketches_tell_unlike_lines_and_lose_no_link(spark, monkeypatch):
    """Of lines of one vocabulary that share bands, few have their texts compared; lines that link are never ruled out."""
    rng, compared, real = random.Random(8), [], line_dedup._similar
    parts = [a + b for a in "bcdfgklmnprst" for b in ("a", "e", "i", "on", "er")]
    lines = ["".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.choice([40, 150, 300, 500]))) for _ in range(300)]
    near = [t[: len(t) // 2] + "#" * rng.randint(1, 3) + t[len(t) // 2 + 2 :] for t in lines[:60]] + ["ab " * 30, "ab " * 90, "x", "xy"]
    sketches = line_dedup.signatures(spark.createDataFrame(list(enumerate(lines + near)), "h long, line string"))
    linker = line_dedup._Linker(None, sketches, 8, 10, None)
    pairs = spark.createDataFrame([(i, 300 + i) for i in range(60)] + [(360, 361)], "x long, y long")
    assert linker.sketched(linker.sketched(pairs, "x"), "y").where(linker.possible()).count() == 61

    def similar(pairs, *rest):
        compared.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(line_dedup, "_similar", similar)
    got = line_dedup.line_classes(spark.createDataFrame(list(enumerate(lines + near)), DOCS)).collect()
    cls = {r["id"]: r["class"] for r in got}
    assert sum(cls[i] == cls[300 + i] for i in range(60)) >= 58 and sum(compared) < 100
