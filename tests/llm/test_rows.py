"""Rows with repeated ids, null ids and clashing columns; odd and long texts; features and rates against plain versions."""

import random
import re
import time

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chartloom.llm import audio, chunk_bpe, exact_dedup, mixing, ngram_join, toxicity

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
# names that the operators and Spark's models use inside
CLASHING = "doc_id long, text string, features string, score string, row_key string, kept string, n string, fate_id string, prediction string, id string, key string, whole_row string"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, *"abcdefghij") for i, t in rows], CLASHING)


# ---- 1 and 6 ----------------------------------------------------------------------------------
def test_prefix_counts_of_odd_chunks():
    """White space of all kinds, special strings, composing characters, control characters, final sigma."""
    bpe, lib = chunk_bpe.ChunkBpe(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    rng = random.Random(2)
    alphabet = [*"aabcdehilnorst'réñßÉİΣς,.&1²\t\n -ſKÅ", "　", "́", "̧", "ᄀ", "ᅡ", "ᆨ", " ", " ", "​", "া", "\x1c", "\x00", "'re", "'ll", "<|endoftext|>", "<|startoftext|>", "<|endof", "漢字"]
    for _ in range(800):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        width, table = bpe.prefix_table(text)
        want = [len(lib.encode(text[:i], add_special_tokens=False).ids) for i in range(1, len(text) + 1)]
        assert np.cumsum(np.frombuffer(table, "i1" if width == 1 else "<i4")).tolist() == want, text
        assert bpe.text_ids(text) == np.array(lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_by_pieces_equal_the_library():
    """Plain text goes by pieces, chunks with odd characters whole; both give the library's ids."""
    bpe = chunk_bpe.ChunkBpe(VOCABULARY)
    rng = random.Random(8)
    alphabet = "aAzZ  \n\t'’sStTrReEvVlLmMdD019.,$#éÉßÄİıſŉǅΣσς<|>́\x1c\x00\x85\xa0ʼł\xad²½ªʰ中한🙂"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["", "IT'S we'Re ''s 'sé l'été", "a <|endoftext|> b\x85c", "É" * 5000, "plain words, “quoted” ones.\nAnd more."]
    plain = [bpe.lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in bpe.all_ids(texts)] == plain
    assert bpe.counts(texts) == [len(ids) for ids in plain]


def test_long_odd_texts_take_linear_time():
    bpe, lib, rng = chunk_bpe.ChunkBpe(VOCABULARY), Tokenizer.from_file(VOCABULARY), random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    texts = {
        "tabs": "\t".join(rng.choice(words) for _ in range(40_000)),
        "wide blanks": "　".join(rng.choice(words) for _ in range(40_000)),
        "marks": "".join(rng.choice(["é", "à", "o"]) for _ in range(20_000)),
        "letters": "".join(rng.choice("abcdefgh") for _ in range(40_000)),
        "specials": "<|endoftext|>ab" * 3_000,
    }
    for name, text in texts.items():
        began = time.process_time()
        width, table = bpe.prefix_table(text)
        assert time.process_time() - began < 40, name
        counts = np.cumsum(np.frombuffer(table, "i1" if width == 1 else "<i4"))
        for k in [*(rng.randint(1, 5_000) for _ in range(6)), len(text)]:
            assert counts[k - 1] == len(lib.encode(text[:k], add_special_tokens=False).ids), (name, k)


def test_memos_stay_bounded():
    memo = chunk_bpe.Memo(40_000)
    for i in range(5_000):
        (key,) = memo.missing({f"w{i}"})
        memo.put(key, b"1234")
        assert memo.missing({f"w{i}", f"w{max(0, i - 5)}"}) == set()
    assert len(memo.new) + len(memo.old) < 250


# ---- 2 ------------------------------------------------------------------------------------------
def test_toxicity_features_against_a_plain_version(spark):
    terms = ["scum", "^wretc"]
    texts = ["You scum! WRETCHED you", "a$$ sc0um 5cum scuuum ???", "", None, "x" * 5_000, "du bist scum, " * 30]
    docs = rows_of(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r["features"] for r in toxicity.dense_features(docs, terms).collect()}
    you = toxicity.SECOND_PERSON
    for i, text in enumerate(texts):
        chunks = (text or "").split()
        core = ["".join(c for c in w.lower() if c.isalpha()) for w in chunks]
        lex, beg = [c == "scum" for c in core], [len(c) >= 5 and c[:5] == "wretc" for c in core]
        n, size = max(1, len(chunks)), max(1, len((text or "").encode()))
        row = dict(zip(toxicity.FEATURES, got[i], strict=True))
        assert row["lexicon_hits"] == sum(lex) and row["beginning_hits"] == sum(beg)
        assert np.isclose(row["lexicon"], sum(lex) / n) and np.isclose(row["second_person"], sum(c in you for c in core) / n)
        assert np.isclose(row["capitals"], len(re.findall("[A-Z]", text or "")) / size) and np.isclose(row["digits"], len(re.findall("[0-9]", text or "")) / size)
        hidden = [not a and bool(set(w.lower()) & set("0134578@$!")) and "".join(c for c in w.lower().strip(".,;:!?\"'()[]").translate(toxicity.LOOK_ALIKES) if c.isalpha()) == "scum" for a, w in zip(lex, chunks, strict=True)]
        hit = [a or b or c for a, b, c in zip(lex, beg, hidden, strict=True)]
        near = sum(any(core[j] in you for j in range(max(0, k - 5), min(len(core), k + 6))) for k, h in enumerate(hit) if h)
        assert np.isclose(row["near_second_person"], near / n), (text, row)


# ---- 3 ------------------------------------------------------------------------------------------
def test_resampling_against_direct_convolution():
    rng = np.random.default_rng(1)
    x = rng.normal(size=900).astype(np.float32)
    y = audio.resample(x, 16_000, 10_000)
    assert len(y) == -(-900 * 10 // 16) and np.isfinite(y).all()
    # linear and nearly the identity on a slow signal
    slow = np.sin(np.arange(900) / 60).astype(np.float32)
    z = audio.resample(slow, 16_000, 10_000)
    want = np.sin(np.arange(len(z)) * 1.6 / 60)
    assert np.abs(z[60:-60] - want[60:-60]).max() < 0.02
    assert np.allclose(audio.resample(x + slow, 16_000, 10_000), y + z, atol=1e-4)


# ---- 5 ------------------------------------------------------------------------------------------
def test_rates_against_a_plain_projected_gradient(spark):
    """Infeasible targets: the residual is as small as that of a plain gradient with many steps on the same posteriors."""
    rng = random.Random(3)
    kinds = {"a": "aeiou ", "b": "bcdfg ", "c": "xyzw "}
    rows = [(i, "".join(rng.choice(kinds["abc"[(i % 10 > 5) + (i % 10 > 7)]]) for _ in range(120))) for i in range(200)]
    known = spark.createDataFrame([(i, "abc"[(i % 10 > 5) + (i % 10 > 7)]) for i in range(0, 200, 2)], "doc_id long, domain string")
    model, members = mixing.fit_mixing(rows_of(spark, rows), known, {"a": 1.0, "b": 1.0}, budget=1.5, floor=0.5, iterations=300, tolerance=1e-9)
    got = mixing.with_rates(model, members).toPandas()
    n, p = got["n_tokens"].to_numpy(float), np.stack(got["posterior"])
    gap = lambda r: np.abs((r * n) @ p - model.targets)
    r, step = np.ones(len(n)), 1 / np.linalg.norm((p * n[:, None]).T @ (p * n[:, None]), 2)
    for _ in range(20_000):
        r = np.maximum(0.5, r - step * n * (p @ ((r * n) @ p - model.targets)))
    mine = got["rate"].to_numpy()
    assert (mine >= 0.5).all() and gap(mine).max() <= gap(r).max() + 0.02 * n.sum()
    assert np.allclose([model.off[d] for d in model.classifier.domains], ((mine * n) @ p - model.targets) / model.targets.sum(), atol=1e-6)


# ---- pipeline stages by rows ---------------------------------------------------------------------
def kept(df):
    return sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in df.collect()), key=repr)


def test_copies_go_by_row(spark):
    rows = [(3, "a"), (5, "a"), (5, "b"), (None, "a"), (7, "c  d"), (7, "c  d"), (8, "c d"), (9, None), (10, ""), (None, "only")]
    docs = rows_of(spark, rows)
    out = exact_dedup.without_copies(docs)
    assert out.columns == docs.columns
    assert kept(out) == sorted([(3, "a"), (5, "b"), (7, "c  d"), (9, None), (-1, "only")], key=repr)
    assert exact_dedup.without_copies(rows_of(spark, [])).count() == 0


def test_near_copies_go_by_row(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(80)]
    near = [*base[:79], "other"]
    rows = [(3, " ".join(base)), (5, " ".join(near)), (5, "alone in its group of words"), (6, " ".join(base).upper()), (None, " ".join(base)), (9, None), (10, ""), (11, "x y"), (11, "x y")]
    docs = rows_of(spark, rows)
    out = ngram_join.without_near_copies(docs)
    assert out.columns == docs.columns
    assert kept(out) == sorted([(3, rows[0][1]), (5, rows[2][1]), (9, None), (10, ""), (11, "x y")], key=repr)
    assert ngram_join.without_near_copies(rows_of(spark, [])).count() == 0
    named = docs.where("doc_id is not null").select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 3, "0")).alias("doc_id"), "text")
    assert {r["component_id"] for r in ngram_join.ngram_components(named, 5, 80, 100).collect()} == {"d003", "d005", "d009", "d010", "d011"}


def test_stages_on_odd_rows(spark, tmp_path):
    """All stages on nulls, empty texts, repeated ids and clashing names, and on an empty table."""
    import corpus_pipeline

    home = str(tmp_path)
    rows = [(3, "a b c"), (5, "a b c"), (5, "b"), (None, "a b c"), (9, None), (10, ""), (11, "é" * 3_000), (11, "é" * 3_000)]
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 1), (None, None, None), (11, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{home}/labels.parquet")
    for rows_, least in ((rows, 4), ([], 0)):
        docs = rows_of(spark, rows_).withColumn("lang", F.lit("en"))
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, home)
            if name != "packing":
                assert out.columns == columns, name
                docs = out
            assert out.count() >= least
