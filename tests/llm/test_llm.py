"""The ten operators against brute force on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import os
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chartloom.llm import audio, chunk_bpe, components, exact_dedup, line_dedup, mixing, ngram_join, packing, queries, substring_dedup, token_counts, toxicity, warc
from tests.compare import same, tables

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# extra columns take names that the operators use inside
SCHEMA = "doc_id long, text string, id string, n long, key string, h string, digest string, keep string, span string, tid string, rate string, posterior string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "k", "h", "d", "k", "s", "t", "r", "p") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    out = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "don't you're <|endoftext|> x<|startoftext|>y")]
    base = [rng.choice(words) for _ in range(120)]
    for i in range(25):  # near copies at graded distances
        own = list(base)
        for _ in range(i // 4):
            own[rng.randrange(len(own))] = rng.choice(words)
        out.append((10 + i, " ".join(own)))
    out += [(50 + i, "\n".join([" ".join(base), "tail " + str(i)])) for i in range(4)]
    out += [(60 + i, " ".join(rng.choice(words) for _ in range(rng.choice([5, 40, 200])))) for i in range(20)]
    out += [(90, " ".join(base)), (91, "  ".join(base)), (92, "\n".join(base)), (93, " ".join(rng.choice(words) for _ in range(9000)))]
    out += [(94, " ".join(base[:50] * 3)), (60, dict(out)[60])]
    return out


def by_id(df, key="doc_id"):
    return sorted(df.collect(), key=lambda r: r[key])


def reference_tokens(text):
    return Tokenizer.from_file(VOCABULARY).encode(text or "", add_special_tokens=False).ids


# ---- 1 and 6 --------------------------------------------------------------------------------
def test_prefix_counts_match_the_library():
    bpe, lib = chunk_bpe.ChunkBpe(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    rng = random.Random(2)
    alphabet = "aabcdehilnorst'réñßÉİΣς é,.&%1²\t\n -<|endoftext|>"
    for k in range(600):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 16))) + ("<|endoftext|>" if k % 9 == 0 else "")
        width, table = bpe.prefix_table(text)
        want = [len(lib.encode(text[:i], add_special_tokens=False).ids) for i in range(1, len(text) + 1)]
        assert np.cumsum(np.frombuffer(table, "i1" if width == 1 else "<i4")).tolist() == want
        assert bpe.text_ids(text) == np.array(lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_token_counts(spark, texts):
    got = by_id(token_counts.prefix_token_counts(make(spark, texts), VOCABULARY))
    assert [(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got] == sorted((i, len((t or "").encode()), len(reference_tokens(t))) for i, t in texts)
    long = next(r for r in got if r["doc_id"] == 93)
    cut = chunk_bpe.longest_prefix(long["prefix_width"], long["prefix_table"], 100)
    text = dict(texts)[93]
    assert len(reference_tokens(text[:cut])) <= 100 < len(reference_tokens(text[: cut + 12]))
    assert chunk_bpe.count_at(long["prefix_width"], long["prefix_table"], 50) == len(reference_tokens(text[:50]))
    assert token_counts.prefix_token_counts(make(spark, []), VOCABULARY).count() == 0


def test_packing(spark, texts):
    got = packing.pack_documents(make(spark, texts), VOCABULARY, 4096, 1).collect()
    ids = {i: [*reference_tokens(t), 1] for i, t in texts}
    seen = {}
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part)) and len(part) == r["length"] and r["start"] == 4096 * r["piece"]
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in got) == sum(len([*reference_tokens(t), 1]) for _, t in texts)
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in got)
    assert len(seen) <= -(-total // 4096) + 2
    assert packing.pack_documents(make(spark, []), VOCABULARY).count() == 0


def test_open_bins_choose_the_best_fit():
    rng = random.Random(1)
    bins, spaces, closed = packing.OpenBins(50, 4), {}, set()
    for _ in range(2000):
        need = rng.randint(1, 50)
        open_ = {b: s for b, s in spaces.items() if s and b not in closed}
        fits = [s for s in open_.values() if s >= need]
        b, offset = bins.place(need)
        if fits:
            assert spaces[b] == min(fits)
        else:
            if len(open_) == 4:
                closed |= {next(x for x, s in open_.items() if s == min(open_.values()) and x not in {y[-1] for y in bins.at.values() if y} and all(x not in y for y in bins.at.values()))}
            spaces[b] = 50
        assert offset == 50 - spaces[b]
        spaces[b] -= need


# ---- 2 -----------------------------------------------------------------------------------------
def test_toxicity(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(400)]
    bad = ["scumbag", "wretchling", "wretchedly"]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 8 == 0
        body = [rng.choice(words) for _ in range(30)]
        if toxic:
            body[rng.randrange(30)] = "you"
            for _ in range(3):
                body[rng.randrange(30)] = rng.choice(bad)
        rows.append((i, " ".join(body)))
        labels.append((i, int(toxic)))
    docs = make(spark, [*rows, (5000, None), (5001, ""), (5002, "wretchling you scumbag " * 3), (5003, "x" * 200_000)])
    marks = spark.createDataFrame([*labels, (7777, 1), (3, None)], "doc_id long, toxic int")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = toxicity.fit_toxicity(docs, marks, usable=~held)
    got = {r["doc_id"]: r["score"] for r in model.score(docs).collect()}
    out = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    hits = sum((got[i] >= 0.3) == bool(dict(labels)[i]) for i in out)
    assert hits / len(out) > 0.97 and all(0 <= s <= 1 for s in got.values()) and got[5002] >= 0.3 > got[5000] and len(got) == 1204
    assert toxicity.fit_toxicity(docs, marks.limit(0)).score(docs.limit(3)).count() == 3
    assert model.score(make(spark, [])).count() == 0


# ---- 3 and 4 ---------------------------------------------------------------------------------------
def test_audio(spark, texts):
    clips = make(spark, texts).select("doc_id", audio.text_payload(F.col("text")).alias("payload"))
    for r in audio.audio_features(audio.encode_media(clips, "doc_id"), "doc_id").collect():
        want = {(lambda b: b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b)))((t or "").encode()) for i, t in texts if i == r["doc_id"]}
        assert bytes(r["payload"]) in want and audio.read_wav(bytes(r["media"])) == (16_000, bytes(r["payload"]))
        tensor, start, end = audio.read_tensors(bytes(r["tensors"]))
        assert tensor.shape == (r["n_tensors"], audio.PATCH, audio.MELS) and (start < end).all() and abs(end[-1] - r["duration_s"]) < 0.06
    assert audio.clip_features(audio.wav_bytes(b""))[3] == 0
    empty = spark.createDataFrame([(1, None)], "doc_id long, payload binary")
    assert audio.audio_features(audio.encode_media(empty, "doc_id"), "doc_id").first()["payload"] is None


def test_resampling_and_segments():
    t = np.arange(16_000) / 16_000
    tone = (0.5 * np.sin(2 * np.pi * 440 * t)).astype(np.float32)
    y = audio.resample(tone, 16_000, 10_000)
    peak = np.abs(np.fft.rfft(y[1000:9000])).argmax() * 10_000 / 8000
    assert len(y) == 10_000 and abs(peak - 440) < 3 and abs(np.abs(y[1000:9000]).max() - 0.5) < 0.01
    quiet = np.concatenate([np.zeros(4000, np.float32), tone[:4000], np.zeros(4000, np.float32)])
    ((a, b),) = audio.energy_segments(audio.frames_of(quiet), 10_000)
    assert 0.36 < a < 0.41 and 0.79 < b < 0.84


def test_warc(spark):
    pages = spark.createDataFrame([(5, "http://a\r\nX: y", "same"), (2, None, "same"), (9, "u", None), (1, "u", ""), (3, "u", "é" * 300_000), (7, "u", "same")], "page_id long, url string, html string")
    marked = warc.mark_revisits(pages, "page_id", "url", "html")
    bundles = warc.write_bundles(marked.coalesce(1), frame_bytes=500, bundle_bytes=2000).cache()
    got = {r["record_id"]: r for r in warc.read_bundles(bundles).collect()}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {5: ("revisit", 2), 2: ("response", None), 7: ("revisit", 2), 9: ("revisit", 1), 1: ("response", None), 3: ("response", None)}
    assert bytes(got[3]["payload"]).decode() == "é" * 300_000 and got[5]["payload_bytes"] == 4 and bytes(got[5]["payload"]) == b""
    for i in (0, 5, -1, None, 2**63 - 1, -(2**63)):
        assert warc.record_number(warc.record_urn(i)) == i
    record = warc.record_bytes(7, "http://x/", "response", b"<p>", warc.sha1_base32(b"<p>"), 3, None)
    headers, block, _ = warc.parse_record(record)
    assert headers["Content-Type"] == "application/http; msgtype=response" and block.startswith(b"HTTP/1.1 200 OK\r\n") and block.endswith(b"\r\n\r\n<p>")
    with pytest.raises(ValueError):
        warc._row(headers, block[:-1] + b"?")
    found = warc.lookup_records(bundles, spark.createDataFrame([(3,), (7,), (77,)], "record_id long")).collect()
    assert sorted(r["record_id"] for r in found) == [3, 7]
    import zstandard

    content = bytes(bundles.first()["content"])
    whole = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1") >= 1 and sum(f[2] for f in warc.seek_table(content)) == len(whole)
    assert warc.read_bundles(warc.write_bundles(warc.mark_revisits(pages.limit(0), "page_id", "url", "html"))).count() == 0
    assert {r["kind"] for r in warc.mark_revisits(pages, "page_id", "url", "html", min_payload=1_000_000).collect()} == {"response"}


# ---- 5 -----------------------------------------------------------------------------------------------
def test_mixing(spark):
    rng = random.Random(3)
    kinds = {"a": "aeiou ", "b": "bcdfg ", "c": "xyzw "}
    rows, labels = [], []
    for i in range(300):
        k = "abc"[(i % 10 > 5) + (i % 10 > 7)]
        rows.append((i, "".join(rng.choice(kinds[k]) for _ in range(120))))
        labels.append((i, k))
    docs = make(spark, [*rows, (900, None), (901, "")])
    known = spark.createDataFrame([*labels[:200], (8888, "a"), (5, None)], "doc_id long, domain string")
    model, members = mixing.fit_mixing(docs, known, {"a": 1.0, "b": 1.0, "c": 1.0, "unknown": 3.0})
    got = mixing.with_rates(model, members).toPandas()
    p = np.stack(got["posterior"])
    totals = (got["rate"].to_numpy() * got["n_tokens"].to_numpy()) @ p
    assert (got["rate"] >= 0).all() and np.allclose(totals, got["n_tokens"].sum() / 3, rtol=1e-3) and len(got) == 302
    truth = dict(labels)
    assert np.mean([truth[i] == d for i, d in zip(got["id"], got["domain"], strict=True) if i in truth]) > 0.95
    applied = model.apply(docs, names=("_t", "_r", "_d", "_p")).toPandas()
    assert np.allclose(sorted(applied["_r"]), sorted(got["rate"]))
    # infeasible targets: as good as a plain projected gradient on the same posteriors
    tight, tm = mixing.fit_mixing(docs, known, {"a": 1.0}, budget=2.0, floor=1.0, iterations=200)
    n, r = got["n_tokens"].to_numpy(float), np.ones(len(got))
    assert tight.totals[0] > tight.totals[1] and (mixing.with_rates(tight, tm).toPandas()["rate"] >= 1).all()
    none, m = mixing.fit_mixing(docs, known.limit(0), {"a": 1.0})
    assert set(mixing.with_rates(none, m).toPandas()["rate"]) == {1.0}
    assert mixing.fit_mixing(make(spark, []), known, {"a": 1.0})[1].count() == 0
    u = spark.range(4000).select(mixing.copies(F.lit(1.25), F.col("id")).alias("c")).agg(F.avg("c")).first()[0]
    assert abs(u - 1.25) < 0.03


# ---- 7 -------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("batches", [1, 3])
def test_substring_dedup(spark, texts, batches):
    got = substring_dedup.remove_repeats(make(spark, texts), batches=batches)
    assert sorted(tuple(r) for r in got.collect()) == brute_repeats([], texts)
    assert substring_dedup.remove_repeats(make(spark, [])).count() == 0


def brute_repeats(history, rows):
    from collections import Counter

    windows, words = Counter(), [(i, WORD.findall(t or "")) for i, t in rows]
    for ws in [WORD.findall(t or "") for _, t in history] + [ws for _, ws in words]:
        windows.update(tuple(ws[k : k + 35]) for k in range(len(ws) - 34))
    out = []
    for i, ws in words:
        gone = {k + j for k in range(len(ws) - 34) if windows[tuple(ws[k : k + 35])] > 1 for j in range(35)}
        out.append((i, len(ws), len(gone), hashlib.sha256(" ".join(w for k, w in enumerate(ws) if k not in gone).encode()).hexdigest()))
    return sorted(out)


def test_index_is_incremental(spark, texts):
    rows = make(spark, texts).select(F.xxhash64("doc_id", "text").alias("key"), "text").where("text is not null")
    index = substring_dedup.FingerprintIndex(spark, 4)
    first = index.add(substring_dedup.index_rows(rows)).count()
    assert index.add(substring_dedup.index_rows(rows.limit(0))).count() == 0
    hits = index.add(substring_dedup.index_rows(rows))
    alone = spark.table(index.runs[0][0])
    distinct, n = alone.select("fp").distinct().count(), alone.count()
    assert hits.count() == distinct > first
    index.compact()
    again = substring_dedup.FingerprintIndex(spark, 99, index.home)
    assert again.runs == index.runs and again.buckets == 4 and len(index.runs) == 1
    assert again.entries().count() == n and again.entries().where("c < 2").count() == 0
    index.close()


def test_repeats_over_calls_with_one_home(spark, texts, tmp_path):
    """The index and texts of earlier calls are found again, with tables dropped in between as by a new session."""
    home, seen = f"file://{tmp_path}/index", []
    parts = [texts[:20], texts[20:45], [*texts[45:], (700, " ".join((dict(texts)[10] or "").split()[:60])), (701, dict(texts)[93])]]
    for part in parts:
        got = substring_dedup.remove_repeats(make(spark, part), home=home).collect()
        assert sorted(tuple(r) for r in got) == brute_repeats(seen, part)
        seen += part
        for t in spark.catalog.listTables():
            if t.name.startswith("fingerprints_"):
                spark.sql(f"DROP TABLE {t.name}")


# ---- 8 ---------------------------------------------------------------------------------------------------
def brute_components(texts, k, num, den):
    def shingles(t):
        ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset([tuple(ws)] if 0 < len(ws) < k else [tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)])

    sets = [(i, shingles(t)) for i, t in texts]
    up = {i: i for i, _ in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and den * len(x & y) >= num * len(x | y):
                r, s = sorted((root(i), root(j)))
                up[s] = r
    return sorted((i, len(x), root(i)) for i, x in sets)


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100), (3, 60, 100)])
def test_ngram_join(spark, texts, k, num, den):
    got = ngram_join.ngram_components(make(spark, texts), k, num, den)
    assert sorted(tuple(r) for r in got.collect()) == brute_components(texts, k, num, den)
    assert ngram_join.ngram_components(make(spark, []), k, num, den).count() == 0


def test_ngram_join_of_a_crowded_family(spark):
    """Many copies around one text at all distances: hot sections, leaders, prefixes and components."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(900)]
    base = [rng.choice(words) for _ in range(150)]
    rows = []
    for i in range(160):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 3, 4, 5, 9])):
            own[rng.randrange(150)] = rng.choice(words)
        rows.append((i, " ".join(own[: rng.choice([150, 150, 149, 140])])))
    got = ngram_join.ngram_components(make(spark, rows), 3, 90, 100)
    assert sorted(tuple(r) for r in got.collect()) == brute_components(rows, 3, 90, 100)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components.connected_components(links.limit(0)).count() == 0


# ---- 9 -----------------------------------------------------------------------------------------------------
def test_exact_dedup(spark, texts):
    groups = {}
    bodies = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in texts]
    for i, b in bodies:
        groups.setdefault(b, []).append(i)
    want = sorted((i, min(groups[b]), len(groups[b]), i == min(groups[b]), hashlib.sha256(b.encode()).hexdigest()) for i, b in bodies)
    assert sorted(tuple(r) for r in exact_dedup.exact_dedup(make(spark, texts)).collect()) == want
    assert exact_dedup.exact_dedup(make(spark, [])).count() == 0


def test_dedup_state_outlives_a_run(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(bytearray(d), i, ("f", i)) for d, i in x], "digest binary, id long, locator struct<file:string,row_id:long>")
    home = f"file://{tmp_path}/state"
    exact_dedup.StreamingDeduper(spark, home).ingest(rows((b"a", 5), (b"b", 6)))
    got = exact_dedup.StreamingDeduper(spark, home).ingest(rows((b"a", 3), (b"c", 9)))
    assert {bytes(r["digest"]): (r["keep"], r["n"]) for r in got.collect()} == {b"a": (3, 2), b"b": (6, 1), b"c": (9, 1)}


# ---- 10 ------------------------------------------------------------------------------------------------------
def alike(a, b, num=8, den=10):
    """Similarity by five-character shingles, whatever the lines' lengths."""
    x, y = ({t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in (a, b))
    return den * len(x & y) >= num * len(x | y)


def test_short_lines_with_an_edit(spark):
    """One character changed in lines of 50 to 140 characters."""
    rng = random.Random(12)
    lines = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for n in range(50, 140, 2)]
    pairs = [(t, t[: len(t) // 2] + "#" + t[len(t) // 2 + 1 :]) for t in lines]
    got = line_dedup.line_classes(make(spark, [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)])).collect()
    cls = {r["id"]: r["class"] for r in got}
    same = [alike(*p) for p in pairs]
    found = sum(cls[2 * i] == cls[2 * i + 1] for i in range(len(pairs)) if same[i])
    assert all(same) and found >= 0.97 * len(pairs) and sum(r["kept"] for r in got) == 2 * len(pairs) - found


def test_lines_of_all_lengths_are_compared_alike(spark):
    """Rules, padding and other periodic lines; near copies on either side of any length."""
    rng = random.Random(21)
    base = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200)) for _ in range(30)]
    groups = [["-" * n for n in (7, 80, 90, 99, 100, 149, 150, 160, 300, 5000)], ["ab cd " * n for n in (3, 12, 17, 25, 40)], ["| " * n for n in (20, 80)]]
    groups += [[t[:n], t[: n + d]] for t, n, d in ((t, rng.randint(60, 170), rng.randint(1, 30)) for t in base)]
    rows = [(i, line) for i, line in enumerate(x for g in groups for x in g)]
    cls = {r["id"]: r["class"] for r in line_dedup.line_classes(make(spark, rows)).collect()}
    of, found, linked = {line: cls[i] for i, line in rows}, 0, 0
    for g in groups:
        for a, b in zip(g, g[1:], strict=False):
            linked += alike(a, b)
            found += alike(a, b) and of[a] == of[b]
    assert all(len({of[line] for line in g}) == 1 for g in groups[:3]) and found >= 0.95 * linked and linked > 30


def test_line_dedup(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    bases = [[word() for _ in range(30)] for _ in range(40)]
    lines = []
    for b in bases:
        for edits in range(rng.choice([1, 3, 6])):
            own = list(b)
            for _ in range(edits % 3):
                own[rng.randrange(30)] = word()
            lines.append(" ".join(own))
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[6 * i : 6 * i + 6] + ["", "short", "  "])) for i in range(len(lines) // 6)] + [(500, None), (501, ""), (502, "short"), (503, "é" * 30_000)]

    every = [(i, n, line) for i, t in docs for n, line in enumerate((t or "").split("\n")) if line.strip()]
    distinct = sorted({line for _, _, line in every})
    linked = {(a, b) for x, a in enumerate(distinct) for b in distinct[:x] if alike(a, b)}
    got = line_dedup.line_classes(make(spark, docs)).collect()
    assert len(got) == len(every)
    cls = {}
    for r in got:
        line = (dict(docs)[r["doc_id"] if "doc_id" in r else r["id"]] or "").split("\n")[r["line_no"]]
        cls.setdefault(line, set()).add(r["class"])
    assert all(len(c) == 1 for c in cls.values())
    found = sum(cls[a] == cls[b] for a, b in linked)
    assert found >= 0.95 * len(linked) and linked
    # nothing without a chain of links is joined
    up = {line: line for line in distinct}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        up[root(a)] = root(b)
    assert all(root(a) == root(b) for a in distinct for b in distinct if cls[a] == cls[b])
    kept = [r for r in got if r["kept"]]
    assert len({r["class"] for r in got}) == len(kept)
    per = {r["doc_id"]: r for r in line_dedup.dedup_lines(make(spark, docs)).collect()}
    assert per[500]["n_lines"] == per[501]["n_lines"] == 0 and per[502]["dropped_lines"] == [0] and len(per) == len(docs)
    out = make(spark, [(0, "a\nb\nc")]).select(line_dedup.without_lines(F.col("text"), F.array(F.lit(1))).alias("t")).first()["t"]
    assert out == "a\nc" and line_dedup.dedup_lines(make(spark, [])).count() == 0


def test_rows_without_an_id(spark):
    docs = make(spark, [(None, "a b c d e f g h"), (4, "a b c d e f g h"), (None, None), (None, "x " * 80), (5, "x " * 80)])
    got = ngram_join.ngram_components(docs, 3, 90, 100).collect()
    assert sorted((r["n_shingles"], r["component_id"]) for r in got if r["component_id"]) == [(1, 5), (1, 5), (6, 4), (6, 4)] and len(got) == 5
    kept = {(r["doc_id"], r["keep_id"]): r["kept"] for r in exact_dedup.exact_dedup(docs).collect()}
    assert kept == {(None, 4): False, (4, 4): True, (None, None): True, (None, 5): False, (5, 5): True}
    assert substring_dedup.remove_repeats(docs).count() == 5 and packing.pack_documents(docs, VOCABULARY).count() == 5
    assert line_dedup.dedup_lines(docs).count() == 5 and token_counts.prefix_token_counts(docs, VOCABULARY).count() == 5
    pages = spark.createDataFrame([(None, "u", "s"), (None, "u", "s"), (3, "u", "s"), (None, None, None)], "page_id long, url string, html string")
    rows = warc.read_bundles(warc.write_bundles(warc.mark_revisits(pages, "page_id", "url", "html"))).collect()
    assert sorted((r["record_id"] or 0, r["record_type"]) for r in rows) == [(0, "response"), (0, "response"), (0, "response"), (3, "response")]


def test_crowded_lines(spark):
    """Many lines around one at all distances: large groups, rarest shingles, size classes and components."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 9)))
    base, lines = [word() for _ in range(40)], []
    for _ in range(150):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            own[rng.randrange(40)] = word()
        lines.append(" ".join(own[: rng.choice([40, 40, 39, 37])]))
    rows = list(enumerate(lines))
    up = list(range(150))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(150):
        for b in range(a):
            if alike(lines[a], lines[b]):
                r, t = sorted((root(a), root(b)))
                up[t] = r
    got = {r["id"]: r["class"] for r in line_dedup.line_classes(make(spark, rows)).collect()}
    near = [(a, b) for a in range(150) for b in range(a) if root(a) == root(b)]
    assert sum(got[a] == got[b] for a, b in near) >= 0.95 * len(near)
    assert all(root(a) == root(b) for a in range(150) for b in range(a) if got[a] == got[b])


# ---- queries and pipeline ----------------------------------------------------------------------------------------
@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, name):
    same(queries.QUERIES[name](spark, DATA), tables(DATA), queries.SQL[name])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        sizes.append(docs.count())
        if name == "exact dedup":
            assert docs.select(exact_dedup.normalised()).distinct().count() == docs.count() == before.select(exact_dedup.normalised()).distinct().count()
        if name == "n-gram join":
            rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
            keep = {c for _, _, c in brute_components(rows, 5, 80, 100)}
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == keep
        if name == "mixing":
            assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == columns
    assert sizes[0] > sizes[1] > sizes[3] > 0
