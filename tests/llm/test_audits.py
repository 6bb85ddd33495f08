"""Filter audit, benchmark contamination and fill-in-the-middle against plain versions, on odd rows."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartloom.llm import decontaminate, exact_dedup, fill_middle, filter_audit, queries, substring_dedup

ODD = "doc_id long, text string, source string, row string, id string, n string, mask string, part string, words string, form string"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, s, *"abcdefg") for i, t, s in rows], ODD).repartition(3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- 11 ---------------------------------------------------------------------------------------
def plain_audit(rows, marks):
    """Every order run over all rows."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    rows = [(i, t or "", s or "") for i, t, s in rows]
    fails = {
        "A": lambda i, t: len(words(t)) < 200,
        "B": lambda i, t: 100 * len(set(words(t))) < 50 * len(words(t)),
        "C": lambda i, t: 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
        "D": lambda i, t: bool(re.search(r"[#$%&*|]", t)),
        "E": lambda i, t: i is not None and any(j is not None and j < i and u == t for j, u, _ in rows),
    }
    bad = [{f for f, test in fails.items() if test(i, t)} for i, t, _ in rows]
    good, toxic = ({i for i, *m in marks if i is not None and m[k] == 1} for k in (0, 1))
    out = {}
    for part in {s for _, _, s in rows}:
        here = [(i, bad[x]) for x, (i, _, s) in enumerate(rows) if s == part]
        share = dict.fromkeys(fails, 0)
        for order in permutations("ABCDE"):
            left = here
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                share[f] += len(gone)
                early = [r for r in here if f in r[1] and r[1] & set(order[: step - 1])]
                out[part, "".join(order), step] = [len(left), len(gone), len(early), sum(b == {f} for _, b in here), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(share[order[step - 1]])
    return out


def audited(spark, rows, marks):
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    got = filter_audit.audit_orders(filter_audit.failure_counts(odd(spark, rows), labels, "source"), "ABCDE", ["good", "toxic"]).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in got}, len(got)


def test_filter_audit(spark):
    rng = random.Random(5)
    long = " ".join(f"w{i}" for i in range(260))
    texts = [None, "", " ", "\x1f  word", "short", long, long + " #", "AB " * 300, long.upper(), "a|b", "É" * 40 + "Z", "x " * 400, "\U0001f600" * 49 + "Q", "\U0001f600" * 50 + "Q"]
    rows = [(rng.choice([None, 1, 2, 3, *range(10, 60)]), rng.choice(texts), rng.choice([None, "", "a", "b"])) for _ in range(150)]
    marks = [(1, 1, None), (1, 0, 1), (None, 1, 1), *((i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(10, 40))]
    got, n = audited(spark, rows, marks)
    want = plain_audit(rows, marks)
    assert n == len(want) == 120 * 5 * 3 and got == want


def test_filter_audit_of_nothing(spark):
    assert audited(spark, [], [(1, 1, 1)]) == ({}, 0)


def test_lattice_has_eighty_edges_and_paths_of_five(spark):
    counts = spark.createDataFrame([("p", 0, 3, 1, 0)], "part string, mask int, n long, good long, toxic long")
    assert filter_audit.lattice_edges(counts, "ABCDE", ["good", "toxic"]).count() == 80
    assert filter_audit.order_paths(spark, "ABCDE").count() == 600


# ---- 12 ---------------------------------------------------------------------------------------
def plain_hits(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, t in items:
        ws = words(t)
        size = min(10, len(ws))
        for j in range(len(ws) - size + 1 if ws else 0):
            windows.setdefault(tuple(ws[j : j + size]), set()).add(item)
    out = []
    for i, t in docs:
        ws, hit, found = words(t), set(), set()
        for size in {len(w) for w in windows}:
            for j in range(len(ws) - size + 1):
                owners = windows.get(tuple(ws[j : j + size]))
                if owners:
                    hit |= set(range(j, j + size))
                    found |= owners - {None}
        ids = sorted(map(str, found))
        out.append((i, len(ws), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return sorted(out, key=repr)


def contaminated(spark, docs, items):
    got = decontaminate.contamination(odd(spark, [(i, t, "s") for i, t in docs]), spark.createDataFrame(items, "item_id string, text string, extra string") if items and len(items[0]) == 3 else spark.createDataFrame(items, "item_id string, text string"))
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got.collect()), key=repr)


def test_contamination(spark):
    """Few words, so that windows repeat, overlap and meet in part; short items, shared items, rows without ids."""
    rng = random.Random(8)
    say = lambda n, many: " ".join(rng.choice(["The", "cat", "sat", "é", "ÉA", "7", "漢字", "x" * 30][:many]) + rng.choice(["", ",", " \x00", "_", "\n"]) for _ in range(n))
    items = [(f"i{k}", say(rng.choice([10, 11, 14, 40]), 8)) for k in range(25)] + [("i3", say(12, 8)), (None, say(13, 8)), ("short", "Cat SAT 漢字 x7 x7"), ("one", "zebra"), ("none", " ,. "), ("null", None), ("twin", None)]
    items += [("twin2", items[0][1]), ("same", "the " * 30)]
    docs = [(None, None), (1, ""), (1, "the cat"), (2, "Zebra! zebra"), (3, ",,,"), (4, "THE-" * 300)]
    for i in range(60):
        own = rng.choice(items)[1] or ""
        cut = own.split()
        a, b = sorted((rng.randint(0, len(cut)), rng.randint(0, len(cut))))
        docs.append((rng.choice([None, *range(30)]), say(rng.randint(0, 30), 8) + " " + " ".join(cut[a:b]) + " " + say(rng.randint(0, 12), 8)))
    assert contaminated(spark, docs, items) == plain_hits(docs, items)


def test_contamination_without_items(spark):
    docs = [(1, "some words"), (2, None)]
    assert contaminated(spark, docs, []) == plain_hits(docs, [])
    assert contaminated(spark, [], [("a", "some words")]) == []


def test_any_shared_run_of_ten_words_has_a_common_print():
    rng = random.Random(3)
    for _ in range(200):
        run = [rng.choice("abcdefghijkl") for _ in range(10)]
        of = []
        for _ in range(2):
            w = decontaminate.Words(" ".join([rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 20))] + run + [rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 20))]))
            places, hashes = w.chosen(10, 5)
            of.append(set(hashes[np.unique(places)].tolist()))
        own = decontaminate.Words(" ".join(run))
        places, hashes = own.chosen(10, 5)
        assert len(places) == 1 and hashes[places[0]] in of[0] & of[1]


def test_contamination_spans(spark):
    docs = spark.createDataFrame([(1, "a b " + " ".join(f"q{i}" for i in range(12)) + " c zebra")], "doc_id long, text string")
    items = spark.createDataFrame([("x", " ".join(f"q{i}" for i in range(12))), ("z", "zebra")], "item_id string, text string")
    rows, families = decontaminate.find_contamination(docs, items)
    (row,), (family,) = rows.collect(), families.collect()
    assert [tuple(s) for s in row["spans"]] == [(2, 14), (15, 16)] and family["items"] == ["x", "z"] and family["family"] == row["family"]


# ---- 13 ---------------------------------------------------------------------------------------
def plain_middle(i, text):
    t = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    digest = sha(f"1:{'' if i is None else i}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, len(units), "plain", None, None, sha(t), sha(t)
    spm = h[3] % 100 < 20
    return i, len(units), "spm" if spm else "psm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"), sha(t)


def test_fill_in_the_middle(spark, tmp_path):
    rng = random.Random(13)
    pieces = ["a", "Bc", "\x01", "\x02", "0", "1", "\x020", "\x021", "\x01\x02", " ", "\n", "\r", "é", "\U0001f600", "é", "<", "P", ">", "<S", "$0", "\\", "\x00", "<M"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))) for i in range(1500)]
    rows += [(None, "no id"), (None, None), (3, ""), (3, "again"), (-5, "less <P> x"), (-6, "a<S>"), (-7, "<M>"), (-8, "long " * 60000), (-9, "\U0001f600\x02" * 50000)]
    odd(spark, [(i, t, "s") for i, t in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_fill_middle"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain_middle(i, t) for i, t in rows), key=repr)
    parts = fill_middle.fill_in_middle(odd(spark, [(i, t, "s") for i, t in rows])).where("form <> 'plain'")
    assert parts.where(F.concat("prefix", "middle", "suffix") != F.col("text")).count() == 0 and parts.where(fill_middle.restored() != F.col("text")).count() == 0
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_the_middle_of_nothing(spark):
    assert fill_middle.fill_in_middle(odd(spark, [])).count() == 0


# ---- calls that are made again -------------------------------------------------------------------------
def once(spark):
    rng = random.Random(3)
    return [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(60))) for i in range(6)]


def test_a_repeated_call_removes_nothing_more(spark, tmp_path, monkeypatch):
    """Killed before its index is published, killed after, and whole: always the result of one call."""
    home, rows = f"file://{tmp_path}/repeats", once(spark)
    shared = rows[0][1]
    first, second = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(10, shared), (11, "own words " * 3)], "doc_id long, text string")
    run = lambda docs, batch: sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs, home=home, batch=batch).collect())
    stop = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed"))
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(substring_dedup.FingerprintIndex, "publish", stop)
        run(first, "one")
    clean = [(i, 0) for i in range(6)]
    assert run(first, "one") == clean
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(substring_dedup.FingerprintIndex, "status", stop)
        run(second, "two")
    assert run(second, "two") == [(10, 60), (11, 0)]
    assert run(second, "two") == [(10, 60), (11, 0)]
    assert run(second, "three") == [(10, 60), (11, 0)]


def test_a_repeated_call_counts_once(spark, tmp_path, monkeypatch):
    home = f"file://{tmp_path}/copies"
    docs = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "c")], "doc_id long, text string")
    run = lambda batch: sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(docs, home=home, batch=batch).collect())
    stop = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed"))
    whole = exact_dedup.StreamingDeduper.ingest
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(exact_dedup.StreamingDeduper, "ingest", lambda self, a, b=None: (whole(self, a, b), stop()))
        run("one")
    for _ in range(2):
        assert run("one") == [(1, 1, 2), (2, 1, 2), (3, 3, 1)]
    assert run("two") == [(1, 1, 4), (2, 1, 4), (3, 3, 2)]
