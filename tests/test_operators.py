import random

import pytest
from pyspark.sql import functions as F

from chartloom.operators import adapters, cohort, fuzzy, hierarchy, intervals, metrics, sampling, segments, stages, vectors
from chartloom.sources import code_xml, readers


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


def test_metrics_golden(spark):
    t = spark.createDataFrame([(0, [1, 2, 3]), (1, [1, 2]), (2, [1, 3])], "row_id int, x array<int>")
    p = spark.createDataFrame([(0, [2, 3]), (1, [2]), (2, [3, 4])], "row_id int, x array<int>")
    got = metrics.micro_macro(metrics.long_labels(t, "row_id", "x"), metrics.long_labels(p, "row_id", "x"), t).first()
    assert got["accuracy"] == 0 and round(got["micro_f1"], 4) == 0.6667 and round(got["macro_f1"], 4) == 0.5 and round(got["ratio"], 3) == 0.714
    same = metrics.micro_macro(metrics.long_labels(t, "row_id", "x"), metrics.long_labels(t, "row_id", "x"), t).first()
    assert same["accuracy"] == 1 and round(same["micro_f1"], 6) == round(same["macro_f1"], 6) == 1


def test_signed_labels(spark):
    df = spark.createDataFrame([(0, [1, -2, 3]), (1, [2]), (2, [0, 6])], "r int, x array<int>")
    assert rows(metrics.signed_labels(df, "r", "x", 5)) == [(0, 0, 1.0), (0, 1, -1.0), (0, 2, 1.0), (1, 1, 1.0)]


def test_overlaps(spark):
    segs = spark.createDataFrame([(1, 1, 0, 35), (1, 2, 36, 60)], "doc int, seg int, start int, end int")
    spans = spark.createDataFrame([(1, 0, 35, "428.0"), (1, 36, 60, "401.9")], "doc int, start int, end int, code string")
    assert rows(intervals.segment_targets(segs, spans, "doc", "seg"), "seg", "targets") == [(1, ["428.0"]), (2, ["401.9"])]
    assert rows(intervals.segment_targets(segs, spans.limit(0), "doc", "seg"), "seg", "targets") == [(1, []), (2, [])]


@pytest.mark.parametrize(("n", "hard_ratio", "size"), [(2, 0.5, 3), (0, 0.0, 1), (-1, 0.0, 4), (1, 1.0, 2)])
def test_negatives(spark, n, hard_ratio, size):
    s = lambda *x: F.array(*map(F.lit, x))
    out = spark.range(1).select(sampling.negatives(s("428.0", "401.9", "250.00", "272.4"), s("428.0"), n, 3, s("250.00"), hard_ratio).alias("x")).first()["x"]
    assert len(out) == size and "428.0" in out and (hard_ratio == 0 or "250.00" in out)


@pytest.mark.parametrize("n", [-1, 0, 1, 3, 9])
@pytest.mark.parametrize("hard_ratio", [0.0, 0.5])
def test_classes_of_all_rows_as_of_each(spark, n, hard_ratio):
    """A Python list of classes gives what it gave as a list of each row: null lists, null and repeated codes, no or all classes taken."""
    classes = ["428.0", "401.9", None, "250.00", "401.9", "272.4", ""]
    own = [None, [], ["401.9"], ["401.9", None, "401.9", "x"], [c for c in classes if c], classes]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(own)], "i int, own array<string>")
    hard = F.array(F.lit("250.00"), F.lit("h"), F.lit("401.9"))
    each = F.array(*(F.lit(c).cast("string") for c in classes))
    got = df.select(sampling.negatives(classes, F.col("own"), n, 3, hard, hard_ratio).alias("got"), sampling.negatives(each, F.col("own"), n, 3, hard, hard_ratio).alias("want")).collect()
    assert len(got) == len(own) and all(r["got"] == r["want"] for r in got)
    empty = df.select(sampling.negatives([], F.col("own"), n, 3).alias("x"), F.sort_array(F.array_distinct("own")).alias("y")).collect()
    assert all(r["x"] == r["y"] for r in empty)


def test_classes_of_all_rows_are_hashed_once(spark):
    """The order of the classes is a subquery of one row; the rows' own projection hashes nothing."""
    df = spark.range(5).select(F.array(F.col("id").cast("string")).alias("own"))
    out = df.select(sampling.negatives(["1", "2", "3"], F.col("own"), 2, 7).alias("x"))
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    assert "md5" not in next(line for line in plan if "AS x" in line) and sum("md5" in line for line in plan) == 1
    assert all(len(r["x"]) == 3 for r in out.collect())


def test_shuffle_and_remap(spark):
    s = lambda *x: F.array(*map(F.lit, x))
    r = spark.range(1).select(sampling.shuffled(s("a", "b", "c"), 1).alias("o"), sampling.remap(F.array().cast("array<string>"), s("a")).alias("e")).first()
    assert sorted(r["o"]) == ["a", "b", "c"] and r["e"] == [0]


def test_fuzzy_ratio():
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 9))) for _ in range(2))
        want = 100.0 if not a + b else 200.0 * lcs(a, b) / len(a + b)
        assert abs(fuzzy.indel_ratio(a, b) - want) < 1e-9


def test_segmenters():
    text = "Dr. Smith came. He left.\n- one\n- two"
    for seg in (segments.document, segments.by_pattern(r"\n", 3), segments.sentences(), segments.factory("raw_sentence")):
        for part, a, b in seg(text):
            assert part == text[a:b].strip(" \t\r\n-*•") or part == text[a:b].strip()
    assert next(iter(segments.sentences()(text)))[0].startswith("Dr. Smith came.")
    assert list(segments.document("  ")) == []


def test_knn_matches_brute_force(spark):
    rng = random.Random(1)
    data = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(data, "i long, v array<double>")
    got = vectors.knn(df.select(F.col("i").alias("q"), F.col("v").alias("w")), df.withColumnRenamed("i", "x"), 3, "q", "w", "x", "v")
    for q, v in data:
        best = sorted((-round(sum(a * b for a, b in zip(v, w, strict=True)), 6), i) for i, w in data)[:3]
        assert [r["x"] for r in got.where(F.col("q") == q).orderBy("rank").collect()] == [i for _, i in best]


TABULAR = """<T><chapter><name>1</name><desc>Infections</desc><includes><note>inc</note></includes><section id="A00"><desc>S</desc>
<diag><name>A00</name><desc>Cholera</desc><sevenChrDef><extension char="A">initial</extension></sevenChrDef><diag><name>A00.0</name><desc>c0</desc></diag></diag></section></chapter></T>"""
INDEX = """<I><indexHeading><head col="2">Malignant</head></indexHeading><letter><mainTerm><title>Fever<nemod>(acute)</nemod></title><code>R50.9</code>
<cell col="2">C00.-</cell><cell col="3">-</cell><term level="1"><title>yellow</title><code>A95.-</code></term></mainTerm></letter></I>"""


def test_xml(spark, tmp_path):
    (tmp_path / "t.xml").write_text(TABULAR)
    (tmp_path / "i.xml").write_text(INDEX)
    nodes = code_xml.read_tabular(spark, str(tmp_path / "t.xml"))
    assert rows(nodes, "id", "parent_id", "assignable") == [("A00", "A00-A00", False), ("A00-A00", "chapter 1", False), ("A00.0", "A00", True), ("chapter 1", None, False)]
    terms = {r["id"]: r for r in code_xml.read_index(spark, str(tmp_path / "i.xml")).collect()}
    assert terms["00000"]["title"] == "Fever" and terms["00000"]["optional_modifiers"] == ["acute"]
    assert terms["00000X2"]["code"] == "C00" and not terms["00000X2"]["assignable"] and "00000X3" not in terms and terms["00000.0"]["code"] == "A95"
    closed = hierarchy.closure(nodes, include_self=True)
    ext = nodes.select(F.col("id").alias("owner"), F.explode("seventh").alias("s")).select("owner", "s.char", "s.text")
    assert rows(hierarchy.seventh_characters(nodes, closed, ext), "name", "parent_id", "description") == [("A00.0XXA", "A00.0", "c0 (initial)")]
    assert hierarchy.check_tree(nodes).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "ids.csv").write_text("11\n12\n")
    assert rows(readers.read_id_list(spark, str(tmp_path / "ids.csv"))) == [(11,), (12,)]
    (tmp_path / "c.csv").write_text('HADM_ID,ICD9_CODE\n1,0019\n2,"E849"\n')
    assert rows(readers.read_csv(spark, str(tmp_path / "c.csv"), "code_events_9")) == [(1, "0019"), (2, "E849")]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text('{"hadm_id":1,"notes":[{"note_id":2,"category":"c","description":"d","annotations":[{"code":"x","code_system":"s","begin":1,"end":3},{"code":"x","code_system":"t","begin":5,"end":6}]}]}')
    got = readers.load(spark, "annotated_json", str(tmp_path / "j")).first()
    assert [tuple(s) for s in got["spans"]] == [(1, 3), (5, 6)] and got["code_type"] == "t"


def test_adapters_and_validation(spark):
    df = spark.createDataFrame([("n1", "t", "k", ["b", "a"])], "note_id string, text string, note_type string, diagnosis_codes array<string>")
    assert adapters.adapt(df).first()["targets"] == ["b", "a"]
    with pytest.raises(ValueError, match="no adapter"):
        adapters.adapt(spark.range(1))
    good, bad = adapters.validate(spark.range(3), even=F.col("id") % 2 == 0)
    assert good.count() == 2 and bad.first()["broken"] == ["even"]


def test_retries(spark):
    calls = []

    def flaky(prompts):
        calls.append(len(prompts))
        return [p + "!" * len(calls) for p in prompts]

    out = stages.complete(spark.createDataFrame([("a",)], "p string"), "p", flaky, accept=lambda r: r.endswith("!!!"))
    assert out.first()["reply"] == "a!!!"


def test_rare_codes_keep_occurrences(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["c"]), (4, None)], "i int, codes array<string>")
    assert rows(cohort.remove_rare_codes(df, "i", ["codes"], 2), "i", "codes") == [(1, ["a"]), (2, ["a"])]
    kept = {r["i"]: r["codes"] for r in cohort.keep_top_codes(df, "i", ["codes"], 1).collect()}
    assert kept == {1: ["a"], 2: ["a"], 3: None, 4: None}


def test_stream_equals_batch(spark, tmp_path):
    import os

    from chartloom.streaming import monitors

    src = "/root/testdata/sf0.001/events.parquet"
    if not os.path.exists(src):
        pytest.skip("no driver tables")
    stream = monitors.windowed_means(monitors.read_events(spark, src))
    monitors.run_once(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    batch = monitors.windowed_means(spark.read.parquet(src).withColumn("ts", F.col("ts").cast("timestamp")))
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["start"], r["event_type"]): r["n"] for r in batch.collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_scored_notes_and_guidelines(spark, tmp_path):
    (tmp_path / "patient_notes.csv").write_text('pn_num,case_num,pn_history\n1,0,"line one\nline two"\n')
    (tmp_path / "features.csv").write_text("feature_num,case_num,feature_text\n7,0,fever\n6,0,cough\n")
    (tmp_path / "train.csv").write_text("id,pn_num,case_num,feature_num,annotation,location\na,1,0,7,\"['hot', 'warm']\",\"['0 3;5 8']\"\nb,1,0,6,[],[]\n")
    r = readers.load(spark, "scored_notes", str(tmp_path)).first()
    assert r["pn_history"] == "line one\nline two" and [f["feature_num"] for f in r["features"]] == [6, 7] and r["features"][1]["annotation"] == ["hot", "warm"]
    nodes = spark.createDataFrame([("c1", None), ("s", "c1"), ("x", "s")], "id string, parent_id string")
    rows_ = spark.createDataFrame([(1, ["x", "s"])], "r int, codes array<string>")
    g = spark.createDataFrame([("c1", "1", "T", "body")], "id string, number string, title string, content string")
    got = hierarchy.guidelines_for(rows_, "r", "codes", hierarchy.closure(nodes), g).first()["guidelines"]
    assert [x["title"] for x in got] == ["T"]
    shots = spark.createDataFrame([(1, ["a", "b"], [["x"], ["y"]])], "k int, s array<string>, t array<array<string>>")
    assert sampling.flatten_fewshots(shots, "k", "s", "t", 1).count() == 1


def test_ranked_recall_deals_rows_in_a_given_number_of_parts(spark):
    terms = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (1, "b", 2), (2, "a", 1)], "row_id long, term_id string, rank int")
    codes = spark.createDataFrame([("a", "A"), ("b", "B"), ("b", None)], "term_id string, code string")
    wanted = spark.createDataFrame([(1, "A"), (1, "A"), (1, None), (3, "B")], "row_id long, code string")
    got = metrics.ranked_recall(terms, codes, wanted, [1, 2], parts=5).select("k", "tp", "seen", "fn").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 2, 2), (2, 1, 3, 2)]
