"""Filters from data, labelled data sets, readers and stages that no query over the tables reaches."""

import pyarrow as pa
import pyarrow.feather as feather
import pytest
from pyspark.sql import functions as F

from chartloom.functions import filters, text
from chartloom.operators import adapters, intervals, segments, stages, training
from chartloom.sources import code_xml, readers


def test_payload_filters(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "b", None), (3, None, 7.0), (4, "ab", 9.0)], "i int, k string, x double")
    kept = lambda spec: [r["i"] for r in df.where(filters.payload_filter(spec)).orderBy("i").collect()]
    assert kept({"eq": {"k": "a"}}) == [1] and kept({"not": {"eq": {"k": "a"}}}) == [2, 3, 4]
    assert kept({"eq": {"k": "a", "i": 2}}) == [] and kept({"eq": {}}) == [1, 2, 3, 4]
    assert kept({"range": {"x": {"gte": 5, "lt": 9}}}) == [1, 3] and kept({"range": {"x": {"gt": 5, "lte": 9}}}) == [3, 4]
    assert kept({"in": {"k": ["a", "b"]}}) == [1, 2] and kept({"in": {"k": []}}) == [] and kept({"null": "x"}) == [2]
    assert kept({"and": []}) == [1, 2, 3, 4] and kept({"or": []}) == [] and kept({"match": {"k": "^a"}}) == [1, 4]
    assert kept({"or": [{"null": "k"}, {"and": [{"match": {"k": "b"}}, {"not": {"null": "x"}}]}]}) == [3, 4]
    for bad in ({}, {"eq": {"k": 1}, "null": "x"}, {"like": {"k": "a"}}, {"range": {"x": {"above": 1}}}):
        with pytest.raises(ValueError):
            filters.payload_filter(bad)


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).withColumn("k", F.lit("a")).write.parquet(f"file://{tmp_path}/t")
    plan = spark.read.parquet(f"file://{tmp_path}/t").where(filters.payload_filter({"and": [{"eq": {"k": "a"}}, {"range": {"id": {"gte": 3}}}]}))._jdf.queryExecution().toString()
    assert "EqualTo(k,a)" in plan and "GreaterThanOrEqual(id,3)" in plan


# ---- labelled data sets -------------------------------------------------------------------------
NOTE = "First part here. Second part there. Third and last one."


def labelled(spark, rows, ddl, name, **options):
    df = spark.createDataFrame(rows, ddl)
    got = {r["aid"]: r for r in training.adapt_labelled(df, segments.sentences(), **options).collect()}
    same = {r["aid"]: r for r in training.adapt_labelled(df, segments.sentences(), name, **options).collect()}
    assert got == same
    return got


def test_decisions(spark):
    ddl = "subject_id int, hadm_id int, note_id int, text string, classes map<string,string>, annotations struct<category_id:array<string>,start_offset:array<int>,end_offset:array<int>>"
    names = {"1": "one", "2": "two", "3": "three"}
    rows = [(7, 8, 9, NOTE, names, (["1", "2", "1", "9"], [0, 17, 20, 0], [5, 30, 25, 9])), (7, 8, 10, NOTE, names, None), (7, 8, 11, None, names, ([], [], []))]
    got = labelled(spark, rows, ddl, "decisions", order="alphabetical")
    assert got["8_7_9"]["segments"] == ["First part here.", "Second part there.", "Third and last one."]
    assert got["8_7_9"]["classes"] == ["one", "two", "three"] and got["8_7_9"]["targets"] == [[1], [1, 2], [0]]
    assert got["8_7_10"]["classes"] == [] and got["8_7_10"]["targets"] == [] and len(got["8_7_10"]["segments"]) == 3
    assert got["8_7_11"]["segments"] == [] and got["8_7_11"]["classes"] == ["one", "two", "three"]
    few = labelled(spark, rows, ddl, "decisions", order="alphabetical", negatives=0)
    assert few["8_7_9"]["classes"] == ["one", "two"] and few["8_7_11"]["classes"] == []


def test_concepts_with_their_own_classes(spark):
    ddl = "note_id string, text string, classes map<string,string>, annotations struct<concept_id:array<bigint>,start:array<int>,end:array<int>>"
    rows = [("n1", NOTE, {"11": "a"}, ([11, 12], [40, 0], [45, 3])), ("n2", NOTE, {"12": "b"}, ([11, 12], [40, 0], [45, 3]))]
    got = labelled(spark, rows, ddl, "concepts")
    assert (got["n1"]["classes"], got["n1"]["targets"]) == (["a"], [[0], [0], [1]])
    assert (got["n2"]["classes"], got["n2"]["targets"]) == (["b"], [[1], [0], [0]])


def test_scored_notes(spark):
    ddl = "pn_num int, case_num int, patient_note string, case_features map<string,string>, labels struct<feature_num:array<int>,location:array<array<string>>>"
    rows = [(5, 2, NOTE, {"3": "x", "4": "y"}, ([3, 4], [["0 5;17 20"], []]))]
    got = labelled(spark, rows, ddl, "scored", order="alphabetical")
    assert (got["2_5"]["classes"], got["2_5"]["targets"]) == (["x", "y"], [[1], [1], [0]])
    with pytest.raises(ValueError, match="no adapter"):
        training.adapt_labelled(spark.range(1), segments.document)


def test_dataset_config():
    one, two = (adapters.DatasetConfig("a", seed=s) for s in (0, 1))
    assert one.fingerprint() == adapters.DatasetConfig("a").fingerprint() != two.fingerprint()


# ---- readers -------------------------------------------------------------------------
def test_split_tables(spark, tmp_path):
    for i in (0, 1):
        feather.write_feather(pa.table({"_id": pa.array([10 * i + 1, 10 * i + 2], pa.int32()), "split": ["train", "test"]}), f"{tmp_path}/s{i}.feather")
    got = sorted(map(tuple, readers.read_split(spark, f"file://{tmp_path}/*.feather").collect()))
    assert got == [(1, "train"), (2, "test"), (11, "train"), (12, "test")]


def test_release_files_and_runs(spark, tmp_path):
    (tmp_path / "run_neg5_seed2").mkdir()
    (tmp_path / "run_neg5_seed2/averages.json").write_text('{"f1": 0.5}')
    (tmp_path / "run_neg5_seed2/responses.json").write_text('{"f1": 0.25}')
    for files, f1 in (("averages.json", 0.5), ("responses.json", 0.25)):
        assert [tuple(r) for r in readers.read_runs(spark, f"file://{tmp_path}", files=files).select("f1", "experiment", "negatives", "seed").collect()] == [(f1, "run", 5, 2)]
    (tmp_path / "b2.xml").write_text("<x/>")
    (tmp_path / "b1.xml").write_text("<x/>")
    assert readers.release_files(spark, f"file://{tmp_path}", {"x": "b*.xml"})["x"].endswith("b1.xml")
    with pytest.raises(FileNotFoundError):
        readers.release_files(spark, f"file://{tmp_path}", {"x": "c*.xml"})


def test_lists_lexicon_and_decisions(spark, tmp_path):
    (tmp_path / "names.txt").write_text("a\n\n b \n")
    assert [r["name"] for r in readers.read_name_list(spark, f"file://{tmp_path}/names.txt").collect()] == ["a", "b"]
    (tmp_path / "lex.rrf").write_text("|".join(["C1", "ENG", "P", "L", "PF", "S", "Y", *["x"] * 11]) + "|\n" + "|".join(["C2", "FRE", "P", "L", "PF", "S", "Y", *["x"] * 11]) + "|\n")
    lexicon = readers.read_lexicon(spark, f"file://{tmp_path}/lex.rrf")
    assert len(lexicon.columns) == 18 and [r[0] for r in readers.preferred_english(lexicon).collect()] == ["C1"]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.json").write_text('{"annotator_id": "x", "discharge_summary_id": "1_2_3", "annotations": [{"start_offset": "4", "end_offset": "9", "category": "Category 7: Plan", "decision": "d", "annotation_id": "a"}, {"start_offset": "", "end_offset": "9", "category": "other"}]}')
    got = [tuple(r) for r in readers.read_decision_json(spark, f"file://{tmp_path}/d").select("subject_id", "hadm_id", "row_id", "start", "end", "category_id", "category").collect()]
    assert got == [(1, 2, 3, 4, 9, 7, "Plan"), (1, 2, 3, None, 9, 0, "Unknown")]


def test_axes(spark, tmp_path):
    (tmp_path / "p.xml").write_text('<P><pcsTable><axis pos="1"><title>Section</title><label code="0">Medical</label></axis><pcsRow codes="2"><axis pos="4"><title>Part</title><label code="A">Arm</label><label code="B">Leg</label></axis></pcsRow></pcsTable></P>')
    got = [(r["pos"], r["title"], [(x["code"], x["label"]) for x in r["labels"]], r["fixed"], r["declared"]) for r in code_xml.read_axes(spark, f"file://{tmp_path}/p.xml").collect()]
    assert got == [(1, "Section", [("0", "Medical")], True, 2), (4, "Part", [("A", "Arm"), ("B", "Leg")], False, 2)]


# ---- stages and spans -------------------------------------------------------------------------
def test_one_request_an_item(spark):
    df = spark.createDataFrame([(1, ["b", "a"]), (2, []), (3, None)], "row int, items array<string>")
    up = lambda prompts: [p.upper() for p in prompts]
    steps = [("ask", lambda d: stages.per_group(d, "row", "items", lambda c: F.concat(F.lit("x"), c), up, lambda r: F.substring(r, 2, 9), "out"))]
    assert {r["row"]: r["out"] for r in stages.run_stages(df, steps).collect()} == {1: ["B", "A"], 2: None, 3: None}


def test_first_places_and_printable_text(spark):
    docs, pieces = spark.createDataFrame([(1, "ab cab")], "k int, text string"), spark.createDataFrame([(1, "ab"), (1, "zz"), (1, "cab")], "k int, piece string")
    assert sorted((r["piece"], r["start"], r["end"]) for r in intervals.locate_spans(docs, pieces, key="k").collect()) == [("ab", 0, 2), ("cab", 3, 6)]
    assert spark.createDataFrame([('a\té"b',)], "t string").select(text.printable_json(F.col("t"))).first()[0] == '{"v":"a  \\"b"}'
    assert text.template_names("{{ b }} {{a}} {{ b }}") == ["a", "b"]
    row = spark.createDataFrame([("(abc)", 0, 4)], "t string, s int, e int")
    assert tuple(row.select(*text.trim_span(F.col("t"), F.col("s"), F.col("e"))).first()) == (1, 3)
