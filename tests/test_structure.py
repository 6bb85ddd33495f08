"""Prefix hierarchies, table functions, mergeable aggregates, stems and stemmed overlap."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from chartloom.functions import stem
from chartloom.operators import metrics, prefix_tree, segments, table_functions
from chartloom.plans import catalog, structure  # noqa: F401
from chartloom.streaming.partials import PartialStore

DATA = "/root/testdata/sf0.001"


# ---- prefix hierarchies -------------------------------------------------------------------------
def plain_tree(codes, lengths=None):
    nodes = {c for c in codes if c}
    given = set(nodes)
    if lengths:
        nodes |= {c[:n] for c in given for n in lengths if n < len(c)}
    order = sorted(nodes, key=lambda c: c.encode())
    out = {}
    for i, c in enumerate(order):
        up = [p for p in nodes if c.startswith(p) and p != c]
        below = sum(d.startswith(c) for d in order) - 1
        leaves = sum(d.startswith(c) and d != c and not any(e.startswith(d) and e != d for e in order) for d in order)
        out[c] = (max(up, key=len, default=None), len(up), i, i + below, leaves, c in given)
    return out


@pytest.mark.parametrize("lengths", [None, [4, 5, 6], [1]])
def test_prefix_tree(spark, lengths):
    rng = random.Random(6)
    codes = ["".join(rng.choice("AB1é\U0001f600") for _ in range(rng.randint(0, 8))) for _ in range(300)] + [None, "", "A", "A", "AA"]
    df = spark.createDataFrame([(c,) for c in codes], "code string").repartition(5)
    got = {r["code"]: (r["parent"], r["depth"], r["entry"], r["exit"], r["n_leaves"], r["given"]) for r in prefix_tree.prefix_tree(df, lengths=lengths).collect()}
    assert got == plain_tree(codes, lengths)


def test_prefix_tree_of_nothing(spark):
    assert prefix_tree.prefix_tree(spark.createDataFrame([], "code string")).count() == 0


def test_ranges_are_the_closure(spark):
    codes = ["A", "A0", "A01", "A01.1", "A02", "B", "B9", "C77"]
    tree = prefix_tree.prefix_tree(spark.createDataFrame([(c,) for c in codes], "code string")).cache()
    a, d = tree.alias("a"), tree.alias("d")
    pairs = a.join(d, prefix_tree.is_below(F.col("d.entry"), F.col("a.entry"), F.col("a.exit"))).select("a.code", "d.code").collect()
    assert sorted(map(tuple, pairs)) == sorted((x, y) for x in codes for y in codes if y.startswith(x) and x != y)
    assert {r["code"]: r["root"] for r in prefix_tree.roots(tree).collect()} == {c: "C77" if c == "C77" else c[0] for c in codes}
    assert sorted(r["code"] for r in tree.where(prefix_tree.is_leaf()).collect()) == ["A01.1", "A02", "B9", "C77"]


def test_code_file(spark, tmp_path):
    (tmp_path / "codes.csv").write_text(';"Kap. I: Infections: some [A00-B99]"\n;"Gut diseases [A00-A09]"\nA00;Cholera \nA000;"Cholera; classic"\n')
    got = [tuple(r) for r in prefix_tree.read_code_file(spark, f"file://{tmp_path}/codes.csv").collect()]
    assert got == [
        ("A00-B99", "A00", "Infections  some", "A00", "B99", "category"),
        ("A00-A09", "A00", "Gut diseases", "A00", "A09", "category"),
        ("A00", "A00", "Cholera", "A00", "A00", "code"),
        ("A000", "A000", "Cholera; classic", "A000", "A000", "code"),
    ]


# ---- table functions -------------------------------------------------------------------------
@pytest.mark.parametrize(
    "call, segmenter",
    [
        ("segment_text(t, 'document')", segments.document),
        ("segment_text(t, 'sentence')", segments.factory("sentence")),
        ("segment_text(t, 'nbme')", segments.factory("nbme")),
        ("segment_text(t, 'raw_sentence')", segments.factory("raw_sentence")),
        ("segment_pattern(t, '[.;]\\\\s|\\\\n', 4)", segments.by_pattern(r"[.;]\s|\n", 4)),
        ("segment_window(t, 30, 7)", segments.by_window(30, 7)),
    ],
)
def test_segmenters_from_sql(spark, call, segmenter):
    texts = [None, "", "  ", "One. Two; three\nfour. Five six seven.", "HPI: a b c.\r\nPMH: none, d e f g h i j. K", "Dr. No came. \U0001f600 é " * 12, "- a\n- b c d e f\n\n---\nLast one here."]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    table_functions.register(spark)
    want = (segments.segment_table(df, "id", "t", segmenter) if segmenter is not segments.document else segments.segment_table(df, "id", "t", segments.factory("document"))).collect()
    got = spark.sql(f"SELECT d.id, s.* FROM {{df}} d, LATERAL {call} s", df=df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def test_segmenters_are_checked_before_they_run(spark):
    table_functions.register(spark)
    df = spark.createDataFrame([("a b", "sentence")], "t string, k string")
    for call in ("segment_text(t, 'nothing')", "segment_text(t, k)", "segment_window(t, 5, 5)", "segment_pattern(t, '(', 1)", "segment_pattern(t, 'a', -1)"):
        with pytest.raises(Exception, match="(?s)(no segmenter|constant|overlap|unterminated|negative)"):
            spark.sql(f"SELECT s.* FROM {{df}}, LATERAL {call} s", df=df).schema  # noqa: B018


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_lateral_sentences(spark):
    one, two = (sorted(map(tuple, catalog.QUERIES[n](spark, DATA).select("doc_id", "seg_no", "start", "end").collect())) for n in ("lateral_sentences", "sentence_segments"))
    assert one == two and one


# ---- mergeable aggregates -------------------------------------------------------------------------
def test_runs_merge_to_one(spark, tmp_path):
    rows = [("a", 1.0, [1.0, 2.0]), ("a", math.nan, [math.nan, 1.0]), ("a", None, None), ("b", -2.0, [0.5]), ("b", 3.0, [0.25, None, 4.0]), ("c", math.nan, []), (None, 7.0, [1.0])]
    df = lambda r: spark.createDataFrame(r, "k string, x double, v array<double>")
    one, many = (PartialStore(spark, f"file://{tmp_path}/{n}", "k", "x", "v") for n in ("one", "many"))
    one.add(df(rows), 0)
    for i, row in enumerate([*rows, rows[0], rows[3]]):  # the last two are retries
        many.add(df([row]), i % len(rows) if i < len(rows) else (0, 3)[i - len(rows)])
    rows_of = lambda s: (sorted(map(tuple, s.values().collect()), key=repr), sorted(map(tuple, s.vectors().collect()), key=repr))
    assert rows_of(one) == rows_of(many)
    assert {r["k"]: (r["n"], r["mean"], r["high"], r["total"]) for r in one.values().collect()} == {"a": (1, 1.0, 1.0, 1.0), "b": (2, 0.5, 3.0, 1.0), "c": (0, None, None, None), None: (1, 7.0, 7.0, 7.0)}
    assert {r["k"]: r["total"] for r in one.vectors().collect()} == {"a": [1.0, 3.0], "b": [0.75, 0.0, 4.0], None: [1.0]}


def test_a_stream_adds_to_what_stands(spark, tmp_path):
    store = PartialStore(spark, f"file://{tmp_path}/home", "k", "x")
    assert store.values().count() == 0 and store.vectors().count() == 0
    for part in (1, 2):
        spark.createDataFrame([("a", float(part)), ("b", 10.0)], "k string, x double").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        store.run(spark.readStream.schema("k string, x double").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/checkpoint")
    assert {r["k"]: (r["n"], r["total"]) for r in store.values().collect()} == {"a": (2, 3.0), "b": (2, 20.0)}


# ---- stems and overlap -------------------------------------------------------------------------
STEMS = (
    "caresses caress ponies poni ties tie cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan "
    "falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit "
    "radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous "
    "formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv "
    "allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt "
    "communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controlling control rolling roll dying die "
    "enjoy enjoy spied spi died die flies fli geology geolog as as"
).split()


def test_stems():
    for word, want in zip(STEMS[::2], STEMS[1::2], strict=True):
        assert stem.stem(word) == want, (word, stem.stem(word), want)


def test_stemmed_words():
    assert stem.stemmed_words("The Runner's RUNNING, ran 10kms: É-relational!") == ["the", "runner", "s", "run", "ran", "10km", "relat"]


def test_rouge(spark):
    cases = [("the cats were running", "a cat runs", 4 / 7), ("relational tables", "Relation table", 1.0), ("", "x", 0.0), (None, None, 0.0), ("a b c d", "d c b a", 0.25), ("same words", "same words", 1.0)]
    df = spark.createDataFrame([(i, p, r, "ab"[i % 2]) for i, (p, r, _) in enumerate(cases)], "i int, p string, r string, g string")
    got = {r["i"]: r["f"] for r in df.select("i", metrics.rouge_l_stemmed(F.col("p"), F.col("r")).alias("f")).collect()}
    assert all(got[i] == pytest.approx(w) for i, (_, _, w) in enumerate(cases))
    assert metrics.mean_rouge(df, "p", "r").first()["rouge"] == pytest.approx(sum(w for *_, w in cases) / len(cases))
    assert {r["g"]: round(r["rouge"], 9) for r in metrics.mean_rouge(df, "p", "r", "g").collect()} == {"a": round((4 / 7 + 0 + 0.25) / 3, 9), "b": round(2 / 3, 9)}
    assert metrics.mean_rouge(df.limit(0), "p", "r").first()["rouge"] == 0.0
    assert df.select(metrics.rouge_l(F.col("p"), F.col("r")).alias("f")).where("f = 1").count() == 2


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_rouge_of_turns(spark):
    """All turns against a plain table of common subsequences."""
    turns = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()}
    sums = {}
    for (conv, turn), (role, text) in turns.items():
        if (conv, turn - 1) in turns:
            a, b = stem.stemmed_words(text or ""), stem.stemmed_words(turns[conv, turn - 1][1] or "")
            row = [0] * (len(b) + 1)
            for x in a:
                row, old = [0], row
                for j, y in enumerate(b):
                    row.append(old[j] + 1 if x == y else max(old[j + 1], row[j]))
            sums.setdefault(role, []).append(2 * row[-1] / (len(a) + len(b)) if a and b else 0.0)
    got = {r["role"]: r["rouge"] for r in catalog.QUERIES["rouge_of_turns"](spark, DATA).collect()}
    assert got == {k: pytest.approx(sum(v) / len(v), abs=1e-8) for k, v in sums.items()}
