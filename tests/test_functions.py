import pytest
from pyspark.sql import functions as F

from chartloom.functions import answers, codes, lists, text


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


@pytest.mark.parametrize(("code", "d9", "p9", "d10"), [("4280", "428.0", "42.80", "428.0"), ("E8490", "E849.0", "E8.490", "E84.90"), ("428", "428", "42.8", "428"), ("428.0", "428.0", "428.0", "428.0"), ("", "", "", "")])
def test_dots(spark, code, d9, p9, d10):
    assert tuple(one(spark, codes.dot_diagnosis9(F.lit(code)), codes.dot_procedure9(F.lit(code)), codes.dot_diagnosis10(F.lit(code)))) == (d9, p9, d10)


def test_truncate_and_pad(spark):
    r = one(spark, codes.truncate_code(F.lit("A01.234"), 0), codes.truncate_code(F.lit("A01.234"), 2), codes.pad_seventh(F.lit("A01")), codes.pad_seventh(F.lit("A01.2")))
    assert tuple(r) == ("A01", "A01.23", "A01.XXX", "A01.2XX")


def test_titles(spark):
    title, modifiers = codes.split_title(F.lit("Fever (acute)  (high)"))
    assert tuple(one(spark, title, modifiers)) == ("Fever", ["acute", "high"])


@pytest.mark.parametrize(
    ("reply", "terms"),
    [("<answer>b, a, a</answer>", ["a", "b"]), ('<answer>["x", "y"]</answer>', ["x", "y"]), ('<answer>"q r" and "s"</answer>', ["q r", "s"]), ("none", []), (None, []), ("<answer></answer>", [])],
)
def test_answer_terms(spark, reply, terms):
    assert one(spark, answers.answer_terms(F.lit(reply).cast("string")))[0] == terms


@pytest.mark.parametrize(("reply", "ids"), [("<answer>IDs: 3, 1</answer>", [3, 1]), ("<answer>x</answer>", [0]), (None, [0])])
def test_answer_ids(spark, reply, ids):
    assert one(spark, answers.answer_ids(F.lit(reply).cast("string")))[0] == ids


def test_answer_ids_of_odd_items(spark):
    """What casts to an integer, and only that: against a split and a cast of every item, as it was."""
    marks = [*map(chr, range(0x180)), "\u2003", "\u3000", "\ufeff", "\u0663", "\uff15", "\U0001f600"]
    items = [x for c in marks for x in (f"{c}7", f"7{c}", f"7{c}8", c, f" {c}{c}-7 ", f"+{c}7,x")]
    items += ["2147483647", "2147483648", "-1", "+5", "--5", "5.", "5.0", "1e3", "0x1", "00012", "1-2", "", ",,", " , 5", "ID:5", "IDs:5IDs:6", "IDIDs::5", "IDID:s:5", "1ID:2", "ids:5", "9" * 5000 + "x", "12x 13 x14,15", "\x0015\x7f\x1c"]
    replies = [f"<answer>{x}</answer>" for x in items] + ["<answer>5", "5</answer>", "</answer>1<answer>2<answer>,3</answer>4</answer>", "<answer></answer><answer>5</answer>", "", None]
    df = spark.createDataFrame(list(enumerate(replies)), "i int, reply string")
    body = F.regexp_replace(F.coalesce(answers.answer_body(F.col("reply")), F.lit("")), r"IDs?:", "")
    for least in (0, 6, -10):
        cast = F.filter(F.transform(F.split(body, r"[,\s]+"), lambda x: x.try_cast("int")), lambda x: x.isNotNull() & (x >= least))  # noqa: B023
        want = F.when(F.size(cast) > 0, cast).otherwise(F.array(F.lit(0)))
        assert [r["reply"] for r in df.select("reply", want.alias("w"), answers.answer_ids(F.col("reply"), least).alias("g")).where(~F.col("g").eqNullSafe(F.col("w"))).collect()] == []


def test_answer_ids_are_worked_out_once(spark):
    """Each reply is made once, each list of numbers worked out once, and items that are no numbers are not cast."""
    replies = spark.createDataFrame([("IDs: 1, x, 2",)], "t string").select(F.concat(F.lit("<answer>"), F.upper("t"), F.lit("</answer>")).alias("reply"))
    out = replies.select(answers.answer_ids(F.col("reply")).alias("ids"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and plan.count("upper(") == 1 and "split(" not in plan
    assert out.first()["ids"] == [1, 2]


def test_lists(spark):
    a = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    r = one(spark, lists.chunks(a, 2), lists.decode_ids(F.array(F.lit(0), F.lit(2), F.lit(9)), a), lists.clean_codes(F.array(F.lit(""), F.lit("x"))), lists.null_safe_union(F.lit(None).cast("array<string>"), a), lists.chunks(F.array().cast("array<string>"), 2))
    assert tuple(r) == ([["a", "b"], ["c"]], ["b"], ["x"], ["a", "b", "c"], [])


def test_text(spark):
    start, end = text.trim_span(F.lit(" chest pain."), F.lit(0), F.lit(11))
    low, high = text.location_bounds(F.lit("3 9;12 20"))
    r = one(spark, start, end, low, high, text.literal_list(F.lit("['a b', 'c']")), text.safe_filename(F.lit("a b/c.txt")), text.human_number(F.lit(1234.0)), text.render("Hi {{ x }}!", x=F.lit("y")), text.extract_or_null(F.lit("abc"), r"(\d)"))
    assert tuple(r) == (1, 10, 3, 20, ["a b", "c"], "a-b-c.txt", "1.23K", "Hi y!", None)


def test_rewards(spark):
    good = "<reasoning>\nx\n</reasoning>\n<answer>\n7\n</answer>\n"
    assert tuple(one(spark, answers.strict_format_reward(F.lit(good)), answers.tag_count_reward(F.lit(good)), answers.integer_reward(F.lit(good)))) == (0.5, 0.5, 0.5)
