"""Scalar expressions on literal tables."""

import pytest
from pyspark.sql import functions as F

from rungwork.functions import prompts
from rungwork.functions import scoring as sc
from rungwork.functions import text as tx
from rungwork.operators import admission as ad
from rungwork.operators import grading as gr


def one(spark, expr, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], names) if names else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_question_key_ignores_blanks_but_not_content(spark):
    df = spark.createDataFrame([("a  b\n c",), ("a b c",), (" a b c\t",), ("a b d",)], "q string")
    keys = [r[0] for r in df.select(tx.question_key("q")).collect()]
    assert keys[0] == keys[1] == keys[2] == "6b3f339c67bb03d5"
    assert keys[3] != keys[0]


def test_item_id_separates_reused_source_ids(spark):
    df = spark.createDataFrame([("7", "q one"), ("7", "q two")], "s string, q string")
    ids = [r[0] for r in df.select(tx.item_id("s", "q")).collect()]
    assert ids[0] != ids[1] and all(i.startswith("7::") and len(i) == 15 for i in ids)


def test_clean_parts(spark):
    df = spark.createDataFrame([(["a", " ", "b"],), (None,)], "p array<string>")
    assert [r[0] for r in df.select(tx.clean_parts("p")).collect()] == [["a", "b"], []]
    assert df.select(tx.parts_text("p")).first()[0] == "a\nb"
    assert one(spark, tx.parts_of_text("v"), v="x") == ["x"]


def test_three_answer_keys_differ(spark):
    df = spark.createDataFrame([("\\boxed{ {A} b}} $1",)], "v string")
    lazy, greedy, alnum = df.select(tx.answer_key("v"), tx.answer_key_greedy("v"), tx.alnum_key("v")).first()
    assert (lazy, greedy, alnum) == ("ab1", "ab1", "ab1")
    assert one(spark, tx.answer_key("v"), v="\\boxed {x+ Y}") == "x+y"
    assert one(spark, tx.alnum_key("v"), v="X+Y-1") == "xy1"


def plan(spark, step, words=6, relation="", subproblem="", answer="5", reference="13"):
    df = spark.createDataFrame(
        [(step, relation, subproblem, answer, reference)],
        "source_step string, relation string, subproblem string, subproblem_answer string, reference string",
    )
    return ad.plan_candidates(df, words).first()["minimal_plan"]


def test_minimal_plan_is_short_and_hides_answers(spark):
    text = "Use the Pythagorean theorem to determine the missing side before substitution"
    assert plan(spark, text) == "Use the Pythagorean theorem to determine"
    assert plan(spark, "The missing side is 5", words=12) == ""
    assert plan(spark, "Compute thirteen 1 3 now", words=12) == ""
    assert plan(spark, "  ", relation=" factor first. ") == "factor first"
    assert plan(spark, None, subproblem=None, relation=None) == ""


def test_usable_plans_drops_only_empty_ones(spark):
    df = spark.createDataFrame(
        [("a", "go on", "", "", "9", "8"), ("b", "say 9", "", "", "9", "8")],
        "id string, source_step string, relation string, subproblem string, subproblem_answer string, reference string",
    )
    assert [r["id"] for r in ad.usable_plans(df).collect()] == ["a"]


def test_reference_solution_order(spark):
    df = spark.createDataFrame([(" ", " think ", "ans", "r"), (None, None, "", "r")], "a string, b string, c string, r string")
    got = [r[0] for r in df.select(tx.reference_solution("r", "a", "b", "c", stripped=True)).collect()]
    assert got == ["think", "r"]


def test_unboxed_and_data_source(spark):
    assert one(spark, tx.unboxed("v"), v=" \\boxed{7} ") == "7"
    assert one(spark, tx.unboxed("v"), v="x \\boxed{7}") == "x \\boxed{7}"
    df = spark.createDataFrame([("math::verifiable_subproblem",), ("math",), (None,)], "d string")
    assert [r[0] for r in df.select(tx.normal_data_source("d")).collect()] == ["math", "math", None]


@pytest.mark.parametrize(
    ("text", "complete"),
    [
        ("answer \\boxed{\\frac{1}{2}}", True),
        ("answer \\boxed{\\frac{1}{2}", False),
        ("\\boxed{1} then \\boxed{2", True),
        ("\\boxed{1} then \\boxed", False),
        ("\\boxed{a{b} \\boxed{c}", True),
        ("no wrapper {}", False),
        ("} \\boxed x {y}", True),
    ],
)
def test_boxed_complete(spark, text, complete):
    assert one(spark, tx.boxed_complete("t"), t=text) is complete


def test_grading_is_exact(spark):
    cases = [
        ("FINAL_ANSWER: 1,275", "1275", True),
        ("final_answer: 3/8", "0.375", True),
        ("FINAL_ANSWER: $86.40", "432/5", True),
        ("FINAL_ANSWER: 1\nFINAL_ANSWER: 2", "2", True),
        ("about .5", "1/2", True),
        ("5.", "+5", True),
        ("-6/-4", "1.5", True),
        ("3/0", "3", False),
        ("nothing", "3", False),
        ("0.33", "1/3", False),
        ("1000000000000000000000000000001/2", "500000000000000000000000000000.5", True),
        ("1000000000000000000000000000001/2", "500000000000000000000000000000.6", False),
    ]
    df = spark.createDataFrame(cases, "text string, reference string, want boolean")
    got = gr.grade_rollouts(df).collect()
    assert len(got) == len(cases)
    assert [(r["text"], r["correct"]) for r in got if r["correct"] != r["want"]] == []


def test_grading_accepts_a_user_verifier(spark):
    same = F.pandas_udf(lambda a, b: a == b, "boolean")
    df = spark.createDataFrame([("x", "x"), ("x", "y")], "text string, reference string")
    assert [r["correct"] for r in gr.grade_rollouts(df, verifier=same).collect()] == [True, False]


def test_parse_cascade(spark):
    texts = [
        "<Subproblem> what is\n 1+1? </subproblem> <answer> 2 </answer>",
        'text ```json\n{"question": "find x", "target": 4}\n```',
        "Subproblem: find y\nquickly\n Answer: 3\nbye",
        "nothing here",
        "<subproblem> </subproblem><answer>1</answer>",
        "{not json} question: q1\nanswer: a1",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: (r["subproblem"], r["subproblem_answer"]) for r in ad.parse_generations(df).collect()}
    assert got[0] == ("what is 1+1?", "2")
    assert got[1] == ("find x", "4")
    assert got[2] == ("find y quickly", "3")
    assert got[3] == (None, None) and got[4] == (None, None)
    assert got[5] == ("q1", "a1")


def test_verification_and_labels(spark):
    df = spark.createDataFrame(
        [("<state> a  b</state><verify>is it so</verify>",), ("no tags: Knowledge, yes",)], "text string"
    )
    a, b = ad.parse_generations(df).collect()
    assert (a["tentative_state"], a["verification_question"]) == ("a b", "is it so?")
    assert b["verification_question"] == tx.DEFAULT_VERIFICATION
    assert (a["oracle_answer"], b["oracle_answer"]) == ("UNKNOWN", "NO")
    assert (a["action"], b["action"]) == (None, "KNOWLEDGE")


def test_scaffold_name(spark):
    assert one(spark, tx.scaffold_kind("n"), n="planning@25") == "planning"
    assert one(spark, tx.scaffold_strength("n"), n="planning@12.5") == 0.125
    with pytest.raises(Exception, match="planning@25"):
        one(spark, tx.scaffold_strength("n"), n="planning-25")


def test_admission_rules(spark):
    ok = '{"subproblem": "q", "answer": "4", "relation": "", "source_step": "", "verification": ""}'
    leak = ok.replace('"4"', '"\\\\boxed{9}"')
    longer = ok.replace('"q"', '"' + "x" * 1201 + '"')
    content = {
        "good": '{"candidates": {"knowledge": %s, "planning": %s}}' % (ok, ok),
        "missing": '{"candidates": {"knowledge": %s}}' % ok,
        "leak": '{"candidates": {"knowledge": %s, "planning": %s}}' % (ok, leak),
        "long": '{"candidates": {"knowledge": %s, "planning": %s}}' % (longer, ok),
        "junk": "oops",
    }
    df = spark.createDataFrame([(k, "9", v) for k, v in content.items()], "root_id string, reference string, content string")
    got = ad.admit_candidates(df, ("knowledge", "planning")).collect()
    reason = {r["root_id"]: (r["reject_reason"], r["terminal"]) for r in got}
    assert len(got) == 10
    assert reason["good"] == (None, False)
    assert reason["missing"][0] == "response is missing candidate dimensions: planning"
    assert reason["leak"] == (tx.LEAK_BY_ANSWER, True)
    assert reason["long"] == ("subproblem is too long", False)
    assert reason["junk"][0] == "response is not valid JSON"
    with pytest.raises(ValueError):
        ad.admit_candidates(df, ("other",))


def test_terminal_failures_and_open_requests(spark):
    errors = spark.createDataFrame(
        [
            ("leak", f"ValueError: {tx.LEAK_BY_ANSWER}", None),
            ("flag", "ValueError: other", True),
            ("net", "URLError: timed out", False),
            ("json", "JSONDecodeError: x", None),
        ],
        "id string, error string, terminal boolean",
    )
    assert {r[0] for r in ad.terminal_roots(errors).collect()} == {"leak", "flag"}
    roots = spark.createDataFrame([("leak",), ("net",)], "root_id string")
    done = spark.createDataFrame([("net::knowledge",)], "id string")
    left = ad.open_requests(roots, done, errors).collect()
    assert {r["id"] for r in left} == {"net::planning", "net::calculation"}
    reasons = {r["reason"]: r["roots"] for r in ad.failure_reasons(errors).collect()}
    assert reasons == {"ValueError": 2, "URLError": 1, "JSONDecodeError": 1}


def test_informative_probability_peaks_at_half(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (0.9,)], "p double")
    low, mid, high = [r[0] for r in df.select(sc.informative("p", 8)).collect()]
    assert mid > low and mid > high
    with pytest.raises(ValueError):
        sc.informative("p", 1)


def test_fading(spark):
    assert one(spark, sc.visible_fraction(F.col("s"), 0, 10), s=5) == 0.5
    parts = spark.createDataFrame(
        [(["a", "b", "c", "d"],), (["derive the symmetric term before simplifying"],), ([" "],)], "p array<string>"
    )
    got = [r[0] for r in parts.select(sc.fade_parts("p", F.lit(0.5))).collect()]
    assert got == [["a", "b"], ["derive the symmetric"], []]
    assert parts.select(sc.fade_parts("p", F.lit(0.0))).first()[0] == []
    df = spark.createDataFrame([(0.0,), (0.5,), (0.125,), (1.0,)], "f double")
    assert [r[0] for r in df.select(sc.guided_count(4, F.col("f"))).collect()] == [0, 2, 1, 4]


def test_importance_weight(spark):
    df = spark.createDataFrame([([-1.0, -1.0], [-2.0, -2.0], [1, 1])], "t array<double>, b array<double>, m array<int>")
    assert df.select(sc.importance_weight("t", "b")).first()[0] == pytest.approx(5.0)
    assert df.select(sc.importance_weight("t", "b", "m", 0.1, 10.0, True)).first()[0] == pytest.approx(2.718281828)
    bad = spark.createDataFrame([([1.0], [1.0, 2.0])], "t array<double>, b array<double>")
    with pytest.raises(Exception, match="equal length"):
        bad.select(sc.importance_weight("t", "b")).collect()


def test_prompts(spark):
    df = spark.createDataFrame([("Q", "planning", 0.25, "1. p")], "question string, kind string, strength double, hint string")
    text = df.select(prompts.arm_prompt("kind", "strength", "hint")).first()[0]
    assert text.startswith("Q\n\nOptional planning scaffold (25%):\n1. p\n\nUse")
    assert df.select(prompts.plan_prompt("question", F.lit(""))).first()[0] == "Q"
    assert "Minimal plan (no answer is provided): go" in df.select(prompts.plan_prompt("question", F.lit("go"))).first()[0]
    tail = df.select(prompts.retry_prompt(F.lit("abcdef"), F.lit(False), tail=3)).first()[0]
    assert "attempt was:\ndef\n" in tail and "correct: NO." in tail
    assert df.select(prompts.curriculum_prompt("kind", F.array(F.lit("a"), F.lit("b")))).first()[0] == "Question: Q\nPlanning Hints: a b"


def test_teacher_prompt(spark):
    df = spark.createDataFrame([(" Q ", "9", ["k"], ["p"], ["s"], "sol")], "question string, reference string, knowledge_components_parts array<string>, planning_skeleton_parts array<string>, solution_breakdown_parts array<string>, reference_solution string")
    text = df.select(prompts.teacher_prompt(("planning",))).first()[0]
    assert "Original problem:\nQ\n" in text and text.endswith("Reference solution:\nsol")
    assert '"planning": {"subproblem": "...", "answer": "..."' in text and '"knowledge"' not in text
