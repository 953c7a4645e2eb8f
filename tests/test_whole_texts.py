"""The bridge reads whole texts; strict responses; independent draws; trainable pairs."""

import json

from pyspark.sql import functions as F

from rungwork.operators import admission as ad
from rungwork.operators import mixing as mx
from rungwork.operators import variants as va
from rungwork.sources import bridge


def documents(spark, folder, text):
    rows = [(1, text, "en", "src0", len(text)), (2, "one. two. three.", "fr", "src1", 16)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_the_last_sentence_of_a_long_text_counts(spark, tmp_path):
    base = " ".join(f"Sentence number {k}." for k in range(400))
    seen = []
    for name, end in (("a", " Ends here"), ("b", " Ends elsewhere")):
        folder = documents(spark, tmp_path / name, base + end)
        subs = sorted(r.subproblem for r in bridge.candidates(spark, folder).filter("root_id = '1'").collect())
        row = bridge.problems(spark, folder).filter("log_pos = 1").first()
        hints = sorted([*row.knowledge_components_parts, *row.planning_skeleton_parts, *row.solution_breakdown_parts])
        assert sum(map(len, subs)) >= len(base) - 402  # all but the full stops between the three
        seen.append((subs, hints))
    assert seen[0][0] != seen[1][0] and seen[0][1] != seen[1][1]


def entry(**changes):
    return {"subproblem": "what is 1 + 1", "answer": "2", "relation": "", "source_step": "", "verification": "count"} | changes


def test_responses_must_be_one_json_object(spark):
    good = {"candidates": {d: entry() for d in ("knowledge", "planning", "calculation")}}
    listed = {"candidates": {d: entry(answer=["2", " ", "two"]) for d in good["candidates"]}}
    bare = {"candidates": good["candidates"] | {"planning": "text"}}
    rows = [
        ("good", json.dumps(good)),
        ("trailing", json.dumps(good) + " trailing"),
        ("two", json.dumps(good) + json.dumps(good)),
        ("quotes", str(good)),
        ("list", json.dumps(listed)),
        ("bare", json.dumps(bare)),
        ("array", json.dumps([good])),
        ("none", None),
        ("other", json.dumps({"candidates": []})),
    ]
    table = spark.createDataFrame([(n, c, "9") for n, c in rows], "name string, content string, reference string")
    got = {(r.name, r.dimension): r for r in ad.admit_candidates(table).collect()}
    reason = {n: got[n, "planning"].reject_reason for n, _ in rows}
    assert reason["good"] is None and reason["list"] is None
    assert got["list", "planning"].subproblem_answer == "2\ntwo"
    assert {reason[n] for n in ("trailing", "two", "quotes", "array", "none")} == {"response is not valid JSON"}
    assert reason["bare"] == "response is not a JSON object"
    assert reason["other"] == "response does not contain a candidates JSON object"


def test_random_bit_and_action_are_independent(spark):
    jobs = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.lit(0).alias("sample_index"))
    counts = va.assign_conditions(jobs, seed=42).groupBy("random_bit", "random_action").count().collect()
    assert len(counts) == 8 and all(400 <= r["count"] <= 600 for r in counts)


def test_only_trainable_candidates_make_decorated_pairs(spark, tmp_path):
    folder = documents(spark, tmp_path, "a b. c d. e f. g h")
    rows = bridge.candidates(spark, folder).filter("root_id = '1'").withColumns(
        {
            "success_probability": F.lit(0.5),
            "no_help_probability": F.lit(0.1),
            "random_plan_probability": F.lit(0.2),
            "trainable": F.col("dimension") == "knowledge",
            "minimal_plan": F.concat(F.lit("plan of "), F.col("dimension")),
        }
    )
    out = mx.plan_decorated_roots(bridge.problems(spark, folder), rows).collect()
    assert [r.candidate_id for r in out] == ["1::knowledge"]
    assert out[0].decision.minimal_plan == "plan of calculation"  # the lookup takes the last, trainable or not


def test_subproblem_rows_keep_other_reward_fields(spark, tmp_path):
    folder = documents(spark, tmp_path, "a b. c d. e f. g h")
    problems = bridge.problems(spark, folder).withColumns(
        {"reward_model": F.col("reward_model").withField("judge", F.lit("exact")), "parsed_output": F.lit("old")}
    )
    rows = bridge.candidates(spark, folder).filter("id = '1::planning'").withColumns(
        {"success_probability": F.lit(0.5), "no_help_probability": F.lit(0.1), "random_plan_probability": F.lit(0.2), "trainable": F.lit(True)}
    )
    by_slot = {r.slot: r for r in mx.training_mix(problems, rows).collect()}
    assert by_slot[1].reward_model.judge == "exact" and by_slot[1].parsed_output is None
    assert by_slot[0].parsed_output == "old"
