"""Readers, sinks, streams and the learned router on temporary files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rungwork import schemas
from rungwork.operators import calibration as ca
from rungwork.operators import reports as rep
from rungwork.operators import router_model as rm
from rungwork.operators import routing as ro
from rungwork.sources import readers as rd
from rungwork.sources import sinks as sk
from rungwork.streaming import calibration_stream as cs


def write_lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_log_reader_skips_blank_lines(spark, tmp_path):
    path = write_lines(tmp_path / "a.jsonl", [{"id": "1", "question": "q"}, "", {"id": "2", "question": "r"}])
    assert rd.read_log(spark, path, schemas.TOY_PROBLEMS).count() == 2
    empty = write_lines(tmp_path / "b.jsonl", [""])
    with pytest.raises(ValueError, match="no records"):
        rd.read_log(spark, empty, schemas.TOY_PROBLEMS, require_rows=True)
    assert [r["id"] for r in rd.read_first(spark, path, schemas.TOY_PROBLEMS, 1).collect()] == ["1"]


def test_strict_reader_and_quarantine(spark, tmp_path):
    path = write_lines(tmp_path / "a.jsonl", [{"id": "1"}, "{broken", {"id": "2"}])
    with pytest.raises(Exception):
        rd.read_log_strict(spark, path, schemas.TOY_PROBLEMS).collect()
    good, bad = rd.quarantine(spark, path, schemas.TOY_PROBLEMS)
    assert sorted(r["id"] for r in good.collect()) == ["1", "2"]
    row = bad.first()
    assert row["_corrupt_record"] == "{broken" and row["source_file"].endswith("a.jsonl")
    with pytest.raises(Exception):
        rd.read_log(spark, str(tmp_path / "missing"), schemas.TOY_PROBLEMS).collect()


def test_rollouts_of_several_files(spark, tmp_path):
    paths = [write_lines(tmp_path / f"{n}.jsonl", [{"id": n, "question": "q"}]) for n in "ab"]
    keys = {r["item_key"] for r in rd.read_rollouts(spark, paths).collect()}
    assert len(keys) == 2 and all("::" in k for k in keys)


@pytest.mark.parametrize("first_only", [True, False])
def test_metric_tree(spark, tmp_path, first_only):
    for method in ("base", "new"):
        for i, dataset in enumerate(rep.DATASETS):
            payload = {"main": {"pass@1": i / 10}} if first_only else {"note": 3, "main": {"pass@1": i / 10}}
            write_lines(tmp_path / f"eval_{method}" / dataset / "metric.json", [json.dumps(payload, indent=1)])
    got = rd.metric_tree(spark, str(tmp_path), first_only).collect()
    assert {(r["method"], r["dataset"]): r["score"] for r in got}[("new", "AMC23")] == pytest.approx(0.2)
    assert len(got) == 14


def test_metric_without_score_is_an_error(spark, tmp_path):
    write_lines(tmp_path / "AMC23" / "metric.json", [{"other": {"x": 1}}])
    with pytest.raises(Exception, match="no pass@1"):
        rd.metric_tree(spark, str(tmp_path)).collect()


def test_manifests(spark, tmp_path):
    text = write_lines(tmp_path / "roots.txt", [" a ", "", "b"])
    assert [r[0] for r in rd.read_manifest_text(spark, text).collect()] == ["a", "b"]
    one = write_lines(tmp_path / "m.jsonl", [{"question_key": "k", "phase": "graduated"}])
    assert rd.load_manifest(spark, one).count() == 1 and rd.load_manifest(spark, " ") is None
    two = write_lines(tmp_path / "n.jsonl", [{"question_key": "k"}, {"question_key": "k"}])
    with pytest.raises(ValueError, match="duplicate question_key"):
        rd.load_manifest(spark, two)


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "id string, n int")
    sk.append_log(df, str(tmp_path / "log"))
    sk.append_log(df, str(tmp_path / "log"))
    assert rd.read_log(spark, str(tmp_path / "log"), "id string, n int").count() == 4
    sk.write_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    sk.write_training_set(df, str(tmp_path / "set"), ("id",))
    assert spark.read.parquet(str(tmp_path / "set")).count() == 2
    assert not sk.write_if_any(df.limit(0), str(tmp_path / "none"))
    sk.write_summary(df.agg(F.count("*").alias("rows")), str(tmp_path / "sum"))
    assert spark.read.json(str(tmp_path / "sum")).first()["rows"] == 2
    shards = spark.createDataFrame([(0, "x", 1), (0, "y", 0), (1, "z", 0)], schemas.SHARD_MANIFESTS)
    sk.write_manifest_text(shards, str(tmp_path / "man"))
    assert [r[0] for r in rd.read_manifest_text(spark, str(tmp_path / "man" / "shard_index=0")).collect()] == ["y", "x"]
    files = rd.file_report(spark.read.parquet(str(tmp_path / "set"))).agg(F.sum("rows")).first()[0]
    assert files == 2


def test_problem_reader_bound_needs_the_column(spark, tmp_path):
    spark.createDataFrame([("a", 0.9), ("b", 0.1)], "id string, accuracy double").write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([("a",)], "id string").write.parquet(str(tmp_path / "q"))
    assert rd.read_problems(spark, str(tmp_path / "p"), 0.5).count() == 1
    assert rd.read_problems(spark, str(tmp_path / "q"), 0.5).count() == 1


def test_contract_check(spark):
    got = {r["check"]: r["ok"] for r in rep.contract_check(spark.range(3), ["id", "question"], 3).collect()}
    assert got == {"column id": True, "column question": False, "rows": True}


def rollout(root, candidate, variant, index, correct):
    return {"root_id": root, "candidate_id": candidate, "variant": variant, "sample_index": index, "correct": correct}


CANDIDATES = "root_id string, id string, dimension string, minimal_plan string"


def run(query_df, out, checkpoint):
    query = query_df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def test_sequential_stop_follows_the_batch_rule(spark, tmp_path):
    candidates = spark.createDataFrame([("r", "c", "planning", "factor first"), ("s", "d", "planning", "go")], CANDIDATES)
    first = [rollout("r", "", "no_help", 0, False), rollout("r", "c", "relevant_plan", 0, True), rollout("r", "c", "random_plan", 0, False)]
    first += [rollout("s", "", "no_help", 0, False), rollout("s", "d", "relevant_plan", 0, False), rollout("s", "d", "random_plan", 0, False)]
    second = [rollout("r", "", "no_help", 1, False), rollout("r", "c", "relevant_plan", 1, False), rollout("r", "c", "random_plan", 1, False)]
    second += [first[0], rollout("s", "", "no_help", 1, True), rollout("s", "d", "relevant_plan", 1, False), rollout("s", "d", "random_plan", 1, False)]
    folder, out, cp = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "cp")

    def decide():
        stream = cs.read_stream(spark, str(folder), schemas.HELP_RESULTS)
        run(cs.sequential_stop(stream, candidates, 0.25, 0.60, 0.0, 1, 2, 1), out, cp)
        return [(r["root_id"], r["status"], r["prefix"], r["wave_end"]) for r in spark.read.schema(cs.DECISION).parquet(out).collect()]

    write_lines(folder / "1.json", first)
    assert sorted(decide()) == [("r", "next_wave", 1, 2), ("s", "next_wave", 1, 2)]
    write_lines(folder / "2.json", second)
    later = sorted(decide())
    assert ("r", "selected", 2, None) in later and ("s", "exhausted", 2, None) in later and len(later) == 4
    log = rd.read_log(spark, str(folder), schemas.HELP_RESULTS).dropDuplicates(list(cs.KEYS))
    batch = ca.causal_candidates(candidates, log, 0.25, 0.60).collect()
    assert [(b["root_id"], b["id"], b["success_probability"]) for b in batch] == [("r", "c", 0.5)]


def test_ingest_is_exactly_once(spark, tmp_path):
    row = rollout("r", "c", "relevant_plan", 0, True)
    for n in (1, 2):
        write_lines(tmp_path / "log" / f"{n}.json", [row, rollout("r", "c", "relevant_plan", n, False), row])
        stream = cs.read_stream(spark, str(tmp_path / "log"), schemas.HELP_RESULTS)
        cs.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_ledger_outlives_the_streaming_state(spark, tmp_path):
    """A replayed key is ignored by a query with a new checkpoint; a batch that runs again leaves one copy."""
    log, out = tmp_path / "log", str(tmp_path / "out")
    rows = [rollout(f"r{k}", "c", "relevant_plan", k, True) for k in range(40)] + [rollout("r0", None, "no_help", 0, True)] * 2
    write_lines(log / "1.json", rows)

    def copy(checkpoint):
        cs.ingest(cs.read_stream(spark, str(log), schemas.HELP_RESULTS), out, str(tmp_path / checkpoint)).awaitTermination()
        return spark.read.parquet(out)

    assert copy("first").count() == 41
    write_lines(log / "2.json", rows[:5] + [rollout("new", "c", "random_plan", 0, False)])
    assert copy("second").count() == 42  # all files again, with another query id
    assert copy("second").count() == 42
    queries = {r["query"] for r in copy("second").select("query").distinct().collect()}
    assert len(queries) == 2
    # the offsets say that the last batch has not ended, so it runs again
    commits = sorted((tmp_path / "second" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for name in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        name.unlink(missing_ok=True)
    assert copy("second").count() == 42
    ledger = spark.read.parquet(f"{out}-ledger")
    assert ledger.count() == 42 == ledger.select(*cs.KEYS).distinct().count()


def test_sequential_stop_over_batches_and_restarts(spark, tmp_path):
    """Small batches with restarts end where the batch rule ends, and decided roots keep one word of state."""
    rng = random.Random(9)
    roots = [f"r{k}" for k in range(12)]
    candidates = spark.createDataFrame([(r, f"{r}::{d}", d, "use it") for r in roots for d in ("planning", "knowledge")], CANDIDATES)
    rows = [
        {**rollout(r, c, v, i, rng.random() < 0.5), "log_pos": n}
        for n, (i, r, c, v) in enumerate((i, r, c, v) for i in range(3) for r in roots for c, v in [("", "no_help"), *((f"{r}::{d}", v) for d in ("planning", "knowledge") for v in ("relevant_plan", "random_plan"))])
    ]
    rows += [{**rollout("r0", "unknown", "relevant_plan", 0, True), "log_pos": 999}, {**rollout("r0", "", "no_help", 7, True), "log_pos": 1000}]
    log, out, cp = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "cp")
    step = len(rows) // 4 + 1
    for n in range(4):  # every run starts the query anew on the same checkpoint, with some rows again
        write_lines(log / f"{n}.json", rows[n * step : (n + 1) * step] + rows[: n * 3])
        run(cs.sequential_stop(cs.read_stream(spark, str(log), schemas.HELP_RESULTS), candidates, 0.3, 0.7, 0.0, 1, 3, 1), out, cp)
    got = {}
    for r in spark.read.schema(cs.DECISION).parquet(out).collect():
        got.setdefault(r["root_id"], []).append(r["status"])
    assert all("next_wave" in s or s in ("selected", "exhausted") for statuses in got.values() for s in statuses)
    assert set(got) == set(roots) and all(sum(s != "next_wave" for s in statuses) <= 1 for statuses in got.values())
    # a root without an early choice has seen everything: it is chosen by the batch rule, or exhausted
    log_rows = spark.createDataFrame([(r["root_id"], r["candidate_id"], r["variant"], r["sample_index"], r["correct"]) for r in rows if r["sample_index"] < 3], "root_id string, candidate_id string, variant string, sample_index int, correct boolean")
    chosen = {r["root_id"] for r in ca.causal_candidates(candidates, log_rows, 0.3, 0.7).collect()}
    for root, statuses in got.items():
        assert any(s != "next_wave" for s in statuses)
        if "exhausted" in statuses:
            assert root not in chosen
    cells = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "cells").load(cp)
    assert cells.count() == 0  # all roots are decided: their masks are released
    masks = spark.read.format("statestore").option("operatorId", 1).option("stateVarName", "masks").load(cp)
    assert masks.count() <= len(roots) * 5  # one row a known key, however often it was logged


def test_running_q_matches_batch(spark, tmp_path):
    rows = [rollout("r", "c", "relevant_plan", i, i % 2 == 0) for i in range(5)]
    for n in (1, 2):
        write_lines(tmp_path / "log" / f"{n}.json", rows[: n * 2])
        stream = cs.read_stream(spark, str(tmp_path / "log"), schemas.HELP_RESULTS)
        cs.write_updates(cs.running_q(stream), str(tmp_path / "q"), str(tmp_path / "cp")).awaitTermination()
    got = cs.latest(spark, str(tmp_path / "q"), ["root_id", "candidate_id", "variant"]).collect()
    assert [(r["samples"], r["hits"], r["q"]) for r in got] == [(6, 3, 0.5)]


def test_router_learns_and_reloads(spark, tmp_path):
    rows = []
    for i in range(60):
        hard = i % 2 == 0
        text = f"prove the hard lemma number {i}" if hard else f"add two small numbers {i}"
        rows.append((f"q{i}", text, "none", "none", 0.0, 0.0, not hard if i % 10 else hard))
        rows.append((f"q{i}", text, "solution@100", "solution", 1.0, 40.0, True))
    df = spark.createDataFrame(rows, "item_key string, question string, arm_name string, arm_kind string, arm_strength double, hint_tokens double, correct boolean")
    labelled = rm.with_split(df, seed=1)
    router = rm.fit_router(labelled, max_features=500, max_iter=30)
    test = labelled.filter("split = 'test'").withColumn("arm_name", F.when(F.col("arm_name") == "none", "none").otherwise("unseen"))
    scored = router.score(test)
    plain = scored.select(F.col("correct").cast("int").alias("label"), F.col("predicted_success").alias("p"))
    metrics = ro.probability_metrics(plain).first()
    assert metrics["roc_auc"] > 0.8 and metrics["rows"] == test.count()
    router.save(str(tmp_path / "router"))
    again = rm.Router.load(str(tmp_path / "router")).score(test)
    key = lambda d: sorted((r["item_key"], r["arm_name"], round(r["predicted_success"], 9)) for r in d.collect())
    assert key(again) == key(scored)
    with pytest.raises(ValueError, match="both reward classes"):
        rm.fit_router(labelled.withColumn("correct", F.lit(True)))
    assert sum(r["items"] for r in rm.split_report(labelled).collect()) == 60


def test_router_query_fits_with_the_sizes_of_the_reference(spark, monkeypatch):
    from rungwork.plans import queries_streaming

    fit, made = rm.fit_router, []
    monkeypatch.setattr(rm, "fit_router", lambda *a, **b: made.append(fit(*a, **b)) or made[0])
    assert queries_streaming.router_ml(spark, "/root/testdata/sf0.001").count() == 1
    words, chars = (s for s in made[0].counts.stages if hasattr(s, "vocabulary"))
    assert (words.getVocabSize(), chars.getVocabSize()) == (10_000, 10_000) and len(chars.vocabulary) > 2_000
    assert made[0].classifier.getMaxIter() == 1_000


def test_written_logs_are_compressed_files_of_bounded_rows(spark, tmp_path, monkeypatch):
    df = spark.range(1_000).select(F.lit("the same text over and over").alias("text"), "id").coalesce(1)
    sk.write_log(df, str(tmp_path / "log"))
    files = list((tmp_path / "log").glob("part-*"))
    assert len(files) == 1 and files[0].stat().st_size < 1_000 * 20
    monkeypatch.setattr(sk, "LOG_FILE_ROWS", 300)
    sk.write_log(df, str(tmp_path / "log"))
    assert len(list((tmp_path / "log").glob("part-*"))) == 4
    assert sorted(r.id for r in rd.read_log(spark, str(tmp_path / "log"), "text string, id bigint").collect()) == list(range(1_000))
