"""The stop rule's log rows are packed before they move, and its state is one value a bucket of roots."""

import random

import pyarrow as pa
from pyspark.sql import Row

from rungwork.streaming import calibration_stream as cs

CANDIDATES = "root_id string, id string, dimension string, minimal_plan string"
ROWS = ["bucket", "root_id", "candidate_id", "variant", "sample_index", "correct", "place"]


def test_packs_keep_the_first_arrivals(monkeypatch):
    rng = random.Random(4)
    rows = [(r % 3, f"r{r}", rng.choice(["", "a", "b"]), rng.choice(["x", "y"]), rng.randrange(3), rng.random() < 0.5, n) for n, r in enumerate(rng.randrange(7) for _ in range(2_000))]
    rng.shuffle(rows)
    want = {}
    for bucket, *cell, correct, place in sorted(rows, key=lambda r: r[-1]):
        want.setdefault((bucket, *cell), (correct, place))
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int64()))], ROWS)
    for size in (10_000, 300):
        monkeypatch.setattr(cs, "PACKED", size)
        packs = [r for b in cs.packed(iter(table.to_batches(max_chunksize=100))) for r in b.to_pylist()]
        got = {}
        for p in packs:
            for *cell, correct, place in zip(*(p[c] for c in ROWS[1:])):
                key = (p["bucket"], *cell)
                got[key] = min(got.get(key, (place, correct)), (place, correct))
        assert {k: v[::-1] for k, v in got.items()} == want
        assert len(packs) <= 3 * -(-2_000 // size)


def test_state_is_read_once_a_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cs, "ROOT_BUCKETS", 2)
    roots = [f"r{k}" for k in range(30)]
    candidates = spark.createDataFrame([(r, f"{r}::p", "planning", "use it") for r in roots], CANDIDATES)
    rows = [(r, c, v, 0, True, n) for n, (r, (c, v)) in enumerate((r, k) for r in roots for k in (("", "no_help"), (f"{r}::p", "relevant_plan")))]
    log, out, cp = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "root_id string, candidate_id string, variant string, sample_index int, correct boolean, log_pos bigint"
    spark.createDataFrame(rows, schema).write.json(str(log))
    decisions = cs.sequential_stop(cs.read_stream(spark, str(log), schema), candidates, 0.3, 0.7, 0.0, 1, 2, 1)
    query = decisions.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp)
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["root_id"] for r in spark.read.schema(cs.DECISION).parquet(out).collect()) == sorted(roots)
    for operator, name in ((0, "cells"), (1, "masks")):
        assert spark.read.format("statestore").option("operatorId", operator).option("stateVarName", name).load(cp).count() == 2


class Value:
    """A value state of one key."""

    held = None
    exists = lambda self: self.held is not None
    get = lambda self: self.held
    update = lambda self, value: setattr(self, "held", value)
    clear = lambda self: setattr(self, "held", None)


class Clock:
    def __init__(self, now):
        self.getCurrentProcessingTimeInMs = lambda: now


def test_keys_of_a_bucket_expire_one_by_one():
    def pack(root, index):
        return Row(bucket=0, root_id=[root], candidate_id=[""], variant=["no_help"], sample_index=[index], correct=[True], place=[1])

    stage, rule = cs.SampleMasks(100), cs.StopRule(0.0, 1.0, 0.0, 1, 2, 1, 100)
    stage.masks, rule.cells, rule.decided = Value(), Value(), Value()
    roots = [Row(root_id=r, members=[Row(id="c", plan_words=1, dimension_rank=0)]) for r in ("a", "b")]
    held = []
    for now, root, index in ((0, "a", 0), (60, "b", 0), (120, "b", 1)):
        for row in stage.handleInputRows((0,), iter([pack(root, index)]), Clock(now)):
            found = list(rule.handleInputRows((0,), iter([Row(bucket=0, cells=row.cells, roots=roots)]), Clock(now)))
            assert [r.root_id for r in found] == [root]
        held.append((sorted(k[0] for k in cs._read(stage.masks)), sorted(cs._read(rule.cells))))
    assert held == [(["a"], ["a"]), (["a", "b"], ["a", "b"]), (["b"], ["b"])]
