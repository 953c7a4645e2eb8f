"""Ring controls look at near slots first; only secrets of open roots are indexed."""

from rungwork.operators import controls as co

PLANS = "root_id string, id string, dimension string, reference string, minimal_plan string, log_pos bigint"


def test_only_secrets_of_open_roots_are_indexed(spark, monkeypatch):
    n = 300
    rows = [(f"r{i}", f"c{i}", "knowledge", "x" if i % 50 == 0 else f"q{i}", "clean" if i == 1 else f"x plan {i}", i) for i in range(n)]
    indexed, whole = [], co.shown_secrets
    monkeypatch.setattr(co, "shown_secrets", lambda keys, secrets: indexed.append({r["secret"] for r in secrets.select("secret").collect()}) or whole(keys, secrets))
    got = {r["id"]: r["control_id"] for r in co.ring_controls(spark.createDataFrame(rows, PLANS), 42).collect()}
    assert all(indexed) and set().union(*indexed) <= {"x"} and len(got) == n
    assert {got[f"c{i}"] for i in range(0, n, 50)} == {"c1"}


def test_probes_change_no_control(spark, monkeypatch):
    rows = [(f"r{i}", f"c{i}", "knowledge", "ab"[i % 2] if i % 3 else "", "a b" if i % 7 else f"z{i}", i) for i in range(90)]
    df, found = spark.createDataFrame(rows, PLANS), []
    for probed, rounds in ((64, 4), (0, 0), (2, 2)):
        monkeypatch.setattr(co, "PROBED", probed)
        monkeypatch.setattr(co, "PROBES", rounds)
        found.append(sorted(tuple(r) for r in co.ring_controls(df, 42).select("id", "control_id", "step").collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == 90


def test_pieces_meet_listed_secrets_without_a_shuffle(spark, monkeypatch):
    keys = spark.createDataFrame([(k,) for k in ("abcab", "xy")], "plan_key string")
    secrets = spark.createDataFrame([("ab",), ("x",)], "secret string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    text = plan(co.shown_secrets(keys, secrets))
    assert "BroadcastHashJoin [secret" in text and "hashpartitioning(secret" not in text.split("BroadcastExchange")[0]
    monkeypatch.setattr(co, "LISTED", 1)
    assert sorted(map(tuple, co.shown_secrets(keys, secrets).collect())) == [("abcab", "ab"), ("xy", "x")]
