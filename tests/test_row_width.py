"""Plans whose sorts and shuffles carry short values instead of texts."""

from rungwork.plans.catalog import REGISTRY

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_job_table_groups_digests_not_prompts(spark):
    plan = _plan(REGISTRY["job_table"].run(spark, SF))
    assert "min(prompt_digest" in plan and "min(sha1" not in plan


def test_pieces_of_plan_keys_are_cut_in_a_fixed_number_of_tasks(spark):
    from rungwork.operators import controls

    keys = spark.createDataFrame([(k,) for k in ("abcab", "abcab", "xy", "")], "plan_key string")
    secrets = spark.createDataFrame([("ab",), ("x",), ("zz",), ("",)], "secret string")
    found = controls.shown_secrets(keys, secrets)
    assert sorted(map(tuple, found.collect())) == [("abcab", "ab"), ("xy", "x")]
    assert "REPARTITION_BY_NUM" in _plan(found)
