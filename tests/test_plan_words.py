"""First and last words of long texts."""

import random

from pyspark.sql import functions as F

from rungwork.functions import text as tx

BLANKS = [" ", "  ", "\t", "\n", "\x0b", "\x1c", "\x85", " ", " ", " \t ", "\n "]


def test_head_words_equal_the_rule_on_whole_texts(spark):
    draw = random.Random(3)
    texts = ["", " ", "\t\n", "a", " a ", " b ", "x  y\tz"]
    texts += [f"a{chr(c)}b{chr(c)} c" for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(draw.choice([*BLANKS, "a", "bé", "🙂", "."]) for _ in range(draw.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = F.trim(F.regexp_replace("t", tx.BLANK, " "))
    heads = [F.array_join(F.slice(F.filter(F.split(whole, " "), lambda w: w != ""), 1, k), " ") == tx.head_words("t", k) for k in (1, 2, 12)]
    assert df.select(*heads).distinct().collect() == [(True, True, True)]


def test_minimal_plan_reads_the_first_words_only(spark):
    plan = tx.minimal_plan("t", F.lit(""), F.lit(""), F.lit(""), F.lit(""), 12)
    assert "{0,11}+" in spark.range(1).select(F.lit("a b").alias("t")).select(plan)._jdf.queryExecution().analyzed().toString()


def test_last_word_is_the_last_field(spark):
    from rungwork.sources import bridge

    df = spark.createDataFrame([(t,) for t in ("a b", "a ", "", " ", "one", "a  b", "é 🙂", None)], "t string")
    assert df.select(bridge.last_word("t").eqNullSafe(bridge.field("t", " ", -1))).distinct().collect() == [(True,)]
    assert "substring_index" in df.select(bridge.last_word("t"))._jdf.queryExecution().analyzed().toString()
