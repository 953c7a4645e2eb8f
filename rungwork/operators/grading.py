"""Grading whole generation tables against their references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwork.functions import text as tx

LIMB = 6  # digits of a limb: products of two stay far below 64 bits, also when many are summed


def _limbs(digits: Column) -> Column:
    """Magnitude of a digit string as numbers below 10^LIMB, the least first; zero has none."""

    def cut(bare: Column) -> Column:
        n = F.ceil(F.length(bare) / LIMB).cast("int")
        padded = F.lpad(bare, n * LIMB, "0")
        parts = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(padded, (n - i) * LIMB + 1, F.lit(LIMB)).cast("bigint"))
        return F.when(n > 0, parts).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(F.regexp_replace(digits, "^[-+]?0*", "")), cut), F.lit(0))


def _coefficient(a: Column, b: Column, k: Column) -> Column:
    """Sum of all products of limbs whose places add up to ``k``."""
    low, high = F.greatest(F.lit(0), k - F.size(b) + 1), F.least(k, F.size(a) - 1)
    zero = F.lit(0).cast("bigint")
    summed = F.aggregate(F.sequence(low, high), zero, lambda total, i: total + F.get(a, i) * F.get(b, k - i))
    return F.when(low <= high, summed).otherwise(zero)


def same_rational(n1: Column, d1: Column, n2: Column, d2: Column) -> Column:
    """Whether two fractions of digit strings, of any length, are equal: n1 d2 - n2 d1 carried limb by limb is zero."""
    negative = [F.startswith(x, F.lit("-")).cast("int") for x in (n1, d1, n2, d2)]
    sign = [F.lit(1) - 2 * F.pmod(negative[x] + negative[y], F.lit(2)) for x, y in ((0, 3), (2, 1))]
    bound = F.struct(*[_limbs(x).alias(f"l{k}") for k, x in enumerate((n1, d2, n2, d1))], sign[0].alias("s1"), sign[1].alias("s2"))

    def equal(x: Column) -> Column:
        places = F.greatest(F.size(x["l0"]) + F.size(x["l1"]), F.size(x["l2"]) + F.size(x["l3"]))

        def step(acc: Column, k: Column) -> Column:
            left = acc["carry"] + x["s1"] * _coefficient(x["l0"], x["l1"], k) - x["s2"] * _coefficient(x["l2"], x["l3"], k)
            rest = left % 10**LIMB
            return F.struct((acc["same"] & (rest == 0)).alias("same"), F.call_function("div", left - rest, F.lit(10**LIMB)).alias("carry"))

        start = F.struct(F.lit(True).alias("same"), F.lit(0).cast("bigint").alias("carry"))
        carried = F.aggregate(F.sequence(F.lit(0), places), start, step, lambda acc: acc["same"] & (acc["carry"] == 0))
        return F.when(x["l0"].isNotNull() & x["l2"].isNotNull(), carried)

    return F.get(F.transform(F.array(bound), equal), F.lit(0))


def grade_rollouts(rows: DataFrame, text: str = "text", reference: str = "reference", verifier=None) -> DataFrame:
    """Adds ``correct``: text and reference name the same rational number.

    Numbers of any length are compared exactly, in one pass and without leaving the JVM.
    ``verifier`` replaces the grader: a pandas UDF of (text, reference) giving a boolean.
    """
    if verifier is not None:
        return rows.withColumn("correct", F.coalesce(verifier(F.col(text), F.col(reference)), F.lit(False)))
    want = F.concat(F.lit("FINAL_ANSWER: "), F.col(reference))
    parsed = rows.withColumns({"__got": tx.exact_number(text), "__want": tx.exact_number(want)})
    equal = same_rational(*[F.col(c) for c in ("__got.num", "__got.den", "__want.num", "__want.den")])
    return parsed.withColumn("correct", F.coalesce(equal, F.lit(False))).drop("__got", "__want")


def boxed_report(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose answer wrapper is complete, and the share."""
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("rows"),
        F.count_if(tx.boxed_complete(text)).alias("complete_rows"),
        (F.count_if(tx.boxed_complete(text)) / n).alias("complete_share"),
    )
