"""Exact row numbers, seeded orders and last-wins picks without a one-task sort.

A plain ``row_number()`` over a whole table, or over one very large group, sorts
everything in a single task. Here the order is cut into slices first: slices are
counted, the counts are summed up in order (a table of slices, not of rows), and
each row adds its position inside its own slice.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 1024  # of positions at most
HASH_SLICE_DIGITS = 4  # 16**4 slices at most, whatever the row count


def seeded_hash(seed: int, *keys: Column) -> Column:
    """Stable pseudo-random order key: sha1 of the seed and the row's key."""
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def sliced_rank(
    df: DataFrame,
    order: Sequence[str],
    slice_expr: Column,
    name: str,
    by: Sequence[str] = (),
) -> DataFrame:
    """Add 1-based ``name`` = row number by ``order`` (inside each ``by`` group).

    ``slice_expr`` must never decrease along ``order``; it decides how finely one
    group is spread over tasks.
    """
    cut, before = f"__{name}_slice", f"__{name}_before"
    sliced = df.withColumn(cut, slice_expr)
    sizes = sliced.groupBy(*by, cut).agg(F.count(F.lit(1)).alias("__n"))
    running = Window.partitionBy(*by).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(c).alias(f"__by_{c}") for c in by],
        F.col(cut).alias("__cut"),
        F.coalesce(F.sum("__n").over(running), F.lit(0)).alias(before),
    )
    match = F.col(cut).eqNullSafe(F.col("__cut"))
    for column in by:
        match = match & F.col(column).eqNullSafe(F.col(f"__by_{column}"))
    inside = Window.partitionBy(*by, cut).orderBy(*order)
    return (
        sliced.withColumn(name, F.row_number().over(inside).cast("long"))
        .join(offsets, match, "inner")
        .withColumn(name, F.col(name) + F.col(before))
        .drop(cut, before, "__cut", *[f"__by_{c}" for c in by])
    )


def hash_rank(df: DataFrame, keys: Sequence[str], seed: int, name: str) -> DataFrame:
    """Global 1-based rank in the seeded order of distinct ``keys``."""
    digest = f"__{name}_digest"
    hashed = df.withColumn(digest, seeded_hash(seed, *[F.col(k) for k in keys]))
    ranked = sliced_rank(
        hashed,
        [digest, *keys],
        F.substring(digest, 1, HASH_SLICE_DIGITS),
        name,
    )
    return ranked.drop(digest)


def position_rank(
    df: DataFrame, position: str, name: str, by: Sequence[str] = (), width: int = 1_000_000
) -> DataFrame:
    """1-based rank along an integer log position.

    Slices follow the rows, not the range of positions: they are cut at approximate quantiles,
    so that each holds about ``width`` rows however the positions lie, ``SLICES`` at most. The
    cuts come from one aggregate that combines bounded sketches.
    """
    at = F.col(position).cast("double")  # rounding keeps the order
    parts = [k / SLICES for k in range(1, SLICES)]
    rows, cuts = df.agg(F.count(F.lit(1)), F.percentile_approx(at, parts, 4 * SLICES)).first()
    wanted = min(SLICES, -(-rows // width))
    kept = sorted({cuts[k * SLICES // wanted - 1] for k in range(1, wanted)}) if cuts else []
    if not kept:
        return sliced_rank(df, [position], F.lit(0), name, by)
    raw, slice_of = f"__{name}_at", f"__{name}_cut"
    binned = Bucketizer(splits=[-math.inf, *kept, math.inf], inputCol=raw, outputCol=slice_of, handleInvalid="keep")
    sliced = binned.transform(df.withColumn(raw, at)).drop(raw)
    return sliced_rank(sliced, [position], F.col(slice_of), name, by).drop(slice_of)


def last_by(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Keep, per key, the row with the largest log position (combines map-side)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), position).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest]).select(df.columns)


def first_by(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Keep, per key, the row with the smallest log position."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), position).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest]).select(df.columns)
