"""Connected components of a link table, 64-bit hashes of byte slices, and memory of Python workers."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwork.session import cut_lineage

_BASE = 0xD6E8FEB86659FD93


def release_memory() -> None:
    """Hand freed memory back at the end of a task: Spark keeps its Python workers for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library than glibc
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PowerTable:
    """Powers of an odd base and of its inverse, longer as needed."""

    def __init__(self) -> None:
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = 1 << max(16, int(n).bit_length())
            self.up, self.down = (self._powers(b) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]

    def _powers(self, base: int) -> np.ndarray:
        out = np.full(self.n, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


POWERS = PowerTable()
_BYTES = mix64(np.arange(256, dtype=np.uint64))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any slice of the bytes by ``slice_hashes``."""
    up, _ = POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=out[1:])
    return out


def slice_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes begin..end of each slice, wherever the slice stands."""
    _, down = POWERS.upto(len(sums))
    return mix64((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable node per linked node: (``node``, ``root``).

    Each round hooks every node to its smallest smaller neighbour, follows the hooks to their
    ends and puts the ends in place of the nodes of all links; what is left are links between
    the merged nodes. Hooks and links are written every round, so a lost executor costs a round
    at most, joins see true sizes, and the one-row-a-node side lets a hot node be split. Every
    round at least halves the nodes that still have links.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    links = cut_lineage(pairs)
    found: DataFrame | None = None
    while not links.isEmpty():
        hooks = cut_lineage(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        while True:  # follow hooks: each step doubles the distance
            onward = hooks.select(F.col("node").alias("via"), F.col("root").alias("end"))
            jumped = cut_lineage(
                hooks.join(onward, F.col("root") == F.col("via"), "left").select("node", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved"))
            )
            moved = not jumped.where("moved").isEmpty()
            hooks = jumped.select("node", "root")
            if not moved:
                break
        step = hooks.select(F.col("node").alias("via"), F.col("root").alias("end"))
        for side in ("a", "b"):
            links = links.join(step, F.col(side) == F.col("via"), "left").withColumn(side, F.coalesce("end", side)).drop("via", "end")
        links = cut_lineage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
        if found is None:
            found = hooks
        else:
            moved_on = found.join(step, F.col("root") == F.col("via"), "left").select("node", F.coalesce("end", "root").alias("root"))
            found = cut_lineage(moved_on.unionByName(hooks.join(found.select("node"), "node", "left_anti")))
    if found is None:
        return spark.createDataFrame([], "node long, root long")
    ends = found.select(F.col("root").alias("node"), F.col("root")).distinct()
    return cut_lineage(found.unionByName(ends.join(found.select("node"), "node", "left_anti")))
