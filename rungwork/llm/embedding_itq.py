"""Near-duplicate embeddings by learned binary codes and multi-index Hamming tables.

Iterative quantisation: the unit vectors of a bounded sample are turned to their principal axes,
then a rotation is learned that brings them close to the corners of the cube, so that signs are
balanced bits; several starts give several rotations and as many bits as are needed. The code of
a vector is cut into substrings of ``bits`` bits, one table each. Two codes that differ in fewer
places than there are tables agree in a whole substring; for a pair just at the threshold the
number of tables is chosen so that ``recall`` of such pairs meet. Pairs that meet are reranked by
the cosine of the original vectors in double precision, and count in the first table where they
meet only, so links are neither lost nor counted twice between tables. ``bits`` grows with the
logarithm of the table, so buckets stay small; a bucket of more than ``CELL`` vectors is cut into
cells of two blocks, exactly. Equal vectors are one class with a weight. No pairs are emitted: a
cell gives link counts, and links enough for its components.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing; so do vectors of different lengths among themselves. Repeated rows are vectors of their
own: they link with each other. A null id links with nothing and has null component and kept.
Empty tables give no row. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwork.llm.linking import components, mix64
from rungwork.session import cut_lineage

CELL = 1024


@dataclass(frozen=True)
class Index:
    """Learned axes (dimension x all bits) for the common length, and the cut of the codes."""

    axes: np.ndarray
    bits: int
    tables: int
    seed: int

    def axes_for(self, dimension: int) -> np.ndarray:
        """Vectors of another length than the common one get random rotations."""
        if dimension == len(self.axes):
            return self.axes
        rng = np.random.default_rng([self.seed, dimension])
        need = -(-self.bits * self.tables // dimension)
        return np.concatenate([np.linalg.qr(rng.normal(size=(dimension, dimension)))[0] for _ in range(need)], axis=1)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """One substring per table and row."""
        signs = (unit @ self.axes_for(unit.shape[1])[:, : self.bits * self.tables]) >= 0
        parts = signs.reshape(len(unit), self.tables, self.bits)
        return (parts * (1 << np.arange(self.bits))).sum(axis=2).astype(np.int32)


def learn_rotation(axes: np.ndarray, turned: np.ndarray, seed: int, rounds: int = 30) -> np.ndarray:
    """Iterative quantisation: alternate signs and the best rotation towards them."""
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.normal(size=(turned.shape[1],) * 2))[0]
    for _ in range(rounds):
        signs = np.where(turned @ rotation >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(turned.T @ signs)
        rotation = u @ v
    return axes @ rotation


def learn_index(sample: np.ndarray, n: int, threshold: float, recall: float, seed: int) -> Index:
    """Axes and cut for ``n`` vectors from the unit vectors of a sample."""
    dimension = sample.shape[1]
    bits = min(24, max(4, math.ceil(math.log2(max(2, n) / 16))))
    apart = math.acos(threshold) / math.pi  # share of bits in which a pair at the threshold differs
    meet = (1 - apart) ** bits
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))
    axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]
    turned = sample @ axes
    need = -(-bits * tables // dimension)
    learned = [learn_rotation(axes, turned, seed + k) for k in range(need)]
    return Index(np.concatenate(learned, axis=1), bits, tables, seed)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, cls, dimension, vector bytes); cls is null where a vector links with nothing."""
    for batch in batches:
        ids, column = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keys, sizes, vectors = [], [], []
        for vec_id, values in zip(ids, column):
            ok = vec_id is not None and values is not None and len(values) > 0 and None not in values
            vector = np.asarray(values, dtype=np.float64) if ok else np.zeros(0)
            if ok and np.isfinite(vector).all() and (top := np.abs(vector).max()) > 0:
                vector = vector / top + 0.0  # no overflow in the norm; -0.0 is 0.0
                raw = np.frombuffer(vector.tobytes(), dtype=np.uint64)
                spread = mix64(raw + mix64(np.arange(len(raw), dtype=np.uint64)))
                keys.append(int(mix64(spread.sum(dtype=np.uint64, keepdims=True) + np.uint64(len(raw)))[0].astype(np.int64)))
                sizes.append(len(vector))
                vectors.append((vector / np.linalg.norm(vector)).tobytes())
            else:
                keys.append(None), sizes.append(None), vectors.append(None)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(vectors, pa.binary())],
            names=["vec_id", "cls", "dimension", "vector"],
        )


def _keys(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            vectors = [np.frombuffer(v.as_py()) for v in batch.column(names.index("vector"))]
            keys: list = [None] * len(vectors)
            for size in {len(v) for v in vectors}:
                which = [i for i, v in enumerate(vectors) if len(v) == size]
                for i, row in zip(which, shared.value.keys(np.stack([vectors[i] for i in which])).tolist()):
                    keys[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int32()))], names=[*names, "keys"])

    return run


def cell_links(unit: np.ndarray, weight: np.ndarray, keys: np.ndarray, table: int, block: np.ndarray, threshold: float):
    """Link weight per vector, and a label per vector: the first of its component in the cell."""
    m = len(unit)
    count, label = np.zeros(m, dtype=np.int64), np.arange(m)
    across = len(np.unique(block)) > 1
    left_all, right_all = [], []
    for start in range(0, m, 256):
        near = unit[start : start + 256] @ unit.T >= threshold
        left, right = np.nonzero(near)
        left = left + start
        ok = left < right
        if across:
            ok &= block[left] != block[right]
        left, right = left[ok], right[ok]
        for t in range(table):  # met in an earlier table
            new = keys[left, t] != keys[right, t]
            left, right = left[new], right[new]
        count += np.bincount(left, weight[right], minlength=m).astype(np.int64) + np.bincount(right, weight[left], minlength=m).astype(np.int64)
        left_all.append(left), right_all.append(right)
    left, right = np.concatenate(left_all), np.concatenate(right_all)
    while True:
        before = label.copy()
        np.minimum.at(label, left, label[right])
        np.minimum.at(label, right, label[left])
        label = label[label]
        if (label == before).all():
            return count, label


def _cells(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def flush():
            table = key[0]
            unit = np.stack([np.frombuffer(r[3]) for r in rows])
            count, label = cell_links(unit, np.array([r[2] for r in rows]), np.array([r[4] for r in rows]), table, np.array([r[5] for r in rows]), threshold)
            out = [(rows[i][0], None, int(count[i])) for i in np.flatnonzero(count)]
            out += [(rows[i][1], rows[label[i]][1], None) for i in np.flatnonzero(label != np.arange(len(rows))) if rows[i][1] != rows[label[i]][1]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], []))], names=["a", "b", "n"])

        for batch in batches:
            for i in range(0, len(batch), 1024):
                for *now, cls, one, weight, vector, keys, block in zip(*[c.to_pylist() for c in batch.slice(i, 1024).columns]):
                    if now != key:
                        if len(rows) > 1:
                            yield flush()
                        key, rows = now, []
                    rows.append((cls, one, weight, vector, keys, block))
        if len(rows) > 1:
            yield flush()

    return run


def near_vectors(table: DataFrame, threshold: float = 0.9, recall: float = 0.97, fit_rows: int = 10_000, seed: int = 5) -> DataFrame:
    """Per row of (vec_id, embedding): vec_id, n_links, component_id, kept.

    The rotations are learned from at most ``fit_rows`` vectors, the first by hash.
    """
    spark = table.sparkSession
    rows = cut_lineage(table.select("vec_id", "embedding").mapInArrow(_classes, "vec_id long, cls long, dimension int, vector binary"))
    classes = cut_lineage(
        rows.where("cls is not null").groupBy("cls", "dimension").agg(F.min("vec_id").alias("one"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector"))
    )
    common = classes.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.sum(F.lit(1)).alias("all")).orderBy(F.desc("n"), "dimension").first()
    if common is None:
        own = F.lit(0).cast("long")
        return rows.select("vec_id", own.alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    chosen = classes.where(F.col("dimension") == common.dimension).orderBy(F.xxhash64("cls"), "cls").limit(fit_rows)
    sample = np.stack([np.frombuffer(r.vector) for r in chosen.select("vector").toLocalIterator()])
    index = spark.sparkContext.broadcast(learn_index(sample, classes.count(), threshold, recall, seed))
    keyed = cut_lineage(classes.mapInArrow(_keys(index), "cls long, dimension int, one long, weight long, vector binary, keys array<int>"))
    dealt = keyed.select("*", F.posexplode("keys").alias("table", "bucket"))
    hot = dealt.groupBy(F.col("table").alias("t"), F.col("bucket").alias("k"), F.col("dimension").alias("d")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL)
    hot = cut_lineage(hot.select("t", "k", "d", F.ceil(F.col("n") / CELL).cast("int").alias("of")))
    placed = dealt.join(hot, (F.col("table") == F.col("t")) & (F.col("bucket") == F.col("k")) & (F.col("dimension") == F.col("d")), "left")
    blocks = F.coalesce("of", F.lit(1))
    spread = placed.withColumn("block", F.pmod(F.xxhash64("cls"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cell = ["table", "dimension", "bucket", "low", "high"]
    cells = spread.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).select(*cell, "cls", "one", "weight", "vector", "keys", "block")
    found = cut_lineage(cells.repartition(*cell).sortWithinPartitions(*cell, "cls").mapInArrow(_cells(threshold), "a long, b long, n long"))
    counts = cut_lineage(found.where("n is not null").groupBy(F.col("a").alias("of")).agg(F.sum("n").alias("links")))
    roots = components(found.where("n is null").select("a", "b"))
    labels = classes.join(counts, F.col("cls") == F.col("of"), "left").join(roots, F.col("one") == F.col("node"), "left")
    labels = cut_lineage(labels.select(F.col("cls").alias("of_cls"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("root", "one").alias("root")))
    component = F.coalesce("root", "vec_id")
    return rows.join(labels, F.col("cls") == F.col("of_cls"), "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept")
    )
