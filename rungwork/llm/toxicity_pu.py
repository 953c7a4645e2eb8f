"""Toxicity scores from confirmed toxic examples and unlabelled text.

A linear classifier over hashed words and word beginnings is trained in numpy with the
non-negative positive-unlabelled risk: with the share ``prior`` of toxic documents,

    risk = prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

and where the bracket falls below zero, the step goes against it, so the model cannot
win by calling all unlabelled text clean. Only the fit uses a bounded sample: at most
``Fit.positives`` confirmed examples and ``Fit.unlabelled`` documents, the first by hash of
(id, text) of all rows of the training fold. Scoring reads every whole text, row by row.

Cases: null or empty text has no features and scores by the intercept. A null label, or one
other than 1, confirms nothing; label rows of unknown documents count for nothing; repeated
label rows count once, repeated documents get equal scores. A null id is in no training row and
``held_out`` is null. Without any confirmed example every score is 0. Extra columns are kept by
``score``; an output name that is there already is an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rungwork.llm.linking import release_memory

BITS = 18  # hashed features
CACHED_WORDS = 100_000
MARKS = '.,;:!?"()'


@dataclass(frozen=True)
class Fit:
    """Bounds and settings of the fit."""

    positives: int = 4_000
    unlabelled: int = 8_000
    steps: int = 300
    rate: float = 1.0
    momentum: float = 0.9
    decay: float = 1e-5
    certainty: float = 4.0  # standard errors by which a feature's shares must differ


@dataclass(frozen=True)
class Model:
    table: dict[int, float]  # weight by feature; the others weigh nothing
    intercept: float
    prior: float


def held_out(doc_id: Column) -> Column:
    """True for the fold that training never sees: crc32 of the id as text, modulo five, is zero."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def words_of(text: str | None) -> set[str]:
    text = (text or "").lower()
    for mark in MARKS:
        text = text.replace(mark, " ")
    return set(text.split())


def word_features(word: str) -> list[int]:
    """Hashed features of one word: itself and its first four and five letters."""
    mask = (1 << BITS) - 1
    found = [zlib.crc32(b"w" + word.encode()) & mask]
    for k in (4, 5):
        if len(word) >= k:
            found.append(zlib.crc32(b"%d" % k + word[:k].encode()) & mask)
    return found


def features(text: str | None) -> list[int]:
    return [f for word in sorted(words_of(text)) for f in word_features(word)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def train(positive: list, unlabelled: list, prior: float, fit: Fit = Fit()) -> Model:
    """Non-negative PU training with logistic loss, by descent with momentum on features scaled by their log ratio."""
    size = 1 << BITS
    if not positive or not unlabelled:
        return Model({}, -np.inf, prior)
    rows = positive + unlabelled
    indptr = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    indices = np.concatenate([np.asarray(r, dtype=np.int32) for r in rows])
    split = indptr[len(positive)]

    in_pos, in_unl = (np.bincount(part, minlength=size) for part in (indices[:split], indices[split:]))
    n_pos, n_unl = len(positive), len(unlabelled)
    pooled = (in_pos + in_unl + 0.5) / (n_pos + n_unl + 1)
    gap = in_pos / n_pos - in_unl / n_unl
    certain = np.abs(gap) > fit.certainty * np.sqrt(pooled * (1 / n_pos + 1 / n_unl))
    ratio = np.log((in_pos / n_pos + pooled) / (in_unl / n_unl + pooled))
    ratio = np.where(certain & (gap > 0), ratio, 0.0)  # only evidence for toxicity, so length is none against it
    chosen = ratio[indices] > 0  # the other features never change a margin
    owner, columns = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(indptr))[chosen], indices[chosen]
    scaled = ratio[columns]
    is_pos = np.arange(len(rows)) < n_pos
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    pace, pace_b = np.zeros(size), 0.0
    for _ in range(fit.steps):
        z = np.bincount(owner, w[columns] * scaled, minlength=len(rows)) + b
        zp, zu = z[is_pos], z[~is_pos]
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # d/dz of loss(+) is sigmoid(z) - 1, of loss(-) is sigmoid(z)
        if rest >= 0:
            gp, gu = prior * (_sigmoid(zp) - 1) - prior * _sigmoid(zp), _sigmoid(zu)
        else:  # go against the negative part
            gp, gu = prior * _sigmoid(zp), -_sigmoid(zu)
        g = np.concatenate([gp / n_pos, gu / n_unl])
        pace = fit.momentum * pace + np.bincount(columns, g[owner] * scaled, minlength=size) + fit.decay * w
        pace_b = fit.momentum * pace_b + g.sum()
        w, b = w - fit.rate * pace, b - fit.rate * pace_b
    found = np.flatnonzero(ratio)
    return Model(dict(zip(found.tolist(), (w * ratio)[found].tolist())), float(b), prior)


def training_rows(docs: DataFrame, labels: DataFrame, fit: Fit) -> tuple[list[np.ndarray], list[np.ndarray], float]:
    """Features of the bounded samples, and the share of toxic rows among the labelled ones."""
    known = (
        labels.select(F.col("doc_id").alias("id"), "toxic")
        .where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    )
    total, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic:
        return [], [], 0.0
    prior = min(0.9, max(0.001, toxic / total))
    every = docs.select(F.col("doc_id").alias("id"), "text").where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    order = F.xxhash64("id", F.coalesce("text", F.lit("")))

    def first(rows: DataFrame, n: int) -> list[np.ndarray]:
        """The first ``n`` rows by hash; ids first, so that only chosen texts are moved."""
        ids = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(n)  # n ids at most
        picked = every.join(F.broadcast(ids), "id", "left_semi").orderBy(order, "id").limit(n).select("text")
        made = picked.mapInArrow(_feature_rows, "f binary")
        return [np.frombuffer(row.f, dtype=np.int32) for row in made.toLocalIterator()]

    return first(known.where("toxic = 1"), fit.positives), first(every, fit.unlabelled), prior


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.array(features(t.as_py()), dtype=np.int32).tobytes() for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["f"])


def fit_model(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model:
    """Fitted on the driver from bounded samples, whose memory is handed back at the end."""
    rows = training_rows(docs, labels, fit)
    model = train(*rows, fit)
    del rows
    release_memory()
    return model


def scores_of(texts: list[str | None], model: Model, known: dict[str, float]) -> list[float]:
    """Scores of some texts; ``known`` remembers what each word adds."""
    out = np.empty(len(texts))
    for i, text in enumerate(texts):
        words = words_of(text)
        try:
            out[i] = sum(map(known.__getitem__, words))
        except KeyError:
            if len(known) > CACHED_WORDS:
                known.clear()
            for word in words.difference(known):
                known[word] = sum(model.table.get(f, 0.0) for f in word_features(word))
            out[i] = sum(map(known.__getitem__, words))
    return _sigmoid(out + model.intercept).tolist()


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score of every row's whole text. No shuffle; the model has a fixed size."""
    if out in docs.columns:
        raise ValueError(f"column {out} is there already; choose another out=")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for whole in batches:
            for start in range(0, len(whole), 256):
                batch = whole.slice(start, 256)
                found = scores_of(batch.column(batch.schema.names.index(text)).to_pylist(), shared.value, known)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, out])
        known.clear()
        release_memory()

    return docs.mapInArrow(run, schema)
