"""Learned router: text and arm features, balanced logistic regression, calibration."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import (
    IDF,
    CountVectorizerModel,
    NGram,
    Normalizer,
    OneHotEncoder,
    RegexTokenizer,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from rungwork.operators.routing import grouped_split
from rungwork.plans.ranking import seeded_hash
from rungwork.session import cut_lineage

# Words as they are, and each blank-padded, whose parts are the character n-grams.
CHAR_WORDS = r"""
SELECT *, transform(filter(split(lower(question), '\\s+'), w -> w <> ''), w -> concat(' ', w, ' ')) AS char_words FROM __THIS__
"""
WORD_GRAMS = "SELECT *, concat(word_tokens, word_pairs) AS word_grams FROM __THIS__"
SPREAD = 1 << 18  # grams of texts in memory at once, unless one text has more
REMEMBERED = 1 << 18  # pieces and grams a task counts before it hands them on
HELD = 1 << 20  # words and word pairs, as numbers, that a task counts before it hands them on
HANDED = 1 << 16  # counts in a batch that a task hands on
#: rows of whole texts that Python gets at once, and rows of vectors that the Parquet reader holds at once
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 500, "spark.sql.parquet.columnarReaderBatchSize": 256}
WRITTEN = 50_000  # training rows whose features are written, some 15 KB each
ARM = ("arm_name", "arm_kind", "arm_strength", "correct")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside move rows of whole texts and of vectors in small batches; the session's sizes come back."""
    before = {k: spark.conf.get(k) for k in BATCHES}
    for k, most in BATCHES.items():
        spark.conf.set(k, str(min(int(before[k]), most) if int(before[k]) > 0 else most))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _hand_back() -> None:
    """A worker that waits for its next task gives the memory of the last one back."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def gram_stages() -> list:
    """Words and word pairs of a question, and its padded words, without anything to fit."""
    return [
        RegexTokenizer(inputCol="question", outputCol="word_tokens", pattern=r"(?U)\b\w\w+\b", gaps=False),
        NGram(n=2, inputCol="word_tokens", outputCol="word_pairs"),
        SQLTransformer(statement=WORD_GRAMS),
        SQLTransformer(statement=CHAR_WORDS),
    ]


def char_grams(word: str) -> list[str]:
    """Character n-grams of 3 to 5 inside a padded word."""
    return [word[i : i + n] for n in (3, 4, 5) for i in range(len(word) - n + 1)]


def _alike(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per text the number of the run of equal neighbours that it is in: arms of an item show one text."""
    sizes = np.diff(ends)
    new = np.ones(len(sizes), bool)
    for i in np.flatnonzero(sizes[1:] == sizes[:-1]) + 1:
        new[i] = not np.array_equal(codes[ends[i - 1] : ends[i]], codes[ends[i] : ends[i + 1]])
    return np.cumsum(new) - 1


def _coded(lists: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different pieces of a batch, the piece at each place, and the places where texts end, from 0."""
    coded = lists.flatten().dictionary_encode()
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), ends


def _text_counts(lists: pa.ListArray, number: Callable[[str], np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice of texts: first text, texts, and (text, gram, uses) of each different gram of a text.

    ``number`` gives the grams of a piece as numbers. A batch's pieces are told apart once, and each
    different piece is cut once; equal neighbours among the texts are counted once.
    """
    words, codes, ends = _coded(lists)
    cut = [number(p) for p in words]
    sizes = np.array([len(c) for c in cut], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    grams = np.concatenate([*cut, np.empty(0, np.int64)]).astype(np.int64)
    spread = np.concatenate([[0], np.cumsum(sizes[codes])])[ends]  # grams before each text
    first, texts = 0, len(lists)
    while first < texts:
        last = max(first + 1, int(np.searchsorted(spread, spread[first] + SPREAD, "right")) - 1)
        same = _alike(codes, ends[first : last + 1])
        heads = np.flatnonzero(np.diff(same, prepend=-1))
        own = np.repeat(np.diff(same, prepend=-1) > 0, np.diff(ends[first : last + 1]))
        pieces = codes[ends[first] : ends[last]][own]
        at = np.repeat(np.arange(len(heads)), np.diff(ends[first : last + 1])[heads])
        pair, times = np.unique(at * len(cut) + pieces, return_counts=True)  # a text's different pieces
        at, pieces = np.divmod(pair, max(len(cut), 1))
        n = sizes[pieces]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[pieces], n)
        width = int(grams.max(initial=0)) + 1
        key = np.repeat(at, n) * width + grams[place]
        order = np.argsort(key, kind="stable")
        key, weight = key[order], np.repeat(times, n)[order]
        begin = np.flatnonzero(np.diff(key, prepend=-1))
        uses = np.add.reduceat(weight, begin) if len(begin) else weight
        at, gram = np.divmod(key[begin], width)
        if len(heads) < last - first:  # the counts of a run once per text
            many = np.bincount(at, minlength=len(heads))
            shown, begin = many[same], (np.cumsum(many) - many)[same]
            place = np.arange(shown.sum()) - np.repeat(np.cumsum(shown) - shown, shown) + np.repeat(begin, shown)
            at, gram, uses = np.repeat(np.arange(last - first), shown), gram[place], uses[place]
        yield first, last - first, at, gram, uses
        first = last


def _times(batch: pa.RecordBatch) -> np.ndarray:
    """How often each text counts: the second column, or once."""
    return batch.column(1).to_numpy(zero_copy_only=False) if batch.num_columns > 1 else np.ones(len(batch), np.int64)


def _tally(cut: Callable[[str], list[str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Grams of a task's texts with the rows that hold them and their uses; a gram comes again after ``REMEMBERED`` ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[str, np.ndarray] = {}
        numbers: dict[str, int] = {}
        rows, uses = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def number(piece: str) -> np.ndarray:
            found = pieces.get(piece)
            if found is None:
                found = pieces[piece] = np.array([numbers.setdefault(g, len(numbers)) for g in cut(piece)], np.int64)
            return found

        def counted() -> Iterator[pa.RecordBatch]:
            grams = list(numbers)
            for i in range(0, len(grams), HANDED):
                part = slice(i, i + HANDED)
                yield pa.RecordBatch.from_arrays([pa.array(grams[part], pa.string()), pa.array(rows[part]), pa.array(uses[part])], ["gram", "rows", "uses"])

        for batch in batches:
            times = _times(batch)
            for first, _, at, gram, n in _text_counts(batch.column(0), number):
                more = np.zeros(max(len(numbers) - len(rows), 0), np.int64)
                rows, uses = np.concatenate([rows, more]), np.concatenate([uses, more])
                weight = times[first + at]
                rows += np.bincount(gram, weight, minlength=len(rows)).astype(np.int64)
                uses += np.bincount(gram, n * weight, minlength=len(uses)).astype(np.int64)
            more = np.zeros(len(numbers) - len(rows), np.int64)
            rows, uses = np.concatenate([rows, more]), np.concatenate([uses, more])
            if max(len(pieces), len(numbers)) > REMEMBERED:
                yield from counted()
                pieces.clear()
                numbers.clear()
                rows, uses = rows[:0], uses[:0]
        yield from counted()
        pieces.clear()
        numbers.clear()
        _hand_back()

    return run


def _tally_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for words and pairs of neighbouring words, counted as pairs of word numbers; a lone word's second is 0."""
    numbers: dict[str, int] = {}
    held, rows, uses = (np.zeros(0, np.int64) for _ in range(3))

    def counted() -> Iterator[pa.RecordBatch]:
        words = pa.array(["", *numbers], pa.string())
        for i in range(0, len(held), HANDED):
            part = slice(i, i + HANDED)
            x, y = words.take(pa.array(held[part] >> 32)), words.take(pa.array(held[part] & 0xFFFFFFFF))
            gram = pc.if_else(pa.array(held[part] & 0xFFFFFFFF > 0), pc.binary_join_element_wise(x, y, " "), x)
            yield pa.RecordBatch.from_arrays([gram, pa.array(rows[part]), pa.array(uses[part])], ["gram", "rows", "uses"])

    for batch in batches:
        times = _times(batch)
        words, codes, ends = _coded(batch.column(0))
        word = np.array([numbers.setdefault(w, len(numbers) + 1) for w in words], np.int64)[codes] if words else np.zeros(0, np.int64)
        first, texts = 0, len(batch)
        while first < texts:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + SPREAD // 2, "right")) - 1)
            same = _alike(codes, ends[first : last + 1])
            new = np.diff(same, prepend=-1) > 0
            shown, sizes = np.bincount(same, times[first:last]), np.diff(ends[first : last + 1])
            mine = word[ends[first] : ends[last]][np.repeat(new, sizes)]
            at = np.repeat(np.arange(len(shown)), sizes[new])
            inside = np.flatnonzero(at[1:] == at[:-1])
            grams, gram = np.unique(np.concatenate([mine << 32, mine[inside] << 32 | mine[inside + 1]]), return_inverse=True)
            at = np.concatenate([at, at[inside]])
            once = np.unique(gram * len(shown) + at)  # a text's different grams
            more_rows = np.bincount(once // len(shown), shown[once % len(shown)], len(grams)).astype(np.int64)
            more_uses = np.bincount(gram, shown[at], len(grams)).astype(np.int64)
            held, place = np.unique(np.concatenate([held, grams]), return_inverse=True)
            rows, uses = (np.bincount(place, np.concatenate(c), len(held)).astype(np.int64) for c in ((rows, more_rows), (uses, more_uses)))
            if len(held) > HELD:
                yield from counted()
                held, rows, uses = held[:0], rows[:0], uses[:0]
            first = last
        if len(numbers) > REMEMBERED:
            yield from counted()
            numbers.clear()
            held, rows, uses = held[:0], rows[:0], uses[:0]
    yield from counted()
    numbers.clear()
    _hand_back()


#: column of pieces, and how a task counts their grams
GRAMS: dict[str, tuple[str, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]] = {
    "word_grams": ("word_tokens", _tally_words),
    "char_grams": ("char_words", _tally(char_grams)),
}


def vocabulary(rows: DataFrame, grams: str, size: int, least_rows: int = 2) -> DataFrame:
    """The ``size`` most used grams that at least ``least_rows`` rows hold: (gram, rows, uses, place).

    Exact: a task counts the grams of its texts before the shuffle, and equal counts are ordered by the gram.
    A text of an item with listed ``arms`` counts once an arm.
    """
    column, tally = GRAMS[grams]
    times = [F.size("arms").cast("long").alias("times")] if "arms" in rows.columns else []
    held = rows.select(column, *times).mapInArrow(tally, "gram string, rows bigint, uses bigint")
    counts = held.groupBy("gram").agg(F.sum("rows").alias("rows"), F.sum("uses").alias("uses"))
    top = counts.filter(F.col("rows") >= least_rows).orderBy(F.desc("uses"), "gram").limit(size)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("uses"), "gram")) - 1)  # size rows at most


class CharCounts(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Sparse counts of the listed character n-grams, ``vocabSize`` wide, in place of the padded words."""

    grams = Param(Params._dummy(), "grams", "listed grams in order", TypeConverters.toListString)
    vocabSize = Param(Params._dummy(), "vocabSize", "most grams asked for", TypeConverters.toInt)

    def __init__(self, grams: list[str] | None = None, vocabSize: int = 0):
        super().__init__()
        self._set(grams=grams or [], vocabSize=vocabSize)

    @property
    def vocabulary(self) -> list[str]:
        return self.getOrDefault(self.grams)

    def getVocabSize(self) -> int:
        return self.getOrDefault(self.vocabSize)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        listed = {g: i for i, g in enumerate(self.vocabulary)}
        kept, width = [c for c in dataset.columns if c != "char_words"], len(listed)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, np.ndarray] = {}

            def number(piece: str) -> np.ndarray:
                found = known.get(piece)
                if found is None:
                    found = known[piece] = np.array([listed[g] for g in char_grams(piece) if g in listed], np.int64)
                return found

            for batch in batches:
                for first, texts, at, gram, n in _text_counts(batch.column("char_words"), number):
                    ends = pa.array(np.searchsorted(at, np.arange(texts + 1)), pa.int32())
                    vector = {
                        "type": pa.array(np.zeros(texts, np.int8)),
                        "size": pa.array(np.full(texts, width, np.int32)),
                        "indices": pa.ListArray.from_arrays(ends, pa.array(gram, pa.int32())),
                        "values": pa.ListArray.from_arrays(ends, pa.array(n, pa.float64())),
                    }
                    counts = pa.StructArray.from_arrays(list(vector.values()), list(vector))
                    part = batch.slice(first, texts)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), counts], [*kept, "char_counts"])
                if len(known) > REMEMBERED:
                    known.clear()
            known.clear()
            _hand_back()

        return dataset.mapInArrow(run, StructType([*(dataset.schema[c] for c in kept), StructField("char_counts", VectorUDT())]))


def gram_counts(train: DataFrame, max_features: int) -> PipelineModel:
    """First stages: sparse counts of the vocabulary's grams, arm codes.

    Unseen arm names get a code of their own, which the encoder turns into all zeros. ``train``
    has an item a row, with its arms listed.
    """
    grams = PipelineModel(gram_stages()).transform(train)
    listed = {g: [r.gram for r in vocabulary(grams, g, max_features).orderBy("place").select("gram").collect()] for g in GRAMS}
    words = CountVectorizerModel.from_vocabulary(listed["word_grams"] or [""], "word_grams", "word_counts", minTF=1.0)
    words._set(vocabSize=max_features)
    arms = StringIndexer(inputCols=["arm_name", "arm_kind"], outputCols=["arm_ix", "kind_ix"], handleInvalid="keep")
    narrow = SQLTransformer(statement="SELECT * EXCEPT (word_tokens, word_pairs, word_grams) FROM __THIS__")
    return PipelineModel([*gram_stages(), words, narrow, CharCounts(listed["char_grams"] or [""], max_features), arms.fit(listed_arms(train.select("arms")))])


def as_items(rows: DataFrame) -> DataFrame:
    """Rows with listed ``arms`` as they are; a row of one arm becomes an item with that arm."""
    return rows if "arms" in rows.columns else rows.withColumn("arms", F.array(F.struct(*ARM))).drop(*ARM)


def listed_arms(items: DataFrame) -> DataFrame:
    """A row an arm."""
    return items.select(*[c for c in items.columns if c != "arms"], F.inline("arms"))


def _counted(counts: PipelineModel, items: DataFrame) -> DataFrame:
    """Counts of each item's text, which does not come along to Python, and the arms."""
    for stage in counts.stages[:-1]:
        items = stage.transform(items.drop("question") if isinstance(stage, CharCounts) else items)
    return items.select("split", "word_counts", "char_counts", "hint_tokens", "arms")


def scaled_features() -> Pipeline:
    """Second stages, over counts only: weighting, unit length, encoding, scaling."""
    return Pipeline(
        stages=[
            IDF(inputCol="word_counts", outputCol="word_idf"),
            Normalizer(inputCol="word_idf", outputCol="word_vec", p=2.0),
            IDF(inputCol="char_counts", outputCol="char_idf"),
            Normalizer(inputCol="char_idf", outputCol="char_vec", p=2.0),
            OneHotEncoder(inputCols=["arm_ix", "kind_ix"], outputCols=["arm_vec", "kind_vec"]),
            VectorAssembler(inputCols=["arm_strength", "hint_tokens"], outputCol="numbers"),
            StandardScaler(inputCol="numbers", outputCol="numbers_vec", withMean=True, withStd=True),
            VectorAssembler(
                inputCols=["word_vec", "char_vec", "arm_vec", "kind_vec", "numbers_vec"], outputCol="features"
            ),
        ]
    )


@dataclass
class Router:
    counts: PipelineModel
    features: PipelineModel
    classifier: LogisticRegressionModel
    calibrator: LogisticRegressionModel
    training: DataFrame | None = None  # features, label and weight of the rows that the classifier was fitted on

    def score(self, rows: DataFrame) -> DataFrame:
        """Rows, one an arm, with the calibrated ``predicted_success``."""
        if "arms" in rows.columns:
            rows = listed_arms(rows)
        margin = _margin(self.classifier, self.features.transform(self.counts.transform(rows)))
        out = self.calibrator.transform(_as_feature(margin))
        keep = [F.col(c) for c in rows.columns]
        return out.select(*keep, vector_to_array("cal_probability")[1].alias("predicted_success"))

    def save(self, path: str) -> None:
        for name in ("counts", "features", "classifier", "calibrator"):
            getattr(self, name).write().overwrite().save(f"{path}/{name}")

    @staticmethod
    def load(path: str) -> Router:
        return Router(
            PipelineModel.load(f"{path}/counts"),
            PipelineModel.load(f"{path}/features"),
            LogisticRegressionModel.load(f"{path}/classifier"),
            LogisticRegressionModel.load(f"{path}/calibrator"),
        )


def _margin(model: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("margin", vector_to_array("rawPrediction")[1])


def _as_feature(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=["margin"], outputCol="margin_vec").transform(rows)


def _class_counts(rows: DataFrame) -> tuple[int, int]:
    n, positive = rows.agg(F.count(F.lit(1)), F.count_if("correct")).first()
    return n, positive


def with_split(rows: DataFrame, train: float = 0.6, validation: float = 0.2, seed: int = 42) -> DataFrame:
    """Rows with their item's split; items never cross splits.

    The splits follow the seeded order of the keys. Two keys come to the driver, the last of the
    first two splits; each row compares its key with them, so no row moves.
    """
    at = F.struct(seeded_hash(seed, F.col("item_key")), F.col("item_key"))
    ends = grouped_split(rows, train, validation, seed).where("item_key is not null").groupBy("split").agg(F.max(at).alias("last"))
    last = {r["split"]: F.struct(*map(F.lit, r["last"])) for r in ends.collect()}
    split = F.lit("test")
    for name in ("validation", "train"):
        split = F.when(at <= last[name], name).otherwise(split) if name in last else split
    rest = [c for c in rows.columns if c != "item_key"]
    return rows.where("item_key is not null").select("item_key", *rest, split.alias("split"))


def fit_router(labelled: DataFrame, max_features: int = 10_000, max_iter: int = 1_000) -> Router:
    """Fit on the train split, calibrate on the validation split of ``with_split`` rows.

    Rows are arms, or items with their ``arms`` listed (fields ``ARM``), whose texts are read once
    for all arms. Texts are cut into grams once per vocabulary and once for the counts; the counts
    are written, an item a row, and weighting and scaling read only those. The features of more
    than ``WRITTEN`` rows are made when they are read, as they would take several times the room of
    the texts. Only class counts and the bounded vocabularies come to the driver. Both splits must
    hold both classes.
    """
    with small_batches(labelled.sparkSession):
        return _fitted(as_items(labelled), max_features, max_iter)


def _fitted(items: DataFrame, max_features: int, max_iter: int) -> Router:
    train, validation = (items.filter(F.col("split") == s) for s in ("train", "validation"))
    n, positive = _class_counts(listed_arms(train.select("arms")))
    m, valid_positive = _class_counts(listed_arms(validation.select("arms")))
    if not (0 < positive < n and 0 < valid_positive < m):
        raise ValueError("train and validation splits must each contain both reward classes")
    counts = gram_counts(train, max_features)
    gc.collect()  # else the shuffled gram counts stay on disk beside the solver's blocks
    items.sparkSession._jvm.System.gc()
    both = items.filter(F.col("split").isin("train", "validation")).select("split", "question", "hint_tokens", "arms")
    counted = counts.stages[-1].transform(listed_arms(cut_lineage(_counted(counts, both), "zstd")))
    counted = counted.withColumn("label", F.col("correct").cast("double"))
    train, validation = (counted.filter(F.col("split") == s) for s in ("train", "validation"))
    features = scaled_features().fit(train)
    balance = F.when(F.col("correct"), n / (2.0 * positive)).otherwise(n / (2.0 * (n - positive)))
    plain = F.col("features").alias("features", metadata={"comment": "names of the features left out"})
    train = features.transform(train.withColumn("weight", balance)).select(plain, "label", "weight")
    if n <= WRITTEN:  # a smaller plan for each step of the solver
        train = cut_lineage(train)
    classifier = LogisticRegression(
        featuresCol="features", weightCol="weight", maxIter=max_iter, regParam=1.0 / n, standardization=False
    ).fit(train)
    scored = _as_feature(cut_lineage(_margin(classifier, features.transform(validation)).select("margin", "label")))
    calibrator = LogisticRegression(
        featuresCol="margin_vec",
        probabilityCol="cal_probability",
        rawPredictionCol="cal_raw",
        predictionCol="cal_prediction",
        maxIter=max_iter,
    ).fit(scored.select("margin_vec", "label"))
    return Router(counts, features, classifier, calibrator, train)


def class_weights(labelled: DataFrame) -> DataFrame:
    """Per split and class: rows, and the balanced weight of one row (rows / (2 x rows of the class))."""
    rows = labelled.groupBy("split", F.col("correct").alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    whole = F.sum("rows").over(Window.partitionBy("split"))  # two rows a split
    return rows.withColumn("weight", whole / (2.0 * F.col("rows")))


def gradient(router: Router) -> DataFrame:
    """Slope of the fitted loss at the stored coefficients: (feature, gradient, coefficient), feature -1 the intercept.

    The loss is the weighted mean log loss plus half of regParam times the squared coefficients. Each
    row adds its residual times its features to its task's sums, over all training rows. At the
    optimum all slopes are zero.
    """
    model = router.classifier
    rows = model.transform(router.training)
    share = F.col("weight") * (vector_to_array("probability")[1] - F.col("label"))
    parts = rows.select("features", "weight", share.alias("share"))
    above, below = (F.when(sign * F.col("share") > 0, sign * F.col("share")).otherwise(0.0) for sign in (1, -1))
    sums = [Summarizer.metrics("sum").summary(F.col("features"), w).getField("sum").alias(n) for w, n in ((above, "above"), (below, "below"))]
    with small_batches(router.training.sparkSession):
        total = parts.agg(*sums, F.sum("share").alias("share"), F.sum("weight").alias("weight")).first()
    slopes = total.above.toArray() - total.below.toArray()
    at = model.coefficients.toArray()  # as long as the vocabularies, which are bounded
    flat = slopes / total.weight + model.getRegParam() * at
    listed = {
        "feature": np.arange(-1, len(at), dtype=np.int32),
        "gradient": np.concatenate([[total.share / total.weight], flat]),
        "coefficient": np.concatenate([[model.intercept], at]),
    }
    return router.training.sparkSession.createDataFrame(pa.table(listed))


def optimality(router: Router, bound: float = 1e-3) -> DataFrame:
    """One row: features, whether the largest slope keeps below ``bound``, and whether the whole gradient does."""
    norm = F.sqrt(F.sum(F.col("gradient") * F.col("gradient")))
    return gradient(router).agg(
        (F.count(F.lit(1)) - 1).alias("features"),
        (F.max(F.abs("gradient")) <= bound).alias("flat_everywhere"),
        (norm <= bound).alias("flat"),
    )


def split_report(labelled: DataFrame) -> DataFrame:
    """Items and records per split."""
    return labelled.groupBy("split").agg(
        F.count_distinct("item_key").alias("items"), F.count(F.lit(1)).alias("records")
    )
