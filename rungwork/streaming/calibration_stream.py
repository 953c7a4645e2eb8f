"""Calibration kept up to date from an append-only rollout stream."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rungwork.operators.calibration import NO_HELP, RANDOM, RELEVANT, dimension_rank, expected_keys
from rungwork.plans.ranking import last_by

KEYS = ("root_id", "candidate_id", "variant", "sample_index")
BUCKETS = 64
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, folder: str, schema: str, fmt: str = "json", files: int = 100) -> DataFrame:
    """New files of a log folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(folder)


def _query_id(batch: DataFrame) -> str:
    """Id of the running query: kept by its checkpoint, new with a new one."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or uuid.uuid4().hex


def bucket_of(keys: Sequence[str], buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def ledger_keys(spark: SparkSession, ledger: str, query: str, batch_id: int, buckets: list[int], schema: str) -> DataFrame:
    """Keys logged by other batches, read from the named buckets alone."""
    kept = spark.read.schema(f"{schema}, bucket int, query string, batch_id long").parquet(ledger)
    others = ~((F.col("query") == query) & (F.col("batch_id") == batch_id))
    return kept.filter(F.col("bucket").isin(buckets) & others)


def ingest(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True, keys: Sequence[str] = KEYS, buckets: int = BUCKETS):
    """Exactly-once copy of the rows with new keys; of one batch's equal keys any one row stays.

    No streaming state is kept. A ledger beside the copy holds all keys ever copied, in folders of
    a bucket, a query and a batch; a batch is anti-joined with its own buckets of it. A batch first
    writes its rows, then its keys, each into folders that only it writes; read again after a
    failure, it leaves its own earlier keys out and replaces its folders. A query with a new
    checkpoint has a new id, so the ledger still knows what earlier queries have copied.
    """
    ledger = f"{out.rstrip('/')}-ledger"

    def save(batch: DataFrame, batch_id: int) -> None:
        spark, query = batch.sparkSession, _query_id(batch)
        rows = batch.dropDuplicates(list(keys)).withColumn("bucket", bucket_of(keys, buckets)).persist()
        try:
            touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # as many as buckets at most
            if not touched:
                return
            schema = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)
            path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
            fresh = rows
            if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
                known = ledger_keys(spark, ledger, query, batch_id, touched, schema).select("bucket", *keys)
                same = F.col("n.bucket") == F.col("k.bucket")
                for key in keys:
                    same = same & F.col(f"n.{key}").eqNullSafe(F.col(f"k.{key}"))
                fresh = rows.alias("n").join(known.alias("k"), same, "left_anti")
            place = f"query={query}/batch_id={batch_id}"
            fresh.drop("bucket").write.mode("overwrite").parquet(f"{out}/{place}")
            written = spark.read.schema(rows.drop("bucket").schema).parquet(f"{out}/{place}").select(*keys)
            tagged = written.withColumns({"bucket": bucket_of(keys, buckets), "query": F.lit(query), "batch_id": F.lit(batch_id)})
            # only this batch's folders are replaced; one file a bucket
            dynamic = tagged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            dynamic.partitionBy("bucket", "query", "batch_id").parquet(ledger)
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def running_q(stream: DataFrame) -> DataFrame:
    """Success per root, candidate and variant so far (run in update mode)."""
    n = F.count(F.lit(1))
    return stream.groupBy("root_id", "candidate_id", "variant").agg(
        n.alias("samples"), F.count_if("correct").alias("hits"), (F.count_if("correct") / n).alias("q")
    )


def write_updates(updates: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """Updated rows of each batch in a folder of its own (see :func:`latest`)."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = updates.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Newest update per key."""
    return last_by(spark.read.parquet(out), keys, "batch_id").drop("batch_id")


ROOT_BUCKETS = 1 << 12  # of roots, whose state is one value each; a state store keeps to the number it began with
PACKED = 200_000  # rows of the log that a task packs at once
PACK = (
    "bucket int, root_id array<string>, candidate_id array<string>, variant array<string>, "
    "sample_index array<int>, correct array<boolean>, place array<bigint>"
)
CELLS = "bucket int, cells binary"
DECISION = (
    "root_id string, status string, candidate_id string, success_probability double, "
    "no_help_probability double, random_plan_probability double, prefix int, wave_end int"
)


def root_members(candidates: DataFrame) -> DataFrame:
    """Per root its candidates as a short array (one entry per candidate id)."""
    words = F.size(F.split(F.trim("minimal_plan"), r"\s+"))
    one = candidates.groupBy("root_id", "id").agg(
        F.max(words).alias("plan_words"), F.max(dimension_rank()).alias("dimension_rank")
    )
    member = F.struct("id", "plan_words", "dimension_rank")
    return one.groupBy("root_id").agg(F.collect_list(member).alias("members"))


def _pack(rows: pa.Table) -> pa.RecordBatch:
    """A row a bucket with the first arrival of each sample of its (root, candidate, variant)."""
    cell = np.zeros(len(rows), np.int64)
    for name in ("root_id", "candidate_id", "variant", "sample_index"):  # three variants are known: 64 bits hold a chunk's cells
        coded = rows[name].combine_chunks().dictionary_encode()
        cell = cell * len(coded.dictionary) + coded.indices.to_numpy()
    bucket, place = (rows[name].to_numpy() for name in ("bucket", "place"))
    order = np.lexsort((place, cell, bucket))
    first = order[np.diff(cell[order], prepend=-1) != 0]
    starts = np.flatnonzero(np.diff(bucket[first], prepend=-1))
    ends = pa.array(np.append(starts, len(first)), pa.int32())
    kept = rows.take(pa.array(first)).combine_chunks()
    names = kept.column_names[1:]
    lists = [pa.ListArray.from_arrays(ends, kept[name].combine_chunks()) for name in names]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first][starts], pa.int32()), *lists], ["bucket", *names])


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task in few rows, ``PACKED`` rows at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= PACKED:
            yield _pack(pa.Table.from_batches(held))
            held = []
    if held:
        yield _pack(pa.Table.from_batches(held))


def _read(state) -> dict:
    return pickle.loads(bytes(state.get()[0])) if state.exists() else {}


def _write(state, entries: dict) -> None:
    if entries:
        state.update((pickle.dumps(entries, 4),))
    elif state.exists():
        state.clear()


class SampleMasks(StatefulProcessor):
    """First stage, one state a bucket of roots: which samples of a (root, candidate, variant) are logged, and which were right.

    A sample's first arrival counts, inside a batch the row with the smallest log position. The
    state has two bits a sample. What a key has expires ``ttl`` milliseconds after its last change, where given.
    """

    def __init__(self, ttl: int | None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.masks = handle.getValueState("masks", "cells binary", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first: dict[tuple, dict[int, tuple]] = {}
        one: dict[str, str] = {}  # equal strings are one object, which a pickle holds once
        for row in rows:
            for root, candidate, variant, index, correct, place in zip(row.root_id, row.candidate_id, row.variant, row.sample_index, row.correct, row.place):
                name = one.setdefault(root, root), one.setdefault(candidate, candidate), one.setdefault(variant, variant)
                samples = first.setdefault(name, {})
                if index not in samples or place < samples[index][0]:
                    samples[index] = (place, correct)
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl else 0
        masks = {k: v for k, v in _read(self.masks).items() if not self.ttl or now < v[2] + self.ttl}
        changed = []
        for name, samples in first.items():
            seen, right, _ = masks.get(name, (0, 0, 0))
            fresh = [(index, correct) for index, (_, correct) in samples.items() if not seen >> index & 1]
            if fresh:
                seen |= sum(1 << index for index, _ in fresh)
                right |= sum(1 << index for index, correct in fresh if correct)
                masks[name] = (seen, right, now)
                changed.append((*name, seen, right))
        if changed:
            _write(self.masks, masks)
            yield Row(bucket=key[0], cells=pickle.dumps(changed, 4))

    def close(self) -> None:
        pass


class StopRule(StatefulProcessor):
    """Second stage, one state a bucket of roots: the masks of a root's keys until it is decided, then one word.

    Samples that were counted once stay as they were, so a first-stage mask that expired or a
    repeated row changes nothing. When a root is decided, its masks are released.
    """

    def __init__(self, q_low: float, q_high: float, min_gain: float, min_samples: int, max_samples: int, sample_batch: int, ttl: int | None):
        self.q_low, self.q_high, self.min_gain = q_low, q_high, min_gain
        self.min_samples, self.max_samples, self.sample_batch, self.ttl = min_samples, max_samples, sample_batch, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getValueState("cells", "roots binary", self.ttl)
        self.decided = handle.getValueState("decided", "roots binary")

    def _share(self, cell: tuple[int, int]) -> float | None:
        """Success of a key with samples enough."""
        seen, right = cell
        return right.bit_count() / seen.bit_count() if seen.bit_count() >= self.min_samples else None

    def _ruled(self, root: str, cells: dict[tuple[str, str], tuple[int, int]], members: list) -> Row:
        wanted = [("", NO_HELP), *((m["id"], v) for m in members for v in (RELEVANT, RANDOM))]
        found = [cells.get(name, (0, 0)) for name in wanted]
        whole = (1 << self.max_samples) - 1
        for seen, _ in found:
            whole &= seen
        prefix = (~whole & (whole + 1)).bit_length() - 1
        base, shares = self._share(found[0]), [self._share(cell) for cell in found[1:]]
        middle, usable = (self.q_low + self.q_high) / 2, []
        for m, q, other in zip(members, shares[::2], shares[1::2]):
            if None not in (base, q, other) and self.q_low <= q <= self.q_high and q > max(base, other) + self.min_gain:
                usable.append(((m["plan_words"], abs(q - middle), m["dimension_rank"], m["id"]), q, other))
        best = min(usable, default=None)
        status = "selected" if best else "exhausted" if prefix >= self.max_samples else "next_wave"
        return Row(
            root_id=root, status=status, candidate_id=best and best[0][3], success_probability=best and best[1],
            no_help_probability=base if best else None, random_plan_probability=best and best[2], prefix=prefix,
            wave_end=min(self.max_samples, max(self.min_samples, prefix + self.sample_batch)) if status == "next_wave" else None,
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl else 0
        decided = _read(self.decided)
        open_roots = {k: v for k, v in _read(self.cells).items() if not self.ttl or now < v[1] + self.ttl}
        news, members, before = set(), {}, len(decided)
        for row in rows:
            for root, candidate, variant, seen, right in pickle.loads(bytes(row.cells)):
                if root in decided:
                    continue
                cells = open_roots[root][0] if root in open_roots else {}
                had, was = cells.get((candidate, variant), (0, 0))
                fresh = seen & ~had
                cells[candidate, variant] = (had | fresh, was | (right & fresh))
                open_roots[root] = (cells, now)
                news.add(root)
            members.update((r["root_id"], r["members"]) for r in row.roots if r["root_id"] in news)
        for root in news:
            found = self._ruled(root, open_roots[root][0], members[root])
            if found.status != "next_wave":
                decided[root] = found.status
                del open_roots[root]
            yield found
        if news:
            _write(self.cells, open_roots)
        if len(decided) > before:
            _write(self.decided, decided)

    def close(self) -> None:
        pass


def sequential_stop(
    stream: DataFrame,
    candidates: DataFrame,
    q_low: float,
    q_high: float,
    min_gain: float,
    min_samples: int,
    max_samples: int,
    sample_batch: int,
    ttl: int | None = None,
) -> DataFrame:
    """After each batch, per root with news: ``selected``, ``exhausted`` or the next wave.

    Two stages on a state store. Tasks keep the first arrival of each sample of a (root, candidate,
    variant) and pack them by bucket of roots, so of a root with most of the log few rows move. The
    first stage makes bit masks of them, the second one applies the rule to roots whose masks
    changed; each reads and writes one state a bucket, not one a key. Keys of unknown candidates leave before any
    state is kept. ``ttl`` (milliseconds) lets first-stage masks and open roots expire that were not
    changed for so long; it must be longer than the time between waves. Run in append mode.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)  # what this kind of state needs
    candidate = F.coalesce("candidate_id", F.lit("")).alias("candidate_id")
    last = F.lit((1 << 63) - 1)  # rows without a position come last
    place = (F.coalesce("log_pos", last) if "log_pos" in stream.columns else last).cast("bigint").alias("place")
    index, correct = F.col("sample_index").cast("int"), F.coalesce("correct", F.lit(False)).alias("correct")
    rows = stream.where((index >= 0) & (index < max_samples)).select("root_id", candidate, "variant", index.alias("sample_index"), correct, place)
    known = rows.join(expected_keys(candidates), ["root_id", "candidate_id", "variant"], "left_semi")
    bucket = bucket_of(["root_id"], ROOT_BUCKETS).alias("bucket")
    packs = known.select(bucket, "root_id", "candidate_id", "variant", "sample_index", "correct", "place").mapInArrow(packed, PACK)
    mode = "ProcessingTime" if ttl else "None"
    masks = packs.groupBy("bucket").transformWithState(SampleMasks(ttl), CELLS, "Append", mode)
    roots = root_members(candidates).groupBy(bucket).agg(F.collect_list(F.struct("root_id", "members")).alias("roots"))
    rule = StopRule(q_low, q_high, min_gain, min_samples, max_samples, sample_batch, ttl)
    return masks.join(roots, "bucket").groupBy("bucket").transformWithState(rule, DECISION, "Append", mode)
