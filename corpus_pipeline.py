"""A training-data pipeline of five corpus operators over the table ``documents``.

Toxic documents go, repeated multi-line chunks go, one document of each near-duplicate group
stays, sources are mixed to their target weights, and the mix is encoded. Every stage takes the
documents that the one before has kept, written as Parquet; all but the last return the columns
of ``documents``. A stage's helper tables are deleted when the next one starts: by then its result
is written. Stages hand whole texts to Python in batches of ``BATCH_ROWS`` rows: they lower the
session's ``spark.sql.execution.arrow.maxRecordsPerBatch`` to it, and leave it so, since results are
computed after a stage returns. The batches differ, the rows do not.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rungwork.llm import bpe_matrix, line_chunks, ngram_jaccard, source_mix, toxicity_pu
from rungwork.session import cut_lineage, drop_tables, helper_tables

ORACLE_SQL = None  # learned scores and merges have no SQL; tests/llm holds brute-force versions
SLOTS = 1 << 20
BATCH_ROWS = 1_000
_helpers: list[str] = []  # of the stage before


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that deletes the helper tables of the one before it and remembers its own."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark, _helpers)
        rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        if not 0 < rows <= BATCH_ROWS:  # none or less stands for all rows of a task
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        with helper_tables() as paths:
            out = work(spark, docs, sf_dir)
        _helpers[:] = paths
        return out

    return run_stage


@stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; labels only come from the training fold."""
    model = toxicity_pu.fit_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = "toxicity_score"
    while out in map(str.lower, docs.columns):  # the caller may have such a column
        out += "_"
    scored = toxicity_pu.score(docs, model, out=out)
    return scored.where(F.col(out) < 0.5).select(docs.columns)


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated chunks of lines but for their first places."""
    return line_chunks.dedup_lines(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; of rows with one id and text one stays.

    Rows without an id are in no group and stay. Only documents whose id is concerned are moved.
    """
    groups = ngram_jaccard.jaccard_groups(docs)
    ids = groups.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component"), F.count(F.lit(1)).alias("n"))
    touched = cut_lineage(ids.where("component <> doc_id or n > 1").select(F.col("doc_id").alias("id"), (F.col("component") != F.col("doc_id")).alias("out")))
    row = docs.select(F.struct(*docs.columns).alias("row"))  # helper names stay apart from the caller's
    slot = F.pmod(F.xxhash64("row.doc_id"), F.lit(SLOTS))
    slots = touched.select(F.pmod(F.xxhash64("id"), F.lit(SLOTS)).alias("slot")).distinct()  # SLOTS rows at most
    dealt = row.withColumn("slot", slot)
    rest = dealt.join(F.broadcast(slots), "slot", "left_anti")
    some = dealt.join(F.broadcast(slots), "slot", "left_semi").join(touched, F.col("row.doc_id") == F.col("id"), "left")
    copy = Window.partitionBy("row.doc_id", F.xxhash64("row.text")).orderBy("row.text")
    kept = some.where("not coalesce(out, false)").withColumn("copy", F.row_number().over(copy))
    kept = kept.where("id is null or copy = 1")
    return rest.select("row").unionByName(kept.select("row")).select([F.col(f"row.`{c}`").alias(c) for c in docs.columns])


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; on a source's border the first words of one."""
    return source_mix.mixed_documents(docs)


@stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with the digest of what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_matrix.encode(docs.select("doc_id", "source", "text"), path, public_tokenizers.PATTERN).drop("text")


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("byte-level BPE encoding and decoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, work in STAGES:
        docs = cut_lineage(work(spark, docs, sf_dir))
    return docs
