"""Registered queries of the corpus operators: name -> (run, SQL for the same rows or None)."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwork.llm import benchmark_scan, bpe_matrix, conversation_repair, embedding_itq, iblt_fingerprint, line_chunks
from rungwork.llm import ngram_jaccard, packing, run_length_dedup, source_mix, token_alignment, toxicity_pu, warc_merge

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
RANKS = "byte_bpe_50k.tiktoken"


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = (run, sql)
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_embedding_itq")
def near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_itq.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op2_ngram_jaccard")
def near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_groups(table(spark, sf_dir, "documents"))


@query("op3_warc", warc_merge.SQL)
def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table has no capture time: page numbers stand for seconds.
    captured = F.lit(1_700_000_000) + F.col("page_id")
    pages = table(spark, sf_dir, "pages").withColumn("captured", captured)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return warc_merge.capture_histories(pages).select(columns)


@query("op4_mix", source_mix.SQL)
def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])


@query("op5_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_length_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op6_line_dedup", line_chunks.SQL)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)


@query("op7_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_pu.fit_model(docs, table(spark, sf_dir, "labels"))
    return toxicity_pu.score(docs, model).select(
        "doc_id",
        toxicity_pu.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op8_bpe")
def bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path(RANKS)
    return bpe_matrix.encode(docs, path, public_tokenizers.PATTERN, keep_ids=False).drop("text")


@query("op9_fingerprint")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt_fingerprint.compare_versions(table(spark, sf_dir, "documents"))


@query("op10_packing")
def packed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    free = 50_256  # the first id behind the ranks: ends documents and fills rows
    packed = packing.pack_texts(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, length=4096, end_id=free, pad_id=free)
    return packing.summary(packing.written(packed))


@query("op11_benchmark_scan", benchmark_scan.SQL)
def benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = benchmark_scan.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op12_token_alignment")
def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_alignment.aligned_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_conversation_repair")
def repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    return conversation_repair.summaries(conversation_repair.faults(broken))


QUERIES["pipeline"] = (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)
