"""Registered corpus queries: against SQL where there is one, else complete and stable; the pipeline by stages."""

import sys

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from collections import namedtuple  # noqa: E402

import corpus_pipeline  # noqa: E402
from compare import compare, duck  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from rungwork.llm import bpe_matrix, line_chunks, ngram_jaccard, source_mix, toxicity_pu  # noqa: E402
from rungwork.llm.queries import QUERIES  # noqa: E402
from rungwork.session import cut_lineage  # noqa: E402

SF = "/root/testdata/sf0.001"
Item = namedtuple("Item", "run sql")


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_query_matches_sql(spark, name):
    assert compare(spark, duck(SF), Item(*QUERIES[name]), SF) is None


@pytest.mark.parametrize("name, key, table", [("op1_embedding_itq", "vec_id", "embeddings"), ("op2_ngram_jaccard", "doc_id", "documents"), ("op5_suffix_dedup", "doc_id", "documents"),
                                             ("op7_toxicity", "doc_id", "documents"), ("op8_bpe", "doc_id", "documents"), ("op9_fingerprint", "doc_id", "documents")])
def test_query_covers_the_whole_table(spark, name, key, table):
    got = sorted(x[key] for x in QUERIES[name][0](spark, SF).select(key).collect())
    assert got == sorted(x[key] for x in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())


def test_packed_query_holds_every_token(spark):
    rows = QUERIES["op10_packing"][0](spark, SF).collect()
    public = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_matrix.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sum(x.n_tokens for x in rows) == sum(len(public.encode_ordinary(d.text)) + 1 for d in docs)
    assert {d for x in rows for d in x.doc_ids} == {d.doc_id for d in docs}


def test_stages_of_the_pipeline(spark):
    docs = cut_lineage(
        spark.read.parquet(f"{SF}/documents.parquet").unionByName(
            spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "src0", 0), (None, "no id", None, "src1", 5)], "doc_id long, text string, lang string, source string, n_chars long")
        )
    )
    model = toxicity_pu.fit_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = cut_lineage(stage(spark, docs, SF))
        if name == "byte-level BPE encoding and decoding":
            plain = before.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("d")).collect()
            assert sorted((str(x.doc_id), x.d) for x in plain) == sorted((str(x.doc_id), x.decoded_sha256) for x in docs.collect())
            continue
        assert docs.columns == before.columns
        rows, kept = before.collect(), docs.collect()
        if name == "toxicity":
            scores = toxicity_pu.scores_of([x.text for x in rows], model, {})
            assert sorted(map(str, kept)) == sorted(str(x) for x, s in zip(rows, scores) if s < 0.5)
        elif name == "line dedup":
            assert sorted(map(str, line_chunks.dedup_lines(before).collect())) == sorted(map(str, kept)) and len(kept) == len(rows)
        elif name == "n-gram Jaccard join":
            groups = ngram_jaccard.jaccard_groups(before).collect()
            assert sorted(str(x.doc_id) for x in kept) == sorted(str(x.doc_id) for x in groups if x.doc_id in (None, x.component_id))
        else:
            sizes = source_mix.mix(before, keep=["doc_id"]).agg(F.sum("taken")).first()[0]
            assert docs.select(F.sum(source_mix.words(F.col("text")))).first()[0] == sizes


def test_repeated_rows_leave_one(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (3, "x"), (None, "x"), (None, "x"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted((str(x.doc_id), x.text) for x in kept if x.text) == [("1", "a b c d e f g"), ("3", "x"), ("None", "x"), ("None", "x")]
    assert any(x.doc_id == 4 for x in kept)


def test_stages_keep_columns_named_as_their_helpers(spark):
    names = ["slot", "id", "out", "copy", "row", "Toxicity_Score", "component", "n"]
    rows = [(i, t, *[f"{c}{k}" for c in names]) for k, (i, t) in enumerate([(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "x"), (None, "x"), (4, None)])]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string", *[f"{c} string" for c in names]]))
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(str(r) for r in rows if r[0] != 2)
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    wide = whole.select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in names])
    got = corpus_pipeline.toxicity(spark, wide, SF)
    assert got.columns == wide.columns
    got = got.collect()
    assert sorted(x.doc_id for x in got) == sorted(x.doc_id for x in corpus_pipeline.toxicity(spark, whole, SF).collect())
    assert all(x[c] == f"{c}{x.doc_id}" for x in got for c in names)


def test_stages_hand_texts_to_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(key)
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text", "'s' as source")
    try:
        out = dict(corpus_pipeline.STAGES)["byte-level BPE encoding and decoding"](spark, docs.coalesce(1), SF)
        seen = docs.coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([len(b)])], names=["n"]) for b in batches), "n long")
        assert [r.n for r in seen.collect()] == [1000, 1000, 1000] and out.count() == 3000
        spark.conf.set(key, 10)
        corpus_pipeline.encoding(spark, docs, SF)
        assert spark.conf.get(key) == "10"  # a smaller one stays
    finally:
        spark.conf.set(key, usual)
