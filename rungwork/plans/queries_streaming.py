"""Streaming calibration over the line-item files, and the learned router."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwork.functions import text as tx
from rungwork.operators import router_model as rm
from rungwork.operators import routing as ro
from rungwork.plans import oracle_views as ov
from rungwork.plans.queries_frontier import rounded
from rungwork.plans.registry import query
from rungwork.session import checkpoint_folder, cut_lineage
from rungwork.sources import bridge
from rungwork.streaming import calibration_stream as cs


def _work_folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The help log as a stream: line items arrive, orders are a static table."""
    lines = bridge.table(spark, sf_dir, "lineitem")
    arriving = (
        spark.readStream.schema(lines.schema).option("pathGlobFilter", "lineitem*.parquet").parquet(sf_dir)
    )
    return bridge.as_help_results(arriving.join(bridge.table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey")))


@query("S2", "WITH " + ov.HELP_RESULTS + """
SELECT root_id, candidate_id, variant, count(*) AS samples, count(*) FILTER (correct) AS hits,
       round(count(*) FILTER (correct) / count(*), 9) AS q
FROM help_results GROUP BY ALL""")
def stream_running_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = _work_folder(spark)
    run = cs.write_updates(cs.running_q(_stream(spark, sf_dir)), f"{work}/q", f"{work}/cp")
    run.awaitTermination()
    return rounded(cs.latest(spark, f"{work}/q", ["root_id", "candidate_id", "variant"]))


@query("S1, A7", "WITH " + ov.HELP_RESULTS + """
SELECT variant, count(*) AS keys FROM (SELECT DISTINCT root_id, candidate_id, variant, sample_index FROM help_results) k GROUP BY variant""")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = _work_folder(spark)
    cs.ingest(_stream(spark, sf_dir), f"{work}/log", f"{work}/cp").awaitTermination()
    copied = spark.read.parquet(f"{work}/log")
    return copied.groupBy("variant").agg(F.count(F.lit(1)).alias("keys"))


@query("S3", "WITH " + ov.HELP_RESULTS + "," + ov.ROOT_CANDIDATES + """,
expected AS (
  SELECT DISTINCT root_id, '' AS candidate_id, 'no_help' AS variant FROM root_candidates
  UNION ALL SELECT root_id, id, v FROM root_candidates CROSS JOIN (VALUES ('relevant_plan'), ('random_plan')) t(v)
),
logged AS (
  SELECT root_id, candidate_id, variant, sample_index, arg_min(correct, log_pos) AS correct
  FROM help_results SEMI JOIN expected USING (root_id, candidate_id, variant) WHERE sample_index < 3 GROUP BY ALL
),
cells AS (SELECT root_id, candidate_id, variant, count(*) AS n, count(*) FILTER (correct) / count(*) AS q FROM logged GROUP BY ALL),
enough AS (SELECT * FROM cells WHERE n >= 2),
prefixes AS (
  SELECT root_id, coalesce(min(i) FILTER (lacking > 0), 3) AS prefix
  FROM (SELECT e.root_id, i, count(*) FILTER (l.root_id IS NULL) AS lacking
        FROM expected e CROSS JOIN (VALUES (0), (1), (2)) s(i)
             LEFT JOIN logged l ON l.root_id = e.root_id AND l.candidate_id = e.candidate_id AND l.variant = e.variant AND l.sample_index = i
        GROUP BY e.root_id, i) g GROUP BY root_id
),
usable AS (
  SELECT c.root_id, c.id, r.q AS q_help, b.q AS q_no, x.q AS q_random,
         row_number() OVER (PARTITION BY c.root_id ORDER BY len(string_split(minimal_plan, ' ')), abs(r.q - 0.5::DOUBLE), pos, id) AS rn
  FROM root_candidates c
       JOIN enough r ON r.root_id = c.root_id AND r.candidate_id = c.id AND r.variant = 'relevant_plan'
       JOIN enough x ON x.root_id = c.root_id AND x.candidate_id = c.id AND x.variant = 'random_plan'
       JOIN enough b ON b.root_id = c.root_id AND b.variant = 'no_help'
  WHERE r.q BETWEEN 0.25 AND 0.75 AND r.q > greatest(b.q, x.q)
)
SELECT p.root_id, CASE WHEN u.id IS NOT NULL THEN 'selected' WHEN prefix >= 3 THEN 'exhausted' ELSE 'next_wave' END AS status,
       u.id AS candidate_id, round(q_help, 9) AS success_probability, round(q_no, 9) AS no_help_probability,
       round(q_random, 9) AS random_plan_probability, CAST(prefix AS INTEGER) AS prefix,
       CAST(CASE WHEN u.id IS NULL AND prefix < 3 THEN least(3, greatest(2, prefix + 1)) END AS INTEGER) AS wave_end
FROM prefixes p SEMI JOIN logged USING (root_id) LEFT JOIN usable u ON u.root_id = p.root_id AND rn = 1""")
def stream_sequential_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = _work_folder(spark)
    decisions = cs.sequential_stop(
        _stream(spark, sf_dir),
        bridge.root_candidates(spark, sf_dir),
        q_low=0.25,
        q_high=0.75,
        min_gain=0.0,
        min_samples=2,
        max_samples=3,
        sample_batch=1,
    )
    run = (
        decisions.writeStream.format("parquet")
        .option("path", f"{work}/out")
        .option("checkpointLocation", f"{work}/cp")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return rounded(spark.read.schema(decisions.schema).parquet(f"{work}/out"))


# Two arms a labelled document; items are split by the seeded order of their keys.
ROUTER = """
WITH labelled AS (
  SELECT concat(CAST(d.doc_id AS VARCHAR), '::', substr(sha1(text), 1, 12)) AS item_key, text, quality, toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
),
keys AS (
  SELECT item_key, row_number() OVER (ORDER BY """ + ov.seeded(42, "item_key") + """, item_key) AS rank, count(*) OVER () AS n
  FROM (SELECT DISTINCT item_key FROM labelled) k
),
cuts AS (
  SELECT *, greatest(1, CAST(floor(n * 0.6::DOUBLE) AS BIGINT)) AS first FROM keys
),
splits AS (
  SELECT item_key, CASE WHEN rank <= first THEN 'train'
                        WHEN rank <= least(n - 1, greatest(first + 1, CAST(floor(n * (0.6::DOUBLE + 0.2::DOUBLE)) AS BIGINT))) THEN 'validation' ELSE 'test' END AS split
  FROM cuts
),
arms AS (
  SELECT split, text, quality = 1 AS correct FROM labelled JOIN splits USING (item_key)
  UNION ALL SELECT split, text, toxic = 0 FROM labelled JOIN splits USING (item_key)
)
"""


BROADCAST_LABELS = 1 << 21  # labels, of a few bytes each, that go to the texts


def _router_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled document with its two arms: is it good as it is, is it clean with a hint."""
    docs = bridge.table(spark, sf_dir, "documents")
    labels = bridge.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_doc"), "quality", "toxic")
    if labels.count() <= BROADCAST_LABELS:
        labels = F.broadcast(labels)

    def arm(name: str, strength: float, order: int, correct: Column) -> Column:
        return F.struct(
            F.lit(name).alias("arm_name"),
            F.lit(name.split("@")[0]).alias("arm_kind"),
            F.lit(strength).alias("arm_strength"),
            F.lit(order).alias("arm_order"),
            correct.alias("correct"),
        )

    arms = F.array(
        arm("none", 0.0, 0, F.col("quality") == 1), arm("knowledge@25", 0.25, 1, F.col("toxic") == 0)
    )
    items = docs.join(labels, F.col("doc_id") == F.col("label_doc")).select(
        F.col("doc_id").cast("string").alias("id"),
        tx.item_id("doc_id", "text").alias("item_key"),
        F.col("text").alias("question"),
        F.col("n_chars").cast("double").alias("hint_tokens"),
        "quality",
        "toxic",
    )
    with rm.small_batches(spark):
        return cut_lineage(rm.with_split(items).select("item_key", "id", "question", "hint_tokens", arms.alias("arms"), "split"), "zstd")


@query("M1-M4")
def router_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _router_rows(spark, sf_dir)
    router = rm.fit_router(labelled)
    scored = router.score(labelled.filter(F.col("split") == "test"))
    with rm.small_batches(spark):
        plain = cut_lineage(scored.select(F.col("correct").cast("int").alias("label"), F.col("predicted_success").alias("p")))
    return rounded(ro.probability_metrics(plain))


@query("M1", ROUTER + """
, tokens AS (
  SELECT row_number() OVER () AS row, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}]+'), lambda w: length(w) > 1) AS ws
  FROM arms WHERE split = 'train'
),
grams AS (
  SELECT row, unnest(ws || list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1]))) AS gram FROM tokens
),
counts AS (
  SELECT gram, count(DISTINCT row) AS rows, count(*) AS uses FROM grams GROUP BY gram HAVING count(DISTINCT row) >= 2
)
SELECT gram, rows, uses, row_number() OVER (ORDER BY uses DESC, gram) - 1 AS place FROM counts QUALIFY place < 10000""")
def router_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word grams that the router is fitted with, with their exact counts."""
    train = _router_rows(spark, sf_dir).filter(F.col("split") == "train")
    grams = PipelineModel(rm.gram_stages()).transform(train)
    return rm.vocabulary(grams, "word_grams", 10_000).withColumn("place", F.col("place").cast("long"))


@query("M1, M2", ROUTER + """
SELECT split, correct AS label, count(*) AS rows, round(sum(count(*)) OVER (PARTITION BY split) / (2.0::DOUBLE * count(*)), 9) AS weight
FROM arms GROUP BY split, correct""")
def router_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rm.class_weights(rm.listed_arms(_router_rows(spark, sf_dir))))


@query("M2, M3", "SELECT true AS flat_everywhere, true AS flat, true AS all_features")
def router_optimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted classifier is at the minimum of its loss: the gradient there, summed over all training rows, is small."""
    router = rm.fit_router(_router_rows(spark, sf_dir))
    size = F.lit(router.classifier.numFeatures)
    return rm.optimality(router).select("flat_everywhere", "flat", (F.col("features") == size).alias("all_features"))
