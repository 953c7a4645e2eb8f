"""Candidate calibration, controls and shard queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwork.operators import admission as ad
from rungwork.operators import calibration as ca
from rungwork.operators import controls as co
from rungwork.operators import shards as sh
from rungwork.plans import oracle_views as ov
from rungwork.plans.queries_frontier import rounded
from rungwork.plans.registry import query
from rungwork.sources import bridge

LOW, HIGH = 0.25, 0.75

BASE = "WITH " + ov.HELP_RESULTS + "," + ov.ROOT_CANDIDATES
MEASURED = BASE + """,
measured AS (
  SELECT candidate_id, count(*) AS samples, sum(CASE WHEN correct THEN 1 ELSE 0 END) / count(*) AS q
  FROM help_results GROUP BY candidate_id HAVING count(*) >= 4
),
calibrated AS (
  SELECT c.*, m.q AS success_probability, coalesce(m.q BETWEEN 0.25 AND 0.75, false) AS in_q_band
  FROM root_candidates c LEFT JOIN measured m ON c.id = m.candidate_id
)
"""


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return bridge.root_candidates(spark, sf_dir), bridge.help_results(spark, sf_dir)


def _calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, results = _tables(spark, sf_dir)
    return ca.candidate_q(candidates, results, LOW, HIGH, min_samples=4)


@query("F24, F26", MEASURED + """
SELECT id, dimension, round(success_probability, 9) AS success_probability, in_q_band FROM calibrated""")
def candidate_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_calibrated(spark, sf_dir).select("id", "dimension", "success_probability", "in_q_band"))


@query("F23", MEASURED + """
SELECT count(success_probability) AS candidate_count, count(*) FILTER (in_q_band) AS trainable_candidate_count,
       round(count(*) FILTER (in_q_band) / count(success_probability), 9) AS trainable_candidate_rate,
       round(avg(success_probability), 9) AS mean_q
FROM calibrated""")
def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ca.q_summary(_calibrated(spark, sf_dir)))


@query("F28", MEASURED + """
SELECT round(success_probability, 9) AS success_probability, count(*) AS candidates
FROM calibrated WHERE success_probability IS NOT NULL GROUP BY 1""")
def q_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ca.q_histogram(_calibrated(spark, sf_dir)))


@query("F28", MEASURED + """
SELECT dimension, count(success_probability) AS candidates, round(avg(success_probability), 9) AS mean_q,
       count(*) FILTER (in_q_band) AS in_band
FROM calibrated GROUP BY dimension""")
def dimension_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ca.dimension_report(_calibrated(spark, sf_dir)))


@query("F27, H2", MEASURED + """
SELECT root_id, id, round(success_probability, 9) AS success_probability
FROM (SELECT *, row_number() OVER (PARTITION BY root_id
             ORDER BY abs(success_probability - 0.5::DOUBLE), length(subproblem), pos, id) AS rn
      FROM calibrated WHERE in_q_band) r
WHERE rn = 1""")
def best_candidate_per_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ca.best_candidate_per_root(_calibrated(spark, sf_dir))
    return rounded(best.select("root_id", "id", "success_probability"))


@query("F25", BASE + f""",
seen AS (SELECT DISTINCT root_id, dimension FROM help_results WHERE candidate_id <> ''),
whole AS (SELECT root_id, row_number() OVER (ORDER BY {ov.seeded(42, 'root_id')}, root_id) AS root_rank
          FROM seen GROUP BY root_id HAVING count(*) = 3)
SELECT c.id, c.root_id, c.dimension, root_rank, CAST(c.pos - 1 AS INTEGER) AS dimension_rank
FROM root_candidates c JOIN whole w ON c.root_id = w.root_id WHERE root_rank <= (SELECT count(DISTINCT root_id) // 2 FROM root_candidates)""")
def complete_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, results = _tables(spark, sf_dir)
    seen = results.filter(F.col("candidate_id") != "").select(F.col("candidate_id").alias("id")).distinct()
    known = candidates.join(seen, "id", "left_semi").withColumn("log_pos", F.lit(1))
    half = candidates.select("root_id").distinct().count() // 2
    picked = ca.complete_roots(known, root_limit=half, seed=42)
    return picked.select("id", "root_id", "dimension", "root_rank", "dimension_rank")


CAUSAL = BASE + """,
cells AS (
  SELECT root_id, candidate_id, variant, count(*) AS n, sum(CASE WHEN correct THEN 1 ELSE 0 END) / count(*) AS q
  FROM help_results GROUP BY ALL HAVING count(*) >= 2
),
scored AS (
  SELECT c.*, r.q AS q_help, x.q AS q_random, b.q AS q_no
  FROM root_candidates c
       JOIN cells r ON r.root_id = c.root_id AND r.candidate_id = c.id AND r.variant = 'relevant_plan'
       JOIN cells x ON x.root_id = c.root_id AND x.candidate_id = c.id AND x.variant = 'random_plan'
       JOIN cells b ON b.root_id = c.root_id AND b.variant = 'no_help'
),
chosen AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY len(string_split(minimal_plan, ' ')),
                                 abs(q_help - 0.5::DOUBLE), pos, id) AS rn
    FROM scored WHERE q_help BETWEEN 0.25 AND 0.75 AND q_help > q_no + 0.05 AND q_help > q_random + 0.05) o
  WHERE rn = 1
)
"""


def _causal(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, results = _tables(spark, sf_dir)
    return ca.causal_candidates(candidates, results, LOW, HIGH, min_gain=0.05, min_samples=2)


@query("F29", CAUSAL + """
SELECT root_id, id, round(q_help, 9) AS success_probability, round(q_no, 9) AS no_help_probability,
       round(q_random, 9) AS random_plan_probability, round(q_help - q_no, 9) AS gain_over_no_help,
       round(q_help - q_random, 9) AS gain_over_random
FROM chosen""")
def causal_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        _causal(spark, sf_dir).select(
            "root_id",
            "id",
            "success_probability",
            "no_help_probability",
            "random_plan_probability",
            "gain_over_no_help",
            "gain_over_random",
        )
    )


@query("F32", CAUSAL + """
SELECT (SELECT count(DISTINCT root_id) FROM root_candidates) AS selected_roots, count(*) AS training_roots,
       round(count(*) / (SELECT count(DISTINCT root_id) FROM root_candidates), 9) AS training_candidate_rate
FROM chosen""")
def calibration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, _ = _tables(spark, sf_dir)
    return rounded(ca.calibration_summary(candidates, _causal(spark, sf_dir)))


MAX_SAMPLES, MIN_SAMPLES, BATCH = 4, 1, 2
PREFIX = BASE + """,
logged AS (SELECT DISTINCT root_id, candidate_id, variant, sample_index FROM help_results),
full_index AS (
  SELECT root_id, sample_index FROM logged GROUP BY root_id, sample_index HAVING count(*) = 7
),
indices AS (SELECT unnest(range(0, 4)) AS i),
prefixes AS (
  SELECT root_id, coalesce(min(i) FILTER (NOT done), 4) AS prefix
  FROM (SELECT r.root_id, i, f.root_id IS NOT NULL AS done
        FROM (SELECT DISTINCT root_id FROM root_candidates) r CROSS JOIN indices
             LEFT JOIN full_index f ON f.root_id = r.root_id AND f.sample_index = i) g
  GROUP BY root_id
)
"""


@query("F30, D3", PREFIX + "SELECT root_id, CAST(prefix AS INTEGER) AS prefix FROM prefixes")
def completed_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, results = _tables(spark, sf_dir)
    return ca.completed_prefix(candidates, results, MAX_SAMPLES)


@query("F31, D3, E3, H11", PREFIX + """
, wanted AS (
  SELECT p.root_id, k.candidate_id, k.variant, i AS sample_index
  FROM prefixes p JOIN indices ON i >= prefix AND i < least(4, greatest(1, prefix + 2))
       JOIN (SELECT DISTINCT root_id, '' AS candidate_id, 'no_help' AS variant FROM root_candidates
             UNION ALL SELECT root_id, id, 'relevant_plan' FROM root_candidates
             UNION ALL SELECT root_id, id, 'random_plan' FROM root_candidates) k ON k.root_id = p.root_id
)
SELECT w.root_id, w.candidate_id, w.variant, CAST(w.sample_index AS INTEGER) AS sample_index
FROM wanted w ANTI JOIN logged l ON w.root_id = l.root_id AND w.candidate_id = l.candidate_id
     AND w.variant = l.variant AND w.sample_index = l.sample_index""")
def pending_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, results = _tables(spark, sf_dir)
    return ca.pending_jobs(candidates, results, MIN_SAMPLES, MAX_SAMPLES, BATCH)


LEARN = BASE + """,
learn AS (
  SELECT c.root_id, c.id AS candidate_id, c.dimension, coalesce(hits / n, 0.0::DOUBLE) AS p,
         coalesce(n, 0) AS num_samples, coalesce(hits, 0) AS correct_samples
  FROM root_candidates c LEFT JOIN (
    SELECT candidate_id, count(*) AS n, CAST(sum(CASE WHEN correct THEN 1 ELSE 0 END) AS BIGINT) AS hits
    FROM help_results GROUP BY candidate_id) m ON c.id = m.candidate_id
)
"""


def _learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, results = _tables(spark, sf_dir)
    return ca.learnability(candidates, results, group_size=8)


@query("F33, C2", LEARN + """
SELECT root_id, candidate_id, dimension, round(p, 9) AS p_sub,
       round(1.0::DOUBLE - pow(p, 8) - pow(1.0::DOUBLE - p, 8), 9) AS contrast_score, num_samples, correct_samples
FROM learn""")
def learnability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_learn(spark, sf_dir))


@query("F33", LEARN + """
SELECT count(*) AS candidates, CAST(sum(num_samples) AS BIGINT) AS rollouts,
       count(*) FILTER (p > 0 AND p < 1) AS informative_candidates, round(avg(p), 9) AS mean_p_sub
FROM learn""")
def learnability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ca.learnability_summary(_learn(spark, sf_dir)))


@query("E10", "WITH " + ov.CANDIDATES + """,
firsts AS (
  SELECT support_tokens, arg_min(id, log_pos) AS id, min(log_pos) AS pos,
         arg_min(id, log_pos, 2)[2] AS second_id, min(log_pos, 2)[2] AS second_pos
  FROM candidates GROUP BY support_tokens
),
options AS (
  SELECT c.id, c.support_tokens, o.other_id, abs(o.support_tokens - c.support_tokens) AS gap, o.pos
  FROM candidates c JOIN (
    SELECT support_tokens, id AS other_id, pos FROM firsts
    UNION ALL SELECT support_tokens, second_id, second_pos FROM firsts WHERE second_id IS NOT NULL) o
  ON o.other_id <> c.id
)
SELECT id, support_tokens, arg_min(other_id, ROW(gap, pos)) AS control_id, min(gap) AS size_gap
FROM options GROUP BY id, support_tokens""")
def nearest_size_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.nearest_size_controls(bridge.candidates(spark, sf_dir))


def plan_sql(max_words: int = 12) -> str:
    step = ov.collapse("source_step")
    sub = ov.collapse("subproblem")
    text = f"coalesce(nullif({step}, ''), nullif({sub}, ''), '')"
    return f"trim(array_to_string(string_split({text}, ' ')[1:{max_words}], ' '), ' .')"


PLANS = "WITH " + ov.CANDIDATES + f""",
raw_plans AS (
  SELECT *, {plan_sql()} AS plan, {ov.alnum_key('subproblem_answer')} AS answer_key, {ov.alnum_key('reference')} AS secret
  FROM candidates
),
plans AS (
  SELECT *, {ov.alnum_key('plan')} AS plan_key,
         CASE WHEN (answer_key <> '' AND contains({ov.alnum_key('plan')}, answer_key))
                OR (secret <> '' AND contains({ov.alnum_key('plan')}, secret)) THEN '' ELSE plan END AS minimal_plan
  FROM raw_plans
)
"""


@query("B9-B11", PLANS + "SELECT id, minimal_plan FROM plans")
def minimal_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.plan_candidates(bridge.candidates(spark, sf_dir)).select("id", "minimal_plan")


@query("E11, H5", PLANS + f"""
, usable AS (SELECT * FROM plans WHERE minimal_plan <> ''),
roots AS (
  SELECT root_id, arg_min(secret, log_pos) AS secret,
         row_number() OVER (ORDER BY {ov.seeded(42, 'root_id')}, root_id) - 1 AS ring, count(*) OVER () AS n
  FROM usable GROUP BY root_id
),
options AS (SELECT u.id AS control_id, u.dimension AS other_dimension, u.plan_key, r.ring AS at FROM usable u JOIN roots r USING (root_id)),
targets AS (SELECT DISTINCT u.root_id, u.dimension, r.secret, r.ring, r.n FROM usable u JOIN roots r USING (root_id)),
found AS (
  SELECT t.root_id, t.dimension,
         arg_min(o.control_id, ROW((o.at - t.ring + t.n) % t.n, o.other_dimension <> t.dimension, o.control_id)) AS control_id,
         min((o.at - t.ring + t.n) % t.n) AS step
  FROM targets t JOIN options o ON o.at <> t.ring AND (t.secret = '' OR NOT contains(o.plan_key, t.secret))
  GROUP BY t.root_id, t.dimension
)
SELECT u.id, f.control_id, f.step FROM usable u LEFT JOIN found f ON u.root_id = f.root_id AND u.dimension = f.dimension""")
def ring_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = ad.usable_plans(bridge.candidates(spark, sf_dir))
    return co.ring_controls(plans, seed=42, require_all=False).select(
        "id", "control_id", F.col("step").cast("bigint").alias("step")
    )


SHARDED = "WITH " + ov.HELP_RESULTS + """,
sharded AS (
  SELECT CAST(CASE WHEN variant = 'random_plan' THEN 1 ELSE 0 END AS INTEGER) AS shard, root_id, log_pos FROM help_results
),
history AS (SELECT shard, root_id, count(*) AS records, min(log_pos) AS first_pos FROM sharded GROUP BY ALL)
"""


def _shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = bridge.help_results(spark, sf_dir)
    return log.select(
        F.when(F.col("variant") == "random_plan", 1).otherwise(0).alias("shard"), "root_id", "log_pos"
    )


@query("E13, H3", SHARDED + """
SELECT root_id, count(*) AS rows, count(DISTINCT shard) AS shards FROM history GROUP BY root_id HAVING count(*) > 1""")
def shard_merge_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sh.overlapping_roots(sh.root_history(_shards(spark, sf_dir)))


@query("F34", "WITH " + ov.HELP_RESULTS + """,
roots AS (SELECT root_id, max(log_pos) % 2 AS shard FROM help_results GROUP BY root_id)
SELECT CAST(sum(n) AS BIGINT) AS selected_roots, count(*) AS num_shards, (SELECT count(*) FROM roots) AS training_roots,
       round((SELECT count(*) FROM roots) / sum(n), 9) AS training_candidate_rate
FROM (SELECT shard, 2 * count(*) AS n FROM roots GROUP BY shard) s""")
def shard_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = (
        bridge.help_results(spark, sf_dir)
        .groupBy("root_id")
        .agg((F.max("log_pos") % 2).alias("shard"))
    )
    summaries = roots.groupBy("shard").agg((F.count(F.lit(1)) * 2).alias("selected_roots"))
    return rounded(sh.merge_summary(sh.merge_shards(roots), summaries))


RECOVER = SHARDED + f""",
owners AS (
  SELECT root_id, arg_max(shard, ROW(records, -first_pos, -shard)) AS shard_index,
         arg_max(first_pos, ROW(records, -first_pos, -shard)) AS first_pos
  FROM history GROUP BY root_id
),
eligible AS (SELECT CAST(c_custkey AS VARCHAR) AS root_id FROM customer),
quotas AS (SELECT count(*) * 2 // 5 AS q0, count(*) * 3 // 10 AS q1 FROM customer),
ranked AS (
  SELECT o.*, row_number() OVER (PARTITION BY shard_index ORDER BY first_pos) AS place
  FROM owners o SEMI JOIN eligible e ON o.root_id = e.root_id
),
recovered AS (
  SELECT root_id, shard_index, place - 1 AS position, true AS recovered
  FROM ranked CROSS JOIN quotas WHERE place <= CASE shard_index WHEN 0 THEN q0 ELSE q1 END
),
have AS (SELECT count(*) FILTER (shard_index = 0) AS a, count(*) FILTER (shard_index = 1) AS b FROM recovered),
pool AS (
  SELECT e.root_id, row_number() OVER (ORDER BY {ov.seeded(42, 'e.root_id')}, e.root_id) AS draw
  FROM eligible e ANTI JOIN recovered r ON e.root_id = r.root_id
),
manifest AS (
  SELECT * FROM recovered
  UNION ALL
  SELECT root_id, CASE WHEN draw <= q0 - a THEN 0 ELSE 1 END,
         CASE WHEN draw <= q0 - a THEN a + draw - 1 ELSE b + draw - (q0 - a) - 1 END, false
  FROM pool CROSS JOIN have CROSS JOIN quotas WHERE draw <= q0 - a + q1 - b
)
"""


def _eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = bridge.table(spark, sf_dir, "customer")
    return customers.select(F.col("c_custkey").cast("string").alias("root_id"))


def _quotas(eligible: DataFrame) -> tuple[int, int]:
    """Two fifths of the roots for the first shard, three tenths for the second."""
    n = eligible.count()
    return n * 2 // 5, n * 3 // 10


def _manifest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[int, int]]:
    history = sh.root_history(_shards(spark, sf_dir))
    eligible = _eligible(spark, sf_dir)
    quotas = _quotas(eligible)
    return sh.recover_manifests(eligible, history, quotas, seed=42), quotas


@query("F35", RECOVER + "SELECT root_id, CAST(shard_index AS INTEGER) AS shard_index, position, recovered FROM manifest")
def root_manifest_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(spark, sf_dir)[0]


CHECKED = """,
sizes AS (SELECT 0 AS s, q0 AS q FROM quotas UNION ALL SELECT 1, q1 FROM quotas)
"""


@query("F36", RECOVER + CHECKED + """
SELECT CAST(s AS INTEGER) AS shard_index, count(*) FILTER (shard_index = s) AS manifest_roots, CAST(q AS BIGINT) AS quota,
       count(*) FILTER (shard_index = s AND recovered) AS recovered_roots, count(*) FILTER (shard_index = s) = any_value(q) AS ok
FROM manifest CROSS JOIN sizes GROUP BY s, q""")
def root_manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sh.manifest_check(*_manifest(spark, sf_dir))


@query("F36, A14", RECOVER + CHECKED + """
SELECT CAST(s AS INTEGER) AS shard_index, count(*) FILTER (shard_index = s) AS manifest_roots, CAST(q AS BIGINT) AS quota,
       count(*) FILTER (shard_index = s AND CAST(root_id AS BIGINT) % 11 = 0) AS missing_roots,
       count(*) FILTER (shard_index = s) = q AND count(*) FILTER (shard_index = s AND CAST(root_id AS BIGINT) % 11 = 0) = 0 AS ok
FROM manifest CROSS JOIN sizes GROUP BY s, q""")
def root_manifest_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen manifests against the candidates of a later run, in which every eleventh root is gone."""
    frozen, quotas = _manifest(spark, sf_dir)
    later = _eligible(spark, sf_dir).filter(F.col("root_id").cast("bigint") % 11 != 0)
    return sh.reuse_manifests(frozen.select("root_id", "shard_index"), later, quotas)


@query("F36, H4", f"""
SELECT CAST(i AS INTEGER) AS shard_index, count(*) FILTER (rank <= n // 2 AND (rank - 1) % 3 = i) AS quota, count(*) FILTER (rank <= n // 2 AND (rank - 1) % 3 = i) AS roots
FROM (SELECT row_number() OVER (ORDER BY {ov.seeded(42, 'CAST(c_custkey AS VARCHAR)')}) AS rank, count(*) OVER () AS n FROM customer) r
CROSS JOIN (VALUES (0), (1), (2)) v(i) GROUP BY i""")
def shard_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas of half of the roots in three shards, beside what a round-robin deal gives them."""
    roots = _eligible(spark, sf_dir)
    half = roots.count() // 2
    quotas = F.array(*[F.lit(q).cast("bigint") for q in sh.shard_quotas(half, 3)])
    dealt = sh.round_robin(roots, num_shards=3, seed=42, root_limit=half).groupBy("shard_index").agg(F.count(F.lit(1)).alias("roots"))
    return dealt.select("shard_index", F.get(quotas, "shard_index").alias("quota"), "roots")


@query("H4", f"""
SELECT CAST(c_custkey AS VARCHAR) AS root_id, CAST((rank - 1) % 4 AS INTEGER) AS shard_index, (rank - 1) // 4 AS position
FROM (SELECT c_custkey, row_number() OVER (ORDER BY {ov.seeded(42, 'CAST(c_custkey AS VARCHAR)')}) AS rank FROM customer) r""")
def round_robin_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = bridge.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("root_id"))
    return sh.round_robin(roots, num_shards=4, seed=42)


@query("E2, F35", PLANS + f"""
SELECT root_id, min(log_pos) AS first_pos FROM plans
WHERE minimal_plan <> '' AND {ov.question_key('question')} IN (
  SELECT {ov.question_key('text')} FROM documents)
GROUP BY root_id""")
def eligible_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    problems = bridge.table(spark, sf_dir, "documents").select(F.col("text").alias("question"))
    return sh.eligible_roots(bridge.candidates(spark, sf_dir), problems)
