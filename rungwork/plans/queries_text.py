"""Key, parsing, grading and prompt jobs over whole text tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwork.functions import prompts
from rungwork.functions import text as tx
from rungwork.operators import admission as ad
from rungwork.operators import grading as gr
from rungwork.operators import jobs as jb
from rungwork.operators import reports as rep
from rungwork.plans import oracle_views as ov
from rungwork.plans.queries_frontier import rounded
from rungwork.plans.registry import query
from rungwork.sources import bridge

STRIP = r"regexp_replace({x}, '^[\s\x0b\x1c-\x1f\x85\pZ]+|[\s\x0b\x1c-\x1f\x85\pZ]+$', '', 'g')"


def strip(expr: str) -> str:
    return STRIP.replace("{x}", expr)


def parts(expr: str) -> str:
    return f"list_filter({expr}, lambda p: regexp_matches(p, '[^\\s\\x0b\\x1c-\\x1f\\x85\\pZ]'))"


@query("B1-B3, B5, B6, B12, B13, B15, B16", "WITH " + ov.PROBLEMS + f"""
SELECT log_pos, {ov.question_key('question')} AS question_key, concat(id, '::', substr(sha1(question), 1, 12)) AS item_id,
       {strip('ground_truth')} AS reference,
       sha1(CASE WHEN {strip('question')} <> '' THEN {strip('question')} ELSE {strip('ground_truth')} END) AS solution_digest,
       round(coalesce(accuracy, 0.0), 9) AS source_accuracy,
       regexp_replace(data_source, '::verifiable_subproblem$', '') AS data_source,
       sha1(array_to_string({parts('planning_parts')}, chr(10))) AS plan_digest,
       CAST(len({parts('knowledge_parts')}) AS INTEGER) AS knowledge_count
FROM problems""")
def key_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = ad.key_problems(bridge.problems(spark, sf_dir))
    return rounded(
        keyed.select(
            "log_pos",
            "question_key",
            "item_id",
            "reference",
            F.sha1("reference_solution").alias("solution_digest"),
            "source_accuracy",
            "data_source",
            F.sha1(tx.parts_text("planning_skeleton_parts")).alias("plan_digest"),
            F.size("knowledge_components_parts").alias("knowledge_count"),
        )
    )


@query("B16", "WITH " + ov.PROBLEMS + """
SELECT count(*) AS rows, count(*) FILTER (data_source LIKE '%::verifiable_subproblem') AS normalized_rows,
       CAST(0 AS BIGINT) AS remaining_rows FROM problems""")
def data_source_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.data_source_report(bridge.problems(spark, sf_dir))


@query("B16", "WITH " + ov.PROBLEMS + """
SELECT regexp_replace(data_source, '::verifiable_subproblem$', '') AS data_source, count(*) AS rows FROM problems GROUP BY 1""")
def data_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.data_sources(bridge.problems(spark, sf_dir))


@query("H13", "WITH " + ov.PROBLEMS + f"""
SELECT log_pos, id, draw FROM (
  SELECT log_pos, id, row_number() OVER (ORDER BY {ov.seeded(42, 'CAST(log_pos AS VARCHAR)')}) AS draw, count(*) OVER () AS n
  FROM problems
  WHERE coalesce(accuracy, 0.0) <= 0.5 AND {strip('question')} <> '' AND {strip('ground_truth')} <> '') d
WHERE draw <= greatest(1, n // 4)""")
def eligible_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ad.eligible_problems(bridge.problems(spark, sf_dir), max_source_accuracy=0.5).select("log_pos", "id")
    return ad.seeded_sample(kept, ["log_pos"], limit=max(1, kept.count() // 4), seed=42)


@query("A2", "WITH " + ov.PROBLEMS + """
SELECT count(*) FILTER (coalesce(accuracy, 0.0) = 0) AS zero_reward_roots,
       3 * count(*) FILTER (coalesce(accuracy, 0.0) = 0) AS requested_candidates FROM problems""")
def zero_reward_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.count_if(F.coalesce("accuracy", F.lit(0.0)) == 0)
    return bridge.problems(spark, sf_dir).agg(
        zero.alias("zero_reward_roots"), (zero * 3).alias("requested_candidates")
    )


@query("B7-B9", "WITH " + ov.CANDIDATES + f""",
wrapped AS (SELECT id, concat('\\boxed {{', subproblem_answer, '}} $', source_step, '}}') AS a FROM candidates)
SELECT id, sha1({ov.answer_key('a')}) AS lazy_key, sha1({ov.answer_key('a', greedy=True)}) AS greedy_key,
       sha1({ov.alnum_key('a')}) AS alnum_key
FROM wrapped""")
def answer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = F.concat(F.lit("\\boxed {"), "subproblem_answer", F.lit("} $"), "source_step", F.lit("}"))
    rows = bridge.candidates(spark, sf_dir).select("id", wrapped.alias("a"))
    return rows.select(
        "id",
        F.sha1(tx.answer_key("a")).alias("lazy_key"),
        F.sha1(tx.answer_key_greedy("a")).alias("greedy_key"),
        F.sha1(tx.alnum_key("a")).alias("alnum_key"),
    )


@query("B27", "WITH " + ov.CANDIDATES + f"""
SELECT id, CASE WHEN {ov.answer_key('subproblem_answer')} = {ov.answer_key('reference')}
                THEN 'subproblem answer equals the original final answer'
                WHEN {ov.answer_key('subproblem')} = {ov.answer_key('reference')}
                THEN 'subproblem text equals the original final answer' END AS reject_reason
FROM candidates""")
def leakage_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.answer_leaks(bridge.candidates(spark, sf_dir)).select("id", "reject_reason")


# conversation turns read as generations: sentence ends open a wrapper, commas close it
WRAPPED = r"replace(replace(text, '. ', ' \boxed x{'), ',', '}')"


def _wrapped() -> Column:
    return F.replace(F.replace("text", F.lit(". "), F.lit(" \\boxed x{")), F.lit(","), F.lit("}"))


@query("B19", rf"""
WITH gen AS (SELECT conv_id, turn, {WRAPPED} AS t FROM conversations),
tokens AS (
  SELECT conv_id, turn, unnest(regexp_extract_all(t, '\\boxed|[{{}}]')) AS tok,
         unnest(range(1, len(regexp_extract_all(t, '\\boxed|[{{}}]')) + 1)) AS pos
  FROM gen
),
sums AS (
  SELECT *, sum(CASE tok WHEN '}}' THEN 1 WHEN '{{' THEN -1 ELSE 0 END)
              OVER (PARTITION BY conv_id, turn ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS s
  FROM tokens
),
clamped AS (
  SELECT *, s - least(0, min(s) OVER (PARTITION BY conv_id, turn ORDER BY pos DESC ROWS UNBOUNDED PRECEDING)) AS c
  FROM sums
),
opens AS (
  SELECT *, CASE WHEN tok = '{{' THEN coalesce(lag(c) OVER (PARTITION BY conv_id, turn ORDER BY pos DESC), 0) > 0 END AS closed
  FROM clamped
),
nexts AS (
  SELECT *, last_value(closed IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS next_closed
  FROM opens
),
verdicts AS (
  SELECT conv_id, turn, arg_max(next_closed IS NOT NULL, pos) AS last_opens, max(CASE WHEN next_closed THEN 1 ELSE 0 END) AS any_closed
  FROM nexts WHERE tok = '\boxed' GROUP BY conv_id, turn
)
SELECT g.conv_id, g.turn, coalesce(last_opens AND any_closed = 1, false) AS complete
FROM gen g LEFT JOIN verdicts v ON g.conv_id = v.conv_id AND g.turn = v.turn""")
def boxed_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = bridge.table(spark, sf_dir, "conversations").withColumn("t", _wrapped())
    return turns.select("conv_id", "turn", tx.boxed_complete("t").alias("complete"))


NUMBERS = """
WITH gen AS (
  SELECT event_id, event_type,
         CASE event_type
           WHEN 'view' THEN concat('so FINAL_ANSWER: $1,', CAST(100 + k AS VARCHAR), '.50')
           WHEN 'click' THEN concat('final_answer : ', CAST(k AS VARCHAR), ' / -', CAST(k % 7 AS VARCHAR))
           WHEN 'error' THEN concat('FINAL_ANSWER: 9', CHR(10), 'Final_Answer:', CAST(k AS VARCHAR), '.0')
           WHEN 'purchase' THEN concat('about ', CAST(k AS VARCHAR), ' apples')
           WHEN 'signup' THEN concat('FINAL_ANSWER: -', CAST(k AS VARCHAR), repeat('0', 40), '/3', repeat('0', 40))
           ELSE 'none' END AS t,
         CASE event_type
           WHEN 'view' THEN concat(CAST(2200 + 2 * k + 1 AS VARCHAR), '/2')
           WHEN 'click' THEN CAST(-k AS VARCHAR)
           WHEN 'error' THEN concat(CAST(k AS VARCHAR), '/1')
           WHEN 'purchase' THEN concat(CAST(k AS VARCHAR), '.', repeat('0', 25))
           WHEN 'signup' THEN concat(CAST(k AS VARCHAR), repeat('0', 40), CASE WHEN k % 2 = 0 THEN '0/-30' ELSE '1/-3' END, repeat('0', 40))
           ELSE '1' END AS reference, k
  FROM (SELECT event_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events) e
)
SELECT event_id, CASE event_type WHEN 'view' THEN true WHEN 'click' THEN k % 7 <> 0 AND (k = 0 OR k % 7 = 1)
                 WHEN 'error' THEN true WHEN 'purchase' THEN true WHEN 'signup' THEN k % 2 = 0 ELSE false END AS correct
FROM gen"""


@query("B17, B18", NUMBERS)
def numeric_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    kind, s, zeros = F.col("event_type"), k.cast("string"), F.repeat(F.lit("0"), F.lit(40))
    rows = bridge.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "view", F.concat(F.lit("so FINAL_ANSWER: $1,"), (k + 100).cast("string"), F.lit(".50")))
        .when(kind == "click", F.concat(F.lit("final_answer : "), s, F.lit(" / -"), (k % 7).cast("string")))
        .when(kind == "error", F.concat(F.lit("FINAL_ANSWER: 9\nFinal_Answer:"), s, F.lit(".0")))
        .when(kind == "purchase", F.concat(F.lit("about "), s, F.lit(" apples")))
        .when(kind == "signup", F.concat(F.lit("FINAL_ANSWER: -"), s, zeros, F.lit("/3"), zeros))
        .otherwise(F.lit("none"))
        .alias("text"),
        F.when(kind == "view", F.concat((k * 2 + 2201).cast("string"), F.lit("/2")))
        .when(kind == "click", (-k).cast("string"))
        .when(kind == "error", F.concat(s, F.lit("/1")))
        .when(kind == "purchase", F.concat(s, F.lit("."), F.repeat(F.lit("0"), F.lit(25))))
        .when(kind == "signup", F.concat(s, zeros, F.when(k % 2 == 0, F.lit("0/-30")).otherwise(F.lit("1/-3")), zeros))
        .otherwise(F.lit("1"))
        .alias("reference"),
    )
    return gr.grade_rollouts(rows).select("event_id", "correct")


# every whole turn rewritten as one of the reply styles a teacher may use
T0, T1, T2, LAST = ov.dealt("0"), ov.dealt("1"), ov.dealt("2"), "split_part(text, ' ', -1)"
REPLY = rf"""
replies AS (
  SELECT conv_id, turn, role, {LAST} AS reference, {T0} AS t0, {LAST} AS t9,
         CASE turn % 4
           WHEN 0 THEN concat('<State> ', {T0}, ' </state><SUBPROBLEM>', {T1}, ' </Subproblem> <answer>', {LAST}, '</answer> <verify>', {T2}, '</verify> yes')
           WHEN 1 THEN concat('Here: {{"question": ', to_json({T0}), ', "target": ', to_json({LAST}), '}} planning')
           WHEN 2 THEN concat('Question: ', replace({T0}, chr(10), ' '), chr(10), 'Answer: ', replace({LAST}, chr(10), ' '), chr(10), 'no')
           ELSE text END AS t
  FROM conversations
)"""


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    def as_json(value: Column) -> Column:
        return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)

    def one_line(value: Column) -> Column:
        return F.replace(value, F.lit("\n"), F.lit(" "))

    style = F.col("turn") % 4
    state, sub, verify = (bridge.dealt("text", k) for k in range(3))
    last = bridge.last_word("text")
    tagged = F.concat(
        F.lit("<State> "), state, F.lit(" </state><SUBPROBLEM>"), sub,
        F.lit(" </Subproblem> <answer>"), last, F.lit("</answer> <verify>"), verify, F.lit("</verify> yes"),
    )
    json = F.concat(F.lit('Here: {"question": '), as_json(state), F.lit(', "target": '), as_json(last), F.lit("} planning"))
    lines = F.concat(F.lit("Question: "), one_line(state), F.lit("\nAnswer: "), one_line(last), F.lit("\nno"))
    return bridge.table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        last.alias("reference"),
        F.when(style == 0, tagged).when(style == 1, json).when(style == 2, lines).otherwise(F.col("text")).alias("t"),
    )


@query("B20-B23", "WITH " + REPLY + f""",
found AS (
  SELECT *, CASE turn % 4 WHEN 0 THEN {ov.collapse("regexp_extract(t, '<subproblem>(.*?)</subproblem>', 1, 'is')")}
                 WHEN 1 THEN {ov.collapse("t0")} WHEN 2 THEN {ov.collapse("t0")} ELSE '' END AS q,
         CASE turn % 4 WHEN 0 THEN {ov.collapse("regexp_extract(t, '<answer>(.*?)</answer>', 1, 'is')")}
                 WHEN 1 THEN {ov.collapse("t9")} WHEN 2 THEN {ov.collapse("t9")} ELSE '' END AS a,
         {ov.collapse("regexp_extract(t, '<state>(.*?)</state>', 1, 'is')")} AS tentative_state,
         coalesce(nullif({ov.collapse("regexp_extract(t, '<verify>(.*?)</verify>', 1, 'is')")}, ''), '{tx.DEFAULT_VERIFICATION}') AS v
  FROM replies
)
SELECT conv_id, turn, CASE WHEN q <> '' AND a <> '' THEN q END AS subproblem,
       CASE WHEN q <> '' AND a <> '' THEN a END AS subproblem_answer, tentative_state,
       CASE WHEN ends_with(v, '?') THEN v ELSE concat(v, '?') END AS verification_question,
       CASE WHEN q <> '' AND a <> '' AND {ov.answer_key('a', greedy=True)} = {ov.answer_key('reference', greedy=True)}
              THEN 'subproblem_answer_equals_root_answer'
            WHEN NOT (q <> '' AND a <> '') THEN 'parse_failure' END AS reject_reason
FROM found""")
def parse_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = ad.screen_parsed(ad.parse_generations(_replies(spark, sf_dir), "t"))
    return parsed.select(
        "conv_id",
        "turn",
        "subproblem",
        "subproblem_answer",
        "tentative_state",
        "verification_question",
        "reject_reason",
    )


WORD = r"regexp_extract(upper({t}), '(?:^|[^\p{L}\p{N}_])({w})(?:[^\p{L}\p{N}_]|$)', 1)"


@query("B22, B23", "WITH " + REPLY + f"""
SELECT conv_id, turn, coalesce(nullif({WORD.replace('{t}', 't').replace('{w}', 'YES|NO|UNKNOWN')}, ''), 'UNKNOWN') AS oracle_answer,
       nullif({WORD.replace('{t}', 't').replace('{w}', 'NONE|KNOWLEDGE|PLANNING|STEP')}, '') AS action
FROM replies""")
def reply_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = ad.parse_generations(_replies(spark, sf_dir), "t")
    return parsed.select("conv_id", "turn", "oracle_answer", "action")


# structured responses built from whole documents; some break a rule
RESPONSE = f"""
responses AS (
  SELECT doc_id, split_part(text, ' ', -1) AS reference, {T0} AS k, {T1} AS p, {T2} AS c,
         concat(split_part({T0}, ' ', -1), CASE WHEN doc_id % 7 = 2 AND doc_id % 5 <> 0 THEN concat(chr(10), 'second') ELSE '' END) AS a, text
  FROM documents
)"""


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds by id: a missing dimension, no JSON, text behind the JSON, single quotes, a bare string; list answers.

    Some have white space around the object: of JSON (accepted) or another (refused).
    """
    k, p, c = (bridge.dealt("text", i) for i in range(3))

    def entry(sub: Column, answer: Column) -> Column:
        return F.struct(
            sub.alias("subproblem"),
            answer.alias("answer"),
            F.lit("r").alias("relation"),
            F.lit(" s ").alias("source_step"),
            F.col("text").alias("verification"),
        )

    def full(answer: Column) -> Column:
        entries = F.struct(entry(k, answer).alias("knowledge"), entry(p, answer).alias("planning"), entry(c, answer).alias("calculation"))
        return F.to_json(F.struct(entries.alias("candidates")))

    last = bridge.last_word(k)
    listed = full(F.array(last, F.lit(" "), F.lit("second")))
    partial = F.to_json(F.struct(F.struct(entry(k, last).alias("knowledge")).alias("candidates")))
    bare = F.to_json(F.struct(F.struct(k.alias("knowledge"), p.alias("planning"), c.alias("calculation")).alias("candidates")))
    kind = F.col("doc_id") % 20
    content = (
        F.when(kind % 5 == 0, partial)
        .when(kind == 1, F.lit("not json"))
        .when(kind == 6, F.concat(full(last), F.lit(" trailing")))
        .when(kind == 11, F.lit("{'candidates': {}}"))
        .when(kind == 16, bare)
        .when(F.col("doc_id") % 7 == 2, listed)
        .otherwise(full(last))
    )
    content = F.when(kind == 3, F.concat(F.lit("\n \t"), content, F.lit("\t\r\n"))).when(kind == 13, F.concat(content, F.lit("\x0b"))).otherwise(content)
    return bridge.table(spark, sf_dir, "documents").select("doc_id", bridge.last_word("text").alias("reference"), content.alias("content"))


@query("B26-B28", "WITH " + RESPONSE + f""",
clean AS (
  SELECT doc_id, reference, {strip('k')} AS k, {strip('p')} AS p, {strip('c')} AS c, {strip('a')} AS a, {strip('text')} AS v,
         doc_id % 20 IN (1, 6, 11, 13) AS no_json, doc_id % 20 = 16 AS bare, doc_id % 5 = 0 AS part FROM responses
),
judged AS (
  SELECT *, CASE
    WHEN no_json THEN 'response is not valid JSON'
    WHEN part THEN 'response is missing candidate dimensions: planning, calculation'
    WHEN bare THEN 'response is not a JSON object'
    ELSE coalesce(
      CASE WHEN k = '' OR a = '' THEN 'empty subproblem or answer' WHEN length(k) > 1200 THEN 'subproblem is too long'
           WHEN length(a) > 400 THEN 'answer is too long' WHEN length(v) > 2000 THEN 'verification is too long' END,
      CASE WHEN p = '' THEN 'empty subproblem or answer' WHEN length(p) > 1200 THEN 'subproblem is too long' END,
      CASE WHEN c = '' THEN 'empty subproblem or answer' WHEN length(c) > 1200 THEN 'subproblem is too long' END,
      CASE WHEN {ov.answer_key('a')} = {ov.answer_key('reference')} THEN 'subproblem answer equals the original final answer'
           WHEN {ov.answer_key('k')} = {ov.answer_key('reference')} OR {ov.answer_key('p')} = {ov.answer_key('reference')}
             OR {ov.answer_key('c')} = {ov.answer_key('reference')} THEN 'subproblem text equals the original final answer' END)
    END AS reject_reason
  FROM clean
)
SELECT doc_id, d.dimension, CASE WHEN no_json OR bare OR (part AND d.dimension <> 'knowledge') THEN '' ELSE
         CASE d.dimension WHEN 'knowledge' THEN k WHEN 'planning' THEN p ELSE c END END AS subproblem,
       CASE WHEN no_json OR bare OR (part AND d.dimension <> 'knowledge') THEN '' ELSE a END AS answer,
       reject_reason, coalesce(reject_reason LIKE '%equals the original final answer', false) AS terminal
FROM judged CROSS JOIN (VALUES ('knowledge'), ('planning'), ('calculation')) d(dimension)""")
def admit_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    admitted = ad.admit_candidates(_responses(spark, sf_dir))
    return admitted.select("doc_id", "dimension", "subproblem", F.col("subproblem_answer").alias("answer"), "reject_reason", "terminal")


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate failures of documents, logged as error rows."""
    leaks = ad.answer_leaks(bridge.candidates(spark, sf_dir))
    text = F.concat(F.lit("ValueError: "), "reject_reason")
    return leaks.filter(F.col("reject_reason").isNotNull()).select(
        F.col("root_id").alias("id"), text.alias("error"), F.lit(None).cast("boolean").alias("terminal")
    )


LEAKS = ov.CANDIDATES + f""",
leaks AS (
  SELECT * FROM candidates WHERE {ov.answer_key('subproblem_answer')} = {ov.answer_key('reference')}
     OR {ov.answer_key('subproblem')} = {ov.answer_key('reference')}
),
done AS (SELECT id FROM candidates WHERE length(subproblem) > 800)
"""


@query("E3, E4, B28, H11", "WITH " + LEAKS + """
SELECT c.id, c.root_id, c.dimension FROM candidates c
WHERE c.id NOT IN (SELECT id FROM done) AND c.root_id NOT IN (SELECT root_id FROM leaks)""")
def open_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = bridge.candidates(spark, sf_dir)
    roots = bridge.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("root_id"))
    done = candidates.filter(F.length("subproblem") > 800).select("id")
    return ad.open_requests(roots, done, _errors(spark, sf_dir)).select("id", "root_id", "dimension")


RUN = LEAKS.rstrip() + """,
chosen AS (SELECT CAST(doc_id AS VARCHAR) AS root_id FROM documents WHERE doc_id % 10 <> 0),
logged AS (SELECT id, log_pos % 2 = 0 AS now FROM candidates WHERE length(subproblem) > 800),
failed AS (SELECT root_id, CAST(root_id AS BIGINT) % 2 = 1 AS now FROM leaks),
per_root AS (
  SELECT c.root_id, count(*) FILTER (l.id IS NULL) AS missing, bool_or(s.root_id IS NOT NULL) AS stopped
  FROM chosen r JOIN candidates c ON c.root_id = r.root_id LEFT JOIN (SELECT id FROM logged WHERE NOT now) l ON l.id = c.id
       LEFT JOIN (SELECT DISTINCT root_id FROM failed WHERE NOT now) s ON s.root_id = c.root_id
  GROUP BY c.root_id
)
"""


@query("F44", "WITH " + RUN + """
SELECT (SELECT count(*) FROM documents) AS eligible_rows, (SELECT count(*) FROM chosen) AS selected_rows,
       3 * (SELECT count(*) FROM chosen) AS requested_candidates, (SELECT count(*) FROM logged WHERE NOT now) AS completed_before_run,
       (SELECT count(*) FROM logged WHERE now) AS success_this_run,
       CAST(sum(CASE WHEN missing = 0 THEN 3 WHEN stopped THEN missing ELSE 0 END) AS BIGINT) AS skipped_this_run,
       (SELECT count(*) FROM logged) AS total_output_rows, (SELECT count(*) FROM failed WHERE now) AS failed_roots_this_run,
       (SELECT count(DISTINCT root_id) FROM failed) AS terminal_roots
FROM per_root""")
def generation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = bridge.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("root_id"), (F.col("doc_id") % 10 != 0).alias("selected"))
    admitted = bridge.candidates(spark, sf_dir).filter(F.length("subproblem") > 800).select("id", (F.col("log_pos") % 2 == 0).alias("this_run"))
    errors = _errors(spark, sf_dir).withColumn("this_run", F.col("id").cast("bigint") % 2 == 1)
    return ad.generation_summary(roots, admitted, errors)


@query("F24", "WITH " + REPLY + f""",
found AS (
  SELECT *, CASE turn % 4 WHEN 0 THEN {ov.collapse("regexp_extract(t, '<subproblem>(.*?)</subproblem>', 1, 'is')")} WHEN 3 THEN '' ELSE {ov.collapse("t0")} END AS q,
         CASE turn % 4 WHEN 0 THEN {ov.collapse("regexp_extract(t, '<answer>(.*?)</answer>', 1, 'is')")} WHEN 3 THEN '' ELSE {ov.collapse("t9")} END AS a
  FROM replies
),
judged AS (SELECT q <> '' AND a <> '' AND {ov.answer_key('a', greedy=True)} <> {ov.answer_key('reference', greedy=True)} AS valid FROM found)
SELECT count(*) AS selected_questions, count(*) FILTER (valid) AS valid_candidates, round(count(*) FILTER (valid) / count(*), 9) AS valid_candidate_rate FROM judged""")
def valid_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ad.valid_rate(ad.screen_parsed(ad.parse_generations(_replies(spark, sf_dir), "t"))))


@query("F44, B28", "WITH " + LEAKS + "SELECT 'ValueError' AS reason, count(*) AS roots FROM leaks")
def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.failure_reasons(_errors(spark, sf_dir))


@query("F44", "SELECT field, CAST(sum(amount) AS BIGINT) AS total FROM (SELECT 'prompt_tokens' AS field, n_chars AS amount FROM documents UNION ALL SELECT 'total_tokens', n_chars + length(lang) FROM documents) u GROUP BY field")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bridge.table(spark, sf_dir, "documents")
    usage = F.create_map(
        F.lit("prompt_tokens"), F.col("n_chars"), F.lit("total_tokens"), F.col("n_chars") + F.length("lang")
    )
    rows = docs.select(
        F.col("doc_id").cast("string").alias("root_id"),
        usage.alias("usage"),
        F.explode(F.sequence(F.lit(1), F.lit(3))).alias("log_pos"),
    )
    return ad.usage_totals(rows)


LATTICE = "WITH " + ov.PROBLEMS + f""",
clean AS (
  SELECT log_pos, id, question, ground_truth, {parts('knowledge_parts')} AS k, {parts('planning_parts')} AS p, {parts('solution_parts')} AS s
  FROM problems
),
kinds AS (
  SELECT log_pos, id, question, 1 AS kind_order, 'knowledge' AS kind, k AS parts FROM clean
  UNION ALL SELECT log_pos, id, question, 2, 'planning', p FROM clean
  UNION ALL SELECT log_pos, id, question, 3, 'solution', s FROM clean
),
arms AS (
  SELECT log_pos, id, question, 0 AS kind_order, 'none' AS arm_name, 'none' AS arm_kind, 0.0::DOUBLE AS arm_strength,
         0 AS selected_parts, 0 AS total_parts, '' AS hint FROM clean
  UNION ALL
  SELECT log_pos, id, question, kind_order, concat(kind, '@', label), kind, strength, least(len(parts), greatest(1, ceil(len(parts) * strength))),
         len(parts),
         array_to_string(list_transform(parts[1:CAST(least(len(parts), greatest(1, ceil(len(parts) * strength))) AS BIGINT)], lambda x, i: concat(i, '. ', x)), chr(10))
  FROM kinds CROSS JOIN (VALUES (0.25::DOUBLE, '25'), (0.5::DOUBLE, '50'), (1.0::DOUBLE, '100')) v(strength, label)
  WHERE len(parts) > 0
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY log_pos ORDER BY kind_order, arm_strength) - 1 AS arm_order FROM arms
)
"""


@query("D1, B25", LATTICE + """
SELECT log_pos, arm_name, arm_kind, arm_strength, CAST(arm_order AS INTEGER) AS arm_order,
       CAST(selected_parts AS INTEGER) AS selected_parts, CAST(total_parts AS INTEGER) AS total_parts, sha1(hint) AS hint_digest
FROM numbered""")
def arm_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = jb.arm_lattice(bridge.problems(spark, sf_dir), [0.25, 0.5, 1.0])
    return arms.select(
        "log_pos",
        "arm_name",
        "arm_kind",
        "arm_strength",
        "arm_order",
        "selected_parts",
        "total_parts",
        F.sha1("hint").alias("hint_digest"),
    )


@query("D2, E3, B30", LATTICE + f"""
SELECT concat(id, '::', substr(sha1(question), 1, 12)) AS id, arm_name, CAST(i AS INTEGER) AS sample_index, count(*) AS jobs,
       min({ov.seeded(42, "concat(id, '::', substr(sha1(question), 1, 12))", 'arm_name', 'CAST(i AS VARCHAR)')}) AS job_order,
       min(sha1(CASE WHEN arm_kind = 'none' THEN question ELSE concat(question, chr(10), chr(10), 'Optional ', arm_kind, ' scaffold (',
           CAST(CAST(round_even(arm_strength * 100, 0) AS INTEGER) AS VARCHAR), '%):', chr(10), hint, chr(10), chr(10),
           'Use the scaffold only as guidance and complete the reasoning yourself.') END)) AS prompt_digest
FROM numbered CROSS JOIN (VALUES (0), (1)) v(i)
WHERE NOT (arm_name = 'none' AND i = 0)
GROUP BY 1, 2, 3""")
def job_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = ad.key_problems(bridge.problems(spark, sf_dir))
    done = keyed.select(F.col("item_id").alias("id"), F.lit("none").alias("arm_name"), F.lit(0).alias("sample_index"))
    left = jb.build_job_table(keyed, [0.25, 0.5, 1.0], samples_per_arm=2, seed=42, done=done)
    # the grouping sorts its rows, so they carry the prompt's digest instead of the prompt
    digests = left.select("id", "arm_name", "sample_index", "job_order", F.sha1("prompt_text").alias("prompt_digest"))
    return digests.groupBy("id", "arm_name", "sample_index").agg(
        F.count(F.lit(1)).alias("jobs"), F.min("job_order").alias("job_order"), F.min("prompt_digest").alias("prompt_digest")
    )


@query("B30, B31", "WITH " + ov.PROBLEMS + f""",
hinted AS (SELECT log_pos, question, coalesce({parts('knowledge_parts')}[1], '') AS h,
                  CASE log_pos % 2 WHEN 0 THEN 'KNOWLEDGE' ELSE 'NONE' END AS action FROM problems)
SELECT log_pos, action, sha1(CASE WHEN action = 'KNOWLEDGE' AND h <> ''
         THEN concat('Problem: ', question, chr(10), chr(10), 'Minimal Knowledge assistance: ', h, chr(10), 'Use it only as guidance.')
         ELSE concat('Problem: ', question) END) AS prompt_digest
FROM hinted""")
def action_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("log_pos") % 2 == 0, "KNOWLEDGE").otherwise("NONE")
    rows = bridge.problems(spark, sf_dir).withColumn("action", action)
    rows = rows.withColumn("hint", prompts.first_part("action", tx.ACTION_COLUMNS))
    return rows.select("log_pos", "action", F.sha1(prompts.action_prompt("action", "hint")).alias("prompt_digest"))


def _filled(template: str, **slots: str) -> str:
    """A template with SQL in its slots, as one SQL expression."""
    pieces = re.split(r"\{(\w+)\}", template)
    return "concat(" + ", ".join(f"({slots[p] if i % 2 else _quoted(p)})" for i, p in enumerate(pieces)) + ")"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


STATE = ov.collapse("regexp_extract(t, '<state>(.*?)</state>', 1, 'is')")
VERIFY = ov.collapse("regexp_extract(t, '<verify>(.*?)</verify>', 1, 'is')")
ASKED = f"coalesce(nullif({VERIFY}, ''), '{tx.DEFAULT_VERIFICATION}')"
BIT = "CASE WHEN correct THEN 'YES' ELSE 'NO' END"
RETRY = _filled(prompts.TEMPLATES["retry"], question="question", previous="t", oracle_answer=BIT)
SHORT_RETRY = _filled(prompts.TEMPLATES["retry"], question="question", previous="right(t, 40)", oracle_answer=BIT)
GO_ON = _filled(
    prompts.TEMPLATES["continuation"], question="question", state="coalesce(nullif(state, ''), '(not provided)')",
    verification_question="verification_question", oracle_answer="oracle_answer",
)


@query("B30", "WITH " + REPLY + f""",
asked AS (
  SELECT conv_id, turn, concat('Q', CAST(conv_id AS VARCHAR)) AS question, t, turn % 2 = 0 AS correct, {STATE} AS state,
         CASE WHEN {ASKED} LIKE '%?' THEN {ASKED} ELSE concat({ASKED}, '?') END AS verification_question,
         coalesce(nullif({WORD.replace('{t}', 't').replace('{w}', 'YES|NO|UNKNOWN')}, ''), 'UNKNOWN') AS oracle_answer
  FROM replies
)
SELECT conv_id, turn, sha1({RETRY}) AS retry, sha1({SHORT_RETRY}) AS short_retry, sha1({GO_ON}) AS continuation FROM asked""")
def second_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is asked after a reply: to try again, or to go on from its own state."""
    parsed = ad.parse_generations(_replies(spark, sf_dir), "t")
    rows = parsed.withColumns({"question": F.concat(F.lit("Q"), F.col("conv_id").cast("string")), "correct": F.col("turn") % 2 == 0})
    return rows.select(
        "conv_id",
        "turn",
        F.sha1(prompts.retry_prompt("t", "correct")).alias("retry"),
        F.sha1(prompts.retry_prompt("t", "correct", tail=40)).alias("short_retry"),
        F.sha1(prompts.continuation_prompt()).alias("continuation"),
    )


LABELS = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in prompts.HINT_LABELS.items()) + " ELSE 'Hints' END"
KINDS = "CASE log_pos % 5 WHEN 0 THEN NULL " + " ".join(f"WHEN {i + 1} THEN '{k}'" for i, k in enumerate(prompts.HINT_LABELS)) + " ELSE 'other' END"
PLANNED = _filled(prompts.TEMPLATES["plan"], question="question", plan="plan")
BARE_FORM = _filled(prompts.TEMPLATES["curriculum"], question="question")
HINTED_FORM = _filled(prompts.TEMPLATES["curriculum_hint"], question="question", hint_label=LABELS, hint="array_to_string(planning_parts, ' ')")


@query("B30", "WITH " + ov.PROBLEMS + f""",
hinted AS (
  SELECT log_pos, question, planning_parts, {KINDS} AS kind, CASE WHEN log_pos % 3 = 0 THEN '' ELSE coalesce(planning_parts[1], '') END AS plan FROM problems
)
SELECT log_pos, sha1(CASE WHEN plan = '' THEN question ELSE {PLANNED} END) AS plan_prompt,
       sha1(CASE WHEN kind IS NULL OR len(planning_parts) = 0 THEN {BARE_FORM} ELSE {HINTED_FORM} END) AS curriculum_prompt
FROM hinted""")
def hinted_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with a plan, and with the labelled hints of a curriculum."""
    at = F.col("log_pos") % 5
    kind = F.lit(None).cast("string")
    for i, name in enumerate(prompts.HINT_LABELS):
        kind = F.when(at == i + 1, F.lit(name)).otherwise(kind)
    kind = F.when((at == 0) | kind.isNotNull(), kind).otherwise(F.lit("other"))
    plan = F.when(F.col("log_pos") % 3 == 0, F.lit("")).otherwise(F.get("planning_skeleton_parts", F.lit(0)))
    rows = bridge.problems(spark, sf_dir).withColumns({"kind": kind, "plan": plan})
    return rows.select(
        "log_pos",
        F.sha1(prompts.plan_prompt("question", "plan")).alias("plan_prompt"),
        F.sha1(prompts.curriculum_prompt("kind", "planning_skeleton_parts")).alias("curriculum_prompt"),
    )


RULES_TEXT = _quoted("\n".join(f'- "{d}": {prompts.DIMENSION_GUIDANCE[d]}' for d in tx.DIMENSIONS))
ENTRY = ", ".join(f'"{f}": "..."' for f in ("subproblem", "answer", "relation", "source_step", "verification"))
SHAPE_TEXT = _quoted('{\n  "candidates": {\n' + ",\n".join(f'    "{d}": {{{ENTRY}}}' for d in tx.DIMENSIONS) + "\n  }\n}")
REQUEST = _filled(
    prompts.TEACHER, rules=RULES_TEXT, shape=SHAPE_TEXT, question=strip("question"), reference="ground_truth",
    knowledge=f"array_to_string({parts('knowledge_parts')}, chr(10))", planning=f"array_to_string({parts('planning_parts')}, chr(10))",
    breakdown=f"left(array_to_string({parts('solution_parts')}, chr(10)), 200)", solution="question",
)


@query("B30, B4", "WITH " + ov.PROBLEMS + f"SELECT log_pos, sha1({REQUEST}) AS digest FROM problems")
def teacher_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole requests to a teacher; one field is cut as a short context asks for."""
    rows = bridge.problems(spark, sf_dir).withColumns({"reference": F.col("reward_model.ground_truth"), "reference_solution": F.col("question")})
    return rows.select("log_pos", F.sha1(prompts.teacher_prompt(limits={"breakdown": 200})).alias("digest"))


@query("A15", "WITH " + ov.PROBLEMS + """
SELECT 'column question' AS "check", 'present' AS expected, 'present' AS actual, true AS ok
UNION ALL SELECT 'column reward_model', 'present', 'present', true
UNION ALL SELECT 'column uid', 'present', 'missing', false
UNION ALL SELECT 'rows', 'any', CAST(count(*) AS VARCHAR), true FROM problems""")
def contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rep.contract_check(bridge.problems(spark, sf_dir), ["question", "reward_model", "uid"])


# what each slot of a template is filled with, as SQL over the candidates
SLOTS = {
    "question": "question",
    "kind": "dimension",
    "hint": "source_step",
    "plan": "source_step",
    "bit": "CASE WHEN support_tokens % 2 = 0 THEN 'YES' ELSE 'NO' END",
    "subproblem": "subproblem",
    "subproblem_answer": "subproblem_answer",
    "reference_solution": "question",
    "verification_question": "subproblem",
}


def _rendered(template: str) -> str:
    pieces = re.split(r"\{(\w+)\}", template)
    quoted = ["'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" if i % 2 == 0 else SLOTS[p] for i, p in enumerate(pieces)]
    return "concat(" + ", ".join(q if i % 2 else f"({q})" for i, q in enumerate(quoted)) + ")"


FORMS = {n: t for n, t in prompts.TEMPLATES.items() if set(re.findall(r"\{(\w+)\}", t)) <= set(SLOTS)}
SYSTEM = prompts.SYSTEM.replace("'", "''")


@query("B30", "WITH " + ov.CANDIDATES + " " + " UNION ALL ".join(
    f"SELECT id, '{n}' AS form, sha1(concat('{SYSTEM}', chr(10), {_rendered(t)})) AS digest FROM candidates" for n, t in sorted(FORMS.items())))
def prompt_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prompt form of every candidate, with the system message before it."""
    values = {name: F.expr(text) for name, text in SLOTS.items()}
    forms = bridge.candidates(spark, sf_dir).select("id", F.inline(prompts.every_form(values)).alias("form", "prompt"))
    chat = forms.select("id", "form", prompts.chat("prompt").alias("messages"))
    return chat.select("id", "form", F.sha1(F.array_join(F.transform("messages", lambda m: m["content"]), "\n")).alias("digest"))
