"""DuckDB text of the bridge tables, for use as common table expressions."""

ROLLOUTS = """
rollouts AS (
  SELECT CAST(o_custkey AS VARCHAR) AS id,
         concat('Problem ', CAST(o_custkey AS VARCHAR)) AS question,
         CAST(o_custkey % 10 AS VARCHAR) AS reference,
         o_orderpriority AS priority,
         CASE l_linenumber WHEN 1 THEN 'none' WHEN 2 THEN 'knowledge@25' WHEN 3 THEN 'knowledge@100'
              WHEN 4 THEN 'planning@25' WHEN 5 THEN 'planning@100' WHEN 6 THEN 'solution@25'
              ELSE 'solution@100' END AS arm_name,
         CASE WHEN l_linenumber = 1 THEN 'none' WHEN l_linenumber <= 3 THEN 'knowledge'
              WHEN l_linenumber <= 5 THEN 'planning' ELSE 'solution' END AS arm_kind,
         CASE WHEN l_linenumber = 1 THEN CAST(0.0 AS DOUBLE) WHEN l_linenumber IN (2, 4, 6)
              THEN CAST(0.25 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS arm_strength,
         l_linenumber - 1 AS arm_order,
         l_orderkey AS sample_index,
         l_returnflag = 'R' AS correct,
         CAST(20 + floor(l_quantity) AS BIGINT) AS input_tokens,
         CASE WHEN l_linenumber = 1 THEN CAST(0 AS BIGINT) ELSE CAST(floor(l_quantity) AS BIGINT) END AS hint_tokens,
         CAST(floor(l_extendedprice / 100) AS BIGINT) AS output_tokens,
         l_tax > 0.06 AS hit_max,
         l_discount AS latency_seconds,
         l_partkey * 100000000 + CAST(floor(l_extendedprice) AS BIGINT) AS log_pos
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""

HELP_RESULTS = """
help_results AS (
  SELECT root_id, CASE WHEN variant = 'no_help' THEN '' ELSE concat(root_id, '::', dimension) END AS candidate_id,
         dimension, variant, sample_index, correct, log_pos
  FROM (SELECT CAST(o_custkey AS VARCHAR) AS root_id,
               CASE l_orderkey % 3 WHEN 0 THEN 'knowledge' WHEN 1 THEN 'planning' ELSE 'calculation' END AS dimension,
               CASE l_returnflag WHEN 'N' THEN 'no_help' WHEN 'R' THEN 'relevant_plan' ELSE 'random_plan' END AS variant,
               (l_linenumber - 1) % 3 AS sample_index,
               l_linestatus = 'O' AS correct,
               l_orderkey * 8 + l_linenumber AS log_pos
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey) b
)"""

DIMENSION_ROWS = """
dims AS (
  SELECT 'knowledge' AS dimension, 1 AS pos UNION ALL SELECT 'planning', 2 UNION ALL SELECT 'calculation', 3
)"""

ROOT_CANDIDATES = (
    DIMENSION_ROWS
    + """,
root_candidates AS (
  SELECT concat(CAST(c_custkey AS VARCHAR), '::', dimension) AS id, CAST(c_custkey AS VARCHAR) AS root_id, dimension,
         concat('Problem ', CAST(c_custkey AS VARCHAR)) AS question,
         concat(dimension, ' ', c_mktsegment, ' ', c_name) AS subproblem,
         concat('use ', c_mktsegment, ' ', dimension) AS minimal_plan, pos
  FROM customer CROSS JOIN dims
)"""
)

VARIANTS = """
variants AS (
  SELECT CAST(user_id AS VARCHAR) AS id,
         CASE event_type WHEN 'view' THEN 'no_help' WHEN 'click' THEN 'random_bit'
              WHEN 'error' THEN 'self_asked_verification' WHEN 'purchase' THEN 'knowledge_min'
              WHEN 'signup' THEN 'planning_min' END AS variant,
         CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS BIGINT) AS sample_index,
         value > 40 AS correct,
         CASE WHEN event_type = 'view' THEN CAST(0 AS BIGINT)
              ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS external_information_tokens,
         CAST(floor(value) AS BIGINT) AS total_generated_tokens,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS props_tokens,
         event_id AS log_pos
  FROM events
)"""


def dealt(turn: str, text: str = "text") -> str:
    """Every third sentence, from the turn on."""
    return f"array_to_string(list_filter(string_split({text}, '.'), lambda x, i: (i - 1) % 3 = {turn}), '.')"


def dealt_parts(turn: int) -> str:
    return f"list_filter(string_split(text, '.'), lambda x, i: (i - 1) % 3 = {turn})"


CANDIDATES = (
    DIMENSION_ROWS
    + f""",
cut AS (
  SELECT *, {dealt('pos - 1')} AS subproblem, {dealt('pos % 3')} AS source_step FROM documents CROSS JOIN dims
),
candidates AS (
  SELECT concat(CAST(doc_id AS VARCHAR), '::', dimension) AS id, CAST(doc_id AS VARCHAR) AS root_id, dimension,
         source AS source_id, text AS question, split_part(text, ' ', -1) AS reference, subproblem,
         CASE WHEN doc_id % 4 = 1 THEN concat('\\boxed{{', split_part(subproblem, ' ', -1), '}}')
              ELSE split_part(subproblem, ' ', -1) END AS subproblem_answer,
         '' AS relation, source_step, CAST(length(subproblem) AS BIGINT) AS support_tokens,
         doc_id * 3 + pos AS log_pos, pos, doc_id
  FROM cut
)"""
)

PROBLEMS = f"""
problems AS (
  SELECT source AS id, text AS question, split_part(text, ' ', -1) AS ground_truth,
         CASE WHEN lang = 'en' THEN concat(source, '::verifiable_subproblem') ELSE source END AS data_source,
         {dealt_parts(0)} AS knowledge_parts, {dealt_parts(1)} AS planning_parts, list_value({dealt('2')}) AS solution_parts,
         CAST(1 - quality AS DOUBLE) AS accuracy, documents.doc_id AS log_pos
  FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id
)"""

# a third of the turns end with an action word; the others are whole texts as they are
CONVERSATION_ACTIONS = r"""
actions AS (
  SELECT conv_id, turn, nullif(regexp_extract(upper(CASE turn % 3 WHEN 0 THEN concat(text, ' -> planning') ELSE text END),
           '(?:^|[^\p{L}\p{N}_])(NONE|KNOWLEDGE|PLANNING|STEP)(?:[^\p{L}\p{N}_]|$)', 1), '') AS action
  FROM conversations
)"""

EVAL_SCORES = """
eval_scores AS (
  SELECT n_name AS dataset, o_orderpriority AS method,
         sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / count(*) AS score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey
  GROUP BY n_name, o_orderpriority
)"""

LOGPROBS = """
logprobs AS (
  SELECT CAST(vec_id AS VARCHAR) AS id, pos,
         CAST(embedding[pos] AS DOUBLE) AS target,
         CAST(embedding[pos] AS DOUBLE) + (label - 5) * CAST(0.03125 AS DOUBLE) AS behavior,
         CASE WHEN embedding[pos] > 0 THEN 1 ELSE 0 END AS mask,
         CAST(embedding[pos] AS DOUBLE) * 2 AS advantage,
         label % 2 = 1 AS off_context
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) e
)"""

# Python-style blanks for RE2, as a character class
BLANKS = r"[\s\x0b\x1c-\x1f\x85\pZ]"


def collapse(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{BLANKS}+', ' ', 'g'), ' ')"


def question_key(expr: str) -> str:
    return f"substr(sha1({collapse(expr)}), 1, 16)"


def answer_key(expr: str, greedy: bool = False) -> str:
    body = ".*" if greedy else ".*?"
    bare = rf"regexp_replace({expr}, '\\boxed\s*\{{({body})\}}', '\1', 'gs')"
    return rf"lower(regexp_replace({bare}, '[\s\x0b\x1c-\x1f\x85\pZ{{}}$]', '', 'g'))"


def alnum_key(expr: str) -> str:
    bare = rf"regexp_replace({expr}, '\\boxed\s*\{{(.*?)\}}', '\1', 'gs')"
    return f"regexp_replace(lower({bare}), '[^a-z0-9]+', '', 'g')"


def seeded(seed: int, *keys: str) -> str:
    return f"sha1(concat('{seed}|', " + ", '|', ".join(keys) + "))"
