"""String, hash and JSON column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: patterns, labels and limits of the data formats -------------------
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]+"
NONBLANK = r"[^\s\x1c-\x1f\x85\p{Z}]"
EDGE_BLANK = r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$"
BOXED_LAZY = r"(?s)\\boxed\s*\{(.*?)\}"
BOXED_GREEDY = r"(?s)\\boxed\s*\{(.*)\}"
ANSWER_NOISE = r"[\s\x1c-\x1f\x85\p{Z}{}$]"
SCAFFOLD_NAME = r"^([A-Za-z_]+)@([0-9]+(?:\.[0-9]+)?)$"
FINAL_ANSWER = r"(?i)FINAL_ANSWER\s*:\s*([^\r\n]+)"
FRACTION = r"([-+]?\d+)\s*/\s*([-+]?\d+)"
DECIMAL = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)"
LEGACY_SOURCE_SUFFIX = "::verifiable_subproblem"
DEFAULT_VERIFICATION = "Is the most uncertain intermediate assumption valid?"
DIMENSIONS = ("knowledge", "planning", "calculation")
HINT_COLUMNS = {
    "knowledge": "knowledge_components_parts",
    "planning": "planning_skeleton_parts",
    "solution": "solution_breakdown_parts",
}
HINT_LEVELS = {"knowledge": 1, "planning": 5, "solution": 9}
ACTION_COLUMNS = {
    "KNOWLEDGE": "knowledge_components_parts",
    "PLANNING": "planning_skeleton_parts",
    "STEP": "solution_breakdown_parts",
}
ACTIONS = ("NONE", "KNOWLEDGE", "PLANNING", "STEP")
MAX_SUBPROBLEM_CHARS = 1200
MAX_ANSWER_CHARS = 400
MAX_VERIFICATION_CHARS = 2000
JSON_SPACE = " \t\r\n"
LEAK_BY_ANSWER = "subproblem answer equals the original final answer"
LEAK_BY_TEXT = "subproblem text equals the original final answer"
# -------------------------------------------------------------------------------------


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Blanks removed at both ends; long texts are only searched when an end is blank."""
    value = col(value)
    ends = F.concat(F.left(value, F.lit(1)), F.right(value, F.lit(1)))
    return F.when(F.rlike(ends, F.lit(BLANK)), F.regexp_replace(value, EDGE_BLANK, "")).otherwise(value)


def collapse(value: Column | str) -> Column:
    """Every run of blanks becomes one space; none remain at the ends."""
    return F.trim(F.regexp_replace(col(value), BLANK, " "))


def head_words(value: Column | str, count: int) -> Column:
    """The first ``count`` words with one space between them; the text behind them is not read."""
    first = BLANK[:-1] + "*+((?:" + NONBLANK + "++" + BLANK + "+){0," + str(max(count - 1, 0)) + "}+" + NONBLANK + "*+)"
    return collapse(F.regexp_extract(col(value), "^" + first, 1))


def has_text(value: Column | str) -> Column:
    return F.coalesce(F.rlike(col(value), F.lit(NONBLANK)), F.lit(False))


def question_key(question: Column | str) -> Column:
    """Never null, so joins on it add no null filter that would compute it twice."""
    return F.substring(F.sha1(collapse(F.coalesce(col(question), F.lit("")))), 1, 16)


def item_id(source_id: Column | str, question: Column | str) -> Column:
    """Source ids are reused, so the raw question's hash is part of the id."""
    return F.concat_ws(
        "::", col(source_id).cast("string"), F.substring(F.sha1(col(question)), 1, 12)
    )


def candidate_id(root_id: Column | str, dimension: Column | str) -> Column:
    return F.concat_ws("::", col(root_id), col(dimension))


def clean_parts(parts: Column | str) -> Column:
    """Hint parts with null lists as empty and blank entries removed."""
    empty = F.array().cast("array<string>")
    return F.filter(F.coalesce(col(parts), empty), has_text)


def parts_of_text(value: Column | str, keep_blank: bool = True) -> Column:
    """A bare string as a one-part list; a null as an empty list."""
    value = col(value)
    usable = value.isNotNull() if keep_blank else has_text(value)
    return F.when(usable, F.array(value)).otherwise(F.array().cast("array<string>"))


def parts_text(parts: Column | str) -> Column:
    return F.array_join(clean_parts(parts), "\n")


def answer_key(value: Column | str) -> Column:
    """Answer comparison key; each boxed wrapper ends at its first closing brace."""
    bare = F.regexp_replace(col(value), BOXED_LAZY, "$1")
    return F.lower(F.regexp_replace(bare, ANSWER_NOISE, ""))


def answer_key_greedy(value: Column | str) -> Column:
    """As :func:`answer_key`, but the wrapper reaches to the last closing brace."""
    bare = F.regexp_replace(col(value), BOXED_GREEDY, "$1")
    return F.lower(F.regexp_replace(bare, ANSWER_NOISE, ""))


def alnum_key(value: Column | str) -> Column:
    """Lower-case ASCII letters and digits only, boxed wrappers removed."""
    bare = F.regexp_replace(col(value), BOXED_LAZY, "$1")
    return F.regexp_replace(F.lower(bare), "[^a-z0-9]+", "")


def words(value: Column | str) -> Column:
    return F.filter(F.split(collapse(value), " "), lambda w: w != "")


def minimal_plan(
    source_step: Column | str,
    relation: Column | str,
    subproblem: Column | str,
    subproblem_answer: Column | str,
    reference: Column | str,
    max_words: int,
) -> Column:
    """First words of the first filled field; '' when they would give an answer away."""
    filled = F.coalesce(
        *[
            F.nullif(head_words(F.coalesce(col(c), F.lit("")), max_words), F.lit(""))
            for c in (source_step, relation, subproblem)
        ],
        F.lit(""),
    )
    plan = F.btrim(F.array_join(F.slice(words(filled), 1, max_words), " "), F.lit(" ."))
    secrets = [alnum_key(F.coalesce(col(c), F.lit(""))) for c in (subproblem_answer, reference)]

    def guarded(plan: Column, plan_key: Column) -> Column:
        leaks = [(secret != "") & F.contains(plan_key, secret) for secret in secrets]
        return F.when(leaks[0] | leaks[1], F.lit("")).otherwise(plan)

    # one-element arrays bind the plan and its key, so each is computed once
    return F.get(
        F.transform(
            F.array(plan),
            lambda p: F.get(F.transform(F.array(alnum_key(p)), lambda k: guarded(p, k)), F.lit(0)),
        ),
        F.lit(0),
    )


def reference_solution(reference: Column | str, *fields: Column | str, stripped: bool) -> Column:
    """First non-blank of ``fields``, else the reference answer."""
    picks = [F.when(has_text(f), strip(f) if stripped else col(f)) for f in fields]
    return F.coalesce(*picks, col(reference))


def ground_truth(reward_model: Column | str) -> Column:
    return F.coalesce(strip(col(reward_model).getField("ground_truth")), F.lit(""))


def unboxed(value: Column | str) -> Column:
    """Inner text if the stripped value is exactly one ``\\boxed{...}`` wrapper."""
    bare = strip(value)
    inner = F.regexp_extract(bare, r"(?s)^\\boxed\{(.*)\}$", 1)
    return F.when(F.rlike(bare, F.lit(r"(?s)^\\boxed\{.*\}$")), inner).otherwise(bare)


def source_accuracy(value: Column | str) -> Column:
    return F.coalesce(col(value).try_cast("double"), F.lit(0.0))


def normal_data_source(value: Column | str) -> Column:
    return F.regexp_replace(col(value), LEGACY_SOURCE_SUFFIX + "$", "")


def boxed_complete(text: Column | str) -> Column:
    """True if some ``\\boxed`` wrapper closes; false if the last one never opens.

    Braces are matched once from the right over the few relevant tokens, so the
    cost is linear in the text however many wrappers it holds.
    """
    tokens = F.regexp_extract_all(col(text), F.lit(r"(\\boxed|[{}])"), F.lit(1))
    start = F.struct(
        F.lit(0).alias("closers"),
        F.lit("missing").alias("next_open"),
        F.lit(None).cast("boolean").alias("verdict"),
    )

    def step(acc: Column, token: Column) -> Column:
        closers, next_open, verdict = acc["closers"], acc["next_open"], acc["verdict"]
        return F.struct(
            F.when(token == "}", closers + 1)
            .when((token == "{") & (closers > 0), closers - 1)
            .otherwise(closers)
            .alias("closers"),
            F.when((token == "{") & (closers > 0), F.lit("closed"))
            .when(token == "{", F.lit("dangling"))
            .otherwise(next_open)
            .alias("next_open"),
            F.when(verdict.isNotNull() | token.isin("{", "}"), verdict)
            .when(next_open == "missing", F.lit(False))
            .when(next_open == "closed", F.lit(True))
            .alias("verdict"),
        )

    return F.aggregate(
        F.reverse(tokens), start, step, lambda acc: F.coalesce(acc["verdict"], F.lit(False))
    )


def exact_number(text: Column | str) -> Column:
    """Last labelled answer (else the whole text) as digit strings ``num`` / ``den``.

    ``den`` is a power of ten for decimals; null when there is no number or the
    denominator is zero. Digit strings keep any length exact.
    """
    labelled = F.regexp_extract_all(col(text), F.lit(FINAL_ANSWER), F.lit(1))
    spoken = F.coalesce(F.try_element_at(labelled, F.lit(-1)), col(text))

    def read(cleaned: Column) -> Column:
        top = F.regexp_extract(cleaned, FRACTION, 1)
        bottom = F.regexp_extract(cleaned, FRACTION, 2)
        number = F.regexp_extract(cleaned, DECIMAL, 0)
        tail = F.regexp_extract(number, r"\.(\d*)", 1)
        as_fraction = F.struct(top.alias("num"), bottom.alias("den"))
        as_decimal = F.struct(
            F.replace(number, F.lit("."), F.lit("")).alias("num"),
            F.rpad(F.lit("1"), F.length(tail) + 1, F.lit("0")).alias("den"),
        )
        zero = F.rlike(bottom, F.lit(r"^[-+]?0+$"))
        return F.when((bottom != "") & ~zero, as_fraction).when((bottom == "") & (number != ""), as_decimal)

    # the one-element array binds the cleaned answer, so it is computed once
    return F.get(F.transform(F.array(F.regexp_replace(spoken, "[,$]", "")), read), F.lit(0))


def tagged(text: Column | str, tag: str) -> Column:
    """Collapsed text between ``<tag>`` and ``</tag>``; '' when absent."""
    return collapse(F.regexp_extract(col(text), rf"(?is)<{tag}>(.*?)</{tag}>", 1))


def has_tag(text: Column | str, tag: str) -> Column:
    return F.rlike(col(text), F.lit(rf"(?is)<{tag}>.*?</{tag}>"))


def verification_parts(text: Column | str) -> Column:
    """Tentative state and the yes/no question of a self-check."""
    asked = F.coalesce(F.nullif(tagged(text, "verify"), F.lit("")), F.lit(DEFAULT_VERIFICATION))
    question = F.when(F.endswith(asked, F.lit("?")), asked).otherwise(F.concat(asked, F.lit("?")))
    return F.struct(tagged(text, "state").alias("state"), question.alias("question"))


def first_label(text: Column | str, labels: tuple[str, ...]) -> Column:
    """First of the upper-case whole words ``labels``; null when none occurs."""
    found = F.regexp_extract(F.upper(col(text)), rf"(?U)\b({'|'.join(labels)})\b", 1)
    return F.nullif(found, F.lit(""))


def oracle_answer(text: Column | str) -> Column:
    return F.coalesce(first_label(text, ("YES", "NO", "UNKNOWN")), F.lit("UNKNOWN"))


def help_action(text: Column | str) -> Column:
    return first_label(text, ACTIONS)


def scaffold_kind(name: Column | str) -> Column:
    return F.regexp_extract(col(name), SCAFFOLD_NAME, 1)


def scaffold_strength(name: Column | str) -> Column:
    """Strength of ``kind@percent``; any other spelling is an error."""
    percent = F.regexp_extract(col(name), SCAFFOLD_NAME, 2)
    bad = F.raise_error(F.concat(F.lit("Expected a scaffold name like planning@25, got "), col(name)))
    return F.when(F.rlike(col(name), F.lit(SCAFFOLD_NAME)), percent.try_cast("double") / 100.0).when(
        col(name).isNotNull(), bad.cast("double")
    )


def strength_label(strength: Column | str) -> Column:
    return F.rint(col(strength) * 100).cast("int").cast("string")


def error_class(error: Column | str) -> Column:
    name = F.substring_index(F.coalesce(col(error), F.lit("")), ":", 1)
    return F.when(F.coalesce(col(error), F.lit("")) == "", F.lit("unknown")).otherwise(name)


def is_leak_error(error: Column | str) -> Column:
    return F.coalesce(
        F.contains(col(error), F.lit(LEAK_BY_ANSWER)) | F.contains(col(error), F.lit(LEAK_BY_TEXT)),
        F.lit(False),
    )


def hint_level(kind: Column | str) -> Column:
    levels = F.create_map(*[F.lit(x) for pair in HINT_LEVELS.items() for x in pair])
    return F.coalesce(F.try_element_at(levels, col(kind)), F.lit(0))
