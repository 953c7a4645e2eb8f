"""Mixing sources to target weights by exponential keys (native).

Every source gets a share of ``budget`` times all words by its weight; no target passes
``most`` times the source's own words, and what is cut off goes to the others by weight. That
is a level: target = min(most * size, level * weight), found from the sorted ratios of size to
weight. A source gives all its documents for each complete epoch in its target; the rest of the
target is filled by weighted sampling: documents in order of -ln(u) / quality, u drawn from a
hash of the id, summed up until the words are reached. The document on the border gives the
words that are still missing, so that the source meets its target to the word.

The order inside a source is cut into slices of about ``slice_rows`` documents by the key:
slices are summed first, then documents inside their slice, so no source is sorted by one task.

Cases: null or empty text has size 0 and is taken 0 times; a null source is a source of its own
and comes last; rows that are repeated are documents of their own, ties in the order fall to the
smaller size (equal rows give equal amounts in some order). A table without words has targets 0, an
empty one gives no row. The source table is one row per source and is ordered by one task.
Needed columns: id, text, source; an input column that has an output name is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungwork.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
LETTERS = "abcdefghijklmnopqrstuvwxyz"
OUT = ("size", "source_size", "target", "taken")
SOURCES = 100_000  # whose borders are broadcast


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """0.5 to 1 by the share of plain letters in the text."""
    n = F.length(text)
    letters = n - F.length(F.translate(text, LETTERS, ""))
    return F.coalesce(F.lit(0.5) + F.lit(0.5) * letters / F.when(n > 0, n), F.lit(0.5))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) that only depends on the seed and the id."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(16**12))


def source_targets(sizes: DataFrame, budget: float, most: float, weights: Sequence[int]) -> DataFrame:
    """Add ``target`` to one row per source (``source``, ``source_size``)."""
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("weight", F.get(listed, (F.row_number().over(turn) - 1) % len(weights)))
    order = ["cut", F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.lit(most) * F.col("source_size")
    levels = (
        weighed.withColumn("cut", full / F.col("weight"))
        .withColumn("level", (F.lit(budget) * F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    )
    # Past the first source that keeps below its bound, levels only fall.
    level = F.max(F.when(F.col("level") <= F.col("cut"), F.col("level"))).over(everything)
    target = F.least(full, F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return levels.select("source", "source_size", "docs", target.alias("target"))


def sampling_key(doc_id: Column, text: Column, seed: int, weight: Column | None) -> Column:
    return -F.log(uniform(doc_id, seed)) / (quality(text) if weight is None else weight)


def _placed(
    docs: DataFrame,
    keep: Sequence[str],
    budget: float = 1.5,
    most: float = 2.0,
    weights: Sequence[int] = WEIGHTS,
    weight: Column | None = None,
    seed: int = 11,
    slice_rows: int = 1_000,
) -> DataFrame:
    """Per document: ``row`` (the ``keep`` columns), source, key, doc_id, size, its source's figures, ``epochs`` and ``part``."""
    rows = cut_lineage(
        docs.select(
            F.struct(F.lit(0).alias(""), *keep).alias("row"),
            F.col("source").alias("source"),
            F.col("doc_id").alias("doc_id"),
            words(F.col("text")).alias("size"),
            sampling_key(F.col("doc_id"), F.col("text"), seed, weight).alias("key"),
        )
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    targets = cut_lineage(source_targets(sizes, budget, most, weights))  # read by both branches below
    named = targets.withColumnRenamed("source", "of")
    pieces = F.ceil(F.col("docs") / slice_rows)
    place = F.floor((1 - F.exp(-0.75 * F.col("key"))) * pieces)
    sliced = rows.join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("slice", place)
    sums = sliced.groupBy("source", "slice").agg(F.sum("size").alias("n"))
    running = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("of"), F.col("slice").alias("at"), F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sliced.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("at"))
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor(F.col("target") - F.col("epochs") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before") - F.col("ahead")))
    return placed.withColumn("epochs", epochs).select("row", "source", "key", "doc_id", "size", "source_size", "target", "epochs", part.alias("part"))


def mix(docs: DataFrame, keep: Sequence[str] | None = None, **settings) -> DataFrame:
    """Add size, source_size, target and taken to the ``keep`` columns (all of them by default).

    Settings: ``budget``, ``most``, ``weights``, ``seed``, ``slice_rows`` and ``weight``, which
    replaces the quality of a document and must be positive.
    """
    keep = list(docs.columns if keep is None else keep)
    if clash := set(OUT) & set(keep):
        raise ValueError(f"columns {sorted(clash)} are there already; leave them out of keep=")
    taken = (F.col("epochs") * F.col("size") + F.col("part")).cast("long")
    placed = _placed(docs, keep, **settings)
    return placed.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], "size", "source_size", "target", taken.alias("taken"))


def borders(placed: DataFrame) -> DataFrame:
    """One row a source: epochs, the first place in its order that is not taken whole, and what is taken there.

    ``words`` is the amount of all documents of that place and ``alike`` their number; the place
    is null where the whole source is taken.
    """
    place = F.struct(F.col("key"), F.col("doc_id").isNotNull().alias("named"), "doc_id", "size")
    at = placed.withColumn("place", place)
    first = at.groupBy("source").agg(F.max("epochs").alias("epochs"), F.min(F.when(F.col("part") < F.col("size"), F.col("place"))).alias("border"))
    first = cut_lineage(first)
    named = first.select(F.col("source").alias("of"), F.col("border").alias("b")).where("b is not null")
    met = at.join(named, F.col("source").eqNullSafe(F.col("of")) & (F.col("place") == F.col("b")))
    tied = met.groupBy("of").agg(F.sum("part").alias("words"), F.count(F.lit(1)).alias("alike"))
    return first.join(tied, F.col("source").eqNullSafe(F.col("of")), "left").select(F.col("source").alias("of"), F.col("epochs").alias("times"), "border", "words", "alike")


def mixed_documents(docs: DataFrame, seed: int = 11, weight: Column | None = None, **settings) -> DataFrame:
    """The mix itself: each document as often as it is taken, the last time maybe its first words only.

    Only ids, sizes and keys are put in order; from them comes one border a source, and each
    document is compared with its source's border where it lies. Texts are not moved, but for
    documents that share a border, which are numbered to the last word.
    """
    columns = docs.columns
    given = docs.select(F.struct(*[f"`{c}`" for c in columns]).alias("row"))
    needed = {c: F.col(f"row.{c}") for c in ("doc_id", "source", "text")}
    narrow = _placed(docs, [], seed=seed, weight=weight, **settings)
    marks = cut_lineage(borders(narrow))
    size = words(needed["text"])
    place = F.struct(sampling_key(needed["doc_id"], needed["text"], seed, weight).alias("key"), needed["doc_id"].isNotNull().alias("named"), needed["doc_id"].alias("doc_id"), size.alias("size"))
    few = marks.count() <= SOURCES
    if weight is not None:  # an expression over the input's columns
        given = docs.select(F.struct(*[f"`{c}`" for c in columns]).alias("row"), weight.alias("__weight"))
        place = F.struct(sampling_key(needed["doc_id"], needed["text"], seed, F.col("__weight")).alias("key"), *[f for f in (needed["doc_id"].isNotNull().alias("named"), needed["doc_id"].alias("doc_id"), size.alias("size"))])
    known = given.select("row", place.alias("place")).join(F.broadcast(marks) if few else marks, needed["source"].eqNullSafe(F.col("of")))
    many = not marks.where("alike > 1").isEmpty()
    at_border = F.coalesce(F.col("place") == F.col("border"), F.lit(False))
    before = F.col("border").isNull() | (F.col("place") < F.col("border"))
    part = F.when(at_border, F.col("words")).when(before, F.col("place.size")).otherwise(F.lit(0))
    if many:
        alone = ~at_border | (F.col("alike") == 1)
        shared = cut_lineage(known.where(~alone).withColumn("nr", F.monotonically_increasing_id()))
        group = F.shiftright("nr", 33)  # of one written task
        counts = shared.groupBy("of", group.alias("task")).agg(F.count(F.lit(1)).alias("n"), F.min("nr").alias("least"))
        along = Window.partitionBy("of").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(F.col("of").alias("o"), F.col("task").alias("t"), F.coalesce(F.sum("n").over(along), F.lit(0)).alias("offset"))
        inside = Window.partitionBy("of", "task").orderBy("nr")
        numbered = shared.withColumn("task", group).withColumn("k", F.row_number().over(inside) - 1)
        numbered = numbered.join(offsets, F.col("of").eqNullSafe(F.col("o")) & (F.col("task") == F.col("t")))
        left = F.col("words") - (F.col("offset") + F.col("k")) * F.col("place.size")
        some = numbered.withColumn("part", F.greatest(F.lit(0), F.least(F.col("place.size"), left)).cast("long"))
        both = known.where(alone).withColumn("part", part.cast("long")).select("row", "place", "times", "part")
        taken = both.unionByName(some.select("row", "place", "times", "part"))
    else:
        taken = known.withColumn("part", part.cast("long")).select("row", "place", "times", "part")
    whole = F.array_repeat(F.col("place.size"), F.col("times").cast("int"))
    shares = F.concat(whole, F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<bigint>")))
    copies = taken.where("place.size > 0").select("row", F.col("place.size").alias("size"), F.explode(shares).alias("share"))
    first = F.array_join(F.slice(F.regexp_extract_all(needed["text"], F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, F.col("share").cast("int")), "")
    text = F.when(F.col("share") == F.col("size"), needed["text"]).otherwise(first)
    shown = {"text": text}
    if "n_chars" in columns:  # follows a text that was cut
        shown["n_chars"] = F.when(F.col("share") == F.col("size"), F.col("row.n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return copies.select(*[shown.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])


SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         -ln((('0x' || substr(md5('11|' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
         / coalesce(0.5 + 0.5 * (length(text) - length(translate(text, 'abcdefghijklmnopqrstuvwxyz', ''))) / nullif(length(text), 0), 0.5) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS turn FROM d GROUP BY source),
w AS (SELECT *, ([3.0, 1.0, 2.0])[((turn - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
c AS (SELECT *, 2.0::DOUBLE * source_size / weight AS cut FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY cut, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY cut, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, max(CASE WHEN level <= cut THEN level END) OVER () * weight) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target - epochs * source_size) - ahead)))::BIGINT AS taken FROM r
"""
