"""Document fingerprints by invertible Bloom lookup sketches of paragraphs (native).

A text's paragraphs are its lines cut at sentence ends and then into runs of ``WORDS`` words, by
one rule for texts of any length. Each distinct paragraph's digest goes into one cell of each of
three subtables; a cell holds a count and the xor of digests and of their check hashes. The
fingerprint is this sketch, written out cell by cell. Fingerprints of two versions are subtracted:
what both have cancels out. A cell with count 1 or -1 and a fitting check hash holds one differing
digest; it is taken out of its other cells, subtable by subtable, until nothing is left. Only where
cells are left, or the counts say beforehand that the sketch is too full, larger sketches of the two
sets with other hashes are subtracted: sized by the number of differences that the counts suggest,
twice the size a level, at most as large as the two sets need. Should ``LEVELS`` of them fail, which
has no known case, the sets themselves are compared. Likeness is that of the paragraph sets (Jaccard): a
sketch's counts give the set's size, the recovered digests the difference.

The next document is the next row by id. Ids are cut by approximate quantiles into slices of about
``SLICE`` rows, at most ``CUTS`` of them, so the list of cuts is bounded; an id that takes several
quantiles is split by its texts' hashes. Each slice also gets the first row of the following one.
Texts move once. The digests are written as a bucketed table, and all sketch work is grouped by
slice and needs no shuffle; the table leaves the catalog at the end.

Cases: null text is empty; an empty text has no paragraph, an empty fingerprint and likeness 1 to
another empty one. Rows with a null id come last, in an order by text hash, then the first row
follows. Rows of one id are ordered by text hash; repeated rows follow each other. A single row is
its own next. Empty tables give no row. Very long texts are read whole. Extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungwork.session import checkpoint_folder, cut_lineage

SLICE = 1_000
CUTS = 10_000
WORDS = 16
CELLS = 16  # of each subtable in the fingerprint: some 35 differences can be read from it
TABLES = 3
PASSES = 9  # three for each subtable
LEVELS = 8
FULL = -2  # instead of a cell: the sketch has too many members
LOAD = 0.75  # members a cell that are tried to read
ROOM = 2.0  # cells a guessed member of the larger sketches
KEY = ("slice", "place", "pair")


def paragraphs(text: Column) -> Column:
    """Distinct digests of the parts of a text."""
    lines = F.split(text, r"(?<=[.!?])\s+|\n")
    runs = F.transform(lines, lambda s: F.regexp_extract_all(s, F.lit(rf"(?:\S+\s*){{1,{WORDS}}}"), F.lit(0)))
    return F.array_distinct(F.transform(F.flatten(runs), lambda p: F.xxhash64(F.rtrim(p, F.lit(" \t\n\x0b\f\r")))))


def check_of(digest: Column) -> Column:
    return F.hash(digest, F.lit(-7))


def cell_of(digest: Column, table: Column | int, cells: Column, level: int) -> Column:
    table = F.lit(table) if isinstance(table, int) else table
    return table * cells + F.pmod(F.xxhash64(digest, table + 31 * level), cells).cast("int")


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """(slice, place, doc_id, text, parts, next, next_parts): every row with the text of the row after it; and the slices."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    slices = min(CUTS, max(1, -(-rows.count() // SLICE)))
    number = F.col("doc_id").cast("double")  # rounding keeps the order, and equal ids together
    quantiles = [k / slices for k in range(1, slices)]
    ends = (rows.agg(F.percentile_approx(number, quantiles, 4 * slices)).first()[0] or []) if quantiles else []
    splits = [-math.inf, *sorted(set(ends)), math.inf]
    hashed = rows.withColumn("v", number).withColumn("hash", F.xxhash64("text"))
    dealt = Bucketizer(splits=splits, inputCol="v", outputCol="bucket", handleInvalid="keep").transform(hashed) if ends else hashed.withColumn("bucket", F.lit(0))
    hot = [(v, n) for v, n in Counter(ends).items() if n > 1]  # ids that take several quantiles, fewer than CUTS
    if hot:
        dealt = dealt.join(F.broadcast(docs.sparkSession.createDataFrame(hot, "w double, n int")), F.col("v") == F.col("w"), "left")
        share = F.floor((F.col("hash") / 2.0**64 + 0.5) * F.col("n"))  # grows with the hash
        fine = F.when(F.col("n").isNotNull(), F.least(share, F.col("n") - 1)).otherwise(F.lit(CUTS))
    else:
        fine = F.lit(0)
    known = F.col("bucket").cast("long") * (CUTS + 1) + fine
    cut = F.when(F.col("doc_id").isNotNull(), known).otherwise(F.lit((slices + 2) * (CUTS + 1)) + F.pmod("hash", F.lit(slices)))
    sliced = dealt.select("doc_id", "text", cut.cast("long").alias("slice"), "hash")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    order = Window.orderBy("slice")  # one row a slice
    every = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = sliced.groupBy("slice").agg(F.min(first).alias("head"))
    heads = cut_lineage(
        heads.select(F.col("slice").alias("s"), F.col("head.doc_id").alias("i"), F.col("head.hash").alias("h"), F.coalesce(F.lag("slice").over(order), F.last("slice").over(every)).alias("goes_to"))
    )
    ghosts = sliced.join(heads, (F.col("slice") == F.col("s")) & (F.col("hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("i")))
    both = sliced.withColumn("ghost", F.lit(0)).unionByName(ghosts.select("doc_id", "text", F.col("goes_to").alias("slice"), "hash", F.lit(1).alias("ghost")))
    ordered = Window.partitionBy("slice").orderBy("ghost", F.col("doc_id").asc_nulls_last(), "hash")
    both = both.repartition("slice").withColumn("parts", paragraphs(F.col("text")))  # digests do not shrink, so they are made after the texts moved
    placed = both.withColumn("next", F.lead("text").over(ordered)).withColumn("next_parts", F.lead("parts").over(ordered)).withColumn("place", F.row_number().over(ordered))
    return placed.where("ghost = 0").select("slice", "place", "doc_id", "text", "parts", "next", "next_parts"), slices


def sketches(rows: DataFrame, sides: list[str], cells: Column, level: int, keys: tuple[str, ...] = ("slice", "place")) -> DataFrame:
    """(keys, cells, cell and n, key, check by side): what each cell of each side's sketch holds."""

    def tagged(side: int, name: str) -> Column:
        return F.transform(name, lambda d: F.struct(F.lit(side).alias("side"), d.alias("d")))

    tables = F.array(*[F.lit(j) for j in range(TABLES)])
    members = rows.select(*keys, cells.cast("int").alias("cells"), F.explode(F.concat(*[tagged(k, c) for k, c in enumerate(sides)])).alias("e"))
    put = members.select(*keys, "cells", "e.side", "e.d", check_of(F.col("e.d")).alias("c"), F.explode(tables).alias("t"))
    put = put.select(*keys, "cells", cell_of(F.col("d"), F.col("t"), F.col("cells"), level).alias("cell"), "side", "d", "c")
    held = []
    for k in range(len(sides)):
        mine = F.col("side") == k
        held.append(F.sum(F.when(mine, 1).otherwise(0)).cast("int").alias(f"n{k}"))
        held.append(F.bit_xor(F.when(mine, F.col("d")).otherwise(F.lit(0))).alias(f"key{k}"))
        held.append(F.bit_xor(F.when(mine, F.col("c")).otherwise(F.lit(0))).alias(f"check{k}"))
    return put.groupBy(*keys, "cells", "cell").agg(*held)


def subtract(held: DataFrame, x: int, y: int) -> dict[str, Column]:
    """What is left of a cell of side ``x`` without that of ``y``."""
    return {"n": F.col(f"n{x}") - F.col(f"n{y}"), "key": F.col(f"key{x}").bitwiseXOR(F.col(f"key{y}")), "check": F.col(f"check{x}").bitwiseXOR(F.col(f"check{y}"))}


def peel(cells: DataFrame, level: int, listed: tuple[int, ...] = (), passes: int = PASSES) -> DataFrame:
    """Take single digests out of their cells; recovered ones are rows of cell -1.

    ``cells``: (slice, place, pair, cells, cell, n, key, check). Pairs in ``listed`` keep each
    digest (``known``, with ``n`` 1 or -1 for its side); of others it is only counted (``count``).
    A pass looks at one subtable, where a digest has one cell, so none is taken out twice.
    """
    zero = F.lit(0).cast("long")
    cells = cells.withColumn("known", zero).withColumn("count", F.when(F.col("cell") == FULL, F.col("check")).otherwise(0))
    for turn in range(passes):
        table = turn % TABLES
        inside = F.floor(F.col("cell") / F.col("cells")) == table
        alone = (F.col("cell") >= 0) & inside & (F.abs("n") == 1) & (F.col("check") == check_of(F.col("key"))) & (cell_of(F.col("key"), table, F.col("cells"), level) == F.col("cell"))

        def row(cell: Column, n: Column, key: Column, check: Column, known: Column, count: Column) -> Column:
            return F.struct(cell.cast("int").alias("cell"), n.cast("int").alias("n"), key.alias("key"), check.cast("int").alias("check"), known.alias("known"), count.cast("int").alias("count"))

        out = [row(cell_of(F.col("key"), j, F.col("cells"), level), -F.col("n"), F.col("key"), F.col("check"), zero, F.lit(0)) for j in range(TABLES) if j != table]
        name = F.when(F.col("pair").isin(*listed), F.col("key")).otherwise(zero) if listed else zero
        found = F.array(row(F.lit(-1), F.col("n"), zero, F.lit(0), name, F.lit(1)), *out)  # the digest goes into a row of its own
        same = F.array(row(*[F.col(c) for c in ("cell", "n", "key", "check", "known", "count")]))
        moved = cells.select(*KEY, "cells", F.explode(F.when(alone, found).otherwise(same)).alias("r")).select(*KEY, "cells", "r.*")
        cells = (
            moved.groupBy(*KEY, "cells", "cell", "known")
            .agg(F.sum("n").cast("int").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"), F.sum("count").cast("int").alias("count"))
            .where("cell < 0 or n <> 0 or key <> 0 or check <> 0")
        )
    return cells


def _result(cells: DataFrame) -> DataFrame:
    """Per (slice, place, pair): digests found, cells left open, the guess of a full sketch, and the listed digests of each side."""
    taken = F.col("cell") == -1
    return cells.groupBy(*KEY).agg(
        F.sum(F.when(taken, F.col("count")).otherwise(0)).alias("found"),
        F.sum(F.when(taken, 0).otherwise(1)).alias("open"),
        F.max(F.when(F.col("cell") == FULL, F.col("count"))).alias("guess"),
        F.collect_list(F.when(taken & (F.col("known") != 0) & (F.col("n") > 0), F.col("known"))).alias("only_x"),
        F.collect_list(F.when(taken & (F.col("known") != 0) & (F.col("n") < 0), F.col("known"))).alias("only_y"),
    )


def weighed(cells: DataFrame) -> DataFrame:
    """Differences with too many members for their cells become one row of cell ``FULL``, whose check is the guess of their number.

    A member adds 1 or -1 to one cell of each subtable, so the squares of the counts add up to
    about the number of members, subtable by subtable.
    """
    held = F.collect_list(F.struct("cell", "n", "key", "check")).alias("held")
    whole = cells.groupBy(*KEY, "cells").agg(held, F.ceil(F.sum(F.col("n") * F.col("n")) / TABLES).cast("int").alias("guess"))
    zero = F.lit(0)
    full = F.struct(F.lit(FULL).alias("cell"), F.lit(1).alias("n"), zero.cast("long").alias("key"), F.col("guess").alias("check"))
    shown = F.when(F.col("guess") <= F.col("cells") * TABLES * LOAD, F.col("held")).otherwise(F.array(full))
    return whole.select(*KEY, "cells", F.explode(shown).alias("h")).select(*KEY, "cells", "h.*")


def differences(rows: DataFrame, sides: list[str], pairs: dict[int, tuple[int, int]], listed: tuple[int, ...] = (), cells: int = CELLS, levels: int = LEVELS) -> DataFrame:
    """Written: (slice, place, pair, found, only_x, only_y, level) of the pairs of sides that differ.

    ``rows`` has slice, place and the arrays that ``sides`` names. Level 0 subtracts the sketches
    of ``cells`` a subtable; pairs that are not read from them go on to larger ones, sized by what
    level 0 says about their number.
    """
    held = sketches(rows, sides, F.lit(cells), 0)
    left = [F.struct(F.lit(k).alias("pair"), *[v.alias(n) for n, v in subtract(held, x, y).items()]) for k, (x, y) in pairs.items()]
    first = held.select("slice", "place", "cells", "cell", F.explode(F.array(*left)).alias("p")).select("slice", "place", "p.pair", "cells", "cell", "p.n", "p.key", "p.check")
    result = cut_lineage(_result(peel(weighed(first.where("n <> 0 or key <> 0 or check <> 0")), 0, listed)))
    kept = [*KEY, "found", "only_x", "only_y"]
    done = result.where("open = 0").select(*kept, F.lit(0).alias("level"))
    sets = rows.select("slice", "place", F.explode(F.array(*[F.struct(F.lit(k).alias("pair"), F.col(sides[x]).alias("x"), F.col(sides[y]).alias("y")) for k, (x, y) in pairs.items()])).alias("p"))
    sets = sets.select("slice", "place", "p.*")
    guess = F.coalesce("guess", F.lit(cells * TABLES))
    failed = result.where("open > 0").select(*KEY, guess.alias("guess"))
    for level in range(1, levels + 1):
        if failed.isEmpty():
            return done
        todo = sets.join(failed, list(KEY))
        if level == levels:
            x, y = F.array_except("x", "y"), F.array_except("y", "x")
            empty = F.array().cast("array<bigint>")
            shown = F.col("pair").isin(*listed) if listed else F.lit(False)
            exact = todo.select(*KEY, (F.size(x) + F.size(y)).cast("long").alias("found"), F.when(shown, x).otherwise(empty).alias("only_x"), F.when(shown, y).otherwise(empty).alias("only_y"))
            return done.unionByName(cut_lineage(exact.withColumn("level", F.lit(level))))
        most = F.size("x") + F.size("y")  # a difference is never larger than both sets
        wanted = F.ceil(F.least(F.col("guess") * 2 ** (level - 1), most * (1 + level / 4)) * ROOM / TABLES) + 8
        larger = sketches(todo, ["x", "y"], wanted, level, (*KEY, "guess"))
        cut = larger.select(*KEY, "cells", "cell", *[v.alias(n) for n, v in subtract(larger, 0, 1).items()])
        result = cut_lineage(_result(peel(cut.where("n <> 0 or key <> 0 or check <> 0"), level, listed)))
        done = done.unionByName(result.where("open = 0").select(*kept, F.lit(level).alias("level")))
        failed = result.where("open > 0").select(*KEY).join(failed, list(KEY))
    return done


def fingerprints(rows: DataFrame, sides: list[str], shown: dict[int, str], cells: int = CELLS) -> DataFrame:
    """(slice, place and ``shown``): the sketches as text, ``cell count:key:check`` in hex with a point between cells."""
    held = sketches(rows, sides, F.lit(cells), 0)

    def text(k: int) -> Column:
        cell = F.format_string("%02x%x:%016x:%08x", F.col("cell"), F.col(f"n{k}"), F.col(f"key{k}"), F.col(f"check{k}"))
        return F.array_join(F.array_sort(F.collect_list(F.when(F.col(f"n{k}") > 0, cell))), ".")

    return held.groupBy("slice", "place").agg(*[text(k).alias(name) for k, name in shown.items()])


def likeness(x: Column, y: Column, found: Column) -> Column:
    """Of two sets from their sizes and the number of differing members."""
    total = x + y
    return F.when(total == 0, F.lit(1.0)).otherwise((total - found) / (total + found)).cast("double")


def compare_versions(docs: DataFrame) -> DataFrame:
    """Per row: fingerprints of the text and of its edited version, their likenesses and the differing digests.

    The edited text has the last half of its characters replaced by as many first ones of the
    next document. ``only_text`` and ``only_edited`` are the digests recovered from the two
    fingerprints; ``level`` says how often larger sketches were needed for them (null: no difference).
    """
    spark = docs.sparkSession
    rows, slices = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    made = rows.select(
        "slice", "place", "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("parts").alias("a"), paragraphs(F.col("edited")).alias("b"), F.col("next_parts").alias("c"),
    )
    name = f"fingerprint_{uuid.uuid4().hex}"
    made.write.bucketBy(max(4, slices), "slice").option("compression", "zstd").option("path", f"{checkpoint_folder(spark)}/{name}").saveAsTable(name)
    co_located = "spark.sql.requireAllClusterKeysForCoPartition"  # the joins on (slice, place) find both sides by slice
    before = spark.conf.get(co_located, "true")
    try:
        spark.conf.set(co_located, "false")
        table = spark.table(name)
        found = differences(table, ["a", "b", "c"], {0: (0, 1), 1: (0, 2)}, listed=(0,))
        by_pair = [F.max(F.when(F.col("pair") == k, F.col("found"))).alias(f"found{k}") for k in (0, 1)]
        edit = F.max(F.when(F.col("pair") == 0, F.struct("level", "only_x", "only_y"))).alias("edit")
        wide = found.groupBy("slice", "place").agg(*by_pair, edit)
        joined = table.select("slice", "place", "doc_id", "n_chars", "edited_sha256", *[F.size(c).alias(c) for c in "abc"])
        for part in (fingerprints(table, ["a", "b"], {0: "fingerprint", 1: "edited_fingerprint"}), wide):
            renamed = part.withColumnsRenamed({"slice": "s", "place": "p"})
            joined = joined.join(renamed, (F.col("slice") == F.col("s")) & (F.col("place") == F.col("p")), "left").drop("s", "p")
        zero, none = F.lit(0), F.array().cast("array<bigint>")
        return cut_lineage(joined.select(
            "doc_id", "n_chars", "edited_sha256", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"), F.coalesce("edited_fingerprint", F.lit("")).alias("edited_fingerprint"),
            likeness(F.col("a"), F.col("b"), F.coalesce("found0", zero)).alias("near_edited"), likeness(F.col("a"), F.col("c"), F.coalesce("found1", zero)).alias("near_next"),
            F.coalesce("edit.only_x", none).alias("only_text"), F.coalesce("edit.only_y", none).alias("only_edited"), F.col("edit.level").alias("level"),
        ), compression="zstd")
    finally:
        spark.conf.set(co_located, before)
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # the catalog entry; its files stay in the checkpoint folder
