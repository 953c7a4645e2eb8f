"""Line dedup by content-defined chunks of lines (native).

Lines get a hash each, and a cyclic rolling hash over ``2`` line hashes marks lines where it is a
multiple of ``spread``. A chunk ends at a marked line behind an unmarked one, but not at the last
line but one, so every chunk of a text of two lines has at least two, and the same passage is cut
alike wherever it stands: an end depends on three lines. A chunk of at least
``least`` lines that occurs again anywhere is removed everywhere but at its first place (smallest
doc_id, then text hash, then position), after its bytes were compared with the first one's.

Only digests of chunks are shuffled to find the repeated ones (counts combine first); texts of
chunks and documents move where a filter of bounded size says that they may be concerned.

Cases: null text stays null and has no chunks; empty text is one empty line, which is no
multi-line chunk. Very long texts are cut whole. Rows that repeat id and text are one document
and get the same result; a null id is last in the order. Empty tables give no row. All input
columns are kept in place; helper names are only used inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwork.session import cut_lineage

SPREAD = 2
LEAST = 2
SLOTS = 1 << 20


def chunks(text: Column, spread: int = SPREAD) -> Column:
    """Array of chunk texts; joined by line ends they are the text again."""
    ring = 1 << 28

    def once(value: Column, use) -> Column:  # evaluate an expression once
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def hash_of(line: Column) -> Column:
        return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")

    def turned(value: Column) -> Column:
        return (value * 2) % ring + F.floor(value * 2 / ring).cast("long")

    def marks(hashes: Column) -> Column:
        """Whether the rolling hash at each line is a multiple of ``spread``; the first line has none."""
        return F.transform(hashes, lambda h, i: (i > 0) & (h.bitwiseXOR(turned(F.get(hashes, i - 1))) % spread == 0))

    def ends(marked: Column) -> Column:
        last = F.size(marked) - 1
        inner = F.filter(
            F.when(last > 2, F.sequence(F.lit(1), last - 2)).otherwise(F.array().cast("array<int>")),
            lambda i: F.get(marked, i) & ~F.get(marked, i - 1),
        )
        return F.concat(F.array(F.lit(-1)), inner, F.array(last))

    def cut(lines: Column) -> Column:
        return once(
            once(once(F.transform(lines, hash_of), marks), ends),
            lambda e: F.transform(
                F.sequence(F.lit(1), F.size(e) - 1),
                lambda k: F.array_join(F.slice(lines, F.get(e, k - 1) + 2, F.get(e, k) - F.get(e, k - 1)), "\n"),
            ),
        )

    return F.when(text.isNotNull(), once(F.split(text, "\n", -1), cut))


def line_count(chunk: Column) -> Column:
    return F.length(chunk) - F.length(F.replace(chunk, F.lit("\n"), F.lit(""))) + 1


def _slots(rows: DataFrame, key: Column, wanted: DataFrame, negate: bool = False) -> DataFrame:
    """Rows whose key may be wanted (or surely is not): the broadcast side has SLOTS rows at most."""
    some = wanted.select(F.pmod("key", F.lit(SLOTS)).alias("slot")).distinct()
    return rows.withColumn("slot", F.pmod(key, F.lit(SLOTS))).join(F.broadcast(some), "slot", "left_anti" if negate else "left_semi").drop("slot")


def repeated_places(docs: DataFrame, spread: int, least: int) -> DataFrame:
    """Per document (doc_id, hash) with something to remove: the ``places`` of its chunks that go."""
    cut = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.posexplode(chunks(F.col("text"), spread)).alias("place", "chunk"))
    cut = cut.where(line_count(F.col("chunk")) >= least).withColumn("key", F.xxhash64("chunk"))
    where = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "place")
    firsts = cut_lineage(
        cut.groupBy("key")
        .agg(F.min(where).alias("first"), F.max(where).alias("last"))
        .where(F.col("first") != F.col("last"))  # repeated rows of a document are one place
        .select("key", "first")
    )
    named = firsts.withColumnRenamed("key", "of")
    met = _slots(cut, F.col("key"), firsts).join(named, F.col("key") == F.col("of")).withColumn("here", where)
    met = cut_lineage(met.select("key", "chunk", "doc_id", "hash", "place", (F.col("here") == F.col("first")).alias("original")))
    originals = met.where("original").select(F.col("key").alias("of"), F.col("chunk").alias("bytes")).dropDuplicates(["of"])
    same = met.where("not original").join(originals, F.col("key") == F.col("of")).where(F.col("chunk") == F.col("bytes"))
    gone = same.groupBy("doc_id", "hash").agg(F.collect_set("place").alias("places"))
    return cut_lineage(gone.withColumn("key", F.xxhash64("doc_id", "hash")))


def dedup_lines(docs: DataFrame, spread: int = SPREAD, least: int = LEAST, report: bool = False) -> DataFrame:
    """The documents without their repeated chunks (``n_chars``, if there, follows the text).

    ``report`` gives doc_id, n_lines, n_chunks, removed_chunks, removed_lines and kept_sha256 instead.
    """
    gone = repeated_places(docs.select("doc_id", "text"), spread, least)
    row = docs.select(F.struct(*docs.columns).alias("row")).withColumns({"hash": F.xxhash64("row.text"), "id": F.col("row.doc_id")})
    key = F.xxhash64("id", "hash")
    named = gone.select(F.col("doc_id").alias("of"), F.col("hash").alias("of_hash"), "places")
    touched = _slots(row, key, gone).join(named, F.col("id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("of_hash")), "left")
    places = F.coalesce("places", F.array().cast("array<int>"))
    cut = touched.select("row", places.alias("places"), chunks(F.col("row.text"), spread).alias("all"))
    kept = F.array_join(F.filter("all", lambda c, i: ~F.array_contains("places", i)), "\n")
    text = F.when(F.size("places") > 0, kept).otherwise(F.col("row.text"))
    rest = _slots(row, key, gone, negate=True)
    if report:
        removed = F.filter("all", lambda c, i: F.array_contains("places", i))
        shown = cut.withColumns({"text": text, "removed": removed}).unionByName(
            rest.select("row", F.array().cast("array<int>").alias("places"), chunks(F.col("row.text"), spread).alias("all"), F.col("row.text").alias("text"), F.array().cast("array<string>").alias("removed"))
        )
        return shown.select(
            F.col("row.doc_id").alias("doc_id"),
            F.coalesce(line_count(F.col("row.text")), F.lit(0)).cast("long").alias("n_lines"),
            F.coalesce(F.size("all"), F.lit(0)).cast("long").alias("n_chunks"),
            F.size("removed").cast("long").alias("removed_chunks"),
            F.aggregate("removed", F.lit(0).cast("long"), lambda n, c: n + line_count(c)).alias("removed_lines"),
            F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
        )

    def columns(new: Column) -> list[Column]:
        named = {"text": new} | ({"n_chars": F.length(new).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
        return [named.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]

    return cut.select(columns(text)).unionByName(rest.select([F.col(f"row.`{c}`").alias(c) for c in docs.columns]))


SQL = """
WITH l AS (
  SELECT doc_id, md5(text) AS hash, text, unnest(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10)))))) AS p
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
h AS (SELECT doc_id, hash, p[1] AS line, p[2] AS i, ('0x' || substr(md5(p[1]), 1, 7))::BIGINT AS v FROM l),
r AS (SELECT *, lag(v) OVER w AS u, lead(i) OVER w AS nxt FROM h WINDOW w AS (PARTITION BY doc_id, hash ORDER BY i)),
m AS (SELECT *, coalesce(i > 0 AND xor(v, (u * 2) % 268435456 + (u * 2) // 268435456) % 2 = 0, false) AS marked FROM r),
o AS (SELECT *, lag(marked) OVER w AS behind, lead(nxt) OVER w AS nxt2 FROM m WINDOW w AS (PARTITION BY doc_id, hash ORDER BY i)),
e AS (SELECT *, CASE WHEN nxt IS NULL OR (marked AND NOT behind AND nxt2 IS NOT NULL) THEN 1 ELSE 0 END AS is_end FROM o),
n AS (SELECT *, coalesce(sum(is_end) OVER (PARTITION BY doc_id, hash ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM e),
c AS (SELECT doc_id, hash, place, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS lines FROM n GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id NULLS LAST, hash, place) > 1 AND lines >= 2 AS gone FROM c),
s AS (SELECT doc_id, hash, sum(lines) AS n_lines, count(*) AS n_chunks, count(*) FILTER (gone) AS removed_chunks, coalesce(sum(lines) FILTER (gone), 0) AS removed_lines,
             sha256(coalesce(string_agg(chunk, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM k GROUP BY doc_id, hash)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_chunks, 0)::BIGINT AS n_chunks, coalesce(removed_chunks, 0)::BIGINT AS removed_chunks,
       coalesce(removed_lines, 0)::BIGINT AS removed_lines, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN s ON d.doc_id IS NOT DISTINCT FROM s.doc_id AND md5(d.text) = s.hash
"""
