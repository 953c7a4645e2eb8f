"""WARC archives of captures, and their index merged into global capture histories.

Writing: of equal payloads of at least ``min_bytes`` bytes the capture with the largest page id
is the response, the others are revisits that refer to it. Each task sorts its captures by URL
key, time and page and writes them as archive files through Spark's own text sink (the record
separator of WARC is the line separator), so any file system that Spark can commit to will do.
Reading: every file is parsed, response payloads are checked against their digests, and each
file gives one sorted run of index entries. Merging: the runs are cut at common range bounds and
every slice merges its part of all runs with a loser tree; (slice, place) is the global order.

Cases: null html is an empty payload; a null or empty URL has the key "" and stays in the
archive; line ends in a URL are escaped. Rows repeated with one page id and payload are all
responses if the id is the largest. A null page id never wins over another; captures of a
payload that only has null ids are responses. Very long payloads are single records; an archive
file holds at most ``records_per_file`` records. Empty tables give no archive and no row.
Columns besides page_id, url, html and captured are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwork.session import checkpoint_folder, cut_lineage

RECORD_END = "\r\n\r\n"
ENTRY = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "url_key string, captured long, archive string, archive_offset long"
)
FIELDS = [part.split()[0] for part in ENTRY.split(", ")]
ARROW = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def url_key(url: Column) -> Column:
    """Sortable key: host labels from the right, then path and query; no scheme, www or fragment."""
    rest = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://", ""), "#.*$", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r"^www[0-9]*\.", "")
    path = F.regexp_extract(rest, r"^[^/?]*(.*)$", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)
    return F.when(rest == "", F.lit("")).otherwise(key)


def first_holders(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Per payload digest that several captures share: the largest page id (``winner``).

    Counts combine before the shuffle, so a payload that a third of the rows share is no burden.
    The result is written: the join that follows sees its size, and can split a hot digest.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return cut_lineage(
        pages.where(F.octet_length(payload) >= min_bytes)
        .groupBy(F.sha1(payload).alias("digest"))
        .agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, records_per_file: int = 2048) -> None:
    """Write one record per capture (page_id, url, html, ``captured`` in epoch seconds) below ``folder``."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), "captured", F.sha1(payload).alias("hash"), url_key(F.col("url")).alias("key"))
    joined = rows.join(first_holders(pages, min_bytes), F.col("hash") == F.col("digest"), "left")
    refers = F.when(F.octet_length("payload") >= min_bytes, F.when(~F.col("winner").eqNullSafe(F.col("page_id")), F.col("winner")))
    runs = joined.select("page_id", "url", "payload", "captured", "hash", "key", refers.alias("refers_to"))
    runs = runs.sortWithinPartitions("key", "captured", "page_id")
    records = runs.mapInArrow(_records, "value string")
    records.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(folder)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        page, url, payload, captured, digest, key, refers = (batch.column(i) for i in range(7))
        for start in range(0, len(page), 256):
            part = [c.slice(start, 256).to_pylist() for c in (page, url, payload, captured, digest, key, refers)]
            made = pa.array([record(*row) for row in zip(*part)], pa.binary())
            yield pa.RecordBatch.from_arrays([made.view(pa.string())], names=["value"])


def page_urn(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, captured: int | None, digest: str, key: str, refers: int | None) -> bytes:
    """One record without its end; a revisit has no payload but tells its length and digest."""
    one_line = str.maketrans({"\r": "%0D", "\n": "%0A"})
    body = payload if refers is None else b""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {page_urn(page)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {url.translate(one_line)}")
    if captured is not None:
        lines.append(f"WARC-Date: {datetime.fromtimestamp(captured, UTC).strftime('%Y-%m-%dT%H:%M:%SZ')}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers is not None:
        lines += [f"WARC-Refers-To: {page_urn(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"X-Payload-Length: {len(payload)}", f"X-Url-Key: {key.translate(one_line)}", "Content-Type: text/html; charset=utf-8"]
    lines += [f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body


def parse_archive(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and body of each record."""
    at, end = 0, RECORD_END.encode()
    while at < len(data):
        stop = data.index(end, at)
        lines = data[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        body = stop + len(end)
        after = body + int(headers["Content-Length"])
        if data[after : after + len(end)] != end:
            raise ValueError(f"the record at byte {at} has no end")
        yield at, headers, data[body:after]
        at = after + len(end)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Index entries of all archives; the payload of a response must fit its digest."""
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("path", "content")
    return files.mapInArrow(_entries, ENTRY)


def _page_of(urn: str | None) -> int | None:
    number = (urn or "<urn:page:>")[len("<urn:page:") : -1]
    return int(number) if number else None


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            out: list[tuple] = []
            for at, head, body in parse_archive(gzip.decompress(content) if path.endswith(".gz") else content):
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = head["WARC-Type"]
                if kind == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                    raise ValueError(f"{path}: the payload at byte {at} differs from its digest")
                date = head.get("WARC-Date")
                when = None if date is None else int(datetime.strptime(date + "+0000", "%Y-%m-%dT%H:%M:%SZ%z").timestamp())
                size = len(body) if kind == "response" else int(head["X-Payload-Length"])
                out.append((_page_of(head["WARC-Record-ID"]), size, digest, kind, _page_of(head.get("WARC-Refers-To")), head["X-Url-Key"], when, path.rsplit("/", 1)[-1], at))
            yield _batch(out)


def _batch(rows: list[tuple], more: list[tuple[str, pa.Array]] = ()) -> pa.RecordBatch:
    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * len(ARROW), ARROW)]
    return pa.RecordBatch.from_arrays([*columns, *[c for _, c in more]], names=[*FIELDS, *[n for n, _ in more]])


class LoserTree:
    """Merges sorted runs: inner nodes keep the loser of their match, the winner goes up."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.heads = [next(run, None) for run in runs] or [None]
        self.losers = [-1] * self.k  # node 0 keeps the winner
        for leaf in range(self.k - 1, -1, -1):
            self._play(leaf)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # the first to come here waits for the other side
                self.losers[node] = winner
                return
            if self._before(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple[tuple, int]]:
        while (head := self.heads[winner := self.losers[0]]) is not None:
            yield head, winner
            self.heads[winner] = next(self.runs[winner], None)
            self._replay(winner)

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if self._before(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner


def merge_runs(index: DataFrame, slices: int | None = None) -> DataFrame:
    """Entries in global order: add ``slice`` (a range of the order) and ``place`` in it.

    Range bounds are over key, time and page, so the captures of one hot URL fall into many
    slices. A task holds the entries of its slice (not the payloads).
    """
    keys = ["url_key", "captured", "page_id"]
    ranged = index.repartitionByRange(slices, *keys) if slices else index.repartitionByRange(*keys)
    parts = ranged.withColumn("slice", F.spark_partition_id()).sortWithinPartitions("archive", "archive_offset")
    return parts.mapInArrow(_merge_slice, f"{ENTRY}, slice int, place long")


def _order(value) -> tuple:
    return (value is not None, value)  # nulls first, as the tasks have sorted them


def _merge_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[str, list[tuple]] = {}
    number = 0
    for batch in batches:
        rows = list(zip(*[c.to_pylist() for c in batch.columns]))
        for row in rows:
            runs.setdefault(row[7], []).append(row[:9])
        number = rows[0][9] if rows else number
    lists = list(runs.values())
    keyed = [((_order(r[5]), _order(r[6]), _order(r[0]), i) for i, r in enumerate(run)) for run in lists]
    merged = [lists[run][key[3]] for key, run in LoserTree(keyed)]
    for start in range(0, len(merged), 4096):
        part = merged[start : start + 4096]
        more = [("slice", pa.array([number] * len(part), pa.int32())), ("place", pa.array(range(start, start + len(part)), pa.int64()))]
        yield _batch(part, more)


def capture_histories(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write the archives below a new folder, read them back and merge their index runs."""
    spark = pages.sparkSession
    folder = folder or f"{checkpoint_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, min_bytes)
    return merge_runs(cut_lineage(read_archives(spark, folder)))


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hash FROM pages),
w AS (SELECT hash, max(page_id) AS winner FROM p GROUP BY hash)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(hash, ((i // 4) * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> winner THEN winner END AS refers_to
FROM p JOIN w USING (hash)
"""
