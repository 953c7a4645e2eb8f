"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of test items.

Text is normalised by bytes: A-Z become a-z, other ASCII characters than digits and letters part
words, and everything beyond ASCII belongs to words. An item's windows are its runs of ``window``
consecutive words; an item of fewer words, but not none, is one window. The automaton's letters
are words (numbers of the words that windows hold, 0 for all others), so a window is a path of at
most ``window`` nodes, and a document is scanned once whatever the number of windows. Hit words
are mapped back to character offsets of the original text.

The automaton goes to every task, so it is bounded: ``PAIRS`` pairs of a window and an item. A
benchmark of more pairs is dealt by hash into several automata of that size, which scan one after
another; between them the documents with what was found so far are written as a table. A pair is
in exactly one of them and hits are united, so the result does not depend on the number.

Cases: null and empty texts have no words and no hits. Very long texts are scanned whole, in
stretches that carry the automaton's state on. Repeated documents give repeated results, repeated
items count once, items with one text are all named. An item with a null id marks words and is not
named; a null item text has no window. Empty tables: no documents give no rows, no items no hits.
Columns of the input are kept; a name that clashes with a result is an error unless ``out`` (the
prefix of all results) is changed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rungwork.llm.linking import release_memory
from rungwork.session import cut_lineage

WINDOW = 10
PAIRS = 100_000  # of a window and an item in one automaton: some 50 MB in a task
STRETCH = 1 << 22  # bytes scanned at once
# Bytes of words, lower-cased; all others part words.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
IN_WORD = np.array([b != 0x20 for b in WORD_BYTES])
FOUND = "n_words long, n_hit long, spans array<struct<first:long,last:long>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def stretches(plain: bytes, size: int = STRETCH) -> Iterator[list[bytes]]:
    """The words of normalised bytes, cut between words into lists of about ``size`` bytes."""
    start = 0
    while start < len(plain):
        stop = len(plain) if start + size >= len(plain) else plain.find(b" ", start + size)
        stop = len(plain) if stop < 0 else stop
        yield plain[start:stop].split()
        start = stop


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (item, words): the windows of every item as words joined by one blank."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(whole)
                size = min(window, len(words))
                for first in range(0, len(words) - size + 1 if size else 0, 10_000):
                    last = min(first + 10_000, len(words) - size + 1)
                    joined = list({b" ".join(words[k : k + size]) for k in range(first, last)})
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(joined), pa.string()), pa.array(joined, pa.binary())], names=["item", "words"])

    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, "item string, words binary").distinct()


class Scanner:
    """Automaton over (window, item) pairs."""

    def __init__(self, pairs: list[tuple[bytes, str | None]]):
        numbers: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        self.items: list[set[str]] = []
        self.sizes: list[int] = []
        places: dict[bytes, int] = {}
        for window, item in pairs:
            place = places.setdefault(window, len(self.items))
            if place == len(self.items):
                path = tuple(numbers.setdefault(word, len(numbers) + 1) for word in window.split(b" "))
                self.automaton.add_word(path, place)
                self.items.append(set())
                self.sizes.append(len(path))
            if item is not None:
                self.items[place].add(item)
        self.number = numbers.get
        if pairs:
            self.automaton.make_automaton()

    def runs(self, text: str | None) -> tuple[int, list[list[int]], set[str]]:
        """Words, runs [first, behind last] of hit words, and the items of the windows found."""
        at, found, items, search = 0, [], set(), None
        seen: set[int] = set()
        for words in stretches((text or "").encode().translate(WORD_BYTES)):
            if self.items:
                path = tuple(map(self.number, words, repeat(0)))
                if search is None:
                    search = self.automaton.iter(path)
                else:
                    search.set(path)  # goes on from the state reached, and counts places on
                for last, place in search:
                    seen.add(place)
                    found.append((last + 1 - self.sizes[place], last + 1))
            at += len(words)
        for place in seen:
            items |= self.items[place]
        return at, join_runs(found), items


def join_runs(runs: list) -> list[list[int]]:
    """Overlapping or touching runs as one."""
    out: list[list[int]] = []
    for first, behind in sorted(map(tuple, runs)):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], behind)
        else:
            out.append([first, behind])
    return out


def word_offsets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character offsets of the words of a text: starts, and places behind their ends."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    inside = np.concatenate([[False], IN_WORD[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters that begin before a byte
    return chars[edges[::2]], chars[edges[1::2]]


_SCANNERS: dict[str, Scanner] = {}


def _scanner(name: str, shared) -> Scanner:
    """The automaton of a broadcast, built once a worker."""
    if name not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[name] = Scanner(shared.value)
    return _SCANNERS[name]


def scan(docs: DataFrame, windows: DataFrame, text: str = "text", out: str = "", pairs: int = PAIRS) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``spans`` and ``items`` to every document.

    ``spans`` are the character offsets [first, last) of each run of hit words, from its first
    word's start to its last word's end; ``items`` are the named items, sorted as strings.
    """
    names = [f"{out}{n}" for n in ("n_words", "n_hit", "spans", "items")]
    if clash := set(map(str.lower, names)) & set(map(str.lower, docs.columns)):
        raise ValueError(f"columns {sorted(clash)} are there already; choose another out=")
    spark = docs.sparkSession
    windows = cut_lineage(windows)
    parts = max(1, -(-windows.count() // pairs))
    dealt = windows.withColumn("part", F.pmod(F.xxhash64("item", "words"), F.lit(parts)))
    fields = T._parse_datatype_string(FOUND).fields
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, f.dataType) for n, f in zip(names, fields)]])
    place = docs.columns.index(text)
    arrow = [pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.list_(pa.string())]
    result = docs
    for part in range(parts):
        some = [(bytes(row.words), row.item) for row in dealt.where(F.col("part") == part).collect()]  # about PAIRS at most
        shared, name = spark.sparkContext.broadcast(some), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name, first=part == 0) -> Iterator[pa.RecordBatch]:
            scanner = _scanner(name, shared)
            for batch in batches:
                rows: list[list] = [[], [], [], []]
                before = [c.to_pylist() for c in batch.columns[-2:]] if not first else None
                for k, whole in enumerate(batch.column(place).to_pylist()):
                    n, runs, items = scanner.runs(whole)
                    starts, ends = word_offsets(whole) if runs or before and before[0][k] else (None, None)
                    if before and before[0][k]:
                        runs = join_runs(runs + [[int(np.searchsorted(starts, s["first"])), int(np.searchsorted(ends, s["last"])) + 1] for s in before[0][k]])
                    rows[0].append(n)
                    rows[1].append(sum(b - a for a, b in runs))
                    rows[2].append([{"first": int(starts[a]), "last": int(ends[b - 1])} for a, b in runs])
                    rows[3].append(sorted(items.union(before[1][k]) if before else items))
                kept = batch.columns if first else batch.columns[:-4]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, t) for c, t in zip(rows, arrow)]], names=schema.names)
            release_memory()

        result = result.mapInArrow(run, schema)
        if part + 1 < parts:
            result = cut_lineage(result)
    return result


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, out: str = "") -> DataFrame:
    """``scan`` with the windows of a benchmark (item_id, text)."""
    return scan(docs, item_windows(benchmark, window=window), text, out)


# The same rows in SQL: windows and document word runs of the windows' sizes are joined as strings.
SQL = """
WITH lowered AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
    FROM documents
),
item AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
    FROM benchmark
),
placed AS (SELECT item_id, ws, least(10, len(ws)) AS k, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM item WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS run FROM placed),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM lowered CROSS JOIN sizes WHERE len(ws) >= k),
runs AS (SELECT r, k, i, array_to_string(ws[i:i + k - 1], ' ') AS run FROM places),
hits AS (SELECT r, d.k, i, item_id FROM runs d JOIN windows w ON d.run = w.run AND d.k = w.k),
words AS (SELECT r, count(DISTINCT word) AS n FROM (SELECT r, unnest(range(i, i + k)) AS word FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM lowered LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""
