"""Removal of long byte repeats with a run-compressed Burrows-Wheeler transform.

Every byte that a string of ``width`` bytes covers which also starts anywhere else is removed.
Each such string holds a ``GRAM``-byte anchor: the smallest hash among its grams. Anchors are a
few positions in a hundred bytes; those whose hash occurs once cannot lie in a repeat and are
dropped. Around each other anchor a frame of text is cut that holds all strings with it, and
frames of one anchor hash form a group, aligned at the anchor. Equal frames are one, with a count.
For the different frames of a group the transform is built column by column from the right: each
column is sorted stably by its byte on top of the order so far. In a run of equal bytes the
match with the neighbour in the order just grows by one; only at the ends of runs it is sampled
anew (the smallest match in between). So the matching statistics of all frames stream by, and
where a match of ``width`` bytes starts, the string repeats.

A group of more than ``GROUP`` different frames is not given to one task: its strings are counted
by their hashes instead, which combines before the shuffle and is exact as well.

Equal texts are one text with a count: texts of ``width`` bytes or more that occur in several
rows are removed whole. Texts and grams are told apart by 64-bit hashes. Cases: null or empty
text has 0 bytes and keeps the empty string; texts shorter than ``width`` keep all; very long
texts are read whole. A null id is kept as it is. Rows repeated are copies. Empty tables give no
row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwork.llm.linking import mix64, prefix_hashes, release_memory, slice_hashes
from rungwork.session import cut_lineage

GRAM = 64
GROUP = 20_000
SLOTS = 1 << 20  # of the broadcast filter of texts with repeats
PAD = 256


def anchors(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, gram hash) of the smallest gram of every string of ``width`` bytes."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    windows = width - GRAM + 1
    if len(data) < width:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    place = np.arange(len(data) - GRAM + 1)
    grams = slice_hashes(prefix_hashes(data), place, place + GRAM)
    low = np.uint64((1 << int(len(data)).bit_length()) - 1)
    least = (grams & ~low) | place.astype(np.uint64)  # ties go to the left
    span = 1
    while span * 2 <= windows:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < windows:
        least = np.minimum(least[: len(least) - (windows - span)], least[windows - span :])
    ends = np.cumsum(sizes)
    owner = np.searchsorted(ends, np.arange(len(least)), side="right")
    inside = np.arange(len(least)) + width <= ends[owner]
    at = (least[inside] & low).astype(np.int64)
    owner = owner[inside]
    first = np.ones(len(at), dtype=bool)
    first[1:] = at[1:] != at[:-1]
    at, owner = at[first], owner[first]
    return owner, at - (ends - sizes)[owner], grams[at]


def _grouped(texts: list[str | None], most: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    start, part, size = 0, [], 0
    for text in texts:
        part.append((text or "").encode())
        size += len(part[-1])
        if size >= most:
            yield start, part
            start, part, size = start + len(part), [], 0
    if part:
        yield start, part


def _anchor_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for k in range(0, len(batch), 512):
                keys = batch.column(0).slice(k, 512).to_pylist()
                for start, part in _grouped(batch.column(1).slice(k, 512).to_pylist()):
                    fresh = [i for i in range(len(part)) if keys[start + i] not in seen]
                    seen.update(keys[start + i] for i in fresh)
                    owner, at, gram = anchors([part[i] for i in fresh], width)
                    names = np.array([keys[start + i] for i in fresh], dtype=np.int64)[owner] if fresh else owner
                    yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(names), pa.array(at.astype(np.int32))], names=["gram", "cls", "pos"])
            if len(seen) > 1_000_000:
                seen.clear()
        release_memory()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (gram, cls, pos): those whose gram stands at several places."""
    tail: list[np.ndarray] | None = None  # the last row, and whether its gram was met before it
    met = False
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if tail is not None:
            columns = [np.concatenate(x) for x in zip(tail, columns)]
        gram, cls, pos = columns
        if not len(gram):
            continue
        new = np.ones(len(gram), dtype=bool)
        new[1:] = (gram[1:] != gram[:-1]) | (cls[1:] != cls[:-1]) | (pos[1:] != pos[:-1])
        gram, cls, pos = gram[new], cls[new], pos[new]
        again = np.zeros(len(gram), dtype=bool)
        again[1:] = gram[1:] == gram[:-1]
        again[0] = met
        keep = again.copy()
        keep[:-1] |= again[1:]
        tail, met = [c[-1:] for c in (gram, cls, pos)], bool(again[-1])
        yield pa.RecordBatch.from_arrays([pa.array(c[:-1][keep[:-1]]) for c in (gram, cls, pos)], names=["gram", "cls", "pos"])
    if tail is not None and met:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in tail], names=["gram", "cls", "pos"])


def _frames(width: int):
    reach = width - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                key, text, every, names_of = (batch.column(i)[k].as_py() for i in range(4))
                data = text.encode()
                for start in range(0, len(every), 512):  # a text of one repeated byte has an anchor at each place
                    places, grams = every[start : start + 512], names_of[start : start + 512]
                    bodies = [data[max(0, p - reach) : p + width] for p in places]
                    left = [min(p, reach) for p in places]
                    joined = np.frombuffer(b"".join(bodies), dtype=np.uint8)
                    ends = np.cumsum([len(b) for b in bodies])
                    names = slice_hashes(prefix_hashes(joined), ends - [len(b) for b in bodies], ends) ^ mix64(np.array(left))
                    columns = (grams, names.view(np.int64), [key] * len(places), places, left, bodies)
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["gram", "frame", "cls", "pos", "left", "body"])

    return run


def repeat_starts(bodies: list[bytes], left: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """Frame x offset: does the string of ``width`` bytes there stand in another frame of the group?

    ``group`` does not decrease; frames are aligned at their anchors.
    """
    reach = width - GRAM
    columns, n = reach + width, len(bodies)
    matrix = np.full((columns, n), PAD, dtype=np.uint16)
    for i, (body, before) in enumerate(zip(bodies, left.tolist())):
        matrix[reach - before : reach - before + len(body), i] = np.frombuffer(body, dtype=np.uint8)
    order, match = np.arange(n), np.zeros(n + 1, dtype=np.int32)  # match[i]: of order[i - 1] and order[i]
    out = np.zeros((reach + 1, n), dtype=bool)
    for column in range(columns - 1, -1, -1):
        key = group[order] * 512 + matrix[column, order]
        sort = np.argsort(key, kind="stable")
        key = key[sort]
        grown = np.zeros(n + 1, dtype=np.int32)
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        came, to = sort[same - 1], sort[same]
        run = to == came + 1  # neighbours before: the same run of the transform
        grown[same[run]] = match[to[run]] + 1
        ends = same[~run]
        if len(ends):
            bounds = np.stack([sort[ends - 1] + 1, sort[ends] + 1], axis=1).ravel()
            grown[ends] = np.minimum.reduceat(match, bounds)[::2] + 1
        order, match = order[sort], grown
        if column <= reach:
            out[column, order] = np.maximum(match[:-1], match[1:]) >= width
    return out.T


def covered(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Union of the strings that start at the given increasing places."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > width)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.concatenate([cut, [len(starts) - 1]])] + width).tolist()))


def _marks(width: int):
    reach = width - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(rows):
            grams = np.array([r[0] for r in rows])
            group = np.concatenate([[0], np.cumsum(grams[1:] != grams[:-1])])
            found = repeat_starts([r[4] for r in rows], np.array([r[3] for r in rows]), group, width)
            spans = []
            for i, (_, _, count, left, body) in enumerate(rows):
                ok = found[i].copy()
                if count > 1:
                    ok[:] = True
                ok[: reach - left] = False
                ok[max(0, reach - left + len(body) - width + 1) :] = False
                spans.append([x - reach for pair in covered(np.flatnonzero(ok), width) for x in pair])
            kept = [i for i, s in enumerate(spans) if s]
            return pa.RecordBatch.from_arrays(
                [pa.array([rows[i][0] for i in kept], pa.int64()), pa.array([rows[i][1] for i in kept], pa.int64()), pa.array([spans[i] for i in kept], pa.list_(pa.int32()))],
                names=["g", "f", "spans"],
            )

        for batch in batches:
            for k in range(0, len(batch), 1024):
                for row in zip(*[c.to_pylist() for c in batch.slice(k, 1024).columns]):
                    if len(held) >= 2048 and row[0] != held[-1][0]:
                        yield flush(held)
                        held = []
                    held.append(row)
        if held:
            yield flush(held)
        held = []
        release_memory()

    return run


def _windows(width: int):
    """Hashed strings of the frames of very large groups."""
    reach = width - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, frame, count, left, body in zip(*[c.to_pylist() for c in batch.columns]):
                n = max(0, len(body) - width + 1)
                at = np.arange(n)
                names = slice_hashes(prefix_hashes(np.frombuffer(body, np.uint8)), at, at + width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v] * n, pa.int64()) for v in (gram, frame, count)] + [pa.array((at - left).astype(np.int32)), pa.array(names.view(np.int64))],
                    names=["gram", "frame", "n", "rel", "window"],
                )

    return run


def _kept(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 256) for whole in batches for k in range(0, len(whole), 256)):
            out = []
            for k in range(len(batch)):
                doc_id, text, copies, spans = (batch.column(i)[k].as_py() for i in range(4))
                data = (text or "").encode()
                cover = np.zeros(len(data) + 1, dtype=np.int32)
                if copies and copies > 1 and len(data) >= width:
                    cover[0] += 1
                    cover[-1] -= 1
                for start, end in zip((spans or [])[::2], (spans or [])[1::2]):
                    cover[start] += 1
                    cover[end] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                out.append((doc_id, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def repeats(docs: DataFrame, width: int) -> DataFrame:
    """Per text (``cls``) with repeats: flat start, end pairs of covered bytes; cut by frames, so they may overlap."""
    texts = docs.select(F.xxhash64("text").alias("cls"), "text").where(F.octet_length("text") >= width)
    found = texts.mapInArrow(_anchor_rows(width), "gram long, cls long, pos int").repartition(F.col("gram")).sortWithinPartitions("gram", "cls", "pos")
    places = cut_lineage(found.mapInArrow(_shared, "gram long, cls long, pos int"))
    listed = places.groupBy(F.col("cls").alias("key")).agg(F.array_sort(F.collect_list(F.struct("pos", "gram"))).alias("at"))
    listed = listed.select("key", F.col("at.pos").alias("places"), F.col("at.gram").alias("grams"))
    cut = with_slots(texts, places).dropDuplicates(["cls"]).join(listed, F.col("cls") == F.col("key")).select("cls", "text", "places", "grams")
    framed = cut.mapInArrow(_frames(width), "gram long, frame long, cls long, pos int, left int, body binary")
    framed = cut_lineage(framed)
    frames = cut_lineage(framed.groupBy("gram", "frame").agg(F.count(F.lit(1)).alias("n"), F.first("left").alias("left"), F.first("body").alias("body")))
    large = cut_lineage(frames.groupBy(F.col("gram").alias("g")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("g"))
    usual = frames.join(large, F.col("gram") == F.col("g"), "left_anti").select("gram", "frame", "n", "left", "body")
    marks = usual.repartition(F.col("gram")).sortWithinPartitions("gram", "frame").mapInArrow(_marks(width), "g long, f long, spans array<int>")
    rest = frames.join(large, F.col("gram") == F.col("g"), "left_semi").select("gram", "frame", "n", "left", "body")
    windows = rest.mapInArrow(_windows(width), "gram long, frame long, n long, rel int, window long")
    often = cut_lineage(windows.groupBy(F.col("gram").alias("g"), F.col("rel").alias("r"), F.col("window").alias("w")).agg(F.sum("n").alias("m")).where("m > 1").drop("m"))
    again = windows.join(often, (F.col("gram") == F.col("g")) & (F.col("rel") == F.col("r")) & (F.col("window") == F.col("w")), "left_semi")
    pairs = F.flatten(F.collect_list(F.array(F.col("rel"), F.col("rel") + width)))
    marks = cut_lineage(marks.unionByName(again.groupBy(F.col("gram").alias("g"), F.col("frame").alias("f")).agg(pairs.alias("spans"))))
    hit = framed.select("gram", "frame", "cls", "pos").join(marks, (F.col("gram") == F.col("g")) & (F.col("frame") == F.col("f")))
    return hit.groupBy("cls").agg(F.flatten(F.collect_list(F.transform("spans", lambda x: x + F.col("pos")))).alias("spans"))


def with_slots(texts: DataFrame, wanted: DataFrame, negate: bool = False) -> DataFrame:
    """Rows whose ``cls`` may be among the wanted ones (or surely is not): a filter of SLOTS bits at most."""
    slots = wanted.select(F.pmod("cls", F.lit(SLOTS)).alias("slot")).distinct()
    return texts.withColumn("slot", F.pmod("cls", F.lit(SLOTS))).join(F.broadcast(slots), "slot", "left_anti" if negate else "left_semi").drop("slot")


def remove_repeats(docs: DataFrame, width: int = 200, keep_bytes: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the bytes that stay)."""
    if width < GRAM:
        raise ValueError(f"width must be at least {GRAM}")
    spans = repeats(docs, width).withColumn("copies", F.lit(1).cast("long"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("cls"))
    copied = rows.where(F.octet_length("text") >= width).groupBy("cls").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    nothing = F.array().cast("array<int>")
    marked = cut_lineage(
        spans.unionByName(copied.withColumn("spans", nothing)).groupBy("cls").agg(F.max("copies").alias("copies"), F.flatten(F.collect_list("spans")).alias("spans"))
    )
    named = marked.withColumnRenamed("cls", "key")
    touched = with_slots(rows, marked).join(named, F.col("cls") == F.col("key"), "left").select("doc_id", "text", "copies", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    free = with_slots(rows, marked, negate=True).select(
        "doc_id", F.octet_length(whole).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(whole, 256).alias("kept_sha256"), whole.alias("kept")
    )
    out = touched.mapInArrow(_kept(width), schema).unionByName(free)
    return out if keep_bytes else out.drop("kept")
