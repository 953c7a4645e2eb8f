"""Packing token ids into rows of fixed length by best-fit decreasing.

Documents longer than a row are split into full rows and a rest; every piece keeps its document
and its offset there, so nothing is lost. Pieces are placed longest first, each into the row with
the least free room that still takes it; a segment tree over the free room (0 to the row length)
finds that row in logarithmic time. A task packs its documents in groups of about
``group_tokens`` ids, so memory is bounded and no shuffle is needed; a row never mixes groups.

A packed row has ``ids`` (little-endian unsigned integers, padded to the full length),
``cu_seqlens`` (segment ends, from 0), ``position_resets`` (where positions start at 0 again),
``doc_ids`` and ``doc_offsets`` of the segments, and ``n_tokens`` without padding.

Cases: null or empty ids have no segment unless an end id is added to every document; a null
doc_id stays null in ``doc_ids``; a null among ids is an error; repeated rows are packed as often as they come; very long
documents are split, never cut. Ids that do not fit the integer width are an error. Empty tables
give no row. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwork.llm.bpe_matrix import ArrayEncoder
from rungwork.llm.bpe_matrix import _text_groups as text_slices
from rungwork.llm.linking import release_memory
from rungwork.session import checkpoint_folder

PACKED = "pack_id long, doc_ids array<long>, doc_offsets array<long>, cu_seqlens array<int>, position_resets array<int>, n_tokens int, ids binary"


class RoomTree:
    """Segment tree over free room: which rows have exactly so much, and the next larger room."""

    def __init__(self, length: int):
        self.base = 1 << length.bit_length()
        self.count = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.base
        while node:
            self.count[node] += 1
            node //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the row with the least room of at least ``need``."""
        node = need + self.base
        while not self.count[node]:
            while node & 1:  # a right child: go up to where the tree has something further right
                node //= 2
            if node == 0:
                return None
            node += 1
            if node & (node - 1) == 0:  # past the right edge
                return None
        while node < self.base:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.base
        while node:
            self.count[node] -= 1
            node //= 2
        return room, self.rows[room].pop()


def best_fit(lengths: list[int], length: int) -> list[list[int]]:
    """Rows as lists of piece numbers; every piece is at most ``length`` long."""
    tree, rows = RoomTree(length), []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[piece])
        if found is None:
            found = (length, len(rows))
            rows.append([])
        room, row = found
        rows[row].append(piece)
        if room > lengths[piece]:
            tree.add(room - lengths[piece], row)
    return rows


def position_ids(cu_seqlens: list[int]) -> np.ndarray:
    """Positions of a packed row: they start at 0 with every segment."""
    ends = np.asarray(cu_seqlens)
    return np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))


def pack_group(docs: list[tuple[int | None, np.ndarray]], length: int, pad_id: int, dtype: str) -> list[tuple]:
    pieces = [(doc, at, ids[at : at + length]) for doc, ids in docs for at in range(0, len(ids), length)]
    out = []
    for row in best_fit([len(p[2]) for p in pieces], length):
        chosen = [pieces[i] for i in row]
        ends = np.concatenate([[0], np.cumsum([len(p[2]) for p in chosen])])
        ids = np.full(length, pad_id, dtype=dtype)
        ids[: ends[-1]] = np.concatenate([p[2] for p in chosen])
        out.append(([p[0] for p in chosen], [p[1] for p in chosen], ends.tolist(), ends[:-1].tolist(), int(ends[-1]), ids.tobytes()))
    return out


class Packer:
    """Packs the documents of one task in groups; ``batches`` are ready rows."""

    def __init__(self, length: int, pad_id: int, dtype: str, group_tokens: int):
        self.length, self.pad_id, self.dtype, self.group_tokens = length, pad_id, dtype, group_tokens
        self.held: list[tuple[int | None, np.ndarray]] = []
        self.size, self.number = 0, TaskContext.get().partitionId() << 33

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((doc, ids))
        self.size += len(ids)
        if self.size >= self.group_tokens:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        rows = [(self.number + i, *row) for i, row in enumerate(pack_group(self.held, self.length, self.pad_id, self.dtype))]
        self.number += len(rows)
        self.held, self.size = [], 0
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.binary())
        names = [part.split()[0] for part in PACKED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)


def pack(frame: DataFrame, length: int = 4096, end_id: int | None = None, pad_id: int = 0, dtype: str = "<u2", group_tokens: int = 2_000_000) -> DataFrame:
    """Pack rows of (doc_id, ids array<int>); see the module for the columns."""
    top = np.iinfo(np.dtype(dtype)).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(length, pad_id, dtype, group_tokens)
        for batch in batches:
            docs, lists = batch.column(0).to_pylist(), batch.column(1)
            for k, doc in enumerate(docs):
                values = lists[k].values
                if values is not None and values.null_count:
                    raise ValueError(f"document {doc} has a null among its ids")
                ids = np.zeros(0, np.int32) if values is None else values.to_numpy(zero_copy_only=False)
                if end_id is not None:
                    ids = np.append(ids, np.int32(end_id))
                if len(ids) and not (0 <= ids.min() and ids.max() <= top):
                    raise ValueError(f"document {doc} has an id outside of {dtype}")
                yield from packer.add(doc, ids.astype(dtype))
        if packer.held:
            yield packer.flush()

    return frame.select("doc_id", "ids").mapInArrow(run, PACKED)


def pack_texts(
    docs: DataFrame, path: str, pattern: str, length: int = 4096, end_id: int | None = None, pad_id: int = 0, dtype: str = "<u2", group_tokens: int = 2_000_000
) -> DataFrame:
    """Encode the texts of (doc_id, text) by the ranks of a file and pack them in the same pass.

    The same rows as ``pack`` over encoded ids, but the ids of a text never leave the task.
    """
    top = np.iinfo(np.dtype(dtype)).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ArrayEncoder(path, pattern)
        if max(len(encoder.voc.tokens) - 1, end_id or 0) > top:
            raise ValueError(f"the vocabulary has ids outside of {dtype}")
        packer = Packer(length, pad_id, dtype, group_tokens)
        last = np.array([] if end_id is None else [end_id], dtype=dtype)
        for whole in batches:
            for batch, texts in text_slices(whole, "text"):
                for doc, ids in zip(batch.column(0).to_pylist(), encoder.arrays(texts)):
                    yield from packer.add(doc, np.concatenate([ids.astype(dtype), last]))
        if packer.held:
            yield packer.flush()
        del encoder
        release_memory()

    return docs.select("doc_id", "text").mapInArrow(run, PACKED)


def written(packed: DataFrame, path: str | None = None) -> DataFrame:
    """Packed rows as Parquet (by default below the checkpoint folder), read back."""
    path = path or f"{checkpoint_folder(packed.sparkSession)}/packed-{uuid.uuid4().hex}"
    packed.write.parquet(path)
    return packed.sparkSession.read.schema(PACKED).parquet(path)


def write_packed(frame: DataFrame, path: str | None = None, **settings) -> DataFrame:
    """Write the packed rows of ``pack`` and read them back."""
    return written(pack(frame, **settings), path)


def unpack(packed: DataFrame, dtype: str = "<u2") -> DataFrame:
    """Segments again: (doc_id, doc_offset, ids) by document and offset give the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for docs, offsets, ends, data in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                ids = np.frombuffer(data, dtype=dtype).astype(np.int32)
                out += [(d, o, ids[a:b]) for d, o, a, b in zip(docs, offsets, ends, ends[1:])]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 3, kinds)], names=["doc_id", "doc_offset", "ids"])

    return packed.select("doc_ids", "doc_offsets", "cu_seqlens", "ids").mapInArrow(run, "doc_id long, doc_offset long, ids array<int>")


def summary(packed: DataFrame) -> DataFrame:
    """Packed rows with a digest for the matrix row."""
    return packed.select(*[c for c in packed.columns if c != "ids"], F.sha2("ids", 256).alias("ids_sha256"))
