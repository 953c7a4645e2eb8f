"""Byte-level BPE encoding and decoding over length-bucketed padded matrices.

Text is cut by the public split pattern, each piece is encoded by itself. Pieces not seen
before in a task are put into numpy matrices of similar byte length, one piece per row. Each
round every row merges its minimum-rank pair at its leftmost place, and at the later places
that do not overlap it (they have the same rank and would come next; a merge never makes a
pair of a smaller rank in such vocabularies). Ranks come from a hashed table of id pairs;
merged cells are squeezed out and finished rows leave the matrix.

Cases: null or empty text has no tokens. Very long texts and pieces are encoded whole; a long
piece gets a matrix of its own. Repeated rows give repeated results. Columns of the input are
kept; output names must be new (``out`` is the prefix of all of them).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rungwork.llm.linking import POWERS, mix64, release_memory

NONE = np.int32(2**31 - 1)  # rank of a pair that does not merge
CELLS = 1 << 20  # cells of one matrix at most, unless a single piece is longer
CACHED_PIECES = 100_000  # pieces a task remembers; then it starts anew
LISTED_PIECES = 2_000_000  # the same where they are remembered in arrays, some 40 bytes each


class Vocabulary:
    """Token bytes by rank, and the hashed table of pairs that merge."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.names = [str(i) for i in range(size)]
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self._build(np.array(keys, dtype=np.uint64), np.array(values, dtype=np.int32))

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(8, int(len(keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.ranks = np.full(1 << bits, NONE, dtype=np.int32)
        self.depth = 0
        at, left = self._home(keys), np.arange(len(keys))
        mask = len(self.slots) - 1
        while len(left):  # linear probing; of equal places one key wins a round
            self.depth += 1
            place = at[left]
            free = self.slots[place] == np.iinfo(np.uint64).max
            _, first = np.unique(place[free], return_index=True)
            won = left[free][first]
            self.slots[at[won]] = keys[won]
            self.ranks[at[won]] = values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each merged pair, ``NONE`` where it does not merge."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at, mask = self._home(keys), len(self.slots) - 1
        out = np.where(self.slots[at] == keys, self.ranks[at], NONE)
        open_ = np.flatnonzero((self.slots[at] != keys) & (self.slots[at] != np.iinfo(np.uint64).max))
        for _ in range(self.depth):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & mask
            seen = self.slots[at[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (seen != np.iinfo(np.uint64).max)]
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(read_ranks(path))


GAP, SPACE, LETTER, NUMBER, OTHER = range(5)  # classes of code points; GAP stands between texts
# Fixed values of the split pattern that the class cutter knows: the endings it keeps whole.
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point, from the properties that the pattern names."""
    import regex

    everything = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for kind, name in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        for run in regex.findall(f"(?:{name})+", everything):
            out[ord(run[0]) : ord(run[-1]) + 1] = kind
    return out


def piece_starts(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the known pattern starts a piece; each text of ``points`` ends with a GAP.

    A run of one class is a piece and takes one blank before it along. Of white space before
    other text, the last character stands apart; at the end of a text the run stays whole.
    """
    starts = np.ones(len(points), dtype=bool)
    before, here = kind[:-1], kind[1:]
    starts[1:] = (before != here) & ~((points[:-1] == 32) & (here >= LETTER))
    last = np.zeros(len(points), dtype=bool)  # last of a run of white space before other text
    last[:-1] = (before == SPACE) & (here >= LETTER)
    starts |= last
    quotes = np.flatnonzero((points == 39) & starts)
    for ending in ENDINGS:
        size = len(ending)
        fits = quotes[quotes + size < len(points)]
        for k, letter in enumerate(ending):
            fits = fits[points[fits + 1 + k] == ord(letter)]
        for k in range(size):
            starts[fits + 1 + k] = False
        starts[fits + 1 + size] = True
    return starts


def merge_matrix(ids: np.ndarray, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Encode the rows of a matrix of byte ids padded by -1: ids row after row, and ids a row."""
    counts = np.zeros(len(ids), dtype=np.int64)
    rows, closed = np.arange(len(ids)), []
    ranks = np.full(ids.shape, NONE, dtype=np.int32)  # of each cell and the one to its right
    both = np.flatnonzero((ids[:, 1:] >= 0).ravel())
    r, c = both // max(1, ids.shape[1] - 1), both % max(1, ids.shape[1] - 1)
    ranks[r, c] = voc.pair_ranks(ids[r, c], ids[r, c + 1])
    while len(rows):
        best = ranks.min(axis=1)
        done = best == NONE
        if done.any():
            ready = ids[done]
            counts[rows[done]] = (ready >= 0).sum(axis=1)
            closed.append((rows[done], ready[ready >= 0]))
            rows, ids, ranks, best = rows[~done], ids[~done], ranks[~done], best[~done]
            if not len(rows):
                break
        hit = ranks == best[:, None]
        if (hit[:, 1:] & hit[:, :-1]).any():  # x x x: take every second place of a run
            place = np.arange(hit.shape[1])
            start = hit.copy()
            start[:, 1:] &= ~hit[:, :-1]
            since = place - np.maximum.accumulate(np.where(start, place, 0), axis=1)
            hit &= since % 2 == 0
        np.copyto(ids, np.broadcast_to(best[:, None], ids.shape), where=hit)
        keep = ids >= 0
        keep[:, 1:] &= ~hit[:, :-1]
        stale = hit.copy()  # cells with a new right neighbour or a new id
        stale[:, :-1] |= hit[:, 1:]
        stale[:, :-2] |= hit[:, 2:] if hit.shape[1] > 2 else False
        lengths = keep.sum(axis=1)
        width = int(lengths.max())
        filled = np.arange(width) < lengths[:, None]
        packed, moved, redo = np.full(filled.shape, -1, np.int32), np.full(filled.shape, NONE, np.int32), np.zeros(filled.shape, bool)
        packed[filled], moved[filled], redo[filled] = ids[keep], ranks[keep], stale[keep]
        ids, ranks = packed, moved
        r, c = np.nonzero(redo)
        inside = c + 1 < lengths[r]
        ranks[r[~inside], c[~inside]] = NONE
        r, c = r[inside], c[inside]
        ranks[r, c] = voc.pair_ranks(ids[r, c], ids[r, c + 1])
    out, at = np.empty(int(counts.sum()), dtype=np.int32), np.concatenate([[0], np.cumsum(counts)])
    for which, flat in closed:
        sizes = counts[which]
        shift = np.repeat(at[which] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        out[shift + np.arange(len(flat))] = flat
    return out, counts


def encode_flat(pieces: list[bytes], voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids piece after piece, and ids a piece; pieces share a matrix with others of similar length."""
    sizes, parts = np.zeros(len(pieces), np.int64), []
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    start = int(np.searchsorted(ordered, 1))
    while start < len(order):
        longest = max(4, int(ordered[start]) * 5 // 4)
        stop = int(np.searchsorted(ordered, longest, side="right"))
        stop = min(stop, start + max(1, CELLS // longest))
        chosen = order[start:stop]
        matrix = np.full((len(chosen), int(ordered[stop - 1])), -1, dtype=np.int32)
        flat = voc.byte_ids[np.frombuffer(b"".join(pieces[i] for i in chosen), dtype=np.uint8)]
        matrix[np.arange(matrix.shape[1]) < lengths[chosen][:, None]] = flat
        ids, sizes[chosen] = merge_matrix(matrix, voc)
        parts.append((chosen, ids))
        start = stop
    out, at = np.empty(int(sizes.sum()), dtype=np.int32), np.cumsum(sizes) - sizes
    for chosen, ids in parts:
        out[spans(at[chosen], sizes[chosen])] = ids
    return out, sizes


def spans(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each span, span after span."""
    return np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def encode_pieces(pieces: list[bytes], voc: Vocabulary) -> list[list[int]]:
    """Ids of each piece."""
    ids, sizes = encode_flat(pieces, voc)
    ids, ends = ids.tolist(), np.cumsum(sizes).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends)]


class Encoder:
    """Encodes texts of one task and remembers the pieces it has met.

    ``pieces`` cuts a group of texts at once: characters become classes, class changes become
    starts, and pieces are told apart by a 64-bit hash and their length. Another split pattern
    than the known one goes through the Unicode matcher instead.
    """

    def __init__(self, path: str, pattern: str):
        self.voc, self.pattern = vocabulary(path), pattern
        self.forget()

    def forget(self) -> None:
        self.place: dict[int | str, int] = {}
        self.ids: list[list[int]] = []
        self.named: list[bytes] = []  # decimal ids, each with a blank after it
        self.plain: list[bytes] = []  # what the ids decode to

    def learn(self, pieces: list[str], keys: list) -> None:
        for key, ids in zip(keys, encode_pieces([p.encode() for p in pieces], self.voc)):
            self.place[key] = len(self.ids)
            self.ids.append(ids)
            self.named.append("".join([self.voc.names[i] + " " for i in ids]).encode())
            self.plain.append(b"".join([self.voc.tokens[i] for i in ids]))

    def pieces(self, texts: list[str]) -> Iterator[list[int]]:
        """Per text, the places of its pieces in what is remembered."""
        if len(self.ids) > CACHED_PIECES:
            self.forget()
        if self.pattern != KNOWN_PATTERN:
            import regex

            cut = [regex.findall(self.pattern, text) for text in texts]
            fresh = list(set(chain.from_iterable(cut)).difference(self.place))
            self.learn(fresh, fresh)
            for words in cut:
                yield [self.place[w] for w in words]
            return
        joined, at, to, unique, inverse, stops = self.cut(texts)
        listed = unique.tolist()
        known = [self.place.get(k, -1) for k in listed]
        fresh = [i for i, k in enumerate(known) if k < 0]
        self.learn([joined[at[i] : to[i]] for i in fresh], [listed[i] for i in fresh])
        for i in fresh:
            known[i] = self.place[listed[i]]
        everything = np.array(known)[inverse]
        for a, b in zip([0, *(stops[:-1] + 1).tolist()], stops.tolist()):
            yield everything[a:b].tolist()

    def cut(self, texts: list[str]) -> tuple[str, list[int], list[int], np.ndarray, np.ndarray, np.ndarray]:
        """Joined texts, where each different piece is first shown, their hashes, the piece at each place, and the places of the gaps."""
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        gaps = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))) - 1
        kind = classes()[points]
        kind[gaps] = GAP
        starts = piece_starts(points, kind)
        starts[gaps] = True
        starts[gaps[:-1] + 1] = True
        begin = np.flatnonzero(starts)
        up, down = POWERS.upto(len(points))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(points) * up, dtype=np.uint64)])
        end = np.append(begin[1:], len(points))
        keys = (sums[end] - sums[begin]) * down[begin] ^ mix64(end - begin)
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        return joined, begin[first].tolist(), end[first].tolist(), unique, inverse, np.searchsorted(begin, gaps)

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        for places in self.pieces(texts):
            yield list(chain.from_iterable(map(self.ids.__getitem__, places)))

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Tokens, sha256 of the decimal ids, sha256 of the decoded bytes."""
        for places in self.pieces(texts):
            named = b"".join(map(self.named.__getitem__, places))
            plain = b"".join(map(self.plain.__getitem__, places))
            yield named.count(b" "), hashlib.sha256(named[:-1]).hexdigest(), hashlib.sha256(plain).hexdigest()


class ArrayEncoder(Encoder):
    """Gives ids only, as arrays: what is remembered of a piece are its hash and ids, in sorted and flat arrays."""

    def forget(self) -> None:
        super().forget()
        self.keys, self.at, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def add(self, keys: np.ndarray, pieces: list[str]) -> None:
        ids, sizes = encode_flat([p.encode() for p in pieces], self.voc)
        place = np.searchsorted(self.keys, keys)
        self.at = np.insert(self.at, place, len(self.flat) + np.cumsum(sizes) - sizes)
        self.sizes = np.insert(self.sizes, place, sizes)
        self.keys = np.insert(self.keys, place, keys)
        self.flat = np.concatenate([self.flat, ids])

    def arrays(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Per text its ids."""
        if self.pattern != KNOWN_PATTERN:
            for ids in self.encode(texts):
                yield np.array(ids, np.int32)
            return
        if len(self.keys) > LISTED_PIECES:
            self.forget()
        joined, at, to, unique, inverse, stops = self.cut(texts)
        place = np.searchsorted(self.keys, unique)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == unique[known]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            self.add(unique[fresh], [joined[at[i] : to[i]] for i in fresh.tolist()])
            place = np.searchsorted(self.keys, unique)
        place = place[inverse]
        sizes = self.sizes[place]
        sizes[stops] = 0  # gaps between texts
        ids = self.flat[spans(self.at[place], sizes)]
        ends = np.cumsum(sizes)[stops].tolist()
        for a, b in zip([0, *ends], ends):
            yield ids[a:b]


def _text_groups(batch: pa.RecordBatch, column: str, most_chars: int = 500_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A batch in slices whose texts stay small together; one text is never cut."""
    start, size, texts = 0, 0, []
    for i, text in enumerate(batch.column(batch.schema.names.index(column))):
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= most_chars or i == len(batch) - 1:
            yield batch.slice(start, i + 1 - start), texts
            start, size, texts = i + 1, 0, []


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "", keep_ids: bool = True, digests: bool = True) -> DataFrame:
    """Add ``ids`` (unless ``keep_ids`` is false) and, with ``digests``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    ``ids_sha256`` is over the decimal ids joined by one space, ``decoded_sha256`` over the bytes
    that the ids decode to. Works row by row, without a shuffle.
    """
    names = [f"{out}{n}" for n in ["ids"] * keep_ids + ["n_tokens", "ids_sha256", "decoded_sha256"] * digests]
    if clash := set(names) & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already; choose another out=")
    kinds = [T.ArrayType(T.IntegerType())] * keep_ids + [T.LongType(), T.StringType(), T.StringType()] * digests
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for whole in batches:
            for batch, texts in _text_groups(whole, text):
                more = [pa.array(list(encoder.encode(texts)), pa.list_(pa.int32()))] if keep_ids else []
                if digests:
                    found = zip(*encoder.digests(texts))
                    more += [pa.array(c, k) for c, k in zip(found, (pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])
        del encoder
        release_memory()

    return docs.mapInArrow(run, schema)


def decode(frame: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that an array of ids stands for; a null array gives null, unknown ids an error."""
    schema = T.StructType([*frame.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(path).tokens
        for batch in batches:
            rows = batch.column(batch.schema.names.index(ids)).to_pylist()
            if any(i < 0 for row in rows if row for i in row):
                raise ValueError("negative token id")
            plain = [None if row is None else b"".join(map(tokens.__getitem__, row)) for row in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(plain, pa.binary())], names=[*batch.schema.names, out])

    return frame.mapInArrow(run, schema)
