"""Exact Jaccard self-join of documents on word n-grams by rare-first prefix filtering.

A document's set is hashed to 64 bits per n-gram; equal sets are one class. N-grams are ordered
by how many documents hold them, rarest first: the counts of all documents go into a sketch of
fixed size (a collision makes an n-gram look more frequent, which only moves it back in an order
that is the same for all). Two sets of the asked similarity share an n-gram among their first
n - ceil(t n) + 1, so only those are shuffled, once, with size and position. In every run of
equal n-grams the length and positional filters leave candidates. Runs of more than ``RUN``
classes name no pairs: their members with a possible partner are put into one group per leader,
and large groups are cut into cells of two blocks, so no group is expanded. Each candidate or cell gets a packed
text per class, less than half its set, and makes the full sets where they are compared; a suffix
bound over parts of the hash space drops pairs before the intersection.
Only links that join something new in their cell leave it; the components are those of all links.

Cases: null or empty text, or white space alone, is an empty set that links with nothing; fewer
words than ``n`` are one n-gram. Very long texts are read whole. Repeated rows get equal results;
rows of one id with different texts are one node. Rows with a null id link with nothing and have
a null component. Empty tables give no row. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwork.llm.linking import components, mix64, prefix_hashes, release_memory, slice_hashes
from rungwork.session import cut_lineage

SKETCH_BITS = 20
BLOCKS = 32  # the sketch is summed in so many parts
RUN = 3  # classes in a run up to which pairs are named
FILTERED = 64  # classes in a run up to which those without a possible partner are left out
CELL = 2048  # classes in a block of a large group
BYTES = 1 << 17  # of texts whose sets are made together, unless a single text is longer
SLOTS = 1 << 20  # of the broadcast filter of candidate ids
PIVOTS = np.arange(1, 64, dtype=np.uint64) << np.uint64(58)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], dtype=np.uint64)


def shingle_sets(texts: list[str | None], n: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams; a-z for A-Z, words end at ASCII blanks."""
    raw = [(t or "").encode().lower() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[0::2], edge[1::2]
    words = slice_hashes(prefix_hashes(data), begin, end)
    stops = np.cumsum([len(r) + 1 for r in raw])  # where each text ends in the data
    upto = np.searchsorted(begin, stops)
    grams = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
    for k in range(n):
        grams += words[k : len(words) - n + 1 + k] * _ODD[k % 10] + np.uint64(k)
    grams = mix64(grams)
    out, first = [], 0
    for last in upto.tolist():
        if last - first >= n:
            out.append(np.unique(grams[first : last - n + 1]))
        elif last > first:
            short = (words[first:last] * _ODD[: last - first]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix64(short ^ mix64(np.array([last - first]))))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        first = last
    return out


def set_key(values: np.ndarray) -> int:
    """One signed 64-bit name for a set of sorted hashes."""
    sums = np.array([mix64(values).sum(dtype=np.uint64), mix64(values ^ _ODD[2]).sum(dtype=np.uint64), len(values)], dtype=np.uint64)
    return int(mix64((mix64(sums) * _ODD[:3]).sum(dtype=np.uint64, keepdims=True))[0].astype(np.int64))


def prefix_length(n: np.ndarray | int, percent: int):
    return n - -(-n * percent // 100) + 1


def _parts(sizes: np.ndarray, rows: int = 256) -> Iterator[tuple[int, int]]:
    """Start and length of parts of ``rows`` rows and ``BYTES`` bytes at most; one larger row is a part."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + BYTES, side="right"))))
        yield start, stop - start
        start = stop


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
        for start, many in _parts(sizes):
            part = batch.slice(start, many)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def _describe(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])
        for ids, texts in _texts(batches):
            sets = shingle_sets(texts, n)
            every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            np.add.at(counts, (every >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
            none = [None] * len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip((ids, [len(s) for s in sets], [set_key(s) for s in sets], none, none), schema)], schema=schema
            )
        for k, part in enumerate(np.split(counts, BLOCKS)):
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], f.type) for v, f in zip((None, None, None, k, zlib.compress(part.tobytes(), 1)), schema)], schema=schema
                )
        del counts
        release_memory()

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            part = np.frombuffer(zlib.decompress(packed.as_py()), dtype=np.uint32).astype(np.uint64)
            sums[block] = sums[block] + part if block in sums else part
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())], names=["block", "counts"])


def sketch_of(described: DataFrame) -> np.ndarray:
    """The summed sketch: 2**SKETCH_BITS counts, whatever the input."""
    parts = described.where("block is not null").select("block", "counts").repartition(BLOCKS, "block").mapInArrow(_sum_blocks, "block int, counts binary")
    out = np.zeros((BLOCKS, (1 << SKETCH_BITS) // BLOCKS), dtype=np.uint64)
    for row in parts.toLocalIterator():
        out[row.block] += np.frombuffer(zlib.decompress(row.counts), dtype=np.uint64)
    return out.ravel()


def _postings(n: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        for _, texts in _texts(batches):
            grams, sizes, keys = [], [], []
            for values in shingle_sets(texts, n):
                key = set_key(values)
                if not len(values) or key in seen:  # equal sets of a task come once
                    continue
                seen.add(key)
                order = np.argsort(counts[(values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                grams.append(values[order[: prefix_length(len(values), percent)]])
                sizes.append(len(values))
                keys.append(key)
            if len(seen) > 2_000_000:
                seen.clear()
            if not keys:
                continue
            many = np.array([len(g) for g in grams])
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.repeat(np.array(sizes, np.int64) << 32, many) | place), pa.array(np.repeat(np.array(keys), many))],
                names=["gram", "size_place", "cls"],
            )
        seen.clear()
        release_memory()

    return run


def _run_pairs(percent: int):
    """Candidates of runs of one n-gram; rows come sorted by n-gram and class.

    The first class of a large run is its leader, so runs of the same classes have the same one.
    """

    def similar(nx, px, ny, py):
        need = -(-percent * (nx + ny) // (100 + percent))
        fits = 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
        return fits & (1 + np.minimum(nx - px - 1, ny - py - 1) >= need)

    def work(gram, sp, cls, began, last: bool):
        """Pairs and members of whole runs, and the rows of a run that may go on; a class comes once."""
        size, place = sp >> 32, sp & 0xFFFFFFFF
        starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        lengths = np.diff(np.append(starts, len(gram)))
        run = np.repeat(np.arange(len(starts)), lengths)
        big = lengths > FILTERED
        if began is not None and len(gram) and gram[0] == began[0]:
            big[0] = True
        centre, member, clique = [], [], []
        few, usual = lengths[run] <= RUN, ~big[run]
        paired = np.zeros(len(gram), dtype=bool)
        for d in range(1, FILTERED):
            i = np.flatnonzero(usual[:-d] & (run[:-d] == run[d:])) if len(gram) > d else np.zeros(0, np.int64)
            if not len(i):
                break
            ok = i[similar(size[i], place[i], size[i + d], place[i + d])]
            paired[ok] = paired[ok + d] = True
            ok = ok[few[ok]]
            centre.append(cls[ok]), member.append(cls[ok + d]), clique.append(np.zeros(len(ok), bool))
        some = np.flatnonzero(paired & ~few)
        if len(some):
            first = np.concatenate([[True], run[some][1:] != run[some][:-1]])
            leader = cls[some[first]][np.cumsum(first) - 1]
            centre.append(leader), member.append(cls[some]), clique.append(np.ones(len(some), bool))
        in_big = np.flatnonzero(big[run])
        if len(in_big):
            leader = cls[starts[run[in_big]]].copy()
            if began is not None and gram[0] == began[0]:
                leader[run[in_big] == 0] = began[1]
            centre.append(leader), member.append(cls[in_big]), clique.append(np.ones(len(in_big), bool))
        return centre, member, clique

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[np.ndarray] | None = None
        began: tuple[int, int] | None = None  # n-gram and leader of a large run that goes on

        def emit(columns, last):
            nonlocal began
            centre, member, clique = work(*columns, began, last)
            names = ["centre", "member", "clique"]
            if centre:
                c, m, q = (np.concatenate(x) for x in (centre, member, clique))
                found = np.unique(np.stack([c, m, q.astype(np.int64)]), axis=1) if len(c) else np.zeros((3, 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), pa.array(found[2].astype(bool))], names=names)

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if tail is not None:
                columns = [np.concatenate(x) for x in zip(tail, columns)]
            gram, _, cls = columns
            if not len(gram):
                continue
            keep = np.ones(len(gram), dtype=bool)
            keep[1:] = (gram[1:] != gram[:-1]) | (cls[1:] != cls[:-1])  # copies of a class: classes count, not rows
            columns = [c[keep] for c in columns]
            gram = columns[0]
            cut = int(np.searchsorted(gram, gram[-1]))  # start of the run that may go on
            if len(gram) - cut > FILTERED or (began is not None and began[0] == gram[-1]):
                yield from emit(columns, False)  # a large run: its members may leave at once
                if began is None or began[0] != gram[-1]:
                    began = (gram[-1], columns[2][cut])
                tail = None
            else:
                if cut:
                    yield from emit([c[:cut] for c in columns], False)
                tail = [c[cut:] for c in columns]
        if tail is not None:
            yield from emit(tail, True)

    return run


def suffix_bound(x: np.ndarray, y: np.ndarray) -> int:
    """The most that two sorted sets can share: the smaller count in each part of the hash space."""
    a, b = (np.diff(np.concatenate([[0], np.searchsorted(s, PIVOTS), [len(s)]])) for s in (x, y))
    return int(np.minimum(a, b).sum())


def star_links(centre: np.ndarray, others: list[np.ndarray], percent: int) -> list[int]:
    """Which of the others have the similarity to the centre."""
    out = []
    for i, other in enumerate(others):
        need = -(-percent * (len(centre) + len(other)) // (100 + percent))
        if suffix_bound(centre, other) < need:
            continue
        short, long_ = (centre, other) if len(centre) < len(other) else (other, centre)
        at = np.minimum(np.searchsorted(long_, short), len(long_) - 1)
        if int((long_[at] == short).sum()) >= need:
            out.append(i)
    return out


def cell_links(sets: list[np.ndarray], block: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of a cell that join something new; pairs of one block only if there is one block."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), size)
    order = np.argsort(term, kind="stable")
    holders = owner[order]
    first = np.searchsorted(term[order], np.arange(term.max() + 2))
    at = np.concatenate([[0], np.cumsum(size)])
    label, links = np.arange(m), []
    across = len(np.unique(block)) > 1
    for x in range(m):
        terms = term[at[x] : at[x + 1]]
        shared = np.bincount(np.concatenate([holders[first[t] : first[t + 1]] for t in terms]), minlength=m)
        ok = 100 * shared >= percent * (size[x] + size - shared)
        ok[: x + 1] = False
        if across:
            ok &= block != block[x]
        ok &= label != label[x]
        near = np.flatnonzero(ok)
        if len(near):
            labels, one = np.unique(label[near], return_index=True)
            links += [(x, int(near[i])) for i in one]
            label[np.isin(label, labels)] = label[x]
    return links


def _verify(n: int, percent: int):
    """Links of cells; rows come sorted by cell, centre first. A row holds the packed text of its class."""

    def links_of(key, rows):
        clique, centre = key[0], key[1]
        ids = [r[0] for r in rows]
        sets = [r[1] for r in rows]
        if clique:
            found = cell_links(sets, np.array([r[2] for r in rows]), percent)
            return [(ids[a], ids[b]) for a, b in found]
        if ids[0] != centre:
            raise ValueError("a group has lost its centre")
        return [(ids[0], ids[1 + i]) for i in star_links(sets[0], sets[1:], percent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def flush():
            found = links_of(key, rows) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for i, many in _parts(batch.column(6).to_numpy()):
                *columns, _, packed = (c.to_pylist() for c in batch.slice(i, many).columns)
                sets = shingle_sets([zlib.decompress(p).decode() for p in packed], n)
                for clique, centre, low, high, member, block, values in zip(*columns, sets):
                    now = (clique, centre, low, high)
                    if now != key:
                        if key is not None:
                            yield flush()
                        key, rows = now, []
                    elif not clique and len(rows) > 512:  # a star of many arms goes by parts
                        yield flush()
                        rows = rows[:1]
                    rows.append((member, values, block))
        if key is not None:
            yield flush()
        rows = []
        release_memory()

    return run


def _packed(n: int):
    """Texts by the class of their set, packed; those without words have no class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches):
            some = [(set_key(s), t.encode()) for s, t in zip(shingle_sets(texts, n), texts) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in some], pa.int64()),
                    pa.array([len(t) for _, t in some], pa.int64()),
                    pa.array([zlib.compress(t, 1) for _, t in some], pa.binary()),
                ],
                names=["cls", "size", "packed"],
            )
        release_memory()

    return run


def without_covered(grouped: DataFrame) -> DataFrame:
    """Drop groups and pairs that lie within another group, where all their pairs are verified as well.

    The other group is that of the smallest leader of the group's own leader, so what is dropped is
    covered by a smaller leader's group, and following it up ends at one that stays.
    """
    inside = grouped.where("clique").select(F.col("centre").alias("g"), F.col("member").alias("m"))
    parents = cut_lineage(inside.where("g <> m").groupBy(F.col("m").alias("node")).agg(F.min("g").alias("parent")).where("parent < node"))
    named = grouped.join(parents, F.col("centre") == F.col("node"), "left").drop("node")
    held = named.join(inside, (F.col("parent") == F.col("g")) & (F.col("member") == F.col("m")), "left")
    held = cut_lineage(held.select("centre", "member", "clique", F.col("g").isNotNull().alias("held")))
    groups = held.where("clique").groupBy(F.col("centre").alias("of")).agg(F.every("held").alias("all")).where("all").select("of")
    kept = held.where("clique").join(cut_lineage(groups), F.col("centre") == F.col("of"), "left_anti").select("centre", "member", "clique")
    pairs = held.where("not clique and not held").select("centre", "member", "clique")
    other = pairs.join(parents, F.col("member") == F.col("node"))  # the same from the pair's other side
    gone = other.join(inside, (F.col("parent") == F.col("g")) & (F.col("centre") == F.col("m"))).select(F.col("centre").alias("c"), F.col("member").alias("d"))
    pairs = pairs.join(gone, (F.col("centre") == F.col("c")) & (F.col("member") == F.col("d")), "left_anti")
    return cut_lineage(kept.unionByName(pairs))


def describe(docs: DataFrame, n: int) -> DataFrame:
    """Written: a row per document (doc_id, n, cls), and the parts of the sketch."""
    return cut_lineage(docs.select("doc_id", "text").mapInArrow(_describe(n), "doc_id long, n long, cls long, block int, counts binary"))


def links(docs: DataFrame, described: DataFrame, n: int, percent: int) -> DataFrame:
    """Links between classes (a, b): enough of them to give the components of all links."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(sketch_of(described))
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    postings = texts.mapInArrow(_postings(n, percent, shared), "gram long, size_place long, cls long")
    runs = postings.repartition(F.col("gram")).sortWithinPartitions("gram", "cls")
    found = runs.mapInArrow(_run_pairs(percent), "centre long, member long, clique boolean")
    grouped = without_covered(cut_lineage(found.distinct()))
    stars = grouped.where("not clique")
    stars = stars.unionByName(stars.select("centre", F.col("centre").alias("member"), "clique").distinct())
    cliques = grouped.where("clique")
    blocks = cut_lineage(cliques.groupBy(F.col("centre").alias("of")).agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("blocks")))
    dealt = cliques.join(blocks, F.col("centre") == F.col("of")).withColumn("block", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = other.select("clique", "centre", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "member", "block").unionByName(
        stars.select("clique", "centre", F.lit(0).alias("low"), F.lit(0).alias("high"), "member", F.lit(0).alias("block"))
    )
    holders = described.where("doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("holder"))
    wanted = grouped.select(F.explode(F.array("centre", "member")).alias("cls")).distinct()
    chosen = cut_lineage(holders.join(wanted, "cls"))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    slots = chosen.select(F.pmod(F.xxhash64("holder"), F.lit(SLOTS)).alias("slot")).distinct()  # SLOTS rows at most
    likely = texts.withColumn("slot", slot).join(F.broadcast(slots), "slot", "left_semi").drop("slot")
    # any text of a class gives its set, so the texts that pass the filter are moved by class and meet the members there
    packed = likely.mapInArrow(_packed(n), "cls long, size long, packed binary").dropDuplicates(["cls"])
    full = members.join(packed, F.col("member") == F.col("cls")).select("clique", "centre", "low", "high", "member", "block", "size", "packed")
    first = (F.col("member") != F.col("centre")).alias("later")
    cells = full.repartition("clique", "centre", "low", "high").sortWithinPartitions("clique", "centre", "low", "high", first, "member")
    return cells.mapInArrow(_verify(n, percent), "a long, b long")


def jaccard_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, ``n_shingles`` and ``component_id`` (the smallest id reachable by links)."""
    described = describe(docs, n)
    rows = described.where("block is null").select("doc_id", "n", "cls")
    real = rows.where("doc_id is not null and n > 0")
    several = real.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("doc_id", "a")
    same_id = real.join(several, "doc_id").select("a", F.col("cls").alias("b"))
    found = components(links(docs, described, n, percent).unionByName(same_id))
    holders = real.groupBy("cls").agg(F.min("doc_id").alias("holder"))
    placed = holders.join(found, F.col("cls") == F.col("node"), "left").select("cls", "holder", F.coalesce("root", "cls").alias("root"))
    placed = cut_lineage(placed)
    smallest = cut_lineage(placed.groupBy(F.col("root").alias("of")).agg(F.min("holder").alias("component")))
    labels = cut_lineage(placed.join(smallest, F.col("root") == F.col("of")).select(F.col("cls").alias("of_cls"), "component"))
    own = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return rows.join(labels, F.col("cls") == F.col("of_cls"), "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
