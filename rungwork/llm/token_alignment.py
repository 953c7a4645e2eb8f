"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Every text is encoded twice, and both token rows are laid over the bytes of one blank and the
text. Per batch, ``pandas.merge_asof`` keyed by document gives each token start the other side's
token that covers it; the union of both directions holds every overlapping pair once, since of
two tokens that overlap the later start lies in the other. Byte offsets where tokens of both sides
end cut the rows into groups.

Texts move through Python once: what is needed later (per document its distinct id pairs and how
often each is linked) is written as a table. The pairs' document counts are a grouping with
partial sums. They are joined back by broadcast only up to ``PAIRS`` pairs; beyond, by a shuffle
on the pair and a salt, since common pairs stand in nearly all documents.

Cases: a null or empty text, or one that a side does not give back byte by byte (white space or
characters that its tokenizer changes), has no tokens: zeros and an empty ``groups``. The strings
of special tokens are plain text. Very long texts are encoded whole, each in a batch of its own.
Repeated rows are documents of their own and count as such. An empty table gives no rows. Columns
of the input are kept; a name that clashes with a result is an error unless ``out`` (the prefix
of all results) is changed.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rungwork.llm.linking import release_memory
from rungwork.session import cut_lineage

PAIRS = 1_000_000  # broadcast at most: some 50 MB
SALTS = 32  # for the shuffled join beyond
WORDS = 400_000  # whose pieces a task remembers; then it starts anew
WORD = re.compile(" *[^ ]+| +")
# Fixed value: how a byte-level pre-tokenizer cuts a text.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHARS = 500_000  # of the texts of one batch, unless one is longer
RESULT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_letters() -> dict[str, int]:
    """Byte-level entries write each byte as one letter: printable ones as themselves, the others in order from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Side:
    """Bytes of each id, and the ids of texts: all of them in one array, and how many each text has."""

    def __init__(self, tokens: list[bytes], ids: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.tokens, self.ids, self.size = tokens, ids, len(tokens)
        self.lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))


def _flat(rows: list) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    return np.fromiter(chain.from_iterable(rows), dtype=np.int64, count=int(counts.sum())), counts


def byte_level_side(path: str) -> Side:
    """A ``tokenizers`` file of byte-level entries; texts get a blank in front.

    A plain byte-level BPE whose merges make their results in the order of ids is encoded by
    ``tiktoken`` with the ids as ranks, which gives the same ids in a fifth of the time.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    letters = byte_letters()
    entries = tokenizer.get_vocab(with_added_tokens=True)
    tokens = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        tokens[i] = bytes(map(letters.__getitem__, entry)) if all(c in letters for c in entry) else entry.encode()
    if (ranks := _ranks(path, letters)) is not None:
        import tiktoken

        public = tiktoken.Encoding("side", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return Side(tokens, lambda texts: _flat([public.encode_ordinary(f" {t}") for t in texts]))
    encode = tokenizer.encode_batch_fast
    return Side(tokens, lambda texts: _flat([e.ids for e in encode([f" {t}" for t in texts], add_special_tokens=False)]))


def _ranks(path: str, letters: dict[str, int]) -> dict[bytes, int] | None:
    """Ids as ranks, where the file is nothing but a byte-level BPE with merges in order."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    model, cut = made["model"], made.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")]
    if not plain or any(odd) or model.get("type") != "BPE" or any(made.get(k) for k in ("normalizer", "truncation", "padding")):
        return None
    vocabulary = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    results = [vocabulary["".join(pair)] for pair in pairs]
    single = {i for entry, i in vocabulary.items() if len(entry) == 1}
    if results != sorted(set(results)) or single | set(results) != set(vocabulary.values()) or max(single) > min(results):
        return None
    return {bytes(map(letters.__getitem__, entry)): i for entry, i in vocabulary.items()}


class Pieces:
    """A ``sentencepiece`` model that remembers the ids of words.

    Where the model changes no character, keeps blanks, and has no piece with a blank behind
    another character, no merge reaches over the start of a blank run, and a text is encoded word
    by word; another model gets whole texts.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = [bytes([int(n[3:-1], 16)]) if self.model.is_byte(i) else n.replace("\u2581", " ").encode() for i, n in enumerate(names)]
        self.by_word = self._keeps_text(path) and not any(re.search("[^\u2581]\u2581", n) for n in names)
        self.forget()

    @staticmethod
    def _keeps_text(path: str) -> bool:
        try:
            from sentencepiece import sentencepiece_model_pb2
        except ImportError:  # cannot tell
            return False
        made = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            made.ParseFromString(file.read())
        spec = made.normalizer_spec
        changes = spec.precompiled_charsmap or spec.remove_extra_whitespaces or made.trainer_spec.treat_whitespace_as_suffix
        return bool(spec.add_dummy_prefix and spec.escape_whitespaces and not changes and made.trainer_spec.model_type == 2)

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word:
            return _flat(self.model.encode(texts, num_threads=1))
        if len(self.place) > WORDS:
            self.forget()
        cut = [WORD.findall(f" {t}") for t in texts]  # the model's own blank in front
        words = list(chain.from_iterable(cut))
        fresh = list(set(words).difference(self.place))
        if fresh:
            # the model puts a blank before a word, but none before nothing
            alone = self.model.encode("a ")[len(self.model.encode("a")) :]
            ids, counts = _flat([row if w != " " else alone for w, row in zip(fresh, self.model.encode([w[1:] for w in fresh], num_threads=1))])
            self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh))))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
            self.flat, self.counts = np.concatenate([self.flat, ids]), np.concatenate([self.counts, counts])
        at = np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))
        sizes = self.counts[at]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        last = np.cumsum(np.fromiter(map(len, cut), dtype=np.int64, count=len(cut)))
        return ids, np.diff(np.concatenate([[0], ends])[last], prepend=0)


def piece_side(path: str) -> Side:
    """A ``sentencepiece`` model, which puts the blank in front by itself."""
    pieces = Pieces(path)
    return Side(pieces.tokens, pieces.ids)


@lru_cache(maxsize=2)
def sides(path_a: str, path_b: str) -> tuple[Side, Side]:
    return byte_level_side(path_a), piece_side(path_b)


def covering(starts: np.ndarray, docs: np.ndarray, other: np.ndarray, other_docs: np.ndarray) -> np.ndarray:
    """For each start the place of the other side's token that covers it, in the same document."""
    left = pd.DataFrame({"start": starts, "doc": docs})
    right = pd.DataFrame({"start": other, "doc": other_docs, "place": np.arange(len(other))})
    return pd.merge_asof(left, right, on="start", by="doc")["place"].to_numpy()


class Aligned:
    """Token rows of a batch of texts that both sides give back, on one axis of bytes.

    ``which`` are the texts' places in the batch; a text's bytes follow those of the one before.
    """

    def __init__(self, texts: list[str | None], a: Side, b: Side):
        full = [i for i, t in enumerate(texts) if t]
        sides = [side.ids([texts[i] for i in full]) for side in (a, b)]
        good = np.ones(len(full), dtype=bool)
        for side, (ids, counts) in zip((a, b), sides):
            named, first = list(map(side.tokens.__getitem__, ids.tolist())), 0
            for k, (i, n) in enumerate(zip(full, counts.tolist())):
                good[k] &= b"".join(named[first : first + n]) == b" " + texts[i].encode()
                first += n
        self.which = [i for i, fits in zip(full, good.tolist()) if fits]
        self.a, self.counts_a, self.doc_a, self.end_a, self.start_a = self._laid(*sides[0], good, a)
        self.b, self.counts_b, self.doc_b, self.end_b, self.start_b = self._laid(*sides[1], good, b)

    @staticmethod
    def _laid(ids: np.ndarray, counts: np.ndarray, good: np.ndarray, side: Side):
        if not good.all():
            ids, counts = ids[np.repeat(good, counts)], counts[good]
        lengths = side.lengths[ids]
        if len(lengths) and not lengths.min():
            raise ValueError("a token without bytes has no place")
        ends = np.cumsum(lengths)
        return ids, counts, np.repeat(np.arange(len(counts)), counts), ends, ends - lengths

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places (a, b) of all overlapping token pairs, each once."""
        b_at = covering(self.start_a, self.doc_a, self.start_b, self.doc_b)
        a_at = covering(self.start_b, self.doc_b, self.start_a, self.doc_a)
        later = self.start_a[a_at] < self.start_b  # equal starts are in the first direction already
        return np.concatenate([np.arange(len(b_at)), a_at[later]]), np.concatenate([b_at, np.flatnonzero(later)])

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group of every token of a and of b (numbered through the batch), and groups a text."""
        total = int(self.end_a[-1]) if len(self.end_a) else 0
        ends = np.zeros((2, total + 1), dtype=bool)
        ends[0, self.end_a], ends[1, self.end_b] = True, True
        closed = np.cumsum(ends[0] & ends[1])
        of_a, of_b = closed[self.end_a - 1], closed[self.end_b - 1]
        last = np.cumsum(self.counts_a) - 1
        return of_a, of_b, np.diff(of_a[last] + 1, prepend=0)

    def written_groups(self, a: Side, b: Side) -> list[bytes]:
        """Per text ``a1,a2|b1;a3|b2,b3``: decimal ids of both sides, group by group."""
        of_a, of_b, _ = self.groups()
        n_a, n_b = len(of_a), len(of_b)
        size = (int(of_a[-1]) + 1) if n_a else 0
        before_b = np.concatenate([[0], np.cumsum(np.bincount(of_b, minlength=size))])  # tokens of b before a group
        upto_a = np.cumsum(np.bincount(of_a, minlength=size))  # tokens of a up to a group's end
        place = np.concatenate([np.arange(n_a) + before_b[of_a], np.arange(n_b) + upto_a[of_b]])
        last_a = np.append(of_a[1:] != of_a[:-1], True)[:n_a]
        last_b = np.append(of_b[1:] != of_b[:-1], True)[:n_b]
        code = np.empty(n_a + n_b, dtype=np.int64)
        code[place] = np.concatenate([2 * self.a + last_a, 2 * (a.size + self.b) + last_b])
        names = _names(a.size, b.size)
        listed, out, start = code.tolist(), [], 0
        for n in (self.counts_a + self.counts_b).tolist():
            out.append(b"".join(map(names.__getitem__, listed[start : start + n]))[:-1])
            start += n
        return out


@lru_cache(maxsize=2)
def _names(size_a: int, size_b: int) -> list[bytes]:
    """Ids with the mark behind them: ``,`` inside a side of a group, ``|`` and ``;`` at the ends of a and b."""
    return [b"%d%s" % (i, mark) for n, end in ((size_a, b"|"), (size_b, b";")) for i in range(n) for mark in (b",", end)]


def text_groups(texts: list[str | None], most: int = CHARS) -> Iterator[tuple[int, int]]:
    """Stretches [first, last) of texts of about ``most`` characters together."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "") + 1
        if size >= most or i == len(texts) - 1:
            yield first, i + 1
            first, size = i + 1, 0


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", out: str = "") -> DataFrame:
    """Add token and link counts of both sides and ``links``: distinct (pair, times) with pair = a * size of b + b.

    ``groups_sha256`` digests the written groups; a text without tokens has an empty one.
    """
    names = [f"{out}{n}" for n in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")]
    _no_clash(names, docs)
    kinds = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<pair:long,times:int>>"
    fields = T._parse_datatype_string(kinds).fields
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, f.dataType) for n, f in zip(names, fields)]])
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(path_a, path_b)
        for whole in batches:
            texts = whole.column(place).to_pylist()
            for first, last in text_groups(texts):
                n = last - first
                rows = Aligned(texts[first:last], a, b)
                which = np.array(rows.which, dtype=np.int64)
                counts = np.zeros((4, n), dtype=np.int64)
                digests = [""] * n
                at_a, at_b = rows.links()
                doc = rows.doc_a[at_a]
                counts[0, which], counts[1, which] = rows.counts_a, rows.counts_b
                counts[2, which], counts[3, which] = rows.groups()[2], np.bincount(doc, minlength=len(which))
                for i, plain in zip(rows.which, rows.written_groups(a, b)):
                    digests[i] = hashlib.sha256(plain).hexdigest()
                pairs = a.size * b.size
                key, times = np.unique(which[doc] * pairs + rows.a[at_a] * b.size + rows.b[at_b], return_counts=True)
                offsets = np.searchsorted(key, np.arange(n + 1) * pairs)
                links = pa.StructArray.from_arrays([pa.array(key % pairs), pa.array(times.astype(np.int32))], names=["pair", "times"])
                more = [*map(pa.array, counts), pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), links)]
                yield pa.RecordBatch.from_arrays([*whole.slice(first, n).columns, *more], names=schema.names)
        release_memory()

    return docs.mapInArrow(run, schema)


def pair_counts(links: DataFrame, size_b: int) -> DataFrame:
    """(pair, count, best) of rows (row, pair, times): documents a pair, and whether its a id has none of more."""
    counted = links.groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    counted = cut_lineage(counted.withColumn("a", F.floor(F.col("pair") / size_b)))
    most = counted.groupBy(F.col("a").alias("id")).agg(F.max("count").alias("most"))
    return counted.join(most, F.col("a") == F.col("id")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned_documents(docs: DataFrame, path_a: str, path_b: str, text: str = "text", out: str = "", pairs: int = PAIRS) -> DataFrame:
    """``align`` with ``n_best`` and ``count_sum``, which need the whole corpus; texts and links are left out."""
    kept = [c for c in docs.columns if c != text]
    _no_clash([f"{out}{n}" for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")], docs)
    row = docs.select(F.struct(F.lit(0).alias(""), *[F.col(f"`{c}`") for c in kept]).alias("kept"), F.col(f"`{text}`").alias("text"))
    written = cut_lineage(align(row, path_a, path_b).drop("text").withColumn("row", F.monotonically_increasing_id()))
    links = written.select("row", F.explode("links").alias("l")).select("row", "l.*")
    counts = cut_lineage(pair_counts(links, sides(path_a, path_b)[1].size))
    if counts.count() <= pairs:
        joined = links.join(F.broadcast(counts), "pair")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        salted = links.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
        joined = salted.join(counts.withColumn("salt", salts), ["pair", "salt"])
    sums = joined.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"),
        F.sum(F.col("times") * F.col("count")).cast("long").alias("count_sum"),
    )
    whole = written.drop("links").join(sums.withColumnRenamed("row", "of"), F.col("row") == F.col("of"), "left")
    zero = F.lit(0).cast("long")
    results = {c: F.coalesce(c, zero) if c in ("n_best", "count_sum") else F.col(c) for c in [f.split()[0] for f in RESULT.split(", ")]}
    return whole.select(*[F.col(f"kept.`{c}`") for c in kept], *[v.alias(f"{out}{c}") for c, v in results.items()])


def _no_clash(names: list[str], docs: DataFrame) -> None:
    if clash := set(map(str.lower, names)) & set(map(str.lower, docs.columns)):
        raise ValueError(f"columns {sorted(clash)} are there already; choose another out=")
