"""Embeddings, Jaccard join, WARC, mixing, packing and components against brute force."""

import base64
import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rungwork.llm import bpe_matrix, embedding_itq, linking, ngram_jaccard, packing, source_mix, warc_merge


def frame(spark, rows, schema="doc_id long, text string", parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


class Sets:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        while self.parent.setdefault(x, x) != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


# --- components -----------------------------------------------------------------------------


def test_components_of_paths_stars_and_loops(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (300, 200), (200, 300)]
    edges += [(r.randint(400, 500), r.randint(400, 500)) for _ in range(60)]
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    got = {x.node: x.root for x in linking.components(frame(spark, edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: sets.find(x) for x in linked}
    assert linking.components(frame(spark, [], "a long, b long")).count() == 0


# --- embeddings -----------------------------------------------------------------------------


def brute_vectors(ids, vectors):
    def good(v):
        return v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))

    links, sets = Counter(), Sets()
    usable = [i for i, (k, v) in enumerate(zip(ids, vectors)) if k is not None and good(v)]
    for size in {len(vectors[i]) for i in usable}:
        which = [i for i in usable if len(vectors[i]) == size]
        unit = np.array([vectors[i] for i in which], float)
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        near = unit @ unit.T >= 0.9
        for a in range(len(which)):
            for b in np.flatnonzero(near[a]):
                if a != b:
                    links[which[a]] += 1
                    sets.join(ids[which[a]], ids[which[b]])
    return links, sets


@pytest.mark.parametrize("cell", [1024, 20])
def test_near_vectors_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(embedding_itq, "CELL", cell)
    r = np.random.default_rng(1)

    def unit(v):
        return v / np.linalg.norm(v)

    vectors = [r.normal(size=64).tolist() for _ in range(200)]
    for k in range(200):  # just above the threshold
        a = unit(np.array(vectors[k]))
        o = r.normal(size=64)
        o = unit(o - a * (o @ a))
        c = r.uniform(0.9001, 0.93)
        vectors.append((3 * (c * a + np.sqrt(1 - c * c) * o)).tolist())
    centre = unit(r.normal(size=64))
    vectors += [(centre + 0.02 * r.normal(size=64)).tolist() for _ in range(100)]
    vectors += [vectors[0], vectors[0], None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [None] + [1.0] * 63, [1.0, 2.0], [2.0, 4.1]]
    ids = list(range(len(vectors))) + [None]
    vectors.append(vectors[0])
    links, sets = brute_vectors(ids, vectors)
    out = embedding_itq.near_vectors(frame(spark, list(zip(ids, vectors)), "vec_id long, embedding array<double>").selectExpr("*", "1 as cls")).collect()
    assert len(out) == len(ids)
    got = {x.vec_id: x for x in out}
    assert sum(got[k].n_links for k in ids) >= 0.95 * sum(links.values())
    assert all(got[k].n_links <= links[i] for i, k in enumerate(ids) if k is not None)  # none below the threshold
    same = sum(got[k].component_id == sets.find(k) for k in ids[:-1])
    assert same >= 0.98 * len(ids)
    assert all(got[k].kept == (got[k].component_id == k) for k in ids[:-1])
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, None)
    assert embedding_itq.near_vectors(frame(spark, [], "vec_id long, embedding array<double>")).count() == 0


def test_recall_on_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.collect()
    links, _ = brute_vectors([x.vec_id for x in rows], [x.embedding for x in rows])
    found = sum(x.n_links for x in embedding_itq.near_vectors(table).collect())
    assert 0.9 * sum(links.values()) <= found <= sum(links.values())


def test_recall_on_pairs_planted_among_the_given_vectors(spark):
    """The given vectors hold few near pairs, so every fourth gets a neighbour at a cosine from 0.87 to 0.99."""
    rng = np.random.default_rng(5)
    rows = [(x.vec_id, np.array(x.embedding, dtype=float)) for x in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    planted = []
    for k, (vec_id, vector) in enumerate(rows[::4]):
        unit = vector / np.linalg.norm(vector)
        side = rng.normal(size=len(unit))
        side -= side @ unit * unit
        cosine = rng.uniform(0.87, 0.99)
        planted.append((10**6 + k, 3.0 * (cosine * unit + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side))))
    every = rows + planted
    by_place, _ = brute_vectors([i for i, _ in every], [v.tolist() for _, v in every])
    links = Counter({every[k][0]: n for k, n in by_place.items()})
    table = frame(spark, [(i, v.tolist()) for i, v in every], "vec_id long, embedding array<double>")
    got = {x.vec_id: x.n_links for x in embedding_itq.near_vectors(table).collect()}
    assert not {i: (n, links[i]) for i, n in got.items() if n > links[i]}
    assert sum(links.values()) > 300
    assert sum(got.values()) >= 0.9 * sum(links.values())


# --- n-gram Jaccard join --------------------------------------------------------------------


def brute_jaccard(rows, n=5, percent=80):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    found = []
    for _, text in rows:
        words = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        found.append({tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set())
    holders, sets = defaultdict(list), Sets()
    for k, grams in enumerate(found):
        for g in grams:
            holders[g].append(k)
    for k, grams in enumerate(found):
        for j, shared in Counter(j for g in grams for j in holders[g] if j < k).items():
            if 100 * shared >= percent * (len(grams) + len(found[j]) - shared) and rows[k][0] is not None and rows[j][0] is not None:
                sets.join(rows[k][0], rows[j][0])
    return sorted(((i, len(s), None if i is None else sets.find(i) if s else i) for (i, _), s in zip(rows, found)), key=str)


@pytest.mark.parametrize("cell", [2048, 16])
def test_jaccard_groups_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(ngram_jaccard, "CELL", cell)
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [r.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(200):
        if i < 120:
            words = list(base)
            for _ in range(r.randint(0, 5)):
                words[r.randrange(120)] = r.choice(vocabulary)
        else:
            words = [r.choice(vocabulary) for _ in range(r.randint(0, 40))] if i % 2 else [r.choice("ab") for _ in range(r.randint(0, 9))]
        rows.append((i, " ".join(words)))
    rows += [(300, None), (301, ""), (302, "  \n"), (5, "other text entirely here now yes"), (None, rows[3][1]), (None, None)]
    rows += [(7, rows[7][1]), (303, "Ab cD"), (304, "ab cd"), (305, "x " * 3000)]
    out = ngram_jaccard.jaccard_groups(frame(spark, rows).selectExpr("*", "1 as n", "2 as cls")).collect()
    assert sorted(map(tuple, out), key=str) == brute_jaccard(rows)


def test_jaccard_groups_of_given_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(x.doc_id, x.text) for x in table.collect()]
    assert sorted(map(tuple, ngram_jaccard.jaccard_groups(table).collect()), key=str) == brute_jaccard(rows)


def test_last_words_of_a_long_text_count(spark):
    words = [f"v{i}" for i in range(20_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:15_900] + [f"z{i}" for i in range(4_100)])), (3, " ".join(words[:18_500] + [f"y{i}" for i in range(1_500)]))]
    assert sorted(map(tuple, ngram_jaccard.jaccard_groups(frame(spark, rows)).collect())) == [(1, 19_996, 1), (2, 19_996, 2), (3, 19_996, 1)]


@pytest.mark.parametrize("step", [66, 70, 130, 211])
def test_copies_over_batch_borders_make_no_large_run(step):
    # One n-gram, few classes with many copies each: every two classes are a pair or in one group.
    for classes in (2, 3, 10, 64, 65, 90):
        cls = np.repeat(np.arange(100, 100 + classes), 40)
        columns = [np.full(len(cls), 7), np.full(len(cls), 10 << 32), cls]
        batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + step]) for c in columns], names=["gram", "size_place", "cls"]) for i in range(0, len(cls), step)]
        pairs, groups = set(), defaultdict(set)
        for out in ngram_jaccard._run_pairs(80)(iter(batches)):
            for centre, member, clique in zip(*[c.to_pylist() for c in out.columns]):
                if clique:
                    groups[centre].add(member)
                else:
                    pairs.add((centre, member))
        assert all(leader in members for leader, members in groups.items())
        for a, b in itertools.combinations(range(100, 100 + classes), 2):
            assert (a, b) in pairs or any({a, b} <= g for g in groups.values())


def test_jaccard_groups_of_an_empty_table(spark):
    assert ngram_jaccard.jaccard_groups(frame(spark, [])).count() == 0


# --- WARC -----------------------------------------------------------------------------------


def test_loser_tree_merges_any_number_of_runs():
    r = random.Random(1)
    for k in range(9):
        runs = [sorted((r.randint(0, 20), i) for i in range(r.randint(0, 8))) for _ in range(k)]
        assert [x for x, _ in warc_merge.LoserTree([iter(run) for run in runs])] == sorted(x for run in runs for x in run)


def test_archives_round_trip_in_global_order(spark):
    r = random.Random(2)
    rows = [(i, f"https://www.host{i % 3}.example.org/p/{r.randint(0, 30)}?q={i % 2}#top", r.choice(["<p>a\r\n\r\nb</p>", f"page {i} é", ""])) for i in range(120)]
    rows += [(200, None, None), (201, "", "x"), (202, "HTTP://host.example/\r\nX: y", "z" * 200_000), (None, "http://n.example", "null id"), (5, rows[5][1], rows[5][2])]
    pages = frame(spark, rows, "page_id long, url string, html string", 5).withColumn("captured", F.lit(1_700_000_000) + F.col("page_id"))
    out = warc_merge.capture_histories(pages.withColumn("digest", F.lit("clash"))).collect()
    assert len(out) == len(rows)
    winner = {}
    for page, _, html in rows:
        winner[html or ""] = max(winner.get(html or "", -1), -1 if page is None else page)
    texts = defaultdict(list)
    for page, _, html in rows:
        texts[page].append(html or "")
    for x in out:
        html = texts[x.page_id][0].encode()
        assert (x.payload_bytes, x.payload_digest) == (len(html), base64.b32encode(hashlib.sha1(html).digest()).decode())
        best = winner[html.decode()]
        assert (x.record_type, x.refers_to) == (("response", None) if x.page_id in (best, None) else ("revisit", best))
    ordered = sorted(out, key=lambda x: (x.slice, x.place))
    keys = [(x.url_key, x.captured is not None, x.captured or 0, x.page_id or -1) for x in ordered]
    assert keys == sorted(keys)
    assert any(x.url_key.startswith("org,example,host1)/p/") for x in out)


def test_small_payloads_can_be_responses_all(spark):
    pages = frame(spark, [(1, "u", "a"), (2, "u", "a"), (3, "u", "long"), (4, "u", "long")], "page_id long, url string, html string")
    out = warc_merge.capture_histories(pages.withColumn("captured", F.col("page_id")), min_bytes=2).collect()
    assert {x.page_id: x.refers_to for x in out} == {1: None, 2: None, 3: 4, 4: None}
    none = frame(spark, [], "page_id long, url string, html string, captured long")
    assert warc_merge.capture_histories(none).count() == 0


# --- mixing ---------------------------------------------------------------------------------


def brute_targets(sizes, weights=(3, 1, 2), budget=1.5, most=2.0):
    names = sorted(sizes, key=lambda n: (n is None, n or ""))
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    capped, total = set(), budget * sum(sizes.values())
    while True:
        left, shares = total - sum(most * sizes[n] for n in capped), sum(weight[n] for n in names if n not in capped)
        target = {n: most * sizes[n] if n in capped else left * weight[n] / shares for n in names}
        over = {n for n in names if n not in capped and target[n] > most * sizes[n]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("slice_rows", [1000, 3])
def test_mix_meets_the_reshared_targets(spark, slice_rows):
    r = random.Random(4)
    sources = ["b", "a", "é", "Z", None, "tiny"]
    rows = [(i, r.choice(sources[:5]), " ".join("w" * r.randint(1, 4) for _ in range(r.randint(0, 60)))) for i in range(300)]
    rows += [(400, "tiny", "only  words\there"), (401, "a", None), (402, "empty", ""), (None, "b", "no id at all"), (7, *rows[7][1:])]
    docs = frame(spark, rows, "doc_id long, source string, text string")
    got = source_mix.mix(docs, keep=["doc_id", "source"], slice_rows=slice_rows).collect()
    sizes = Counter()
    for _, source, text in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    target = brute_targets(dict(sizes))
    taken = Counter()
    for x in got:
        taken[x.source] += x.taken
        assert x.source_size == sizes[x.source] and abs(x.target - target[x.source]) < 1e-9 * max(1, target[x.source])
        assert 0 <= x.taken <= 2 * x.size
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    again = source_mix.mix(docs.repartition(7), keep=["doc_id", "source"], slice_rows=slice_rows).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = source_mix.mixed_documents(docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("size", F.lit("mine")), slice_rows=slice_rows)
    words = Counter()
    for x in mixed.collect():
        assert x.n_chars == len(x.text) and x["size"] == "mine"
        words[x.source] += len(re.findall(r"[^\x20\x09-\x0D]+", x.text))
    assert words == +taken


def test_equal_documents_share_a_border_to_the_word(spark):
    """Most of a source is one repeated row: copies are taken whole but for one, and the target is met."""
    rows = [(5, "hot", "same words in every row")] * 300 + [(i, "hot", f"own {i}") for i in range(100, 130)] + [(7, "other", "one two three")] * 9 + [(None, None, "x y")] * 8
    docs = frame(spark, rows, "doc_id long, source string, text string", parts=6)
    targets = {x.source: x.target for x in source_mix.mix(docs, keep=["source"]).collect()}
    mixed = source_mix.mixed_documents(docs).collect()
    words = Counter()
    for x in mixed:
        words[x.source] += len(x.text.split())
    assert {s: int(t) for s, t in targets.items()} == dict(words)
    cut = [x for x in mixed if (x.doc_id, x.source, x.text) not in set(rows)]
    assert len(cut) <= 3


def test_mix_prefers_heavier_documents(spark):
    rows = [(i, "s" if i % 2 else "t", "word " * 10) for i in range(2000)]
    docs = frame(spark, rows, "doc_id long, source string, text string")
    heavy = (F.col("doc_id") % 4 == 0).cast("double") * 9 + 1
    got = source_mix.mix(docs, keep=["doc_id", "source"], weight=heavy, budget=0.3).where("source = 't'").collect()
    share = [sum(x.taken for x in got if (x.doc_id % 4 == 0) == kind) for kind in (True, False)]
    assert share[0] > 3 * share[1]


def test_mix_of_nothing(spark):
    schema = "doc_id long, source string, text string"
    assert source_mix.mix(frame(spark, [], schema), keep=["doc_id"]).count() == 0
    out = source_mix.mix(frame(spark, [(1, "s", None), (2, None, " ")], schema), keep=["doc_id"]).collect()
    assert [(x["size"], x.target, x.taken) for x in out] == [(0, 0.0, 0)] * 2
    with pytest.raises(ValueError):
        source_mix.mix(frame(spark, [], schema + ", size long"))


# --- packing --------------------------------------------------------------------------------


def test_best_fit_equals_a_plain_search():
    r = random.Random(1)
    for _ in range(100):
        length = r.randint(1, 40)
        sizes = [r.randint(1, length) for _ in range(r.randint(0, 60))]
        rows = packing.best_fit(sizes, length)
        assert sorted(i for x in rows for i in x) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in x) <= length for x in rows)
        free = []
        for size in sorted(sizes, reverse=True):
            fits = [f for f in free if f >= size]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - size)
            else:
                free.append(length - size)
        assert len(free) == len(rows)


@pytest.mark.parametrize("group", [700, 2_000_000])
def test_packed_rows_give_the_documents_back(spark, group):
    r = random.Random(1)
    docs = [(i, [r.randint(0, 65535) for _ in range(r.choice([0, 1, 5, 50, 120]))]) for i in range(150)] + [(None, [1, 2]), (500, None), (8, [])]
    table = spark.createDataFrame(docs, "doc_id long, ids array<int>").selectExpr("*", "1 as n_tokens").repartition(3)
    packed = packing.write_packed(table, length=16, end_id=9, group_tokens=group)
    rows = packed.collect()
    assert all(len(x.ids) == 32 and x.n_tokens == x.cu_seqlens[-1] <= 16 and x.position_resets == x.cu_seqlens[:-1] for x in rows)
    assert all(packing.position_ids(x.cu_seqlens)[x.position_resets].tolist() == [0] * len(x.doc_ids) for x in rows)
    assert len({x.pack_id for x in rows}) == len(rows)
    found = defaultdict(list)
    for x in sorted(packing.unpack(packed).collect(), key=lambda x: (str(x.doc_id), x.doc_offset)):
        found[x.doc_id].append(x.ids)
    wanted = {i: (ids or []) + [9] for i, ids in docs if i != 8}
    assert {i: sum(found[i], []) for i in wanted} == wanted
    assert packing.pack(table.limit(0)).count() == 0
    with pytest.raises(Exception, match="outside"):
        packing.pack(spark.createDataFrame([(1, [70_000])], "doc_id long, ids array<int>")).collect()


def test_encoding_and_packing_in_one_pass(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = [(i, "word " * (i * 7 % 90) + f"é {i}") for i in range(60)] + [(3, None), (None, ""), (70, "x" * 30_000)]
    docs = frame(spark, texts, "doc_id long, text string", parts=1)
    one = packing.pack_texts(docs, path, public_tokenizers.PATTERN, length=32, end_id=50_256).collect()
    two = packing.pack(bpe_matrix.encode(docs, path, public_tokenizers.PATTERN, digests=False), length=32, end_id=50_256).collect()
    assert one == two and sum(len(x.doc_ids) for x in one) >= len(texts)
    with pytest.raises(Exception, match="null among its ids"):
        packing.pack(spark.createDataFrame([(1, [1, None])], "doc_id long, ids array<int>")).collect()
    with pytest.raises(Exception, match="outside of <u1"):
        packing.pack_texts(docs, path, public_tokenizers.PATTERN, dtype="<u1").collect()


def test_jaccard_sets_are_not_written(spark, monkeypatch):
    cut, seen = ngram_jaccard.cut_lineage, []
    monkeypatch.setattr(ngram_jaccard, "cut_lineage", lambda df: seen.append(df.columns) or cut(df))
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join([*words, f"x{i}"])) for i in range(6)], "doc_id long, text string")
    assert {r.component_id for r in ngram_jaccard.jaccard_groups(docs).collect()} == {0}
    assert seen and not any("values" in columns for columns in seen)


def test_jaccard_moves_packed_texts_instead_of_sets(spark, monkeypatch):
    plans, join = [], ngram_jaccard.links
    monkeypatch.setattr(ngram_jaccard, "links", lambda *a: plans.append(join(*a)) or plans[-1])
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*words, f"x{i}"])) for i in range(6)] + [(2, "another text of the same id"), (3, " ".join([*words, "x3"]))]
    out = ngram_jaccard.jaccard_groups(frame(spark, rows)).collect()
    assert sorted(map(tuple, out), key=str) == brute_jaccard(rows)
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert "packed" in plan and "values" not in plan
    moved = [r for b in ngram_jaccard._packed(5)(iter([pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])])) for r in b.to_pylist()]
    assert len(moved) == len(rows) and all(len(r["packed"]) < 8 * 397 / 2 for r in moved)  # a set is 8 bytes an n-gram
    assert all(r["cls"] == ngram_jaccard.set_key(ngram_jaccard.shingle_sets([t])[0]) for r, (_, t) in zip(moved, rows))


def test_jaccard_sets_are_made_for_few_bytes_at_a_time():
    texts = ["é" * 20_000, None, "a b " * 100_000, "", "last"] + ["word " * 4_000] * 300
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    parts = list(ngram_jaccard._texts(iter([batch, batch.slice(0, 0)])))
    assert [t for _, part in parts for t in part] == texts and [i for ids, _ in parts for i in ids] == list(range(len(texts)))
    assert all(len(part) == 1 or sum(len((t or "").encode()) for t in part) <= 1 << 17 for _, part in parts)
