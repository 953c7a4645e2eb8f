"""BPE, toxicity, line chunks, long repeats and fingerprints against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from pyspark.sql import functions as F

from rungwork.llm import bpe_matrix, iblt_fingerprint, line_chunks, run_length_dedup, toxicity_pu

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "\n\n", "a" * 5000, "ab" * 3000, "\x1c\x1d\x85 \xa0x", "it's we'll 'sam !'s", "🙂 漢字 é½²Ⅷ"]


def frame(spark, rows, schema="doc_id long, text string", parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


# --- byte-level BPE -------------------------------------------------------------------------


def public_encoder():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_matrix.read_ranks(PATH), special_tokens={})


def test_ids_equal_the_public_library():
    r = random.Random(1)
    letters = "aaab  \n\t\x1c\x1d\x85\xa0é½²Ⅷ漢字🙂'srevelmd_1234.-​　 "
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 200))) for _ in range(800)] + [t or "" for t in ODD]
    public = public_encoder()
    encoder = bpe_matrix.Encoder(PATH, public_tokenizers.PATTERN)
    assert list(encoder.encode(texts)) == [public.encode_ordinary(t) for t in texts]


def test_other_patterns_go_through_the_matcher():
    encoder = bpe_matrix.Encoder(PATH, r"\S+|\s+")
    public = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=bpe_matrix.read_ranks(PATH), special_tokens={})
    texts = ["one two", "", "  three!! 4"]
    assert list(encoder.encode(texts)) == [public.encode_ordinary(t) for t in texts]


def test_encode_decode_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(0, None), (None, "no id")]
    out = bpe_matrix.decode(bpe_matrix.encode(frame(spark, rows), PATH, public_tokenizers.PATTERN), PATH).collect()
    public = public_encoder()
    assert len(out) == len(rows)
    for row in out:
        text = row.text or ""
        ids = public.encode_ordinary(text)
        assert (row.ids, row.n_tokens, bytes(row.decoded)) == (ids, len(ids), text.encode())
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_of_empty_and_clashing_tables(spark):
    empty = frame(spark, [])
    assert bpe_matrix.encode(empty, PATH, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe_matrix.encode(empty.withColumnRenamed("text", "ids").selectExpr("*", "'' as text"), PATH, public_tokenizers.PATTERN)


# --- toxicity -------------------------------------------------------------------------------


def test_toxicity_learns_from_positive_and_unlabelled(spark):
    r = random.Random(5)
    words = ["".join(r.choice("aeioulmnrst") for _ in range(5)) for _ in range(300)]
    bad = ["vilest", "vilemost", "grotty"]
    rows, labels = [], []
    for i in range(1500):
        text = [r.choice(words) for _ in range(r.randint(3, 80))]
        toxic = i % 6 == 0
        if toxic:
            text += r.sample(bad, 2)
        rows.append((i, " ".join(text)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    labels += [(99999, 1), (None, 1), (4, None), (6, 1)]
    rows += [(None, None), (7, rows[7][1]), (2000, "")]
    docs, known = frame(spark, rows), frame(spark, labels, "doc_id long, toxic int")
    model = toxicity_pu.fit_model(docs, known)
    out = toxicity_pu.score(docs.selectExpr("*", "1 as extra"), model).withColumn("held_out", toxicity_pu.held_out(F.col("doc_id"))).collect()
    assert len(out) == len(rows) and all(0 <= x.score <= 1 for x in out)
    tested = [(x.score, x.doc_id % 6 == 0) for x in out if x.held_out and x.doc_id is not None and x.doc_id < 1500]
    assert len(tested) > 200
    assert sum((score >= 0.5) == toxic for score, toxic in tested) / len(tested) > 0.97
    with pytest.raises(ValueError):
        toxicity_pu.score(docs.selectExpr("*", "1 as score"), model)


def test_toxicity_without_examples_calls_nothing_toxic(spark):
    docs = frame(spark, [(1, "x"), (2, None)])
    model = toxicity_pu.fit_model(docs, frame(spark, [(1, 0)], "doc_id long, toxic int"))
    assert [x.score for x in toxicity_pu.score(docs, model).collect()] == [0.0, 0.0]
    assert toxicity_pu.score(frame(spark, []), model).count() == 0


def test_negative_part_is_turned_around():
    # All unlabelled rows equal the positives: the plain risk would go below zero.
    rows = [[1, 2]] * 50
    model = toxicity_pu.train(rows, rows + [[3]] * 50, 0.1)
    assert np.isfinite(model.intercept)


# --- lines ----------------------------------------------------------------------------------


def cut_lines(text):
    lines = text.split("\n")
    ring = 1 << 28
    value = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    marked = [i > 0 and (value[i] ^ (value[i - 1] * 2 % ring + value[i - 1] * 2 // ring)) % line_chunks.SPREAD == 0 for i in range(len(lines))]
    out, part = [], []
    for i, line in enumerate(lines):
        part.append(line)
        if i == len(lines) - 1 or (marked[i] and not marked[i - 1] and i < len(lines) - 2):
            out.append("\n".join(part))
            part = []
    return out


def brute_lines(rows):
    first = {}
    for doc_id, text in sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0)):
        for place, chunk in enumerate(cut_lines(text) if text is not None else []):
            if chunk.count("\n") >= 1:
                first.setdefault(chunk, (doc_id, text, place))
    out = []
    for doc_id, text in rows:
        if text is None:
            out.append((doc_id, None))
            continue
        kept = [c for p, c in enumerate(cut_lines(text)) if c.count("\n") < 1 or first[c] == (doc_id, text, p)]
        out.append((doc_id, "\n".join(kept)))
    return out


def test_line_chunks_equal_brute_force(spark):
    r = random.Random(3)
    shared = ["\n".join(f"shared {k} {j}" for j in range(9)) for k in range(6)]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(shared), *[f"own {i} {r.random()}" for _ in range(r.randint(0, 5))]]
        rows.append((i, "\n".join(parts)))
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (103, "same\n" * 500), (None, shared[0]), (104, shared[1]), (5, rows[5][1])]
    docs = frame(spark, rows).selectExpr("*", "'x' as slot", "length(text) as n_chars")
    out = line_chunks.dedup_lines(docs)
    assert out.columns == docs.columns
    got = sorted(((x.doc_id, x.text) for x in out.collect()), key=str)
    assert got == sorted(brute_lines(rows), key=str)
    assert all(x.n_chars == len(x.text) for x in out.collect() if x.text is not None)
    assert line_chunks.dedup_lines(frame(spark, [])).count() == 0


def repeated_runs(texts):
    """Lines in runs of two or more consecutive lines that also stand, as a run, in an earlier text: (text, line)."""
    seen, out = set(), set()
    for k, text in enumerate(texts):
        lines = text.split("\n")
        pairs = list(zip(lines, lines[1:]))
        out |= {(k, i + j) for i, pair in enumerate(pairs) if pair in seen for j in (0, 1)}
        seen.update(pairs)
    return out


def test_runs_of_repeated_lines_go(spark):
    """Coverage against the repeated runs themselves, not against the cutter: most of their lines go, all lines once stay."""
    rows = [(x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    left = {x.doc_id: x.text.split("\n") for x in line_chunks.dedup_lines(frame(spark, rows)).collect()}
    runs = repeated_runs([t for _, t in rows])
    gone = sum(len(t.split("\n")) - len(left[i] if left[i] != [""] or t == "" else []) for i, t in rows)
    assert gone >= 0.8 * len(runs)
    kept = {line for lines in left.values() for line in lines}
    assert kept >= {line for _, t in rows for line in t.split("\n")} - {""}
    for n in (12, 30):  # a passage shared by texts that differ around it: all but its edges goes from the later ones
        passage = [f"line {n} {k}" for k in range(n)]
        texts = [(k, "\n".join([f"a{k} {j}" for j in range(k % 5 + 1)] + passage + [f"b{k} {j}" for j in range(k % 3 + 1)])) for k in range(20)]
        out = {x.doc_id: x.text for x in line_chunks.dedup_lines(frame(spark, texts)).collect()}
        stay = [sum(line in out[k].split("\n") for line in passage) for k in range(20)]
        assert stay[0] == n and max(stay[1:]) <= 12 and len(set(stay[1:])) <= 6


# --- long repeats ---------------------------------------------------------------------------


def brute_repeats(rows, width=200):
    data = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + width] for b in data for i in range(len(b) - width + 1))
    out = []
    for (doc_id, _), b in zip(rows, data):
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if count[b[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        kept = bytes(x for x, y in zip(b, gone) if not y)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [20_000, 2])
def test_long_repeats_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(run_length_dedup, "GROUP", group)
    r = random.Random(4)

    def noise(n):
        return "".join(r.choice("abcdé \n") for _ in range(n))

    passages = [noise(k) for k in (150, 199, 200, 201, 300, 900)]
    rows = []
    for i in range(40):
        text = noise(r.randint(0, 400))
        for _ in range(r.randint(0, 3)):
            text += r.choice(passages)[r.randint(0, 40) :] + noise(r.randint(0, 120))
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, "a" * 1000), (103, "ab" * 150), (104, "a" * 200), (105, "a" * 199)]
    rows += [(106, rows[3][1]), (3, rows[3][1]), (None, rows[5][1] + rows[6][1]), (107, noise(5000)), (108, "x" * 50 + passages[5] + "y" * 300)]
    out = run_length_dedup.remove_repeats(frame(spark, rows).selectExpr("*", "'x' as slot")).collect()
    assert sorted(map(tuple, out), key=str) == brute_repeats(rows)


def test_long_repeats_of_an_empty_table(spark):
    assert run_length_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_last_bytes_of_a_long_text_count(spark):
    r = random.Random(8)
    end = "".join(r.choice("xyz") for _ in range(250))
    rows = [(1, "q" + "".join(r.choice("lmnop") for _ in range(60_000)) + end), (2, "other " + end)]
    got = {x.doc_id: x.n_removed for x in run_length_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == {1: 250, 2: 250}


# --- fingerprints ---------------------------------------------------------------------------


def parts_of(text):
    lines = re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+|\n", text)
    run = r"(?:[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]*){1,%d}" % iblt_fingerprint.WORDS
    return {x.rstrip(" \t\n\x0b\f\r") for s in lines for x in re.findall(run, s)}


def digests_of(text):
    """Spark's xxhash64 of strings, as signed numbers."""
    return {int.from_bytes(xxhash.xxh64(p.encode(), seed=42).digest(), "big", signed=True) for p in parts_of(text)}


def cells_of(fingerprint):
    """cell -> (count, key, check) of a fingerprint's text."""
    out = {}
    for cell in filter(None, fingerprint.split(".")):
        head, key, check = cell.split(":")
        out[int(head[:2], 16)] = (int(head[2:], 16), int(key, 16), int(check, 16))
    return out


def read_difference(one, two):
    """Keys only in one and only in two, peeled from two fingerprints; None where cells are left."""
    x, y = cells_of(one), cells_of(two)
    left = {c: [a[0] - b[0], a[1] ^ b[1], a[2] ^ b[2]] for c in x.keys() | y.keys() for a, b in [(x.get(c, (0, 0, 0)), y.get(c, (0, 0, 0)))]}
    known = {}
    while single := {(n, k, h) for n, k, h in left.values() if abs(n) == 1 and k in known_checks and known_checks[k] == h}:
        for n, k, h in single:
            known[k] = n
            for c in places[k]:
                left[c] = [left[c][0] - n, left[c][1] ^ k, left[c][2] ^ h]
    if any(any(v) for v in left.values()):
        return None
    return {k for k, n in known.items() if n == 1}, {k for k, n in known.items() if n == -1}


known_checks, places = {}, {}


def alike(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


@pytest.mark.parametrize("slice_rows", [2000, 10])
def test_fingerprints_equal_brute_force(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(iblt_fingerprint, "SLICE", slice_rows)
    r = random.Random(2)
    words = ["alpha", "béta", "gam", "del.", "eps!", "zet?", "x\n", "🙂"]
    rows = [(i * 7, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(50)]
    rows += [(1000, None), (1001, ""), (1002, ""), (1003, "one"), (None, "no id here. at all")]
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, x[0]))
    want = []
    for k, (doc_id, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(alike(parts_of(text), parts_of(edited)), 9), round(alike(parts_of(text), parts_of(following)), 9)))
    out = iblt_fingerprint.compare_versions(frame(spark, rows)).collect()
    got = [(x.doc_id, x.n_chars, x.edited_sha256, round(x.near_edited, 9), round(x.near_next, 9)) for x in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    marks = {x.doc_id: x.fingerprint for x in out}
    assert marks[1000] == marks[1001] == marks[1002] and marks[0] != marks[7]


@pytest.mark.parametrize("levels", [8, 1])  # larger sketches; and the sets themselves where none is left to try
def test_peeling_recovers_the_digests(spark, levels):
    rows = [(0, 1, list(range(1, 60)), list(range(5, 65))), (0, 2, [1], [1]), (0, 3, [], [9, 8]), (1, 1, list(range(1, 3000)), [])]
    table = spark.createDataFrame(rows, "slice long, place int, x array<long>, y array<long>")
    found = iblt_fingerprint.differences(table, ["x", "y"], {0: (0, 1)}, listed=(0,), levels=levels).collect()
    out = {(d.slice, d.place): (d.found, sorted(d.only_x), sorted(d.only_y)) for d in found}
    assert out == {(0, 1): (9, [1, 2, 3, 4], [60, 61, 62, 63, 64]), (0, 3): (2, [], [8, 9]), (1, 1): (2999, list(range(1, 3000)), [])}
    assert {(d.slice, d.place): d.level for d in found}[(0, 1)] == 0  # read from the first sketches
    counted = iblt_fingerprint.differences(table, ["x", "y"], {0: (0, 1)}, levels=levels).collect()
    assert {(d.slice, d.place): (d.found, d.only_x, d.only_y) for d in counted} == {k: (n, [], []) for k, (n, _, _) in out.items()}


def test_fingerprints_of_the_given_documents(spark):
    """Equal texts have equal fingerprints with any neighbour, other paragraph sets others; the likeness is that of the emitted sketches."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id % 5 = 0").selectExpr("1000 - doc_id AS doc_id", "text")).withColumn("slice", F.lit("x"))
    texts = {x.doc_id: x.text for x in docs.collect()}
    out = iblt_fingerprint.compare_versions(docs).collect()
    assert len(out) == docs.count()
    sets = {i: frozenset(digests_of(t)) for i, t in texts.items()}
    marks = {}
    for x in out:
        marks.setdefault(sets[x.doc_id], set()).add(x.fingerprint)
        assert sum(n for c, (n, _, _) in cells_of(x.fingerprint).items() if c < iblt_fingerprint.CELLS) == len(sets[x.doc_id])
    assert all(len(m) == 1 for m in marks.values()) and len({min(m) for m in marks.values()}) == len(marks)
    ordered = sorted(out, key=lambda x: x.doc_id)
    every = sorted({d for s in sets.values() for d in s})
    more = [digests_of(t) for k, x in enumerate(ordered) for t in [texts[x.doc_id][: len(texts[x.doc_id]) - len(texts[x.doc_id]) // 2] + texts[ordered[(k + 1) % len(ordered)].doc_id][: len(texts[x.doc_id]) // 2]]]
    every = sorted(set(every).union(*more))
    cells = spark.createDataFrame([(d,) for d in every], "d long").select(
        "d", iblt_fingerprint.check_of(F.col("d")).alias("h"), *[iblt_fingerprint.cell_of(F.col("d"), j, F.lit(iblt_fingerprint.CELLS), 0).alias(f"c{j}") for j in range(3)]
    )
    for c in cells.collect():
        known_checks[c.d % 2**64], places[c.d % 2**64] = c.h % 2**32, (c.c0, c.c1, c.c2)
    read = late = 0  # late: just readable, but taken for too full, or not read in the bounded number of passes
    for x, edited in zip(ordered, more):
        both = sets[x.doc_id] | edited
        assert x.near_edited == pytest.approx(1.0 if not both else len(sets[x.doc_id] & edited) / len(both))
        assert (set(x.only_text), set(x.only_edited)) == (sets[x.doc_id] - edited, edited - sets[x.doc_id])
        told = read_difference(x.fingerprint, x.edited_fingerprint)
        late += x.level not in (None, 0) and told is not None
        if told is not None:
            read += 1
            assert told == ({d % 2**64 for d in x.only_text}, {d % 2**64 for d in x.only_edited})
    assert read > len(out) // 4 and late <= len(out) // 10


def test_far_ids_leave_slices_even(spark, monkeypatch):
    monkeypatch.setattr(iblt_fingerprint, "SLICE", 20)
    rows = [(i, f"text {i}") for i in range(200)] + [(10**12 + i, f"far {i}") for i in range(3)] + [(None, "none")]
    placed, _ = iblt_fingerprint.with_next(frame(spark, rows))
    got = placed.collect()
    assert max(Counter(x.slice for x in got).values()) <= 40
    after = {x.text: x.next for x in got}
    assert len(got) == len(rows) and all(after[a] == b for (_, a), (_, b) in zip(rows, rows[1:] + rows[:1]))


def test_a_hot_id_is_split_by_its_texts(spark, monkeypatch):
    monkeypatch.setattr(iblt_fingerprint, "SLICE", 20)
    rows = [(i, f"text {i}") for i in range(100)] + [(50, f"more {i}") for i in range(200)]
    placed, _ = iblt_fingerprint.with_next(frame(spark, rows))
    got = placed.collect()
    assert len(got) == len(rows) and max(Counter(x.slice for x in got).values()) <= 60
    after = {x.text: x.next for x in got}
    seen, at = [], "text 0"
    while at not in seen:  # one ring through all rows, by ascending id
        seen.append(at)
        at = after[at]
    ids = {t: i for i, t in rows}
    assert len(seen) == len(rows) and at == "text 0" and [ids[t] for t in seen] == sorted(ids[t] for t in seen)


def test_pieces_remembered_in_arrays_give_the_same_ids(monkeypatch):
    texts = ["", "one two  three\n", "two one's 12 \u00e9t\u00e9", "\n\n x", "abc" * 50, "one two three"]
    for pattern in (public_tokenizers.PATTERN, r"\S+|\s+"):
        for most in (bpe_matrix.LISTED_PIECES, 3):
            monkeypatch.setattr(bpe_matrix, "LISTED_PIECES", most)
            plain, listed = (kind(PATH, pattern) for kind in (bpe_matrix.Encoder, bpe_matrix.ArrayEncoder))
            for group in (texts[:2], texts, texts[::-1], [""]):
                assert [a.tolist() for a in listed.arrays(group)] == list(plain.encode(group))


def test_more_pieces_than_the_plain_encoder_remembers_are_encoded_once(monkeypatch):
    monkeypatch.setattr(bpe_matrix, "CACHED_PIECES", 10)
    learnt, flat = [], bpe_matrix.encode_flat
    monkeypatch.setattr(bpe_matrix, "encode_flat", lambda pieces, voc: learnt.extend(pieces) or flat(pieces, voc))
    encoder = bpe_matrix.ArrayEncoder(PATH, public_tokenizers.PATTERN)
    for _ in range(3):
        list(encoder.arrays([" ".join(f"word{chr(97 + i)}" for i in range(26))]))
    assert len(learnt) == len(set(learnt)) > 10


def test_fingerprint_digests_are_made_after_the_texts_moved(spark):
    docs = spark.createDataFrame([(i, f"line {i}\nother {i}") for i in range(20)], "doc_id long, text string")
    plan = iblt_fingerprint.with_next(docs)[0]._jdf.queryExecution().executedPlan().toString()
    moved = plan.find("Exchange hashpartitioning(slice")
    assert moved > 0 and plan.count("Exchange hashpartitioning(slice") == 1 and plan.rfind("regexp_extract_all") < moved
