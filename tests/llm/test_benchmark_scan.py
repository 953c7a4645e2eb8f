"""Benchmark decontamination against brute force."""

import random
import re

import pytest

from rungwork.llm import benchmark_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text, items):
    text = text or ""
    places = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    words = [text.translate(LOWER)[a:b] for a, b in places]
    hit, named = set(), set()
    for item, whole in items:
        own = WORD.findall((whole or "").translate(LOWER))
        size = min(10, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                named.update([] if item is None else [str(item)])
    runs = benchmark_scan.join_runs([(i, i + 1) for i in hit])
    return len(words), len(hit), [(places[a][0], places[b - 1][1]) for a, b in runs], sorted(named)


def made(seed):
    r = random.Random(seed)
    words = ["the", "Ape", "été", "b2", "x", "漢字", "Zoo's", "ÀB", "I", "no-on"]

    def text(n):
        return "".join(r.choice(words) + r.choice([" ", "  ", "\n", ", ", ". "]) for _ in range(n))

    items = [(i, text(r.choice([0, 1, 3, 9, 10, 11, 30]))) for i in range(25)]
    items += [(3, text(12)), (7, items[7][1]), (99, items[5][1]), (None, text(14)), (101, None), (102, " ,;")]
    docs = [(i, r.choice([None, "", "?!", text(5), text(40), text(20) + items[r.randrange(25)][1].upper() + text(8)])) for i in range(60)]
    return docs + [(5, docs[5][1]), (None, items[8][1])], items


@pytest.mark.parametrize("pairs", [100_000, 60])  # one automaton, and several after another
def test_hits_spans_and_items_equal_brute_force(spark, pairs):
    docs, items = made(1)
    items = [x for x in items if len(WORD.findall(x[1] or "")) != 1 or x[0] == 3]
    benchmark = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    frame = spark.createDataFrame([(*d, f"x{k}") for k, d in enumerate(docs)], "doc_id long, text string, item string").repartition(4)
    got = benchmark_scan.scan(frame, benchmark_scan.item_windows(benchmark), pairs=pairs).collect()
    assert len(got) == len(docs)
    for row in got:
        want = brute(row.text, items)
        assert (row.n_words, row.n_hit, [(s.first, s.last) for s in row.spans], row["items"]) == want, row
        assert (row.doc_id, row.text) == docs[int(row.item[1:])]
    assert any(row.n_hit for row in got) and any(not row.n_hit for row in got)


def test_stretches_carry_the_state_on(monkeypatch):
    docs, items = made(2)
    pairs = [(b" ".join(own[i : i + min(10, len(own))]), str(n)) for n, (_, whole) in enumerate(items) for own in [benchmark_scan.words_of(whole)] if own for i in range(len(own) - min(10, len(own)) + 1)]
    scanner = benchmark_scan.Scanner(pairs)
    whole = [scanner.runs(text) for _, text in docs]
    cut = benchmark_scan.stretches
    monkeypatch.setattr(benchmark_scan, "stretches", lambda plain: cut(plain, 17))
    assert [scanner.runs(text) for _, text in docs] == whole


def test_one_word_items_and_long_texts(spark):
    benchmark = spark.createDataFrame([("a", "Cat"), ("b", "cat!"), ("c", "dog bird")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "cat dog bird " * 200_000), (2, "concat dogbird")], "doc_id long, text string")
    long, none = sorted(benchmark_scan.decontaminate(docs, benchmark).drop("text").collect())
    assert (long.n_words, long.n_hit, long["items"], len(long.spans)) == (600_000, 600_000, ["a", "b", "c"], 1)
    assert (long.spans[0].first, long.spans[0].last) == (0, 13 * 200_000 - 1)
    assert (none.n_words, none.n_hit, none.spans, none["items"]) == (2, 0, [], [])


def test_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in benchmark_scan.decontaminate(docs, items).collect()] == [(1, "one two", 2, 0, [], [])]
    assert benchmark_scan.decontaminate(docs.limit(0), items).count() == 0
    with pytest.raises(ValueError):
        benchmark_scan.decontaminate(docs.selectExpr("*", "1 AS N_Hit"), items)
    assert "k_n_hit" in benchmark_scan.decontaminate(docs.selectExpr("*", "1 AS n_hit"), items, out="k_").columns
