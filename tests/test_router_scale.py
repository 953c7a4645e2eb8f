"""The router's grams and its training table."""

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from rungwork.operators import router_model as rm

ARMS = "item_key string, question string, arm_name string, arm_kind string, arm_strength double, hint_tokens double, correct boolean"


def _labelled(spark):
    rows = [(f"q{i}", f"prove hard lemma {i % 7}" if i % 2 else f"add  Small numbers {i % 5}", "none", "none", 0.0, float(i % 3), i % 2 == 0 or i % 9 == 0) for i in range(60)]
    return rm.with_split(spark.createDataFrame(rows, ARMS), seed=1)


def test_training_table_keeps_no_feature_names(spark):
    router = rm.fit_router(_labelled(spark), max_features=200, max_iter=20)
    assert "ml_attr" not in router.training.schema["features"].metadata
    slopes = rm.gradient(router).agg(F.count(F.lit(1)), F.max(F.abs("gradient"))).first()
    assert slopes[0] == router.classifier.numFeatures + 1 and slopes[1] < 1e-2


def test_grams_are_counted_before_the_shuffle(spark):
    texts = ["Ab  ab É", "", None, "ab b", "b ab abc 🙂x"]
    grams = PipelineModel(rm.gram_stages()).transform(spark.createDataFrame([(t,) for t in texts], "question string"))
    want = {}
    for at, text in enumerate(texts):
        for word in (f" {w} " for w in (text or "").lower().split()):
            for gram in (word[i : i + n] for n in (3, 4, 5) for i in range(len(word) - n + 1)):
                want.setdefault(gram, []).append(at)
    found = rm.vocabulary(grams, "char_grams", 1_000, least_rows=1)
    assert {(r.gram, r.rows, r.uses) for r in found.collect()} == {(g, len(set(v)), len(v)) for g, v in want.items()}
    plan = rm.vocabulary(grams, "word_grams", 1_000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_slices_and_early_handing_on_change_no_count(spark, monkeypatch):
    grams = PipelineModel(rm.gram_stages()).transform(spark.createDataFrame([(f"word{i % 11} other{i % 4} word1",) for i in range(200)], "question string"))
    lists = grams.select("char_words").toArrow().column(0).combine_chunks()
    numbers = {}
    number = lambda p: [numbers.setdefault(g, len(numbers)) for g in rm.char_grams(p)]
    whole = [(a + f, g, n) for f, _, at, gram, uses in rm._text_counts(lists, number) for a, g, n in zip(at, gram, uses)]
    monkeypatch.setattr(rm, "SPREAD", 50)
    cut = [(a + f, g, n) for f, _, at, gram, uses in rm._text_counts(lists, number) for a, g, n in zip(at, gram, uses)]
    assert whole == cut and len(whole) > 1_000
    batches = grams.select("char_words").toArrow().to_batches(max_chunksize=20)
    total = lambda parts: {g: tuple(map(sum, zip(*[(r["rows"], r["uses"]) for p in parts for r in p.to_pylist() if r["gram"] == g]))) for g in numbers}
    once = total(list(rm._tally(rm.char_grams)(iter(batches))))
    monkeypatch.setattr(rm, "REMEMBERED", 10)
    many = list(rm._tally(rm.char_grams)(iter(batches)))
    assert len(many) > 5 and total(many) == once


def test_word_pairs_are_counted_as_numbers(spark, monkeypatch):
    texts = ["aa bb aa bb", "aa bb aa bb", "", "bb", "x", "bb aa cc É1 aa"] * 3
    rows = PipelineModel(rm.gram_stages()).transform(spark.createDataFrame([(t,) for t in texts], "question string").coalesce(1))
    want = {}
    for at, text in enumerate(texts):
        words = [w for w in text.lower().split() if len(w) > 1]
        for gram in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
            want.setdefault(gram, []).append(at)
    want = {g: (len(set(v)), len(v)) for g, v in want.items()}
    for spread, held in ((rm.SPREAD, rm.HELD), (4, 2)):
        monkeypatch.setattr(rm, "SPREAD", spread)
        monkeypatch.setattr(rm, "HELD", held)
        batch = rows.select("word_tokens").toArrow().combine_chunks().to_batches()[0]
        got = {}
        for part in rm._tally_words(iter([batch])):
            for r in part.to_pylist():
                old = got.get(r["gram"], (0, 0))
                got[r["gram"]] = (old[0] + r["rows"], old[1] + r["uses"])
        assert got == want
    assert {r.gram: (r.rows, r.uses) for r in rm.vocabulary(rows, "word_grams", 100, 1).collect()} == want


def test_equal_neighbours_are_counted_once(spark, monkeypatch):
    lists = PipelineModel(rm.gram_stages()).transform(spark.createDataFrame([(f"abc{i // 2} de",) for i in range(40)], "question string").coalesce(1))
    lists = lists.select("char_words").toArrow().column(0).combine_chunks()
    sorted_keys, plain = [], rm.np.argsort
    monkeypatch.setattr(rm.np, "argsort", lambda a, **k: sorted_keys.append(len(a)) or plain(a, **k))
    numbers = {}
    counts = [len(at) for _, _, at, _, _ in rm._text_counts(lists, lambda p: [numbers.setdefault(g, len(numbers)) for g in rm.char_grams(p)])]
    assert 2 * sum(sorted_keys) == sum(counts)


def test_gradient_needs_no_row_per_feature(spark):
    router = rm.fit_router(_labelled(spark), max_features=200, max_iter=20)
    found = {r.feature: r.gradient for r in rm.gradient(router).collect()}
    rows, model = router.training.collect(), router.classifier
    want = model.getRegParam() * model.coefficients.toArray()
    whole = sum(r.weight for r in rows)
    for r in rows:
        margin = r.features.dot(model.coefficients) + model.intercept
        want = want + r.weight * (1 / (1 + rm.np.exp(-margin)) - r.label) * r.features.toArray() / whole
    assert max(abs(found[i] - g) for i, g in enumerate(want)) < 1e-9
    assert "Generate" not in rm.gradient(router)._jdf.queryExecution().executedPlan().toString()
