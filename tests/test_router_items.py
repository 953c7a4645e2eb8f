"""Router texts and vectors are held once an item and moved in small batches."""

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from rungwork.operators import router_model as rm
from rungwork.operators.routing import grouped_split

ITEM = "item_key string, question string, hint_tokens double, arms array<struct<arm_name:string,arm_kind:string,arm_strength:double,correct:boolean>>"


def _items(spark):
    rows = [
        (f"q{i}", f"prove hard lemma {i % 7}" if i % 2 else f"add  Small numbers {i % 5}", float(i % 3), [("none", "none", 0.0, i % 2 == 0 or i % 9 == 0), ("plan@1", "plan", 1.0, i % 5 > 0)])
        for i in range(60)
    ]
    return rm.with_split(spark.createDataFrame(rows, ITEM), seed=1)


def test_rows_do_not_move_for_their_split(spark):
    items = _items(spark)
    assert "Exchange" not in items._jdf.queryExecution().executedPlan().toString()
    want = {r["item_key"]: r["split"] for r in grouped_split(items.drop("split"), seed=1).collect()}
    assert {r["item_key"]: r["split"] for r in items.collect()} == want


def test_texts_of_items_are_counted_once_for_all_arms(spark):
    items = _items(spark)
    arms = rm.listed_arms(items)
    cut = lambda rows: PipelineModel(rm.gram_stages()).transform(rows)
    for kind in rm.GRAMS:
        both = [{(r["gram"], r["rows"], r["uses"], r["place"]) for r in rm.vocabulary(cut(rows), kind, 500).collect()} for rows in (items, arms)]
        assert both[0] == both[1] and len(both[0]) >= 10
    a, b = (rm.fit_router(rows, max_features=200, max_iter=50) for rows in (items, arms))
    assert abs(a.classifier.coefficients.toArray() - b.classifier.coefficients.toArray()).max() < 1e-6
    counts = rm._counted(a.counts, items)
    assert counts.count() == 60 and "question" not in counts.columns


def test_whole_texts_and_vectors_move_in_small_batches(spark, monkeypatch):
    seen, fitted = [], rm._fitted
    monkeypatch.setattr(rm, "_fitted", lambda *a: seen.append([int(spark.conf.get(k)) for k in rm.BATCHES]) or fitted(*a))
    before = [spark.conf.get(k) for k in rm.BATCHES]
    rm.fit_router(_items(spark), max_features=200, max_iter=5)
    assert seen == [[500, 256]] and [spark.conf.get(k) for k in rm.BATCHES] == before


def test_counts_leave_a_task_in_parts(spark, monkeypatch):
    monkeypatch.setattr(rm, "HANDED", 10)
    rows = PipelineModel(rm.gram_stages()).transform(spark.createDataFrame([(f"word{i} other{i}",) for i in range(50)], "question string").coalesce(1))
    for column, tally in rm.GRAMS.values():
        parts = list(tally(iter(rows.select(column).toArrow().combine_chunks().to_batches())))
        assert len(parts) > 5 and max(map(len, parts)) == 10


def test_features_of_many_rows_are_not_written(spark, monkeypatch):
    scanned = lambda r: "features" in r.training._jdf.queryExecution().executedPlan().toString().split("FileScan")[1]
    few = rm.fit_router(_items(spark), max_features=200, max_iter=50)
    monkeypatch.setattr(rm, "WRITTEN", 0)
    many = rm.fit_router(_items(spark), max_features=200, max_iter=50)
    assert scanned(few) and not scanned(many)
    a, b = ({r["feature"]: r["gradient"] for r in rm.gradient(m).collect()} for m in (few, many))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-6
    assert "ml_attr" not in many.training.schema["features"].metadata
