import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from opsloom.operators import forest, models, windows
from opsloom.sources.readers import tiny_jobs


def test_a_tree_is_the_one_of_all_rows(spark):
    """Grown from the sums of cells, with all columns at every node, as Spark ML grows one from the rows."""
    rng = np.random.default_rng(1)
    a, c = rng.integers(0, 8, 2000), rng.integers(0, 4, 2000)
    y = 100.0 * (a > 3) + 30.0 * a * (c == 2) + rng.normal(0, 5, 2000)
    df = spark.createDataFrame([(float(i), *(float(k == v) for v in range(4)), float(x)) for i, k, x in zip(a, c, y)], "a double, c0 double, c1 double, c2 double, c3 double, label double")
    rows = VectorAssembler(inputCols=["a", "c0", "c1", "c2", "c3"], outputCol="features").transform(df)
    fitted = DecisionTreeRegressor(maxDepth=4).fit(rows).transform(rows)
    expected = {(r.a, r.c0, r.c1, r.c2, r.c3): r.prediction for r in fitted.collect()}
    cells, back = np.unique(np.array([a, c]), axis=1, return_inverse=True)
    back = back.reshape(-1)
    o = forest.Options(maxDepth=4, featureSubsetStrategy="all")
    got = forest.grow(o, [cells[0].astype(float)], [cells[1]], [4], np.bincount(back).astype(float), np.bincount(back, y), rng)
    for x, v, p in zip(*cells, got):
        assert abs(p - expected[(float(x), *(float(v == k) for k in range(4)))]) < 1e-6


def test_rows_are_drawn_with_replacement():
    o, rid = forest.Options(subsamplingRate=0.5), np.arange(200_000)
    times = forest.drawn(o, rid, 3)
    assert abs(times.mean() - 0.5) < 0.01 and abs(times.var() - 0.5) < 0.01
    assert not np.array_equal(times, forest.drawn(o, rid, 4))


def test_thresholds_of_many_values():
    x = np.arange(1000.0)
    assert len(forest.thresholds(x, np.ones(1000), 32)) == 31
    assert forest.thresholds(np.array([1.0, 3.0, 3.0]), np.ones(3), 32).tolist() == [2.0]


def test_forests_of_few_cells_take_no_fit_a_window(spark, monkeypatch):
    """All windows by one pass over the rows, with predictions near those of Spark ML's forests; beyond CELLS, those."""
    j = tiny_jobs(spark).withColumn("requested_seconds", F.col("runtime_seconds") * 2)
    g = windows.grid(j, n_windows=3, hours=3, lookback_days=9)
    options = {"numTrees": 60, "maxDepth": 3, "featureSubsetStrategy": "all", "maxBins": 4}
    with monkeypatch.context() as m:
        m.setattr(forest, "CELLS", 3)
        fitted = {(r.window_id, r.job_id): r for r in models.rolling_trees(j, g, "forest", **options).collect()}
    monkeypatch.setattr(models, "regressor", None)
    grown = models.rolling_trees(j, g, "forest", **options)
    rows = {(r.window_id, r.job_id): r for r in grown.collect()}
    assert rows.keys() == fitted.keys() and rows
    assert all(rows[k].y_true == fitted[k].y_true and abs(rows[k].y_pred - fitted[k].y_pred) < 150 for k in rows)
    again = {(r.window_id, r.job_id): r for r in models.rolling_trees(j.repartition(5), g, "forest", **options).collect()}
    assert again == rows
    log = models.rolling_trees(j, g, "forest", log=True, windows=[1], **options).collect()
    assert {r.window_id for r in log} == {1} and all(500 < r.y_pred < 1800 for r in log)
