import random
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from opsloom.operators import history, metrics, models, similarity, windows
from opsloom.plans import evaluate
from opsloom.sources.readers import tiny_embedded_jobs, tiny_jobs


@pytest.fixture(scope="module")
def forty(spark):
    """40 jobs in ten hours whose baseline is known."""
    rows = []
    for h in range(10):
        for j in range(4):
            compute = (h + j) % 2 == 0
            rows.append((4 * h + j, h * 60 + 10 * j, 20 + j, "compute" if compute else "debug", ["phys", "chem", "bio"][h % 3], ["alice", "bob", "charlie"][h % 3], float(j + 1), 900.0 + 30 * h + 20 * j + (60 if compute else 0)))
    df = spark.createDataFrame(rows, "job_id bigint, m int, r int, partition string, account string, user string, num_cores_req double, runtime_seconds double")
    t = F.unix_timestamp(F.lit("2026-01-01 20:00:00").cast("timestamp")) + F.col("m") * 60
    return df.withColumn("submit_time", F.timestamp_seconds(t)).withColumn("end_time", F.timestamp_seconds(t + F.col("r") * 60)).drop("m", "r")


def test_golden_baseline(forty):
    g = windows.grid(forty, n_windows=4, hours=1, lookback_days=100)
    rows = {r.window_id: r for r in metrics.report(windows.rolling_mean(forty, g), ["mae", "rmse"]).collect()}
    assert rows[None].n_test == 16 and len(rows) == 5
    assert rows[None].mae == pytest.approx(127.5) and rows[None].rmse == pytest.approx(133.93095235978873)


def test_golden_splits(spark):
    j = tiny_jobs(spark)
    g = windows.grid(j, n_windows=8, hours=6, lookback_days=2)
    plan = [(r.n_train, r.n_test) for r in windows.split_plan(j, g).orderBy("window_id").collect()]
    assert plan == [(0, 0), (0, 0), (0, 5), (5, 6), (11, 6), (17, 6), (23, 6), (29, 1)]


def test_ranges_equal_the_join_they_replace(spark):
    j = tiny_jobs(spark)
    g = windows.grid(j, n_windows=6, hours=5, lookback_days=1)
    t = windows.window_table(spark, g)
    joined = j.join(t, (F.col("end_time") >= F.col("t0") - F.expr("INTERVAL 1 DAY")) & (F.col("end_time") < F.col("t0")))
    a = {(r.job_id, r.window_id) for r in joined.collect()}
    assert a == {(r.job_id, r.window_id) for r in windows.train_rows(j, g).collect()}
    sums = {r.window_id: r for r in windows.train_sums(j, g, {"y": F.col("runtime_seconds")}).collect()}
    assert {w: sums[w].n_train for w in range(6)} == {w: sum(1 for _, k in a if k == w) for w in range(6)}


def test_split_edges(spark):
    """An end at the window's start trains nothing; a submission there is tested."""
    df = spark.createDataFrame([(1, "2026-01-01 10:00:00", "2026-01-01 12:00:00"), (2, "2026-01-01 12:00:00", "2026-01-01 12:30:00")], "job_id int, s string, e string")
    j = df.select("job_id", F.col("s").cast("timestamp").alias("submit_time"), F.col("e").cast("timestamp").alias("end_time"))
    g = windows.grid(j, n_windows=1, hours=1, lookback_days=1)
    assert windows.train_rows(j, g).count() == 0
    assert [r.job_id for r in windows.test_rows(j, g).collect()] == [2]
    with pytest.raises(ValueError, match="no value"):
        windows.grid(j.limit(0), n_windows=1, hours=1, lookback_days=1)


def test_refresh_flags(spark):
    g = windows.Grid(windows.MICROS * 3600 * 20, 4, 2, 1)
    assert [r.refresh for r in windows.window_table(spark, g).orderBy("window_id").collect()] == [True, False, True, False]


def test_row_index_is_consecutive(spark):
    df = spark.range(0, 1000, 1, 13).select((F.col("id") * 7919 % 1000).alias("x"))
    rows = windows.row_index(df, ["x"]).collect()
    assert sorted((r.row_idx, r.x) for r in rows) == [(k, k) for k in range(1000)]


def recipe(model, method="rolling", **params):
    split = {"method": method} | ({"n_windows": 3, "test_window_hours": 6, "training_lookback_days": 2} if method == "rolling" else {"train_fraction": 0.8})
    return {"model": {"id": model, "params": params}, "metrics": [{"name": n, "target": "runtime_seconds"} for n in ("mae", "rmse")], "split": split}


@pytest.mark.parametrize("model,method,params", [("mean", "fixed", {}), ("mean", "rolling", {}), ("embedding_knn", "rolling", {"k": 3}), ("perceptron", "rolling", {"rounds": 3, "hidden": (8, 4)}), ("text_knn", "rolling", {}), ("routed_means", "rolling", {"user": "partition", "value": "allocated_cpus", "least": 2}), ("routed_experts", "rolling", {"user": "partition", "value": "allocated_cpus", "least": 2, "maxIter": 2, "maxDepth": 2}), ("random_forest", "rolling", {"numTrees": 3, "maxDepth": 3, "variance": 0.95}), ("boosted_trees", "rolling", {"maxIter": 2, "maxDepth": 2})])
def test_models_run(spark, tmp_path, model, method, params):
    r = recipe(model, method, **params)
    predictions, report = evaluate.run(tiny_embedded_jobs(spark), r)
    numbers = evaluate.write_bundle(spark, str(tmp_path / "b"), r, report, predictions=predictions)
    assert numbers["mae"] >= 0 and evaluate.read_bundles(spark, str(tmp_path)).count() == 2
    with pytest.raises(FileExistsError):
        evaluate.write_bundle(spark, str(tmp_path / "b"), r, report)


def test_neighbours_do_not_see_the_future(spark):
    """Each cluster has its own runtime, which the nearest past jobs give."""
    predictions, _ = evaluate.run(tiny_embedded_jobs(spark), recipe("embedding_knn", k=3))
    assert all(abs(r.y_true - r.y_pred) < 50 for r in predictions.collect())


def test_recipe_rules():
    for broken in ({"metrics": []}, {"split": {"method": "rolling", "n_windows": 0}}, {"metrics": [{"name": "mae", "target": "x"}, {"name": "rmse", "target": "y"}]}):
        with pytest.raises(evaluate.RecipeError):
            evaluate.check(recipe("mean") | broken)


def test_only_allowed_features(spark):
    numeric, categorical, ignored = models.feature_columns(tiny_jobs(spark))
    assert (numeric, categorical) == ([], ["partition"]) and "runtime_seconds" in ignored and "allocated_cpus" in ignored


def test_encoding_of_categories(spark):
    """Rare values count as one, the width fits, and the singular vectors are those of the one-hot matrix."""
    import numpy as np

    r = np.random.default_rng(5)
    rows = [(i, "abcdefgh"[int((8 * (k % 36) + 1) ** 0.5 - 1) // 2], "xyyzzz"[k % 6] if i % 50 else f"rare{i}", float(i % 7)) for i, k in enumerate(r.permutation(400).tolist())]
    df = spark.createDataFrame(rows, "job_id int, partition string, user string, num_cores_req double")
    ready = models.prepared(df, ["num_cores_req"], ["partition", "user"])
    e = models.encode(ready, ["num_cores_req"], ["partition", "user"], variance=0.9)
    assert e.min_frequency == 2 and e.values["user"] == ["x", "y", "z"] and e.width == 13
    x = np.array([[float(r[1] == v) for v in e.values["partition"]] + [0.0] + [float(r[2] == v) for v in e.values["user"]] + [float(r[2] not in "xyz")] for r in rows])
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    k = e.basis.shape[1]
    assert np.allclose(abs(e.basis.T @ vt[:k].T), np.eye(k), atol=1e-6)
    share = np.cumsum((x @ vt.T).var(axis=0)) / x.var(axis=0).sum()
    assert share[k - 1] >= 0.9 > share[k - 2] and e.coverage == pytest.approx(share[k - 1])
    got = {r.job_id: r.features.toArray() for r in e.features(ready).collect()}
    assert np.allclose(got[5], [5.0, *(x[5] @ e.basis)])
    plain = models.encode(ready, ["num_cores_req"], ["partition", "user"], most=6)
    assert plain.width <= 8 and plain.min_frequency > 2
    assert {len(r.features) for r in plain.features(ready).collect()} == {1 + plain.width}
    told = models.diagnostics(df)
    assert told["one_hot_width"] == 13 and told["categories"]["user"]["rare_values"] == 8 and told["categories"]["partition"]["top"][0][0] == "h" and 0 < told["components"] < 13


def test_fitted_models_are_saved(spark, tmp_path):
    from pyspark.ml.regression import RandomForestRegressionModel

    j = tiny_jobs(spark)
    g = windows.grid(j, n_windows=2, hours=6, lookback_days=9)
    models.rolling_trees(j, g, "forest", save=str(tmp_path), numTrees=2, maxDepth=2)
    assert [len(RandomForestRegressionModel.load(f"{tmp_path}/window-0000{w}").trees) for w in (0, 1)] == [2, 2]


def test_weights_follow_recent_jobs(spark):
    """With a steep decay the old half of the jobs, which says otherwise, counts for nothing."""
    j = tiny_jobs(spark).withColumn("runtime_seconds", F.when(F.col("job_id") < 1015, 100.0).otherwise(5000.0)).withColumn("partition", F.lit("same"))
    g = windows.grid(j, n_windows=1, hours=3, lookback_days=30)
    options = {"numTrees": 3, "maxDepth": 2, "subsamplingRate": 1.0}
    even = models.rolling_trees(j, g, "forest", **options).agg(F.avg("y_pred")).first()[0]
    late = models.rolling_trees(j, g, "forest", decay=50.0, **options).agg(F.avg("y_pred")).first()[0]
    assert even < 4000 < 4990 < late
    statuses = {r.window_id: r.status for r in models.window_statuses(j.drop("partition"), windows.grid(j, n_windows=6, hours=6, lookback_days=1)).collect()}
    assert statuses[0] == "insufficient_training_rows" and statuses[5] == "no_features_after_preprocessing"


def test_experts_know_their_bins(spark):
    """Two requested times with their own runtimes: each expert fits its own, rare routes fall back."""
    j = tiny_jobs(spark).withColumn("requested_seconds", F.when(F.col("job_id") % 2 == 0, 600).otherwise(7200)).withColumn("runtime_seconds", F.when(F.col("job_id") % 2 == 0, 60.0).otherwise(6000.0)).withColumn("user", F.col("partition"))
    g = windows.grid(j, n_windows=1, hours=6, lookback_days=30)
    rows = models.rolling_experts(j, g, least=5, power_users=False, maxIter=2, maxDepth=1).collect()
    assert {r.route for r in rows} == {"expert"} and all(r.y_pred == pytest.approx(r.y_true) for r in rows)
    assert {r.route for r in models.rolling_experts(j, g, least=500, maxIter=1, maxDepth=1).collect()} == {"fallback"}


def test_perceptron_tells_frequent_values_apart():
    import pandas as pd

    a = pd.DataFrame({"user": ["zz"] * 50 + [f"a{k:03}" for k in range(60)] * 2, "queue": ["q"] * 170})
    assert models.kept_values(a, ["user", "queue"], 2, 100) == {"user": sorted(["zz", *(f"a{k:03}" for k in range(60))]), "queue": ["q"]}
    assert models.kept_values(a, ["user", "queue"], 2, 10) == {"user": ["zz"], "queue": ["q"]}


def test_own_history(spark):
    """The latest of equally near jobs first, unseen names apart, no prediction below k jobs, unreadable times first."""
    rows = [(k, f"2024-01-01 {k:02}:00:00" if k else "?", "u", n, c, float(y)) for k, (n, c, y) in enumerate([("a", 1, 10), ("a", 1, 20), ("b", 1, 30), ("b", 9, 40), ("a", 1, 50), ("c", 1, 60), ("a", 1, 70), ("b", 9, 80)])]
    df = spark.createDataFrame(rows, "job_id int, end_time string, user string, name string, cnumr int, runtime_seconds double")
    r = recipe("own_history", "fixed", theta=5, k=2) | {"split": {"method": "fixed", "train_fraction": 0.5}}
    got = {x.job_id: x.y_pred for x in evaluate.run(df, r)[0].collect()}
    # 4 (a, 1) has jobs 1 and 0 at distance 0.  5 (c, 1): c is unseen, so -1 against a = 0: jobs 4 and 1.
    # 6 (a, 1): jobs 4 and 1.  7 (b, 9): job 3 at 0, then job 2 beyond its context of five, so of 3 to 6: job 6, 5 and 4 at 8 and more, b = 1, c = 2: job 6 is later than 5.
    assert (got[4], got[5], got[6]) == (15, 35, 35) and got[7] == (40 + 30) / 2


def test_history_in_pieces(spark):
    """One user with most jobs: pieces of 64 give what one window a user gives, and no piece holds more than its jobs and copies."""
    df = spark.range(1500).select(F.col("id").alias("job_id"), F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id") % 11).alias("user"), (F.col("id") * 7919 % 1000).alias("at"), (F.col("id") % 17 * 1.0).alias("y"), (F.col("id") % 5).alias("x"))
    whole = history.context_mean(df, user="user", order=["at", "job_id"], target="y", theta=10)
    cut = history.context_mean(df, user="user", order=["at", "job_id"], target="y", theta=10, piece=64)
    assert sorted(whole.collect()) == sorted(cut.collect()) and cut.columns == [*df.columns, "n_context", "y_pred"]
    held, _ = history.past(df, "user", ["at", "job_id"], 10, 64)
    assert held.where("__piece >= 0").groupBy("__piece").count().agg(F.max("count")).first()[0] <= 74 and held.where("__piece >= 0").select("__piece").distinct().count() > 10
    assert held.where("__piece < 0").groupBy("user").count().agg(F.max("count")).first()[0] <= 64
    a = history.context_knn(df, user="user", order=["at", "job_id"], key="job_id", feature="x", target="y", theta=10, piece=64)
    b = history.context_knn(df, user="user", order=["at", "job_id"], key="job_id", feature="x", target="y", theta=10)
    assert sorted(a.collect()) == sorted(b.collect())


def test_neighbours_in_windows(spark, monkeypatch):
    """Without a copy of a row for each window, and in small blocks, the same neighbours."""
    j = tiny_embedded_jobs(spark)
    g = windows.grid(j, n_windows=5, hours=5, lookback_days=1)
    train, test = windows.train_rows(j, g), windows.test_rows(j, g)
    wanted = similarity.dense_neighbours(test, train, key="job_id", vector="embedding", value="runtime_seconds", group="window_id", k=3)
    lo, hi = windows.train_range(g, F.col("end_time"))
    for block in (1024, 7):
        monkeypatch.setattr(similarity, "BLOCK", block)
        got = similarity.windowed_neighbours(test, j, key="job_id", vector="embedding", value="runtime_seconds", window="window_id", lo=lo, hi=hi, k=3)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_randomized_singular_vectors(spark):
    """Shares of variance as those of all eigenvectors, within 0.001, of more columns than the sketch has vectors."""
    r = np.random.default_rng(3)
    group = r.integers(0, 12, 3000)
    frame = pd.DataFrame({"user": [f"u{g * 9 + k}" for g, k in zip(group, r.integers(0, 9, 3000))], "queue": [f"q{g % 5}" for g in group], "name": [f"n{k}" for k in r.zipf(1.6, 3000) % 90]})
    df = spark.createDataFrame(frame).repartition(3)
    cols = ["user", "queue", "name"]
    e = models.encode(df, [], cols)
    first = np.cumsum([0, *(len(v) + 1 for v in e.values.values())])
    x = np.zeros((len(frame), first[-1]))
    for k, c in enumerate(cols):
        at = {v: j for j, v in enumerate(e.values[c])}
        x[np.arange(len(frame)), [first[k] + at.get(v, len(at)) for v in frame[c]]] = 1
    vt = np.linalg.svd(x, full_matrices=False)[2]
    want = np.cumsum((x @ vt.T).var(axis=0)) / x.var(axis=0).sum()
    for most in (20, 40, 1000):
        basis, share = models.singular_vectors(e, df, 0.999999 if most < 1000 else 0.9, most)
        k = basis.shape[1]
        assert share == pytest.approx(want[k - 1], abs=1e-3) and np.allclose(basis.T @ basis, np.eye(k), atol=1e-8)
        assert (x @ basis).var(axis=0).sum() / x.var(axis=0).sum() == pytest.approx(want[k - 1], abs=1e-3)
        assert k == most or want[k - 1] >= 0.9 - 1e-3


def test_own_history_goes_batch_by_batch(spark):
    """Against plain Python, histories longer than a batch and than a piece, with null users, names and targets; no row holds its context."""
    r = random.Random(5)
    rows = [(i, r.choice(["u", "u", "v", None]), r.choice(["é", "z", "A", "", None]), r.choice([1.0, 2.0, 5.0, None]), r.choice([1.0, 7.5, 9.25, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "job_id int, user string, name string, x double, y double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = history.context_nearest(df, user="user", order=["job_id"], name=F.col("name"), numbers=[F.col("x")], target="y", theta=9, k=3, piece=50)
        got = {x.job_id: (x.n_context, x.y_pred) for x in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out.columns == [*df.columns, "n_context", "y_pred"] and "collect_list" not in out._jdf.queryExecution().toString()
    for i, user, name, x, _ in rows:
        context = [c for c in rows[:i] if c[1] == user][-9:][::-1]
        names = sorted({c[2] or "" for c in context}, key=str.encode)
        place = lambda n: names.index(n or "") if (n or "") in names else -1
        near = sorted(context, key=lambda c: (place(c[2]) - place(name)) ** 2 + ((c[3] or 0) - (x or 0)) ** 2)[:3]
        whole = len(near) == 3 and all(c[4] is not None for c in near)
        assert got[i] == (len(context), sum(c[4] for c in near) / 3 if whole else None)


def test_routed_means_add_up_before_they_join(spark, monkeypatch):
    """Routes and means as from the rows one by one, with null users, values and targets; training rows are never joined."""
    u = F.when(F.col("id") % 13 != 0, F.when(F.col("id") % 3 == 0, F.lit("big")).otherwise(F.concat(F.lit("u"), (F.col("id") % 40).cast("string"))))
    v = F.when(F.col("id") % 17 != 0, F.element_at(F.array(*map(F.lit, (60, 600, 3600, 0))), (F.col("id") % 4 + 1).cast("int")))
    rows = spark.range(900).select("id", (F.col("id") % 2).cast("int").alias("g"), u.alias("user"), v.alias("v"), F.when(F.col("id") % 11 != 0, F.col("id") * 1.25).alias("y"))
    train, test = rows.where("id < 700"), rows.where("id >= 700")
    a, b = history.placed(train, test, group="g", user="user", value="v")
    a, b = a.toPandas(), b.toPandas()
    mean = a.groupby(["g", "__key", "__bin"])["y"].agg(["size", "mean"])
    mean = mean[mean["size"] >= 20]["mean"].to_dict()
    want = {r["id"]: mean.get((r["g"], r["__key"], r["__bin"])) for _, r in b.iterrows()}
    whole = a.groupby("g")["y"].mean()
    monkeypatch.setattr(history, "placed", lambda *a, **k: pytest.fail("rows are joined"))
    got = history.routed_means(train, test, group="g", user="user", value="v", target="y", least=20).collect()
    assert len(got) == 200 and {r.route for r in got} == {"expert", "fallback"}
    for r in got:
        assert r.route == ("fallback" if want[r.id] is None else "expert")
        assert r.y_pred == pytest.approx(whole[r.g] if want[r.id] is None else want[r.id])
