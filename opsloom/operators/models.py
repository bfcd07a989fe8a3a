"""Regressors fitted in each evaluation window.

Training and test rows of a window meet under its number.  Windows are independent, so several are
fitted at once: forests of few cells for all windows by one pass (see forest), other trees by Spark ML over the
distributed rows of one window, from a few threads of the driver that only start jobs; small models by a group map with the training rows bounded by
``max_rows`` (a documented sample by hash beyond it).

Categories are prepared once a day, by the first window of the day that has training rows: values
below the least frequency at which the one-hot columns fit count as one, and the columns can be
reduced to the right singular vectors that explain a share of their variance.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.transforms import finite, log_target, unlog_target
from ..scratch import checkpoint
from . import boosting, forest, history
from .quality import categories, category_profile, one_hot_width
from .windows import MICROS, Grid, micros, split_plan, test_rows, train_range, train_rows

#: Columns known at submission, the only ones that may be features.
ALLOWED = [
    "num_nodes_req",
    "nodes_requested",
    "num_cores_req",
    "processors_requested",
    "num_gpus_req",
    "gpus_requested",
    "num_tasks_req",
    "requested_seconds",
    "wallclock_requested",
    "wallclock_requested_seconds",
    "requested_memory_mib",
    "memory_requested",
    "partition",
    "queue",
    "qos",
    "constraints",
    "user",
    "account",
    "name",
    "job_name",
    "job_type",
    "platform",
    "machine",
    "machine_name",
    "science_field",
    "science_field_short",
    "award_category",
    "submit_line",
    "work_dir",
    "script",
]


def feature_columns(df: DataFrame, extra: tuple[str, ...] = ()) -> tuple[list[str], list[str], list[str]]:
    """(numeric, categorical, ignored): only allowed columns are features, so none that is known later slips in."""
    numeric, categorical, ignored = [], [], []
    for field in df.schema:
        kind = field.dataType.typeName()
        if field.name not in ALLOWED and field.name not in extra:
            ignored.append(field.name)
        elif kind in ("string", "boolean"):
            categorical.append(field.name)
        elif kind in ("byte", "short", "integer", "long", "float", "double", "decimal"):
            numeric.append(field.name)
        else:
            ignored.append(field.name)
    return numeric, categorical, ignored


def prepared(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Numbers with 0 for nothing; categories as strings with '' for nothing."""
    cols = {c: F.coalesce(finite(F.col(c)), F.lit(0.0)) for c in numeric} | {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in categorical}
    return df.withColumns(cols) if cols else df


@dataclass
class Encoding:
    """How a day's categories become features: the values of each column that are told apart, and the basis they are reduced to."""

    numeric: list[str]
    values: dict[str, list[str]]
    min_frequency: int
    basis: np.ndarray | None = None
    coverage: float = 1.0

    @property
    def width(self) -> int:
        return sum(len(v) + 1 for v in self.values.values())

    def indexed(self, df: DataFrame) -> DataFrame:
        """df with the place of each category, the last one for rare and unseen values."""
        if not self.values:
            return df
        cols = list(self.values)
        model = StringIndexerModel.from_arrays_of_labels([self.values[c] for c in cols], inputCols=cols, outputCols=[f"{c}__i" for c in cols], handleInvalid="keep")
        # Spark fills the lists of labels up to one length, so what is unseen has a place behind the longest.
        return model.transform(df).withColumns({f"{c}__i": F.least(F.col(f"{c}__i"), F.lit(float(len(v)))) for c, v in self.values.items()})

    def features(self, df: DataFrame) -> DataFrame:
        """df with a vector column features."""
        df, inputs, extra = self.indexed(df), list(self.numeric), [f"{c}__i" for c in self.values]
        if self.values and self.basis is not None:
            df, inputs = df.withColumn("__svd", array_to_vector(self.projection()(*extra))), [*inputs, "__svd"]
            extra.append("__svd")
        elif self.values:
            codes = [f"{c}__v" for c in self.values]
            sizes = [len(v) + 1 for v in self.values.values()]
            # The encoder learns nothing but the number of categories, which is known.
            known = df.sparkSession.createDataFrame([[float(min(k, n - 1)) for n in sizes] for k in range(max(sizes))], ", ".join(f"`{c}` double" for c in extra))
            df = OneHotEncoder(inputCols=extra[: len(sizes)], outputCols=codes, dropLast=False).fit(known).transform(df)
            inputs, extra = inputs + codes, extra + codes
        return VectorAssembler(inputCols=inputs, outputCol="features").transform(df).drop(*extra)

    def projection(self) -> Callable[..., Column]:
        basis, first = self.basis, np.cumsum([0, *(len(v) + 1 for v in self.values.values())])[:-1]

        @F.pandas_udf("array<double>")
        def run(*places: pd.Series) -> pd.Series:
            rows = sum(basis[first[k] + p.to_numpy().astype(int)] for k, p in enumerate(places))
            return pd.Series(list(rows))

        return run


def encode(train: DataFrame, numeric: list[str], categorical: list[str], *, floor: int = 2, most: int = 2048, variance: float | None = None, components: int = 256) -> Encoding:
    """The encoding that training rows give; most bounds its width, whatever the number of values.

    variance: the share that the singular vectors must explain, None for one-hot columns.
    """
    if not categorical:
        return Encoding(numeric, {}, floor)
    fit = one_hot_width(train, categorical, floor=floor, most=most).first()
    least = fit.min_frequency if fit else None
    if least is None:  # more columns than the width has room for
        return Encoding(numeric, {}, floor)
    kept = categories(train, categorical).where((F.col("n") >= least) & F.col("value").isNotNull()).select("column", "value").collect()  # at most the width
    out = Encoding(numeric, {c: sorted(r["value"] for r in kept if r["column"] == c) for c in categorical}, least)
    if variance is not None:
        out.basis, out.coverage = singular_vectors(out, train, variance, components)
    return out


#: Rows of a matrix that are summed as one piece; vectors of the sketch beyond those wanted; power rounds.
CHUNK, SPARE, POWERS = 256, 60, 4


def singular_vectors(e: Encoding, train: DataFrame, variance: float, most: int, *, seed: int = 42, powers: int = POWERS) -> tuple[np.ndarray, float]:
    """(right singular vectors of the one-hot rows, the share of variance they explain).

    A randomized range finder: the product of the Gram matrix with most + SPARE seeded vectors, and with their
    orthogonal basis in each power round, is summed by tasks from the different rows and their counts.  The driver
    holds width times as many numbers, never width squared; with no more columns than that the result is exact.
    """
    first = np.cumsum([0, *(len(v) + 1 for v in e.values.values())])
    width = int(first[-1])
    places = F.array(*((F.col(f"{c}__i") + float(first[k])).cast("int") for k, c in enumerate(e.values)))
    rows = checkpoint(e.indexed(train).groupBy(places.alias("p")).agg(F.count(F.lit(1)).alias("n")))
    n = max(1, rows.agg(F.sum("n")).first()[0] or 0)

    def times(basis: np.ndarray) -> np.ndarray:
        """The Gram matrix of the rows times the basis, over n."""

        def partial(batches):
            total = np.zeros_like(basis)
            touched = np.zeros(width, dtype=bool)
            for batch in batches:
                if batch.num_rows:
                    at = batch.column("p").flatten().to_numpy().reshape(batch.num_rows, -1)
                    sums = sum(basis[at[:, k]] for k in range(at.shape[1])) * batch.column("n").to_numpy()[:, None]
                    for k in range(at.shape[1]):
                        np.add.at(total, at[:, k], sums)
                    touched[at] = True
            for c in np.unique(np.flatnonzero(touched) // CHUNK):
                yield pa.RecordBatch.from_pydict({"c": pa.array([c], pa.int32()), "m": pa.array([total[c * CHUNK : (c + 1) * CHUNK].tobytes()], pa.binary())})

        def added(key, t):
            total = sum(np.frombuffer(m) for m in sorted(t.column("m").to_pylist()))
            return pa.table({"c": pa.array([key[0].as_py()], pa.int32()), "m": pa.array([total.tobytes()], pa.binary())})

        out = np.zeros_like(basis)
        for r in rows.mapInArrow(partial, "c int, m binary").groupBy("c").applyInArrow(added, "c int, m binary").collect():  # the width over CHUNK
            out[r["c"] * CHUNK : (r["c"] + 1) * CHUNK] = np.frombuffer(r["m"]).reshape(-1, basis.shape[1])
        return out / n

    size = min(width, most + SPARE)
    q = np.eye(width) if size == width else np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))[0]
    for _ in range(0 if size == width else powers + 1):
        q = np.linalg.qr(times(q))[0]
    values, inner = np.linalg.eigh(q.T @ times(q))
    values, vectors = values[::-1], (q @ inner)[:, ::-1]
    mean = np.zeros(width)
    for r in rows.select(F.explode("p").alias("i"), "n").groupBy("i").agg(F.sum("n").alias("n")).collect():  # at most the width
        mean[r["i"]] = r["n"] / n
    total = (mean - mean**2).sum()
    share = np.cumsum(values - (mean @ vectors) ** 2) / max(total, 1e-12)
    k = min(int(np.searchsorted(share, variance) + 1), most, len(values))
    return vectors[:, :k].copy(), float(min(1.0, share[k - 1]))


def diagnostics(df: DataFrame, *, extra: tuple[str, ...] = (), variance: float = 0.95, most: int = 2048, top: int = 10) -> dict:
    """What the preparation of a table's categories comes to: profiles, the one-hot plan and the singular vectors needed."""
    numeric, categorical, ignored = feature_columns(df, extra)
    ready = prepared(df, numeric, categorical)
    e = encode(ready, numeric, categorical, most=most, variance=variance)
    frequent: dict[str, list] = {}
    if categorical:
        ranked = categories(ready, categorical).where("value is not null")
        first = ranked.withColumn("__r", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("__r") <= top)
        for r in first.orderBy("column", "__r").collect():
            frequent.setdefault(r["column"], []).append([r["value"], r["n"]])
    profiles = {r["column"]: r.asDict() | {"top": frequent.get(r["column"], [])} for r in category_profile(ready, categorical).collect()} if categorical else {}
    return {
        "rows": df.count(), "numeric": numeric, "ignored": ignored, "categories": profiles, "min_frequency": e.min_frequency, "one_hot_width": e.width,
        "components": 0 if e.basis is None else e.basis.shape[1], "coverage": e.coverage,
    }


def regressor(kind: str, *, seed: int = 42, weighted: bool = False, **params):
    """kind: gbt or forest."""
    common = {"featuresCol": "features", "labelCol": "label", "predictionCol": "prediction", "seed": seed} | ({"weightCol": "weight"} if weighted else {})
    if kind == "gbt":
        return GBTRegressor(**common, **({"maxIter": 100, "maxDepth": 8, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "minInstancesPerNode": 5} | params))
    return RandomForestRegressor(**common, **({"numTrees": 100, "maxDepth": 16, "featureSubsetStrategy": "sqrt"} | params))


def window_statuses(jobs: DataFrame, g: Grid, extra: tuple[str, ...] = ()) -> DataFrame:
    """split_plan with the reason why a fitted model skips a window: too few rows, or no column that may be a feature."""
    numeric, categorical, _ = feature_columns(jobs, extra)
    plan = split_plan(jobs, g)
    status = F.when(F.col("n_train") < 2, "insufficient_training_rows").when(F.col("n_test") < 1, "insufficient_test_rows")
    return plan.withColumn("status", status.otherwise("ok" if numeric + categorical else "no_features_after_preprocessing"))


def _rolling(jobs: DataFrame, g: Grid, score: Callable, *, windows: list[int] | None, extra: tuple[str, ...], log: bool, decay: float, variance: float | None, most: int, parallel: int, cells: forest.Options | None = None) -> DataFrame:
    """The rows that score(train, test, window) gives in each window; both have features, label and weight.

    cells: a forest in place of score, where the features are few enough.
    """
    numeric, categorical, _ = feature_columns(jobs, extra)
    known = checkpoint(prepared(jobs.where(finite(F.col("runtime_seconds")).isNotNull()), numeric, categorical))
    plan = [r for r in window_statuses(known, g, extra).orderBy("window_id").collect() if windows is None or r.window_id in windows]
    lo, hi = train_range(g, F.col("end_time"))
    label = log_target(F.col("runtime_seconds")) if log else F.col("runtime_seconds").cast("double")

    def train_of(w: int) -> DataFrame:
        return known.where((lo <= w) & (hi >= w))

    days: dict[str, int] = {}
    for r in plan:
        if r.n_train >= 2 and numeric + categorical:
            days.setdefault(r.day, r.window_id)

    def one(w: int, e: Encoding) -> DataFrame:
        start = F.lit(g.start + w * g.step)
        age = F.greatest(F.lit(0.0), (start - micros(F.col("end_time"))) / (86400.0 * MICROS))
        cols = {"label": label, "weight": F.exp(-decay * age)}
        train = e.features(train_of(w).withColumns(cols)).persist()
        try:
            test = e.features(test_rows(known, g).where(F.col("window_id") == w))
            return checkpoint(score(train, test, w))
        finally:
            train.unpersist()

    todo = [r for r in plan if r.status == "ok"]
    if not todo:
        raise ValueError("no window has enough rows")
    with ThreadPoolExecutor(parallel) as pool:
        made = dict(pool.map(lambda d: (d[0], encode(train_of(d[1]), numeric, categorical, most=most, variance=variance)), days.items()))
        if cells is not None and (found := _cells(known, numeric + categorical)) is not None:
            return _forest_rows(known, g, found, numeric + categorical, label, {r.window_id: made[r.day] for r in todo}, cells)
        scored = list(pool.map(lambda r: one(r.window_id, made[r.day]), todo))
    out = scored[0]
    for x in scored[1:]:
        out = out.unionByName(x)
    return out


def _cells(known: DataFrame, features: list[str]) -> DataFrame | None:
    """cell and the features of each different row; None if there are more than forest.CELLS."""
    rows = known.select(*features).distinct().limit(forest.CELLS + 1).collect()
    if len(rows) > forest.CELLS:
        return None
    kinds = dict(known.dtypes)
    rows = sorted(rows, key=lambda r: [(v is not None, v) for v in r])
    return known.sparkSession.createDataFrame([(k, *r) for k, r in enumerate(rows)], "cell int, " + ", ".join(f"`{c}` {kinds[c]}" for c in features))


def _forest_rows(known: DataFrame, g: Grid, cells: DataFrame, features: list[str], label: Column, encodings: dict[int, Encoding], options: forest.Options) -> DataFrame:
    """Test rows of the windows with the prediction of each window's forest."""
    lo, hi = train_range(g, F.col("end_time"))
    train = known.join(F.broadcast(cells), features).select(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), "cell", F.xxhash64(F.col("job_id").cast("string")).alias("rid"), label.alias("label")).where("lo <= hi")  # at most CELLS
    test = test_rows(known, g).where(F.col("window_id").isin(list(encodings))).join(F.broadcast(cells), features).withColumn("window_id", F.col("window_id").cast("int"))
    predicted = forest.predictions(train, test.select("window_id", "cell").distinct(), cells, encodings, options)
    return test.join(F.broadcast(predicted), ["window_id", "cell"])  # at most CELLS a window


def _told(scored: DataFrame, log: bool) -> DataFrame:
    p = F.col("prediction")
    return scored.withColumn("y_true", F.col("runtime_seconds")).withColumn("y_pred", unlog_target(p) if log else p)


def rolling_trees(
    jobs: DataFrame, g: Grid, kind: str, *, windows: list[int] | None = None, log: bool = False, decay: float = 0.0, variance: float | None = None, most: int = 2048, extra: tuple[str, ...] = (), parallel: int = 4, save: str | None = None, **params
) -> DataFrame:
    """window_id, job_id, y_true, y_pred of the test rows, by a tree model fitted on each window's training rows.

    decay: rows that ended d days before their window weigh exp(-decay * d); variance: see encode();
    parallel: windows that are fitted at once; save: a folder for the fitted model of each window.
    Boosted trees over the columns themselves (no variance) are fitted by rolling_boosted().  Forests of unweighted rows that
    aren't saved grow from sums over cells, if there are at most forest.CELLS of them.
    """
    if kind == "gbt" and variance is None:
        return rolling_boosted(jobs, g, windows=windows, log=log, decay=decay, most=most, extra=extra, save=save, **params)

    def score(train: DataFrame, test: DataFrame, w: int) -> DataFrame:
        model = regressor(kind, weighted=decay > 0, **params).fit(train)
        if save:
            model.write().overwrite().save(f"{save}/window-{w:05}")
        return _told(model.transform(test), log).select("window_id", "job_id", "y_true", "y_pred")

    cells = None
    if kind == "forest" and variance is None and not decay and not save and set(params) <= set(forest.Options.__dataclass_fields__):
        cells = forest.Options(**params)
    out = _rolling(jobs, g, score, windows=windows, extra=extra, log=log, decay=decay, variance=variance, most=most, parallel=parallel, cells=cells)
    return out if "y_pred" in out.columns else _told(out, log).select("window_id", "job_id", "y_true", "y_pred")


#: Options of fitted trees under the names that recipes use -> those of boosting.Spec.
BOOST_NAMES = {"maxIter": "rounds", "maxDepth": "depth", "stepSize": "rate", "subsamplingRate": "subsample", "columnRate": "columns", "minInstancesPerNode": "least"}


def boost_spec(numeric: list[str], categorical: list[str], *, objective: str = "squared", seed: int = 42, most: int = 2048, **params) -> boosting.Spec:
    """objective: squared or absolute; params: options of boosting.Spec, also by their names in recipes."""
    if objective not in ("squared", "absolute"):
        raise ValueError(f"unknown objective {objective}")
    named = {BOOST_NAMES.get(k, k): v for k, v in params.items()}
    return boosting.Spec(squared=objective == "squared", seed=seed, most=most, numeric=tuple(numeric), categorical=tuple(categorical), **named)


def _training_rows(known: DataFrame, g: Grid, plan: DataFrame, log: bool, decay: float) -> DataFrame:
    """Rows of the windows that can be fitted, once for each, with label, weight and rid."""
    age = F.greatest(F.lit(0.0), (F.lit(g.start) + F.col("window_id") * g.step - micros(F.col("end_time"))) / (86400.0 * MICROS))
    cols = {"label": log_target(F.col("runtime_seconds")) if log else F.col("runtime_seconds").cast("double"), "weight": F.exp(-decay * age), "rid": F.xxhash64(F.col("job_id").cast("string"))}
    fitted = plan.where("status = 'ok'").select("window_id")
    return train_rows(known, g).join(F.broadcast(fitted), "window_id").withColumns(cols)  # a row a window


def rolling_boosted(
    jobs: DataFrame, g: Grid, *, windows: list[int] | None = None, log: bool = False, decay: float = 0.0, most: int = 2048, extra: tuple[str, ...] = (), task_rows: int = 1_000_000, save: str | None = None, **params
) -> DataFrame:
    """window_id, job_id, y_true, y_pred of the test rows, by boosted trees of all windows fitted at once.

    decay: rows that ended d days before their window weigh exp(-decay * d); save: a folder for the
    nodes of all models, a table that boosting.predict() reads; params: see boost_spec().
    """
    numeric, categorical, _ = feature_columns(jobs, extra)
    known = checkpoint(prepared(jobs.where(finite(F.col("runtime_seconds")).isNotNull()), numeric, categorical))
    plan = checkpoint(window_statuses(known, g, extra))
    plan = plan if windows is None else plan.where(F.col("window_id").isin(windows))
    spec = boost_spec(numeric, categorical, most=most, **params)
    nodes = boosting.fit(_training_rows(known, g, plan, log, decay), spec, keys=["window_id"], task_rows=task_rows)
    if save:
        nodes.write.mode("overwrite").parquet(save)
    scored = boosting.predict(test_rows(known, g), nodes, spec, keys=["window_id"], keep=["job_id", "runtime_seconds"])
    return _told(scored, log).select("window_id", "job_id", "y_true", "y_pred")


def rolling_experts(
    jobs: DataFrame, g: Grid, *, user: str = "user", value: str = "requested_seconds", least: int = 100, power_users: bool = True, windows: list[int] | None = None, log: bool = False, decay: float = 0.0,
    most: int = 2048, extra: tuple[str, ...] = (), task_rows: int = 1_000_000, save: str | None = None, **params,
) -> DataFrame:
    """window_id, job_id, y_true, y_pred, route: a boosted expert for each power user and bin of the requested time, pooled ones for the others.

    Routes come from the training rows.  A model of the whole window scores what has no expert, that is
    fewer than least training rows.  Only what test rows need is fitted, all experts of all windows at once.
    """
    extra = (*extra, value, user)
    numeric, categorical, _ = feature_columns(jobs, extra)
    ready = prepared(jobs.where(finite(F.col("runtime_seconds")).isNotNull()), numeric, categorical)
    known = checkpoint(ready.withColumns({"__user": ready[user], "__value": ready[value]}))
    plan = checkpoint(window_statuses(known, g, extra))
    plan = plan if windows is None else plan.where(F.col("window_id").isin(windows))
    test = test_rows(known, g).join(F.broadcast(plan.where("status = 'ok'").select("window_id")), "window_id")  # a row a window
    train, test = history.placed(_training_rows(known, g, plan, log, decay), test, group="window_id", user="__user", value="__value", power=power_users)
    route = F.concat_ws(":", F.col("__bin").cast("string"), "__key")
    train, test = checkpoint(train.withColumn("route", route)), checkpoint(test.withColumn("route", route))
    experts = train.groupBy("window_id", "route").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("window_id", "route")
    wanted = checkpoint(test.select("window_id", "route").distinct().join(experts, ["window_id", "route"]).withColumn("expert", F.lit(True)))
    routed = checkpoint(test.join(wanted, ["window_id", "route"], "left").withColumn("route", F.when(F.col("expert"), F.col("route"))))
    pooled = routed.where("route is null").select("window_id").distinct()
    columns = ["window_id", *spec_columns(numeric, categorical), "label", "weight", "rid"]
    rows = train.join(wanted, ["window_id", "route"]).select("route", *columns).unionByName(train.join(F.broadcast(pooled), "window_id").select(F.lit(None).cast("string").alias("route"), *columns))  # a row a window
    spec = boost_spec(numeric, categorical, most=most, **params)
    nodes = boosting.fit(rows, spec, keys=["window_id", "route"], task_rows=task_rows)
    if save:
        nodes.write.mode("overwrite").parquet(save)
    scored = boosting.predict(routed, nodes, spec, keys=["window_id", "route"], keep=["job_id", "runtime_seconds"])
    return _told(scored, log).select("window_id", "job_id", "y_true", "y_pred", F.when(F.col("route").isNull(), "fallback").otherwise("expert").alias("route"))


def spec_columns(numeric: list[str], categorical: list[str]) -> list[str]:
    return [c for c in (*numeric, *categorical) if c not in ("window_id", "route")]


def design(frame: pd.DataFrame, numeric: list[str], categories: dict[str, list[str]]) -> np.ndarray:
    parts = [frame[numeric].to_numpy(float)] if numeric else []
    parts += [(frame[c].to_numpy()[:, None] == np.array(values, object)).astype(float) for c, values in categories.items()]
    return np.hstack(parts)


def svd_reduce(x: np.ndarray, target: float = 0.95, most: int = 256) -> np.ndarray:
    """Right singular vectors of the uncentred matrix that explain the target share of variance."""
    if not x.size:
        return np.zeros((x.shape[1], 0))
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    share = (x @ vt.T).var(axis=0) / max(x.var(axis=0).sum(), 1e-12)
    k = int(np.searchsorted(np.cumsum(share), target) + 1)
    return vt[: min(k, most, len(vt))].T


class Perceptron:
    """A regressor with two hidden layers, fitted by Adam with early stopping."""

    def __init__(self, hidden=(128, 64), alpha=1e-4, rate=1e-3, rounds=200, batch=200, seed=42):
        self.hidden, self.alpha, self.rate, self.rounds, self.batch, self.seed = hidden, alpha, rate, rounds, batch, seed

    def _forward(self, x):
        acts = [x]
        for k, (w, b) in enumerate(zip(self.w, self.b)):
            z = acts[-1] @ w + b
            acts.append(np.maximum(z, 0) if k < len(self.w) - 1 else z)
        return acts

    def fit(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(self.seed)
        self.mean, self.std = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
        self.y0, self.y1 = y.mean(), y.std() or 1.0
        x, y = (x - self.mean) / self.std, (y - self.y0) / self.y1
        sizes = [x.shape[1], *self.hidden, 1]
        self.w = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:])]
        self.b = [np.zeros(b) for b in sizes[1:]]
        held = int(len(x) * 0.1) if int(len(x) * 0.1) >= 2 else 0
        order = rng.permutation(len(x))
        check, train = order[:held], order[held:]
        m = [np.zeros_like(p) for p in (*self.w, *self.b)]
        v = [np.zeros_like(p) for p in (*self.w, *self.b)]
        best, wait, t, kept = np.inf, 0, 0, None
        for _ in range(self.rounds):
            for s in range(0, len(train), self.batch):
                at = rng.permutation(train)[: self.batch]
                acts = self._forward(x[at])
                d = (acts[-1] - y[at, None]) * 2 / len(at)
                gw, gb = [], []
                for k in range(len(self.w) - 1, -1, -1):
                    gw.append(acts[k].T @ d + self.alpha * self.w[k])
                    gb.append(d.sum(axis=0))
                    d = (d @ self.w[k].T) * (acts[k] > 0)
                t += 1
                for p, g, mm, vv in zip((*self.w, *self.b), (*gw[::-1], *gb[::-1]), m, v):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    p -= self.rate * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)
            at = check if held else train
            loss = float(np.mean((self._forward(x[at])[-1][:, 0] - y[at]) ** 2))
            if loss < best - 1e-4:
                best, wait, kept = loss, 0, ([w.copy() for w in self.w], [b.copy() for b in self.b])
            elif (wait := wait + 1) >= 10:
                break
        if kept:
            self.w, self.b = kept
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._forward((x - self.mean) / self.std)[-1][:, 0] * self.y1 + self.y0


def kept_values(a: pd.DataFrame, categorical: list[str], floor: int, most: int) -> dict[str, list[str]]:
    """The values of each column that are told apart: the least frequency from floor on at which all columns together fit."""
    counts = {c: a[c].value_counts() for c in categorical}
    steps = sorted({floor, *(int(n) + 1 for s in counts.values() for n in s.unique() if n >= floor)})
    for least in steps:
        if sum(int((s >= least).sum()) for s in counts.values()) <= most:
            return {c: sorted(s[s >= least].index) for c, s in counts.items()}
    return {c: [] for c in categorical}


def rolling_perceptron(jobs: DataFrame, g: Grid, *, max_rows: int = 50_000, min_frequency: int = 2, most: int = 2048, extra: tuple[str, ...] = (), **params) -> DataFrame:
    """Test rows with y_true and y_pred of a perceptron for each window.

    max_rows bounds the training rows of one window (those of least hash), so that a group fits in
    one task; all test rows are scored, in pieces of about as many rows that each get the window's model.
    """
    numeric, categorical, _ = feature_columns(jobs, extra)
    base = prepared(jobs.where(finite(F.col("runtime_seconds")).isNotNull()), numeric, categorical)
    lo, hi = train_range(g, F.col("end_time"))
    keep = ["job_id", "runtime_seconds", *numeric, *categorical]
    ranged = base.withColumn("__lo", lo).withColumn("__hi", hi).where("__lo <= __hi").select(*keep, F.explode(F.sequence("__lo", "__hi")).alias("window_id"))
    n = ranged.groupBy("window_id").agg(F.count(F.lit(1)).alias("__n"))
    share = F.xxhash64("job_id").bitwiseAND((1 << 40) - 1) / float(1 << 40)
    train = ranged.join(F.broadcast(n), "window_id").where(share < F.lit(float(max_rows)) / F.col("__n")).drop("__n")  # a row a window
    test = test_rows(base, g).select(*keep, "window_id")
    pieces = test.groupBy("window_id").agg(F.ceil(F.count(F.lit(1)) / max_rows).cast("int").alias("__pieces"))

    def features(frame: pd.DataFrame, cats: dict[str, list[str]], basis: np.ndarray | None) -> np.ndarray:
        x = design(frame, numeric, cats)
        return x if basis is None else np.hstack([x[:, : len(numeric)], x[:, len(numeric) :] @ basis])

    def fit(key, a: pd.DataFrame) -> pd.DataFrame:
        if len(a) < 2:
            return pd.DataFrame({"window_id": [], "model": []})
        cats = kept_values(a, categorical, min_frequency, most)
        basis = svd_reduce(design(a, [], cats)) if categorical else None
        model = Perceptron(**params).fit(features(a, cats, basis), a["runtime_seconds"].to_numpy(float))
        return pd.DataFrame({"window_id": [key[0]], "model": [pickle.dumps((cats, basis, model))]})

    fitted = checkpoint(train.groupBy("window_id").applyInPandas(fit, "window_id int, model binary"))

    def score(key, b: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(m) or not len(b):
            return pd.DataFrame({"window_id": [], "job_id": [], "y_true": [], "y_pred": []})
        cats, basis, model = pickle.loads(m["model"][0])  # noqa: S301 - made above
        y = model.predict(features(b, cats, basis))
        return pd.DataFrame({"window_id": b["window_id"], "job_id": b["job_id"], "y_true": b["runtime_seconds"], "y_pred": np.maximum(y, 0)})

    placed = test.join(F.broadcast(pieces), "window_id").withColumn("__piece", F.pmod(F.xxhash64("job_id"), F.col("__pieces")).cast("int")).drop("__pieces")  # a row a window
    copies = fitted.join(F.broadcast(pieces), "window_id").select("window_id", "model", F.explode(F.sequence(F.lit(0), F.col("__pieces") - 1)).alias("__piece"))
    kind = dict(jobs.dtypes)["job_id"]
    return placed.groupBy("window_id", "__piece").cogroup(copies.groupBy("window_id", "__piece")).applyInPandas(score, f"window_id int, job_id {kind}, y_true double, y_pred double")
