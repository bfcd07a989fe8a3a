"""Recipes: which data set, model, split and metrics; their checks, their runs and their results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import storage
from ..functions.transforms import finite, log_target, unlog_target
from ..operators import history, metrics, models, similarity, windows

NEEDED_METRICS = {"mae", "rmse"}


class RecipeError(Exception):
    pass


def load(path: str) -> dict:
    recipe = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    check(recipe)
    return recipe


def check(recipe: dict) -> None:
    """Raises RecipeError unless the recipe names its parts, mae and rmse, one target and a sound split."""
    if missing := {"model", "metrics", "split"} - set(recipe or {}):
        raise RecipeError(f"missing {', '.join(sorted(missing))}")
    if lacking := NEEDED_METRICS - {m.get("name") for m in recipe["metrics"]}:
        raise RecipeError(f"missing metrics {', '.join(sorted(lacking))}")
    targets = {m.get("target") for m in recipe["metrics"]}
    if len(targets) != 1 or not all(targets):
        raise RecipeError("the metrics need one target")
    split = recipe["split"]
    if split.get("method") not in ("fixed", "rolling"):
        raise RecipeError("the split is fixed or rolling")
    if split["method"] == "rolling":
        for name in ("n_windows", "test_window_hours", "training_lookback_days"):
            value = split.get(name, 1)
            if type(value) is not int or value <= 0:
                raise RecipeError(f"{name} must be a positive whole number")
    elif not 0 < split.get("train_fraction", 0.8) <= 1:
        raise RecipeError("train_fraction must lie in (0, 1]")


def _rolling(jobs: DataFrame, recipe: dict) -> windows.Grid:
    s = recipe["split"]
    return windows.grid(jobs, n_windows=s["n_windows"], hours=s.get("test_window_hours", 6), lookback_days=s.get("training_lookback_days", 120))


def _mean_fixed(jobs, recipe, target):
    order = ["submit_time", "job_id"] if "submit_time" in jobs.columns else ["job_id"]
    s = windows.fixed_split(jobs.where(F.col(target).isNotNull()), recipe["split"].get("train_fraction", 0.8), order)
    mean = s.where("is_train").agg((F.sum(F.col(target).cast("decimal(28,6)")).cast("double") / F.count(target)).alias("y_pred"))
    return s.where("is_test").withColumnRenamed(target, "y_true").join(F.broadcast(mean)).select(F.lit(0).alias("window_id"), "job_id", "y_true", "y_pred")


def _mean_rolling(jobs, recipe, target):
    return windows.rolling_mean(jobs, _rolling(jobs, recipe), target).select("window_id", "job_id", "y_true", "y_pred")


def _options(recipe: dict) -> dict:
    """Settings of a split that fitted models share."""
    split = recipe["split"]
    return {"log": split.get("log_target", False), "decay": split.get("time_decay_rate", 0.0)} | recipe["model"].get("params", {})


def _trees(kind):
    return lambda jobs, recipe, target: models.rolling_trees(jobs, _rolling(jobs, recipe), kind, **_options(recipe))


def _perceptron(jobs, recipe, target):
    return models.rolling_perceptron(jobs, _rolling(jobs, recipe), **recipe["model"].get("params", {}))


def _experts(jobs, recipe, target):
    return models.rolling_experts(jobs, _rolling(jobs, recipe), **_options(recipe))


def _routed(jobs, recipe, target):
    g, p = _rolling(jobs, recipe), recipe["model"].get("params", {})
    out = history.routed_means(windows.train_rows(jobs, g), windows.test_rows(jobs, g), group="window_id", user=p.get("user", "user"), value=p.get("value", "requested_seconds"), target=target, least=p.get("least", 100))
    return out.withColumnRenamed(target, "y_true").select("window_id", "job_id", "y_true", "y_pred", "route")


def _embedding(jobs, recipe, target):
    g, p = _rolling(jobs, recipe), recipe["model"].get("params", {})
    log = recipe["split"].get("log_target", False)
    known = jobs.where(F.col(target).isNotNull()).withColumn("__label", log_target(F.col(target)) if log else F.col(target))
    lo, hi = windows.train_range(g, F.col("end_time"))
    near = similarity.windowed_neighbours(windows.test_rows(known, g), known, key="job_id", vector=p.get("vector", "embedding"), value="__label", window="window_id", lo=lo, hi=hi, k=p.get("k", 5))
    predicted = similarity.weighted_prediction(near, "window_id", weighting=p.get("weighting", "similarity")).withColumnRenamed("query", "job_id")
    predicted = predicted.withColumn("y_pred", unlog_target(F.col("y_pred"))) if log else predicted
    return windows.test_rows(known, g).withColumnRenamed(target, "y_true").join(predicted, ["window_id", "job_id"]).select("window_id", "job_id", "y_true", "y_pred")


def _texts(jobs, recipe, target):
    """All windows at once: their number is the group."""
    g, p = _rolling(jobs, recipe), recipe["model"].get("params", {})
    text = similarity.serialise(jobs, form="kv", extra=p.get("extra", []))
    known = jobs.where(F.col(target).isNotNull())
    train, test = windows.train_rows(known, g), windows.test_rows(known, g)
    counted = similarity.term_counts(train, "job_id", text, keep=("window_id", target)), similarity.term_counts(test, "job_id", text, keep=("window_id",))
    near = similarity.tfidf_neighbours(*counted, k=p.get("k", 5), group="window_id", value=target)
    predicted = similarity.weighted_prediction(near, "window_id", weighting=p.get("weighting", "similarity")).withColumnRenamed("query", "job_id")
    return test.withColumnRenamed(target, "y_true").join(predicted, ["window_id", "job_id"]).select("window_id", "job_id", "y_true", "y_pred")


def _own_history(jobs, recipe, target):
    """Test jobs with k jobs or more of their user before them; earlier test jobs count too, as their ends are known by then."""
    p = recipe["model"].get("params", {})
    named = jobs.withColumns({"__user": F.coalesce(history.first_present(jobs, "user").cast("string"), F.lit("")), "__end": history.first_present(jobs, "end_time"), "__y": finite(F.col(target))})
    named = named.where("__y is not null").withColumn("__at", F.unix_micros(F.col("__end").try_cast("timestamp")))
    s = windows.fixed_split(named.withColumn("__at", F.coalesce("__at", F.lit(-(1 << 62)))), recipe["split"].get("train_fraction", 0.8), ["__at", "job_id"])
    numbers = [history.first_present(s, "num_cores_req"), history.first_present(s, "num_nodes_req")]
    scored = history.context_nearest(s, user="__user", order=["row_idx"], name=history.first_present(s, "name"), numbers=numbers, target="__y", theta=p.get("theta", 50), k=p.get("k", 5))
    return scored.where("is_test and y_pred is not null").select(F.lit(0).alias("window_id"), "job_id", F.col("__y").alias("y_true"), "y_pred")


MODELS: dict[tuple[str, str], Callable] = {
    ("mean", "fixed"): _mean_fixed, ("mean", "rolling"): _mean_rolling, ("boosted_trees", "rolling"): _trees("gbt"), ("random_forest", "rolling"): _trees("forest"),
    ("perceptron", "rolling"): _perceptron, ("routed_experts", "rolling"): _experts, ("routed_means", "rolling"): _routed, ("embedding_knn", "rolling"): _embedding, ("text_knn", "rolling"): _texts,
    ("own_history", "fixed"): _own_history,
}


def run(jobs: DataFrame, recipe: dict) -> tuple[DataFrame, DataFrame]:
    """(predictions, report): rows with y_true and y_pred, and the metrics of each window and of all rows pooled (null window)."""
    check(recipe)
    key = (recipe["model"]["id"], recipe["split"]["method"])
    if key not in MODELS:
        raise RecipeError(f"no model {key[0]} with a {key[1]} split; known: {', '.join(f'{m} ({s})' for m, s in MODELS)}")
    target = recipe["metrics"][0]["target"]
    predictions = MODELS[key](jobs, recipe, target)
    return predictions, metrics.report(predictions, [m["name"] for m in recipe["metrics"]])


def write_bundle(spark: SparkSession, folder: str, recipe: dict, report: DataFrame, *, predictions: DataFrame | None = None, dataset: str | None = None, overwrite: bool = False) -> dict:
    """result.json, metrics.json and provenance.json in a new folder, and the predictions as Parquet; returns the pooled metrics."""
    if storage.exists(spark, f"{folder}/result.json") and not overwrite:
        raise FileExistsError(f"{folder} holds a result")
    rows = [r.asDict() for r in report.collect()]  # one row a window
    pooled = next(r for r in rows if r["window_id"] is None)
    made = storage.now()
    result = {"created_at": made, "dataset": dataset, "model": recipe["model"], "split": recipe["split"], "n_test": pooled["n_test"], "windows": sorted((r for r in rows if r["window_id"] is not None), key=lambda r: r["window_id"])}
    numbers = {m["name"]: pooled[m["name"]] for m in recipe["metrics"]}
    provenance = {"created_at": made, "recipe": recipe, "recipe_sha256": hashlib.sha256(json.dumps(recipe, sort_keys=True).encode()).hexdigest(), "spark": spark.version}
    if predictions is not None:
        predictions.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{folder}/predictions.parquet")
    for name, value in (("metrics", numbers), ("provenance", provenance), ("result", result)):  # the result last: a bundle with it is whole
        storage.write_json(spark, f"{folder}/{name}.json", value, overwrite=overwrite)
    return numbers


def read_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """run, created_at, metric, value of every whole bundle below a folder, read as a table; broken ones are passed over."""
    run = F.regexp_extract("path", "([^/]+)/[^/]+$", 1)
    results = storage.named_files(spark, folder, "result.json").select(F.regexp_replace("path", "/[^/]+$", "").alias("at"), run.alias("run"), F.get_json_object("value", "$.created_at").alias("created_at"), F.get_json_object("value", "$.model.id").alias("model"), F.get_json_object("value", "$.dataset").alias("dataset"))
    numbers = storage.named_files(spark, folder, "metrics.json").select(F.regexp_replace("path", "/[^/]+$", "").alias("at"), F.from_json("value", "map<string,double>").alias("m"))
    whole = results.where("model is not null").join(numbers.where("m is not null"), "at")
    return whole.select("run", "model", "dataset", "created_at", F.explode("m").alias("metric", "value")).where("value is not null")


def check_bundle(spark: SparkSession, folder: str) -> None:
    """Raises RecipeError unless the bundle's three files say what they must."""
    needed = {"result": ("model", "split", "n_test", "windows"), "metrics": tuple(NEEDED_METRICS), "provenance": ("created_at", "recipe")}
    for name, keys in needed.items():
        try:
            value = storage.read_json(spark, f"{folder}/{name}.json")
        except Exception as e:
            raise RecipeError(f"{name}.json can't be read: {e}") from e
        if lacking := [k for k in keys if k not in value]:
            raise RecipeError(f"{name}.json lacks {', '.join(lacking)}")
