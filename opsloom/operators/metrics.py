"""Error metrics as aggregates over (y_true, y_pred)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ranks import grouped_quantiles


def metric(name: str) -> Column:
    """The aggregate of a metric; mape is a fraction over non-zero truths, r2 is 0 where truths are constant."""
    y, p = F.col("y_true"), F.col("y_pred")
    err = y - p
    made = {
        "mae": lambda: F.avg(F.abs(err)),
        "rmse": lambda: F.sqrt(F.avg(err * err)),
        "median_ae": lambda: F.percentile(F.abs(err), F.lit(0.5)),  # a buffer of all different errors: for few rows
        "underprediction_ratio": lambda: F.lit(100.0) * F.count_if(p < y) / F.count(F.lit(1)),
        "mape": lambda: F.avg(F.when(y != 0, F.abs(err) / F.abs(F.nullif(y, F.lit(0.0))))),
        "r2": lambda: F.when(F.var_pop(y) > 0, F.lit(1.0) - F.avg(err * err) / F.nullif(F.var_pop(y), F.lit(0.0))).otherwise(0.0),
    }
    if name not in made:
        raise ValueError(f"unknown metric {name!r}")
    return made[name]().alias(name)


def report(predictions: DataFrame, names: list[str], by: str | None = "window_id") -> DataFrame:
    """One row a window and, with a null window, one over all rows pooled; in a single pass, but for the median.

    The median of the errors of each window and of all rows comes from sorted counts, see ranks.grouped_quantiles().
    """
    aggs = [F.count(F.lit(1)).alias("n_test"), *(metric(n) for n in names if n != "median_ae")]
    out = predictions.rollup(by).agg(*aggs) if by else predictions.agg(*aggs)
    if "median_ae" not in names:
        return out
    groups = F.array(F.struct(F.lit(True).alias("pooled"), F.lit(None).cast(dict(predictions.dtypes)[by]).alias("w")), F.struct(F.lit(False).alias("pooled"), F.col(by).alias("w"))) if by else F.array(F.struct(F.lit(True).alias("pooled"), F.lit(0).alias("w")))
    errors = predictions.select(F.explode(groups).alias("g"), F.abs(F.col("y_true") - F.col("y_pred")).alias("e")).select("g.*", "e")
    medians = grouped_quantiles(errors, ["pooled", "w"], "e", [0.5]).select("pooled", "w", F.col("q")[0].alias("median_ae"))
    if not by:
        return out.join(medians.select("median_ae"), how="left").select("n_test", *names)
    rolled = predictions.rollup(by).agg((F.grouping(by) == 1).alias("__pooled"), *aggs)
    return rolled.join(medians.withColumnRenamed("w", "__w"), (F.col("__pooled") == F.col("pooled")) & F.col(by).eqNullSafe(F.col("__w")), "left").select(by, "n_test", *names)


def best(results: DataFrame, value: str, by: str, smaller: Column) -> DataFrame:
    """results with is_best: within 1e-9 of the best value of its metric, the least or the largest."""
    bounds = results.groupBy(by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    joined = results.join(bounds, by)
    return joined.withColumn("is_best", F.abs(F.col(value) - F.when(smaller, F.col("__lo")).otherwise(F.col("__hi"))) < 1e-9).drop("__lo", "__hi")
