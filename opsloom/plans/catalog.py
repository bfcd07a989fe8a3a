"""Registry, metadata graph, evaluation matrix and leaderboard as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.metrics import best

ENTRY = "id string, type string, label string, domain string, tags array<string>, source string, input_schema string, output_schema string"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a registry snapshot: JSON files with an array, or an object with an array ``entries``."""
    raw = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    if "entries" in raw.columns:
        raw = raw.select(F.explode("entries").alias("e")).select("e.*")
    kinds = [c.split() for c in ENTRY.split(", ")]
    return raw.select(*(F.col(n).cast(k).alias(n) if n in raw.columns else F.lit(None).cast(k).alias(n) for n, k in kinds)).where("id is not null")


def own_registry(spark: SparkSession) -> DataFrame:
    """What this engine itself offers: traces and models."""
    from . import evaluate, traces

    models = [{"id": f"model.{m}", "type": "model", "label": m, "domain": "job-runtime", "tags": [split], "source": "local", "input_schema": "job", "output_schema": "prediction"} for m, split in evaluate.MODELS]
    return spark.createDataFrame(traces.entries() + models, ENTRY)


def info(entries: DataFrame, name: str) -> dict:
    """The one entry of that id, or of the only id that ends with it."""
    found = entries.where((F.col("id") == name) | F.endswith("id", F.lit(f".{name}"))).limit(2).collect()
    if len(found) != 1:
        raise KeyError(f"{name}: {'several entries' if found else 'no such entry'}")
    return found[0].asDict()


def embeddings_needed(cells: DataFrame, models: DataFrame) -> DataFrame:
    """dataset: those with a cell whose model reads vectors; cells as matrix() makes them, models: model, needs_vectors."""
    wanted = cells.where("status = 'cell'").join(models.where("needs_vectors"), "model", "left_semi")
    return wanted.select("dataset").distinct()


def registry_filter(entries: DataFrame, *, kind: str | None = None, tag: str | None = None, source: str | None = None, input_schema: str | None = None, output_schema: str | None = None) -> DataFrame:
    """Entries that meet all that is given; a tag also matches the domain.  Columns: id, type, domain, tags, source, input_schema, output_schema."""
    keep = F.lit(True)
    for c, v in (("type", kind), ("source", source), ("input_schema", input_schema), ("output_schema", output_schema)):
        keep = keep & (F.col(c) == v) if v is not None else keep
    if tag is not None:
        keep = keep & (F.array_contains("tags", tag) | (F.col("domain") == tag))
    return entries.where(keep)


def graph(entries: DataFrame, links: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, type, label; edges: source, target, type) of entries, one edge type for each linked column.

    A linked array is exploded.  A node named twice keeps its entry's own type.
    """
    kinds = dict(entries.dtypes)
    edges = None
    for column, kind in links.items():
        target = F.explode(column) if kinds[column].startswith("array") else F.col(column)
        e = entries.select(F.col("id").alias("source"), target.alias("target"), F.lit(kind).alias("type")).where("target is not null")
        edges = e if edges is None else edges.union(e)
    own = entries.select("id", F.struct(F.lit(0).alias("o"), F.col("type").alias("type"), F.col("label").alias("label")).alias("n"))
    linked = edges.select(F.col("target").alias("id"), F.struct(F.lit(1).alias("o"), F.col("type").alias("type"), F.col("target").alias("label")).alias("n"))
    nodes = own.union(linked).groupBy("id").agg(F.min("n").alias("n")).select("id", "n.type", "n.label")
    return nodes.orderBy("id"), edges.distinct().orderBy("source", "target", "type")


def tier(rows: Column) -> Column:
    """The row counts of the light and heavy tiers of a run."""
    return F.when(rows < 300_000, "light").when(rows < 2_000_000, "heavy").otherwise("extreme")


def matrix(cards: DataFrame, models: DataFrame, *, sidecars: DataFrame | None = None, most_rows: int | None = None, only_dataset: str | None = None, only_model: str | None = None) -> DataFrame:
    """dataset, model, rows, tier, status: every healthy data set with every model.

    cards: dataset, n_rows, healthy; models: model; sidecars: dataset, slice_rows, the true size where
    a slice exists.  Both lists are catalogues, a few rows each; the small one is sent to all tasks.
    """
    if only_dataset:
        cards = cards.where(F.col("dataset") == only_dataset)
    if only_model:
        models = models.where(F.col("model") == only_model)
    sized = cards.join(sidecars, "dataset", "left").withColumn("rows", F.coalesce("slice_rows", "n_rows")) if sidecars is not None else cards.withColumn("rows", F.col("n_rows"))
    status = F.when(~F.col("healthy"), "skipped: unhealthy window")
    status = status.when(F.col("rows") > most_rows, "skipped: too many rows").otherwise("cell") if most_rows else status.otherwise("cell")
    return sized.join(F.broadcast(models)).select("dataset", "model", "rows", tier(F.col("rows")).alias("tier"), status.alias("status"))


def cell_recipe(dataset: str, model: str, *, metrics: tuple[str, ...] = ("mae", "rmse"), target: str = "runtime_seconds", **overrides) -> dict:
    """The recipe of a cell: six-hour windows over the card's test days; overrides: split settings and params of the model."""
    params = overrides.pop("params", {})
    split = {"method": "rolling", "n_windows": 12, "test_window_hours": 6, "training_lookback_days": 10} | overrides
    return {"dataset": dataset, "model": {"id": model, "params": params}, "metrics": [{"name": n, "target": target} for n in metrics], "split": split}


def leaderboard(results: DataFrame, larger_is_better: tuple[str, ...] = ("r2",)) -> DataFrame:
    """results (run, created_at, metric, value) in the order of created_at, with the best of each metric marked."""
    return best(results, "value", "metric", ~F.col("metric").isin(list(larger_is_better))).orderBy(F.coalesce("created_at", F.lit("")), "run", "metric")
