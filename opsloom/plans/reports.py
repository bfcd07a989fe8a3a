"""What runs and data sets are shown as: leaderboards, analyses, data set cards and slices, as JSON, HTML or Markdown."""

from __future__ import annotations

from datetime import date, timedelta
from html import escape

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import storage
from ..operators import mapping, quality
from ..operators.summaries import metric_text, short_id, short_time
from . import catalog, characterize
from .evaluate import read_bundles

STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.3em .6em;text-align:left}.best{font-weight:bold}"


def page(title: str, *parts: str) -> str:
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(title)}</title><style>{STYLE}</style></head><body><h1>{escape(title)}</h1>{''.join(parts)}</body></html>\n"


def table_html(header: list[str], rows: list[list]) -> str:
    """Cells are texts, or pairs of text and class."""

    def cell(x) -> str:
        text, kind = x if isinstance(x, tuple) else (x, "")
        return f"<td class='{kind}'>{escape(str(text))}</td>"

    head = "".join(f"<th>{escape(h)}</th>" for h in header)
    return f"<table><tr>{head}</tr>{''.join('<tr>' + ''.join(map(cell, r)) + '</tr>' for r in rows)}</table>"


# -- leaderboard ------------------------------------------------------------------------------
def leaderboard(spark: SparkSession, folder: str, larger_is_better: tuple[str, ...] = ("r2",)) -> dict:
    """The runs below a folder in the order of their creation, each with its metrics and where it is the best."""
    board = catalog.leaderboard(read_bundles(spark, folder), larger_is_better)
    runs: dict[str, dict] = {}
    for r in board.collect():  # a row for each metric of a run
        run = runs.setdefault(r["run"], {"run": r["run"], "model": r["model"], "dataset": r["dataset"], "created_at": r["created_at"], "metrics": {}, "best": []})
        run["metrics"][r["metric"]] = r["value"]
        if r["is_best"]:
            run["best"].append(r["metric"])
    return {"generated_at": storage.now(), "folder": folder, "entries": list(runs.values())}


def leaderboard_html(board: dict, target: str = "runtime_seconds") -> str:
    names = sorted({n for e in board["entries"] for n in e["metrics"]})
    rows = []
    for e in board["entries"]:
        shown = [(metric_text(n, e["metrics"][n], target), "best" if n in e["best"] else "") if n in e["metrics"] else "-" for n in names]
        rows.append([e["run"], short_id(e["model"]), e["dataset"] or "-", short_time(e["created_at"], compact=True), *shown])
    return page("Leaderboard", table_html(["run", "model", "data set", "created", *names], rows))


def write_leaderboard(spark: SparkSession, folder: str, out: str) -> dict:
    """leaderboard.json and leaderboard.html below out."""
    board = leaderboard(spark, folder)
    storage.write_json(spark, f"{out}/leaderboard.json", board, overwrite=True)
    storage.write_text(spark, f"{out}/leaderboard.html", leaderboard_html(board), overwrite=True)
    return board


# -- analysis ---------------------------------------------------------------------------------
def analysis(df: DataFrame, *, categorical: list[str] = ()) -> dict:
    """What a user sees of a new table: quality, coverage, suggestions, categories."""
    have = [c for c in categorical if c in df.columns]
    complete = {"runtime_seconds", "partition"} <= set(df.columns)
    return {
        "generated_at": storage.now(),
        "columns": [list(c) for c in df.dtypes],
        "quality": quality.report(df, "job_state" if "job_state" in df.columns else None),
        "coverage": quality.coverage(df).first().asDict() if complete else None,
        "fields": [r.asDict() for r in mapping.field_presence(df).collect()],
        "suggestions": [r.asDict() for r in mapping.suggest(df).where("rank <= 3").orderBy("field", "rank").collect()],
        "categories": [r.asDict() for r in quality.category_profile(df, have).collect()] if have else [],
    }


def analysis_html(told: dict) -> str:
    q = told["quality"]
    parts = [
        f"<p>{q['rows']} rows</p>", "<h2>Missing</h2>", table_html(["column", "share"], [[c, f"{v:.1%}"] for c, v in q["missingness"].items()]),
        "<h2>Issues</h2>", table_html(["issue", "rows"], [[c, n] for c, n in q["issues"].items()]),
        "<h2>Suggestions</h2>", table_html(["field", "column", "confidence", "reason"], [[s["field"], s["column"], s["confidence"], s["reason"]] for s in told["suggestions"]]),
    ]
    if told["coverage"]:
        parts += ["<h2>Coverage</h2>", table_html(["what", "value"], [[k, v] for k, v in told["coverage"].items()])]
    return page("Analysis", *parts)


def write_analysis(df: DataFrame, out: str, **options) -> dict:
    """analysis.json and analysis.html below out."""
    told = analysis(df, **options)
    storage.write_json(df.sparkSession, f"{out}/analysis.json", told, overwrite=True)
    storage.write_text(df.sparkSession, f"{out}/analysis.html", analysis_html(told), overwrite=True)
    return told


# -- cards and slices ----------------------------------------------------------------------------
def card_markdown(name: str, card: dict) -> str:
    v, w, r = card["volume"], card["window"], card["runtime_seconds"]
    lines = [f"# {name}", "", f"- rows: {card['n_rows']:,}", f"- days: {v['days']}, {v['rate']} jobs a day, median {v['median']:,.0f} on active days, gap floor {v['gap_floor']:,.0f}"]
    lines.append(f"- missing blocks: {len(card['gaps']) or 'none'}")
    lines += [f"    - {g['gap_start']} to {g['gap_end']} ({g['days']} days)" for g in card["gaps"]]
    lines.append("- runtime in seconds: " + ", ".join(f"{k} {x:,.0f}" for k, x in r.items() if x is not None))
    if card["columns"]:
        lines += ["", "| column | values | missing |", "|-|-|-|", *(f"| {c} | {x['cardinality']:,} | {x['missingness']:.1%} |" for c, x in card["columns"].items())]
    lines += ["", "## Window", "", f"- {w['window_start']} to {w['window_end']}, tested from {w['test_start']}", f"- rows: {w['n_rows']:,}", f"- {'healthy' if w['healthy'] else 'UNHEALTHY: it touches a missing block'}", ""]
    return "\n".join(lines)


def write_card(jobs: DataFrame, out: str, name: str, **options) -> dict:
    """<name>.card.json and <name>.md below out."""
    card = {"dataset": name, "created_at": storage.now()} | characterize.card(jobs, **options)
    storage.write_json(jobs.sparkSession, f"{out}/{name}.card.json", card, overwrite=True)
    storage.write_text(jobs.sparkSession, f"{out}/{name}.md", card_markdown(name, card), overwrite=True)
    return card


def read_cards(spark: SparkSession, folder: str, slices: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(cards: dataset, n_rows, healthy, window_start, window_end; sidecars: dataset, slice_rows) of all files below the folders."""
    kind = "struct<dataset:string,n_rows:bigint,window:struct<window_start:string,window_end:string,healthy:boolean>>"
    cards = storage.named_files(spark, folder, "*.card.json").select(F.from_json("value", kind).alias("c")).where("c.dataset is not null")
    cards = cards.select("c.dataset", "c.n_rows", "c.window.healthy", "c.window.window_start", "c.window.window_end")
    if slices is None:
        return cards, spark.createDataFrame([], "dataset string, slice_rows bigint")
    side = storage.named_files(spark, slices, "slice.json").select(F.from_json("value", "struct<dataset:string,rows:bigint>").alias("s"))
    return cards, side.select("s.dataset", F.col("s.rows").alias("slice_rows")).where("dataset is not null")


def effective_start(start: str, extra_days: int) -> str:
    return (date.fromisoformat(str(start)) - timedelta(days=extra_days)).isoformat()


def write_slice(jobs: DataFrame, out: str, start: str, end: str, *, extra_days: int = 0, dataset: str | None = None, source: str | None = None) -> dict:
    """The jobs that overlap a window as out/data.parquet, and slice.json beside it, which says which window they are of."""
    spark = jobs.sparkSession
    mapping.overlap(jobs, start, end, extra_days=extra_days).write.mode("overwrite").parquet(f"{out}/data.parquet")
    told = {
        "dataset": dataset, "source_table": source, "card_window": {"start": str(start), "end": str(end)}, "extra_lookback_days": extra_days,
        "effective_window": {"start": effective_start(start, extra_days), "end": str(end)}, "rows": spark.read.parquet(f"{out}/data.parquet").count(),
    }
    storage.write_json(spark, f"{out}/slice.json", told, overwrite=True)
    return told
