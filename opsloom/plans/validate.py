"""Rules of a table as predicates: types, ranges and required columns checked over all rows in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from ..operators import quality
from . import rules

#: The canonical job table: required columns, then types and bounds of known ones; others are free.
JOB_SCHEMA = {
    "required": ["job_id", "start_time", "end_time", "runtime_seconds"],
    "properties": {
        "job_id": {"type": ["string", "integer"]}, "submit_time": {"type": "timestamp"}, "start_time": {"type": "timestamp"}, "end_time": {"type": "timestamp"},
        "runtime_seconds": {"type": "number", "minimum": 0}, "allocated_cpus": {"type": "integer", "minimum": 1}, "partition": {"type": "string"}, "node_list": {"type": "string"},
    },
}
_KINDS = {"byte": "integer", "short": "integer", "integer": "integer", "long": "integer", "float": "number", "double": "number", "decimal": "number", "string": "string", "boolean": "boolean"}


class ValidationError(Exception):
    pass


def column_kind(df: DataFrame, name: str) -> str:
    t = df.schema[name].dataType
    if isinstance(t, (TimestampType, TimestampNTZType)):
        return "timestamp"
    return _KINDS.get(t.typeName(), t.typeName())


def type_issues(df: DataFrame, schema: dict) -> list[str]:
    """What the table's own schema already breaks, without reading a row."""
    out = [f"missing column {c}" for c in schema.get("required", []) if c not in df.columns]
    for name, rule in schema.get("properties", {}).items():
        if name in df.columns and "type" in rule:
            wanted = rule["type"] if isinstance(rule["type"], list) else [rule["type"]]
            kind = column_kind(df, name)
            if kind not in wanted and not (kind == "integer" and "number" in wanted) and kind != "void":
                out.append(f"{name} is {kind}, not {' or '.join(wanted)}")
    return out


def row_issues(df: DataFrame, schema: dict) -> Column:
    """An array with what is wrong with a row; empty texts count as missing in columns that are required.

    The types of the columns themselves are type_issues' part, those below them are checked here.
    """
    needed = [F.when(quality.missing(df, c), F.lit(f"{c}: required")) for c in schema.get("required", []) if c in df.columns]
    found = F.array_compact(F.array(*needed)) if needed else F.array().cast("array<string>")
    return F.array_union(found, rules.row_issues(df, schema, types=False))


def validate(df: DataFrame, schema: dict = JOB_SCHEMA, *, key: str | None = None, strict: bool = False) -> dict:
    """rows, bad_rows, issues (name -> count and examples); strict raises on any."""
    found = type_issues(df, schema)
    both = F.array_union(row_issues(df, schema), quality.issues(df))
    key = key or ("job_id" if "job_id" in df.columns else df.columns[0])
    tagged = df.select(F.col(key).cast("string").alias("key"), both.alias("issues"))
    counts = tagged.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("issues") > 0).alias("bad")).first()
    each = tagged.select("key", F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("example"))
    issues = {r["issue"]: {"count": r["n"], "example": r["example"]} for r in each.orderBy(F.desc("n"), "issue").collect()}
    out = {"rows": counts["rows"], "bad_rows": counts["bad"], "schema_issues": found, "issues": issues}
    if strict and (found or issues):
        top = found + [f"{k} ({v['count']})" for k, v in list(issues.items())[:20]]
        raise ValidationError("; ".join(top))
    return out


def check_path(spark: SparkSession, path: str, *, strict: bool = False) -> dict:
    """What path holds (bundle, manifest or table) and, for a table, its report, which is written beside it; raises on what is broken."""
    from .. import storage
    from . import evaluate, prepare

    path = path.rstrip("/")
    if not storage.exists(spark, path):
        raise FileNotFoundError(path)
    if storage.is_folder(spark, path) and storage.exists(spark, f"{path}/result.json"):
        evaluate.check_bundle(spark, path)
        return {"kind": "bundle", "path": path}
    if path.endswith("manifest.json"):
        prepare.check_manifest(storage.read_json(spark, path))
        return {"kind": "manifest", "path": path}
    if path.endswith(".json"):
        raise ValidationError(f"no rule for {path}")
    report = validate(spark.read.parquet(path), strict=strict)
    storage.write_json(spark, f"{path}.quality.json", report, overwrite=True)
    return {"kind": "table", "path": path} | report
