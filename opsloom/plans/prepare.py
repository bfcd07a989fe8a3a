"""From a data set descriptor to a canonical table: fetch, decode, map, filter, sample, select, validate, write."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import storage
from ..operators import mapping, quality
from ..operators.summaries import UNIT_NAMES, unit_name
from ..sources import fetch, readers
from ..sources.readers import check_vectors
from ..streaming import once
from .validate import validate


class DescriptorError(Exception):
    pass


def load(path: str) -> dict:
    d = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    check(d)
    return d


def check(d: dict) -> None:
    """Rules that hold between the parts of a descriptor."""
    for key in ("dataset_id", "source", "decode", "targets"):
        if key not in d:
            raise DescriptorError(f"missing {key}")
    source = d["source"]
    if source.get("kind") != "manual" and any("url" not in r for r in source.get("resources", [])):
        raise DescriptorError("resources need a url unless the source is manual")
    slices = source.get("slices") or {}
    if slices and slices.get("default") not in slices.get("available", {}):
        raise DescriptorError("the default slice does not exist")
    for t in d["targets"]:
        if not t.get("domain"):
            raise DescriptorError("a target needs a domain")
        s = t.get("sample") or {}
        if s.get("strategy") == "stratified" and not s.get("by"):
            raise DescriptorError("a stratified sample needs by")
        produced = set(t.get("select") or t["mapping"])
        if lost := set(t.get("capabilities", [])) - produced:
            raise DescriptorError(f"columns not produced: {', '.join(sorted(lost))}")


def read_mapping(path: str) -> dict[str, dict]:
    """A mapping file: canonical name -> source column, or a rule with its units as users spell them."""
    out = {}
    for name, rule in (yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}).items():
        rule = {"from": rule} if isinstance(rule, str) else dict(rule)
        for key, kind in (("unit", rule.get("type")), ("format", "timestamp")):
            if key in rule and kind in UNIT_NAMES and "%" not in rule[key]:
                rule[key] = unit_name(kind, rule[key])
        out[name] = rule
    return out


def write_mapping(path: str, rules: dict[str, dict]) -> None:
    Path(path).write_text(yaml.safe_dump(rules, sort_keys=False), encoding="utf-8")


def target(df: DataFrame, t: dict, order: list[str]) -> DataFrame:
    """A decoded table as one target says."""
    out = mapping.project(df, t["mapping"], order)
    if t.get("state_allowlist"):
        out = mapping.allow_states(out, "job_state", t["state_allowlist"])
    out = mapping.complete(out)
    out = mapping.drop_empty_columns(mapping.apply_filters(out, t.get("filter") or {}))
    if t.get("sample"):
        out = mapping.sample(out, ["job_id"], **t["sample"])
    return mapping.select(out, t.get("select"))


#: What a manifest must say.
MANIFEST = ("dataset", "domain", "rows", "columns", "created_at", "sources")


def check_manifest(manifest: dict) -> None:
    if lacking := [k for k in MANIFEST if k not in manifest]:
        raise DescriptorError(f"the manifest lacks {', '.join(lacking)}")
    if not isinstance(manifest["rows"], int) or manifest["rows"] < 0 or not all(len(c) == 2 for c in manifest["columns"]):
        raise DescriptorError("rows is a count, columns are pairs of name and type")


def write_manifest(spark: SparkSession, path: str, table: DataFrame, *, dataset: str, domain: str, sources: list[str], **more) -> dict:
    made = {"dataset": dataset, "domain": domain, "rows": table.count(), "columns": [list(c) for c in table.dtypes], "created_at": storage.now(), "sources": sources} | more
    check_manifest(made)
    storage.write_json(spark, path, made)
    return made


def prepare(spark: SparkSession, d: dict, cache: str, out: str, *, order: list[str] | None = None, strict: bool = False, **options) -> dict:
    """Writes each target's table, manifest and quality report below out; returns the manifests by domain.

    Durations and nanoseconds that a Parquet source holds as plain numbers become seconds and times.
    """
    check(d)
    files = fetch.fetch(d["dataset_id"], d["source"], cache, **options)
    raw = readers.decode(spark, d["decode"]["format"], [str(f) for f in files], **d["decode"].get("options", {}))
    made = {}
    for t in d["targets"]:
        table = target(raw, t, order or raw.columns[:1])
        path = f"{out}/{d['dataset_id']}.{t['domain']}"
        table.write.mode("errorifexists").parquet(f"{path}.parquet")
        written = spark.read.parquet(f"{path}.parquet")
        storage.write_json(spark, f"{path}.quality.json", validate(written, strict=strict) | {"report": quality.report(written, "job_state" if "job_state" in written.columns else None)})
        made[t["domain"]] = write_manifest(spark, f"{path}.manifest.json", written, dataset=d["dataset_id"], domain=t["domain"], sources=[f.name for f in files])
    return made


def embed(df: DataFrame, path: str, make, *, form: str = "prose", column: str = "embedding", **options) -> DataFrame:
    """df with the vector of its text, made once for each distinct text and kept in a table at path, with a manifest beside it.

    A second run reads the vectors that are there and makes only those that are missing.
    """
    from ..operators.similarity import concepts, serialise

    spark = df.sparkSession
    texts = df.withColumn("__text", serialise(df, form=form, **options)).withColumn("__hash", F.sha2("__text", 256))
    wanted = texts.select("__hash", "__text").dropDuplicates(["__hash"])
    if storage.exists(spark, path):
        wanted = wanted.join(once.read(spark, path).select("__hash"), "__hash", "left_anti")
    # The missing texts name the batch, so a second writer of the same ones adds nothing.
    missing = wanted.agg(F.hex(F.bit_xor(F.xxhash64("__hash"))).alias("x"), F.count(F.lit(1)).alias("n")).first()
    once.append_once(wanted.select("__hash", make(F.col("__text")).alias(column)), path, "vectors", f"{missing.x or 0}-{missing.n}")
    vectors = once.read(spark, path)
    digest = vectors.agg(F.hex(F.bit_xor(F.xxhash64("__hash"))).alias("x")).first().x
    told = {"form": form, "options": {k: list(v) if isinstance(v, tuple) else v for k, v in options.items()}, "concepts": concepts(df, submit=options.get("submit", "submit_time"), extra=options.get("extra", []))}
    storage.write_json(spark, f"{path.rstrip('/')}.manifest.json", told | {"texts": vectors.count(), "texts_digest": digest, "dim": check_vectors(vectors, column) if vectors.take(1) else None, "created_at": storage.now()}, overwrite=True)
    return texts.join(vectors.dropDuplicates(["__hash"]), "__hash").drop("__hash", "__text")
