"""Command line: python -m opsloom COMMAND ...; each command prints what it found or wrote as JSON."""

from __future__ import annotations

import argparse
import json

from . import storage
from .session import session

CATEGORICAL = ["partition", "queue", "qos", "user", "account", "job_state"]

#: Command -> (what it does, arguments, options).
COMMANDS: dict[str, tuple[str, list[str], list[str]]] = {
    "query": ("shows a registered query", ["name", "sf_dir"], []),
    "baseline": ("evaluates the mean baseline on a table", ["table", "out"], ["windows", "lookback"]),
    "evaluate": ("runs a recipe on a table", ["recipe", "table", "out"], ["dataset"]),
    "analyze": ("writes an analysis of a table", ["table", "out"], []),
    "validate": ("checks a bundle, a manifest or a table", ["path"], []),
    "characterize": ("writes the card of a table", ["table", "out", "dataset"], []),
    "slice": ("writes the jobs of a window", ["table", "out", "start", "end"], ["extra-days", "dataset"]),
    "prepare": ("fetches and prepares a data set: a registered trace or a descriptor file", ["descriptor", "cache", "out"], ["manual"]),
    "fetch": ("fetches the files of a data set", ["descriptor", "cache"], ["manual", "slice"]),
    "ingest-log": ("makes a job table of controller logs", ["log", "out"], []),
    "ingest-parquet": ("makes a job table of a Parquet export and a mapping file", ["table", "mapping", "out"], []),
    "suggest": ("suggests which columns fill which fields", ["table"], []),
    "embed": ("adds hashed text vectors to a table", ["table", "vectors", "out"], ["form"]),
    "plan": ("plans the cells of cards and models, with their recipes", ["cards", "out"], ["slices", "most-rows", "dataset", "model", "overrides"]),
    "diagnose": ("writes what the preparation of a table's categories comes to", ["table", "out"], []),
    "leaderboard": ("writes the leaderboard of a folder of bundles", ["folder", "out"], []),
    "browse": ("lists registry entries", [], ["registry", "type", "tag", "source"]),
    "info": ("shows a registry entry", ["entry"], ["registry"]),
    "record-hash": ("shows the fingerprint of a table, as its rows are", ["table"], []),
}


def descriptor(name: str) -> dict:
    from .plans import prepare, traces

    return traces.trace(name) if name in traces.TRACES else prepare.load(name)


def run(spark, a: argparse.Namespace) -> object:
    """What a command prints."""
    from .operators import mapping, models, similarity, summaries
    from .plans import catalog, evaluate, prepare, reports, validate
    from .sources import fetch, readers

    table = lambda: spark.read.parquet(a.table)
    rows = lambda df: [r.asDict() for r in df.collect()]
    if a.what in ("evaluate", "baseline"):
        if a.what == "evaluate":
            recipe = evaluate.load(a.recipe)
        else:
            metrics = [{"name": n, "target": "runtime_seconds"} for n in ("mae", "rmse")]
            recipe = {"model": {"id": "mean"}, "metrics": metrics, "split": {"method": "rolling", "n_windows": int(a.windows or 20), "training_lookback_days": int(a.lookback or 100)}}
        predictions, report = evaluate.run(table(), recipe)
        return evaluate.write_bundle(spark, a.out, recipe, report, predictions=predictions, dataset=getattr(a, "dataset", None) or a.table)
    if a.what == "analyze":
        return reports.write_analysis(table(), a.out, categorical=CATEGORICAL)
    if a.what == "validate":
        return validate.check_path(spark, a.path, strict=a.strict)
    if a.what == "characterize":
        return reports.write_card(table(), a.out, a.dataset, categorical=CATEGORICAL)
    if a.what == "slice":
        return reports.write_slice(table(), a.out, a.start, a.end, extra_days=int(a.extra_days or 0), dataset=a.dataset, source=a.table)
    if a.what == "prepare":
        return prepare.prepare(spark, descriptor(a.descriptor), a.cache, a.out, strict=a.strict, manual=a.manual)
    if a.what == "fetch":
        d = descriptor(a.descriptor)
        return [str(f) for f in fetch.fetch(d["dataset_id"], d["source"], a.cache, manual=a.manual, name=a.slice)]
    if a.what == "ingest-log":
        jobs = readers.scheduler_log_file(spark, a.log)
        jobs.write.parquet(f"{a.out}/data.parquet")
        return {"rows": spark.read.parquet(f"{a.out}/data.parquet").count(), "fields": rows(mapping.field_presence(jobs))}
    if a.what == "ingest-parquet":
        raw = readers.unify_temporal(readers.parquet(spark, a.table))
        prepare.target(raw, {"mapping": prepare.read_mapping(a.mapping)}, raw.columns[:1]).write.parquet(f"{a.out}/data.parquet")
        written = spark.read.parquet(f"{a.out}/data.parquet")
        return prepare.write_manifest(spark, f"{a.out}/manifest.json", written, dataset=a.table, domain="job-runtime", sources=[a.table]) | {"quality": validate.validate(written, strict=a.strict)}
    if a.what == "suggest":
        return rows(mapping.suggest(readers.parquet(spark, a.table)).orderBy("field", "rank"))
    if a.what == "embed":
        prepare.embed(table(), a.vectors, similarity.hash_encode, form=a.form or "prose").write.parquet(a.out)
        return storage.read_json(spark, f"{a.vectors.rstrip('/')}.manifest.json")
    if a.what == "plan":
        cards, sides = reports.read_cards(spark, a.cards, a.slices)
        known = spark.createDataFrame([(m, m == "embedding_knn") for m, split in evaluate.MODELS if split == "rolling"], "model string, needs_vectors boolean")
        cells = catalog.matrix(cards.select("dataset", "n_rows", "healthy"), known.select("model"), sidecars=sides, most_rows=int(a.most_rows) if a.most_rows else None, only_dataset=a.dataset, only_model=a.model)
        plan = {"cells": rows(cells.orderBy("dataset", "model")), "embed": [r.dataset for r in catalog.embeddings_needed(cells, known).orderBy("dataset").collect()]}
        for c in plan["cells"]:
            if c["status"] == "cell":
                c["recipe"] = storage.write_json(spark, f"{a.out}/{c['dataset']}.{c['model']}.recipe.json", catalog.cell_recipe(c["dataset"], c["model"], **json.loads(a.overrides or "{}")), overwrite=True)
        storage.write_json(spark, f"{a.out}/plan.json", plan, overwrite=True)
        return plan
    if a.what == "diagnose":
        told = models.diagnostics(table())
        storage.write_json(spark, a.out, told, overwrite=True)
        return told
    if a.what == "leaderboard":
        return reports.write_leaderboard(spark, a.folder, a.out)
    if a.what in ("browse", "info"):
        entries = catalog.read_registry(spark, a.registry) if a.registry else catalog.own_registry(spark)
        return catalog.info(entries, a.entry) if a.what == "info" else rows(catalog.registry_filter(entries, kind=a.type, tag=a.tag, source=a.source).orderBy("id"))
    return summaries.fingerprint(table()).first().asDict()


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="opsloom", description=__doc__)
    sub = parser.add_subparsers(dest="what", required=True)
    for name, (told, needed, options) in COMMANDS.items():
        p = sub.add_parser(name, help=told)
        for n in needed:
            p.add_argument(n)
        for o in options:
            p.add_argument(f"--{o}")
        p.add_argument("--strict", action="store_true")
    a = parser.parse_args(args)
    spark = session()
    if a.what == "query":
        from .catalog_queries import QUERIES

        QUERIES[a.name](spark, a.sf_dir).show(50, False)
    else:
        print(json.dumps(storage.jsonable(run(spark, a)), indent=2))


if __name__ == "__main__":
    main()
