"""Mappings of families of public job traces: traces of one family differ in names of columns only.

``descriptor`` makes the descriptor of a trace from its family and, where they differ, its own columns.
"""

from __future__ import annotations

_SHARED_FILTER = {"require_nonnull": ["runtime_seconds"], "require_end_after_start": True}


def _times(form: str, **extra) -> dict[str, dict]:
    return {c: {"type": "timestamp", "format": form} | extra for c in ("submit_time", "start_time", "end_time")}


_COUNTS = {c: {"type": "integer"} for c in ("num_nodes_req", "num_cores_req", "num_gpus_req", "num_nodes_alloc", "num_cores_alloc", "allocated_cpus")}
_WHO = {"user": {"type": "hash_identifier"}, "account": {"type": "hash_identifier"}}
_PLAIN = {c: {} for c in ("job_id", "partition", "queue", "qos", "job_state", "name")}

#: What each family says of a canonical column; the source column comes from COLUMNS or the trace.
FAMILIES: dict[str, dict] = {
    # Standard Workload Format: the reader has made the times and turned -1 into nothing.
    "workload_format": {"decode": {"format": "swf"}, "rules": _PLAIN | _times("iso8601") | _COUNTS | {"user": {"type": "hash_identifier"}, "runtime_seconds": {"type": "duration", "unit": "seconds"}, "requested_seconds": {"type": "duration", "unit": "seconds"}}},
    # Exports of a scheduler's accounting: ISO times, seconds, memory in scheduler notation.
    "accounting_iso": {"decode": {"format": "parquet"}, "rules": _PLAIN | _times("iso8601") | _COUNTS | _WHO | {"runtime_seconds": {"type": "duration", "unit": "seconds"}, "requested_seconds": {"type": "duration", "unit": "seconds"}, "requested_memory_mib": {"type": "memory_slurm"}}},
    # The same with limits in minutes and times in seconds since 1970.
    "accounting_epoch": {"decode": {"format": "csv"}, "rules": _PLAIN | _times("epoch_s") | _COUNTS | _WHO | {"requested_seconds": {"type": "duration", "unit": "minutes"}}},
    # Spreadsheets with American dates and limits in minutes.
    "american_dates": {"decode": {"format": "csv"}, "rules": _PLAIN | _times("%m/%d/%Y %H:%M:%S") | _COUNTS | _WHO | {"requested_seconds": {"type": "duration", "unit": "minutes"}}},
    # Tables without job numbers, with limits as time differences.
    "numbered_timedelta": {"decode": {"format": "csv"}, "rules": _PLAIN | _times("iso8601") | _COUNTS | _WHO | {"job_id": {"synthesize": "row_index"}, "requested_seconds": {"type": "duration", "unit": "timedelta"}}},
    # Groups of records nested in JSON.
    "nested_groups": {"decode": {"format": "json", "options": {"record_path": "tasklist"}}, "rules": _PLAIN | _times("epoch_s") | _COUNTS | {"platform": {}}},
}
COLUMNS = {
    "workload_format": {
        "job_id": "job_number", "submit_time": "submit_time", "start_time": "start_time", "end_time": "end_time", "runtime_seconds": "run_time", "requested_seconds": "requested_time",
        "allocated_cpus": "allocated_processors", "num_cores_req": "requested_processors", "job_state": "status", "queue": "queue", "partition": "partition", "user": "user_id",
    }
}


def descriptor(dataset: str, family: str, resources: list[dict], columns: dict[str, str] | None = None, *, kind: str = "http", domain: str = "job-runtime", **decode_options) -> dict:
    """The descriptor of a trace; columns: canonical name -> source column."""
    f = FAMILIES[family]
    named = COLUMNS.get(family, {}) | (columns or {})
    mapping = {c: rule | {"from": named[c]} for c, rule in f["rules"].items() if c in named}
    mapping |= {c: rule for c, rule in f["rules"].items() if "synthesize" in rule}
    mapping |= {c: {"from": source} for c, source in named.items() if c not in f["rules"]}
    mapping.setdefault("runtime_seconds", {"derive": "end_minus_start"})
    decode = {"format": f["decode"]["format"], "options": f["decode"].get("options", {}) | decode_options}
    return {"dataset_id": dataset, "source": {"kind": kind, "resources": resources}, "decode": decode, "targets": [{"domain": domain, "mapping": mapping, "filter": _SHARED_FILTER}]}
