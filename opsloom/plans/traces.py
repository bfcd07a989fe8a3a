"""Public job traces that can be prepared out of the box.

A trace is a group of columns, the files that hold it, and where they come from.  Traces of one
archive share their columns, so only what differs stands with a trace.  Sizes and hashes of files are
recorded in the lock file at the first fetch.
"""

from __future__ import annotations

from .families import _SHARED_FILTER

# What the columns of each archive mean: canonical name -> source column, with the transform if there is one.
_SECONDS, _MINUTES = {"type": "duration", "unit": "seconds"}, {"type": "duration", "unit": "minutes"}
_ISO, _EPOCH, _AMERICAN = ({"type": "timestamp", "format": f} for f in ("iso8601", "epoch_s", "%m/%d/%Y %H:%M:%S"))
_WHOLE, _HASHED, _CLOCK, _MEMORY = {"type": "integer"}, {"type": "hash_identifier"}, {"type": "duration", "unit": "timedelta"}, {"type": "memory_slurm"}

COLUMNS: dict[str, dict[str, tuple[str, dict]]] = {
    "swf": {
        "job_id": ("job_number", {}), "submit_time": ("submit_time", {}), "start_time": ("start_time", {}), "end_time": ("end_time", {}),
        "runtime_seconds": ("run_time", _SECONDS), "requested_seconds": ("requested_time", _SECONDS), "allocated_cpus": ("allocated_processors", _WHOLE), "num_cores_req": ("requested_processors", _WHOLE),
        "job_state": ("status", {}), "queue": ("queue", {}), "partition": ("partition", {}), "user": ("user_id", _HASHED),
    },
    "job_composite": {
        "job_id": ("JOB_NAME", {}), "submit_time": ("QUEUED_TIMESTAMP", _ISO), "start_time": ("START_TIMESTAMP", _ISO), "end_time": ("END_TIMESTAMP", _ISO),
        "runtime_seconds": ("RUNTIME_SECONDS", _SECONDS), "requested_seconds": ("WALLTIME_SECONDS", _SECONDS), "allocated_cpus": ("CORES_USED", _WHOLE), "num_cores_req": ("CORES_REQUESTED", _WHOLE),
        "num_nodes_alloc": ("NODES_USED", _WHOLE), "num_nodes_req": ("NODES_REQUESTED", _WHOLE), "queue": ("QUEUE_NAME", {}), "job_state": ("EXIT_STATUS", {}), "user": ("USERNAME_GENID", {}),
        "account": ("PROJECT_NAME_GENID", {}), "machine": ("MACHINE_NAME", {}), "award_category": ("ALLOCATION_AWARD_CATEGORY", {}), "science_field": ("SCIENCE_FIELD_SHORT", {}),
    },
    "atlas": {
        "submit_time": ("submit_time", _ISO), "start_time": ("start_time", _ISO), "end_time": ("end_time", _ISO), "requested_seconds": ("wallclock_limit", _CLOCK),
        "num_nodes_req": ("node_count", _WHOLE), "num_tasks_req": ("tasks_requested", _WHOLE), "job_state": ("job_status", {}), "user": ("user_ID", _HASHED), "account": ("group_ID", _HASHED),
    },
    "esif": {
        "job_id": ("id", {}), "submit_time": ("submit_time", {}), "start_time": ("start_time", {}), "end_time": ("end_time", {}), "requested_seconds": ("wallclock_req", _SECONDS),
        "num_nodes_req": ("nodes_req", _WHOLE), "num_cores_req": ("processors_req", _WHOLE), "num_nodes_alloc": ("nodes_used", _WHOLE), "num_cores_alloc": ("processors_used", _WHOLE),
        "num_gpus_req": ("gpus_requested", _WHOLE), "requested_memory_mib": ("memory_req", _MEMORY), "partition": ("partition", {}), "qos": ("qos", {}), "job_state": ("state_simple", {}),
        "user": ("user_hash", {}), "account": ("account_hash", {}),
    },
    "adastra": {
        "job_id": ("job_id", {}), "start_time": ("start_time", _ISO), "end_time": ("end_time", _ISO), "submit_time": ("submit_time", _ISO), "runtime_seconds": ("run_time", _SECONDS),
        "partition": ("partition", {}), "qos": ("qos", {}), "num_nodes_req": ("num_nodes_req", _WHOLE), "num_cores_req": ("num_cores_req", _WHOLE), "num_gpus_req": ("num_gpus_req", _WHOLE),
        "job_state": ("job_state", {}), "user": ("user_id", _HASHED),
    },
    "ccin2p3": {
        "job_id": ("jobid", {}), "submit_time": ("submit", _EPOCH), "start_time": ("start", _EPOCH), "end_time": ("end", _EPOCH), "runtime_seconds": ("elapsed", _SECONDS), "requested_seconds": ("timelimit", _SECONDS),
        "allocated_cpus": ("alloccpus", _WHOLE), "partition": ("partition", {}), "job_state": ("state", {}), "user": ("user", _HASHED), "account": ("account", _HASHED), "allocgpus": ("allocgpus", _WHOLE),
    },
    "fugaku": {
        "job_id": ("jid", {}), "start_time": ("sdt", _ISO), "end_time": ("edt", _ISO), "submit_time": ("adt", _ISO), "runtime_seconds": ("duration", _SECONDS), "requested_seconds": ("elpl", _SECONDS),
        "user": ("usr", _HASHED), "name": ("jnam", {}), "num_cores_req": ("cnumr", _WHOLE), "num_nodes_req": ("nnumr", _WHOLE), "num_cores_alloc": ("cnumat", _WHOLE), "num_nodes_alloc": ("nnuma", _WHOLE),
        "exit_code": ("ec", _WHOLE), "job_state": ("exit state", {}), "pclass": ("pclass", {}),
    },
    "anvil": {
        "job_id": ("Job Id", {}), "submit_time": ("Submit Time", _ISO), "start_time": ("Start Time", _ISO), "end_time": ("End Time", _ISO), "runtime_seconds": ("Wall Time", _SECONDS),
        "requested_seconds": ("Requested Wall Time", _SECONDS), "allocated_cpus": ("Cores", _WHOLE), "num_nodes_alloc": ("Nodes", _WHOLE), "num_gpus_req": ("Gpus", _WHOLE), "num_nodes_req": ("Requested Nodes", _WHOLE),
        "queue": ("Queue", {}), "job_state": ("Exit Status", {}), "user": ("User", {}), "account": ("Account", {}),
    },
    "conte": {
        "job_id": ("jobID", {}), "submit_time": ("qtime", _AMERICAN), "start_time": ("start", _AMERICAN), "end_time": ("end", _AMERICAN), "runtime_seconds": ("resources_used.walltime", _SECONDS),
        "requested_seconds": ("Resource_List.walltime", _SECONDS), "num_cores_alloc": ("Resource_List.ncpus", _WHOLE), "num_nodes_alloc": ("Resource_List.nodect", _WHOLE), "queue": ("queue", {}),
        "job_state": ("Exit_status", {}), "user": ("user", {}), "account": ("group", {}),
    },
    "stampede": {
        "job_id": ("jobID", {}), "submit_time": ("submit", _AMERICAN), "start_time": ("start", _AMERICAN), "end_time": ("end", _AMERICAN), "requested_seconds": ("walltime", _MINUTES),
        "allocated_cpus": ("ncpus", _WHOLE), "num_nodes_alloc": ("nnodes", _WHOLE), "queue": ("queue", {}), "job_state": ("exit_status", {}), "user": ("user", {}), "account": ("account", {}),
    },
    "ic2": {
        "job_id": ("task_id", {}), "submit_time": ("submit_time", _EPOCH), "start_time": ("start_time", _EPOCH), "end_time": ("finish_time", _EPOCH), "allocated_cpus": ("cpus", _WHOLE),
        "num_gpus_req": ("gpus", _WHOLE), "name": ("app_name", {}), "platform": ("platform", {}),
    },
    "lassen": {
        "job_id": ("primary_job_id", _WHOLE), "submit_time": ("job_submit_time", _ISO), "start_time": ("begin_time", _ISO), "end_time": ("end_time", _ISO), "requested_seconds": ("time_limit", _SECONDS),
        "num_nodes_alloc": ("num_nodes", _WHOLE), "num_cores_alloc": ("num_processors", _WHOLE), "num_gpus_req": ("num_gpus", _WHOLE), "exit_code": ("exit_status", _WHOLE), "queue": ("queue", {}),
        "job_type": ("job_type", {}), "user": ("hashed_user_id", {}), "account": ("hashed_user_group_id", {}),
    },
    "supercloud": {
        "job_id": ("id_job", {}), "submit_time": ("time_submit", _EPOCH), "start_time": ("time_start", _EPOCH), "end_time": ("time_end", _EPOCH), "requested_seconds": ("timelimit", _MINUTES),
        "num_cores_req": ("cpus_req", _WHOLE), "num_nodes_alloc": ("nodes_alloc", _WHOLE), "partition": ("partition", {}), "job_state": ("state", {}), "user": ("id_user", _HASHED), "exit_code": ("exit_code", {}),
        "constraints": ("constraints", {}),
    },
    "eagle": {
        "job_id": ("job_id", {}), "submit_time": ("submit_time", _ISO), "start_time": ("start_time", _ISO), "end_time": ("end_time", _ISO), "runtime_seconds": ("run_time", _SECONDS),
        "requested_seconds": ("wallclock_req", _SECONDS), "partition": ("partition", {}), "qos": ("qos", {}), "num_nodes_req": ("nodes_req", _WHOLE), "num_cores_req": ("processors_req", _WHOLE),
        "num_gpus_req": ("gpus_req", _WHOLE), "job_state": ("state", {}), "user": ("user", _HASHED), "account": ("account", _HASHED), "name": ("name", {}),
    },
    "pm100": {
        "job_id": ("job_id", {}), "start_time": ("start_time", {}), "end_time": ("end_time", {}), "submit_time": ("submit_time", {}), "runtime_seconds": ("run_time", _SECONDS), "partition": ("partition", {}),
        "requested_seconds": ("time_limit", _MINUTES), "num_nodes_req": ("num_nodes_req", _WHOLE), "num_cores_req": ("num_cores_req", _WHOLE), "num_cores_alloc": ("num_cores_alloc", _WHOLE), "qos": ("qos", {}),
        "job_state": ("job_state", {}), "user": ("user_id", _HASHED),
    },
}

_SWF = "https://www.cs.huji.ac.il/labs/parallel/workload"
_ZENODO = "https://zenodo.org/records/{}/files"
_FRESCO = "https://www.datadepot.rcac.purdue.edu/sbagchi/fresco/repository"
_CMU = "https://ftp.pdl.cmu.edu/pub/datasets/ATLAS"


def _months(first: str, n: int, form: str) -> list[str]:
    """n file names from a month (yyyy-mm) on; the form may use {y}, {m} and {name}, the month's short English name."""
    names = "jan feb mar apr may june july aug sep oct nov dec".split()
    y, m = map(int, first.split("-"))
    return [form.format(y=y + (m - 1 + k) // 12, m=(m - 1 + k) % 12 + 1, name=names[(m - 1 + k) % 12]) for k in range(n)]


# Each trace's columns, format, the address of its files, and their names; an address of None asks for files fetched by hand.
TRACES: dict[str, tuple[str, str, str | None, list[str]]] = {
    "adastra_mi250": ("adastra", "parquet", _ZENODO.format(14007065), ["AdastaJobsMI250_15days.parquet"]),
    "alcf_djc_aurora": ("job_composite", "csv", None, ["ANL-ALCF-DJC-AURORA_*.csv.gz"]),
    "alcf_djc_polaris": ("job_composite", "csv", None, ["ANL-ALCF-DJC-POLARIS_*.csv.gz"]),
    "alcf_djc_theta": ("job_composite", "csv", None, ["ANL-ALCF-DJC-THETA_*.csv.gz"]),
    "atlas_mustang": ("atlas", "csv", f"{_CMU}/mustang", ["mustang_release_v1.0beta.csv.gz"]),
    "atlas_opentrinity": ("atlas", "csv", f"{_CMU}/trinity", ["trinity_formatted_release_v1.0beta.csv.gz"]),
    "ccin2p3_2024": ("ccin2p3", "csv", _ZENODO.format(18668107), _months("2024-09", 4, "{m:02}.tsv.tar.gz")),
    "fdata_fugaku": ("fugaku", "parquet", _ZENODO.format(11467483), _months("2023-03", 7, "23_{m:02}.parquet")),
    "fresco_anvil": ("anvil", "csv", f"{_FRESCO}/Anvil/JobAccounting", _months("2022-07", 11, "job_accounting_{name}{y}_anon.csv")),
    "fresco_conte": ("conte", "csv", f"{_FRESCO}/Conte/AccountingStatistics", _months("2015-03", 12, "{y}-{m:02}.csv")),
    "fresco_stampede1": ("stampede", "csv", f"{_FRESCO}/Stampede/AccountingStatistics", ["stampede_accounting.csv"]),
    "ic2": ("ic2", "json", _ZENODO.format(15545096), ["all_workloads_ic2.json", "all_workloads_polaris.json", "all_workloads_aws.json"]),
    "lassen": ("lassen", "csv", "https://media.githubusercontent.com/media/LLNL/LAST/main/Lassen-Supercomputer-Job-Dataset", ["final_csm_allocation_history_hashed.csv"]),
    "mit_supercloud": ("supercloud", "csv", "https://mit-supercloud-dataset.s3.amazonaws.com/datacenter-challenge/202201", ["slurm-log.csv"]),
    "nlr_eagle": ("esif", "parquet", "https://data.nlr.gov/system/files/295", ["1773544762-esif.hpc.eagle.job-anon.zip"]),
    "nlr_kestrel": ("esif", "parquet", "https://data.nlr.gov/system/files/302", ["1773544299-esif.hpc.kestrel.job-anon.zip"]),
    "nrel_eagle": ("eagle", "parquet", "https://data.openei.org/files/5860", ["eagle_data.parquet"]),
    "pm100": ("pm100", "parquet", _ZENODO.format(10127767), ["job_table.parquet"]),
    "pwa_cea_curie": ("swf", "swf", f"{_SWF}/l_cea_curie", ["CEA-Curie-2011-2.1-cln.swf.gz"]),
    "pwa_hpc2n": ("swf", "swf", f"{_SWF}/l_hpc2n", ["HPC2N-2002-2.swf.gz"]),
    "pwa_kit_fh2": ("swf", "swf", f"{_SWF}/l_kit_fh2", ["KIT-FH2-2016-1.swf.gz"]),
    "pwa_metacentrum": ("swf", "swf", f"{_SWF}/l_metacentrum2", ["METACENTRUM-2013-1.swf.gz"]),
    "pwa_ricc": ("swf", "swf", f"{_SWF}/l_ricc", ["RICC-2010-2.swf.gz"]),
    "pwa_sdsc_blue": ("swf", "swf", f"{_SWF}/l_sdsc_blue", ["SDSC-BLUE-2000-4.swf.gz"]),
}
#: Times with their zone stand in other columns here.
RENAMED = {"nlr_eagle": {c: f"{c}_tz" for c in ("submit_time", "start_time", "end_time")}}
_OPTIONS = {"ccin2p3_2024": {"delimiter": "\t"}, "ic2": {"record_path": "tasklist"}}
_STRICT = {"job_composite": ["runtime_seconds", "start_time", "end_time"], "stampede": ["runtime_seconds"]}


def trace(name: str) -> dict:
    """The descriptor of a trace."""
    kind, form, base, files = TRACES[name]
    columns = COLUMNS[kind]
    renamed = RENAMED.get(name, {})
    rules = {c: {"from": renamed.get(c, source)} | rule for c, (source, rule) in columns.items()}
    if "job_id" not in rules:
        rules = {"job_id": {"synthesize": "row_index"}} | rules
    rules.setdefault("runtime_seconds", {"derive": "end_minus_start"})
    needed = {"require_nonnull": ["runtime_seconds"]}
    if kind in _STRICT:
        needed = _SHARED_FILTER | {"require_nonnull": _STRICT[kind], "require_positive": ["allocated_cpus"]}
    options = dict(_OPTIONS.get(name, {}))
    if form in ("csv", "parquet") and kind in ("job_composite", "conte", "esif"):
        options["columns"] = [rule["from"] for rule in rules.values() if "from" in rule]  # wide files: only these are read
    source = {"kind": "http" if base else "manual", "resources": [{"filename": f} | ({"url": f"{base}/{f}"} if base else {}) for f in files]}
    return {"dataset_id": name, "source": source, "decode": {"format": form, "options": options}, "targets": [{"domain": "job-runtime", "mapping": rules, "filter": needed}]}


def entries() -> list[dict]:
    """The traces as entries of a registry."""
    return [{"id": f"dataset.{n}", "type": "dataset", "label": n, "domain": "job-runtime", "tags": [k, f], "source": "http" if base else "manual", "input_schema": f, "output_schema": "job"} for n, (k, f, base, _) in TRACES.items()]
