"""Transforms from source values to canonical ones, as Columns.

All run inside the JVM.  Unless a function is ``strict``, what can't be read becomes null.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The largest whole numbers of common widths, which stand for "no value" in durations.
SENTINELS = (2**15 - 1, 2**16 - 1, 2**31 - 1, 2**32 - 1, 2**63 - 1, 2**64 - 1)
#: Seconds of each duration unit.
DURATION_UNITS = {"seconds": 1.0, "minutes": 60.0, "hours": 3600.0}
#: Mebibytes of each memory unit; decimal and binary names mean the same.
MEMORY_UNITS = {"bytes": 1 / 1048576, "kb": 1 / 1024, "kib": 1 / 1024, "mb": 1.0, "mib": 1.0, "gb": 1024.0, "gib": 1024.0}
#: Strptime fields and their patterns here.
STRPTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%f": "SSSSSS", "%b": "MMM", "%B": "MMMM", "%p": "a", "%I": "hh", "%j": "DDD"}
#: A number, a unit of mebibytes or none, and the mark of an amount for each node.
_SLURM_MEMORY = r"^([\d.]+)([KMGTPkmgtp]?)[nN]?$"


def number(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double")


def integer(c: Column) -> Column:
    """Whole numbers, also those written with a zero fraction; others are null."""
    d = number(c)
    return F.when(d == F.floor(d), d.try_cast("bigint"))


def iso8601(c: Column, *, strict: bool = False) -> Column:
    """Times as ISO 8601, with a trailing UTC or GMT, a short offset, or none (then UTC)."""
    text = F.nullif(F.trim(c.cast("string")), F.lit(""))
    time = F.regexp_replace(text, r"\s+(UTC|GMT)$", "").try_cast("timestamp")
    return F.when(text.isNotNull() & time.isNull(), F.raise_error(F.concat(F.lit("not a time: "), text))).otherwise(time) if strict else time


def epoch(c: Column, unit: str) -> Column:
    """Times from seconds (fractions allowed), milliseconds or microseconds since 1970."""
    scale = {"epoch_s": 1_000_000, "epoch_ms": 1000, "epoch_us": 1}[unit]
    whole = F.trim(c.cast("string")).try_cast("bigint")
    micros = F.when(whole.isNotNull(), whole * scale).otherwise(F.round(number(c) * scale).try_cast("bigint"))
    return F.timestamp_micros(micros)


def strptime(c: Column, pattern: str) -> Column:
    for field, own in STRPTIME.items():
        pattern = pattern.replace(field, own)
    return F.try_to_timestamp(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit(pattern))


def told(made: Column, c: Column, what: str) -> Column:
    """made, or an error where c has a text that it could not be made of."""
    text = F.nullif(F.trim(c.cast("string")), F.lit(""))
    return F.when(text.isNotNull() & made.isNull(), F.raise_error(F.concat(F.lit(f"{what}: "), text)).cast("double")).otherwise(made)


def duration(c: Column, unit: str = "seconds", *, strict: bool = False) -> Column:
    """Seconds; sentinels are told before the unit is applied.  strict: clock texts and differences that can't be read are errors."""
    if strict and unit in ("hh:mm:ss", "timedelta"):
        return told(duration(c, unit), c, "not a duration")
    if unit == "hh:mm:ss":
        part = F.split(F.trim(c.cast("string")), ":")
        n = [F.try_element_at(part, F.lit(k)).try_cast("double") for k in (1, 2, 3)]
        return F.when(F.size(part) == 3, n[0] * 3600 + n[1] * 60 + n[2])
    if unit == "timedelta":
        text = F.trim(c.cast("string"))
        pattern = r"^(?:(\d+) days? ?,? ?)?(\d+):(\d+):(\d+(?:\.\d+)?)$"
        n = [F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("double") for k in (1, 2, 3, 4)]
        return F.when(n[1].isNotNull(), F.coalesce(n[0], F.lit(0.0)) * 86400 + n[1] * 3600 + n[2] * 60 + n[3])
    d = number(c)
    return F.when(~d.isin([float(s) for s in SENTINELS]), d * DURATION_UNITS[unit])


def ticks(c: Column, unit: str) -> Column:
    """Seconds from a stored duration of unit s, ms, us or ns."""
    return c.cast("double") / {"s": 1, "ms": 1e3, "us": 1e6, "ns": 1e9}[unit]


def memory(c: Column, unit: str) -> Column:
    """Mebibytes."""
    return number(c) * MEMORY_UNITS[unit]


def memory_slurm(c: Column) -> Column:
    """Mebibytes of scheduler notation: a number, a unit (mebibytes if none) and a per-node mark; per-CPU amounts are null."""
    text = F.trim(c.cast("string"))
    unit = F.upper(F.regexp_extract(text, _SLURM_MEMORY, 2))
    factor = F.when(unit == "K", 1 / 1024).when(unit == "G", 1024.0).when(unit == "T", 1024.0**2).when(unit == "P", 1024.0**3).otherwise(1.0)
    return F.nullif(F.regexp_extract(text, _SLURM_MEMORY, 1), F.lit("")).try_cast("double") * factor


def hash_identifier(c: Column, salt: str | None = None) -> Column:
    text = c.cast("string")
    return F.sha2(F.concat(F.lit(f"{salt}:"), text) if salt else text, 256)


def parse_size(c: Column) -> Column:
    """Bytes of sizes such as 5GB or 2 GiB."""
    pattern = r"(?i)^([\d.]+) *([KMGT]?)(i?)B?$"
    text = F.trim(c.cast("string"))
    power = F.instr(F.lit("KMGT"), F.upper(F.regexp_extract(text, pattern, 2)))
    power = F.when(F.regexp_extract(text, pattern, 2) == "", 0).otherwise(power)
    base = F.when(F.regexp_extract(text, pattern, 3) == "", 1000.0).otherwise(1024.0)
    return F.floor(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double") * F.pow(base, power)).cast("bigint")


def human_bytes(c: Column) -> Column:
    out = F.format_string("%.1f TB", c / 1e12)
    for size, name in ((1e12, "GB"), (1e9, "MB"), (1e6, "KB")):
        out = F.when(c < size, F.format_string(f"%.1f {name}", c / (size / 1000))).otherwise(out)
    return F.when(c < 1000, F.concat(c.cast("string"), F.lit(" B"))).otherwise(out)


def floor_hour(c: Column) -> Column:
    return F.date_trunc("hour", c)


def iso_z(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def weekday_hour(c: Column) -> Column:
    return F.date_format(c, "EEEE HH:00")


def log_target(c: Column) -> Column:
    return F.log1p(F.greatest(c, F.lit(0.0)))


def unlog_target(c: Column) -> Column:
    return F.greatest(F.expm1(F.least(c, F.lit(700.0))), F.lit(0.0))


def l2_normalise(c: Column) -> Column:
    """The array divided by its length; zeros stay zeros."""
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.transform(c, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def normal_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def finite(c: Column) -> Column:
    """The number, or null for what is no finite number."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def exact_sum(c: Column, scale: int = 6) -> Column:
    """A sum that does not depend on the order of rows: decimals are summed, not doubles."""
    return F.sum(c.cast(f"decimal(28,{scale})"))


def exact_mean(c: Column, scale: int = 6) -> Column:
    return exact_sum(c, scale).cast("double") / F.nullif(F.count(c), F.lit(0))


def transform(c: Column, spec: dict | None) -> Column:
    """The Column of a mapping rule's transform."""
    if not spec:
        return c
    kind = spec["type"]
    if kind == "timestamp":
        form = spec.get("format", "iso8601")
        return iso8601(c, strict=spec.get("strict", False)) if form == "iso8601" else epoch(c, form) if form.startswith("epoch_") else strptime(c, form)
    if kind == "duration":
        return duration(c, spec.get("unit", "seconds"), strict=spec.get("strict", False))
    if kind == "memory":
        return memory(c, spec.get("unit", "mib"))
    if kind == "memory_slurm":
        return memory_slurm(c)
    if kind == "hash_identifier":
        return hash_identifier(c, spec.get("salt"))
    if kind == "integer":
        return integer(c)
    if kind == "number":
        return number(c)
    raise ValueError(f"unknown transform {kind!r}")
