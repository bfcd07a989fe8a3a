import datetime as dt

import pytest
from pyspark.sql import functions as F

from opsloom.functions import transforms as T


def values(spark, texts, make, kind="string"):
    df = spark.createDataFrame(list(enumerate(texts)), f"i int, x {kind}")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_memory_of_schedulers(spark):
    texts = ["160G", "  2g  ", "512K", "4096", "0n", "90000Mn", "2Gn", "2GN", "4Gc", "n", "1.2.3G", None]
    assert values(spark, texts, T.memory_slurm) == [163840, 2048, 0.5, 4096, 0, 90000, 2048, 2048, None, None, None, None]


def test_duration_sentinels_come_before_units(spark):
    texts = ["1440", str(2**32 - 1), str(2**31 - 1), "60", "UNLIMITED", "INVALID", "Partition_Limit", "", None]
    assert values(spark, texts, lambda c: T.duration(c, "minutes")) == [86400, None, None, 3600, None, None, None, None, None]


def test_timedelta(spark):
    texts = ["365 days 00:00:00.000000000", "2 days 03:04:05", "01:00:00", ""]
    assert values(spark, texts, lambda c: T.duration(c, "timedelta")) == [31536000, 183845, 3600, None]


def test_strict_durations(spark):
    assert values(spark, ["01:00:00", ""], lambda c: T.duration(c, "hh:mm:ss", strict=True)) == [3600, None]
    for unit, text in (("hh:mm:ss", "01:00"), ("timedelta", "two days")):
        with pytest.raises(Exception, match="not a duration"):
            values(spark, [text], lambda c: T.duration(c, unit, strict=True))


def test_times(spark):
    at = dt.datetime(2023, 5, 31, 22, 21, 4)
    assert values(spark, ["2023-05-31T22:21:04 UTC", "2023-05-31T22:21:04Z", ""], lambda c: F.date_format(T.iso8601(c), "yyyy-MM-dd HH:mm:ss")) == [str(at), str(at), None]
    assert values(spark, ["03/01/2015 07:04:29", "", "not-a-date"], lambda c: F.date_format(T.strptime(c, "%m/%d/%Y %H:%M:%S"), "yyyy-MM-dd HH:mm:ss")) == ["2015-03-01 07:04:29", None, None]
    with pytest.raises(Exception, match="not a time"):
        values(spark, ["never"], lambda c: T.iso8601(c, strict=True))


def test_numbers(spark):
    assert values(spark, ["24.0", "24.5", " 7 ", "x", None], T.integer) == [24, None, 7, None, None]
    assert values(spark, ["5GB", "2 GiB", "12", "1.5kb", "x"], T.parse_size) == [5_000_000_000, 2 * 1024**3, 12, 1500, None]
    assert values(spark, [float("nan"), float("inf"), 1.5, None], T.finite, "double") == [None, None, 1.5, None]


def test_names_and_bytes(spark):
    assert values(spark, [" Job ID (x) ", "__A--b__"], T.normal_name) == ["job_id_x", "a_b"]
    assert values(spark, [999, 1500, 2_500_000], T.human_bytes, "bigint") == ["999 B", "1.5 KB", "2.5 MB"]
