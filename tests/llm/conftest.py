import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import pytest
from pyspark.sql import functions as F

from llm_samples import MOTS, SCHEMA, prose


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns with clashing names."""
    a, b = prose(1, 120), prose(2, 90, MOTS)
    rows = [
        (1, a, "en", "s1", 1), (2, b, "fr", "s1", 1), (3, a, "en", None, 1), (3, a, "en", None, 1), (4, None, None, "s2", None), (5, "", "en", "s2", 0), (6, "  \n\t ", None, "s2", 0),
        (None, a, "en", "s1", 1), (7, prose(3, 30_000), "en", "s1", 1), (8, "12345 !!", "en", "s3", 1), (9, a + " more words at the end", None, "s3", 1), (10, b + "\n" + a, "fr", "s3", 1), (11, "Z", "en", "s3", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("key", "copy", "shard", "rank", "findings", "runs", "n_lines", "shuffle_key", "h", "m", "u", "v", "w", "n", "block", "part", "pos", "body", "found", "words", "sums", "ms", "ps", "item_id", "h1"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
