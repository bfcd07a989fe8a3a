"""Mixing sources to target weights by Poisson replication.

Each document is repeated Poisson(rate) times, where the rate of its source makes the expected
share of the source its target weight.  The count inverts the Poisson distribution at a uniform
number hashed from (seed, doc_id), so it does not depend on partitioning, order or reruns.  The
copies are then put into one global order by a hash of (seed, doc_id, copy).

Defined results for odd input: null sources form one source of their own; a row without ``doc_id``
is named by the MD5 sum of its text for hashing, if there is a text column; rows with the same ``doc_id``
get the same count, each for itself; sources
without a weight, or with weight 0, get no copies if weights are given; an empty table gives none;
clashing input columns ``copy`` and ``shuffle_key`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import Stages

#: A rate above this is split into a sum of equal parts, as exp(-rate) would underflow.
LARGEST_PART = 500.0
#: Distributions with more numbers in all than this (8 bytes each) are joined by shuffle instead of broadcast.
BROADCAST_NUMBERS = 4_000_000


def name_of(docs: DataFrame) -> Column:
    """What a row is hashed by: its doc_id, else its text."""
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")) if "text" in docs.columns else F.lit("")
    return F.coalesce(F.col("doc_id").cast("string"), text)


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, hashed from the parts."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def rates(docs: DataFrame, weights: dict[str, float] | None, total: int | None) -> DataFrame:
    """source, n, rate, and the cumulative Poisson distribution of one part of the rate."""
    by_source = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = by_source.withColumn("weight", F.lit(1.0))
    else:
        pairs = F.create_map(*(F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1])))) if weights else None
        weighed = by_source.withColumn("weight", F.coalesce(F.try_element_at(pairs, F.col("source")), F.lit(0.0)) if weights else F.lit(0.0))
    sums = weighed.agg(F.sum("n").alias("n"), F.sum("weight").alias("w")).first()
    rows, weight = sums.n or 0, sums.w or 1.0
    rated = weighed.withColumn("rate", F.lit(float(total if total is not None else rows)) * F.col("weight") / F.lit(weight) / F.col("n"))
    rated = rated.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_PART)).cast("int")).withColumn("unit", F.col("rate") / F.col("parts"))
    return rated.selectExpr(
        "source", "n", "rate", "parts",
        """aggregate(sequence(1, cast(ceil(unit + 12 * sqrt(unit) + 30) as int)),
             named_struct('p', exp(-unit), 'c', exp(-unit), 'all', array(exp(-unit))),
             (s, k) -> named_struct('p', s.p * unit / k, 'c', s.c + s.p * unit / k, 'all', concat(s.all, array(s.c + s.p * unit / k))),
             s -> s.all) as cdf""",
    )


def replicate(docs: DataFrame, *, weights: dict[str, float] | None = None, total: int | None = None, seed: str = "mix-1") -> DataFrame:
    """The columns of docs plus copy (from 1) and shuffle_key, in the order of shuffle_key.

    weights: target share of each source (any scale), equal shares if None; total: expected rows of
    the result, as many as docs has if None.
    """
    docs = docs.drop("copy", "shuffle_key")
    stages, name = Stages(docs.sparkSession), name_of(docs)
    rated = stages.write("rates", rates(docs, weights, total))
    small = rated.select(F.col("source").alias("__source"), "parts", "cdf")
    numbers = rated.agg(F.sum(F.size("cdf") + F.lit(8))).first()[0] or 0
    small = F.broadcast(small) if numbers <= BROADCAST_NUMBERS else small
    joined = docs.join(small, docs["source"].eqNullSafe(small["__source"]))

    def count(i: Column) -> Column:
        """The Poisson number of part i; its uniform number is bound, so that it is hashed once and not for each element."""
        return F.element_at(F.transform(F.array(uniform(seed, name, i)), lambda u: F.size(F.filter("cdf", lambda c: c <= u))), 1)

    drawn = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda acc, i: acc + count(i))
    copies = joined.withColumn("__n", drawn).where("__n > 0").select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("copy"))
    keyed = copies.withColumn("shuffle_key", F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(f"{seed}:order"), name, F.col("copy").cast("string")), 256), 1, 15), 16, 10).cast("bigint"))
    return keyed.orderBy("shuffle_key", "doc_id", "copy")


def oracle(seed: str = "mix-1") -> str:
    """DuckDB SQL of replicate() with its defaults, for rates below LARGEST_PART."""
    return f"""
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT sum(n) AS rows, count(*) AS w FROM s),
r AS (SELECT source, rows::DOUBLE * 1.0 / w / n AS rate FROM s, t),
p AS (SELECT source, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 30)::INT)) AS k, rate FROM r),
c AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
u AS (SELECT *, ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || ':1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM u.source AND c.cdf <= u.u) AS n FROM u),
x AS (SELECT doc_id, text, lang, source, n_chars, unnest(generate_series(1, n)) AS copy FROM n)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy,
  ('0x' || substr(sha256('{seed}:order:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || ':' || copy), 1, 15))::BIGINT AS shuffle_key FROM x
"""
