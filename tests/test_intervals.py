"""Overlaps of intervals against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from opsloom.operators import intervals


@pytest.mark.parametrize("seed", [1, 2])
def test_overlaps_by_brute_force(spark, seed):
    """Nested, touching, equal, empty, reversed and endless intervals, negative and large numbers, repeated rows."""
    r = random.Random(seed)

    def some(n):
        out = []
        for k in range(n):
            lo = r.choice([r.randint(-50, 50), r.randint(-(10**6), 10**6), r.randint(-(1 << 55), 1 << 55)])
            hi = lo + r.choice([0, 1, 2, 7, 8, 9, 63, 64, 1000, 10**6, 1 << 40, -1])
            out.append((k % (n - 2), r.choice([lo, lo, lo, None]), r.choice([hi, hi, hi, None]), r.choice("xy")))
        return out

    left, right = some(60), some(45)
    a = spark.createDataFrame(left, "i bigint, lo bigint, hi bigint, g string").repartition(3)
    b = spark.createDataFrame(right, "j bigint, first bigint, last bigint, g string").repartition(2)
    ends = {"a_from": F.col("lo"), "a_to": F.col("hi"), "b_from": F.col("first"), "b_to": F.col("last")}
    inf = 1 << 62
    span = lambda lo, hi: (-inf if lo is None else lo, inf if hi is None else hi)

    def meet(x, y):
        (p, q), (s, t) = span(x[1], x[2]), span(y[1], y[2])
        return p <= q and s <= t and p <= t and s <= q

    for on in ([], ["g"]):
        got = sorted((x.i, x.j) for x in intervals.overlap_join(a, b if on else b.drop("g"), on=on, **ends).collect())
        assert got == sorted((x[0], y[0]) for x in left for y in right if meet(x, y) and (not on or x[3] == y[3]))
    assert intervals.overlap_join(a.limit(0), b.drop("g"), **ends).count() == 0
    assert intervals.overlap_join(a, b.drop("g").limit(0), **ends).count() == 0


def test_pairs_are_found_once_and_few_rows_are_made(spark):
    """Long and short intervals: rows stay in proportion to both sides, whatever their lengths."""
    a = spark.range(3000).select("id", (F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 3).alias("hi"))
    b = spark.range(3).select(F.col("id").alias("w"), (F.col("id") * 10_000).alias("first"), (F.col("id") * 10_000 + 9_999).alias("last"))
    out = intervals.overlap_join(a, b, a_from=F.col("lo"), a_to=F.col("hi"), b_from=F.col("first"), b_to=F.col("last"))
    assert out.count() == 3000 and out.select("id").distinct().count() == 3000
    placed = intervals._placed(intervals._bounded(a, F.col("lo"), F.col("hi"), 0, 1), [14])
    assert placed.count() <= 4 * 3000


@pytest.mark.parametrize("seed", [1, 2])
def test_totals_are_those_of_the_pairs(spark, seed):
    """Counts, sums and least values over the overlaps, also of open, empty, reversed and equal intervals, without a pair."""
    r = random.Random(seed)

    def some(n):
        lows = [r.choice([r.randint(-50, 50), r.randint(-(10**6), 10**6), r.randint(-(1 << 55), 1 << 55)]) for _ in range(n)]
        return [(k, r.choice([lo, lo, lo, None]), r.choice([hi, hi, hi, None])) for k, lo in enumerate(lows) for hi in [lo + r.choice([0, 1, 2, 7, 8, 63, 64, 1000, 1 << 40, -1])]]

    a = spark.createDataFrame(some(60), "i bigint, lo bigint, hi bigint").repartition(3)
    b = spark.createDataFrame(some(45), "j bigint, first bigint, last bigint").repartition(2)
    ends = {"a_from": F.col("lo"), "a_to": F.col("hi"), "b_from": F.col("first"), "b_to": F.col("last")}
    totals = {"n": (F.lit(1).cast("bigint"), F.sum), "total": (F.col("i") * 3, F.sum), "least": (F.col("i"), F.min)}
    made = intervals.overlap_totals(a, b, totals, **ends)
    assert made.columns == [*b.columns, *totals]
    pairs = intervals.overlap_join(a, b, **ends).groupBy("j").agg(F.count(F.lit(1)), F.sum(F.col("i") * 3), F.min("i"))
    assert sorted(made.select("j", *totals).collect()) == sorted(pairs.collect())
    assert intervals.overlap_totals(a.limit(0), b, totals, **ends).count() == 0
