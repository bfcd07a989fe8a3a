"""Joins of overlapping intervals, by buckets of several widths.

An interval has the level of the least power of two that is not below its length, so it touches at
most two buckets of that level, or of any wider one.  Two intervals meet at the wider of their
levels: each is put into its buckets at its own level and at every wider level that the other side has.  Of the
one or two buckets that a pair shares, that with the later of both beginnings counts, so a pair is found once.
The keys of the join are bucket numbers; a crowded bucket is an ordinary hot key, which adaptive execution splits.

Where only totals over the overlapping rows are asked, no pair is made: overlap_totals() adds up rows in buckets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import checkpoint

#: Levels are exponents; intervals are numbers of 63 bits.
WIDEST = 62


def _level(lo: Column, hi: Column) -> Column:
    """The exponent of the least power of two not below the length of [lo, hi]."""
    return F.least(F.lit(WIDEST), F.length(F.regexp_replace(F.bin(hi - lo), "^0+(?=.)", ""))).cast("int")


def _bucket(at: Column, level: Column) -> Column:
    return F.call_function("shiftright", at, level)


def _bounded(df: DataFrame, lo: Column, hi: Column, first: int, last: int) -> DataFrame:
    """df with __lo and __hi, whole numbers from first to last; intervals that end before they begin are none."""
    rows = df.withColumn("__lo", F.coalesce(lo.cast("bigint"), F.lit(first))).withColumn("__hi", F.coalesce(hi.cast("bigint"), F.lit(last)))
    return rows.where("__lo <= __hi")


def _placed(df: DataFrame, levels: list[int]) -> DataFrame:
    """df, once for each of its buckets at its own level and at the wider ones of the other side."""
    rows = df.withColumn("__level", _level(F.col("__lo"), F.col("__hi")))
    at = F.array_distinct(F.concat(F.array("__level"), F.filter(F.array(*(F.lit(x) for x in levels)), lambda x: x > F.col("__level"))))
    rows = rows.withColumn("__at", F.explode(at))
    both = F.array_distinct(F.array(_bucket(F.col("__lo"), F.col("__at")), _bucket(F.col("__hi"), F.col("__at"))))
    return rows.withColumn("__bucket", F.explode(both))


def overlap_join(a: DataFrame, b: DataFrame, *, a_from: Column, a_to: Column, b_from: Column, b_to: Column, on: list[str] | None = None) -> DataFrame:
    """Every pair of a row of a and a row of b whose intervals share a number: the columns of a, then those of b (but on).

    Intervals hold both ends, as whole numbers; a null end is open.  on: columns that must be equal too (nulls are not).
    An interval that ends before it begins meets nothing.  Columns of both sides need different names.
    """
    on = on or []
    ends = [d.agg(F.min(lo.cast("bigint")).alias("x"), F.max(hi.cast("bigint")).alias("y"), F.min(hi.cast("bigint")).alias("z"), F.max(lo.cast("bigint")).alias("w")).first() for d, lo, hi in ((a, a_from, a_to), (b, b_from, b_to))]
    known = [v for e in ends for v in e if v is not None] or [0]
    left = checkpoint(_bounded(a, a_from, a_to, min(known), max(known)))
    right = checkpoint(_bounded(b, b_from, b_to, min(known), max(known)).withColumnsRenamed({c: f"__on_{c}" for c in on}))
    levels = [sorted(r[0] for r in d.select(_level(F.col("__lo"), F.col("__hi"))).distinct().collect()) for d in (left, right)]  # at most 62
    # Written, so that the sides of the join hold no aggregate and hot buckets can be split.
    x = _placed(left, levels[1])
    y = _placed(right, levels[0]).withColumnsRenamed({c: f"{c}_b" for c in ("__lo", "__hi", "__level", "__at", "__bucket")})
    same = (F.col("__at") == F.col("__at_b")) & (F.col("__bucket") == F.col("__bucket_b"))
    for c in on:
        same = same & (F.col(c) == F.col(f"__on_{c}"))
    later = F.greatest("__lo", "__lo_b")
    once = (F.col("__at") == F.greatest("__level", "__level_b")) & (F.col("__bucket") == _bucket(later, F.col("__at")))
    pairs = x.join(y, same & once & (F.col("__lo") <= F.col("__hi_b")) & (F.col("__lo_b") <= F.col("__hi")))
    return pairs.select(*(f"`{c}`" for c in a.columns), *(f"`{c}`" for c in b.columns if c not in on))


def slices(jobs: DataFrame, cards: DataFrame, *, first: Column, last: Column, submit: str = "submit_time", end: str = "end_time") -> DataFrame:
    """The jobs of every card: submitted before its last instant and ended at or after its first; one row a job and card, all cards in one pass.

    first, last: timestamps of cards, null where a card is open; a job without an end counts as ended when it was submitted.
    """
    at = lambda c: F.unix_micros(c.cast("timestamp"))
    begun = at(F.col(submit))
    return overlap_join(jobs.where(F.col(submit).isNotNull()), cards, a_from=begun, a_to=F.greatest(begun, F.coalesce(at(F.col(end)), begun)), b_from=at(first), b_to=at(last) - 1)


def _parts(lo: str, hi: str) -> Column:
    """The buckets (level l, b) that make up [lo, hi] exactly: at most two a level."""
    bound = lambda at, l, up: F.call_function("shiftright", F.col(at) + (F.call_function("shiftleft", F.lit(1).cast("bigint"), l) - 1 if up else F.lit(0)), l)  # noqa: E731, E741
    none = F.array().cast("array<struct<l:int,b:bigint>>")

    def of(l: Column) -> Column:  # noqa: E741 - what [x, y) has at a level: the odd ends, as the rest goes into wider buckets
        x, y = bound(lo, l, True), bound(hi, l, False)
        one = lambda b: F.array(F.struct(l.cast("int").alias("l"), b.alias("b")))
        left = F.when((x < y) & (x % 2 != 0), one(x)).otherwise(none)
        return F.when(x < y, F.concat(left, F.when(y % 2 != 0, one(y - 1)).otherwise(none))).otherwise(none)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.length(F.bin(F.col(hi) - F.col(lo))) - 1), of))


def _bucketed(df: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """df, once for each of the buckets __l, __b of [lo, hi]; none if it is empty."""
    ends = df.withColumns({"__x": lo, "__y": hi + 1}).where("__x < __y")
    return ends.withColumn("__e", F.explode(_parts("__x", "__y"))).withColumns({"__l": F.col("__e.l"), "__b": F.col("__e.b")}).drop("__e", "__x", "__y")


def _above(df: DataFrame, at: Column, widest: int) -> DataFrame:
    """df, once for each bucket that holds the point, one a level."""
    every = F.sequence(F.lit(0), F.lit(widest))
    return df.withColumn("__l", F.explode(every)).withColumn("__b", F.call_function("shiftright", at, F.col("__l")))


def overlap_totals(a: DataFrame, b: DataFrame, totals: dict[str, tuple[Column, Callable[[Column], Column]]], *, a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> DataFrame:
    """b with totals over the rows of a whose intervals share a number with its own; rows of b that meet nothing are left out.

    totals: name -> (value of a row of a, aggregate), for aggregates of which totals of totals are taken, as F.sum, F.min and F.max.
    Ends are as in overlap_join().  A row of a that meets [s, t] either begins in it or is under way at s, not both.  For
    the first, rows are added up in the buckets of their beginnings, of which [s, t] is made up; for the second in the
    buckets that make up the rest of the interval, of which one a level holds s.  Equal intervals of a side are one row first, so the work
    follows the different intervals of both sides, never their pairs.
    """
    ends = [d.agg(*(f(c.cast("bigint")).alias(n) for n, f, c in (("x", F.min, lo), ("y", F.max, hi), ("z", F.min, hi), ("w", F.max, lo)))).first() for d, lo, hi in ((a, a_from, a_to), (b, b_from, b_to))]
    known = [v for e in ends for v in e if v is not None] or [0]
    base, last = min(known), max(known) - min(known)  # counted from the least, so that buckets are few and not negative
    widest = (last + 1).bit_length()
    again = [how(F.col(n)).alias(n) for n, (_, how) in totals.items()]

    def shifted(d: DataFrame, lo: Column, hi: Column) -> DataFrame:
        rows = d.withColumns({"__lo": F.coalesce(lo.cast("bigint") - base, F.lit(0)).cast("bigint"), "__hi": F.coalesce(hi.cast("bigint") - base, F.lit(last)).cast("bigint")})
        return rows.where("__lo <= __hi")

    rows = shifted(a.select(a_from.alias("__f"), a_to.alias("__t"), *(c.alias(n) for n, (c, _) in totals.items())), F.col("__f"), F.col("__t"))
    rows = checkpoint(rows.groupBy("__lo", "__hi").agg(*again))
    windows = checkpoint(shifted(b, b_from, b_to))
    asked = checkpoint(windows.select("__lo", "__hi").distinct())
    begun = _above(rows.groupBy("__lo").agg(*again), F.col("__lo"), widest).groupBy("__l", "__b").agg(*again)
    under_way = _bucketed(rows, F.col("__lo") + 1, F.col("__hi")).groupBy("__l", "__b").agg(*again)
    starts = asked.select("__lo").distinct()
    before = _above(starts, F.col("__lo"), widest).join(under_way, ["__l", "__b"]).groupBy("__lo").agg(*again)
    inside = _bucketed(asked, F.col("__lo"), F.col("__hi")).join(begun, ["__l", "__b"])
    parts = inside.select("__lo", "__hi", *totals).unionByName(asked.join(before, "__lo").select("__lo", "__hi", *totals))
    made = checkpoint(parts.groupBy("__lo", "__hi").agg(*again))
    return windows.join(made, ["__lo", "__hi"]).drop("__lo", "__hi")


def slice_totals(jobs: DataFrame, cards: DataFrame, totals: dict[str, tuple[Column, Callable[[Column], Column]]], *, first: Column, last: Column, submit: str = "submit_time", end: str = "end_time") -> DataFrame:
    """cards with totals over their jobs, see slices() and overlap_totals(); cards without jobs are left out."""
    at = lambda c: F.unix_micros(c.cast("timestamp"))
    begun = at(F.col(submit))
    return overlap_totals(jobs.where(F.col(submit).isNotNull()), cards, totals, a_from=begun, a_to=F.greatest(begun, F.coalesce(at(F.col(end)), begun)), b_from=at(first), b_to=at(last) - 1)
