"""Predictions from a user's own past jobs, and routing to groups of jobs."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..scratch import checkpoint
from .ranks import row_index

# Functions sent to Python workers carry their code along, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Names that sources give to the same thing.
FIELD_NAMES = {"user": ["user", "usr"], "name": ["name", "jnam"], "num_cores_req": ["processors_requested", "cnumr"], "num_nodes_req": ["nodes_requested", "nnumr"], "end_time": ["end_time", "edt"]}


def first_present(df: DataFrame, field: str) -> Column:
    """The first of a field's names that has a value."""
    have = [F.col(c) for c in FIELD_NAMES.get(field, [field]) if c in df.columns]
    return F.coalesce(*have) if have else F.lit(None)


#: Jobs of one piece of the history.
PIECE = 100_000


def past(jobs: DataFrame, user: str, order: list, theta: int, piece: int = PIECE) -> tuple[DataFrame, WindowSpec]:
    """(jobs in pieces, the window of the theta jobs of the same user before each); current() takes the copies out again.

    A user with at most piece jobs is one piece.  The jobs of the others are numbered by user and order
    and cut into pieces of equal size, so a user with many jobs is spread over many tasks; the last
    theta jobs of a piece are copied to the next one, where they serve as history only.  order names each user's jobs in one way.
    """
    window = Window.partitionBy("__piece", user).orderBy("__i", *order).rowsBetween(-theta, -1)
    marks = {"__i": F.lit(0).cast("bigint"), "__piece": F.lit(-1).cast("bigint"), "__copy": F.lit(False)}
    busy = checkpoint(jobs.groupBy(F.col(user).alias("__busy")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > piece).select("__busy"))
    if busy.isEmpty():
        return jobs.withColumns(marks), window
    same = jobs[user].eqNullSafe(busy["__busy"])
    few = F.broadcast(busy)  # a row for each piece of jobs at most
    numbered = row_index(jobs.join(few, same, "left_semi"), [user, *order], "__i").withColumn("__piece", F.floor(F.col("__i") / piece)).withColumn("__copy", F.lit(False))
    ahead = numbered.where(F.col("__i") % piece >= piece - theta).withColumn("__piece", F.col("__piece") + 1).withColumn("__copy", F.lit(True))
    return jobs.join(few, same, "left_anti").withColumns(marks).unionByName(numbered.union(ahead)), window


def current(held: DataFrame) -> DataFrame:
    return held.where("not __copy").drop("__i", "__piece", "__copy")


def context_mean(jobs: DataFrame, *, user: str, order: list[str], target: str, theta: int = 50, piece: int = PIECE) -> DataFrame:
    """jobs with n_context and y_pred, the exact mean of the target over the context."""
    held, w = past(jobs, user, order, theta, piece)
    total = F.sum(F.col(target).cast("decimal(28,6)")).over(w)
    n = F.count(target).over(w)
    return current(held.withColumn("n_context", n).withColumn("y_pred", total.cast("double") / F.nullif(n, F.lit(0))))


def context_knn(jobs: DataFrame, *, user: str, order: list[str], key: str, feature: str, target: str, theta: int = 50, k: int = 5, piece: int = PIECE) -> DataFrame:
    """jobs with y_pred: the mean target of the k jobs of the context with the nearest feature; ties by key."""
    held, w = past(jobs, user, order, theta, piece)
    context = F.collect_list(F.struct(F.col(feature).alias("x"), F.col(key).alias("id"), F.col(target).alias("y"))).over(w)
    near = F.slice(F.array_sort(F.transform("__c", lambda c: F.struct(F.abs(c["x"] - F.col(feature)).alias("d"), c["id"].alias("id"), c["y"].alias("y")))), 1, k)
    total = F.aggregate(near, F.lit(0).cast("decimal(28,6)"), lambda a, c: (a + c["y"].cast("decimal(20,6)")).cast("decimal(28,6)"))
    return current(held.withColumn("__c", context)).withColumn("y_pred", F.when(F.size("__c") > 0, total.cast("double") / F.least(F.lit(k), F.size("__c")))).drop("__c")


def context_nearest(jobs: DataFrame, *, user: str, order: list, name: Column, numbers: list[Column], target: str, theta: int = 50, k: int = 5, piece: int = PIECE) -> DataFrame:
    """jobs with n_context and y_pred: the mean target of the k jobs of the context nearest by name and numbers.

    The name counts as its place among the sorted names of the context, -1 if it is not there; missing
    numbers count as 0; the distance is Euclidean, and of equally near jobs the latest go first.  No
    prediction below k jobs.  The order may hold Columns.  Spark sorts the histories; a task goes through
    its own batch by batch and keeps the theta jobs before a batch.
    """
    own = {"__own_name": F.coalesce(name.cast("string"), F.lit("")), "__own_y": F.col(target).cast("double")} | {f"__own_x{i}": F.coalesce(n.cast("string").try_cast("double"), F.lit(0.0)) for i, n in enumerate(numbers)}
    held, _ = past(jobs.withColumns(own), user, order, theta, piece)
    keys, features = ["__piece", user], [f"__own_x{i}" for i in range(len(numbers))]
    ordered = held.repartition(*keys).sortWithinPartitions(*keys, "__i", *order)
    schema = StructType([*held.drop(*own).schema.fields, StructField("n_context", IntegerType()), StructField("y_pred", DoubleType())])
    needed, kept = list(dict.fromkeys([*keys, *own])), schema.names[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            seen = t.select(needed) if before is None else pa.concat_tables([before, t.select(needed)])
            seen, first = seen.combine_chunks(), seen.num_rows - t.num_rows
            before = seen.slice(max(0, seen.num_rows - theta))
            n, y = _nearest_before(seen, first, keys, features, theta, k)
            yield from t.select(kept).append_column("n_context", pa.array(n, pa.int32())).append_column("y_pred", y).combine_chunks().to_batches()

    return current(ordered.mapInArrow(run, schema))


def _nearest_before(t: pa.Table, first: int, keys: list[str], features: list[str], theta: int, k: int, step: int = 2048) -> tuple[np.ndarray, pa.Array]:
    """(size of the context, mean of its k nearest) of the sorted rows from first on; the rows before are context only."""
    code = lambda c: pc.dictionary_encode(t.column(c), null_encoding="encode").combine_chunks()
    new = np.r_[True, np.zeros(t.num_rows - 1, dtype=bool)]
    for c in keys:
        at = code(c).indices.to_numpy()
        new[1:] |= at[1:] != at[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(t.num_rows), 0))
    named = code("__own_name")
    words = [w.encode() for w in named.dictionary.to_pylist()]  # sorted as Spark sorts, by bytes
    rank = np.empty(len(words), dtype=np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    names = rank[named.indices.to_numpy()]
    x = [t.column(c).to_numpy() for c in features]
    told = ~t.column("__own_y").is_null().to_numpy()
    y = pc.fill_null(t.column("__own_y"), 0.0).to_numpy()
    size, out, known = [], [], []
    for lo in range(first, t.num_rows, step):
        rows = np.arange(lo, min(lo + step, t.num_rows))
        at = rows[:, None] - np.arange(1, theta + 1)  # latest first
        there = at >= start[rows][:, None]
        at = np.maximum(at, 0)
        theirs = np.where(there, names[at], len(words))
        order = np.argsort(theirs, axis=1)
        placed = np.take_along_axis(theirs, order, axis=1)
        fresh = np.c_[np.ones(len(rows), dtype=bool), placed[:, 1:] != placed[:, :-1]]
        place = np.empty_like(theirs)
        np.put_along_axis(place, order, np.cumsum(fresh, axis=1) - 1, axis=1)
        mine = names[rows][:, None]
        mine = np.where((theirs == mine).any(axis=1), (fresh & (placed < mine)).sum(axis=1), -1)
        away = np.zeros(at.shape)
        for v in x:
            away += (v[at] - v[rows][:, None]) ** 2
        away = (place - mine[:, None]).astype(float) ** 2 + away
        # Rows that are not there come last, behind distances that are no number too.
        near = np.lexsort((away, ~there), axis=1)[:, :k]
        got = np.take_along_axis(at, near, axis=1)
        total = np.zeros(len(rows))
        for i in range(got.shape[1]):
            total = total + y[got[:, i]]
        n = there.sum(axis=1)
        size.append(n)
        out.append(total / k)
        known.append((n >= k) & told[got].all(axis=1))
    return np.concatenate(size), pa.array(np.concatenate(out), pa.float64(), mask=~np.concatenate(known))


def wallclock_edges(rows: DataFrame, group: str, value: str, *, bins: int = 5, least_share: float = 0.02, weight: Column | None = None) -> DataFrame:
    """group, edges: the most requested values, if two have the share, else quantiles; the last edge is infinite.

    Quantiles come from the counts of the different values of a group, of which requested times have few.
    """
    counts = rows.where(F.col(value) > 0).groupBy(group, value).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), value))).withColumn("total", F.sum("n").over(Window.partitionBy(group)))
    modes = ranked.where((F.col("r") < bins) & (F.col("n") >= least_share * F.col("total"))).groupBy(group).agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("modes"))
    cuts = F.array(*(F.lit((i + 1) / bins) for i in range(bins - 1)))
    quantiles = counts.groupBy(group).agg(F.array_distinct(F.percentile(value, cuts, F.col("n"))).alias("q"))
    edges = F.concat(F.when(F.size("modes") >= 2, F.col("modes")).otherwise(F.col("q")), F.array(F.lit(float("inf"))))
    return quantiles.join(modes, group, "left").select(group, edges.alias("edges"))


def bin_of(value: Column, edges: Column) -> Column:
    """The first bin whose edge is not below the value; -1 for nothing or no positive number."""
    at = F.array_position(F.transform(edges, lambda e: value <= e), F.lit(True)).cast("int") - 1
    return F.when(value > 0, F.coalesce(F.when(at >= 0, at), F.size(edges) - 1)).otherwise(-1)


def power_users(rows: DataFrame, group: str, user: str, quantile: float = 0.99, *, weight: Column | None = None) -> DataFrame:
    """group, user, n: the users whose number of jobs reaches the quantile of their group.

    The quantile's buffer holds different numbers of jobs, of which n jobs give at most sqrt(2 n).
    """
    named = rows.where(F.col(user).isNotNull() & (F.col(user).cast("string") != ""))
    counts = named.groupBy(group, user).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    cut = counts.groupBy(group).agg(F.percentile("n", F.lit(quantile)).alias("cut"))
    return counts.join(cut, group).where(F.col("n") >= F.col("cut")).select(group, user, "n")


def placed(train: DataFrame, test: DataFrame, *, group: str, user: str, value: str, power: bool = True) -> tuple[DataFrame, DataFrame]:
    """Both with __key (the user, if a power user, else *) and __bin of the requested value; from the training rows alone."""
    edges = wallclock_edges(train, group, value)
    users = power_users(train, group, user).select(F.col(group).alias("__g"), F.col(user).alias("__u")).withColumn("__power", F.lit(True))

    def place(rows: DataFrame) -> DataFrame:
        out = rows.join(F.broadcast(edges), group, "left")  # a row a group
        if not power:
            return out.withColumn("__key", F.lit("*")).withColumn("__bin", bin_of(F.col(value), F.col("edges"))).drop("edges")
        out = out.join(users, (F.col(group) == F.col("__g")) & (F.col(user) == F.col("__u")), "left")
        key = F.when(F.col("__power"), F.col(user).cast("string")).otherwise("*")
        return out.withColumn("__key", key).withColumn("__bin", bin_of(F.col(value), F.col("edges"))).drop("edges", "__g", "__u", "__power")

    return place(train), place(test)


def routed_means(train: DataFrame, test: DataFrame, *, group: str, user: str, value: str, target: str, least: int = 100) -> DataFrame:
    """test with route and y_pred: the mean of the expert of (user or none, bin), else the group's mean.

    Routes come from training rows only; experts below least rows don't exist.
    """
    # Everything that is learned comes from the sums of (group, user, value), so training rows are added up where they are read.
    parts = train.groupBy(group, F.col(user).alias("__user"), F.col(value).alias("__value")).agg(F.count(F.lit(1)).alias("__n"), F.count(target).alias("__known"), F.sum(F.col(target).cast("decimal(28,6)")).alias("__sum"))
    parts = checkpoint(parts)
    mean = F.sum("__sum").cast("double") / F.sum("__known")
    edges = checkpoint(wallclock_edges(parts, group, "__value", weight=F.col("__n")))
    users = checkpoint(power_users(parts, group, "__user", weight=F.col("__n")).select(group, "__user", F.lit(True).alias("__power")))
    whole = parts.groupBy(group).agg(mean.alias("__all"))
    routed = parts.join(users, [group, "__user"], "left").join(F.broadcast(edges), group, "left")  # a row a group
    routed = routed.withColumn("__bin", bin_of(F.col("__value"), F.col("edges"))).withColumn("__own", F.when(F.col("__power"), F.col("__user")))
    experts = checkpoint(routed.groupBy(group, "__own", "__bin").agg(F.sum("__n").alias("__n"), mean.alias("__mean")).where(F.col("__n") >= least))
    by_bin = lambda name: F.map_from_entries(F.collect_list(F.struct("__bin", F.struct("__mean")))).alias(name)
    # A row a group for the pooled experts, a row a power user for the others: no key of the join is shared by more rows than a user has.
    pooled = experts.where("__own is null").groupBy(group).agg(by_bin("__pooled"))
    own = users.join(experts.where("__own is not null").groupBy(group, F.col("__own").alias("__user")).agg(by_bin("__experts")), [group, "__user"], "left")
    own = checkpoint(own.select(F.col(group).alias("__g"), F.col("__user").alias("__u"), "__power", "__experts"))
    joined = test.join(own, (F.col(group) == F.col("__g")) & (F.col(user) == F.col("__u")), "left")
    joined = joined.join(F.broadcast(edges), group, "left").join(F.broadcast(pooled), group, "left").join(F.broadcast(whole), group)
    found = F.get(F.filter(F.map_entries(F.when(F.col("__power"), F.col("__experts")).otherwise(F.col("__pooled"))), lambda e: e["key"] == F.col("__at")), F.lit(0))
    joined = joined.withColumn("__at", bin_of(F.col(value), F.col("edges"))).withColumn("__mean", found["value"]["__mean"])
    key = F.when(F.col("__power"), F.col(user).cast("string")).otherwise("*")
    out = joined.withColumn("route", F.when(F.col("__mean").isNotNull(), "expert").otherwise("fallback")).withColumn("y_pred", F.coalesce("__mean", "__all")).withColumn("__key", key).withColumn("__bin", F.col("__at"))
    return out.drop("__mean", "__all", "__g", "__u", "__power", "__experts", "__pooled", "__at", "edges")
