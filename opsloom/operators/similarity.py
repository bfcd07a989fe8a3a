"""Nearest neighbours, dense and sparse, and texts encoded once."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from ..scratch import checkpoint
from .models import ALLOWED
from .ranks import row_index

# Functions sent to Python workers carry their code along, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 1024


def _blocks(df: DataFrame, group: str, block: int) -> tuple[DataFrame, DataFrame]:
    """(group, __b and rows, the rows sorted by id and gathered into blocks of about that many; group, __n: its blocks)."""
    sized = df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__n"))
    placed = df.join(sized, group).withColumn("__b", F.pmod(F.xxhash64("id"), F.col("__n")).cast("int"))
    fields = [c for c in df.columns if c not in (group, "id")]
    return placed.groupBy(group, "__b").agg(F.sort_array(F.collect_list(F.struct("id", *fields))).alias("rows")), sized


def _pairs(test: DataFrame, train: DataFrame, group: str, block: int) -> DataFrame:
    """group, a, b: every block of test rows with every block of training rows of its group.

    Test blocks are copied once for each training block and meet it under (group, block), so the pairs
    of a group are spread over as many tasks as it has training blocks.
    """
    a, _ = _blocks(test, group, block)
    b, sized = _blocks(train, group, block)
    copies = a.join(sized, group).select(group, F.col("rows").alias("a"), F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__b"))
    return copies.join(b.withColumnRenamed("rows", "b"), [group, "__b"]).select(group, "a", "b")


def _best(similar: Callable[[pa.StructArray, pa.StructArray], np.ndarray], schema: StructType, k: int, least: float):
    """A function of batches of pairs that leaves the k best of each query, similarities of least or more."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                left, right = (batch.column(c).slice(r, 1).flatten() for c in (1, 2))
                sims = np.round(similar(left, right), 9)
                # ids are sorted, so a stable sort settles ties by id.
                top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                best = np.take_along_axis(sims, top, axis=1)
                q, place = np.nonzero(best >= least)
                at = top[q, place]
                values = [
                    pa.array(batch.column(0).slice(r, 1).to_pylist() * len(q), arrow.field(0).type), left.field("id").take(pa.array(q)), right.field("id").take(pa.array(at)),
                    pa.array(best[q, place]), right.field("y").take(pa.array(at)),
                ]
                yield pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(values, arrow)], schema=arrow)

    return run


def _nearest(test: DataFrame, train: DataFrame, group: str, k: int, similar: Callable, least: float, block: int = BLOCK) -> DataFrame:
    """group, query, neighbour, similarity, value, rank; test: group, id and fields; train: also y."""
    kinds = {f.name: f.dataType for f in test.schema}
    schema = StructType([StructField(group, kinds[group]), StructField("query", kinds["id"]), StructField("neighbour", kinds["id"]), StructField("similarity", DoubleType()), StructField("value", DoubleType())])
    near = checkpoint(_pairs(test, train, group, block).mapInArrow(_best(similar, schema, k, least), schema), batch_rows=16)
    rank = F.row_number().over(Window.partitionBy(group, "query").orderBy(F.desc("similarity"), "neighbour"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


#: Vectors that rows are ordered by and blocks are bounded by; the driver and each task hold them.
PIVOTS = 48
#: Blocks whose bounds are compared at once, and training blocks that each test block meets first.
CHUNK, FIRST = 512, 2
#: Bytes of single-precision vectors in a pack of blocks; a task holds two packs.
PACK = 4 << 20
#: Bounds are wider than the rounding of angles and similarities.
SLACK = 1e-6


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(n == 0, 1, n)


def _matrix(v: pa.Array, n: int) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(n, -1)


def _vectors(df: DataFrame, column: str) -> Column:
    """Vectors in the precision that they have, as they take less room; tasks calculate in double."""
    return F.col(column).cast("array<float>" if dict(df.dtypes).get(column) == "array<float>" else "array<double>").alias("v")


def _pivots(rows: DataFrame) -> np.ndarray:
    """The vectors of PIVOTS rows of least hash, scaled to length 1."""
    found = rows.select("v", F.xxhash64("v").alias("h")).distinct().orderBy("h", "v").limit(PIVOTS).collect()
    return _unit(np.array([r["v"] for r in found], dtype=float)) if found else np.zeros((0, 0))


def _angles(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(v) @ pivots.T, -1, 1))


def _by_cell(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows with the nearest pivot __cell and the angle __far to it."""
    schema = StructType([*rows.schema.fields, StructField("__cell", IntegerType()), StructField("__far", DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a = _angles(_matrix(batch.column("v"), batch.num_rows), pivots)
                cell = a.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(a[np.arange(len(a)), cell])], schema=arrow)

    return rows.mapInArrow(run, schema)


def _near_blocks(rows: DataFrame, order: list[str], pivots: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(g, block and rows; g, chunk and the bounds of its blocks), both written.

    rows: g, id, v, lo, hi (windows) and more.  Rows are numbered in the order (then by cell and angle) and cut
    into blocks of BLOCK, so a block holds near rows; a cell of BLOCK / 8 rows or more has blocks of its own.  A
    block's bounds are its least and largest angle to each pivot and its first and last window.
    """
    keys = list(dict.fromkeys(["g", *order, "__cell"]))
    numbered = checkpoint(row_index(_by_cell(rows, pivots), [*order, "__cell", "__far", "id"], "__i").drop("__far"))
    cells = numbered.groupBy(*keys).agg(F.min("__i").alias("__first"), (F.count(F.lit(1)) >= BLOCK // 8).alias("__own"))
    placed = numbered.join(checkpoint(cells), keys).drop("__cell")
    # A block is named by the number of its first row, twice, and one more in a cell of its own.
    own = 2 * (F.col("__first") + F.floor((F.col("__i") - F.col("__first")) / BLOCK) * BLOCK) + 1
    block = F.when(F.col("__own"), own).otherwise(F.floor(F.col("__i") / BLOCK) * (2 * BLOCK)).cast("bigint")
    fields = [c for c in rows.columns if c not in ("g", "id")]
    blocks = checkpoint(placed.groupBy("g", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("id", *fields))).alias("rows")))
    schema = StructType([blocks.schema["g"], blocks.schema["block"], *(StructField(c, BinaryType()) for c in ("near", "far")), StructField("from", IntegerType()), StructField("to", IntegerType())])
    arrow = to_arrow_schema(schema)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                own = batch.column("rows").slice(r, 1).flatten()
                a = _angles(_matrix(own.field("v"), len(own)), pivots)
                lo, hi = (own.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi"))
                values = [batch.column("g")[r].as_py(), batch.column("block")[r].as_py(), a.min(axis=0).tobytes(), a.max(axis=0).tobytes(), int(lo.min()), int(hi.max())]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow)], schema=arrow)

    told = checkpoint(blocks.mapInArrow(bounds, schema), batch_rows=16)
    chunks = told.groupBy("g", F.floor(F.col("block") / (2 * BLOCK * CHUNK)).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("block", "near", "far", "from", "to"))).alias("bounds"))
    return blocks, checkpoint(chunks)


def _meetings(a: DataFrame, b: DataFrame, choose: Callable, more: str = "") -> DataFrame:
    """What choose() picks of the pairs of blocks of each group: g, a, b (and more); chunks of bounds meet, not blocks."""
    of_group = b.select("g", "chunk").groupBy("g").agg(F.collect_list("chunk").alias("chunks"))
    copies = a.join(of_group, "g").select("g", F.col("bounds").alias("a"), F.explode("chunks").alias("chunk"))
    pairs = copies.join(b.withColumnRenamed("bounds", "b"), ["g", "chunk"]).select("g", "a", "b")
    schema = f"g {dict(a.dtypes)['g']}, a bigint, b bigint{more}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                left, right = (batch.column(c).slice(r, 1).flatten() for c in (1, 2))
                i, j, *others = choose(left, right)
                g = pa.array(batch.column(0).slice(r, 1).to_pylist() * len(i), batch.column(0).type)
                yield pa.RecordBatch.from_arrays([g, left.field("block").take(pa.array(i)), right.field("block").take(pa.array(j)), *map(pa.array, others)], names=["g", "a", "b", *(c.split()[0] for c in more.split(", ")[1:])])

    return checkpoint(pairs.mapInArrow(run, schema), batch_rows=4)


def _bounded(left: pa.StructArray, right: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least angle between rows of two blocks, how far their middles lie apart, whether their windows touch), each block against each."""
    angles = {}
    for side, rows in (("a", left), ("b", right)):
        angles[side] = [np.array([np.frombuffer(x, dtype=float) for x in rows.field(c).to_pylist()]) for c in ("near", "far")]
    (an, af), (bn, bf) = angles["a"], angles["b"]
    apart, middle = np.zeros((len(left), len(right))), np.zeros((len(left), len(right)))
    for p in range(an.shape[1]):
        apart = np.maximum(apart, np.maximum(an[:, p, None] - bf[None, :, p], bn[None, :, p] - af[:, p, None]))
        middle += np.abs((an[:, p] + af[:, p])[:, None] - (bn[:, p] + bf[:, p])[None, :])
    first, last = (left.field(c).to_numpy()[:, None] for c in ("from", "to"))
    touch = (last >= right.field("from").to_numpy()[None, :]) & (first <= right.field("to").to_numpy()[None, :])
    return apart, middle, touch


def _first_blocks(left: pa.StructArray, right: pa.StructArray):
    """The FIRST training blocks that lie nearest to each test block."""
    apart, middle, touch = _bounded(left, right)
    order = np.lexsort((middle, apart, ~touch), axis=1)[:, :FIRST]
    i, k = np.nonzero(np.take_along_axis(touch, order, axis=1))
    j = order[i, k]
    return i, j, apart[i, j], middle[i, j]


def _further_blocks(left: pa.StructArray, right: pa.StructArray):
    """The training blocks in which a test block may find rows at least as near as those it has."""
    apart, _, touch = _bounded(left, right)
    least = left.field("least").to_numpy()[:, None]
    return np.nonzero(touch & (np.cos(np.maximum(apart - SLACK, 0)) >= least - SLACK))


def _best_of_packs(similar: Callable[[pa.StructArray, pa.StructArray], np.ndarray], schema: StructType, k: int, least: float):
    """A function of batches of g, the pairs of blocks and the blocks of two packs; it leaves the k best of each query, similarities of least or more."""
    arrow = to_arrow_schema(schema)

    def unpacked(blocks: pa.StructArray) -> tuple[pa.StructArray, dict[int, tuple[int, int]]]:
        """(the rows of all blocks, block -> its first row and number of rows)."""
        sizes = blocks.field("rows").value_lengths().to_pylist()
        firsts = np.cumsum([0, *sizes]).tolist()
        return blocks.field("rows").flatten(), {b: (f, n) for b, f, n in zip(blocks.field("block").to_pylist(), firsts, sizes)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                pairs, lefts, rights = (batch.column(c).slice(r, 1).flatten() for c in (1, 2, 3))
                (left, in_left), (right, in_right) = unpacked(lefts), unpacked(rights)
                by_id = np.empty(len(right), dtype=np.int64)
                by_id[pc.sort_indices(right.field("id")).to_numpy()] = np.arange(len(right))
                todo: dict[int, list[int]] = {}
                for a, b in zip(pairs.field("a").to_pylist(), pairs.field("b").to_pylist()):
                    todo.setdefault(a, []).append(b)
                for a, others in todo.items():
                    first, n = in_left[a]
                    own, cut = left.slice(first, n), np.full(n, least)
                    q, at, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
                    for b in others:
                        start, m = in_right[b]
                        sims = np.round(similar(own, right.slice(start, m)), 9)
                        # What is below the k-th best of the block, or of those before, is not among the k best.
                        floor = np.maximum(cut, np.partition(sims, m - k, axis=1)[:, m - k]) if m > k else cut
                        fits = sims >= floor[:, None]
                        if np.count_nonzero(fits) > 4 * k * n:  # many ties; ids are sorted, so a stable sort settles them
                            top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                            i, place = np.nonzero(np.take_along_axis(fits, top, axis=1))
                            j = top[i, place]
                        else:
                            i, j = np.nonzero(fits)
                        q, at, best = np.r_[q, i], np.r_[at, start + j], np.r_[best, sims[i, j]]
                        order = np.lexsort((by_id[at], -best, q))
                        place = np.arange(len(order)) - np.searchsorted(q[order], q[order], side="left")
                        order, place = order[place < k], place[place < k]
                        q, at, best = q[order], at[order], best[order]
                        full = place == k - 1
                        cut[q[full]] = best[full]
                    ids = left.field("id").take(pa.array(first + q)), right.field("id").take(pa.array(at))
                    values = [pa.array(batch.column(0).slice(r, 1).to_pylist() * len(q), arrow.field(0).type), *ids, pa.array(best), right.field("y").take(pa.array(at))]
                    yield pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(values, arrow)], schema=arrow)

    return run


def _multiplied(pairs: DataFrame, a: DataFrame, b: DataFrame, schema: StructType, k: int, width: int = 1) -> DataFrame:
    """The k best of each query among the rows of the pairs of blocks, width: the length of vectors.

    Blocks of neighbouring rows are a pack of about PACK bytes.  A block is copied once for each pack that it has to meet, not for
    each block, and a pair of packs leaves k candidates a query.
    """
    rows = max(BLOCK, PACK // (4 * max(1, width)))
    pack = {side: F.floor(F.col(side) / (2 * rows)).cast("bigint") for side in ("a", "b")}
    named = pairs.select("g", "a", "b", pack["a"].alias("pa"), pack["b"].alias("pb"))
    keys = ["g", "pa", "pb"]
    out = named.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("pairs"))
    for side, blocks in (("a", a), ("b", b)):
        met = named.select(*keys, F.col(side).alias("block")).distinct().join(blocks, ["g", "block"])
        out = out.join(met.groupBy(*keys).agg(F.collect_list(F.struct("block", "rows")).alias(f"of_{side}")), keys)
    return checkpoint(out.select("g", "pairs", "of_a", "of_b").mapInArrow(_best_of_packs(_cosines_in_windows, schema, k, -2.0), schema), batch_rows=1)


def _nearest_in_windows(test: DataFrame, train: DataFrame, order_test: list[str], order_train: list[str], k: int) -> DataFrame:
    """g, query, neighbour, similarity, value, rank of rows (g, id, v, lo, hi) and (g, id, v, lo, hi, y): the exact k best by cosine.

    Rows at angles s and t to a pivot lie at least |s - t| apart, so bounds of blocks say how near their
    rows can be.  Each test block first meets the FIRST blocks that lie nearest; the k-th best that its
    rows find there bounds which other blocks it has to meet.
    """
    pivots = _pivots(train)
    kinds = {f.name: f.dataType for f in test.schema}
    schema = StructType([StructField("g", kinds["g"]), StructField("query", kinds["id"]), StructField("neighbour", kinds["id"]), StructField("similarity", DoubleType()), StructField("value", DoubleType())])
    if not len(pivots):
        return train.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0))
    (a, bounds_a), (b, bounds_b) = _near_blocks(test, order_test, pivots), _near_blocks(train, order_train, pivots)
    near = _meetings(bounds_a, bounds_b, _first_blocks, ", apart double, middle double")
    place = F.row_number().over(Window.partitionBy("g", "a").orderBy("apart", "middle", "b"))
    first = checkpoint(near.withColumn("r", place).where(F.col("r") <= FIRST).select("g", "a", "b"))
    found = _multiplied(first, a, b, schema, k, pivots.shape[1])
    # The k-th best of each query; of a block the least of them, and nothing if a row has fewer than k.
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("g", "query").orderBy(F.desc("similarity"), "neighbour"))).where(F.col("r") == k)
    members = a.select("g", "block", F.explode("rows.id").alias("query"))
    least = members.join(ranked.select("g", "query", "similarity"), ["g", "query"], "left").groupBy("g", "block").agg(F.min(F.coalesce("similarity", F.lit(-2.0))).alias("least"))
    told = bounds_a.select("g", "chunk", F.explode("bounds").alias("s")).select("g", "chunk", "s.*").join(checkpoint(least), ["g", "block"])
    told = checkpoint(told.groupBy("g", "chunk").agg(F.sort_array(F.collect_list(F.struct("block", "near", "far", "from", "to", "least"))).alias("bounds")))
    further = checkpoint(_meetings(told, bounds_b, _further_blocks).join(first, ["g", "a", "b"], "left_anti"))
    every = found.unionByName(_multiplied(further, a, b, schema, k, pivots.shape[1]))
    rank = F.row_number().over(Window.partitionBy("g", "query").orderBy(F.desc("similarity"), "neighbour"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k)


def dense_neighbours(test: DataFrame, train: DataFrame, *, key: str, vector: str, value: str, group: str, k: int = 5) -> DataFrame:
    """group, query, neighbour, similarity, value, rank: the k nearest training rows of each test row by cosine.

    Test and training rows of a group meet block by block, each pair of blocks as one matrix product; packs of
    blocks leave k candidates a query, so no group is gathered in one task and pairs are never rows.
    Blocks that provably hold no nearer row than those found are left out.  Zero vectors have similarity 0.  Ties go by id.
    """
    fields = lambda df: [F.col(group).alias("g"), F.col(key).alias("id"), _vectors(df, vector), F.lit(0).alias("lo"), F.lit(0).alias("hi")]
    out = _nearest_in_windows(test.select(*fields(test)), train.select(*fields(train), F.col(value).cast("double").alias("y")), ["g"], ["g"], k)
    return out.withColumnRenamed("g", group)


def _cosines_in_windows(left: pa.StructArray, right: pa.StructArray) -> np.ndarray:
    """Cosines, and -3 where the row on the right does not train the window of the row on the left."""
    a, b = (_unit(_matrix(x.field("v"), len(x))) for x in (left, right))
    w = left.field("lo").to_numpy(zero_copy_only=False)[:, None]
    lo, hi = (right.field(c).to_numpy(zero_copy_only=False)[None, :] for c in ("lo", "hi"))
    return np.where((lo <= w) & (w <= hi), a @ b.T, -3.0)


def windowed_neighbours(test: DataFrame, train: DataFrame, *, key: str, vector: str, value: str, window: str, lo: Column, hi: Column, k: int = 5) -> DataFrame:
    """window, query, neighbour, similarity, value, rank: as dense_neighbours with windows as groups, without a copy of a training row for each window.

    A training row says which windows it trains, from lo to hi.  Rows are put into blocks in the order
    of their windows; only blocks whose windows touch meet, and inside the product each pair is checked.
    """
    v = lambda df: [F.lit(0).alias("g"), F.col(key).alias("id"), _vectors(df, vector)]
    asked = test.select(*v(test), F.col(window).cast("int").alias("lo"), F.col(window).cast("int").alias("hi"))
    known = train.select(*v(train), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), F.col(value).cast("double").alias("y")).where("lo <= hi")
    best = _nearest_in_windows(asked, known, ["lo"], ["lo", "hi"], k).drop("g")
    return best.join(test.select(F.col(key).alias("query"), F.col(window)), "query").select(window, "query", "neighbour", "similarity", "value", "rank")


def weighted_prediction(neighbours: DataFrame, group: str, *, weighting: str = "similarity") -> DataFrame:
    """group, query, y_pred: the mean of the neighbours' values, weighted by similarity above 0; uniform if all are 0."""
    w = F.greatest(F.col("similarity"), F.lit(0.0)) if weighting == "similarity" else F.lit(1.0)
    out = neighbours.groupBy(group, "query").agg(F.sum(w).alias("w"), F.sum(w * F.col("value")).alias("wy"), F.avg("value").alias("mean"))
    return out.select(group, "query", F.when(F.col("w") > 0, F.col("wy") / F.nullif(F.col("w"), F.lit(0.0))).otherwise(F.col("mean")).alias("y_pred"))


def term_counts(df: DataFrame, key: str, text: Column, pattern: str = "[^a-z0-9_]+", least: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, term, tf of lower-cased words of at least two characters, and the columns to keep."""
    words = df.select(F.col(key).alias("key"), *keep, F.explode(F.split(F.lower(text), pattern)).alias("term")).where(F.length("term") >= least)
    return words.groupBy("key", *keep, "term").agg(F.count(F.lit(1)).alias("tf"))


def _overlaps(left: pa.StructArray, right: pa.StructArray) -> np.ndarray:
    """Sums of products of the weights of common terms, of rows with terms t and weights w.

    Terms that many rows of the block have go by a dense product, the others by their pairs of rows.
    """

    def flat(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = rows.field("t")
        return np.repeat(np.arange(len(rows)), t.value_lengths().to_numpy(zero_copy_only=False)), t.flatten().to_numpy(), rows.field("w").flatten().to_numpy()

    (ra, ta, wa), (rb, tb, wb) = flat(left), flat(right)
    na, nb = len(left), len(right)
    terms, tb = np.unique(tb, return_inverse=True)
    if not len(terms):
        return np.zeros((na, nb))
    at = np.minimum(np.searchsorted(terms, ta), len(terms) - 1)
    known = terms[at] == ta
    ra, ta, wa = ra[known], at[known], wa[known]
    times = np.bincount(tb, minlength=len(terms))
    common = np.flatnonzero(times > nb // 16)
    out = np.zeros((na, nb))
    for lo in range(0, len(common), 2048):
        place = np.full(len(terms), -1)
        place[common[lo : lo + 2048]] = np.arange(len(common[lo : lo + 2048]))
        a, b = np.zeros((na, 2048)), np.zeros((nb, 2048))
        for m, r, t, w in ((a, ra, ta, wa), (b, rb, tb, wb)):
            here = place[t] >= 0
            m[r[here], place[t[here]]] = w[here]
        out += a @ b.T
    rare = times[ta] <= nb // 16
    ra, ta, wa = ra[rare], ta[rare], wa[rare]
    order = np.argsort(tb, kind="stable")
    rb, wb, first = rb[order], wb[order], np.cumsum(times) - times
    for lo in range(0, len(ra), 100_000):
        r, t, w = ra[lo : lo + 100_000], ta[lo : lo + 100_000], wa[lo : lo + 100_000]
        n = times[t]
        b = np.repeat(first[t], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out += np.bincount(np.repeat(r, n) * nb + rb[b], np.repeat(w, n) * wb[b], na * nb).reshape(na, nb)
    return out


def tfidf_neighbours(train: DataFrame, test: DataFrame, *, k: int = 5, group: str | None = None, value: str | None = None) -> DataFrame:
    """query, neighbour, similarity, value, rank (and group) by cosine of TF-IDF with smoothed idf, of (key, term, tf) tables.

    Only pairs with a common term count.  With a group, each has its own frequencies.  value: a column
    of train that each neighbour brings along, the same for all terms of a key.  Different vectors meet in blocks
    that are sparse matrices, so neither pairs nor the rows of a frequent term are ever gathered.  Rows with equal
    vectors meet once: a class has its least id and its k first members, as the k best rows lie in the k best classes.
    """
    by = [group] if group else []
    g = group or "__g"
    counted = train.groupBy(*by, "key").agg(F.lit(1).alias("one")).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    freq = train.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"))
    sized = freq.join(F.broadcast(counted), by) if by else freq.join(F.broadcast(counted))  # a row a group
    idf = sized.select(*by, "term", (F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))

    def weighed(t: DataFrame, extra: list[str]) -> DataFrame:
        """Terms as hashes of 64 bits, and weights of length 1."""
        w = t.join(idf, [*by, "term"]).select(*(by or [F.lit(0).alias(g)]), F.col("key").alias("id"), *extra, F.xxhash64("term").alias("t"), (F.col("tf") * F.col("idf")).alias("w"))
        rows = w.groupBy(g, "id", *extra).agg(F.sort_array(F.collect_list(F.struct("t", "w"))).alias("tw"))
        norm = F.sqrt(F.aggregate("tw", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
        return rows.select(g, "id", *extra, F.col("tw.t").alias("t"), F.transform("tw.w", lambda x: x / norm).alias("w"))

    same = [g, "t", "w"]
    known = weighed(train.withColumn("y", F.col(value).cast("double") if value else F.lit(None).cast("double")), ["y"])
    place = F.row_number().over(Window.partitionBy(*same).orderBy("id"))
    firsts = known.withColumn("__r", place).where(F.col("__r") <= k).groupBy(*same).agg(F.min("id").alias("id"), F.sort_array(F.collect_list(F.struct(F.col("id").alias("neighbour"), F.col("y").alias("value")))).alias("members"))
    classes = checkpoint(firsts)
    asked = checkpoint(weighed(test, []))
    queries = checkpoint(asked.groupBy(*same).agg(F.min("id").alias("id")))
    near = _nearest(queries.select(g, "id", "t", "w"), classes.select(g, "id", "t", "w", F.lit(None).cast("double").alias("y")), g, k, _overlaps, 1e-9)
    members = classes.select(g, F.col("id").alias("neighbour"), "members")
    rows = near.select(g, "query", "neighbour", "similarity").join(members, [g, "neighbour"]).select(g, "query", "similarity", F.explode("members").alias("m")).select(g, "query", "m.neighbour", "similarity", "m.value")
    rank = F.row_number().over(Window.partitionBy(g, "query").orderBy(F.desc("similarity"), "neighbour"))
    best = checkpoint(rows.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("query", "__class"))
    # Every query has its class, and with that its neighbours; written tables on both sides, so that a large class can be split.
    of = checkpoint(_same_vector(asked, queries, same).select(g, F.col("id").alias("query"), F.col("__class")))
    out = of.join(best, [g, "__class"]).select(g, "query", "neighbour", "similarity", "value", "rank")
    return out if group else out.drop(g)


def _same_vector(rows: DataFrame, classes: DataFrame, same: list[str]) -> DataFrame:
    """rows with the id of their class; the group may be null."""
    named = classes.select(*(F.col(c).alias(f"__{c}") for c in same), F.col("id").alias("__class"))
    on = F.xxhash64("t", "w") == F.xxhash64("__t", "__w")
    for c in same:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(named, on)


def hash_encode(texts: Column, dim: int = 256) -> Column:
    """Counts of hashed words, scaled to length 1, inside the JVM."""
    from ..functions.transforms import l2_normalise

    words = F.filter(F.split(texts, r"\s+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    return l2_normalise(counts)


def encoder(encode: Callable[[list[str]], np.ndarray]) -> Callable[[Column], Column]:
    """A Column function from a batch encoder of texts."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(encode(texts.fillna("").tolist()), np.float32)))

    return run


def digest_encode(dim: int = 256) -> Callable[[Column], Column]:
    """Counts of words by the first 8 bytes of their BLAKE2b digest, little-endian, modulo dim; scaled to length 1.

    The same vectors as other programs with that rule make; hash_encode is the faster form.
    """
    from hashlib import blake2b

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in zip(out, texts):
            for w in text.split():
                row[int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little") % dim] += 1
        n = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(n == 0, 1, n)

    return encoder(encode)


def map_distinct(df: DataFrame, text: str, make: Callable[[Column], Column], name: str) -> DataFrame:
    """df with name = make(text), computed once for each distinct text."""
    made = df.select(text).where(F.col(text).isNotNull()).distinct().withColumn(name, make(F.col(text)))
    return df.join(made, text, "left")


def first_of_equal(df: DataFrame, text: str, key: str) -> DataFrame:
    """df with first_key: the smallest key of rows with the same text."""
    firsts = df.groupBy(text).agg(F.min(key).alias("first_key"))
    return df.join(firsts, df[text].eqNullSafe(firsts[text])).drop(firsts[text])


# -- texts of jobs ----------------------------------------------------------------------------

#: The concepts known at submission, in their order, and the columns that may hold each, the first present one first.
CONCEPTS = {
    "job name": ["job_name", "name"],
    "partition": ["partition"],
    "queue": ["queue", "qos"],
    "account": ["account"],
    "user": ["user"],
    "science field": ["science_field", "science_field_short"],
    "machine": ["machine", "machine_name"],
    "requested walltime": ["requested_seconds", "wallclock_requested", "wallclock_requested_seconds"],
    "requested nodes": ["num_nodes_req", "nodes_requested"],
    "requested cores": ["num_cores_req", "processors_requested"],
    "requested gpus": ["num_gpus_req", "gpus_requested"],
    "requested memory": ["memory_requested", "mem_req"],
}
#: Columns that are known only after a job has run.
AFTERWARDS = [
    "runtime_seconds",
    "run_time",
    "end_time",
    "start_time",
    "state",
    "job_state",
    "exit_status",
    "elapsed",
    "allocated_cpus",
    "num_nodes_alloc",
    "num_cores_alloc",
    "cores_used",
    "nodes_used",
]


def _said(df: DataFrame, name: str) -> Column:
    """The value as text; whole doubles are written out."""
    c = F.col(name)
    if df.schema[name].dataType.typeName() in ("double", "float"):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e16)
        return F.when(whole, F.concat(c.cast("decimal(20,0)").cast("string"), F.lit(".0"))).otherwise(c.cast("string"))
    return F.nullif(c.cast("string"), F.lit(""))


def concepts(df: DataFrame, *, submit: str | None = "submit_time", extra: list[str] = ()) -> list[str]:
    """What a row's text tells, of the columns that are there."""
    have = [label for label, names in CONCEPTS.items() if any(c in df.columns for c in names)]
    return have + (["submitted"] if submit in df.columns else []) + list(extra)


def text_columns(df: DataFrame, extra: tuple[str, ...] = ()) -> list[str]:
    """The columns of strings among those that may be features, by name; those that have no value are left out."""
    named = sorted(f.name for f in df.schema if f.dataType.typeName() == "string" and (f.name in ALLOWED or f.name in extra))
    seen = df.agg(*(F.count(F.nullif(F.col(c), F.lit(""))).alias(c) for c in named)).first() if named else {}
    return [c for c in named if seen[c]]


def serialise(df: DataFrame, *, form: str = "prose", submit: str | None = "submit_time", extra: list[str] = (), limit: int = 2000, instruction: str | None = None) -> Column:
    """A job row as text, from what is known at its submission."""
    if form not in ("prose", "kv"):
        raise ValueError("form is prose or kv")
    if leaks := sorted(set(AFTERWARDS).intersection(extra)):
        raise ValueError(f"known only afterwards: {', '.join(leaks)}")
    value = {}
    for label, names in CONCEPTS.items():
        have = [_said(df, c) for c in names if c in df.columns]
        if have:
            value[label] = F.coalesce(*have)
    if submit and submit in df.columns:
        value["submitted"] = F.date_format(submit, "EEEE HH:00")
    extras = [(c, F.substring(F.nullif(F.col(c).cast("string"), F.lit("")), 1, limit)) for c in extra if c in df.columns]
    if form == "kv":
        lines = [F.concat(F.lit(f"{k}: "), v) for k, v in value.items()] + [F.concat(F.lit(f"{k}:\n"), v) for k, v in extras]
        text = F.concat_ws("\n", *lines)
    else:

        def said(label: str, before: str, after: str = "") -> Column:
            return F.coalesce(F.concat(F.lit(before), value[label], F.lit(after)), F.lit("")) if label in value else F.lit("")

        wants = [F.concat(value[k], F.lit(f" {unit}")) for k, unit in (("requested nodes", "nodes"), ("requested cores", "cores"), ("requested gpus", "GPUs"), ("requested memory", "memory")) if k in value]
        if "requested walltime" in value:
            wants.append(F.concat(F.lit("a walltime limit of "), value["requested walltime"]))
        asked = F.concat_ws(", ", *wants) if wants else F.lit("")
        text = F.concat(
            F.lit("An HPC batch job"), said("job name", " named "), said("partition", " on the ", " partition"), said("queue", " (queue ", ")"),
            F.when(asked != "", F.concat(F.lit(", requesting "), asked)).otherwise(""), said("account", ", charged to account "), said("user", ", submitted by "),
            said("science field", ", in "), said("machine", ", on "), said("submitted", ", submitted on "), F.lit("."),
            *(F.coalesce(F.concat(F.lit(f" {k}:\n"), v), F.lit("")) for k, v in extras),
        )
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), text) if instruction else text
