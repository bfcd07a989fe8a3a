"""Random forests of all windows at once, grown from sums over cells (rows with the same features).

A tree sees each row as often as a Poisson number says that a hash of row and tree draws.  Splits and leaves depend on
counts and labels summed by cell only, so one pass over the rows adds these up for every tree, by cell and range of windows
that the rows train; a tree of a window then grows in one task from a row a cell.  Labels are summed as whole numbers, so
trees depend neither on the order of rows nor on how they are spread.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..scratch import checkpoint
from .boosting import _mixed, scale_of

# Functions sent to Python workers carry their code along, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Cells up to which forests grow from sums.
CELLS = 4096
#: Bytes of sums that a task holds before it hands them on.
HELD = 128 << 20


@dataclass(frozen=True)
class Options:
    """Under Spark ML's names."""

    numTrees: int = 100
    maxDepth: int = 16
    featureSubsetStrategy: str = "sqrt"
    subsamplingRate: float = 1.0
    minInstancesPerNode: int = 1
    minInfoGain: float = 0.0
    maxBins: int = 32
    seed: int = 42

    def subset(self, width: int) -> int:
        """The number of features that a node may split on."""
        named = {"sqrt": np.sqrt(width), "auto": width / 3 if self.numTrees > 1 else width, "onethird": width / 3, "log2": np.log2(width), "all": width}
        how = str(self.featureSubsetStrategy).lower()
        if how in named:
            return max(1, int(np.ceil(named[how])))
        share = float(how)
        return min(width, int(how)) if how.isdigit() else max(1, int(np.ceil(share * width)))


def drawn(o: Options, rid: np.ndarray, tree: int) -> np.ndarray:
    """How often a tree sees each row."""
    terms = [np.exp(-o.subsamplingRate)]
    while sum(terms) < 1 - 2.0**-53 and terms[-1] > 0 and len(terms) < 256:
        terms.append(terms[-1] * o.subsamplingRate / len(terms))
    with np.errstate(over="ignore"):
        step = np.uint64(o.seed * 1_000_003 + tree + 1) * np.uint64(0x9E3779B97F4A7C15)
        h = _mixed(rid.astype(np.int64).view(np.uint64) + step)
    return np.searchsorted(np.cumsum(terms), (h >> np.uint64(11)).astype(np.float64) / 2.0**53, side="right")


SUMS = "lo int, hi int, cell int, tree int, n bigint, g bigint"


def _added(o: Options, scale: float):
    """Rows (lo, hi, cell, rid, label) to sums by range, cell and tree."""

    def told(keys: np.ndarray, n: np.ndarray, g: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(keys), 1024):
            at, tree = np.nonzero(n[s : s + 1024])
            lo, hi, cell = keys[s + at].T
            yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)) for v in (lo, hi, cell, tree)] + [pa.array(v[s + at, tree]) for v in (n, g)], names=["lo", "hi", "cell", "tree", "n", "g"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[tuple, int] = {}
        n = g = np.zeros((0, o.numTrees), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            lo, hi, cell, rid = (batch.column(c).to_numpy() for c in ("lo", "hi", "cell", "rid"))
            y = np.rint(batch.column("label").to_numpy() * scale)
            keys, back = np.unique(np.array([lo, hi, cell], dtype=np.int64), axis=1, return_inverse=True)
            back = back.reshape(-1)
            at = np.array([place.setdefault(tuple(k), len(place)) for k in keys.T.tolist()])
            if len(place) > len(n):
                more = np.zeros((max(len(place), 2 * len(n)) - len(n), o.numTrees), dtype=np.int64)
                n, g = np.vstack([n, more]), np.vstack([g, more])
            for tree in range(o.numTrees):
                times = drawn(o, rid, tree)
                # Below 2^53, so doubles are exact.
                n[at, tree] += np.bincount(back, times, keys.shape[1]).astype(np.int64)
                g[at, tree] += np.bincount(back, times * y, keys.shape[1]).astype(np.int64)
            if n.nbytes + g.nbytes > HELD:
                yield from told(np.array(list(place)), n[: len(place)], g[: len(place)])
                place, n, g = {}, n[:0], g[:0]
        if place:
            yield from told(np.array(list(place)), n[: len(place)], g[: len(place)])

    return run


def thresholds(x: np.ndarray, n: np.ndarray, bins: int) -> np.ndarray:
    """The middles between neighbouring values, of more than bins - 1 those at even shares of the rows."""
    values, back = np.unique(x, return_inverse=True)
    middles = (values[1:] + values[:-1]) / 2
    if len(middles) < bins:
        return middles
    upto = np.cumsum(np.bincount(back.reshape(-1), n, len(values)))
    at = np.searchsorted(upto, upto[-1] * np.arange(1, bins) / bins)
    return middles[np.unique(np.minimum(at, len(middles) - 1))]


def grow(o: Options, numbers: list[np.ndarray], places: list[np.ndarray], widths: list[int], n: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """What a tree predicts for each cell; n and y: counts and sums of labels of the rows that it sees there.

    numbers: values of each numeric column; places: of each category, which is as many features as its width, "is it this one?".
    """
    seen = n > 0
    bins = [np.searchsorted(thresholds(x[seen], n[seen], o.maxBins), x, side="left") for x in numbers]
    first = np.cumsum([len(numbers), *widths])
    width, out = int(first[-1]), np.zeros(len(n))
    live = [(np.arange(len(n)), 0)]
    while live:
        own, depth = live.pop()
        w, s = n[own], y[own]
        all_w, all_s = w.sum(), s.sum()
        out[own] = all_s / all_w if all_w else 0.0
        if depth == o.maxDepth or all_w < 2 * o.minInstancesPerNode:
            continue
        whole = all_s * all_s / all_w
        best, left = max(o.minInfoGain * all_w, 1e-12 * abs(whole)), None
        for f in rng.permutation(width)[: o.subset(width)]:
            if f < len(numbers):
                x = bins[f][own]
            else:
                c = int(np.searchsorted(first, f, side="right")) - 1
                x = (places[c][own] == f - first[c]).astype(np.int64)
            lw, ls = np.cumsum(np.bincount(x, w))[:-1], np.cumsum(np.bincount(x, s))[:-1]
            fits = (lw >= o.minInstancesPerNode) & (all_w - lw >= o.minInstancesPerNode) & (lw > 0) & (lw < all_w)
            if not fits.any():
                continue
            lw, ls, at = lw[fits], ls[fits], np.flatnonzero(fits)
            gain = ls * ls / lw + (all_s - ls) ** 2 / (all_w - lw) - whole
            k = int(gain.argmax())
            if gain[k] > best:
                best, left = gain[k], x <= at[k]
        if left is not None:
            live += [(own[left], depth + 1), (own[~left], depth + 1)]
    return out


def predictions(train: DataFrame, wanted: DataFrame, cells: DataFrame, encodings: dict, o: Options) -> DataFrame:
    """window_id, cell, prediction.

    train: lo and hi (the windows that a row trains), cell, rid (a whole number that names the row) and label; wanted: window_id and
    cell, those of test rows; cells: cell and its features; encodings: how the features of each window are told apart.
    """
    largest = train.agg(F.max(F.abs("label"))).first()[0]
    scale = scale_of(largest or 0.0)
    sums = train.select("lo", "hi", "cell", "rid", "label").mapInArrow(_added(o, scale), SUMS).groupBy("lo", "hi", "cell", "tree").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    sums = sums.withColumn("window_id", F.explode(F.sequence("lo", "hi"))).where(F.col("window_id").isin(list(encodings)))
    sums = sums.groupBy("window_id", "tree", "cell").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    asked = wanted.withColumns({"tree": F.explode(F.sequence(F.lit(0), F.lit(o.numTrees - 1))), "asked": F.lit(True)})
    rows = sums.join(asked, ["window_id", "tree", "cell"], "full").join(F.broadcast(cells), "cell")  # at most CELLS
    rows = rows.withColumns({"n": F.coalesce("n", F.lit(0)), "g": F.coalesce("g", F.lit(0)), "asked": F.coalesce("asked", F.lit(False))})
    names = ["window_id", "tree", "cell", "p"]

    def one(key, t):
        window, tree = (k.as_py() for k in key)
        t = t.sort_by("cell")
        e, n = encodings[window], t.column("n").to_numpy().astype(np.float64)
        numbers = [t.column(c).to_numpy().astype(np.float64) for c in e.numeric]
        places = []
        for c, values in e.values.items():
            at = {v: k for k, v in enumerate(values)}
            places.append(np.array([at.get(v, len(values)) for v in t.column(c).to_pylist()]))
        p = grow(o, numbers, places, [len(v) + 1 for v in e.values.values()], n, t.column("g").to_numpy() / scale, np.random.default_rng([o.seed, window, tree]))
        keep = t.column("asked").to_numpy(zero_copy_only=False).astype(bool)
        cell = t.column("cell").to_numpy()[keep]
        return pa.table([pa.array(np.full(len(cell), window), pa.int32()), pa.array(np.full(len(cell), tree), pa.int32()), pa.array(cell, pa.int32()), pa.array(p[keep])], names=names)

    # Trees take long and their cells little room, so partitions are not put together by their size.
    tasks = max(1, min(len(encodings) * o.numTrees, 4 * int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    grown = rows.repartition(tasks, "window_id", "tree").groupBy("window_id", "tree").applyInArrow(one, "window_id int, tree int, cell int, p double")
    mean = F.aggregate(F.sort_array(F.collect_list("p")), F.lit(0.0), lambda a, x: a + x) / o.numTrees
    return checkpoint(grown.groupBy("window_id", "cell").agg(mean.alias("prediction")))
