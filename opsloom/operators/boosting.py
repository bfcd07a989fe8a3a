"""Gradient-boosted trees for any number of models at once.

A model is named by key columns (a window, or a window and a route), and a training row belongs to one model; a row that
trains several windows is there once for each, as its residuals differ.  Columns are cut into bins: numbers at
exact quantiles of the model's rows, categories into their values ("is it this one?").  A level of a tree is a histogram
over (model, node, column, bin) of gradients and weights, from which each node takes the best split.

Gradients and weights are summed as whole numbers, so sums, splits and predictions depend neither on
the order of rows nor on how they are spread.  That allows two ways with the same results:

* models of at most ``task_rows`` rows are grown in one task each, all models by one job;
* larger ones level by level: each task adds up its rows' histograms, Spark sums them by (model, node,
  column, bin), the splits (one row a node) come to the driver and go out with the next level's tasks.
  Rows lie in written tables of packed pieces; what the trees add to a row is written every
  ``REFRESH`` trees.  A level is one chain of jobs for all large models.

Rows in the same bins of all columns (a cell) have one prediction.  Models in memory grow from the sums of their cells, and
so do large ones with at most ``CELLS`` of them: one job a tree for all large models, two more for leaves of absolute errors.

What the driver holds is the trees in work of the models above ``task_rows`` rows, so at most a node for each
``task_rows / 2^depth`` rows.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from ..scratch import BATCH_ROWS, checkpoint
from .ranks import grouped_places

# Functions sent to Python workers carry their code along, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Whole numbers that a weight of 1 counts.
UNIT = 1 << 20
#: Trees between two writings of what large models predict for their rows.
REFRESH = 10
#: Rows of a packed piece.
PIECE = 1 << 16
#: Cells (rows in the same bins of all columns) up to which a large model's trees grow from the sums of its cells.
CELLS = 1 << 16
#: Bits of a residual that the second pass over the leaves' medians settles.
STEP = 21
#: The columns of a model's nodes; a leaf has no column.
NODES = "tree int, node int, feature string, threshold double, category string, gain double, value double"


@dataclass(frozen=True)
class Spec:
    """How trees grow.  squared: mean squares; otherwise absolute errors, whose leaves are weighted medians."""

    rounds: int = 100
    depth: int = 8
    rate: float = 0.05
    subsample: float = 0.8
    columns: float = 0.8
    least: float = 5.0
    penalty: float = 1.0
    gamma: float = 0.0
    bins: int = 256
    floor: int = 2
    most: int = 2048
    squared: bool = True
    seed: int = 42
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    #: Whole numbers that a residual of 1 counts, see scale_of().
    scale: float = 1.0

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric + self.categorical


def scale_of(largest: float) -> float:
    """A power of two at which residuals of labels up to largest keep 31 bits, so that 2^31 of them add up in 64."""
    return float(2.0 ** (30 - np.ceil(np.log2(max(largest, 1e-9)))))


@dataclass
class Bins:
    """edges: the upper bound of each bin but the last, for each number; values: the categories told apart."""

    edges: list[np.ndarray]
    values: list[list[str]]

    def of(self, numbers: list[np.ndarray], categories: list[np.ndarray], n: int) -> np.ndarray:
        """(columns x rows) bins; -1 for a category that isn't told apart."""
        out = [np.searchsorted(e, x, side="left") for e, x in zip(self.edges, numbers)]
        for known, x in zip(self.values, categories):
            at = {v: k for k, v in enumerate(known)}
            named, back = np.unique(x.astype(str), return_inverse=True)
            out.append(np.array([at.get(v, -1) for v in named], dtype=np.int64)[back])
        return np.array(out, dtype=np.int32).reshape(len(out), n)


def ranks_of(n: int, bins: int) -> np.ndarray:
    """The places of the inner edges among n sorted values."""
    return np.unique((np.arange(1, bins) * n + bins - 1) // bins - 1) if n else np.zeros(0, dtype=np.int64)


def bins_of(spec: Spec, numbers: list[np.ndarray], categories: list[np.ndarray]) -> Bins:
    """Edges at exact quantiles; categories from the least frequency on, not below floor, at which most of them at most are left."""
    edges = []
    for x in numbers:
        e = np.unique(np.sort(x)[ranks_of(len(x), spec.bins)])
        edges.append(e[e < x.max()] if len(x) else e)
    counted = [np.unique(x.astype(str), return_counts=True) for x in categories]
    every = np.sort(np.concatenate([n for _, n in counted]))[::-1] if counted else np.zeros(0, dtype=np.int64)
    cut = max(spec.floor, int(every[spec.most]) + 1) if len(every) > spec.most else spec.floor
    return Bins(edges, [[str(v) for v, k in zip(*c) if k >= cut] for c in counted])


@dataclass
class Tree:
    """Nodes by their place in the heap: the children of k are 2k + 1 and 2k + 2; feature -1 is a leaf or nothing."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (1 << (depth + 1)) - 1
        return cls(np.full(n, -1, dtype=np.int32), np.zeros(n, dtype=np.int32), np.zeros(n), np.zeros(n))

    def walk(self, x: np.ndarray, n_numeric: int) -> np.ndarray:
        """The node in which each row ends so far."""
        at = np.zeros(x.shape[1], dtype=np.int64)
        rows = np.arange(x.shape[1])
        while len(rows):
            f = self.feature[at[rows]]
            rows, f = rows[f >= 0], f[f >= 0]
            bins, own = self.bin[at[rows]], x[f, rows]
            left = np.where(f < n_numeric, own <= bins, own == bins)
            at[rows] = 2 * at[rows] + np.where(left, 1, 2)
        return at


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def taken(spec: Spec, rid: np.ndarray, tree: int) -> np.ndarray:
    """Which rows a tree sees, by a hash of the row and the tree."""
    if spec.subsample >= 1:
        return np.ones(len(rid), dtype=bool)
    with np.errstate(over="ignore"):
        step = np.uint64(spec.seed * 1_000_003 + tree + 1) * np.uint64(0x9E3779B97F4A7C15)
        h = _mixed(rid.astype(np.int64).view(np.uint64) + step)
    return (h >> np.uint64(11)).astype(np.float64) / 2.0**53 < spec.subsample


def columns_of(spec: Spec, name: str, tree: int) -> list[int]:
    """The columns that a tree of a model may split on."""
    n = len(spec.features)
    many = min(n, max(1, int(spec.columns * n)))  # none if there is no column
    return sorted(np.random.default_rng([spec.seed, tree, zlib.crc32(name.encode())]).permutation(n)[:many].tolist())


def whole_weights(w: np.ndarray) -> np.ndarray:
    return np.rint(w * UNIT).astype(np.int64)


def gradients(spec: Spec, y: np.ndarray, pred: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not spec.squared:
        return (np.sign(y - pred) * h).astype(np.int64)
    return np.rint((y - pred) * (h / UNIT) * spec.scale).astype(np.int64)


def sums_by(key: np.ndarray, size: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the keys that occur, sums of g and h), exactly: halves of 31 bits are added as doubles."""
    if size > 4 * len(key) + 1024:
        found, back = np.unique(key, return_inverse=True)
        return found, *sums_by(back, len(found), g, h)[1:]
    low = (1 << 16) - 1

    def exact(v: np.ndarray) -> np.ndarray:
        return (np.bincount(key, v >> 16, size).astype(np.int64) << 16) + np.bincount(key, v & low, size).astype(np.int64)

    found = np.flatnonzero(np.bincount(key, minlength=size))
    return found, exact(g)[found], exact(h)[found]


def score_of(spec: Spec, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    real = g / (spec.scale if spec.squared else UNIT)
    return real * real / (h / UNIT + spec.penalty)


def value_of(spec: Spec, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return spec.rate * (g / (spec.scale if spec.squared else UNIT)) / (h / UNIT + spec.penalty)


def best_splits(spec: Spec, feature: int, slot: np.ndarray, bins: np.ndarray, g: np.ndarray, h: np.ndarray, total_g: np.ndarray, total_h: np.ndarray):
    """For each slot (a node): gain, bin, and g and h of the left side of the column's best split; entries are sorted by (slot, bin).

    gain is minus infinity where no split leaves the least weight on both sides; the lowest bin wins ties.
    """
    n = len(total_g)
    gain, at, lg, lh = np.full(n, -np.inf), np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if feature >= len(spec.numeric):  # what isn't told apart is never the one value
        named = bins >= 0
        slot, bins, g, h = slot[named], bins[named], g[named], h[named]
    if not len(slot):
        return gain, at, lg, lh
    if feature < len(spec.numeric):
        first = np.r_[True, slot[1:] != slot[:-1]]
        start = np.maximum.accumulate(np.where(first, np.arange(len(slot)), 0))
        cg, ch = np.cumsum(g), np.cumsum(h)
        g, h = cg - (cg[start] - g[start]), ch - (ch[start] - h[start])
    rg, rh = total_g[slot] - g, total_h[slot] - h
    fits = (h >= spec.least * UNIT) & (rh >= spec.least * UNIT)
    gained = np.where(fits, 0.5 * (score_of(spec, g, h) + score_of(spec, rg, rh) - score_of(spec, total_g, total_h)[slot]), -np.inf)
    order = np.lexsort((bins, -gained, slot))
    top = order[np.r_[True, slot[order][1:] != slot[order][:-1]]]
    s = slot[top]
    gain[s], at[s], lg[s], lh[s] = gained[top], bins[top], g[top], h[top]
    return gain, at, lg, lh


def median_of(r: np.ndarray, h: np.ndarray) -> int:
    """The least residual up to which lies half of the weight."""
    order = np.argsort(r, kind="stable")
    upto = np.cumsum(h[order])
    return int(r[order][np.searchsorted(2 * upto, upto[-1])])


def whole_residuals(spec: Spec, y: np.ndarray, pred: np.ndarray) -> np.ndarray:
    return np.rint((y - pred) * spec.scale).astype(np.int64)


def base_of(spec: Spec, y: np.ndarray, h: np.ndarray) -> float:
    """Where a model begins: the weighted mean, or median."""
    if not h.sum():
        return 0.0
    if not spec.squared:
        return median_of(whole_residuals(spec, y, np.zeros(len(y))), h) / spec.scale
    return mean_of(spec, int(gradients(spec, y, np.zeros(len(y)), h).sum()), int(h.sum()))


def mean_of(spec: Spec, g: int, h: int) -> float:
    return g / spec.scale / (h / UNIT)


def set_splits(spec: Spec, tree: Tree, node: np.ndarray, feature: np.ndarray, bins: np.ndarray, gain: np.ndarray, lg, lh, g, h) -> None:
    """Splits the nodes whose gain is above gamma and gives their children values."""
    ok = np.isfinite(gain) & (gain > spec.gamma)
    for k, f, b, a, x, y, gg, hh in zip(node[ok], feature[ok], bins[ok], gain[ok], lg[ok], lh[ok], g[ok], h[ok]):
        tree.feature[k], tree.bin[k], tree.gain[k] = f, b, a
        tree.value[2 * k + 1], tree.value[2 * k + 2] = value_of(spec, x, y), value_of(spec, gg - x, hh - y)


def grow(spec: Spec, name: str, tree_no: int, x: np.ndarray, g: np.ndarray, h: np.ndarray, seen: np.ndarray) -> tuple[Tree, np.ndarray]:
    """(one tree over the rows of one model, the node of each row)."""
    tree, node = Tree.empty(spec.depth), np.zeros(x.shape[1], dtype=np.int64)
    tree.value[0] = value_of(spec, g[seen].sum(), h[seen].sum())
    features, active = columns_of(spec, name, tree_no), seen.copy()
    for level in range(spec.depth if features else 0):
        rows = np.flatnonzero(active)
        if not len(rows):
            break
        nodes, slot = np.unique(node[rows], return_inverse=True)
        own_g, own_h = g[rows], h[rows]
        total_g, total_h = sums_by(slot, len(nodes), own_g, own_h)[1:]
        best = None
        for f in features:
            wide = int(x[f].max()) + 2  # bin -1 has the first place
            found, hg, hh = sums_by(slot * wide + x[f, rows] + 1, len(nodes) * wide, own_g, own_h)
            one = best_splits(spec, f, found // wide, found % wide - 1, hg, hh, total_g, total_h)
            if best is None:
                best = [np.full(len(nodes), f), *one]
            else:
                better = one[0] > best[1]
                best = [np.where(better, new, old) for new, old in zip((f, *one), best)]
        set_splits(spec, tree, nodes, best[0], best[2], best[1], best[3], best[4], total_g, total_h)
        split = tree.feature[node] >= 0
        inside = np.flatnonzero(split & (node >= (1 << level) - 1))
        f = tree.feature[node[inside]]
        own, at = x[f, inside], tree.bin[node[inside]]
        node[inside] = 2 * node[inside] + np.where(np.where(f < len(spec.numeric), own <= at, own == at), 1, 2)
        active = active & (node >= (2 << level) - 1)
    return tree, node


def set_medians(spec: Spec, tree: Tree, node: np.ndarray, residual: np.ndarray, h: np.ndarray) -> None:
    """Leaves of absolute errors: the weighted median of the residuals of the rows that the tree saw."""
    order = np.argsort(node, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
        if len(own) and h[own].sum():
            tree.value[node[own[0]]] = spec.rate * (median_of(residual[own], h[own]) / spec.scale)


def cells_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the different columns of x: rows that are in the same bins, the place of each row's among them)."""
    at = np.zeros(x.shape[1], dtype=np.int64)
    for own in x:
        at = np.unique(at * (int(own.max(initial=-1)) + 2) + own + 1, return_inverse=True)[1].reshape(-1)
    first = np.unique(at, return_index=True)[1]
    return x[:, first], at


def boosted(spec: Spec, name: str, x: np.ndarray, y: np.ndarray, w: np.ndarray, rid: np.ndarray) -> tuple[float, list[Tree]]:
    """(base, trees) of one model in memory; rows of one cell have one prediction, so trees grow over the sums of cells."""
    h = whole_weights(w)
    base = base_of(spec, y, h)
    cells, cell = cells_of(x)
    pred, trees = np.full(cells.shape[1], base), []
    for t in range(spec.rounds):
        rows = np.flatnonzero(taken(spec, rid, t))
        own, own_y, own_h = cell[rows], y[rows], h[rows]
        found, g, weight = sums_by(own, len(pred), gradients(spec, own_y, pred[own], own_h), own_h)
        tree, node = grow_cells(spec, name, t, cells, found, g, weight)
        if not spec.squared:
            set_medians(spec, tree, node[own], whole_residuals(spec, own_y, pred[own]), own_h)
        pred = pred + tree.value[node]
        trees.append(tree)
    return base, trees


def grow_cells(spec: Spec, name: str, tree_no: int, cells: np.ndarray, found: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[Tree, np.ndarray]:
    """(one tree, the node of each cell) from the sums of the cells in which the tree sees rows."""
    all_g, all_h, seen = np.zeros(cells.shape[1], dtype=np.int64), np.zeros(cells.shape[1], dtype=np.int64), np.zeros(cells.shape[1], dtype=bool)
    all_g[found], all_h[found], seen[found] = g, h, True
    return grow(spec, name, tree_no, cells, all_g, all_h, seen)


def node_rows(spec: Spec, bins: Bins, base: float, trees: list[Tree], first: int = 0) -> dict[str, list]:
    """The columns of NODES; tree -1 holds the base."""
    out: dict[str, list] = {c.split()[0]: [] for c in NODES.split(", ")}

    def add(*row):
        for c, v in zip(out, row):
            out[c].append(v)

    if not first:
        add(-1, 0, None, None, None, None, base)
    for t, tree in enumerate(trees, first):
        live = [0]
        while live:
            k = live.pop()
            f = int(tree.feature[k])
            if f < 0:
                add(t, k, None, None, None, None, float(tree.value[k]))
                continue
            numeric = f < len(spec.numeric)
            add(t, k, spec.features[f], float(bins.edges[f][tree.bin[k]]) if numeric else None, None if numeric else bins.values[f - len(spec.numeric)][tree.bin[k]], float(tree.gain[k]), None)
            live += [2 * k + 1, 2 * k + 2]
    return out


def _name(values) -> str:
    return "\x1f".join("" if v is None else str(v) for v in values)


def _columns(spec: Spec, t: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The numbers and the categories of rows without nulls."""
    return [t.column(c).to_numpy().astype(np.float64) for c in spec.numeric], [np.array(t.column(c).to_pylist(), dtype=object) for c in spec.categorical]


def _schema(rows: DataFrame, keys: list[str]) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + NODES


def _arrow(rows: DataFrame, keys: list[str]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(rows.select(*keys).sparkSession.createDataFrame([], _schema(rows, keys)).schema)


def fit(rows: DataFrame, spec: Spec, *, keys: list[str], task_rows: int = 1_000_000) -> DataFrame:
    """The nodes (keys and NODES) of all models.

    rows: the keys, the columns of spec (numbers and strings without nulls), label, weight and rid (a whole number that names the row).
    """
    rows = checkpoint(rows.select(*keys, *spec.features, F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"), F.col("rid").cast("bigint").alias("rid")))
    largest = rows.agg(F.max(F.abs("label"))).first()[0]
    spec = Spec(**(spec.__dict__ | {"scale": scale_of(largest or 0.0)}))
    sizes = checkpoint(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")))
    large = [tuple(r[k] for k in keys) for r in sizes.where(F.col("__n") > task_rows).collect()]  # at most rows / task_rows
    schema = _arrow(rows, keys)
    small = rows
    if large:
        picked = rows.sparkSession.createDataFrame([(i, *k) for i, k in enumerate(large)], "__model int, " + ", ".join(f"`__k_{k}` {dict(rows.dtypes)[k]}" for k in keys))
        same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
        on = same[0]
        for c in same[1:]:
            on = on & c
        small = rows.join(F.broadcast(picked), on, "left_anti")

    def one(key, t):
        values = [k.as_py() for k in key]
        bins = bins_of(spec, *_columns(spec, t))
        x = bins.of(*_columns(spec, t), t.num_rows)
        base, trees = boosted(spec, _name(values), x, t.column("label").to_numpy(), t.column("weight").to_numpy(), t.column("rid").to_numpy())
        made = node_rows(spec, bins, base, trees)
        n = len(made["tree"])
        return pa.table([pa.array([v] * n, schema.field(k).type) for k, v in zip(keys, values)] + [pa.array(made[f], schema.field(f).type) for f in made], schema=schema)

    # Models take long and their rows little room, so partitions are not put together by their size.
    tasks = max(1, min(sizes.count(), 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    out = small.repartition(tasks, *keys).groupBy(*keys).applyInArrow(one, _schema(rows, keys))
    if large:
        out = out.unionByName(_fit_large(rows.join(F.broadcast(picked), on).drop(*(f"__k_{k}" for k in keys)), spec, keys, large, schema))
    return checkpoint(out)


# -- models above task_rows: level by level over all rows -----------------------------------------
def _large_bins(rows: DataFrame, spec: Spec, n: int) -> list[Bins]:
    """bins_of() of each model, by counting; edges and categories of a model are bounded by bins and most."""
    bins = [Bins([np.zeros(0)] * len(spec.numeric), [[] for _ in spec.categorical]) for _ in range(n)]
    if spec.numeric:
        long = rows.select("__model", *spec.numeric).unpivot(["__model"], list(spec.numeric), "column", "v")
        counted = long.groupBy("__model", "column").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
        places = F.expr(f"array_distinct(transform(sequence(1, {spec.bins - 1}), k -> (k * n + {spec.bins - 1}) div {spec.bins} - 1))")
        asked = counted.select("__model", "column", F.explode(places).alias("place"))
        found = grouped_places(long, ["__model", "column"], "v", asked)
        tops = {(r["__model"], r["column"]): r["top"] for r in counted.collect()}
        values: dict = {}
        for r in found.collect():
            values.setdefault((r["__model"], r["column"]), set()).add(r["v"])
        for (m, c), v in values.items():
            bins[m].edges[spec.numeric.index(c)] = np.array(sorted(x for x in v if x < tops[m, c]))
    if spec.categorical:
        long = rows.select("__model", *(F.col(c).cast("string").alias(c) for c in spec.categorical)).unpivot(["__model"], list(spec.categorical), "column", "value")
        counts = checkpoint(long.groupBy("__model", "column", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= spec.floor))
        order = Window.partitionBy("__model").orderBy(F.desc("n"))
        over = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= spec.most + 1).where(F.col("r") == spec.most + 1).select("__model", (F.col("n") + 1).alias("cut"))
        kept = counts.join(over, "__model", "left").where(F.col("cut").isNull() | (F.col("n") >= F.col("cut"))).select("__model", "column", "value").collect()
        for r in sorted(kept, key=lambda r: r["value"]):
            bins[r["__model"]].values[spec.categorical.index(r["column"])].append(r["value"])
    return bins


def _packed(spec: Spec, bins: list[Bins]):
    """Batches of rows to pieces: model, and its rows' bins, label, weight, rid and prediction as packed arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            models = t.column("__model").to_numpy()
            for m in np.unique(models):
                own = t.filter(pa.array(models == m))
                x = bins[m].of(*_columns(spec, own), own.num_rows).astype(np.int16)
                yield pa.RecordBatch.from_pydict({
                    "model": pa.array([m], pa.int32()), "x": pa.array([x.tobytes()], pa.binary()), "y": pa.array([own.column("label").to_numpy().tobytes()], pa.binary()), "w": pa.array([own.column("weight").to_numpy().tobytes()], pa.binary()),
                    "rid": pa.array([own.column("rid").to_numpy().tobytes()], pa.binary()), "pred": pa.array([np.zeros(own.num_rows).tobytes()], pa.binary()),
                })

    return run


PACKED = "model int, x binary, y binary, w binary, rid binary, pred binary"


def _unpacked(spec: Spec, batches: Iterator[pa.RecordBatch], pending: list[list[Tree]] | None):
    """(row, model, x, y, whole weights, rid, prediction with the trees that aren't written yet)."""
    for batch in batches:
        for r in batch.to_pylist():
            y = np.frombuffer(r["y"])
            x = np.frombuffer(r["x"], dtype=np.int16).astype(np.int32).reshape(len(spec.features), len(y))
            pred = np.frombuffer(r["pred"])
            for tree in pending[r["model"]] if pending else ():
                pred = pred + tree.value[tree.walk(x, len(spec.numeric))]
            yield r, r["model"], x, y, whole_weights(np.frombuffer(r["w"])), np.frombuffer(r["rid"], dtype=np.int64), pred


def _sums_pass(spec: Spec, pieces: DataFrame) -> dict[int, tuple[int, int]]:
    """model -> (sum of labels, of weights), as whole numbers."""

    def run(batches):
        for _, m, _, y, h, _, pred in _unpacked(spec, batches, None):
            yield pa.RecordBatch.from_pydict({"model": pa.array([m], pa.int32()), "g": pa.array([int(gradients(spec, y, pred, h).sum())], pa.int64()), "h": pa.array([int(h.sum())], pa.int64())})

    sums = pieces.mapInArrow(run, "model int, g bigint, h bigint").groupBy("model").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
    return {r["model"]: (r["g"], r["h"]) for r in sums}


def _level_pass(spec: Spec, pieces: DataFrame, names: list[str], tree_no: int, level: int, growing: list[Tree], pending: list[list[Tree]]) -> list:
    """The best split of each node of a level, a row a node."""

    def run(batches):
        held: dict = {}
        for _, m, x, y, h, rid, pred in _unpacked(spec, batches, pending):
            node = growing[m].walk(x, len(spec.numeric))
            rows = np.flatnonzero(taken(spec, rid, tree_no) & (node >= (1 << level) - 1))
            g = gradients(spec, y, pred, h)[rows]
            for f in columns_of(spec, names[m], tree_no):
                wide = int(x[f].max()) + 2
                key, hg, hh = sums_by((node[rows] - ((1 << level) - 1)) * wide + x[f, rows] + 1, (1 << level) * wide, g, h[rows])
                held.setdefault((m, f), []).append((key // wide + (1 << level) - 1, key % wide - 1, hg, hh))
        for (m, f), entries in held.items():  # a task's own sums, so that rows sent do not depend on its pieces
            node, b, g, h = (np.concatenate(e) for e in zip(*entries))
            order = np.lexsort((b, node))
            node, b, g, h = node[order], b[order], g[order], h[order]
            head = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (b[1:] != b[:-1])]) if len(node) else np.zeros(0, dtype=np.int64)
            if len(head):
                yield pa.RecordBatch.from_pydict({
                    "model": pa.array(np.full(len(head), m), pa.int32()), "node": pa.array(node[head], pa.int32()), "feature": pa.array(np.full(len(head), f), pa.int32()), "bin": pa.array(b[head], pa.int32()),
                    "g": pa.array(np.add.reduceat(g, head), pa.int64()), "h": pa.array(np.add.reduceat(h, head), pa.int64()),
                })

    sums = pieces.mapInArrow(run, "model int, node int, feature int, bin int, g bigint, h bigint").groupBy("model", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))

    def choose(key, t):
        t = t.sort_by([("feature", "ascending"), ("bin", "ascending")])
        f, b, g, h = (t.column(c).to_numpy() for c in ("feature", "bin", "g", "h"))
        total_g, total_h = np.array([g[f == f[0]].sum()]), np.array([h[f == f[0]].sum()])
        best = (-np.inf, 0, 0, 0, 0)
        for k in np.unique(f):
            own = f == k
            gain, at, lg, lh = best_splits(spec, int(k), np.zeros(own.sum(), dtype=np.int64), b[own], g[own], h[own], total_g, total_h)
            if gain[0] > best[0]:
                best = (gain[0], int(k), int(at[0]), int(lg[0]), int(lh[0]))
        row = {"model": key[0].as_py(), "node": key[1].as_py(), "gain": float(best[0]), "feature": best[1], "bin": best[2], "lg": best[3], "lh": best[4], "g": int(total_g[0]), "h": int(total_h[0])}
        return pa.table({k: pa.array([v], pa.float64() if k == "gain" else pa.int64() if k in ("lg", "lh", "g", "h") else pa.int32()) for k, v in row.items()})

    return sums.groupBy("model", "node").applyInArrow(choose, "model int, node int, gain double, feature int, bin int, lg bigint, lh bigint, g bigint, h bigint").collect()


def _median_pass(spec: Spec, pieces: DataFrame, tree_no: int, growing: list[Tree] | None, pending: list[list[Tree]] | None) -> dict[tuple[int, int], int]:
    """(model, leaf) -> weighted median of the whole residuals, digit by digit of 16 bits; without trees, of the labels."""
    prefix: dict[tuple[int, int], int] = {}
    below: dict[tuple[int, int], int] = {}
    total: dict[tuple[int, int], int] = {}
    for shift in (32, 16, 0):
        def run(batches, shift=shift, prefix=dict(prefix)):
            for _, m, x, y, h, rid, pred in _unpacked(spec, batches, pending):
                node = growing[m].walk(x, len(spec.numeric)) if growing else np.zeros(len(y), dtype=np.int64)
                r = whole_residuals(spec, y, pred) + (1 << 47)
                use = taken(spec, rid, tree_no) if growing else np.ones(len(y), dtype=bool)
                if prefix:
                    high = np.full(int(node.max()) + 1, -1, dtype=np.int64)
                    for (mm, k), p in prefix.items():
                        if mm == m and k < len(high):
                            high[k] = p
                    use &= (r >> (shift + 16)) == high[node]
                digit = (r >> shift) & 0xFFFF
                found, back = np.unique((node * 65536 + digit)[use], return_inverse=True)
                if len(found):
                    _, hs, _ = sums_by(back, len(found), h[use], h[use])
                    yield pa.RecordBatch.from_pydict({"model": pa.array(np.full(len(found), m), pa.int32()), "node": pa.array(found >> 16, pa.int32()), "digit": pa.array(found & 0xFFFF, pa.int32()), "h": pa.array(hs, pa.int64())})

        digits = pieces.mapInArrow(run, "model int, node int, digit int, h bigint").groupBy("model", "node", "digit").agg(F.sum("h").alias("h"))
        own = Window.partitionBy("model", "node")
        upto = digits.withColumn("upto", F.sum("h").over(own.orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("h").over(own))  # at most 65,536 digits a leaf
        if shift == 32:
            half = 2 * F.col("upto") >= F.col("all")
            hits = upto.where(half)
        else:
            known = pieces.sparkSession.createDataFrame([(m, k, total[m, k], below[m, k]) for m, k in prefix], "model int, node int, total bigint, below bigint")
            hits = upto.join(F.broadcast(known), ["model", "node"]).where(2 * (F.col("below") + F.col("upto")) >= F.col("total"))
        first = hits.groupBy("model", "node").agg(F.min(F.struct("digit", (F.col("upto") - F.col("h")).alias("before"), "all")).alias("s")).select("model", "node", "s.*").collect()
        for r in first:
            k = (r["model"], r["node"])
            if shift == 32:
                total[k] = r["all"]
            prefix[k] = (prefix.get(k, 0) << 16) | r["digit"]
            below[k] = below.get(k, 0) + r["before"]
    return {k: p - (1 << 47) for k, p in prefix.items() if total[k]}


def _fit_large(rows: DataFrame, spec: Spec, keys: list[str], large: list[tuple], schema: pa.Schema) -> DataFrame:
    n, names = len(large), [_name(k) for k in large]
    bins = _large_bins(rows, spec, n)
    # Sorted by model, so that pieces are full.
    spread = rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())).sortWithinPartitions("__model")
    pieces = checkpoint(spread.mapInArrow(_packed(spec, bins), PACKED), batch_rows=PIECE)
    if spec.squared:
        sums = _sums_pass(spec, pieces)
        base = [mean_of(spec, *sums[m]) if m in sums and sums[m][1] else 0.0 for m in range(n)]
    else:
        found = _median_pass(spec, pieces, -1, None, None)
        base = [found.get((m, 0), 0) / spec.scale for m in range(n)]
    cells = _cells_pass(spec, pieces, n)
    made = _grown_by_level(spec, pieces, names, base) if cells is None else _grown_by_cells(spec, pieces, names, base, cells)
    parts = []
    for m, k in enumerate(large):
        rows_of = node_rows(spec, bins[m], base[m], made[m])
        size = len(rows_of["tree"])
        parts.append(pa.table([pa.array([v] * size, schema.field(c).type) for c, v in zip(keys, k)] + [pa.array(rows_of[c], schema.field(c).type) for c in rows_of], schema=schema))
    return rows.sparkSession.createDataFrame(pa.concat_tables(parts))


def _grown_by_level(spec: Spec, pieces: DataFrame, names: list[str], base: list[float]) -> list[list[Tree]]:
    """The trees of each model, level by level over all rows."""
    n = len(names)
    pending: list[list[Tree]] = [[_constant(b)] for b in base]
    made: list[list[Tree]] = [[] for _ in range(n)]
    for t in range(spec.rounds):
        growing = [Tree.empty(spec.depth) for _ in range(n)]
        for level in range(spec.depth):
            told = _level_pass(spec, pieces, names, t, level, growing, pending)
            for m in range(n):
                own = [r for r in told if r["model"] == m]
                if level == 0 and own:
                    growing[m].value[0] = value_of(spec, own[0]["g"], own[0]["h"])
                a = {c: np.array([r[c] for r in own]) for c in ("node", "feature", "bin", "gain", "lg", "lh", "g", "h")}
                set_splits(spec, growing[m], a["node"], a["feature"], a["bin"], a["gain"], a["lg"], a["lh"], a["g"], a["h"])
            if not told:
                break
        if not spec.squared:
            for (m, k), v in _median_pass(spec, pieces, t, growing, pending).items():
                growing[m].value[k] = spec.rate * (v / spec.scale)
        for m in range(n):
            pending[m].append(growing[m])
            made[m].append(growing[m])
        if len(pending[0]) > REFRESH:
            pieces = checkpoint(pieces.mapInArrow(_written(spec, pending), PACKED), batch_rows=16)
            pending = [[] for _ in range(n)]
    return made


# -- models above task_rows whose rows lie in few cells: a job a tree -----------------------------
def _cells_pass(spec: Spec, pieces: DataFrame, n: int) -> list[np.ndarray] | None:
    """The cells of each model (columns x cells), or None if a model has more than CELLS or all have 16 times that."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rows = len(r["y"]) // 8
                own = cells_of(np.frombuffer(r["x"], dtype=np.int16).astype(np.int32).reshape(len(spec.features), rows))[0] if rows else np.zeros((len(spec.features), 0), dtype=np.int32)
                yield pa.RecordBatch.from_pydict({"model": pa.array(np.full(own.shape[1], r["model"]), pa.int32()), "x": pa.array([c.astype(np.int16).tobytes() for c in own.T], pa.binary())})

    found = checkpoint(pieces.mapInArrow(run, "model int, x binary").distinct(), batch_rows=16)
    sizes = [r["n"] for r in found.groupBy("model").agg(F.count(F.lit(1)).alias("n")).collect()]
    if max(sizes, default=0) > CELLS or sum(sizes) > 16 * CELLS:
        return None
    held: list[list[bytes]] = [[] for _ in range(n)]
    for r in found.collect():  # at most 16 CELLS
        held[r["model"]].append(bytes(r["x"]))
    return [np.array([np.frombuffer(x, dtype=np.int16) for x in sorted(own)], dtype=np.int32).reshape(len(own), len(spec.features)).T for own in held]


def _in_cells(spec: Spec, cells):
    """Pieces with the cell of each row instead of its bins, and whole weights."""

    def run(batches):
        known: dict[int, dict[bytes, int]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                m = r["model"]
                if m not in known:
                    known[m] = {c.astype(np.int16).tobytes(): k for k, c in enumerate(cells.value[m].T)}
                own, at = cells_of(np.frombuffer(r["x"], dtype=np.int16).astype(np.int32).reshape(len(spec.features), len(r["y"]) // 8))
                named = np.array([known[m][c.astype(np.int16).tobytes()] for c in own.T], dtype=np.int32)
                yield pa.RecordBatch.from_pydict({
                    "model": pa.array([m], pa.int32()), "cell": pa.array([named[at].tobytes()], pa.binary()), "y": pa.array([r["y"]], pa.binary()),
                    "h": pa.array([whole_weights(np.frombuffer(r["w"])).tobytes()], pa.binary()), "rid": pa.array([r["rid"]], pa.binary()),
                })

    return run


def _seen(spec: Spec, batches: Iterator[pa.RecordBatch], tree_no: int):
    """(model, cells, labels, whole weights) of the rows that a tree sees, piece by piece."""
    for batch in batches:
        for r in batch.to_pylist():
            rows = np.flatnonzero(taken(spec, np.frombuffer(r["rid"], dtype=np.int64), tree_no))
            yield r["model"], np.frombuffer(r["cell"], dtype=np.int32)[rows], np.frombuffer(r["y"])[rows], np.frombuffer(r["h"], dtype=np.int64)[rows]


def _tree_pass(spec: Spec, pieces: DataFrame, names: list[str], tree_no: int, cells, preds: list[np.ndarray]) -> list[Tree]:
    """The next tree of each model: tasks send the sums of their cells, a model's are added up in one task and its tree grown there."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for m, cell, y, h in _seen(spec, batches, tree_no):
            size = len(preds[m])
            found, g, weight = sums_by(cell, size, gradients(spec, y, preds[m][cell], h), h)
            total = held.setdefault(m, np.zeros((3, size), dtype=np.int64))
            total[0, found] += g
            total[1, found] += weight
            total[2, found] = 1
        for m, total in held.items():
            yield pa.RecordBatch.from_pydict({"model": pa.array([m], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    def added(key, t):
        m = key[0].as_py()
        total = sum(np.frombuffer(b, dtype=np.int64).reshape(3, -1) for b in t.column("sums").to_pylist())
        found = np.flatnonzero(total[2])
        tree = grow_cells(spec, names[m], tree_no, cells.value[m], found, total[0, found], total[1, found])[0]
        kept = np.flatnonzero((tree.feature >= 0) | (tree.value != 0))
        return pa.table({"model": pa.array(np.full(len(kept), m), pa.int32()), "node": pa.array(kept, pa.int32()), "feature": pa.array(tree.feature[kept], pa.int32()), "bin": pa.array(tree.bin[kept], pa.int32()), "gain": pa.array(tree.gain[kept]), "value": pa.array(tree.value[kept])})

    grown = [Tree.empty(spec.depth) for _ in names]
    told = pieces.mapInArrow(run, "model int, sums binary").groupBy("model").applyInArrow(added, "model int, node int, feature int, bin int, gain double, value double")
    for r in told.collect():  # the trees
        tree, k = grown[r["model"]], r["node"]
        tree.feature[k], tree.bin[k], tree.gain[k], tree.value[k] = r["feature"], r["bin"], r["gain"], r["value"]
    return grown


def _leaf_medians(spec: Spec, pieces: DataFrame, tree_no: int, leaves: list[np.ndarray], preds: list[np.ndarray]) -> dict[tuple[int, int], int]:
    """(model, leaf) -> weighted median of the whole residuals: first the step of 2^STEP that it lies in, then its place there."""
    at: dict[tuple[int, int], tuple[int, int, int]] = {}
    for last in (False, True):
        def run(batches, last=last, at=dict(at)):
            steps = [np.full(int(own.max(initial=0)) + 1, 1 << 62, dtype=np.int64) for own in leaves]
            for (m, k), (step, _, _) in at.items():
                steps[m][k] = step
            for m, cell, y, h in _seen(spec, batches, tree_no):
                node, r = leaves[m][cell], whole_residuals(spec, y, preds[m][cell])
                digit = r >> STEP
                if last:
                    use = digit == steps[m][node]
                    node, digit, h = node[use], r[use] & ((1 << STEP) - 1), h[use]
                if not len(digit):
                    continue
                least = int(digit.min())
                wide = int(digit.max()) - least + 1
                found, hs, _ = sums_by(node * wide + digit - least, (int(node.max()) + 1) * wide, h, h)
                yield pa.RecordBatch.from_pydict({"model": pa.array(np.full(len(found), m), pa.int32()), "node": pa.array(found // wide, pa.int32()), "digit": pa.array(found % wide + least, pa.int64()), "h": pa.array(hs, pa.int64())})

        digits = pieces.mapInArrow(run, "model int, node int, digit bigint, h bigint").groupBy("model", "node", "digit").agg(F.sum("h").alias("h"))
        own = Window.partitionBy("model", "node")
        upto = digits.withColumn("upto", F.sum("h").over(own.orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("h").over(own))  # at most 2^STEP digits a leaf
        if last:
            known = pieces.sparkSession.createDataFrame([(m, k, total, below) for (m, k), (_, below, total) in at.items()], "model int, node int, total bigint, below bigint")
            hits = upto.join(F.broadcast(known), ["model", "node"]).where(2 * (F.col("below") + F.col("upto")) >= F.col("total"))
        else:
            hits = upto.where(2 * F.col("upto") >= F.col("all"))
        first = hits.groupBy("model", "node").agg(F.min(F.struct("digit", (F.col("upto") - F.col("h")).alias("before"), "all")).alias("s")).select("model", "node", "s.*").collect()
        if last:
            return {(r["model"], r["node"]): (at[r["model"], r["node"]][0] << STEP) + r["digit"] for r in first}
        at = {(r["model"], r["node"]): (r["digit"], r["before"], r["all"]) for r in first if r["all"]}
        if not at:
            break
    return {}


def _grown_by_cells(spec: Spec, packed: DataFrame, names: list[str], base: list[float], cells: list[np.ndarray]) -> list[list[Tree]]:
    """The trees of each model: rows of one cell have one prediction, so a tree takes one pass, and leaves of absolute errors two more."""
    spark = packed.sparkSession
    sent = spark.sparkContext.broadcast(cells)
    pieces = checkpoint(packed.mapInArrow(_in_cells(spec, sent), "model int, cell binary, y binary, h binary, rid binary"), batch_rows=16)
    preds = [np.full(own.shape[1], b) for own, b in zip(cells, base)]
    made: list[list[Tree]] = [[] for _ in names]
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, "16")
    try:
        for t in range(spec.rounds):
            grown = _tree_pass(spec, pieces, names, t, sent, preds)
            leaves = [tree.walk(own, len(spec.numeric)) for tree, own in zip(grown, cells)]
            if not spec.squared:
                for (m, k), v in _leaf_medians(spec, pieces, t, leaves, preds).items():
                    grown[m].value[k] = spec.rate * (v / spec.scale)
            for m, tree in enumerate(grown):
                preds[m] = preds[m] + tree.value[leaves[m]]
                made[m].append(tree)
    finally:
        spark.conf.set(BATCH_ROWS, before)
        sent.unpersist()
    return made


def _constant(value: float) -> Tree:
    tree = Tree.empty(0)
    tree.value[0] = value
    return tree


def _written(spec: Spec, pending: list[list[Tree]]):
    def run(batches):
        for r, *_, pred in _unpacked(spec, batches, pending):
            yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.int32() if k == "model" else pa.binary()) for k, v in (r | {"pred": pred.tobytes()}).items()})

    return run


# -- predictions ----------------------------------------------------------------------------------
def predict(rows: DataFrame, nodes: DataFrame, spec: Spec, *, keys: list[str], keep: list[str], piece_rows: int = 200_000) -> DataFrame:
    """keys, keep and prediction of the rows whose model there is.

    Rows of a model are scored in pieces, each of which meets the model's nodes once.
    """
    pieces = checkpoint(rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / piece_rows).cast("int").alias("__pieces")))
    placed = _same(rows.select(*keys, *keep, *(c for c in spec.features if c not in (*keys, *keep))), pieces, keys).withColumn("__piece", F.pmod(F.xxhash64(*keep), F.col("__pieces")).cast("int")).drop("__pieces")
    copies = _same(nodes, pieces, keys).withColumn("__piece", F.explode(F.sequence(F.lit(0), F.col("__pieces") - 1))).drop("__pieces")
    copies = copies.withColumnsRenamed({k: f"__m_{k}" for k in [*keys, "__piece"]})
    kinds = dict(rows.dtypes)
    named = list(dict.fromkeys([*keys, *keep]))
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in named) + ", prediction double"

    def score(t, model):
        if not t.num_rows or not model.num_rows:
            return t.slice(0, 0).select(named).append_column("prediction", pa.array([], pa.float64()))
        numbers, categories = _columns(spec, t)
        out = np.zeros(t.num_rows)
        m = {c.split()[0]: model.column(c.split()[0]).to_pylist() for c in NODES.split(", ")}
        values: list[dict] = [{} for _ in spec.categorical]
        for f, v in zip(m["feature"], m["category"]):
            if v is not None:
                values[spec.categorical.index(f)].setdefault(v, len(values[spec.categorical.index(f)]))
        codes = Bins([], [list(v) for v in values]).of([], categories, t.num_rows)
        x = np.vstack([np.array(numbers, dtype=np.float64).reshape(len(spec.numeric), t.num_rows), codes])
        trees: dict[int, list[int]] = {}
        for i, k in enumerate(m["tree"]):
            trees.setdefault(k, []).append(i)
        for k in sorted(trees):
            own = trees[k]
            size = max(m["node"][i] for i in own) + 1
            feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            for i in own:
                at, name = m["node"][i], m["feature"][i]
                if name is None:
                    value[at] = m["value"][i]
                else:
                    feature[at] = spec.features.index(name)
                    cut[at] = m["threshold"][i] if m["category"][i] is None else values[spec.categorical.index(name)][m["category"][i]]
            at, left = np.zeros(t.num_rows, dtype=np.int64), np.arange(t.num_rows)
            while len(left):
                f = feature[at[left]]
                left, f = left[f >= 0], f[f >= 0]
                mine, edge = x[f, left], cut[at[left]]
                at[left] = 2 * at[left] + np.where(np.where(f < len(spec.numeric), mine <= edge, mine == edge), 1, 2)
            out = out + value[at]
        return t.select(named).append_column("prediction", pa.array(out))

    return placed.groupBy(*keys, "__piece").cogroup(copies.groupBy(*(f"__m_{k}" for k in [*keys, "__piece"]))).applyInArrow(score, schema)


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the other columns of right, by keys that may be null."""
    other = right.withColumnsRenamed({k: f"__j_{k}" for k in keys})
    on = left[keys[0]].eqNullSafe(other[f"__j_{keys[0]}"])
    for k in keys[1:]:
        on = on & left[k].eqNullSafe(other[f"__j_{k}"])
    return left.join(other, on).drop(*(f"__j_{k}" for k in keys))
