"""Boosted trees against plain Python, and both ways of growing them against each other."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsloom.operators import boosting, models, ranks, windows

SCHEMA = "model string, a double, b double, c string, label double, weight double, rid bigint"


def rows_of(n: int, models=("m", "n", None), seed: int = 1):
    r = random.Random(seed)
    out = []
    for k in range(n):
        a, b, c = float(r.randint(0, 30)), r.choice([0.0, 1.5, 1.5, 7.25]), r.choice(["", "x", "y", "zé", "rare%d" % (k % 40)])
        out.append((r.choice(models), a, b, c, round(3 * (a > 11) + 2 * (c == "x") * b + r.random(), 3), r.choice([1.0, 0.5, 0.25]), k * 7919))
    return out


# -- a tree in plain Python -----------------------------------------------------------------------
def plain_trees(rows, spec: boosting.Spec, name: str):
    """[(tree, node, column, threshold or category, value)] by trying every split on every row."""
    y, h, rid = [r[4] for r in rows], [round(r[5] * boosting.UNIT) for r in rows], np.array([r[6] for r in rows])
    scale, tenth = spec.scale, lambda x: round(x * spec.scale)
    numbers = {f: [r[1 + k] for r in rows] for k, f in enumerate(("a", "b")) if f in spec.numeric}
    cuts = {f: sorted({sorted(v)[(k * len(v) + spec.bins - 1) // spec.bins - 1] for k in range(1, spec.bins)} - {max(v)}) for f, v in numbers.items()}
    counts = defaultdict(int)
    for r in rows:
        counts[r[3]] += 1
    known = sorted(v for v, n in counts.items() if n >= spec.floor)

    def median(values):
        values, upto, total = sorted(values), 0, sum(w for _, w in values)
        for v, w in values:
            upto += w
            if 2 * upto >= total:
                return v

    base = median([(tenth(v), w) for v, w in zip(y, h)]) / scale if not spec.squared else sum(round(v * (w / boosting.UNIT) * scale) for v, w in zip(y, h)) / scale / (sum(h) / boosting.UNIT)
    pred, out = [base] * len(rows), [(-1, 0, None, None, base)]
    unit = scale if spec.squared else boosting.UNIT
    score = lambda g, w: (g / unit) ** 2 / (w / boosting.UNIT + spec.penalty)
    for t in range(spec.rounds):
        sign = lambda v: (v > 0) - (v < 0)
        g = [round((v - p) * (w / boosting.UNIT) * scale) if spec.squared else sign(v - p) * w for v, p, w in zip(y, pred, h)]
        seen = set(np.flatnonzero(boosting.taken(spec, rid, t)).tolist())
        allowed = [spec.features[k] for k in boosting.columns_of(spec, name, t)]

        def node(k, all_rows, level):
            mine = [i for i in all_rows if i in seen]
            tg, th = sum(g[i] for i in mine), sum(h[i] for i in mine)
            best = None
            for f in allowed if level < spec.depth else ():
                for at in known if f == "c" else cuts[f]:
                    left = [i for i in mine if (rows[i][3] == at if f == "c" else numbers[f][i] <= at)]
                    lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                    if min(lh, th - lh) >= spec.least * boosting.UNIT:
                        gain = 0.5 * (score(lg, lh) + score(tg - lg, th - lh) - score(tg, th))
                        if best is None or gain > best[0]:
                            best = (gain, f, at)
            if best is None or best[0] <= spec.gamma:
                value = spec.rate * (tg / unit) / (th / boosting.UNIT + spec.penalty)
                if not spec.squared and mine:
                    value = spec.rate * (median([(tenth(y[i] - pred[i]), h[i]) for i in mine]) / scale)
                out.append((t, k, None, None, value))
                return {i: value for i in all_rows}
            _, f, at = best
            out.append((t, k, f, at, None))
            inside = [i for i in all_rows if (rows[i][3] == at if f == "c" else numbers[f][i] <= at)]
            return node(2 * k + 1, inside, level + 1) | node(2 * k + 2, [i for i in all_rows if i not in set(inside)], level + 1)

        added = node(0, range(len(rows)), 0)
        pred = [p + added[i] for i, p in enumerate(pred)]
    return sorted(out, key=lambda r: r[:2]), pred


def told(nodes):
    out = defaultdict(list)
    for r in nodes.collect():
        out[r.model].append((r.tree, r.node, r.feature, r.threshold if r.category is None else r.category, r.value))
    return {k: sorted(v, key=lambda r: r[:2]) for k, v in out.items()}


@pytest.mark.parametrize("squared", [True, False])
@pytest.mark.parametrize("bins", [256, 5])
def test_trees_by_hand(spark, squared, bins):
    """The same columns, cuts and leaves as plain Python finds by trying every split; the large way gives the same nodes."""
    rows = rows_of(240)
    spec = boosting.Spec(rounds=3, depth=3, rate=0.3, bins=bins, squared=squared, gamma=0.01, numeric=("a", "b"), categorical=("c",))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    small = told(boosting.fit(df, spec, keys=["model"]))
    spec = boosting.Spec(**(spec.__dict__ | {"scale": boosting.scale_of(max(abs(r[4]) for r in rows))}))
    for m in ("m", "n", None):
        want, pred = plain_trees([r for r in rows if r[0] == m], spec, m or "")
        assert [r[:4] for r in small[m]] == [r[:4] for r in want]
        assert [r[4] for r in small[m] if r[4] is not None] == pytest.approx([r[4] for r in want if r[4] is not None], abs=1e-9)
    assert told(boosting.fit(df, spec, keys=["model"], task_rows=60)) == small
    scored = boosting.predict(df, boosting.fit(df, spec, keys=["model"]), spec, keys=["model"], keep=["rid", "label"], piece_rows=30).collect()
    assert len(scored) == len(rows)
    want = dict(zip([r[6] for r in rows if r[0] == "m"], plain_trees([r for r in rows if r[0] == "m"], spec, "m")[1]))
    assert {r.rid: pytest.approx(r.prediction, abs=1e-9) for r in scored if r.model == "m"} == want


def test_refreshed_predictions(spark):
    """More trees than are held between two writings, and a mix of small and large models."""
    rows = rows_of(300, models=("m", "m", "m", "n"))
    spec = boosting.Spec(rounds=boosting.REFRESH + 3, depth=2, numeric=("a",), categorical=("c",))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert told(boosting.fit(df, spec, keys=["model"], task_rows=100)) == told(boosting.fit(df, spec, keys=["model"]))


def test_odd_training_rows(spark):
    """One row, no columns, equal labels, no rows; rows without a model get no prediction."""
    df = spark.createDataFrame([("m", 1.0, 0.0, "", 4.5, 1.0, 1), ("n", 1.0, 0.0, "x", -2.0, 1.0, 2), ("n", 2.0, 0.0, "x", -2.0, 0.0, 3)], SCHEMA)
    for spec in (boosting.Spec(rounds=2, depth=2, numeric=("a", "b"), categorical=("c",)), boosting.Spec(rounds=1, depth=1)):
        nodes = boosting.fit(df, spec, keys=["model"])
        other = df.union(df.limit(1).withColumn("model", F.lit("none")))
        got = {(r.model, r.rid): r.prediction for r in boosting.predict(other, nodes, spec, keys=["model"], keep=["rid"]).collect()}
        assert got == {("m", 1): pytest.approx(4.5), ("n", 2): pytest.approx(-2.0), ("n", 3): pytest.approx(-2.0)}
        assert boosting.fit(df.limit(0), spec, keys=["model"]).count() == 0
    assert math.isclose(boosting.scale_of(1.0), 2.0**30)


def test_grouped_quantiles(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.choice([None, float(r.randint(0, 9)), r.random()])) for _ in range(500)] + [("one", 3.0), ("none", None)]
    at = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {x.k: x.q for x in ranks.grouped_quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", at).collect()}
    want = {k: [float(np.quantile([v for g, v in rows if g == k and v is not None], q)) for q in at] for k in ("a", "b", None, "one")}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_absolute_errors_follow_the_median(spark):
    """A tenth of the jobs runs a hundred times as long: squared errors are drawn to them, absolute ones are not."""
    rows = [(i, (i % 7) * 3600 + 60.0 * i, 100.0 if i % 10 else 10000.0, "q") for i in range(400)]
    j = spark.createDataFrame(rows, "job_id bigint, at double, runtime_seconds double, queue string").withColumn("submit_time", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("job_id") * 1800))
    j = j.withColumn("end_time", F.expr("submit_time + interval 100 seconds")).drop("at")
    g = windows.grid(j, n_windows=3, hours=6, lookback_days=5)
    options = {"maxIter": 20, "maxDepth": 2, "stepSize": 0.3}
    median = models.rolling_boosted(j, g, objective="absolute", **options).agg(F.avg("y_pred")).first()[0]
    mean = models.rolling_boosted(j, g, **options).agg(F.avg("y_pred")).first()[0]
    assert median == pytest.approx(100.0, abs=1) and mean > 500


@pytest.mark.parametrize("squared", [True, False])
def test_large_models_by_cells_and_by_level(spark, monkeypatch, squared):
    """Few cells: a pass a tree, no pass a level; the same trees as in memory and as level by level."""
    df = spark.range(400).select((F.col("id") % 2).cast("int").alias("model"), (F.col("id") * 37 % 11 * 1.0).alias("a"), F.concat(F.lit("c"), (F.col("id") % 5).cast("string")).alias("c"), (F.col("id") * 7919 % 211 * 1.5).alias("label"), (1.0 / (1 + F.col("id") % 3)).alias("weight"), F.col("id").alias("rid"))
    spec = boosting.Spec(rounds=4, depth=3, squared=squared, numeric=("a",), categorical=("c",))
    told = lambda d: sorted(map(repr, d.collect()))
    levels = []
    level_pass = boosting._level_pass
    monkeypatch.setattr(boosting, "_level_pass", lambda *a: levels.append(1) or level_pass(*a))
    small = told(boosting.fit(df, spec, keys=["model"]))
    assert told(boosting.fit(df, spec, keys=["model"], task_rows=100)) == small and not levels
    monkeypatch.setattr(boosting, "CELLS", 3)
    assert told(boosting.fit(df, spec, keys=["model"], task_rows=100)) == small and levels
