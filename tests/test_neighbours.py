"""Exact nearest neighbours that leave out blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsloom.operators import similarity


def brute(test, train, k, windows=False):
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    out = {}
    for q, v, w in test:
        sims = sorted((-round(float(unit(v) @ unit(x)), 9) + 0.0, i) for i, x, lo, hi, _ in train if lo <= w <= hi)
        out[w, q] = [i for _, i in sims[:k]]
    return out


def found(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: r["rank"]):
        out.setdefault((r.w, r["query"]), []).append(r.neighbour)
    return out


def counted(monkeypatch):
    """Pairs of blocks that are multiplied, and of blocks that there are."""
    pairs, blocks, multiplied, near = [], [], similarity._multiplied, similarity._near_blocks

    def count_pairs(p, *args):
        pairs.append(p.count())
        return multiplied(p, *args)

    def count_blocks(*args):
        out = near(*args)
        blocks.append(out[0].count())
        return out

    monkeypatch.setattr(similarity, "_multiplied", count_pairs)
    monkeypatch.setattr(similarity, "_near_blocks", count_blocks)
    return pairs, blocks


@pytest.mark.parametrize("clusters", [40, 0])
def test_neighbours_by_brute_force(spark, monkeypatch, clusters):
    """Clustered and unclustered vectors with ties, copies and zero vectors: the same rows; of clustered blocks few meet."""
    monkeypatch.setattr(similarity, "BLOCK", 32)
    monkeypatch.setattr(similarity, "CHUNK", 8)
    rng = np.random.default_rng(clusters)
    centres = rng.normal(size=(max(1, clusters), 12))

    def vectors(n):
        v = centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, 12)) * 0.05 if clusters else rng.normal(size=(n, 12))
        v[: n // 20] = v[n // 2]
        v[n // 20 : n // 20 + 3] = 0
        return v.round(3).tolist()

    train = [(i, v, 0, 0, float(i)) for i, v in enumerate(vectors(1500))]
    test = [(i, v, 0) for i, v in enumerate(vectors(700))]
    pairs, blocks = counted(monkeypatch)
    a = spark.createDataFrame(test, "q bigint, v array<double>, w int").repartition(3)
    b = spark.createDataFrame(train, "i bigint, v array<double>, lo int, hi int, y double").repartition(3)
    got = similarity.dense_neighbours(a, b.withColumns({"w": F.lit(0), "q": F.col("i")}), key="q", vector="v", value="y", group="w", k=4)
    assert found(got) == brute(test, train, 4)
    if clusters:
        assert sum(pairs) < blocks[0] * blocks[1] / 5, (pairs, blocks)


def test_windows_and_few_rows(spark, monkeypatch):
    """Windows with fewer training rows than k, with none, and groups apart; an empty side."""
    monkeypatch.setattr(similarity, "BLOCK", 16)
    rng = np.random.default_rng(5)
    train = [(i, rng.normal(size=4).round(2).tolist(), int(lo), int(lo) + int(n), 1.0) for i, (lo, n) in enumerate(zip(rng.integers(0, 9, 150), rng.integers(-1, 3, 150)))] + [(900, [1.0, 0.0, 0.0, 0.0], 30, 30, 2.0)]
    test = [(i, rng.normal(size=4).round(2).tolist(), int(w)) for i, w in enumerate(rng.integers(0, 12, 90))] + [(800, [0.0, 1.0, 0.0, 0.0], 30), (801, [1.0, 0.0, 0.0, 0.0], 40)]
    a = spark.createDataFrame(test, "q bigint, v array<double>, w int")
    b = spark.createDataFrame(train, "q bigint, v array<double>, lo int, hi int, y double")
    options = {"key": "q", "vector": "v", "value": "y", "window": "w", "lo": F.col("lo"), "hi": F.col("hi"), "k": 3}
    assert found(similarity.windowed_neighbours(a, b, **options)) == {k: v for k, v in brute(test, train, 3).items() if v}
    assert similarity.windowed_neighbours(a, b.limit(0), **options).count() == 0
    assert similarity.windowed_neighbours(a.limit(0), b, **options).count() == 0


@pytest.mark.parametrize("group", [None, "g"])
def test_copies_of_a_text_meet_once(spark, monkeypatch, group):
    """Many copies of few texts: the neighbours of all pairs, with ties by id across copies and texts, from one row a text."""
    words = ["red", "blue", "hot", "cold", "ring", "bolt"]
    texts = [(i, i % 2, [words[i * 7 % 4], words[4 + i * 5 % 3 % 2], words[i % 3]], float(i)) for i in range(240)]
    rows = spark.createDataFrame(texts, "key bigint, g int, words array<string>, y double").select("key", "g", "y", F.explode("words").alias("term")).groupBy("key", "g", "y", "term").agg(F.count(F.lit(1)).alias("tf"))
    train, test = rows.where("key % 3 <> 0"), rows.where("key % 3 = 0")
    met = []
    nearest = similarity._nearest
    monkeypatch.setattr(similarity, "_nearest", lambda a, b, *more: met.append((a.count(), b.count())) or nearest(a, b, *more))
    found = similarity.tfidf_neighbours(train, test, k=4, group=group, value="y")
    got = {}
    for r in found.orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.neighbour, round(r.similarity, 6), r.value))
    assert met[0][0] <= 24 and met[0][1] <= 24

    def vectors(part, idf):
        out = {}
        for i, gg, ws, _ in part:
            w = {t: ws.count(t) * idf[gg if group else 0][t] for t in set(ws) if t in idf[gg if group else 0]}
            n = sum(x * x for x in w.values()) ** 0.5
            out[i] = {t: x / n for t, x in w.items()}
        return out

    known, asked = [t for t in texts if t[0] % 3], [t for t in texts if t[0] % 3 == 0]
    idf = {}
    for gg in (0, 1):
        own = [t for t in known if not group or t[1] == gg]
        idf[gg] = {w: np.log((1 + len(own)) / (1 + sum(w in t[2] for t in own))) + 1 for w in words if any(w in t[2] for t in own)}
    a, b = vectors(asked, idf), vectors(known, idf)
    for i, gg, *_ in asked:
        sims = [(round(sum(x * b[j].get(t, 0.0) for t, x in a[i].items()), 9), j) for j, hh, *_ in known if not group or gg == hh]
        want = sorted(((-s, j) for s, j in sims if s >= 1e-9))[:4]
        assert got.get(i, []) == [(j, round(-s, 6), float(j)) for s, j in want]


def test_blocks_travel_in_packs(spark, monkeypatch):
    """A pair of packs leaves k candidates a query, whatever the number of blocks; small packs and single precision give the same rows."""
    monkeypatch.setattr(similarity, "BLOCK", 32)
    rng = np.random.default_rng(5)
    train = [(i, v, 0, 0, float(i)) for i, v in enumerate(rng.integers(-2, 3, (600, 8)).astype(float).tolist())]
    test = [(i, v, 0) for i, v in enumerate(rng.integers(-2, 3, (200, 8)).astype(float).tolist())]
    left, multiplied = [], similarity._multiplied

    def count_left(*args):
        out = multiplied(*args)
        left.append(out.count())
        return out

    monkeypatch.setattr(similarity, "_multiplied", count_left)
    a = spark.createDataFrame(test, "q bigint, v array<float>, w int").repartition(3)
    b = spark.createDataFrame(train, "i bigint, v array<float>, lo int, hi int, y double").repartition(3)
    options = {"key": "q", "vector": "v", "value": "y", "group": "w", "k": 4}
    expected = brute(test, train, 4)
    assert found(similarity.dense_neighbours(a, b.withColumns({"w": F.lit(0), "q": F.col("i")}), **options)) == expected
    assert all(n <= 4 * 200 for n in left), left  # one pack each
    monkeypatch.setattr(similarity, "PACK", 4 * 8 * 64)
    assert found(similarity.dense_neighbours(a, b.withColumns({"w": F.lit(0), "q": F.col("i").cast("string")}), **(options | {"k": 700}))).keys() == expected.keys()
