"""Suffix, line and Jaccard deduplication against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsloom.llm import graph, jaccard, linededup
from opsloom.llm import suffixdedup as sd
from opsloom.llm.common import Stages, settings

from llm_samples import prose


def brute_repeats(docs):
    first, out = {}, []
    for i, text in sorted(docs, key=lambda d: sd.NOBODY if d[0] is None else d[0]):
        key, b = sd.NOBODY if i is None else i, (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            if first.get(w, key) < key:
                gone[p : p + 50] = b"\1" * 50
            else:
                first.setdefault(w, key)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
    return Counter(out)


def found_repeats(df, **options):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.find_repeats(df, **options).collect())


@pytest.mark.parametrize("block,part,fan,hot", [(300, 900, 256, 1 << 14), (300, 500, 4, 1 << 14), (1000, 3000, 2, 1), (3000, 5000, 3, 0), (1 << 20, 1 << 20, 256, 2)])
def test_suffixes(spark, block, part, fan, hot):
    """One level and several, without hot grams, with some, and with all."""
    r = random.Random(5)
    base = prose(9, 400)
    docs = []
    for i in range(60):
        t = prose(100 + i, r.randint(0, 60))
        if r.random() < 0.6:
            s = r.randint(0, len(base) - 200)
            t = t[: len(t) // 2] + base[s : s + r.randint(40, 200)] + t[len(t) // 2 :]
        if r.random() < 0.2:
            t += "é" * r.randint(0, 80) + "a" * r.randint(0, 150)
        docs.append((i, t))
    docs += [(60, docs[3][1]), (61, "ab" * 100), (62, "x" + "ab" * 60), (63, base), (64, "\0" * 70), (65, "q" + "\0" * 60)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    assert found_repeats(df, block_bytes=block, part_bytes=part, fan=fan, hot=hot) == brute_repeats(docs)


def test_many_records_of_a_gram():
    """In arrays as one by one: the strings of records that share a gram, also those that go alone."""
    r = random.Random(7)
    gram = bytes(r.randrange(256) for _ in range(16))
    records = set()
    for _ in range(300):
        before, after = bytes(r.choice(b"ab") for _ in range(r.randint(0, 34))), bytes(r.choice(b"ab") for _ in range(34))
        text = before + gram + after
        if len(text) >= 50:
            records.add((text[len(before) :] + before[::-1]).ljust(sd.LONGEST, b"\0") + bytes((len(before), len(text))))
        records.add((gram + after).ljust(sd.LONGEST, b"\0") + bytes((sd.ALONE, 50)))
    records = sorted(records)
    docs = [r.randrange(1000) for _ in records]
    assert sd.least_of_many(records, docs) == sd.least_of_strings(records, docs)


def test_pieces_grow_with_the_text():
    """Blocks of 6 MB in ranges of 16 MB: at no level does a group's pieces outgrow the fan, whatever the corpus."""
    for blocks in (1, 80, 300, 5000, 10**5, 2 * 10**7):
        lv = sd.levels(blocks, blocks * (6 << 20), 16 << 20, 256)
        assert lv.groups[-1] == 1 and all(b % a == 0 for a, b in zip(lv.ranges, lv.ranges[1:]))
        runs, pieces = blocks, 0
        for level, (g, r) in enumerate(zip(lv.groups, lv.ranges)):
            sent = runs * (r if level == 0 else r // lv.ranges[level - 1] * lv.ranges[level - 1])
            pieces += sent
            runs = g
        assert pieces <= 110 * blocks * len(lv.groups) + 10 and len(lv.groups) <= 4


def test_suffixes_of_odd_input(odd, nothing):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert found_repeats(odd, block_bytes=500, part_bytes=20_000) == brute_repeats(docs)
    assert sd.find_repeats(nothing).count() == 0


def test_merge_equals_sort():
    r = random.Random(1)
    runs = []
    for _ in range(7):
        rows = sorted({bytes(r.choice(b"ab") for _ in range(sd.LONGEST)) + bytes((3, 80)) for _ in range(r.randint(0, 40))} | {b"a" * sd.LONGEST + bytes((0, 60))})
        rows = rows if r.random() > 0.2 else []
        lcp = [0] + [sd.first_difference(x, y, 0) for x, y in zip(rows, rows[1:])]
        runs.append([(x, n, k) for k, (x, n) in enumerate(zip(rows, lcp))])
    got = list(sd.merge([iter(x) for x in runs]))
    assert [g[0] for g in got] == sorted(x[0] for run in runs for x in run)
    assert all(g[1] == sd.first_difference(p[0], g[0], 0) for p, g in zip(got, got[1:]))


def brute_links(docs, size, percent):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_links_around_the_threshold(spark, size, percent):
    r = random.Random(size)
    docs = []
    for base in range(60):
        words = prose(1000 + base, r.choice([3, 5, 8, 12, 20, 30, 60, 70, 120, 400])).split()
        for _ in range(4):
            w = list(words)
            for _ in range(r.randint(0, max(1, len(w) // 30))):
                w[r.randrange(len(w))] = r.choice(["changed", "other", "words"])
            if r.random() < 0.5:
                w = w[r.randint(0, len(w) // 10) :]
            docs.append((len(docs) * 3 + 1, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(df, words=size, percent=percent).collect()}
    assert got == brute_links(docs, size, percent)


def test_search_finds_links_that_no_star_has(spark):
    """A chain: each document links with the next only, and all share keys with the first."""
    words = [f"w{k}" for k in range(300)]
    docs = [(k, " ".join(words[6 * k : 6 * k + 200])) for k in range(15)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(df).collect()} == brute_links(docs, 4, 85)


def test_keys_lose_no_pair():
    r = np.random.default_rng(3)
    keys = jaccard.Keys(85)
    for n in (5, 7, 12, 30, 60, 64, 90, 200, 700, 3000):
        for _ in range(30):
            a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
            spare = int(0.15 * len(a) / 0.85)
            drop, add = (int(x) for x in r.multinomial(spare, [0.5, 0.5]))
            b = np.unique(np.concatenate([a[drop:], r.integers(0, 1 << 63, add).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 85 * (len(a) + len(b) - common) and not np.array_equal(a, b):
                assert len(np.intersect1d(keys.of(a), keys.of(b)))


def test_tree_bound_keeps_all_pairs():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 400, 80).astype(np.uint64)) for _ in range(150)]
    points, size = jaccard.points_of([jaccard.vector(s).tobytes() for s in sets]), np.array([len(s) for s in sets])
    tree = jaccard.RTree(points)
    kept = {(int(x), int(y)) for xs, ys in tree.pairs(tree, size, size, 30) for x, y in zip(xs, ys)}
    linked = {(i, j) for i in range(150) for j in range(150) if len(np.intersect1d(sets[i], sets[j])) >= jaccard.needed(size[i], size[j], 30)}
    assert linked <= kept


def test_hot_key_costs_few_rows(spark):
    """100,000 documents under one key: rows grow with those outside the key's largest component."""
    n, outside = 100_000, 300
    placed = spark.range(n).selectExpr("7L AS key", "id AS doc_id", f"IF(id % {n // outside} = 1, id, 0) AS component").union(spark.range(n, n + 10).selectExpr("8L", "id", f"{n}L"))
    keys = jaccard._open_keys(placed)
    (row,) = keys.collect()
    assert (row.key, row.n, row.main) == (7, n, 0) and outside - 5 <= row.outside <= outside + 5
    blocks = jaccard._blocks(placed, keys)
    assert blocks.count() < 1.3 * n
    most = blocks.groupBy("i", "j").count().agg(F.max("count")).first()[0]
    assert most < 1.2 * (jaccard.BLOCK + outside)
    met = blocks.where("side = 0").select("i", "j", "doc_id").join(blocks.where("side = 1").select("i", "j", F.col("doc_id").alias("v")), ["i", "j"])
    assert met.count() == row.outside * n  # each of those outside meets all once
    pivots = [{r.u, r.v} for r in jaccard._pivots(placed, keys, 0).collect()]
    (pivot,) = set.intersection(*pivots)
    assert len(pivots) == row.outside and pivot % (n // outside) != 1


@pytest.fixture
def eager_skew(spark):
    """Settings under which small tables are split as large ones would be."""
    values = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    with settings(spark, **values):
        yield


def split(df):
    """Does the plan that ran split a hot key?"""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_are_split(spark, eager_skew):
    """The joins on line hashes, on keys of the Jaccard join, on sets of copies and on the nodes of a star."""
    stages = Stages(spark)
    hot = F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 5000)  # two thirds have one key
    base = stages.write("base", spark.range(0, 60_000, 1, 12).select("id", hot.alias("a"), (hot * 3).alias("b")))
    assert split(base.join(linededup._ranks(stages, "ranks", base), ["a", "b"]))
    placed = stages.write("placed", base.select(F.col("a").alias("key"), F.col("id").alias("doc_id"), (F.col("id") % 1000).alias("component")))
    keys = stages.write("keys", jaccard._open_keys(placed))
    assert split(placed.join(keys, "key"))
    least = stages.write("least", base.groupBy("a").agg(F.min("id").alias("m")))
    assert split(base.join(least, "a"))
    stages.drop("base", "ranks", "placed", "keys", "least")


def test_near_copies_under_hot_keys(spark, monkeypatch):
    """Small blocks, so that a few hundred near copies make large keys; no link is lost in the rounds or the search."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    r = random.Random(11)
    docs = []
    for base in range(3):
        words = prose(500 + base, 60).split()
        for _ in range(90):
            w = list(words)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice("abcdefgh") * 3
            docs.append((len(docs) * 2 + 5, " ".join(w)))
    docs += [(1000 + k, prose(500, 25) + " " + prose(700 + k, r.randint(3, 30))) for k in range(80)]
    r.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(df).collect()}
    assert got == brute_links(docs, 4, 85) and len({c for _, c in got.values()}) > 5


def test_common_tokens_of_small_sets(spark, monkeypatch):
    """Many small unlike sets with one passage in common, some with a near copy: no link is lost, and the search meets few of them."""
    monkeypatch.setattr(jaccard, "BLOCK", 64)
    monkeypatch.setattr(jaccard, "CROWD", 8)
    made, blocks = [], jaccard._blocks

    def counted(*args):
        out = blocks(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_blocks", counted)
    for percent, words, sizes in ((85, 4, (300, 600)), (40, 2, (150,))):
        for n in sizes:
            r = random.Random(n)
            docs = []
            for k in range(n):
                own = [f"w{r.randrange(10**6)}" for _ in range(r.choice([1, 2, 12, 14]))]
                docs.append((k, " ".join(["all", "rights", "are", "reserved", *own])))
                if k % 9 == 0:
                    docs.append((5000 + k, docs[-1][1] + " tail"))
            df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
            got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(df, words=words, percent=percent).collect()}
            assert got == brute_links(docs, words, percent)
        if percent == 85:
            assert made[1] < 3 * made[0] + 200


@pytest.mark.parametrize("bare", [True, False])
def test_ids_of_every_size(spark, bare):
    """The least and the largest bigint are ids like others, also beside rows without one."""
    top, low = (1 << 63) - 1, -(1 << 63)
    rows = [(top, prose(1, 40)), (top - 1, prose(1, 40) + " x"), (low, prose(2, 40)), (0, prose(2, 40) + " x"), ((1 << 62) + 5, prose(3, 40)), ((1 << 62) + 9, prose(3, 40) + " x"), ((1 << 62) - 1, prose(4, 40)), ((1 << 62) + 7, None)]
    rows += [] if bare else [(None, prose(1, 40)), (None, prose(5, 40)), (None, prose(4, 40) + " x"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = Counter((r.doc_id, r.component_id) for r in jaccard.link(df).collect())
    want = [(top, top - 1), (top - 1, top - 1), (low, low), (0, low), ((1 << 62) + 5, (1 << 62) + 5), ((1 << 62) + 9, (1 << 62) + 5), ((1 << 62) - 1, (1 << 62) - 1), ((1 << 62) + 7, (1 << 62) + 7)]
    assert got == Counter(want + ([] if bare else [(None, top - 1), (None, None), (None, (1 << 62) - 1), (None, None)]))
    kept = Counter(r.doc_id for r in jaccard.keep_one(df).collect())
    assert kept == Counter([top - 1, low, (1 << 62) + 5, (1 << 62) - 1, (1 << 62) + 7] + ([] if bare else [None, None]))


def test_repeated_ids(spark):
    """Rows of one doc_id are one node, for which the smallest of their texts stands."""
    rows = [(1, prose(1, 60)), (2, prose(1, 60) + " x"), (2, "~ " + prose(7, 60)), (3, prose(7, 60)), (4, prose(4, 60)), (4, prose(4, 60)), (5, prose(4, 60) + " y")]
    for a, b in ((rows, 1), (rows[::-1], 1)):
        got = Counter((r.doc_id, r.component_id) for r in jaccard.link(spark.createDataFrame(a, "doc_id bigint, text string").repartition(3)).collect())
        assert got == Counter([(1, 1), (2, b), (2, b), (3, 3), (4, 4), (4, 4), (5, 4)])


def test_links_of_odd_input(spark, odd, nothing):
    rows = jaccard.link(odd).collect()
    assert len(rows) == odd.count()
    got = {r.doc_id: r.component_id for r in rows}
    assert got[1] == got[3] == got[9] == got[None] == 1 and got[4] == 4 and got[5] == 5 and got[6] == 6
    assert jaccard.link(nothing).count() == 0
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, 4, 5, 6, 7, 8, 10, 11}
    rows = [(None, prose(5, 40)), (None, prose(5, 40)), (None, prose(5, 40) + " x"), (None, None), (None, ""), (None, ""), (7, prose(6, 40)), (None, prose(6, 40))]
    named = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = jaccard.keep_one(named).collect()
    assert Counter((r.doc_id, bool(r.text)) for r in left) == Counter({(None, True): 1, (None, False): 3, (7, True): 1})
    assert {r.component_id for r in jaccard.link(named).collect()} == {None, 7}


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 700)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    near = defaultdict(set)
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)
    expected, seen = {}, set()
    for s in sorted(near):
        todo = [s]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                expected[x] = s
                todo += near[x]
    got = {r.node: r.component for r in graph.components(df, Stages(spark), "t").collect()}
    assert got == {k: v for k, v in expected.items() if near[k] != {k}}
    assert graph.components(df.limit(0), Stages(spark), "t").count() == 0


def brute_lines(docs, m):
    seen, out = set(), {}
    for i, text in sorted(docs):
        lines = text.split("\n")
        gone = [False] * len(lines)
        for k in range(len(lines) - m + 1):
            w = tuple(lines[k : k + m])
            if w in seen:
                gone[k : k + m] = [True] * m
            seen.add(w)
        out[i] = "\n".join(x for x, g in zip(lines, gone) if not g)
    return out


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_line_runs(spark, m):
    r = random.Random(m)
    docs = [(i, "\n".join(r.choice("abcde") for _ in range(r.randint(1, 12)))) for i in range(25)]
    out = linededup.drop_repeated_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), min_lines=m)
    rows = out.collect()
    assert {r.doc_id: r.text for r in rows} == brute_lines(docs, m)
    assert all(r.n_removed == sum(x["size"] for x in r.runs) for r in rows)


def test_single_long_lines(spark):
    """A long line alone is a run: exact copies of one-line documents and a shared passage go, short lines stay."""
    long, other = prose(31, 12), prose(32, 12)
    docs = [(1, long), (2, long), (3, f"a b\n{other}\nc"), (4, f"d\n{other}\ne\na b"), (5, f"x\ny\n{long}\n{other}\nz"), (6, f"x\ny\n{long}\nq"), (7, " ".join(other.split()[:9])), (8, " ".join(other.split()[:9]))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = {r.doc_id: r for r in linededup.drop_repeated_lines(df, min_words=10).collect()}
    assert {i: r.text for i, r in rows.items()} == {**dict(docs), 2: "", 4: "d\ne\na b", 5: "x\ny\nz", 6: "q"}
    assert [tuple(x) for x in rows[6].runs] == [(0, 3)] and rows[5].n_removed == 2
    assert {r.doc_id: r.text for r in linededup.drop_repeated_lines(df).collect()}[2] == long


def test_line_runs_of_copies(spark):
    """Copies of long documents, runs at their ends, one line over and over, and a document that repeats itself."""
    r = random.Random(3)
    base = [f"line {k}" for k in range(70)]
    docs = [(0, "\n".join(base)), (1, "\n".join(base)), (2, "\n".join(base[5:50] + ["own"] + base[60:])), (3, "x\n" * 200), (4, "x\n" * 130), (5, "\n".join(base[:9] * 5)), (6, "tail\n" + base[-1])]
    docs += [(10 + k, "\n".join(base[s : s + r.randint(1, 30)] + ["own %d" % k] * (k % 2))) for k, s in enumerate(r.sample(range(65), 40))]
    for m in (1, 2, 5):
        rows = linededup.drop_repeated_lines(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), min_lines=m).collect()
        assert {r.doc_id: r.text for r in rows} == brute_lines(docs, m)
        assert all(a["start"] + a["size"] < b["start"] for r in rows for a, b in zip(r.runs, r.runs[1:]))  # maximal


def test_lines_of_odd_input(spark, odd, nothing):
    lined = odd.withColumn("text", F.regexp_replace("text", "( [a-m])", "\n$1"))
    for df in (odd, lined):
        rows = linededup.drop_repeated_lines(df).collect()
        assert len(rows) == df.count()
        docs = {(sd.NOBODY if r.doc_id is None else r.doc_id, r.text) for r in df.collect() if r.text is not None}
        expected = brute_lines(docs, 2)
        assert {sd.NOBODY if r.doc_id is None else r.doc_id: r.text for r in rows if r.n_lines} == expected
    got = {r.doc_id: r for r in rows}
    assert got[4].text is None and got[4].n_lines == 0 and got[5].n_lines == 1 and got[None].text == "" and got[3].n_removed > 1
    assert linededup.drop_repeated_lines(nothing).count() == 0
