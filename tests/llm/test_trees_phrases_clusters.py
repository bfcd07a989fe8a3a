"""Chat formatting, phrase mining and centroid clustering against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_samples import SCHEMA, WORDS, prose
from opsloom.llm import centroids, chat, phrases

MESSAGE = "tree bigint, id bigint, parent bigint, role string, text string, score double"
ODD = ["</s>[INST] ok [/INST]", "a\\b \\<s> \\\\", "<|im_end|>\n<|im_start|>user<|im_sep|>", "<<SYS>><</SYS>> <<s>", "x <", "|im_sep|> \\", "", "é\U0001f600<|x|>\n", "[INST][/INST]<s></s><|endoftext|"]


# -- chat formatting -----------------------------------------------------------------------------
def paths_of(rows, keep):
    """{(tree, leaf): (branch, score, [(role, text), ...])} by walking up from every leaf."""
    first = {}
    for t, i, p, r, x, s in rows:
        if i is not None:
            k, v = (t, i), ((p is not None, p or 0), (r is not None, r or ""), (x is not None, x or ""), s or 0.0)
            if k not in first or ((v[0], v[1][1], v[2][1], v[3]) < (first[k][0], first[k][1][1], first[k][2][1], first[k][3])):
                first[k] = v
    nodes = [(t, i, v[0][1] if v[0][0] else None, v[1][1], v[2][1], v[3]) for (t, i), v in first.items()]
    nodes += [(t, None, p, r or "", x or "", s or 0.0) for t, i, p, r, x, s in rows if i is None]
    at = {(t, i): n for n, (t, i, *_) in enumerate(nodes) if i is not None}
    answered = {at[t, p] for t, _, p, *_ in nodes if p is not None and (t, p) in at}
    found = defaultdict(list)
    for n, node in enumerate(nodes):
        if n in answered:
            continue
        path, seen, here = [], set(), n
        while here is not None and here not in seen:
            seen.add(here)
            path.append(here)
            t, _, p, *_ = nodes[here]
            here = at.get((t, p)) if p is not None else None
        if here is None:
            found[node[0]].append((-sum(nodes[k][5] for k in path), -len(path), node[1] is None, node[1] or 0, [(nodes[k][3], nodes[k][4]) for k in reversed(path)]))
    out = Counter()
    for tree, own in found.items():
        for b, (s, _, none, leaf, turns) in enumerate(sorted(own)[:keep]):
            out[tree, None if none else leaf, b + 1, round(-s, 6), tuple(turns)] += 1
    return out


def read(df):
    out = Counter()
    for r in df.withColumn("turns", chat.read_turns(F.col("text"))).withColumn("said", chat.read_loss(F.col("text"), F.col("loss"))).collect():
        turns = tuple((t.role, t.text) for t in r.turns)
        assert r.n_turns == len(turns) and r.said == "".join(x for role, x in turns if role == "assistant")
        assert len(re.findall(chat.CONTROL, r.text)) == 3 * len(turns)  # nothing but the template's own marks
        out[r.tree, r.leaf_id, r.branch, round(r.score, 6), turns] += 1
    return out


@pytest.mark.parametrize("keep", [1, 2, None])
def test_reply_trees(spark, keep):
    """Random trees, chains, stars, unknown and null parents, circles, repeated and missing ids, null texts and scores, control strings."""
    r = random.Random(5)
    rows = []
    for t in range(12):
        for i in range(r.randint(1, 30)):
            rows.append((t, i, r.randrange(i) if i and r.random() < 0.9 else r.choice([None, 99]), r.choice(["user", "assistant", "tool", None]), r.choice([*ODD, None, prose(i, 5)]), r.choice([None, float(r.randint(-3, 9))])))
    rows += [(20, i, i - 1 if i else None, "assistant" if i % 2 else "user", f"turn {i}", 1.0) for i in range(70)]
    rows += [(21, i, 0 if i else None, "user", str(i), float(i % 3)) for i in range(40)]
    rows += [(22, 1, 2, "user", "a", 1.0), (22, 2, 1, "user", "b", 1.0), (22, 3, 2, "user", "c", 1.0), (22, 4, None, "user", "d", 1.0)]
    rows += [(None, 1, None, "user", "n", 1.0), (None, 2, 1, "assistant", "m", 1.0), (23, None, None, None, None, None), (23, 5, None, "a<|b|>", "x", 0.0), (23, 5, None, "a<|b|>", "x", 0.0)]
    df = spark.createDataFrame(rows, MESSAGE).withColumns({c: F.lit("x") for c in ("n", "leaf", "back", "up", "loss", "branch")}).repartition(5)
    assert read(chat.format_trees(df, score="score", keep=keep)) == paths_of(rows, keep)


def test_threads(spark):
    """Equal and null turns, null conversations, repeated rows, an empty table."""
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, None, None, None), (None, 1, "user", "x"), (None, 0, "system", ODD[0]), (2, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("tree", F.lit("x"))
    got = {k[0]: k[4] for k in read(chat.format_trees(chat.thread(df), unique=True))}
    assert got == {1: (("", ""), ("user", "a"), ("user", "a"), ("assistant", "b")), None: (("system", ODD[0]), ("user", "x")), 2: (("assistant", ""),)}
    assert chat.format_trees(chat.thread(df.limit(0)), unique=True).count() == 0


# -- phrase mining -------------------------------------------------------------------------------
def brute_phrases(rows, most, least, covered=80, scale=2_000_000):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und" if lang is None else lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang if lang is not None else "und", tuple(w[i : i + k])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = set()
    for (lang, w), a in found.items():
        inside = any(q[0] == lang and len(q[1]) > len(w) and 100 * b >= covered * a and any(q[1][i : i + len(w)] == w for i in range(len(q[1]) - len(w) + 1)) for q, b in found.items())
        if not inside:
            score, k, left, right = min((scale * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.add((lang, " ".join(w), a, left, right, k, n[lang], score))
    return out


@pytest.mark.parametrize("block,keys", [(1, 7), (3000, 100), (1 << 24, 1 << 20)])
def test_phrases(spark, odd, block, keys):
    """Repeated words, overlaps, pieces, many languages, control characters, nulls, empty texts; blocks of every size."""
    r = random.Random(3)
    few = ["The", "of", "OF", "stone", "a a", "tide.", "x,y", "é", " w", "river\t", "q\x0bz", "b!", "\n"]
    rows = [(k, " ".join(r.choice(few) for _ in range(r.randint(0, 80))), r.choice(["en", "fr", None, "", "zz"]), "s", 1) for k in range(60)]
    rows += [(None, "a a a a a a", "en", None, None), (1, None, "en", "s", 1), (2, "", None, "s", 1), rows[0], rows[0]]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("word", "lid", "block", "gid", "x", "y", "n")}).repartition(3)
    for most, least in ((4, 5), (2, 2), (6, 4)) if block == 3000 else ((4, 5),):
        got = [tuple(x) for x in phrases.mine(df, most_words=most, least=least, block_bytes=block, part_keys=keys).select("lang", "phrase", "a", "l", "r", "k", "n", "score").collect()]
        assert len(got) == len(set(got)) and set(got) == brute_phrases(rows, most, least)
    if block != 3000:
        return
    ranked = phrases.best(phrases.mine(df, least=5), top=4).collect()
    for lang in {x.lang for x in ranked}:
        mine = sorted(((-s, -a, p.encode()) for g, p, a, _, _, _, _, s in brute_phrases(rows, 4, 5) if g == lang))[:4]
        assert [(-x.score, -x.a, x.phrase.encode()) for x in sorted((x for x in ranked if x.lang == lang), key=lambda x: x["rank"])] == mine
    many = [tuple(r) for r in odd.select("doc_id", "text", "lang").collect()]
    assert {tuple(x) for x in phrases.mine(odd, least=3, block_bytes=block, part_keys=keys).select("lang", "phrase", "a", "l", "r", "k", "n", "score").collect()} == brute_phrases(many, 4, 3)


def test_phrases_of_an_empty_table(spark, nothing):
    assert phrases.best(phrases.mine(nothing)).count() == 0


def test_lists_are_extended_by_the_word_behind():
    words, text, ended = phrases.words_of(pa.array(["B a. A b a", None, "", "a b"]))
    assert [w.as_py() for w in words] == [b"b", b"a", b"a", b"b", b"a", b"a", b"b"]
    assert text.tolist() == [0, 0, 0, 0, 0, 3, 3] and ended.tolist() == [0, 0, 1, 1, 1, 1, 1]
    at, owner, x, y, n, part = phrases.extend(np.array([1, 3, 5, 7, 0, 4, 8]), np.array([0, 0, 0, 0, 1, 1, 1]), np.array([70, 90]), 1)
    assert list(zip(x.tolist(), y.tolist(), n.tolist())) == [(70, 90, 2), (90, 70, 2)] and part.tolist() == [0, 0]
    assert sorted(zip(owner.tolist(), at.tolist())) == [(0, 3), (0, 7), (1, 0), (1, 4)]


@pytest.mark.parametrize("delta", [True, False])
def test_packed_numbers(delta):
    for a in ([], [0], [5, 5, 5], [-1, 300, -70000, (1 << 62) - 1, 0, -(1 << 61)], list(range(1000))):
        assert phrases.unpack(phrases.pack(np.array(a, dtype=np.int64), delta), delta).tolist() == a


# -- centroid clustering -------------------------------------------------------------------------
def brute_clusters(vectors, dims, k, rounds, scale=256, seed="2"):
    import math

    kept = [(i, tuple(math.floor(scale * float(np.float32(x))) for x in v)) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(np.float32(x)) for x in v)]
    named = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in named[:k]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        told = nearest()
        for n in range(len(cents)):
            own = [v for (_, v), (_, c) in zip(kept, told) if c == n]
            if own:
                cents[n] = tuple(sum(x) // len(own) for x in zip(*own))
    told = nearest()
    total, each = sum(d for d, _ in told), Counter()
    for d, n in told:
        each[n] += d
    fits = lambda s: s if s < 1 << 63 else None
    return Counter((i, n, fits(d), fits(each[n]), fits(total), hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, told))


def clustered(df, **kw):
    return Counter(tuple(r) for r in centroids.summary(*centroids.cluster(df, **kw)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


@pytest.mark.parametrize("dims,k,rounds", [(3, 4, 5), (2, 7, 3), (5, 100, 2)])
def test_clusters(spark, dims, k, rounds):
    """Ties, repeated vectors and ids, empty clusters, other lengths, nulls, infinities, numbers near the largest single-precision one."""
    r = random.Random(dims)
    rows = [(i, [r.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) + r.choice([0, 0.001]) for _ in range(dims)]) for i in range(90)]
    rows += [(200 + i, [0.5] * dims) for i in range(20)] + [(7, [0.1] * dims), (7, [0.1] * dims), (None, [0.3] * dims)]
    rows += [(300, [1.0]), (301, None), (302, [None] * dims), (303, [float("nan")] * dims), (304, [float("inf")] * dims), (305, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({c: F.lit("x") for c in ("id", "cluster", "dim", "n", "distance")}).repartition(3)
    assert clustered(df, dims=dims, k=k, rounds=rounds) == brute_clusters(rows, dims, k, rounds)
    far = [(400 + i, [3.0e38 * (-1) ** i] * dims) for i in range(3)] + [(410, [3.0e6] * dims), (411, [-2.0e9] + [0.0] * (dims - 1))]
    big = spark.createDataFrame(rows[:12] + far, "vec_id bigint, embedding array<float>")
    assert clustered(big, dims=dims, k=k, rounds=rounds) == brute_clusters(rows[:12] + far, dims, k, rounds)
    assert clustered(df.limit(0), dims=dims, k=k, rounds=rounds) == Counter()


def test_annulus_leaves_out_most_centroids():
    """Centroids of many norms: few are compared, ties on the edge included."""
    rng = np.random.default_rng(1)
    cents = [[int(x) for x in row] for row in rng.integers(-5, 6, (300, 8)) * (1 + np.arange(300)[:, None])]
    search = centroids.Annuli(cents + cents[:5])
    x = np.array(cents, dtype=np.float64)[rng.integers(0, 300, 500)] + rng.integers(-1, 2, (500, 8))
    number, dist, pairs = search.nearest(x, None)
    exact = ((x[:, None, :] - np.array(cents + cents[:5])[None]) ** 2).sum(axis=2)
    assert number.tolist() == exact.argmin(axis=1).tolist() and dist.tolist() == exact.min(axis=1).tolist()
    assert pairs < 500 * 305 / 2
    again = search.nearest(x, number)
    assert again[0].tolist() == number.tolist() and again[2] < 500 * 305 / 20
