"""N-gram Jaccard join by count vectors.

The tokens of a document are its distinct word shingles, as 64-bit hashes.  Candidates meet under
keys that lose no pair:

* Tokens are hashed into more groups than two linked documents can differ in tokens, by the size
  band of the smaller one; so some group holds the same tokens in both, and the band, the group and
  the hash of its tokens make a key.  The number of groups exceeds that need by the number of empty
  groups to expect, so empty ones need no key, except in the rare documents with more of them.
* In documents too small for such groups, the tokens of least hash that must contain a common one
  (the prefix of a set of that size) are the keys.

Every token also counts in one of ``GROUPS`` coordinates.  The count vectors are the points that are
indexed: two sets share at most the sum of the coordinate minima, so a pair, or a pair of boxes in
the R-tree of the documents of one key, is out when that sum is too small.  What survives is verified
on the token hashes.

Pairs are spared within components: equal sets are linked to their smallest doc_id; each document
is first verified against the smallest doc_id under its keys.  Only keys whose documents then lie in
different components stay open, and of those only the documents outside the key's largest component
have to meet the others.  In keys of more than a block they are first verified against a member of
that component, another one in each round, which joins nearly all near copies of one text by a few
rows a document.  What is left outside is searched with the R-tree against all documents of the key,
in blocks of bounded size: so the copies of rows grow with the documents of a key times those still
outside, not with the square of the key.  A token that very many small sets hold among their least
ones is no such key for long: sets that link over it share a second token among the least of both, one place
further, and meet under the pair.  No links between different texts are lost, as each is
either verified or joins two documents already connected.

Defined results for odd input: a null text, or one without words, has an empty set and links with
nothing; fewer words than a shingle make one token; rows with the same doc_id are counted each, but
are one node for linking, for which the smallest of their texts stands;
rows with a null ``doc_id`` link like others, by a number above 2^62 that their text makes (ids from there on are
renumbered in their order meanwhile), and have a null component if it holds no id; other columns are ignored.  Hashes of
64 bits stand for words, shingles and sets (128 bits for whole sets).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BROADCAST_IDS, Stages, by_ids, lean
from .graph import components

GROUPS = 128
FULL = 255
#: Bands whose largest size is below this use prefixes.
SMALL = 64
#: Documents of one key in one block of the search.
BLOCK = 2048
#: Rounds in which documents outside the largest component of a large key meet one of its members.
ROUNDS = 4
#: A key of more than a block with more documents than this outside its largest component is split by second tokens.
CROWD = 256
#: Nodes of rows without doc_id lie from UNNAMED on, those of ids from NAMELESS on between both, if there are such rows.
NAMELESS, UNNAMED = 1 << 62, (1 << 62) + (1 << 61)
LEAF = 32
CACHE = 200_000
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _P1
    x = (x ^ (x >> np.uint64(29))) * _P2
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct hashes of the shingles of a text."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "replace").lower().split() if text else []  # ASCII only, in both
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        for w in set(words).difference(known):
            if len(known) >= CACHE:
                known.clear()
                known.update((x, int.from_bytes(blake2b(x, digest_size=8).digest(), "little")) for x in set(words))
                break
            known[w] = int.from_bytes(blake2b(w, digest_size=8).digest(), "little")
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.size, len(words))
        h = ids[: len(ids) - n + 1].copy()
        for k in range(1, n):
            h = mix(h) + ids[k : len(ids) - n + 1 + k]
        return np.unique(mix(h + np.uint64(n)))


class Keys:
    """The keys of a token set under which every linked set is met."""

    def __init__(self, percent: int):
        self.percent = percent
        self.bands = [1]

    def reach(self, least: int) -> int:
        return least * 100 // self.percent + 1

    def band(self, n: int) -> int:
        """Bands are so wide that linked sets lie in the same or in neighbouring ones."""
        while self.bands[-1] <= n or len(self.bands) < 3:
            self.bands.append(self.reach(self.bands[-1]))
        return int(np.searchsorted(self.bands, n, "right")) - 1

    def groups(self, band: int) -> tuple[int, int]:
        """(groups, empty groups that need no key) of a band."""
        while len(self.bands) < band + 2:
            self.band(self.bands[-1])
        low, high = self.bands[band], self.bands[band + 1] - 1
        differ = (100 - self.percent) * high // self.percent
        spare = 0
        while spare < 3 * differ:
            g = differ + 1 + spare
            mean = g * (1 - 1 / g) ** low
            if spare >= mean + 4 * mean**0.5:
                break
            spare += 1
        return differ + 1 + spare, spare

    def of(self, tokens: np.ndarray) -> np.ndarray:
        n = len(tokens)
        if not n:
            return tokens
        own, below = self.band(n), self.band(-(-self.percent * n // 100))  # of the smallest set that it may link with
        first = self.band(SMALL)  # the first band with groups
        out = []
        if below < first:
            out.append(mix(tokens[: n - -(-self.percent * n // 100) + 1] + np.uint64(1)))
        for b in {below, own}:
            if b >= first:
                count, spare = self.groups(b)
                group = (mix(tokens ^ _P2) % np.uint64(count)).astype(np.int64)
                sums, size = np.zeros(count, np.uint64), np.bincount(group, minlength=count)
                np.add.at(sums, group, mix(tokens + np.uint64(7)))
                which = np.arange(count) if count - np.count_nonzero(size) > spare else np.flatnonzero(size)
                place = np.uint64(b << 32) + which.astype(np.uint64)
                out.append(mix(mix(sums[which]) + mix(place)))
        return np.concatenate(out)


def vector(tokens: np.ndarray) -> np.ndarray:
    """Counts of the tokens by group in a byte each; the largest value stands for that many or more."""
    return np.minimum(np.bincount((mix(tokens) >> np.uint64(65 - GROUPS.bit_length())).astype(np.int64), minlength=GROUPS), FULL).astype(np.uint8)


def points_of(blobs: list[bytes]) -> np.ndarray:
    """Vectors as points; a full count bounds nothing."""
    p = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), GROUPS).astype(np.int32)
    p[p == FULL] = 1 << 20
    return p


def needed(a, b, percent: int):
    """Common tokens that sets of a and b tokens need."""
    return -(-percent * (a + b) // (100 + percent))


SIGN = "doc_id bigint, n bigint, h1 bigint, h2 bigint, vec binary, keys array<bigint>"
SETS = "doc_id bigint, tokens binary"


def _sign(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    shingler, keys = Shingler(size), Keys(percent)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            rows: list = [[], [], [], []]
            found = []
            for text in part.column(1).to_pylist():
                t = shingler(text)
                rows[0].append(len(t))
                rows[1].append(int(mix(t).sum(dtype=np.uint64).view(np.int64)) if len(t) else 0)
                rows[2].append(int(mix(t ^ _P1).sum(dtype=np.uint64).view(np.int64)) if len(t) else 0)
                rows[3].append(vector(t).tobytes())
                found.append(keys.of(t).view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
            cols = [part.column(0), *(pa.array(r, pa.int64()) for r in rows[:3]), pa.array(rows[3], pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "h1", "h2", "vec", "keys"])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    shingler = Shingler(size)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            sets = [shingler(t).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["doc_id", "tokens"])


def _near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(u, v) of the pairs that the bound lets pass, of rows (u, v, n, vec, n, vec)."""
    for batch in batches:
        if batch.num_rows:
            a, b = (points_of(batch.column(k).to_pylist()) for k in (3, 5))
            keep = np.minimum(a, b).sum(axis=1, dtype=np.int64) >= needed(batch.column(2).to_numpy(), batch.column(4).to_numpy(), percent)
            yield batch.select([0, 1]).filter(pa.array(keep))


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(u, v) of the pairs that link, of rows (u, v, tokens, tokens)."""
    for batch in batches:
        keep = []
        for ta, tb in zip(batch.column(2), batch.column(3)):
            a, b = (np.frombuffer(t.as_buffer(), np.uint64) for t in (ta, tb))
            keep.append(len(np.intersect1d(a, b, assume_unique=True)) >= needed(len(a), len(b), percent))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


class RTree:
    """Points packed into leaves by recursive halving along their widest coordinate."""

    def __init__(self, points: np.ndarray):
        self.points = points
        leaves, todo = [], [np.arange(len(points))]
        while todo:
            at = todo.pop()
            if len(at) <= LEAF:
                leaves.append(at)
                continue
            p = points[at]
            axis = int((p.max(axis=0) - p.min(axis=0)).argmax())
            order = at[np.argsort(p[:, axis], kind="stable")]
            todo += [order[: len(order) // 2], order[len(order) // 2 :]]
        self.leaves = leaves
        self.top = np.array([points[at].max(axis=0) for at in leaves])

    def pairs(self, other: RTree, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs whose summed coordinate minima reach the common tokens needed."""
        least_b = np.array([size_b[at].min() for at in other.leaves])
        for k, at in enumerate(self.leaves):
            need = needed(size_a[at].min(), least_b, percent)
            near = np.flatnonzero(np.minimum(self.top[k], other.top).sum(axis=1, dtype=np.int64) >= need)
            for j in near:
                bt = other.leaves[j]
                shared = np.minimum(self.points[at][:, None, :], other.points[bt][None, :, :]).sum(axis=2, dtype=np.int64)
                x, y = np.nonzero(shared >= needed(size_a[at][:, None], size_b[bt][None, :], percent))
                yield at[x], bt[y]


def _search(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(u, v) that may link, across components, of rows (key, i, j, side, doc_id, component, n, vec) sorted by (key, i, j).

    Rows of side 0 are searched for among those of side 1; those of side 2 belong to both.
    """

    def block(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        side, doc, comp, n = (rows.column(c).to_numpy() for c in ("side", "doc_id", "component", "n"))
        a, b = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(a) or not len(b):
            return doc[:0], doc[:0]
        points = points_of(rows.column("vec").to_pylist())
        us, vs = [doc[:0]], [doc[:0]]
        for x, y in RTree(points[a]).pairs(RTree(points[b]), n[a], n[b], percent):
            u, v = a[x], b[y]
            ok = (comp[u] != comp[v]) & (doc[u] != doc[v])
            us.append(np.maximum(doc[u[ok]], doc[v[ok]]))
            vs.append(np.minimum(doc[u[ok]], doc[v[ok]]))
        return np.concatenate(us), np.concatenate(vs)

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        marks = list(zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j"))))
        start = 0
        for k, mark in enumerate(marks):
            if last is not None and mark != last:
                if k > start:
                    held.append(batch.slice(start, k - start))
                u, v = block(pa.Table.from_batches(held))
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
                held, start = [], k
            last = mark
        if start < len(marks):
            held.append(batch.slice(start))
    if held:
        u, v = block(pa.Table.from_batches(held))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _verified(pairs: DataFrame, texts: DataFrame, stages: Stages, name: str, words: int, percent: int) -> DataFrame:
    """The pairs that link; only the texts that they name are read for their sets.  texts: one row a doc_id."""
    ids = stages.write(f"{name}-ids", pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct())
    named = by_ids(texts, ids, "left_semi").select("doc_id", "text")
    sets = stages.write(f"{name}-sets", named.mapInArrow(lean(partial(_sets, size=words)), SETS), batch_rows=2000)
    a = sets.select(F.col("doc_id").alias("u"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("doc_id").alias("v"), F.col("tokens").alias("tb"))
    rows = pairs.join(a, "u").join(b, "v").select("u", "v", "ta", "tb")
    out = stages.write(name, rows.mapInArrow(lean(partial(_verify, percent=percent)), "u bigint, v bigint"), batch_rows=1000)
    stages.drop(f"{name}-ids", f"{name}-sets")
    return out


def _placed(members: DataFrame, comps: DataFrame) -> DataFrame:
    """key, doc_id and component of the documents under each key."""
    return members.join(comps, members["doc_id"] == comps["node"], "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))


def _open_keys(placed: DataFrame) -> DataFrame:
    """key, n (documents), main (the component with most of them), outside (documents not in it) of keys with several components."""
    shares = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    keys = shares.groupBy("key").agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.max_by("component", F.struct("c", "component")).alias("main"))
    return keys.where("most < n").selectExpr("key", "n", "main", "n - most AS outside")


def _pivots(placed: DataFrame, keys: DataFrame, turn: int) -> DataFrame:
    """(u, v): each document outside the main component of a large key with one member of that component."""
    rows = placed.join(keys, "key")
    pivot = rows.where("component = main").groupBy("key").agg(F.min_by("doc_id", F.xxhash64(F.lit(turn), "doc_id")).alias("v"))
    return rows.where("component <> main").select("key", F.col("doc_id").alias("u"), "n").join(pivot, "key").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _blocks(placed: DataFrame, keys: DataFrame, size: int = BLOCK) -> DataFrame:
    """The documents of open keys in pairs (i, j) of blocks: those outside the main component (i) and all (j).

    In a key of one block each document is one row, whose side 2 says that it is on both sides.
    """
    rows = placed.join(keys, "key").selectExpr("key", "doc_id", "component", "component <> main AS other", f"cast(ceil(outside / {size}) AS int) AS ni", f"cast(ceil(n / {size}) AS int) AS nj")
    at = "cast(pmod(xxhash64(doc_id), {}) AS int)"
    one = rows.where("nj = 1").selectExpr("key", "0 AS i", "0 AS j", "IF(other, 2, 1) AS side", "doc_id", "component")
    all_ = rows.where("nj > 1").selectExpr("key", f"{at.format('nj')} AS j", "doc_id", "component", "explode(sequence(0, ni - 1)) AS i").selectExpr("key", "i", "j", "1 AS side", "doc_id", "component")
    few = rows.where("nj > 1 AND other").selectExpr("key", f"{at.format('ni')} AS i", "doc_id", "component", "explode(sequence(0, nj - 1)) AS j").selectExpr("key", "i", "j", "0 AS side", "doc_id", "component")
    return one.union(all_).union(few)


def _second_keys(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(old, key, doc_id) of rows (doc_id, text, keys): the keys that are a least token of the set, each with the other tokens that may be common.

    Sets that need two common tokens or more have two among one more of their least ones than the prefix
    that must hold one; a set that may link by one token keeps that token as a key.
    """
    shingler = Shingler(size)
    for batch in batches:
        old, new, docs = [], [], []
        for doc, text, keys in zip(*(batch.column(k).to_pylist() for k in range(3))):
            tokens = shingler(text)
            common = -(-percent * len(tokens) // 100)
            least = tokens[: len(tokens) - common + 2]
            first = least[: len(tokens) - common + 1]
            own = mix(first + np.uint64(1))
            asked = np.isin(own, np.array(keys, np.int64).view(np.uint64))
            for t, key in zip(first[asked], own[asked].tolist()):
                other = least[least != t]
                pairs = mix(mix(np.minimum(other, t) + np.uint64(3)) + np.maximum(other, t))
                if common == 1:
                    pairs = np.append(pairs, mix(mix(t + np.uint64(5))))
                old += [key] * len(pairs)
                new += pairs.tolist()
                docs += [doc] * len(pairs)
        cols = [pa.array(np.array(old, np.uint64).view(np.int64)), pa.array(np.array(new, np.uint64).view(np.int64)), pa.array(docs, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["old", "key", "doc_id"])


def nodes(docs: DataFrame, stages: Stages) -> tuple[DataFrame, bool, DataFrame | None]:
    """(docs with the number __node for linking, whether rows have no doc_id, the numbers of large ids or none).

    The node is the doc_id, or for rows without one a number that the text makes; only if there are such
    rows and ids that reach into their numbers, these ids are numbered anew in their order.
    """
    seen = docs.agg(F.max("doc_id").alias("top"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    own = F.coalesce(F.col("doc_id"), F.xxhash64("text").bitwiseAND((1 << 60) - 1) + F.lit(UNNAMED))
    if not seen["none"] or seen["top"] is None or seen["top"] < NAMELESS:
        return docs.withColumn("__node", own), bool(seen["none"]), None
    large = docs.where(F.col("doc_id") >= NAMELESS).select(F.col("doc_id").alias("__id")).distinct().orderBy("__id")
    names = stages.write("names", large.withColumn("__number", F.monotonically_increasing_id() + F.lit(NAMELESS)))
    joined = docs.join(_small(names), docs["doc_id"] == names["__id"], "left").withColumn("__node", F.coalesce("__number", own))
    return joined.drop("__id", "__number"), True, names


def _small(names: DataFrame) -> DataFrame:
    return F.broadcast(names) if names.count() <= BROADCAST_IDS else names


def _with_ids(told: DataFrame, names: DataFrame | None) -> DataFrame:
    """told with ids in place of nodes; null for rows without one."""
    for c in ("doc_id", "component_id"):
        plain = F.when(F.col(c) < NAMELESS, F.col(c))
        if names is None:
            told = told.withColumn(c, plain)
        else:
            told = told.join(_small(names), told[c] == names["__number"], "left").withColumn(c, F.coalesce("__id", plain)).drop("__id", "__number")
    return told


def link(docs: DataFrame, *, words: int = 4, percent: int = 85, numbered: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Two documents link when 100 * common shingles >= percent * all shingles of both.  numbered: rows
    without doc_id have the numbers of their nodes.
    """
    stages = Stages(docs.sparkSession)
    nameless, names = False, None
    rows = docs.select("doc_id", "text")
    if not numbered:
        rows, nameless, names = nodes(rows, stages)
        rows = rows.select(F.col("__node").alias("doc_id"), "text")
    sign = lambda t: t.mapInArrow(lean(partial(_sign, size=words, percent=percent)), SIGN)
    all_signed = stages.write("signed", sign(rows), batch_rows=2000)
    sizes = stages.write("sizes", all_signed.select("doc_id", "n"))
    texts, signed = rows, all_signed
    # Where several rows have one doc_id, the smallest of their texts stands for them; only such texts are shuffled.
    repeated = stages.write("repeated", sizes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id"))
    if not repeated.isEmpty():
        several = stages.write("several", by_ids(rows, repeated, "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).select("doc_id", "text"))
        texts = by_ids(rows, repeated, "left_anti").select("doc_id", "text").union(several)
        signed = by_ids(all_signed, repeated, "left_anti").select(*all_signed.columns).union(stages.write("several-signed", sign(several), batch_rows=2000))
    known = signed.select("doc_id", "n", "h1", "h2", "vec").where("n > 0")
    same = known.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last")
    same = stages.write("same", same.drop("last"))
    equal = stages.write("equal", known.select("doc_id", "n", "h1", "h2").join(same, ["n", "h1", "h2"]).where("doc_id <> rep").select("doc_id", "rep").distinct())

    # Copies of a set are linked already; the keys of its smallest doc_id stand for all.
    copies = stages.write("copies", equal.select("doc_id").distinct())
    keyed = by_ids(signed, copies, "left_anti").select("doc_id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("x")).where("m < x").select("key", "m")
    shared = stages.write("shared", shared)
    members = stages.write("members", keyed.join(shared, "key").select("key", "doc_id", "m").distinct())
    stages.drop("shared")

    points = stages.write("points", by_ids(known, copies, "left_anti").select("doc_id", "n", "vec"))
    stages.drop("signed")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that the bound lets pass and that link."""
        both = pairs.join(points.toDF("u", "n1", "vec1"), "u").join(points.toDF("v", "n2", "vec2"), "v").select("u", "v", "n1", "vec1", "n2", "vec2")
        near = stages.write(f"{name}-near", both.mapInArrow(lean(partial(_near, percent=percent)), "u bigint, v bigint"))
        out = _verified(near, texts, stages, name, words, percent)
        stages.drop(f"{name}-near")
        return out

    edges = verified(members.groupBy("doc_id").agg(F.min("m").alias("m")).where("m < doc_id").select(F.col("doc_id").alias("u"), F.col("m").alias("v")), "stars")
    comps = components(edges, stages, "comps")
    placed = stages.write("placed", _placed(members.select("key", "doc_id"), comps))
    # Keys within one component are done; only the documents of the others go on.
    keys = stages.write("keys", _open_keys(placed))
    open_ = stages.write("open", placed.join(keys.select("key"), "key", "left_semi"))
    stages.drop("members", "placed")
    large = keys.where(F.col("n") > BLOCK)
    for turn in range(ROUNDS):
        if large.isEmpty():
            break
        crowd = stages.write(f"crowd-{turn}", _placed(open_.join(large.select("key"), "key", "left_semi").select("key", "doc_id"), comps))
        large = stages.write(f"large-{turn}", _open_keys(crowd))
        new = verified(_pivots(crowd, large, turn), f"stars-{turn}")
        edges = edges.union(new)
        comps = components(edges, stages, f"comps-{turn}")
        stages.drop(f"crowd-{turn}")
        if new.isEmpty():
            break
    placed = stages.write("placed", _placed(open_.select("key", "doc_id"), comps))
    keys = stages.write("keys-left", _open_keys(placed))
    crowded = keys.where((F.col("n") > BLOCK) & (F.col("outside") > CROWD))
    if not crowded.isEmpty():
        asked = stages.write("asked", placed.join(crowded.select("key"), "key", "left_semi").groupBy("doc_id").agg(F.collect_set("key").alias("keys")))  # a document has few keys
        second = texts.join(asked, "doc_id").select("doc_id", "text", "keys").mapInArrow(lean(partial(_second_keys, size=words, percent=percent)), "old bigint, key bigint, doc_id bigint")
        second = stages.write("second", second, batch_rows=1000)
        split = stages.write("split", second.select(F.col("old").alias("key")).distinct())
        shared = second.groupBy("key").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("x")).where("m < x").select("key")
        further = stages.write("further", second.select("key", "doc_id").distinct().join(stages.write("second-shared", shared), "key"))
        placed = stages.write("placed-again", placed.join(split, "key", "left_anti").unionByName(_placed(further, comps)))
        keys = stages.write("keys-again", _open_keys(placed))
    blocks = _blocks(placed, keys).join(points, "doc_id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    blocks = blocks.select("key", "i", "j", "side", "doc_id", "component", "n", "vec")
    across = stages.write("across", blocks.mapInArrow(lean(partial(_search, percent=percent)), "u bigint, v bigint").distinct())
    stages.drop("open", "placed")
    found = _verified(across, texts, stages, "found", words, percent)

    links = edges.union(found).union(equal.select("doc_id", "rep"))
    final = components(links, stages, "components")
    told = stages.write("told", sizes.join(final, sizes["doc_id"] == final["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")))
    stages.drop(*(name for name in list(stages.paths) if name not in ("told", "names")))
    return _with_ids(told, names).select("doc_id", "n_shingles", "component_id") if nameless else told


def keep_one(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group; unlinked ones stay.

    Of rows without doc_id one of each text stays, if no document with an id is in its group.
    """
    nameless = docs.where("doc_id is null")
    a_word = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    docs_ = docs.where("doc_id is not null").union(nameless.where(~a_word)).union(nameless.where(a_word).dropDuplicates(["text"]))
    stages = Stages(docs.sparkSession)
    keyed, _, _ = nodes(docs_, stages)
    linked = link(keyed.select(F.col("__node").alias("doc_id"), "text"), words=words, percent=percent, numbered=True)
    gone = linked.where("doc_id <> component_id").select(F.col("doc_id").alias("__node")).distinct()
    return by_ids(keyed, stages.write("gone", gone), "left_anti", "__node").select(*(f"`{c}`" for c in docs.columns))
