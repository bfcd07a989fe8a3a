"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort.

Every string of ``MATCH`` bytes has a least hash among its ``GRAM``-byte grams, so equal strings
agree on it.  Consecutive strings of a document with the same least gram form one suffix record: the
suffix that begins at the gram, together with what lies before it.  The steps:

1. Documents are packed into blocks, in a written table.
2. Each block sends its distinct gram hashes, sorted and delta-coded; each hash range answers with
   two bits a hash: do other documents have it, and is it hot, that is, do more than ``HOT`` different
   records have it.  Records whose gram is unique are done.
3. Each block sorts its remaining distinct records into runs, one for each hash range, and sends
   them front-coded: the length of the prefix shared with the record before, and the rest.
4. Each hash range merges its runs with a loser tree that keeps, for each loser, the prefix it
   shares with its winner; known prefixes are not compared again.  Equal records meet, and so do all
   with the same gram; there the smallest doc_id of each ``MATCH``-byte string is found and sent
   back for each record of a run, in its order.
5. Each block marks the bytes of strings that begin in a document with a smaller doc_id too.

A block collapses its own copies before anything is sent, so that a frequent string costs one record
a block, however often it occurs.

Merging goes by levels of at most about ``FAN`` runs.  At the first level the blocks of a group meet, by
ranges that are as many as their text needs; what a range has merged is cut into finer ranges that
meet those of other groups at the next level, until one group is left.  Answers go back the same
way: each range merges once more what it got and hands the answers to its runs.  So the pieces that
are exchanged grow with the text at each level, and the levels with its logarithm.

Records around a passage that very many documents share differ in what stands beside it but have its
grams.  They are those of hot grams: such records are taken apart into their strings, which are named
by a hash of all their bytes, asked for once more whether other documents have them, and merged as
records of one string each.  So no gram gathers more than about ``HOT`` different records in a range.

Defined results for odd input: a null text counts as empty; texts below ``MATCH`` bytes are kept; a
null ``doc_id`` counts as larger than all others; rows with the same doc_id are not smaller than one
another and keep what only they share; a text of any length is one document; other columns are
ignored.  A text that is not valid Unicode is read with replacement marks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Stages, lean

MATCH, GRAM = 50, 16
SPAN = MATCH - GRAM + 1  # grams of a string; strings of a record at most
LONGEST = MATCH + SPAN - 1
WIDTH = LONGEST + 2  # with the length of the left part and of the whole, every record has this width
CHUNK = 1 << 18
#: Runs that one merge takes, about.
FAN = 256
#: Different records of one gram beyond which their strings go by themselves; such records have this for their left part.
HOT, ALONE = 1 << 17, 255
NOBODY = (1 << 63) - 1
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)

PIECES = "g bigint, part int, child bigint, blob binary"
ANSWERS = "child bigint, part int, blob binary, hot bigint"
BLOCKS = "block bigint, doc_ids array<bigint>, sizes array<bigint>, body binary"
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,size:bigint>>"


def pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([a.nbytes for a in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(a.tobytes() for a in arrays))


def unpack(blob: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, np.int64, len(types))
    out, at = [], 8 * len(types)
    for size, kind in zip(sizes, types):
        out.append(np.frombuffer(raw, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


def _pack_blocks(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 24, 0
        ids: list = []
        texts: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            body = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
            cols = [pa.array([base + seq], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([body], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["block", "doc_ids", "sizes", "body"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = (text.as_py() or "").encode("utf-8", "replace")
                ids.append(doc_id)
                texts.append(data)
                size += len(data)
                if size >= block_bytes:
                    yield row()
                    ids, texts, size, seq = [], [], 0, seq + 1
        if ids:
            yield row()

    return run


def scatter(least: np.ndarray) -> np.ndarray:
    """One-to-one: least hashes crowd near 0, ranges of their keys are even."""
    key = (least ^ (least >> np.uint64(31))) * _A
    return (key ^ (key >> np.uint64(30))) * _B


def gram_key(m: np.ndarray) -> np.ndarray:
    """The key of the gram that each row of bytes begins with."""
    words = np.ascontiguousarray(m[:, :GRAM]).view(np.uint64)
    h = words[:, 0] * _A + words[:, 1] * _B
    h ^= h >> np.uint64(32)
    h *= _C
    h ^= h >> np.uint64(29)
    return scatter(np.minimum(h, _TOP - np.uint64(1)))


def string_key(m: np.ndarray) -> np.ndarray:
    """The key of the string that each row of bytes begins with."""
    w = np.zeros((len(m), -(-MATCH // 8) * 8), np.uint8)
    w[:, :MATCH] = m[:, :MATCH]
    h = np.full(len(m), _B)
    for word in w.view(np.uint64).T:
        h = (h ^ word) * _A
        h ^= h >> np.uint64(32)
        h *= _C
        h ^= h >> np.uint64(29)
    return scatter(h)


def keys_of(rows: np.ndarray) -> np.ndarray:
    """The keys of records, by which they are dealt to ranges."""
    m = np.frombuffer(rows.tobytes(), np.uint8).reshape(-1, WIDTH)
    key, alone = gram_key(m), m[:, LONGEST] == ALONE
    key[alone] = string_key(m[alone])
    return key


class Block:
    """The suffix records of a block: first string, strings, least hash, and document of each."""

    def __init__(self, sizes: list[int], body: bytes):
        raw = zstandard.ZstdDecompressor().decompress(body, max_output_size=sum(sizes) or 1) if sum(sizes) else b""
        self.size = len(raw)
        self.buf = np.frombuffer(raw + bytes(MATCH + 16), np.uint8)
        self.sizes = np.array(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        parts = [self._chunk(s, min(s + CHUNK, self.size)) for s in range(0, self.size, CHUNK)]
        self.at, self.strings, self.least = (np.concatenate(x) if parts else np.empty(0, t) for x, t in zip(zip(*parts) if parts else [(), (), ()], (np.int64, np.int64, np.uint64)))
        self.doc = np.searchsorted(self.ends, self.at, "right")
        self.key = scatter(self.least)

    def grams(self, s: int, e: int) -> np.ndarray:
        """Hashes of the grams that begin in [s, e); those that leave their document or the block get the top value."""
        e = min(e, self.size)
        if e <= s:
            return np.empty(0, np.uint64)
        words = np.ndarray((e - s + 8,), np.uint64, self.buf, s, (1,)).copy()
        h = words[: e - s] * _A
        h += words[8 : e - s + 8] * _B
        h ^= h >> np.uint64(32)
        h *= _C
        h ^= h >> np.uint64(29)
        np.minimum(h, _TOP - np.uint64(1), out=h)
        first, last = np.searchsorted(self.ends, [s, e + GRAM], "right")
        for end in self.ends[first : last + 1]:
            h[max(0, end - GRAM + 1 - s) : max(0, min(end, e) - s)] = _TOP
        return h

    def _chunk(self, s: int, e: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g = self.grams(s, e + SPAN - 1)
        if len(g) < e - s + SPAN - 1:
            g = np.concatenate([g, np.full(e - s + SPAN - 1 - len(g), _TOP)])
        m, step = g, 1
        while step * 2 <= SPAN:
            m = np.minimum(m[:-step], m[step:])
            step *= 2
        m = np.minimum(m[: e - s], m[SPAN - step : SPAN - step + e - s])
        valid = np.ones(e - s, bool)
        first, last = np.searchsorted(self.ends, [s, e + MATCH], "right")
        for end in self.ends[first : last + 1]:
            valid[max(0, end - MATCH + 1 - s) : max(0, min(end, e) - s)] = False
        edge = np.empty(e - s, bool)
        edge[:1] = valid[:1]
        edge[1:] = valid[1:] & (~valid[:-1] | (m[1:] != m[:-1]))
        start = np.flatnonzero(edge)
        stop = np.flatnonzero(np.append(valid[:-1] & (~valid[1:] | (m[1:] != m[:-1])), valid[-1:])) + 1
        length = stop - start
        cuts = -(-length // SPAN)
        if (cuts > 1).any():  # a run of strings with one gram over and over
            which = np.repeat(np.arange(len(start)), cuts)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start, length = start[which] + nth * SPAN, np.minimum(SPAN, length[which] - nth * SPAN)
        return start + s, length, m[start]

    def prints(self) -> np.ndarray:
        """A hash of the bytes of each record."""
        out = self.strings.astype(np.uint64) * _B
        for s in range(0, self.size, CHUNK):
            lo, hi = np.searchsorted(self.at, [s, min(s + CHUNK, self.size)])
            if hi > lo:
                g, at, n = self.grams(s, s + CHUNK + LONGEST), self.at[lo:hi] - s, self.strings[lo:hi] + MATCH - 1
                for k in (0, GRAM, 2 * GRAM, MATCH - GRAM, n - MATCH, n - 3 * GRAM, n - 2 * GRAM, n - GRAM):
                    out[lo:hi] = (out[lo:hi] ^ g[at + k]) * _A
                    out[lo:hi] ^= out[lo:hi] >> np.uint64(31)
        return out

    def apart(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, documents) of the strings of the picked records."""
        n = self.strings[pick]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(self.at[pick], n) + nth, np.repeat(self.doc[pick], n)

    def string_keys(self, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.uint64)
        for lo in range(0, len(at), 50_000):
            out[lo : lo + 50_000] = string_key(self.buf[at[lo : lo + 50_000, None] + np.arange(MATCH)])
        return out

    def string_records(self, at: np.ndarray) -> np.ndarray:
        """The strings at the given places as records of one string."""
        out = np.empty(len(at), f"S{WIDTH}")
        for lo in range(0, len(at), 50_000):
            cut = slice(lo, lo + 50_000)
            rows = np.zeros((len(at[cut]), WIDTH), np.uint8)
            rows[:, :MATCH] = self.buf[at[cut, None] + np.arange(MATCH)]
            rows[:, LONGEST], rows[:, LONGEST + 1] = ALONE, MATCH
            out[cut] = rows.view(f"S{WIDTH}")[:, 0]
        return out

    def gram_places(self, pick: np.ndarray) -> np.ndarray:
        """For each picked record a place of its least gram within its first string."""
        at, least = self.at[pick], self.least[pick]
        place = np.full(len(at), -1, np.int64)
        for s in range(0, self.size, CHUNK):
            lo, hi = np.searchsorted(at, [s, min(s + CHUNK, self.size)])
            if hi == lo:
                continue
            g = self.grams(s, s + CHUNK + SPAN)
            todo = np.arange(lo, hi)
            for k in (SPAN - 1, *range(SPAN - 1)):
                hit = g[np.minimum(at[todo] - s + k, len(g) - 1)] == least[todo]
                place[todo[hit]] = at[todo[hit]] + k
                todo = todo[~hit]
                if not len(todo):
                    break
        return place

    def records(self, pick: np.ndarray) -> np.ndarray:
        """The picked records as byte strings of WIDTH: the suffix from the gram, then what is before it, reversed."""
        at, place = self.at[pick], self.gram_places(pick)
        whole = self.strings[pick] + MATCH - 1
        left = place - at
        out = np.empty(len(at), f"S{WIDTH}")
        col = np.arange(LONGEST)
        for lo in range(0, len(at), 20_000):
            cut = slice(lo, lo + 20_000)
            a, p, n, l = (x[cut, None] for x in (at, place, whole, left))
            index = np.where(col < n - l, p + col, p - 1 - (col - (n - l)))
            rows = np.zeros((len(a), WIDTH), np.uint8)
            rows[:, :LONGEST] = np.where(col < n, self.buf[np.clip(index, 0, len(self.buf) - 1)], 0)
            rows[:, LONGEST], rows[:, LONGEST + 1] = l[:, 0], n[:, 0]
            out[cut] = rows.view(f"S{WIDTH}")[:, 0]
        return out


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


@dataclass(frozen=True)
class Levels:
    """groups and ranges of each level of merging; a range of one level is cut into whole ranges of the next."""

    groups: tuple[int, ...]
    ranges: tuple[int, ...]
    fan: int

    def up(self, level: int) -> int:
        """Ranges of the next level in one of this (from 0)."""
        return self.ranges[level + 1] // self.ranges[level]


def levels(blocks: int, size: int, part_bytes: int, fan: int) -> Levels:
    """Of so many blocks with so much text in all: groups of about fan runs, ranges of about part_bytes of a group's text."""
    groups, ranges, n = [], [], max(1, blocks)
    while n > 1 or not groups:
        n = -(-n // fan)
        wanted = max(8 if n == 1 else 1, -(-size // n // part_bytes))
        before = ranges[-1] if ranges else 1
        groups.append(n)
        ranges.append(before * max(1, -(-wanted // before)))
    return Levels(tuple(groups), tuple(ranges), fan)


def _rows(g: list[int], part: list[int], child: list[int], blobs: list[bytes]) -> pa.Table:
    return pa.table({"g": pa.array(g, pa.int64()), "part": pa.array(part, pa.int32()), "child": pa.array(child, pa.int64()), "blob": pa.array(blobs, pa.binary())})


def _one(step: Callable, **options):
    def run(part: pa.Table) -> pa.Table:
        return step(part, **options)

    return run


def _two(step: Callable, **options):
    def run(part: pa.Table, told: pa.Table) -> pa.Table:
        return step(part, told, **options)

    return run


def exchange(first: DataFrame, lv: Levels, stages: Stages, name: str, up: Callable, answer: Callable, down: Callable) -> DataFrame:
    """The answers (ANSWERS, a written table) to the pieces that the blocks send (PIECES, child: the block)."""
    pieces = []
    for level in range(len(lv.groups) - 1):
        pieces.append(stages.write(f"{name}-up-{level}", first, batch_rows=4))
        first = pieces[-1].groupBy("g", "part").applyInArrow(_one(up, lv=lv, level=level), PIECES)
    answers = stages.write(f"{name}-top", first.groupBy("g", "part").applyInArrow(_one(answer), ANSWERS), batch_rows=4)
    for level in range(len(lv.groups) - 2, -1, -1):
        told = answers.select(F.col("child").alias("g"), F.floor(F.col("part") / lv.up(level)).cast("int").alias("over"), "part", "blob")
        below = pieces[level].groupBy("g", "part").cogroup(told.groupBy("g", "over")).applyInArrow(_two(down, lv=lv, level=level), ANSWERS)
        answers = stages.write(f"{name}-down-{level}", below, batch_rows=4)
        stages.drop(f"{name}-up-{level}", f"{name}-top" if level == len(lv.groups) - 2 else f"{name}-down-{level + 1}")
    return answers


# -- which hashes do several documents have? -----------------------------------------------------
def _hash_blob(keys: np.ndarray, multi: np.ndarray, counts: np.ndarray, marks: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)), np.packbits(multi), counts.astype(np.uint32), marks.astype(np.uint16))


def _short_part(short: np.ndarray, parts: int) -> np.ndarray:
    return part_of(short << np.uint64(16), parts)


class Hashes:
    """The distinct hashes (48 bits) of several pieces: are they in several documents, in how many different records, and a mark of these."""

    def __init__(self, blobs):
        keys, multi, counts, marks, self.sizes = [], [], [], [], []
        for blob in blobs:
            delta, bits, n, m = unpack(blob.as_py(), np.uint64, np.uint8, np.uint32, np.uint16)
            keys.append(np.cumsum(delta, dtype=np.uint64))
            multi.append(np.unpackbits(bits, count=len(delta)).astype(bool))
            counts.append(n)
            marks.append(m)
            self.sizes.append(len(delta))
        key, multi, count, mark = (np.concatenate(x) for x in (keys, multi, counts, marks))
        order = np.lexsort((mark, key))
        key, mark = key[order], mark[order]
        new = np.append(True, key[1:] != key[:-1])
        first = np.flatnonzero(new)
        # Pieces with the same mark have the same records, which count once.
        other = new | np.append(True, mark[1:] != mark[:-1])
        self.key = key[first]
        self.multi = np.maximum.reduceat(multi[order], first) | (np.diff(np.append(first, len(key))) > 1)
        self.counts = np.minimum(np.add.reduceat(np.where(other, count[order].astype(np.int64), 0), first), (1 << 32) - 1)
        self.marks = np.add.reduceat(np.where(other, mark.astype(np.int64), 0), first) & 0xFFFF
        self.entry = np.empty(len(key), np.int64)
        self.entry[order] = np.cumsum(new) - 1

    def answers(self, part: pa.Table, shared: np.ndarray, hot: np.ndarray) -> pa.Table:
        """Two bits for each hash of each piece."""
        cuts = np.cumsum(self.sizes)[:-1]
        each = [(s, h) for s, h in zip(np.split(shared[self.entry], cuts), np.split(hot[self.entry], cuts))]
        blobs = [pack(np.packbits(s), np.packbits(h)) for s, h in each]
        return pa.table({"child": part.column("child"), "part": part.column("part"), "blob": pa.array(blobs, pa.binary()), "hot": pa.array([int(h.sum()) for _, h in each], pa.int64())})


def _hashes_up(part: pa.Table, lv: Levels, level: int) -> pa.Table:
    h, g = Hashes(part.column("blob")), part.column("g")[0].as_py()
    ranges, first = np.unique(_short_part(h.key, lv.ranges[level + 1]), return_index=True)
    cuts = zip(first, np.append(first[1:], len(h.key)))
    blobs = [_hash_blob(h.key[a:b], h.multi[a:b], h.counts[a:b], h.marks[a:b]) for a, b in cuts]
    return _rows([g // lv.fan] * len(blobs), ranges.tolist(), [g] * len(blobs), blobs)


def _hashes_answered(part: pa.Table, hot: int) -> pa.Table:
    h = Hashes(part.column("blob"))
    return h.answers(part, h.multi, h.multi & (h.counts > hot))


def _hashes_down(part: pa.Table, told: pa.Table, lv: Levels, level: int) -> pa.Table:
    h = Hashes(part.column("blob"))
    ranges, sizes = np.unique(_short_part(h.key, lv.ranges[level + 1]), return_counts=True)
    size = dict(zip(ranges.tolist(), sizes.tolist()))
    bits = [_bits(r["blob"], size[r["part"]]) for r in sorted(told.to_pylist(), key=lambda r: r["part"])]
    return h.answers(part, *(np.concatenate([b[k] for b in bits]) for k in (0, 1)))


def _bits(blob: bytes, n: int) -> list[np.ndarray]:
    return [np.unpackbits(x, count=n).astype(bool) for x in unpack(blob, np.uint8, np.uint8)]


def _cut_hashes(lv: Levels, block: int, keys: np.ndarray, *more: np.ndarray) -> list[pa.RecordBatch]:
    """The pieces of a block's sorted distinct hashes."""
    short = keys >> np.uint64(16)
    ranges, first = np.unique(part_of(keys, lv.ranges[0]), return_index=True)
    blobs = [_hash_blob(short[a:b], *(x[a:b] for x in more)) for a, b in zip(first, np.append(first[1:], len(keys)))]
    return _rows([group_of(block, lv)] * len(blobs), ranges.tolist(), [block] * len(blobs), blobs).combine_chunks().to_batches()


def group_of(block: int, lv: Levels) -> int:
    """The group of a block at the first level; those of a task are spread."""
    return (block * 0x9E3779B97F4A7C15 % (1 << 64) >> 16) % lv.groups[0]


def _runs_of(keys: np.ndarray, other: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of keys with documents and another number each: the distinct keys; are they in several documents; how many other numbers; their sum."""
    if not len(keys):
        return keys, np.empty(0, bool), np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys, other, docs = keys[order], other[order], docs[order]
    new = np.append(True, keys[1:] != keys[:-1])
    first = np.flatnonzero(new)
    # Most keys occur once; the numbers of the others are put in order within each key.
    often = np.flatnonzero(~new | np.append(~new[1:], False))
    group = np.cumsum(new)[often]
    sub = often[np.lexsort((other[often], group))]
    other[often] = other[sub]
    fresh = new | np.append(True, other[1:] != other[:-1])
    multi = np.maximum.reduceat(docs, first) != np.minimum.reduceat(docs, first)
    return keys[first], multi, np.add.reduceat(fresh.astype(np.int64), first), np.add.reduceat(np.where(fresh, (other & np.uint64(0xFFFF)).astype(np.int64), 0), first) & 0xFFFF


def _send_hashes(lv: Levels):
    """The distinct gram hashes of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, body in zip(*(batch.column(c) for c in ("block", "sizes", "body"))):
                b = Block(sizes.as_py(), body.as_py())
                yield from _cut_hashes(lv, block.as_py(), *_runs_of(b.key, b.prints(), b.doc))

    return run


def _record_flags(b: Block, masks) -> list[np.ndarray]:
    """The two bits of the gram of each of the block's records."""
    keys, entry = np.unique(b.key, return_inverse=True)
    return [f[entry] for f in _flags(masks, keys)]


def _hot_strings(b: Block, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, documents, keys) of the strings of the flagged records."""
    at, doc = b.apart(np.flatnonzero(hot))
    return at, doc, b.string_keys(at)


def _send_strings(lv: Levels):
    """The distinct string hashes of each block's records with a hot gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, body, masks in zip(*(batch.column(c) for c in ("block", "sizes", "body", "masks"))):
                b = Block(sizes.as_py(), body.as_py())
                _, doc, key = _hot_strings(b, _record_flags(b, masks)[1])
                if len(key):
                    keys, multi, _, _ = _runs_of(key, np.zeros(len(key), np.uint64), doc)
                    none = np.zeros(len(keys), np.int64)
                    yield from _cut_hashes(lv, block.as_py(), keys, multi, none, none)

    return run


def _flags(masks, keys: np.ndarray) -> list[np.ndarray]:
    """The two bits of each of a block's sorted distinct hashes, from the answers of the ranges."""
    out = [np.zeros(len(keys), bool), np.zeros(len(keys), bool)]
    if masks.is_valid:
        told = {x["part"].as_py(): x["blob"].as_py() for x in masks.values}
        ranges, first = np.unique(part_of(keys, masks.values[0]["ranges"].as_py()), return_index=True)
        for r, a, b in zip(ranges.tolist(), first, np.append(first[1:], len(keys))):
            out[0][a:b], out[1][a:b] = _bits(told[r], b - a)
    return out


# -- runs of records -----------------------------------------------------------------------------
def encode(rows: np.ndarray, docs: np.ndarray) -> bytes:
    """Sorted records and their smallest doc_ids as a front-coded run."""
    m = np.frombuffer(rows.tobytes(), np.uint8).reshape(-1, WIDTH)
    shared = np.zeros(len(m), np.uint8)
    shared[1:] = (m[1:] != m[:-1]).argmax(axis=1)
    col = np.arange(LONGEST)
    rest = m[:, :LONGEST][(col >= shared[:, None]) & (col < m[:, LONGEST + 1, None])]
    return pack(shared, m[:, LONGEST].copy(), m[:, LONGEST + 1].copy(), rest, np.diff(docs, prepend=0))


class Runs:
    """What a block merges: the records whose gram others have, and the strings of hot ones that others have; sorted and distinct, by range."""

    def __init__(self, b: Block, masks, strings, lv: Levels, doc_ids: np.ndarray):
        shared, hot = _record_flags(b, masks)
        pick = np.flatnonzero(shared & ~hot)
        rows, key = b.records(pick), b.key[pick]
        self.at, self.strings, self.doc = b.at[pick], b.strings[pick], b.doc[pick]
        if hot.any():
            at, doc, own = _hot_strings(b, hot)
            known, entry = np.unique(own, return_inverse=True)
            keep = _flags(strings, known)[0][entry]
            rows, key = np.concatenate([rows, b.string_records(at[keep])]), np.concatenate([key, own[keep]])
            self.at, self.strings, self.doc = (np.concatenate(x) for x in ((self.at, at[keep]), (self.strings, np.ones(keep.sum(), np.int64)), (self.doc, doc[keep])))
        part = part_of(key, lv.ranges[0])
        order = np.argsort(rows, kind="stable")
        order = order[np.argsort(part[order], kind="stable")]
        rows, part = rows[order], part[order]
        new = np.append(True, (rows[1:] != rows[:-1]) | (part[1:] != part[:-1])) if len(rows) else np.empty(0, bool)
        self.entry = np.empty(len(rows), np.int64)  # of each record and string
        self.entry[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.rows, self.part = rows[first], part[first]
        self.least_doc = np.minimum.reduceat(doc_ids[self.doc][order], first) if len(first) else np.empty(0, np.int64)

    def pieces(self) -> Iterator[tuple[int, bytes]]:
        ranges, first = np.unique(self.part, return_index=True)
        for r, a, b in zip(ranges.tolist(), first, np.append(first[1:], len(self.part))):
            yield r, encode(self.rows[a:b], self.least_doc[a:b])


def _ids(doc_ids) -> np.ndarray:
    return np.array([NOBODY if x is None else x for x in doc_ids.as_py()], np.int64)


def _send_runs(lv: Levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, doc_ids, sizes, body, masks, strings in zip(*(batch.column(c) for c in ("block", "doc_ids", "sizes", "body", "masks", "strings"))):
                rows = list(Runs(Block(sizes.as_py(), body.as_py()), masks, strings, lv, _ids(doc_ids)).pieces())
                n = block.as_py()
                if rows:
                    yield from _rows([group_of(n, lv)] * len(rows), [p for p, _ in rows], [n] * len(rows), [x for _, x in rows]).combine_chunks().to_batches()

    return run


def decode(blob: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(record, prefix shared with the one before, smallest doc_id) of a front-coded run."""
    shared, left, whole, rest, docs = unpack(blob, np.uint8, np.uint8, np.uint8, np.uint8, np.int64)
    rest, at, last = rest.tobytes(), 0, b""
    for s, l, n, d in zip(shared.tolist(), left.tolist(), whole.tolist(), np.cumsum(docs).tolist()):
        k = s if s < n else n
        last = last[:k] + rest[at : at + n - k]
        at += n - k
        yield last.ljust(LONGEST, b"\0") + bytes((l, n)), s, d


def first_difference(a: bytes, b: bytes, k: int) -> int:
    while k < WIDTH and a[k : k + 8] == b[k : k + 8]:
        k += 8
    while k < WIDTH and a[k] == b[k]:
        k += 1
    return k if k < WIDTH else WIDTH


def merge(runs: list[Iterator[tuple[bytes, int, int]]]) -> Iterator[tuple[bytes, int, int, int]]:
    """(record, prefix shared with the one before, run, doc_id) in the order of records.

    A loser tree: node k keeps the run that lost there and how long a prefix it shares with the
    winner.  Of two runs compared with the same winner, the one that shares more of it is next, and
    records are compared only behind a prefix that both share.
    """
    width = 1
    while width < len(runs):
        width *= 2
    end = iter(())
    feed = [*runs, *[end] * (width - len(runs))]
    now: list[bytes] = [b""] * width
    docs = [0] * width
    lcp = [0] * width  # with the last winner; below 0: the run has ended

    def pull(r: int) -> None:
        x = next(feed[r], None)
        if x is None:
            lcp[r] = -1
        else:
            now[r], lcp[r], docs[r] = x

    def fight(a: int, b: int) -> tuple[int, int]:
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        if lcp[a] < 0:
            return a, b
        k = first_difference(now[a], now[b], lcp[a])
        if k == WIDTH or now[a][k] < now[b][k]:
            lcp[b] = k
            return a, b
        lcp[a] = k
        return b, a

    for r in range(width):
        pull(r)
        lcp[r] = min(lcp[r], 0)
    loser = [0] * width
    level = list(range(width))
    node = width // 2
    while len(level) > 1:
        fought = [fight(level[k], level[k + 1]) for k in range(0, len(level), 2)]
        for k, (_, lost) in enumerate(fought):
            loser[node + k] = lost
        level = [w for w, _ in fought]
        node //= 2
    win = level[0]
    while lcp[win] >= 0:
        yield now[win], lcp[win], win, docs[win]
        pull(win)
        k = (win + width) // 2
        while k:
            other = loser[k]
            a, b = lcp[win], lcp[other]
            if a == b:
                win, loser[k] = fight(win, other)
            elif a < b:
                win, loser[k] = other, win
            k //= 2


def strings_of(record: bytes) -> list[bytes]:
    left, whole = record[LONGEST], record[LONGEST + 1]
    if left == ALONE:
        return [record[:MATCH]]
    text = record[whole - left : whole][::-1] + record[: whole - left]
    return [text[k : k + MATCH] for k in range(whole - MATCH + 1)]


def merged(part: pa.Table) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """(records, smallest doc_ids) of the merged runs of a range, without repeats, and the places there of each run's records."""
    runs = [decode(x.as_py()) for x in part.column("blob")]
    records: list[bytes] = []
    docs: list[int] = []
    places: list[list[int]] = [[] for _ in runs]
    for rec, shared, r, d in merge(runs):
        if not records or shared < WIDTH:
            records.append(rec)
            docs.append(d)
        elif d < docs[-1]:
            docs[-1] = d
        places[r].append(len(records) - 1)
    return np.array(records, f"S{WIDTH}"), np.array(docs, np.int64), places


def _runs_up(part: pa.Table, lv: Levels, level: int) -> pa.Table:
    """A range's merged run, cut into the ranges of the next level."""
    g = part.column("g")[0].as_py()
    rows, docs, _ = merged(part)
    sub = part_of(keys_of(rows), lv.ranges[level + 1])
    ranges = np.unique(sub).tolist()
    blobs = [encode(rows[sub == r], docs[sub == r]) for r in ranges]
    return _rows([g // lv.fan] * len(blobs), ranges, [g] * len(blobs), blobs)


def _answer_table(part: pa.Table, counts: list, values: list) -> pa.Table:
    blobs = [pack(np.asarray(c, np.uint8), np.diff(np.asarray(v, np.int64), prepend=0)) for c, v in zip(counts, values)]
    return pa.table({"child": part.column("child"), "part": part.column("part"), "blob": pa.array(blobs, pa.binary()), "hot": pa.array([0] * len(blobs), pa.int64())})


def _runs_down(part: pa.Table, told: pa.Table, lv: Levels, level: int) -> pa.Table:
    """The answers to a range's merged run, handed to the runs that it was merged from."""
    rows, _, places = merged(part)
    order = np.argsort(part_of(keys_of(rows), lv.ranges[level + 1]), kind="stable")  # as _runs_up has cut them
    got = [unpack(r["blob"], np.uint8, np.int64) for r in sorted(told.to_pylist(), key=lambda r: r["part"])]
    n = np.concatenate([c for c, _ in got]).astype(np.int64)
    flat = np.concatenate([np.cumsum(v) for _, v in got])
    counts, start = np.empty_like(n), np.empty_like(n)
    counts[order], start[order] = n, np.cumsum(n) - n
    out_counts, out_values = [], []
    for run in places:
        at = np.array(run, np.int64)
        c = counts[at]
        out_counts.append(c)
        out_values.append(flat[np.repeat(start[at], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)])
    return _answer_table(part, out_counts, out_values)


def least_of_strings(records: list[bytes], docs: list[int]) -> list[list[int]]:
    """For each of different records with one gram, the smallest doc_id of each of its strings among all of them."""
    best: dict[bytes, int] = {}
    seen = [strings_of(rec) for rec in records]
    for strings, d in zip(seen, docs):
        for x in strings:
            if best.get(x, NOBODY) >= d:
                best[x] = d
    return [[best[x] for x in strings] for strings in seen]


def least_of_many(records: list[bytes], docs: list[int]) -> list[list[int]]:
    """As least_of_strings, in arrays: strings meet by their keys and are then compared byte by byte."""
    m = np.frombuffer(b"".join(records), np.uint8).reshape(-1, WIDTH)
    left, whole = (np.where(m[:, LONGEST] == ALONE, 0, m[:, LONGEST]).astype(np.int64)[:, None], m[:, LONGEST + 1].astype(np.int64)[:, None])
    col = np.arange(LONGEST)
    text = np.take_along_axis(m, np.clip(np.where(col < left, whole - 1 - col, col - left), 0, LONGEST - 1), axis=1)
    n = whole[:, 0] - MATCH + 1
    rows = [np.flatnonzero(n > k) for k in range(SPAN)]
    key = np.concatenate([string_key(text[r, k : k + MATCH]) for k, r in enumerate(rows)])
    rec, at = np.concatenate(rows), np.repeat(np.arange(SPAN), [len(r) for r in rows])
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order][1:] != key[order][:-1])
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    head = order[first][group]
    span = np.arange(MATCH)
    for lo in range(0, len(order), 50_000):
        a, b = order[lo : lo + 50_000], head[lo : lo + 50_000]
        if (text[rec[a, None], at[a, None] + span] != text[rec[b, None], at[b, None] + span]).any():
            return least_of_strings(records, docs)  # two strings with one key
    least = np.minimum.reduceat(np.array(docs, np.int64)[rec[order]], first)
    value = np.empty(len(order), np.int64)
    value[order] = least[group]
    flat = value[np.lexsort((at, rec))]
    return [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]


def _runs_answered(part: pa.Table) -> pa.Table:
    """For each run of a hash range and each of its records, the smallest doc_id of its strings.

    One number if all its strings have the same, else one for each string.
    """
    runs = [decode(x.as_py()) for x in part.column("blob")]
    counts: list[bytearray] = [bytearray() for _ in runs]
    values: list[list[int]] = [[] for _ in runs]
    records: list[bytes] = []  # the different ones of a gram
    docs: list[int] = []
    members: list[list[int]] = []  # the runs that have each of them

    def settle() -> None:
        if len(records) == 1:
            found = [[docs[0]]]
        else:
            found = (least_of_many if len(records) > 64 else least_of_strings)(records, docs)
        # The runs get their records in the order of the records.
        for told, own in zip(found, members):
            if told.count(told[0]) == len(told):
                told = told[:1]
            for r in own:
                counts[r].append(len(told))
                values[r].extend(told)

    for rec, shared, r, d in merge(runs):
        if records and shared < GRAM:
            settle()
            records, docs, members = [], [], []
        if records and shared == WIDTH:
            docs[-1] = min(docs[-1], d)
            members[-1].append(r)
        else:
            records.append(rec)
            docs.append(d)
            members.append([r])
    if records:
        settle()
    return _answer_table(part, [np.frombuffer(bytes(c), np.uint8) for c in counts], values)


def _cut(lv: Levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, sizes, body, masks, strings, answers in zip(*(batch.column(c) for c in ("doc_ids", "sizes", "body", "masks", "strings", "answers"))):
                b, ids = Block(sizes.as_py(), body.as_py()), _ids(doc_ids)
                marks = np.zeros(b.size + 1, np.int32)
                if answers.is_valid:
                    r = Runs(b, masks, strings, lv, ids)
                    got = {x["part"].as_py(): unpack(x["blob"].as_py(), np.uint8, np.int64) for x in answers.values}
                    order = sorted(got)
                    counts = np.concatenate([got[p][0] for p in order]).astype(np.int64)
                    values = np.concatenate([np.cumsum(got[p][1]) for p in order])
                    first = np.cumsum(counts) - counts
                    entry, at, n_strings, own = r.entry, r.at, r.strings, ids[r.doc]
                    one = counts[entry] == 1
                    cut = one & (values[first[entry]] < own)
                    np.add.at(marks, at[cut], 1)
                    np.add.at(marks, at[cut] + n_strings[cut] + MATCH - 1, -1)
                    many = np.flatnonzero(~one)
                    n = counts[entry[many]]
                    which = np.repeat(many, n)
                    nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                    hit = values[first[entry[which]] + nth] < own[which]
                    place = at[which[hit]] + nth[hit]
                    np.add.at(marks, place, 1)
                    np.add.at(marks, place + MATCH, -1)
                gone = np.cumsum(marks[:-1]) > 0
                rows: list[tuple] = []
                raw, start = b.buf, 0
                for doc_id, size in zip(doc_ids.as_py(), b.sizes.tolist()):
                    out = gone[start : start + size]
                    removed = int(np.count_nonzero(out))
                    if removed:
                        edge = np.flatnonzero(np.diff(out, prepend=False, append=False))
                        spans = [{"start": int(s), "size": int(e - s)} for s, e in zip(edge[::2], edge[1::2])]
                        kept = raw[start : start + size][~out].tobytes()
                    else:
                        spans, kept = [], raw[start : start + size].tobytes()
                    rows.append((doc_id, size, removed, len(spans), hashlib.sha256(kept).hexdigest(), spans))
                    start += size
                cols = list(zip(*rows))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def find_repeats(docs: DataFrame, *, block_bytes: int = 6 << 20, part_bytes: int = 16 << 20, fan: int = FAN, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (start, size) of each document.

    block_bytes: text of a block, held by one task; part_bytes: text for each hash range; fan: runs of a
    merge; hot: different records of a gram beyond which their strings go by themselves.
    """
    stages = Stages(docs.sparkSession)
    blocks = stages.write("blocks", docs.select("doc_id", "text").mapInArrow(lean(_pack_blocks(block_bytes)), BLOCKS))
    size = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    lv = levels(size.n, size.bytes or 0, part_bytes, fan)

    def by_block(answers: DataFrame, name: str) -> DataFrame:
        return answers.groupBy(F.col("child").alias("block")).agg(F.collect_list(F.struct("part", "blob", F.lit(lv.ranges[0]).alias("ranges"))).alias(name))

    hash_steps = _hashes_up, partial(_hashes_answered, hot=hot), _hashes_down
    answers = exchange(blocks.select("block", "sizes", "body").mapInArrow(lean(_send_hashes(lv)), PIECES), lv, stages, "hashes", *hash_steps)
    known = blocks.join(by_block(answers, "masks"), "block", "left")
    if answers.agg(F.sum("hot")).first()[0]:
        alone = known.select("block", "sizes", "body", "masks").mapInArrow(lean(_send_strings(lv)), PIECES)
        told = exchange(alone, lv, stages, "strings", *hash_steps)
        known = known.join(by_block(told, "strings"), "block", "left")
    else:
        known = known.withColumn("strings", F.lit(None).cast("array<struct<part:int,blob:binary,ranges:int>>"))
    cols = ["doc_ids", "sizes", "body", "masks", "strings"]
    runs = known.where("masks is not null").select("block", *cols).mapInArrow(lean(_send_runs(lv)), PIECES)
    found = exchange(runs, lv, stages, "runs", _runs_up, _runs_answered, _runs_down)
    sides = known.join(by_block(found, "answers"), "block", "left")
    result = stages.write("result", sides.select(*cols, "answers").mapInArrow(lean(_cut(lv)), RESULT), batch_rows=4)
    stages.drop(*(name for name in list(stages.paths) if name != "result"))
    return result
