"""Phrase collocation mining by vertical positional inverted lists.

Texts are cut into blocks.  A block holds, for each of its phrases, the sorted list of the positions at which
the phrase begins; the length of the list is its exact frequency there.  A phrase of n words is
extended by the word behind it: its list is merge-joined with the list of the phrases that begin one
position later and end in that word, and what meets is the list of the longer phrase.  Only phrases that
are frequent in the whole corpus are extended: for each length the blocks send the lengths of their lists,
packed and dealt by a hash of the phrase; the sums of a part tell each block which of its phrases are frequent, and under
which number.  Lists of phrases that may not be frequent are not stored: the next pass makes them again from the lists of the phrases one word shorter.

Frequencies are per language.  Positions skip a number between pieces and between texts, so no phrase
crosses them.  A block, its lists and its answers are one task's work and bounded by ``block_bytes``
of text (or one longer text); a part holds about ``part_keys`` phrases of all blocks.

Defined results for odd input: null and blank texts have no words; a null language is ``und``; rows
without ``doc_id``, repeated ids and repeated rows all count; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import Stages, lean

#: What ends a piece, and what parts words inside one.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: UTF-8 bytes of text that a block holds (more only if one text is longer).
BLOCK_BYTES = 24 << 20
#: Phrases of all blocks, about, whose counts one task adds up.
PART_KEYS = 1 << 20
NO_LANGUAGE = "und"

#: A state row holds the lists of a block: positions, lengths and the numbers of the phrases (none for words not asked for yet).
#: A piece holds the phrases of a block in one part: words, or the numbers x and y of both parts of each, and n; first is the place of its first list.
BLOCK = "block bigint, part int, first int, lang string, total bigint, words binary, x binary, y binary, n binary, positions binary, lengths binary, gids binary"
#: An answer says which lists of a piece are frequent (at) and their numbers; the other rows are the frequent phrases.
MERGED = "block bigint, first int, at binary, gids binary, gid bigint, lang string, word string, x bigint, y bigint, f bigint"
_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _rows(schema: str, **columns) -> pa.Table:
    """Rows of a schema from some of its columns; the others are null."""
    kinds = {c.split()[0]: _KINDS[c.split()[1]] for c in schema.split(", ")}
    n = len(next(iter(columns.values())))
    return pa.table({c: pa.array(columns[c], kind) if c in columns else pa.nulls(n, kind) for c, kind in kinds.items()})


def pack(a: np.ndarray, delta: bool = False) -> bytes:
    """Whole numbers (or their steps), the low bytes of all first, then the next ones; bytes that are zero in all are left out.

    What compresses the rows later finds long runs in that order.
    """
    a = np.asarray(a, dtype=np.int64)
    a = np.diff(a, prepend=0) if delta else a
    planes = ((a << 1) ^ (a >> 63)).view(np.uint8).reshape(-1, 8).T
    width = int(np.flatnonzero(planes.any(axis=1)).max(initial=-1)) + 1 if len(a) else 0
    return bytes([width]) + len(a).to_bytes(8, "little") + planes[:width].tobytes()


def unpack(b: bytes, delta: bool = False) -> np.ndarray:
    width, n = b[0], int.from_bytes(b[1:9], "little")
    planes = np.zeros((8, n), dtype=np.uint8)
    planes[:width] = np.frombuffer(b, dtype=np.uint8, offset=9).reshape(width, n)
    a = np.ascontiguousarray(planes.T).view(np.int64).reshape(-1)
    a = ((a >> 1) & 0x7FFFFFFFFFFFFFFF) ^ -(a & 1)
    return np.cumsum(a) if delta else a


def _state(block: int, place: np.ndarray, owner: np.ndarray, n: int, gids: np.ndarray | None) -> pa.Table:
    """The state of lists given as their positions and the list of each."""
    order = np.lexsort((place, owner))
    return _rows(BLOCK, block=[block], positions=[pack(place[order], delta=True)], lengths=[pack(np.bincount(owner, minlength=n))], gids=[None if gids is None else pack(gids)])


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(the words in order, the number of the text of each, the number of piece ends before each), A-Z in lower case."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    kinds = np.zeros(256, dtype=np.int8)
    kinds[list(BLANKS)] = 1
    kinds[list(ENDS)] = 2
    kind = kinds[data]
    inside = kind == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begins[edges] |= inside[edges]
    at = np.flatnonzero(begins)
    letters = np.cumsum(inside, dtype=np.int64)
    starts = letters[at] - 1
    ended = np.cumsum(kind == 2, dtype=np.int64)[at]
    body = lower[data[inside]]
    bounds = np.append(starts, len(body)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(body.tobytes())])
    return words, np.searchsorted(offsets, at, side="right") - 1, ended


def _lists_of_words(block: int, texts: pa.Array, langs: pa.Array, parts: int):
    """The state and the pieces of a block: lists in order of (language, part)."""
    found = langs.fill_null(NO_LANGUAGE).dictionary_encode()
    codes = found.indices.to_numpy(zero_copy_only=False)
    places, owners, pieces, base, first = [], [], [], 0, 0
    for code, lang in enumerate(found.dictionary.to_pylist()):
        words, text, ended = words_of(texts.filter(pa.array(codes == code)))
        if not len(words):
            continue
        coded = words.dictionary_encode()
        known = coded.dictionary.to_pylist()
        part = np.fromiter((zlib.crc32(w) % parts for w in known), dtype=np.int64, count=len(known))
        order = np.argsort(part, kind="stable")
        rank = np.empty(len(known), dtype=np.int64)
        rank[order] = np.arange(len(known))
        owner = rank[coded.indices.to_numpy(zero_copy_only=False)]
        place = np.arange(len(owner), dtype=np.int64) + text + ended + first
        first = int(place[-1]) + 2
        places.append(place)
        owners.append(owner + base)
        n = np.bincount(owner, minlength=len(known))
        for at in np.split(np.arange(len(known)), np.flatnonzero(np.diff(part[order])) + 1):
            pieces.append((int(part[order[at[0]]]), base + int(at[0]), lang, int(n[at].sum()), b" ".join(known[k] for k in order[at]), pack(n[at])))
        base += len(known)
    if base:
        yield _state(block, np.concatenate(places), np.concatenate(owners), base, None)
        part, start, lang, total, words, n = zip(*pieces)
        yield _rows(BLOCK, block=[block] * len(part), part=part, first=start, lang=lang, total=total, words=words, n=n)


def _blocks(block_bytes: int, parts: int):
    """Batches of (lang, text) to blocks of lists of words."""

    @lean
    def run(batches):
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def lists():
            rows = pa.Table.from_batches(held).combine_chunks()
            for t in _lists_of_words((task << 32) + number, rows.column("text").combine_chunks(), rows.column("lang").combine_chunks(), parts):
                yield from t.to_batches(max_chunksize=256)

        for batch in batches:
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= block_bytes:
                yield from lists()
                number, held, size = number + 1, [], 0
        if size:
            yield from lists()

    return run


def part_of(x: np.ndarray, y: np.ndarray, parts: int) -> np.ndarray:
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + y.astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(parts)).astype(np.int64)


def extend(place: np.ndarray, owner: np.ndarray, gids: np.ndarray, parts: int):
    """Lists of phrases one word longer, in order of (part, x, y).

    place, owner: the positions of the lists and the list of each; gids: the numbers of the lists.
    Returns place and owner of the new lists, and x, y, n and part of each.
    """
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    meets = np.flatnonzero(place[1:] == place[:-1] + 1)
    found, back = np.unique(owner[meets] * max(1, len(gids)) + owner[meets + 1], return_inverse=True)
    x, y = gids[found // max(1, len(gids))], gids[found % max(1, len(gids))]
    part = part_of(x, y, parts)
    order = np.lexsort((y, x, part))
    rank = np.empty(len(found), dtype=np.int64)
    rank[order] = np.arange(len(found))
    owner = rank[back]
    return place[meets], owner, x[order], y[order], np.bincount(owner, minlength=len(found)), part[order]


def _longer(parts: int, before: int, last: bool):
    """A block's state and the answers to its pieces -> the state of its frequent phrases and the pieces of those one word longer.

    before: the number of parts when the pieces were dealt.
    """

    def run(left, right):
        if not left.num_rows or not right.num_rows:
            return _rows(BLOCK, block=[])
        state = left.to_pylist()[0]
        place, lengths = unpack(state["positions"], delta=True), unpack(state["lengths"])
        owner, lists = np.repeat(np.arange(len(lengths)), lengths), len(lengths)
        if state["gids"] is not None:
            place, owner, _, _, n, _ = extend(place, owner, unpack(state["gids"]), before)
            lists = len(n)
        answers = right.to_pylist()
        lids = np.concatenate([unpack(r["at"], delta=True) + r["first"] for r in answers])
        gids = np.concatenate([unpack(r["gids"], delta=True) for r in answers])
        number = np.full(lists, -1, dtype=np.int64)
        number[lids] = np.arange(len(lids))
        owner = number[owner]
        place, owner = place[owner >= 0], owner[owner >= 0]
        out = [] if last else [_state(state["block"], place, owner, len(gids), gids)]
        _, _, x, y, n, part = extend(place, owner, gids, parts)
        if len(n):
            cut = np.split(np.arange(len(n)), np.flatnonzero(np.diff(part)) + 1)
            out.append(_rows(
                BLOCK, block=[state["block"]] * len(cut), part=[int(part[c[0]]) for c in cut], first=[int(c[0]) for c in cut],
                x=[pack(x[c], delta=True) for c in cut], y=[pack(y[c]) for c in cut], n=[pack(n[c]) for c in cut],
            ))
        return pa.concat_tables(out) if out else _rows(BLOCK, block=[])

    return run


def _summed(least: int):
    """The pieces of one part -> its frequent phrases, and an answer to each piece that has any."""

    def run(key, t):
        rows, part = t.to_pylist(), key[0].as_py()
        n = np.concatenate([unpack(r["n"]) for r in rows])
        ends = np.cumsum([int.from_bytes(r["n"][1:9], "little") for r in rows])
        if rows[0]["words"] is not None:
            langs = {v: k for k, v in enumerate(sorted({r["lang"] for r in rows}))}
            words = pa.array([w for r in rows for w in r["words"].split(b" ")], pa.binary()).dictionary_encode()
            x = np.repeat([langs[r["lang"]] for r in rows], np.diff(ends, prepend=0))
            y = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        else:
            x = np.concatenate([unpack(r["x"], delta=True) for r in rows])
            y = np.concatenate([unpack(r["y"]) for r in rows])
        order = np.lexsort((y, x))
        head = np.r_[True, (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])]
        group = np.empty(len(n), dtype=np.int64)
        group[order] = np.cumsum(head) - 1
        f = np.zeros(int(head.sum()), dtype=np.int64)
        np.add.at(f, group, n)
        number = np.where(f >= least, np.cumsum(f >= least) - 1, -1)
        top = order[head][f >= least]
        gids = (part << 32) + np.arange(len(top), dtype=np.int64)
        if not len(top):
            return _rows(MERGED, block=[])
        if rows[0]["words"] is not None:
            names = sorted(langs, key=langs.get)
            out = [_rows(MERGED, gid=gids, lang=[names[k] for k in x[top]], word=words.dictionary.take(pa.array(y[top])).cast(pa.string()), f=f[f >= least])]
        else:
            out = [_rows(MERGED, gid=gids, x=x[top], y=y[top], f=f[f >= least])]
        told = []
        for r, own in zip(rows, np.split(number[group], ends[:-1])):
            at = np.flatnonzero(own >= 0)
            if len(at):
                told.append((r["block"], r["first"], pack(at, delta=True), pack((part << 32) + own[at], delta=True)))
        if told:
            block, first, at, ids = zip(*told)
            out.append(_rows(MERGED, block=block, first=first, at=at, gids=ids))
        return pa.concat_tables(out)

    return run


def _levels(stages: Stages, docs: DataFrame, most_words: int, least: int, block_bytes: int, part_keys: int) -> tuple[DataFrame, list[DataFrame]]:
    """(lang and n of all words; the frequent phrases of 1, 2, ... words)."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col("text").cast("string").alias("text"))
    parts = max(8, rows.rdd.getNumPartitions())
    blocks = stages.write("lists-1", rows.mapInArrow(_blocks(block_bytes, parts), BLOCK), batch_rows=500)
    sizes = stages.write("sizes", blocks.where("total is not null").groupBy("lang").agg(F.sum("total").alias("n")))
    before, parts = parts, max(8, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // part_keys))
    levels = []
    for words in range(1, most_words + 1):
        pieces = blocks.where("part is not null").select("part", "block", "first", "lang", "words", "x", "y", "n")
        merged = stages.write(f"merged-{words}", pieces.groupBy("part").applyInArrow(_summed(least), MERGED))
        levels.append(merged.where("gid is not null"))
        if words == most_words:
            break
        told = merged.where("block is not null").select(F.col("block").alias("to_block"), "first", "at", "gids")
        states = blocks.where("part is null").select("block", "positions", "lengths", "gids")
        step = _longer(parts, before, words == most_words - 1)
        blocks = stages.write(f"lists-{words + 1}", states.groupBy("block").cogroup(told.groupBy("to_block")).applyInArrow(step, BLOCK))
        stages.drop(f"lists-{words}")
        before = parts
    stages.drop(f"lists-{most_words}")
    return sizes, levels


def mine(docs: DataFrame, *, most_words: int = 4, least: int = 30, scale: int = 2_000_000, covered: int = 80, block_bytes: int = BLOCK_BYTES, part_keys: int = PART_KEYS) -> DataFrame:
    """lang, phrase, words, a, l, r, k, n, score of the phrases of 2 to most_words words that occur least times or more.

    A phrase is cut into its first k words, which occur l times, and the rest, which occurs r times; the
    cut of the least score floor(scale * a / (l + r)) counts, of equal ones that of the smallest k.
    Phrases go that lie inside a longer one with at least covered percent of their occurrences; a
    phrase between both has at least as many as the longer one, so those one word longer decide.
    """
    stages = Stages(docs.sparkSession)
    with stages.cleared_on_error():
        sizes, levels = _levels(stages, docs, most_words, least, block_bytes, part_keys)
        # fs: frequencies of the first 1, 2, ... words and of the last 1, 2, ... words, the whole included.
        known = stages.write("known-1", levels[0].selectExpr("gid", "lang", "array(word) AS words", "array(f) AS firsts", "array(f) AS lasts"))
        out = []
        for k in range(1, most_words):
            pairs = levels[k].select("gid", "x", "y", "f")
            left = known.select(F.col("gid").alias("x"), "lang", "words", "firsts")
            right = known.select(F.col("gid").alias("y"), F.element_at("words", -1).alias("__word"), "lasts")
            joined = stages.write(f"halves-{k + 1}", pairs.join(left, "x")).join(right, "y")
            made = joined.select("gid", "x", "y", "f", "lang", F.concat("words", F.array("__word")).alias("words"), F.concat("firsts", F.array("f")).alias("firsts"), F.concat("lasts", F.array("f")).alias("lasts"))
            known = stages.write(f"known-{k + 1}", made)
            out.append(known)
        for k, phrases in enumerate(out):
            if k + 1 < len(out):
                inside = out[k + 1].select("f", F.explode(F.array("x", "y")).alias("gid")).groupBy("gid").agg(F.max("f").alias("__most"))
                phrases = phrases.join(inside, "gid", "left").where(F.col("__most").isNull() | (F.lit(100).cast("decimal(20,0)") * F.col("__most") < F.lit(covered).cast("decimal(20,0)") * F.col("f"))).drop("__most")
            out[k] = phrases.select("lang", "words", "f", "firsts", "lasts")
        all_phrases = out[0]
        for phrases in out[1:]:
            all_phrases = all_phrases.unionByName(phrases)
        # firsts[k - 1] is l of the cut behind k words, lasts[size - k - 1] its r.
        cuts = F.expr(f"""transform(sequence(1, size(words) - 1), k -> named_struct(
          'score', (cast(f AS decimal(20,0)) * {scale}) div (cast(firsts[k - 1] AS decimal(20,0)) + lasts[size(words) - k - 1]), 'k', k, 'l', firsts[k - 1], 'r', lasts[size(words) - k - 1]))""")
        scored = all_phrases.select("lang", "words", F.col("f").alias("a"), F.array_min(cuts).alias("cut")).join(sizes, "lang")
        return scored.select("lang", F.array_join("words", " ").alias("phrase"), F.size("words").alias("words"), "a", "cut.l", "cut.r", "cut.k", "n", "cut.score")


def best(phrases: DataFrame, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score, a and phrase."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = phrases.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))


def oracle(least: int = 30, top: int = 2000) -> str:
    """DuckDB SQL of the query: all n-grams counted, each candidate against all longer ones."""
    return rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang HAVING sum(len(w)) > 0),
g AS (SELECT lang, w[i:i + k - 1] AS s FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 5) t(k))),
f AS MATERIALIZED (SELECT lang, s, count(*) AS f FROM g GROUP BY lang, s HAVING count(*) >= {least}),
c AS (SELECT lang, s, f AS a, unnest(range(1, len(s))) AS k FROM f WHERE len(s) > 1),
x AS (SELECT c.lang, c.s, c.a, c.k, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.a) // (l.f + r.f))::BIGINT AS score FROM c JOIN f l ON l.lang = c.lang AND l.s = c.s[:k] JOIN f r ON r.lang = c.lang AND r.s = c.s[k + 1:]),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, k) = 1),
i AS (SELECT lang, f, s[j:j + m - 1] AS s FROM (SELECT lang, s, f, m, unnest(range(1, len(s) - m + 2)) AS j FROM f, range(2, 4) t(m) WHERE len(s) > m)),
z AS (SELECT lang, s, max(f) AS f FROM i GROUP BY lang, s),
k AS (SELECT y.* FROM y LEFT JOIN z USING (lang, s) WHERE z.f IS NULL OR 100::HUGEINT * z.f < 80::HUGEINT * y.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM (SELECT lang, array_to_string(s, ' ') AS phrase, a, l, r, score FROM k)) JOIN n USING (lang) WHERE rank <= {top}
"""
