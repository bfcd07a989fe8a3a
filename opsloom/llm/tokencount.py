"""Token counts by rank-synchronous array merging.

A text is cut into pre-tokens as byte-level vocabulary files say.  The distinct pre-tokens of a batch
are held as ragged numpy arrays of byte symbols.  In each round every sequence finds its lowest-rank
adjacent pair, and all sequences apply theirs at once; a sequence without a ranked pair is done.
The symbols that survive are the tokens.  A pre-token of more than ``LONG`` bytes is merged by itself:
the places of its pairs are held by rank, all places of the lowest rank merge at once, and only the
pairs beside a merge are ranked anew, so its time grows with its length times its logarithm.

The file's own settings are read.  What is supported: a BPE model with ranked merges only, no
normalizer, a byte-level pre-tokenizer with its usual pattern and without a prefix space, and added
tokens without flags; any other file is refused with a ValueError.  Texts with characters that
versions of Unicode classify differently are cut by the library's splitter, all others by ``PATTERN``.

Defined results for odd input: a null text counts as empty (0 bytes, 0 tokens); special strings
inside texts are matched first, as the library does by default; repeated rows are each counted; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import lean, parts

#: Fixed value: the split pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that every Unicode version in use classifies alike; texts with others are cut by the library's own splitter.
UNSTABLE = regex.compile(r"[^\u0000-ԯ -⁯　-鿿가-힣]")
CACHE = 500_000
#: Pre-tokens of more bytes are merged one at a time, and those of more characters are not kept for later texts.
LONG, KEPT = 2048, 256
#: Pre-tokens that a task cuts before it counts them.
STEP = 200_000
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for k, b in enumerate(x for x in range(256) if x not in out):
        out[b] = chr(256 + k)
    return out


def check(spec: dict) -> None:
    """Raises ValueError unless the tokenizer file asks for no more than Merger and _counter do."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type", "BPE") != "BPE":
        wrong.append(f"model {model['type']}")
    if spec.get("normalizer"):
        wrong.append("normalizer")
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        wrong.append("pre_tokenizer")
    wrong += [f"added token {t['content']!r}" for t in spec.get("added_tokens", []) if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
    if wrong:
        raise ValueError(f"not supported in a tokenizer file: {', '.join(wrong)}")


class Merger:
    """Counts the symbols that a byte-level merge list leaves of byte strings."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        check(spec)
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.left, self.right = left, right
        self.keys, self.ranks = keys[order], np.arange(len(keys))[order]
        self.product = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.start = np.array([vocab[c] for _, c in sorted(byte_alphabet().items())], np.int64)
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.none = len(keys)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each non-empty byte string."""
        result = np.zeros(len(pieces), np.int64)
        short = [k for k, p in enumerate(pieces) if len(p) <= LONG]
        if short:
            result[short] = self.count_short([pieces[k] for k in short])
        for k, p in enumerate(pieces):
            if len(p) > LONG:
                result[k] = self.count_long(p)
        return result

    def count_long(self, piece: bytes) -> int:
        """Tokens of one byte string: its pairs by rank, lowest first."""
        ids = self.start[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ids = np.append(ids, -1)  # the end, which pairs with nothing
        rank = self.rank(ids[:-1], ids[1:])
        at = np.flatnonzero(rank < self.none)
        at = at[np.argsort(rank[at], kind="stable")]
        ranks, first = np.unique(rank[at], return_index=True)
        places: dict[int, list] = {r: [p] for r, p in zip(ranks.tolist(), np.split(at, first[1:]))} if len(at) else {}
        heap, left = ranks.tolist(), n
        while heap:
            r = heapq.heappop(heap)
            found = places.pop(r)
            at = found[0] if len(found) == 1 and isinstance(found[0], np.ndarray) else np.unique(np.concatenate([np.atleast_1d(x) for x in found]))
            # A place that was merged away holds -1, so its pair has another rank now.
            at = at[ids[at] == self.left[r]]
            at = at[ids[after[at]] == self.right[r]]
            if self.left[r] == self.right[r] and len(at) > 1:
                # In a run of overlapping pairs every other one merges, from the left.
                head = np.append(True, after[at[:-1]] != at[1:])
                nth = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                at = at[nth % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            ids[at], ids[gone] = self.product[r], -1
            behind = after[gone]
            after[at] = behind
            inside = behind < n
            before[behind[inside]] = at[inside]
            left -= len(at)
            ahead = before[at]
            at = np.unique(np.concatenate([at, ahead[ahead >= 0]]))
            rank = self.rank(ids[at], ids[after[at]])
            new = rank < self.none
            at, rank = at[new], rank[new]
            if len(at) > 64:
                order = np.argsort(rank, kind="stable")
                ranks, first = np.unique(rank[order], return_index=True)
                fresh = zip(ranks.tolist(), np.split(at[order], first[1:]))
            else:
                fresh = zip(rank.tolist(), at.tolist())
            for r, p in fresh:
                if r in places:
                    places[r].append(p)
                else:
                    places[r] = [p]
                    heapq.heappush(heap, r)
        return left

    def count_short(self, pieces: list[bytes]) -> np.ndarray:
        size = np.array([len(p) for p in pieces], np.int64)
        result = size.copy()
        ids = self.start[np.frombuffer(b"".join(pieces), np.uint8)]
        seq = np.repeat(np.arange(len(pieces)), size)
        while len(ids) > 1:
            rank = self.rank(ids[:-1], ids[1:])
            rank[seq[:-1] != seq[1:]] = self.none
            rank = np.append(rank, self.none)
            first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            low = np.minimum.reduceat(rank, first)
            each = np.repeat(low, np.diff(np.append(first, len(seq))))
            hit = np.flatnonzero((rank == each) & (rank < self.none))
            if not len(hit):
                break
            # In a run of overlapping hits (the pair x x within x x x) every other one counts, from the left.
            head = np.append(True, (np.diff(hit) != 1) | (rank[hit[1:]] != rank[hit[:-1]]))
            run = np.maximum.accumulate(np.where(head, hit, 0))
            hit = hit[(hit - run) % 2 == 0]
            ids[hit] = self.product[rank[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            np.subtract.at(result, seq[hit], 1)
            keep &= each < self.none  # finished sequences leave
            ids, seq = ids[keep], seq[keep]
        return result


def _counter(vocabulary: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import pre_tokenizers

        merger = Merger(vocabulary)
        pattern = regex.compile(PATTERN)
        split = pattern.findall
        own = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        special = regex.compile("|".join(map(regex.escape, merger.specials))) if merger.specials else None
        known: dict[str, int] = {}

        def pieces(text: str) -> Iterator[list[str]]:
            """The pre-tokens of a text, in bounded lists."""
            if UNSTABLE.search(text):
                cut = [text[a:b] for _, (a, b) in own.pre_tokenize_str(text)]
                yield from (cut[k : k + STEP] for k in range(0, len(cut), STEP))
            elif len(text) <= STEP:
                yield split(text)
            else:
                found = (m.group() for m in pattern.finditer(text))
                while cut := list(islice(found, STEP)):
                    yield cut

        def tokens(cuts: list[list[str]]) -> list[int]:
            """Tokens of each list of pre-tokens; new ones of all lists are merged together."""
            new = list(set().union(*cuts).difference(known))
            if len(known) + len(new) > CACHE:
                known.clear()
                new = list(set().union(*cuts))
            if new:
                known.update(zip(new, merger.count([p.encode("utf-8", "replace") for p in new]).tolist()))
            out = [sum(map(known.__getitem__, cut)) for cut in cuts]
            for p in new:
                if len(p) > KEPT:
                    del known[p]
            return out

        for batch in parts(batches, 1000):
            sizes, totals = [], [0] * batch.num_rows
            held: list[tuple[int, list[str]]] = []
            load = 0

            def settle() -> None:
                nonlocal held, load
                for (k, _), n in zip(held, tokens([cut for _, cut in held])):
                    totals[k] += n
                held, load = [], 0

            for k, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                sizes.append(len(text.encode("utf-8", "replace")))
                cut_at = [text]
                if special and special.search(text):
                    cut_at = special.split(text)
                    totals[k] += len(cut_at) - 1
                for part in cut_at:
                    for cut in pieces(part):
                        held.append((k, cut))
                        load += len(cut)
                        if load > STEP:
                            settle()
            settle()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def count_tokens(docs: DataFrame, vocabulary_path: str, *, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text.

    The vocabulary file is read on the driver and sent along: its size does not depend on the corpus.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = f.read()
    check(json.loads(vocabulary))
    return docs.select("doc_id", "text").mapInArrow(lean(_counter(vocabulary, limit)), SCHEMA)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
