"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters and digits, lower-cased.  Fixed masks ignore some token positions; the
kept ones are hashed at every place of every document and benchmark item, and equal hashes are hits.
Around each hit, document and item are compared token by token on its diagonal; a document is
contaminated where a window of ``window`` tokens of an item agrees but for ``substitutions``.

No such window is lost (recall 1.0, tested against all windows of all pairs):

* Two masks over eight tokens meet any two substitutions within 13 tokens; other windows and
  numbers of substitutions take the blocks below over the whole window.
* An item of 8 tokens up to the window must agree over its whole length with the same number of
  substitutions.  Its first eight tokens are cut into ``substitutions + 2`` blocks, and each pair of
  blocks is a mask: some pair has no substitution.
* An item below eight tokens must occur whole and unchanged, so its mask keeps all its tokens.

Masks for items below the window are used only if the benchmark has such items.

Only DataFrame functions are used.  The hashes of the benchmark are counted first: up to
``broadcast_hashes`` they are sent to all tasks, beyond it the join is by shuffle.  Documents are
named by two hashes of their text, so copies are judged together and need no ``doc_id``.

Defined results for odd input: a null text, or one without a token, is clean; a null ``doc_id`` row
is judged by its text like any other; a null item, or one without a token, matches nothing; an item
with a null ``item_id`` makes documents contaminated but stands in no list; repeated rows are each
answered; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from .common import BROADCAST_IDS, TEXT_KEY, Stages, by_ids, let, text_key

#: With these two masks any two substitutions in 13 tokens leave a hit.
MASKS = ("11001111", "11101011")
#: Items below this many tokens must occur unchanged.
EXACT = 8


def family(size: int, substitutions: int) -> tuple[str, ...]:
    """Masks over size tokens of which one has none of any so many substitutions: two of substitutions + 2 blocks each."""
    n = substitutions + 2
    if not substitutions or size < n:
        return ("1" * size,)
    cut = [size * k // n for k in range(n + 1)]
    return tuple("".join("1" if any(cut[b] <= p < cut[b + 1] for b in pair) else "0" for p in range(size)).rstrip("0") for pair in combinations(range(n), 2))


def masks(window: int, substitutions: int, short: list[int]) -> list[tuple[str, int, int | None]]:
    """(mask, fewest tokens, most tokens) of the items that each mask serves; short: the item sizes below the window."""
    if window < EXACT or not 0 <= substitutions <= EXACT - 2:
        raise ValueError(f"windows have {EXACT} tokens or more, of which two or more must agree")
    out = [(m, window, None) for m in (MASKS if window >= 13 and substitutions <= 2 else family(window, substitutions))]
    if any(EXACT <= n < window for n in short):
        out += [(m, EXACT, window - 1) for m in family(EXACT, substitutions)]
    return out + [("1" * n, n, n) for n in sorted(short) if 0 < n < EXACT]


def tokens(column: str) -> str:
    return rf"filter(split(lower({column}), '[^\\p{{L}}\\p{{N}}]+', -1), t -> t <> '')"


def seeds(words: str, specs: list[tuple[str, int, int | None]], *, item: bool) -> str:
    """SQL: for an array of token hashes an array for each mask with the hashes at every place.

    An item is hashed by the masks of its size alone, and at its first place alone if it is shorter than a window.
    """
    hashed = []
    for k, (mask, low, high) in enumerate(specs):
        picked = ", ".join(f"{words}[i + {j}]" for j, c in enumerate(mask) if c == "1")
        last = "0" if item and high is not None else f"size({words}) - {len(mask)}"
        fits = f"size({words}) >= {low if item else len(mask)}" + (f" AND size({words}) <= {high}" if item and high is not None else "")
        hashed.append(f"IF({fits}, transform(sequence(0, {last}), i -> xxhash64({k}, {picked})), cast(array() AS array<bigint>))")
    return f"array({', '.join(hashed)})"


def _hashed(df: DataFrame, key: list[str], specs: list, *, item: bool) -> DataFrame:
    """key, place, h: every masked hash."""
    found = let("w", f"transform({tokens('text')}, t -> xxhash64(t))", seeds("w", specs, item=item))
    return df.selectExpr(*key, f"{found} AS s").select(*key, F.explode("s").alias("s")).select(*key, F.posexplode("s").alias("place", "h"))


def overlaps(docs: DataFrame, items: DataFrame, *, window: int = 13, substitutions: int = 2, broadcast_hashes: int = 1_000_000) -> DataFrame:
    """The two hashes that name a text, item_id, diagonal, start and size (tokens of the text) of each verified overlap."""
    stages = Stages(docs.sparkSession)
    texts = text_key(docs.select("text"))
    named = items.where("text is not null").select("item_id", "text").distinct()
    known = stages.write("items", named.select("item_id", "text", F.expr(f"{tokens('text')} AS item"), F.monotonically_increasing_id().alias("nr")))
    short = [r[0] for r in known.select(F.size("item").alias("n")).where(F.col("n") < window).distinct().collect()]  # fewer values than a window has tokens
    specs = masks(window, substitutions, short)
    hashes = stages.write("hashes", _hashed(known, ["nr"], specs, item=True).withColumnRenamed("place", "item_place"))
    side = F.broadcast(hashes) if hashes.count() <= broadcast_hashes else hashes
    found = _hashed(texts, TEXT_KEY, specs, item=False).join(side, "h")
    found = stages.write("hits", found.select(*TEXT_KEY, "nr", (F.col("place") - F.col("item_place")).alias("diagonal")).distinct())

    # The stretches of a text beside the items are cut inside its row; only they travel on.
    with_sizes = stages.write("sizes", found.join(known.select("nr", F.size("item").alias("n_item")), "nr"))
    per_text = stages.write("per-text", with_sizes.groupBy(*TEXT_KEY).agg(F.collect_list(F.struct("nr", "diagonal", "n_item")).alias("found")))
    few = F.broadcast(per_text) if with_sizes.count() <= BROADCAST_IDS // 8 else per_text  # spares the shuffle of all texts
    own = texts.join(few, TEXT_KEY).select(*TEXT_KEY, "found", F.expr(f"{tokens('text')} AS w")).select(*TEXT_KEY, "w", F.explode("found").alias("f"))
    beside = own.selectExpr(*TEXT_KEY, "f.nr", "f.diagonal", "slice(w, greatest(f.diagonal, 0) + 1, greatest(0, f.n_item + least(f.diagonal, 0))) AS beside")
    sides = beside.join(known.select("nr", "item_id", "item"), "nr")
    same = "zip_with(slice(item, greatest(0, -diagonal) + 1, size(beside)), beside, (a, b) -> a = b)"
    agree = f"size(filter(slice(same, i + 1, win), x -> x)) >= win - IF(size(item) < {EXACT}, 0, {substitutions})"
    good = let("same", same, f"IF(size(same) < win, cast(array() AS array<int>), filter(sequence(0, size(same) - win), i -> {agree}))")
    judged = sides.selectExpr(*TEXT_KEY, "nr", "item_id", "diagonal", "item", "beside", f"least({window}, size(item)) AS win").selectExpr(*TEXT_KEY, "nr", "item_id", "diagonal", "win", f"{good} AS good")
    spans = judged.where("size(good) > 0").selectExpr(
        *TEXT_KEY, "nr", "item_id", "diagonal", "cast(greatest(diagonal, 0) + good[0] AS bigint) AS start", "cast(element_at(good, -1) - good[0] + win AS bigint) AS size"
    )
    out = stages.write("overlaps", spans.distinct().drop("nr"))
    stages.drop("items", "hashes", "hits", "sizes", "per-text")
    return out


def judge(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, contaminated, item_ids (sorted), n_overlaps (pairs of item and diagonal)."""
    found = overlaps(docs, items, **options)
    per_text = Stages(docs.sparkSession).write("judged", found.groupBy(*TEXT_KEY).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.count(F.lit(1)).alias("n_overlaps")))
    told = text_key(docs.select("doc_id", "text")).select("doc_id", *TEXT_KEY).join(per_text, TEXT_KEY, "left")
    return told.selectExpr("doc_id", "item_ids IS NOT NULL AS contaminated", "coalesce(item_ids, array()) AS item_ids", "coalesce(n_overlaps, 0) AS n_overlaps")


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs without an overlap with an item."""
    bad = Stages(docs.sparkSession).write("contaminated", overlaps(docs, items, **options).select(*TEXT_KEY).distinct())
    return by_ids(text_key(docs), bad, "left_anti", TEXT_KEY).select(*(f"`{c}`" for c in docs.columns))
