"""Removal of repeated line runs by a suffix array over line numbers.

Every document is a sequence of lines, and all lines have numbers in the order of documents.  The
suffix that begins at a line gets a rank by its first lines: distributed prefix doubling makes the
rank of 2h lines from the pair (rank of h lines here, rank of h lines behind them), sorted across
partitions.  Suffixes of one rank at a length are an interval of the suffix array whose longest
common prefix has at least that length.  A suffix alone in its interval is ranked apart and leaves;
doubling ends when no pair repeats.  Lengths double from 1, with one overlapping step to reach
``min_lines`` exactly, and on from there.

In each interval of a longest common prefix of ``min_lines`` or more the suffix with the smallest
number (smallest doc_id, then line) is the first copy.  All others are later copies; each gives one
run: the greatest length at which it still shares its interval with a smaller number.  The union of
the runs of a document are the maximal repeated runs, and their lines are deleted.  With
``min_words``, a single line of that many words is a run too.

Only DataFrame functions are used.  Lines travel as two independent hashes.  Counts and first copies
are partial sums before they are shuffled and written tables before they are joined, so no side of a
join is an aggregate and hot keys can be split.

Defined results for odd input: a null text has no lines and stays null; the empty text has one empty
line; a null ``doc_id`` comes after all others; rows with the same doc_id are documents of their own,
in the order of their text hashes, but rows with the same doc_id and text are one document and share
its verdict; other columns are passed on; clashing names are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import BROADCAST_IDS, TEXT_KEY, WORD_SPLIT, Stages, let, text_key

NEW = ["n_lines", "n_removed", "runs"]


#: Words that make a single line a run of its own in the query that removes such lines.
LONG_LINE = 10


def _numbered(docs: DataFrame, stages: Stages, min_words: int | None) -> DataFrame:
    """A row a line: doc_id and text hashes of its document, pos, id (consecutive in a document), a, b (hashes), long (has it min_words words?)."""
    lines = "split(text, '\\n', -1)"
    words = rf"size(filter(split(l, '{WORD_SPLIT}', -1), w -> w <> ''))".replace("\\", "\\\\")
    long = "cast(null AS array<boolean>)" if min_words is None else f"transform(ls, l -> {words} >= {min_words})"
    texts = text_key(docs.where("text is not null").select("doc_id", "text"))
    both = let("ls", lines, f"named_struct('a', transform(ls, l -> xxhash64(l)), 'b', transform(ls, l -> xxhash64(1, l)), 'long', {long})")  # one split a text
    hashed = texts.selectExpr("doc_id", *TEXT_KEY, f"{both} AS h").select("doc_id", *TEXT_KEY, "h.a", "h.b", "h.long")
    ordered = hashed.dropDuplicates(["doc_id", *TEXT_KEY]).orderBy(F.col("doc_id").asc_nulls_last(), *TEXT_KEY)
    rows = ordered.select("doc_id", *TEXT_KEY, "b", "long", F.posexplode("a").alias("pos", "a"))
    return stages.write("lines", rows.select("doc_id", *TEXT_KEY, "pos", F.monotonically_increasing_id().alias("id"), "a", F.get("b", F.col("pos")).alias("b"), F.get("long", F.col("pos")).alias("long")))


def _ranks(stages: Stages, name: str, rows: DataFrame) -> DataFrame:
    """a, b, rank (its place in their order), first (the smallest id) of the pairs that occur more than once."""
    repeated = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1")
    return stages.write(name, repeated.orderBy("a", "b").select("a", "b", F.monotonically_increasing_id().alias("rank"), "first"))


def _pairs(ranked: DataFrame, step: int) -> DataFrame:
    """The suffixes with their rank as a and the rank of the suffix step lines later, if that is left, as b."""
    after = Window.partitionBy("doc").orderBy("id").rangeBetween(step, step)
    return ranked.select("doc", "id", "first", F.col("rank").alias("a"), F.max("rank").over(after).alias("b"))


def _spans(docs: DataFrame, stages: Stages, min_lines: int, min_words: int | None) -> tuple[DataFrame, DataFrame]:
    """(lines, spans: doc, id, size): a run for each suffix that is a later copy."""
    lines = _numbered(docs, stages, min_words)
    rows = lines.select((F.col("id") - F.col("pos")).alias("doc"), "id", "a", "b", "long")
    ranked = stages.write("level-1", rows.join(_ranks(stages, "ranks-1", rows), ["a", "b"]).select("doc", "id", "rank", "first", "long"))
    spans = []
    if min_words is not None:
        spans.append(stages.write("long", ranked.where("long AND id > first").selectExpr("doc", "id", "1 AS size")))
    length, done = 1, ["ranks-1"]
    while length < min_lines:
        step = min(length, min_lines - length)
        pairs = stages.write(f"pairs-{length}", _pairs(ranked, step).where("b is not null"))
        done += [f"level-{length}", f"pairs-{length}", f"ranks-{length + step}"]
        ranks = _ranks(stages, f"ranks-{length + step}", pairs)
        length += step
        ranked = stages.write(f"level-{length}", pairs.drop("first").join(ranks, ["a", "b"]).select("doc", "id", "rank", "first"))
    while True:
        pairs = stages.write(f"pairs-{length}", _pairs(ranked, length))
        both = pairs.where("b is not null")
        ranks = _ranks(stages, f"ranks-{2 * length}", both)
        done += [f"level-{length}", f"pairs-{length}", f"ranks-{2 * length}"]
        last = ranks.isEmpty()
        if last:
            spans.append(stages.write(f"spans-{length}", pairs.where("id > first").selectExpr("doc", "id", f"{length} AS size")))
            break
        longer = stages.write(f"longer-{length}", both.join(ranks.withColumnRenamed("first", "first2"), ["a", "b"], "left").select("doc", "id", "first", "rank", "first2"))
        done.append(f"longer-{length}")
        # A suffix that is a later copy here but not at the next length has its run here.
        ended = pairs.where("b is null").select("doc", "id", "first").union(longer.where("rank is null OR id = first2").select("doc", "id", "first"))
        spans.append(stages.write(f"spans-{length}", ended.where("id > first").selectExpr("doc", "id", f"{length} AS size")))
        ranked = stages.write(f"level-{2 * length}", longer.where("rank is not null").selectExpr("doc", "id", "rank", "first2 AS first"))
        stages.drop(*done)
        done, length = [], 2 * length
    stages.drop(*done)
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return lines, out


def removed_lines(docs: DataFrame, *, min_lines: int = 2, min_words: int | None = None) -> DataFrame:
    """doc_id, two hashes of the text, runs: the maximal runs (start, size) of lines to delete, in order."""
    stages = Stages(docs.sparkSession)
    lines, spans = _spans(docs, stages, min_lines, min_words)
    in_doc = Window.partitionBy("doc").orderBy("id", "size")
    end = F.max(F.col("id") + F.col("size"))
    fresh = spans.withColumn("new", (F.col("id") > F.coalesce(end.over(in_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    run = fresh.withColumn("run", F.sum("new").over(in_doc)).groupBy("doc", "run").agg(F.min("id").alias("at"), (end - F.min("id")).cast("int").alias("size"))
    start = (F.col("at") - F.col("doc")).cast("int").alias("start")
    runs = stages.write("runs", run.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct(start, "size"))).alias("runs")))
    named = runs.join(lines.where("pos = 0").select("doc_id", *TEXT_KEY, F.col("id").alias("doc")), "doc")
    out = stages.write("removed", named.select("doc_id", *TEXT_KEY, "runs"))
    stages.drop(*(name for name in list(stages.paths) if name != "removed"))
    return out


def drop_repeated_lines(docs: DataFrame, *, min_lines: int = 2, min_words: int | None = None) -> DataFrame:
    """docs with the later copies of repeated line runs deleted from text, and n_lines, n_removed, runs."""
    docs = docs.drop(*NEW)
    cut = removed_lines(docs, min_lines=min_lines, min_words=min_words).withColumnsRenamed({"doc_id": "__doc", **{c: f"{c}2" for c in TEXT_KEY}})
    few = (cut.agg(F.sum(F.size("runs") + F.lit(2))).first()[0] or 0) <= BROADCAST_IDS  # spares the shuffle of all texts
    keyed = text_key(docs)
    same = F.col("doc_id").eqNullSafe(F.col("__doc"))
    for c in TEXT_KEY:
        same = same & (F.col(c) == F.col(f"{c}2"))
    joined = keyed.join(F.broadcast(cut) if few else cut, same, "left")
    lines = "split(text, '\\n', -1)"
    # What stays lies between the end of one run and the start of the next.
    kept = (
        f"flatten(zip_with(concat(array(0), transform(runs, r -> r.start + r.size)), concat(transform(runs, r -> r.start), array(size({lines}))), "
        f"(s, e) -> slice({lines}, s + 1, e - s)))"
    )
    out = joined.selectExpr(
        *(f"`{c}`" for c in docs.columns if c != "text"),
        f"CASE WHEN runs IS NULL THEN text ELSE array_join({kept}, '\\n') END AS text",
        f"cast(CASE WHEN text IS NULL THEN 0 ELSE size({lines}) END AS bigint) AS n_lines",
        "cast(coalesce(aggregate(runs, 0, (n, r) -> n + r.size), 0) AS bigint) AS n_removed",
        "coalesce(runs, array()) AS runs",
    )
    return out.select(*docs.columns, *NEW)


def oracle() -> str:
    """DuckDB SQL of the op3 query: min_lines 2 and distinct doc_id."""
    return """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
p AS (SELECT *, lead(line) OVER w AS next, lead(pos) OVER w AS np FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, pos) AS k FROM p WHERE np IS NOT NULL),
x AS (SELECT DISTINCT doc_id, pos + o AS pos FROM r, (VALUES (0), (1)) t(o) WHERE k > 1),
s AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM x),
g AS (SELECT doc_id, count(*) AS n_removed, count(DISTINCT island) AS n_runs FROM s GROUP BY doc_id),
k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) AS kept FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.pos = x.pos WHERE x.pos IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs,
  CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def oracle_long(min_words: int = LONG_LINE) -> str:
    """DuckDB SQL of the query that also removes single lines of min_words words: distinct doc_id."""
    words = rf"len(list_filter(regexp_split_to_array(line, '{WORD_SPLIT}'), lambda x: x <> ''))"
    return oracle().replace(
        "x AS (SELECT DISTINCT doc_id, pos + o AS pos FROM r, (VALUES (0), (1)) t(o) WHERE k > 1),",
        f"o AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS k FROM l WHERE {words} >= {min_words}),\n"
        "x AS (SELECT doc_id, pos + o AS pos FROM r, (VALUES (0), (1)) t(o) WHERE k > 1 UNION SELECT doc_id, pos FROM o WHERE k > 1),",
    )
