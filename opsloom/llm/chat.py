"""Chat formatting: reply trees to conversations with a loss mask.

A message names the message that it answers.  Iterative self-joins that double their step give each
message its root, its depth and the score of its path; leaves are ranked within their tree by that
score; the paths of the chosen leaves are enumerated by the same steps, largest first, so a path of d
messages takes about log2(d) joins.  Each chosen path becomes one conversation.

The template marks turns as ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line feed.  Control
strings inside roles and texts (:data:`CONTROL`) are escaped: every backslash is doubled and a
backslash breaks each control string behind its first character, so taking one backslash away before each
character that follows one gives the text back (:func:`unescape`).  ``loss`` holds the
places of what the assistant says, in code points of the conversation, without markers.

Only DataFrame functions run.  A conversation is one row, so it must fit into one; nothing else is
gathered by conversation.

Defined results for odd input: null texts and roles are empty; a null tree is a tree of its own; a
message whose parent is null or unknown within its tree begins a path; a message without id can't be
answered; of several messages with one id in a tree the least (by parent, role, text) stays; messages
that lead into a circle of replies belong to no path from a root and are left out; null scores count 0;
ties of branches go to the longer path, then to the leaf of smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Stages

#: The marks of the template, and the control strings of usual chat templates.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = r"(<)(/?s>|\|[A-Za-z0-9_]+\|>|</?SYS>>)|(\[)(/?INST\])"
SPOKEN = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def thread(turns: DataFrame, *, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of linear conversations as messages (tree, id, parent, role, text), each an answer to the one before.

    Equal turns follow by role and text, a null turn comes first; repeated rows are turns of their own.
    """
    own = Window.partitionBy("tree").orderBy("__turn", "role", "text")
    rows = turns.select(F.col(tree).alias("tree"), F.col(turn).alias("__turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    numbered = rows.withColumn("id", F.row_number().over(own).cast("bigint"))
    return numbered.select("tree", "id", F.nullif(F.col("id") - 1, F.lit(0)).alias("parent"), "role", "text")


def _links(stages: Stages, messages: DataFrame) -> DataFrame:
    """n, up (the number of the message that is answered, null at a root), score and len of that step."""
    child = messages.select("n", "tree", F.col("parent").alias("__p"), "score")
    parent = messages.where("id is not null").select(F.col("tree").alias("__tree"), F.col("id").alias("__id"), F.col("n").alias("up"))
    joined = child.join(parent, child["tree"].eqNullSafe(parent["__tree"]) & (child["__p"] == parent["__id"]), "left")
    return stages.write("links-0", joined.select("n", "up", "score", F.lit(1).cast("bigint").alias("len")))


def _doubled(stages: Stages, links: DataFrame) -> list[DataFrame]:
    """links and their compositions with themselves: the k-th steps up 2^k messages, until no step leads on.

    Only messages that have not come to their root yet are in the next table, so the tables shrink as
    fast as there are few deep trees; :func:`_ended` has those that have.
    """
    tables, most = [links], links.count()
    while tables[-1].where("up is not null").limit(1).count() and 1 << (len(tables) - 1) <= most:
        going = tables[-1].where("up is not null")
        on = going.unionByName(_ended(tables)).select(F.col("n").alias("__n"), F.col("up").alias("__up"), F.col("score").alias("__score"), F.col("len").alias("__len"))
        step = going.join(on, going["up"] == on["__n"]).select("n", F.col("__up").alias("up"), (F.col("score") + F.col("__score")).alias("score"), (F.col("len") + F.col("__len")).alias("len"))
        tables.append(stages.write(f"links-{len(tables)}", step))
    return tables


def _ended(tables: list[DataFrame]) -> DataFrame:
    """The messages that have come to their root, with the score and the length of the path to it."""
    out = tables[0].where("up is null")
    for t in tables[1:]:
        out = out.unionByName(t.where("up is null"))
    return out


def branches(stages: Stages, messages: DataFrame, tables: list[DataFrame], keep: int | None) -> DataFrame:
    """leaf, tree, leaf_id, branch (rank by score within the tree, from 1), score, n_turns of the chosen leaves."""
    answered = tables[0].where("up is not null").select(F.col("up").alias("n")).distinct()
    ended = _ended(tables).join(answered, "n", "left_anti")
    leaves = ended.join(messages.select("n", "tree", "id"), "n").select(F.col("n").alias("leaf"), "tree", F.col("id").alias("leaf_id"), "score", F.col("len").alias("n_turns"))
    leaves = stages.write("leaves", leaves)
    order = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("n_turns"), F.asc_nulls_last("leaf_id"), "leaf")
    ranked = leaves.withColumn("branch", F.row_number().over(order))
    return stages.write("branches", ranked if keep is None else ranked.where(F.col("branch") <= keep))


def _paths(stages: Stages, chosen: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """leaf, n, back: the messages of each chosen path and how far they lie before its leaf."""
    path = chosen.select("leaf", F.col("leaf").alias("n"), F.lit(0).cast("bigint").alias("back"))
    for k in range(len(tables) - 1, -1, -1):
        steps = tables[k].where("up is not null").select(F.col("n").alias("__n"), "up")
        further = path.join(steps, path["n"] == steps["__n"]).select("leaf", F.col("up").alias("n"), (F.col("back") + F.lit(1 << k)).alias("back"))
        longer = stages.write(f"path-{k}", path.unionByName(further))
        if k < len(tables) - 1:
            stages.drop(f"path-{k + 1}")
        path = longer
    return path


def format_trees(messages: DataFrame, *, score: str | None = None, keep: int | None = 1, unique: bool = False) -> DataFrame:
    """One row for each chosen branch: tree, leaf_id, branch, score, n_turns, text, loss (array of start and chars).

    messages: tree, id, parent, role, text; score: a numeric column, summed along a path (none: the
    longest path is best); keep: branches of a tree, all if None; unique: whether (tree, id) names a row already.
    """
    stages = Stages(messages.sparkSession)
    with stages.cleared_on_error():
        value = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
        rows = messages.select("tree", "id", "parent", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), value.alias("score"))
        if not unique:
            named = rows.where("id is not null").groupBy("tree", "id").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m"))
            rows = named.select("tree", "id", "m.*").unionByName(rows.where("id is null"))
        written = stages.write("messages", rows.withColumn("n", F.monotonically_increasing_id()))
        tables = _doubled(stages, _links(stages, written))
        chosen = branches(stages, written, tables, keep)
        path = _paths(stages, chosen, tables)
        stages.drop("leaves", *(f"links-{k}" for k in range(len(tables))))
        turn = written.select("n", F.col("role") == SPOKEN, F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)), escape(F.col("text"))).toDF("n", "spoken", "head", "body")
        piece = path.join(turn, "n").select("leaf", "back", "spoken", "head", "body", (F.length("head") + F.length("body") + F.lit(len(END) + 1)).cast("bigint").alias("size"))
        own = Window.partitionBy("leaf").orderBy(F.desc("back"))
        placed = piece.withColumn("start", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") + F.length("head"))
        made = placed.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), F.concat("head", "body", F.lit(END + "\n")).alias("piece"), "spoken", "start", F.length("body").cast("bigint").alias("chars")))).alias("turns"))
        spans = F.transform(F.filter("turns", lambda t: t["spoken"]), lambda t: F.struct(t["start"].alias("start"), t["chars"].alias("chars")))
        texts = made.select("leaf", F.array_join(F.col("turns.piece"), "").alias("text"), spans.alias("loss"))
        return chosen.join(texts, "leaf").select("tree", "leaf_id", "branch", "score", "n_turns", "text", "loss")


def read_turns(text: Column) -> Column:
    """The turns (role, text) of a conversation, read back from its form."""
    pieces = F.split(text, r"<\|im_start\|>")
    parts = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: F.split(p, r"<\|im_(?:sep|end)\|>"))
    return F.transform(parts, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))


def read_loss(text: Column, loss: Column) -> Column:
    """What stands under the mask, unescaped and put together."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(text, s["start"].cast("int") + 1, s["chars"].cast("int")))), "")


def oracle() -> str:
    """DuckDB SQL of the query: the same figures from the turns themselves."""
    marks = len(START) + len(SEP) + len(END) + 1

    def escaped(c: str) -> str:
        return rf"regexp_replace(replace({c}, '\', '\\'), '{CONTROL}', '\1\3\\\2\4', 'g')"

    def gathered(c: str, where: str = "") -> str:
        return f"coalesce(string_agg({c}, '' ORDER BY turn NULLS FIRST, role0 NULLS FIRST, text0 NULLS FIRST){where}, '')"

    said = gathered("text", f" FILTER (WHERE role = '{SPOKEN}')")
    return f"""
WITH c AS (SELECT conv_id, turn, role AS role0, text AS text0 FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, '{SPOKEN}', '</s>[INST] ok [/INST]'),
t AS (SELECT *, coalesce(role0, '') AS role, coalesce(text0, '') AS text FROM c)
SELECT conv_id, count(*) AS n_turns, sha256({gathered("role || chr(10) || text || chr(10)")}) AS turns_sha256,
  length({said})::BIGINT AS loss_chars, sha256({said}) AS loss_sha256,
  sum(length({escaped('role')}) + length({escaped('text')}) + {marks})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
