"""Chat formatting of reply trees with DataFrame functions only.

A message names its parent.  Root-to-leaf paths come from iterative self-joins by pointer doubling: after k
rounds each message knows its ancestor 2^k replies up, and each leaf has collected 2^k messages of its path, so a
tree of depth d takes log2(d) joins of narrow id rows.  Paths are ranked within their tree by their messages'
summed score, which a leaf gathers on its way up as one row, before any path is enumerated.  Texts are joined once,
to the paths that are kept; each path becomes one conversation.

The template is <|im_start|>ROLE\\nTEXT<|im_end|>\\n per turn.  Roles are URL-encoded.  In texts a backslash is
doubled, and a backslash and an e go behind the first character of every control string, so texts hold none and
reading back is exact.  The loss mask is the (start, length) of each text of the roles to be learned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

START, END = "<|im_start|>", "<|im_end|>"
#: The control strings: of this template, of others in <|...|>, and of the [INST] family.
CONTROL = r"(<|\[)(\|[^|<>\s]*\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1\\e$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|e)", "$1")


def reply_links(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(tables, leaves) of nodes (node, parent, maybe score): table k has (node, above, weight), above being 2^k replies
    up and weight the summed score of node and those between; leaves (leaf) have no replies.

    A parent that is not in the table is none: its replies are roots.  Messages on a cycle of replies, or below
    one, have no root and are left out of the leaves.
    """
    n = nodes.count()
    weight = F.coalesce("score", F.lit(0.0)) if "score" in nodes.columns else F.lit(0.0)
    known = nodes.select(F.col("node").alias("parent"))
    up = common.settled(nodes.join(known, "parent", "left_semi").select("node", F.col("parent").alias("above"), weight.alias("weight")))
    ups, step = [], 1
    while step <= n and not up.isEmpty():
        ups.append(up)
        again = up.select(F.col("node").alias("above"), F.col("above").alias("further"), F.col("weight").alias("more"))
        up = common.settled(up.join(again, "above").select("node", F.col("further").alias("above"), (F.col("weight") + F.col("more")).alias("weight")))
        step *= 2
    rooted = nodes.join(up.select("node"), "node", "left_anti")
    return ups, rooted.join(nodes.select(F.col("parent").alias("node")), "node", "left_anti").select(F.col("node").alias("leaf"))


def path_scores(leaves: DataFrame, ups: list[DataFrame], nodes: DataFrame) -> DataFrame:
    """(leaf, path_score): a leaf climbs to its root in as many steps as there are tables, one row a leaf throughout."""
    at = leaves.select("leaf", F.col("leaf").alias("node"), F.lit(0.0).alias("path_score"))
    for table in reversed(ups):
        total = F.col("path_score") + F.coalesce("weight", F.lit(0.0))
        at = at.join(table, "node", "left").select("leaf", F.coalesce("above", "node").alias("node"), total.alias("path_score"))
    return at.join(nodes.select("node", "score"), "node").select("leaf", (F.col("path_score") + F.coalesce("score", F.lit(0.0))).alias("path_score"))


def reply_paths(leaves: DataFrame, ups: list[DataFrame]) -> DataFrame:
    """(leaf, node, back): for each leaf its path; back counts replies from the leaf up."""
    reached = leaves.select("leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("back"))
    for k, table in enumerate(ups):
        higher = reached.join(table, "node").select("leaf", F.col("above").alias("node"), (F.col("back") + 2**k).alias("back"))
        reached = common.settled(reached.unionByName(higher))
    return reached


def conversations(messages: DataFrame, paths_per_tree: int | None = None, learn=("assistant",)) -> DataFrame:
    """One row per chosen path of messages (tree, node, parent, score, role, text): tree, leaf, rank, n_turns,
    formatted, loss (array of start, length in characters of formatted).

    Null roles and texts count as empty, null scores as 0; ties in a path's score go to the smaller leaf.  Of
    rows that repeat a node the least counts.  Messages without a node are left out; no messages, no rows.
    """
    picked = F.min(F.struct("tree", "parent", "score", "role", "text")).alias("m")
    messages = common.settled(messages.where(F.col("node").isNotNull()).groupBy("node").agg(picked).select("node", "m.*"))
    ups, leaves = reply_links(messages.select("node", "parent", "score"))
    if paths_per_tree is None:
        paths = reply_paths(leaves, ups).withColumn("rank", F.lit(None).cast("int"))
    else:  # ranked before any path is enumerated: a path that is not chosen costs its leaf's row alone
        scored = path_scores(leaves, ups, messages).join(messages.select(F.col("node").alias("leaf"), "tree"), "leaf")
        best = Window.partitionBy("tree").orderBy(F.col("path_score").desc(), "leaf")
        chosen = common.settled(scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= paths_per_tree).select("leaf", "rank"))
        paths = reply_paths(chosen, ups).join(chosen, "leaf")
    head = F.concat(F.lit(START), F.url_encode(F.coalesce("role", F.lit(""))), F.lit("\n"))
    turns = paths.join(messages, "node").withColumn("head", head).withColumn("body", escape(F.coalesce("text", F.lit(""))))
    turns = turns.withColumn("chars", F.length("head") + F.length("body") + len(END) + 1)
    so_far = Window.partitionBy("leaf").orderBy(F.col("back").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("start", F.sum("chars").over(so_far) - F.col("chars") + F.length("head"))
    span = F.when(F.col("role").isin(*learn), F.struct(F.col("start"), F.length("body").cast("long").alias("length")))
    turns = turns.select("leaf", "tree", "rank", (-F.col("back")).alias("at"), F.concat("head", "body", F.lit(END + "\n")).alias("turn"), span.alias("span"))
    whole = turns.groupBy("leaf").agg(F.first("tree").alias("tree"), F.first("rank").alias("rank"), F.array_sort(F.collect_list(F.struct("at", "turn", "span"))).alias("turns"))
    return whole.select("tree", "leaf", "rank", F.size("turns").cast("long").alias("n_turns"), F.array_join("turns.turn", "").alias("formatted"), F.filter("turns.span", lambda s: s.isNotNull()).alias("loss"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    turns = F.split(formatted, r"<\|im_end\|>\n")
    turns = F.slice(turns, 1, F.greatest(F.size(turns) - 1, F.lit(0)))
    return F.transform(turns, lambda t: F.struct(F.url_decode(F.substring_index(F.substring(t, len(START) + 1, 2**31 - 1), "\n", 1)).alias("role"), unescape(F.regexp_replace(t, r"^[^\n]*\n", "")).alias("text")))


def masked(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def threads(rows: DataFrame) -> DataFrame:
    """Messages of flat conversations (conv_id, turn, role, text): each row replies to the row before it."""
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    name = lambda i: F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("none")), F.lit(":"), i.cast("string"))
    rows = rows.select("conv_id", "role", "text", number.alias("number"))
    return rows.select(F.col("conv_id").alias("tree"), name(F.col("number")).alias("node"), F.when(F.col("number") > 1, name(F.col("number") - 1)).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    trick = "</s>[INST] ok [/INST]"
    added = [spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(trick).alias("text")) for i, role in enumerate(("user", "assistant"))]
    made = conversations(threads(reduce(DataFrame.unionByName, added, rows)), paths_per_tree=1)  # a thread is a tree of one path
    back = made.withColumn("turns", read_back(F.col("formatted"))).withColumn("learned", masked(F.col("formatted"), F.col("loss")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql() -> str:
    trick = "</s>[INST] ok [/INST]"
    return rf"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{trick}' UNION ALL SELECT -7, 1, 'assistant', '{trick}'),
escaped AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '(<|\[)(\|[^|<>\s]*\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\e\2', 'g') AS body FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(START) + len(END) + 2} + length(role) + length(body))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""


ORACLE = _sql()
