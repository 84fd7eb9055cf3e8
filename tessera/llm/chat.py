"""Reply trees as conversations: paths from root to leaf by iterated self-joins, ranked by score, one formatted text a path.

A formatted path is <s>, its turns, and </s>. A turn is [ROLE], its role, [INST] , its text and [/INST]; assistant turns have <s> before
and </s> after them in place of nothing, so that the loss mask is what stands between [INST]  and [/INST] of a turn of role assistant.
Inside roles and texts each control string is escaped by doubling a mark that no control string has outside them: & is written &amp;, < is &lt; and [ is &#91; .
No control string can then come from a text, and what is read back is the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import row_count, table, written

ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
BEGIN, END, ROLE, OPEN, CLOSE = "<s>", "</s>", "[ROLE]", "[INST]", "[/INST]"


def escaped(text: Column) -> Column:
    for plain, mark in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescaped(text: Column) -> Column:
    for plain, mark in reversed(ESCAPES):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def tree_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left and right joined by tree and key; a null tree is one tree, a null key meets none."""
    right = right.withColumnsRenamed({"tree": "_tree", key: "_key"})
    return left.join(right, left["tree"].eqNullSafe(right["_tree"]) & (left[key] == right["_key"]), how).drop("_tree", "_key")


def nodes_of(messages: DataFrame) -> DataFrame:
    """messages with one row each (tree, id), as a written table: of rows that repeat them, the least (parent, role, text, score). Null role, text and score are empty, empty and 0."""
    whole = messages.select("tree", "id", F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score")).alias("row"))
    return written(whole.groupBy("tree", "id").agg(F.min("row").alias("row")).select("tree", "id", "row.*"), "tree-nodes")


def paths(nodes: DataFrame) -> DataFrame:
    """nodes(tree, id, parent), one row each (tree, id) -> (tree, leaf, id, depth): every path from a root to a leaf, a row for each of its nodes.

    Self-joins double the distance that they cross: up(k) links a node with its ancestor 2^k above. So a chain of n turns takes log2(n) joins.
    A parent that is null or absent makes a root; nodes on a cycle, or that hang on one, have no root and are in no path.
    Rows without a tree are one tree, whose tree is null; rows without an id are in no path.
    """
    nodes = nodes.select("tree", "id", "parent").where("id IS NOT NULL")
    known = nodes.select("tree", F.col("id").alias("parent"))
    up = written(tree_join(nodes, known, "parent", "left_semi").select("tree", "id", F.col("parent").alias("above")), "tree-up")
    parents = up.select("tree", F.col("above").alias("id")).distinct()
    leaves = tree_join(nodes.select("tree", "id"), parents, "id", "left_anti")
    roots = tree_join(nodes.select("tree", "id"), up.select("tree", "id"), "id", "left_anti").select("tree", "id")
    found = leaves.select("tree", F.col("id").alias("leaf"), "id", F.lit(0).alias("dist"))
    # no path is longer than its tree has links; what goes on after that is a cycle
    size, most = 1, up.groupBy("tree").count().agg(F.max("count")).first()[0] if row_count(up) else 0
    while row_count(up) and size <= 2 * most:
        # all nodes that are up to 2 * size - 1 above a leaf
        more = tree_join(found, up, "id").select("tree", "leaf", F.col("above").alias("id"), (F.col("dist") + size).alias("dist"))
        found = written(found.union(more), "tree-paths")
        half = up.select("tree", F.col("id").alias("above"), F.col("above").alias("top"))
        up = written(tree_join(up, half, "above").select("tree", "id", F.col("top").alias("above")), "tree-up")
        size *= 2
    high = tree_join(found, roots, "id", "left_semi").groupBy("tree", "leaf").agg(F.max("dist").alias("high"))
    return tree_join(found, high, "leaf").select("tree", "leaf", "id", (F.col("high") - F.col("dist")).alias("depth"))


def formatted(messages: DataFrame, best: int | None = None) -> DataFrame:
    """messages(tree, id, parent, role, text, score) -> (tree, leaf, rank, path_score, n_turns, formatted, loss), a row for each path from root to leaf.

    Paths of a tree are ranked by the sum of their scores, then by leaf; best keeps the first ranks only. Ranks are given on numbers: texts are joined to
    the paths that stay. loss has start and end, in code points of formatted, of each assistant text. Null text, role and score are
    empty, empty and 0; of rows that repeat (tree, id) one counts; a null tree is one tree; other columns are not read. No messages give no rows. The turns of one
    path are one text, so they meet in one task.
    """
    nodes = nodes_of(messages)
    steps = written(paths(nodes), "tree-steps")
    scores = tree_join(steps.select("tree", "leaf", "id"), nodes.select("tree", "id", "score"), "id").groupBy("tree", "leaf").agg(F.sum("score").alias("path_score"), F.count(F.lit(1)).alias("n_turns"))
    ranked = scores.selectExpr("*", "row_number() OVER (PARTITION BY tree ORDER BY path_score DESC, leaf) AS rank")
    chosen = written(ranked if best is None else ranked.where(F.col("rank") <= best), "tree-ranks")
    lone = lambda x: F.when(F.col("role") == "assistant", F.lit(x)).otherwise(F.lit(""))
    lead = F.concat(lone(BEGIN), F.lit(ROLE), escaped(F.col("role")), F.lit(OPEN))
    turns = tree_join(tree_join(steps, chosen.select("tree", "leaf"), "leaf", "left_semi"), nodes, "id")
    turns = turns.select("tree", "leaf", "depth", "role", lead.alias("lead"), escaped(F.col("text")).alias("body"), F.concat(F.lit(CLOSE), lone(END)).alias("trail"))
    before = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("lead") + F.length("body") + F.length("trail")
    start = F.coalesce(F.sum(size).over(before), F.lit(0)) + len(BEGIN) + F.length("lead")
    loss = F.when(F.col("role") == "assistant", F.struct(start.cast("bigint").alias("start"), (start + F.length("body")).cast("bigint").alias("end")))
    turns = turns.select("tree", "leaf", F.struct("depth", F.concat("lead", "body", "trail").alias("turn"), loss.alias("loss")).alias("t"))
    one = turns.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    text = F.concat(F.lit(BEGIN), F.array_join(F.col("turns.turn"), ""), F.lit(END))
    one = one.select("tree", "leaf", text.alias("formatted"), F.array_compact("turns.loss").alias("loss"))
    return tree_join(one, chosen, "leaf").select("tree", "leaf", "rank", "path_score", "n_turns", "formatted", "loss")


def read_back(text: Column) -> Column:
    """The turns of a formatted path: array of (role, text)."""
    parts = F.slice(F.split(text, r"\[ROLE\]"), F.lit(2), F.size(F.split(text, r"\[ROLE\]")) - 1)
    role = lambda t: unescaped(F.substring_index(t, OPEN, 1))
    body = lambda t: unescaped(F.substring_index(F.substring_index(t, OPEN, -1), CLOSE, 1))
    return F.when(F.size(F.split(text, r"\[ROLE\]")) > 1, F.transform(parts, lambda t: F.struct(role(t).alias("role"), body(t).alias("text")))).otherwise(F.expr("CAST(array() AS array<struct<role:string,text:string>>)"))


def digests(chats: DataFrame, id_col: str) -> DataFrame:
    """What the output says: turns from the formatted text alone, loss text from what the mask covers of it."""
    r = chats.select(id_col, "formatted", "loss", read_back(F.col("formatted")).alias("turns"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.transform("loss", lambda x: unescaped(F.substring("formatted", (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))))
    r = r.select(id_col, "formatted", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.array_join(masked, "").alias("said"))
    return r.select(id_col, "n_turns", "turns_sha256", F.length("said").cast("long").alias("loss_chars"), F.sha2(F.col("said"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op5_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """conversations as chains of replies, and conversation -1; rows without a conv_id are one conversation, rows that repeat a turn are turns of their own."""
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    # a turn replies to the turn before it
    nth = talk.unionByName(odd).selectExpr("conv_id AS tree", "role", "text", "row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS id")
    messages = nth.select("tree", F.col("id").cast("long").alias("id"), F.when(F.col("id") > 1, F.col("id") - 1).cast("long").alias("parent"), "role", "text", F.lit(0.0).alias("score"))
    return digests(formatted(messages, best=1).withColumnRenamed("tree", "conv_id"), "conv_id")


ORACLE = """
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS t FROM c),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(length('[ROLE]' || role || '[INST]' || t || '[/INST]') + CASE WHEN role = 'assistant' THEN 7 ELSE 0 END) + 7 AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
