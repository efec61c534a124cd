"""Chat formatting of reply trees.

Messages (tree, node, parent, role, text, score) form trees. Self-joins of the parent links, doubling their reach each
time, give every node its distance from the root and the summed score of its path, in logarithmically many rounds. Leaves
are ranked by that score and the best ones of a tree chosen; the saved links of all rounds then enumerate the nodes of
each chosen root-to-leaf path exactly once. Each path becomes one text, which is one row by its nature.

Template: ``<s>role[SEP]text</s>`` and a line break per turn. In role and text each ``\\``, ``<`` and ``[`` is followed by
a backslash, so no control string can appear there, and reading back drops those backslashes. ``loss`` holds the spans
(code points, from and length) of the assistants' texts.

Defined cases: a null role or text is empty; a null parent, or one that the tree lacks, makes a root; a null tree is a
tree of its own; repeated rows of a conversation are turns of their own, ordered by turn, role and text; nodes on a cycle
of parents have no root and give no path; equal scores rank by node; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import cut_lineage

TURN, SPLIT, END = "<s>", "[SEP]", "</s>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([\\<\[])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def chains(conversations: DataFrame) -> DataFrame:
    """Conversations as trees with one branch: each turn replies to the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").alias("tree"), F.row_number().over(order).cast("long").alias("node"), "role", "text")
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, depth, role, text): the ``best`` highest-scored root-to-leaf paths of each tree, depth from 0."""
    rows = cut_lineage(messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"), "role", "text"))
    known = rows.select(F.col("tree").alias("t"), F.col("node").alias("n")).distinct()
    on = F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n"))
    links = rows.join(known, on, "left").select("tree", "node", F.col("n").alias("up"), F.when(F.col("n").isNull(), 0).otherwise(1).cast("long").alias("steps"), "score")
    start = cut_lineage(links)
    limit, reach = rows.count(), 1
    of_root = lambda df: df.filter("up IS NULL").select("tree", "node", "steps", "score")
    ended, levels = [of_root(start)], [start.filter("up IS NOT NULL")]
    met = ended[0]
    # only nodes that have not met their root go on, and of the others only those of their trees can be met
    while reach <= limit and levels[-1].limit(1).count():
        here = levels[-1]
        alive = here.select(F.col("tree").alias("t")).distinct()
        met = cut_lineage(met.join(alive, F.col("tree").eqNullSafe(F.col("t")), "left_semi"))
        there = here.unionByName(met.withColumn("up", F.lit(None).cast(messages.schema["node"].dataType))).select(
            F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("score").alias("score2")
        )
        joined = here.join(there, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n")))
        further = cut_lineage(joined.select("tree", "node", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("score") + F.col("score2")).alias("score")))
        ended.append(of_root(further))
        met = met.unionByName(ended[-1])
        levels.append(further.filter("up IS NOT NULL"))
        reach *= 2
    parents = levels[0].select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct()
    same = F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))
    leaves = reduce(DataFrame.unionByName, ended).join(parents, same, "left_anti")
    rank = Window.partitionBy("tree").orderBy(F.col("score").desc(), "node")
    chosen = leaves.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= best)
    members = chosen.select("tree", F.col("node").alias("leaf"), "node", F.col("steps").alias("depth"))
    for k in range(len(levels) - 2, -1, -1):  # the last level is empty or holds cycles alone
        up = levels[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        further = members.join(up, same).select("tree", "leaf", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))
        # read twice by the next round: without the cut the plan would double each time
        members = cut_lineage(members.unionByName(further))
    texts = rows.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    return members.join(texts, same).select("tree", "leaf", "depth", "role", "text")


def format_paths(turns: DataFrame) -> DataFrame:
    """(tree, leaf, formatted, loss): one text per path."""
    whole = turns.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    parts = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escape(t["role"]).alias("head"), escape(t["text"]).alias("body")))
    piece = lambda t: F.concat(F.lit(TURN), t["head"], F.lit(SPLIT), t["body"], F.lit(END))
    before = lambda t: F.length(t["head"]) + len(TURN) + len(SPLIT)

    def span(state: Column, t: Column) -> Column:
        at, length = state["at"] + before(t), F.length(t["body"])
        own = F.struct(at.alias("from"), length.alias("length"))
        spans = F.when(t["role"] == "assistant", F.concat(state["spans"], F.array(own))).otherwise(state["spans"])
        return F.struct((at + length + len(END)).alias("at"), spans.alias("spans"))

    start = F.expr("struct(0 AS at, cast(array() AS array<struct<from:int,length:int>>) AS spans)")
    staged = whole.withColumn("_parts", parts)
    return staged.select("tree", "leaf", F.array_join(F.transform("_parts", piece), "").alias("formatted"), F.aggregate("_parts", start, span)["spans"].alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``roles``, ``texts`` (unescaped, in order) and ``loss_text`` (unescaped text under the loss spans)."""
    pieces = F.split("formatted", END)
    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.split(F.substr(p, F.lit(len(TURN) + 1)), r"\[SEP\]"))
    staged = formatted.withColumn("_turns", turns)
    under = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["from"] + 1, s["length"])))
    return staged.withColumns(
        {"roles": F.transform("_turns", lambda t: unescape(t[0])), "texts": F.transform("_turns", lambda t: unescape(t[1])), "loss_text": F.array_join(under, "")}
    ).drop("_turns")
