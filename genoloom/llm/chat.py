"""Chat formatting of reply trees, in DataFrame functions alone.

Messages point at the message they answer. Paths from roots to leaves are enumerated by self-joins
that double their reach: with every round the known (leaf, ancestor) pairs are joined with a table
of jumps twice as far, so a tree of depth d takes about log2(d) rounds, and the work is the size of
the paths. Branches of a tree are ranked by score, and each chosen path is formatted as one
conversation, with spans for the loss over the assistant's texts.

The template is ``<s>``, then for each turn ``<|role|>text</s>``. Within texts and roles a
backslash, ``<``, ``[`` and ``|`` (``|`` in roles only) are written as ``\\e``, ``\\l``, ``\\b`` and
``\\p``; after that no control string, of this template or of those in square brackets, is left in
them, and reading back restores every text.

Null texts and roles are empty. Messages whose parent is null or not in the tree are roots. Messages
below a loop of parents reach no root and stand on no path. Repeated messages (equal tree and id)
are one, the first by role and text. Null trees are a tree of their own. Ties in rank go by the
leaf's id. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise

ASSISTANT = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    """The text without control characters of the template; reversible."""
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))
    return F.replace(out, F.lit("|"), F.lit("\\p")) if role else out


def unescape(text: Column) -> Column:
    """The text that ``escape`` was given."""
    out = F.replace(F.replace(F.replace(text, F.lit("\\p"), F.lit("|")), F.lit("\\b"), F.lit("[")), F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\e"), F.lit("\\"))


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): for every leaf under a root, the messages of its path.

    ``messages`` has tree, node and parent; ``up`` counts messages from the leaf.
    """
    m = materialise(messages.select("tree", "node", "parent"), "messages")
    known = m.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    jumps = m.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left_semi").select("tree", "node", F.col("parent").alias("to"))
    inner = jumps.select(F.col("tree").alias("t"), F.col("to").alias("n")).distinct()
    leaves = m.join(inner, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
    reached = materialise(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths")
    jumps = materialise(jumps, "jumps")
    roots = m.join(jumps.select(F.col("tree").alias("t"), F.col("node").alias("n")), F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti").select("tree", "node")
    reach, most = 1, m.count()
    while reach <= most and not jumps.isEmpty():
        j = jumps.select(F.col("tree").alias("t"), F.col("node").alias("n"), "to")
        here = lambda a, b: F.col("tree").eqNullSafe(F.col("t")) & (F.col(a) == F.col(b))
        further = reached.join(j, here("node", "n")).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + reach).alias("up"))
        reached = materialise(reached.unionByName(further), "paths")
        jumps = materialise(jumps.join(j.withColumnRenamed("to", "next"), here("to", "n")).select("tree", "node", F.col("next").alias("to")), "jumps")
        reach *= 2
    r = roots.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    whole = reached.join(r, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select(F.col("tree").alias("wt"), F.col("leaf").alias("wl"))
    return reached.join(whole, F.col("tree").eqNullSafe(F.col("wt")) & (F.col("leaf") == F.col("wl")), "left_semi")


def format_trees(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, score, formatted, loss) of the ``best`` paths of each tree, or of all.

    ``messages`` has tree, node, parent, role, text and score; a path scores the mean of its
    messages, null scores counting as 0. ``loss`` holds (start, length) of the assistant's texts
    as they stand in ``formatted``, in code points from 0.
    """
    clean = messages.select("tree", "node", "parent", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    # written once: what follows reads ids, scores or texts of it, none of which is computed anew
    clean = materialise(clean, "clean")
    if not clean.groupBy("tree", "node").count().where("count > 1").isEmpty():
        one = Window.partitionBy("tree", "node").orderBy("role", "text", "score", "parent")
        clean = clean.withColumn("nth", F.row_number().over(one)).where("nth = 1").drop("nth")
    known = paths(clean)
    light = clean.select(F.col("tree").alias("t"), F.col("node").alias("n"), "score")
    scored = known.join(light, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    chosen = ranked.select(F.col("tree").alias("ct"), F.col("leaf").alias("cl"), "rank", F.col("score").alias("path_score"))
    turns = known.join(chosen, F.col("tree").eqNullSafe(F.col("ct")) & (F.col("leaf") == F.col("cl")))
    texts = clean.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    turns = turns.join(texts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    head = F.concat(F.lit("<|"), escape(F.col("role"), True), F.lit("|>"))
    turn = F.struct((-F.col("up")).alias("at"), head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == ASSISTANT).alias("learn"))
    grouped = turns.groupBy("tree", "leaf", "rank", "path_score").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.select("tree", "leaf", "rank", F.col("path_score").alias("score"), formatted(F.col("turns")).alias("formatted"), loss_spans(F.col("turns")).alias("loss"))


def formatted(turns: Column) -> Column:
    """The conversation of turns (head, body)."""
    return F.concat(F.lit("<s>"), F.array_join(F.transform(turns, lambda t: F.concat(t["head"], t["body"], F.lit("</s>"))), ""))


def loss_spans(turns: Column) -> Column:
    """(start, length) of the bodies to learn, in code points of the formatted conversation."""
    empty = F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)")
    start = F.struct(F.lit(3).cast("bigint").alias("at"), empty.alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(t["head"])
        span = F.struct(begin.cast("bigint").alias("start"), F.length(t["body"]).cast("bigint").alias("length"))
        return F.struct((begin + F.length(t["body"]) + 4).cast("bigint").alias("at"), F.when(t["learn"], F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def read_turns(text: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""
    pieces = F.filter(F.split(F.substring(text, 4, 2**31 - 1), "<"), lambda p: F.startswith(p, F.lit("|")))
    role = lambda p: F.substring_index(F.substring(p, F.lit(2), F.length(p)), "|>", 1)
    return F.transform(pieces, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(F.substring(p, F.length(role(p)) + 4, F.length(p))).alias("text")))


def read_loss(text: Column, spans: Column) -> Column:
    """All text under the loss spans, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
