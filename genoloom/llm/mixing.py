"""Mixing sources to target weights by entropy balancing, in DataFrame functions alone.

Each document gets a rate: how often the mix repeats it. Among all rates that meet every source's
target of tokens, those closest to 1 are sought, in relative entropy weighted by tokens and under a
bound of ``CAP`` copies. The dual of that problem is convex, smooth but at the bound, with one
multiplier per group: the rate is min(CAP, exp(sum of the multipliers of the document's groups)).
Newton's steps solve it on cells, one row for each combination of groups, made by one grouped sum
over the documents: each step sums tokens times rate over the cells of every group, and moves the
group's multiplier by the gap to its target over the curvature. One family of groups (the sources)
makes the Hessian diagonal; further families are stepped in turn, block by block.

Rates are then rounded into copies. In each source, documents stand from the largest to the
smallest in classes of size; each gets the whole steps that the running sum of rates makes at it.
So the copies up to any point differ from their rates by less than one, and a source's words differ
from its target by less than its largest document. A few single copies, from large documents to
small, then close what is left of that. The running sums are built from counts
per source, class and hash part, so no task orders a whole source.

Null is a source of its own, after all others. Documents without words are never taken. Repeated
rows are mixed one by one, and reruns agree. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise

CAP = 3
WEIGHTS = (5, 2, 1)
STEPS, ROUND = 60, 6
CLOSE = 1e-9
PARTS = 256
CLASSES_PER_OCTAVE = 16
FIXERS = 2
WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of the text: maximal runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(__none, __source, source_size) with target: weights by rank, at most cap times the size.

    What sources above their bound leave is shared by weight among the others. That ends where
    every target is min(bound, level x weight): the bounds met are those lowest by weight, so the
    level follows from running sums in that order.
    """
    rank = F.row_number().over(Window.orderBy("__none", "__source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.select("__none", "__source", "source_size", rank.alias("rank"), weight.alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("bound"))
    order = Window.orderBy(F.col("bound") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    all_ = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(all_) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    # the level of the first source that stays below its bound holds for all after it
    levelled = ranked.withColumn("own", level).withColumn("free", F.col("own") * F.col("weight") <= F.col("bound"))
    first = F.min(F.when(F.col("free"), F.struct("rank_in", "own"))).over(all_)
    levelled = levelled.withColumn("rank_in", F.row_number().over(order)).withColumn("level", first["own"])
    return levelled.select("__none", "__source", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least("bound", F.col("level") * F.col("weight"))).alias("target"))


def newton(cells: DataFrame, families: list[list[str]], cap: int = CAP, steps: int = STEPS) -> DataFrame:
    """Cells (families' columns, size, target_0, target_1, ...) with the rate that balances them."""
    out = cells.withColumns({f"__m_{i}": F.lit(0.0) for i in range(len(families))})
    rate = F.least(F.lit(float(cap)), F.exp(sum((F.col(f"__m_{i}") for i in range(1, len(families))), F.col("__m_0"))))
    tokens = F.col("size") * rate
    written = None
    for _ in range(0, steps, ROUND):
        for _ in range(ROUND):
            for i, family in enumerate(families):
                group = Window.partitionBy(*family)
                gap = F.col(f"target_{i}") - F.sum(tokens).over(group)
                bend = F.sum(F.when(rate < cap, tokens).otherwise(0.0)).over(group)
                # far from the target a whole step overshoots: steps of 1 keep the descent
                step = F.when(bend > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), gap / bend))).when(gap < 0, F.lit(-1.0)).otherwise(0.0)
                out = out.withColumn(f"__m_{i}", F.col(f"__m_{i}") + step)
        written = materialise(out, "newton", drop=written)
        out = written
        off = [F.abs(F.col(f"target_{i}") - F.sum(tokens).over(Window.partitionBy(*family))) / F.greatest(F.col(f"target_{i}"), F.lit(1.0)) for i, family in enumerate(families)]
        worst = out.select(F.greatest(*off, F.lit(0.0)).alias("off")).agg(F.max("off")).first()[0]
        if worst is None or worst < CLOSE:
            break
    none = F.when(F.least(*[F.col(f"target_{i}") for i in range(len(families))], F.lit(1.0)) <= 0, F.lit(0.0))
    return out.withColumn("rate", F.coalesce(none, rate)).drop(*[f"__m_{i}" for i in range(len(families))])


def _upto(rank: Column) -> Column:
    """Copies of the first ``rank`` documents of a source: whole steps of the running sum of rates."""
    return F.floor(F.col("__rate") * rank + 0.5)


def _fixes(starts: DataFrame, of: list[str], cap: int) -> DataFrame:
    """(source, class, part, __fix): cells whose first document is taken once more or once less.

    What rounding leaves of a source's target is closed from large documents to small: the first
    documents of up to FIXERS cells of each class stand in line, and each that brings the words
    nearer is moved. So the rest ends below the smallest sizes, where a source has some.
    """
    took = (_upto(F.col("__start") + F.col("n")) - _upto(F.col("__start"))) * F.col("words") / F.col("n")
    line = Window.partitionBy(*of, "__class").orderBy("__part")
    first = starts.withColumns({"nth": F.row_number().over(line), "copies": (_upto(F.col("__start") + 1) - _upto(F.col("__start"))).cast("int"), "took": took})
    item = F.when((F.col("nth") <= FIXERS) & (F.col("largest") > 0), F.struct("largest", "__class", "__part", "copies"))
    sources = first.groupBy(*of).agg((F.first("target") - F.sum("took")).alias("gap"), F.first("target").alias("target"), F.collect_list(item).alias("line"))
    start = F.struct(F.col("gap").alias("gap"), F.expr("cast(array() as array<struct<c:int,p:int,by:int>>)").alias("moved"))

    def walk(state: Column, x: Column) -> Column:
        by = F.when(state["gap"] > 0, 1).otherwise(-1)
        after = state["gap"] - by * x["largest"]
        good = (F.abs(after) < F.abs(state["gap"])) & F.when(by > 0, x["copies"] < cap).otherwise(x["copies"] > 0)
        moved = F.struct(x["__class"].alias("c"), x["__part"].alias("p"), by.alias("by"))
        return F.struct(F.when(good, after).otherwise(state["gap"]).alias("gap"), F.when(good, F.array_append(state["moved"], moved)).otherwise(state["moved"]).alias("moved"))

    walked = F.aggregate(F.sort_array("line", asc=False), start, walk, lambda s: s["moved"])
    moves = sources.where("target > 0").select(*of, F.explode(walked).alias("m"))
    return moves.select(*of, F.col("m.c").alias("__class"), F.col("m.p").alias("__part"), F.col("m.by").alias("__fix"))


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, prefix: str = "") -> DataFrame:
    """The documents with size, source_size, target, rate, copies and taken."""
    id_, source = F.col(f"`{id_col}`"), F.col(f"`{source_col}`").cast("string")
    base = docs.withColumns({"__none": source.isNull(), "__source": F.coalesce(source, F.lit("")), "__size": n_words(F.col(f"`{text_col}`"))})
    # classes of size, the largest first, and a hash part within each; never null, or joins on them
    # would count the words once more in a filter at the scan
    base = base.withColumns({
        "__class": F.coalesce(F.when(F.col("__size") > 0, -F.floor(F.log2("__size") * CLASSES_PER_OCTAVE)).cast("int"), F.lit(1)),
        "__part": F.coalesce(F.pmod(F.xxhash64(id_, "__size"), F.lit(PARTS)).cast("int"), F.lit(0)),
    })
    of, key = ["__none", "__source"], ["__none", "__source", "__class", "__part"]
    counted = materialise(base.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("__size").alias("size"), F.max("__size").alias("largest")), "cells")
    cells = targets(counted.groupBy(*of).agg(F.sum("size").alias("source_size")), weights, cap).withColumn("size", F.col("source_size").cast("double"))
    rated = newton(cells.withColumnRenamed("target", "target_0"), [of], cap).select(*of, "source_size", F.col("target_0").alias("target"), F.col("rate").alias("__rate"))
    # what stands before a cell: the classes before its own, and the parts before it within the class
    classes = counted.groupBy(*of, "__class").agg(F.sum("n").alias("__cn"))
    earlier = Window.unboundedPreceding, -1
    classes = classes.withColumn("__before", F.coalesce(F.sum("__cn").over(Window.partitionBy(*of).orderBy("__class").rowsBetween(*earlier)), F.lit(0))).drop("__cn")
    within_class = F.coalesce(F.sum("n").over(Window.partitionBy(*of, "__class").orderBy("__part").rowsBetween(*earlier)), F.lit(0))
    starts = counted.select(*key, "n", F.col("size").alias("words"), "largest", within_class.alias("__inner")).join(classes, [*of, "__class"])
    starts = starts.withColumn("__start", F.col("__before") + F.col("__inner")).drop("__before", "__inner").join(rated, of)
    starts = materialise(starts, "starts")
    starts = starts.join(_fixes(starts, of, cap), key, "left")
    starts = starts.select(*[F.col(k).alias(f"{k}_") for k in key], "__start", "__rate", F.coalesce("__fix", F.lit(0)).alias("__fix"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    within = Window.partitionBy(*key).orderBy(F.desc("__size"), F.xxhash64(id_), id_)
    numbered = base.withColumn("__rank", F.row_number().over(within))
    ranked = numbered.join(starts, [numbered[k] == starts[f"{k}_"] for k in key])
    rank = F.col("__start") + F.col("__rank")
    copies = F.when(F.col("__size") == 0, F.lit(0)).otherwise(F.least(F.lit(cap), _upto(rank) - _upto(rank - 1) + F.when(F.col("__rank") == 1, F.col("__fix")).otherwise(0))).cast("int")
    new = {"size": F.col("__size"), "source_size": F.col("__source_size"), "target": F.col("__target"), "rate": F.col("__rate"), "copies": copies, "taken": (copies * F.col("__size")).cast("long")}
    return ranked.select(*[F.col(f"`{c}`") for c in docs.columns if c not in {prefix + k for k in new}], *[v.alias(prefix + k) for k, v in new.items()])


def take(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken; the columns stay as they are."""
    mixed = mix(docs, prefix="__mix_", **options).where(F.col("__mix_copies") > 0)
    return mixed.withColumn("__mix_nth", F.explode(F.sequence(F.lit(1), "__mix_copies"))).select(*[F.col(f"`{c}`") for c in docs.columns])
