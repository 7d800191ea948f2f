"""Sharding by Karmarkar-Karp differencing.

Groups of equal texts are indivisible and are dealt to ``shards`` shards of near equal bytes. A
partial partition is a tuple of ``shards`` sums; differencing takes the two with the largest
spread and joins them in opposite order, largest sums to smallest, until one is left.

What is differenced are at most 2 x ``ITEMS`` items at any size of the corpus: every group of at
least an ``ITEMS``-th of all bytes is an item of its own, and all smaller groups are hashed into
``ITEMS`` bins, each an item. So a group of a third of all bytes is balanced against the rest, and
the bins, each a small part of a shard, leave a spread of a few bytes. Sums of groups and items are
made by grouped aggregation; the items, and where they go, are small enough for the driver and for
a broadcast, so no document is shuffled to learn its shard.

Size is the text's UTF-8 bytes plus 1; null texts go with empty ones, of size 1. Groups are
told apart by hash, CRC-32 and length; repeated rows stay together. One group larger than a shard's
share takes a shard of its own. Slots count from 0 in each shard without gaps, in the order of a
hash, the id and the CRC. An empty table gives an empty table. Other columns pass untouched, but
those named like the results, which are replaced.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise

SHARDS = 8
ITEMS = 1 << 14
SLOT_ROWS = 50_000


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over tuples (rows of ``sums``): where each goes, and the sums that result.

    ``place[i, j]`` is the position that sum j of tuple i ends in. Equal spreads go by row number.
    """
    n, k = sums.shape
    order = np.argsort(-sums, axis=1, kind="stable")
    top = np.take_along_axis(sums, order, axis=1)
    heap = [(-(t[0] - t[-1]), i) for i, t in enumerate(top.tolist())]
    heapq.heapify(heap)
    live: list = top.tolist()
    parent: list[tuple[int, list[int]] | None] = [None] * n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = live[a], live[b]
        joined = [x[j] + y[k - 1 - j] for j in range(k)]
        by = sorted(range(k), key=lambda j: (-joined[j], j))
        at = [0] * k
        for new, old in enumerate(by):
            at[old] = new
        c = len(live)
        live.append([joined[j] for j in by])
        parent += [None]
        parent[a], parent[b] = (c, at), (c, at[::-1])
        live[a] = live[b] = None
        heapq.heappush(heap, (-(live[c][0] - live[c][-1]), c))
    last = len(live) - 1
    place = np.zeros((len(live), k), np.int16)
    place[last] = np.arange(k)
    for i in range(last - 1, -1, -1):
        c, at = parent[i]
        place[i] = place[c][at]
    out = np.empty((n, k), np.int16)
    np.put_along_axis(out, order, place[:n], axis=1)
    return out, np.array(live[last], np.int64)


def assign(groups: DataFrame, shards: int = SHARDS, items: int = ITEMS) -> tuple[DataFrame, DataFrame]:
    """Shards of groups (h, crc, len, bytes): (h, crc, len, shard) of the large, (bin, shard) of the rest.

    Both tables have at most ``items`` rows.
    """
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    large = F.col("bytes") * items >= total
    big = groups.where(large).select("h", "crc", "len", "bytes").orderBy("h", "crc", "len").toArrow()
    small = groups.where(~large).groupBy(bin_of(items).alias("bin")).agg(F.sum("bytes").alias("bytes")).orderBy("bin").toArrow()
    sums = np.zeros((big.num_rows + small.num_rows, shards), np.int64)
    sums[:, 0] = np.concatenate([big["bytes"].to_numpy(), small["bytes"].to_numpy()])
    place = difference(sums)[0][:, 0].astype(np.int32) if len(sums) else np.zeros(0, np.int32)
    spark = groups.sparkSession
    import pyarrow as pa

    of_big = pa.table({"h": big["h"], "crc": big["crc"], "len": big["len"], "shard": place[: big.num_rows]})
    of_small = pa.table({"bin": small["bin"], "shard": place[big.num_rows :]})
    return spark.createDataFrame(of_big), spark.createDataFrame(of_small)


def bin_of(items: int):
    """The bin of a group among the small ones."""
    return F.pmod(F.xxhash64("h", "crc", "len"), F.lit(items)).cast("int")


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", items: int = ITEMS, prefix: str = "") -> DataFrame:
    """The documents with size, text_crc32, law, shard, slot and grown_shard (null under this law)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keyed = docs.withColumns({"__h": F.xxhash64(text), "__crc": F.crc32(text).cast("long"), "__len": F.octet_length(text).cast("long")})
    size = F.col("__len") + 1
    light = keyed.select(F.col("__h").alias("h"), F.col("__crc").alias("crc"), F.col("__len").alias("len"), size.alias("bytes"))
    groups = materialise(light.groupBy("h", "crc", "len").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")), "groups")
    rows = groups.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    of_big, of_small = assign(groups, shards, items)
    own = of_big.select(F.col("h").alias("__gh"), F.col("crc").alias("__gc"), F.col("len").alias("__gl"), F.col("shard").alias("__own"))
    binned = of_small.select(F.col("bin").alias("__gb"), F.col("shard").alias("__binned"))
    bin_ = F.pmod(F.xxhash64("__h", "__crc", "__len"), F.lit(items)).cast("int")
    placed = keyed.join(F.broadcast(own), (F.col("__h") == F.col("__gh")) & (F.col("__crc") == F.col("__gc")) & (F.col("__len") == F.col("__gl")), "left").withColumn("__bin", bin_)
    placed = placed.join(F.broadcast(binned), F.col("__bin") == F.col("__gb"), "left").withColumn("__shard", F.coalesce("__own", "__binned")).drop("__gh", "__gc", "__gl", "__gb", "__bin", "__own", "__binned")
    # slots: rows are dealt by a hash into parts of a shard, numbered within the part after the rows of the parts before
    parts = max(1, -(-rows // (SLOT_ROWS * shards)))
    dealt = placed.withColumn("__part", F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit(17)), F.lit(parts)).cast("int"))
    before = Window.partitionBy("__s").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(F.col("__shard").alias("__s"), F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__n")).select("__s", "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__shard", "__part").orderBy(F.xxhash64(F.col(f"`{id_col}`")), F.col(f"`{id_col}`"), "__crc", "__h")
    numbered = dealt.withColumn("__row", F.row_number().over(within)).join(starts, (F.col("__shard") == F.col("__s")) & (F.col("__part") == F.col("__p")))
    new = {"size": size, "text_crc32": F.col("__crc"), "law": F.lit("bytes"), "shard": F.col("__shard"), "slot": (F.col("__start") + F.col("__row") - 1).cast("long"), "grown_shard": F.lit(None).cast("int")}
    return numbered.select(*[F.col(f"`{c}`") for c in docs.columns if c not in {prefix + k for k in new}], *[v.alias(prefix + k) for k, v in new.items()])
