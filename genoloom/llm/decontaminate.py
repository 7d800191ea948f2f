"""Benchmark decontamination by winnowing.

Both sides are cut into words. A fingerprint is the hash of ``gram`` consecutive words; of each
``window`` - ``gram`` + 1 consecutive grams the minimum is kept, with all its ties. What is kept
depends on those grams alone, so a document and an item that share ``window`` words in a row
keep a common fingerprint: no shared span of that length is missed. Around each common fingerprint
the hit is extended to both sides: every window of words that holds it is held against the windows
of the items, and consecutive windows make up the shared span. Extension asks for windows by their
hash, so its cost is a few look-ups a fingerprint, however often either side repeats itself: no
occurrence in a document is ever paired with the occurrences in an item. Items of fewer words (but not
none) are one window of their whole length, looked up at every word of a document.

The benchmark is read in blocks of at most ``block_words`` words, the bound of what is broadcast. With
more than one block the documents are written once, to the shared folder, with a number each; a block
then returns numbers and hits of the documents that hit, and nothing else is written.
A document never leaves its partition while it is searched: no hot passage or group of copies
gathers rows.

Nulls and texts without words have no words and no hits. Repeated rows are judged one by one.
Items with equal ids are one item. An item without an id counts for words and spans, is named by
``unnamed`` alone, and takes one place among the items when documents are dropped. An empty benchmark hits
nothing; empty documents give an empty table. Other columns pass untouched; a column named like the
result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .scratch import materialise
from .textbytes import ALNUM, blocks, mix, words

WINDOW, GRAM = 8, 5
BLOCK_WORDS = 2_000_000
PAIRS = 1 << 20  # of rows and items, expanded at a time
_STEP = np.uint64(0xA24BAED4963EE407)
HIT = "struct<n_words:bigint, spans:array<struct<first:int, last:int>>, items:array<string>, unnamed:boolean>"
_SPAN = pa.struct([("first", pa.int32()), ("last", pa.int32())])


def grams(hashes: np.ndarray, left: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the k words from each position, and whether the row has so many left."""
    n = len(hashes)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, n)):
        out[: n - i] += hashes[i:] * _STEP ** np.uint64(i)
    return mix(out), left >= k


def gram_at(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from the given positions."""
    out = np.zeros(len(at), np.uint64)
    for i in range(k):
        out += hashes[at + i] * _STEP ** np.uint64(i)
    return mix(out)


def winnow(grams_: np.ndarray, whole: np.ndarray, span: int) -> np.ndarray:
    """Marks grams that are the minimum of some ``span`` consecutive ones; ties all count."""
    n, top = len(grams_), np.uint64(2**64 - 1)
    g = np.where(whole, grams_, top)
    padded = np.concatenate([np.full(span - 1, top), g, np.full(span - 1, top)])
    least = padded[: n + span - 1].copy()
    for i in range(1, span):
        np.minimum(least, padded[i : i + n + span - 1], out=least)
    kept = np.zeros(n, bool)
    for i in range(span):
        kept |= g == least[i : i + n]
    return kept & whole


def among(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, and whether each is there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


class Windows:
    """Sorted hashes of the windows of one length, and for each the list of items that hold it.

    Equal lists are kept once, so a passage of many words in many items is a single list.
    """

    def __init__(self, k: int, keys: np.ndarray, item: np.ndarray):
        order = np.lexsort((item, keys))
        keys, item = keys[order], item[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (item[1:] != item[:-1])
        keys, self.items = keys[new], item[new]
        self.k = k
        self.keys, self.start = np.unique(keys, return_index=True)
        self.end = np.append(self.start[1:], len(keys))
        names = np.add.reduceat(mix(self.items.astype(np.uint64) + np.uint64(1)), self.start) if len(keys) else self.keys
        _, first, same = np.unique(np.stack([names, (self.end - self.start).astype(np.uint64)]), axis=1, return_index=True, return_inverse=True)
        self.list = first[same.ravel()]


class Benchmark:
    """Fingerprints and windows of a block of items."""

    def __init__(self, texts: list[str], ids: list[str | None], window: int, gram: int):
        self.ids, self.window, self.gram = ids, window, gram
        table = list(_hashed(pa.array(texts, pa.string())))
        hashes = np.concatenate([h for h, _ in table] or [np.zeros(0, np.uint64)])
        counts = np.concatenate([np.diff(first) for _, first in table] or [np.zeros(0, np.int64)])
        left = np.repeat(np.cumsum(counts), counts) - np.arange(len(hashes))
        item, size = np.repeat(np.arange(len(ids)), counts), np.repeat(counts, counts)
        g, whole = grams(hashes, left, gram)
        self.fingerprints = np.unique(g[winnow(g, whole, window - gram + 1) & (size >= window)])
        self.windows = []
        for k in [window, *np.unique(counts[(counts > 0) & (counts < window)]).tolist()]:
            at = np.flatnonzero((left >= k) & ((size >= window) if k == window else (size == k)))
            self.windows.append(Windows(k, gram_at(hashes, at, k), item[at]))

    def _starts(self, h: np.ndarray, left: np.ndarray, k: int) -> np.ndarray:
        """Where windows of k words may hit: around a common fingerprint, or anywhere for short items."""
        if k < self.window:
            return np.flatnonzero(left >= k)
        span = self.window - self.gram + 1
        g, whole = grams(h, left, self.gram)
        at = np.flatnonzero(winnow(g, whole, span))
        at = at[among(self.fingerprints, g[at])[1]]
        starts = np.unique((at[:, None] - np.arange(span)).ravel())
        starts = starts[starts >= 0]
        return starts[left[starts] >= k]

    def hits(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[tuple[Windows, np.ndarray, np.ndarray]]]:
        """Marks words inside a shared window; (windows, row, list) of every list of items met in a row."""
        left = np.repeat(first[1:], np.diff(first)) - np.arange(len(h))
        edge = np.zeros(len(h) + 1, np.int64)
        met = []
        for windows in self.windows:
            at = self._starts(h, left, windows.k)
            place, there = among(windows.keys, gram_at(h, at, windows.k))
            at, place = at[there], place[there]
            edge[at] += 1
            edge[at + windows.k] -= 1
            if len(at):
                row = np.searchsorted(first, at, "right") - 1
                pairs = np.unique(row * len(windows.keys) + windows.list[place])
                met.append((windows, pairs // len(windows.keys), pairs % len(windows.keys)))
        return np.cumsum(edge[:-1]) > 0, met

    def names(self, windows: Windows, row: np.ndarray, lists: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, item) of the lists met, different within what is expanded at a time."""
        many = windows.end[lists] - windows.start[lists]
        total = np.cumsum(many)
        lo = 0
        while lo < len(row):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, "right")))
            c = many[lo:hi]
            item = windows.items[np.repeat(windows.start[lists[lo:hi]] - np.cumsum(c) + c, c) + np.arange(c.sum())]
            pairs = np.unique(np.repeat(row[lo:hi], c) * len(self.ids) + item)
            yield pairs // len(self.ids), pairs % len(self.ids)
            lo = hi


def _hashed(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for _, data, offsets in blocks(texts):
        w = words(data, offsets, ALNUM)
        yield w.hashes(), w.first


def _find(texts: pa.Array, bench: Benchmark) -> pa.Array:
    out = [pa.array([], pa.struct([("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string())), ("unnamed", pa.bool_())]))]
    for h, first in _hashed(texts):
        inside, met = bench.hits(h, first)
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        # runs end with their row
        full = np.diff(first) > 0
        begins[first[:-1][full]] = inside[first[:-1][full]]
        ends[first[1:][full] - 1] = inside[first[1:][full] - 1]
        lo, hi = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        base = first[np.searchsorted(first, lo, "right") - 1]
        spans = pa.StructArray.from_arrays([pa.array((lo - base).astype(np.int32)), pa.array((hi - base).astype(np.int32))], fields=list(_SPAN))
        items: dict[int, set] = {}
        for windows, row, lists in met:
            for r, item in bench.names(windows, row, lists):
                for a, b in zip(r.tolist(), item.tolist(), strict=True):
                    items.setdefault(a, set()).add(bench.ids[b])
        named = [sorted(x for x in items.get(i, ()) if x is not None) for i in range(len(first) - 1)]
        out.append(
            pa.StructArray.from_arrays(
                [pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(np.searchsorted(lo, first).astype(np.int32)), spans), pa.array(named, pa.list_(pa.string())), pa.array([None in items.get(i, ()) for i in range(len(first) - 1)], pa.bool_())],
                fields=list(out[0].type),
            )
        )
    return pa.concat_arrays(out)


def load_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[tuple[list[str | None], list[str]]]:
    """(ids, texts) of the benchmark, in blocks of about ``block_words`` words at most; one block at least."""
    ids, texts, size = [], [], 0
    text = F.col(f"`{text_col}`").cast("string")
    for item, text_ in benchmark.where(text.isNotNull()).select(F.col(f"`{id_col}`").cast("string"), text).toLocalIterator():
        n = len(text_) // 2 + 1  # no text has more words
        if ids and size + n > block_words:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(item)
        texts.append(text_)
        size += n
    yield ids, texts


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM, block_words: int = BLOCK_WORDS, result: str = "overlap") -> DataFrame:
    """Documents with a struct ``result``: n_words, shared spans [first, last), item ids, and unnamed.

    Spans are the maximal runs of words inside any shared window.
    """
    if not 1 <= gram <= window:
        raise ValueError("1 <= gram <= window is needed")
    sc = docs.sparkSession.sparkContext
    text = F.col(f"`{text_col}`").cast("string")
    found = load_blocks(benchmark, item_col, item_text_col, block_words)
    block = next(found)
    more: DataFrame | None = None
    number = "__row" + "_" * max(map(len, docs.columns))  # no column has this name
    for after in found:
        if more is None:
            docs = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "documents")
        hit = docs.select(number, _udf(sc.broadcast(Benchmark(block[1], block[0], window, gram)))(text).alias("hit")).where(F.size("hit.spans") > 0)
        hit = materialise(hit.select(number, "hit.spans", "hit.items", "hit.unnamed"), "hits")
        more = hit if more is None else more.unionByName(hit)
        block = after
    last = _udf(sc.broadcast(Benchmark(block[1], block[0], window, gram)))(text)
    if more is None:
        return docs.withColumn(result, last)
    # rows that hit alone, one for each document
    hits = more.groupBy(F.col(number).alias("n")).agg(F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("i"), F.max("unnamed").alias("u"))
    hits = hits.select("n", F.struct("s", "i", "u").alias(number + "hits"))
    own, rest = F.col(f"`{result}`"), F.col(number + "hits")
    none = lambda kind: F.expr(f"cast(array() as {kind})")
    spans = F.array_sort(F.concat(own["spans"], F.coalesce(rest["s"], none("array<struct<first:int,last:int>>"))))
    items = F.array_sort(F.array_distinct(F.concat(own["items"], F.coalesce(rest["i"], none("array<string>")))))
    joined = docs.withColumn(result, last).join(hits, F.col(number) == hits["n"], "left")
    return joined.withColumn(result, F.struct(own["n_words"].alias("n_words"), _merged(spans).alias("spans"), items.alias("items"), (own["unnamed"] | F.coalesce(rest["u"], F.lit(False))).alias("unnamed"))).drop(number, number + "hits", "n")


def _merged(spans: Column) -> Column:
    """Sorted spans with those that touch or overlap made one."""

    def step(done: Column, s: Column) -> Column:
        end = F.element_at(done, -1)
        longer = F.struct(end["first"].alias("first"), F.greatest(end["last"], s["last"]).alias("last"))
        return F.when(F.size(done) == 0, F.array(s)).when(s["first"] > end["last"], F.array_append(done, s)).otherwise(F.array_append(F.slice(done, 1, F.size(done) - 1), longer))

    return F.aggregate(spans, F.expr("cast(array() as array<struct<first:int,last:int>>)"), step)


def _udf(shared: Broadcast):
    @arrow_udf(HIT)
    def overlap(texts: pa.Array) -> pa.Array:
        return _find(texts, shared.value)

    return overlap


def n_hit(result: str = "overlap") -> Column:
    """Words inside any span; spans do not overlap."""
    return F.aggregate(F.col(f"{result}.spans"), F.lit(0).cast("bigint"), lambda n, s: n + (s["last"] - s["first"]).cast("bigint"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_items: int = 1, text_col: str = "text", **options) -> DataFrame:
    """The documents that fewer than ``min_items`` items overlap; the columns stay as they are.

    One shared span of a window's length is a leak, so a single item is enough by default. Items
    without an id count as one.
    """
    name = "__hits" + "_" * max(map(len, docs.columns))
    found = find_overlaps(docs, benchmark, text_col=text_col, result=name, **options)
    return found.where(F.size(f"{name}.items") + F.col(f"{name}.unnamed").cast("int") < min_items).select(*[F.col(f"`{c}`") for c in docs.columns])
