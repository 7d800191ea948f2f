"""LM scoring with a log-bilinear neural model trained by noise-contrastive estimation.

Tokens are the words of the lower-cased text and one end. All training documents are counted, and
all of them train the model. The model predicts a token's row from the groups of the two tokens
before it. Every token counted ``MIN_COUNT`` times has a row of its own, up to the ``ROWS`` most
frequent (the bound of what is broadcast), so the rows grow with the corpus; the others belong to one
of ``TAILS`` rows by their last two bytes, and within such a row words follow their add-half counts
with room for one word never seen. So the probabilities of all words sum to one. Before a token, the
``CONTEXTS`` most frequent are groups of their own and the others go by the same tails. The score of a
row is bilinear: vectors of the groups before it, scaled by a learned diagonal for each position,
times the row's vector, plus the log of its share of all tokens. Products of matrices give the normaliser of every pair of
groups, in blocks over the executors, so scores are exact log10 probabilities.

Training does not depend on how the table is cut into files and tasks. Documents are dealt by a hash
of id and text to ``ROUNDS`` rounds and to shards of about ``SHARD_TOKENS`` tokens. In a round every
shard descends by itself in numpy, in the order of the hash, from the parameters of the round before;
then each row's values are averaged over the shards that met the row, weighted by how often. So a word
that few shards hold is not held back by the others, and every round goes on where the last one ended.

Counts of the ``HEAD`` most frequent tokens travel to the executors; the rest of a document's words
are joined with the full table of counts, so every count is exact whatever the vocabulary's size.
Words are told apart by a 64-bit hash.

Null texts count as empty: one token, the end. Rows with a null id are scored, and not learned
from. Repeated rows count as often as they occur; rows equal in id and text train in one shard, which
streams them. Without training documents every count is 0.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialise
from .textbytes import SPACE, blocks, row_sums, words

ROWS, MIN_COUNT = 1 << 16, 8
CONTEXTS, TAILS = 1792, 256
HEAD = 1 << 18
HELD = 1 << 19  # different tokens a task holds, some 16 MB
DIM = 16
BATCH = 4096
NOISE, SHARED = 8, 32
RATE, SEEN = 0.2, 0.1
ROUNDS, SHARD_TOKENS = 4, 1 << 23
END = np.uint64(0x5EED_0E0D)
_GROUPS = CONTEXTS + TAILS
_START = _GROUPS  # the group before the first token


def _tokens(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes and tail classes of the tokens of a block, and the first token of each row."""
    for _, data, offsets in blocks(texts):
        w = words(data, offsets, ~SPACE)
        last = w.data[w.end - 1].astype(np.int64) if len(w.end) else np.zeros(0, np.int64)
        prior = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0) if len(w.end) else last
        tail = ((last * 31 + prior) % TAILS).astype(np.int32)
        yield np.insert(w.hashes(), w.first[1:], END), np.insert(tail, w.first[1:], 0), w.first + np.arange(len(w.first))


def _distinct(h: np.ndarray, tail: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(h)
    h = h[order]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[start], tail[order[start]], np.add.reduceat(n[order], start)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task, given away whenever more than ``HELD`` different tokens are at hand."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def out(done: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch([done[0].view(np.int64), done[1], done[2].astype(np.int64)], ["h", "tail", "n"])

    for batch in batches:
        for h, t, _ in _tokens(batch.column(0)):
            held.append(_distinct(h, t, np.ones(len(h), np.int32)))
            if sum(len(x[0]) for x in held) > 2 * HELD:
                held = [_distinct(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                if len(held[0][0]) > HELD:
                    yield out(held.pop())
    if held:
        yield out(_distinct(*(np.concatenate(x) for x in zip(*held, strict=True))))


def count_tokens(train: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, tail, n): how often each token occurs in the training texts."""
    parts = train.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(_count, "h bigint, tail int, n bigint")
    return materialise(parts.groupBy("h").agg(F.min("tail").alias("tail"), F.sum("n").alias("n")), "counts")


@dataclass
class Vocabulary:
    """The most frequent tokens by hash, with counts, rows and groups, and totals of all tokens."""

    h: np.ndarray
    n: np.ndarray
    row: np.ndarray  # below ``own``, or ``own`` + the tail
    group: np.ndarray
    own: int
    row_n: np.ndarray
    row_size: np.ndarray  # different words of each row
    total: int
    distinct: int

    @classmethod
    def of(cls, counts: DataFrame) -> Vocabulary:
        head = counts.orderBy(F.desc("n"), "h").limit(HEAD).toArrow()
        h, tail, n = (head[c].to_numpy() for c in ("h", "tail", "n"))
        own = min(ROWS, int((n >= MIN_COUNT).sum()))
        rank = np.arange(len(h))
        row, group = np.where(rank < own, rank, own + tail), np.where(rank < CONTEXTS, rank, CONTEXTS + tail)
        row_n, row_size = np.zeros(own + TAILS), np.zeros(own + TAILS)
        total = distinct = 0
        for r in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
            row_n[own + r["tail"]], row_size[own + r["tail"]] = r["n"], r["v"]
            total, distinct = total + r["n"], distinct + r["v"]
        np.subtract.at(row_n, own + tail[:own], n[:own])
        np.subtract.at(row_size, own + tail[:own], 1)
        row_n[:own] = n[:own]
        by = np.argsort(h.view(np.uint64))
        return cls(h.view(np.uint64)[by], n[by], row[by].astype(np.int32), group[by].astype(np.int32), own, row_n, row_size, int(total), int(distinct))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of each token in the table, and whether it is there."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return at, self.h[at] == h

    def places(self, h: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows and groups of tokens, their positions in the table, and whether they are there."""
        at, there = self.find(h)
        if not len(self.h):
            return self.own + tail, CONTEXTS + tail, at, there
        return np.where(there, self.row[at], self.own + tail), np.where(there, self.group[at], CONTEXTS + tail), at, there

    def unigram(self) -> np.ndarray:
        return (self.row_n + 0.5) / (self.row_n.sum() + 0.5 * len(self.row_n))


def _contexts(group: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups one and two before each token, within its document."""
    one, two = np.empty_like(group), np.empty_like(group)
    one[1:], two[2:] = group[:-1], group[:-2]
    one[first[:-1]] = two[first[:-1]] = _START
    second = first[:-1][np.diff(first) > 1] + 1
    two[second] = _START
    return one, two


class LogBilinear:
    """Vectors of groups and rows, the diagonals of both positions, and fixed biases of rows.

    ``seen`` holds for each vector the sum of squares that scales its steps.
    """

    PARTS = "context", "target", "scale"

    def __init__(self, unigram: np.ndarray, dim: int = DIM, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.context = rng.normal(0, 0.1, (_GROUPS + 1, dim)).astype(np.float32)
        self.target = rng.normal(0, 0.1, (len(unigram), dim)).astype(np.float32)
        self.scale = np.ones((2, dim), np.float32)
        self.bias = np.log(unigram).astype(np.float32)
        self.seen = {k: np.full(len(getattr(self, k)), SEEN, np.float32) for k in self.PARTS}

    def offsets(self) -> dict[str, int]:
        """Where each part starts when all vectors are numbered through."""
        return {"context": 0, "target": len(self.context), "scale": len(self.context) + len(self.target)}

    def log_normaliser(self, lo: int, hi: int, step: int = 512) -> np.ndarray:
        """ln of the sum over all rows, for groups lo to hi one before and every group two before."""
        near, far = self.context[lo:hi] * self.scale[0], self.context * self.scale[1]
        z = np.zeros((hi - lo, len(far)), np.float32)
        # buffers that are used again: their pages stay in place
        one, two, more = np.empty((hi - lo, step), np.float32), np.empty((len(far), step), np.float32), np.empty_like(z)
        for a in range(0, len(self.bias), step):
            q, n = self.target[a : a + step].T, min(step, len(self.bias) - a)
            one[:, :n], two[:, :n] = near @ q + self.bias[a : a + step], far @ q
            np.exp(one[:, :n], out=one[:, :n])
            np.exp(two[:, :n], out=two[:, :n])
            z += np.matmul(one[:, :n], two[:, :n].T, out=more)
        return np.log(z)


def _sums(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different indexes, the sum of the values of each, and how often it occurs."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    start = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    return index[start], np.add.reduceat(values[order], start, axis=0), np.diff(np.append(start, len(index)))


class Trainer:
    """Stochastic gradient descent on the noise-contrastive objective, with scaled steps."""

    def __init__(self, model: LogBilinear, unigram: np.ndarray, seed: int = 13, rate: float = RATE):
        self.m, self.rate, self.rng = model, np.float32(rate), np.random.default_rng(seed)
        self.cdf = np.cumsum(unigram)
        self.log_kp = np.log(NOISE * unigram).astype(np.float32)
        self.met = {k: np.zeros(len(getattr(model, k)), np.int64) for k in model.PARTS}
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _move(self, part: str, rows: np.ndarray, grad: np.ndarray, times: np.ndarray | int) -> None:
        x, seen = getattr(self.m, part), self.m.seen[part]
        seen[rows] += np.einsum("ij,ij->i", grad, grad) / np.float32(grad.shape[1])
        x[rows] -= grad * (self.rate / np.sqrt(seen[rows]))[:, None]
        self.met[part][rows] += times

    def step(self, one: np.ndarray, two: np.ndarray, row: np.ndarray) -> None:
        m = self.m
        drawn = np.minimum(np.searchsorted(self.cdf, self.rng.random(SHARED) * self.cdf[-1]), len(self.cdf) - 1)
        r1, r2 = m.context[one], m.context[two]
        predicted = r1 * m.scale[0] + r2 * m.scale[1]
        q, qn = m.target[row], m.target[drawn]
        true = np.einsum("ij,ij->i", predicted, q) + m.bias[row] - self.log_kp[row]
        false = predicted @ qn.T + (m.bias[drawn] - self.log_kp[drawn])
        with np.errstate(over="ignore"):
            g = -1 / (1 + np.exp(true))
            gn = np.float32(NOISE / SHARED) / (1 + np.exp(-false))
        back = g[:, None] * q + gn @ qn
        groups, moved, times = _sums(np.concatenate([one, two]), np.concatenate([back * m.scale[0], back * m.scale[1]]))
        rows, rest, met = _sums(np.concatenate([row, drawn]), np.concatenate([g[:, None] * predicted, gn.T @ predicted]))
        scale = np.stack([(back * r1).sum(axis=0), (back * r2).sum(axis=0)]) / np.float32(len(row))
        self._move("context", groups, moved, times)
        self._move("target", rows, rest, met)
        self._move("scale", np.arange(2), scale, len(row))

    def add(self, *tokens: np.ndarray, last: bool = False) -> None:
        """Train on (one, two, row) in steps of ``BATCH`` tokens, wherever the stream is cut."""
        self.held.append(tokens)
        n = sum(len(x[0]) for x in self.held)
        if n < 16 * BATCH and not last:
            return
        one, two, row = (np.concatenate(x) for x in zip(*self.held, strict=True))
        done = n if last else n - n % BATCH
        for lo in range(0, done, BATCH):
            self.step(one[lo : min(lo + BATCH, done)], two[lo : min(lo + BATCH, done)], row[lo : min(lo + BATCH, done)])
        self.held = [(one[done:], two[done:], row[done:])]

    def found(self) -> pa.RecordBatch:
        """The vectors that were met, numbered through, with how often."""
        self.add(*[np.zeros(0, np.int64)] * 3, last=True)
        at, n, seen, values = [], [], [], []
        for part, start in self.m.offsets().items():
            rows = np.flatnonzero(self.met[part])
            at.append(rows + start)
            n.append(self.met[part][rows].astype(np.float64))
            seen.append(self.m.seen[part][rows])
            values.append(getattr(self.m, part)[rows])
        flat = np.concatenate(values)
        return pa.record_batch([np.concatenate(at), np.concatenate(n), np.concatenate(seen), *[np.ascontiguousarray(flat[:, i]) for i in range(flat.shape[1])]], ["at", "n", "seen", *[f"v{i}" for i in range(flat.shape[1])]])


def train(texts: DataFrame, vocabulary: Broadcast, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> LogBilinear:
    """The model after all rounds; the same for any layout of the rows of ``texts``."""
    v = vocabulary.value
    unigram = v.unigram()
    model = LogBilinear(unigram)
    shards = max(1, -(-v.total // shard_tokens))
    text = F.col(f"`{text_col}`").cast("string")
    key = F.xxhash64(F.col(f"`{id_col}`"), text)
    dealt = texts.select(text.alias("text"), key.alias("key")).withColumns({"round": F.pmod("key", F.lit(ROUNDS)), "shard": F.pmod(F.hash("key"), F.lit(shards))})
    names = [f"v{i}" for i in range(DIM)]
    kind = "at bigint, n double, seen float, " + ", ".join(f"{x} float" for x in names)
    mean = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
    for nth in range(ROUNDS):
        start = texts.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], nth: int = nth, start: Broadcast = start) -> Iterator[pa.RecordBatch]:
            words, now, trainer = vocabulary.value, None, None
            for batch in batches:
                shard = batch.column(1).to_numpy()
                cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1), len(shard)]
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    if hi > lo and shard[lo] != now:
                        if trainer:
                            yield trainer.found()
                        now = shard[lo]
                        trainer = Trainer(copy.deepcopy(start.value), words.unigram(), seed=int(now) * ROUNDS + nth)
                    for h, tail, first in _tokens(batch.column(0).slice(lo, hi - lo)):
                        row, group, _, _ = words.places(h, tail)
                        trainer.add(*_contexts(group, first), row)
            if trainer:
                yield trainer.found()

        mine = dealt.where(F.col("round") == nth).select("text", "shard", "key")
        mine = mine.repartition(min(3 * shards, 20_000) if shards > 1 else 1, "shard").sortWithinPartitions("shard", "key")
        # in the order of the hash, a shard's steps are the same however its rows arrived
        moved = mine.select("text", "shard").mapInArrow(run, kind).groupBy("at").agg(mean("seen"), *[mean(x) for x in names]).toArrow()
        at, seen = moved["at"].to_numpy(), moved["seen"].to_numpy()
        values = np.stack([moved[x].to_numpy() for x in names], axis=1).astype(np.float32)
        for part, lo in model.offsets().items():
            x = getattr(model, part)
            own = (at >= lo) & (at < lo + len(x))
            x[at[own] - lo] = values[own]
            model.seen[part][at[own] - lo] = seen[own]
        start.unpersist()
    return model


def log_normalisers(spark: SparkSession, model: Broadcast, block: int = 256) -> np.ndarray:
    """ln of the normaliser of every pair of groups, computed in blocks over the executors."""
    n = _GROUPS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                z = model.value.log_normaliser(i * block, min(n, (i + 1) * block))
                yield pa.record_batch([pa.array([i]), pa.array([z.tobytes()], pa.binary())], ["i", "z"])

    blocks_ = -(-n // block)
    rows = spark.range(0, blocks_, 1, min(blocks_, 16)).mapInArrow(run, "i bigint, z binary").collect()
    return np.concatenate([np.frombuffer(r["z"], np.float32).reshape(-1, n) for r in sorted(rows, key=lambda r: r["i"])])


_SCORED = "rid bigint, n_tokens bigint, n_known bigint, base double, score double, tail array<bigint>"


def _score_texts(texts: pa.Array, v: Vocabulary, model: LogBilinear, norm: np.ndarray) -> Iterator[tuple]:
    floor = np.log10(v.total + 0.5 * (v.distinct + 1))
    count_log = np.log10(v.n + 0.5) if len(v.n) else np.zeros(1)
    # what a word loses to its tail's row; words with a row of their own lose nothing
    within = np.log10(v.row_n + 0.5 * (v.row_size + 1))
    near, far = model.context * model.scale[0], model.context * model.scale[1]
    for h, tail, first in _tokens(texts):
        row, group, at, there = v.places(h, tail)
        one, two = _contexts(group, first)
        logp = np.empty(len(row))
        for lo in range(0, len(row), 1 << 16):
            a, b, r = one[lo : lo + (1 << 16)], two[lo : lo + (1 << 16)], row[lo : lo + (1 << 16)]
            logp[lo : lo + (1 << 16)] = np.einsum("ij,ij->i", near[a] + far[b], model.target[r]) + model.bias[r] - norm[a, b]
        counted = np.where(there, count_log[np.minimum(at, len(count_log) - 1)], 0.0)
        base = row_sums(counted - floor, first)
        score = row_sums(logp / np.log(10) + np.where(row < v.own, 0.0, counted - within[row]), first)
        known = row_sums(there.astype(np.int64), first)
        rare = np.flatnonzero(~there)
        rows = np.searchsorted(first, rare, "right") - 1
        yield np.diff(first), known, base, score, h[rare].view(np.int64), np.searchsorted(rows, np.arange(len(first)))


def score(docs: DataFrame, learn_from: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``."""
    counts = count_tokens(learn_from, text_col)
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary.of(counts))
    model = spark.sparkContext.broadcast(train(learn_from, vocabulary, id_col, text_col))
    norm = spark.sparkContext.broadcast(log_normalisers(spark, model))
    total = vocabulary.value.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m, z = vocabulary.value, model.value, norm.value
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            lo = 0
            for tokens, known, base, scored, rare, first in _score_texts(batch.column(1), v, m, z):
                n = len(tokens)
                tail = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(rare))
                yield pa.record_batch([batch.column(0).slice(lo, n), pa.array(rid + np.arange(n)), pa.array(tokens), pa.array(known), pa.array(base), pa.array(scored), tail], ["id", *[x.split()[0] for x in _SCORED.split(", ")]])
                lo += n
                rid += n

    light = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string"))
    rows = materialise(light.mapInArrow(run, f"id {light.schema['id'].dataType.simpleString()}, {_SCORED}"), "scored")
    rare = rows.select("rid", F.explode("tail").alias("h")).groupBy("rid", "h").agg(F.count(F.lit(1)).alias("times"))
    rest = rare.join(counts.select("h", "n"), "h", "left").groupBy("rid").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
    )
    more = F.coalesce("more", F.lit(0.0))
    return rows.join(rest, "rid", "left").select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
