"""Quality classifier: supervised subword embeddings.

Every word and every 3- and 4-byte gram within a word is hashed to a row of a table of learned
vectors; a document is the mean of its rows, and softmax over two outputs gives the probability
of label 1. Both layers are trained together by stochastic gradient descent in numpy, over a
bounded sample of labelled rows: the rows with the smallest hash of the id among all that may be
learned from, ``MAX_TRAIN`` of them and ``MAX_TRAIN_BYTES`` of text at most, each text whole. Scoring covers every row and whole texts. Since mean and output
are linear, a trained model is kept as one number per table row (its vector times the difference
of the outputs), so scoring a document is a sum over its grams. A word equal to the word before it counts as one more gram, the same
for all words, and ``PRIOR`` empty grams draw short texts towards the bias.

Only the text is an input of a score. Null texts count as empty; a text without grams gets the
score of the bias alone. Labelled rows without a text, a label or an id are not learned from;
rows equal in id, label and text are learned from once. Without rows of both labels every score is the share of
label 1 (0.5 with no row). Other columns pass untouched.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .textbytes import SPACE, Words, blocks, row_sums, words

MAX_TRAIN, MAX_TRAIN_BYTES = 8192, 1 << 26
BUCKETS = 1 << 16
DIM = 8
EPOCHS = 4
RATE = 0.5
THRESHOLD = 0.3
PRIOR = 24
GRAMS = (3, 4)
_REPEAT = 0  # the table row of a repeated word
_MUL = np.uint32(0x9E3779B1)


def _buckets(data: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table rows of the words of a block; the table row and validity of the gram from each byte."""
    of_words = (w.hashes() >> np.uint64(48)).astype(np.int32)
    n = len(data)
    grams, valid = [], []
    space = SPACE[data].copy()
    room = np.zeros(n, np.int32)  # bytes left in the word, from each byte
    lengths = w.end - w.start
    inside = np.repeat(w.end, lengths) - (np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(w.start, lengths))
    room[~space] = inside
    x = data.astype(np.uint32)
    h = np.zeros(n, np.uint32)
    for i in range(max(GRAMS)):
        if i < n:
            h[: n - i] = (h[: n - i] ^ x[i:]) * _MUL
        if i + 1 in GRAMS:
            grams.append(((h ^ (h >> np.uint32(15))) * _MUL >> np.uint32(16)).astype(np.int32))
            valid.append(room > i)
    return of_words, np.stack(grams), np.stack(valid)


def _repeats(w: Words) -> np.ndarray:
    """Marks words that equal the word before them in the row."""
    h = w.hashes()
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[w.first[:-1][np.diff(w.first) > 0]] = False
    return again


class Model:
    """``weight``: one number per table row, for the words and for the grams; ``bias``."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float32), float(bias)

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = []
        for _, data, offsets in blocks(texts):
            w = words(data, offsets, ~SPACE, lower=False)
            of_words, grams, valid = _buckets(data, w)
            again = row_sums(_repeats(w).astype(np.int64), w.first)
            total = row_sums(self.weight[of_words].astype(np.float64), w.first) + again * float(self.weight[_REPEAT])
            count = np.diff(w.first) + again + float(PRIOR)
            own = self.weight[BUCKETS:]
            for g, v in zip(grams, valid, strict=True):
                total += row_sums(np.where(v, own[g], 0).astype(np.float64), offsets)
                count += row_sums(v.astype(np.int64), offsets)
            z = total / count + self.bias
            out.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
        return np.concatenate(out) if out else np.zeros(0)


def counted(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Table rows of each text, ascending, and how often each is met."""
    for _, data, offsets in blocks(texts):
        w = words(data, offsets, ~SPACE, lower=False)
        of_words, grams, valid = _buckets(data, w)
        again = row_sums(_repeats(w).astype(np.int64), w.first)
        for i in range(len(offsets) - 1):
            a, b = offsets[i], offsets[i + 1]
            rows = np.concatenate([of_words[w.first[i] : w.first[i + 1]], *(g[a:b][v[a:b]] + BUCKETS for g, v in zip(grams, valid, strict=True)), np.full(again[i], _REPEAT, np.int32)])
            yield np.unique(rows, return_counts=True)


def _shares(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ids.astype(np.int32), (n / (n.sum() + PRIOR)).astype(np.float32)


def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Table rows of each text and the share of each."""
    return [_shares(ids, n) for ids, n in counted(texts)]


def pack(ids: np.ndarray, n: np.ndarray) -> bytes:
    """What ``counted`` gives of a text, in 3 bytes a table row, or more where a count is over 255."""
    head = np.array([len(ids), np.searchsorted(ids, BUCKETS)], np.uint32)
    return head.tobytes() + ids.astype(np.uint16).tobytes() + n.astype(np.min_scalar_type(int(n.max(initial=0)))).tobytes()


class Packed:
    """Packed texts as a sequence of features, each unpacked when it is asked for."""

    def __init__(self, texts: list):
        self.texts = texts

    def __len__(self) -> int:
        return len(self.texts)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(self.texts[i], np.uint8)
        size, of_words = data[:8].view(np.uint32).tolist()
        ids, n = data[8 : 8 + 2 * size].view(np.uint16).astype(np.int32), data[8 + 2 * size :]
        ids[of_words:] += BUCKETS
        return _shares(ids, n.view(f"u{len(n) // size}").astype(np.int64) if size else n.astype(np.int64))


def sgd(rows: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, dim: int = DIM, rate: float = RATE, seed: int = 7) -> Model:
    """Embeddings and softmax output by stochastic gradient descent, a row at a time."""
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(2 * BUCKETS), np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (2 * BUCKETS, dim)).astype(np.float32)
    out = np.zeros((2, dim), np.float32)
    bias = np.log(np.array([1 - share, share], np.float32))
    steps, done = epochs * len(labels), 0
    scale = np.float32(16)  # of the document vector, so that the table learns in few passes
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            now = np.float32(rate * (1 - done / steps))
            ids, part = rows[i]
            vector = scale * (part @ table[ids])
            z = out @ vector + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ out
            out -= now * np.outer(p, vector)
            bias -= now * np.float32(0.1) * p
            table[ids] -= (now * scale * part)[:, None] * back
            done += 1
    return Model(scale * (table @ (out[1] - out[0])), bias[1] - bias[0])


def learnable(id_: Column) -> Column:
    """Ids a model may learn from: crc32 of the id as text is no multiple of 5. Null is none."""
    return F.coalesce(F.crc32(id_.cast("string")) % 5 != 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN, max_bytes: int = MAX_TRAIN_BYTES) -> Model:
    """A model of the sample; only that many rows, and of each its hashed grams, packed, reach the driver."""
    spark = docs.sparkSession
    known = labels.where(learnable(F.col(f"`{id_col}`")) & F.col(f"`{label_col}`").isin(0, 1)).select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label_col}`").cast("int").alias("label")).distinct()
    known = known.orderBy(F.xxhash64("__id"), "__id", "label").limit(max_train)
    texts = docs.where(F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    # first which rows: an id may recur in the documents, and texts may be long
    light = texts.join(F.broadcast(known), "__id").select("__id", "label", "hash", F.octet_length("text").alias("bytes")).distinct()
    rows, left = [], max_bytes
    for r in light.orderBy(F.xxhash64("__id"), "__id", "label", "hash").limit(max_train).collect():
        left -= r["bytes"]
        if rows and left < 0:
            break
        rows.append((r["__id"], r["label"], r["hash"]))
    if not rows:
        return sgd([], np.zeros(0, np.int64))
    chosen = spark.createDataFrame(rows, light.select("__id", "label", "hash").schema)

    def hashed(column: pa.Array) -> pa.Array:
        return pa.array([pack(ids, n) for ids, n in counted(column)], pa.binary())

    sample = texts.join(F.broadcast(chosen), ["__id", "hash"]).dropDuplicates(["__id", "hash", "label"])
    found = sample.select("__id", "label", "hash", arrow_udf(hashed, "binary")("text").alias("f")).toArrow()
    label = found["label"].to_numpy().astype(np.int64)
    # the order in which rows arrive is no part of the model
    key = list(zip(map(str, found["__id"].to_pylist()), label.tolist(), found["hash"].to_pylist(), strict=True))
    order = sorted(range(len(key)), key=key.__getitem__)
    packed = [x.as_buffer() for x in found["f"]]
    model = sgd(Packed([packed[i] for i in order]), label[order])
    del found, packed
    pa.default_memory_pool().release_unused()  # else the pool keeps the sample's memory through the stages that follow
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", result: str = "score") -> DataFrame:
    """The documents with the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(texts), pa.float64())

    return docs.withColumn(result, arrow_udf(scored, "double")(F.col(f"`{text_col}`").cast("string")))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """Documents that score at least ``threshold``; the columns stay."""
    return score(docs, model, text_col, "__quality").where(F.col("__quality") >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
