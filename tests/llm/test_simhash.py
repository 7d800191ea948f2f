import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from genoloom.llm import simhash as S
from genoloom.llm.components import components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    k = min(3, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[j : j + k]).encode(), 42) for j in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    vocabulary = [f"W{i}é" for i in range(200)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 40, 300]))) for _ in range(30)]
    near = []
    for t in base[:15]:
        w = t.split(" ")
        for _ in range(4):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
            near.append("\t".join(w))
    return base + near + base[:5] + [None, "", " \n", "x", base[4].upper()] + ["y " * 70_000]


def test_equals_brute_force(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = [brute_fingerprint(t) for t in texts]
    want = {i: (f"{f:016x}", g) for i, (f, g) in enumerate(zip(fps, brute_groups(fps), strict=True))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.near_duplicates(docs).collect()}
    assert got == want


def test_keys_cover_every_choice_of_equal_bytes():
    assert all(S._FIRST[m] >= 0 for m in range(256) if m.bit_count() >= S.MIN_SHARED)


@pytest.mark.parametrize("key", range(len(S.KEYS)))
def test_tally_counts_shared_bytes_and_filters(key):
    rng = np.random.default_rng(key)
    columns = rng.integers(0, 4, (70, 8)).astype(np.uint8)
    columns[:, S.KEYS[key]] = 9
    want = (columns[:, None] == columns[None]).sum(axis=2)
    assert (S._tally(columns, key) == want).all() and (want < S.MIN_SHARED).any() and (want > S.MIN_SHARED).any()


@pytest.mark.parametrize("size", [2, 16, 5000])
def test_blocks_of_long_lists_lose_no_link(spark, monkeypatch, size):
    monkeypatch.setattr(S, "LIST", size)
    rng = np.random.default_rng(2)
    center = int(rng.integers(1 << 62))
    fps = {center}
    for _ in range(120):
        f = center
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            f ^= 1 << int(b)
        fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {r["fp"]: r["root"] for r in S.classes(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    groups = brute_groups(fps)
    assert len(set(got.values())) == len(set(groups))
    assert all((got[signed[i]] == got[signed[j]]) == (groups[i] == groups[j]) for i in range(len(fps)) for j in range(i))


def test_one_row_of_each_group_stays(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    docs = docs.unionByName(docs.where("doc_id < 7")).unionByName(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    groups = brute_groups([brute_fingerprint(t) for t in texts])
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(docs).count() == 0 and S.drop_near_duplicates(docs).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
