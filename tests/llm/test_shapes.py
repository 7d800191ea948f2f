"""Mixing, sharding, chat formatting, archives and order-sensitive fingerprints."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoloom.llm import chat, mixing, order_minhash, sharding, warc


def corpus(seed, n=300):
    rng = random.Random(seed)
    return [(i, rng.choice(["b", "a", "é", None, "a"]), " ".join("w" * rng.randint(1, 6) for _ in range(int(rng.paretovariate(0.9)) % 900))) for i in range(n)]


def targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        t = {s: 3 * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if t[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return t
        capped |= over


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(spark, seed):
    rows = corpus(seed) + [(900 + i, "tiny", "one two") for i in range(3)] + [(950, "none", None), (951, "none", " ")]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, source string, text string, size string")
    pdf = mixing.mix(docs.repartition(5)).toPandas()
    again = mixing.mix(docs.repartition(2)).toPandas()
    assert sorted(zip(pdf.doc_id, pdf.taken, strict=True)) == sorted(zip(again.doc_id, again.taken, strict=True))
    words = {i: len((t or "").split()) for i, _, t in rows}
    assert all(words[r.doc_id] == r.size and r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0 for r in pdf.itertuples())
    source = {i: s for i, s, _ in rows}
    sizes, taken, got = {}, {}, {}
    for r in pdf.itertuples():
        s = source[r.doc_id]
        sizes[s], taken[s], got[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken, r.target
    want = targets(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)
    # a source of a few documents can miss its target by a part of its largest
    largest = {s: max(words[i] for i, x, _ in rows if x == s) for s in want}
    assert all(abs(taken[s] - want[s]) <= max(0.01 * want[s], 0.2 * largest[s]) + 3 for s in want)
    out = mixing.take(docs)
    assert out.columns == docs.columns and out.count() == int((pdf.taken / pdf["size"].clip(lower=1)).sum())


def test_mixing_of_two_families(spark):
    cells = spark.createDataFrame([("a", "x", 100.0), ("a", "y", 50.0), ("b", "x", 30.0), ("b", "y", 80.0)], "s string, l string, size double")
    cells = cells.withColumn("target_0", F.when(F.col("s") == "a", 120.0).otherwise(140.0)).withColumn("target_1", F.when(F.col("l") == "x", 150.0).otherwise(110.0))
    pdf = mixing.newton(cells, [["s"], ["l"]]).toPandas()
    pdf["t"] = pdf["size"] * pdf["rate"]
    assert np.allclose(pdf.groupby("s").t.sum(), [120, 140], rtol=1e-6) and np.allclose(pdf.groupby("l").t.sum(), [150, 110], rtol=1e-6)


def test_mixing_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_differencing_is_near_equal_and_consistent():
    rng = np.random.default_rng(3)
    sums = np.zeros((500, 8), np.int64)
    sums[:, 0] = rng.integers(1, 10_000, 500)
    place, total = sharding.difference(sums)
    assert total.sum() == sums.sum() and total.max() - total.min() <= 10
    assert all(sums[place[:, 0] == j, 0].sum() == total[j] for j in range(8))
    assert all(sorted(p) == list(range(8)) for p in place)


@pytest.mark.parametrize("items", [1 << 14, 64])
def test_sharding(spark, items):
    rows = [(i, t) for i, _, t in corpus(5, 200)] + [(500 + i, "copy é " * 9) for i in range(40)] + [(600, None), (601, ""), (602, "y" * 9000), (602, "y" * 9000)]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, shard string")
    pdf = sharding.shard(docs, items=items).toPandas()
    assert len(pdf) == len(rows) and list(pdf.columns) == ["doc_id", "text", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert (pdf["size"] == [len((t or "").encode()) + 1 for t in pdf.text]).all()
    assert pdf.fillna({"text": ""}).groupby("text").shard.nunique().max() == 1
    for _, g in pdf.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    # groups larger than a share stand alone; the others are near equal
    loads = pdf.groupby("shard")["size"].sum().sort_values()
    groups = pdf.fillna({"text": ""}).groupby("text")["size"].sum().sort_values()
    assert list(loads[-2:]) == list(groups[-2:]) and loads.iloc[-4] - loads.iloc[0] <= (12 if items > 64 else 120)
    assert sharding.shard(docs.limit(0)).count() == 0


def test_reply_trees(spark):
    rows = [("t", 1, None, "user", "hi <s> \\l [INST]|x", 1.0), ("t", 2, 1, "assistant", "a</s>", 0.5), ("t", 3, 1, "assistant", "b", 2.0), ("t", 4, 3, "user", "", 0.0), ("t", 5, 4, "assistant", None, None), ("t", 6, 2, "a|b<", "end", 0.1)]
    rows += [("loop", 1, 2, "user", "x", 1.0), ("loop", 2, 1, "user", "y", 1.0), ("orphan", 8, 77, "user", "z", 1.0), (None, 1, None, "user", "n", 1.0), (None, 1, None, "user", "n", 1.0)]
    m = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    got = {(r["tree"], r["leaf"]): r for r in chat.format_trees(m, None).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("learn", chat.read_loss(F.col("formatted"), F.col("loss"))).collect()}
    assert set(got) == {("t", 5), ("t", 6), ("orphan", 8), (None, 1)}
    five, six = got["t", 5], got["t", 6]
    assert [(x["role"], x["text"]) for x in five["turns"]] == [("user", "hi <s> \\l [INST]|x"), ("assistant", "b"), ("user", ""), ("assistant", "")]
    assert [(x["role"], x["text"]) for x in six["turns"]] == [("user", "hi <s> \\l [INST]|x"), ("assistant", "a</s>"), ("a|b<", "end")]
    assert (five["rank"], six["rank"], five["learn"], six["learn"]) == (1, 2, "b", "a</s>")
    assert five["formatted"].count("</s>") == 4 and "[" not in five["formatted"]
    assert {(r["tree"], r["leaf"]) for r in chat.format_trees(m).collect()} == {("t", 5), ("orphan", 8), (None, 1)}
    assert chat.format_trees(m.limit(0)).count() == 0


def test_a_long_chain(spark):
    m = spark.range(1, 71).select(F.lit("t").alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(1.0).alias("score"))
    row = chat.format_trees(m).withColumn("turns", chat.read_turns(F.col("formatted"))).first()
    assert [x["text"] for x in row["turns"]] == [str(i) for i in range(1, 71)]


def test_archives(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nzz\r\n\r\n"
    rows = [(1, "u", tricky), (2, "u", tricky * 50), (3, "u\r\nX: y", tricky * 50), (4, None, None), (5, "u", ""), (6, "é", "ü\r\n\r\n" * 400), (7, "é", "ü\r\n\r\n" * 400), (7, "é", "ü\r\n\r\n" * 400), (None, "u", "n" * 1200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("type", F.lit("mine"))
    got = warc.round_trip(pages, keep_blocks=True).collect()
    assert len(got) == len(rows)
    want = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        i = int(r["capture_id"]) if r["capture_id"] else None
        assert (r["response"]["payload_bytes"], r["response"]["payload_digest"]) == (len(want[i]), hashlib.sha1(want[i]).hexdigest())
        assert r["type"] == ("revisit" if i in (2, 6) else "response") and r["refers_to_id"] == {2: "3", 6: "7"}.get(i)
        assert r["request"]["uri"] == r["response"]["uri"] and b"GET " in r["request"]["block"]
        if r["type"] == "response":
            assert r["response"]["block"].split(b"\r\n\r\n", 1)[1] == want[i]
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("few", [200_000, 0])
def test_a_hot_payload(spark, monkeypatch, few):
    """A third of all pages holds one payload; the joins are those of a large table where few is 0."""
    monkeypatch.setattr(warc, "BROADCAST_ROWS", few)
    rows = [(i, "u", "hot " * 400 if i % 3 == 0 else f"page {i % 40} " * 150) for i in range(240)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    last = {}
    for i, _, h in rows:
        last[h] = max(last.get(h, i), i)
    want = {i: (None if last[h] == i else str(last[h])) for i, _, h in rows}
    assert {int(r["capture_id"]): r["refers_to_id"] for r in got} == want and len(got) == len(rows)


def brute_signatures(spark, texts):
    """Order MinHash written out in Python, with Spark's hashes."""
    import xxhash

    h_ints = lambda *xs: _chain(xs)

    def _signed(x):
        return x - (1 << 64) if x >> 63 else x

    def _chain(values):
        seed = 42
        for v in values:
            data = v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True) if v_long(v) else int(v).to_bytes(4, "little", signed=True)
            seed = xxhash.xxh64_intdigest(data, seed & ((1 << 64) - 1))
        return _signed(seed)

    def v_long(v):
        return isinstance(v, Long)

    class Long(int):
        pass

    out = []
    for t in texts:
        w = [x for x in (t or "").split() if x]
        keys = [_chain(w[i : i + 2]) for i in range(len(w) - 1)] if len(w) > 1 else [_chain([w[0]])] if w else []
        seen, ks = {}, []
        for at, k in enumerate(keys):
            k >>= 30
            nth = seen.get(k, 0)
            seen[k] = nth + 1
            ks.append((h_ints(Long(k), nth) >> 30, at))
        bins = {}
        for k in sorted(ks):
            bins.setdefault(k[0] >> 28, []).append(k)
        sig = []
        for b in sorted(bins):
            two = sorted(bins[b][:2], key=lambda x: x[1])
            sig.append((b << 32) | (_chain([Long(x[0]) for x in two]) & 0xFFFFFFFF))
        out.append(sig)
    return out


def test_signatures_equal_brute_force(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "b", "ç", "dd"]) for _ in range(n)) for n in (0, 1, 2, 3, 40, 500)] + [None, "x\n y\tz ", "same same same same"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [r["s"] for r in df.select("i", order_minhash.signatures(F.col("text")).alias("s")).orderBy("i").collect()]
    assert got == brute_signatures(spark, texts)


@pytest.mark.parametrize("rows", [4096, 1])
def test_next_document_and_likeness(spark, monkeypatch, rows):
    monkeypatch.setattr(order_minhash, "RANGE_ROWS", rows)
    rng = random.Random(2)
    docs = [(rng.randrange(10**9) if i else 5, " ".join(f"ü{rng.randint(0, 999)}" for _ in range(rng.randint(0, 60)))) for i in range(150)] + [(-4, None), (10**12, "ab")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in order_minhash.compare_edited(df).collect()}
    order = sorted((i, t or "") for i, t in docs)
    for n, (i, t) in enumerate(order):
        other = order[(n + 1) % len(order)][1]
        half = len(t) // 2
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + other[:half]).encode()).hexdigest()
        assert got[i]["n_chars"] == len(t) and 0 <= got[i]["near_next"] <= 1 and 0 <= got[i]["near_edited"] <= 1
    long = [i for i, t in order if len(t.split()) > 30]
    assert np.mean([got[i]["near_edited"] for i in long]) > 0.05 > np.mean([got[i]["near_next"] for i in long])
    assert order_minhash.compare_edited(df.limit(0)).count() == 0


def test_next_document_of_ids_that_are_text(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "RANGE_ROWS", 8)
    rng = random.Random(4)
    docs = [(f"id-{rng.randrange(10**6)}", f"w{i} " * (i % 9)) for i in range(90)] + [("same", "x"), ("same", "y")]
    df = spark.createDataFrame(docs, "doc_id string, text string").repartition(5)
    got = sorted((r["doc_id"], r["edited_sha256"]) for r in order_minhash.compare_edited(df).collect())
    order = sorted(docs)
    want = []
    for n, (i, t) in enumerate(order):
        half = len(t) // 2
        want.append((i, hashlib.sha256((t[: len(t) - half] + order[(n + 1) % len(order)][1][:half]).encode()).hexdigest()))
    assert got == sorted(want)


def test_order_matters(spark):
    t = " ".join(f"w{i}" for i in range(100))
    turned = " ".join(t.split()[50:] + t.split()[:50])
    df = spark.createDataFrame([(t, turned)], "a string, b string")
    same, moved = df.select(order_minhash.likeness(order_minhash.signatures(F.col("a")), order_minhash.signatures(F.col("a"))), order_minhash.likeness(order_minhash.signatures(F.col("a")), order_minhash.signatures(F.col("b")))).first()
    assert same == 1.0 and 0.2 < moved < 0.9


def brute_order_signatures(spark, texts):
    """The two least k-mers of every signature over all rounds, written out with Spark's hashes of single values."""
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def chain(*values):
        seed = 42
        for v, size in values:
            data = v if size == 0 else v.to_bytes(size, "little", signed=True)
            seed = xxhash.xxh64_intdigest(data, seed)
        return signed(seed)

    out = []
    for t in texts:
        w = (t or "").split()
        keys = [chain(*[(x.encode(), 0) for x in w[i : i + 2]]) >> 30 for i in range(max(1, len(w) - 1))] if w else []
        seen, ks = {}, []
        for at, k in enumerate(keys):
            nth = seen[k] = seen.get(k, -1) + 1
            ks.append((chain((k, 8), (nth, 4)) >> 30, at))
        ks.sort()
        best = [[] for _ in range(64)]
        for i, (k, _) in enumerate(ks):
            first = {}
            for r in range(64):
                h = chain((k, 8), (r, 4))
                first.setdefault((h >> 58) + 32, (r, h >> 30 & (1 << 21) - 1, i))
            for j in range(64):
                best[j].append(first.get(j, (64, chain((k, 8), (64 + j, 4)) >> 30 & (1 << 21) - 1, i)))
        sig = []
        for j in range(64) if ks else ():
            two = sorted((ks[i] for _, _, i in sorted(best[j])[:2]), key=lambda x: x[1])
            sig.append((j - 32 << 32) | (chain(*[(k, 8) for k, _ in two]) & 0xFFFFFFFF))
        out.append(sig)
    return out


def test_order_signatures_equal_brute_force(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "b", "ç", "dd"]) for _ in range(n)) for n in (0, 1, 2, 3, 4, 9, 16, 40, 120, 500, 1200)] + [None, "x\n y\tz ", "same same same same"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [r["s"] for r in df.select("i", order_minhash.order_signatures(F.col("text")).alias("s")).orderBy("i").collect()]
    assert got == brute_order_signatures(spark, texts)


@pytest.mark.parametrize("words", [20, 40, 64, 128])
def test_order_counts_in_short_texts(spark, words):
    rows = []
    for k in range(40):
        w = [f"w{k}_{i}" for i in range(words)]
        q = words // 4
        rows.append((k, " ".join(w), " ".join(w[3 * q :] + w[2 * q : 3 * q] + w[q : 2 * q] + w[:q])))
    df = spark.createDataFrame(rows, "doc_id long, a string, b string")
    sig = lambda c: order_minhash.compare_edited(df.select("doc_id", F.col(c).alias("text"))).select("doc_id", F.col("fingerprint").alias(c))
    cut = lambda s: [s[i : i + 10] for i in range(0, len(s), 10)]
    got = [np.mean([x == y for x, y in zip(cut(r["a"]), cut(r["b"]), strict=True)]) for r in sig("a").join(sig("b"), "doc_id").collect()]
    print(words, np.mean(got))
    # pairs within a quarter keep their order, those of different quarters do not
    assert len(got) == 40 and 0.02 < np.mean(got) < 0.28
