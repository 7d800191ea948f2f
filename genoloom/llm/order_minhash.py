"""Document fingerprints by Order MinHash, in DataFrame functions alone.

The k-mers of a text are its runs of ``K`` words (``WORD`` separated), each numbered by how often it
has occurred so far, so that repeats count. Each of ``BINS`` signatures has a hash function of its own
over all k-mers of the text; the ``TUPLE`` k-mers it makes smallest are put back into text order and
hashed together. Two texts agree in a signature only where the same k-mers are minimal and stand in the
same order: likeness falls with edit distance, not only with the sets of words.

The hash functions are those of fast similarity sketching. In each of ``ROUNDS`` rounds a k-mer is hashed
anew and its hash names one signature; a k-mer's value in a signature is the first round that named it,
then the hash of that round, or after all rounds one more hash for that signature. Values do not
depend on the text, and rounds beyond those in which every signature has met ``TUPLE`` different k-mers
change nothing, so they are left out: about ``POINTS`` hashes or one a k-mer are made for a text, not
``BINS`` a k-mer. A text for which they were too few goes through all rounds.

Likeness is the share of equal signatures. Two texts without
words are alike (1); one without words is like no other (0). A text of fewer than ``K`` words has
one k-mer of all its words. Null texts count as empty. Equal texts have equal fingerprints.

Finding the next document keeps order without sending all rows to one task: rows go to ranges of
ids of about ``RANGE_ROWS`` rows, are put in order within their range, and the last of a range looks
at the first of the next. Equal ids go by text; rows with a null id come first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[\x20\x09-\x0D]+"
K = 2
TUPLE = 2
BIN_BITS = 6
BINS = 1 << BIN_BITS
ROUNDS = 64
POINTS = 14 * BINS  # a signature then lacks k-mers in one of a thousand texts
RANGE_ROWS = 4096
FAN = 256  # ranges are found in two steps of at most so many bounds
SAMPLED = 16  # ids looked at for each range
_AT_BITS = 30  # a text has fewer than 2^30 words
_AT = (1 << _AT_BITS) - 1


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _packed(hash_: Column, at: Column) -> Column:
    return hash_.bitwiseAND(F.lit(~_AT)).bitwiseOR(at)


def _kmers(words: Column) -> Column:
    """Sorted longs: the hash of each k-mer above its position."""
    n = F.size(words)
    many = F.transform(F.slice(words, 1, n - K + 1), lambda w, i: _packed(F.xxhash64(w, *[F.get(words, i + j) for j in range(1, K)]), i))
    few = F.array(_packed(F.xxhash64(F.array_join(words, " ")), F.lit(0)))
    return F.sort_array(F.when(n == 0, F.expr("cast(array() as array<bigint>)")).when(n < K, few).otherwise(many))


def _numbered(kmers: Column) -> Column:
    """Sorted longs: the hash of each k-mer with its occurrence number, above its position."""
    key = lambda i: F.shiftright(F.get(kmers, i), _AT_BITS)
    value = lambda i, nth: _packed(F.xxhash64(key(i), nth), F.get(kmers, i).bitwiseAND(F.lit(_AT)))
    n = F.size(kmers)
    every = F.when(n == 0, F.expr("cast(array() as array<int>)")).otherwise(F.sequence(F.lit(0), n - 1))

    def of_runs(starts: Column) -> Column:
        end = lambda j: F.coalesce(F.get(starts, j + 1), n)
        firsts = F.transform(starts, lambda i: value(i, F.lit(0)))
        repeated = F.filter(F.transform(starts, lambda s, j: F.struct(s.alias("s"), end(j).alias("e"))), lambda r: r["e"] - r["s"] > 1)
        rest = F.flatten(F.transform(repeated, lambda r: F.transform(F.sequence(r["s"] + 1, r["e"] - 1), lambda i: value(i, i - r["s"]))))
        return F.sort_array(F.concat(firsts, rest))

    return _let(F.filter(every, lambda i: (i == 0) | (key(i) != key(i - 1))), of_runs)


def _signatures(numbered: Column) -> Column:
    """For each filled bin, ascending: the bin above 32 bits of the hash of its tuple in text order."""
    bin_ = lambda i: F.shiftright(F.get(numbered, i), 64 - BIN_BITS)
    n = F.size(numbered)
    every = F.when(n == 0, F.expr("cast(array() as array<int>)")).otherwise(F.sequence(F.lit(0), n - 1))
    starts = F.filter(every, lambda i: (i == 0) | (bin_(i) != bin_(i - 1)))

    def signature(i: Column) -> Column:
        own = F.filter(F.slice(numbered, i + 1, TUPLE), lambda x: F.shiftright(x, 64 - BIN_BITS) == bin_(i))
        ordered = F.transform(F.array_sort(F.transform(own, lambda x: F.struct(x.bitwiseAND(F.lit(_AT)).alias("at"), F.shiftright(x, _AT_BITS).alias("h")))), lambda s: s["h"])
        return F.shiftleft(bin_(i), 32).bitwiseOR(F.xxhash64(ordered).bitwiseAND(F.lit(0xFFFFFFFF)))

    return F.transform(starts, signature)


def _numbered_of(text: Column, use: Callable[[Column], Column]) -> Column:
    words = F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), WORD), "")
    return _let(words, lambda w: _let(_kmers(w), lambda k: _let(_numbered(k), use)))


def signatures(text: Column) -> Column:
    """Signatures of one permutation cut into bins, some of a single k-mer: an array of at most BINS longs.

    No query uses them; see ``order_signatures``.
    """
    return _numbered_of(text, _signatures)


_ROUND_BITS = 7  # of the numbers 0 to ROUNDS
_BELOW_BIN = (1 << (64 - BIN_BITS)) - 1
_BELOW_ROUND = (1 << (64 - BIN_BITS - _ROUND_BITS)) - 1


def _points(numbered: Column, rounds: Column) -> Column:
    """Sorted longs: signature, round and hash of each k-mer in each round, above its index."""
    at_round = lambda r: F.shiftleft(r.cast("long"), 64 - BIN_BITS - _ROUND_BITS)

    def point(x: Column, i: Column, r: Column) -> Column:
        h = F.xxhash64(F.shiftright(x, _AT_BITS), r)
        return _packed(h.bitwiseAND(F.lit(_BELOW_ROUND | ~_BELOW_BIN)).bitwiseOR(at_round(r)), i.cast("long"))

    return F.flatten(F.transform(F.sequence(F.lit(0), rounds - 1), lambda r: F.transform(numbered, lambda x, i: point(x, i, r))))


def _last_points(numbered: Column) -> Column:
    """Points of every k-mer in every signature, after all rounds."""

    def point(x: Column, i: Column, j: Column) -> Column:
        h = F.xxhash64(F.shiftright(x, _AT_BITS), j + ROUNDS).bitwiseAND(F.lit(_BELOW_ROUND))
        top = F.shiftleft((j - BINS // 2).cast("long"), 64 - BIN_BITS).bitwiseOR(F.lit(ROUNDS << (64 - BIN_BITS - _ROUND_BITS)))
        return _packed(h.bitwiseOR(top), i.cast("long"))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.transform(numbered, lambda x, i: point(x, i, j))))


def _least(points: Column) -> Column:
    """Of sorted points, for each signature: (bin, first, second), indexes of its two least different k-mers."""
    bin_ = lambda i: F.shiftright(F.get(points, i), 64 - BIN_BITS)
    index = lambda x: x.bitwiseAND(F.lit(_AT))
    every = F.sequence(F.lit(0), F.size(points) - 1)

    def of_runs(starts: Column) -> Column:
        def pair(i: Column, j: Column) -> Column:
            run = F.slice(points, i + 1, F.coalesce(F.get(starts, j + 1), F.size(points)) - i)
            other = F.filter(run, lambda x: index(x) != index(F.get(points, i)))
            return F.struct(bin_(i).alias("bin"), index(F.get(points, i)).cast("int").alias("a"), index(F.get(other, F.lit(0))).cast("int").alias("b"))

        return F.transform(starts, pair)

    return _let(F.filter(every, lambda i: (i == 0) | (bin_(i) != bin_(i - 1))), of_runs)


def _order_signatures(numbered: Column) -> Column:
    n = F.size(numbered)
    rounds = F.least(F.lit(ROUNDS), F.ceil(F.lit(POINTS) / n).cast("int"))
    all_rounds = F.sort_array(F.concat(_points(numbered, F.lit(ROUNDS)), _last_points(numbered)))
    whole = _let(all_rounds, _least)
    enough = lambda pairs: (F.size(pairs) == BINS) & F.forall(pairs, lambda p: p["b"].isNotNull())
    quick = _let(F.sort_array(_points(numbered, rounds)), _least)
    pairs = F.when(n * ROUNDS <= POINTS, whole).otherwise(_let(quick, lambda p: F.when(enough(p), p).otherwise(whole)))
    at = lambda i: F.get(numbered, i).bitwiseAND(F.lit(_AT))
    key = lambda i: F.shiftright(F.get(numbered, i), _AT_BITS)

    def signature(p: Column) -> Column:
        a, b = p["a"], p["b"]
        both = F.when(b.isNull(), F.xxhash64(key(a))).when(at(a) < at(b), F.xxhash64(key(a), key(b))).otherwise(F.xxhash64(key(b), key(a)))
        return F.shiftleft(p["bin"], 32).bitwiseOR(both.bitwiseAND(F.lit(0xFFFFFFFF)))

    none = F.expr("cast(array() as array<bigint>)")
    return F.when(n == 0, none).otherwise(F.transform(pairs, signature))


def order_signatures(text: Column) -> Column:
    """The signatures of a text by Order MinHash: an array of BINS longs, or of none without words."""
    return _numbered_of(text, _order_signatures)


def fingerprint(signatures_: Column) -> Column:
    """The signatures as text: 2 hex digits of the bin and 8 of the hash, for each filled bin."""
    return F.array_join(F.transform(signatures_, lambda s: F.lower(F.lpad(F.hex(s + F.lit(BINS // 2 << 32)), 10, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal signatures among the bins that a or b fills."""
    bins = lambda x: F.transform(x, lambda s: F.shiftright(s, 32))
    filled = F.size(F.array_union(bins(a), bins(b)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def _range_of(id_: Column, docs: DataFrame, id_name: str) -> Column:
    """The range an id falls into, of about RANGE_ROWS rows each; -1 for null.

    Bounds are taken from ids chosen by hash, so ids may be of any type that has an order. Beyond FAN
    x FAN ranges each holds more rows, which are sorted with spilling.
    """
    n = docs.count()
    parts = max(1, min(FAN * FAN, -(-n // RANGE_ROWS)))
    if parts == 1:
        return F.when(id_.isNull(), -1).otherwise(0)
    kind = docs.schema[id_name].dataType.simpleString()
    chosen = docs.where(F.pmod(F.xxhash64(id_name), F.lit(max(1, n // (SAMPLED * parts)))) == 0).where(F.col(id_name).isNotNull()).select(id_name).distinct()
    seen = [r[0] for r in chosen.orderBy(id_name).collect()]
    bounds = list(dict.fromkeys(seen[i * len(seen) // parts] for i in range(1, parts))) if seen else []
    coarse = bounds[FAN - 1 :: FAN]
    fine = [bounds[i : i + FAN - 1] for i in range(0, len(bounds), FAN)] or [[]]
    fine += [[]] * (len(coarse) + 1 - len(fine))
    below = lambda array: F.size(F.filter(array, lambda b: b <= id_))
    literal = lambda xs: F.array(*[F.lit(x).cast(kind) for x in xs]) if xs else F.expr(f"cast(array() as array<{kind}>)")
    first = below(literal(coarse))
    within = below(F.element_at(F.array(*[literal(x) for x in fine]), first + 1))
    return F.when(id_.isNull(), -1).otherwise(first * FAN + within)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, sig, next_text, next_sig): each row with the next in ascending order of the ids."""
    light = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = light.withColumn("range", _range_of(F.col("id"), light.select("id"), "id")).withColumn("sig", order_signatures(F.col("text")))
    # the first row of every range: few, found by their ids
    least = rows.groupBy("range").agg(F.min("id").alias("first_id"))
    after = Window.orderBy("range")
    all_ = after.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("range").over(after), F.max("range").over(all_))
    chain = least.select(F.col("range").alias("first_range"), "first_id", before.alias("to"))
    firsts = rows.select("id", "text", "range").join(F.broadcast(chain), (F.col("range") == F.col("first_range")) & F.col("id").eqNullSafe(F.col("first_id"))).groupBy("to").agg(F.min("text").alias("first_text"))
    firsts = firsts.withColumn("first_sig", order_signatures(F.col("first_text")))
    order = Window.partitionBy("range").orderBy("id", "text")
    led = rows.withColumns({"lead_text": F.lead("text").over(order), "lead_sig": F.lead("sig").over(order)})
    return led.join(firsts, led["range"] == firsts["to"]).select("id", "text", "sig", F.coalesce("lead_text", "first_text").alias("next_text"), F.coalesce("lead_sig", "first_sig").alias("next_sig"))


def edited(text: Column, next_text: Column) -> Column:
    """The text, its last floor(n/2) code points replaced by the first as many of the next."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(next_text, F.lit(1), half))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and likeness to it and to the next text."""
    rows = with_next(docs, id_col, text_col).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select("id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sig", "next_sig", order_signatures(F.col("edited")).alias("edited_sig"))
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("sig")).alias("fingerprint"),
        fingerprint(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
