"""Secret scans with a random forest that removes false positives, in DataFrame functions alone.

Candidates are runs of the characters of keys and tokens, in whole texts: runs of ``LONG`` or more; of
8 or more where the run mixes digits and letters; and of 6 or more right after an equals sign, or after
``=`` or ``:`` and a quote, where a value may hold any characters but blanks and quotes. Shorter runs, and
runs of letters that nothing assigns, are the words texts are made of.

A candidate is told by its length, its character transitions (how often neighbouring characters
change between digits, cases and signs, and how often consonants and vowels alternate), dictionary
coverage (the share of its letters inside the ``DICTIONARY`` most frequent words of the corpus, and the
share of its runs of letters that are words of the corpus, looked up by a join among all words of 3 to
12 letters counted twice or more, which grow with the corpus), its path, and the words before, after and
inside it. Where a candidate starts with a name and ``=``, as in settings of an environment, the name
counts as words before it and the shape is that of the value.

What words say is learned from the labelled findings: a word at a place (before, after, inside, path)
weighs the log of its share among secrets over its share among others, and a feature is the sum over the
words of a place. In training each half of the findings is told by the weights of the other half, so that
no finding's own label stands in its features. The ``ODDS`` words that tell most are kept.

The forest is grown from the findings by grouped sums: features are cut into bins at
quantiles; for every level one aggregation counts weight and labels per tree, node, feature and
bin, and the best cut of each node, among features drawn for it, has the least Gini impurity. Rows
are drawn for a tree with Poisson weights from a hash. A grown forest is a few hundred cuts, which
become one SQL expression.

Findings to learn from are an argument. No table at hand holds any, so by default they are made by rule:
a fixed number of texts, searched like any other (see ``made_findings``). What a scan then knows of
formats and of words around them is what those rules state; real findings are to be preferred.

Null texts have no candidates; null paths are empty. Texts without candidates give no row. Equal
texts give equal verdicts, and repeated rows are told one by one. Without findings of both labels every
candidate scores the share of label 1. Empty tables give empty tables. Columns of the documents named
like a result (``RESULTS``) are replaced; all others stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import materialise

LONG = 16
_RUN = r"A-Za-z0-9+/_=.\-"
#: fixed forms: a quoted value that is assigned, a long run, an assigned run, a run of digits and letters
CANDIDATE = "|".join(
    [
        r"(?<=[=:]\s?[\"'`])[^\s\"'`]{6,}(?=[\"'`])",
        rf"(?<![{_RUN}])[{_RUN}]{{{LONG},}}",
        r"(?<==\s?)[A-Za-z0-9+/_.\-][A-Za-z0-9+/_=.\-]{5,}",
        rf"(?<![{_RUN}])(?=[A-Za-z+/_=.\-]*+[0-9])(?=[0-9+/_=.\-]*+[A-Za-z])[{_RUN}]{{8,}}",
    ]
)
NAMED = r"^([A-Za-z_][A-Za-z0-9_.\-]*)=(?=[^=])"
CONTEXT = 48
DICTIONARY = 512
ODDS, MIN_TIMES, NEAR = 128, 8, 4
TREES, DEPTH, BINS, DRAWN, MIN_LEAF = 16, 6, 16, 5, 4
MADE = 8192
KEEP = 0.5
PLACES = ["before", "after", "inside", "path"]
SHAPES = ["length", "digit_turns", "case_turns", "sign_turns", "vowel_turns", "digits", "coverage", "known", "distinct", "assigned", "quoted"]
FEATURES = [*SHAPES, *[f"{p}_odds" for p in PLACES]]
RESULTS = ["nth", "candidate", "before", "after", "start", "path", "score", "is_secret"]


def _candidates(docs: DataFrame, text_col: str, path_col: str | None) -> tuple[DataFrame, list[Column]]:
    """(doc, path, nth, candidate, before, after, start), and the columns of the documents out of ``doc``.

    Columns of the documents may have any names: they travel within one struct.
    """
    text = F.col(f"`{text_col}`").cast("string")
    kept = [c for c in docs.columns if c != text_col and c not in RESULTS]
    path = F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")) if path_col else F.lit("")
    doc = F.struct(F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    some = docs.where(text.rlike(CANDIDATE)).select(doc.alias("doc"), path.alias("path"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split(text, CANDIDATE, -1).alias("between"))
    n = F.size("found")
    zipped = F.arrays_zip(F.col("found").alias("c"), F.slice("between", F.lit(1), n).alias("b"), F.slice("between", F.lit(2), n).alias("a"))
    each = some.select("doc", "path", F.posexplode(zipped).alias("nth", "x"))
    each = each.select("doc", "path", "nth", F.col("x.c").alias("candidate"), F.length("x.b").cast("long").alias("skip"), F.substring("x.b", -CONTEXT, CONTEXT).alias("before"), F.substring("x.a", 1, CONTEXT).alias("after"))
    upto = Window.partitionBy("doc.row").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.col("skip") + F.length("candidate")).over(upto) - F.length("candidate")
    return each.withColumn("start", start).drop("skip"), [F.col(f"doc.c{i}").alias(c) for i, c in enumerate(kept)]


def candidates(docs: DataFrame, text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """Every candidate with the columns of its document (but the text), as ``nth``, ``start`` and texts."""
    found, rest = _candidates(docs, text_col, path_col)
    return found.select(*rest, "path", "nth", "candidate", "before", "after", "start")


def _runs(text: Column) -> Column:
    """Its runs of letters, lower-cased, cut at signs, digits and where a small letter meets a capital."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, "(?<=[a-z])(?=[A-Z])", " ")), "[^a-z]+"), lambda w: w != "")


def _value() -> Column:
    return F.regexp_replace("candidate", NAMED, "")


def _words(place: str) -> Column:
    """The words at a place, the nearest first; what the cut of the text may have halved is no word."""
    if place == "before":
        whole = F.when(F.length("before") < CONTEXT, F.col("before")).otherwise(F.regexp_replace("before", "^[A-Za-z]+", ""))
        return F.slice(F.reverse(_runs(F.concat(whole, F.lit(" "), F.regexp_extract("candidate", NAMED, 1)))), 1, NEAR)
    if place == "after":
        whole = F.when(F.length("after") < CONTEXT, F.col("after")).otherwise(F.regexp_replace("after", "[A-Za-z]+$", ""))
        return F.slice(_runs(whole), 1, NEAR)
    if place == "inside":
        return F.filter(F.array_distinct(_runs(_value())), lambda w: F.length(w) >= 3)
    return F.array_distinct(_runs(F.col("path")))


class Dictionary:
    """``counts``: (w, n) of all words of 3 to 12 letters that occur twice, ``top`` the most frequent.

    Letters next to a digit or an underscore are no word: else the parts of keys would be.
    """

    def __init__(self, docs: DataFrame, text_col: str = "text", size: int = DICTIONARY):
        word = F.explode(F.regexp_extract_all(F.lower(F.col(f"`{text_col}`").cast("string")), F.lit(r"(?<![a-z0-9_])[a-z]{3,12}(?![a-z0-9_])"), F.lit(0)))
        self.counts = materialise(docs.select(word.alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "words")
        self.top = [r["w"] for r in self.counts.orderBy(F.desc("n"), "w").limit(size).collect()]

    def look_up(self, found: DataFrame) -> DataFrame:
        """``found``, written, with ``known``: the share of a candidate's letters in runs that are words of the corpus.

        Different candidates are looked up once, and met again by a join of two written tables, whose
        large partitions Spark can split where one candidate holds many rows.
        """
        found = materialise(found, "found")
        runs = found.select("candidate").distinct().select("candidate", F.explode(_words("inside")).alias("w"))
        told = runs.join(self.counts.select("w", F.lit(1).alias("there")), "w", "left").groupBy("candidate").agg((F.sum(F.length("w") * F.coalesce("there", F.lit(0))) / F.sum(F.length("w"))).alias("known"))
        told = materialise(told.where("known > 0").select(F.col("candidate").alias("of"), "known"), "known")
        return found.join(told, F.col("candidate") == F.col("of"), "left").drop("of").withColumn("known", F.coalesce("known", F.lit(0.0)))

    def shapes(self) -> dict[str, Column]:
        """Features of (candidate, before, after, known) that need no labels."""
        named = F.regexp_extract("candidate", NAMED, 1) != ""
        c = _value()
        n = F.length(c)
        between = F.greatest(n - 1, F.lit(1))
        turns = lambda a, b: F.regexp_count(c, F.lit(f"(?<=[{a}])(?=[{b}])|(?<=[{b}])(?=[{a}])")) / between
        letters = F.lower(F.regexp_replace(c, "[^A-Za-z]+", " "))
        # longest words first, so that what a word covers is not cut by a shorter one
        longest = sorted(self.top, key=lambda w: (-len(w), w))
        inside = F.aggregate(F.array(*[F.lit(w) for w in longest]), letters, lambda left, w: F.replace(left, w, F.lit("#"))) if longest else letters
        open_ = F.length(F.regexp_replace(inside, "[^a-z]", ""))
        all_ = F.length(F.regexp_replace(letters, "[^a-z]", ""))
        return {
            "length": F.least(n, F.lit(200)),
            "digit_turns": turns("0-9", "A-Za-z"),
            "case_turns": turns("a-z", "A-Z"),
            "sign_turns": turns(r"+/_=.\-", "A-Za-z0-9"),
            "vowel_turns": turns("aeiouAEIOU", "b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z"),
            "digits": F.regexp_count(c, F.lit("[0-9]")) / n,
            "coverage": F.when(all_ == 0, F.lit(0.0)).otherwise((all_ - open_) / all_),
            "known": F.col("known"),
            "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
            "assigned": (named | F.col("before").rlike(r"[=:]\s*[\"'`]?$")).cast("int"),
            "quoted": (F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")).cast("int"),
        }


class Odds:
    """What words at their places say: log of the share among secrets over that among others."""

    def __init__(self, findings: DataFrame):
        named = lambda place: F.transform(_words(place), lambda w: F.concat(F.lit(f"{place}:"), w))
        each = findings.select("label", F.explode(F.concat(*map(named, PLACES))).alias("w"))
        sums = findings.agg(F.sum("label").alias("y"), F.count(F.lit(1)).alias("n")).first()
        y, n = sums["y"] or 0, sums["n"]
        told = each.groupBy("w").agg(F.sum("label").alias("y"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_TIMES)
        odds = F.log((F.col("y") + 0.5) / (y + 1)) - F.log((F.col("n") - F.col("y") + 0.5) / (n - y + 1))
        rows = told.select("w", "n", odds.alias("odds")).orderBy(F.desc(F.abs("odds") * F.sqrt("n")), "w").limit(ODDS).collect()
        self.of: dict[str, dict[str, float]] = {p: {} for p in PLACES}
        for r in rows:
            place, _, word = r["w"].partition(":")
            self.of[place][word] = float(r["odds"])

    def feature(self, place: str) -> Column:
        weights = self.of[place]
        if not weights:
            return F.lit(0.0)
        table = F.map_from_arrays(F.array(*[F.lit(w) for w in weights]), F.array(*[F.lit(x) for x in weights.values()]))
        return F.aggregate(F.transform(_words(place), lambda w: F.coalesce(F.try_element_at(table, w), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def features(shapes: dict[str, Column], odds: dict[str, Column]) -> Column:
    """A struct of all features, each a double."""
    made = {**shapes, **{f"{p}_odds": odds[p] for p in PLACES}}
    return F.struct(*[made[f].cast("double").alias(f) for f in FEATURES])


def made_findings(spark: SparkSession, words: list[str], n: int = MADE) -> DataFrame:
    """Candidates of texts made by rule from hashes of 0 to n-1: (candidate, before, after, path, label).

    Half of the texts hold a key: of public formats, random hex, base64 or a password; announced,
    assigned to a name or without a word on it. The others hold long words, ids, addresses, checksums, numbers,
    plain values and placeholders, some of them announced or assigned as well. Candidates
    of a text other than what it was made around are left out.
    """
    i = F.col("id")
    u = lambda salt, m: F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(m)).cast("int")
    pick = lambda salt, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), u(salt, len(xs)) + 1)
    hexes = F.sha2(F.concat(i.cast("string"), F.lit("k")), 512)
    base = F.regexp_replace(F.base64(F.unhex(hexes)), "[\\r\\n]", "")
    some = words or ["words", "other", "letter", "thing"]
    word = lambda salt: pick(salt, some)
    plain = F.concat(*[word(20 + k) for k in range(9)])
    secret = [
        F.substring(hexes, 1, 40), F.substring(hexes, 1, 32), F.substring(hexes, 1, 64), F.upper(F.substring(hexes, 1, 40)),
        F.substring(base, 1, 40), F.substring(base, 1, 24), F.concat(F.lit("AKIA"), F.upper(F.translate(F.substring(base, 1, 16), "+/=", "XYZ"))),
        F.concat(F.lit("ghp_"), F.translate(F.substring(base, 1, 36), "+/=", "abc")), F.concat(F.lit("sk-"), F.translate(F.substring(base, 1, 48), "+/=", "abc")),
        F.concat(F.initcap(word(14)), F.substring(hexes, 1, 3), F.translate(F.substring(hexes, 4, 1), "0123456789abcdef", "!$%&*!$%&*!$%&*!"), word(15)), F.concat(F.substring(base, 1, 9), F.lit("7k")),
    ]
    harmless = [
        F.substring(plain, F.lit(1), 16 + u(3, 14)), F.initcap(F.substring(plain, F.lit(1), 16 + u(3, 14))), F.upper(F.substring(plain, F.lit(1), 16 + u(3, 14))),
        F.concat(F.substring(plain, F.lit(1), 16 + u(3, 10)), F.lit(".")),
        F.concat(F.lit("mail"), u(4, 10).cast("string"), F.lit(".example.com")), F.concat_ws("/", word(31), word(32), word(33), word(34), word(35)),
        F.concat_ws("-", *[F.substring(hexes, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]),
        F.repeat(pick(5, ["x", "0", "-", "=", "_", "."]), 24), F.lit("YOUR_API_KEY_HERE_EXAMPLE"), F.concat_ws("_", word(31), word(32), word(33), word(34)),
        F.concat(word(16), word(17), F.lit("."), u(18, 90).cast("string"), F.lit("@mail.example.com")), F.translate(F.substring(hexes, 1, 16), "abcdef", "012345"), F.concat(word(16), F.lit("_"), word(17), u(18, 9).cast("string")), F.concat(F.lit("v"), u(18, 9).cast("string"), F.lit("."), u(19, 20).cast("string"), F.lit(".0-"), word(16)),
        F.substring(hexes, 1, 40), F.substring(hexes, 1, 64),
    ]
    label = F.pmod(i, F.lit(2)) == 1
    choose = lambda xs, at: F.element_at(F.array(*xs), at + 1)
    kind = u(1, len(secret))
    not_kind = u(2, len(harmless))
    digest = not_kind >= len(harmless) - 2
    announced = pick(7, ["token = \"", "secret: ", "api_key: \"", "password = '", "Authorization: Bearer ", "access_key = \"", "TOKEN = \"", "auth_token: \"", "client_key = \"", "secret key "])
    assigned = pick(7, ["API_KEY=", "export SECRET=", "AWS_SECRET_ACCESS_KEY=", "GITHUB_TOKEN=", "DB_PASSWORD=", "auth_token=", "CLIENT_KEY=", "api-key="])
    settings = pick(7, ["DATABASE_NAME=", "export HOME_PAGE=", "LOG_LEVEL=", "title=", "IMAGE_TAG=", "APP_REGION="])
    silent = pick(11, [" ", ", ", "\n", "(", ". ", "| ", "= ", ": ", " \"", "id "])
    digests = pick(7, ["commit ", "sha1: ", "sha256:", "checksum = ", "revision ", "md5 = \"", "integrity: ", "GIT_COMMIT=", "SHA256="])
    # keys: a third each announced, assigned and alone; of the others, half stand alone
    before1 = choose([announced, assigned, silent], u(12, 3))
    before0 = F.when(digest, digests).otherwise(choose([silent, silent, silent, settings, announced, assigned], u(12, 6)))
    before = F.concat(word(6), F.lit(" "), F.when(label, before1).otherwise(before0))
    after = F.concat(pick(8, ["\"", " ", "'", "\n", ","]), F.lit(" "), word(9))
    path = F.when(label | (u(13, 2) == 0), pick(10, ["src/app/settings.py", "config/prod.env", "deploy/values.yaml", "src1", "src7"])).otherwise(pick(10, ["tests/data/sample.txt", "docs/guide.md", "src/app/page.txt", "src3", "src9"]))
    # a password alone is a word: it is announced or assigned
    password = kind >= len(secret) - 2
    before1 = F.when(password & (u(12, 3) == 2), choose([announced, assigned], u(22, 2))).otherwise(before1)
    before = F.concat(word(6), F.lit(" "), F.when(label, before1).otherwise(before0))
    core = F.when(label, choose(secret, kind)).otherwise(choose(harmless, not_kind))
    texts = spark.range(n).select(F.concat(before, core, after).alias("text"), path.alias("made_path"), label.cast("int").alias("label"), core.alias("core"))
    found, rest = _candidates(texts, "text", "made_path")
    around = F.contains("candidate", "core") | (F.contains("core", "candidate") & ~F.col("label").cast("boolean"))
    return found.select("candidate", "before", "after", "path", *rest).where(around).select("candidate", "before", "after", "path", "label")


class Forest:
    """Trees as nested cuts: (feature, value, low, high), or the probability of a leaf; and the words' odds."""

    def __init__(self, trees: list, odds: Odds | None = None):
        self.trees, self.odds = trees, odds

    def score(self, of: str = "f") -> Column:
        """The mean of the trees over a struct of features."""

        def walk(t) -> Column:
            if isinstance(t, float):
                return F.lit(t)
            feature, value, low, high = t
            return F.when(F.col(f"{of}.{feature}") <= value, walk(low)).otherwise(walk(high))

        return sum((walk(t) for t in self.trees[1:]), walk(self.trees[0])) / float(len(self.trees))


def grow(findings: DataFrame, words: Dictionary, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """A forest of the labelled findings; null labels and candidates are left out."""
    given = findings.where(F.col("label").isin(0, 1) & F.col("candidate").isNotNull()).fillna("", ["before", "after", "path"]).select("candidate", "before", "after", "path", "label")
    given = materialise(words.look_up(given).withColumn("half", F.pmod(F.xxhash64("candidate", "before", "after", "path"), F.lit(2))), "findings")
    share = given.agg(F.avg("label")).first()[0]
    if share is None or share in (0.0, 1.0):
        return Forest([float(0.5 if share is None else share)])
    halves, all_odds = [Odds(given.where(F.col("half") == h)) for h in (0, 1)], Odds(given)
    other = {p: F.when(F.col("half") == 0, halves[1].feature(p)).otherwise(halves[0].feature(p)) for p in PLACES}
    rows = materialise(given.select("candidate", "before", "after", "path", "label", features(words.shapes(), other).alias("f")), "features")
    cuts = rows.agg(*[F.percentile_approx(f"f.{f}", [k / BINS for k in range(1, BINS)], 1000).alias(f) for f in FEATURES]).first()
    values = {f: sorted(set(cuts[f])) for f in FEATURES}
    below = lambda f: F.size(F.filter(F.array(*[F.lit(float(v)) for v in values[f]]), lambda v: v < F.col(f"f.{f}")))
    rows = rows.select(F.xxhash64("candidate", "before", "after", "path", "label").alias("key"), "label", F.array(*[below(f).cast("int") for f in FEATURES]).alias("bins"))
    draw = F.pmod(F.xxhash64("key", "tree"), F.lit(10_000)) / 10_000
    poisson = F.when(draw < 0.3679, 0).when(draw < 0.7358, 1).when(draw < 0.9197, 2).when(draw < 0.981, 3).otherwise(4)
    at = rows.select("key", "label", "bins", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).withColumn("w", poisson).where("w > 0")
    at = materialise(at.withColumn("node", F.lit(1)), "forest")
    split: dict[tuple[int, int], tuple[int, int]] = {}
    leaf: dict[tuple[int, int], float] = {}
    for level in range(depth + 1):
        for r in at.groupBy("tree", "node").agg((F.sum(F.col("w") * F.col("label")) + share).alias("y"), (F.sum("w") + 1).alias("n")).collect():
            leaf[r["tree"], r["node"]] = float(r["y"] / r["n"])
        if level == depth:
            break
        counts = at.select("tree", "node", "w", "label", F.posexplode("bins").alias("feature", "bin")).groupBy("tree", "node", "feature", "bin").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("label")).alias("y"))
        drawn = F.row_number().over(Window.partitionBy("tree", "node").orderBy(F.xxhash64("tree", "node", "feature"), "feature"))
        allowed = counts.select("tree", "node", "feature").distinct().withColumn("d", drawn).where(F.col("d") <= DRAWN).drop("d")
        counts = counts.join(allowed, ["tree", "node", "feature"])
        upto = Window.partitionBy("tree", "node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy("tree", "node", "feature")
        sums = counts.select("tree", "node", "feature", "bin", F.sum("n").over(upto).alias("n0"), F.sum("y").over(upto).alias("y0"), F.sum("n").over(whole).alias("n"), F.sum("y").over(whole).alias("y"))
        gini = lambda y, n: y * (n - y) / n
        gain = gini(F.col("y"), F.col("n")) - gini(F.col("y0"), F.col("n0")) - gini(F.col("y") - F.col("y0"), F.col("n") - F.col("n0"))
        good = sums.where((F.col("n0") >= MIN_LEAF) & (F.col("n") - F.col("n0") >= MIN_LEAF)).withColumn("gain", gain).where("gain > 1e-9")
        best = good.groupBy("tree", "node").agg(F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))).alias("s")).select("tree", "node", (-F.col("s.f")).alias("feature"), (-F.col("s.b")).alias("cut"))
        best = materialise(best, "cuts")
        for r in best.collect():
            split[r["tree"], r["node"]] = (r["feature"], r["cut"])
        down = F.col("node") * 2 + (F.get("bins", "feature") > F.col("cut")).cast("int")
        at = materialise(at.join(best, ["tree", "node"]).select("key", "label", "bins", "tree", "w", down.alias("node")), "forest", drop=at)

    def build(tree: int, node: int):
        if (tree, node) not in split:
            return leaf.get((tree, node), leaf.get((tree, node // 2), share))
        feature, cut = split[tree, node]
        name = FEATURES[feature]
        return (name, float(values[name][cut]), build(tree, 2 * node), build(tree, 2 * node + 1))

    return Forest([build(t, 1) for t in range(trees)], all_odds)


def scan(docs: DataFrame, text_col: str = "text", path_col: str | None = None, findings: DataFrame | None = None) -> DataFrame:
    """Every candidate of every text with its ``score`` and whether it ``is_secret``."""
    words = Dictionary(docs, text_col)
    forest = grow(findings if findings is not None else made_findings(docs.sparkSession, words.top), words)
    found, rest = _candidates(docs, text_col, path_col)
    told = words.look_up(found)
    odds = {p: forest.odds.feature(p) if forest.odds else F.lit(0.0) for p in PLACES}
    told = told.withColumn("f", features(words.shapes(), odds)).withColumn("score", forest.score())
    return told.select(*rest, "path", "nth", "candidate", "before", "after", "start", "score", (F.col("score") >= KEEP).alias("is_secret"))
