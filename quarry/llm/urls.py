"""URL filter in DataFrame operations alone: rules first, else logistic regression.

The model is trained on hashed character n-grams of host and path, each bucket counted
once a URL, from a small labelled table of whole URLs; both sides of it, and every page,
go through the same split_url(). Spark's own logistic regression fits it; its weights
(DIMS numbers) then stand in the plan as a literal, and pages are scored by SQL functions.
"""

from __future__ import annotations

import random

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import LOWER, UPPER, column

#: Buckets of hashed n-grams, their length, penalty of weights, its part that is of their absolute values, rounds at most.
DIMS, GRAM, PENALTY, SPARSE, ROUNDS = 4096, 4, 1e-4, 0.5, 80
#: Rows of the labelled table that is made below; rows that a table may have.
LABELLED, MOST_LABELLED = 3000, 10_000
#: Rules of the query: what to do, and the host and path that it is for.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

#: Words of unwanted and of wanted sites, and what both have alike.
BAD_WORDS = (
    "casino poker slots jackpot betting bets bonus roulette lottery porn xxx adult escort cams nude viagra pills pharma diet replica counterfeit loans payday debt scam spam phishing "
    "malware virus trojan warez keygen crack torrent prize winner claim clickbait popup adserver banner ads tracker track doubleclick cheap"
).split()
GOOD_WORDS = (
    "library museum university research science news journal herald weather garden kitchen recipes travel history music theatre school docs wiki forum support store market bank health "
    "clinic sports football software developer github stackoverflow code data report press art photo books reader council city region nature river mountain ocean energy physics maths "
    "language dictionary shop cars homes jobs letters radio film studio archive catalog family kids games mail calendar maps questions spark apache python guide interview article"
).split()
SYLLABLES = [c + v for c in "bcdfghlmnprstvw" for v in "aeiou"] + "th er ing on st an".split()
PREFIXES, MIDDLES = ["", "", "www.", "m.", "blog.", "en."], ["", "", ".example", ".site"]
SUFFIXES = "com net org info co.uk de fr es top xyz".split()
SEGMENTS, ENDS = "en de fr es a p 2021 05".split(), ["", "/", ".html", ".php", "?page=2", "?id=7&ref=x", "#top"]


def make_urls(rows: int = LABELLED, seed: int = 1) -> list[tuple[str, float]]:
    """Labelled URLs (url, bad): hosts and paths vary apart from each other, and a URL is bad if either has a bad word."""
    rng = random.Random(seed)

    def word() -> str:
        return rng.choice(GOOD_WORDS) if rng.random() < 0.6 else "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 4)))

    def name(bad: bool) -> str:
        parts = [rng.choice(BAD_WORDS) if bad else word()]
        if rng.random() < 0.5:
            parts.insert(rng.randint(0, 1), rng.choice(BAD_WORDS) if bad and rng.random() < 0.4 else word())
        return rng.choice(["-", "-", ""]).join(parts)

    def url(bad_host: bool, bad_path: bool) -> str:
        host = rng.choice(PREFIXES) + name(bad_host) + rng.choice(MIDDLES) + "." + rng.choice(SUFFIXES)
        path = [rng.choice([*SEGMENTS, word(), str(rng.randrange(2000))]) for _ in range(rng.randint(0, 3))]
        if bad_path:
            path.insert(rng.randint(0, len(path)), name(True))
        return rng.choice(["http://", "https://"]) + host + "/" * bool(path) + "/".join(path) + rng.choice(ENDS)

    kinds = [(False, False)] * 6 + [(True, False)] * 2 + [(False, True), (True, True)]
    return [(url(*kinds[i % len(kinds)]), float(any(kinds[i % len(kinds)]))) for i in range(rows)]


def labelled_urls(spark: SparkSession, rows: int = LABELLED, seed: int = 1) -> DataFrame:
    """The small labelled table: url, bad."""
    return spark.createDataFrame(make_urls(rows, seed), "url string, bad double")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without "://"."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(size, rule, verdict), or null.

    A rule fits its host and all subdomains, where the path starts with the rule's. Of
    two rules for the same host and path, the block wins.
    """
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    table = F.array(*[
        F.struct(F.lit(len(r)).alias("size"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(r.partition("/")[0]).alias("host"), F.lit("/" + r.partition("/")[2]).alias("path"))
        for v, r in rules
    ])
    fits = F.filter(table, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    top = F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return top


def grams(text: Column, dims: int = DIMS, size: int = GRAM) -> Column:
    """Buckets of the text's n-grams with a mark at either end."""
    letters = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
    letters = F.filter(letters, lambda c: c != "")
    ends = F.sequence(F.lit(0), F.greatest(F.size(letters) - size, F.lit(0)))
    return F.transform(ends, lambda i: F.pmod(F.xxhash64(F.array_join(F.slice(letters, i + 1, size), "")), F.lit(dims)).cast("int"))


def features(host: Column, path: Column, dims: int = DIMS) -> Column:
    """Buckets that host or path have, each once."""
    return F.array_distinct(F.concat(grams(host, dims), grams(path, dims)))


def margin(buckets: Column, weights: Column, bias: float) -> Column:
    """Sum of the buckets' weights by the root of their number, and the bias."""
    return F.aggregate(buckets, F.lit(0.0), lambda acc, j: acc + F.element_at(weights, j + 1)) / F.sqrt(F.size(buckets).cast("double")) + F.lit(bias)


def vectors(labelled: DataFrame, dims: int = DIMS) -> DataFrame:
    """(features, label) of a labelled table (url, bad): unit vectors of the buckets."""
    host, path = split_url(F.col("url"))
    rows = labelled.select(F.transform(features(host, path, dims), lambda j: j.cast("string")).alias("buckets"), F.col("bad").cast("double").alias("label"))
    counted = CountVectorizerModel.from_vocabulary([str(j) for j in range(dims)], "buckets", "counts").setBinary(True).transform(rows)
    return Normalizer(p=2.0, inputCol="counts", outputCol="features").transform(counted).select("features", "label")


def train(labelled: DataFrame, dims: int = DIMS, penalty: float = PENALTY, sparse: float = SPARSE, rounds: int = ROUNDS, rows: int = MOST_LABELLED) -> tuple[list[float], float]:
    """Weights and bias of a logistic regression on a small table (url, bad).

    rows bounds the table: more are refused, since one task trains on all of it.
    """
    if labelled.limit(rows + 1).count() > rows:
        raise ValueError(f"the labelled table has more than {rows} rows")
    model = LogisticRegression(regParam=penalty, elasticNetParam=sparse, maxIter=rounds, standardization=False).fit(vectors(labelled, dims).coalesce(1))
    return model.coefficients.toArray().tolist(), float(model.intercept)


_TRAINED: dict[str, tuple[list[float], float]] = {}


def default_model(spark: SparkSession) -> tuple[list[float], float]:
    """The model of the labelled table above, trained once a session's application."""
    app = spark.sparkContext.applicationId
    if app not in _TRAINED:
        _TRAINED[app] = train(labelled_urls(spark))
    return _TRAINED[app]


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, model: tuple[list[float], float] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of pages: id, host, path, rule, verdict, score.

    The longest fitting rule decides; without one, the model blocks where its probability
    of a bad URL (score) is above one half. Null and strange URLs have empty host and
    path, fit no rule and get the model's verdict on those. A map over rows: nothing is
    shuffled, repeated rows give repeated results, only id and url are read.
    """
    weights, bias = model or default_model(pages.sparkSession)
    host, path = split_url(column(url_col))
    parts = pages.select(column(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    ruled = parts.withColumn("r", best_rule(F.col("host"), F.col("path"), rules))
    z = margin(features(F.col("host"), F.col("path"), len(weights)), F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>"), bias)
    scored = ruled.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
    return scored.select(column(id_col), "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), F.round("score", 6).alias("score"))
