"""URL filter: rules first, gradient-boosted trees on lexical features for the urls that no rule fits.

A rule (host, path, verdict) fits its host and all subdomains if the url's path starts with the rule's; the
longest rule wins (host and path together; equally long ones by text). Rules are configuration: they become one
literal in the plan, looked up by each of the host's suffixes.

The trees see lengths of url, host and path and query, depth, labels, hyphens, digit ratios, character entropy,
parameter counts, longest path part, and statistics of the host's suffix (its last two labels): the smoothed rate of
blocked urls and the number of urls, counted over all distinct labelled urls. They are trained on labelled urls:
a table (url, blocked) given by the caller, of which at most `bound` (parameter, 6000, the lowest by a hash) are
used, together with `examples` made-up ones (parameter, 2000) of two kinds: short readable addresses of pages, and
addresses stuffed with digits, parameters and hyphenated host names. The suffix statistics that a training url
sees are cross-fitted: those of the other `FOLDS` - 1 folds, so no url's own label is among its features; made-up urls are
in no statistic. Everything is SQL expressions and Spark ML.

Defined results: a null url or one without "://" has host and path empty, and the verdict of the trees for an
empty url; repeated rows each get a row, and urls train and count once (labelled both ways: as blocked); without
labelled urls the made-up ones train alone; very long urls are read whole; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.sources.tables import cut, drop

#: (rule as host + path, verdict)
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
NAMES = ["url_size", "host_size", "path_size", "query_size", "depth", "labels", "hyphens", "digits", "path_digits", "entropy", "parameters", "longest", "suffix_blocked", "suffix_known"]
FOLDS = 5
#: Suffix statistics (some 60 bytes each) are broadcast up to this many; beyond, the join shuffles urls by suffix.
BROADCAST_SUFFIXES = 500_000


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def _rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct<rule, verdict> of the longest fitting rule, or null."""
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        by_host.setdefault(h.lower(), []).append((slash + p, rule, verdict))
    if not by_host:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    entries = F.create_map(*[x for h, found in by_host.items() for x in (F.lit(h), F.array(*[F.struct(F.lit(p).alias("path"), F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for p, r, v in found]))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(entries, s), F.array().cast("array<struct<path:string,rule:string,verdict:string>>"))))
    fits = F.filter(found, lambda r: F.startswith(path, r["path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def _with_suffix(rows: DataFrame, statistics: DataFrame) -> DataFrame:
    """rows with the labelled urls of their host's suffix: `urls` and `blocked_urls`."""
    if statistics.count() <= BROADCAST_SUFFIXES:
        statistics = F.broadcast(statistics)
    return rows.join(statistics, suffix_of(F.col("host")) == F.col("suffix"), "left").drop("suffix")


def _features(rows: DataFrame, overall: float) -> DataFrame:
    """rows need url, host, path, urls, blocked_urls."""
    url = F.coalesce(F.col("url"), F.lit(""))
    chars = F.split(url, "")
    size = F.greatest(F.lit(1), F.length(url)).cast("double")

    def entropy() -> Column:
        count = lambda c: F.size(F.filter(chars, lambda x: x == c)) / size
        return -F.aggregate(F.transform(F.array_distinct(chars), count), F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log2(p)).otherwise(0.0))

    urls = F.coalesce("urls", F.lit(0))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return rows.select(
        *(c for c in rows.columns if c not in ("urls", "blocked_urls")),
        F.length(url).cast("double").alias("url_size"),
        F.length("host").cast("double").alias("host_size"),
        F.length("path").cast("double").alias("path_size"),
        F.length(query).cast("double").alias("query_size"),
        F.regexp_count("path", F.lit("/[^/]")).cast("double").alias("depth"),
        F.size(F.split("host", r"\.")).cast("double").alias("labels"),
        F.regexp_count("host", F.lit("-")).cast("double").alias("hyphens"),
        (F.regexp_count(url, F.lit("[0-9]")) / size).alias("digits"),
        (F.regexp_count("path", F.lit("[0-9]")) / F.greatest(F.lit(1), F.length("path"))).alias("path_digits"),
        entropy().alias("entropy"),
        F.regexp_count(query, F.lit("[^&=]+=")).cast("double").alias("parameters"),
        F.array_max(F.transform(F.split("path", "/"), F.length)).cast("double").alias("longest"),
        ((F.coalesce("blocked_urls", F.lit(0)) + 10 * overall) / (urls + 10)).alias("suffix_blocked"),
        F.log1p(urls).alias("suffix_known"),
    )


def example_urls(spark: SparkSession, examples: int = 2000) -> DataFrame:
    """(url, blocked): made up from hashes, the same on every call."""
    words = F.array(*map(F.lit, "river garden market school travel music health kitchen sports history science energy forest harbor bridge museum".split()))
    bait = F.array(*map(F.lit, "cheap free best win bonus pills casino loan spam click deals cash prize farm bet hot".split()))

    def pick(options: Column, salt: int) -> Column:
        return F.element_at(options, (F.pmod(F.xxhash64("id", F.lit(salt)), F.size(options)) + 1).cast("int"))

    code = F.md5(F.concat(F.lit("url"), F.col("id").cast("string")))
    digits = F.conv(F.substring(code, 1, 12), 16, 10)
    tail = F.array(*map(F.lit, (".com", ".net", ".org", ".info")))
    clean = F.concat(F.lit("https://"), pick(F.array(F.lit("www."), F.lit("blog."), F.lit("")), 1), pick(words, 2), pick(words, 3), pick(tail, 4), F.lit("/"), pick(words, 5), F.lit("/"), F.substring(digits, 1, 3), pick(F.array(F.lit(""), F.lit("/"), F.lit(".html"), F.lit("?page=2&ref=x"), F.lit("#top"), F.lit("?utm_source=feed")), 6))
    junk = F.concat(F.lit("http://"), pick(F.array(F.lit("www."), F.lit("m."), F.lit("")), 1), pick(bait, 2), F.lit("-"), pick(bait, 3), pick(F.array(F.lit(""), F.lit("-24"), F.lit("-now")), 7), pick(tail, 4), F.lit("/"), pick(F.array(F.lit(""), F.concat(pick(bait, 5), F.lit("/"))), 6), F.substring(digits, 1, 10), pick(F.array(F.lit(""), F.concat(F.lit("?id="), digits, F.lit("&aff="), F.substring(code, 5, 12)), F.lit("?page=2&ref=x")), 8))
    blocked = F.pmod(F.xxhash64("id", F.lit(0)), F.lit(2)).cast("int")
    return spark.range(0, examples, 1, 2).select(F.when(blocked == 1, junk).otherwise(clean).alias("url"), blocked.alias("blocked"))


def fit(labelled: DataFrame, bound: int = 6000, examples: int = 2000, rounds: int = 12, depth: int = 4) -> tuple[GBTClassificationModel, DataFrame, float]:
    """(model, suffix statistics, overall rate of blocked) from labelled urls (url, blocked)."""
    spark = labelled.sparkSession
    known = labelled.select("url", F.col("blocked").cast("int").alias("blocked")).where("url is not null and blocked in (0, 1)")
    known = cut(known.groupBy("url").agg(F.max("blocked").alias("blocked")), "url-label")
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS))
    by_fold = cut(known.groupBy(suffix_of(host_of(F.col("url"))).alias("suffix"), fold.alias("fold")).agg(F.count("*").alias("urls"), F.sum("blocked").alias("blocked_urls")), "url-fold")
    statistics = cut(by_fold.groupBy("suffix").agg(F.sum("urls").alias("urls"), F.sum("blocked_urls").alias("blocked_urls")), "url-suffix")
    total = statistics.agg(F.sum("urls").alias("urls"), F.sum("blocked_urls").alias("blocked")).first()
    overall = total["blocked"] / total["urls"] if total["urls"] else 0.5
    some = known.orderBy(F.xxhash64("url"), "url").limit(bound).withColumn("own", fold)
    rows = some.unionByName(example_urls(spark, examples).withColumn("own", F.lit(-1).cast("long")))
    rows = _with_suffix(rows.select("url", "blocked", "own", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), statistics)
    mine = by_fold.select("suffix", "fold", F.col("urls").alias("own_urls"), F.col("blocked_urls").alias("own_blocked"))
    rows = rows.join(mine, (suffix_of(F.col("host")) == F.col("suffix")) & (F.col("own") == F.col("fold")), "left")
    rows = rows.withColumns({"urls": F.col("urls") - F.coalesce("own_urls", F.lit(0)), "blocked_urls": F.col("blocked_urls") - F.coalesce("own_blocked", F.lit(0))})
    data = VectorAssembler(inputCols=NAMES, outputCol="features").transform(_features(rows, overall)).select("features", F.col("blocked").cast("double").alias("label"))
    data = cut(data.coalesce(2), "url-train")
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=3, stepSize=0.2).fit(data)
    drop(known, by_fold, data)
    return model, statistics, overall


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5, **settings) -> DataFrame:
    """page_id, host, path, rule, verdict, score (of the trees; null where a rule decides) for every url.

    Without a table of labelled urls, the urls that rules decide are the labelled ones.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("fit", _rule(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = rows.where("fit is not null").select("url", (F.col("fit.verdict") == "block").cast("int").alias("blocked"))
    model, statistics, overall = fit(labelled, **settings)
    described = VectorAssembler(inputCols=NAMES, outputCol="features").transform(_features(_with_suffix(rows, statistics), overall))
    scored = model.transform(described).withColumn("score", F.round(vector_to_array("probability")[1], 9))
    verdict = F.coalesce("fit.verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("fit").isNull(), F.col("score")).alias("score"))
