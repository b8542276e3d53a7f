"""URL filters: allow and block rules by host and path, and gradient-boosted trees on lexical features for the rest.

The trees are trained from a small labelled table of URLs (labelled_urls(), some thousand rows made by rule; pass another
table of url and spam to replace it) and applied as columns. Features: length, depth, digit ratio, entropy of the host's
characters, parameter counts, hyphens, and two statistics of the labelled URLs, both smoothed: the share of spam among
those of a host's suffix, and the largest such share of a word in the host. Work per URL is one projection; nothing is shuffled but the labelled table.

Defined results: a null URL or one without :// has empty host and path, fits no rule and is judged by the trees on its
(empty) parts; a rule fits only if the path starts with the rule's path, so an empty path fits none; ties between rules
cannot occur, since two rules of one length that fit are the same; repeated rows are judged one by one; extra columns are
not read. If the labelled table has one class only, that class is the verdict of every URL without rule.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (verdict, rule); a rule is a host and a path prefix.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

FEATURES = ("url_length", "host_length", "path_depth", "host_labels", "digit_ratio", "host_entropy", "n_params", "query_length", "n_hyphens", "has_fragment", "suffix_spam", "word_spam")


@dataclass(frozen=True)
class UrlParams:
    rules: tuple = RULES
    max_iter: int = 10
    max_depth: int = 3
    threshold: float = 0.5
    seed: int = 7


#: Words of the labelled hosts: of plain sites, and of sites that stuff keywords or farm links.
PLAIN_FIRST = ("river", "oak", "north", "stone", "green", "lake", "hill", "city", "open", "royal", "first", "old")
PLAIN_LAST = ("museum", "library", "school", "press", "news", "journal", "weather", "garden", "clinic", "college", "theatre", "council", "farm")
SPAM_FIRST = ("cheap", "best", "free", "win", "fast", "easy", "hot", "spam", "first", "open")
SPAM_LAST = ("pills", "casino", "loans", "bonus", "prize", "replica", "watches", "deals", "diet", "links", "farm", "offers")
PLAIN_SUFFIXES = ("com", "org", "net", "edu", "gov", "co.uk", "ac.uk", "de", "fr", "es", "io", "com", "org")
SPAM_SUFFIXES = ("com", "net", "org", "xyz", "top", "click", "biz", "info", "com", "net", "co.uk")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """A labelled table (host, url, spam) made by rule: plain hosts with and without hyphens against keyword hosts, over many
    suffixes, with paths and queries of either kind on both."""
    each = lambda values: F.explode(F.array(*map(F.lit, values)))
    made = lambda first, last, suffixes, spam: spark.range(1).select(each(first).alias("a"), each(last).alias("b"), F.lit(spam).alias("spam"), F.array(*map(F.lit, suffixes)).alias("suffixes"))
    hosts = made(PLAIN_FIRST, PLAIN_LAST, PLAIN_SUFFIXES, 0).unionByName(made(SPAM_FIRST, SPAM_LAST, SPAM_SUFFIXES, 1))
    k = F.abs(F.xxhash64("a", "b", "spam"))
    pick = lambda values, k: F.get(values if isinstance(values, Column) else F.array(*map(F.lit, values)), (k % (F.size(values) if isinstance(values, Column) else len(values))).cast("int"))
    tail = F.when(F.col("spam") == 1, pick(("", "-4u", "-247", "-88", "-online", ""), F.floor(k / 3))).otherwise(pick(("", "", "", "2", "-online"), F.floor(k / 3)))
    name = F.concat("a", pick(("-", "", "-"), k), "b", tail)
    rows = hosts.select("spam", "suffixes", name.alias("name"), each(range(6)).alias("page"))
    k = F.abs(F.xxhash64("name", "page"))
    rows = rows.withColumn("host", F.concat(pick(("", "www.", "m.", "shop.", "en."), k), "name", F.lit("."), pick(F.col("suffixes"), F.floor(k / 5))))
    path = pick(("/", "", "/articles/2021/05/on-rain-and-rivers", "/wiki/Valley", "/list?sort=up&page=3", "/item.php?id=88412", "/a/b/c/d.html", "/en/about", "/de/7731", "/go?to=home&utm_source=mail&utm_medium=a#b", "/view/20391.html#top"), F.floor(k / 64))
    return rows.select("host", F.concat(pick(("http://", "https://"), F.floor(k / 2)), "host", path).alias("url"), "spam")


def with_parts(df: DataFrame) -> DataFrame:
    """df with _u_host (A-Z lower-cased), _u_path and _u_query."""
    at = F.coalesce(F.locate("://", F.col("url")), F.lit(0))
    rest = F.when(at > 0, F.substr(F.col("url"), at + 3)).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return df.withColumns(
        {
            "_u_host": F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower()),
            "_u_path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
            "_u_query": F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1),
        }
    )


def rule_of(host: Column, path: Column, rules: tuple) -> Column:
    """The longest rule that fits, as a struct of rule and verdict, else null."""
    out = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _suffix(host: Column) -> Column:
    """What a host ends in: its last label, or the last two where a country's second level comes before it."""
    return F.when(host.rlike(r"\.(co|com|org|net|ac|gov|edu)\.[a-z]{2}$"), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def _words(host: Column) -> Column:
    return F.array_distinct(F.split(host, "[^a-z]+"))


def with_features(df: DataFrame, suffixes: dict[str, float], words: dict[str, float], default: float) -> DataFrame:
    """df (with its parts) with one column for each of FEATURES."""
    url, host, path, query = F.coalesce(F.col("url"), F.lit("")), F.col("_u_host"), F.col("_u_path"), F.col("_u_query")
    n = F.greatest(F.length(host), F.lit(1))
    letters = F.array_sort(F.split(host, ""))
    counts = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / n)
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    shares = lambda of: F.from_json(F.lit(json.dumps(of)), "map<string,double>")
    of_words = F.array_max(F.transform(_words(host), lambda w: F.element_at(shares(words), w)))
    return df.withColumns(
        {
            "url_length": F.length(url).cast("double"),
            "host_length": F.length(host).cast("double"),
            "path_depth": count(path, "/[^/]"),
            "host_labels": count(host, r"[^.]+"),
            "digit_ratio": count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
            "host_entropy": -F.aggregate(counts, F.lit(0.0), lambda s, p: s + p * F.log2(p)),
            "n_params": count(query, "[^&=]+="),
            "query_length": F.length(query).cast("double"),
            "n_hyphens": count(host, "-"),
            "has_fragment": url.contains("#").cast("double"),
            "suffix_spam": F.coalesce(F.element_at(shares(suffixes), _suffix(host)), F.lit(default)),
            "word_spam": F.coalesce(of_words, F.lit(default)),
        }
    )


class UrlModel:
    """Boosted trees and statistics fitted on labelled URLs. The labelled table is small by contract: the statistics of its
    most frequent suffixes and host words, at most max_values of either, become part of the plan."""

    def __init__(self, labelled: DataFrame, params: UrlParams = UrlParams(), max_values: int = 200):
        self.params = params
        data = with_parts(labelled.where(F.col("url").isNotNull() & F.col("spam").isNotNull()).select("url", F.col("spam").cast("double")))
        n, bad = data.agg(F.count("*"), F.coalesce(F.sum("spam"), F.lit(0.0))).first()
        self.default = (bad + 1) / (n + 2)

        def shares(value: Column) -> dict[str, float]:
            stats = data.select(value.alias("value"), "spam").groupBy("value").agg(F.sum("spam").alias("bad"), F.count("*").alias("n")).where("value <> ''").orderBy(F.desc("n"), "value").limit(max_values).collect()
            return {r["value"]: (r["bad"] + 4 * self.default) / (r["n"] + 4) for r in stats}

        self.suffixes, self.words = shares(_suffix(F.col("_u_host"))), shares(F.explode(_words(F.col("_u_host"))))
        self.assembler = VectorAssembler(inputCols=[f"_f_{x}" for x in FEATURES], outputCol="_u_features")
        self.only = None if 0 < bad < n else float(bad > 0)
        if self.only is None:
            gbt = GBTClassifier(featuresCol="_u_features", labelCol="spam", maxIter=params.max_iter, maxDepth=params.max_depth, seed=params.seed)
            self.model = gbt.fit(self._assembled(data).coalesce(1))

    def _assembled(self, df: DataFrame) -> DataFrame:
        f = with_features(df, self.suffixes, self.words, self.default)
        return self.assembler.transform(f.withColumnsRenamed({x: f"_f_{x}" for x in FEATURES}))

    def spam_score(self, df: DataFrame) -> DataFrame:
        """df with _u_score, the trees' probability of spam."""
        if self.only is not None:
            return with_parts(df).withColumn("_u_score", F.lit(self.only))
        return self.model.transform(self._assembled(with_parts(df))).withColumn("_u_score", vector_to_array("probability")[1])


def judge(pages: DataFrame, model: UrlModel) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' spam_score: one row for each row of pages."""
    p = model.spam_score(pages.select("page_id", "url"))
    p = p.withColumn("_u_rule", rule_of(F.col("_u_host"), F.col("_u_path"), model.params.rules))
    method = F.when(F.col("_u_score") > model.params.threshold, "block").otherwise("allow")
    return p.select(
        "page_id",
        F.col("_u_host").alias("host"),
        F.col("_u_path").alias("path"),
        F.col("_u_rule.rule").alias("rule"),
        F.coalesce("_u_rule.verdict", method).alias("verdict"),
        F.col("_u_score").alias("spam_score"),
    )
