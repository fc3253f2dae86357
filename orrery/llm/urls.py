"""URL filter: pattern rules indexed by their rarest literal token.

A rule has a pattern (a regular expression over ``host || path`` or over the lower-cased whole URL), a verdict, and for each
of its alternatives the literal tokens that every URL it fits must contain as whole tokens. Token counts over all URLs choose the
rarest token of each alternative; a URL's tokens fetch the rules filed under them by an equi-join, and only those rules run their expression.

Only DataFrame expressions are used. The rule index is broadcast when it has at most ``BROADCAST_RULES`` rows, else it is
joined by a shuffle, where Spark can split a hot token. Verdicts are worked out once per distinct URL.

Defined cases: very long URLs are judged whole; a null URL, or one without ``://``, has an empty host and path and gets the default verdict; rows keep
their multiplicity; columns called host, path, rule or verdict are replaced, all others are kept; of several fitting
rules the fixed ones beat patterns, then the longest wins, then block beats allow, then the least rule text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Placed, ascii_lower

BROADCAST_RULES = 100_000

#: (host, path, verdict): the fixed rules of the query's contract.
PREFIX_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

#: (pattern over the lower-cased URL, its literal tokens, verdict): what decides where no fixed rule fits. Fixed values.
PATTERN_RULES = (
    (r"^[a-z]+://([^/?#]*\.)?cheap-pills\.", (("cheap", "pills"),), "block"),
    (r"^[a-z]+://([^/?#]*\.)?spam-farm\.", (("spam", "farm"),), "block"),
    (r"^[a-z]+://([^/?#]*\.)?(free|online)-casino\.", (("free", "casino"), ("online", "casino")), "block"),
    (r"^[a-z]+://([^/?#]*\.)?payday-loans?\.", (("payday",),), "block"),
    (r"^[a-z]+://([^/?#]*\.)?replica-watches\.", (("replica", "watches"),), "block"),
    (r"^[a-z]+://([^/?#]*\.)?(porn|xxx)\.", (("porn",), ("xxx",)), "block"),
    (r"^[a-z]+://[^?#]*/wp-login\.php([?#]|$)", (("wp", "login", "php"),), "block"),
    (r"^[a-z]+://[^?#]*/cgi-bin/", (("cgi", "bin"),), "block"),
    (r"[?&]sessionid=[0-9a-f]{16,}", (("sessionid",),), "block"),
)
_RULE_SCHEMA = "rule string, on_url boolean, pattern string, verdict string, fixed boolean, size int, alternatives array<array<string>>"


def host_of(url: Column) -> Column:
    return F.when(F.coalesce(F.contains(url, F.lit("://")), F.lit(False)), ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(F.coalesce(F.contains(url, F.lit("://")), F.lit(False)), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


def compile_rules(spark: SparkSession, prefixes=PREFIX_RULES, patterns=PATTERN_RULES) -> DataFrame:
    """The rule table. Of a prefix rule, a last path piece that may go on in the URL is no whole token."""
    rows = []
    for host, path, verdict in prefixes:
        tokens = re.findall("[a-z0-9]+", host.lower()) + [t.lower() for t in re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)]
        rows.append((host + path, False, rf"^(?:[^/]*\.)?{_quote(host)}{_quote(path)}", verdict, True, len(host + path), [tokens]))
    rows += [(p, True, p, verdict, False, len(p), [list(t) for t in alternatives]) for p, alternatives, verdict in patterns]
    return spark.createDataFrame(rows, _RULE_SCHEMA)


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(ascii_lower(url), "[^a-z0-9]+"), lambda t: t != ""))


def index_rules(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """``rules`` with ``token``: for each alternative of a rule its rarest token over all of ``urls``; one without tokens is refused."""
    each = rules.select("*", F.posexplode_outer("alternatives").alias("alternative", "tokens")).drop("alternatives")
    each = each.select("*", F.explode_outer("tokens").alias("token")).drop("tokens")
    seen = urls.select(F.explode(_tokens(F.col("url"))).alias("token")).join(_sized(each.select("token").distinct()), "token").groupBy("token").count()
    each = each.join(seen, "token", "left")
    order = Window.partitionBy("rule", "verdict", "alternative").orderBy(F.coalesce("count", F.lit(0)), "token")
    bad = F.raise_error(F.lit("a rule needs a literal token"))
    filed = each.withColumn("at", F.row_number().over(order)).where("at = 1").withColumn("token", F.coalesce("token", bad.cast("string")))
    return filed.drop("at", "count", "alternative").distinct()


def _sized(rules: DataFrame) -> DataFrame:
    return F.broadcast(rules) if rules.count() <= BROADCAST_RULES else rules


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` (any columns, with ``url``) plus host, path, rule (of fixed rules, else null) and verdict."""
    placed = Placed(pages, ["host", "path", "rule", "verdict"])
    urls = pages.select("url").where("url is not null").distinct()
    index = index_rules(rules, urls)
    url = F.col("url")
    fetched = urls.select("url", F.explode(_tokens(url)).alias("token")).join(_sized(index), "token")
    target = F.when(F.col("on_url"), ascii_lower(url)).otherwise(F.concat(host_of(url), path_of(url)))
    fits = fetched.where(F.rlike(target, F.col("pattern")) & F.contains(url, F.lit("://")))
    rank = F.struct(F.col("fixed").cast("int"), "size", (F.col("verdict") == "block").cast("int"))
    best = fits.groupBy("url").agg(F.max(F.struct(rank.alias("rank"), "rule", "verdict", "fixed")).alias("b"))
    best = best.select(F.col("url").alias("_url"), "b")
    # null URLs fit nothing, and would all meet in one task
    url = F.col(placed.at("url"))
    out = placed.rows.where(url.isNotNull()).join(best, url == F.col("_url"), "left")
    out = out.unionByName(placed.rows.where(url.isNull()), allowMissingColumns=True)
    return out.select(*placed.columns(), host_of(url).alias("host"), path_of(url).alias("path"),
                      F.when(F.col("b.fixed"), F.col("b.rule")).alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
