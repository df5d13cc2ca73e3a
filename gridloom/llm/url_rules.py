"""URL filters: pattern rules, each indexed by its rarest literal token.

A rule is a host and path (``example.com/en/``: that host and its subdomains, paths that begin so) or
a regular expression over ``host + path`` with the literal tokens that every match holds as whole
tokens.  Token counts over all URLs say which token of a rule is the rarest; the rule is filed under
it.  A URL looks up its own tokens and runs the regular expressions of the rules that it finds
there, and of rules without any token, no others.  Of host rules the longest wins over every
pattern; else a blocking pattern decides; else the URL is allowed.

The index is a small table (its size is checked before it is broadcast); equal URLs are judged
once, and the verdicts are joined back to the rows, so a URL with a third of all rows is one key of
a join that Spark may split.

Edge cases: null, or no ``://``: host and path are empty and no rule fits.  Repeated rows, ties and
extra columns stay as they are.  Two host rules of one length cannot both fit a URL.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import LOWER, UPPER, bounded

ALLOW, BLOCK = "allow", "block"

# The host rules of the contract.
HOST_RULES = (("com/", ALLOW), ("example.com/en/", BLOCK), ("www.example.com/en/", ALLOW), ("net/es/", BLOCK), ("net/fr/", BLOCK))

#: Words that mark a host label or path segment as unwanted, by category.
UNWANTED = {
    "gambling": "casino casinos poker bingo bet bets betting jackpot roulette slots lottery",
    "adult": "adult porn porno sex xxx nude erotic escort escorts cams",
    "pharmacy": "pills pill pharmacy viagra cialis meds",
    "spam": "spam linkfarm seo clickbait warez torrent crack keygen",
    "adverts": "ads adserver adservice doubleclick tracking tracker popunder affiliate",
    "loans": "payday loan loans forex",
}


@dataclass(frozen=True)
class Rule:
    """One rule: name, verdict, regular expression over host + path, and the whole tokens of every match."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    host_rule: bool = False


def _tokens(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(re.findall("[0-9a-z]+", text.translate(str.maketrans(UPPER, LOWER)))))


def host_rule(text: str, verdict: str) -> Rule:
    """Rule of a host and path; a last token that the path may continue is no whole token."""
    host, slash, path = text.partition("/")
    whole = host if slash else ""
    whole += "/" + re.sub("[0-9A-Za-z]+$", "", path)
    return Rule(text, verdict, r"^(?:[^/]*\.)?" + re.escape(host) + re.escape(slash + path), _tokens(whole), True)


def default_rules() -> list[Rule]:
    """The contract's host rules and a blocking pattern for each unwanted word."""
    rules = [host_rule(t, v) for t, v in HOST_RULES]
    return rules + [Rule(f"{kind}:{w}", BLOCK, rf"(?:^|[^0-9A-Za-z]){w}(?:[^0-9A-Za-z]|$)", (w,)) for kind, words in UNWANTED.items() for w in words.split()]


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(place: Column) -> Column:
    return F.array_distinct(F.split(F.translate(place, UPPER, LOWER), "[^0-9a-z]+"))


def rule_index(spark: SparkSession, rules: Sequence[Rule], tokens: DataFrame) -> DataFrame:
    """Each rule under its rarest token; ``tokens`` holds the column ``token`` of all URLs.  No token: filed under ''."""
    table = spark.createDataFrame([(r.name, r.verdict, r.pattern, r.host_rule, len(r.name) if r.host_rule else 0, list(r.tokens)) for r in rules], "rule string, verdict string, pattern string, host_rule boolean, length int, tokens array<string>")
    wanted = sorted({t for r in rules for t in r.tokens})
    counts = tokens.join(F.broadcast(spark.createDataFrame([(t,) for t in wanted], "token string")), "token").groupBy("token").agg(F.count("*").alias("n"))
    each = table.withColumn("token", F.explode_outer("tokens")).join(counts, "token", "left")
    rarest = each.groupBy("rule").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    return table.drop("tokens").join(rarest, "rule").withColumn("token", F.coalesce("token", F.lit("")))


def judge(pages: DataFrame, rules: Sequence[Rule] | None = None, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (the host rule that fits, or null), verdict and pattern (the pattern rule that blocks, or null)."""
    spark = pages.sparkSession
    rules = default_rules() if rules is None else list(rules)
    urls = pages.select(F.col(url).alias("_u")).where("_u is not null").distinct()
    urls = urls.withColumn("_place", F.concat(host(F.col("_u")), path(F.col("_u"))))
    tokens = pages.select(F.explode(url_tokens(F.concat(host(F.col(url)), path(F.col(url))))).alias("token"))
    index = bounded(rule_index(spark, rules, tokens), len(rules), 400)
    looked = urls.select("_u", "_place", F.explode(F.array_union(url_tokens(F.col("_place")), F.array(F.lit("")))).alias("token"))
    hits = looked.join(index, "token").where((F.col("_place") != "") & F.expr("_place rlike pattern"))
    best = hits.groupBy("_u").agg(
        F.max(F.when(F.col("host_rule"), F.struct("length", "rule", "verdict"))).alias("_host"),
        F.min(F.when(~F.col("host_rule"), F.struct(F.when(F.col("verdict") == BLOCK, 0).otherwise(1).alias("o"), "rule", "verdict"))).alias("_pattern"),
    )
    out = pages.join(best, pages[url] == best["_u"], "left")
    verdict = F.coalesce("_host.verdict", "_pattern.verdict", F.lit(ALLOW))
    named = {"host": host(F.col(url)), "path": path(F.col(url)), "rule": F.col("_host.rule"), "verdict": verdict, "pattern": F.when(F.col("_host").isNull(), F.col("_pattern.rule"))}
    keep = [c for c in pages.columns if c not in named]
    return out.select(*keep, *(v.alias(k) for k, v in named.items()))
