"""URL screening and allow/deny rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageforge.functions.urls import host_of, normalize_url, url_reject_reason

KINDS = ("whitelist_patterns", "blacklist_patterns", "regex_whitelist", "regex_blacklist")
# Patterns without groups or references are joined into alternations of at most
# this many characters, so that one compiled regex tests many rules.
ALTERNATION_LENGTH = 20_000


def glob_to_regex(pattern: str) -> str:
    """``*`` and ``?`` become wildcards, anchored; other metacharacters stay live."""
    return "^" + pattern.replace("*", ".*").replace("?", ".") + "$"


def to_java(pattern: str) -> str:
    """Named groups in the spelling of the engine that runs the patterns."""
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))


def compiles(pattern: str) -> bool:
    """Whether the engine that runs the patterns accepts one; without a session, whether Python does."""
    context = SparkContext._active_spark_context
    if context is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(pattern)
        except (Py4JJavaError, IllegalArgumentException):
            return False
        return True
    try:
        re.compile(re.sub(r"\\k<(\w+)>", r"(?P=\1)", re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern)))
    except re.error:
        return False
    return True


def _packs(pattern: str) -> bool:
    """Patterns whose meaning cannot depend on their neighbours: no groups, flags, references or quoting."""
    return "(" not in pattern and re.search(r"\\[0-9kQE]", pattern) is None


def _alternations(patterns: list[str]) -> list[str]:
    packed, current = [p for p in patterns if not _packs(p)], ""
    for p in filter(_packs, patterns):
        piece = f"(?:{p})"
        if current and len(current) + len(piece) > ALTERNATION_LENGTH:
            packed.append(current)
            current = ""
        current = f"{current}|{piece}" if current else piece
    return [*packed, current] if current else packed


@dataclass(frozen=True)
class UrlRules:
    """Allow and deny patterns, globs or regexes. Deny wins; no allow rule allows all.

    Rules are literals of the plan: the test is one regex per group of rules,
    compiled once per task, instead of a nested-loop join that would recompile
    a pattern for every URL and rule.
    """

    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    allow_regex: tuple[str, ...] = ()
    deny_regex: tuple[str, ...] = ()

    def __post_init__(self):
        for name in ("allow_regex", "deny_regex"):
            object.__setattr__(self, name, tuple(map(to_java, getattr(self, name))))
        for p in (*self.allow_regex, *self.deny_regex):
            if not compiles(p):
                raise ValueError(f"Invalid pattern: {p}")

    def add(self, kind: str, pattern: str, is_regex: bool = False) -> UrlRules:
        name = {"allow": "allow", "deny": "deny"}[kind] + ("_regex" if is_regex else "")
        pattern = to_java(pattern) if is_regex else pattern
        current = getattr(self, name)
        return self if pattern in current else replace(self, **{name: (*current, pattern)})

    def cleared(self) -> UrlRules:
        return UrlRules()

    def summary(self) -> dict[str, int]:
        return dict(zip(KINDS, map(len, (self.allow, self.deny, self.allow_regex, self.deny_regex))))

    def frame(self, spark: SparkSession) -> DataFrame:
        """The rules as a table ``(kind, is_regex, pattern)``."""
        rows = [
            (kind, regex, p)
            for kind, regex, patterns in (
                ("allow", False, self.allow), ("deny", False, self.deny),
                ("allow", True, self.allow_regex), ("deny", True, self.deny_regex),
            )
            for p in patterns
        ]
        return spark.createDataFrame(rows, "kind string, is_regex boolean, pattern string")

    def matched(self, url: Column) -> Column:
        """Every rule a URL matches, as an array of ``(kind, is_regex, pattern)``."""
        tests = []
        for kind, regex, patterns in (
            ("deny", False, self.deny), ("deny", True, self.deny_regex),
            ("allow", False, self.allow), ("allow", True, self.allow_regex),
        ):
            for p in patterns:
                row = F.struct(F.lit(kind).alias("kind"), F.lit(regex).alias("is_regex"), F.lit(p).alias("pattern"))
                tests.append(F.when(_matches_any(url, () if regex else (p,), (p,) if regex else ()), row))
        empty = F.array().cast("array<struct<kind:string,is_regex:boolean,pattern:string>>")
        return F.array_compact(F.array(*tests)) if tests else empty

    def allows(self, url: Column) -> Column:
        denied = _matches_any(url, self.deny, self.deny_regex)
        if not self.allow and not self.allow_regex:
            return ~denied
        return ~denied & _matches_any(url, self.allow, self.allow_regex)


def _matches_any(url: Column, globs, regexes) -> Column:
    test = F.lit(False)
    translated = [glob_to_regex(g) for g in globs]
    for alternation in _alternations([t for t in translated if compiles(t)] + list(regexes)):
        test = test | url.rlike(alternation)
    for glob, t in zip(globs, translated):
        if not compiles(t):  # an invalid pattern is plain containment
            test = test | url.contains(glob)
    return test


def filter_urls(df: DataFrame, rules: UrlRules, url: str = "url") -> DataFrame:
    return df.where(rules.allows(F.col(url)))


def rule_counts(rules: DataFrame) -> DataFrame:
    """Rules per kind, kinds without rules included: ``(kind, n)``."""
    label = (
        F.when((F.col("kind") == "allow") & ~F.col("is_regex"), KINDS[0])
        .when((F.col("kind") == "deny") & ~F.col("is_regex"), KINDS[1])
        .when(F.col("kind") == "allow", KINDS[2])
        .otherwise(KINDS[3])
    )
    counted = rules.groupBy(label.alias("kind")).agg(F.count("*").alias("n"))
    kinds = rules.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    return kinds.join(counted, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def screen(df: DataFrame, url: str = "url", reason: str = "reason") -> DataFrame:
    """Add the first failing URL check (null for crawlable URLs)."""
    return df.withColumn(reason, url_reject_reason(F.col(url)))


def screen_against(df: DataFrame, blocklist: DataFrame, url: str = "url", domain: str = "domain") -> DataFrame:
    """Crawlable URLs under a block list given as a table of exact host names."""
    names = blocklist.select(F.lower(domain).alias("_host"))
    valid = df.where(url_reject_reason(F.col(url), blocked=()).isNull())
    return valid.withColumn("_host", host_of(F.col(url))).join(names, "_host", "left_anti").drop("_host")


def add_blocked(blocklist: DataFrame, added: DataFrame, domain: str = "domain") -> DataFrame:
    lowered = added.select(F.lower(domain).alias(domain))
    return blocklist.select(domain).unionByName(lowered).distinct()


def remove_blocked(blocklist: DataFrame, removed: DataFrame, domain: str = "domain") -> DataFrame:
    return blocklist.select(domain).join(removed.select(F.lower(domain).alias(domain)), domain, "left_anti")


def unique_urls(df: DataFrame, order: str, url: str = "url") -> DataFrame:
    """First row per normal form of the URL: ``(normalized, order, url)``.

    One pass and one shuffle, combined before the shuffle. To drop repeats from
    a wide table, keep its rows with ``keys.only`` on the order values.
    """
    first = F.min(F.struct(F.col(order), F.col(url))).alias("_first")
    found = df.groupBy(normalize_url(F.col(url)).alias("normalized")).agg(first)
    return found.select("normalized", f"_first.{order}", f"_first.{url}")
