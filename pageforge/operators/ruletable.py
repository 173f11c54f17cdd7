"""Allow and deny rules as a table of any size, met by an equi-join on a fixed piece.

A URL matches a rule only if it holds every fixed piece of the pattern, so each
rule is filed under one short piece, the one that the fewest URLs hold. URLs are
cut into all their pieces of the lengths in use; the pieces that are anchors
join the rules, and only these pairs are tested with the whole pattern.

Rules without any fixed character (``*``, and regular expressions with groups,
alternatives or counts, whose pieces are not read) meet every URL. They are filed
under ``SALTS`` keys and each URL under one of them, so that no task gets all URLs.

Rows are ``(kind, is_regex, pattern)`` as in ``UrlRules.frame``, patterns in Python's
spelling. Defined results: rules with a null or unknown kind or a null pattern
are ignored, a null ``is_regex`` means a glob, repeated rules count once; regular
expressions that do not compile match nothing (``rule_problems`` lists them); a
glob that does not compile is plain containment; a null URL matches nothing and
is not allowed; repeated rows are judged alike.
"""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from pageforge.operators.keys import settle
from pageforge.operators.urlrules import glob_to_regex

# Lengths of the pieces; a rule uses the greatest that its pattern offers.
LENGTHS = (6, 3, 1)
SALTS = 64
KINDS = ("allow", "deny")

_PREPARED = "kind string, is_regex boolean, pattern string, test string, expression string, length int, pieces array<string>"
_RULE = ("kind", "is_regex", "pattern")


# An escape, a class, or one character.
_TOKEN = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.", re.DOTALL)


def fixed_pieces(expression: str) -> list[str]:
    """Runs of ASCII characters that every match of a regular expression holds; none where that is not plain to see."""
    if re.search(r"[(|{]", expression) or re.search(r"\\[^\WdDwWsSbBAZ]", expression):
        return []
    pieces, current = [], ""
    for token in _TOKEN.findall(expression):
        c = token[-1] if len(token) == 1 or token[0] == "\\" and not token[1].isalnum() else ""
        if c.isascii() and c and (len(token) > 1 or c not in "*?+.^$"):
            current += c
            continue
        pieces.append(current[:-1] if token in "*?" else current)
        current = ""
    return [p for p in (*pieces, current) if p]


@functools.lru_cache(maxsize=10_000)
def _compiled(expression: str) -> re.Pattern | None:
    try:
        return re.compile(expression)
    except (re.error, OverflowError, RecursionError):
        return None


def _prepared_rule(is_regex: bool, pattern: str) -> tuple[str, str, list[str]]:
    """How a rule is tested, with which expression, and its fixed pieces."""
    expression = pattern if is_regex else glob_to_regex(pattern)
    if not is_regex and not re.search(r"[()\[\]{}\\+^$|]", pattern):
        return "plain", f"(?d){expression}", fixed_pieces(expression)
    if _compiled(expression) is None:
        return ("invalid", pattern, []) if is_regex else ("contains", pattern, re.findall(r"[\x00-\x7F]+", pattern))
    return "search", expression, fixed_pieces(expression)


def _prepare(batches):
    for pdf in batches:
        rows = []
        for is_regex, pattern in zip(pdf["is_regex"], pdf["pattern"]):
            test, expression, runs = _prepared_rule(is_regex, pattern)
            length = next((k for k in LENGTHS if any(len(r) >= k for r in runs)), 0)
            pieces = {r[i : i + length] for r in runs for i in range(len(r) - length + 1)} if length else set()
            rows.append((test, expression, length, sorted(pieces)))
        yield pd.concat(
            [pdf.reset_index(drop=True), pd.DataFrame(rows, columns=["test", "expression", "length", "pieces"])], axis=1
        )


def prepared(rules: DataFrame) -> DataFrame:
    """The distinct usable rules with their test and pieces, one pass over the rule table."""
    known = rules.where(F.col("kind").isin(*KINDS) & F.col("pattern").isNotNull())
    distinct = known.select("kind", F.coalesce("is_regex", F.lit(False)).alias("is_regex"), "pattern").distinct()
    return distinct.mapInPandas(_prepare, _PREPARED)


def rule_problems(rules: DataFrame) -> DataFrame:
    """Rules that can never apply, with the reason: ``(kind, is_regex, pattern, problem)``."""
    unusable = rules.select(
        *_RULE,
        F.when(F.col("pattern").isNull(), "Pattern is missing")
        .when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "Unknown kind of rule")
        .alias("problem"),
    ).where("problem IS NOT NULL")
    invalid = prepared(rules).where("test = 'invalid'")
    return unusable.unionByName(invalid.select(*_RULE, F.lit("Pattern does not compile").alias("problem")))


def _keys(url: Column, lengths: list[int]) -> Column:
    """Hashes of all pieces of a URL, each once; linear in its length."""
    plain = F.regexp_replace(url, r"[^\x00-\x7F]", "\x00")

    salt = F.concat(F.lit("#"), F.pmod(F.xxhash64(url), F.lit(SALTS)).cast("string"))

    def cut(chars: Column, length: int) -> Column:
        return F.transform(chars, lambda _, i: F.xxhash64(F.array_join(F.slice(chars, i + 1, F.lit(length)), "")))

    def of(chars: Column) -> Column:
        return F.array_distinct(F.concat(*[cut(chars, k) if k else F.array(F.xxhash64(salt)) for k in lengths]))

    return F.transform(F.array(F.split(plain, "")), of)[0]


@F.pandas_udf(BooleanType())
def _search(url: pd.Series, expression: pd.Series) -> pd.Series:
    """Patterns that only the rules' own regex dialect reads as meant; compiled once per process up to a bound."""
    return pd.Series([u is not None and _compiled(e).search(u) is not None for u, e in zip(url, expression)], dtype=bool)


def _anchored(table: DataFrame, pieces: DataFrame) -> DataFrame:
    """Rules with the hash of the piece that the fewest URLs hold; rules without pieces under every salt."""
    filed = table.where("length > 0").withColumn("_key", F.explode(F.transform("pieces", lambda p: F.xxhash64(p))))
    wanted = filed.select("_key").distinct()
    counts = pieces.join(wanted, "_key", "left_semi").groupBy("_key").agg(F.count("*").alias("_n"))
    rarest = F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_key").alias("key")))["key"].alias("_key")
    columns = (*_RULE, "test", "expression")
    anchors = filed.join(counts, "_key", "left").groupBy(*columns).agg(rarest)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    loose = table.where("length = 0").select(*columns, salts.alias("_salt"))
    loose = loose.select(*columns, F.xxhash64(F.concat(F.lit("#"), F.col("_salt").cast("string"))).alias("_key"))
    return anchors.unionByName(loose)


def _matches(df: DataFrame, table: DataFrame, url: str) -> DataFrame:
    """``(_row, _url, kind, is_regex, pattern)`` per row and rule of a prepared, settled table."""
    shape = table.agg(F.collect_set("length").alias("lengths"), F.collect_set("test").alias("tests")).first()
    rows = df.select(F.struct("*").alias("_row"), F.col(url).alias("_url")).where("_url IS NOT NULL")
    rows = rows.withColumn("_id", F.xxhash64("_url"))
    # Without rules there is no length; one keeps the plan's shape and meets nothing.
    pieces = rows.select("_id", F.explode(_keys(F.col("_url"), sorted(shape["lengths"]) or [0])).alias("_key"))
    pairs = pieces.join(_anchored(table, pieces), "_key").drop("_key").distinct()
    met = rows.join(pairs, "_id")
    holds = F.when(F.col("test") == "plain", F.rlike("_url", F.col("expression")))
    holds = holds.when(F.col("test") == "contains", F.contains("_url", F.col("expression")))
    if "search" in shape["tests"]:
        own = F.col("test") == "search"
        met = met.withColumn("_found", _search(F.when(own, F.col("_url")), F.col("expression")))
        holds = holds.when(own, F.col("_found"))
    return met.where(holds).select("_row", "_url", *_RULE)


def _table(rules: DataFrame) -> DataFrame:
    return settle(prepared(rules).where("test <> 'invalid'"))


def matched_rules(df: DataFrame, rules: DataFrame, url: str = "url", into: str = "rule") -> DataFrame:
    """Every row once per rule its URL matches, the rule in a struct column ``(kind, is_regex, pattern)``."""
    found = _matches(df, _table(rules), url)
    return found.select("_row.*", F.struct(*_RULE).alias(into))


def filter_urls(df: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """The allowed rows: deny wins; without a usable allow rule all others are allowed."""
    table = _table(rules)
    must = not table.where("kind = 'allow'").isEmpty()
    found = _matches(df.select(F.col(url).alias("u")), table, "u").groupBy("_url")
    flags = found.agg(F.bool_or(F.col("kind") == "deny").alias("_denied"), F.bool_or(F.col("kind") == "allow").alias("_listed"))
    rows = df.select(F.struct("*").alias("_row"), F.col(url).alias("_url")).where("_url IS NOT NULL")
    judged = rows.join(flags, "_url", "left")
    denied, listed = F.coalesce("_denied", F.lit(False)), F.coalesce("_listed", F.lit(False))
    return judged.where(~denied & (listed | F.lit(not must))).select("_row.*")
