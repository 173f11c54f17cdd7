"""Rules as a table against a brute-force test of every URL with every pattern."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pageforge.operators import ruletable as T
from pageforge.operators.urlrules import glob_to_regex

RULES = "kind string, is_regex boolean, pattern string"


def holds(url, is_regex, pattern):
    try:
        return bool(re.search(pattern if is_regex else glob_to_regex(pattern), url))
    except re.error:
        return not is_regex and pattern in url


def brute(urls, rules):
    usable = {(k, bool(x), p) for k, x, p in rules if k in T.KINDS and p is not None}
    return sorted((i, k, x, p) for i, u in urls if u is not None for k, x, p in usable if holds(u, x, p))


def hits(spark, urls, rules):
    df = spark.createDataFrame(urls, "i int, url string")
    found = T.matched_rules(df, spark.createDataFrame(rules, RULES))
    return sorted((r.i, r.rule.kind, r.rule.is_regex, r.rule.pattern) for r in found.collect())


@pytest.mark.parametrize(
    "expression, pieces",
    [
        ("^http://.*$", ["http://"]), ("abc*d", ["ab", "d"]), ("ab?c+d", ["a", "c", "d"]), (r"a\.b\dc", ["a.b", "c"]),
        ("a[]x]b[^]]c", ["a", "b", "c"]), (r"[\]]x", ["x"]), ("a|b", []), ("(ab)c", []), ("a{2}b", []), (r"\x41b", []),
        ("éab", ["ab"]), ("é*ab", ["ab"]), ("a*?b++c", ["b", "c"]), ("", []),
    ],
)
def test_fixed_pieces(expression, pieces):
    assert T.fixed_pieces(expression) == pieces


def test_every_match_holds_the_fixed_pieces():
    random.seed(5)
    for _ in range(20_000):
        expression = "".join(random.choices(["a", "b", "/", "*", "?", "+", ".", "[ab]", "[^a]", r"\.", r"\w", "^", "$", "é", "|", "(", ")"], k=random.randint(1, 7)))
        url = "".join(random.choices("ab/.é", k=random.randint(0, 9)))
        try:
            found = re.search(expression, url)
        except re.error:
            continue
        assert not found or all(p in url for p in T.fixed_pieces(expression)), (expression, url)


def test_matches_as_brute_force(spark):
    random.seed(7)
    letters = ["a", "b", "/", ".", "http://", "example", "é", "😀", "x1"]
    urls = [(i, "".join(random.choices([*letters, "\n"], k=random.randint(0, 9)))) for i in range(200)]
    urls += [(200, None), (201, ""), (202, urls[0][1]), (0, urls[0][1]), (203, "http://a.com/x?y=(pills"), (204, "a\r"), (205, "a\n"), (206, "a b")]
    odd = ["*", "?", "[ab]", "(", ")", "+", "\\", "|", "[", r"\d", "^", "$", "{2}"]
    rules = [
        (random.choice(["allow", "deny"]), random.choice([True, False, False, None]), "".join(random.choices([*letters, *odd, "*", "*"], k=random.randint(1, 6))))
        for _ in range(600)
    ]
    rules += [("deny", False, ""), ("allow", False, "*"), ("allow", True, ""), ("allow", None, "(pills"), ("deny", False, "a"), ("deny", False, "a?b"), ("deny", False, "a.")]
    rules += [(None, False, "a"), ("other", False, "a"), ("deny", True, None), ("deny", True, "(a"), *rules[:20]]
    wanted = brute([u for u in urls], rules)
    got = hits(spark, urls, rules)
    assert got == wanted and len(wanted) > 3000
    problems = {(r.kind, r.pattern): r.problem for r in T.rule_problems(spark.createDataFrame(rules, RULES)).collect()}
    assert problems["deny", "(a"] == "Pattern does not compile" and problems["deny", None] == "Pattern is missing"
    assert problems[None, "a"] == problems["other", "a"] == "Unknown kind of rule"


def test_filter(spark):
    urls = [(1, "http://a.com/x"), (2, "http://a.com/admin/x"), (2, "http://a.com/admin/x"), (3, "http://b.com/"), (3, "http://b.com/"), (4, None), (5, "")]
    df = spark.createDataFrame(urls, "kind int, url string").withColumn("_url", F.lit("x")).withColumn("pattern", F.lit(1))

    def kept(*rules):
        out = T.filter_urls(df, spark.createDataFrame(rules, RULES))
        assert out.columns == df.columns
        return sorted(r.kind for r in out.collect())

    assert kept(("allow", False, "http://a.com/*"), ("deny", False, "*/admin/*")) == [1]
    assert kept(("deny", False, "*/admin/*")) == [1, 3, 3, 5]
    assert kept(("deny", False, "*")) == []
    assert kept(("allow", False, "nowhere")) == []
    assert kept((None, False, "*")) == [1, 2, 2, 3, 3, 5]
    assert kept(("allow", True, "(")) == [1, 2, 2, 3, 3, 5]
    empty = df.limit(0)
    rules = spark.createDataFrame([("allow", False, "*x")], RULES)
    assert T.filter_urls(empty, rules).count() == 0 and T.matched_rules(empty, rules).count() == 0
    assert T.matched_rules(df, rules.limit(0)).count() == 0 and T.filter_urls(df, rules.limit(0)).count() == 6


def test_many_rules_test_few_pairs(spark):
    """10^5 rules: a URL is tested with the rules filed under its pieces only."""
    rules = spark.range(100_000).select(
        F.lit("deny").alias("kind"), F.lit(False).alias("is_regex"),
        F.concat(F.lit("*://"), F.lower(F.conv(F.xxhash64("id").cast("string"), 10, 36)), F.lit("/*")).alias("pattern"),
    )
    hosts = spark.range(0, 100_000, 100).select("id", F.lower(F.conv(F.xxhash64("id").cast("string"), 10, 36)).alias("host"))
    urls = hosts.select("id", F.concat(F.lit("https://"), "host", F.when(F.col("id") % 200 == 0, "/a").otherwise("x/a")).alias("url"))
    found = T.matched_rules(urls, rules).select("id", "rule.pattern", "url").collect()
    assert sorted(r.id for r in found) == list(range(0, 100_000, 200))
    assert all(r.pattern[4:-2] == r.url[8:-2] for r in found)
    table = T._table(rules)
    pieces = urls.select(F.explode(T._keys(F.col("url"), [6])).alias("_key"))
    assert pieces.join(T._anchored(table, pieces), "_key").count() < 10 * 1000
