"""Quality rules: decision lists learned from labelled statistics.

Statistics are taken inside the row by built-in functions. Sequential covering
grows one conjunction of thresholds at a time on two thirds of the labelled
rows (best information gain per step), prunes it on the last third and keeps it
while it is precise there. Every count of the search is one aggregation over a
table of binned statistics, so any number of labelled rows takes part; the
driver only sees counts per bin. The list becomes one CASE expression.

Defined results: a null or empty text has zero statistics and fails the base
rules; labels that are null, or of unknown documents, are ignored; a document
labelled twice counts with its lowest label; without labels the list is empty
and the base rules alone decide; repeated rows are judged alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageforge.llm.common import let, settle, words

SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SHORT_LIST = 24


def _repeat_words(w: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the text."""
    keys = F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
    )

    def covered(places: Column) -> Column:
        widths = F.transform(places, lambda p, k: F.least(F.coalesce(F.get(places, k + 1) - p, F.lit(3)), F.lit(3)))
        return F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x)

    def by_sort(g: Column) -> Column:
        """Positions of repeated keys, for texts with many of them."""

        def repeated(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k + 1) | (k > 0) & same(x, k - 1)), lambda x: x["i"]))

        return let(F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), repeated)

    def by_list(g: Column, twice: Column) -> Column:
        """The same positions, by looking into the short list of repeated keys."""
        return F.filter(F.transform(g, lambda h, i: F.when(F.array_contains(twice, h), i)), lambda i: i.isNotNull())

    def count(g: Column) -> Column:
        twice = let(F.sort_array(g), lambda s: F.array_distinct(F.filter(s, lambda h, k: h == F.get(s, k + 1))))
        places = let(twice, lambda d: F.when(F.size(d) <= SHORT_LIST, by_list(g, d)).otherwise(by_sort(g)))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(let(places, covered))

    return let(keys, count)


def statistics(text: Column) -> Column:
    """Struct of counts over the whole text."""
    t = F.coalesce(text, F.lit(""))

    def of(w: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return let(
            lines,
            lambda ls: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                _repeat_words(w).alias("n_repeat_words"),
                F.size(ls).cast("long").alias("n_lines"),
                F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            ),
        )

    return let(words(text), of)


def base_failed(s) -> Column:
    """The fixed base rules: too few words, or mostly repeated windows."""
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


# Name -> ratio of statistics that rules may test.
FEATURES = {
    "words": lambda s: s["n_words"].cast("double"),
    "word_length": lambda s: _share(s["word_chars"], s["n_words"]),
    "symbols_per_word": lambda s: _share(s["n_symbols"], s["n_words"]),
    "dup_lines": lambda s: _share(s["n_dup_lines"], s["n_lines"]),
    "repeats": lambda s: _share(s["n_repeat_words"], s["n_words"]),
    "capitals": lambda s: _share(s["n_upper"], s["word_chars"]),
    "line_length": lambda s: _share(s["n_words"], s["n_lines"]),
}


@dataclass(frozen=True)
class Test:
    """``feature <= bound`` or ``feature > bound``."""

    feature: str
    above: bool
    bound: float

    def column(self, s) -> Column:
        value = FEATURES[self.feature](s)
        return value > self.bound if self.above else value <= self.bound

    def __str__(self):
        return f"{self.feature} {'>' if self.above else '<='} {self.bound:g}"


def verdict(rules: list[tuple[Test, ...]], s) -> Column:
    """The ordered list as one conditional expression: true keeps the document."""
    chain = F.when(base_failed(s), F.lit(False))
    for rule in rules:
        hit = F.lit(True)
        for test in rule:
            hit = hit & test.column(s)
        chain = chain.when(hit, F.lit(False))
    return chain.otherwise(F.lit(True))


def learn(
    labelled: DataFrame,
    max_rules: int = 8,
    max_tests: int = 4,
    min_precision: float = 0.95,
    min_covered: int = 5,
    grid: int = 40,
) -> list[tuple[Test, ...]]:
    """Rules that reject, learned from rows (key, stats struct ``s``, ``quality``).

    ``key`` splits the rows into growing and pruning parts. Thresholds are approximate
    quantiles of the rejected and of the kept rows, ``grid`` each.
    """
    names = list(FEATURES)
    rows = labelled.filter(~base_failed(F.col("s"))).select(
        (F.col("quality") == 0).alias("bad"),
        (F.crc32(F.col("key").cast("string")) % 3 == 0).alias("prune"),
        *[FEATURES[n](F.col("s")).alias(n) for n in names],
    )
    shares = [i / grid for i in range(grid + 1)]
    cuts = rows.groupBy("bad").agg(*[F.percentile_approx(n, shares, 5000).alias(n) for n in names]).collect()
    if {r["bad"] for r in cuts} != {True, False}:
        return []
    values = {n: sorted({float(v) for r in cuts for v in (r[n] or [])}) for n in names}
    # A threshold lies halfway between neighbouring values, as far from both classes as they allow.
    bounds = {n: [(a + b) / 2 for a, b in zip(v, v[1:])] for n, v in values.items()}

    # Bin b of a feature: value <= bounds[b], and above bounds[b - 1].
    def binned(n: str) -> Column:
        return F.aggregate(
            F.array(*[F.lit(v) for v in bounds[n]]).cast("array<double>"), F.lit(0), lambda a, v: a + (F.col(n) > v).cast("int")
        ).alias(n)

    table = settle(
        rows.select("bad", "prune", *[binned(n) for n in names]).groupBy("bad", "prune", *names).agg(F.count("*").alias("c")),
        "rule-bins",
    )

    def hit(rule) -> Column:
        out = F.lit(True)
        for n, above, b in rule:
            out = out & (F.col(n) > b if above else F.col(n) <= b)
        return out

    def tally(df: DataFrame) -> dict:
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("b")) for n in names])).alias("x")
        got = (
            df.select(pairs, "bad", "c").groupBy("x.f", "x.b")
            .agg(F.sum(F.when(F.col("bad"), F.col("c")).otherwise(0)).alias("p"),
                 F.sum(F.when(F.col("bad"), 0).otherwise(F.col("c"))).alias("n")).collect()
        )
        return {(r["f"], r["b"]): (r["p"], r["n"]) for r in got}

    rules: list[list[tuple[str, bool, int]]] = []
    while len(rules) < max_rules:
        left = table.filter(~F.coalesce(F.reduce(F.array(*[hit(r) for r in rules]), F.lit(False), lambda a, x: a | x), F.lit(False)) if rules else F.lit(True))
        rule: list[tuple[str, bool, int]] = []
        while len(rule) < max_tests:
            counts = tally(left.filter(~F.col("prune") & hit(rule)))
            p0 = sum(p for (f, _), (p, _n) in counts.items() if f == names[0])
            n0 = sum(n for (f, _), (_p, n) in counts.items() if f == names[0])
            if not p0 or not n0:
                break
            best = (0.0, None)
            for f in names:
                p = n = 0
                for b in range(len(bounds[f])):
                    p, n = p + counts.get((f, b), (0, 0))[0], n + counts.get((f, b), (0, 0))[1]
                    for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                        if pp >= min_covered and pp + nn < p0 + n0:
                            gain = pp * (math.log2(pp / (pp + nn)) - math.log2(p0 / (p0 + n0)))
                            if gain > best[0]:
                                best = (gain, (f, above, b))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        # Prune: the leading tests that do best on the rows kept for it.
        parts = [rule[: k + 1] for k in range(len(rule))]
        seen = left.filter("prune").agg(
            *[F.sum(F.when(hit(r) & (F.col("bad") == bad), F.col("c")).otherwise(0)).alias(f"{tag}{k}") for k, r in enumerate(parts) for tag, bad in (("p", True), ("n", False))]
        ).first()
        scored = [((seen[f"p{k}"] or 0), (seen[f"n{k}"] or 0), k) for k in range(len(parts))]
        p, n, k = max(scored, key=lambda x: ((x[0] - x[1]) / max(1, x[0] + x[1]), x[0]))
        if p < 1 or p / (p + n) < min_precision:
            break
        rules.append(parts[k])
    return [tuple(Test(f, above, bounds[f][b]) for f, above, b in r) for r in rules]


def labelled_statistics(stats: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows for ``learn``: one per labelled document."""
    marks = labels.filter(F.col("quality").isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min("quality").alias("quality"))
    return stats.select(F.col(key).alias("key"), "s").join(marks, "key")


def judge(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """``doc_id``, the statistics, base_failed and kept, one row per input row."""
    stats = settle(docs.select("doc_id", statistics(F.col("text")).alias("s")), "statistics")
    rules = learn(labelled_statistics(stats, labels), **settings)
    s = F.col("s")
    return stats.select("doc_id", "s.*", base_failed(s).alias("base_failed"), verdict(rules, s).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The documents the learned list keeps, all columns as they are; the verdict is taken inside the row."""
    stats = settle(docs.select("doc_id", statistics(F.col("text")).alias("s")), "statistics")
    rules = learn(labelled_statistics(stats, labels), **settings)
    return docs.filter(let(statistics(docs["text"]), lambda s: verdict(rules, s)))
