"""Line dedup: exact set-similarity join of lines, by built-in functions only.

A line is the set of its words. It goes when an earlier line (smaller doc_id, or
same document and earlier place) has a word set at Jaccard ``4/5`` or more;
"earlier" is judged on the input. Lines without a word stay.

1. Word counts over all texts, by hash bucket, give the order of words: rare
   first. The table has a fixed size, and any fixed order is exact; counts only
   make the prefixes rare.
2. Lines with equal sets are one class; its earliest line stands for it.
3. Each class gives a row per word of its prefix (the words of which two
   similar sets must share one). A semi join keeps the rows that meet a partner
   within the length filter, the positional filter and a parity sketch: the
   sketches of two sets differ in at most as many bits as the sets in words.
   Semi joins stop at the first partner, so no group is ever paired out.
4. Only for those lines the whole sets are fetched and settled, and a second
   semi join verifies the exact Jaccard with an earlier line.

Words are compared by 64-bit hashes, classes by two of them.

Defined results: null and empty texts have no lines and come back as they are;
rows without a doc_id take no part and come back as they are; rows that repeat
a doc_id are the same document: equal places do not remove each other; an empty
table gives no rows. All columns of the input are kept, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageforge.llm.common import let, release, settle, words

# Similarity as a fraction.
NUM, DEN = 4, 5
BUCKETS = 65_536
# Sets up to this size have a sketch of 64 bits, larger ones of 128.
SHORT = 96
# Sets of fewer words have no other set at this similarity.
LEAST_WORDS = NUM


def _least(n: Column, num: int, den: int) -> Column:
    """ceil(n * num / den)"""
    return F.floor((n * num + (den - 1)) / den).cast("int")


def bucket_levels(docs: DataFrame) -> list[int]:
    """Level of rarity per hash bucket of words: four steps per doubling of the count."""
    tokens = docs.select(F.explode(words(docs["text"])).alias("w")).select((F.xxhash64("w").bitwiseAND(BUCKETS - 1)).cast("int").alias("b"))
    levels = [0] * BUCKETS
    for r in tokens.groupBy("b").agg(F.count("*").alias("c")).toLocalIterator():
        levels[r["b"]] = int(4 * math.log2(r["c"]))
    return levels


def _codes(line: Column, levels: list[int]) -> Column:
    """Distinct words as longs that sort rare words first: level, then hash."""
    table = F.split(F.lit(",".join(map(str, levels))), ",").cast("array<int>")
    hashes = F.array_distinct(F.transform(words(line), lambda w: F.xxhash64(w)))

    def code(h: Column) -> Column:
        # Never null, so that the arrays of codes are sorted as plain longs.
        level = F.coalesce(F.get(table, h.bitwiseAND(BUCKETS - 1).cast("int")), F.lit(0)).cast("long")
        return F.shiftleft(level, 55).bitwiseOR(F.shiftrightunsigned(h, 9))

    return F.sort_array(F.transform(hashes, code))


def _parity(codes: Column, half: bool = False) -> Column:
    """64 bits of which each word flips one; with ``half`` only the words whose next bit is set do."""
    place = lambda c: c.bitwiseAND(63).cast("int")
    one = lambda c: F.shiftrightunsigned(c, 6).bitwiseAND(1) if half else F.lit(1).cast("long")
    return F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: a.bitwiseXOR(F.call_function("shiftleft", one(c), place(c))))


def _n(a: str) -> Column:
    """Size of a set, kept in the upper half of ``np``."""
    return F.shiftright(f"{a}.np", 32).cast("int")


def _alike(a: str, b: str) -> Column:
    """Whether the sketches allow similar sets: each word that only one has flips a bit, and there are (n + m) / 9 at most.

    ``s1`` has 64 bits of all words. ``s2`` are those of the words of one half, so that two long sets compare 128.
    """
    x = {k: F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}")) for k in ("s1", "s2")}
    n, m = _n(a), _n(b)
    whole = F.bit_count(x["s1"]) * (NUM + DEN) <= (n + m) * (DEN - NUM)
    halves = F.bit_count(x["s2"]) + F.bit_count(x["s1"].bitwiseXOR(x["s2"]))
    return whole & ((n <= SHORT) | (m <= SHORT) | (halves * (NUM + DEN) <= (n + m) * (DEN - NUM)))


def _numbered(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def lines(docs: DataFrame, levels: list[int]) -> DataFrame:
    """Settled table of the lines with words: place, two set hashes, size, prefix, sketch.

    Lines without a word go as the table is read: a filter before it is written
    would be pushed below the projection and build every set a second time.
    """
    each = docs.filter("doc_id IS NOT NULL").select("doc_id", F.posexplode(_numbered(docs["text"])).alias("line", "_text"))
    each = each.select("doc_id", "line", _codes(F.col("_text"), levels).alias("c"))
    c, n = F.col("c"), F.size("c")
    facts = each.select(
        "doc_id", "line", F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(1), c).alias("h2"), n.alias("n"),
        F.when(n < LEAST_WORDS, F.array().cast("array<bigint>")).otherwise(F.slice(c, 1, n - _least(n, NUM, DEN) + 1)).alias("prefix"),
        _parity(c).alias("s1"), F.when(n <= SHORT, F.lit(0).cast("long")).otherwise(_parity(c, half=True)).alias("s2"),
    )
    return settle(facts, "lines").filter("n > 0")


def _earlier(a: str, b: str) -> Column:
    """Whether line ``b`` stands before line ``a``."""
    return (F.col(f"{b}.doc_id") < F.col(f"{a}.doc_id")) | (
        (F.col(f"{b}.doc_id") == F.col(f"{a}.doc_id")) & (F.col(f"{b}.line") < F.col(f"{a}.line"))
    )


def _shares(count: Column, a: str, b: str) -> Column:
    """Whether ``count`` shared words make sets of these sizes similar, in whole numbers."""
    return count * (NUM + DEN) >= (_n(a) + _n(b)) * NUM


def _lengths(a: str, b: str) -> Column:
    n, m = _n(a), _n(b)
    return (n * DEN >= m * NUM) & (m * DEN >= n * NUM)


def _near(table: DataFrame) -> DataFrame:
    """Settled prefix rows (place, code, size, sketch) of classes' first lines that meet a probable partner there."""
    first = F.min(F.struct("doc_id", "line", "n", "prefix", "s1", "s2")).alias("f")
    classes = table.groupBy("h1", "h2").agg(first).select("f.*")
    rows = classes.select("doc_id", "line", "n", "s1", "s2", F.posexplode("prefix").alias("pos", "code"))
    # Narrow rows for the shuffle: size and place in one number.
    rows = rows.select("doc_id", "line", "code", (F.col("n").cast("long") * (1 << 32) + F.col("pos")).alias("np"), "s1", "s2")
    x, y = rows.alias("x"), rows.alias("y")
    pos = lambda a: F.col(f"{a}.np").bitwiseAND((1 << 32) - 1).cast("int")
    room = F.least(_n("x") - pos("x"), _n("y") - pos("y"))
    other = (F.col("x.doc_id") != F.col("y.doc_id")) | (F.col("x.line") != F.col("y.line"))
    # Most pairs of a code end at the sketch, so it comes first.
    meets = (F.col("x.code") == F.col("y.code")) & _alike("x", "y") & _lengths("x", "y") & _shares(room, "x", "y") & other
    return settle(x.join(y, meets, "left_semi"), "near-lines")


def _sets(docs: DataFrame, near: DataFrame, levels: list[int]) -> DataFrame:
    """Settled (doc_id, line, codes) of the near lines, whose texts are read from the documents again."""
    wanted = near.select("doc_id", "line").distinct().groupBy("doc_id").agg(F.collect_list("line").alias("_lines"))
    texts = docs.select("doc_id", "text").join(wanted, "doc_id")
    picked = let(_numbered(F.col("text")), lambda t: F.transform("_lines", lambda i: F.struct(i.alias("line"), F.get(t, i).alias("t"))))
    sets = texts.select("doc_id", F.explode(picked).alias("_l")).dropDuplicates(["doc_id", "_l"])
    return settle(sets.select("doc_id", F.col("_l.line").alias("line"), _codes(F.col("_l.t"), levels).alias("codes")), "near-sets")


def _matched(near: DataFrame, sets: DataFrame) -> DataFrame:
    """Settled (doc_id, line) of those whose whole set is similar to an earlier one."""
    # The hint keeps both sides of the next join the same plan, so that its rows are shuffled once.
    whole = near.join(sets.hint("merge"), ["doc_id", "line"])
    x, y = whole.alias("x"), whole.alias("y")
    similar = (
        (F.col("x.code") == F.col("y.code")) & _alike("x", "y") & _lengths("x", "y") & _earlier("x", "y")
        & _shares(F.size(F.array_intersect("x.codes", "y.codes")), "x", "y")
    )
    return settle(x.join(y, similar, "left_semi").select("doc_id", "line").distinct(), "matched-lines")


def _later(table: DataFrame) -> DataFrame:
    """(doc_id, line) of all but the first of each class; rows that repeat a doc_id repeat theirs."""
    firsts = table.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line")).alias("f")).select("f.*")
    return table.select("doc_id", "line").join(firsts, ["doc_id", "line"], "left_anti")


def removed_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All lines with words (doc_id, line), and the settled (doc_id, line) of those that go."""
    spark = docs.sparkSession
    levels = bucket_levels(docs)
    table = lines(docs, levels)
    near = _near(table)
    release(spark)
    # The shuffled texts go before the sets are shuffled by code.
    sets = _sets(docs, near, levels)
    release(spark)
    matched = _matched(near, sets)
    release(spark)
    gone = settle(_later(table).unionByName(matched).distinct(), "removed-lines")
    release(spark)
    return table, gone


def report(docs: DataFrame) -> DataFrame:
    """Per input row: lines with words, how many go, and their numbers (from 0)."""
    table, gone = removed_lines(docs)
    # Dealt by document at once: neither the distinct lines nor their count are moved again.
    counts = table.select("doc_id", "line").repartition("doc_id").distinct().groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    lost = gone.groupBy("doc_id").agg(F.sort_array(F.collect_list("line")).alias("removed"))
    out = docs.select("doc_id").join(counts, "doc_id", "left").join(lost, "doc_id", "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"),
    )


def drop_lines(docs: DataFrame) -> DataFrame:
    """The documents without the lines that go; all columns kept, ``n_chars`` (if there is one) counted anew.

    A document that loses its last line with a word goes as a whole; one that never had any stays.
    """
    _, gone = removed_lines(docs)
    # Names of our own that no column of the input has.
    own = max(map(len, docs.columns), default=0) * "_"
    key, places = f"{own}_id", f"{own}_gone"
    lost = gone.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list("line").alias(places))
    out = docs.join(lost, docs["doc_id"] == F.col(key), "left")
    untouched = F.col(places).isNull()
    stays = lambda t: F.array_except(F.sequence(F.lit(0), F.size(t) - 1), F.col(places))
    word = lambda t: F.exists(stays(t), lambda i: F.get(t, i).rlike(r"[^\x20\x09-\x0D]"))
    out = out.filter(F.when(untouched, F.lit(True)).otherwise(let(_numbered(docs["text"]), word)))
    kept = let(_numbered(docs["text"]), lambda t: F.array_join(F.transform(stays(t), lambda i: F.get(t, i)), "\n"))
    text = F.when(untouched, docs["text"]).otherwise(kept)
    columns = [text.alias(c) if c == "text" else docs[c] for c in docs.columns]
    if "n_chars" in docs.columns:
        length = F.when(untouched, docs["n_chars"]).otherwise(F.char_length(text).cast(docs.schema["n_chars"].dataType))
        columns[docs.columns.index("n_chars")] = length.alias("n_chars")
    return out.select(*columns)
