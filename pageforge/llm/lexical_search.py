"""Ranked lexical search: accumulator-limited term-at-a-time over blocks of documents.

1. The items' distinct terms are the vocabulary. Items are taken in blocks of
   bounded items and terms, each with its own pass, so what travels to the tasks
   is bounded, however many items there are.
2. Documents are tokenised once, where they are read. A task writes postings of
   the vocabulary's terms in blocks of bounded documents and postings: per term
   the documents and how often each holds it, with the documents' lengths.
3. Counts of documents, terms and documents per term are sums over the blocks.
4. Each block is searched by itself, item by item, a term at a time, rarest
   first. What the remaining terms can add is at most their greatest value in the
   block; once that is below the k-th best score so far (of this block, or of the
   blocks the task has done), no new document can enter: no more accumulators are
   made, and the survivors alone are brought up to their exact scores.
5. The tasks' best lists are merged by a ranking window.

Nothing is shuffled but k rows per item and task, and counts per term and block.

Terms are runs of ASCII letters, digits and all characters beyond ASCII; only A-Z
are lower-cased.

Defined results: rows without a doc_id or item_id take no part, also not in the
counts; every row with a doc_id is a document, also if it repeats one (equal ids
with equal scores then stand in several ranks); rows that repeat an item_id are
one item with the terms of all; texts without a term, null or empty, match
nothing; items without a match, an empty table of items or of documents give no
rows; equal scores are ranked by doc_id.
"""

from __future__ import annotations

from array import array
from collections import Counter
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageforge.llm.common import settle

# Items and distinct (item, term) pairs per pass; documents and postings per block.
PASS_ITEMS, PASS_TERMS = 4_096, 500_000
BLOCK_DOCS, BLOCK_POSTINGS = 8_192, 2_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# The same for bytes: everything that is no term becomes a space.
_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()

INDEX = "n_docs long, n_terms long, doc_ids binary, lengths binary, terms array<int>, counts array<int>, docs binary, times binary"


def terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_remove(F.array_distinct(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS)), "")


def index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Settled postings of the vocabulary, a row per block; counts of documents and terms are over all terms."""

    def run(batches):
        ids, lengths, n_docs, n_terms = [], [], 0, 0
        place, term, times = (array("i") for _ in range(3))

        def out():
            t, p, f = (np.array(x, np.int32) for x in (term, place, times))
            order = np.argsort(t, kind="stable")
            found, counts = np.unique(t, return_counts=True)
            lists = [pa.array([x.tolist()], pa.list_(pa.int32())) for x in (found, counts.astype(np.int32))]
            raw = [pa.array([x.tobytes()], pa.binary()) for x in (np.array(ids, np.int64), np.array(lengths, np.int64), p[order], f[order])]
            return pa.RecordBatch.from_arrays(
                [pa.array([n_docs]), pa.array([n_terms]), raw[0], raw[1], *lists, raw[2], raw[3]],
                names=[x.split()[0] for x in INDEX.split(", ")],
            )

        get = vocabulary.get
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = (text.as_py() or b"").translate(_BYTES).split()
                if not tokens:
                    continue
                n_docs, n_terms = n_docs + 1, n_terms + len(tokens)
                held = [(i, f) for t, f in Counter(tokens).items() if (i := get(t)) is not None]
                if not held:
                    continue
                place.extend([len(ids)] * len(held))
                term.extend([i for i, _ in held])
                times.extend([f for _, f in held])
                ids.append(key)
                lengths.append(len(tokens))
                if len(ids) >= BLOCK_DOCS or len(term) >= BLOCK_POSTINGS:
                    yield out()
                    ids, lengths, n_docs, n_terms = [], [], 0, 0
                    place, term, times = (array("i") for _ in range(3))
        if n_docs:
            yield out()

    source = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return settle(source.mapInArrow(run, INDEX), "postings")


class Best:
    """The best k documents of one item so far; ``floor`` is the k-th score once there are k."""

    def __init__(self, k: int):
        self.k, self.floor = k, 0
        self.score, self.doc = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[order], doc[order]
        if len(order) == self.k:
            self.floor = int(self.score[-1])


def search_block(best: Best, doc_ids: np.ndarray, postings: list[tuple[int, np.ndarray, np.ndarray]]) -> int:
    """Add a block's documents to the best; postings are (greatest value, places, values) of the item's terms, rarest first.

    Gives the number of accumulators made.
    """
    rest = sum(p[0] for p in postings)
    total, level, at = np.zeros(len(doc_ids), np.int64), best.floor, 0
    for top, places, values in postings:
        if rest < level:
            break
        total[places] += values
        rest, at = rest - top, at + 1
        if len(total) > best.k:
            level = max(level, int(np.partition(total, len(total) - best.k)[-best.k]))
    alive = np.flatnonzero(total)
    made, total = len(alive), total[alive]
    for top, places, values in postings[at:]:
        stay = total + rest >= level
        alive, total = alive[stay], total[stay]
        if not len(alive):
            break
        where = np.minimum(np.searchsorted(places, alive), len(places) - 1)
        total += np.where(places[where] == alive, values[where], 0)
        rest -= top
        if len(total) > best.k:
            level = max(level, int(np.partition(total, len(total) - best.k)[-best.k]))
    stay = total >= max(level, 1)
    best.add(total[stay], doc_ids[alive[stay]])
    return made


def search_pass(docs: DataFrame, pairs: list[tuple[int, str]], k: int) -> DataFrame:
    """(item_id, doc_id, score): per task the best k documents of each item of (item_id, term) pairs."""
    vocabulary = {t.encode("utf-8", "surrogatepass"): i for i, t in enumerate(sorted({t for _, t in pairs}))}
    blocks = index(docs, vocabulary)
    total = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n, all_terms = total[0] or 0, total[1] or 1
    each = blocks.select(F.explode(F.arrays_zip("terms", "counts")).alias("e")).groupBy("e.terms").agg(F.sum("e.counts").alias("df"))
    weight = np.zeros(len(vocabulary), np.int64)
    for r in each.toLocalIterator():
        weight[r["terms"]] = floor(1000 * log((2 * n + 2) / (2 * r["df"] + 1)))
    items: dict[int, list[int]] = {}
    for item, t in pairs:
        items.setdefault(item, []).append(vocabulary[t.encode("utf-8", "surrogatepass")])
    # Rarest first; terms of weight 0 or in no document add nothing.
    asked = {i: sorted((t for t in ts if weight[t] > 0), key=lambda t: (-weight[t], t)) for i, ts in items.items()}

    def run(batches):
        found = {i: Best(k) for i in asked}
        for batch in batches:
            for r in batch.to_pylist():
                ids, lengths = np.frombuffer(r["doc_ids"], np.int64), np.frombuffer(r["lengths"], np.int64)
                if not len(ids):
                    continue
                places, times = np.frombuffer(r["docs"], np.int32), np.frombuffer(r["times"], np.int32).astype(np.int64)
                scale = 50 + 50 * lengths * n // all_terms
                value = 1_000_000_000 * times // (1000 * times + 20 * scale[places])
                ends = np.cumsum(r["counts"])
                starts = ends - np.array(r["counts"])
                lists = {}
                for t, lo, hi in zip(r["terms"], starts.tolist(), ends.tolist()):
                    if weight[t] > 0:
                        v = value[lo:hi] * weight[t]
                        lists[t] = (int(v.max()), places[lo:hi], v)
                for item, ts in asked.items():
                    if postings := [lists[t] for t in ts if t in lists]:
                        search_block(found[item], ids, postings)
        for item, best in found.items():
            if len(best.doc):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(best.doc), item, np.int64)), pa.array(best.doc), pa.array(best.score)], names=["item_id", "doc_id", "score"]
                )

    source = blocks.select("doc_ids", "lengths", "terms", "counts", "docs", "times")
    return source.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k best documents with a score above 0."""
    pairs = items.filter(items[key].isNotNull()).select(items[key].cast("long").alias("item"), F.explode(terms(items[text])).alias("term"))
    pairs = settle(pairs.distinct(), "item-terms")
    size = pairs.agg(F.count("*").alias("terms"), F.countDistinct("item").alias("items")).first()
    passes = max(1, -(-size["items"] // PASS_ITEMS), -(-size["terms"] // PASS_TERMS))
    found = None
    for i in range(passes):
        mine = pairs.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == i)
        part = search_pass(docs, [(r["item"], r["term"]) for r in mine.toLocalIterator()], k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
