"""N-gram Jaccard join of documents, with Bayesian pruning of candidates.

A document is the set of its runs of five words. Two documents are linked when
their sets have Jaccard 4/5 or more.

1. Documents with equal sets are one class; the smallest doc_id stands for it.
2. Every class gets a MinHash signature. Bands of it are grouped; a pair at the
   threshold misses all bands with a probability below 1e-5.
3. Inside a band's bucket MinHash values are compared a few at a time, and a
   pair is dropped once the posterior probability that its similarity reaches
   the threshold is below a tolerance (uniform prior, so a binomial tail). The
   pairs that stay connect documents into coarse groups. A bucket of many
   members connects all of them to its first one instead, unpruned, so that no
   bucket is paired out.
4. Each coarse group is cut into blocks of bounded documents and bounded text.
   For every two blocks one unit compares signatures in the same way, with all
   values, and verifies what is left exactly on whole sets. A unit returns
   link counts and a spanning forest, never the pairs.
5. Components of the forest are the near-duplicate groups.

Copies and hot groups are counted by weight. Nothing is collected to the driver.

Defined results: a text of one to four words is one run of all its words; null
and empty texts have no runs and are alone; rows without a doc_id take no part;
rows that repeat a doc_id with other text count once, with one of the texts; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageforge.llm.common import own_prefix, release, settle, whole_runs
from pageforge.llm.graph import components

GRAM = 5
NUM, DEN = 4, 5
BANDS, BAND_ROWS = 32, 5
VALUES = BANDS * BAND_ROWS
STEP, TOLERANCE = 16, 1e-6
# Minimal number of equal values after each step, from the posterior under a uniform prior.
BUCKET = 256
BLOCK_DOCS, BLOCK_GRAMS = 512, 1_000_000

_RNG = np.random.default_rng(20_240_501)
_MUL = _RNG.integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, VALUES, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)


def least_equal(n: int, threshold: float = NUM / DEN, tolerance: float = TOLERANCE) -> int:
    """Fewest equal values of ``n`` with P(similarity >= threshold) >= tolerance.

    With a uniform prior the posterior tail is P(Bin(n + 1, threshold) <= m).
    """
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _P
    return h ^ (h >> np.uint64(29))


def gram_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word runs."""
    w = (text or "").encode("utf-8", "surrogatepass").split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    width = min(GRAM, len(w))
    n = len(w) - width + 1
    out = h[:n].copy()
    for k in range(1, width):
        out = _mix(out) + h[k : k + n]
    return np.unique(_mix(out))


def signature(grams: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty set, as 32-bit numbers."""
    low = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 2048):
        part = grams[at : at + 2048, None] * _MUL + _ADD
        low = np.minimum(low, (part >> np.uint64(32)).min(axis=0))
    return low.astype(np.uint32)


def _bands(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, BAND_ROWS).astype(np.uint64)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND_ROWS):
        out = _mix(out + rows[:, k])
    return out.view(np.int64)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, set key (k1, k2), n, low 16 bits of the signature, band hashes; one row per input row."""

    def run(batches):
        for batch in batches:
            keys, k1, k2, n, sigs, bands = [], [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                g = gram_set(text.as_py())
                if not len(g):
                    continue
                d = hashlib.blake2b(g.tobytes(), digest_size=16).digest()
                s = signature(g)
                keys.append(key)
                k1.append(int.from_bytes(d[:8], "little", signed=True))
                k2.append(int.from_bytes(d[8:], "little", signed=True))
                n.append(len(g))
                sigs.append(s.astype(np.uint16).tobytes())
                bands.append(_bands(s))
            flat = pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), flat)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), lists],
                names=["doc_id", "k1", "k2", "n", "sig", "bands"],
            )

    source = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    return source.mapInArrow(run, "doc_id long, k1 long, k2 long, n long, sig binary, bands array<long>")


def prune(a: np.ndarray, b: np.ndarray, sig: np.ndarray, values: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a[i], b[i]) those that stay probable while values are compared step by step."""
    equal = np.zeros(len(a), np.int32)
    for at in range(0, values, STEP):
        equal += (sig[a, at : at + STEP] == sig[b, at : at + STEP]).sum(axis=1, dtype=np.int32)
        stay = equal >= least_equal(at + STEP)
        a, b, equal = a[stay], b[stay], equal[stay]
    return a, b


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes under edges (a, b)."""
    lab = np.arange(n)
    while len(a):
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    return lab


def _pairs(starts: np.ndarray, counts: np.ndarray):
    """Index pairs inside runs, some runs at a time."""
    at = 0
    while at < len(starts):
        upto = at + max(1, int(np.searchsorted(np.cumsum(counts[at:] ** 2), 2_000_000)))
        sizes = np.repeat(counts[at:upto], counts[at:upto])
        first = np.repeat(starts[at:upto], counts[at:upto])
        a = np.repeat(np.arange(len(sizes)) + starts[at], sizes)
        inner = np.arange(len(a)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        b = np.repeat(first, sizes) + inner
        yield a[a < b], b[a < b]
        at = upto


def bucket_edges(members: DataFrame) -> DataFrame:
    """(band, node, sig) of small buckets to edges (a, b) between documents that stay probable."""

    def run(batches):
        for table in whole_runs(batches, ["band"]):
            band, node = table.column("band").to_numpy(), table.column("node").to_numpy()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(node), -1)
            starts = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
            counts = np.diff(np.r_[starts, len(band)])
            found = [prune(a, b, sig, sig.shape[1]) for a, b in _pairs(starts, counts)]
            a, b = (np.concatenate(x) for x in zip(*found))
            lab = roots(len(node), a, b)
            kept = np.flatnonzero(lab != np.arange(len(node)))
            edges = np.unique(np.stack([node[kept], node[lab[kept]]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

    parts = members.repartition("band").sortWithinPartitions("band", "node")
    return parts.mapInArrow(run, "a long, b long")


def coarse_groups(classes: DataFrame) -> DataFrame:
    """(node, bands, sig) to (node, root): groups outside which no link is probable."""
    bands = classes.select(F.explode("bands").alias("band"), "node")
    buckets = bands.groupBy("band").agg(F.count("*").alias("c"), F.min("node").alias("first")).filter("c > 1")
    members = settle(bands.join(buckets, "band"), "band-members")
    stars = members.filter((F.col("c") > BUCKET) & (F.col("node") != F.col("first"))).select(F.col("node").alias("a"), F.col("first").alias("b"))
    # The first 64 values are enough to part accidental neighbours; all of them are used on the groups.
    short = F.substring("sig", 1, 128).alias("sig")
    small = members.filter(F.col("c") <= BUCKET).select("band", "node").join(classes.select("node", short), "node")
    return components(stars.unionByName(bucket_edges(small)))


def _unit(node, weight, side, sets, sig, same: bool):
    """Links of one unit: (weights linked per row, edge ends a, b)."""
    n = len(node)
    left = np.arange(n) if same else np.flatnonzero(side == 0)
    right = np.arange(n) if same else np.flatnonzero(side == 1)
    size = np.array([len(s) for s in sets], np.int64)
    found = []
    for at in range(0, len(left), max(1, 1_000_000 // max(1, len(right)))):
        rows = left[at : at + max(1, 1_000_000 // max(1, len(right)))]
        a, b = np.repeat(rows, len(right)), np.tile(right, len(rows))
        low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        ok = (DEN * low >= NUM * high) & ((a < b) if same else True)
        found.append(prune(a[ok], b[ok], sig, VALUES))
    a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int),) * 2
    linked = np.zeros(n, np.int64)
    if not len(a):
        return linked, a, b
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    ids = [ids[e - s : e] for e, s in zip(ends, size)]
    mark = np.zeros(int(max(x.max() for x in ids)) + 1, bool)
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    cuts = np.flatnonzero(np.r_[True, a[1:] != a[:-1], True])
    true = np.zeros(len(a), bool)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        mark[ids[a[lo]]] = True
        for k in range(lo, hi):
            shared = np.count_nonzero(mark[ids[b[k]]])
            true[k] = (NUM + DEN) * shared >= NUM * (size[a[lo]] + size[b[k]])
        mark[ids[a[lo]]] = False
    a, b = a[true], b[true]
    np.add.at(linked, a, weight[b])
    np.add.at(linked, b, weight[a])
    return linked, a, b


def verify(docs: DataFrame, groups: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (node, other, links): exact links of the coarse groups. ``other`` is set on edges of a spanning forest."""
    sized = groups.join(classes.select("node", "n", "copies"), "node")
    totals = sized.groupBy("root").agg(F.count("*").alias("docs"), F.sum("n").alias("grams"))
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("long")
    placed = sized.join(totals.filter("docs > 1").select("root", blocks.alias("blocks")), "root")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    source = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    whole = placed.join(source, "node").select("node", "root", "block", "blocks", "copies", "text")

    def sets(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                g = gram_set(r["text"])
                if len(g):
                    s = signature(g).astype(np.uint16).tobytes()
                    for x in range(r["blocks"]):
                        i, j = min(r["block"], x), max(r["block"], x)
                        out.append((r["root"], i, j, int(r["block"] == j and i != j), r["node"], r["copies"], s, g.tobytes()))
                    if len(out) > 2000 or sum(len(o[-1]) for o in out[-50:]) > 1 << 25:
                        yield _batch(out)
                        out = []
            yield _batch(out)

    def _batch(rows):
        cols = list(zip(*rows)) if rows else [[]] * 8
        kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 2 + [pa.binary()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["root", "i", "j", "side", "node", "weight", "sig", "grams"])

    def compare(batches):
        for table in whole_runs(batches, ["root", "i", "j"]):
            root, i, j = (table.column(c).to_numpy() for c in ("root", "i", "j"))
            cuts = np.flatnonzero(np.r_[True, (root[1:] != root[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), True])
            nodes, others, links = [], [], []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi - lo < 2:
                    continue
                part = table.slice(lo, hi - lo)
                node, weight, side = (part.column(c).to_numpy() for c in ("node", "weight", "side"))
                once = np.unique(node, return_index=True)[1]  # rows that repeat a document
                node, weight, side, part = node[once], weight[once], side[once], part.take(pa.array(once))
                grams = [np.frombuffer(x, np.uint64) for x in part.column("grams").to_pylist()]
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(len(node), -1)
                linked, a, b = _unit(node, weight, side, grams, sig, i[lo] == j[lo])
                lab = roots(len(node), a, b)
                rows = np.flatnonzero(linked > 0)
                nodes.append(node[rows])
                others.append(node[lab[rows]])
                links.append(linked[rows])
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (nodes, others, links)], names=["node", "other", "links"])

    units = whole.mapInArrow(sets, "root long, i long, j long, side int, node long, weight long, sig binary, grams binary")
    units = units.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    return settle(units.mapInArrow(compare, "node long, other long, links long"), "links")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, copy_id (smallest doc_id with the same runs), class_id (smallest of the near-duplicate group), n_links.

    ``n_links`` counts the other documents at the threshold or above, copies included.
    """
    spark = docs.sparkSession
    facts = settle(describe(docs), "grams")
    member = facts.groupBy("doc_id").agg(F.max(F.struct("k1", "k2")).alias("k")).select("doc_id", "k.*")
    member = settle(member, "members")
    copies = member.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    classes = copies.join(facts.withColumnRenamed("doc_id", "node"), ["node", "k1", "k2"]).dropDuplicates(["node"])
    classes = settle(classes, "classes")
    release(spark)
    groups = coarse_groups(classes)
    release(spark)
    links = verify(docs, groups, classes)
    release(spark)
    near = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = (
        member.join(classes.select("node", "k1", "k2", "copies"), ["k1", "k2"])
        .join(near, "node", "left").join(counted, "node", "left")
        .select(
            F.col("doc_id").alias("_id"), "node", F.coalesce("root", "node").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        )
    )
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    out = ids.join(known, ids["doc_id"] == F.col("_id"), "left")
    return out.select(
        "doc_id", F.coalesce("node", ids["doc_id"]).alias("copy_id"), F.coalesce("root", ids["doc_id"]).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without all but the first of each near-duplicate group; rows that repeat its doc_id go too.

    Rows without a doc_id stay.
    """
    key = f"{own_prefix(docs)}id"
    drop = join(docs).filter("doc_id <> class_id").select(F.col("doc_id").alias(key))
    left = docs.join(drop, docs["doc_id"] == F.col(key), "left_anti")
    return left.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(docs.filter("doc_id IS NULL"))
