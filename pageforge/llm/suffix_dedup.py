"""Suffix-array dedup: repeated byte strings found by distributed prefix doubling.

A byte goes when it lies in a string of ``LENGTH`` bytes that also starts
earlier (smaller doc_id, or same document and earlier place). Positions are
ranked by strings of growing length, and every round drops the positions whose
rank is already unique or whose answer is already known:

1. Seeds: positions ranked by their ``SEED`` bytes. Only minima of a window are
   taken (winnowing): every string of ``LENGTH`` bytes holds one, and equal
   strings hold the same one at the same place. A unique seed cannot lie in a
   repeated string, and a group's first seed only lies in first strings.
2. Shared seeds are ranked again by the pair (seed rank, rank of the context of
   all strings around the seed). A context that stands earlier settles all of
   its strings at once.
3. A string around a seed reaches ``HALF`` bytes beyond it on one side at least.
   First contexts are ranked by the seed and that much on either side; a context
   whose ranks are both unique holds no repeated string and drops out.
4. The others are ranked string by string: ranks at
   offsets 1, 2, 4, ... are paired and doubled up to ``LENGTH``, sorted within
   (seed, salt) groups, and the first of each is found. Salts split large seeds
   into parts of bounded size; what is first in its part meets the others by a
   minimum that is combined before the shuffle.

Spark sorts, groups and joins the ranks; ranks are 64-bit hashes of the strings
(a string's rank is compared within its seed's group only). No group of equal
strings is gathered.

Defined results: null and empty texts have no bytes; rows without a doc_id take
no part and lose nothing; rows that repeat a doc_id are the same document; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageforge.llm.common import release, settle, whole_runs

LENGTH, SEED = 100, 24
WINDOW = LENGTH - SEED + 1
BEFORE = LENGTH - SEED
CONTEXT = BEFORE + LENGTH
HALF = (BEFORE + 1) // 2
PART = 4096
SLICE = 1 << 20

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (a >> np.uint64(31))) * _A + b * _B
    return h ^ (h >> np.uint64(29))


def ranks(values: np.ndarray, length: int) -> np.ndarray:
    """Ranks of all strings of ``length`` along the last axis: pairs of ranks at doubling offsets."""
    out, have, step, width = None, 0, values.astype(np.uint64) + np.uint64(1), 1
    while True:
        if length & width:
            if out is None:
                out, have = step, width
            else:
                n = out.shape[-1] - width
                out, have = _pair(out[..., :n], step[..., have : have + n]), have + width
        if 2 * width > length:
            return out
        n = step.shape[-1] - width
        step, width = _pair(step[..., :n], step[..., width:]), 2 * width


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    reach, w = values, 1
    while 2 * w <= width:
        reach, w = pick(reach[:-w], reach[w:]), 2 * w
    n = len(values) - width + 1
    return pick(reach[:n], reach[width - w : width - w + n])


def seeds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ranks and places of the seeds of one text, in slices of bounded size."""
    found = [(np.empty(0, np.uint64), np.empty(0, np.int64))]
    for at in range(0, len(text), SLICE):
        lo, hi = max(0, at - LENGTH), min(len(text), at + SLICE + 2 * LENGTH)
        if hi - lo < LENGTH:
            continue
        h = ranks(np.frombuffer(text, np.uint8, hi - lo, lo), SEED)
        low = _sliding(h, WINDOW, np.minimum)
        # A seed is the minimum of some window around it: compare with the largest of their minima.
        edge = np.zeros(WINDOW - 1, np.uint64)
        high = _sliding(np.concatenate([edge, low, edge]), WINDOW, np.maximum)
        place = np.flatnonzero(high == h)
        rank, place = h[place], place + lo
        own = (place >= at) & (place < at + SLICE)
        found.append((rank[own], place[own]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _bytes(value) -> bytes:
    return (value.as_py() or "").encode("utf-8", "surrogatepass")


def _named(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")


def _all_seeds(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            rank, ids, place = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                r, p = seeds(_bytes(text))
                rank.append(r)
                place.append(p)
                ids.append(np.full(len(r), key, np.int64))
            if rank:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(rank).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(place).astype(np.int64))],
                    names=["h", "doc_id", "at"],
                )

    return settle(_named(docs).mapInArrow(run, "h long, doc_id long, at long"), "seeds")


def _shared_seeds(every: DataFrame) -> DataFrame:
    """Settled, per document: its seeds that stand twice or more, with the first document of each."""
    known = every.groupBy("h").agg(F.count("*").alias("c"), F.min("doc_id").alias("first_doc")).filter("c > 1").drop("c")
    return settle(every.join(known, "h").select("h", "doc_id", "at", "first_doc"), "shared-seeds")


def _per_document(rows: DataFrame, *names: str) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("_seeds"))


def _columns(lists, *names: str) -> list[np.ndarray]:
    flat = lists.flatten()
    return [flat.field(n).to_numpy(zero_copy_only=False) for n in names]


def _contexts(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """Settled (h, x, left, right, doc_id, at, first, first_x).

    x ranks the context, left and right the seed with ``HALF`` bytes before or after
    it (null where the text ends first); flags for the first in the group and in the document.
    """

    def run(batches):
        for batch in batches:
            h, place, first_doc = _columns(batch.column(2), "h", "at", "first_doc")
            ends = batch.column(2).offsets.to_numpy() - batch.column(2).offsets.to_numpy()[0]
            out = [[np.empty(0, np.int64)] * 4 + [np.empty(0, bool)] * 2 + [np.empty(0, np.int64), np.empty(0, bool)] * 2]
            for k, (key, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                data, s = _bytes(text), slice(ends[k], ends[k + 1])
                order = np.unique(place[s], return_index=True)[1]
                hh, pp, dd = h[s][order], place[s][order], first_doc[s][order]
                x = np.array(
                    [xxhash.xxh3_64_intdigest(data[max(0, p - BEFORE) : p + LENGTH], seed=min(p, BEFORE)) for p in pp.tolist()], np.uint64
                ).view(np.int64)
                part = lambda lo, hi: np.array([xxhash.xxh3_64_intdigest(data[max(0, p + lo) : p + hi]) for p in pp.tolist()], np.uint64).view(np.int64)  # noqa: E731, B023
                left, right = part(-HALF, SEED), part(0, SEED + HALF)
                no_left, no_right = pp < HALF, pp + SEED + HALF > len(data)
                first_h, first_x = np.zeros(len(hh), bool), np.zeros(len(hh), bool)
                first_h[np.unique(hh, return_index=True)[1]] = True
                first_x[np.unique(np.stack([hh, x]), axis=1, return_index=True)[1]] = True
                out.append([hh, x, np.full(len(hh), key, np.int64), pp, first_h & (dd == key), first_x, left, no_left, right, no_right])
            h_, x_, doc, at, first, first_x, left, no_left, right, no_right = (np.concatenate(c) for c in zip(*out))
            columns = [pa.array(h_), pa.array(x_), pa.array(left, mask=no_left), pa.array(right, mask=no_right), pa.array(doc), pa.array(at), pa.array(first), pa.array(first_x)]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "x", "left", "right", "doc_id", "at", "first", "first_x"])

    source = _named(docs).join(_per_document(shared, "h", "at", "first_doc"), "doc_id").select("doc_id", "text", "_seeds")
    return settle(source.mapInArrow(run, "h long, x long, left long, right long, doc_id long, at long, first boolean, first_x boolean"), "contexts")


def _ranked_contexts(contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Settled (doc_id, at) of contexts that stand earlier, and (h, salts, doc_id, at) of first ones that need a closer look."""
    firsts = contexts.groupBy("h", "x").agg(F.min("doc_id").alias("x_doc"))
    many = firsts.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    ranked = contexts.join(firsts, ["h", "x"])
    earlier = ~(F.col("first_x") & (F.col("doc_id") == F.col("x_doc")))
    ranked = settle(ranked.select("h", "left", "right", "doc_id", "at", earlier.alias("earlier")), "ranked-contexts")
    several = settle(ranked.filter("NOT earlier").join(many.select("h"), "h").drop("earlier"), "several-contexts")
    twice = lambda side: several.groupBy("h", side).agg(F.count("*").alias("c")).filter("c > 1").drop("c")
    either = [several.join(twice(side), ["h", side], "left_semi").select("h", "doc_id", "at") for side in ("left", "right")]
    open_ = settle(either[0].union(either[1]).distinct(), "repeated-halves")
    sizes = open_.groupBy("h").agg(F.ceil(F.count("*") / PART).cast("int").alias("salts"))
    return ranked.filter("earlier").select("doc_id", "at"), settle(open_.join(sizes, "h"), "open-contexts")


def _merge(doc: np.ndarray, place: np.ndarray):
    """Sorted string starts to (doc_id, from, to) of what they cover."""
    if not len(doc):
        return doc, place, place
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + LENGTH)])
    last = np.r_[cut[1:], len(doc)] - 1
    return doc[cut], place[cut], place[last] + LENGTH


def _doubled(docs: DataFrame, open_: DataFrame) -> DataFrame:
    """Settled (doc_id, lo, hi, h, w): covered ranges (w null), and strings first in their part of a split seed (w their rank)."""

    def cut(batches):
        for batch in batches:
            h, salts, place = _columns(batch.column(2), "h", "salts", "at")
            ends = batch.column(2).offsets.to_numpy() - batch.column(2).offsets.to_numpy()[0]
            data, ids = [], np.repeat(batch.column(0).to_numpy(), np.diff(ends))
            left = np.minimum(place, BEFORE).astype(np.int32)
            for k, text in enumerate(batch.column(1)):
                raw = _bytes(text)
                data += [raw[max(0, p - BEFORE) : p + LENGTH] for p in place[ends[k] : ends[k + 1]].tolist()]
            salt = (_pair(ids.view(np.uint64), ids.view(np.uint64)) % salts.astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(salt), pa.array(salts > 1), pa.array(ids), pa.array(place), pa.array(left), pa.array(data, pa.binary())],
                names=["h", "salt", "split", "doc_id", "at", "before", "data"],
            )

    def compare(batches):
        for table in whole_runs(batches, ["h", "salt"]):
            yield from _compare(table)

    def _compare(table):
        h, salt, split, ids, place, before = (table.column(c).to_numpy() for c in ("h", "salt", "split", "doc_id", "at", "before"))
        data = table.column("data").to_pylist()
        grid = np.zeros((len(h), CONTEXT), np.uint8)
        length = np.array([len(d) for d in data])
        column = np.arange(CONTEXT)
        inside = (column >= (BEFORE - before)[:, None]) & (column < (BEFORE - before + length)[:, None])
        grid[inside] = np.frombuffer(b"".join(data), np.uint8)
        rank = ranks(grid, LENGTH)
        starts = np.arange(rank.shape[1])
        whole = (starts >= (BEFORE - before)[:, None]) & (starts + LENGTH <= (BEFORE - before + length)[:, None])
        row, s = np.nonzero(whole)
        w, doc, p = rank[row, s], ids[row], place[row] - BEFORE + s
        group = _pair(_pair(h.view(np.uint64), salt.astype(np.uint64))[row], w)
        order = np.lexsort((p, doc, group))
        group, w, doc, p, row = group[order], w[order], doc[order], p[order], row[order]
        new = np.r_[True, group[1:] != group[:-1]]
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (doc != doc[lead]) | (p != p[lead])
        again = np.unique(np.stack([doc[later], p[later]], 1), axis=0)
        d, lo, hi = _merge(again[:, 0], again[:, 1])
        keep = ~later & split[row]
        none = pa.nulls(len(d), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(lo), pa.array(hi), none, none], names=["doc_id", "lo", "hi", "h", "w"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[keep]), pa.array(p[keep]), pa.array(p[keep] + LENGTH), pa.array(h[row[keep]]), pa.array(w[keep].view(np.int64))],
            names=["doc_id", "lo", "hi", "h", "w"],
        )

    source = _named(docs).join(_per_document(open_, "h", "salts", "at"), "doc_id").select("doc_id", "text", "_seeds")
    parts = source.mapInArrow(cut, "h long, salt int, split boolean, doc_id long, at long, before int, data binary")
    parts = parts.repartition("h", "salt").sortWithinPartitions("h", "salt", "doc_id", "at")
    return settle(parts.mapInArrow(compare, "doc_id long, lo long, hi long, h long, w long"), "doubled")


def _across_parts(doubled: DataFrame) -> DataFrame:
    """(doc_id, lo, hi) of strings of split seeds that are first in their part but stand earlier in another one."""
    kept = doubled.filter("w IS NOT NULL")
    firsts = kept.groupBy("h", "w").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    return kept.join(firsts.drop("last"), ["h", "w"]).filter("doc_id > first").select("doc_id", "lo", "hi")


def covered(docs: DataFrame) -> DataFrame:
    """Settled (doc_id, ranges array<struct<lo, hi>>): byte ranges that go, unsorted and overlapping; ``hi`` may pass the end."""
    spark = docs.sparkSession
    every = _all_seeds(docs)
    shared = _shared_seeds(every)
    release(spark)
    contexts = _contexts(docs, shared)
    release(spark)
    earlier, open_ = _ranked_contexts(contexts)
    release(spark)
    doubled = _doubled(docs, open_)
    release(spark)
    ranges = earlier.select("doc_id", F.greatest(F.col("at") - BEFORE, F.lit(0)).alias("lo"), (F.col("at") + LENGTH).alias("hi"))
    ranges = ranges.unionByName(doubled.filter("w IS NULL").select("doc_id", "lo", "hi")).unionByName(_across_parts(doubled))
    out = settle(ranges.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "ranges")
    release(spark)
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the bytes that stay, ``kept``, per input row."""
    found = covered(docs)

    def run(batches):
        for batch in batches:
            out = []
            for key, text, ranges in zip(*(batch.column(i) for i in range(3))):
                data = _bytes(text)
                steps = np.zeros(len(data) + 1, np.int64)
                for r in ranges.as_py() or ():
                    steps[min(r["lo"], len(data))] += 1
                    steps[min(r["hi"], len(data))] -= 1
                gone = np.cumsum(steps[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((key.as_py(), len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out)) if out else [[]] * 6
            kinds = [batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", "text").join(found, "doc_id", "left")
    return source.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
