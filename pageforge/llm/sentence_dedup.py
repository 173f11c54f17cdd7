"""Substring dedup by sentence spans.

A text is cut into sentences (after . ! ? before white space, and at line ends).
Sentences of more than ``LONG`` words are cut further after words that a hash
picks, so that a passage is cut alike wherever it stands. A run starts at any
sentence and goes on until it has at least ``RUN`` sentences and ``WORDS`` words,
so nothing shorter than ``WORDS`` words is ever removed from inside a text. Every
run is hashed; a run that also stands earlier (smaller doc_id, or same document
and earlier place) is removed with all its sentences.

A run's first document is a minimum, combined before the shuffle; only hashes of
runs are shuffled, and runs of one document are compared inside its row.

Defined results: white space inside a sentence does not count; a text
without a whole run is one run of all its sentences; null and empty texts have none;
rows without a doc_id take no part and come back as they are; rows that repeat a
doc_id are the same document; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageforge.llm.common import release, settle

RUN, WORDS, LONG, CUT = 3, 20, 16, 5
_END = re.compile(r"[.!?]+\s+|\s*\n\s*")
_WORD = re.compile(r"\s*\S+\s*")
_P = 0x9E3779B97F4A7C15
_BACK = pow(_P, -1, 1 << 64)


def sentences(text: str) -> list[str]:
    """Pieces that join to the text again."""
    out, at = [], 0
    for m in _END.finditer(text):
        out.append(text[at : m.end()])
        at = m.end()
    if at < len(text):
        out.append(text[at:])
    short = []
    for s in out:
        if len(s) <= LONG * 2 or s.count(" ") < LONG:
            short.append(s)
            continue
        piece = []
        for w in _WORD.findall(s):
            piece.append(w)
            if zlib.crc32(w.strip().encode("utf-8", "surrogatepass")) % CUT == 0:
                short.append("".join(piece))
                piece = []
        if piece:
            short.append("".join(piece))
    return short


def run_ends(pieces: list[list[str]]) -> np.ndarray:
    """Where the run that starts at each sentence ends; runs that the text ends too early for are left out."""
    if not pieces:
        return np.empty(0, np.int64)
    n = len(pieces)
    before = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    ends = np.maximum(np.arange(n) + RUN, np.searchsorted(before, before[:-1] + WORDS))
    ends = ends[ends <= n]
    return ends if len(ends) else np.array([n])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def runs(sentences_: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and end of the runs, by their first sentence; white space at the ends and its kind do not count.

    The hash of a run is a polynomial over its sentences, read off sums from the start.
    """
    pieces = [p.split() for p in sentences_]
    ends = run_ends(pieces)
    if not len(ends):
        return np.empty(0, np.uint64), ends
    h = np.array([xxhash.xxh3_64_intdigest(" ".join(p).encode("utf-8", "surrogatepass")) for p in pieces], np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_P, len(h)), dtype=np.uint64)])
    out = (sums[ends] - sums[: len(ends)]) * _powers(_BACK, len(ends))
    out = (out ^ (out >> np.uint64(29))) * np.uint64(_P) + (ends - np.arange(len(ends))).astype(np.uint64)
    return out ^ (out >> np.uint64(32)), ends


def _first_here(h: np.ndarray) -> np.ndarray:
    """Places at which a hash stands for the first time in its document."""
    return np.sort(np.unique(h, return_index=True)[1])


def spans(docs: DataFrame) -> DataFrame:
    """(h, doc_id, i): the runs of each document, each once."""

    def run(batches):
        for batch in batches:
            hashes, ids, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                h, _ = runs(sentences(text.as_py() or ""))
                at = _first_here(h)
                hashes.append(h[at])
                ids.append(np.full(len(at), key, np.int64))
                places.append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(places))], names=["h", "doc_id", "i"]
            )

    source = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    return source.mapInArrow(run, "h long, doc_id long, i int")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Settled (doc_id, spans array<int>): runs that stand in an earlier document."""
    every = settle(spans(docs), "spans")
    known = every.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    known = known.filter("first < last").select("h", "first")
    later = every.join(known, "h").filter("doc_id > first")
    return settle(later.groupBy("doc_id").agg(F.collect_set("i").alias("spans")), "later-spans")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows with their text deduplicated, and ``n_sentences``, ``n_removed``, ``kept_sha256``; other columns are left out."""
    found = repeated_spans(docs)
    release(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts, counts, gone, sums = [], [], [], []
            for key, text, later in zip(*(batch.column(i) for i in range(3))):
                text, pieces = text.as_py(), sentences(text.as_py() or "")
                covered = np.zeros(len(pieces), bool)
                if key.is_valid:
                    h, ends = runs(pieces)
                    again = np.ones(len(h), bool)
                    again[_first_here(h)] = False
                    for i in [*np.flatnonzero(again).tolist(), *[x for x in later.as_py() or () if x < len(h)]]:
                        covered[i : ends[i]] = True
                kept = text if text is None else "".join(p for p, c in zip(pieces, covered) if not c)
                texts.append(kept)
                counts.append(len(pieces))
                gone.append(int(covered.sum()))
                sums.append(hashlib.sha256((kept or "").encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())],
                names=["doc_id", "text", "n_sentences", "n_removed", "kept_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", "text").join(found, "doc_id", "left")
    return source.mapInArrow(run, f"doc_id {kind}, text string, n_sentences long, n_removed long, kept_sha256 string")
