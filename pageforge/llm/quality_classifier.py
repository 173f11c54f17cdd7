"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A text is cut into words and runs of other signs. Features are hashed word
unigrams and bigrams, and unigrams and bigrams of word shapes (capitals, title,
lower case, digits, signs, and "as the word before"); each kind is scaled to sum
to one, so a score is four means of weights plus a bias: a sparse dot product.

Training uses a bounded sample (``max_rows``) of the labelled rows, chosen by a
hash of the id. The sample is dealt to ``shards`` tasks that each run FTRL over
their rows; their weights are averaged. Scoring covers every row and whole
texts; the weight table has a fixed size, which bounds its broadcast.

Defined results: null and empty texts score by the bias; null labels and labels
of unknown documents are ignored, a document labelled twice counts with its
lowest label; without labels every score is one half; rows without a doc_id are
scored and count as not held out; repeated rows score alike.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 18
SIZE = 1 << BITS
SHAPES = 8
TOTAL = SIZE + SHAPES + SHAPES * SHAPES
MAX_ROWS, SHARDS, EPOCHS = 20_000, 8, 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
THRESHOLD = 0.3
REMEMBERED = 200_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_P = np.uint64(0x9E3779B97F4A7C15)


class Codes(dict):
    """Token -> hash with its shape in the low three bits, remembered up to a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        first = token[0]
        if not (first.isalnum() or first == "_"):
            shape = 5
        elif token.isupper() and len(token) > 1:
            shape = 1
        elif token.istitle():
            shape = 2
        elif token.islower():
            shape = 3
        else:
            shape = 4 if token.isdigit() else 6
        code = self[token] = zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) << 3 | shape
        return code


def features(text: str | None, codes: Codes) -> list[np.ndarray]:
    """Index arrays, one per kind of feature."""
    tokens = _TOKEN.findall(text or "")
    c = np.fromiter(map(codes.__getitem__, tokens), np.uint64, len(tokens))
    if not len(c):
        return []
    h, shape = c >> np.uint64(3), (c & np.uint64(7)).astype(np.int64)
    again = np.r_[False, h[1:] == h[:-1]]
    shape[again] = 7
    uni = ((h * _P) >> np.uint64(64 - BITS)).astype(np.int64)
    out = [uni, SIZE + shape]
    if len(c) > 1:
        two = (h[:-1] * _P) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
        out += [((two * _P) >> np.uint64(64 - BITS)).astype(np.int64), SIZE + SHAPES + shape[:-1] * SHAPES + shape[1:]]
    return out


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def train(texts, marks, epochs: int = EPOCHS, seed: int = 1) -> tuple[np.ndarray, float]:
    """FTRL-proximal over the rows in permuted order; weights and bias."""
    codes, rows = Codes(), []
    for text in texts:
        kinds = features(text, codes)
        index = np.concatenate(kinds) if kinds else np.empty(0, np.int64)
        value = np.concatenate([np.full(len(k), 1 / len(k)) for k in kinds]) if kinds else np.empty(0)
        index, inverse = np.unique(index, return_inverse=True)
        rows.append((np.r_[index, TOTAL], np.r_[np.bincount(inverse, value, len(index)), 1.0]))
    z, n = np.zeros(TOTAL + 1), np.zeros(TOTAL + 1)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            i, x = rows[r]
            w = weights(i)
            g = (_sigmoid(float(w @ x)) - marks[r]) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weights(np.arange(TOTAL + 1))
    return w[:TOTAL], float(w[TOTAL])


def held_out(key: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, shards: int = SHARDS) -> tuple[np.ndarray, float]:
    """Averaged weights (a fixed number of them) and bias from the rows that are not held out."""
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, max_rows / max(1, marks.count()))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))
    rows = docs.select("doc_id", "text").filter(chosen).join(marks.filter(chosen), "doc_id")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(shards)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        w, bias = train(pdf["text"], (pdf["quality"].to_numpy() > 0).astype(float))
        at = np.flatnonzero(w)
        return pd.DataFrame({"i": np.r_[at, TOTAL], "w": np.r_[w[at], bias]})

    parts = rows.groupBy("shard").applyInPandas(run, "i long, w double")
    mean = parts.groupBy("i").agg(F.sum("w").alias("w"), F.count("*").alias("c")).toPandas()
    out = np.zeros(TOTAL + 1)
    if len(mean):
        out[mean["i"]] = mean["w"] / mean["c"].max()
    return out[:TOTAL], float(out[TOTAL])


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    def run(batches):
        weights, bias = sent.value
        codes = Codes()
        for batch in batches:
            got = [_sigmoid(bias + sum(float(weights[k].mean(dtype=np.float64)) for k in features(t.as_py(), codes))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
