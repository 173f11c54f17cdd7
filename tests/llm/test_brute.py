"""Models and pipeline stages against plain restatements over whole small tables."""

import math
import re
import sys
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageforge.llm import quality_classifier, quality_rules, queries
from tests.llm.test_dedup import brute_lines, brute_links
from tests.llm.test_models import MIDDLE, SMALL, WORD, brute_statistics, brute_targets

# --- quality rules ---------------------------------------------------------


def ratios(t):
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat = brute_statistics(t)
    n_lines = sum(bool(re.search(WORD, x)) for x in (t or "").split("\n"))
    share = lambda a, b: a / b if b else 0.0
    failed = n_words < 50 or 100 * n_repeat > 50 * n_words
    upper = sum(unicodedata.category(c) == "Lu" for c in t or "")
    return failed, {
        "words": float(n_words), "word_length": share(word_chars, n_words), "symbols_per_word": share(n_symbols, n_words),
        "dup_lines": share(n_dup_lines, n_lines), "repeats": share(n_repeat, n_words), "capitals": share(upper, word_chars),
        "line_length": share(n_words, n_lines),
    }


def holds(rule, row):
    return all(row[f] > b if above else row[f] <= b for f, above, b in rule)


def brute_rules(rows, grid=40):
    """Sequential covering on the rows themselves: (key, ratios, bad) of labelled rows that pass the base rules."""
    bounds = {}
    for f in quality_rules.FEATURES:
        values = set()
        for mark in (True, False):
            s = sorted(r[f] for _, r, bad in rows if bad == mark)
            if not s:
                return []
            values |= {s[max(1, math.ceil(i / grid * len(s))) - 1] for i in range(grid + 1)}
        v = sorted(values)
        bounds[f] = [(a + b) / 2 for a, b in zip(v, v[1:])]
    left, rules = rows, []
    while len(rules) < 8:
        grow = [(r, bad) for k, r, bad in left if zlib.crc32(str(k).encode()) % 3]
        keep = [(r, bad) for k, r, bad in left if zlib.crc32(str(k).encode()) % 3 == 0]
        rule = []
        while len(rule) < 4:
            now = [(r, bad) for r, bad in grow if holds(rule, r)]
            p0 = sum(bad for _, bad in now)
            if not p0 or p0 == len(now):
                break
            best, chosen = 0.0, None
            for f, cuts in bounds.items():
                for b in cuts:
                    for above in (False, True):
                        hit = [bad for r, bad in now if holds([(f, above, b)], r)]
                        if sum(hit) >= 5 and len(hit) < len(now):
                            gain = sum(hit) * (math.log2(sum(hit) / len(hit)) - math.log2(p0 / len(now)))
                            if gain > best:
                                best, chosen = gain, (f, above, b)
            if not chosen:
                break
            rule.append(chosen)
        tried = []
        for n in range(1, len(rule) + 1):
            hit = [bad for r, bad in keep if holds(rule[:n], r)]
            p, q = sum(hit), len(hit) - sum(hit)
            tried.append(((p - q) / max(1, p + q), p, -n))
        if not tried or max(tried)[1] < 1:
            break
        worth, p, n = max(tried)
        hit = [bad for r, bad in keep if holds(rule[:-n], r)]
        if p / len(hit) < 0.95:
            break
        rules.append(rule[:-n])
        left = [x for x in left if not holds(rules[-1], x[1])]
    return rules


def brute_kept(texts, labels):
    """doc_id -> (base_failed, kept), and the list."""
    marks = {}
    for k, quality in labels:
        if quality is not None:
            marks[k] = min(quality, marks.get(k, quality))
    seen = {k: ratios(t) for k, t in texts.items()}
    rules = brute_rules([(k, seen[k][1], marks[k] == 0) for k in texts if k in marks and not seen[k][0]])
    return {k: (failed, not failed and not any(holds(r, row) for r in rules)) for k, (failed, row) in seen.items()}, rules


def test_rules_as_covering_on_the_rows(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()]
    want, rules = brute_kept(texts, labels)
    assert rules and {r.doc_id: (r.base_failed, r.kept) for r in queries.QUERIES["op9_quality_rules"](spark, MIDDLE).collect()} == want


# --- quality classifier ----------------------------------------------------

BIG = 1 << 64


def brute_features(text):
    """Index -> value; each of the four kinds sums to one."""
    tokens, kinds, before = re.findall(r"\w+|[^\w\s]+", text or ""), [[], [], [], []], None
    for t in tokens:
        h = zlib.crc32(t.lower().encode())
        if before and h == before[0]:
            shape = 7
        elif not (t[0].isalnum() or t[0] == "_"):
            shape = 5
        elif t.isupper() and len(t) > 1:
            shape = 1
        else:
            shape = 2 if t.istitle() else 3 if t.islower() else 4 if t.isdigit() else 6
        kinds[0].append((h * 0x9E3779B97F4A7C15 % BIG) >> 46)
        kinds[1].append(2**18 + shape)
        if before:
            two = (before[0] * 0x9E3779B97F4A7C15 % BIG) ^ (h * 0xC2B2AE3D27D4EB4F % BIG)
            kinds[2].append((two * 0x9E3779B97F4A7C15 % BIG) >> 46)
            kinds[3].append(2**18 + 8 + before[1] * 8 + shape)
        before = (h, shape)
    x = defaultdict(float)
    for kind in kinds:
        for i in kind:
            x[i] += 1 / len(kind)
    return {**x, "bias": 1.0}


def sigmoid(s):
    return 1 / (1 + math.exp(-s))


def brute_weights(rows, alpha=0.5, beta=1.0, l1=1e-4, l2=1e-4, epochs=4):
    """Follow the regularised leader, one coordinate at a time; rows are (features, mark)."""
    z, n = defaultdict(float), defaultdict(float)

    def w(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    rng = np.random.default_rng(1)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            x, mark = rows[r]
            now = {i: w(i) for i in x}
            error = sigmoid(sum(now[i] * x[i] for i in x)) - mark
            for i in x:
                g = error * x[i]
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * now[i]
                n[i] += g * g
    return {i: w(i) for i in list(z)}


def test_classifier_as_plain_updates(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    marks = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    x = {r.doc_id: brute_features(r.text) for r in docs.collect()}
    shards = defaultdict(list)
    for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(3)).alias("s")).orderBy("doc_id").collect():
        if r.doc_id in marks:
            shards[r.s].append((x[r.doc_id], float(marks[r.doc_id] > 0)))
    mean = defaultdict(float)
    for rows in shards.values():
        for i, v in brute_weights(rows).items():
            mean[i] += v / len(shards)
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, quality_classifier.fit(docs, labels, shards=3)).collect()}
    assert len(shards) == 3 and got == pytest.approx({k: sigmoid(sum(mean[i] * v for i, v in f.items())) for k, f in x.items()}, abs=1e-5)


# --- pipeline --------------------------------------------------------------


def wrapped(text, width):
    w = re.findall(WORD, text)
    return "\n".join(" ".join(w[i : i + width]) for i in range(0, len(w), width))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """The small documents with some wrapped anew (only the n-gram join sees these copies) and some lines repeated."""
    folder = tmp_path_factory.mktemp("corpus")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    full = [r for r in rows if r[1] and 80 < len(r[1].split()) < 2000]
    rows += [(10_000 + i, wrapped(r[1], 17 + i % 5), *r[2:]) for i, r in enumerate(full[:12])]
    rows += [(20_000 + i, f"{r[1]}\n{full[i + 1][1]}", *r[2:]) for i, r in enumerate(full[20:30])]
    rows += [(30_000, None, *rows[0][2:]), (30_001, "", *rows[0][2:])]
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_stages_as_brute_force(spark, corpus):
    """Each stage on what the one before kept."""
    sys.path.insert(0, ".")
    import corpus_pipeline
    from tokenizers import Tokenizer

    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{corpus}/documents.parquet")

    def step(name, docs):
        rows = stages[name](spark, docs, corpus).collect()
        return rows, spark.createDataFrame(rows, docs.schema)

    before = {r.doc_id: r for r in docs.collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{corpus}/labels.parquet").collect()]
    want, _ = brute_kept({k: r.text for k, r in before.items()}, labels)
    rows, docs = step("quality rules", docs)
    assert sorted(rows) == sorted(r for k, r in before.items() if want[k][1]) and 0 < len(rows) < len(before)

    before, gone, want = {r.doc_id: r for r in rows}, brute_lines({r.doc_id: r.text for r in rows}), []
    for k, r in before.items():
        left = [x for j, x in enumerate(r.text.split("\n")) if j not in gone.get(k, ())]
        if any(re.search(WORD, x) for x in left):
            text = "\n".join(left)
            want.append((k, text, r.lang, r.source, r.n_chars if k not in gone else len(text)))
    rows, docs = step("line dedup", docs)
    assert sorted(map(tuple, rows)) == sorted(want) and sum(map(len, gone.values())) > 5

    groups = brute_links({r.doc_id: r.text for r in rows})
    want = [r for r in rows if groups[r.doc_id][0] == r.doc_id]
    rows, docs = step("n-gram Jaccard join", docs)
    assert sorted(rows) == sorted(want) and len(want) <= len(groups) - 8

    sizes, taken, known = Counter(), Counter(), {r.doc_id: r for r in rows}
    words = {k: len(re.findall(WORD, r.text)) for k, r in known.items()}
    for k, r in known.items():
        sizes[r.source] += words[k]
    rows, docs = step("mixing sources", docs)
    copies = Counter(r.doc_id for r in rows)
    assert all(tuple(r) == tuple(known[r.doc_id]) for r in rows) and max(copies.values()) <= 3
    for k, n in copies.items():
        taken[known[k].source] += n * words[k]
    for s, goal in brute_targets(sizes).items():
        least = max(words[k] for k, r in known.items() if r.source == s)
        assert abs(taken[s] - goal) <= max(0.02 * goal, least / 2)

    whole, cover, sequences = Tokenizer.from_file(queries.tokenizer_path()), {}, defaultdict(list)
    ids = {k: np.array([*whole.encode(known[k].text, add_special_tokens=False).ids, 0], "<u4") for k in copies}
    for r in stages["packing"](spark, docs, corpus).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        cover.setdefault(r.doc_id, np.zeros(r.doc_tokens, int))[r.start : r.start + r.length] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(cover) == set(copies) and all((cover[k] == copies[k]).all() for k in copies)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_pipeline_odd_rows(spark, odd, tmp_path):
    """Nulls, repeated rows, clashing names and an empty table pass every stage."""
    sys.path.insert(0, ".")
    import corpus_pipeline

    labels = spark.createDataFrame([(1, None), (4, 1), (6, 0)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    named = odd.withColumn("__id", F.lit(1)).withColumn("__source", F.lit("x")).withColumn("__size", F.lit(2)).withColumn("__copies", F.lit(3))
    for docs in (named, named.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == named.columns and out.count() <= 3 * docs.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()
