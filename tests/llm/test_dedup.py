"""Dedup operators against brute force over whole small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageforge.llm import line_dedup, ngram_join, sentence_dedup, suffix_dedup
from pageforge.llm.graph import components

WORD = r"[^\x20\x09-\x0D]+"


def brute_sentences(texts):
    seen, out = set(), {}
    for k, t in sorted(texts.items()):
        p = sentence_dedup.sentences(t)
        assert "".join(p) == t
        n, gone = [" ".join(x.split()) for x in p], set()
        found = []
        for i in range(len(p)):
            n_words = 0
            for e in range(i, len(p)):
                n_words += len(n[e].split())
                if n_words >= sentence_dedup.WORDS and e + 1 - i >= sentence_dedup.RUN:
                    found.append((i, e + 1))
                    break
        for i, e in found or [(0, len(p))] * bool(p):
            key = tuple(n[i:e])
            if key in seen:
                gone.update(range(i, e))
            seen.add(key)
        out[k] = ("".join(x for i, x in enumerate(p) if i not in gone), len(gone))
    return out


def test_sentence_spans(small, texts):
    got = {r.doc_id: (r.text, r.n_removed) for r in sentence_dedup.dedup(small).collect()}
    assert got == brute_sentences(texts)
    assert sum(n for _, n in got.values()) > 0


def test_short_repeats_inside_a_text_stay(docs):
    """Three short sentences, and words that the cut isolates, are no run; a run of enough words is."""
    short = "It rained. It snowed. It froze. "
    cut = next(w for w in (f"c{i}" for i in range(99)) if zlib.crc32(w.encode()) % sentence_dedup.CUT == 0)
    words = lambda k, n: " ".join(f"a{k}b{i}" for i in range(n))
    rows = [(k, f"{words(k, 9)}. {short}{words(k + 10, 9)} {cut} {cut} {cut} {cut} {words(k + 20, 9)}.") for k in range(4)]
    assert {r.doc_id: r.text for r in sentence_dedup.dedup(docs(*rows)).collect()} == dict(rows)
    rows = [(k, f"{words(k, 9)}. {short * 4}{words(k + 10, 9)}.") for k in range(4)]
    got = {r.doc_id: r.text for r in sentence_dedup.dedup(docs(*rows)).collect()}
    assert got == dict(rows) | {k: rows[k][1].replace(short * 4, "") for k in (1, 2, 3)}


def test_removed_runs_have_the_documented_length(small, texts):
    """Whatever goes from a text that stays in part is a stretch of at least WORDS words."""
    for r in sentence_dedup.dedup(small).collect():
        if r.n_removed and r.text.strip():
            assert len(texts[r.doc_id].split()) - len(r.text.split()) >= sentence_dedup.WORDS


def test_long_passages_go_wherever_they_stand(docs):
    passage = " ".join(f"Wort{i}" for i in range(60))
    rows = [(k, " ".join(f"d{k}v{i}" for i in range(40 + k)) + " " + passage + f" end{k} of{k} text{k}.") for k in range(6)]
    got = {r.doc_id: r.text for r in sentence_dedup.dedup(docs(*rows)).collect()}
    assert got[0] == rows[0][1]
    for k in range(1, 6):
        left = got[k].split()
        assert f"d{k}v0" in left
        assert not any(passage.split()[i : i + 30] == left[j : j + 30] for i in (0, 15, 30) for j in range(len(left)))


def brute_bytes(texts, length=100):
    seen, out = set(), {}
    for k, t in sorted(texts.items()):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = True
            seen.add(s)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[k] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def suffix_rows(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(df).collect()}


@pytest.mark.parametrize("part", [512, 3])
def test_suffix_dedup(small, texts, part, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", part)
    assert suffix_rows(small) == brute_bytes(texts)


def test_suffix_dedup_periodic_and_overlapping(docs):
    base = "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(400))
    rows = [(1, "ab" * 300), (2, "x" * 250), (3, base), (4, base[:150] + "#" + base[100:399]), (5, base[1:100]), (6, base[30:130]), (7, "é" * 120 + base[:99])]
    assert suffix_rows(docs(*rows)) == brute_bytes(dict((k, t) for k, t in rows))


def brute_lines(texts):
    sets, every = {}, []
    for k, t in sorted(texts.items()):
        for j, line in enumerate(t.split("\n")):
            w = frozenset(re.findall(WORD, line))
            if w:
                every.append((k, j, w))
                sets.setdefault(w, (k, j))
    gone = defaultdict(set)
    for k, j, w in every:
        if sets[w] != (k, j):
            gone[k].add(j)
    order, index = sorted(sets, key=sets.get), defaultdict(list)
    df = Counter(x for w in order for x in w)
    for n, w in enumerate(order):
        least = sorted(w, key=lambda x: (df[x], x))[: len(w) - -(-4 * len(w) // 5) + 1]
        near = {i for x in least for i in index[x]}
        if any(9 * len(order[i] & w) >= 4 * (len(order[i]) + len(w)) for i in near):
            gone[sets[w][0]].add(sets[w][1])
        for x in least:
            index[x].append(n)
    return gone


def test_line_dedup(small, texts):
    want = brute_lines(texts)
    got = {r.doc_id: set(r.removed) for r in line_dedup.report(small).collect()}
    assert got == {k: want.get(k, set()) for k in texts}
    assert sum(map(len, got.values())) > 0


def test_line_dedup_texts(docs):
    rows = [(1, "a b c d e\n\nx"), (2, "a b c d e f\nx\nq r"), (3, None), (None, "x\nx"), (4, ""), (5, "x")]
    rows += [(6, "\n \nx\n\t"), (7, " \n")]
    got = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.drop_lines(docs(*rows)).collect()}
    # Documents 5 and 6 lose their only line with a word and go; 4 and 7 never had one.
    assert got == {1: (rows[0][1], len(rows[0][1])), 2: ("q r", 3), 3: (None, None), None: ("x\nx", 3), 4: ("", 0), 7: (" \n", 2)}


def test_line_dedup_long_lines(docs):
    """Lines on both sides of the sketch's size limit, at, above and below the similarity."""
    rng, rows = np.random.default_rng(7), []
    for n in (4, 9, 40, 90, 96, 97, 100, 108, 180, 400):
        base = [f"b{n}w{i}" for i in range(n)]
        for gone in (0, n // 9, n // 9 + 1, n // 5, n // 5 + 1):
            cut = base[gone:] + [f"n{n}g{gone}x{i}" for i in range(gone if gone <= n // 9 + 1 else 0)]
            rows.append(" ".join(rng.permutation(cut)))
    rows = [(k, line) for k, line in enumerate(rng.permutation(rows).tolist())]
    want = brute_lines(dict(rows))
    got = {r.doc_id: set(r.removed) for r in line_dedup.report(docs(*rows)).collect()}
    assert got == {k: want.get(k, set()) for k, _ in rows}
    assert 0 < sum(map(len, got.values())) < len(rows)


def test_line_dedup_reads_texts_once_per_step(small, monkeypatch):
    """Each line's set is built once, and the shuffled texts are no part of the step that shuffles the sets."""
    plans, settle = {}, line_dedup.settle

    def spy(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return settle(df, label)

    monkeypatch.setattr(line_dedup, "settle", spy)
    line_dedup.removed_lines(small)
    assert plans["lines"].count("split(_text") == 1
    assert "codes" in plans["matched-lines"] and "text#" not in plans["matched-lines"]


def brute_links(texts):
    sets = {}
    for k, t in texts.items():
        w = re.findall(WORD, t)
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    parent, links = {k: k for k in sets}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (find(k), links[k]) for k in keys}


@pytest.mark.parametrize("bucket,block", [(256, 512), (2, 2)])
def test_ngram_join(small, texts, bucket, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET", bucket)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(small).collect()}
    assert got == brute_links(texts)


def test_pruning_keeps_similar_pairs():
    assert ngram_join.least_equal(16) < ngram_join.least_equal(160) < 128
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    for shift, stays in ((100, True), (900, False)):  # Jaccard 900/1100 and 100/1900
        sig = np.stack([ngram_join.signature(base), ngram_join.signature(np.r_[base[shift:], rng.integers(0, 2**63, shift, dtype=np.uint64)])])
        kept, _ = ngram_join.prune(np.array([0]), np.array([1]), sig.astype(np.uint16), ngram_join.VALUES)
        assert (len(kept) == 1) == stays


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 99), (99, 98), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {98: 98, 99: 98, 100: 98}


def test_odd_rows(odd):
    ids = sorted(odd.select("doc_id").collect(), key=str)
    for got in (sentence_dedup.dedup(odd), suffix_dedup.dedup(odd), line_dedup.report(odd)):
        assert sorted(got.select("doc_id").collect(), key=str) == ids
    named = odd.withColumn("__id", F.lit(1)).withColumn("__gone", F.lit("x"))
    kept = line_dedup.drop_lines(named)
    # The copy of the long text and of the short one lose all their lines.
    assert kept.columns == named.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "6", "6", "None", "None"]
    one = ngram_join.keep_one(odd)
    assert one.columns == odd.columns
    assert sorted(str(r.doc_id) for r in one.collect()) == ["1", "2", "3", "4", "6", "None", "None"]


def test_empty_tables(odd):
    none = odd.limit(0)
    for got in (sentence_dedup.dedup(none), suffix_dedup.dedup(none), line_dedup.report(none), line_dedup.drop_lines(none), ngram_join.join(none), ngram_join.keep_one(none)):
        assert got.count() == 0
