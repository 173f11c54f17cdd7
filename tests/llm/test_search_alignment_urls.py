"""Ranked lexical search, cross-tokenizer alignment and URL filters against plain versions of their definitions."""

import hashlib
import random
import re
import tracemalloc
from array import array
from collections import Counter
from math import floor, log
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pageforge.llm import lexical_search, queries, token_alignment, url_filters

SMALL = "/root/testdata/sf0.001"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


# Lexical search


def terms_of(text):
    return re.findall(TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(rows, items, k):
    """[(item_id, rank, doc_id, score)] by scoring every document for every item."""
    docs = [(d, terms_of(t)) for d, t in rows if d is not None]
    docs = [(d, ts) for d, ts in docs if ts]
    n_all, l_all = len(docs), sum(len(ts) for _, ts in docs)
    df = Counter(t for _, ts in docs for t in set(ts))
    asked = {}
    for i, text in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms_of(text))
    out = []
    for i, wanted in asked.items():
        scored = []
        for d, ts in docs:
            tf, m = Counter(ts), 100 - 50 + (50 * len(ts) * n_all) // l_all
            score = sum(floor(1000 * log((2 * n_all + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in wanted if t in tf)
            if score > 0:
                scored.append((score, d))
        scored.sort(key=lambda x: (-x[0], x[1]))
        out += [(i, r + 1, d, s) for r, (s, d) in enumerate(scored[:k])]
    return sorted(out)


def found(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(tuple(r) for r in df.collect())


def items_frame(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("blocks", [(8_192, 2_000_000), (7, 2_000_000), (8_192, 40)])
def test_search_is_exact_in_blocks_of_any_size(spark, docs, monkeypatch, blocks):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", blocks[0])
    monkeypatch.setattr(lexical_search, "BLOCK_POSTINGS", blocks[1])
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(150)]
    rows += [(200 + i, rows[5][1]) for i in range(6)]  # ties
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(12)] + [(50, "w1 w2 w1"), (51, "absent")]
    for k in (1, 5, 300):
        got = found(lexical_search.search(docs(*rows).repartition(3), items_frame(spark, items), k=k))
        assert got == brute_search(rows, items, k)


def test_search_odd_input(spark, docs, odd):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    items = [(1, "ONE two"), (1, "three"), (None, "one"), (2, None), (3, " . "), (4, "w5x5 ONE"), (4, "w5x5 ONE")]
    frame = items_frame(spark, items).withColumn("doc_id", F.lit(7)).withColumn("score", F.lit("x")).withColumn("term", F.lit(0))
    assert found(lexical_search.search(odd, frame)) == brute_search(rows, items, 50)
    assert found(lexical_search.search(odd.limit(0), frame)) == []
    assert found(lexical_search.search(odd, frame.limit(0))) == []
    accents = [(1, "Élan ÉLAN élan a.b_c-d 9É"), (2, "élan"), (3, "\x7fÉlan\x00")]
    asked = [(1, "ÉLAN élan"), (2, "B 9É")]
    assert found(lexical_search.search(docs(*accents), items_frame(spark, asked))) == brute_search(accents, asked, 50)


def test_search_in_several_passes(spark, docs, monkeypatch):
    monkeypatch.setattr(lexical_search, "PASS_TERMS", 5)
    rows = [(i, f"a b{i % 3} c{i % 5} d{i}") for i in range(20)]
    items = [(i, f"a b{i} c{i} d{i}") for i in range(6)]
    assert found(lexical_search.search(docs(*rows), items_frame(spark, items), k=4)) == brute_search(rows, items, 4)


def test_accumulators_are_limited():
    """Rare terms decide, so documents that hold the common one alone get no accumulator."""
    best, n = lexical_search.Best(2), 1000
    rare = (900, np.arange(3, dtype=np.int32), np.full(3, 900))
    common = (10, np.arange(n, dtype=np.int32), np.full(n, 10))
    assert lexical_search.search_block(best, np.arange(n), [rare, common]) == 3
    assert best.doc.tolist() == [0, 1] and best.score.tolist() == [910, 910]
    # The next block starts at the score that is to be beaten.
    assert lexical_search.search_block(best, np.arange(n, 2 * n), [common]) == 0


def test_search_query_on_the_small_tables(spark, small):
    rows = [tuple(r) for r in small.select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    assert found(queries.op11_lexical_search(spark, SMALL)) == brute_search(rows, items, 50)


# Alignment


@pytest.fixture(scope="module")
def files():
    return queries.tokenizer_path(token_alignment.A_FILE), queries.tokenizer_path(token_alignment.B_FILE)


@pytest.fixture(scope="module")
def brute_align(files):
    """Rows by whole texts, the tokenizers' own libraries, and all pairs of tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(files[0]), sentencepiece.SentencePieceProcessor(model_file=files[1])
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def spans(parts):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return list(zip([0, *ends], ends))

    def run(rows):
        cut = []
        for key, text in rows:
            whole = " " + (text or "")
            a_ids, b_ids = a.encode(whole, add_special_tokens=False).ids, b.encode(text or "")
            a_parts, b_parts = [bytes(byte[c] for c in a.id_to_token(i)) for i in a_ids], [piece(i) for i in b_ids]
            if not text or b"".join(a_parts) != whole.encode() or b"".join(b_parts) != whole.encode():
                cut.append((key, [], [], [], ""))
                continue
            a_spans, b_spans = spans(a_parts), spans(b_parts)
            links = [(a_ids[i], b_ids[k]) for i, (x, y) in enumerate(a_spans) for k, (u, v) in enumerate(b_spans) if x < v and u < y]
            groups, lo = [], 0
            for end in sorted({y for _, y in a_spans} & {y for _, y in b_spans}):
                mine = [",".join(str(i) for i, (_, y) in zip(ids, s) if lo < y <= end) for ids, s in ((a_ids, a_spans), (b_ids, b_spans))]
                groups.append("|".join(mine))
                lo = end
            cut.append((key, a_ids, b_ids, links, ";".join(groups)))
        count = Counter(p for *_, links, _ in cut for p in links)
        highest = Counter()
        for (_, y), n in count.items():
            highest[y] = max(highest[y], n)
        out = []
        for key, a_ids, b_ids, links, groups in cut:
            best, total = sum(count[p] == highest[p[1]] for p in links), sum(count[p] for p in links)
            digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
            out.append((key, len(a_ids), len(b_ids), groups.count(";") + bool(groups), len(links), best, total, digest))
        return sorted(out, key=str)

    return run


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def aligned(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


ODD_TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a b", "a\nb", "a \nb", "a \n b", "a\n b", "\n a", "a\t b \t c", "x\u00a0 y", "x \u00a0y", "\x1c a \x1cb",
    "<|endoftext|> <s> </s> <unk>", "a▁b", "a ▁ b", "▁", "naïve Zoë – 日本 語 русский текст", "e\u0301 fi ﬁ ﷺ", "😀 👍🏽 x", "it's we'll I'd 'tis",
    "a" * 300, "word " * 40, "{\r\n}\r x", "tab\tand  two   three    four", "\ufeffbom", "\x00 \x01", "1234567890 12,345.67", "a.b,c;d", "end. \n\n Next",
    "Ünïcödé \u2003em space", "\u3000wide\u3000 space", "\u200bzero \u200b width",
]


def test_alignment_of_odd_texts(docs, files, brute_align):
    rows = list(enumerate(ODD_TEXTS)) + [(6, "a b"), (None, "a b")]
    df = docs(*rows).withColumn("block", F.lit(1)).withColumn("pair", F.lit("x")).withColumn("count", F.lit(2.5))
    assert aligned(token_alignment.report(df, *files)) == brute_align(rows)
    assert aligned(token_alignment.report(df.limit(0), *files)) == []


def test_alignment_of_made_up_texts(docs, files, brute_align):
    rng = random.Random(11)
    bits = ["the", " ", "  ", "\n", " \n", "\t", "Ing", "é", "ß", "日", "'s", "ll", "12", ".", ",", "\u00a0", "▁", "😀", "qu", "\r", "x"]
    rows = [(i, "".join(rng.choices(bits, weights=[6, 9, 1, 1, 1] + [2] * 16, k=rng.randint(1, 40)))) for i in range(400)]
    assert aligned(token_alignment.report(docs(*rows), *files)) == brute_align(rows)


def test_alignment_in_small_blocks_without_memory(docs, files, brute_align, monkeypatch):
    monkeypatch.setattr(token_alignment, "BLOCK_DOCS", 3)
    monkeypatch.setattr(token_alignment, "CALL_DOCS", 2)
    monkeypatch.setattr(token_alignment, "REMEMBERED", 4)
    rows = [(i, " ".join(f"w{j % (i + 2)}" for j in range(25))) for i in range(20)]
    assert aligned(token_alignment.report(docs(*rows).repartition(2), *files)) == brute_align(rows)


def test_alignment_block_takes_little_memory():
    """A block of as many entries and links as one may hold is written in a few copies of them, with the right counts."""
    rng, n, each = np.random.default_rng(8), 150_000, 10
    aligner = SimpleNamespace(texts=[""] * n, numbers=np.full((n, 4), each), pairs=array("q", rng.integers(0, 20_000, n * each).tolist()))
    block, entries = token_alignment.Block(), rng.integers(0, n // 2, 2_000_000)
    block.ids, block.digests, block.numbers, block.sizes = [1], [""], [np.zeros(4, np.int64)], [len(entries)]
    block.entries = array("i", entries.tolist())
    tracemalloc.start()
    try:
        out = block.batch(3, pa.int64(), aligner).to_pylist()[0]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    held, places, times = np.unique(entries, return_inverse=True, return_counts=True)
    flat = np.array(aligner.pairs).reshape(n, each)[held]
    count = np.bincount(flat.ravel(), np.repeat(times, each))
    pairs = np.flatnonzero(count)
    assert out["pairs"] == pairs.tolist() and out["counts"] == count[pairs].astype(int).tolist()
    assert (np.frombuffer(out["entries"], np.int32) == places).all()
    assert (np.array(out["pairs"])[np.frombuffer(out["links"], np.int32)] == flat.ravel()).all()
    assert (np.frombuffer(out["stretch_sizes"], np.int32) == each).all() and len(out["stretch_sizes"]) == 4 * len(held)
    assert peak < 90 << 20


def test_alignment_keeps_one_aligner_and_no_stretches(docs, files):
    """Tasks of a worker share the tokenizers; what one remembers goes with it."""

    def run(batches):
        for _ in batches:
            aligner = token_alignment.aligner_of(*files)
            yield pa.RecordBatch.from_arrays([pa.array([len(aligner.texts) + len(aligner.known) + len(aligner.pairs)])], names=["left"])

    df = docs(*[(i, f"some words {i}") for i in range(30)]).coalesce(1)
    token_alignment.blocks(df, *files).count()
    assert [r.left for r in df.select("doc_id").mapInArrow(run, "left long").collect()] == [0]


def test_alignment_of_the_small_table(spark, small, brute_align):
    rows = sorted(((r.doc_id, r.text) for r in small.collect()), key=lambda r: len(r[1] or ""))
    short = {k for k, t in rows if len(t or "") <= 3000}
    got = [r for r in aligned(queries.op12_token_alignment(spark, SMALL))]
    assert len(got) == len(rows)
    # Pairs of tokens are too many to try on long texts: their numbers are compared without totals.
    whole = {r[0]: r for r in brute_align([r for r in rows if r[0] in short])}
    assert all(g[:5] == whole[g[0]][:5] and g[7] == whole[g[0]][7] for g in got if g[0] in short)
    assert all(g[4] == g[1] + g[2] - g[3] for g in got)


# URL filters


def brute_url(url, rules=queries.PATH_RULES, blocked=url_filters.BLOCKED, allowed=url_filters.ALLOWED):
    """(host, path, rule, verdict, glob) by regular expressions, one pattern at a time."""
    if url is None or "://" not in url:
        rest = ""
    else:
        rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    tail = rest[len(host) :]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = re.match(r"[^?#]*", tail).group() if tail[:1] == "/" else ""
    whole = host + path + re.match(r"(\?[^#]*)?", tail[len(path) :]).group()
    fits = [(len(r), len(r.split("/")[0]), v == "block", r, v) for v, r in rules if ("." + host).endswith("." + r.split("/", 1)[0]) and path.startswith("/" + r.split("/", 1)[1])]
    if fits:
        return host, path, max(fits)[3], max(fits)[4], None
    for verdict, globs in (("allow", allowed), ("block", blocked)):
        for g in globs:
            if re.fullmatch(glob_regex(g), whole, re.S):
                return host, path, None, verdict, g
    return host, path, None, "allow", None


def glob_regex(glob):
    out, rest = (r"(?:[^/?]*\.)?", glob[2:]) if glob.startswith("||") else ("", glob)
    for part in re.findall(r"\*+|\\.|.", rest, re.S):
        out += ".*" if part[:2] == "**" else "[^/?]*" if part == "*" else "[^/?]" if part == "?" else re.escape(part[-1])
    return out


URLS = [
    None, "", "no scheme", "http://", "https://org/", "https://org", "http://EXAMPLE.org/es/x", "http://a.example.org/es", "http://a.example.org/es/?q#f",
    "http://example.org/en/12", "http://notexample.org/en/1", "http://x.com/fr/a", "http://x.com/de/", "http://x.com/fr", "http://x.com?/fr/", "http://x.com#/de/",
    "http://evil.net/x.org/", "http://evil.net/.example.org/es/", "http://m.casino-win.example.com/en/1", "http://a.net/casino", "http://a.net/?casino",
    "http://a.net/b/login", "http://a.net/b/login?x", "http://a.net/A.JPG", "http://a.net/a.jpg", "http://a.net/a.jpg#x", "http://a.net/x?sessionid=1", "http://a.net/x/sessionid=1",
    "http://w3.org/x.zip", "http://www.w3.org/x.zip", "http://archive.org./details/x.mp3", "http://Ünï.net/é.gif", "ftp://a://b.com/de/", "http://user@x.com/de/1", "http://x.com:80/de/1",
    "http:///de/", "http://..org/", "http://a.com/de/" + "y" * 5000, "http://x.net/line\nbreak.zip",
]


def judged(df):
    names = ["host", "path", "rule", "verdict", "glob"]
    return [tuple(r[n] for n in names) for r in df.orderBy("page_id").collect()]


def test_url_rules_and_globs(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    assert judged(url_filters.judge(pages, queries.PATH_RULES)) == [brute_url(u) for u in URLS]


def test_url_filters_odd_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/"), (1, "http://a.org/"), (None, "http://x.com/de/"), (None, None)], "page_id long, url string")
    named = pages.withColumn("host", F.lit(1)).withColumn("Rule", F.lit(2)).withColumn("__x", F.lit(3))
    got = url_filters.judge(named, queries.PATH_RULES)
    assert got.columns == ["page_id", "url", "__x", "host", "path", "rule", "verdict", "glob"]
    assert sorted((str(r.page_id), r.verdict, r["__x"]) for r in got.collect()) == [("1", "allow", 3), ("1", "allow", 3), ("None", "allow", 3), ("None", "block", 3)]
    assert url_filters.judge(pages.limit(0), queries.PATH_RULES).count() == 0
    with pytest.raises(ValueError):
        url_filters.judge(pages, [("deny", "org/")])
    with pytest.raises(ValueError):
        url_filters.judge(pages, [("allow", "org")])


def test_automaton_of_random_globs():
    """Globs over a small alphabet, so that words, carries, loops and parents of the host all come up."""
    rng = random.Random(5)
    globs = sorted({("||" if rng.random() < 0.3 else "") + "".join(rng.choices(["a", "b", ".", "/", "*", "**", "?", "\\?", "\\*", "ab"], k=rng.randint(1, 12))) for _ in range(120)})
    machine = url_filters.Automaton(globs)
    assert machine.words > 5
    texts = ["".join(rng.choices("aab./?*", k=rng.randint(0, 14))) for _ in range(1500)]
    hosts = np.array([len(re.match(r"[^/?]*", t).group()) for t in texts])
    compiled = [re.compile(glob_regex(g), re.S) for g in globs]
    want = [max((i for i, c in enumerate(compiled) if c.fullmatch(t)), default=-1) for t in texts]
    assert machine.best(texts, hosts).tolist() == want


def test_many_rules(spark, monkeypatch):
    """Thousands of rules in hundreds of words, with few URLs per step."""
    monkeypatch.setattr(url_filters, "STEP_WORDS", 4096)
    rules = [("block" if i % 3 else "allow", f"h{i % 500}.net/{i}/") for i in range(3000)] + [("allow", "net/")]
    urls = [f"http://{'www.' * (i % 2)}h{i % 600}.net/{i % 3500}/x" for i in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert judged(url_filters.judge(pages, rules, blocked=(), allowed=())) == [brute_url(u, rules, (), ()) for u in urls]


def test_url_query_on_the_small_table(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url").collect()}
    rows = queries.op13_url_filters(spark, SMALL).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict, r.glob) for r in rows} == {k: brute_url(u) for k, u in pages.items()}
