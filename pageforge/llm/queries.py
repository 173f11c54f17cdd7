"""The dealt queries opN_<name> and their checking SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageforge.llm import (
    lexical_search, line_dedup, mixing, ngram_join, packing, pii, quality_classifier, quality_rules, sentence_dedup, suffix_dedup,
    token_alignment, topk, url_filters,
)
from pageforge.llm.common import documents


def tokenizer_path(name: str = packing.TOKENIZER) -> str:
    """Path of a public tokenizer's file, which is the same on every machine."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def op1_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_dedup.dedup(documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir)).drop("kept")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(documents(spark, sf_dir))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("_nth")
    taken = F.col("size") * F.size("copies")
    return plan.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "copies", each).drop("_nth")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, lambda key: key % 50 == 0, k=5)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.score(docs, quality_classifier.fit(docs, labels))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.array_join(F.transform("removed", lambda i: i.cast("string")), ",").alias("removed")
    return line_dedup.report(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", removed)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(documents(spark, sf_dir).select("doc_id", "text"), key="pageforge")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.judge(documents(spark, sf_dir), labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=50)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.report(documents(spark, sf_dir), tokenizer_path(token_alignment.A_FILE), tokenizer_path(token_alignment.B_FILE))


PATH_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filters.judge(pages, PATH_RULES).select("page_id", "host", "path", "rule", "verdict", "glob")


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentence_dedup, op2_suffix_dedup, op3_mixing, op4_topk, op5_quality_classifier,
        op6_packing, op7_line_dedup, op8_pii, op9_quality_rules, op10_ngram_join,
        op11_lexical_search, op12_token_alignment, op13_url_filters,
    )
}
SQL: dict[str, str] = {
    "op4_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS z
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.z) + 1), lambda i: q.z[i] * c.z[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.z) = len(c.z)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op7_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line
  FROM documents WHERE doc_id IS NOT NULL
), w AS (
  SELECT doc_id, line, list_sort(list_distinct(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))) AS s FROM l
), k AS (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, line) AS nth FROM w WHERE len(s) > 0
), c AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, line) AS id, len(s) AS n FROM k WHERE nth = 1
), t AS (SELECT id, n, unnest(s) AS word FROM c),
f AS (SELECT word, count(*) AS df FROM t GROUP BY word),
p AS (
  SELECT id, n, word FROM (SELECT t.*, row_number() OVER (PARTITION BY id ORDER BY df, word) AS pos FROM t JOIN f USING (word))
  WHERE pos <= n - (4 * n + 4) // 5 + 1
), pairs AS (
  SELECT DISTINCT a.id AS later, b.id AS earlier FROM p a JOIN p b ON a.word = b.word AND b.id < a.id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
), gone AS (
  SELECT doc_id, line FROM k WHERE nth > 1
  UNION ALL
  SELECT x.doc_id, x.line FROM c x WHERE EXISTS (
    SELECT 1 FROM pairs JOIN c y ON y.id = earlier WHERE later = x.id AND 9 * len(list_intersect(x.s, y.s)) >= 4 * (x.n + y.n))
), lost AS (SELECT doc_id, count(*) AS n_removed, string_agg(line, ',' ORDER BY line) AS removed FROM gone GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n_lines FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN counted USING (doc_id) LEFT JOIN lost USING (doc_id)
""",
    "op10_ngram_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM d
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (
  SELECT x, y, shared = nx.n AND shared = ny.n AS same FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 9 * shared >= 4 * (nx.n + ny.n)
), reach AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x)
SELECT d.doc_id,
  least(d.doc_id, coalesce((SELECT min(y) FROM e WHERE x = d.doc_id AND same), d.doc_id)) AS copy_id,
  least(d.doc_id, coalesce((SELECT min(y) FROM reach WHERE x = d.doc_id), d.doc_id)) AS class_id,
  (SELECT count(*) FROM e WHERE x = d.doc_id) AS n_links
FROM d
""",
    "op11_lexical_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE doc_id IS NOT NULL
), s AS (SELECT count(*) AS n_all, sum(len(t)) AS l_all FROM d WHERE len(t) > 0),
i AS (
  SELECT DISTINCT item_id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL
), p AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, n_all),
c AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + CAST((50 * n * n_all) // l_all AS BIGINT))))) AS score
  FROM i JOIN f USING (term) JOIN w USING (term), s GROUP BY ALL
), k AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM c WHERE score > 0
)
SELECT CAST(item_id AS BIGINT) AS item_id, CAST(rank AS INTEGER) AS rank, CAST(doc_id AS BIGINT) AS doc_id, CAST(score AS BIGINT) AS score
FROM k WHERE rank <= 50
""",
    "op13_url_filters": r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, rest,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*([?][^#]*)', 1) AS query
  FROM u
), c AS (SELECT *, '.' || host AS dotted, host || path || query AS whole FROM h),
r AS (
  SELECT *, CASE
    WHEN ends_with(dotted, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ends_with(dotted, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ends_with(dotted, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ends_with(dotted, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ends_with(dotted, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM c
), g AS (SELECT * FROM (VALUES
  (1, 'allow', '||w3.org/**', '^([^/?]*[.])?w3[.]org/'), (2, 'allow', '||archive.org/details/**', '^([^/?]*[.])?archive[.]org/details/'),
  (3, 'block', '*adult-**', '^[^/?]*adult-'), (4, 'block', '*casino**', '^[^/?]*casino'), (5, 'block', '*cheap-pills**', '^[^/?]*cheap-pills'),
  (6, 'block', '*spam-farm**', '^[^/?]*spam-farm'), (7, 'block', '*porn**', '^[^/?]*porn'), (8, 'block', '*viagra**', '^[^/?]*viagra'),
  (9, 'block', '*betting**', '^[^/?]*betting'), (10, 'block', '*lottery-win**', '^[^/?]*lottery-win'), (11, 'block', '*free-money**', '^[^/?]*free-money'),
  (12, 'block', '*warez**', '^[^/?]*warez'), (13, 'block', '**/wp-admin/**', '/wp-admin/'), (14, 'block', '**/wp-login.php**', '/wp-login[.]php'),
  (15, 'block', '**/cgi-bin/**', '/cgi-bin/'), (16, 'block', '**/login', '/login$'), (17, 'block', '**/logout', '/logout$'),
  (18, 'block', '**/checkout/**', '/checkout/'), (19, 'block', '**/cart/**', '/cart/'),
  (20, 'block', '**.jpg', '[.]jpg$'), (21, 'block', '**.jpeg', '[.]jpeg$'), (22, 'block', '**.png', '[.]png$'), (23, 'block', '**.gif', '[.]gif$'),
  (24, 'block', '**.mp3', '[.]mp3$'), (25, 'block', '**.mp4', '[.]mp4$'), (26, 'block', '**.avi', '[.]avi$'), (27, 'block', '**.zip', '[.]zip$'),
  (28, 'block', '**.tar.gz', '[.]tar[.]gz$'), (29, 'block', '**.exe', '[.]exe$'), (30, 'block', '**.dmg', '[.]dmg$'), (31, 'block', '**.iso', '[.]iso$'),
  (32, 'block', '**.apk', '[.]apk$'), (33, 'block', '**\?**sessionid=**', '[?].*sessionid='), (34, 'block', '**\?**replytocom=**', '[?].*replytocom=')
) AS t(place, kind, written, pattern)),
m AS (SELECT whole, min(place) AS place FROM (SELECT DISTINCT whole FROM c) JOIN g ON regexp_matches(whole, pattern, 's') GROUP BY whole)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' ELSE coalesce(kind, 'allow') END AS verdict,
  CASE WHEN rule IS NULL THEN written END AS "glob"
FROM r LEFT JOIN m USING (whole) LEFT JOIN g USING (place)
""",
}
