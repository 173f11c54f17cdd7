"""Text, date and prompt scalar queries."""

from pyspark.sql import functions as F

from pageforge.functions import dates as D
from pageforge.functions import product as P
from pageforge.functions import text as X
from pageforge.functions.entities import clean_text, decode_entities
from pageforge.functions.urls import domain_of, url_path
from pageforge.queries.base import derived, query

SP = r"[\s\x1c-\x1f\x0b\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SP = r"[^\s\x1c-\x1f\x0b\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

derived(
    "messy",
    """
    SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN concat('  ', replace(text, ' the ', ' &amp;  the&nbsp;'), chr(10))
      WHEN 1 THEN replace(text, 'a', '&lt;a&gt;') WHEN 2 THEN concat('&amp;lt;', text, chr(9), '&quot;')
      WHEN 3 THEN concat('&eacute;', replace(text, ' of ', ' &copy '), '&#233;', chr(7)) WHEN 4 THEN '' ELSE text END AS text
    FROM {documents}
    """,
    "documents",
)
_DECODED = (
    "replace(replace(replace(replace(replace(replace(replace(replace(text, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'),"
    " '&quot;', '\"'), '&eacute;', 'é'), '&#233;', 'é'), '&copy ', '© '), '&amp;', '&')"
)


@query(
    "text_clean", "messy",
    rf"""SELECT doc_id, coalesce(regexp_replace(trim(regexp_replace({_DECODED}, '{SP}+', ' ', 'g'), ' '),
      '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x84\x86-\x9f]', '', 'g'), '') AS text FROM messy""",
)
def text_clean(docs):
    return docs.select("doc_id", clean_text(F.col("text")).alias("text"))


@query("text_decode_entities", "messy", f"SELECT doc_id, {_DECODED} AS text FROM messy")
def text_decode(docs):
    return docs.select("doc_id", decode_entities(F.col("text")).alias("text"))


_WORDS = f"len(regexp_extract_all(text, '{NOT_SP}+'))"


@query("text_word_count", "documents", f"SELECT doc_id, cast({_WORDS} AS bigint) AS words FROM documents")
def text_word_count(docs):
    return docs.select("doc_id", X.word_count(F.col("text")).cast("bigint").alias("words"))


@query(
    "text_reading_time", "messy",
    f"""SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE cast(greatest(1, round_even({_WORDS} / 200.0, 0)) AS bigint) END AS minutes
    FROM messy""",
)
def text_reading_time(docs):
    return docs.select("doc_id", X.reading_time(F.col("text")).cast("bigint").alias("minutes"))


@query(
    "text_excerpt", "documents",
    """
    WITH s AS (
      SELECT doc_id, pos, sentence, sum(length(sentence)) OVER w + 2 * (pos - 1) AS used FROM (
        SELECT doc_id, unnest(string_split(text, '. ')) AS sentence, generate_subscripts(string_split(text, '. '), 1) AS pos
        FROM documents WHERE text <> '')
      WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    fit AS (SELECT *, max(CASE WHEN used > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS over FROM s)
    SELECT d.doc_id, nullif(trim(string_agg(sentence || '. ', '' ORDER BY pos) FILTER (WHERE over = 0), E' \\n\\t'), '') AS excerpt
    FROM documents d LEFT JOIN fit f ON d.doc_id = f.doc_id GROUP BY d.doc_id
    """,
)
def text_excerpt(docs):
    return docs.select("doc_id", X.excerpt(F.col("text")).alias("excerpt"))


@query(
    "text_summary", "documents",
    rf"""
    WITH s AS (
      SELECT doc_id, regexp_replace(regexp_replace(sentence, '^{SP}+', ''), '{SP}+$', '') AS sentence, pos FROM (
        SELECT doc_id, unnest(string_split_regex(text, '[.!?]+')) AS sentence,
          generate_subscripts(string_split_regex(text, '[.!?]+'), 1) AS pos FROM documents)),
    k AS (SELECT doc_id, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM s WHERE sentence <> ''),
    u AS (SELECT *, sum(length(sentence)) OVER (PARTITION BY doc_id ORDER BY k) + 2 * (k - 1) AS used FROM k WHERE k <= 3),
    f AS (SELECT *, max(CASE WHEN used > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS over FROM u)
    SELECT d.doc_id, trim(string_agg(sentence || '. ', '' ORDER BY k) FILTER (WHERE over = 0)) AS summary
    FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id
    """,
)
def text_summary(docs):
    return docs.select("doc_id", X.summary(F.col("text")).alias("summary"))


derived("titled", "SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS content, source FROM {documents}", "documents")


@query(
    "text_slug", "titled",
    rf"""SELECT doc_id, CASE WHEN title <> '' THEN trim(regexp_replace(regexp_replace(lower(title),
      '[^\p{{L}}\p{{N}}_\s\x1c-\x1f\x0b\x85\xa0\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}-]', '', 'g'),
      '[_\s\x1c-\x1f\x0b\x85\xa0\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}-]+', '-', 'g'), '-') END AS slug
      FROM titled""",
)
def text_slug(docs):
    return docs.select("doc_id", X.slug(F.col("title")).alias("slug"))


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
KEYWORD_SQL = r"""
    words AS (SELECT doc_id, w, pos FROM (
      SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (
        SELECT doc_id, string_split_regex(lower(concat(title, ' ', content)), '[^\p{L}\p{N}_]+') AS ws FROM titled))
      WHERE regexp_full_match(w, '[a-z]{3,}') AND w NOT IN (STOP)),
    counted AS (SELECT doc_id, w, count(*) AS n, min(pos) AS first FROM words GROUP BY doc_id, w),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS k FROM counted)
""".replace("STOP", _STOP)


@query(
    "text_keywords", "titled",
    f"""WITH {KEYWORD_SQL} SELECT d.doc_id, coalesce(string_agg(w, '|' ORDER BY k), '') AS keywords
    FROM titled d LEFT JOIN (SELECT * FROM ranked WHERE k <= 10 AND n > 1) r ON d.doc_id = r.doc_id GROUP BY d.doc_id""",
)
def text_keywords(docs):
    return docs.select("doc_id", F.array_join(X.keywords(F.col("content"), F.col("title")), "|").alias("keywords"))


@query(
    "text_top_terms", "titled",
    f"WITH {KEYWORD_SQL} SELECT w AS keyword, count(*) AS documents FROM ranked WHERE k <= 10 AND n > 1 GROUP BY w",
)
def text_top_terms(docs):
    one = docs.select(F.explode(X.keywords(F.col("content"), F.col("title"))).alias("keyword"))
    return one.groupBy("keyword").agg(F.count("*").alias("documents"))


@query("text_term_frequency", "titled", f"WITH {KEYWORD_SQL} SELECT w AS word, sum(n)::bigint AS uses, count(*) AS documents FROM counted GROUP BY w")
def text_term_frequency(docs):
    """Corpus term frequency: counted per row first, so that one word per row and
    document is shuffled at most, and combined before the shuffle."""
    text = F.lower(F.concat("title", F.lit(" "), "content"))
    words = docs.select("doc_id", F.explode(X.keyword_candidates(text)).alias("word"))
    per_document = words.groupBy("word", "doc_id").agg(F.count("*").alias("n"))
    return per_document.groupBy("word").agg(F.sum("n").alias("uses"), F.count("*").alias("documents"))


def _hits(column: str, words) -> str:
    return " + ".join(f"cast(contains({column}, '{w}') AS int)" for w in words)


_LANG = f"""SELECT *, {_hits('lower(content)', X.LANGUAGE_MARKS['en'])} AS en, {_hits('lower(content)', X.LANGUAGE_MARKS['es'])} AS es,
  {_hits('lower(content)', X.LANGUAGE_MARKS['fr'])} AS fr FROM titled"""


@query(
    "text_language", "titled",
    f"""SELECT doc_id, CASE WHEN en > es AND en > fr THEN 'en' WHEN es > fr THEN 'es' WHEN fr > 0 THEN 'fr' ELSE 'en' END AS language
    FROM ({_LANG})""",
)
def text_language(docs):
    return docs.select("doc_id", X.language(F.col("content")).alias("language"))


_TOPIC_UNION = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS place, '{t}' AS topic, {_hits('t', words)} AS score FROM (SELECT doc_id, lower(concat(title, ' ', content)) AS t FROM topical)"
    for k, (t, words) in enumerate(X.TOPIC_WORDS.items())
)
derived(
    "topical",
    """
    SELECT doc_id, title, concat(content, CASE doc_id % 8 WHEN 0 THEN ' market research' WHEN 1 THEN ' the Team won the match'
      WHEN 2 THEN ' doctor' WHEN 3 THEN ' Machine Learning software' WHEN 4 THEN ' movie music policy' ELSE '' END) AS content FROM {titled}
    """,
    "titled",
)


@query(
    "text_topic", "topical",
    f"""WITH scores AS ({_TOPIC_UNION}) SELECT doc_id, CASE WHEN max(score) = 0 THEN 'general'
      ELSE arg_max(topic, score * 100 - place) END AS topic FROM scores GROUP BY doc_id""",
)
def text_topic(docs):
    return docs.select("doc_id", X.topic(F.col("content"), F.col("title")).alias("topic"))


derived(
    "raw_dates",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'soon' ELSE CASE o_orderkey % 11
      WHEN 0 THEN concat(y, '-', m, '-', d, 'T08:05:09Z') WHEN 1 THEN concat(y, '-', m, '-', d, 'T08:05:09')
      WHEN 2 THEN concat(y, '-', m, '-', d, ' 23:59:58') WHEN 3 THEN concat(' ', y, '-', m, '-', d)
      WHEN 4 THEN concat(d, '/', m, '/', y) WHEN 5 THEN concat(m, '/', d, '/', y) WHEN 6 THEN concat('March ', d, ', ', y)
      WHEN 7 THEN concat(d, ' july ', y) WHEN 8 THEN concat(y, '-', m, '-', d, 'T08:05:09.5Z')
      WHEN 9 THEN concat(y, '-02-', d) ELSE concat('2024-13-', d) END END AS raw
    FROM (SELECT o_orderkey, cast(year(o_orderdate) AS varchar(4)) AS y, cast(month(o_orderdate) AS varchar(2)) AS m,
      cast(day(o_orderdate) AS varchar(2)) AS d FROM {orders})
    """,
    "orders",
)


def _date_sql(day_first: bool, spaced: bool) -> str:
    slashes = ["%d/%m/%Y", "%m/%d/%Y"] if day_first else ["%m/%d/%Y", "%d/%m/%Y"]
    formats = ["%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S", *(["%Y-%m-%d %H:%M:%S"] if spaced else []), "%Y-%m-%d", *slashes,
               "%B %d, %Y", "%d %B %Y", *(["%Y-%m-%dT%H:%M:%S.%fZ"] if spaced else [])]
    tries = ", ".join(f"try_strptime(trim(raw), '{f}')" for f in formats)
    return f"SELECT o_orderkey, strftime(coalesce({tries}), '%Y-%m-%d %H:%M:%S.%g') AS parsed FROM raw_dates"


def _shown(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS").alias("parsed")


@query("date_extraction", "raw_dates", _date_sql(True, True))
def date_extraction(rows):
    return rows.select("o_orderkey", _shown(D.parse_extracted_date(F.col("raw"))))


@query("date_blog", "raw_dates", _date_sql(False, False))
def date_blog(rows):
    return rows.select("o_orderkey", _shown(D.parse_blog_date(F.col("raw"))))


derived(
    "prompts",
    """
    SELECT conv_id, turn, concat('https://', CASE conv_id % 4 WHEN 0 THEN 'leetcode.com' WHEN 1 THEN 'mathsite.org' ELSE 'q.net' END, '/',
      cast(conv_id AS varchar(19)), '-', cast(turn AS varchar(19))) AS url,
      concat(CASE conv_id % 7 WHEN 0 THEN 'Write a simple Python function. ' WHEN 1 THEN 'Solve this equation. '
      WHEN 2 THEN 'A complex logic puzzle. ' WHEN 3 THEN 'Optimize const x in JavaScript with a linked list and recursion. '
      WHEN 4 THEN 'package main; func sort(array, tree, graph, queue, stack, hash) ' ELSE '' END, text) AS prompt_text
    FROM {conversations} WHERE role = 'user'
    """,
    "conversations",
)


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


PROMPT_SQL = {
    "category": "CASE " + " ".join(f"WHEN {_any('t', w)} THEN '{c}'" for c, w in X.PROMPT_CATEGORY_WORDS.items())
    + " WHEN contains(url, 'leetcode') THEN 'programming' WHEN contains(url, 'math') THEN 'mathematics' ELSE 'general' END",
    "difficulty": f"CASE WHEN {_any('t', X.EASY_WORDS)} THEN 'easy' WHEN {_any('t', X.HARD_WORDS)} THEN 'hard'"
    f" WHEN len(regexp_extract_all(t, '{NOT_SP}+')) < 50 THEN 'easy' WHEN len(regexp_extract_all(t, '{NOT_SP}+')) > 200 THEN 'hard' ELSE 'medium' END",
    "tags": "array_to_string(list_filter([" + ", ".join(
        f"CASE WHEN contains(t, '{w}') THEN '{w.replace(' ', '-')}' END" for w in X.TAG_WORDS
    ) + "], lambda x: x IS NOT NULL)[1:5], '|')",
    "programming_language": "CASE " + " ".join(f"WHEN {_any('t', w)} THEN '{c}'" for c, w in X.CODE_MARKS.items()) + " END",
}
_FROM_PROMPTS = "FROM (SELECT *, lower(prompt_text) AS t FROM prompts)"


@query("prompt_category", "prompts", f"SELECT conv_id, turn, {PROMPT_SQL['category']} AS category {_FROM_PROMPTS}")
def prompt_category(rows):
    return rows.select("conv_id", "turn", X.prompt_category(F.col("prompt_text"), domain_of(F.col("url"))).alias("category"))


@query("prompt_difficulty", "prompts", f"SELECT conv_id, turn, {PROMPT_SQL['difficulty']} AS difficulty {_FROM_PROMPTS}")
def prompt_difficulty(rows):
    return rows.select("conv_id", "turn", X.difficulty(F.col("prompt_text")).alias("difficulty"))


@query("prompt_tags", "prompts", f"SELECT conv_id, turn, {PROMPT_SQL['tags']} AS tags {_FROM_PROMPTS}")
def prompt_tags(rows):
    return rows.select("conv_id", "turn", F.array_join(X.mined_tags(F.col("prompt_text")), "|").alias("tags"))


@query("document_tags", "documents", f"SELECT doc_id, {PROMPT_SQL['tags']} AS tags FROM (SELECT *, lower(text) AS t FROM documents)")
def document_tags(rows):
    return rows.select("doc_id", F.array_join(X.mined_tags(F.col("text")), "|").alias("tags"))


@query(
    "prompt_code_language", "prompts",
    f"SELECT conv_id, turn, {PROMPT_SQL['programming_language']} AS programming_language {_FROM_PROMPTS}",
)
def prompt_code_language(rows):
    return rows.select("conv_id", "turn", X.code_language(F.col("prompt_text")).alias("programming_language"))


derived(
    "prompt_limits",
    """
    SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN concat(' ', cast(conv_id AS varchar(19)), ' ') WHEN 1 THEN '12.5'
      WHEN 2 THEN concat('-', cast(turn AS varchar(19))) WHEN 3 THEN 'none' ELSE concat('1_0', cast(turn AS varchar(19))) END AS raw
    FROM {conversations}
    """,
    "conversations",
)


@query(
    "prompt_strict_int", "prompt_limits",
    """SELECT conv_id, turn, CASE WHEN regexp_full_match(trim(raw), '[+-]?[0-9](_?[0-9])*')
      THEN cast(replace(trim(raw), '_', '') AS bigint) END AS number FROM prompt_limits""",
)
def prompt_strict_int(rows):
    return rows.select("conv_id", "turn", P.parse_strict_int(F.col("raw")).alias("number"))


derived(
    "raw_examples",
    """
    SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN concat('in ', cast(conv_id AS varchar(19)))
      WHEN 1 THEN concat('[', chr(123), '"input": "a  &amp; b", "output": ', cast(conv_id AS varchar(19)), chr(125), ', "x", ', cast(turn AS varchar(19)), ']')
      WHEN 2 THEN '' ELSE '[]' END AS raw FROM {conversations}
    """,
    "conversations",
)


@query(
    "prompt_examples", "raw_examples",
    """
    SELECT conv_id, turn, 0 AS n, raw AS input, '' AS output, '' AS explanation FROM raw_examples WHERE turn % 4 = 0
    UNION ALL SELECT conv_id, turn, 0, 'a & b', cast(conv_id AS varchar), '' FROM raw_examples WHERE turn % 4 = 1
    UNION ALL SELECT conv_id, turn, 1, 'x', '', '' FROM raw_examples WHERE turn % 4 = 1
    UNION ALL SELECT conv_id, turn, 2, cast(turn AS varchar), '', '' FROM raw_examples WHERE turn % 4 = 1
    """,
)
def prompt_examples(rows):
    made = rows.withColumn("e", P.examples(F.col("raw")))
    return made.select("conv_id", "turn", F.posexplode("e").alias("n", "e")).select("conv_id", "turn", "n", "e.*")


@query(
    "tag_split", "documents",
    rf"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ','),
      lambda x: regexp_replace(regexp_replace(x, '^{SP}+', ''), '{SP}+$', '')), lambda x: x <> ''), '|') AS tags FROM documents""",
)
def tag_split(docs):
    return docs.select("doc_id", F.array_join(X.split_tags(F.col("text")), "|").alias("tags"))


@query(
    "tag_list", "documents",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat(source, '|', lang, ' & x') END AS tags FROM documents""",
)
def tag_list(docs):
    given = F.array(F.concat(F.lit(" "), "source"), F.lit(""), F.lit(None).cast("string"), F.concat("lang", F.lit("  &amp; x")))
    made = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.slice(given, 1, 0)).otherwise(given).alias("t"))
    return made.select("doc_id", F.array_join(X.tag_list(F.col("t")), "|").alias("tags"))


@query(
    "blog_category", "pages",
    r"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'given' WHEN 1 THEN concat('tag', page_id)
      ELSE lower(regexp_extract(url, '//([^/?#]*)', 1)) END AS category FROM pages""",
)
def blog_category(pages):
    kind = F.col("page_id") % 3
    made = pages.select(
        "page_id", F.when(kind == 0, "given").otherwise("").alias("c"),
        F.when(kind < 2, F.array(F.concat(F.lit("tag"), F.col("page_id").cast("string")))).alias("tags"),
        domain_of(F.col("url")).alias("domain"),
    )
    return made.select("page_id", X.blog_category(F.col("c"), F.col("tags"), F.col("domain")).alias("category"))


@query(
    "url_category", "products",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'electronics' WHEN 1 THEN 'clothing' WHEN 2 THEN NULL ELSE 'home' END AS category
    FROM products""",
)
def url_category(rows):
    return rows.select("p_partkey", X.url_category(url_path(F.col("product_url"))).alias("category"))
