"""Sources, sinks, constraints, search, sorting."""

import uuid

from pyspark.sql import functions as F

from pageforge import catalog
from pageforge.operators import keys as K
from pageforge.operators import quality as Q
from pageforge.operators import search as S
from pageforge.operators.stats import content_counts
from pageforge.queries.base import derived, query
from pageforge.sources import readers, sinks


def _folder(spark) -> str:
    return f"{K.shared_folder(spark)}/queries/{uuid.uuid4().hex}"


@query("page_scan", "pages", "SELECT page_id, url, length(html) AS size FROM pages")
def page_scan(pages):
    return pages.select("page_id", "url", F.length("html").cast("bigint").alias("size"))


derived(
    "crawl_lists",
    """
    SELECT user_id AS list_id, CASE user_id % 6 WHEN 0 THEN 'blog' WHEN 1 THEN 'prompt' WHEN 2 THEN 'article' WHEN 3 THEN 'product'
      WHEN 4 THEN 'news' ELSE 'article' END AS content_type, count(*) AS n FROM {events} GROUP BY user_id
    """,
    "events",
)


def _requests(lists):
    urls = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.format_string("https://s%d.org/p/%d", F.col("list_id"), k))
    return readers.requests_from_lists(
        lists.withColumn("urls", urls), keep=("list_id",)
    )


_REQUESTS = "requests AS (SELECT list_id, k - 1 AS pos, concat('https://s', list_id, '.org/p/', k) AS url, content_type FROM crawl_lists, (SELECT unnest([1, 2, 3]) AS k))"


@query("request_scan", "crawl_lists", f"WITH {_REQUESTS} SELECT * FROM requests")
def request_scan(lists):
    return _requests(lists)


@query(
    "request_types", "crawl_lists",
    f"""WITH {_REQUESTS} SELECT list_id, pos, CASE content_type WHEN 'blog' THEN 'blogs' WHEN 'prompt' THEN 'prompts' WHEN 'article' THEN 'articles'
      ELSE 'products' END AS table_name, CASE content_type WHEN 'blog' THEN 4 ELSE 3 END AS n_required FROM requests WHERE content_type <> 'news'""",
)
def request_types(lists):
    known, _ = readers.resolve_types(_requests(lists), catalog.catalog_frame(lists.sparkSession))
    return known.select("list_id", "pos", "table_name", F.size("required_fields").alias("n_required"))


@query(
    "request_rejected", "crawl_lists",
    f"WITH {_REQUESTS} SELECT list_id, pos, concat('Unsupported content type: ', content_type) AS reason FROM requests WHERE content_type = 'news'",
)
def request_rejected(lists):
    _, rejected = readers.resolve_types(_requests(lists), catalog.catalog_frame(lists.sparkSession))
    return rejected.select("list_id", "pos", "reason")


@query(
    "request_selectors", "crawl_lists",
    f"""WITH {_REQUESTS} SELECT list_id, pos, CASE WHEN list_id % 2 = 0 THEN 'h2' WHEN content_type = 'blog' THEN 'h1, .title, .post-title'
      WHEN content_type = 'article' THEN 'h1, .article-title, .headline' END AS title, CASE WHEN list_id % 2 = 0 THEN 1 WHEN content_type = 'blog' THEN 4
      WHEN content_type = 'product' THEN 4 ELSE 3 END AS n_selectors FROM requests WHERE content_type <> 'news'""",
)
def request_selectors(lists):
    own = F.when(F.col("list_id") % 2 == 0, F.create_map(F.lit("title"), F.lit("h2"))).otherwise(
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    )
    requests = _requests(lists).withColumn("selectors", own)
    known, _ = readers.resolve_types(requests, catalog.catalog_frame(lists.sparkSession))
    return known.select(
        "list_id", "pos", F.try_element_at("selectors", F.lit("title")).alias("title"), F.size("selectors").alias("n_selectors")
    )


@query(
    "request_pages", "page_requests pages",
    """SELECT r.request_id, r.url, p.page_id IS NOT NULL AS has_page FROM page_requests r LEFT JOIN pages p ON r.url = p.url""",
)
def request_pages(requests, pages):
    from pageforge.plans.ingest import with_pages

    return with_pages(requests, pages).select("request_id", "url", F.col("html").isNotNull().alias("has_page"))


# ------------------------------------------------------------------- sinks

derived(
    "product_rows",
    """
    SELECT p_partkey AS request_id, concat('https://shop.test/', cast(p_partkey % 700 AS varchar(19))) AS url,
      CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE concat('SKU-', cast(p_partkey % 900 AS varchar(19))) END AS sku,
      CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 17 = 1 THEN repeat(p_name, 60) ELSE p_name END AS name,
      p_retailprice AS price, p_brand AS brand, 'USDX' AS currency_raw FROM {part}
    """,
    "part",
)
# Inserts replayed one row after the other, with the accepted keys carried along.
_REPLAY = """RECURSIVE numbered AS (SELECT *, row_number() OVER (ORDER BY request_id) AS i FROM ({src})),
    replay AS (
      SELECT 0::bigint AS i, false AS ok, {urls} AS urls, {skus} AS skus
      UNION ALL
      SELECT n.i, o.ok, CASE WHEN o.ok THEN list_append(r.urls, n.url) ELSE r.urls END,
        CASE WHEN o.ok AND n.sku IS NOT NULL THEN list_append(r.skus, n.sku) ELSE r.skus END
      FROM replay r JOIN numbered n ON n.i = r.i + 1,
        LATERAL (SELECT NOT list_contains(r.urls, n.url) AND (n.sku IS NULL OR NOT list_contains(r.skus, n.sku)) AS ok) o)
    SELECT {columns} FROM numbered n JOIN replay r ON n.i = r.i WHERE r.ok"""


def _replay(src: str, columns: str, urls: str = "cast([] AS varchar[])", skus: str = "cast([] AS varchar[])") -> str:
    return "WITH " + _REPLAY.format(src=src, columns=columns, urls=urls, skus=skus)


@query("insert_first_wins", "product_rows", _replay("SELECT * FROM product_rows", "request_id, url, sku"))
def insert_first_wins(rows):
    return K.accept_inserts(rows.select("request_id", "url", "sku"), ["url", "sku"], "request_id")


@query(
    "insert_existing_keys", "product_rows",
    _replay(
        "SELECT * FROM product_rows WHERE request_id >= 50", "request_id, url, sku",
        "(SELECT list(url) FROM product_rows WHERE request_id < 50)", "(SELECT list(sku) FROM product_rows WHERE request_id < 50 AND sku IS NOT NULL)",
    ),
)
def insert_existing_keys(rows):
    keys = rows.select("request_id", "url", "sku")
    return K.accept_inserts(keys.where("request_id >= 50"), ["url", "sku"], "request_id", keys.where("request_id < 50"))


@query("insert_chain", "events", "SELECT event_id AS request_id FROM events WHERE event_id % 2 = 0")
def insert_chain(events):
    """One chain through the whole table: every row shares its url with the row before it and its sku with the next, or the other way round."""
    i = F.col("event_id")
    rows = events.select(
        i.alias("request_id"), F.format_string("https://c.test/%d", F.floor((i + 1) / 2)).alias("url"), F.format_string("S%d", F.floor(i / 2)).alias("sku")
    )
    return K.accept_inserts(rows, ["url", "sku"], "request_id").select("request_id")


@query(
    "insert_single_key", "product_rows",
    "SELECT min(request_id) AS request_id, url FROM product_rows GROUP BY url",
)
def insert_single_key(rows):
    return K.accept_inserts(rows.select("request_id", "url"), ["url"], "request_id")


_VIOLATIONS = """concat_ws('|', CASE WHEN name IS NULL THEN 'name is null' END, CASE WHEN length(name) > 500 THEN 'name is longer than 500' END,
  'currency is longer than 3')"""


@query("constraint_violations", "product_rows", f"SELECT request_id, {_VIOLATIONS} AS violations FROM product_rows")
def constraint_violations(rows):
    checked = rows.withColumn("currency", F.col("currency_raw"))
    return checked.select("request_id", F.array_join(Q.constraint_violations(checked, catalog.PRODUCT), "|").alias("violations"))


@query(
    "typed_sink", "product_rows",
    _replay("SELECT * FROM product_rows WHERE name IS NOT NULL AND length(name) <= 500", "url, sku, name, price"),
)
def typed_sink(rows):
    """Insert twice: the second half meets the keys of the first, and all keys of the first again."""
    spark, root = rows.sparkSession, _folder(rows.sparkSession)
    full = rows.select("request_id", "url", "sku", "name", "price", "brand")
    middle = F.floor(F.lit(full.count()) / 2)
    sinks.insert(full.where(F.col("request_id") < middle), root, "product")
    sinks.insert(full, root, "product")
    return sinks.read_table(spark, root, "product").select("url", "sku", "name", "price")


@query(
    "sink_mixed_writes", "product_rows",
    _replay("SELECT * FROM product_rows WHERE name IS NOT NULL AND length(name) <= 500", "url, sku, name, price"),
)
def sink_mixed_writes(rows):
    """A plain insert, one under a name that is written twice, and a plain one again leave every row readable."""
    spark, root = rows.sparkSession, _folder(rows.sparkSession)
    full = rows.select("request_id", "url", "sku", "name", "price", "brand")
    third = F.floor(F.lit(full.count()) / 3)
    sinks.insert(full.where(F.col("request_id") < third), root, "product")
    for _ in range(2):
        sinks.insert(full.where(F.col("request_id").between(third, 2 * third)), root, "product", part="7")
    sinks.insert(full, root, "product")
    return sinks.read_table(spark, root, "product").select("url", "sku", "name", "price")


@query("partitioned_sink", "mixed_requests", "SELECT request_id, url, content_type FROM mixed_requests WHERE content_type = 'blog'")
def partitioned_sink(requests):
    path = _folder(requests.sparkSession)
    sinks.write_content(requests.select("request_id", "url", "content_type"), path)
    return requests.sparkSession.read.parquet(path).where("content_type = 'blog'")


derived(
    "job_results",
    """
    SELECT event_id, concat('job-', cast(user_id % 97 AS varchar(19))) AS job_id FROM {events}
    """,
    "events",
)
derived("known_jobs", "SELECT DISTINCT concat('job-', cast(user_id AS varchar(19))) AS job_id FROM {events} WHERE user_id % 3 <> 0", "events")


@query(
    "orphan_results", "job_results known_jobs",
    "SELECT event_id, job_id FROM job_results WHERE job_id NOT IN (SELECT job_id FROM known_jobs)",
)
def orphan_results(results, jobs):
    return K.orphans(results, jobs, "job_id")


@query(
    "raw_envelope", "pages",
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN html END AS html, 'en' AS lang, cast(page_id AS varchar) AS job FROM pages""",
)
def raw_envelope(pages):
    made = pages.select(
        "page_id",
        sinks.raw_envelope(F.col("html"), F.col("page_id") % 2 == 0, F.struct(F.lit("en").alias("lang"))).alias("raw"),
        sinks.meta_envelope(job_id=F.col("page_id").cast("string")).alias("meta"),
    )
    return made.select(
        "page_id", F.get_json_object("raw", "$.html").alias("html"),
        F.get_json_object("raw", "$.extraction_metadata.lang").alias("lang"), F.get_json_object("meta", "$.job_id").alias("job"),
    )


@query(
    "partial_update", "product_rows",
    """SELECT request_id, CASE WHEN request_id % 4 = 0 THEN concat('new ', request_id) ELSE brand END AS brand,
      CASE WHEN request_id % 4 = 0 THEN request_id + 0.5 WHEN request_id % 4 = 1 THEN NULL ELSE price END AS price, name,
      CASE WHEN request_id % 4 < 2 THEN 'now' ELSE 'before' END AS updated_at FROM product_rows""",
)
def partial_update(rows):
    base = rows.select("request_id", "brand", "price", "name", F.lit("before").alias("updated_at"))
    key = F.col("request_id")
    text = key.cast("string")

    def change(seq, field, value):
        return rows.select(
            "request_id", F.lit(seq).alias("seq"), F.create_map(F.lit(field), value.cast("string")).alias("changes"), (key % 4).alias("k")
        )

    updates = K.union_all(
        [
            change(1, "brand", F.lit("old")).where("k = 0"),
            change(2, "brand", F.concat(F.lit("new "), text)).where("k = 0"),
            change(3, "price", key + F.lit(0.5)).where("k = 0"),
            *[change(4 + n, f"unknown {n}", text).where("k = 0") for n in range(5)],
            change(1, "price", F.lit(None)).where("k = 1"),
        ]
    )
    merged = K.merged_changes(updates, "request_id", "changes", "seq", base.columns)
    return K.apply_changes(base, merged, "request_id", "changes", F.lit("now"))


@query("find_by_id", "part", "SELECT p_partkey, p_name FROM part WHERE p_partkey = 7")
def find_by_id(part):
    return K.find_by_id(part.select("p_partkey", "p_name"), 7, "p_partkey")


@query(
    "find_in_clustered", "orders",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)
      OR o_custkey = (SELECT min(o_custkey) FROM orders)""",
)
def find_in_clustered(orders):
    """One look-up by the cluster key, one by a column with a Bloom filter only; an order found by both comes once."""
    path = _folder(orders.sparkSession)
    sinks.write_clustered(orders.select("o_orderkey", "o_custkey", "o_totalprice"), path, "o_orderkey", "o_custkey")
    ends = orders.agg(F.max("o_orderkey").alias("last"), F.min("o_custkey").alias("customer")).first()
    written = orders.sparkSession.read.parquet(path)
    by_key = K.find_by_id(written, ends["last"], "o_orderkey")
    by_customer = K.find_by_id(written, ends["customer"], "o_custkey").where(F.col("o_orderkey") != ends["last"])
    return by_key.unionByName(by_customer)


derived(
    "prompt_records",
    """
    SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'not json' ELSE concat(chr(123), '"id": ', cast(conv_id AS varchar(19)), ', "slug": "s', cast(turn AS varchar(19)),
      '", "premium": ', CASE WHEN turn % 2 = 0 THEN 'true' ELSE 'false' END, ', "new": false, "category": ', chr(123), '"id": 30, "name": "Solo", "subscriptions_id": ',
      chr(123), '"id": ', cast(conv_id % 5 AS varchar(19)), ', "subscription_slug": "monthly"', chr(125), chr(125), ', "sub_category": ', chr(123), '"id": 31, "slug": "c"', chr(125), chr(125))
      END AS record FROM {conversations}
    """,
    "conversations",
)


@query(
    "nested_prompts", "prompt_records",
    """SELECT conv_id, turn, CASE WHEN turn % 5 <> 4 THEN conv_id END AS id, CASE WHEN turn % 5 <> 4 THEN turn % 2 = 0 END AS premium,
      CASE WHEN turn % 5 <> 4 THEN 'Solo' END AS category_name, CASE WHEN turn % 5 <> 4 THEN conv_id % 5 END AS subscription_id,
      CASE WHEN turn % 5 <> 4 THEN 'c' END AS sub_category_slug FROM prompt_records""",
)
def nested_prompts(rows):
    made = readers.parse_prompt_records(rows.withColumnRenamed("turn", "turn_no"), "record", keep=("conv_id", "turn_no"))
    return made.select(
        "conv_id", F.col("turn_no").alias("turn"), "id", "premium", "category_name", "subscription_id", "sub_category_slug"
    )


@query("row_records", "part", "SELECT p_partkey AS k, p_name AS name, p_retailprice AS price FROM part")
def row_records(part):
    record = K.as_records(part)
    return record.select(
        F.get_json_object("record", "$.p_partkey").cast("bigint").alias("k"), F.get_json_object("record", "$.p_name").alias("name"),
        F.get_json_object("record", "$.p_retailprice").cast("double").alias("price"),
    )


@query(
    "content_ids", "pages",
    """SELECT page_id, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12)) AS id
    FROM (SELECT page_id, md5(concat('article', chr(31), url)) AS h FROM pages)""",
)
def content_ids(pages):
    return pages.select("page_id", K.content_id(F.lit("article"), F.col("url")).alias("id"))


@query(
    "content_counts", "crawl_lists",
    """SELECT t AS content_type, cast(coalesce(n, 0) AS bigint) AS n FROM (SELECT unnest(['blog', 'prompt', 'article', 'product']) AS t)
      LEFT JOIN (SELECT CASE content_type WHEN 'blog' THEN 'article' ELSE content_type END AS content_type, count(*) AS n FROM crawl_lists GROUP BY 1) ON t = content_type
    UNION ALL SELECT 'all', count(*) FROM crawl_lists WHERE content_type <> 'news'""",
)
def content_type_counts(lists):
    """Blogs are counted as articles, so that one known type is absent."""
    kind = F.when(F.col("content_type") == "blog", "article").otherwise(F.col("content_type"))
    return content_counts(lists.withColumn("content_type", kind))


# ------------------------------------------------------------------ search

_ORDER = "o_orderkey, o_orderstatus, o_totalprice, o_orderpriority"


@query("search_equals", "orders", f"SELECT {_ORDER} FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'")
def search_equals(orders):
    rows = orders.select(*_ORDER.split(", "))
    return S.equals(rows, {"o_orderstatus": "F", "o_orderpriority": "2-HIGH", "no_such_field": 1})


@query("search_is_null", "products", "SELECT p_partkey FROM products WHERE availability_raw IS NULL AND price_raw = 'call us'")
def search_is_null(rows):
    return S.equals(rows, {"availability_raw": None, "price_raw": "call us"}).select("p_partkey")


@query("search_json_filter", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey = 3")
def search_json_filter(orders):
    return S.equals(orders, S.parse_filters('{"o_orderstatus": "P", "o_custkey": 3}')).select("o_orderkey")


@query(
    "search_saved", "orders",
    """SELECT o_orderkey, 'urgent' AS search FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT o_orderkey, 'open high' FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH'""",
)
def search_saved(orders):
    searches = {"urgent": '{"o_orderpriority": "1-URGENT"}', "open high": '{"o_orderstatus": "O", "o_orderpriority": "2-HIGH"}'}
    return orders.select("o_orderkey", F.explode(S.matched_searches(orders, searches)).alias("search"))


derived(
    "saved_searches",
    # chr(123) and chr(125) are braces, which would name a table here.
    """
    SELECT name, concat(chr(123), tests, end_of) AS filters FROM (
      SELECT concat('customer ', cast(o_custkey AS varchar(19))) AS name,
        concat('"o_orderstatus": "F", "no_such_field": 1, "o_custkey": ', cast(o_custkey AS varchar(19))) AS tests, chr(125) AS end_of FROM {orders} GROUP BY o_custkey
      UNION ALL SELECT concat('order ', cast(o_orderkey AS varchar(19))), concat('"o_orderkey": "', cast(o_orderkey AS varchar(19)), '"'), chr(125) FROM {orders}
      UNION ALL SELECT concat('priority ', o_orderpriority), concat('"o_orderpriority": "', o_orderpriority, '", "o_comment": null'), chr(125) FROM {orders} GROUP BY o_orderpriority
      UNION ALL SELECT concat('broken ', o_orderpriority), concat('"o_orderpriority": "', o_orderpriority, '"'), '' FROM {orders} GROUP BY o_orderpriority
    ) made
    """,
    "orders",
)


@query(
    "search_saved_table", "orders saved_searches",
    """SELECT o_orderkey, concat('customer ', cast(o_custkey AS varchar)) AS name FROM orders WHERE o_orderstatus = 'F'
      UNION ALL SELECT o_orderkey, concat('order ', cast(o_orderkey AS varchar)) FROM orders
      UNION ALL SELECT o_orderkey, concat('priority ', o_orderpriority) FROM orders WHERE o_orderkey % 3 = 0""",
)
def search_saved_table(orders, searches):
    """More searches than rows; every third order has no comment."""
    marked = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.when(F.col("o_orderkey") % 3 != 0, "c").alias("o_comment"))
    return S.saved_search_matches(marked, searches, "o_orderkey")


@query(
    "search_json_problems", "events",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Invalid JSON in filters parameter' END AS problem FROM events""",
)
def search_json_problems(events):
    text = F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit("}"))).when(F.col("event_id") % 3 == 1, "").otherwise(F.col("props"))
    return events.select("event_id", S.filter_problem(text).alias("problem"))


@query(
    "search_predicates", "orders",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('5-LOW')
      AND o_totalprice > 1000 AND o_totalprice <= 300000 AND o_custkey >= 10 AND o_custkey < 900 AND o_orderstatus <> 'O'
      AND contains(o_orderpriority, 'H') AND o_orderstatus = 'F'""",
)
def search_predicates(orders):
    filters = [
        S.Filter("o_orderstatus", "in", ["F", "O"]), S.Filter("o_orderpriority", "not_in", ["5-LOW"]),
        S.Filter("o_totalprice", "gt", 1000), S.Filter("o_totalprice", "lte", 300000), S.Filter("o_custkey", "gte", 10),
        S.Filter("o_custkey", "lt", 900), S.Filter("o_orderstatus", "ne", "O"), S.Filter("o_orderpriority", "contains", "H"),
        S.Filter("o_orderstatus", "eq", "F"),
    ]
    return S.matching(orders, filters).select("o_orderkey", "o_totalprice")


@query(
    "search_array_contains", "documents",
    "SELECT doc_id FROM documents WHERE list_contains(string_split(text, ' '), 'the')",
)
def search_array_contains(docs):
    rows = docs.withColumn("words", F.split("text", " "))
    return S.matching(rows, [S.Filter("words", "contains", "the")]).select("doc_id")


@query(
    "search_query", "orders",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 20""",
)
def search_query(orders):
    wanted = S.ContentQuery("product", (S.Filter("o_orderstatus", "eq", "O"),), sort_by="o_totalprice", limit=50, offset=20)
    return S.run_query(orders, wanted, tiebreak="o_orderkey").select("o_orderkey", "o_totalprice")


@query("search_page", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 100 OFFSET 30")
def search_page(orders):
    return S.search(orders, {"o_orderstatus": "P"}, limit=100, offset=30, tiebreak="o_orderkey").select("o_orderkey")


@query(
    "search_cursor", "orders",
    """SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC NULLS LAST, o_orderkey LIMIT 100 OFFSET 200""",
)
def search_cursor(orders):
    """The third page, reached by two cursors."""
    cursor = None
    for _ in range(2):
        cursor = S.next_cursor(S.cursor_page(orders, cursor, "o_orderpriority", tiebreak="o_orderkey"), "o_orderpriority", "o_orderkey")
    return S.cursor_page(orders, cursor, "o_orderpriority", tiebreak="o_orderkey").select("o_orderkey", "o_orderpriority")


@query(
    "sort_ascending", "orders",
    "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority NULLS LAST, o_orderkey",
)
def sort_ascending(orders):
    return S.ordered(orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "asc", "o_orderkey")


# ---------------------------------------------------------- request checks

derived(
    "job_requests",
    """
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN '   ' WHEN 1 THEN repeat('n', 201) ELSE concat(' job ', cast(event_id AS varchar(19))) END AS name,
      event_id % 1003 AS n_urls, CASE event_id % 4 WHEN 0 THEN 'immediate' WHEN 1 THEN 'scheduled' WHEN 2 THEN 'later' END AS schedule
    FROM {events}
    """,
    "events",
)


@query(
    "job_request_errors", "job_requests",
    """SELECT event_id, concat_ws('|', CASE WHEN trim(name) = '' THEN 'Job name cannot be empty' END,
      CASE WHEN length(name) > 200 THEN 'Job name is longer than 200 characters' END, CASE WHEN n_urls < 1 THEN 'At least 1 URL is required' END,
      CASE WHEN n_urls > 1000 THEN 'Maximum 1000 URLs allowed per job' END,
      CASE WHEN schedule IS NULL OR schedule = 'later' THEN 'Schedule must be one of: immediate, scheduled' END) AS errors FROM job_requests""",
)
def job_request_errors(rows):
    urls = F.array_repeat(F.lit("u"), F.col("n_urls").cast("int"))
    return rows.select("event_id", F.array_join(Q.job_request_errors(F.col("name"), urls, F.col("schedule")), "|").alias("errors"))


@query(
    "batch_request_errors", "job_requests",
    """SELECT event_id, concat_ws('|', CASE WHEN n_urls < 1 THEN 'At least 1 URL is required' END,
      CASE WHEN n_urls > 100 THEN 'Maximum 100 URLs allowed per batch request' END,
      CASE WHEN event_id % 25 NOT BETWEEN 1 AND 20 THEN 'Concurrency must be between 1 and 20' END) AS errors FROM job_requests""",
)
def batch_request_errors(rows):
    urls = F.array_repeat(F.lit("u"), F.col("n_urls").cast("int"))
    return rows.select("event_id", F.array_join(Q.batch_request_errors(urls, F.col("event_id") % 25), "|").alias("errors"))
