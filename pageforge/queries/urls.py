"""URL queries."""

from pyspark.sql import functions as F

from pageforge.functions import urls as U
from pageforge.operators import ruletable as T
from pageforge.operators import urlrules as R
from pageforge.operators.quality import selector_errors, url_list_errors
from pageforge.queries.base import derived, query

# One URL per page: the page's own, or a variant that trips one check.
derived(
    "url_mix",
    """
    SELECT page_id, CASE page_id % 20
      WHEN 1 THEN replace(replace(url, 'https:', 'ftp:'), 'http:', 'file:')
      WHEN 2 THEN concat('https://a', cast(page_id AS varchar(19)), '.org/report.PDF')
      WHEN 3 THEN concat('https://localhost/', cast(page_id AS varchar(19)))
      WHEN 4 THEN concat('http://192.168.', cast(page_id % 300 AS varchar(19)), '.7/x')
      WHEN 5 THEN concat('http://', cast(page_id % 260 AS varchar(19)), '.16.5.4:8080/x')
      WHEN 6 THEN concat('https://localnews', cast(page_id AS varchar(19)), '.com/')
      WHEN 7 THEN concat(url, '&q=config')
      WHEN 8 THEN concat('https://user:pw@Example.com:443/p', cast(page_id AS varchar(19)))
      WHEN 9 THEN concat('HTTPS://Mixed.Host', cast(page_id AS varchar(19)), '.Org/A;v=1?b=2&a=1&b=1#frag')
      WHEN 10 THEN concat('https://h', cast(page_id AS varchar(19)), '.org/')
      WHEN 11 THEN concat('https://h', cast(page_id AS varchar(19)), '.org/?z=1&y=/')
      WHEN 12 THEN concat('  ', url, '  ')
      WHEN 13 THEN concat('//h', cast(page_id AS varchar(19)), '.org/rel')
      WHEN 14 THEN concat('no scheme ', cast(page_id AS varchar(19)))
      WHEN 15 THEN ''
      WHEN 16 THEN concat('https://h.org/..', '/up/', cast(page_id AS varchar(19)))
      WHEN 17 THEN concat('https://h.org/environment/', cast(page_id AS varchar(19)))
      ELSE url END AS url
    FROM {pages}
    """,
    "pages",
)

_STRIPPED = "trim(url, ' ')"
_PARTS = rf"""
    SELECT page_id, url, {_STRIPPED} AS u,
      lower(regexp_extract({_STRIPPED}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
      regexp_extract({_STRIPPED}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS netloc,
      regexp_replace(regexp_extract({_STRIPPED}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '') AS path,
      regexp_extract({_STRIPPED}, '^[^?#]*[?]([^#]*)', 1) AS query
    FROM url_mix
"""
_REASON = rf"""
    WITH parts AS ({_PARTS}),
    hosts AS (
      SELECT *, lower(regexp_extract(netloc, '^(?:.*@)?([^:]*)', 1)) AS host FROM parts
    ),
    numbers AS (
      SELECT *, CASE WHEN regexp_full_match(host,
          '(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){{3}}')
        THEN ((cast(split_part(host, '.', 1) AS bigint) * 256 + cast(split_part(host, '.', 2) AS bigint)) * 256
          + cast(split_part(host, '.', 3) AS bigint)) * 256 + cast(split_part(host, '.', 4) AS bigint) END AS ip
      FROM hosts
    ),
    reasons AS (
      SELECT page_id, url, scheme, netloc, path, query, host, CASE
        WHEN url IS NULL OR url = '' THEN 'empty'
        WHEN scheme NOT IN ('http', 'https') THEN 'scheme'
        WHEN host = '' THEN 'host'
        WHEN host IN ('localhost', '127.0.0.1', '0.0.0.0', '::1', 'example.com', 'example.org', 'example.net') THEN 'blocked_domain'
        WHEN ip IS NOT NULL AND (ip // 16777216 IN (0, 10, 127) OR ip // 65536 IN (169 * 256 + 254, 192 * 256 + 168)
          OR ip // 1048576 = 172 * 16 + 1 OR ip // 256 IN ((192 * 256) * 256, (192 * 256) * 256 + 2, (198 * 256 + 51) * 256 + 100, (203 * 256) * 256 + 113)
          OR ip // 131072 = 198 * 128 + 9 OR ip // 268435456 = 15) THEN 'private_address'
        WHEN ip IS NULL AND (contains(host, 'local') OR contains(host, '::1')) THEN 'private_address'
        WHEN regexp_matches(lower(path), '\.(pdf|doc|docx|xls|xlsx|ppt|pptx|zip|rar|tar|gz|exe|dmg|pkg|mp3|mp4|avi|mov|wmv|flv|jpg|jpeg|png|gif|bmp|svg|ico|css|js|xml|json|txt|log)$')
          THEN 'skipped_extension'
        WHEN regexp_matches(lower(url), '\.\./|%2e%2e%2f|%252e%252e%252f|file://|ftp://|admin|login|password|secret|.env|config')
          THEN 'suspicious_pattern'
        END AS reason
      FROM numbers
    )
"""
_REASON = _REASON.replace("{{", "{").replace("}}", "}")


@query("url_reject_reason", "url_mix", _REASON + "SELECT page_id, url, reason FROM reasons")
def url_reject_reason(urls):
    return R.screen(urls)


@query("url_valid", "url_mix", _REASON + "SELECT page_id, url FROM reasons WHERE reason IS NULL")
def url_valid(urls):
    return urls.where(U.is_valid_url(F.col("url")))


@query(
    "url_reject_counts", "url_mix",
    _REASON + "SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM reasons GROUP BY 1",
)
def url_reject_counts(urls):
    return R.screen(urls).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "url_private_host", "url_mix",
    _REASON.replace("WHEN host IN", "WHEN host IN ('') AND host IN")
    + "SELECT page_id, host, coalesce(reason = 'private_address', false) AS private FROM reasons"
    " WHERE scheme IN ('http', 'https') AND host <> '' ",
)
def url_private_host(urls):
    web = urls.where(U.scheme_of(F.col("url")).isin("http", "https"))
    host = web.select("page_id", U.host_of(F.col("url")).alias("host")).where("host <> ''")
    return host.withColumn("private", U.is_private_host(F.col("host")))


# One spelling per row; the checking SQL names the private ones.
derived(
    "ipv6_urls",
    """
    SELECT page_id, concat('http://[', CASE page_id % 14 WHEN 0 THEN '::1' WHEN 1 THEN '0:0:0:0:0:ffff:7f00:1' WHEN 2 THEN '::ffff:8.8.8.8'
      WHEN 3 THEN '::FFFF:10.1.2.3' WHEN 4 THEN '2001:4860:4860::8888' WHEN 5 THEN 'fe80::1' WHEN 6 THEN 'FD12:3456::1' WHEN 7 THEN '2001:db8::5'
      WHEN 8 THEN '0000:0000:0000:0000:0000:0000:0000:0001' WHEN 9 THEN '2606:4700::1111' WHEN 10 THEN '2001:20::7' WHEN 11 THEN '2001:0:1::'
      WHEN 12 THEN '64:ff9b:1::9' ELSE '::' END, ']:8080/x') AS url FROM {pages}
    """,
    "pages",
)


@query(
    "url_private_ipv6", "ipv6_urls",
    "SELECT page_id, page_id % 14 NOT IN (2, 4, 9, 10) AS private FROM ipv6_urls",
)
def url_private_ipv6(urls):
    return urls.select("page_id", U.is_private_host(U.host_of(F.col("url"))).alias("private"))


@query(
    "url_skipped_extension", "url_mix",
    rf"""WITH parts AS ({_PARTS}) SELECT page_id, url FROM parts WHERE regexp_matches(lower(path),
    '\.(pdf|doc|docx|xls|xlsx|ppt|pptx|zip|rar|tar|gz|exe|dmg|pkg|mp3|mp4|avi|mov|wmv|flv|jpg|jpeg|png|gif|bmp|svg|ico|css|js|xml|json|txt|log)$')""",
)
def url_skipped_extension(urls):
    return urls.where(U.has_skipped_extension(F.col("url")))


@query(
    "url_suspicious", "url_mix",
    r"""SELECT page_id, url FROM url_mix WHERE regexp_matches(lower(url),
    '\.\./|%2e%2e%2f|%252e%252e%252f|file://|ftp://|sftp://|admin|login|password|secret|wp-admin|wp-login|.env|config')""",
)
def url_suspicious(urls):
    return urls.where(U.has_suspicious_pattern(F.col("url")))


_NORMAL = rf"""
    WITH parts AS ({_PARTS}),
    joined AS (
      SELECT page_id, path, concat(scheme, '://', netloc, path, CASE WHEN query <> '' THEN
        concat('?', array_to_string(list_sort(string_split(query, '&')), '&')) ELSE '' END) AS j FROM parts
    ),
    normal AS (
      SELECT page_id, CASE WHEN j LIKE '%/' AND length(path) <= 1 THEN rtrim(j, '/') ELSE j END AS normalized FROM joined
    )
"""


@query("url_normalize", "url_mix", _NORMAL + "SELECT page_id, normalized FROM normal")
def url_normalize(urls):
    return urls.select("page_id", U.normalize_url(F.col("url")).alias("normalized"))


derived(
    "url_repeats",
    """
    SELECT page_id, concat('https://s', cast(page_id % 40 AS varchar(19)), '.org/p?b=', cast(page_id % 3 AS varchar(19)),
      CASE page_id % 2 WHEN 0 THEN '&a=1#x' ELSE '&a=1' END) AS url FROM {pages}
    """,
    "pages",
)


@query(
    "url_dedup", "url_repeats",
    """
    SELECT page_id, url, normalized FROM (
      SELECT *, row_number() OVER (PARTITION BY normalized ORDER BY page_id) AS k FROM (
        SELECT page_id, url, concat(split_part(url, '?', 1), '?a=1&b=', regexp_extract(url, 'b=([0-9]+)', 1)) AS normalized
        FROM url_repeats)) WHERE k = 1
    """,
)
def url_dedup(urls):
    return R.unique_urls(urls, "page_id").select("page_id", "url", "normalized")


@query(
    "url_domain", "url_mix",
    rf"""WITH parts AS ({_PARTS.replace("trim(url, ' ')", "ltrim(url, ' ')")}) SELECT page_id, lower(netloc) AS domain FROM parts""",
)
def url_domain(urls):
    return urls.select("page_id", U.domain_of(F.col("url")).alias("domain"))


@query(
    "url_same_domain", "pages",
    r"""
    WITH links AS (
      SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href FROM pages)
    SELECT page_id, count(*) AS links, count(*) FILTER (WHERE href LIKE '/%' AND href NOT LIKE '//%') AS internal
    FROM links GROUP BY page_id
    """,
)
def url_same_domain(pages):
    from pageforge.operators.extract import links

    flagged = links(pages).withColumn("same", U.same_domain(F.col("url"), F.col("href")))
    return flagged.groupBy("page_id").agg(F.count("*").alias("links"), F.count_if("same").alias("internal"))


@query(
    "url_blocklist", "url_mix orders",
    _REASON.replace("WHEN host IN", "WHEN host IN ('') AND host IN")
    + """, blocked AS (SELECT DISTINCT concat('h', cast(o_orderkey AS varchar), '.org') AS domain FROM orders WHERE o_orderkey % 7 = 0)
    SELECT page_id, url FROM reasons WHERE reason IS NULL AND host NOT IN (SELECT domain FROM blocked)""",
)
def url_blocklist(urls, orders):
    names = orders.select(F.concat(F.lit("H"), F.col("o_orderkey").cast("string"), F.lit(".org")).alias("domain"), "o_orderkey")
    blocked = R.remove_blocked(
        R.add_blocked(names.where("o_orderkey % 14 = 0").select(F.lower("domain").alias("domain")), names.where("o_orderkey % 7 = 0 OR o_orderkey % 5 = 0")),
        names.where("o_orderkey % 7 <> 0").select("domain"),
    )
    return R.screen_against(urls, blocked)


_RULES = (
    R.UrlRules()
    .add("allow", "http://*")
    .add("allow", "*/en/*")
    .add("allow", r"\.example\.net/", is_regex=True)
    .add("deny", "*/6?5*")
    .add("deny", "(pills")
    .add("deny", r"[?]page=\d+", is_regex=True)
)
_DENY = r"(regexp_full_match(url, '.*/6.5.*') OR contains(url, '(pills') OR regexp_matches(url, '[?]page=\d+'))"
_ALLOW = r"(regexp_full_match(url, 'http://.*') OR regexp_full_match(url, '.*/en/.*') OR regexp_matches(url, '\.example\.net/'))"


@query("url_allow_deny", "pages", f"SELECT page_id, url FROM pages WHERE NOT {_DENY} AND {_ALLOW}")
def url_allow_deny(pages):
    return R.filter_urls(pages.select("page_id", "url"), _RULES)


_GROUPED = R.UrlRules(
    deny_regex=tuple(f"(never{k})/" for k in range(60)) + (r"/(\d)\1", r"(?P<digit>[2-4])[^/]*(?P=digit)$"), allow=("https://*",)
)


@query(
    "url_rules_groups", "pages",
    f"""SELECT page_id, url FROM pages WHERE regexp_full_match(url, 'https://.*')
      AND NOT ({" OR ".join(f"regexp_matches(url, '/{d}{d}')" for d in range(10))})
      AND NOT ({" OR ".join(f"regexp_matches(url, '{d}[^/]*{d}$')" for d in (2, 3, 4))})""",
)
def url_rules_groups(pages):
    """Back-references keep their groups, however many rules there are."""
    return R.filter_urls(pages.select("page_id", "url"), _GROUPED)


@query(
    "url_deny_only", "pages",
    "SELECT page_id, url FROM pages WHERE NOT regexp_full_match(url, '.*spam.*')",
)
def url_deny_only(pages):
    return R.filter_urls(pages.select("page_id", "url"), R.UrlRules(deny=("*spam*",)))


@query(
    "url_rule_matches", "pages",
    r"""
    SELECT page_id, 'allow' AS kind, 'http://*' AS pattern FROM pages WHERE regexp_full_match(url, 'http://.*')
    UNION ALL SELECT page_id, 'allow', '*/en/*' FROM pages WHERE regexp_full_match(url, '.*/en/.*')
    UNION ALL SELECT page_id, 'allow', '\.example\.net/' FROM pages WHERE regexp_matches(url, '\.example\.net/')
    UNION ALL SELECT page_id, 'deny', '*/6?5*' FROM pages WHERE regexp_full_match(url, '.*/6.5.*')
    UNION ALL SELECT page_id, 'deny', '(pills' FROM pages WHERE contains(url, '(pills')
    UNION ALL SELECT page_id, 'deny', '[?]page=\d+' FROM pages WHERE regexp_matches(url, '[?]page=\d+')
    """,
)
def url_rule_matches(pages):
    found = pages.select("page_id", F.explode(_RULES.matched(F.col("url"))).alias("r"))
    return found.select("page_id", "r.kind", "r.pattern")


derived(
    "rule_rows",
    """
    SELECT CASE WHEN page_id % 3 = 0 THEN 'allow' ELSE 'deny' END AS kind, page_id % 2 = 0 AND page_id % 3 = 0 AS is_regex,
      url AS pattern FROM {pages}
    """,
    "pages",
)


@query(
    "url_rule_counts", "rule_rows",
    """
    SELECT 'whitelist_patterns' AS kind, count(*) AS n FROM rule_rows WHERE kind = 'allow' AND NOT is_regex
    UNION ALL SELECT 'blacklist_patterns', count(*) FROM rule_rows WHERE kind = 'deny' AND NOT is_regex
    UNION ALL SELECT 'regex_whitelist', count(*) FROM rule_rows WHERE kind = 'allow' AND is_regex
    UNION ALL SELECT 'regex_blacklist', count(*) FROM rule_rows WHERE kind = 'deny' AND is_regex
    """,
)
def url_rule_counts(rules):
    return R.rule_counts(rules)


# A rule table that grows with the pages: per host and section, per number, per file name, per domain ending.
derived(
    "page_rules",
    """
    SELECT DISTINCT 'allow' AS kind, false AS is_regex,
      'http*//' || split_part(url, '/', 3) || '/' || split_part(url, '/', 4) || '/*' AS pattern FROM {pages}
    UNION ALL SELECT DISTINCT 'deny', false, '*/' || regexp_extract(url, '/([0-9]+)', 1) || '[?#]*' FROM {pages}
    UNION ALL SELECT DISTINCT 'deny', true, '/' || regexp_extract(url, '/([0-9]+)', 1) || '[.]html$' FROM {pages}
    UNION ALL SELECT DISTINCT 'allow', true, '^https?://(www|m)[.].*' || regexp_extract(url, '[.]([a-z]+)/', 1) || '/' FROM {pages}
    """,
    "pages",
)
_TABLE_HITS = """SELECT page_id, url, kind, is_regex, pattern FROM pages JOIN page_rules ON
  CASE WHEN is_regex THEN regexp_matches(url, pattern)
    ELSE regexp_full_match(url, replace(replace(pattern, '?', '.'), '*', '.*')) END"""


@query("url_rule_table_matches", "pages page_rules", f"SELECT page_id, kind, is_regex, pattern FROM ({_TABLE_HITS})")
def url_rule_table_matches(pages, rules):
    return T.matched_rules(pages.select("page_id", "url"), rules).select("page_id", "rule.*")


@query(
    "url_rule_table", "pages page_rules",
    f"""SELECT page_id, url FROM pages WHERE page_id IN (SELECT page_id FROM ({_TABLE_HITS}) WHERE kind = 'allow')
      AND page_id NOT IN (SELECT page_id FROM ({_TABLE_HITS}) WHERE kind = 'deny')""",
)
def url_rule_table(pages, rules):
    return T.filter_urls(pages.select("page_id", "url"), rules)


# References of every kind against page URLs; targets written out per kind.
derived(
    "url_references",
    """
    SELECT page_id, concat('https://h', cast(page_id AS varchar(19)), '.org/a/b/c?x=1#f') AS base,
      CASE page_id % 12 WHEN 0 THEN '/r' WHEN 1 THEN 'r' WHEN 2 THEN '../r' WHEN 3 THEN './r/' WHEN 4 THEN '?q=2'
        WHEN 5 THEN '#g' WHEN 6 THEN '//o.org/z' WHEN 7 THEN 'mailto:a@b.c' WHEN 8 THEN '..' WHEN 9 THEN '../../../r?y#z'
        WHEN 10 THEN '' ELSE 'https://o.org/k' END AS ref FROM {pages}
    """,
    "pages",
)


@query(
    "url_resolve", "url_references",
    """
    SELECT page_id, CASE ref WHEN '/r' THEN concat(h, '/r') WHEN 'r' THEN concat(h, '/a/b/r') WHEN '../r' THEN concat(h, '/a/r')
      WHEN './r/' THEN concat(h, '/a/b/r/') WHEN '?q=2' THEN concat(h, '/a/b/c?q=2') WHEN '#g' THEN concat(h, '/a/b/c?x=1#g')
      WHEN '//o.org/z' THEN 'https://o.org/z' WHEN '..' THEN concat(h, '/a/') WHEN '../../../r?y#z' THEN concat(h, '/r?y#z')
      WHEN '' THEN base ELSE ref END AS target
    FROM (SELECT *, concat('https://h', cast(page_id AS varchar), '.org') AS h FROM url_references)
    """,
)
def url_resolve(refs):
    return refs.select("page_id", U.resolve_url(F.col("base"), F.col("ref")).alias("target"))


@query(
    "url_protocol", "url_mix",
    "SELECT page_id, url, (starts_with(url, 'http://') OR starts_with(url, 'https://')) AS accepted FROM url_mix",
)
def url_protocol(urls):
    return urls.withColumn("accepted", U.has_http_protocol(F.col("url")))


# Lists of 25 URLs, each with a repeated, a blank, a wrong-scheme and a spaced entry.
derived(
    "url_entries",
    """
    SELECT cast(floor(page_id / 25) AS bigint) AS list_id, page_id % 25 AS pos, url FROM {pages}
    UNION ALL SELECT cast(floor(page_id / 25) AS bigint), 25 + page_id % 5, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN '  '
      WHEN 2 THEN 'ftp://x.org/a' WHEN 3 THEN concat(' ', url, '/with space ') ELSE concat(url, ' ') END
      FROM {pages} WHERE page_id % 25 < 5
    """,
    "pages",
)


@query(
    "url_list_errors", "url_entries",
    """
    WITH e AS (
      SELECT list_id, row_number() OVER (PARTITION BY list_id ORDER BY pos) - 1 AS pos, url, trim(url, ' ') AS t FROM url_entries),
    d AS (SELECT *, row_number() OVER (PARTITION BY list_id, t ORDER BY pos) > 1 AS dup, t LIKE 'http://%' OR t LIKE 'https://%' AS web FROM e)
    SELECT list_id, pos, concat('URL at index ', pos, ' cannot be empty') AS message FROM d WHERE t = ''
    UNION ALL SELECT list_id, pos, concat('URL at index ', pos, ' must use http or https protocol: ', t) FROM d WHERE t <> '' AND NOT web
    UNION ALL SELECT list_id, pos, concat('Duplicate URL found: ', t) FROM d WHERE web AND dup
    UNION ALL SELECT list_id, pos, concat('URL at index ', pos, ' contains spaces: ', t) FROM d WHERE web AND contains(t, ' ')
    UNION ALL SELECT list_id, -1, concat('Too many URLs: ', count(*), '. Maximum allowed: 28') FROM d GROUP BY list_id HAVING count(*) > 28
    """,
)
def url_list_check(entries):
    lists = entries.groupBy("list_id").agg(F.sort_array(F.collect_list(F.struct("pos", "url"))).alias("e"))
    lists = lists.select("list_id", F.col("e.url").alias("urls"))
    found = url_list_errors(lists, "list_id", "urls", max_count=28)
    return found.select("list_id", F.col("pos").cast("bigint").alias("pos"), "message")


derived(
    "selector_rows",
    """
    SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'h1, .title' WHEN 1 THEN '.invalid[' WHEN 2 THEN 'a:not(.x' WHEN 3 THEN '  '
      WHEN 4 THEN 'img[src^="DATA:"]' WHEN 5 THEN '<script>[(' ELSE NULL END AS selector FROM {pages}
    """,
    "pages",
)


@query(
    "selector_errors", "selector_rows",
    """
    SELECT page_id, 'title' AS field, concat('Selector for ''title'' ', m) AS message FROM (
      SELECT page_id, CASE WHEN selector IS NULL THEN 'must be a string' WHEN trim(selector) = '' THEN 'cannot be empty' END AS m
      FROM selector_rows) WHERE m IS NOT NULL
    UNION ALL SELECT page_id, 'title', concat('Unmatched brackets in selector for ''title'': ', selector) FROM selector_rows
      WHERE length(replace(selector, '[', '')) <> length(replace(selector, ']', ''))
    UNION ALL SELECT page_id, 'title', concat('Unmatched parentheses in selector for ''title'': ', selector) FROM selector_rows
      WHERE length(replace(selector, '(', '')) <> length(replace(selector, ')', ''))
    UNION ALL SELECT page_id, 'title', concat('Suspicious content in selector for ''title'': ', selector) FROM selector_rows
      WHERE contains(lower(selector), '<script') OR contains(lower(selector), 'javascript:') OR contains(lower(selector), 'data:')
    """,
)
def selector_check(rows):
    sets = rows.select("page_id", F.create_map(F.lit("title"), F.col("selector")).alias("selectors"))
    return selector_errors(sets, "page_id", "selectors").select("page_id", "field", "message")
