"""Robots compliance queries."""

from pyspark.sql import functions as F

from pageforge.operators import robots as R
from pageforge.queries.base import derived, query

# One fresh snapshot per origin, except: hosts "m." have none, hosts "blog." a
# stale one, hosts "www." a failed one. Other hosts also have an older snapshot
# with opposite rules, and one fetched after the request.
_LINES = (
    "concat('# rules', {nl}, 'User-agent: badbot', {nl}, 'user-Agent : Test', {nl}, 'Disallow: /en/', {nl}, 'Allow: /en/1 # never read', {nl},"
    " 'Crawl-delay: 5', {nl}, {nl}, 'User-agent: ghost', {nl}, {nl}, 'User-agent: *', {nl}, 'Allow: /fr/8', {nl}, 'Disallow: /%66r/', {nl},"
    " 'Crawl-delay: 2', {nl}, 'Disallow:', {nl}, 'Disallow: /')"
).replace("{nl}", "chr(10)")
derived(
    "robots_snapshots",
    f"""
    WITH o AS (SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin FROM {{pages}})
    SELECT concat(origin, '#1') AS snapshot_id, origin, cast(CASE WHEN origin LIKE '%//blog.%' THEN '2024-01-01 09:00:00' ELSE '2024-01-01 11:40:00' END
      AS timestamp) AS fetched_at, CASE WHEN origin LIKE '%//www.%' THEN 404 ELSE 200 END AS status, {_LINES} AS content
    FROM o WHERE origin NOT LIKE '%//m.%'
    UNION ALL
    SELECT concat(origin, '#0'), origin, cast('2024-01-01 11:10:00' AS timestamp), 200, concat('User-agent: *', chr(10), 'Disallow: /') FROM o
    WHERE origin NOT LIKE '%//m.%' AND origin NOT LIKE '%//blog.%' AND origin NOT LIKE '%//www.%'
    UNION ALL
    SELECT concat(origin, '#2'), origin, cast('2024-01-01 12:00:01' AS timestamp), 200, concat('User-agent: *', chr(10), 'Disallow: /') FROM o
    WHERE origin NOT LIKE '%//m.%' AND origin NOT LIKE '%//blog.%' AND origin NOT LIKE '%//www.%'
    """,
    "pages",
)
derived(
    "robots_requests",
    "SELECT page_id, url, cast('2024-01-01 12:00:00' AS timestamp) AS requested_at FROM {pages}",
    "pages",
)
_KIND = """
    asked AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*(.*)', 1) AS path,
      regexp_matches(url, '//(m|blog|www)[.]') AS open_host FROM robots_requests)
"""


def _check(requests, snapshots, agent):
    return R.check_robots(requests, snapshots, "page_id", agent).select("page_id", "allowed", "crawl_delay")


@query(
    "robots_named_agent", "robots_requests robots_snapshots",
    f"""WITH {_KIND} SELECT page_id, open_host OR NOT starts_with(path, '/en/') AS allowed, CASE WHEN NOT open_host THEN 5.0::double END AS crawl_delay FROM asked""",
)
def robots_named_agent(requests, snapshots):
    return _check(requests, snapshots, "TestBot/2.1")


@query(
    "robots_any_agent", "robots_requests robots_snapshots",
    f"""WITH {_KIND} SELECT page_id, open_host OR starts_with(path, '/fr/8') OR NOT starts_with(path, '/fr/') AS allowed,
      CASE WHEN NOT open_host THEN 2.0::double END AS crawl_delay FROM asked""",
)
def robots_any_agent(requests, snapshots):
    return _check(requests, snapshots, "Spider")


@query(
    "robots_snapshot_used", "robots_requests robots_snapshots",
    """SELECT page_id, CASE WHEN NOT regexp_matches(url, '//(m|blog)[.]') THEN concat(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), '#1') END
      AS snapshot_id FROM robots_requests""",
)
def robots_snapshot_used(requests, snapshots):
    return R.latest_snapshot(requests, snapshots, "page_id")


@query(
    "robots_rule_lines", "robots_snapshots",
    """SELECT snapshot_id, unnest([2, 3, 4, 5, 6, 8, 10, 11, 12, 13, 14, 15]) - 1 AS line_no, unnest(['agent', 'agent', 'disallow', 'allow', 'crawl-delay', 'agent', 'agent',
      'allow', 'disallow', 'crawl-delay', 'disallow', 'disallow']) AS kind, unnest(['badbot', 'Test', '/en/', '/en/1', '5', 'ghost', '*', '/fr/8', '/fr/', '2', '', '/']) AS value
      FROM robots_snapshots WHERE ends_with(snapshot_id, '#1') AND status = 200
    UNION ALL SELECT snapshot_id, unnest([1, 2]) - 1, unnest(['agent', 'disallow']), unnest(['*', '/']) FROM robots_snapshots WHERE NOT ends_with(snapshot_id, '#1')""",
)
def robots_rule_lines(snapshots):
    return R.rule_lines(snapshots).select("snapshot_id", "line_no", "kind", "value")


@query(
    "robots_cache_expiry", "robots_snapshots",
    "SELECT snapshot_id FROM robots_snapshots WHERE fetched_at >= timestamp '2024-01-01 12:20:00' - INTERVAL 3600 SECONDS",
)
def robots_cache_expiry(snapshots):
    return R.live_snapshots(snapshots, F.lit("2024-01-01 12:20:00").cast("timestamp")).select("snapshot_id")
