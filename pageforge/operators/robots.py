"""Robots rules as joins.

A snapshot is ``(snapshot_id, origin, fetched_at, status, content)``. Contents
are parsed once per snapshot into a small rule array; a URL meets its snapshot
by an equi-join on origin and hour, and the rules are read inside the row, so
URLs are never multiplied by rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageforge.functions.base import strip
from pageforge.functions.urls import origin_of

CACHE_SECONDS = 3600


def _unquoted(c: Column) -> Column:
    """Percent-decoding that leaves '+' and malformed escapes alone."""
    plus_safe = F.replace(c, F.lit("+"), F.lit("%2B"))
    return F.when(c.contains("%"), F.coalesce(F.try_url_decode(plus_safe), c)).otherwise(c)


def robots_path(url: Column) -> Column:
    """The part of a URL that rules are compared with."""
    rest = F.regexp_replace(strip(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*", "")
    return F.when(rest == "", "/").otherwise(_unquoted(rest))


def live_snapshots(snapshots: DataFrame, as_of: Column, cache_seconds: int = CACHE_SECONDS) -> DataFrame:
    """Cache expiry: snapshots not older than the cache time."""
    return snapshots.where(F.col("fetched_at") >= as_of - F.make_dt_interval(secs=F.lit(cache_seconds)))


def rule_lines(snapshots: DataFrame) -> DataFrame:
    """One row per rule with the agents group it belongs to.

    Columns: snapshot_id, line_no, grp, kind (allow, disallow, crawl-delay,
    request-rate), value. Lines are a snapshot's own content, so the windows
    per snapshot are bounded by one file.
    """
    lines = snapshots.where((F.col("status") == 200) & F.col("content").isNotNull()).select(
        "snapshot_id", F.posexplode(F.split("content", r"\r\n|[\n\r]")).alias("line_no", "line")
    )
    body = strip(F.substring_index("line", "#", 1))
    key = F.lower(strip(F.substring_index(body, ":", 1)))
    value = _unquoted(strip(F.substr(body, F.length(F.substring_index(body, ":", 1)) + 2)))
    named = key.isin("user-agent", "allow", "disallow", "crawl-delay", "request-rate") & body.contains(":")
    kind = F.when(F.col("line") == "", "blank").when(named, F.when(key == "user-agent", "agent").otherwise(key))
    read = lines.select("snapshot_id", "line_no", kind.alias("kind"), value.alias("value")).where("kind IS NOT NULL")
    by_file = Window.partitionBy("snapshot_id").orderBy("line_no")
    so_far = by_file.rowsBetween(Window.unboundedPreceding, 0)
    opens = (F.col("kind") == "agent") & (F.coalesce(F.lag("kind").over(by_file), F.lit("")) != "agent")
    grouped = read.withColumn("_opens", opens.cast("int"))
    heading = F.last(F.when(F.col("kind").isin("agent", "blank"), F.col("kind")), ignorenulls=True).over(so_far)
    return grouped.withColumns({"grp": F.sum("_opens").over(so_far), "_under": heading}).where(
        "_under = 'agent'"
    ).select("snapshot_id", "line_no", "grp", "kind", "value")


def agent_rules(snapshots: DataFrame, user_agent: str = "*") -> DataFrame:
    """Rules that apply to an agent: ``(snapshot_id, rules, crawl_delay)``.

    The first group naming the agent wins, else the first ``*`` group. A group
    without any rule line does not exist. Rules keep file order.
    """
    token = user_agent.split("/")[0].lower()
    rows = rule_lines(snapshots)
    name = F.lower("value")
    is_agent = F.col("kind") == "agent"
    star = is_agent & (F.col("value") == "*")
    named = is_agent & (F.col("value") != "*") & F.lit(token).contains(name)
    rule = F.struct("line_no", (F.col("kind") == "allow").alias("allow"), F.col("value").alias("path"))
    delay = F.when((F.col("kind") == "crawl-delay") & F.col("value").rlike("^[0-9]+$"), F.col("value").cast("double"))
    groups = rows.groupBy("snapshot_id", "grp").agg(
        F.bool_or(star).alias("star"),
        F.bool_or(named).alias("named"),
        F.count_if(~is_agent).alias("n_rules"),
        F.sort_array(F.collect_list(F.when(F.col("kind").isin("allow", "disallow"), rule))).alias("rules"),
        F.max_by(delay, F.when(delay.isNotNull(), F.col("line_no"))).alias("crawl_delay"),
    ).where("n_rules > 0")
    # A first "*" group is only the fallback, even when it names the agent as well.
    first_star = F.min(F.when(F.col("star"), F.col("grp"))).over(Window.partitionBy("snapshot_id"))
    placed = groups.withColumn("_first_star", first_star)
    fallback = F.col("grp") == F.col("_first_star")
    usable = placed.withColumn(
        "rank",
        F.when(F.col("named") & ~F.col("star"), F.col("grp")).when(fallback, F.col("grp") + F.lit(2**40)),
    ).where("rank IS NOT NULL")
    best = usable.groupBy("snapshot_id").agg(
        F.min_by(F.struct("rules", "crawl_delay"), "rank").alias("b")
    )
    return best.select("snapshot_id", "b.rules", "b.crawl_delay")


def rules_allow(rules: Column, path: Column) -> Column:
    """First rule in file order whose path starts the URL path; none allows.
    An empty Disallow allows everything; ``*`` in a path is an ordinary character."""
    hit = F.get(F.filter(rules, lambda r: path.startswith(r["path"])), F.lit(0))
    return F.coalesce(hit["allow"] | (hit["path"] == ""), F.lit(True))


def intervals(snapshots: DataFrame, cache_seconds: int = CACHE_SECONDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """When each snapshot is the one to use, listed per time bucket: ``(origin, bucket, starts, ends, snapshot_id, ...)``.

    A snapshot counts from its fetch until the cache time is over or the next
    fetch of its origin, so the intervals of an origin do not overlap. None is
    wider than a bucket, so none is listed more than twice.
    """
    in_order = Window.partitionBy("origin").orderBy("fetched_at", "snapshot_id")
    starts = _seconds("fetched_at")
    cut = snapshots.where("origin IS NOT NULL AND fetched_at IS NOT NULL").select(
        "origin", "snapshot_id", *carry, starts.alias("starts"), F.least(starts + cache_seconds, F.lead(starts).over(in_order)).alias("ends")
    )
    first, last = F.floor(F.col("starts") / cache_seconds), F.floor(F.col("ends") / cache_seconds)
    return cut.where("starts < ends").select("*", F.explode(F.sequence(first, last)).alias("bucket"))


def _seconds(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6)


def latest_snapshot(
    requests: DataFrame, snapshots: DataFrame, request_id: str, url: str = "url", at: str = "requested_at",
    cache_seconds: int = CACHE_SECONDS, carry: dict[str, Column] | None = None, brought: tuple[str, ...] = (),
) -> DataFrame:
    """As-of join: for each request the newest snapshot of its origin not older than the cache time.

    Requests meet the snapshots' intervals by origin and time bucket, and at most
    one interval holds a request's time: an equi-join with one shuffle of the
    requests and nothing to choose afterwards. Returns ``(request_id, snapshot_id)``,
    null when there is none, the ``carry`` columns of the request and the ``brought``
    columns of the snapshot.
    """
    carry = carry or {}
    asked = requests.select(request_id, origin_of(F.col(url)).alias("_origin"), _seconds(at).alias("_at"), *[c.alias(n) for n, c in carry.items()])
    asked = asked.withColumn("_bucket", F.floor(F.col("_at") / cache_seconds))
    known = intervals(snapshots, cache_seconds, brought)
    meets = (
        (F.col("_origin") == F.col("origin")) & (F.col("_bucket") == F.col("bucket")) & (F.col("_at") >= F.col("starts")) & (F.col("_at") < F.col("ends"))
    )
    return asked.join(known, meets, "left").select(request_id, "snapshot_id", *carry, *brought)


def check_robots(
    requests: DataFrame, snapshots: DataFrame, request_id: str, user_agent: str = "*", url: str = "url",
    at: str = "requested_at", cache_seconds: int = CACHE_SECONDS, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per request: ``snapshot_id``, ``allowed``, ``crawl_delay`` and the ``keep`` columns. A missing, stale or
    failed snapshot allows and gives no delay.

    The rules are joined to the snapshots first, so requests are shuffled once.
    """
    ruled = snapshots.join(agent_rules(snapshots, user_agent), "snapshot_id", "left")
    kept = {n: F.col(n) for n in keep if n != request_id}
    chosen = latest_snapshot(
        requests, ruled, request_id, url, at, cache_seconds, carry=kept | {"_path": robots_path(F.col(url))}, brought=("rules", "crawl_delay")
    )
    return chosen.select(request_id, "snapshot_id", rules_allow(F.col("rules"), F.col("_path")).alias("allowed"), "crawl_delay", *kept)
