"""Job tracking, statistics and pacing queries."""

from pyspark.sql import functions as F

from pageforge.operators import jobs as J
from pageforge.operators import pacing as P
from pageforge.operators.stats import batch_summary
from pageforge.queries.base import derived, query

derived(
    "job_events",
    """
    SELECT concat('job-', cast(user_id AS varchar(19))) AS job_id, event_id AS seq, event_type <> 'error' AS success, ts, value FROM {events}
    """,
    "events",
)
derived(
    "job_states",
    """
    SELECT concat('job-', cast(user_id AS varchar(19))) AS job_id, event_id AS seq, ts, CASE WHEN value < 0.2 THEN 'cancelled' ELSE CASE event_type
      WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END END AS status FROM {events}
    """,
    "events",
)
derived(
    "job_totals",
    """
    SELECT concat('job-', cast(user_id AS varchar(19))) AS job_id, user_id % 90 + count(*) AS total_urls, min(ts) AS started_at FROM {events} GROUP BY user_id
    UNION ALL SELECT 'job-none', 10, cast(NULL AS timestamp) FROM {events} WHERE event_id = 0
    """,
    "events",
)
# A cancellation stands when the latest change before it, other cancellations aside, left the job pending or running.
_STATE = """
    walked AS (SELECT *, last_value(CASE WHEN status <> 'cancelled' THEN status END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS met, min(ts) OVER (PARTITION BY job_id) AS created_at FROM job_states),
    counted AS (SELECT *, status = 'cancelled' AS stands FROM walked WHERE status <> 'cancelled' OR met IS NULL OR met = 'pending' OR met = 'running'),
    state AS (SELECT job_id, status, created_at, CASE WHEN status NOT IN ('pending', 'running') THEN ts END AS completed_at FROM (
      SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY stands DESC, CASE WHEN stands THEN seq ELSE -seq END) AS n FROM counted) WHERE n = 1)
"""
_PROGRESS = """
    done AS (SELECT job_id, count(*) AS c, count(*) FILTER (WHERE success) AS s FROM job_events GROUP BY job_id),
    progress AS (SELECT t.job_id, t.total_urls, t.started_at, coalesce(c, 0) AS completed_urls, coalesce(s, 0) AS successful_urls,
      coalesce(c - s, 0) AS failed_urls, round(least(100.0, coalesce(c, 0) * 100.0 / total_urls), 6)::double AS progress_percentage
      FROM job_totals t LEFT JOIN done d ON t.job_id = d.job_id)
"""
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _when(name):
    return F.date_format(name, STAMP).alias(name)


def _sql_when(name):
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"


@query(
    "job_latest_state", "job_states",
    f"WITH {_STATE} SELECT job_id, status, {_sql_when('created_at')}, {_sql_when('completed_at')} FROM state",
)
def job_latest_state(states):
    return J.latest_states(states).select("job_id", "status", _when("created_at"), _when("completed_at"))


@query("job_status_filter", "job_states", f"WITH {_STATE} SELECT job_id, status FROM state WHERE status = 'completed'")
def job_status_filter(states):
    return J.with_status(J.latest_states(states), "completed").select("job_id", "status")


def _progress(events, totals):
    made = J.progress(events, totals)
    return made.withColumn("progress_percentage", F.round("progress_percentage", 6))


@query(
    "job_progress", "job_events job_totals",
    f"WITH {_PROGRESS} SELECT job_id, total_urls, completed_urls, successful_urls, failed_urls, progress_percentage FROM progress",
)
def job_progress(events, totals):
    return _progress(events, totals).drop("started_at")


@query(
    "job_eta", "job_events job_totals job_states",
    f"""WITH {_STATE}, {_PROGRESS} SELECT p.job_id, status, CASE WHEN status = 'running' AND completed_urls > 0 THEN
      round((total_urls - completed_urls) / (completed_urls / ((epoch_us(timestamp '2024-02-01') - epoch_us(started_at)) / 1000000.0)), 3)::double END
      AS estimated_remaining_time FROM progress p JOIN state s ON p.job_id = s.job_id""",
)
def job_eta(events, totals, states):
    jobs = J.progress(events, totals).join(J.latest_states(states).select("job_id", "status"), "job_id")
    timed = J.with_eta(jobs, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return timed.select("job_id", "status", F.round("estimated_remaining_time", 3).alias("estimated_remaining_time"))


def _seq_chunk():
    return F.floor(F.col("seq") / 1000)


@query(
    "job_errors", "job_events",
    """SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY seq, n) AS error_no, message FROM (
      SELECT job_id, seq, 0 AS n, concat('failed ', seq) AS message FROM job_events WHERE NOT success
      UNION ALL SELECT job_id, seq, 1, 'late' FROM job_events WHERE NOT success AND value > 10)""",
)
def job_errors(events):
    messages = F.array_compact(F.array(F.concat(F.lit("failed "), F.col("seq").cast("string")), F.when(F.col("value") > 10, "late")))
    return J.error_list(events.withColumn("errors", messages), _seq_chunk())


@query(
    "job_statistics", "job_states job_totals",
    f"""WITH {_STATE}, j AS (SELECT s.*, total_urls, status IN ('pending', 'running') AS active FROM state s JOIN job_totals t ON s.job_id = t.job_id)
    SELECT count(*) AS total_jobs, count(*) FILTER (WHERE active) AS active_jobs, count(*) FILTER (WHERE status = 'completed') AS completed_jobs,
      count(*) FILTER (WHERE status = 'failed') AS failed_jobs, count(*) FILTER (WHERE status = 'cancelled') AS cancelled_jobs,
      round(count(*) FILTER (WHERE status = 'completed') * 100.0 / greatest(count(*) FILTER (WHERE NOT active), 1), 6)::double AS success_rate,
      round(coalesce(sum(total_urls) FILTER (WHERE NOT active), 0) / greatest(count(*) FILTER (WHERE NOT active), 1), 6)::double AS avg_urls_per_job FROM j""",
)
def job_statistics(states, totals):
    stats = J.statistics(J.latest_states(states).join(totals, "job_id"))
    return stats.withColumns({c: F.round(c, 6) for c in ("success_rate", "avg_urls_per_job")})


@query(
    "job_status_record", "job_events job_totals job_states",
    f"""WITH {_STATE}, {_PROGRESS} SELECT p.job_id, status, total_urls, completed_urls, successful_urls, failed_urls, progress_percentage,
      concat('Job ', status, ': ', completed_urls, '/', total_urls, ' URLs processed') AS message
      FROM progress p JOIN state s ON p.job_id = s.job_id WHERE p.job_id = 'job-7'""",
)
def job_status_record(events, totals, states):
    jobs = _progress(events, totals).join(J.latest_states(states).select("job_id", "status"), "job_id")
    active = F.col("status").isin(*J.ACTIVE)
    stored = totals.select(
        "job_id", F.lit("completed").alias("status"), "total_urls", F.lit(5).alias("results_count"), F.lit(1).alias("error_count")
    )
    return J.status_record(jobs.where(active), jobs.where(~active), stored, "job-7")


@query(
    "job_stored_record", "job_totals job_events",
    """SELECT job_id, 'completed' AS status, total_urls, 9 AS completed_urls, 7 AS successful_urls, 2 AS failed_urls, 100.0::double AS progress_percentage,
      concat('Job completed: 9/', total_urls, ' URLs processed') AS message FROM job_totals WHERE job_id = 'job-8'""",
)
def job_stored_record(totals, events):
    gone = J.progress(events, totals).withColumn("status", F.lit("running")).where("job_id <> 'job-8'")
    stored = totals.select(
        "job_id", F.lit("completed").alias("status"), "total_urls", F.lit(9).alias("results_count"), F.lit(2).alias("error_count")
    )
    return J.status_record(gone, gone, stored, "job-8")


@query(
    "job_list_newest", "job_states",
    f"WITH {_STATE} SELECT job_id, status, {_sql_when('created_at')} FROM state ORDER BY state.created_at DESC, job_id LIMIT 20 OFFSET 5",
)
def job_list_newest(states):
    latest = J.latest_states(states)
    active = F.col("status").isin(*J.ACTIVE)
    both = J.all_jobs(latest.where(active), latest.where(~active))
    return J.newest(both, limit=20, offset=5).select("job_id", "status", _when("created_at"))


@query(
    "job_retention", "job_states",
    f"""WITH {_STATE} SELECT job_id, status FROM state WHERE completed_at IS NULL OR completed_at >= timestamp '2024-01-30 12:00:00' - INTERVAL 24 HOURS""",
)
def job_retention(states):
    kept = J.retained(J.latest_states(states), F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))
    return kept.select("job_id", "status")


@query(
    "job_batches", "job_events",
    """SELECT job_id, seq, cast((row_number() OVER (PARTITION BY job_id ORDER BY seq) - 1) // 5 AS bigint) AS batch_no FROM job_events""",
)
def job_batches(events):
    return J.batches(events, 5, _seq_chunk(), order="seq").select("job_id", "seq", "batch_no")


derived(
    "loose_events",
    """
    SELECT CASE WHEN user_id % 3 = 0 THEN NULL ELSE concat('job-', cast(user_id AS varchar(19))) END AS job_id, event_id AS seq FROM {events}
    """,
    "events",
)


@query(
    "job_batches_nulls", "loose_events",
    """SELECT job_id, seq, cast((row_number() OVER (PARTITION BY job_id ORDER BY seq) - 1) // 5 AS bigint) AS batch_no FROM loose_events""",
)
def job_batches_nulls(events):
    """Events without a job are numbered as a group of their own."""
    return J.batches(events, 5, _seq_chunk(), order="seq").select("job_id", "seq", "batch_no")


@query(
    "job_batch_progress", "job_events job_totals",
    """WITH b AS (SELECT job_id, (row_number() OVER (PARTITION BY job_id ORDER BY seq) - 1) // 10 AS batch_no, success FROM job_events),
    g AS (SELECT job_id, batch_no, count(*) AS c, count(*) FILTER (WHERE success) AS s FROM b GROUP BY ALL)
    SELECT g.job_id, cast(batch_no AS bigint) AS batch_no, cast(sum(c) OVER w AS bigint) AS completed_urls, cast(sum(s) OVER w AS bigint) AS successful_urls,
      round(least(100.0, sum(c) OVER w * 100.0 / total_urls), 6)::double AS progress_percentage
    FROM g JOIN job_totals t ON g.job_id = t.job_id WINDOW w AS (PARTITION BY g.job_id ORDER BY batch_no)""",
)
def job_batch_progress(events, totals):
    numbered = J.batches(events, 20, _seq_chunk(), order="seq")
    made = J.batch_progress(numbered, totals, F.floor(F.col("batch_no") / 4))
    return made.select(
        "job_id", "batch_no", "completed_urls", "successful_urls", F.round("progress_percentage", 6).alias("progress_percentage")
    )


@query(
    "job_results_join", "job_events job_totals",
    """SELECT t.job_id, t.total_urls, count(e.seq) AS results, max(e.seq) AS last_seq FROM job_totals t LEFT JOIN job_events e ON t.job_id = e.job_id
      GROUP BY t.job_id, t.total_urls""",
)
def job_results_join(events, totals):
    done = events.groupBy("job_id").agg(F.count("seq").alias("results"), F.max("seq").alias("last_seq"))
    return totals.join(done, "job_id", "left").select(
        "job_id", "total_urls", F.coalesce("results", F.lit(0)).alias("results"), "last_seq"
    )


@query(
    "batch_summary", "job_events",
    """SELECT count(*) AS total_urls, count(*) FILTER (WHERE success) AS successful_count, count(*) FILTER (WHERE NOT success) AS failed_count,
      round(sum(value), 3)::double AS processing_time FROM job_events""",
)
def batch_summary_query(events):
    made = batch_summary(events.withColumn("processing_time", F.col("value")))
    return made.withColumn("processing_time", F.round("processing_time", 3))


# Requests per domain; every third domain has its own delay.
derived(
    "paced_requests",
    """
    SELECT event_id AS id, CASE WHEN user_id = 0 THEN '' ELSE concat('d', cast(user_id AS varchar(19))) END AS domain, ts AS arrival FROM {events}
    """,
    "events",
)
derived(
    "delay_overrides",
    """
    SELECT concat('D', cast(user_id AS varchar(19))) AS domain, cast(CASE WHEN user_id % 6 = 0 THEN 0 ELSE 7200 END AS double) AS delay
    FROM {events} WHERE user_id % 3 = 0 GROUP BY user_id
    """,
    "events",
)
_DELAY = """
    delayed AS (SELECT r.*, CASE WHEN o.delay > 0 THEN o.delay ELSE 21600.0 END AS delay FROM paced_requests r
      LEFT JOIN delay_overrides o ON lower(o.domain) = r.domain)
"""
_SCHEDULE = f"""{_DELAY},
    ordered AS (SELECT *, epoch_us(arrival) AS a, cast(delay * 1000000 AS bigint) AS d,
      row_number() OVER (PARTITION BY domain ORDER BY arrival, id) - 1 AS i FROM delayed),
    planned AS (SELECT *, CASE WHEN domain = '' THEN a ELSE i * d + max(a - i * d) OVER (PARTITION BY domain ORDER BY i) END AS s FROM ordered)
"""


@query("domain_delays", "paced_requests delay_overrides", f"WITH {_DELAY} SELECT id, domain, delay FROM delayed")
def domain_delays(requests, overrides):
    return P.effective_delays(requests, overrides, default=21600.0).select("id", "domain", "delay")


def _schedule(requests, overrides):
    return P.schedule(P.effective_delays(requests, overrides, default=21600.0))


@query(
    "rate_schedule", "paced_requests delay_overrides",
    f"WITH {_SCHEDULE} SELECT id, domain, strftime(make_timestamp(s::bigint), '%Y-%m-%d %H:%M:%S.%f') AS start, round((s - a) / 1000000.0, 6)::double AS wait_seconds FROM planned",
)
def rate_schedule(requests, overrides):
    return _schedule(requests, overrides).select("id", "domain", _when("start"), F.round("wait_seconds", 6).alias("wait_seconds"))


derived(
    "loose_requests",
    """
    SELECT event_id AS id, CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('d', cast(user_id AS varchar(19))) END AS domain,
      CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS arrival, cast(3600 AS double) AS delay FROM {events}
    """,
    "events",
)


@query(
    "rate_schedule_nulls", "loose_requests",
    """WITH o AS (SELECT *, epoch_us(arrival) AS a, row_number() OVER (PARTITION BY domain, arrival IS NULL ORDER BY arrival, id) - 1 AS i FROM loose_requests),
    p AS (SELECT *, CASE WHEN arrival IS NULL OR domain IS NULL OR domain = '' THEN a
      ELSE i * 3600000000 + max(a - i * 3600000000) OVER (PARTITION BY domain, arrival IS NULL ORDER BY i) END AS s FROM o)
    SELECT id, domain, strftime(make_timestamp(s::bigint), '%Y-%m-%d %H:%M:%S.%f') AS start, round((s - a) / 1000000.0, 6)::double AS wait_seconds FROM p""",
)
def rate_schedule_nulls(requests):
    """Requests without a domain or an arrival keep their row and are not paced."""
    return P.schedule(requests).select("id", "domain", _when("start"), F.round("wait_seconds", 6).alias("wait_seconds"))


derived(
    "burst_requests",
    """
    SELECT event_id AS id, CASE WHEN user_id % 3 = 0 THEN 'hot' ELSE concat('d', cast(user_id AS varchar(19))) END AS domain,
      cast('2024-01-01 00:00:00' AS timestamp) AS arrival, cast(0.5 AS double) AS delay FROM {events}
    """,
    "events",
)


@query(
    "rate_schedule_burst", "burst_requests",
    """SELECT id, domain, (row_number() OVER (PARTITION BY domain ORDER BY id) - 1) * 0.5::double AS wait_seconds FROM burst_requests""",
)
def rate_schedule_burst(requests):
    """One arrival time for all requests, a third of them of one domain."""
    return P.schedule(requests).select("id", "domain", "wait_seconds")


@query(
    "domain_statistics", "paced_requests delay_overrides",
    f"""WITH {_SCHEDULE} SELECT domain, max(delay) AS delay, strftime(make_timestamp(max(s)::bigint), '%Y-%m-%d %H:%M:%S.%f') AS last_request,
      round((epoch_us(timestamp '2024-02-01') - max(s)) / 1000000.0, 6)::double AS time_since_last,
      (epoch_us(timestamp '2024-02-01') - max(s)) / 1000000.0 >= max(delay) AS ready_to_request FROM planned WHERE domain <> '' GROUP BY domain""",
)
def domain_stats(requests, overrides):
    made = P.domain_statistics(_schedule(requests, overrides), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return made.select("domain", "delay", _when("last_request"), F.round("time_since_last", 6).alias("time_since_last"), "ready_to_request")
