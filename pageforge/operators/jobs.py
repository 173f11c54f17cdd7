"""Job tracking over append-only tables.

``events``: one row per processed URL (job_id, seq, url, success, errors, ts).
``states``: one row per status change (job_id, seq, status, ts, ...).
Every figure is an aggregate of those tables; nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageforge import catalog
from pageforge.operators.running import join_null_safe, with_rank, with_running_sums
from pageforge.operators.search import page_of

ACTIVE = ("pending", "running")
MAX_BATCH = 10
# Values of ``seq`` per chunk of a job's status changes.
STATE_CHUNK = 50_000


def standing_cancels(states: DataFrame) -> DataFrame:
    """(job_id, _cancel, _cancelled_at): the first cancellation of each job that met it active.

    A cancellation counts when the latest other change before it left the job
    active, or there is none. A job's changes are read in chunks of their whole
    number ``seq``, and only the last change of each chunk goes on to the next, so a
    job with any number of changes is spread over many tasks.
    """
    status, seq = F.col("status"), F.col("seq")
    other = F.when(status != "cancelled", status)
    rows = states.select("job_id", "seq", "status", "ts", F.floor(seq / STATE_CHUNK).alias("_chunk"))
    inside = Window.partitionBy("job_id", "_chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    cancels = rows.withColumn("_before", F.last(other, ignorenulls=True).over(inside)).where("status = 'cancelled'")
    lasts = rows.groupBy("job_id", "_chunk").agg(F.max_by(other, F.when(other.isNotNull(), seq)).alias("_last"))
    earlier = Window.partitionBy("job_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("job_id", "_chunk", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    met = F.coalesce("_before", "_carried")
    counted = join_null_safe(cancels, carried, ["job_id", "_chunk"]).where(met.isNull() | met.isin(*ACTIVE))
    return counted.groupBy("job_id").agg(F.min("seq").alias("_cancel"), F.min_by("ts", "seq").alias("_cancelled_at"))


def latest_states(states: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Current status per job, when it was created and, if it is finished, when it finished.

    A cancellation counts when it meets the job active, and is then final: what
    is reported later comes from work that was under way. A cancellation of a
    finished job does nothing. Otherwise the last other change counts; a job may
    run again after its end and then has no completion time.
    """
    status, seq, ts = F.col("status"), F.col("seq"), F.col("ts")
    other = status != "cancelled"
    found = states.groupBy("job_id").agg(
        F.min("ts").alias("created_at"),
        F.max_by(status, F.when(other, seq)).alias("_last"),
        F.max_by(ts, F.when(other, seq)).alias("_last_at"),
        *[F.max_by(c, "seq").alias(c) for c in carry],
    )
    stopped = standing_cancels(states).withColumnRenamed("job_id", "_job")
    joined = found.join(stopped, F.col("job_id").eqNullSafe(F.col("_job")), "left")
    stands, over = F.col("_cancel").isNotNull(), ~F.col("_last").isin(*ACTIVE)
    return joined.select(
        "job_id",
        F.when(stands, "cancelled").otherwise(F.col("_last")).alias("status"),
        "created_at",
        F.when(stands, F.col("_cancelled_at")).when(over, F.col("_last_at")).alias("completed_at"),
        *carry,
    )


def percent(done: Column, total: Column) -> Column:
    ratio = F.try_divide(done * F.lit(100.0), total)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(ratio, F.lit(0.0))))


def progress(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """Completed, successful and failed URLs per job and percent of its total.

    ``jobs`` holds ``job_id, total_urls`` and any further columns to keep.
    """
    done = events.groupBy("job_id").agg(
        F.count("*").alias("completed_urls"),
        F.count_if("success").alias("successful_urls"),
        F.count_if(~F.col("success")).alias("failed_urls"),
    )
    counts = ("completed_urls", "successful_urls", "failed_urls")
    joined = jobs.join(done, "job_id", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})
    return joined.withColumn("progress_percentage", percent(F.col("completed_urls"), F.col("total_urls")))


def with_eta(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Add the remaining seconds of running jobs: remaining / (completed / elapsed)."""
    elapsed = (
        F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    ) / F.lit(1e6)
    rate = F.try_divide(F.col("completed_urls").cast("double"), elapsed)
    left = F.try_divide((F.col("total_urls") - F.col("completed_urls")).cast("double"), F.when(rate > 0, rate))
    running = (F.col("status") == "running") & (F.col("completed_urls") > 0)
    return jobs.withColumn("estimated_remaining_time", F.when(running, left))


def error_list(events: DataFrame, chunk: Column) -> DataFrame:
    """Error messages of failed URLs as rows ``(job_id, error_no, message)`` in order.

    Kept as rows: a job's errors are unbounded and are never gathered into one
    value. ``chunk`` cuts a job along ``seq`` (see operators.running).
    """
    failed = events.where(~F.col("success")).select("job_id", "seq", F.posexplode("errors").alias("_n", "message"))
    return with_rank(failed, ["job_id"], ["seq", "_n"], chunk, "error_no").select("job_id", "error_no", "message")


def statistics(jobs: DataFrame) -> DataFrame:
    """Totals over jobs by status, success rate and mean number of URLs of finished jobs."""
    active = F.col("status").isin(*ACTIVE)
    counted = jobs.agg(
        F.count("*").alias("total_jobs"),
        F.count_if(active).alias("active_jobs"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_jobs") for s in ("completed", "failed", "cancelled")],
        F.coalesce(F.sum(F.when(~active, F.col("total_urls"))), F.lit(0)).alias("_urls"),
    )
    finished = F.greatest(F.col("total_jobs") - F.col("active_jobs"), F.lit(1))
    return counted.withColumns(
        {
            "success_rate": F.col("completed_jobs") / finished * F.lit(100.0),
            "avg_urls_per_job": F.col("_urls") / finished,
        }
    ).drop("_urls")


def with_message(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn(
        "message", F.format_string("Job %s: %d/%d URLs processed", "status", "completed_urls", "total_urls")
    )


def status_record(active: DataFrame, history: DataFrame, stored: DataFrame, job_id: str) -> DataFrame:
    """Status of one job: from the active jobs, else the finished ones, else the stored rows.

    ``active`` and ``history`` come from :func:`progress`; ``stored`` has
    results_count and error_count, from which its figures derive.
    """
    wanted = F.col("job_id") == job_id
    columns = ["job_id", "status", "total_urls", "completed_urls", "successful_urls", "failed_urls", "progress_percentage"]
    results, failed = F.coalesce("results_count", F.lit(0)), F.coalesce("error_count", F.lit(0))
    old = stored.where(wanted).select(
        "job_id", F.coalesce("status", F.lit("unknown")).alias("status"), "total_urls",
        results.alias("completed_urls"), (results - failed).alias("successful_urls"), failed.alias("failed_urls"),
        F.when(F.col("status") == "completed", 100.0).otherwise(0.0).alias("progress_percentage"),
    )
    sources = [active.where(wanted), history.where(wanted), old]
    ranked = [s.select(*columns, F.lit(k).alias("_source")) for k, s in enumerate(sources)]
    found = ranked[0].unionByName(ranked[1]).unionByName(ranked[2])
    return with_message(found.orderBy("_source").limit(1).drop("_source"))


def all_jobs(active: DataFrame, finished: DataFrame) -> DataFrame:
    return active.unionByName(finished)


def with_status(jobs: DataFrame, status: str | None) -> DataFrame:
    return jobs if not status else jobs.where(F.col("status") == status)


def newest(jobs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of jobs, newest first."""
    return page_of(jobs.orderBy(F.col("created_at").desc(), "job_id"), limit, offset, catalog.MAX_JOBS_LIMIT)


def retained(jobs: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Drop finished jobs completed before the retention window."""
    cutoff = as_of - F.make_dt_interval(hours=F.lit(hours))
    return jobs.where(F.col("completed_at").isNull() | (F.col("completed_at") >= cutoff))


def batches(urls: DataFrame, concurrency: int, chunk: Column, order: str = "pos") -> DataFrame:
    """Number the batches of each job: groups of min(10, concurrency) URLs in order."""
    size = min(MAX_BATCH, concurrency)
    ranked = with_rank(urls, ["job_id"], [order], chunk, "_rank")
    return ranked.withColumn("batch_no", F.floor((F.col("_rank") - 1) / F.lit(size))).drop("_rank")


def batch_progress(events: DataFrame, jobs: DataFrame, chunk: Column) -> DataFrame:
    """Running progress after each batch. ``events`` carry ``batch_no``; ``chunk`` cuts along it."""
    per_batch = events.groupBy("job_id", "batch_no").agg(
        F.count("*").alias("completed_urls"), F.count_if("success").alias("successful_urls")
    )
    sums = with_running_sums(
        per_batch, ["job_id"], ["batch_no"], chunk,
        {"completed_urls": F.col("completed_urls"), "successful_urls": F.col("successful_urls")},
    )
    joined = sums.join(jobs.select("job_id", "total_urls"), "job_id")
    return joined.withColumn("progress_percentage", percent(F.col("completed_urls"), F.col("total_urls")))
