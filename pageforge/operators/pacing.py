"""Rate limits per domain as tables: delays, schedules, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageforge.operators.keys import settle

DEFAULT_DELAY = 1.0
_MICROS = 1_000_000


def effective_delays(domains: DataFrame, overrides: DataFrame, domain: str = "domain", default: float = DEFAULT_DELAY) -> DataFrame:
    """Add ``delay`` in seconds: a positive override replaces the default.

    The overrides are not hinted; adaptive execution broadcasts them only when
    their measured size is small.
    """
    found = overrides.select(F.lower(domain).alias(domain), F.col("delay").alias("_override"))
    joined = domains.join(found, domain, "left")
    chosen = F.coalesce(F.when(F.col("_override") > 0, F.col("_override")), F.lit(default))
    return joined.withColumn("delay", chosen.cast("double")).drop("_override")


def schedule(
    requests: DataFrame, domain: str = "domain", arrival: str = "arrival", order: str = "id",
    delay: str = "delay", last_starts: DataFrame | None = None,
) -> DataFrame:
    """Add ``start`` and ``wait_seconds``: each request starts at its arrival, but not
    earlier than ``delay`` after the previous start of its domain.

    start_i = i*d + max over j<=i of (arrival_j - j*d). Requests are cut into ranges of
    (domain, arrival, order) of about equal size, so that a domain with many requests,
    even all at one time, is spread over tasks; the maximum is taken inside the ranges
    and then over them. Microsecond integers keep it exact. The delay is one value per
    domain. Requests with an empty or null domain are not paced and start at their
    arrival; those without an arrival get no start. Neither enters a window.
    ``last_starts`` (domain, last_start in microseconds) continues an earlier schedule.
    """
    micros = F.unix_micros(F.col(arrival).cast("timestamp"))
    paced = F.coalesce(F.col(domain).cast("string"), F.lit("")) != ""
    rows = requests.withColumns({"_at": micros, "_step": F.round(F.col(delay) * _MICROS).cast("bigint")})
    free = rows.where(~paced | F.col("_at").isNull()).withColumn("_start", F.col("_at"))
    held = rows.where(paced & F.col("_at").isNotNull()).repartitionByRange(domain, "_at", order)
    # Written once: the ranges must be the same for every reader.
    placed = settle(held.withColumn("_chunk", F.spark_partition_id()))
    local = Window.partitionBy(domain, "_chunk").orderBy("_at", order)
    counted = placed.withColumn("_i", (F.row_number().over(local) - 1).cast("bigint"))
    slack = F.col("_at") - F.col("_i") * F.col("_step")
    inside = counted.withColumn("_peak", F.max(slack).over(local.rowsBetween(Window.unboundedPreceding, 0)))
    narrow = placed.select(domain, "_chunk", "_at", order, "_step").withColumn(
        "_i", (F.row_number().over(local) - 1).cast("bigint")
    )
    chunks = narrow.groupBy(domain, "_chunk").agg(
        F.count("*").alias("_n"), F.max(slack).alias("_top"), F.max("_step").alias("_d")
    )
    earlier = Window.partitionBy(domain).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).withColumn(
        "_prior", F.max(F.col("_top") - F.col("_offset") * F.col("_d")).over(earlier)
    ).select(domain, "_chunk", "_offset", "_prior", "_d")
    if last_starts is not None:
        offsets = offsets.join(last_starts.select(domain, "last_start"), domain, "left").withColumn(
            "_prior", F.greatest("_prior", F.col("last_start") + F.col("_d"))
        )
    offsets = offsets.select(domain, "_chunk", "_offset", "_prior")
    joined = inside.join(offsets, [domain, "_chunk"])
    base = F.greatest(F.col("_prior"), F.col("_peak") - F.col("_offset") * F.col("_step"))
    timed = joined.withColumn("_start", base + (F.col("_offset") + F.col("_i")) * F.col("_step"))
    kept = [*requests.columns, "_at", "_start"]
    return timed.select(*kept).unionByName(free.select(*kept)).withColumns(
        {
            "start": F.timestamp_micros("_start").cast(requests.schema[arrival].dataType),
            "wait_seconds": (F.col("_start") - F.col("_at")) / F.lit(float(_MICROS)),
        }
    ).select(*requests.columns, "start", "wait_seconds")


def domain_statistics(requests: DataFrame, as_of: Column, domain: str = "domain", at: str = "start", delay: str = "delay") -> DataFrame:
    """Per domain: delay, last request, seconds since, ready flag."""
    last = requests.where(F.col(domain).cast("string") != "").groupBy(domain).agg(
        F.max(delay).alias("delay"), F.max(at).alias("last_request")
    )
    since = (
        F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_request").cast("timestamp"))
    ) / F.lit(float(_MICROS))
    return last.withColumn("time_since_last", since).withColumn(
        "ready_to_request", F.col("time_since_last") >= F.col("delay")
    )
