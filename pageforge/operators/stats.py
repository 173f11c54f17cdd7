"""Ingest and content statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageforge import catalog


def ingest_statistics(results: DataFrame) -> DataFrame:
    """One row: totals, success rate, mean time.

    ``failed_requests`` counts fetch failures (``fetch_failed``) only; rejected
    URLs and failed validations are requests that were neither.
    """
    counted = results.agg(
        F.count("*").alias("total_requests"),
        F.count_if("success").alias("successful_requests"),
        F.count_if("fetch_failed").alias("failed_requests"),
        F.coalesce(F.sum("processing_time"), F.lit(0.0)).alias("total_processing_time"),
    )
    total = F.col("total_requests")
    return counted.withColumns(
        {
            "success_rate": F.coalesce(F.try_divide(F.col("successful_requests"), total), F.lit(0.0)),
            "avg_processing_time": F.coalesce(F.try_divide(F.col("total_processing_time"), total), F.lit(0.0)),
        }
    )


def types_processed(results: DataFrame) -> DataFrame:
    return results.where("processed").groupBy("content_type").agg(F.count("*").alias("n"))


def batch_summary(results: DataFrame, batch: list[str] | None = None) -> DataFrame:
    """Total, successful, failed and summed time, overall or per batch key."""
    return results.groupBy(*(batch or [])).agg(
        F.count("*").alias("total_urls"),
        F.count_if("success").alias("successful_count"),
        (F.count("*") - F.count_if("success")).alias("failed_count"),
        F.coalesce(F.sum("processing_time"), F.lit(0.0)).alias("processing_time"),
    )


def content_counts(content: DataFrame) -> DataFrame:
    """Items per content type, absent types included, and the total as type ``all``."""
    counted = content.groupBy("content_type").agg(F.count("*").alias("n"))
    types = catalog.catalog_frame(content.sparkSession).select("content_type")
    full = types.join(counted, "content_type", "left").select("content_type", F.coalesce("n", F.lit(0)).alias("n"))
    return full.unionByName(full.agg(F.sum("n").alias("n")).select(F.lit("all").alias("content_type"), "n"))


def error_breakdown(results: DataFrame) -> DataFrame:
    """Errors by message class: the text before the first colon."""
    one = results.select(F.explode("errors").alias("message"))
    return one.groupBy(F.substring_index("message", ":", 1).alias("error_class")).agg(F.count("*").alias("n"))
