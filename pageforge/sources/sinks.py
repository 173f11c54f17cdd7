"""Typed content tables: header columns, raw envelope, first-write-wins append."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from pageforge.operators.keys import accepted_ids, only, settle
from pageforge.operators.quality import split_by_constraints
from pageforge.plans.content import type_of

HEADER = "id string, created_at timestamp_ntz, updated_at timestamp_ntz, url string, content_type string, raw_data string, meta_data string"


def raw_envelope(html: Column, store_raw: Column, metadata: Column) -> Column:
    """Raw data kept next to a row: html only when asked for, and the extraction metadata."""
    return F.to_json(F.struct(F.when(store_raw, html).alias("html"), metadata.alias("extraction_metadata")))


def meta_envelope(**parts: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()]))


def stored_rows(results: DataFrame, content_type: str, as_of: Column) -> DataFrame:
    """Rows to insert for the successful results of one type.

    ``results`` come from plans.ingest: the typed record sits in ``data``.
    """
    spec = type_of(content_type)
    wanted = results.where(F.col("success") & F.col("store_in_db"))
    return wanted.select(
        F.col("content_id").alias("id"),
        "request_id",
        as_of.cast("timestamp_ntz").alias("created_at"),
        as_of.cast("timestamp_ntz").alias("updated_at"),
        "url",
        F.lit(content_type).alias("content_type"),
        "raw_data",
        "meta_data",
        *[F.col(f"data.{c}").alias(c) for c in spec.columns],
    )


def table_path(root: str, content_type: str) -> str:
    return f"{root.rstrip('/')}/{type_of(content_type).table}"


def read_table(spark: SparkSession, root: str, content_type: str) -> DataFrame | None:
    """Stored rows of a type, or None before the first insert."""
    try:
        return spark.read.parquet(table_path(root, content_type))
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def insert(rows: DataFrame, root: str, content_type: str, order: str = "request_id", part: str | None = None) -> DataFrame:
    """Append rows to their table under its constraints; returns the rejected rows with their ``violations``.

    Rows that break a column constraint are rejected. Of rows that share a unique
    key the first stays, whether it is in this batch or already stored, and the
    others are rejected. Every write goes to a folder ``part=...`` of the table, so
    all writes share one layout: with ``part`` (for instance a stream batch id) the
    folder of that name is overwritten and a repeated batch is stored once, without
    it the folder gets a new name.
    """
    spec = type_of(content_type)
    good, bad = split_by_constraints(settle(rows), spec)
    stored = read_table(rows.sparkSession, root, content_type)
    if stored is not None and part is not None:
        stored = stored.where(F.col("part").cast("string") != part)
    winners = settle(accepted_ids(good, spec.unique, order, stored))
    accepted = only(good, winners, order).drop(order)
    folder = f"write-{uuid.uuid4().hex}" if part is None else part
    accepted.write.mode("overwrite").parquet(f"{table_path(root, content_type)}/part={folder}")
    taken = F.array(F.lit("unique key already stored: " + ", ".join(spec.unique)))
    return bad.unionByName(good.join(winners, order, "left_anti").withColumn("violations", taken))


def with_storage(outcomes: DataFrame, rejected: DataFrame, order: str = "request_id") -> DataFrame:
    """Outcomes after the insert: a rejected row has no content id and says why, and its request stays a success."""
    why = rejected.select(order, F.concat(F.lit("Failed to store content in database: "), F.array_join("violations", ", ")).alias("_why"))
    joined, lost = outcomes.join(why, order, "left"), F.col("_why").isNotNull()
    return joined.withColumns(
        {
            "errors": F.when(lost, F.concat("errors", F.array("_why"))).otherwise(F.col("errors")),
            "content_id": F.when(~lost, F.col("content_id")),
        }
    ).drop("_why")


def write_clustered(rows: DataFrame, path: str, key: str, *also: str, distinct: int = 100_000, block_bytes: int | None = None) -> None:
    """Write a table for look-ups by ``key``.

    Rows are ranged and sorted by the key, so the statistics of files and row
    groups leave few of them for an id. Other look-up columns, ``also``, lie
    anywhere; they get Parquet Bloom filters for up to ``distinct`` values per row
    group, and so does the key. ``block_bytes`` bounds a row group. The key should
    be nearly unique, as ids are: rows of one value land in one task.
    """
    writer = rows.repartitionByRange(key).sortWithinPartitions(key).write
    for name in (key, *also):
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true").option(f"parquet.bloom.filter.expected.ndv#{name}", str(distinct))
    if block_bytes is not None:
        writer = writer.option("parquet.block.size", str(block_bytes))
    writer.parquet(path)


def write_content(rows: DataFrame, path: str) -> None:
    """One dataset for mixed types, partitioned so that a type reads its own folder."""
    rows.write.mode("append").partitionBy("content_type").parquet(path)
