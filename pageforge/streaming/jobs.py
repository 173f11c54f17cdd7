"""Structured Streaming forms of the long-running jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pageforge.functions.urls import normalize_url
from pageforge.operators.extract import extract_fields
from pageforge.operators.keys import settle
from pageforge.operators.pacing import schedule
from pageforge.operators.robots import CACHE_SECONDS, check_robots
from pageforge.plans.content import process, type_of
from pageforge.plans.ingest import ingest, outcomes
from pageforge.sources.sinks import insert, stored_rows, with_storage

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def content_stream(pages: DataFrame, content_type: str, keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Stateless: landed pages to typed records, the same plan as in batch."""
    fields = extract_fields(pages, dict(type_of(content_type).selectors))
    return process(fields, content_type, keep)


def ingest_stream(pages: DataFrame, content_type: str, root: str, checkpoint: str, as_of: Column) -> DataStreamWriter:
    """Continuous ingest into the typed table of ``root``.

    Each micro-batch goes to its own folder by batch id, so a batch that is run
    again after a failure replaces itself instead of appearing twice. Nothing is
    dropped unseen: ``results/part=N`` holds one outcome per request, refused and
    failed ones with their reasons, and ``rejects/part=N`` the rows that break a
    constraint of the table, a unique key among them; their outcome says so.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        requests = batch.withColumnRenamed("page_id", "request_id")
        results = settle(ingest(requests, content_type))
        rejected = insert(stored_rows(results, content_type, as_of), root, content_type, part=str(batch_id))
        rejected.write.mode("overwrite").parquet(f"{root}/rejects/part={batch_id}")
        rejected = batch.sparkSession.read.schema(rejected.schema).parquet(f"{root}/rejects/part={batch_id}")
        with_storage(outcomes(results), rejected).write.mode("overwrite").parquet(f"{root}/results/part={batch_id}")

    return pages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def first_urls(stream: DataFrame, at: str, root: str, checkpoint: str, url: str = "url") -> DataStreamWriter:
    """First row per normal form of the URL, written to ``root/part=N`` per micro-batch.

    A batch adds its earliest row of each URL that no batch before it has seen,
    however long ago; there is no watermark behind which rows get lost. The first
    rows are keyed state (RocksDB, with changelogs): a batch reads the state of its
    own URLs, never the rows stored so far, and partial minima are combined before
    the shuffle, so a frequent URL is one state row. A row's rank starts with the
    trigger time of its batch, which Spark logs with the batch and repeats after a
    failure; it must not go back between batches. Rows without a URL are one key.

    The state provider is a setting of the session when the stream starts.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withColumn("norm_url", normalize_url(F.col(url)))
    now = F.current_timestamp()
    row = F.struct(*timed.columns).alias("row")
    ranked = timed.select("norm_url", row, F.struct(now.alias("batch"), F.col(at).alias("at"), F.col(url).alias("url")).alias("rank"))
    first = ranked.groupBy("norm_url").agg(F.min_by(F.struct("rank", "row"), "rank").alias("r"))
    found = first.where(F.col("r.rank.batch") == now).select("r.row.*")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/part={batch_id}")

    return found.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)


def live_progress(events: DataFrame) -> DataFrame:
    """Running counts per job; write in update mode."""
    return events.groupBy("job_id").agg(
        F.count("*").alias("completed_urls"),
        F.count_if("success").alias("successful_urls"),
        F.count_if(~F.col("success")).alias("failed_urls"),
    )


def windowed_statistics(events: DataFrame, at: str = "ts", width: str = "1 hour") -> DataFrame:
    """Event counts per time window; write in update mode.

    State is one row per window, few enough to keep all: late rows count in their
    window whenever they come, and the newest window is there from its first row.
    """
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    return timed.groupBy(F.window(at, width).alias("w")).agg(
        F.count("*").alias("total"), F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
    ).select(F.col("w.start").alias("window_start"), "total", "successful", "failed")


def updates(counts: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """Changed rows of running counts, one folder ``root/part=N`` per micro-batch; the last row of a key counts."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/part={batch_id}")

    return counts.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)


def newest_counts(stored: DataFrame, *keys: str) -> DataFrame:
    """Current state of what :func:`updates` has written."""
    counts = [c for c in stored.columns if c not in (*keys, "part")]
    return stored.groupBy(*keys).agg(*[F.max_by(c, "part").alias(c) for c in counts])


def pace_batches(requests: DataFrame, root: str, checkpoint: str, delay_seconds: float, domain: str = "domain",
                 arrival: str = "arrival", order: str = "id") -> DataStreamWriter:
    """Pacing of a request stream: start times that keep ``delay_seconds`` between requests of a domain.

    Every micro-batch is scheduled with the batch operator, which
    spreads a domain over tasks, and continues from the last starts that the
    batch before it wrote under ``root``. Folders are named by batch id and
    overwritten, so a repeated batch changes nothing.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = None
        if batch_id > 0:
            known = spark.read.parquet(f"{root}/last/batch={batch_id - 1}")
        timed = schedule(batch.withColumn("delay", F.lit(delay_seconds)), domain, arrival, order, last_starts=known)
        timed.write.mode("overwrite").parquet(f"{root}/starts/batch={batch_id}")
        paced = spark.read.parquet(f"{root}/starts/batch={batch_id}").where(F.coalesce(F.col(domain).cast("string"), F.lit("")) != "")
        mine = paced.groupBy(domain).agg(
            F.unix_micros(F.max("start").cast("timestamp")).alias("last_start")
        )
        if known is not None:
            mine = mine.unionByName(known).groupBy(domain).agg(F.max("last_start").alias("last_start"))
        mine.write.mode("overwrite").parquet(f"{root}/last/batch={batch_id}")

    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def robots_stream(
    requests: DataFrame, read_snapshots: Callable[[], DataFrame], root: str, checkpoint: str, request_id: str, user_agent: str = "*",
    url: str = "url", at: str = "requested_at", cache_seconds: int = CACHE_SECONDS,
) -> DataStreamWriter:
    """Robots check of a request stream, written to ``root/part=N`` per micro-batch.

    Every micro-batch runs the batch operator on the snapshot table as it is then
    (``read_snapshots`` opens it), so a request meets the newest snapshot that was
    live when it was made, and comes out once.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        checked = check_robots(batch, read_snapshots(), request_id, user_agent, url, at, cache_seconds)
        checked.write.mode("overwrite").parquet(f"{root}/part={batch_id}")

    return requests.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
