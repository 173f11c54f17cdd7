"""Streaming jobs, run to completion over the stored tables.

Every stream writes files (never the in-memory sink, which gathers on the
driver) under the shared folder and the written table is the result.
"""

import uuid

from pyspark.sql import functions as F

from pageforge.operators.keys import shared_folder
from pageforge.queries.base import QUERIES, _CHECKS, table
from pageforge.queries.content import DOMAIN, MEASURES, PAGE_FIELDS
from pageforge.queries.jobs import _sql_when, _when
from pageforge.sources.sinks import read_table
from pageforge.streaming import jobs as S

EPOCH = "2024-03-01 00:00:00"


def stream_query(name: str, tables: str = "", sql: str | None = None):
    names = tuple(tables.split())

    def add(fn):
        def run(spark, sf_dir):
            root = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
            return fn(spark, sf_dir, root)

        QUERIES[name] = run
        if sql is not None:
            _CHECKS[name] = (sql, names)
        return fn

    return add


def opened(spark, sf_dir: str, name: str):
    """A stored table, one file or a folder of files, as a stream of files.

    The bracket makes the path a pattern: a plain path is taken for a folder, and a file is refused.
    """
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def drained(writer) -> None:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def written(stream, root: str):
    drained(
        stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
    )
    return stream.sparkSession.read.parquet(f"{root}/out")


@stream_query(
    "stream_articles", "pages",
    f"WITH {PAGE_FIELDS} SELECT page_id, title, {MEASURES}, {DOMAIN} AS source_domain FROM page_fields",
)
def stream_articles(spark, sf_dir, root):
    made = written(S.content_stream(opened(spark, sf_dir, "pages"), "article", ("page_id",)), root)
    return made.select(
        "page_id", "title", F.col("word_count").cast("bigint").alias("word_count"),
        F.col("reading_time").cast("bigint").alias("reading_time"), "source_domain",
    )


@stream_query("stream_ingest", "pages", f"WITH {PAGE_FIELDS} SELECT url, title, 'article' AS content_type FROM page_fields")
def stream_ingest(spark, sf_dir, root):
    pages = opened(spark, sf_dir, "pages")
    drained(S.ingest_stream(pages, "article", f"{root}/tables", f"{root}/checkpoint", F.lit(EPOCH)))
    return read_table(spark, f"{root}/tables", "article").select("url", "title", "content_type")


_EARLY = "SELECT concat('https://u.org/', user_id) AS norm_url, min(ts) AS first FROM events GROUP BY user_id"


@stream_query("stream_first_urls", "", f"SELECT norm_url, {_sql_when('first')} FROM ({_EARLY})")
def stream_first_urls(spark, sf_dir, root):
    """The table arrives in three parts by time, and the stream is started anew for each."""
    events = table(spark, sf_dir, "events").select(F.format_string("HTTPS://u.org/%d#%d", "user_id", "event_id").alias("url"), F.col("ts").cast("timestamp").alias("ts"))
    cuts = events.agg(F.percentile_approx("ts", [1 / 3, 2 / 3]).alias("c")).first()["c"] or [None, None]
    late, later = (F.coalesce(F.col("ts") > F.lit(c), F.lit(False)) for c in cuts)
    stream = spark.readStream.schema(events.schema).parquet(f"{root}/in/*")
    for i, part in enumerate((~late, late & ~later, later)):
        events.where(part).write.parquet(f"{root}/in/{i}")
        drained(S.first_urls(stream, "ts", f"{root}/out", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/out").select("norm_url", F.col("ts").alias("first")).select("norm_url", _when("first"))


@stream_query(
    "stream_ingest_rejects", "pages",
    """SELECT page_id AS request_id, page_id % 4 = 0 AS success, CASE page_id % 4 WHEN 1 THEN concat('Invalid URL: ftp://x.org/', page_id)
      WHEN 2 THEN concat('Crawl failed for ', url, ': no landed page') WHEN 3 THEN
      'Content validation failed: Required field ''title'' is missing or empty, Required field ''content'' is missing or empty' ELSE '' END AS errors
      FROM pages""",
)
def stream_ingest_rejects(spark, sf_dir, root):
    kind = F.col("page_id") % 4
    pages = opened(spark, sf_dir, "pages").select(
        "page_id",
        F.when(kind == 1, F.concat(F.lit("ftp://x.org/"), F.col("page_id").cast("string"))).otherwise(F.col("url")).alias("url"),
        F.when(kind == 2, "").when(kind == 3, "<p></p>").otherwise("<h1>t</h1><article>c</article>").alias("html"),
    )
    drained(S.ingest_stream(pages, "article", f"{root}/tables", f"{root}/checkpoint", F.lit(EPOCH)))
    results = spark.read.parquet(f"{root}/tables/results")
    return results.select("request_id", "success", F.array_join("errors", "|").alias("errors"))


@stream_query(
    "ingest_store_refused", "pages",
    """SELECT 2 * page_id + k AS request_id, true AS success, k = 0 AS stored,
      CASE k WHEN 1 THEN 'Failed to store content in database: unique key already stored: url' ELSE '' END AS errors FROM pages, (VALUES (0), (1)) AS t(k)""",
)
def ingest_store_refused(spark, sf_dir, root):
    """Every page is asked for twice: the second request finds the first one's row in the table."""
    twice = opened(spark, sf_dir, "pages").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "*")
    pages = twice.select((2 * F.col("page_id") + F.col("k")).alias("page_id"), "url", F.lit("<h1>t</h1><article>c</article>").alias("html"))
    drained(S.ingest_stream(pages, "article", f"{root}/tables", f"{root}/checkpoint", F.lit(EPOCH)))
    results = spark.read.parquet(f"{root}/tables/results")
    return results.select("request_id", "success", F.col("content_id").isNotNull().alias("stored"), F.array_join("errors", "|").alias("errors"))


def _outcomes(spark, sf_dir):
    return opened(spark, sf_dir, "events").select(
        F.format_string("job-%d", "user_id").alias("job_id"), "event_id", "ts", (F.col("event_type") != "error").alias("success")
    )


@stream_query(
    "stream_job_progress", "job_events",
    """SELECT job_id, count(*) AS completed_urls, count(*) FILTER (WHERE success) AS successful_urls, count(*) FILTER (WHERE NOT success) AS failed_urls
      FROM job_events GROUP BY job_id""",
)
def stream_job_progress(spark, sf_dir, root):
    drained(S.updates(S.live_progress(_outcomes(spark, sf_dir)), f"{root}/out", f"{root}/checkpoint"))
    return S.newest_counts(spark.read.parquet(f"{root}/out"), "job_id")


_PACED = f"""WITH ordered AS (SELECT event_id AS id, user_id AS domain, epoch_us(ts) AS a,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
    planned AS (SELECT *, i * 21600000000 + max(a - i * 21600000000) OVER (PARTITION BY domain ORDER BY i) AS s FROM ordered)
    SELECT id, domain, strftime(make_timestamp(s::bigint), '%Y-%m-%d %H:%M:%S.%f') AS start, round((s - a) / 1000000.0, 6)::double AS wait_seconds FROM planned"""


def _paced(spark, sf_dir):
    return opened(spark, sf_dir, "events").select(
        F.col("user_id").alias("domain"), F.col("event_id").alias("id"), F.col("ts").alias("arrival")
    )


@stream_query("stream_pacing", "", _PACED)
@stream_query("stream_pacing_batches", "", _PACED)
def stream_pacing_batches(spark, sf_dir, root):
    drained(S.pace_batches(_paced(spark, sf_dir), f"{root}/paced", f"{root}/checkpoint", 21600.0))
    made = spark.read.parquet(f"{root}/paced/starts")
    return made.select("id", "domain", _when("start"), F.round("wait_seconds", 6).alias("wait_seconds"))


@stream_query(
    "stream_robots", "robots_requests",
    """SELECT page_id, regexp_matches(url, '//(m|blog|www)[.]') OR NOT starts_with(regexp_extract(url, '^[a-z]+://[^/?#]*(.*)', 1), '/en/') AS allowed
      FROM robots_requests""",
)
def stream_robots(spark, sf_dir, root):
    pages = opened(spark, sf_dir, "pages").select("page_id", "url", F.lit("2024-01-01 12:00:00").cast("timestamp").alias("requested_at"))
    snapshots = lambda: table(spark, sf_dir, "robots_snapshots")
    drained(S.robots_stream(pages, snapshots, f"{root}/out", f"{root}/checkpoint", "page_id", "TestBot/2.1"))
    return spark.read.parquet(f"{root}/out").select("page_id", "allowed")


@stream_query(
    "stream_hourly_statistics", "job_events",
    f"""SELECT {_sql_when('window_start')}, total, successful, failed FROM (
      SELECT date_trunc('hour', ts) AS window_start, count(*) AS total, count(*) FILTER (WHERE success) AS successful,
        count(*) FILTER (WHERE NOT success) AS failed FROM job_events GROUP BY 1)""",
)
def stream_hourly_statistics(spark, sf_dir, root):
    drained(S.updates(S.windowed_statistics(_outcomes(spark, sf_dir)), f"{root}/out", f"{root}/checkpoint"))
    made = S.newest_counts(spark.read.parquet(f"{root}/out"), "window_start")
    return made.select(_when("window_start"), "total", "successful", "failed")
