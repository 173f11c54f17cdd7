"""Streams over several micro-batches give what the batch operators give."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pageforge.operators import pacing
from pageforge.sources import readers, sinks
from pageforge.streaming import jobs as S

T0 = datetime(2024, 1, 1)


def micro_batches(spark, folder, frames, start=0):
    """A file stream that reads one frame per micro-batch, in order."""
    for k, frame in enumerate(frames, start):
        frame.coalesce(1).write.parquet(f"{folder}/part={k}")
    schema = frames[0].schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")


def drain(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def requests(spark):
    rng = random.Random(9)
    rows = sorted(
        ((i, rng.choice(["hot", "hot", "a", "b"]), T0 + timedelta(seconds=rng.randrange(4000))) for i in range(300)), key=lambda r: (r[2], r[0]))
    rows = [(n, d, t) for n, (_, d, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "id int, domain string, arrival timestamp")
    batch = pacing.schedule(df.withColumn("delay", F.lit(20.0)))
    want = {r.id: r.start for r in batch.collect()}
    return [df.where(f"id % 300 between {a} and {a + 99}") for a in (0, 100, 200)], want


def test_pacing_by_batches(spark, tmp_path):
    frames, want = requests(spark)
    stream = micro_batches(spark, tmp_path / "in", frames)
    drain(S.pace_batches(stream, str(tmp_path / "paced"), str(tmp_path / "c"), 20.0))
    assert {r.id: r.start for r in spark.read.parquet(str(tmp_path / "paced" / "starts")).collect()} == want


def test_ingest_stream_keeps_first(spark, tmp_path):
    def pages(rows):
        return spark.createDataFrame([(i, u, f"<h1>t{i}</h1><article>c</article>") for i, u in rows], readers.PAGE_SCHEMA)

    frames = [pages([(1, "https://a.org/1"), (2, "https://a.org/1")]), pages([(3, "https://a.org/1"), (4, "https://a.org/2")])]
    stream = micro_batches(spark, tmp_path / "in", frames)
    drain(S.ingest_stream(stream, "article", str(tmp_path / "tables"), str(tmp_path / "c"), F.lit("2024-01-01")))
    stored = sinks.read_table(spark, str(tmp_path / "tables"), "article")
    assert {(r.url, r.title) for r in stored.collect()} == {("https://a.org/1", "t1"), ("https://a.org/2", "t4")}


def test_ingest_stream_reports_what_it_does_not_store(spark, tmp_path):
    rows = [(1, "https://a.org/1", "<h1>t</h1><article>c</article>"), (2, "ftp://a.org/2", "<h1>t</h1>"), (3, "https://a.org/3", ""), (4, "https://a.org/4", "<p>x</p>")]
    rows.append((5, "https://a.org/5", "<h1>" + "t" * 600 + "</h1><article>c</article>"))
    stream = micro_batches(spark, tmp_path / "in", [spark.createDataFrame(rows, readers.PAGE_SCHEMA)])
    root = str(tmp_path / "tables")
    drain(S.ingest_stream(stream, "article", root, str(tmp_path / "c"), F.lit("2024-01-01")))
    results = {r.request_id: r.errors for r in spark.read.parquet(f"{root}/results").collect()}
    assert set(results) == {1, 2, 3, 4, 5} and not results[1] and all(results[k] for k in (2, 3, 4))
    assert [r.request_id for r in spark.read.parquet(f"{root}/rejects").collect()] == [5]
    assert [r.url for r in sinks.read_table(spark, root, "article").collect()] == ["https://a.org/1"]


def test_late_rows_count_in_their_hour(spark, tmp_path):
    def events(hours):
        return spark.createDataFrame([("j", True, T0 + timedelta(hours=h)) for h in hours], "job_id string, success boolean, ts timestamp_ntz")

    stream = micro_batches(spark, tmp_path / "in", [events([1, 1, 6]), events([7]), events([1, 20])])
    drain(S.updates(S.windowed_statistics(stream), str(tmp_path / "out"), str(tmp_path / "c")))
    got = {r.window_start.hour: r.total for r in S.newest_counts(spark.read.parquet(str(tmp_path / "out")), "window_start").collect()}
    assert got == {1: 3, 6: 1, 7: 1, 20: 1}


def test_first_urls_across_batches(spark, tmp_path):
    def urls(rows):
        return spark.createDataFrame([(u, T0 + timedelta(minutes=m)) for u, m in rows], "url string, ts timestamp_ntz")

    stream = micro_batches(spark, tmp_path / "in", [urls([("https://a.org/#x", 0), ("https://b.org", 1)]), urls([("https://a.org", -5), ("https://c.org", -6)])])
    drain(S.first_urls(stream, "ts", str(tmp_path / "out"), str(tmp_path / "c")))
    assert sorted(r.norm_url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["https://a.org", "https://b.org", "https://c.org"]


def test_first_urls_are_those_of_the_first_batch_and_survive_restarts(spark, tmp_path):
    """Four batches in two starts, against a loop over the rows; a key with most of the rows, null URLs and times, ties."""
    rows = [[(b * 100 + i, f"https://h{(i * i + b) % 7 if i % 3 else 0}.org/#{i}" if i % 11 else None, T0 + timedelta(minutes=i * 7 % 13 - b) if i % 5 else None)
             for i in range(40)] for b in range(4)]
    batches = [spark.createDataFrame(r, "id long, url string, ts timestamp_ntz") for r in rows]
    out, source = str(tmp_path / "out"), tmp_path / "in"
    for start in (0, 2):
        drain(S.first_urls(micro_batches(spark, source, batches[start : start + 2], start), "ts", out, str(tmp_path / "c")))
    known = {}
    for r in rows:
        new = {}
        for _, url, ts in r:
            key = url.split("#")[0].rstrip("/") if url else url
            # A missing time stands first, a missing URL before any other.
            rank = (ts is not None, ts or T0, url or "")
            if key not in known and (key not in new or rank < new[key]):
                new[key] = rank
        known |= new
    got = spark.read.parquet(out).select("norm_url", "url", F.col("ts").cast("timestamp_ntz").alias("ts")).collect()
    assert len(got) == len(known)
    assert {(r.norm_url or "").rstrip("/") or None: (r.ts is not None, r.ts or T0, r.url or "") for r in got} == known


def test_robots_stream_takes_the_newest_live_snapshot_once(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    rules = lambda path: f"User-agent: *\nDisallow: {path}"
    snapshots = spark.createDataFrame(
        [("s1", "https://a.org", at(0), 200, rules("/x")), ("s2", "https://a.org", at(10), 200, rules("/y")), ("s3", "https://a.org", at(31), 200, rules("/"))],
        "snapshot_id string, origin string, fetched_at timestamp, status int, content string",
    )
    asked = spark.createDataFrame([(1, "https://a.org/x", at(30)), (2, "https://a.org/y", at(30)), (3, "https://b.org/", at(30))], "id long, url string, requested_at timestamp")
    stream = micro_batches(spark, tmp_path / "in", [asked])
    drain(S.robots_stream(stream, lambda: snapshots, str(tmp_path / "out"), str(tmp_path / "c"), "id"))
    assert sorted((r.id, r.allowed) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, True), (2, False), (3, True)]


def test_tables_open_as_streams_from_a_file_and_from_a_folder(spark, tmp_path):
    from pageforge.queries.streams import opened, written

    spark.range(6).repartition(3).write.parquet(f"{tmp_path}/tables/pages.parquet")
    spark.range(9).coalesce(1).write.parquet(f"{tmp_path}/one")
    next((tmp_path / "one").glob("part-*.parquet")).rename(tmp_path / "tables/labels.parquet")
    for name, rows in (("pages", 6), ("labels", 9)):
        made = written(opened(spark, str(tmp_path / "tables"), name), f"{tmp_path}/{name}")
        assert sorted(r.id for r in made.collect()) == list(range(rows))
