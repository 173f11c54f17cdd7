"""Operators on small tables against plain-Python statements of the rules."""

import hashlib
import random
from datetime import datetime, timedelta
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from pageforge import catalog
from pageforge.operators import jobs, keys, pacing, quality, robots, running, search, urlrules
from pageforge.plans import content
from pageforge.plans.ingest import ingest, outcomes
from pageforge.sources import readers, sinks

T0 = datetime(2024, 1, 1)


def replay(rows, stored=()):
    urls, skus, out = {s[0] for s in stored}, {s[1] for s in stored if s[1]}, []
    for i, url, sku in sorted(rows):
        if url in urls or (sku and sku in skus):
            continue
        urls.add(url)
        if sku:
            skus.add(sku)
        out.append(i)
    return out


@pytest.mark.parametrize("spread", [4, 12, 60])
def test_inserts_equal_a_replay(spark, spread):
    rng = random.Random(spread)
    rows = [(i, f"u{rng.randrange(spread)}" if rng.random() > 0.3 else "hot", rng.choice([None, f"s{rng.randrange(spread)}"])) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, url string, sku string")
    got = sorted(r.i for r in keys.accept_inserts(df, ["url", "sku"], "i").collect())
    assert got == replay(rows)
    stored = spark.createDataFrame([("hot", "s1"), ("u2", None)], "url string, sku string")
    got = sorted(r.i for r in keys.accept_inserts(df, ["url", "sku"], "i", stored).collect())
    assert got == replay(rows, [("hot", "s1"), ("u2", None)])


def test_chain_of_collisions(spark):
    rows = [(i, f"u{i // 2}", f"s{(i + 1) // 2}") for i in range(7)]
    df = spark.createDataFrame(rows, "i int, url string, sku string")
    assert sorted(r.i for r in keys.accept_inserts(df, ["url", "sku"], "i").collect()) == replay(rows)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rows = [(i, f"u{(i + 1) // 2}", f"s{i // 2}") for i in range(3000)]
    written, settle = [], keys.settle
    monkeypatch.setattr(keys, "settle", lambda df: written.append(1) or settle(df))
    df = spark.createDataFrame(rows, "i int, url string, sku string")
    assert sorted(r.i for r in keys.accept_inserts(df, ["url", "sku"], "i").collect()) == replay(rows)
    assert len(written) <= 4 + 14


def test_chains_under_three_keys(spark):
    rng = random.Random(9)
    pick = lambda name, i: rng.choice([None, f"{name}{i // 2}", f"{name}{(i + 1) // 2}", f"{name}{rng.randrange(60)}"])
    rows = [(f"{i:04}", pick("a", i), pick("b", i), pick("c", i)) for i in range(300)]
    df = spark.createDataFrame(rows, "i string, a string, b string, c string")
    taken, want = [set(), set(), set()], []
    for i, *ks in rows:
        if not any(k in t for k, t in zip(ks, taken) if k is not None):
            want.append(i)
            for k, t in zip(ks, taken):
                t.add(k)
    assert sorted(r.i for r in keys.accept_inserts(df, ["a", "b", "c"], "i").collect()) == want


def test_requests_are_shuffled_once_for_robots(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        requests = spark.range(10).selectExpr("id", "concat('https://h', id, '.org/x') AS url", "timestamp_seconds(id) AS requested_at", "repeat('q', id) AS payload")
        snapshots = spark.createDataFrame([("h#1", "https://h1.org", T0, 200, "User-agent: *\nDisallow: /x")], "snapshot_id string, origin string, fetched_at timestamp, status int, content string")
        plan = robots.check_robots(requests, snapshots, "id", keep=("payload",))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.split("\n")
    assert sum("Exchange" in a and "payload" in b for a, b in zip(lines, lines[1:])) == 1 and plan.count("SortMergeJoin") == 2


def test_snapshot_intervals_equal_a_scan(spark):
    rng = random.Random(4)
    at = lambda: T0 + timedelta(seconds=rng.randrange(0, 20_000, 50))
    snaps = [(f"s{i:03}", rng.choice(["https://a.org", "https://b.org"]), at()) for i in range(60)]
    asked = [(i, rng.choice(["https://a.org/1", "https://b.org/2", "https://c.org/3"]), at()) for i in range(400)]
    snapshots = spark.createDataFrame(snaps, "snapshot_id string, origin string, fetched_at timestamp")
    requests = spark.createDataFrame(asked, "id int, url string, requested_at timestamp")
    got = {r.id: r.snapshot_id for r in robots.latest_snapshot(requests, snapshots, "id").collect()}
    live = lambda u, t: [(f, s) for s, o, f in snaps if u.startswith(o) and timedelta(0) <= t - f < timedelta(hours=1)]
    assert got == {i: max(live(u, t), default=(None, None))[1] for i, u, t in asked}


def sequential_starts(rows, delay):
    last, out = {}, {}
    for i, domain, at in sorted(rows, key=lambda r: (r[2], r[0])):
        start = at if domain not in last or domain == "" else max(at, last[domain] + delay)
        last[domain], out[i] = start, start
    return out


def test_schedule_equals_a_sequential_loop(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot", "hot", "cold", ""]), T0 + timedelta(seconds=rng.randrange(0, 9000), microseconds=rng.randrange(10**6))) for i in range(800)]
    df = spark.createDataFrame(rows, "id int, domain string, arrival timestamp_ntz").withColumn("delay", F.lit(7.25))
    got = {r.id: r.start for r in pacing.schedule(df).collect()}
    assert got == sequential_starts(rows, timedelta(seconds=7.25))


def test_schedule_keeps_rows_without_domain_or_arrival(spark):
    rows = [(1, None, T0), (2, "a", None), (3, "a", T0), (4, "a", T0), (5, None, None), (6, "", T0)]
    df = spark.createDataFrame(rows, "id int, domain string, arrival timestamp_ntz").withColumn("delay", F.lit(2.0))
    got = {r.id: r.start for r in pacing.schedule(df).collect()}
    assert got == {1: T0, 2: None, 3: T0, 4: T0 + timedelta(seconds=2), 5: None, 6: T0}


def test_rules_keep_their_groups(spark):
    df = spark.createDataFrame([("https://a.org/xx",), ("https://a.org/xy",)], "url string")
    rules = urlrules.UrlRules(deny_regex=(r"(q)z", r"(?P<n>x)(?P=n)"))
    assert [r.url for r in df.where(rules.allows(F.col("url"))).collect()] == ["https://a.org/xy"]
    with pytest.raises(ValueError):
        urlrules.UrlRules(deny_regex=("(",))


def test_cancellation_stands_only_before_an_end(spark):
    rows = [("a", 1, "running"), ("a", 2, "completed"), ("a", 3, "cancelled"), ("b", 1, "running"), ("b", 2, "cancelled"), ("b", 3, "completed"), ("c", 1, "completed"), ("c", 2, "running")]
    df = spark.createDataFrame([(j, s, x, T0 + timedelta(hours=s)) for j, s, x in rows], "job_id string, seq int, status string, ts timestamp_ntz")
    got = {r.job_id: (r.status, r.completed_at) for r in jobs.latest_states(df).collect()}
    assert got == {"a": ("completed", T0 + timedelta(hours=2)), "b": ("cancelled", T0 + timedelta(hours=2)), "c": ("running", None)}


def test_shared_folder_is_required_on_a_cluster(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda k, d=None: d)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        keys.shared_folder(Session)


def test_delays_and_domain_statistics(spark):
    df = spark.createDataFrame([(1, "a", T0), (2, "b", T0)], "id int, domain string, arrival timestamp_ntz")
    overrides = spark.createDataFrame([("A", 3.0), ("b", 0.0)], "domain string, delay double")
    timed = pacing.schedule(pacing.effective_delays(df, overrides))
    stats = pacing.domain_statistics(timed, F.lit("2024-01-01 00:00:02").cast("timestamp_ntz"))
    assert {r.domain: (r.delay, r.time_since_last, r.ready_to_request) for r in stats.collect()} == {"a": (3.0, 2.0, False), "b": (1.0, 2.0, True)}


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(4)}", i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = running.with_running_sums(df, ["k"], ["i"], F.floor(F.col("i") / 37), {"s": F.col("v"), "n": F.lit(1)})
    totals, want = {}, {}
    for k, i, v in rows:
        s, n = totals.get(k, (0, 0))
        totals[k] = want[i] = (s + v, n + 1)
    assert {r.i: (r.s, r.n) for r in got.collect()} == want


FILES = [
    "User-agent: *\nDisallow: /fr/\nAllow: /",
    "User-agent: a\nUser-agent: mybot\nDisallow: /x\nCrawl-delay: 3\n\nUser-agent: *\nDisallow: /",
    "User-agent: mybot\n\nDisallow: /x\nUser-agent: *\nAllow: /x/ok\nDisallow: /x\nCrawl-delay: soon",
    "# c\nUSER-AGENT: MyBot/3 # no\nDisallow: /\nUser-agent: bot\nDisallow: /%7Eu\nDisallow:\n",
    "Disallow: /\nUser-agent: *\nDisallow: *\n\nUser-agent: *\nAllow: /",
    "User-agent: *\nDisallow: /a b\nDisallow: /q?x=1",
    "", "junk\nAllow: /", "User-agent: mybot\nCrawl-delay: 9", "User-agent: *\nUser-agent: mybot\nDisallow: /x\n\nUser-agent: mybot\nDisallow: /y",
]
PATHS = ["/", "/x", "/x/ok", "/fr/1", "/~u/1", "/%7eu", "/y", "/a%20b", "/q?x=12", "", "/é"]


@pytest.mark.parametrize("agent", ["MyBot/1.0", "other", "*"])
def test_robots_rules_equal_the_standard_parser(spark, agent):
    snapshots = spark.createDataFrame(
        [(f"s{k}", f"https://h{k}.org", T0, 200, text) for k, text in enumerate(FILES)],
        "snapshot_id string, origin string, fetched_at timestamp, status int, content string")
    asked = [(k * 100 + j, f"https://h{k}.org{p}", T0 + timedelta(seconds=5)) for k in range(len(FILES)) for j, p in enumerate(PATHS)]
    df = spark.createDataFrame(asked, "id int, url string, requested_at timestamp")
    got = {r.id: (r.allowed, r.crawl_delay) for r in robots.check_robots(df, snapshots, "id", agent).collect()}
    for i, url, _ in asked:
        parser = RobotFileParser()
        parser.parse(FILES[i // 100].splitlines())
        assert got[i] == (parser.can_fetch(agent, url), parser.crawl_delay(agent)), (FILES[i // 100], url)


def test_robots_as_of(spark):
    snapshots = spark.createDataFrame(
        [("old", "https://h.org", T0, 200, "User-agent: *\nDisallow: /"), ("new", "https://h.org", T0 + timedelta(minutes=50), 500, None)],
        "snapshot_id string, origin string, fetched_at timestamp, status int, content string")
    times = {1: 10, 2: 55, 3: 61, 4: 109, 5: 110, 6: -1}
    df = spark.createDataFrame([(i, "https://h.org/x", T0 + timedelta(minutes=m)) for i, m in times.items()], "id int, url string, requested_at timestamp")
    got = {r.id: (r.snapshot_id, r.allowed) for r in robots.check_robots(df, snapshots, "id").collect()}
    assert got == {1: ("old", False), 2: ("new", True), 3: ("new", True), 4: ("new", True), 5: (None, True), 6: (None, True)}


def test_url_rules(spark):
    rules = urlrules.UrlRules().add("allow", "https://example.com/*").add("deny", "*/admin/*").add("deny", "(bad")
    df = spark.createDataFrame([("https://example.com/page",), ("https://example.com/admin/",), ("https://o.org",), ("https://example.com/(bad",)], "url string")
    assert [r.url for r in urlrules.filter_urls(df, rules).collect()] == ["https://example.com/page"]
    assert rules.add("deny", "(bad").summary() == {"whitelist_patterns": 1, "blacklist_patterns": 2, "regex_whitelist": 0, "regex_blacklist": 0}
    assert urlrules.filter_urls(df, rules.cleared()).count() == 4
    many = urlrules.UrlRules(deny=tuple(f"*no{i}such*" for i in range(6000)) + ("*o.org",))
    assert urlrules.filter_urls(df, many).count() == 3
    with pytest.raises(ValueError):
        rules.add("deny", "(", is_regex=True)


def test_url_list_messages(spark):
    urls = ["https://a.org", "invalid-url", " https://a.org ", "", None, "https://b.org/x y", "https://c.org/" + "x" * 2048]
    lists = spark.createDataFrame([(1, urls), (2, []), (3, ["https://a.org"] * 4)], "id int, urls array<string>")
    got = quality.url_list_errors(lists, "id", "urls", max_count=7).orderBy("id", "pos", "n").collect()
    assert [(r.id, r.pos, r.message) for r in got] == [
        (1, 1, "URL at index 1 must use http or https protocol: invalid-url"), (1, 2, "Duplicate URL found: https://a.org"),
        (1, 3, "URL at index 3 cannot be empty"), (1, 4, "URL at index 4 must be a string"),
        (1, 5, "URL at index 5 contains spaces: https://b.org/x y"), (1, 6, "URL at index 6 is too long (max 2048 characters)"),
        (2, -1, "URL list cannot be empty"), (3, 1, "Duplicate URL found: https://a.org"), (3, 2, "Duplicate URL found: https://a.org"),
        (3, 3, "Duplicate URL found: https://a.org")]


def test_selector_messages(spark):
    sets = spark.createDataFrame([(1, {"title": "h1", "content": ".invalid["}), (2, {})], "id int, s map<string,string>")
    got = quality.selector_errors(sets, "id", "s").orderBy("id").collect()
    assert [r.message for r in got] == ["Unmatched brackets in selector for 'content': .invalid[", "Selectors must be a non-empty dictionary"]


def test_required_fields(spark):
    df = spark.createDataFrame([(0.0, "  ", [], "x"), (1.0, None, ["a"], "")], "price double, name string, tags array<string>, url string")
    got = [r.e for r in df.select(quality.required_field_errors(df, ["price", "name", "tags", "url", "gone"]).alias("e")).collect()]
    gone = "Required field 'gone' is missing or empty"
    assert got == [
        ["Required field 'price' is missing or empty", "Required field 'name' is empty", "Required field 'tags' is missing or empty", gone],
        ["Required field 'name' is missing or empty", "Required field 'url' is missing or empty", gone]]


def test_search_checks(spark):
    for make in (lambda: search.Filter("a", "like", 1), lambda: search.ContentQuery("news"), lambda: search.ContentQuery("blog", sort_order="up"),
                 lambda: search.ContentQuery("blog", limit=0), lambda: search.ContentQuery("blog", offset=-1), lambda: search.parse_filters("{"),
                 lambda: search.page_of(spark.range(1), 101, 0, catalog.MAX_JOBS_LIMIT), lambda: catalog.content_type("news")):
        with pytest.raises(ValueError):
            make()
    df = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "id int, v int")
    assert [r.id for r in search.ordered(df, "v").collect()] == [3, 1, 2]
    assert [r.id for r in search.ordered(df, "v", "asc").collect()] == [1, 3, 2]
    assert [r.id for r in search.equals(df, {"v": None}).collect()] == [2]


def test_job_states_and_cancellation(spark):
    rows = [("a", 1, "pending"), ("a", 2, "running"), ("a", 3, "cancelled"), ("a", 4, "completed"), ("b", 1, "pending")]
    df = spark.createDataFrame([(j, s, st, T0 + timedelta(hours=s)) for j, s, st in rows], "job_id string, seq int, status string, ts timestamp_ntz")
    got = {r.job_id: (r.status, r.completed_at) for r in jobs.latest_states(df).collect()}
    assert got == {"a": ("cancelled", T0 + timedelta(hours=3)), "b": ("pending", None)}
    empty = jobs.statistics(jobs.latest_states(df.where("false")).withColumn("total_urls", F.lit(1))).first()
    assert (empty.total_jobs, empty.success_rate, empty.avg_urls_per_job) == (0, 0.0, 0.0)


def test_cancellation_of_a_job_that_runs_again(spark, monkeypatch):
    """Against a replay of the changes, with chunks of few changes and of all."""
    import random

    rng, rows = random.Random(2), []
    for j in range(80):
        rows += [(f"j{j}", s, rng.choice(["pending", "running", "completed", "failed", "cancelled"])) for s in sorted(rng.sample(range(60), rng.randint(1, 12)))]
    want = {}
    for j, s, status in rows:
        last, stopped = want.get(j, (None, None))
        if stopped is None and status == "cancelled":
            want[j] = (last, s) if last in (None, "pending", "running") else (last, None)
        elif stopped is None:
            want[j] = (status, None)
    want = {j: ("cancelled", T0 + timedelta(hours=stop)) if stop is not None else (last, ...) for j, (last, stop) in want.items()}
    df = spark.createDataFrame([(j, s, x, T0 + timedelta(hours=s)) for j, s, x in rows], "job_id string, seq int, status string, ts timestamp_ntz")
    for chunk in (5, 50_000):
        monkeypatch.setattr(jobs, "STATE_CHUNK", chunk)
        got = {r.job_id: (r.status, r.completed_at if r.status == "cancelled" else ...) for r in jobs.latest_states(df).collect()}
        assert got == want


def test_blog_record(spark):
    df = spark.createDataFrame(
        [("https://B.org/x", " A &amp; B ", "One. Two.", "Ann", "01/02/2024", " t1 , ,t2", None, "")],
        "url string, title string, content string, author string, published_date string, tags string, excerpt string, category string")
    got = content.blog(df).first()
    assert (got.title, got.excerpt, got.category, got.slug, got.source_domain) == ("A & B", "One. Two..", "t1", "a-b", "b.org")
    assert (got.tags, got.published_date, got.word_count, got.reading_time) == (["t1", "t2"], datetime(2024, 1, 2), 2, 1)
    bare = content.blog(spark.createDataFrame([("https://b.org", None)], "url string, title string")).first()
    assert (bare.title, bare.slug, bare.excerpt, bare.word_count, bare.reading_time, bare.category) == ("", None, None, 0, 0, "b.org")


def test_product_record(spark):
    df = spark.createDataFrame(
        [("https://s.org/books/1", "N", 0.0, ["/a.png", None], {"k": " v "}, "9")],
        "url string, name string, price double, images array<string>, specifications map<string,string>, rating string")
    got = content.product(df).first()
    assert (got.price, got.currency, got.category, got.images, got.specifications, got.rating) == (
        0.0, "USD", "books", ["https://s.org/a.png"], {"k": "v"}, 5.0)


def test_custom_type_registration(spark):
    with pytest.raises(ValueError):
        content.process(spark.range(1), "nope")
    assert content.supported_types()[:4] == ["blog", "prompt", "article", "product"]


def test_ingest_then_insert(spark, tmp_path):
    html = "<h1>T</h1><article>{}</article>"
    rows = [(i, u, html.format(i)) for i, u in enumerate(["https://a.org/1", "https://a.org/2", "https://a.org/1", "ftp://a.org", "https://a.org/3"])]
    rows[4] = (4, "https://a.org/3", "<p>no title</p>")
    requests = spark.createDataFrame(rows, "request_id bigint, url string, html string")
    snapshots = spark.createDataFrame(
        [("s", "https://a.org", T0, 200, "User-agent: *\nDisallow: /2")],
        "snapshot_id string, origin string, fetched_at timestamp, status int, content string")
    asked = requests.withColumn("requested_at", F.lit(T0 + timedelta(seconds=1)))
    results = ingest(asked, "article", snapshots=snapshots)
    errors = {r.request_id: list(r.errors) for r in results.collect()}
    assert errors[0] == errors[2] == []
    assert errors[1] == ["Robots.txt disallows crawling: https://a.org/2"]
    assert errors[3] == ["Invalid URL: ftp://a.org"]
    assert errors[4][0].startswith("Content validation failed: Required field 'title' is missing or empty, Required field 'content'")
    stored = sinks.stored_rows(results, "article", F.lit("2024-01-01"))
    root = str(tmp_path)
    # The second request for the first page is refused, and both when they are inserted again.
    for refused in ([2], [0, 2]):
        rejected = sinks.insert(stored, root, "article")
        assert sorted(r.request_id for r in rejected.collect()) == refused
        after = {r.request_id: r for r in sinks.with_storage(outcomes(results), rejected).collect()}
        assert all((after[i].content_id is None) == (i in refused) and after[i].success for i in (0, 2))
        assert after[2].errors == ["Failed to store content in database: unique key already stored: url"]
    table = sinks.read_table(spark, root, "article").collect()
    assert [(r.url, r.content, r.content_type) for r in table] == [("https://a.org/1", "0", "article")]
    assert len(table[0].id) == 36 and '"html":"<h1>T</h1>' in table[0].raw_data


def test_partial_updates_with_thousands_of_unknown_names(spark):
    base = spark.createDataFrame([(1, "a", 1.0, "old"), (2, "b", 2.0, "old"), (3, "c", 3.0, "old"), (4, "d", 4.0, "old")], "id int, name string, price double, updated_at string")
    many = [(1, n, {f"x{n}": "1"}) for n in range(3000)]
    rows = [*many, (1, 4000, {"name": "n1"}), (1, 4001, {"name": "n2", "zz": "1"}), (1, 4002, {"price": None}), (2, 1, {"unknown": "1"}), (3, 1, None), (4, 1, {})]
    updates = spark.createDataFrame(rows, "id int, seq int, changes map<string,string>")
    merged = keys.merged_changes(updates, "id", "changes", "seq", base.columns)
    assert {r.id: r.changes for r in merged.collect()} == {1: {"name": "n2", "price": None}, 2: {}}
    got = {r.id: tuple(r)[1:] for r in keys.apply_changes(base, merged, "id", "changes", F.lit("now")).collect()}
    assert got == {1: ("n2", None, "now"), 2: ("b", 2.0, "now"), 3: ("c", 3.0, "old"), 4: ("d", 4.0, "old")}


def test_unknown_and_null_types_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "u", "article"), (2, "u", "news"), (3, "u", None)], "id int, url string, content_type string")
    made = content.process_mixed(df, keep=["id", "url"])
    assert [r.id for r in made["article"].collect()] == [1]
    assert sorted((r.id, r.reason) for r in made[content.UNSUPPORTED].collect()) == [(2, "Unsupported content type: news"), (3, "Unsupported content type: null")]


def test_one_result_per_request(spark):
    pages = spark.createDataFrame(
        [(2, "https://a.org", "<h1>b</h1><article>x</article>"), (1, "https://a.org", "<h1>a</h1><article>x</article>")], readers.PAGE_SCHEMA)
    requests = spark.createDataFrame([(1, "https://a.org"), (2, "https://a.org"), (3, "https://b.org")], "request_id bigint, url string")
    got = {r.request_id: (r.success, r.data.title if r.data else None) for r in ingest(requests, "article", pages=pages).collect()}
    assert got == {1: (True, "a"), 2: (True, "a"), 3: (False, None)}


def test_page_readers(spark, tmp_path):
    df = spark.createDataFrame([(1, "https://a.org", "<h1>x</h1>")], "page_id bigint, url string, html string")
    df.write.json(str(tmp_path / "j"))
    df.write.parquet(str(tmp_path / "p"))
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.html").write_text("<h1>x</h1>\n<p>y")
    assert readers.read_pages(spark, str(tmp_path / "j"), "json").collect() == df.collect()
    assert readers.read_pages(spark, str(tmp_path / "p")).collect() == df.collect()
    whole = readers.read_pages(spark, str(tmp_path / "t"), "text").first()
    assert whole.url.endswith("a.html") and whole.html == "<h1>x</h1>\n<p>y"
    (tmp_path / "r.json").write_text('{"id": 7, "premium": true, "category": {"id": 30, "subscriptions_id": {"id": 3}}}')
    record = readers.read_prompt_records(spark, str(tmp_path / "r.json")).first()
    assert (record.id, record.premium, record.category_id, record.subscription_id, record.slug) == (7, True, 30, 3, None)


def test_plans_push_filters_and_prune_columns(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = search.equals(orders, {"o_orderstatus": "F"}).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan
    page = search.page_of(search.ordered(orders, "o_totalprice", tiebreak="o_orderkey"), 10, 5)
    assert "TakeOrderedAndProject" in page._jdf.queryExecution().executedPlan().toString()
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = content.article(ingest_fields(pages))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("regexp_extract_all(coalesce(html") == 1


def ingest_fields(pages):
    from pageforge.operators.extract import extract_fields

    return extract_fields(pages, dict(catalog.ARTICLE.selectors))


@pytest.mark.parametrize("by, order", [("v", "asc"), ("v", "desc"), ("id", "desc"), (None, "desc"), ("absent", "asc")])
def test_cursor_pages_are_the_whole_order(spark, by, order):
    """Page by page to the end: every row once, in the order of a full sort; ties and nulls in the sort field."""
    rows = [(i, None if i % 4 == 0 else i * 7 % 5) for i in range(23)]
    df = spark.createDataFrame(rows, "id long, v int")
    got, cursor = [], None
    while page := search.cursor_page(df, cursor, by, order, limit=5).collect():
        got += [(r.id, r.v) for r in page]
        cursor = search.next_cursor(search.cursor_page(df, cursor, by, order, limit=5), by)
    assert got == [(r.id, r.v) for r in search.ordered(df, by, order).collect()]
    assert search.next_cursor(search.cursor_page(df.where("false"), None, by, order), by) is None


def test_cursor_comparison_reaches_the_scan(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") % 10).alias("v")).write.parquet(str(tmp_path / "t"))
    page = search.cursor_page(spark.read.parquet(str(tmp_path / "t")), {"v": 7, "id": 17}, "v", "asc", limit=5)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThanOrEqual(v,7)" in plan
    assert [r.id for r in page.collect()] == [27, 37, 47, 57, 67]


def test_clustered_tables_skip_row_groups(spark, tmp_path):
    """A look-up by key reads few rows thanks to statistics, one by a scattered column thanks to Bloom filters."""
    path = str(tmp_path / "t")
    rows = spark.range(200_000).select("id", F.md5(F.col("id").cast("string")).alias("code"), F.lit("x" * 20).alias("rest"))
    sinks.write_clustered(rows, path, "id", "code", distinct=30_000, block_bytes=1 << 20)

    def read(column, value):
        found = keys.find_by_id(spark.read.parquet(path), value, column)
        assert f"EqualTo({column}" in found._jdf.queryExecution().executedPlan().toString()
        assert [r[column] for r in found.collect()] == [value]
        nodes = found._jdf.queryExecution().executedPlan().collectLeaves()
        return nodes.apply(0).metrics().apply("numOutputRows").value()

    assert 0 < read("id", 77_777) <= 60_000
    assert 0 < read("code", hashlib.md5(b"123456").hexdigest()) <= 100_000
    assert keys.find_by_id(spark.read.parquet(path), -5, "id").isEmpty()


def test_saved_searches_as_a_table_match_the_compiled_ones(spark):
    """Every row against every search, as ``matched_searches`` decides; ties, nulls, other types, unknown fields, no field at all."""
    rows = [(i, "hot" if i % 3 else f"k{i}", None if i % 5 == 0 else i % 4, i / 2, i % 2 == 0, [1]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, k string, n int, x double, b boolean, a array<int>")
    texts = {
        "hot": '{"k": "hot"}', "rare": '{"k": "k3", "n": 3}', "both": '{"k": "hot", "n": 2, "b": true}', "null": '{"n": null, "k": "hot"}',
        "double": '{"x": 4}', "unknown": '{"zz": 1, "n": 1}', "only unknown": '{"zz": 1}', "empty": "", "none": '{"k": "nobody"}',
    }
    want = {(r.id, s) for r in df.select("id", search.matched_searches(df, texts).alias("s")).collect() for s in r.s}
    never = [("broken", '{"k": '), ("a list", "[1]"), ("no int", '{"n": "many"}')]
    table = spark.createDataFrame([*texts.items(), *never], "name string, filters string")
    got = [tuple(r) for r in search.saved_search_matches(df, table, "id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert search.saved_search_matches(df, table.where("false"), "id").isEmpty()
    assert search.saved_search_matches(df.where("false"), table, "id").isEmpty()


def test_saved_searches_are_never_broadcast(spark):
    """Both tables grow, and files tell little of what their texts take in memory."""
    rows = spark.createDataFrame([(i, i % 3) for i in range(30)], "id int, kind int")
    table = rows.select(F.col("id").cast("string").alias("name"), F.format_string('{"kind": %d}', "kind").alias("filters"))
    found = search.saved_search_matches(rows, table, "id")
    assert found.count() == 300
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("stretch", [1, 7, 200_000])
def test_chains_followed_in_stretches(spark, monkeypatch, stretch):
    """Rows wait for one or two others near or far away, in stretches of any length; few nodes go into the rounds."""
    monkeypatch.setattr(keys, "STRETCH", stretch)
    rng, written = random.Random(stretch), []
    settled = keys.settle
    monkeypatch.setattr(keys, "settle", lambda df, by=None: (written.append(settled(df, by)), written[-1])[1])
    rows = [(i, f"u{(i + 1) // 2}", f"s{i // 2}") for i in range(400)]
    rows += [(i, f"v{rng.randrange(150)}", rng.choice([None, f"t{rng.randrange(150)}", f"t{i // 3}"])) for i in range(400, 900)]
    df = spark.createDataFrame(rows, "i int, url string, sku string")
    assert sorted(r.i for r in keys.accept_inserts(df, ["url", "sku"], "i").collect()) == replay(rows)
    if stretch == 200_000:
        rounds = [df.count() for df in written if df.columns[:3] == ["ord", "k", "p"] and "taken" in df.columns]
        assert sum(rounds[1:]) < 2 * rounds[0]
