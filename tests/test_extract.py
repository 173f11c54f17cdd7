"""Selector extraction on small pages."""

import pytest
from pyspark.sql import functions as F

from pageforge.functions.selectors import UnsupportedSelector, parse_selector
from pageforge.operators import extract
from pageforge.plans.content import process
from pageforge.operators.extract import extract_fields, extract_own_fields, links, page_metadata


@pytest.fixture
def page(spark):
    def run(html, problems=None, **selectors):
        df = spark.createDataFrame([(1, "https://h.org/a/b", html)], "page_id int, url string, html string")
        return extract_fields(df, selectors, problems=problems).first().asDict()

    return run


def test_text_is_joined_without_separator(page):
    got = page("<article><p> a </p><p>b</p><script>var t='</article>';</script><!-- x --></article>", content="article")
    assert got["content"] == "ab"


def test_first_selector_in_list_order_wins(page):
    got = page("<p class='title'>late</p><h1>first</h1>", title="h1, .title", other=".none, .title", missing=".none")
    assert (got["title"], got["other"], got["missing"]) == ("first", "late", None)


def test_lists_and_commas(page):
    assert page("<ul><li>x</li><li>y</li></ul>", tags="ul")["tags"] == ["x", "y"]
    assert page("<span>a, ,b</span>", tags="span")["tags"] == ["a", "", "b"]
    assert page("<ol><li>a<ul><li>b &amp; c</li></ul></li><li> d</ol><li>no</li>", categories="ol")["categories"] == ["ab & c", "b & c", "d"]


def test_selector_forms(page):
    html = """<div class="byline x"><a rel=me href='../q?x=1&amp;y=2'>Ann</a><b id="n" data-k="v>w">Bea</b></div><b>late</b>
      <table><tr><td>1<td class=c>2<tr><td>3</table><dl><dt>t<dd class=d>u<dt>v</dl>"""
    got = page(
        html, a=".byline b", b=".byline > b#n", c="[data-k='v>w']", d="a[rel]", link=".x a[href]", e="td.c", f=".d", g="table .c",
        h="div.byline.x", i="body b, b",
    )
    assert (got["a"], got["b"], got["c"], got["d"]) == ("Bea", "Bea", "Bea", "Ann")
    assert got["link"] == "https://h.org/q?x=1&y=2"
    assert (got["e"], got["f"], got["g"], got["h"], got["i"]) == ("2", "u", "2", "AnnBea", "Bea")


def test_unclosed_elements_end_with_their_parent(page):
    got = page("<div><p class=t>one<b>two</div>three<h1>four<p>five", t=".t", h="h1")
    assert (got["t"], got["h"]) == ("onetwo", "fourfive")
    assert page("<p class=t>one<p>two", t=".t")["t"] == "one"


def test_dates_images_and_void_elements(page):
    got = page("<time datetime='2024-01-15T10:30:00Z'>x</time><img src='/i.png'><br class=v>z", date="time", image="img", v=".v")
    assert str(got["date"]) == "2024-01-15 10:30:00"
    assert (got["image"], got["v"]) == ("https://h.org/i.png", "")


def test_entities_are_decoded_before_stripping(page):
    assert page("<h1>&nbsp;a &eacute;&nbsp;</h1><h2>x &amp;lt; y < 5 & z</h2>", t="h1", u="h2") == {
        "page_id": 1, "url": "https://h.org/a/b", "html": "<h1>&nbsp;a &eacute;&nbsp;</h1><h2>x &amp;lt; y < 5 & z</h2>",
        "t": "a é", "u": "x &lt; y < 5 & z"}


def test_unsupported_selector_nulls_its_field_only(page):
    got = page("<h1>a</h1><p>b</p>", problems="why", title="h1", bad="p:first-child", late="h1, p::x")
    assert (got["title"], got["bad"], got["late"]) == ("a", None, "a")
    assert len(got["why"]) == 2


@pytest.mark.parametrize("text", ["", ">", "a >", "a:hover", "a + b", "a > > b", "[x", "..a"])
def test_bad_selectors(text):
    with pytest.raises(UnsupportedSelector):
        parse_selector(text)


def test_long_and_broken_pages_do_not_fail(page):
    assert page("<h1>" + "x < y " * 60000 + "</h1>", t="h1")["t"].startswith("x < y x")
    assert page("<h1 " + 'a="b" ' * 5000 + ">t</h1>", t="h1")["t"] == "t"
    for html in (None, "", "<", "<h1", "<!-- open", "<script>open", "</div></p>", '<h1 a="open>t</h1>'):
        page(html, t="h1")


def test_metadata_and_links(spark):
    df = spark.createDataFrame(
        [(1, "https://h.org/a", "<title> A &amp;\n B </title><a href='x?a&amp;b'>1</a><a name=n>2</a><img src=i><script>'<a href=z>'</script>")],
        "page_id int, url string, html string")
    got = page_metadata(df).first()
    assert (got.page_title, got.links_found, got.images_found) == ("A & B", 1, 1)
    assert [tuple(r) for r in links(df).collect()] == [(1, "https://h.org/a", 0, "https://h.org/x?a&b", "1")]


def test_extraction_matches_an_independent_parser(spark):
    """h1 and article text of the stored pages against the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self, wanted):
            super().__init__(convert_charrefs=True)
            self.wanted, self.depth, self.out, self.done, self.skip = wanted, 0, [], False, False

        def handle_starttag(self, tag, attrs):
            self.skip = tag in ("script", "style")
            if not self.done and tag == self.wanted:
                self.depth += 1

        def handle_endtag(self, tag):
            self.skip = False
            if self.depth and tag == self.wanted:
                self.depth -= 1
                self.done = self.depth == 0

        def handle_data(self, data):
            if self.depth and not self.skip:
                self.out.append(data.strip())

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = extract_fields(pages, {"a": "h1", "b": "article"}).select("html", "a", "b").collect()
    assert got
    for row in got:
        for wanted, text in (("h1", row.a), ("article", row.b)):
            reader = Reader(wanted)
            reader.feed(row.html)
            assert " ".join("".join(reader.out).split()) == " ".join(text.split())


OWN = {
    "a": ".byline b", "b": ".byline > b#n", "c": "[data-k='v>w']", "d": "a[rel]", "link": ".x a[href]", "e": "td.c", "f": ".d", "g": "table .c",
    "h": "div.byline.x", "i": "body b, b", "j": "p:hover, b", "k": "b, p:hover", "l": "[class^=by], b", "m": "[class$=x] > a", "n": "[class*=yli] b",
    "o": "[data-k|=v]", "p": "table tr td + td", "q": "", "r": ".none, .x > .none, div > b ~ b", "s": "div b, table > tr > td.c", "tags": "ul", "date": "time",
}
OWN_HTML = """<div class="byline x"><a rel=me href='../q?x=1&amp;y=2'>Ann</a><b id="n" data-k="v>w">Bea</b></div><b>late</b>
  <table><tr><td>1<td class=c>2<tr><td>3</table><dl><dt>t<dd class=d>u<dt>v</dl><ul><li>x<li>y</ul><time datetime="2024-01-15T10:30:00Z">"""


def test_selectors_as_data_equal_compiled_ones(spark):
    sets = [OWN, {k: v for k, v in OWN.items() if k < "f"}, {"a": None, "zz": "b"}, {}, None]
    rows = [(i, "https://h.org/a/b", html, s) for i, (html, s) in enumerate((h, s) for s in sets for h in (OWN_HTML, None, "<b>one</b>"))]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, chosen map<string,string>")
    got = {r.page_id: r.asDict() for r in extract_own_fields(df, "chosen", list(OWN), problems="why").drop("url", "html", "chosen").collect()}
    assert sorted(got) == [r[0] for r in rows]
    for i, url, html, chosen in rows:
        one = spark.createDataFrame([(i, url, html)], "page_id int, url string, html string")
        own = {k: v or "" for k, v in (chosen or {}).items()}
        want = extract_fields(one, {k: v for k, v in own.items() if k in OWN}, problems="why").drop("url", "html").first().asDict()
        assert {k: v for k, v in got[i].items() if k not in ("why", "page_id")} == {k: want.get(k) for k in OWN}, i
        assert got[i]["why"] == sorted(want["why"]), i


def test_one_plan_for_any_number_of_sets(spark):
    df = spark.range(300).selectExpr("id AS page_id", "'https://h.org/' AS url", "concat('<i class=c', id, '>', id, '</i>') AS html", "map('t', concat('.c', id)) AS s")
    out = extract_own_fields(df, "s", ["t"])
    assert ".c7" not in out._jdf.queryExecution().toString()
    assert all(r.t == str(r.page_id) for r in out.select("page_id", "t").collect())


def nested_texts(pieces):
    """Text of every item by reading on from its mark."""
    out = []
    for i, p in enumerate(pieces):
        if p == "<li>":
            depth, text = 0, ""
            for q in pieces[i + 1 :]:
                if q == "<ul>":
                    depth += 1
                elif q in ("<li>", "</li>", "</ul>"):
                    if depth == 0:
                        break
                    depth -= q == "</ul>"
                else:
                    text += q.strip()
            out.append(text)
    return out


def test_nested_lists_of_any_shape(spark):
    import random

    rng = random.Random(7)
    lists = [rng.choices(["<li>", "</li>", "<ul>", "</ul>", "a", " b ", "c"], weights=[5, 4, 3, 1, 3, 2, 2], k=rng.randint(1, 30)) for _ in range(200)]
    lists = [p if "<ul>" in p else [*p, "<ul>", "</ul>"] for p in lists]
    marks = {"<li>": extract.ITEM, "</li>": extract.ITEM_END, "<ul>": extract.LIST, "</ul>": extract.LIST_END}
    df = spark.createDataFrame([(i, extract.SEAM.join(marks.get(q, q) for q in p)) for i, p in enumerate(lists)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", extract._nested_items(F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(len(lists))] == [nested_texts(p) for p in lists]


def test_nested_lists_take_linear_time(spark):
    import time

    def seconds(n):
        html = "<ul>" + "<li>a<ul><li>b</li></ul></li>" * (n // 2) + "</ul>"
        df = spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string")
        run = extract_fields(df, {"tags": "ul"}).select(F.size("tags").alias("n"))
        times = []
        for _ in range(3):
            at = time.perf_counter()
            assert run.first().n == n
            times.append(time.perf_counter() - at)
        return min(times)

    small, large = seconds(500), seconds(4000)
    assert large < 16 * small + 1, (small, large)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_on_page_columns_reach_the_scan(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    made = extract_fields(pages, {"title": "h1", "content": "article"}, metadata=True)
    text = plan_of(made.where("url LIKE 'https://%'").select("page_id", "title"))
    assert "StringStartsWith(url,https://)" in text.split("PushedFilters: ")[1].split("]")[0]
    records = process(made, "article", keep=["page_id", "url"])
    assert "EqualTo(page_id,3)" in plan_of(records.where("page_id = 3")).split("PushedFilters: ")[1].split("]")[0]


def test_filters_on_fields_do_not_repeat_the_extraction(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    made = extract_fields(pages, {"title": "h1", "content": "article"})
    for df in (made, process(made, "article", keep=["page_id", "url"])):
        assert plan_of(df.where("title <> '' AND content LIKE '%a%'")).count("regexp_extract_all(") == plan_of(df).count("regexp_extract_all(")


def test_pages_are_spread_and_not_gathered_by_selector_set(spark):
    from pyspark.sql import functions as F

    from pageforge.operators.extract import compiled_set
    from pageforge.plans.ingest import spread

    sets = ['{"title":"h1"}', None, '{"title":"h2, a:hover"}']
    pages = spark.createDataFrame([(i, sets[i % 3]) for i in range(40)], "request_id int, chosen string").coalesce(1)
    made = spread(pages).withColumn("steps", compiled_set(F.col("chosen")))
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.select(F.spark_partition_id()).distinct().count() > 4
    found = {(r.request_id % 3, r.n, r.tag) for r in made.select("request_id", F.size("steps").alias("n"), F.col("steps")[0]["choices"][0][0]["tag"].alias("tag")).collect()}
    assert {(0, 1, "h1"), (2, 1, "h2")} == {f for f in found if f[0] != 1}
