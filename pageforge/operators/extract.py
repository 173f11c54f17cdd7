"""Selector-driven extraction as a DataFrame step."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from pageforge.functions import html as H
from pageforge.functions.base import computed_once, let, squeeze, strip
from pageforge.functions.dates import parse_extracted_date
from pageforge.functions.entities import SEAM, decode_entities, join_seamed
from pageforge.functions.selectors import COMPILED, compiled
from pageforge.functions.urls import absolute_link

# Field names with their own value rule.
LINK_FIELDS = ("url", "link", "href")
IMAGE_FIELDS = ("image", "img", "src")
DATE_FIELDS = ("date", "published_date", "datetime")
LIST_FIELDS = ("tags", "categories")

TOKENS, TAGS, STARTS, ENDS = "_tokens", "_tags", "_starts", "_ends"

# Marks for list structure inside a joined token string. Python treats these
# four characters as white space, so text that holds them loses nothing when
# they are turned into spaces first.
ITEM, ITEM_END, LIST, LIST_END = "\x1e", "\x1f", "\x1c", "\x1d"


def with_tags(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add the token and tag arrays, computed once per page."""
    return pages.withColumn(TOKENS, H.tokens_of(F.col(html))).withColumn(TAGS, H.tags_of(F.col(TOKENS)))


def _joined(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, strip), "")


def _marked_list(inside: Column) -> Column:
    def mark(t: Column) -> Column:
        return (
            F.when(t.rlike(r"(?i)^<li[\s/>]"), ITEM)
            .when(t.rlike(r"(?i)^</li[\s/>]"), ITEM_END)
            .when(t.rlike(r"(?i)^<[uo]l[\s/>]"), LIST)
            .when(t.rlike(r"(?i)^</[uo]l[\s/>]"), LIST_END)
            .when(H.is_text(t), F.translate(t, ITEM + ITEM_END + LIST + LIST_END, "    "))
        )

    return F.array_join(F.array_compact(F.transform(inside, mark)), SEAM)


def _flat_items(marked: Column) -> Column:
    parts = F.split(marked, ITEM)
    items = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(items, lambda i: _joined(F.split(F.substring_index(i, ITEM_END, 1), SEAM)))


def _nested_items(marked: Column) -> Column:
    """Texts of all items of a list that holds lists, in one fold over the marks with a stack of open items.

    An item ends at the next mark of its own level: another item, an item's end or the list's end. Its text
    is a slice of the pieces, so the work is the marks plus the texts that come out.
    """
    none = F.array().cast("array<struct<at:int,level:int>>")
    begin = F.struct(F.lit(0).alias("level"), none.alias("open"), F.lit("").alias("closed"))

    def read(acc: Column, m: Column) -> Column:
        level, opened = acc["level"], acc["open"]
        top = F.get(opened, F.size(opened) - 1)
        mark, at = m["t"], m["at"]
        ends = (mark != LIST) & F.coalesce(top["level"] == level, F.lit(False))
        left = F.when(ends, F.slice(opened, 1, F.size(opened) - 1)).otherwise(opened)
        item = F.struct(at.alias("at"), level.alias("level"))
        return F.struct(
            F.when(mark == LIST, level + 1).when(mark == LIST_END, level - 1).otherwise(level).alias("level"),
            F.when(mark == ITEM, F.concat(left, F.array(item))).otherwise(left).alias("open"),
            # Written into a string: appending to an array would copy it at every item.
            F.when(ends, F.concat(acc["closed"], top["at"].cast("string"), F.lit(":"), at.cast("string"), F.lit(","))).otherwise(acc["closed"]).alias("closed"),
        )

    def of(pieces: Column) -> Column:
        marks = F.filter(
            F.transform(pieces, lambda t, i: F.struct(t.alias("t"), i.alias("at"))), lambda m: m["t"].isin(ITEM, ITEM_END, LIST, LIST_END)
        )

        def spans(acc: Column) -> Column:
            cuts = F.transform(
                F.array_remove(F.split(acc["closed"], ","), ""),
                lambda c: F.struct(F.substring_index(c, ":", 1).cast("int").alias("at"), F.substring_index(c, ":", -1).cast("int").alias("to")),
            )
            rest = F.transform(acc["open"], lambda o: F.struct(o["at"].alias("at"), F.size(pieces).alias("to")))
            return F.array_sort(F.concat(cuts, rest))

        def texts(bare: Column) -> Column:
            return F.transform(F.aggregate(marks, begin, read, spans), lambda c: F.array_join(F.slice(bare, c["at"] + 2, c["to"] - c["at"] - 1), ""))

        return let(F.transform(pieces, lambda t: F.when(t.isin(ITEM, ITEM_END, LIST, LIST_END), "").otherwise(strip(t))), texts)

    return let(F.split(marked, SEAM), of)


def _raw_value(name: str) -> Column:
    """Undecoded source of a field: an attribute, or its text pieces joined by seams."""
    tokens, start, end = F.col(TOKENS), F.col(STARTS)[name], F.col(ENDS)[name]
    tag = F.get(tokens, start)
    pieces = F.array_join(H.text_pieces(tokens, start, end), SEAM)
    if name in LINK_FIELDS:
        raw = H.attribute(tag, "href")
    elif name in IMAGE_FIELDS:
        raw = H.attribute(tag, "src")
    elif name in DATE_FIELDS:
        raw = F.coalesce(F.nullif(H.attribute(tag, "datetime"), F.lit("")), pieces)
    elif name in LIST_FIELDS:
        raw = F.when(_is_list(name), _marked_list(H.content_tokens(tokens, start, end))).otherwise(pieces)
    else:
        raw = pieces
    return F.when(start.isNotNull(), raw)


def _is_list(name: str) -> Column:
    return F.get(F.col(TOKENS), F.col(STARTS)[name]).rlike(r"(?i)^<[uo]l[\s/>]")


def _decoded_value(name: str, raw: Column) -> Column:
    if name in LINK_FIELDS + IMAGE_FIELDS + LIST_FIELDS:
        return decode_entities(raw)
    return join_seamed(raw)


def _final_value(name: str, text: Column, listed: Column, base_url: Column) -> Column:
    """``ul``/``ol``: the text of every ``li``; other list fields: split on commas, empties kept."""
    if name in LINK_FIELDS + IMAGE_FIELDS:
        return absolute_link(base_url, text)
    if name in DATE_FIELDS:
        return parse_extracted_date(text)
    if name in LIST_FIELDS:
        items = F.when(text.contains(LIST), _nested_items(text)).otherwise(_flat_items(text))
        parts = F.split(F.replace(text, F.lit(SEAM), F.lit("")), ",")
        return F.when(listed, items).otherwise(F.transform(parts, strip))
    return text


def extract_fields(
    pages: DataFrame,
    selectors: dict[str, str],
    html: str = "html",
    url: str = "url",
    problems: str | None = None,
    metadata: bool = False,
) -> DataFrame:
    """Add one column per selector field; with ``metadata`` the page metadata as well,
    read from the same tokens.

    Strings for text, link and image fields, a timestamp for date fields, an
    array for list fields; null when no selector matches. A selector that
    cannot be compiled nulls its own field only; with ``problems`` the reasons
    are added as an array column of that name.
    """
    starts, reasons = {}, []
    for name, text in selectors.items():
        starts[name], refused = H.first_match(F.col(TAGS), text)
        reasons += [f"Failed to extract {name}: {reason}" for reason in refused]
    out = _read_fields(with_tags(pages, html), starts, html, url, metadata)
    if problems is not None:
        out = out.withColumn(problems, F.array(*map(F.lit, reasons)).cast("array<string>"))
    return out


def compiled_set(text: Column) -> Column:
    """The steps, as data, of a selector set that is a JSON text; a batch of rows compiles each of its distinct sets once."""

    def run(texts: pa.Array) -> pa.Array:
        import json

        import pyarrow as pa

        found = texts.dictionary_encode()
        return pa.array([compiled(json.loads(t)) for t in found.dictionary.to_pylist()], kind).take(found.indices)

    kind = to_arrow_type(DataType.fromDDL(COMPILED))
    return F.arrow_udf(run, COMPILED)(text)


def extract_own_fields(
    pages: DataFrame,
    selectors: str,
    fields: Iterable[str],
    html: str = "html",
    url: str = "url",
    problems: str | None = None,
    metadata: bool = False,
) -> DataFrame:
    """``extract_fields`` with a selector set per row: the map column ``selectors``, field to comma list.

    Sets are data. They are compiled where their rows are, so that pages are not
    gathered by set (a few sets would be a few tasks), and the walk over a page's
    tags reads the steps from the row, so the plan is the same for one set and for
    millions. ``fields`` are the columns that come out; a field that a
    row's set does not name is null, other names in a set give no column but count
    among the problems. A null or empty map extracts nothing.
    """
    names = list(fields)
    texts = F.transform_values(F.col(selectors), lambda _, v: F.coalesce(v, F.lit("")))
    # The order of a set's entries does not matter; a sorted map has one spelling.
    spelled = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(texts))))
    tagged = with_tags(pages.withColumn("_compiled", compiled_set(spelled)), html)
    found = tagged.withColumn("_found", H.first_matches(F.col(TAGS), F.coalesce("_compiled", F.array().cast(COMPILED))))

    def position(name: str) -> Column:
        return F.get(F.filter("_found", lambda e: e["field"] == name), F.lit(0))["position"]

    starts = {n: position(n) for n in names}
    none = F.array().cast("array<string>")
    refused = F.coalesce(F.array_compact(F.transform("_compiled", lambda e: e["problem"])), none)
    if problems is not None:
        found = found.withColumn(problems, refused)
    return _read_fields(found.drop("_compiled"), starts, html, url, metadata)


def _read_fields(tagged: DataFrame, starts: dict[str, Column], html: str, url: str, metadata: bool) -> DataFrame:
    """Values of the elements that begin at ``starts``, read from the tokens; helper columns are dropped."""
    placed = tagged
    if starts:
        placed = tagged.withColumn(STARTS, F.struct(*[c.alias(n) for n, c in starts.items()]))
        ends = [H.element_end(F.col(TAGS), F.col(STARTS)[n], F.size(TOKENS)).alias(n) for n in starts]
        placed = placed.withColumn(ENDS, F.struct(*ends))
    described = _metadata_columns(html) if metadata else {}
    # Each stage is its own projection, so that no stage is evaluated twice.
    raw = placed.withColumns(
        {f"_raw_{n}": _raw_value(n) for n in starts}
        | {f"_listed_{n}": _is_list(n) for n in starts if n in LIST_FIELDS}
        | described
    ).drop(TOKENS, TAGS, STARTS, ENDS, "_found")
    title = {"page_title": decode_entities(F.col("page_title"))} if metadata else {}
    decoded = raw.withColumns({f"_raw_{n}": _decoded_value(n, F.col(f"_raw_{n}")) for n in starts} | title)
    final = {n: _final_value(n, F.col(f"_raw_{n}"), F.col(f"_listed_{n}"), F.col(url)) for n in starts}
    if metadata:
        final |= {"page_title": strip(squeeze(F.col("page_title")))} | {n: F.col(n) for n in ("links_found", "images_found")}
    out = computed_once(decoded, final) if final else decoded
    return out.drop(*[f"_raw_{n}" for n in starts], *[f"_listed_{n}" for n in starts])


def _metadata_columns(html: str) -> dict[str, Column]:
    return {
        "page_title": H.page_title(F.col(html)),
        "links_found": F.size(H.link_tags(F.col(TAGS))),
        "images_found": F.size(H.image_tags(F.col(TAGS))),
    }


def page_metadata(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add page title, number of links and number of images."""
    return extract_fields(pages, {}, html, metadata=True)


def links(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """One row per link: ``(key, url, pos, href, text)``, href resolved against the page.

    Links do not nest: a link's text ends at the next ``a`` tag of either kind.
    """
    tagged = with_tags(pages.select(key, url, html), html).select(
        key, url, TOKENS, F.filter(TAGS, lambda t: t["name"] == "a").alias("_anchors")
    )
    tokens, anchors = F.col(TOKENS), F.col("_anchors")

    def link(tag: Column, k: Column) -> Column:
        end = F.coalesce(F.get(anchors, k + 1)["i"], F.size(tokens))
        pieces = F.array_join(H.text_pieces(tokens, tag["i"], end), SEAM)
        return F.when(H.is_link(tag), F.struct(tag["raw"].alias("raw"), pieces.alias("text")))

    one = tagged.select(key, url, F.posexplode(F.array_compact(F.transform(anchors, link))).alias("pos", "link"))
    raw = one.select(key, url, "pos", H.attribute(F.col("link.raw"), "href").alias("href"), "link.text")
    decoded = raw.withColumns({"href": decode_entities(F.col("href")), "text": join_seamed(F.col("text"))})
    return decoded.withColumn("href", absolute_link(F.col(url), F.col("href")))
