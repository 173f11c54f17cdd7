"""Field extraction from HTML with CSS selectors, inside the row and on the JVM.

A page becomes an array of tokens (one regex pass); tags become a second, much
smaller array. One walk over the tags keeps the path of open elements as a short
string and notes every tag's depth; what selectors match and where elements end
is read from the depths. Selectors are compiled on the driver into Column tests,
or are values of the row (selector sets as data). The text of an element is a
slice of the token array. There is no shuffle and no Python on the path.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageforge.functions.base import let
from pageforge.functions.selectors import ATTR_VALUE, Step, parse_list, presence_re, value_re

_TAG_REST = rf"(?:=\s*+{ATTR_VALUE}|[^>=]++|=)*+>?"

# Token kinds, in this order: comment, whole script, whole style, declaration,
# tag, text run (a '<' that opens no tag is text), anything left over.
TOKEN_RE = (
    r"(?is)<!--.*?(?:-->|\z)"
    rf"|<script\b{_TAG_REST}.*?(?:</script\s*+>|\z)"
    rf"|<style\b{_TAG_REST}.*?(?:</style\s*+>|\z)"
    r"|<[!?][^>]*+>?"
    rf"|</?[a-z]{_TAG_REST}"
    r"|(?:[^<]++|<(?![a-z/!?]))++"
    r"|<[^>]*+>?"
)

_TAG_START = r"^</?[A-Za-z]"
_MARKUP_START = r"^<[A-Za-z/!?]"

# Elements without content, and element families of HTML.
VOID_ELEMENTS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
    "source", "track", "wbr",
)
RAW_ELEMENTS = ("script", "style")
BLOCK_ELEMENTS = (
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr",
    "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
)
INLINE_ELEMENTS = (
    "a", "abbr", "b", "big", "cite", "code", "em", "font", "i", "kbd", "label", "mark", "q", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
)

# Implied end tags: an opening tag of the first group ends an open element of
# the second, unless an element of the third lies between.
IMPLIED_ENDS = (
    (BLOCK_ELEMENTS, "p", "table|td|th|caption|button|object"),
    (("li",), "li", "ul|ol|menu"),
    (("dt", "dd"), "dt|dd", "dl"),
    (("td", "th"), "td|th", "table"),
    (("tr",), "tr", "table"),
    (("tbody", "thead", "tfoot"), "tbody|thead|tfoot", "table"),
    (("option", "optgroup"), "option", "select"),
)
_CELL_WALL = r"(?:^|/)(?:td|th|table)/"
_BLOCK_WALL = r"(?:^|/)(?:td|th|table|" + "|".join(b for b in BLOCK_ELEMENTS if b != "p") + r")/"
_TABLE_PARTS = ("table", "thead", "tbody", "tfoot", "tr", "td", "th")


# ---------------------------------------------------------------- tokens

def tokens_of(html: Column) -> Column:
    """All tokens of a page, in order; a null page gives an empty array."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TOKEN_RE), F.lit(0))


def is_text(token: Column) -> Column:
    return ~token.rlike(_MARKUP_START)


def tags_of(tokens: Column) -> Column:
    """Tags only: position ``i`` (0-based, in tokens), name, kind (open, close, void), raw text, and ``depth``.

    The depth is the number of elements that stay open when the tag has closed what it closes.
    """

    named = F.array_compact(
        F.transform(
            tokens,
            lambda t, i: F.when(
                t.rlike(_TAG_START),
                F.struct(
                    i.alias("i"), F.lower(F.regexp_extract(t, r"^</?([A-Za-z][^\s/>]*)", 1)).alias("name"), t.alias("raw")
                ),
            ),
        )
    )

    def with_kind(tag: Column) -> Column:
        empty = tag["name"].isin(*VOID_ELEMENTS, *RAW_ELEMENTS) | tag["raw"].endswith("/>")
        kind = F.when(tag["raw"].startswith("</"), "close").when(empty, "void").otherwise("open")
        return F.struct(tag["i"].alias("i"), tag["name"].alias("name"), kind.alias("kind"), tag["raw"].alias("raw"))

    def with_depth(tags: Column) -> Column:
        def one(depths: Column) -> Column:
            return F.transform(tags, lambda t, k: F.struct(*[t[n].alias(n) for n in ("i", "name", "kind", "raw")], F.get(depths, k).alias("depth")))

        return let(_depths(tags), one)

    return let(F.transform(named, with_kind), with_depth)


def attribute(raw: Column, name: str) -> Column:
    """Value of the first such attribute of a tag; empty when absent. Entities stay encoded."""
    return _unquoted(F.regexp_extract(raw, value_re(name), 1))


def _unquoted(value: Column) -> Column:
    return F.regexp_replace(value, r"""(?s)^(["'])(.*)\1\z""", "$2")


# ------------------------------------------------------------- selectors

def _test(raw: Column, name: str, op: str, wanted: str) -> Column:
    if op == "":
        return raw.rlike(presence_re(name))
    value = attribute(raw, name)
    if op == "=":
        return value == wanted
    if op == "~=":
        return raw.contains(wanted) & value.rlike(rf"(?:^|\s){re.escape(wanted)}(?:\s|$)")
    if op == "^=":
        return value.startswith(wanted) if wanted else F.lit(False)
    if op == "$=":
        return value.endswith(wanted) if wanted else F.lit(False)
    if op == "*=":
        return value.contains(wanted) if wanted else F.lit(False)
    return (value == wanted) | value.startswith(wanted + "-")


def _matches(tag: Column, step: Step) -> Column:
    test = tag["kind"] != "close"
    if step.tag:
        test = test & (tag["name"] == step.tag)
    for name, op, wanted in step.tests:
        test = test & _test(tag["raw"], name, op, wanted)
    return test


# ------------------------------------------------------ path of open elements

def _after_implied_ends(path: Column, name: Column) -> Column:
    ended = None
    for openers, targets, wall in IMPLIED_ENDS:
        pattern = rf"^(.*/)(?:{targets})/(?!(?:.*/)?(?:{wall})/).*$"
        cut = F.regexp_replace(path, pattern, "$1")
        test = name.isin(*openers)
        ended = F.when(test, cut) if ended is None else ended.when(test, cut)
    return ended.otherwise(path)


def _after_end_tag(path: Column, name: Column) -> Column:
    """Path after an end tag: back to the matching open element, if one is reachable."""
    mark = F.concat(F.lit("/"), name, F.lit("/"))
    inner = F.call_function("substring_index", path, mark, F.lit(-1))
    popped = F.left(path, F.length(path) - F.length(inner) - F.length(name) - 1)
    walled = (
        F.when(name.isin(*INLINE_ELEMENTS), inner.rlike(_BLOCK_WALL))
        .when(name.isin(*_TABLE_PARTS), F.concat(F.lit("/"), inner).contains("/table/"))
        .otherwise(inner.rlike(_CELL_WALL))
    )
    return F.when((inner == path) | ((inner != "") & walled), path).otherwise(popped)


def _base_path(path: Column, tag: Column) -> Column:
    """Open elements after everything the tag closes, before anything it opens."""
    return F.when(tag["kind"] == "close", _after_end_tag(path, tag["name"])).otherwise(
        _after_implied_ends(path, tag["name"])
    )


def _with_opened(base: Column, tag: Column) -> Column:
    return F.when(tag["kind"] == "open", F.concat(base, tag["name"], F.lit("/"))).otherwise(base)


def _depths(tags: Column) -> Column:
    """The one walk over the tags that keeps the path of open elements: the depth below which each tag stands."""
    start = F.struct(F.lit("/").alias("path"), F.lit("").alias("depths"))

    def walk(acc: Column, tag: Column) -> Column:
        def with_base(base: Column) -> Column:
            depth = F.length(base) - F.length(F.replace(base, F.lit("/"), F.lit(""))) - 1
            # Written into a string: appending to an array would copy it at every tag.
            return F.struct(_with_opened(base, tag).alias("path"), F.concat(acc["depths"], depth.cast("string"), F.lit(",")).alias("depths"))

        return let(_base_path(acc["path"], tag), with_base)

    return F.aggregate(tags, start, walk, lambda acc: F.split(acc["depths"], ",").try_cast("array<int>"))


def _first_simple(tags: Column, step: Step) -> Column:
    return F.get(F.filter(tags, lambda t: _matches(t, step)), F.lit(0))["i"]


def _first_combined(tags: Column, steps: tuple[Step, ...]) -> Column:
    """First element matched by a chain of compounds.

    Every open element carries two small masks, as two characters of a string
    as deep as the path: prefixes of the chain it matches itself, and prefixes
    matched by it or any ancestor.
    """
    a = ord("A")
    start = F.struct(F.lit("").alias("marks"), F.lit(None).cast("int").alias("hit"))

    def walk(acc: Column, tag: Column) -> Column:
        depth = tag["depth"]

        def with_marks(marks: Column) -> Column:
            own_top = F.when(depth > 0, F.ascii(F.substring(marks, -2, 1)) - a).otherwise(F.lit(0))
            all_top = F.when(depth > 0, F.ascii(F.substring(marks, -1, 1)) - a).otherwise(F.lit(0))
            own = F.lit(0)
            hit = F.lit(False)
            for k, step in enumerate(steps):
                reach = F.lit(True)
                if k:
                    above = own_top if step.combinator == ">" else all_top
                    reach = above.bitwiseAND(1 << (k - 1)) > 0
                matched = reach & _matches(tag, step)
                if k == len(steps) - 1:
                    hit = matched
                else:
                    own = own + F.when(matched, 1 << k).otherwise(0)
            pushed = F.concat(marks, F.char(own + a), F.char(own.bitwiseOR(all_top) + a))
            return F.struct(
                F.when(tag["kind"] == "open", pushed).otherwise(marks).alias("marks"),
                F.coalesce(acc["hit"], F.when(hit, tag["i"])).alias("hit"),
            )

        # Once the element is found the walk stops doing work.
        return F.when(acc["hit"].isNotNull(), acc).otherwise(let(F.left(acc["marks"], depth * 2), with_marks))

    return F.aggregate(tags, start, walk, lambda acc: acc["hit"])


def first_match(tags: Column, selectors: str) -> tuple[Column, list[str]]:
    """Token position of the first element of the first selector that matches.

    ``selectors`` is a comma list in priority order. Returns the position
    (null when nothing matches) and the reasons for selectors left out.
    """
    chains, problem = parse_list(selectors)
    found = [_first_simple(tags, steps[0]) if len(steps) == 1 else _first_combined(tags, steps) for steps in chains]
    return (F.coalesce(*found) if found else F.lit(None).cast("int")), [problem] if problem else []


# ------------------------------------------------------ selectors as data

def _matches_data(tag: Column, step: Column) -> Column:
    """``_matches`` for a step that is a value of the row."""

    def test(t: Column) -> Column:
        # Most tags fail here, before a pattern is compiled and run.
        plain = (t["wanted"] == "") | tag["raw"].contains(t["wanted"])

        def holds(value: Column) -> Column:
            op, wanted = t["op"], t["wanted"]
            full = wanted != ""
            return (
                F.when(op == "=", value == wanted)
                .when(op == "~=", F.array_contains(F.split(value, r"\s"), wanted))
                .when(op == "^=", full & value.startswith(wanted))
                .when(op == "$=", full & value.endswith(wanted))
                .when(op == "*=", full & value.contains(wanted))
                .otherwise((value == wanted) | value.startswith(F.concat(wanted, F.lit("-"))))
            )

        value = _unquoted(F.call_function("regexp_extract", tag["raw"], t["pattern"], F.lit(1)))
        return F.when(t["op"] == "", F.rlike(tag["raw"], t["pattern"])).when(plain, let(value, holds)).otherwise(F.lit(False))

    named = (step["tag"] == "") | (tag["name"] == step["tag"])
    return F.when((tag["kind"] != "close") & named, F.forall(step["tests"], test)).otherwise(F.lit(False))


def _first_of_chain(tags: Column, steps: Column) -> Column:
    """``_first_combined`` for a chain that is a value of the row; masks are numbers, an array as deep as the path."""
    none = F.array().cast("array<long>")
    start = F.struct(none.alias("own"), none.alias("all"), F.lit(None).cast("int").alias("hit"))
    last = F.size(steps) - 1

    def walk(acc: Column, tag: Column) -> Column:
        depth = tag["depth"]

        def with_tops(tops: Column) -> Column:
            def matched(step: Column, k: Column) -> Column:
                above = F.when(step["combinator"] == ">", tops["own"]).otherwise(tops["all"])
                reach = (k == 0) | (F.call_function("shiftright", above, k - 1).bitwiseAND(1) > 0)
                return F.when(reach, _matches_data(tag, step)).otherwise(F.lit(False))

            def moved(bits: Column) -> Column:
                one = F.transform(bits, lambda b, k: F.when(b, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
                mask = F.aggregate(one, F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))
                opened = tag["kind"] == "open"
                pushed = lambda n, v: F.when(opened, F.concat(F.slice(acc[n], 1, depth), F.array(v))).otherwise(F.slice(acc[n], 1, depth)).alias(n)
                return F.struct(pushed("own", mask), pushed("all", mask.bitwiseOR(tops["all"])), F.when(F.get(bits, last), tag["i"]).alias("hit"))

            return let(F.transform(steps, matched), moved)

        top = lambda n: F.coalesce(F.get(acc[n], depth - 1), F.lit(0).cast("long")).alias(n)
        return F.when(acc["hit"].isNotNull(), acc).otherwise(let(F.struct(top("own"), top("all")), with_tops))

    return F.aggregate(tags, start, walk, lambda acc: acc["hit"])


def first_matches(tags: Column, compiled: Column) -> Column:
    """(field, position) of every field of a selector set that is a value of the row (see ``selectors.COMPILED``)."""

    def of(choice: Column) -> Column:
        simple = let(F.get(choice, F.lit(0)), lambda step: F.get(F.filter(tags, lambda t: _matches_data(t, step)), F.lit(0))["i"])
        return F.when(F.size(choice) == 1, simple).otherwise(_first_of_chain(tags, choice))

    def first(entry: Column) -> Column:
        position = F.aggregate(entry["choices"], F.lit(None).cast("int"), lambda found, choice: F.coalesce(found, of(choice)))
        return F.struct(entry["field"].alias("field"), position.alias("position"))

    return F.transform(compiled, first)


def element_end(tags: Column, start: Column, token_count: Column) -> Column:
    """Token position where the element that begins at ``start`` ends; null without one.

    It ends at the first later tag that does not stand below it, or at the end of the page. A void element has no content.
    """

    def ended(own: Column) -> Column:
        after = F.get(F.filter(tags, lambda t: (t["i"] > start) & (t["depth"] <= own["depth"])), F.lit(0))
        return F.when(own["kind"] != "open", start).otherwise(F.coalesce(after["i"], token_count))

    return F.when(start.isNotNull(), let(F.get(F.filter(tags, lambda t: t["i"] == start), F.lit(0)), ended))


def content_tokens(tokens: Column, start: Column, end: Column) -> Column:
    """Tokens strictly inside an element."""
    return F.slice(tokens, start + 2, F.greatest(end - start - 1, F.lit(0)))


def text_pieces(tokens: Column, start: Column, end: Column) -> Column:
    """Text runs inside an element; scripts, styles and comments are left out."""
    return F.filter(content_tokens(tokens, start, end), is_text)


# ---------------------------------------------------------- page metadata

def page_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title\b[^>]*+>(.*?)</title\s*+>", 1)


def is_link(tag: Column) -> Column:
    return (tag["name"] == "a") & (tag["kind"] != "close") & _test(tag["raw"], "href", "", "")


def link_tags(tags: Column) -> Column:
    return F.filter(tags, is_link)


def image_tags(tags: Column) -> Column:
    return F.filter(tags, lambda t: (t["name"] == "img") & (t["kind"] != "close"))
