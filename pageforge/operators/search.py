"""Filtered retrieval: predicates, sorting, paging."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageforge import catalog
from pageforge.operators.keys import settle

# Operator names of the query schema.
OPERATORS = ("eq", "ne", "gt", "lt", "gte", "lte", "in", "not_in", "contains")
INVALID_JSON = "Invalid JSON in filters parameter"


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str
    value: Any

    def __post_init__(self):
        if self.operator not in OPERATORS:
            raise ValueError(f"Operator must be one of: {list(OPERATORS)}")


@dataclass(frozen=True)
class ContentQuery:
    content_type: str
    filters: tuple[Filter, ...] = field(default=())
    sort_by: str | None = None
    sort_order: str = "desc"
    limit: int = 50
    offset: int = 0

    def __post_init__(self):
        catalog.content_type(self.content_type)
        if self.sort_order not in ("asc", "desc"):
            raise ValueError("Sort order must be asc or desc")
        check_page(self.limit, self.offset)


def check_page(limit: int, offset: int, most: int = catalog.MAX_CONTENT_LIMIT) -> None:
    if not 1 <= limit <= most:
        raise ValueError(f"Limit must be between 1 and {most}")
    if offset < 0:
        raise ValueError("Offset must not be negative")


def equals(df: DataFrame, filters: dict[str, Any] | None) -> DataFrame:
    """AND of equalities; unknown fields are ignored, None means IS NULL."""
    for name, value in (filters or {}).items():
        if name in df.columns:
            df = df.where(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    return df


def parse_filters(text: str | None) -> dict[str, Any] | None:
    """Filter map of a JSON request parameter; malformed JSON is an error."""
    if not text:
        return None
    try:
        return json.loads(text)
    except json.JSONDecodeError as problem:
        raise ValueError(INVALID_JSON) from problem


def filter_problem(text: Column) -> Column:
    """Reason why a column of filter texts cannot be used, or null."""
    # The parser stops after the first value; inside brackets a tail cannot hide.
    whole = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    one = F.try_parse_json(text).isNotNull() & whole.isNotNull() & F.try_variant_get(whole, "$[1]", "variant").isNull()
    return F.when((text != "") & ~one, INVALID_JSON)


def predicate(df: DataFrame, f: Filter) -> Column:
    """Column test of one filter; nulls follow SQL. ``contains`` looks into arrays too."""
    column, value = F.col(f.field), f.value
    if f.operator == "in":
        return column.isin(list(value))
    if f.operator == "not_in":
        return ~column.isin(list(value))
    if f.operator == "contains":
        if isinstance(df.schema[f.field].dataType, T.ArrayType):
            return F.array_contains(column, F.lit(value))
        return column.contains(F.lit(value))
    comparisons = {
        "eq": column.__eq__, "ne": column.__ne__, "gt": column.__gt__,
        "lt": column.__lt__, "gte": column.__ge__, "lte": column.__le__,
    }
    return comparisons[f.operator](F.lit(value))


def matching(df: DataFrame, filters) -> DataFrame:
    for f in filters:
        if f.field in df.columns:
            df = df.where(predicate(df, f))
    return df


def matched_searches(df: DataFrame, searches: dict[str, str]) -> Column:
    """Names of the saved searches (name to JSON filter text) that a row satisfies."""
    tests = []
    for name, text in searches.items():
        test = F.lit(True)
        for f, value in (parse_filters(text) or {}).items():
            if f in df.columns:
                test = test & (F.col(f).isNull() if value is None else F.coalesce(F.col(f) == F.lit(value), F.lit(False)))
        tests.append(F.when(test, F.lit(name)))
    return F.array_compact(F.array(*tests))


def _test_key(name: str, kind: T.DataType, value: Column) -> Column:
    """One equality as a text: the field, and the value as the column's type writes it."""
    held = F.concat(F.lit(f"{name}\x1f="), value.try_cast(kind).cast("string"))
    return F.when(value.isNull(), F.lit(f"{name}\x1fnull")).otherwise(F.coalesce(held, F.lit(f"{name}\x1fnever")))


def saved_search_matches(df: DataFrame, searches: DataFrame, key: str, name: str = "name", filters: str = "filters") -> DataFrame:
    """(``key``, ``name``) of every row and every saved search that it satisfies, the searches being a table.

    A search is a name, which is unique, and a JSON text of equalities. Every
    equality becomes one text; a search meets the rows by an equi-join on the
    equality that the fewest rows satisfy, and holds when none of its others is
    missing from the row. Equalities are counted over all rows, combined before
    the shuffle, so that frequent values are joined only where a search has none
    rarer. Searches without a known field hold for every row and are dealt over
    salted keys. Both sides of every join grow with the tables, and their texts
    take many times the room of the files they are read from, by which Spark would
    choose a broadcast: the joins merge.

    Fields the frame lacks are ignored, null asks for a null, and values are compared
    in the type of the column: a value it cannot hold never matches. Array, map and
    struct columns count as unknown. Texts that are no JSON (see ``filter_problem``)
    or no JSON object take no part.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))}
    text = F.coalesce(F.col(filters), F.lit(""))
    asked = F.when(text == "", F.lit("{}")).otherwise(text)
    stated = searches.where(filter_problem(text).isNull()).select(F.col(name).alias("_search"), F.try_variant_get(F.try_parse_json(asked), "$", "map<string,string>").alias("_asked"))
    tests = [F.when(F.map_contains_key("_asked", F.lit(c)), _test_key(c, t, F.element_at("_asked", F.lit(c)))) for c, t in kinds.items()]
    stated = settle(stated.where("_asked IS NOT NULL").select("_search", F.array_compact(F.array(*tests)).alias("_tests")))
    single = stated.select("_search", "_tests", F.explode("_tests").alias("_test"))
    # At most one row per column of the frame.
    used = {r["c"] for r in single.select(F.substring_index("_test", "\x1f", 1).alias("c")).distinct().collect()}
    has = [F.when(F.col(c).isNull(), F.lit(f"{c}\x1fnull")).otherwise(F.concat(F.lit(f"{c}\x1f="), F.col(c).cast("string"))) for c in kinds if c in used]
    rows = df.select(F.col(key).alias("_row"), F.array(*has).cast("array<string>").alias("_has"))
    met = rows.select("_row", "_has", F.explode("_has").alias("_test"))
    merged = lambda frame: frame.hint("merge")
    # Counted before they meet the searches, so that a frequent value is one row.
    counts = met.groupBy("_test").agg(F.count("*").alias("_n"))
    rarest = single.join(merged(counts), "_test").groupBy("_search", "_tests").agg(F.min_by("_test", F.struct("_n", "_test")).alias("_test"))
    hits = met.join(merged(rarest), "_test").where(F.size(F.array_except("_tests", "_has")) == 0).select("_row", "_search")
    salts = 64
    always = stated.where(F.size("_tests") == 0).select("_search", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    every = rows.select("_row", F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int").alias("_salt")).join(merged(always), "_salt").select("_row", "_search")
    return hits.unionByName(every).select(F.col("_row").alias(key), F.col("_search").alias(name))


def ordered(df: DataFrame, sort_by: str | None, sort_order: str = "desc", tiebreak: str = "id") -> DataFrame:
    """Total order: the sort field (nulls last), then the tiebreak column."""
    if sort_order not in ("asc", "desc"):
        raise ValueError("Sort order must be asc or desc")
    if sort_by is None or sort_by not in df.columns:
        return df.orderBy(tiebreak)
    by = F.col(sort_by)
    return df.orderBy(by.asc_nulls_last() if sort_order == "asc" else by.desc_nulls_last(), F.col(tiebreak))


def page_of(df: DataFrame, limit: int, offset: int = 0, most: int = catalog.MAX_CONTENT_LIMIT) -> DataFrame:
    """One page of an ordered frame; planned as a top-k, never a full sort."""
    check_page(limit, offset, most)
    return df.offset(offset).limit(limit)


def after(df: DataFrame, cursor: dict[str, Any] | None, sort_by: str | None, sort_order: str = "desc", tiebreak: str = "id") -> DataFrame:
    """Rows that :func:`ordered` puts behind the cursor: the sort value and tiebreak of the last row seen (None: all rows).

    Rows before the cursor fail a plain comparison, which reaches the scan; they
    are neither sorted nor counted. Null sort values stand last, as in the order.
    The tiebreak must be unique and not null.
    """
    if sort_order not in ("asc", "desc"):
        raise ValueError("Sort order must be asc or desc")
    if cursor is None:
        return df
    later = F.col(tiebreak) > F.lit(cursor[tiebreak])
    if sort_by is None or sort_by not in df.columns or sort_by == tiebreak:
        down = sort_by == tiebreak and sort_order == "desc"
        return df.where(F.col(tiebreak) < F.lit(cursor[tiebreak]) if down else later)
    by, value = F.col(sort_by), cursor[sort_by]
    if value is None:
        return df.where(by.isNull() & later)
    nearer, further = (by >= F.lit(value), by > F.lit(value)) if sort_order == "asc" else (by <= F.lit(value), by < F.lit(value))
    return df.where(by.isNull() | (nearer & (further | later)))


def cursor_page(
    df: DataFrame, cursor: dict[str, Any] | None, sort_by: str | None, sort_order: str = "desc", limit: int = 100, tiebreak: str = "id"
) -> DataFrame:
    """The page behind a cursor: a top-k of the rows that are left, however deep the page lies."""
    return page_of(ordered(after(df, cursor, sort_by, sort_order, tiebreak), sort_by, sort_order, tiebreak), limit)


def next_cursor(page: DataFrame, sort_by: str | None, tiebreak: str = "id") -> dict[str, Any] | None:
    """Cursor behind the last row of a page, or None when the page is empty. Brings one page of two columns to the driver."""
    names = list(dict.fromkeys([c for c in (sort_by, tiebreak) if c in page.columns]))
    rows = page.select(*names).collect()
    return rows[-1].asDict() if rows else None


def run_query(df: DataFrame, query: ContentQuery, tiebreak: str = "id") -> DataFrame:
    found = matching(df, query.filters)
    return page_of(ordered(found, query.sort_by, query.sort_order, tiebreak), query.limit, query.offset)


def search(df: DataFrame, filters: dict[str, Any] | None = None, limit: int = 100, offset: int = 0, tiebreak: str = "id") -> DataFrame:
    return page_of(ordered(equals(df, filters), None, tiebreak=tiebreak), limit, offset)
