"""Product and prompt field parsers: prices, currencies, numbers, maps, images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageforge.functions.base import any_contains, count_of, strip
from pageforge.functions.entities import clean_list
from pageforge.functions.urls import absolute_image

# Currency marks in check order.
CURRENCY_SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}
CURRENCY_CODES = ["USD", "EUR", "GBP", "JPY", "CAD", "AUD", "CHF"]
DEFAULT_CURRENCY = "USD"

# Availability words in check order. "unavailable" can never be
# reached because "available" is tested first; that outcome is intended.
AVAILABILITY_WORDS = {
    "in_stock": ["in stock", "available", "ready"],
    "out_of_stock": ["out of stock", "unavailable", "sold out"],
    "pre_order": ["pre-order", "preorder", "coming soon"],
    "limited": ["limited", "few left", "last"],
}

_NUMBER = (
    r"(?i)^[+-]?(?:(?:[0-9](?:_?[0-9])*(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)"
    r"(?:e[+-]?[0-9](?:_?[0-9])*)?|inf(?:inity)?|nan)\z"
)
_INTEGER = r"^[+-]?[0-9](?:_?[0-9])*\z"


def parse_price(c: Column) -> Column:
    """Number in a price text; the last of mixed separators is the decimal one."""
    kept = F.regexp_replace(c, r"[^0-9.,]", "")
    dotless = F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    commaless = F.replace(kept, F.lit(","), F.lit(""))
    decimal_comma = F.replace(kept, F.lit(","), F.lit("."))
    turned = F.reverse(kept)
    comma_last = F.instr(turned, ",") < F.instr(turned, ".")
    short_tail = F.length(F.substring_index(kept, ",", -1)) <= 2
    number = (
        F.when(kept.contains(",") & kept.contains("."), F.when(comma_last, dotless).otherwise(commaless))
        .when((count_of(kept, ",") == 1) & short_tail, decimal_comma)
        .otherwise(commaless)
    )
    return number.try_cast("double")


def currency_of(price: Column) -> Column:
    text = F.upper(price)
    found = None
    for mark, code in [*CURRENCY_SYMBOLS.items(), *((c, c) for c in CURRENCY_CODES)]:
        found = F.when(text.contains(mark), code) if found is None else found.when(text.contains(mark), code)
    return found.otherwise(DEFAULT_CURRENCY)


def currency_or_default(currency: Column, price: Column) -> Column:
    return F.coalesce(F.nullif(currency, F.lit("")), F.when(price != "", currency_of(price)), F.lit(DEFAULT_CURRENCY))


def availability(c: Column) -> Column:
    lowered = F.lower(c)
    label = F.lit("unknown")
    for name, words in reversed(AVAILABILITY_WORDS.items()):
        label = F.when(any_contains(lowered, words), name).otherwise(label)
    return F.when(c != "", label)


def parse_float(c: Column) -> Column:
    text = strip(c)
    return F.when(text.rlike(_NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def clamp_rating(c: Column) -> Column:
    """Rating limited to 0..5; anything unparsable is null."""
    value = parse_float(c)
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(5.0), value)))


def parse_int_via_float(c: Column) -> Column:
    """Whole part of a number; NaN and infinities are null."""
    value = parse_float(c)
    return F.when(~F.isnan(value), value.try_cast("bigint"))


def parse_strict_int(c: Column) -> Column:
    """Integer text only; '12.5' is null."""
    text = strip(c)
    return F.when(text.rlike(_INTEGER), F.replace(text, F.lit("_"), F.lit("")).try_cast("bigint"))


def image_list(base: Column, images: Column) -> Column:
    """Array of image URLs: a leading slash is resolved, nulls are dropped; empty gives null."""
    kept = F.transform(F.array_compact(images), lambda i: absolute_image(base, i))
    return F.when(F.size(images) > 0, kept)


def single_image(image: Column) -> Column:
    """A single image text becomes a one-element list, unresolved."""
    return F.when(image != "", F.array(image))


def specifications_from_text(c: Column) -> Column:
    """``key: value`` lines to a map; lines without a colon are dropped, later keys win."""
    lines = F.filter(F.split(c, "\n"), lambda line: line.contains(":"))
    placed = F.transform(
        lines,
        lambda line, i: F.struct(
            strip(F.substring_index(line, ":", 1)).alias("k"),
            i.alias("i"),
            strip(F.substr(line, F.length(F.substring_index(line, ":", 1)) + 2)).alias("v"),
        ),
    )
    ordered = F.sort_array(placed)
    last = F.filter(
        F.arrays_zip(ordered.alias("e"), F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1))).alias("n")),
        lambda z: z["n"]["k"].isNull() | (z["n"]["k"] != z["e"]["k"]),
    )
    entries = F.transform(last, lambda z: F.struct(z["e"]["k"], z["e"]["v"]))
    return F.when(c != "", F.map_from_entries(entries))


def specifications_from_map(m: Column) -> Column:
    """Map form: values are cleaned, keys kept; an empty map gives null."""
    return F.when(
        F.size(m) > 0,
        F.map_from_arrays(
            F.map_keys(m), clean_list(F.transform(F.map_values(m), lambda v: F.coalesce(v, F.lit("None"))))
        ),
    )


def _variant_text(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    return F.when(kind == "BOOLEAN", F.initcap(text)).when(kind == "VOID", "None").otherwise(text)


def examples(c: Column) -> Column:
    """Examples to input/output/explanation triples.

    A JSON array gives one triple per element (objects by key, scalars as
    input); any other text is the input of a single triple, uncleaned.
    """
    parsed = F.when(c.rlike(r"^\s*\["), F.try_parse_json(c))
    items = F.try_variant_get(parsed, "$", "array<variant>")

    def part(item: Column, key: str) -> Column:
        value = F.try_variant_get(item, f"$.{key}", "variant")
        is_object = F.schema_of_variant(item).startswith("OBJECT")
        scalar = _variant_text(item) if key == "input" else F.lit("")
        return F.when(is_object, F.coalesce(_variant_text(value), F.lit(""))).otherwise(scalar)

    keys = ("input", "output", "explanation")

    def parts(key: str) -> Column:
        return clean_list(F.transform(items, lambda item: part(item, key)))

    cleaned = [parts(k) for k in keys]
    triples = F.transform(
        F.arrays_zip(*[col.alias(k) for col, k in zip(cleaned, keys)]),
        lambda z: F.struct(*[z[k].alias(k) for k in keys]),
    )
    single = F.array(F.struct(c.alias("input"), F.lit("").alias("output"), F.lit("").alias("explanation")))
    return F.when(items.isNotNull(), F.when(F.size(items) > 0, triples)).when(c != "", single)
