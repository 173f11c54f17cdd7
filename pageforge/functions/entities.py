"""Entity decoding and text cleaning, on the JVM.

All named and numeric references are decoded as the HTML standard says (and
Python's ``html.unescape`` does). Common ones are plain replacements; texts that
hold any other are cut at their ampersands, and each piece is looked up in one
map literal that comes from the standard library's table.
"""

from __future__ import annotations

import html.entities
import json
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageforge.functions.base import let, squeeze

# A noncharacter that no page text holds; it marks the seams between text pieces.
SEAM = "\ufdd0"

# Entities decoded by replacement; "amp" comes last so that one pass
# over the text decodes one level only.
FAST_ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "#34": '"', "nbsp": "\xa0",
    "copy": "©", "reg": "®", "middot": "·", "ndash": "–", "mdash": "—",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "hellip": "…",
    "amp": "&",
}
_SLOW = r"&(?!(?:" + "|".join(FAST_ENTITIES) + r");)[#A-Za-z]"

# What a reference may be: decimal, hexadecimal, or a name with or without its semicolon.
_REFERENCE = rf"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;{SEAM}]{{1,32}};?)"
# Names that older pages may write without a semicolon, even with letters behind them; the longest is meant.
_BARE = "^(" + "|".join(sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"

# The control characters that cleaning removes.
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x84\x86-\x9f]"


@cache
def _table(kind: str) -> str:
    """JSON of a decoding table: names, or the code points that stand for others."""
    if kind == "names":
        return json.dumps(html.entities.html5)
    # References to the control characters of Latin-1 mean those of Windows; some ends of line and nulls are replaced.
    windows = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
    return json.dumps({0x00: "\ufffd", 0x0D: "\r"} | windows)


def _looked_up(kind: str, key: Column) -> Column:
    """Entry of a table; the text is parsed once, when the plan is made."""
    return F.try_element_at(F.from_json(F.lit(_table(kind)), "map<string,string>"), key)


def _character(digits: Column, base: int) -> Column:
    """The character of a numeric reference; '' for code points that are none."""

    def of(code: Column) -> Column:
        low = code.bitwiseAND(0xFFFF)
        none = code.between(0x1, 0x8) | code.between(0xE, 0x1F) | code.between(0x7F, 0x9F) | code.between(0xFDD0, 0xFDEF) | (code == 0xB) | low.isin(0xFFFE, 0xFFFF)
        plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return (
            F.when(code.isNull() | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "\ufffd")
            .otherwise(F.coalesce(_looked_up("codes", code.cast("string")), F.when(none, "").otherwise(plain)))
        )

    # More digits than any code point has are beyond the last one.
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    return let(F.when(F.length(short) <= 7, F.conv(short, base, 10).try_cast("bigint")), of)


def _reference(rest: Column) -> Column:
    """What follows an ampersand, with the reference it begins decoded."""

    def of(found: Column) -> Column:
        body = F.rtrim(found, F.lit(";"))
        bare = F.regexp_extract(found, _BARE, 1)
        named = F.coalesce(
            _looked_up("names", found),
            F.when(bare != "", F.concat(_looked_up("names", bare), F.substr(found, F.length(bare) + 1))),
            F.concat(F.lit("&"), found),
        )
        value = (
            F.when(found == "", F.lit("&"))
            .when(found.rlike("^#[xX]"), _character(F.substr(body, F.lit(3)), 16))
            .when(found.startswith("#"), _character(F.substr(body, F.lit(2)), 10))
            .otherwise(named)
        )
        return F.concat(value, F.substr(rest, F.length(found) + 1))

    return let(F.regexp_extract(rest, _REFERENCE, 1), of)


def decode_all(c: Column) -> Column:
    """One level of all references, however they are written."""
    decoded = lambda parts: F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), _reference), ""))
    return let(F.split(c, "&"), decoded)


def has_rare_entity(c: Column) -> Column:
    return c.contains("&") & c.rlike(_SLOW)


def decode_common(c: Column) -> Column:
    decoded = c
    for name, char in FAST_ENTITIES.items():
        decoded = F.replace(decoded, F.lit(f"&{name};"), F.lit(char))
    return F.when(c.contains("&"), decoded).otherwise(c)


def decode_entities(c: Column) -> Column:
    """One level of entity decoding."""
    return F.when(has_rare_entity(c), decode_all(c)).otherwise(decode_common(c))


def _strip_seams(c: Column) -> Column:
    """Squeeze whitespace and drop it around seams and at both ends."""
    squeezed = squeeze(c)
    no_left = F.replace(squeezed, F.lit(" " + SEAM), F.lit(SEAM))
    no_right = F.replace(no_left, F.lit(SEAM + " "), F.lit(SEAM))
    return F.trim(no_right)


def clean_text(c: Column) -> Column:
    """Decode entities, squeeze whitespace, strip, drop control characters; null gives ''."""
    return F.coalesce(F.regexp_replace(F.trim(squeeze(decode_entities(c))), CONTROL_CHARS, ""), F.lit(""))


def clean_list(items: Column) -> Column:
    """``clean_text`` over the non-null elements of a string array."""
    cleaned = F.regexp_replace(_strip_seams(decode_entities(F.array_join(items, SEAM))), CONTROL_CHARS, "")
    return F.when(F.size(F.array_compact(items)) == 0, F.slice(items, 1, 0)).otherwise(F.split(cleaned, SEAM))


def join_seamed(joined: Column) -> Column:
    """Text of an element from its seam-joined pieces: decode and strip each, join bare, squeeze."""
    return F.replace(_strip_seams(decode_entities(joined)), F.lit(SEAM), F.lit(""))
