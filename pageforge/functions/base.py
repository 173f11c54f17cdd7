"""Small Column helpers shared by the function modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# One character class for whitespace as Python understands it: Unicode white
# space plus the four ASCII separators.
WS = r"[\s\x1c-\x1f]"
# Whitespace runs other than a single space, the only ones squeezing changes.
_UNEVEN_RUN = rf"(?U)(?:[^\S ]|[\x1c-\x1f]| (?={WS})){WS}*+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a binding inside an expression)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that filters above do not compute again.

    The optimizer moves a filter below a projection by repeating what it reads.
    A one-element generator lets filters on the other columns through, down to
    the scan, and keeps those on its own columns above.
    """
    kept = [c for c in df.columns if c not in columns]
    made = df.select(*kept, F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once"))
    return made.select(*kept, *[F.col("_once")[n].alias(n) for n in columns])


def squeeze(c: Column) -> Column:
    """Whitespace runs become one space."""
    return F.regexp_replace(c, _UNEVEN_RUN, " ")


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace, Unicode spaces included."""
    return F.regexp_replace(c, rf"(?U)^{WS}+|{WS}+\z", "")


def squeezed_strip(c: Column) -> Column:
    return F.trim(squeeze(c))


def blank_to_null(c: Column) -> Column:
    """Empty strings (and nulls) become null; whitespace is kept."""
    return F.when(c != "", c)


def count_of(c: Column, needle: str) -> Column:
    """Occurrences of a one-character needle."""
    return F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))


def any_contains(c: Column, needles) -> Column:
    """True when any of the literal needles occurs in ``c``."""
    found = F.lit(False)
    for needle in needles:
        found = found | c.contains(needle)
    return found


def hits(c: Column, needles) -> Column:
    """How many of the needles occur in ``c`` (each counted once per listing).

    ``c`` is read once per needle: pass a column or a bound value, not a computation.
    """
    listed = F.expr("array(" + ", ".join(f"'{n}'" for n in needles) + ")")
    return F.size(F.filter(listed, lambda needle: F.contains(c, needle)))
