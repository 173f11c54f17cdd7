"""Date parsing: two format lists, tried in order.

A cheap shape test guards every parser call, so a string only reaches the
formats it could match and misses do not cost exceptions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageforge.functions.base import squeezed_strip

_TIME = r"\d{1,2}:\d{1,2}:\d{1,2}"
_DAY = r"\d{4}-\d{1,2}-\d{1,2}"

_ISO_Z = (rf"(?i)^{_DAY}T{_TIME}Z\z", "yyyy-M-d'T'H:m:s'Z'")
_ISO = (rf"(?i)^{_DAY}T{_TIME}\z", "yyyy-M-d'T'H:m:s")
_SPACED = (rf"^{_DAY} {_TIME}\z", "yyyy-M-d H:m:s")
_DATE = (rf"^{_DAY}\z", "yyyy-M-d")
_DAY_MONTH = (r"^\d{1,2}/\d{1,2}/\d{4}\z", "d/M/yyyy")
_MONTH_DAY = (r"^\d{1,2}/\d{1,2}/\d{4}\z", "M/d/yyyy")
_NAME_DAY = (r"^\p{L}+ \d{1,2}, \d{4}\z", "MMMM d, yyyy")
_DAY_NAME = (r"^\d{1,2} \p{L}+ \d{4}\z", "d MMMM yyyy")
_FRACTION = (rf"(?i)^{_DAY}T{_TIME}\.\d{{1,6}}Z\z", "yyyy-M-d'T'H:m:s.SSSSSS'Z'")

# Format order of page extraction (day first) and of blog fields (month first).
EXTRACTION_FORMATS = (
    _ISO_Z, _ISO, _SPACED, _DATE, _DAY_MONTH, _MONTH_DAY, _NAME_DAY, _DAY_NAME, _FRACTION,
)
BLOG_FORMATS = (_ISO_Z, _ISO, _DATE, _NAME_DAY, _DAY_NAME, _MONTH_DAY, _DAY_MONTH)


def _padded_fraction(c: Column) -> Column:
    """Fractions have 1 to 6 digits; pad them to 6 for the parser."""
    digits = F.regexp_extract(c, r"\.(\d+)[Zz]\z", 1)
    return F.concat(F.substring_index(c, ".", 1), F.lit("."), F.rpad(digits, 6, "0"), F.lit("Z"))


def _parse(c: Column, formats) -> Column:
    text = squeezed_strip(c)
    attempts = []
    for shape, pattern in formats:
        source = _padded_fraction(text) if pattern.endswith("SSSSSS'Z'") else F.upper(text)
        if "MMMM" in pattern:
            source = F.initcap(text)
        attempts.append(F.when(text.rlike(shape), F.try_to_timestamp(source, F.lit(pattern))))
    return F.coalesce(*attempts).cast("timestamp_ntz")


def parse_extracted_date(c: Column) -> Column:
    return _parse(c, EXTRACTION_FORMATS)


def parse_blog_date(c: Column) -> Column:
    return _parse(c, BLOG_FORMATS)
