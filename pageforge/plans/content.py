"""The four content-type jobs: extracted fields in, typed records out.

Each job is a chain of narrow projections. Text is cleaned in one projection
and measured in the next, so that every cleaned text is computed once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageforge import catalog
from pageforge.functions import dates, product as P, text as X
from pageforge.functions.base import blank_to_null
from pageforge.functions.entities import clean_text
from pageforge.functions.urls import domain_of, url_path

Job = Callable[[DataFrame, Iterable[str]], DataFrame]
# Key of the rows whose content type has no job.
UNSUPPORTED = "unsupported"


def _given(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _is(df: DataFrame, name: str, kind: type) -> bool:
    return name in df.columns and isinstance(df.schema[name].dataType, kind)


def _clean(df: DataFrame, *names: str) -> dict[str, Column]:
    return {n: clean_text(_given(df, n)) for n in names}


def _staged(df: DataFrame, keep: Iterable[str], columns: dict[str, Column]) -> DataFrame:
    """Projection of the kept columns plus ``columns`` (see ``computed_once``), kept names prefixed out of the way."""
    kept = [F.col(k).alias(f"_keep_{k}") for k in keep]
    cleaned = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")
    made = df.select(F.col("url").alias("_url"), *kept, cleaned)
    return made.select("_url", *[f"_keep_{k}" for k in keep], *[F.col("_once")[n].alias(n) for n in columns])


def _finished(df: DataFrame, keep: Iterable[str], spec: catalog.ContentType, columns: dict[str, Column]) -> DataFrame:
    kept = [F.col(f"_keep_{k}").alias(k) for k in keep]
    out = [columns.get(n, F.col(n)).cast(kind).alias(n) for n, kind in spec.columns.items()]
    return df.select(*kept, *out)


def _measures(content: Column) -> dict[str, Column]:
    words = X.clean_word_count(content)
    return {
        "word_count": words,
        "reading_time": F.when(content != "", X.reading_minutes(words)).otherwise(F.lit(0)),
    }


def blog(df: DataFrame, keep: Iterable[str] = ("url",)) -> DataFrame:
    if _is(df, "tags", T.ArrayType):
        tags = X.tag_list(F.col("tags"))
    else:
        tags = F.when(_given(df, "tags") != "", X.split_tags(_given(df, "tags")))
    published = _given(df, "published_date")
    if not _is(df, "published_date", T.TimestampType) and not _is(df, "published_date", T.TimestampNTZType):
        published = dates.parse_blog_date(published)
    first = _staged(
        df,
        keep,
        _clean(df, "title", "content", "author")
        | {
            "tags": tags,
            "published_date": published,
            "excerpt": blank_to_null(_given(df, "excerpt")),
            "featured_image": blank_to_null(_given(df, "featured_image")),
            "category": _given(df, "category"),
            "source_domain": domain_of(F.col("url")),
        },
    )
    content = F.col("content")
    second = first.withColumns(
        _measures(content) | {"excerpt": F.coalesce("excerpt", X.excerpt(content))}
    )
    return _finished(
        second,
        keep,
        catalog.BLOG,
        {
            "excerpt": F.when(F.col("excerpt").isNotNull(), clean_text(F.col("excerpt"))),
            "author": blank_to_null(F.col("author")),
            "category": X.blog_category(F.col("category"), F.col("tags"), F.col("source_domain")),
            "slug": X.slug(F.col("title")),
        },
    )


def prompt(df: DataFrame, keep: Iterable[str] = ("url",)) -> DataFrame:
    if _is(df, "tags", T.ArrayType):
        tags = X.tag_list(F.col("tags"))
    else:
        tags = F.when(_given(df, "tags") != "", X.split_tags(_given(df, "tags")))
    examples = _given(df, "examples")
    if not _is(df, "examples", T.ArrayType):
        examples = P.examples(examples)
    first = _staged(
        df,
        keep,
        _clean(df, "prompt_text", "category", "solution", "explanation")
        | {
            "difficulty": blank_to_null(_given(df, "difficulty")),
            "tags": tags,
            "examples": examples,
            "programming_language": blank_to_null(_given(df, "programming_language")),
            "time_limit": P.parse_strict_int(_given(df, "time_limit").cast("string")),
            "memory_limit": P.parse_strict_int(_given(df, "memory_limit").cast("string")),
            "_domain": domain_of(F.col("url")),
        },
    )
    text = F.col("prompt_text")
    return _finished(
        first,
        keep,
        catalog.PROMPT,
        {
            "category": F.coalesce(blank_to_null(F.col("category")), X.prompt_category(text, F.col("_domain"))),
            "difficulty": F.lower(F.coalesce("difficulty", X.difficulty(text))),
            "tags": F.coalesce(F.col("tags"), X.mined_tags(text)),
            "solution": blank_to_null(F.col("solution")),
            "explanation": blank_to_null(F.col("explanation")),
            "programming_language": F.coalesce("programming_language", X.code_language(text)),
        },
    )


def article(df: DataFrame, keep: Iterable[str] = ("url",)) -> DataFrame:
    first = _staged(
        df,
        keep,
        _clean(df, "title", "content")
        | {
            "summary": blank_to_null(_given(df, "summary")),
            "keywords": _given(df, "keywords", "array<string>"),
            "language": blank_to_null(_given(df, "language")),
            "topic": blank_to_null(_given(df, "topic")),
            "source_domain": domain_of(F.col("url")),
        },
    )
    title, content = F.col("title"), F.col("content")
    given_words = F.when(F.size("keywords") > 0, F.col("keywords"))
    second = first.withColumns(
        _measures(content)
        | {
            "summary": F.coalesce("summary", X.summary(content)),
            "keywords": F.coalesce(
                given_words, F.when(content != "", X.keywords(content, title)), F.col("keywords")
            ),
            "language": F.coalesce("language", X.language(content)),
            "topic": F.coalesce("topic", X.topic(content, title)),
        }
    )
    return _finished(
        second,
        keep,
        catalog.ARTICLE,
        {"summary": F.when(F.col("summary").isNotNull(), clean_text(F.col("summary")))},
    )


def product(df: DataFrame, keep: Iterable[str] = ("url",)) -> DataFrame:
    price = _given(df, "price")
    price_text = price.cast("string")
    numeric = isinstance(df.schema["price"].dataType, T.NumericType) if "price" in df.columns else False
    if _is(df, "images", T.ArrayType):
        images = P.image_list(F.col("url"), F.col("images"))
    else:
        images = P.single_image(_given(df, "images"))
    if _is(df, "specifications", T.MapType):
        specifications = P.specifications_from_map(F.col("specifications"))
    else:
        specifications = P.specifications_from_text(_given(df, "specifications"))
    first = _staged(
        df,
        keep,
        _clean(df, "name", "description", "brand", "category")
        | {
            "price": price.cast("double") if numeric else P.parse_price(price_text),
            "currency": P.currency_or_default(
                _given(df, "currency"), F.when(price != 0, price_text) if numeric else price_text
            ),
            "availability": P.availability(_given(df, "availability")),
            "rating": P.clamp_rating(_given(df, "rating").cast("string")),
            "review_count": P.parse_int_via_float(_given(df, "review_count").cast("string")),
            "sku": blank_to_null(_given(df, "sku")),
            "images": images,
            "specifications": specifications,
        },
    )
    category = F.coalesce(blank_to_null(F.col("category")), X.url_category(url_path(F.col("_url"))))
    return _finished(
        first,
        keep,
        catalog.PRODUCT,
        {
            "description": blank_to_null(F.col("description")),
            "brand": blank_to_null(F.col("brand")),
            "category": category,
        },
    )


_JOBS: dict[str, Job] = {"blog": blog, "prompt": prompt, "article": article, "product": product}


def register(spec: catalog.ContentType, job: Job) -> None:
    """Add a content type: its catalogue entry, which all of the library reads, and a DataFrame-to-DataFrame job."""
    catalog.CONTENT_TYPES[spec.name] = spec
    _JOBS[spec.name] = job


def unregister(name: str) -> None:
    catalog.CONTENT_TYPES.pop(name, None)
    _JOBS.pop(name, None)


@contextmanager
def registered(spec: catalog.ContentType, job: Job):
    """A content type for the plans built inside the ``with`` block."""
    register(spec, job)
    try:
        yield spec
    finally:
        unregister(spec.name)


def supported_types() -> list[str]:
    return list(_JOBS)


def type_of(name: str) -> catalog.ContentType:
    return catalog.content_type(name)


def process(df: DataFrame, content_type: str, keep: Iterable[str] = ("url",)) -> DataFrame:
    """Run the job of a content type over extracted fields."""
    type_of(content_type)
    return _JOBS[content_type](df, tuple(keep))


def process_mixed(df: DataFrame, keep: Iterable[str] = ("url",), type_column: str = "content_type") -> dict[str, DataFrame]:
    """One typed frame per content type, and the rows that have no job under ``UNSUPPORTED``: kept columns, type and reason.

    Store the input partitioned by type and each branch reads its own partition only.
    """
    known, kind = supported_types(), F.col(type_column)
    other = df.where(~F.coalesce(kind.isin(known), F.lit(False)))
    reason = unsupported_reason(kind).alias("reason")
    named = [c for c in keep if c != type_column]
    return {t: process(df.where(kind == t), t, keep) for t in known} | {UNSUPPORTED: other.select(*named, type_column, reason)}


def unsupported_reason(kind: Column) -> Column:
    return F.concat(F.lit("Unsupported content type: "), F.coalesce(kind, F.lit("null")))


# Columns of a record that its job computes; a selector for them is not read.
COMPUTED = ("word_count", "reading_time", "slug", "source_domain")


def fields_of(spec: catalog.ContentType) -> list[str]:
    """Names under which selectors can hand values to the job of a type."""
    return [n for n in dict.fromkeys([*spec.selectors, *spec.columns]) if n not in COMPUTED]
