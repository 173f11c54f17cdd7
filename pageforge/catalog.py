"""Content types: stored columns, required fields, default selectors and limits.

Everything here has a fixed, small size (four content types), so it is plain
driver-side configuration; ``catalog_frame`` exposes it as a DataFrame for joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class ContentType:
    name: str
    table: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    selectors: dict[str, str]
    not_null: tuple[str, ...]
    max_length: dict[str, int]
    unique: tuple[str, ...]
    columns: dict[str, str] = field(default_factory=dict)


EXAMPLE_TYPE = "struct<input:string,output:string,explanation:string>"

# The four content types with their selectors (list order is
# priority), required fields, column limits and unique keys.
BLOG = ContentType(
    name="blog",
    table="blogs",
    required=("title", "content", "url", "published_date"),
    optional=("author", "tags", "excerpt", "featured_image"),
    selectors={
        "title": "h1, .title, .post-title",
        "content": ".content, .post-content, article",
        "author": ".author, .by-author, .post-author",
        "published_date": ".date, .published, .post-date",
    },
    not_null=("url", "title", "content"),
    max_length={"url": 767, "title": 500, "author": 200, "featured_image": 767, "category": 100, "slug": 500},
    unique=("url", "slug"),
    columns={
        "title": "string",
        "content": "string",
        "excerpt": "string",
        "author": "string",
        "published_date": "timestamp_ntz",
        "tags": "array<string>",
        "featured_image": "string",
        "word_count": "int",
        "reading_time": "int",
        "category": "string",
        "slug": "string",
        "source_domain": "string",
    },
)

PROMPT = ContentType(
    name="prompt",
    table="prompts",
    required=("prompt_text", "url", "category"),
    optional=("difficulty", "tags", "examples"),
    selectors={
        "prompt_text": ".prompt, .question, .challenge",
        "category": ".category, .tag, .type",
        "difficulty": ".difficulty, .level",
    },
    not_null=("url", "prompt_text", "category"),
    max_length={"url": 767, "category": 100, "difficulty": 20, "programming_language": 50},
    unique=("url",),
    columns={
        "prompt_text": "string",
        "category": "string",
        "difficulty": "string",
        "tags": "array<string>",
        "examples": f"array<{EXAMPLE_TYPE}>",
        "solution": "string",
        "explanation": "string",
        "programming_language": "string",
        "time_limit": "bigint",
        "memory_limit": "bigint",
    },
)

ARTICLE = ContentType(
    name="article",
    table="articles",
    required=("title", "content", "url"),
    optional=("summary", "keywords", "reading_time"),
    selectors={
        "title": "h1, .article-title, .headline",
        "content": "article, .article-body, .content",
        "summary": ".summary, .excerpt, .abstract",
    },
    not_null=("url", "title", "content"),
    max_length={"url": 767, "title": 500, "language": 10, "topic": 100, "source_domain": 200},
    unique=("url",),
    columns={
        "title": "string",
        "content": "string",
        "summary": "string",
        "keywords": "array<string>",
        "word_count": "int",
        "reading_time": "int",
        "language": "string",
        "topic": "string",
        "source_domain": "string",
    },
)

PRODUCT = ContentType(
    name="product",
    table="products",
    required=("name", "price", "url"),
    optional=("description", "rating", "availability", "images"),
    selectors={
        "name": ".product-name, h1, .title",
        "price": ".price, .cost, .amount",
        "description": ".description, .product-desc",
        "rating": ".rating, .stars, .score",
    },
    not_null=("url", "name"),
    max_length={
        "url": 767, "name": 500, "currency": 3, "availability": 50,
        "brand": 200, "category": 100, "sku": 100,
    },
    unique=("url", "sku"),
    columns={
        "name": "string",
        "description": "string",
        "price": "double",
        "currency": "string",
        "availability": "string",
        "rating": "double",
        "review_count": "bigint",
        "brand": "string",
        "category": "string",
        "sku": "string",
        "images": "array<string>",
        "specifications": "map<string,string>",
    },
)

CONTENT_TYPES: dict[str, ContentType] = {t.name: t for t in (BLOG, PROMPT, ARTICLE, PRODUCT)}

# Enumerations and size limits of the request schemas.
JOB_STATUSES = ("pending", "running", "completed", "failed", "cancelled")
JOB_SCHEDULES = ("immediate", "scheduled")
MAX_BATCH_URLS = 100
MAX_JOB_URLS = 1000
MAX_CONCURRENT = 20
MAX_URL_LENGTH = 2048
MAX_CONTENT_LIMIT = 1000
MAX_JOBS_LIMIT = 100


def content_type(name: str) -> ContentType:
    if name not in CONTENT_TYPES:
        raise ValueError(f"Unsupported content type: {name}")
    return CONTENT_TYPES[name]


def catalog_frame(spark: SparkSession) -> DataFrame:
    """The catalogue as a table: one row per content type, registered ones included."""
    rows = [
        (t.name, t.table, list(t.required), list(t.optional), dict(t.selectors))
        for t in CONTENT_TYPES.values()
    ]
    return spark.createDataFrame(
        rows,
        "content_type string, table_name string, required_fields array<string>,"
        " optional_fields array<string>, default_selectors map<string,string>",
    )
