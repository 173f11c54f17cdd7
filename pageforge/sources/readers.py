"""Readers: landed pages, request lists, nested prompt records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_SCHEMA = "page_id BIGINT, url STRING, html STRING"

PROMPT_RECORD_SCHEMA = (
    "id BIGINT, slug STRING, icon STRING, prompt_name STRING, page_name STRING, description STRING,"
    " premium BOOLEAN, new BOOLEAN,"
    " category STRUCT<id: BIGINT, name: STRING, slug: STRING, subscriptions_id: STRUCT<id: BIGINT,"
    " subscription_slug: STRING, memberstack_subscription_plan_id: STRING>>,"
    " sub_category STRUCT<id: BIGINT, name: STRING, slug: STRING>"
)


def read_pages(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Landed pages. ``text`` reads one page per file, the file name being its URL."""
    if format == "text":
        whole = spark.read.text(path, wholetext=True).withColumn("url", F.input_file_name())
        return whole.select(F.xxhash64("url").alias("page_id"), "url", F.col("value").alias("html"))
    return spark.read.format(format).schema(PAGE_SCHEMA).load(path)


def stream_pages(spark: SparkSession, path: str, format: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(format).schema(PAGE_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def requests_from_lists(
    lists: DataFrame, urls: str = "urls", content_type: str = "content_type", keep: tuple[str, ...] = ()
) -> DataFrame:
    """URL lists to one request per URL, list position kept."""
    return lists.select(*keep, F.posexplode(urls).alias("pos", "url"), F.col(content_type).alias("content_type"))


def resolve_types(requests: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with table, required fields and selectors of their type; and the rejected rest.

    Request selectors replace the defaults as a whole when they are not empty.
    """
    joined = requests.join(catalog, "content_type")
    if "selectors" in requests.columns:
        own = F.when(F.size("selectors") > 0, F.col("selectors"))
        joined = joined.withColumn("selectors", F.coalesce(own, F.col("default_selectors")))
    else:
        joined = joined.withColumn("selectors", F.col("default_selectors"))
    rejected = requests.join(catalog, "content_type", "left_anti").withColumn(
        "reason", F.concat(F.lit("Unsupported content type: "), F.coalesce("content_type", F.lit("null")))
    )
    return joined.drop("default_selectors"), rejected


def read_prompt_records(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return flatten_prompt_records(
        spark.read.schema(PROMPT_RECORD_SCHEMA).option("multiLine", multiline).json(path)
    )


def parse_prompt_records(df: DataFrame, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Prompt records held as JSON text; malformed text gives null fields."""
    parsed = df.select(*keep, F.from_json(text, PROMPT_RECORD_SCHEMA).alias("_r")).select(*keep, "_r.*")
    return flatten_prompt_records(parsed, keep)


def flatten_prompt_records(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return records.select(
        *keep, "id", "slug", "icon", "prompt_name", "page_name", "description", "premium", "new",
        F.col("category.id").alias("category_id"),
        F.col("category.name").alias("category_name"),
        F.col("category.slug").alias("category_slug"),
        F.col("category.subscriptions_id.id").alias("subscription_id"),
        F.col("category.subscriptions_id.subscription_slug").alias("subscription_slug"),
        F.col("category.subscriptions_id.memberstack_subscription_plan_id").alias("subscription_plan_id"),
        F.col("sub_category.id").alias("sub_category_id"),
        F.col("sub_category.name").alias("sub_category_name"),
        F.col("sub_category.slug").alias("sub_category_slug"),
    )
