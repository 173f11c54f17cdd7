"""Record checks: required fields, constraints, lists, selectors, job requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageforge import catalog
from pageforge.functions.base import strip
from pageforge.functions.urls import selector_messages, url_entry_messages

STRINGS = "array<string>"


def _messages(*checks: Column) -> Column:
    return F.array_compact(F.array(*checks)).cast(STRINGS)


def required_field_errors(df: DataFrame, required) -> Column:
    """Messages for required fields that are missing, empty, zero or blank."""
    checks = []
    for name in required:
        missing = F.lit(f"Required field '{name}' is missing or empty")
        if name not in df.columns:
            checks.append(missing)
            continue
        value, kind = F.col(name), df.schema[name].dataType
        if isinstance(kind, T.StringType):
            checks.append(
                F.when(value.isNull() | (value == ""), missing).when(
                    strip(value) == "", F.lit(f"Required field '{name}' is empty")
                )
            )
        elif isinstance(kind, T.NumericType):
            checks.append(F.when(value.isNull() | (value == 0), missing))
        elif isinstance(kind, T.BooleanType):
            checks.append(F.when(value.isNull() | ~value, missing))
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            checks.append(F.when(value.isNull() | (F.size(value) == 0), missing))
        else:
            checks.append(F.when(value.isNull(), missing))
    return _messages(*checks)


def validation_failure(errors: Column) -> Column:
    return F.concat(F.lit("Content validation failed: "), F.array_join(errors, ", "))


def with_validation(df: DataFrame, required, validate: Column | bool = True) -> DataFrame:
    """Add ``validation_errors``, ``success`` and ``errors``.

    With validation on, a record with errors fails and says so; with it off the
    record succeeds and carries its validation errors.
    """
    gate = validate if isinstance(validate, Column) else F.lit(validate)
    checked = df.withColumn("validation_errors", required_field_errors(df, required))
    failed = gate & (F.size("validation_errors") > 0)
    return checked.withColumns(
        {
            "success": ~failed,
            "errors": F.when(failed, F.array(validation_failure(F.col("validation_errors"))))
            .otherwise(F.array().cast(STRINGS)),
        }
    )


def constraint_violations(df: DataFrame, spec: catalog.ContentType) -> Column:
    """NOT NULL and length violations of a stored row."""
    checks = [F.when(F.col(n).isNull(), F.lit(f"{n} is null")) for n in spec.not_null if n in df.columns]
    checks += [
        F.when(F.length(n) > limit, F.lit(f"{n} is longer than {limit}"))
        for n, limit in spec.max_length.items()
        if n in df.columns
    ]
    return _messages(*checks)


def split_by_constraints(df: DataFrame, spec: catalog.ContentType) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy every column constraint, and quarantined rows with their violations."""
    checked = df.withColumn("violations", constraint_violations(df, spec))
    bad = F.size("violations") > 0
    return checked.where(~bad).drop("violations"), checked.where(bad)


def url_list_errors(lists: DataFrame, list_id: str, urls: str, max_count: int = catalog.MAX_JOB_URLS) -> DataFrame:
    """Messages for lists of URLs: ``(list_id, pos, n, message)``.

    Position -1 holds list-level messages; ``n`` numbers the messages of one
    position. First positions are aggregated per URL and joined back on the
    unique (list, position), so a URL repeated without end gathers in no task.
    """
    size = F.size(F.coalesce(F.col(urls), F.array().cast(STRINGS)))
    whole = lists.select(
        list_id,
        F.lit(-1).alias("pos"),
        _messages(
            F.when(size == 0, "URL list cannot be empty"),
            F.when(
                size > max_count,
                F.concat(F.lit("Too many URLs: "), size.cast("string"), F.lit(f". Maximum allowed: {max_count}")),
            ),
        ).alias("messages"),
    )
    entries = lists.select(list_id, F.posexplode(urls).alias("pos", "url")).withColumn("_key", strip(F.col("url")))
    firsts = (
        entries.where(F.col("_key").rlike("^https?://")).groupBy(list_id, "_key").agg(F.min("pos").alias("pos"))
    ).select(list_id, "pos", F.lit(True).alias("_first"))
    placed = entries.join(firsts, [list_id, "pos"], "left")
    repeated = F.col("_first").isNull() & F.col("_key").rlike("^https?://")
    single = placed.select(
        list_id, "pos",
        url_entry_messages(F.col("url"), F.col("pos"), F.coalesce(repeated, F.lit(False))).alias("messages"),
    )
    return whole.unionByName(single).select(list_id, "pos", F.posexplode("messages").alias("n", "message"))


def selector_errors(sets: DataFrame, set_id: str, selectors: str) -> DataFrame:
    """Messages for maps of selectors: ``(set_id, field, n, message)``; an empty map has a null field."""
    empty = sets.where(F.coalesce(F.size(selectors), F.lit(0)) <= 0).select(
        set_id, F.lit(None).cast("string").alias("field"), F.lit(0).alias("n"),
        F.lit("Selectors must be a non-empty dictionary").alias("message"),
    )
    one = sets.select(set_id, F.explode(selectors).alias("field", "selector"))
    found = one.select(
        set_id, "field", F.posexplode(selector_messages(F.col("field"), F.col("selector"))).alias("n", "message")
    )
    return empty.unionByName(found)


def job_request_errors(name: Column, urls: Column, schedule: Column) -> Column:
    """Messages for a job request: name, number of URLs, schedule."""
    trimmed = strip(name)
    count = F.coalesce(F.size(urls), F.lit(0))
    return _messages(
        F.when(F.coalesce(trimmed, F.lit("")) == "", "Job name cannot be empty"),
        F.when(F.length(name) > 200, "Job name is longer than 200 characters"),
        F.when(count < 1, "At least 1 URL is required"),
        F.when(count > catalog.MAX_JOB_URLS, f"Maximum {catalog.MAX_JOB_URLS} URLs allowed per job"),
        F.when(
            F.coalesce(~schedule.isin(*catalog.JOB_SCHEDULES), F.lit(True)),
            "Schedule must be one of: " + ", ".join(catalog.JOB_SCHEDULES),
        ),
    )


def batch_request_errors(urls: Column, max_concurrent: Column) -> Column:
    """Messages for a batch request: number of URLs and requested concurrency."""
    count = F.coalesce(F.size(urls), F.lit(0))
    return _messages(
        F.when(count < 1, "At least 1 URL is required"),
        F.when(count > catalog.MAX_BATCH_URLS, f"Maximum {catalog.MAX_BATCH_URLS} URLs allowed per batch request"),
        F.when(
            ~max_concurrent.between(1, catalog.MAX_CONCURRENT),
            f"Concurrency must be between 1 and {catalog.MAX_CONCURRENT}",
        ),
    )
