"""From requests and landed pages to results and stored rows, as one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageforge.functions.urls import url_reject_reason
from pageforge.operators.extract import extract_fields, extract_own_fields
from pageforge.operators.keys import content_id, keep_first, settle, union_all
from pageforge.operators.quality import required_field_errors, validation_failure
from pageforge.operators.robots import check_robots
from pageforge.plans.content import UNSUPPORTED, fields_of, process, supported_types, type_of, unsupported_reason
from pageforge.sources.sinks import meta_envelope, raw_envelope

# Flags of a request and their defaults.
FLAGS = {"validate_content": True, "store_raw_data": True, "store_in_db": True}
# What extraction hands on of a request, and of its page besides the fields.
KEPT = (
    "request_id", "job_id", "metadata", "processing_time", "refused", "has_page",
    "validate_content", "store_raw_data", "store_in_db", "status_code", "response_headers", "crawled_at",
)
META = ("page_title", "links_found", "images_found")
RESULT_COLUMNS = (
    "request_id", "url", "content_type", "success", "errors", "validation_errors", "content_id",
    "processed", "fetch_failed", "processing_time", "store_in_db", "raw_data", "meta_data", "data",
)


# Facts of the fetch that a landed page (or a request with its own html) may bring.
FETCH_FACTS = {"status_code": "int", "response_headers": "map<string,string>", "crawled_at": "timestamp"}


def with_pages(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Every request once, with the html of its page and the facts of its fetch; null where no page has landed.

    Of pages that landed twice under one URL the first (by page_id) is taken.
    """
    asked = requests.select("url").where("url IS NOT NULL").distinct()
    facts = [c for c in FETCH_FACTS if c in pages.columns and c not in requests.columns]
    named = pages.select("page_id", "url", "html", *facts).join(asked, "url", "left_semi")
    landed = keep_first(named, "url", "page_id")
    return requests.join(landed.select("url", "html", *facts), "url", "left")


def _with_defaults(requests: DataFrame) -> DataFrame:
    given = {
        n: F.coalesce(F.col(n), F.lit(v)) if n in requests.columns else F.lit(v) for n, v in FLAGS.items()
    }
    optional = {
        n: F.lit(None).cast(kind)
        for n, kind in {"job_id": "string", "metadata": "map<string,string>", "processing_time": "double"}.items()
        if n not in requests.columns
    }
    return requests.withColumns(given | optional)


def refusal(url: Column, robots_allowed: Column | None = None) -> Column:
    """Why a request is not crawled: invalid URL first, robots second; null when it is."""
    reason = F.when(url_reject_reason(url).isNotNull(), F.concat(F.lit("Invalid URL: "), F.coalesce(url, F.lit(""))))
    if robots_allowed is None:
        return reason
    return reason.when(~robots_allowed, F.concat(F.lit("Robots.txt disallows crawling: "), url))


def fetched(
    requests: DataFrame, pages: DataFrame | None = None, snapshots: DataFrame | None = None, user_agent: str = "*", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Requests with defaults, refusals, and the html of those that are not refused."""
    asked = _with_defaults(requests)
    allowed = None
    if snapshots is not None:
        own = tuple(c for c in asked.columns if c not in ("snapshot_id", "allowed", "crawl_delay"))
        asked = check_robots(asked, snapshots, "request_id", user_agent, keep=own)
        allowed = F.coalesce("allowed", F.lit(True))
    asked = asked.withColumn("refused", refusal(F.col("url"), allowed))
    if pages is not None:
        # A refused request has no page to look for, so no html moves for it.
        wanted = asked.withColumns({"_url": F.col("url"), "url": F.when(F.col("refused").isNull(), F.col("url"))})
        asked = with_pages(wanted, pages).withColumn("url", F.col("_url")).drop("_url")
    asked = asked.withColumns({n: F.lit(None).cast(kind) for n, kind in FETCH_FACTS.items() if n not in asked.columns})
    return asked.withColumns(
        {
            "has_page": F.coalesce(F.col("html"), F.lit("")) != "",
            "html": F.when(F.col("refused").isNull(), F.col("html")),
        }
    ).select(*KEPT, *keep, "url", "html")


def spread(requests: DataFrame) -> DataFrame:
    """Requests dealt evenly over more tasks than there are cores.

    Extraction takes far longer than reading: rows that a few bytes describe, or pages that a join has gathered,
    would otherwise be extracted in the few tasks that their size in files or shuffles asks for.
    """
    spark = requests.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return requests.repartition(tasks, "request_id")


def _map(selectors: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in selectors.items() for x in pair]).cast("map<string,string>")


def ingest(
    requests: DataFrame,
    content_type: str,
    pages: DataFrame | None = None,
    selectors: Mapping[str, str] | None = None,
    snapshots: DataFrame | None = None,
    user_agent: str = "*",
) -> DataFrame:
    """One result row per request of one content type.

    ``requests``: request_id (unique), url, and html unless ``pages`` is given;
    optional flags, job_id, metadata, processing_time, fetch facts (status_code,
    response_headers, crawled_at; pages may bring them), requested_at for the robots check,
    and ``selectors``, a map from field to comma list: a request's own set replaces
    ``selectors`` (or the type's) as a whole unless it is null or empty.
    Refused requests keep their row but lose their html, so no extraction work
    is done for them. ``data`` is the typed record.
    """
    spec = type_of(content_type)
    chosen = dict(selectors or spec.selectors)
    asked = spread(fetched(requests, pages, snapshots, user_agent, keep=("selectors",) if "selectors" in requests.columns else ()))
    if "selectors" not in requests.columns:
        # Field columns that clash with kept names do not occur: selectors name record fields.
        extracted = extract_fields(asked, chosen, problems="selector_errors", metadata=True)
        used = F.lit(None).cast("map<string,string>") if selectors is None else _map(selectors)
        return results(extracted.withColumn("selectors", used), content_type)
    given = F.when(F.size("selectors") > 0, F.col("selectors"))
    placed = asked.withColumn("_chosen", F.coalesce(given, _map(chosen)))
    extracted = extract_own_fields(placed, "_chosen", fields_of(spec), problems="selector_errors", metadata=True)
    return results(_listed(extracted), content_type)


def _listed(extracted: DataFrame) -> DataFrame:
    """Keywords are a list in the record; a selector finds one text."""
    if "keywords" not in extracted.columns:
        return extracted
    return extracted.withColumn("keywords", F.when(F.col("keywords") != "", F.array("keywords")))


def results(extracted: DataFrame, content_type: str) -> DataFrame:
    """Result rows of extracted requests of one content type; ``selectors`` is the set a request brought."""
    spec = type_of(content_type)
    processed = process(extracted, content_type, keep=["url", "html", *KEPT, "selectors", *META, "selector_errors"])
    checked = processed.withColumn("_missing", required_field_errors(processed, spec.required))
    ran = F.col("refused").isNull() & F.col("has_page")
    failed = F.col("validate_content") & (F.size("_missing") > 0)
    success = ran & ~failed
    none = F.array().cast("array<string>")
    errors = (
        F.when(F.col("refused").isNotNull(), F.array("refused"))
        .when(~F.col("has_page"), F.array(F.concat(F.lit("Crawl failed for "), "url", F.lit(": no landed page"))))
        .when(failed, F.array(validation_failure(F.col("_missing"))))
        .otherwise(none)
    )
    keep_row = success & F.col("store_in_db")
    crawled = F.date_format(F.col("crawled_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("crawl_timestamp")
    extraction = F.struct("status_code", "response_headers", *META, crawled, "selector_errors")
    return checked.select(
        "request_id",
        "url",
        F.lit(content_type).alias("content_type"),
        success.alias("success"),
        errors.alias("errors"),
        F.when(ran, F.col("_missing")).otherwise(none).alias("validation_errors"),
        F.when(keep_row, content_id(F.lit(content_type), F.col("url"))).alias("content_id"),
        ran.alias("processed"),
        (F.col("refused").isNull() & ~F.col("has_page")).alias("fetch_failed"),
        "processing_time",
        "store_in_db",
        F.when(ran, raw_envelope(F.col("html"), F.col("store_raw_data"), extraction)).alias("raw_data"),
        meta_envelope(
            crawl_timestamp=crawled,
            job_id=F.col("job_id"),
            processing_time=F.col("processing_time"),
            selectors_used=F.col("selectors"),
            validation_errors=F.col("_missing"),
            metadata=F.col("metadata"),
        ).alias("meta_data"),
        F.when(ran, F.struct(*spec.columns)).alias("data"),
    )


def ingest_mixed(requests: DataFrame, pages: DataFrame | None = None, snapshots: DataFrame | None = None, user_agent: str = "*") -> dict[str, DataFrame]:
    """Results per content type for requests of mixed types (column ``content_type``).

    The pages are read and tokenised once: a row's selector set is its own, or
    that of its type, and is a value of the row. The extracted fields are settled
    in a folder per type, from which each type's job reads its rows. Requests whose
    type is unknown or null are refused under the key ``UNSUPPORTED``.
    """
    known, kind = supported_types(), F.col("content_type")
    fits = F.coalesce(kind.isin(known), F.lit(False))
    asked = requests if "selectors" in requests.columns else requests.withColumn("selectors", F.lit(None).cast("map<string,string>"))
    placed = spread(fetched(asked.where(fits), pages, snapshots, user_agent, keep=("selectors", "content_type")))
    own, chosen = F.when(F.size("selectors") > 0, F.col("selectors")), F.lit(None).cast("map<string,string>")
    for t in known:
        chosen = F.when(kind == t, _map(type_of(t).selectors)).otherwise(chosen)
    fields = list(dict.fromkeys(n for t in known for n in fields_of(type_of(t))))
    extracted = extract_own_fields(placed.withColumn("_chosen", F.coalesce(own, chosen)), "_chosen", fields, problems="selector_errors", metadata=True)
    stored = settle(_listed(extracted.drop("_chosen")), by="content_type")

    def rows_of(t: str) -> DataFrame:
        spec = type_of(t)
        mine = stored.where(kind == t).drop("content_type")
        # A column that the type has no field for would be read as one.
        return results(mine.drop(*[n for n in fields if n not in fields_of(spec)]), t)

    return {t: rows_of(t) for t in known} | {UNSUPPORTED: unsupported(requests.where(~fits))}


def unsupported(requests: DataFrame) -> DataFrame:
    """Outcome rows of requests whose content type has no job."""
    none = F.array().cast("array<string>")
    return _with_defaults(requests).select(
        "request_id", "url", "content_type", F.lit(False).alias("success"), F.array(unsupported_reason(F.col("content_type"))).alias("errors"),
        none.alias("validation_errors"), F.lit(None).cast("string").alias("content_id"), F.lit(False).alias("processed"),
        F.lit(False).alias("fetch_failed"), "processing_time", "store_in_db",
    )


def outcomes(results: DataFrame) -> DataFrame:
    """Results without the typed record, the same columns for every content type."""
    return results.drop("data", "raw_data", "meta_data")


def batch_outcomes(results: Mapping[str, DataFrame]) -> DataFrame:
    return union_all([outcomes(r) for r in results.values()])
