"""Registry of the driver queries and the derived tables they read.

A derived table is one SQL text that both Spark and the checking database
understand; ``{name}`` stands for a stored table or an earlier derived one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_CHECKS: dict[str, tuple[str, tuple[str, ...]]] = {}
DERIVED: dict[str, tuple[str, tuple[str, ...]]] = {}


def derived(name: str, sql: str, *sources: str) -> None:
    DERIVED[name] = (sql, sources)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table, or a derived one planned over the stored tables."""
    if name not in DERIVED:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql, sources = DERIVED[name]
    return spark.sql(sql, **{s: table(spark, sf_dir, s) for s in sources})


def _closure(names, seen: list[str]) -> list[str]:
    for name in names:
        if name in DERIVED and name not in seen:
            _closure(DERIVED[name][1], seen)
            seen.append(name)
    return seen


def oracle(body: str, *names: str) -> str:
    """Checking SQL: the derived tables it needs as common table expressions, then the body."""
    parts = []
    for name in _closure(names, []):
        sql, sources = DERIVED[name]
        for source in sources:
            sql = sql.replace("{" + source + "}", source)
        parts.append(f"{name} AS ({sql})")
    if not parts:
        return body
    text = body.strip()
    if text.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + text[len("WITH RECURSIVE"):].strip()
    if text.upper().startswith("WITH"):
        return "WITH " + ", ".join(parts) + ", " + text[4:].strip()
    return "WITH " + ", ".join(parts) + " " + text


def query(name: str, tables: str = "", sql: str | None = None):
    """Register ``fn(*tables) -> DataFrame`` with its checking SQL."""
    names = tuple(tables.split())

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(*[table(spark, sf_dir, n) for n in names])

        QUERIES[name] = run
        if sql is not None:
            _CHECKS[name] = (sql, names)
        return fn

    return add


def oracles() -> dict[str, str]:
    return {name: oracle(sql, *names) for name, (sql, names) in _CHECKS.items()}
