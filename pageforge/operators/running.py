"""Running totals that stay parallel inside one key.

A plain window would put every row of a key into one task. Here each key is cut
into chunks that are ordered among themselves; rows are accumulated inside a
chunk, chunk totals (one row per chunk) are accumulated per key, and the two are
added. The result is exact and a key of any size is spread over many tasks.
Rows whose key is null form a key of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"


def with_running_sums(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, totals: dict[str, Column]
) -> DataFrame:
    """Add inclusive running sums per key.

    ``chunk`` must not decrease along ``order``: rows of a lower chunk come
    before rows of a higher one (for instance the hour of the first order column).
    """
    local = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn(CHUNK, chunk)
    inside = rows.withColumns({n: F.sum(v).over(local) for n, v in totals.items()})
    sums = rows.groupBy(*keys, CHUNK).agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in totals.items()])
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys, CHUNK, *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in totals]
    )
    joined = join_null_safe(inside, offsets, [*keys, CHUNK])
    return joined.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in totals}).drop(
        CHUNK, *[f"_before_{n}" for n in totals]
    )


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on equal keys in which a null equals a null; the keys appear once."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(named[f"_right_{k}"])
    return left.join(named, same).drop(*[f"_right_{k}" for k in keys])


def with_rank(df: DataFrame, keys: list[str], order: list[str], chunk: Column, name: str = "rank") -> DataFrame:
    """Add the 1-based position of each row within its key."""
    return with_running_sums(df, keys, order, chunk, {name: F.lit(1).cast("bigint")})
