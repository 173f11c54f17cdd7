import pytest

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts(small):
    return {r.doc_id: r.text or "" for r in small.select("doc_id", "text").collect()}


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text[, source]) tuples."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def odd(docs):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators might use."""
    from pyspark.sql import functions as F

    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    df = docs((1, None), (2, ""), (3, " \n \t"), (4, long, None), (5, long), (6, "one two three"), (6, "one two three"), (None, "one two three"), (None, None, None), (7, "one two three"))
    for name in ("size", "h", "code", "node", "s", "line", "key", "copies", "shard", "__x", "ranges", "spans", "n_entities"):
        df = df.withColumn(name, F.lit(1))
    return df
