import pytest

from pageforge.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate a Column function over a list of strings."""

    def run(fn, inputs, *more):
        from pyspark.sql import functions as F

        rows = [(i, v) for i, v in enumerate(inputs)]
        df = spark.createDataFrame(rows, "i int, v string")
        out = df.select("i", fn(F.col("v"), *more).alias("o")).orderBy("i").collect()
        return [r.o for r in out]

    return run
