"""Small helpers the operators share: words, scratch tables, one-row bindings."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but space and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it.

    A filter over derived columns is inlined by the optimizer and would compute
    a shared value once per use; a bound variable is not.
    """
    return F.transform(F.array(value), body)[0]


def own_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` starts with, for columns that meet its own in a join."""
    return (max(map(len, df.columns), default=0) + 1) * "_"


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only in local mode without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="pageforge-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back: lineage ends here, lost executors only reread."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps.

    It does so once the driver's garbage is collected: Python's first, which lets
    go of the JVM's objects, then the JVM's; the second round takes what the
    first has only unlinked.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_runs(batches, keys: list[str]):
    """Arrow tables that hold only complete runs of equal keys, from batches sorted by them."""
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        cut = 0
        for k in keys:
            values = table.column(k).to_numpy()
            changes = np.flatnonzero(values[1:] != values[:-1])
            cut = max(cut, int(changes[-1]) + 1 if len(changes) else 0)
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield held
