"""Unique keys, references and updates on stored tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructType

# Nodes whose state a task keeps while it follows chains through a stretch of rows.
STRETCH = 200_000


def shared_folder(spark: SparkSession) -> str:
    """Folder for data that outlives a task, named in ``spark.checkpoint.dir``.

    Without that setting a local session gets a temporary folder; any other
    session is refused, because its executors could not share one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="pageforge-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settle(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    A frame that is read more than once is then computed once, survives lost
    executors, and is read by column; with ``by`` also by the values of that
    column, each in its own folder. The folder is scratch space of the job.
    """
    path = f"{shared_folder(df.sparkSession)}/settled/{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def first_ids(df: DataFrame, key: str, order: str) -> DataFrame:
    """Order values of the rows that come first under ``key``; null keys are all kept.

    ``order`` must be unique. Only key and order are shuffled, and the minimum
    is combined before the shuffle, so a key with a third of the rows is cheap.
    """
    keyed = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order)).select(order)
    return keyed.unionByName(df.where(F.col(key).isNull()).select(order))


def only(df: DataFrame, ids: DataFrame, order: str) -> DataFrame:
    """Rows of ``df`` whose unique ``order`` is among ``ids``, which hold most of them.

    The rows to drop are found on the ids alone. When they are few, adaptive
    execution broadcasts them and the payload is not shuffled; when they are
    many, the join runs on a unique column and cannot be skewed.
    """
    dropped = df.select(order).join(ids, order, "left_anti")
    return df.join(dropped, order, "left_anti")


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """First row per key in insert order. ``df`` is read more than once: hand over
    a stored or settled frame when it is costly to compute."""
    return only(df, first_ids(df, key, order), order)


def accept_inserts(df: DataFrame, keys, order: str, stored: DataFrame | None = None) -> DataFrame:
    """Rows that unique constraints let in when rows are inserted one by one in ``order`` (see ``accepted_ids``)."""
    return only(df, accepted_ids(df, keys, order, stored), order)


def accepted_ids(df: DataFrame, keys, order: str, stored: DataFrame | None = None) -> DataFrame:
    """Order values of the rows that inserting one by one lets in.

    Rows whose key exists in ``stored`` are rejected; null keys are exempt. With
    one key these are the first rows. With several, a row that is rejected under
    one key must not block others under another. One round decides nearly all:
    rows that come first under all their keys are in, rows that share a key with
    them are out. What is left blocks each other in turn and goes to
    ``_decide_chains``. Only keys and order values take part.
    """
    pending = df.select(order, *keys)
    for key in keys if stored is not None else ():
        taken = stored.where(F.col(key).isNotNull()).select(key)
        pending = pending.join(taken, key, "left_anti")
    if len(keys) == 1:
        return first_ids(pending, keys[0], order)
    pending = settle(pending)
    into = pending
    for key in keys:
        into = into.join(first_ids(pending, key, order), order, "left_semi")
    into = settle(into)
    rest = pending.join(into.select(order), order, "left_anti")
    for key in keys:
        rest = rest.join(into.where(F.col(key).isNotNull()).select(key), key, "left_anti")
    rest = settle(rest.select(order, *keys))
    if rest.isEmpty():
        return into.select(order)
    return into.select(order).unionByName(_decide_chains(rest, keys, order))


def _decide_chains(rows: DataFrame, keys, order: str) -> DataFrame:
    """Order values of the accepted of rows that block each other in turn.

    A node is a row under one of its keys and says whether the key is taken once
    the row has been tried. It follows from the nodes just before the row under its
    keys: if none of those keys is taken the row is in and takes them all. With one
    undecided node before it a row's nodes are true or copy or negate that node: a
    pointer. Every round looks once at what each node points to, so pointers double
    their reach and a chain of n rows is decided in about log2(n) rounds. A row with
    two undecided nodes waits for one of them; the number of rounds is bounded by
    log2 of the chains between such rows times how deep those rows depend on each
    other, and the earliest undecided row is decided in every round at least.
    The rows of one key are ordered by a window over key and order values.

    Chains run along the order, so stretches of it are followed first, each in one
    task (see ``_followed``). Only nodes that other stretches ask for, and rows that
    wait for two, go into the rounds; the verdicts of all others point to these.
    """
    none = F.lit(None)
    kind = rows.schema[order].dataType
    occurs = union_all(
        [rows.where(F.col(k).isNotNull()).select(F.col(order).alias("ord"), F.lit(i).alias("k"), F.col(k).cast("string").alias("v")) for i, k in enumerate(keys)]
    )
    before = F.lag("ord").over(Window.partitionBy("k", "v").orderBy("ord"))
    followed = settle(_followed(occurs.select("ord", "k", before.alias("p")), kind))
    own, verdicts = followed.where("k >= 0"), followed.where("k < 0")
    waiting = own.where("taken IS NULL AND to IS NULL")
    asked = union_all(
        [
            followed.where("to IS NOT NULL").select(F.col("to").alias("ord"), F.col("to_k").alias("k")),
            waiting.where("p IS NOT NULL").select(F.col("p").alias("ord"), "k"),
            waiting.select("ord", "k"),
        ]
    )
    nodes = settle(own.join(asked.distinct(), ["ord", "k"], "left_semi"))
    row = Window.partitionBy("ord")
    while True:
        seen = nodes.select(
            F.col("ord").alias("_aim"), F.col("k").alias("_aim_k"), F.col("taken").alias("s_taken"), F.col("to").alias("s_to"),
            F.col("to_k").alias("s_to_k"), F.col("neg").alias("s_neg"),
        )
        # A pointer looks at its node, a node without one at the node before it.
        aimed = nodes.withColumns({"_aim": F.coalesce("to", "p"), "_aim_k": F.coalesce("to_k", "k")})
        looked = aimed.join(seen, ["_aim", "_aim_k"], "left")
        first, points = F.col("p").isNull(), F.col("to").isNotNull()
        # What the node before the row says: a value, or the node to ask instead.
        said = F.when(first, F.lit(False)).otherwise(F.col("s_taken"))
        ask = F.when(
            said.isNull(),
            F.struct(F.coalesce("s_to", "_aim").alias("to"), F.coalesce("s_to_k", "_aim_k").alias("to_k"), F.when(F.col("s_to").isNotNull(), F.col("s_neg")).otherwise(False).alias("neg")),
        )
        summed = looked.withColumns({"_said": said, "_ask": ask}).withColumns(
            {
                "_held": F.coalesce(F.bool_or("_said").over(row), F.lit(False)),
                "_open": F.count_if(F.col("_said").isNull()).over(row),
                "_other": F.max("_ask").over(row),
            }
        )
        copied = F.struct(F.col("_said").alias("taken"), F.col("_ask.to").alias("to"), F.col("_ask.to_k").alias("to_k"), F.coalesce("_ask.neg", F.lit(False)).alias("neg"))
        true = F.struct(F.lit(True).alias("taken"), none.cast(kind).alias("to"), none.cast("int").alias("to_k"), F.lit(False).alias("neg"))
        negated = F.struct(none.cast("boolean").alias("taken"), F.col("_other.to").alias("to"), F.col("_other.to_k").alias("to_k"), (~F.col("_other.neg")).alias("neg"))
        jumped = F.struct(
            F.when(F.col("s_taken").isNotNull(), F.col("s_taken") != F.col("neg")).alias("taken"),
            F.coalesce("s_to", "to").alias("to"), F.coalesce("s_to_k", "to_k").alias("to_k"),
            F.when(F.col("s_to").isNotNull(), F.col("neg") != F.col("s_neg")).otherwise(F.col("neg")).alias("neg"),
        )
        kept = F.struct("taken", "to", "to_k", "neg")
        now = (
            F.when(F.col("taken").isNotNull(), kept)
            .when(points, jumped)
            .when(F.col("_held"), copied)
            .when(F.col("_open") == 0, true)
            .when(F.col("_open") == 1, F.when(F.col("_said").isNull(), true).otherwise(negated))
            .otherwise(kept)
        )
        nodes = settle(summed.select("ord", "k", "p", now.alias("n")).select("ord", "k", "p", "n.*"))
        if nodes.where("taken IS NULL").isEmpty():
            break
    pointed = nodes.select(F.col("ord").alias("to"), F.col("k").alias("to_k"), F.col("taken").alias("_told"))
    told = verdicts.join(pointed, ["to", "to_k"], "left").where(~F.coalesce(F.col("taken"), F.col("_told") != F.col("neg")))
    earlier = nodes.select(F.col("ord").alias("p"), "k", F.col("taken").alias("_before"))
    met = waiting.select("ord", "k", "p").join(earlier, ["p", "k"], "left").groupBy("ord")
    waited = met.agg(F.bool_or(F.coalesce("_before", F.lit(False))).alias("_out")).where("NOT _out")
    return told.select(F.col("ord").alias(order)).unionByName(waited.select(F.col("ord").alias(order)))


def _followed(nodes: DataFrame, kind: DataType) -> DataFrame:
    """Nodes (ord, k, p) with what their stretch of the order tells: a value, a pointer out of the stretch, or nothing for all
    nodes of a row that waits for two. Rows that do not wait also give a verdict, ``k`` -1: whether the row is out.

    A task reads its rows in order and keeps the nodes of one stretch, a bounded number.
    """
    schema = StructType.fromDDL("ord int, k int, p int, taken boolean, to int, to_k int, neg boolean")
    for name in ("ord", "p", "to"):
        schema[name].dataType = kind
    arrow, stretch = to_arrow_schema(schema), STRETCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row, made = {}, [], []

        def add(at, k, p, state):
            if isinstance(state, tuple):
                made.append((at, k, p, None, *state))
            else:
                made.append((at, k, p, state, None, None, False))

        def decide():
            at, said, ask = row[0][0], {}, {}
            for _, k, p in row:
                state = False if p is None else known.get((p, k), (p, k, False))
                (ask if isinstance(state, tuple) else said)[k] = state
            if True in said.values():
                verdict, states = True, said | ask
            elif not ask:
                verdict, states = False, dict.fromkeys(said, True)
            elif len(ask) == 1:
                ((k, (to, to_k, neg)),) = ask.items()
                verdict, states = (to, to_k, neg), dict.fromkeys(said, (to, to_k, not neg)) | {k: True}
            else:
                verdict, states = None, {}
            if len(known) >= stretch:
                known.clear()
            for _, k, p in row:
                add(at, k, p, states.get(k))
                known[at, k] = states.get(k, (at, k, False))
            if verdict is not None:
                add(at, -1, None, verdict)
            row.clear()

        def taken_out():
            columns = list(zip(*made)) or [()] * len(arrow)
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for node in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if row and row[0][0] != node[0]:
                    decide()
                row.append(node)
            yield taken_out()
        if row:
            decide()
        yield taken_out()

    return nodes.repartitionByRange("ord").sortWithinPartitions("ord", "k").mapInArrow(run, schema)


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children that refer to no parent."""
    return children.join(parents.select(key), key, "left_anti")


def merged_changes(updates: DataFrame, key: str, changes: str, seq: str, fields: Iterable[str]) -> DataFrame:
    """Fold several change maps per key into one, the latest value of each field winning.

    ``fields`` are the columns that can be set. Each is one maximum that combines
    before the shuffle, so nothing is gathered however many other names the maps hold.
    """
    names = list(fields)

    def latest(name: str) -> Column:
        named = F.map_contains_key(changes, F.lit(name))
        return F.max_by(F.when(named, F.struct(F.lit(name).alias("field"), F.element_at(changes, F.lit(name)).alias("value"))), F.when(named, F.col(seq)))

    folded = updates.where(F.size(changes) > 0).groupBy(key).agg(*[latest(n).alias(f"_{i}") for i, n in enumerate(names)])
    return folded.select(key, F.map_from_entries(F.array_compact(F.array(*[f"_{i}" for i in range(len(names))]))).alias(changes))


def apply_changes(
    base: DataFrame, updates: DataFrame, key: str, changes: str, as_of: Column, touched: str = "updated_at"
) -> DataFrame:
    """Partial update: named fields are set (to null as well), unknown names ignored,
    the update time set on changed rows."""
    joined = base.join(updates.select(key, F.col(changes).alias("_changes")), key, "left")
    columns = []
    for field in base.schema.fields:
        old = F.col(field.name)
        if field.name == touched:
            columns.append(F.when(F.col("_changes").isNotNull(), as_of).otherwise(old).alias(field.name))
        elif field.name == key:
            columns.append(old)
        else:
            named = F.coalesce(F.map_contains_key("_changes", F.lit(field.name)), F.lit(False))
            new = F.element_at("_changes", F.lit(field.name)).try_cast(field.dataType)
            columns.append(F.when(named, new).otherwise(old).alias(field.name))
    return joined.select(*columns)


def content_id(*parts: Column) -> Column:
    """Stable identifier in the 36-character layout, from a hash of its parts.

    Equal on every run, so that re-run tasks and retried writes give the same id.
    """
    digest = F.md5(F.concat_ws("\x1f", *parts))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, at, n) for at, n in cuts])


def random_id() -> Column:
    """Random identifier in the same layout. It differs on every evaluation: use it
    only for rows that are written once and never recomputed."""
    return F.uuid()


def find_by_id(df: DataFrame, value, column: str = "id") -> DataFrame:
    return df.where(F.col(column) == value)


def as_records(df: DataFrame, name: str = "record") -> DataFrame:
    """Every row as one JSON record of all its columns."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias(name))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
