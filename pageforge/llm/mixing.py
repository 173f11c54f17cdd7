"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source gets a weight; its target is its share of all words, at most
``cap`` times the source's own size, and what is cut off is shared among the
others by weight until none is above (water filling over one row per source).
A source is dealt into blocks by ranges of a keyed hash, so their order is a
random permutation. Whole passes over a source and then its first blocks are
drawn until the target is met; the block in which the target falls is drawn by
document, large ones first, as far as they fit. The gap that this leaves goes on
into the following blocks, over the documents that still fit, until no document
left does; then the smallest one left is drawn if that comes nearer. So a source
ends at most half of its smallest document not drawn away from its target,
however long the others are.

The drawn blocks of all sources are then shared out exactly: a binary tree over
the output shards splits the vector of block quotas at every node by a
multivariate hypergeometric draw, and each leaf takes its quota of every source
as a disjoint range of that source's permuted blocks. Inside a shard documents
are ordered by a keyed hash.

Only narrow rows (id, source, size, hash) are shuffled; a hot source is summed
before its shuffle and never gathered. All draws are functions of ``seed`` and
the rows, so reruns agree.

Defined results: a null text has size 0; a null source is a source of its own
and comes last; rows that repeat id, source and size are one item, drawn
together; sources without words are never drawn; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageforge.llm.common import own_prefix, settle

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, CAP = (5, 2, 1), 3
BLOCK_ITEMS, MAX_BLOCKS = 64, 65_536
SHARD_WORDS, MIN_SHARDS = 64_000_000, 16
SMALL_SOURCES = 50_000


def size(text: Column) -> Column:
    """Number of words of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """Adds ``weight`` and ``target`` to rows (source, source_size)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    picked = F.array(*[F.lit(float(w)) for w in weights])
    df = sources.withColumn("weight", F.get(picked, (F.row_number().over(order) - 1) % len(weights)))
    df = df.withColumn("_limit", F.col("source_size") * float(cap)).withColumn("_reach", F.col("_limit") / F.col("weight"))
    by_reach = Window.orderBy("_reach", F.col("source").asc_nulls_last())
    before, after = by_reach.rowsBetween(Window.unboundedPreceding, -1), by_reach.rowsBetween(0, Window.unboundedFollowing)
    everything = by_reach.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The level at which a source and all behind it would be filled if all before it are full.
    df = df.withColumn(
        "_level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / F.sum("weight").over(after),
    )
    df = df.withColumn("_level", F.first(F.when(F.col("_level") <= F.col("_reach"), F.col("_level")), ignorenulls=True).over(everything))
    level = F.coalesce(F.col("_level") * F.col("weight"), F.col("_limit"))
    return df.withColumn("target", F.least(F.col("_limit"), level)).drop("_limit", "_reach", "_level")


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """Draw inside one block: large items first, as far as they fit."""
    pdf = pdf.sort_values(["weight_", "key", "doc_id"], ascending=[False, True, True], kind="stable", na_position="last")
    gap, drawn = float(pdf["gap"].iloc[0]), np.zeros(len(pdf), bool)
    for i, w in enumerate(pdf["weight_"].to_numpy()):
        if w <= gap:
            drawn[i], gap = True, gap - w
    return pdf[drawn][["doc_id", "source", "size", "block", "weight_"]]


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


def _join(a: DataFrame, b: DataFrame, *names: str, how: str = "inner") -> DataFrame:
    """Join on equal names, nulls equal, with one copy of the key columns."""
    b = b.select(*[F.col(n).alias(f"__{n}") if n in names else F.col(n) for n in b.columns])
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"__{n}"))
    return a.join(b, on, how).drop(*[f"__{n}" for n in names])


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, quota) to (source, shard, quota): ``shards`` is a power of two, each node one hypergeometric draw."""

    def halve(level: int):
        def of(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("source", na_position="last", kind="stable")
            node, counts = int(pdf["node"].iloc[0]), pdf["quota"].to_numpy(np.int64)
            rng = np.random.default_rng([seed, level, node])
            left = rng.multivariate_hypergeometric(counts, (int(counts.sum()) + (node & 1)) // 2, method="marginals")
            out = [pdf.assign(node=2 * node, quota=left), pdf.assign(node=2 * node + 1, quota=counts - left)]
            return pd.concat(out)[["node", "source", "quota"]]

        return of

    schema = quotas.schema["source"].dataType.simpleString()
    nodes = quotas.select(F.lit(0).cast("long").alias("node"), "source", "quota")
    for level in range(shards.bit_length() - 1):
        nodes = nodes.groupBy("node").applyInPandas(halve(level), f"node long, source {schema}, quota long")
    return nodes.select("source", F.col("node").alias("shard"), "quota")


def _line(blocks: DataFrame) -> DataFrame:
    """Rows (source, block, block_size, rest) with their ``state`` and what is left of ``rest`` before them as ``gap``."""
    line = Window.partitionBy("source").orderBy("block")
    blocks = blocks.withColumn("_end", F.sum("block_size").over(line)).withColumn("gap", F.col("rest") - (F.col("_end") - F.col("block_size")))
    state = F.when(F.col("_end") <= F.col("rest"), "whole").when(F.col("gap") > 0, "part").otherwise("none")
    return blocks.withColumn("state", state).drop("_end")


def _drawn_by_document(placed: DataFrame, blocks: DataFrame, known_sources: int) -> DataFrame:
    """(doc_id, source, size, block) of the documents drawn outside whole blocks.

    ``placed`` has the documents with the state of their block, ``blocks`` (source, block, gap, state). In every round the
    documents behind the last part block that fit the gap are drawn by whole blocks up to the next part block. There
    the first one that does not fit follows at least as much that was drawn, so the gap halves from round to round.
    """
    names = ("doc_id", "source", "size", "block", "weight_")
    schema = ", ".join(f"{n} {placed.schema[n].dataType.simpleString()}" for n in names)
    spread = F.broadcast if known_sources <= SMALL_SOURCES else (lambda df: df)
    open_ = placed.filter("state = 'part' OR state = 'none' AND weight_ > 0").select(*names, "key")
    part = blocks.filter("state = 'part'").select("source", "block", "gap")
    left, drawn, gaps = open_, None, None
    while True:
        fitted = left.join(spread(part.withColumnRenamed("source", "_s").withColumnRenamed("block", "_b")), F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
        fitted = settle(fitted.select(*names, "key", "gap").groupBy("source", "block").applyInPandas(_fit, schema), "mix-fitted")
        drawn = fitted if drawn is None else drawn.unionByName(fitted)
        spent = fitted.groupBy("source").agg(F.sum("weight_").alias("spent"))
        now = _join(part, spent, "source", how="left").select("source", F.col("block").alias("at"), (F.col("gap") - F.coalesce("spent", F.lit(0))).alias("rest"))
        now = settle(now, "mix-gaps")
        # A source without a part block in this round has run out of documents that fit; its gap stands.
        gaps = now if gaps is None else now.unionByName(_join(gaps, now.select("source"), "source", how="left_anti"))
        left = _join(left, spread(now), "source").filter("block > at AND weight_ <= rest").drop("at")
        left = settle(left, "mix-left")
        if left.isEmpty():
            break
        line = settle(_line(left.groupBy("source", "block").agg(F.sum("weight_").alias("block_size"), F.first("rest").alias("rest"))), "mix-line")
        whole = line.filter("state = 'whole'")
        took = _join(left, whole.select("source", "block"), "source", "block").select(*names)
        drawn = drawn.unionByName(took)
        part = line.filter("state = 'part'").select("source", "block", "gap")
        # Without a part block all that fitted is drawn and only the sum is taken off.
        done = whole.groupBy("source").agg(F.sum("block_size").alias("spent"), F.first("rest").alias("rest"))
        done = _join(done, part.select("source"), "source", how="left_anti")
        done = done.select("source", F.lit(None).cast("long").alias("at"), (F.col("rest") - F.col("spent")).alias("rest"))
        gaps = settle(done.unionByName(_join(gaps, done.select("source"), "source", how="left_anti")), "mix-gaps")
        left = left.drop("rest")
    near = _join(open_, spread(gaps.filter("rest > 0").select("source", "rest")), "source").filter("weight_ > rest AND weight_ < 2 * rest")
    near = _join(near, drawn.select("doc_id", "source", "size"), "doc_id", "source", "size", how="left_anti")
    near = near.groupBy("source").agg(F.min_by(F.struct("doc_id", "size", "block"), F.struct("weight_", "key", "doc_id", "size")).alias("d"))
    return settle(drawn.select("doc_id", "source", "size", "block").unionByName(near.select("d.doc_id", "source", "d.size", "d.block")), "mix-drawn")


def plan(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: int = 7) -> DataFrame:
    """One row per distinct (doc_id, source, size): ``times`` it occurs, source_size, target and ``copies``.

    ``copies`` lists one (epoch, shard, place) per time that the mix takes the document.
    """
    key = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("source"), F.col("size"))
    items = settle(
        docs.select("doc_id", "source", size(docs["text"]).alias("size"))
        .groupBy("doc_id", "source", "size").agg(F.count("*").alias("times"))
        .withColumn("key", key).withColumn("weight_", F.col("size") * F.col("times")),
        "mix-items",
    )
    sources = items.groupBy("source").agg(F.sum("weight_").alias("source_size"), F.count("*").alias("n_items"))
    sources = targets(sources, weights, cap)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("full", full.cast("long")).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    sources = sources.withColumn("blocks", F.least(F.ceil(F.col("n_items") / BLOCK_ITEMS), F.lit(MAX_BLOCKS)).cast("long"))
    sources = settle(sources, "mix-sources")
    known = sources.agg(F.count("*").alias("n"), F.sum("source_size").alias("w")).first()
    small = F.broadcast(sources) if known["n"] <= SMALL_SOURCES else sources
    shards = 1 << max(MIN_SHARDS - 1, (known["w"] or 0) // SHARD_WORDS).bit_length()

    share = F.shiftrightunsigned(F.col("key"), 33) / float(1 << 31)
    placed = _join(items, small.select("source", "source_size", "target", "blocks"), "source")
    placed = placed.withColumn("block", F.floor(share * F.col("blocks")).cast("long")).drop("blocks")
    blocks = placed.groupBy("source", "block").agg(F.sum("weight_").alias("block_size"))
    blocks = _join(blocks, small.select("source", "full", "rest"), "source")
    blocks = settle(_line(blocks).select("source", "block", "full", "gap", "state"), "mix-blocks")
    parts = _drawn_by_document(_join(placed, blocks.select("source", "block", "state"), "source", "block"), blocks, known["n"])
    # Later blocks of which a document was drawn are part of the last pass as well.
    touched = parts.select("source", "block").distinct().withColumn("_touched", F.lit(True))
    state = F.when((F.col("state") == "none") & F.col("_touched"), "part").otherwise(F.col("state"))
    blocks = settle(_join(blocks, touched, "source", "block", how="left").select("source", "block", "full", state.alias("state")), "mix-blocks")

    # Units: a block in one pass. Each source's units in permuted order, cut into the shards' quotas.
    passes = F.col("full") + (F.col("state") != "none").cast("long")
    units = blocks.filter(passes > 0).select("source", "block", F.explode(F.sequence(F.lit(1).cast("long"), passes)).alias("epoch"))
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "block", "epoch"), "block", "epoch")
    ranked = units.withColumn("_rank", F.row_number().over(order))
    quotas = split_quotas(units.groupBy("source").agg(F.count("*").alias("quota")), shards, seed)
    upto = F.sum("quota").over(Window.partitionBy("source").orderBy("shard"))
    starts = quotas.filter("quota > 0").select("source", "shard", (upto - F.col("quota") + 1).alias("_rank"))
    # A unit's shard is that of the last range start at or before it: starts and units meet in one ordered pass.
    both = ranked.unionByName(starts.withColumn("_start", F.lit(True)), allowMissingColumns=True)
    last = Window.partitionBy("source").orderBy("_rank", F.col("_start").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    dealt = both.withColumn("shard", F.last("shard", ignorenulls=True).over(last)).filter("_start IS NULL")
    dealt = dealt.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("units"))

    placed = _join(placed, blocks.select("source", "block", "full", "state"), "source", "block")
    parts = parts.select("doc_id", "source", "size", F.lit(True).alias("drawn"))
    out = _join(_join(placed, dealt, "source", "block", how="left"), parts, "doc_id", "source", "size", how="left")
    drawn = (F.col("state") == "whole") | F.coalesce(F.col("drawn"), F.lit(False))
    taken = F.filter(F.coalesce(F.col("units"), F.array()), lambda u: (u["epoch"] <= F.col("full")) | drawn)
    copies = F.transform(
        taken,
        lambda u: F.struct(u["epoch"].alias("epoch"), u["shard"].alias("shard"), F.xxhash64(F.col("key"), u["epoch"]).alias("place")),
    )
    return out.select("doc_id", "source", "size", "times", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each document as often as it was drawn, dealt to shards and shuffled inside each."""
    names, own = docs.columns, own_prefix(docs)
    drawn = plan(docs, **settings).filter(F.size("copies") > 0)
    drawn = drawn.select(*[F.col(c).alias(f"{own}{c}") for c in ("doc_id", "source", "size", "copies")])
    on = docs["doc_id"].eqNullSafe(F.col(f"{own}doc_id")) & docs["source"].eqNullSafe(F.col(f"{own}source"))
    out = docs.join(drawn, on & (size(docs["text"]) == F.col(f"{own}size")))
    shard, place = f"{own}copy.shard", f"{own}copy.place"
    out = out.withColumn(f"{own}copy", F.explode(f"{own}copies"))
    return out.repartition(F.col(shard)).sortWithinPartitions(shard, place).select(*[docs[n] for n in names])
