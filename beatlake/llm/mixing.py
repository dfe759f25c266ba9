"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted target / source size times. The whole part of that is sure; the fractions are rounded
by the pivotal method: two documents meet, mass moves at random from one to the other until one of them is whole, and the
other one meets the next document. Documents meet in descending order of their sizes, so that mass moves between documents of
about one size and the last fraction is that of a short one: the words taken stay near the target. Blocks of documents are rounded apart, each leaves at most one
fraction, and these residuals meet in a tree of blocks of blocks.

Defined results: a null text has size 0; a null source is a source of its own, last in order; repeated rows are rounded
apart; a source of size 0 has target 0 and takes nothing; an empty table gives an empty result; the result comes as one
struct column under a name that the table doesn't hold yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beatlake.llm._shared import Scratch, free_name, mix64, small_enough, text_or_empty

#: Weights by the source's place in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A target is at most so many times its source's size.
MOST_COPIES = 3
#: Documents that one block rounds, and residuals that meet in one block of the tree.
BLOCK, FAN_IN = 4096, 64

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text"):
    """Number of words of a text column; null has none."""
    return F.regexp_count(text_or_empty(text), F.lit(WORDS)).cast("long")


def source_targets(sized: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, place, documents, source_size and target. sized has source and size.

    Targets fill up like water: weight times a level, at most `most` times the source's size; the level that spends all
    words is found from sums over the sources, a few jobs of which only three numbers come back.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    order = [F.col("source").isNull(), F.col("source")]
    # A global index without a window over everything: range partitions are sorted and their counts added up.
    dealt = scratch.table(totals.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before = dealt.groupBy(part.alias("_part")).count().withColumn("_before", F.sum("count").over(Window.orderBy("_part")) - F.col("count"))  # a row per partition
    place = F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    indexed = dealt.withColumn("_part", part).join(F.broadcast(before), "_part").select("source", "source_size", "documents", place.alias("place")).withColumn("weight", weight)
    indexed = scratch.table(indexed)
    most_of = F.col("source_size") * F.lit(float(most))
    total, all_weights = indexed.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = (total / all_weights if all_weights else 0.0), -1
    while True:
        stopped = most_of <= F.col("weight") * F.lit(float(level))
        n, spent, rest = indexed.agg(F.count_if(stopped), F.sum(F.when(stopped, most_of)), F.sum(F.when(~stopped, F.col("weight")))).first()
        if n == full or not rest:
            break
        full, level = n, max(0.0, (total - (spent or 0.0)) / rest)
    return indexed.withColumn("target", F.least(most_of, F.col("weight") * F.lit(float(level))))


def _rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequential pivotal rounding of rows sorted by (_place, _block, ...). Sets _copy to 0 or 1, or leaves it null for the
    one row of a block whose fraction _p is what is left; the others' _p is 0. One row is held at a time."""
    held: pa.RecordBatch | None = None
    key, mass, count = None, 0.0, 0

    def done(rows: pa.RecordBatch, copies: list, masses: list) -> pa.RecordBatch:
        names = rows.schema.names
        rows = rows.set_column(names.index("_copy"), "_copy", pa.array(copies, pa.int32()))
        return rows.set_column(names.index("_p"), "_p", pa.array(masses, pa.float64()))

    for batch in batches:
        n = batch.num_rows
        get = lambda name: batch.column(batch.schema.names.index(name)).to_numpy(zero_copy_only=False)  # noqa: E731,B023
        places, blocks, masses = get("_place"), get("_block"), get("_p").copy()
        dice = get("_dice").astype(np.int64).astype(np.uint64)
        copies: list = [None] * n
        at = -1 if held is not None else None  # where the row that holds mass is: -1 in an earlier batch
        ready: list[tuple[pa.RecordBatch, int | None, float]] = []

        def settle(where: int, copy: int | None, left: float = 0.0) -> None:
            if where == -1:
                ready.append((held, copy, left))  # noqa: B023
            else:
                copies[where], masses[where] = copy, left  # noqa: B023

        for k in range(n):
            if (places[k], blocks[k]) != key:
                if at is not None:
                    settle(at, None, mass)
                key, at, count = (places[k], blocks[k]), None, 0
            count += 1
            own = masses[k]
            if own <= 1e-12 or own >= 1 - 1e-12:
                copies[k], masses[k] = round(own), 0.0
                continue
            if at is None:
                at, mass = k, own
                continue
            chance = float(mix64(np.array([dice[k] ^ np.uint64(count * 0x9E3779B1)]))[0]) / 2.0**64
            both = mass + own
            if both < 1:
                keep, lose, left, copy = (k, at, both, 0) if chance * both < own else (at, k, both, 0)
            else:
                keep, lose, left, copy = (k, at, both - 1, 1) if chance * (2 - both) < 1 - own else (at, k, both - 1, 1)
            settle(lose, copy)
            if left <= 1e-12 or left >= 1 - 1e-12:
                settle(keep, round(left))
                at = None
            else:
                at, mass = keep, left
        for row, copy, left in ready:
            yield done(row, [copy], [left])
        if at == -1:
            out = batch
        else:
            keep_row = batch.slice(at, 1) if at is not None else None
            held = keep_row
            if at is None:
                out = batch
            else:
                mask = np.ones(n, dtype=bool)
                mask[at] = False
                out = batch.filter(pa.array(mask))
                copies, masses = [c for k, c in enumerate(copies) if k != at], np.delete(masses, at)
        if out.num_rows:
            yield done(out, copies, list(masses))
    if held is not None:
        yield done(held, [None], [mass])


def mixed(sized: DataFrame, seed: int = 8, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, tie: str | None = None) -> DataFrame:
    """sized (with doc_id, source and size) plus a struct `mix` of source_size, target, copies and taken.

    Results depend on the rows alone (ids, sizes, sources and, where given, the column `tie`), not on partitions.
    """
    scratch = Scratch(sized.sparkSession, "mixing")
    targets = source_targets(sized, scratch, weights, most)
    n_sources = targets.count()
    slim = targets.select(F.col("source").alias("_source"), F.col("place").alias("_place"), "documents", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    side = F.broadcast(slim) if small_enough(n_sources, 200) else slim
    share = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    near = F.when(F.abs(share - F.round(share)) < 1e-9, F.round(share)).otherwise(share)
    dice = F.xxhash64(F.lit(seed), "doc_id", "size", *(["_tie"] if tie else []))
    # All columns of sized go along as one, so none clashes with those added here.
    own = sized.select(F.struct(*sized.columns).alias("_row"), "doc_id", "source", "size", *([F.col(tie).alias("_tie")] if tie else []))
    rows = (
        own.join(side, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_share", near)
        .withColumn("_p", F.col("_share") - F.floor("_share"))
        .withColumn("_dice", dice)
        .withColumn("_block", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "_dice"), F.ceil(F.col("documents") / BLOCK)).cast("long"))
        .withColumn("_copy", F.lit(None).cast("int"))
        .drop("_source", "documents", "_tie")
    )
    most_blocks = targets.agg(F.max(F.ceil(F.col("documents") / BLOCK))).first()[0] or 1
    parts, schema = [], rows.schema
    while True:
        dealt = rows.repartition("_place", "_block").sortWithinPartitions("_place", "_block", F.desc("size"), "_dice", "doc_id")
        level = scratch.table(dealt.mapInArrow(_rounded, schema))
        parts.append(level.filter(F.col("_copy").isNotNull()))
        rows = level.filter(F.col("_copy").isNull())
        if most_blocks <= 1:  # the last fraction of a source is rounded alone
            chance = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 2), "_dice"), 11)) / F.lit(2.0**53)
            parts.append(rows.withColumn("_copy", F.when(chance < F.col("_p"), 1).otherwise(0)))
            break
        rows = rows.withColumn("_block", F.floor(F.col("_block") / FAN_IN).cast("long"))
        most_blocks = -(-most_blocks // FAN_IN)
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.unionByName(x)
    copies = (F.floor("_share") + F.col("_copy")).cast("long")
    name = free_name(sized, "mix")
    made = F.struct(F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    return whole.select(*(F.col("_row")[c].alias(c) for c in sized.columns), made.alias(name))
