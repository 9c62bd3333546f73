"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source gets a target number of words from its weight. Blocks of equal size are
then apportioned: to the sources by the highest quotients target / (2k - 1), and each
source's seats in the same way to groups of shards and to their shards. A shard takes
its quota as whole passes over its blocks and a run of blocks that starts at a seeded
place of its seeded document order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeflow.llm.common import WORD, saved

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source is repeated so many times at most.
MOST_REPEATS = 3
#: Words in a block at most, and blocks that the smallest target holds at least.
BLOCK_WORDS = 1024
LEAST_BLOCKS = 256
#: Words of a source in one of its shards, and shards in a group, about.
SHARD_WORDS = 1 << 16
GROUP_SHARDS = 1 << 12


def seeded(seed: int, *columns) -> Column:
    """A non-negative long that is a fixed function of the seed and the columns."""
    text = F.concat_ws("/", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def apportion(items: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``quota``: the ``seats`` of each ``by`` dealt to its items by ``votes``.

    Sainte-Laguë: the seats go to the highest quotients votes / (2k - 1); ties go to
    the first item in ``order``. Rounding each item's share gives at most half as many
    seats too few or too many as there are items, so the exact result differs from it,
    for an item with share p, by no more than p * (that + items + 1) + 1. Only the
    quotients in this range are ranked: a few rows per item. Items without votes get
    no seats.
    """
    all_items = Window.partitionBy(*by)
    share = F.col("votes") / F.sum("votes").over(all_items)
    start = (
        items.withColumn("_share", F.when(F.col("votes") > 0, share))
        .withColumn("_round", F.floor(F.col("seats") * F.col("_share") + 0.5))
        .withColumn("_off", F.abs(F.col("seats") - F.sum("_round").over(all_items)))
        .withColumn(
            "_reach",
            F.ceil(F.col("_share") * (F.col("_off") + F.count("*").over(all_items) + 1)) + 1,
        )
        .withColumn("_sure", F.greatest(F.lit(0), F.col("_round") - F.col("_reach")))
        .withColumn("_open", F.col("seats") - F.sum("_sure").over(all_items))
    )
    ranks = Window.partitionBy(*by).orderBy(F.col("_quotient").desc(), *order)
    won = (
        start.where(F.col("_share").isNotNull())
        .withColumn("_k", F.explode(F.sequence(F.col("_sure") + 1, F.col("_round") + F.col("_reach"))))
        .withColumn("_quotient", F.col("votes") / (2 * F.col("_k") - 1))
        .withColumn("_rank", F.row_number().over(ranks))
        .groupBy(*by, *order)
        .agg(
            (F.max("_sure") + F.sum((F.col("_rank") <= F.col("_open")).cast("long"))).alias("_won")
        )
    )
    return (
        items.join(won, [*by, *order], "left")
        .withColumn("quota", F.coalesce("_won", F.lit(0)).cast("long"))
        .drop("_won")
    )


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most_repeats: int = MOST_REPEATS
) -> DataFrame:
    """Targets of the sources: (source, source_size) with rank, target and all words.

    The sources by code point, null last, weigh ``weights`` in turn. The share of all
    words by weight stops at ``most_repeats`` times the source's size, the excess goes
    to the others by weight until none is above. In closed form: target = min(cap,
    level * weight), where the level is that of the first source, by cap / weight, that
    stays below its cap. One row per source, so one task.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        sizes.withColumn("rank", F.row_number().over(everything))
        .withColumn("weight", F.element_at(cycle, (F.col("rank") - 1) % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * most_repeats)
    )
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    whole = Window.partitionBy()
    return (
        ranked.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("_capped", F.sum("cap").over(by_cap) - F.col("cap"))
        .withColumn(
            "_weights", F.sum("weight").over(whole) - F.sum("weight").over(by_cap) + F.col("weight")
        )
        .withColumn("_level", (F.col("total") - F.col("_capped")) / F.col("_weights"))
        .withColumn(
            "level",
            # Too low for later sources, which would count uncapped ones as capped.
            F.max(F.when(F.col("_level") * F.col("weight") <= F.col("cap"), F.col("_level"))).over(whole),
        )
        .withColumn(
            "target",
            F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))),
        )
        .select("rank", "source", "source_size", "target", "total")
    )


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    most_repeats: int = MOST_REPEATS,
    block_words: int = BLOCK_WORDS,
    seed: int = 2,
) -> DataFrame:
    """How many words of every document the mix takes, repeats counted.

    ``docs`` needs ``doc_id``, ``text`` and ``source``. Returns doc_id, source, size
    (words), source_size, target, taken. A document is taken at most ``most_repeats``
    times. Null texts and texts without words have size 0 and are never taken; a null
    source is a source of its own. A repeated row is a document of its own. An empty
    table gives no rows.

    The block has ``block_words`` words, or fewer so that the smallest target still
    holds ``LEAST_BLOCKS`` blocks. Blocks are runs of words of one source and shard;
    the shards' documents stand in a seeded order, so a run of blocks is a random draw.
    A source has as many shards as its own words fill with ``SHARD_WORDS`` each, so blocks
    are about equal in all sources however many there are. Documents are dealt to them by a
    hash of doc_id, or of the text where there is none, which also splits a source that
    holds most rows. One shuffle orders the documents, carrying three numbers each.
    """
    rows = saved(
        docs.select(
            "doc_id",
            "source",
            word_count().alias("size"),
            F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("_text"),
        ).select("doc_id", "source", "size", seeded(seed, "doc_id", "_text").alias("place")),
        "sizes",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = saved(source_targets(sizes, weights, most_repeats), "targets")
    total, smallest = targets.agg(
        F.max("total"), F.min(F.when(F.col("target") > 0, F.col("target")))
    ).first()
    total, smallest = total or 0, smallest or 0.0
    block = max(1, min(block_words, int(smallest // LEAST_BLOCKS)))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS))
    rows = (
        rows.join(
            targets.select(F.col("source").alias("_source"), "rank", "source_size", "target"),
            F.col("source").eqNullSafe(F.col("_source")),
        )
        .drop("_source")
        .withColumn("shard", F.col("place") % shards)
    )
    cells = (
        rows.groupBy("rank", "shard")
        .agg(F.sum("size").alias("words"))
        .withColumn(
            "blocks",
            F.when(F.col("words") > 0, F.greatest(F.lit(1), F.round(F.col("words") / block).cast("long")))
            .otherwise(0)
            .cast("long"),
        )
        .withColumn("group", F.floor(F.col("shard") / GROUP_SHARDS))
    )
    cells = saved(cells, "cells")
    groups = cells.groupBy("rank", "group").agg(F.sum("blocks").alias("votes"))
    # Seats of a source: its share of all blocks, in whole passes at most.
    source_seats = apportion(
        targets.select(
            F.lit(0).alias("all"),
            "rank",
            F.col("target").alias("votes"),
            F.lit(round(total / block)).cast("long").alias("seats"),
        ),
        ["all"],
        ["rank"],
    ).select("rank", F.col("quota").alias("wanted"))
    there = groups.groupBy("rank").agg(F.sum("votes").alias("there"))
    # Each apportioning names its items twice, so the plan of three in a row, which the
    # driver plans anew after every stage, would double with each.
    seats = saved(
        source_seats.join(there, "rank").select(
            "rank", F.least("wanted", F.col("there") * most_repeats).alias("seats")
        ),
        "seats",
    )
    group_seats = saved(
        apportion(groups.join(seats, "rank"), ["rank"], ["group"]).select(
            "rank", "group", F.col("quota").alias("seats")
        ),
        "group-seats",
    )
    quotas = apportion(
        cells.withColumn("votes", F.col("blocks")).join(group_seats, ["rank", "group"]),
        ["rank", "group"],
        ["shard"],
    )
    quotas = saved(quotas, "quotas")

    def bound(block_number: Column) -> Column:
        # Blocks of a shard differ by a word at most.
        return F.floor(block_number * F.col("words") / F.col("blocks")).cast("long")

    runs = (
        quotas.where(F.col("blocks") > 0)
        .withColumn("passes", F.floor(F.col("quota") / F.col("blocks")))
        .withColumn("rest", F.col("quota") % F.col("blocks"))
        .withColumn("first", seeded(seed, "rank", "shard") % F.col("blocks"))
        .withColumn("last", F.col("first") + F.col("rest"))
        .select(
            "rank",
            "shard",
            "passes",
            bound(F.col("first")).alias("from_1"),
            bound(F.least("last", "blocks")).alias("to_1"),
            bound(F.greatest(F.col("last") - F.col("blocks"), F.lit(0))).alias("to_2"),
        )
    )
    order = Window.partitionBy("rank", "shard").orderBy("place", "doc_id", "size")
    before_end = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("end")
    start = F.col("end") - F.col("size")

    def overlap(low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0), F.least(end, high) - F.greatest(start, low))

    taken = (
        F.col("passes") * F.col("size")
        + overlap(F.col("from_1"), F.col("to_1"))
        + overlap(F.lit(0), F.col("to_2"))
    )
    return (
        rows.withColumn("end", F.sum("size").over(before_end))
        .join(runs, ["rank", "shard"], "left")
        .select(
            "doc_id",
            "source",
            "size",
            F.col("source_size").cast("long").alias("source_size"),
            F.col("target").cast("double").alias("target"),
            F.coalesce(taken, F.lit(0)).cast("long").alias("taken"),
        )
    )
