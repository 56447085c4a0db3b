"""Chat logs without snapshots of conversations that went on, rendered for training.

Method: cumulative-snapshot collapse. Each turn gets the rolling hash of all turns up to
it. A conversation whose last hash is the hash of a longer one at the same place is a
snapshot of it; an anti-join keeps the others, of equal ones the smallest id, and their
turns are rendered. DataFrame functions only.

The rolling hash combines hashes salted with the turn's place, so it is computed per block
of turns and then over the blocks: no conversation is one task's group, however long it
is. Blocks are cut by turn number; those of the at most ``HEAVY`` conversations that hold one in
so many of all turns, such as the rows without an id, by ranges of the sorted turns, which also
part turns that share a number. Only hashes and keys are compared. The result has a row per
turn for the same reason.

Defined results: turns of a conversation are ordered by number, null first, then by role
and text, so repeated rows are turns of their own; null roles and texts are empty; rows
without an id are one conversation; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palestra.llm.scratch import Scratch

BLOCK = 1024
HEAVY = 10_000


def in_blocks(given: DataFrame, block: int, scratch: Scratch) -> DataFrame:
    """The turns with the number of their block, which rises with their order. Conversations
    that are heavy are cut anew, into ranges."""
    total = given.count()
    counts = given.groupBy("conv_key").agg(F.count("*").alias("n"))
    heavy = scratch.table(
        counts.where((F.col("n") > block) & (F.col("n") * HEAVY >= total)).select("conv_key"), "heavy"
    )  # at most HEAVY rows
    if heavy.isEmpty():
        return given
    # equal rows are interchangeable, and parted by where they come from
    some = given.join(F.broadcast(heavy), "conv_key", "left_semi").withColumn("from", F.monotonically_increasing_id() % 1024)
    ranges = some.repartitionByRange("conv_key", F.col("turn").asc_nulls_first(), "role", "text", "from")
    cut = scratch.table(ranges.withColumn("block", F.spark_partition_id().cast("long")).drop("from"), "ranges")
    light = given.join(F.broadcast(heavy), "conv_key", "left_anti")
    return light.unionByName(cut)


def hashed_turns(conversations: DataFrame, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """The turns with their position from 0 and the rolling hashes up to them."""
    scratch = scratch or Scratch(conversations.sparkSession)
    given = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumns(
        {"conv_key": F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("none")),
         "block": F.coalesce(F.floor(F.col("turn") / block), F.lit(-(2**62))).cast("long")}
    )
    given = in_blocks(given, block, scratch)
    blocks = Window.partitionBy("conv_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = given.groupBy("conv_key", "block").agg(F.count("*").alias("n")).select(
        "conv_key", "block", F.coalesce(F.sum("n").over(blocks), F.lit(0)).alias("skip")
    )
    inside = Window.partitionBy("conv_key", "block").orderBy("turn", "role", "text")
    placed = given.withColumn("own", F.row_number().over(inside)).join(before, ["conv_key", "block"]).withColumn(
        "position", F.col("skip") + F.col("own") - 1
    )
    salted = placed.withColumns(
        {f"h{k}": F.xxhash64(F.lit(k), "position", "role", "text") for k in (1, 2)}
    ).select("conv_id", "conv_key", "block", "position", "role", "text", "h1", "h2")
    total = salted.groupBy("conv_key", "block").agg(*[F.bit_xor(h).alias(h) for h in ("h1", "h2")]).select(
        "conv_key", "block", *[F.coalesce(F.bit_xor(h).over(blocks), F.lit(0)).alias(f"{h}_before") for h in ("h1", "h2")]
    )
    so_far = Window.partitionBy("conv_key", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rolling = salted.withColumns({f"run{k}": F.bit_xor(f"h{k}").over(so_far) for k in (1, 2)}).join(
        total, ["conv_key", "block"]
    )
    return rolling.select(
        "conv_id", "conv_key", "position", "role", "text",
        *[F.col(f"run{k}").bitwiseXOR(F.col(f"h{k}_before")).alias(f"hash{k}") for k in (1, 2)],
    )


def maximal(turns: DataFrame) -> DataFrame:
    """Keys and lengths of the conversations that no other one continues or, with a smaller
    id, equals."""
    state = ["position", "hash1", "hash2"]
    keys = turns.select("conv_id", "conv_key", *state)
    ends = keys.groupBy("conv_key").agg(F.max(F.struct(*state, "conv_id")).alias("end")).select("conv_key", "end.*")
    going_on = keys.join(ends.select("conv_key", "position"), ["conv_key", "position"], "left_anti").select(*state).distinct()
    kept = ends.join(going_on, state, "left_anti")
    order = F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "conv_key")
    return kept.groupBy(*state).agg(F.min(order).alias("first")).select(
        F.col("first.conv_key").alias("conv_key"), (F.col("position") + 1).alias("n_turns")
    )


def rendered(conversations: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per turn of the kept conversations; joined in order they are the training text."""
    scratch = scratch or Scratch(conversations.sparkSession)
    turns = scratch.table(hashed_turns(conversations, scratch=scratch), "turns")
    kept = scratch.table(maximal(turns), "kept")
    return turns.join(kept, "conv_key").select(
        "conv_id", "position", "n_turns", "role",
        F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>\n")).alias("rendered"),
    )
