"""Joins within groups, in blocks: a large group is cut into blocks, and each pair of blocks is a task's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_blocks(df: DataFrame, group: Column, member: Column, n_blocks: Column) -> DataFrame:
    """Repeat each row for the pairs of blocks that its block is in: adds bk_key (of the pair), bk_block, bk_low, bk_high.

    Rows of one (group, pair) follow each other in the result. A group of one block is not repeated; a group of b blocks
    is repeated b times, and rows meet in exactly one pair of blocks (those of one block where low = high).
    """
    d = df.withColumn("bk_block", F.pmod(F.xxhash64(member), n_blocks).cast("int"))
    d = d.withColumn("bk_other", F.explode(F.sequence(F.lit(0), (n_blocks - 1).cast("int"))))
    d = d.withColumns({"bk_low": F.least("bk_block", "bk_other"), "bk_high": F.greatest("bk_block", "bk_other")})
    d = d.withColumn("bk_key", F.xxhash64(group, F.lit(1), "bk_low", "bk_high")).drop("bk_other")
    return d.repartition("bk_key").sortWithinPartitions("bk_key")
