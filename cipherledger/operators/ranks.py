"""Positions within groups without a task for each group.

A window numbers the rows of a group in one task; a group with a third of all rows then
ends up there. Here rows are dealt by range of (group, order), so that a large group
spreads over neighbouring partitions. A row's position is its place among the rows of its
group in its partition, plus the rows of the group in the partitions before; those are
counted once, one row a group and partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cipherledger.session import written

_WITHIN = 33  # bits of the row number within a partition in a monotonically increasing id


def positioned(rows: DataFrame, group: str, order: list[str], name: str = "position") -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... within each group, by ``order``; rows that agree in it stand in any order.

    Nulls come first. The numbered rows are stored, so that every reader sees the same numbers.
    """
    whole = F.struct(*rows.columns)
    keyed = rows.select(F.col(group).alias("g"), F.struct(*order).alias("o"), whole.alias("row"))
    dealt = keyed.repartitionByRange("g", "o").sortWithinPartitions("g", "o").withColumn("id", F.monotonically_increasing_id())
    stored = written(dealt.select("g", "row", F.shiftright("id", _WITHIN).alias("part"), (F.col("id") % (1 << _WITHIN)).alias("at")), "positions")
    parts = stored.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select(F.col("g").alias("of"), F.col("part").alias("of_part"), (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    joined = stored.join(starts, F.col("g").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    return joined.select("row.*", (F.col("at") + F.col("shift")).alias(name))
