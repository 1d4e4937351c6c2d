"""Sets of names by group in long form: members as rows, equality by digests.

A set is never one value. Members are distinct (group, item) rows, combined where they are
read; differences of two families of sets come from one aggregation over (group, item), so
a group with a third of all rows spreads over tasks by its items. Equality needs no members
at all: a digest does not depend on order and is a sum, so it is combined map-side too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DIGITS = 14  # hexadecimal digits of one summand: 56 bits, so that 2^70 of them fit in a decimal


def members(rows: DataFrame, group: str, item: str) -> DataFrame:
    """Distinct (group, item) rows; null items are no members."""
    return rows.select(group, item).filter(F.col(item).isNotNull()).distinct()


def digests(sets: DataFrame, group: str, item: str) -> DataFrame:
    """group, n, digest of distinct (group, item) rows; sets are equal when both agree.

    The digest has two sums of independent 56 bits of each item's sha256.
    """
    name = F.sha2(F.col(item).cast("string"), 256)

    def summed(start: int) -> Column:
        return F.sum(F.conv(F.substring(name, start, _DIGITS), 16, 10).cast("decimal(20,0)")).cast("string")

    return sets.groupBy(group).agg(F.count("*").alias("n"), F.concat_ws("-", summed(1), summed(1 + _DIGITS)).alias("digest"))


def compared(left: DataFrame, right: DataFrame, group: str, item: str) -> DataFrame:
    """group, item, in_left, in_right of every member of either family."""
    flagged = [
        sets.select(group, item, F.lit(side == 0).alias("in_left"), F.lit(side == 1).alias("in_right")) for side, sets in enumerate((left, right))
    ]
    return flagged[0].unionByName(flagged[1]).groupBy(group, item).agg(F.bool_or("in_left").alias("in_left"), F.bool_or("in_right").alias("in_right"))


def differences(found: DataFrame, expected: DataFrame, group: str, item: str) -> DataFrame:
    """group, item, side: 'missing' from found or 'extra' beyond expected."""
    rows = compared(found, expected, group, item).filter(F.col("in_left") != F.col("in_right"))
    return rows.select(group, item, F.when(F.col("in_left"), "extra").otherwise("missing").alias("side"))


def relations(left: DataFrame, right: DataFrame, group: str, item: str) -> DataFrame:
    """group, n_both, n_left_only, n_right_only, is_subset (right within left), is_equal."""
    rows = compared(left, right, group, item).groupBy(group).agg(
        F.count_if(F.col("in_left") & F.col("in_right")).alias("n_both"), F.count_if(~F.col("in_right")).alias("n_left_only"),
        F.count_if(~F.col("in_left")).alias("n_right_only"),
    )
    return rows.withColumns({"is_subset": F.col("n_right_only") == 0, "is_equal": (F.col("n_right_only") == 0) & (F.col("n_left_only") == 0)})
