"""A bitmap of hashes with a fixed size: a filter that may let too much through, and never too little."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 24  # 2 MB, whatever is put in


def build(hashes: DataFrame) -> bytes:
    """The bitmap of the low bits of column ``h``; tasks fold it to at most 512 pages of 4 KB."""
    low = hashes.select(F.col("h").bitwiseAND((1 << BITS) - 1).alias("low")).distinct()
    pages = low.groupBy(F.shiftright("low", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("low").bitwiseAND(32767)).alias("bits"))
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for page, bits in pages.toLocalIterator():
        out[page * 4096 : page * 4096 + 4096] = np.frombuffer(bits, np.uint8)
    return out.tobytes()


def passes(bitmap: bytes, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each 64-bit hash is set."""
    bits = np.frombuffer(bitmap, np.uint8)
    low = hashes.view(np.uint64) & np.uint64((1 << BITS) - 1)
    return (bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bits(hashes: DataFrame) -> DataFrame:
    """The same bitmap as one row with one array of 2^18 longs, made and used without leaving the JVM."""
    low = hashes.select(F.col("h").bitwiseAND((1 << BITS) - 1).alias("low"))
    words = low.groupBy(F.shiftright("low", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(low & 63 as int))")).alias("b"))
    every = hashes.sparkSession.range(0, 1 << (BITS - 6)).join(words, "id", "left").select("id", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "b"))), lambda x: x.b).alias("bits"))


def holds(one_row: DataFrame, h) -> F.Column:
    """Whether the bit of ``h`` is set in the result of :func:`bits`, as a scalar subquery."""
    low = h.bitwiseAND((1 << BITS) - 1)
    return F.bit_get(F.get(one_row.scalar(), F.shiftright(low, 6).cast("int")), low.bitwiseAND(63).cast("int")) == 1
