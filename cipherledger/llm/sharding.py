"""Sharding by extendible hashing, in DataFrame operations only.

A document's place is a string of bits: 60 bits of md5(doc_id), then 60 bits of
md5(text) and, for rows that agree in both, bits of the row's number. The directory
is indexed by a prefix of these bits. It starts at the depth that the total size
asks for; only buckets beyond the byte limit are split on one more bit, and only
their rows are looked at again. Each round reads counts of prefixes, not rows:
rows are summed once into cells STEP bits finer than the current depth.

Defined results: a null doc_id or text hashes and weighs like the empty text;
repeated rows are dealt by row number; an empty table gives an empty table; a
single document larger than the limit is a shard of its own with ``oversized``
true; one shard alone has the empty prefix.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherledger.session import written

LIMIT = 1 << 20  # bytes of UTF-8 text in a shard: what a loader reads at once
STEP = 8
WORD = 60  # bits in each of the three hash words
MAX_DEPTH = 3 * WORD


def _bits(text) -> F.Column:
    return F.lpad(F.bin(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")), WORD, "0")


def _prefix(depth) -> F.Column:
    return F.substring("place", F.lit(1), depth if isinstance(depth, F.Column) else F.lit(depth))


def places(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_bytes, place: a narrow table, written once, that all rounds read."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.concat(_bits(key), _bits(text)).alias("head"),
        F.monotonically_increasing_id().alias("row"),
    )
    return written(narrow.select("row", "doc_id", "n_bytes", F.concat("head", _bits(F.col("row").cast("string"))).alias("place")), "places")


def directory(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """shard (bit prefix), depth, n_docs, shard_bytes: the leaves of the directory."""
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    depth = max(0, math.ceil(math.log2(max(1, total) / limit)))  # of the first directory; a prefix is its index
    depth = max(0, depth - 1)
    left, done = rows, None
    while True:
        finest = min(depth + STEP, MAX_DEPTH)
        cells = left.groupBy(_prefix(finest).alias("place")).agg(
            F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_docs"), F.max("n_bytes").alias("largest")
        )
        cells = written(cells, "cells")
        levels = cells.select("place", "n_bytes", "n_docs", F.explode(F.sequence(F.lit(depth), F.lit(finest))).alias("depth"))
        sums = levels.groupBy(_prefix(F.col("depth")).alias("shard"), "depth").agg(
            F.sum("n_bytes").alias("shard_bytes"), F.sum("n_docs").alias("n_docs")
        )
        fits = (F.col("shard_bytes") <= limit) | (F.col("n_docs") == 1) | (F.col("depth") == MAX_DEPTH)
        sums = written(sums.withColumn("fits", fits), "sums")
        # a leaf fits and the bucket it was split from, if this round saw it, does not
        parents = sums.filter(~F.col("fits")).select(F.col("shard").alias("parent"), (F.col("depth") + 1).alias("depth"))
        leaf = sums.filter("fits").withColumn("parent", F.substring("shard", F.lit(1), F.greatest(F.col("depth") - 1, F.lit(0))))
        leaves = leaf.join(parents, ["parent", "depth"], "left_semi").unionByName(leaf.filter(F.col("depth") == depth))
        leaves = leaves.select("shard", "depth", "n_docs", "shard_bytes")
        done = leaves if done is None else done.unionByName(leaves)
        over = sums.filter((F.col("depth") == finest) & ~F.col("fits")).select(F.col("shard").alias("over"))
        if over.isEmpty():
            return done
        left = written(left.join(over, _prefix(finest) == F.col("over"), "left_semi"), "oversized")
        depth = finest + 1


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row a document: doc_id, n_bytes, shard, depth, shard_bytes, oversized."""
    rows = places(docs)
    leaves = written(directory(rows, limit), "directory")
    depths = [r[0] for r in leaves.select("depth").distinct().collect()]  # MAX_DEPTH + 1 at most
    # a document's leaf is the one prefix of its place that the directory holds
    prefixes = F.array(*[_prefix(d) for d in sorted(depths)]) if depths else F.array(F.lit(""))
    asked = rows.select("doc_id", "n_bytes", F.explode(prefixes).alias("shard"))
    return asked.join(leaves, "shard").select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", (F.col("shard_bytes") > limit).alias("oversized"))


def write_shards(docs: DataFrame, folder: str, limit: int = LIMIT) -> None:
    """Write documents as Parquet, one folder a shard; rows meet their shard by doc_id."""
    where = shards(docs, limit).select(F.col("doc_id").alias("_doc"), "shard").distinct()
    joined = docs.join(where, F.col("doc_id").eqNullSafe(F.col("_doc"))).drop("_doc")
    joined.repartition("shard").write.partitionBy("shard").parquet(folder)
