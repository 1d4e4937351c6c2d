"""Taking rows out of a table of documents without shuffling the texts of the others.

A row is known by doc_id and the hash of its text. A fixed bitmap of the keys that
go lets all rows that cannot be meant pass by; only the rest is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherledger.llm import bitmap
from cipherledger.session import written


def text_hash() -> F.Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def without(docs: DataFrame, gone: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """``docs`` without the rows of ``gone`` and with one row of each of ``once`` (both: doc_id, text_hash).

    A document is one struct meanwhile, so that no column of it meets a column of this function.
    """
    lost = written(gone.select("doc_id", "text_hash").distinct().toDF("lost_id", "lost_hash").withColumn("lost_key", F.xxhash64("lost_id", "lost_hash")), "gone")
    marked = lost.select(F.col("lost_key").alias("h"))
    if once is not None:
        marked = marked.unionByName(once.select(F.xxhash64("doc_id", "text_hash").alias("h")))
    hit = written(bitmap.bits(marked), "bits")
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", text_hash().alias("text_hash"))
    keyed = keyed.withColumn("key", F.xxhash64("doc_id", "text_hash"))
    touched = bitmap.holds(hit, F.col("key"))
    on = (F.col("key") == F.col("lost_key")) & F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("text_hash") == F.col("lost_hash"))
    met = keyed.filter(touched).join(lost, on, "left_anti")
    if once is not None:
        met = met.dropDuplicates(["doc_id", "text_hash"])
    return keyed.filter(~touched).select("doc.*").unionByName(met.select("doc.*"))
