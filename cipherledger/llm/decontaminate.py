"""Benchmark decontamination by winnowed fingerprints.

Of every run of ``WINDOW - GRAM + 1`` consecutive GRAM-word hashes the smallest is
kept (the rightmost of equals), so any WINDOW words that a document and an item
share carry a fingerprint that both keep. Fingerprints meet in an equality join
and each hit is extended to both sides over the words around it; windows that
agree as a whole are hits. Items with fewer than WINDOW words are compared as one
window of their own length.

A fixed bitmap of fingerprint hashes (2 MB whatever the benchmark's size) goes to
all tasks; documents emit only fingerprints whose bit is set, so the shuffle
follows the number of hits and not the corpus. The bitmap only saves work: a full
one would let everything through to the same join.

Defined results: null or wordless texts have no words and no hits, and a wordless
item never occurs; repeated items count by their distinct item_ids; null item_ids
are left out of the list; every document row gives a row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cipherledger.llm import bitmap, rows, words
from cipherledger.session import written

WINDOW = 10
GRAM = 6

_HIT = T.StructType().add("fp", "long").add("at", "integer").add("size", "integer").add("around", T.ArrayType(T.LongType()))


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash (rightmost of equals) of every ``window`` consecutive hashes."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at = hashes[:n].copy(), np.arange(n)
    for j in range(1, window):
        better = hashes[j : j + n] <= best
        best = np.where(better, hashes[j : j + n], best)
        at = np.where(better, np.arange(j, j + n), at)
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


def _around(full: np.ndarray, at: int, start: int, end: int) -> list:
    """Hashes of the whole windows that hold the fingerprint at ``at``: entry o starts o words before it."""
    out = []
    for o in range(WINDOW - GRAM + 1):
        s = at - o
        out.append(int(full[s].view(np.int64)) if start <= s and s + WINDOW <= end else None)
    return out


def _fingerprints(h: np.ndarray, sizes, passes) -> list[tuple]:
    """(fingerprint, position, window size, windows around it) of one document's word hashes."""
    found = []
    n = len(h)
    if n >= WINDOW:
        grams = words.window_hashes(h, GRAM)
        at = winnow(grams, WINDOW - GRAM + 1)
        at = at[passes(grams[at])]
        if len(at):
            full = words.window_hashes(h, WINDOW)
            found += [(int(grams[a].view(np.int64)), int(a), WINDOW, _around(full, int(a), 0, n)) for a in at]
    for m in sizes:
        if n >= m:
            whole = words.window_hashes(h, m)
            at = np.flatnonzero(passes(whole))
            found += [(int(whole[a].view(np.int64)), int(a), m, None) for a in at]
    return found


def _scan(texts: DataFrame, key: str, sizes: list[int] | None, filtering) -> DataFrame:
    """Of each row: key, n_words and its fingerprints. Without sizes the rows are items and keep all of theirs."""
    import pyarrow as pa

    kind = texts.schema[key].dataType
    hits = pa.list_(pa.struct([("fp", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), ("around", pa.list_(pa.int64()))]))

    def run(batches):
        def passes(x):
            return np.ones(len(x), bool) if filtering is None else bitmap.passes(filtering.value, x)

        for batch in batches:
            all_texts = words.utf8(batch.column(1))
            counts, found = [], []
            for a, b in words.batches(all_texts):
                h, off = words.word_hashes(all_texts[a:b], words.ALNUM)
                for i in range(b - a):
                    own = h[off[i] : off[i + 1]]
                    counts.append(len(own))
                    short = sizes if sizes is not None else [len(own)] if 0 < len(own) < WINDOW else []
                    found.append([dict(zip(("fp", "at", "size", "around"), x, strict=True)) for x in _fingerprints(own, short, passes)])
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, hits)]
            yield pa.RecordBatch.from_arrays(columns, [key, "n_words", "hits"])

    out = T.StructType([T.StructField(key, kind), T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(_HIT))])
    return texts.select(key, F.col("text").cast("string").alias("text")).mapInArrow(run, out)


def hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents: row, doc_id, n_words; spans: row, item_id, start, end in words) of all shared windows."""
    items = written(_scan(benchmark, "item_id", None, None), "benchmark-prints")
    sizes = [r[0] for r in items.select(F.explode("hits.size").alias("size")).filter(F.col("size") < WINDOW).distinct().collect()]  # nine at most
    filtering = docs.sparkSession.sparkContext.broadcast(bitmap.build(items.select(F.explode("hits.fp").alias("h"))))
    scanned = written(_scan(docs, "doc_id", sorted(sizes), filtering).withColumn("row", F.monotonically_increasing_id()), "document-prints")
    d = scanned.select("row", F.explode("hits").alias("d")).select("row", "d.*")
    b = (
        items.select("item_id", F.explode("hits").alias("b"))
        .select("item_id", F.col("b.fp").alias("fp"), F.col("b.size").alias("size"), F.col("b.around").alias("other"))
        .distinct()
    )
    met = d.join(b, ["fp", "size"])
    # extension: o words to the left of the fingerprint start a window that agrees on both sides
    starts = F.expr(f"transform(filter(sequence(0, {WINDOW - GRAM}), o -> around[o] = other[o]), o -> at - o)")
    long = met.filter(F.col("size") == WINDOW).select("row", "item_id", F.explode(starts).alias("start"), F.lit(WINDOW).alias("size"))
    short = met.filter(F.col("size") < WINDOW).select("row", "item_id", F.col("at").alias("start"), "size")
    spans = long.unionByName(short).distinct().select("row", "item_id", "start", (F.col("start") + F.col("size")).alias("end"))
    return scanned.select("row", "doc_id", "n_words"), spans


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row, doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), spans (start, end; sorted), contaminated."""
    every, spans = hits(docs, benchmark)
    places = spans.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    names = spans.groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    covered = F.expr(
        "aggregate(spans, named_struct('n', 0L, 'to', 0), (a, s) -> named_struct("
        "'n', a.n + greatest(0, s.end - greatest(a.to, s.start)), 'to', greatest(a.to, s.end)), a -> a.n)"
    )
    none = F.array().cast("array<string>")
    return (
        every.join(places.join(names, "row"), "row", "left")
        .withColumn("n_hit", F.coalesce(covered, F.lit(0).cast("long")))
        .withColumn("item_ids", F.coalesce("item_ids", none))
        .withColumn("n_items", F.size("item_ids").cast("long"))
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit, all columns kept."""
    keyed = docs.select(F.struct("doc_id", rows.text_hash().alias("text_hash")).alias("doc_id"), "text")
    return rows.without(docs, contamination(keyed, benchmark).filter("contaminated").select("doc_id.*"))
