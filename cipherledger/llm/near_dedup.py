"""MinHash near-dedup: many universal hash minima, banding, signature verification, star components.

A document's set is its distinct SHINGLE-word shingles, as 64-bit hashes. LANES
multiply-shift minima make the signature; BANDS bands of ROWS lanes make bucket
keys. Two documents are near copies from a Jaccard similarity of ``similar`` percent
on (SIMILAR unless given); at 0.85 they miss all buckets with probability
(1 - 0.85^5)^30 = 2e-8, at 0.8 with 7e-6.

Equal sets collapse first, by a 128-bit digest, so a group of copies is one node.
In every bucket all nodes are then held against one pivot, and against other
pivots in further rounds; nodes that already share a component need no further
comparison, which keeps a large group of near copies linear. What is left are the
buckets whose nodes are still in different components: there the nodes outside the
largest component are compared with all others, signatures first and then full sets,
in blocks of about BLOCK by BLOCK shingles inside the tasks; only links that join two
components come out. Every link has passed the signature test (``least`` equal lanes,
missed with probability below MISS) and is confirmed on the full sets; links
between components are lost by banding or by the signature test alone.

Defined results: null, empty and wordless texts have an empty set and stay alone;
texts of fewer than SHINGLE words have one shingle, the whole sequence; repeated
rows are copies of each other; a null doc_id is the smallest only where all of a
component are null; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cipherledger.llm import bitmap, rows, words
from cipherledger.llm.components import connected
from cipherledger.session import written

SHINGLE = 5
BANDS = 30
ROWS = 5
LANES = BANDS * ROWS
SIMILAR = 85  # percent
MISS = 2e-8
PIVOTS = 2
BLOCK = 150_000  # shingles on each side of a block

_rng = np.random.default_rng(77)
_LANE = (_rng.integers(1, 2**63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_ROW = _rng.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def least(similar: int) -> int:
    """The most equal lanes to ask for that a pair of exactly this similarity misses with probability below MISS."""
    p, below, n = similar / 100, 0.0, 0
    while n < LANES:
        below += math.comb(LANES, n) * p**n * (1 - p) ** (LANES - n)
        if below >= MISS:
            break
        n += 1
    return n


def shingles(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingles of a document's word hashes."""
    if not len(h):
        return np.empty(0, np.uint64)
    return np.unique(words.window_hashes(h, min(size, len(h))))


def signature(s: np.ndarray) -> np.ndarray:
    """The minima of all lanes over a non-empty set."""
    best = np.full(LANES, 2**64 - 1, np.uint64)
    for at in range(0, len(s), 256):
        np.minimum(best, (s[None, at : at + 256] * _LANE).min(1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def digest(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums over a set."""
    low, high = np.add.reduce(words.mix(s ^ np.uint64(0x5851F42D4C957F2D))), np.add.reduce(words.mix(s + np.uint64(0x14057B7EF767814F)))
    return int(np.int64(low.astype(np.int64))), int(np.int64(high.astype(np.int64)))


def bands(sig: np.ndarray) -> np.ndarray:
    return words.mix((sig.astype(np.uint64).reshape(BANDS, ROWS) * _ROW).sum(1, dtype=np.uint64) + _BAND).view(np.int64)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, d1, d2, sig, bands of every row."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            texts = words.utf8(batch.column(2))
            sizes, d1, d2, sigs, keys = [], [], [], [], []
            for a, b in words.batches(texts):
                h, off = words.word_hashes(texts[a:b], words.SPACED)
                for i in range(b - a):
                    s = shingles(h[off[i] : off[i + 1]])
                    sizes.append(len(s))
                    x, y = digest(s)
                    d1.append(x)
                    d2.append(y)
                    sig = signature(s) if len(s) else None
                    sigs.append(None if sig is None else sig.tobytes())
                    keys.append(None if sig is None else bands(sig))
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, out.names)

    out = T.StructType([docs.schema["doc_id"]]).add("text_hash", "long").add("n_shingles", "long").add("d1", "long").add("d2", "long")
    out = out.add("sig", "binary").add("bands", T.ArrayType(T.LongType()))
    return docs.select("doc_id", rows.text_hash(), F.col("text").cast("string")).mapInArrow(run, out)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, sig, set of the wanted nodes (node, doc_id, d1, d2, sig): texts are read again and not shuffled."""
    import pyarrow as pa

    key = F.xxhash64(F.col("doc_id").cast("string"))
    filtering = docs.sparkSession.sparkContext.broadcast(bitmap.build(wanted.select(key.alias("h"))))

    def run(batches):
        for batch in batches:
            asked = np.flatnonzero(bitmap.passes(filtering.value, np.asarray(batch.column(0))))
            texts = words.utf8(batch.column(1).take(pa.array(asked)))
            d1, d2, sets = [], [], []
            for a, b in words.batches(texts):
                h, off = words.word_hashes(texts[a:b], words.SPACED)
                for i in range(b - a):
                    s = shingles(h[off[i] : off[i + 1]])
                    x, y = digest(s)
                    d1.append(x)
                    d2.append(y)
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["d1", "d2", "set"])

    found = docs.select(key, F.col("text").cast("string")).mapInArrow(run, "d1 bigint, d2 bigint, set array<bigint>")
    return written(found.join(wanted.select("node", "d1", "d2", "sig"), ["d1", "d2"]).select("node", "sig", "set").dropDuplicates(["node"]), "sets")


def _alike(pairs: DataFrame, similar: int) -> DataFrame:
    """Of (a, b, sig_a, sig_b) the pairs whose signatures agree in enough lanes."""
    import pyarrow as pa

    enough = least(similar)

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, LANES) for i in (2, 3))
            keep = pa.array((x == y).sum(1) >= enough) if batch.num_rows else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a bigint, b bigint")


def _size_fits(a: str, b: str, similar: int) -> F.Column:
    return (100 * F.least(a, b)) >= (similar * F.greatest(a, b))


def _confirmed(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - both
    return pairs.join(left, "a").join(right, "b").filter(100 * both >= similar * either).select("a", "b")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("node"))
    named = labels.select("node", F.col("component").alias("label"))
    return members.join(named, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _pivot_pairs(m: DataFrame, turn: int, sets: DataFrame, similar: int) -> DataFrame:
    """In every bucket of several components all nodes against one, the same one in as many buckets as possible.

    At first that is the node that meets most others: copies of a text with edits of
    their own meet it more often than each other.
    """
    rank = F.struct(-F.col("met"), F.col("node")) if turn == 0 else F.xxhash64("node", F.lit(turn))
    pivot = F.min_by(F.struct("node", "label", "size"), rank).alias("p")
    buckets = m.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), pivot).filter("lo != hi")
    met = m.join(buckets.select("bucket", "p"), "bucket").filter((F.col("label") != F.col("p.label")) & _size_fits("size", "p.size", similar))
    pairs = met.select(F.col("node").alias("a"), F.col("p.node").alias("b")).distinct()
    # rows of buckets stay narrow: signatures join the distinct pairs
    left, right = (sets.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b")


class _Roots(dict):
    """Labels and what they have been joined to inside one block."""

    def of(self, x):
        while self.get(x, x) != x:
            x = self[x]
        return x


def _compared(x, y, band: int, similar: int) -> list[tuple[int, int]]:
    """Links between the rows of two frames of one bucket; one link is enough to join two components.

    A pair that shares several bands is looked at in the first of them only.
    """
    sx, sy = (np.frombuffer(b"".join(f.sig), np.uint32).reshape(-1, LANES) for f in (x, y))
    flat = np.concatenate(y.set.to_list()).view(np.uint64)
    ends = np.cumsum(y["size"].to_numpy())
    starts = ends - y["size"].to_numpy()
    nx, ny, ly, node_y = x["size"].to_numpy(), y["size"].to_numpy(), y.label.to_list(), y.node.to_numpy()
    roots, found, enough = _Roots(), [], least(similar)
    for k, (own, label) in enumerate(zip(x.set, x.label, strict=True)):
        near = np.flatnonzero(100 * np.minimum(ny, nx[k]) >= similar * np.maximum(ny, nx[k]))
        equal = sy[near] == sx[k]
        likely = equal.sum(1) >= enough
        near, equal = near[likely], equal[likely]
        near = near[equal.reshape(-1, BANDS, ROWS).all(2).argmax(1) == band]
        mine = roots.of(label)
        near = [j for j in near if roots.of(ly[j]) != mine]
        if not near:
            continue
        own = own.view(np.uint64)
        places = np.concatenate([np.arange(starts[j], ends[j]) for j in near])
        at = np.minimum(np.searchsorted(own, flat[places]), len(own) - 1)
        sizes = ny[near]
        both = np.add.reduceat((own[at] == flat[places]).astype(np.int64), np.cumsum(sizes) - sizes)
        for j in np.asarray(near)[100 * both >= similar * (nx[k] + sizes - both)]:
            other = roots.of(ly[j])
            if other != roots.of(label):
                roots[other] = roots.of(label)
                found.append((int(x.node.iloc[k]), int(node_y[j])))
    return found


def _left_over(m: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Links across components inside buckets: nodes outside the largest component against all, in blocks."""
    import pandas as pd

    parts = m.groupBy("bucket", "label").agg(F.sum("size").alias("n"))
    whole = parts.groupBy("bucket").agg(F.sum("n").alias("all"), F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n_main"))
    whole = whole.filter("all > n_main").withColumn("rows", F.ceil((F.col("all") - F.col("n_main")) / BLOCK)).withColumn("cols", F.ceil(F.col("all") / BLOCK))
    m = m.join(whole, "bucket").join(sets, "node")
    spot = F.xxhash64("node", "bucket")
    row = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))
    col = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1))
    across = m.filter("label != main").withColumn("i", F.pmod(spot, "rows")).withColumn("j", col).withColumn("asks", F.lit(True))
    down = m.withColumn("j", F.pmod(spot, "cols")).withColumn("i", row).withColumn("asks", F.lit(False))
    columns = ["bucket", "band", "i", "j", "asks", "node", "label", "size", "sig", "set"]

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = frame[frame.asks], frame[~frame.asks]
        found = _compared(x, y, int(frame.band.iloc[0]), similar) if len(x) and len(y) else []
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    grouped = across.select(columns).unionByName(down.select(columns)).groupBy("bucket", "i", "j")
    return grouped.applyInPandas(compare, "a bigint, b bigint").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(docs: DataFrame, nodes: DataFrame, similar: int = SIMILAR) -> DataFrame | None:
    """(node, component) of nodes that are linked; ``nodes``: node, doc_id, n_shingles, d1, d2, sig, bands."""
    keys = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = keys.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    narrow = written(keys.join(shared, "bucket"), "buckets")
    if narrow.isEmpty():
        return None
    meets = narrow.groupBy("node").agg(F.sum("n").alias("met"))
    wanted = written(nodes.drop("bands").join(meets, "node"), "candidates")
    sets = _sets(docs, wanted)
    members = written(narrow.drop("n").join(wanted.select("node", "met", F.col("n_shingles").alias("size")), "node"), "members")
    found, labels = None, None
    for turn in range(PIVOTS + 1):
        m = _labelled(members, labels)
        new = _confirmed(_alike(_pivot_pairs(m, turn, sets, similar), similar), sets, similar) if turn < PIVOTS else _left_over(m, sets, similar)
        new = written(new, "links")
        if new.isEmpty():
            continue
        found = new if found is None else found.unionByName(new)
        labels = written(connected(found), "labels")
    return labels


def classes(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id of every row; kept: doc_id is the component's smallest."""
    every = written(features(docs), "features")
    same = every.filter("n_shingles > 0").withColumn("_at", F.monotonically_increasing_id())
    same = same.groupBy("d1", "d2", "n_shingles").agg(F.min("_at").alias("node"), F.min("doc_id").alias("first"))
    named = written(same, "classes")
    unique = every.join(named.select("node", "d1", "d2", "first"), ["d1", "d2"]).filter(F.col("doc_id").eqNullSafe(F.col("first")))
    nodes = unique.select("node", "doc_id", "n_shingles", "d1", "d2", "sig", "bands").dropDuplicates(["node"])
    labels = links(docs, written(nodes, "nodes"), similar)
    if labels is None:
        leaders = named.select("d1", "d2", F.col("first").alias("component_id"))
    else:
        joined = named.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
        leaders = joined.join(least, "component").select("d1", "d2", "component_id")
    leaders = written(leaders, "leaders")
    known = every.filter("n_shingles > 0").join(leaders, ["d1", "d2"])
    alone = every.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "text_hash", "n_shingles", "component_id"]
    return known.select(columns).unionByName(alone.select(columns)).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def unique(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The documents that lead their component, all columns kept; of repeated rows one stays."""
    known = written(classes(docs, similar).select("doc_id", "text_hash", "kept"), "kept")
    once = known.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1")
    return rows.without(docs, known.filter("not kept"), once)
