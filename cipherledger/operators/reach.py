"""Dependents of many origins at once, with origins packed 64 to a word.

Each origin has a word number and a bit in it; origins of one group (a scan, say) are
neighbours, because they reach the same nodes. What is known of a node is one row for
each word that reaches it: (node, word, bits).

Most nodes of an inventory are leaves (source files): nothing depends on them, so they
hand nothing on. The walk takes the other nodes only. A level joins the fresh bits with
the edges, merges them by ``bit_or`` where they are made, and keeps those that the node
did not have. One table holds what is reached; it is written anew by each level,
partitioned by whether a row has fresh bits, so that the next level and all later counts
read fresh rows only. The other rows of a level are deleted when the next one is written.
A lost executor costs a level at most. Leaves get their bits from the levels of their
targets in one join at the end, each bit at its least depth.

Counts are taken on words: the number of nodes of every origin is a sum for each bit, so
a count never makes a row for a pair of origin and node. ``pairs`` alone does.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherledger.session import exists, remove, written, written_path

WORD = 64
STATE = "node string, word bigint, reached bigint, fresh bigint, is_fresh boolean"


@dataclass(frozen=True)
class Reach:
    """What a walk found.

    ``levels`` has node, word, bits and depth, ``origins`` says which bit an origin is;
    ``beyond`` (word, bits) are the origins that have dependents further away.
    """

    origins: DataFrame
    levels: DataFrame
    beyond: DataFrame


def numbered(origins: DataFrame) -> DataFrame:
    """origin, word, bit; ``origins`` may have a column ``group``."""
    key = (["group"] if "group" in origins.columns else []) + ["origin"]
    rows = origins.select(*key).filter("origin IS NOT NULL").distinct()
    if len(key) == 2:  # an origin belongs to its least group
        rows = rows.groupBy("origin").agg(F.min("group").alias("group"))
    placed = rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("i", F.monotonically_increasing_id())
    return written(placed.select("origin", F.expr("shiftright(i, 6)").alias("word"), (F.col("i") % WORD).cast("int").alias("bit")), "origins")


def _candidates(state: DataFrame, steps: DataFrame) -> DataFrame:
    """Bits that the fresh rows hand on to the nodes that depend on them."""
    fresh = state.filter("is_fresh").select(F.col("node").alias("dst"), "word", "fresh")
    return fresh.join(steps, "dst").select(F.col("src").alias("node"), "word", F.lit(0).cast("long").alias("reached"), "fresh")


def _advanced(state: DataFrame, steps: DataFrame) -> DataFrame:
    known = state.select("node", "word", "reached", F.lit(0).cast("long").alias("fresh"))
    merged = known.unionByName(_candidates(state, steps)).groupBy("node", "word").agg(
        F.bit_or("reached").alias("reached"), F.bit_or("fresh").alias("handed")
    )
    fresh = F.col("handed").bitwiseAND(F.bitwise_not("reached"))
    return merged.select("node", "word", F.col("reached").bitwiseOR(F.col("handed")).alias("reached"), fresh.alias("fresh"), (fresh != 0).alias("is_fresh"))


def _leaves(levels: DataFrame, steps: DataFrame) -> DataFrame:
    """node, word, bits, depth of leaves: one more than their targets, a bit at its least depth only."""
    handed = levels.select(F.col("node").alias("dst"), "word", "bits", (F.col("depth") + 1).alias("depth")).join(steps, "dst")
    merged = handed.groupBy(F.col("src").alias("node"), "word", "depth").agg(F.bit_or("bits").alias("bits"))
    nearer = Window.partitionBy("node", "word").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or("bits").over(nearer), F.lit(0).cast("long"))))
    return merged.select("node", "word", fresh.alias("bits"), "depth").filter("bits <> 0")


def walk(edges: DataFrame, origins: DataFrame, max_depth: int | None = None) -> Reach:
    """Walk from all origins against the edges, level by level, to the end or to ``max_depth``.

    An origin never counts as its own dependent. Null ends and loops of one node are left out.
    """
    if max_depth is not None and max_depth < 1:
        raise ValueError("max_depth must be at least 1")
    spark = edges.sparkSession
    places = numbered(origins)
    steps = edges.select("src", "dst").filter("src <> dst").distinct()
    targets = steps.select(F.col("dst").alias("src"), F.lit(True).alias("inner")).distinct()
    flagged = steps.join(targets, "src", "left").select("src", "dst", F.coalesce("inner", F.lit(False)).alias("inner"))
    path = written_path(spark, "edges")
    flagged.write.partitionBy("inner").parquet(path)
    stored = spark.read.schema("src string, dst string, inner boolean").parquet(path)
    steps, last_steps = (stored.filter(f"inner = {flag}").select("src", "dst") for flag in ("true", "false"))
    bits = F.expr("bit_or(shiftleft(1L, bit))")
    start = places.groupBy(F.col("origin").alias("node"), "word").agg(bits.alias("reached"))
    state = written(start.select("node", "word", "reached", F.col("reached").alias("fresh"), F.lit(True).alias("is_fresh")), "reached")
    levels = state.select("node", "word", F.col("fresh").alias("bits"), F.lit(0).alias("depth"))
    before, ended = None, False
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        path = written_path(spark, f"reached-{depth}")
        _advanced(state, steps).write.partitionBy("is_fresh").parquet(path)
        ended = not exists(spark, f"{path}/is_fresh=true")
        if before:
            remove(spark, f"{before}/is_fresh=false")
        state, before = spark.read.schema(STATE).parquet(path), path
        if ended:
            break
        levels = levels.unionByName(state.filter("is_fresh").select("node", "word", F.col("fresh").alias("bits"), F.lit(depth).alias("depth")))
    leaves = written(_leaves(levels, last_steps), "leaves")
    found = levels.filter("depth > 0").unionByName(leaves)
    if max_depth is None:
        return Reach(places, found, leaves.select("word", "bits").limit(0))
    beyond = leaves.filter(F.col("depth") > max_depth).select("word", "bits")
    if not ended:
        beyond = beyond.unionByName(_advanced(state, steps).filter("is_fresh").select("word", F.col("fresh").alias("bits")))
    return Reach(places, found.filter(F.col("depth") <= max_depth), beyond)


def _by_bit(rows: DataFrame, *keys: str) -> DataFrame:
    """Of rows (word, bits, keys): word, bit, keys and ``n``, how many rows have the bit."""
    sums = [F.sum(F.expr(f"shiftrightunsigned(bits, {i}) & 1")).alias(f"b{i}") for i in range(WORD)]
    counted = rows.groupBy("word", *keys).agg(*sums)
    return counted.select("word", *keys, F.posexplode(F.array(*[f"b{i}" for i in range(WORD)])).alias("bit", "n")).filter("n > 0")


def _named(reach: Reach, counts: DataFrame) -> DataFrame:
    return reach.origins.join(counts, ["word", "bit"]).drop("word", "bit")


def pairs(reach: Reach) -> DataFrame:
    """(origin, node, depth) with the smallest depth."""
    rows = reach.levels.select("node", "depth", "word", F.explode(_set_bits(F.col("bits"))).alias("bit"))
    return rows.join(reach.origins, ["word", "bit"]).select("origin", "node", "depth")


def _set_bits(bits: Column) -> Column:
    flags = F.reverse(F.split(F.lpad(F.bin(bits), WORD, "0"), ""))
    return F.filter(F.transform(flags, lambda b, i: F.when(b == "1", i)), lambda i: i.isNotNull())


def depth_histogram(reach: Reach) -> DataFrame:
    """origin, depth, n."""
    return _named(reach, _by_bit(reach.levels, "depth")).select("origin", "depth", "n")


def affected_counts(reach: Reach) -> DataFrame:
    """origin, affected_count, reached_depth of every origin; 0 when nothing depends on it."""
    counts = _by_bit(reach.levels, "depth").groupBy("word", "bit").agg(F.sum("n").alias("affected_count"), F.max("depth").alias("reached_depth"))
    zero = {"affected_count": F.coalesce("affected_count", F.lit(0).cast("long")), "reached_depth": F.coalesce("reached_depth", F.lit(0))}
    return reach.origins.join(counts, ["word", "bit"], "left").select("origin", "affected_count", "reached_depth").withColumns(zero)


def affected_types(reach: Reach, nodes: DataFrame) -> DataFrame:
    """origin, node_type, n."""
    kinds = nodes.select(F.col("node_id").alias("node"), "node_type")
    return _named(reach, _by_bit(reach.levels.join(kinds, "node"), "node_type")).select("origin", "node_type", "n")


def dependents(reach: Reach) -> DataFrame:
    """origin, direct (depth 1) and transitive (deeper) dependents of origins that have any."""
    far = _by_bit(reach.levels.select("word", "bits", (F.col("depth") > 1).alias("far")), "far")
    both = far.groupBy("word", "bit").agg(
        F.coalesce(F.sum(F.when(~F.col("far"), F.col("n"))), F.lit(0)).alias("direct"),
        F.coalesce(F.sum(F.when(F.col("far"), F.col("n"))), F.lit(0)).alias("transitive"),
    )
    return _named(reach, both)


def unfinished(reach: Reach) -> DataFrame:
    """Origins with dependents beyond the depth of the walk; none if it went to the end."""
    words = reach.beyond.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return words.select("word", F.explode(_set_bits(F.col("bits"))).alias("bit")).join(reach.origins, ["word", "bit"]).select("origin")
