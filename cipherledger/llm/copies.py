"""Groups of texts that are near copies of each other, in DataFrame operations only.

Two texts are near copies if the Jaccard similarity of their sets of SHINGLE-word
shingles is at least a given percentage; groups are the connected components. BANDS
bands of ROWS minima make the bucket keys: at 0.8 two texts miss all buckets with
probability (1 - 0.8^3)^20 = 6e-7. A lane is the hash of the set nearest to a fixed
word in the XOR order; the words differ in their six highest bits alone, so it is the
least hash of one of 64 cells, or else of the nearest cell that has any. In a bucket all texts are held
against PIVOTS pivots, and what is left across components against all, under a test
that never rejects near copies: an unshared shingle changes one of 64 * SKETCH parities
at most. Every link is confirmed on the full sets.
"""

from __future__ import annotations

import random
import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherledger.llm import bitmap, rows
from cipherledger.llm.components import connected
from cipherledger.session import clear_written, written, written_so_far

SHINGLE = 5
BANDS = 20
ROWS = 3
PIVOTS = 2
SKETCH = 16  # words of 64 parities

CELLS = 64  # by the highest bits of a hash
_LANE = random.Random(78).sample(range(CELLS), BANDS * ROWS)


def _worded(docs: DataFrame, hit: DataFrame) -> DataFrame:
    """text_hash, w (words) of the rows whose text may be meant; w is not empty."""
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    asked = docs.withColumn("text_hash", rows.text_hash()).filter(bitmap.holds(hit, F.col("text_hash")))
    return asked.select("text_hash", F.split(F.btrim(low, F.lit(" \t\n\x0b\f\r")), "[ \t\n\x0b\f\r]+").alias("w"))


def _places() -> F.Column:
    return F.sequence(F.lit(0), F.greatest(F.size("w") - SHINGLE, F.lit(0)))


def _shingle(i) -> F.Column:
    return F.xxhash64(*[F.get("w", i + k) for k in range(SHINGLE)])  # beyond the last word: nothing


def _slice(i) -> F.Column:
    """The same hash, of a slice: cheaper where expressions are interpreted."""
    return F.xxhash64(F.slice("w", i + 1, SHINGLE))


def _alike(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; only sets of texts that stand in a pair are moved."""
    pairs = written(pairs, "pairs")
    left, right = (
        sets.select(F.col("text_hash").alias(x), F.col("set").alias(f"set_{x}")).join(pairs.select(x), x, "left_semi") for x in "ab"
    )
    both = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - both
    return pairs.join(left, "a").join(right, "b").filter(100 * both >= similar * either).select("a", "b")


def _fits(a: str, b: str, similar: int) -> F.Column:
    return 100 * F.least(a, b) >= similar * F.greatest(a, b)


def _against_pivots(m: DataFrame, similar: int) -> DataFrame:
    ranks = [F.struct(-F.col("met"), F.col("text_hash")), *[F.xxhash64("text_hash", F.lit(turn)) for turn in range(1, PIVOTS)]]
    pivots = F.array(*[F.min_by(F.struct("text_hash", "size"), rank) for rank in ranks])
    met = m.join(m.groupBy("bucket").agg(pivots.alias("pivots")), "bucket").select("text_hash", "size", F.explode("pivots").alias("p"))
    near = met.filter((F.col("text_hash") != F.col("p.text_hash")) & _fits("size", "p.size", similar))
    return near.select(F.least("text_hash", "p.text_hash").alias("a"), F.greatest("text_hash", "p.text_hash").alias("b")).distinct()


def _sketches(sets: DataFrame) -> DataFrame:
    """text_hash, sketch: which of 64 * SKETCH classes of shingles occur an odd number of times in the set."""
    each = sets.select("text_hash", F.explode("set").alias("s"))
    bit = F.expr("shiftleft(1L, cast(s & 63 as int))")
    word = F.pmod(F.shiftright("s", 6), F.lit(SKETCH))
    words = [F.bit_xor(F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(SKETCH)]
    made = each.select("text_hash", bit.alias("bit"), word.alias("word")).groupBy("text_hash").agg(*words)
    return made.select("text_hash", F.array(*[f"w{k}" for k in range(SKETCH)]).alias("sketch"))


def _may_match(a: str, b: str, similar: int) -> F.Column:
    """A test that sets similar enough never fail: they leave at most (100 - similar) / (100 + similar) of both sizes unshared."""
    unlike = sum((F.bit_count(F.col(f"{a}sketch")[k].bitwiseXOR(F.col(f"{b}sketch")[k])) for k in range(SKETCH)), F.lit(0))
    return (100 + similar) * unlike <= (100 - similar) * (F.col(f"{a}size") + F.col(f"{b}size"))


def _across(m: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    parts = m.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    whole = parts.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    m = written(m.join(whole.select("bucket", "main"), "bucket").select("bucket", "text_hash", "label", "size", "main"), "apart")
    m = m.join(_sketches(sets.join(m.select("text_hash").distinct(), "text_hash", "left_semi")), "text_hash")
    x = m.filter("label != main").select("bucket", *[F.col(c).alias(f"x_{c}") for c in ("text_hash", "label", "size", "sketch")])
    y = m.select(F.col("bucket").alias("y_bucket"), "text_hash", "label", "size", "sketch")
    near = (F.col("x_label") != F.col("label")) & _fits("x_size", "size", similar) & _may_match("x_", "", similar)
    met = x.join(y, (F.col("bucket") == F.col("y_bucket")) & near)
    return met.select(F.least("x_text_hash", "text_hash").alias("a"), F.greatest("x_text_hash", "text_hash").alias("b")).distinct()


def _lanes(each: DataFrame) -> DataFrame:
    """text_hash, lanes: for each cell the least hash of it, or of the nearest cell in the XOR order that has one."""
    least = [F.expr(f"min(s) FILTER (WHERE cell = {c})") for c in range(CELLS)]
    cells = each.withColumn("cell", F.shiftrightunsigned("s", 58).cast("int")).groupBy("text_hash").agg(F.array(*least).alias("cells"))
    steps = F.array(*[F.lit(1 << i) for i in range(6)])
    fill = F.aggregate(steps, F.col("cells"), lambda has, step: F.transform(has, lambda x, c: F.coalesce(x, F.get(has, c.bitwiseXOR(step)))))
    return cells.select("text_hash", fill.alias("lanes"))


def near_copies(docs: DataFrame, wanted: DataFrame, similar: int) -> DataFrame | None:
    """(text_hash, copy) of the wanted texts (text_hash) that have a near copy among them; None if there is none."""
    start = written_so_far()
    hit = written(bitmap.bits(wanted.select(F.col("text_hash").alias("h"))), "bits")
    each = _worded(docs, hit).select("text_hash", "w", F.explode_outer(_places()).alias("i")).select("text_hash", _shingle(F.col("i")).alias("s"))
    lanes = _lanes(each)
    bands = F.array(*[F.xxhash64(F.lit(b), *[F.get("lanes", F.lit(c)) for c in _LANE[b * ROWS : (b + 1) * ROWS]]) for b in range(BANDS)])
    keys = written(lanes.join(wanted, "text_hash", "left_semi").select("text_hash", bands.alias("bands")), "bands")
    keys = keys.select("text_hash", F.explode("bands").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    narrow = written(keys.join(shared, "bucket"), "buckets")
    if narrow.isEmpty():
        return None
    met = written(narrow.groupBy("text_hash").agg(F.sum("n").alias("met")), "met")
    hit = written(bitmap.bits(met.select(F.col("text_hash").alias("h"))), "bits")
    sets = _worded(docs, hit).select("text_hash", F.array_distinct(F.transform(_places(), _slice)).alias("set"))
    sets = written(sets.join(met, "text_hash").dropDuplicates(["text_hash"]), "sets")
    sizes = sets.select("text_hash", "met", F.size("set").alias("size"))
    members = written(narrow.select("bucket", "text_hash").join(sizes, "text_hash"), "members")
    clear_written(docs.sparkSession, start, keep=2)  # sets and members are read below
    found, labels = None, None
    for work in ("pivots", "across"):
        m = members.withColumn("label", F.col("text_hash"))
        if labels is not None:
            m = members.join(labels, "text_hash", "left").withColumn("label", F.coalesce("copy", "text_hash"))
        new = written(_alike(_against_pivots(m, similar) if work == "pivots" else _across(m, sets, similar), sets, similar), "links")
        if new.isEmpty():
            continue
        found = new if found is None else found.unionByName(new)
        labels = written(connected(found).select(F.col("node").alias("text_hash"), F.col("component").alias("copy")), "labels")
    return labels
