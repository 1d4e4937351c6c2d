"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Two lines of at least MIN_LINE characters belong together if their edit distance is
at most EDITS. A line of length L is cut into EDITS + 1 segments; one of them stands
unchanged in any partner, shifted by at most EDITS (pigeonhole). Every line probes,
for each length L from its own down to EDITS less, the few substrings whose place
fits a segment of L (the multi-match window); the hash of (L, segment number,
substring) is a bucket key, and a line's own segments are among them. Only keys that
two different lines share are kept.

Inside a bucket all lines are held against PIVOTS pivots, the line that meets most others
among them; lines that share a component need no more comparison. What is left across
components is compared under a test that never rejects a pair within reach: lengths
differ by at most EDITS, and the parities of 64 classes of characters and of neighbour
pairs in at most 2 * EDITS and 4 * EDITS bits. Pairs are verified by banded bit-parallel edit distance: one word of 2 * EDITS + 1 bits per
column holds the band. Classes are the connected components of verified pairs; lines
below MIN_LINE are classes of equal lines.

A line is a repeat if its class stood earlier in the same document, and boilerplate
if its class stands in at least SPREAD different texts and this is not the first of
its documents by doc_id. Equal texts and near copies (word shingles similar to COPY
percent, connected components) are one text, however many documents they are; so
copies stay whole for near-duplicate removal, and a large group of copies outweighs
nothing. Near copies are looked for only among texts with a line of SPREAD unequal
texts. Blank lines and, as boilerplate, lines below MIN_LINE always stay.

Defined results: null text is one empty line; repeated rows get the same decision;
a null doc_id comes first; an empty table gives an empty table; other columns pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cipherledger.llm import bitmap, copies
from cipherledger.llm.components import connected
from cipherledger.session import clear_written, written, written_so_far

EDITS = 2
MIN_LINE = 20
SPREAD = 3
COPY = 80  # percent
PIVOTS = 2


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, pos, line, h of every line."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.split(text, "\n", -1).alias("lines"))
    flat = whole.select("doc_id", "text_hash", F.posexplode("lines").alias("pos", "line"))
    return flat.withColumn("h", F.xxhash64("line"))


def _keys() -> F.Column:
    """Bucket keys of a line ``u`` (four bytes a character): for each partner length the substrings that could be one of its segments."""
    n, out = "(octet_length(u) div 4)", []
    for less in range(EDITS + 1):
        size = f"({n} - {less})"
        for k in range(EDITS + 1):  # segment k of a line of length ``size``
            start = f"cast({size} * {k} div {EDITS + 1} as int)"
            end = f"cast({size} * {k + 1} div {EDITS + 1} as int)"
            left, right = k, EDITS - k
            for shift in range(max(-left, less - right), min(left, less + right) + 1):
                out.append(f"xxhash64({size}, {k}, substring(u, 4 * ({start} + {shift}) + 1, 4 * ({end} - {start})))")
    return F.expr(f"array({', '.join(out)})")


def edit_distance_within(a: str, b: str, most: int = EDITS) -> F.Column:
    """Whether two strings (columns) of more than ``most`` characters, lengths at most ``most`` apart, are within ``most`` edits.

    The band of a column is one word; bit i stands for the row i - most from the diagonal.
    Until the band's lower edge reaches the last row the distance is followed along that
    diagonal, then along the last row.
    """
    width = 2 * most + 1
    mask = (1 << width) - 1
    same = " | ".join(f"if(get(first_chars, s.i + {i - most}) = other_char, {1 << i}, 0)" for i in range(width))  # outside the line: 0

    def let(name: str, value: str, body: str) -> str:
        return f"transform(array({value}), {name} -> {body})[0]"

    bottom = f"shiftright({1 << (width - 2)}, greatest(0, s.i - (size(first_chars) - {most})))"
    along = f"if((d & {1 << (width - 1)}) = 0, 1, 0)"
    across = f"if((hp & {bottom}) != 0, 1, 0) - if((hn & {bottom}) != 0, 1, 0)"
    after = (
        "named_struct('i', s.i + 1, "
        f"'vp', (hn | ~(shiftright(d, 1) | hp)) & {mask}, 'vn', shiftright(d, 1) & hp, "
        f"'dist', s.dist + if(s.i < size(first_chars) - {most}, {along}, {across}))"
    )
    step = let(
        "m", same,
        let("d", f"((((m & s.vp) + s.vp) ^ s.vp) | m | s.vn) & {mask}", let("hp", f"(s.vn | ~(d | s.vp)) & {mask}", let("hn", "d & s.vp", after))),
    )
    start = f"named_struct('i', 0, 'vp', {(mask << most) & mask}, 'vn', 0, 'dist', {most})"
    chars = lambda x: f"filter(split({x}, ''), c -> c != '')"
    whole = f"aggregate({chars(b)}, {start}, (s, other_char) -> {step}, s -> s.dist <= {most})"
    return F.expr(let("first_chars", chars(a), whole))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left = texts.select(F.col("h").alias("a"), F.col("line").alias("line_a"))
    right = texts.select(F.col("h").alias("b"), F.col("line").alias("line_b"))
    return pairs.join(left, "a").join(right, "b").filter(edit_distance_within("line_a", "line_b")).select("a", "b")


def _parity(items: F.Column) -> F.Column:
    """Which of 64 classes of items occur an odd number of times."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c), F.lit(64)).cast("int"))
    return F.aggregate(items, F.lit(0).cast("long"), lambda p, c: p.bitwiseXOR(bit(c)))


def _may_match(x: str, y: str) -> F.Column:
    """A test that never fails for lines within EDITS: an edit changes two characters and four pairs of neighbours at most."""
    near = F.abs(F.col(f"{x}size") - F.col(f"{y}size")) <= EDITS
    for name, each in (("ones", 2), ("twos", 4)):
        near &= F.bit_count(F.col(f"{x}{name}").bitwiseXOR(F.col(f"{y}{name}"))) <= each * EDITS
    return near


def _against_pivots(m: DataFrame) -> DataFrame:
    ranks = [F.struct(-F.col("met"), F.col("h")), *[F.xxhash64("h", F.lit(turn)) for turn in range(1, PIVOTS)]]
    pivots = F.array(*[F.min_by(F.struct("h", "size", "ones", "twos"), rank) for rank in ranks])
    met = m.join(m.groupBy("bucket").agg(pivots.alias("pivots")), "bucket").select("h", "size", "ones", "twos", F.explode("pivots").alias("p"))
    near = met.filter((F.col("h") != F.col("p.h")) & _may_match("", "p."))
    return near.select(F.least("h", "p.h").alias("a"), F.greatest("h", "p.h").alias("b")).distinct()


def _across(m: DataFrame, texts: DataFrame) -> DataFrame:
    """Links across components inside buckets: lines outside a bucket's largest component against all others.

    Pairs are verified in the join itself, in the first bucket that both lines share, so
    only links come out of it.
    """
    parts = m.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    whole = parts.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    m = m.join(whole.select("bucket", "main"), "bucket").join(texts.select("h", "line", "buckets"), "h")
    columns = ["h", "label", "size", "ones", "twos", "line", "buckets"]
    x = m.filter("label != main").select("bucket", *[F.col(c).alias(f"x_{c}") for c in columns])
    y = m.select(F.col("bucket").alias("y_bucket"), *[F.col(c).alias(f"y_{c}") for c in columns])
    first = F.array_min(F.array_intersect("x_buckets", "y_buckets")) == F.col("bucket")
    near = (F.col("x_label") != F.col("y_label")) & _may_match("x_", "y_") & first & edit_distance_within("x_line", "y_line")
    met = x.join(y, (F.col("bucket") == F.col("y_bucket")) & near)
    return met.select(F.least("x_h", "y_h").alias("a"), F.greatest("x_h", "y_h").alias("b")).distinct()


def classes(docs: DataFrame) -> DataFrame | None:
    """(h, class) of lines that have a near but different line; None if there is none."""
    long = _lines(docs).filter(F.length("line") >= MIN_LINE).select("h", "line")
    start = written_so_far()
    # made once and read twice: to find the keys that lines share, and the lines that have them
    keyed = written(long.select("h", F.encode("line", "UTF-32").alias("u")).select("h", _keys().alias("buckets")), "keys")
    keys = keyed.select("h", F.explode("buckets").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo != hi").select("bucket")
    shared = written(shared, "shared")
    if shared.isEmpty():
        return None
    hit = written(bitmap.bits(shared.select(F.col("bucket").alias("h"))), "bits")
    asked = keys.filter(bitmap.holds(hit, F.col("bucket")))
    members = written(asked.join(shared, "bucket").distinct(), "members")
    # a line meets as many others as its buckets hold
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"))
    own = members.join(sizes, "bucket").groupBy("h").agg(F.sum("n").alias("met"), F.array_sort(F.collect_set("bucket")).alias("buckets"))
    own = written(own, "met")
    hit = written(bitmap.bits(own.select("h")), "bits")
    texts = long.filter(bitmap.holds(hit, F.col("h"))).join(own, "h").dropDuplicates(["h"]).withColumn("size", F.length("line"))
    texts = texts.withColumn("chars", F.filter(F.split("line", ""), lambda c: c != ""))
    pairs = F.transform(F.slice("chars", 2, F.size("chars")), lambda c, i: F.concat(F.get("chars", i), c))
    texts = written(texts.withColumn("ones", _parity(F.col("chars"))).withColumn("twos", _parity(pairs)).drop("chars"), "lines")
    members = written(members.join(texts.select("h", "size", "ones", "twos", "met"), "h"), "members")
    clear_written(docs.sparkSession, start, keep=2)  # lines and members are read below
    found, labels = None, None
    for work in ("pivots", "across"):
        m = members.withColumn("label", F.col("h"))
        if labels is not None:
            m = members.join(labels, "h", "left").withColumn("label", F.coalesce("class", "h"))
        new = written(_verified(_against_pivots(m), texts) if work == "pivots" else _across(m, texts), "links")
        if new.isEmpty():
            continue
        found = new if found is None else found.unionByName(new)
        labels = written(connected(found).select(F.col("node").alias("h"), F.col("component").alias("class")), "labels")
    return labels


def _boilerplate(docs: DataFrame, lines: DataFrame, spread: float) -> DataFrame:
    """class, keeper (its first document) of the classes that stand in at least ``spread`` different texts."""
    often = lines.select("class", "text_hash").distinct().groupBy("class").agg(F.count("*").alias("texts")).filter(F.col("texts") >= spread)
    often = written(often.select("class"), "often")
    # minima of plain columns: a minimum of structs would sort all lines; a null doc_id comes first
    held = lines.join(often, "class", "left_semi").groupBy("class", "text_hash")
    held = written(held.agg(F.min("doc_id").alias("doc_id"), F.max(F.col("doc_id").isNull()).alias("unnamed")), "held")
    first = F.struct(F.when(~F.col("unnamed"), F.col("doc_id")).alias("doc_id"), "text_hash")
    wide = held.groupBy("class").agg(F.min(first).alias("keeper"))
    wide = written(wide.select("class", "keeper"), "wide")
    named = copies.near_copies(docs, held.select("text_hash").distinct(), COPY)
    if named is None:
        return wide
    once = held.join(named, "text_hash", "left").select("class", F.coalesce("copy", "text_hash").alias("copy")).distinct()
    enough = once.groupBy("class").agg(F.count("*").alias("texts")).filter(F.col("texts") >= spread)
    return written(wide.join(enough, "class", "left_semi"), "boilerplate")


def decisions(docs: DataFrame, spread: float = SPREAD) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n_near of documents with near lines; doc_id, text_hash, pos, repeat of removed lines)."""
    named = classes(docs)
    solid = F.btrim("line", F.lit(" \t\x0b\f\r")) != ""
    flat = _lines(docs).select("doc_id", "text_hash", "pos", "h", F.length("line").alias("size"), solid.alias("solid"))
    flat = flat.withColumn("near", F.lit(False)).withColumn("class", F.col("h")) if named is None else (
        flat.join(named, "h", "left").withColumn("near", F.col("class").isNotNull()).withColumn("class", F.coalesce("class", "h"))
    )
    flat = written(flat, "occurrences")
    own = Window.partitionBy("doc_id", "text_hash", "class")
    placed = flat.filter("solid").withColumn("first", F.min("pos").over(own)).withColumn("repeat", F.col("pos") > F.col("first"))
    wide = _boilerplate(docs, flat.filter(f"solid and size >= {MIN_LINE}"), spread)
    here = F.struct("doc_id", "text_hash")
    judged = placed.join(wide, "class", "left")
    plate = F.col("keeper").isNotNull() & (F.col("size") >= MIN_LINE) & ~here.eqNullSafe(F.col("keeper"))
    gone = judged.filter(F.col("repeat") | plate).select("doc_id", "text_hash", "pos", "repeat").distinct()
    near = flat.filter("near").groupBy("doc_id", "text_hash").agg(F.countDistinct("pos").alias("n_near"))
    return near, written(gone, "removed")


def removed(docs: DataFrame, spread: float = SPREAD) -> DataFrame:
    """One row a document: doc_id, n_lines, n_near, n_repeated, n_boilerplate, removed (positions, comma-joined)."""
    near, gone = decisions(docs, spread)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n_lines = F.size(F.split(text, "\n", -1)).cast("long")
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), n_lines.alias("n_lines"))
    lost = gone.groupBy("doc_id", "text_hash").agg(
        F.sum(F.col("repeat").cast("long")).alias("n_repeated"), F.sum((~F.col("repeat")).cast("long")).alias("n_boilerplate"),
        F.array_join(F.array_sort(F.collect_list("pos")), ",").alias("removed"),
    )

    def meet(left, right, how):
        right = right.withColumnsRenamed({"doc_id": "_doc", "text_hash": "_text"})
        on = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_text"))
        return left.join(right, on, how).drop("_doc", "_text")

    none = F.lit(0).cast("long")
    return meet(meet(rows, near, "left"), lost, "left").select(
        "doc_id", "n_lines", F.coalesce("n_near", none).alias("n_near"), F.coalesce("n_repeated", none).alias("n_repeated"), F.coalesce("n_boilerplate", none).alias("n_boilerplate"),
        F.coalesce("removed", F.lit("")).alias("removed"),
    )


def cleaned(docs: DataFrame, spread: float = SPREAD) -> DataFrame:
    """The documents without removed lines, all columns kept; documents that lose their last solid line go."""
    _, gone = decisions(docs, spread)
    lost = gone.groupBy(F.col("doc_id").alias("lost_id"), F.col("text_hash").alias("lost_hash")).agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    lost = written(lost.withColumn("lost_key", F.xxhash64("lost_id", "lost_hash")), "lost")
    # positions become one flag a line, so that a document is rebuilt in one pass
    marks = F.expr("array_join(transform(gone, (p, i) -> concat(repeat('0', p - if(i = 0, -1, gone[i - 1]) - 1), '1')), '')")
    flags = written(lost.select("lost_key", "lost_id", "lost_hash", F.split(marks, "").alias("flags")), "flags")
    hit = written(bitmap.bits(lost.select(F.col("lost_key").alias("h"))), "bits")
    # a document is one struct, so that no column of it meets a column of this function
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", text.alias("whole"), F.xxhash64(text).alias("text_hash"))
    keyed = keyed.withColumn("key", F.xxhash64("doc_id", "text_hash"))
    touched = bitmap.holds(hit, F.col("key"))  # the others need no join
    on = (F.col("key") == F.col("lost_key")) & F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("text_hash") == F.col("lost_hash"))
    met = keyed.filter(touched).join(flags, on, "left").withColumn("lines", F.split("whole", "\n", -1))
    stays = F.expr("filter(lines, (x, i) -> coalesce(get(flags, i), '0') = '0')")
    rebuilt = met.withColumn("stay", stays).filter(F.col("flags").isNull() | F.exists("stay", lambda x: x.rlike(r"\S")))
    left = F.when(F.col("flags").isNull(), F.col("doc.text")).otherwise(F.array_join("stay", "\n"))
    columns = [left.alias("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns]
    return keyed.filter(~touched).select("doc.*").unionByName(rebuilt.select(*columns))
