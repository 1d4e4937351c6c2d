"""Personal data and the terms that give it away, in DataFrame operations only.

Base: e-mail addresses, IP addresses, card and phone numbers by pattern and check.
Patterns are written so that a failed attempt is never repeated inside the same run
of characters, so matching is linear in the text. Positions come from the lengths
of the pieces between matches, summed in order.

Method: information-theoretic sanitisation. A found value is a protected entity e, and
the unit of co-occurrence is the whole text: with x of the n occurrences of a term t
in texts that hold e, p(e | t) = x / n and PMI(e; t) = log2 p(e | t) / p(e), against
IC(e) = -log2 p(e), what there is to know. IC - PMI = -log2 p(e | t) is what stays
unknown of e to somebody who sees t, in bits; it does not depend on how many texts
there are. p(e | t) is taken at its lower confidence bound (Wilson, Z deviations), so
a value seen once is served as well, and a single occurrence is no evidence. A term
that leaves at most REMOVE bits is removed, one that leaves at most GENERALISE bits is
generalised to its kind of word, at every place in the texts that hold that entity.
Equal texts count once, so plain copies add no evidence.

Entities that stand in the same texts are one class, and so are terms with the same
counts in the same texts; so a text with many values and many rare words makes few
pairs. Terms that can't reach a threshold with any entity are left out by counts.

Defined results: null is the empty text, without spans; repeated rows repeat their
spans and add no evidence; a place inside a found value is not marked again; of two
entities that a term gives away the one with fewer bits left decides; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cipherledger.llm import bitmap, rows
from cipherledger.session import written

KINDS = ("email", "ip", "card", "phone", "generalise", "remove")  # in the order of listing
LETTERS = 3  # shorter words are no terms
Z = 1.0
GENERALISE = 0.75
REMOVE = 0.5
_TERM = r"[\p{L}\p{N}]+"
_LOCAL = "[A-Za-z0-9._%+-]"

#: (pattern, text that must be there for a match)
PATTERNS = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[ -]?[0-9])++", None),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "+"),
}

_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digest() -> F.Column:
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def _digits(value: str) -> F.Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: F.Column) -> F.Column:
    back = F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0))
    doubled = F.transform(back, lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def _valid() -> F.Column:
    digits = _digits("value")
    n = F.length(digits)
    return (
        F.when(F.col("kind") == "email", True)
        .when(F.col("kind") == "ip", F.col("value").rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
        .when(F.col("kind") == "card", F.when(n.between(12, 19), _luhn(digits)).otherwise(False))
        .otherwise(n.between(9, 15))
    )


def matches(docs: DataFrame, row: str | None = None) -> DataFrame:
    """row, doc_id, digest, hits, whole: every pattern match with the gap before it, and the text if there is one; one row a document.

    ``row`` names a column that numbers the rows; without it they are numbered here.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.col(row) if row else F.monotonically_increasing_id()
    d = docs.select(row.alias("row"), "doc_id", text.alias("text"))
    nothing = F.array().cast("array<string>")
    for kind, (pattern, needs) in PATTERNS.items():
        possible = F.contains("text", F.lit(needs)) if needs else F.col("text").rlike("[0-9][ -]?[0-9]")
        d = d.withColumn(kind, F.when(possible, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(nothing))
    for kind, (pattern, _) in PATTERNS.items():
        d = d.withColumn(f"{kind}_gaps", F.when(F.size(kind) > 0, F.split("text", pattern, -1)).otherwise(nothing))

    def hit(kind: str):
        gaps = F.col(f"{kind}_gaps")

        def one(value, i):
            return F.struct(
                F.lit(kind).alias("kind"), i.alias("i"), F.length(gaps[i]).alias("gap"), value.alias("value"),
            )

        return F.transform(kind, one)

    d = d.select("row", "doc_id", _digest().alias("digest"), F.concat(*[hit(k) for k in PATTERNS]).alias("hits"), "text")
    return d.withColumn("whole", F.when(F.size("hits") > 0, F.col("text"))).drop("text")


def base_spans(found: DataFrame) -> DataFrame:
    """row, digest, kind, value, start, end of valid matches; positions are code points."""
    flat = found.filter(F.size("hits") > 0).select("row", "digest", F.explode("hits").alias("h")).select("row", "digest", "h.*")
    order = Window.partitionBy("row", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.length("value")).over(order)
    placed = flat.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    return placed.filter(_valid()).select("row", "digest", "kind", "value", "start", "end")


def _found_terms(text: F.Column) -> F.Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def _is_term(term: str) -> F.Column:
    return (F.length(term) >= LETTERS) & F.col(term).rlike(r"\p{L}")


def corpus_counts(docs: DataFrame) -> DataFrame:
    """key, n: how often each term (by its hash) occurs in all different texts.

    Texts that may have copies, by a fixed bitmap, are made one by digest before they are counted.
    """
    known = docs.select(F.col("text").cast("string").alias("text")).filter("text is not null").withColumn("h", rows.text_hash())
    twice = known.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    hit = written(bitmap.bits(twice.select("h")), "bits")
    copied = bitmap.holds(hit, F.col("h"))
    keys = F.transform(F.filter(_found_terms(F.col("text")), lambda w: F.length(w) >= LETTERS), lambda w: F.xxhash64(w))
    single = known.filter(~copied).select(keys.alias("keys"))
    copies = known.filter(copied).select(_digest().alias("digest"), keys.alias("keys")).groupBy("digest").agg(F.first("keys").alias("keys"))
    both = single.unionByName(copies.select("keys"))
    return both.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def unknown_bits(x, n) -> F.Column:
    """-log2 of the lower Wilson bound of x / n at Z deviations."""
    x, n = F.col(x).cast("double"), F.col(n).cast("double")
    z2 = Z * Z
    low = (x + z2 / 2 - Z * F.sqrt(x * (n - x) / n + z2 / 4)) / (n + z2)
    return -F.log2(F.greatest(low, F.lit(1e-12)))


def disclosing(docs: DataFrame, found: DataFrame, base: DataFrame) -> DataFrame:
    """digest, term, bits: for each text with values its terms that leave at most GENERALISE bits of one of them."""
    held = base.select("digest", "kind", "value").distinct()
    sign = F.bit_xor(F.xxhash64("digest"))
    entities = held.groupBy("kind", "value").agg(F.count("*").alias("n_e"), sign.alias("sign_e"))
    # one class: the same number of texts with the same sign
    classes = written(held.join(entities, ["kind", "value"]).select("digest", "n_e", "sign_e").distinct(), "entities")

    texts = found.join(base.select("row").distinct(), "row", "left_semi").groupBy("digest").agg(F.first("whole").alias("whole"))
    own = texts.select("digest", F.explode(_found_terms(F.col("whole"))).alias("term")).filter(_is_term("term"))
    own = written(own.groupBy("digest", "term").agg(F.count("*").alias("c")).withColumn("key", F.xxhash64("term")), "terms")
    # x is at most the occurrences in all texts with values: what stays below the bound with these can't reach it
    least = 2.0**-GENERALISE
    near = own.groupBy("key").agg(F.sum("c").alias("n_near"), F.max("c").alias("most"), F.bit_xor(F.xxhash64("digest", "c")).alias("sign_t"))
    near = near.join(corpus_counts(docs), "key").filter((F.col("n") > 1) & (F.col("n_near") >= least * F.col("n")))
    rare = written(own.join(near, "key").select("digest", "term", "c", "n", "most", "sign_t"), "rare")

    groups = rare.select("digest", "c", "n", "most", "sign_t").distinct()
    pairs = written(groups.join(classes, "digest").filter(F.col("n_e") * F.col("most") >= least * F.col("n")), "pairs")
    joint = pairs.groupBy("n_e", "sign_e", "n", "sign_t").agg(F.sum("c").alias("x"))
    known = joint.withColumn("bits", unknown_bits("x", "n")).filter(F.col("bits") <= GENERALISE)
    told = pairs.join(known, ["n_e", "sign_e", "n", "sign_t"]).groupBy("digest", "n", "sign_t").agg(F.min("bits").alias("bits"))
    return rare.join(told, ["digest", "n", "sign_t"]).select("digest", "term", "bits")


def _places(found: DataFrame, told: DataFrame) -> DataFrame:
    """row, kind, start, end of every occurrence of a text's disclosing terms."""
    texts = found.filter("whole is not null").join(told.select("digest").distinct(), "digest", "left_semi")
    gaps, words = F.split("whole", _TERM, -1), F.regexp_extract_all("whole", F.lit(_TERM), F.lit(0))
    # zipped, so that each is made once for a text; the gap after the last word has no word
    pieces = F.arrays_zip(words.alias("word"), F.transform(gaps, F.length).alias("gap"))
    flat = texts.select("row", "digest", F.posexplode(pieces).alias("i", "p")).select("row", "digest", "i", "p.*").filter("word is not null")
    end = F.sum(F.col("gap") + F.length("word")).over(Window.partitionBy("row").orderBy("i"))
    placed = flat.withColumn("end", end).withColumn("start", F.col("end") - F.length("word")).withColumn("term", F.lower("word"))
    act = F.when(F.col("bits") <= REMOVE, "remove").otherwise("generalise")
    return placed.join(told, ["digest", "term"]).select("row", act.alias("kind"), "start", "end")


def _clear_of(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Extra spans that overlap no base span: one pass over each row's spans in order."""
    touched = base.select("row", "kind", "start", "end").join(extra.select("row").distinct(), "row", "left_semi").withColumn("base", F.lit(True))
    both = touched.unionByName(extra.select("row", "kind", "start", "end").withColumn("base", F.lit(False)))
    order = Window.partitionBy("row").orderBy("start", F.desc("base"))
    before = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    held = both.withColumn("before", before).withColumn("after", after).filter(~F.col("base"))
    return held.filter((F.coalesce("before", "start") <= F.col("start")) & (F.coalesce("after", "end") >= F.col("end"))).select("row", "kind", "start", "end")


def spans(docs: DataFrame, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(row and doc_id of every document; row, kind, start, end of all spans); ``row`` as in ``matches``."""
    found = written(matches(docs, row), "matches")
    base = written(base_spans(found), "spans")
    told = written(disclosing(docs, found, base), "told")
    extra = written(_places(found, told), "disclosing")
    return found.select("row", "doc_id"), base.select("row", "kind", "start", "end").unionByName(_clear_of(base, extra))


def listed(docs: DataFrame) -> DataFrame:
    """row, doc_id, spans: (start, place, kind, end) in order of start and of KINDS."""
    rows, marked = spans(docs)
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    own = marked.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", place.alias("place"), "kind", "end"))).alias("spans"))
    none = F.expr("filter(array(named_struct('start', 0, 'place', 0L, 'kind', '', 'end', 0)), x -> false)")
    return rows.join(own, "row", "left").withColumn("spans", F.coalesce("spans", none))


def sanitised(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with found values as ``[KIND]``, removed terms gone and generalised ones as ``[TERM]``."""
    # a document is one struct, so that no column of it meets a column of this function
    numbered = written(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    _, marked = spans(numbered.select("row", "doc.doc_id", "doc.text"), "row")
    # base spans may overlap each other: a span's own part begins where the furthest earlier one ended
    order = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    placed = marked.withColumn("done", F.coalesce(F.max("end").over(order), F.lit(0)))
    word = F.when((F.col("end") <= F.col("done")) | (F.col("kind") == "remove"), "").when(F.col("kind") == "generalise", "[TERM]")
    word = word.otherwise(F.concat(F.lit("["), F.upper("kind"), F.lit("]")))
    part = F.struct("start", "end", F.col("done").cast("int").alias("done"), word.alias("word"))
    parts = placed.groupBy("row").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max("end").cast("int").alias("last"))
    joined = numbered.withColumn("whole", F.coalesce(F.col("doc.text").cast("string"), F.lit(""))).join(parts, "row", "left")
    cut = F.expr("transform(parts, s -> concat(substring(whole, s.done + 1, cast(greatest(0, s.start - s.done) as int)), s.word))")
    text = F.when(F.col("parts").isNull(), F.col("whole")).otherwise(F.concat(F.array_join(cut, ""), F.expr("substring(whole, last + 1)")))
    return joined.select(*[text.alias("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns])
