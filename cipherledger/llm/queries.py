"""The registered queries of the package: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherledger.llm import (
    bpe,
    clustering,
    decontaminate,
    dialogues,
    disclosure,
    language,
    license_scan,
    line_dedup,
    near_dedup,
    packing,
    perplexity,
    quality,
    sharding,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(plan):
        QUERIES[name] = plan
        if oracle:
            ORACLES[name] = oracle
        return plan

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sha(column) -> F.Column:
    return F.sha2(column, 256)


@query(
    "op5_shards",
    """
    WITH d AS (
      SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
        lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT), 60, '0')
          || lpad(bin(('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT), 60, '0') AS place
      FROM documents),
    first AS (SELECT greatest(0, ceil(log2(greatest(1, sum(n_bytes)) / 1048576.0)) - 1)::INT AS depth FROM d),
    sums AS (
      SELECT k AS depth, substr(place, 1, k) AS shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS n
      FROM d, range(0, 121) r(k), first WHERE k >= first.depth GROUP BY ALL),
    leaf AS (
      SELECT d.doc_id, d.n_bytes, min(s.depth) AS depth
      FROM d JOIN sums s ON s.shard = substr(d.place, 1, s.depth) WHERE s.shard_bytes <= 1048576 OR s.n = 1 GROUP BY ALL)
    SELECT l.doc_id, l.n_bytes, s.shard, l.depth::INT AS depth, s.shard_bytes, s.shard_bytes > 1048576 AS oversized
    FROM leaf l JOIN d USING (doc_id) JOIN sums s ON s.depth = l.depth AND s.shard = substr(d.place, 1, l.depth)
    """,
)
def shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shards(table(spark, folder, "documents"))


@query("op9_byte_bpe")
def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(table(spark, folder, "documents"), path, public_tokenizers.PATTERN, decoded=True)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join("ids", ",")).alias("ids_sha256"),
        sha("decoded").alias("decoded_sha256"),
    )


@query(
    "op10_decontamination",
    """
    WITH dw AS (
      SELECT doc_id, regexp_extract_all(lower_ascii, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
      FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
    bw AS (
      SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
      FROM benchmark WHERE text IS NOT NULL),
    windows AS (
      SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
      FROM bw, range(1, 100000) r(i) WHERE len(w) > 0 AND i <= len(w) - least(10, len(w)) + 1),
    sizes AS (SELECT DISTINCT m FROM windows),
    spots AS (
      SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, sizes WHERE len(w) >= m)),
    met AS (SELECT doc_id, i, m, item_id FROM spots JOIN windows USING (m, s)),
    covered AS (
      SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM met) GROUP BY doc_id),
    named AS (
      SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM met) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
      sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
)
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", sha(F.array_join("item_ids", ",")).alias("items_sha256"), "contaminated")


@query("op7_perplexity")
def perplexity_bands(spark: SparkSession, folder: str) -> DataFrame:
    return perplexity.judged(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "low", "high"
    )


@query("op8_quality")
def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    labels = table(spark, folder, "labels").filter(fold != 0).select("doc_id", F.col("quality").alias("label"))
    scored = quality.classify(table(spark, folder, "documents"), labels)
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op3_language")
def languages(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = table(spark, folder, "documents")
    net = language.train(language.sample(docs.filter(~held_out)))
    return language.identify(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op6_near_dedup")
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.classes(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query("op1_license_scan")
def license_notices(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.scan(table(spark, folder, "documents"))
    base = F.filter("places", lambda p: p.base)
    starts = F.transform(base, lambda p: p.start)

    def labels(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p.label))), ",")

    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p.share)), F.lit(0.0)).alias("score"),
    )


@query("op4_disclosure")
def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = disclosure.listed(table(spark, folder, "documents"))

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s.place <= 4)
    return found.select("doc_id", *map(count, disclosure.KINDS[:4]), sha(text(base)).alias("base_sha256"), text(F.col("spans")).alias("spans"))


@query("op2_line_dedup")
def near_lines(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.removed(table(spark, folder, "documents"))


def _assigned(v: str, c: str, out: str) -> str:
    """SQL: each vector's nearest centroid; ties go to the smaller number."""
    return f"""
    {out} AS (
      SELECT vec_id, n, v, pick.k AS k, pick.d AS d FROM (
        SELECT vec_id, n, v, min(struct_pack(d := d, k := k)) AS pick FROM (
          SELECT a.vec_id, a.n, a.v, c.k, list_sum(list_transform(list_zip(a.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
          FROM {v} a, {c} c) GROUP BY ALL))"""


def _moved(a: str, c: str, out: str) -> str:
    """SQL: floor of the mean of each component; centroids without vectors stay."""
    return f"""
    {out} AS (
      SELECT c.k, coalesce(m.c, c.c) AS c FROM {c} c LEFT JOIN (
        SELECT k, list(floor_mean ORDER BY j) AS c FROM (
          SELECT k, j, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_mean
          FROM (SELECT k, unnest(v)::HUGEINT AS x, generate_subscripts(v, 1) AS j FROM {a}) GROUP BY k, j) GROUP BY k) m USING (k))"""


@query(
    "op13_bit_plane_clusters",
    """
    WITH vectors AS (
      SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    c0 AS (
      SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), v) - 1)::INT AS k, v AS c
      FROM vectors QUALIFY k < 16),"""
    + ",".join(_assigned("vectors", f"c{i}", f"a{i}") + (("," + _moved(f"a{i}", f"c{i}", f"c{i + 1}")) if i < 3 else "") for i in range(4))
    + """
    SELECT vec_id, k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
      (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM a3 JOIN c3 USING (k)
    """,
)
def bit_plane_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.clusters(table(spark, folder, "embeddings"))


@query("op11_sequence_packing")
def sequence_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with planted faults, by a hash of ``conv_id:turn``."""
    names = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fate = F.crc32(F.concat_ws(":", *names)) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), fate.alias("fate"),
    )
    times = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.filter("fate != 0").select("conv_id", "turn", "role", "text", times.alias("copy")).drop("copy")


@query("op12_dialogue_repair")
def dialogue_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    return dialogues.repair(damaged(conversations), conversations)
