"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Nulls, empty and repeated rows are treated as the operators say; a table without
rows passes through all stages; columns beyond those of documents are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherledger.llm import bpe, decontaminate, language, line_dedup, near_dedup
from cipherledger.session import clear_written, written, written_so_far

SURE = 0.3  # the least share of positions that must speak for a document's language
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
ALIKE = 80  # percent of shared shingles from which two documents are near copies


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: not ``und``, and with a share of at least SURE."""
    learned = docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    longest = max(docs.columns, key=len)  # names that no column has
    name, share = f"{longest}_lang", f"{longest}_share"
    named = language.with_language(docs, language.train(language.sample(learned)), name, share)
    return named.filter((F.col(name) != language.UNKNOWN) & (F.col(share) >= SURE)).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated and boilerplate lines; n_chars follows the text."""
    out = line_dedup.cleaned(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.unique(docs, ALIKE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the bytes that they decode to."""
    coded = bpe.encode(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, decoded=True)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", languages),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", tokens),
]

#: SQL has no recurrent network, so the rows are tested stage by stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; of the intermediate tables the last one stays."""
    docs, start = spark.read.parquet(f"{sf_dir}/documents.parquet"), written_so_far()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        clear_written(spark, start, keep=1)
    return docs
