"""Small fixed tables as inline relations (exact statistics, no Python scan)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherledger.functions import vocab


def sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


def values_sql(rows: Sequence[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(sql_literal, r)) + ")" for r in rows)


def inline_table(spark: SparkSession, columns: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    return spark.sql(f"SELECT * FROM {values_sql(rows)} AS t({', '.join(columns)})")


def lookup(mapping: dict, key: Column, default) -> Column:
    """Map a column through a small dict; missing and null keys give ``default``."""
    start = F.lit(None)
    chain = reduce(lambda acc, kv: acc.when(key == F.lit(kv[0]), F.lit(kv[1])), mapping.items(), F.when(F.lit(False), start))
    return chain.otherwise(F.lit(default))


def first_containing(rules: Sequence[tuple[list[str], str]], text: Column, default: Column) -> Column:
    """First rule with any needle contained in ``text``."""
    chain = F.when(F.lit(False), F.lit(None))
    for needles, value in rules:
        chain = chain.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles]), F.lit(value))
    return chain.otherwise(default)


def alias_table(spark: SparkSession) -> DataFrame:
    """155 names -> canonical name and the metadata of that name."""
    return inline_table(spark, vocab.ALIAS_COLUMNS, vocab.ALIAS_ROWS)


def canonical_table(spark: SparkSession) -> DataFrame:
    """44 canonical names -> metadata found when the canonical name itself is looked up."""
    by_key = {r[0]: r for r in vocab.ALIAS_ROWS}
    names = dict.fromkeys(r[1] for r in vocab.ALIAS_ROWS)
    rows = [
        (n, r[2], r[3], r[5], r[6] or "unknown", r[7])
        for n in names
        for r in [by_key.get(n.lower().replace(" ", "-").replace("_", "-"))]
        if r
    ]
    cols = ["c_canonical", "c_family", "c_status", "c_standard", "c_lifecycle", "c_note"]
    return inline_table(spark, cols, rows)


def package_table(spark: SparkSession) -> DataFrame:
    """41 packages -> algorithms they bring."""
    t = inline_table(spark, vocab.PACKAGE_COLUMNS, vocab.PACKAGE_ROWS)
    return t.withColumn("algorithms", F.split("algorithms", ","))


def registry_table(spark: SparkSession) -> DataFrame:
    """Post-quantum registry with list columns."""
    t = inline_table(spark, ["registry_rank"] + vocab.REGISTRY_COLUMNS, [(i, *r) for i, r in enumerate(vocab.REGISTRY_ROWS)])
    return (
        t.withColumn("usage_roles", F.split("usage_roles", ","))
        .withColumn("variants", F.split("variants", ","))
        .withColumn("security_categories", F.split("security_categories", ",").cast("array<int>"))
        .withColumn("trade_offs", F.split("trade_offs", ";"))
    )
