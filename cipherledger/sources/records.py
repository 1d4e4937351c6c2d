"""Registry and external record sources: schemas, defaults, coercion, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherledger.functions import vocab

REGISTRY_SCHEMA = (
    "name string, standard string, status string, family string, usage_roles array<string>, variants array<string>, "
    "security_categories array<int>, notes string, trade_offs array<string>, "
    "latency struct<public_key_bytes:int,ciphertext_bytes:int,signature_bytes:int,estimated_handshake_overhead_ms:double,"
    "cpu_overhead_factor:double,comparison:string>, "
    "cost struct<bandwidth_per_exchange_kb:double,infrastructure_cost_impact:string,migration_complexity:string,"
    "estimated_cost_tier:string,details:string>"
)
FINDING_FIELDS = [
    "finding_id", "repository", "commit", "file", "line_range", "algorithm", "role", "evidence_type", "source_url",
    "expected_ground_truth", "note",
]


def coerce_registry(entries: DataFrame) -> DataFrame:
    """Defaults for missing fields, known values for unknown ones; entries without a name are dropped."""
    known = lambda c, values, default: F.when(c.isin(values), c).otherwise(F.lit(default))
    empty = F.array().cast("array<string>")
    valid_roles = F.array(*[F.lit(r) for r in vocab.USAGE_ROLES])
    roles = F.filter(F.coalesce("usage_roles", empty), lambda r: F.array_contains(valid_roles, r))
    return entries.filter(F.col("name").isNotNull()).withColumns(
        {
            "standard": F.coalesce("standard", F.lit("")),
            "status": known(F.coalesce("status", F.lit("final")), vocab.PQC_STATUSES, "final"),
            "family": known(F.coalesce("family", F.lit("unknown")), vocab.FAMILIES, "unknown"),
            "usage_roles": roles,
            "variants": F.coalesce("variants", F.array("name")),
            "security_categories": F.coalesce("security_categories", F.array().cast("array<int>")),
            "notes": F.coalesce("notes", F.lit("")),
            "trade_offs": F.coalesce("trade_offs", empty),
        }
    )


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """Versioned registry file; fails when it is absent or holds no entry."""
    entries = spark.read.schema(REGISTRY_SCHEMA).option("multiLine", "true").json(path)
    if entries.isEmpty():
        raise ValueError(f"{vocab.ERROR_CODES['registry_failure']}: no registry entries in {path}")
    return coerce_registry(entries)


def parse_registry(rows: DataFrame, json: str) -> DataFrame:
    """Registry entries from a column of JSON objects; malformed ones are dropped."""
    parsed = rows.withColumn("_e", F.from_json(F.col(json), REGISTRY_SCHEMA, {"mode": "PERMISSIVE"}))
    return coerce_registry(parsed.select(*[c for c in rows.columns if c != json], "_e.*"))


def _missing(fields: Column, names: list[str]) -> Column:
    return F.array_except(F.array(*[F.lit(n) for n in names]), F.map_keys(fields))


def check_finding_records(rows: DataFrame, json: str) -> DataFrame:
    """Finding records against their schema: missing and extra fields, commit form, verdict."""
    fields = F.from_json(F.col(json), "map<string,string>")
    required = FINDING_FIELDS[:-1]
    return rows.withColumn("_f", F.coalesce(fields, F.create_map().cast("map<string,string>"))).withColumns(
        {
            "missing": F.array_sort(_missing(F.col("_f"), required)),
            "extra": F.array_sort(F.array_except(F.map_keys("_f"), F.array(*[F.lit(n) for n in FINDING_FIELDS]))),
            "commit_ok": F.coalesce(F.rlike(F.try_element_at("_f", F.lit("commit")), F.lit("^[0-9a-f]{40}$")), F.lit(False)),
        }
    ).withColumn("valid", (F.size("missing") == 0) & (F.size("extra") == 0) & F.col("commit_ok")).drop("_f")


def snapshot_hash(name: Column, commit: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("-", name, commit), 256), 1, 16)
