"""Raw findings -> normalised evidence (names, defaults, classes, keys)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from cipherledger.functions import vocab
from cipherledger.functions.tables import alias_table, canonical_table, lookup
from cipherledger.functions.text import blank_to_null, strip


def alias_key(name: Column) -> Column:
    return F.translate(F.lower(strip(name)), " _", "--")


def normalize_names(df: DataFrame, name: str) -> DataFrame:
    """Add canonical, family, quantum_status, variant, standard, alias_note for a raw name.

    Unknown names stay as they are (trimmed); blank ones become UNKNOWN.
    The alias table has 155 fixed rows, so the join is a broadcast hash join.
    """
    aliases = alias_table(df.sparkSession).select(
        "alias_key", F.col("canonical").alias("_canonical"), F.col("family").alias("_family"),
        F.col("quantum_status").alias("_status"), F.col("variant").alias("_variant"),
        F.col("standard").alias("_standard"), F.col("note").alias("_note"),
    )
    joined = df.withColumn("_key", alias_key(F.col(name))).join(
        F.broadcast(aliases), F.col("_key") == F.col("alias_key"), "left"
    )
    raw = blank_to_null(strip(F.col(name)))
    return joined.withColumns(
        {
            "canonical": F.coalesce("_canonical", raw, F.lit("UNKNOWN")),
            "family": F.coalesce("_family", F.lit("unknown")),
            "quantum_status": F.coalesce("_status", F.lit("unknown")),
            "variant": F.coalesce("_variant", F.lit("")),
            "standard": F.coalesce("_standard", F.lit("")),
            "alias_note": F.coalesce("_note", F.lit("")),
        }
    ).drop("_key", "alias_key", "_canonical", "_family", "_status", "_variant", "_standard", "_note")


def canonical_metadata(df: DataFrame, name: str = "canonical") -> DataFrame:
    """Metadata that belongs to the canonical name itself (44 fixed rows, broadcast)."""
    dim = canonical_table(df.sparkSession)
    joined = df.join(F.broadcast(dim), F.col(name) == F.col("c_canonical"), "left")
    return joined.withColumns(
        {
            "c_family": F.coalesce("c_family", F.lit("unknown")),
            "c_status": F.coalesce("c_status", F.lit("unknown")),
            "c_standard": F.coalesce("c_standard", F.lit("")),
            "c_lifecycle": F.coalesce("c_lifecycle", F.lit("unknown")),
            "c_note": F.coalesce("c_note", F.lit("")),
        }
    ).drop("c_canonical")


def effective_hint(hint: Column, hints: Column) -> Column:
    return F.coalesce(blank_to_null(hint), F.get(hints, F.lit(0)), F.lit(""))


def expand_hints(findings: DataFrame) -> DataFrame:
    """One row per algorithm hint; the package name where a finding has none.

    Numbers in ``ord`` that leave room for it (decimals) go up with the hint.
    """
    rows = findings.select("*", F.posexplode_outer("algorithm_hints").alias("_at", "_hint")).withColumn(
        "algorithm_hint", F.coalesce(blank_to_null(F.col("algorithm_hint")), F.col("_hint"), F.col("package_name"))
    )
    if "ord" in findings.columns and isinstance(findings.schema["ord"].dataType, DecimalType):
        rows = rows.withColumn("ord", (F.col("ord") + F.coalesce("_at", F.lit(0))).cast("decimal(38,0)"))
        rows = rows.withColumn("finding_id", F.concat_ws("|", "finding_id", "_at"))
    return rows.drop("_at", "_hint")


def source_location(file_path: Column, line: Column, archive_path: Column | None = None) -> Column:
    fallback = [blank_to_null(file_path)]
    if archive_path is not None:
        fallback.append(archive_path)
    base = F.coalesce(*fallback, F.lit("unknown"))
    return F.when(F.coalesce(line, F.lit(0)) != 0, F.concat_ws(":", base, line.cast("string"))).otherwise(base)


def has_known_hint(hint: Column) -> Column:
    trimmed = strip(F.coalesce(hint, F.lit("")))
    return (trimmed != "") & (F.upper(trimmed) != "UNKNOWN")


def usable_findings(findings: DataFrame, fallback: bool = True) -> DataFrame:
    """Findings with a usable hint; scans where none has one keep all their rows.

    Only the rows without a hint are shuffled (anti join against the scans
    that have usable rows, pre-aggregated map-side).
    """
    flagged = findings.withColumn(
        "_hint", effective_hint(F.col("algorithm_hint"), F.col("algorithm_hints"))
    )
    usable = flagged.filter(has_known_hint(F.col("_hint"))).drop("_hint")
    if not fallback:
        return usable
    rest = flagged.filter(~has_known_hint(F.col("_hint"))).drop("_hint")
    return usable.unionByName(rest.join(usable.select("scan_id").distinct(), "scan_id", "left_anti"))


def role_strength(roles: Column) -> Column:
    """Strongest role of a list, 0 for an empty one."""
    strengths = F.transform(roles, lambda r: lookup(vocab.ROLE_STRENGTH, r, 0))
    return F.coalesce(F.array_max(strengths), F.lit(0))


def usage_role(family: Column, canonical: Column) -> Column:
    text = F.lower(canonical)
    return (
        F.when(family.isin("kem", "pqc_kem", "hybrid_kem"), "key_encapsulation")
        .when(family == "key_agreement", "key_establishment")
        .when(family.isin("digital_signature", "pqc_signature", "hybrid_signature"), "digital_signature")
        .when(family == "symmetric_cipher", "encryption")
        .when(family == "hash", "hashing")
        .when(family == "mac", "mac")
        .when(family == "kdf", "key_derivation")
        .when(family == "random", "random_generation")
        .when(text.contains("tls"), "tls_kex")
        .when(text.contains("ssh"), "ssh_kex")
        .otherwise("unknown")
    )


def evidence_class(roles: Column, canonical: Column, family: Column, canonical_family: Column, detector: Column) -> Column:
    """library = bare library presence, unresolved = call without a known algorithm, else algorithm."""
    only_capability = (F.size(roles) == 1) & (F.get(roles, F.lit(0)) == "capability")
    unknown = (canonical == "UNKNOWN") | (canonical_family == "unknown")
    return (
        F.when(only_capability & (unknown | (family == "unknown")), "library")
        .when(unknown & detector.isin(vocab.UNRESOLVED_DETECTORS), "unresolved")
        .otherwise("algorithm")
    )


def sha_key(*parts: Column | str) -> Column:
    """Reproducible identifier from its parts."""
    return F.sha2(F.concat_ws("#", *[F.col(p) if isinstance(p, str) else p for p in parts]), 256)


def surface(source_type: Column) -> Column:
    return F.when(source_type == "certificate", "cert").otherwise("code")


def _or_default(df: DataFrame, name: str, default) -> Column:
    if name not in df.columns:
        return default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.col(name), default if isinstance(default, Column) else F.lit(default))


def normalize_findings(findings: DataFrame, explode_hints: bool = False) -> DataFrame:
    """Evidence table: one row per finding, with class, surface and asset key.

    No shuffle: the only joins are with two fixed tables, and the evidence
    and asset identifiers are digests of their keys.
    """
    base = expand_hints(findings) if explode_hints else findings
    hints = _or_default(base, "algorithm_hints", F.array().cast("array<string>"))
    archive = F.col("archive_path") if "archive_path" in base.columns else None
    typed = base.select(
        "scan_id",
        "ord",
        F.col("finding_id") if "finding_id" in base.columns else F.col("ord").cast("string").alias("finding_id"),
        _or_default(base, "source_type", "python_source").alias("source_type"),
        source_location(F.col("file_path"), F.col("line"), archive).alias("source_location"),
        _or_default(base, "detector", "unknown").alias("detector"),
        _or_default(base, "raw_signal", "").alias("raw_signal"),
        effective_hint(F.col("algorithm_hint"), hints).alias("hint"),
        _or_default(base, "roles", F.array(F.lit("capability"))).alias("roles"),
        _or_default(base, "confidence", 0.5).cast("double").alias("confidence"),
        *([F.col("provenance")] if "provenance" in base.columns else []),
    )
    named = canonical_metadata(normalize_names(typed, "hint"))
    classed = named.withColumns(
        {
            "evidence_id": sha_key("scan_id", "finding_id", "hint"),
            "evidence_class": evidence_class(
                F.col("roles"), F.col("canonical"), F.col("family"), F.col("c_family"), F.col("detector")
            ),
            "surface": surface(F.col("source_type")),
        }
    )
    return classed.withColumn(
        "asset_id",
        F.when(F.col("evidence_class") == "algorithm", sha_key("scan_id", "canonical", "surface")),
    ).drop("c_family", "c_status", "c_standard", "c_lifecycle", "c_note", "finding_id", "alias_note")


def merged_provenance(raw: Column, **registry: Column) -> Column:
    """Registry metadata replaces raw keys of the same name."""
    names = list(registry)
    kept = F.map_filter(raw, lambda k, v: ~k.isin(names))
    added = F.create_map(*[x for n, c in registry.items() for x in (F.lit(n), c)])
    return F.map_concat(kept, added)


def union_findings(*parts: DataFrame) -> DataFrame:
    """All detector outputs as one table; absent columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
