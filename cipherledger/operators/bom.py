"""Bill of materials: component properties, documents, validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherledger.functions import vocab
from cipherledger.functions.tables import lookup
from cipherledger.operators.inventory import top_per_key
from cipherledger.operators.ranks import positioned


def primitive(family: Column) -> Column:
    return lookup(vocab.FAMILY_PRIMITIVES, family, "unknown")


def quantum_safe(status: Column) -> Column:
    return F.coalesce(status.isin(vocab.QUANTUM_SAFE_STATUSES), F.lit(False))


def crypto_functions(family: Column, roles: Column) -> Column:
    names = (
        F.when(family.isin("digital_signature", "pqc_signature", "hybrid_signature"), F.array(F.lit("sign"), F.lit("verify")))
        .when(family == "symmetric_cipher", F.array(F.lit("encrypt"), F.lit("decrypt")))
        .when(
            family.isin("key_agreement", "kem", "pqc_kem", "hybrid_kem"),
            F.array(F.lit("keyAgreement"), F.lit("encapsulate"), F.lit("decapsulate")),
        )
        .when(family == "hash", F.array(F.lit("hash")))
        .when(family == "mac", F.array(F.lit("mac")))
        .when(family == "kdf", F.array(F.lit("keyDerive")))
    )
    in_code = F.array_contains(roles, "implementation") | F.array_contains(roles, "usage")
    return F.coalesce(F.when(in_code, names), F.array(F.lit("unknown")))


def classical_level(canonical: Column, variant: Column) -> Column:
    name, v = F.upper(canonical), F.coalesce(variant, F.lit(""))
    return (
        F.when(name.contains("AES") & v.contains("256"), 256)
        .when(name.contains("AES"), 128)
        .when(name.contains("RSA"), 112)
        .when(name.contains("ECDSA") | name.contains("ECDH"), 128)
        .when(name.contains("SHA-256"), 128)
        .when(name.contains("SHA-512"), 256)
        .otherwise(0)
    )


def quantum_level(canonical: Column, status: Column) -> Column:
    name = F.upper(canonical)
    has = lambda *texts: F.exists(F.array(*[F.lit(t) for t in texts]), lambda t: F.contains(name, t))
    return (
        F.when(~quantum_safe(status), 0)
        .when(has("ML-KEM-512", "ML-DSA-44"), 1)
        .when(has("ML-KEM-768", "ML-DSA-65"), 3)
        .when(has("ML-KEM-1024", "ML-DSA-87"), 5)
        .when(has("ML-KEM", "ML-DSA", "SLH-DSA"), 3)
        .otherwise(0)
    )


def oid(canonical: Column) -> Column:
    return lookup(vocab.ALGORITHM_OIDS, canonical, "")


def evidence_samples(evidence: DataFrame) -> DataFrame:
    """First evidence rows of each asset: 10 occurrences, of which 5 also as methods."""
    rows = evidence.filter(F.col("asset_id").isNotNull()).select(
        "asset_id", "ord", "evidence_id", "source_location", "source_type", "detector", "confidence", "canonical"
    )
    first = top_per_key(rows, "asset_id", ["ord", "evidence_id"], vocab.BOM_OCCURRENCES)
    listed = first.groupBy("asset_id").agg(
        F.array_sort(
            F.collect_list(F.struct("rn", "source_location", "source_type", "detector", "confidence", "canonical"))
        ).alias("ev")
    )
    return listed.select(
        "asset_id",
        F.transform(
            "ev",
            lambda e: F.struct(
                e["source_location"].alias("location"), e["source_type"].alias("detectorType"), F.lit("1.0.0").alias("detectorVersion")
            ),
        ).alias("occurrences"),
        F.transform(
            F.slice("ev", 1, vocab.BOM_METHODS),
            lambda e: F.struct(e["detector"].alias("technique"), e["confidence"], e["canonical"].alias("value")),
        ).alias("methods"),
    )


def components(assets: DataFrame, evidence: DataFrame) -> DataFrame:
    """One component struct per asset."""
    joined = assets.join(evidence_samples(evidence), "asset_id", "left")
    variant = F.coalesce("variant", F.lit(""))
    role_list = F.concat(F.lit("['"), F.array_join("roles", "', '"), F.lit("']"))
    algorithm = F.struct(
        primitive(F.col("family")).alias("primitive"),
        variant.alias("parameterSetIdentifier"),
        F.lit("software-plain-ram").alias("executionEnvironment"),
        F.lit("any").alias("implementationPlatform"),
        F.array(F.coalesce(F.col("parameters")["standard"], F.lit("not-certified"))).alias("certificationLevel"),
        F.lit("unknown").alias("mode"),
        F.lit("unknown").alias("padding"),
        crypto_functions(F.col("family"), F.col("roles")).alias("cryptoFunctions"),
        classical_level(F.col("canonical"), F.col("variant")).alias("classicalSecurityLevel"),
        quantum_level(F.col("canonical"), F.col("quantum_status")).alias("nistQuantumSecurityLevel"),
    )
    identity = F.struct(F.lit("name").alias("field"), F.col("confidence"), F.col("methods"))
    return joined.select(
        "asset_id", "scan_id",
        F.struct(
            F.lit("cryptographic-asset").alias("type"),
            F.col("asset_id").alias("bom-ref"),
            F.col("canonical").alias("name"),
            F.concat(
                F.lit("Cryptographic asset: "), "canonical", F.lit(". Claim state: "), "claim_state",
                F.lit(". Evidence roles: "), role_list, F.lit("."),
            ).alias("description"),
            F.struct(
                F.lit("algorithm").alias("assetType"), algorithm.alias("algorithmProperties"), oid(F.col("canonical")).alias("oid")
            ).alias("cryptoProperties"),
            F.when(
                F.col("occurrences").isNotNull(), F.struct(F.col("occurrences"), identity.alias("identity"))
            ).alias("evidence"),
        ).alias("component"),
    )


def _serial(scan: Column) -> Column:
    h = F.sha2(F.concat(F.lit("bom#"), scan), 256)
    cut = [F.substring(h, p, n) for p, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *cut))


def _titled(counts: DataFrame, names: DataFrame) -> DataFrame:
    return counts.join(names.select("scan_id", "project_name"), "scan_id", "left").withColumn(
        "project_name", F.coalesce("project_name", F.lit("unknown-project"))
    )


def _head(timestamp: str, tool: str, tool_version: str) -> list[Column]:
    """Fields of a document in front of its components."""
    prop = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    meta = F.struct(
        F.lit(timestamp).alias("timestamp"),
        F.array(F.struct(F.lit(tool).alias("name"), F.lit(tool_version).alias("version"))).alias("tools"),
        F.struct(
            F.lit("library").alias("type"), F.col("project_name").alias("name"), F.concat(F.lit("project-"), "scan_id").alias("bom-ref")
        ).alias("component"),
        F.array(
            prop("scanId", F.col("scan_id")),
            prop("assetCount", F.col("asset_count").cast("string")),
            prop("bomStandard", F.lit(f"{vocab.BOM_FORMAT} {vocab.BOM_VERSION}")),
        ).alias("properties"),
    )
    return [
        F.lit(vocab.BOM_FORMAT).alias("bomFormat"), F.lit(vocab.BOM_VERSION).alias("specVersion"),
        F.lit(vocab.BOM_SCHEMA).alias("$schema"), _serial(F.col("scan_id")).alias("serialNumber"), F.lit(1).alias("version"),
        meta.alias("metadata"),
    ]


@dataclass(frozen=True)
class Bill:
    """A bill as tables: one header row a scan and its components in order.

    ``headers``: scan_id, asset_count, project_name, header (struct of all fields but the
    components); ``rows``: scan_id, position, asset_id, name, component, evidence_count (all
    evidence of the asset; a component shows the first occurrences and methods only).
    """

    headers: DataFrame
    rows: DataFrame


def bill(parts: DataFrame, assets: DataFrame, names: DataFrame, timestamp: str, tool: str = "cipherledger", tool_version: str = "1.0.0") -> Bill:
    """Components by scan, name and asset id; a scan with many assets spreads over tasks and is never one value."""
    counts = assets.select("asset_id", "evidence_count")
    named = parts.select("scan_id", F.col("component")["name"].alias("name"), "asset_id", "component").join(counts, "asset_id", "left")
    rows = positioned(named, "scan_id", ["name", "asset_id"])
    headers = _titled(parts.groupBy("scan_id").agg(F.count("*").alias("asset_count")), names)
    return Bill(headers.select("scan_id", "asset_count", "project_name", F.struct(*_head(timestamp, tool, tool_version)).alias("header")), rows)


def export(whole: Bill, folder: str) -> None:
    """Write a bill as JSON lines, a folder a scan: the header is line 0, components follow by position.

    Files of a scan hold neighbouring positions; no task holds a whole scan.
    """
    head = whole.headers.select("scan_id", F.lit(0).cast("long").alias("position"), F.to_json("header").alias("value"))
    rows = whole.rows.select("scan_id", "position", F.to_json("component").alias("value"))
    lines = head.unionByName(rows).repartitionByRange("scan_id", "position").sortWithinPartitions("scan_id", "position")
    lines.select("scan_id", "value").write.partitionBy("scan_id").text(folder)


def documents(parts: DataFrame, names: DataFrame, timestamp: str, tool: str = "cipherledger", tool_version: str = "1.0.0") -> DataFrame:
    """One JSON document per scan; ``names`` has scan_id and project_name.

    A document is one value, so the components of one scan meet in one row: for scans
    beyond what a row can hold (2 GB) use ``bill`` and ``export``.
    """
    grouped = parts.groupBy("scan_id").agg(
        F.count("*").alias("asset_count"),
        F.array_sort(F.collect_list(F.struct(F.col("component")["name"].alias("n"), "asset_id", "component"))).alias("c"),
    )
    document = F.struct(*_head(timestamp, tool, tool_version), F.transform("c", lambda x: x["component"]).alias("components"))
    return _titled(grouped, names).select("scan_id", "asset_count", F.to_json(document).alias("document"))


_TOP = ["bomFormat", "specVersion", "serialNumber", "version", "metadata", "components"]


def validate(rows: DataFrame, document: str = "document") -> DataFrame:
    """Structural errors of each document and whether it is valid."""
    fields = F.coalesce(F.from_json(F.col(document), "map<string,string>"), F.create_map().cast("map<string,string>"))
    parts = F.coalesce(
        F.from_json(F.try_element_at("_f", F.lit("components")), "array<map<string,string>>"), F.array().cast("array<map<string,string>>")
    )
    get = lambda k: F.try_element_at("_f", F.lit(k))
    shown = lambda k: F.coalesce(get(k), F.lit("None"))
    has = lambda m, k: F.array_contains(F.map_keys(m), k)

    def component_errors(c: Column, i: Column) -> Column:
        head = F.concat(F.lit("Component "), i.cast("string"), F.lit(": "))
        crypto = F.from_json(F.try_element_at(c, F.lit("cryptoProperties")), "map<string,string>")
        return F.array(
            F.when(
                ~F.equal_null(F.try_element_at(c, F.lit("type")), F.lit("cryptographic-asset")),
                F.concat(head, F.lit("type must be 'cryptographic-asset'")),
            ),
            F.when(~has(c, "name"), F.concat(head, F.lit("missing 'name'"))),
            F.when(~has(c, "cryptoProperties"), F.concat(head, F.lit("missing 'cryptoProperties'"))),
            F.when(
                has(c, "cryptoProperties") & ~F.coalesce(has(crypto, "assetType"), F.lit(False)),
                F.concat(head, F.lit("cryptoProperties missing 'assetType'")),
            ),
        )

    top = F.array(
        *[F.when(~has(F.col("_f"), k), F.lit(f"Missing required field: {k}")) for k in _TOP],
        F.when(
            ~F.equal_null(get("bomFormat"), F.lit(vocab.BOM_FORMAT)),
            F.concat(F.lit(f"bomFormat must be '{vocab.BOM_FORMAT}', got '"), shown("bomFormat"), F.lit("'")),
        ),
        F.when(
            ~F.equal_null(get("specVersion"), F.lit(vocab.BOM_VERSION)),
            F.concat(F.lit(f"specVersion must be '{vocab.BOM_VERSION}', got '"), shown("specVersion"), F.lit("'")),
        ),
    )
    return (
        rows.withColumn("_f", fields)
        .withColumn("_c", parts)
        .withColumn("errors", F.array_compact(F.concat(top, F.flatten(F.transform("_c", component_errors)))))
        .withColumn("is_valid", F.size("errors") == 0)
        .drop("_f", "_c")
    )


def reduced_export(assets: DataFrame) -> DataFrame:
    """Short component record per inventory row."""
    record = F.struct(
        F.lit("cryptographic-asset").alias("type"), F.col("canonical").alias("name"), F.col("variant").alias("version"),
        F.struct(
            F.col("family").alias("assetType"),
            F.struct("variant", F.col("quantum_status").alias("quantumStatus"), "confidence").alias("algorithmProperties"),
        ).alias("cryptoProperties"),
    )
    return assets.select("asset_id", F.to_json(record).alias("record"))


def restore_values(rows: DataFrame) -> DataFrame:
    """Stored rows with unknown enumeration values replaced by their defaults."""
    known = lambda c, values, default: F.when(F.col(c).isin(values), F.col(c)).otherwise(F.lit(default))
    roles = F.array(*[F.lit(r) for r in vocab.EVIDENCE_ROLES])
    return rows.withColumns(
        {
            "family": known("family", vocab.FAMILIES, "unknown"),
            "quantum_status": known("quantum_status", vocab.QUANTUM_STATUSES, "unknown"),
            "claim_state": known("claim_state", vocab.CLAIM_STATES, "ambiguous"),
            "usage_role": known("usage_role", vocab.USAGE_ROLES, "unknown"),
            "lifecycle": known("lifecycle", vocab.LIFECYCLES, "unknown"),
            "roles": F.array_distinct(F.filter(F.coalesce("roles", F.array().cast("array<string>")), lambda r: F.array_contains(roles, r))),
        }
    )
