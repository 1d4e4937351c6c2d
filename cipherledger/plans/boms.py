"""Queries: bill of materials (B1-B10) and bill checks (L4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cipherledger.functions import vocab
from cipherledger.operators import bom
from cipherledger.plans import fixtures as fx
from cipherledger.plans.registry import cte, query, sql

STAMP = "2024-01-01T00:00:00+00:00"


def _case(column: str, mapping: dict, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE '{default}' END"


@query("b1_primitive_and_flag", sql(
    f"SELECT asset_id, {_case('family', vocab.FAMILY_PRIMITIVES, 'unknown')} AS primitive, quantum_status IN ('safe', 'hybrid') AS quantum_safe "
    "FROM assets", "assets"))
def b1(spark, d):
    return fx.assets(spark, d).select(
        "asset_id", bom.primitive(F.col("family")).alias("primitive"), bom.quantum_safe(F.col("quantum_status")).alias("quantum_safe")
    )


_FUNCTIONS = (
    "CASE WHEN NOT list_has_any(roles, ['implementation', 'usage']) THEN 'unknown' "
    "WHEN family IN ('digital_signature', 'pqc_signature', 'hybrid_signature') THEN 'sign,verify' WHEN family = 'symmetric_cipher' THEN 'encrypt,decrypt' "
    "WHEN family IN ('key_agreement', 'kem', 'pqc_kem', 'hybrid_kem') THEN 'keyAgreement,encapsulate,decapsulate' "
    "WHEN family = 'hash' THEN 'hash' WHEN family = 'mac' THEN 'mac' WHEN family = 'kdf' THEN 'keyDerive' ELSE 'unknown' END"
)


@query("b2_crypto_functions", sql(f"SELECT asset_id, {_FUNCTIONS} AS functions FROM assets", "assets"))
def b2(spark, d):
    return fx.assets(spark, d).select(
        "asset_id", F.array_join(bom.crypto_functions(F.col("family"), F.col("roles")), ",").alias("functions")
    )


_CLASSICAL = (
    "CASE WHEN contains(upper(canonical), 'AES') THEN CASE WHEN contains(coalesce(variant, ''), '256') THEN 256 ELSE 128 END "
    "WHEN contains(upper(canonical), 'RSA') THEN 112 WHEN contains(upper(canonical), 'ECDSA') OR contains(upper(canonical), 'ECDH') THEN 128 "
    "WHEN contains(upper(canonical), 'SHA-256') THEN 128 WHEN contains(upper(canonical), 'SHA-512') THEN 256 ELSE 0 END"
)
_QUANTUM = (
    "CASE WHEN quantum_status NOT IN ('safe', 'hybrid') THEN 0 WHEN regexp_matches(upper(canonical), 'ML-KEM-512|ML-DSA-44') THEN 1 "
    "WHEN regexp_matches(upper(canonical), 'ML-KEM-768|ML-DSA-65') THEN 3 WHEN regexp_matches(upper(canonical), 'ML-KEM-1024|ML-DSA-87') THEN 5 "
    "WHEN regexp_matches(upper(canonical), 'ML-KEM|ML-DSA|SLH-DSA') THEN 3 ELSE 0 END"
)


@query("b3_classical_level", sql(f"SELECT asset_id, {_CLASSICAL} AS level FROM assets", "assets"))
def b3(spark, d):
    return fx.assets(spark, d).select("asset_id", bom.classical_level(F.col("canonical"), F.col("variant")).alias("level"))


@query("b4_quantum_level", sql(f"SELECT asset_id, {_QUANTUM} AS level FROM assets", "assets"))
def b4(spark, d):
    return fx.assets(spark, d).select("asset_id", bom.quantum_level(F.col("canonical"), F.col("quantum_status")).alias("level"))


# levels over names composed from parts, so that every branch occurs
_NAMES = fx.Projection(
    "level_names",
    "part",
    (
        "p_partkey",
        "split_part('ML-KEM-512,ml-kem-768,ML-KEM-1024,ML-DSA-44,ML-DSA-65,ML-DSA-87,SLH-DSA-x,SHA-512,ECDH,aes', ',', CAST(p_partkey % 10 + 1 AS INT)) AS canonical",
        "CASE p_partkey % 3 WHEN 0 THEN '256-GCM' WHEN 1 THEN '128' END AS variant",
        "CASE p_partkey % 7 WHEN 0 THEN 'vulnerable' WHEN 1 THEN 'hybrid' ELSE 'safe' END AS quantum_status",
    ),
).register()


@query("b4_levels_by_name", sql(
    f"SELECT p_partkey, {_CLASSICAL} AS classical, {_QUANTUM} AS quantum FROM level_names", "level_names"))
def b4b(spark, d):
    return _NAMES(spark, d).select(
        "p_partkey", bom.classical_level(F.col("canonical"), F.col("variant")).alias("classical"),
        bom.quantum_level(F.col("canonical"), F.col("quantum_status")).alias("quantum"),
    )


@query("b5_oid", sql(f"SELECT asset_id, {_case('canonical', vocab.ALGORITHM_OIDS, '')} AS oid FROM assets", "assets"))
def b5(spark, d):
    return fx.assets(spark, d).select("asset_id", bom.oid(F.col("canonical")).alias("oid"))


cte(
    "first_evidence",
    "SELECT asset_id, string_agg(source_location, ',' ORDER BY rn) AS locations, string_agg(detector, ',' ORDER BY rn) FILTER (WHERE rn <= 5) AS methods "
    "FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY ord, evidence_id) AS rn FROM evidence WHERE asset_id IS NOT NULL) "
    "WHERE rn <= 10 GROUP BY asset_id",
    "evidence",
)


@query("b6_components", sql(
    "SELECT a.asset_id, 'Cryptographic asset: ' || canonical || '. Claim state: ' || claim_state || '. Evidence roles: [''' || "
    f"array_to_string(roles, ''', ''') || '''].' AS description, coalesce(variant, '') AS parameter_set, standard AS certification, {_FUNCTIONS} AS functions, "
    f"{_case('canonical', vocab.ALGORITHM_OIDS, '')} AS oid, f.locations, f.methods FROM assets a JOIN first_evidence f ON f.asset_id = a.asset_id",
    "assets", "first_evidence"))
def b6(spark, d):
    c = F.col("component")
    algorithm = c["cryptoProperties"]["algorithmProperties"]
    return bom.components(fx.assets(spark, d), fx.evidence(spark, d)).select(
        "asset_id", c["description"].alias("description"), algorithm["parameterSetIdentifier"].alias("parameter_set"),
        F.array_join(algorithm["certificationLevel"], ",").alias("certification"),
        F.array_join(algorithm["cryptoFunctions"], ",").alias("functions"), c["cryptoProperties"]["oid"].alias("oid"),
        F.array_join(F.transform(c["evidence"]["occurrences"], lambda o: o["location"]), ",").alias("locations"),
        F.array_join(F.transform(c["evidence"]["identity"]["methods"], lambda o: o["technique"]), ",").alias("methods"),
    )


def _documents(spark, d):
    parts = bom.components(fx.assets(spark, d), fx.evidence(spark, d))
    names = fx.SCANS(spark, d).select("scan_id", F.col("project_id").alias("project_name"))
    return bom.documents(parts, names, STAMP)


@query("b7_documents", sql(
    "SELECT a.scan_id, 'CycloneDX' AS format, '1.7' AS spec_version, count(*)::VARCHAR AS asset_count, "
    "coalesce(any_value(s.project_id), 'unknown-project') AS project_name, string_agg(canonical, ',' ORDER BY canonical, asset_id) AS names "
    "FROM assets a LEFT JOIN scans s ON s.scan_id = a.scan_id GROUP BY a.scan_id", "assets", "scans"))
def b7(spark, d):
    at = lambda p: F.get_json_object("document", p)
    names = F.from_json(F.get_json_object("document", "$.components[*].name"), "array<string>")
    one = F.when(F.size(names) > 0, names).otherwise(F.array(at("$.components[0].name")))
    return _documents(spark, d).select(
        "scan_id", at("$.bomFormat").alias("format"), at("$.specVersion").alias("spec_version"),
        at("$.metadata.properties[1].value").alias("asset_count"), at("$.metadata.component.name").alias("project_name"),
        F.array_join(F.coalesce(one, F.array(at("$.components[0].name"))), ",").alias("names"),
    )


@query("b7_bill", sql(
    "SELECT a.scan_id, row_number() OVER (PARTITION BY a.scan_id ORDER BY a.canonical, a.asset_id)::BIGINT AS position, a.asset_id, a.canonical AS name, "
    "a.evidence_count::BIGINT AS evidence_count, least(a.evidence_count, 10)::INT AS occurrences, least(a.evidence_count, 5)::INT AS methods FROM assets a UNION ALL "
    "SELECT a.scan_id, 0, NULL, coalesce(any_value(s.project_id), 'unknown-project'), count(*), NULL, NULL "
    "FROM assets a LEFT JOIN scans s ON s.scan_id = a.scan_id GROUP BY a.scan_id", "assets", "scans"))
def b7_bill(spark, d):
    """Header and component rows in order, with the true number of evidence rows beside the shown ones."""
    assets, evidence = fx.assets(spark, d), fx.evidence(spark, d)
    names = fx.SCANS(spark, d).select("scan_id", F.col("project_id").alias("project_name"))
    whole = bom.bill(bom.components(assets, evidence), assets, names, STAMP)
    shown = F.col("component")["evidence"]
    rows = whole.rows.select(
        "scan_id", "position", "asset_id", "name", F.col("evidence_count").cast("long").alias("evidence_count"), F.size(shown["occurrences"]).alias("occurrences"),
        F.size(shown["identity"]["methods"]).alias("methods"),
    )
    heads = whole.headers.select(
        "scan_id", F.lit(0).cast("long").alias("position"), F.lit(None).cast("string").alias("asset_id"), F.col("header")["metadata"]["component"]["name"].alias("name"),
        F.col("asset_count").alias("evidence_count"), F.lit(None).cast("int").alias("occurrences"), F.lit(None).cast("int").alias("methods"),
    )
    return rows.unionByName(heads)


@query("b8_validate_documents", sql(
    "SELECT scan_id, true AS is_valid, 0 AS errors FROM (SELECT DISTINCT scan_id FROM assets)", "assets"))
def b8(spark, d):
    return bom.validate(_documents(spark, d)).select("scan_id", "is_valid", F.size("errors").alias("errors"))


_FAULTY = fx.Projection(
    "faulty_documents",
    "events",
    (
        "event_id",
        "'{\"specVersion\": \"' || CASE event_id % 4 WHEN 0 THEN '1.6' ELSE '1.7' END || '\", ' || "
        "CASE event_id % 3 WHEN 0 THEN '' ELSE '\"bomFormat\": \"CycloneDX\", ' END || "
        "CASE event_id % 5 WHEN 0 THEN '' ELSE '\"serialNumber\": \"s\", ' END || '\"version\": 1, \"metadata\": {\"k\": 1}, \"components\": [{' || "
        "CASE event_id % 7 WHEN 0 THEN '\"type\": \"library\"' ELSE '\"type\": \"cryptographic-asset\"' END || "
        "CASE event_id % 2 WHEN 0 THEN '' ELSE ', \"name\": \"AES\"' END || "
        "CASE event_id % 11 WHEN 0 THEN '' WHEN 1 THEN ', \"cryptoProperties\": {\"x\": 1}' ELSE ', \"cryptoProperties\": {\"assetType\": \"algorithm\"}' END || "
        "'}]}' AS document",
    ),
).register()


@query("b8_validate_faulty", sql(
    "SELECT event_id, errors = '' AS is_valid, errors FROM (SELECT event_id, array_to_string(list_filter(["
    "CASE WHEN event_id % 3 = 0 THEN 'Missing required field: bomFormat' END, CASE WHEN event_id % 5 = 0 THEN 'Missing required field: serialNumber' END, "
    "CASE WHEN event_id % 3 = 0 THEN 'bomFormat must be ''CycloneDX'', got ''None''' END, "
    "CASE WHEN event_id % 4 = 0 THEN 'specVersion must be ''1.7'', got ''1.6''' END, "
    "CASE WHEN event_id % 7 = 0 THEN 'Component 0: type must be ''cryptographic-asset''' END, "
    "CASE WHEN event_id % 2 = 0 THEN 'Component 0: missing ''name''' END, "
    "CASE WHEN event_id % 11 = 0 THEN 'Component 0: missing ''cryptoProperties''' END, "
    "CASE WHEN event_id % 11 = 1 THEN 'Component 0: cryptoProperties missing ''assetType''' END], lambda e: e IS NOT NULL), '; ') AS errors FROM events)"))
def b8b(spark, d):
    return bom.validate(_FAULTY(spark, d)).select("event_id", "is_valid", F.array_join("errors", "; ").alias("errors"))


@query("b9_reduced_export", sql(
    "SELECT asset_id, canonical AS name, variant AS version, family AS asset_type, quantum_status, round(confidence, 6) AS confidence FROM assets", "assets"))
def b9(spark, d):
    at = lambda p: F.get_json_object("record", p)
    p = "$.cryptoProperties.algorithmProperties"
    return bom.reduced_export(fx.assets(spark, d)).select(
        "asset_id", at("$.name").alias("name"), at("$.version").alias("version"), at("$.cryptoProperties.assetType").alias("asset_type"),
        at(f"{p}.quantumStatus").alias("quantum_status"), F.round(at(f"{p}.confidence").cast("double"), 6).alias("confidence"),
    )


_STORED = fx.Projection(
    "stored_assets",
    "lineitem",
    (
        "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS row_id",
        "CASE l_partkey % 4 WHEN 0 THEN 'hash' WHEN 1 THEN 'mac' WHEN 2 THEN 'bogus' END AS family",
        "CASE l_suppkey % 3 WHEN 0 THEN 'safe' WHEN 1 THEN 'Safe' ELSE 'hybrid' END AS quantum_status",
        "CASE l_linenumber % 3 WHEN 0 THEN 'supported' WHEN 1 THEN 'none' ELSE 'contradictory' END AS claim_state",
        "CASE l_linenumber % 2 WHEN 0 THEN 'hashing' ELSE 'digest' END AS usage_role",
        "CASE l_returnflag WHEN 'R' THEN 'deprecated' ELSE 'old' END AS lifecycle",
        "split(CASE l_linenumber % 3 WHEN 0 THEN 'usage,bogus,usage' WHEN 1 THEN 'nothing' ELSE 'observed,capability' END, ',') AS roles",
    ),
).register()


@query("b10_restored_values", sql(
    "SELECT row_id, CASE WHEN family IN ('hash', 'mac') THEN family ELSE 'unknown' END AS family, "
    "CASE WHEN quantum_status IN ('safe', 'hybrid') THEN quantum_status ELSE 'unknown' END AS quantum_status, "
    "CASE WHEN claim_state = 'none' THEN 'ambiguous' ELSE claim_state END AS claim_state, "
    "CASE WHEN usage_role = 'digest' THEN 'unknown' ELSE usage_role END AS usage_role, "
    "CASE WHEN lifecycle = 'old' THEN 'unknown' ELSE lifecycle END AS lifecycle, "
    "CASE WHEN roles[1] = 'usage' THEN 'usage' WHEN roles[1] = 'nothing' THEN '' ELSE 'observed,capability' END AS roles FROM stored_assets", "stored_assets"))
def b10(spark, d):
    return bom.restore_values(_STORED(spark, d)).withColumn("roles", F.array_join("roles", ","))


@query("l4_presence_checks", sql(
    "SELECT s.scan_id, coalesce(a.n, 0) > 0 AS has_assets, coalesce(e.n, 0) > 0 AS has_evidence, coalesce(a.n, 0) > 0 AND coalesce(a.mock, 0) = 0 AS has_real_bom "
    "FROM scans s LEFT JOIN (SELECT scan_id, count(*) AS n, count(*) FILTER (WHERE lower(canonical) IN ('aes-256-gcm', 'mock', 'placeholder', 'example-rsa-key')) AS mock "
    "FROM assets GROUP BY scan_id) a ON a.scan_id = s.scan_id LEFT JOIN (SELECT scan_id, count(*) AS n FROM evidence GROUP BY scan_id) e ON e.scan_id = s.scan_id",
    "scans", "assets", "evidence"))
def l4(spark, d):
    from cipherledger.operators.evaluate import presence_checks

    return presence_checks(fx.SCANS(spark, d), fx.assets(spark, d), fx.evidence(spark, d))
