"""The given tables projected onto the inventory's input tables.

Each projection is a list of expressions that Spark and the oracle engine
both read, so both sides start from the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cipherledger.functions import vocab
from cipherledger.functions.tables import values_sql
from cipherledger.plans.registry import cte


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@dataclass(frozen=True)
class Projection:
    name: str
    source: str
    columns: tuple[str, ...]
    where: str | None = None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        df = table(spark, folder, self.source)
        if self.where:
            df = df.filter(self.where)
        return df.selectExpr(*self.columns)

    def register(self) -> Projection:
        where = f" WHERE {self.where}" if self.where else ""
        cte(self.name, f"SELECT {', '.join(self.columns)} FROM {self.source}{where}")
        return self


HINTS = "RS256,aes_256_gcm,AES-128-GCM,sha256,ES384,ml-kem-768,X25519,hs256,jwt,, RSA ,TLSv1.3"

FINDINGS = Projection(
    "findings",
    "lineitem",
    (
        "'scan-' || (l_orderkey % 500) AS scan_id",
        "(l_orderkey * 10 + l_linenumber) * 16 + l_partkey % 12 AS ord",
        "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || "
        "CAST(round(l_extendedprice * 100) AS BIGINT) || '-' || CAST(CAST(l_shipdate AS DATE) AS STRING) AS finding_id",
        "'svc/' || l_suppkey || '/src/f' || (l_orderkey % 97) || '.py' AS file_path",
        "l_linenumber AS line",
        "CASE l_returnflag WHEN 'R' THEN 'certificate' WHEN 'A' THEN 'config' ELSE 'python_source' END AS source_type",
        "CASE l_linestatus WHEN 'O' THEN 'python.ast.call' ELSE 'config.text_scan' END AS detector",
        "'part ' || l_partkey || ' qty ' || CAST(round(l_quantity) AS BIGINT) AS raw_signal",
        "split(CASE l_linenumber % 5 WHEN 0 THEN 'capability' WHEN 1 THEN 'implementation' "
        "WHEN 2 THEN 'implementation,usage' WHEN 3 THEN 'configuration' ELSE 'observed' END, ',') AS roles",
        f"split_part('{HINTS}', ',', CAST(l_partkey % 12 + 1 AS INT)) AS algorithm_hint",
        "CASE WHEN l_partkey % 12 = 9 AND l_suppkey % 2 = 0 THEN split('md5,sha1', ',') END AS algorithm_hints",
        "'pkg' || (l_partkey % 50) AS package_name",
        "round(0.10 + l_discount * 5, 2) AS confidence",
    ),
).register()

SCANS = Projection(
    "scans",
    "orders",
    (
        "'scan-' || o_orderkey AS scan_id",
        "'project-' || (o_custkey % 211) AS project_id",
        "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'failed' END AS state",
        "CASE o_orderkey % 2 WHEN 0 THEN 'live' ELSE 'replay' END AS mode",
        "CAST(o_orderdate AS DATE) AS created_at",
    ),
).register()

PROJECTS = Projection(
    "projects",
    "customer",
    (
        "'project-' || c_custkey AS project_id",
        "CASE c_custkey % 60 WHEN 0 THEN 'jjwt-' || c_custkey WHEN 1 THEN 'PyJWT' WHEN 2 THEN ' certbot ' "
        "WHEN 3 THEN 'paramiko' WHEN 4 THEN 'My JJWT fork' ELSE c_name END AS name",
        "c_mktsegment AS description",
    ),
).register()

# --- fixed tables ------------------------------------------------------------
cte("aliases", f"SELECT * FROM ({values_sql(vocab.ALIAS_ROWS)}) AS t({', '.join(vocab.ALIAS_COLUMNS)})")
cte(
    "packages",
    f"SELECT pkg_rank, pkg_key, ecosystem, string_split(algorithms, ',') AS algorithms "
    f"FROM ({values_sql(vocab.PACKAGE_ROWS)}) AS t({', '.join(vocab.PACKAGE_COLUMNS)})",
)
cte(
    "canon",
    "SELECT DISTINCT n.canonical AS c_name, m.family AS c_family, m.quantum_status AS c_status, "
    "m.standard AS c_standard, coalesce(nullif(m.lifecycle, ''), 'unknown') AS c_lifecycle, m.note AS c_note "
    "FROM aliases n JOIN aliases m ON m.alias_key = translate(lower(n.canonical), ' _', '--')",
    "aliases",
)
cte(
    "registry",
    "SELECT registry_rank, name, standard, status, family, string_split(usage_roles, ',') AS usage_roles, "
    "string_split(variants, ',') AS variants, "
    "list_transform(string_split(security_categories, ','), lambda x: CAST(x AS INT)) AS security_categories, "
    "notes, string_split(trade_offs, ';') AS trade_offs, overhead_ms, cpu_factor, public_key_bytes, "
    "bandwidth_kb, complexity, cost_tier "
    f"FROM ({values_sql([(i, *r) for i, r in enumerate(vocab.REGISTRY_ROWS)])}) "
    f"AS t(registry_rank, {', '.join(vocab.REGISTRY_COLUMNS)})",
)

# --- evidence and assets -----------------------------------------------------
cte(
    "hinted",
    "SELECT *, coalesce(nullif(algorithm_hint, ''), algorithm_hints[1], '') AS hint FROM findings",
    "findings",
)
_UNRESOLVED = ", ".join(f"'{d}'" for d in vocab.UNRESOLVED_DETECTORS)
cte(
    "evidence",
    f"""
SELECT *, CASE WHEN evidence_class = 'algorithm' THEN sha256(scan_id || '#' || canonical || '#' || surface) END AS asset_id
FROM (
  SELECT h.scan_id, h.ord, h.source_type, h.file_path || ':' || h.line AS source_location, h.detector,
    h.raw_signal AS raw_signal, h.hint, h.roles, h.confidence, h.finding_id,
    sha256(h.scan_id || '#' || h.finding_id || '#' || h.hint) AS evidence_id,
    coalesce(a.canonical, nullif(trim(h.hint), ''), 'UNKNOWN') AS canonical,
    coalesce(a.family, 'unknown') AS family, coalesce(a.quantum_status, 'unknown') AS quantum_status,
    coalesce(a.variant, '') AS variant, coalesce(a.standard, '') AS standard,
    CASE WHEN h.source_type = 'certificate' THEN 'cert' ELSE 'code' END AS surface,
    CASE WHEN h.roles = ['capability'] AND (coalesce(c.c_family, 'unknown') = 'unknown' OR coalesce(a.family, 'unknown') = 'unknown')
           THEN 'library'
         WHEN coalesce(c.c_family, 'unknown') = 'unknown' AND h.detector IN ({_UNRESOLVED}) THEN 'unresolved'
         ELSE 'algorithm' END AS evidence_class
  FROM hinted h
  LEFT JOIN aliases a ON a.alias_key = translate(lower(trim(h.hint)), ' _', '--')
  LEFT JOIN canon c ON c.c_name = coalesce(a.canonical, nullif(trim(h.hint), ''), 'UNKNOWN')
)""",
    "hinted", "aliases", "canon",
)
cte(
    "fused",
    """
SELECT scan_id, canonical, surface, count(*) AS evidence_count, max(confidence) AS best, min(ord) AS first_ord,
  arg_min(family, ord) FILTER (WHERE family IN ('digital_signature', 'mac')) AS refined_family,
  arg_min(variant, ord) FILTER (WHERE variant <> '') AS variant,
  coalesce(list_sort(list_distinct(list(variant) FILTER (WHERE variant <> '' AND list_contains(roles, 'configuration')))), []) AS config_variants,
  coalesce(list_sort(list_distinct(list(variant) FILTER (WHERE variant <> '' AND NOT list_contains(roles, 'configuration')
      AND (list_contains(roles, 'usage') OR list_contains(roles, 'implementation'))))), []) AS code_variants,
  list_filter(['capability', 'implementation', 'usage', 'configuration', 'observed'],
      lambda r: list_contains(flatten(list(roles)), r)) AS roles
FROM evidence WHERE evidence_class = 'algorithm' GROUP BY scan_id, canonical, surface""",
    "evidence",
)
cte(
    "assets",
    """
SELECT *,
  CASE WHEN family IN ('kem', 'pqc_kem', 'hybrid_kem') THEN 'key_encapsulation'
       WHEN family = 'key_agreement' THEN 'key_establishment'
       WHEN family IN ('digital_signature', 'pqc_signature', 'hybrid_signature') THEN 'digital_signature'
       WHEN family = 'symmetric_cipher' THEN 'encryption' WHEN family = 'hash' THEN 'hashing'
       WHEN family = 'mac' THEN 'mac' WHEN family = 'kdf' THEN 'key_derivation'
       WHEN family = 'random' THEN 'random_generation'
       WHEN contains(lower(canonical), 'tls') THEN 'tls_kex' WHEN contains(lower(canonical), 'ssh') THEN 'ssh_kex'
       ELSE 'unknown' END AS usage_role
FROM (
  SELECT sha256(f.scan_id || '#' || f.canonical || '#' || f.surface) AS asset_id, f.scan_id, f.canonical, f.surface,
    coalesce(f.refined_family, c.c_family, 'unknown') AS family, f.variant,
    coalesce(c.c_standard, '') AS standard, coalesce(c.c_note, '') AS note, f.roles,
    CASE WHEN len(config_variants) > 0 AND len(code_variants) > 0 AND NOT list_has_any(config_variants, code_variants)
           THEN 'contradictory'
         WHEN list_has_any(f.roles, ['usage', 'implementation', 'configuration', 'observed']) THEN 'supported'
         ELSE 'ambiguous' END AS claim_state,
    least(1.0, best + 0.05 * log2(evidence_count)) AS confidence,
    coalesce(c.c_status, 'unknown') AS quantum_status, coalesce(c.c_lifecycle, 'unknown') AS lifecycle,
    f.evidence_count, f.config_variants, f.code_variants, f.first_ord
  FROM fused f LEFT JOIN canon c ON c.c_name = f.canonical
)""",
    "fused", "canon",
)


def findings(spark: SparkSession, folder: str) -> DataFrame:
    return FINDINGS(spark, folder)


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    from cipherledger.operators.normalize import normalize_findings

    return normalize_findings(findings(spark, folder))


def assets(spark: SparkSession, folder: str) -> DataFrame:
    from cipherledger.operators.fuse import fuse_assets

    return fuse_assets(evidence(spark, folder))
