"""Whole run: files -> findings -> evidence -> assets -> graph -> risk -> plan -> bill."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cipherledger.functions import vocab
from cipherledger.operators import bom, detect_certificates, detect_config, detect_dependencies, detect_images, detect_java, detect_python
from cipherledger.operators import fuse, graph, migrate, normalize, reach, risk
from cipherledger.session import written, written_path
from cipherledger.sources import quarantine

COLUMNS = ["scan_id", "path", "line", "detector", "raw_signal", "roles", "algorithm_hint", "algorithm_hints", "package_name", "confidence", "source_type"]
HINTS = 1_000_000  # room between the numbers of two findings


def land_files(files: DataFrame, path: str) -> DataFrame:
    """Accepted files of ``quarantine.land``: scan_id, path, content, artifact_type."""
    return quarantine.land(files, path).accepted


def numbered(findings: DataFrame) -> DataFrame:
    """``finding_id`` and ``ord`` that depend on the rows alone and are unique.

    Findings of a file are numbered in order of line, detector, hint and signal; rows
    that agree in all of these are interchangeable. ``ord`` is the hash of the path
    (64 bits), the number in the file and room for the hints of a finding.
    """
    alike = ["line", "detector", F.coalesce("algorithm_hint", F.lit("")), "raw_signal", F.to_json("roles"), F.coalesce("confidence", F.lit(0.0))]
    place = F.row_number().over(Window.partitionBy("scan_id", "file_path").orderBy(*alike))
    number = place.cast("decimal(38,0)")
    path = F.xxhash64("file_path").cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")
    return (
        findings.withColumn("_place", number)
        .withColumn("finding_id", F.concat_ws("|", "file_path", F.col("line").cast("string"), "detector", F.col("_place").cast("string")))
        .withColumn("ord", (path * F.lit(10**17).cast("decimal(18,0)") + F.col("_place") * HINTS).cast("decimal(38,0)"))
        .drop("_place")
    )


def _detected(landed: DataFrame, check_syntax: bool, errors: bool) -> DataFrame:
    of = lambda kind: landed.filter(F.col("artifact_type") == kind).select("scan_id", "path", "content")
    parts = [
        detect_python.scan_python(of("python_source"), check_syntax, errors),
        detect_java.scan_java(of("java_source")),
        detect_dependencies.scan_dependencies(of("dependency")),
        detect_images.scan_build_files(of("image_file")),
        detect_config.scan_config(of("config"), errors),
    ]
    found = normalize.union_findings(*[p.select(*[c for c in COLUMNS if c in p.columns]) for p in parts])
    return found.withColumnRenamed("path", "file_path")


def discover(landed: DataFrame, check_syntax: bool = True) -> DataFrame:
    """Findings of routed files (scan_id, path, content, artifact_type) from all text detectors."""
    return numbered(_detected(landed, check_syntax, errors=False))


@dataclass(frozen=True)
class Discovery:
    """``findings`` of the accepted files; ``errors``: scan_id, path, reason, error_code of rejected files and failed detectors."""

    findings: DataFrame
    errors: DataFrame


def discover_run(landing: quarantine.Landing, check_syntax: bool = True) -> Discovery:
    """Findings and errors of a landing, from one pass of the detectors that is stored by what its rows are.

    A detector that cannot read a file yields an error row for it; other files are not touched.
    """
    path = written_path(landing.accepted.sparkSession, "detected")
    rows = _detected(landing.accepted, check_syntax, errors=True)
    flagged = rows.withColumn("is_error", F.col("detector").isin(detect_python.ERROR, detect_config.ERROR))
    flagged.write.partitionBy("is_error").parquet(path)
    stored = landing.accepted.sparkSession.read.schema(flagged.schema).parquet(path)
    failed = stored.filter("is_error").select(
        "scan_id", F.col("file_path").alias("path"), F.col("detector").alias("reason"), F.lit(vocab.ERROR_CODES["parse_failure"]).alias("error_code")
    )
    errors = landing.rejected.select("scan_id", "path", "reason", "error_code").unionByName(failed)
    return Discovery(numbered(stored.filter("NOT is_error").drop("is_error")), errors)


def private_keys(landed: DataFrame) -> DataFrame:
    return detect_certificates.private_key_markers(
        landed.filter("artifact_type = 'certificate'").select("scan_id", "path", "content")
    )


@dataclass(frozen=True)
class ScanResult:
    evidence: DataFrame
    assets: DataFrame
    nodes: DataFrame
    edges: DataFrame
    affected: DataFrame
    unfinished: DataFrame
    risk: DataFrame
    candidates: DataFrame
    members: DataFrame
    waves: DataFrame
    components: DataFrame


def analyze(
    findings: DataFrame, context: DataFrame | None = None, services: DataFrame | None = None, explode_hints: bool = True, max_depth: int | None = None,
    only_usable: bool = True,
) -> ScanResult:
    """All results of findings of any number of scans at once.

    ``context`` gives x, y and the risk parameters per scan; scans without it
    get an assessment that says so.  ``services`` adds the topology.  Dependents are
    counted to the end; with ``max_depth``, ``unfinished`` names the assets that have more.
    """
    usable = normalize.usable_findings(findings) if only_usable else findings
    # text is scanned once; all results are derived from these two stored tables
    evidence = written(normalize.normalize_findings(usable, explode_hints), "evidence")
    assets = written(fuse.fuse_assets(evidence), "assets")
    nodes, edges = graph.build_graph(evidence, assets)
    if services is not None:
        edges = edges.unionByName(graph.topology_edges(evidence, services))
    bridge = graph.asset_nodes(assets)
    walked = reach.walk(edges, bridge.select(F.col("node_id").alias("origin"), F.col("scan_id").alias("group")), max_depth)
    counts = reach.affected_counts(walked)
    unfinished = bridge.join(reach.unfinished(walked), F.col("node_id") == F.col("origin")).select("asset_id", "scan_id")
    affected = bridge.join(counts, F.col("node_id") == F.col("origin")).select("asset_id", "affected_count", "reached_depth")
    rows = assets.select("asset_id", "scan_id", "canonical", "quantum_status").join(affected, "asset_id", "left")
    if context is not None:
        rows = rows.join(context, "scan_id", "left")
    for name in ("x", "y"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("double"))
    assessed = risk.assess(rows.withColumn("blast_radius_count", F.coalesce("affected_count", F.lit(0))))
    chosen = migrate.candidates(assets)
    members = migrate.wave_members(assets, assessed)
    return ScanResult(
        evidence, assets, nodes, edges, affected, unfinished, assessed, chosen, members, migrate.waves(members), bom.components(assets, evidence)
    )
