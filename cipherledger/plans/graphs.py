"""Queries: graph construction, topology and blast radius."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherledger.operators import graph as g
from cipherledger.operators import reach
from cipherledger.plans import fixtures as fx
from cipherledger.plans.registry import cte, query, sql

# order -> customer -> nation -> region, and a ring of regions
_STEPS = [
    ("orders", "'order-' || o_orderkey", "'customer-' || o_custkey"),
    ("customer", "'customer-' || c_custkey", "'nation-' || c_nationkey"),
    ("nation", "'nation-' || n_nationkey", "'region-' || n_regionkey"),
    ("region", "'region-' || r_regionkey", "'region-' || ((r_regionkey + 1) % 5)"),
]
cte("links", " UNION ALL ".join(f"SELECT {s} AS src, {t} AS dst FROM {tab}" for tab, s, t in _STEPS))
cte("steps", "SELECT DISTINCT src, dst FROM links", "links")
cte("origins", "SELECT DISTINCT dst AS origin FROM steps", "steps")
_RADIUS = (
    "walk(origin, node, depth) AS (SELECT origin, origin, 0 FROM origins UNION "
    "SELECT w.origin, s.src, w.depth + 1 FROM walk w JOIN steps s ON s.dst = w.node WHERE w.depth < 10), "
    "radius AS (SELECT origin, node, min(depth) AS depth FROM walk WHERE node <> origin GROUP BY ALL)"
)


def radius_sql(body: str, *names: str) -> str:
    text = sql("", "origins", *names).rstrip()
    return text.replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + _RADIUS + "\n" + body


def links(spark, d) -> DataFrame:
    parts = [fx.table(spark, d, tab).selectExpr(f"{s} AS src", f"{t} AS dst") for tab, s, t in _STEPS]
    return reduce(DataFrame.unionByName, parts)


def radius(spark, d) -> reach.Reach:
    edges = links(spark, d)
    origins = edges.select(F.col("dst").alias("origin"), F.split_part("dst", F.lit("-"), F.lit(1)).alias("group"))
    return reach.walk(edges, origins, 10)


_LIVE = [
    ("orders", "'order-' || o_orderkey", "o_orderstatus <> 'P'"),
    ("customer", "'customer-' || c_custkey", "c_acctbal > 0"),
    ("nation", "'nation-' || n_nationkey", "n_nationkey <> 3"),
    ("region", "'region-' || r_regionkey", "true"),
]
cte("live_nodes", " UNION ALL ".join(f"SELECT {i} AS id FROM {tab} WHERE {w}" for tab, i, w in _LIVE))

_NODE_TYPE = (
    "CASE source_type WHEN 'dependency' THEN 'library' WHEN 'certificate' THEN 'certificate' WHEN 'binary' THEN 'binary' "
    "WHEN 'container' THEN 'container' ELSE 'source_file' END"
)
cte(
    "alg_nodes",
    "SELECT scan_id, sha256(scan_id || '#algorithm#' || canonical) AS node_id, 'algorithm' AS node_type, canonical AS label, "
    "asset_id, family, claim_state, variant FROM assets "
    "QUALIFY row_number() OVER (PARTITION BY scan_id, canonical ORDER BY first_ord, surface) = 1",
    "assets",
)
cte(
    "src_nodes",
    "SELECT scan_id, sha256(scan_id || '#' || node_type || '#' || label) AS node_id, node_type, label, source_type, detector FROM ("
    f"SELECT scan_id, {_NODE_TYPE} AS node_type, source_location AS label, source_type, detector, ord, evidence_id FROM evidence "
    "WHERE asset_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY scan_id, node_type, label ORDER BY ord, evidence_id) = 1",
    "evidence",
)
cte(
    "nodes",
    "SELECT scan_id, node_id, node_type, label FROM alg_nodes UNION ALL SELECT scan_id, node_id, node_type, label FROM src_nodes",
    "alg_nodes", "src_nodes",
)
cte(
    "edges",
    "SELECT scan_id, sha256(scan_id || '#edge#' || evidence_id) AS edge_id, "
    f"sha256(scan_id || '#' || {_NODE_TYPE} || '#' || source_location) AS src, "
    "sha256(scan_id || '#algorithm#' || canonical) AS dst, "
    "CASE WHEN source_type IN ('python_source', 'java_source') AND list_contains(roles, 'implementation') THEN 'IMPLEMENTS' "
    "WHEN source_type IN ('dependency', 'container') THEN 'PROVIDES' WHEN source_type = 'certificate' THEN 'SIGNS' "
    "WHEN source_type = 'binary' THEN 'IMPLEMENTS' ELSE 'USES' END AS edge_type, evidence_id, confidence "
    "FROM evidence WHERE asset_id IS NOT NULL",
    "evidence",
)
SERVICES = fx.Projection(
    "suppliers",
    "supplier",
    (
        "s_name AS service",
        "CASE s_suppkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'medium' ELSE 'low' END AS business_criticality",
        "s_acctbal > 5000 AS internet_exposure",
        "split(CASE s_suppkey % 3 WHEN 0 THEN 'svc/' || s_suppkey || '/src,/svc/' || s_suppkey || '/' "
        "WHEN 1 THEN '/svc/' || s_suppkey || '/' ELSE 'vc/' || s_suppkey || '/sr' END, ',') AS repositories",
        "'data-' || s_nationkey AS data_name",
    ),
).register()


def services(spark, d) -> DataFrame:
    rows = SERVICES(spark, d)
    return rows.withColumn(
        "data_assets", F.array(F.struct(F.col("data_name").alias("name"), F.lit("confidential").alias("sensitivity")))
    )


cte(
    "service_evidence",
    "SELECT s.service, e.scan_id, e.canonical, e.evidence_id, e.source_location, s.data_name FROM evidence e JOIN suppliers s ON "
    "len(list_filter(s.repositories, lambda r: contains(e.source_location, r) OR starts_with(e.source_location, ltrim(r, '/')))) > 0 "
    "WHERE e.asset_id IS NOT NULL",
    "evidence", "suppliers",
)


@query("g1_source_nodes", sql("SELECT node_id, node_type, label, source_type, detector FROM src_nodes", "src_nodes"))
def g1(spark, d):
    return g.source_nodes(fx.evidence(spark, d)).select(
        "node_id", "node_type", "label", F.col("properties")["source_type"].alias("source_type"),
        F.col("properties")["detector"].alias("detector"),
    )


@query("g2_algorithm_nodes", sql("SELECT node_id, label, asset_id, family, claim_state, variant FROM alg_nodes", "alg_nodes"))
def g2(spark, d):
    p = F.col("properties")
    return g.algorithm_nodes(fx.assets(spark, d)).select(
        "node_id", "label", p["asset_id"].alias("asset_id"), p["family"].alias("family"),
        p["claim_state"].alias("claim_state"), F.try_element_at(p, F.lit("variant")).alias("variant"),
    )


@query("g3_evidence_edges", sql("SELECT edge_id, src, dst, edge_type FROM edges", "edges"))
def g3(spark, d):
    return g.evidence_edges(fx.evidence(spark, d)).select("edge_id", "src", "dst", "edge_type")


@query("j6_service_locations", sql(
    "SELECT DISTINCT service, source_location FROM service_evidence", "service_evidence"))
def j6(spark, d):
    locations = g.of_assets(fx.evidence(spark, d)).select("source_location").distinct()
    return g.location_matches(services(spark, d), locations)


@query("g4_topology_edges", sql(
    "SELECT sha256(scan_id || '#' || service || '#' || evidence_id) AS edge_id, sha256(scan_id || '#service#' || service) AS src, "
    "sha256(scan_id || '#algorithm#' || canonical) AS dst, 'USES' AS edge_type FROM service_evidence UNION ALL "
    "SELECT DISTINCT sha256(scan_id || '#' || service || '#' || data_name), sha256(scan_id || '#service#' || service), "
    "sha256(scan_id || '#data_asset#' || data_name), 'PROTECTS' FROM service_evidence", "service_evidence"))
def g4(spark, d):
    return g.topology_edges(fx.evidence(spark, d), services(spark, d)).select("edge_id", "src", "dst", "edge_type")


@query("g4_topology_nodes", sql(
    "SELECT DISTINCT sha256(scan_id || '#service#' || service) AS node_id, 'service' AS node_type, service AS label FROM service_evidence "
    "UNION ALL SELECT DISTINCT sha256(scan_id || '#data_asset#' || data_name), 'data_asset', data_name FROM service_evidence", "service_evidence"))
def g4b(spark, d):
    rows = g.of_assets(fx.evidence(spark, d)).select("scan_id", "source_location")
    placed = g.service_matches(rows, services(spark, d)).select("scan_id", "service", "business_criticality", "internet_exposure", "data_assets")
    return g.topology_nodes(placed).select("node_id", "node_type", "label")


@query("g5_blast_radius", radius_sql("SELECT origin, node, depth FROM radius"))
def g5(spark, d):
    return reach.pairs(radius(spark, d))


@query("g6_affected_counts", radius_sql(
    "SELECT o.origin, coalesce(count(node), 0) AS affected_count, coalesce(max(depth), 0) AS reached_depth "
    "FROM origins o LEFT JOIN radius r ON r.origin = o.origin GROUP BY o.origin"))
def g6(spark, d):
    return reach.affected_counts(radius(spark, d))


@query("g6_depth_histogram", radius_sql("SELECT origin, depth, count(*) AS n FROM radius GROUP BY ALL"))
def g6b(spark, d):
    return reach.depth_histogram(radius(spark, d))


@query("g6_affected_types", radius_sql(
    "SELECT origin, split_part(node, '-', 1) AS node_type, count(*) AS n FROM radius GROUP BY ALL"))
def g6c(spark, d):
    edges = links(spark, d)
    nodes = edges.select(F.col("src").alias("node_id")).unionByName(edges.select(F.col("dst").alias("node_id"))).distinct()
    return reach.affected_types(radius(spark, d), nodes.withColumn("node_type", F.split_part("node_id", F.lit("-"), F.lit(1))))


@query("g7_graph_export", sql(
    "SELECT node_id AS id, 'node' AS kind, label AS text, source_type AS detail FROM src_nodes UNION ALL "
    "SELECT node_id, 'node', label, family FROM alg_nodes UNION ALL SELECT edge_id, 'edge', edge_type, evidence_id FROM edges",
    "src_nodes", "alg_nodes", "edges"))
def g7(spark, d):
    ev, assets = fx.evidence(spark, d), fx.assets(spark, d)
    nodes, edges = g.build_graph(ev, assets)
    get = lambda k: F.get_json_object("record", f"$.{k}")
    n = g.node_records(nodes).select(
        F.col("node_id").alias("id"), F.lit("node").alias("kind"), get("label").alias("text"),
        F.coalesce(get("source_type"), get("family")).alias("detail"),
    )
    e = g.edge_records(edges).select(
        F.col("edge_id").alias("id"), F.lit("edge").alias("kind"), get("edge_type").alias("text"), get("evidence_id").alias("detail")
    )
    return n.unionByName(e)


@query("g8_direct_transitive", radius_sql(
    "SELECT origin, count(*) FILTER (WHERE depth = 1) AS direct, count(*) FILTER (WHERE depth > 1) AS transitive FROM radius GROUP BY origin"))
def g8(spark, d):
    return reach.dependents(radius(spark, d))


@query("g9_parallel_edges", sql("SELECT DISTINCT src, dst FROM edges", "edges"))
def g9(spark, d):
    return g.collapse_parallel(g.evidence_edges(fx.evidence(spark, d)))


@query("a16_node_types", sql("SELECT scan_id, node_type, count(*) AS n FROM nodes GROUP BY ALL", "nodes"))
def a16(spark, d):
    nodes, _ = g.build_graph(fx.evidence(spark, d), fx.assets(spark, d))
    return nodes.groupBy("scan_id", "node_type").agg(F.count("*").alias("n"))


@query("j9_asset_nodes", sql(
    "SELECT a.asset_id, n.node_id, n.asset_id AS described_by FROM assets a JOIN alg_nodes n ON n.scan_id = a.scan_id AND n.label = a.canonical",
    "assets", "alg_nodes"))
def j9(spark, d):
    assets = fx.assets(spark, d)
    nodes = g.algorithm_nodes(assets).select("node_id", F.col("properties")["asset_id"].alias("described_by"))
    return g.asset_nodes(assets).join(nodes, "node_id").select("asset_id", "node_id", "described_by")


@query("j11_edge_integrity", sql(
    "SELECT src, dst FROM links WHERE src IN (SELECT id FROM live_nodes) AND dst IN (SELECT id FROM live_nodes)", "links", "live_nodes"))
def j11(spark, d):
    nodes = [fx.table(spark, d, tab).filter(w).selectExpr(f"{i} AS node_id") for tab, i, w in _LIVE]
    return g.valid_edges(links(spark, d), reduce(DataFrame.unionByName, nodes)).select("src", "dst")


# ids are digests of labels, so the labels of an edge's ends are those of its evidence; no join of digests is needed to say it
@query("s12_stored_graph", sql(
    "SELECT sha256(scan_id || '#edge#' || evidence_id) AS edge_id, source_location AS src_label, canonical AS dst_label "
    "FROM evidence WHERE asset_id IS NOT NULL", "evidence"))
def s12(spark, d):
    from cipherledger.sources.store import store_graph
    from cipherledger.session import shared_folder

    evidence = fx.evidence(spark, d)
    nodes, _ = g.build_graph(evidence, fx.assets(spark, d))
    # an edge is stored with the labels of its ends, if nodes with the digests of these are stored; ids are made when they are read
    edges = g.evidence_edges(evidence, labels=True)
    _, edges = store_graph(nodes, edges, f"{shared_folder(spark)}/graph", g.node_keys(), g.edge_keys())
    return edges.select("edge_id", "src_label", "dst_label")
