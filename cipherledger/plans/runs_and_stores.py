"""Queries: sources, sinks, replay, records, evaluation, bookkeeping
(S1-S19, W1, A14, A17, A19, A21, A22, P12, J14, L1-L3, L5)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cipherledger.functions import vocab
from cipherledger.operators import evaluate as ev
from cipherledger.operators import graph, migrate, runs
from cipherledger.plans import fixtures as fx
from cipherledger.plans import graphs, migrations  # noqa: F401  (shared sub-queries)
from cipherledger.plans.registry import cte, query, sql
from cipherledger.plans.source_code import pick
from cipherledger.session import shared_folder
from cipherledger.sources import archives, files, records, store, versions

# --- files -----------------------------------------------------------------------------
NAMES = (
    "src/app.py,src/Main.java,a/requirements.txt,b/setup.cfg,certs/x.PEM,docker/Dockerfile.prod,conf/app.yaml,ui/package.json,build/q.py,"
    "x/node_modules/y.js,lib/tool.so,bin/run,c/poetry.lock,my/build.gradle.kts,conf/app.ini,k.properties,docs/readme.md,.git/config,z/setup.py,key.der"
)
FILES = fx.Projection(
    "file_rows", "part",
    ("p_partkey", f"'r' || (p_partkey % 97) || '/' || {pick(NAMES, 'p_partkey')} AS path", "CAST(p_partkey % 13 AS BIGINT) * p_size * 100000 AS length"),
).register()
_EXT = "lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1))"


@query("s1_read_tree", "SELECT lang, source, sum(strlen(text) + 1)::BIGINT AS bytes FROM documents GROUP BY ALL")
def s1(spark, d):
    """Whole documents written as text files in a folder tree, then read back as files."""
    root = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    docs = fx.table(spark, d, "documents").select("lang", "source", F.col("text").alias("value"))
    docs.write.partitionBy("lang", "source").option("maxRecordsPerFile", 500).text(root)
    tree = files.read_tree(spark, root, [".txt"], max_bytes=vocab.BINARY_MAX_BYTES)
    at = lambda k: F.regexp_extract("path", f"{k}=([^/]*)", 1).alias(k)
    return tree.groupBy(at("lang"), at("source")).agg(F.sum(F.octet_length("content")).cast("bigint").alias("bytes"))


@query("s2_size_guards", sql(
    f"SELECT p_partkey, path FROM (SELECT *, {_EXT} AS ext FROM file_rows) WHERE (ext IN ('.py', '.java') AND length <= 5000000) OR "
    "(ext IN ('.yaml', '.yml', '.json', '.properties', '.ini', '.conf', '.env', '.cfg') AND length <= 1000000) OR ext IN ('.pem', '.crt', '.cer', '.der', '.p12', '.pfx') OR "
    "(ext IN ('.elf', '.exe', '.dll', '.so', '.dylib', '.o', '.a', '.out', '', '.bin') AND length > 0 AND length <= 268435456)", "file_rows"))
def s2(spark, d):
    return FILES(spark, d).filter(files.within_size_guard(F.col("path"), F.col("length"))).select("p_partkey", "path")


@query("s3_excluded_folders", sql(
    "SELECT p_partkey, path FROM file_rows WHERE NOT list_has_any(string_split(path, '/'), ["
    + ", ".join(f"'{x}'" for x in vocab.EXCLUDED_DIRS) + "])", "file_rows"))
def s3(spark, d):
    return FILES(spark, d).filter(files.outside_excluded_dirs(F.col("path"))).select("p_partkey", "path")


@query("s4_routing", sql(
    f"SELECT p_partkey, path, CASE WHEN ext = '.py' THEN 'python_source' WHEN ext = '.java' THEN 'java_source' "
    "WHEN regexp_matches(path, '(requirements\\.txt|setup\\.cfg|setup\\.py|pyproject\\.toml|pom\\.xml)$') THEN 'dependency' "
    "WHEN ext IN ('.pem', '.crt', '.cer', '.der') THEN 'certificate' WHEN contains(lower(path), 'dockerfile') THEN 'image_file' "
    f"WHEN ext IN ('.yml', '.yaml', '.json', '.conf', '.ini') AND NOT ends_with(path, 'package.json') THEN 'config' END AS artifact_type FROM (SELECT *, {_EXT} AS ext FROM file_rows)", "file_rows"))
def s4(spark, d):
    return FILES(spark, d).select("p_partkey", "path", files.route(F.col("path")).alias("artifact_type"))


@query("s5_manifest_parser", sql(
    "SELECT p_partkey, path, parser FROM file_rows JOIN (VALUES " + ", ".join(f"('{n}', '{p}')" for n, p in vocab.MANIFEST_PARSERS)
    + ") m(n, parser) ON n = string_split(path, '/')[-1]", "file_rows"))
def s5(spark, d):
    return files.manifest_files(FILES(spark, d)).select("p_partkey", "path", "parser")


@query("s8_digest", "SELECT doc_id, sha256(text) AS sha256, strlen(text)::INT AS size_bytes FROM documents")
def s8(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return files.with_digest(docs).select("doc_id", "sha256", "size_bytes")


# --- archive members ---------------------------------------------------------------------
MEMBERS = fx.Projection(
    "member_rows",
    "lineitem",
    (
        "'archive-' || CAST(floor(l_orderkey / 16) AS BIGINT) AS archive",
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
        f"{pick('src/a.py,../x,/abs/y,node_modules/z.js,a/b/c.txt,build/q,dir/,ok/file.pem,e/..f', 'l_partkey')} || CASE l_partkey % 10 WHEN 9 THEN chr(92) || '..' || chr(92) || 'v' ELSE '' END AS name",
        "CAST(round(l_extendedprice) AS BIGINT) AS size",
        "l_partkey % 9 = 6 AS is_dir",
        "CASE l_suppkey % 5 WHEN 0 THEN 'symlink' WHEN 1 THEN 'dir' ELSE 'file' END AS kind",
    ),
).register()
LIMITS = {"members": 50, "single": 80_000, "total": 1_000_000}
_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"
cte("members_numbered", f"SELECT *, row_number() OVER (PARTITION BY archive ORDER BY {_ORDER}) AS ordinal FROM member_rows", "member_rows")
_EXCLUDED = ", ".join(f"'{x}'" for x in vocab.EXCLUDED_DIRS)


def members(spark, d) -> DataFrame:
    window = Window.partitionBy("archive").orderBy(*_ORDER.split(", "))
    return MEMBERS(spark, d).withColumn("ordinal", F.row_number().over(window))


@query("s6_archive_guard", sql(
    "SELECT archive, ordinal, name, total_size FROM (SELECT *, sum(size) OVER (PARTITION BY archive ORDER BY ordinal ROWS UNBOUNDED PRECEDING)::BIGINT AS total_size "
    "FROM (SELECT *, replace(name, chr(92), '/') AS clean FROM members_numbered WHERE ordinal <= 50) WHERE NOT is_dir AND NOT starts_with(clean, '/') "
    f"AND NOT list_contains(string_split(clean, '/'), '..') AND NOT list_has_any(string_split(clean, '/'), [{_EXCLUDED}]) AND size <= 80000) WHERE total_size <= 1000000", "members_numbered"))
def s6(spark, d):
    return archives.admit_archive_members(members(spark, d), LIMITS).select("archive", "ordinal", "name", "total_size")


@query("s7_image_guard", sql(
    "SELECT archive, ordinal, ltrim(name, './') AS name, total_size FROM (SELECT *, sum(size) OVER (PARTITION BY archive ORDER BY ordinal ROWS UNBOUNDED PRECEDING)::BIGINT AS total_size "
    "FROM members_numbered WHERE ordinal <= 50 AND kind = 'file') WHERE total_size <= 1000000 AND size <= 80000 AND NOT starts_with(name, '/') AND NOT list_contains(string_split(name, '/'), '..')", "members_numbered"))
def s7(spark, d):
    return archives.admit_image_members(members(spark, d), LIMITS).select("archive", "ordinal", "name", "total_size")


_CODE = "CASE WHEN reason = 'unsafe_path' THEN 'E-1003' WHEN reason IN ('member_count', 'too_large', 'total_size') THEN 'E-1002' END"


@query("s6_archive_quarantine", sql(
    f"SELECT archive, ordinal, total_size, reason, {_CODE} AS error_code FROM (SELECT archive, ordinal, total_size, CASE WHEN ordinal > 50 THEN 'member_count' "
    "ELSE coalesce(reason, CASE WHEN total_size > 1000000 THEN 'total_size' END) END AS reason FROM (SELECT *, CASE WHEN ordinal <= 50 THEN "
    "sum(CASE WHEN reason IS NULL AND ordinal <= 50 THEN size ELSE 0 END) OVER (PARTITION BY archive ORDER BY ordinal ROWS UNBOUNDED PRECEDING) END::BIGINT AS total_size FROM ("
    "SELECT *, CASE WHEN is_dir THEN 'not_a_file' WHEN starts_with(clean, '/') OR list_contains(string_split(clean, '/'), '..') THEN 'unsafe_path' "
    f"WHEN list_has_any(string_split(clean, '/'), [{_EXCLUDED}]) THEN 'excluded_folder' WHEN size > 80000 THEN 'too_large' END AS reason "
    "FROM (SELECT *, replace(name, chr(92), '/') AS clean FROM members_numbered))))", "members_numbered"))
def s6b(spark, d):
    """Every member, admitted or rejected, with the rule that rejects it."""
    return archives.judge_archive_members(members(spark, d), LIMITS).select("archive", "ordinal", "total_size", "reason", "error_code")


@query("s7_image_quarantine", sql(
    f"SELECT archive, ordinal, total_size, reason, {_CODE} AS error_code FROM (SELECT archive, ordinal, total_size, CASE WHEN ordinal > 50 THEN 'member_count' "
    "ELSE coalesce(reason, CASE WHEN kind = 'file' AND total_size > 1000000 THEN 'total_size' END) END AS reason FROM (SELECT *, CASE WHEN ordinal <= 50 THEN "
    "sum(CASE WHEN kind = 'file' AND ordinal <= 50 THEN size ELSE 0 END) OVER (PARTITION BY archive ORDER BY ordinal ROWS UNBOUNDED PRECEDING) END::BIGINT AS total_size, "
    "CASE WHEN kind <> 'file' THEN 'not_a_file' WHEN size > 80000 THEN 'too_large' WHEN starts_with(name, '/') OR list_contains(string_split(name, '/'), '..') THEN 'unsafe_path' END AS reason "
    "FROM members_numbered))", "members_numbered"))
def s7b(spark, d):
    return archives.judge_image_members(members(spark, d), LIMITS).select("archive", "ordinal", "total_size", "reason", "error_code")


@query("w1_running_size", sql(
    "SELECT archive, ordinal, sum(size) OVER (PARTITION BY archive ORDER BY ordinal ROWS UNBOUNDED PRECEDING)::BIGINT AS total_size FROM members_numbered WHERE ordinal <= 50", "members_numbered"))
def w1(spark, d):
    return members(spark, d).filter("ordinal <= 50").withColumn("total_size", archives.running_size()).select("archive", "ordinal", "total_size")


# --- result tables -----------------------------------------------------------------------
@query("s9_register_projects", (
    "SELECT c_name AS name, 'old-' || c_custkey AS project_id FROM customer WHERE c_custkey % 3 = 0 UNION ALL "
    "SELECT c_name, 'new-' || c_custkey FROM customer WHERE c_custkey % 3 <> 0"))
def s9(spark, d):
    c = fx.table(spark, d, "customer")
    old = c.filter("c_custkey % 3 = 0").select(F.col("c_name").alias("name"), F.concat(F.lit("old-"), "c_custkey").alias("project_id"))
    new = c.select(F.col("c_name").alias("name"), F.concat(F.lit("new-"), "c_custkey").alias("project_id"))
    return store.register_names(old, new)


_ENTRIES = fx.Projection(
    "registry_json",
    "part",
    (
        "p_partkey",
        "CASE p_partkey % 7 WHEN 0 THEN '{\"standard\": \"no name\"}' WHEN 1 THEN 'not json' ELSE '{\"name\": \"A' || p_partkey || '\"' || "
        "CASE p_partkey % 2 WHEN 0 THEN ', \"family\": \"bogus\"' ELSE ', \"family\": \"pqc_kem\"' END || CASE p_partkey % 3 WHEN 0 THEN ', \"status\": \"odd\"' WHEN 1 THEN ', \"status\": \"informational\"' ELSE '' END || "
        "CASE p_partkey % 5 WHEN 0 THEN '' ELSE ', \"usage_roles\": [\"tls_kex\", \"nope\", \"mac\"]' END || CASE p_partkey % 4 WHEN 0 THEN ', \"variants\": [\"v1\", \"v2\"]' ELSE '' END || '}' END AS entry",
    ),
).register()


@query("s10_registry_source", (
    "SELECT p_partkey, 'A' || p_partkey AS name, CASE p_partkey % 2 WHEN 0 THEN 'unknown' ELSE 'pqc_kem' END AS family, CASE p_partkey % 3 WHEN 1 THEN 'informational' ELSE 'final' END AS status, "
    "CASE p_partkey % 5 WHEN 0 THEN '' ELSE 'tls_kex,mac' END AS usage_roles, CASE p_partkey % 4 WHEN 0 THEN 'v1,v2' ELSE 'A' || p_partkey END AS variants, '' AS standard FROM part WHERE p_partkey % 7 NOT IN (0, 1)"))
def s10(spark, d):
    rows = records.parse_registry(_ENTRIES(spark, d), "entry")
    return rows.select(
        "p_partkey", "name", "family", "status", F.array_join("usage_roles", ",").alias("usage_roles"), F.array_join("variants", ",").alias("variants"), "standard"
    )


@query("s11_stored_assets", sql(
    "SELECT a.scan_id, a.n AS assets, e.n AS evidence FROM (SELECT scan_id, count(*) AS n FROM assets GROUP BY 1) a JOIN "
    "(SELECT scan_id, count(*) AS n FROM evidence WHERE asset_id IS NOT NULL GROUP BY 1) e ON e.scan_id = a.scan_id", "assets", "evidence"))
def s11(spark, d):
    base = shared_folder(spark)
    a = store.store_and_read(fx.assets(spark, d).select("scan_id", "asset_id", "canonical", "claim_state"), f"{base}/assets", 16)
    e = store.store_and_read(fx.evidence(spark, d).filter("asset_id IS NOT NULL").select("scan_id", "asset_id", "evidence_id", "confidence"), f"{base}/evidence", 16)
    count = lambda t, n: t.groupBy("scan_id").agg(F.count("*").alias(n))
    return count(a, "assets").join(count(e, "evidence"), "scan_id")


@query("s13_stored_risk_and_plans", sql(
    "SELECT r.scan_id, r.n AS risk_rows, p.n AS plan_rows FROM (SELECT scan_id, count(*) AS n FROM asset_risk GROUP BY 1) r JOIN (SELECT scan_id, count(*) AS n FROM assets GROUP BY 1) p ON p.scan_id = r.scan_id",
    "asset_risk", "assets"))
def s13(spark, d):
    base = shared_folder(spark)
    assets = fx.assets(spark, d)
    risk = store.store_and_read(migrations.asset_risk(spark, d).select("scan_id", "asset_id", "probability", "context_score", "risk_level"), f"{base}/risk", 16)
    plan = migrate.plan_rows(assets, migrate.candidates(assets), migrations.affected(spark, d))
    plans = store.store_and_read(plan.select("scan_id", "asset_id", "candidates", "affected_count"), f"{base}/plans", 16)
    count = lambda t, n: t.groupBy("scan_id").agg(F.count("*").alias(n))
    return count(risk, "risk_rows").join(count(plans, "plan_rows"), "scan_id")


@query("s14_rescan_replaces", sql(
    "SELECT scan_id, asset_id, 'old' AS run FROM assets WHERE CAST(substr(scan_id, 6) AS INT) % 4 <> 0 UNION ALL "
    "SELECT scan_id, asset_id, 'new' FROM assets WHERE CAST(substr(scan_id, 6) AS INT) % 4 = 0 AND surface = 'code'", "assets"))
def s14(spark, d):
    a = fx.assets(spark, d).select("scan_id", "asset_id", "surface")
    rerun = a.filter("CAST(substr(scan_id, 6) AS INT) % 4 = 0")
    new = rerun.filter("surface = 'code'").withColumn("run", F.lit("new")).drop("surface")
    return store.replace_scans(a.withColumn("run", F.lit("old")).drop("surface"), new)


@query("s14_stored_rescan", sql(
    "SELECT scan_id, asset_id, 'old' AS run FROM assets WHERE CAST(substr(scan_id, 6) AS INT) % 4 <> 0 UNION ALL "
    "SELECT scan_id, asset_id, 'new' FROM assets WHERE CAST(substr(scan_id, 6) AS INT) % 4 = 0 AND surface = 'code'", "assets"))
def s14b(spark, d):
    path = f"{shared_folder(spark)}/rescan-{uuid.uuid4().hex}"
    a = fx.assets(spark, d).select("scan_id", "asset_id", "surface")
    first = a.withColumn("run", F.lit("old")).drop("surface")
    store.store_by_scan(first, path, buckets=8)
    again = a.filter("CAST(substr(scan_id, 6) AS INT) % 4 = 0 AND surface = 'code'").withColumn("run", F.lit("new")).drop("surface")
    store.rescan(again, path, buckets=8)
    return store.read_store(spark, path, first.schema).select("scan_id", "asset_id", "run")


@query("s14_versioned_rescan", sql(
    "SELECT scan_id, asset_id, 'old' AS run FROM assets WHERE CAST(substr(scan_id, 6) AS INT) % 4 <> 0 UNION ALL "
    "SELECT scan_id, asset_id, 'new' FROM assets WHERE CAST(substr(scan_id, 6) AS INT) % 4 = 0 AND surface = 'code'", "assets"))
def s14c(spark, d):
    """A re-scan as a new version of its buckets, made visible by a manifest; a later change that was never committed stays unseen."""
    path = f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    a = fx.assets(spark, d).select("scan_id", "asset_id", "surface")
    first = a.withColumn("run", F.lit("old")).drop("surface")
    versions.rescan(first, path, 8)
    again = a.filter("CAST(substr(scan_id, 6) AS INT) % 4 = 0 AND surface = 'code'").withColumn("run", F.lit("new")).drop("surface")
    versions.rescan(again, path, 8)
    versions.prepare(first.withColumn("run", F.lit("lost")), path, 8)
    return versions.read(spark, path, first.schema)


@query("s15_report_files", sql(
    "SELECT asset_id, canonical, family, quantum_status, claim_state, round(confidence, 6) AS confidence, array_to_string(roles, ',') AS roles, evidence_count FROM assets", "assets"))
def s15(spark, d):
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    cols = ["asset_id", "canonical", "family", "quantum_status", "claim_state", "confidence", "roles", "evidence_count"]
    report = fx.assets(spark, d).select(*cols)
    store.write_report(report, path)
    back = spark.read.schema(report.schema).json(path)
    return back.withColumns({"confidence": F.round("confidence", 6), "roles": F.array_join("roles", ",")})


# --- replay --------------------------------------------------------------------------------
cte("copies", "SELECT scan_id AS from_scan, 'replay-' || scan_id AS to_scan FROM scans WHERE mode = 'replay'", "scans")
cte("copied_assets", "SELECT * FROM assets WHERE canonical <> 'HMAC'", "assets")


def copies(spark, d) -> DataFrame:
    return fx.SCANS(spark, d).filter("mode = 'replay'").select(F.col("scan_id").alias("from_scan"), F.concat(F.lit("replay-"), "scan_id").alias("to_scan"))


@query("s16_copied_assets", sql(
    "SELECT sha256(to_scan || '#' || asset_id) AS asset_id, to_scan AS scan_id, canonical FROM copied_assets JOIN copies ON from_scan = scan_id", "copied_assets", "copies"))
def s16(spark, d):
    return store.copy_assets(fx.assets(spark, d).filter("canonical <> 'HMAC'"), copies(spark, d)).select("asset_id", "scan_id", "canonical")


@query("s16_copied_evidence", sql(
    "SELECT sha256(to_scan || '#' || evidence_id) AS evidence_id, to_scan AS scan_id, CASE WHEN a.asset_id IS NOT NULL THEN sha256(to_scan || '#' || a.asset_id) END AS asset_id "
    "FROM evidence e JOIN copies ON from_scan = e.scan_id LEFT JOIN copied_assets a ON a.asset_id = e.asset_id", "evidence", "copies", "copied_assets"))
def s16b(spark, d):
    known = fx.assets(spark, d).filter("canonical <> 'HMAC'")
    return store.copy_evidence(fx.evidence(spark, d), known, copies(spark, d)).select("evidence_id", "scan_id", "asset_id")


@query("s16_copied_edges", sql(
    "SELECT sha256(to_scan || '#' || edge_id) AS edge_id, sha256(to_scan || '#' || src) AS src, CASE WHEN n.node_id IS NOT NULL THEN sha256(to_scan || '#' || dst) ELSE dst END AS dst "
    "FROM edges e JOIN copies ON from_scan = e.scan_id LEFT JOIN (SELECT node_id FROM nodes WHERE node_type <> 'algorithm' OR label <> 'HMAC') n ON n.node_id = e.dst", "edges", "copies", "nodes"))
def s16c(spark, d):
    nodes, edges = graph.build_graph(fx.evidence(spark, d), fx.assets(spark, d))
    kept = nodes.filter("node_type <> 'algorithm' OR label <> 'HMAC'")
    return store.copy_edges(edges, kept, copies(spark, d)).select("edge_id", "src", "dst")


@query("s16_copied_risk", sql(
    "SELECT sha256(to_scan || '#' || r.asset_id) AS asset_id, to_scan AS scan_id, probability, risk_level FROM asset_risk r JOIN copies ON from_scan = r.scan_id "
    "WHERE r.asset_id IN (SELECT asset_id FROM copied_assets)", "asset_risk", "copies", "copied_assets"))
def s16d(spark, d):
    known = fx.assets(spark, d).filter("canonical <> 'HMAC'")
    return store.copy_risk(migrations.asset_risk(spark, d), known, copies(spark, d)).select("asset_id", "scan_id", "probability", "risk_level")


@query("s17_replay_source", (
    "SELECT 'scan-' || o_orderkey AS scan_id, CASE WHEN o_custkey % 3 = 0 AND o_custkey % 2 = 0 THEN 'scan-' || (o_custkey % 500) END AS source_scan_id, "
    "CASE WHEN o_custkey % 3 <> 0 THEN 'E-6001' END AS error_code FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)"))
def s17(spark, d):
    known = fx.table(spark, d, "customer").select("c_custkey")
    orders = fx.table(spark, d, "orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    requests = orders.selectExpr("'scan-' || o_orderkey AS scan_id", "'snap-' || o_custkey AS replay_snapshot_id")
    snapshots = known.filter("c_custkey % 3 = 0").selectExpr(
        "'snap-' || c_custkey AS snapshot_id", "CASE WHEN c_custkey % 2 = 0 THEN 'scan-' || (c_custkey % 500) END AS source_scan_id"
    )
    return store.resolve_replays(requests, snapshots).select("scan_id", "source_scan_id", "error_code")


@query("s18_snapshot_hash", "SELECT c_custkey, left(sha256(c_name || '-' || c_mktsegment), 16) AS config_hash FROM customer")
def s18(spark, d):
    return fx.table(spark, d, "customer").select("c_custkey", records.snapshot_hash(F.col("c_name"), F.col("c_mktsegment")).alias("config_hash"))


_FINDING_JSON = fx.Projection(
    "finding_json",
    "events",
    (
        "event_id",
        "'{\"finding_id\": \"F' || event_id || '\", \"repository\": \"r\", \"commit\": \"' || CASE event_id % 3 WHEN 0 THEN '0123456789abcdef0123456789abcdef01234567' WHEN 1 THEN 'ABC' ELSE '0123456789abcdef0123456789abcdef0123456' END || "
        "'\", \"file\": \"f\", \"line_range\": \"1-2\", \"algorithm\": \"RSA\", \"role\": \"usage\", \"evidence_type\": \"e\"' || CASE event_id % 4 WHEN 0 THEN '' ELSE ', \"source_url\": \"u\"' END || "
        "CASE event_id % 5 WHEN 0 THEN ', \"more\": ' || props ELSE '' END || ', \"expected_ground_truth\": \"t\"' || CASE event_id % 2 WHEN 0 THEN ', \"note\": \"n\"' ELSE '' END || CASE event_id % 11 WHEN 0 THEN '' ELSE '}' END AS record",
    ),
).register()


@query("s19_finding_records", (
    "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'algorithm,commit,evidence_type,expected_ground_truth,file,finding_id,line_range,repository,role,source_url' WHEN event_id % 4 = 0 THEN 'source_url' ELSE '' END AS missing, "
    "CASE WHEN event_id % 11 <> 0 AND event_id % 5 = 0 THEN 'more' ELSE '' END AS extra, event_id % 11 <> 0 AND event_id % 3 = 0 AS commit_ok, "
    "event_id % 11 <> 0 AND event_id % 3 = 0 AND event_id % 4 <> 0 AND event_id % 5 <> 0 AS valid FROM events"))
def s19(spark, d):
    checked = records.check_finding_records(_FINDING_JSON(spark, d), "record")
    return checked.select("event_id", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"), "commit_ok", "valid")


# --- evaluation ------------------------------------------------------------------------------
_CASES = fx.Projection(
    "label_cases",
    "documents",
    (
        "doc_id", "lang",
        f"{pick('RSA,aes,SHA-256,ML-KEM,HMAC', 'doc_id')} AS expected",
        f"split(CASE WHEN n_chars % 4 = 0 THEN 'unknown' ELSE {pick('rsa-oaep,AES,md5,kem,hmac-sha256,ML-KEM-768', 'n_chars')} || ';' || {pick('SHA,x,Unknown', 'n_chars')} END, ';') AS detected",
    ),
).register()
cte(
    "judged",
    "SELECT *, CASE WHEN is_positive AND matched THEN 'TP' WHEN is_positive THEN 'FN' WHEN any_found THEN 'FP' ELSE 'TN' END AS outcome FROM (SELECT c.*, coalesce(l.quality, 0) = 1 AS is_positive, "
    "len(list_filter(detected, lambda x: upper(x) <> 'UNKNOWN' AND (contains(upper(x), upper(expected)) OR contains(upper(expected), upper(x))))) > 0 AS matched, "
    "len(list_filter(detected, lambda x: upper(x) <> 'UNKNOWN')) > 0 AS any_found FROM label_cases c LEFT JOIN labels l ON l.doc_id = c.doc_id)",
    "label_cases",
)


def judged(spark, d) -> DataFrame:
    labels = fx.table(spark, d, "labels").select("doc_id", "quality")
    rows = _CASES(spark, d).join(labels, "doc_id", "left").withColumn("is_positive", F.coalesce("quality", F.lit(0)) == 1)
    found = F.exists("detected", lambda x: F.upper(x) != "UNKNOWN")
    matched = ev.hint_matches(F.col("expected"), F.col("detected"))
    return rows.withColumns({"matched": matched, "outcome": ev.outcome(F.col("is_positive"), matched, found)})


@query("p12_hint_match", sql("SELECT doc_id, matched, outcome FROM judged", "judged"))
def p12(spark, d):
    return judged(spark, d).select("doc_id", "matched", "outcome")


def _accuracy(group: str) -> str:
    key, tail = (f"{group}, ", f" GROUP BY {group}") if group else ("", "")
    return sql(
        f"SELECT *, CASE WHEN precision + recall > 0 THEN round(2 * precision * recall / (precision + recall), 6) ELSE 0 END AS f1 FROM (SELECT *, "
        "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, "
        "round(CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) / (tp + tn + fp + fn) ELSE 0 END, 6) AS accuracy FROM (SELECT "
        f"{key}count(*) FILTER (WHERE outcome = 'TP') AS tp, count(*) FILTER (WHERE outcome = 'FP') AS fp, count(*) FILTER (WHERE outcome = 'TN') AS tn, "
        f"count(*) FILTER (WHERE outcome = 'FN') AS fn FROM judged{tail}))".replace("round(2 * precision * recall / (precision + recall), 6)", "round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6)"), "judged")


_RATES = ["precision", "recall", "accuracy", "f1"]


@query("a17_accuracy", _accuracy(""))
def a17(spark, d):
    rated = ev.accuracy(judged(spark, d))
    return rated.select("tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in _RATES])


@query("a17_accuracy_by_language", _accuracy("lang"))
def a17b(spark, d):
    rated = ev.accuracy(judged(spark, d), "lang")
    return rated.select("lang", "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in _RATES])


_TRUTH = fx.Projection(
    "truth_cases",
    "customer",
    (
        "'case-' || c_custkey AS case_id",
        "'scan-' || (c_custkey % 600) AS scan_id",
        f"split({pick('RSA;AES,SHA-256,RSA;missing,X25519;jwt', 'c_custkey')}, ';') AS expected_algorithms",
        f"split({pick('usage,implementation;observed,configuration', 'c_custkey')}, ';') AS expected_roles",
        f"split({pick('usage,none,capability;observed', 'c_nationkey')}, ';') AS forbidden_roles",
        "CASE c_custkey % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'contradictory' END AS expected_claim_state",
        "c_custkey % 7 = 0 AS must_emit_nothing",
    ),
).register()


@query("a19_ground_truth", sql(
    "SELECT *, missing_algorithms = '' AND missing_roles = '' AND forbidden_found = '' AND state_ok AND silence_ok AS passed FROM (SELECT case_id, "
    "array_to_string(list_sort(list_filter(expected_algorithms, lambda x: NOT list_contains(names, x))), ',') AS missing_algorithms, "
    "array_to_string(list_sort(list_filter(expected_roles, lambda x: NOT list_contains(roles, x))), ',') AS missing_roles, "
    "array_to_string(list_sort(list_filter(forbidden_roles, lambda x: list_contains(roles, x))), ',') AS forbidden_found, "
    "expected_claim_state IS NULL OR list_contains(states, expected_claim_state) AS state_ok, NOT must_emit_nothing OR len(names) = 0 AS silence_ok FROM (SELECT c.*, coalesce(e.names, []) AS names, "
    "coalesce(e.roles, []) AS roles, coalesce(a.states, []) AS states FROM truth_cases c LEFT JOIN (SELECT scan_id, list_distinct(list(canonical)) AS names, list_distinct(flatten(list(roles))) AS roles FROM evidence GROUP BY 1) e "
    "ON e.scan_id = c.scan_id LEFT JOIN (SELECT scan_id, list_distinct(list(claim_state)) AS states FROM assets GROUP BY 1) a ON a.scan_id = c.scan_id))", "truth_cases", "evidence", "assets"))
def a19(spark, d):
    scored = ev.score_cases(_TRUTH(spark, d), fx.evidence(spark, d), fx.assets(spark, d))
    lists = [F.array_join(c, ",").alias(c) for c in ("missing_algorithms", "missing_roles", "forbidden_found")]
    return scored.select("case_id", *lists, "state_ok", "silence_ok", "passed")


@query("a22_check_score", sql(
    "SELECT scan_id, passed, 4 AS total, CASE WHEN passed = 4 THEN 'FULLY VALIDATED' WHEN passed >= 2 THEN 'MOSTLY VALIDATED' ELSE 'VALIDATION INCOMPLETE' END AS verdict FROM (SELECT s.scan_id, "
    "(CASE WHEN a.n > 0 THEN 3 ELSE 0 END + CASE WHEN s.state = 'completed' THEN 1 ELSE 0 END) AS passed FROM scans s LEFT JOIN (SELECT scan_id, count(*) AS n FROM assets GROUP BY 1) a ON a.scan_id = s.scan_id)", "scans", "assets"))
def a22(spark, d):
    scans = fx.SCANS(spark, d)
    checks = ev.presence_checks(scans, fx.assets(spark, d), fx.evidence(spark, d).filter("asset_id IS NOT NULL"))
    completed = scans.select("scan_id", (F.col("state") == "completed").alias("is_completed"))
    names = ["has_assets", "has_evidence", "has_real_bom", "is_completed"]
    return ev.check_score(checks.join(completed, "scan_id"), names).select("scan_id", "passed", "total", "verdict")


@query("a14_row_counts", sql(
    "SELECT 'projects' AS table_name, count(*) AS n FROM projects UNION ALL SELECT 'scans', count(*) FROM scans UNION ALL SELECT 'artifacts', count(*) FROM file_rows UNION ALL SELECT 'assets', count(*) FROM assets "
    "UNION ALL SELECT 'evidence', count(*) FROM evidence UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'risk', count(*) FROM asset_risk UNION ALL SELECT 'plans', count(*) FROM assets",
    "projects", "scans", "file_rows", "assets", "evidence", "nodes", "edges", "asset_risk"))
def a14(spark, d):
    assets, evidence = fx.assets(spark, d), fx.evidence(spark, d)
    nodes, edges = graph.build_graph(evidence, assets)
    plans = migrate.plan_rows(assets, migrate.candidates(assets), migrations.affected(spark, d))
    return ev.row_counts(
        {
            "projects": fx.PROJECTS(spark, d), "scans": fx.SCANS(spark, d), "artifacts": FILES(spark, d), "assets": assets, "evidence": evidence,
            "nodes": nodes, "edges": edges, "risk": migrations.asset_risk(spark, d), "plans": plans,
        }
    )


# --- bookkeeping -------------------------------------------------------------------------------
STAGES = fx.Projection(
    "stage_events",
    "events",
    (
        "event_id", "'scan-' || user_id AS scan_id", f"{pick(','.join(vocab.SCAN_STAGES), 'event_id')} AS stage",
        "CASE WHEN value > 150 THEN 'failed' WHEN value > 30 THEN 'done' WHEN value > 10 THEN 'running' ELSE 'pending' END AS state", "ts AS updated_at",
        "CASE WHEN value > 150 THEN 'stage error ' || event_id END AS error",
    ),
).register()
cte("stages", "SELECT * FROM stage_events QUALIFY row_number() OVER (PARTITION BY scan_id, stage ORDER BY updated_at DESC, event_id DESC) = 1", "stage_events")


def stages(spark, d) -> DataFrame:
    return runs.latest_stages(STAGES(spark, d))


@query("l1_stage_status", sql("SELECT scan_id, stage, state, error FROM stages", "stages"))
def l1(spark, d):
    maps = runs.stage_maps(stages(spark, d))
    return maps.select("scan_id", F.explode("stages").alias("stage", "s")).select("scan_id", "stage", "s.state", "s.error")


@query("l2_scan_state", sql(
    "SELECT scan_id, CASE WHEN bool_or(state = 'failed') THEN 'failed' WHEN bool_or(stage = 'export' AND state = 'done') THEN 'completed' WHEN bool_and(state = 'pending') THEN 'queued' ELSE 'running' END AS state, "
    "arg_max(error, updated_at) FILTER (WHERE state = 'failed') AS error_message FROM stages GROUP BY scan_id", "stages"))
def l2(spark, d):
    return runs.scan_states(stages(spark, d))


@query("a21_done_stages", sql(
    "SELECT scan_id, count(*) FILTER (WHERE state = 'done') AS done, coalesce(string_agg(stage, ',' ORDER BY stage) FILTER (WHERE state = 'done'), '') AS names FROM stages GROUP BY scan_id", "stages"))
def a21(spark, d):
    done = runs.done_stages(F.col("stages"))
    return runs.stage_maps(stages(spark, d)).select("scan_id", F.size(done).cast("bigint").alias("done"), F.array_join(done, ",").alias("names"))


@query("l3_stuck_scans", sql(
    "SELECT scan_id, CASE WHEN state = 'queued' AND created_at < DATE '1998-01-01' THEN 'failed' ELSE state END AS state, CASE WHEN state = 'queued' AND created_at < DATE '1998-01-01' THEN 'stuck in queue' END AS error_message FROM scans", "scans"))
def l3(spark, d):
    return runs.fail_stuck(fx.SCANS(spark, d), "stuck in queue", F.to_date(F.lit("1998-01-01"))).select("scan_id", "state", "error_message")


@query("j14_orphan_scans", sql(
    "SELECT scan_id, state = 'queued' AS is_stale FROM scans WHERE scan_id NOT IN (SELECT scan_id FROM assets)", "scans", "assets"))
def j14(spark, d):
    return runs.orphan_scans(fx.SCANS(spark, d), fx.assets(spark, d)).select("scan_id", (F.col("state") == "queued").alias("is_stale"))


@query("l5_isolated_errors", (
    "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'E-1003' WHEN strlen(text) + CASE doc_id % 5 WHEN 0 THEN 2 ELSE 0 END > 8000 THEN 'E-1002' WHEN doc_id % 5 = 0 THEN 'E-1004x' WHEN doc_id % 2 = 0 THEN 'E-2003' END AS error_code FROM documents").replace("E-1004x", "E-1005"))
def l5(spark, d):
    docs = fx.table(spark, d, "documents")
    path = F.expr("CASE WHEN doc_id % 9 = 0 THEN 'a/../d' ELSE 'd' END || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.json' ELSE '.txt' END")
    content = F.concat(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.when(F.col("doc_id") % 5 == 0, F.unhex(F.lit("C328"))).otherwise(F.unhex(F.lit(""))))
    rows = docs.select("doc_id", path.alias("path"), content.alias("content"))
    return runs.input_errors(rows, 8000).select("doc_id", "error_code")


def _streamed(spark, d) -> DataFrame:
    """Stages from a stream of four landings: events by time, the late ones, and some once more."""
    from cipherledger.streaming import stages as stream

    root = f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"
    events = STAGES(spark, d).select("scan_id", F.col("event_id").cast("bigint"), "stage", "state", F.col("updated_at").cast("timestamp"), "error")
    span = events.agg(F.min("updated_at").alias("a"), F.max("updated_at").alias("b")).first()
    half = span["a"] + (span["b"] - span["a"]) / 2
    late = F.col("event_id") % 10 == 0
    for part in (events.filter(~late & (F.col("updated_at") < half)), events.filter(~late & (F.col("updated_at") >= half)), events.filter(late), events.filter("event_id % 7 = 0")):
        part.coalesce(2).write.mode("append").parquet(f"{root}/in")
    delay = f"{(span['b'] - span['a']).days + 1} days"
    stream.keep(stream.watch(spark, f"{root}/in", 2), f"{root}/out", f"stages-{uuid.uuid4().hex}", delay).awaitTermination()
    return stream.stored(spark, f"{root}/out")


@query("l1_streamed_stages", sql("SELECT scan_id, stage, state, error FROM stages", "stages"))
def l1_streamed(spark, d):
    return _streamed(spark, d).select("scan_id", "stage", "state", "error")


@query("l2_streamed_states", sql(
    "SELECT scan_id, CASE WHEN bool_or(state = 'failed') THEN 'failed' WHEN bool_or(stage = 'export' AND state = 'done') THEN 'completed' WHEN bool_and(state = 'pending') THEN 'queued' ELSE 'running' END AS state "
    "FROM stages GROUP BY scan_id", "stages"))
def l2_streamed(spark, d):
    return runs.scan_states(_streamed(spark, d)).select("scan_id", "state")
