"""Fusion, graph, risk, migration, stores, streaming: assertions and brute force on small data."""

import random
import uuid
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from cipherledger.operators import fuse, graph, migrate, normalize, risk
from cipherledger.operators.scan import analyze, discover, land_files
from cipherledger.sources import archives, files, records, store

SCHEMA = "scan_id string, ord long, file_path string, line int, source_type string, detector string, raw_signal string, roles array<string>, algorithm_hint string, algorithm_hints array<string>, package_name string, confidence double"


def findings(spark, *rows):
    full = [
        ("s", i, "test.py", i + 1, r.get("source", "python_source"), r.get("detector", "test.detector"), "x", r["roles"], r["hint"], None, None, r.get("confidence", 0.7))
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, SCHEMA)


def assets(spark, *rows):
    return fuse.fuse_assets(normalize.normalize_findings(findings(spark, *rows))).collect()


def test_normalization(spark):
    (a,) = assets(spark, {"hint": "sha256", "roles": ["implementation"]})
    assert a.canonical == "SHA-256" and a.claim_state == "supported"
    (a,) = assets(spark, {"hint": "mlkem768", "roles": ["usage"]})
    assert (a.canonical, a.quantum_status, a.variant) == ("ML-KEM", "safe", "768")


def test_roles_are_united_not_upgraded(spark):
    (a,) = assets(spark, {"hint": "RSA", "roles": ["capability"]})
    assert a.roles == ["capability"] and a.claim_state == "ambiguous"
    (a,) = assets(spark, {"hint": "RSA", "roles": ["capability"]}, {"hint": "RSA", "roles": ["usage"]})
    assert set(a.roles) == {"capability", "usage"}


def test_certificates_are_a_surface_of_their_own(spark):
    rows = assets(spark, {"hint": "RSA", "roles": ["usage"]}, {"hint": "RSA", "roles": ["observed"], "source": "certificate"})
    assert {(a.surface, a.claim_state) for a in rows} == {("code", "supported"), ("cert", "supported")}


def test_contradiction(spark):
    (a,) = assets(spark, {"hint": "aes-128-gcm", "roles": ["configuration"]}, {"hint": "aes-256-gcm", "roles": ["usage"]})
    assert a.claim_state == "contradictory"
    assert a.contradictions[0].config_variants == ["128-GCM"] and a.contradictions[0].code_variants == ["256-GCM"]


def test_confidence(spark):
    (a,) = assets(spark, {"hint": "RSA", "roles": ["usage"], "confidence": 0.85})
    assert a.confidence == pytest.approx(0.85)
    (a,) = assets(spark, *[{"hint": "RSA", "roles": ["usage"], "confidence": 0.75}] * 26)
    assert a.confidence == pytest.approx(0.75 + 0.05 * np.log2(26))


def test_family_refinement(spark):
    (a,) = assets(spark, {"hint": "RSA", "roles": ["usage"]}, {"hint": "RS256", "roles": ["usage"]})
    assert (a.family, a.usage_role) == ("digital_signature", "digital_signature")
    (a,) = assets(spark, {"hint": "RSA", "roles": ["implementation"]})
    assert a.usage_role == "unknown"


def test_variant_status_option(spark):
    ev = normalize.normalize_findings(findings(spark, {"hint": "aes-256-gcm", "roles": ["usage"]}))
    assert fuse.fuse_assets(ev).first().quantum_status == "conditionally_safe"
    assert fuse.fuse_assets(ev, strict_variant_status=True).first().quantum_status == "safe"


def test_fallback_to_all_rows(spark):
    f = findings(spark, {"hint": "", "roles": ["usage"]}, {"hint": "UNKNOWN", "roles": ["usage"]})
    assert normalize.usable_findings(f).count() == 2
    assert normalize.usable_findings(f, fallback=False).count() == 0


def test_blast_radius_against_search(spark):
    rng = random.Random(7)
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(90)] + [("n0", "n1"), ("n1", "n0"), ("n0", "n1")]
    back = {}
    for a, b in set(edges):
        back.setdefault(b, set()).add(a)
    for limit in (1, 3, 10):
        want = set()
        for origin in {b for _, b in edges}:
            seen, todo = {origin: 0}, deque([origin])
            while todo:
                n = todo.popleft()
                for m in back.get(n, ()):
                    if m not in seen and seen[n] < limit:
                        seen[m] = seen[n] + 1
                        todo.append(m)
            want |= {(origin, n, k) for n, k in seen.items() if n != origin}
        e = spark.createDataFrame(edges, "src string, dst string")
        got = graph.blast_radius(e, e.select(F.col("dst").alias("origin")), limit)
        assert {tuple(r) for r in got.select("origin", "node", "depth").collect()} == want


def test_blast_radius_of_unknown_origin(spark):
    e = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert graph.blast_radius(e, spark.createDataFrame([("zz",)], "origin string")).count() == 0


def test_location_matches_against_search(spark):
    repos = {"a": ["/svc/x/", "lib"], "b": ["q"], "c": ["/svc/x", "app/y.py:1"]}
    places = ["svc/x/f.py:1", "z/svc/x/f:2", "mylib/q:3", "app/y.py:12", "none"]
    want = {(s, p) for s, rs in repos.items() for p in places if any(r in p or p.startswith(r.lstrip("/")) for r in rs)}
    services = spark.createDataFrame(list(repos.items()), "service string, repositories array<string>")
    got = graph.location_matches(services, spark.createDataFrame([(p,) for p in places], "source_location string"))
    assert {tuple(r) for r in got.select("service", "source_location").collect()} == want


def test_sampled_probability_equals_direct_sampling(spark):
    rows = [(float(x), float(y), lo, mo, hi) for x in range(0, 25, 3) for y in (0.5, 3) for lo, mo, hi in ((5.0, 12.0, 20.0), (1.0, 2.0, 9.0))]
    df = spark.createDataFrame(rows, "x double, y double, z_low double, z_mode double, z_high double")
    for r in risk.sampled_probability(df).collect():
        z = np.random.default_rng(20260930).triangular(r.z_low, r.z_mode, r.z_high, 10_000)
        assert r.probability == pytest.approx(round(float(np.mean(r.x + r.y > z)), 4), abs=1e-9)


def test_risk_examples(spark):
    cols = "x double, y double, z_low double, z_mode double, z_high double, quantum_status string, data_sensitivity string, business_criticality string, internet_exposure boolean, blast_radius_count int, migration_difficulty double"
    rows = risk.assess(
        spark.createDataFrame(
            [
                (15.0, 10.0, 5.0, 8.0, 12.0, "vulnerable", "top_secret", "critical", True, 50, 0.9),
                (1.0, 1.0, 15.0, 20.0, 30.0, "safe", "public", "low", False, 0, 0.1),
                (None, 1.0, 5.0, 12.0, 20.0, "vulnerable", "secret", "high", True, 1, 0.5),
            ],
            cols,
        )
    ).collect()
    assert rows[0].probability > 0.8 and rows[0].context_score > 0.7 and rows[0].risk_level == "CRITICAL" and rows[0].at_risk_baseline
    assert rows[1].probability < 0.2 and rows[1].context_score < 0.3 and rows[1].risk_level == "LOW"
    assert rows[2].probability is None and rows[2].risk_level == "INSUFFICIENT CONTEXT" and rows[2].context_score > 0


def test_signature_assets_never_get_key_exchange(spark):
    ev = normalize.normalize_findings(findings(spark, {"hint": "RS256", "roles": ["usage"]}, {"hint": "ECDH", "roles": ["usage"]}, {"hint": "ml-kem", "roles": ["usage"]}))
    got = {(r.canonical, r.candidate_family) for r in migrate.candidates(fuse.fuse_assets(ev)).collect()}
    assert got == {("RSA", "pqc_signature"), ("ECDH", "pqc_kem"), ("ECDH", "hybrid_kem")}


def test_archive_guard_stops_at_total(spark):
    rows = [("a", i, f"f{i}.py", 40, False) for i in range(1, 8)] + [("a", 8, "../x", 1, False), ("a", 9, "g.py", 1, False)]
    m = spark.createDataFrame(rows, "archive string, ordinal int, name string, size long, is_dir boolean")
    kept = archives.admit_archive_members(m, {"members": 8, "single": 100, "total": 200})
    assert [r.ordinal for r in kept.orderBy("ordinal").collect()] == [1, 2, 3, 4, 5]


def test_read_tree(spark, tmp_path):
    (tmp_path / "a" / "node_modules").mkdir(parents=True)
    (tmp_path / "a" / "x.py").write_bytes(b"import rsa \xff")
    (tmp_path / "a" / "big.py").write_bytes(b"x" * 100)
    (tmp_path / "a" / "node_modules" / "y.py").write_text("import rsa")
    (tmp_path / "a" / "z.txt").write_text("no")
    df = files.read_tree(spark, str(tmp_path), [".py"], max_bytes=50).filter(files.outside_excluded_dirs(F.col("path")))
    assert [r.content for r in df.collect()] == ["import rsa �"]


def test_registry_file(spark, tmp_path):
    good = tmp_path / "r.json"
    good.write_text('[{"name": "A", "family": "odd", "usage_roles": ["mac", "zz"]}, {"standard": "no name"}]')
    (row,) = records.load_registry(spark, str(good)).collect()
    assert (row["name"], row.family, row.status, row.usage_roles, row.variants) == ("A", "unknown", "final", ["mac"], ["A"])
    empty = tmp_path / "e.json"
    empty.write_text("[]")
    with pytest.raises(ValueError):
        records.load_registry(spark, str(empty))


def test_rescan_replaces_only_its_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("s1", 1), ("s2", 2), ("s2", 3)], "scan_id string, v int")
    store.store_by_scan(first, path, buckets=2)
    for _ in range(2):
        store.rescan(spark.createDataFrame([("s2", 9)], "scan_id string, v int"), path, buckets=2)
        got = store.read_store(spark, path, first.schema).select("scan_id", "v").collect()
        assert {tuple(r) for r in got} == {("s1", 1), ("s2", 9)} and len(got) == 2


SOURCES = [
    ("s1", "app/main.py", "import hashlib\nh = hashlib.sha256(b'')\nfrom cryptography.hazmat.primitives.asymmetric import rsa\n"),
    ("s1", "app/A.java", 'Cipher.getInstance("AES/GCM/NoPadding");\n'),
    ("s1", "requirements.txt", "paramiko==3\n"),
    ("s1", "conf/app.yaml", "cipher: AES\n"),
    ("s1", "Dockerfile", "FROM x\nEXPOSE 443\n"),
    ("s1", "node_modules/z.py", "import rsa\n"),
    ("s2", "clean.py", "x = 1\n"),
]


def test_whole_run(spark, tmp_path):
    raw = spark.createDataFrame(SOURCES, "scan_id string, path string, content string")
    found = discover(land_files(raw, str(tmp_path / "landed")))
    context = spark.createDataFrame([("s1", 10.0, 3.0)], "scan_id string, x double, y double")
    result = analyze(found, context)
    rows = {(r.canonical): r for r in result.assets.collect()}
    assert {"SHA-256", "RSA", "AES", "ECDSA", "Ed25519"} <= set(rows)
    assert "usage" in rows["SHA-256"].roles and rows["Ed25519"].roles == ["capability"]
    assert result.members.count() == len(rows) == result.components.count()
    radius = {r.asset_id: r.affected_count for r in result.affected.collect()}
    assert radius[rows["AES"].asset_id] >= 2
    assert {r.risk_level for r in result.risk.collect()} <= {"CRITICAL", "HIGH", "MEDIUM", "LOW"}


def test_landing_stream_equals_batch(spark, tmp_path):
    from cipherledger.streaming.landing import detect_arrivals, watch

    raw = spark.createDataFrame(SOURCES, "scan_id string, path string, content string")
    land_files(raw.filter("scan_id = 's1'"), str(tmp_path / "land")).select("scan_id", "path", "content", "artifact_type").write.parquet(str(tmp_path / "in"))
    query = detect_arrivals(watch(spark, str(tmp_path / "in")), str(tmp_path / "out"), f"arrivals-{uuid.uuid4().hex}")
    query.awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = discover(spark.read.parquet(str(tmp_path / "in")))
    key = lambda df: sorted((r.file_path, r.line, r.detector, r.raw_signal) for r in df.collect())
    assert key(streamed) == key(batch) and streamed.count() > 5


def test_runs_do_not_depend_on_partitions_or_earlier_landings(spark, tmp_path):
    twice = 'import hashlib\nh = hashlib.md5(b"x"); g = hashlib.md5(b"x")\nALGO = "RS256"; other_algo = "ES256"\n'
    raw = spark.createDataFrame([*SOURCES, ("s2", "twice.py", twice)], "scan_id string, path string, content string")
    seen = []
    for parts in (1, 7):
        found = discover(land_files(raw.repartition(parts), str(tmp_path / "again")))
        result = analyze(found.repartition(parts * 2))
        evidence = result.evidence.collect()
        assert len({r.evidence_id for r in evidence}) == len(evidence) >= 10
        seen.append((sorted(r.evidence_id for r in evidence), sorted(map(str, result.assets.collect()))))
    assert seen[0] == seen[1]


def test_intermediate_tables_are_deleted(spark):
    import os

    from cipherledger import session

    path = session.written(spark.range(3), "kept").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and session.clear_written(spark) > 0 and not os.path.exists(path)


def test_pages_by_last_key(spark):
    from cipherledger.operators import inventory

    rows = spark.createDataFrame([(f"s{i % 3}", i) for i in range(25)], "scan_id string, n int")
    seen, last = [], None
    while page := inventory.page_after(rows, ["scan_id", "n"], last, 10).collect():
        seen += page
        last = tuple(page[-1])
    assert seen == rows.orderBy("scan_id", "n").collect()


def test_open_radius(spark):
    from cipherledger.operators import graph

    edges = spark.createDataFrame([(f"n{i}", f"n{i - 1}") for i in range(1, 26)], "src string, dst string")
    origins = spark.createDataFrame([("n0",)], "origin string")
    assert graph.blast_radius(edges, origins, None).count() == 25
    short = graph.blast_radius(edges, origins, 4)
    assert short.count() == 4 and graph.unfinished(edges, short, 4).count() == 1
    assert graph.unfinished(edges, graph.blast_radius(edges, origins, None), 25).count() == 0
