import glob
import hashlib
import tempfile
import time

from cipherledger.operators import graph
from cipherledger.sources import store

NODES = "scan_id string, node_id string, label string"
EDGES = "scan_id string, edge_id string, src string, dst string"
EDGE_ROWS = [("s", "1", "a", "x"), ("s", "2", "a", "gone"), ("s", "3", "lost", "x"), ("s", "4", None, "x"), ("s", "5", "b", None), ("t", "6", "b", "x")]


def _tables(spark):
    nodes = spark.createDataFrame([("s", "a", "A"), ("s", "b", "B"), ("s", "x", "X")], NODES)
    return nodes, spark.createDataFrame(EDGE_ROWS, EDGES)


def test_stored_edges_have_both_ends(spark, tmp_path):
    nodes, edges = store.store_graph(*_tables(spark), str(tmp_path / "g"))
    assert nodes.count() == 3
    assert {r.edge_id for r in edges.collect()} == {"1", "6"}


def test_missing_ends_are_ids_without_a_node(spark):
    nodes, edges = _tables(spark)
    assert {r.end for r in graph.missing_ends(edges, nodes).collect()} == {"gone", "lost"}


def test_copied_edges_keep_old_ends(spark):
    nodes, edges = _tables(spark)
    copies = spark.createDataFrame([("s", "c1"), ("s", "c2"), ("none", "c3")], "from_scan string, to_scan string")
    key = lambda *p: spark.range(1).select(store.copied_id(*[store.F.lit(x) for x in p])).first()[0]
    got = {(r.scan_id, r.edge_id, r.src, r.dst) for r in store.copy_edges(edges, nodes, copies).collect()}
    known = {"a", "b", "x"}
    new = lambda c, i: key(c, i) if i in known else i
    assert got == {(c, key(c, e), new(c, s), new(c, d)) for c in ("c1", "c2") for scan, e, s, d in EDGE_ROWS if scan == "s"}


def test_copies_move_no_row_by_scan(spark):
    """The scans of the copies are a stored small table, so evidence is not dealt by its few scans."""
    rows = spark.range(1000).selectExpr("'s' || id % 5 AS scan_id", "string(id) AS evidence_id", "string(id % 7) AS asset_id")
    copies = spark.range(50).selectExpr("'s' || id AS from_scan", "'c' || id AS to_scan")
    plan = store.copy_evidence(rows, rows.select("asset_id").distinct(), copies)
    assert "Exchange hashpartitioning" not in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count() == 1000


def test_few_cuts_reach_the_location_join(spark):
    """Only substrings with the ends of a repository are joined, and matches are those of a search."""
    repos = {"a": ["svc/1/src", "/svc/1/"], "b": ["vc/2/sr"], "c": ["/"], "d": ["//x/"]}
    places = ["svc/1/src/f3.py:1", "svc/2/src/f3.py:12", "x/svc/1/g", "none", "x/"]
    services = spark.createDataFrame(list(repos.items()), "service string, repositories array<string>")
    rows = spark.createDataFrame([(p,) for p in places], "source_location string")
    want = {(s, p) for s, rs in repos.items() for p in places if any(r in p or p.startswith(r.lstrip("/")) for r in rs)}
    assert {tuple(r) for r in graph.location_matches(services, rows).collect()} == want
    parts = spark.createDataFrame([("svc/1/src", False), ("/svc/1/", False), ("vc/2/sr", False), ("svc/1/", True)], "part string, at_start boolean")
    cuts = {tuple(r) for r in graph._cuts(rows.filter("source_location like 'svc/1%'"), parts).collect()}
    assert cuts == {("svc/1/src/f3.py:1", p, f) for p, f in (("svc/1/src", False), ("vc/1/sr", False), ("svc/1/", True))}


def test_rows_of_assets_need_no_digest(spark):
    rows = spark.range(3).selectExpr("id", "if(id > 0, 'algorithm', 'library') AS evidence_class")
    rows = rows.withColumn("asset_id", graph.F.when(graph.F.col("evidence_class") == "algorithm", graph.sha_key(graph.F.col("id").cast("string"))))
    plan = graph.of_assets(rows).select("id")
    assert {r.id for r in plan.collect()} == {1, 2} and "sha2" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert graph.of_assets(rows.drop("evidence_class")).count() == 2


def _topology(spark):
    services = spark.createDataFrame(
        [("a", ["svc/1/src", "/svc/1/"], [("d1", "x")]), ("a", ["svc/2/"], [("d2", "x"), ("d2", "y")]), ("b", ["/svc/1/", "c/1/s", "/"], []), ("c", ["1/1"], [("d3", "x")])],
        "service string, repositories array<string>, data_assets array<struct<name: string, sensitivity: string>>",
    )
    places = ["svc/1/src/svc/1/src:1", "x/svc/1/svc/2/", "svc/2/1/1/1", "none", "\U0001d51bsvc/2/"]
    rows = spark.range(20).selectExpr("'s' || id % 2 AS scan_id", "'k' AS canonical", "string(id) AS evidence_id", "id % 5 AS at", "'algorithm' AS evidence_class")
    rows = rows.withColumn("source_location", graph.F.element_at(graph.F.array(*map(graph.F.lit, places)), (graph.F.col("at") + 1).cast("int"))).drop("at")
    return rows, services


def test_services_of_one_name_do_not_multiply(spark):
    """One USES edge for each evidence row and service row, one PROTECTS edge for each data asset of a service row that was met."""
    rows, services = _topology(spark)
    met = [(e, s) for e in rows.collect() for s in services.collect() if any(r in e.source_location or e.source_location.startswith(r.lstrip("/")) for r in s.repositories)]
    sha = lambda *p: hashlib.sha256("#".join(p).encode()).hexdigest()
    want = [(sha(e.scan_id, s.service, e.evidence_id), "USES") for e, s in met]
    want += [(sha(*p), "PROTECTS") for p in {(e.scan_id, s.service, a.name) for e, s in met for a in s.data_assets}]
    assert sorted(tuple(r) for r in graph.topology_edges(rows, services).select("edge_id", "edge_type").collect()) == sorted(want)
    placed = graph.service_matches(rows.select("scan_id", "source_location"), services.selectExpr("*", "'low' AS business_criticality", "true AS internet_exposure"))
    nodes = [(r.scan_id, r.node_type, r.label) for r in graph.topology_nodes(placed).collect()]
    assert sorted(nodes) == sorted({(e.scan_id, "service", s.service) for e, s in met} | {(e.scan_id, "data_asset", a.name) for e, s in met for a in s.data_assets})


def test_topology_moves_no_evidence(spark):
    """Only the names of scans, services and data assets are shuffled, not locations or evidence."""
    plan = graph.topology_edges(*_topology(spark))._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
    assert len(moved) == 1 and "source_location" not in moved[0], moved


def test_cuts_of_all_shapes_are_those_of_a_search(spark):
    """Short, long, overlapping and many repositories, and places with repeats, other scripts and line ends."""
    places = ["", "a", "ab", "aab\naab", "abababab", "svc/1/src/svc/1/src", "xsvc/12/src", "\U0001d51b/ab.c*d", "/svc/1/", "q\\E?.{1}"]
    shapes = [["ab", "b"], ["svc/1/src", "svc/12/src", "/svc/1/"], ["/"], ["abab", "/ab.c", ".c*d"], ["\\E?.", "aab\n", "/\U0001d51b"], ["abababab", "baba", "abab", "svc/1/src/s"]]
    shapes.append([chr(97 + i % 26) + chr(97 + i // 26) + "xx" for i in range(70)] + ["abab", "svc/1/"])  # more heads than a pattern looks for
    shapes.append([f"svc/{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(70)] + ["svc/1/"])  # more tails
    rows = spark.createDataFrame([(p,) for p in places], "source_location string")
    for repos in shapes:
        services = spark.createDataFrame([("all", repos), *((r, [r]) for r in repos)], "service string, repositories array<string>")
        got = sorted(tuple(r) for r in graph.service_matches(rows, services).select("source_location", "service").collect())
        want = sorted((p, s.service) for p in places for s in services.collect() if any(r in p or p.startswith(r.lstrip("/")) for r in s.repositories))
        assert got == want, repos


def test_ids_of_any_shape_are_told_apart(spark, tmp_path):
    """Digests, what looks like them, and text: an end is there only if a node has the very same id."""
    hexed = "ab" * 32
    ids = [hexed, hexed.upper(), hexed + "\n", "61", "a", "", "#" * 33, bytes.fromhex("61" * 32).decode(), "61" * 32, "\U0001d51b"]
    for have in range(0, len(ids), 3):
        nodes = spark.createDataFrame([("s", i, i) for i in ids[have : have + 3]] + [("s", None, "none")], NODES)
        edges = spark.createDataFrame([("s", str(k), i, ids[have]) for k, i in enumerate([*ids, None])], EDGES)
        assert {r.end for r in graph.missing_ends(edges, nodes).collect()} == set(ids) - set(ids[have : have + 3])
        assert {r.src for r in store.store_graph(nodes, edges, str(tmp_path / f"g{have}"))[1].collect()} == set(ids[have : have + 3])


def test_stored_graph_is_labelled_without_a_shuffle(spark):
    """Edges are stored with the labels of their ends, so that digests are not joined again to find them."""
    import __spark_entry__ as entry

    rows = entry.queries()["s12_stored_graph"](spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan, plan
    assert rows.filter("src_label IS NOT NULL AND dst_label IS NOT NULL").count() == rows.count() > 0


def test_shuffles_of_a_store_do_not_stay(spark, tmp_path):
    from cipherledger.session import shuffles_dropped

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    files = lambda: {f for f in glob.glob(f"{tempfile.gettempdir()}/blockmgr-*/*/shuffle_*")}
    there = files()
    with shuffles_dropped(spark):
        spark.range(1000).repartition(4, "id").write.parquet(str(tmp_path / "t"))
        for _ in range(50):
            if not files() - there:
                break
            time.sleep(0.1)
        assert not files() - there
    assert spark.conf.get(name) == before


def test_ids_made_at_reading_are_those_stored(spark, tmp_path):
    """Columns that follow from others are not written, and nothing changes for a reader."""
    from cipherledger.plans import fixtures as fx

    evidence, assets = (f(spark, "/root/testdata/sf0.001") for f in (fx.evidence, fx.assets))
    nodes, edges = graph.build_graph(evidence, assets)[0], graph.evidence_edges(evidence, labels=True)
    got = store.store_graph(nodes, edges, str(tmp_path / "made"), graph.node_keys(), graph.edge_keys())
    want = store.store_graph(nodes, edges, str(tmp_path / "stored"))
    for a, b, first in zip(got, want, (nodes, edges)):
        assert a.columns == b.columns == first.columns
        rows = lambda df: sorted(map(str, df.collect()))
        assert rows(a) == rows(b) == rows(first)
    written = spark.read.parquet(*glob.glob(str(tmp_path / "made-*/edges"))).columns
    assert not {"edge_id", "src", "dst"} & set(written) and {"src_label", "dst_label", "properties"} <= set(written)
