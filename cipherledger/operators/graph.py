"""Dependency graph tables and bounded blast radius.

Nodes and edges are two tables.  Node ids are digests of (scan, type, label),
so edges are a projection of evidence rows and need no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherledger.operators import reach
from cipherledger.operators.normalize import sha_key
from cipherledger.session import written

NODE_COLUMNS = ["scan_id", "node_id", "node_type", "label", "properties"]
EDGE_COLUMNS = ["scan_id", "edge_id", "src", "dst", "edge_type", "properties"]


def node_id(scan: Column | str, kind: Column | str, label: Column | str) -> Column:
    return sha_key(scan, kind, label)


def node_type(source_type: Column) -> Column:
    return (
        F.when(source_type == "dependency", "library")
        .when(source_type == "certificate", "certificate")
        .when(source_type == "binary", "binary")
        .when(source_type == "container", "container")
        .otherwise("source_file")
    )


def edge_type(source_type: Column, roles: Column) -> Column:
    is_code = source_type.isin("python_source", "java_source")
    return (
        F.when(is_code & F.array_contains(roles, "implementation"), "IMPLEMENTS")
        .when(source_type.isin("dependency", "container"), "PROVIDES")
        .when(source_type == "certificate", "SIGNS")
        .when(source_type == "binary", "IMPLEMENTS")
        .otherwise("USES")
    )


def source_label(location: Column, grain: str = "line") -> Column:
    """Node label of a source: its location, or the file alone for ``grain='file'``."""
    return location if grain == "line" else F.regexp_replace(location, r":\d+$", "")


def digest_bytes(name: str) -> Column:
    """A digest in hex as bytes: half the room and the same order; other ids as they are."""
    return F.coalesce(F.unhex(name), F.encode(name, "UTF-8"))


def id_bytes(name: Column) -> Column:
    """An id as bytes: a digest in hex takes half the room; any other becomes longer than these, so that no two ids share their bytes."""
    return F.when(name.rlike(r"^[0-9a-f]{64}\z"), F.unhex(name)).otherwise(F.concat(F.lit("#" * 33), name).cast("binary"))


def of_id_bytes(key: Column) -> Column:
    return F.when(F.length(key) == 32, F.lower(F.hex(key))).otherwise(F.substring(key, 34, 2**31 - 1).cast("string"))


def of_assets(evidence: DataFrame) -> DataFrame:
    """Evidence rows that belong to an asset, told by their class where there is one: the id is a digest, dear to make only for this."""
    return evidence.filter("evidence_class = 'algorithm'" if "evidence_class" in evidence.columns else "asset_id IS NOT NULL")


def algorithm_nodes(assets: DataFrame) -> DataFrame:
    """One node per scan and canonical name; the asset with the earliest evidence describes it."""
    props = F.map_filter(
        F.create_map(
            F.lit("canonical_algorithm"), F.col("canonical"), F.lit("family"), F.col("family"),
            F.lit("quantum_status"), F.col("quantum_status"), F.lit("claim_state"), F.col("claim_state"),
            F.lit("confidence"), F.round("confidence", 6).cast("string"), F.lit("usage_role"), F.col("usage_role"),
            F.lit("roles"), F.array_join("roles", ","), F.lit("asset_id"), F.col("asset_id"),
            F.lit("variant"), F.col("variant"),
        ),
        lambda k, v: v.isNotNull() & (v != ""),
    )
    return (
        assets.groupBy("scan_id", "canonical")
        .agg(F.min_by(props, F.struct("first_ord", "surface")).alias("properties"))
        .select(
            "scan_id", node_id("scan_id", F.lit("algorithm"), "canonical").alias("node_id"),
            F.lit("algorithm").alias("node_type"), F.col("canonical").alias("label"), "properties",
        )
    )


def source_nodes(evidence: DataFrame, grain: str = "line") -> DataFrame:
    """One node per scan, type and location; the first evidence row gives the properties."""
    rows = of_assets(evidence).select(
        "scan_id", node_type(F.col("source_type")).alias("node_type"),
        source_label(F.col("source_location"), grain).alias("label"), "source_type", "detector", "ord", digest_bytes("evidence_id").alias("evidence_id"),
    )
    return (
        rows.groupBy("scan_id", "node_type", "label")
        .agg(F.min_by(F.struct("source_type", "detector"), F.struct("ord", "evidence_id")).alias("first"))
        .select(
            "scan_id", node_id("scan_id", "node_type", "label").alias("node_id"), "node_type", "label",
            F.create_map(F.lit("source_type"), F.col("first.source_type"), F.lit("detector"), F.col("first.detector")).alias("properties"),
        )
    )


def evidence_edges(evidence: DataFrame, grain: str = "line", labels: bool = False) -> DataFrame:
    """Source -> algorithm, one edge per evidence row; a projection without shuffle.

    With ``labels`` also src_type, src_label and dst_label, what the ids of its ends are digests of.
    """
    rows = of_assets(evidence)
    label = source_label(F.col("source_location"), grain)
    return rows.select(
        "scan_id",
        sha_key("scan_id", F.lit("edge"), "evidence_id").alias("edge_id"),
        node_id("scan_id", node_type(F.col("source_type")), label).alias("src"),
        node_id("scan_id", F.lit("algorithm"), "canonical").alias("dst"),
        edge_type(F.col("source_type"), F.col("roles")).alias("edge_type"),
        F.create_map(
            F.lit("evidence_id"), F.col("evidence_id"), F.lit("confidence"), F.col("confidence").cast("string")
        ).alias("properties"),
        *([node_type(F.col("source_type")).alias("src_type"), label.alias("src_label"), F.col("canonical").alias("dst_label")] if labels else []),
    )


def node_keys() -> dict[str, Column]:
    """The columns of nodes that follow from the others."""
    return {"node_id": node_id("scan_id", "node_type", "label")}


def edge_keys() -> dict[str, Column]:
    """The columns of ``evidence_edges`` with labels that follow from the others."""
    return {
        "edge_id": sha_key("scan_id", F.lit("edge"), F.col("properties")["evidence_id"]),
        "src": node_id("scan_id", "src_type", "src_label"),
        "dst": node_id("scan_id", F.lit("algorithm"), "dst_label"),
    }


def build_graph(evidence: DataFrame, assets: DataFrame, grain: str = "line") -> tuple[DataFrame, DataFrame]:
    nodes = algorithm_nodes(assets).unionByName(source_nodes(evidence, grain))
    return nodes, evidence_edges(evidence, grain)


# --- topology ------------------------------------------------------------------


ENDS = 4096  # most pairs of ends that cuts are held against before their join
HEADS = 64  # most first and last two characters that a pattern looks for


def service_matches(rows: DataFrame, services: DataFrame) -> DataFrame:
    """``rows`` with the columns of every service (but its repositories) that their ``source_location`` belongs to:
    it contains one of the repositories, or starts with one without its leading slash. Once for each service row.

    Containment is an equality join on substrings: a location is cut to the lengths that
    repositories have, and a cut reaches the join only if some repository has its first and
    last two characters. Only repositories with a leading slash are looked for at the start
    without it; the others stand inside there. The repositories are stored first, so that the
    join knows their size and ``rows`` need no shuffle while Spark can broadcast them; a
    service is met at the first of its repositories, so no pair has to be found again.
    """
    others = [c for c in services.columns if c != "repositories"]
    repos = F.filter("repositories", lambda r: r != "")
    test = lambda part, flag: F.struct(part.alias("part"), F.lit(flag).alias("at_start"))
    slashed = F.transform(F.filter(repos, lambda r: r.startswith("/")), lambda r: test(F.ltrim(r, F.lit("/")), True))
    tests = services.select(*others, F.array_distinct(F.concat(F.transform(repos, lambda r: test(r, False)), slashed)).alias("_tests"))
    parts = tests.select(*others, "_tests", F.posexplode("_tests").alias("_k", "_t")).select(
        *others, "_t.part", "_t.at_start", F.slice("_tests", F.lit(1), F.col("_k")).alias("_earlier")
    )
    parts = written(parts, "repositories", compression="zstd")
    at = F.col("source_location")
    met = F.exists("_earlier", lambda e: F.when(e.at_start, at.startswith(e.part)).otherwise(at.contains(e.part)))
    joined = _cuts(rows, parts).join(parts, ["part", "at_start"]).filter((F.size("_earlier") == 0) | ~met)
    return joined.select(*rows.columns, *others)


def location_matches(services: DataFrame, locations: DataFrame) -> DataFrame:
    """(service, source_location) where the location belongs to the service (``service_matches``)."""
    found = service_matches(locations.select("source_location"), services.select("service", "repositories"))
    return found.select("service", "source_location").distinct()


def _cuts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows, part, at_start: substrings of source_location that have the length and the ends of a part, each once for a row.

    Patterns find the longest and the shortest candidate of a position; only where these differ are the lengths between tried.
    """
    ends_of = "concat({0}, '|', substring({1}, 1, 2), substring({1}, {2} - 1, 2))".format
    at_start = F.col("at_start")
    of = parts.groupBy("at_start", F.length("part").alias("n")).agg(F.count("*")).collect()
    lengths = {flag: sorted(r.n for r in of if r.at_start == flag) for flag in (False, True)}
    ends = parts.select("at_start", F.substring("part", 1, 2).alias("head"), F.expr("substring(part, length(part) - 1, 2)").alias("tail"))
    ends = ends.distinct().limit(ENDS + 1).collect()
    known = {flag: [r for r in ends if r.at_start == flag and len(ends) <= ENDS] for flag in (False, True)}
    found, least = _candidates(lengths[False], known[False], "")
    start, start_least = _candidates(lengths[True], known[True], r"\A")
    starts = rows.select("*", start.alias("_start"), start_least.alias("_start_least"), found.alias("_found"), least.alias("_least"))
    starts = starts.select(*rows.columns, F.size("_start").alias("_first"), F.concat("_start", "_found").alias("_from"), F.concat("_start_least", "_least").alias("_least"))
    starts = starts.select("*", F.posexplode_outer("_from").alias("_k", "_s"))
    ints = lambda flag: F.array(*map(F.lit, lengths[flag])).cast("array<int>")
    one = F.expr("_s = element_at(_least, _k + 1)")
    cut = starts.select("*", F.explode_outer(F.when(one, F.array(F.length("_s"))).when(F.expr("_k < _first"), ints(True)).otherwise(ints(False))).alias("_n"))
    cut = cut.filter("_n <= length(_s)")
    if len(ends) <= ENDS:  # beyond that all cuts go to the join
        within = "_s" if min(lengths[False] + lengths[True], default=0) >= 2 else "substring(_s, 1, _n)"
        cut = cut.filter(F.expr(ends_of("_k < _first", within, "_n")).isin([f"{str(r.at_start).lower()}|{r.head}{r.tail}" for r in ends]))
    cut = cut.withColumns({"part": F.expr("substring(_s, 1, _n)"), "at_start": F.expr("_k < _first")})
    # a cut that stands at several positions counts at the first
    alone = F.expr("locate(part, source_location, locate(part, source_location) + 1) = 0")
    first = F.expr("array_position(transform(_from, (s, i) -> if(i < _first, NULL, substring(s, 1, _n))), part) = _k + 1")
    return cut.filter(at_start | alone | first).select(*rows.columns, "part", "at_start")


def _candidates(lengths: list[int], ends: list, anchor: str) -> tuple[Column, Column]:
    """For each position of source_location (or its start) where parts may stand: what is as long as the longest and as the shortest of them."""
    at = F.col("source_location")
    none = F.array().cast("array<string>")
    if not lengths:
        return none, none
    quoted = lambda text: "".join(c if c.isalnum() or c > "\x7f" else f"\\{c}" for c in text)
    tails: dict[str, set[str]] = {}
    for r in ends:
        tails.setdefault(r.head, set()).add(r.tail)
    least, most = lengths[0], lengths[-1]
    sharp = tails and least >= 4 and len(tails) <= HEADS and max(map(len, tails.values())) <= HEADS
    if not anchor and not sharp and not 0 < len(tails) <= HEADS:  # no ends to tell positions by
        places = F.sequence(F.lit(1), F.greatest(F.length(at), F.lit(1)))
        return F.transform(places, lambda i: at.substr(i, F.lit(most))), F.transform(places, lambda i: F.lit(""))

    def pattern(lazy: str) -> str:
        if sharp:
            shapes = [f"{quoted(h)}.{{{least - 4},{most - 4}}}{lazy}(?:{'|'.join(map(quoted, sorted(t)))})" for h, t in sorted(tails.items())]
            return f"(?s){anchor}(?=({'|'.join(shapes)}))"
        heads = "" if anchor else f"(?={'|'.join(map(quoted, sorted(tails)))})"
        return f"(?s){anchor}{heads}(?=(.{{{least},{most}}}{lazy}))"

    return tuple(F.regexp_extract_all(at, F.lit(pattern(lazy)), F.lit(1)) for lazy in ("", "?"))


def topology_nodes(scans: DataFrame, services: DataFrame | None = None) -> DataFrame:
    """Service and data-asset nodes for the scans that the topology applies to.

    ``scans`` has the columns of the services, or only their names. Services of one name share a node.
    """
    placed = scans if services is None else scans.select("scan_id", "service").distinct().join(services, "service")
    service = placed.groupBy("scan_id", "service").agg(F.min(F.struct("business_criticality", "internet_exposure")).alias("of")).select(
        "scan_id", node_id("scan_id", F.lit("service"), "service").alias("node_id"), F.lit("service").alias("node_type"),
        F.col("service").alias("label"),
        F.create_map(
            F.lit("business_criticality"), F.coalesce("of.business_criticality", F.lit("unknown")),
            F.lit("internet_exposure"), F.coalesce("of.internet_exposure", F.lit(False)).cast("string"),
            F.lit("source"), F.lit("enterprise_yaml"),
        ).alias("properties"),
    )
    held = placed.select("scan_id", F.explode("data_assets").alias("a")).select("scan_id", "a.*")
    data = (
        held.groupBy("scan_id", "name").agg(F.min("sensitivity").alias("sensitivity"))
        .select(
            "scan_id", node_id("scan_id", F.lit("data_asset"), "name").alias("node_id"), F.lit("data_asset").alias("node_type"),
            F.col("name").alias("label"),
            F.create_map(
                F.lit("sensitivity"), F.coalesce("sensitivity", F.lit("unknown")), F.lit("source"), F.lit("enterprise_yaml")
            ).alias("properties"),
        )
    )
    return service.unionByName(data)


def topology_edges(evidence: DataFrame, services: DataFrame) -> DataFrame:
    """Service USES algorithm (one edge per matching evidence row and service row) and service PROTECTS data asset (one per scan)."""
    rows = of_assets(evidence).select("scan_id", "canonical", "source_location", "evidence_id")
    matched = service_matches(rows, services.select("service", "repositories", F.transform("data_assets", lambda a: a["name"]).alias("_names")))
    uses = matched.select(
        "scan_id", sha_key("scan_id", "service", "evidence_id").alias("edge_id"),
        node_id("scan_id", F.lit("service"), "service").alias("src"),
        node_id("scan_id", F.lit("algorithm"), "canonical").alias("dst"),
        F.lit("USES").alias("edge_type"),
        F.create_map(F.lit("source"), F.lit("enterprise_yaml_inference")).alias("properties"),
    )
    # a name is that of the service row that was met, so services of one name do not multiply each other's
    protects = matched.select("scan_id", "service", F.explode("_names").alias("_name")).distinct().select(
        "scan_id", sha_key("scan_id", "service", "_name").alias("edge_id"),
        node_id("scan_id", F.lit("service"), "service").alias("src"),
        node_id("scan_id", F.lit("data_asset"), "_name").alias("dst"),
        F.lit("PROTECTS").alias("edge_type"),
        F.create_map(F.lit("source"), F.lit("enterprise_yaml")).alias("properties"),
    )
    return uses.unionByName(protects)


# --- traversal -----------------------------------------------------------------


def collapse_parallel(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def blast_radius(edges: DataFrame, origins: DataFrame, max_depth: int | None = 10) -> DataFrame:
    """Dependents of every origin: (origin, node, depth) with the smallest depth, origin excluded.

    The pairs of ``reach.walk``; counts are better taken from the walk itself. Stops when
    nothing new is reached, or at ``max_depth`` if one is given. Origins that no edge
    touches simply have no rows.
    """
    return reach.pairs(reach.walk(edges, origins, max_depth))


def unfinished(edges: DataFrame, radius: DataFrame, max_depth: int) -> DataFrame:
    """Origins with dependents further away than ``max_depth``."""
    last = radius.filter(F.col("depth") == max_depth).select("origin", F.col("node").alias("dst"))
    beyond = last.join(collapse_parallel(edges), "dst").select("origin", F.col("src").alias("node")).filter("origin <> node")
    return beyond.join(radius, ["origin", "node"], "left_anti").select("origin").distinct()


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends exist."""
    ids = nodes.select("node_id")
    return edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi"
    )


def absent_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stored table of the ids (``end``) of edges that are no node; a null is among them if an edge lacks an end.

    Edges are read once, and one aggregation of ids holds both tables against each other.
    """
    ends = edges.select(F.explode_outer(F.array("src", "dst")).alias("end")).select(id_bytes(F.col("end")).alias("key"), F.lit(False).alias("node"))
    ids = nodes.filter("node_id IS NOT NULL").select(id_bytes(F.col("node_id")).alias("key"), F.lit(True).alias("node"))
    gone = ends.unionByName(ids).groupBy("key").agg(F.max("node").alias("node")).filter("NOT node")
    return written(gone.select(of_id_bytes(F.col("key")).alias("end")), "missing")


def missing_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stored table of the ids (``end``) of edges that are no node: usually few, so that joins with it move no edge."""
    return absent_ends(edges, nodes).filter("end IS NOT NULL")


def node_records(nodes: DataFrame) -> DataFrame:
    """JSON record per node with the properties flattened into it (one line per node)."""
    own = F.create_map(F.lit("node_id"), F.col("node_id"), F.lit("label"), F.col("label"), F.lit("node_type"), F.col("node_type"))
    kept = F.map_filter(own, lambda k, v: ~F.array_contains(F.map_keys("properties"), k))
    return nodes.select("scan_id", "node_id", F.to_json(F.map_concat(kept, "properties")).alias("record"))


def edge_records(edges: DataFrame) -> DataFrame:
    own = F.create_map(
        F.lit("edge_id"), F.col("edge_id"), F.lit("source"), F.col("src"), F.lit("target"), F.col("dst"),
        F.lit("edge_type"), F.col("edge_type"),
    )
    kept = F.map_filter(own, lambda k, v: ~F.array_contains(F.map_keys("properties"), k))
    return edges.select("scan_id", "edge_id", F.to_json(F.map_concat(kept, "properties")).alias("record"))


def asset_nodes(assets: DataFrame) -> DataFrame:
    """Bridge from asset to its algorithm node (both surfaces of a name share one node)."""
    return assets.select("asset_id", "scan_id", node_id("scan_id", F.lit("algorithm"), "canonical").alias("node_id"))
