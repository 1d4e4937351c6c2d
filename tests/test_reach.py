"""Packed reachability against a plain search."""

import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from cipherledger.operators import reach


def search(edges, origins, limit):
    """(origin, node) -> depth, and the origins that have more beyond the limit."""
    back = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            back.setdefault(b, set()).add(a)
    found, more = {}, set()
    for origin in origins:
        seen, todo = {origin: 0}, deque([origin])
        while todo:
            n = todo.popleft()
            for m in back.get(n, ()):
                if m in seen:
                    continue
                if limit is not None and seen[n] >= limit:
                    more.add(origin)
                    continue
                seen[m] = seen[n] + 1
                todo.append(m)
        found |= {(origin, n): k for n, k in seen.items() if n != origin}
    return found, more


@pytest.mark.parametrize("limit", [1, 2, 4, None])
def test_walk_equals_search(spark, limit):
    rng = random.Random(11)
    nodes = [f"n{i}" for i in range(150)]
    edges = [(rng.choice(nodes), rng.choice(nodes[:60])) for _ in range(220)]  # most nodes are leaves
    edges += [("n0", "n1"), ("n1", "n2"), ("n2", "n0"), ("n0", "n1"), ("n5", "n5"), (None, "n1"), ("n1", None)]
    edges += [(f"chain{i}", f"chain{i + 1}") for i in range(9)]
    origins = nodes[:100] + ["chain9", "nowhere", "n3"]  # over 64, one of them unknown, one twice
    found, more = search(edges, set(origins), limit)
    e = spark.createDataFrame(edges, "src string, dst string").repartition(3)
    o = spark.createDataFrame([(x, x[:2]) for x in origins] + [(None, "g")], "origin string, group string")
    walked = reach.walk(e, o, limit)
    assert {(r["origin"], r["node"]): r["depth"] for r in reach.pairs(walked).collect()} == found
    assert reach.pairs(walked).count() == len(found)
    counts = Counter(o for o, _ in found)
    deepest = {o: max(k for (p, _), k in found.items() if p == o) for o in counts}
    got = {r["origin"]: (r["affected_count"], r["reached_depth"]) for r in reach.affected_counts(walked).collect()}
    assert got == {o: (counts.get(o, 0), deepest.get(o, 0)) for o in set(origins)}
    histogram = {(r["origin"], r["depth"]): r["n"] for r in reach.depth_histogram(walked).collect()}
    assert histogram == Counter((o, k) for (o, _), k in found.items())
    split = {r["origin"]: (r["direct"], r["transitive"]) for r in reach.dependents(walked).collect()}
    assert split == {o: (histogram.get((o, 1), 0), counts[o] - histogram.get((o, 1), 0)) for o in counts}
    kinds = spark.createDataFrame([(n, n[-1]) for n in nodes], "node_id string, node_type string")
    types = {(r["origin"], r["node_type"]): r["n"] for r in reach.affected_types(walked, kinds).collect()}
    assert types == Counter((o, n[-1]) for o, n in found if n in set(nodes))
    assert {r["origin"] for r in reach.unfinished(walked).collect()} == more


def test_no_edges_and_no_origins(spark):
    e = spark.createDataFrame([("a", "b")], "src string, dst string")
    o = spark.createDataFrame([("b",)], "origin string")
    assert reach.affected_counts(reach.walk(e.filter("src = 'x'"), o)).collect()[0][1:] == (0, 0)
    empty = reach.walk(e, o.filter("origin = 'x'"))
    assert reach.pairs(empty).count() == reach.affected_counts(empty).count() == reach.unfinished(empty).count() == 0
    with pytest.raises(ValueError):
        reach.walk(e, o, 0)


def test_counts_make_no_pairs(spark):
    """A hub with many leaves and many origins behind it: rows stay (node, word)."""
    edges = [(f"leaf{i}", "hub") for i in range(300)] + [("hub", f"origin{i}") for i in range(200)]
    e = spark.createDataFrame(edges, "src string, dst string")
    walked = reach.walk(e, e.filter("src = 'hub'").select(F.col("dst").alias("origin")))
    assert walked.levels.count() <= 301 * walked.origins.select("word").distinct().count()
    assert {tuple(r)[1:] for r in reach.affected_counts(walked).collect()} == {(301, 2)}
