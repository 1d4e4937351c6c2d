"""Sets in long form against plain sets."""

import random

from cipherledger.operators import sets


def test_sets_equal_plain_sets(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", "c", "hot"]), rng.choice([*"pqrstuv", None]), rng.random() < 0.5) for _ in range(400)] + [("same1", "p", True), ("same2", "p", True)]
    rows += [("hot", f"n{i}", i % 2 == 0) for i in range(300)] + [(None, "p", True)]
    df = spark.createDataFrame(rows, "g string, x string, side boolean").repartition(6)
    left, right = (sets.members(df.filter(f"side = {s}"), "g", "x") for s in ("true", "false"))
    plain = {}
    for g, x, side in rows:
        if x is not None:
            plain.setdefault(g, (set(), set()))[not side].add(x)
    found = {(r.g, r.x): (r.in_left, r.in_right) for r in sets.compared(left, right, "g", "x").collect()}
    assert found == {(g, x): (x in a, x in b) for g, (a, b) in plain.items() for x in a | b}
    sides = {(r.g, r.x, r.side) for r in sets.differences(left, right, "g", "x").collect()}
    assert sides == {(g, x, "extra") for g, (a, b) in plain.items() for x in a - b} | {(g, x, "missing") for g, (a, b) in plain.items() for x in b - a}
    relations = {r.g: (r.n_both, r.n_left_only, r.n_right_only, r.is_subset, r.is_equal) for r in sets.relations(left, right, "g", "x").collect()}
    assert relations == {g: (len(a & b), len(a - b), len(b - a), b <= a, a == b) for g, (a, b) in plain.items()}


def test_digests_tell_sets_apart(spark):
    groups = {"a": "pq", "b": "qp", "c": "p", "d": "pqr", "e": "pr"}
    rows = [(g, x) for g, xs in groups.items() for x in xs * 2]
    got = {r.g: (r.n, r.digest) for r in sets.digests(sets.members(spark.createDataFrame(rows, "g string, x string"), "g", "x"), "g", "x").collect()}
    assert got["a"] == got["b"] and len(set(got.values())) == 4
