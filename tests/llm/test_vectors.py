import hashlib
import math
import random

import numpy as np

from cipherledger.llm import clustering


def brute(rows, count=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:count]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(centres)]
    out = [(i, *reversed(near(v))) for i, v in kept]
    sums = {k: sum(d for _, c, d in out if c == k) for _, k, _ in out}
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, k, d, sums[k], sum(sums.values()), name[k]) for i, k, d in out), key=str)


def got(frame):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in frame.collect()), key=str)


def vectors(spark, rows):
    schema = "vec_id bigint, embedding array<double>, planes string, norm int, cluster string, x int, k int, n int"
    return spark.createDataFrame([(i, v, "p", 1, "c", 2, 3, 4) for i, v in rows], schema).repartition(3)


def test_planes_hold_the_integers():
    rng = np.random.default_rng(3)
    for top in (0, 1, 63, 64, 1 << 20, 1 << 27):
        a, b = rng.integers(-top - 1, top + 1, (7, 64)), rng.integers(-top - 1, top + 1, (5, 64))
        p, q = clustering.pack(a), clustering.pack(b)
        assert (clustering.dots(p, q) == a @ b.T).all()
        assert (clustering.norms(p) == (a * a).sum(axis=1)).all()
        assert (clustering.unpacked_sums(p) == a.sum(axis=0)).all()


def test_clusters_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 3) for _ in range(64)]) for i in range(150)]
    rows += [(7, rows[7][1])] * 40 + [(i, [0.0] * 64) for i in range(200, 220)]  # a hot vector, and ties at the start
    rows += [(None, [0.5] * 64), (300, None), (301, []), (302, [1.0] * 63), (303, [None] + [1.0] * 63), (304, [float("nan")] + [1.0] * 63)]
    rows += [(305, [float("-inf")] + [1.0] * 63), (306, [1.0] * 65), (307, [-1e-9] * 64), (308, [3e4] * 64)]
    assert got(clustering.clusters(vectors(spark, rows))) == brute(rows)


def test_repeated_ids_and_few_vectors(spark):
    rows = [(1, [float(k)] * 64) for k in range(20)]
    assert got(clustering.clusters(vectors(spark, rows))) == brute(rows)
    assert got(clustering.clusters(vectors(spark, rows[:3]))) == brute(rows[:3])


def test_huge_components_and_no_vectors(spark):
    rows = [(1, [1e30] * 64), (2, [-1e30] * 64), (3, [0.0] * 64)]
    out = got(clustering.clusters(vectors(spark, rows)))
    assert [r[0] for r in out] == [1, 2, 3] and {r[2] for r in out} == {0}
    none = clustering.clusters(vectors(spark, [(1, None)]))
    assert none.columns == ["vec_id", "cluster", "distance", "centroid_sha256", "cluster_inertia", "inertia"] and none.count() == 0
