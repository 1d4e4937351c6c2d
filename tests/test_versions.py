"""Changes of a versioned table are seen as a whole or not at all."""

import pytest
from pyspark.sql import functions as F

from cipherledger.session import storage
from cipherledger.sources import versions


def rows(spark, scans, run, n=3):
    return spark.createDataFrame([(f"s{s}", i, run) for s in scans for i in range(n)], "scan_id string, i int, run string")


def seen(spark, path, frame, number=None):
    return {(r.scan_id, r.run, r.n) for r in versions.read(spark, path, frame.schema, number).groupBy("scan_id", "run").agg(F.count("*").alias("n")).collect()}


def test_a_lost_rescan_leaves_the_old_rows(spark, tmp_path):
    path, first = str(tmp_path / "t"), rows(spark, range(6), "old")
    assert versions.read(spark, path, first.schema).count() == 0
    versions.rescan(first, path, 4)
    old = seen(spark, path, first)
    assert old == {(f"s{s}", "old", 3) for s in range(6)}
    change = versions.prepare(rows(spark, [1, 2], "new", 2), path, 4)  # all its data is written; its writer is lost here
    assert seen(spark, path, first) == old
    committed = versions.commit(spark, change)
    want = {(f"s{s}", "old", 3) for s in (0, 3, 4, 5)} | {("s1", "new", 2), ("s2", "new", 2)}
    assert seen(spark, path, first) == want
    assert seen(spark, path, first, committed.number - 1) == old  # readers of the earlier manifest keep their rows


def test_a_manifest_that_was_cut_off_is_not_read(spark, tmp_path):
    path, first = str(tmp_path / "t"), rows(spark, range(3), "old")
    done = versions.rescan(first, path, 4)
    files, at = storage(spark, f"{path}/manifests/{done.number + 1:012d}")
    stream = files.create(at, False)
    stream.write(bytearray(b'{"0": "x'))
    stream.close()
    assert seen(spark, path, first) == {(f"s{s}", "old", 3) for s in range(3)}
    assert versions.rescan(rows(spark, [0], "new"), path, 4).number == done.number + 2
    assert ("s0", "new", 3) in seen(spark, path, first)


def test_two_writers(spark, tmp_path):
    path, first = str(tmp_path / "t"), rows(spark, range(12), "old")
    versions.rescan(first, path, 4)
    bucket = {r.scan_id: r.scan_bucket for r in versions.bucketed(first, 4).collect()}
    one = 0
    other = next(s for s in range(12) if bucket[f"s{s}"] != bucket["s0"])
    a, b, c = (versions.prepare(rows(spark, [s], run), path, 4) for s, run in ((one, "a"), (other, "b"), (one, "c")))
    versions.commit(spark, a)
    versions.commit(spark, b)  # other buckets: goes on top
    with pytest.raises(versions.Conflict):
        versions.commit(spark, c)
    now = seen(spark, path, first)
    assert ("s0", "a", 3) in now and (f"s{other}", "b", 3) in now and not any(run == "c" for _, run, _ in now) and len(now) == 12


def test_vacuum_keeps_what_is_named(spark, tmp_path):
    path, first = str(tmp_path / "t"), rows(spark, range(8), "old")
    versions.rescan(first, path, 4)
    versions.rescan(rows(spark, [1], "new"), path, 4)
    versions.prepare(rows(spark, [2], "lost"), path, 4)
    before = seen(spark, path, first)
    assert versions.vacuum(spark, path) >= 2 and seen(spark, path, first) == before
    assert versions.vacuum(spark, path) == 0
