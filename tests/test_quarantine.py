"""Accepted and rejected rows together are the input; a bad file gives an error row and harms no other."""

from pyspark.sql import functions as F

from cipherledger.operators.scan import discover, discover_run
from cipherledger.sources import archives, quarantine

FILES = [
    ("s", "ok.py", b"import hashlib\n", None), ("s", "../up.py", b"import hashlib\n", "unsafe_path"), ("s", "build/x.py", b"import rsa\n", "excluded_folder"),
    ("s", "notes.txt", b"AES", "no_detector"), ("s", "gone.py", None, "no_content"), ("s", "long.py", b"x" * 200, "too_large"), ("s", "long.pem", b"x" * 200, None),
    ("s", "bytes.py", b"\xc3\x28", "not_text"), ("s", None, b"x", "unsafe_path"), ("s", "bad.py", b"import hashlib\ndef broken(\n", None),
    ("s", "bad.json", b"{ broken\nmac = HMAC\n", None), ("s", "ok.json", b'{"cipher": "AES"}', None), ("s", "plain.py", b"def broken(\n", None),
]


def frame(spark, rows):
    return spark.createDataFrame([(a, b, None if c is None else bytearray(c)) for a, b, c, _ in rows], "scan_id string, path string, content binary").repartition(3)


def test_every_file_is_accepted_or_rejected(spark, tmp_path):
    landing = quarantine.land(frame(spark, FILES), str(tmp_path), {"python_source": 100})
    accepted = {(r.path, bytes(r.content, "utf-8")) for r in landing.accepted.collect()}
    rejected = {(r.path, r.reason) for r in landing.rejected.collect()}
    assert accepted == {(p, c) for _, p, c, why in FILES if why is None}
    assert rejected == {(p, why) for _, p, _, why in FILES if why}
    assert landing.accepted.count() + landing.rejected.count() == len(FILES)
    codes = {r.reason: r.error_code for r in landing.rejected.collect()}
    assert codes["unsafe_path"] == "E-1003" and codes["too_large"] == "E-1002" and codes["no_detector"] is None


def test_a_bad_file_gives_an_error_row(spark, tmp_path):
    landing = quarantine.land(frame(spark, FILES), str(tmp_path), {"python_source": 100})
    run = discover_run(landing)
    plain = lambda df: sorted((r.file_path, r.line, r.detector, r.algorithm_hint) for r in df.collect())
    assert plain(run.findings) == plain(discover(landing.accepted))
    assert {r.file_path for r in run.findings.collect()} == {"ok.py", "ok.json", "bad.json"}
    failed = {(r.path, r.reason) for r in run.errors.filter("error_code = 'E-2003'").collect()}
    # a file without any fact is never parsed
    assert failed == {("bad.py", "python.ast.error"), ("bad.json", "config.json_error")}


def test_no_files(spark, tmp_path):
    landing = quarantine.land(frame(spark, FILES).filter("scan_id = 'x'"), str(tmp_path))
    assert landing.accepted.count() == landing.rejected.count() == discover_run(landing).errors.count() == 0


def test_members_are_admitted_or_rejected(spark):
    rows = [("a", i, name, size, False, "file") for i, (name, size) in enumerate([("x", 5), ("/y", 1), ("z", 99), ("u", 6), ("v", 1), ("w", 1)], 1)]
    members = spark.createDataFrame(rows, "archive string, ordinal int, name string, size long, is_dir boolean, kind string")
    limits = {"members": 5, "single": 50, "total": 10}
    judged = {r.name: (r.reason, r.error_code) for r in archives.judge_archive_members(members, limits).collect()}
    assert judged == {
        "x": (None, None), "/y": ("unsafe_path", "E-1003"), "z": ("too_large", "E-1002"), "u": ("total_size", "E-1002"), "v": ("total_size", "E-1002"),
        "w": ("member_count", "E-1002"),
    }
    image = archives.judge_image_members(members, limits)
    assert image.count() == 6 and {r.name for r in image.filter(F.col("reason").isNull()).collect()} == {"x"}
