from pyspark.sql import functions as F

from cipherledger.operators.inventory import first_of_key

ROWS = [("p", "A", [1], 2, "y"), ("p", "a", [1], 1, "x"), ("p", None, [1], 3, "z"), ("q", "a", [1], 1, "v"), ("q", "a", [1], 1, "u"), (None, "a", None, 9, None)]


def _table(spark):
    return spark.createDataFrame(ROWS, "path string, hint string, roles array<int>, ord int, id string")


def _key():
    return [F.col("path"), F.lower("hint"), F.col("roles")]


WANT = {("p", "a", 1, "x"), ("p", None, 3, "z"), ("q", "a", 1, "u"), (None, "a", 9, None)}


def test_first_row_of_each_key(spark):
    got = first_of_key(_table(spark), _key(), ["ord", "id"])
    assert got.columns == ["path", "hint", "roles", "ord", "id"]
    assert {(r.path, r.hint, r.ord, r.id) for r in got.collect()} == WANT


def test_columns_that_cannot_be_compared(spark):
    rows = _table(spark).withColumn("more", F.create_map(F.lit("k"), F.col("ord")))
    got = first_of_key(rows, _key(), ["ord", "id"]).collect()
    assert {(r.path, r.hint, r.ord, r.id) for r in got} == WANT and all(r.more["k"] == r.ord for r in got)


def test_columns_are_carried_once(spark):
    row = first_of_key(_table(spark), _key(), ["ord", "id"])._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[1]
    assert "min_by" not in row and "named_struct(path" not in row and "roles, roles" not in row


def test_only_what_differs_between_string_hits_is_aggregated(spark):
    from cipherledger.operators import detect_binary

    files = spark.createDataFrame([("a", b"\x7fELF AES_encrypt x aes_decrypt"), ("b", b"nothing"), ("a", b"AES_encrypt")], "path string, content binary")
    got = detect_binary.scan_strings(files)
    assert got.columns == ["path", "ord", "detector", "raw_signal", "roles", "algorithm_hint", "confidence", "source_type", "provenance"]
    rows = got.collect()
    assert len({(r.path, r.algorithm_hint) for r in rows}) == len(rows) > 0 and {r.path for r in rows} == {"a"}
    assert all(r.detector == "binary.string_scan" and set(r.provenance) == {"file_type", "file_size"} for r in rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate" in line and ("provenance" in line or "0.45" in line)]
