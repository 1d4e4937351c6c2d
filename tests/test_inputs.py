import pytest

from cipherledger.operators import runs

GOOD = ["1", " -2.5e3 \n", "null", "true", '"a ] } , b"', "{}", "[]", '{"a": [1, {"b": null}]}', "[null, 1]"]
BAD = ["", " ", "4754543480058766 Ieein", "1 2", "1, 2", "1]", "1] [2", "1}", '1} {"w":2', '1, "w": 2', "1] x", "null,", "{} {}", '{"a": 1', "[1,]", "x", '"a" "b"']


def test_json_is_one_value_and_nothing_after_it(spark):
    rows = spark.createDataFrame([(t, bytearray(t.encode()), "d.json") for t in GOOD + BAD], "text string, content binary, path string")
    got = {r.text: r.error_code for r in runs.input_errors(rows).collect()}
    assert {t for t in GOOD if got[t]} == set()
    assert {t for t in BAD if got[t] != "E-2003"} == set()


@pytest.mark.parametrize("path, code", [("d.json", "E-2003"), ("d.txt", None)])
def test_number_before_prose(spark, path, code):
    row = spark.createDataFrame([(path, bytearray(b"4754543480058766 Ieein"))], "path string, content binary")
    assert runs.input_errors(row).first().error_code == code
