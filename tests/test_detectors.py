"""Detectors on small sources: positives, aliases, negative controls, broken input."""

from cipherledger.operators import detect_config, detect_dependencies, detect_images, detect_java
from cipherledger.operators.detect_python import scan_python


def files(spark, *rows):
    return spark.createDataFrame([(f"f{i}" if isinstance(r, str) else r[0], r if isinstance(r, str) else r[1]) for i, r in enumerate(rows)], "path string, content string")


def found(df, *cols):
    return {tuple(r[c] if not isinstance(r[c], list) else tuple(r[c]) for c in cols) for r in df.collect()}


def python(spark, source):
    return found(scan_python(files(spark, source)), "line", "detector", "algorithm_hint", "roles")


def test_import_is_capability_only(spark):
    assert python(spark, "import jwt\n") == {(1, "python.ast.import", "jwt", ("capability",))}


def test_alias_call_is_resolved(spark):
    rows = python(spark, "import hashlib as h\nx = h.sha256(b'1')\n")
    assert (2, "python.ast.call", "sha256", ("implementation", "usage")) in rows


def test_alias_without_token_is_unknown_implementation(spark):
    rows = python(spark, "from Crypto.Cipher import AES as crypto_aes\nc = crypto_aes.new(key, 2)\n")
    assert (1, "python.ast.import_from", "AES", ("implementation",)) in rows
    assert (2, "python.ast.call", "UNKNOWN", ("implementation",)) in rows


def test_comments_strings_and_other_names_stay_silent(spark):
    source = '"""uses AES and hashlib.md5()"""\n# import hashlib; rsa.sign()\ntitle = "the RSA talk"\ndef aes_helper(x):\n    return x\n'
    assert python(spark, source) == set()


def test_hash_sign_inside_string_is_no_comment(spark):
    rows = python(spark, 'import hashlib\nx = f("#"); y = hashlib.md5(b"#")\n')
    assert (2, "python.ast.call", "md5", ("implementation", "usage")) in rows


def test_empty_and_broken_files(spark):
    assert python(spark, "") == set()
    assert python(spark, "import hashlib\ndef broken(\n") == set()


def test_nested_calls_and_keywords(spark):
    rows = python(spark, "import jwt\nt = jwt.encode(f(g(1), '(') , k, algorithm='ES256')\n")
    assert (2, "python.ast.call", "ES256", ("implementation", "usage")) in rows


def test_one_bad_file_does_not_hide_others(spark):
    df = scan_python(files(spark, "def (", "import hashlib\n"))
    assert found(df, "path", "algorithm_hint") == {("f1", "hashlib")}


def test_large_file(spark):
    source = "import hashlib\n" + "x = 1\n" * 20000 + "h = hashlib.sha512(b'')\n"
    assert (20002, "python.ast.call", "sha512", ("implementation", "usage")) in python(spark, source)


def test_java_rules(spark):
    source = (
        "import javax.crypto.Cipher;\nimport java.security.interfaces.ECPublicKey;\nclass A {\n"
        ' Object a = Cipher\n   .getInstance("AES/GCM/NoPadding");\n Signature.getInstance("SHA256withRSA");\n new RSAEngine();\n}\n'
    )
    rows = found(detect_java.scan_java(files(spark, source)), "line", "algorithm_hint", "roles", "confidence")
    assert rows == {
        (1, "Cipher", ("capability",), 0.5), (2, "ECDSA", ("implementation",), 0.6),
        (4, "AES/GCM/NoPadding", ("implementation", "usage"), 0.9), (7, "RSAEngine", ("implementation", "usage"), 0.75),
    }


def test_java_duplicates_on_one_line(spark):
    source = 'x = Cipher.getInstance("AES"); y = Cipher.getInstance("aes");\n'
    assert len(found(detect_java.scan_java(files(spark, source)), "line", "algorithm_hint")) == 1


def test_config_text_and_json(spark):
    df = detect_config.scan_config(
        files(spark, ("a.yaml", "# cipher: AES\nhash: SHA-256\nname: RSA\n"), ("b.json", '{"a": [{"cipher": "AES"}], "note": "RSA"}'), ("c.json", "{ broken\nmac = HMAC\n"))
    )
    assert found(df, "path", "line", "algorithm_hint") == {("a.yaml", 2, "SHA-256"), ("b.json", 0, "AES"), ("c.json", 2, "HMAC")}


def test_manifests_by_file_name(spark):
    df = detect_dependencies.scan_dependencies(
        files(spark, ("x/requirements.txt", "rsa==4\nflask\n"), ("x/other.txt", "rsa==4\n"), ("y/pom.xml", "<p.v>1</p.v>\n<artifactId>bcprov-jdk18on</artifactId>\n<version>${p.v}</version>"))
    )
    rows = found(df, "path", "package_name", "version", "roles")
    assert rows == {("x/requirements.txt", "rsa", "==4", ("capability",)), ("y/pom.xml", "bcprov-jdk18on", "1", ("capability",))}


def test_last_stanza_without_blank_line_is_lost(spark):
    df = detect_images.package_stanzas(files(spark, "Package: openssl\nVersion: 3\n\nPackage: rsa\nVersion: 1\n"))
    assert found(df, "package_name", "version") == {("openssl", "3")}


def test_build_file_never_shows_usage(spark):
    df = detect_images.scan_build_files(files(spark, "FROM debian:12\nRUN apt install openssl-dev\nEXPOSE 443/tcp 22\n"))
    roles = {r for (rs,) in found(df, "roles") for r in rs}
    assert roles == {"capability", "configuration"}


def test_deep_brackets_and_several_statements(spark):
    deep = "hashlib.sha256(" + "f(" * 60 + "1" + ")" * 60 + ")"
    source = f'import hashlib\na = {deep}\nalgo = other = "RS256"\nalgorithm = "ES256"; z = 1\nCIPHERS = [["aes256-ctr"], "rsa",\n  "x", "md5"]\nh = hashlib.new("""md5""")\n'
    source += 'REG = {"ES384": {"k": 1, "l": [2, 3]}, "zz": 1}\n"""h = hashlib.md5()"""\n'
    rows = found(scan_python(files(spark, source)), "line", "detector", "algorithm_hint", "raw_signal")
    assert {(a, b, c) for a, b, c, _ in rows} == {
        (1, "python.ast.import", "hashlib"), (2, "python.ast.call", "sha256"), (3, "python.ast.assignment", "RS256"),
        (4, "python.ast.assignment", "ES256"), (5, "python.ast.assignment", "rsa"), (6, "python.ast.assignment", "md5"),
        (7, "python.ast.call", "md5"), (8, "python.ast.registry", "ES384"),
    }
    assert any(s.endswith(")" * 61) for _, _, c, s in rows if c == "sha256")
    assert ('ES384: {"k": 1, "l": [2, 3]}') in {s for *_, s in rows}


def test_time_grows_with_the_size_of_a_file(spark):
    import time

    def seconds(n):
        df = files(spark, "import hashlib\n" + "".join(f"h{i} = hashlib.sha256(b'{i}', g({i}))\n" for i in range(n)))
        start = time.time()
        assert scan_python(df, check_syntax=False).filter("detector = 'python.ast.call'").count() == n
        return time.time() - start

    seconds(1000)
    assert seconds(60000) < 20 * max(seconds(6000), 1.0)


def test_java_time_grows_with_the_size_of_a_file(spark):
    text = "".join(f'Cipher c{i} = Cipher.getInstance("AES/GCM/NoPadding");\n' for i in range(30000))
    assert detect_java.raw_java(files(spark, text)).count() == 30000


def test_brackets_by_depth(spark):
    from pyspark.sql import functions as F

    from cipherledger.functions.brackets import split_top_level

    texts = ['a, f(b, [c, ","]), "x,(y", d', "", "one", "a,,b", "(a,b),{c:d,e:f}", "ü, g('ñ,', 1), z", "a, (b"]
    want = [["a", ' f(b, [c, ","])', ' "x,(y"', " d"], [""], ["one"], ["a", "", "b"], ["(a,b)", "{c:d,e:f}"], ["ü", " g('ñ,', 1)", " z"], ["a", " (b"]]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", split_top_level(F.col("t")).alias("p")).orderBy("i").collect()
    assert [r["p"] for r in rows] == want


def test_python_calls_against_the_language(spark):
    """Generated code, compared with what the language's own parser says of calls of a known module."""
    import ast
    import random

    rng = random.Random(12)

    def expression(depth):
        kind = rng.randrange(7) if depth else rng.randrange(3)
        inner = lambda: expression(depth - 1)
        return [
            lambda: str(rng.randrange(9)), lambda: rng.choice(["'a(,'", '"]"', "'ü'", 'b")"']), lambda: "name",
            lambda: f"hashlib.{rng.choice(['sha256', 'md5', 'other'])}({inner()},\n   {inner()})", lambda: f"[{inner()}, {inner()}]",
            lambda: f"({inner()})", lambda: "{" + f"'k': {inner()}, 2: {inner()}" + "}",
        ][kind]()

    sources = ["import hashlib\n" + "".join(f"x{i} = {expression(5)}\nprint({expression(4)}); y = {expression(3)}\n" for i in range(12)) for _ in range(25)]
    want = set()
    for k, source in enumerate(sources):
        for node in ast.walk(ast.parse(source)):
            if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
                inside = "".join(ast.get_source_segment(source, node).split("(", 1)[1:])[:-1]
                want.add((f"f{k}", node.lineno, f"hashlib.{node.func.attr}({inside})"))
    got = found(scan_python(files(spark, *sources)).filter("detector = 'python.ast.call'"), "path", "line", "raw_signal")
    assert got == want
