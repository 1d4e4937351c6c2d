"""Queries: Python and Java source detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from cipherledger.functions import vocab
from cipherledger.functions.tables import values_sql
from cipherledger.operators import detect_java as dj
from cipherledger.operators import detect_python as dp
from cipherledger.plans import fixtures as fx
from cipherledger.plans.registry import cte, query, sql


def pick(names: str, index: str, n: int | None = None) -> str:
    """SQL text: the (index mod n)-th of comma-separated names."""
    n = n or names.count(",") + 1
    return f"split_part('{names}', ',', CAST({index} % {n} + 1 AS INT))"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def regexp(pattern: str) -> str:
    """Pattern for the oracle's engine as a literal."""
    return quoted(pattern)


def line_table(source: str, key: str = "path") -> str:
    """SQL text: one row per trimmed line of a files table."""
    return (
        f"SELECT {key}, trim(t, ' ' || chr(9)) AS line_text, line FROM (SELECT {key}, unnest(l) AS t, generate_subscripts(l, 1) AS line "
        f"FROM (SELECT {key}, string_split(content, chr(10)) AS l FROM {source}))"
    )


def occurrence_table(source: str, pattern: str, groups: dict[str, int], key: str = "path") -> str:
    """SQL text: one row per match with its start line, groups, and the trimmed source line."""
    p = regexp(pattern)
    nl = "lambda x: len(x) - len(replace(x, chr(10), ''))"
    extra = ", ".join(f"regexp_extract_all(content, {p}, {g}) AS {n}_all" for n, g in groups.items())
    picked = ", ".join(f"{n}_all[i] AS {n}" for n in groups)
    return (
        f"SELECT {key}, i, line, trim(string_split(content, chr(10))[line], ' ' || chr(9)) AS snippet, {', '.join(groups)} FROM ("
        f"SELECT {key}, content, i, {picked}, CAST(1 + list_sum(list_transform(b[1:i], {nl})) + coalesce(list_sum(list_transform(m[1:i - 1], {nl})), 0) AS INT) AS line "
        f"FROM (SELECT {key}, content, unnest(range(1, len(m) + 1)) AS i, m, b, {', '.join(n + '_all' for n in groups)} FROM ("
        f"SELECT {key}, content, regexp_extract_all(content, {p}, 0) AS m, string_split_regex(content, {p}) AS b, {extra} FROM {source})))"
    )


# --- Java ----------------------------------------------------------------------------
NL = "chr(10)"
JAVA_IMPORTS = (
    "javax.crypto.Cipher,java.security.interfaces.RSAPublicKey,java.security.*,org.bouncycastle.crypto.AES,"
    "javax.crypto.spec.GCMParameterSpec,com.google.crypto.tink.Aead,org.apache.commons.codec.digest.HMAC,java.util.List"
)
JAVA_NAMES = "AES/GCM/NoPadding,SHA-256,SHA256withRSA,HmacSHA256,RSA,X25519,ChaCha20,DES/CBC"
JAVA_CLASSES = "Cipher,MessageDigest,Signature,Mac,KeyFactory,keyagreement"
JAVA_ENGINES = "AESEngine,RSAKeyGenerationParameters,SHA256Digest,Blake2bDigest,MLKEMKeyPairGenerator,EcdsaSigner,Poly1305"
JAVA_PQC = "ML-KEM-768,kyber512,X25519MLKEM768,SLH-DSA,dilithium,ML-DSA,RSA"
JAVA = fx.Projection(
    "java_files",
    "documents",
    (
        "'repo/' || source || '/J' || doc_id || '.java' AS path",
        f"text || {NL} || 'import ' || {pick(JAVA_IMPORTS, 'doc_id')} || ';' || {NL} || 'import  ' || {pick(JAVA_IMPORTS, '(doc_id + 3)')} || ';' || {NL} || "
        f"'  Object c = ' || {pick(JAVA_CLASSES, 'doc_id')} || CASE doc_id % 3 WHEN 0 THEN {NL} || '    ' ELSE '' END || '.getInstance(\"' || {pick(JAVA_NAMES, 'doc_id')} || '\");' || {NL} || "
        f"'  Mac.getInstance( \"' || {pick(JAVA_NAMES, '(doc_id + 1)')} || '\" ); Mac.getInstance(\"' || {pick(JAVA_NAMES, '(doc_id + 1)')} || '\");' || {NL} || "
        f"'  new ' || {pick(JAVA_ENGINES, 'doc_id')} || '(k); KeyPairGenerator.initialize(' || (1024 * (doc_id % 4 + 1)) || '); s = \"' || {pick(JAVA_PQC, 'doc_id')} || '\";' || {NL} AS content",
    ),
).register()
_GENERIC = ", ".join(f"'{c}'" for c in vocab.JAVA_GENERIC_CLASSES)
_TOK = regexp(vocab.JAVA_ALGORITHM_TOKEN)
for _rule, _, _pattern, _g, _c, _ in dj.RULES:
    cte(f"java_{_rule}", occurrence_table("java_files", _pattern, {"name": _g, "cls": _c}), "java_files")
cte(
    "java_raw",
    f"""
SELECT path, 1 AS r, i, line, snippet, 'java.rule.import' AS detector, name,
  CASE WHEN token <> '' THEN token WHEN simple = '*' OR lower(simple) IN ({_GENERIC}) THEN simple ELSE coalesce(a.canonical, simple) END AS hint,
  CASE WHEN token = '' AND (simple = '*' OR lower(simple) IN ({_GENERIC})) THEN 'capability' ELSE 'implementation' END AS roles,
  CASE WHEN token = '' AND (simple = '*' OR lower(simple) IN ({_GENERIC})) THEN 0.50 ELSE 0.60 END AS confidence
FROM (SELECT *, regexp_extract(replace(name, '.', ' '), {_TOK}, 1) AS token, string_split(name, '.')[-1] AS simple FROM java_import) m
LEFT JOIN aliases a ON a.alias_key = translate(lower(m.simple), ' _', '--')
UNION ALL SELECT path, 2, i, line, snippet, 'java.rule.getinstance', name, name, 'implementation,usage', 0.90 FROM java_getinstance
  WHERE regexp_matches(name, {_TOK}) OR contains(name, '/')
UNION ALL SELECT path, 3, i, line, snippet, 'java.rule.keygen_init', name, 'KeySize-' || name, 'implementation,usage', 0.70 FROM java_key_size
UNION ALL SELECT path, 4, i, line, snippet, 'java.rule.engine_instantiation', name,
  coalesce(nullif(regexp_extract(name, {_TOK}, 1), ''), a.canonical, name), 'implementation,usage', 0.75
  FROM java_engine m LEFT JOIN aliases a ON a.alias_key = translate(lower(m.name), ' _', '--')
UNION ALL SELECT path, 5, i, line, snippet, 'java.rule.pqc_string', name, name, 'implementation,usage', 0.80 FROM java_pqc""",
    "java_import", "java_getinstance", "java_key_size", "java_engine", "java_pqc", "aliases",
)


def _java_oracle(detector: str) -> str:
    return sql(
        f"SELECT path, line, snippet AS raw_signal, hint AS algorithm_hint, roles, confidence::DOUBLE AS confidence FROM java_raw WHERE detector = '{detector}'",
        "java_raw",
    )


def _java_rule(detector: str):
    def plan(spark, d):
        rows = dj.raw_java(JAVA(spark, d)).filter(F.col("detector") == detector)
        return rows.select("path", "line", "raw_signal", "algorithm_hint", F.array_join("roles", ",").alias("roles"), "confidence")

    return plan


for _name, _detector in [
    ("d14_java_import", "java.rule.import"), ("d15_java_get_instance", "java.rule.getinstance"), ("d16_java_key_size", "java.rule.keygen_init"),
    ("d17_java_engine", "java.rule.engine_instantiation"), ("d18_java_pqc_string", "java.rule.pqc_string"),
]:
    query(_name, _java_oracle(_detector))(_java_rule(_detector))


@query("d19_match_lines", sql("SELECT path, i, line, snippet FROM java_getinstance", "java_getinstance"))
def d19(spark, d):
    from cipherledger.functions.text import line_at, match_lines, text_lines

    rows = JAVA(spark, d).select(
        "path", text_lines(F.col("content")).alias("l"), F.posexplode(match_lines(F.col("content"), vocab.JAVA_GET_INSTANCE)).alias("i", "line")
    )
    return rows.select("path", (F.col("i") + 1).alias("i"), "line", line_at(F.col("l"), F.col("line")).alias("snippet"))


@query("d20_java_deduplicated", sql(
    "SELECT path, line, detector, hint AS algorithm_hint, roles FROM java_raw "
    "QUALIFY row_number() OVER (PARTITION BY path, line, lower(hint), roles ORDER BY r, i) = 1", "java_raw"))
def d20(spark, d):
    return dj.scan_java(JAVA(spark, d)).select("path", "line", "detector", "algorithm_hint", F.array_join("roles", ",").alias("roles"))


# --- Python --------------------------------------------------------------------------
# Nine kinds of files; the whole document stands in front as a raw doc string.
VARIANTS = [
    'import hashlib, os  # import hmac\nfrom Crypto.Cipher import AES as CA\nh = hashlib.sha256(b"x").hexdigest()\nc = CA.new(key, CA.MODE_GCM)',
    'import hmac as hm\nm = hm.new(key, msg,\n    hashlib.sha512)\nALGORITHM = "RS256"\nh = hm.digest(k, d, "md5")',
    'import jwt, ssl.x as sx\nt = jwt.encode(p, key, algorithm="HS256", algorithms=["RS512", "x"])\nREGISTRY = {"ES384": f, "zz": 2}\nu = other.encode("sha1")',
    'from cryptography.hazmat.primitives.asymmetric import rsa\nk = rsa.generate_private_key(public_exponent=65537, key_size=2048)\nD = hashes.SHA384\nx = "AES"',
    'from cryptography.hazmat.primitives.asymmetric.ed25519 import (\n    Key,\n    Other as O,\n)\nCIPHERS = [\n    "aes256-ctr",\n    "rsa", "zz",\n]\nk = O.generate()',
    'from jwt.algorithms import RSAAlgorithm\nE = RSAAlgorithm(1)\nname = "use aes here"\nalgo_name = "use aes here"\nh2: str = hashlib.sha1',
    '# import hashlib; hashlib.md5()\ntext = "plain"\nnote = "hash of x"  # AES\nvalues = ("a", "b")',
    'import hashlib\nh = hashlib.md5()\ndef broken(',
    'import hashlib\na = hashlib.sha256(f(g(h(i(j(1))))))\nalgo = other = "RS256"\nalgorithm = "ES256"; z = 1\nCIPHERS = [["aes256-ctr"], "rsa"]\n'
    'h = hashlib.new("""md5""")\nREG = {"ES384": {"k": 1, "l": [2, 3]}, "zz": 1}',
]
_I, _IU, _C, _IC = "implementation", "implementation,usage", "configuration", "implementation,configuration"
# variant, line after the doc string, detector, hint, roles, confidence
EXPECTED = [
    (0, 1, "python.ast.import", "hashlib", "capability", 0.5), (0, 2, "python.ast.import_from", "AES", _I, 0.75),
    (0, 3, "python.ast.call", "sha256", _IU, 0.85), (0, 4, "python.ast.call", "UNKNOWN", _I, 0.65),
    (1, 1, "python.ast.import", "hmac", "capability", 0.5), (1, 2, "python.ast.call", "HMAC", _I, 0.85),
    (1, 2, "python.ast.call", "sha512", _IU, 0.85), (1, 4, "python.ast.assignment", "RS256", _C, 0.55),
    (1, 5, "python.ast.call", "HMAC", _I, 0.85), (1, 5, "python.ast.call", "md5", _IU, 0.85),
    (2, 1, "python.ast.import", "jwt", "capability", 0.5), (2, 1, "python.ast.import", "ssl", "capability", 0.5),
    (2, 2, "python.ast.call", "HS256", _IU, 0.85), (2, 2, "python.ast.call", "RS512", _IU, 0.85),
    (2, 3, "python.ast.registry", "ES384", _IC, 0.80),
    (3, 1, "python.ast.import_from", "rsa", _I, 0.75), (3, 2, "python.ast.call", "UNKNOWN", _I, 0.65),
    (3, 3, "python.ast.attribute", "SHA384", _I, 0.75), (3, 4, "python.ast.assignment", "AES", _C, 0.55),
    (4, 1, "python.ast.import_from", "ed25519", _I, 0.75), (4, 1, "python.ast.import_from", "ed25519", _I, 0.75),
    (4, 6, "python.ast.assignment", "aes256-ctr", _C, 0.55), (4, 7, "python.ast.assignment", "rsa", _C, 0.55),
    (4, 9, "python.ast.call", "UNKNOWN", _I, 0.65),
    (5, 2, "python.ast.call", "UNKNOWN", _I, 0.65), (5, 4, "python.ast.assignment", "aes", _C, 0.55),
    (5, 5, "python.ast.attribute", "sha1", _I, 0.75),
    (8, 1, "python.ast.import", "hashlib", "capability", 0.5), (8, 2, "python.ast.call", "sha256", _IU, 0.85),
    (8, 3, "python.ast.assignment", "RS256", _C, 0.55), (8, 3, "python.ast.assignment", "RS256", _C, 0.55),
    (8, 4, "python.ast.assignment", "ES256", _C, 0.55), (8, 5, "python.ast.assignment", "rsa", _C, 0.55),
    (8, 6, "python.ast.call", "md5", _IU, 0.85), (8, 7, "python.ast.registry", "ES384", _IC, 0.80),
]
_CODE = f"CASE doc_id % {len(VARIANTS)} " + " ".join(
    f"WHEN {i} THEN " + " || chr(10) || ".join(quoted(line) for line in v.split("\n")) for i, v in enumerate(VARIANTS)
) + " END"
PYTHON = fx.Projection(
    "python_files",
    "documents",
    (
        "'repo/' || source || '/p' || doc_id || '.py' AS path",
        "doc_id",
        f"'r''''''' || text || {NL} || '''''''' || {NL} || {_CODE} || {NL} AS content",
    ),
).register()
cte("py_expected", f"SELECT * FROM ({values_sql(EXPECTED)}) t(variant, rel, detector, hint, roles, confidence)")
cte(
    "py_findings",
    "SELECT 'repo/' || d.source || '/p' || d.doc_id || '.py' AS path, len(d.text) - len(replace(d.text, chr(10), '')) + 2 + e.rel AS line, "
    "e.detector, e.hint AS algorithm_hint, e.roles, e.confidence FROM documents d JOIN py_expected e ON e.variant = d.doc_id % " + str(len(VARIANTS)),
    "py_expected",
)
cte("py_lines", line_table("python_files"), "python_files")


def _python(spark, d):
    return dp.scan_python(PYTHON(spark, d).select("path", "content"))


def _shown(rows):
    return rows.select("path", "line", "algorithm_hint", F.array_join("roles", ",").alias("roles"), "confidence")


def _python_oracle(where: str) -> str:
    return sql(f"SELECT path, line, algorithm_hint, roles, confidence FROM py_findings WHERE {where}", "py_findings")


def _python_query(where: str):
    return lambda spark, d: _shown(_python(spark, d).withColumn("roles", F.col("roles")).filter(where))


for _name, _where in [
    ("d2_python_import", "detector = 'python.ast.import'"), ("d3_python_from_import", "detector = 'python.ast.import_from'"),
    ("d6_python_call", "detector = 'python.ast.call'"), ("d11_python_attribute", "detector = 'python.ast.attribute'"),
    ("d12_python_registry", "detector = 'python.ast.registry'"),
]:
    query(_name, _python_oracle(_where))(_python_query(_where))


@query("d9_python_string_constant", sql(
    "SELECT f.path, f.line, algorithm_hint, l.line_text AS raw_signal FROM py_findings f JOIN py_lines l ON l.path = f.path AND l.line = f.line "
    "WHERE detector = 'python.ast.assignment' AND contains(l.line_text, '=')", "py_findings", "py_lines"))
def d9(spark, d):
    rows = _python(spark, d).filter("detector = 'python.ast.assignment' AND contains(raw_signal, '=')")
    return rows.select("path", "line", "algorithm_hint", "raw_signal")


@query("d10_python_string_sequence", sql(
    "SELECT f.path, f.line, algorithm_hint, l.line_text AS raw_signal FROM py_findings f JOIN py_lines l ON l.path = f.path AND l.line = f.line "
    "WHERE detector = 'python.ast.assignment' AND NOT contains(l.line_text, '=')", "py_findings", "py_lines"))
def d10(spark, d):
    rows = _python(spark, d).filter("detector = 'python.ast.assignment' AND NOT contains(raw_signal, '=')")
    return rows.select("path", "line", "algorithm_hint", "raw_signal")


@query("d13_python_negative_controls", sql(
    "SELECT 'repo/' || d.source || '/p' || d.doc_id || '.py' AS path, count(e.variant) AS findings FROM documents d "
    "LEFT JOIN py_expected e ON e.variant = d.doc_id % " + str(len(VARIANTS)) + " GROUP BY 1", "py_expected"))
def d13(spark, d):
    counts = _python(spark, d).groupBy("path").agg(F.count("*").alias("n"))
    return PYTHON(spark, d).select("path").join(counts, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("findings"))


MODULES = "hashlib,hashlib.x,jwtx,Crypto.Cipher.AES,cryptographyx,os,nacl.public,rsa,Crypto,crypto,secrets.y.z"
_MODULE_ROWS = fx.Projection("modules", "part", ("p_partkey", f"{pick(MODULES, 'p_partkey')} AS module")).register()
cte("known_modules", f"SELECT * FROM ({values_sql([(m,) for m in vocab.CRYPTO_MODULES])}) t(k)")


@query("d1_crypto_module", sql(
    "SELECT p_partkey, module FROM modules m WHERE EXISTS (SELECT 1 FROM known_modules WHERE module = k OR starts_with(module, k || '.'))",
    "modules", "known_modules"))
def d1(spark, d):
    return _MODULE_ROWS(spark, d).filter(dp.is_crypto_module(F.col("module")))


TOKENS = (
    "AES-256-GCM,chacha20-poly1305,RSAAlgorithm,use sha256 here,SHA_512,ml-kem-768,mlkem1024,x ES256K y,des-ede3-cbc,hashing,SHA3-256,aes256-ctr,curve25519,RS2567"
)
_TOKEN_ROWS = fx.Projection("token_texts", "part", ("p_partkey", f"p_name || ' ' || {pick(TOKENS, 'p_partkey')} AS text")).register()


@query("d4_algorithm_token", sql(
    f"SELECT p_partkey, nullif(regexp_extract(text, {regexp(dp.TOKEN)}, 1), '') AS token FROM token_texts", "token_texts"))
def d4(spark, d):
    return _TOKEN_ROWS(spark, d).select("p_partkey", dp.algorithm_token(F.col("text")).alias("token"))


# call facts in table form: three imports and one call per file
_CALLS = fx.Projection(
    "call_rows",
    "part",
    (
        "p_partkey AS file_id",
        f"{pick('hashlib,hm,CA,k,jwt', 'p_partkey')} AS local",
        f"{pick('sha256,new,encode,other', 'p_partkey')} AS attr",
        "CAST(p_partkey % 3 + 1 AS INT) AS depth",
    ),
).register()
_IMPORTED = fx.Projection(
    "import_rows",
    "part",
    (
        "p_partkey AS file_id",
        f"{pick('hm,CA,jwt', 'p_partkey')} AS local",
        f"{pick('hmac,Crypto.Cipher.AES,jwt,os.path', 'p_partkey')} AS target",
        "1 AS line",
    ),
).register()
cte("resolved_calls", "SELECT c.*, coalesce(i.target, c.local) AS base FROM call_rows c LEFT JOIN import_rows i ON i.file_id = c.file_id AND i.local = c.local", "call_rows", "import_rows")


def _resolved(spark, d):
    return dp.resolve_facts(_CALLS(spark, d), _IMPORTED(spark, d), ["file_id"])


@query("j10_alias_resolution", sql("SELECT file_id, local, base FROM resolved_calls", "resolved_calls"))
def j10(spark, d):
    return _resolved(spark, d).select("file_id", "local", "base")


_KNOWN = "EXISTS (SELECT 1 FROM known_modules WHERE {0} = k OR starts_with({0}, k || '.'))"


@query("d5_crypto_call", sql(
    "SELECT file_id, base, attr, depth FROM resolved_calls c WHERE CASE depth WHEN 1 THEN "
    f"{_KNOWN.format('split_part(base, chr(46), 1)')} WHEN 2 THEN {_KNOWN.format('base')} ELSE attr IN ('new', 'encode') AND {_KNOWN.format('base')} END",
    "resolved_calls", "known_modules"))
def d5(spark, d):
    rows = _resolved(spark, d)
    return rows.filter(dp.is_crypto_call(F.col("attr"), F.col("depth"), F.col("base"))).select("file_id", "base", "attr", "depth")


ARGS = [
    ('p, key, algorithm="HS256"', "HS256"), ("key, msg, hashlib.sha512", "sha512"), ('"rsa", b"aes", x', "rsa"),
    ('mode=CA.MODE_GCM, name=hashes.SHA256()', "SHA256"), ('algorithms=["RS512", "x", "md5"]', "RS512,md5"),
    ('data, other="aes", f("sha1")', ""), ('cipher=algorithms.AES(key), scheme="PS256, x"', "AES,PS256"), ("a.b.sha1, hash_algorithm=hmac.new(k)", "sha1,HMAC"),
]
_ARG_ROWS = fx.Projection(
    "argument_rows", "part",
    ("p_partkey", "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN {quoted(a)}" for i, (a, _) in enumerate(ARGS)) + " END || ', ' || replace(p_name, ' ', '_') AS args"),
).register()


@query("d7_argument_hints", (
    "SELECT p_partkey, CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN {quoted(h)}" for i, (_, h) in enumerate(ARGS)) + " END AS hints FROM part"))
def d7(spark, d):
    return _ARG_ROWS(spark, d).select("p_partkey", F.array_join(dp.argument_hints(F.col("args")), ",").alias("hints"))


@query("d8_called_algorithm", sql(
    f"SELECT file_id, base, attr, depth, coalesce(nullif(regexp_extract(attr, {regexp(dp.TOKEN)}, 1), ''), CASE WHEN depth = 2 AND "
    "(base = 'hmac' OR starts_with(base, 'hmac.')) AND attr IN ('new', 'digest', 'HMAC') THEN 'HMAC' END) AS algorithm FROM resolved_calls", "resolved_calls"))
def d8(spark, d):
    return _resolved(spark, d).select(
        "file_id", "base", "attr", "depth", dp.called_algorithm(F.col("attr"), F.col("depth"), F.col("base")).alias("algorithm")
    )
