"""Queries: configuration, dependency, certificate, binary and image detection."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from cipherledger.functions import vocab
from cipherledger.operators import detect_binary as db
from cipherledger.operators import detect_certificates as dc
from cipherledger.operators import detect_config as cfg
from cipherledger.operators import detect_dependencies as dd
from cipherledger.operators import detect_images as di
from cipherledger.operators.normalize import expand_hints
from cipherledger.plans import fixtures as fx
from cipherledger.plans.registry import cte, query, sql
from cipherledger.plans.source_code import NL, line_table, pick, quoted, regexp

# --- configuration ---------------------------------------------------------------------
VALUES = "AES-256-GCM,SHA-512,RSA,ECDHE-RSA-AES256,TLSv1.3,plain,Blowfish,ml-kem,sha_1,x25519"
CONFIG = fx.Projection(
    "config_files",
    "documents",
    (
        "'repo/' || source || '/c' || doc_id || CASE doc_id % 2 WHEN 0 THEN '.yaml' ELSE '.properties' END AS path",
        f"text || {NL} || '# algorithm: AES' || {NL} || '  Cipher : ' || {pick(VALUES, 'doc_id')} || {NL} || 'tls.hash=' || {pick(VALUES, '(doc_id + 1)')} || {NL} || "
        f"'// mac: HMAC' || {NL} || 'other: ' || {pick(VALUES, '(doc_id + 2)')} || {NL} || 'key_type= ' || {pick(VALUES, '(doc_id + 3)')} || ' # RSA' || {NL} AS content",
    ),
).register()
cte("config_lines", line_table("config_files"), "config_files")


@query("d21_config_lines", sql(
    f"SELECT path, line, line_text AS raw_signal, trim(regexp_extract(line_text, '^[^=:]*', 0)) AS key_name, "
    f"regexp_extract(line_text, {regexp(vocab.CONFIG_VALUE)}, 0) AS algorithm_hint FROM config_lines WHERE line_text <> '' AND NOT starts_with(line_text, '#') "
    f"AND NOT starts_with(line_text, '//') AND regexp_matches(line_text, {regexp(vocab.CONFIG_KEY)}) AND regexp_matches(line_text, {regexp(vocab.CONFIG_VALUE)})",
    "config_lines"))
def d21(spark, d):
    return cfg.scan_config_text(CONFIG(spark, d)).select("path", "line", "raw_signal", "key_name", "algorithm_hint")


JSON = fx.Projection(
    "json_files",
    "events",
    (
        "event_id",
        "'conf/' || user_id || '/e' || event_id || '.json' AS path",
        "'{\"crypto\": {\"cipher\": \"AES-256-GCM\", \"k\": ' || props || ', \"note\": \"RSA\"},' || chr(10) || '\"rules\": [{\"hash\": \"SHA-256\"}, "
        "{\"deep\": [[{\"Key_Type\": \"' || CASE event_id % 3 WHEN 0 THEN 'RSA' WHEN 1 THEN 'none' ELSE 'ed25519' END || '\"}]]}], \"mac\": 5}' || "
        "CASE event_id % 10 WHEN 0 THEN '}' || chr(10) || 'mac: HMAC' || chr(10) || 'hash = sha1' ELSE '' END AS content",
    ),
).register()


@query("d22_config_json", (
    "SELECT path, raw_signal, key_name, algorithm_hint FROM (SELECT 'conf/' || user_id || '/e' || event_id || '.json' AS path, event_id % 10 = 0 AS broken, "
    "event_id % 3 AS v, props FROM events) e, (VALUES (0, 'crypto.cipher: AES-256-GCM', 'cipher', 'AES'), (1, 'rules[0].hash: SHA-256', 'hash', 'SHA-256'), "
    "(2, 'rules[1].deep[0][0].Key_Type: ', 'Key_Type', '')) h0(n, raw0, key_name, hint0), LATERAL (SELECT CASE WHEN n = 2 THEN raw0 || CASE v WHEN 0 THEN 'RSA' ELSE 'ed25519' END "
    "ELSE raw0 END AS raw_signal, CASE WHEN n = 2 THEN CASE v WHEN 0 THEN 'RSA' ELSE 'ed25519' END ELSE hint0 END AS algorithm_hint) WHERE NOT broken AND NOT (n = 2 AND v = 1) "))
def d22(spark, d):
    return cfg.scan_config_json(JSON(spark, d).drop("event_id")).filter("detector = 'config.json_scan'").select(
        "path", "raw_signal", "key_name", "algorithm_hint"
    )


@query("d22_invalid_json_as_text", sql(
    "SELECT path, count(*) AS findings FROM (SELECT path, unnest(string_split(content, chr(10))) AS t FROM json_files WHERE event_id % 10 = 0) "
    f"WHERE regexp_matches(t, {regexp(vocab.CONFIG_KEY)}) AND regexp_matches(t, {regexp(vocab.CONFIG_VALUE)}) GROUP BY path", "json_files"))
def d22b(spark, d):
    rows = cfg.scan_config_json(JSON(spark, d).drop("event_id")).filter("detector = 'config.text_scan'")
    return rows.groupBy("path").agg(F.count("*").alias("findings"))


# --- dependencies -----------------------------------------------------------------------
PACKAGES = (
    "cryptography,PyCryptodome,bcprov-jdk18on,rsa_utils,flask,openssl-dev,libssl1.1,django,ssl-x,python3-cryptography,paramiko,nss3,argon2_cffi,liboqs-python2"
)


def capability(names: str) -> str:
    """SQL text: package capability of each distinct name of a one-column query ``name``."""
    return (
        "SELECT name, pkg_key, algorithms, ecosystem FROM (SELECT DISTINCT name, replace(lower(trim(name)), '_', '-') AS key FROM "
        f"({names})) n JOIN packages p ON p.pkg_key = n.key OR starts_with(n.key, p.pkg_key) "
        "QUALIFY row_number() OVER (PARTITION BY name ORDER BY (p.pkg_key = n.key) DESC, pkg_rank) = 1"
    )


REQUIREMENTS = fx.Projection(
    "requirement_files",
    "documents",
    (
        "'repo/' || source || '/r' || doc_id || '/requirements.txt' AS path",
        f"text || {NL} || {pick(PACKAGES, 'doc_id')} || '[extra]>=' || (doc_id % 9) || '.0' || {NL} || '# rsa' || {NL} || '-r rsa.txt' || {NL} || {pick(PACKAGES, '(doc_id + 1)')} || {NL} || "
        f"'  ' || {pick(PACKAGES, '(doc_id + 2)')} || ' == 2.' || (doc_id % 5) || '  ' || {NL} || 'git+https://x/rsa' || {NL} || {pick(PACKAGES, '(doc_id + 3)')} || ' ; extra' || {NL} AS content",
    ),
).register()
cte("requirement_lines", line_table("requirement_files"), "requirement_files")
_REQ = regexp(vocab.REQUIREMENT_LINE)
cte(
    "requirement_rows",
    f"SELECT path, line, line_text AS raw_signal, regexp_extract(line_text, {_REQ}, 1) AS package_name, nullif(trim(regexp_extract(line_text, {_REQ}, 3)), '') AS version "
    f"FROM requirement_lines WHERE line_text <> '' AND NOT regexp_matches(line_text, {regexp(vocab.REQUIREMENT_SKIP)}) AND regexp_matches(line_text, {_REQ})",
    "requirement_lines",
)


@query("d23_requirements", sql("SELECT path, line, raw_signal, package_name, version FROM requirement_rows", "requirement_rows"))
def d23(spark, d):
    return dd.requirements(REQUIREMENTS(spark, d)).select("path", "line", "raw_signal", "package_name", "version")


cte("requirement_caps", capability("SELECT package_name AS name FROM requirement_rows"), "requirement_rows", "packages")


@query("d29_package_capability", sql(
    "SELECT path, line, package_name, array_to_string(algorithms, ',') AS algorithms, ecosystem FROM requirement_rows r JOIN requirement_caps c ON c.name = r.package_name",
    "requirement_rows", "requirement_caps"))
def d29(spark, d):
    found = dd.package_capabilities(dd.requirements(REQUIREMENTS(spark, d)))
    return found.select("path", "line", "package_name", F.array_join("algorithm_hints", ",").alias("algorithms"), "ecosystem")


@query("d30_expanded_hints", sql(
    "SELECT path, line, unnest(algorithms) AS algorithm_hint FROM requirement_rows r JOIN requirement_caps c ON c.name = r.package_name",
    "requirement_rows", "requirement_caps"))
def d30(spark, d):
    found = dd.capability_findings(dd.requirements(REQUIREMENTS(spark, d)))
    return expand_hints(found).select("path", "line", "algorithm_hint")


_NAMES = fx.Projection(
    "package_rows", "lineitem", ("l_partkey", f"{pick(PACKAGES, 'l_partkey')} || CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN '-' || (l_suppkey % 7) ELSE '_x' END AS name")
).register()


@query("j2_package_prefix_join", sql(
    f"SELECT r.name, pkg_key, count(*) AS n FROM package_rows r JOIN ({capability('SELECT name FROM package_rows')}) c ON c.name = r.name GROUP BY ALL",
    "package_rows", "packages"))
def j2(spark, d):
    rows = _NAMES(spark, d).withColumn("pkg_key", dd.package_key(F.col("name"))).filter("pkg_key IS NOT NULL")
    return rows.groupBy("name", "pkg_key").agg(F.count("*").alias("n"))


@query("w3_first_match", sql(
    f"SELECT name, ecosystem FROM ({capability('SELECT name FROM package_rows')})", "package_rows", "packages"))
def w3(spark, d):
    names = _NAMES(spark, d).select("name").distinct()
    return dd.package_capabilities(names, "name").select("name", "ecosystem")


_P = [f"{pick(PACKAGES, f'(p_partkey + {i})')}" for i in range(4)]
PYPROJECT = fx.Projection(
    "pyproject_files",
    "part",
    (
        "'m' || p_partkey || '/pyproject.toml' AS path",
        f"'[tool.poetry]' || {NL} || 'name = \"' || p_name || '\"' || {NL} || '[tool.poetry.dependencies]' || {NL} || 'python = \"^3.9\"' || {NL} || {_P[0]} || ' = \"^' || p_size || '\"' || {NL} || "
        f"{_P[1]} || ' = {{version = \"2.' || p_size || '\", extras = [\"x\"]}}' || {NL} || {NL} || '[tool.poetry.dev-dependencies]' || {NL} || {_P[0]} || ' = \"dev\"' || {NL} || {_P[2]} || ' = true' || {NL} || "
        f"'[project]' || {NL} || 'name = \"x\"' || {NL} || 'dependencies = [' || {NL} || '  \"' || {_P[3]} || '[all]>=' || p_size || '\", # c' || {NL} || '  \"' || {_P[2]} || '\",' || {NL} || ']' || {NL} || '[tool.x]' || {NL} || 'rsa = \"1\"' AS content",
    ),
).register()


@query("d24_pyproject", (
    "SELECT 'm' || p_partkey || '/pyproject.toml' AS path, unnest(['python', "
    + ", ".join(_P[i] for i in (0, 1, 3, 2)) + "]) AS package_name, unnest(['^3.9', 'dev', '2.' || p_size, '>=' || p_size, '']) AS version FROM part"))
def d24(spark, d):
    return dd.pyproject(PYPROJECT(spark, d)).select("path", "package_name", "version")


LOCK = fx.Projection(
    "lock_files",
    "part",
    (
        "'m' || p_partkey || '/poetry.lock' AS path",
        f"'# lock of ' || p_name || {NL} || '[[package]]' || {NL} || 'name = \"' || {_P[0]} || '\"' || {NL} || 'version = \"1.' || p_size || '\"' || {NL} || {NL} || '[[package]]' || {NL} || "
        f"'name = \"' || {_P[1]} || '\"' || {NL} || 'optional = false' || {NL} || '[[package]]' || {NL} || 'version = \"3\"' || {NL} || 'name = ' || {_P[2]} AS content",
    ),
).register()


@query("d25_lock_stanzas", (
    "SELECT 'm' || p_partkey || '/poetry.lock' AS path, unnest([6, 9, 0]) AS line, "
    + f"unnest([{_P[0]}, {_P[1]}, {_P[2]}]) AS package_name, unnest(['1.' || p_size, NULL, '3']) AS version, "
    + f"unnest(['[[package]] name = ' || {_P[0]}, '[[package]] name = ' || {_P[1]}, 'name = ' || {_P[2]}]) AS raw_signal FROM part"))
def d25(spark, d):
    return dd.poetry_lock(LOCK(spark, d)).select("path", "line", "package_name", "version", "raw_signal")


POM = fx.Projection(
    "pom_files",
    "part",
    (
        "'m' || p_partkey || '/pom.xml' AS path",
        f"'<project><artifactId>own</artifactId>' || {NL} || '<version>0.1</version>' || {NL} || '<properties>' || {NL} || '<a.v>9.' || p_size || '</a.v>' || {NL} || '<b.v>' || chr(36) || '{{a.v}}</b.v>' || {NL} || "
        f"'<lib>' || {_P[0]} || '</lib>' || {NL} || '<lib>' || {_P[1]} || '</lib>' || {NL} || '<name>' || p_name || '</name>' || {NL} || '</properties>' || {NL} || '<artifactId>' || chr(36) || '{{lib}}</artifactId>' || {NL} || "
        f"'<version>' || chr(36) || '{{b.v}}</version>' || {NL} || '<artifactId> ' || {_P[2]} || ' </artifactId>' || {NL} || '<version>' || chr(36) || '{{no.v}}</version>' || {NL} || '<artifactId>' || {_P[3]} || '</artifactId>' AS content",
    ),
).register()


@query("d26_pom", (
    "SELECT 'm' || p_partkey || '/pom.xml' AS path, unnest([1, 10, 12, 14]) AS line, "
    f"unnest(['own', {_P[1]}, {_P[2]}, {_P[3]}]) AS package_name, unnest(['0.1', '9.' || p_size, '${{no.v}}', NULL]) AS version FROM part"))
def d26(spark, d):
    return dd.pom(POM(spark, d)).select("path", "line", "package_name", "version")


GRADLE = fx.Projection(
    "gradle_files",
    "documents",
    (
        "'repo/' || source || '/g' || doc_id || '/build.gradle' AS path",
        f"text || {NL} || 'dependencies {{' || {NL} || '  implementation \"org.bouncycastle:' || {pick(PACKAGES, 'doc_id')} || ':1.' || (doc_id % 8) || '\"' || {NL} || "
        f"'  testImplementation ''' || {pick(PACKAGES, '(doc_id + 5)')} || ':2''' || {NL} || '  shadow \"a:b:c\"' || {NL} || '}}' AS content".replace("{{", "{").replace("}}", "}"),
    ),
).register()
cte("gradle_lines", line_table("gradle_files"), "gradle_files")
_GR = regexp(vocab.GRADLE_DEPENDENCY)


@query("d27_gradle", sql(
    f"SELECT path, line, line_text AS raw_signal, regexp_extract(line_text, {_GR}, 1) AS package_name, regexp_extract(line_text, {_GR}, 2) AS version "
    f"FROM gradle_lines WHERE regexp_matches(line_text, {_GR})", "gradle_lines"))
def d27(spark, d):
    return dd.gradle(GRADLE(spark, d)).select("path", "line", "raw_signal", "package_name", "version")


NPM = fx.Projection(
    "npm_files",
    "part",
    (
        "'m' || p_partkey || '/package.json' AS path",
        f"'{{\"name\": \"' || p_name || '\", \"dependencies\": {{\"' || {_P[0]} || '\": \"^' || p_size || '\", \"' || {_P[1]} || '\": \"1\"}}, "
        f"\"devDependencies\": {{\"' || {_P[1]} || '\": \"2.' || p_size || '\"}}}}' AS content",
    ),
).register()


@query("d28_package_json", (
    f"SELECT 'm' || p_partkey || '/package.json' AS path, unnest([{_P[0]}, {_P[1]}]) AS package_name, unnest(['^' || p_size, '2.' || p_size]) AS version FROM part"))
def d28(spark, d):
    return dd.package_json(NPM(spark, d)).select("path", "package_name", "version")


# --- certificates ------------------------------------------------------------------------
KEYS = fx.Projection(
    "key_files",
    "documents",
    (
        "'repo/' || source || '/k' || doc_id || '.pem' AS path",
        f"text || {NL} || CASE doc_id % 4 WHEN 0 THEN '-----BEGIN RSA PRIVATE KEY-----' || {NL} || 'MIIE' || {NL} || '-----BEGIN EC PRIVATE KEY-----' WHEN 1 THEN '-----BEGIN CERTIFICATE-----' || {NL} || 'PRIVATE KEY' "
        f"WHEN 2 THEN ' -----BEGIN PRIVATE KEY-----' || {NL} || '-----BEGIN PRIVATE KEY-----' ELSE 'nothing' END || {NL} AS content",
    ),
).register()


@query("d31_private_key_markers", (
    "SELECT 'repo/' || source || '/k' || doc_id || '.pem' AS path, CASE doc_id % 4 WHEN 0 THEN 'RSA PRIVATE KEY' ELSE 'PRIVATE KEY' END AS key_type_hint "
    "FROM documents WHERE doc_id % 4 IN (0, 2)"))
def d31(spark, d):
    return dc.private_key_markers(KEYS(spark, d)).select("path", "key_type_hint")


CERTS = fx.Projection(
    "certificate_facts",
    "orders",
    (
        "'certs/' || o_orderkey || '.pem' AS path",
        "'CN=host-' || o_custkey || ',O=' || o_orderpriority AS subject",
        "o_orderkey * 7919 AS serial",
        "CAST(o_orderdate AS DATE) AS not_before",
        "CAST(o_orderdate AS DATE) + CAST(o_custkey % 900 AS INT) AS not_after",
        "CASE o_orderkey % 6 WHEN 0 THEN 'RSA' WHEN 1 THEN 'EC' WHEN 2 THEN 'Ed25519' WHEN 3 THEN 'Ed448' WHEN 4 THEN 'X25519' ELSE 'Unknown' END AS key_type",
        "CAST(CASE o_orderkey % 6 WHEN 0 THEN 2048 + 1024 * (o_custkey % 2) WHEN 1 THEN 256 END AS INT) AS key_size",
        "CASE o_orderkey % 6 WHEN 1 THEN 'secp256r1' END AS curve",
        "CASE o_custkey % 3 WHEN 0 THEN 'sha256' WHEN 1 THEN 'sha384' END AS hash_name",
        "'1.2.3.' || (o_orderkey % 6) AS signature_oid",
        "o_custkey % 5 = 0 AS is_ca",
        "o_custkey",
    ),
).register()
_SIGNATURE = (
    "CASE key_type WHEN 'RSA' THEN 'RSA-with-' || coalesce(upper(hash_name), 'Unknown') WHEN 'EC' THEN 'ECDSA-with-' || coalesce(upper(hash_name), 'Unknown') "
    "WHEN 'Ed25519' THEN 'Ed25519' WHEN 'Ed448' THEN 'Ed448' ELSE signature_oid END"
)


def _certificates(spark, d):
    kind = F.when(F.col("o_custkey") % 4 == 0, "dns").when(F.col("o_custkey") % 4 == 1, "ip").when(F.col("o_custkey") % 4 == 2, "uri").otherwise("other")
    name = lambda k, v: F.struct(k.alias("kind"), v.alias("value"))
    names = F.array(name(kind, F.concat(F.lit("h"), F.col("o_custkey"))), name(F.lit("email"), F.concat(F.lit("a@"), F.col("o_custkey"))))
    facts = CERTS(spark, d).withColumn("names", names).drop("o_custkey")
    return dc.scan_certificates(facts, F.to_date(F.lit("1999-01-01")))


@query("d32_certificate_facts", sql(
    "SELECT path, DATE '1999-01-01' > not_after AS is_expired, CASE WHEN DATE '1999-01-01' > not_after THEN NULL ELSE date_diff('day', DATE '1999-01-01', not_after)::INT END AS days_to_expiry, "
    "CASE o_custkey % 4 WHEN 0 THEN 'DNS:h' || o_custkey || ',' WHEN 1 THEN 'IP:h' || o_custkey || ',' WHEN 2 THEN 'URI:h' || o_custkey || ',' ELSE '' END || 'email:a@' || o_custkey AS names, "
    "CASE key_type WHEN 'Ed25519' THEN '256' WHEN 'Ed448' THEN '448' WHEN 'X25519' THEN '255' WHEN 'RSA' THEN key_size::VARCHAR WHEN 'EC' THEN '256' END AS key_size, "
    f"CASE WHEN key_type = 'EC' THEN 'secp256r1' END AS curve, is_ca, 'cert: ' || subject || ' | key=' || key_type || ' | sig=' || {_SIGNATURE} AS raw_signal, "
    "printf('%X', serial) AS serial_number FROM certificate_facts", "certificate_facts"))
def d32(spark, d):
    at = lambda k: F.try_element_at("key_params", F.lit(k)).alias(k)
    return _certificates(spark, d).select(
        "path", "is_expired", "days_to_expiry", F.array_join("alternative_names", ",").alias("names"), at("key_size"), at("curve"), "is_ca",
        "raw_signal", "serial_number",
    )


@query("d33_certificate_hint", sql(
    f"SELECT path, {_SIGNATURE} AS signature_algorithm, CASE WHEN key_type = 'EC' THEN 'ECDSA' WHEN key_type = 'RSA' THEN 'RSA' ELSE key_type END AS algorithm_hint, "
    "0.95::DOUBLE AS confidence FROM certificate_facts", "certificate_facts"))
def d33(spark, d):
    return _certificates(spark, d).select("path", "signature_algorithm", "algorithm_hint", "confidence")


# --- binaries ------------------------------------------------------------------------------
MAGIC = "7F454C46,4D5A9000,FEEDFACE,CFFAEDFE,CAFEBABE,5A4D0000,00010203"
SYMBOLS = "RSA_sign AES_encrypt,EVP_EncryptInit X25519,OQS_KEM_encaps ML-KEM-768,SHA-256 sha512 SHA512_Init,chacha20_poly1305_seal,Hmac_Update ECDSA_verify,pqcrystals_dilithium2 SPHINCS,nothing here"
_BIN = (
    "'bin/' || p_partkey AS path",
    f"{pick(MAGIC, 'p_partkey')} AS head",
    f"p_name || ' ' || {pick(SYMBOLS, 'p_partkey')} || ' ' || {pick(SYMBOLS, '(p_partkey + 3)')} || ' ' || p_brand AS body",
)
BINARY = fx.Projection("binary_rows", "part", _BIN).register()


def _binaries(spark, d):
    content = F.concat(F.unhex("head"), F.lit(b"\x00\xff"), F.encode("body", "US-ASCII"))
    return BINARY(spark, d).select("path", content.alias("content"))


@query("d34_file_type", sql(
    "SELECT path, CASE WHEN head = '7F454C46' THEN 'ELF' WHEN left(head, 4) IN ('4D5A', '5A4D') THEN 'PE' WHEN head IN ('FEEDFACE', 'CFFAEDFE') THEN 'Mach-O' "
    "WHEN head = 'CAFEBABE' THEN 'Mach-O-fat' ELSE 'unknown' END AS file_type FROM binary_rows", "binary_rows"))
def d34(spark, d):
    return _binaries(spark, d).select("path", db.file_type(F.col("content")).alias("file_type"))


def symbol_algorithm(column: str) -> str:
    whens = " ".join(
        f"WHEN {' OR '.join(f'''contains(lower({column}), {quoted(n)})''' for n in needles)} THEN {quoted(value)}" for needles, value in vocab.SYMBOL_ALGORITHMS
    )
    return f"CASE {whens} ELSE {column} END"


cte(
    "string_hits",
    " UNION ALL ".join(
        f"SELECT path, {i} AS p, signal, {symbol_algorithm('signal')} AS algorithm_hint FROM (SELECT path, unnest(list_distinct(regexp_extract_all(body, {regexp('(?i)' + p)}))) AS signal FROM binary_rows)"
        for i, p in enumerate(vocab.BINARY_SYMBOLS + vocab.BINARY_STRINGS)
    ),
    "binary_rows",
)


@query("d35_string_scan", sql("SELECT path, signal, algorithm_hint FROM string_hits", "string_hits"))
def d35(spark, d):
    return db.string_matches(_binaries(spark, d)).select("path", "signal", "algorithm_hint")


_SYMBOL_ROWS = fx.Projection(
    "symbol_rows",
    "lineitem",
    (
        "'bin/' || l_partkey AS path",
        "l_orderkey || '_' || l_linenumber || '_' || split_part('RSA_sign,aes_decrypt_x,EVP_PKEY_keygen,my_curve25519,OQS_SIG_sign,printf,mldsa_keygen,HMAC_Init,EC_KEY_generate_key,SHA256_Final', ',', "
        "CAST(l_suppkey % 10 + 1 AS INT)) AS symbol",
    ),
).register()


@query("d36_symbol_algorithm", sql(f"SELECT path, symbol, {symbol_algorithm('symbol')} AS algorithm FROM symbol_rows", "symbol_rows"))
def d36(spark, d):
    return _SYMBOL_ROWS(spark, d).select("path", "symbol", db.algorithm_of_symbol(F.col("symbol")).alias("algorithm"))


LIBRARIES = "libssl.so.3,/usr/lib/libcrypto.so,LIBSODIUM.dll,libc.so.6,bcrypt.dll,liboqs.so,libgcrypt-20.so,libbotan-3.so,libmbedtls_x,xlibssl.so"
_LIBRARY_ROWS = fx.Projection("library_rows", "lineitem", ("'bin/' || l_partkey AS path", f"{pick(LIBRARIES, 'l_suppkey')} AS library")).register()


@query("d37_imported_libraries", sql(
    "SELECT path, lower(library) AS raw_signal, CASE WHEN contains(lower(library), 'ssl') OR contains(lower(library), 'crypto') THEN 'TLS' "
    "WHEN contains(lower(library), 'sodium') THEN 'X25519' WHEN contains(lower(library), 'gcrypt') THEN 'AES' WHEN contains(lower(library), 'oqs') THEN 'PQC-OQS' "
    "WHEN contains(lower(library), 'botan') THEN 'AES' ELSE 'Unknown' END AS algorithm_hint FROM library_rows WHERE "
    + " OR ".join(f"starts_with(lower(string_split(library, '/')[-1]), '{n}')" for n in vocab.CRYPTO_LIBRARIES), "library_rows"))
def d37(spark, d):
    return db.scan_libraries(_LIBRARY_ROWS(spark, d)).select("path", "raw_signal", "algorithm_hint")


@query("d38_symbols", sql(
    f"SELECT path, symbol, {symbol_algorithm('symbol')} AS algorithm_hint FROM symbol_rows WHERE regexp_matches(symbol, {regexp(db.ANY_SYMBOL)})", "symbol_rows"))
def d38(spark, d):
    return db.scan_symbols(_SYMBOL_ROWS(spark, d)).select("path", "symbol", "algorithm_hint")


@query("d39_binary_deduplicated", sql(
    "SELECT path, algorithm_hint, min(p) >= 15 AS from_text FROM string_hits GROUP BY path, algorithm_hint", "string_hits"))
def d39(spark, d):
    rows = db.scan_strings(_binaries(spark, d))
    symbol = F.rlike("raw_signal", F.lit(f"^(?:{db.ANY_SYMBOL})$"))
    return rows.select("path", "algorithm_hint", (~symbol).alias("from_text"))


# --- images --------------------------------------------------------------------------------
DPKG = fx.Projection(
    "dpkg_files",
    "documents",
    (
        "'var/lib/dpkg/status.d/' || doc_id AS path",
        f"'Package: ' || {pick(PACKAGES, 'doc_id')} || {NL} || 'Status: ok' || {NL} || 'Version: 1.' || doc_id || {NL} || {NL} || text || {NL} || ' ' || {NL} || "
        f"'Version: 9' || {NL} || 'Package: ' || {pick(PACKAGES, '(doc_id + 1)')} || {NL} || {NL} || {NL} || 'Package: ' || {pick(PACKAGES, '(doc_id + 2)')} || {NL} || 'Version: 3' AS content",
    ),
).register()
cte(
    "dpkg_rows",
    f"SELECT 'var/lib/dpkg/status.d/' || doc_id AS path, unnest([{pick(PACKAGES, 'doc_id')}, {pick(PACKAGES, '(doc_id + 1)')}]) AS package_name, unnest(['1.' || doc_id, NULL]) AS version FROM documents",
)


@query("d40_package_database", sql(
    "SELECT path, package_name, version, package_name || ' ' || coalesce(version, '') AS raw_signal, ecosystem FROM dpkg_rows r JOIN "
    f"({capability('SELECT package_name AS name FROM dpkg_rows')}) c ON c.name = r.package_name", "dpkg_rows", "packages"))
def d40(spark, d):
    return di.scan_package_database(DPKG(spark, d)).select("path", "package_name", "version", "raw_signal", "ecosystem")


_PKG_LINES = fx.Projection(
    "package_lines",
    "part",
    (
        "p_partkey",
        "CASE p_partkey % 5 WHEN 0 THEN 'Package:  ' || p_name || ' ' WHEN 1 THEN ' ' || replace(p_name, ' ', '-') || ':amd64  3.' || p_size || ' amd64' WHEN 2 THEN '# ' || p_name "
        "WHEN 3 THEN replace(p_name, ' ', '_') ELSE ' ' END AS line",
    ),
).register()


@query("d41_package_line", (
    "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '-') WHEN 3 THEN replace(p_name, ' ', '_') END AS name, "
    "CASE p_partkey % 5 WHEN 1 THEN '3.' || p_size END AS version FROM part"))
def d41(spark, d):
    parsed = di.package_line(F.col("line"))
    return _PKG_LINES(spark, d).select("p_partkey", parsed["name"].alias("name"), parsed["version"].alias("version"))


BUILD = fx.Projection(
    "build_files",
    "documents",
    (
        "'repo/' || source || '/d' || doc_id || '/Dockerfile' AS path",
        f"'# FROM none' || {NL} || 'from  image-' || (doc_id % 9) || ':1 AS x' || {NL} || text || {NL} || 'RUN apt install ' || {pick('openssl-dev,libssl1.1,gnutls,mybouncycastle,OpenSSL openssl liboqs,cryptography==3', 'doc_id')} || {NL} || "
        f"'EXPOSE ' || {pick('443/tcp 80,22,8443 22/tcp 9,8080', 'doc_id')} || {NL} AS content",
    ),
).register()
cte("build_lines", line_table("build_files"), "build_files")
cte("live_lines", "SELECT * FROM build_lines WHERE line_text <> '' AND NOT starts_with(line_text, '#')", "build_lines")


def _build_rows(spark, d, detector: str):
    return di.scan_build_files(BUILD(spark, d)).filter(F.col("detector") == detector)


@query("d42_base_image", sql(
    "SELECT path, line, string_split_regex(line_text, '\\s+')[2] AS package_name FROM live_lines WHERE starts_with(upper(line_text), 'FROM ') AND len(string_split_regex(line_text, '\\s+')) >= 2", "live_lines"))
def d42(spark, d):
    return _build_rows(spark, d, "container.dockerfile_base_image").select("path", "line", "package_name")


@query("d43_image_packages", sql(
    "SELECT path, line, pkg AS package_name, pkg || ' installed in Dockerfile (line ' || line || '): ' || line_text AS raw_signal, 0 AS hints FROM live_lines, (VALUES "
    + ", ".join(f"({quoted(p)}, {regexp(rf'(?i)\b{re.escape(p)}(-dev|-devel|[0-9._-]*)?\b')})" for p in vocab.IMAGE_FILE_PACKAGES)
    + ") v(pkg, pattern) WHERE regexp_matches(line_text, pattern)", "live_lines"))
def d43(spark, d):
    return _build_rows(spark, d, "container.dockerfile_package").select("path", "line", "package_name", "raw_signal", F.size("algorithm_hints").alias("hints"))


@query("d44_exposed_ports", sql(
    "SELECT path, line, 'EXPOSE ' || port || CASE WHEN split_part(port, '/', 1) = '22' THEN ' (SSH protocol listener)' ELSE ' (TLS/HTTPS protocol listener)' END AS raw_signal, "
    "CASE WHEN split_part(port, '/', 1) = '22' THEN 'SSH' ELSE 'TLS' END AS algorithm_hint FROM (SELECT path, line, unnest(string_split_regex(trim(substr(line_text, 8)), '\\s+')) AS port "
    "FROM live_lines WHERE starts_with(upper(line_text), 'EXPOSE ')) WHERE split_part(port, '/', 1) IN ('443', '8443', '22')", "live_lines"))
def d44(spark, d):
    rows = _build_rows(spark, d, "container.dockerfile_protocol")
    return rows.select("path", "line", "raw_signal", F.get("algorithm_hints", F.lit(0)).alias("algorithm_hint"))


MEMBER_NAMES = "./var/lib/dpkg/status,etc/ssl/ca.PEM,usr/bin/tool,app/main.py,lib/apk/db/installed,usr/lib/libssl.so,a.der,doc.md"
_MEMBERS = fx.Projection("image_members", "part", ("p_partkey", f"{pick(MEMBER_NAMES, 'p_partkey')} AS name", f"{pick(MAGIC, 'p_partkey')} AS head")).register()


@query("d45_member_class", sql(
    "SELECT p_partkey, CASE WHEN contains(lower(name), 'var/lib/dpkg/status') OR contains(lower(name), 'lib/apk/db/installed') THEN 'manifest' "
    "WHEN regexp_matches(lower(name), '\\.(pem|crt|cer|der)$') THEN 'certificate' WHEN NOT regexp_matches(lower(name), '\\.(py|md)$') AND head IN ('7F454C46', 'FEEDFACE', 'CEFAEDFE') THEN 'binary' END AS member_class "
    "FROM image_members", "image_members"))
def d45(spark, d):
    return _MEMBERS(spark, d).select("p_partkey", di.member_class(F.col("name"), F.unhex("head")).alias("member_class"))
