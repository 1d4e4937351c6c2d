"""Vocabularies, lookup tables, patterns and constants.

Everything in this module is data that must have exactly these values for
results to be right.  The engine itself lives in ``operators``.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# enumerations
# ---------------------------------------------------------------------------
EVIDENCE_ROLES = ["capability", "implementation", "usage", "configuration", "observed"]
CLAIM_STATES = ["supported", "ambiguous", "insufficient-context", "contradictory"]
SOURCE_TYPES = [
    "python_source", "java_source", "dependency", "certificate",
    "binary", "container", "config", "enterprise_map",
]
FAMILIES = [
    "symmetric_cipher", "hash", "mac", "kdf", "asymmetric_cipher", "key_agreement", "kem",
    "digital_signature", "random", "hybrid_kem", "hybrid_signature", "pqc_kem",
    "pqc_signature", "unknown",
]
QUANTUM_STATUSES = ["vulnerable", "safe", "hybrid", "conditionally_safe", "unknown"]
SCAN_MODES = ["live", "replay"]
SCAN_STATES = ["queued", "running", "completed", "completed_with_warnings", "failed"]
SCAN_STAGES = [
    "ingest", "discover", "normalize", "fuse", "graph", "risk", "migrate", "validate", "export",
]
NODE_TYPES = [
    "project", "service", "repository", "source_file", "library", "binary", "container",
    "algorithm", "certificate", "protocol", "data_asset", "kms", "hsm",
]
EDGE_TYPES = [
    "USES", "DEPENDS_ON", "IMPLEMENTS", "PROVIDES", "PROTECTS", "SIGNS", "ENCRYPTS",
    "NEGOTIATES", "DEPLOYED_ON", "ISSUED_BY", "STORED_IN", "CALLS",
]
PQC_STATUSES = ["final", "standards-track", "informational", "experimental"]
USAGE_ROLES = [
    "key_establishment", "key_encapsulation", "digital_signature", "authentication",
    "encryption", "decryption", "key_derivation", "hashing", "mac", "tls_kex", "ssh_kex",
    "certificate_signing", "random_generation", "unknown",
]
LIFECYCLES = ["active", "deprecated", "legacy", "fips_active", "historical", "unknown"]
ERROR_CODES = {
    "invalid_archive": "E-1001", "resource_limit": "E-1002", "path_traversal": "E-1003",
    "invalid_enterprise_map": "E-1004", "unsupported_input": "E-1005",
    "scanner_exception": "E-2001", "scanner_timeout": "E-2002", "parse_failure": "E-2003",
    "registry_failure": "E-3001", "config_failure": "E-3002", "fusion_unresolved": "E-4001",
    "graph_inconsistency": "E-4002", "missing_risk_context": "E-4003",
    "no_migration_candidate": "E-4004", "bom_validation_fail": "E-5001",
    "signing_failure": "E-5002", "replay_snapshot_missing": "E-6001",
    "db_unavailable": "E-9001", "queue_unavailable": "E-9002",
}
ROLE_STRENGTH = {
    "observed": 1, "capability": 2, "configuration": 3, "implementation": 4, "usage": 5,
}

# ---------------------------------------------------------------------------
# Algorithm names
# key | canonical | family | quantum status | variant | standard | lifecycle | note
# ---------------------------------------------------------------------------
_ALIASES = """
rsa|RSA|asymmetric_cipher|vulnerable
rsa-pkcs1|RSA|asymmetric_cipher|vulnerable
rsa-oaep|RSA-OAEP|asymmetric_cipher|vulnerable
rsa-pss|RSA-PSS|digital_signature|vulnerable
sha256withrsa|RSA|digital_signature|vulnerable
sha384withrsa|RSA|digital_signature|vulnerable
sha512withrsa|RSA|digital_signature|vulnerable
sha256withrsa/pss|RSA-PSS|digital_signature|vulnerable
rs256|RSA|digital_signature|vulnerable
rs384|RSA|digital_signature|vulnerable
rs512|RSA|digital_signature|vulnerable
ps256|RSA-PSS|digital_signature|vulnerable
ps384|RSA-PSS|digital_signature|vulnerable
ps512|RSA-PSS|digital_signature|vulnerable
ecdsa|ECDSA|digital_signature|vulnerable
ecdsawithsha256|ECDSA|digital_signature|vulnerable
ecdsawithsha384|ECDSA|digital_signature|vulnerable
ecdh|ECDH|key_agreement|vulnerable
p-256|ECDSA|digital_signature|vulnerable|P-256
p-384|ECDSA|digital_signature|vulnerable|P-384
secp256r1|ECDSA|digital_signature|vulnerable|secp256r1
secp384r1|ECDSA|digital_signature|vulnerable|secp384r1
es256|ECDSA|digital_signature|vulnerable|P-256
es256k|ECDSA|digital_signature|vulnerable|secp256k1
es384|ECDSA|digital_signature|vulnerable|P-384
es512|ECDSA|digital_signature|vulnerable|P-521
es521|ECDSA|digital_signature|vulnerable|P-521
x25519|X25519|key_agreement|vulnerable
curve25519|Curve25519|key_agreement|vulnerable
ed25519|Ed25519|digital_signature|vulnerable
eddsa|Ed25519|digital_signature|vulnerable
aes|AES|symmetric_cipher|conditionally_safe
aes-128-gcm|AES|symmetric_cipher|conditionally_safe|128-GCM
aes-256-gcm|AES|symmetric_cipher|safe|256-GCM
aes-192-gcm|AES|symmetric_cipher|conditionally_safe|192-GCM
aes128-gcm|AES|symmetric_cipher|conditionally_safe|128-GCM
aes192-gcm|AES|symmetric_cipher|conditionally_safe|192-GCM
aes256-gcm|AES|symmetric_cipher|safe|256-GCM
aes-128-cbc|AES|symmetric_cipher|conditionally_safe|128-CBC
aes-192-cbc|AES|symmetric_cipher|conditionally_safe|192-CBC
aes-256-cbc|AES|symmetric_cipher|safe|256-CBC
aes128-cbc|AES|symmetric_cipher|conditionally_safe|128-CBC
aes192-cbc|AES|symmetric_cipher|conditionally_safe|192-CBC
aes256-cbc|AES|symmetric_cipher|safe|256-CBC
aes-128-ctr|AES|symmetric_cipher|conditionally_safe|128-CTR
aes-192-ctr|AES|symmetric_cipher|conditionally_safe|192-CTR
aes-256-ctr|AES|symmetric_cipher|safe|256-CTR
aes128-ctr|AES|symmetric_cipher|conditionally_safe|128-CTR
aes192-ctr|AES|symmetric_cipher|conditionally_safe|192-CTR
aes256-ctr|AES|symmetric_cipher|safe|256-CTR
aes256|AES|symmetric_cipher|safe|256
aes128|AES|symmetric_cipher|conditionally_safe|128
3des|3DES|symmetric_cipher|vulnerable|||deprecated
tripledes|3DES|symmetric_cipher|vulnerable|||deprecated
3des-cbc|3DES|symmetric_cipher|vulnerable|CBC||deprecated
des-ede3|3DES|symmetric_cipher|vulnerable|||deprecated
des-ede3-cbc|3DES|symmetric_cipher|vulnerable|CBC||deprecated
chacha20-poly1305|ChaCha20-Poly1305|symmetric_cipher|safe
xchacha20-poly1305|XChaCha20-Poly1305|symmetric_cipher|safe
chacha20poly1305|ChaCha20-Poly1305|symmetric_cipher|safe
sha-224|SHA-224|hash|safe
sha224|SHA-224|hash|safe
sha-256|SHA-256|hash|safe
sha256|SHA-256|hash|safe
sha-384|SHA-384|hash|safe
sha384|SHA-384|hash|safe
sha-512|SHA-512|hash|safe
sha512|SHA-512|hash|safe
sha-1|SHA-1|hash|vulnerable|||deprecated
sha1|SHA-1|hash|vulnerable|||deprecated
md5|MD5|hash|vulnerable|||deprecated
sha3-224|SHA3-224|hash|safe
sha3-256|SHA3-256|hash|safe
sha3-384|SHA3-384|hash|safe
sha3-512|SHA3-512|hash|safe
shake128|SHAKE128|hash|safe
shake256|SHAKE256|hash|safe
blake2s|BLAKE2s|hash|safe
blake2b|BLAKE2b|hash|safe
hmac|HMAC|mac|safe
hmac-sha256|HMAC|mac|safe|SHA-256
hs256|HMAC|mac|safe|SHA-256
hs384|HMAC|mac|safe|SHA-384
hs512|HMAC|mac|safe|SHA-512
poly1305|Poly1305|mac|safe
hkdf|HKDF|kdf|safe
pbkdf2|PBKDF2|kdf|conditionally_safe
scrypt|scrypt|kdf|conditionally_safe
argon2|Argon2|kdf|conditionally_safe
ml-kem|ML-KEM|pqc_kem|safe||NIST FIPS 203
mlkem|ML-KEM|pqc_kem|safe||NIST FIPS 203
ml-kem-512|ML-KEM|pqc_kem|safe|512|NIST FIPS 203
ml-kem-768|ML-KEM|pqc_kem|safe|768|NIST FIPS 203
ml-kem-1024|ML-KEM|pqc_kem|safe|1024|NIST FIPS 203
mlkem512|ML-KEM|pqc_kem|safe|512|NIST FIPS 203
mlkem768|ML-KEM|pqc_kem|safe|768|NIST FIPS 203
mlkem1024|ML-KEM|pqc_kem|safe|1024|NIST FIPS 203
kyber|ML-KEM|pqc_kem|safe||||Kyber is ML-KEM draft name
ml-dsa|ML-DSA|pqc_signature|safe||NIST FIPS 204
mldsa|ML-DSA|pqc_signature|safe||NIST FIPS 204
ml-dsa-44|ML-DSA|pqc_signature|safe|44|NIST FIPS 204
ml-dsa-65|ML-DSA|pqc_signature|safe|65|NIST FIPS 204
ml-dsa-87|ML-DSA|pqc_signature|safe|87|NIST FIPS 204
mldsa44|ML-DSA|pqc_signature|safe|44|NIST FIPS 204
mldsa65|ML-DSA|pqc_signature|safe|65|NIST FIPS 204
mldsa87|ML-DSA|pqc_signature|safe|87|NIST FIPS 204
dilithium|ML-DSA|pqc_signature|safe||||Dilithium is ML-DSA draft name
slh-dsa|SLH-DSA|pqc_signature|safe||NIST FIPS 205
slhdsa|SLH-DSA|pqc_signature|safe||NIST FIPS 205
sphincs+|SLH-DSA|pqc_signature|safe||||SPHINCS+ is SLH-DSA draft name
ed448|Ed448|digital_signature|vulnerable
x448|X448|key_agreement|vulnerable
rsapublickey|RSA|asymmetric_cipher|vulnerable
rsaprivatekey|RSA|asymmetric_cipher|vulnerable
rsaprivatecrtkey|RSA|asymmetric_cipher|vulnerable
rsaprivatecrtkeyspec|RSA|asymmetric_cipher|vulnerable
rsamultiprimeprivatecrtkey|RSA|asymmetric_cipher|vulnerable
rsamultiprimeprivatecrtkeyspec|RSA|asymmetric_cipher|vulnerable
rsakey|RSA|asymmetric_cipher|vulnerable
rsapublickeyspec|RSA|asymmetric_cipher|vulnerable
rsaprivatekeyspec|RSA|asymmetric_cipher|vulnerable
rsakeygenparameterspec|RSA|asymmetric_cipher|vulnerable
rsasignaturealgorithm|RSA|digital_signature|vulnerable
rsaprivatejwkfactory|RSA|asymmetric_cipher|vulnerable
rsapublicjwkfactory|RSA|asymmetric_cipher|vulnerable
ecpublickey|ECDSA|digital_signature|vulnerable
ecprivatekey|ECDSA|digital_signature|vulnerable
eckey|ECDSA|digital_signature|vulnerable
ecpublickeyspec|ECDSA|digital_signature|vulnerable
ecprivatekeyspec|ECDSA|digital_signature|vulnerable
ecparameterspec|ECDSA|digital_signature|vulnerable
ecgenparameterspec|ECDSA|digital_signature|vulnerable
ecsignaturealgorithm|ECDSA|digital_signature|vulnerable
ecpublicjwkfactory|ECDSA|digital_signature|vulnerable
ecprivatejwkfactory|ECDSA|digital_signature|vulnerable
edecpublickey|Ed25519|digital_signature|vulnerable
edecprivatekey|Ed25519|digital_signature|vulnerable
edsignaturealgorithm|Ed25519|digital_signature|vulnerable
edwardscurve|Ed25519|digital_signature|vulnerable
xecpublickey|X25519|key_agreement|vulnerable
xecprivatekey|X25519|key_agreement|vulnerable
ecdhkeyalgorithm|ECDH|key_agreement|vulnerable
aeswrapkeyalgorithm|AES|symmetric_cipher|conditionally_safe|KW
aesgcmkeyalgorithm|AES|symmetric_cipher|conditionally_safe|GCM
aesalgorithm|AES|symmetric_cipher|conditionally_safe
gcmaesaeadalgorithm|AES|symmetric_cipher|conditionally_safe|GCM
hmacaesaeadalgorithm|AES|symmetric_cipher|conditionally_safe|CBC-HMAC
x25519mlkem768|X25519MLKEM768|hybrid_kem|hybrid||IETF RFC 10024
x25519mlkem768-sha256|X25519MLKEM768|hybrid_kem|hybrid||IETF RFC 10024
secp256r1mlkem768|SecP256r1MLKEM768|hybrid_kem|hybrid||IETF RFC 10024
secp384r1mlkem1024|SecP384r1MLKEM1024|hybrid_kem|hybrid||IETF RFC 10024
mlkem768x25519-sha256|mlkem768x25519-sha256|hybrid_kem|hybrid||IETF RFC 10042
sntrup761x25519-sha512|sntrup761x25519-sha512|hybrid_kem|hybrid
tls|TLS|unknown|unknown
ssl|SSL|unknown|vulnerable|||deprecated
"""

# ---------------------------------------------------------------------------
# Packages known to bring cryptography, in match order
# package | ecosystem | algorithms | lifecycle
# ---------------------------------------------------------------------------
_PACKAGES = """
cryptography|python|RSA,ECDSA,AES,ChaCha20-Poly1305,X25519,Ed25519
pycryptodome|python|RSA,ECDSA,AES,MD5,SHA-256
pycrypto|python|RSA,AES,MD5|deprecated
pyca|python|RSA,ECDSA,AES
rsa|python|RSA
ecdsa|python|ECDSA
pyotp|python|HMAC,SHA-1,SHA-256
paramiko|python|RSA,ECDSA,Ed25519,AES
pyopenssl|python|RSA,ECDSA,AES,TLS
ssl|python-stdlib|TLS
hashlib|python-stdlib|SHA-256,SHA-384,SHA-512,SHA-1,MD5,BLAKE2s,BLAKE2b
hmac|python-stdlib|HMAC
secrets|python-stdlib|RANDOM
pynacl|python|X25519,Ed25519,ChaCha20-Poly1305,BLAKE2b
liboqs-python|python|ML-KEM,ML-DSA,SLH-DSA
oqs|python|ML-KEM,ML-DSA,SLH-DSA
bcrypt|python|bcrypt
argon2-cffi|python|Argon2
jwcrypto|python|RSA,ECDSA,AES
authlib|python|RSA,ECDSA,Ed25519,AES
bouncy-castle|java|RSA,ECDSA,AES,ML-KEM,ML-DSA
bouncycastle|java|RSA,ECDSA,AES,ML-KEM,ML-DSA
bcprov-jdk|java|RSA,ECDSA,AES,ML-KEM,ML-DSA
bcprov|java|RSA,ECDSA,AES,ML-KEM,ML-DSA
bcpkix|java|RSA,ECDSA,AES,TLS
bcutil|java|RSA,ECDSA,AES
conscrypt|java|RSA,ECDSA,AES,TLS
amazon-corretto-crypto|java|RSA,ECDSA,AES,ML-KEM
tink|java|AES,ECDSA,Ed25519,HKDF
libssl|system|RSA,ECDSA,AES,TLS
libcrypto|system|RSA,ECDSA,AES,SHA-256
openssl|system|RSA,ECDSA,AES,SHA-256,TLS
libsodium|system|X25519,Ed25519,ChaCha20-Poly1305,BLAKE2b
libgcrypt|system|RSA,ECDSA,AES,SHA-256
nss|system|RSA,ECDSA,AES,TLS
mbedtls|system|RSA,ECDSA,AES,TLS
wolfssl|system|RSA,ECDSA,AES,TLS
liboqs|system|ML-KEM,ML-DSA,SLH-DSA
openssl-dev|system|RSA,ECDSA,AES,SHA-256
libssl-dev|system|RSA,ECDSA,AES,TLS
python3-cryptography|system|RSA,ECDSA,AES,TLS
"""


def _table(text: str, width: int) -> list[tuple]:
    rows = (line.split("|") for line in text.strip().splitlines())
    return [tuple((r + [""] * width)[:width]) for r in rows]


ALIAS_COLUMNS = [
    "alias_key", "canonical", "family", "quantum_status", "variant", "standard", "lifecycle", "note",
]
ALIAS_ROWS = _table(_ALIASES, 8)
PACKAGE_ROWS = [
    (i, p, eco, algos, lc) for i, (p, eco, algos, lc) in enumerate(_table(_PACKAGES, 4))
]
PACKAGE_COLUMNS = ["pkg_rank", "pkg_key", "ecosystem", "algorithms", "pkg_lifecycle"]

# ---------------------------------------------------------------------------
# Input selection
# ---------------------------------------------------------------------------
EXCLUDED_DIRS = [
    "__pycache__", ".git", "build", "dist", ".eggs", ".tox", "node_modules", ".pytest_cache", ".idea",
]
SOURCE_MAX_BYTES = 5_000_000
CONFIG_MAX_BYTES = 1_000_000
BINARY_MAX_BYTES = 256 * 1024 * 1024
CONFIG_EXTENSIONS = [".yaml", ".yml", ".json", ".properties", ".ini", ".conf", ".env", ".cfg"]
CERT_EXTENSIONS = [".pem", ".crt", ".cer", ".der", ".p12", ".pfx"]
BINARY_EXTENSIONS = [".elf", ".exe", ".dll", ".so", ".dylib", ".o", ".a", ".out", "", ".bin"]
ARCHIVE_MANIFEST_SUFFIXES = ["requirements.txt", "setup.cfg", "setup.py", "pyproject.toml", "pom.xml"]
ARCHIVE_CERT_EXTENSIONS = [".pem", ".crt", ".cer", ".der"]
ARCHIVE_CONFIG_EXTENSIONS = [".yml", ".yaml", ".json", ".conf", ".ini"]
IMAGE_TEXT_EXTENSIONS = [
    ".py", ".java", ".js", ".ts", ".rb", ".sh", ".txt", ".json", ".yaml", ".yml", ".md",
    ".html", ".css", ".xml", ".properties",
]
MANIFEST_PARSERS = [
    ("requirements.txt", "requirements"), ("requirements-dev.txt", "requirements"),
    ("requirements-test.txt", "requirements"), ("setup.cfg", "requirements"),
    ("pyproject.toml", "pyproject"), ("poetry.lock", "poetry_lock"), ("pom.xml", "pom"),
    ("build.gradle", "gradle"), ("build.gradle.kts", "gradle"),
    ("package.json", "package_json"), ("package-lock.json", "package_json"),
]
ARCHIVE_LIMITS = {"members": 5_000, "single": 10 * 1024 * 1024, "total": 100 * 1024 * 1024}
IMAGE_LIMITS = {"members": 10_000, "single": 256 * 1024 * 1024, "total": 1_073_741_824}

# ---------------------------------------------------------------------------
# Detection patterns
# ---------------------------------------------------------------------------
CRYPTO_MODULES = [
    "hashlib", "hmac", "ssl", "secrets",
    "cryptography", "cryptography.hazmat", "cryptography.hazmat.primitives",
    "cryptography.hazmat.primitives.asymmetric",
    "cryptography.hazmat.primitives.ciphers",
    "cryptography.hazmat.primitives.hashes",
    "cryptography.hazmat.primitives.kdf",
    "Crypto", "Crypto.Cipher", "Crypto.Hash", "Crypto.PublicKey",
    "Crypto.Signature", "Crypto.Random",
    "rsa", "ecdsa", "pynacl", "nacl", "oqs", "liboqs",
    "jwt", "authlib", "jwcrypto",
]
CHAINED_METHODS = [
    "encrypt", "decrypt", "sign", "verify", "new", "generate", "generate_private_key",
    "generate_parameters", "update", "finalize", "hexdigest", "digest", "compare_digest",
    "encapsulate", "decapsulate", "encode", "decode",
]
PY_ALGORITHM_TOKEN = (
    r"\b(aes|rsa|ecdsa|ecdh|ed25519|ed448|x25519|x448|curve25519|chacha20|"
    r"rs(?:256|384|512)|ps(?:256|384|512)|hs(?:256|384|512)|es(?:256k?|384|512|521)|eddsa|"
    r"sha[-_]?(?:224|256|384|512|1)|md5|hmac|pbkdf2|hkdf|scrypt|argon2|poly1305|blake2[sb]|"
    r"sha3[-_]?(?:224|256|384|512)|shake[-_]?(?:128|256)|"
    r"ml[-_]?kem(?:[-_]?\d+)?|ml[-_]?dsa(?:[-_]?\d+)?|slh[-_]?dsa|kyber|dilithium|sphincs|"
    r"aes[-_]?\d+[-_]?(?:gcm|cbc|ctr)|3des(?:[-_]?cbc)?|tripledes|des[-_]?ede3(?:[-_]?cbc)?)\b"
)
ARGUMENT_KEYWORDS = [
    "algorithm", "algo", "hash_algorithm", "name", "mode", "cipher", "scheme", "algorithms",
]
ASSIGN_KEYWORDS = ["algo", "algorithm", "cipher", "hash", "digest", "scheme", "method"]
SEQUENCE_KEYWORDS = ASSIGN_KEYWORDS + ["mac", "kex", "crypt"]

JAVA_IMPORT_PACKAGES = [
    r"javax\.crypto", r"java\.security", r"org\.bouncycastle",
    r"com\.google\.crypto\.tink", r"software\.amazon\.awscryptography", r"org\.apache\.commons\.codec",
]
JAVA_GET_INSTANCE = (
    r"(?i)(MessageDigest|Cipher|KeyPairGenerator|KeyGenerator|Signature|"
    r"Mac|KeyAgreement|SecretKeyFactory|AlgorithmParameters|KeyFactory|"
    r"TrustManagerFactory|SSLContext|SecureRandom)\s*\.\s*getInstance\s*\(\s*\"([^\"]+)\"\s*\)"
)
JAVA_KEY_SIZE = r"(?i)(KeyPairGenerator|KeyGenerator)\s*\.\s*initialize\s*\(\s*(\d+)"
JAVA_ENGINE = (
    r"(?i)new\s+((?:AES|RSA|ECDSA|ECDSASigner|SHA|Blake2|ChaCha20|"
    r"Poly1305|RSAKeyGenerationParameters|ECKeyGenerationParameters|"
    r"MLKEMKeyPairGenerator|MLDSAKeyPairGenerator)\w*)\s*\("
)
JAVA_PQC_STRING = (
    r"(?i)\"(ML-KEM(?:-\d+)?|ML-DSA(?:-\d+)?|SLH-DSA|"
    r"X25519MLKEM768|SecP256r1MLKEM768|SecP384r1MLKEM1024|"
    r"mlkem768|kyber(?:\d+)?|dilithium(?:\d+)?)\""
)
JAVA_ALGORITHM_TOKEN = (
    r"(?i)\b(AES|RSA|ECDSA|ECDH|Ed25519|Ed448|X25519|X448|ChaCha20|"
    r"SHA[-/]256|SHA[-/]384|SHA[-/]512|SHA[-/]1|MD5|HMAC|PBKDF2|HKDF|"
    r"ML[-_]?KEM|ML[-_]?DSA|SLH[-_]?DSA|kyber|dilithium|"
    r"AES/\w+/\w+|RSA/\w+/\w+)\b"
)
JAVA_GENERIC_CLASSES = [
    "key", "privatekey", "publickey", "secretkey", "provider", "securerandom",
    "security", "cipher", "signature", "mac", "messagedigest", "keyagreement",
    "keypair", "keypairgenerator", "keyfactory", "secretkeyfactory", "keygenerator",
    "algorithmparameters", "certificate", "certificatefactory", "certpath", "x509certificate",
    "keyspec", "secretkeyspec", "algorithmparameterspec", "ivparameterspec", "gcmparameterspec",
    "oaepparameterspec", "pssparameterspec", "pbekeyspec", "pkcs8encodedkeyspec",
    "x509encodedkeyspec", "ecfieldfp", "ecpoint", "ellipticcurve", "mgf1parameterspec", "psource",
    "rsaotherprimeinfo", "rsaotherprimeinfoconverter",
    "nosuchalgorithmexception", "nosuchpaddingexception",
    "invalidkeyexception", "invalidalgorithmparameterexception", "invalidkeyspecexception",
    "certificateexception", "certificateencodingexception",
]
CONFIG_KEY = (
    r"(?i)(?:algorithm|algo|cipher|hash|digest|signature|encryption|tls_cipher|"
    r"ssl_cipher|crypto|key_type|mac|key_algorithm|signature_algorithm|"
    r"asymmetric_key_type|symmetric_key|kdf|key_derivation)\s*[=:]"
)
CONFIG_VALUE = (
    r"(?i)\b(AES|RSA|ECDSA|ECDH|Ed25519|X25519|ChaCha20|"
    r"SHA[-_]?256|SHA[-_]?384|SHA[-_]?512|SHA[-_]?1|MD5|HMAC|PBKDF2|HKDF|"
    r"ML-KEM|ML-DSA|SLH-DSA|kyber|dilithium|"
    r"TLSv1\.[23]|AES[-/]\d+[-/](?:GCM|CBC|CTR|ECB)|"
    r"ECDHE-RSA-\S+|ECDHE-ECDSA-\S+)\b"
)
REQUIREMENT_LINE = r"^\s*([A-Za-z0-9_.\-]+)\s*(\[[^\]]*\])?\s*([><=!~].*)?\s*$"
REQUIREMENT_SKIP = r"^(#|-r|-c|http|git\+)"
MAVEN_ARTIFACT = r"<artifactId>\s*([A-Za-z0-9_.\-${}]+)\s*</artifactId>"
MAVEN_VERSION = r"<version>\s*([^<]+)\s*</version>"
MAVEN_PROPERTY = r"<(?<key>[A-Za-z0-9_.\-]+)>(?<val>[^<]+)</\k<key>>"
MAVEN_REFERENCE = r"\$\{([A-Za-z0-9_.\-]+)\}"
MAVEN_NOT_PROPERTIES = [
    "groupId", "artifactId", "version", "scope", "type", "packaging", "module", "name", "description",
]
GRADLE_DEPENDENCY = (
    r"(?:implementation|compile|testImplementation|api|runtimeOnly)\s+"
    r"[\"'](?:[\w.\-]+:)?([\w.\-]+):([^'\"]+)[\"']"
)
BINARY_SYMBOLS = [
    r"RSA_(?:sign|verify|public_encrypt|private_decrypt|generate_key)",
    r"EVP_(?:DigestSign|DigestVerify|Encrypt|Decrypt|PKEY_keygen)",
    r"EC_KEY_(?:generate_key|new_by_curve_name)",
    r"ECDSA_(?:sign|verify|do_sign)",
    r"AES_(?:encrypt|decrypt|set_encrypt_key|set_decrypt_key)",
    r"SHA256_(?:Init|Update|Final)",
    r"SHA512_(?:Init|Update|Final)",
    r"HMAC_(?:Init|Update|Final)",
    r"X25519|curve25519|ed25519_sign|ed25519_verify",
    r"chacha20_poly1305_(?:open|seal)",
    r"pqcrystals_(?:kyber|dilithium|sphincs)",
    r"OQS_KEM_(?:keypair|encaps|decaps)",
    r"OQS_SIG_(?:keypair|sign|verify)",
    r"mlkem_(?:keygen|encaps|decaps)",
    r"mldsa_(?:keygen|sign|verify)",
]
BINARY_STRINGS = [
    r"AES-(?:128|192|256)-(?:GCM|CBC|CTR|ECB|CFB|OFB)",
    r"SHA-?(?:1|224|256|384|512)",
    r"ECDSA|ECDH|Ed25519|X25519|Curve25519",
    r"ML-KEM|MLKEM|Kyber",
    r"ML-DSA|MLDSA|Dilithium",
    r"SLH-DSA|SPHINCS",
    r"ChaCha20|chacha20_poly1305",
]
# library name prefixes (text before the first dot of each known library file)
CRYPTO_LIBRARIES = [
    "libssl", "ssleay32", "libcrypto", "libeay32", "libsodium", "libgcrypt", "liboqs",
    "libmbedcrypto", "libmbedtls", "libwolfssl", "libwolfcrypt", "bcrypt", "ncrypt", "crypt32",
    "libbotan", "libbotan-3",
]
# magic bytes (hex) -> file type
BINARY_MAGIC = [
    ("7F454C46", "ELF"), ("4D5A", "PE"), ("5A4D", "PE"),
    ("FEEDFACE", "Mach-O"), ("CEFAEDFE", "Mach-O"), ("FEEDFACF", "Mach-O"), ("CFFAEDFE", "Mach-O"),
    ("CAFEBABE", "Mach-O-fat"),
]
# needles -> algorithm, first hit wins
SYMBOL_ALGORITHMS = [
    (["aes"], "AES"), (["rsa"], "RSA"), (["ecdsa", "ecdh"], "ECDSA"),
    (["ed25519", "x25519", "curve25519"], "X25519"), (["sha256"], "SHA-256"),
    (["sha512"], "SHA-512"), (["hmac"], "HMAC"), (["chacha20", "poly1305"], "ChaCha20-Poly1305"),
    (["kyber", "mlkem", "ml-kem"], "ML-KEM"), (["dilithium", "mldsa", "ml-dsa"], "ML-DSA"),
    (["sphincs", "slh-dsa"], "SLH-DSA"), (["oqs"], "PQC-OQS"),
]
LIBRARY_ALGORITHMS = [
    (["ssl", "crypto"], "TLS"), (["sodium"], "X25519"), (["gcrypt"], "AES"),
    (["oqs"], "PQC-OQS"), (["botan"], "AES"),
]
IMAGE_FILE_PACKAGES = [
    "openssl", "libssl", "liboqs", "gnutls", "mbedtls", "cryptography", "bouncycastle",
]
TLS_PORTS = ["443", "8443"]
SSH_PORTS = ["22"]

# ---------------------------------------------------------------------------
# fusion
# ---------------------------------------------------------------------------
UNRESOLVED_DETECTORS = [
    "python.ast.call", "python.ast.import_from", "python.ast.attribute", "python.ast.registry",
    "java.rule.import", "java.rule.engine_instantiation", "java.rule.getinstance",
    "java.rule.keygen_init", "java.rule.pqc_string",
]

# ---------------------------------------------------------------------------
# Risk model
# ---------------------------------------------------------------------------
CONTEXT_WEIGHTS = {
    "quantum_exposure": 0.35, "data_sensitivity": 0.20, "business_criticality": 0.20,
    "internet_exposure": 0.10, "blast_radius": 0.10, "migration_difficulty": 0.05,
}
EXPOSURE_SCORES = {
    "vulnerable": 1.00, "conditionally_safe": 0.40, "unknown": 0.60, "hybrid": 0.20, "safe": 0.00,
}
SENSITIVITY_SCORES = {
    "top_secret": 1.00, "secret": 0.85, "confidential": 0.65, "internal": 0.40, "public": 0.10,
    "unknown": 0.50,
}
CRITICALITY_SCORES = {"critical": 1.00, "high": 0.75, "medium": 0.50, "low": 0.25, "unknown": 0.50}
RISK_LEVELS = [(0.75, "CRITICAL"), (0.55, "HIGH"), (0.30, "MEDIUM")]
RISK_SEED = 20260930
RISK_SAMPLES = 10_000
RISK_DEFAULTS = {"z_low": 5.0, "z_mode": 12.0, "z_high": 20.0}
INSUFFICIENT_CONTEXT = "INSUFFICIENT CONTEXT"

# ---------------------------------------------------------------------------
# migration
# bucket, wave number, rationale, effort weeks per asset
# ---------------------------------------------------------------------------
WAVES = [
    ("CRITICAL", 1, "Immediate: highest quantum risk, internet-facing, sensitive data", 8.0),
    ("HIGH", 2, "Near-term: high risk, requires coordinated migration", 5.0),
    ("MEDIUM", 3, "Planned: medium risk, can follow organizational cycle", 3.0),
    ("LOW", 4, "Scheduled: low risk, include in next major upgrade cycle", 2.0),
    ("SAFE", 5, "No action: already quantum-safe — verify registry currency", 0.0),
]
NOTE_TLS = "Requires TLS 1.3 support at both endpoints"
NOTE_SSH = "Requires OpenSSH 9.x or equivalent PQC-capable SSH implementation"
NOTE_LIBRARY = "Library support required: OQS, Bouncy Castle >= 1.79, or native FIPS 203 implementation"
NOTE_CERTIFICATE = "Certificate re-issuance required for X.509 public key changes"
MIGRATION_STATUSES = ["vulnerable", "conditionally_safe", "unknown"]
SIGNATURE_FAMILIES = ["pqc_signature", "hybrid_signature"]
KEM_FAMILIES = ["pqc_kem", "hybrid_kem"]
KEY_ROLES = ["key_encapsulation", "key_establishment", "tls_kex"]
# name | standard | status | family | usage roles | variants | categories | notes | trade-offs |
# overhead ms | cpu factor | public key bytes | bandwidth kB | complexity | cost tier
_REGISTRY = """
ML-KEM-768|NIST FIPS 203|final|pqc_kem|key_encapsulation,key_establishment|ML-KEM-512,ML-KEM-768,ML-KEM-1024|1,3,5|NIST primary KEM standard. Not a signature scheme.|Larger key/ciphertext than ECDH;Higher CPU than X25519|2.1|1.5|1184|2.27|LOW|$
ML-DSA-65|NIST FIPS 204|final|pqc_signature|digital_signature,certificate_signing|ML-DSA-44,ML-DSA-65,ML-DSA-87|2,3,5|NIST primary digital signature standard.|Larger signature than ECDSA;Different performance profile|3.4|1.8|1952|5.26|MODERATE|$$
SLH-DSA|NIST FIPS 205|final|pqc_signature|digital_signature|SLH-DSA-SHA2-128s,SLH-DSA-SHA2-192f,SLH-DSA-SHA2-256f|1,3,5|Hash-based signature, conservative security assumption.|Stateless but large signature size;Slow signing for some variants|8.5|3.2|32|17.12|MODERATE-HIGH|$$
X25519MLKEM768|IETF RFC 10024|standards-track|hybrid_kem|tls_kex,key_establishment|X25519MLKEM768,SecP256r1MLKEM768,SecP384r1MLKEM1024|3|Hybrid PQ/T KEX for TLS 1.3. RFC 10024 standards-track.|Larger ClientHello;Requires TLS 1.3|2.3|1.6|1216|2.34|LOW|$
mlkem768x25519-sha256|IETF RFC 10042|informational|hybrid_kem|ssh_kex|mlkem768x25519-sha256,sntrup761x25519-sha512|3|Hybrid PQ/T KEX for SSH. RFC 10042 informational.|Requires OpenSSH 9.x+|2.3|1.6|1216|2.34|LOW|$
"""
REGISTRY_COLUMNS = [
    "name", "standard", "status", "family", "usage_roles", "variants", "security_categories", "notes",
    "trade_offs", "overhead_ms", "cpu_factor", "public_key_bytes", "bandwidth_kb", "complexity", "cost_tier",
]
REGISTRY_ROWS = [
    tuple(float(v) if 9 <= i <= 10 or i == 12 else int(v) if i == 11 else v for i, v in enumerate(r))
    for r in _table(_REGISTRY, 15)
]

# ---------------------------------------------------------------------------
# Bill of materials
# ---------------------------------------------------------------------------
BOM_FORMAT = "CycloneDX"
BOM_VERSION = "1.7"
BOM_SCHEMA = "http://cyclonedx.org/schema/bom-1.7.schema.json"
BOM_UI_VERSION = "1.6"
FAMILY_PRIMITIVES = {
    "symmetric_cipher": "cipher", "hash": "hash", "mac": "mac", "kdf": "hash",
    "asymmetric_cipher": "asymmetric-encryption", "key_agreement": "key-agreement", "kem": "kem",
    "digital_signature": "signature", "random": "prf", "hybrid_kem": "kem",
    "hybrid_signature": "signature", "pqc_kem": "kem", "pqc_signature": "signature",
    "unknown": "unknown",
}
QUANTUM_SAFE_STATUSES = ["safe", "hybrid"]
ALGORITHM_OIDS = {
    "RSA": "1.2.840.113549.1.1.1", "ECDSA": "1.2.840.10045.2.1",
    "SHA-256": "2.16.840.1.101.3.4.2.1", "SHA-384": "2.16.840.1.101.3.4.2.2",
    "SHA-512": "2.16.840.1.101.3.4.2.3", "AES": "2.16.840.1.101.3.4.1",
    "Ed25519": "1.3.101.112", "X25519": "1.3.101.110", "ML-KEM": "2.16.840.1.101.3.4.4.1",
    "ML-DSA": "2.16.840.1.101.3.4.3.17", "SLH-DSA": "2.16.840.1.101.3.4.3.20",
}
BOM_OCCURRENCES = 10
BOM_METHODS = 5
PLACEHOLDER_NAMES = ["aes-256-gcm", "mock", "placeholder", "example-rsa-key"]

# ---------------------------------------------------------------------------
# Project listing order (names containing the last one sort last)
# ---------------------------------------------------------------------------
PROJECT_RANKS = {"pyjwt": 0, "paramiko": 1, "certbot": 2}
PROJECT_DEFAULT_RANK = 50
PROJECT_LAST = "jjwt"
