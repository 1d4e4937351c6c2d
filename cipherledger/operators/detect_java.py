"""Java source rules: imports, getInstance calls, key sizes, engines, post-quantum names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherledger.functions import vocab
from cipherledger.functions.text import each_with_position, first_match, line_at, occurrences, record, text_lines, without_marks
from cipherledger.operators.inventory import first_of_key
from cipherledger.operators.normalize import normalize_names

IMPORT = r"import\s+((?:" + "|".join(vocab.JAVA_IMPORT_PACKAGES) + r")\.[\w.*]+)"
CODE = ["implementation", "usage"]
# rule, detector, pattern, group with the name, group with the class, confidence
RULES = [
    ("import", "java.rule.import", IMPORT, 1, 1, 0.60),
    ("getinstance", "java.rule.getinstance", vocab.JAVA_GET_INSTANCE, 2, 1, 0.90),
    ("key_size", "java.rule.keygen_init", vocab.JAVA_KEY_SIZE, 2, 1, 0.70),
    ("engine", "java.rule.engine_instantiation", vocab.JAVA_ENGINE, 1, 1, 0.75),
    ("pqc", "java.rule.pqc_string", vocab.JAVA_PQC_STRING, 1, 1, 0.80),
]


def scan_java(files: DataFrame) -> DataFrame:
    """Findings of Java files (key columns, ``path``, ``content``), one per file, line, name and roles.

    Each file is matched inside its own row; only the findings are shuffled,
    for the removal of duplicates.
    """
    return deduplicate(raw_java(files), [c for c in files.columns if c != "content"])


def _tagged(rule: str, found: Column) -> Column:
    return F.transform(
        found,
        lambda m: record(rule=F.lit(rule), line=m["line"], name=m["name"], cls=m["cls"], raw_signal=line_at(F.col("_lines"), m["line"])),
    )


def raw_java(files: DataFrame) -> DataFrame:
    keys = [c for c in files.columns if c != "content"]
    content = F.col("content")
    found = F.concat(*[_tagged(rule, occurrences(content, pattern, name=g, cls=c)) for rule, _, pattern, g, c, _ in RULES])
    prepared = files.select(*keys, without_marks(content).alias("content"), text_lines(content).alias("_lines"))
    rows = each_with_position(prepared.select(*keys, found.alias("_found")), keys, F.col("_found"), "ord", "m").select(*keys, "ord", "m.*")
    rule, name = F.col("rule"), F.col("name")
    token = first_match(F.when(rule == "import", F.replace(name, F.lit("."), F.lit(" "))).otherwise(name), vocab.JAVA_ALGORITHM_TOKEN)
    simple = F.when(rule == "import", F.element_at(F.split(name, r"\."), -1)).otherwise(name)
    named = normalize_names(rows.withColumns({"_token": token, "_simple": simple}), "_simple")
    generic = F.lower("_simple").isin(vocab.JAVA_GENERIC_CLASSES) | (F.col("_simple") == "*") | (F.col("canonical") == "UNKNOWN")
    library = (rule == "import") & F.col("_token").isNull() & generic
    hint = (
        F.when(rule.isin("getinstance", "pqc"), name)
        .when(rule == "key_size", F.concat(F.lit("KeySize-"), name))
        .when(F.col("_token").isNotNull(), F.col("_token"))
        .when(library | (F.col("canonical") == "UNKNOWN"), F.col("_simple"))
        .otherwise(F.col("canonical"))
    )
    roles = (
        F.when(library, F.array(F.lit("capability")))
        .when(rule == "import", F.array(F.lit("implementation")))
        .otherwise(F.array(*[F.lit(r) for r in CODE]))
    )
    confidence = F.when(library, 0.50)
    detector = F.when(F.lit(False), "")
    for r, d, *_, c in RULES:
        confidence, detector = confidence.when(rule == r, c), detector.when(rule == r, d)
    kept = (rule != "getinstance") | F.col("_token").isNotNull() | name.contains("/")
    return named.filter(kept).select(
        *keys, "ord", "line", detector.alias("detector"), "raw_signal", roles.alias("roles"), hint.alias("algorithm_hint"),
        confidence.alias("confidence"), F.lit("java_source").alias("source_type"),
        F.create_map(F.lit("rule"), rule, F.lit("name"), name, F.lit("class"), F.col("cls")).alias("provenance"),
    )


def deduplicate(findings: DataFrame, keys: list[str]) -> DataFrame:
    key = [*[F.col(k) for k in keys], F.col("line"), F.lower("algorithm_hint"), F.array_sort("roles")]
    return first_of_key(findings, key, ["ord"])
