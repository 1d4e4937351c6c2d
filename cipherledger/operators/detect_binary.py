"""Binary content: file type, string signatures, library and symbol facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherledger.functions import vocab
from cipherledger.functions.tables import first_containing
from cipherledger.functions.text import base_name, each_with_position, first_match
from cipherledger.operators.inventory import first_of_key

ROLES = ["capability", "observed"]
ANY_SYMBOL = "(?i)" + "|".join(vocab.BINARY_SYMBOLS)
ANY_STRING = "(?i)" + "|".join(vocab.BINARY_SYMBOLS + vocab.BINARY_STRINGS)


def _roles() -> Column:
    return F.array(*[F.lit(r) for r in ROLES])


def file_type(content: Column) -> Column:
    """Type by magic bytes: ELF, PE, Mach-O, Mach-O-fat or unknown."""
    head = F.hex(F.substring(content, 1, 4))
    chain = F.when(F.lit(False), "")
    for magic, name in vocab.BINARY_MAGIC:
        chain = chain.when(head.startswith(magic), name)
    return chain.otherwise("unknown")


def algorithm_of_symbol(symbol: Column) -> Column:
    return first_containing(vocab.SYMBOL_ALGORITHMS, F.lower(symbol), symbol)


def algorithm_of_library(library: Column) -> Column:
    return first_containing(vocab.LIBRARY_ALGORITHMS, F.lower(library), F.lit("Unknown"))


def string_matches(files: DataFrame) -> DataFrame:
    """Every distinct signature text per pattern in raw bytes, in pattern order."""
    keys = [c for c in files.columns if c != "content"]
    text = F.decode("content", "ISO-8859-1")
    small = files.filter(F.octet_length("content") <= vocab.BINARY_MAX_BYTES).select(
        *keys, F.octet_length("content").alias("file_size"), file_type(F.col("content")).alias("file_type"), text.alias("_t")
    )
    found = F.concat(
        *[
            F.array_distinct(F.regexp_extract_all("_t", F.lit(f"(?i){p}"), F.lit(0)))
            for p in vocab.BINARY_SYMBOLS + vocab.BINARY_STRINGS
        ]
    )
    # one pass tells most binaries apart from those worth a pass for each pattern
    found = F.when(F.rlike("_t", F.lit(ANY_STRING)), found)
    rows = each_with_position(small, [*keys, "file_size", "file_type"], found, "ord", "signal")
    return rows.withColumn("algorithm_hint", algorithm_of_symbol(F.col("signal")))


def scan_strings(files: DataFrame) -> DataFrame:
    """String-scan findings, the first per file and algorithm."""
    keys = [c for c in files.columns if c != "content"]
    # only what differs between rows goes through the aggregation
    rows = string_matches(files).select(*keys, "ord", F.col("signal").alias("raw_signal"), "algorithm_hint", "file_type", "file_size")
    first = first_of_key(rows, [*[F.col(k) for k in keys], F.col("algorithm_hint")], ["ord"])
    return first.select(
        *keys, "ord", F.lit("binary.string_scan").alias("detector"), "raw_signal",
        _roles().alias("roles"), "algorithm_hint", F.lit(0.45).alias("confidence"), F.lit("binary").alias("source_type"),
        F.create_map(F.lit("file_type"), F.col("file_type"), F.lit("file_size"), F.col("file_size").cast("string")).alias("provenance"),
    )


_LIBRARY = "^(" + "|".join(vocab.CRYPTO_LIBRARIES) + ")"


def scan_libraries(facts: DataFrame) -> DataFrame:
    """Imported-library facts (``library``): one finding per known library name prefix."""
    base = F.lower(base_name(F.col("library")))
    return facts.filter(first_match(base, _LIBRARY).isNotNull()).withColumns(
        {
            "detector": F.lit("binary.imported_library"), "raw_signal": F.lower("library"), "roles": _roles(),
            "algorithm_hint": algorithm_of_library(F.col("library")), "confidence": F.lit(0.65), "source_type": F.lit("binary"),
        }
    )


def scan_symbols(facts: DataFrame) -> DataFrame:
    """Symbol facts (``symbol``): one finding per symbol that any pattern matches."""
    return facts.filter(F.rlike("symbol", F.lit(ANY_SYMBOL))).withColumns(
        {
            "detector": F.lit("binary.symbol"), "raw_signal": F.col("symbol"), "roles": _roles(),
            "algorithm_hint": algorithm_of_symbol(F.col("symbol")), "confidence": F.lit(0.70), "source_type": F.lit("binary"),
        }
    )


def deduplicate(findings: DataFrame, order: list[str], path: str = "path") -> DataFrame:
    """First finding per file, detector and algorithm."""
    return first_of_key(findings, [F.col(path), F.col("detector"), F.col("algorithm_hint")], order)
