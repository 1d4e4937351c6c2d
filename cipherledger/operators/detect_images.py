"""Container images: package databases, build files, member classes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherledger.functions import vocab
from cipherledger.functions.text import blank_to_null, each, first_match, lines, record, strip
from cipherledger.operators.detect_dependencies import package_capabilities

_NAME = r"(?s)^(?:.*\n)?Package: ([^\n]*)(.*)$"
_VERSION = r"(?s)^.*\nVersion: ([^\n]*)"


def package_stanzas(files: DataFrame) -> DataFrame:
    """Package and version of every stanza that a blank line ends."""
    keys = [c for c in files.columns if c != "content"]
    text = F.regexp_replace("content", r"\r\n?", "\n")
    stanzas = F.split(text, r"\n\s*\n", -1)
    ended = F.slice(stanzas, F.lit(1), F.size(stanzas) - 1)
    rows = each(files.filter(F.contains("content", F.lit("Package: "))), keys, ended, "_s")
    rest = F.regexp_extract("_s", _NAME, 2)
    return rows.select(
        *keys, blank_to_null(strip(F.regexp_extract("_s", _NAME, 1))).alias("package_name"),
        strip(first_match(rest, _VERSION)).alias("version"),
    ).filter("package_name IS NOT NULL")


def scan_package_database(files: DataFrame) -> DataFrame:
    found = package_capabilities(package_stanzas(files))
    return found.withColumns(
        {
            "detector": F.lit("container.dpkg_manifest"),
            "raw_signal": F.concat("package_name", F.lit(" "), F.coalesce("version", F.lit(""))),
            "roles": F.array(F.lit("capability"), F.lit("observed")),
            "confidence": F.lit(0.60),
            "source_type": F.lit("container"),
        }
    )


def package_line(line: Column) -> Column:
    """struct<name, version> of one package line; null for blank lines and comments."""
    text = strip(line)
    parts = F.split(text, r"\s+")
    pair = lambda n, v: record(name=n, version=v.cast("string"))
    return F.when((text != "") & ~text.startswith("#"), F.when(
        text.startswith("Package: "), pair(strip(F.substring(text, 10, 2**31 - 1)), F.lit(None))
    ).when(F.size(parts) >= 2, pair(F.get(F.split(F.get(parts, F.lit(0)), ":"), F.lit(0)), F.get(parts, F.lit(1)))).otherwise(
        pair(text, F.lit(None))
    ))


_COLUMNS = ["line", "detector", "raw_signal", "roles", "package_name", "algorithm_hints", "confidence", "source_type"]


def scan_build_files(files: DataFrame) -> DataFrame:
    """Base images, crypto packages and exposed TLS/SSH ports of image build files."""
    keys = [c for c in files.columns if c != "content"]
    text = F.col("line_text")
    rows = lines(files).filter((text != "") & ~text.startswith("#"))
    parts = [base_images(rows), installed_packages(rows), exposed_ports(rows)]
    return reduce(DataFrame.unionByName, [p.select(*keys, *_COLUMNS) for p in parts])


def _finding(rows: DataFrame, detector: str, role: str, confidence: float, **cols: Column) -> DataFrame:
    base = {
        "detector": F.lit(detector), "roles": F.array(F.lit(role)), "confidence": F.lit(confidence), "source_type": F.lit("container"),
        "package_name": F.lit(None).cast("string"), "algorithm_hints": F.array().cast("array<string>"),
    }
    return rows.withColumns(base | cols)


def base_images(rows: DataFrame) -> DataFrame:
    image = F.get(F.split("line_text", r"\s+"), F.lit(1))
    hits = rows.filter(F.upper("line_text").startswith("FROM ") & blank_to_null(image).isNotNull())
    signal = F.concat(F.lit("FROM "), image, F.lit(" (line "), F.col("line").cast("string"), F.lit(")"))
    return _finding(hits, "container.dockerfile_base_image", "capability", 0.85, package_name=image, raw_signal=signal)


def installed_packages(rows: DataFrame) -> DataFrame:
    """Mentions of seven packages; the hint list of such a finding is always empty."""
    named = lambda p: F.when(
        F.rlike("line_text", F.lit(rf"(?i)\b{re.escape(p)}(-dev|-devel|[0-9._-]*)?\b")), F.lit(p)
    )
    hits = rows.withColumn("pkg", F.explode(F.array_compact(F.array(*[named(p) for p in vocab.IMAGE_FILE_PACKAGES]))))
    signal = F.concat(
        "pkg", F.lit(" installed in Dockerfile (line "), F.col("line").cast("string"), F.lit("): "), "line_text"
    )
    return _finding(hits, "container.dockerfile_package", "capability", 0.80, package_name=F.col("pkg"), raw_signal=signal)


def exposed_ports(rows: DataFrame) -> DataFrame:
    hits = rows.filter(F.upper("line_text").startswith("EXPOSE ")).withColumn(
        "port", F.explode(F.split(strip(F.substring("line_text", 8, 2**31 - 1)), r"\s+"))
    )
    number = F.get(F.split("port", "/"), F.lit(0))
    protocol = F.when(number.isin(vocab.TLS_PORTS), "TLS").when(number.isin(vocab.SSH_PORTS), "SSH")
    label = F.when(protocol == "TLS", " (TLS/HTTPS protocol listener)").otherwise(" (SSH protocol listener)")
    return _finding(
        hits.filter(protocol.isNotNull()), "container.dockerfile_protocol", "configuration", 0.75,
        algorithm_hints=F.array(protocol), raw_signal=F.concat(F.lit("EXPOSE "), "port", label),
    )


def member_class(name: Column, header: Column) -> Column:
    """manifest, certificate or binary for an image member; null for anything else.

    ``header`` holds the first four bytes, so two-byte magics never match here.
    """
    low = F.lower(F.ltrim(name, F.lit("./")))
    ends = lambda xs: reduce(lambda a, b: a | b, [low.endswith(x) for x in xs])
    return (
        F.when(low.contains("var/lib/dpkg/status") | low.contains("var/lib/dpkg/info") | low.contains("lib/apk/db/installed"), "manifest")
        .when(ends(vocab.ARCHIVE_CERT_EXTENSIONS), "certificate")
        .when(~ends(vocab.IMAGE_TEXT_EXTENSIONS) & F.hex(header).isin("7F454C46", "FEEDFACE", "CEFAEDFE"), "binary")
    )
