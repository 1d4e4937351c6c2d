"""File sources: directory trees, size guards, excluded folders, routing, digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherledger.functions import vocab
from cipherledger.functions.tables import inline_table
from cipherledger.functions.text import base_name, extension


def read_tree(
    spark: SparkSession, root: str, extensions: list[str] | None = None, max_bytes: int | None = None, text: bool = True
) -> DataFrame:
    """Files under ``root``: path, length, content.

    The name pattern and the length bound reach the file source, so content of
    other files is never read.  Undecodable bytes become replacement characters.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if extensions:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(extensions) + "}")
    files = reader.load(root)
    if max_bytes is not None:
        files = files.filter(F.col("length") <= max_bytes)
    content = F.make_valid_utf8(F.col("content").cast("string")) if text else F.col("content")
    return files.select("path", "length", content.alias("content"))


def outside_excluded_dirs(path: Column, excluded: list[str] | None = None) -> Column:
    names = F.array(*[F.lit(x) for x in (excluded or vocab.EXCLUDED_DIRS)])
    return ~F.arrays_overlap(F.split(path, "/"), names)


def within_size_guard(path: Column, length: Column) -> Column:
    """Size and extension rules of each file type; false for files of no known type."""
    ext = extension(path)
    return (
        (ext.isin(".py", ".java") & (length <= vocab.SOURCE_MAX_BYTES))
        | (ext.isin(vocab.CONFIG_EXTENSIONS) & (length <= vocab.CONFIG_MAX_BYTES))
        | ext.isin(vocab.CERT_EXTENSIONS)
        | (ext.isin(vocab.BINARY_EXTENSIONS) & (length > 0) & (length <= vocab.BINARY_MAX_BYTES))
    )


def _ends_with(c: Column, suffixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.endswith(s) for s in suffixes])


def route(path: Column) -> Column:
    """Detector for an archive member by name, null when no detector takes it."""
    ext = extension(path)
    return (
        F.when(ext == ".py", "python_source")
        .when(ext == ".java", "java_source")
        .when(_ends_with(path, vocab.ARCHIVE_MANIFEST_SUFFIXES), "dependency")
        .when(ext.isin(vocab.ARCHIVE_CERT_EXTENSIONS), "certificate")
        .when(F.lower(path).contains("dockerfile"), "image_file")
        .when(ext.isin(vocab.ARCHIVE_CONFIG_EXTENSIONS) & ~path.endswith("package.json"), "config")
    )


def manifest_files(files: DataFrame) -> DataFrame:
    """Files whose name a manifest parser knows, with the parser's name (11 fixed rows, broadcast)."""
    parsers = inline_table(files.sparkSession, ["file_name", "parser"], vocab.MANIFEST_PARSERS)
    return files.withColumn("file_name", base_name(F.col("path"))).join(F.broadcast(parsers), "file_name")


def with_digest(files: DataFrame) -> DataFrame:
    return files.withColumns({"sha256": F.sha2("content", 256), "size_bytes": F.octet_length("content")})
