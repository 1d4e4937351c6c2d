"""Dependency manifests: parse package lines, keep known packages, expand their algorithms."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherledger.functions import vocab
from cipherledger.functions.tables import package_table
from cipherledger.functions.text import blank_to_null, each, each_with_position, first_match, lines, match_lines, record, strip, text_lines, without_marks
from cipherledger.sources.files import manifest_files

PACKAGE_NAMES = [r[1] for r in vocab.PACKAGE_ROWS]
_PREFIX = "^(" + "|".join(re.escape(p).replace(r"\-", "-") for p in PACKAGE_NAMES) + ")"


def package_key(name: Column) -> Column:
    """Known package for a name: the name itself, else the first table entry it starts with."""
    key = F.translate(F.lower(strip(name)), "_", "-")
    return F.when(key.isin(PACKAGE_NAMES), key).otherwise(first_match(key, _PREFIX))


def package_capabilities(rows: DataFrame, name: str = "package_name") -> DataFrame:
    """Rows of known packages with algorithm_hints and ecosystem.

    The prefix rule is one alternation in table order, so the join itself is
    an equality join with 41 fixed rows.
    """
    table = package_table(rows.sparkSession).select("pkg_key", F.col("algorithms").alias("algorithm_hints"), "ecosystem")
    return rows.withColumn("pkg_key", package_key(F.col(name))).join(F.broadcast(table), "pkg_key").drop("pkg_key")


def _keys(files: DataFrame) -> list[str]:
    return [c for c in files.columns if c != "content"]


def _as_rows(packages: DataFrame, keys: list[str], detector: str) -> DataFrame:
    return packages.select(
        *keys, F.col("line").cast("int").alias("line"), F.lit(detector).alias("detector"), "raw_signal", "package_name", "version"
    )


def requirements(files: DataFrame) -> DataFrame:
    text = F.col("line_text")
    rows = lines(files).filter((text != "") & ~F.rlike(text, F.lit(vocab.REQUIREMENT_SKIP)) & F.rlike(text, F.lit(vocab.REQUIREMENT_LINE)))
    parsed = rows.select(
        *_keys(files), "line", text.alias("raw_signal"), F.regexp_extract(text, vocab.REQUIREMENT_LINE, 1).alias("package_name"),
        blank_to_null(strip(F.regexp_extract(text, vocab.REQUIREMENT_LINE, 3))).alias("version"),
    )
    return _as_rows(parsed, _keys(files), "dependency.requirements_txt")


def _section(content: Column, header: str) -> Column:
    return F.regexp_extract(content, r"(?ms)^\[" + re.escape(header) + r"\][ \t]*(?:#[^\n]*)?$(.*?)(?=^\[|\z)", 1)


_ENTRY = r"""(?m)^[ \t]*["']?([A-Za-z0-9_.\-]+)["']?[ \t]*=[ \t]*(.+)$"""
_LIST = r"""(?ms)^[ \t]*dependencies[ \t]*=[ \t]*\[((?:\s|"[^"]*"|'[^']*'|,|#[^\n]*)*)\]"""


def _table_packages(section: Column) -> Column:
    """name = "1.0" and name = {version = "1.0"} lines as array<struct<package_name, version>>."""
    found = F.arrays_zip(
        F.regexp_extract_all(section, F.lit(_ENTRY), F.lit(1)), F.regexp_extract_all(section, F.lit(_ENTRY), F.lit(2))
    )
    quoted = r"""^["']([^"']*)["']"""
    inner = r"""version\s*=\s*["']([^"']*)["']"""

    def entry(z: Column) -> Column:
        value = z["1"]
        version = F.when(F.rlike(value, F.lit(quoted)), F.regexp_extract(value, quoted, 1)).when(
            value.startswith("{") & F.rlike(value, F.lit(inner)), F.regexp_extract(value, inner, 1)
        )
        return record(package_name=z["0"], version=version)

    return F.transform(found, entry)


def _listed_packages(section: Column) -> Column:
    body = F.regexp_extract(section, _LIST, 1)
    items = F.regexp_extract_all(body, F.lit(r"""["']([^"']*)["']"""), F.lit(1))
    good = F.filter(items, lambda x: F.rlike(x, F.lit(vocab.REQUIREMENT_LINE)))
    return F.transform(
        good,
        lambda x: record(package_name=F.regexp_extract(x, vocab.REQUIREMENT_LINE, 1), version=F.regexp_extract(x, vocab.REQUIREMENT_LINE, 3)),
    )


def pyproject(files: DataFrame) -> DataFrame:
    """Poetry tables and the PEP 621 list; a later entry of the same name replaces an earlier one."""
    content = F.col("content")
    entries = F.concat(
        _table_packages(_section(content, "tool.poetry.dependencies")),
        _table_packages(_section(content, "tool.poetry.dev-dependencies")),
        _listed_packages(_section(content, "project")),
    )
    rows = files.select(*_keys(files), entries.alias("_all"))
    last = F.filter(
        "_all",
        lambda x, i: ~F.exists(F.slice("_all", i + 2, F.size("_all") + 1), lambda y: y["package_name"] == x["package_name"]),
    )
    parsed = each(rows, _keys(files), last, "e").select(
        *_keys(files), F.lit(0).alias("line"),
        F.concat(F.col("e.package_name"), F.lit(" = "), F.coalesce(F.col("e.version"), F.lit("None"))).alias("raw_signal"), "e.*",
    )
    return _as_rows(parsed, _keys(files), "dependency.pyproject_toml")


_HEADER = r"(?m)^[ \t]*\[\[package\]\][ \t]*$"


def _last_value(stanza: Column, field: str) -> Column:
    line = F.try_element_at(F.regexp_extract_all(stanza, F.lit(rf"(?m)^[ \t]*{field} = (.*)$"), F.lit(1)), F.lit(-1))
    return F.when(line.contains('"'), F.get(F.split(line, '"'), F.lit(1))).otherwise(strip(line))


def poetry_lock(files: DataFrame) -> DataFrame:
    """name/version of every [[package]] stanza; the line is that of the next header, 0 for the last stanza."""
    heads = files.withColumn("_heads", match_lines(without_marks(F.col("content")), _HEADER))
    rows = each_with_position(heads, [*_keys(files), "_heads"], F.split("content", _HEADER, -1), "_i", "_stanza")
    final = F.col("_i") == F.size("_heads")
    parsed = rows.select(
        *_keys(files), F.coalesce(F.get("_heads", F.col("_i")), F.lit(0)).alias("line"), final.alias("_final"),
        _last_value(F.col("_stanza"), "name").alias("package_name"), _last_value(F.col("_stanza"), "version").alias("version"),
    ).filter("package_name IS NOT NULL AND package_name <> ''")
    head = F.when(F.col("_final"), "name = ").otherwise("[[package]] name = ")
    return _as_rows(parsed.withColumn("raw_signal", F.concat(head, "package_name")), _keys(files), "dependency.poetry_lock")


def _resolve(value: Column, names: Column, values: Column) -> Column:
    """Three passes of ${reference} replacement; an unknown reference stays.

    ``names`` are the properties in reverse order, so the last definition counts.
    """

    def step(text: Column, _: Column) -> Column:
        ref = F.regexp_extract(text, vocab.MAVEN_REFERENCE, 1)
        known = F.get(values, (F.array_position(names, ref) - 1).cast("int"))
        return F.coalesce(F.replace(text, F.concat(F.lit("${"), ref, F.lit("}")), known), text)

    return F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), value, step)


def pom(files: DataFrame) -> DataFrame:
    """i-th artifactId with i-th version, ${properties} resolved."""
    keys = _keys(files)
    props = F.filter(
        F.transform(
            "_lines",
            lambda t: record(k=F.regexp_extract(t, vocab.MAVEN_PROPERTY, 1), v=strip(F.regexp_extract(t, vocab.MAVEN_PROPERTY, 2))),
        ),
        lambda p: (p["k"] != "") & ~p["k"].isin(vocab.MAVEN_NOT_PROPERTIES),
    )
    tagged = lambda pattern: F.filter(
        F.transform("_lines", lambda t, i: record(line=(i + 1), text=strip(t), v=F.regexp_extract(t, pattern, 1))),
        lambda a: a["v"] != "",
    )
    found = files.select(*keys, text_lines(F.col("content")).alias("_lines")).select(
        *keys, F.reverse(props).alias("_props"), tagged(vocab.MAVEN_ARTIFACT).alias("_arts"), tagged(vocab.MAVEN_VERSION).alias("_vers")
    )
    rows = each_with_position(found, [*keys, "_props", "_vers"], F.col("_arts"), "_i", "a")
    names, values = F.col("_props.k"), F.col("_props.v")
    raw = F.col("a.v")
    parsed = rows.select(
        *keys, F.col("a.line").alias("line"), F.col("a.text").alias("raw_signal"),
        F.coalesce(blank_to_null(_resolve(raw, names, values)), raw).alias("package_name"),
        _resolve(F.get("_vers", F.col("_i"))["v"], names, values).alias("version"),
    )
    return _as_rows(parsed, keys, "dependency.pom_xml")


def gradle(files: DataFrame) -> DataFrame:
    text = F.col("line_text")
    rows = lines(files).filter(F.rlike(text, F.lit(vocab.GRADLE_DEPENDENCY)))
    parsed = rows.select(
        *_keys(files), "line", text.alias("raw_signal"), F.regexp_extract(text, vocab.GRADLE_DEPENDENCY, 1).alias("package_name"),
        F.regexp_extract(text, vocab.GRADLE_DEPENDENCY, 2).alias("version"),
    )
    return _as_rows(parsed, _keys(files), "dependency.build_gradle")


def package_json(files: DataFrame) -> DataFrame:
    """dependencies and devDependencies, the latter first where both name a package."""
    none = F.create_map().cast("map<string,string>")
    parsed = files.withColumn("_d", F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>"))
    main, dev = F.coalesce("_d.dependencies", none), F.coalesce("_d.devDependencies", none)
    both = parsed.select(*_keys(files), main.alias("_main"), dev.alias("_dev"))
    merged = F.map_concat(F.map_filter("_main", lambda k, v: ~F.map_contains_key("_dev", k)), "_dev")
    rows = both.select(*_keys(files), F.lit(0).alias("line"), F.explode(merged).alias("package_name", "version"))
    return _as_rows(rows.withColumn("raw_signal", F.concat_ws(": ", "package_name", "version")), _keys(files), "dependency.package_json")


PARSERS = {
    "requirements": requirements, "pyproject": pyproject, "poetry_lock": poetry_lock, "pom": pom, "gradle": gradle,
    "package_json": package_json,
}


def parse_manifests(files: DataFrame) -> DataFrame:
    """All packages named by known manifest files, one detector branch per parser."""
    known = manifest_files(files)
    parts = [
        parse(known.filter(F.col("parser") == name).select(*files.columns)) for name, parse in PARSERS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def capability_findings(packages: DataFrame) -> DataFrame:
    """Findings for packages that bring cryptography; dependencies are never more than a capability."""
    return package_capabilities(packages).withColumns(
        {
            "roles": F.array(F.lit("capability")),
            "confidence": F.lit(0.50),
            "source_type": F.lit("dependency"),
            "algorithm_hint": F.lit(None).cast("string"),
            "provenance": F.create_map(F.lit("package"), F.col("package_name"), F.lit("ecosystem"), F.col("ecosystem")),
        }
    ).drop("ecosystem")


def scan_dependencies(files: DataFrame) -> DataFrame:
    return capability_findings(parse_manifests(files))
