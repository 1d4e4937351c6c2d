"""Configuration detectors: key/value lines and nested JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from cipherledger.functions import vocab
from cipherledger.functions.text import each, first_match, lines, strip


def scan_config_text(files: DataFrame) -> DataFrame:
    """One finding per non-comment line with a known key and an algorithm value."""
    keys = [c for c in files.columns if c != "content"]
    text = F.col("line_text")
    hits = (
        lines(files.filter(F.rlike("content", F.lit(vocab.CONFIG_KEY))))
        .filter((text != "") & ~text.startswith("#") & ~text.startswith("//") & F.rlike(text, F.lit(vocab.CONFIG_KEY)))
        .withColumn("algorithm_hint", first_match(text, vocab.CONFIG_VALUE, 0))
        .filter("algorithm_hint IS NOT NULL")
    )
    return hits.select(
        *keys, "line", F.lit("config.text_scan").alias("detector"), text.alias("raw_signal"),
        F.array(F.lit("configuration")).alias("roles"), strip(F.get(F.split(text, "[=:]", 2), F.lit(0))).alias("key_name"),
        "algorithm_hint", F.lit(0.70).alias("confidence"), F.lit("config").alias("source_type"),
    )


ERROR = "config.json_error"

# plain values only: the helper is shipped to workers without this package
_KEY = vocab.CONFIG_KEY
_HIT = StructType([StructField(n, StringType()) for n in ("json_path", "key", "value")])
_HITS = StructType([StructField("ok", BooleanType()), StructField("hits", ArrayType(_HIT))])


@F.pandas_udf(_HITS)
def json_strings(content: pd.Series) -> pd.DataFrame:
    """String values under matching keys at any depth; ``ok`` is false for invalid JSON.

    SQL has no recursion into documents of unknown depth, so the walk is a
    small Arrow-batched helper; all matching of values stays in Spark.
    """
    wanted = re.compile(_KEY)

    def walk(text: str) -> tuple[bool, list[dict]]:
        try:
            todo = [("", json.loads(text))]
        except (ValueError, RecursionError):
            return False, []
        hits = []
        while todo:
            path, node = todo.pop()
            if isinstance(node, list):
                todo += [(f"{path}[{i}]", v) for i, v in enumerate(node)]
            elif isinstance(node, dict):
                for k, v in node.items():
                    at = f"{path}.{k}" if path else k
                    if isinstance(v, str) and wanted.search(k + ":"):
                        hits.append({"json_path": at, "key": k, "value": v})
                    elif isinstance(v, (dict, list)):
                        todo.append((at, v))
        return True, hits

    done = [walk(t) for t in content]
    return pd.DataFrame({"ok": [d[0] for d in done], "hits": [d[1] for d in done]})


def scan_config_json(files: DataFrame, errors: bool = False) -> DataFrame:
    """Findings of JSON files; invalid JSON is scanned as text, and with ``errors`` also gives a row of the detector ERROR.

    Files that hold no algorithm value (and no escape that could hide one)
    never leave the JVM.
    """
    keys = [c for c in files.columns if c != "content"]
    possible = files.filter(F.rlike("content", F.lit(vocab.CONFIG_VALUE)) | F.contains("content", F.lit("\\")))
    walked = possible.withColumn("_w", json_strings("content"))
    hits = each(walked.filter("_w.ok"), keys, F.col("_w.hits"), "h").select(*keys, "h.*")
    found = hits.withColumn("algorithm_hint", first_match(F.col("value"), vocab.CONFIG_VALUE, 0)).filter("algorithm_hint IS NOT NULL")
    structured = found.select(
        *keys, F.lit(0).alias("line"), F.lit("config.json_scan").alias("detector"),
        F.concat_ws(": ", "json_path", "value").alias("raw_signal"), F.array(F.lit("configuration")).alias("roles"),
        F.col("key").alias("key_name"), "algorithm_hint", F.lit(0.70).alias("confidence"), F.lit("config").alias("source_type"),
    )
    broken = walked.filter("NOT _w.ok").select(*keys, "content")
    found = structured.unionByName(scan_config_text(broken))
    if not errors:
        return found
    none = F.lit(None).cast("string")
    failed = broken.select(
        *keys, F.lit(0).alias("line"), F.lit(ERROR).alias("detector"), F.lit("not valid").alias("raw_signal"), F.array().cast("array<string>").alias("roles"),
        none.alias("key_name"), none.alias("algorithm_hint"), F.lit(0.0).alias("confidence"), F.lit("config").alias("source_type"),
    )
    return found.unionByName(failed)


def scan_config(files: DataFrame, errors: bool = False) -> DataFrame:
    is_json = F.lower("path").endswith(".json")
    return scan_config_json(files.filter(is_json), errors).unionByName(scan_config_text(files.filter(~is_json)))
