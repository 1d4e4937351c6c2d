"""Private-key markers and certificate facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherledger.functions.text import split_lines

BEGIN = "-----BEGIN"


def private_key_markers(files: DataFrame) -> DataFrame:
    """Files with private-key material: the type named in the first header line, never the key."""
    keys = [c for c in files.columns if c != "content"]
    likely = files.filter(F.contains("content", F.lit(BEGIN)) & F.contains("content", F.lit("PRIVATE KEY")))
    header = F.get(
        F.filter(split_lines(F.col("content")), lambda t: F.contains(t, F.lit("PRIVATE KEY")) & F.startswith(t, F.lit(BEGIN))), F.lit(0)
    )
    hint = F.trim(F.replace(F.replace(header, F.lit(f"{BEGIN} "), F.lit("")), F.lit("-----"), F.lit("")))
    return likely.select(*keys, hint.alias("key_type_hint")).filter("key_type_hint IS NOT NULL")


def signature_name(key_type: Column, hash_name: Column, signature_oid: Column) -> Column:
    hashed = F.upper(F.coalesce(hash_name, F.lit("Unknown")))
    hashed = F.when(hash_name.isNull(), "Unknown").otherwise(hashed)
    return (
        F.when(key_type == "RSA", F.concat(F.lit("RSA-with-"), hashed))
        .when(key_type == "EC", F.concat(F.lit("ECDSA-with-"), hashed))
        .when(key_type.isin("Ed25519", "Ed448"), key_type)
        .otherwise(signature_oid)
    )


def certificate_hint(key_type: Column, signature: Column) -> Column:
    low = F.lower(signature)
    return (
        F.when(low.contains("ecdsa") | (key_type == "EC"), "ECDSA")
        .when(low.contains("rsa") | (key_type == "RSA"), "RSA")
        .when(low.contains("ed25519") | (key_type == "Ed25519"), "Ed25519")
        .when(low.contains("ed448") | (key_type == "Ed448"), "Ed448")
        .otherwise(key_type)
    )


def alternative_names(names: Column) -> Column:
    """array<struct<kind, value>> -> prefixed strings; other kinds are left out."""
    prefix = lambda n: (
        F.when(n["kind"] == "dns", "DNS:").when(n["kind"] == "ip", "IP:").when(n["kind"] == "email", "email:").when(n["kind"] == "uri", "URI:")
    )
    return F.array_compact(F.transform(names, lambda n: F.concat(prefix(n), n["value"])))


def key_parameters(key_type: Column, key_size: Column, curve: Column) -> Column:
    fixed = F.when(key_type == "Ed25519", 256).when(key_type == "X25519", 255).when(key_type.isin("Ed448", "X448"), 448)
    size = F.coalesce(fixed, F.when(key_type.isin("RSA", "EC", "DH"), key_size)).cast("string")
    both = F.create_map(F.lit("key_size"), size, F.lit("curve"), F.when(key_type == "EC", curve))
    return F.map_filter(both, lambda k, v: v.isNotNull())


def scan_certificates(facts: DataFrame, now: Column) -> DataFrame:
    """Findings from parsed certificate facts at a given time.

    Facts hold path, subject, serial (integer), not_before, not_after, key_type,
    key_size, curve, hash_name, signature_oid, names, is_ca.
    """
    expired = now > F.col("not_after")
    seconds = F.unix_timestamp(F.col("not_after").cast("timestamp")) - F.unix_timestamp(now.cast("timestamp"))
    signature = signature_name(F.col("key_type"), F.col("hash_name"), F.col("signature_oid"))
    return facts.withColumn("signature_algorithm", signature).withColumns(
        {
            "is_expired": expired,
            "days_to_expiry": F.when(~expired, F.floor(seconds / 86400).cast("int")),
            "serial_number": F.upper(F.hex("serial")),
            "alternative_names": alternative_names(F.col("names")),
            "key_params": key_parameters(F.col("key_type"), F.col("key_size"), F.col("curve")),
            "algorithm_hint": certificate_hint(F.col("key_type"), F.col("signature_algorithm")),
            "raw_signal": F.concat(
                F.lit("cert: "), "subject", F.lit(" | key="), "key_type", F.lit(" | sig="), "signature_algorithm"
            ),
            "detector": F.lit("certificate.x509_parser"),
            "roles": F.array(F.lit("observed")),
            "confidence": F.lit(0.95),
            "source_type": F.lit("certificate"),
        }
    )
