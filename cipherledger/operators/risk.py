"""Quantum exposure: timing condition, probability, context score, risk level."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherledger.functions import vocab
from cipherledger.functions.tables import inline_table, lookup

GRID = 1024


def at_risk(x: Column, y: Column, z_mode: Column) -> Column:
    return (x + y) > z_mode


def timing_assumptions(x: Column, y: Column, z_mode: Column) -> Column:
    return F.array(
        F.concat(F.lit("X (data lifetime) = "), x.cast("string"), F.lit(" years — user-supplied or enterprise-default")),
        F.concat(F.lit("Y (migration time) = "), y.cast("string"), F.lit(" years — estimated from algorithm complexity and context")),
        F.concat(F.lit("Z mode = "), z_mode.cast("string"), F.lit(" years — scenario parameter, not a CRQC arrival forecast")),
        F.lit("Mosca condition: X + Y > Z"),
    )


def triangular_cdf(t: Column, low: Column, mode: Column, high: Column) -> Column:
    return (
        F.when(t <= low, 0.0)
        .when(t >= high, 1.0)
        .when(t <= mode, (t - low) * (t - low) / ((high - low) * (mode - low)))
        .otherwise(1.0 - (high - t) * (high - t) / ((high - low) * (high - mode)))
    )


def triangular_pdf(t: Column, low: Column, mode: Column, high: Column) -> Column:
    return (
        F.when((t < low) | (t > high), 0.0)
        .when(t <= mode, 2.0 * (t - low) / ((high - low) * (mode - low)))
        .otherwise(2.0 * (high - t) / ((high - low) * (high - mode)))
    )


@lru_cache(maxsize=8)
def uniform_samples(samples: int = vocab.RISK_SAMPLES, seed: int = vocab.RISK_SEED) -> np.ndarray:
    """The sorted uniforms behind one seeded sample vector."""
    return np.sort(np.random.default_rng(seed).random(samples))


def sample_grid(spark: SparkSession, samples: int, seed: int) -> DataFrame:
    """Samples by grid cell: how many lie below the cell, and those inside it (at most ``samples`` values in all)."""
    u = uniform_samples(samples, seed)
    edges = np.searchsorted(u, np.arange(GRID + 1) / GRID)
    rows = [
        (c, int(edges[c]), ",".join(map(repr, u[edges[c] : edges[c + 1]].tolist()))) for c in range(GRID)
    ] + [(GRID, samples, "")]
    grid = inline_table(spark, ["cell", "below", "inside"], rows)
    return grid.withColumn(
        "inside", F.when(F.col("inside") == "", F.array().cast("array<double>")).otherwise(F.split("inside", ",").cast("array<double>"))
    )


def sampled_probability(
    rows: DataFrame, samples: int = vocab.RISK_SAMPLES, seed: int = vocab.RISK_SEED, name: str = "probability"
) -> DataFrame:
    """Share of seeded triangular samples Z with x + y > Z, to 4 places.

    Z is the inverse CDF of a uniform, so Z < t exactly when the uniform is
    below CDF(t).  One sample vector therefore serves every parameter set, and
    a row needs only its grid cell: an equality join with a table whose size is
    the number of samples, not the number of rows.
    """
    level = triangular_cdf(F.col("x") + F.col("y"), F.col("z_low"), F.col("z_mode"), F.col("z_high"))
    leveled = rows.withColumn("_level", level).withColumn("cell", F.floor(F.col("_level") * GRID).cast("int"))
    joined = leveled.join(F.broadcast(sample_grid(rows.sparkSession, samples, seed)), "cell", "left")
    hits = F.col("below") + F.size(F.filter("inside", lambda u: u < F.col("_level")))
    return joined.withColumn(
        name, F.when(F.col("_level").isNotNull(), F.round(hits / F.lit(float(samples)), 4))
    ).drop("cell", "_level", "below", "inside")


def context_components(
    quantum_status: Column,
    data_sensitivity: Column,
    business_criticality: Column,
    internet_exposure: Column,
    blast_radius_count: Column,
    migration_difficulty: Column,
) -> dict[str, Column]:
    n = F.coalesce(blast_radius_count, F.lit(0))
    return {
        "quantum_exposure": lookup(vocab.EXPOSURE_SCORES, quantum_status, 0.5),
        "data_sensitivity": lookup(vocab.SENSITIVITY_SCORES, F.lower(data_sensitivity), 0.5),
        "business_criticality": lookup(vocab.CRITICALITY_SCORES, F.lower(business_criticality), 0.5),
        "internet_exposure": F.when(internet_exposure, 1.0).otherwise(0.2),
        "blast_radius": F.when(n > 0, F.least(F.lit(1.0), F.log2(F.lit(1) + n) / 10.0)).otherwise(0.0),
        "migration_difficulty": migration_difficulty.cast("double"),
    }


def context_score(components: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    w = weights or vocab.CONTEXT_WEIGHTS
    total = F.lit(0.0)
    for k in vocab.CONTEXT_WEIGHTS:
        total = total + F.lit(float(w[k])) * components[k]
    return F.round(total, 4)


def risk_level(probability: Column, score: Column) -> Column:
    combined = F.lit(0.6) * probability + F.lit(0.4) * score
    chain = F.when(F.lit(False), "")
    for bound, level in vocab.RISK_LEVELS:
        chain = chain.when(combined >= bound, level)
    return chain.otherwise("LOW")


def _default(df: DataFrame, name: str, value) -> Column:
    return F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value)


def assess(
    rows: DataFrame, weights: dict[str, float] | None = None, samples: int = vocab.RISK_SAMPLES, seed: int = vocab.RISK_SEED
) -> DataFrame:
    """Full assessment of rows with x, y, optional z parameters and context columns.

    Rows without x or y are marked as lacking context: no condition, no
    probability, but a context score.
    """
    filled = rows.withColumns(
        {
            "x": F.col("x").cast("double"), "y": F.col("y").cast("double"),
            **{k: _default(rows, k, v).cast("double") for k, v in vocab.RISK_DEFAULTS.items()},
            "data_sensitivity": _default(rows, "data_sensitivity", "unknown"),
            "business_criticality": _default(rows, "business_criticality", "unknown"),
            "internet_exposure": _default(rows, "internet_exposure", False),
            "blast_radius_count": _default(rows, "blast_radius_count", 0),
            "migration_difficulty": _default(rows, "migration_difficulty", 0.5),
        }
    )
    parts = context_components(
        F.col("quantum_status"), F.col("data_sensitivity"), F.col("business_criticality"),
        F.col("internet_exposure"), F.col("blast_radius_count"), F.col("migration_difficulty"),
    )
    missing = F.col("x").isNull() | F.col("y").isNull()
    scored = sampled_probability(filled, samples, seed).withColumns(
        {
            "context_score": context_score(parts, weights),
            "context_breakdown": F.create_map(*[v for k, c in parts.items() for v in (F.lit(k), c)]),
            "at_risk_baseline": at_risk(F.col("x"), F.col("y"), F.col("z_mode")),
        }
    )
    return scored.withColumns(
        {
            "risk_level": F.when(missing, vocab.INSUFFICIENT_CONTEXT).otherwise(risk_level(F.col("probability"), F.col("context_score"))),
            "samples": F.when(~missing, F.lit(samples)),
            "seed": F.when(~missing, F.lit(seed)),
            "assumptions": F.when(
                missing, F.array(F.lit("Insufficient context: analyst inputs X and Y were not supplied"))
            ).otherwise(timing_assumptions(F.col("x"), F.col("y"), F.col("z_mode"))),
        }
    )


def sweep(rows: DataFrame, scenarios: list[dict]) -> DataFrame:
    """Every row under every scenario; scenario keys that are absent take the defaults."""
    keys = ["x", "y", *vocab.RISK_DEFAULTS]
    structs = [
        F.struct(
            F.lit(s["scenario"]).alias("scenario"),
            *[F.lit(s.get(k, vocab.RISK_DEFAULTS.get(k))).cast("double").alias(k) for k in keys],
        )
        for s in scenarios
    ]
    kept = [c for c in rows.columns if c not in keys]
    return rows.select(*kept, F.inline(F.array(*structs)))


def ranked_risk(risk: DataFrame, assets: DataFrame) -> DataFrame:
    """Risk rows with their asset's name and status, most probable first, unknown last."""
    names = assets.select("asset_id", "canonical", F.col("quantum_status").alias("asset_status"))
    return risk.join(names, "asset_id").orderBy(F.desc_nulls_last("probability"), "asset_id")


# --- curves ----------------------------------------------------------------------


def curve_parameters(z_mode: Column) -> tuple[Column, Column, Column]:
    return F.greatest(z_mode - 5.0, F.lit(2.0)), z_mode, z_mode + 8.0


def curve_points(rows: DataFrame, steps: int = 30) -> DataFrame:
    """Density curve of each row's distribution on an even grid, with the exposure cutoff in [0, 1]."""
    low, mode, high = curve_parameters(F.col("z_mode"))
    base = rows.withColumns({"low": low, "mode": mode, "high": high})
    points = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    t = F.col("low") + (F.col("i") / float(steps)) * (F.col("high") - F.col("low"))
    density = triangular_pdf(t, F.col("low"), F.col("mode"), F.col("high"))
    peak = 2.0 / (F.col("high") - F.col("low"))
    cutoff = (F.col("x") + F.col("y") - F.col("low")) / (F.col("high") - F.col("low"))
    return points.withColumns(
        {
            "curve_x": F.col("i") / float(steps) * 400.0,
            "curve_y": 130.0 - density / peak * 110.0,
            "cutoff": F.greatest(F.lit(0.0), F.least(F.lit(1.0), cutoff)) * 400.0,
        }
    )


def _half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def exposure_series(rows: DataFrame, years: int = 15) -> DataFrame:
    """Yearly threat, migration progress and risk window in percent (x: years to quantum computer,
    y: migration years, z: data lifetime)."""
    x, y, z, t = (F.col(c).cast("double") for c in ("x", "y", "z", "t"))
    timed = rows.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(years))))
    left = F.greatest(F.lit(0.0), x - t)
    window = F.least(F.lit(100.0), F.greatest(F.lit(0.0), (t - (z - y)) * 20.0))
    return timed.withColumns(
        {
            "year": F.concat(F.lit("Y+"), F.col("t")),
            "threat": _half_up(F.greatest(F.lit(0.0), 100.0 - left / F.greatest(F.lit(1.0), x) * 100.0)),
            "migration": _half_up(F.least(F.lit(100.0), t / F.greatest(F.lit(1.0), y) * 100.0)),
            "risk_window": _half_up(F.when(x + y > z, window).otherwise(0.0)),
        }
    ).drop("t")
