"""Disposition policy and invariants as a lookup table and column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The closed sets of classes, modes and profiles.
CLASSES = ("UNKNOWN", "FAILURE", "AUTHORITY", "SECURITY", "CANONICAL_STATE", "BENCHMARK", "DIAGNOSTIC", "MACHINE_DATA", "SUCCESS_SUMMARY", "DISCOVERY", "NOISE", "PROGRESS")
MODES = ("EXPLORE", "BUILD", "PROVE")
PROFILES = ("default", "strict", "ideas")
ALWAYS_RAW = ("AUTHORITY", "SECURITY", "FAILURE", "CANONICAL_STATE", "BENCHMARK", "UNKNOWN")
RAW_IN_PROVE = ("DISCOVERY", "PROGRESS", "SUCCESS_SUMMARY", "DIAGNOSTIC", "MACHINE_DATA")
FOLD = "FOLD"
#: Transforms proven lossless for machine data: none yet.
LOSSLESS: tuple[str, ...] = ()


def transform_for(evidence: Column, mode: Column) -> Column:
    """The transform a policy allows, null for none."""
    return F.when(evidence == "NOISE", FOLD).when((evidence == "PROGRESS") & (mode != "PROVE"), FOLD)


def whitelist(profile: Column, evidence: Column, mode: Column) -> Column:
    """The transforms a profile lists; all profiles are aliases of one policy, an unknown one lists none."""
    return F.when(profile.isin(*PROFILES), F.array_compact(F.array(transform_for(evidence, mode)))).otherwise(F.array().cast("array<string>"))


def policy_table(spark: SparkSession) -> DataFrame:
    """Every profile, class and mode with what it allows; profiles are aliases of one policy."""
    rows = spark.createDataFrame([(p, c, m) for p in PROFILES for c in CLASSES for m in MODES], "profile string, evidence string, mode string")
    allowed = transform_for(F.col("evidence"), F.col("mode"))
    lossless = (F.col("evidence") == "MACHINE_DATA") & (F.col("mode") != "PROVE")
    return rows.withColumn("transform", allowed).withColumn("disposition", F.when(allowed.isNotNull(), "TRANSFORM").when(lossless, "LOSSLESS_ONLY").otherwise("RAW"))


def invariants(evidence: Column, mode: Column, exit_code: Column, transform: Column, raw_bytes: Column, out_bytes: Column) -> Column:
    """Ordered (id, passed) of all checks; the first that fails forces raw delivery."""
    failed_exit = F.coalesce(exit_code != 0, F.lit(False))
    checks = [
        ("I5", evidence != "UNKNOWN"),
        ("I6", ~((evidence == "FAILURE") | failed_exit)),
        ("I7", ~evidence.isin("AUTHORITY", "SECURITY")),
        ("I_ALWAYS_RAW", ~evidence.isin(*ALWAYS_RAW)),
        ("I_PROVE_MODE", ~((mode == "PROVE") & evidence.isin(*RAW_IN_PROVE))),
        ("I8", (evidence != "MACHINE_DATA") | transform.isNull() | (transform.isin(*LOSSLESS) if LOSSLESS else F.lit(False))),
        ("I9", out_bytes.isNull() | (out_bytes < raw_bytes)),
        ("I12", ~(evidence.isin(*ALWAYS_RAW) & transform.isNotNull())),
    ]
    return F.array(*[F.struct(F.lit(i).alias("id"), c.alias("passed")) for i, c in checks])


def first_forced(checks: Column) -> Column:
    return F.get(F.filter(checks, lambda c: ~c["passed"]), F.lit(0))["id"]
