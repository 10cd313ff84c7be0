"""The flagship pipeline: screening, class, policy, checks, recovery, fold and validation, raw wherever in doubt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import codecs, policy, text

# Streams and type hints whose text may be folded at all.
STREAMS, HINT = ("combined", "stdout", "file"), "text"
GIT = r"(?i)(?:^|[^A-Za-z0-9_])git(?:\.exe)?(?:$|[^A-Za-z0-9_])"


def metadata_text(*columns: Column) -> Column:
    """What a secret could hide in beside the content."""
    return F.concat_ws("\n", *[c.cast("string") for c in columns])


def resolve_sensitivity(content: Column, metadata: Column, claimed: Column) -> Column:
    """The detector and the caller can only raise sensitivity."""
    found = F.coalesce(text.contains_sensitive(content), F.lit(False)) | F.coalesce(text.contains_sensitive(metadata), F.lit(False))
    return F.when(found | (claimed == "SENSITIVE"), "SENSITIVE").otherwise(F.coalesce(claimed, F.lit("UNKNOWN")))


def resolve_persistence(sensitivity: Column, wanted: Column) -> Column:
    """Sensitive content is never kept; only what is known not to be sensitive is kept on disk."""
    return F.when(sensitivity == "SENSITIVE", "DO_NOT_PERSIST").when((wanted == "PERSIST") & (sensitivity != "NON_SENSITIVE"), "EPHEMERAL").otherwise(F.coalesce(wanted, F.lit("DO_NOT_PERSIST")))


def metadata_allows(command: Column, stream: Column, truncated: Column, hint: Column) -> Column:
    """Metadata can forbid a transform, never justify one."""
    return ~F.coalesce(truncated, F.lit(False)) & F.coalesce(stream.isin(*STREAMS), F.lit(False)) & (hint.isNull() | (hint == HINT)) & ~F.coalesce(command.rlike(GIT), F.lit(False))


def facts_kept(visible: Column, content: Column, facts: Column) -> Column:
    """Every fact stands in the visible bytes, as often as in the content."""
    return F.forall(facts, lambda f: (text.occurrences(visible, f) > 0) & (text.occurrences(visible, f) >= text.occurrences(content, f)))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later ones refer to often. The row generator keeps the optimizer from writing
    their expressions out at every reference."""
    held = [c for c in rows.columns if c not in columns]
    return rows.select(*held, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def process(rows: DataFrame) -> DataFrame:
    """``rows`` has content, exit_code, mode, profile, command, stream, truncated, hint, persistence,
    sensitivity and facts. Adds the decision, its ordered reason, the visible bytes and the audit.

    Null content is empty. A transform whose round trip fails escalates to raw.
    """
    raw = F.coalesce(F.col("content"), F.lit(""))
    r = rows.withColumn("content", raw).withColumn("n_bytes", F.octet_length(raw).cast("long"))
    metadata = metadata_text(F.col("command"), F.col("stream"), F.col("hint"), F.array_join("facts", "\n"), F.col("profile"))
    r = once(r, evidence=text.evidence_class(F.col("content"), F.col("exit_code")), sensitivity=resolve_sensitivity(F.col("content"), metadata, F.col("sensitivity")))
    r = r.withColumn("persistence", resolve_persistence(F.col("sensitivity"), F.col("persistence")))
    # a profile allows no more than the core does
    core = policy.transform_for(F.col("evidence"), F.col("mode"))
    allowed = F.array_intersect(policy.whitelist(F.col("profile"), F.col("evidence"), F.col("mode")), F.array_compact(F.array(core)))
    r = r.withColumn("transform", F.get(allowed, F.lit(0)))
    r = r.withColumn("checks", policy.invariants(F.col("evidence"), F.col("mode"), F.col("exit_code"), F.col("transform"), F.col("n_bytes"), F.lit(None)))
    r = r.withColumn("plain", metadata_allows(F.col("command"), F.col("stream"), F.col("truncated"), F.col("hint")))
    r = once(r, transform=F.col("transform"), checks=F.col("checks"), plain=F.col("plain"))
    eligible = F.col("transform").isNotNull() & policy.first_forced(F.col("checks")).isNull() & F.col("plain") & (F.col("persistence") != "DO_NOT_PERSIST")
    r = r.withColumn("eligible", eligible).withColumn("fold", codecs.fold_udf()(F.when(F.col("eligible"), F.col("content").cast("binary"))))
    required = F.array_distinct(F.concat(text.required_facts(F.col("content")), F.coalesce("facts", F.array().cast("array<string>"))))
    visible = F.col("fold.visible").cast("string")
    reason = (
        F.when(F.col("persistence") == "DO_NOT_PERSIST", "NO_ARCHIVE_RAW")
        .when(~F.col("plain"), "METADATA_REQUIRES_RAW")
        .when(~F.col("eligible"), "EVIDENCE_OR_PROFILE")
        .when(F.col("fold.visible").isNull(), "NO_SAVINGS")
        .when(F.octet_length("fold.visible") >= F.col("n_bytes"), "NON_REDUCING")
        .when(~facts_kept(visible, F.col("content"), required), "FACT_GUARD")
        .when(~F.col("fold.exact"), "VALIDATE_FAILED")
        .otherwise("VALIDATED")
    )
    r = r.withColumn("reason", reason)
    done = F.col("reason") == "VALIDATED"
    disposition = F.when(done, "TRANSFORM").when(F.col("reason") == "VALIDATE_FAILED", "ESCALATE_TO_RAW").otherwise("RAW")
    # checks made only once a transform holds
    validated = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(True).alias("passed")) for i in ("I2", "I4", "I9", "BYTE_IDENTITY")])
    r = r.withColumn("disposition", disposition).withColumn("audit", F.when(done, F.concat("checks", validated)).otherwise(F.col("checks")))
    storage = F.when(F.col("persistence") == "DO_NOT_PERSIST", "FORBIDDEN").otherwise("READY")
    shown = F.when(done, visible).otherwise(F.col("content"))
    return r.withColumn("storage", storage).withColumn("visible", shown).withColumn("visible_bytes", F.octet_length("visible").cast("long")).withColumn("sha", F.sha2("content", 256)).drop("fold", "plain")


def replay_summary(done: DataFrame) -> DataFrame:
    """Totals of a replay: bytes, estimated tokens, reductions, and where the fold applied."""
    n, v = F.sum("n_bytes"), F.sum("visible_bytes")
    fold = F.col("disposition") == "TRANSFORM"
    return done.agg(
        F.count("*").alias("entries"), F.coalesce(n, F.lit(0)).alias("raw_bytes"), F.coalesce(v, F.lit(0)).alias("visible_bytes"),
        F.coalesce(n / 4.0, F.lit(0.0)).alias("raw_tokens_estimate"), F.coalesce(v / 4.0, F.lit(0.0)).alias("visible_tokens_estimate"),
        F.when(n > 0, F.round((1 - v / n) * 100, 2)).otherwise(0.0).alias("byte_reduction_pct"),
        F.count_if("eligible").alias("eligible"), F.count_if(fold).alias("transformed"), F.coalesce(F.sum(F.when(fold, F.col("n_bytes"))), F.lit(0)).alias("fold_raw_bytes"),
        F.coalesce(F.sum(F.when(fold, F.col("visible_bytes"))), F.lit(0)).alias("fold_visible_bytes"), F.count_if(F.col("reason") == "NO_SAVINGS").alias("overhead_defeated"),
    )
