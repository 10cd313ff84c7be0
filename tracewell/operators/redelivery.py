"""Exact redelivery of content within a session.

The sequential rules reduce to windows over a session: the first delivery of a content, the content
a source delivered last for the first time, and running counts. All windows partition by session
and narrower keys, so they share one shuffle on the session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell.functions.buckets import episode_bucket, recency_bucket

#: Families whose output is content to an agent even when its text proves nothing.
CONTENT_FAMILIES = ("FILE_READ", "SEARCH", "DIRECTORY_LIST")
REFERENCE = "[[REDELIVERY sha256=%s bytes=%d receipt=RCP-%s-%06d]]"


def _session(*keys: str):
    return W.partitionBy("session_id", *keys).orderBy("call_index")


def delivery_state(calls: DataFrame) -> DataFrame:
    """Adds what each call sees of the session before it.

    ``is_first``: first delivery of its content. ``first_index``/``first_episode``: where that was.
    ``source_sha``: content most recently delivered for the first time by the same source.
    ``receipt_no``: number of the first delivery among the session's.
    """
    by_sha = _session("sha")
    first = F.row_number().over(by_sha) == 1
    source = _session("tool_family", "target_path").rowsBetween(W.unboundedPreceding, -1)
    return (
        calls.withColumn("is_first", first)
        .withColumn("first_index", F.first("call_index").over(by_sha))
        .withColumn("first_episode", F.first("episode_id").over(by_sha))
        .withColumn("source_sha", F.last(F.when(F.col("is_first"), F.col("sha")), ignorenulls=True).over(source))
        .withColumn("firsts", F.sum(F.col("is_first").cast("long")).over(_session().rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("receipt_no", F.first("firsts").over(by_sha))
        .drop("firsts")
    )


def reference_text(sha: Column, n_bytes: Column, session: Column, receipt: Column) -> Column:
    return F.format_string(REFERENCE, sha, n_bytes, F.substring(session, 1, 8), receipt)


REFERENCE_FIELDS = r"^\[\[REDELIVERY sha256=([0-9a-f]{64}) bytes=(\d+) receipt=(RCP-.{1,8}-\d{6,})\]\]$"


def parse_reference(text: Column) -> Column:
    """The fields of a reference; null if the text is not exactly one."""
    part = lambda k: F.regexp_extract(text, REFERENCE_FIELDS, k)
    return F.when(text.rlike(REFERENCE_FIELDS), F.struct(part(1).alias("sha"), part(2).cast("long").alias("n_bytes"), part(3).alias("receipt")))


def redelivery_decisions(calls: DataFrame, evidence: Column, sensitive: Column | None = None) -> DataFrame:
    """One decision per call; ``evidence`` is the class of a call's content."""
    state = delivery_state(calls).withColumn("evidence", evidence)
    shown = F.when((F.col("evidence") == "UNKNOWN") & F.col("tool_family").isin(*CONTENT_FAMILIES) & F.col("target_path").isNotNull(), "CONTENT_EVIDENCE").otherwise(F.col("evidence"))
    secret = (sensitive if sensitive is not None else F.lit(False)) | (F.col("evidence") == "SECURITY")
    same = F.col("source_sha").eqNullSafe(F.col("sha")) & ~F.coalesce(F.col("target_path"), F.lit("")).isin("", "UNKNOWN")
    size = F.octet_length(reference_text(F.col("sha"), F.col("n_bytes"), F.col("session_id"), F.col("receipt_no")))
    chain = (
        F.when(F.col("is_first"), "FIRST_DELIVERY")
        .when(F.col("truncated"), "AMBIGUOUS_IDENTITY")
        .when(F.col("exit_code") != 0, "UNSAFE_EVIDENCE")
        .when(secret, "SENSITIVE")
        .when(~same, "CROSS_SOURCE")
        .when(shown.isin("AUTHORITY", "CANONICAL_STATE", "FAILURE", "DIAGNOSTIC"), "UNSAFE_EVIDENCE")
        .when(shown == "UNKNOWN", "UNKNOWN_EVIDENCE")
        .when(size >= F.col("n_bytes"), "NOT_ECONOMIC")
        .otherwise("REFERENCE")
    )
    out = state.withColumn("evidence", shown).withColumn("reference_bytes", size.cast("long")).withColumn("disposition", chain)
    # a receipt was last seen when it was made or when a reference to it was last emitted
    emitted = F.col("is_first") | (F.col("disposition") == "REFERENCE")
    latest = F.last(F.when(emitted, F.col("call_index")), ignorenulls=True).over(_session("sha").rowsBetween(W.unboundedPreceding, -1))
    return (
        out.withColumn("avoided_bytes", F.when(F.col("disposition") == "REFERENCE", F.col("n_bytes") - F.col("reference_bytes")).otherwise(F.lit(0).cast("long")))
        .withColumn("latest_distance", F.when(~F.col("is_first"), F.col("call_index") - latest))
        .withColumn("call_distance", F.when(~F.col("is_first"), F.col("call_index") - F.col("first_index")))
        .withColumn("episode_distance", F.when(~F.col("is_first"), F.col("episode_id") - F.col("first_episode")))
    )


def exact_redelivery(calls: DataFrame) -> DataFrame:
    """Groups of equal content under one source: events, gross bytes and the bytes of repeats."""
    groups = calls.where(F.col("target_path").isNotNull()).groupBy("target_path", "sha").agg(F.count("*").alias("events"), F.sum("n_bytes").alias("gross_bytes"), F.min("n_bytes").alias("one"))
    return groups.where(F.col("events") > 1).groupBy("target_path").agg(
        F.count("*").alias("groups"), F.sum("events").alias("events"), F.sum("gross_bytes").alias("gross_bytes"), F.sum(F.col("gross_bytes") - F.col("one")).alias("repeat_bytes")
    )


def funnel(decisions: DataFrame) -> DataFrame:
    """Nested stages from every call to an economic reference, in one pass."""
    d = F.col("disposition")
    stages = [
        ("1_all", F.lit(True)),
        ("2_repeated", ~F.col("is_first")),
        ("3_identified", ~d.isin("FIRST_DELIVERY", "AMBIGUOUS_IDENTITY")),
        ("4_same_source", d.isin("UNKNOWN_EVIDENCE", "NOT_ECONOMIC", "REFERENCE")),
        ("5_safe", d.isin("NOT_ECONOMIC", "REFERENCE")),
        ("6_economic", d == "REFERENCE"),
    ]
    sums = [x for n, c in stages for x in (F.count_if(c).alias(f"c{n}"), F.coalesce(F.sum(F.when(c, F.col("n_bytes"))), F.lit(0)).alias(f"b{n}"))]
    rows = F.array(*[F.struct(F.lit(n).alias("stage"), F.col(f"c{n}").alias("calls"), F.col(f"b{n}").alias("bytes")) for n, _ in stages])
    return decisions.agg(*sums).select(F.inline(rows))


def disposition_by_family(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("tool_family", "disposition").agg(F.count("*").alias("calls"), F.sum("n_bytes").alias("bytes"), F.sum("avoided_bytes").alias("avoided_bytes"))


def recency_histogram(decisions: DataFrame) -> DataFrame:
    """Repeats by distance from the first delivery in calls and in episodes."""
    return (
        decisions.where(~F.col("is_first"))
        .groupBy(recency_bucket(F.col("call_distance")).alias("recency"), episode_bucket(F.col("episode_distance")).alias("episodes"))
        .agg(F.count("*").alias("calls"), F.sum("n_bytes").alias("bytes"))
    )
