"""Read receipts: what a session already holds of a source's view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell.functions.buckets import salience_bucket

REFERENCE = "[[READ receipt=rcpt-%04d sha256=%s bytes=%d]]"


def receipt_decisions(reads: DataFrame, source: Column, view: Column) -> DataFrame:
    """Per read: first, changed, identical but not economic, or a reference candidate.

    State is keyed by session, source and view. Reads without a source or view are decided before
    and never touch it. A repeat that is not economic does not refresh the distance.
    """
    keyed = reads.withColumn("source", source).withColumn("view", view)
    known = F.col("source").isNotNull() & F.col("view").isNotNull()
    key = W.partitionBy("session_id", "source", "view", known).orderBy("call_index")
    before = F.lag("sha").over(key)
    first = known & before.isNull()
    out = keyed.withColumn("_before", before).withColumn("is_first", first)
    number = F.sum(F.col("is_first").cast("long")).over(W.partitionBy("session_id").orderBy("call_index").rowsBetween(W.unboundedPreceding, 0))
    out = out.withColumn("_number", number).withColumn("receipt_no", F.when(known, F.first("_number").over(key)))
    changed = F.col("_before") != F.col("sha")
    size = F.octet_length(F.format_string(REFERENCE, F.col("receipt_no"), F.col("sha"), F.col("n_bytes"))).cast("long")
    decision = (
        F.when(F.col("source").isNull(), "SOURCE_UNKNOWN")
        .when(F.col("view").isNull(), "VIEW_UNKNOWN")
        .when(F.col("is_first"), "FIRST_READ")
        .when(changed, "SOURCE_CHANGED")
        .when(size >= F.col("n_bytes"), "NOT_ECONOMIC")
        .otherwise("HISTORICAL_IDENTICAL")
    )
    out = out.withColumn("reference_bytes", F.when(known, size)).withColumn("decision", decision)
    refreshed = F.last(F.when(F.col("decision") != "NOT_ECONOMIC", F.col("call_index")), ignorenulls=True).over(key.rowsBetween(W.unboundedPreceding, -1))
    out = out.withColumn("distance", F.when(known & ~F.col("is_first"), F.col("call_index") - refreshed))
    return out.withColumn("avoided_bytes", F.when(F.col("decision") == "HISTORICAL_IDENTICAL", F.col("n_bytes") - F.col("reference_bytes")).otherwise(F.lit(0).cast("long"))).drop("_before", "_number")


def salience_histogram(decisions: DataFrame) -> DataFrame:
    """Repeat reads by distance; first reads form their own row with a null bucket."""
    return decisions.groupBy(salience_bucket(F.col("distance")).alias("salience")).agg(F.count("*").alias("reads"), F.sum("n_bytes").alias("bytes"))


def receipt_manifest(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision").agg(F.count("*").alias("reads"), F.sum("n_bytes").alias("delivered_bytes"), F.sum("avoided_bytes").alias("avoided_bytes"))


def view_coverage(decisions: DataFrame) -> DataFrame:
    """Per view: reads, sources, and repeats that could have been references."""
    return decisions.groupBy("view").agg(
        F.count("*").alias("reads"), F.countDistinct("source").alias("sources"), F.count_if(F.col("decision") == "HISTORICAL_IDENTICAL").alias("candidates"), F.sum("avoided_bytes").alias("avoided_bytes")
    )


def hash_chain(entries: DataFrame, session: str, order: str, payload: Column, seed: str = "") -> DataFrame:
    """Per session: entries and head of the chain in which each hash covers the one before it.

    A chain is sequential by nature; one session's entries are folded in one row, sessions in parallel.
    """
    listed = entries.groupBy(session).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), payload.alias("payload")))).alias("entries"))
    head = F.aggregate("entries", F.lit(seed), lambda acc, e: F.sha2(F.concat_ws(":", acc, e["payload"]), 256))
    return listed.select(session, F.size("entries").cast("long").alias("entries"), head.alias("head"))
