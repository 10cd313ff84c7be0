"""References delivered in place of repeated reads, and their expansion back to the bytes.

A session holds, for each source and view, the bytes of its latest read that was assessed as not
sensitive; its receipt stands for them. A repeat may be delivered as a reference only if what is held
is what was read. Expansion finds what the receipt stood for when the reference was given, and checks
every part of it; whatever does not hold is delivered raw, or not expanded, with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell.operators.receipts import REFERENCE, receipt_decisions

#: The parts of a reference, in order.
PATTERN = r"\A\[\[READ receipt=rcpt-(\d{4,}) sha256=([0-9a-f]{64}) bytes=(0|[1-9]\d*)\]\]\z"
NOT_SENSITIVE = "NON_SENSITIVE"


def parse_reference(text: Column) -> Column:
    """Struct of ``receipt_no``, ``sha`` and ``n_bytes``; null if the text is no reference in its one form."""
    part = lambda k: F.regexp_extract(text, PATTERN, k)
    number, size = part(1).try_cast("long"), part(3).try_cast("long")
    padded = F.format_string("%04d", number) == part(1)  # no further zeros
    return F.when(text.rlike(PATTERN) & number.isNotNull() & size.isNotNull() & padded, F.struct(number.alias("receipt_no"), part(2).alias("sha"), size.alias("n_bytes")))


def deliver(reads: DataFrame, source: Column, view: Column, sensitivity: Column, treatment: Column, enabled: Column, observed: Column) -> DataFrame:
    """Per read (session_id, call_index, sha, n_bytes): ``delivery`` RAW or READREF, ``reason``, ``reference``, and ``held``.

    ``sensitivity`` must say NON_SENSITIVE for bytes to be kept or replaced, null does not; without ``treatment`` nothing is
    kept or replaced, without ``enabled`` nothing is replaced; ``observed``, the session that is seen to read, must be the session
    or null. ``held`` says whether the read's bytes are what its receipt stands for from then on.
    """
    gate = {"_safe": F.coalesce(sensitivity == NOT_SENSITIVE, F.lit(False)), "_treated": F.coalesce(treatment, F.lit(False)), "_on": F.coalesce(enabled, F.lit(False)), "_own": F.coalesce(observed == F.col("session_id"), F.lit(True))}
    d = receipt_decisions(reads.withColumns(gate), source, view)
    known = F.col("receipt_no").isNotNull()
    d = d.withColumn("held", known & F.col("_safe") & F.col("_treated") & F.col("_own"))
    earlier = W.partitionBy("session_id", "receipt_no", known).orderBy("call_index").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("_kept", F.last(F.when(F.col("held"), F.struct("sha", "n_bytes")), ignorenulls=True).over(earlier))
    same = (F.col("_kept.sha") == F.col("sha")) & (F.col("_kept.n_bytes") == F.col("n_bytes"))
    reason = (
        F.when(~F.col("_own"), "CROSS_SESSION_FORBIDDEN")
        .when(~F.col("_treated"), "CONTROL")
        .when(~F.col("_on"), "SWITCHED_OFF")
        .when(~F.col("_safe"), "NOT_ASSESSED_SAFE")
        .when(F.col("decision") != "HISTORICAL_IDENTICAL", F.col("decision"))
        .when(F.col("_kept").isNull(), "MISSING_RECEIPT")
        .when(~same, "RECEIPT_MISMATCH")
        .otherwise("EXACT_REFERENCE")
    )
    d = d.withColumn("reason", reason).withColumn("delivery", F.when(reason == "EXACT_REFERENCE", "READREF").otherwise("RAW"))
    reference = F.when(F.col("delivery") == "READREF", F.format_string(REFERENCE, F.col("receipt_no"), F.col("sha"), F.col("n_bytes")))
    return d.withColumn("reference", reference).drop("_safe", "_treated", "_on", "_own", "_kept")


def expand(references: DataFrame, delivered: DataFrame, content: str) -> DataFrame:
    """Per reference (session_id, call_index, reference): ``outcome``, and the ``content`` it stands for if all checks hold.

    ``delivered`` is what :func:`deliver` gave, with the bytes as ``content``. The receipt is the one of the
    reference's own session, as it stood before its call; a receipt of another session is not found. Only the places of
    receipts go through the window; bytes are fetched by an equal join at the end.
    """
    r = references.select("session_id", "call_index", "reference", parse_reference(F.col("reference")).alias("_r"))
    asked = r.select("session_id", F.col("_r.receipt_no").alias("receipt_no"), "call_index", F.lit(None).cast("long").alias("_at"), F.lit(True).alias("_asks"), "reference", "_r")
    kept = delivered.where("held")
    given = kept.select("session_id", "receipt_no", "call_index", F.col("call_index").alias("_at"), F.lit(False).alias("_asks"), F.lit(None).cast("string").alias("reference"), F.lit(None).cast(asked.schema["_r"].dataType).alias("_r"))
    # a receipt given at the call itself comes after the reference
    order = W.partitionBy("session_id", "receipt_no").orderBy("call_index", F.desc("_asks")).rowsBetween(W.unboundedPreceding, 0)
    found = asked.where("_r is not null").union(given).withColumn("_at", F.last("_at", ignorenulls=True).over(order)).where("_asks")
    store = kept.select("session_id", "receipt_no", F.col("call_index").alias("_at"), F.col("sha").alias("_sha"), F.col(content).alias("content"))
    whole = found.union(asked.where("_r is null")).join(store, ["session_id", "receipt_no", "_at"], "left")
    outcome = (
        F.when(F.col("_r").isNull(), "NO_REFERENCE")
        .when(F.col("_at").isNull(), "UNKNOWN_RECEIPT")
        .when(F.col("_sha") != F.col("_r.sha"), "METADATA_MISMATCH")
        .when(~F.col("content").isNotNull() | (F.octet_length("content") != F.col("_r.n_bytes")), "LENGTH_MISMATCH")
        .when(F.sha2(F.col("content").cast("binary"), 256) != F.col("_r.sha"), "DIGEST_MISMATCH")
        .otherwise("EXPANDED")
    )
    return whole.withColumn("outcome", outcome).select("session_id", "call_index", "reference", "outcome", F.when(F.col("outcome") == "EXPANDED", F.col("content")).alias("content"))
