"""Foundations that a session was given whole, and their recovery by reference.

A foundation is always delivered raw. What a session was given, and may so refer to, is a small table of receipts; the bytes
are held once for each digest, whatever the number of sessions. A reference recovers only in its own session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import contains_sensitive, occurrences
from tracewell.sources.scratch import Steps

# Names that a session may have.
SESSION = r"\A[A-Za-z0-9][A-Za-z0-9_.-]{0,127}\z"
REFERENCE = "[[FOUNDATION session=%s sha256=%s bytes=%d]]"
PATTERN = r"\A\[\[FOUNDATION session=([A-Za-z0-9][A-Za-z0-9_.-]{0,127}) sha256=([0-9a-f]{64}) bytes=([1-9]\d*)\]\]\z"
CANONICAL = "CANONICAL"


def parse_reference(text: Column) -> Column:
    """Struct of ``session``, ``sha`` and ``n_bytes``; null if the text is no reference in its one form."""
    part = lambda k: F.regexp_extract(text, PATTERN, k)
    size = part(3).try_cast("long")
    return F.when(text.rlike(PATTERN) & size.isNotNull(), F.struct(part(1).alias("session"), part(2).alias("sha"), size.alias("n_bytes")))


def canonicalize(rows: DataFrame, order: str) -> DataFrame:
    """Per delivered foundation: ``reason``, and for CANONICAL ones ``sha``, ``n_bytes``, ``reference`` and ``required``.

    ``rows`` has session_id, foundation (binary), facts (array of structs of id and value) and assessment; ``order`` is the
    column of a session's order, unique in it. ``required`` says how often each fact's digest stands in the foundation. The first eligible
    delivery of a text in a session fixes its facts; another list of facts, or the same in another order, is refused. Reasons, first match
    wins: SESSION (null or no name), INVALID_UTF8 (null, empty or not UTF-8), INVALID_FACTS (null, an id or value that is null or empty,
    an id given twice), ASSESSMENT, SENSITIVE, FACT_MISSING:<id>, CONTRACT_CHANGED.
    """
    text, facts = F.col("foundation").cast("string"), F.col("facts")
    ids = F.transform(facts, lambda f: f["id"])
    sound = F.forall(facts, lambda f: F.coalesce((f["id"] != "") & (f["value"] != ""), F.lit(False))) & (F.size(F.array_distinct(ids)) == F.size(ids))
    missing = F.get(F.filter(facts, lambda f: ~F.contains(text, f["value"])), F.lit(0))["id"]
    eligible = (
        F.when(~F.coalesce(F.col("session_id").rlike(SESSION), F.lit(False)), "SESSION")
        .when(~F.coalesce(F.is_valid_utf8(text) & (F.octet_length("foundation") > 0), F.lit(False)), "INVALID_UTF8")
        .when(~F.coalesce(sound, F.lit(False)), "INVALID_FACTS")
        .when(F.coalesce(F.col("assessment"), F.lit("UNKNOWN")) != "NON_SENSITIVE", "ASSESSMENT")
        .when(contains_sensitive(text), "SENSITIVE")
        .when(missing.isNotNull(), F.concat(F.lit("FACT_MISSING:"), missing))
    )
    d = rows.withColumn("reason", eligible).withColumn("sha", F.when(F.col("reason").isNull(), F.sha2("foundation", 256)))
    d = d.withColumn("_contract", F.when(F.col("reason").isNull(), F.sha2(F.to_json(F.transform(facts, lambda f: F.array(f["id"], f["value"]))), 256)))
    # screening is dear: rows are written once with what it says, and all that follows reads them back
    d = Steps(rows.sparkSession, "foundations").append(d.withColumn("_n", F.octet_length("foundation").cast("long")))
    # only digests go through the aggregate, and a text that a session is given over and over is one row when it is joined back
    first = d.where("reason is null").groupBy("session_id", "sha").agg(F.min_by("_contract", order).alias("_first"))
    d = d.join(first, ["session_id", "sha"], "left")
    reason = F.coalesce("reason", F.when(F.col("_contract") != F.col("_first"), "CONTRACT_CHANGED").otherwise(CANONICAL))
    d = d.withColumn("reason", reason)
    ok = lambda c: F.when(F.col("reason") == CANONICAL, c)
    n = F.col("_n")
    required = F.transform(facts, lambda f: F.struct(f["id"].alias("id"), F.sha2(f["value"], 256).alias("sha"), occurrences(text, f["value"]).alias("times")))
    return d.withColumns({"sha": ok(F.col("sha")), "n_bytes": ok(n), "reference": ok(F.format_string(REFERENCE, "session_id", "sha", n)), "required": ok(required)}).drop("_contract", "_first", "_n")


def receipts(canonical: DataFrame) -> DataFrame:
    """What each session may refer to: session_id, sha, n_bytes; no bytes."""
    return canonical.where(F.col("reason") == CANONICAL).groupBy("session_id", "sha").agg(F.min("n_bytes").alias("n_bytes"))


def contents(canonical: DataFrame) -> DataFrame:
    """The store: sha and content, once for each digest."""
    return canonical.where(F.col("reason") == CANONICAL).select("sha", F.col("foundation").alias("content")).dropDuplicates(["sha"])


def recover(references: DataFrame, given: DataFrame, store: DataFrame) -> DataFrame:
    """References (session_id, reference, and any others) with ``outcome``, and the ``content`` if every check holds.

    ``given`` is a table of :func:`receipts`, ``store`` of :func:`contents`. The first check that fails is the outcome: MALFORMED,
    CROSS_SESSION (also for a null session), UNISSUED, LENGTH_MISMATCH, MISSING (the store lost it), INTEGRITY; else RECOVERED.
    Bytes are asked for only where a receipt stands.
    """
    r = references.withColumn("_r", parse_reference(F.col("reference")))
    own = F.col("_r.session").eqNullSafe(F.col("session_id"))
    r = r.withColumn("_sha", F.when(own, F.col("_r.sha")))
    g = given.select(F.col("session_id").alias("_session"), F.col("sha").alias("_issued"), F.col("n_bytes").alias("_n"))
    r = r.join(g, (F.col("session_id") == F.col("_session")) & (F.col("_sha") == F.col("_issued")), "left")
    r = r.withColumn("_asked", F.when(F.col("_n") == F.col("_r.n_bytes"), F.col("_issued")))
    s = store.select(F.col("sha").alias("_held"), F.col("content").alias("_content"))
    r = r.join(s, F.col("_asked") == F.col("_held"), "left")
    outcome = (
        F.when(F.col("_r").isNull(), "MALFORMED")
        .when(~own, "CROSS_SESSION")
        .when(F.col("_issued").isNull(), "UNISSUED")
        .when(F.col("_asked").isNull(), "LENGTH_MISMATCH")
        .when(F.col("_content").isNull(), "MISSING")
        .when((F.octet_length("_content") != F.col("_n")) | (F.sha2("_content", 256) != F.col("_asked")), "INTEGRITY")
        .otherwise("RECOVERED")
    )
    return r.withColumn("outcome", outcome).select(*references.columns, "outcome", F.when(F.col("outcome") == "RECOVERED", F.col("_content")).alias("content"))
