"""Labelled corpora: reading, migrating, checking and serialising entries, and safety by provenance of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import policy
from tracewell.functions.text import occurrences
from tracewell.sources.lines import numbered_lines

# Schema versions and closed sets of an entry.
VERSION, OLD_VERSION = 4, 3
ELIGIBILITY = ("SAFE_TO_REDUCE", "RAW_REQUIRED", "UNKNOWN")
PROTECTED = ("AUTHORITY", "SECURITY", "FAILURE", "CANONICAL_STATE")
BUCKETS = ("DUPLICATED_HEADERS", "REPETITIVE_PROGRESS", "KNOWN_SUCCESS_RECORDS", "STRUCTURED_TABULAR_REPETITION", "SEPARATOR_NOISE", "DIRECTORY_OR_PATH_REDUNDANCY", "OTHER")
PROVENANCE = ("HUMAN_REVIEW", "INDEPENDENT_REVIEW", "SYNTHETIC_FIXTURE")
SCREENING = ("DETECTOR_MATCH", "DETECTOR_NO_MATCH", "NOT_SCREENED", "EXPLICIT_NON_SENSITIVE")
SENSITIVITY = ("NOT_SENSITIVE", "SENSITIVE_SECRET", "SENSITIVE_PII", "UNKNOWN")
LABEL = "evidence_class string, transform_eligibility string, inline_required_facts array<string>, missed_opportunity_category string"
ENTRY = (
    "schema_version int, entry_id string, source_data struct<command:string,exit_code:int,stream:string,raw_content_b64:string,raw_ref_path:string,byte_length:bigint,truncated:boolean>, "
    "sensitivity_screening struct<result:string,method:string>, "
    "heuristic_suggestion struct<evidence_class:string,transform_eligibility:string,inline_required_facts:array<string>,missed_opportunity_category:string,method:string>, "
    "oracle_labels struct<evidence_class:string,transform_eligibility:string,inline_required_facts:array<string>,missed_opportunity_category:string,provenance:string,reviewer_id:string,review_protocol:string,sensitivity:string>, tags array<string>"
)


def parse_entries(lines: DataFrame, migrate: bool = False) -> DataFrame:
    """``line_no`` and the entry of every line that is not blank or a remark; ``error`` says why there is none.

    Entries of the old version are refused unless ``migrate``: then their reviewed labels become
    suggestions, as nothing tells who reviewed them.
    """
    kept = lines.where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    e = kept.select("line_no", F.from_json("value", ENTRY).alias("e"), F.json_object_keys("value").alias("k"))
    version = F.col("e.schema_version")
    error = F.when(F.col("k").isNull() | F.col("e").isNull(), "MALFORMED").when(version == VERSION, None).when((version == OLD_VERSION) & F.lit(migrate), None).otherwise("UNSUPPORTED_VERSION")
    e = e.withColumn("error", error).select("line_no", "error", F.when(F.col("error").isNull(), F.col("e")).alias("e")).select("line_no", "error", "e.*")
    old = F.col("schema_version") == OLD_VERSION
    label = F.col("oracle_labels")
    demoted = F.struct(*[label[f].alias(f) for f in ("evidence_class", "transform_eligibility", "inline_required_facts", "missed_opportunity_category")], F.lit("V3_MIGRATED_LABEL").alias("method"))
    return e.withColumn("heuristic_suggestion", F.when(old & label.isNotNull(), demoted).otherwise(F.col("heuristic_suggestion"))).withColumn("oracle_labels", F.when(~F.coalesce(old, F.lit(False)), label)).withColumn("schema_version", F.when(old, VERSION).otherwise(F.col("schema_version")))


def read_corpus(spark: SparkSession, path: str, migrate: bool = False, base: str | None = None) -> DataFrame:
    """All entries of files of JSON lines, with their bytes; a bad line fails the job with its file and number.

    ``base`` is the folder that entries name their bytes in; without it only inline bytes are found.
    """
    lines = numbered_lines(spark, path)
    e = parse_entries(lines.select(F.struct("file", "line_no").alias("line_no"), "value"), migrate).select("line_no.file", "line_no.line_no", *[c for c in parse_entries(lines, migrate).columns if c != "line_no"])
    e = with_bytes(e, None if base is None else stored_bytes(spark, base))
    bad = F.concat_ws("; ", F.col("error"), F.array_join(problems(), "; "))
    where = F.concat(F.col("file"), F.lit(":"), F.col("line_no").cast("string"))
    return e.withColumn("entry_id", F.when(bad != "", F.raise_error(F.concat(F.lit("bad entry at "), where, F.lit(": "), bad))).otherwise(F.col("entry_id")))


def stored_bytes(spark: SparkSession, base: str) -> DataFrame:
    """``path`` below ``base`` and ``content`` of every file there."""
    folder = base.rstrip("/").split(":", 1)[-1]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    return files.select(F.substring_index(F.col("path"), folder + "/", -1).alias("path"), "content")


def with_bytes(entries: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Adds ``raw``: the inline bytes, else those of the file (path, content) that the entry names; null if there are
    none, if the inline ones are no base64, or if both are given. A path that is absolute or leads upwards names none."""
    inline, named = F.col("source_data.raw_content_b64"), F.col("source_data.raw_ref_path")
    own = F.try_to_binary(inline, F.lit("base64"))
    if files is None:
        return entries.withColumn("raw", own)
    plain = F.when(inline.isNull() & ~named.rlike(r"^[/\\]|(^|[/\\])\.\.([/\\]|$)|^[A-Za-z]:"), named)
    found = files.select(F.col("path").alias("_path"), F.col("content").alias("_content"))
    return entries.join(found, plain == F.col("_path"), "left").withColumn("raw", F.when(named.isNull(), own).otherwise(F.col("_content"))).drop("_path", "_content")


def _label_problems(name: str, label: Column, raw: Column) -> list[tuple[str, Column]]:
    facts = F.coalesce(label["inline_required_facts"], F.array().cast("array<string>"))
    eligible, bucket = label["transform_eligibility"], label["missed_opportunity_category"]
    often = lambda f: F.size(F.filter(facts, lambda x: x == f))
    return [
        (f"{name}_CLASS", label["evidence_class"].isin(*policy.CLASSES)), (f"{name}_ELIGIBILITY", eligible.isin(*ELIGIBILITY)), (f"{name}_BUCKET", bucket.isNull() | bucket.isin(*BUCKETS)),
        (f"{name}_BUCKET_WITHOUT_SAFE", bucket.isNull() | (eligible == "SAFE_TO_REDUCE")), (f"{name}_PROTECTED_SAFE", ~((eligible == "SAFE_TO_REDUCE") & label["evidence_class"].isin(*PROTECTED))),
        (f"{name}_FACTS", F.forall(facts, lambda f: F.coalesce(f != "", F.lit(False)))), (f"{name}_FACT_ABSENT", raw.isNull() | F.forall(facts, lambda f: occurrences(raw.cast("string"), f) >= often(f))),
    ]


def problems() -> Column:
    """Every rule that an entry with ``raw`` breaks, in order."""
    src, screen, h, o, raw = (F.col(c) for c in ("source_data", "sensitivity_screening", "heuristic_suggestion", "oracle_labels", "raw"))
    rules = [
        ("VERSION", F.col("schema_version") == VERSION), ("ENTRY_ID", F.length("entry_id") > 0), ("ONE_SOURCE", src["raw_content_b64"].isNull() != src["raw_ref_path"].isNull()), ("BYTES", src["raw_content_b64"].isNull() | raw.isNotNull()),
        ("LENGTH", raw.isNull() | (src["byte_length"] == F.octet_length(raw))), ("SCREENING", screen["result"].isin(*SCREENING)), ("SCREENING_METHOD", ~screen["result"].startswith("DETECTOR_") | (F.length(screen["method"]) > 0)), ("NO_LABELS", h.isNotNull() | o.isNotNull()),
    ]
    rules += [(n, h.isNull() | ok) for n, ok in (*_label_problems("HEURISTIC", h, raw), ("HEURISTIC_METHOD", F.length(h["method"]) > 0))]
    rules += [
        (n, o.isNull() | ok)
        for n, ok in (
            *_label_problems("ORACLE", o, raw), ("ORACLE_PROVENANCE", o["provenance"].isin(*PROVENANCE)), ("ORACLE_REVIEWER", F.length(o["reviewer_id"]) > 0), ("ORACLE_PROTOCOL", F.length(o["review_protocol"]) > 0),
            ("ORACLE_SENSITIVITY", o["sensitivity"].isin(*SENSITIVITY)), ("ORACLE_SENSITIVE_SAFE", ~(o["sensitivity"].isin(*SENSITIVITY[1:3]) & (o["transform_eligibility"] == "SAFE_TO_REDUCE"))),
        )
    ]
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), n) for n, ok in rules]))


def to_line(include_raw: bool = True) -> Column:
    """An entry as JSON; without its bytes only their length stays."""
    src = F.col("source_data") if include_raw else F.col("source_data").dropFields("raw_content_b64")
    return F.to_json(F.struct("schema_version", "entry_id", src.alias("source_data"), "sensitivity_screening", "heuristic_suggestion", "oracle_labels", "tags"))


def label_scopes(entries: DataFrame) -> DataFrame:
    """One row for each label of an entry, under a scope that names where it comes from."""
    o, h = F.col("oracle_labels"), F.col("heuristic_suggestion")
    view = lambda scope, l, s: F.struct(scope.alias("scope"), *[l[f].alias(f) for f in ("evidence_class", "transform_eligibility", "inline_required_facts", "missed_opportunity_category")], s.alias("label_sensitivity"))  # noqa: E731, E741
    rows = F.array_compact(F.array(F.when(o.isNotNull(), view(F.concat(F.lit("ORACLE:"), o["provenance"]), o, o["sensitivity"])), F.when(h.isNotNull(), view(F.concat(F.lit("HEURISTIC:"), h["method"]), h, F.lit("UNKNOWN")))))
    return entries.select("*", F.inline(rows))


def safety_outcome(views: DataFrame) -> DataFrame:
    """The first outcome that holds of each label view: leak, dangerous transform, missed, uncertain, match.

    ``views`` has a label's columns beside ``disposition``, ``persistence``, ``visible`` and ``content``.
    """
    eligible, secret = F.col("transform_eligibility"), F.col("label_sensitivity").isin(*SENSITIVITY[1:3])
    facts = F.coalesce("inline_required_facts", F.array().cast("array<string>"))
    kept = F.forall(facts, lambda f: occurrences(F.col("visible"), f) >= F.size(F.filter(facts, lambda x: x == f)))
    done = F.col("disposition") == "TRANSFORM"
    needed = (eligible == "RAW_REQUIRED") | F.col("evidence_class").isin(*PROTECTED) | secret
    outcome = (
        F.when(secret & (F.col("persistence") == "PERSIST"), "UNSAFE_SENSITIVITY_LEAK")
        .when(done & (needed | ~kept), "DANGEROUS_TRANSFORM")
        .when((eligible == "SAFE_TO_REDUCE") & ~done, "SAFE_OPPORTUNITY_MISSED")
        .when(eligible == "UNKNOWN", "LABEL_UNCERTAIN")
        .otherwise("SAFE_MATCH")
    )
    bucket = F.when(F.col("missed_opportunity_category").isin(*BUCKETS), F.col("missed_opportunity_category")).otherwise("OTHER")
    return views.withColumn("outcome", outcome).withColumn("bucket", F.when(F.col("outcome") == "SAFE_OPPORTUNITY_MISSED", bucket))


def bucket_report(outcomes: DataFrame) -> DataFrame:
    """Missed opportunities by scope and bucket: entries, bytes, estimated tokens and share of the scope's bytes."""
    missed = outcomes.where(F.col("bucket").isNotNull()).groupBy("scope", "bucket").agg(F.count("*").alias("entries"), F.sum("n_bytes").alias("bytes"))
    total = missed.groupBy("scope").agg(F.sum("bytes").alias("all_bytes"))
    return missed.join(total, "scope").select("scope", "bucket", "entries", "bytes", (F.col("bytes") / 4.0).alias("tokens_estimate"), F.round(F.col("bytes") * 100.0 / F.col("all_bytes"), 2).alias("share_pct"))


def sidecar(reviews: DataFrame) -> DataFrame:
    """Reviews as a sidecar holds them; one that carries a payload fails the job."""
    allowed = {"entry_id", "raw_sha256", "oracle_labels", "sensitivity_assessment"}
    extra = sorted(set(reviews.columns) - allowed)
    if extra:
        raise ValueError(f"a sidecar must not hold {', '.join(extra)}")
    return reviews


def unknown_reviews(entries: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews of entries that do not exist: each is an error."""
    return reviews.join(entries.select("entry_id").distinct(), "entry_id", "left_anti")
