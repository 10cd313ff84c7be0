"""Telemetry records: one a session, checked field by field, serialised in one way, rolled up without mixing measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Closed sets, formats and the version of a record.
VERSION = "FEED_V1"
QUALITIES = ("PROVIDER_REPORTED_EXACT", "RUNTIME_REPORTED_EXACT", "DERIVED_FROM_EXACT_ACCOUNTING", "ESTIMATED_BYTES_DIV_4", "UNAVAILABLE")
LIVE = ("REAL_FULL_SESSION", "REAL_PARTIAL_SESSION", "CONTROLLED_LIVE_LAB", "HISTORICAL_REPLAY", "SYNTHETIC")
OUTCOMES = ("VERIFIED_COMPLETED", "VERIFIED_FAILED", "PARTIAL", "UNKNOWN")
WASTE = ("DISCOVERY_WASTE_CANDIDATE", "REEXPOSURE_WASTE_CANDIDATE", "REPRESENTATION_WASTE_CANDIDATE", "HANDOFF_REDUNDANCY_CANDIDATE")
FAMILIES = ("FILE_READ", "SEARCH", "TEST", "SCRIPT", "GIT", "BUILD", "OTHER")
TOKENS = ("input_tokens", "output_tokens", "cached_input_tokens", "reasoning_tokens")
NEEDED_TOKENS = TOKENS[:3]
HEX64, HEX40 = r"^[0-9a-f]{64}$", r"^[0-9a-f]{40}$"
TIMESTAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,9})?Z$"
COUNTS = (
    "corrective_rereads", "discovery_queries", "file_read_bytes", "file_read_events", "first_reads", "grouped_applicable", "grouped_applied", "grouped_bytes_avoided", "grouped_no_gain", "grouped_rejected",
    "identical_reread_bytes", "identical_reread_events", "proven_events", "proven_search_events", "reference_bytes_avoided", "reference_candidates", "repeated_reads", "search_events", "tool_calls", "tool_output_bytes",
)
FLAGS = ("active_suppression", "auto_selection", "behaviour_changed")
SCHEMA = {
    **{c: "bigint" for c in COUNTS}, **{f: "boolean" for f in FLAGS},
    "end_time": "string", "family_bytes": "map<string,bigint>", "first_target_position": "bigint", "git_head": "string", "live_class": "string", "model": "string", "outcome": "string",
    "paths": "array<struct<bytes:bigint,path:string,path_hash:string,read_events:bigint>>", "repository_id": "string", "run_id_hash": "string", "schema_version": "string", "session_id_hash": "string", "start_time": "string", "task_hash": "string",
    "token_measurements": "map<string,struct<basis_bytes:bigint,quality:string,value:bigint>>", "turns": "bigint", "waste_counts": "map<string,bigint>", "worktree_fingerprint": "string",
}
FIELDS = tuple(sorted(SCHEMA))
DDL = ", ".join(f"{f} {SCHEMA[f]}" for f in FIELDS)


def private_id(value: Column) -> Column:
    """A portable name that tells nothing of the value."""
    return F.when(F.length(value) > 0, F.sha2(value, 256))


def serialize(records: DataFrame) -> Column:
    """One line of JSON: sorted keys, no spaces, nulls spelled out, a line feed."""
    kinds = dict(records.dtypes)
    value = lambda f: F.map_from_entries(F.array_sort(F.map_entries(f))).alias(f) if kinds[f].startswith("map") else F.col(f)
    return F.concat(F.to_json(F.struct(*[value(f) for f in FIELDS]), {"ignoreNullFields": "false"}), F.lit("\n"))


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """The record of each line and ``error``: null, or why there is none. Keys must be exactly the known ones, once each."""
    r = lines.withColumn("record", F.from_json(F.col(column), DDL)).withColumn("_keys", F.json_object_keys(F.col(column)))
    known = F.array(*map(F.lit, FIELDS))
    error = (
        F.when(F.col("_keys").isNull() | F.col("record").isNull(), "NOT_AN_OBJECT")
        .when(F.size("_keys") != F.size(F.array_distinct("_keys")), "DUPLICATE_KEYS")
        .when(F.array_sort("_keys") != known, "WRONG_FIELDS")
        .when(F.col("record.schema_version") != VERSION, "UNSUPPORTED_VERSION")
    )
    return r.withColumn("error", error).withColumn("record", F.when(F.col("error").isNull(), F.col("record"))).drop("_keys")


def clean_path(path: Column) -> Column:
    """Relative, inside the repository, without control characters, of bounded length; null is allowed."""
    tidy = F.replace(path, F.lit("\\"), F.lit("/"))
    bad = (path == "") | (F.length(path) > 1024) | path.rlike(r"[\x00\r\n]") | tidy.rlike(r"^/|^[A-Za-z]:|(?:^|/)\.\.(?:/|$)")
    return path.isNull() | ~bad


def violations(r: Column) -> Column:
    """Every broken rule of a record, in order."""
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, x: a + x)
    hashed = lambda c, needed: F.coalesce(c.rlike(HEX64), F.lit(not needed))
    bad_token = lambda name, m: (
        ~(name.isin(*TOKENS) | name.rlike(r"^other_provider_[a-z0-9_]{1,64}_tokens$"))
        | F.coalesce(~m["quality"].isin(*QUALITIES), F.lit(True))
        | F.when(m["quality"] == "UNAVAILABLE", m["value"].isNotNull() | m["basis_bytes"].isNotNull()).otherwise(
            F.coalesce(m["value"] < 0, F.lit(True)) | F.when(m["quality"] == "ESTIMATED_BYTES_DIV_4", F.coalesce(m["basis_bytes"] < 0, F.lit(True))).otherwise(m["basis_bytes"].isNotNull())
        )
    )
    known = lambda m, allowed: F.forall(F.map_keys(m), lambda k: k.isin(*allowed)) & F.forall(F.map_values(m), lambda v: v >= 0)
    rules = (
        ("SESSION_HASH", hashed(r["session_id_hash"], True)), ("RUN_HASH", hashed(r["run_id_hash"], False)), ("WORKTREE", hashed(r["worktree_fingerprint"], True)), ("TASK_HASH", hashed(r["task_hash"], False)),
        ("GIT_HEAD", r["git_head"].rlike(HEX40)), ("REPOSITORY", r["repository_id"].rlike(r"^[^/\s]+/[^/\s]+$")), ("MODEL", r["model"].isNull() | r["model"].rlike(r"^[A-Za-z0-9][A-Za-z0-9._:/-]{0,127}$")),
        ("TIMES", r["start_time"].rlike(TIMESTAMP) & r["end_time"].rlike(TIMESTAMP)), ("LIVE_CLASS", r["live_class"].isin(*LIVE)), ("OUTCOME", r["outcome"].isin(*OUTCOMES)),
        ("TOKENS_MISSING", F.size(F.array_except(F.array(*map(F.lit, NEEDED_TOKENS)), F.map_keys(r["token_measurements"]))) == 0),
        ("TOKEN_MEASUREMENT", ~F.exists(F.map_entries(r["token_measurements"]), lambda e: bad_token(e["key"], e["value"]))),
        ("COUNTS", F.forall(F.array(*[r[c] for c in COUNTS]), lambda v: v >= 0)), ("TURNS", F.coalesce(r["turns"] >= 0, F.lit(True)) & F.coalesce(r["first_target_position"] >= 0, F.lit(True))),
        ("FAMILIES", known(r["family_bytes"], FAMILIES)), ("FAMILY_SUM", total(r["family_bytes"]) == r["tool_output_bytes"]),
        ("READ_BYTES", r["file_read_bytes"] <= r["tool_output_bytes"]), ("READ_EVENTS", r["file_read_events"] <= r["tool_calls"]), ("CLASSIFIED_READS", r["first_reads"] + r["repeated_reads"] <= r["file_read_events"]),
        ("IDENTICAL_EVENTS", r["identical_reread_events"] <= r["repeated_reads"]), ("IDENTICAL_BYTES", r["identical_reread_bytes"] <= r["file_read_bytes"]), ("PROVEN", r["proven_events"] <= r["identical_reread_events"]),
        ("CANDIDATES", r["reference_candidates"] <= r["identical_reread_events"]), ("REFERENCE_BYTES", r["reference_bytes_avoided"] <= r["identical_reread_bytes"]), ("SEARCHES", r["search_events"] <= r["tool_calls"]),
        ("PROVEN_SEARCHES", r["proven_search_events"] <= r["search_events"]), ("GROUPED", r["grouped_applicable"] + r["grouped_no_gain"] + r["grouped_rejected"] <= r["search_events"]), ("GROUPED_BYTES", r["grouped_bytes_avoided"] <= r["tool_output_bytes"]),
        ("SHADOW_ONLY", ~(r["active_suppression"] | r["auto_selection"] | r["behaviour_changed"]) & (r["grouped_applied"] == 0)), ("WASTE", known(r["waste_counts"], WASTE)),
        ("PATHS", F.forall(r["paths"], lambda p: clean_path(p["path"]) & F.coalesce(p["path_hash"].rlike(HEX64), F.lit(False)) & (p["read_events"] >= 0) & (p["bytes"] >= 0))),
    )
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules]))


def roll_up(records: DataFrame) -> DataFrame:
    """(measure, name, total): sums that add, token sums by how they were measured, counts of classes and waste."""
    r = records
    row = lambda df, measure: df.select(F.lit(measure).alias("measure"), "name", F.col("total").cast("long").alias("total"))
    sums = r.agg(*[F.sum(c).alias(c) for c in COUNTS], F.count("*").alias("records"), F.countDistinct("session_id_hash").alias("sessions"))
    flat = sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("total")) for c in (*COUNTS, "records", "sessions")])))
    spread = lambda m: r.select(F.explode(m).alias("name", "v"))
    counted = lambda c: r.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("total"))
    tokens = spread("token_measurements").groupBy(F.concat_ws(":", "name", "v.quality").alias("name"), (F.col("v.quality") == "UNAVAILABLE").alias("none")).agg(F.when(F.first("v.quality") == "UNAVAILABLE", F.count("*")).otherwise(F.sum(F.coalesce("v.value", F.lit(0)))).alias("total"))
    parts = [
        row(flat, "sum"), row(tokens.where(~F.col("none")), "tokens"), row(tokens.where("none"), "tokens_unavailable"),
        row(spread("family_bytes").groupBy("name").agg(F.sum("v").alias("total")), "family_bytes"), row(spread("waste_counts").groupBy("name").agg(F.sum("v").alias("total")), "waste"),
        row(counted("outcome"), "outcome"), row(counted("live_class"), "live_class"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dominant_families(records: DataFrame) -> DataFrame:
    """Families by bytes, most first; equal ones by name."""
    return records.select(F.explode("family_bytes").alias("family", "v")).groupBy("family").agg(F.sum("v").alias("bytes")).orderBy(F.desc("bytes"), "family")


def repeated_paths(records: DataFrame) -> DataFrame:
    """Paths read more than once, most read first; equal ones by digest, then path, a missing one first."""
    p = records.select(F.inline("paths")).groupBy("path_hash", "path").agg(F.sum("read_events").alias("read_events"), F.sum("bytes").alias("bytes"))
    return p.where(F.col("read_events") > 1).orderBy(F.desc("read_events"), "path_hash", F.coalesce("path", F.lit("")))
