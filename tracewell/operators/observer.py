"""What an observer counts over the calls of sessions: counters of a run, and one telemetry record a session.

Rows are calls with session_id, call_index, ts, episode_id, tool_family, target_path, n_bytes, exit_code, and what the shadow made of them:
``decision`` and ``avoided_bytes`` of a read (null for other calls), ``grouped`` (APPLICABLE, NO_GAIN, REJECTED or null) and ``grouped_avoided``
of a search, ``orientation`` (PRODUCED, FAILED or null) of a discovery, and ``applied``, whether what was avoided was really left out.
What was left out and what could have been are never added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tracewell.operators import feed

IDENTICAL = "HISTORICAL_IDENTICAL"
REPEATS = (IDENTICAL, "SOURCE_CHANGED", "NOT_ECONOMIC")
NO_TOKENS = {name: "UNAVAILABLE" for name in feed.NEEDED_TOKENS}


def _counters() -> dict[str, Column]:
    c = F.col
    known = lambda name: F.coalesce(c(name), F.lit(False))
    total = lambda when, what: F.coalesce(F.sum(F.when(when, what)), F.lit(0)).cast("long")
    applied, read, grouped = known("applied"), c("decision") == IDENTICAL, c("grouped") == "APPLICABLE"
    raw_read = c("decision").isNotNull() & ~F.coalesce(read & applied, F.lit(False))
    return {
        "events_seen": F.count(F.lit(1)), "discovery_queries": F.count("orientation"), "orientations_produced": F.count_if(c("orientation") == "PRODUCED"), "discovery_failures": F.count_if(c("orientation") == "FAILED"),
        "grouped_evaluated": F.count("grouped"), "grouped_eligible": F.count_if(grouped), "grouped_no_gain": F.count_if(c("grouped") == "NO_GAIN"), "grouped_rejected": F.count_if(c("grouped") == "REJECTED"),
        "grouped_transformed": F.count_if(grouped & applied), "grouped_raw": F.count_if(c("grouped").isNotNull() & ~F.coalesce(grouped & applied, F.lit(False))),
        "read_evaluations": F.count("decision"), "reference_candidates": F.count_if(read), "raw_reads": F.count_if(raw_read), "failures_kept_raw": F.count_if((c("exit_code") != 0) & ~applied),
        "actual_bytes": total(applied & read, c("avoided_bytes")) + total(applied & grouped, c("grouped_avoided")), "actual_grouped_bytes": total(applied & grouped, c("grouped_avoided")),
        "shadow_bytes": total(~applied & read, c("avoided_bytes")) + total(~applied & grouped, c("grouped_avoided")), "shadow_read_bytes": total(~applied & read, c("avoided_bytes")), "shadow_grouped_bytes": total(~applied & grouped, c("grouped_avoided")),
    }


def lab_counters(calls: DataFrame) -> DataFrame:
    """One row of counters; zeros for no calls."""
    return calls.agg(*(v.alias(k) for k, v in _counters().items()))


def observed(calls: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The calls as they are, and counters that their next action fills on its way, without a pass of their own."""
    seen = Observation(name)
    return calls.observe(seen, *(v.alias(k) for k, v in _counters().items())), seen


def session_records(calls: DataFrame, repository: str, git_head: str, worktree: str) -> DataFrame:
    """One telemetry record a session, of shadow counts alone; calls of no session make none.

    Token counts are not known here and say so. Calls are first summed by session, family and path, so that a
    session of any length reaches its record as few rows. Families outside the format count as OTHER; paths that no record
    may hold are named by their digest alone. Null byte counts count as none.
    """
    c = F.col
    is_read = c("tool_family") == "FILE_READ"
    family = F.when(c("tool_family").isin(*feed.FAMILIES), c("tool_family")).otherwise("OTHER")
    n = F.coalesce(c("n_bytes"), F.lit(0)).cast("long")
    count = lambda when: F.count_if(F.coalesce(when, F.lit(False)))
    total = lambda when, what: F.coalesce(F.sum(F.when(when, what)), F.lit(0)).cast("long")
    identical = is_read & (c("decision").isin(IDENTICAL, "NOT_ECONOMIC"))
    sums = {
        "tool_calls": F.count(F.lit(1)), "tool_output_bytes": F.sum(n), "file_read_events": count(is_read), "file_read_bytes": total(is_read, n), "first_reads": count(is_read & (c("decision") == "FIRST_READ")), "repeated_reads": count(is_read & c("decision").isin(*REPEATS)),
        "identical_reread_events": count(identical), "identical_reread_bytes": total(identical, n), "reference_candidates": count(is_read & (c("decision") == IDENTICAL)), "reference_bytes_avoided": total(is_read & (c("decision") == IDENTICAL), c("avoided_bytes")),
        "discovery_queries": F.count("orientation"), "search_events": count(c("tool_family") == "SEARCH"), "grouped_applicable": count(c("grouped") == "APPLICABLE"), "grouped_no_gain": count(c("grouped") == "NO_GAIN"), "grouped_rejected": count(c("grouped") == "REJECTED"),
        "grouped_bytes_avoided": total(c("grouped") == "APPLICABLE", c("grouped_avoided")), "proven_search_events": count(c("grouped").isin("APPLICABLE", "NO_GAIN")),
    }
    parts = calls.where("session_id is not null").groupBy("session_id", family.alias("family"), F.when(is_read, c("target_path")).alias("path")).agg(
        *(v.alias(k) for k, v in sums.items()), F.min("ts").alias("first"), F.max("ts").alias("last"), F.collect_set("episode_id").alias("episodes"), count(is_read).alias("reads")
    )
    seen = F.struct(c("tool_output_bytes").alias("bytes"), F.when(feed.clean_path(c("path")), c("path")).alias("path"), F.sha2("path", 256).alias("path_hash"), c("reads").alias("read_events"))
    by_family = F.map_from_entries(F.array(*(F.struct(F.lit(f).alias("k"), F.coalesce(F.sum(F.when(c("family") == f, c("tool_output_bytes"))), F.lit(0)).alias("v")) for f in feed.FAMILIES)))
    s = parts.groupBy("session_id").agg(
        *(F.sum(k).alias(k) for k in sums), F.min("first").alias("first"), F.max("last").alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("episodes")))).cast("long").alias("turns"),
        F.map_filter(by_family, lambda k, v: v > 0).alias("family_bytes"), F.array_sort(F.collect_list(F.when(c("path").isNotNull(), seen)), lambda a, b: F.when(a["path_hash"] < b["path_hash"], -1).otherwise(1)).alias("paths"),
    )
    time = lambda t: F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    waste = F.map_filter(F.create_map(*(x for name, k in (("REEXPOSURE_WASTE_CANDIDATE", "reference_candidates"), ("DISCOVERY_WASTE_CANDIDATE", "discovery_queries"), ("REPRESENTATION_WASTE_CANDIDATE", "grouped_applicable")) for x in (F.lit(name), c(k)))), lambda k, v: v > 0)
    tokens = F.create_map(*(x for name, quality in NO_TOKENS.items() for x in (F.lit(name), F.struct(F.lit(None).cast("long").alias("basis_bytes"), F.lit(quality).alias("quality"), F.lit(None).cast("long").alias("value")))))
    given = {
        "session_id_hash": feed.private_id(c("session_id")), "start_time": time(c("first")), "end_time": time(c("last")), "repository_id": F.lit(repository), "git_head": F.lit(git_head), "worktree_fingerprint": F.lit(worktree), "schema_version": F.lit(feed.VERSION),
        "live_class": F.lit("HISTORICAL_REPLAY"), "outcome": F.lit("PARTIAL"), "waste_counts": waste, "token_measurements": tokens, **{f: F.lit(False) for f in feed.FLAGS},
    }
    made = {*sums, *given, "turns", "family_bytes", "paths"}
    fields = [(given[f] if f in given else c(f) if f in made else F.lit(0) if f in feed.COUNTS else F.lit(None)).cast(feed.SCHEMA[f]).alias(f) for f in feed.FIELDS]
    return s.select(*fields)
