"""Corpora out of session logs: strata, suggested labels, clean search outputs and why others are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Strata and how many of fifty each should give.
TARGETS = {"git": 8, "search": 8, "file_read": 8, "dir_list": 6, "test_success": 6, "test_failure": 6, "progress_build": 4, "script_or_unknown": 4}
_STRATA = (
    ("git", ("git ", "git.exe")),
    ("dir_list", ("rg --files", "dir ", "get-childitem", "ls ", "find ")),
    ("search", ("rg ", "grep ")),
    ("file_read", ("get-content", "cat ", "read_file", "type ")),
)
_TESTS = ("pytest", "python -m unittest", "cargo test", "npm test")
_PROGRESS = ("building", "downloading", "fetching", "progress", "installing")


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def test_failure(output: Column) -> Column:
    """Evidence of a failed test; a count of zero is none."""
    return (
        output.rlike(r"(?i)(?:^|\s)[1-9]\d*\s+(?:failed|failures?|errors?)(?:$|[^A-Za-z0-9_])")
        | output.rlike(r"(?:^|\n)FAILED(?:\s|$)")
        | F.contains(output, F.lit("Traceback (most recent call last)"))
        | output.rlike(r"(?:^|\n)(?:AssertionError|ERROR:)(?:\s|$)")
    )


def stratum(command: Column, output: Column, exit_code: Column) -> Column:
    low = F.lower(command)
    out = F.when(_any(low, _TESTS), F.when(F.coalesce(exit_code != 0, F.lit(False)) | test_failure(output), "test_failure").otherwise("test_success"))
    for name, words in _STRATA:
        out = out.when(_any(low, words), name)
    return out.when(_any(F.lower(output), _PROGRESS), "progress_build").otherwise("script_or_unknown")


def suggested_label(kind: Column, exit_code: Column) -> Column:
    """Class, eligibility and missed-opportunity bucket that a review starts from."""
    row = lambda cls, eligible, bucket=None: F.struct(F.lit(cls).alias("evidence"), F.lit(eligible).alias("eligibility"), F.lit(bucket).cast("string").alias("bucket"))
    raw, safe = "RAW_REQUIRED", "SAFE_TO_REDUCE"
    return (
        F.when(F.coalesce(exit_code != 0, F.lit(False)), row("FAILURE", raw))
        .when(kind == "git", row("CANONICAL_STATE", raw))
        .when(kind == "test_success", row("SUCCESS_SUMMARY", safe, "KNOWN_SUCCESS_RECORDS"))
        .when(kind == "test_failure", row("FAILURE", raw))
        .when(kind == "dir_list", row("DISCOVERY", safe, "DIRECTORY_OR_PATH_REDUNDANCY"))
        .when(kind == "progress_build", row("PROGRESS", safe, "REPETITIVE_PROGRESS"))
        .when(kind == "search", row("DISCOVERY", safe, "DUPLICATED_HEADERS"))
        .when(kind == "file_read", row("CANONICAL_STATE", raw))
        .otherwise(row("UNKNOWN", raw))
    )


def stratified(rows: DataFrame, kind: str, order: str, targets: dict[str, int]) -> DataFrame:
    """Evenly spaced rows of every stratum, as many as its target: places int(i * n / target).

    Rows are numbered through counts of fixed order ranges, so no stratum is sorted in one task.
    """
    goal = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])[F.col(kind)]
    numbered = number_within(rows, kind, order, place="_place", size="_size").withColumn("_target", F.coalesce(goal, F.lit(0)))
    wanted = F.transform(F.sequence(F.lit(0), F.greatest(F.col("_target"), F.lit(1)) - 1), lambda i: F.floor(i * F.col("_size") / F.col("_target")).cast("long"))
    kept = numbered.where((F.col("_target") > 0) & ((F.col("_size") <= F.col("_target")) | F.array_contains(wanted, F.col("_place"))))
    return kept.drop("_target", "_place", "_size")


def number_within(rows: DataFrame, key: str, order: str, width: int = 1 << 16, place: str = "place", size: str = "n") -> DataFrame:
    """``place`` of each row among its key's by an integer ``order``, from 0, and ``size``, the key's rows.

    Rows are counted by ranges of ``order``; only a range is sorted in a task, and the ranges before
    it are a running sum over counts. A hot key is so spread over all its ranges. Rows without an order
    come first, as a sort puts them; among themselves they are spread over ``width`` ranges by their content,
    and rows that are equal in all columns share a range. The result's two columns must be new to the rows.
    """
    if {place, size} & set(rows.columns):
        raise ValueError(f"the rows have a column {place} or {size}; name others")
    spread = F.pmod(F.xxhash64(*[rows[c].cast("string") for c in rows.columns]), F.lit(width))
    ranged = rows.withColumns({"_range": F.when(F.col(order).isNull(), spread).otherwise(F.floor(F.col(order) / width)), "_placed": F.col(order).isNotNull()})
    by = ["_placed", "_range"]
    counts = ranged.groupBy(key, *by).agg(F.count("*").alias("_in"))
    w = W.partitionBy(key).orderBy(*by)
    before = counts.select(F.col(key).alias("_key"), F.col("_placed").alias("_p"), F.col("_range").alias("_r"), (F.sum("_in").over(w) - F.col("_in")).alias("_before"), F.sum("_in").over(W.partitionBy(key)).alias(size))
    joined = ranged.join(before, ranged[key].eqNullSafe(before["_key"]) & (ranged["_placed"] == before["_p"]) & (ranged["_range"] == before["_r"]))
    own = F.row_number().over(W.partitionBy(key, *by).orderBy(order)) - 1
    return joined.withColumn(place, (F.col("_before") + own).cast("long")).drop("_range", "_placed", "_key", "_p", "_r", "_before")


def clean_search_reason(rows: DataFrame, reason: Column) -> Column:
    """Why an output is no clean search output, in order; ``reason`` is the grouping evaluator's."""
    return (
        F.when(F.col("call_id").isNull(), "NO_CALL_ID")
        .when(F.col("output").isNull(), "UNMATCHED")
        .when(F.col("exit_code").isNull(), "ENVELOPE")
        .when(F.col("sensitive"), "SENSITIVE")
        .when(F.col("command").isNull(), "INVOCATION")
        .when(F.col("exit_code") == 1, "EXIT_1")
        .when(F.col("exit_code") >= 2, "EXIT_2_OR_MORE")
        .when(F.col("truncated"), "TRUNCATED")
        .when(~reason.isin("APPLIED", "NO_GAIN"), reason)
    )


#: The path before a match line's number; a drive letter's colon belongs to it.
MATCH_PATH = r"^((?:[A-Za-z]:(?=[\\/]))?[^:]*)"


def characterise(rows: DataFrame, key: str, output: Column) -> DataFrame:
    """Match lines of each output: records, distinct paths, repeated paths and repeated records."""
    lines = F.filter(F.split(output, "\n"), lambda x: x != "")
    paths = F.transform(lines, lambda x: F.regexp_extract(x, MATCH_PATH, 1))
    n, p, d = F.size(lines), F.size(F.array_distinct(paths)), F.size(F.array_distinct(lines))
    return rows.select(key, n.cast("long").alias("records"), p.cast("long").alias("paths"), (n - p).cast("long").alias("repeated_paths"), (n - d).cast("long").alias("repeated_records"))
