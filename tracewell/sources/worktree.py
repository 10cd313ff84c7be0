"""Snapshots of source trees: the files, their digest, and recovery of a recorded source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that are never part of a snapshot.
EXCLUDED = (".git", ".venv", "venv", "__pycache__", "node_modules", "build", "dist", ".pytest_cache")


def scan(spark: SparkSession, root: str, suffix: str = ".py", excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """``path`` below the root, ``text`` and ``sha`` of every file of that ending outside the excluded folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root)
    clean = F.regexp_replace(F.col("path"), "^file:/+", "/")
    relative = F.substring(clean, F.lit(len(root.rstrip("/")) + 2), F.length(clean))
    f = files.select(relative.alias("path"), "content").where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, excluded))))
    return f.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.sha2("content", 256).alias("sha"))


def digest(entries: DataFrame, key: str, order: str, sha: Column, width: int = 4096) -> DataFrame:
    """One digest of every key's entries by an integer order, in two levels: of ranges of ``width`` places,
    then of the ranges' digests. A task holds a range, or a key's digests of ranges."""
    text = F.concat_ws(":", F.col(order).cast("string"), sha)
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["v"]), "\n")
    ranges = entries.groupBy(key, F.floor(F.col(order) / width).alias("r")).agg(F.count("*").alias("n"), F.sha2(listed(F.struct(F.col(order).alias("k"), text.alias("v"))), 256).alias("d"))
    return ranges.groupBy(key).agg(F.sum("n").alias("files"), F.sha2(listed(F.struct(F.col("r").alias("k"), F.col("d").alias("v"))), 256).alias("digest"))


def recover(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Recorded sources (path, n_bytes, sha) with the text that still is what was recorded; null if it is not."""
    f = files.select("path", "text", F.col("sha").alias("now"), F.octet_length("text").cast("long").alias("size"))
    same = (F.col("now") == F.col("sha")) & (F.col("size") == F.col("n_bytes"))
    return wanted.join(f, "path", "left").select("path", "sha", F.when(same, F.col("text")).alias("text"), F.coalesce(same, F.lit(False)).alias("recovered"))
