"""Lines of text files with their numbers, read by byte ranges.

Spark cuts a file into ranges at line ends. Lines are counted within their range, which has a bounded
size, and what lies in the ranges before is a sum over their counts; no file is sorted or counted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``_range`` (where the line's byte range begins), ``_at`` (order within it) and ``value`` of every line."""
    lines = spark.read.text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_range"), F.monotonically_increasing_id().alias("_at"), "value")


def running(lines: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """``lines`` with a running count, itself included, of the lines of its file that meet each condition."""
    flags = lines.withColumns({f"_{n}": F.coalesce(c, F.lit(False)).cast("long") for n, c in counts.items()})
    sums = flags.groupBy(F.col("file").alias("_f"), F.col("_range").alias("_r")).agg(*[F.sum(f"_{n}").alias(f"_{n}_sum") for n in counts])
    earlier = W.partitionBy("_f").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("_f", "_r", *[F.coalesce(F.sum(f"_{n}_sum").over(earlier), F.lit(0)).alias(f"_{n}_before") for n in counts])
    own = W.partitionBy("file", "_range").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    inside = flags.withColumns({n: F.sum(f"_{n}").over(own) for n in counts})
    joined = inside.join(before, (F.col("file") == F.col("_f")) & (F.col("_range") == F.col("_r")))
    return joined.withColumns({n: F.col(n) + F.col(f"_{n}_before") for n in counts}).select(*lines.columns, *counts)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``line_no`` from 1, and ``value`` of every line."""
    return running(read_ranges(spark, path), {"line_no": F.lit(True)}).select("file", "line_no", "value")
