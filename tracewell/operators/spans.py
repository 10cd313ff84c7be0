"""Byte intervals: accounting by class, unions, sections, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def span_accounting(docs: DataFrame, key: str, spans: Column, size: Column, rest: str = "PLAIN") -> DataFrame:
    """Bytes of each class per document; what no span covers is ``rest``, so classes add up to the input."""
    listed = docs.select(key, size.alias("size"), F.explode_outer(spans).alias("span"))
    covered = listed.select(key, F.col("span.kind").alias("kind"), (F.col("span.stop") - F.col("span.start")).alias("bytes")).where(F.col("kind").isNotNull())
    used = covered.groupBy(key).agg(F.sum("bytes").alias("used"))
    left = docs.select(key, size.alias("size")).join(used, key, "left").select(key, F.lit(rest).alias("kind"), (F.col("size") - F.coalesce("used", F.lit(0))).alias("bytes"))
    return covered.unionByName(left).groupBy(key, "kind").agg(F.sum("bytes").alias("bytes"))


def layout_valid(spans: Column, size: Column) -> Column:
    """Spans are ordered, disjoint and inside the text."""
    ordered = F.forall(F.sequence(F.lit(1), F.greatest(F.size(spans) - 1, F.lit(1))), lambda i: F.coalesce(F.get(spans, i)["start"] >= F.get(spans, i - 1)["stop"], F.lit(True)))
    return ordered & F.forall(spans, lambda s: (s["start"] >= 0) & (s["start"] < s["stop"]) & (s["stop"] <= size))


def range_union(ranges: DataFrame, key: str) -> DataFrame:
    """Merged half-open ranges (start, stop) of every key; ranges that touch are joined."""
    w = W.partitionBy(key).orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = ranges.withColumn("opens", F.coalesce((F.col("start") > before), F.lit(True)).cast("long"))
    island = F.sum("opens").over(w.rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn("island", island).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def section_bounds(headings: DataFrame, key: str) -> DataFrame:
    """Each heading's section ends at the next heading of the same or a higher level.

    A document's headings are one bounded array, searched by a higher-order function.
    """
    listed = headings.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("line", "level"))).alias("all"))
    each = listed.select(key, "all", F.explode("all").alias("h"))
    after = F.filter(F.col("all"), lambda x: (x["line"] > F.col("h.line")) & (x["level"] <= F.col("h.level")))
    return each.select(key, F.col("h.line").alias("line"), F.col("h.level").alias("level"), F.get(after, F.lit(0))["line"].alias("stop_line"))


def within_budget(rows: DataFrame, key: str, order: list, size: str, budget: int) -> DataFrame:
    """The ranked prefix of every key whose running size stays within the budget."""
    total = F.sum(size).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("running", total).where(F.col("running") <= budget)


def fold_runs(lines: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Runs of equal consecutive lines: gaps and islands over (key, line number)."""
    w = W.partitionBy(key).orderBy("line_no")
    changed = F.coalesce(F.lag("line").over(w) != F.col("line"), F.lit(True)).cast("long")
    island = F.sum("changed").over(w.rowsBetween(W.unboundedPreceding, 0))
    runs = lines.withColumn("changed", changed).withColumn("island", island).groupBy(key, "island").agg(F.count("*").alias("n"), F.min("line_no").alias("first"), F.max("line_no").alias("last"))
    return runs.where(F.col("n") >= least).select(key, "first", "last", "n")
