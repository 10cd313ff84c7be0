"""Replay of labelled corpora: confusion, safety by scope, missed cases, and review samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell.operators.harvest import number_within


def label_views(entries: DataFrame, scopes: dict[str, Column]) -> DataFrame:
    """One row per entry and scope that has a label."""
    views = F.array_compact(F.array(*[F.when(label.isNotNull(), F.struct(F.lit(scope).alias("scope"), label.cast("long").alias("label"))) for scope, label in scopes.items()]))
    return entries.select("*", F.inline(views))


def confusion(views: DataFrame) -> DataFrame:
    return views.groupBy("scope", "label", "predicted").agg(F.count("*").alias("entries"))


def safety(views: DataFrame) -> DataFrame:
    """Outcome counts per scope; an entry predicted good against its label is unsafe."""
    outcome = F.when(F.col("predicted") == F.col("label"), F.when(F.col("label") == 1, "SAFE_KEEP").otherwise("SAFE_DROP")).when(F.col("predicted") == 1, "UNSAFE_KEEP").otherwise("MISSED_KEEP")
    return views.groupBy("scope", outcome.alias("outcome")).agg(F.count("*").alias("entries"), F.round(F.avg("n_chars"), 2).alias("mean_chars"))


def bucket_samples(entries: DataFrame, bucket: Column, buckets: tuple[str, ...], key: str, n: int = 5) -> DataFrame:
    """Entries per bucket with its first ``n`` keys; empty buckets are listed with zero."""
    marked = entries.withColumn("bucket", bucket)
    nth = F.row_number().over(W.partitionBy("bucket").orderBy(key))
    first = marked.withColumn("nth", nth).where(F.col("nth") <= n).groupBy("bucket").agg(F.array_join(F.transform(F.sort_array(F.collect_list(key)), lambda x: x.cast("string")), ",").alias("sample"))
    count = marked.groupBy("bucket").agg(F.count("*").alias("entries"))
    listed = entries.sparkSession.createDataFrame([(b,) for b in buckets], "bucket string")
    return F.broadcast(listed).join(count, "bucket", "left").join(first, "bucket", "left").select("bucket", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("sample", F.lit("")).alias("sample"))


def sidecar_join(entries: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Entries with their reviews; a review counts only if it names the entry's content digest."""
    joined = entries.join(reviews, key, "left")
    state = F.when(F.col("review_sha").isNull(), "UNREVIEWED").when(F.col("review_sha") == F.col("sha"), "REVIEWED").otherwise("DIGEST_MISMATCH")
    return joined.withColumn("state", state)


def periodic_sample(rows: DataFrame, stratum: str, order: str, target: int) -> DataFrame:
    """``target`` evenly spaced rows of every stratum: places int(i * n / target) by an integer order."""
    placed = number_within(rows, stratum, order, place="_place", size="_size")
    wanted = F.transform(F.sequence(F.lit(0), F.lit(target - 1)), lambda i: F.floor(i * F.col("_size") / target).cast("long"))
    return placed.where((F.col("_size") <= target) | F.array_contains(wanted, F.col("_place"))).drop("_size", "_place")


def quantile_review(rows: DataFrame, group: str, size: str, key: str, quantiles: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """The rows at the quantiles of size of every group, with their ``place``; rows without a size come first.

    Sizes are counted first; only rows of a size that holds a wanted place are sorted.
    """
    sizes = rows.groupBy(F.col(group).alias("_group"), F.col(size).alias("_size")).agg(F.count("*").alias("_times"))
    w = W.partitionBy("_group")
    upto = sizes.withColumn("_stop", F.sum("_times").over(w.orderBy("_size"))).withColumn("_n", F.sum("_times").over(w))
    wanted = F.array(*[F.floor((F.col("_n") - 1) * q).cast("long") for q in quantiles])
    held = upto.withColumn("_start", F.col("_stop") - F.col("_times")).withColumn("_wanted", F.filter(wanted, lambda p: (p >= F.col("_start")) & (p < F.col("_stop")))).where(F.size("_wanted") > 0)
    near = rows.select(group, key, size).join(held, F.col(group).eqNullSafe(F.col("_group")) & F.col(size).eqNullSafe(F.col("_size")))
    placed = near.withColumn("_place", (F.col("_start") + F.row_number().over(W.partitionBy(group, size).orderBy(key)) - 1).cast("long"))
    return placed.where(F.array_contains("_wanted", F.col("_place"))).select(group, key, size, F.col("_place").alias("place"))


def first_per_reason(rows: DataFrame, reason: str, key: str, n: int) -> DataFrame:
    nth = F.row_number().over(W.partitionBy(reason).orderBy(key)).cast("long")
    return rows.withColumn("nth", nth).where(F.col("nth") <= n)
