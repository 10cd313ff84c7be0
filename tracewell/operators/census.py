"""Exploration cost of sessions: families, episodes, repeats and bytes that could be avoided."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def family_stats(calls: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """Per family: calls, bytes, share, least, upper median, nearest-rank p90 and most; absent families are zero."""
    spark = calls.sparkSession
    total = F.sum(F.coalesce("bytes", F.lit(0))).over(W.partitionBy())
    n = F.col("calls")
    stats = calls.groupBy("tool_family", "n_bytes").agg(F.count("*").alias("times"))
    # sizes repeat, so ranks are taken over distinct sizes with their counts
    running = F.sum("times").over(W.partitionBy("tool_family").orderBy("n_bytes"))
    every = F.sum("times").over(W.partitionBy("tool_family"))
    ranked = stats.withColumn("upto", running).withColumn("calls", every)
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("n_bytes")))
    agg = ranked.groupBy("tool_family").agg(
        F.sum("times").alias("calls"),
        F.sum(F.col("times") * F.col("n_bytes")).alias("bytes"),
        F.min("n_bytes").alias("min_bytes"),
        at(F.floor(n / 2) + 1).alias("median_bytes"),
        at(F.ceil(n * 0.9)).alias("p90_bytes"),
        F.max("n_bytes").alias("max_bytes"),
    )
    listed = spark.createDataFrame([(f,) for f in families], "tool_family string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return F.broadcast(listed).join(agg, "tool_family", "left").select(
        "tool_family", *[zero(c) for c in ("calls", "bytes", "min_bytes", "median_bytes", "p90_bytes", "max_bytes")], F.round(F.coalesce("bytes", F.lit(0)) * 100.0 / total, 2).alias("share_pct")
    )


def coverage(calls: DataFrame) -> DataFrame:
    """Totals, and the share of calls whose family is known."""
    known = F.count_if(F.col("tool_family").isNotNull())
    return calls.agg(F.count("*").alias("calls"), F.sum("n_bytes").alias("bytes"), F.countDistinct("session_id").alias("sessions"), F.round(known * 100.0 / F.count("*"), 2).alias("classified_pct"))


def before_first_write(calls: DataFrame) -> DataFrame:
    """Adds ``pre_write``: the call precedes its episode's first mutation."""
    first = F.min(F.when(F.col("is_mutation"), F.col("call_index"))).over(W.partitionBy("session_id", "episode_id"))
    return calls.withColumn("first_write", first).withColumn("pre_write", F.col("first_write").isNull() | (F.col("call_index") < F.col("first_write")))


def episode_discovery(calls: DataFrame) -> DataFrame:
    """Per episode: what was looked at before the first write, and what was written."""
    c = before_first_write(calls)
    pre = F.col("pre_write")
    of = lambda family: pre & (F.col("tool_family") == family)
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n_bytes"))), F.lit(0))
    read = F.collect_set(F.when(pre, F.col("target_path")))
    modified = F.collect_set(F.when(~pre & F.col("is_mutation"), F.col("target_path")))
    parts = [("search", "SEARCH"), ("read", "FILE_READ"), ("directory", "DIRECTORY_LIST")]
    return (
        c.groupBy("session_id", "episode_id")
        .agg(
            F.count("*").alias("total_calls"),
            F.count_if(pre).alias("discovery_calls"),
            total(pre).alias("discovery_bytes"),
            *[x for name, family in parts for x in (F.count_if(of(family)).alias(f"{name}_calls"), total(of(family)).alias(f"{name}_bytes"))],
            read.alias("read"),
            modified.alias("modified"),
        )
        .select(
            "*",
            F.size("read").cast("long").alias("files_read"),
            F.size("modified").cast("long").alias("files_modified"),
            F.size(F.array_except("read", "modified")).cast("long").alias("supporting_reads"),
        )
        .drop("read", "modified")
    )


def episode_duplicates(calls: DataFrame) -> DataFrame:
    """Searches, listings and reads repeated before an episode's first write."""
    c = before_first_write(calls).where(F.col("pre_write") & F.col("tool_family").isin("SEARCH", "DIRECTORY_LIST", "FILE_READ"))
    key = F.when(F.col("tool_family") == "FILE_READ", F.concat_ws("|", "target_path", "sha")).otherwise(F.col("target_path"))
    return c.withColumn("repeat_key", key).withColumn("nth", F.row_number().over(W.partitionBy("session_id", "episode_id", "tool_family", "repeat_key").orderBy("call_index")).cast("long"))


def duplicate_totals(calls: DataFrame) -> DataFrame:
    return episode_duplicates(calls).where(F.col("nth") > 1).groupBy("tool_family").agg(F.count("*").alias("calls"), F.sum("n_bytes").alias("bytes"))


def action_chains(calls: DataFrame, top: int = 5) -> DataFrame:
    """The most common first three operations of an episode."""
    nth = F.row_number().over(W.partitionBy("session_id", "episode_id").orderBy("call_index"))
    first = calls.withColumn("nth", nth).where(F.col("nth") <= 3)
    at = lambda k: F.max(F.when(F.col("nth") == k, F.col("tool_family")))
    chains = first.groupBy("session_id", "episode_id").agg(*[at(k).alias(f"op{k}") for k in (1, 2, 3)]).where(F.col("op3").isNotNull())
    return chains.groupBy(F.concat_ws(" -> ", "op1", "op2", "op3").alias("chain")).agg(F.count("*").alias("episodes")).orderBy(F.desc("episodes"), "chain").limit(top)


def avoidable(calls: DataFrame) -> DataFrame:
    """Every avoidable call once, under the first class that claims it."""
    # a content may be delivered anywhere often, so its first delivery is an aggregate, not a window
    first = calls.groupBy("target_path", "sha").agg(F.min(F.struct("session_id", "call_index")).alias("first"))
    again = calls.join(first, ["target_path", "sha"]).withColumn("reexposed", F.struct("session_id", "call_index") != F.col("first"))
    repeats = episode_duplicates(calls).where(F.col("nth") > 1).select("event_id", F.lit(True).alias("duplicate"))
    flags = again.join(repeats, "event_id", "left")
    claimed = F.when(F.col("reexposed"), "EXACT_REEXPOSURE").when(F.col("duplicate"), "DISCOVERY_DUPLICATE")
    return flags.withColumn("attribution", claimed).where(F.col("attribution").isNotNull()).groupBy("attribution").agg(F.count("*").alias("calls"), F.sum("n_bytes").alias("bytes"))


def priority(calls: DataFrame) -> DataFrame:
    """The class with the highest observed cost and the one with the most avoidable bytes; listed order wins ties."""
    spent = before_first_write(calls).agg(F.coalesce(F.sum(F.when(F.col("pre_write"), F.col("n_bytes"))), F.lit(0)).alias("discovery"), F.sum(F.when(F.col("tool_family") == "SEARCH", F.col("n_bytes"))).alias("representation"))
    save = avoidable(calls).agg(
        F.coalesce(F.sum(F.when(F.col("attribution") == "EXACT_REEXPOSURE", F.col("bytes"))), F.lit(0)).alias("reexposure_avoidable"),
        F.coalesce(F.sum(F.when(F.col("attribution") == "DISCOVERY_DUPLICATE", F.col("bytes"))), F.lit(0)).alias("discovery_avoidable"),
    )
    both = spent.crossJoin(F.broadcast(save))  # one row each
    return both.select(
        "discovery", "representation", "reexposure_avoidable", "discovery_avoidable",
        F.when(F.col("discovery") >= F.col("representation"), "DISCOVERY").otherwise("REPRESENTATION").alias("highest_observed"),
        F.when(F.col("reexposure_avoidable") >= F.col("discovery_avoidable"), "REEXPOSURE").otherwise("DISCOVERY").alias("highest_avoidable"),
    )


def reread_changes(calls: DataFrame) -> DataFrame:
    """Reads of a path compared with the path's previous read in the session."""
    before = F.lag("sha").over(W.partitionBy("session_id", "target_path").orderBy("call_index"))
    reads = calls.where(F.col("tool_family") == "FILE_READ").withColumn("before", before)
    state = F.when(F.col("before").isNull(), "FIRST").when(F.col("before") == F.col("sha"), "IDENTICAL").otherwise("CHANGED")
    return reads.groupBy(state.alias("state")).agg(F.count("*").alias("reads"), F.sum("n_bytes").alias("bytes"))


def range_overlap(reads: DataFrame) -> DataFrame:
    """Consecutive reads of one path whose line ranges overlap, by inclusive and by strict ends."""
    key = W.partitionBy("session_id", "target_path").orderBy("call_index")
    r = reads.withColumn("p_start", F.lag("start_line").over(key)).withColumn("p_end", F.lag("end_line").over(key))
    lo, hi = F.greatest("start_line", "p_start"), F.least("end_line", "p_end")
    seen = F.col("p_start").isNotNull()
    return r.agg(
        F.count_if(seen & (lo <= hi)).alias("inclusive_reads"),
        F.coalesce(F.sum(F.when(seen & (lo <= hi), hi - lo + 1)), F.lit(0)).alias("inclusive_lines"),
        F.count_if(seen & (lo < hi)).alias("strict_reads"),
    )


def call_output_pairs(calls: DataFrame, outputs: DataFrame) -> DataFrame:
    """Calls with their outputs: the last record of an id wins on each side; calls without output are dropped."""
    last = lambda df, name: df.groupBy("call_id").agg(F.max_by("event_id", "record_index").alias(name), F.max("record_index").alias(f"{name}_index"))
    return last(calls, "call_event").join(last(outputs, "output_event"), "call_id")


def unmatched(calls: DataFrame, outputs: DataFrame) -> DataFrame:
    """Ids found on one side only."""
    c, o = calls.select("call_id").distinct(), outputs.select("call_id").distinct()
    return c.join(o, "call_id", "left_anti").withColumn("side", F.lit("CALL")).unionByName(o.join(c, "call_id", "left_anti").withColumn("side", F.lit("OUTPUT")))
