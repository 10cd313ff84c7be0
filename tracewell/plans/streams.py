"""Queries that run a stream to its end, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import receipts, redelivery
from tracewell.plans import corpora
from tracewell.plans.sessions import _READS
from tracewell.sources import sinks
from tracewell.sources.scratch import shared_dir
from tracewell.sources.tables import TOOL_CALLS_SQL, table, tool_calls
from tracewell.streaming import stateful


#: Slices of a log that arrive one after another, and files of each.
SLICES, FILES = 4, 2


def _arriving(rows: DataFrame, order: str, session: str) -> tuple[str, DataFrame]:
    """A new place in the shared folder, and the stream of ``rows`` that arrive there slice by slice.

    A slice is a range of ``order``, so every session goes on through all slices and its state is carried from batch to
    batch. A session lies in one file of a slice.
    """
    spark = rows.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{at}/log")
    log = spark.read.schema(rows.schema).parquet(f"{at}/log")
    bounds = [None, *sorted(set(log.approxQuantile(order, [k / SLICES for k in range(1, SLICES)], 0.01))), None]
    for lo, hi in zip(bounds, bounds[1:]):
        after, upto = F.lit(True) if lo is None else F.col(order) > lo, F.lit(True) if hi is None else F.col(order) <= hi
        log.where(after & upto).repartition(FILES, session).write.mode("append").parquet(f"{at}/in")
    return at, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(f"{at}/in")


def _finish(writer, at: str, batches: list | None = None) -> None:
    query = writer.option("checkpointLocation", f"{at}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    if batches is not None:
        batches += [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]


def _through(rows: DataFrame, step, schema: str, order: str = "call_index", session: str = "session_id", batches: list | None = None) -> DataFrame:
    """What ``step`` makes of ``rows`` as they arrive; read from the shared folder. ``batches`` gets the rows of each micro-batch."""
    at, stream = _arriving(rows, order, session)
    _finish(step(stream).writeStream.format("parquet").option("path", f"{at}/out"), at, batches)
    return rows.sparkSession.read.schema(schema).parquet(f"{at}/out")


def stream_vs_batch(spark, sf_dir):
    """First deliveries decided call by call in a stream, compared with the windows over the whole log."""
    calls = tool_calls(table(spark, sf_dir, "events"))
    stream = _through(calls.select("session_id", "call_index", "event_id", "sha"), stateful.first_deliveries, stateful.FIRST).select("event_id", F.struct("is_first", "receipt_no", "first_index").alias("s"))
    batch = redelivery.delivery_state(calls).select("event_id", F.struct("is_first", "receipt_no", "first_index").alias("b"))
    same = F.col("s").eqNullSafe(F.col("b"))
    return batch.join(stream, "event_id", "full_outer").agg(F.count("*").alias("calls"), F.count_if(same).alias("matched"), F.count_if(~same).alias("mismatched"))


#: Milliseconds without a call after which a session of the bounded stream ends: four hours.
IDLE = 4 * 3_600_000


def stream_sessions(spark, sf_dir, batches: list | None = None):
    """First deliveries in a stream whose sessions end when idle, and begin anew afterwards."""
    calls = tool_calls(table(spark, sf_dir, "events")).select("session_id", "call_index", "event_id", "sha", F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    bounds = stateful.Bounds("ts", IDLE)
    return _through(calls, lambda rows: stateful.first_deliveries(rows, bounds), stateful.FIRST, "ms", batches=batches)


def _reads(spark, sf_dir):
    k = F.col("k")
    reads = tool_calls(table(spark, sf_dir, "events")).where(F.col("tool_family") == "FILE_READ")
    return reads.withColumn("source", F.when(k % 13 != 0, F.col("target_path"))).withColumn("view", F.when(k % 17 == 0, None).when(k % 2 == 0, "FULL_FILE").otherwise("LINE_RANGE"))


def stream_receipts(spark, sf_dir):
    """Read receipts decided one by one in a stream."""
    rows = _reads(spark, sf_dir).select("session_id", "call_index", "event_id", "source", "view", "sha", "n_bytes")
    return _through(rows, stateful.read_receipts, stateful.READS)


def stream_receipts_vs_batch(spark, sf_dir):
    """Fields in which the stream's receipts differ from those of the windows."""
    stream = stream_receipts(spark, sf_dir)
    batch = receipts.receipt_decisions(_reads(spark, sf_dir), F.col("source"), F.col("view"))
    fields = ("decision", "receipt_no", "distance")
    both = batch.select("event_id", *[F.col(f).alias("b_" + f) for f in fields]).join(stream.select("event_id", *fields), "event_id", "full_outer")
    return both.agg(F.count("*").alias("reads"), *[F.count_if(~F.col(f).eqNullSafe(F.col("b_" + f))).alias(f + "_differs") for f in fields])


def stream_pairing(spark, sf_dir, batches: list | None = None):
    """Calls paired with outputs as both arrive; eight records in turn share four call ids."""
    i = F.col("call_index")
    call_id = F.concat(F.lit("c"), (F.floor(i / 8) * 4 + F.col("event_id") % 4).cast("string"))
    e = tool_calls(table(spark, sf_dir, "events")).select("session_id", i.alias("record_index"), "event_id", (F.col("k") % 3 != 0).alias("is_call"), call_id.alias("call_id"))
    return _through(e, stateful.pair_calls, stateful.PAIRS, "record_index", batches=batches)


def stream_ledger(spark, sf_dir):
    """Receipt decisions chained batch by batch, as the ledger then stands."""
    rows = receipts.receipt_decisions(_reads(spark, sf_dir), F.col("source"), F.col("view")).select("session_id", "call_index", "event_id", "decision", "sha")
    at, stream = _arriving(rows, "call_index", "session_id")
    ledger = sinks.StreamLedger(f"{at}/ledger", "session_id", "call_index", F.concat_ws(":", F.col("event_id").cast("string"), "decision", "sha"), digits=16)
    _finish(stream.writeStream.foreachBatch(ledger), at)
    return ledger.entries(spark).select("session_id", "at", "before", "hash")


SQL = {
    "stream_vs_batch": "SELECT count(*) AS calls, count(*) AS matched, CAST(0 AS BIGINT) AS mismatched FROM events",
    "stream_sessions": f"""WITH {TOOL_CALLS_SQL}, g AS (SELECT *, CAST(epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY session_id ORDER BY call_index) > {IDLE} AS INT) AS gap FROM tool_calls),
      p AS (SELECT *, sum(coalesce(gap, 0)) OVER (PARTITION BY session_id ORDER BY call_index) AS part FROM g), f AS (SELECT *, min(call_index) OVER (PARTITION BY session_id, part, sha) AS first_index FROM p),
      n AS (SELECT *, CAST(sum(CAST(call_index = first_index AS INT)) OVER (PARTITION BY session_id, part ORDER BY call_index) AS BIGINT) AS num FROM f)
      SELECT session_id, call_index, event_id, call_index = first_index AS is_first, max(CASE WHEN call_index = first_index THEN num END) OVER (PARTITION BY session_id, part, sha) AS receipt_no, first_index FROM n""",
    "stream_receipts": f"WITH {_READS} SELECT session_id, call_index, event_id, decision, receipt_no, distance FROM r7",
    "stream_receipts_vs_batch": "SELECT count(*) AS reads, CAST(0 AS BIGINT) AS decision_differs, CAST(0 AS BIGINT) AS receipt_no_differs, CAST(0 AS BIGINT) AS distance_differs FROM events WHERE event_type = 'view'",
    "stream_pairing": f"""WITH {TOOL_CALLS_SQL}, r AS (SELECT session_id, call_index AS i, event_id, k % 3 <> 0 AS is_call, 'c' || (call_index // 8 * 4 + event_id % 4) AS call_id FROM tool_calls),
      f AS (SELECT session_id, call_id, min(i) AS first_call FROM r WHERE is_call GROUP BY 1, 2), o AS (SELECT session_id, call_id, min(i) AS at FROM r JOIN f USING (session_id, call_id) WHERE NOT is_call AND i > first_call GROUP BY 1, 2)
      SELECT o.session_id, o.call_id, (SELECT max_by(c.event_id, c.i) FROM r c WHERE c.session_id = o.session_id AND c.call_id = o.call_id AND c.is_call AND c.i < o.at) AS call_event,
        (SELECT min(x.event_id) FROM r x WHERE x.session_id = o.session_id AND x.i = o.at) AS output_event FROM o""",
}
SQL["stream_ledger"] = corpora.SQL["receipt_ledger"]
QUERIES = {name: globals()[name] for name in SQL}
