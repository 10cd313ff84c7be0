"""Queries over sessions of tool calls, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell.functions import buckets
from tracewell.operators import census, delivery, receipts, redelivery
from tracewell.sources.tables import FAMILIES, TOOL_CALLS_SQL, table, tool_calls


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls(table(spark, sf_dir, "events"))


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redelivery.redelivery_decisions(_calls(spark, sf_dir), F.lit("UNKNOWN"))


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with a source (unknown for some) and one of two views (unknown for some)."""
    k = F.col("k")
    source = F.when(k % 13 == 0, None).otherwise(F.col("target_path"))
    view = F.when(k % 17 == 0, None).when(k % 2 == 0, "FULL_FILE").otherwise("LINE_RANGE")
    return receipts.receipt_decisions(_calls(spark, sf_dir).where(F.col("tool_family") == "FILE_READ"), source, view)


def first_delivery(spark, sf_dir):
    d = redelivery.delivery_state(_calls(spark, sf_dir))
    return d.groupBy("session_id").agg(F.count("*").alias("calls"), F.count_if("is_first").alias("first_deliveries"), F.sum(F.when(~F.col("is_first"), F.col("n_bytes")).otherwise(0)).alias("repeat_bytes"))


def exact_redelivery(spark, sf_dir):
    return redelivery.exact_redelivery(_calls(spark, sf_dir))


def redelivery_decisions(spark, sf_dir):
    return _decisions(spark, sf_dir).select("event_id", "session_id", "call_index", "disposition", "evidence", "receipt_no", "reference_bytes", "avoided_bytes", "call_distance", "latest_distance", "episode_distance")


def redelivery_funnel(spark, sf_dir):
    return redelivery.funnel(_decisions(spark, sf_dir))


def redelivery_by_family(spark, sf_dir):
    return redelivery.disposition_by_family(_decisions(spark, sf_dir))


def recency_hist(spark, sf_dir):
    return redelivery.recency_histogram(_decisions(spark, sf_dir))


def reference_roundtrip(spark, sf_dir):
    """References of all economic redeliveries, parsed back."""
    d = _decisions(spark, sf_dir).where(F.col("disposition") == "REFERENCE")
    text = redelivery.reference_text(F.col("sha"), F.col("n_bytes"), F.col("session_id"), F.col("receipt_no"))
    p = redelivery.parse_reference(text)
    return d.select("event_id", (p["sha"] == F.col("sha")).alias("same_sha"), p["n_bytes"].alias("parsed_bytes"), p["receipt"].alias("receipt"))


def family_stats(spark, sf_dir):
    return census.family_stats(_calls(spark, sf_dir), FAMILIES)


def coverage(spark, sf_dir):
    return census.coverage(_calls(spark, sf_dir))


def episode_discovery(spark, sf_dir):
    return census.episode_discovery(_calls(spark, sf_dir))


def episode_duplicates(spark, sf_dir):
    return census.duplicate_totals(_calls(spark, sf_dir))


def action_chains(spark, sf_dir):
    return census.action_chains(_calls(spark, sf_dir))


def avoidable_dedup(spark, sf_dir):
    return census.avoidable(_calls(spark, sf_dir))


def priority(spark, sf_dir):
    return census.priority(_calls(spark, sf_dir))


def reread_changes(spark, sf_dir):
    return census.reread_changes(_calls(spark, sf_dir))


def range_overlap(spark, sf_dir):
    k = F.col("k")
    return census.range_overlap(_calls(spark, sf_dir).where(F.col("tool_family") == "FILE_READ").withColumns({"start_line": k + 1, "end_line": k + 20}))


def receipt_decisions(spark, sf_dir):
    return _reads(spark, sf_dir).select("event_id", "session_id", "call_index", "source", "view", "decision", "receipt_no", "reference_bytes", "distance", "avoided_bytes")


def salience_hist(spark, sf_dir):
    return receipts.salience_histogram(_reads(spark, sf_dir))


def receipt_manifest(spark, sf_dir):
    return receipts.receipt_manifest(_reads(spark, sf_dir))


def read_view_coverage(spark, sf_dir):
    return receipts.view_coverage(_reads(spark, sf_dir))


def ledger_chain(spark, sf_dir):
    d = _decisions(spark, sf_dir)
    return receipts.hash_chain(d, "session_id", "call_index", F.concat_ws(":", F.col("call_index").cast("string"), "disposition", "sha"))


def _sides(spark, sf_dir):
    """Even events are calls, odd ones outputs; several share a call id."""
    e = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 2).alias("pair"), (F.col("event_id") % 2 == 0).alias("is_call"))
    e = e.withColumn("call_id", F.col("pair") - F.col("pair") % F.when(F.col("is_call"), 3).otherwise(5)).withColumn("record_index", F.col("event_id"))
    return e.where("is_call"), e.where(~F.col("is_call"))


def call_output_pairing(spark, sf_dir):
    return census.call_output_pairs(*_sides(spark, sf_dir))


def unmatched_calls(spark, sf_dir):
    return census.unmatched(*_sides(spark, sf_dir))


def at_most_once(spark, sf_dir):
    """The first record of each call id in a session."""
    c = _calls(spark, sf_dir).withColumn("call_id", F.concat_ws("/", "session_id", F.col("k").cast("string")))
    nth = F.row_number().over(W.partitionBy("call_id").orderBy("call_index"))
    return c.withColumn("nth", nth).where(F.col("nth") == 1).select("call_id", "event_id", "call_index")


def conversation_episodes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    episode = F.sum((F.col("role") == "user").cast("long")).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0))
    e = c.withColumn("episode_id", episode)
    return e.groupBy("conv_id", "episode_id").agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))


def reference_cap(spark, sf_dir):
    """At most three references in a session; a failed call ends them."""
    d = _decisions(spark, sf_dir)
    w = W.partitionBy("session_id").orderBy("call_index").rowsBetween(W.unboundedPreceding, -1)
    stopped = F.coalesce(F.max(F.col("exit_code")).over(w), F.lit(0)) > 0
    wanted = F.col("disposition") == "REFERENCE"
    used = F.coalesce(F.sum(F.when(wanted & ~F.col("stopped"), 1).otherwise(0)).over(w), F.lit(0))
    d = d.withColumn("stopped", stopped).withColumn("used", used)
    mode = F.when(~wanted, "RAW").when(F.col("stopped"), "RAW_AFTER_FAILURE").when(F.col("used") >= 3, "RAW_CAPPED").otherwise("REFERENCE")
    return d.groupBy(mode.alias("delivery")).agg(F.count("*").alias("calls"), F.sum("n_bytes").alias("bytes"))


def structural_trace(spark, sf_dir, keep: int = 64):
    """The last operations of every session, and how many came before them."""
    c = _calls(spark, sf_dir)
    last = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("call_index")))
    n = F.count("*").over(W.partitionBy("session_id"))
    t = c.withColumn("back", last).withColumn("n", n).where(F.col("back") <= keep)
    return t.groupBy("session_id").agg(
        F.max(F.greatest(F.col("n") - keep, F.lit(0))).alias("dropped"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("call_index", "tool_family"))), lambda s: s["tool_family"]), ",").alias("trace"),
    )


def delivery_economics(spark, sf_dir):
    """Raw and reference bytes of identical reads, less what recovering every fifth costs."""
    r = _reads(spark, sf_dir).where(F.col("decision") == "HISTORICAL_IDENTICAL")
    recovery = F.when(F.col("call_index") % 5 == 0, F.col("n_bytes")).otherwise(0)
    return r.groupBy("session_id").agg(
        F.sum("n_bytes").alias("raw_bytes"), F.sum("reference_bytes").alias("reference_bytes"), F.sum(recovery).alias("recovery_bytes"), F.sum(F.col("n_bytes") - F.col("reference_bytes") - recovery).alias("net_bytes")
    )


def _delivered(spark, sf_dir):
    """Reads as they are delivered: a fifth of the sessions is the control; some are not assessed, switched off or seen elsewhere."""
    k = F.col("k")
    reads = _calls(spark, sf_dir).where(F.col("tool_family") == "FILE_READ").drop("content")
    source, view = F.when(k % 13 != 0, F.col("target_path")), F.when(k % 17 == 0, None).when(k % 2 == 0, "FULL_FILE").otherwise("LINE_RANGE")
    assessed, observed = F.when(k % 19 != 0, delivery.NOT_SENSITIVE), F.when(k % 29 == 0, "other")
    return delivery.deliver(reads, source, view, assessed, F.substring("session_id", 2, 20).cast("long") % 5 != 0, k % 23 != 0, observed)


def delivery_outcomes(spark, sf_dir):
    return _delivered(spark, sf_dir).select("event_id", "delivery", "reason", "reference", "held")


def reference_expansion(spark, sf_dir):
    """References expanded, most of them changed on the way; some held bytes are spoilt."""
    d = _delivered(spark, sf_dir)
    content = F.when(F.col("k") % 31 == 0, F.overlay("content", F.lit("X"), F.lit(1))).otherwise(F.col("content"))
    store = d.join(_calls(spark, sf_dir).select("event_id", content.alias("content")), "event_id")
    turn, r = F.col("event_id") % 7, F.col("reference")
    changed = (
        F.when(turn == 1, F.regexp_replace(r, r"sha256=.{8}", "sha256=00000000"))
        .when(turn == 2, F.regexp_replace(r, r"bytes=", "bytes=1"))
        .when(turn == 3, F.regexp_replace(r, r"rcpt-\d+", "rcpt-99999"))
        .when(turn == 4, F.concat(F.lit("x"), r))
        .otherwise(r)
    )
    asked = d.where(F.col("delivery") == "READREF").select(F.when(turn == 5, "elsewhere").otherwise(F.col("session_id")).alias("session_id"), "call_index", changed.alias("reference"))
    return delivery.expand(asked, store, "content").select("session_id", "call_index", "outcome", F.sha2("content", 256).alias("sha"))


_STATE = TOOL_CALLS_SQL + """, st AS (
  SELECT *, row_number() OVER s = 1 AS is_first, first_value(call_index) OVER s AS first_index, first_value(episode_id) OVER s AS first_episode
  FROM tool_calls WINDOW s AS (PARTITION BY session_id, sha ORDER BY call_index)
), st2 AS (
  SELECT *, last_value(CASE WHEN is_first THEN sha END IGNORE NULLS) OVER (PARTITION BY session_id, tool_family, target_path ORDER BY call_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS source_sha,
    sum(CASE WHEN is_first THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY call_index ROWS UNBOUNDED PRECEDING) AS firsts FROM st
), st3 AS (
  SELECT *, CAST(first_value(firsts) OVER (PARTITION BY session_id, sha ORDER BY call_index) AS BIGINT) AS receipt_no FROM st2
), st4 AS (
  SELECT *, CASE WHEN tool_family IN ('FILE_READ', 'SEARCH', 'DIRECTORY_LIST') THEN 'CONTENT_EVIDENCE' ELSE 'UNKNOWN' END AS evidence,
    '[[REDELIVERY sha256=' || sha || ' bytes=' || n_bytes || ' receipt=RCP-' || left(session_id, 8) || '-' || CASE WHEN receipt_no < 1000000 THEN lpad(CAST(receipt_no AS VARCHAR), 6, '0') ELSE CAST(receipt_no AS VARCHAR) END || ']]' AS ref
  FROM st3
), dec AS (
  SELECT *, strlen(ref) AS reference_bytes,
    CASE WHEN is_first THEN 'FIRST_DELIVERY' WHEN truncated THEN 'AMBIGUOUS_IDENTITY' WHEN exit_code <> 0 THEN 'UNSAFE_EVIDENCE'
      WHEN source_sha IS DISTINCT FROM sha THEN 'CROSS_SOURCE' WHEN evidence = 'UNKNOWN' THEN 'UNKNOWN_EVIDENCE'
      WHEN strlen(ref) >= n_bytes THEN 'NOT_ECONOMIC' ELSE 'REFERENCE' END AS disposition FROM st4
), d AS (
  SELECT *, CASE WHEN disposition = 'REFERENCE' THEN n_bytes - reference_bytes ELSE 0 END AS avoided_bytes,
    CASE WHEN NOT is_first THEN call_index - first_index END AS call_distance, CASE WHEN NOT is_first THEN episode_id - first_episode END AS episode_distance,
    CASE WHEN NOT is_first THEN call_index - last_value(CASE WHEN is_first OR disposition = 'REFERENCE' THEN call_index END IGNORE NULLS) OVER (PARTITION BY session_id, sha ORDER BY call_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS latest_distance FROM dec
)"""

_PRE = TOOL_CALLS_SQL + """, fw AS (
  SELECT *, min(CASE WHEN is_mutation THEN call_index END) OVER (PARTITION BY session_id, episode_id) AS first_write FROM tool_calls
), pw AS (
  SELECT *, first_write IS NULL OR call_index < first_write AS pre FROM fw
), dup AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, episode_id, tool_family, CASE WHEN tool_family = 'FILE_READ' THEN target_path || '|' || sha ELSE target_path END ORDER BY call_index) AS nth
  FROM pw WHERE pre AND tool_family IN ('SEARCH', 'DIRECTORY_LIST', 'FILE_READ')
), flags AS (
  SELECT p.*, row_number() OVER (PARTITION BY target_path, sha ORDER BY session_id, call_index) > 1 AS reexposed,
    event_id IN (SELECT event_id FROM dup WHERE nth > 1) AS duplicate FROM pw p
), av AS (
  SELECT CASE WHEN reexposed THEN 'EXACT_REEXPOSURE' ELSE 'DISCOVERY_DUPLICATE' END AS attribution, count(*) AS calls, CAST(sum(n_bytes) AS BIGINT) AS bytes
  FROM flags WHERE reexposed OR duplicate GROUP BY 1
)"""

_READS = TOOL_CALLS_SQL + """, r0 AS (
  SELECT *, CASE WHEN k % 13 = 0 THEN NULL ELSE target_path END AS source, CASE WHEN k % 17 = 0 THEN NULL WHEN k % 2 = 0 THEN 'FULL_FILE' ELSE 'LINE_RANGE' END AS view
  FROM tool_calls WHERE tool_family = 'FILE_READ'
), r1 AS (
  SELECT *, source IS NOT NULL AND view IS NOT NULL AS known FROM r0
), r2 AS (
  SELECT *, lag(sha) OVER (PARTITION BY session_id, source, view ORDER BY call_index) AS prior FROM r1
), r3 AS (
  SELECT *, known AND prior IS NULL AS is_first, sum(CASE WHEN known AND prior IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY call_index ROWS UNBOUNDED PRECEDING) AS num FROM r2
), r4 AS (
  SELECT *, CASE WHEN known THEN CAST(first_value(num) OVER (PARTITION BY session_id, source, view ORDER BY call_index) AS BIGINT) END AS receipt_no FROM r3
), r5 AS (
  SELECT *, strlen('[[READ receipt=rcpt-' || CASE WHEN receipt_no < 10000 THEN lpad(CAST(receipt_no AS VARCHAR), 4, '0') ELSE CAST(receipt_no AS VARCHAR) END || ' sha256=' || sha || ' bytes=' || n_bytes || ']]') AS reference_bytes FROM r4
), r6 AS (
  SELECT *, CASE WHEN source IS NULL THEN 'SOURCE_UNKNOWN' WHEN view IS NULL THEN 'VIEW_UNKNOWN' WHEN is_first THEN 'FIRST_READ' WHEN prior <> sha THEN 'SOURCE_CHANGED'
    WHEN reference_bytes >= n_bytes THEN 'NOT_ECONOMIC' ELSE 'HISTORICAL_IDENTICAL' END AS decision FROM r5
), r7 AS (
  SELECT *, CASE WHEN known AND NOT is_first THEN call_index - last_value(CASE WHEN decision <> 'NOT_ECONOMIC' THEN call_index END IGNORE NULLS) OVER (PARTITION BY session_id, source, view ORDER BY call_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS distance,
    CASE WHEN decision = 'HISTORICAL_IDENTICAL' THEN n_bytes - reference_bytes ELSE 0 END AS avoided_bytes FROM r6
)"""

_DELIVERED = _READS + """, x0 AS (
  SELECT *, CAST(substr(session_id, 2) AS BIGINT) % 5 <> 0 AS treated, k % 23 <> 0 AS enabled, k % 19 <> 0 AS safe, k % 29 <> 0 AS own FROM r7
), x1 AS (
  SELECT *, known AND safe AND treated AND own AS held FROM x0
), x2 AS (
  SELECT *, last_value(CASE WHEN held THEN call_index END IGNORE NULLS) OVER (PARTITION BY session_id, receipt_no, known ORDER BY call_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kept_at FROM x1
), x3 AS (
  SELECT a.*, b.k AS kept_k, CASE WHEN NOT a.own THEN 'CROSS_SESSION_FORBIDDEN' WHEN NOT a.treated THEN 'CONTROL' WHEN NOT a.enabled THEN 'SWITCHED_OFF' WHEN NOT a.safe THEN 'NOT_ASSESSED_SAFE' WHEN a.decision <> 'HISTORICAL_IDENTICAL' THEN a.decision
    WHEN b.sha IS NULL THEN 'MISSING_RECEIPT' WHEN b.sha <> a.sha THEN 'RECEIPT_MISMATCH' ELSE 'EXACT_REFERENCE' END AS reason
  FROM x2 a LEFT JOIN x2 b ON b.session_id = a.session_id AND b.call_index = a.kept_at
), dl AS (
  SELECT *, CASE WHEN reason = 'EXACT_REFERENCE' THEN 'READREF' ELSE 'RAW' END AS delivery, event_id % 7 AS turn FROM x3
)"""

_SIDES = """sides AS (
  SELECT event_id, event_id AS record_index, event_id % 2 = 0 AS is_call, event_id // 2 - (event_id // 2) % (CASE WHEN event_id % 2 = 0 THEN 3 ELSE 5 END) AS call_id FROM events
), c AS (SELECT call_id, max_by(event_id, record_index) AS call_event, max(record_index) AS call_event_index FROM sides WHERE is_call GROUP BY 1
), o AS (SELECT call_id, max_by(event_id, record_index) AS output_event, max(record_index) AS output_event_index FROM sides WHERE NOT is_call GROUP BY 1
)"""

_big = "CAST({} AS BIGINT)".format
_families = " UNION ALL ".join(f"SELECT {i} AS pos, '{f}' AS tool_family" for i, f in enumerate(FAMILIES))
_stage = lambda n, c: f"SELECT '{n}' AS stage, count(*) FILTER ({c}) AS calls, CAST(coalesce(sum(n_bytes) FILTER ({c}), 0) AS BIGINT) AS bytes FROM d"

SQL = {
    "delivery_outcomes": f"WITH {_DELIVERED} SELECT event_id, delivery, reason, CASE WHEN delivery = 'READREF' THEN '[[READ receipt=rcpt-' || CASE WHEN receipt_no < 10000 THEN lpad(CAST(receipt_no AS VARCHAR), 4, '0') ELSE CAST(receipt_no AS VARCHAR) END || ' sha256=' || sha || ' bytes=' || n_bytes || ']]' END AS reference, held FROM dl",
    "reference_expansion": f"""WITH {_DELIVERED}, o AS (SELECT *, CASE turn WHEN 1 THEN 'METADATA_MISMATCH' WHEN 2 THEN 'LENGTH_MISMATCH' WHEN 3 THEN 'UNKNOWN_RECEIPT' WHEN 4 THEN 'NO_REFERENCE' WHEN 5 THEN 'UNKNOWN_RECEIPT' ELSE CASE WHEN kept_k % 31 = 0 THEN 'DIGEST_MISMATCH' ELSE 'EXPANDED' END END AS outcome FROM dl WHERE delivery = 'READREF')
      SELECT CASE WHEN turn = 5 THEN 'elsewhere' ELSE session_id END AS session_id, call_index, outcome, CASE WHEN outcome = 'EXPANDED' THEN sha END AS sha FROM o""",
    "first_delivery": f"WITH {_STATE} SELECT session_id, count(*) AS calls, count(*) FILTER (is_first) AS first_deliveries, {_big('sum(CASE WHEN is_first THEN 0 ELSE n_bytes END)')} AS repeat_bytes FROM st GROUP BY 1",
    "exact_redelivery": f"WITH {TOOL_CALLS_SQL}, g AS (SELECT target_path, sha, count(*) AS n, sum(n_bytes) AS b, min(n_bytes) AS one FROM tool_calls GROUP BY 1, 2 HAVING count(*) > 1) SELECT target_path, count(*) AS groups, {_big('sum(n)')} AS events, {_big('sum(b)')} AS gross_bytes, {_big('sum(b - one)')} AS repeat_bytes FROM g GROUP BY 1",
    "redelivery_decisions": f"WITH {_STATE} SELECT event_id, session_id, call_index, disposition, evidence, receipt_no, reference_bytes, avoided_bytes, call_distance, latest_distance, episode_distance FROM d",
    "redelivery_funnel": f"WITH {_STATE} " + " UNION ALL ".join(
        _stage(n, c)
        for n, c in (
            ("1_all", "true"), ("2_repeated", "NOT is_first"), ("3_identified", "disposition NOT IN ('FIRST_DELIVERY', 'AMBIGUOUS_IDENTITY')"),
            ("4_same_source", "disposition IN ('UNKNOWN_EVIDENCE', 'NOT_ECONOMIC', 'REFERENCE')"), ("5_safe", "disposition IN ('NOT_ECONOMIC', 'REFERENCE')"), ("6_economic", "disposition = 'REFERENCE'"),
        )
    ),
    "redelivery_by_family": f"WITH {_STATE} SELECT tool_family, disposition, count(*) AS calls, {_big('sum(n_bytes)')} AS bytes, {_big('sum(avoided_bytes)')} AS avoided_bytes FROM d GROUP BY 1, 2",
    "recency_hist": f"WITH {_STATE} SELECT {buckets.ladder_sql('call_distance', buckets.RECENCY, buckets.RECENCY_BEYOND)} AS recency, {buckets.ladder_sql('episode_distance', buckets.EPISODES, buckets.EPISODES_BEYOND)} AS episodes, count(*) AS calls, {_big('sum(n_bytes)')} AS bytes FROM d WHERE NOT is_first GROUP BY 1, 2",
    "reference_roundtrip": f"WITH {_STATE} SELECT event_id, regexp_extract(ref, 'sha256=([0-9a-f]+)', 1) = sha AS same_sha, CAST(regexp_extract(ref, 'bytes=([0-9]+)', 1) AS BIGINT) AS parsed_bytes, regexp_extract(ref, 'receipt=(RCP-.+)\\]\\]', 1) AS receipt FROM d WHERE disposition = 'REFERENCE'",
    "family_stats": f"""WITH {TOOL_CALLS_SQL}, f AS ({_families}), s AS (SELECT tool_family, count(*) AS calls, sum(n_bytes) AS bytes, min(n_bytes) AS lo, max(n_bytes) AS hi, list(n_bytes ORDER BY n_bytes) AS l FROM tool_calls GROUP BY 1)
      SELECT f.tool_family, coalesce(calls, 0) AS calls, {_big('coalesce(bytes, 0)')} AS bytes, coalesce(lo, 0) AS min_bytes, coalesce(l[len(l) // 2 + 1], 0) AS median_bytes, coalesce(l[CAST(ceil(0.9 * len(l)) AS BIGINT)], 0) AS p90_bytes, coalesce(hi, 0) AS max_bytes,
      round(coalesce(bytes, 0) * 100.0 / (SELECT sum(bytes) FROM s), 2) AS share_pct FROM f LEFT JOIN s USING (tool_family)""",
    "coverage": f"WITH {TOOL_CALLS_SQL} SELECT count(*) AS calls, {_big('sum(n_bytes)')} AS bytes, count(DISTINCT session_id) AS sessions, round(count(tool_family) * 100.0 / count(*), 2) AS classified_pct FROM tool_calls",
    "episode_discovery": f"""WITH {_PRE}, e AS (SELECT session_id, episode_id, count(*) AS total_calls, count(*) FILTER (pre) AS discovery_calls, {_big('coalesce(sum(n_bytes) FILTER (pre), 0)')} AS discovery_bytes,
      """ + ", ".join(f"count(*) FILTER (pre AND tool_family = '{f}') AS {n}_calls, CAST(coalesce(sum(n_bytes) FILTER (pre AND tool_family = '{f}'), 0) AS BIGINT) AS {n}_bytes" for n, f in (("search", "SEARCH"), ("read", "FILE_READ"), ("directory", "DIRECTORY_LIST"))) + """,
      coalesce(list(DISTINCT target_path) FILTER (pre), []) AS rd, coalesce(list(DISTINCT target_path) FILTER (NOT pre AND is_mutation), []) AS md FROM pw GROUP BY 1, 2)
      SELECT * EXCLUDE (rd, md), len(rd) AS files_read, len(md) AS files_modified, len(list_filter(rd, lambda x: NOT list_contains(md, x))) AS supporting_reads FROM e""",
    "episode_duplicates": f"WITH {_PRE} SELECT tool_family, count(*) AS calls, {_big('sum(n_bytes)')} AS bytes FROM dup WHERE nth > 1 GROUP BY 1",
    "action_chains": f"""WITH {TOOL_CALLS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id, episode_id ORDER BY call_index) AS nth FROM tool_calls),
      c AS (SELECT string_agg(tool_family, ' -> ' ORDER BY nth) AS chain FROM n WHERE nth <= 3 GROUP BY session_id, episode_id HAVING count(*) = 3) SELECT chain, count(*) AS episodes FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
    "avoidable_dedup": f"WITH {_PRE} SELECT * FROM av",
    "priority": f"""WITH {_PRE}, s AS (SELECT {_big('sum(n_bytes) FILTER (pre)')} AS discovery, {_big("sum(n_bytes) FILTER (tool_family = 'SEARCH')")} AS representation FROM pw),
      a AS (SELECT {_big("coalesce(sum(bytes) FILTER (attribution = 'EXACT_REEXPOSURE'), 0)")} AS reexposure_avoidable, {_big("coalesce(sum(bytes) FILTER (attribution = 'DISCOVERY_DUPLICATE'), 0)")} AS discovery_avoidable FROM av)
      SELECT *, CASE WHEN discovery >= representation THEN 'DISCOVERY' ELSE 'REPRESENTATION' END AS highest_observed, CASE WHEN reexposure_avoidable >= discovery_avoidable THEN 'REEXPOSURE' ELSE 'DISCOVERY' END AS highest_avoidable FROM s, a""",
    "reread_changes": f"""WITH {TOOL_CALLS_SQL}, r AS (SELECT *, lag(sha) OVER (PARTITION BY session_id, target_path ORDER BY call_index) AS prior FROM tool_calls WHERE tool_family = 'FILE_READ')
      SELECT CASE WHEN prior IS NULL THEN 'FIRST' WHEN prior = sha THEN 'IDENTICAL' ELSE 'CHANGED' END AS state, count(*) AS reads, {_big('sum(n_bytes)')} AS bytes FROM r GROUP BY 1""",
    "range_overlap": f"""WITH {TOOL_CALLS_SQL}, r AS (SELECT k + 1 AS a, k + 20 AS b, lag(k + 1) OVER w AS pa, lag(k + 20) OVER w AS pb FROM tool_calls WHERE tool_family = 'FILE_READ' WINDOW w AS (PARTITION BY session_id, target_path ORDER BY call_index)),
      q AS (SELECT greatest(a, pa) AS lo, least(b, pb) AS hi FROM r WHERE pa IS NOT NULL) SELECT count(*) FILTER (lo <= hi) AS inclusive_reads, {_big('coalesce(sum(hi - lo + 1) FILTER (lo <= hi), 0)')} AS inclusive_lines, count(*) FILTER (lo < hi) AS strict_reads FROM q""",
    "receipt_decisions": f"WITH {_READS} SELECT event_id, session_id, call_index, source, view, decision, receipt_no, reference_bytes, distance, avoided_bytes FROM r7",
    "salience_hist": f"WITH {_READS} SELECT {buckets.ladder_sql('distance', buckets.SALIENCE, buckets.SALIENCE_BEYOND)} AS salience, count(*) AS reads, {_big('sum(n_bytes)')} AS bytes FROM r7 GROUP BY 1",
    "receipt_manifest": f"WITH {_READS} SELECT decision, count(*) AS reads, {_big('sum(n_bytes)')} AS delivered_bytes, {_big('sum(avoided_bytes)')} AS avoided_bytes FROM r7 GROUP BY 1",
    "read_view_coverage": f"WITH {_READS} SELECT view, count(*) AS reads, count(DISTINCT source) AS sources, count(*) FILTER (decision = 'HISTORICAL_IDENTICAL') AS candidates, {_big('sum(avoided_bytes)')} AS avoided_bytes FROM r7 GROUP BY 1",
    "ledger_chain": f"WITH {_STATE}, l AS (SELECT session_id, list(call_index || ':' || disposition || ':' || sha ORDER BY call_index) AS e FROM d GROUP BY 1) SELECT session_id, len(e) AS entries, list_reduce(list_prepend('', e), lambda a, x: sha256(a || ':' || x)) AS head FROM l",
    "call_output_pairing": f"WITH {_SIDES} SELECT * FROM c JOIN o USING (call_id)",
    "unmatched_calls": f"WITH {_SIDES} SELECT call_id, 'CALL' AS side FROM c WHERE call_id NOT IN (SELECT call_id FROM o) UNION ALL SELECT call_id, 'OUTPUT' AS side FROM o WHERE call_id NOT IN (SELECT call_id FROM c)",
    "at_most_once": f"WITH {TOOL_CALLS_SQL} SELECT session_id || '/' || k AS call_id, event_id, call_index FROM tool_calls QUALIFY row_number() OVER (PARTITION BY session_id, k ORDER BY call_index) = 1",
    "conversation_episodes": f"WITH e AS (SELECT *, {_big('''sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)''')} AS episode_id FROM conversations) SELECT conv_id, episode_id, count(*) AS turns, min(turn) AS first_turn, {_big('sum(strlen(text))')} AS bytes FROM e GROUP BY 1, 2",
    "reference_cap": f"""WITH {_STATE}, a AS (SELECT *, coalesce(max(exit_code) OVER w, 0) > 0 AS stopped FROM d WINDOW w AS (PARTITION BY session_id ORDER BY call_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      b AS (SELECT *, coalesce(sum(CASE WHEN disposition = 'REFERENCE' AND NOT stopped THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY call_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM a)
      SELECT CASE WHEN disposition <> 'REFERENCE' THEN 'RAW' WHEN stopped THEN 'RAW_AFTER_FAILURE' WHEN used >= 3 THEN 'RAW_CAPPED' ELSE 'REFERENCE' END AS delivery, count(*) AS calls, {_big('sum(n_bytes)')} AS bytes FROM b GROUP BY 1""",
    "structural_trace": f"""WITH {TOOL_CALLS_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY call_index DESC) AS back, count(*) OVER (PARTITION BY session_id) AS n FROM tool_calls)
      SELECT session_id, max(greatest(n - 64, 0)) AS dropped, string_agg(tool_family, ',' ORDER BY call_index) AS trace FROM t WHERE back <= 64 GROUP BY 1""",
    "delivery_economics": f"""WITH {_READS}, x AS (SELECT *, CASE WHEN call_index % 5 = 0 THEN n_bytes ELSE 0 END AS rec FROM r7 WHERE decision = 'HISTORICAL_IDENTICAL')
      SELECT session_id, {_big('sum(n_bytes)')} AS raw_bytes, {_big('sum(reference_bytes)')} AS reference_bytes, {_big('sum(rec)')} AS recovery_bytes, {_big('sum(n_bytes - reference_bytes - rec)')} AS net_bytes FROM x GROUP BY 1""",
}

QUERIES = {name: globals()[name] for name in SQL}
