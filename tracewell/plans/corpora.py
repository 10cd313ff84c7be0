"""Queries over labelled corpora, mission spans, manifests and ledgers, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import mission, replay
from tracewell.plans import documents
from tracewell.plans.sessions import _READS, _reads
from tracewell.sources import sinks
from tracewell.sources.scratch import Steps
from tracewell.sources.tables import table


def _entry_lines(spark, sf_dir):
    """A corpus of all contents as JSON lines, some with one fault each, remarks and blank lines between."""
    c = documents.captured(spark, sf_dir)
    i = F.col("doc_id")
    bad = lambda k: i % 29 == k
    label = lambda *more: F.struct(
        F.when(bad(1), "NONSENSE").when(i % 10 == 0, "FAILURE").when(i % 10 == 1, "NOISE").otherwise("PROGRESS").alias("evidence_class"), F.when(bad(2), "MAYBE").when(i % 10 == 0, F.when(bad(3), "SAFE_TO_REDUCE").otherwise("RAW_REQUIRED")).when(i % 4 == 3, "UNKNOWN").otherwise("SAFE_TO_REDUCE").alias("transform_eligibility"),
        F.when(bad(4), F.array(F.lit("no such fact"))).when(i % 10 == 1, F.array(F.lit("Building"))).otherwise(F.array().cast("array<string>")).alias("inline_required_facts"), F.when((i % 10 > 0) & (i % 4 != 3) & ~bad(2), F.when(i % 3 == 0, "REPETITIVE_PROGRESS").when(i % 3 == 1, "OTHER")).alias("missed_opportunity_category"), *more,
    )
    data = F.coalesce(F.col("content"), F.lit("")).cast("binary")
    source = F.struct(F.col("command"), F.col("exit_code").cast("int").alias("exit_code"), "stream", F.when(bad(5), "!").otherwise(F.regexp_replace(F.base64(data), r"\s", "")).alias("raw_content_b64"), F.when(bad(6), "some/file").alias("raw_ref_path"), (F.octet_length(data) + F.when(bad(7), 1).otherwise(0)).cast("long").alias("byte_length"), "truncated")
    screen = F.struct(F.when(bad(8), "LOOKED").otherwise("DETECTOR_NO_MATCH").alias("result"), F.when(bad(9), "").otherwise("scan").alias("method"))
    heuristic = F.when(i % 2 == 0, label(F.when(bad(10), "").otherwise("extractor").alias("method")))
    oracle = F.when((i % 2 == 1) | (i % 6 == 0), label(F.when(bad(11), "RUMOUR").otherwise("HUMAN_REVIEW").alias("provenance"), F.lit("r1").alias("reviewer_id"), F.lit("p1").alias("review_protocol"), F.when(i % 31 == 0, "SENSITIVE_SECRET").otherwise("NOT_SENSITIVE").alias("sensitivity")))
    version = F.when(bad(12), 2).when(i % 17 == 0, 3).otherwise(4)
    line = F.to_json(F.struct(version.alias("schema_version"), F.concat(F.lit("e"), i.cast("string")).alias("entry_id"), source.alias("source_data"), screen.alias("sensitivity_screening"), heuristic.alias("heuristic_suggestion"), oracle.alias("oracle_labels"), F.array(F.lit("t")).alias("tags")))
    each = F.array(F.struct((i * 3).alias("line_no"), F.when(bad(13), F.lit("{broken")).otherwise(line).alias("value")), F.struct((i * 3 + 1).alias("line_no"), F.lit("# remark").alias("value")), F.struct((i * 3 + 2).alias("line_no"), F.lit("  ").alias("value")))
    return c.select(F.inline(each))


def _entries(spark, sf_dir):
    return replay.with_bytes(replay.parse_entries(_entry_lines(spark, sf_dir), migrate=True))


def corpus_problems(spark, sf_dir):
    """What is wrong with every entry of the corpus, migrated entries included."""
    e = _entries(spark, sf_dir)
    return e.select((F.col("line_no") / 3).cast("long").alias("doc_id"), F.coalesce("error", F.array_join(replay.problems(), ",")).alias("problems"), F.octet_length("raw").cast("long").alias("n_bytes"), F.coalesce(F.col("heuristic_suggestion.method") == "V3_MIGRATED_LABEL", F.lit(False)).alias("migrated"))


def corpus_roundtrip(spark, sf_dir):
    """Entries that are read, written and read again; without their bytes only the length stays."""
    e = _entries(spark, sf_dir).where(F.col("error").isNull())
    again = replay.parse_entries(e.select("line_no", replay.to_line().alias("value"))).select("line_no", replay.to_line().alias("again"))
    both = e.select("line_no", replay.to_line().alias("line"), replay.to_line(False).alias("bare")).join(again, "line_no")
    return both.agg(F.count("*").alias("entries"), F.count_if(F.col("line") == F.col("again")).alias("same"), F.count_if(F.contains("bare", F.lit("raw_content_b64"))).alias("leaks"))


def _outcomes(spark, sf_dir):
    e = _entries(spark, sf_dir).where(F.col("error").isNull()).withColumn("doc_id", (F.col("line_no") / 3).cast("long"))
    done = documents._processed(spark, sf_dir).select("doc_id", "content", "visible", "disposition", "persistence", "evidence", "n_bytes")
    return replay.safety_outcome(replay.label_scopes(e).join(done, "doc_id"))


def scope_safety(spark, sf_dir):
    return _outcomes(spark, sf_dir).groupBy("scope", "outcome").agg(F.count("*").alias("entries"))


def missed_report(spark, sf_dir):
    return replay.bucket_report(_outcomes(spark, sf_dir))


def review_ids(spark, sf_dir):
    """Reviews of entries that the corpus does not hold."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("entry_id"))
    r = replay.sidecar(table(spark, sf_dir, "labels").select((F.col("doc_id") * 2).cast("string").alias("entry_id"), F.lit("x").alias("raw_sha256")))
    return replay.unknown_reviews(d, r).select("entry_id")


def _missions(spark, sf_dir):
    """Every document twice over: its second half repeats the first; spans of it claim one thing or another."""
    i, t = F.col("doc_id"), F.concat(F.lit("0123456789"), F.coalesce("text", F.lit("")))
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"), F.octet_length(t).cast("long").alias("h"))
    h = F.col("h")
    span = lambda a, b, kind, path=None, sha=None, lo=None, hi=None: F.struct(a.cast("long").alias("start"), b.cast("long").alias("stop"), F.lit(kind).alias("kind"), (path if path is not None else F.lit(None)).cast("string").alias("path"), (sha if sha is not None else F.lit(None)).cast("string").alias("sha"), (lo if lo is not None else F.lit(None)).cast("long").alias("from"), (hi if hi is not None else F.lit(None)).cast("long").alias("to"))
    q = F.floor(h / 4)
    doc = F.concat(F.lit("docs/"), i.cast("string"))
    sha = F.when(i % 9 == 0, F.lit("0" * 64)).otherwise(F.sha2("t", 256))
    spans = F.array(
        span(h, h + q, "DROP_DUPLICATE", lo=F.when(i % 5 == 0, F.lit(1)).otherwise(F.lit(0)), hi=q + F.when(i % 5 == 0, 1).otherwise(0)),
        span(F.lit(0), F.lit(2), "INLINE_CRITICAL"),
        span(h + q, 2 * h, "REFERENCE_CANONICAL", F.when(i % 8 == 0, F.concat(F.lit("../"), doc)).otherwise(doc), sha, q, h),
        span(F.lit(2), F.when(i % 13 == 0, h + 1).otherwise(F.lit(4)), "DELTA"),
    )
    return d.select(i.alias("mission"), F.concat("t", "t").cast("binary").alias("raw"), F.when(i % 7 == 0, None).otherwise("NON_SENSITIVE").alias("assessment"), spans.alias("spans")), d.select(doc.alias("path"), F.sha2("t", 256).alias("sha"), F.col("t").cast("binary").alias("content"))


def mission_spans(spark, sf_dir):
    return mission.account_spans(*_missions(spark, sf_dir))


def mission_candidates(spark, sf_dir):
    """Candidates by their digest, and what comes of restoring them; some lose their artifact, some a byte."""
    missions, artifacts = _missions(spark, sf_dir)
    i = F.col("mission")
    # written, so that missions are screened and assembled once for both uses
    c = Steps(spark, "candidates").append(mission.assemble(missions, artifacts))
    given = c.withColumn("candidate", F.when(i % 19 == 0, F.substring("candidate", F.lit(1), (F.octet_length("candidate") - 1).cast("int"))).otherwise(F.col("candidate")))
    r = mission.restore(given, artifacts.where(~F.col("path").endswith("4"))).withColumnRenamed("mission", "_m")
    return c.join(r, F.col("_m") == i).select("mission", F.sha2("candidate", 256).alias("candidate_sha"), F.size("recipe").cast("long").alias("left_out"), "outcome", F.sha2("restored", 256).alias("restored_sha"))


def mission_span_totals(spark, sf_dir):
    a = mission_spans(spark, sf_dir).withColumn("quality", F.when(F.col("mission") % 3 == 0, "SYNTHETIC").otherwise("EXACT"))
    return mission.span_totals(a)


def manifest_shadow(spark, sf_dir):
    """A manifest for every document, what it costs, and whether odd ones are refused."""
    i = F.col("doc_id")
    entries = F.transform(F.sequence(F.lit(1), (1 + i % 5).cast("int")), lambda k: F.array(F.lit("R"), k.cast("string"), F.lit("x")))
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n"), mission.encode_manifest(entries, F.sha2("text", 256), F.concat(F.lit("m"), i.cast("string")), F.octet_length("text"), F.lit("NON_SENSITIVE")).alias("text"))
    odd = F.when(i % 6 == 1, F.replace("text", F.lit('"m":'), F.lit('"q":'))).when(i % 6 == 2, F.replace("text", F.lit('"m":'), F.lit('"m":"a","m":'))).when(i % 6 == 3, F.replace("text", F.lit("NON_SENSITIVE"), F.lit("FINE"))).when(i % 6 == 4, F.repeat("text", 2000)).otherwise(F.col("text"))
    p = mission.parse_manifest(odd)
    return d.select("doc_id", F.octet_length("text").cast("long").alias("cost"), p["error"].alias("error"), F.size(p["manifest"]["e"]).cast("long").alias("entries"), mission.manifest_gain(F.col("n"), F.col("text")).cast("long").alias("gain"))


def receipt_ledger(spark, sf_dir):
    """Every receipt decision in its session's chain, with short digests."""
    r = _reads(spark, sf_dir)
    return sinks.chained(r, "session_id", "call_index", F.concat_ws(":", F.col("event_id").cast("string"), "decision", "sha"), digits=16).select("session_id", "at", "before", "hash")


def ledger_check(spark, sf_dir):
    """A ledger with some payloads changed after the fact: the entries that show it."""
    r = _reads(spark, sf_dir)
    ledger = sinks.chained(r, "session_id", "call_index", F.col("decision"))
    forged = ledger.withColumn("payload", F.when(F.col("at") % 10 == 3, "FORGED").otherwise(F.col("payload")))
    return sinks.broken_chains(forged, "session_id").groupBy("session_id").agg(F.count("*").alias("broken"), F.min("at").alias("first"))


def decision_manifest(spark, sf_dir):
    return sinks.manifest(_reads(spark, sf_dir))


_C = "WITH " + documents._CAPTURED
_LAB = """en AS (
  SELECT doc_id, doc_id % 29 AS b, coalesce(content, '') AS content, CASE WHEN doc_id % 29 = 12 THEN 2 WHEN doc_id % 17 = 0 THEN 3 ELSE 4 END AS version, doc_id % 2 = 0 AS has_h, doc_id % 2 = 1 OR doc_id % 6 = 0 AS has_o,
    CASE WHEN doc_id % 29 = 1 THEN 'NONSENSE' WHEN doc_id % 10 = 0 THEN 'FAILURE' WHEN doc_id % 10 = 1 THEN 'NOISE' ELSE 'PROGRESS' END AS cls,
    CASE WHEN doc_id % 29 = 2 THEN 'MAYBE' WHEN doc_id % 10 = 0 THEN CASE WHEN doc_id % 29 = 3 THEN 'SAFE_TO_REDUCE' ELSE 'RAW_REQUIRED' END WHEN doc_id % 4 = 3 THEN 'UNKNOWN' ELSE 'SAFE_TO_REDUCE' END AS el,
    CASE WHEN doc_id % 10 > 0 AND doc_id % 4 <> 3 AND doc_id % 29 <> 2 THEN CASE doc_id % 3 WHEN 0 THEN 'REPETITIVE_PROGRESS' WHEN 1 THEN 'OTHER' END END AS bucket, doc_id % 31 = 0 AS secret FROM cap
), lb AS (
  SELECT *, version = 3 AND has_o AS migrated, has_h OR (version = 3 AND has_o) AS h, has_o AND version <> 3 AS o FROM en
), fp AS (
  SELECT *, list_filter([CASE WHEN b = 6 THEN 'ONE_SOURCE' END, CASE WHEN b = 5 THEN 'BYTES' END, CASE WHEN b = 7 THEN 'LENGTH' END, CASE WHEN b = 8 THEN 'SCREENING' END, CASE WHEN b = 9 THEN 'SCREENING_METHOD' END, CASE WHEN NOT h AND NOT o THEN 'NO_LABELS' END], lambda x: x IS NOT NULL)
    || CASE WHEN h THEN list_filter([CASE WHEN b = 1 THEN 'HEURISTIC_CLASS' END, CASE WHEN b = 2 THEN 'HEURISTIC_ELIGIBILITY' END, CASE WHEN el = 'SAFE_TO_REDUCE' AND cls = 'FAILURE' THEN 'HEURISTIC_PROTECTED_SAFE' END, CASE WHEN b = 4 THEN 'HEURISTIC_FACT_ABSENT' END, CASE WHEN b = 10 AND NOT migrated THEN 'HEURISTIC_METHOD' END], lambda x: x IS NOT NULL) ELSE [] END
    || CASE WHEN o THEN list_filter([CASE WHEN b = 1 THEN 'ORACLE_CLASS' END, CASE WHEN b = 2 THEN 'ORACLE_ELIGIBILITY' END, CASE WHEN el = 'SAFE_TO_REDUCE' AND cls = 'FAILURE' THEN 'ORACLE_PROTECTED_SAFE' END, CASE WHEN b = 4 THEN 'ORACLE_FACT_ABSENT' END, CASE WHEN b = 11 THEN 'ORACLE_PROVENANCE' END, CASE WHEN secret AND el = 'SAFE_TO_REDUCE' THEN 'ORACLE_SENSITIVE_SAFE' END], lambda x: x IS NOT NULL) ELSE [] END AS errs,
    CASE WHEN b = 13 THEN 'MALFORMED' WHEN b = 12 THEN 'UNSUPPORTED_VERSION' END AS error FROM lb
), sv AS (
  SELECT doc_id, 'ORACLE:' || CASE WHEN b = 11 THEN 'RUMOUR' ELSE 'HUMAN_REVIEW' END AS scope, cls, el, bucket, secret FROM fp WHERE o AND error IS NULL
  UNION ALL SELECT doc_id, 'HEURISTIC:' || CASE WHEN migrated THEN 'V3_MIGRATED_LABEL' WHEN b = 10 THEN '' ELSE 'extractor' END, cls, el, bucket, false FROM fp WHERE h AND error IS NULL
), so AS (
  SELECT sv.*, n_bytes, CASE WHEN secret AND persistence = 'PERSIST' THEN 'UNSAFE_SENSITIVITY_LEAK'
    WHEN reason = 'VALIDATED' AND (el = 'RAW_REQUIRED' OR cls = 'FAILURE' OR secret OR sv.doc_id % 29 = 4) THEN 'DANGEROUS_TRANSFORM' WHEN el = 'SAFE_TO_REDUCE' AND reason <> 'VALIDATED' THEN 'SAFE_OPPORTUNITY_MISSED' WHEN el = 'UNKNOWN' THEN 'LABEL_UNCERTAIN' ELSE 'SAFE_MATCH' END AS outcome
  FROM sv JOIN pz USING (doc_id)
)"""
_big = "CAST({} AS BIGINT)".format
_MS = f"""m AS (SELECT doc_id AS mission, '0123456789' || coalesce(text, '') AS t FROM documents), n AS (SELECT *, strlen(t) AS h, strlen(t) // 4 AS q, regexp_matches(regexp_replace(t || t, {documents._q(documents.text.ANSI)}, '', 'g'), {documents._i(documents.text.SECRET)}) AS secret FROM m),
  a AS (SELECT *, mission % 13 <> 0 AS valid, mission % 7 <> 0 AND NOT secret AS allowed, strlen('[[CANONICAL {{"end":' || h || ',"path":"docs/' || mission || '","sha256":"' || sha256(t) || '","start":' || q || '}}]]') AS mk FROM n),
  p AS (SELECT *, valid AND allowed AND (mission % 5 > 0 OR t[2:q + 1] = t[1:q]) AS dup, valid AND allowed AND mission % 9 > 0 AND mission % 8 > 0 AS ref FROM a),
  ac AS (SELECT mission, 2 * h AS raw_bytes, valid, CASE WHEN valid THEN 2 ELSE 0 END AS inline_bytes, CASE WHEN valid THEN 2 ELSE 0 END AS delta_bytes, CASE WHEN ref THEN h - q ELSE 0 END AS reference_bytes, CASE WHEN dup THEN q ELSE 0 END AS duplicate_bytes,
    CASE WHEN valid THEN CAST(NOT dup AS INT) + CAST(NOT ref AS INT) ELSE 0 END AS failures, 2 * h - CASE WHEN dup THEN q ELSE 0 END - CASE WHEN ref THEN h - q - least(h - q, mk) ELSE 0 END AS candidate_bytes FROM p),
  sp AS (SELECT *, raw_bytes - inline_bytes - delta_bytes - reference_bytes - duplicate_bytes AS unknown_bytes FROM ac)"""

SQL = {
    "corpus_problems": f"{_C}, {_LAB} SELECT doc_id, coalesce(error, array_to_string(errs, ',')) AS problems, CASE WHEN error IS NULL AND b <> 5 THEN strlen(content) END AS n_bytes, error IS NULL AND migrated AS migrated FROM fp",
    "corpus_roundtrip": f"{_C}, {_LAB} SELECT count(*) AS entries, count(*) AS same, CAST(0 AS BIGINT) AS leaks FROM fp WHERE error IS NULL",
    "scope_safety": f"{_C}, {_LAB} SELECT scope, outcome, count(*) AS entries FROM so GROUP BY 1, 2",
    "missed_report": f"{_C}, {_LAB}, g AS (SELECT scope, coalesce(bucket, 'OTHER') AS bucket, count(*) AS entries, {_big('sum(n_bytes)')} AS bytes FROM so WHERE outcome = 'SAFE_OPPORTUNITY_MISSED' GROUP BY 1, 2) SELECT *, bytes / 4.0 AS tokens_estimate, round(bytes * 100.0 / sum(bytes) OVER (PARTITION BY scope), 2) AS share_pct FROM g",
    "review_ids": "SELECT CAST(doc_id * 2 AS VARCHAR) AS entry_id FROM labels WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)",
    "mission_spans": f"WITH {_MS} SELECT mission, raw_bytes, valid, {', '.join(_big(c) + ' AS ' + c for c in ('inline_bytes', 'delta_bytes', 'reference_bytes', 'duplicate_bytes', 'failures'))}, unknown_bytes, candidate_bytes FROM sp",
    "mission_candidates": f"""WITH {_MS}, x AS (SELECT mission, hex(encode(t)) AS t, q, dup, ref AND mk < h - q AS cut, hex(encode('[[CANONICAL {{"end":' || h || ',"path":"docs/' || mission || '","sha256":"' || sha256(t) || '","start":' || q || '}}]]')) AS marker FROM p),
      o AS (SELECT *, unhex(t || CASE WHEN dup THEN '' ELSE t[1:2 * q] END || CASE WHEN cut THEN marker ELSE t[2 * q + 1:] END) AS c, CASE WHEN mission % 19 = 0 AND cut THEN 'MARKER_MISMATCH' WHEN cut AND mission % 10 = 4 THEN 'MISSING_ARTIFACT' WHEN mission % 19 = 0 THEN 'LENGTH_MISMATCH' ELSE 'RESTORED' END AS outcome FROM x)
      SELECT mission, sha256(c) AS candidate_sha, CAST(dup AS BIGINT) + CAST(cut AS BIGINT) AS left_out, outcome, CASE WHEN outcome = 'RESTORED' THEN sha256(unhex(t || t)) END AS restored_sha FROM o""",
    "mission_span_totals": f"WITH {_MS} SELECT count(*) AS missions, round(median((1 - candidate_bytes / raw_bytes) * 100), 2) AS median_reduction_pct, {_big('sum(reference_bytes + duplicate_bytes)')} AS proven_bytes, {_big('sum(unknown_bytes)')} AS unknown_bytes FROM sp WHERE mission % 3 <> 0",
    "manifest_shadow": """WITH e AS (SELECT doc_id, strlen(text) AS n, '{"e":[' || array_to_string(list_transform(range(1, doc_id % 5 + 2), lambda k: '["R","' || k || '","x"]'), ',') || '],"h":"' || sha256(text) || '","m":"m' || doc_id || '","n":' || strlen(text) || ',"s":"NON_SENSITIVE","v":"MANIFEST_V1"}' || chr(10) AS t FROM documents)
      SELECT doc_id, strlen(t) AS cost, CASE doc_id % 6 WHEN 1 THEN 'FIELDS' WHEN 2 THEN 'FIELDS' WHEN 3 THEN 'ASSESSMENT' WHEN 4 THEN 'LENGTH' END AS error, CASE WHEN doc_id % 6 IN (0, 5) THEN doc_id % 5 + 1 END AS entries, n - strlen(t) AS gain FROM e""",
    "receipt_ledger": f"""WITH RECURSIVE {_READS}, o AS (SELECT session_id, call_index AS nth, event_id || ':' || decision || ':' || sha AS p, row_number() OVER (PARTITION BY session_id ORDER BY call_index) AS k FROM r7),
      ch AS (SELECT session_id, nth, k, '' AS before, left(sha256(':' || p), 16) AS hash FROM o WHERE k = 1 UNION ALL SELECT o.session_id, o.nth, o.k, ch.hash, left(sha256(ch.hash || ':' || o.p), 16) FROM ch JOIN o ON o.session_id = ch.session_id AND o.k = ch.k + 1)
      SELECT session_id, nth AS "at", before, hash FROM ch""",
    "ledger_check": f"WITH {_READS} SELECT session_id, count(*) AS broken, min(call_index) AS first FROM r7 WHERE call_index % 10 = 3 GROUP BY 1",
    "decision_manifest": f"WITH {_READS}, g AS (SELECT decision, count(*) AS n FROM r7 GROUP BY 1) SELECT {_big('sum(n)')} AS entries, '{{' || string_agg('\"' || decision || '\":' || n, ',' ORDER BY decision) || '}}' AS counts FROM g",
}
QUERIES = {name: globals()[name] for name in SQL}
