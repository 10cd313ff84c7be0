"""Queries over mission context and section selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import maps, sections
from tracewell.operators import foundations, mission
from tracewell.plans import documents
from tracewell.sources.tables import table

_MODES = ("INLINE_CRITICAL", "REFERENCE_CANONICAL", "DELTA", "DROP_DUPLICATE")


def mission_modes(spark, sf_dir):
    """Every document as a foundation under each mode in turn."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.get(F.array(*map(F.lit, _MODES)), (i % 4).cast("int")).alias("mode"),
        F.concat(F.lit("commit 0123456789\n"), F.col("text")).alias("foundation"),
        F.when(i % 4 == 3, F.concat(F.lit("commit 0123456789\n"), F.when(i % 5 == 0, F.upper("text")).otherwise(F.col("text")))).when(i % 50 == 1, "x").alias("repeated"),
        F.when(i % 7 == 0, "").otherwise(F.when(i % 4 == 2, "delta").otherwise("")).alias("delta"),
        F.when(i % 11 == 0, "").otherwise("commit 0123456789").alias("inline"),
        F.when(i % 13 == 0, None).otherwise("NON_SENSITIVE").alias("assessment"),
    )
    return mission.mode_decisions(d, F.array(F.lit("commit 0123456789"))).select("doc_id", "mode", "reason", "avoided_bytes")


def section_selection(spark, sf_dir):
    """Documents made Markdown, one section each, by why a selection fell back."""
    i = F.col("doc_id")
    raw = F.concat(F.lit("# Top\n"), F.col("text"), F.when(i % 9 == 0, "\n```\n").otherwise("\n"), F.lit("## Part\nbody\n### Inner\nmore\n## Next\nlast\n"))
    wanted = F.when(i % 7 == 0, F.array(F.lit("Nowhere"))).when(i % 5 == 0, F.array(F.lit("Part"), F.lit("Inner"))).otherwise(F.array(F.lit("Part")))
    s = table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"), sections.select_udf()(raw.cast("binary"), wanted).alias("s"))
    return s.groupBy(F.coalesce("s.fallback", F.lit("SELECTED")).alias("outcome")).agg(F.count("*").alias("docs"), F.sum(F.octet_length("s.content").cast("long") - F.when(F.col("s.fallback").isNull(), 0).otherwise(F.octet_length("raw"))).alias("selected_bytes"))


def _foundations(spark, sf_dir):
    """Every document delivered twice to a session, with facts; some unassessed, some without their fact, some with other facts the second time."""
    i = F.col("doc_id")
    fact = lambda name, value: F.struct(F.lit(name).alias("id"), value.alias("value"))
    head = F.concat(F.lit("task "), i.cast("string"), F.lit("\n"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("s"), (i % 20).cast("string")).alias("session_id"), F.concat(F.when(i % 7 == 0, F.lit("")).otherwise(head), F.coalesce("text", F.lit("")), F.lit("\n")).cast("binary").alias("foundation"), F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"), F.when(i % 11 != 0, "NON_SENSITIVE").alias("assessment"))
    facts = F.array(fact("task", F.concat(F.lit("task "), i.cast("string"))), fact("end", F.when((i % 13 == 0) & (F.col("turn") == 1), F.lit("task")).otherwise(F.lit("\n"))))
    return d.select("*", facts.alias("facts"), (i * 2 + F.col("turn")).alias("at"))


def foundation_receipts(spark, sf_dir):
    """Foundations by why they are canonical or not, with the bytes and occurrences that receipts stand for."""
    c = foundations.canonicalize(_foundations(spark, sf_dir), "at")
    return c.groupBy(F.regexp_extract("reason", "^[A-Z0-9_]+", 0).alias("reason"), "turn").agg(F.count("*").alias("deliveries"), F.sum("n_bytes").alias("bytes"), F.sum(F.element_at("required", 2)["times"]).alias("line_ends"))


def foundation_recovery(spark, sf_dir):
    """References of all sessions, some of another session, another length or another digest, recovered from one store."""
    c = foundations.canonicalize(_foundations(spark, sf_dir), "at")
    i = F.col("doc_id")
    text = F.format_string(foundations.REFERENCE, "session_id", F.when(i % 17 == 3, F.sha2(i.cast("string"), 256)).otherwise(F.sha2("foundation", 256)), F.octet_length("foundation") + F.when(i % 17 == 4, 1).otherwise(0))
    asked = _foundations(spark, sf_dir).where("turn = 0").select("doc_id", F.when(i % 17 == 5, F.lit("s20")).otherwise(F.col("session_id")).alias("session_id"), F.when(i % 17 == 6, F.concat(text, F.lit(" "))).otherwise(text).alias("reference"))
    r = foundations.recover(asked, foundations.receipts(c), foundations.contents(c))
    return r.select("doc_id", "outcome", F.sha2("content", 256).alias("sha"))


def signature_map(spark, sf_dir):
    """Every document as files, one a line, with the line's words as signatures, in a map of a budget of its own."""
    i = F.col("doc_id")
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line, k: F.struct(F.concat(F.lit("L"), k.cast("string")).alias("path"), F.split(line, " ").alias("signatures")))
    m = table(spark, sf_dir, "documents").select("doc_id", maps.budgeted_map(lines, 200 + i % 300).alias("m"))
    return m.select("doc_id", F.sha2("m.text", 256).alias("sha"), "m.n_bytes", "m.tokens_estimate", "m.files", "m.candidates", "m.cut")


SQL = {
    "mission_modes": r"""
WITH d AS (
  SELECT doc_id, ['INLINE_CRITICAL', 'REFERENCE_CANONICAL', 'DELTA', 'DROP_DUPLICATE'][doc_id % 4 + 1] AS mode, 'commit 0123456789' || chr(10) || text AS foundation,
    CASE WHEN doc_id % 4 = 3 THEN 'commit 0123456789' || chr(10) || CASE WHEN doc_id % 5 = 0 THEN upper(text) ELSE text END WHEN doc_id % 50 = 1 THEN 'x' END AS repeated,
    CASE WHEN doc_id % 7 <> 0 AND doc_id % 4 = 2 THEN 'delta' ELSE '' END AS delta, CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'commit 0123456789' END AS inline, doc_id % 13 = 0 AS unassessed FROM documents
), n AS (
  SELECT *, strlen(CASE WHEN mode = 'DROP_DUPLICATE' AND repeated IS NOT NULL THEN repeated ELSE foundation END) + strlen(delta) AS raw,
    strlen('[[CONTEXT sha256=' || sha256(foundation) || ' bytes=' || strlen(foundation) || ']]') + 1 + strlen(inline) + strlen(delta) AS cand,
    (strlen(foundation) - strlen(replace(foundation, 'commit 0123456789', ''))) // 17 <= (strlen(inline) - strlen(replace(inline, 'commit 0123456789', ''))) // 17 AS held FROM d
), r AS (
  SELECT *, CASE WHEN unassessed THEN 'ASSESSMENT' WHEN mode = 'INLINE_CRITICAL' THEN 'BASELINE' WHEN mode IN ('REFERENCE_CANONICAL', 'DROP_DUPLICATE') AND delta <> '' THEN 'EXACT_DUPLICATE_NEEDED'
    WHEN mode = 'DELTA' AND delta = '' THEN 'DELTA_NEEDED' WHEN mode = 'DROP_DUPLICATE' AND repeated IS DISTINCT FROM foundation THEN 'REPEAT_NOT_PROVEN' WHEN mode <> 'DROP_DUPLICATE' AND repeated IS NOT NULL THEN 'REPEAT_NOT_ALLOWED'
    WHEN NOT held THEN 'FACTS_NOT_INLINE' WHEN cand >= raw THEN 'NOT_ECONOMIC' ELSE 'CANDIDATE' END AS reason FROM n
)
SELECT doc_id, mode, reason, CASE WHEN reason = 'CANDIDATE' THEN raw - cand ELSE 0 END AS avoided_bytes FROM r
""",
}
SQL["section_selection"] = """
WITH d AS (
  SELECT doc_id, '# Top' || chr(10) || text || CASE WHEN doc_id % 9 = 0 THEN chr(10) || '```' || chr(10) ELSE chr(10) END || '## Part' || chr(10) || 'body' || chr(10) || '### Inner' || chr(10) || 'more' || chr(10) || '## Next' || chr(10) || 'last' || chr(10) AS raw FROM documents
), o AS (
  SELECT *, CASE WHEN doc_id % 9 = 0 THEN 'UNCLOSED_FENCE' WHEN doc_id % 7 = 0 THEN 'MISSING_HEADING' ELSE 'SELECTED' END AS outcome FROM d
)
SELECT outcome, count(*) AS docs, CAST(sum(CASE WHEN outcome = 'SELECTED' THEN strlen('## Part' || chr(10) || 'body' || chr(10) || '### Inner' || chr(10) || 'more' || chr(10)) ELSE 0 END) AS BIGINT) AS selected_bytes FROM o GROUP BY 1
"""
SQL["signature_map"] = """WITH RECURSIVE d AS (SELECT doc_id, 200 + doc_id % 300 AS budget, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
  f AS (SELECT doc_id, budget, unnest(range(len(ls))) AS k, unnest(list_transform(ls, lambda l: string_split(l, ' '))) AS w FROM d),
  r AS (
    SELECT doc_id, CAST(-1 AS BIGINT) AS k, '' AS t, CAST(0 AS BIGINT) AS files, false AS cut, false AS over FROM d
    UNION ALL
    SELECT doc_id, k, t || CASE WHEN n > 0 THEN 'L' || k || ':' || chr(10) || array_to_string(list_transform(w[1:n - 1], lambda s: '  ' || s || chr(10)), '') ELSE '' END, files + CAST(n > 0 AS INT), cut OR n <= len(w), n = 0
    FROM (SELECT r.doc_id, f.k, t, files, cut, w, len(list_filter(range(len(w) + 1), lambda j: strlen(t) + strlen('L' || f.k) + 2 + strlen(array_to_string(w[1:j], '')) + 3 * j <= budget)) AS n FROM r JOIN f ON f.doc_id = r.doc_id AND f.k = r.k + 1 WHERE NOT over)
  ), z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) AS back FROM r)
SELECT doc_id, sha256(t) AS sha, strlen(t) AS n_bytes, CAST(ceil(strlen(t) / 4) AS BIGINT) AS tokens_estimate, files, CAST(len(ls) AS BIGINT) AS candidates, cut FROM z JOIN d USING (doc_id) WHERE back = 1"""
_secret = f"regexp_matches(regexp_replace(f, {documents._q(documents.text.ANSI)}, '', 'g'), {documents._i(documents.text.SECRET)})"
_FO = f"""d AS (SELECT doc_id, 's' || doc_id % 20 AS session_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'task ' || doc_id || chr(10) END || coalesce(text, '') || chr(10) AS f, doc_id % 11 = 0 AS unassessed FROM documents),
  g AS (SELECT *, CASE WHEN unassessed THEN 'ASSESSMENT' WHEN {_secret} THEN 'SENSITIVE' WHEN NOT contains(f, 'task ' || doc_id) THEN 'FACT_MISSING' ELSE 'CANONICAL' END AS r0 FROM d),
  t AS (SELECT g.*, turn, CASE WHEN r0 = 'CANONICAL' AND turn = 1 AND doc_id % 13 = 0 THEN 'CONTRACT_CHANGED' ELSE r0 END AS reason FROM g, (VALUES (0), (1)) AS v(turn))"""
SQL["foundation_receipts"] = f"""WITH {_FO} SELECT reason, turn, count(*) AS deliveries, CAST(sum(CASE WHEN reason = 'CANONICAL' THEN strlen(f) END) AS BIGINT) AS bytes,
  CAST(sum(CASE WHEN reason = 'CANONICAL' THEN strlen(f) - strlen(replace(f, chr(10), '')) END) AS BIGINT) AS line_ends FROM t GROUP BY 1, 2"""
SQL["foundation_recovery"] = f"""WITH {_FO}, o AS (SELECT *, CASE WHEN doc_id % 17 = 6 THEN 'MALFORMED' WHEN doc_id % 17 = 5 THEN 'CROSS_SESSION' WHEN doc_id % 17 = 3 OR r0 <> 'CANONICAL' THEN 'UNISSUED' WHEN doc_id % 17 = 4 THEN 'LENGTH_MISMATCH' ELSE 'RECOVERED' END AS outcome FROM g)
  SELECT doc_id, outcome, CASE WHEN outcome = 'RECOVERED' THEN sha256(f) END AS sha FROM o"""
QUERIES = {name: globals()[name] for name in SQL}
