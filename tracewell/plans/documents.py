"""Queries over captured texts, rankings, graphs and labelled corpora, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell.functions import codecs, policy, text
from tracewell.operators import corpus, discovery, pipeline, spans, walks
from tracewell.sources import worktree
from tracewell.plans.walk_sql import walk_sql
from tracewell.sources.tables import TOOL_CALLS_SQL, table, tool_calls

NOISE = "Building... [ OK ]\n"
PROGRESS = "Downloading 50%\n"


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as captured outputs: some get the marks of failures, states, noise, matches and so on."""
    d = table(spark, sf_dir, "documents")
    kind = F.col("doc_id") % 10
    before = {0: "error: build failed\n", 3: "commit 0123456789abcdef\nOn branch main\n", 5: "12 passed in 3s\n", 6: "warning: deprecated call\n", 7: "total 8\ndrwx a\n", 8: "0 failures\nbenchmark 1.5 ms mean\n"}
    content = F.when(kind == 1, F.repeat(F.lit(NOISE), (5 + F.col("doc_id") % 20).cast("int"))).when(kind == 2, F.repeat(F.lit(PROGRESS), (4 + F.col("doc_id") % 7).cast("int")))
    content = content.when(kind == 4, F.concat(F.lit('{"k": '), F.col("doc_id"), F.lit("}")))
    for k, mark in before.items():
        content = content.when(kind == k, F.concat(F.lit(mark), F.col("text")))
    content = content.otherwise(F.col("text"))
    i = F.col("doc_id")
    return d.select(
        "doc_id", "lang", "source", "n_chars", content.alias("content"), (i % 23 == 0).cast("long").alias("exit_code"), kind.alias("kind"),
        F.get(F.array(*[F.lit(m) for m in policy.MODES]), (i % 3).cast("int")).alias("mode"),
        F.get(F.array(*map(F.lit, (*policy.PROFILES, "other"))), (i % 4).cast("int")).alias("profile"),
        F.when(i % 17 == 0, "git status").when(i % 17 == 1, "GIT.EXE log").when(i % 17 == 2, None).when(i % 43 == 3, "login --password=x").otherwise("make legit").alias("command"),
        F.when(i % 19 == 0, "stderr").when(i % 3 == 1, "stdout").otherwise("combined").alias("stream"),
        (i % 29 == 0).alias("truncated"), F.when(i % 31 == 0, "json").when(i % 2 == 0, "text").alias("hint"),
        F.when(i % 7 == 0, "DO_NOT_PERSIST").when(i % 2 == 0, "PERSIST").otherwise("EPHEMERAL").alias("persistence"),
        F.when(i % 13 == 0, "SENSITIVE").when(i % 3 == 0, "NON_SENSITIVE").otherwise("UNKNOWN").alias("sensitivity"),
        F.when(i % 37 < 3, F.array(F.lit("Downloading 50%"))).when(i % 41 == 0, F.array(F.lit("absent"))).otherwise(F.array().cast("array<string>")).alias("facts"),
    )


def _classified(spark, sf_dir):
    return captured(spark, sf_dir).withColumn("evidence", text.evidence_class(F.col("content"), F.col("exit_code")))


def sensitive_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.contains_sensitive(F.col("text")).alias("sensitive"))


def evidence_class(spark, sf_dir):
    return _classified(spark, sf_dir).select("doc_id", "evidence")


def required_facts(spark, sf_dir):
    c = captured(spark, sf_dir).withColumn("facts", text.required_facts(F.col("content")))
    return c.where(F.size("facts") > 0).select("doc_id", F.array_join("facts", "|").alias("facts"), text.occurrences(F.col("content"), F.get("facts", F.lit(0))).alias("occurrences"))


def policy_matrix(spark, sf_dir):
    return policy.policy_table(spark)


def invariant_checks(spark, sf_dir):
    """All checks of a proposed fold: machine data is offered one that is not lossless, protected classes
    one that no profile may allow, and some folds would not shrink."""
    c = _classified(spark, sf_dir).withColumn("n_bytes", F.octet_length("content").cast("long"))
    offered = F.when(F.col("doc_id") % 5 < 4, policy.FOLD)
    out = F.when(offered.isNotNull(), F.col("n_bytes") - F.col("doc_id") % 3)
    checks = policy.invariants(F.col("evidence"), F.col("mode"), F.col("exit_code"), offered, F.col("n_bytes"), out)
    c = c.withColumn("checks", checks)
    return c.select("doc_id", "mode", F.array_join(F.transform(F.filter("checks", lambda x: ~x["passed"]), lambda x: x["id"]), ",").alias("failed"), policy.first_forced(F.col("checks")).alias("first_forced"))


def token_estimate(spark, sf_dir):
    n = F.octet_length("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(n.cast("long")).alias("bytes"), F.round(F.sum(text.token_estimate(n)), 2).alias("tokens"))


def _lines(spark, sf_dir):
    return captured(spark, sf_dir).select("doc_id", F.posexplode(text.lines_of(F.col("content"))).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def fold_runs(spark, sf_dir):
    return spans.fold_runs(_lines(spark, sf_dir), "doc_id")


def fold_roundtrip(spark, sf_dir):
    """Folds of all contents: how many got shorter, and how many of those decode to the same bytes."""
    c = captured(spark, sf_dir).withColumn("fold", codecs.fold_udf()(F.col("content").cast("binary")))
    return c.groupBy("kind").agg(F.count("*").alias("docs"), F.count_if(F.col("fold.visible").isNotNull()).alias("folded"), F.count_if(F.col("fold.exact")).alias("exact"))


def _processed(spark, sf_dir):
    return pipeline.process(captured(spark, sf_dir))


def pipeline_result(spark, sf_dir):
    """Every content through screening, class, policy, checks, transform and validation; raw wherever in doubt."""
    return _processed(spark, sf_dir).select("doc_id", "evidence", "mode", "sensitivity", "persistence", "storage", "disposition", "reason", "visible_bytes", F.size("audit").cast("long").alias("checks"))


def replay_rollup(spark, sf_dir):
    """Totals of the pipeline over all contents."""
    return pipeline.replay_summary(_processed(spark, sf_dir))


def exact_content_dups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n"))
    g = d.groupBy("sha").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), F.min("n").alias("n_bytes"))
    return g.where(F.col("copies") > 1).withColumn("repeat_bytes", (F.col("copies") - 1) * F.col("n_bytes"))


def store_dedup(spark, sf_dir):
    """Content-addressed store by fan-out folder: what is kept of what came in; sensitive content is refused."""
    d = table(spark, sf_dir, "documents").withColumn("sha", F.sha2("text", 256))
    kept = d.where(~text.contains_sensitive(F.col("text"))).groupBy("sha").agg(F.min(F.octet_length("text")).alias("n"))
    return kept.groupBy(F.substring("sha", 1, 1).alias("folder")).agg(F.count("*").alias("objects"), F.sum(F.col("n").cast("long")).alias("bytes"))


def search_grouping(spark, sf_dir):
    """Match-line outputs of every session's searches, grouped by path where all gates pass."""
    c = tool_calls(table(spark, sf_dir, "events")).where(F.col("tool_family").isin("SEARCH", "TEST"))
    line = F.transform(F.sequence(F.lit(1), (1 + F.col("k") % 9).cast("int")), lambda i: F.concat(F.col("target_path"), F.lit(":"), i.cast("string"), F.lit(":text "), (i * 7).cast("string"), F.lit("\n")))
    command = F.when(F.col("k") % 10 == 0, "rg text src | head").when(F.col("k") % 10 == 1, "grep -n text src").otherwise("rg -n text src")
    out = c.withColumn("out", F.array_join(line, "")).withColumn("g", codecs.grouping_udf()(F.col("out").cast("binary"), command, F.col("exit_code"), F.col("truncated"), F.lit("stdout")))
    saved = F.when(F.col("g.visible").isNotNull(), F.octet_length("out") - F.octet_length("g.visible")).otherwise(0)
    return out.groupBy(F.col("g.reason").alias("reason")).agg(F.count("*").alias("calls"), F.sum(F.octet_length("out").cast("long")).alias("raw_bytes"), F.sum(saved.cast("long")).alias("saved_bytes"))


def _tokens(c):
    return text.identifier_tokens(F.coalesce(F.col(c), F.lit("")))


def bm25_topk(spark, sf_dir):
    return discovery.bm25(table(spark, sf_dir, "documents"), "doc_id", _tokens("text"), table(spark, sf_dir, "benchmark"), "item_id", _tokens("text"))


def legacy_topk(spark, sf_dir):
    s = text.stems(F.coalesce(F.col("text"), F.lit("")))
    return discovery.stem_overlap(table(spark, sf_dir, "documents"), "doc_id", s, table(spark, sf_dir, "benchmark"), "item_id", s)


def idf_table(spark, sf_dir):
    d = table(spark, sf_dir, "pages")
    n = d.count()
    return discovery.idf_table(discovery.postings(d, "page_id", _tokens("url")), F.lit(n)).withColumn("idf", F.round("idf", 6))


def _leads(text, n: int = 5):
    """Hashes of every ``n`` words in a row; the words are split off once for a text."""
    hashes = lambda ws: F.transform(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - n + 1, F.lit(0))), lambda w, k: F.xxhash64(*[F.get(ws, k + d) for d in range(n)]))
    return F.element_at(F.transform(F.array(F.split(F.trim(text), r"\s+")), hashes), 1)


def hit_rate_mrr(spark, sf_dir):
    """BM25 against the documents that hold an item's whole text, from the start of a word; items have six words at least.

    Documents with the item's first five words are found by their hash, then compared with the whole text.
    """
    items, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    marks = items.where(F.size(F.split(F.trim("text"), r"\s+")) > 5).select("item_id", F.get(_leads(F.col("text")), F.lit(0)).alias("mark"), F.col("text").alias("item"))
    leads = d.select("doc_id", F.explode(F.array_distinct(_leads(F.col("text")))).alias("mark"))
    near = leads.join(marks, "mark").select("item_id", "item", "doc_id").distinct()
    truth = near.join(d.select("doc_id", "text"), "doc_id").where(F.contains("text", "item")).select("item_id", "doc_id").distinct()
    return discovery.retrieval_metrics(bm25_topk(spark, sf_dir), truth, "item_id", "doc_id")


def _graph(spark, sf_dir):
    """Suppliers, nations and regions as a tree."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    edges = s.select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst")).union(n.select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst")))
    nodes = s.select(name("s", "s_suppkey").alias("node")).union(n.select(name("n", "n_nationkey"))).union(r.select(name("r", "r_regionkey")))
    return nodes, edges


def _wide_graph(spark, sf_dir):
    """The tree with every supplier's parts, a chain as long as there are nations, and a part of nothing else."""
    nodes, edges = _graph(spark, sf_dir)
    l, p, n = (table(spark, sf_dir, t) for t in ("lineitem", "part", "nation"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    chain = n.select(F.concat(F.lit("c"), (F.col("n_nationkey") + 1).cast("string")).alias("src"), F.when(F.col("n_nationkey") == 0, "r0").otherwise(name("c", "n_nationkey")).alias("dst"))
    supplied = l.select(name("s", "l_suppkey").alias("src"), name("p", "l_partkey").alias("dst"))
    more = p.select(name("p", "p_partkey").alias("node")).union(n.select(F.concat(F.lit("c"), (F.col("n_nationkey") + 1).cast("string"))))
    return nodes.union(more).union(spark.createDataFrame([("alone",)], "node string")), edges.union(supplied).union(chain)


def graph_neighbors(spark, sf_dir):
    around = discovery.neighbours(_wide_graph(spark, sf_dir)[1])
    return around.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("neighbours"), F.min("dst").alias("first"), F.max("dst").alias("last"))


def in_degree(spark, sf_dir):
    return discovery.in_degree(*_wide_graph(spark, sf_dir))


def bfs_distance(spark, sf_dir):
    nodes, edges = _wide_graph(spark, sf_dir)
    return discovery.distances(nodes, edges, nodes.where(F.col("node") == "r0"))


def pagerank(spark, sf_dir, iterations: int = 8):
    nodes, edges = _graph(spark, sf_dir)
    seeds = nodes.where(F.col("node").startswith("s")).select("node", F.lit(1.0).alias("weight"))
    return discovery.pagerank(nodes, edges, seeds, iterations=iterations, tolerance=None)


def walks_converged(spark, sf_dir):
    """Ranks that have settled, for two sets of seeds at once and for none."""
    nodes, edges = _graph(spark, sf_dir)
    seeds = nodes.where(F.col("node").startswith("s")).select(F.lit("suppliers").alias("query"), "node", F.lit(1.0).alias("weight"))
    seeds = seeds.union(nodes.where(F.col("node").startswith("n")).select(F.lit("nations"), "node", F.length("node").cast("double")))
    queries = spark.createDataFrame([("suppliers",), ("nations",), ("uniform",)], "query string")
    w = walks.personal_walks(queries, nodes, edges, seeds, tolerance=1e-9)
    every = nodes.select("node").crossJoin(F.broadcast(queries))  # three rows
    return w.ranks(every).select("query", "node", F.round("rank", 6).alias("rank"))


def pagerank_converged(spark, sf_dir):
    """Ranks that have settled; ``pagerank`` stops where its SQL does, after 8 steps."""
    return walks_converged(spark, sf_dir).where("query = 'suppliers'").select("node", "rank")


def graph_health(spark, sf_dir):
    nodes, edges = _wide_graph(spark, sf_dir)
    d = nodes.join(discovery.neighbours(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")), "node", "left")
    h = d.agg(F.count("*").alias("nodes"), F.count_if(F.col("n").isNull()).alias("orphans"), F.sum(F.coalesce("n", F.lit(0))).alias("ends"))
    linked = F.round((F.col("nodes") - F.col("orphans")) / F.col("nodes"), 4)
    return h.withColumn("linked_ratio", linked).withColumn("status", F.when(linked >= 0.85, "HIGH").when(linked >= 0.5, "PARTIAL").otherwise("LOW"))


def _views(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", (F.col("n_chars") >= 300).cast("long").alias("predicted"))
    e = d.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return corpus.label_views(e, {"quality": F.col("quality"), "clean": 1 - F.col("toxic")})


def label_confusion(spark, sf_dir):
    return corpus.confusion(_views(spark, sf_dir))


def label_scope_safety(spark, sf_dir):
    return corpus.safety(_views(spark, sf_dir))


BUCKETS = ("EMPTY", "SHORT", "LONG", "FOREIGN", "PLAIN")


def missed_buckets(spark, sf_dir):
    n = F.col("n_chars")
    bucket = F.when(n == 0, "EMPTY").when(n < 200, "SHORT").when(n > 8000, "LONG").when(F.col("lang") != "en", "FOREIGN").otherwise("PLAIN")
    return corpus.bucket_samples(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), bucket, BUCKETS, "doc_id")


def sidecar_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    r = table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", F.when(F.col("doc_id") % 9 == 0, "stale").otherwise(F.col("sha")).alias("review_sha"))
    return corpus.sidecar_join(d, r, "doc_id").groupBy("state").agg(F.count("*").alias("entries"))


def stratified_sample(spark, sf_dir):
    return corpus.periodic_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 8)


def quantile_review(spark, sf_dir):
    return corpus.quantile_review(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "lang", "n_chars", "doc_id")


def first_n_per_reason(spark, sf_dir):
    d = _classified(spark, sf_dir)
    return corpus.first_per_reason(d.where(F.col("evidence") != "UNKNOWN").select("doc_id", "evidence"), "evidence", "doc_id", 5)


def _spans():
    n = F.octet_length("text").cast("long")
    part = lambda a, b, kind: F.struct(F.floor(n * a / 20).alias("start"), F.floor(n * b / 20).alias("stop"), F.lit(kind).alias("kind"))
    return n, F.array(part(1, 3, "CANONICAL"), part(5, 6, "DUPLICATE"), part(10, 14, "CANONICAL"))


def span_accounting(spark, sf_dir):
    n, listed = _spans()
    return spans.span_accounting(table(spark, sf_dir, "documents"), "doc_id", listed, n).groupBy("kind").agg(F.count("*").alias("docs"), F.sum("bytes").alias("bytes"))


def _ranges(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_partkey").cast("long").alias("start"), (F.col("l_partkey") + F.col("l_linenumber")).cast("long").alias("stop"))


def range_union(spark, sf_dir):
    u = spans.range_union(_ranges(spark, sf_dir), "key")
    return u.groupBy("key").agg(F.count("*").alias("ranges"), F.sum(F.col("stop") - F.col("start")).alias("covered"))


def section_bounds(spark, sf_dir):
    h = _lines(spark, sf_dir).where(F.col("line_no") % 3 == 0).withColumn("level", 1 + (F.col("line_no") / 3).cast("long") % 3)
    return spans.section_bounds(h.select("doc_id", F.col("line_no").alias("line"), "level"), "doc_id")


def budgeted_map(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return spans.within_budget(d, "source", ["n_chars", "doc_id"], "n_chars", 4000).select("doc_id", "source", "running")


def _feed(spark, sf_dir):
    """One telemetry record for each session, with maps of bytes and waste counts."""
    c = tool_calls(table(spark, sf_dir, "events"))
    by = c.groupBy("session_id", "tool_family").agg(F.count("*").alias("calls"), F.sum("n_bytes").alias("bytes"))
    rec = by.groupBy("session_id").agg(F.sum("calls").alias("calls"), F.sum("bytes").alias("bytes"), F.map_from_entries(F.collect_list(F.struct("tool_family", "bytes"))).alias("family_bytes"))
    last = F.substring("session_id", -1, 1).cast("int")
    return rec.withColumn("quality", F.when(last % 3 == 0, "EXACT").when(last % 3 == 1, "ESTIMATE").otherwise("UNAVAILABLE")).withColumn("tokens", F.when(F.col("quality") != "UNAVAILABLE", F.col("bytes") / 4))


def feed_rollup(spark, sf_dir):
    """Family bytes and token sums, the latter by how they were measured and never mixed."""
    f = _feed(spark, sf_dir)
    fam = f.select(F.explode("family_bytes").alias("name", "value")).groupBy(F.lit("family_bytes").alias("measure"), "name").agg(F.sum("value").cast("double").alias("total"))
    tok = f.groupBy(F.lit("tokens").alias("measure"), F.col("quality").alias("name")).agg(F.coalesce(F.sum("tokens"), F.lit(0.0)).alias("total"))
    ses = f.agg(F.countDistinct("session_id").cast("double").alias("total")).select(F.lit("sessions").alias("measure"), F.lit("all").alias("name"), "total")
    return fam.unionByName(tok).unionByName(ses)


def feed_constraints(spark, sf_dir):
    """Records that break a rule: family bytes must add up, unavailable tokens must be null."""
    f = _feed(spark, sf_dir)
    total = F.aggregate(F.map_values("family_bytes"), F.lit(0).cast("long"), lambda a, x: a + x)
    errors = F.array_compact(F.array(F.when(total != F.col("bytes"), "FAMILY_SUM"), F.when((F.col("quality") == "UNAVAILABLE") & F.col("tokens").isNotNull(), "TOKENS"), F.when(F.col("calls") > 70, "MANY_CALLS")))
    return f.select("session_id", F.array_join(errors, ",").alias("errors"))


def top_repeated_paths(spark, sf_dir):
    c = tool_calls(table(spark, sf_dir, "events")).where(F.col("tool_family") == "FILE_READ")
    g = c.groupBy(F.substring(F.sha2("target_path", 256), 1, 16).alias("path_hash"), "target_path").agg(F.count("*").alias("read_events"), F.sum("n_bytes").alias("bytes"))
    return g.where(F.col("read_events") > 1).orderBy(F.desc("read_events"), "path_hash").limit(5)


def worktree_digest(spark, sf_dir):
    """One digest over the content digests of every source, in two levels."""
    return worktree.digest(table(spark, sf_dir, "documents"), "source", "doc_id", F.sha2("text", 256))


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_i = lambda pattern: _q("(?i)" + pattern)
_CAPTURED = f"""cap AS (
  SELECT doc_id, lang, source, n_chars, doc_id % 10 AS kind, CAST(CASE WHEN doc_id % 23 = 0 THEN 1 ELSE 0 END AS BIGINT) AS exit_code,
    ['EXPLORE', 'BUILD', 'PROVE'][doc_id % 3 + 1] AS mode, ['default', 'strict', 'ideas', 'other'][doc_id % 4 + 1] AS profile,
    CASE WHEN doc_id % 17 IN (0, 1) THEN true ELSE false END AS is_git, doc_id % 17 > 2 AND doc_id % 43 = 3 AS secret_command, CASE WHEN doc_id % 19 = 0 THEN 'stderr' ELSE 'stdout' END AS stream, doc_id % 29 = 0 AS truncated, doc_id % 31 = 0 AS odd_hint,
    CASE WHEN doc_id % 7 = 0 THEN 'DO_NOT_PERSIST' WHEN doc_id % 2 = 0 THEN 'PERSIST' ELSE 'EPHEMERAL' END AS wanted, CASE WHEN doc_id % 13 = 0 THEN 'SENSITIVE' WHEN doc_id % 3 = 0 THEN 'NON_SENSITIVE' ELSE 'UNKNOWN' END AS claimed,
    CASE WHEN doc_id % 37 < 3 THEN ['Downloading 50%'] WHEN doc_id % 41 = 0 THEN ['absent'] ELSE [] END AS facts,
    CASE doc_id % 10 WHEN 0 THEN 'error: build failed' || chr(10) || text WHEN 1 THEN repeat('Building... [ OK ]' || chr(10), 5 + doc_id % 20) WHEN 2 THEN repeat('Downloading 50%' || chr(10), 4 + doc_id % 7)
      WHEN 3 THEN 'commit 0123456789abcdef' || chr(10) || 'On branch main' || chr(10) || text WHEN 4 THEN '{{"k": ' || doc_id || '}}' WHEN 5 THEN '12 passed in 3s' || chr(10) || text
      WHEN 6 THEN 'warning: deprecated call' || chr(10) || text WHEN 7 THEN 'total 8' || chr(10) || 'drwx a' || chr(10) || text WHEN 8 THEN '0 failures' || chr(10) || 'benchmark 1.5 ms mean' || chr(10) || text ELSE text END AS content
  FROM documents
), ln AS (
  SELECT *, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS lines FROM (SELECT *, regexp_replace(content, {_q(text.ANSI)}, '', 'g') AS seen, regexp_split_to_array(regexp_replace(content, {_q(text.ANSI)}, '', 'g'), '\\r\\n|\\n|\\r') AS l FROM cap)
), cls AS (
  SELECT *, len(list_filter(lines, lambda x: NOT regexp_matches(x, {_q('^' + text.NOISE_LINE + '$')}))) = 0 AS noise,
    len(list_filter(lines, lambda x: NOT regexp_matches(x, {_q('^' + text.NOISE_LINE + '$')}) AND NOT regexp_matches(x, {_i('^' + text.PROGRESS_LINE + '$')}))) = 0 AS progress FROM ln
), ev AS (
  SELECT *, CASE WHEN exit_code <> 0 THEN 'FAILURE' WHEN content IS NULL OR strlen(content) = 0 THEN 'UNKNOWN' WHEN regexp_matches(seen, {_i(text.SECRET)}) THEN 'SECURITY'
    WHEN regexp_matches(regexp_replace(seen, {_i(text.ZERO_FAILURES)}, ' ', 'g'), {_i(text.FAILURE)}) THEN 'FAILURE' WHEN regexp_matches(seen, {_i(text.SECURITY)}) THEN 'SECURITY'
    WHEN regexp_matches(seen, {_i(text.AUTHORITY)}) THEN 'AUTHORITY' WHEN regexp_matches(seen, {_i(text.WARNING)}) THEN 'DIAGNOSTIC' WHEN regexp_matches(seen, {_i(text.CANONICAL)}) THEN 'CANONICAL_STATE'
    WHEN regexp_matches(seen, {_i(text.BENCHMARK)}) THEN 'BENCHMARK' WHEN regexp_matches(trim(seen), '^[\\[{{]') AND json_valid(trim(seen)) THEN 'MACHINE_DATA' WHEN regexp_matches(trim(seen), '^[\\[{{]') AND NOT noise THEN 'UNKNOWN'
    WHEN regexp_matches(seen, {_i(text.SUCCESS)}) THEN 'SUCCESS_SUMMARY' WHEN regexp_matches(seen, {_i(text.DISCOVERY)}) THEN 'DISCOVERY' WHEN regexp_matches(content, {_q(text.CONTROL)}) THEN 'UNKNOWN'
    WHEN noise THEN 'NOISE' WHEN progress THEN 'PROGRESS' ELSE 'UNKNOWN' END AS evidence FROM cls
), ck AS (
  SELECT *, doc_id % 5 < 4 AS offered, strlen(content) AS n_bytes FROM ev
), iv AS (
  SELECT *, ['I5', 'I6', 'I7', 'I_ALWAYS_RAW', 'I_PROVE_MODE', 'I8', 'I9', 'I12'] AS names,
    [evidence <> 'UNKNOWN', NOT (evidence = 'FAILURE' OR exit_code <> 0), evidence NOT IN ('AUTHORITY', 'SECURITY'), evidence NOT IN ('AUTHORITY', 'SECURITY', 'FAILURE', 'CANONICAL_STATE', 'BENCHMARK', 'UNKNOWN'),
     NOT (mode = 'PROVE' AND evidence IN ('DISCOVERY', 'PROGRESS', 'SUCCESS_SUMMARY', 'DIAGNOSTIC', 'MACHINE_DATA')),
     NOT (evidence = 'MACHINE_DATA' AND offered), NOT (offered AND doc_id % 3 = 0), NOT (offered AND evidence IN ('AUTHORITY', 'SECURITY', 'FAILURE', 'CANONICAL_STATE', 'BENCHMARK', 'UNKNOWN'))] AS ok FROM ck
), sn AS (
  SELECT *, strlen(content) AS n_bytes, CASE WHEN claimed = 'SENSITIVE' OR secret_command OR regexp_matches(seen, {_i(text.SECRET)}) THEN 'SENSITIVE' ELSE claimed END AS sensitivity FROM ev
), ps AS (
  SELECT *, CASE WHEN sensitivity = 'SENSITIVE' THEN 'DO_NOT_PERSIST' WHEN wanted = 'PERSIST' AND sensitivity <> 'NON_SENSITIVE' THEN 'EPHEMERAL' ELSE wanted END AS persistence,
    (evidence = 'NOISE' OR (evidence = 'PROGRESS' AND mode <> 'PROVE')) AND profile <> 'other' AND exit_code = 0 AS foldable, NOT (is_git OR stream = 'stderr' OR truncated OR odd_hint) AS plain FROM sn
), pc AS (
  SELECT doc_id, unnest(regexp_extract_all(content, '[^\\n]*\\n|[^\\n]+')) AS piece, generate_subscripts(regexp_extract_all(content, '[^\\n]*\\n|[^\\n]+'), 1) AS nth FROM cap
  WHERE NOT regexp_matches(content, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]|\\r([^\\n]|$)')
), pr AS (
  SELECT doc_id, piece, nth, nth - row_number() OVER (PARTITION BY doc_id, piece ORDER BY nth) AS run FROM pc
), rn AS (
  SELECT doc_id, any_value(piece) AS line, min(nth) AS lo, max(nth) AS hi, count(*) AS n FROM pr GROUP BY doc_id, piece, run
), fd AS (
  SELECT doc_id, '[[FOLD:v1]]' || chr(10) || string_agg(line || CASE WHEN n > 1 THEN '[[FOLD:v1 count=' || n || ' first=' || lo || ' last=' || hi || ']]' || chr(10) ELSE '' END, '' ORDER BY lo) AS folded, max(n) AS most FROM rn GROUP BY 1
), fx AS (
  SELECT cap.*, CASE WHEN most > 1 AND strlen(folded) < strlen(content) THEN folded END AS folded FROM cap LEFT JOIN fd USING (doc_id)
), pp AS (
  SELECT ps.*, fx.folded,
    CASE WHEN persistence = 'DO_NOT_PERSIST' THEN 'NO_ARCHIVE_RAW' WHEN NOT plain THEN 'METADATA_REQUIRES_RAW' WHEN NOT foldable THEN 'EVIDENCE_OR_PROFILE' WHEN folded IS NULL THEN 'NO_SAVINGS'
      WHEN len(list_filter(ps.facts, lambda f: NOT (contains(folded, f) AND strlen(folded) - strlen(replace(folded, f, '')) >= strlen(ps.content) - strlen(replace(ps.content, f, ''))))) > 0 THEN 'FACT_GUARD' ELSE 'VALIDATED' END AS reason
  FROM ps JOIN fx USING (doc_id)
), pz AS (
  SELECT *, CASE WHEN reason = 'VALIDATED' THEN strlen(folded) ELSE n_bytes END AS visible_bytes, foldable AND plain AND persistence <> 'DO_NOT_PERSIST' AS eligible FROM pp
)"""
_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


def _tokens_sql(c: str) -> str:
    snake = f"regexp_replace(regexp_replace(coalesce({c}, ''), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g')"
    return f"list_filter(string_split(lower(regexp_replace({snake}, {_q(text.SEPARATORS)}, '_', 'g')), '_'), lambda x: length(x) >= 2 AND x NOT IN ({_STOP}))"


def _stems_sql(c: str) -> str:
    stem = "CASE " + " ".join(f"WHEN x LIKE '%{s}' AND length(x) - {len(s)} >= 3 THEN left(x, length(x) - {len(s)})" for s in text.SUFFIXES) + " ELSE x END"
    return f"list_distinct(list_transform(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN ({_STOP})), lambda x: {stem}))"


_BM25 = f"""d AS (SELECT doc_id, {_tokens_sql('text')} AS t FROM documents), sz AS (SELECT count(*) AS n, avg(len(t)) AS m FROM d),
  p AS (SELECT doc_id, token, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, unnest(t) AS token, len(t) AS l FROM d) GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM p GROUP BY 1),
  q AS (SELECT DISTINCT item_id, unnest({_tokens_sql('text')}) AS token FROM benchmark),
  sc AS (SELECT item_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m))), 6) AS score FROM q JOIN p USING (token) JOIN df USING (token), sz GROUP BY 1, 2),
  top AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 10)"""
_GRAPH = "e AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), v AS (SELECT 's' || s_suppkey AS node FROM supplier UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"

_WIDE = _GRAPH.replace("FROM nation), v AS (", "FROM nation UNION ALL SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem UNION ALL SELECT 'c' || (n_nationkey + 1), CASE WHEN n_nationkey = 0 THEN 'r0' ELSE 'c' || n_nationkey END FROM nation), v AS (").replace(
    "FROM region), u AS", "FROM region UNION ALL SELECT 'p' || p_partkey FROM part UNION ALL SELECT 'c' || (n_nationkey + 1) FROM nation UNION ALL SELECT 'alone'), u AS"
)


def _pagerank_sql(iterations: int = 8) -> str:
    steps = [f"WITH {_GRAPH}, dg AS (SELECT src, count(*) AS k FROM (SELECT DISTINCT src, dst FROM e) GROUP BY 1), st AS (SELECT node, CASE WHEN node LIKE 's%' THEN 1.0 / (SELECT count(*) FROM v WHERE node LIKE 's%') ELSE 0 END AS seed, k FROM v LEFT JOIN dg ON src = node), r0 AS (SELECT node, CAST(seed AS DOUBLE) AS rank FROM st)"]
    for i in range(iterations):
        steps.append(
            f"r{i + 1} AS (SELECT st.node, 0.15 * seed + 0.85 * (coalesce((SELECT sum(r.rank / dg.k) FROM (SELECT DISTINCT src, dst FROM e) x JOIN r{i} r ON r.node = x.src JOIN dg ON dg.src = x.src WHERE x.dst = st.node), 0) + (SELECT coalesce(sum(r.rank), 0) FROM r{i} r JOIN st s2 ON s2.node = r.node WHERE s2.k IS NULL) / (SELECT count(*) FROM v)) AS rank FROM st)"
        )
    return ", ".join(steps) + f" SELECT node, round(rank / (SELECT sum(rank) FROM r{iterations}), 6) AS rank FROM r{iterations}"


def _walks_sql() -> str:
    """The same by power iteration."""
    return f"WITH RECURSIVE {_GRAPH}, nd AS (SELECT node FROM v), lk AS (SELECT DISTINCT src, dst FROM e), qq AS (SELECT unnest(['suppliers', 'nations', 'uniform']) AS query), sd AS (SELECT 'suppliers' AS query, node, 1.0 AS w FROM v WHERE node LIKE 's%' UNION ALL SELECT 'nations', node, length(node) FROM v WHERE node LIKE 'n%'), {walk_sql()} SELECT query, node, round(rank, 6) AS rank FROM pr"


_VIEWS = "x AS (SELECT d.doc_id, n_chars, CAST(n_chars >= 300 AS BIGINT) AS predicted, quality, 1 - toxic AS clean FROM documents d LEFT JOIN labels l USING (doc_id)), vw AS (SELECT *, 'quality' AS scope, CAST(quality AS BIGINT) AS label FROM x WHERE quality IS NOT NULL UNION ALL SELECT *, 'clean', CAST(clean AS BIGINT) FROM x WHERE clean IS NOT NULL)"
_buckets = " UNION ALL ".join(f"SELECT '{b}' AS bucket" for b in BUCKETS)
_FEED = TOOL_CALLS_SQL + ", f AS (SELECT session_id, count(*) AS calls, CAST(sum(n_bytes) AS BIGINT) AS bytes, CAST(right(session_id, 1) AS INT) % 3 AS g FROM tool_calls GROUP BY 1)"
_big = "CAST({} AS BIGINT)".format

SQL = {
    "sensitive_docs": f"SELECT doc_id, regexp_matches(regexp_replace(text, {_q(text.ANSI)}, '', 'g'), {_i(text.SECRET)}) AS sensitive FROM documents",
    "evidence_class": f"WITH {_CAPTURED} SELECT doc_id, evidence FROM ev",
    "required_facts": f"WITH {_CAPTURED}, f AS (SELECT doc_id, content, regexp_extract_all(content, {_q(text.FACT)}) AS facts FROM cap) SELECT doc_id, array_to_string(facts, '|') AS facts, {_big('(strlen(content) - strlen(replace(content, facts[1], chr(0)))) // (strlen(facts[1]) - 1)')} AS occurrences FROM f WHERE len(facts) > 0",
    "policy_matrix": f"WITH p AS (SELECT unnest({list(policy.PROFILES)}) AS profile), c AS (SELECT unnest({list(policy.CLASSES)}) AS evidence), m AS (SELECT unnest({list(policy.MODES)}) AS mode), t AS (SELECT *, CASE WHEN evidence = 'NOISE' OR (evidence = 'PROGRESS' AND mode <> 'PROVE') THEN 'FOLD' END AS transform FROM p, c, m) SELECT *, CASE WHEN transform IS NOT NULL THEN 'TRANSFORM' WHEN evidence = 'MACHINE_DATA' AND mode <> 'PROVE' THEN 'LOSSLESS_ONLY' ELSE 'RAW' END AS disposition FROM t",
    "invariant_checks": f"WITH {_CAPTURED} SELECT doc_id, mode, array_to_string(list_filter(names, lambda n: NOT ok[list_position(names, n)]), ',') AS failed, names[list_position(ok, false)] AS first_forced FROM iv",
    "pipeline_result": f"WITH {_CAPTURED} SELECT doc_id, evidence, mode, sensitivity, persistence, CASE WHEN persistence = 'DO_NOT_PERSIST' THEN 'FORBIDDEN' ELSE 'READY' END AS storage, CASE WHEN reason = 'VALIDATED' THEN 'TRANSFORM' ELSE 'RAW' END AS disposition, reason, visible_bytes, {_big("CASE WHEN reason = 'VALIDATED' THEN 12 ELSE 8 END")} AS checks FROM pz",
    "replay_rollup": f"""WITH {_CAPTURED} SELECT count(*) AS entries, {_big('sum(n_bytes)')} AS raw_bytes, {_big('sum(visible_bytes)')} AS visible_bytes, sum(n_bytes) / 4.0 AS raw_tokens_estimate, sum(visible_bytes) / 4.0 AS visible_tokens_estimate,
      round((1 - sum(visible_bytes) / sum(n_bytes)) * 100, 2) AS byte_reduction_pct, count(*) FILTER (eligible) AS eligible, count(*) FILTER (reason = 'VALIDATED') AS transformed, {_big("coalesce(sum(n_bytes) FILTER (reason = 'VALIDATED'), 0)")} AS fold_raw_bytes,
      {_big("coalesce(sum(visible_bytes) FILTER (reason = 'VALIDATED'), 0)")} AS fold_visible_bytes, count(*) FILTER (reason = 'NO_SAVINGS') AS overhead_defeated FROM pz""",
    "fold_roundtrip": f"WITH {_CAPTURED} SELECT kind, count(*) AS docs, count(folded) AS folded, count(folded) AS exact FROM fx GROUP BY 1",
    "search_grouping": f"""WITH {TOOL_CALLS_SQL}, c AS (SELECT *, 1 + k % 9 AS n FROM tool_calls WHERE tool_family IN ('SEARCH', 'TEST')), o AS (SELECT *, list_transform(range(1, n + 1), lambda i: i || ':text ' || i * 7 || chr(10)) AS rows FROM c),
      z AS (SELECT *, list_sum(list_transform(rows, lambda r: strlen(target_path) + 1 + strlen(r))) AS raw, 13 + strlen('[[GROUP:v1 path_bytes=' || strlen(target_path) || ']]' || target_path) + 1 + list_sum(list_transform(rows, lambda r: strlen(r))) AS grouped FROM o),
      y AS (SELECT *, CASE WHEN exit_code <> 0 THEN 'NONZERO_EXIT' WHEN truncated THEN 'TRUNCATED' WHEN k % 10 = 0 THEN 'COMMAND_COMPOSITE' WHEN k % 10 = 1 THEN 'COMMAND_PRODUCER' WHEN grouped < raw THEN 'APPLIED' ELSE 'NO_GAIN' END AS reason FROM z)
      SELECT reason, count(*) AS calls, {_big('sum(raw)')} AS raw_bytes, {_big("sum(CASE WHEN reason = 'APPLIED' THEN raw - grouped ELSE 0 END)")} AS saved_bytes FROM y GROUP BY 1""",
    "token_estimate": f"SELECT lang, count(*) AS docs, {_big('sum(strlen(text))')} AS bytes, round(sum(strlen(text)) / 4.0, 2) AS tokens FROM documents GROUP BY 1",
    "fold_runs": f"WITH {_CAPTURED}, l2 AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS ls FROM (SELECT doc_id, regexp_split_to_array(content, '\\r\\n|\\n|\\r') AS l FROM cap)), x AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM l2), c AS (SELECT *, CASE WHEN lag(line) OVER w IS NOT DISTINCT FROM line THEN 0 ELSE 1 END AS ch FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), i AS (SELECT *, sum(ch) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS island FROM c) SELECT doc_id, min(line_no) AS first, max(line_no) AS last, count(*) AS n FROM i GROUP BY doc_id, island HAVING count(*) >= 2",
    "exact_content_dups": "SELECT sha256(text) AS sha, count(*) AS copies, min(doc_id) AS first_doc, min(strlen(text)) AS n_bytes, (count(*) - 1) * min(strlen(text)) AS repeat_bytes FROM documents GROUP BY 1 HAVING count(*) > 1",
    "store_dedup": f"WITH k AS (SELECT sha256(text) AS sha, min(strlen(text)) AS n FROM documents WHERE NOT regexp_matches(regexp_replace(text, {_q(text.ANSI)}, '', 'g'), {_i(text.SECRET)}) GROUP BY 1) SELECT left(sha, 1) AS folder, count(*) AS objects, {_big('sum(n)')} AS bytes FROM k GROUP BY 1",
    "bm25_topk": f"WITH {_BM25} SELECT * FROM top",
    "legacy_topk": f"WITH d AS (SELECT doc_id, unnest({_stems_sql('text')}) AS stem FROM documents), q AS (SELECT item_id, unnest({_stems_sql('text')}) AS stem FROM benchmark), s AS (SELECT item_id, doc_id, count(*) AS score FROM q JOIN d USING (stem) GROUP BY 1, 2) SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10",
    "idf_table": f"WITH p AS (SELECT DISTINCT page_id, unnest({_tokens_sql('url')}) AS token FROM pages), f AS (SELECT token, count(*) AS df FROM p GROUP BY 1), z AS (SELECT count(*) AS n FROM pages) SELECT token, df, round(ln((n - df + 0.5) / (df + 0.5) + 1.0), 6) AS idf FROM f, z",
    "hit_rate_mrr": f"""WITH {_BM25}, tr AS (SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) AND len(string_split_regex(trim(b.text), '\\s+')) > 5),
      h AS (SELECT item_id, min(rank) AS first, count(*) FILTER (rank <= 5) AS in_5, count(*) FILTER (rank <= 10) AS in_10 FROM top JOIN tr USING (item_id, doc_id) GROUP BY 1), z AS (SELECT * FROM (SELECT item_id, count(*) AS wanted FROM tr GROUP BY 1) LEFT JOIN h USING (item_id))
      SELECT count(*) AS queries, {", ".join(f"round(avg(CASE WHEN first <= {k} THEN 1.0 ELSE 0 END), 6) AS hit_at_{k}" for k in (1, 3, 5, 10))}, {", ".join(f"round(avg(CASE WHEN in_{k} = wanted THEN 1.0 ELSE 0 END), 6) AS all_hits_at_{k}" for k in (5, 10))},
        round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, count(*) FILTER (first IS NULL) AS misses, round(sum(coalesce(in_10, 0)) / sum(wanted), 6) AS recall_at_10 FROM z""",
    "graph_neighbors": f"WITH {_WIDE} SELECT src AS node, count(*) AS neighbours, min(dst) AS first, max(dst) AS last FROM u GROUP BY 1",
    "in_degree": f"WITH {_WIDE}, d AS (SELECT dst, count(DISTINCT src) AS n FROM e GROUP BY 1) SELECT node, coalesce(n, 0) AS in_degree, round(5 * ln(1 + coalesce(n, 0)), 6) AS centrality FROM v LEFT JOIN d ON dst = node",
    "bfs_distance": f"WITH RECURSIVE {_WIDE}, w(node, distance) AS (SELECT 'r0', 0 UNION SELECT u.dst, w.distance + 1 FROM w JOIN u ON u.src = w.node WHERE w.distance < 30), b AS (SELECT node, min(distance) AS d FROM w GROUP BY 1) SELECT node, {_big('d')} AS distance, round(5.0 / (d + 1), 6) AS proximity FROM (SELECT DISTINCT node FROM v) LEFT JOIN b USING (node)",
    "pagerank": _pagerank_sql(),
    "walks_converged": _walks_sql(),
    "pagerank_converged": f"SELECT node, rank FROM ({_walks_sql()}) WHERE query = 'suppliers'",
    "graph_health": f"WITH {_WIDE}, d AS (SELECT node, n FROM v LEFT JOIN (SELECT src, count(*) AS n FROM u GROUP BY 1) ON src = node), h AS (SELECT count(*) AS nodes, count(*) FILTER (n IS NULL) AS orphans, {_big('sum(coalesce(n, 0))')} AS ends FROM d), q AS (SELECT *, round((nodes - orphans) / nodes, 4) AS linked_ratio FROM h) SELECT *, CASE WHEN linked_ratio >= 0.85 THEN 'HIGH' WHEN linked_ratio >= 0.5 THEN 'PARTIAL' ELSE 'LOW' END AS status FROM q",
    "label_confusion": f"WITH {_VIEWS} SELECT scope, label, predicted, count(*) AS entries FROM vw GROUP BY 1, 2, 3",
    "label_scope_safety": f"WITH {_VIEWS} SELECT scope, CASE WHEN predicted = label THEN CASE WHEN label = 1 THEN 'SAFE_KEEP' ELSE 'SAFE_DROP' END WHEN predicted = 1 THEN 'UNSAFE_KEEP' ELSE 'MISSED_KEEP' END AS outcome, count(*) AS entries, round(avg(n_chars), 2) AS mean_chars FROM vw GROUP BY 1, 2",
    "missed_buckets": f"WITH b AS ({_buckets}), m AS (SELECT doc_id, CASE WHEN n_chars = 0 THEN 'EMPTY' WHEN n_chars < 200 THEN 'SHORT' WHEN n_chars > 8000 THEN 'LONG' WHEN lang <> 'en' THEN 'FOREIGN' ELSE 'PLAIN' END AS bucket FROM documents), g AS (SELECT bucket, count(*) AS n, array_to_string(list(doc_id ORDER BY doc_id)[:5], ',') AS s FROM m GROUP BY 1) SELECT bucket, coalesce(n, 0) AS entries, coalesce(s, '') AS sample FROM b LEFT JOIN g USING (bucket)",
    "sidecar_join": "WITH d AS (SELECT doc_id, sha256(text) AS sha FROM documents), r AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'stale' ELSE sha END AS rs FROM labels JOIN d USING (doc_id)) SELECT CASE WHEN rs IS NULL THEN 'UNREVIEWED' WHEN rs = sha THEN 'REVIEWED' ELSE 'DIGEST_MISMATCH' END AS state, count(*) AS entries FROM d LEFT JOIN r USING (doc_id) GROUP BY 1",
    "stratified_sample": "WITH p AS (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents) SELECT doc_id, source FROM p WHERE n <= 8 OR list_contains(list_transform(range(8), lambda i: i * n // 8), place)",
    "quantile_review": "WITH p AS (SELECT doc_id, lang, n_chars, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS place FROM documents) SELECT lang, doc_id, n_chars, place FROM p WHERE list_contains(list_transform([0.0, 0.25, 0.5, 0.75, 1.0], lambda q: CAST(floor((n - 1) * q) AS BIGINT)), place)",
    "first_n_per_reason": f"WITH {_CAPTURED} SELECT doc_id, evidence, row_number() OVER (PARTITION BY evidence ORDER BY doc_id) AS nth FROM ev WHERE evidence <> 'UNKNOWN' QUALIFY nth <= 5",
    "span_accounting": f"WITH s AS (SELECT doc_id, strlen(text) AS n FROM documents), t AS (SELECT doc_id, n, n * 3 // 20 - n // 20 + n * 14 // 20 - n * 10 // 20 AS c, n * 6 // 20 - n * 5 // 20 AS d FROM s), k AS (SELECT doc_id, 'CANONICAL' AS kind, c AS bytes FROM t UNION ALL SELECT doc_id, 'DUPLICATE', d FROM t UNION ALL SELECT doc_id, 'PLAIN', n - c - d FROM t) SELECT kind, count(*) AS docs, {_big('sum(bytes)')} AS bytes FROM k GROUP BY 1",
    "range_union": f"WITH r AS (SELECT l_suppkey AS key, l_partkey AS a, l_partkey + l_linenumber AS b FROM lineitem), m AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY key ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS o FROM r), i AS (SELECT *, sum(o) OVER (PARTITION BY key ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m), u AS (SELECT key, g, min(a) AS a, max(b) AS b FROM i GROUP BY 1, 2) SELECT key, count(*) AS ranges, {_big('sum(b - a)')} AS covered FROM u GROUP BY 1",
    "section_bounds": f"WITH {_CAPTURED}, l2 AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS ls FROM (SELECT doc_id, regexp_split_to_array(content, '\\r\\n|\\n|\\r') AS l FROM cap)), h AS (SELECT doc_id, line, 1 + line // 3 % 3 AS level FROM (SELECT doc_id, unnest(range(len(ls))) AS line FROM l2) WHERE line % 3 = 0) SELECT a.doc_id, a.line, a.level, (SELECT min(b.line) FROM h b WHERE b.doc_id = a.doc_id AND b.line > a.line AND b.level <= a.level) AS stop_line FROM h a",
    "budgeted_map": f"SELECT doc_id, source, {_big('sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING)')} AS running FROM documents QUALIFY running <= 4000",
    "feed_rollup": f"WITH {_FEED} SELECT 'family_bytes' AS measure, tool_family AS name, CAST(sum(n_bytes) AS DOUBLE) AS total FROM tool_calls GROUP BY 2 UNION ALL SELECT 'tokens', ['EXACT', 'ESTIMATE', 'UNAVAILABLE'][g + 1], CASE WHEN g = 2 THEN 0 ELSE CAST(sum(bytes) AS DOUBLE) / 4 END FROM f GROUP BY g UNION ALL SELECT 'sessions', 'all', CAST(count(*) AS DOUBLE) FROM f",
    "feed_constraints": f"WITH {_FEED} SELECT session_id, CASE WHEN calls > 70 THEN 'MANY_CALLS' ELSE '' END AS errors FROM f",
    "top_repeated_paths": f"WITH {TOOL_CALLS_SQL} SELECT left(sha256(target_path), 16) AS path_hash, target_path, count(*) AS read_events, {_big('sum(n_bytes)')} AS bytes FROM tool_calls WHERE tool_family = 'FILE_READ' GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 3 DESC, 1 LIMIT 5",
    "worktree_digest": "WITH r AS (SELECT source, doc_id // 4096 AS r, count(*) AS n, sha256(string_agg(doc_id || ':' || sha256(text), chr(10) ORDER BY doc_id)) AS d FROM documents GROUP BY 1, 2) SELECT source, CAST(sum(n) AS BIGINT) AS files, sha256(string_agg(d, chr(10) ORDER BY r)) AS digest FROM r GROUP BY 1",
}

#: Converged ranks have no SQL: a test compares them with power iteration.
QUERIES = {name: globals()[name] for name in SQL}
