"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import audio, bpe, clustering, lm, minhash, packing, quality, rules, runs, topk, toxicity, warc
from tracewell.llm.common import split_remainder, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh
  FROM w
), e AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 85 * (min(x.n) + min(y.n) - count(*))
), l AS (
  SELECT a, b FROM p UNION SELECT b, a FROM p
), r(id, seen) AS (
  SELECT a, a FROM l UNION SELECT l.b, r.seen FROM r JOIN l ON l.a = r.id
), c AS (
  SELECT id, min(seen) AS component FROM r GROUP BY id
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(c.component, s.doc_id) AS component_id,
  coalesce(c.component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON c.id = s.doc_id
"""


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = split_remainder(F.col("id"), 5) == 0
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out, threshold=0.3)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"), split_remainder(F.col("id"), 5) == 1)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = split_remainder(F.col("id"), 4) == 2
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out, threshold=0.3)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=512)


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where(F.col("id") % 100 == 0), vectors, k=10)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op7_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), capacity=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.restore(*warc.archive(table(spark, sf_dir, "pages"), min_bytes=1000))
    header = F.col("header")
    return records.select(
        F.col("id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        warc.field(header, "WARC-Type").alias("record_type"),
        F.nullif(F.regexp_extract(warc.field(header, "WARC-Refers-To"), r"(-?\d+)", 1), F.lit("")).cast("long").alias("refers_to"),
    )


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), g AS (
  SELECT page_id, strlen(html) AS n, sha1(html) AS digest, max(page_id) OVER (PARTITION BY html) AS holder FROM p
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> holder THEN holder END AS refers_to
FROM g
"""


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip_digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op10_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.media_digests(audio.store_media(table(spark, sf_dir, "documents")))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")).cast("binary"), 256)
    assigned, centroids = clustering.cluster(table(spark, sf_dir, "embeddings"), 40, 5, digest, width=64, scale=256)
    return clustering.with_inertia(assigned, centroids).withColumnRenamed("id", "vec_id")


def _op11_sql(k: int = 40, rounds: int = 5) -> str:
    """One step of assignment and one of means for each round."""
    nearest = """d{r} AS MATERIALIZED (
  SELECT v.row, v.vec_id, v.e, c.c, list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance
  FROM v CROSS JOIN c{r} c
), a{r} AS MATERIALIZED (
  SELECT row, vec_id, e, c, distance FROM d{r} QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, c) = 1
)"""
    means = """u{r} AS (
  SELECT c, unnest(range(1, 65)) AS i, unnest(e) AS x FROM a{p}
), m{r} AS (
  SELECT c, i, sum(x) AS s, count(*) AS n FROM u{r} GROUP BY c, i
), n{r} AS (
  SELECT c, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY i) AS e FROM m{r} GROUP BY c
), c{r} AS MATERIALIZED (
  SELECT c{p}.c, coalesce(n{r}.e, c{p}.e) AS e FROM c{p} LEFT JOIN n{r} ON n{r}.c = c{p}.c
)"""
    steps = [nearest.format(r=0)]
    for r in range(1, rounds + 1):
        steps += [means.format(r=r, p=r - 1), nearest.format(r=r)]
    body = ", ".join(steps)
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, e) - 1 AS c, e FROM v
  QUALIFY c < {k}
), {body}, i AS (
  SELECT c, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY c
)
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance, i.cluster_inertia,
  CAST((SELECT sum(distance) FROM a{rounds}) AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN i ON i.c = a.c JOIN c{rounds} c ON c.c = a.c
"""


OP11_SQL = _op11_sql()


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op12_sql() -> str:
    n, share = len(rules.SIGNALS), "coalesce(least(1000, 1000 * {} // nullif({}, 0)), 0)".format
    signals = ", ".join([share("n_symbols", "word_chars"), share("n_shouts", "word_chars"), share("n_capitals", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), "least(1000, coalesce(10 * word_chars // nullif(n_words, 0), 0))"])
    quantile = "min(x) FILTER (WHERE place >= {q} * size)".format
    settings = ", ".join(f"list(CAST(floor({f} * q{k}) AS BIGINT) ORDER BY s)" for k, (_, f) in enumerate(rules.PATH))
    quantiles = ", ".join(f"{quantile(q=q)} AS q{k}" for k, (q, _) in enumerate(rules.PATH))
    above = "len(list_filter(list_zip({s}, {c}), lambda z: z[1] > z[2])) > 0".format
    tail = f"list_sum(list_transform(range(0, rejected + 1), lambda j: exp(lgamma(tested + 1) - lgamma(j + 1) - lgamma(tested - j + 1) + j * ln({rules.RISK}) + (tested - j) * ln(1 - {rules.RISK}))))"
    languages = ", ".join(f"'{x}'" for x in rules.LANGUAGES)
    return rf"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-]')) AS ls
  FROM documents
), r AS (
  SELECT row_number() OVER () AS row, doc_id, CASE WHEN lang IN ({languages}) THEN lang ELSE 'other' END AS stratum, md5(text) AS digest, ws, len(ws) AS n_words,
    length(regexp_replace(text, '[ 	-]+', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    length(regexp_replace(text, '[^!]+', '', 'g')) AS n_shouts, length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_capitals,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines
  FROM w
), e AS (
  SELECT row, unnest(range(1, n_words - 3)) AS k, unnest(list_transform(range(1, n_words - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS g FROM r WHERE n_words > 4
), f AS (
  SELECT row, k FROM e QUALIFY count(*) OVER (PARTITION BY row, g) > 1
), c AS (
  SELECT row, count(DISTINCT p) AS n_repeat_words FROM (SELECT row, unnest(range(k, k + 5)) AS p FROM f) GROUP BY row
), t AS (
  SELECT r.*, coalesce(c.n_repeat_words, 0) AS n_repeat_words, n_words < 10 OR 100 * coalesce(c.n_repeat_words, 0) > 20 * n_words AS base_failed FROM r LEFT JOIN c ON c.row = r.row
), s AS (
  SELECT *, [{signals}] AS signals FROM t
), l AS (
  SELECT doc_id, avg(quality) AS label FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), good AS (
  SELECT digest, stratum, min(signals) AS signals FROM s JOIN l ON l.doc_id = s.doc_id WHERE NOT base_failed GROUP BY digest, stratum HAVING avg(label) >= 0.5
), x AS (
  SELECT stratum, unnest(range(1, {n + 1})) AS s, unnest(signals) AS x FROM good WHERE substr(digest, 1, 1) IN ('0', '1', '2')
), y AS (
  SELECT *, cume_dist() OVER (PARTITION BY stratum, s ORDER BY x) AS place, 1.0 AS size FROM x
), q AS (
  SELECT stratum, s, {quantiles} FROM y GROUP BY stratum, s
), p AS (
  SELECT stratum, [{settings}] AS cutoffs FROM q GROUP BY stratum
), z AS (
  SELECT p.stratum, unnest(range(1, {len(rules.PATH) + 1})) AS setting, unnest(cutoffs) AS cutoff FROM p
), b AS (
  SELECT z.stratum, z.setting, any_value(z.cutoff) AS cutoff, count(*) AS tested, count(*) FILTER (WHERE {above(s="good.signals", c="z.cutoff")}) AS rejected
  FROM good JOIN z ON z.stratum = good.stratum WHERE substr(digest, 1, 1) NOT IN ('0', '1', '2') GROUP BY z.stratum, z.setting
), v AS (
  SELECT *, rejected < {rules.RISK} * tested AND {tail} <= {rules.ERROR / (len(rules.LANGUAGES) + 1)} AS passed FROM b
), o AS (
  SELECT *, bool_and(passed) OVER (PARTITION BY stratum ORDER BY setting) AS reached FROM v
), k AS (
  SELECT stratum, max_by(cutoff, setting) AS cutoff FROM o WHERE reached GROUP BY stratum
)
SELECT s.doc_id, s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, s.base_failed,
  NOT s.base_failed AND NOT coalesce({above(s="s.signals", c="k.cutoff")}, false) AS kept
FROM s LEFT JOIN k ON k.stratum = s.stratum
"""


OP12_SQL = _op12_sql()


def rearranged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One text in ten, by its id's crc32, repeats a stretch of its words to the end; a null id changes nothing."""
    h = F.crc32(docs[id_col].cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        whole = lambda i: F.get(ws, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))  # noqa: E731
        return F.when(n == 0, docs[text_col]).otherwise(F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), whole), " "))

    text = F.when(h % 10 == 0, F.element_at(F.transform(F.array(rules.words(docs[text_col])), repeat), 1)).otherwise(docs[text_col])
    return docs.withColumn(text_col, text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(rearranged(table(spark, sf_dir, "documents")), exponent=4, least=6)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.select("id", "collapsed", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"), F.array_join(lines, "").alias("listed"))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_runs",
        F.col("longest.start").alias("start"),
        (-F.col("longest.less")).alias("length"),
        F.col("longest.period").alias("period"),
        F.floor(-1000 * F.col("longest.less") / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_dedup, op2_quality_classifier, op3_lm_scoring, op4_toxicity, op5_token_counts, op6_exact_topk, op7_cost_packing, op8_warc_archive, op9_bpe_codec, op10_audio_features, op11_centroid_clustering, op12_quality_rules, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": OP1_SQL, "op6_exact_topk": OP6_SQL, "op8_warc_archive": OP8_SQL, "op11_centroid_clustering": OP11_SQL, "op12_quality_rules": OP12_SQL}
