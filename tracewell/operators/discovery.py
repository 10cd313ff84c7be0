"""Lexical and structural ranking: BM25, stem overlap, graph signals, retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell.sources.scratch import Steps, cut

K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, token, tf, length) of every document; texts are tokenised once."""
    held = docs.select(key, tokens.alias("tokens")).select(key, F.size("tokens").cast("long").alias("length"), "tokens").select(key, "length", F.explode("tokens").alias("token"))
    return held.groupBy(key, "token", "length").agg(F.count("*").alias("tf"))


def idf_table(post: DataFrame, n_docs: Column) -> DataFrame:
    df = post.groupBy("token").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0))


def bm25(docs: DataFrame, key: str, tokens: Column, queries: DataFrame, query_key: str, query_tokens: Column, k: int = 10) -> DataFrame:
    """The k best documents of every query; equal scores go by key.

    Texts are tokenised once: only postings of query tokens are kept, beside one row of each document that holds its length.
    idf is computed for query tokens alone.
    """
    asked = queries.select(query_key, F.explode(F.array_distinct(query_tokens)).alias("token"))
    # a null token stands for the document itself; lengths are taken before the texts are spread, or each token's row would carry all tokens
    own = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.array_compact("tokens"), F.array().cast("array<string>")))
    held = docs.select(key, tokens.alias("tokens")).select(key, F.size("tokens").cast("long").alias("length"), own.alias("own"))
    every = held.select(key, "length", F.explode("own").alias("token"))
    wanted = asked.select("token").distinct().select(F.col("token").alias("_wanted"))
    each = every.join(wanted.union(docs.sparkSession.range(1).select(F.lit(None).cast("string"))), F.col("token").eqNullSafe(F.col("_wanted")), "left_semi")
    kept = Steps(docs.sparkSession, "postings").append(each.groupBy(key, "token", "length").agg(F.count("*").alias("tf")))
    size = kept.where("token is null").agg(F.sum("tf").alias("n_docs"), (F.sum(F.col("length") * F.col("tf")) / F.sum(F.when(F.col("length").isNotNull(), F.col("tf")))).alias("mean_length"))
    df = kept.where("token is not null").groupBy("token").agg(F.count("*").alias("df"))
    # written, so that its true size decides how it is joined; where it is small, a document's pairs are summed where its postings lie
    terms = Steps(docs.sparkSession, "terms").append(asked.join(df, "token").crossJoin(F.broadcast(size)))  # size is one row
    part = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    scored = _dealt(kept.where("token is not null"), terms, key, "token").join(terms, "token").groupBy(query_key, key).agg(F.round(F.sum(part), 6).alias("score")).where(F.col("score") > 0)
    rank = F.row_number().over(W.partitionBy(query_key).orderBy(F.desc("score"), key)).cast("long")
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


#: Pairs of a query and a document that one task sums.
PAIRS = 250_000


def _dealt(postings: DataFrame, asked: DataFrame, key: str, token: str) -> DataFrame:
    """``postings`` dealt out by document, so that no task makes more than about PAIRS pairs with ``asked``, whatever the input's size."""
    often = asked.groupBy(token).agg(F.count("*").alias("_queries"))
    pairs = postings.groupBy(token).agg(F.count("*").alias("_docs")).join(often, token).agg(F.sum(F.col("_docs") * F.col("_queries"))).first()[0] or 0
    least = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return postings.repartition(max(least, -(-pairs // PAIRS)), key)


def stem_overlap(docs: DataFrame, key: str, doc_stems: Column, queries: DataFrame, query_key: str, query_stems: Column, k: int = 10) -> DataFrame:
    """The older ranker: shared distinct stems, by an equi-join on the stem.

    Only postings of stems that queries have are written; a document's pairs are summed where its postings lie.
    """
    q = Steps(docs.sparkSession, "asked").append(queries.select(query_key, F.explode(query_stems).alias("stem")))
    d = docs.select(key, F.explode(doc_stems).alias("stem"))
    kept = Steps(docs.sparkSession, "stems").append(d.join(q.select("stem").distinct(), "stem", "left_semi"))
    scored = _dealt(kept, q, key, "stem").join(q, "stem").groupBy(query_key, key).agg(F.count("*").alias("score"))
    rank = F.row_number().over(W.partitionBy(query_key).orderBy(F.desc("score"), key)).cast("long")
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def retrieval_metrics(ranked: DataFrame, truth: DataFrame, query_key: str, key: str) -> DataFrame:
    """Over the queries of ``truth``: shares with any hit and with all hits among the first, mean reciprocal rank, misses, and the share of all wanted keys that is found."""
    n = lambda most: F.count_if(F.col("rank") <= most).alias(f"in_{most}")
    hit = ranked.join(truth, [query_key, key]).groupBy(query_key).agg(F.min("rank").alias("first"), n(5), n(10))
    every = truth.groupBy(query_key).agg(F.count("*").alias("wanted")).join(hit, query_key, "left")
    rate = lambda c, name: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6).alias(name)
    return every.agg(
        F.count("*").alias("queries"),
        *[rate(F.col("first") <= k, f"hit_at_{k}") for k in (1, 3, 5, 10)],
        *[rate(F.col(f"in_{k}") == F.col("wanted"), f"all_hits_at_{k}") for k in (5, 10)],
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
        F.count_if(F.col("first").isNull()).alias("misses"),
        F.round(F.sum(F.coalesce("in_10", F.lit(0))) / F.sum("wanted"), 6).alias("recall_at_10"),
    )


def neighbours(edges: DataFrame) -> DataFrame:
    """Undirected neighbours of the edges (src, dst), each pair once on both sides."""
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("degree"))
    degree = F.coalesce("degree", F.lit(0))
    return nodes.join(d, "node", "left").select("node", degree.alias("in_degree"), F.round(5 * F.log1p(degree), 6).alias("centrality"))


def laid_out(edges: DataFrame) -> DataFrame:
    """``neighbours`` of the edges in the shared folder, in order of src, so that a range of nodes is read without the rest.

    Both ends of the order deal rows out, so a node with any number of neighbours lies in as many files as it fills.
    """
    e = edges.select("src", "dst").where("src is not null and dst is not null")
    both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    # equal rows meet in one range, so one shuffle does for both
    return Steps(edges.sparkSession, "neighbours").append(both.repartitionByRange("src", "dst").distinct().sortWithinPartitions("src", "dst"))


def frontiers(around: DataFrame, start: DataFrame, keys: list[str]) -> DataFrame:
    """``start`` and all that is reached from it over ``around`` (src, dst), with the ``distance``; ``keys`` end in node.

    The frontier grows until nothing new is found, so a path may have any length. Links go both ways, so a
    neighbour of a frontier lies in it, in the one before or in the next: only those two are looked at, and all frontiers
    are read together once. Where ``around`` is ``laid_out``, a step reads the part of it between the frontier's least and greatest node.
    """
    steps = Steps(start.sparkSession, "frontiers")
    before, frontier = None, steps.append(start.select(*keys).distinct())
    while True:
        low, high, size = frontier.agg(F.min("node"), F.max("node"), F.count("*")).first()
        if not size:
            return steps.all().withColumnRenamed("step", "distance")
        part = around.where(F.col("src").between(low, high))
        near = frontier.join(part, F.col("node") == F.col("src")).select(*keys[:-1], F.col("dst").alias("node")).distinct()
        met = frontier if before is None else frontier.union(before)
        before, frontier = frontier, steps.append(near.join(met, keys, "left_anti"))


def distances(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Unweighted distance of every node to its nearest seed, null if none is reached."""
    seen = frontiers(laid_out(edges), seeds, ["node"])
    return nodes.select("node").distinct().join(seen, "node", "left").withColumn("proximity", F.round(5.0 / (F.col("distance") + 1), 6))


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """Personalised PageRank; what dangling nodes hold is spread evenly over all nodes.

    Seeds that are no nodes, and weights not above zero, are left out; without any the start is uniform.
    """
    n = nodes.count()
    valid = seeds.where(F.col("weight") > 0).join(nodes, "node", "left_semi").groupBy("node").agg(F.sum("weight").alias("weight"))
    total = valid.agg(F.sum("weight")).first()[0]
    out = edges.select("src", "dst").distinct()
    degree = out.groupBy("src").agg(F.count("*").alias("degree"))
    links = cut(out.join(degree, "src"))
    seed = F.coalesce("weight", F.lit(0.0)) / total if total else F.lit(1.0 / max(n, 1))
    start = cut(nodes.join(valid, "node", "left").select("node", seed.alias("seed")).join(degree.withColumnRenamed("src", "node"), "node", "left"))
    rank = start.withColumn("rank", F.col("seed"))
    for _ in range(iterations):
        dangling = rank.agg(F.coalesce(F.sum(F.when(F.col("degree").isNull(), F.col("rank"))), F.lit(0.0))).first()[0]
        given = links.join(rank.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("degree")).alias("given"))
        new = rank.withColumnRenamed("rank", "old").join(given, "node", "left")
        value = (1 - damping) * F.col("seed") + damping * (F.coalesce("given", F.lit(0.0)) + dangling / n)
        new = cut(new.select("node", "seed", "degree", "old", value.alias("rank")))
        moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] if tolerance is not None else None
        rank = new.drop("old")
        if moved is not None and moved < tolerance:
            break
    mass = rank.agg(F.sum("rank")).first()[0] or 1.0
    return rank.select("node", F.round(F.col("rank") / mass, 6).alias("rank"))
