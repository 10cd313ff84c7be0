"""Ranking files for a task by words, symbols and graph: what the text names, and what lies near it.

All lookups are equi-joins: names are spread into their parts once, and words meet parts that equal them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell.operators.discovery import frontiers, laid_out
from tracewell.operators.grams import holding
from tracewell.operators.walks import personal_walks
from tracewell.sources.scratch import cut

# Words of a task that say nothing about files, and phrases that ask for relations.
STOPWORDS = (
    "a", "about", "add", "after", "an", "and", "are", "at", "be", "been", "being", "but", "by", "change", "chore", "did", "do", "docs", "does", "else", "feat", "fix", "for", "from", "had", "has", "have", "if", "implement", "in", "into", "is", "it", "its",
    "make", "not", "of", "on", "or", "over", "refactor", "so", "test", "tests", "that", "the", "then", "these", "this", "those", "to", "up", "update", "was", "were", "when", "while", "with",
)
RELATED = r"(?:^|[^a-z0-9_])(?:callers of|dependents of|depends on|imports|related to)(?:$|[^a-z0-9_])"
WORD = r"[A-Za-z0-9_\-./\\]+"


def last_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst), the one added last; separators are normalised first."""
    tidy = lambda c: F.replace(F.col(c), F.lit("\\"), F.lit("/")).alias(c)
    return edges.select(tidy("src"), tidy("dst"), "kind", "seq").groupBy("src", "dst").agg(F.max_by("kind", "seq").alias("kind"))


def directed_neighbours(edges: DataFrame) -> DataFrame:
    """Sorted successors and predecessors of every node that has any."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_set("dst")).alias("out"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.sort_array(F.collect_set("src")).alias("into"))
    empty = F.array().cast("array<string>")
    return out.join(into, "node", "full_outer").select("node", F.coalesce("out", empty).alias("out"), F.coalesce("into", empty).alias("into"))


def symbol_lookup(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """Symbols by name in any case, and whether the name is exact; rows come in no order."""
    s = symbols.withColumn("low", F.lower("name"))
    n = names.select("wanted", F.lower("wanted").alias("low"))
    return n.join(s, "low").select("wanted", "path", "name", "line", (F.col("name") == F.col("wanted")).alias("exact"))


def symbols_in_files(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols of the files asked for, whatever the separators of their paths."""
    tidy = lambda c: F.replace(F.col(c), F.lit("\\"), F.lit("/"))
    return files.select("path", tidy("path").alias("_at")).distinct().join(symbols.select(tidy("path").alias("_at"), "name", "line"), "_at").drop("_at")


def extract_queries(queries: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per query: ``paths``, ``names`` and ``terms`` it holds, in the order they come, and its ``intent``.

    A word that is a path is nothing else; other words may name a file by its end or its stem, or a symbol.
    """
    words = queries.select("query", F.trim("text").alias("text")).select("query", "text", F.posexplode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("pos", "word"))
    norm = F.regexp_replace(F.replace(F.col("word"), F.lit("\\"), F.lit("/")), r"^[./]+|[./]+$", "")
    words = words.withColumn("norm", norm).withColumn("low", F.lower("word"))
    paths = files.select("path").distinct()
    asked = words.where(F.col("norm").endswith(".py")).select("norm")
    ends = holding(asked, "norm", paths, "path").where(F.col("path").endswith(F.col("norm"))).groupBy("norm").agg(F.min("path").alias("by_end"))
    stems = paths.select(F.lower(F.replace(F.element_at(F.split("path", "/"), -1), F.lit(".py"), F.lit(""))).alias("low"), "path").groupBy("low").agg(F.max("path").alias("by_stem"))
    name = F.element_at(F.split("name", r"\."), -1)
    exact = symbols.select(name.alias("word")).distinct().withColumn("by_name", F.col("word"))
    lower = symbols.select(name.alias("n")).groupBy(F.lower("n").alias("low")).agg(F.max("n").alias("by_lower"))
    w = words.join(paths.select(F.col("path").alias("norm"), F.lit(True).alias("is_path")), "norm", "left").join(ends, "norm", "left").join(stems, "low", "left").join(exact, "word", "left").join(lower, "low", "left")
    whole = F.coalesce("is_path", F.lit(False))
    long_ = F.length("low") > 3
    term = F.regexp_replace("low", "[^a-z0-9_]", "")
    found = lambda cond, c: F.when(cond, c)
    w = w.select(
        "query", "text", "pos",
        F.array_compact(F.array(found(whole, F.col("norm")), found(~whole & F.col("norm").endswith(".py"), F.col("by_end")), found(~whole & long_, F.col("by_stem")))).alias("p"),
        found(~whole, F.coalesce("by_name", found(long_, F.col("by_lower")))).alias("s"), found(~whole & (F.length(term) >= 3) & ~term.isin(*STOPWORDS), term).alias("t"),
    )
    listed = w.groupBy("query").agg(F.first("text").alias("text"), F.array_sort(F.collect_list(F.struct("pos", "p", "s", "t"))).alias("all"))
    each = lambda f: F.array_distinct(F.array_compact(F.transform("all", lambda x: x[f])))
    out = queries.select("query", F.col("text").alias("raw")).join(listed, "query", "left").select("query", F.lower(F.trim("raw")).alias("raw"), F.coalesce("all", F.array().cast(listed.schema["all"].dataType)).alias("all"))
    out = out.select("query", "raw", F.array_distinct(F.flatten(F.transform("all", lambda x: x["p"]))).alias("paths"), each("s").alias("names"), each("t").alias("terms"))
    has_p, has_s = F.size("paths") > 0, F.size("names") > 0
    intent = F.when(F.col("raw").rlike(RELATED), "RELATED_TO_FILE").when(has_p & ~has_s, "PATH_LOOKUP").when(has_s & ~has_p, "SYMBOL_LOOKUP").when((F.size("terms") > 0) | has_p | has_s, "FEATURE_TEXT").otherwise("UNKNOWN")
    return out.select("query", "paths", "names", "terms", intent.alias("intent"))


def lexical_signals(extracted: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(query, path) with the four word signals; pairs without any are left out."""
    q = cut(extracted)
    exact = q.select("query", F.explode("paths").alias("path")).withColumn("exact_path", F.lit(100.0))
    terms = q.select("query", F.explode("terms").alias("term"))
    low = files.select("path").distinct().withColumn("low", F.lower("path"))
    in_path = holding(terms, "term", low, "low").join(low, "low").join(terms, "term").groupBy("query", "path").agg((F.count("*") * 15.0).alias("path_terms"))
    s = symbols.select("path", "line", F.element_at(F.split("name", r"\."), -1).alias("name"))
    named = s.join(q.select("query", F.explode("names").alias("name")), "name").groupBy("query", "path").agg((F.count("*") * 40.0).alias("exact_symbol"))
    long_terms = terms.where(F.length("term") >= 4)
    lower = s.select("path", F.lower("name").alias("low"))
    in_name = holding(long_terms, "term", lower, "low").join(lower, "low").join(long_terms, "term").groupBy("query", "path").agg((F.count("*") * 10.0).alias("symbol_terms"))
    out = exact
    for other in (in_path, named, in_name):
        out = out.join(other, ["query", "path"], "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return out.join(files.select("path").distinct(), "path", "left_semi").select("query", "path", *map(zero, ("exact_path", "path_terms", "exact_symbol", "symbol_terms")))


def _lexical() -> Column:
    return F.col("exact_path") + F.col("path_terms") + F.col("exact_symbol") + F.col("symbol_terms")


def seed_weights(signals: DataFrame) -> DataFrame:
    """What each query's walk starts from: its lexical score, and 100 more for a path it names."""
    return signals.select("query", F.col("path").alias("node"), (_lexical() + F.col("exact_path")).alias("weight")).where(F.col("weight") > 0)


def nearest_seed(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query, node, distance) of every node that a seed of the query reaches."""
    return frontiers(laid_out(edges), seeds, ["query", "node"])


def structural_rank(queries: DataFrame, files: DataFrame, symbols: DataFrame, edges: DataFrame, mode: str, k: int = 10) -> DataFrame:
    """The k best files of every query among all files, zero scores included, equal scores by path.

    ``mode``: LEXICAL, STRUCTURAL, LEXICAL_STRUCTURAL or LEXICAL_PPR, which walks from each query's seeds. A file
    that no query-bound signal reaches scores as it does for every query, or in the same order, so only the k
    best of those are needed beside the files that are reached.
    """
    extracted = cut(extract_queries(queries, files, symbols))
    signals = cut(lexical_signals(extracted, files, symbols))
    seeds = seed_weights(signals)
    near = cut(nearest_seed(edges, seeds).select("query", F.col("node").alias("path"), "distance"))
    degree = edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("path")).agg((F.log1p(F.count("*")) * 5.0).alias("centrality"))
    central = files.select("path").distinct().join(degree, "path", "left").select("path", F.coalesce("centrality", F.lit(0.0)).alias("centrality"))
    walks = personal_walks(extracted, files.select(F.col("path").alias("node")), edges, seeds) if mode == "LEXICAL_PPR" else None
    order = [F.desc("centrality")] if mode in ("STRUCTURAL", "LEXICAL_STRUCTURAL") else []
    if walks is not None:
        central = central.join(walks.shared.select(F.col("node").alias("path"), "part"), "path")
        order = [F.desc("part")]
    everywhere = central.orderBy(*order, "path").limit(k).select("path")
    held = signals.select("query", "path").union(near.select("query", "path")).union(extracted.select("query").crossJoin(F.broadcast(everywhere)))  # k rows
    if walks is not None:
        held = held.union(walks.near.select("query", F.col("node").alias("path")))
    held = cut(held.distinct().join(central.select("path", "centrality"), "path"))
    r = held.join(signals, ["query", "path"], "left").join(near, ["query", "path"], "left").join(extracted.select("query", (F.size("paths") > 0).alias("names_paths")), "query")
    if walks is not None:
        ranks = walks.ranks(held.select("query", F.col("path").alias("node"))).join(walks.highest(), "query")
        r = r.join(ranks.select("query", F.col("node").alias("path"), (F.col("rank") / F.col("highest") * 20.0).alias("walk")), ["query", "path"], "left")
    else:
        r = r.withColumn("walk", F.lit(None).cast("double"))
    names = ("exact_path", "path_terms", "exact_symbol", "symbol_terms", "walk")
    r = r.select("query", "path", "names_paths", "distance", "centrality", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names], F.coalesce(5.0 / (F.col("distance") + 1), F.lit(0.0)).alias("proximity"))
    score = {
        "LEXICAL": _lexical(), "STRUCTURAL": F.col("centrality") + F.when(F.col("names_paths"), F.col("proximity")).otherwise(0.0),
        "LEXICAL_STRUCTURAL": _lexical() + F.col("proximity") + F.col("centrality"), "LEXICAL_PPR": _lexical() + F.col("proximity") + F.col("walk"),
    }[mode]
    active = F.array_compact(F.array(*[F.when(F.col(c) > 0, c.upper()) for c in ("exact_path", "path_terms", "exact_symbol", "symbol_terms", "proximity", "centrality", "walk")]))
    why = F.when(F.size(active) > 0, F.array_join(active, " + ")).otherwise("DEFAULT_UNRANKED")
    scored = r.select("query", "path", F.round(score, 6).alias("score"), "distance", why.alias("explanation"))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "path")).cast("long")
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def basename_recall(ranked: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per query: share of wanted base names among those of the ranked files."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    want = wanted.select("query", base(F.col("path")).alias("name")).distinct()
    have = ranked.select("query", base(F.col("path")).alias("name"), F.lit(1).alias("hit")).distinct()
    return want.join(have, ["query", "name"], "left").groupBy("query").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


def compact_map(ranked: DataFrame, budget: int) -> DataFrame:
    """Ranked files as lines, up to and with the first at which the bytes reach ``budget``; then a note."""
    line = F.format_string("[%02d] %s (score=%.4f)", "rank", "path", "score")
    w = W.partitionBy("query").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    r = ranked.withColumn("line", line).withColumn("upto", F.sum(F.octet_length("line") + 1).over(w))
    kept = r.where(F.col("upto") - F.octet_length("line") - 1 < budget)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n")
    return kept.groupBy("query").agg(text.alias("map"), F.count("*").alias("files"), (F.max("upto") >= budget).alias("cut"))
