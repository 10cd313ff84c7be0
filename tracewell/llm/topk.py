"""Exact top-k inner products by term-at-a-time accumulation.

Vectors become integer rows; a row's non-zero components are its terms. Candidates are packed
into blocks that keep one posting list (row, weight) for each term. Each query row of a query
block visits its terms one after another and scatters ``query weight x posting weight`` into a
dense score array over the block. The best k of each block are selected in the task and merged
by query.

Query blocks and candidate blocks meet through an equi-join on the query block's number, so
neither side is broadcast or collected, however many queries there are. Both travel as binary
matrices. A task holds one query block, one candidate block and the best k so far; query blocks are
large, as candidates are sent once for each.

Defined results: vectors that are null, or hold a null or non-finite component, take no part;
empty vectors and components beyond a vector's length count as zeros; a query is never its own
candidate, and rows with equal ids are one another's own; ties go to the smaller id. Components whose
scaled floor does not fit a long raise; scores that could leave 63 bits are computed with Python
integers and raise if they do not fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell.llm.common import bound_batches

#: Rows of a query block and of a candidate block.
QUERY_ROWS = 16_384
CANDIDATE_ROWS = 8192
#: Candidate blocks that share one copy of a query block.
GROUP_BLOCKS = 1
_SAFE = 1 << 62


def integer_vectors(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", null_ids: bool = False) -> DataFrame:
    """``id`` and ``v``: floor(scale * component) of the vectors that take part; rows without an id do so only with ``null_ids``."""
    v = vectors[vector_col]
    x = F.transform(v, lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    wide = lambda c: F.raise_error(F.concat(F.lit("component does not fit a long: "), c.cast("string"))).cast("long")
    scaled = F.transform(x, lambda c: F.when(F.abs(F.floor(F.lit(float(scale)) * c).cast("double")) >= F.lit(2.0**63), wide(c)).otherwise(F.floor(F.lit(float(scale)) * c)))
    named = F.lit(True) if null_ids else vectors[id_col].isNotNull()
    return vectors.where(v.isNotNull() & named).where(~bad).select(vectors[id_col].cast("long").alias("id"), scaled.alias("v"))


def _matrix(rows: pa.ListArray) -> np.ndarray:
    """Rows of one width; shorter ones end in zeros."""
    size = np.asarray(rows.value_lengths(), np.int64)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = rows.flatten().to_numpy()
    return out


def _blob(matrix: np.ndarray) -> bytes:
    """A matrix in the narrowest integers that hold it, behind their size and its width."""
    least, most = int(matrix.min(initial=0)), int(matrix.max(initial=0))
    kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= least and most <= np.iinfo(t).max)
    return np.array([np.dtype(kind).itemsize, matrix.shape[1]], "<i8").tobytes() + matrix.astype(kind).tobytes()


def _from_blob(blob: bytes, rows: int) -> np.ndarray:
    size, width = np.frombuffer(blob, "<i8", 2).tolist()
    return np.frombuffer(blob, f"<i{size}", rows * width, 16).reshape(rows, width).astype(np.int64)


def score_block(queries: np.ndarray, candidates: np.ndarray):
    """Yields the dense score array of each query row over the candidate rows."""
    width = min(queries.shape[1], candidates.shape[1])
    reach = lambda m: max(-int(m.min(initial=0)), int(m.max(initial=0)))  # noqa: E731  np.abs would wrap at the least long
    most = reach(queries) * reach(candidates) * max(width, 1)
    kind = np.int64 if most < _SAFE else object
    postings = []
    for term in range(width):
        weights = candidates[:, term].astype(kind)
        rows = np.flatnonzero(weights)
        postings.append((slice(None) if len(rows) == len(weights) else rows, weights if len(rows) == len(weights) else weights[rows]))
    for query in queries:
        scores = np.zeros(len(candidates), kind)
        for term in np.flatnonzero(query[:width]):
            rows, weights = postings[term]
            scores[rows] += weights * (query[term] if kind is np.int64 else int(query[term]))
        yield scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, found by selection."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        level = np.flatnonzero(scores == least)
        level = level[np.argsort(ids[level], kind="stable")[: k - len(above)]]
        at = np.concatenate([above, level])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))]


def _long(n: int):
    return F.lit(n).cast("long")


def _block(ids: list[np.ndarray], parts: list[np.ndarray]) -> pa.RecordBatch:
    rows = np.zeros((sum(map(len, parts)), max((p.shape[1] for p in parts), default=0)), np.int64)
    at = 0
    for p in parts:
        rows[at : at + len(p), : p.shape[1]] = p
        at += len(p)
    names = np.concatenate(ids).astype("<i8")
    return pa.RecordBatch.from_arrays([pa.array(names[:1]), pa.array([names.tobytes()], pa.binary()), pa.array([_blob(rows)], pa.binary())], ["first", "ids", "rows"])


def _packed(vectors: DataFrame, most: int) -> DataFrame:
    """``first`` id, ``ids`` and ``rows`` of blocks of at most ``most`` vectors, made in place from each partition."""

    def run(batches):
        ids, parts, held = [], [], 0
        for batch in batches:
            name, rows = batch.column(0).to_numpy(), _matrix(batch.column(1))
            while len(name):
                take = min(most - held, len(name))
                ids.append(name[:take]), parts.append(rows[:take])
                name, rows, held = name[take:], rows[take:], held + take
                if held == most:
                    yield _block(ids, parts)
                    ids, parts, held = [], [], 0
        if held:
            yield _block(ids, parts)

    return vectors.select("id", "v").mapInArrow(run, "first long, ids binary, rows binary")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """Both inputs as of :func:`integer_vectors`; one row for each query and rank.

    The counts that set the numbers of blocks are two scans of the ids.
    """
    bound_batches(candidates.sparkSession)
    n_query_blocks = max(1, -(-queries.count() // QUERY_ROWS))
    n_groups = max(1, -(-candidates.count() // (CANDIDATE_ROWS * GROUP_BLOCKS)))

    def gather(table: pa.Table) -> pa.Table:
        made = _block([table["id"].to_numpy()], [_matrix(table["v"].combine_chunks())])
        return pa.table({"block": table["block"].slice(0, 1), "q_ids": made["ids"], "q_rows": made["rows"]})

    asked = (
        queries.select(F.pmod(F.xxhash64("id"), F.lit(n_query_blocks)).alias("block"), "id", "v")
        .groupBy("block")
        .applyInArrow(gather, "block long, q_ids binary, q_rows binary")
        .withColumn("part", F.explode(F.sequence(_long(0), _long(n_groups - 1))))
    )
    held = _packed(candidates, CANDIDATE_ROWS).select("ids", "rows", F.pmod(F.xxhash64("first"), F.lit(n_groups)).alias("part"), F.explode(F.sequence(_long(0), _long(n_query_blocks - 1))).alias("block"))

    def run(batches):
        for batch in batches:
            for q_ids, q_rows, ids, rows in zip(*(batch.column(c).to_pylist() for c in range(4))):
                asking, names = np.frombuffer(q_ids, "<i8"), np.frombuffer(ids, "<i8")
                found = []
                for q, scores in zip(asking.tolist(), score_block(_from_blob(q_rows, len(asking)), _from_blob(rows, len(names)))):
                    own = names == q
                    at = best(scores, names, k) if not own.any() else (others := np.flatnonzero(~own))[best(scores[others], names[others], k)]
                    found += zip([q] * len(at), names[at].tolist(), scores[at].tolist())
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    scored = held.join(asked, ["block", "part"]).select("q_ids", "q_rows", "ids", "rows").mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
