"""Centroid clustering of integer vectors by partial-distance search.

Vectors become integer rows, written once. Each round reads them, finds every row's nearest centroid
and adds up the rows of each cluster within the task; only these sums, whose number is that of
centroids times dimensions, meet and come to the driver, which computes the next centroids exactly.

The search visits dimensions in blocks, those of the highest variance first. A row starts with the
centroid that is nearest over the first block; every other centroid's squared differences add up block
by block, and it is abandoned as soon as its sum is strictly above the row's best, so that ties
finish. Survivors finish all dimensions and replace the best if they are nearer, or as near with a smaller
number.

Defined results: vectors that are null, have another number of components, or hold a null or
non-finite one take no part; a null id has no digest and so starts no centroid while others are
left, but its row is clustered; rows with equal ids are different vectors, those of equal digest start
centroids in the order of their components; with fewer vectors than centroids each vector is one; no
vectors, no rows. Components whose scaled floor does not fit a long raise, as do distances and
inertias; everything below is exact, by Python integers where 62 bits could be left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import bound_batches, map_batches, materialize, without_tools
from tracewell.llm.topk import integer_vectors

#: Dimensions whose differences are added between two looks at the best.
BLOCK = 8
_SAFE = 1 << 62


@dataclass(frozen=True)
class Centroids:
    """Centroids in their numbers' order and the order in which dimensions are visited; of fixed size."""

    rows: tuple[tuple[int, ...], ...]
    order: tuple[int, ...]

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in self.rows]


def _exact(vectors: np.ndarray, centroids: np.ndarray) -> type:
    """The kind of integer that holds every squared distance."""
    least = min(int(vectors.min(initial=0)), int(centroids.min(initial=0)))
    most = max(int(vectors.max(initial=0)), int(centroids.max(initial=0)))
    return np.int64 if (most - least) ** 2 * max(vectors.shape[1], 1) < _SAFE else object


def nearest(vectors: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to each row's nearest centroid, by partial distances."""
    kind = _exact(vectors, centroids)
    v, c = vectors[:, order].astype(kind), centroids[:, order].astype(kind)
    n, width = v.shape

    def part(rows: np.ndarray | slice, k: int | np.ndarray, lo: int) -> np.ndarray:
        apart = v[rows, lo : lo + BLOCK] - c[k, lo : lo + BLOCK]
        return (apart * apart).sum(1)

    first = np.stack([part(slice(None), k, 0) for k in range(len(c))])
    number = first.argmin(0)
    best = first[number, np.arange(n)]
    for lo in range(BLOCK, width, BLOCK):
        best = best + part(slice(None), number, lo)
    for k in range(len(c)):
        alive = np.flatnonzero((first[k] <= best) & (number != k))
        total = first[k][alive]
        for lo in range(BLOCK, width, BLOCK):
            total = total + part(alive, k, lo)
            on = total <= best[alive]
            alive, total = alive[on], total[on]
            if not len(alive):
                break
        nearer = (total < best[alive]) | (k < number[alive])
        best[alive[nearer]], number[alive[nearer]] = total[nearer], k
    return number, best


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _round(vectors: DataFrame, at: Centroids, width: int) -> dict[int, tuple[int, list[int]]]:
    """Per non-empty cluster: rows and componentwise sums. At most centroids x dimensions numbers come back."""
    centroids, order = np.array(at.rows, np.int64), np.array(at.order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without_tools()
        held = np.zeros(len(centroids), np.int64)
        total = np.zeros((len(centroids), width), object)
        for batch in batches:
            rows = _matrix(batch.column(0), width)
            number, _ = nearest(rows, centroids, order)
            held += np.bincount(number, minlength=len(centroids))
            least = max(-int(rows.min(initial=0)), int(rows.max(initial=0)))
            part = np.zeros(total.shape, np.int64 if least * len(rows) < _SAFE else object)
            np.add.at(part, number, rows.astype(part.dtype))
            total += part
        at = np.flatnonzero(held)
        sums = pa.array([[Decimal(int(x)) for x in total[k]] for k in at], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at]), sums], ["cluster", "held", "sums"])

    parts = vectors.select("v").mapInArrow(run, "cluster int, held long, sums array<decimal(38,0)>")
    sums = [F.sum(F.col("sums")[k]) for k in range(width)]
    return {r[0]: (r[1], [int(x) for x in r[2:]]) for r in parts.groupBy("cluster").agg(F.sum("held"), *sums).collect()}


def start(vectors: DataFrame, k: int, digest: Column, width: int) -> Centroids:
    """The ``k`` vectors of smallest digest, and dimensions by falling variance."""
    rows = vectors.select(digest.alias("digest"), "v").orderBy(F.asc_nulls_last("digest"), "v").limit(k).collect()
    spread = vectors.agg(*[F.var_pop(F.col("v")[d].cast("double")) for d in range(width)]).first()
    order = sorted(range(width), key=lambda d: (-(spread[d] or 0.0), d))
    return Centroids(tuple(tuple(r["v"]) for r in rows), tuple(order))


def cluster(vectors: DataFrame, k: int, rounds: int, digest: Column, width: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Centroids]:
    """``id``, ``cluster`` and ``distance`` of every vector that takes part, and the final centroids.

    ``digest`` is an expression over ``id``; the vectors of smallest digest start the centroids.
    """
    bound_batches(vectors.sparkSession)
    fit = vectors.where(F.size(vectors[vector_col]) == width)
    kept = materialize(integer_vectors(fit, scale, id_col, vector_col, null_ids=True), "cluster-vectors")
    at = start(kept, k, digest, width)
    for _ in range(rounds if at.rows else 0):
        found = _round(kept, at, width)
        rows = [tuple(x // found[c][0] for x in found[c][1]) if c in found else row for c, row in enumerate(at.rows)]
        at = Centroids(tuple(rows), at.order)
    centroids, order = np.array(at.rows, np.int64).reshape(-1, width), np.array(at.order)

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        number, distance = nearest(_matrix(batch.column(1), width), centroids, order)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], ["id", "cluster", "distance"])

    return map_batches(kept.select("id", "v"), assign, "id long, cluster int, distance long"), at


def with_inertia(assigned: DataFrame, at: Centroids) -> DataFrame:
    """``assigned`` with ``cluster_inertia``, ``inertia`` and ``centroid_sha256``.

    The assignment is written once. One row for each centroid is joined to it: its number is a parameter.
    """
    done = materialize(assigned, "clusters")
    per = done.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    total = sum(r["cluster_inertia"] for r in per)
    digests = at.digests()
    rows = [(r["cluster"], r["cluster_inertia"], total, digests[r["cluster"]]) for r in per]
    facts = done.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(facts), "cluster")
