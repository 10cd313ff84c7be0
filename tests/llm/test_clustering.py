"""Centroid clustering against a plain version."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import clustering

ROWS = "vec_id long, embedding array<double>"


def plain(rows, k, rounds, width, scale=256):
    """Full distances, Python integers, one vector after another."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    at = [v for _, v in sorted(kept, key=digest)[:k]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    nearest = lambda v: min(range(len(at)), key=lambda c: (far(v, at[c]), c))
    for _ in range(rounds):
        of = {}
        for _, v in kept:
            of.setdefault(nearest(v), []).append(v)
        at = [[sum(x) // len(of[c]) for x in zip(*of[c])] if c in of else at[c] for c in range(len(at))]
    done = [(i, nearest(v), far(v, at[nearest(v)])) for i, v in kept]
    total = sum(d for *_, d in done)
    sha = lambda c: hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()
    return [(i, c, d, sum(e for _, b, e in done if b == c), total, sha(c)) for i, c, d in done]


def found(spark, rows, k, rounds, width, extra=()):
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    for name in extra:
        df = df.withColumn(name, F.lit(1))
    digest = F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")).cast("binary"), 256)
    got = clustering.with_inertia(*clustering.cluster(df, k, rounds, digest, width))
    return [tuple(r) for r in got.select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()]


def vectors(n, width, seed, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(rng.randrange(4), 0.1) * spread for _ in range(width)]) for i in range(n)]


@pytest.mark.parametrize("width", [1, 8, 20])
def test_equals_the_plain_version(spark, width):
    rows = vectors(120, width, width)
    odd = [(200, None), (201, []), (202, [1.0] * (width + 1)), (203, [None] * width), (204, [math.nan] * width), (205, [-math.inf] * width), (None, [0.5] * width), (7, [2.0] * width), (7, [1.0] * width)]
    rows += odd + rows[:10] + [(300 + i, rows[3][1]) for i in range(60)]  # repeated rows, and one large group of copies
    assert sorted(found(spark, rows, 9, 3, width, ("id", "v", "cluster", "distance")), key=repr) == sorted(plain(rows, 9, 3, width), key=repr)


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(40)]  # several centroids start equal
    assert sorted(found(spark, rows, 12, 4, 2)) == sorted(plain(rows, 12, 4, 2))


def test_few_no_and_large_vectors(spark):
    few = vectors(3, 4, 1)
    assert sorted(found(spark, few, 40, 5, 4)) == sorted(plain(few, 40, 5, 4))
    assert found(spark, [], 40, 5, 4) == [] and found(spark, [(1, None), (2, [1.0])], 40, 5, 4) == []
    large = [(i, [x * 2.0**20 for x in v]) for i, v in vectors(30, 4, 2)]
    assert sorted(found(spark, large, 5, 2, 4)) == sorted(plain(large, 5, 2, 4))
    with pytest.raises(Exception, match="long|int64|Overflow|too large"):
        found(spark, [(1, [2.0**50]), (2, [-(2.0**50)])], 1, 0, 1)  # a squared distance of 2^118


def test_partial_distances_equal_full_ones():
    rng = np.random.default_rng(3)
    for width in (1, 7, 8, 9, 64):
        v, c = rng.integers(-9, 9, (300, width)), rng.integers(-9, 9, (40, width))
        full = ((v[:, None] - c[None]) ** 2).sum(2)
        number, best = clustering.nearest(v, c, rng.permutation(width))
        assert (number == full.argmin(1)).all() and (best == full.min(1)).all()
