"""Distance buckets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds and names of the buckets.
RECENCY = ((2, "0-2"), (5, "3-5"), (10, "6-10"), (25, "11-25"), (50, "26-50"), (100, "51-100"))
RECENCY_BEYOND = ">100"
EPISODES = ((0, "0_same_episode"), (1, "1_episode"), (5, "2-5_episodes"))
EPISODES_BEYOND = ">5_episodes"
SALIENCE = ((10, "NEAR"), (25, "MEDIUM"), (50, "FAR"))
SALIENCE_BEYOND = "VERY_FAR"


def _ladder(distance: Column, steps, beyond: str) -> Column:
    out = F.when(distance.isNull(), None)
    for bound, name in steps:
        out = out.when(distance <= bound, name)
    return out.otherwise(beyond)


def recency_bucket(distance: Column) -> Column:
    return _ladder(distance, RECENCY, RECENCY_BEYOND)


def episode_bucket(distance: Column) -> Column:
    """An unknown distance is its own bucket."""
    return F.coalesce(_ladder(distance, EPISODES, EPISODES_BEYOND), F.lit("unknown"))


def salience_bucket(distance: Column) -> Column:
    """A first delivery has no distance and no bucket."""
    return _ladder(distance, SALIENCE, SALIENCE_BEYOND)


def ladder_sql(distance: str, steps, beyond: str) -> str:
    return f"CASE WHEN {distance} IS NULL THEN NULL " + " ".join(f"WHEN {distance} <= {b} THEN '{n}'" for b, n in steps) + f" ELSE '{beyond}' END"
