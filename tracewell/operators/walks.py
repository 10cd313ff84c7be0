"""Personalised walks of many tasks over one graph.

A walk follows links with the damping's chance, else starts again at its task's seeds; what nodes without
links hold is spread over all nodes. The last part makes every rank dense, but it is the same for all
tasks but for a factor: a rank is what the seeds alone give, a series that only reaches what lies
behind them, plus a multiple of what a uniform start gives. So the seeds' series of all tasks and one uniform
series run together, each until its own rest is below the tolerance, and one number for each task joins
them. No row is kept for a task and a node that its seeds do not reach.
"""

from __future__ import annotations

from dataclasses import dataclass
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.sources.scratch import Steps, cut


@dataclass(frozen=True)
class Walks:
    """Ranks of all tasks: ``near`` (query, node, part), ``shared`` (node, part) and ``scale`` (query, scale)."""

    near: DataFrame
    shared: DataFrame
    scale: DataFrame

    def ranks(self, pairs: DataFrame) -> DataFrame:
        """``rank`` of each of ``pairs`` (query, node); nodes that are not in the graph have none."""
        own = self.near.withColumnRenamed("part", "_own")
        joined = pairs.join(self.scale, "query").join(self.shared, "node").join(own, ["query", "node"], "left")
        return joined.select("query", "node", (F.coalesce("_own", F.lit(0.0)) + F.col("scale") * F.col("part")).alias("rank"))

    def highest(self) -> DataFrame:
        """Each query's highest rank: at a node that its seeds reach, or where the shared part is highest."""
        top = self.shared.agg(F.max("part").alias("top"))
        near = self.ranks(self.near.select("query", "node")).groupBy("query").agg(F.max("rank").alias("own"))
        return self.scale.join(near, "query", "left").crossJoin(F.broadcast(top)).select("query", F.greatest(F.coalesce("own", F.lit(0.0)), F.col("scale") * F.col("top")).alias("highest"))  # top is one row


def personal_walks(queries: DataFrame, nodes: DataFrame, edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6) -> Walks:
    """Walks of ``queries`` (query) from ``seeds`` (query, node, weight) over ``edges`` (src, dst).

    Seeds that are no nodes, and weights that are null or not above zero, are left out; a query without any
    starts uniformly. Nodes are the given ones and all ends of edges; null nodes and edges with a null end are left out. The rest
    of every series is below ``tolerance`` of its start.
    """
    out = edges.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct()
    every = cut(nodes.select("node").where(F.col("node").isNotNull()).union(out.select("src")).union(out.select("dst")).distinct())
    n = every.count()
    degree = out.groupBy("src").agg(F.count("*").alias("degree"))
    links = cut(out.join(degree, "src").select("src", "dst", (damping / F.col("degree")).alias("share")))
    asked = cut(queries.select("query").where(F.col("query").isNotNull()).distinct())
    valid = seeds.where(F.col("weight") > 0).join(every, "node", "left_semi").join(asked, "query", "left_semi").groupBy("query", "node").agg(F.sum("weight").cast("double").alias("weight"))
    total = valid.groupBy("query").agg(F.sum("weight").alias("total"))
    own = valid.join(total, "query").select("query", "node", F.lit(False).alias("uniform"), ((1 - damping) * F.col("weight") / F.col("total")).alias("part"))
    start = F.lit((1 - damping) / max(n, 1))
    kind = own.schema["query"].dataType
    steps = Steps(edges.sparkSession, "walks")
    moving = steps.append(own.union(every.select(F.lit(None).cast(kind).alias("query"), "node", F.lit(True).alias("uniform"), start.alias("part"))))
    while not moving.isEmpty():
        moved = cut(moving.join(links, moving["node"] == links["src"]).groupBy("query", F.col("dst").alias("node"), "uniform").agg(F.sum(F.col("part") * F.col("share")).alias("part")))
        rest = moved.groupBy(F.col("query").alias("_q"), F.col("uniform").alias("_u")).agg(F.sum("part").alias("_rest")).where(F.col("_rest") >= tolerance * (1 - damping))
        moving = steps.append(moved.join(rest, F.col("query").eqNullSafe(F.col("_q")) & (F.col("uniform") == F.col("_u")), "left_semi"))
    parts = cut(steps.all().groupBy("query", "node", "uniform").agg(F.sum("part").alias("part")))
    shared = cut(parts.where("uniform").select("node", "part"))
    near = cut(parts.where(~F.col("uniform")).select("query", "node", "part"))
    ends = every.join(degree.select(F.col("src").alias("node")), "node", "left_anti")
    held = shared.join(ends, "node").agg(F.coalesce(F.sum("part"), F.lit(0.0))).first()[0]
    again = damping / (1 - damping)
    stuck = near.join(ends, "node", "left_semi").groupBy("query").agg(F.sum("part").alias("stuck"))
    joined = asked.join(stuck, "query", "left").join(near.select("query").distinct().withColumn("seeded", F.lit(True)), "query", "left")
    lost = F.when(F.col("seeded"), F.coalesce("stuck", F.lit(0.0))).otherwise(F.lit(held)) / (1 - again * held)
    return Walks(near, shared, cut(joined.select("query", (F.when(F.col("seeded"), 0.0).otherwise(1.0) + again * lost).alias("scale"))))
