"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from socspark.plans.storage import stored


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; a component is named by its smallest node.

    In each round a node joins the neighbour, or itself, that comes first in a
    hashed order of that round, and edges are relabelled and made distinct;
    the hashed order keeps long paths from taking a round a node. Aggregations
    are partial; the joins on a hub's key are split by adaptive execution only.
    Rounds are written to the shared folder. Edges with a null end are left out, a loop
    makes its node a component, and no edges give an empty result.
    """
    a, b = F.col(src).alias("a"), F.col(dst).alias("b")
    known = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    first = known.select(a, b)
    nodes = first.select(F.col("a").alias("node")).union(first.select(F.col("b").alias("node"))).distinct()
    live = stored(first.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    while not live.isEmpty():
        if len(steps) == most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        rank = lambda c, r=len(steps): F.struct(F.xxhash64(F.lit(r), F.col(c)).alias("h"), F.col(c).alias("n"))
        both = live.select(F.col("a").alias("node"), rank("b").alias("x")).union(live.select(F.col("b").alias("node"), rank("a").alias("x")))
        best = both.groupBy("node").agg(F.min("x.h").alias("h"), F.min_by("x.n", "x.h").alias("n"))
        step = stored(best.select("node", F.when(F.col("h") < F.xxhash64(F.lit(len(steps)), F.col("node")), F.col("n")).otherwise(F.col("node")).alias("to")), "contraction")
        steps.append(step)
        moved = live.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        moved = moved.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        live = stored(moved, "edges")
    labels = nodes.withColumn("label", F.col("node"))
    for step in steps:
        labels = labels.join(step.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    labels = stored(labels, "labels")
    names = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(names, "label").select("node", "component")
