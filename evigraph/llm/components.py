"""Connected components of a graph that lives in a DataFrame.

Edges point from a node to a smaller one.  Each round keeps for every node its
least parent, turns its other parents into edges to that one, and moves edges
from a parent to the parent's own least parent (pointer jumping).  Both steps
keep what is connected connected, and parents only fall, so the rounds end when
every node has one parent, a root.  The depth halves with each round; only two
counts a round come to the driver, and each round is written to the shared
folder, so that no lineage grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import materialize_at, remove

MAX_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge to another; root is the least node reachable.

    ``edges`` should be cheap to read; loops and nulls are ignored.
    """
    spark = edges.sparkSession
    down = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("p")).distinct()
    now, path = materialize_at(down, "edges")
    for _ in range(MAX_ROUNDS):
        least = now.groupBy("v").agg(F.min("p").alias("m"))
        joined = now.join(least, "v")
        # (v, least parent) once, and every other parent tied to the least
        tied = joined.select(F.explode(F.array(F.struct(F.col("v"), F.col("m").alias("p")), F.struct(F.col("p").alias("v"), F.col("m").alias("p")))).alias("e"))
        tied = tied.select("e.v", "e.p").where("v != p").distinct()
        above = least.select(F.col("v").alias("p"), F.col("m").alias("up"))
        jumped = tied.join(above, "p", "left").select("v", F.least(F.coalesce("up", "p"), "p").alias("p")).distinct()
        after, next_path = materialize_at(jumped, "edges")
        kids = after.groupBy("v").count().agg(F.count(F.lit(1)).alias("nodes"), F.sum("count").alias("edges")).first()
        roots = after.join(after.select(F.col("v").alias("p")).distinct(), "p", "left_semi").limit(1).count() == 0
        remove(spark, path)
        now, path = after, next_path
        if roots and kids["nodes"] == (kids["edges"] or 0):
            return now.select(F.col("v").alias("node"), F.col("p").alias("root"))
    raise RuntimeError("components did not settle")
