"""PageRank over an edge list (dst, src, p).

r' = alpha * sum of p * r over the edges into a node + (1 - alpha) / N * sum of r, from r = 1,
until no rank moves by epsilon. Weights are taken as given; dangling nodes are not treated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import differs
from ..plans.store import iterate, settle

ALPHA, EPSILON, MOST = 0.85, 0.01, 1000


def last_edges(edges: DataFrame, order: str) -> DataFrame:
    """Of edges with the same ends, the last in the given order."""
    w = Window.partitionBy("dst", "src").orderBy(F.desc(order))
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def step(edges: DataFrame, ranks: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """ranks (node, r) -> (node, before, r). All nodes stay, also those without edges.

    Edges meet ranks on src and are summed on dst; the total rank is one number.
    """
    n, total = ranks.agg(F.count(F.lit(1)), F.coalesce(F.sum("r"), F.lit(0.0))).first()
    heard = edges.join(ranks.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("r")).alias("s"))
    teleport = (1 - alpha) / n * total if n else 0.0
    return ranks.join(heard, "node", "left").select("node", F.col("r").alias("before"), (alpha * F.coalesce("s", F.lit(0.0)) + F.lit(teleport)).alias("r"))


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = ALPHA, epsilon: float = EPSILON, most: int = MOST) -> DataFrame:
    """(node, r) at the fixpoint. The edges are written once, the ranks after each round; a round shuffles the edges by src unless the ranks are small enough to be broadcast."""
    edges = settle(edges.select("dst", "src", F.col("p").cast("double").alias("p")), "edges")
    start = nodes.select("node").distinct().select("node", F.lit(1.0).alias("before"), F.lit(1.0).alias("r"))
    moved = lambda s: s.where(differs(F.col("r"), F.col("before"), epsilon)).limit(1).count() == 0
    ranks, _ = iterate(start, lambda s: step(edges, s.select("node", "r"), alpha), moved, most, "ranks")
    return ranks.select("node", "r")
