"""k-means on points (id, features).

Centroids start as the first k points by id. A point joins the centroid at the smallest squared
distance, the lower number of equals; an empty cluster's centroid becomes the zero vector. It
ends when no point changes its cluster, when the total distance grows (then the round before
counts), or after `most` further rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles, squared_distance
from ..plans.store import ship

MOST = 100


def first_k(points: DataFrame, k: int) -> np.ndarray:
    rows = points.orderBy("id").limit(k).select(doubles(F.col("features")).alias("f")).collect()
    if len(rows) < k:
        raise ValueError(f"{k} clusters need as many points; there are {len(rows)}")
    return np.array([r.f for r in rows], np.float64)


def literal(centroids: np.ndarray) -> F.Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centroids])


def distances(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, d): the squared distance of every point to every centroid. The centroids, k x dimensions numbers, travel in the plan."""
    each = points.select("id", doubles(F.col("features")).alias("f"), F.posexplode(literal(centroids)).alias("cluster", "c"))
    return each.select("id", "cluster", squared_distance(F.col("f"), F.col("c")).alias("d"))


def assign(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, d) of the nearest centroid, without a shuffle."""
    f = doubles(F.col("features"))
    d = F.transform(literal(centroids), lambda c, i: F.struct(squared_distance(F.col("f"), c).alias("d"), i.alias("cluster")))
    return points.select("id", f.alias("f")).select("id", F.array_min(d).alias("x")).select("id", F.col("x.cluster").alias("cluster"), F.col("x.d").alias("d"))


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance for each row of x, in blocks that bound memory."""
    at, best = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    step = max(1, 4_000_000 // max(1, x.shape[1] if x.ndim > 1 else 1))
    for s in range(0, len(x), step):
        for j, cj in enumerate(c):
            d = ((x[s : s + step] - cj) ** 2).sum(1)
            less = d < best[s : s + step]
            best[s : s + step][less] = d[less]
            at[s : s + step][less] = j
    return at, best


@dataclass
class Round:
    total: float
    changed: int
    centroids: np.ndarray
    sizes: np.ndarray


def one_round(points: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> Round:
    """One pass over the points. Each batch becomes a row for each cluster (count, sums, distance, changes), so the shuffle has a few rows from each task.

    What changed is told by assigning to the centroids before as well, so assignments are never stored.
    """
    ship(points.sparkSession)
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, total, changed = np.zeros(k, np.int64), np.zeros((k, dim)), np.zeros(k), np.zeros(k, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, dim)
            at, d = nearest(x, centroids)
            n += np.bincount(at, minlength=k)
            total += np.bincount(at, d, k)
            np.add.at(sums, at, x)
            changed += np.bincount(at, np.ones(len(at)) if before is None else at != nearest(x, before)[0], k).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"cluster": np.arange(k, dtype=np.int32), "n": n, "total": total, "changed": changed, "sums": list(sums)})

    parts = points.select(doubles(F.col("features")).alias("f")).mapInArrow(run, "cluster int, n long, total double, changed long, sums array<double>")
    whole = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("changed").alias("changed"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim)])
    out = Round(0.0, 0, np.zeros((k, dim)), np.zeros(k, np.int64))
    for r in whole.orderBy("cluster").collect():
        out.total += r.total
        out.changed += r.changed
        out.sizes[r.cluster] = r.n
        if r.n:
            out.centroids[r.cluster] = np.array([r[f"s{i}"] for i in range(dim)]) / r.n
    return out


@dataclass
class Fit:
    centroids: np.ndarray  # as updated last
    assigned_by: np.ndarray  # the centroids that the final assignment goes by
    total: float
    rounds: int


def fit(points: DataFrame, k: int, most: int = MOST, start: np.ndarray | None = None) -> Fit:
    used = first_k(points, k) if start is None else np.asarray(start, np.float64)
    r = one_round(points, used, None)
    n = 1
    for _ in range(most):
        nxt = one_round(points, r.centroids, used)
        n += 1
        if nxt.changed == 0:
            return Fit(nxt.centroids, r.centroids, nxt.total, n)
        if r.total < nxt.total:
            return Fit(r.centroids, used, r.total, n)
        used, r = r.centroids, nxt
    return Fit(r.centroids, used, r.total, n)


def centroid_frame(spark, centroids: np.ndarray) -> DataFrame:
    """(cluster, dim, x)."""
    rows = [(i, j, float(x)) for i, c in enumerate(centroids) for j, x in enumerate(c)]
    return spark.createDataFrame(rows, "cluster int, dim int, x double")


def update(points: DataFrame, assignment: DataFrame, k: int) -> DataFrame:
    """(cluster, dim, x): means of the members; zeros for an empty cluster."""
    long = points.join(assignment.select("id", "cluster"), "id").select("cluster", F.posexplode(doubles(F.col("features"))).alias("dim", "v"))
    means = long.groupBy("cluster", "dim").agg(F.avg("v").alias("x"))
    grid = points.select(F.size("features").alias("n")).limit(1).select(F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("cluster"), "n").select("cluster", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("dim"))
    return grid.join(means, ["cluster", "dim"], "left").select("cluster", "dim", F.coalesce("x", F.lit(0.0)).alias("x"))


def report(assignment: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cluster, n, x0, x1): members and the first two coordinates; clusters without members stay."""
    first = centroids.groupBy("cluster").agg(F.max(F.when(F.col("dim") == 0, F.col("x"))).alias("x0"), F.max(F.when(F.col("dim") == 1, F.col("x"))).alias("x1"))
    sizes = assignment.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return first.join(sizes, "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).alias("n"), "x0", "x1")
