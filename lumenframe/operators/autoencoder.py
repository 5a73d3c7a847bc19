"""Fitting small networks to a table: linear and non-linear principal components, and XOR.

The objective is the square root of the sum over examples of their squared error; an example's
error is itself a sum of squares, or for XOR the plain residual. loss() is one aggregate over
generated column expressions; the minimiser needs no gradients and asks for several candidates
at once, which share a pass over the examples.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from statistics import mean
from time import perf_counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import networks
from ..plans.store import ship

#: From parameters to the error expression of one example.
Build = Callable[[Sequence[float]], Column]


def autoencoder_error(inputs: Sequence[str] = ("x0", "x1"), sizes: Sequence[int] = networks.AUTOENCODER, activation: str = "elliott") -> Build:
    cols = [F.col(c).cast("double") for c in inputs]
    return lambda p: networks.squared_error(networks.forward(cols, p, sizes, activation), cols)


def xor_error(activation: str = "elliott") -> Build:
    return lambda p: networks.xor_forward(F.col("x0").cast("double"), F.col("x1").cast("double"), p, activation) - F.col("y0").cast("double")


def loss(examples: DataFrame, build: Build, parameters: Sequence[float]) -> DataFrame:
    """(loss)."""
    e = build(parameters)
    return examples.agg(F.sqrt(F.coalesce(F.sum(e * e), F.lit(0.0))).alias("loss"))


def loss_sharded(examples: DataFrame, build: Build, parameters: Sequence[float], shard: str) -> DataFrame:
    """(loss): the sum over shards of the root of each shard's sum; it depends on the sharding, the plain loss does not."""
    e = build(parameters)
    return examples.groupBy(shard).agg(F.sqrt(F.sum(e * e)).alias("r")).agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("loss"))


#: The error of each row of a matrix of examples.
RowError = Callable[[np.ndarray, np.ndarray], np.ndarray]


def autoencoder_rows(sizes: Sequence[int] = networks.AUTOENCODER, activation: str = "elliott") -> RowError:
    return lambda x, p: np.square(networks.forward_rows(x, p, sizes, activation) - x).sum(1)


def xor_rows(activation: str = "elliott") -> RowError:
    return lambda x, p: networks.xor_rows(x, p, activation) - x[:, 2]


def losses(examples: DataFrame, columns: Sequence[str], error: RowError, candidates: Sequence[np.ndarray]) -> list[float]:
    """The loss of several candidates in one pass: a task sends one number for each. New parameters need no new plan, which generated expressions would."""
    ship(examples.sparkSession)

    def run(batches):
        total = np.zeros(len(candidates))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns])
            total += [np.square(error(x, p)).sum() for p in candidates]
        yield pa.RecordBatch.from_pydict({"i": np.arange(len(total), dtype=np.int32), "s": total})

    rows = examples.select(*columns).mapInArrow(run, "i int, s double").groupBy("i").agg(F.sqrt(F.sum("s")).alias("l")).collect()
    got = {r.i: r.l for r in rows}
    return [float(got.get(i, 0.0)) for i in range(len(candidates))]


@dataclass
class Timing:
    """Seconds of each evaluation, and the work that they did."""

    flops: float
    seconds: list[float] = field(default_factory=list)

    def row(self) -> dict[str, float]:
        if not self.seconds:
            return {"n": 0, "avg": 0.0, "min": 0.0, "max": 0.0, "gflops": 0.0}
        avg = mean(self.seconds)
        return {"n": len(self.seconds), "avg": avg, "min": min(self.seconds), "max": max(self.seconds), "gflops": self.flops / avg / 1e9}


@dataclass
class Fitted:
    parameters: list[float]
    loss: float
    trace: list[float]
    evaluations: int
    timing: Timing


def minimise(evaluate: Callable[[list[np.ndarray]], list[float]], start: np.ndarray, most: int = 400, ftol: float = 1e-4, batch: int = 8, seed: int = 0, width: float = 0.3) -> tuple[np.ndarray, float, list[float], int]:
    """A (batch / 4, batch) evolution strategy with cumulative step size: no gradients, `batch` candidates for each call of evaluate. Never worse than the start."""
    rng = np.random.default_rng(seed)
    n, mu = len(start), max(1, batch // 4)
    weights = np.log(mu + 0.5) - np.log(np.arange(1, mu + 1))
    weights /= weights.sum()
    power = 1 / (weights**2).sum()
    c = (power + 2) / (n + power + 5)
    centre, path, scale = start.astype(float), np.zeros(n), width
    best = centre.copy()
    lowest = evaluate([best])[0]
    trace, used, still = [lowest], 1, 0
    while used + batch <= most and still < 30:
        z = rng.normal(size=(batch, n))
        values = np.array(evaluate([centre + scale * v for v in z]))
        used += batch
        order = values.argsort()[:mu]
        step = weights @ z[order]
        if values[order[0]] < lowest:
            still = 0 if lowest - values[order[0]] > ftol * max(1.0, abs(lowest)) else still + 1
            lowest, best = float(values[order[0]]), centre + scale * z[order[0]]
        else:
            still += 1
        centre = centre + scale * step
        path = (1 - c) * path + np.sqrt(c * (2 - c) * power) * step
        scale *= np.exp((np.linalg.norm(path) / np.sqrt(n) - 1) * 0.3)
        trace.append(lowest)
    return best, lowest, trace, used


def fit(examples: DataFrame, columns: Sequence[str], error: RowError, n_parameters: int, most: int = 400, ftol: float = 1e-4, seed: int = 0, start: Sequence[float] | None = None, flops: float = 0.0, optimiser: Callable = minimise) -> Fitted:
    """Parameters that lower the loss, from 0.1 x uniform(0, 1) unless a start is given. The examples are read from memory after the first pass.

    optimiser: any function with the signature of minimise.
    """
    examples = examples.persist()
    try:
        timing = Timing(flops * examples.count())

        def evaluate(candidates: list[np.ndarray]) -> list[float]:
            t = perf_counter()
            got = losses(examples, columns, error, candidates)
            timing.seconds.append(perf_counter() - t)
            return got

        x0 = np.asarray(start, float) if start is not None else 0.1 * np.random.default_rng(seed).random(n_parameters)
        best, lowest, trace, used = optimiser(evaluate, x0, most, ftol, seed=seed)
        return Fitted(best.tolist(), lowest, trace, used, timing)
    finally:
        examples.unpersist()


def repeated_loss(examples: DataFrame, columns: Sequence[str], error: RowError, parameters: Sequence[float], times: int, flops: float = 0.0) -> tuple[list[float], Timing]:
    """The same evaluation several times over examples in memory: its results, which should agree, and its timing."""
    examples = examples.persist()
    try:
        timing, got = Timing(flops * examples.count()), []
        for _ in range(times):
            t = perf_counter()
            got += losses(examples, columns, error, [np.asarray(parameters, float)])
            timing.seconds.append(perf_counter() - t)
        return got, timing
    finally:
        examples.unpersist()


def predict(examples: DataFrame, parameters: Sequence[float], inputs: Sequence[str] = ("x0", "x1"), sizes: Sequence[int] = networks.AUTOENCODER, activation: str = "elliott") -> DataFrame:
    """examples with o0, o1, ..."""
    outs = networks.forward([F.col(c).cast("double") for c in inputs], parameters, sizes, activation)
    return examples.withColumns({f"o{i}": o for i, o in enumerate(outs)})


def predict_xor(examples: DataFrame, parameters: Sequence[float], activation: str = "elliott") -> DataFrame:
    return examples.withColumn("o0", networks.xor_forward(F.col("x0").cast("double"), F.col("x1").cast("double"), parameters, activation))
