"""Writers of the text and binary formats; all of them write folders through Spark."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranks(df: DataFrame, path: str) -> None:
    """node<TAB>rank with six decimals."""
    df.select("node", F.format_string("%f", "r").alias("r")).write.option("sep", "\t").csv(path)


def bayes_model(model: tuple[DataFrame, DataFrame], path: str) -> None:
    """The two tables in full precision."""
    for name, t in zip(("prior", "cond"), model):
        t.write.parquet(f"{path}/{name}")


def read_bayes_model(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/prior"), spark.read.parquet(f"{path}/cond")


def bayes_model_text(model: tuple[DataFrame, DataFrame], path: str) -> None:
    """The text format: sizes, cardinalities, priors, then a line of each attribute's value with a probability for each class, all with six decimals. One small file."""
    prior, cond = model
    p = [r.p for r in prior.orderBy("class").collect()]
    table: dict[tuple[int, int], list[float]] = {}
    for r in cond.orderBy("attr", "val", "class").collect():
        table.setdefault((r.attr, r.val), []).append(r.p)
    n = max((a for a, _ in table), default=-1) + 1
    sizes = [sum(a == i for a, _ in table) for i in range(n)]
    lines = [f"{n} {len(p)}", " ".join(map(str, sizes)), " ".join(f"{x:f}" for x in p), *(" ".join(f"{x:f}" for x in row) for row in table.values())]
    text_lines(prior.sparkSession, lines, path)


def text_lines(spark, lines: list[str], path: str) -> None:
    """A few lines as one text file."""
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)


def predictions(df: DataFrame, path: str, key: str = "id", label: str = "class") -> None:
    """row class."""
    df.select(key, label).write.option("sep", " ").csv(path)


def parameters_bytes(values) -> bytes:
    """A count and 32-bit floats."""
    return struct.pack("<I", len(values)) + np.asarray(values, "<f4").tobytes()


def examples_bytes(x: np.ndarray, n_inputs: int) -> bytes:
    """Three 32-bit integers and the examples as 32-bit floats."""
    return struct.pack("<iii", n_inputs, x.shape[1] - n_inputs, len(x)) + np.asarray(x, "<f4").tobytes()


def parameters(spark, values, path: str) -> None:
    """One row with an array of 32-bit floats."""
    spark.createDataFrame([([float(np.float32(v)) for v in values],)], "parameters array<float>").coalesce(1).write.parquet(path)


def append_log(spark, row: dict, path: str) -> None:
    """A row of metrics behind those that are there."""
    spark.createDataFrame([row]).coalesce(1).write.mode("append").parquet(path)


def count_zeros(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_zero)."""
    return df.agg(*[F.count_if(F.col(c) == 0).alias(c) for c in columns]).unpivot([], columns, "column", "n_zero")
