"""Naive Bayes training on a stream: the counts are additive, so they run as one streaming aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import naive_bayes


def stream_counts(rows: DataFrame, label: str, attrs: list[str]) -> DataFrame:
    """(attr, val, class, n) of a stream in update or complete mode; attr -1 and val 0 hold the class counts."""
    long = rows.select(F.col(label).alias("class"), F.posexplode(F.concat(F.array(F.lit(0)), F.array(*[F.col(a).cast("int") for a in attrs]))).alias("attr", "val"))
    return long.groupBy((F.col("attr") - 1).alias("attr"), "val", "class").agg(F.count(F.lit(1)).alias("n"))


def model(counts: DataFrame, cardinalities: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """prior and cond from a table of stream_counts."""
    classes = counts.where("attr = -1").select("class", "n")
    return naive_bayes.priors(classes), naive_bayes.conditionals(classes, counts.where("attr >= 0"), cardinalities)
