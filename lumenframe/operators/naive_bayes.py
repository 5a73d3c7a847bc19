"""Categorical naive Bayes with Laplace smoothing.

Training counts classes and (attribute, value, class) once, in partial sums before the shuffle.
The model is two tables: prior(class, p) and cond(attr, val, class, p) over the full grid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARGIN = 1e-6


def class_counts(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def attribute_counts(rows: DataFrame, label: str, attrs: list[str]) -> DataFrame:
    """(attr, val, class, n): all attributes in one pass."""
    long = rows.select(F.col(label).alias("class"), F.posexplode(F.array(*[F.col(a).cast("int") for a in attrs])).alias("attr", "val"))
    return long.groupBy("attr", "val", "class").agg(F.count(F.lit(1)).alias("n"))


def priors(classes: DataFrame) -> DataFrame:
    """(n_c + 1) / (N + C) for each class."""
    n, c = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    return classes.select("class", ((F.col("n") + 1) / F.lit(float(n + c or 1))).alias("p"))


def conditionals(classes: DataFrame, counts: DataFrame, cardinalities: list[int] | None = None) -> DataFrame:
    """(n_avc + 1) / (n_c + V_a) for every value below the attribute's cardinality and every class, also where nothing was seen.

    The grid is as large as the model. Cardinalities default to the largest value plus one.
    """
    spark = classes.sparkSession
    if cardinalities is None:
        sizes = counts.groupBy("attr").agg((F.max("val") + 1).alias("v"))
    else:
        sizes = spark.createDataFrame([(i, v) for i, v in enumerate(cardinalities)], "attr int, v int")
    own = classes.agg(F.collect_list(F.struct("class", F.col("n").alias("n_c"))).alias("cs"))  # a model has few classes
    values = sizes.select("attr", "v", F.explode(F.sequence(F.lit(0), F.col("v") - 1)).alias("val"))
    grid = values.withColumn("_k", F.lit(1)).join(own.withColumn("_k", F.lit(1)), "_k").select("attr", "v", "val", F.explode("cs").alias("c")).select("attr", "v", "val", "c.class", "c.n_c")
    return grid.join(counts, ["attr", "val", "class"], "left").select("attr", "val", "class", ((F.coalesce("n", F.lit(0)) + 1) / (F.col("n_c") + F.col("v"))).alias("p"))


def train(rows: DataFrame, label: str, attrs: list[str], cardinalities: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    classes = class_counts(rows, label)
    return priors(classes), conditionals(classes, attribute_counts(rows, label, attrs), cardinalities)


def rounded(model: tuple[DataFrame, DataFrame], digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """The model as its text format keeps it."""
    return tuple(t.withColumn("p", F.round("p", digits)) for t in model)


def classify(rows: DataFrame, key: str, attrs: list[str], model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(key, class): the classes in order, a later one only if its log-likelihood is more than MARGIN better. p = 0 counts as minus infinity.

    The likelihoods of a row need no shuffle: the model becomes a map from value to the logarithms
    of its classes for each attribute, which is as large as the model and goes along with the tasks.
    A value that training has not seen has no likelihood; its row gets a null class.
    """
    prior, cond = model
    log = F.when(F.col("p") > 0, F.log("p")).otherwise(F.lit(float("-inf")))
    first = [(r["class"], r.lp) for r in prior.select("class", log.alias("lp")).orderBy("class").collect()]
    order = [c for c, _ in first]
    tables: dict[int, dict[int, dict]] = {}
    for r in cond.select("attr", "val", "class", log.alias("lp")).collect():
        tables.setdefault(r.attr, {}).setdefault(r.val, {})[r["class"]] = r.lp
    scores = []
    for c, lp in first:
        terms = []
        for i, a in enumerate(attrs):
            pairs = [x for v, by in sorted(tables.get(i, {}).items()) for x in (F.lit(v), F.lit(float(by[c])))]
            terms.append(F.element_at(F.create_map(*pairs), F.col(a).cast("int")) if pairs else F.lit(None).cast("double"))
        scores.append(reduce(lambda s, t: s + t, terms, F.lit(float(lp))))
    if not order:
        return rows.select(key, F.lit(None).cast("int").alias("class"))
    named = F.array(*[F.struct(F.lit(c).alias("class"), s.alias("lp")) for c, s in zip(order, scores)])
    best = F.aggregate(F.slice(named, 2, max(0, len(order) - 1)), named[0], lambda b, x: F.when(x["lp"] > b["lp"] + MARGIN, x).otherwise(b))
    return rows.select(key, F.when(scores[0].isNotNull(), best["class"]).alias("class"))


def confusion(truth: DataFrame, predicted: DataFrame, key: str, label: str) -> DataFrame:
    return truth.select(key, F.col(label).alias("actual")).join(predicted.withColumnRenamed("class", "predicted"), key).groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
