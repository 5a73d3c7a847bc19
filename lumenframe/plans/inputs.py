"""The inputs of the catalogue's queries, derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.counters import COUNTERS
from ..operators.report import THREADS
from .store import settle, ship


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers, and an edge between two that occur in one order; weights are shares of the source's edges."""
    together = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s")).distinct()
    pairs = together.withColumnRenamed("s", "src").join(together.withColumnRenamed("s", "dst"), "o").where("src <> dst").select("src", "dst").distinct()
    degree = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node")), pairs.join(degree, "src").select("dst", "src", (1.0 / F.col("n")).alias("p"))


def cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("v"))


ATTRS = ["a0", "a1", "a2", "a3"]
CARDINALITIES = [2, 7, 11, 9]


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class and four small attributes of each line item; id names the combination of attributes."""
    t = read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("class"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("a0"),
        (F.col("l_linenumber") - 1).alias("a1"),
        F.round(F.col("l_discount") * 100).cast("int").alias("a2"),
        F.round(F.col("l_tax") * 100).cast("int").alias("a3"),
    )
    return t.withColumn("id", F.concat_ws("-", *ATTRS))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, user, rating) from what customers ordered of suppliers, in whole numbers."""
    r = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return r.groupBy(F.col("l_suppkey").alias("item"), F.col("o_custkey").alias("user")).agg(F.max(F.ceil(F.col("l_quantity") / 10)).cast("double").alias("rating"))


def split_ratings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Training and test rows."""
    return _split(ratings(spark, sf_dir))


def stored_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same, for queries that read them several times: the ratings are joined once and written."""
    return _split(settle(ratings(spark, sf_dir), "ratings"))


def _split(r: DataFrame) -> tuple[DataFrame, DataFrame]:
    held = F.pmod(31 * F.col("user") + F.col("item"), F.lit(10)) == 0
    return r.where(~held), r.where(held)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") < 5, 1).otherwise(-1).alias("y"), F.col("embedding").alias("features"))


def pairs_of_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first coordinates of the embeddings as examples."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x0"), F.col("embedding")[1].cast("double").alias("x1"), F.when(F.col("label") < 5, 0.9).otherwise(0.1).alias("y0"))


def long_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of event values by kind, user group and hour of four, as measurements for four numbers of threads."""
    t = F.array(*[F.lit(x) for x in THREADS])
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("event"), F.lit("events").alias("model"), F.concat(F.lit("group"), (F.col("user_id") % 3).cast("string")).alias("bench"), F.element_at(t, F.hour("ts") % 4 + 1).alias("threads"), "value")
    return e.groupBy("event", "model", "bench", "threads").agg(F.round(F.sum("value"), 2).alias("value"))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty counters for each return flag, line status and line number of four: (i + 1) x lines + the quantity sum for the i-th."""
    t = F.array(*[F.lit(x) for x in THREADS])
    g = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("bench"), F.element_at(t, F.col("l_linenumber") % 4 + 1).alias("threads")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    return g.select("model", "bench", "threads", "n", "q", F.posexplode(F.array(*[F.lit(c) for c in COUNTERS])).alias("i", "event")).select("event", "model", "bench", "threads", ((F.col("i") + 1) * F.col("n") + F.col("q")).alias("value"))
