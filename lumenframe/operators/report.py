"""The profiling report: from exported (name, value) lines to pivoted tables and derived ratios.

The long form is (event, model, bench, threads, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.counters import COUNTERS, metrics

# The numbers of threads that the report compares.
THREADS = [61, 122, 183, 244]


def first_match(lines: DataFrame, pattern: str, by: str = "file", order: str = "line_no", text: str = "line") -> DataFrame:
    """For each file the first line that matches."""
    w = Window.partitionBy(by).orderBy(order)
    return lines.where(F.col(text).rlike(pattern)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def split_line(lines: DataFrame, text: str = "line") -> DataFrame:
    """lines with name and value of "name,value"; a value that is no number is null."""
    parts = F.split(text, ",", 2)
    return lines.withColumn("name", parts[0]).withColumn("value", F.try_element_at(parts, F.lit(2)).try_cast("double")).drop(text)


def event_names(df: DataFrame, name: str = "event") -> tuple[DataFrame, DataFrame]:
    """(summary rows, counter rows): names with a dash are summary values and get spaces in their place; the others are counters."""
    dashed = F.contains(F.col(name), F.lit("-"))
    return df.where(dashed).withColumn(name, F.regexp_replace(name, "-", " ")), df.where(~dashed)


def tagged(df: DataFrame, **constants: str) -> DataFrame:
    """df behind constant columns."""
    return df.select(*[F.lit(v).alias(k) for k, v in constants.items()], *df.columns)


def pivot(long: DataFrame, threads: list[int] = THREADS) -> DataFrame:
    """(event, model, bench) with a column for each number of threads; null where nothing was measured."""
    return long.groupBy("event", "model", "bench").pivot("threads", threads).agg(F.min("value"))


def unpivot(wide: DataFrame, threads: list[int] = THREADS) -> DataFrame:
    """The long form again, less the nulls."""
    return wide.unpivot(["event", "model", "bench"], [str(t) for t in threads], "threads", "value").withColumn("threads", F.col("threads").cast("int")).where(F.col("value").isNotNull())


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def derived(long: DataFrame) -> DataFrame:
    """(metric, model, bench, threads, value): the derived ratios of each run. A counter that was not exported counts as 0; a ratio without a denominator is null."""
    wide = long.groupBy("model", "bench", "threads").pivot("event", COUNTERS).agg(F.min("value")).fillna(0.0, COUNTERS)
    m = metrics()
    named = wide.select("model", "bench", "threads", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), c.alias("value")) for n, c in m.items()])).alias("x"))
    return named.select("x.metric", "model", "bench", "threads", "x.value")


def write_by_event(wide: DataFrame, path: str, mode: str = "append") -> None:
    """CSV files with a header in a folder for each event."""
    wide.write.mode(mode).option("header", True).partitionBy("event").csv(path)


def pipeline(lines: DataFrame, threads: list[int] = THREADS) -> DataFrame:
    """From (file, line_no, line, model, bench, threads) to the pivoted table of counters, summary values and derived ratios.

    Of each file and name the first line counts.
    """
    named = split_line(lines)
    w = Window.partitionBy("file", "name").orderBy("line_no")
    long = named.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(F.col("name").alias("event"), "model", "bench", "threads", "value")
    summary, counters = event_names(long)
    ratios = derived(counters).withColumnRenamed("metric", "event")
    return pivot(union([summary, counters, ratios.select("event", "model", "bench", "threads", "value")]), threads)
