"""Total sorting, merging and ranks, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import settle


def with_position(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """df with each row's place, from 0, in the given total order.

    Rows are dealt in ranges and sorted there; a partition's first place is the number of rows
    in those before it, which are a row for each partition. Equal rows get successive places.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = settle(ranged.withColumn("_id", F.monotonically_increasing_id()), "sorted")
    part, place = F.shiftright("_id", 33).cast("int"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return numbered.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + place).drop("_id", "_part", "_before")


def sort_values(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """(pos, column) of all rows."""
    order = F.col(column).asc_nulls_first() if ascending else F.col(column).desc_nulls_last()
    return with_position(df.select(column), [order]).select("pos", column)


def sort_segments(df: DataFrame, column: str, segments: int) -> DataFrame:
    """Rows dealt to segments by their value and sorted within each, ascending in even ones and descending in odd ones: (segment, place, column)."""
    seg = F.pmod(F.col(column), F.lit(segments))
    key = F.when(seg % 2 == 0, F.col(column)).otherwise(-F.col(column))
    w = Window.partitionBy("segment").orderBy("_key")
    return df.select(column, seg.alias("segment"), key.alias("_key")).withColumn("place", F.row_number().over(w) - 1).select("segment", "place", column)


def merge_runs(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Two runs merged: (pos, column, run), rows of the first run before equal ones of the second."""
    both = a.select(column, F.lit(0).alias("run")).unionByName(b.select(column, F.lit(1).alias("run")))
    return with_position(both, [F.col(column).asc(), F.col("run").asc()]).select("pos", column, "run")


def co_rank(a: DataFrame, b: DataFrame, column: str, places: list[int]) -> DataFrame:
    """For each place of the merged output, how many rows before it come from each run: (place, from_a, from_b). These are the cuts that give equal work to mergers."""
    merged = merge_runs(a, b, column)
    aggs = [F.struct(F.lit(p).alias("place"), F.count_if((F.col("pos") < p) & (F.col("run") == 0)).alias("from_a"), F.count_if((F.col("pos") < p) & (F.col("run") == 1)).alias("from_b")).alias(f"p{i}") for i, p in enumerate(places)]
    one = merged.agg(*aggs)
    return one.select(F.explode(F.array(*[f"p{i}" for i in range(len(places))])).alias("x")).select(F.col("x.place").cast("long").alias("place"), "x.from_a", "x.from_b")


def neighbours(df: DataFrame, order: str, column: str) -> DataFrame:
    """(order, column, previous): each row with the one before it in the order of an integer without gaps or repeats, by a join instead of one window."""
    left = df.select(order, column)
    right = df.select((F.col(order) + 1).alias(order), F.col(column).alias("previous"))
    return left.join(right, order, "left")


def is_sorted(df: DataFrame, order: str, column: str) -> DataFrame:
    """(n_rows, n_descents)."""
    return neighbours(df, order, column).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("previous") > F.col(column)).alias("n_descents"))


def trend(df: DataFrame, order: str, column: str) -> DataFrame:
    """(order, sign of the difference from the row before): 0 for the first."""
    return neighbours(df, order, column).select(order, F.coalesce(F.signum(F.col(column) - F.col("previous")).cast("int"), F.lit(0)).alias("trend"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n_differ): rows, with repeats, that one side has and the other has not."""
    cols = a.columns
    both = a.withColumn("_s", F.lit(1)).unionByName(b.select(*cols).withColumn("_s", F.lit(-1)))
    return both.groupBy(*cols).agg(F.sum("_s").alias("d")).agg(F.coalesce(F.sum(F.abs("d")), F.lit(0)).alias("n_differ"))


def running_min(df: DataFrame, order: str, column: str, partition: str) -> DataFrame:
    w = Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(partition, order, column, F.min(column).over(w).alias("least"))


def row_ranges(df: DataFrame, order: list[Column], parts: int) -> DataFrame:
    """df with `part`: consecutive rows in `parts` ranges whose sizes differ by one at most, the larger ones first."""
    numbered = with_position(df, order, "_pos")
    n = df.count()
    size, rest = divmod(n, parts)
    wide = rest * (size + 1)
    part = F.when(F.col("_pos") < wide, F.floor(F.col("_pos") / (size + 1))).otherwise(rest + F.floor((F.col("_pos") - wide) / max(1, size)))
    return numbered.withColumn("part", part.cast("int")).drop("_pos")
