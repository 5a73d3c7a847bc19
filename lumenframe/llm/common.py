"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.store import folder, ship

#: Rows of a batch are handed on in slices of about so many characters.
SLICE_CHARS = 8_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends here, and a lost executor costs no more than a reread."""
    path = folder(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df less the columns of these names, whatever their case and however many there are."""
    low = {n.lower() for n in names}
    kept = [c for c in df.columns if c.lower() not in low]
    return df if len(kept) == len(df.columns) else df.select(*[F.col(f"`{c}`") for c in kept])


def unlike(name: str, others: list[str]) -> str:
    """name, with underscores before it until it is none of the others, whatever their case."""
    low = {x.lower() for x in others}
    while name.lower() in low:
        name = "_" + name
    return name


def unused(df: DataFrame, name: str) -> str:
    """name, or one like it that no column of df has."""
    return unlike(name, df.columns)


def add_columns(df: DataFrame, text: str, fields: T.StructType, make: Callable[[], Callable[[list], dict[str, list]]], drop: tuple[str, ...] = ()) -> DataFrame:
    """df with columns computed from its text column, in one pass and without a shuffle.

    ``make()`` runs once in each task and returns a function from a list of texts (None
    for null) to a list of values for each of ``fields``. Input columns with a name of
    ``fields`` or ``drop`` are replaced or left out; all others pass through as they are.
    """
    low = {n.lower() for n in (*fields.names, *drop)}
    kept = [f for f in df.schema.fields if f.name.lower() not in low]
    schema = T.StructType([*kept, *fields])
    arrow, new = to_arrow_schema(schema), to_arrow_schema(fields)
    n_kept = len(kept)
    at = next((i for i, f in enumerate(kept) if f.name == text), n_kept)  # the text is sent once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch, at):
                out = f(part.column(at).to_pylist())
                cols = [c if c.type == x.type else c.cast(x.type) for c, x in zip(part.columns[:n_kept], arrow)]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(out[x.name], x.type) for x in new)], schema=arrow)

    sent = [F.col(f"`{f.name}`") for f in kept]
    if at == n_kept:
        sent.append(F.col(f"`{text}`").alias("\x00text"))  # no input column clashes with it
    return df.select(*sent).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about SLICE_CHARS bytes of this column, one row at least."""
    if not batch.num_rows:
        return
    each = max(1, int(SLICE_CHARS * batch.num_rows / max(1, batch.column(column).get_total_buffer_size())))
    for at in range(0, batch.num_rows, each):
        yield batch.slice(at, each)


def bounded_sample(df: DataFrame, stratum: str, order: str, most: int) -> DataFrame:
    """At most ``most`` rows of each stratum: those with the smallest hash of ``order``.

    Strata are counted first, and rows whose hash cannot be among the smallest are dropped
    before the window, so it sorts about 4 x most rows of a stratum however large that is.
    Null strata are left out.
    """
    spark = df.sparkSession
    df = df.where(F.col(stratum).isNotNull()).withColumn("_h", F.pmod(F.xxhash64(order), F.lit(1 << 30)))
    counts = df.groupBy(stratum).count().limit(1001).collect()  # strata are few: languages, labels
    if len(counts) > 1000:
        raise ValueError(f"more than 1000 values of {stratum}")
    if not counts:
        return df.drop("_h")
    limits = spark.createDataFrame([(r[0], int(min(1.0, (4 * most + 100) / r[1]) * (1 << 30))) for r in counts], T.StructType([T.StructField("_s", df.schema[stratum].dataType), T.StructField("_most", T.LongType())]))
    near = df.join(F.broadcast(limits), F.col(stratum) == F.col("_s")).where(F.col("_h") <= F.col("_most")).drop("_s", "_most")
    return near.withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy("_h", order))).where(F.col("_n") <= most).drop("_n", "_h")


def remainder(column: str, n: int) -> F.Column:
    """crc32 of an id as text, modulo n; null ids have the remainder of the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


#: Types that fields() knows.
KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "float": T.FloatType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType(), "longs": T.ArrayType(T.LongType()), "strings": T.ArrayType(T.StringType())}


def fields(spec: str) -> T.StructType:
    """The type of columns given as "name kind, name kind"; unlike fromDDL it needs no session, so tasks can use it."""
    return T.StructType([T.StructField(n, KINDS[k]) for n, k in (x.split() for x in spec.split(","))])
