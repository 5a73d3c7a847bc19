"""Readers of the text and binary formats. Ids in ratings files are 1-based and stay so unless told."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import ship


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line, at): lines of one file or folder, in an order that follows the file's."""
    return spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("at"))


def _words(line: str = "line") -> F.Column:
    return F.split(line, r"\s+")


def ratings(spark: SparkSession, path: str, order: str = "item", shift: int = 0) -> DataFrame:
    """(item, user, rating) of "item user rating timestamp" lines, or with order="user" of "user item rating timestamp"; the time is dropped. shift is added to both ids."""
    names = ["item", "user"] if order == "item" else ["user", "item"]
    schema = ", ".join(f"{n} int" for n in names) + ", rating float, ts int"
    rows = spark.read.schema(schema).option("sep", " ").option("ignoreTrailingWhiteSpace", True).csv(path)
    return rows.select((F.col("item") + shift).alias("item"), (F.col("user") + shift).alias("user"), "rating")


def test_ratings(spark: SparkSession, path: str) -> DataFrame:
    """User-first lines with 0-based ids."""
    return ratings(spark, path, order="user", shift=-1)


def block(rows: DataFrame, column: str, start: int, size: int) -> DataFrame:
    """The rows whose key lies in a block; the range reaches the scan as a filter."""
    return rows.where((F.col(column) >= start) & (F.col(column) < start + size))


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """(id, features) of a file that begins with "# num rows=R num columns=C". A file without that header, or with rows of another length, is an error."""
    head = spark.read.text(path).where(F.col("value").startswith("#")).limit(1).collect()
    if not head:
        raise ValueError("the header '# num rows=R num columns=C' is missing")
    got = dict(x.split("=") for x in head[0].value.replace("num ", "").replace("#", "").split())
    n = int(got["columns"])
    lines = _numbered(spark, path).where(~F.col("line").startswith("#") & (F.col("line") != ""))
    f = F.transform(_words(), lambda x: x.cast("double"))
    ok = F.assert_true(F.size(f) == n, F.lit(f"a row does not have {n} columns"))
    return lines.select(F.col("at").alias("id"), F.when(ok.isNull(), f).alias("features"))


def _head(spark: SparkSession, path: str, lines: int) -> list[list[int]]:
    return [[int(x) for x in r.value.split()] for r in spark.read.text(path).limit(lines).collect()]


def edges(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a file "N E", then "dst src p" lines; edges (dst, src, p, at) keep their order in at."""
    n = _head(spark, path, 1)[0][0]
    w = _words()
    rows = _numbered(spark, path).where(F.size(w) == 3).select(w[0].cast("int").alias("dst"), w[1].cast("int").alias("src"), w[2].cast("double").alias("p"), "at")
    return spark.range(n).select(F.col("id").cast("int").alias("node")), rows


def categories(spark: SparkSession, path: str) -> tuple[DataFrame, list[int], int]:
    """(rows, cardinalities, classes) of a training file: "rows attributes classes", the cardinalities, then "class a0 a1 ..." lines."""
    (_, n, classes), sizes = _head(spark, path, 2)
    w = _words()
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    rows = lines.where((F.col("at") >= 2) & (F.col("line") != ""))
    return rows.select(F.col("at").alias("id"), w[0].cast("int").alias("class"), *[w[i + 1].cast("int").alias(f"a{i}") for i in range(n)]), sizes, classes


def unlabelled(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(id, a0, a1, ...) of a file with its number of rows first."""
    w = _words()
    return _numbered(spark, path).where((F.col("at") >= 1) & (F.col("line") != "")).select(F.col("at").alias("id"), *[w[i].cast("int").alias(f"a{i}") for i in range(n)])


def bayes_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """prior and cond of a model in its text format, read in full precision."""
    lines = [r.value.split() for r in spark.read.text(path).collect()]  # a model is small
    n, classes = map(int, lines[0])
    sizes = list(map(int, lines[1]))
    prior = [(c, float(x)) for c, x in enumerate(lines[2])]
    cond, at = [], 3
    for a in range(n):
        for v in range(sizes[a]):
            cond += [(a, v, c, float(lines[at][c])) for c in range(classes)]
            at += 1
    return spark.createDataFrame(prior, "class int, p double"), spark.createDataFrame(cond, "attr int, val int, class int, p double")


def sparse(spark: SparkSession, path: str) -> DataFrame:
    """(id, y, idx, val) arrays of "label index:value ..." lines. An empty line, a number that is none or an index that does not increase is an error."""
    w = _words()
    pairs = F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x: F.struct(F.split(x, ":")[0].try_cast("int").alias("i"), F.try_element_at(F.split(x, ":"), F.lit(2)).try_cast("double").alias("v")))
    rows = _numbered(spark, path).select(F.col("at").alias("id"), "line", w[0].try_cast("double").alias("y"), pairs.alias("p"))
    idx, val = F.transform("p", lambda x: x["i"]), F.transform("p", lambda x: x["v"])
    numbers = F.col("y").isNotNull() & F.forall("p", lambda x: x["i"].isNotNull() & x["v"].isNotNull())
    rises = F.forall(F.sequence(F.lit(1), F.size("p")), lambda i: (i < 2) | (F.get(idx, i - 1) > F.get(idx, i - 2))) & F.coalesce(F.get(idx, F.lit(0)) >= 1, F.lit(True))
    bad = F.when(F.col("line") == "", F.raise_error(F.lit("an empty line"))).when(~numbers, F.raise_error(F.concat(F.lit("no number in: "), "line"))).when((F.size("p") > 0) & ~rises, F.raise_error(F.concat(F.lit("indices do not increase in: "), "line")))
    return rows.select("id", F.coalesce(bad.cast("double"), "y").alias("y"), idx.alias("idx"), val.alias("val"))


def integers(spark: SparkSession, path: str) -> DataFrame:
    """(at, v): the first n integers behind the number n, over any number of lines."""
    n = _head(spark, path, 1)[0][0]
    each = _numbered(spark, path).select("at", F.posexplode(F.split("line", r"\s+")).alias("place", "w")).where((F.col("w") != "") & ((F.col("at") > 0) | (F.col("place") > 0)))
    return each.orderBy("at", "place").limit(n).select("at", F.col("w").cast("int").alias("v"))


#: The header of binary examples: numbers of inputs, outputs and examples.
HEADER = "<iii"


def examples(spark: SparkSession, path: str, n_inputs: int, n_outputs: int) -> DataFrame:
    """(file, id, x0.., y0..) of binary files, or a folder of them with one for each rank: three 32-bit integers, then 32-bit floats example by example.

    A header that does not fit, or a file that is too short, is an error.
    """
    ship(spark)
    names = [f"x{i}" for i in range(n_inputs)] + [f"y{i}" for i in range(n_outputs)]
    size = struct.calcsize(HEADER)

    def run(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                i, o, n = struct.unpack_from(HEADER, raw)
                if (i, o) != (n_inputs, n_outputs):
                    raise ValueError(f"{name} has {i} inputs and {o} outputs")
                if len(raw) < size + 4 * n * (i + o):
                    raise ValueError(f"{name} is too short for {n} examples")
                x = np.frombuffer(raw, "<f4", n * (i + o), size).reshape(n, i + o)
                for at in range(0, n, 100_000):
                    some = x[at : at + 100_000]
                    yield pa.RecordBatch.from_pydict({"file": [name] * len(some), "id": np.arange(at, at + len(some))} | {c: some[:, j].copy() for j, c in enumerate(names)})

    schema = "file string, id long, " + ", ".join(f"{c} float" for c in names)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def parameters(spark: SparkSession, path: str, n: int) -> list[float]:
    """The numbers of a binary parameter file; another count is an error."""
    raw = bytes(spark.read.format("binaryFile").load(path).first().content)
    (count,) = struct.unpack_from("<I", raw)
    if count != n or len(raw) < 4 + 4 * n:
        raise ValueError(f"{count} parameters where {n} are expected")
    return np.frombuffer(raw, "<f4", n, 4).astype(float).tolist()


def report_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of exported "name,value" files."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def report_csv(spark: SparkSession, path: str) -> DataFrame:
    """A pivoted report: event, model, bench and a column for each number of threads."""
    return spark.read.option("header", True).csv(path).select(F.col("Event").alias("event"), F.col("Code Model").alias("model"), F.col("Bench").alias("bench"), *[F.col(f"`{t}`").cast("double").alias(t) for t in ("61", "122", "183", "244")])
