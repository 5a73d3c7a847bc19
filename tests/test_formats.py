"""Readers and writers: round trips and refusals."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from lumenframe.operators import naive_bayes
from lumenframe.operators import report as rep
from lumenframe.sources import readers, writers
from lumenframe.streaming import counts


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(p)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_ratings(spark, tmp_path):
    p = put(tmp_path, "r", "1 2 3.5 99\n4 5 1 98\n")
    assert rows(readers.ratings(spark, p), "item", "user", "rating") == [(1, 2, 3.5), (4, 5, 1.0)]
    assert rows(readers.test_ratings(spark, p), "item", "user", "rating") == [(1, 0, 3.5), (4, 3, 1.0)]
    assert readers.block(readers.ratings(spark, p), "item", 0, 2).count() == 1


def test_matrix(spark, tmp_path):
    p = put(tmp_path, "m", "# num rows=2 num columns=3\n1 2 3\n4 5 6.5\n")
    assert [r.features for r in readers.matrix(spark, p).orderBy("id").collect()] == [[1, 2, 3], [4, 5, 6.5]]
    with pytest.raises(ValueError):
        readers.matrix(spark, put(tmp_path, "n", "1 2 3\n"))
    with pytest.raises(PySparkException):
        readers.matrix(spark, put(tmp_path, "o", "# num rows=1 num columns=3\n1 2\n")).collect()


def test_edges_and_ranks(spark, tmp_path):
    nodes, edges = readers.edges(spark, put(tmp_path, "e", "3 2\n0 1 0.5\n2 1 0.25\n"))
    assert nodes.count() == 3 and rows(edges, "dst", "src", "p") == [(0, 1, 0.5), (2, 1, 0.25)]
    out = str(tmp_path / "ranks")
    writers.ranks(spark.createDataFrame([(0, 1.5)], "node int, r double"), out)
    assert spark.read.text(out).first().value == "0\t1.500000"


def test_bayes_files(spark, tmp_path):
    t, sizes, classes = readers.categories(spark, put(tmp_path, "c", "3 1 2\n2\n0 0\n0 1\n1 1\n"))
    assert (sizes, classes) == ([2], 2) and rows(t, "class", "a0") == [(0, 0), (0, 1), (1, 1)]
    assert rows(readers.unlabelled(spark, put(tmp_path, "u", "2\n0\n1\n"), 1), "a0") == [(0,), (1,)]
    model = naive_bayes.train(t, "class", ["a0"], sizes)
    full, text = str(tmp_path / "model"), str(tmp_path / "text")
    writers.bayes_model(model, full)
    assert rows(writers.read_bayes_model(spark, full)[1], "attr", "val", "class", "p") == rows(model[1], "attr", "val", "class", "p")
    writers.bayes_model_text(model, text)
    prior, cond = readers.bayes_model(spark, text)
    assert rows(prior, "class", "p") == [(0, 0.6), (1, 0.4)]
    assert rows(cond, "attr", "val", "class", "p") == rows(naive_bayes.rounded(model)[1], "attr", "val", "class", "p")
    writers.predictions(spark.createDataFrame([(0, 1)], "id int, class int"), str(tmp_path / "pred"))
    assert spark.read.text(str(tmp_path / "pred")).first().value == "0 1"


def test_sparse_rows(spark, tmp_path):
    ok = readers.sparse(spark, put(tmp_path, "s", "+1 1:1 3:2.5\n-1 2:1\n1\n"))
    assert rows(ok, "y", "idx", "val") == [(-1.0, [2], [1.0]), (1.0, [], []), (1.0, [1, 3], [1.0, 2.5])]
    for bad in ("1 3:1 2:1\n", "1 1:x\n", "x 1:1\n", "1 1:1\n\n1 1:1\n", "1 0:1\n", "1 1\n"):
        with pytest.raises(PySparkException):
            readers.sparse(spark, put(tmp_path, "bad", bad)).collect()


def test_integers(spark, tmp_path):
    p = put(tmp_path, "i", "4\n3 -1\n3\n0 77\n")
    assert [r.v for r in readers.integers(spark, p).orderBy("at").collect()] in ([3, -1, 3, 0], [-1, 3, 3, 0])


def test_binary_examples(spark, tmp_path):
    x = np.array([[1, 2, 3], [4, 5, 6.5]], np.float32)
    p = put(tmp_path, "b.0", writers.examples_bytes(x, 2))
    assert rows(readers.examples(spark, p, 2, 1), "id", "x0", "x1", "y0") == [(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.5)]
    for bad in (writers.examples_bytes(x, 1), writers.examples_bytes(x, 2)[:-4]):
        with pytest.raises(PySparkException):
            readers.examples(spark, put(tmp_path, "bad.0", bad), 2, 1).collect()
    q = put(tmp_path, "p", writers.parameters_bytes([1.5, -2.0]))
    assert readers.parameters(spark, q, 2) == [1.5, -2.0]
    with pytest.raises(ValueError):
        readers.parameters(spark, q, 3)


def test_small_sinks(spark, tmp_path):
    writers.parameters(spark, [0.5], str(tmp_path / "par"))
    assert spark.read.parquet(str(tmp_path / "par")).first().parameters == [0.5]
    for i in range(2):
        writers.append_log(spark, {"seconds": float(i)}, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    assert rows(writers.count_zeros(spark.createDataFrame([(0, 1), (0, 0)], "a int, b int"), ["a", "b"]), "column", "n_zero") == [("a", 2), ("b", 1)]


def test_report_files(spark, tmp_path):
    lines = readers.report_lines(spark, put(tmp_path, "r.csv", "BRANCHES,5\nCPI-Rate,2\n"))
    assert rows(rep.split_line(lines), "name", "value") == [("BRANCHES", 5.0), ("CPI-Rate", 2.0)]
    p = put(tmp_path, "w.csv", "Event,Code Model,Bench,61,122,183,244\nBRANCHES,omp,km,1,2,3,4\n")
    wide = readers.report_csv(spark, p)
    assert rows(rep.unpivot(wide), "threads", "value") == [(61, 1.0), (122, 2.0), (183, 3.0), (244, 4.0)]
    out = str(tmp_path / "by")
    rep.write_by_event(wide, out)
    rep.write_by_event(wide, out)
    assert spark.read.option("header", True).csv(out).where("event = 'BRANCHES'").count() == 2


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    t = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "class int, a0 int")
    t.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    q = counts.stream_counts(stream, "class", ["a0"]).writeStream.outputMode("complete").format("memory").queryName("nb").start()
    q.processAllAvailable()
    q.stop()
    prior, cond = counts.model(spark.table("nb"), [2])
    want = naive_bayes.train(t, "class", ["a0"], [2])
    assert rows(prior, "class", "p") == rows(want[0], "class", "p")
    assert rows(cond, "attr", "val", "class", "p") == rows(want[1], "attr", "val", "class", "p")
