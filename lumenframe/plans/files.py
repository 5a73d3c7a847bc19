"""Queries through the file formats: each writes a test table in a format, reads the file back and goes on from there.

Files with a header are one file, as the format has them; the others are folders of any number of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import naive_bayes, pagerank, report, sorting
from ..sources import readers, writers
from . import catalog, inputs, oracles
from .store import folder

BLOCKS, BLOCK_ITEMS = 4, 250  # ranges of items, the last without an upper end
RANGES = 7


def _lines(s, rows: DataFrame, line, name: str, head: list[str] | None = None) -> str:
    """Writes rows as text lines, behind the header's lines in one file if there is a header."""
    path = folder(s, name)
    out = rows.select(line.alias("value"))
    if head is not None:
        top = s.createDataFrame([(i, v) for i, v in enumerate(head)], "at int, value string")
        out = top.unionByName(out.withColumn("at", F.lit(len(head)))).coalesce(1).sortWithinPartitions("at").select("value")
    out.write.text(path)
    return path


def _joined(*columns):
    return F.concat_ws(" ", *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns])


def _item_first(s, d) -> DataFrame:
    path = _lines(s, inputs.ratings(s, d), _joined("item", "user", F.col("rating").cast("int").cast("string"), F.lit("978300760")), "item-first")
    return readers.ratings(s, path).withColumn("rating", F.col("rating").cast("double"))


def file_ratings(s, d):
    """Item-first rating lines; the time is dropped."""
    return _item_first(s, d).select("item", "user", "rating")


def file_rating_blocks(s, d):
    """All blocks of items, each read as a range of keys."""
    rows = _item_first(s, d)
    return report.union([readers.block(rows, "item", i * BLOCK_ITEMS, BLOCK_ITEMS if i < BLOCKS - 1 else 2**31 - 1 - i * BLOCK_ITEMS).select(F.lit(i).alias("block"), "item", "user", "rating") for i in range(BLOCKS)])


def file_test_ratings(s, d):
    """User-first test lines, with ids from 0."""
    path = _lines(s, inputs.split_ratings(s, d)[1], _joined("user", "item", F.col("rating").cast("int").cast("string"), F.lit("978300760")), "user-first")
    return readers.test_ratings(s, path).select("item", "user", F.col("rating").cast("double").alias("rating"))


def file_matrix(s, d):
    """The embeddings as a dense matrix with its header: the first and last number and the sum of each row."""
    p = inputs.points(s, d)
    n = p.count()
    path = _lines(s, p, F.concat_ws(" ", F.transform("features", lambda x: x.cast("double").cast("string"))), "matrix", [f"# num rows={n} num columns=64"])
    f = F.col("features")
    return readers.matrix(s, path).select(F.round(f[0], 6).alias("first"), F.round(f[63], 6).alias("last"), F.round(vectors.total(f), 4).alias("total"))


def file_edges(s, d):
    """The graph as an edge list, read back and ranked for one step."""
    nodes, edges = inputs.graph(s, d)
    dense = sorting.with_position(nodes, [F.col("node").asc()], "at").select("node", F.col("at").cast("int").alias("at"))
    e = edges.join(dense.select(F.col("node").alias("dst"), F.col("at").alias("i")), "dst").join(dense.select(F.col("node").alias("src"), F.col("at").alias("j")), "src")
    path = _lines(s, e, _joined("i", "j", "p"), "edges", [f"{dense.count()} {e.count()}"])
    nodes, edges = readers.edges(s, path)
    return pagerank.step(edges.select("dst", "src", "p"), nodes.withColumn("r", F.lit(1.0))).select("node", F.round("r", 6).alias("r"))


def file_ranks(s, d):
    """The ranks after one step through their text file."""
    nodes, edges = inputs.graph(s, d)
    path = folder(s, "ranks")
    writers.ranks(pagerank.step(edges, nodes.withColumn("r", F.lit(1.0))), path)
    return s.read.schema("node long, r double").option("sep", "\t").csv(path)


def _training_file(s, d):
    train = catalog._nb(s, d)[0]
    path = _lines(s, train, _joined("class", *inputs.ATTRS), "categories", [f"{train.count()} 4 3", " ".join(map(str, inputs.CARDINALITIES))])
    return readers.categories(s, path)


def file_nb_counts(s, d):
    """Counts of attribute values from the training file."""
    rows, _, _ = _training_file(s, d)
    return naive_bayes.attribute_counts(rows, "class", inputs.ATTRS)


def _model_file(s, d):
    rows, sizes, _ = _training_file(s, d)
    path = folder(s, "model")
    writers.bayes_model_text(naive_bayes.train(rows, "class", inputs.ATTRS, sizes), path)
    return readers.bayes_model(s, path)


def file_nb_prior(s, d):
    """The classes of the model's text file."""
    return _model_file(s, d)[0].withColumn("p", F.round("p", 6))


def file_nb_model(s, d):
    """The attributes of the model's text file."""
    return _model_file(s, d)[1].withColumn("p", F.round("p", 6))


def file_nb_predictions(s, d):
    """How many test rows get each class: training file, model file, unlabelled file and predictions file, one after the other."""
    test = catalog._nb(s, d)[1]
    path = _lines(s, test, _joined(*inputs.ATTRS), "unlabelled", [str(test.count())])
    out = folder(s, "predictions")
    writers.predictions(naive_bayes.classify(readers.unlabelled(s, path, 4), "id", inputs.ATTRS, catalog._nb_model(s, d)), out)
    return s.read.schema("id long, class int").option("sep", " ").csv(out).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def file_sparse(s, d):
    """Labelled sparse lines: the label, the number of entries, the last index and the sum."""
    kept = F.filter(F.transform("features", lambda x, i: F.struct((i + 1).alias("i"), x.cast("double").alias("v"))), lambda e: F.abs(e["v"]) > 0.1)
    line = F.concat_ws(" ", F.when(F.col("y") > 0, "+1").otherwise("-1"), F.transform(kept, lambda e: F.concat_ws(":", e["i"].cast("string"), e["v"].cast("string"))))
    rows = readers.sparse(s, _lines(s, inputs.labelled(s, d), line, "sparse"))
    return rows.select("y", F.size("idx").alias("n"), F.array_max("idx").alias("last"), F.round(vectors.total(F.col("val")), 4).alias("total"))


def file_integers(s, d):
    """The prices in cents behind their number, sorted."""
    v = inputs.cents(s, d)
    path = _lines(s, v, F.col("v").cast("string"), "integers", [str(v.count())])
    return sorting.sort_values(readers.integers(s, path), "v")


def file_report(s, d):
    """The whole report: exported lines, the pivoted table with its ratios, CSV files for each event, read again."""
    runs = inputs.counters(s, d)
    lines = runs.select(F.concat_ws("-", "model", "bench", F.col("threads").cast("string")).alias("file"), F.xxhash64("event").alias("line_no"), F.concat_ws(",", "event", F.col("value").cast("decimal(20,2)").cast("string")).alias("line"), "model", "bench", "threads")
    path = folder(s, "report")
    report.write_by_event(report.pipeline(lines), path)
    back = s.read.option("header", True).csv(path)
    return back.select("event", "model", "bench", *[F.round(F.col(f"`{t}`").cast("double"), 4).alias(f"t{t}") for t in report.THREADS])


def zero_counts(s, d):
    return writers.count_zeros(inputs.read(s, d, "lineitem").select("l_discount", "l_tax"), ["l_discount", "l_tax"])


def row_ranges(s, d):
    """First and last price and the number of rows of each of seven ranges of the sorted prices."""
    out = sorting.row_ranges(inputs.cents(s, d), [F.col("v").asc()], RANGES)
    return out.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("first"), F.max("v").alias("last"))


def kernels_other(s, d):
    """Linear, polynomial and sigmoid kernels of each vector and the one with the next id, the linear one clipped as well."""
    p = inputs.points(s, d).select("id", vectors.doubles(F.col("features")).alias("a"))
    both = p.join(p.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id")
    a, b = F.col("a"), F.col("b")
    linear = vectors.linear_kernel(a, b)
    return both.select("id", F.round(linear, 6).alias("linear"), F.round(vectors.polynomial_kernel(a, b, 0.5, 1.0, 3.0), 6).alias("poly"), F.round(vectors.sigmoid_kernel(a, b, 0.5, -0.1), 6).alias("sigmoid"), F.round(vectors.clip(linear, -0.1, 0.1), 6).alias("clipped"))


def report_tagged(s, d):
    """Events behind constant columns, with block number and place."""
    block, place = vectors.block_of(F.col("event_id"), 100)
    rows = inputs.read(s, d, "events").select("event_id", block.alias("block"), place.cast("long").alias("place"))
    return report.tagged(rows, model="events", bench="all")


QUERIES = {
    f.__name__: f
    for f in (
        file_ratings, file_rating_blocks, file_test_ratings, file_matrix, file_edges, file_ranks, file_nb_counts, file_nb_prior, file_nb_model,
        file_nb_predictions, file_sparse, file_integers, file_report, zero_counts, row_ranges, kernels_other, report_tagged,
    )
}

_DOT = "list_sum(list_transform(range(1, len(a.f) + 1), lambda i: a.f[i] * b.f[i]))"
_STEP = oracles._STEP.format(r="r0")
_TABLE = ", ".join(f"max(CASE WHEN threads = {t} THEN value END) AS t{t}" for t in report.THREADS)
SQL = {
    "file_ratings": oracles.SQL["cf_ratings"],
    "file_rating_blocks": f'WITH {oracles._R} SELECT CAST(least(item // {BLOCK_ITEMS}, {BLOCKS - 1}) AS INT) AS block, item, "user", rating FROM ra',
    "file_test_ratings": f'WITH {oracles._R} SELECT item - 1 AS item, "user" - 1 AS "user", rating FROM te',
    "file_matrix": "SELECT round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[64] AS DOUBLE), 6) AS last, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings",
    "file_edges": f"WITH {oracles._GRAPH}, r0 AS (SELECT s_suppkey AS node, 1e0 AS r FROM supplier), r1 AS ({_STEP}) SELECT CAST(row_number() OVER (ORDER BY node) - 1 AS INT) AS node, round(r, 6) AS r FROM r1",
    "file_ranks": oracles.SQL["pagerank_step"],
    "file_nb_counts": oracles.SQL["nb_attr_counts"],
    "file_nb_prior": oracles.SQL["nb_prior"],
    "file_nb_model": oracles.SQL["nb_model_rounded"],
    "file_nb_predictions": f"WITH {oracles._NB}, {oracles._NB_CLASSIFY} SELECT cls.class, count(*) AS n FROM te JOIN cls ON cls.id = te.id GROUP BY ALL",
    "file_sparse": f"""WITH {oracles._Y}, k AS (SELECT y, list_filter(list_transform(range(1, len(f) + 1), lambda i: {{'i': i, 'v': f[i]}}), lambda e: abs(e.v) > CAST(0.1 AS DOUBLE)) AS p FROM y)
SELECT y, CAST(len(p) AS INT) AS n, CAST(list_max(list_transform(p, lambda e: e.i)) AS INT) AS last, round(list_sum(list_transform(p, lambda e: e.v)), 4) AS total FROM k""",
    "file_integers": oracles.SQL["sort_values"],
    "file_report": f"WITH dr AS ({oracles._metrics()}), cn AS ({oracles._metrics().split(', wd AS')[0]} SELECT event, model, bench, threads, value FROM ln), al AS (SELECT metric AS event, model, bench, threads, value FROM dr UNION ALL SELECT * FROM cn) SELECT event, model, bench, {_TABLE} FROM al GROUP BY event, model, bench",
    "zero_counts": "SELECT 'l_discount' AS \"column\", count(*) FILTER (l_discount = 0) AS n_zero FROM lineitem UNION ALL SELECT 'l_tax', count(*) FILTER (l_tax = 0) FROM lineitem",
    "row_ranges": f"WITH {oracles._V}, p AS (SELECT v, ntile({RANGES}) OVER (ORDER BY v) - 1 AS part FROM v) SELECT CAST(part AS INT) AS part, count(*) AS n, min(v) AS first, max(v) AS last FROM p GROUP BY part",
    "kernels_other": f"""WITH y AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS f FROM embeddings), k AS (SELECT a.id, {_DOT} AS x FROM y a JOIN y b ON b.id = a.id + 1)
SELECT id, round(x, 6) AS linear, round(pow(0.5e0 * x + 1, 3), 6) AS poly, round(tanh(0.5e0 * x - 0.1e0), 6) AS sigmoid, round(greatest(least(x, 0.1e0), -0.1e0), 6) AS clipped FROM k""",
    "report_tagged": "SELECT 'events' AS model, 'all' AS bench, event_id, event_id // 100 AS block, event_id % 100 AS place FROM events",
}
