"""Every query of the catalogue against its SQL."""

import duckdb
import numpy as np
import pytest

from lumenframe.plans import catalog, files, inputs, oracles

QUERIES, SQL = catalog.QUERIES | files.QUERIES, oracles.SQL | files.SQL

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def same(v):
    return (0.0 if v == 0 else float(f"{v:.9g}")) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(same(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(same(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


def test_the_rest_has_rows(spark, sf):
    """Iterative results without SQL: clusters are final, coefficients are in the box."""
    k = catalog.kmeans_fit(spark, sf).collect()
    assert len({r.id for r in k}) == len(k) == 500 and {r.cluster for r in k} <= set(range(10))
    a = catalog.svm_train(spark, sf).collect()
    assert all(-1e-9 <= r.alpha <= 1 + 1e-9 for r in a) and abs(sum(r.alpha * r.y for r in a)) < 0.05


@pytest.mark.parametrize("linear", [True, False])
def test_fitted_parameters_have_their_loss(spark, sf, linear):
    """The loss is computed again from the returned parameters in plain numpy, and is far below the start's."""
    name = "linear" if linear else "elliott"
    rows = catalog.QUERIES[f"ae_fit_{name}"](spark, sf).collect()
    p = np.array([r.value for r in sorted((r for r in rows if r.name == "parameter"), key=lambda r: r.place)])
    start, loss = (next(r.value for r in rows if r.name == n) for n in ("start_loss", "loss"))
    x = np.array([(r.x0, r.x1) for r in catalog.fit_examples(spark, sf, linear).collect()])
    g = (lambda z: z) if linear else (lambda z: z / (1 + np.abs(z)))
    h = g(p[:10] + x[:, :1] * p[10:20] + x[:, 1:] * p[20:30])
    code = p[30] + h @ p[31:41]
    h = g(p[41:51] + code[:, None] * p[51:61])
    out = np.stack([p[61] + h @ p[62:72], p[72] + h @ p[73:83]], axis=1)
    assert len(p) == 83 and loss < 0.8 * start
    e = np.square(out - x).sum(1)  # an example's error, which the loss squares again, as the SQL of ae_loss has it
    assert np.sqrt((e * e).sum()) == pytest.approx(loss, rel=1e-6)


def test_stored_ratings_are_split_alike(spark, sf):
    """Queries that read the ratings several times join them once: what they read has no join left, and the same rows."""
    for stored, plain in zip(inputs.stored_split(spark, sf), inputs.split_ratings(spark, sf)):
        assert "Join" not in stored._jdf.queryExecution().toString()
        assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, plain.collect()))


def test_sparse_products_cover_all_rows(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], np.float32).astype(np.float64)
    x[np.abs(x) <= 0.1] = 0
    want = x @ x.T
    common = (x != 0).astype(int) @ (x != 0).astype(int).T
    at = {r.vec_id: i for i, r in enumerate(rows)}
    got = catalog.QUERIES["svm_sparse_all"](spark, sf).collect()
    i, j = np.array([(at[r.a_id], at[r.b_id]) for r in got]).T
    assert len(got) == (common > 0).sum() and (common[i, j] > 0).all() and len(set(zip(i, j))) == len(got)
    assert np.abs(np.array([r.dot for r in got]) - want[i, j]).max() < 1e-6


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
