"""Where intermediate tables live: a folder that every executor sees."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so their Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if spark.conf.get("lumenframe.shipped", "") == sc.applicationId:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="lumenframe-")) / "lumenframe.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    spark.conf.set("lumenframe.shipped", sc.applicationId)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a temporary one on a local master, and an error on a cluster, whose machines would not see it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("lumenframe.store.dir", "")
    if not root:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lumenframe-")
        spark.conf.set("lumenframe.store.dir", root)
    return f"{root.rstrip('/')}/lumenframe/{name}-{uuid.uuid4().hex}"


#: Spark's setting for it, from 4.1 on.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The setting holds for what runs here."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What runs here removes its shuffle files at its end. Without it they stay until the driver happens to collect its garbage, and add up from table to table."""
    with setting(spark, SWEEP, "true"):
        yield


def settle(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again. Its lineage is cut there, its shuffle files go, and a lost executor loses nothing of it."""
    path = folder(df.sparkSession, name)
    with swept(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def iterate(state: DataFrame, step: Callable[[DataFrame], DataFrame], done: Callable[[DataFrame], bool], most: int, name: str = "loop") -> tuple[DataFrame, int]:
    """Applies step until done(new state) or `most` rounds; each state is settled. Returns the last state and the number of rounds."""
    state = settle(state, name)
    for n in range(1, most + 1):
        state = settle(step(state), name)
        if done(state):
            return state, n
    return state, most
