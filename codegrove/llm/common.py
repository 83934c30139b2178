"""What the operators of this subpackage share: tables, stored intermediate results, batches, links to components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by rows and by bytes, and let Python workers import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def batches_of(spark: SparkSession, rows: int) -> AbstractContextManager[None]:
    """Arrow batches of so many rows for the jobs that run inside; afterwards the session has its own limit again."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: Rows of a few numbers up to which they are sent to every executor: some 100 MB as a hash table.
FEW_ROWS = 1_000_000


def few(rows: DataFrame) -> DataFrame:
    """rows (stored, a few numbers each) to be broadcast if they are at most FEW_ROWS, else as they are, to be shuffled."""
    return F.broadcast(rows) if rows.count() <= FEW_ROWS else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where the session names none and all runs on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="codegrove-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, and survives lost executors.

    What was shuffled for it goes with the end of the write, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codegrove/{name}-{uuid.uuid4().hex}"
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Remove a table of stored() that nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and root of all links (a, b) of a task: each takes the smaller root of its ends, over and over, until none changes."""
    read = [(np.asarray(x.column(0)), np.asarray(x.column(1))) for x in batches]
    if not read:
        return
    ends = np.stack([np.concatenate(x) for x in zip(*read, strict=True)])
    nodes, at = np.unique(ends, return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        for x in (a, b, before[a], before[b]):
            np.minimum.at(root, x, low)
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        if (root == before).all():
            break
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b: long), as (node, root): root is the smallest node reachable.

    Up to FEW_ROWS links are united in one task, as a few numbers each. More take turns of a large-star and a small-star step until
    they no longer change. Each step is two aggregations and joins on the node, holds one row per link, and is written to the shared
    folder; the engine splits what hubs send to one task. Nodes without links are absent.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    if edges.count() <= FEW_ROWS:
        prepare(links.sparkSession)
        out = stored(edges.coalesce(1).mapInArrow(_united, "node long, root long"), "roots")
        forget(edges)
        return out
    for _ in range(rounds):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(low, "a")
        small = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after = stored(small.where("a > b").distinct(), "links")
        same = after.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first() == edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        forget(edges)
        edges = after
        if same:
            break
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    leaf = edges.groupBy("a").agg(F.min("b").alias("root"))
    return leaf.select(F.col("a").alias("node"), "root").unionByName(leaf.select(F.col("root").alias("node"), "root").distinct())
