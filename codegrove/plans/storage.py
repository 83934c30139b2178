"""Stored intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers up to which they are sent to every executor.
FEW_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where the session names none and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="codegrove-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codegrove/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(rows: DataFrame) -> DataFrame:
    """rows (stored, a few numbers each) to be broadcast if they are at most FEW_ROWS, else as they are, to be shuffled."""
    return F.broadcast(rows) if rows.count() <= FEW_ROWS else rows


def large(rows: DataFrame) -> DataFrame:
    """rows that grow with the input, for a join that sorts and may spill. Sizes of files, compressed and with columns left out, say
    too little of the memory that rows take, so that the optimizer would send millions of them through the driver."""
    return rows.hint("merge")


def members_of(ids: DataFrame) -> DataFrame:
    """A computed set of ids, for a semi or anti join: each task holds its share of the set, and the other side, which may have hot keys, is not sorted."""
    return ids.hint("shuffle_hash")


def present(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The values of a column that has few (types, reference sets) that are in a set with column id: rows are not dealt by so few values."""
    return few(stored(rows.select(column).distinct().join(wanted.select(F.col("id").alias(column)), column, "left_semi"), column))
