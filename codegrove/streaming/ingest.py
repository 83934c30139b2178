"""Versioned rows as a stream: each batch is merged into a newest-wins table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.versions import newest


def newest_wins_stream(rows: DataFrame, keys: list[str], time: str, order: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keep under `path` the newest row of each key. A batch writes a new version of the table in a folder named by the batch, so that one that is run again after a failure writes the same."""
    def merge(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        old = latest(s, path, below=number)
        every = batch if old is None else old.unionByName(batch)
        newest(every, keys, time, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark, path: str, below: int | None = None) -> DataFrame | None:
    """The table's newest complete version, or None."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(at):
        return None
    done = [int(f.getPath().getName()[6:]) for f in fs.listStatus(at) if f.getPath().getName().startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    done = [n for n in done if below is None or n < below]
    return spark.read.parquet(f"{path}/batch={max(done)}") if done else None
