"""The corpus pipeline: documents are cleaned, deduplicated, mixed and packed, one stage after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codegrove.llm import language_id, mixing, packing, quality, simhash
from codegrove.llm.common import stored, table

STAGES = [
    ("language_id", language_id.stage),
    ("quality", quality.stage),
    ("simhash", simhash.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: No SQL says what language identification, near-duplicates and packing do; a test holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
