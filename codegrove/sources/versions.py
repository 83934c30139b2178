"""Newest-wins over versioned rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest(rows: DataFrame, keys: list[str], time: str, order: str | None = None) -> DataFrame:
    """Of the rows with the same keys the one with the latest time; of several, the first by `order`.

    An aggregation with a map-side combine: no key's rows meet in one task but for one a task.
    """
    rest = [c for c in rows.columns if c not in keys]
    if order is None:
        best = F.max_by(F.struct(*rest), F.col(time))
    elif dict(rows.dtypes)[order] in ("bigint", "int", "smallint", "tinyint"):
        best = F.max_by(F.struct(*rest), F.struct(F.col(time), -F.col(order)))
    else:
        best = F.min_by(F.struct(*rest), F.struct(-F.unix_micros(F.col(time).cast("timestamp")), F.col(order)))
    picked = rows.groupBy(*keys).agg(best.alias("_row"))
    return picked.select(*keys, "_row.*").select(rows.columns)
