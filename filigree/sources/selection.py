"""Selection of data sets: parallel lists of files that belong together by their place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zipped(lists: dict[str, DataFrame], first: int | None = None) -> DataFrame:
    """idx and a column for each list (idx, value), joined by idx; places that some list lacks are left out. first: only so many places from the start."""
    out = None
    for name, rows in lists.items():
        own = rows.select("idx", F.col("value").alias(name))
        own = own if first is None else own.where(F.col("idx") < first)
        out = own if out is None else out.join(own, "idx")
    return out
