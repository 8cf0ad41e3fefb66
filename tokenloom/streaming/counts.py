"""The status counts of the batch engine on a stream: the same grouping, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status_counts(stream: DataFrame, status: str) -> DataFrame:
    """Works on batch and streaming frames alike (update or complete mode)."""
    return stream.groupBy(status).agg(F.count("*").alias("cnt"))
