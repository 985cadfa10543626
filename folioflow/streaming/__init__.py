"""Job control over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_status(events: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """(key, status, n_events): the last status of each key by `order`. On a stream, run it in update mode; its state is one row a key."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("status"), F.count("*").alias("n_events"))
