"""A running count of equivalence classes over a stream of facts. Beyond parity: batch is all that a release needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_counts(stream: DataFrame, cols, time_col: str, user: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window, cols, k): approximate distinct users of each combination in tumbling windows; state is dropped behind the
    watermark."""
    return (
        stream.withWatermark(time_col, late)
        .groupBy(F.window(time_col, window), *cols)
        .agg(F.approx_count_distinct(user).alias("k"))
    )
