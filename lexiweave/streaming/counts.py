"""Keyword counts over a stream of records: an extension of ours; clustering needs the whole corpus and stays batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold


def windowed_counts(stream: DataFrame, time_col: str = "ts", keyword_col: str = "kw_raw", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, term, freq) for each tumbling window, final once the watermark has passed it."""
    rows = stream.withWatermark(time_col, late).select(time_col, fold(F.col(keyword_col)).alias("term")).where(F.col("term") != "")
    counted = rows.groupBy(F.window(time_col, window).alias("w"), "term").agg(F.count(F.lit(1)).alias("freq"))
    return counted.select(F.col("w.start").alias("window_start"), "term", "freq")
