"""Validation of a stream: rows are checked once each within a watermark, and violations counted by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semloom.operators.shapes import lexical


def violation_counts(stream: DataFrame, key: str, time: str, checks: dict[str, str], late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(start, path, n) of values that are no text of the XSD type that checks names for their column.

    Rows that come again with the same key within the watermark count once; rows later than it are dropped, and a
    window's counts come out when it has passed.
    """
    once = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    bad = F.array_compact(F.array(*(F.when(F.col(c).isNotNull() & ~lexical(F.col(c).cast("string"), t), c) for c, t in checks.items())))
    flat = once.select(F.window(time, window).alias("w"), F.explode(bad).alias("path"))
    return flat.groupBy("w", "path").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "path", "n")
