"""A running degree count over a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_degrees(edges: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(window, gene, degree) of a stream (ts, tf, gene, weight), closed ``late`` behind its front."""
    return edges.withWatermark(time, late).groupBy(F.window(time, width), "gene").agg(F.sum("weight").alias("degree"))
