"""Incremental rasterizing: new point files update the cells' sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.grid import Axes, locate


def stream_cells(points: DataFrame, axes: Axes, watermark: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Streaming cell means by event window of a point stream (ts, x, y, z): late points beyond the watermark go."""
    placed = locate(points.withWatermark("ts", watermark), axes)
    return placed.groupBy(F.window("ts", window), "row", "col").agg(F.avg("z").alias("val"), F.count("z").alias("n"))


def rasterize_arrivals(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, axes: Axes) -> StreamingQuery:
    """Every batch of new point files becomes partial sums of cells, appended once by batch number."""

    def add(batch: DataFrame, number: int) -> None:
        sums = locate(batch, axes).groupBy("row", "col").agg(F.sum("z").alias("s"), F.count("z").alias("n"))
        sums.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrived(spark: SparkSession, out: str) -> DataFrame:
    """row, col, val over all batches."""
    return spark.read.parquet(out).groupBy("row", "col").agg((F.sum("s") / F.sum("n")).alias("val"), F.sum("n").alias("n"))
