"""Resizing of grids by separable weights: a table of weights a direction, one equi-join and one sum for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Width of each kernel in cells.
WIDTHS = {"bicubic": 4.0, "bilinear": 2.0, "nearest": 1.0}


def kernel(t: Column, method: str) -> Column:
    """Cubic convolution with slope -1/2, a tent, or a box that holds its left end."""
    a = F.abs(t)
    if method == "nearest":
        return F.when((t >= -0.5) & (t < 0.5), 1.0).otherwise(0.0)
    if method == "bilinear":
        return F.greatest(1 - a, F.lit(0.0))
    near, far = 1.5 * a * a * a - 2.5 * a * a + 1, -0.5 * a * a * a + 2.5 * a * a - 4 * a + 2
    return F.when(a <= 1, near).when(a <= 2, far).otherwise(0.0)


def weights(spark: SparkSession, n: int, out: int, scale: float, method: str = "bicubic", antialias: bool = True) -> DataFrame:
    """target (1 to ``out``), source (1 to ``n``), w: how much each cell of a line gives to those of the resized line.

    Beyond its ends a line goes on as if mirrored there. When it shrinks, the kernel is stretched by as much
    (``antialias``), but for the nearest cell. A target's weights add up to 1.
    """
    if method not in WIDTHS:
        raise ValueError(f"method is one of {', '.join(WIDTHS)}")
    if n < 1 or out < 1 or scale <= 0:
        raise ValueError("sizes and scale are positive")
    shrink = scale if antialias and scale < 1 and method != "nearest" else 1.0
    width = WIDTHS[method] / shrink
    lines = spark.range(1, out + 1).select(F.col("id").cast("int").alias("target"), (F.col("id") / scale + 0.5 * (1 - 1 / scale)).alias("u"))
    first = F.floor(F.col("u") - width / 2)
    taps = lines.select("target", "u", F.explode(F.sequence(first, F.ceil(F.col("u") + width / 2))).alias("tap"))
    w = kernel((F.col("u") - F.col("tap")) * shrink, method)
    round_ = F.pmod(F.col("tap") - 1, F.lit(2 * n))
    source = F.when(round_ < n, round_ + 1).otherwise(2 * n - round_).cast("int")
    summed = taps.select("target", source.alias("source"), w.alias("w")).groupBy("target", "source").agg(F.sum("w").alias("w"))
    total = summed.groupBy("target").agg(F.sum("w").alias("_t"))
    return summed.where("w <> 0").join(total, "target").select("target", "source", (F.col("w") / F.col("_t")).alias("w"))


def _pass(grid: DataFrame, along: str, table: DataFrame) -> DataFrame:
    """One direction: cells whose every source has a value."""
    across = "col" if along == "row" else "row"
    needs = table.groupBy("target").agg(F.count(F.lit(1)).alias("_of"))
    sent = grid.join(table, grid[along] == table["source"]).groupBy("target", across).agg(F.sum(F.col("val") * F.col("w")).alias("val"), F.count(F.lit(1)).alias("_n"))
    met = sent.join(needs, "target").where(F.col("_n") == F.col("_of"))
    return met.select(F.col("target").alias(along), across, "val").select("row", "col", "val")


def resize(grid: DataFrame, nrows: int, ncols: int, scale: float, method: str = "bicubic", antialias: bool = True) -> DataFrame:
    """row, col, val of the grid of nrows x ncols cells at ``scale`` of its size (rounded up): "bicubic", "bilinear" or
    "nearest". The first pass is the one over columns, which neighbouring rows share. A cell for which a cell with
    weight is missing (NULL or absent) has no row; an empty grid gives none."""
    spark, size = grid.sparkSession, lambda n: -int(-(n * scale) // 1)
    cells = grid.where("val is not null").select("row", "col", F.col("val").cast("double").alias("val"))
    for along, n in (("col", ncols), ("row", nrows)):
        cells = _pass(cells, along, weights(spark, n, size(n), scale, method, antialias))
    return cells
