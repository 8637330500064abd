"""Statistics under large footprints by summed-area tables: the cost doesn't depend on the footprint's size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import Axes, _cut


def _running(df: DataFrame, along: str, across: str, names: list[str], block: int) -> DataFrame:
    """``names`` summed up to each cell of a line, in two levels: within blocks of cells, and over the blocks before.
    No task sorts more than a block, or a line's blocks."""
    df = df.withColumn("_b", F.floor((F.col(along) - 1) / block))
    inside = Window.partitionBy(across, "_b").orderBy(along)
    wide = lambda c: c.cast("decimal(38,0)")
    sums = df.select("row", "col", "_b", *[wide(F.sum(n).over(inside)).alias(n) for n in names])
    totals = df.groupBy(across, "_b").agg(*[F.sum(n).alias(n) for n in names])
    before = Window.partitionBy(across).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(across).alias("_line"), F.col("_b").alias("_of"), *[F.coalesce(wide(F.sum(n).over(before)), F.lit(0)).alias(f"_{n}") for n in names])
    met = sums.join(totals, (F.col(across) == F.col("_line")) & (F.col("_b") == F.col("_of")))
    return met.select("row", "col", *[wide(F.col(n) + F.col(f"_{n}")).alias(n) for n in names])


def summed_area(grid: DataFrame, axes: Axes, digits: int = 2, block: int = 1024) -> DataFrame:
    """row, col, n, s, q of every cell of the axes: number, sum and sum of squares of the values (in whole units of
    10 ** -digits, so sums are exact) of all cells up to it in both directions."""
    v = F.round(F.col("val") * 10**digits).cast("decimal(18,0)")
    whole = axes.cells(grid.sparkSession).select("row", "col").join(grid.select("row", "col", "val"), ["row", "col"], "left")
    cells = whole.select("row", "col", F.when(v.isNull(), 0).otherwise(1).cast("decimal(38,0)").alias("n"), F.coalesce(v, F.lit(0)).cast("decimal(38,0)").alias("s"), F.coalesce(v * v, F.lit(0)).cast("decimal(38,0)").alias("q"))
    return _running(_running(cells, "col", "row", ["n", "s", "q"], block), "row", "col", ["n", "s", "q"], block)


def _stretches(centre: Column, half: int, n: int) -> Column:
    """First and last cells of the stretches that centre - half to centre + half covers on a line of n cells, which goes
    on beyond its ends as if mirrored there (up to n cells of it)."""
    a, b = centre - half, centre + half
    piece = lambda p, q: F.struct(p.cast("int").alias("a"), q.cast("int").alias("b"))
    none = F.array().cast("array<struct<a:int,b:int>>")
    held = F.array(piece(F.greatest(a, F.lit(1)), F.least(b, F.lit(n))))
    low = F.when(a < 1, F.array(piece(F.lit(1), F.least(1 - a, F.lit(n))))).otherwise(none)
    high = F.when(b > n, F.array(piece(F.greatest(2 * n - b + 1, F.lit(1)), F.lit(n)))).otherwise(none)
    return F.concat(held, low, high)


def local_deviation(points: DataFrame, grid: DataFrame, axes: Axes, half_rows: int, half_cols: int, digits: int = 2) -> DataFrame:
    """pt_id, n, mean and deviation (of a sample, NULL under two values) of the cells within ``half_rows`` and
    ``half_cols`` of each point (pt_id, row, col); the grid is mirrored at its edges. Missing cells don't count.

    A point looks up the corners of its footprint (four, or up to sixteen at the grid's corners) in the summed-area
    table by one equi-join.
    """
    if half_rows > axes.nrows or half_cols > axes.ncols:
        raise ValueError("the footprint reaches beyond the mirrored grid")
    table = _cut(summed_area(grid, axes, digits))
    rows, cols = F.explode(_stretches(F.col("row"), half_rows, axes.nrows)), F.explode(_stretches(F.col("col"), half_cols, axes.ncols))
    boxes = points.select("pt_id", "row", "col").withColumn("r", rows).withColumn("c", cols)
    corner = lambda r, c, k: F.struct(r.alias("row"), c.alias("col"), F.lit(k).alias("k"))
    r, c = F.col("r"), F.col("c")
    asked = boxes.select("pt_id", F.explode(F.array(corner(r["b"], c["b"], 1), corner(r["a"] - 1, c["b"], -1), corner(r["b"], c["a"] - 1, -1), corner(r["a"] - 1, c["a"] - 1, 1))).alias("p")).select("pt_id", "p.*").where("row > 0 and col > 0")
    total = asked.join(table, ["row", "col"]).groupBy("pt_id").agg(*[F.sum(F.col("k") * F.col(n)).cast("decimal(38,0)").alias(n) for n in ("n", "s", "q")])
    n, s, q, unit = F.col("n").cast("double"), F.col("s").cast("double"), F.col("q").cast("double"), float(10**digits)
    # n q - s s is exact in decimals as long as it has 38 digits
    spread = (F.col("n") * F.col("q") - F.col("s") * F.col("s")).cast("double")
    return total.select("pt_id", F.col("n").cast("long").alias("n"), F.when(n > 0, s / n / unit).alias("mean"), F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (n * (n - 1))) / unit).alias("deviation"))
