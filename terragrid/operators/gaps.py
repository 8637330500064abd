"""Filling the gaps of a grid: the surface over a gap bends as little as the cells around allow, or is a mean of them."""

from __future__ import annotations

import itertools
import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import Axes, checkpoint_dir, components, shifted

_BLOCK = ["component", "br", "bc"]
_CELL = ["row", "col"]


def _equations(holes: DataFrame, axes: Axes) -> DataFrame:
    """er, ec, row, col, v: the second differences along columns and rows that hold a missing cell, as one equation for
    each centre (er, ec). A direction in which the centre is the grid's end has no difference."""
    to = shifted(holes.withColumn("val", F.lit(1.0)), [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)])
    inside = F.col("row").between(1, axes.nrows) & F.col("col").between(1, axes.ncols)
    centres = to.where(inside).select(F.col("row").alias("er"), F.col("col").alias("ec")).distinct()
    down, along = F.col("er").between(2, axes.nrows - 1), F.col("ec").between(2, axes.ncols - 1)
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    entry = lambda r, c, v: F.struct((F.col("er") + r).cast("int").alias("row"), (F.col("ec") + c).cast("int").alias("col"), v.alias("v"))
    five = F.array(entry(0, 0, -2.0 * (one(down) + one(along))), entry(-1, 0, one(down)), entry(1, 0, one(down)), entry(0, -1, one(along)), entry(0, 1, one(along)))
    return centres.select("er", "ec", F.explode(five).alias("e")).select("er", "ec", "e.*").where("v <> 0")


def _solve_block(key: tuple, cells: pd.DataFrame, matrix: pd.DataFrame) -> pd.DataFrame:
    """z with N z = r for the cells of one block and their own part N of the normal equations."""
    if not len(cells):  # a block whose hole has ended
        return pd.DataFrame({c: [] for c in [*_CELL, "z"]})
    width = int(cells["col"].max()) + 1
    order = cells.sort_values(_CELL).reset_index(drop=True)
    number = order["row"].to_numpy(np.int64) * width + order["col"].to_numpy(np.int64)
    at = lambda r, c: np.searchsorted(number, matrix[r].to_numpy(np.int64) * width + matrix[c].to_numpy(np.int64))
    n = np.zeros((len(order), len(order)))
    n[at("row", "col"), at("row2", "col2")] = matrix["v"].to_numpy(float)
    r = order["r"].to_numpy(float)
    try:
        z = np.linalg.solve(n, r)
        exact = np.isfinite(z).all() and np.abs(n @ z - r).max() <= 1e-6 * max(np.abs(r).max(), 1e-300)
    except np.linalg.LinAlgError:
        exact = False
    order["z"] = z if exact else np.linalg.pinv(n, rcond=1e-12, hermitian=True) @ r
    return order[[*_CELL, "z"]]


def _means(holes: DataFrame, axes: Axes) -> DataFrame:
    """er, ec, row, col, v: for each missing cell (er, ec), its side neighbours' number times itself less each of them."""
    side = [(-1, 0), (1, 0), (0, -1), (0, 1)]
    beside = shifted(holes.withColumn("val", F.lit(-1.0)), side).where(F.col("row").between(1, axes.nrows) & F.col("col").between(1, axes.ncols))
    beside = beside.select((F.col("row") + F.col("dr")).alias("er"), (F.col("col") + F.col("dc")).alias("ec"), "row", "col", F.col("val").alias("v"))
    return beside.union(beside.groupBy("er", "ec").agg((-F.sum("v")).alias("v")).select("er", "ec", F.col("er").alias("row"), F.col("ec").alias("col"), "v"))


def inpaint(grid: DataFrame, axes: Axes, method: str = "curvature", block: int = 48, rounds: int = 500, tolerance: float = 1e-11) -> DataFrame:
    """row, col, val of all cells of the axes, missing ones filled. By "curvature" the sum of squares of the second
    differences (of both directions together, at every cell whose differences hold a missing one) is least, so planes
    are continued; by "neighbours" each missing cell is the mean of its (two to four) side neighbours.

    The (normal) equations are a table of their coefficients. Holes that share no equation are solved side by side, all in
    the same rounds of conjugate gradients: joins and sums by cell and by hole. In a round each block of ``block`` x
    ``block`` cells of a hole is first solved by itself, so a hole of one block is done in a round, larger ones take more
    by the same path; a hole ends when its equations' residual is ``tolerance`` of its right side, and ``rounds`` without
    an end raise. Rounds are tables in the folder of ``spark.checkpoint.dir``; the driver gets two flags a round.

    NULL and absent values are missing; repeated cells count once each (grids hold a cell once). A hole without any
    value in its equations has no solution and stays NULL; where the values around leave several, the one nearest to
    their mean is taken. An empty grid gives NULLs.
    """
    spark = grid.sparkSession
    path = f"{checkpoint_dir(spark)}/gaps-{uuid.uuid4().hex}"
    number = itertools.count()

    def written(df: DataFrame) -> DataFrame:
        to = f"{path}/{next(number)}"
        df.write.parquet(to)
        return spark.read.schema(df.schema).parquet(to)

    known = written(grid.where("val is not null").select("row", "col", F.col("val").cast("double").alias("val")))
    holes = written(axes.cells(spark).select("row", "col").join(known, _CELL, "left_anti"))
    if method not in ("curvature", "neighbours"):
        raise ValueError("method is curvature or neighbours")
    if holes.isEmpty():
        return known
    equations = _equations(holes, axes) if method == "curvature" else _means(holes, axes)
    # two missing cells of one equation lie in one component of missing cells and their side neighbours
    touched = components(equations.select(F.col("er").alias("row"), F.col("ec").alias("col")).union(holes), eight=False)
    lone = holes.join(touched, _CELL)
    first = lone.groupBy("component").agg(F.min("row").alias("r0"), F.min("col").alias("c0"))
    tile = lambda c, start: F.floor((F.col(c) - F.col(start)) / block).cast("int")
    cells = written(lone.join(first, "component").select("component", tile("row", "r0").alias("br"), tile("col", "c0").alias("bc"), "row", "col"))
    asked = equations.join(cells, _CELL).select("er", "ec", *_BLOCK, "row", "col", "v")
    given = equations.join(known, _CELL).groupBy("er", "ec").agg(F.sum(F.col("v") * F.col("val")).alias("k"), F.avg("val").alias("m"))
    # the product of the equations' coefficients with those of the same equation's other cells
    other = asked.select("er", "ec", F.col("br").alias("br2"), F.col("bc").alias("bc2"), F.col("row").alias("row2"), F.col("col").alias("col2"), F.col("v").alias("v2"))
    if method == "neighbours":  # symmetric as they are: an equation is multiplied by its own cell alone
        asked = asked.where("row = er and col = ec").withColumn("v", F.lit(1.0))
    normal = asked.join(other, ["er", "ec"]).groupBy(*_BLOCK, *_CELL, "br2", "bc2", "row2", "col2").agg(F.sum(F.col("v") * F.col("v2")).alias("v"))
    normal = written(normal)
    own = normal.where("br = br2 and bc = bc2").select(*_BLOCK, *_CELL, "row2", "col2", "v")
    right = asked.join(given, ["er", "ec"], "left").groupBy(*_BLOCK, *_CELL).agg(F.coalesce(-F.sum(F.col("v") * F.col("k")), F.lit(0.0)).alias("b"), F.sum("m").alias("m"), F.count("m").alias("n"))
    right = written(cells.join(right, [*_BLOCK, *_CELL], "left").fillna({"b": 0.0, "n": 0}))
    start = right.groupBy("component").agg((F.sum("m") / F.sum("n")).alias("x"), F.max(F.abs("b")).alias("scale"))

    def times(vector: DataFrame, name: str) -> DataFrame:
        """row, col, _n: the equations times the column ``name``."""
        sent = vector.select(F.col("row").alias("row2"), F.col("col").alias("col2"), F.col(name).alias("_v"))
        return normal.join(sent, ["row2", "col2"]).groupBy("row", "col").agg(F.sum(F.col("v") * F.col("_v")).alias("_n"))

    state = right.join(start, "component").where("x is not null")
    state = state.join(times(state, "x"), _CELL).select(*_BLOCK, *_CELL, "x", (F.col("b") - F.col("_n")).alias("r"), F.lit(0.0).alias("p"), F.lit(0.0).alias("s"), "scale", F.lit(0.0).alias("rz"), F.lit(0.0).alias("a"), F.lit(True).alias("open"))
    state, done = written(state), [known]
    for _ in range(rounds):
        z = state.groupBy(*_BLOCK).cogroup(own.groupBy(*_BLOCK)).applyInPandas(_solve_block, "row int, col int, z double")
        solved = written(state.join(z, _CELL))
        met = solved.join(times(solved, "z"), _CELL)
        # one reduction a round: the step's length from this round's products and the last one's length
        sums = met.groupBy("component").agg(F.sum(F.expr("r * z")).alias("_rz"), F.sum(F.expr("_n * z")).alias("_zz"), (F.max(F.abs("r")) > tolerance * F.max("scale")).alias("_open"), F.max("rz").alias("_was"), F.max("a").alias("_a"))
        sums = sums.withColumn("_b", F.expr("case when _was > 0 then _rz / _was else 0 end")).withColumn("_k", F.expr("_rz / nullif(_zz - case when _was > 0 then _b * _rz / _a else 0 end, 0)"))
        sums = sums.select("component", "_rz", "_b", F.coalesce("_k", F.lit(0.0)).alias("_k"), (F.col("_open") & (F.col("_rz") > 0)).alias("_open"))
        met = met.join(sums, "component").withColumns({"p": F.expr("z + _b * p"), "s": F.expr("_n + _b * s")})
        step = lambda e: F.expr(f"if(_open, {e}, 0)")
        state = written(met.select(*_BLOCK, *_CELL, (F.col("x") + step("_k * p")).alias("x"), (F.col("r") - step("_k * s")).alias("r"), "p", "s", "scale", F.col("_rz").alias("rz"), F.col("_k").alias("a"), F.col("_open").alias("open")))
        left = {r.open for r in state.select("open").distinct().collect()}
        if False in left:
            done.append(state.where("not open").select("row", "col", F.col("x").alias("val")))
        if True not in left:
            none = right.join(start.where("x is null"), "component").select("row", "col", F.lit(None).cast("double").alias("val"))
            return reduce(DataFrame.union, [*done, none])
        state = state.where("open")
    raise RuntimeError(f"holes are still open after {rounds} rounds")
