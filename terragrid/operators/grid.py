"""Grids as cells (row, col, val) and points (pt_id, x, y, z): gridding, sampling, neighbourhoods and morphology.

Rows count from the north, columns from the west, both from 1. A cell without a value has no row, or NULL.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

@dataclass(frozen=True)
class Axes:
    """Cell centres: x0 + (col - 1) dx eastward and y0 - (row - 1) dy southward from the north-west cell."""

    x0: float
    y0: float
    dx: float
    dy: float
    ncols: int
    nrows: int

    def __post_init__(self):
        if self.dx <= 0 or self.dy <= 0 or self.ncols < 1 or self.nrows < 1:
            raise ValueError("axes need positive steps and sizes; y runs from north to south")

    @classmethod
    def of_limits(cls, xlim: tuple[float, float], ylim: tuple[float, float], dx: float, dy: float, postings: bool = False) -> Axes:
        """From outer limits; with ``postings`` the limits are the outermost cells' centres."""
        shift = 0.0 if postings else 0.5
        n = [round((b - a) / d) + (1 if postings else 0) for (a, b), d in ((xlim, dx), (ylim, dy))]
        return cls(xlim[0] + shift * dx, ylim[1] - shift * dy, dx, dy, n[0], n[1])

    def cells(self, spark) -> DataFrame:
        """row, col, x, y of every cell, generated in parallel."""
        n = F.col("id")
        out = spark.range(self.ncols * self.nrows).select((n % self.nrows + 1).cast("int").alias("row"), (F.floor(n / self.nrows) + 1).cast("int").alias("col"))
        return out.select("row", "col", (F.lit(self.x0) + (F.col("col") - 1) * self.dx).alias("x"), (F.lit(self.y0) - (F.col("row") - 1) * self.dy).alias("y"))

    # halves go up, as by F.round, which makes a decimal of every double
    def col_of(self, x: Column) -> Column:
        return F.floor((x - self.x0) / self.dx + 1 + 0.5).cast("int")

    def row_of(self, y: Column) -> Column:
        return F.floor((F.lit(self.y0) - y) / self.dy + 1 + 0.5).cast("int")

    def halved(self, factor: int) -> Axes:
        """Axes of every ``factor`` cells, for a pyramid level."""
        return Axes(self.x0 + (factor - 1) / 2 * self.dx, self.y0 - (factor - 1) / 2 * self.dy, self.dx * factor, self.dy * factor, max(1, self.ncols // factor), max(1, self.nrows // factor))


def locate(points: DataFrame, axes: Axes) -> DataFrame:
    """Points with row and col of their cell; those outside the grid go."""
    placed = points.withColumn("row", axes.row_of(F.col("y"))).withColumn("col", axes.col_of(F.col("x")))
    return placed.where(F.col("row").between(1, axes.nrows) & F.col("col").between(1, axes.ncols))


def cell_mean(points: DataFrame, axes: Axes, by: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """by..., row, col, val (mean z) and n of every cell with points. Points are added up before the shuffle.

    With ``digits`` z is rounded to as many decimals and added up exactly, so the order of rows can't show."""
    mean = F.avg("z") if digits is None else F.sum(F.col("z").cast(f"decimal(18,{digits})")).cast("double") / F.count("z")
    return locate(points, axes).groupBy(*(by or []), "row", "col").agg(mean.alias("val"), F.count("z").alias("n"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """row, col, val of a minus b where both have a value."""
    return a.select("row", "col", F.col("val").alias("_a")).join(b.select("row", "col", F.col("val").alias("_b")), ["row", "col"]).select("row", "col", (F.col("_a") - F.col("_b")).alias("val")).where("val is not null")


def mask_out(grid: DataFrame, mask: DataFrame) -> DataFrame:
    """Cells that the mask (row, col) doesn't hold."""
    return grid.join(mask.select("row", "col").distinct(), ["row", "col"], "left_anti")


def fill(grid: DataFrame, other: DataFrame) -> DataFrame:
    """Cells of ``grid`` with missing values taken from ``other``."""
    return grid.join(other.select("row", "col", F.col("val").alias("_o")), ["row", "col"], "left").withColumn("val", F.coalesce("val", "_o")).drop("_o")


def window_scan(grid: DataFrame, axes: Axes, box: tuple[float, float, float, float], buffer: float = 0.0) -> DataFrame:
    """Cells whose centre is between the axis positions nearest to the edges of ``box`` (x0, y0, x1, y1), widened by
    ``buffer`` times its size. The index range is worked out first, so it reaches the scan."""
    x0, y0, x1, y1 = box
    bx, by = buffer * (x1 - x0), buffer * (y1 - y0)
    near = lambda v, a, d, n: min(n, max(1, math.floor((v - a) / d + 1.5)))
    c0, c1 = near(x0 - bx, axes.x0, axes.dx, axes.ncols), near(x1 + bx, axes.x0, axes.dx, axes.ncols)
    r0, r1 = near(-(y1 + by), -axes.y0, axes.dy, axes.nrows), near(-(y0 - by), -axes.y0, axes.dy, axes.nrows)
    if c1 <= c0 or r1 <= r0:
        raise ValueError("the box holds fewer than two cells on an axis")
    return grid.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))


def bilinear(points: DataFrame, grid: DataFrame, axes: Axes, out: str = "sample", by: list[str] | None = None) -> DataFrame:
    """Points (pt_id, x, y, ...) with the value between the four cells around them; NULL outside or beside a missing one.

    Each point asks for its (at most four) cells with a weight, one equi-join and one sum by pt_id answer. With ``by``
    both sides have these columns, and a group's points meet its own grid.
    """
    by = by or []
    fx, fy = (F.col("x") - axes.x0) / axes.dx + 1, (F.lit(axes.y0) - F.col("y")) / axes.dy + 1
    # the last row and column end the grid: points on them lie in the cell before
    c, r = F.least(F.floor(fx), F.lit(max(1, axes.ncols - 1))), F.least(F.floor(fy), F.lit(max(1, axes.nrows - 1)))
    inside = fx.between(1, axes.ncols) & fy.between(1, axes.nrows)
    corner = lambda dr, dc: F.struct((r + dr).cast("int").alias("row"), (c + dc).cast("int").alias("col"), ((fy - r if dr else 1 - (fy - r)) * (fx - c if dc else 1 - (fx - c))).alias("w"))
    asked = points.where(inside).select(*by, "pt_id", F.explode(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)])).alias("s")).select(*by, "pt_id", "s.*").where("w > 0")
    got = asked.join(grid.select(*by, "row", "col", "val"), [*by, "row", "col"], "left").groupBy(*by, "pt_id")
    value = F.when(F.count("val") == F.count(F.lit(1)), F.sum(F.col("w") * F.col("val")))
    return points.join(got.agg(value.alias(out)), [*by, "pt_id"], "left")


def resample(grid: DataFrame, axes: Axes, target: Axes, inverse=None, nulls: tuple = ()) -> DataFrame:
    """row, col, val on the target axes: each target centre goes through ``inverse`` (x, y -> source x, y; see
    ``projections.reproject``) and is sampled bilinearly. Values in ``nulls`` are missing; a target centre beside a
    missing cell or outside the source is NULL."""
    if nulls:
        grid = grid.withColumn("val", F.when(~F.col("val").isin(*nulls), F.col("val")))
    cells = target.cells(grid.sparkSession).withColumn("pt_id", (F.col("col").cast("long") - 1) * target.nrows + F.col("row"))
    if inverse is not None:
        x, y = inverse(F.col("x"), F.col("y"))
        cells = cells.withColumns({"x": x, "y": y})
    return bilinear(cells, grid, axes, "val").select("row", "col", "val")


def shifted(grid: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each cell's value sent to the cells it neighbours: row, col, dr, dc, val where the value lies at row + dr, col + dc."""
    to = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in offsets]))
    return grid.select("row", "col", "val", to.alias("o")).select((F.col("row") - F.col("o.dr")).alias("row"), (F.col("col") - F.col("o.dc")).alias("col"), "o.dr", "o.dc", "val")


EIGHT = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
NAMES = ["n", "ne", "e", "se", "s", "sw", "w", "nw"]


def with_rim(grid: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """The grid and a rim of cells around it, each continuing the line through the two cells before it."""

    def beyond(g: DataFrame, along: str, across: str, n: int) -> DataFrame:
        at = lambda k: F.max(F.when(F.col(across) == k, F.col("val")))
        ends = g.where(F.col(across).isin(1, 2, n - 1, n)).groupBy(along).agg((2 * at(1) - at(2)).alias("_a"), (2 * at(n) - at(n - 1)).alias("_b"))
        rim = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("_a").alias("val")), F.struct(F.lit(n + 1).alias("k"), F.col("_b").alias("val"))))
        return ends.select(along, rim.alias("r")).select(along, F.col("r.k").alias(across), "r.val").select("row", "col", "val")

    wide = grid.select("row", "col", "val")
    wide = wide.union(beyond(wide, "row", "col", ncols))
    return wide.union(beyond(wide, "col", "row", nrows))


def neighbours(grid: DataFrame, rim: tuple[int, int] | None = None) -> DataFrame:
    """row, col, val and the eight neighbours' values (n, ne, e, se, s, sw, w, nw; NULL where there is none).

    Every cell sends its value to its neighbours; one aggregation by cell puts them side by side. With ``rim`` (numbers
    of rows and columns) cells at the grid's edge get neighbours beyond it by linear continuation.
    """
    if rim is not None:
        return neighbours(with_rim(grid, *rim)).where(F.col("row").between(1, rim[0]) & F.col("col").between(1, rim[1]))
    sent = shifted(grid, [(0, 0), *EIGHT])
    pick = lambda dr, dc: F.max(F.when((F.col("dr") == dr) & (F.col("dc") == dc), F.col("val")))
    every = sent.groupBy("row", "col").agg(F.max(F.when((F.col("dr") == 0) & (F.col("dc") == 0), 1)).alias("_own"), pick(0, 0).alias("val"), *[pick(*o).alias(n) for o, n in zip(EIGHT, NAMES)])
    return every.where("_own = 1").drop("_own")


def gradient(around: DataFrame, dx: float, dy: float) -> DataFrame:
    """``neighbours`` with p and q: central differences eastward and northward, NULL beside a missing value."""
    p = (F.col("e") - F.col("w")) / (2 * dx)
    q = (F.col("n") - F.col("s")) / (2 * dy)
    return around.withColumns({"p": p, "q": q})


def surface(grid: DataFrame, dx: float, dy: float, rim: tuple[int, int] | None = None) -> DataFrame:
    """row, col, val, slope and aspect (degrees) and the unit normal nx, ny, nz of cells with all four side neighbours
    (at the grid's edge with ``rim``, see ``neighbours``)."""
    g = gradient(neighbours(grid, rim), dx, dy).where("p is not null and q is not null")
    p, q = F.col("p"), F.col("q")
    size = F.sqrt(p * p + q * q + 1)
    return g.select("row", "col", "val", F.degrees(F.atan(F.sqrt(p * p + q * q))).alias("slope"), (F.degrees(F.atan2(p, q)) + 180).alias("aspect"), (-p / size).alias("nx"), (-q / size).alias("ny"), (1 / size).alias("nz"))


def sobel(grid: DataFrame) -> DataFrame:
    """row, col, gx, gy and magnitude of cells with all eight neighbours."""
    a = neighbours(grid)
    gx = F.col("ne") + 2 * F.col("e") + F.col("se") - F.col("nw") - 2 * F.col("w") - F.col("sw")
    gy = F.col("sw") + 2 * F.col("s") + F.col("se") - F.col("nw") - 2 * F.col("n") - F.col("ne")
    return a.select("row", "col", gx.alias("gx"), gy.alias("gy")).where("gx is not null and gy is not null").withColumn("magnitude", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))


def _reflect(i: Column, n: int) -> Column:
    return F.when(i < 1, 1 - i).when(i > n, 2 * n + 1 - i).otherwise(i)


def box_statistic(grid: DataFrame, nrows: int, ncols: int, size: int, statistic) -> DataFrame:
    """row, col, val of ``statistic`` over each cell's size x size box; beyond the edges the grid is mirrored.

    Boxes take values from their cells, so every value goes to at most size² boxes (times what edges mirror).
    """
    k = size // 2
    span = [(dr, dc) for dr in range(-k, k + 1) for dc in range(-k, k + 1)]
    asked = grid.select("row", "col", F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in span])).alias("o"))
    asked = asked.select("row", "col", _reflect(F.col("row") + F.col("o.dr"), nrows).alias("_r"), _reflect(F.col("col") + F.col("o.dc"), ncols).alias("_c"))
    values = grid.select(F.col("row").alias("_r"), F.col("col").alias("_c"), "val")
    return asked.join(values, ["_r", "_c"]).groupBy("row", "col").agg(statistic(F.col("val")).alias("val"))


def median(grid: DataFrame, nrows: int, ncols: int, size: int = 3) -> DataFrame:
    return box_statistic(grid, nrows, ncols, size, F.median)


def wiener(grid: DataFrame, nrows: int, ncols: int, size: int = 3, noise: float | None = None) -> DataFrame:
    """Adaptive noise filter: local mean plus the share of the deviation that exceeds the noise (default: the mean local
    variance)."""
    pair = lambda v: F.struct(F.avg(v).alias("m"), (F.avg(v * v) - F.avg(v) * F.avg(v)).alias("v"))
    local = box_statistic(grid, nrows, ncols, size, pair).select("row", "col", "val.m", "val.v")
    nu = F.lit(noise) if noise is not None else F.lit(local.agg(F.avg("v")).head()[0] or 0.0)
    part = F.coalesce(F.try_divide(F.greatest(F.col("v") - nu, F.lit(0.0)), F.greatest(F.col("v"), nu)), F.lit(0.0))
    return grid.join(local, ["row", "col"]).select("row", "col", (F.col("m") + part * (F.col("val") - F.col("m"))).alias("val"))


def disk(radius: float) -> list[tuple[int, int]]:
    k = int(radius)
    return [(r, c) for r in range(-k, k + 1) for c in range(-k, k + 1) if r * r + c * c <= radius * radius]


def dilate(mask: DataFrame, offsets: list[tuple[int, int]], nrows: int, ncols: int) -> DataFrame:
    """Cells (row, col) that a mask cell reaches by one of the offsets, inside the grid."""
    reached = shifted(mask.select("row", "col", F.lit(1).alias("val")), offsets)
    return reached.where(F.col("row").between(1, nrows) & F.col("col").between(1, ncols)).select("row", "col").distinct()


def components(mask: DataFrame, eight: bool = True, most: int = 200) -> DataFrame:
    """row, col, component of mask cells: the least cell number among those connected over sides (and corners).

    Labels travel by the least of the neighbourhood and then jump to the label of their label's cell, so rounds grow
    with the logarithm of a component's extent; every few rounds are written to the checkpoint folder.
    """
    cells = mask.select("row", "col").distinct()
    number = lambda r, c: r.cast("long") * (1 << 31) + c.cast("long")
    now = cells.withColumn("component", number(F.col("row"), F.col("col")))
    around = [(0, 0), *EIGHT] if eight else [(0, 0), (-1, 0), (0, 1), (1, 0), (0, -1)]
    now = _cut(now)
    for _ in range(most):
        least = shifted(now.withColumnRenamed("component", "val"), around).groupBy("row", "col").agg(F.min("val").alias("_l"))
        step = now.join(least, ["row", "col"]).select("row", "col", F.least("component", "_l").alias("_l"))
        own = step.select(number(F.col("row"), F.col("col")).alias("_l"), F.col("_l").alias("_jump"))
        after = _cut(step.join(own, "_l").select("row", "col", F.col("_jump").alias("component")))
        moved = after.join(now.withColumnRenamed("component", "_was"), ["row", "col"]).where("component <> _was").limit(1).count()
        now = after
        if not moved:
            return now
    raise RuntimeError(f"components didn't settle in {most} rounds")


def checkpoint_dir(spark) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        path = f"/tmp/terragrid-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def _cut(df: DataFrame) -> DataFrame:
    """The same rows, read from the checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """The same rows, read from a Parquet table in the checkpoint folder that goes at the end: smaller than a checkpoint,
    for rows that many passes read."""
    path = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def area_open(mask: DataFrame, least: int, eight: bool = True) -> DataFrame:
    """Mask cells of components with ``least`` cells or more."""
    found = components(mask, eight)
    return found.join(found.groupBy("component").agg(F.count(F.lit(1)).alias("area")).where(F.col("area") >= least), "component").select("row", "col")


def fill_holes(mask: DataFrame, axes: Axes) -> DataFrame:
    """The mask and all background components that don't touch the border."""
    back = axes.cells(mask.sparkSession).select("row", "col").join(mask.select("row", "col"), ["row", "col"], "left_anti")
    found = components(back, eight=False)
    edge = found.where(F.col("row").isin(1, axes.nrows) | F.col("col").isin(1, axes.ncols)).select("component").distinct()
    return mask.select("row", "col").union(found.join(edge, "component", "left_anti").select("row", "col"))


def clear_border(mask: DataFrame, axes: Axes) -> DataFrame:
    """Mask components that don't touch the border."""
    found = components(mask)
    edge = found.where(F.col("row").isin(1, axes.nrows) | F.col("col").isin(1, axes.ncols)).select("component").distinct()
    return found.join(edge, "component", "left_anti").select("row", "col")


def hopping_extremes(grid: DataFrame, size: int, nrows: int, ncols: int) -> DataFrame:
    """row, col, n_max, n_min: how many windows of size x size, a quarter of the size apart, have their first maximum or
    minimum there."""
    hop = max(1, size // 4)
    starts = lambda c, n: F.filter(F.sequence(F.greatest(F.lit(0), F.ceil((c - size) / hop)), F.floor((c - 1) / hop)), lambda k: k * hop + size <= n)
    tiles = grid.withColumn("_wr", F.explode(starts(F.col("row"), nrows))).withColumn("_wc", F.explode(starts(F.col("col"), ncols)))
    place = F.struct((-F.col("col")).alias("c"), (-F.col("row")).alias("r"))
    found = tiles.groupBy("_wr", "_wc").agg(F.max(F.struct("val", place)).alias("a"), F.min(F.struct("val", F.struct("col", "row"))).alias("b"))
    high = found.select((-F.col("a.col2.r")).alias("row"), (-F.col("a.col2.c")).alias("col"), F.lit(1).alias("hi"), F.lit(0).alias("lo"))
    low = found.select(F.col("b.col2.row").alias("row"), F.col("b.col2.col").alias("col"), F.lit(0).alias("hi"), F.lit(1).alias("lo"))
    return high.union(low).groupBy("row", "col").agg(F.sum("hi").alias("n_max"), F.sum("lo").alias("n_min"))


def tile_map(cells: DataFrame, tile: int, fn, schema: str, halo: int = 0) -> DataFrame:
    """``fn`` over every tile of tile x tile cells as pandas, with a halo of the cells around it; fn gets (tile_row,
    tile_col) and the frame. Half-open tiles: a cell belongs to one tile only."""
    low = lambda c: F.floor((F.col(c) - 1 - halo) / tile)
    high = lambda c: F.floor((F.col(c) - 1 + halo) / tile)
    spread = cells.withColumn("tile_row", F.explode(F.sequence(F.greatest(low("row"), F.lit(0)), high("row")))).withColumn("tile_col", F.explode(F.sequence(F.greatest(low("col"), F.lit(0)), high("col"))))
    return spread.groupBy("tile_row", "tile_col").applyInPandas(lambda key, frame: fn(key, frame.drop(columns=["tile_row", "tile_col"])), schema)


def ordered_difference(points: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Difference to the point before, by pt_id within ``by``."""
    return points.withColumn("diff", F.col(column) - F.lag(column).over(Window.partitionBy(*by).orderBy("pt_id")))
