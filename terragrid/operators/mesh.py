"""Triangle meshes as tables: vertices (vertex, x, y, z) and faces (face_id, a, b, c), and smoothing that keeps edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import Axes, _cut, shifted


def grid_mesh(grid: DataFrame, axes: Axes) -> tuple[DataFrame, DataFrame]:
    """Vertices at the cells with values and the two triangles of each square of four such cells (one, if three of them
    have values), counter-clockwise seen from above. A vertex is numbered by its cell, column by column."""
    cells = grid.where("val is not null").select("row", "col", F.col("val").cast("double").alias("val"))
    number = lambda r, c: (c.cast("long") - 1) * axes.nrows + r
    vertices = cells.select(number(F.col("row"), F.col("col")).alias("vertex"), (F.lit(axes.x0) + (F.col("col") - 1) * axes.dx).alias("x"), (F.lit(axes.y0) - (F.col("row") - 1) * axes.dy).alias("y"), F.col("val").alias("z"))
    here = lambda r, c: F.max(F.when((F.col("dr") == r) & (F.col("dc") == c), number(F.col("row") + r, F.col("col") + c)))
    squares = shifted(cells, [(0, 0), (0, 1), (1, 0), (1, 1)]).groupBy("row", "col").agg(here(0, 0).alias("nw"), here(0, 1).alias("ne"), here(1, 0).alias("sw"), here(1, 1).alias("se"))
    three = lambda *v: F.struct(*[F.col(k).alias(n) for k, n in zip(v, "abc")])
    lacks = lambda c: F.col(c).isNull()
    # the diagonal runs from north-west to south-east, unless one of its ends is missing
    halves = F.when(lacks("nw") | lacks("se"), F.array(three("nw", "sw", "ne"), three("sw", "se", "ne"))).otherwise(F.array(three("nw", "sw", "se"), three("nw", "se", "ne")))
    at = 2 * number(F.col("row") + 1, F.col("col") + 1)
    faces = squares.select(at.alias("at"), F.posexplode(halves).alias("k", "f")).select((F.col("at") + F.col("k")).alias("face_id"), "f.*")
    return vertices, faces.where("a is not null and b is not null and c is not null")


def corners(faces: DataFrame) -> DataFrame:
    """face_id, k (0 to 2), vertex."""
    return faces.select("face_id", F.posexplode(F.array("a", "b", "c")).alias("k", "vertex"))


def _placed(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """face_id and x0 ... z2 of its corners; faces that lack one are left out."""
    met = corners(faces).join(vertices.select("vertex", "x", "y", "z"), "vertex")
    own = [F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in range(3) for c in "xyz"]
    return met.groupBy("face_id").agg(*own).where(" and ".join(f"{c}{k} is not null" for k in range(3) for c in "xyz"))


def _unit(df: DataFrame, *keys: str) -> DataFrame:
    """keys..., nx, ny, nz divided by their length; zero vectors are left out."""
    return df.withColumn("_l", F.sqrt(F.expr("nx * nx + ny * ny + nz * nz"))).where("_l > 0").select(*keys, *[(F.col(c) / F.col("_l")).alias(c) for c in ("nx", "ny", "nz")])


def face_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """face_id, nx, ny, nz (unit length); faces without area have none."""
    cross = lambda u, v: F.expr(f"({u}1 - {u}0) * ({v}2 - {v}0) - ({v}1 - {v}0) * ({u}2 - {u}0)")
    return _unit(_placed(faces, vertices).select("face_id", cross("y", "z").alias("nx"), cross("z", "x").alias("ny"), cross("x", "y").alias("nz")), "face_id")


def smooth(vertices: DataFrame, faces: DataFrame, threshold: float = 0.8, rounds: int = 3, moves: int = 6) -> DataFrame:
    """Vertices of a mesh smoothed without rounding its edges off.

    In each round a face's normal becomes the sum of the normals of all faces that share a vertex with it, itself too,
    weighted by (cosine - threshold)² where the cosine is above the threshold, at unit length. In each move a vertex goes
    by the mean, over its faces, of the way to the face's centre along its normal. Pairs of faces are a table, written
    once; a vertex with many faces makes pairs with the square of their number, which planar meshes keep small (six
    faces a vertex on average). Vertices without faces stay. A NULL coordinate leaves out the vertex's faces.
    """
    at = corners(faces).select("face_id", "vertex")
    pairs = _cut(at.join(at.select(F.col("face_id").alias("other"), "vertex"), "vertex").select("face_id", "other").distinct())
    normals = _cut(face_normals(faces, vertices))
    for _ in range(rounds):
        own = normals.select("face_id", *[F.col(f"n{c}").alias(f"m{c}") for c in "xyz"])
        met = pairs.join(own, "face_id").join(normals.withColumnRenamed("face_id", "other"), "other")
        met = met.withColumn("_d", F.expr("nx * mx + ny * my + nz * mz") - threshold).where("_d > 0")
        normals = _cut(_unit(met.groupBy("face_id").agg(*[F.sum(F.col("_d") * F.col("_d") * F.col(c)).alias(c) for c in ("nx", "ny", "nz")]), "face_id"))
    # the way along a normal n is n (n . centre) - (n n') vertex: the second factor's sums don't change from move to move
    spread = at.join(normals, "face_id")
    sums = {u + v: F.sum(F.col(f"n{u}") * F.col(f"n{v}")) for u, v in ("xx", "xy", "xz", "yy", "yz", "zz")}
    fixed = _cut(spread.groupBy("vertex").agg(F.count(F.lit(1)).alias("_n"), *[s.alias(f"_{k}") for k, s in sums.items()]))
    now = vertices.select("vertex", "x", "y", "z")
    for _ in range(moves):
        centres = at.join(now, "vertex").groupBy("face_id").agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"])
        along = normals.join(centres, "face_id").select("face_id", "nx", "ny", "nz", F.expr("nx * cx + ny * cy + nz * cz").alias("_t"))
        pull = at.join(along, "face_id").groupBy("vertex").agg(*[F.sum(F.col(f"n{c}") * F.col("_t")).alias(f"_p{c}") for c in "xyz"])
        met = now.join(fixed.join(pull, "vertex"), "vertex", "left")
        step = {"x": "_px - (_xx * x + _xy * y + _xz * z)", "y": "_py - (_xy * x + _yy * y + _yz * z)", "z": "_pz - (_xz * x + _yz * y + _zz * z)"}
        now = _cut(met.select("vertex", *[(F.col(c) + F.coalesce(F.expr(f"({e}) / _n"), F.lit(0.0))).alias(c) for c, e in step.items()]))
    return now


def sample_mesh(vertices: DataFrame, faces: DataFrame, axes: Axes) -> DataFrame:
    """row, col, val: height of the mesh at every cell centre that a face covers (of several faces the one with the
    least number). A face meets the cells of its own box alone; no face covers anything outside the mesh."""
    p = _placed(faces, vertices)
    area = "((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0))"
    ends = lambda f, c: f(*[F.col(f"{c}{k}") for k in range(3)])
    first = lambda v, n: F.greatest(F.ceil(v - 1e-9), F.lit(1)).cast("int")
    last = lambda v, n: F.least(F.floor(v + 1e-9), F.lit(n)).cast("int")
    span = lambda a, b: F.explode(F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>")))
    col = lambda v: (v - axes.x0) / axes.dx + 1
    row = lambda v: (F.lit(axes.y0) - v) / axes.dy + 1
    p = p.where(F.expr(area) != 0).withColumn("row", span(first(row(ends(F.greatest, "y")), axes.nrows), last(row(ends(F.least, "y")), axes.nrows)))
    p = p.withColumn("col", span(first(col(ends(F.least, "x")), axes.ncols), last(col(ends(F.greatest, "x")), axes.ncols)))
    p = p.withColumns({"x": F.lit(axes.x0) + (F.col("col") - 1) * axes.dx, "y": F.lit(axes.y0) - (F.col("row") - 1) * axes.dy})
    p = p.withColumns({"u": F.expr(f"((x - x0) * (y2 - y0) - (x2 - x0) * (y - y0)) / {area}"), "v": F.expr(f"((x1 - x0) * (y - y0) - (x - x0) * (y1 - y0)) / {area}")})
    p = p.where("u >= -1e-9 and v >= -1e-9 and u + v <= 1 + 1e-9")
    return p.groupBy("row", "col").agg(F.min_by(F.expr("z0 + u * (z1 - z0) + v * (z2 - z0)"), F.col("face_id")).alias("val"))


def denoise(grid: DataFrame, axes: Axes, threshold: float = 0.8, rounds: int = 3, moves: int | None = None) -> DataFrame:
    """The grid (row, col, val) smoothed as a mesh and sampled again at its cells with values; twice as many moves as
    rounds, unless stated. Gaps aren't bridged by faces. A rim cell from which the mesh has drawn back, and a cell
    without faces, has its own vertex's height."""
    vertices, faces = grid_mesh(grid, axes)
    faces = _cut(faces)
    moved = smooth(vertices, faces, threshold, rounds, 2 * rounds if moves is None else moves)
    own = moved.select((F.pmod(F.col("vertex") - 1, F.lit(axes.nrows)) + 1).cast("int").alias("row"), (F.floor((F.col("vertex") - 1) / axes.nrows) + 1).cast("int").alias("col"), F.col("z").alias("_own"))
    met = own.join(sample_mesh(moved, faces, axes), ["row", "col"], "left")
    return met.select("row", "col", F.coalesce("val", "_own").alias("val"))
