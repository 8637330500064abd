"""Validity rules, acceptance gates and selections over points, cells, windows and matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import holds


def slope_window(face: DataFrame, low: float = 5.0, high: float = 75.0) -> DataFrame:
    """Cells whose slope lies strictly between two angles: flat and steep ground says little about a shift."""
    return face.where((F.col("slope") > low) & (F.col("slope") < high))


def cut_outliers(points: DataFrame, z: str, reference: str, most: float = 200.0) -> DataFrame:
    """``z`` becomes NULL where it is more than ``most`` away from the reference; without a reference it stays."""
    return points.withColumn(z, F.when(~holds(F.abs(F.col(z) - F.col(reference)) > most), F.col(z)))


def position_faults(points: DataFrame, low: float = -500.0, high: float = 9000.0) -> DataFrame:
    """Rows (lon, lat, z, ...) with a missing or impossible entry, and the first fault found."""
    bad = lambda c, a, b: ~holds(F.col(c).between(a, b))
    fault = F.when(bad("lon", -180, 180), "longitude").when(bad("lat", -90, 90), "latitude").when(~holds((F.col("z") > low) & (F.col("z") < high)), "elevation")
    return points.withColumn("fault", fault).where("fault is not null")


def coverage(points: DataFrame, windows: DataFrame, by: str, value: str, least: float = 0.33) -> DataFrame:
    """by, n, share and covered: whether ``least`` or more of a window's expected points have a value. Windows (by,
    expected) without points have none of them."""
    found = points.groupBy(by).agg(F.count(value).alias("n"))
    out = windows.join(found, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.coalesce(F.try_divide(F.col("n"), F.col("expected")), F.lit(0.0))
    return out.select(by, "n", share.alias("share"), (share >= least).alias("covered"))


def against_coarser(fine: DataFrame, coarse: DataFrame, factor: int, most: float = 50.0, fill: bool = True) -> DataFrame:
    """row, col, val of a pyramid level: values more than ``most`` from the coarser level's are missing; with ``fill``
    missing ones are taken from there."""
    up = lambda c: (F.floor((F.col(c) - 1) / factor) + 1).cast("int")
    low = coarse.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("val").alias("_v"))
    met = fine.join(low, (up("row") == F.col("_r")) & (up("col") == F.col("_c")), "left")
    kept = F.when(~holds(F.abs(F.col("val") - F.col("_v")) > most), F.col("val"))
    return met.select("row", "col", (F.coalesce(kept, "_v") if fill else kept).alias("val"))


def inside_image(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes (x0, y0, x1, y1, from 1) with an extent that lie within the image."""
    return boxes.where((F.col("x0") >= 1) & (F.col("y0") >= 1) & (F.col("x1") <= width) & (F.col("y1") <= height) & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")))


def blank_text(value: Column, above: float = 250) -> Column:
    """Labels burnt into film are white: brighter values become 0."""
    return F.when(value > above, 0).otherwise(value)


def facing(points: DataFrame, by: list[str], depths: list[str], least: float = 0.95) -> DataFrame:
    """by..., the percentage of points in front of each camera, and facing: whether more than ``least`` are for all."""
    shares = [F.avg(F.when(holds(F.col(d) > 0), 1.0).otherwise(0.0)) for d in depths]
    out = points.groupBy(*by).agg(*[s.alias(f"_{d}") for s, d in zip(shares, depths)])
    good = F.lit(True)
    for d in depths:
        good = good & (F.col(f"_{d}") > least)
    return out.select(*by, *[(F.col(f"_{d}") * 100).alias(f"percent_{d}") for d in depths], good.alias("facing"))


def single_source(windows: DataFrame, by: str, column: str) -> DataFrame:
    """by and single: whether all of a group's windows name one and the same source (a missing one is a source)."""
    return windows.groupBy(by).agg((F.count_distinct(F.coalesce(F.col(column).cast("string"), F.lit("")), F.col(column).isNull()) == 1).alias("single"))


def complete(df: DataFrame, column: str) -> DataFrame:
    """Rows whose array has no missing entry (nor is missing)."""
    return df.where(holds(F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys... and n of those that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def most_voted(votes: DataFrame, id_: str, column: str, n: int) -> DataFrame:
    """The ``n`` rows with most votes, ties to the higher id."""
    return votes.orderBy(F.desc(column), F.desc(id_)).limit(n)


def vertex_faces(faces: DataFrame, most: int = 10) -> DataFrame:
    """vertex, face_id, place: the first ``most`` faces around each vertex."""
    order = Window.partitionBy("vertex").orderBy("face_id")
    return faces.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def overlap(a: DataFrame, b: DataFrame, by: str, least: float = 10.0) -> DataFrame:
    """by and the common part x0, y0, x1, y1 of two boxes a key, where it is ``least`` wide and high."""
    other = b.select(F.col(by).alias("_by"), *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    met = a.join(other, F.col(by) == F.col("_by")).select(by, F.greatest("x0", "_x0").alias("x0"), F.greatest("y0", "_y0").alias("y0"), F.least("x1", "_x1").alias("x1"), F.least("y1", "_y1").alias("y1"))
    return met.where((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least))


def match_histogram(cells: DataFrame, reference: DataFrame, bins: int = 256) -> DataFrame:
    """id..., val: cell values (0 to ``bins`` - 1, NULL and 0 left as they are) mapped so that their distribution
    becomes the reference's: each value to the first whose share up to it is not below its own."""

    def shares(df: DataFrame) -> DataFrame:
        counted = df.where(F.col("val") > 0).groupBy("val").agg(F.count(F.lit(1)).alias("n"))  # a row a value
        upto, every = Window.orderBy("val"), Window.partitionBy()
        return counted.select("val", F.sum("n").over(upto).alias("upto"), F.sum("n").over(every).alias("n"))

    own, ref = shares(cells), shares(reference).select(F.col("val").alias("to"), F.col("upto").alias("r"), F.col("n").alias("rn"))
    # whole numbers are compared, so shares that are equal are equal; both tables have ``bins`` rows at most
    table = own.join(F.broadcast(ref), F.col("r") * F.col("n") >= F.col("upto") * F.col("rn")).groupBy("val").agg(F.min("to").alias("to"))
    return cells.join(F.broadcast(table), "val", "left").withColumn("val", F.coalesce("to", "val")).drop("to")


def left_to_right(images: DataFrame, by: str, id_: str, axis: tuple[float, float]) -> DataFrame:
    """``images`` (by, id, x, y of the centre) with place: their order along ``axis``, ties by id."""
    along = axis[0] * F.col("x") + axis[1] * F.col("y")
    return images.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(along, id_)))
