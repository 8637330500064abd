"""Tables of rasters, windows and polygons; text fields of coordinate systems; sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semantics import nodata_short, saturate


def files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """path, length and modificationTime of files below a folder whose names end in ``suffix``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.where(F.col("path").endswith(suffix)).select("path", "length", "modificationTime")


def wkt_field(text: Column, field: str) -> Column:
    """The quoted name that follows a keyword of a coordinate system's text; empty if there is none."""
    return F.regexp_extract(text, rf'{field}\["([^"]*)"', 1)


def check_wgs84(texts: DataFrame) -> DataFrame:
    """Rows (path, text) whose system isn't WGS84 over Greenwich, with the reason."""
    low = lambda f: F.lower(wkt_field(F.col("text"), f))
    wrong = F.when(~low("GEOGCS").isin("gcs_wgs_1984", "wgs 84", "wgs84"), "system").when(~low("SPHEROID").isin("wgs_1984", "wgs 84"), "ellipsoid").when(low("PRIMEM") != "greenwich", "meridian")
    return texts.withColumn("reason", wrong).where("reason is not null")


def pair_windows(left: DataFrame, right: DataFrame, points: DataFrame) -> DataFrame:
    """Windows with both sides and with points, by window_id."""
    both = left.join(right, ["region_id", "window_id"])
    return both.join(points.select("window_id").distinct(), "window_id", "left_semi")


def ready(windows: DataFrame, column: str = "vertical_rmse") -> DataFrame:
    return windows.where(F.col(column).isNotNull())


def write_elevation(cells: DataFrame, path: str) -> None:
    """16-bit cells, a folder for each region and window; rewriting a window leaves the others."""
    out = cells.withColumn("z", nodata_short(F.col("val"))).drop("val")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("region_id", "window_id").parquet(path)


def write_image(cells: DataFrame, path: str) -> None:
    """8-bit cells in the same layout."""
    out = cells.withColumn("val", saturate(F.col("val"), 0, 255, "short"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("region_id", "window_id").parquet(path)


def camera_constants(images: DataFrame, scan_um: float = 7.0, focal_um: float = 304_800.0) -> DataFrame:
    """Images (width, height) with focal length in pixels and the principal point."""
    return images.withColumns({"focal_px": F.lit(focal_um / scan_um), "pp_x": F.col("width") / 2, "pp_y": F.col("height") / 2})


def window_tiles(x0: int, y0: int, x1: int, y1: int, spark: SparkSession, size: int = 4400, buffer: int = 300) -> DataFrame:
    """window_id and pixel limits of about ``size`` x ``size`` windows with a buffer, held within the region."""
    nx, ny = max(1, round((x1 - x0 + 1) / size)), max(1, round((y1 - y0 + 1) / size))
    sx, sy = (x1 - x0 + 1) / nx, (y1 - y0 + 1) / ny
    k, j = (F.col("id") % nx), F.floor(F.col("id") / nx)
    edge = lambda v, lo, hi: F.greatest(F.least(F.round(v).cast("int"), F.lit(hi)), F.lit(lo))
    return spark.range(nx * ny).select((F.col("id") + 1).cast("int").alias("window_id"), edge(x0 + k * sx - buffer, x0, x1).alias("x0"), edge(y0 + j * sy - buffer, y0, y1).alias("y0"), edge(x0 + (k + 1) * sx - 1 + buffer, x0, x1).alias("x1"), edge(y0 + (j + 1) * sy - 1 + buffer, y0, y1).alias("y1"))


def image_tiles(images: DataFrame, size: int = 4400, buffer: int = 300) -> DataFrame:
    """image_id, window_id (from 1) and pixel limits of the windows of every image (image_id, width, height), of about
    ``size`` x ``size`` pixels with a buffer, held within the image."""
    many = lambda c: F.greatest(F.lit(1), F.round(F.col(c) / size)).cast("int")
    w = images.withColumns({"_nx": many("width"), "_ny": many("height")}).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_nx") * F.col("_ny") - 1)))
    step = {"x": F.col("width").cast("double") / F.col("_nx"), "y": F.col("height").cast("double") / F.col("_ny")}
    place = {"x": F.col("_k") % F.col("_nx"), "y": F.floor(F.col("_k") / F.col("_nx"))}
    edge = lambda v, side: F.greatest(F.least(F.round(v), F.col(side) - 1.0), F.lit(0.0)).cast("int")
    low = [edge(place[a] * step[a] - buffer, s).alias(f"{a}0") for a, s in (("x", "width"), ("y", "height"))]
    high = [edge((place[a] + 1) * step[a] - 1 + buffer, s).alias(f"{a}1") for a, s in (("x", "width"), ("y", "height"))]
    return w.select("image_id", (F.col("_k") + 1).cast("int").alias("window_id"), *low, *high)
