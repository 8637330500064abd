"""Automatic control points: keypoints by extremum votes over growing windows, ring descriptors, matches over scales."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .estimators import Similarity, ransac
from .grid import Axes, _cut, bilinear
from .spatial import match


def growing_windows(nrows: int, ncols: int, size: int) -> list[int]:
    """Edge lengths of the search windows: from one and a half times ``size`` up by half of it, as often as that half
    goes into the shorter side of the grid."""
    grow = max(1, math.floor(size / 2 + 0.5))
    return [w for w in (size + grow * k for k in range(1, math.floor(min(nrows, ncols) / grow + 0.5) + 1)) if w < max(nrows, ncols)]


def extremum_votes(grid: DataFrame, axes: Axes, size: int) -> DataFrame:
    """row, col, n_max, n_min: how many search windows of growing sizes, each a quarter of its size apart, have their
    first (by column, then row) maximum or minimum at a cell. Windows of which over half is missing don't vote.

    A cell asks each size's windows that hold it; window sizes and places are rows of one aggregation.
    """
    sizes = [(w, max(1, math.floor(w / 4 + 0.5))) for w in growing_windows(axes.nrows, axes.ncols, size)]
    if not sizes:
        return grid.select("row", "col", F.lit(0).alias("n_max"), F.lit(0).alias("n_min")).limit(0)

    w, hop = F.col("w"), F.col("hop")

    def starts(c: str, n: int) -> Column:
        """Numbers of the windows that hold cell c and end before the grid's last cell; each begins a hop further."""
        first, last = F.greatest(F.lit(0), F.ceil((F.col(c) - w) / hop)), F.least(F.floor((F.col(c) - 1) / hop), F.floor((F.lit(n) - w - 1) / hop))
        return F.when(last >= first, F.sequence(first, last))

    held = grid.where("val is not null").select("row", "col", "val", F.explode(F.array(*[F.struct(F.lit(a).alias("w"), F.lit(h).alias("hop")) for a, h in sizes])).alias("s"))
    tiles = held.select("row", "col", "val", "s.*").withColumn("r", F.explode(starts("row", axes.nrows))).withColumn("c", F.explode(starts("col", axes.ncols)))
    found = tiles.groupBy("w", "r", "c").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("val", (-F.col("col")).alias("c"), (-F.col("row")).alias("r"))).alias("a"), F.min(F.struct("val", F.col("col").alias("c"), F.col("row").alias("r"))).alias("b"))
    found = found.where(F.col("n") * 2 >= F.col("w") * F.col("w"))
    vote = F.explode(F.array(F.struct((-F.col("a.r")).alias("row"), (-F.col("a.c")).alias("col"), F.lit(1).alias("hi")), F.struct(F.col("b.r").alias("row"), F.col("b.c").alias("col"), F.lit(0).alias("hi"))))
    return found.select(vote.alias("v")).groupBy("v.row", "v.col").agg(F.sum("v.hi").alias("n_max"), F.sum(1 - F.col("v.hi")).alias("n_min"))


def most_voted(votes: DataFrame, axes: Axes, n: int) -> DataFrame:
    """row, col of the n cells with the most votes as a maximum and of the n with the most as a minimum (ties: the later
    cell by column, then row), each cell once."""
    one = lambda c: votes.where(F.col(c) > 0).orderBy(F.desc(c), F.desc("col"), F.desc("row")).limit(n).select("row", "col")
    return one("n_max").union(one("n_min")).distinct()


def ring_samples(grid: DataFrame, axes: Axes, keypoints: DataFrame, radii: list[float], angles: int = 360) -> DataFrame:
    """id, ring, k and z of ``angles`` positions (the last is the first again) on each ring around each keypoint (id,
    row, col), sampled between cells; NULL outside the grid and beside a missing cell."""
    ring = F.explode(F.array(*[F.struct(F.lit(i).alias("ring"), F.lit(float(r)).alias("radius")) for i, r in enumerate(radii)]))
    step = 2 * math.pi / max(1, angles - 1)
    places = keypoints.select("id", "row", "col", ring.alias("s")).select("id", "row", "col", "s.*", F.explode(F.sequence(F.lit(0), F.lit(angles - 1))).alias("k"))
    theta = F.col("k") * step
    unit = Axes(1.0, float(axes.nrows), 1.0, 1.0, axes.ncols, axes.nrows)  # columns eastward, rows southward from 1
    x, y = F.col("col") + F.col("radius") * F.cos(theta), F.lit(float(axes.nrows + 1)) - (F.col("row") + F.col("radius") * F.sin(theta))
    asked = places.select("id", "ring", "k", ((F.col("id").cast("long") * len(radii) + F.col("ring")) * angles + F.col("k")).alias("pt_id"), x.alias("x"), y.alias("y"))
    return bilinear(asked, grid, unit, "z").select("id", "ring", "k", "z")


def ring_descriptors(grid: DataFrame, axes: Axes, keypoints: DataFrame, radii: list[float], angles: int = 360) -> DataFrame:
    """id and d (angles x rings numbers) of the keypoints (id, row, col) all of whose samples have a value.

    Each ring's samples are turned so that its first maximum comes first, divided by their standard deviation (n - 1)
    and centred; so the descriptor doesn't change if the surface turns, shifts or is stretched upward. A ring without
    variation has none.
    """
    rings = ring_samples(grid, axes, keypoints, radii, angles).groupBy("id", "ring").agg(F.array_sort(F.collect_list(F.struct("k", "z"))).alias("s"), F.count("z").alias("n"), F.stddev_samp("z").alias("sd"), F.avg("z").alias("mean"))
    z = F.transform("s", lambda x: x["z"])
    near = F.transform("s", lambda x: F.round(x["z"], 9))  # the first and the last sample stand at one place
    first = F.array_position(near, F.array_max(near)).cast("int")
    turned = F.concat(F.slice(z, first, angles), F.slice(z, 1, first - 1))
    scaled = rings.where((F.col("n") == angles) & (F.col("sd") > 0)).select("id", "ring", "sd", "mean", turned.alias("z")).select("id", "ring", F.transform("z", lambda v: (v - F.col("mean")) / F.col("sd")).alias("d"))
    whole = scaled.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ring", "d"))).alias("all"))
    return whole.where(F.size("all") == len(radii)).select("id", F.flatten(F.transform("all", lambda x: x["d"])).alias("d"))


def control_points(moving: DataFrame, moving_axes: Axes, reference: DataFrame, reference_axes: Axes, scales: list[float] | None = None, most: tuple[int, int] = (500, 5000), inlier: float = 25.0, hypotheses: int = 500, angles: int = 360, seed: int = 0) -> tuple[float, Similarity, DataFrame]:
    """Pairs of positions of a moving grid and a reference grid (cells row, col, val without holes; rough placement of
    the moving one not needed) that agree on a planar similarity: the chosen scale, the similarity, and the inliers
    (pt_id, x, y, tx, ty) in the two axes' units.

    Keypoints are the cells most often an extremum of growing windows; the reference's rings are tried at each scale,
    the moving grid's aren't. Each moving keypoint is paired with the nearest descriptor, for all scales in one join,
    and RANSAC (``inlier`` in cells) judges each scale's pairs. The scale with the most inliers wins (ties: the first).
    """
    scales = scales or [round(0.5 + 0.1 * i, 1) for i in range(11)]
    size = max(2, math.floor((reference_axes.nrows + reference_axes.ncols) / 40 + 0.5))
    radius = (moving_axes.nrows + moving_axes.ncols) / 40
    radii = [max(1.0, math.floor(r + 0.5)) for r in (radius / 2, radius, 2 * radius)]
    place = lambda a: F.xxhash64("row", "col").bitwiseAND((1 << 40) - 1) if a is None else (F.col("col").cast("long") - 1) * a.nrows + F.col("row")
    points = lambda g, a, n: _cut(most_voted(extremum_votes(g, a, size), a, n).withColumn("id", place(a)))
    ours, theirs = points(moving, moving_axes, most[0]), points(reference, reference_axes, most[1])
    asked = ring_descriptors(moving, moving_axes, ours, radii, angles)
    asked = asked.select("id", "d", F.explode(F.lit(list(range(len(scales))))).alias("scale"))
    known = None
    for i, s in enumerate(scales):
        d = ring_descriptors(reference, reference_axes, theirs, [r * s for r in radii], angles).withColumn("scale", F.lit(i))
        known = d if known is None else known.unionByName(d)
    pairs = match(_cut(asked), _cut(known), ["scale"], "squared")
    at = lambda axes, c, names: ((F.floor((F.col(c) - 1) / axes.nrows) * axes.dx + axes.x0).alias(names[0]), (F.lit(axes.y0) - F.pmod(F.col(c) - 1, F.lit(axes.nrows)) * axes.dy).alias(names[1]))
    pairs = _cut(pairs.select("scale", F.col("id").alias("pt_id"), *at(moving_axes, "id", ("x", "y")), *at(reference_axes, "tid", ("tx", "ty"))))
    best = None
    for i, s in enumerate(scales):
        try:
            found, inliers = ransac(pairs.where(F.col("scale") == i).drop("scale"), inlier * (reference_axes.dx + reference_axes.dy) / 2, hypotheses, seed)
        except ValueError:  # too few pairs agree at this scale
            continue
        n = inliers.count()
        if best is None or n > best[0]:
            best = n, s, found, inliers
    if best is None:
        raise ValueError("no scale has three pairs that agree")
    return best[1:]
