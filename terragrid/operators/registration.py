"""Registration of point clouds: point-to-plane alignment over a pyramid of samples with exact nearest points."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.projections import apply_matrix
from ..functions.semantics import hash_order
from .estimators import plane_step
from .grid import _cut
from .spatial import nearest, one_to_one
from .stats import mad_threshold

_XYZ = ("x", "y", "z")


def _scaled(points: DataFrame, centre: list[float], size: float) -> DataFrame:
    return points.withColumns({c: (F.col(c) - o) * size for c, o in zip(_XYZ, centre)})


def icp_pyramid(points: DataFrame, model: DataFrame, levels: int = 8, iterations: int = 100, tolerance: float = 0.05, reject: float = 3.0, least: int = 50) -> np.ndarray:
    """3 x 4 motion of points (id, x, y, z) onto a surface given as points with normals (id, x, y, z, nx, ny, nz).

    Level k works on one point in 2 ** k (by hash, so levels are nested; levels of under ``least`` points are left out),
    from the coarsest on, with iterations / 2 ** k rounds and a tolerance that grows with (k + 1) squared. A round finds
    each point's nearest model point, whatever the distance, drops pairs beyond the median distance plus ``reject``
    robust deviations, keeps a model point's nearest partner only, and solves point-to-plane. A level ends when the
    mean distance changes by less than its tolerance, and hands on its best pose. Points with a missing value don't
    count. Coordinates are centred and scaled to a mean distance of one. Samples and pairs are written to the
    checkpoint folder; the driver gets sums.
    """
    there = lambda d: " and ".join(f"{c} is not null and not isnan({c})" for c in d.columns if c != "id")
    points, model = points.select("id", *_XYZ), model.select("id", *_XYZ, "nx", "ny", "nz")
    points, model = points.where(there(points)), model.where(there(model))
    means = [d.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in _XYZ]).head() for d in (points, model)]
    if not all(m.n for m in means):
        raise ValueError("there are no points to align")
    centre = [(means[0][c] + means[1][c]) / 2 for c in _XYZ]
    away = points.select(*_XYZ).union(model.select(*_XYZ)).agg(F.avg(F.sqrt(sum(((F.col(c) - o) * (F.col(c) - o) for c, o in zip(_XYZ, centre)), F.lit(0.0))))).head()[0]
    size = 1 / away if away else 1.0
    model, points = _cut(_scaled(model, centre, size)), _cut(_scaled(points, centre, size))
    ends = model.agg(*[f(c) for c in _XYZ for f in (F.min, F.max)]).head()
    # buckets that hold a few points each if the model is a surface over its two longer sides
    sides = sorted((ends[2 * i + 1] - ends[2 * i] for i in range(3)), reverse=True)
    bucket = max(2 * math.sqrt(max(sides[0] * sides[1], 1e-12) / means[1].n), 1e-6)
    target = model.select("id", *_XYZ)
    there_ = model.select(F.col("id").alias("rid"), *[F.col(c).alias(f"t{c}") for c in _XYZ], "nx", "ny", "nz")
    total = np.eye(3, 4)
    for level in reversed(range(levels)):
        some = _cut(points.where(hash_order(F.col("id"), 0) < (1 << 32) // 2**level)) if level else points
        if level and some.count() < least:
            continue
        last, best = None, (math.inf, total)
        for _ in range(max(1, math.ceil(iterations / 2**level))):
            moved = some.select("id", *[c.alias(n) for n, c in zip(_XYZ, apply_matrix(total, *[F.col(c) for c in _XYZ]))])
            pairs = _cut(nearest(moved, target, bucket, 1, _XYZ))
            limit = mad_threshold(pairs, "distance", reject).head().threshold
            one = one_to_one(pairs.where(F.col("distance") <= limit + 1e-12), "rid")
            met = _cut(moved.join(one.select("id", "rid", "distance"), "id").join(there_, "rid"))
            error = met.agg(F.avg("distance")).head()[0]
            if error < best[0]:
                best = error, total
            if last is not None and abs(error / max(last, 1e-300) - 1) < tolerance * (level + 1) ** 2:
                break
            last, step = error, plane_step(met)
            total = np.column_stack([step[:, :3] @ total[:, :3], step[:, :3] @ total[:, 3] + step[:, 3]])
        total = best[1]
    c = np.array(centre)
    return np.column_stack([total[:, :3], c - total[:, :3] @ c + total[:, 3] / size])
