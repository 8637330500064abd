"""The stages that users run: georeference a point cloud, rasterize it, sample an orthoimage."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.projections import apply_matrix, curve, ecef_to_geodetic, geodetic_to_ecef, ll_to_utm, rotation, solver_forward, solver_inverse, uncurve, utm_to_ll
from ..functions.semantics import hash_order
from ..operators import estimators as est
from ..operators.checks import coverage, cut_outliers
from ..operators.control import control_points
from ..operators.gaps import inpaint
from ..operators.grid import Axes, _cut, area_open, bilinear, cell_mean, dilate, disk, fill, locate, median, surface
from ..operators.mesh import denoise as smoothed
from ..operators.spatial import inside_polygons, nearest
from ..operators.stats import clip_quantiles_by, quota, sample


@dataclass(frozen=True)
class Step:
    """One transform of a window's points: "matrix" (3 x 4), "solver" (variables) or "curve" (3 x 4, zone, hemisphere)."""

    kind: str
    what: tuple

    def forward(self, points: DataFrame) -> DataFrame:
        x, y, z = F.col("x"), F.col("y"), F.col("z")
        if self.kind == "curve":
            return curve(points, np.asarray(self.what[0]), *self.what[1:])
        moved = apply_matrix(self.what[0], x, y, z) if self.kind == "matrix" else solver_forward(self.what[0], x, y, z)
        return points.withColumns(dict(zip("xyz", moved)))

    def inverse(self, points: DataFrame) -> DataFrame:
        x, y, z = F.col("x"), F.col("y"), F.col("z")
        if self.kind == "curve":
            return uncurve(points, np.asarray(self.what[0]), *self.what[1:])
        if self.kind == "solver":
            return points.withColumns(dict(zip("xyz", solver_inverse(self.what[0], x, y, z))))
        m = np.asarray(self.what[0], float)
        back = np.linalg.inv(m[:, :3])
        return points.withColumns(dict(zip("xyz", apply_matrix(np.column_stack([back, -back @ m[:, 3]]), x, y, z))))


def apply_chain(points: DataFrame, chain: list[Step]) -> DataFrame:
    for step in chain:
        points = step.forward(points)
    return points


def undo_chain(points: DataFrame, chain: list[Step]) -> DataFrame:
    """The exact reverse of ``apply_chain``: the inverses, last step first."""
    for step in reversed(chain):
        points = step.inverse(points)
    return points


#: How far the solver's ten variables may go each way: rotations (degrees), shifts (axis units), axis scales, whole scale.
#: None leaves a variable out.
BOUNDS = {"rotation": (2.0, 2.0, 2.0), "shift": (50.0, 50.0, 50.0), "scale": (0.02, 0.02, 0.02), "whole": 0.02}


def affine(v: dict) -> np.ndarray:
    """Solver variables without a surface as one 3 x 4 matrix."""
    turn, c = rotation(*v["rotation"]) * (np.asarray(v["scale"]) * v["whole"]), np.asarray(v["center"], float)
    return np.column_stack([turn, c + np.asarray(v["shift"]) - turn @ c])


def _small(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """A table of ``rows`` rows (counted), broadcast if there are no more than ``most``."""
    return F.broadcast(df) if rows <= most else df


def apply_each(points: DataFrame, by: list[str], matrices: dict) -> DataFrame:
    """Points (by..., x, y, z, ...) of each group under the group's 3 x 4 matrix; groups without one go."""
    kinds = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in by)
    rows = [(*key, [float(t) for t in np.asarray(m, float).ravel()]) for key, m in matrices.items()]
    table = points.sparkSession.createDataFrame(rows, f"{kinds}, _m array<double>")
    m, xyz = F.col("_m"), [F.col(c) for c in "xyz"]
    moved = {n: sum((m[4 * r + k] * c for k, c in enumerate(xyz)), m[4 * r + 3]) for r, n in enumerate("xyz")}
    return points.join(_small(table, len(rows)), by).withColumns(moved).drop("_m")


def at_places(points: DataFrame, by: list[str], apart: bool = False) -> DataFrame:
    """by..., x, y, z (mean), n (elevations) and points of each place; with ``apart`` of each elevation by itself."""
    if apart:
        return points.groupBy(*by, "x", "y", "z").agg(F.count("z").alias("n"), F.count(F.lit(1)).alias("points"))
    return points.groupBy(*by, "x", "y").agg(F.avg("z").alias("z"), F.count("z").alias("n"), F.count(F.lit(1)).alias("points"))


def trial_errors(points: DataFrame, by: list[str], trials: dict, reference: DataFrame, axes: Axes, clip: tuple[float, float] | None = (0.05, 0.95), placed: bool = False, few: bool = False) -> DataFrame:
    """by..., trial, n, sse and rmse of every trial (a list of 3 x 4 matrices for each group) at once.

    Every point of a group goes through each of its trials; means by cell, differences from the reference, the clip
    between two quantiles and the sums are grouped by trial, so the number of jobs doesn't depend on groups or trials.
    If no trial moves a point sideways by its elevation, points at one place stay together and have their mean's
    elevation, so they are put together first (``placed``: ``points`` is what ``at_places`` gives). With ``few``
    reference cells these are broadcast, and a trial's differences, which are no more than they, are sorted as an array.
    """
    if not placed:
        points = at_places(points, by, any(m[0][2] or m[1][2] for ms in trials.values() for m in ms))
    flat = [(*key, [tuple(float(t) for t in np.asarray(m, float).ravel()) for m in ms]) for key, ms in trials.items()]
    kinds = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in by)
    table = points.sparkSession.createDataFrame(flat, f"{kinds}, _ms array<struct<{', '.join(f'_{i}: double' for i in range(12))}>>")
    each = points.join(_small(table, sum(len(r[-1]) for r in flat)), by).where("n > 0").select(*by, "x", "y", "z", F.col("n").alias("_n"), F.posexplode("_ms").alias("trial", "_m"))
    m, xyz = [F.col(f"_m._{i}") for i in range(12)], [F.col(c) for c in "xyz"]
    moved = each.select(*by, "trial", "_n", *[sum((m[4 * r + k] * c for k, c in enumerate(xyz)), m[4 * r + 3]).alias(n) for r, n in enumerate("xyz")])
    keys = [*by, "trial"]
    cells = locate(moved, axes).groupBy(*keys, "row", "col").agg((F.sum(F.col("z") * F.col("_n")) / F.sum("_n")).alias("val"))
    ref = reference.select("row", "col", F.col("val").alias("_ref"))
    met = cells.join(F.broadcast(ref) if few else ref, ["row", "col"])
    diff = met.select(*keys, (F.col("_ref") - F.col("val")).alias("d")).where("d is not null")
    if few:
        every = diff.groupBy(*keys).agg(F.sort_array(F.collect_list("d")).alias("_d"))
        if clip:
            n, all_ = F.size("_d"), F.col("_d")
            for name, q in zip(("_lo", "_hi"), clip):  # Hazen's, as clip_quantiles_by
                place = F.greatest(F.least(n * q + 0.5, n.cast("double")), F.lit(1.0))
                first = F.floor(place).cast("int")
                low, high = all_[first - 1], all_[F.least(first + 1, n) - 1]
                every = every.withColumn(name, low + (high - low) * (place - first))
            every = every.withColumn("_d", F.filter("_d", lambda d: d.between(F.col("_lo"), F.col("_hi"))))
        every = every.select(*keys, F.size("_d").cast("long").alias("n"), F.aggregate("_d", F.lit(0.0), lambda s, d: s + d * d).alias("sse"))
        return every.withColumn("rmse", F.sqrt(F.col("sse") / F.col("n")))
    kept = clip_quantiles_by(_cut(diff), "d", keys, *clip) if clip else diff  # once: other orders give other sums
    d = F.col("d")
    return kept.groupBy(*keys).agg(F.count("d").alias("n"), F.sum(d * d).alias("sse"), F.sqrt(F.avg(d * d)).alias("rmse"))


def optimise_each(points: DataFrame, by: list[str], reference: DataFrame, axes: Axes, mask: DataFrame | None = None, bounds: dict = BOUNDS, rounds: int = 200, settled: float = 0.1, clip: tuple[float, float] | None = (0.05, 0.95)) -> dict:
    """For each group of points (by..., x, y, z) the solver variables that take it nearest to the reference, their
    vertical error and the log of errors, by key (a tuple).

    A simplex a group over the variables scaled to -1..1 within their bounds, outside of which the error is infinite.
    All groups' simplexes move in step: a round is one grouped job over the sample, which is written once (equal points
    together, by place unless the bounds let points tilt) in as many parts as a shuffle has, as its trials are many
    times its bytes. The driver holds the simplexes (eleven points a group). A group without points has no entry; one
    that nowhere meets the reference has an infinite error.
    """
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = _cut(at_places(points, by, any((bounds.get("rotation") or ())[:2])).repartition(parts))
    if mask is not None:
        reference = reference.join(mask.select("row", "col").distinct(), ["row", "col"], "left_anti")
    reference = _cut(reference.select("row", "col", "val").where("val is not null"))
    few = reference.count() <= 100_000
    mean = lambda c, w: F.try_divide(F.sum(F.col(c) * F.col(w)), F.sum(F.when(F.col(c).isNotNull(), F.col(w))))
    centres = {tuple(r[c] for c in by): [float(r[c]) for c in ("_x", "_y", "_z")] for r in points.groupBy(*by).agg(*[mean(c, w).alias(f"_{c}") for c, w in zip("xyz", ("points", "points", "n"))]).collect() if r["_x"] is not None and r["_z"] is not None}  # a row a group
    slots = [(name, i, b) for name in ("rotation", "shift", "scale") for i, b in enumerate(bounds.get(name) or (None,) * 3) if b] + ([("whole", None, bounds["whole"])] if bounds.get("whole") else [])

    def variables(key: tuple, u: np.ndarray) -> dict:
        v = {"center": centres[key], "rotation": [0.0] * 3, "shift": [0.0] * 3, "scale": [1.0] * 3, "whole": 1.0, "surface": None}
        for (name, i, b), x in zip(slots, u):
            if i is None:
                v[name] += float(x) * b
            else:
                v[name][i] += float(x) * b
        return v

    def errors(asked: dict) -> dict:
        out = {key: [float("inf")] * len(us) for key, us in asked.items()}
        within = {key: [i for i, u in enumerate(us) if np.abs(u).max(initial=0.0) <= 1] for key, us in asked.items()}
        trials = {key: [affine(variables(key, asked[key][i])) for i in at] for key, at in within.items() if at}
        if trials:
            for r in trial_errors(points, by, trials, reference, axes, clip, True, few).collect():  # a row a trial
                key = tuple(r[c] for c in by)
                out[key][within[key][r.trial]] = float("inf") if r.rmse is None else r.rmse
        return out

    moves = {key: est.simplex_moves(np.zeros(len(slots)), np.full(len(slots), 0.25), rounds, settled) for key in centres}
    return {key: (variables(key, best), value, log) for key, (best, value, log) in est.together(moves, errors).items()}


def optimise(points: DataFrame, reference: DataFrame, axes: Axes, mask: DataFrame | None = None, bounds: dict = BOUNDS, rounds: int = 200, settled: float = 0.1, clip: tuple[float, float] | None = (0.05, 0.95)) -> tuple[dict, float, list]:
    """``optimise_each`` for one group of points."""
    found = optimise_each(points.withColumn("fit_group", F.lit(0)), ["fit_group"], reference, axes, mask, bounds, rounds, settled, clip)
    if not found:
        raise ValueError("no points to fit")
    return found[0,]


def near_reference(points: DataFrame, by: list[str], reference: DataFrame, axes: Axes, most: float = 50.0) -> DataFrame:
    """Points (by..., pt_id, x, y, z) at which the reference differs by less than ``most`` from the group's own cell
    means (the difference grid sampled between cells)."""
    own = cell_mean(points, axes, by=by)
    diff = own.join(reference.select("row", "col", F.col("val").alias("_ref")), ["row", "col"]).select(*by, "row", "col", (F.col("_ref") - F.col("val")).alias("val"))
    return bilinear(points, diff, axes, "_off", by).where(F.abs("_off") < most).drop("_off")


def fit_curvature(points: DataFrame, by: list[str], zone: int, hemisphere: str, n: int = 100) -> dict:
    """By group the similarity (3 x 4) from the map (x, y, z) to geocentric coordinates over n points in hash order."""
    some = quota(points.withColumn("_group", F.struct(*by)), "_group", "pt_id", n)
    lon, lat = utm_to_ll(F.col("x"), F.col("y"), zone, hemisphere)
    some = some.withColumns({"_lon": lon, "_lat": lat})
    tx, ty, tz = geodetic_to_ecef(F.col("_lon"), F.col("_lat"), F.col("z"))
    return {key: m.matrix for key, m in est.horn_by(some.withColumns({"tx": tx, "ty": ty, "tz": tz}), by[0]).items()}


def curve_each(points: DataFrame, by: str, matrices: dict, zone: int, hemisphere: str) -> DataFrame:
    """``curve`` with a matrix a group."""
    placed = apply_each(points, [by], {(k,): m for k, m in matrices.items()})
    round_ = placed.withColumns(dict(zip("xyz", ecef_to_geodetic(*[F.col(c) for c in "xyz"]))))
    return round_.withColumns(dict(zip("xy", ll_to_utm(F.col("x"), F.col("y"), zone, hemisphere))))


@dataclass(frozen=True)
class Georeference:
    """What georeferencing found: the chain of transforms, the vertical error and the simplex's log."""

    chain: list
    rmse: float
    log: list

    def apply(self, points: DataFrame) -> DataFrame:
        return apply_chain(points, self.chain)


def georeference(points: DataFrame, reference: DataFrame, axes: Axes, mask: DataFrame | None = None, rounds: int = 30, shift_step: float = 10.0, most_rmse: float = 50.0) -> Georeference:
    """Fit points (pt_id, x, y, z) to reference cells (row, col, val): point-to-plane alignment over the reference's
    surface, then the simplex over shifts of up to four times ``shift_step``."""
    face = surface(reference, axes.dx, axes.dy).join(axes.cells(points.sparkSession), ["row", "col"])
    motion = Step("matrix", (est.icp(points, face, axes),))
    solver, value, log = optimise(motion.forward(points), reference, axes, mask, {"shift": (4 * shift_step, 4 * shift_step, 2 * shift_step)}, rounds, 1e-3)
    if value > most_rmse:
        raise ValueError(f"vertical error {value:.1f} is over {most_rmse}")
    return Georeference([motion, Step("solver", (solver,))], value, log)


def automatic_controls(points: DataFrame, rough: Step, reference: DataFrame, axes: Axes, **options) -> DataFrame:
    """Control points (x, y, z in the points' own frame; tx, ty, tz) found by matching the points' surface with the
    reference's: points (pt_id, x, y, z), placed roughly by ``rough``, reference cells (row, col, val).

    Both grids (the points' one has the reference's steps) have their holes filled; ``control_points`` (which takes the
    options) pairs positions. A pair's elevation is the reference's there, and its source is the point nearest in plan.
    """
    placed = _cut(rough.forward(points.select("pt_id", "x", "y", "z")).where("x is not null and y is not null and z is not null"))
    e = placed.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).head()
    if e[0] is None:
        raise ValueError("no points to match")
    own = Axes(e[0], e[3], axes.dx, axes.dy, math.floor((e[1] - e[0]) / axes.dx) + 1, math.floor((e[3] - e[2]) / axes.dy) + 1)
    whole = _cut(inpaint(reference.select("row", "col", "val"), axes))
    surface_ = _cut(inpaint(cell_mean(placed, own).select("row", "col", "val"), own))
    _, _, pairs = control_points(surface_, own, whole, axes, **options)
    pairs = _cut(pairs.select("pt_id", "x", "y", "tx", "ty"))
    there = bilinear(pairs.select("pt_id", F.col("tx").alias("x"), F.col("ty").alias("y")), whole, axes, "tz").select("pt_id", F.col("x").alias("tx"), F.col("y").alias("ty"), "tz").where("tz is not null")
    near = nearest(pairs.select(F.col("pt_id").alias("id"), "x", "y"), placed.select(F.col("pt_id").alias("id"), "x", "y"), max(axes.dx, axes.dy)).select(F.col("id").alias("pt_id"), "rid")
    source = points.select(F.col("pt_id").alias("rid"), "x", "y", "z")
    return there.join(near, "pt_id").join(source, "rid").select("x", "y", "z", "tx", "ty", "tz")


def initial_transform(points: DataFrame, controls: DataFrame | None, reference: DataFrame, axes: Axes, n: int = 1_000_000, rounds: int = 60, most_rmse: float = 50.0, shift: float = 10_000.0, rough: Step | None = None, **options) -> Georeference:
    """A first placement of one window: the similarity through control points (x, y, z, tx, ty, tz), then the simplex
    over wide bounds (45 degrees, ``shift``, whole scale by a factor of two at most; axis scales left out) on a sample.
    Without control points they are found from a ``rough`` placement (see ``automatic_controls`` and its options)."""
    if controls is None:
        if rough is None:
            raise ValueError("give control points, or a rough placement to find them from")
        controls = _cut(automatic_controls(points, rough, reference, axes, **options))
    if controls.limit(3).count() < 3:
        raise ValueError("it takes three control points or more")
    rough = Step("matrix", (est.horn(controls).matrix,))
    some = rough.forward(sample(points, "pt_id", n))
    solver, value, log = optimise(some, reference, axes, None, {"rotation": (45.0,) * 3, "shift": (shift,) * 3, "whole": 0.5}, rounds)
    if value > most_rmse:
        raise ValueError(f"vertical error {value:.1f} of the first placement is over {most_rmse}")
    return Georeference([rough, Step("solver", (solver,))], value, log)


def georeference_regions(points: DataFrame, windows: DataFrame, first: list[Step], reference: DataFrame, axes: Axes, links: DataFrame | None = None, mask: DataFrame | None = None, attempts: int = 3, retry_over: float = 25.0, least: float = 0.33, per_region: int = 1_000_000, most_off: float = 200.0, bounds: dict = BOUNDS, rounds: int = 200, zone: tuple[int, str] | None = None, separately: bool = False, near: float | None = None) -> tuple[DataFrame, DataFrame]:
    """All windows of all regions: placed points (region_id, window_id, pt_id, x, y, z; with a zone lon and lat too) and
    a lineage row a window (region_id, window_id, rmse, attempts, chain as JSON, error).

    points: region_id, window_id, pt_id, x, y, z; windows: region_id, window_id, expected (points); ``first``: the chain
    that places the first window's frame; links: region_id, x, y, z, tx, ty, tz, pairs of a region's frame and that
    first window's. A region takes the windows with ``least`` of their expected points, is aligned to the first by its
    links, bent onto the ellipsoid (with a ``zone`` and hemisphere), and fitted on an even sample of its windows (with
    ``near``, 50 metres say, where it is that close to the reference), again from where it got to while the error is over ``retry_over``
    (``attempts`` times at most); with ``separately`` each window once more by itself. Elevations more than
    ``most_off`` from the reference's become NULL. Windows and regions that fail are recorded with the reason.

    All regions are fitted together (see ``optimise_each``): the number of jobs grows with attempts and rounds, not
    with regions. The driver holds a few matrices a window.
    """
    gate = coverage(points, windows, "window_id", "z", least).join(windows.select("region_id", "window_id"), "window_id").collect()  # a row a window
    rows = [(r.region_id, r.window_id, None, 0, None, f"{r.share:.2f} of the expected points, {least} are needed") for r in gate if not r.covered]
    good: dict = {}
    for r in gate:
        if r.covered:
            good.setdefault(r.region_id, []).append(r.window_id)
    region, window = ["region_id"], ["region_id", "window_id"]
    kept = points.sparkSession.createDataFrame([(r, w, max(1, per_region // len(ws))) for r, ws in good.items() for w in ws], "region_id long, window_id long, _quota long")
    own = points.withColumns({c: F.col(c).cast("long") for c in window}).join(_small(kept, sum(map(len, good.values()))), window)
    chains = {r: list(first) for r in good}
    if links is not None:
        found = {r: m.matrix for r, m in est.horn_by(links, "region_id").items() if r in good}
        chains.update({r: [Step("matrix", (m,)), *first] for r, m in found.items()})
        own = apply_each(own, region, {(r,): found.get(r, np.eye(3, 4)) for r in good})
    own = apply_chain(own, first)
    if zone is not None:
        bent = fit_curvature(own, region, *zone)
        own = curve_each(own, "region_id", bent, *zone)
        chains = {r: [*chains[r], Step("curve", (bent[r], *zone))] for r in bent}
    own = _cut(own)
    order = Window.partitionBy(*window).orderBy(hash_order(F.col("pt_id"), 0), "pt_id")
    some = _cut(own.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= F.col("_quota")).drop("_r", "_quota"))
    fits, tries, motion = {}, dict.fromkeys(chains, 0), {r: np.eye(3, 4) for r in chains}
    compose = lambda a, b: np.column_stack([a[:, :3] @ b[:, :3], a[:, :3] @ b[:, 3] + a[:, 3]])
    close = lambda p, by: p if near is None else near_reference(p, by, reference, axes, near)
    open_ = list(chains)
    while open_:
        now = close(apply_each(some, region, {(r,): motion[r] for r in open_}), region)
        got = optimise_each(now, region, reference, axes, mask, bounds, rounds)
        for (r,), (solver, value, _) in got.items():
            if np.isfinite(value):
                fits[r], tries[r], motion[r] = value, tries[r] + 1, compose(affine(solver), motion[r])
                chains[r] = [*chains[r], Step("solver", (solver,))]
        open_ = [r for r in open_ if np.isfinite(got.get((r,), (0, np.inf))[1]) and fits[r] > retry_over and tries[r] < attempts]
    each = {(r, w): (motion[r], chains[r], fits[r]) for r in fits for w in good[r]}
    if separately and each:
        now = close(apply_each(some, window, {k: m for k, (m, _, _) in each.items()}), window)
        for key, (solver, value, _) in optimise_each(now, window, reference, axes, mask, bounds, rounds).items():
            if np.isfinite(value):
                m, chain, _ = each[key]
                each[key] = compose(affine(solver), m), [*chain, Step("solver", (solver,))], value
    rows += [(r, w, each[r, w][2], tries[r], chain_json(each[r, w][1]), None) if (r, w) in each else (r, w, None, 0, None, "nothing of it is near the reference") for r in good for w in good[r]]
    lineage = points.sparkSession.createDataFrame(rows, "region_id long, window_id long, rmse double, attempts int, chain string, error string")
    moved = apply_each(own, window, {k: m for k, (m, _, _) in each.items()})
    met = moved.withColumns({"row": axes.row_of(F.col("y")), "col": axes.col_of(F.col("x"))}).join(reference.select("row", "col", F.col("val").alias("_ref")), ["row", "col"], "left")
    placed = cut_outliers(met, "z", "_ref", most_off).select(*window, "pt_id", "x", "y", "z")
    if zone is not None:
        placed = placed.withColumns(dict(zip(("lon", "lat"), utm_to_ll(F.col("x"), F.col("y"), *zone))))
    return placed, lineage


def prepare_reference(terrain: DataFrame, vertices: DataFrame, zone: int, hemisphere: str, cell: float = 90.0, reach: int = 3, strip: float = 0.01) -> tuple[Axes, DataFrame, DataFrame]:
    """Axes, reference cells (row, col, val) and mask cells (row, col) on the map for reference elevations given in
    longitude and latitude (lon, lat, val).

    The map grid spans the terrain and a cell more each way. Cells are means of the elevations that fall into them;
    the mask is where any position in a polygon (of unstable ground) falls, grown by ``reach`` cells.
    """
    x, y = ll_to_utm(F.col("lon"), F.col("lat"), zone, hemisphere)
    on_map = _cut(terrain.select("lon", "lat", "val").withColumns({"x": x, "y": y}))
    e = on_map.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).head()
    if e[0] is None:
        raise ValueError("the reference holds no elevation here")
    x0, y1 = math.floor(e[0]) - cell, math.floor(e[2]) - cell
    ncols, nrows = (int((math.ceil(b) + cell - a) // cell) + 1 for a, b in ((x0, e[1]), (y1, e[3])))
    axes = Axes(x0, y1 + (nrows - 1) * cell, cell, cell, ncols, nrows)
    cells = cell_mean(on_map.select("x", "y", F.col("val").alias("z")), axes).select("row", "col", "val").where("val is not null")
    named = on_map.withColumn("pt_id", F.xxhash64("lon", "lat"))
    under = inside_polygons(named.select("pt_id", F.col("lon").alias("x"), F.col("lat").alias("y")), vertices, strip).select("pt_id").distinct()
    wet = locate(named.join(under, "pt_id", "left_semi"), axes).select("row", "col").distinct()
    return axes, cells, dilate(wet, disk(reach), axes.nrows, axes.ncols)


def chain_json(chain: list[Step]) -> str:
    plain = lambda v: v.tolist() if isinstance(v, np.ndarray) else v
    return json.dumps([[s.kind, [plain(w) for w in s.what]] for s in chain])


def chain_of(text: str) -> list[Step]:
    return [Step(kind, tuple(what)) for kind, what in json.loads(text)]


def guarded(fn, columns: list[str]):
    """``fn`` (key, frame -> frame) for applyInPandas that never fails a stage: a group that raises gives one row of
    missing ``columns`` with the message in ``error``."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        try:
            return fn(key, frame).assign(error=None)
        except Exception as error:  # noqa: BLE001 - recorded in the row
            return pd.DataFrame([{c: None for c in columns} | {"error": f"{type(error).__name__}: {error}"}])

    return run


def rasterize(points: DataFrame, axes: Axes, gap_cells: int = 4, speckle_cells: int = 40, median_size: int = 3, denoise: float | None = None) -> DataFrame:
    """row, col, val of a cleaned elevation grid: cell means; gaps under ``gap_cells`` filled; larger gaps grown by a
    cell and kept; components of data under ``speckle_cells`` dropped; median; surface smoothing."""
    spark = points.sparkSession
    cells = _cut(cell_mean(points, axes).select("row", "col", "val"))  # the points are read once
    gaps = axes.cells(spark).select("row", "col").join(cells, ["row", "col"], "left_anti")
    large = area_open(gaps, gap_cells)
    filled = inpaint(cells, axes)
    out = filled.join(dilate(large, disk(1), axes.nrows, axes.ncols), ["row", "col"], "left_anti")
    out = _cut(out)
    out = out.join(area_open(out, speckle_cells), ["row", "col"], "left_semi")
    if median_size:
        out = median(out, axes.nrows, axes.ncols, median_size)
    return smoothed(_cut(out), axes, denoise) if denoise is not None else out


def orthoimage(elevation: DataFrame, reference: DataFrame, axes: Axes, image: DataFrame, image_axes: Axes, project) -> DataFrame:
    """row, col, val: image value at each elevation cell (holes from the reference), through ``project`` (x, y, z -> pixel)."""
    whole = fill(axes.cells(elevation.sparkSession).join(elevation.select("row", "col", "val"), ["row", "col"], "left"), reference).where("val is not null")
    u, v = project(F.col("x"), F.col("y"), F.col("val"))
    asked = whole.select("row", "col", ((F.col("col").cast("long") - 1) * axes.nrows + F.col("row")).alias("pt_id"), u.alias("x"), v.alias("y"))
    return bilinear(asked, image, image_axes, "val").select("row", "col", "val")
