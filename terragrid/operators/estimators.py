"""Estimators: every pass over the data is an aggregation or a join, the driver solves the small system left."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.projections import apply_matrix
from ..functions.semantics import hash_order
from .grid import Axes, _cut, cell_mean, stored
from .stats import clip_quantiles, moments, normal_equations, rmse


@dataclass(frozen=True)
class Similarity:
    """target = scale * rotation @ source + shift."""

    scale: float
    rotation: np.ndarray
    shift: np.ndarray
    rms: float

    @property
    def matrix(self) -> np.ndarray:
        return np.column_stack([self.scale * self.rotation, self.shift])


def horn(pairs: DataFrame, scale: bool = True, weight: str | None = None, planar: bool = False) -> Similarity:
    """Similarity that takes (x, y, z) nearest to (tx, ty, tz): sums in one aggregation, then the quaternion that
    maximises the correlation (planar: the angle in closed form). Rows with a missing value don't count."""
    s, t = (["x", "y"], ["tx", "ty"]) if planar else (["x", "y", "z"], ["tx", "ty", "tz"])
    ok = None
    for c in [*s, *t]:
        good = F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
        ok = good if ok is None else ok & good
    m = moments(pairs.where(ok), s, t, weight).head()
    return similarity_of(m, s, t, scale, planar)


def horn_by(pairs: DataFrame, by: str) -> dict:
    """The similarity of each group of pairs, from one aggregation; groups of fewer than three pairs have none."""
    s, t = ["x", "y", "z"], ["tx", "ty", "tz"]
    ok = F.lit(True)
    for c in [*s, *t]:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return {m[by]: similarity_of(m, s, t) for m in moments(pairs.where(ok), s, t, by=[by]).collect() if m.n >= 3}  # a row a group


def similarity_of(m, s: list[str], t: list[str], scale: bool = True, planar: bool = False) -> Similarity:
    """The similarity that sums of coordinates and their products (see ``moments``) ask for."""
    n = m.n or 0.0
    if n <= 0:
        raise ValueError("no pairs to align")
    a, b = np.array([m[f"s_{c}"] for c in s]) / n, np.array([m[f"s_{c}"] for c in t]) / n
    cov = np.array([[m[f"s_{p}_{q}"] for q in t] for p in s]) / n - np.outer(a, b)
    va, vb = (sum(m[f"s_{c}_{c}"] for c in cs) / n - v @ v for cs, v in ((s, a), (t, b)))
    if planar:
        theta = math.atan2(cov[0, 1] - cov[1, 0], cov[0, 0] + cov[1, 1])
        r = np.array([[math.cos(theta), -math.sin(theta)], [math.sin(theta), math.cos(theta)]])
    else:
        d = np.array([cov[1, 2] - cov[2, 1], cov[2, 0] - cov[0, 2], cov[0, 1] - cov[1, 0]])
        k = np.zeros((4, 4))
        k[0, 0], k[0, 1:], k[1:, 0] = np.trace(cov), d, d
        k[1:, 1:] = cov + cov.T - np.trace(cov) * np.eye(3)
        w, x, y, z = np.linalg.eigh(k)[1][:, -1]
        r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    along = float(np.sum(r * cov.T))
    f = along / va if scale and va > 0 else 1.0
    rms = math.sqrt(max(0.0, f * f * va - 2 * f * along + vb))
    return Similarity(f, r, b - f * r @ a, rms)


def ransac(pairs: DataFrame, inlier: float, hypotheses: int = 500, seed: int = 0) -> tuple[Similarity, DataFrame]:
    """Similarity (planar) with the most pairs (pt_id, x, y, tx, ty) within ``inlier``, refitted on those; and those.

    Hypothesis h takes three pairs by hash order; all are tried at once as rows: each pair meets every hypothesis'
    matrix (a few numbers, at most ``hypotheses`` of them) and the hits are counted by hypothesis before the shuffle.
    Three pairs at least. Hypotheses are drawn from the first three pairs for each by hash; all pairs are counted.
    """
    drawn = pairs.select("pt_id", "x", "y", "tx", "ty").orderBy(hash_order(F.col("pt_id"), seed), "pt_id").limit(3 * hypotheses).toPandas()
    if len(drawn) < 3:
        raise ValueError("a hypothesis takes three pairs")
    rng, rows = np.random.default_rng(seed), []
    src, dst = drawn[["x", "y"]].to_numpy(), drawn[["tx", "ty"]].to_numpy()
    for h in range(hypotheses):
        k = rng.choice(len(drawn), 3, replace=False)
        p, q = (v[k, 0] + 1j * v[k, 1] for v in (src, dst))
        p0, q0 = p - p.mean(), q - q.mean()
        size = float(np.sum(np.abs(p0) ** 2))
        if size > 0:
            c = complex(np.sum(q0 * np.conj(p0)) / size)
            o = complex(q.mean() - c * p.mean())
            rows.append((h, c.real, c.imag, o.real, o.imag))
    trial = F.explode(F.lit([list(map(float, r)) for r in rows]).cast("array<array<double>>"))
    each = pairs.select("pt_id", "x", "y", "tx", "ty", trial.alias("m"))
    dx = F.col("m")[1] * F.col("x") - F.col("m")[2] * F.col("y") + F.col("m")[3] - F.col("tx")
    dy = F.col("m")[2] * F.col("x") + F.col("m")[1] * F.col("y") + F.col("m")[4] - F.col("ty")
    best = each.where(dx * dx + dy * dy < inlier * inlier).groupBy(F.col("m")[0].alias("h")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "h").head()
    if best is None or best.n < 3:
        raise ValueError("no hypothesis has three pairs within the distance")
    _, a, b, ox, oy = next(r for r in rows if r[0] == int(best.h))
    ex, ey = a * F.col("x") - b * F.col("y") + ox - F.col("tx"), b * F.col("x") + a * F.col("y") + oy - F.col("ty")
    inliers = pairs.where(ex * ex + ey * ey < inlier * inlier)
    return horn(inliers, planar=True), inliers


def plane_sums(pairs: DataFrame, off: Column) -> DataFrame:
    """The 27 sums of point-to-plane alignment: rotations rx, ry, rz and shifts tx, ty, tz against the distance ``off``
    along the normals (nx, ny, nz) at points (x, y, z)."""
    p, n = [F.col(c) for c in ("x", "y", "z")], [F.col(c) for c in ("nx", "ny", "nz")]
    cross = [p[1] * n[2] - p[2] * n[1], p[2] * n[0] - p[0] * n[2], p[0] * n[1] - p[1] * n[0]]
    return normal_equations(pairs, dict(zip(["rx", "ry", "rz", "tx", "ty", "tz"], [*cross, *n])), off)


def plane_step(pairs: DataFrame) -> np.ndarray:
    """3 x 4 motion (small rotation, shift) that takes points (x, y, z) toward the planes through (tx, ty, tz) with
    normals (nx, ny, nz): 27 sums, then six unknowns."""
    p, n = [F.col(c) for c in ("x", "y", "z")], [F.col(c) for c in ("nx", "ny", "nz")]
    off = sum(((F.col(t) - q) * m for t, q, m in zip(("tx", "ty", "tz"), p, n)), F.lit(0.0))
    names = ["rx", "ry", "rz", "tx", "ty", "tz"]
    m = plane_sums(pairs, off).head()
    a = np.array([[m[f"{i}_{j}" if names.index(i) <= names.index(j) else f"{j}_{i}"] for j in names] for i in names])
    v = np.linalg.lstsq(a, np.array([m[f"{i}_y"] for i in names]), rcond=None)[0]
    rx, ry, rz = v[:3]
    cx, cy, cz, sx, sy, sz = math.cos(rx), math.cos(ry), math.cos(rz), math.sin(rx), math.sin(ry), math.sin(rz)
    r = np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]]) @ np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]]) @ np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]])
    return np.column_stack([r, v[3:]])


def icp(points: DataFrame, reference: DataFrame, axes: Axes, rounds: int = 20, tolerance: float = 1e-6, reject: float = 3.0) -> np.ndarray:
    """3 x 4 motion of points (pt_id, x, y, z) onto a surface given as cells (row, col, x, y, val, nx, ny, nz).

    The points are written once, by their own columns alone, as a round reads them four times. It places them in the
    reference's cells (an equi-join), drops distances beyond the median plus ``reject`` robust deviations, keeps the
    nearest point of each cell, and solves point-to-plane.
    """
    total = np.column_stack([np.eye(3), np.zeros(3)])
    small = F.broadcast if axes.nrows * axes.ncols <= 100_000 else lambda df: df  # a row a cell
    ref = small(_cut(reference.select("row", "col", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("val").alias("tz"), "nx", "ny", "nz")))
    with stored(points.select("pt_id", "x", "y", "z").where("x is not null and y is not null and z is not null")) as kept:
        for _ in range(rounds):
            x, y, z = apply_matrix(total, F.col("x"), F.col("y"), F.col("z"))
            moved = kept.select("pt_id", x.alias("x"), y.alias("y"), z.alias("z"))
            met = moved.withColumns({"row": axes.row_of(F.col("y")), "col": axes.col_of(F.col("x"))}).join(ref, ["row", "col"])
            d = F.abs((F.col("tx") - F.col("x")) * F.col("nx") + (F.col("ty") - F.col("y")) * F.col("ny") + (F.col("tz") - F.col("z")) * F.col("nz"))
            met = met.withColumn("_d", d)
            med = met.agg(F.percentile_approx("_d", 0.5, F.lit(1000)).alias("m")).head().m
            if med is None:
                raise ValueError("no point lies over the reference")
            mad = met.agg(F.percentile_approx(F.abs(F.col("_d") - med), 0.5, F.lit(1000)).alias("m")).head().m
            near = met.where(F.col("_d") <= med + reject * 1.4826 * mad + 1e-12)
            least = small(near.groupBy("row", "col").agg(F.min("_d").alias("_least")))  # added up before the shuffle, as points aren't
            tied = near.join(least, ["row", "col"]).where(F.col("_d") == F.col("_least"))
            one = tied.withColumn("_r", F.row_number().over(Window.partitionBy("row", "col").orderBy("pt_id"))).where("_r = 1")
            step = plane_step(one)
            total = np.column_stack([step[:, :3] @ total[:, :3], step[:, :3] @ total[:, 3] + step[:, 3]])
            if np.abs(step - np.column_stack([np.eye(3), np.zeros(3)])).max() < tolerance:
                break
    return total


def vertical_error(points: DataFrame, reference: DataFrame, axes: Axes, mask: DataFrame | None = None, clip: tuple[float, float] | None = (0.05, 0.95), digits: int | None = None) -> DataFrame:
    """n, sse and rmse of the points' cell means against reference cells outside the mask, between two quantiles.

    Differences are worked out once: a sum in another order would put the cells that are a quantile beyond it. For
    ``digits`` see ``cell_mean``."""
    cells = cell_mean(points, axes, digits=digits).join(reference.select("row", "col", F.col("val").alias("_ref")), ["row", "col"])
    diff = cells.select("row", "col", (F.col("_ref") - F.col("val")).alias("d")).where("d is not null")
    if mask is not None:
        diff = diff.join(mask.select("row", "col"), ["row", "col"], "left_anti")
    return rmse(clip_quantiles(_cut(diff), "d", *clip) if clip else diff, "d")


def simplex_moves(start: np.ndarray, step: np.ndarray, rounds: int = 60, settled: float = 0.1, memory: int = 10):
    """Nelder-Mead over a few variables as a generator: it yields lists of points to try, is sent their errors, and
    returns the best point, its error and the best error of each round.

    A round asks for the reflected, the expanded and both contracted points at once, so several simplexes can have
    their errors worked out together. It stops when the errors that the last ``memory`` rounds tried last differ by less
    than ``settled``: the best one's may stand while the simplex still moves.
    """
    points = [np.asarray(start, float)] + [np.asarray(start, float) + step * np.eye(len(start))[i] for i in range(len(start))]
    values, log, last = list((yield points)), [], []
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        log.append(values[0])
        if len(last) >= memory and max(last[-memory:]) - min(last[-memory:]) < settled:
            break
        centre = np.mean(points[:-1], axis=0)
        tried = [centre + k * (centre - points[-1]) for k in (1.0, 2.0, 0.5, -0.5)]
        across, beyond, before, within = got = yield tried
        if across < values[0]:
            chosen = 1 if beyond < across else 0
            last.append(beyond)
        elif across < values[-2]:
            chosen = 0
            last.append(across)
        else:
            chosen = 2 if across < values[-1] else 3
            last.append(got[chosen])
            chosen = chosen if got[chosen] < min(across, values[-1]) else None
        if chosen is not None:
            points[-1], values[-1] = tried[chosen], got[chosen]
        else:
            points = [points[0]] + [points[0] + (q - points[0]) / 2 for q in points[1:]]
            values = [values[0], *(yield points[1:])]
            last[-1] = values[-1]
    best = int(np.argmin(values))
    return points[best], values[best], log


def simplex(error: Callable[[np.ndarray], float], start: np.ndarray, step: np.ndarray, rounds: int = 60, settled: float = 0.1, memory: int = 10) -> tuple[np.ndarray, float, list[float]]:
    """The simplex of ``simplex_moves`` for one error function."""
    return together({0: simplex_moves(start, step, rounds, settled, memory)}, lambda asked: {0: [error(p) for p in asked[0]]})[0]


def together(moves: dict, errors: Callable[[dict], dict]) -> dict:
    """Run generators of moves side by side: each round ``errors`` gets the points of all that still move, by key, and
    returns their errors; the result of each by key."""
    done, asked = {}, {}
    for key, move in moves.items():
        asked[key] = next(move)
    while asked:
        got, now = errors(asked), {}
        for key in asked:
            try:
                now[key] = moves[key].send(got[key])
            except StopIteration as end:
                done[key] = end.value
        asked = now
    return done


def polyfit(df: DataFrame, variables: list[str], target: str, terms: list[tuple[float, ...]]) -> dict:
    """Least squares of a polynomial: terms (exponents of each variable), coef, std, rmse, r2, adjusted_r2, dof, n.

    Sums of scaled features come from one aggregation. Rows with a missing value don't count.
    """
    spread = df.agg(*[F.stddev_pop(v).alias(v) for v in variables]).head()
    size = [spread[v] or 1.0 for v in variables]
    features = {}
    for i, powers in enumerate(terms):
        c = F.lit(1.0)
        for v, p, s in zip(variables, powers, size):
            if p:
                c = c * F.pow(F.col(v) / s, F.lit(float(p)))
        features[f"t{i}"] = c
    m = normal_equations(df, features, F.col(target)).head()
    names, n = list(features), m.n
    a = np.array([[m[f"t{min(i, j)}_t{max(i, j)}"] for j in range(len(names))] for i in range(len(names))], float)
    b = np.array([m[f"{k}_y"] for k in names], float)
    inverse = np.linalg.pinv(a)
    coef = inverse @ b
    sse = max(0.0, m.y_y - coef @ b)
    unit = np.array([math.prod(s**p for s, p in zip(size, powers)) for powers in terms])
    constant = any(not any(p) for p in terms)
    total = m.y_y - m.y**2 / n if constant else m.y_y
    dof = n - len(terms)
    r2 = 1 - sse / total if total else float("nan")
    return {"terms": terms, "coef": coef / unit, "std": np.sqrt(np.diag(inverse) * sse / dof) / unit if dof > 0 else np.full(len(terms), np.inf), "rmse": math.sqrt(sse / n), "r2": r2, "adjusted_r2": 1 - (1 - r2) * (n - constant) / dof if dof > 0 else float("nan"), "dof": dof, "n": n}


def complete_terms(order: int, variables: int) -> list[tuple[int, ...]]:
    """All exponents of a total degree up to ``order``."""
    if variables == 1:
        return [(k,) for k in range(order + 1)]
    return [(k, *rest) for k in range(order + 1) for rest in complete_terms(order - k, variables - 1)]


def parse_terms(text: str) -> tuple[list[str], list[tuple[float, ...]]]:
    """Variables and exponents of a model such as ``x^2, x*y, constant``."""
    parsed = []
    for term in filter(None, (t.strip() for t in text.replace(" ", ",").split(","))):
        powers: dict[str, float] = {}
        for factor in filter(None, term.split("*")):
            name, _, power = factor.partition("^")
            if name not in ("constant", "1"):
                powers[name] = powers.get(name, 0.0) + float(power or 1)
        parsed.append(powers)
    names = sorted({n for p in parsed for n in p})
    return names, [tuple(p.get(n, 0.0) for n in names) for p in parsed]


def derivative(terms: list[tuple], coef, variable: int) -> tuple[list[tuple], list[float]]:
    """Terms and coefficients of the derivative by one variable."""
    kept = [(t, c) for t, c in zip(terms, coef) if t[variable]]
    return [tuple(p - (i == variable) for i, p in enumerate(t)) for t, _ in kept], [c * t[variable] for t, c in kept]


def as_sql(terms: list[tuple], coef, variables: list[str]) -> str:
    """The model as an SQL expression."""
    product = lambda t: " * ".join(f"power({v}, {p!r})" for v, p in zip(variables, t) if p)
    return " + ".join(f"({float(c)!r}{' * ' if any(t) else ''}{product(t)})" for t, c in zip(terms, coef)) or "0.0"


def cosine_sums(diff: DataFrame) -> DataFrame:
    """The sums behind ``cosine_shift``."""
    aspect, y = F.radians("aspect"), F.col("d") / F.tan(F.radians("slope"))
    return normal_equations(diff, {"a": F.cos(aspect), "b": F.sin(aspect), "c": F.lit(1.0)}, y)


def similarity_2d(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by..., a, b, tx, ty of the similarity without reflection (x, y) -> (a x - b y + tx, b x + a y + ty) nearest to
    (tx, ty) for each group; groups whose points coincide have none."""
    c = lambda e: F.sum(F.expr(e))
    m = pairs.where("x is not null and y is not null and tx is not null and ty is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), c("x").alias("sx"), c("y").alias("sy"), c("tx").alias("su"), c("ty").alias("sv"), c("x * x + y * y").alias("q"), c("x * tx + y * ty").alias("d"), c("x * ty - y * tx").alias("e"))
    m = m.withColumn("w", F.expr("q - (sx * sx + sy * sy) / n")).where("w > 0")
    m = m.withColumns({"a": F.expr("(d - (sx * su + sy * sv) / n) / w"), "b": F.expr("(e - (sx * sv - sy * su) / n) / w")})
    return m.select(*by, "a", "b", F.expr("(su - a * sx + b * sy) / n").alias("tx"), F.expr("(sv - b * sx - a * sy) / n").alias("ty"))


def cosine_shift(diff: DataFrame) -> dict:
    """a, b (degrees), c of dz / tan(slope) = a cos(b - aspect) + c over rows (d, slope, aspect): linear in cosine and sine."""
    m = cosine_sums(diff).head()
    k = np.array([[m.a_a, m.a_b, m.a_c], [m.a_b, m.b_b, m.b_c], [m.a_c, m.b_c, m.c_c]])
    u, v, c = np.linalg.lstsq(k, np.array([m.a_y, m.b_y, m.c_y]), rcond=None)[0]
    return {"a": math.hypot(u, v), "b": math.degrees(math.atan2(v, u)) % 360, "c": c}


def triangulate(points: DataFrame, left: np.ndarray, right: np.ndarray) -> DataFrame:
    """pt_id, x, y, z, the four reprojection residuals (exl, eyl, exr, eyr; 0 where there is none) and their error of
    image pairs (pt_id, xl, yl, xr, yr) under two 3 x 4 cameras: the least singular vector of each point's four
    equations, batch by batch. Missing pixels give missing points."""
    left, right = np.asarray(left, float), np.asarray(right, float)
    schema = pa.schema([("pt_id", pa.int64()), *((c, pa.float64()) for c in ("x", "y", "z", "exl", "eyl", "exr", "eyr", "error"))])

    def run(batches):
        for b in batches:
            p = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("xl", "yl", "xr", "yr")])
            ok = np.isfinite(p).all(axis=1)
            q = np.where(ok[:, None], p, 0.0)
            rows = np.stack([q[:, [0]] * left[2] - left[0], q[:, [1]] * left[2] - left[1], q[:, [2]] * right[2] - right[0], q[:, [3]] * right[2] - right[1]], axis=1)
            rows /= np.maximum(np.linalg.norm(rows, axis=2, keepdims=True), 1e-300)
            v = np.linalg.svd(rows)[2][:, -1] if len(q) else np.zeros((0, 4))
            with np.errstate(all="ignore"):
                world = v[:, :3] / v[:, 3:]
                h = np.column_stack([world, np.ones(len(v))])
                seen = [(h @ m.T)[:, :2] / (h @ m.T)[:, 2:] for m in (left, right)]
            ok &= np.isfinite(world).all(axis=1)
            off = np.where(ok[:, None] & np.isfinite(np.column_stack(seen)), np.column_stack(seen) - q, 0.0)
            error = np.sqrt((off**2).sum(axis=1) / 2)
            col = lambda a: pa.array(np.where(ok, a, 0.0), mask=~ok)
            yield pa.RecordBatch.from_arrays([b.column("pt_id").cast(pa.int64()), *(col(world[:, i]) for i in range(3)), *(pa.array(off[:, i]) for i in range(4)), col(error)], schema=schema)

    return points.select("pt_id", "xl", "yl", "xr", "yr").mapInArrow(run, "pt_id long, x double, y double, z double, exl double, eyl double, exr double, eyr double, error double")
