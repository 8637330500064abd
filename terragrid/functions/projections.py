"""Map projections, geocentric coordinates and planar transforms as column expressions.

Series of J. P. Snyder, Map Projections: A Working Manual (1987), on WGS84.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

A, FLAT = 6378137.0, 1 / 298.257223563
B = A * (1 - FLAT)
E2 = FLAT * (2 - FLAT)
EP2 = E2 / (1 - E2)
K0, EASTING, SOUTHING = 0.9996, 500_000.0, 10_000_000.0


def utm_zone(points: DataFrame, lon: str = "lon", lat: str = "lat") -> tuple[int, str]:
    """Zone (1 to 60) and hemisphere of the mean position of the rows that have one."""
    row = points.where(f"{lon} is not null and {lat} is not null").agg(F.avg(lon), F.avg(lat)).head()
    if row[0] is None:
        raise ValueError("no position to choose a zone from")
    return min(60, max(1, int(math.floor(row[0] / 6)) + 31)), "N" if row[1] > 0 else "S"


def _meridian(phi: Column) -> Column:
    e4, e6 = E2**2, E2**3
    return A * ((1 - E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi - (3 * E2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * phi) + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * phi) - (35 * e6 / 3072) * F.sin(6 * phi))


def ll_to_utm(lon: Column, lat: Column, zone: int, hemisphere: str) -> tuple[Column, Column]:
    """Easting and northing."""
    lon0 = math.radians(zone * 6 - 183)
    phi = F.radians(lat)
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    n, t, c = A / F.sqrt(1 - E2 * sin * sin), tan * tan, EP2 * cos * cos
    a = cos * (F.radians(lon) - lon0)
    x = K0 * n * (a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * EP2) * F.pow(a, 5) / 120) + EASTING
    y = K0 * (_meridian(phi) + n * tan * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * EP2) * F.pow(a, 6) / 720))
    return x, y + (SOUTHING if hemisphere == "S" else 0.0)


def utm_to_ll(x: Column, y: Column, zone: int, hemisphere: str) -> tuple[Column, Column]:
    """Longitude and latitude in degrees, by the footpoint latitude."""
    e1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    m = (y - (SOUTHING if hemisphere == "S" else 0.0)) / K0
    mu = m / (A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
    p = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    sin, cos, tan = F.sin(p), F.cos(p), F.tan(p)
    c, t = EP2 * cos * cos, tan * tan
    w = 1 - E2 * sin * sin
    n, r = A / F.sqrt(w), A * (1 - E2) / F.pow(w, 1.5)
    d = (x - EASTING) / (n * K0)
    lat = p - (n * tan / r) * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * EP2) * F.pow(d, 4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * EP2 - 3 * c * c) * F.pow(d, 6) / 720)
    lon = (d - (1 + 2 * t + c) * F.pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * EP2 + 24 * t * t) * F.pow(d, 5) / 120) / cos
    return F.degrees(lon) + (zone * 6 - 183), F.degrees(lat)


def _ps_scale(lat0: float, k0: float | None) -> tuple[float, float]:
    """Sign of the pole and the factor of t in the radius."""
    e, sign = math.sqrt(E2), 1.0 if lat0 >= 0 else -1.0
    phi = abs(math.radians(lat0))
    if abs(abs(lat0) - 90) < 1e-9:
        return sign, 2 * A * (k0 if k0 is not None else 1.0) / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
    t = math.tan(math.pi / 4 - phi / 2) / ((1 - e * math.sin(phi)) / (1 + e * math.sin(phi))) ** (e / 2)
    return sign, A * math.cos(phi) / math.sqrt(1 - E2 * math.sin(phi) ** 2) / t * (k0 if k0 is not None else 1.0)


def ll_to_ps(lon: Column, lat: Column, lon0: float, lat0: float, fe: float = 0.0, fn: float = 0.0, k0: float | None = None) -> tuple[Column, Column]:
    """Polar stereographic x and y, true to scale at latitude ``lat0`` (or scaled by ``k0`` at the pole)."""
    e, (sign, factor) = math.sqrt(E2), _ps_scale(lat0, k0)
    phi = F.radians(lat) * sign
    es = e * F.sin(phi)
    rho = factor * F.tan(math.pi / 4 - phi / 2) / F.pow((1 - es) / (1 + es), e / 2)
    d = (F.radians(lon) - math.radians(lon0)) * sign
    return fe + sign * rho * F.sin(d), fn - sign * rho * F.cos(d)


def ps_to_ll(x: Column, y: Column, lon0: float, lat0: float, fe: float = 0.0, fn: float = 0.0, k0: float | None = None) -> tuple[Column, Column]:
    """Longitude and latitude, by the series for the latitude with the full eighth-order term."""
    sign, factor = _ps_scale(lat0, k0)
    u, v = sign * (x - fe), sign * (y - fn)
    chi = math.pi / 2 - 2 * F.atan(F.sqrt(u * u + v * v) / factor)
    e4, e6, e8 = E2**2, E2**3, E2**4
    phi = chi + (E2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360) * F.sin(2 * chi) + (7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520) * F.sin(4 * chi) + (7 * e6 / 120 + 81 * e8 / 1120) * F.sin(6 * chi) + (4279 * e8 / 161280) * F.sin(8 * chi)
    return F.degrees(sign * F.atan2(u, -v)) + lon0, F.degrees(sign * phi)


def geodetic_to_ecef(lon: Column, lat: Column, h: Column) -> tuple[Column, Column, Column]:
    lam, phi = F.radians(lon), F.radians(lat)
    n = A / F.sqrt(1 - E2 * F.sin(phi) * F.sin(phi))
    return (n + h) * F.cos(phi) * F.cos(lam), (n + h) * F.cos(phi) * F.sin(lam), (n * (1 - E2) + h) * F.sin(phi)


def ecef_to_geodetic(x: Column, y: Column, z: Column, rounds: int = 3) -> tuple[Column, Column, Column]:
    """Bowring's start, improved ``rounds`` times."""
    p = F.sqrt(x * x + y * y)
    beta = F.atan2(z * A, p * B)
    phi = None
    for _ in range(rounds):
        phi = F.atan2(z + EP2 * B * F.pow(F.sin(beta), 3), p - E2 * A * F.pow(F.cos(beta), 3))
        beta = F.atan2((1 - FLAT) * F.sin(phi), F.cos(phi))
    n = A / F.sqrt(1 - E2 * F.sin(phi) * F.sin(phi))
    return F.degrees(F.atan2(y, x)), F.degrees(phi), p * F.cos(phi) + z * F.sin(phi) - n * (1 - E2 * F.sin(phi) * F.sin(phi))


def rotation(rx: float, ry: float, rz: float) -> np.ndarray:
    """Rotation about x, then y, then z axes (degrees), as the product Rx Ry Rz."""
    cx, cy, cz = (math.cos(math.radians(v)) for v in (rx, ry, rz))
    sx, sy, sz = (math.sin(math.radians(v)) for v in (rx, ry, rz))
    return np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]]) @ np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]]) @ np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]])


def apply_matrix(m: np.ndarray, *xs: Column) -> list[Column]:
    """Rows of ``m`` times the point; a last column more than the point has is the translation."""
    out = []
    for row in np.asarray(m, float):
        total = F.lit(float(row[len(xs)])) if len(row) > len(xs) else F.lit(0.0)
        for k, x in zip(row, xs):
            total = total + float(k) * x
        out.append(total)
    return out


def homography(h: np.ndarray, x: Column, y: Column) -> tuple[Column, Column]:
    u, v, w = apply_matrix(h, x, y)
    return F.try_divide(u, w), F.try_divide(v, w)


def camera(k: np.ndarray, pose: np.ndarray, x: Column, y: Column, z: Column, left: float = 0.0, top: float = 0.0) -> tuple[Column, Column]:
    """Pixel of a point under intrinsics (3 x 3) and pose (3 x 4), relative to a window's corner."""
    u, v, w = apply_matrix(np.asarray(k) @ np.asarray(pose), x, y, z)
    return F.try_divide(u, w) - left, F.try_divide(v, w) - top


def polynomial(terms: list[tuple[tuple[float, ...], float]], *xs: Column) -> Column:
    """Sum of coefficient times powers of the variables."""
    total = F.lit(0.0)
    for powers, coefficient in terms:
        term = F.lit(float(coefficient))
        for x, p in zip(xs, powers):
            term = term * (F.pow(x, F.lit(float(p))) if p not in (0, 1) else x if p == 1 else F.lit(1.0))
        total = total + term
    return total


def solver_forward(v: dict, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Centre, scale axes and whole, rotate, move back, translate, add the surface to z.

    v: center (3), scale (3), whole, rotation (3 degrees), shift (3), surface (polynomial terms of x and y, or None).
    """
    c = v["center"]
    s = [(p - k) * a * v["whole"] for p, k, a in zip((x, y, z), c, v["scale"])]
    r = apply_matrix(rotation(*v["rotation"]), *s)
    x, y, z = (p + k + t for p, k, t in zip(r, c, v["shift"]))
    return x, y, z + polynomial(v["surface"], x, y) if v.get("surface") else z


def solver_inverse(v: dict, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """The exact reverse of ``solver_forward``."""
    if v.get("surface"):
        z = z - polynomial(v["surface"], x, y)
    c = v["center"]
    d = [p - k - t for p, k, t in zip((x, y, z), c, v["shift"])]
    r = apply_matrix(rotation(*v["rotation"]).T, *d)
    return tuple(p / (a * v["whole"]) + k for p, a, k in zip(r, v["scale"], c))


def scale_to_unit(v: Column, low: Column, high: Column) -> Column:
    return F.try_divide(v - low, high - low)


def descale(u: Column, low: Column, high: Column) -> Column:
    return u * (high - low) + low


def rotation_between(f: tuple, t: tuple) -> list[list[Column]]:
    """Matrix that turns unit vector f into unit vector t (3 columns each), without trigonometry.

    Away from parallel the usual c I + [v]x + v v' / (1 + c) holds; for opposite vectors two reflections are used.
    """
    fx, fy, fz = f
    tx, ty, tz = t
    v = (fy * tz - fz * ty, fz * tx - fx * tz, fx * ty - fy * tx)
    c = fx * tx + fy * ty + fz * tz
    k = 1 / (1 + c)
    skew = [[F.lit(0.0), -v[2], v[1]], [v[2], F.lit(0.0), -v[0]], [-v[1], v[0], F.lit(0.0)]]
    usual = [[(c if i == j else F.lit(0.0)) + skew[i][j] + v[i] * v[j] * k for j in range(3)] for i in range(3)]
    # reflect f to the axis it is least along, then that axis to t
    least = F.least(F.abs(fx), F.abs(fy), F.abs(fz))
    axis = [F.when(F.abs(fx) == least, 1.0).otherwise(0.0), F.when((F.abs(fx) != least) & (F.abs(fy) == least), 1.0).otherwise(0.0), F.when((F.abs(fx) != least) & (F.abs(fy) != least), 1.0).otherwise(0.0)]
    u, w = [a - b for a, b in zip(axis, f)], [a - b for a, b in zip(axis, t)]
    uu, ww, uw = (sum((a * b for a, b in zip(p, q)), F.lit(0.0)) for p, q in ((u, u), (w, w), (u, w)))
    twice = [[(F.lit(1.0) if i == j else F.lit(0.0)) - 2 * u[i] * u[j] / uu - 2 * w[i] * w[j] / ww + 4 * uw * w[i] * u[j] / (uu * ww) for j in range(3)] for i in range(3)]
    return [[F.when(c > -0.99, usual[i][j]).otherwise(twice[i][j]) for j in range(3)] for i in range(3)]


def to_full_image(x: Column, y: Column, left: Column | float, top: Column | float, height: Column | float | None = None) -> tuple[Column, Column]:
    """A window's pixel (from 1) in the whole image; with ``height`` rows count from the other end."""
    u, v = x + left - 1, y + top - 1
    return u, v if height is None else height - v + 1


def euler_zyx(m: list[list[Column]]) -> tuple[Column, Column, Column]:
    """Angles in degrees of rotations about z, then y, then x that make up a rotation matrix (Rz Ry Rx)."""
    flat = F.sqrt(m[0][0] * m[0][0] + m[1][0] * m[1][0])
    return F.degrees(F.atan2(m[1][0], m[0][0])), F.degrees(F.atan2(-m[2][0], flat)), F.degrees(F.atan2(m[2][1], m[2][2]))


def rotate_normals(m: np.ndarray, *n: Column) -> list[Column]:
    """Unit normals under the rotation part of a similarity (the scale drops out)."""
    turned = apply_matrix(np.asarray(m, float)[:, :3], *n)
    size = F.sqrt(sum((c * c for c in turned), F.lit(0.0)))
    return [F.try_divide(c, size) for c in turned]


def ramp(value: Column, low: float, high: float, colours: list) -> Column:
    """The colour of an equal part of the range from low to high; values beyond take the first or last."""
    n = len(colours)
    k = F.greatest(F.least(F.floor((value - low) / ((high - low) / n)) + 1, F.lit(n)), F.lit(1)).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in colours]), k)


def curve(points: DataFrame, matrix: np.ndarray, zone: int, hemisphere: str) -> DataFrame:
    """Points (x, y, z, ...) of a flat model bent onto the ellipsoid: the similarity ``matrix`` (3 x 4, map to
    geocentric) places the model in space, from where it goes back to the map. A step's columns are computed once."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    placed = points.withColumns(dict(zip("xyz", apply_matrix(matrix, x, y, z))))
    round_ = placed.withColumns(dict(zip("xyz", ecef_to_geodetic(x, y, z))))
    return round_.withColumns(dict(zip("xy", ll_to_utm(x, y, zone, hemisphere))))


def uncurve(points: DataFrame, matrix: np.ndarray, zone: int, hemisphere: str) -> DataFrame:
    """The reverse of ``curve``."""
    m, (x, y, z) = np.asarray(matrix, float), (F.col(c) for c in "xyz")
    back = np.linalg.inv(m[:, :3])
    round_ = points.withColumns(dict(zip("xy", utm_to_ll(x, y, zone, hemisphere))))
    placed = round_.withColumns(dict(zip("xyz", geodetic_to_ecef(x, y, z))))
    return placed.withColumns(dict(zip("xyz", apply_matrix(np.column_stack([back, -back @ m[:, 3]]), x, y, z))))


def paired_points(x: Column, y: Column, disparity: Column, left: np.ndarray, right: np.ndarray, offset: tuple[float, float, float, float]) -> tuple[Column, Column, Column, Column]:
    """xl, yl, xr, yr in the two images of a rectified pixel and its disparity: inverse homographies, then offsets."""
    a, b = homography(np.linalg.inv(left), x, y), homography(np.linalg.inv(right), x - disparity, y)
    return tuple(c + o for c, o in zip((*a, *b), offset))


@dataclass(frozen=True)
class Projection:
    """Map coordinates: "ll" (degrees), "utm" (zone, hemisphere) or "ps" (lon0, lat0, and false origin)."""

    kind: str = "ll"
    parameters: tuple = ()

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return (lon, lat) if self.kind == "ll" else {"utm": ll_to_utm, "ps": ll_to_ps}[self.kind](lon, lat, *self.parameters)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        return (x, y) if self.kind == "ll" else {"utm": utm_to_ll, "ps": ps_to_ll}[self.kind](x, y, *self.parameters)


def reproject(source: Projection, target: Projection):
    """A function from source to target coordinates, by longitude and latitude."""
    return lambda x, y: (x, y) if source == target else target.forward(*source.inverse(x, y))
