"""Gaps, meshes and resizing against plain versions in numpy, and their queries against DuckDB."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terragrid.operators import gaps, grid as G, mesh
from terragrid.operators.resize import resize
from terragrid.plans import surfaces

SF = "/root/testdata/sf0.001"


def as_cells(spark, a):
    rows = [(r + 1, c + 1, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "row int, col int, val double")


def as_array(df, shape):
    out = np.full(shape, np.nan)
    for r in df.select("row", "col", "val").collect():
        out[r.row - 1, r.col - 1] = np.nan if r.val is None else r.val
    return out


def filled(a):
    """Least squares of second differences in one dense solve."""
    n, m = a.shape
    unknown = {p: i for i, p in enumerate(zip(*np.where(np.isnan(a))))}
    rows, right = [], []
    for r in range(n):
        for c in range(m):
            stencil = {}
            for on, dr, dc in ((0 < r < n - 1, 1, 0), (0 < c < m - 1, 0, 1)):
                for k, v in ((-1, 1), (0, -2), (1, 1)) if on else ():
                    p = (r + k * dr, c + k * dc)
                    stencil[p] = stencil.get(p, 0) + v
            if any(p in unknown for p in stencil):
                row = np.zeros(len(unknown))
                for p, v in stencil.items():
                    if p in unknown:
                        row[unknown[p]] = v
                rows.append(row)
                right.append(-sum(v * a[p] for p, v in stencil.items() if p not in unknown))
    x = np.linalg.lstsq(np.array(rows), np.array(right), rcond=None)[0]
    out = a.copy()
    for p, i in unknown.items():
        out[p] = x[i]
    return out


@pytest.mark.parametrize("block", [24, 3])
def test_gaps_equal_a_direct_solve_for_any_block(spark, block):
    rng = np.random.default_rng(5)
    a = np.cumsum(rng.normal(size=(7, 11)), axis=1)
    a[2:5, 3:8] = np.nan  # over two small blocks
    a[0, 0] = a[6, 10] = np.nan  # corners
    got = as_array(gaps.inpaint(as_cells(spark, a), G.Axes(0, 6, 1, 1, 11, 7), block=block), a.shape)
    assert np.allclose(got, filled(a), atol=1e-6)


def test_gaps_lines_planes_and_grids_without_values(spark):
    a = np.array([[1.0, np.nan, 3.0, np.nan, np.nan, 6.0, 7.0]])
    assert np.allclose(as_array(gaps.inpaint(as_cells(spark, a), G.Axes(0, 0, 1, 1, 7, 1)), a.shape), [np.arange(1, 8)])
    r, c = np.mgrid[:9, :9]
    plane = 2.0 * r - 3.0 * c + 1
    hole = plane.copy()
    hole[:4, 5:] = np.nan
    absent = as_cells(spark, hole).where("val is not null")  # cells without a row are missing too
    assert np.allclose(as_array(gaps.inpaint(absent, G.Axes(0, 8, 1, 1, 9, 9)), plane.shape), plane, atol=1e-6)
    none = gaps.inpaint(spark.createDataFrame([], "row int, col int, val double"), G.Axes(0, 1, 1, 1, 2, 2)).collect()
    assert len(none) == 4 and all(r.val is None for r in none)
    whole = gaps.inpaint(as_cells(spark, plane), G.Axes(0, 8, 1, 1, 9, 9))
    assert np.array_equal(as_array(whole, plane.shape), plane)


def loop(points, faces, t, rounds, moves):
    v = points.copy()
    n = np.array([np.cross(v[b] - v[a], v[c] - v[a]) for a, b, c in faces])
    n /= np.linalg.norm(n, axis=1)[:, None]
    near = [[g for g, o in enumerate(faces) if set(f) & set(o)] for f in faces]
    for _ in range(rounds):
        new = np.array([sum(max(n[f] @ n[g] - t, 0) ** 2 * n[g] for g in near[f]) for f in range(len(faces))])
        n = new / np.linalg.norm(new, axis=1)[:, None]
    for _ in range(moves):
        c = np.array([v[list(f)].mean(axis=0) for f in faces])
        step = np.zeros_like(v)
        for k in range(len(v)):
            mine = [f for f, o in enumerate(faces) if k in o]
            if mine:
                step[k] = np.mean([n[f] * (n[f] @ (c[f] - v[k])) for f in mine], axis=0)
        v = v + step
    return v


def test_mesh_equals_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    a = np.where(np.arange(7) > 3, 4.0, 0.0)[None, :] + rng.normal(scale=0.2, size=(6, 7))
    a[2, 2] = a[0, 6] = np.nan
    axes = G.Axes(10.0, 20.0, 2.0, 1.0, 7, 6)
    vertices, faces = mesh.grid_mesh(as_cells(spark, a), axes)
    ids = sorted((r.vertex, r.x, r.y, r.z) for r in vertices.collect())
    at = {r[0]: i for i, r in enumerate(ids)}
    plain = [tuple(at[v] for v in (r.a, r.b, r.c)) for r in faces.orderBy("face_id").collect()]
    # 30 squares; the gap inside is a corner of four squares, the one in the corner of one: each leaves one triangle
    assert len(ids) == 40 and len(plain) == 2 * 25 + 5
    want = loop(np.array([r[1:] for r in ids]), plain, 0.5, 2, 3)
    got = {r.vertex: (r.x, r.y, r.z) for r in mesh.smooth(vertices, faces, 0.5, 2, 3).collect()}
    assert np.allclose([got[r[0]] for r in ids], want, atol=1e-9)
    assert all(r.nz > 0 for r in mesh.face_normals(faces, vertices).collect())


def test_denoise_keeps_planes_gaps_and_steps(spark):
    axes = G.Axes(0.0, 9.0, 1.0, 1.0, 10, 10)
    r, c = np.mgrid[:10, :10]
    plane = 0.5 * r + 0.25 * c
    plane[4, 4] = np.nan
    assert np.allclose(as_array(mesh.denoise(as_cells(spark, plane), axes), plane.shape), plane, atol=1e-6, equal_nan=True)
    rng = np.random.default_rng(1)
    step = np.where(c > 4, 20.0, 0.0)
    noisy = step + rng.normal(scale=0.05, size=step.shape)
    got = as_array(mesh.denoise(as_cells(spark, noisy), axes), step.shape)
    flat = (c < 3) | (c > 6)
    assert np.abs(got - step)[flat].std() < np.abs(noisy - step)[flat].std() and np.abs(got - step)[flat].max() < 0.3
    assert mesh.denoise(spark.createDataFrame([], "row int, col int, val double"), axes).count() == 0
    alone = mesh.denoise(spark.createDataFrame([(3, 4, 5.0)], "row int, col int, val double"), axes).collect()
    assert [(x.row, x.col, x.val) for x in alone] == [(3, 4, 5.0)]


def line(n, scale, method, antialias):
    out = int(np.ceil(n * scale))
    shrink = scale if antialias and scale < 1 and method != "nearest" else 1.0
    w = np.zeros((out, n))
    for o in range(out):
        u = (o + 1) / scale + 0.5 * (1 - 1 / scale)
        for s in range(-2 * n + 1, 3 * n):
            t = (u - s) * shrink
            a = abs(t)
            k = {"bilinear": max(1 - a, 0), "nearest": float(-0.5 <= t < 0.5), "bicubic": 1.5 * a**3 - 2.5 * a * a + 1 if a <= 1 else -0.5 * a**3 + 2.5 * a * a - 4 * a + 2 if a <= 2 else 0}[method]
            i = (s - 1) % (2 * n)
            w[o, i if i < n else 2 * n - 1 - i] += k
    return w / w.sum(axis=1)[:, None]


@pytest.mark.parametrize("method, scale, antialias", [("bicubic", 0.4, True), ("bicubic", 0.4, False), ("bicubic", 2.0, True), ("bilinear", 0.3, True), ("nearest", 0.5, True)])
def test_resize_equals_dense_weights(spark, method, scale, antialias):
    a = np.random.default_rng(2).normal(size=(9, 12))
    want = line(9, scale, method, antialias) @ a @ line(12, scale, method, antialias).T
    assert np.allclose(as_array(resize(as_cells(spark, a), 9, 12, scale, method, antialias), want.shape), want)


def test_resize_missing_and_wrong(spark):
    a = np.ones((8, 8))
    a[0, 0] = np.nan
    got = as_array(resize(as_cells(spark, a), 8, 8, 0.5, "bilinear"), (4, 4))
    assert np.isnan(got[0, 0]) and np.allclose(got[2:, 2:], 1)
    assert resize(spark.createDataFrame([], "row int, col int, val double"), 8, 8, 0.5).count() == 0
    with pytest.raises(ValueError):
        resize(as_cells(spark, a), 8, 8, 0.5, "cubic")


@pytest.mark.parametrize("name", ["inpaint_spots", "mesh_normals", "mesh_smooth", "resize_grid"])
def test_queries_equal_sql(spark, name):
    got = surfaces.QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()
    con = duckdb.connect()
    con.execute("create view lineitem as select * from '/root/testdata/sf0.01/lineitem.parquet'")
    want = con.execute(surfaces.ORACLES[name]).df()[list(got.columns)]
    keys = [c for c in got.columns if c in ("method", "scale", "row", "col", "face_id", "vertex")]
    got, want = (d.sort_values(keys).reset_index(drop=True) for d in (got, want))
    assert len(got) == len(want) > 0
    for c in got.columns:
        assert (got[c] == want[c]).all(), (c, got[got[c] != want[c]].head(), want[got[c] != want[c]].head())


def test_holes_of_blocks_are_filled(spark):
    assert surfaces.QUERIES["inpaint_holes"](spark, SF).where("val is not null").count() == 500
    assert surfaces.QUERIES["mesh_denoise"](spark, SF).count() == surfaces.cells(spark, SF).count()
