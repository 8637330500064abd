"""Every query with SQL against DuckDB, and the estimators against known answers."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terragrid.functions import projections as P
from terragrid.functions import semantics as S
from terragrid.operators import estimators as E
from terragrid.operators import gaps
from terragrid.operators import grid as G
from terragrid.operators import spatial as X
from terragrid.plans import more, queries, regional, stages
from terragrid.streaming import windows
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    clean = lambda v: None if v is None or v != v else round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(clean(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(regional.ORACLES))
def test_query_matches_sql(spark, db, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = db.sql(f"select {', '.join(f'\"{c}\"' for c in columns)} from ({queries.ORACLES[name]})").fetchall()
    assert plain(map(tuple, got.select(columns).collect())) == plain(want)


def test_missing_values(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (float("inf"),), (2.5,), (-2.5,), (1e9,)], "v double")
    got = [r[0] for r in df.select(S.saturate(S.null_nan(F.col("v")), 0, 255)).collect()]
    assert got == [0, 0, 0, 3, 0, 255]
    assert df.limit(0).agg(F.count("*")).head()[0] == 0 and S.hazen(df.limit(0), "v", [0.5]).count() == 0
    five = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 10)], "v double")
    assert {r.q: r.value for r in S.hazen(five, "v", [0.05, 0.5, 0.95]).collect()} == {0.05: 1.0, 0.5: 3.0, 0.95: 10.0}


def test_axes_reject_bad_input():
    with pytest.raises(ValueError):
        G.Axes(0, 0, 1, -1, 5, 5)
    assert G.Axes.of_limits((0, 10), (0, 5), 1, 1).nrows == 5 and G.Axes.of_limits((0, 10), (0, 5), 1, 1, True).ncols == 11


def test_horn_recovers_a_similarity(spark):
    rng = np.random.default_rng(0)
    r, s, t = P.rotation(14, 23, -37), 1.7, np.array([0.1, 1.2, 1.1])
    p = rng.normal(size=(200, 3))
    rows = [tuple(map(float, (*a, *(s * r @ a + t)))) for a in p] + [(None, 0.0, 0.0, 1.0, 1.0, 1.0), (float("nan"), 0.0, 0.0, 1.0, 1.0, 1.0)]
    found = E.horn(spark.createDataFrame(rows, "x double, y double, z double, tx double, ty double, tz double"))
    assert np.allclose(found.matrix, np.column_stack([s * r, t])) and found.rms < 1e-6


def test_ransac_ignores_wrong_pairs(spark):
    row = queries.ransac(spark, SF).head()
    assert np.allclose([row.scale, row.sx, row.sy], [1, 10, -20], atol=1e-6)


def test_icp_finds_the_motion(spark):
    shift = [r.shift for r in queries.icp(spark, SF).collect()]
    assert np.allclose(shift, [-0.4, 0.3, -2.0], atol=0.1)


def test_published_polynomial_fit(spark):
    rows = [(float(x), math.cos(x)) for x in np.arange(-2, 2.01, 0.1)]
    fit = E.polyfit(spark.createDataFrame(rows, "x double, y double"), ["x"], "y", E.parse_terms("constant, x^2, x^4, x^6")[1])
    assert np.allclose(fit["coef"], [0.99996, -0.49968, 0.041242, -0.0012079], atol=1e-4) and fit["rmse"] < 1e-4 and fit["r2"] > 0.999999
    assert E.derivative([(2,), (0,)], [3.0, 1.0], 0) == ([(1,)], [6.0])


def test_two_unknowns_of_the_worked_example(spark):
    values = [[0, 0, 0, 0], [1, None, None, 4], [2, 3, 5, 8]]
    cells = [(r + 1, c + 1, None if v is None else float(v)) for r, row in enumerate(values) for c, v in enumerate(row)]
    got = {(r.row, r.col): r.val for r in gaps.inpaint(spark.createDataFrame(cells, "row int, col int, val double"), G.Axes(0, 0, 1, 1, 4, 3), method="neighbours").collect()}
    assert abs(got[2, 2] - 25 / 15) < 1e-4 and abs(got[2, 3] - 40 / 15) < 1e-4


def test_triangulation_returns_the_points(spark):
    for r in queries.triangulate(spark, SF).collect():
        assert np.allclose([r.x, r.y, r.z], r.pt_id, atol=1e-5) and r.error < 1e-5


def test_simplex_and_cosine_shift(spark):
    best, value, log = E.simplex(lambda v: float((v[0] - 3) ** 2 + (v[1] + 1) ** 2), np.zeros(2), np.ones(2), rounds=200, settled=1e-12)
    assert np.allclose(best, [3, -1], atol=1e-3) and log[0] >= value
    rows = [(float((7 * math.cos(math.radians(40 - a)) + 2) * math.tan(math.radians(s))), float(s), float(a)) for a in range(0, 360, 7) for s in (10, 30)]
    got = E.cosine_shift(spark.createDataFrame(rows, "d double, slope double, aspect double"))
    assert np.allclose([got["a"], got["b"], got["c"]], [7, 40, 2])


def test_georeference_end_to_end(spark):
    axes, ref, pts = queries._scene(spark, (0.6, -0.4, 3.0))
    found = stages.georeference(pts, ref, axes, rounds=4, shift_step=0.2)
    assert found.rmse < 1.0 and "z" in found.apply(pts).columns


def test_regions_record_errors_and_chains_can_be_undone(spark):
    axes, ref, pts = queries._scene(spark, (0.0, 0.0, 3.0))
    wide = pts.withColumns({"region_id": (F.col("pt_id") % 3).cast("long"), "window_id": (F.col("pt_id") % 6).cast("long")})
    wide = wide.where("region_id < 2 or pt_id < 30").withColumn("z", F.when(F.col("region_id") == 1, F.col("z") + 5000).otherwise(F.col("z")))
    windows_ = spark.createDataFrame([(w % 3, w, 500) for w in range(6)], "region_id long, window_id long, expected long")
    first = [stages.Step("matrix", (np.column_stack([np.eye(3), [0, 0, -1.0]]),))]
    placed, lineage = stages.georeference_regions(wide, windows_, first, ref, axes, attempts=2, retry_over=1.0, bounds={"shift": (0.0, 0.0, 8.0)}, rounds=8)
    got = {r.window_id: r for r in lineage.collect()}
    assert len(got) == 6 and got[0].rmse < 1 and got[2].error.startswith("0.0") and got[1].attempts == 2
    z = placed.groupBy("region_id").agg(F.count("z").alias("n")).collect()
    assert {r.region_id: r.n > 0 for r in z} == {0: True, 1: False}
    back = stages.undo_chain(placed.where("region_id = 0 and z is not null"), stages.chain_of(got[0].chain)).join(wide.select("pt_id", F.col("z").alias("z0"), F.col("x").alias("x0")), "pt_id")
    assert back.agg(F.max(F.abs(F.col("z") - F.col("z0")) + F.abs(F.col("x") - F.col("x0")))).head()[0] < 1e-9


def test_guarded_groups_and_large_holes(spark):
    def fail(key, frame):
        if key[0] == 1:
            raise ValueError("no")
        return frame[["g", "v"]]

    got = spark.createDataFrame([(1, 1.0), (2, 2.0)], "g int, v double").groupBy("g").applyInPandas(stages.guarded(fail, ["g", "v"]), "g int, v double, error string").collect()
    assert sorted((r.g or 0, r.error or "") for r in got) == [(0, "ValueError: no"), (2, "")]
    axes = G.Axes(0, 15, 1, 1, 16, 16)
    plane = axes.cells(spark).select("row", "col", (2.0 * F.col("row") - F.col("col")).alias("val"))
    hole = plane.where("not (row between 3 and 13 and col between 3 and 13)")
    out = gaps.inpaint(hole, axes).join(plane.withColumnRenamed("val", "want"), ["row", "col"])
    assert out.count() == 16 * 16 and out.agg(F.max(F.abs(F.col("val") - F.col("want")))).head()[0] < 1e-6



def test_nearest_far_away_and_reprojection(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0)], "id long, x double, y double")
    right = spark.createDataFrame([(7, 1e6, 0.0)], "id long, x double, y double")
    assert [(r.id, r.rid) for r in X.nearest_2d(left, right, 10.0, 3).collect()] == [(1, 7)]
    pair = P.reproject(P.Projection("utm", (32, "N")), P.Projection("ps", (0.0, 71.0)))
    back = P.reproject(P.Projection("ps", (0.0, 71.0)), P.Projection("utm", (32, "N")))
    p = spark.createDataFrame([(500_000.0, 7_900_000.0)], "x double, y double")
    there = p.select(*[c.alias(n) for c, n in zip(pair(F.col("x"), F.col("y")), "xy")])
    r = there.select(*[c.alias(n) for c, n in zip(back(F.col("x"), F.col("y")), "xy")]).head()
    assert abs(r.x - 500_000) < 1e-2 and abs(r.y - 7_900_000) < 1e-2


def test_components_and_holes(spark):
    axes = G.Axes(0, 0, 1, 1, 7, 7)
    ring = [(r, c) for r in range(2, 7) for c in range(2, 7) if r in (2, 6) or c in (2, 6)] + [(1, 1)]
    mask = spark.createDataFrame(ring, "row int, col int")
    assert G.fill_holes(mask, axes).count() == 26
    assert G.area_open(mask, 17).count() == 17 and G.area_open(mask, 18).count() == 0
    assert G.clear_border(mask, axes).count() == 0


def test_nearest_needs_no_lucky_bucket(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 900.0, 900.0)], "id long, x double, y double")
    right = spark.createDataFrame([(7, 500.0, 0.0), (8, 0.0, 500.0)], "id long, x double, y double")
    got = {r.id: r.rid for r in X.nearest_2d(left, right, 10.0).collect()}
    assert got[1] == 7 and set(got) == {1, 2}


def test_tiles_agree_with_the_whole(spark):
    cells = G.Axes(0, 9, 1, 1, 10, 10).cells(spark).withColumn("val", F.col("row") * F.col("col"))

    def blur(key, frame):
        frame["val"] = frame.apply(lambda r: frame[(abs(frame.row - r.row) <= 1) & (abs(frame.col - r.col) <= 1)].val.mean(), axis=1)
        own = frame[((frame.row - 1) // key[2] == key[0]) & ((frame.col - 1) // key[2] == key[1])] if len(key) > 2 else frame
        return own[["row", "col", "val"]]

    made = [sorted(map(tuple, G.tile_map(cells.select("row", "col", "val"), t, lambda k, f, t=t: blur((*k, t), f), "row int, col int, val double", halo=1).collect())) for t in (4, 100)]
    assert made[0] == made[1]


def test_stream_of_point_files(spark, tmp_path):
    axes = G.Axes(0, 9, 1, 1, 10, 10)
    pts = spark.range(500).select((F.col("id") % 10).cast("double").alias("x"), (F.floor(F.col("id") / 10) % 10).cast("double").alias("y"), F.col("id").cast("double").alias("z"))
    for part in (0, 1):
        pts.where(F.col("z") % 2 == part).write.mode("append").parquet(str(tmp_path / "in"))
        windows.rasterize_arrivals(spark, str(tmp_path / "in"), "x double, y double, z double", str(tmp_path / "out"), str(tmp_path / "check"), axes).awaitTermination()
    got = sorted((r.row, r.col, r.val) for r in windows.arrived(spark, str(tmp_path / "out")).collect())
    assert got == sorted((r.row, r.col, r.val) for r in G.cell_mean(pts, axes).collect())


def test_entry_and_rows_only_queries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert queries.inpaint(spark, SF).count() == 1600


def test_regions_fitted_together_equal_regions_fitted_alone(spark):
    axes, ref, pts = queries._scene(spark, (0.0, 0.0, 0.0))
    moved = pts.withColumn("g", (F.col("pt_id") % 3).cast("long")).withColumn("z", F.col("z") - 2.0 * F.col("g"))
    bounds = {"shift": (1.0, 1.0, 8.0), "whole": 0.1}
    every = stages.optimise_each(moved, ["g"], ref, axes, bounds=bounds, rounds=5, settled=1e-6)
    for g in range(2):
        v, e, log = stages.optimise(moved.where(F.col("g") == g), ref, axes, bounds=bounds, rounds=5, settled=1e-6)
        (w, f, more_) = every[g,]
        assert np.allclose(v["shift"], w["shift"], atol=1e-6) and abs(e - f) < 1e-6 and len(log) == len(more_) == 5
    assert every[0,][1] < every[2,][1] < 4


def test_jobs_grow_with_rounds_not_with_regions(spark):
    axes, ref, pts = queries._scene(spark)
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for n in (1, 6):
        spark.sparkContext.setJobGroup(f"fit{n}", "fit")
        p = pts.where("pt_id < 600").withColumn("g", F.col("pt_id") % n)
        stages.optimise_each(p, ["g"], ref, axes, bounds={"shift": (0.0, 0.0, 5.0)}, rounds=2, settled=0.0)
        jobs.append(len(tracker.getJobIdsForGroup(f"fit{n}")))
    spark.sparkContext.setJobGroup("tests", "tests")
    assert jobs[1] <= 1.5 * jobs[0]


def test_curvature_near_masks_and_way_back(spark):
    """Points on a flat model of an ellipsoid's patch are bent to it; windows are fitted once more by themselves."""
    x0, y0 = 500_000.0, 4_000_000.0
    axes = G.Axes(x0 - 2000, y0 + 2000, 200.0, 200.0, 21, 21)
    ref = axes.cells(spark).withColumn("val", 300 + 40 * F.sin((F.col("x") - x0) / 900) + 30 * F.cos((F.col("y") - y0) / 700)).select("row", "col", "val")
    n = F.col("id")
    pts = spark.range(4000).select(n.alias("pt_id"), (n % 2).alias("region_id"), (n % 4).alias("window_id"), (x0 - 1800 + (n * 7919 % 3600)).cast("double").alias("x"), (y0 - 1800 + (n * 104729 % 3600)).cast("double").alias("y"))
    pts = pts.withColumn("z", 300 + 40 * F.sin((F.col("x") - x0) / 900) + 30 * F.cos((F.col("y") - y0) / 700) + 3 * F.col("region_id") + F.when(F.col("pt_id") % 50 == 0, 900).otherwise(0))
    windows_ = spark.createDataFrame([(w % 2, w, 900) for w in range(4)], "region_id long, window_id long, expected long")
    links = spark.createDataFrame([(r, x, y, z, x, y, z - 3.0 * r) for r in range(2) for x, y, z in ((x0, y0, 0.0), (x0 + 900, y0, 5.0), (x0, y0 + 800, 9.0), (x0 + 500, y0 + 500, 3.0))], "region_id long, x double, y double, z double, tx double, ty double, tz double")
    placed, lineage = stages.georeference_regions(pts, windows_, [], ref, axes, links=links, attempts=1, bounds={"shift": (0.0, 0.0, 20.0)}, rounds=6, zone=(33, "N"), separately=True, near=50.0)
    got = lineage.collect()
    assert len(got) == 4 and all(r.error is None and r.rmse < 2 for r in got)
    kinds = [s.kind for s in stages.chain_of(got[0].chain)]
    assert kinds == ["matrix", "curve", "solver", "solver"]
    rows = placed.join(pts.select("pt_id", F.col("x").alias("x1"), F.col("y").alias("y1")), "pt_id")
    far = rows.agg(F.max(F.abs(F.col("x") - F.col("x1"))), F.sum(F.when(F.col("z").isNull(), 1).otherwise(0)), F.count("z"), F.max("lon"), F.min("lat")).head()
    assert far[0] < 3 and far[1] == 80 and far[2] == 3920  # spikes far over the reference are cut
    assert abs(far[3] - 15) < 0.1 and abs(far[4] - 36.1) < 0.1
    back = stages.undo_chain(placed.where("window_id = 1 and z is not null"), stages.chain_of(next(r.chain for r in got if r.window_id == 1)))
    worst = back.join(pts.select("pt_id", F.col("x").alias("x1"), F.col("z").alias("z1")), "pt_id").agg(F.max(F.abs(F.col("x") - F.col("x1")) + F.abs(F.col("z") - F.col("z1")))).head()[0]
    assert worst < 1e-2


def test_reference_is_prepared_on_the_map(spark):
    rows = [(15.0 + i * 0.001, 36.0 + j * 0.001, 100.0 + i) for i in range(12) for j in range(12)]
    terrain = spark.createDataFrame([*rows, (15.0, 36.0, None)], "lon double, lat double, val double")
    square = spark.createDataFrame([(1, 0, k, x, y) for k, (x, y) in enumerate([(15.0045, 36.0045), (15.0065, 36.0045), (15.0065, 36.0065), (15.0045, 36.0065)])], "poly_id long, ring_id int, vtx_id int, x double, y double")
    axes, ref, mask = stages.prepare_reference(terrain, square, 33, "N", reach=0)
    assert (axes.dx, axes.dy) == (90.0, 90.0) and axes.ncols in (13, 14) and axes.nrows in (15, 16)
    assert ref.agg(F.min("val"), F.max("val")).head() == (100.0, 111.0) and ref.count() == 144
    assert mask.count() == 4 and stages.prepare_reference(terrain, square, 33, "N", reach=1)[2].count() == 12
    with pytest.raises(ValueError):
        stages.prepare_reference(terrain.limit(0), square, 33, "N")


def test_control_points_recover_a_planted_similarity(spark):
    from terragrid.operators import control

    rng, n = np.random.default_rng(5), 70
    bumps = [(*rng.uniform(0, n, 2), rng.uniform(-30, 40), rng.uniform(3, 6)) for _ in range(60)]
    height = lambda x, y: float(sum(a * np.exp(-((x - p) ** 2 + (y - q) ** 2) / (2 * s * s)) for p, q, a, s in bumps))
    axes, c, s = G.Axes(0.0, n - 1.0, 1.0, 1.0, n, n), math.cos(math.radians(25)), math.sin(math.radians(25))
    grid = lambda f: spark.createDataFrame([(r, q, f(q - 1.0, float(n - r))) for r in range(1, n + 1) for q in range(1, n + 1)], "row int, col int, val double")
    turned = grid(lambda x, y: height(c * (x - 35) - s * (y - 35) + 35, s * (x - 35) + c * (y - 35) + 35))
    scale, found, inliers = control.control_points(turned, axes, grid(height), axes, scales=[0.8, 1.0], most=(60, 120), inlier=1.5, hypotheses=300, angles=72)
    assert scale == 1.0 and inliers.count() >= 15 and abs(found.scale - 1) < 0.02
    assert abs(math.degrees(math.atan2(found.rotation[1, 0], found.rotation[0, 0])) - 25) < 1
    flat = turned.withColumn("val", F.lit(1.0))
    with pytest.raises(ValueError):
        control.control_points(flat, axes, flat, axes, scales=[1.0], most=(5, 5), hypotheses=10, angles=8)


def test_polygon_boxes_reach_the_scan_and_clips_are_exact(spark, tmp_path):
    from terragrid.sources import polygons as V

    path = str(tmp_path / "polygons")
    V.write_polygons(regional._diamonds(spark, SF), path, 1.0)
    plan = V.read_polygons(spark, [path], (1.0, 2.0, 3.0, 4.0))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(px0)" in plan and "LessThanOrEqual(px0,3.0)" in plan
    key = lambda x, y: spark.range(1).select(V.morton(F.lit(x), F.lit(y))).head()[0]
    assert [key(x, y) for x, y in ((0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (65535, 65535))] == [0, 1, 2, 3, 4, (1 << 32) - 1]
    ring = lambda *ps: F.lit(None) if not ps else F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ps])
    unit = ring((0, 0), (4, 0), (4, 4), (0, 4))
    for other, want in ((ring((1, 1), (9, 1), (9, 2), (1, 2)), 3.0), (ring((5, 5), (6, 5), (6, 6)), 0.0), (ring((1, 1), (2, 1), (1, 2)), 0.5), (ring((-9, 2), (2, -9), (13, 2), (2, 13)), 16.0), (ring((0, 0), (8, 0), (0, 8)), 16.0)):
        assert abs(spark.range(1).select(V.area(V.clip_convex(other, unit))).head()[0] - want) < 1e-9
    # a hole of one file doesn't open another file's polygon
    square = lambda f, ring_id, a, b: [(f, 1, ring_id, k, x, y) for k, (x, y) in enumerate(((a, a), (b, a), (b, b), (a, b)))]
    both = spark.createDataFrame(square(0, 0, 0.0, 9.0) + square(0, 1, 3.0, 6.0) + square(1, 0, 4.0, 5.0), "file_id int, poly_id long, ring_id int, vtx_id int, x double, y double")
    at = spark.createDataFrame([(1, 1.5, 1.5), (2, 3.5, 3.5), (3, 4.5, 4.5), (4, 9.5, 1.0)], "pt_id long, x double, y double")
    assert sorted(r.pt_id for r in V.covered(at, V.edge_table(both), 2.0).collect()) == [1, 3]


def test_footprints_at_edges_and_holes(spark):
    from terragrid.operators.summed import local_deviation

    rng = np.random.default_rng(1)
    v = rng.integers(0, 255, (9, 13)).astype(float)
    axes, grid = G.Axes(0, 8, 1, 1, 13, 9), spark.createDataFrame([(r + 1, c + 1, float(v[r, c])) for r in range(9) for c in range(13) if (r, c) != (4, 4)], "row int, col int, val double")
    at = axes.cells(spark).select(((F.col("col").cast("long") - 1) * 9 + F.col("row")).alias("pt_id"), "row", "col")
    v[4, 4] = np.nan
    for hr, hc in ((1, 1), (3, 5), (9, 13)):
        wide = np.pad(v, ((hr, hr), (hc, hc)), mode="symmetric")
        for r in local_deviation(at, grid, axes, hr, hc).collect():
            row, col = (r.pt_id - 1) % 9, (r.pt_id - 1) // 9
            part = wide[row : row + 2 * hr + 1, col : col + 2 * hc + 1]
            part = part[~np.isnan(part)]
            assert r.n == part.size and abs(r.mean - part.mean()) < 1e-9 and abs(r.deviation - part.std(ddof=1)) < 1e-9
    with pytest.raises(ValueError):
        local_deviation(at, grid, axes, 10, 1)


def test_pyramid_registration_recovers_a_motion(spark):
    from terragrid.operators import registration

    axes, ref, pts = queries._scene(spark)
    face = G.surface(ref, 1.0, 1.0).join(axes.cells(spark), ["row", "col"])
    model = face.select(((F.col("col").cast("long") - 1) * 40 + F.col("row")).alias("id"), "x", "y", F.col("val").alias("z"), "nx", "ny", "nz")
    turn, shift = P.rotation(4, -3, 6), np.array([1.5, -1.0, 2.0])
    inner = pts.where("x between 6 and 33 and y between 6 and 33 and pt_id < 700").select(F.col("pt_id").alias("id"), "x", "y", "z")
    wild = inner.where("id < 60").select((F.col("id") + 10_000).alias("id"), "x", "y", (F.col("z") + 90).alias("z"))  # rejected
    missing = inner.where("id = 1").select(F.lit(-1).cast("long").alias("id"), "x", "y", F.lit(None).cast("double").alias("z"))
    moved = inner.union(wild).union(missing)
    moved = moved.select("id", *[c.alias(n) for n, c in zip("xyz", P.apply_matrix(np.column_stack([turn, shift]), F.col("x"), F.col("y"), F.col("z")))])
    got = registration.icp_pyramid(moved, model, levels=2, iterations=10, tolerance=1e-3)
    corners = np.array([[10, 10, 0], [30, 10, 20], [10, 30, -10], [30, 30, 5.0]]).T
    back = got[:, :3] @ (turn @ corners + shift[:, None]) + got[:, [3]]
    assert np.abs(back - corners).max() < 0.3
    with pytest.raises(ValueError):
        registration.icp_pyramid(moved.limit(0), model)


def test_first_placement_finds_its_control_points(spark):
    rng, n = np.random.default_rng(8), 56
    bumps = [(*rng.uniform(0, n, 2), rng.uniform(-30, 40), rng.uniform(3, 5)) for _ in range(50)]
    height = lambda x, y: float(sum(a * np.exp(-((x - p) ** 2 + (y - q) ** 2) / (2 * s * s)) for p, q, a, s in bumps))
    axes = G.Axes(0.0, n - 1.0, 1.0, 1.0, n, n)
    ref = spark.createDataFrame([(r, q, height(q - 1.0, float(n - r))) for r in range(1, n + 1) for q in range(1, n + 1)], "row int, col int, val double")
    turn, shift = P.rotation(0, 0, 12), np.array([4.0, -3.0, 0.0])
    world = np.column_stack([rng.uniform(1, n - 2, (9000, 2)), np.zeros(9000)])
    world[:, 2] = [height(x, y) for x, y, _ in world]
    frame = (world - shift - [28, 28, 0]) @ turn + [28, 28, 0]  # turned back about the middle
    pts = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(frame)], "pt_id long, x double, y double, z double")
    rough = stages.Step("matrix", (np.eye(3, 4),))
    options = {"scales": [1.0], "most": (50, 100), "inlier": 1.5, "hypotheses": 300, "angles": 72}
    found = stages.automatic_controls(pts, rough, ref, axes, **options)
    assert found.columns == ["x", "y", "z", "tx", "ty", "tz"] and found.count() >= 8
    m = E.horn(found).matrix
    off = np.abs(m[:, :3] @ frame.T + m[:, [3]] - world.T)  # pairs stand at whole cells
    assert off.mean() < 1 and off.max() < 3
    with pytest.raises(ValueError):
        stages.initial_transform(pts, None, ref, axes)
    placed = stages.initial_transform(pts, found, ref, axes, rounds=2, shift=2.0)
    assert placed.rmse < 5 and placed.chain[0].kind == "matrix"
