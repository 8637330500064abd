"""Copies, crowds and plans that small tables don't show."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terragrid.functions import semantics as S
from terragrid.operators import estimators as E
from terragrid.operators import grid as G
from terragrid.operators import spatial as X
from terragrid.plans import stages
from terragrid.sources import polygons as V


@pytest.mark.parametrize("distance", ["squared", "bits", "entries"])
def test_matches_of_many_copies(spark, distance):
    """Copies of a few descriptors over several tiles, with ties, against all pairs; missing entries match nothing."""
    rng = np.random.default_rng(3)
    kinds = rng.integers(0, 4, size=(60, 5))
    rows = [(int(i % 2), int(i), [float(v) for v in kinds[rng.integers(60)]]) for i in range(400)]
    df = spark.createDataFrame([*rows, (0, 900, [1.0, None, 0.0, 0.0, 0.0]), (0, 901, None)], "b int, id long, d array<double>")
    got = {(r.id, r["rank"]): (r.tid, round(r.distance, 9)) for r in X.match(df, df, ["b"], distance, 2, other=True, tile=16, digits=6 if distance == "squared" else None).collect()}
    far = {"squared": lambda p, q: float(((p - q) ** 2).sum()), "bits": lambda p, q: sum(int(v).bit_count() for v in p.astype(int) ^ q.astype(int)), "entries": lambda p, q: float((p != q).mean())}[distance]
    want = {}
    for b, i, d in rows:
        near = sorted((round(far(np.array(d), np.array(e)), 9), j) for c, j, e in rows if c == b and j != i)[:2]
        want.update({(i, n + 1): (j, v) for n, (v, j) in enumerate(near)})
    assert got == want


def test_nearest_of_crowded_places(spark):
    """Many points at a few places and one far off: pairs are made by place, results by id."""
    right = spark.range(4000).select("id", (F.col("id") % 5 * 1.0).alias("x"), F.when(F.col("id") == 3999, 1e5).otherwise(0.0).alias("y"))
    left = spark.range(3000).select("id", (F.col("id") % 3 * 1.0 + 0.25).alias("x"), F.lit(0.0).alias("y"))
    got = X.nearest_2d(left, right, 100.0, 2)
    assert sorted((r.id, r["rank"], r.rid, r.distance) for r in got.where("id < 3").collect()) == [(i, k + 1, i + 5 * k, 0.25) for i in range(3) for k in range(2)]
    assert got.count() == 6000
    rng = np.random.default_rng(5)
    p, q = rng.normal(size=(300, 2)) ** 5, rng.normal(size=(400, 2)) ** 5
    table = lambda a: spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(a)], "id long, x double, y double")
    want = {i: int(np.hypot(*(q - v).T).argmin()) for i, v in enumerate(p)}
    assert {r.id: r.rid for r in X.nearest_2d(table(p), table(q), 50.0).collect()} == want


def test_cell_means_that_no_order_changes(spark):
    """Sums of a cell's elevations in cents are exact: two orders of the same points give the same error."""
    axes = G.Axes(0.0, 0.0, 1.0, 1.0, 1, 1)
    z = [0.1, 0.2, 0.3, 1e9, -1e9 + 0.4]
    error = lambda zs: E.vertical_error(spark.createDataFrame([(0.0, 0.0, v) for v in zs], "x double, y double, z double").coalesce(1), axes.cells(spark).select("row", "col", F.lit(0.0).alias("val")), axes, None, digits=2).head()
    assert error(z).rmse == error(z[::-1]).rmse == 0.2


def test_quantile_cells_stay_in(spark):
    """Differences are worked out once, so cells at a quantile stay in whatever a second sum would give."""
    axes = G.Axes(0.0, 0.0, 1.0, 1.0, 10, 1)
    pts = spark.range(10).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), (F.col("id") + F.rand()).alias("z"))
    ref = axes.cells(spark).select("row", "col", F.lit(0.0).alias("val"))
    assert E.vertical_error(pts.drop("g"), ref, axes, clip=(0.05, 0.95)).head().n == 10
    assert stages.trial_errors(pts, ["g"], {(1,): [np.eye(3, 4)]}, ref, axes).head().n == 10


def test_highest_neighbours_of_faces(spark):
    """Faces of one crowded vertex and of two that share most neighbours, against all pairs."""
    rows = [(i, 0) for i in range(40)] + [(i, 1) for i in range(30, 60)] + [(i, 2) for i in range(35, 45)]
    got = X.face_neighbours(spark.createDataFrame(rows, "face_id long, vertex long"), 7)
    at = {v: {f for f, w in rows if w == v} for v in (0, 1, 2)}
    want = {(f, o) for f in {f for f, _ in rows} for o in sorted(set().union(*(at[v] for g, v in rows if g == f)), reverse=True)[:7]}
    assert {(r.face_id, r.other) for r in got.collect()} == want


def test_polygon_tables_are_not_broadcast(spark):
    """Spark takes exploded polygons for small; none of the joins over them sends a side to the driver."""
    one = spark.range(1).select(F.lit(0).alias("file_id"), F.col("id").alias("poly_id"), F.lit(0).alias("ring_id"), F.explode(F.lit([0, 1, 2, 3])).alias("vtx_id"))
    square = one.select("*", F.col("vtx_id").isin(1, 2).cast("double").alias("x"), F.col("vtx_id").isin(2, 3).cast("double").alias("y"))
    points = spark.range(4).select(F.col("id").alias("pt_id"), (F.col("id") * 0.4 + 0.1).alias("x"), F.lit(0.5).alias("y"))
    got = V.covered(points, V.edge_table(square), 1.0)
    assert sorted(r.pt_id for r in got.collect()) == [0, 1, 2]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_boxes_are_spread(spark):
    """Copies of few boxes, read by one task: all pairs, none of the tasks that make them having most; odd boxes too."""
    rng = np.random.default_rng(11)
    kinds = [(float(x), float(y), float(x + w), float(y + h)) for x, y, w, h in rng.integers(0, 40, size=(12, 4))]
    rows = [(i, *kinds[i % 12]) for i in range(600)]
    schema = "id long, x0 double, y0 double, x1 double, y1 double"
    df = spark.createDataFrame([*rows, (900, 1.0, 1.0, None, 2.0), (None, 5.0, 5.0, 5.0, 5.0)], schema).coalesce(1)
    got = X.boxes_meet(df, df, 16.0, tile=4, some=8).withColumn("task", F.spark_partition_id()).collect()
    rows.append((None, 5.0, 5.0, 5.0, 5.0))
    want = [(i, j) for i, *p in rows for j, *q in rows if p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]]
    at = lambda pairs: sorted((i is None, i or 0, j is None, j or 0) for i, j in pairs)
    assert at((r.id, r.b_id) for r in got) == at(want)
    tasks = [r.task for r in got]
    assert max(tasks.count(t) for t in set(tasks)) < len(got) / 2


@pytest.mark.parametrize("most", [2, 100_000])
def test_quantiles_of_large_groups(spark, most):
    """Hazen quantiles of two large groups, one of them NULL, and a small one: no group is sorted by one task, unless
    there are more groups than are sent to all."""
    sizes = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(sizes)
    spark.conf.set(sizes, "-1")  # as for tables that Spark doesn't broadcast by itself
    v = F.pmod(F.col("id") * 7919, F.lit(100_003)).cast("double")
    df = spark.range(100_003).select(F.when(F.col("id") % 2 == 0, "a").when(F.col("id") == 1, "b").alias("g"), v.alias("v"))
    found = S.hazen(df, "v", [0.05, 0.5], ["g"], most)
    rows, plan = found.collect(), found._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(sizes, was)
    want = {}
    for g, ids in (("a", np.arange(0, 100_003, 2)), ("b", np.array([1])), (None, np.arange(3, 100_003, 2))):
        sorted_, n = np.sort(ids * 7919 % 100_003), len(ids)
        for q in (0.05, 0.5):
            h = min(max(n * q + 0.5, 1), n)
            lo, hi = sorted_[int(h) - 1], sorted_[min(int(h) + 1, n) - 1]
            want[g, q] = lo + (hi - lo) * (h - int(h))
    assert {(r.g, r.q): round(r.value, 6) for r in rows} == {k: round(float(x), 6) for k, x in want.items()}
    assert ("SortMergeJoin" in plan) == (most == 2)


def test_rasterize_reads_points_once(spark):
    """Rows that pass a counter on their way from the points to the cleaned grid."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    axes = G.Axes(0.0, 5.0, 1.0, 1.0, 6, 6)
    pts = spark.range(700).where("id % 35 <> 8").select((F.col("id") % 35 % 6).cast("double").alias("x"), F.floor(F.col("id") % 35 / 6).cast("double").alias("y"), (F.col("id") % 7).cast("double").alias("z"))
    got = stages.rasterize(pts.mapInArrow(counted, pts.schema), axes, gap_cells=4, speckle_cells=2).count()
    assert read.value == 680 and got > 20


def test_trials_of_points_at_one_place(spark, monkeypatch):
    """Points at few places are put together unless they tilt: the same errors, means and fits, from few rows."""
    rng = np.random.default_rng(2)
    xyz = [(int(i % 2), float(i % 30 % 6), float(i % 30 // 6 - 2), float(z)) for i, z in enumerate(rng.normal(size=1200) * 5 + 7)]
    pts = spark.createDataFrame([*xyz, (0, 1.0, 0.0, None)], "g int, x double, y double, z double")
    axes = G.Axes(0.0, 2.0, 1.0, 1.0, 6, 5)
    ref = axes.cells(spark).select("row", "col", (F.col("x") + F.col("y")).alias("val"))
    flat, turned = np.eye(3, 4), stages.affine({"center": [2.0, 0.0, 7.0], "rotation": [4.0, -3.0, 0.0], "shift": [0.2, 0.1, -5.0], "scale": [1.0] * 3, "whole": 1.0})
    flat[2, 3] = -6.0
    for trials in ([flat], [flat, turned]):
        got = {(r.g, r.trial): (r.n, r.rmse) for r in stages.trial_errors(pts, ["g"], {(0,): trials, (1,): trials}, ref, axes, None).collect()}
        for g in (0, 1):
            for t, m in enumerate(trials):
                held = {}
                for _, *p in (p for p in xyz if p[0] == g):
                    x, y, z = m[:, :3] @ p + m[:, 3]
                    held.setdefault((int(np.floor(x + 0.5)), int(np.floor(y + 0.5))), []).append(z)
                off = [x + y - np.mean(zs) for (x, y), zs in held.items() if 0 <= x <= 5 and -2 <= y <= 2]
                assert got[g, t][0] == len(off) and np.isclose(got[g, t][1], np.sqrt(np.mean(np.square(off))))
    rows, cut = [], stages._cut
    monkeypatch.setattr(stages, "_cut", lambda df: (kept := cut(df), rows.append(kept.count()))[0])
    found = stages.optimise_each(pts, ["g"], ref, axes, bounds={"shift": (0.0, 0.0, 20.0)}, rounds=12, settled=1e-3)
    assert rows[0] == 31
    for g in (0, 1):
        v = found[g,][0]
        mine = [p[1:] for p in xyz if p[0] == g]
        assert np.allclose(v["center"], [*np.mean([[*p[:2]] for p in mine + ([[1.0, 0.0, 0.0]] if g == 0 else [])], axis=0), np.mean([p[2] for p in mine])])


def test_rounds_of_icp_read_written_points(spark, tmp_path):
    """Points are read once whatever the rounds, and cells of halves are rounded up without decimals."""
    from terragrid.plans import queries

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    axes, ref, pts = queries._scene(spark, (0.3, -0.2, 1.0))
    face = G.surface(ref, 1.0, 1.0).join(axes.cells(spark), ["row", "col"])
    shift = E.icp(pts.mapInArrow(counted, pts.schema), face, axes, rounds=4, tolerance=0.0)[:, 3]
    assert read.value == 3000 and np.allclose(shift, [-0.3, 0.2, -1.0], atol=0.2)
    at = [(0.5, 1), (0.4999999999999998, 0), (1.4999999999999998, 1), (1.5, 2), (2.5, 3), (-0.25, 0), (float("nan"), 0)]
    got = spark.createDataFrame([(v,) for v, _ in at], "x double").select(G.Axes(1.0, 0.0, 1.0, 1.0, 9, 9).col_of(F.col("x"))).collect()
    assert [r[0] for r in got] == [n for _, n in at]
    plan = pts.select(axes.row_of(F.col("y")))._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan.lower()


def test_common_areas_of_copies_without_a_broadcast(spark):
    """Copies of few squares in two blocks over small tiles and lists: all pairs, by area, and no side at the driver."""
    square = lambda x, s: F.array(*[F.struct((x + a * s).alias("x"), F.lit(float(b * s)).alias("y")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))])
    rings = spark.range(90).select("id", (F.col("id") % 2).alias("b"), square((F.col("id") % 9).cast("double") / 2, 2).alias("ring"))
    got = V.common_areas(rings, ["b"], tile=2, some=3, digits=3)
    want = sorted((i, j, max(0.0, 2 - abs(i % 9 - j % 9) / 2) * 2) for i in range(90) for j in range(i + 1, 90) if i % 2 == j % 2)
    assert sorted(map(tuple, got.collect())) == want
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_points_are_judged_where_they_meet_polygons(spark):
    """Copies of holed polygons are met once, so their number doesn't add rows to a shuffle; strips of many edges take
    the join by polygon to the same result."""
    ring = lambda r, s: [(r, k, a * s, b * s) for k, (a, b) in enumerate(((1, 0), (0, 1), (-1, 0), (0, -1)))]
    corners = F.explode(F.lit([[float(v) for v in c] for c in ring(0, 2.0) + ring(1, 1.0)]))
    one = lambda n: spark.range(n).select((F.col("id") % 2).cast("int").alias("file_id"), F.col("id").alias("poly_id"), (F.col("id") % 4 * 3.0).alias("at"), corners.alias("c")).selectExpr("file_id", "poly_id", "cast(c[0] as int) ring_id", "cast(c[1] as int) vtx_id", "c[2] + at + 0.05 x", "c[3] + 0.03 y")
    points = spark.range(600).select(F.col("id").alias("pt_id"), (F.col("id") % 60 / 4 - 3).alias("x"), (F.floor(F.col("id") / 60) / 2.0 - 2.5).alias("y"))
    hit = lambda p, k: 1.0 <= abs(p.x - 3 * k - 0.05) + abs(p.y - 0.03) < 2.0
    want = {(p.pt_id, k) for p in points.collect() for k in range(4) if hit(p, k)}
    for most in (4096, 9, 0):
        assert {(r.pt_id, r.poly_id) for r in V.covered_by(points, V.edge_table(one(4)), 1.0, most).collect()} == want
        assert sorted(r.pt_id for r in V.covered(points, V.edge_table(one(4)), 1.0, most).collect()) == sorted({p for p, _ in want})
    met = []
    for n in (4, 400):
        few, _ = V._strips(V.edge_table(one(n)), 1.0, 4096)
        met.append(few.select(*V._BOX, "_strip", "_edges").distinct().count())
    assert met[0] == met[1] and V.covered(points, V.edge_table(one(400)), 1.0).count() == len({p for p, _ in want})


def test_fits_go_on_while_the_simplex_moves(spark, monkeypatch):
    """A best error that stands for a few rounds ends no fit; region_fit leaves no variable and no round out."""
    from terragrid.plans import regional

    weights = np.arange(1, 11)
    best, value, log = E.simplex(lambda v: float(((v - 0.1) ** 2 * weights).sum()), np.zeros(10), np.full(10, 0.25), rounds=200, settled=1e-3)
    assert len(log) > 50 and value < 1e-3 and np.abs(best - 0.1).max() < 0.03
    asked = {}

    def fit(points, by, reference, axes, **options):
        asked.update(options)
        return {(1,): ({"shift": [0.0] * 3, "scale": [1.0] * 3}, 1.0, [1.0])}

    monkeypatch.setattr(stages, "optimise_each", fit)
    assert regional.region_fit(spark, "/root/testdata/sf0.001").count() == 1
    assert asked.get("rounds", 200) >= 200 and all(asked["bounds"][k] and all(asked["bounds"][k]) for k in ("rotation", "shift", "scale")) and asked["bounds"]["whole"]


def test_trials_over_few_cells_equal_those_over_many(spark):
    """Equal points are put together by their number, and arrays of differences give what the quantile passes give."""
    rng = np.random.default_rng(4)
    rows = [(int(i % 2), float(i % 7), float(i % 4), float(z)) for i, z in enumerate(rng.integers(0, 5, size=400))]
    pts = spark.createDataFrame([*rows, *rows, (0, 1.0, 1.0, None)], "g int, x double, y double, z double")
    placed = stages.at_places(pts, ["g"], True)
    assert placed.count() == len(set(rows)) + 1 and placed.agg(F.sum("points"), F.sum("n")).head() == (801, 800)
    axes = G.Axes(0.0, 3.0, 1.0, 1.0, 7, 4)
    ref = axes.cells(spark).select("row", "col", (F.col("x") - F.col("y")).alias("val"))
    trials = {(g,): [np.eye(3, 4) + rng.normal(size=(3, 4)) * 0.1 for _ in range(3)] for g in (0, 1)}
    for clip in (None, (0.1, 0.8)):
        few, many, alone = (sorted(map(tuple, stages.trial_errors(p, ["g"], trials, ref, axes, clip, True, f).collect())) for p, f in ((placed, True), (placed, False), (pts.where("z is not null").select("*", F.lit(1).alias("n")), False)))
        assert len(few) == 6 and np.allclose(few, many) and np.allclose(few, alone)
