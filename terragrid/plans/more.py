"""More operators as queries over the driver's tables, with DuckDB SQL: gates, selections, transforms and sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import projections as P
from ..operators import checks as K
from ..operators import estimators as E
from ..operators import grid as G
from ..operators import spatial as X
from .queries import _N8, _PQ, AX, GRID, ORACLES, POS, QUERIES, REF, cells, positions, query, reference, rounded, table

__all__ = ["ORACLES", "QUERIES"]


@query(f'with {_PQ}, s as (select "row", col, degrees(atan(sqrt(p * p + q * q))) as slope from d where p is not null and q is not null) select "row", col, round(slope, 6) as slope from s where slope > 5 and slope < 75')
def slope_window(spark, sf):
    return K.slope_window(G.surface(cells(spark, sf), 1000.0, 1000.0)).select("row", "col", F.round("slope", 6).alias("slope"))


@query(f'with {GRID}, {REF} select g."row", g.col, round(case when abs(g.val - ref.val) > 5000 then null else g.val end, 9) as val from g left join (select * from ref where col % 9 > 0) ref using ("row", col)')
def outlier_cut(spark, sf):
    met = cells(spark, sf).join(reference(spark, sf).where("col % 9 > 0").select("row", "col", F.col("val").alias("ref")), ["row", "col"], "left")
    return rounded(K.cut_outliers(met, "val", "ref", 5000.0), 9, "val").select("row", "col", "val")


@query(f"with {POS}, w as (select pt_id, lon, case when pt_id % 5 = 0 then lat * 1.5 else lat end as lat, case when pt_id % 11 = 0 then null else h end as z from p), f as (select pt_id, case when not lon between -180 and 180 then 'longitude' when not lat between -90 and 90 then 'latitude' when not coalesce(z > -500 and z < 9000, false) then 'elevation' end as fault from w) select pt_id, fault from f where fault is not null")
def input_faults(spark, sf):
    k = F.col("pt_id")
    wild = positions(spark, sf).select("pt_id", "lon", F.when(k % 5 == 0, F.col("lat") * 1.5).otherwise(F.col("lat")).alias("lat"), F.when(k % 11 != 0, F.col("h")).alias("z"))
    return K.position_faults(wild).select("pt_id", "fault")


@query("select p_partkey, coalesce(n, 0) as n, round(coalesce(n, 0) / expected, 6) as share, coalesce(n, 0) / expected >= 0.33 as covered from (select p_partkey, p_size * 2 as expected from part) w left join (select l_partkey, count(case when l_orderkey % 3 > 0 then l_tax end) as n from lineitem group by 1) on l_partkey = p_partkey")
def coverage_gate(spark, sf):
    points = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.when(F.col("l_orderkey") % 3 > 0, F.col("l_tax")).alias("v"))
    windows = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 2).alias("expected"))
    return rounded(K.coverage(points, windows, "p_partkey", "v"), 6, "share")


@query(f'with {GRID}, c as (select cast(("row" - 1) // 2 + 1 as integer) as r, cast((col - 1) // 2 + 1 as integer) as c, max(val) as v from g group by 1, 2) select g."row", g.col, round(coalesce(case when coalesce(abs(g.val - v) > 4000, false) or n % 4 = 0 then null else g.val end, v), 4) as val from g left join c on c.r = (g."row" - 1) // 2 + 1 and c.c = (g.col - 1) // 2 + 1')
def pyramid_outliers(spark, sf):
    """Disparities far from the coarser level's give way to those."""
    half = lambda c: (F.floor((F.col(c) - 1) / 2) + 1).cast("int").alias(c)
    g = cells(spark, sf)
    coarse = g.groupBy(half("row"), half("col")).agg(F.max("val").alias("val"))
    fine = g.select("row", "col", F.when(F.col("n") % 4 != 0, F.col("val")).alias("val"))
    return rounded(K.against_coarser(fine, coarse, 2, 4000.0), 4, "val")


@query("with b as (select p_partkey as id, p_partkey % 900 - 20 as x0, p_partkey % 700 - 10 as y0, p_partkey % 900 - 20 + p_size * 3 as x1, p_partkey % 700 - 10 + 50 - p_size as y1 from part) select id from b where x0 >= 1 and y0 >= 1 and x1 <= 900 and y1 <= 700 and x0 < x1 and y0 < y1")
def boxes_in_image(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    b = table(spark, sf, "part").select(k.alias("id"), (k % 900 - 20).alias("x0"), (k % 700 - 10).alias("y0"), (k % 900 - 20 + s * 3).alias("x1"), (k % 700 - 10 + 50 - s).alias("y1"))
    return K.inside_image(b, 900, 700).select("id")


@query("select p_partkey, case when p_partkey % 256 > 250 then 0 else p_partkey % 256 end as val from part")
def white_text(spark, sf):
    return table(spark, sf, "part").select("p_partkey", K.blank_text(F.col("p_partkey") % 256).alias("val"))


@query("select c_nationkey, round(avg(case when c_acctbal > 0 then 1.0 else 0.0 end) * 100, 6) as percent_a, round(avg(case when c_acctbal + 900 > 0 then 1.0 else 0.0 end) * 100, 6) as percent_b, avg(case when c_acctbal > 0 then 1.0 else 0.0 end) > 0.9 and avg(case when c_acctbal + 900 > 0 then 1.0 else 0.0 end) > 0.9 as facing from customer group by 1")
def cheirality(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", F.col("c_acctbal").alias("a"), (F.col("c_acctbal") + 900).alias("b"))
    return rounded(K.facing(c, ["c_nationkey"], ["a", "b"], 0.9), 6, "percent_a", "percent_b")


@query("select c_nationkey, count(distinct c_mktsegment) = 1 as single from customer where c_custkey % 40 = 0 group by 1")
def same_source(spark, sf):
    return K.single_source(table(spark, sf, "customer").where("c_custkey % 40 = 0"), "c_nationkey", "c_mktsegment")


@query("select vec_id from embeddings where len(list_filter(embedding, lambda x: abs(x) > 0.34::float)) = 0")
def complete_descriptors(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.when(F.abs(x) <= F.lit(0.34).cast("float"), x)).alias("d"))
    return K.complete(e, "d").select("vec_id")


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def duplicate_keys(spark, sf):
    return K.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select l_partkey, n from (select l_partkey, count(*) as n from lineitem group by 1) order by n desc, l_partkey desc limit 50")
def most_voted(spark, sf):
    votes = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return K.most_voted(votes, "l_partkey", "n", 50)


@query("select vertex, face_id, cast(k as integer) as place from (select *, row_number() over (partition by vertex order by face_id) as k from (select distinct l_partkey as vertex, l_orderkey as face_id from lineitem)) where k <= 10")
def vertex_incidence(spark, sf):
    return K.vertex_faces(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("vertex"), F.col("l_orderkey").alias("face_id")))


@query("with a as (select p_partkey as id, (p_partkey % 50)::double as x0, 0::double as y0, (p_partkey % 50 + p_size)::double as x1, p_size::double as y1 from part), b as (select p_partkey as id, 20::double as x0, 3::double as y0, 60::double as x1, 90::double as y1 from part) select id, greatest(a.x0, b.x0) as x0, greatest(a.y0, b.y0) as y0, least(a.x1, b.x1) as x1, least(a.y1, b.y1) as y1 from a join b using (id) where least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 10 and least(a.y1, b.y1) - greatest(a.y0, b.y0) >= 10")
def image_overlap(spark, sf):
    p, k, s = table(spark, sf, "part"), F.col("p_partkey"), F.col("p_size")
    a = p.select(k.alias("id"), *[c.cast("double").alias(n) for n, c in (("x0", k % 50), ("y0", F.lit(0)), ("x1", k % 50 + s), ("y1", s))])
    b = p.select(k.alias("id"), *[F.lit(float(v)).alias(n) for n, v in (("x0", 20), ("y0", 3), ("x1", 60), ("y1", 90))])
    return K.overlap(a, b, "id")


@query("""with a as (select p_partkey as id, p_partkey * 7 % 256 as val from part), b as (select p_partkey * p_partkey % 199 as val from part),
h as (select val, sum(n) over (order by val) as u, sum(n) over () as n from (select val, count(*) as n from a where val > 0 group by 1)), r as (select val, sum(n) over (order by val) as u, sum(n) over () as n from (select val, count(*) as n from b where val > 0 group by 1)),
m as (select h.val, min(r.val) as t from h join r on r.u * h.n >= h.u * r.n group by 1) select id, coalesce(t, val) as val from a left join m using (val)""")
def histogram_match(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part")
    return K.match_histogram(p.select(k.alias("id"), (k * 7 % 256).alias("val")), p.select((k * k % 199).alias("val"))).select("id", "val")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey::double + 100 - 1 as x, 9000 - (l_suppkey::double + 50 - 1) + 1 as y from lineitem")
def full_image_pixels(spark, sf):
    x, y = P.to_full_image(F.col("l_partkey").cast("double"), F.col("l_suppkey").cast("double"), 100.0, 50.0, 9000.0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", x.alias("x"), y.alias("y"))


@query("select c_custkey, round((c_custkey % 170)::double - 85, 6) as a, round((c_custkey % 80)::double - 40, 6) as b, round((c_custkey % 110)::double - 55, 6) as c from customer")
def euler_angles(spark, sf):
    """Angles to a matrix (Rz Ry Rx, entry by entry) and back."""
    k = F.col("c_custkey")
    a, b, c = (F.radians(v.cast("double")) for v in (k % 170 - 85, k % 80 - 40, k % 110 - 55))
    (sa, ca), (sb, cb), (sc, cc) = ((F.sin(v), F.cos(v)) for v in (a, b, c))
    m = [[ca * cb, None, None], [sa * cb, None, None], [-sb, cb * sc, cb * cc]]
    return table(spark, sf, "customer").select("c_custkey", *[F.round(v, 6).alias(n) for v, n in zip(P.euler_zyx(m), "abc")])


@query("select p_partkey, ['low', 'mid', 'high', 'top'][cast(greatest(least(floor((p_retailprice - 1000) / 200) + 1, 4), 1) as integer)] as colour from part")
def colour_ramp(spark, sf):
    return table(spark, sf, "part").select("p_partkey", P.ramp(F.col("p_retailprice"), 1000.0, 1800.0, ["low", "mid", "high", "top"]).alias("colour"))


_TURN = P.rotation(10.0, 20.0, 30.0)


@query("with v as (select vec_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings), r as (select vec_id, " + ", ".join(f"{float(_TURN[i][0])!r} * x + {float(_TURN[i][1])!r} * y + {float(_TURN[i][2])!r} * z as {n}" for i, n in enumerate("abc")) + " from v) select vec_id, round(a / sqrt(a * a + b * b + c * c), 6) as a, round(b / sqrt(a * a + b * b + c * c), 6) as b, round(c / sqrt(a * a + b * b + c * c), 6) as c from r where a * a + b * b + c * c > 0")
def normals_turned(spark, sf):
    n = P.rotate_normals(np.column_stack([2.5 * _TURN, [7, 8, 9]]), *[F.col("embedding")[i].cast("double") for i in range(3)])
    return table(spark, sf, "embeddings").select("vec_id", *[F.round(c, 6).alias(k) for c, k in zip(n, "abc")]).where("a is not null")


@query("with t as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey::double as x, l_suppkey::double as y, l_quantity as d from lineitem) select l_orderkey, l_linenumber, l_partkey, l_suppkey, round((x - 3) / 2 + 11, 6) as xl, round((y - 5) / 4 + 12, 6) as yl, round((x - d + 1) / 0.5 + 13, 6) as xr, round((y - 2) / 8 + 14, 6) as yr from t")
def disparity_points(spark, sf):
    left, right = np.array([[2.0, 0, 3], [0, 4.0, 5], [0, 0, 1]]), np.array([[0.5, 0, -1], [0, 8.0, 2], [0, 0, 1]])
    four = P.paired_points(F.col("l_partkey").cast("double"), F.col("l_suppkey").cast("double"), F.col("l_quantity"), left, right, (11, 12, 13, 14))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.round(c, 6).alias(n) for c, n in zip(four, ("xl", "yl", "xr", "yr"))])


@query(f"with {POS} select pt_id, round(lon, 6) as lon, round(lat, 6) as lat, round(h, 3) as h from p where abs(lat) < 60")
def curvature_roundtrip(spark, sf):
    """Map coordinates bent onto the ellipsoid and unbent again."""
    m = np.array([[0.0, -1.0, 0.0, 6378137.0], [1.0, 0.0, 0.0, -500000.0], [0.0, 0.0, 1.0, 0.0]])
    p = positions(spark, sf).where("abs(lat) < 60")
    x, y = P.ll_to_utm(F.col("lon"), F.col("lat"), 32, "N")
    flat = p.select("pt_id", x.alias("x"), y.alias("y"), F.col("h").alias("z"))
    bent = P.curve(P.uncurve(flat, m, 32, "N"), m, 32, "N")
    lon, lat = P.utm_to_ll(F.col("x"), F.col("y"), 32, "N")
    return bent.select("pt_id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"), F.round("z", 3).alias("h"))


@query("""with c as (select c_nationkey as image, c_custkey % 97 * 1.0 as x, c_custkey % 89 * 1.0 as y, c_custkey % 97 * 0.6 - c_custkey % 89 * 0.8 + 5 as u, c_custkey % 97 * 0.8 + c_custkey % 89 * 0.6 - 7 as v from customer),
m as (select image, count(*) as n, sum(x) as sx, sum(y) as sy, sum(u) as su, sum(v) as sv, sum(x * x + y * y) as q, sum(x * u + y * v) as d, sum(x * v - y * u) as e from c group by 1),
s as (select *, q - (sx * sx + sy * sy) / n as w from m), r as (select image, n, sx, sy, su, sv, (d - (sx * su + sy * sv) / n) / w as a, (e - (sx * sv - sy * su) / n) / w as b from s where w > 0)
select image, round(a, 6) as a, round(b, 6) as b, round((su - a * sx + b * sy) / n, 4) as tx, round((sv - b * sx - a * sy) / n, 4) as ty from r""")
def similarity_corners(spark, sf):
    """Similarity without reflection from corner points, for each image, in one aggregation."""
    k = F.col("c_custkey")
    x, y = (k % 97) * F.lit(1.0), (k % 89) * F.lit(1.0)
    pts = table(spark, sf, "customer").select(F.col("c_nationkey").alias("image"), x.alias("x"), y.alias("y"), (x * 0.6 - y * 0.8 + 5).alias("tx"), (x * 0.8 + y * 0.6 - 7).alias("ty"))
    return rounded(rounded(E.similarity_2d(pts, ["image"]), 6, "a", "b"), 4, "tx", "ty")


@query(f"""with {_PQ}, s as (select "row", col, val, atan(sqrt(p * p + q * q)) as slope, atan2(p, q) + pi() as aspect from d where p is not null and q is not null and p * p + q * q > 0),
f as (select cos(aspect) as a, sin(aspect) as b, 1.0::double as c, val / 1000 / tan(slope) as y from s) select count(*) as n, round(sum(a * a), 5) as a_a, round(sum(a * b), 5) as a_b, round(sum(a * c), 5) as a_c, round(sum(b * b), 5) as b_b, round(sum(b * c), 5) as b_c, round(sum(c * c), 5) as c_c, round(sum(a * y), 2) as a_y, round(sum(b * y), 2) as b_y, round(sum(c * y), 2) as c_y from f""")
def cosine_fit_sums(spark, sf):
    face = G.surface(cells(spark, sf), 1000.0, 1000.0).where("slope > 0")
    s = E.cosine_sums(face.select((F.col("val") / 1000).alias("d"), "slope", "aspect"))
    return s.select("n", *[F.round(c, 5).alias(c) for c in ("a_a", "a_b", "a_c", "b_b", "b_c", "c_c")], *[F.round(c, 2).alias(c) for c in ("a_y", "b_y", "c_y")])


@query(f"""with {_PQ}, s as (select 0.001 * col as x, 0.001 * "row" as y, val / 100000 as z, -p / sqrt(p * p + q * q + 1) as nx, -q / sqrt(p * p + q * q + 1) as ny, 1 / sqrt(p * p + q * q + 1) as nz from d where p is not null and q is not null),
f as (select y * nz - z * ny as a, z * nx - x * nz as b, nx as c, nz as d, 0.01 * nx + 0.02 * nz as r from s) select count(*) as n, round(sum(a * a), 5) as a_a, round(sum(a * b), 5) as a_b, round(sum(b * b), 5) as b_b, round(sum(c * c), 4) as c_c, round(sum(c * d), 4) as c_d, round(sum(a * r), 6) as a_y from f""")
def p2plane_sums(spark, sf):
    """The sums behind one step of point-to-plane alignment."""
    face = G.surface(cells(spark, sf), 1000.0, 1000.0)
    rows = face.select((0.001 * F.col("col")).alias("x"), (0.001 * F.col("row")).alias("y"), (F.col("val") / 100000).alias("z"), "nx", "ny", "nz", (0.01 * F.col("nx") + 0.02 * F.col("nz")).alias("r"))
    s = E.plane_sums(rows, F.col("r"))
    return s.select("n", *[F.round(f"{a}_{b}", 5).alias(k) for a, b, k in (("rx", "rx", "a_a"), ("rx", "ry", "a_b"), ("ry", "ry", "b_b"))], F.round("tx_tx", 4).alias("c_c"), F.round("tx_tz", 4).alias("c_d"), F.round("rx_y", 6).alias("a_y"))


@query("with v as (select s_suppkey as id, s_suppkey * 37 % 100 * 1.0 as x, s_suppkey * 91 % 100 * 1.0 as y, s_suppkey * 53 % 100 * 1.0 as z from supplier), c as (select c_custkey as id, c_custkey * 29 % 100 * 1.0 as x, c_custkey * 31 % 100 * 1.0 as y, c_custkey * 41 % 100 * 1.0 as z from customer), d as (select c.id, v.id as rid, sqrt((c.x - v.x) * (c.x - v.x) + (c.y - v.y) * (c.y - v.y) + (c.z - v.z) * (c.z - v.z)) as distance from c, v), r as (select *, row_number() over (partition by id order by distance, rid) as k from d) select id, rid, round(distance, 6) as distance, cast(k as integer) as rank from r where k <= 2")
def nn_3d(spark, sf):
    """The two nearest of other points in space."""
    at = lambda df, k, m: table(spark, sf, df).select(F.col(k).alias("id"), *[((F.col(k) * a) % 100 * F.lit(1.0)).alias(c) for a, c in zip(m, "xyz")])
    return X.nearest(at("customer", "c_custkey", (29, 31, 41)), at("supplier", "s_suppkey", (37, 91, 53)), 20.0, 2, ("x", "y", "z")).withColumn("distance", F.round("distance", 6))


@query(f'with {_N8}, d as (select "row", col, coalesce(e, case when col = 50 then 2 * val - w end) as e, coalesce(w, case when col = 1 then 2 * val - e end) as w, coalesce(n, case when "row" = 1 then 2 * val - s end) as n, coalesce(s, case when "row" = 10 then 2 * val - n end) as s from o) select "row", col, round((e - w) / 2, 9) as p, round((n - s) / 2, 9) as q from d where e is not null and w is not null and n is not null and s is not null')
def gradient_with_rim(spark, sf):
    """Central differences with the grid continued in lines beyond its edge."""
    g = G.gradient(G.neighbours(cells(spark, sf), (AX.nrows, AX.ncols)), 1.0, 1.0)
    return rounded(g.where("p is not null and q is not null").select("row", "col", "p", "q"), 9, "p", "q")


@query("select 0 as power, round(regr_intercept(l_extendedprice, l_quantity), 4) as coef, round(regr_r2(l_extendedprice, l_quantity), 8) as r2 from lineitem union all select 1, round(regr_slope(l_extendedprice, l_quantity), 4), round(regr_r2(l_extendedprice, l_quantity), 8) from lineitem")
def line_fit(spark, sf):
    fit = E.polyfit(table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice", E.complete_terms(1, 1))
    return spark.createDataFrame([(int(t[0]), round(float(c), 4), round(float(fit["r2"]), 8)) for t, c in zip(fit["terms"], fit["coef"])], "power int, coef double, r2 double")


@query("select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by x, o_orderkey) as integer) as place from (select o_custkey, o_orderkey, 0.8 * (o_totalprice / 100) - 0.6 * (o_orderkey % 1000) as x from orders)")
def image_order(spark, sf):
    """Images from left to right by their centres, turned."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 100).alias("x"), (F.col("o_orderkey") % 1000).alias("y"))
    return K.left_to_right(o, "o_custkey", "o_orderkey", (0.8, -0.6)).select("o_custkey", "o_orderkey", "place")
