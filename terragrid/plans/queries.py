"""Every operator as a query over the driver's tables, with DuckDB SQL where SQL can express it.

Tables are projected to points, cells and vectors: lineitem to points on a 50 x 10 grid, customer to positions,
embeddings to descriptors. Results are rounded, so that the order of summation doesn't show.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import projections as P
from ..functions import semantics as S
from ..operators import estimators as E
from ..operators import gaps
from ..operators import grid as G
from ..operators import spatial as X
from ..operators import stats as Q
from ..sources import catalog as C
from . import stages

QUERIES: dict = {}
ORACLES: dict = {}
AX = G.Axes(0.0, 9.0, 1.0, 1.0, 50, 10)
#: Cells of lineitem: mean price by part and supplier number.
GRID = """g as (select cast(10 - l_suppkey % 10 as integer) as "row", cast(l_partkey % 50 + 1 as integer) as col, sum(l_extendedprice::decimal(18, 2))::double / count(l_extendedprice) as val, count(l_extendedprice) as n from lineitem group by all)"""
REF = """ref as (select cast(10 - (p_partkey // 50) % 10 as integer) as "row", cast(p_partkey % 50 + 1 as integer) as col, sum(p_retailprice::decimal(18, 2))::double / count(p_retailprice) * 25 as val from part group by all)"""


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def points(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select((F.col("l_partkey") % 50).cast("double").alias("x"), (F.col("l_suppkey") % 10).cast("double").alias("y"), F.col("l_extendedprice").alias("z"))


def cells(spark, sf) -> DataFrame:
    return G.cell_mean(points(spark, sf), AX, digits=2)


def reference(spark, sf) -> DataFrame:
    p = table(spark, sf, "part").select((F.col("p_partkey") % 50).cast("double").alias("x"), (F.floor(F.col("p_partkey") / 50) % 10).cast("double").alias("y"), F.col("p_retailprice").alias("z"))
    return G.cell_mean(p, AX, digits=2).select("row", "col", (F.col("val") * 25).alias("val"))


def positions(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("pt_id"), (F.lit(6) + (k % 600) / 100).alias("lon"), ((k % 141) - 70.0).alias("lat"), F.col("c_acctbal").alias("h"))


POS = "p as (select c_custkey as pt_id, 6 + (c_custkey % 600) / 100 as lon, ((c_custkey % 141) - 70.0)::double as lat, c_acctbal as h from customer)"


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(f'with {GRID} select "row", col, round(val, 9) as val, n from g')
def cell_mean(spark, sf):
    return rounded(cells(spark, sf), 9, "val")


@query(f"""with {GRID}, {REF},
d as (select ref.val - g.val as d from g join ref using ("row", col) where (g."row" + g.col) % 7 <> 0),
o as (select d, row_number() over (order by d) as k, count(*) over () as n from d),
q as (select lo + (hi - lo) * part as a, lo2 + (hi2 - lo2) * part2 as b from (
  select max(d) filter (where k = floor(greatest(n * 0.05 + 0.5, 1))) as lo, max(d) filter (where k = least(floor(greatest(n * 0.05 + 0.5, 1)) + 1, n)) as hi, max(greatest(n * 0.05 + 0.5, 1) - floor(greatest(n * 0.05 + 0.5, 1))) as part,
         max(d) filter (where k = floor(least(n * 0.95 + 0.5, n))) as lo2, max(d) filter (where k = least(floor(least(n * 0.95 + 0.5, n)) + 1, n)) as hi2, max(least(n * 0.95 + 0.5, n) - floor(least(n * 0.95 + 0.5, n))) as part2 from o))
select count(*) as n, round(sum(d * d) / 1e6, 3) as sse_millions, round(sqrt(avg(d * d)), 4) as rmse from d, q where d between a and b""")
def grid_diff_rmse(spark, sf):
    """The error of a point cloud's grid against a reference, outside a mask and between two quantiles."""
    mask = AX.cells(spark).where((F.col("row") + F.col("col")) % 7 == 0)
    out = E.vertical_error(points(spark, sf), reference(spark, sf), AX, mask, digits=2)
    return out.select("n", F.round(F.col("sse") / 1e6, 3).alias("sse_millions"), F.round("rmse", 4).alias("rmse"))


@query(f"""with {GRID}, p as (select c_custkey as pt_id, (c_custkey % 53) * 0.97 as x, (c_custkey % 11) * 0.93 as y from customer),
f as (select *, x + 1 as fx, 9 - y + 1 as fy from p), i as (select *, least(floor(fx), 49) as c, least(floor(fy), 9) as r from f),
s as (select i.pt_id, count(g.val) as have, count(*) as want, sum(w * g.val) as v from (
  select pt_id, cast(r + dr as integer) as rr, cast(c + dc as integer) as cc, (case when dr = 1 then fy - r else 1 - (fy - r) end) * (case when dc = 1 then fx - c else 1 - (fx - c) end) as w
  from i, (values (0, 0), (0, 1), (1, 0), (1, 1)) o(dr, dc) where fx between 1 and 50 and fy between 1 and 10) i
  left join g on g."row" = rr and g.col = cc where w > 0 group by i.pt_id)
select p.pt_id, round(case when have = want then v end, 3) as sample from p left join s using (pt_id)""")
def bilinear_sample(spark, sf):
    k = F.col("c_custkey")
    at = table(spark, sf, "customer").select(k.alias("pt_id"), ((k % 53) * 0.97).alias("x"), ((k % 11) * 0.93).alias("y"))
    return rounded(G.bilinear(at, cells(spark, sf), AX), 3, "sample").select("pt_id", "sample")


@query(f"""with {GRID}, t as (select k % 5 + 1 as "row", k // 5 + 1 as col, 0.5 + (k // 5) * 2.0 as x, 8.5 - (k % 5) * 2.0 as y from range(125) r(k)),
f as (select *, x + 1 as fx, 10 - y as fy from t), i as (select *, least(floor(fx), 49) as c, least(floor(fy), 9) as r from f)
select cast(i."row" as integer) as "row", cast(i.col as integer) as col, round(case when count(g.val) = count(*) then sum(w * g.val) end, 3) as val from (
  select "row", col, cast(r + dr as integer) as rr, cast(c + dc as integer) as cc, (case when dr = 1 then fy - r else 1 - (fy - r) end) * (case when dc = 1 then fx - c else 1 - (fx - c) end) as w
  from i, (values (0, 0), (0, 1), (1, 0), (1, 1)) o(dr, dc)) i left join g on g."row" = rr and g.col = cc where w > 0 group by 1, 2""")
def pyramid_half(spark, sf):
    """The grid at half its resolution."""
    return rounded(G.resample(cells(spark, sf), AX, AX.halved(2)), 3, "val")


@query("select o_orderkey, cast(greatest(least(floor(o_totalprice / 1000 + 1.5), 300), 1) as integer) as axis_index from orders")
def nearest_axis(spark, sf):
    return X.nearest_on_axis(table(spark, sf, "orders"), "o_totalprice", 0.0, 1000.0, 300).select("o_orderkey", "axis_index")


@query(f'with {GRID} select "row", col, round(val, 9) as val from g where col between 4 and 23 and "row" between 3 and 8')
def region_bbox_scan(spark, sf):
    return rounded(G.window_scan(cells(spark, sf), AX, (4.6, 2.2, 20.4, 6.9), 0.1), 9, "val").select("row", "col", "val")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, case when l_extendedprice between -500 and 9000 and l_extendedprice not in (1000) then l_extendedprice end as val from lineitem")
def valid_range(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", S.valid(F.col("l_extendedprice"), nulls=(1000.0,)).alias("val"))


_UTM = f"""with {POS}, a as (select pt_id, lon, lat, radians(lat) as phi, radians(lon) - radians(9) as dl from p),
b as (select *, {P.A!r} / sqrt(1 - {P.E2!r} * sin(phi) * sin(phi)) as n, tan(phi) * tan(phi) as t, {P.EP2!r} * cos(phi) * cos(phi) as c, cos(phi) * dl as a from a),
m as (select *, {P.A!r} * ((1 - {P.E2!r} / 4 - 3 * pow({P.E2!r}, 2) / 64 - 5 * pow({P.E2!r}, 3) / 256) * phi - (3 * {P.E2!r} / 8 + 3 * pow({P.E2!r}, 2) / 32 + 45 * pow({P.E2!r}, 3) / 1024) * sin(2 * phi) + (15 * pow({P.E2!r}, 2) / 256 + 45 * pow({P.E2!r}, 3) / 1024) * sin(4 * phi) - (35 * pow({P.E2!r}, 3) / 3072) * sin(6 * phi)) as mer from b),
u as (select pt_id, lon, lat, 0.9996 * n * (a + (1 - t + c) * pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * {P.EP2!r}) * pow(a, 5) / 120) + 500000 as x,
  0.9996 * (mer + n * tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * {P.EP2!r}) * pow(a, 6) / 720)) as y from m)"""


@query(_UTM + " select pt_id, round(x, 3) as x, round(y, 3) as y from u")
def ll2utm(spark, sf):
    x, y = P.ll_to_utm(F.col("lon"), F.col("lat"), 32, "N")
    return positions(spark, sf).select("pt_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"with {POS} select pt_id, round(lon, 6) as lon, round(lat, 6) as lat from p")
def utm2ll(spark, sf):
    """There and back: the inverse gives the positions again."""
    x, y = P.ll_to_utm(F.col("lon"), F.col("lat"), 32, "N")
    there = positions(spark, sf).select("pt_id", x.alias("x"), y.alias("y"))
    lon, lat = P.utm_to_ll(F.col("x"), F.col("y"), 32, "N")
    return there.select("pt_id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query(f"with {POS} select cast(least(60, greatest(1, floor(avg(lon) / 6) + 31)) as integer) as zone, case when avg(lat) > 0 then 'N' else 'S' end as hemisphere from p")
def utm_zone(spark, sf):
    return spark.createDataFrame([P.utm_zone(positions(spark, sf))], "zone int, hemisphere string")


_PS = P._ps_scale(71.0, None)[1]


@query(f"""with {POS}, r as (select pt_id, {_PS!r} * tan(pi() / 4 - radians(lat) / 2) / pow((1 - {math.sqrt(P.E2)!r} * sin(radians(lat))) / (1 + {math.sqrt(P.E2)!r} * sin(radians(lat))), {math.sqrt(P.E2) / 2!r}) as rho, radians(lon) - radians(-45) as d from p where lat > 0)
select pt_id, round(rho * sin(d), 3) as x, round(-rho * cos(d), 3) as y from r""")
def ll2ps(spark, sf):
    x, y = P.ll_to_ps(F.col("lon"), F.col("lat"), -45.0, 71.0)
    return positions(spark, sf).where("lat > 0").select("pt_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"with {POS} select pt_id, round(lon, 6) as lon, round(lat, 6) as lat from p where lat < 0")
def ps2ll(spark, sf):
    x, y = P.ll_to_ps(F.col("lon"), F.col("lat"), 0.0, -71.0, 1000.0, 2000.0)
    there = positions(spark, sf).where("lat < 0").select("pt_id", x.alias("x"), y.alias("y"))
    lon, lat = P.ps_to_ll(F.col("x"), F.col("y"), 0.0, -71.0, 1000.0, 2000.0)
    return there.select("pt_id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query(f"""with {POS}, n as (select *, {P.A!r} / sqrt(1 - {P.E2!r} * pow(sin(radians(lat)), 2)) as n from p)
select pt_id, round((n + h) * cos(radians(lat)) * cos(radians(lon)), 3) as x, round((n + h) * cos(radians(lat)) * sin(radians(lon)), 3) as y, round((n * (1 - {P.E2!r}) + h) * sin(radians(lat)), 3) as z, round(lon, 7) as lon, round(lat, 7) as lat, round(h, 2) as h from n""")
def ecef_roundtrip(spark, sf):
    x, y, z = P.geodetic_to_ecef(F.col("lon"), F.col("lat"), F.col("h"))
    there = positions(spark, sf).select("pt_id", x.alias("x"), y.alias("y"), z.alias("z"))
    back = P.ecef_to_geodetic(F.col("x"), F.col("y"), F.col("z"))
    return rounded(there.withColumns(dict(zip(("lon", "lat", "h"), back))), 3, "x", "y", "z").withColumns({"lon": F.round("lon", 7), "lat": F.round("lat", 7), "h": F.round("h", 2)})


SOLVER = {"center": [1000.0, 50.0, 25.0], "scale": [1.01, 0.99, 1.0], "whole": 1.002, "rotation": [1.0, -2.0, 30.0], "shift": [5.0, -3.0, 2.0], "surface": [((1, 0), 0.001), ((0, 1), -0.002), ((1, 1), 0.00001)]}
_R = P.rotation(*SOLVER["rotation"])


def _triples(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("double").alias("x"), F.col("l_suppkey").cast("double").alias("y"), F.col("l_quantity").alias("z"))


_T = "t as (select l_orderkey, l_linenumber, l_partkey::double as x, l_suppkey::double as y, l_quantity as z from lineitem)"
_S = "s as (select *, (x - 1000.0) * 1.01 * 1.002 as a, (y - 50.0) * 0.99 * 1.002 as b, (z - 25.0) * 1.0 * 1.002 as c from t)"
_ROT = ", ".join(f"{_R[i][0]!r} * a + {_R[i][1]!r} * b + {_R[i][2]!r} * c + {k!r} as {n}" for i, (k, n) in enumerate(((1005.0, "px"), (47.0, "py"), (27.0, "pz")))).replace("np.float64(", "(")


@query(f"with {_T}, {_S}, r as (select l_orderkey, l_linenumber, {_ROT} from s) select l_orderkey, l_linenumber, round(px, 6) as x, round(py, 6) as y, round(pz + 0.001 * px - 0.002 * py + 0.00001 * px * py, 6) as z from r")
def solver_transform_fwd(spark, sf):
    x, y, z = P.solver_forward(SOLVER, F.col("x"), F.col("y"), F.col("z"))
    return rounded(_triples(spark, sf).select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"), z.alias("z")), 6, "x", "y", "z")


@query(f"with {_T} select l_orderkey, l_linenumber, round(x, 5) as x, round(y, 5) as y, round(z, 5) as z from t")
def solver_transform_inv(spark, sf):
    """The inverse of the forward transform gives the points again."""
    x, y, z = P.solver_forward(SOLVER, F.col("x"), F.col("y"), F.col("z"))
    there = _triples(spark, sf).select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"), z.alias("z"))
    x, y, z = P.solver_inverse(SOLVER, F.col("x"), F.col("y"), F.col("z"))
    return rounded(there.select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"), z.alias("z")), 5, "x", "y", "z")


@query(f"with {_T} select l_orderkey, l_linenumber, round((1.1 * x + 0.2 * y + 3) / (0.0001 * x + 0.0002 * y + 1), 6) as u, round((-0.1 * x + 0.9 * y + 7) / (0.0001 * x + 0.0002 * y + 1), 6) as v from t")
def homography_apply(spark, sf):
    u, v = P.homography(np.array([[1.1, 0.2, 3.0], [-0.1, 0.9, 7.0], [0.0001, 0.0002, 1.0]]), F.col("x"), F.col("y"))
    return _triples(spark, sf).select("l_orderkey", "l_linenumber", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


@query(f"with {_T} select l_orderkey, l_linenumber, round((1000.0 * x + 500.0 * (z + 900.0)) / (z + 900.0) - 10.0, 6) as u, round((1000.0 * y + 400.0 * (z + 900.0)) / (z + 900.0) - 20.0, 6) as v from t")
def camera_project(spark, sf):
    k = np.array([[1000.0, 0, 500.0], [0, 1000.0, 400.0], [0, 0, 1]])
    u, v = P.camera(k, np.array([[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 900.0]]), F.col("x"), F.col("y"), F.col("z"), 10.0, 20.0)
    return _triples(spark, sf).select("l_orderkey", "l_linenumber", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


@query("""with v as (select vec_id, embedding[1]::double as a, embedding[2]::double as b, embedding[3]::double as c, embedding[4]::double as d, embedding[5]::double as e, embedding[6]::double as f from embeddings),
u as (select vec_id, d / sqrt(d * d + e * e + f * f) as x, e / sqrt(d * d + e * e + f * f) as y, f / sqrt(d * d + e * e + f * f) as z from v where a * a + b * b + c * c > 0 and d * d + e * e + f * f > 0)
select vec_id, round(x, 5) as x, round(y, 5) as y, round(z, 5) as z from u""")
def rotation_between_vectors(spark, sf):
    """The matrix from one unit vector to another, applied to the first, gives the second."""
    e = lambda i: F.col("embedding")[i].cast("double")
    norm = lambda *c: F.sqrt(sum((x * x for x in c), F.lit(0.0)))
    f, t = [e(0), e(1), e(2)], [e(3), e(4), e(5)]
    v = table(spark, sf, "embeddings").where((norm(*f) > 0) & (norm(*t) > 0)).select("vec_id", *[(x / norm(*f)).alias(f"f{i}") for i, x in enumerate(f)], *[(x / norm(*t)).alias(f"t{i}") for i, x in enumerate(t)])
    cols = [F.col(f"f{i}") for i in range(3)]
    m = P.rotation_between(tuple(cols), tuple(F.col(f"t{i}") for i in range(3)))
    return v.select("vec_id", *[F.round(sum((a * b for a, b in zip(r, cols)), F.lit(0.0)), 5).alias(n) for r, n in zip(m, "xyz")])


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1 + 0.5 * l_quantity - 0.01 * pow(l_quantity, 2) + 2 * pow(l_discount, 2) * l_quantity, 8) as p, round(0.5 - 0.02 * l_quantity + 2 * pow(l_discount, 2), 8) as dp from lineitem")
def polynomial_value(spark, sf):
    """A polynomial of two variables and its derivative by the first."""
    terms, coef = [(0, 0), (1, 0), (2, 0), (1, 2)], [1.0, 0.5, -0.01, 2.0]
    d = E.derivative(terms, coef, 0)
    v = [F.col("l_quantity"), F.col("l_discount")]
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(P.polynomial(list(zip(terms, coef)), *v), 8).alias("p"), F.round(F.expr(E.as_sql(*d, ["l_quantity", "l_discount"])), 8).alias("dp"))


_HAZEN = """with v as (select l_returnflag, l_extendedprice as v from lineitem), o as (select l_returnflag, v, row_number() over (partition by l_returnflag order by v) as k, count(*) over (partition by l_returnflag) as n from v),
h as (select o.*, q, greatest(least(n * q + 0.5, n), 1) as h from o, (values (0.05), (0.5), (0.95)) t(q))
select l_returnflag, q::double as q, round(max(v) filter (where k = floor(h)) + (max(v) filter (where k = least(floor(h) + 1, n)) - max(v) filter (where k = floor(h))) * max(h - floor(h)), 4) as value from h group by l_returnflag, q"""


@query(_HAZEN)
def hazen_quantile(spark, sf):
    return rounded(S.hazen(table(spark, sf, "lineitem"), "l_extendedprice", [0.05, 0.5, 0.95], ["l_returnflag"]), 4, "value")


@query(_HAZEN.replace("select l_returnflag, l_extendedprice as v", "select 1 as l_returnflag, l_extendedprice as v").replace("select l_returnflag, q::double as q", "select q::double as q"))
def hazen_quantile_global(spark, sf):
    return rounded(S.hazen(table(spark, sf, "lineitem"), "l_extendedprice", [0.05, 0.5, 0.95]), 4, "value")


@query("select l_returnflag, l_quantity as mode from (select l_returnflag, l_quantity, row_number() over (partition by l_returnflag order by count(*) desc, l_quantity) as k from lineitem group by 1, 2) where k = 1")
def det_mode(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.mode("l_quantity", True).alias("mode"))


@query("with m as (select median(l_extendedprice) as m from lineitem) select round(max(m) + 3.0 * 1.4826 * median(abs(l_extendedprice - m)), 4) as threshold from lineitem, m")
def mad_threshold(spark, sf):
    return rounded(Q.mad_threshold(table(spark, sf, "lineitem"), "l_extendedprice"), 4, "threshold")


@query("select greatest(avg(l_quantity), 1.0) as resolution from (select l_quantity from lineitem group by 1 order by count(*) desc, l_quantity limit 3)")
def top3_spacing(spark, sf):
    return Q.frequent_spacing(table(spark, sf, "lineitem"), "l_quantity")


@query("select cast(least(floor((l_extendedprice - 0) / (100000 / 256.0)), 255) as integer) as bin, count(*) as n from lineitem where l_extendedprice between 0 and 100000 group by 1")
def residual_hist(spark, sf):
    return Q.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 0.0, 100000.0, 256)


@query("""with h as (select least(floor(l_extendedprice / (100000 / 256.0)), 255) as bin, count(*) as n from lineitem where l_extendedprice between 0 and 100000 group by 1),
c as (select bin, sum(n) over (order by bin) as w, sum(n * bin) over (order by bin) as s, sum(n) over () as aw, sum(n * bin) over () as als from h),
v as (select bin, round(pow(als * w::double - s::double * aw, 2) / nullif(w::double * (aw - w), 0), 3) as v from c)
select (bin + 1) * (100000 / 256.0) as threshold from v where v is not null order by v desc, bin limit 1""")
def otsu(spark, sf):
    return Q.otsu(table(spark, sf, "lineitem"), "l_extendedprice", 0.0, 100000.0)


@query(f'with {GRID}, r as (select "row", avg(val) as rm from g group by 1), c as (select col, avg(val) as cm from g group by 1) select g."row", g.col, round(least(rm, cm), 4) as val from g join r using ("row") join c using (col)')
def row_col_mean(spark, sf):
    return rounded(Q.row_col_mean(cells(spark, sf)), 4, "val")


_N8 = f'{GRID}, o as (select g."row", g.col, g.val, ' + ", ".join(f'max(h.val) filter (where h."row" = g."row" + ({dr}) and h.col = g.col + ({dc})) as {n}' for (dr, dc), n in zip(G.EIGHT, G.NAMES)) + ' from g left join g h on abs(h."row" - g."row") <= 1 and abs(h.col - g.col) <= 1 group by 1, 2, 3)'


@query(f'with {_N8} select "row", col, round(val, 9) as val, ' + ", ".join(f"round({n}, 9) as {n}" for n in G.NAMES) + " from o")
def neighbors8(spark, sf):
    return rounded(G.neighbours(cells(spark, sf)), 9, "val", *G.NAMES)


_PQ = f"{_N8}, d as (select *, (e - w) / 2000 as p, (n - s) / 2000 as q from o)"


@query(f'with {_PQ} select "row", col, round(degrees(atan(sqrt(p * p + q * q))), 6) as slope, round(degrees(atan2(p, q)) + 180, 6) as aspect, round(-p / sqrt(p * p + q * q + 1), 8) as nx, round(-q / sqrt(p * p + q * q + 1), 8) as ny, round(1 / sqrt(p * p + q * q + 1), 8) as nz from d where p is not null and q is not null')
def surface_normals(spark, sf):
    return rounded(rounded(G.surface(cells(spark, sf), 1000.0, 1000.0), 6, "slope", "aspect"), 8, "nx", "ny", "nz").drop("val")


@query(f'with {_N8}, d as (select "row", col, ne + 2 * e + se - nw - 2 * w - sw as gx, sw + 2 * s + se - nw - 2 * n - ne as gy from o) select "row", col, round(gx, 4) as gx, round(gy, 4) as gy, round(sqrt(gx * gx + gy * gy), 4) as magnitude from d where gx is not null and gy is not null')
def sobel(spark, sf):
    return rounded(G.sobel(cells(spark, sf)), 4, "gx", "gy", "magnitude")


def _box(agg: str) -> str:
    mirror = lambda e, n: f"case when {e} < 1 then 1 - ({e}) when {e} > {n} then {2 * n + 1} - ({e}) else {e} end"
    r, c = mirror('a."row" + dr', 10), mirror("a.col + dc", 50)
    return f'select a."row", a.col, a.val as own, {agg} from g a, range(-1, 2) x(dr), range(-1, 2) y(dc), g b where b."row" = {r} and b.col = {c} group by 1, 2, 3'


@query(f'with {GRID}, m as ({_box("median(b.val) as val")}) select "row", col, round(val, 4) as val from m')
def median3(spark, sf):
    return rounded(G.median(cells(spark, sf), 10, 50), 4, "val")


@query(f'with {GRID}, m as ({_box("avg(b.val) as m, avg(b.val * b.val) - avg(b.val) * avg(b.val) as v")}), n as (select avg(v) as nu from m) select "row", col, round(m + greatest(v - nu, 0) / greatest(v, nu) * (own - m), 2) as val from m, n')
def wiener3(spark, sf):
    return rounded(G.wiener(cells(spark, sf).select("row", "col", "val"), 10, 50), 2, "val")


@query(f"""with {GRID} select distinct cast("row" + dr as integer) as "row", cast(col + dc as integer) as col from g, range(-3, 4) x(dr), range(-3, 4) y(dc) where n % 13 = 0 and dr * dr + dc * dc <= 9 and "row" + dr between 1 and 10 and col + dc between 1 and 50""")
def dilate_disk(spark, sf):
    return G.dilate(cells(spark, sf).where("n % 13 = 0"), G.disk(3), 10, 50)


@query(f"""with {GRID}, w as (select wr, wc, "row", col, val from g, range(0, 10) a(wr), range(0, 50) b(wc) where wr * 2 + 8 <= 10 and wc * 2 + 8 <= 50 and "row" between wr * 2 + 1 and wr * 2 + 8 and col between wc * 2 + 1 and wc * 2 + 8),
r as (select *, row_number() over (partition by wr, wc order by val desc, col, "row") as hi, row_number() over (partition by wr, wc order by val, col, "row") as lo from w)
select "row", col, cast(count(*) filter (where hi = 1) as bigint) as n_max, cast(count(*) filter (where lo = 1) as bigint) as n_min from r where hi = 1 or lo = 1 group by 1, 2""")
def hop2d_extrema(spark, sf):
    return G.hopping_extremes(cells(spark, sf), 8, 10, 50)


@query("""select event_id, count(value) over w = 10 and coalesce(max(value) over w - min(value) over w < 50, false) as settled, round(value - lag(value) over (partition by user_id order by ts, event_id), 6) as diff
from events window w as (partition by user_id order by ts, event_id rows between 10 preceding and 1 preceding)""")
def conv_window(spark, sf):
    e = Q.convergence(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", within=50.0)
    return e.select("event_id", "settled", F.round(F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), 6).alias("diff"))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("d"))


_KNN = """p as (select a.label, a.vec_id as id, b.vec_id as tid, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: pow(a.embedding[i]::double - b.embedding[i]::double, 2))), 6) as distance from embeddings a join embeddings b using (label) where a.vec_id <> b.vec_id),
k as (select *, row_number() over (partition by id order by distance, tid) as rank from p)"""


def _knn(spark, sf, k):
    v = _vectors(spark, sf)
    return X.match(v, v, ["label"], "squared", k, other=True, digits=6)


@query(f"with {_KNN} select id, tid, distance, rank from k where rank <= 3")
def knn_l2(spark, sf):
    """The three nearest descriptors of the same label."""
    return _knn(spark, sf, 3).select("id", "tid", "distance", F.col("rank").cast("long").alias("rank"))


@query(f"with {_KNN}, m as (select *, row_number() over (partition by label order by distance, id, tid) as place from k where rank = 1) select label, id, tid, distance, place from m where place <= 10")
def topk_matches(spark, sf):
    """The ten best matches of each label."""
    return X.top_matches(_knn(spark, sf, 1), ["label"], 10).select("label", "id", "tid", "distance", F.col("place").cast("long").alias("place"))


@query(f"with {_KNN}, m as (select *, row_number() over (partition by tid order by distance, id) as r from k where rank = 1) select id, tid, distance from m where r = 1")
def dedup_min(spark, sf):
    """One match a target: the nearest."""
    return X.one_to_one(_knn(spark, sf, 1)).select("id", "tid", "distance")


def _codes(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_size", k.alias("id"), F.array(*[((k + 7) * c) % 65536 for c in (40503, 30011, 51787, 60293)]).alias("d"))


def _codes_sql(distance: str) -> str:
    return f"""with c as (select p_size, p_partkey as id, [((p_partkey + 7) * m) % 65536 for m in [40503, 30011, 51787, 60293]] as d from part),
p as (select a.id, b.id as tid, {distance} as distance from c a join c b using (p_size) where a.id <> b.id), r as (select *, row_number() over (partition by id order by distance, tid) as k from p)
select id, tid, distance from r where k = 1"""


def _other(codes, distance):
    """The nearest other code of the same block."""
    return X.match(codes, codes, ["p_size"], distance, 1, other=True).select("id", "tid", "distance")


@query(_codes_sql("cast(list_sum(list_transform(range(1, 5), lambda i: bit_count(xor(a.d[i], b.d[i])))) as integer)"))
def hamming_bits(spark, sf):
    return _other(_codes(spark, sf), "bits")


@query(_codes_sql("(list_sum(list_transform(range(1, 5), lambda i: case when a.d[i] % 4 = b.d[i] % 4 then 0 else 1 end)) / 4.0)::double"))
def hamming_bytes(spark, sf):
    return _other(_codes(spark, sf).withColumn("d", F.transform("d", lambda x: x % 4)), "entries")


@query("""with s as (select s_suppkey as rid, (s_suppkey * 37 % 1000)::double as x, (s_suppkey * 91 % 1000)::double as y from supplier), c as (select c_custkey as id, (c_custkey * 53 % 1000)::double as x, (c_custkey * 29 % 1000)::double as y from customer),
d as (select id, rid, sqrt(pow(c.x - s.x, 2) + pow(c.y - s.y, 2)) as d from c, s), r as (select *, row_number() over (partition by id order by d, rid) as k from d) select id, rid, round(d, 6) as distance from r where k = 1""")
def nn_2d(spark, sf):
    """The nearest supplier of each customer."""
    k, j = F.col("c_custkey"), F.col("s_suppkey")
    left = table(spark, sf, "customer").select(k.alias("id"), (k * 53 % 1000).cast("double").alias("x"), (k * 29 % 1000).cast("double").alias("y"))
    right = table(spark, sf, "supplier").select(j.alias("id"), (j * 37 % 1000).cast("double").alias("x"), (j * 91 % 1000).cast("double").alias("y"))
    return X.nearest_2d(left, right, 100.0).select("id", "rid", F.round("distance", 6).alias("distance"))


_POLY = [(1, 0, 0, 2.5, 0.5), (1, 0, 1, 40.5, 1.5), (1, 0, 2, 38.5, 8.5), (1, 0, 3, 6.5, 7.5), (1, 1, 0, 15.5, 2.5), (1, 1, 1, 25.5, 2.5), (1, 1, 2, 25.5, 6.5), (1, 1, 3, 15.5, 6.5)]


@query(f"""with e as (select poly_id, ring_id, x as x1, y as y1, coalesce(lead(x) over w, first(x) over (partition by poly_id, ring_id order by vtx_id rows between unbounded preceding and unbounded following)) as x2, coalesce(lead(y) over w, first(y) over (partition by poly_id, ring_id order by vtx_id rows between unbounded preceding and unbounded following)) as y2
  from (values {", ".join(map(str, _POLY))}) v(poly_id, ring_id, vtx_id, x, y) window w as (partition by poly_id, ring_id order by vtx_id)),
p as (select (y * 50 + x) as pt_id, x::double as x, y::double as y from range(50) a(x), range(10) b(y)),
c as (select pt_id, poly_id, ring_id, count(*) % 2 as odd from p, e where (y1 > y) <> (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 group by all)
select pt_id, poly_id from c where odd = 1 group by 1, 2 having max(ring_id) = 0""")
def point_in_polygon(spark, sf):
    """Cells inside a polygon with a hole."""
    cells_ = AX.cells(spark).select((F.col("y") * 50 + F.col("x")).cast("long").alias("pt_id"), "x", "y")
    return X.inside_polygons(cells_, spark.createDataFrame(_POLY, "poly_id int, ring_id int, vtx_id int, x double, y double"), 2.0)


@query("""with b as (select p_partkey as id, (p_partkey * 37 % 5000)::double as x0, (p_partkey * 91 % 5000)::double as y0, (p_partkey * 37 % 5000 + p_size)::double as x1, (p_partkey * 91 % 5000 + 60 - p_size)::double as y1 from part)
select a.id, b.id as b_id from b a, b where a.id < b.id and a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1""")
def bbox_range_join(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    b = table(spark, sf, "part").select(k.alias("id"), (k * 37 % 5000).cast("double").alias("x0"), (k * 91 % 5000).cast("double").alias("y0"), (k * 37 % 5000 + s).cast("double").alias("x1"), (k * 91 % 5000 + 60 - s).cast("double").alias("y1"))
    return X.boxes_meet(b, b, 64.0).where("id < b_id")


@query("select c_custkey from customer order by ((c_custkey * 2654435761 + 7 * 40503) % 4294967296), c_custkey limit 100")
def hash_sample(spark, sf):
    return Q.sample(table(spark, sf, "customer"), "c_custkey", 100, 7).select("c_custkey")


@query("select c_custkey from customer where (c_custkey - 1) % 7 = 0")
def stride_sample(spark, sf):
    return Q.stride(table(spark, sf, "customer"), "c_custkey", 7).select("c_custkey")


@query("select c_nationkey, c_custkey from (select *, row_number() over (partition by c_nationkey order by ((c_custkey * 2654435761 + 3 * 40503) % 4294967296), c_custkey) as k from customer) where k <= 5")
def quota_sample(spark, sf):
    return Q.quota(table(spark, sf, "customer"), "c_nationkey", "c_custkey", 5, 3).select("c_nationkey", "c_custkey")


@query("select n_regionkey as region_id, n_nationkey as window_id, n_name as l_file, r_name as r_file from nation join region on n_regionkey = r_regionkey where exists (select 1 from customer where c_nationkey = n_nationkey)")
def pair_catalog(spark, sf):
    """Windows with both sides, and with points."""
    n = table(spark, sf, "nation")
    left = n.select(F.col("n_regionkey").alias("region_id"), F.col("n_nationkey").alias("window_id"), F.col("n_name").alias("l_file"))
    right = n.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_regionkey").alias("region_id"), F.col("n_nationkey").alias("window_id"), F.col("r_name").alias("r_file"))
    return C.pair_windows(left, right, table(spark, sf, "customer").select(F.col("c_nationkey").alias("window_id")))


@query("select o_orderkey, o_totalprice from orders where case when o_orderkey % 3 = 0 then null else o_totalprice end is not null")
def stage_ready(spark, sf):
    o = table(spark, sf, "orders").withColumn("vertical_rmse", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")))
    return C.ready(o).select("o_orderkey", "o_totalprice")


@query("select o_custkey, arg_min(o_orderkey, [o_totalprice, o_orderkey]) as o_orderkey from orders group by 1")
def argmin_param(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey"))


@query(f'with {GRID}, {REF}, h as (select "row", col, case when n % 3 = 0 then null else val end as val from g) select h."row", h.col, round(coalesce(h.val, ref.val), 9) as val from h left join ref using ("row", col)')
def coalesce_fill(spark, sf):
    holed = cells(spark, sf).select("row", "col", F.when(F.col("n") % 3 != 0, F.col("val")).alias("val"))
    return rounded(G.fill(holed, reference(spark, sf)), 9, "val")


@query("""with f as (select distinct l_orderkey as face_id, l_partkey as vertex from lineitem),
p as (select distinct a.face_id, b.face_id as other from f a join f b using (vertex)), r as (select *, row_number() over (partition by face_id order by other desc) as k from p) select face_id, other from r where k <= 15""")
def face_adjacency(spark, sf):
    f = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("face_id"), F.col("l_partkey").alias("vertex")).distinct()
    return X.face_neighbours(f)


@query("select count(*)::double as n, round(sum(l_quantity), 3) as s_x, round(sum(l_quantity * 2 + l_discount), 3) as s_tx, round(sum(l_quantity * (l_quantity * 2 + l_discount)), 2) as s_x_tx from lineitem")
def horn_sums(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_quantity") * 2 + F.col("l_discount")).alias("tx"))
    return Q.moments(t, ["x"], ["tx"]).select(F.round("n", 1).alias("n"), F.round("s_x", 3).alias("s_x"), F.round("s_tx", 3).alias("s_tx"), F.round("s_x_tx", 2).alias("s_x_tx"))


@query("select count(*) as n, round(sum(1.0::double), 3) as c_c, round(sum(l_quantity), 3) as c_x, round(sum(l_quantity * l_quantity), 3) as x_x, round(sum(l_tax), 6) as c_y, round(sum(l_quantity * l_tax), 5) as x_y, round(sum(l_tax), 6) as y, round(sum(l_tax * l_tax), 6) as y_y from lineitem")
def poly_normal_eq(spark, sf):
    m = Q.normal_equations(table(spark, sf, "lineitem"), {"c": F.lit(1.0), "x": F.col("l_quantity")}, F.col("l_tax"))
    digits = {"c_c": 3, "c_x": 3, "x_x": 3, "c_y": 6, "x_y": 5, "y": 6, "y_y": 6}
    return m.select("n", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query(f"""with recursive {GRID}, m as (select "row", col, "row"::bigint * 2147483648 + col as id from g where n % 2 = 0),
e as (select a.id as a, b.id as b from m a join m b on abs(a."row" - b."row") <= 1 and abs(a.col - b.col) <= 1),
r as (select id as a, id as b from m union select r.a, e.b from r join e on r.b = e.a), c as (select a, min(b) as component from r group by a)
select component, count(*) as area from c group by 1""")
def components_area(spark, sf):
    found = G.components(cells(spark, sf).where("n % 2 = 0"))
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("area"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(case when l_orderkey % 17 = 0 then -32768 else round(greatest(least(l_extendedprice - 30000, 32767), -32768)) end as smallint) as z, cast(case when l_orderkey % 17 = 0 then 0 else round(greatest(least(l_quantity * 6.5, 255), 0)) end as integer) as b from lineitem")
def sat_cast(spark, sf):
    gone = lambda c: F.when(F.col("l_orderkey") % 17 != 0, c)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.nodata_short(gone(F.col("l_extendedprice") - 30000)).alias("z"), S.saturate(gone(F.col("l_quantity") * 6.5), 0, 255).alias("b"))


@query("""select n_nationkey, regexp_extract('GEOGCS["' || n_name || '",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137,298.257223563]],PRIMEM["Greenwich",0]]', 'GEOGCS\\["([^"]*)"', 1) as system from nation""")
def wkt_field(spark, sf):
    text = F.concat(F.lit('GEOGCS["'), F.col("n_name"), F.lit('",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137,298.257223563]],PRIMEM["Greenwich",0]]'))
    return table(spark, sf, "nation").select("n_nationkey", C.wkt_field(text, "GEOGCS").alias("system"))


@query("select page_id from pages where url like '%.html'")
def suffix_match(spark, sf):
    return table(spark, sf, "pages").where(F.col("url").endswith(".html")).select("page_id")


@query("select distinct k from (select c_nationkey as k from customer union all select s_nationkey from supplier) except select n_nationkey from nation where n_nationkey % 4 = 0")
def set_operations(spark, sf):
    both = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf, "supplier").select("s_nationkey"))
    return both.distinct().join(table(spark, sf, "nation").where("n_nationkey % 4 = 0"), F.col("k") == F.col("n_nationkey"), "left_anti").select("k")


@query("""with i as (select p_partkey as image_id, 3000 + p_size * 400 as width, 2500 + p_partkey % 50 * 300 as height from part),
n as (select *, greatest(1, round(width / 4400.0))::int as nx, greatest(1, round(height / 4400.0))::int as ny from i),
w as (select *, unnest(range(0, nx * ny)) as k from n)
select image_id, cast(k + 1 as integer) as window_id, cast(greatest(least(round((k % nx) * (width * 1.0::double / nx) - 300), width - 1), 0) as integer) as x0, cast(greatest(least(round((k // nx) * (height * 1.0::double / ny) - 300), height - 1), 0) as integer) as y0,
  cast(greatest(least(round((k % nx + 1) * (width * 1.0::double / nx) - 1 + 300), width - 1), 0) as integer) as x1, cast(greatest(least(round((k // nx + 1) * (height * 1.0::double / ny) - 1 + 300), height - 1), 0) as integer) as y1 from w""")
def window_tiles(spark, sf):
    """Windows of every image of part."""
    k = F.col("p_partkey")
    images = table(spark, sf, "part").select(k.alias("image_id"), (3000 + F.col("p_size") * 400).alias("width"), (2500 + k % 50 * 300).alias("height"))
    return C.image_tiles(images)


@query("select c_custkey, 304800.0 / 7.0 as focal_px, c_nationkey / 2 as pp_x from customer")
def camera_constants(spark, sf):
    i = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("width"), F.lit(1).alias("height"))
    return C.camera_constants(i).select("c_custkey", "focal_px", "pp_x")


def _scene(spark, shift=(0.0, 0.0, 0.0)):
    """A smooth surface on 40 x 40 cells and points on it, moved."""
    axes = G.Axes(0.0, 39.0, 1.0, 1.0, 40, 40)
    z = lambda x, y: 20 * F.sin(x / 6) + 15 * F.cos(y / 5) + 0.3 * x
    ref = axes.cells(spark).withColumn("val", z(F.col("x"), F.col("y")))
    n = F.col("id")
    pts = spark.range(3000).select(n.alias("pt_id"), (2 + (n * 7919 % 3600) / 100).alias("x"), (2 + (n * 104729 % 3600) / 100).alias("y"))
    pts = pts.withColumn("z", z(F.col("x"), F.col("y"))).select("pt_id", (F.col("x") + shift[0]).alias("x"), (F.col("y") + shift[1]).alias("y"), (F.col("z") + shift[2]).alias("z"))
    return axes, ref, pts


def surveyed(spark, sf):
    """Axes of 40 x 40 cells, a surface surveyed at the places of orders as cells, and points of it at the places of
    lineitem, each off by a little that goes by the quantity."""
    axes = G.Axes(0.0, 39.0, 1.0, 1.0, 40, 40)
    z = lambda x, y: 20 * F.sin(x / 6) + 15 * F.cos(y / 5) + 0.3 * x
    o, k = F.col("o_orderkey"), F.col("l_orderkey") * 7 + F.col("l_linenumber")
    places = table(spark, sf, "orders").select((o * 7919 % 3951 / 100).alias("x"), (o * 104729 % 3947 / 100).alias("y"))
    cells_ = G.cell_mean(places.withColumn("z", z(F.col("x"), F.col("y"))), axes).select("row", "col", "val")
    pts = table(spark, sf, "lineitem").select(k.alias("pt_id"), (2 + (k * 7919 + F.col("l_partkey") * 31) % 3600 / 100).alias("x"), (2 + (k * 104729 + F.col("l_suppkey") * 17) % 3600 / 100).alias("y"), ((F.col("l_quantity") - 25.5) / 500).alias("off"))
    return axes, cells_, pts.select("pt_id", "x", "y", (z(F.col("x"), F.col("y")) + F.col("off")).alias("z"))


@query()
def inpaint(spark, sf):
    """A surveyed grid with its empty cells and a cut-out filled."""
    axes, grid, _ = surveyed(spark, sf)
    return gaps.inpaint(grid.where("not (row between 10 and 14 and col between 10 and 13)"), axes)


@query()
def icp(spark, sf):
    """The motion that takes shifted points of lineitem back onto the surface surveyed at orders, its gaps filled."""
    axes, grid, pts = surveyed(spark, sf)
    face = G.surface(gaps.inpaint(grid, axes), 1.0, 1.0).join(axes.cells(spark), ["row", "col"])
    moved = pts.select("pt_id", (F.col("x") + 0.4).alias("x"), (F.col("y") - 0.3).alias("y"), (F.col("z") + 2.0).alias("z"))
    return spark.createDataFrame([tuple(map(float, r)) for r in E.icp(moved, face, axes, rounds=6)], "a double, b double, c double, shift double")


@query()
def ransac(spark, sf):
    k = F.col("c_custkey")
    x, y = (k * 53 % 1000).cast("double"), (k * 29 % 1000).cast("double")
    wrong = k % 4 == 0
    pairs = table(spark, sf, "customer").select(k.alias("pt_id"), x.alias("x"), y.alias("y"), F.when(wrong, y * 3).otherwise(0.8 * x - 0.6 * y + 10).alias("tx"), F.when(wrong, x * 2).otherwise(0.6 * x + 0.8 * y - 20).alias("ty"))
    found, _ = E.ransac(pairs, 1.0, hypotheses=60)
    return spark.createDataFrame([(float(found.scale), *map(float, found.shift), float(found.rms))], "scale double, sx double, sy double, rms double")


@query()
def polyfit(spark, sf):
    fit = E.polyfit(table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice", E.complete_terms(2, 1))
    return spark.createDataFrame([(int(t[0]), float(c), float(s), float(fit["rmse"]), float(fit["r2"])) for t, c, s in zip(fit["terms"], fit["coef"], fit["std"])], "power int, coef double, std double, rmse double, r2 double")


@query()
def triangulate(spark, sf):
    k = np.array([[1000.0, 0, 500.0], [0, 1000.0, 400.0], [0, 0, 1]])
    left, right = k @ np.column_stack([np.eye(3), [0, 0, 900.0]]), k @ np.column_stack([np.eye(3), [-100.0, 0, 900.0]])
    t = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("pt_id"), *[F.col("s_suppkey").cast("double").alias(c) for c in "xyz"])
    (xl, yl), (xr, yr) = (P.camera(np.eye(3), m, F.col("x"), F.col("y"), F.col("z")) for m in (left, right))
    return E.triangulate(t.select("pt_id", xl.alias("xl"), yl.alias("yl"), xr.alias("xr"), yr.alias("yr")), left, right)


@query()
def rasterize(spark, sf):
    """A cleaned elevation grid of lineitem's points."""
    axes, _, pts = surveyed(spark, sf)
    return stages.rasterize(pts, axes, gap_cells=4, speckle_cells=20, denoise=0.8)
