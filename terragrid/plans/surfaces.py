"""Queries of whole surfaces: gaps filled by least squares, meshes, resizing; with DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import gaps, mesh
from ..operators.resize import resize
from .queries import AX, GRID, cells, query, rounded
from .regional import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]


def _heights(spark, sf) -> DataFrame:
    """Cells of lineitem in thousands, so that slopes are moderate."""
    return cells(spark, sf).select("row", "col", (F.col("val") / 1000).alias("val"))


_LAPLACE = """e as (select m."row" as mr, m.col as mc, m."row" + dr as er, m.col + dc as ec from m, (values (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) t(dr, dc) where m."row" + dr between 1 and 10 and m.col + dc between 1 and 50),
t as (select mr, mc, er, ec, (case when er between 2 and 9 then 1.0 else 0.0 end)::double as dn, (case when ec between 2 and 49 then 1.0 else 0.0 end)::double as al from e),
s as (select mr, mc, er, ec, er as "row", ec as col, -2 * (dn + al) as v from t union all select mr, mc, er, ec, er - 1, ec, dn from t union all select mr, mc, er, ec, er + 1, ec, dn from t union all select mr, mc, er, ec, er, ec - 1, al from t union all select mr, mc, er, ec, er, ec + 1, al from t),
q as (select mr, mc, er, ec, sum(case when s."row" = mr and s.col = mc then v else 0 end) as a, sum(case when s."row" = mr and s.col = mc then 0 else v * k.val end) as b from s left join k using ("row", col) where v <> 0 group by all),
x as (select mr as "row", mc as col, -sum(a * b) / sum(a * a) as val from q group by all)"""


@query(f"""with {GRID}, m as (select a.i::int as "row", b.i::int as col from range(1, 11) a(i), range(1, 51) b(i) where (a.i = 5 and b.i % 7 = 3) or (a.i in (1, 10) and b.i % 7 = 1)),
k as (select "row", col, val from g where not exists (select 1 from m where m."row" = g."row" and m.col = g.col)), {_LAPLACE}
select "row", col, round(val, 6) as val from x union all select "row", col, round(val, 6) from k""")
def inpaint_spots(spark, sf):
    """Cells cut out one by one, on the rim, in corners and inside, each filled by least squares."""
    r, c = F.col("row"), F.col("col")
    cut = ((r == 5) & (c % 7 == 3)) | (r.isin(1, 10) & (c % 7 == 1))
    return rounded(gaps.inpaint(cells(spark, sf).where(~cut).select("row", "col", "val"), AX), 6, "val")


@query()
def inpaint_holes(spark, sf):
    """Holes of several blocks, of both ends of the grid, and single cells, all filled in the same rounds."""
    r, c = F.col("row"), F.col("col")
    cut = (r.between(3, 8) & c.between(6, 20)) | (c >= 44) | ((r * 7 + c * 3) % 11 == 0)
    return rounded(gaps.inpaint(cells(spark, sf).where(~cut).select("row", "col", "val"), AX, block=6), 4, "val")


_MESH = f"""{GRID}, h as (select "row", col, (col - 1)::bigint * 10 + "row" as vertex, (col - 1)::double as x, (10 - "row")::double as y, val / 1000 as z from g),
sq as (select r.i as r, c.i as c, a.vertex as nw, b.vertex as ne, d.vertex as sw, e.vertex as se from range(1, 10) r(i) cross join range(1, 50) c(i)
  left join h a on a."row" = r.i and a.col = c.i left join h b on b."row" = r.i and b.col = c.i + 1 left join h d on d."row" = r.i + 1 and d.col = c.i left join h e on e."row" = r.i + 1 and e.col = c.i + 1),
f0 as (select 2 * (c * 10 + r + 1) as face_id, case when nw is null or se is null then [nw, sw, ne] else [nw, sw, se] end as v from sq union all select 2 * (c * 10 + r + 1) + 1, case when nw is null or se is null then [sw, se, ne] else [nw, se, ne] end from sq),
f as (select face_id, v from f0 where v[1] is not null and v[2] is not null and v[3] is not null),
cross_ as (select face_id, (b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y) as nx, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) as ny, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) as nz from f join h a on a.vertex = v[1] join h b on b.vertex = v[2] join h c on c.vertex = v[3]),
n0 as (select face_id, nx / sqrt(nx * nx + ny * ny + nz * nz) as nx, ny / sqrt(nx * nx + ny * ny + nz * nz) as ny, nz / sqrt(nx * nx + ny * ny + nz * nz) as nz from cross_)"""


@query(f"with {_MESH} select face_id, round(nx, 8) as nx, round(ny, 8) as ny, round(nz, 8) as nz from n0")
def mesh_normals(spark, sf):
    """Normals of the triangles over the cells of lineitem."""
    vertices, faces = mesh.grid_mesh(_heights(spark, sf), AX)
    return rounded(mesh.face_normals(faces, vertices), 8, "nx", "ny", "nz")


_MOVE = """c{k} as (select face_id, avg(x) as cx, avg(y) as cy, avg(z) as cz from inc join {was} using (vertex) group by all),
{now} as (select p.vertex, p.x + coalesce(avg(n1.nx * (n1.nx * (cx - p.x) + n1.ny * (cy - p.y) + n1.nz * (cz - p.z))), 0) as x, p.y + coalesce(avg(n1.ny * (n1.nx * (cx - p.x) + n1.ny * (cy - p.y) + n1.nz * (cz - p.z))), 0) as y, p.z + coalesce(avg(n1.nz * (n1.nx * (cx - p.x) + n1.ny * (cy - p.y) + n1.nz * (cz - p.z))), 0) as z
  from {was} p left join inc using (vertex) left join n1 using (face_id) left join c{k} using (face_id) group by p.vertex, p.x, p.y, p.z)"""


@query(f"""with {_MESH}, inc as (select face_id, unnest(v) as vertex from f),
pairs as (select distinct a.face_id, b.face_id as other from inc a join inc b using (vertex)),
w as (select p.face_id, o.nx, o.ny, o.nz, a.nx * o.nx + a.ny * o.ny + a.nz * o.nz - 0.3 as d from pairs p join n0 a using (face_id) join n0 o on o.face_id = p.other),
s as (select face_id, sum(d * d * nx) as nx, sum(d * d * ny) as ny, sum(d * d * nz) as nz from w where d > 0 group by all),
n1 as (select face_id, nx / sqrt(nx * nx + ny * ny + nz * nz) as nx, ny / sqrt(nx * nx + ny * ny + nz * nz) as ny, nz / sqrt(nx * nx + ny * ny + nz * nz) as nz from s),
{_MOVE.format(k=1, was="h", now="m1")}, {_MOVE.format(k=2, was="m1", now="m2")}
select vertex, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z from m2""")
def mesh_smooth(spark, sf):
    """The mesh over the cells of lineitem after a round of normals and two moves of its vertices."""
    vertices, faces = mesh.grid_mesh(_heights(spark, sf), AX)
    return rounded(mesh.smooth(vertices, faces, 0.3, rounds=1, moves=2), 6, "x", "y", "z")


@query()
def mesh_denoise(spark, sf):
    """The cells of lineitem smoothed as a mesh and sampled at the cells again."""
    return rounded(mesh.denoise(_heights(spark, sf), AX, 0.3), 4, "val")


#: Method and scale of each resizing, with its kernel in SQL over t.
_SIZES = [("bicubic", 0.5), ("bilinear", 0.4), ("nearest", 0.4), ("bicubic", 1.5)]
_KERNELS = {
    "bicubic": "case when abs(t) <= 1 then 1.5 * pow(abs(t), 3) - 2.5 * t * t + 1 when abs(t) <= 2 then -0.5 * pow(abs(t), 3) + 2.5 * t * t - 4 * abs(t) + 2 else 0 end",
    "bilinear": "greatest(1 - abs(t), 0)",
    "nearest": "case when t >= -0.5 and t < 0.5 then 1 else 0 end",
}


def _lines(k: int, n: int, method: str, scale: float) -> str:
    """SQL of the weights w{k}_{n} (o, i, w) of a line of n cells."""
    out, shrink = -int(-(n * scale) // 1), scale if scale < 1 and method != "nearest" else 1.0
    return f"""t{k}_{n} as (select o.i as o, s.i as s, ((o.i / {scale!r}::double + 0.5 * (1 - 1 / {scale!r}::double)) - s.i) * {shrink!r}::double as t from range(1, {out + 1}) o(i), range({-n}, {3 * n}) s(i)),
r{k}_{n} as (select o, case when (s - 1 + {2 * n}) % {2 * n} < {n} then (s - 1 + {2 * n}) % {2 * n} + 1 else {2 * n} - (s - 1 + {2 * n}) % {2 * n} end as i, sum({_KERNELS[method]})::double as w from t{k}_{n} group by all),
w{k}_{n} as (select o, i, w / sum(w) over (partition by o) as w from r{k}_{n} where w <> 0)"""


_PICTURE = ", ".join(f"""{_lines(k, 10, m, s)}, {_lines(k, 50, m, s)}, z{k} as (select '{m}' as method, {s!r}::double as scale, a.o::int as "row", b.o::int as col, sum(a.w * b.w * g.val) as val, count(*) as n, max((select count(*) from w{k}_10 where o = a.o) * (select count(*) from w{k}_50 where o = b.o)) as need from g join w{k}_10 a on a.i = g."row" join w{k}_50 b on b.i = g.col group by a.o, b.o)""" for k, (m, s) in enumerate(_SIZES))


@query(f"""with {GRID}, {_PICTURE} {" union all ".join(f'select method, scale, "row", col, round(val, 5) as val from z{k} where n = need' for k in range(len(_SIZES)))}""")
def resize_grid(spark, sf):
    """The cells of lineitem made smaller and larger by the three kernels."""
    grid = cells(spark, sf).select("row", "col", "val")
    parts = [resize(grid, AX.nrows, AX.ncols, s, m).select(F.lit(m).alias("method"), F.lit(s).alias("scale"), "row", "col", "val") for m, s in _SIZES]
    return rounded(reduce(DataFrame.union, parts), 5, "val")
