"""Polygon files as tables of edges that a box filter can prune, and the cells or points that they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.spatial import edges

KEYS = ["file_id", "poly_id"]


def morton(x: Column, y: Column, bits: int = 16) -> Column:
    """A number that interleaves the bits of two whole numbers from 0, so that near places have near numbers."""

    def spread(v: Column) -> Column:
        v = v.cast("long").bitwiseAND((1 << bits) - 1)
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(mask)
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def edge_table(vertices: DataFrame) -> DataFrame:
    """file_id, poly_id, ring_id, x1, y1, x2, y2 and the polygon's box (px0, py0, px1, py1) of every edge of polygons
    given as vertices (file_id, poly_id, ring_id, vtx_id, x, y); ring 0 is the outer one, the others are holes."""
    named = vertices.withColumn("_poly", F.struct(*KEYS))
    rings = edges(named.select(F.col("_poly").alias("poly_id"), "ring_id", "vtx_id", "x", "y"))
    whole = Window.partitionBy(*KEYS)  # not a join, whose side Spark would take for small and broadcast
    box = {"px0": F.min("x1"), "py0": F.min("y1"), "px1": F.max("x1"), "py1": F.max("y1")}
    return rings.select("poly_id.*", "ring_id", "x1", "y1", "x2", "y2").withColumns({n: e.over(whole) for n, e in box.items()})


def write_polygons(vertices: DataFrame, path: str, cell: float, rows: int = 50_000) -> None:
    """The edge table as Parquet, in order of a space-filling key over cells of size ``cell`` and in row groups of about
    ``rows`` edges' bytes, so that row groups cover small boxes and a reader's box skips the others."""
    table = edge_table(vertices)
    least = F.col("px0"), F.col("py0")
    origin = table.agg(F.min("px0"), F.min("py0")).head()
    if origin[0] is not None:
        key = morton(*[F.floor((c - float(o)) / cell) for c, o in zip(least, origin)])
        table = table.repartitionByRange(key, *KEYS).sortWithinPartitions(key, *KEYS)
    table.write.mode("overwrite").option("parquet.block.size", rows * 80).parquet(path)


def read_polygons(spark: SparkSession, paths: list[str], box: tuple[float, float, float, float]) -> DataFrame:
    """The edges of all polygons in the files whose box meets ``box`` (x0, y0, x1, y1); the comparison reaches the scan."""
    x0, y0, x1, y1 = box
    meets = (F.col("px0") <= x1) & (F.col("px1") >= x0) & (F.col("py0") <= y1) & (F.col("py1") >= y0)
    return spark.read.parquet(*paths).where(meets)


_BOX = ["px0", "py0", "px1", "py1"]


def _bucket(c: str, cell: float) -> Column:
    return F.floor(F.col(c) / cell)


def _crosses(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether an edge is passed on the way from (x, y) to the right."""
    return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)


def _strips(table: DataFrame, cell: float, most: int) -> tuple[DataFrame, DataFrame]:
    """The edges (not the level ones) of each strip of size ``cell`` that a polygon passes: as one array ``_edges`` where
    these times the buckets across its box are ``most`` or fewer, and the others a row each."""
    sides = table.where("y1 <> y2").withColumn("_strip", F.explode(F.sequence(F.floor(F.least("y1", "y2") / cell), F.floor(F.greatest("y1", "y2") / cell))))
    n = F.count(F.lit(1)).over(Window.partitionBy(*KEYS, "_strip"))
    sides = sides.withColumn("_copies", n * (_bucket("px1", cell) - _bucket("px0", cell) + 1))
    few = sides.where(F.col("_copies") <= most).groupBy(*KEYS, *_BOX, "_strip").agg(F.array_sort(F.collect_list(F.struct("ring_id", "x1", "y1", "x2", "y2"))).alias("_edges"))
    return few, sides.where(F.col("_copies") > most)


def _met(points: DataFrame, strips: DataFrame, cell: float) -> DataFrame:
    """Points (pt_id, x, y) with the strips (of a polygon's box) whose box holds them, in as many tasks as a shuffle has
    partitions: Spark's sizes tell nothing of the pairs."""
    keys, parts = ["_bx", "_strip"], int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = points.select("pt_id", "x", "y", _bucket("x", cell).alias("_bx"), _bucket("y", cell).alias("_strip")).repartition(parts, *keys)
    dealt = strips.withColumn("_bx", F.explode(F.sequence(_bucket("px0", cell), _bucket("px1", cell)))).repartition(parts, *keys)
    near = asked.join(dealt.hint("merge"), keys)  # tables of polygons aren't broadcast
    return near.where(F.col("x").between(F.col("px0"), F.col("px1")) & F.col("y").between(F.col("py0"), F.col("py1")))


def _inside(met: DataFrame) -> DataFrame:
    """The rows that pass an odd number of the ``_edges`` of ring 0 and an even one of each other ring's."""
    passed = F.filter("_edges", lambda e: _crosses(F.col("x"), F.col("y"), e.x1, e.y1, e.x2, e.y2))
    none = F.array().cast("array<int>")
    odd = F.aggregate(passed, none, lambda held, e: F.when(F.array_contains(held, e.ring_id), F.array_remove(held, e.ring_id)).otherwise(F.array_append(held, e.ring_id.cast("int"))))
    return met.where(F.array_max(odd) == 0)


def _crossing(points: DataFrame, sides: DataFrame, cell: float) -> DataFrame:
    """pt_id, file_id, poly_id as ``covered_by``, by pairs of points and polygons that meet edges a row each."""
    near = _met(points, sides.select(*KEYS, *_BOX, "_strip").distinct(), cell).select(*KEYS, "pt_id", "x", "y", "_strip")
    met = near.join(sides.select(*KEYS, "ring_id", "x1", "y1", "x2", "y2", "_strip").hint("merge"), [*KEYS, "_strip"])
    odd = met.where(_crosses(*[F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")])).groupBy("pt_id", *KEYS, "ring_id").agg((F.count(F.lit(1)) % 2).alias("odd")).where("odd = 1")
    return odd.groupBy("pt_id", *KEYS).agg(F.max("ring_id").alias("_last")).where("_last = 0").select("pt_id", *KEYS)


def covered_by(points: DataFrame, table: DataFrame, cell: float, most: int = 4096) -> DataFrame:
    """pt_id, file_id, poly_id of points (pt_id, x, y) in a polygon of the edge table and in none of its holes.

    Points meet the polygons' strips by buckets of size ``cell`` and count crossings to the right. A strip brings its
    edges along, so pairs of points and polygons are judged where they meet and aren't shuffled; strips whose edges
    would be copied over ``most`` times take a second join, by polygon and strip.
    """
    few, many = _strips(table, cell, most)
    return _inside(_met(points, few, cell)).select("pt_id", *KEYS).union(_crossing(points, many, cell))


def covered(points: DataFrame, table: DataFrame, cell: float, most: int = 4096) -> DataFrame:
    """pt_id of points in any polygon of any file, less that polygon's own holes: as ``covered_by``, but strips with
    equal edges, as copies have, are met once."""
    few, many = _strips(table, cell, most)
    found = _inside(_met(points, few.select(*_BOX, "_strip", "_edges").distinct(), cell)).select("pt_id")
    return found.union(_crossing(points, many, cell).select("pt_id")).distinct()


def clip_convex(subject: Column, clip: Column) -> Column:
    """The part of a polygon within a convex one, both arrays of (x, y) in order; the clip counter-clockwise.

    Each edge of the clip keeps the half plane to its left: a vertex outside goes, and where an edge passes the line
    the crossing comes in. Empty where nothing is common.
    """
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    following = lambda a: F.concat(F.slice(a, 2, F.size(a)), F.slice(a, 1, 1))
    sides = F.zip_with(clip, following(clip), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def half(now, side):
        over = lambda p: (side.b.x - side.a.x) * (p.y - side.a.y) - (side.b.y - side.a.y) * (p.x - side.a.x)

        def step(p, q):
            part = over(p) / (over(p) - over(q))
            cross = point(p.x + part * (q.x - p.x), p.y + part * (q.y - p.y))
            none = F.array().cast("array<struct<x:double,y:double>>")
            inside = F.when(over(q) >= 0, F.array(point(q.x, q.y))).otherwise(none)
            passes = ((over(p) >= 0) & (over(q) < 0)) | ((over(p) < 0) & (over(q) >= 0))
            return F.concat(F.when(passes, F.array(cross)).otherwise(none), inside)

        return F.flatten(F.zip_with(now, following(now), step))

    start = F.transform(subject, lambda p: point(p.x.cast("double"), p.y.cast("double")))
    return F.aggregate(sides, start, half)


def area(ring: Column) -> Column:
    """Area of a polygon given as an array of (x, y)."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.abs(F.aggregate(F.zip_with(ring, nxt, lambda p, q: p.x * q.y - q.x * p.y), F.lit(0.0), lambda s, v: s + v)) / 2


def common_areas(rings: DataFrame, block: list[str], tile: int = 256, some: int = 256, digits: int | None = None) -> DataFrame:
    """id, other, area (rounded to ``digits``, if given) of all pairs (id < other) of convex polygons (block..., id, ring)
    of the same block.

    Polygons of one shape and place are clipped once, whatever their number, and shapes whose boxes don't meet aren't. A
    block's shapes are dealt into tiles of about ``tile``. Sized pairs of shapes then meet their lists of about ``some``
    ids, so only the last step makes as many rows as the result. Pairs of tiles and of lists are spread over as many
    tasks as a shuffle has partitions, and no side is broadcast: Spark takes it for as small as its polygons.
    """
    parts = int(rings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = lambda p, q, on: p.join(q.hint("merge"), on)
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rings = rings.select(*block, "id", "ring")
    once = rings.groupBy(*block, "ring").agg(F.min("id").alias("_shape"), F.ceil(F.count(F.lit(1)) / some).alias("_n"))
    listed = merged(rings, once, [*block, "ring"]).groupBy("_shape", F.pmod(F.xxhash64("id"), "_n").alias("_list")).agg(F.collect_list("id").alias("_ids"))
    ids = lambda s: listed.select(F.col("_shape").alias(f"_{s}"), F.col("_list").alias(f"_list_{s}"), F.col("_ids").alias(f"_ids_{s}"))
    ends = {f"_{f}{c}": g(F.transform("ring", lambda p: p[c])) for c in "xy" for f, g in (("lo", F.array_min), ("hi", F.array_max))}
    held = once.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / tile).alias("_tiles"))
    shapes = merged(once.select(*block, "_shape", "ring").withColumns(ends), held, block).withColumns({"_own": F.pmod(F.xxhash64("_shape"), "_tiles"), "_each": numbers("_tiles")})
    keys = [*block, "_left", "_right"]
    left = shapes.select(*block, F.col("_own").alias("_left"), F.col("_each").alias("_right"), F.col("_shape").alias("_a"), "ring", *ends).repartition(parts, *keys)
    right = shapes.select(*block, F.col("_own").alias("_right"), F.col("_each").alias("_left"), F.col("_shape").alias("_b"), *[F.col(c).alias(f"o{c}") for c in ("ring", *ends)]).repartition(parts, *keys)
    meet = F.lit(True)
    for c in "xy":
        meet = meet & (F.col(f"_lo{c}") <= F.col(f"o_hi{c}")) & (F.col(f"o_lo{c}") <= F.col(f"_hi{c}"))
    size = F.when(meet, F.transform(F.array(clip_convex(F.col("ring"), F.col("oring"))), area)[0]).otherwise(0.0)
    sized = merged(left, right, keys).where(F.col("_a") <= F.col("_b")).select("_a", "_b", (size if digits is None else F.round(size, digits)).alias("area"))
    lists = merged(merged(sized, ids("a"), "_a"), ids("b"), "_b").repartition(parts, "_a", "_b", "_list_a", "_list_b")
    each = lists.select((F.col("_a") == F.col("_b")).alias("_same"), "area", "_ids_b", F.explode("_ids_a").alias("_i")).select("_same", "area", "_i", F.explode("_ids_b").alias("_j"))
    return each.where("not _same or _i < _j").select(F.least("_i", "_j").alias("id"), F.greatest("_i", "_j").alias("other"), "area")
