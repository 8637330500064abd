"""Missing values, rounding, casts and quantiles with the numeric conventions of gridded data.

Missing is NULL here: NaN becomes NULL when data come in, and a comparison with a missing value is false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_nan(c: Column) -> Column:
    """NaN and infinities as NULL."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def holds(predicate: Column) -> Column:
    """A predicate that is false, not NULL, on missing values."""
    return F.coalesce(predicate, F.lit(False))


def saturate(c: Column, low: int, high: int, kind: str = "int", missing: int = 0) -> Column:
    """Rounded half away from zero and held within low and high; missing values become ``missing``."""
    held = F.round(F.greatest(F.least(c, F.lit(float(high))), F.lit(float(low))))
    return F.when(c.isNull(), F.lit(float(missing))).otherwise(held).cast(kind)  # greatest and least skip NULL


def nodata_short(c: Column) -> Column:
    """Elevation as 16-bit with -32768 for missing."""
    return saturate(c, -32768, 32767, "short", -32768)


def valid(c: Column, low: float = -500.0, high: float = 9000.0, nulls: tuple = ()) -> Column:
    """Values outside the valid range, or in ``nulls``, as NULL."""
    ok = c.between(low, high)
    return F.when(ok & ~c.isin(*nulls) if nulls else ok, c)


def hash_order(id_: Column, seed: int) -> Column:
    """A pseudo-random order that any SQL engine can compute from an integer id."""
    return F.pmod(id_.cast("long") * 2654435761 + F.lit(seed * 40503), F.lit(4294967296))


def hazen(df: DataFrame, value: str, quantiles: list[float], by: list[str] | None = None, most: int = 100_000) -> DataFrame:
    """Hazen quantiles (plotting positions (i - 0.5) / n, linear between) of ``value`` for each group ``by``.

    Returns by..., q, value. Missing values don't count. A sketch brackets each quantile; one pass counts the values
    below its bracket, and only the bracket's distinct values are sorted, so no task gets a whole group. A bracket
    that misses its order statistics (the counts show it) is replaced by the whole range. Brackets are a row a group;
    those of up to ``most`` groups (counted) are broadcast, so values stay where they are and no task sorts a group.
    """
    keys = by or ["_g"]
    data = df.where(F.col(value).isNotNull()).select(*(by or [F.lit(1).alias("_g")]), F.col(value).cast("double").alias("_v"))
    q = [float(x) for x in quantiles]
    sides = [min(max(x + d, 0.0), 1.0) for x in q for d in (-0.002, 0.002)]
    cuts = data.groupBy(*keys).agg(F.percentile_approx("_v", sides, F.lit(5_000)).alias("_cut"), F.count(F.lit(1)).alias("_all"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    low, high = (lambda i: F.col("_cut")[2 * i]), (lambda i: F.col("_cut")[2 * i + 1])
    few = by is None or data.select(*keys).distinct().limit(most + 1).count() <= most
    sent = F.broadcast if few else lambda b: b
    join = lambda a, b: a.join(sent(b.select(*[F.col(c).alias(f"_k_{c}") for c in keys], *[c for c in b.columns if c not in keys])), [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys]).drop(*[f"_k_{c}" for c in keys])
    counts = join(data, cuts).groupBy(*keys).agg(*[F.count_if(F.col("_v") < low(i)).alias(f"_b{i}") for i in range(len(q))], *[F.count_if(F.col("_v") <= high(i)).alias(f"_u{i}") for i in range(len(q))])
    known = join(cuts, counts)
    place = lambda x: F.greatest(F.least(F.col("_all") * x + 0.5, F.col("_all").cast("double")), F.lit(1.0))
    first = lambda x: F.floor(place(x))
    second = lambda x: F.least(first(x) + 1, F.col("_all"))
    fits = [(F.col(f"_b{i}") < first(x)) & (second(x) <= F.col(f"_u{i}")) for i, x in enumerate(q)]
    wanted = F.array(*[F.struct(F.lit(x).alias("q"), F.when(f, low(i)).otherwise(F.col("_min")).alias("lo"), F.when(f, high(i)).otherwise(F.col("_max")).alias("hi"), F.when(f, F.col(f"_b{i}")).otherwise(0).alias("below"), first(x).alias("k0"), second(x).alias("k1"), (place(x) - first(x)).alias("part")) for i, (x, f) in enumerate(zip(q, fits))])
    inside = join(data, known.select(*keys, wanted.alias("_w"))).select(*keys, "_v", F.explode(F.filter("_w", lambda w: F.col("_v").between(w["lo"], w["hi"]))).alias("w"))
    near = inside.groupBy(*keys, "w.q", "w.below", "w.k0", "w.k1", "w.part", "_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.col("below") + F.sum("_n").over(Window.partitionBy(*keys, "q").orderBy("_v"))
    near = near.withColumn("_upto", upto)
    at = lambda k: F.max(F.when((F.col("_upto") - F.col("_n") < F.col(k)) & (F.col(k) <= F.col("_upto")), F.col("_v")))
    return near.groupBy(*keys, "q").agg((at("k0") + (at("k1") - at("k0")) * F.max("part")).alias("value")).select(*(by or []), "q", "value")
