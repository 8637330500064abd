"""Robust statistics, histograms, sampling and the sums behind least-squares estimators."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import hash_order, hazen


def clip_quantiles(df: DataFrame, value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Rows with a value between two Hazen quantiles of all values."""
    q = {r.q: r.value for r in hazen(df, value, [low, high]).collect()}
    return df.where(F.col(value).between(q[low], q[high])) if q else df.limit(0)


def clip_quantiles_by(df: DataFrame, value: str, by: list[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Rows with a value between two Hazen quantiles of their group's values."""
    ends = hazen(df, value, [low, high], by).groupBy(*by).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    return df.join(ends, by).where(F.col(value).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def rmse(df: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    return df.agg(F.count(value).alias("n"), F.sum(v * v).alias("sse"), F.sqrt(F.avg(v * v)).alias("rmse"))


def frequent_spacing(df: DataFrame, value: str, top: int = 3, least: float = 1.0) -> DataFrame:
    """resolution: the mean of the ``top`` most frequent values (ties: the smaller), ``least`` at the lowest."""
    best = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), value).limit(top)
    return best.agg(F.greatest(F.avg(value), F.lit(least)).alias("resolution"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    bin_ = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1))
    return df.where(F.col(value).between(low, high)).groupBy(bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def otsu(df: DataFrame, value: str, low: float, high: float, bins: int = 256) -> DataFrame:
    """threshold: the first bin's upper edge that splits the histogram with the largest variance between the classes."""
    h = histogram(df, value, low, high, bins).withColumn("m", F.col("bin") * F.col("n"))
    upto, every = Window.orderBy("bin"), Window.partitionBy()  # over the bins only
    h = h.select("bin", F.sum("n").over(upto).alias("w"), F.sum("m").over(upto).alias("s"), F.sum("n").over(every).alias("all_w"), F.sum("m").over(every).alias("all_s"))
    w, s = F.col("w").cast("double"), F.col("s").cast("double")
    between = F.try_divide(F.pow(F.col("all_s") * w - s * F.col("all_w"), F.lit(2.0)), w * (F.col("all_w") - w))
    best = h.select("bin", between.alias("v")).where("v is not null").orderBy(F.desc(F.round("v", 3)), "bin").limit(1)
    return best.select((F.lit(low) + (F.col("bin") + 1) * ((high - low) / bins)).alias("threshold"))


def mad_threshold(df: DataFrame, value: str, k: float = 3.0) -> DataFrame:
    """threshold: median + k * 1.4826 * median absolute deviation."""
    m = hazen(df, value, [0.5]).head()
    if m is None:
        return df.sparkSession.createDataFrame([], "threshold double")
    off = hazen(df.select(F.abs(F.col(value) - m.value).alias("_d")), "_d", [0.5])
    return off.select((F.lit(m.value) + k * 1.4826 * F.col("value")).alias("threshold"))


def row_col_mean(grid: DataFrame) -> DataFrame:
    """row, col, val: the lower of the row's and the column's mean, for every cell."""
    rows, cols = grid.groupBy("row").agg(F.avg("val").alias("rm")), grid.groupBy("col").agg(F.avg("val").alias("cm"))
    return grid.join(rows, "row").join(cols, "col").select("row", "col", F.least("rm", "cm").alias("val"))


def sample(df: DataFrame, id_: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of an arithmetic hash of the id."""
    return df.orderBy(hash_order(F.col(id_), seed), id_).limit(n)


def stride(df: DataFrame, id_: str, step: int) -> DataFrame:
    return df.where((F.col(id_) - 1) % step == 0)


def quota(df: DataFrame, group: str, id_: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each group in hash order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(hash_order(F.col(id_), seed), id_))).where(F.col("_r") <= n).drop("_r")


def convergence(df: DataFrame, group: str, order: list[str], value: str, n: int = 10, within: float = 0.1) -> DataFrame:
    """``df`` with settled: whether the n values before a row all are there and within a range."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(-n, -1)
    return df.withColumn("spread", F.max(value).over(w) - F.min(value).over(w)).withColumn("settled", (F.count(value).over(w) == n) & F.coalesce(F.col("spread") < within, F.lit(False)))


def moments(df: DataFrame, left: list[str], right: list[str], weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """n, sums of all columns and of the products left x right: what closed-form alignment needs, in one aggregation
    (for each group ``by``)."""
    w = F.col(weight) if weight else F.lit(1.0)
    sums = [F.sum(w).alias("n")] + [F.sum(w * F.col(c)).alias(f"s_{c}") for c in [*left, *right]]
    return df.groupBy(*(by or [])).agg(*sums, *[F.sum(w * F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for a in left for b in right], *[F.sum(w * F.col(a) * F.col(a)).alias(f"s_{a}_{a}") for a in [*left, *right]])


def normal_equations(df: DataFrame, features: dict[str, Column], target: Column) -> DataFrame:
    """n, the sums of feature products (upper triangle), of feature times target, and of target and its square."""
    names = list(features)
    data = df.select(*[c.alias(n) for n, c in features.items()], target.alias("_y")).where(" and ".join(f"`{n}` is not null" for n in [*names, "_y"]))
    return data.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in combinations_with_replacement(names, 2)], *[F.sum(F.col(a) * F.col("_y")).alias(f"{a}_y") for a in names], F.sum("_y").alias("y"), F.sum(F.col("_y") * F.col("_y")).alias("y_y"))
