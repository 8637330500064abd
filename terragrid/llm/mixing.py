"""Mixing sources to target weights by Poisson replication (DataFrame operations only)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh


def _uniform(seed: int, *cols) -> F.Column:
    """A number in [0, 1) from the first 52 bits of an md5 over the seed and the columns as text."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, weights: dict[str, float] | None, epochs: float = 1.0, alpha: float = 0.5) -> DataFrame:
    """Mean repetition rate of each source.

    With n rows in all, a source with the share w of the target and m rows gets the rate epochs * n * w / m. Without
    weights the target share is m ** alpha, normalised (a temperature). A source that the weights don't name gets 0;
    named sources that no row has don't count. One row a source, a null source is its own source.
    """
    by = docs.groupBy("source").agg(F.count(F.lit(1)).alias("m"))
    if weights is None:
        target = F.pow(F.col("m").cast("double"), F.lit(alpha))
    else:
        if any(not w >= 0 or math.isinf(w) for w in weights.values()):
            raise ValueError("weights must be finite and not negative")
        target = F.coalesce(*[F.when(F.col("source") == k, F.lit(float(v))) for k, v in sorted(weights.items())], F.lit(0.0)) if weights else F.lit(0.0)
    every = Window.partitionBy()  # over one row a source
    by = by.select("source", "m", F.sum("m").over(every).alias("all_m"), target.alias("w"), F.sum(target).over(every).alias("all_w"))
    rate = F.when(F.col("all_w") > 0, F.col("all_m") * F.col("w") / F.col("all_w") / F.col("m") * epochs).otherwise(0.0)
    return by.select("source", rate.alias("rate"))


def terms(most: float) -> int:
    """How many terms of a Poisson distribution with a mean up to ``most`` reach 1 within a double's precision."""
    return int(most + 12 * math.sqrt(most) + 30)


def _distribution(rate, most: float) -> tuple[F.Column, F.Column]:
    """The Poisson distribution function at k, k + 1, ... as an array, its terms summed upward, and the first k.

    k is 0 up to a mean of 400; past that exp(-mean) nears the least double, so the sum begins 12 standard deviations
    and 30 below the mean (all before adds up to less than exp(-70)), with Stirling's series for the factorial. The
    array ends as far above the mean, or above ``most`` if that is more.
    """
    k = F.when(rate > 400, F.floor(rate - 12 * F.sqrt(rate) - 30)).otherwise(0).cast("int")
    x = k.cast("double")
    rest = 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5)))
    start = F.exp(-rest - (x * F.log(x / rate) + rate - x) - F.log(2 * math.pi * x) / 2)
    first = F.when(rate > 400, start).otherwise(F.exp(-rate))
    top = F.greatest(rate, F.lit(float(most)))
    end = F.floor(top + 12 * F.sqrt(top) + 30).cast("int")
    cdf = F.aggregate(
        F.sequence(k + 1, end - 1),
        F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all")),
        lambda s, i: F.struct((s.p * rate / i).alias("p"), (s.c + s.p * rate / i).alias("c"), F.array_append(s["all"], s.c + s.p * rate / i).alias("all")),
    )["all"]
    return cdf, k


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 20240, alpha: float = 0.5, most: float = 64.0, broadcast_sources: int = 10_000) -> DataFrame:
    """Each document as often as a Poisson number with its source's mean rate, all in one global random order.

    Returns the columns of ``docs`` (which needs doc_id and source; others may have any name) with copy (from 0),
    mix_copies, mix_rate and mix_key, which take the place of columns of these names. The number is inverted from a hash of seed and doc_id, so a
    rerun or a lost executor repeats it: it is the smallest k whose distribution function exceeds the hash. Equal
    doc_ids get equal numbers. A rate may be any size: the distribution's terms follow it, ``most`` is only the mean up
    to which all sources have the same number of them. A null source is a source of its own, a null id hashes as an empty text. The order:
    rows are dealt to partitions by the hash mix_key and sorted by it there, so a hot source is spread evenly. The
    table of rates is broadcast up to ``broadcast_sources`` sources (counted first), else joined by source. An empty
    table gives an empty one.
    """
    docs = docs.drop("copy", "mix_copies", "mix_rate", "mix_key")
    source_, cdf_, start_, unit_ = fresh(docs, "mix_source", "mix_cdf", "mix_start", "mix_unit")
    by = rates(docs, weights, epochs, alpha)
    few = docs.select("source").distinct().count() <= broadcast_sources
    cdf, start = _distribution(F.col("rate"), most)
    by = by.select(F.col("source").alias(source_), F.col("rate").alias("mix_rate"), cdf.alias(cdf_), start.alias(start_))
    counted = docs.join(F.broadcast(by) if few else by, F.col("source").eqNullSafe(F.col(source_))).drop(source_)
    counted = counted.withColumn(unit_, _uniform(seed, F.col("doc_id")))
    counted = counted.withColumn("mix_copies", F.when(F.col("mix_rate") > 0, F.col(start_) + F.size(F.filter(cdf_, lambda c: c <= F.col(unit_)))).otherwise(0)).drop(cdf_, start_, unit_)
    copies = counted.where("mix_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)))
    return copies.withColumn("mix_key", _uniform(seed + 1, F.col("doc_id"), F.col("copy"))).repartition("mix_key").sortWithinPartitions("mix_key", "doc_id", "copy")


def sql(documents: str, seed: int, alpha: float, most: float, columns: str = "doc_id, source, copy, mix_copies, round(mix_rate, 9) mix_rate, mix_key") -> str:
    """DuckDB SQL for the copies of each document: the same hash and inversion, rates for weights=None and epochs=1."""
    unit = lambda text: f"cast(('0x' || substr(md5({text}), 1, 13))::bigint as double) / 4503599627370496.0"
    return f"""
with recursive mix_d as (select * from {documents}),
mix_s as (select source, count(*) m, pow(count(*), {alpha}) w from mix_d group by source),
mix_r as (select source, (select sum(m) from mix_s) * w / (select sum(w) from mix_s) / m mix_rate from mix_s),
mix_c as (
  select source, mix_rate, 0 k, exp(-mix_rate) p, exp(-mix_rate) c from mix_r
  union all select source, mix_rate, k + 1, p * mix_rate / (k + 1), c + p * mix_rate / (k + 1) from mix_c where k < {terms(most) - 1}),
mix_l as (select source, mix_rate, list(c) cdf from mix_c group by all),
mix_n as (
  select d.*, mix_rate, len(list_filter(cdf, lambda x: x <= {unit(f"'{seed}|' || d.doc_id::varchar")})) mix_copies
  from mix_d d join mix_l l on d.source is not distinct from l.source),
mix_e as (select *, unnest(range(0, mix_copies)) copy from mix_n),
mix_o as (select *, {unit(f"'{seed + 1}|' || doc_id::varchar || '|' || copy::varchar")} mix_key from mix_e)
select {columns} from mix_o
"""
