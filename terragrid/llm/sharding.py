"""Uniform shuffling into shards of exact sizes by a hypergeometric communication matrix (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh


def _uniform(*cols) -> Column:
    """A number between 0 and 1 from 52 bits of a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 12).cast("double") + 0.5) / float(1 << 52)


def _let(values: Column, use) -> Column:
    """use(values), where ``values`` (a struct) is worked out once."""
    return F.transform(F.array(values), use)[0]


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` things out of ``total`` are among the ``good`` ones: the distribution inverted at ``u``.

    Terms are relative to the mode's and follow from ratios, first upward and then downward from it, within 12
    standard deviations and 30 (all beyond adds up to less than exp(-70)); so no factorials and no limit on sizes.
    """
    given = F.struct(total.cast("double").alias("t"), good.cast("double").alias("g"), drawn.cast("double").alias("n"))

    def limits(v):
        least, most = F.greatest(F.lit(0.0), v.n - (v.t - v.g)), F.least(v.n, v.g)
        mode = F.least(F.greatest(F.floor((v.n + 1) * (v.g + 1) / (v.t + 2)).cast("double"), least), most)
        reach = F.ceil(12 * F.sqrt(v.n / v.t * v.g * ((v.t - v.g) / v.t) * ((v.t - v.n) / F.greatest(v.t - 1, F.lit(1.0)))) + 30).cast("double")
        return _let(F.struct(v.t.alias("t"), v.g.alias("g"), v.n.alias("n"), least.alias("least"), most.alias("most"), mode.alias("mode"), reach.alias("reach")), terms)

    def terms(v):
        up = F.transform(_upto(F.least(v.most - v.mode, v.reach)), lambda i: _let((v.mode + i - 1).alias("k"), lambda k: (v.g - k) * (v.n - k) / ((k + 1) * (v.t - v.g - v.n + k + 1))))
        down = F.transform(_upto(F.least(v.mode - v.least, v.reach)), lambda i: _let((v.mode - i + 1).alias("k"), lambda k: k * (v.t - v.g - v.n + k) / ((v.g - k + 1) * (v.n - k + 1))))
        return _let(F.struct(up.alias("up"), down.alias("down"), v.mode.alias("mode")), sums)

    def running(ratios, first):
        """The sum of 1, r1, r1 r2, ... without its first term, added to ``first``."""
        return F.aggregate(ratios, F.struct(F.lit(1.0).alias("p"), first.alias("c")), lambda s, r: F.struct((s.p * r).alias("p"), (s.c + s.p * r).alias("c")))["c"]

    def sums(v):
        upper = running(v.up, F.lit(1.0))
        return _let(F.struct(v.up.alias("up"), v.down.alias("down"), v.mode.alias("mode"), upper.alias("upper"), (u * running(v.down, upper)).alias("aim")), invert)

    def past(ratios, first, aim):
        """How many of the running sums are ``aim`` or less."""
        step = lambda s, r: F.struct((s.p * r).alias("p"), (s.c + s.p * r).alias("c"), (s.n + F.when(s.c + s.p * r <= aim, 1).otherwise(0)).alias("n"))
        return F.aggregate(ratios, F.struct(F.lit(1.0).alias("p"), first.alias("c"), F.lit(0).alias("n")), step)["n"]

    def invert(v):
        upward = v.mode + past(v.up, F.lit(1.0), v["aim"]) + 1
        downward = v.mode - past(v.down, v.upper, v["aim"]) - 1
        return F.when(v["aim"] < 1.0, v.mode).when(v["aim"] < v.upper, upward).otherwise(F.greatest(downward, v.mode - F.size(v.down)))

    return F.when(total > 0, _let(given, limits)).otherwise(0).cast("long")


def _upto(n: Column) -> Column:
    return F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))


def matrix(counts: DataFrame, sizes: list[int], seed: int) -> DataFrame:
    """part and quota (array: rows for each shard) of each row of ``counts`` (part, n), at random.

    The numbers of rows that a random permutation would send from each part to each shard, whose sizes add up to all
    rows. The parts are split in halves, and again: what the left half sends to each shard is drawn from what its
    parent sends, shard after shard, and the right half sends the rest. Each level works on all its nodes at once, and
    a node holds the numbers of its parts (a number a part, no rows).
    """
    node = counts.agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts")).withColumn("quota", F.lit(sizes).cast("array<long>"))
    levels, parts = 0, counts.count()
    while 1 << levels < parts:
        levels += 1
    add = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y)
    for _ in range(levels):
        half = F.floor(F.size("parts") / 2).cast("int")
        node = node.withColumn("left_n", add(F.transform(F.slice("parts", 1, half), lambda p: p.n)))
        ends = F.element_at("parts", 1)["part"], F.element_at("parts", -1)["part"]

        def draw(s, q):
            got = hypergeometric(s.total, q, s["open"], _uniform(F.lit(seed), *ends, F.size(s.out)))  # noqa: B023
            return _let(F.struct(s.total.alias("total"), s["open"].alias("open"), s.out.alias("out"), q.alias("q"), got.alias("got")), lambda x: F.struct((x.total - x.q).alias("total"), (x["open"] - x.got).alias("open"), F.array_append(x.out, x.got).alias("out")))

        start = F.struct(add(F.col("quota")).alias("total"), F.col("left_n").alias("open"), F.array().cast("array<long>").alias("out"))
        node = node.withColumn("sent", F.aggregate("quota", start, draw)["out"])
        rest = F.zip_with("quota", "sent", lambda a, b: a - b)
        left, right = F.struct(F.slice("parts", 1, half).alias("parts"), F.col("sent").alias("quota")), F.struct(F.slice("parts", half + 1, F.size("parts")).alias("parts"), rest.alias("quota"))
        # a node of one part is done
        node = node.select(F.explode(F.when(F.size("parts") > 1, F.array(left, right)).otherwise(F.array(F.struct("parts", "quota")))).alias("x")).select("x.*")
    return node.where("size(parts) = 1").select(F.col("parts")[0]["part"].alias("part"), "quota")


def shard(docs: DataFrame, shards: int = 16, seed: int = 13, rows: int = 50_000, broadcast_cells: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` in a uniformly random order, dealt to ``shards`` shards whose counts are at most one apart.

    Returns all columns with shard and slot (gapless from 0 in each shard), which take the place of columns of these
    names; a shard's rows come in order of slot, in consecutive runs of about ``rows`` or fewer. What rows hold never
    matters: nulls, repeated rows and equal texts are dealt like others. Fewer rows than shards leave shards empty.

    Each partition permutes its rows and is written once, which fixes them should an executor be lost. The matrix says
    how many of a partition's rows go to each shard: the first so many of its order to shard 0, and so on. Rows move
    once, to runs of their shard drawn by hash, which are permuted again; a shard is never one task. The matrix (a
    number a partition and shard) is broadcast up to ``broadcast_cells`` numbers, else joined.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    docs = docs.drop("shard", "slot")
    spark, columns = docs.sparkSession, docs.columns
    scratch = Scratch(spark, "shards")
    key_, part_, place_, quota_, run_, from_ = fresh(docs, "key", "part", "place", "quota", "run", "from_slot")
    local = docs.withColumn(key_, F.rand(seed)).sortWithinPartitions(key_).withColumn(key_, F.monotonically_increasing_id())
    fixed = scratch.save(local, "permuted").withColumns({part_: F.shiftright(key_, 33), place_: F.col(key_).bitwiseAND((1 << 33) - 1)})
    counts = scratch.save(fixed.groupBy(F.col(part_).alias("part")).agg(F.count(F.lit(1)).alias("n")), "counts")
    parts, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).head()
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    quotas = scratch.save(matrix(counts, sizes, seed), "matrix").select(F.col("part").alias(part_), F.col("quota").alias(quota_))
    placed = fixed.join(F.broadcast(quotas) if parts * shards <= broadcast_cells else quotas, part_)
    # the shard whose share of the partition's order holds the place
    past = F.aggregate(quota_, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n")), lambda s, q: F.struct((s.sum + q).alias("sum"), (s.n + F.when(s.sum + q <= F.col(place_), 1).otherwise(0)).alias("n")))["n"]
    runs = max(-(-sizes[0] // rows), -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // shards), 1)
    placed = placed.withColumn("shard", past).withColumn(run_, F.floor(_uniform(F.lit(seed + 1), F.col(key_)) * runs).cast("int"))
    ahead = Window.partitionBy("shard").orderBy(run_).rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", run_).agg(F.count(F.lit(1)).alias("n"))
    starts = scratch.save(starts.select("shard", run_, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(from_)), "runs")
    inside = Window.partitionBy("shard", run_).orderBy(F.xxhash64(F.lit(seed + 2), F.col(key_)), key_)
    out = placed.drop(part_, place_, quota_).join(starts, ["shard", run_])
    return out.select(*columns, "shard", (F.col(from_) + F.row_number().over(inside) - 1).alias("slot"))
