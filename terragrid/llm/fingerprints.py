"""Document fingerprints by consistent weighted sampling (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What separates words.
SPACE = "\\x20\\x09-\\x0D"


def _sample(term, log_weight, j: int):
    """One packed sample: the negated log of Ioffe's a in the upper half, a hash of (term, t) in the lower.

    r and c are Gamma(2, 1), beta uniform, all from hashes of (term, j). The least packed number over a text's terms
    names the term and t that the text takes for sample j.
    """
    h, g = F.xxhash64(term, F.lit(j)), F.xxhash64(F.lit(j), term)
    unit = lambda x, s: (F.shiftrightunsigned(x, s).bitwiseAND(0x1FFFFF).cast("double") + 0.5) / float(1 << 21)
    r = -F.log(unit(h, 0) * unit(h, 21))
    log_c = F.log(-F.log(unit(g, 0) * unit(g, 21)))
    beta = unit(h, 42)
    t = F.floor(log_weight / r + beta)
    log_a = log_c - r * (t - beta + 1)
    # log_a is within -64 and 64 for weights up to e ** 16
    rank = ((F.greatest(F.least(log_a, F.lit(63.9)), F.lit(-63.9)) + 64) * float(1 << 24)).cast("long")
    return F.shiftleft(rank, 32).bitwiseOR(F.xxhash64(h, t).bitwiseAND(0xFFFFFFFF))


def signatures(texts: DataFrame, keys: list[str], samples: int) -> DataFrame:
    """``keys`` and sig (array of ``samples`` 32-bit numbers) of each row of ``texts`` (keys, text).

    Terms are words, weighted by how often they occur; the rate at which two signatures agree estimates generalised
    Jaccard similarity. A null or blank text has the one term of an empty word. If ``texts`` is partitioned by some of
    the keys, nothing is shuffled here.
    """
    trimmed = F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    words = texts.select(*keys, F.explode(F.split(trimmed, f"[{SPACE}]+")).alias("word"))
    counts = words.select(*keys, F.xxhash64("word").alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))
    weighed = counts.select(*keys, "term", F.log("n").alias("w"))
    least = weighed.groupBy(*keys).agg(*[F.min(_sample(F.col("term"), F.col("w"), j)).alias(f"m{j}") for j in range(samples)])
    return least.select(*keys, F.array(*[F.col(f"m{j}").bitwiseAND(0xFFFFFFFF) for j in range(samples)]).alias("sig"))


def likeness(a, b) -> F.Column:
    """Share of the samples on which two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / F.size(a)


def as_text(sig) -> F.Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, rn, tail, doc_id, text, next_text: each document beside the next one by descending doc_id.

    After the last comes the first. Rows of one id stand by text, null ids come last. Documents are dealt to
    ``buckets`` ranges of ids, so the text is shuffled once; a range's last row finds its successor in a copy of the
    next range's first row (tail = 1, one a range).
    """
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text")
    cuts = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], F.lit(20 * buckets))).head()[0] or []
    bounds = sorted(set(cuts))
    bucket = F.coalesce(F.size(F.filter(F.lit(bounds).cast("array<long>"), lambda b: b < F.col("doc_id"))), F.lit(-1)) if bounds else F.when(F.col("doc_id").isNull(), -1).otherwise(0)
    docs = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(bucket))
    heads = docs.groupBy("bucket").agg(F.max("doc_id").alias("doc_id")).orderBy(F.desc("bucket")).collect()  # a row a range
    if not heads:
        return docs.selectExpr("bucket", "1 rn", "0 tail", "doc_id", "text", "text next_text")
    before = {heads[(i + 1) % len(heads)].bucket: h.bucket for i, h in enumerate(heads)}
    first = docs.sparkSession.createDataFrame([(before[h.bucket], h.bucket, h.doc_id) for h in heads], "_before int, _bucket int, _head long")
    is_head = (F.col("bucket") == F.col("_bucket")) & F.col("doc_id").eqNullSafe(F.col("_head"))
    tails = docs.join(F.broadcast(first), is_head).groupBy("_before").agg(F.min("text").alias("text")).selectExpr("_before bucket", "cast(null as long) doc_id", "text", "1 tail")
    rows = docs.selectExpr("bucket", "doc_id", "text", "0 tail").unionByName(tails)
    order = Window.partitionBy("bucket").orderBy("tail", F.desc_nulls_last("doc_id"), "text")
    return rows.select("bucket", F.row_number().over(order).alias("rn"), "tail", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def edited(text, next_text) -> F.Column:
    """The text with its last half replaced by as many first characters of the next one."""
    half = F.floor(F.char_length(text) / 2)
    return F.concat(F.left(text, F.char_length(text) - half), F.left(next_text, half))


def compare(docs: DataFrame, samples: int = 32, buckets: int = 64) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next document's are.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; one row a row of
    ``docs`` (doc_id, text). A null text is an empty one; an empty table gives an empty one. Equal texts have equal
    fingerprints. Everything after the shuffle of the texts works within the ranges of ids.
    """
    pairs = with_next(docs, buckets)
    both = pairs.withColumn("edited", F.when(F.col("tail") == 0, edited(F.col("text"), F.col("next_text"))))
    sides = both.select("bucket", "rn", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("text")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")))).alias("s"))
    sides = sides.select("bucket", "rn", "s.side", "s.text").where("side = 0 or text is not null")
    sig = signatures(sides, ["bucket", "rn", "side"], samples)
    # a row a text side: bring both sides of a document and the next document's together within the range
    order = Window.partitionBy("bucket").orderBy("rn", "side")
    own, at = F.col("sig"), lambda k: F.lead("sig", k).over(order)
    near = sig.select("bucket", "rn", "side", "sig", at(1).alias("e"), at(2).alias("n")).where("side = 0 and e is not null")
    near = near.select("bucket", "rn", as_text(own).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"), likeness(own, F.col("e")).alias("near_edited"), likeness(own, F.col("n")).alias("near_next"))
    about = both.where("tail = 0").select("bucket", "rn", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    return about.join(near, ["bucket", "rn"]).drop("bucket", "rn")
