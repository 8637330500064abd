"""Quality by an interpolated modified Kneser-Ney model of characters, trained on trusted text.

n-grams are strings of code points. Counts, discounts, probabilities and back-off weights are tables joined by n-gram;
no part of the model is collected or broadcast, in estimation or in scoring, whatever its size.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import Scratch, fresh

_START = 1


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts on end, and where each begins. Other white space than newlines counts as a space, digits as 0."""
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    x = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    x = np.where((x == 9) | ((x >= 11) & (x <= 13)) | (x == 0xA0), 32, x)
    return np.where((x >= 48) & (x <= 57), 48, np.maximum(x, 2)).astype(np.uint32), at


def _grams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which n-gram ends at each character (texts begun with start symbols), the distinct n-grams (rows of code
    points), and where each text's characters begin."""
    x, at = _symbols(texts)
    padded = np.insert(x, np.repeat(at[:-1], order - 1), np.uint32(_START))
    keep = np.ones(len(padded), bool)
    first = at[:-1] + np.arange(len(at) - 1) * (order - 1)
    for k in range(order - 1):
        keep[first + k] = False
    ends = np.flatnonzero(keep)
    if not len(ends):
        return np.zeros(0, np.int64), np.zeros((0, order), np.uint32), at
    # these texts' symbols are numbered, so that an n-gram is one whole number
    used = np.zeros(int(padded.max()) + 1, bool)
    used[padded] = True
    symbols = np.flatnonzero(used).astype(np.uint32)
    if len(symbols) ** order < 1 << 64:
        number = np.zeros(len(used), np.uint64)
        number[symbols] = np.arange(len(symbols), dtype=np.uint64)
        number = number[padded]
        key = number[ends]
        for k in range(1, order):
            key = key + number[ends - k] * np.uint64(len(symbols) ** k)
        code, distinct = pd.factorize(key)
        rows = np.empty((len(distinct), order), np.uint32)
        for k in range(order):
            rows[:, order - 1 - k] = symbols[(distinct // np.uint64(len(symbols) ** k) % np.uint64(len(symbols))).astype(np.int64)]
    else:
        rows, code = np.unique(padded[ends[:, None] - np.arange(order - 1, -1, -1)], axis=0, return_inverse=True)
    return code.ravel(), rows, at


def _strings(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"<U{rows.shape[1]}").ravel()


def _hash(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        h = T.mix(h * np.uint64(31) + rows[:, k].astype(np.uint64) + np.uint64(1))
    return h


def count(docs: DataFrame, order: int = 5) -> DataFrame:
    """key (the n-gram) and c of all n-grams of the texts of ``docs``; a slice's are added up before the shuffle."""
    emit = T.emitter("key string, c long")

    def run(batches):
        for part in T.slices(batches, most=1 << 20):
            code, rows, _ = _grams(part.column("text").to_pylist(), order)
            yield emit({"key": _strings(rows), "c": np.bincount(code, minlength=len(rows))})
            T.release()

    return docs.selectExpr("cast(text as string) text").mapInArrow(run, "key string, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _suffix(key: str = "key") -> F.Column:
    return F.expr(f"substring({key}, 2)")


def _context(key: str = "key") -> F.Column:
    return F.expr(f"left({key}, char_length({key}) - 1)")


def estimate(counts: DataFrame, scratch: Scratch, order: int = 5) -> tuple[list[DataFrame], list[DataFrame]]:
    """Probabilities (key, p) and back-off weights (ctx, gamma) of the orders 1 to ``order``.

    Orders below the highest count the distinct characters before an n-gram. Each order has three discounts from its
    counts of counts. Below order 1 all symbols seen and one more are equally likely. Tables are joined on contexts
    and on shorter n-grams.
    """
    tables, now = [], scratch.save(counts, f"count{order}")
    for n in range(order, 0, -1):
        tables.append(now)
        if n > 1:
            now = scratch.save(now.select(_suffix().alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("c")), f"count{n - 1}")
    every = now.count() + 1
    probabilities, weights, lower = [], [], None
    for n, table in enumerate(reversed(tables), 1):
        few = {r.k: r.n for r in table.groupBy(F.least("c", F.lit(5)).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
        n1, n2, n3, n4 = (max(1, few.get(k, 0)) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d1, d2, d3 = (min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        rows = table.select("key", "c", _context().alias("ctx"), cut.alias("d"))
        context = scratch.save(rows.groupBy("ctx").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma")), f"context{n}")
        rows = rows.join(context, "ctx")
        own = (F.col("c") - F.col("d")) / F.col("total")
        if lower is None:
            p = rows.select("key", (own + F.col("gamma") / float(every)).alias("p"))
        else:
            below = lower.select(F.col("key").alias("_k"), F.col("p").alias("_p"))
            p = rows.join(below, _suffix() == F.col("_k")).select("key", (own + F.col("gamma") * F.col("_p")).alias("p"))
        lower = scratch.save(p, f"p{n}")
        probabilities.append(lower)
        weights.append(context.select("ctx", "gamma"))
    return probabilities, weights


def look_up(grams: DataFrame, probabilities: list[DataFrame], weights: list[DataFrame], scratch: Scratch) -> DataFrame:
    """h and lp (natural log-probability) of the n-grams (h, gram): the longest part that the model has, and the
    back-off weights above it; a round of joins for each order."""
    rest, found = grams.select("h", F.col("gram").alias("key"), F.lit(0.0).alias("w")), None
    for n in range(len(probabilities), 0, -1):
        rest = scratch.save(rest.join(probabilities[n - 1], "key", "left"), f"asked{n}")
        seen = rest.where("p is not null").select("h", (F.col("w") + F.log("p")).alias("lp"))
        found = seen if found is None else found.union(seen)
        rest = rest.where("p is null").select("h", "key", "w", _context().alias("ctx")).join(weights[n - 1], "ctx", "left")
        rest = rest.select("h", _suffix().alias("key"), (F.col("w") + F.log(F.coalesce("gamma", F.lit(1.0)))).alias("w"))
    every = probabilities[0].count() + 1
    return found.union(rest.select("h", (F.col("w") - F.log(F.lit(float(every)))).alias("lp")))


def score(docs: DataFrame, probabilities: list[DataFrame], weights: list[DataFrame], keep_text: bool = False, block: int = 16 << 20, shard_keys: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` with lm_chars and lm_log_p (summed natural log-probability of the characters) after their
    own columns; without ``keep_text`` the text is left out. A null text has no characters.

    Texts are gathered in compressed blocks of about ``block`` bytes, each with its distinct n-grams. All blocks'
    distinct n-grams are looked up by joins. Then a block sends each of its n-grams (by a 64-bit hash) once to that
    hash's shard and gets the logarithms back; the table of blocks is bucketed, so the texts themselves aren't shuffled.
    """
    spark, order = docs.sparkSession, len(probabilities)
    scratch = Scratch(spark, "scores")
    docs = docs.withColumn("text", F.col("text").cast("string"))
    ddl = "block long, n_grams int, grams binary, data binary"
    emit, emit_gram = T.emitter(ddl), T.emitter("h long, gram string")

    def gather(batches):
        part, number, held, parts, rows, waiting = TaskContext.get().partitionId(), 0, 0, [], [], 0
        pack = zstandard.ZstdCompressor(level=6).compress

        def merged():
            grams = np.concatenate(rows)
            return grams[np.unique(_hash(grams), return_index=True)[1]]

        def flush():
            grams = merged()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, parts[0].schema) as out:
                for p in parts:
                    out.write_batch(p)
            return emit({"block": [part << 32 | number], "n_grams": [len(grams)], "grams": [pack(grams.tobytes())], "data": [pack(sink.getvalue())]})

        for sub in T.slices(batches, most=1 << 20):
            rows.append(_grams(sub.column("text").to_pylist(), order)[1])
            parts.append(sub)
            waiting += 1
            if waiting == 4:  # distinct ones only, every few slices
                rows, waiting = [merged()], 0
            held += sub.nbytes
            if held >= block:
                yield flush()
                number, held, parts, rows, waiting = number + 1, 0, [], [], 0
                T.release()
        if parts:
            yield flush()
            parts, rows = [], []
            T.release()

    def open_grams(data: bytes) -> np.ndarray:
        return np.frombuffer(zstandard.decompress(data), "<u4").reshape(-1, order)

    def each(batches, *columns):
        """The rows' values one row at a time: a block is large, and all of a batch at once would be copied."""
        for batch in batches:
            for i in range(batch.num_rows):
                yield tuple(batch.column(c)[i].as_py() for c in columns)

    def list_grams(batches):
        for (data,) in each(batches, "grams"):
            grams = open_grams(data)
            yield emit_gram({"h": _hash(grams).view(np.int64), "gram": _strings(grams)})
        T.release()

    made = docs.mapInArrow(gather, ddl)
    name, buckets = f"kn_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    made.write.bucketBy(buckets, "block").option("path", f"{scratch.base}/blocks").option("compression", "zstd").saveAsTable(name)
    blocks = spark.table(name)
    grams = blocks.select("grams").mapInArrow(list_grams, "h long, gram string").distinct()
    shards = max(1, (blocks.agg(F.sum("n_grams")).head()[0] or 0) // shard_keys)
    scores = scratch.save(look_up(grams, probabilities, weights, scratch), "looked_up")
    scratch.drop(*[f"asked{n}" for n in range(1, order + 1)])
    scores = scores.withColumn("shard", F.shiftrightunsigned(F.shiftrightunsigned("h", 32) * F.lit(shards), 32).cast("int"))
    sent, back = T.emitter("shard int, block long, hs binary"), T.emitter("block long, shard int, lps binary")

    def send(batches):
        for number, data in each(batches, "block", "grams"):
            h = np.sort(_hash(open_grams(data)))
            shard = ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(shard, prepend=-1))
            ends = np.append(cuts[1:], len(h))
            yield sent({"shard": shard[cuts], "block": [number] * len(cuts), "hs": [h[a:b].tobytes() for a, b in zip(cuts, ends)]})
        T.release()

    def reply(asked: pa.Table, known: pa.Table) -> pa.Table:
        h, lp = known.column("h").to_numpy().view(np.uint64), known.column("lp").to_numpy()
        order_ = np.argsort(h)
        h, lp = h[order_], lp[order_]
        got = [lp[np.searchsorted(h, np.frombuffer(x, "<u8"))].tobytes() for x in asked.column("hs").to_pylist()]
        return pa.Table.from_batches([back({"block": asked.column("block").combine_chunks(), "shard": asked.column("shard").combine_chunks(), "lps": got})])

    asked = blocks.select("block", "grams").mapInArrow(send, "shard int, block long, hs binary")
    replies = asked.groupBy("shard").cogroup(scores.groupBy("shard")).applyInArrow(reply, "block long, shard int, lps binary")
    replies = replies.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("shard", "lps"))).alias("replies"))
    schema = docs.schema if keep_text else docs.drop("text").schema
    out_ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "lm_chars long, lm_log_p double"])
    emit_row = T.emitter(out_ddl)

    def add_up(batches):
        for data, grams, got in each(batches, "data", "grams", "replies"):
            h, lp = np.sort(_hash(open_grams(grams))), np.frombuffer(b"".join(r["lps"] for r in got), "<f8")
            for sub in pa.ipc.open_stream(zstandard.decompress(data)):
                code, rows, at = _grams(sub.column("text").to_pylist(), order)
                own = lp[np.searchsorted(h, _hash(rows))]
                total = np.concatenate([[0.0], np.cumsum(own[code])])
                yield emit_row({c: sub.column(c) for c in schema.names} | {"lm_chars": np.diff(at), "lm_log_p": total[at[1:]] - total[at[:-1]]})
            T.release()

    result = scratch.save(blocks.join(replies, "block", "left").select("data", "grams", F.coalesce("replies", F.array().cast("array<struct<shard:int,lps:binary>>")).alias("replies")).mapInArrow(add_up, out_ddl), "scored")
    spark.sql(f"drop table {name}")
    scratch.drop("blocks", "looked_up")
    return result


def mark_trusted(docs: DataFrame, trusted: DataFrame, most: int = 2_000_000) -> DataFrame:
    """``docs`` with lm_trusted: whether the doc_id is in ``trusted`` (doc_id). Up to ``most`` ids (counted first) are
    broadcast, more are joined by a shuffle."""
    (id_,) = fresh(docs, "trusted_id")
    ids = trusted.select(F.col("doc_id").cast("long").alias(id_)).where(F.col(id_).isNotNull()).distinct()
    ids = F.broadcast(ids) if ids.count() <= most else ids
    return docs.join(ids, docs.doc_id.cast("long") == F.col(id_), "left").withColumn("lm_trusted", F.col(id_).isNotNull()).drop(id_)


def judge(docs: DataFrame, trusted: DataFrame, order: int = 5, quantile: float = 0.99, margin: float = 1.12, prior: int = 200, keep_text: bool = False) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, others) with lm_chars, perplexity, lm_threshold and lm_kept, which take the place of columns of these names.

    The model counts every character n-gram of the trusted documents. A document's perplexity is drawn toward the
    trusted text's mean as if by ``prior`` more characters, which steadies short texts. A language's threshold is
    ``margin`` times the ``quantile`` of its trusted documents' perplexities, so clean text stays; a language without
    trusted documents has the threshold of all of them, and without any trusted text everything stays. A text without
    characters has no perplexity and isn't kept. Null languages are a language; rows stay one to one.
    """
    scratch = Scratch(docs.sparkSession, "kneser_ney")
    docs = docs.drop("lm_chars", "lm_log_p", "lm_trusted", "perplexity", "lm_threshold", "lm_kept")
    lang_, limit_ = fresh(docs, "limit_lang", "limit")
    marked = mark_trusted(docs, trusted)
    probabilities, weights = estimate(count(marked.where("lm_trusted"), order), scratch, order)
    scored = score(marked, probabilities, weights, keep_text)
    mean = F.sum("lm_log_p") / F.sum("lm_chars")
    trusted_mean = scored.where("lm_trusted and lm_chars > 0").agg(mean.alias("m")).head().m or 0.0
    perplexity = F.when(F.col("lm_chars") > 0, F.exp(-(F.col("lm_log_p") + prior * trusted_mean) / (F.col("lm_chars") + prior)))
    scored = scored.withColumn("perplexity", perplexity)
    good = scored.where("lm_trusted and perplexity is not null")
    top = F.percentile_approx("perplexity", quantile, F.lit(100_000)) * margin
    every = good.agg(top.alias("t")).head().t
    rows = [(r.lang, r.t) for r in good.groupBy("lang").agg(top.alias("t")).collect()]  # a row a language
    limits = docs.sparkSession.createDataFrame(rows, f"{lang_} string, {limit_} double")
    out = scored.join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col(lang_)), "left")
    limit = F.coalesce(limit_, F.lit(float("inf") if every is None else float(every)))
    return out.withColumn("lm_threshold", limit).withColumn("lm_kept", F.coalesce(F.col("perplexity") <= limit, F.lit(False))).drop(lang_, limit_, "lm_trusted", "lm_log_p")
