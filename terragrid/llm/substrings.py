"""Substring deduplication: FM-indexes over shards of the corpus find words covered by windows that occur again.

Every window is routed by its least word 8-gram (its anchor), so equal windows meet in one shard: a run of windows with
one anchor travels as one stretch of text. Each shard's stretches are indexed (suffix order, Burrows-Wheeler transform,
wavelet matrix) and streamed against the index by backward search.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import Scratch, fresh

_GRAM = 8


class WaveletMatrix:
    """Ranks of symbols in a sequence; each level's bits are packed, with a count for every 64."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.words, self.ones, self.zeros = [], [], []
        now = seq
        for level in reversed(range(self.bits)):
            bit = (now >> level & 1).astype(np.uint8)
            packed = np.packbits(np.append(bit, np.zeros(-len(bit) % 64 + 64, np.uint8)), bitorder="little").view("<u8")
            self.words.append(packed)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        # where each symbol's block begins on the last level
        self.base = self._down(np.arange(sigma, dtype=np.int64), np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(reversed(range(self.bits))):
            word = at >> 6
            one = self.ones[k][word] + np.bitwise_count(self.words[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> level & 1, self.zeros[k] + one, at - one)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, at) - self.base[symbol]


class FMIndex:
    """Counts of patterns in ``text``: symbols from 1 to ``sigma`` - 1, pieces each ended by a 0."""

    def __init__(self, text: np.ndarray, sigma: int):
        n = len(text)
        # the pieces' ends differ from one another, so suffixes differ within a piece's length
        ends = np.flatnonzero(text == 0)
        rank = text.astype(np.int64) + len(ends)
        rank[ends] = np.arange(len(ends))
        step = 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1 if step < n else 0
            key = rank * (int(rank.max()) + 2) + after
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            key = key[order]
            new[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            rank = new
            if rank.max() == n - 1 or step >= n:
                break
            step *= 2
        self.n = n
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.wavelet = WaveletMatrix(text[order - 1], sigma)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the suffix ranges of patterns with one more symbol in front."""
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return self.less[symbol] + both[: len(symbol)], self.less[symbol] + both[len(symbol) :]


def repeated_windows(stretches: list[np.ndarray], copies: np.ndarray, sigma: int, window: int) -> np.ndarray:
    """(stretch, from, upto) rows: window starts of each stretch whose words occur twice or more in all of them.

    A stretch with several copies is indexed twice. For an end in a stretch, backward search runs as far as the match
    still occurs twice: all windows within it are repeated. Where it stops, the few words from there on are searched;
    if they occur once, no window across them is repeated and the next end lies before theirs, else one word before.
    """
    text = np.concatenate([np.append(s, 0) for s, c in zip(stretches, copies) for _ in range(min(2, int(c)))])
    index = FMIndex(text, sigma)
    flat, size = np.concatenate(stretches), np.array([len(s) for s in stretches])
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    out = []
    lane = np.arange(len(size))
    end, stop = size.copy(), np.zeros(len(size), np.int64)  # of the match searched now: its end, and the least start
    whole, right, right_end = np.ones(len(size), bool), size.copy(), size.copy()
    at, lo, hi = size.copy(), np.zeros(len(size), np.int64), np.full(len(size), index.n)
    while len(lane):
        new_lo, new_hi = index.extend(flat[first[lane] + at - 1], lo, hi)
        good = new_hi - new_lo >= 2
        at = at - good
        lo, hi = np.where(good, new_lo, lo), np.where(good, new_hi, hi)
        over = ~good | (at == stop)
        if over.any():
            k = np.flatnonzero(over)
            # a whole search is over: note the windows, then look at the few words across the stop
            w = k[whole[k]]
            found = w[right_end[w] - at[w] >= window]
            out.append(np.column_stack([lane[found], at[found], right_end[found] - window + 1]))
            more = w[(at[w] > 0) & (right_end[w] > window)]
            done = np.setdiff1d(w, more)
            # a short search is over: where it failed the next end lies before its own
            s = k[~whole[k]]
            end[s] = np.where(good[s] & (at[s] == stop[s]), end[s] - 1, right_end[s] - 1)
            done = np.concatenate([done, s[end[s] < window]])
            again = s[end[s] >= window]
            whole[more], stop[more] = False, at[more] - 1
            right_end[more] = np.minimum(at[more] - 1 + _GRAM, end[more])
            whole[again], stop[again], right_end[again] = True, 0, end[again]
            for x in (more, again):
                at[x], lo[x], hi[x] = right_end[x], 0, index.n
            if len(done):
                keep = np.ones(len(lane), bool)
                keep[done] = False
                lane, end, stop, whole, right_end, at, lo, hi = (a[keep] for a in (lane, end, stop, whole, right_end, at, lo, hi))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def _word_hashes(part: pa.RecordBatch) -> tuple[np.ndarray, T.Words, np.ndarray]:
    buf, at = T.raw(part.column("text"))
    words = T.Words(buf, at)
    return buf, words, words.hashes()


def _stretch_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words h[start:end] for many stretches: sums of powers, shifted to begin alike."""
    base, inverse = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(h) + 1, base, np.uint64)) if len(h) else np.ones(1, np.uint64)
        down = np.cumprod(np.full(len(h) + 1, inverse, np.uint64)) if len(h) else np.ones(1, np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * power[: len(h)])])
        return T.mix((total[end] - total[start]) * down[start] ^ (end - start).astype(np.uint64))


_RUN = "anchor long, content long, row long, start int, n int, inner boolean"


def _runs(docs: DataFrame, window: int, longest: int) -> DataFrame:
    """Runs of consecutive windows (at most ``longest``) of one text with one anchor: the windows' least 8-gram.

    inner: the anchor stands in the run twice or more, so the run may repeat itself."""
    emit = T.emitter(_RUN)

    def run(batches):
        for part in T.slices(batches):
            _, words, h = _word_hashes(part)
            doc = T.doc_of(words.doc)
            if len(h) < window:
                continue
            grams = T.rolling(h, _GRAM)
            low, have, need = grams, 1, window - _GRAM + 1
            while have < need:  # least over growing runs of 8-grams
                step = min(have, need - have)
                low = np.minimum(low[: len(low) - step], low[step:])
                have += step
            first = np.flatnonzero(doc[: len(h) - window + 1] == doc[window - 1 :])
            if not len(first):
                continue
            new = np.ones(len(first), bool)
            new[1:] = (np.diff(first) != 1) | (low[first[1:]] != low[first[:-1]]) | (doc[first[1:]] != doc[first[:-1]])
            head = np.flatnonzero(new)
            n = np.diff(np.append(head, len(first)))
            # very long runs (texts that repeat themselves) are cut
            cuts = -(-n // longest)
            nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start, size = np.repeat(first[head], cuts) + nth * longest, np.minimum(longest, np.repeat(n, cuts) - nth * longest)
            d = doc[start]
            reach = size + need - 1  # 8-grams in the run's windows
            begin = np.cumsum(reach) - reach
            same = grams[np.arange(reach.sum()) + np.repeat(start - begin, reach)] == np.repeat(low[start], reach)
            inner = np.add.reduceat(same, begin, dtype=np.int64) > 1
            yield emit({"inner": inner, "anchor": low[start].view(np.int64), "content": _stretch_hash(h, start, start + size + window - 1).view(np.int64), "row": part.column("row").to_numpy()[d], "start": start - words.doc[d], "n": size})

    return docs.select("row", "text").mapInArrow(run, _RUN)


def _single(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """The same windows as runs of one, with a hash of all their words for the anchor."""
    emit = T.emitter(_RUN)
    listed = runs.groupBy(F.col("row").alias("_row")).agg(F.collect_set(F.struct("start", "n")).alias("runs"))

    def run(batches):
        for part in T.slices(batches):
            _, words, h = _word_hashes(part)
            row, at = [], []
            for r, d, runs in zip(part.column("row").to_pylist(), words.doc, part.column("runs").to_pylist()):
                for x in runs:
                    at.append(d + x["start"] + np.arange(x["n"]))
                    row.append(np.full(x["n"], r))
            at, row = np.concatenate(at), np.concatenate(row)
            start = at - words.doc[np.searchsorted(words.doc, at, "right") - 1]
            yield emit({"anchor": T.rolling(h, window)[at].view(np.int64), "content": _stretch_hash(h, at, at + window).view(np.int64), "row": row, "start": start, "n": np.ones(len(at), np.int64), "inner": np.zeros(len(at), bool)})

    return docs.select("row", "text").join(listed, docs.row == F.col("_row")).drop("_row").mapInArrow(run, _RUN)


def _stretches(docs: DataFrame, kinds: DataFrame, window: int) -> DataFrame:
    """anchor, content, copies and the words (joined by spaces) of every kind of stretch, read from one text that has it."""
    ddl = "anchor long, content long, copies int, words binary"
    emit = T.emitter(ddl)
    listed = kinds.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("anchor", "content", "copies", "start", "n")).alias("runs"))

    def run(batches):
        for part in T.slices(batches):
            words = T.Words(*T.raw(part.column("text")))
            joined = np.full(len(words.data) + len(words), 0x20, np.uint8)
            joined[np.arange(len(words.data)) + T.doc_of(words.at)] = words.data
            b, at = joined.tobytes(), words.at + np.arange(len(words.at))
            out = {k: [] for k in ("anchor", "content", "copies", "words")}
            for d, runs in zip(words.doc, part.column("runs").to_pylist()):
                for x in runs:
                    for k in ("anchor", "content", "copies"):
                        out[k].append(x[k])
                    s = d + x["start"]
                    out["words"].append(b[at[s] : at[s + x["n"] + window - 1] - 1])
            yield emit(out)

    return docs.select("row", "text").join(listed, docs.row == F.col("_row")).drop("_row").mapInArrow(run, ddl)


def _search(stretches: DataFrame, shards: int, window: int) -> DataFrame:
    """anchor, content, a, b: the repeated window starts a up to b of each kind of stretch, from its shard's index."""
    ddl = "anchor long, content long, a int, b int"
    emit = T.emitter(ddl)

    def shard(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        texts = table.column("words").to_pylist()
        joined = b" ".join(texts)
        words = T.Words(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]))
        codes, kinds = words.codes()
        cuts = np.cumsum([t.count(b" ") + 1 for t in texts])
        found = repeated_windows(np.split(codes + 1, cuts[:-1]), table.column("copies").to_numpy(), len(kinds) + 1, window)
        k = pa.array(found[:, 0])
        return pa.Table.from_batches([emit({"anchor": table.column("anchor").take(k).combine_chunks(), "content": table.column("content").take(k).combine_chunks(), "a": found[:, 1], "b": found[:, 2]})])

    return stretches.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard").applyInArrow(shard, ddl)


def repeats(docs: DataFrame, scratch: Scratch, window: int = 35, longest: int = 64, hot: int = 4096, shard_words: int = 1_000_000) -> DataFrame:
    """row and spans (word ranges to remove) of the rows of ``docs`` (row, text) with words in repeated windows."""
    runs = scratch.save(_runs(docs, window, longest), "runs")

    def again(runs: DataFrame, name: str) -> DataFrame:
        """Runs whose anchor occurs twice or more; the others' windows occur once."""
        twice = runs.groupBy("anchor").agg(F.sum(F.when(F.col("inner"), 2).otherwise(1)).alias("c")).where("c > 1").select("anchor")
        return scratch.save(runs.join(twice, "anchor", "left_semi"), name)

    some = again(runs, "again")
    scratch.drop("runs")
    count = lambda runs: runs.groupBy("anchor", "content").agg(F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("copies"), F.first("row").alias("row"), F.first("start").alias("start"), F.first("n").alias("n"))
    kinds = scratch.save(count(some), "kinds")
    # many different stretches around one anchor: their windows are dealt by all of their words
    many = scratch.save(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot).select("anchor"), "many")
    if many.limit(1).count():
        single = again(_single(docs, some.join(many, "anchor", "left_semi"), window), "single")
        some = some.join(many, "anchor", "left_anti").union(single.select(some.columns))
        kinds = scratch.save(kinds.join(many, "anchor", "left_anti").select("anchor", "content", "copies", "row", "start", "n").union(count(single)), "kinds2")
    total = kinds.agg(F.sum(F.col("n") + window - 1)).head()[0] or 0
    spans = scratch.save(_search(_stretches(docs, kinds, window), max(1, total // shard_words), window), "spans")
    scratch.drop("kinds", "kinds2")
    where = some.join(spans, ["anchor", "content"]).select("row", (F.col("start") + F.col("a")).alias("s"), (F.col("start") + F.col("b") + (window - 1)).alias("e"))
    return where.groupBy("row").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def remove(docs: DataFrame, window: int = 35, keep_text: bool = True, **options) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, others) with each word taken out that a repeated window covers.

    A window is ``window`` consecutive words of one text (words: runs of other characters than white space in ASCII);
    it is repeated if the same words also start anywhere else, in this text or another. Windows are judged on the
    input. The text of a row that loses words becomes its other words joined by one space. Adds n_words, n_removed and
    kept_sha256 (of the other words joined by one space), in place of columns of these names; without ``keep_text`` the text is left out. Null and empty
    texts have no words; rows of one id and text are texts of their own, so they repeat each other.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    docs = docs.drop("n_words", "n_removed", "kept_sha256")
    row_, other_, spans_ = fresh(docs, "row", "other_row", "spans")
    named = docs.withColumn(row_, F.xxhash64(docs.doc_id, docs.text, F.lit(1)))
    found = repeats(named.select(F.col(row_).alias("row"), "text"), scratch, window, **options)
    spans = scratch.save(found, "ranges").select(F.col("row").alias(other_), F.col("spans").alias(spans_))
    schema = docs.schema if keep_text else docs.drop("text").schema
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "n_words long, n_removed long, kept_sha256 string"])
    emit = T.emitter(ddl)

    def run(batches):
        for part in T.slices(batches):
            texts, spans = part.column("text").to_pylist(), part.column(spans_).to_pylist()
            out = {"text": [], "n_words": [], "n_removed": [], "kept_sha256": []}
            for text, found in zip(texts, spans):
                words = text.encode().split()
                kept = words
                if found:
                    gone = np.zeros(len(words) + 1, np.int32)
                    for x in found:
                        gone[x["s"]] += 1
                        gone[x["e"]] -= 1
                    kept = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
                data = b" ".join(kept)
                out["text"].append(data.decode() if found else text)
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept_sha256"].append(hashlib.sha256(data).hexdigest())
            yield emit({c: part.column(c) for c in schema.names if c != "text"} | out)

    return named.join(spans, F.col(row_) == F.col(other_), "left").drop(row_, other_).mapInArrow(run, ddl)
