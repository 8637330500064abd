"""Token-id files compressed by Re-Pair grammars, one grammar a shard, with random-access decoding."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .common import Scratch
from .tokens import Encoder, with_end

_MAGIC = b"RPS1"
_STEP = 1024


def _replace(seq: np.ndarray, at: np.ndarray, least: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round: the pairs that begin at the places ``at`` are counted, those counted ``least`` times or more replaced.

    Returns the new sequence, the replaced pairs (n x 2) in the order of their nonterminals from ``base`` on, and the
    places to look at in the next round. Where chosen pairs overlap, the more frequent one goes first.
    """
    none = seq, np.zeros((0, 2), np.uint32), np.zeros(0, np.int64)
    code, pairs = pd.factorize(seq[at] << 32 | seq[at + 1])
    count = np.bincount(code, minlength=len(pairs))
    # of a run of one pair (the same id again and again) the first, third, ... count
    run = np.flatnonzero(np.append(True, (np.diff(at) > 1) | (np.diff(code) != 0))) if len(at) else np.zeros(0, np.int64)
    apart = (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0
    count = np.bincount(code[apart], minlength=len(pairs)) if not apart.all() else count
    hit = np.flatnonzero(apart & (count[code] >= least))
    if not len(hit):
        return none
    # pairs counted equally often rank in a mixed order, so that of a long repeated passage many win in one round
    mixed = np.random.default_rng(0).permutation(len(pairs))
    place, rank = at[hit], count[code[hit]] * len(pairs) + mixed[code[hit]]
    beside = np.diff(place) == 1
    wins = np.ones(len(hit), bool)
    wins[1:] &= ~beside | (rank[1:] > rank[:-1])
    wins[:-1] &= ~beside | (rank[:-1] > rank[1:])
    wins &= np.bincount(code[hit[wins]], minlength=len(pairs))[code[hit]] >= least
    chosen, rule = np.unique(code[hit[wins]], return_inverse=True)
    place, lost = place[wins], place[~wins]
    out, keep = seq.copy(), np.ones(len(seq), bool)
    out[place] = base + rule
    keep[place + 1] = False
    # next: pairs with a new nonterminal in them, and those that lost their place to another
    again = np.zeros(len(seq) + 1, bool)
    again[place], again[lost] = True, True
    again[place[place > 0] - 1] = True
    gone = np.flatnonzero(again[:-1] & ~keep)  # the pair before a replaced one begins at a nonterminal now
    again[gone - 1] = True
    out, again = out[keep], np.flatnonzero(again[:-1][keep])
    pairs = pairs[chosen]
    return out, np.column_stack([pairs >> 32, pairs & 0xFFFFFFFF]).astype(np.uint32), again[again < len(out) - 1]


def compress(ids: np.ndarray, first: np.ndarray, doc_ids: list, least: int = 8) -> bytes:
    """One shard: documents ``doc_ids`` (None allowed) begin at ``first`` (one more entry: the end) in ``ids``.

    Rounds replace all pairs that stand ``least`` times or more till none is left; a rule takes 12 bytes and an
    occurrence saves two or three, so rarer pairs would make the shard larger (2: Re-Pair to the end). After a round
    only pairs that it made or pushed aside can be frequent, so only these are counted again, exactly.

    Layout, little-endian: magic, eight counts, then document ids and starts (int64) and which ids are null, rules (two
    uint32 each, a rule's number is the terminals' count plus its place), rules of each round (uint32), expansion
    lengths of the rules (uint32), the sum of expansions before every 1024th symbol (int64), the symbols' low 16 bits
    (uint16) and their higher bits (packed).
    """
    base = terminals = int(ids.max()) + 1 if len(ids) else 0
    seq, rules, per_round, sizes = ids.astype(np.int64), [], [], [np.ones(terminals, np.int64)]
    at, size = np.arange(max(0, len(seq) - 1)), sizes[0]
    while len(at):
        seq, pairs, at = _replace(seq, at, least, base)
        if len(pairs):
            rules.append(pairs)
            per_round.append(len(pairs))
            size = np.append(size, size[pairs[:, 0]] + size[pairs[:, 1]])
            base += len(pairs)
    reach = np.concatenate([[0], np.cumsum(size[seq])])[::_STEP] if len(seq) else np.zeros(1, np.int64)
    rule = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    high = max(0, (base - 1).bit_length() - 16) if base else 0
    top = np.packbits((seq[:, None] >> (16 + np.arange(high)) & 1).astype(np.uint8))
    null = np.array([d is None for d in doc_ids], np.uint8)
    head = struct.pack("<8q", len(doc_ids), len(ids), terminals, len(rule), len(per_round), len(seq), len(reach), high)
    parts = [np.array([d or 0 for d in doc_ids], "<i8"), first.astype("<i8"), null, rule.astype("<u4"), np.array(per_round, "<u4"), size[terminals:].astype("<u4"), reach.astype("<i8"), (seq & 0xFFFF).astype("<u2"), top]
    return _MAGIC + head + b"".join(p.tobytes() for p in parts)


class Shard:
    """Reads a shard; ``ids(a, b)`` expands only the symbols that hold those ids."""

    def __init__(self, data: bytes):
        if data[:4] != _MAGIC:
            raise ValueError("not a shard")
        docs, self.n, self.terminals, rules, rounds, symbols, reach, high = struct.unpack_from("<8q", data, 4)
        at = 68

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, self.first, null = take(docs, "<i8"), take(docs + 1, "<i8"), take(docs, "u1")
        self.doc_ids = [None if z else d for d, z in zip(ids.tolist(), null.tolist())]
        self.rules, self.rounds = take(2 * rules, "<u4").reshape(-1, 2).astype(np.int64), take(rounds, "<u4").astype(np.int64)
        self.size = np.concatenate([np.ones(self.terminals, np.int64), take(rules, "<u4")])
        self.reach, low = take(reach, "<i8"), take(symbols, "<u2").astype(np.int64)
        top = np.unpackbits(take(-(-symbols * high // 8), "u1"), count=symbols * high).reshape(symbols, high).astype(np.int64)
        self.symbols = low + (top << (16 + np.arange(high))).sum(axis=1)

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        while (made := seq >= self.terminals).any():
            n = 1 + made
            out = np.repeat(seq, n)
            end = np.cumsum(n)[made]
            pair = self.rules[seq[made] - self.terminals]
            out[end - 2], out[end - 1] = pair[:, 0], pair[:, 1]
            seq = out
        return seq

    def whole(self) -> np.ndarray:
        """All ids: each rule is expanded once."""
        rules = np.arange(self.terminals, self.terminals + len(self.rules))
        flat, n = np.concatenate([np.arange(self.terminals), self._expand(rules)]), self.size[self.symbols]
        start, end = np.cumsum(self.size) - self.size, np.cumsum(n)
        return flat[np.repeat(start[self.symbols] - (end - n), n) + np.arange(self.n)].astype(np.uint32)

    def ids(self, a: int, b: int) -> np.ndarray:
        """The ids from a up to b of the shard."""
        if a >= b:
            return np.zeros(0, np.uint32)
        lo = (int(np.searchsorted(self.reach, a, "right")) - 1) * _STEP
        hi = min(len(self.symbols), int(np.searchsorted(self.reach, b, "left")) * _STEP)
        before = int(self.reach[lo // _STEP])
        ends = before + np.cumsum(self.size[self.symbols[lo:hi]])
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b, "left")) + 1
        begin = before if i == 0 else int(ends[i - 1])
        return self._expand(self.symbols[lo + i : lo + j])[a - begin : b - begin].astype(np.uint32)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.first[k]), int(self.first[k + 1]))


def write(docs: DataFrame, tokenizer: str, end_id: int, shard_ids: int = 1 << 20) -> DataFrame:
    """Shards (part, shard, n_ids, payload) of the documents' ids in ascending order of doc_id, texts of one id in
    the order of their hashes, null ids first. A document is its text's ids and ``end_id``; a null text is empty. Documents are dealt by
    ranges of ids, which shuffles the texts once; a shard takes whole documents of one range until it has
    ``shard_ids``."""
    spark = docs.sparkSession
    ddl = "part int, shard int, n_ids long, payload binary"
    emit = T.emitter(ddl)

    def run(batches):
        encoder, part, shard = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0
        ids, sizes, names, held = [], [], [], 0

        def flush():
            return emit({"part": [part], "shard": [shard], "n_ids": [held], "payload": [compress(np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), names)]})

        for batch in T.slices(batches):
            x, at = with_end(*encoder.encode(*T.raw(batch.column("text"))), end_id)
            ids.append(x)
            sizes.append(np.diff(at))
            names += batch.column("doc_id").to_pylist()
            held += len(x)
            if held >= shard_ids:
                yield flush()
                ids, sizes, names, held, shard = [], [], [], 0, shard + 1
        if held:
            yield flush()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").withColumn("mixed", F.xxhash64("text"))
    # rows of one id (or none) spread over ranges by their texts' hashes
    ordered = ordered.repartitionByRange(parts, "doc_id", "mixed").sortWithinPartitions("doc_id", "mixed", "text").select("doc_id", "text")
    return ordered.mapInArrow(run, ddl)


def read(shards: DataFrame) -> DataFrame:
    """part, shard, doc_id, first (its place in the shard), n_tokens and ids_crc32 of every document in the files."""
    ddl = "part int, shard int, doc_id long, first long, n_tokens long, ids_crc32 long"
    emit = T.emitter(ddl)

    def run(batches):
        for batch in batches:
            for part, shard, data in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "payload"))):
                s = Shard(data)
                n, whole = np.diff(s.first), s.whole().astype("<u4")
                crc = [zlib.crc32(whole[a:b]) for a, b in zip(s.first[:-1], s.first[1:])]
                yield emit({"part": [part] * len(n), "shard": [shard] * len(n), "doc_id": s.doc_ids, "first": s.first[:-1], "n_tokens": n, "ids_crc32": crc})

    return shards.mapInArrow(run, ddl)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, shard_ids: int = 1 << 20) -> DataFrame:
    """Write shards to the shared folder, read them back, and return a row a document: doc_id, start (ids of all
    documents before it), n_tokens, ids_crc32. An empty table gives none; repeated ids keep a row each."""
    scratch = Scratch(docs.sparkSession, "repair")
    shards = scratch.save(write(docs, tokenizer, end_id, shard_ids), "shards")
    sizes = shards.select("part", "shard", "n_ids")
    up_to = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))  # a row a range
    before = parts.select("part", up_to(Window.orderBy("part")).alias("earlier"))
    base = sizes.join(F.broadcast(before), "part").select("part", "shard", (F.col("earlier") + up_to(Window.partitionBy("part").orderBy("shard"))).alias("base"))
    return read(shards).join(base, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
