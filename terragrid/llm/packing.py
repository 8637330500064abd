"""Mixture-controlled packing: deficit round-robin over source queues in closed form.

Tokens are dealt in quanta. Quantum r of a source with weight w falls due at (r + 1/2) / w, and quanta are laid out in
the order in which they fall due: the order of a round-robin whose rounds serve every source its share and carry what
is left of it (the deficit, under a quantum) on, across sequences and partitions. A source that runs dry leaves its
share to the others. How many quanta of each source fall due earlier is plain arithmetic, so any document finds its
places from how many tokens of its source stand before it; no task needs to see another's queue.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .common import Scratch
from .tokens import Encoder, with_end

_SCALE = 1 << 20


@dataclass(frozen=True)
class Layout:
    """Where each source's tokens go. weights, quanta (whole ones) and tail (the place of the first token past them)
    by source; full: sequences of ``length``; rest: the power-of-two sequences after them."""

    length: int
    quantum: int
    weights: dict
    quanta: dict
    tail: dict
    full: int
    rest: tuple[int, ...]


def lay_out(tokens: dict, weights: dict | None, length: int = 4096, quantum: int = 128) -> Layout:
    """Plan from each source's token count; without weights the target is each source's own share, so that all queues
    end together. Tokens past each source's last whole quantum are laid out last; the last sequence's tokens are cut
    into sequences of powers of two, so nothing is padded."""
    names = sorted(tokens, key=lambda s: (s is None, s or ""))
    share = weights if weights is not None else tokens
    if any(not share.get(s, 0) >= 0 for s in names):
        raise ValueError("weights must not be negative")
    scale = sum(share.get(s, 0) for s in names) or 1
    quanta = {s: tokens[s] // quantum for s in names}
    place, tail = sum(quanta.values()) * quantum, {}
    for s in names:
        tail[s] = place
        place += tokens[s] % quantum
    rest = place % length
    return Layout(length, quantum, {s: max(1, round(share.get(s, 0) * _SCALE / scale)) for s in names}, quanta, tail, place // length, tuple(1 << b for b in reversed(range(length.bit_length())) if rest >> b & 1))


def places(layout: Layout, source, first: int, n: int) -> list[tuple[int, int, int]]:
    """(start, length, place) of the pieces of ``n`` tokens of ``source`` with ``first`` tokens of it before them."""
    q, end, dealt = layout.quantum, first + n, layout.quanta[source] * layout.quantum
    out = []
    if first < min(end, dealt):
        r = np.arange(first // q, (min(end, dealt) - 1) // q + 1, dtype=np.int64)
        rank, g, earlier = r.copy(), layout.weights[source], True
        for name, w in layout.weights.items():
            if name == source:
                earlier = False
                continue
            # quanta k of this source with (2k + 1) / w before, or for an earlier source at, (2r + 1) / g
            due = (2 * r + 1) * w
            rank += np.minimum((due // g + 1) // 2 if earlier else -(-due // g) // 2, layout.quanta[name])
        s, t = np.maximum(r * q, first), np.minimum((r + 1) * q, min(end, dealt))
        place = rank * q + s - r * q
        new = np.flatnonzero(np.append(True, place[1:] != place[:-1] + (t - s)[:-1]))
        out += zip((s[new] - first).tolist(), (np.append(s[new][1:], t[-1]) - s[new]).tolist(), place[new].tolist())
    if end > dealt:
        s = max(first, dealt)
        out.append((s - first, end - s, layout.tail[source] + s - dealt))
    return out


def cut(layout: Layout, pieces: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence_id, offset): the pieces cut where sequences end."""
    size, out = layout.length, []
    for start, n, place in pieces:
        while n:
            sequence, offset = divmod(place, size)
            room = size - offset
            if sequence >= layout.full:
                sequence, offset = layout.full, place - layout.full * size
                for part in layout.rest:
                    if offset < part:
                        room = part - offset
                        break
                    sequence, offset = sequence + 1, offset - part
            k = min(n, room)
            out.append((start, k, sequence, offset))
            start, n, place = start + k, n - k, place + k
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, weights: dict | None = None, length: int = 4096, quantum: int = 128, with_ids: bool = False) -> DataFrame:
    """Pack every document of ``docs`` (doc_id, text, source) into sequences of ``length`` tokens (a power of two).

    Returns a row a piece: doc_id, start (ids of the document before it), length, ids_crc32 (of the ids as
    little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, source, and with ``with_ids`` the ids. A document
    is its ids and ``end_id``; null and empty texts are the end id alone. Every window holds the sources in the target
    proportions ``weights`` (default: their shares of all tokens), off by a quantum or so each. Rows of one id are
    documents of their own; a null source is a queue of its own. Documents are queued in file order, and their ids are
    written once to the shared folder, so tasks that run again read the same. The driver holds one number a source.
    """
    if length & (length - 1) or length % quantum:
        raise ValueError("length must be a power of two and hold whole quanta")
    scratch = Scratch(docs.sparkSession, "packing")
    ddl = "part int, source string, doc_id long, before long, n long, ids binary"
    emit = T.emitter(ddl)

    def tokenize(batches):
        encoder, part, had = Encoder.of(tokenizer), TaskContext.get().partitionId(), {}
        wide = np.dtype("<u4") if end_id >= 1 << 16 else encoder.dtype
        for batch in T.slices(batches):
            ids, at = with_end(*encoder.encode(*T.raw(batch.column("text"))), end_id)
            data, n, before = ids.astype(wide), np.diff(at).tolist(), []
            source = batch.column("source").to_pylist()
            for s, k in zip(source, n):
                before.append(had.get(s, 0))
                had[s] = before[-1] + k
            yield emit({"part": [part] * len(n), "source": source, "doc_id": batch.column("doc_id"), "before": before, "n": n, "ids": [data[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]})

    queued = scratch.save(docs.selectExpr("cast(doc_id as long) doc_id", "cast(source as string) source", "cast(text as string) text").mapInArrow(tokenize, ddl), "queued")
    by_part = scratch.save(queued.groupBy("part", "source").agg(F.sum("n").alias("n")), "parts")
    earlier = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = scratch.save(by_part.select(F.col("part").alias("_part"), F.col("source").alias("_source"), F.coalesce(earlier, F.lit(0)).alias("base")), "base")
    layout = lay_out({r.source: r.n for r in by_part.groupBy("source").agg(F.sum("n").alias("n")).collect()}, weights, length, quantum)
    # a row a task and source: Spark broadcasts the table by the size of its files, or sorts and merges
    rows = queued.join(base, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "source", (F.col("base") + F.col("before")).alias("first"), "n", "ids")
    out_ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", ids array<int>" * with_ids
    out = T.emitter(out_ddl)

    def deal(batches):
        for batch in T.slices(batches, "ids", 1 << 20, binary=True):
            columns = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids")}
            for doc_id, source, first, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "first", "n", "ids"))):
                ids = np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4")
                for start, k, sequence, offset in cut(layout, places(layout, source, first, n)):
                    for c, x in zip(columns, (doc_id, start, k, zlib.crc32(ids[start : start + k]), n, sequence, offset, source)):
                        columns[c].append(x)
                    if with_ids:
                        columns["ids"].append(ids[start : start + k].astype(np.int32))
            yield out(columns)

    return rows.mapInArrow(deal, out_ddl)
