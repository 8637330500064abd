"""Whitening of embeddings by singular value decompositions merged up a tree, without loss."""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import Scratch

#: Entries beyond this, once scaled, count as not finite.
LARGEST = 1 << 40
_SUMMARY = "dims int, at long, n long, sums array<decimal(38,0)>, s array<double>, v binary"
_LONG = (1 << 63) - 1


def whole(vectors: pa.Array, scale: int, shift: int):
    """For each length of vector: the rows that hold it without null or infinite entries, and their floor(scale * c) + shift."""
    length = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    for d in np.unique(length[length > 0]):
        at = np.flatnonzero(length == d)
        c = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        with np.errstate(invalid="ignore", over="ignore"):
            x = np.floor(scale * c)
            good = (np.abs(x) <= LARGEST).all(axis=1)
        yield int(d), at[good], x[good].astype(np.int64) + shift


class Summary:
    """Number, exact sums, and all singular values and right vectors of some centred vectors."""

    def __init__(self, n: int, sums: list[int], s: np.ndarray, v: np.ndarray):
        self.n, self.sums, self.s, self.v = n, sums, s, v

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        """Of at most a few thousand vectors, centred in whole numbers."""
        n, sums = len(x), x.sum(axis=0)
        _, s, v = np.linalg.svd((x * n - sums) / n, full_matrices=False)
        return cls(n, [int(t) for t in sums], s, v)

    def merge(self, other: Summary) -> Summary:
        """Of both together: their scaled vectors and one row for the distance of the means, decomposed again."""
        n = self.n + other.n
        apart = np.array([a * other.n - b * self.n for a, b in zip(self.sums, other.sums)], object)
        row = np.array([float(t) for t in apart]) / math.sqrt(self.n) / math.sqrt(other.n) / math.sqrt(n)
        _, s, v = np.linalg.svd(np.vstack([self.s[:, None] * self.v, other.s[:, None] * other.v, row]), full_matrices=False)
        return Summary(n, [a + b for a, b in zip(self.sums, other.sums)], s, v)

    def row(self, at: int) -> dict:
        return {"dims": [len(self.sums)], "at": [at], "n": [self.n], "sums": [[Decimal(t) for t in self.sums]], "s": [self.s.tolist()], "v": [self.v.tobytes()]}

    @classmethod
    def read(cls, r: dict) -> Summary:
        return cls(r["n"], [int(t) for t in r["sums"]], np.array(r["s"]), np.frombuffer(r["v"]).reshape(-1, r["dims"]))


def fit(vectors: DataFrame, scale: int = 1024, shift: int = 100_000, fan: int = 16, rows: int = 2048) -> dict[int, Summary]:
    """The summary of all vectors of each length in ``vectors`` (embedding).

    Each task decomposes ``rows`` vectors at a time and merges them into one summary a length, of at most dims rows.
    Summaries of ``fan`` tasks merge in one task, and so on up; the driver gets one a length.
    """
    scratch, emit = Scratch(vectors.sparkSession, "whitening"), T.emitter(_SUMMARY)

    def summarise(batches):
        held: dict[int, Summary] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                for d, _, x in whole(batch.slice(at, rows).column("embedding"), scale, shift):
                    if len(x):
                        own = Summary.of(x)
                        held[d] = held[d].merge(own) if d in held else own
        for own in held.values():
            yield emit(own.row(TaskContext.get().partitionId()))

    def together(table: pa.Table) -> pa.Table:
        parts = [Summary.read(r) for r in sorted(table.to_pylist(), key=lambda r: r["at"])]
        out = parts[0]
        for p in parts[1:]:
            out = out.merge(p)
        return pa.Table.from_batches([emit(out.row(table.column("up")[0].as_py()))])

    level = scratch.save(vectors.selectExpr("cast(embedding as array<double>) embedding").mapInArrow(summarise, _SUMMARY), "tasks")
    most = level.agg(F.max("at")).head()[0] or 0
    while most:
        most //= fan
        level = level.withColumn("up", F.expr(f"at div {fan}")).groupBy("dims", "up").applyInArrow(together, _SUMMARY)
    return {r["dims"]: Summary.read(r.asDict()) for r in level.collect()}  # a row a length


class Model:
    """Mean, leading components and eigenvalues of a summary's covariance (divisor n)."""

    def __init__(self, fitted: Summary, components: int):
        self.n, self.sums = fitted.n, fitted.sums
        e = fitted.s**2 / fitted.n
        # no variance, no whitening: values beside rounding errors of the first are none
        k = min(components, int((e > (e[0] if len(e) else 0.0) * 1e-18).sum()))
        sign = np.sign(fitted.v[np.arange(k), np.abs(fitted.v[:k]).argmax(axis=1)])
        self.v, self.e, self.explained = fitted.v[:k] * sign[:, None], e[:k], e[:k] / e.sum() if k else e[:0]
        self.base = np.array([t // self.n for t in self.sums], np.int64)
        self.rest = np.array([t % self.n for t in self.sums], np.int64)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.base) - self.rest / self.n) @ self.v.T / np.sqrt(self.e)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over the dimensions of (n x - S) ** 2; None past a long."""
        y = x - self.base
        near = ((y * float(self.n) - self.rest) ** 2).sum(axis=1)
        out: list[int | None] = [None] * len(x)
        for i in np.flatnonzero(near < 9.3e18):
            out[i] = sum((int(a) * self.n - int(b)) ** 2 for a, b in zip(y[i], self.rest)) if near[i] > 9.2e18 else int(((y[i] * self.n - self.rest) ** 2).sum())
            out[i] = out[i] if out[i] <= _LONG else None
        return out


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """Whitened leading components of every vector of ``vectors`` (vec_id, embedding).

    Returns vec_id, component (from 1), n, deviation, whitened, explained and identity_error, ``components`` rows a
    row of ``vectors``, repeated rows and null ids included. Rows whose vector is null or has null, NaN or infinite
    entries (or one beyond ``LARGEST`` once scaled) go; so do empty vectors. Vectors of different lengths are
    different spaces: each length is fitted by itself, with an n and an identity_error of its own. Components without
    variance (all of them if vectors are equal) are left out, so a lone vector gives no row. ``deviation`` is NULL
    where no long holds it. An empty table gives an empty one.
    """
    models = {d: Model(s, components) for d, s in fit(vectors, scale, shift).items()}
    vectors = vectors.selectExpr("cast(vec_id as long) vec_id", "cast(embedding as array<double>) embedding")
    emit_sum = T.emitter("dims int, i int, j int, v double")
    ddl = "vec_id long, component int, n long, deviation long, whitened double, explained double, dims int"
    emit = T.emitter(ddl)

    def products(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in whole(batch.column("embedding"), scale, shift):
                w = models[d].whiten(x)
                w = np.hstack([np.ones((len(w), 1)), w])
                total[d] = total.get(d, 0.0) + w.T @ w
        for d, t in total.items():
            i, j = np.indices(t.shape)
            yield emit_sum({"dims": np.full(t.size, d), "i": i.ravel(), "j": j.ravel(), "v": t.ravel()})

    def project(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                for d, rows, x in whole(some.column("embedding"), scale, shift):
                    m, n = models[d], len(x)
                    k = len(m.e)
                    ids = some.column("vec_id").take(pa.array(np.repeat(rows, k)))
                    yield emit({"vec_id": ids, "component": np.tile(np.arange(1, k + 1), n), "n": np.full(n * k, m.n), "deviation": [t for t in m.deviation(x) for _ in range(k)], "whitened": m.whiten(x).ravel(), "explained": np.tile(m.explained, n), "dims": np.full(n * k, d)})

    moments = vectors.mapInArrow(products, "dims int, i int, j int, v double").groupBy("dims", "i", "j").agg(F.sum("v").alias("v")).collect()  # (components + 1) squared a length
    errors = []
    for d, m in models.items():
        t = np.zeros((len(m.e) + 1,) * 2)
        for r in moments:
            if r.dims == d:
                t[r.i, r.j] = r.v / m.n
        if len(m.e):
            errors.append((d, float(np.abs(t[1:, 1:] - np.outer(t[0, 1:], t[0, 1:]) - np.eye(len(m.e))).max())))
    known = vectors.sparkSession.createDataFrame(errors, "dims int, identity_error double")
    return vectors.mapInArrow(project, ddl).join(F.broadcast(known), "dims").drop("dims")
