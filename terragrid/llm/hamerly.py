"""k-means over whole-number vectors with Hamerly's bounds: one upper and one second-nearest lower bound a vector."""

from __future__ import annotations

import hashlib
import heapq
import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import Scratch

#: Components beyond this have squared distances that no long holds.
LARGEST = 1 << 27
#: Bounds are widened by more than their rounding errors.
_WIDEN = 2.0**-48


def whole(vectors: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have exactly ``dims`` components, all finite and within ``LARGEST`` once scaled; floor(scale * x) of these."""
    fit = pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False).to_numpy(zero_copy_only=False)
    x = vectors.filter(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(scale * x)
        good = (np.abs(x) <= LARGEST).all(axis=1)
    fit = fit.copy()
    fit[fit] = good
    return fit, x[good].astype(np.int64)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every vector to every centroid. Where all sums stay below 2 ** 53 doubles are exact."""
    most = max([1, *(int(np.abs(a).max()) for a in (x, centroids) if a.size)])
    if 4 * x.shape[1] * most * most < 1 << 53:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (of equally near ones the first), upper bound of its distance, lower bound of the second's."""
    d = squared(x, centroids)
    near = d.argmin(axis=1)
    rows = np.arange(len(x))
    upper = np.sqrt(d[rows, near].astype(np.float64)) * (1 + _WIDEN)
    if len(centroids) == 1:
        return near, upper, np.full(len(x), np.inf)
    d[rows, near] = np.iinfo(np.int64).max
    return near, upper, np.sqrt(d.min(axis=1).astype(np.float64)) * (1 - _WIDEN)


class Moves:
    """How far centroids moved and how far each is from the nearest other one, as bounds; from exact whole numbers."""

    def __init__(self, before: list[list[int]], after: list[list[int]]):
        gap = lambda a, b: math.sqrt(sum((p - q) ** 2 for p, q in zip(a, b)))
        self.drift = np.array([gap(a, b) * (1 + _WIDEN) for a, b in zip(before, after)])
        far = np.argsort(-self.drift, kind="stable")
        # a vector's lower bound falls by the largest drift of the other centroids
        self.others = np.full(len(after), self.drift[far[0]])
        self.others[far[0]] = self.drift[far[1]] if len(after) > 1 else 0.0
        self.half = np.array([min([gap(a, b) for j, b in enumerate(after) if j != i], default=math.inf) / 2 * (1 - _WIDEN) for i, a in enumerate(after)])


def advance(x: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, moves: Moves) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Assignment and bounds after the centroids moved, and how many vectors needed a full scan.

    Loosened bounds that still part the nearest centroid from all others settle a vector; else its exact distance
    tightens the upper bound; what remains, ties among it, is compared with every centroid.
    """
    near, upper, lower = near.copy(), (upper + moves.drift[near]) * (1 + _WIDEN), (lower - moves.others[near]) - np.abs(lower) * _WIDEN
    lower[np.isnan(lower)] = np.inf  # one centroid has no second
    safe = np.maximum(moves.half[near], lower)
    open_ = np.flatnonzero(upper >= safe)
    own = ((x[open_] - centroids[near[open_]]) ** 2).sum(axis=1)
    upper[open_] = np.sqrt(own.astype(np.float64)) * (1 + _WIDEN)
    open_ = open_[upper[open_] >= safe[open_]]
    if len(open_):
        near[open_], upper[open_], lower[open_] = scan(x[open_], centroids)
    return near, upper, lower, len(open_)


def _shifted(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, k: int) -> list[dict]:
    """What changed clusters gain or lose: number of vectors and sums of components."""
    moved = np.arange(len(new)) if old is None else np.flatnonzero(old != new)
    out = []
    for c in range(k):
        came, went = moved[new[moved] == c], moved[:0] if old is None else moved[old[moved] == c]
        if len(came) or len(went):
            out.append({"cluster": c, "parts": [len(came) - len(went), *(x[came].sum(axis=0) - x[went].sum(axis=0)).tolist()]})
    return out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, prefix: str = "2:", block: int = 4096) -> DataFrame:
    """Clusters of the vectors of ``vectors`` (vec_id, embedding).

    Returns vec_id, cluster, distance (squared, to the final centroid), cluster_inertia, inertia and centroid_sha256;
    a row for every row whose vector has exactly ``dims`` components, none null or not finite. Components are
    floor(scale * x); a vector with one beyond ``LARGEST`` counts as not finite, since its distances would pass a
    long. The first centroids are the ``k`` vectors of the least sha256 of prefix and vec_id (a null id is an empty
    text; equal ids go by components); fewer vectors make fewer centroids. Repeated rows count each; an empty table
    gives an empty one. Inertia past a long is an error.

    Vectors are packed into blocks without a shuffle, dealt once to buckets by block, and stay there. Each round
    writes assignments and bounds by block, reads them beside the vectors, and tells the driver only what clusters
    gained or lost (k rows of sums). A table of each round is written to the shared folder.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hamerly")
    block_ddl, state_ddl = "block long, ids array<long>, x binary", "block long, near binary, upper binary, lower binary, scanned int, moved array<struct<cluster:int,parts:array<long>>>"
    emit_block, emit_state, emit_first = T.emitter(block_ddl), T.emitter(state_ddl), T.emitter("digest string, x array<int>")
    emit_sum, emit_row = T.emitter("cluster int, parts array<long>"), T.emitter("vec_id long, cluster int, distance long")

    def pack(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                some = batch.slice(at, block)
                fit, x = whole(some.column("embedding"), dims, scale)
                if len(x):
                    yield emit_block({"block": [part << 32 | number], "ids": [some.column("vec_id").filter(pa.array(fit)).to_pylist()], "x": [x.astype(np.int32).tobytes()]})
                    number += 1

    def opened(batch: pa.RecordBatch):
        """Block, ids, vectors and the other columns of each row."""
        for row in batch.to_pylist():
            yield row.pop("block"), row.pop("ids", None), np.frombuffer(row.pop("x"), np.int32).reshape(-1, dims).astype(np.int64), row

    def bounds(row: dict):
        return np.frombuffer(row["near"], np.int32).astype(np.int64), np.frombuffer(row["upper"], np.float64), np.frombuffer(row["lower"], np.float64)

    def firsts(batches):
        for batch in batches:
            for _, ids, x, _ in opened(batch):
                digest = [hashlib.sha256(f"{prefix}{'' if i is None else i}".encode()).hexdigest() for i in ids]
                least = heapq.nsmallest(k, range(len(ids)), key=lambda i: (digest[i], x[i].tolist()))
                yield emit_first({"digest": [digest[i] for i in least], "x": [x[i].tolist() for i in least]})

    def assign(centroids, moves):
        def run(batches):
            c = np.array(centroids, np.int64)
            for batch in batches:
                for number, _, x, row in opened(batch):
                    if moves is None:
                        old, scanned = None, len(x)
                        near, upper, lower = scan(x, c)
                    else:
                        old, upper, lower = bounds(row)
                        near, upper, lower, scanned = advance(x, old, upper, lower, c, moves)
                    yield emit_state({"block": [number], "near": [near.astype(np.int32).tobytes()], "upper": [upper.tobytes()], "lower": [lower.tobytes()], "scanned": [scanned], "moved": [_shifted(x, old, near, len(c))]})

        return run

    def add_up(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for moved in batch.column("moved").to_pylist():
                for m in moved:
                    total[m["cluster"]] = total.get(m["cluster"], 0) + np.array(m["parts"], np.int64)
        yield emit_sum({"cluster": list(total), "parts": [v.tolist() for v in total.values()]})

    def measure(centroids):
        def run(batches):
            c = np.array(centroids, np.int64)
            for batch in batches:
                for _, ids, x, row in opened(batch):
                    near = bounds(row)[0]
                    yield emit_row({"vec_id": ids, "cluster": near, "distance": ((x - c[near]) ** 2).sum(axis=1)})

        return run

    name, buckets = f"hamerly_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = vectors.selectExpr("cast(vec_id as long) vec_id", "cast(embedding as array<double>) embedding").mapInArrow(pack, block_ddl)
    packed.repartition(buckets, "block").write.bucketBy(buckets, "block").option("path", f"{scratch.base}/blocks").option("compression", "zstd").saveAsTable(name)
    try:
        blocks = spark.table(name)
        first = blocks.mapInArrow(firsts, "digest string, x array<int>").orderBy("digest", "x").limit(k).collect()
        centroids = [list(r.x) for r in first]
        state, moves, sums, counts = None, None, [[0] * dims for _ in centroids], [0] * len(centroids)
        for n in range(rounds + 1 if centroids else 0):
            both = blocks.select("block", "x") if state is None else blocks.select("block", "x").join(state.drop("moved", "scanned"), "block")
            state = scratch.save(both.mapInArrow(assign(centroids, moves), state_ddl), f"round{n}")
            scratch.drop(f"round{n - 1}") if n else None
            if n == rounds:
                break
            parts = state.select("moved").mapInArrow(add_up, "cluster int, parts array<long>").select("cluster", F.posexplode("parts").alias("at", "v"))
            for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():  # k rows of dims + 1 sums
                if r["at"] == 0:
                    counts[r["cluster"]] += int(r.v)
                else:
                    sums[r["cluster"]][r["at"] - 1] += int(r.v)
            before, centroids = centroids, [[s // m for s in row] if m else c for row, m, c in zip(sums, counts, centroids)]
            moves = Moves(before, centroids)
        if state is None:
            return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
        rows = scratch.save(blocks.join(state.select("block", "near", "upper", "lower"), "block").mapInArrow(measure(centroids), "vec_id long, cluster int, distance long"), "rows")
    finally:
        spark.sql(f"drop table if exists {name}")
        scratch.drop("blocks")
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    inertia = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row a cluster
    of = {r["cluster"]: r.cluster_inertia for r in inertia}
    table = spark.createDataFrame([(i, of[i], sum(of.values()), d) for i, d in digests if i in of], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(embeddings: str, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, prefix: str = "2:") -> str:
    """DuckDB SQL for the same rows: every vector against every centroid in every round."""
    parts = [f"""hv as materialized (
  select row_number() over (order by vec_id) rid, vec_id, list_transform(embedding, lambda c: floor({scale} * c::double)::bigint) x from {embeddings}
  where len(embedding) = {dims} and len(list_filter(embedding, lambda c: c is not null and isfinite(c))) = {dims}),
c0 as materialized (select (row_number() over (order by sha256('{prefix}' || vec_id), x))::int - 1 cluster, x c from hv qualify cluster < {k})"""]
    for n in range(rounds + 1):
        parts.append(f"""a{n} as materialized (
  select rid, vec_id, x, unnest(first) from (
    select rid, any_value(vec_id) vec_id, any_value(x) x, min({{'distance': d, 'cluster': cluster}}) first from (
      select rid, vec_id, x, cluster, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint d from hv cross join c{n}) group by rid))""")
        if n < rounds:
            parts.append(f"""m{n} as (
  select cluster, list((s - ((s % m) + m) % m) // m order by i) c from (
    select cluster, i, sum(x[i]) s, count(*)::hugeint m from a{n} cross join (select unnest(range(1, {dims + 1})) i) group by all) group by cluster),
c{n + 1} as materialized (select cluster, coalesce(m.c, o.c)::bigint[] c from c{n} o left join m{n} m using (cluster))""")
    return "with " + ",\n".join(parts) + f"""
select vec_id, cluster, distance, (sum(distance) over (partition by cluster))::bigint cluster_inertia, (sum(distance) over ())::bigint inertia,
  sha256(array_to_string(c, ',')) centroid_sha256
from a{rounds} join c{rounds} using (cluster)"""
