"""Clustering, whitening and sharding against plain versions, SQL, closed forms and odd input."""

import collections
import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terragrid.llm import hamerly, queries, sharding, whitening
from tests.conftest import SF

NAN, INF = float("nan"), float("inf")


def vectors(spark, rows, columns="cluster int, component string, label int"):
    """vec_id and embedding beside columns that clash with results."""
    return spark.createDataFrame([(*r, 7, "x", 1) for r in rows], f"vec_id long, embedding array<double>, {columns}")


def plain_kmeans(rows, k, rounds, dims, scale=256):
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in order[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda: [min((far(x, c), j) for j, c in enumerate(centroids)) for _, x in kept]
    for _ in range(rounds):
        got = near()
        for j in range(len(centroids)):
            own = [x for (_, x), (_, c) in zip(kept, got) if c == j]
            if own:
                centroids[j] = [sum(col) // len(own) for col in zip(*own)]
    return sorted(((i, j, d, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, near())), key=str)


def test_clusters_equal_sql(spark):
    got = queries.op11_hamerly(spark, SF)
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = db.sql(f"select {', '.join(got.columns)} from ({queries.ORACLES['op11_hamerly']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_clusters_with_odd_rows_equal_a_plain_version(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(t) for t in rng.integers(-3, 4, 4) / 4]) for i in range(400)]  # many ties and equal vectors
    rows += [(None, [1.0, 2.0, 3.0, 4.0]), (5, rows[5][1]), (5, [0.5, 0.5, 0.5, 0.25]), (500, None), (501, []), (502, [1.0, 2.0, 3.0]), (503, [1.0, None, 2.0, 3.0]), (504, [NAN, 0.0, 0.0, 0.0]), (505, [INF, 0.0, 0.0, 0.0]), (506, [1.0] * 5)]
    got = hamerly.cluster(vectors(spark, rows), k=7, rounds=5, dims=4, block=64)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    got = got.collect()
    assert sorted(((r.vec_id, r["cluster"], r.distance, r.centroid_sha256) for r in got), key=str) == plain_kmeans(rows, 7, 5, 4)
    by = collections.Counter()
    for r in got:
        by[r["cluster"]] += r.distance
    assert all(r.cluster_inertia == by[r["cluster"]] and r.inertia == sum(by.values()) for r in got)


def test_few_or_no_vectors(spark):
    rows = [(1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [-2.0, 0.5])]
    for k in (1, 2, 3, 9):
        got = hamerly.cluster(vectors(spark, rows), k=k, rounds=3, dims=2).collect()
        assert sorted(((r.vec_id, r["cluster"], r.distance, r.centroid_sha256) for r in got), key=str) == plain_kmeans(rows, k, 3, 2)
    assert hamerly.cluster(vectors(spark, rows), dims=3).count() == 0
    assert hamerly.cluster(vectors(spark, []), dims=2).count() == 0
    huge = hamerly.cluster(vectors(spark, [*rows, (4, [1e300, 0.0])]), k=2, rounds=2, dims=2)
    assert {r.vec_id for r in huge.collect()} == {1, 2, 3}


def test_bounds_skip_scans_and_stay_exact():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 20, (500, 8)) for c in (-900, 0, 900)]).astype(np.int64)
    c = [[int(t) for t in x[i]] for i in (0, 600, 700, 1200)]
    near, upper, lower = hamerly.scan(x, np.array(c))
    scans = []
    for _ in range(5):
        after = [[int(t) for t in x[near == j].sum(0) // max(1, (near == j).sum())] for j in range(4)]
        near, upper, lower, n = hamerly.advance(x, near, upper, lower, np.array(after), hamerly.Moves(c, after))
        scans.append(n)
        d = hamerly.squared(x, np.array(after))
        assert (near == d.argmin(1)).all() and (upper**2 >= d.min(1)).all() and (lower**2 <= np.sort(d, 1)[:, 1]).all()
        c = after
    assert scans[0] < len(x) / 2  # the outer groups are settled by their bounds
    big = np.array([[hamerly.LARGEST] * 64, [-hamerly.LARGEST] * 64])
    assert hamerly.squared(big, big[:1]).ravel().tolist() == [0, 64 * (2 * hamerly.LARGEST) ** 2]


def plain_whitening(x, k):
    """By the covariance of whole-number vectors: components up to sign, deviations, shares."""
    n, s = len(x), x.sum(0)
    centred = (x * n - s) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return centred @ v / np.sqrt(e), [sum(int(t) ** 2 for t in row) for row in x * n - s], e / np.trace(centred.T @ centred / n)


def test_whitening_equals_an_eigendecomposition(spark):
    got = queries.op12_whitening(spark, SF).toPandas().sort_values(["component", "vec_id"])
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").toPandas()
    w, deviation, explained = plain_whitening(np.floor(1024 * np.stack(table.embedding).astype(np.float64)).astype(np.int64) + 100000, 8)
    for c in range(8):
        own = got[got.component == c + 1]
        assert own.vec_id.tolist() == table.vec_id.tolist() and own.deviation.tolist() == deviation
        a = own.whitened.to_numpy()
        assert min(np.abs(a - w[:, c]).max(), np.abs(a + w[:, c]).max()) < 1e-7
        assert np.allclose(own.explained, explained[c], rtol=1e-9)
    assert got.identity_error.max() < 1e-9 and (got.n == len(table)).all()


def test_merging_loses_nothing():
    rng = np.random.default_rng(1)
    x = (rng.normal(0, 900, (3000, 12)) @ rng.normal(0, 1, (12, 12))).astype(np.int64) + 100000
    x[:, 7] = 100000  # a dimension without variance stays too
    parts = [whitening.Summary.of(p) for p in np.split(x, [1, 2, 5, 700, 1900])]
    while len(parts) > 1:
        parts = [parts[0].merge(parts[1]), *parts[2:]][::-1]
    centred = (x * len(x) - x.sum(0)) / len(x)
    whole = parts[0]
    assert whole.n == 3000 and whole.sums == x.sum(0).tolist() and len(whole.s) == 12
    gram = centred.T @ centred
    assert np.abs((whole.v.T * whole.s**2) @ whole.v - gram).max() < 1e-9 * np.abs(gram).max()


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i if i else None, rng.normal(0, 1, 3).tolist()) for i in range(60)]
    good.append(good[3])
    odd = [(100, None), (101, [1.0, None, 0.0]), (102, [NAN, 0.0, 0.0]), (103, [0.0, 0.0, -INF]), (104, [1e300, 0.0, 0.0]), (105, [])]
    other = [(200, [1.0, 2.0]), (201, [1.0, 4.0]), (202, [1.0, 5.0])]  # of one varying dimension
    got = whitening.whiten(vectors(spark, good + odd + other + [(300, [1.0])]).repartition(7)).collect()
    assert collections.Counter(r.vec_id for r in got) == collections.Counter({**{i: 3 for i, _ in good}, 3: 6, 200: 1, 201: 1, 202: 1})
    w, deviation, _ = plain_whitening(np.floor(1024 * np.array([v for _, v in good])).astype(np.int64) + 100000, 3)
    of = {(r.vec_id, r.component): r for r in got}
    for (i, _), row, d in zip(good, w, deviation):
        assert [of[i, c + 1].deviation for c in range(3)] == [d] * 3
        assert np.allclose([abs(of[i, c + 1].whitened) for c in range(3)], np.abs(row))
    assert {r.n for r in got} == {61, 3} and max(r.identity_error for r in got) < 1e-9
    assert whitening.whiten(vectors(spark, [])).count() == 0 and whitening.whiten(vectors(spark, [(1, [1.0, 2.0])] * 3)).count() == 0


def test_deviation_past_a_long():
    x = np.array([[100000 + 40000, 100000], [100000 - 40000, 100000], [100000, 100000]])
    model = whitening.Model(whitening.Summary.of(x), 2)
    assert model.deviation(x) == [(3 * 40000) ** 2, (3 * 40000) ** 2, 0] and len(model.e) == 1
    model.n, model.sums, model.rest = 10**8, [s * 10**8 // 3 for s in model.sums], np.zeros(2, np.int64)
    assert model.deviation(x) == [None, None, 0]


def exact_hypergeometric(total, good, drawn):
    return {k: math.comb(good, k) * math.comb(total - good, drawn - k) / math.comb(total, drawn) for k in range(max(0, drawn - total + good), min(good, drawn) + 1)}


def test_hypergeometric_inverts_the_distribution(spark):
    for total, good, drawn in ((10, 4, 5), (50, 3, 40), (7, 7, 3), (7, 0, 3), (1, 1, 1), (300, 120, 150)):
        n = 2000
        u = (F.col("id") + 0.5) / n
        got = spark.range(n).select(sharding.hypergeometric(F.lit(total), F.lit(good), F.lit(drawn), u).alias("k")).groupBy("k").count().collect()
        want = exact_hypergeometric(total, good, drawn)
        have = {r.k: r["count"] / n for r in got}
        assert set(have) <= set(want) and all(abs(have.get(k, 0) - p) < 2 / n + 1e-9 for k, p in want.items())
    far = spark.range(200).select(sharding.hypergeometric(F.lit(10**8), F.lit(10**7), F.lit(5 * 10**7), (F.col("id") + 0.5) / 200).alias("k"))
    mean, std = far.agg(F.avg("k"), F.stddev("k")).head()
    assert abs(mean - 5e6) < 2 and abs(std / math.sqrt(5e7 * 0.1 * 0.9 * 0.5) - 1) < 0.02


def test_matrix_keeps_both_margins(spark):
    n = [0, 5, 1, 300, 40, 0, 7]
    counts = spark.createDataFrame(list(enumerate(n)), "part long, n long")
    sizes = [sum(n) // 5 + (s < sum(n) % 5) for s in range(5)]
    cells = collections.Counter()
    for seed in range(8):
        got = {r.part: r.quota for r in sharding.matrix(counts, sizes, seed).collect()}
        assert [sum(got[i]) for i in range(len(n))] == n and [sum(q[s] for q in got.values()) for s in range(5)] == sizes
        cells[got[2].index(1)] += 1
        assert min(map(min, got.values())) >= 0
    assert len(cells) > 2  # the lone row goes anywhere
    assert [r.quota for r in sharding.matrix(counts.where("part = 4"), [20, 20], 1).collect()] == [[20, 20]]


@pytest.mark.parametrize("rows", [1 << 20, 40])
def test_shards_are_exact_and_shuffled(spark, rows):
    docs = spark.range(1003).repartition(5).select(F.when(F.col("id") > 2, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.lit(None)).alias("text"), F.lit("x").alias("slot"), F.lit(1).alias("key"), F.lit(2).alias("part"))
    got = sharding.shard(docs, shards=16, rows=rows).collect()
    assert got[0].__fields__ == ["doc_id", "text", "key", "part", "shard", "slot"]
    assert collections.Counter(r.doc_id for r in got) == collections.Counter([None] * 3 + list(range(3, 1003)))
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert sorted(by) == list(range(16)) and {len(v) for v in by.values()} == {62, 63}
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    # neighbours by id lie in unrelated shards and slots
    at = {r.doc_id: (r.shard, r.slot) for r in got if r.doc_id}
    assert abs(sum(at[i][0] == at[i + 1][0] for i in range(3, 1002)) / 999 - 1 / 16) < 0.035
    assert abs(np.corrcoef([at[i][1] for i in range(3, 1003)], range(3, 1003))[0, 1]) < 0.12
    assert abs(np.corrcoef([at[i][0] for i in range(3, 1003)], range(3, 1003))[0, 1]) < 0.12


def test_places_are_uniform(spark):
    """Over many seeds each of a few rows is as often at each place."""
    places = collections.Counter()
    docs = spark.range(6).coalesce(2)
    for seed in range(12):
        places.update((r.id, r.shard, r.slot) for r in sharding.shard(docs, shards=2, seed=seed).collect())
    assert sum((places[i, s, p] - 2) ** 2 / 2 for i in range(6) for s in range(2) for p in range(3)) < 60  # 25 degrees of freedom


def test_shards_of_few_rows_and_digests(spark):
    assert sharding.shard(spark.range(0)).count() == 0
    few = sharding.shard(spark.range(3), shards=16).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]
    with pytest.raises(ValueError):
        sharding.shard(spark.range(3), shards=0)
    got = queries.op13_sharding(spark, SF)
    db = duckdb.connect()
    want = db.sql(f"select doc_id, strlen(coalesce(text, '')) + 1 from '{SF}/documents.parquet'").fetchall()
    assert sorted(map(tuple, got.select("doc_id", "size").collect())) == sorted(want)
    assert "Python" not in got._jdf.queryExecution().toString()
