"""SimHash near-deduplication: pigeonring candidates, exact Hamming links, connected components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import Scratch

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprint(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fingerprint (the 64 bits as a signed long) of every whole text of ``docs`` (doc_id, text).

    A-Z are lower-cased. The bits are the majority, by more than half, over the XXH64 of all word shingles, repeats
    included; texts with fewer words have one shingle of them all; a text without words (or null) gets zero.
    """
    emit = T.emitter("doc_id long, fingerprint long")

    def run(batches):
        for part in T.slices(batches):
            buf, at = T.raw(part.column("text"))
            words = T.Words(_LOWER[buf], at)
            n = np.diff(words.doc)
            doc = T.doc_of(words.doc)
            # words joined by one space each; word i begins at its offset plus i
            joined = np.full(len(words.data) + len(words), 0x20, np.uint8)
            joined[np.arange(len(words.data)) + T.doc_of(words.at)] = words.data
            first = np.arange(len(words))[(np.arange(len(words)) - words.doc[doc] == 0) | (np.arange(len(words)) + shingle <= words.doc[doc + 1])] if len(words) else np.zeros(0, np.int64)
            last = np.minimum(first + shingle, words.doc[doc[first] + 1])
            b, h64 = joined.tobytes(), xxhash.xxh64_intdigest
            h = np.fromiter((h64(b[s:e], seed) for s, e in zip((words.at[first] + first).tolist(), (words.at[last] + last - 1).tolist())), np.uint64, len(first))
            out = np.zeros(len(n), np.uint64)
            some = np.flatnonzero(n)
            if len(some):
                starts = np.append(np.searchsorted(doc[first], some), len(first))
                for lo in range(0, len(some), 256):
                    s = starts[lo : lo + 257]
                    bits = np.unpackbits(h[s[0] : s[-1]].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    ones = np.add.reduceat(bits, s[:-1] - s[0], axis=0, dtype=np.int64)
                    most = (2 * ones > np.diff(s)[:, None]).astype(np.uint8)
                    out[some[lo : lo + 256]] = np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()
            yield emit({"doc_id": part.column("doc_id"), "fingerprint": out.view(np.int64)})

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, fingerprint long")


def _segment(fp, i: int, width: int) -> F.Column:
    return F.shiftrightunsigned(fp, i * width).bitwiseAND((1 << width) - 1)


def chain(a, b, budget: int, segments: int) -> F.Column:
    """Pigeonring filter: from some segment on, the differences of any 1, 2, ... consecutive segments (the ring closes)
    add up to no more than their share of the budget. Every pair within the budget passes."""
    width = 64 // segments
    diff = [F.bit_count(_segment(a.bitwiseXOR(b), i, width)) for i in range(segments)]
    starts = []
    for i in range(segments):
        total, ok = F.lit(0), F.lit(True)
        for n in range(1, segments + 1):
            total = total + diff[(i + n - 1) % segments]
            ok = ok & (total <= n * budget // segments)
        starts.append(ok)
    out = starts[0]
    for s in starts[1:]:
        out = out | s
    return out


def links(prints: DataFrame, budget: int = 2, segments: int = 4, hot: int = 64) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp) of at most ``budget`` (2 or less) differing bits that
    connect just what all such links connect.

    A chain of segments within its share of a budget of 2 in 4 segments starts with an equal segment, and one of the
    next two is equal too: so pairs that share two of the four segments are candidates, the chain prunes them, and the
    whole Hamming distance decides. Buckets of more than ``hot`` fingerprints make no pairs: there every fingerprint
    names the 33 patterns within one differing bit outside the shared segments; two fingerprints within 2 bits share a
    pattern, and those that share one are within 2 bits, so each pattern's fingerprints (33 at most) link to the least.
    """
    if budget > 2 or segments != 4:
        raise ValueError("keys are made for at most 2 bits in 4 segments")
    width = 64 // segments
    pairs = list(combinations(range(segments), 2))
    masks = [sum(((1 << width) - 1) << (s * width) for s in p) for p in pairs]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for k, m in enumerate(masks)])
    keyed = prints.select("fp", F.explode(keys).alias("s")).select("fp", "s.k", "s.key")
    sizes = keyed.groupBy("k", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    keyed = keyed.join(sizes, ["k", "key"])
    few, many = keyed.where(F.col("size") <= hot), keyed.where(F.col("size") > hot)
    a, b = few.select("k", "key", F.col("fp").alias("u")), few.select("k", "key", F.col("fp").alias("v"))
    u, v = F.col("u"), F.col("v")
    near = a.join(b, ["k", "key"]).where((u > v) & chain(u, v, budget, segments) & (F.bit_count(u.bitwiseXOR(v)) <= budget)).select("u", "v")
    flips = F.array(*[F.array(F.lit(0), *[F.lit(signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in masks])
    around = many.select("k", "key", "fp", F.explode(flips[F.col("k")]).alias("flip")).select("k", "key", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("pattern"))
    if budget < 2:  # a fingerprint one bit away is itself one of the patterns
        other = many.select("k", "key", F.col("fp").alias("v"), F.col("fp").alias("pattern"))
        one = around.join(other, ["k", "key", "pattern"]).where((F.col("fp") > F.col("v")) & F.lit(budget == 1)).select(F.col("fp").alias("u"), "v")
        return near.union(one).distinct()
    stars = around.groupBy("k", "key", "pattern").agg(F.min("fp").alias("v"), F.collect_list("fp").alias("us")).select(F.explode("us").alias("u"), "v").where("u <> v")
    return near.union(stars).distinct()


def components(edges: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """node, root: the least node that each node of ``edges`` (u, v) reaches, by large-star and small-star rounds.

    A round sends each node's neighbours the least of them; edges never grow in number. Every round is written to the
    shared folder, so its lineage is one scan.
    """

    def least(e: DataFrame) -> DataFrame:
        return e.join(e.groupBy("u").agg(F.min("v").alias("m")), "u")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())

    now = scratch.save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges0")
    seen = mark(now)
    for i in range(1, most + 1):
        now = now.coalesce(1 + seen[0] // 500_000)  # few edges take few tasks, in whatever number of files they lie
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both).withColumn("m", F.least("u", "m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = least(large)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.save(small, f"edges{i}")
        scratch.drop(f"edges{i - 1}")
        now, was, seen = after, seen, mark(after)
        if seen == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components didn't settle in {most} rounds")


def group(docs: DataFrame, shingle: int = 3, budget: int = 2, seed: int = 42, hot: int = 64) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs`` (doc_id, text).

    Fingerprints link at ``budget`` or fewer differing bits; component_id is the least doc_id reachable over links,
    itself included. Equal fingerprints count once, so copies make no pairs. Rows stay one to one; texts without words
    share the fingerprint zero and link like any others; null ids never are a component's id unless it has no other.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprint(docs, shingle, seed), "prints")
    classes = scratch.save(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")).withColumnRenamed("fingerprint", "fp"), "classes")
    roots = components(links(classes.select("fp"), budget, hot=hot), scratch)
    of = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = of.join(of.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    out = prints.join(ids, prints.fingerprint == ids.fp)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def _shingles(words: T.Words, h: np.ndarray, shingle: int):
    """The sorted hashes of each text's distinct word shingles (of all words where there are fewer; none without words)."""
    for lo, hi in zip(words.doc[:-1], words.doc[1:]):
        yield np.unique(T.rolling(h[lo:hi], min(shingle, hi - lo))) if hi > lo else h[:0]


def _whole(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)


def _sets_of(part, shingle: int) -> list[np.ndarray]:
    buf, at = T.raw(part.column("text"))
    words = T.Words(_LOWER[buf], at)
    return list(_shingles(words, words.hashes(), shingle))


def _shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """set (sorted hashes of the distinct word shingles, 8 bytes each; of all words where there are fewer) of every
    text, and a hash of it."""
    emit = T.emitter("node long, set binary")

    def run(batches):
        for part in T.slices(batches):
            sets = _sets_of(part, shingle)
            yield emit({"node": _whole(sets), "set": [s.tobytes() for s in sets]})

    return docs.select("text").mapInArrow(run, "node long, set binary")


def _common_shingles(docs: DataFrame, shingle: int, sample: int = 20_000, least: int = 3, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that ``least`` or more of a sample of about ``sample`` texts hold, in the order of their hashes, and in how
    many. They only shape the order in which shingles are keys, so a sample loses no pair."""
    share = int(1e6 * sample / max(sample, docs.count()))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    emit = T.emitter("s long, n long")

    def run(batches):
        for part in T.slices(batches, most=8 << 20):
            sets = _sets_of(part, shingle)
            s, n = np.unique(np.concatenate(sets), return_counts=True)
            yield emit({"s": s.view(np.int64), "n": n})

    counts = some.select("text").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    got = counts.orderBy(F.desc("n"), "s").limit(most).toArrow()
    s, n = got.column("s").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def _sketch(s: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each of 8 to len(s) / 2 segments (a power of two of them), a byte each."""
    bits = max(3, len(s).bit_length() - 2)
    return np.minimum(np.bincount((s & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def within(a: bytes, b: bytes, budget: float, chain: int = 8) -> bool:
    """Pigeonring filter on two sketches: whether the sets may differ in ``budget`` elements or fewer.

    A set difference shows as differences of the segments' counts, never the other way round. If all segments' add up
    to no more than the budget, then from some segment on the ring's next 1, 2, ... ``chain`` parts (of equally many
    segments) add up to no more than their share of it; pairs without such a chain go before the whole sum is taken.
    Segments with 255 or more elements decide nothing.
    """
    x, y = np.frombuffer(a, np.uint8).astype(np.int16), np.frombuffer(b, np.uint8).astype(np.int16)
    n = min(len(x), len(y))
    full = (x.reshape(-1, n) == 255).any(axis=0) | (y.reshape(-1, n) == 255).any(axis=0)
    d = np.where(full, 0, np.abs(x.reshape(-1, n).sum(axis=0) - y.reshape(-1, n).sum(axis=0)))
    parts = d.reshape(chain, -1).sum(axis=1)
    sums = np.cumsum(np.concatenate([parts, parts]))
    runs = np.stack([sums[k : k + chain] - np.concatenate([[0], sums])[:chain] for k in range(chain)])
    ok = (runs <= budget * np.arange(1, chain + 1)[:, None] / chain + 1e-9).all(axis=0).any()
    return bool(ok) and d.sum() <= budget + 1e-9


def _prefixes(docs: DataFrame, shingle: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, text_hash, node (a hash of the text's set of shingles), n (its size), sketch and keys (8 bytes each): its rarest
    shingles, so many that two sets at ``similarity`` share one. The order is the same for all texts: by count in
    ``common``, then by hash."""
    ddl = "doc_id long, text_hash long, node long, n int, sketch binary, keys binary"
    emit, (known, counts) = T.emitter(ddl), common

    def run(batches):
        for part in T.slices(batches):
            sets, keys = _sets_of(part, shingle), []
            for s in sets:
                first = len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1
                rank = np.zeros(len(s), np.int64)
                if len(known):
                    i = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    rank = np.where(known[i] == s, counts[i], 0)
                keys.append(s[np.argsort(rank, kind="stable")[:first]].tobytes())
            yield emit({"doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"), "node": _whole(sets), "n": np.array([len(s) for s in sets], np.int32), "sketch": [_sketch(s) for s in sets], "keys": keys})

    return docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, ddl)


def _shared_keys(classes: DataFrame, scratch: Scratch, block_keys: int = 400_000, shard_keys: int = 2_000_000) -> DataFrame:
    """key, node, n and at (the key's place) of the keys that two or more of ``classes`` (node, n, keys) have.

    Most keys are one text's alone. So classes travel as blocks of about ``block_keys`` keys; each block sends each of
    its keys once to the key's shard, the shards send back those seen twice, and only these become rows.
    """
    ddl = "block long, nodes binary, sizes binary, counts binary, keys binary"
    emit = T.emitter(ddl)

    def gather(batches):
        part, number, held, rows = TaskContext.get().partitionId(), 0, 0, []

        def flush():
            nodes, sizes, keys = zip(*rows)
            return emit({"block": [part << 32 | number], "nodes": [np.array(nodes, "<i8").tobytes()], "sizes": [np.array(sizes, "<i4").tobytes()], "counts": [np.array([len(k) // 8 for k in keys], "<i4").tobytes()], "keys": [b"".join(keys)]})

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "keys"))):
                rows.append(row)
                held += len(row[2]) // 8
                if held >= block_keys:
                    yield flush()
                    number, held, rows = number + 1, 0, []
        if rows:
            yield flush()

    blocks = scratch.save(classes.select("node", "n", "keys").mapInArrow(gather, ddl), "blocks")
    total = blocks.agg(F.sum(F.octet_length("keys"))).head()[0] or 0
    shards = max(1, total // 8 // shard_keys)
    sent, back, out = T.emitter("shard int, block long, keys binary, twice binary"), T.emitter("block long, keys binary"), T.emitter("key long, node long, n int, at int")

    def send(batches):
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("keys").to_pylist()):
                keys, n = np.unique(np.frombuffer(data, "<u8"), return_counts=True)
                # shards are ranges of keys
                cuts = np.searchsorted(keys >> np.uint64(32), (np.arange(shards + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(shards))
                spans = [(s, a, b) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]
                yield sent({"shard": [s for s, _, _ in spans], "block": [block] * len(spans), "keys": [keys[a:b].tobytes() for _, a, b in spans], "twice": [keys[a:b][n[a:b] > 1].tobytes() for _, a, b in spans]})

    def reply(table: pa.Table) -> pa.Table:
        all_keys = [np.frombuffer(k, "<u8") for k in table.column("keys").to_pylist()]
        keys, n = np.unique(np.concatenate([*all_keys, *(np.frombuffer(k, "<u8") for k in table.column("twice").to_pylist())]), return_counts=True)
        keys = keys[n > 1]
        got = [k[np.isin(k, keys, assume_unique=True)].tobytes() for k in all_keys]
        return pa.Table.from_batches([back({"block": table.column("block").combine_chunks(), "keys": got})])

    def expand(batches):
        for batch in batches:
            for nodes, sizes, counts, data, wanted in zip(*(batch.column(c).to_pylist() for c in ("nodes", "sizes", "counts", "keys", "wanted"))):
                keys, counts = np.frombuffer(data, "<u8"), np.frombuffer(counts, "<i4")
                hit = np.flatnonzero(np.isin(keys, np.frombuffer(b"".join(wanted), "<u8")))
                of = np.repeat(np.arange(len(counts)), counts)[hit]
                first = np.cumsum(counts) - counts
                yield out({"key": keys[hit].view(np.int64), "node": np.frombuffer(nodes, "<i8")[of], "n": np.frombuffer(sizes, "<i4")[of], "at": (hit - first[of]).astype(np.int32)})

    repeated = blocks.select("block", "keys").mapInArrow(send, "shard int, block long, keys binary, twice binary").groupBy("shard").applyInArrow(reply, "block long, keys binary")
    repeated = repeated.where("octet_length(keys) > 0").groupBy("block").agg(F.collect_list("keys").alias("wanted"))
    shared = scratch.save(blocks.join(repeated, "block").drop("block").mapInArrow(expand, "key long, node long, n int, at int"), "shared")
    scratch.drop("blocks")
    return shared


def near_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, block: int = 512, stars: int = 4, centres: int = 8) -> DataFrame:
    """doc_id, text_hash, component_id and root of every row of ``docs`` (doc_id, text): groups of texts whose word
    shingles are alike. text_hash is Spark's xxhash64 of the text, root tells groups apart (ids may repeat).

    Texts with equal sets of ``shingle``-word shingles (A-Z lower-cased) are one class. Classes are linked if the Jaccard
    similarity of their sets is ``similarity`` or more, a group is what links connect, and no link between groups is
    left out. Two such sets share one of their rarest (1 - ``similarity``) n + 1 shingles (a prefix filter), so classes
    meet in a bucket for each of these; sizes, the shingle's place in both and then the pigeonring filter over counts of
    shingles by segment prune pairs that can't be alike, and the sets decide. In each of ``stars`` turns every class is
    held against ``centres`` members of its buckets whose groups differ from its own, other ones each turn. Then all pairs in
    a bucket whose groups still differ are held against one another, in blocks of about ``block`` classes and by bands
    of size: pairs inside a group add nothing, so a large group costs the square of its size only where all of its
    stars show few of its links. component_id is the group's least doc_id. Blank and null texts are one group. Rows stay one to one; texts that only rows without an id have link nothing.
    """
    scratch = Scratch(docs.sparkSession, "near")
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    known = scratch.save(_prefixes(docs, shingle, similarity, _common_shingles(docs, shingle)), "prefixes")
    classes = scratch.save(known.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")).where("doc_id is not null"), "classes")
    shared = _shared_keys(known.join(classes.select("node", "doc_id"), ["node", "doc_id"], "left_semi"), scratch)
    held = F.struct("node", "n", "at")
    sizes = shared.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("key", "size")
    keyed = scratch.save(shared.join(sizes, "key"), "keyed")
    scratch.drop("shared")
    a, b = F.col("a"), F.col("b")
    sketches = known.select("node", "n", "sketch")

    def able(x, y):
        """Whether the sizes and a shared shingle's places leave two sets able to be alike. At the first shingle that
        they share, neither shares any before it."""
        low, high = F.least(x["n"], y["n"]), F.greatest(x["n"], y["n"])
        most = F.least(x["n"] - x["at"], y["n"] - y["at"])
        return (low >= similarity * high - 1e-9) & (most * (1 + similarity) >= similarity * (low + high) - 1e-9)

    def pairs(found: DataFrame) -> DataFrame:
        """Distinct pairs of a and b that may be alike."""
        return found.where((a["node"] != b["node"]) & able(a, b)).select(F.greatest(a["node"], b["node"]).alias("u"), F.least(a["node"], b["node"]).alias("v")).distinct()

    def with_both(candidates: DataFrame, of: DataFrame, column: str) -> DataFrame:
        """u, v and the ``column`` of both."""
        x, y = of.select(F.col("node").alias("u"), F.col(column).alias("x")), of.select(F.col("node").alias("v"), F.col(column).alias("y"))
        return candidates.join(x, "u").join(y, "v")

    def keep(emit, test):
        def run(batches):
            for batch in batches:
                hit = [test(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
                hit = batch.filter(pa.array(hit, pa.bool_()))
                yield emit({"u": hit.column("u"), "v": hit.column("v")})

        return run

    link = "u long, v long"
    emit_link = T.emitter(link)

    def near(x: bytes, y: bytes) -> bool:
        n, m = len(x) // 8, len(y) // 8
        both = len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
        return both >= similarity * (n + m - both)

    def may_be_near(x: tuple, y: tuple) -> bool:
        return within(x["sketch"], y["sketch"], (1 - similarity) / (1 + similarity) * (x["n"] + y["n"]))

    def nodes_of(links: DataFrame) -> DataFrame:
        return links.select(F.col("u").alias("node")).union(links.select("v")).distinct()

    def alike(candidates: DataFrame, name: str) -> DataFrame:
        candidates = scratch.save(candidates, f"candidates_{name}")
        some = scratch.save(sketches.join(nodes_of(candidates), "node", "left_semi").groupBy("node").agg(F.first(F.struct("n", "sketch")).alias("about")), f"sketches_{name}")
        candidates = scratch.save(with_both(candidates, some, "about").mapInArrow(keep(emit_link, may_be_near), link), f"pruned_{name}")
        scratch.drop(f"candidates_{name}", f"sketches_{name}")
        texts = docs.join(classes.join(nodes_of(candidates), "node", "left_semi").select("doc_id"), "doc_id", "left_semi")
        sets = scratch.save(_shingle_sets(texts, shingle).groupBy("node").agg(F.first("set").alias("set")), f"sets_{name}")
        links = scratch.save(with_both(candidates, sets, "set").mapInArrow(keep(emit_link, near), link), f"links_{name}")
        scratch.drop(f"pruned_{name}", f"sets_{name}")
        return links

    rooted, links, roots = keyed.withColumn("root", F.col("node")), None, None
    for turn in range(stars):
        # the least by each of some hashes, which are mostly the same members in all buckets of a group
        by = lambda k: F.struct(F.xxhash64("node", F.lit(turn * centres + k)).alias("h"), "node", "n", "at", "root")  # noqa: B023, E731
        ends = rooted.groupBy("key").agg(F.array(*[F.min(by(k)) for k in range(centres)]).alias("ends"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key", "ends")
        met = rooted.join(ends, "key").select(held.alias("a"), "root", F.explode("ends").alias("e")).where("root <> e.root")
        found = alike(pairs(met.select("a", F.struct("e.node", "e.n", "e.at").alias("b"))), f"star{turn}")
        links = found if links is None else links.union(found)
        roots = components(links, scratch)
        rooted = keyed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        rooted = scratch.save(rooted.select("key", "size", "node", "n", "at", "root"), f"rooted{turn}")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key")
    rest = rooted.join(mixed, "key", "left_semi")
    # the smaller of a pair has its shingle among the first (1 - s) / (1 + s); the other's size is in its band or the next
    band = F.floor(F.log(F.greatest("n", F.lit(1)) + 0.5) / float(-np.log(similarity))).cast("int")
    # blocks of one large group's members, which needn't meet themselves, and blocks of the small groups' together
    own = rest.groupBy("key", "root").agg(F.count(F.lit(1)).alias("own")).where(F.col("own") > block // 8).select("key", "root", F.lit(True).alias("large"))
    member, slots = F.struct("node", "n", "at", "root"), F.ceil(F.col("size") / block)
    rest = rest.join(own, ["key", "root"], "left").withColumns({"of": F.when(F.col("large"), F.col("root")), "slot": F.pmod(F.xxhash64("node"), slots), "salts": F.ceil(slots / 8)})

    def gathered(rows: DataFrame, bands, of: str, members: str) -> DataFrame:
        rows = rows.withColumn("band", F.explode(F.array(*bands)))
        return rows.groupBy("key", "band", "salts", F.col("of").alias(of), F.col("slot").alias(f"slot_{of}")).agg(F.collect_list(member).alias(members))

    first = F.col("at") * (1 + similarity) <= (1 - similarity) * F.col("n") + 1e-9
    left = scratch.save(gathered(rest.where(first), [band], "of_a", "as"), "left").withColumn("salt", F.pmod("slot_of_a", F.col("salts")))
    right = scratch.save(gathered(rest, [band, band - 1], "of_b", "bs"), "right").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    met = left.join(right.drop("salts"), ["key", "band", "salt"]).where("of_a is null or of_b is null or of_a <> of_b").select(F.explode("as").alias("a"), "bs")
    met = met.select("a", F.explode(F.filter("bs", lambda y: (a["root"] != y["root"]) & (a["n"] <= y["n"]) & able(a, y))).alias("b"))
    two = alike(pairs(met), "rest")
    scratch.drop("left", "right", *[f"rooted{turn}" for turn in range(stars)])
    roots = components(links.union(two), scratch)
    groups = classes.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    ids = groups.join(groups.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("node", "component_id", "root")
    return known.select("doc_id", "text_hash", "node").join(ids, "node", "left").select("doc_id", "text_hash", "component_id", "root")
