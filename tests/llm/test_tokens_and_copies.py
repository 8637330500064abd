"""SimHash groups, packing and Re-Pair shards against brute force and round trips."""

import collections
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terragrid.llm import packing, queries, repair, simhash
from terragrid.llm.tokens import Encoder
from tests.conftest import SF
from tests.llm.test_first_operators import EDGE, edge

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_components(prints, budget=2):
    ids, up = sorted(prints), {}
    find = lambda x: x if up.get(x, x) == x else find(up[x])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= budget:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_query_matches_brute_force(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {i: brute_print(t) for i, t in text.items()}
    want = brute_components(prints)
    got = {r.doc_id: r for r in queries.op2_simhash(spark, SF).collect()}
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", want[i]) for i in text}


@pytest.mark.parametrize("hot, budget", [(1, 2), (64, 2), (1, 1), (64, 0)])
def test_links_lose_none(spark, hot, budget):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    prints = {int(c) for c in centre} | {0}
    for _ in range(400):
        x = int(rng.choice(np.array(sorted(prints), np.uint64)))
        for b in rng.integers(0, 64, rng.integers(1, 4)):
            x ^= 1 << int(b)
        prints.add(x)
    signed = {p - (1 << 64) if p >= 1 << 63 else p: p for p in prints}
    links = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), budget, hot=hot).collect()
    up = {}
    find = lambda x: x if up.get(x, x) == x else find(up[x])
    for r in links:
        assert (signed[r.u] ^ signed[r.v]).bit_count() <= budget
        a, b = find(signed[r.u]), find(signed[r.v])
        up[max(a, b)] = min(a, b)
    assert {p: find(p) for p in prints} == brute_components({p: p for p in prints}, budget)


def test_simhash_edges(spark):
    got = {r.doc_id: r for r in simhash.group(edge(spark)).collect()}
    assert got[1].fingerprint == "0" * 16 and got[1].component_id == got[2].component_id == got[3].component_id == 1
    assert got[4].component_id == got[5].component_id == 4
    assert len(got) == len(EDGE) and simhash.group(edge(spark).limit(0)).count() == 0


def test_near_groups_find_planted_copies(spark):
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(5000)]
    rows, kind = [], {}
    for g in range(40):
        base = list(rng.choice(vocab, 150))
        for k in range(4):
            t = list(base)
            if k:
                t[int(rng.integers(0, 150))] = f"new{g}{k}"
            rows.append((len(rows), " ".join(t)))
            kind[len(rows) - 1] = g
    got = {r.doc_id: r.component_id for r in simhash.near_groups(edge(spark, rows)).collect()}
    first = {g: min(i for i in kind if kind[i] == g) for g in range(40)}
    assert sum(got[i] == first[kind[i]] for i in kind) >= 0.97 * len(kind)
    assert simhash.near_groups(edge(spark)).count() == len(EDGE)
    assert simhash.near_groups(edge(spark).limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 400), st.integers(0, 60), st.integers(0, 60))
def test_pigeonring_filter_drops_no_pair_within_budget(seed, both, left, right):
    """Sets that differ in ``left`` + ``right`` hashes pass at that budget, also if their sketches differ in length."""
    rng = np.random.default_rng(seed)
    h = np.unique(rng.integers(0, 1 << 63, both + left + right + 1, dtype=np.uint64))
    x, y = h[: both + left + 1], np.concatenate([h[: both + 1], h[both + left + 1 :]])
    assert simhash.within(simhash._sketch(x), simhash._sketch(y), len(np.setxor1d(x, y)))
    far = np.unique(rng.integers(0, 1 << 63, len(x) + 200, dtype=np.uint64))
    assert not simhash.within(simhash._sketch(h), simhash._sketch(far), 1)


def brute_near(rows, similarity=0.8, k=5):
    """The least id each text reaches over links of ``similarity`` or more, all pairs compared."""
    words = {i: t.lower().split() for i, t in rows}
    sets = {i: {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} for i, w in words.items()}
    ids, up = sorted(sets), {}
    find = lambda x: x if up.get(x, x) == x else find(up[x])
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("variants", [100, 1000])
def test_near_groups_keep_every_link_of_a_hub(spark, variants):
    """Variants that are alike to a hub in the middle of the ids, mostly not to one another, and have its words."""
    rng = np.random.default_rng(variants)
    hub = [f"w{i}" for i in rng.choice(50_000, 200)]
    rows = []
    for k in range(variants + 1):
        t = list(hub)
        if k != variants // 2:
            for at in rng.choice(np.arange(6, 190, 8), 3, replace=False):
                t[at], t[at + 1] = t[at + 1], t[at]
        rows.append((k, " ".join(t)))
    want = brute_near(rows)
    assert set(want.values()) == {0}
    assert {r.doc_id: r.component_id for r in simhash.near_groups(edge(spark, rows)).collect()} == want


def test_near_groups_find_block_edits(spark):
    """A tail replaced or cut, a block inside replaced, scattered words: all groups that all pairs give."""
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(60):
        base = [f"w{i}" for i in rng.choice(5000, 300)]
        new = [f"n{i}" for i in rng.choice(5000, 300)]
        at = int(rng.integers(20, 250))
        scattered = [new[i] if i in (40, 150, 260) else w for i, w in enumerate(base)]
        for t in (base, base[:276] + new[:24], base[:255], base[:at] + new[:15] + base[at + 15 :], base[:200] + new[:100], scattered):
            rows.append((len(rows), " ".join(t)))
    want = brute_near(rows)
    assert len(set(want.values())) == 120  # a third replaced is no copy
    assert {r.doc_id: r.component_id for r in simhash.near_groups(edge(spark, rows)).collect()} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.text(alphabet=" \n\t'abcZé٣ß.,-1  ΣΏ<|>", max_size=40), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "a <|startoftext|> b", "<|endof", "text|>", "<|ENDOFTEXT|>"])), max_size=4).map("".join), max_size=6))
def test_encoder_equals_the_library(texts):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder = Encoder.of(public_tokenizers.path(name))
        data = [t.encode() for t in texts]
        at = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
        ids, start = encoder.encode(np.frombuffer(b"".join(data), np.uint8), at)
        want = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip(start[:-1], start[1:])] == [e.ids for e in want]


def library_ids(name, texts, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array([*e.ids, end], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_pieces(rows, ids):
    """Each id lies in exactly one piece; sequences are gapless and full, or a power of two."""
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
    for doc, p in pieces.items():
        at = 0
        for start, n in sorted(p):
            assert start == at and n > 0
            at += n
        assert at == len(ids[doc])
    assert pieces.keys() == ids.keys()
    for p in sequences.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at == 4096 or at & (at - 1) == 0 and at < 4096


def test_packing_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    ids = dict(zip(docs.doc_id, library_ids("word_bpe_49k.json", docs.text, 2)))
    rows = queries.op3_packing(spark, SF).collect()
    check_pieces(rows, ids)
    total, share, seen = sum(map(len, ids.values())), collections.Counter(), collections.defaultdict(collections.Counter)
    source = dict(zip(docs.doc_id, docs.source))
    for i, x in ids.items():
        share[source[i]] += len(x)
    for r in rows:
        seen[r.sequence_id][r.source] += r.length
    full = [s for s in seen if sum(seen[s].values()) == 4096][:-2]
    assert max(abs(seen[q][s] - 4096 * n / total) for q in full for s, n in share.items()) < 3 * 128


def test_packing_repeated_and_null_ids(spark):
    rows = [(1, "one two three", "a", 5), (1, "one two three", "a", 5), (None, "four five", None, 6), (None, None, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, start int").withColumns({"n": F.lit("x"), "part": F.lit("y"), "_source": F.lit("z")})
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(docs, path, 2).collect()
    assert sum(r.length for r in got) == 4 + 4 + 3 + 1 and {r.doc_id for r in got} == {1, None}
    assert packing.pack(docs.limit(0), path, 2).count() == 0


def test_packing_weights_and_edges(spark):
    rows = [(i, "one two three four " * 40, "a" if i % 4 else None) for i in range(60)] + [(100, None, "b"), (101, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(docs, path, 2, weights={"a": 1.0}, with_ids=True).collect()
    check_pieces(got, {r[0]: x for r, x in zip(rows, library_ids("word_bpe_49k.json", [r[1] for r in rows], 2))})
    assert packing.pack(docs.limit(0), path, 2).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, path, 2, weights={"a": -1.0})


def test_repair_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id")
    ids = library_ids("byte_bpe_50k.json", docs.text, 0)
    start = np.concatenate([[0], np.cumsum([len(x) for x in ids])[:-1]])
    want = [(int(d), int(s), len(x), zlib.crc32(x)) for d, s, x in zip(docs.doc_id, start, ids)]
    assert sorted(map(tuple, queries.op4_repair(spark, SF).collect())) == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=400), max_size=5), st.data())
def test_shards_decode_any_range(docs, data):
    ids = np.array([x for d in docs for x in d], np.uint32)
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    shard = repair.Shard(repair.compress(ids, first, [None, *range(len(docs))][: len(docs)], least=2))
    for k, d in enumerate(docs):
        assert shard.document(k).tolist() == d
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert shard.ids(a, b).tolist() == ids[a:b].tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=300), st.integers(1, 9), st.integers(2, 9))
def test_repair_leaves_no_frequent_pair(some, copies, least):
    """Round trip, random access, and counted afresh no pair stands ``least`` times apart from overlaps in a run."""
    ids = np.array(some * copies, np.uint32)
    shard = repair.Shard(repair.compress(ids, np.array([0, len(ids)]), [1], least=least))
    assert (shard.whole() == ids).all()
    a, b = len(ids) // 3, 2 * len(ids) // 3
    assert (shard.ids(a, b) == ids[a:b]).all()
    pairs = collections.Counter(p for p in zip(shard.symbols[:-1].tolist(), shard.symbols[1:].tolist()) if p[0] != p[1])
    assert all(n < least for n in pairs.values())


def test_repair_compresses_and_handles_edges(spark):
    ids = np.tile(np.array([5, 6, 7, 70000], np.uint32), 50_000)
    data = repair.compress(ids, np.array([0, len(ids)]), [1])
    assert len(data) < len(ids) / 2 and (repair.Shard(data).ids(0, len(ids)) == ids).all()
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = repair.round_trip(edge(spark), path, 0, shard_ids=50).collect()
    assert len(got) == len(EDGE) and min(r.n_tokens for r in got) == 1
    assert repair.round_trip(edge(spark).limit(0), path, 0).count() == 0
