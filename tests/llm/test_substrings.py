"""Substring deduplication against brute force."""

import collections
import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terragrid.llm import queries, substrings
from tests.conftest import SF
from tests.llm.test_first_operators import EDGE, edge


def brute(texts, window):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in texts.items()}
    seen = collections.Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for k, w in words.items():
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out[k] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out


def test_query_matches_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op5_substrings(spark, SF).collect()}
    assert got == brute(texts, 35)


@pytest.mark.parametrize("hot", [2, 4096])
def test_shared_passages_and_hot_anchors(spark, hot):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(300)]
    passage = list(rng.choice(vocab, 60))
    rows = []
    for i in range(80):
        own = list(rng.choice(vocab, int(rng.integers(0, 90))))
        cut = int(rng.integers(0, 60))
        rows.append((i, " ".join(own + (passage[: cut] if i % 3 else passage) + own[:20])))
    rows += [(900, "a " * 200), (901, None), (902, ""), (903, "b c " * 60), (904, " ".join(rows[0][1].split()))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove(edge(spark, rows), 35, hot=hot, shard_words=2000).collect()}
    assert got == brute(dict(rows), 35)


def test_edges(spark):
    out = substrings.remove(edge(spark), 35)
    assert out.count() == len(EDGE) and {"kept", "n_chars"} <= set(out.columns)
    assert substrings.remove(edge(spark).limit(0), 35).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=5, max_size=30), min_size=1, max_size=8), st.integers(2, 5))
def test_index_finds_just_the_repeated_windows(texts, window):
    stretches = [np.array(t) for t in texts]
    seen = collections.Counter(tuple(t[i : i + window]) for t in texts for i in range(len(t) - window + 1))
    want = {(k, i) for k, t in enumerate(texts) for i in range(len(t) - window + 1) if seen[tuple(t[i : i + window])] > 1}
    found = substrings.repeated_windows(stretches, np.ones(len(texts)), 4, window)
    assert {(int(k), i) for k, a, b in found for i in range(a, b)} == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 20), min_size=1, max_size=300))
def test_wavelet_ranks(seq):
    seq = np.array(seq)
    matrix = substrings.WaveletMatrix(seq, 21)
    for c in (0, 7, 20):
        at = np.arange(len(seq) + 1)
        assert matrix.rank(np.full(len(at), c), at).tolist() == np.concatenate([[0], np.cumsum(seq == c)]).tolist()
