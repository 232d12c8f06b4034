"""Posting lists: exact results, and few documents touched where lists tell documents apart."""

import numpy as np

from arborlight.llm import maxscore


def brute(q, own, docs, ids, k):
    s = docs @ q
    return sorted((-int(x), int(i)) for x, i in zip(s, ids, strict=True) if i != own)[:k]


def run(queries, own, docs, ids, k):
    touched: list = []
    got: dict = {}
    for q, doc, score in maxscore.search_shard(queries, own, docs, ids, k, touched):
        got.setdefault(q, []).append((-score, doc))
    return got, touched


def test_sparse_weights_touch_few_documents():
    rng = np.random.default_rng(1)
    docs = np.where(rng.random((4000, 32)) < 0.05, rng.integers(1, 200, (4000, 32)), 0)
    queries = np.where(rng.random((40, 32)) < 0.15, rng.integers(1, 50, (40, 32)), 0)
    ids, own = np.arange(4000) * 3, np.arange(40) * 3
    got, touched = run(queries, own, docs, ids, 5)
    assert all(got[q] == brute(queries[q], own[q], docs, ids, 5) for q in range(40))
    assert np.mean([t[0] for t in touched]) < 0.5 * 4000 and len(touched) == 40


def test_dense_signed_vectors_with_ties_are_exact():
    rng = np.random.default_rng(2)
    for n, d, k in ((300, 5, 5), (3, 4, 5), (1, 1, 2), (700, 64, 5), (50, 17, 7)):
        docs, queries = rng.integers(-4, 5, (n, d)), rng.integers(-4, 5, (20, d))
        ids, own = rng.permutation(n), rng.integers(0, n, 20)
        got, _ = run(queries, own, docs, ids, k)
        assert all(got.get(q, []) == brute(queries[q], own[q], docs, ids, k) for q in range(20))


def test_one_term_decides():
    docs = np.zeros((1000, 8), int)
    docs[:, 0] = np.arange(1000)
    got, touched = run(np.eye(8, dtype=int)[:1], np.array([-1]), docs, np.arange(1000), 3)
    assert got[0] == [(-999, 999), (-998, 998), (-997, 997)] and touched[0][0] < 200
