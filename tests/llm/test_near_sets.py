"""MinHash near-duplicates against literal loops over all pairs."""

import math
import random

import numpy as np
import pytest

from titleq.llm import hamming

from .conftest import WORDS


def literal(rows, shingle=3, percent=85):
    """(doc_id, n, component) of each row by comparing all pairs of rows."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    key = [math.inf if d is None else d for d, _ in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * len(a | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i in range(len(rows)):
        least[top(i)] = min(least.get(top(i), math.inf), key[i])
    return sorted((key[i], len(sets[i]), least[top(i)]) for i in range(len(rows)))


def result(df):
    far = lambda x: math.inf if x is None else x
    rows = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted((far(r.doc_id), r.n_shingles, far(r.component_id)) for r in rows)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    prose = lambda n: [rng.choice(WORDS) for _ in range(n)]
    out = []
    for _ in range(25):
        base = prose(rng.choice([4, 20, 60, 200, 500]))
        out.append(base)
        for _ in range(rng.randrange(6)):  # copies with more or fewer changed words, some just at the limit
            copy = list(base)
            for _ in range(rng.randrange(1 + len(base) // 30)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS) + "x"
            out.append(copy)
    chain = prose(300)
    for i in range(15):  # each like the next one, the ends far apart
        chain = chain[:]
        chain[i * 20 : i * 20 + 6] = prose(6)
        out.append(chain)
    texts = [" ".join(w) for w in out]
    texts += ["a b", "A  b\n", "a b c", "one", "ONE", "É x y", "é x y", "", " \t", None, None, "w " * 500, "w " * 9, "long" * 30_000]
    rows = [(1000 - 3 * i, t) for i, t in enumerate(texts)]
    return [*rows, rows[2], rows[2], (None, texts[4]), (None, "no other like this")]


def test_equals_all_pairs(make, rows):
    assert result(hamming.near_duplicates(make(rows, extra=True))) == literal(rows)


def test_small_blocks_and_buckets_lose_nothing(make, rows):
    want = literal(rows)
    assert result(hamming.near_duplicates(make(rows).repartition(5), bucket=3, block=500)) == want
    assert result(hamming.near_duplicates(make(rows), bucket=1, block=3000)) == want


def test_other_threshold_and_shingle(make, rows):
    assert result(hamming.near_duplicates(make(rows), shingle=5, percent=90)) == literal(rows, 5, 90)


def test_empty_tables(make):
    assert result(hamming.near_duplicates(make([]))) == []
    assert result(hamming.near_duplicates(make([(1, None), (2, ""), (None, None)]))) == [(1, 0, 1), (2, 0, 2), (math.inf, 0, math.inf)]


def test_all_pairs_under_the_signature_distance_share_a_key():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 16, (400, hamming.SYMBOLS), dtype=np.uint16)
    other = base.copy()
    for row in other:
        at = rng.permutation(hamming.SYMBOLS)[: hamming.MOST_ERRORS]
        row[at] ^= 1
    a, b = hamming.chunk_keys(base), hamming.chunk_keys(other)
    assert (a == b).any(axis=1).all()
    assert len(np.unique(a)) == a.size  # no key by chance


def test_signature_distance_follows_similarity():
    rng = np.random.default_rng(4)
    flat, bounds = [], [0]
    for _ in range(300):
        both = rng.integers(0, 2**63, 850, dtype=np.uint64)
        for _ in range(2):
            flat.append(np.unique(np.concatenate([both, rng.integers(0, 2**63, 75, dtype=np.uint64)])))
            bounds.append(bounds[-1] + len(flat[-1]))
    sigs = hamming.signatures(np.concatenate(flat), np.array(bounds))
    errors = (sigs[::2] != sigs[1::2]).sum(axis=1)
    assert 4.2 < errors.mean() < 5.4 and errors.max() <= hamming.MOST_ERRORS


def test_cross_ties_connect_what_all_pairs_connect():
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 2**62, 40, dtype=np.uint64) for _ in range(4)]
    values = []
    for i in range(40):
        v = base[i % 4].copy()
        v[rng.integers(0, 40, 3)] = rng.integers(0, 2**62, 3, dtype=np.uint64)
        values.append(np.unique(v))
    nodes, rest = np.arange(40), np.arange(40) % 3 == 0
    link = lambda i, j: 100 * len(np.intersect1d(values[i], values[j])) >= 85 * len(np.union1d(values[i], values[j]))
    edges = [(i, j) for i in range(40) for j in range(i) if (rest[i] or rest[j]) and link(i, j)]

    def parts(edges):
        up = list(range(40))
        for a, b in edges:
            x, y = up[a], up[b]
            up = [y if u == x else u for u in up]
        return [up.index(u) for u in up]

    got = hamming.cross_ties(values, nodes, rest, 85)
    assert parts(got) == parts(edges) and len(got) < 40
