"""Frequent sets and rules by bitsets against FP-growth and counting."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from titleq.operators import itemsets
from titleq.session import written


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    core = list("abcdefg")
    rows = []
    for i in range(700):
        words = [w for w in core if rng.random() < (0.9 if i % 3 else 0.2)] + [f"r{rng.randrange(300)}" for _ in range(4)]
        rng.shuffle(words)
        rows.append((i, words + words[:2]))
    rows += [(900, []), (901, None), (902, [None, "a", "a"])]
    return written(spark.createDataFrame(rows, "index long, tokens array<string>").repartition(3), "rows")


def as_dict(sets):
    return {tuple(r["items"]): r.freq for r in sets.collect()}


@pytest.mark.parametrize("support, block", [(0.25, 1 << 15), (0.25, 50), (0.05, 64)])
def test_sets_equal_counts_at_every_size(rows, support, block, monkeypatch):
    monkeypatch.setattr(itemsets, "BLOCK_ROWS", block)
    got = as_dict(itemsets.vertical(rows, "tokens", support))
    data = [frozenset(t for t in r.tokens or [] if t is not None) for r in rows.collect()]
    need = -(-support * len(data) // 1)
    items = sorted({i for d in data for i in d})
    want, level = {}, [()]
    while level:
        grown = {}
        for s in level:
            for i in items:
                if not s or i > s[-1]:
                    n = sum(d.issuperset((*s, i)) for d in data)
                    if n >= need:
                        grown[(*s, i)] = n
        want |= grown
        level = list(grown)
        items = [i for i in items if any(i in s for s in level)]
    assert got == want and max(map(len, got)) >= 6


def test_sets_and_rules_equal_fp_growth(rows):
    some = rows.where("index < 900")
    model = itemsets.fit(some, "tokens", 0.2, 0.6)
    assert as_dict(itemsets.vertical(some, "tokens", 0.2)) == as_dict(itemsets.itemsets(model))
    got = itemsets.rules(itemsets.vertical(some, "tokens", 0.2), some.count(), 0.6)
    key = lambda r: (tuple(sorted(r.antecedent)), r.consequent if isinstance(r.consequent, str) else r.consequent[0])
    a = {key(r): (r.confidence, r.lift, r.support) for r in got.collect()}
    b = {key(r): (r.confidence, r.lift, r.support) for r in model.associationRules.collect()}
    assert a.keys() == b.keys() and len(a) > 50
    assert all(a[k] == pytest.approx(b[k]) for k in a)


def test_candidates_have_frequent_parts():
    sets = [s for s in itertools.combinations(range(5), 2) if s != (1, 3)]
    want = [s for s in itertools.combinations(range(5), 3) if not {1, 3} <= set(s)]
    assert sorted(itemsets._next_level(sets)) == want


def test_nothing_frequent(rows):
    assert itemsets.vertical(rows.limit(0), "tokens").count() == 0
    assert itemsets.vertical(rows.where(F.size("tokens") == 0), "tokens").count() == 0
