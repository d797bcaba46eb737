"""Dictionary, bags and topics against loops and Spark's own estimator."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from titleq.models import topics
from titleq.operators import layout
from titleq.session import written

from .conftest import SMALL


def test_rows_are_numbered_in_order(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(4), f"t{i:03}") for i in range(500)]
    df = spark.createDataFrame(rows, "n long, term string").repartition(7)
    got = layout.order_index(df, [F.desc("n"), F.asc("term")], "number").collect()
    want = {t: i for i, (_, t) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))}
    assert {r.term: r.number for r in got} == want
    assert layout.order_index(df.limit(0), [F.desc("n")], "number").count() == 0


@pytest.fixture(scope="module")
def titles(spark):
    """Texts of three planted topics, 12 words each, in two models."""
    rng = random.Random(3)
    rows = []
    for i in range(900):
        topic = i % 3
        words = [f"{'xyz'[topic]}{rng.randrange(12)}" if rng.random() < 0.95 else f"c{rng.randrange(6)}" for _ in range(25)]
        rows.append((i, i % 2 == 0, words))
    rows += [(1000, True, []), (1001, False, None)]
    return written(spark.createDataFrame(rows, "index long, model boolean, tokens array<string>"), "titles")


@pytest.mark.parametrize("limit", [None, 64 * 5])
def test_bags_equal_counts(spark, titles, limit, monkeypatch):
    if limit:  # five terms are broadcast, the others are joined by a shuffle
        monkeypatch.setattr(topics, "BROADCAST_BYTES", limit)
    terms = topics.dictionary(titles, "tokens")
    number = {r.term: r.term_id for r in terms.collect()}
    assert sorted(number.values()) == list(range(len(number)))
    got = {(r["index"], r.term_id): r.n for r in topics.bags(titles, "tokens", terms, "index").collect()}
    want = {}
    for r in titles.collect():
        for t in r.tokens or []:
            want[r["index"], number[t]] = want.get((r["index"], number[t]), 0) + 1
    assert got == want


def test_digamma():
    assert topics.digamma(np.array([1.0, 0.5, 10.0])) == pytest.approx(
        [-0.5772156649015329, -1.9635100260214235, 2.251752589066721], abs=1e-10
    )
    x = np.array([1e-3, 0.2, 3.7, 500.0])
    assert topics.digamma(x + 1) - topics.digamma(x) == pytest.approx(1 / x, rel=1e-10)


def test_a_document_is_inferred_alone():
    rng = np.random.default_rng(2)
    sizes = [3, 1, 40, 7]
    owner = np.repeat(np.arange(4), sizes)
    words, n = rng.random((len(owner), 5)), rng.integers(1, 9, len(owner)).astype(float)
    gamma, expected = topics.infer(owner, n, words, 4, 0.2)
    assert expected.sum(axis=1) == pytest.approx(n)
    at = 0
    for d, size in enumerate(sizes):
        rows = slice(at, at + size)
        alone, own = topics.infer(np.zeros(size, int), n[rows], words[rows], 1, 0.2)
        assert alone[0] == pytest.approx(gamma[d], rel=1e-9) and own == pytest.approx(expected[rows], rel=1e-9)
        at += size


def strongest(learnt, terms, most=12):
    out = {}
    for r in learnt.strongest(terms, most).collect():
        out.setdefault((r.model, r.topic), []).append((r["rank"], r.term, r.weight))
    return {k: [t for _, t, _ in sorted(v)] for k, v in out.items()}


@pytest.mark.parametrize("limit", [None, 1500])
def test_planted_topics_are_found(titles, limit, monkeypatch):
    if limit:
        monkeypatch.setattr(topics, "BROADCAST_BYTES", limit)
    terms = topics.dictionary(titles, "tokens")
    words = written(topics.bags(titles, "tokens", terms, "index", "model"), "bags")
    learnt = topics.learn(words, "index", terms.count(), k=3, rounds=14, batch_share=0.8)
    for (model, topic), found in strongest(learnt, terms).items():
        assert max(sum(t[0] == c for t in found) for c in "xyz") >= 11, (model, topic, found)
    shares = learnt.shares(words, "index").collect()
    assert len(shares) == 900
    by = {}
    for r in shares:
        assert sum(r.shares) == pytest.approx(1)
        by.setdefault((r.model, r["index"] % 3), []).append(int(np.argmax(r.shares)))
    assert all(max(v.count(i) for i in range(3)) > 0.97 * len(v) for v in by.values())


def test_partitions_change_nothing(titles):
    terms = topics.dictionary(titles, "tokens")
    words = written(topics.bags(titles, "tokens", terms, "index", "model"), "bags")
    one, many = (topics.learn(words.repartition(p), "index", terms.count(), k=3, rounds=3, batch_share=0.2) for p in (1, 6))
    a, b = ({(r.model, r.term_id): r.weights for r in t.table.collect()} for t in (one, many))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-9) for k in a)


def _likelihood(bags, beta):
    """Mean log likelihood of a word under inferred shares and topics ``beta`` (term x topic, columns sum to 1)."""
    total = count = 0
    for words in bags:
        ids, n = np.array([w for w, _ in words]), np.array([c for _, c in words], float)
        gamma, _ = topics.infer(np.zeros(len(ids), int), n, beta[ids], 1, 0.2)
        total += (n * np.log(beta[ids] @ (gamma[0] / gamma[0].sum()))).sum()
        count += n.sum()
    return total / count


def test_as_good_as_the_driver_held_estimator(spark):
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = written(docs.select(F.col("doc_id").alias("index"), F.lit("all").alias("model"), F.split(F.lower("text"), r"\W+").alias("tokens")), "rows")
    terms = topics.dictionary(rows, "tokens")
    words = written(topics.bags(rows, "tokens", terms, "index", "model"), "bags")
    size = terms.count()
    number = {r.term: r.term_id for r in terms.collect()}
    bags = {}
    for r in words.collect():
        bags.setdefault(r["index"], []).append((r.term_id, r.n))
    learnt = topics.learn(words, "index", size)
    own = np.zeros((size, 5))
    for r in learnt.table.collect():
        own[r.term_id] = r.weights

    counts = CountVectorizer(inputCol="tokens", outputCol="counts", vocabSize=size).fit(rows)
    model = LDA(k=5, optimizer="online", featuresCol="counts", seed=42).fit(counts.transform(rows))
    other = np.zeros((size, 5))
    other[[number[t] for t in counts.vocabulary]] = model.topicsMatrix().toArray()
    mine, theirs = (_likelihood(bags.values(), b / b.sum(axis=0)) for b in (own, other))
    assert math.isfinite(mine) and mine > theirs - 0.02 * abs(theirs), (mine, theirs)


def test_no_documents(spark):
    rows = spark.createDataFrame([(1, "m", []), (2, "m", None)], "index long, model string, tokens array<string>")
    terms = topics.dictionary(rows, "tokens")
    words = written(topics.bags(rows, "tokens", terms, "index", "model"), "bags")
    learnt = topics.learn(words, "index", terms.count(), rounds=2)
    assert learnt.table.count() == 0 and learnt.strongest(terms, 5).count() == 0 and learnt.shares(words, "index").count() == 0


def test_titles_have_shares(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["ml_lda_shares"](spark, SMALL).collect()
    assert len({r["index"] for r in rows}) == len(rows) > 100
    assert all(sum(r[f"topic_{i}"] for i in range(5)) == pytest.approx(1, abs=1e-5) for r in rows)


def test_a_round_broadcasts_few_weights(spark, monkeypatch):
    """Terms beyond a round's broadcast meet their words by a shuffle, with the same rows."""
    rows = spark.range(300).select((F.col("id") % 50).alias("term_id"), F.lit(1).alias("model"), F.col("id").alias("index"))
    table = spark.range(50).select(F.col("id").alias("term_id"), F.lit(1).alias("model"), F.rand(1).alias("w"))
    want = sorted(map(tuple, topics.frequent_first(rows, table, 50, 88, "term_id", ["model", "term_id"]).collect()))
    assert topics.ROUND_BYTES * 2 * (topics.ROUNDS + 2) < 500 << 20
    monkeypatch.setattr(topics, "ROUND_BYTES", 10 * 88)
    found = topics.frequent_first(rows, table, 50, 88, "term_id", ["model", "term_id"])
    assert "Union" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == want
