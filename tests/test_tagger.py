"""The tagger against sums over all paths, and what its fit must keep."""

import itertools

import numpy as np
import pytest

from titleq.models import tagger
from titleq.session import written

TITLES = [
    "Red cotton shirt for men", "The quick dress and 2 shoes", "Shoes", "running shoe & bag", "beautiful bright lamp !",
    "", None, "sell quickly", "new new new", "a bag of 10 + 5",
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TITLES * 6)], "index long, title string")
    return written(tagger.tokens_of(df, "title", "index"), "tokens")


def all_paths(model, seq):
    """(likelihood, start, steps, shares, best path) by enumeration."""
    t = len(model.start)
    total, start, steps, shares, best = 0.0, np.zeros(t), np.zeros((t, t)), np.zeros((len(seq), t)), (0, None)
    for path in itertools.product(range(t), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[seq[0], path[0]]
        for i in range(1, len(seq)):
            p *= model.step[path[i - 1], path[i]] * model.emit[seq[i], path[i]]
        total += p
        start[path[0]] += p
        for i, s in enumerate(path):
            shares[i, s] += p
            if i:
                steps[path[i - 1], s] += p
        if p > best[0]:
            best = (p, path)
    return np.log(total), start / total, steps / total, shares / total, best[1]


def small_model(tags=4, classes=6):
    rng = np.random.default_rng(3)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return tagger.Model(None, norm(rng.random(tags), 0), norm(rng.random((tags, tags)), 1), norm(rng.random((classes, tags)), 0))


def test_forward_backward_equals_all_paths():
    model, rng = small_model(), np.random.default_rng(4)
    lengths = np.array([1, 2, 3, 3, 4, 5, 5, 2, 1, 6])
    seqs = rng.integers(0, 6, (10, 6))
    log, start, steps, shares = model.expect(seqs, lengths)
    best = model.best(seqs, lengths)
    want = [all_paths(model, seqs[i, :n]) for i, n in enumerate(lengths)]
    assert log == pytest.approx(sum(w[0] for w in want))
    assert start == pytest.approx(sum(w[1] for w in want))
    assert steps == pytest.approx(sum(w[2] for w in want))
    for i, n in enumerate(lengths):
        assert shares[i, :n] == pytest.approx(want[i][3]) and not shares[i, n:].any()
        assert tuple(best[i, :n]) == want[i][4]


def test_objective_never_falls(rows):
    _, objective = tagger.fit(rows, rounds=6, most=12)
    assert all(b >= a - 1e-7 * abs(a) for a, b in zip(objective, objective[1:])) and objective[-1] > objective[0] + 1


def test_partitions_and_chunks_change_nothing(rows, monkeypatch):
    model, objective = tagger.fit(rows, rounds=3, most=12)
    monkeypatch.setattr(tagger, "CELLS", 50)
    other, again = tagger.fit(rows.repartition(5), rounds=3, most=12)
    assert objective == pytest.approx(again) and model.emit == pytest.approx(other.emit)


def test_tags_keep_closed_classes_and_lengths(rows):
    model, _ = tagger.fit(rows, rounds=5)
    words = {r["index"]: (r.words, r.rules) for r in rows.collect()}
    got = {r["index"]: r.tags for r in tagger.tagged(rows, model, "index").collect()}
    assert got.keys() == words.keys()
    for i, tags in got.items():
        assert len(tags) == len(words[i][0])
        for tag, rule in zip(tags, words[i][1]):
            assert tag == rule if rule not in tagger.OPEN else tag in tagger.OPEN
    assert got[5] == got[6] == []
    assert got[0] == got[len(TITLES)]


def test_words_take_the_tag_of_their_places(spark):
    """A word that the rules call a noun stands where only verbs stand, and learns to be one."""
    nouns = ["lamp", "table", "garden", "window", "river"]
    verbs = ["running", "singing", "jumping", "melting"]
    rng = np.random.default_rng(1)
    titles = [f"the {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)}" for _ in range(300)]
    titles += [f"the {rng.choice(nouns)} blork the {rng.choice(nouns)}" for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "index long, title string")
    rows = written(tagger.tokens_of(df, "title", "index"), "tokens")
    assert set(rows.where("index = 320").first().rules) == {"FUNC", "NOUN"}
    model, _ = tagger.fit(rows, rounds=15)
    tags = tagger.tagged(rows.where("index = 320"), model, "index").first().tags
    assert tags == ["FUNC", "NOUN", "VERB", "FUNC", "NOUN"]


def test_no_rows(rows):
    model, objective = tagger.fit(rows.limit(0), rounds=2)
    assert len(objective) == 3 and tagger.tagged(rows.limit(0), model, "index").count() == 0


def test_tag_counts_of_every_title(spark):
    import __spark_entry__ as entry

    from .conftest import SMALL

    rows = entry.queries()["feat_hmm_tags"](spark, SMALL).collect()
    assert len({r["index"] for r in rows}) == len(rows) == 200
    assert all(0 <= r[f"freq_{k}"] <= 1 and (r[f"count_{k}"] > 0) == (r[f"freq_{k}"] > 0) for r in rows for k in ("num", "adj", "noun", "conj"))
    objective = [r.objective for r in entry.queries()["ml_hmm_tagger"](spark, SMALL).orderBy("round").collect()]
    assert len(objective) == 9 and all(b >= a - 1e-7 * abs(a) for a, b in zip(objective, objective[1:]))


def test_tokens_are_numbered_once(spark, monkeypatch):
    """The rounds read stored numbers; only the first scan looks at words."""
    rows = written(tagger.tokens_of(spark.createDataFrame([(1, "a red shoe"), (2, ""), (3, "2 red"), (4, None)], "index int, title string"), "title", "index"), "tokens")
    coded = tagger._coded(rows, tagger.frequent_words(rows, 2))
    assert coded.columns == ["numbers"]
    assert sorted(len(r.numbers) for r in coded.collect()) == [0, 0, 2, 3]
    seen = []
    inner = tagger._expected
    monkeypatch.setattr(tagger, "_expected", lambda r, m: (seen.append(r.columns), inner(r, m))[1])
    tagger.fit(rows, rounds=3)
    assert seen == [["numbers"]] * 4
