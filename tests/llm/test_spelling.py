"""Spelling variants against literal loops."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from titleq.llm import spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def literal(rows, loss=199, letters=6, seen=5):
    counts = collections.Counter()
    for doc_id, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in word)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % loss == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += len(word) >= letters
    counts = {w: n for w, n in counts.items() if n >= seen}
    out = {}
    for w, n in counts.items():
        others = sorted((-counts[x], x) for x in counts if near(w, x))
        form = others[0][1] if others and -others[0][0] >= 5 * n else None
        out[w] = [w, n, len(others), form, counts.get(form), form]
    for w in out:
        root = w
        while out[root][3]:
            root = out[root][3]
        out[w][5] = root
    return sorted(map(tuple, out.values()))


def result(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    letter = lambda: rng.choice("abcdeéÿ÷")
    base = ["".join(letter() for _ in range(n)) for n in (5, 6, 6, 6, 7, 7, 8, 9, 9, 12, 13, 40)]
    words = list(base)
    for _ in range(260):
        w = rng.choice(words[-40:] + base)
        i = rng.randrange(len(w))
        words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + letter() + w[i:], w[:i] + letter() + w[i + 1 :]]))
    texts = [" ".join([w.upper() if rng.random() < 0.2 else w] * rng.choice([1, 4, 5, 6, 30, 150, 800])) for w in words]
    texts += [None, "", "1 2 _", "aaaaaa-bbbbbb " * 5, "Z" * 3000 + " " + "z" * 2999, ("z" * 2999 + " ") * 5, ("Z" * 3000 + "\n") * 30, "ÉÈÀÀÉÈ éèààéè " * 6]
    rows = [(10_000 + i, t) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, texts[4]), (None, None), (rows[5][0], texts[6])]


def test_equals_loops(make, rows):
    want = literal(rows)
    assert sum(r[3] is not None for r in want) > 20 and any(r[5] != r[3] for r in want if r[3])
    assert result(spelling.variants(make(rows, extra=True))) == want


def test_blocks_and_losses(make, rows):
    want = literal(rows, loss=3)
    assert result(spelling.variants(make(rows).repartition(6), loss=3, block=4)) == want


def test_empty_tables(make):
    assert result(spelling.variants(make([]))) == []
    assert result(spelling.variants(make([(1, None), (2, ""), (3, "rare words only")]))) == []


def test_index_equals_distance():
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(6, 9))) for _ in range(300)})
    words += ["abc" * 40, "abc" * 40 + "a", "abc" * 39 + "ab"]
    counts = np.array([rng.randrange(5, 9) for _ in words])
    zero = np.zeros(len(words), int)
    for half in (3, 4, 60, 59):
        for ending in (False, True):
            row, number, best = spelling.near_words(words, counts, zero, zero + half, zero == (0 if ending else 1), zero - 1)
            got = {words[i]: (n, words[b]) for i, n, b in zip(row, number, best)}
            for a in words:
                want = []
                for b, n in zip(words, counts):
                    if near(a, b) and min(len(a), len(b)) // 2 == half and not (ending and a[:half] == b[:half]):
                        want.append((-n, b))
                assert got.get(a) == ((len(want), min(want)[1]) if want else None)


def test_long_paths_reach_their_root(spark):
    pairs = [(f"w{i:02}", f"w{i + 1:02}") for i in range(21)]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(pairs, "word string, form string")).collect()}
    assert got == {a: "w21" for a, _ in pairs}
