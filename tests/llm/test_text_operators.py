"""Operators on documents against literal loops, with nulls, ties, repeats and odd columns."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from titleq.llm import anchors, decontam, golay, lang_id, mixing, quality
from titleq.llm.common import remainder
from titleq.llm.components import components

from .conftest import WORDS


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "x", "é"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (3, 49, 50, 51, 120, 300, 700)]
    passage = prose(rng, 64)
    out = list(base)
    out += [base[4], base[4], base[2], base[1]]  # exact copies
    out += [prose(rng, 30) + " " + passage + " " + prose(rng, 20) for _ in range(6)]
    out += [passage, passage.replace(" ", "\n\t"), passage.upper(), passage + " " + passage]
    near = base[6].split()
    for i in range(8):
        near[i * 9] = "changed"
        out.append(" ".join(near))
    out += [None, "", " \n\t", "12 34", "w " * 80, "long" * 50_000, "é" * 3000 + " z"]
    rows = [(100 - i, t) for i, t in enumerate(out)]
    return [*rows, rows[5], rows[5], (None, base[5]), (None, None), (rows[7][0], "other text of one id")]


def key(x):
    return math.inf if x is None else x


def test_substring_dedup_equals_loops(make, rows):
    least = {}
    for d, t in sorted(rows, key=lambda r: key(r[0])):
        w = (t or "").encode().split()
        for i in range(len(w) - 49):
            least.setdefault(tuple(w[i : i + 50]), key(d))
    want = collections.Counter()
    for d, t in rows:
        w = (t or "").encode().split()
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 49):
            if least[tuple(w[i : i + 50])] < key(d):
                gone[i : i + 50] = True
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        want[d, len(w), int(gone.sum()), hashlib.sha256(left).hexdigest()] += 1
    got = anchors.removals(make(rows, extra=True)).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert sum(n for _, _, n, _ in want) > 500


def test_substring_dedup_cuts_texts(make, rows):
    docs = make(rows, extra=True)
    cut = anchors.without_repeats(docs)
    assert cut.columns == docs.columns
    out = cut.select("doc_id", "text").collect()
    assert len(out) == len(rows)
    short = {d for d, t in rows} - {d for d, t in rows if len((t or "").split()) >= 50}
    assert all(r.text in [t for d, t in rows if d == r.doc_id] for r in out if r.doc_id in short and r.doc_id is not None)


def test_cover_meets_every_distance():
    apart = {(a - b) % anchors.PERIOD for a in anchors.COVER for b in anchors.COVER}
    assert apart == set(range(anchors.PERIOD))


def prints(text):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] * bool(w)
    sums = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p, 42)
        for b in range(64):
            sums[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * sums[b] > len(parts))


def test_simhash_groups_equal_loops(make, rows):
    fps = [prints(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), math.inf), key(d))
    want = collections.Counter((d, fps[i], least[find(i)]) for i, (d, _) in enumerate(rows))
    got = golay.near_groups(make(rows, extra=True)).collect()
    assert collections.Counter((r.doc_id, r.fp & (2**64 - 1), key(r.component_id)) for r in got) == want
    assert len(set(least.values())) < len(rows) - 8


def test_golay_keys_meet(spark):
    rng = np.random.default_rng(1)
    errors = golay._error_of_syndrome()
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    keys = []
    for x in (a, b):
        row, k = golay.fuzzy_keys(x, errors)
        keys.append(collections.defaultdict(set))
        for r, v in zip(row.tolist(), k.tolist()):
            keys[-1][r].add(v)
    assert all(keys[0][i] & keys[1][i] for i in range(len(a)))
    assert np.bitwise_count(errors).max() == 3


def test_blocks_lose_no_tie(spark):
    rng = random.Random(2)
    fps = list({sum(1 << b for b in rng.sample(range(6), rng.randint(0, 3))) ^ (rng.choice([0, 0x7FFF]) << 40) for _ in range(400)})
    df = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, node long")
    few, many = (
        {(r.node, r.root) for r in components(golay.links(df, block=b)).collect()} for b in (7, 5000)
    )
    assert few == many and many


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (100, 102), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def items(text):
    out, word = [], ""
    for ch in (text or "") + " ":
        ch = ch.lower() if "A" <= ch <= "Z" else ch
        if ch.isascii() and not (ch.isdigit() or "a" <= ch <= "z"):
            if word:
                out.append(word)
            word = ""
        else:
            word += ch
    return out


def test_decontamination_equals_loops(spark, make, rows):
    texts = dict(rows)
    bench = [(1, " ".join(texts[96].split()[10:40])), (20, "12"), (3, "34, 12"), (4, None), (5, "--"), (None, texts[94][:200]), (1, texts[96][300:500]), (7, "éé of the")]
    benchmark = spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "'x' AS doc_id")
    wins = collections.defaultdict(set)
    for item, t in bench:
        w = items(t)
        for i in range(max(len(w) - 12, 1) if w else 0):
            wins[tuple(w[i : i + 13])].add(item)
    want = collections.Counter()
    for d, t in rows:
        w, hit, found = items(t), set(), set()
        for size in {len(x) for x in wins}:
            for i in range(len(w) - size + 1):
                if (own := wins.get(tuple(w[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    found |= own
        ids = tuple(sorted(str(x) for x in found if x is not None))
        want[d, len(w), len(hit), ids, bool(hit) and 20 * len(hit) >= len(w)] += 1
    docs = make(rows, extra=True)
    got = decontam.contamination(docs, benchmark).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.items), r.contaminated) for r in got) == want
    kept = decontam.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert kept.count() == sum(n for k, n in want.items() if not k[-1])


def test_language_of_odd_texts(make):
    rng = random.Random(3)
    german = "der die und das ist nicht mit sich auf für eine".split()
    learn = [(i, prose(rng, 40), "en") for i in range(60)] + [(100 + i, " ".join(rng.choices(german, k=40)), "de") for i in range(60)]
    learn += [(300, None, "en"), (301, "ohne Sprache", None)]
    docs = make(learn, extra=True)
    model = lang_id.fit(docs, remainder(3) != 1)
    assert model.languages == ["de", "en"]
    odd = [(1, None), (1, ""), (2, "123 !?"), (3, "der die das nicht für eine"), (4, "the of and was not"), (5, "the " * 300_000), (None, "x")]
    got = lang_id.predict(make(odd, extra=True), model, "doc_id").collect()
    assert [r.lang_pred for r in got][:6] == ["und", "und", "und", "de", "en", "en"]
    assert all(0 <= r.score <= 1 for r in got)
    kept = lang_id.with_language(make(odd, extra=True), model)
    assert kept.count() == 4 and "fp" in kept.columns


def test_language_without_training(make):
    empty = make([])
    model = lang_id.fit(empty, F.lit(True))
    got = lang_id.predict(make([(1, "word")]), model, "doc_id").collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]


def test_texts_stay_if_no_language_is_known(make):
    docs = make([(1, "the cat", None), (2, None, None), (3, "", None), (4, "12 !?", None), (5, "der Hund", None)])
    model = lang_id.fit(docs, F.lit(True))
    assert sorted(r.doc_id for r in lang_id.with_language(docs, model).collect()) == [1, 5]


@pytest.mark.parametrize("n", [2, 3, 6, 7, 20])
def test_codewords_differ(n):
    code = lang_id.codebook(n).astype(int)
    apart = (code.shape[1] - code @ code.T) // 2
    assert len(code) == n and apart[~np.eye(n, dtype=bool)].min() >= 1


def test_quality_learns_and_scores_everything(spark, make):
    rng = random.Random(4)
    good = [(i, prose(rng, 80)) for i in range(150)]
    bad = [(1000 + i, "!! ".join(prose(rng, 60).upper().split())) for i in range(150)]
    odd = [(5000, None), (5001, ""), (None, "x"), (5002, "y" * 100_000)]
    labels = spark.createDataFrame([(d, int(d < 1000)) for d, _ in good + bad] + [(5000, 1), (7, None), (9999, 0)], "doc_id long, label int")
    docs = make(good + bad + odd, extra=True)
    got = quality.quality_scores(docs, labels, remainder(4) != 2).collect()
    assert len(got) == 304 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by = {r.doc_id: r.score for r in got}
    held = [d for d, _ in good + bad if zlib.crc32(str(d).encode()) % 4 == 2]
    assert np.mean([(by[d] > 0.5) == (d < 1000) for d in held]) > 0.95
    none = quality.quality_scores(docs, labels.limit(0), F.lit(True)).collect()
    assert {r.score for r in none} == {0.5}


def test_isotonic_curve_rises():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 9, 200)
    x, y = quality.pool(counts, rng.binomial(counts, np.linspace(0.1, 0.9, 200)), np.arange(200.0))
    assert (np.diff(x) > 0).all() and y[-1] > y[0]


def test_lm_counts_equal_loops_and_bits_add_up(make):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(0, 60)), rng.choice(["en", "de", None])) for i in range(120)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "A" * 3000 + " bé", "en"), (None, "of the", None), rows[3], rows[3]]
    got = mixing.scores(make(rows, extra=True), remainder(7) == 2).collect()
    train = collections.Counter()
    for d, t, _ in rows:
        if zlib.crc32(str("" if d is None else d).encode()) % 7 != 2:
            train.update([*(t or "").encode().lower().split(), b""])
    total, distinct = sum(train.values()), len(train)
    want = collections.Counter()
    for d, t, _ in rows:
        w = [*(t or "").encode().lower().split(), b""]
        base = sum(math.log10((train[x] + 1) / (total + distinct + 1)) for x in w)
        want[d, zlib.crc32(str("" if d is None else d).encode()) % 7 == 2, len(w), sum(train[x] > 0 for x in w), total, round(base, 6)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)


def test_mixed_probabilities_add_to_one():
    """After any word's bytes, the probabilities of all bits' two sides are one; shared bytes agree."""
    rng = np.random.default_rng(0)
    tables = rng.integers(0, 5, (2, int(mixing.SPLITS[-1]))).astype(np.float32)
    weights = rng.normal(0.2, 0.1, (mixing.GATES, mixing.INPUTS))
    seen = rng.random((2, mixing.GATES, mixing.LEVELS)) * 9
    words = sorted([b"", b"a", b"ab", b"abc", b"abd", "é".encode(), b"abcabc"])

    def logs(group):
        own = mixing.Words(group, np.zeros(len(group), np.int64))
        x, gate = mixing.inputs(own, tables, False)
        p = mixing.refined(mixing.mixed(x, gate, weights), gate, seen)
        return own.totals(np.log(np.where(own.bits, p, 1 - p)).sum(axis=1))

    together = logs(words)
    assert np.allclose(together, [logs([w])[0] for w in words])
    singles = [bytes([b]) for b in range(256) if b != 0x20]
    first = logs([b""])[0]
    one = mixing.Words([b"\x00"], np.zeros(1, np.int64))
    assert one.bits.shape == (2, 8) and np.exp(first) < 1 and np.exp(logs(singles)).sum() < 1


def test_every_training_word_counts_in_whole_word_contexts(spark, monkeypatch):
    """Rare words too, and over the edges of blocks: as a loop over all words counts them."""
    monkeypatch.setattr(mixing, "CHUNK", 32)
    rng = random.Random(8)
    counts = {(w, k): rng.choice([0, 1, 1, 1, 7]) for w in {"".join(rng.choices("abcé", k=rng.randint(0, 6))) for _ in range(900)} for k in (0, 1) if rng.random() < 0.7}
    want = collections.Counter()
    for (w, k), n in counts.items():
        data = w.encode() + b" "
        for i, byte in enumerate(data):
            for step in range(8):
                want[k, data[:i], step, byte >> (8 - step), byte >> (7 - step) & 1] += n
    rows = [(w, [(k, counts[w, k]) for k in (0, 1) if (w, k) in counts]) for w in {w for w, _ in counts}]
    table = [(w, sum(n for _, n in own), 9, [k for k, _ in own], [n for _, n in own]) for w, own in rows]
    df = spark.createDataFrame(table, "token string, c long, n long, classes array<int>, counts array<long>").repartition(5)
    blocks, slots = mixing.with_shared(mixing.word_blocks(df))
    batches = blocks.toArrow().combine_chunks().to_batches()
    checked = 0
    for r in (r for b in batches for r in mixing._rows(b)):
        own, _, (zeros, ones), kind, row = mixing._read_block(r, slots)
        words = r["tokens"].to_pylist()
        place = np.cumsum(own.counts) - own.counts
        for e, (w, k) in enumerate(zip((words[i] for i in row), kind)):
            data = w.encode() + b" "
            for j in range(own.counts[e]):
                i = own.shared[e] + j
                for step in range(8):
                    node = (int(k), data[:i], step, data[i] >> (8 - step))
                    assert (zeros[place[e] + j, step], ones[place[e] + j, step]) == (want[(*node, 0)], want[(*node, 1)])
                    checked += 1
    assert blocks.count() > 10 and checked > 10_000


def test_empty_tables(spark, make):
    empty = make([])
    benchmark = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, label int")
    assert anchors.removals(empty).count() == 0
    assert golay.near_groups(empty).count() == 0
    assert decontam.contamination(empty, benchmark).count() == 0
    assert decontam.contamination(make([(1, "a b")]), benchmark).first().contaminated is False
    assert quality.quality_scores(empty, labels, F.lit(True)).count() == 0
    assert mixing.scores(empty, F.lit(False)).count() == 0


def test_repeats_are_cut_whatever_the_columns_are_called(make, rows):
    df = make(rows)
    names = ("_cut_id", "_CUT_ROW", "_cut_kept", "_cut_id_", "copy", "_row", "a.b")
    odd = df.select("*", *[F.lit("x").alias(n) for n in names])
    got = anchors.without_repeats(odd)
    assert got.columns == odd.columns
    plain = collections.Counter((r.doc_id, r.text) for r in anchors.without_repeats(df).collect())
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == plain
