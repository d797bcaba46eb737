"""Similarity scores against literal loops."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from titleq.operators import layout, lexicon, similarity
from titleq.session import written

VOCAB = [f"w{i}" for i in range(40)]
DIM = 6


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(11)
    out = []
    for i in range(25):
        title = list(rng.choice(VOCAB + ["oov"], size=int(rng.integers(0, 9))))
        des = list(rng.choice(VOCAB + ["oov"], size=int(rng.integers(0, 30))))
        out.append((i, [str(x) for x in title], [str(x) for x in des]))
    out.append((90, ["w1", "w2"], []))
    out.append((91, [], ["w1"]))
    out.append((92, ["w0"] * 6, ["w0"] * 7))
    out.append((93, [f"w{i}" for i in range(30)], [f"w{i % 40}" for i in range(90)]))
    return out


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(12)
    vecs = {w: rng.normal(size=DIM) for w in VOCAB}
    vecs["w3"] = np.zeros(DIM)
    return vecs


@pytest.fixture(scope="module")
def words(spark, texts):
    rows = [(i, " ".join(t), " ".join(d)) for i, t, d in texts]
    df = spark.createDataFrame(rows, "index long, title string, description string")
    split = lambda c: F.array_remove(F.split(c, " "), "")
    return similarity.side_words(df, split("title"), split("description"))


@pytest.fixture(scope="module")
def vectors(spark, table):
    rows = [(w, [float(x) for x in v]) for w, v in table.items()]
    df = spark.createDataFrame(rows, "vec_id string, vec array<double>")
    return similarity.WordVectors(df, F.col("token"), len(rows), DIM)


def cosine(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / n) if n else 0.0


def test_every_index_keeps_a_row(words, texts):
    assert words.select("index").distinct().count() == len(texts)


def _odd_texts(spark):
    """Rows whose index repeats or is null, texts that are null or empty, words of both texts."""
    rows = [
        (1, "b a b", "a c a é"), (1, "a", "b"), (2, None, "c c"), (2, "", None), (3, None, None), (None, "a a", "b"), (None, "", "a"),
        (4, "x", ""), (5, "b", "b"), (5, "", ""),
    ]
    df = spark.createDataFrame(rows, "index long, title string, description string")
    split = lambda c: F.array_remove(F.split(c, " "), "")
    return rows, df, split("title"), split("description")


def test_words_are_counted_as_in_a_loop(spark):
    rows, df, title, description = _odd_texts(spark)
    n, first = Counter(), {}
    for index, *texts in rows:
        for side, value in zip("td", texts):
            words = [w for w in (value or "").split(" ") if w]
            for at, w in enumerate(words):
                n[index, side, w] += 1
                first[index, side, w] = min(at, first.get((index, side, w), at))
            if not words:
                n[index, side, None] += 0
    got = [tuple(r) for r in similarity.side_words(df, title, description).collect()]
    assert len(got) == len(n)
    assert {r[:3]: r[3:] for r in got} == {k: (v, first.get(k)) for k, v in n.items()}
    pairs = [tuple(r) for r in similarity.paired_words(df, title, description).collect()]
    keys = {(index, w) for index, _, w in n}
    assert len(pairs) == len(keys)
    assert {r[:2]: r[2:] for r in pairs} == {(i, w): (n[i, "t", w], n[i, "d", w]) for i, w in keys}


def test_words_need_no_hash_table_of_a_task(spark):
    """Words are counted inside their index: grouped by words, a large task spills them all."""
    _, df, title, description = _odd_texts(spark)
    for words in (similarity.side_words(df, title, description), similarity.paired_words(df, title, description)):
        plan = words._jdf.queryExecution().executedPlan().toString()
        keys = [line.split("keys=[")[1].split("]")[0] for line in plan.splitlines() if "keys=[" in line]
        assert keys and all(k.split("#")[0] == "index" and "," not in k for k in keys)
        assert plan.count("Exchange") == 1
        assert plan.count("sort_array") == 1  # computed once


def test_pair_mean(words, texts, table, vectors):
    got = {r["index"]: r.w2v_score for r in similarity.pair_mean(words, vectors).collect()}
    for i, t, d in texts:
        sims = [cosine(table[x], table[y]) for x in t for y in d if x in table and y in table]
        if sims:
            assert got[i] == pytest.approx(np.mean(sims), abs=1e-9)
        else:
            assert got.get(i) is None


def test_mean_vector(words, texts, table, vectors):
    got = {r["index"]: r.sp_score for r in similarity.mean_vector_cosine(words, vectors).collect()}
    for i, t, d in texts:
        a = [table[x] for x in t if x in table]
        b = [table[x] for x in d if x in table]
        if a and b and np.linalg.norm(sum(a)) * np.linalg.norm(sum(b)):
            assert got[i] == pytest.approx(cosine(sum(a), sum(b)), abs=1e-9)
        else:
            assert got.get(i) is None


def test_both_vector_scores_at_once(words, vectors):
    both = {r["index"]: (r.w2v_score, r.sp_score) for r in similarity.vector_scores(words, vectors).collect()}
    pair = {r["index"]: r.w2v_score for r in similarity.pair_mean(words, vectors).collect()}
    mean = {r["index"]: r.sp_score for r in similarity.mean_vector_cosine(words, vectors).collect()}
    assert both.keys() == pair.keys() == mean.keys()
    for i, (a, b) in both.items():
        assert a == pytest.approx(pair[i]) and b == pytest.approx(mean[i])


def loop_profile(t, d, table):
    line = []
    for x in t:
        if x not in table:
            continue
        sims = sorted((cosine(table[x], table[y]) for y in d if y in table), reverse=True)
        if len(t) < 5:
            line += sims
        elif sims:
            line.append(np.mean(sims[:5]))
    line += [0.0] * (5 - len(line))
    return sorted(line, reverse=True)[:5]


@pytest.mark.parametrize("block, bytes_", [(512, layout.BROADCAST_BYTES), (4, 1)])
def test_top5_profile(words, texts, table, vectors, monkeypatch, block, bytes_):
    """Also with blocks of four words, where texts span many blocks, and without a broadcast."""
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(layout, "BROADCAST_BYTES", bytes_)
    got = {r["index"]: list(r[1:]) for r in similarity.top5_profile(words, vectors).collect()}
    assert len(got) == len(texts)
    for i, t, d in texts:
        assert got[i] == pytest.approx(loop_profile(t, d, table), abs=1e-9), i


def test_tfidf_corpus(words, texts):
    docs = [x for _, t, d in texts for x in (t, d)]
    df = Counter(w for x in docs for w in set(x))
    weight = {w: math.log((1 + len(docs)) / (1 + c)) + 1 for w, c in df.items()}
    scored = similarity.tfidf_corpus(words, F.lit(len(docs)))
    got = {r["index"]: r.tf_score for r in scored.collect()}
    for i, t, d in texts:
        a, b = ({w: n * weight[w] for w, n in Counter(x).items()} for x in (t, d))
        norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        want = sum(v * b.get(w, 0) for w, v in a.items()) / norm if norm else 0.0
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_tfidf_pair_of_equal_and_disjoint_texts(spark):
    rows = [(1, "a b b", "b b a"), (2, "a", "b"), (3, "", "b"), (4, "x x y", "x z")]
    df = spark.createDataFrame(rows, "index long, title string, description string")
    split = lambda c: F.array_remove(F.split(c, " "), "")
    words = similarity.side_words(df, split("title"), split("description"))
    got = {r["index"]: r.tf_pair_score for r in similarity.tfidf_pair(words).collect()}
    one, two = math.log(3 / 2) + 1, 1.0
    assert got[1] == pytest.approx(1.0) and got[2] == 0.0 and got[3] == 0.0
    want = 2 * two * two / (math.hypot(2 * two, one) * math.hypot(two, one))
    assert got[4] == pytest.approx(want)


def test_text_vector(spark, table, vectors):
    df = spark.createDataFrame([(1, "w1 w1 w2 oov"), (2, "oov")], "index long, t string")
    got = similarity.text_vector(df, F.split("t", " "), vectors).collect()
    assert [r["index"] for r in got] == [1] and got[0].known == 3
    assert np.allclose(got[0].vec, 2 * table["w1"] + table["w2"])


def test_topic_overlap(spark):
    terms = spark.createDataFrame(
        [(0, "a"), (0, "b"), (1, "b"), (1, "c"), (2, "z")], "topic int, term string"
    )
    df = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["q"]), (3, [])], "index long, w array<string>")
    out = lexicon.topic_overlap(df, "w", lexicon.topic_lists(terms))
    got = {r["index"]: (r.max_words_topic, r.topic_num) for r in out.collect()}
    assert got == {1: (2, 2), 2: (0, 0), 3: (0, 0)}


def test_lexicon_counts(spark):
    titles = spark.createDataFrame(
        [(1, ["red", "acme", "red"]), (2, []), (3, ["acme"] * 50)], "index long, tokens array<string>"
    )
    lists = {
        "color": spark.createDataFrame([("red",)], "token string"),
        "brand": spark.createDataFrame([("acme",), ("red",)], "token string"),
    }
    got = {r["index"]: r for r in lexicon.lexicon_counts(titles, lists).collect()}
    assert (got[1].count_color, got[1].count_brand, got[1].count_chars) == (2, 3, 10)
    assert (got[2].count_words, got[2].freq_color) == (0, 0.0)
    assert got[3].count_brand == 50 and got[3].freq_brand == 1.0


def test_top_terms_breaks_ties_by_word(spark):
    rows = [("g", w) for w in "b b a a c d".split()] + [("h", "x")]
    df = spark.createDataFrame(rows, "lang string, token string")
    got = lexicon.top_terms(df, "lang", 3).orderBy("topic", "rank").collect()
    assert [(r.topic, r.term) for r in got] == [("g", "a"), ("g", "b"), ("g", "c"), ("h", "x")]


def test_every_feature_of_the_clarity_table_varies(spark):
    """No feature is the same in all rows, the lexicon counts among them."""
    import __spark_entry__ as entry
    from titleq.schemas import CLARITY_FEATURES

    frame = entry.queries()["feat_clarity_frame"](spark, "/root/testdata/sf0.01")
    seen = frame.agg(*[F.count_distinct(c).alias(c) for c in CLARITY_FEATURES]).first().asDict()
    flat = {c for c, n in seen.items() if n < 2}
    assert not flat & {"count_color", "freq_color", "count_brand", "freq_brand", "count_noun", "title_des_dup", "tf_score"}


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_lexicon_counts_by_either_lookup(spark, limit, monkeypatch):
    monkeypatch.setattr(lexicon, "BROADCAST_BYTES", limit)
    titles = spark.createDataFrame([(1, ["red", "shoe", "red"]), (2, []), (3, None), (4, ["acme", "red"])], "index long, tokens array<string>")
    lists = {"color": spark.createDataFrame([("red",)], "token string"), "brand": spark.createDataFrame([("acme",), ("red",)], "token string")}
    got = {r["index"]: (r.count_color, r.count_brand, r.count_words, r.count_chars, r.freq_color) for r in lexicon.lexicon_counts(titles, lists).collect()}
    assert got == {1: (2, 2, 3, 10, 2 / 3), 2: (0, 0, 0, 0, 0.0), 3: (0, 0, 0, 0, 0.0), 4: (1, 2, 2, 7, 0.5)}


@pytest.mark.parametrize("numbered", [False, True])
@pytest.mark.parametrize("batch", [3, 10_000])
def test_gathered_sums_equal_broadcast_sums(spark, words, table, monkeypatch, numbered, batch):
    """With a table too large for a broadcast the scores stay; ids may repeat, cells be null, keys be null."""
    rows = [(w, [float(x) for x in v]) for w, v in table.items()]
    rows += [("w5", [1.0, None, 2.0, 0.0, 1.0, 3.0]), ("w6", None), ("w7", [float("nan")] + [1.0] * 5), ("w8", rows[8][1])]
    known = spark.createDataFrame(rows, "vec_id string, vec array<double>")
    key = F.col("token")
    if numbered:
        known, key = known.withColumn("vec_id", F.crc32("vec_id")), F.crc32("token")
    vecs = similarity.WordVectors(known, key, len(rows), DIM)
    more = spark.createDataFrame([(None, "t", "w1", 2, 0), (None, "d", "w2", 1, 0), (95, "t", "w6", 1, 0), (95, "d", "w1", 1, 0), (96, "t", "w7", 1, 0)], "index long, side string, token string, n long, first int")
    all_words = words.unionByName(more)
    texts = all_words.where("side = 't'").groupBy("index", "token").agg(F.sum("n").alias("n")).where("token IS NOT NULL")

    def results():
        scores = similarity.vector_scores(all_words, vecs)
        sums = vecs.summed(texts, "index", columns=("vec", "unit"))
        rounded = [F.transform(c, lambda x: F.round(x, 9)).alias(c) for c in ("vec", "unit")]
        scores = scores.select("index", *[F.round(c, 9).alias(c) for c in ("w2v_score", "sp_score")])
        return [sorted(map(repr, df.collect())) for df in (scores, sums.select("index", "known", *rounded))]

    want = results()
    monkeypatch.setattr(similarity, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(similarity, "GROUP_WORDS", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = results()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [[r.replace("-0.0,", "0.0,") for r in g] for g in got] == [[r.replace("-0.0,", "0.0,") for r in w] for w in want]


def test_gathered_words_travel_without_vectors(spark, monkeypatch):
    """A vector is sent once to a group of texts, not once for each word."""
    rows = spark.range(2000).select((F.col("id") % 500).alias("index"), F.lit("w").alias("token"), F.lit(1).alias("n"))
    vecs = spark.createDataFrame([("w", [1.0, 2.0])], "vec_id string, vec array<double>")
    monkeypatch.setattr(similarity, "BROADCAST_BYTES", 0)
    out = similarity.WordVectors(vecs, F.col("token"), 1, 2).summed(rows, "index")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Aggregate [_group" in plan
    assert {(r.known, tuple(r.vec)) for r in out.collect()} == {(4, (4.0, 8.0))}


def test_copies_of_the_vectors_grow_as_the_words():
    """Ten times the words and vectors: no more than about ten times the vectors are sent to groups."""
    sent = [similarity.group_count(n * 140_000_000, n * 100_000, 200, 12) * n * 100_000 for n in (6, 60, 600)]
    assert sent[1] <= 12 * sent[0] and sent[2] <= 12 * sent[1]


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_pairs_give_the_scores_of_side_words(spark, words, table, tmp_path, monkeypatch, limit):
    """Words paired before they are stored: the same scores, and no shuffle of the stored words by word and text."""
    monkeypatch.setattr(similarity, "BROADCAST_BYTES", limit)
    vecs = similarity.WordVectors(spark.createDataFrame([(w, [float(x) for x in v]) for w, v in table.items()], "vec_id string, vec array<double>"), F.col("token"), len(table), DIM)
    similarity.paired(words).write.parquet(str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs"))

    def results(rows):
        long = rows.withColumn("token", F.when(F.length("token") >= 3, F.col("token")))
        scores = similarity.vector_scores(rows, vecs).join(similarity.tfidf_corpus(long, F.lit(50)), "index", "outer")
        return sorted(map(repr, scores.select("index", *[F.round(c, 9).alias(c) for c in ("w2v_score", "sp_score", "tf_score")]).collect()))

    assert results(pairs) == results(words)
    stored = []
    monkeypatch.setattr(similarity, "written", lambda df, name, *by: stored.append(name) or written(df, name, *by))
    similarity.tfidf_corpus(pairs, F.lit(50)).collect()
    assert stored == ["terms"]


def test_unit_vectors_of_a_group_are_not_stored():
    """One copy of the vectors is held, and the batches they came in are let go."""
    vec = pa.array([[3.0, 4.0], [0.0, 0.0]], pa.list_(pa.float64()))
    parts = [pa.RecordBatch.from_arrays([pa.array([7, 9], pa.int64()), vec], names=["vec_id", "vec"])]
    held = similarity._Held(parts, 2, ("vec", "unit"))
    assert not parts and list(held.sums) == ["vec"]
    found = held.weighted("unit", held.places(pa.array([9, 7], pa.int64())), np.array([1.0, 5.0]))
    assert np.allclose(found, [[0.0, 0.0], [3.0, 4.0]])


def test_copies_of_the_vectors_are_no_more_bytes_than_the_words():
    """At 6 GB the float vectors sent to groups take less than the words sent with them, 8 bytes each."""
    words, vecs = 826_000_000, 615_384
    assert similarity.group_count(words, vecs, 200, 12) * vecs * 4 * 64 <= 8 * words


def test_float_vectors_travel_and_are_held_as_floats(spark, monkeypatch):
    """Their sums are those of the same numbers as doubles, equal ids included."""
    rows = [("w", [0.1, 0.2]), ("v", [0.3, 0.7]), ("v", [0.1, 0.1])]
    words = spark.createDataFrame([(1, "w", 3), (1, "v", 1), (2, "v", 2)], "index long, token string, n long")
    monkeypatch.setattr(similarity, "BROADCAST_BYTES", 0)

    def results(table):
        out = similarity.WordVectors(table, F.col("token"), 3, 2).summed(words, "index", columns=("vec", "unit"))
        return out, sorted(map(tuple, out.collect()))

    floats = spark.createDataFrame(rows, "vec_id string, vec array<float>")
    plan, got = results(floats)
    assert got == results(floats.withColumn("vec", F.col("vec").cast("array<double>")))[1]
    assert "cast(vec" not in plan._jdf.queryExecution().optimizedPlan().toString()
    vec = pa.array([[0.5, 1.0]], pa.list_(pa.float32()))
    held = similarity._Held([pa.RecordBatch.from_arrays([pa.array(["w"]), vec], names=["vec_id", "vec"])], 2, ("vec",))
    assert held.sums["vec"].dtype == np.float32


def test_neighbouring_words_of_a_key_are_one_row(monkeypatch):
    monkeypatch.setattr(similarity, "PACK", 2)
    cells = {"k": [1, 1, 1, None, None, 2, 1], "vec_id": ["a", "b", "c", "d", "e", "f", "g"], "_w0": [1.0, None, 2.0, 3.0, 4.0, 5.0, None]}
    batch = pa.RecordBatch.from_pydict(cells)
    (packed,) = similarity._pack("k", ["_w0"])([batch])
    assert packed.column("k").to_pylist() == [1, 1, None, 2, 1]
    assert packed.column("vec_ids").to_pylist() == [["a", "b"], ["c"], ["d", "e"], ["f"], ["g"]]
    assert similarity._unpacked(packed, "k", ["_w0"]).to_pydict() == cells
    assert similarity._unpacked(packed.slice(1, 3), "k", ["_w0"]).to_pydict() == {c: v[2:6] for c, v in cells.items()}


def test_terms_of_a_small_share_of_the_corpus_do_not_travel(spark, tmp_path, monkeypatch):
    """5,000 terms of equal shares: their weights fit a broadcast, so no stored word is shuffled by term."""
    rows = spark.range(20_000).select((F.col("id") % 100).alias("index"), (F.col("id") % 5000).cast("string").alias("token"), F.lit(1).alias("n_t"), F.lit(1).alias("n_d"))
    rows.write.parquet(str(tmp_path / "pairs"))
    asked = []
    monkeypatch.setattr(similarity, "split_lookup", lambda *a, **b: asked.append((b["freq"], b["parts"])) or layout.split_lookup(*a, **b))
    out = similarity.tfidf_corpus(spark.read.parquet(str(tmp_path / "pairs")), F.lit(200))
    assert {round(r.tf_score, 9) for r in out.collect()} == {1.0}
    (freq, parts), = asked
    assert layout.hot_keys(freq, "token", parts).count() == 5000 and parts * 200 <= layout.BROADCAST_BYTES


def test_top5_profile_moves_words_without_vectors(words, texts, table, vectors, monkeypatch):
    """No row of a word carries its vector: each group gets a vector once."""

    def refused(*_):
        raise AssertionError("vectors were joined to words")

    monkeypatch.setattr(similarity.WordVectors, "attach", refused)
    sent = {}
    dealt = similarity.WordVectors.dealt

    def kept(self, *args):
        sent["rows"] = written(dealt(self, *args), "dealt")
        return dealt(self, *args)

    monkeypatch.setattr(similarity.WordVectors, "dealt", kept)
    got = {r["index"]: list(r[1:]) for r in similarity.top5_profile(words, vectors).collect()}
    assert all(got[i] == pytest.approx(loop_profile(t, d, table), abs=1e-9) for i, t, d in texts)
    with_vector = sent["rows"].where(F.size("vec") > 0)
    assert with_vector.where("_kind = 1").count() == 0
    assert with_vector.groupBy("_group", "vec_id").count().where("count > 1").count() == 0
