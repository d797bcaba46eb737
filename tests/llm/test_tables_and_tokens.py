"""Vectors, URLs and tokenizers against brute force and the public libraries."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest

from titleq.llm import graph_index, pieces, token_count, url_filter
from titleq.llm.common import BATCH_BYTES, map_texts

public_tokenizers = pytest.importorskip("public_tokenizers")

ODD = [
    None, "", "  ", "aaaa aaaaaaa", "ÀÉ İ ß ſ ﬁ Ⅷ 12345 don't I'LL 'S x's", "<|endoftext|> a<|startoftext|>b <|EndOfText|>",
    "漢字かな\U0001F600‍́é", "\t\n a b　c\x1c\x85d ", "É́K", "ﷺ", "\x01\x02", "x" * 5000, "!!??--  ...'''", "1２３", "▁ a▁b ▁▁",
    "<s> </s> <unk> <0x41>", " lead", "trail ", "two  blanks   three", "word " * 90_000,
]


def texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return [r.text for r in docs.select("text").collect()]


def test_token_counts_equal_library(spark, make):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = ODD + texts(spark)
    library = Tokenizer.from_file(path)
    want = [len(e.ids) for e in library.encode_batch([t or "" for t in own], add_special_tokens=False)]
    got = {r.doc_id: r for r in token_count.token_counts(make(list(enumerate(own)), extra=True), path).collect()}
    assert [got[i].n_tokens for i in range(len(own))] == want
    assert [got[i].n_bytes for i in range(len(own))] == [len((t or "").encode()) for t in own]
    assert token_count.token_counts(make([]), path).count() == 0


def test_parts_lose_nothing():
    for text in (b"", b"a b", b"w " * 900_000, b"x" * 3_000_000 + b" y", b"x" * 3_000_000):
        found = list(token_count.parts(text))
        assert b"".join(found) == text
        assert len(found) < 9


def test_piece_ids_equal_library(spark, make):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = ODD + texts(spark)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in pieces.encoded(make(list(enumerate(own)), extra=True), path).collect()}
    for i, t in enumerate(own):
        assert got[i].ids == library.encode(t or ""), t
        assert got[i].n_tokens == len(got[i].ids) and got[i].round_trip
    assert pieces.encoded(make([]), path).count() == 0


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number, value):
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def test_unigram_model(tmp_path):
    """A hand-made unigram model with byte fallback gives the best-scored pieces."""
    import sentencepiece

    table = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    table += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    table += [("▁a", -1.0, 1), ("b", -2.0, 1), ("ab", -2.5, 1), ("▁ab", -3.5, 1), ("▁", -2.0, 1), ("a", -2.2, 1), ("bb", -3.1, 1)]
    data = b""
    for text, score, kind in table:
        data += _field(1, _field(1, text.encode()) + _varint(2 << 3 | 5) + np.float32(score).tobytes() + _field(3, kind))
    data += _field(2, _field(3, 1) + _field(35, 1)) + _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, 0) + _field(5, 1))
    path = tmp_path / "own.model"
    path.write_bytes(data)
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    own = pieces.PieceTokenizer(str(path), library)
    cases = ["ab", "abb ab", "a é b", "bab", "x"]
    assert own.encode(cases) == library.encode(cases)
    assert own.decode(own.encode(cases)) == cases


def _brute(rows, k):
    vecs = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, x in vecs:
        if q % 20 == 0:
            found = sorted((-float((x * y).sum()), i) for i, y in vecs if i != q)
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.7 * rng.normal(size=16)).tolist()) for i in range(1500)]
    rows += [(i, rows[5][1]) for i in range(1500, 2000)]  # a quarter is one vector
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [None] + [1.0] * 15), (2060, [float("nan")] * 16), (2080, [1.0]), (None, rows[1][1]), (2101, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS shard", "3 AS id")
    usable = graph_index.usable(df, "vec_id", "embedding")
    found = graph_index.nearest(graph_index.index(usable, 21, shard_rows=700), usable.where("id % 20 = 0"), 20).collect()
    got = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.id, r.score))
    want = _brute([r for r in rows if r[1] is None or len(r[1]) == 16], 20)
    assert set(got) == set(want) and all(len(got[q]) == 20 for q in want)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.95
    exact = [q for q in want if rows[q][1] == rows[5][1]]
    assert exact and all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in exact[:5])


def test_neighbours_beside_one_very_long_vector(spark):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(2000, 32))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    rows[7] *= 5000
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    usable = graph_index.usable(df, "vec_id", "embedding")
    found = graph_index.nearest(graph_index.index(usable, 21), usable.where("id % 20 = 0"), 20).collect()
    want = _brute(list(enumerate(rows.tolist())), 20)
    hits = sum(r.id in {i for i, _ in want[r.query_id]} for r in found)
    assert len(found) == 20 * len(want) and hits >= 0.95 * len(found)


@pytest.mark.parametrize("kind", ["gaussian", "clusters"])
def test_recall_on_a_full_shard_of_any_lengths(kind):
    """One graph of a full shard; lengths as they come, or spread over clusters."""
    rng = np.random.default_rng(12)
    vectors = rng.normal(size=(graph_index.SHARD_ROWS, 64))
    if kind == "clusters":
        vectors = 0.4 * vectors + rng.normal(size=(200, 64))[rng.integers(0, 200, len(vectors))]
        vectors *= rng.lognormal(0, 0.5, len(vectors))[:, None]
    graph = graph_index.build(vectors)
    queries = vectors[::160]
    found = graph.best(np.hstack([queries, np.zeros((len(queries), 1))]).astype(np.float32), 21, graph_index.SEARCH_BEAM)
    score = np.where(found >= 0, np.einsum("ijk,ik->ij", vectors[np.maximum(found, 0)], queries), -np.inf)
    got = np.take_along_axis(found, np.argsort(-score, axis=1, kind="stable")[:, :20], axis=1)
    want = np.argsort(-(queries @ vectors.T), axis=1, kind="stable")[:, :20]
    recall = np.mean([len(set(a) & set(b)) / 20 for a, b in zip(got.tolist(), want.tolist())])
    assert recall >= 0.9, recall


def test_neighbours_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (7, [0.5, 0.5]), (3, [0.5, 0.5])]):
        usable = graph_index.usable(spark.createDataFrame(rows, schema), "vec_id", "embedding")
        found = graph_index.nearest(graph_index.index(usable, 21), usable.where("id % 20 = 0"), 20).collect()
        assert sorted((r.query_id, r["rank"], r.id) for r in found) == ([(0, 1, 3), (0, 2, 7)] if len(rows) > 2 else [])


URLS = [
    None, "", "no scheme", "http://net/", "http://net", "https://A.Example.NET/en/1", "http://example.net/fr/", "http://notnet/",
    "http://x.example.com/de/1?q", "http://example.com/de", "http://b.org/fr/", "http://b.org/fr/#x", "ftp://b.org?x=/fr/",
    "a://b://c/d", "http://", "http://h.example.com/en/" + "y" * 5000, "http://ü.net/ä",
]


def _rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [h + p for _, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def test_url_rules_equal_loops(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url").collect()
    urls = URLS + [r.url for r in pages]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 AS host", "'x' AS verdict")
    got = {r.page_id: r for r in url_filter.verdicts(df).collect()}
    kinds = {h + p: kind for kind, h, p in url_filter.RULES}
    for i, url in enumerate(urls):
        host, path, rule = _rule(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict == kinds[rule] if rule else got[i].verdict in ("allow", "block")
    ruled = [r for r in got.values() if r.rule]
    right = [(r.difference > 0) == (r.verdict == "allow") for r in ruled]
    assert np.mean(right) > 0.9


def test_url_likelihood_equals_loops():
    rng = np.random.default_rng(0)
    tables = rng.integers(0, 30, (url_filter.ORDER + 1, 2, url_filter.CELLS)).astype(float)
    rows = [b"http://a.b/c", b"", b"xx", b"http://a.b/c"]
    data = np.frombuffer(b"".join(rows), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    got = url_filter.log_likelihoods(data, bounds, tables)
    for row, value in zip(rows, got):
        alone = np.frombuffer(row, np.uint8)
        p = np.full(len(row), 1 / 256)
        for (context, seen), (all_, own) in zip(url_filter.contexts(alone, np.array([0, len(row)])), tables):
            for i in range(len(row)):
                p[i] = (min(own[seen[i]], all_[context[i]]) + url_filter.PRIOR * p[i]) / (all_[context[i]] + url_filter.PRIOR)
        assert value == pytest.approx(np.log(p).sum())


def test_url_contexts_are_counted_exactly(spark):
    """More distinct contexts than ``CELLS``: each has its own count, and unseen ones have none."""
    rng = np.random.default_rng(3)
    urls = ["http://" + "".join(rng.choice(list("abcdefghij/"), 30)) for _ in range(4000)]
    rows = [(u, i % 3 == 0, int(i % 5 == 0)) for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "url string, accepted boolean, side int")
    _, (places, tables) = url_filter._models(df)
    want = [collections.Counter(), collections.Counter()]
    for u, accepted, _ in rows:
        want[accepted].update(("^" * 5 + u)[i : i + 6] for i in range(len(u)))
    assert len(want[0]) > 2 * url_filter.CELLS
    unseen = "http://zzzzzz"
    for u in [*urls[:200], unseen]:
        (_, seen), = list(url_filter.contexts(np.frombuffer(u.encode(), np.uint8), np.array([0, len(u)]), places))[-1:]
        for kind in (0, 1):
            assert tables[kind][-1][1][seen].tolist() == [want[kind][("^" * 5 + u)[i : i + 6]] for i in range(len(u))]


def test_urls_without_rules(spark):
    df = spark.createDataFrame([(1, "http://a.b/c"), (2, None), (3, "")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.verdicts(df).collect()}
    assert got == {1: "allow", 2: "block", 3: "block"}
    assert url_filter.verdicts(df.limit(0)).count() == 0


def test_batches_are_bounded_by_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    before = spark.conf.get(key, None)
    texts = spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 10000) AS text")
    try:
        spark.conf.unset(key)
        got = [r["n"] for r in map_texts(texts, sizes, "n long").collect()]
        assert sum(got) == 3000 and max(got) * 10_000 < 2 * BATCH_BYTES
        spark.conf.set(key, "1m")
        map_texts(texts, sizes, "n long")
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_a_larger_beam_expands_no_node_again():
    """A query's beam doubles from what it met; each node is expanded once."""
    rng = np.random.default_rng(4)
    graph = graph_index.build(rng.normal(size=(1500, 64)))
    expanded = []

    class Edges:
        def __init__(self, edges):
            self.edges = edges

        def __getitem__(self, at):
            expanded.extend(at[at >= 0].tolist())
            return self.edges[at]

    graph.edges = Edges(graph.edges)
    found = graph.best(np.append(rng.normal(size=64), 0.0)[None].astype(np.float32), 21, graph_index.SEARCH_BEAM)
    assert (found >= 0).all() and len(expanded) > 2 * graph_index.SEARCH_BEAM
    assert len(set(expanded)) == len(expanded)
