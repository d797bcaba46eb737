"""Alignment of two tokenizers against the libraries on whole texts and literal loops."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from titleq.llm import alignment

from ..conftest import SMALL

PATHS = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letters = alignment.byte_letters()
    a_bytes = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}
    b_bytes = {}
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        b_bytes[i] = bytes([int(piece[1:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(text):
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if b"".join(a_bytes[i] for i in x) != whole or b"".join(b_bytes[i] for i in y) != whole:
            return [], []
        return [(i, len(a_bytes[i])) for i in x], [(i, len(b_bytes[i])) for i in y]

    return tokens


def literal(rows, tokens):
    found, counts = [], collections.Counter()
    for doc_id, text in rows:
        sides = []
        for side in tokens(text or ""):
            end, out = 0, []
            for i, width in side:
                end += width
                out.append((i, end))
            sides.append(out)
        a, b = sides
        links = [(i, j) for j, end in b for i, at in a if at == end] if len(a) < 3000 else [
            (dict((e, i) for i, e in a)[end], j) for j, end in b if end in {e for _, e in a}
        ]
        counts.update(links)
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        groups, before = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, e in s if before < e <= cut) for s in sides) if len(a) < 3000 else "")
            before = cut
        found.append((doc_id, len(a), len(b), len(cuts), links, ";".join(groups)))
    best = collections.defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    out = []
    for doc_id, n_a, n_b, n_groups, links, groups in found:
        sha = hashlib.sha256(groups.encode()).hexdigest() if n_a and n_a < 3000 else ""
        n_best = sum(counts[x] == best[x[1]] for x in links)
        out.append((-1 if doc_id is None else doc_id, n_a, n_b, n_groups, len(links), n_best, sum(counts[x] for x in links), sha))
    return sorted(out)


def result(df):
    rows = [tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()]
    return sorted((-1 if r[0] is None else r[0], *r[1:-1], r[-1] if r[1] < 3000 else "") for r in rows)


ODD = [
    "Hello world", "hello  world ", " lead", "  ", " ", "\n", "a\n b\n\n c", "a \n b", "tab\tsep \t x", "don't we'll I'D", "naïve café — ünï",
    "日本語 テキスト", "x▁y", "▁", "🙂 smile 🙂🙂", "<|endoftext|> <s> </s> <unk> <0x41>", "1234567890 12,5 %", "a b   c  d",
    "\x00 nul \x1c x \x1c  y", "é ᠎  z", "A" * 2000, "trailing   ", "ﬁ ﬀ ½ Ⅷ", "\r\n\r\n  x", "﻿bom �", "é" * 50 + " " + "é " * 20,
]


def test_equals_loops(make, libraries):
    rng = random.Random(8)
    parts = [" ", "  ", "\n", "\t", "the", "ing", "Ünder", "foo_bar", "x9", "...", "日", "'s", "　", "🙂", "http://a.b/c?d=1"]
    texts = [*ODD, None, "", *("".join(rng.choice(parts) for _ in range(40)) for _ in range(60)), "the quick brown fox " * 2000]
    rows = [(100 + i, t) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[9]), (None, None), (100, texts[10])]
    want = literal(rows, libraries)
    assert result(alignment.alignment(make(rows, extra=True), *PATHS)) == want
    alignment._worker_pair.cache_clear()
    assert result(alignment.alignment(make(rows).repartition(7), *PATHS)) == want


def test_units_give_the_tokens_of_the_text(spark, libraries):
    pair = alignment.TokenPair(*PATHS)
    docs = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    for text in [*docs, *ODD]:
        units = alignment.units_of(text)
        assert "".join(units) == " " + text
        a, b, same = pair.encode(units)
        got = [sum(a, []), sum(b, [])] if all(same) else [[], []]
        assert got == [[i for i, _ in x] for x in libraries(text)], text[:80]


def test_caches_change_nothing(libraries):
    small, large = alignment.TokenPair(*PATHS), alignment.TokenPair(*PATHS)
    before = alignment.CACHE
    try:
        for text in ODD * 2:
            alignment.CACHE = 5
            x = alignment.Aligned(small, [text, "", "the end"])
            alignment.CACHE = before
            y = alignment.Aligned(large, [text, "", "the end"])
            assert x.groups.equals(y.groups) and (x.n_links == y.n_links).all() and x.links[0] is not None
        assert len(small.known) == 5
    finally:
        alignment.CACHE = before


def test_segment_ends():
    import pyarrow as pa

    got = alignment.segment_ends(pa.array([3, 1, 2, 5, 5]), np.array([2, 0, 3]))
    assert got.to_pylist() == [3, 4, 2, 7, 12]


def test_empty_tables(make):
    assert result(alignment.alignment(make([]), *PATHS)) == []
    assert result(alignment.alignment(make([(1, None), (2, "")]), *PATHS)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
