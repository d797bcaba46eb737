"""Token counts by rank-synchronous array merging.

A tokenizer file of byte-level BPE with word ends is read: its normaliser and splitting pattern are
applied with the tokenizers library and its pattern, its merges here. A batch's new pre-tokens are
held as one ragged array of symbols; in each round every sequence applies its lowest-ranked pair
everywhere it occurs, all sequences at once, until no sequence has a pair left. The surviving
symbols are counted, and kept for raw words seen before in a cache of bounded size. As a merge's parts always come from merges of lower rank, this gives the same
symbols as one merge at a time.

Special tokens inside a text count as one token each, found in the raw text, longest first at each
place, as the library does. A null text is empty and has no tokens. Very long texts are split into
parts of bounded size at white space, and counted in full. Repeated rows get equal results, a null
doc_id stays null, other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices

#: Raw words whose counts are kept at once, bytes merged at once, and bytes of a text looked at at once.
CACHE = 1 << 19
SYMBOLS = 1 << 19
PART = 1 << 20


def parts(text: bytes) -> Iterator[bytes]:
    """The text in parts of about PART bytes, cut after a blank or line feed only."""
    start = 0
    while len(text) - start > PART:
        cut = max(text.rfind(b" ", start, start + PART), text.rfind(b"\n", start, start + PART)) + 1
        if not cut:  # one longer word
            cut = min([i + 1 for i in (text.find(b" ", start), text.find(b"\n", start)) if i >= 0], default=len(text))
        yield text[start:cut]
        start = cut
    yield text[start:]


def grouped(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """Lists of (text number, part), each of about PART bytes or one longer word."""
    group, weight = [], 0
    for i, text in enumerate(texts):
        for part in parts(text):
            if weight and weight + len(part) > PART:
                yield group
                group, weight = [], 0
            group.append((i, part))
            weight += len(part)
    yield group


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(256 + extra), extra + 1
    return out


class RankMerger:
    """Counts tokens of a byte-level BPE tokenizer with an end-of-word suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        levels = [p["type"] for p in spec["pre_tokenizer"]["pretokenizers"]]
        if model["type"] != "BPE" or levels != ["Split", "ByteLevel"] or not split["invert"] or model["ignore_merges"]:
            raise ValueError("not a byte-level BPE file with one splitting pattern")
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.pattern = regex.compile(split["pattern"]["Regex"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int64)
        self.width = max(vocab.values()) + 1
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.rank, self.made = pairs[order], order.astype(np.int64), made[order]
        self.counts: dict[bytes, int] = {}

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair among the sorted merges, or -1."""
        key = left * self.width + right
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == key, at, -1)

    def merged(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty pre-token."""
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        data = np.frombuffer(b"".join(tokens), np.uint8)
        ends = np.cumsum(sizes)
        symbol = self.inner[data]
        symbol[ends - 1] = self.last[data[ends - 1]]
        owner = np.repeat(np.arange(len(tokens)), sizes)
        left = np.ones(len(tokens), np.int64)
        none = len(self.pairs)
        while len(symbol):
            same = owner[1:] == owner[:-1]
            at = np.where(same, self._lookup(symbol[:-1], symbol[1:]), -1)
            rank = np.full(len(symbol), none, np.int64)
            rank[:-1][at >= 0] = self.rank[at[at >= 0]]
            first = np.flatnonzero(np.r_[True, ~same])
            lowest = np.minimum.reduceat(rank, first)
            place = np.cumsum(np.r_[True, ~same]) - 1
            # Finished sequences leave the array.
            done = lowest == none
            left[owner[first[done]]] = np.diff(np.r_[first, len(symbol)])[done]
            chosen = (rank == lowest[place]) & (rank < none)
            # In a run of overlapping choices (a a a), every other one is taken, from the left.
            starts = chosen & ~np.r_[False, chosen[:-1]]
            number = np.arange(len(symbol))
            run = np.maximum.accumulate(np.where(starts, number, 0))
            chosen &= (number - run) % 2 == 0
            hit = np.flatnonzero(chosen)
            symbol[hit] = self.made[at[hit]]
            keep = ~done[place]
            keep[hit + 1] = False
            symbol, owner = symbol[keep], owner[keep]
        return left

    def pre_tokens(self, word: bytes) -> tuple[list[str], int]:
        """(pre-tokens, special tokens) of one raw word."""
        if word.isascii() and b"<|" not in word:
            return self.pattern.findall(word.lower().decode()), 0
        text, found = word.decode(), 0
        plain = [text]
        if self.special and (found := len(self.special.findall(text))):
            plain = self.special.split(text)
        return list(chain.from_iterable(self.pattern.findall(self.normalizer.normalize_str(t)) for t in plain)), found

    def learn(self, words: set[bytes]) -> None:
        """Count the symbols of raw words that are not in the cache."""
        names, firsts, batch, weight = [], [], [], 0

        def store() -> None:
            sums = np.concatenate([[0], np.cumsum(self.merged(batch))]) if batch else np.zeros(1, np.int64)
            ends = [a for a, _ in firsts[1:]] + [len(batch)]
            for name, (a, special), b in zip(names, firsts, ends):
                self.counts[name] = int(sums[b] - sums[a]) + special

        for word in words:
            tokens, special = self.pre_tokens(word)
            names.append(word)
            firsts.append((len(batch), special))
            batch += [t.encode() for t in tokens]
            weight += len(word)
            if weight > SYMBOLS:
                store()
                names, firsts, batch, weight = [], [], [], 0
        if names:
            store()


def count_tokens(texts: list[bytes], merger: RankMerger) -> list[int]:
    """Tokens of each text, special ones included.

    Texts are first cut at ASCII white space: no pre-token, special token or composed character
    reaches across it.
    """
    out = [0] * len(texts)
    for group in grouped(texts):
        words = [part.split() for _, part in group]
        if len(merger.counts) > CACHE:
            merger.counts.clear()
        merger.learn(set(chain.from_iterable(words)).difference(merger.counts))
        for (i, _), own in zip(group, words):
            out[i] += sum(map(merger.counts.__getitem__, own))
    return out


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row, by the tokenizer file at ``path`` on each machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = RankMerger(path)
        for batch in batches:
            for first, last, data, bounds in byte_slices(batch.column(1)):
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
                arrays = [batch.column(0).slice(first, last - first), pa.array(np.diff(bounds), pa.int64()), pa.array(count_tokens(texts, merger), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long"
    )
