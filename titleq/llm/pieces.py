"""SentencePiece encoding and decoding with the tokenizers library.

The model's protobuf is read here (no generated classes): pieces with scores and kinds, the trainer's
model type and the normaliser's settings. From them a tokenizer is rebuilt: the precompiled
normalisation map if there is one, the metaspace marker for blanks with the dummy prefix, and either
the unigram scores or, for a merging model, the merges that the scores order, with byte fallback.

If no piece has a marker after another character, no merge crosses the start of a marker run, so a
text's ids are those of its pieces cut there. New pieces are encoded in batches of bounded size by
several threads, and every one is verified against the sentencepiece library inside the task; a
difference stops the job, as results would be wrong. Each new piece is also decoded by the rebuilt
decoder and compared; a text decodes to its normalised self if all its pieces do, as a piece's bytes
are whole characters. The first pieces of a worker process, the frequent ones among them, stay in a cache
of bounded size, which the tasks that follow in that process find filled. If some piece forbids the cut, whole texts take the place of pieces.

A null or empty text has no ids and decodes to the empty text. Repeated rows get equal results, a
null doc_id stays null, other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, list_array, map_texts

MARK = "▁"
#: Runs of markers with what follows, or what stands before the first.
RUNS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Characters encoded by one call, and pieces whose ids are kept at once.
BATCH = 1 << 17
CACHE = 1 << 18
THREADS = 2
#: Fixed values of the model file's format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGING = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protobuf message: integers, 4 or 8 raw bytes, or bytes."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            value |= (byte & 0x7F) << shift
            i, shift = i + 1, shift + 7
            if byte < 0x80:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        else:
            if kind == 2:
                size, i = varint(i)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"unknown wire type {kind}")
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix_marker: bool = False


def read_model(path: str) -> PieceModel:
    """Parse a ``.model`` file."""
    out = PieceModel()
    with open(path, "rb") as file:
        data = file.read()
    for number, value in _fields(data):
        if number == 1:  # a piece: text, score, kind
            text, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    text = v.decode()
                elif n == 2:
                    score = float(np.frombuffer(v, "<f4")[0])
                elif n == 3:
                    kind = v
            out.pieces.append((text, score, kind))
        elif number == 2:  # the trainer's settings
            for n, v in _fields(value):
                if n == 3:
                    out.model_type = v
                elif n == 24:
                    out.suffix_marker = bool(v)
                elif n == 35:
                    out.byte_fallback = bool(v)
        elif number == 3:  # the normaliser's settings
            for n, v in _fields(value):
                if n == 2:
                    out.charsmap = v
                elif n == 3:
                    out.dummy_prefix = bool(v)
                elif n == 4:
                    out.squeeze = bool(v)
                elif n == 5:
                    out.escape = bool(v)
    return out


class PieceTokenizer:
    """Encoder and decoder rebuilt from a model file."""

    def __init__(self, path: str, library: object | None = None):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        self.library = library
        self.known: dict[str, int] = {}
        self.flat, self.sizes, self.good = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)
        self.model = m = read_model(path)
        if m.suffix_marker or not m.escape:
            raise ValueError("markers after words and unmarked blanks are not supported")
        self.unknown = next(i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN)
        vocab = {p[0]: i for i, p in enumerate(m.pieces)}
        plain = [p for p in m.pieces if p[2] in (NORMAL, USER_DEFINED)]
        self.splits = not any(MARK in p[0].lstrip(MARK) for p in plain)
        if m.model_type == UNIGRAM:
            core = models.Unigram([(p[0], p[1]) for p in m.pieces], self.unknown, m.byte_fallback)
        elif m.model_type == MERGING:
            core = models.BPE(vocab, self._merges(), unk_token=m.pieces[self.unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback)
        else:
            raise ValueError(f"model type {m.model_type} has no counterpart")
        tok = Tokenizer(core)
        steps = []
        if m.charsmap:
            steps.append(normalizers.Precompiled(m.charsmap))
        if m.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        self.normal = normalizers.Sequence(steps) if steps else None
        tok.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse()])
        self.tokenizer = tok

    def _merges(self) -> list[tuple[str, str]]:
        """Every split of a piece into two pieces, best score of the whole first, then of the parts."""
        score = {p[0]: p[1] for p in self.model.pieces if p[2] in (NORMAL, USER_DEFINED, UNUSED)}
        place = {p[0]: i for i, p in enumerate(self.model.pieces)}
        found = []
        for whole, value in score.items():
            for cut in range(1, len(whole)):
                a, b = whole[:cut], whole[cut:]
                if a in score and b in score:
                    found.append((-value, place[a], place[b], a, b))
        found.sort()
        return [(a, b) for *_, a, b in found]

    def normalised(self, text: str) -> str:
        """The text as it is encoded, with markers for blanks."""
        if self.normal is not None:
            text = self.normal.normalize_str(text)
        if not text:
            return ""
        return (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)

    def _pieces(self, text: str) -> list[str]:
        """Runs of markers with what follows them; the whole text if merges may cross their starts."""
        return RUNS.findall(text) if self.splits else [text]

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids, whether they decode to the piece) of new pieces.

        They are encoded in batches by several threads, and held against the library.
        """
        found: list[list[int]] = []
        good: list[bool] = []
        i = 0
        while i < len(pieces):
            j, weight = i, 0
            while j < len(pieces) and weight < BATCH:
                weight += len(pieces[j])
                j += 1
            batch = pieces[i:j]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
            if self.library is not None:
                self._verify(batch, ids)
            good += [a == b for a, b in zip(self.tokenizer.decode_batch(ids, skip_special_tokens=False), batch)]
            found += ids
            i = j
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes, np.array(good, bool)

    def _verify(self, pieces: list[str], ids: list[list[int]]) -> None:
        whole = [(p[len(MARK) :] if self.model.dummy_prefix else p).replace(MARK, " ") for p in pieces]
        for piece, text, own, other in zip(pieces, whole, ids, self.library.encode(whole, num_threads=1)):
            if self.model.dummy_prefix and (not text or not piece.startswith(MARK)):
                continue  # no text is encoded as this piece alone
            if own != other:
                raise AssertionError(f"ids differ from the sentencepiece library for {text[:200]!r}")

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each text, whether each text's pieces decode to themselves)."""
        split = [self._pieces(t) if t else [] for t in map(self.normalised, texts)]
        new = list(set(chain.from_iterable(split)).difference(self.known))
        base = len(self.sizes)
        flat, sizes, good = (np.concatenate(x) for x in zip((self.flat, self.sizes, self.good), self._learn(new)))
        self.known.update(zip(new, range(base, base + len(new))))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64)
        if base < CACHE:
            self.flat, self.sizes, self.good = flat, sizes, good
        else:  # frequent pieces are in the cache by now; the others serve this call alone
            for piece in new:
                del self.known[piece]
        starts = np.cumsum(sizes) - sizes
        number = sizes[at]
        ends = np.cumsum(number)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(starts[at] - (ends - number), number) + np.arange(total)]
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in split])
        counts = np.bincount(owner, number, len(texts)).astype(np.int64)
        return ids, counts, np.bincount(owner, ~good[at], len(texts)) == 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        ids, counts, _ = self.encode_flat(texts)
        return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of the ids, the dummy prefix taken away again."""
        out = []
        for text in self.tokenizer.decode_batch(ids, skip_special_tokens=False):
            text = text.replace(MARK, " ")
            out.append(text[1:] if self.model.dummy_prefix and text.startswith(" ") else text)
        return out

    def expected(self, text: str) -> str:
        """What decoding must give back: the normalised text; an unknown character is lost only
        without byte fallback."""
        text = self.normalised(text).replace(MARK, " ")
        return text[1:] if self.model.dummy_prefix and text else text


@lru_cache(maxsize=1)
def _worker_tokenizer(path: str, threads: int) -> PieceTokenizer:
    """The tokenizer of a worker process, verified against the library: built once, not per task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    import sentencepiece

    return PieceTokenizer(path, sentencepiece.SentencePieceProcessor(model_file=path))


def encoded(docs: DataFrame, path: str, threads: int = THREADS) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of every row; ``path`` exists on each machine.

    ``round_trip`` tells whether all pieces of the text decode to themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _worker_tokenizer(path, threads)
        for batch in batches:
            for first, last, data, bounds in byte_slices(batch.column(1)):
                raw = data.tobytes()
                texts = [raw[a:b].decode() for a, b in zip(bounds[:-1], bounds[1:])]
                ids, counts, same = tokenizer.encode_flat(texts)
                arrays = [batch.column(0).slice(first, last - first), list_array(pa.array(ids), counts), pa.array(counts), pa.array(same)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "n_tokens", "round_trip"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_texts(
        texts, run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>, n_tokens long, round_trip boolean"
    )
