"""Language identification with error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier over hashed character n-grams
tells the languages whose bit is one from the others: its weight for a gram is the log ratio of the
gram's smoothed frequency in the two sides, each language counting alike. The codeword with the least
loss is chosen. Losses are logistic in the margin between a bit and its classifier's output, and
each bit counts by how often its classifier is right for that language on the training texts
(loss-weighted decoding). The score is the winner's share of exp(-loss); a text is ambiguous if the
two least losses are closer than ``MARGIN``.

All distinct values of ``lang`` among the training rows are learned. At most about ``FIT_ROWS`` texts
per language are used for fitting, chosen by a hash of id and text, so the same rows are chosen
everywhere. Grams are counted over whole texts, in pieces of bounded size.

A null or empty text, or one without a letter, is ``und`` with score 0, and so is every text if
nothing could be learned. A training row without text counts no grams. Ties of the loss go to the
first language by name. Repeated rows get equal results; other columns are ignored by the model.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, doc_key, map_texts, splitmix, written

FIT_ROWS = 4000
#: Hashed grams of each order share one table of this many cells.
CELLS = 1 << 15
ORDERS = (1, 2, 3)
#: A text counts as at most this many independent grams.
EVIDENCE = 24.0
MARGIN = 0.7
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    codes: np.ndarray  # languages x bits, of +1 and -1
    weights: np.ndarray  # cells x bits
    trust: np.ndarray  # languages x bits, rows add to the number of bits


def codebook(n: int) -> np.ndarray:
    """n codewords of +1 and -1: the exhaustive code for up to six, else the best of random ones."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        bits = np.arange(1, 1 << (n - 1))
        rows = [np.ones(len(bits), int)] + [1 - 2 * (bits >> k & 1) for k in range(n - 1)]
        return np.array(rows, np.int8)
    rng = np.random.default_rng(7)
    width = 10 * int(np.ceil(np.log2(n)))
    best, most = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, width))
        apart = (width - code.astype(int) @ code.T.astype(int)) // 2
        np.fill_diagonal(apart, width)
        varied = (np.abs(code.sum(axis=0, dtype=int)) < n).all()
        if varied and apart.min() > most:
            best, most = code, apart.min()
    return best


def _pieces(text: str) -> Iterator[str]:
    """Parts of at most a quarter of SLICE_BYTES characters that overlap by two."""
    step = SLICE_BYTES // 4
    for i in range(0, max(1, len(text) - 2), step):
        yield text[i : i + step + 2]


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter (general category L)."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def cells(text: str) -> Iterator[np.ndarray]:
    """Cells of the grams of the text, lower-cased; runs of other characters count as one blank."""
    for part in _pieces(text):
        code = np.frombuffer((" " + part.lower() + " ").encode("utf-32-le", "replace"), "<u4")
        letter = _letters()[code]
        kept = letter.copy()
        kept[1:] |= letter[:-1]  # of a run of others, the first stays, as a blank
        kept[0] = True
        code = np.where(letter, code, 32)[kept].astype(np.uint64)
        rolled = np.zeros(len(code), np.uint64)
        for order in ORDERS:
            if len(code) < order:
                return
            rolled = rolled[: len(code) - order + 1] * np.uint64(0x100000001B3) + code[order - 1 :] + np.uint64(order)
            yield (splitmix(rolled) & np.uint64(CELLS - 1)).astype(np.int64)


def _count(texts: DataFrame) -> DataFrame:
    """(lang, cell, n): grams, summed within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sums.setdefault(lang, np.zeros(CELLS, np.int64))
                for found in cells(text or ""):
                    own += np.bincount(found, minlength=CELLS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], names=["lang", "cell", "n"]
            )

    counts = map_texts(texts.select("lang", "text"), run, "lang string, cell long, n long")
    return counts.groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def margins(text: str, weights: np.ndarray) -> np.ndarray:
    """Output of each bit's classifier: mean weight times the text's evidence."""
    total, n = np.zeros(weights.shape[1]), 0
    for found in cells(text):
        total += weights[found].sum(axis=0)
        n += len(found)
    return total / max(n, 1) * min(n, EVIDENCE)


def fit(docs: DataFrame, training: Column, fit_rows: int = FIT_ROWS) -> LanguageModel:
    """Learn from the rows of ``docs`` that ``training`` chooses and whose lang is not null."""
    known = docs.where(training & F.col("lang").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), "text", doc_key().alias("_id")
    )
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(fit_rows)) / F.col("n"))
    # One row per language: the table of shares is as small as the codebook itself.
    chosen = known.join(F.broadcast(counts.select("lang", share.alias("share"))), "lang").where(
        F.pmod(F.xxhash64("_id", "text"), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    )
    chosen = written(chosen.select("lang", "text"), "language_texts")
    got = _count(chosen).toArrow()
    languages = sorted(r[0] for r in chosen.select("lang").distinct().collect())
    place = {name: i for i, name in enumerate(languages)}
    table = np.zeros((len(languages), CELLS))
    rows = np.array([place[x] for x in got.column("lang").to_pylist()], np.int64)
    table[rows, got.column("cell").to_numpy()] = got.column("n").to_numpy()
    codes = codebook(len(languages))
    rates = (table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * CELLS)
    weights = np.zeros((CELLS, codes.shape[1]))
    if len(languages) > 1:
        for bit in range(codes.shape[1]):
            ones = codes[:, bit] > 0
            weights[:, bit] = np.log(rates[ones].mean(axis=0)) - np.log(rates[~ones].mean(axis=0))
    trust = _trust(chosen, languages, codes, weights)
    return LanguageModel(languages, codes, weights, trust)


def _trust(texts: DataFrame, languages: list[str], codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """How often each bit is right for each language, scaled so that each row adds to its length."""
    place = {name: i for i, name in enumerate(languages)}
    sent = texts.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = np.zeros(codes.shape, np.int64)
        rows = np.zeros(len(languages), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                i = place[lang]
                right[i] += margins(text or "", sent.value) * codes[i] > 0
                rows[i] += 1
        i, bit = np.indices(codes.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i), pa.array(bit), pa.array(right.ravel()), pa.array(rows[i])], names=["i", "bit", "right", "n"]
        )

    tallies = map_texts(texts.select("lang", "text"), run, "i long, bit long, right long, n long")
    sums = tallies.groupBy("i", "bit").agg(
        ((F.sum("right") + 1) / (F.sum("n") + 2)).alias("rate")
    )
    out = np.ones(codes.shape)
    for r in sums.collect():
        out[r["i"], r["bit"]] = r["rate"]
    return out / out.sum(axis=1, keepdims=True) * codes.shape[1]


def decide(text: str | None, model: LanguageModel) -> tuple[str, float, bool]:
    """(language, score, ambiguous) of one text."""
    if not text or not model.languages or not has_letter(text):
        return UNKNOWN, 0.0, True
    if len(model.languages) == 1:
        return model.languages[0], 1.0, False
    agree = model.codes * margins(text, model.weights)
    loss = (model.trust * np.logaddexp(0, -agree)).sum(axis=1)
    share = np.exp(loss.min() - loss)
    best = int(np.argmin(loss))
    second = np.partition(loss, 1)[1]
    return model.languages[best], float(share[best] / share.sum()), bool(second - loss[best] < MARGIN)


def predict(docs: DataFrame, model: LanguageModel, *columns: str) -> DataFrame:
    """(columns, lang_pred, score, ambiguous) of every row; only ``text`` is looked at."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decide(x.as_py(), sent.value) for x in batch.column(len(columns))]
            names, scores, unsure = zip(*found) if found else ((), (), ())
            arrays = [batch.column(i) for i in range(len(columns))]
            arrays += [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "lang_pred", "score", "ambiguous"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "lang_pred string, score double, ambiguous boolean"])
    return map_texts(docs.select(*columns, F.col("text").cast("string").alias("_text")), run, schema)


def with_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Rows of ``docs`` in which a language was recognised, all columns kept.

    Rejected are texts that are null, empty or without a letter, and no others if the model has no
    languages. An ambiguous text is kept: a few
    words shared by two languages are no fault.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (x.as_py() for x in batch.column(place))
            if sent.value.languages:
                keep = [decide(x, sent.value)[0] != UNKNOWN for x in texts]
            else:
                keep = [bool(x) and has_letter(x) for x in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_texts(docs, run, docs.schema)
