"""Part-of-speech tags from a hidden Markov model that learns from untagged titles.

Tags are the states. A token is seen as its observation class: one of the most frequent words, or for the
other words the tag that the rules give it together with its ending, dealt to a fixed number of
buckets; so the model's size is a parameter, whatever the vocabulary. The rules serve as the lexicon:
tags of closed classes are fixed, and for open classes each word leans to its rule tag by pseudo-counts. Rounds
of expectation and maximisation sum expected counts in the tasks and by class; the driver holds the model,
which is tags x (tags + classes) numbers. The posterior objective never falls from round to round.

Null and empty titles have no tags. Results do not depend on how rows are dealt to tasks, up to rounding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tags as rules
from ..session import written

TAGS = ["NUM", "SYM", "PUNCT", "CCONJ", "FUNC", "ADV", "ADJ", "VERB", "NOUN"]
OPEN = ["ADV", "ADJ", "VERB", "NOUN"]
#: Frequent words with a class of their own; buckets of endings for each rule tag of the others.
WORDS, ENDINGS = 5000, 256
#: Pseudo-counts of an open class's rule tag, of its other tags, of any other tag, and of a transition.
LIKELY, POSSIBLE, NEVER, STEP = 3.0, 0.3, 1e-9, 0.5
#: Cells (sequences x places x tags) worked on at once.
CELLS = 1 << 20


def tokens_of(rows: DataFrame, title: str, *keep: str) -> DataFrame:
    """(``keep`` ..., words, rules): lower-cased tokens of the titles and their rule tags."""
    tokens = rules.raw_tokens(F.coalesce(F.col(title), F.lit("")))
    return rows.select(*keep, tokens.alias("words")).select(
        *keep, F.transform("words", F.lower).alias("words"), F.transform("words", rules.tag).alias("rules")
    )


class Classes:
    """Numbers of the observation classes, and the lexicon's pseudo-counts for each."""

    def __init__(self, words: dict[str, str]):
        """``words`` holds the frequent words with their rule tags."""
        self.words = {w: i for i, w in enumerate(words)}
        self.size = len(words) + len(TAGS) * ENDINGS
        first = len(words)
        tag = [TAGS.index(t) for t in words.values()] + [t for t in range(len(TAGS)) for _ in range(ENDINGS)]
        self.lexicon = np.full((self.size, len(TAGS)), NEVER)
        for i, t in enumerate(tag):
            if TAGS[t] in OPEN:
                self.lexicon[i, [TAGS.index(o) for o in OPEN]] = POSSIBLE
                self.lexicon[i, t] = LIKELY
            else:
                self.lexicon[i, t] = LIKELY
        self.first = first

    def number(self, word: str, rule: str) -> int:
        found = self.words.get(word)
        if found is not None:
            return found
        return self.first + TAGS.index(rule) * ENDINGS + zlib.crc32(word[-3:].encode()) % ENDINGS


class Model:
    """Logarithm-free parameters: ``start`` (tags), ``step`` (tags x tags) and ``emit`` (classes x tags)."""

    def __init__(self, classes: Classes, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.classes, self.start, self.step, self.emit = classes, start, step, emit

    @staticmethod
    def from_counts(classes: Classes, start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> Model:
        """The most probable parameters given expected counts and the pseudo-counts."""
        start, step, emit = start + STEP, step + STEP, emit + classes.lexicon
        return Model(classes, start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def prior(self) -> float:
        """Logarithm of the pseudo-counts' probability, up to a constant."""
        return float(
            STEP * (np.log(self.start).sum() + np.log(self.step).sum()) + (self.classes.lexicon * np.log(self.emit)).sum()
        )

    def expect(self, seqs: np.ndarray, lengths: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """(log likelihood, start counts, step counts, tag shares of each place) of padded sequences (n x places)."""
        n, places = seqs.shape
        t = len(self.start)
        emit = self.emit[seqs]
        alive = np.arange(places) < lengths[:, None]
        emit[~alive] = 1
        forward, scale = np.empty((places, n, t)), np.ones((places, n))
        now = self.start * emit[:, 0]
        for i in range(places):
            if i:
                moved = (now @ self.step) * emit[:, i]
                now = np.where(alive[:, i, None], moved, now)
            total = now.sum(axis=1)
            scale[i] = np.where(alive[:, i], total, 1)
            now = now / total[:, None]
            forward[i] = now
        backward = np.ones((n, t))
        steps = np.zeros((t, t))
        shares = np.zeros((n, places, t))
        for i in range(places - 1, -1, -1):
            shares[:, i] = np.where(alive[:, i, None], forward[i] * backward, 0)
            if i:
                ahead = np.where(alive[:, i, None], emit[:, i] * backward / scale[i][:, None], 0)
                steps += self.step * (forward[i - 1].T @ ahead)
                backward = np.where(alive[:, i, None], ahead @ self.step.T, backward)
        return float(np.log(scale).sum()), shares[:, 0].sum(axis=0), steps, shares

    def best(self, seqs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Most probable tags of padded sequences; ties to the earlier tag."""
        n, places = seqs.shape
        emit, step = np.log(self.emit)[seqs], np.log(self.step)
        score = np.log(self.start) + emit[:, 0]
        back = np.zeros((places, n, len(self.start)), np.int8)
        for i in range(1, places):
            ways = score[:, :, None] + step
            back[i] = ways.argmax(axis=1)
            score = np.where((i < lengths)[:, None], ways.max(axis=1) + emit[:, i], score)
        out = np.zeros((n, places), np.int64)
        now = score.argmax(axis=1)
        for i in range(places - 1, -1, -1):
            out[:, i] = now
            now = np.where((i < lengths) & (i > 0), back[i][np.arange(n), now], now)
        return out


def _chunks(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of similar length, so many that their padded cells fit; rows of length 0 are left out."""
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * lengths[order[end]] * len(TAGS) <= CELLS:
            end += 1
        yield order[at:end]
        at = end


def _padded(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    places = np.arange(lengths.max())
    return flat[np.minimum(starts[:, None] + places, (starts + lengths - 1)[:, None])]


def _numbers(batch: pa.RecordBatch, classes: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes of all tokens, first token of each row, tokens of each row)."""
    words, tags = batch.column("words"), batch.column("rules")
    ends = words.offsets.to_numpy()
    flat = [classes.number(w, t) for w, t in zip(words.flatten().to_pylist(), tags.flatten().to_pylist())]
    return np.array(flat, np.int64), ends[:-1] - ends[0], np.diff(ends)


def _coded(rows: DataFrame, classes: Classes) -> DataFrame:
    """(numbers array<int>): the classes of the tokens of each row (words, rules); stored, as every round reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, first, _ = _numbers(batch, classes)
            ends = pa.array(np.append(first, len(flat)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(flat.astype(np.int32)))], names=["numbers"])

    return written(rows.select("words", "rules").mapInArrow(run, "numbers array<int>"), "token_classes")


def _expected(rows: DataFrame, model: Model) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(log likelihood, start, step and emission counts) over all rows (numbers) of ``_coded``."""
    t = len(TAGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = model.classes.size
        likelihood, start, steps, emit = 0.0, np.zeros(t), np.zeros((t, t)), np.zeros((size, t))
        for batch in batches:
            lists = batch.column("numbers")
            ends, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
            first, lengths = ends[:-1] - ends[0], np.diff(ends)
            for part in _chunks(lengths):
                seqs = _padded(flat, first[part], lengths[part])
                log, s, m, shares = model.expect(seqs, lengths[part])
                likelihood, start, steps = likelihood + log, start + s, steps + m
                cells = seqs.ravel()
                for i in range(t):
                    emit[:, i] += np.bincount(cells, shares[:, :, i].ravel(), size)
        used = np.flatnonzero(emit.any(axis=1))
        # Rows below zero carry the likelihood, the starts and the steps.
        number = np.concatenate([[-1, -2], -3 - np.arange(t), used])
        values = np.concatenate([np.r_[likelihood, np.zeros(t - 1)][None], start[None], steps, emit[used]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(number.astype(np.int32)), *map(pa.array, values.T.copy())], names=["number", *(f"t{i}" for i in range(t))]
        )

    cells = [f"t{i}" for i in range(t)]
    sums = rows.select("numbers").mapInArrow(run, "number int, " + ", ".join(f"{c} double" for c in cells))
    table = sums.groupBy("number").agg(*[F.sum(c).alias(c) for c in cells]).toArrow()  # one row per class at most
    emit, head = np.zeros((model.classes.size, t)), np.zeros((t + 2, t))
    if table.num_rows:
        number, values = table["number"].to_numpy(), np.stack([table[c].to_numpy() for c in cells], axis=1)
        emit[number[number >= 0]] = values[number >= 0]
        head[-number[number < 0] - 1] = values[number < 0]
    return head[0, 0], head[1], head[2:], emit


def frequent_words(rows: DataFrame, most: int = WORDS) -> Classes:
    """Classes whose own words are the ``most`` frequent ones, ties by word."""
    pairs = rows.select(F.explode(F.arrays_zip("words", "rules")).alias("p")).groupBy("p.words").agg(
        F.count("*").alias("n"), F.min("p.rules").alias("rule")
    )
    best = pairs.orderBy(F.desc("n"), "words").limit(most).collect()  # bounded by the parameter
    return Classes({r.words: r.rule for r in best})


def fit(rows: DataFrame, rounds: int = 8, most: int = WORDS) -> tuple[Model, list[float]]:
    """(model, objective before each round and at the end) from the stored rows (words, rules) of ``tokens_of``."""
    classes = frequent_words(rows, most)
    t = len(TAGS)
    zero = np.zeros((classes.size, t))
    model = Model.from_counts(classes, np.zeros(t), np.zeros((t, t)), zero)
    objective = []
    coded = _coded(rows, classes)
    for _ in range(rounds):
        likelihood, start, step, emit = _expected(coded, model)
        objective.append(likelihood + model.prior())
        model = Model.from_counts(classes, start, step, emit)
    objective.append(_expected(coded, model)[0] + model.prior())
    return model, [float(x) for x in objective]


def tagged(rows: DataFrame, model: Model, *keep: str) -> DataFrame:
    """(``keep`` ..., tags array<string>): the most probable tags of each row of ``tokens_of``."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(TAGS)
        for batch in batches:
            flat, first, lengths = _numbers(batch, model.classes)
            found = np.zeros(len(flat), np.int64)
            for part in _chunks(lengths):
                best = model.best(_padded(flat, first[part], lengths[part]), lengths[part])
                inside = np.arange(best.shape[1]) < lengths[part][:, None]
                found[(first[part][:, None] + np.arange(best.shape[1]))[inside]] = best[inside]
            offsets = pa.array(np.concatenate([first, [len(flat)]]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, names.take(pa.array(found)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], names=[*keep, "tags"])

    return rows.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "tags array<string>"]))
