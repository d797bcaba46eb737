"""Spelling variants: words at an edit distance of one, found in a bit-sliced position index.

The index of a part of the vocabulary has a bitset over its words for every (position, letter): the
words that have this letter there. A query runs through its letters and keeps four bitsets, updated
64 words at a time: words equal so far, and words with one error so far, which is a replaced
letter, a letter more than the query (positions shifted by one to the right) or a letter less
(shifted to the left). At the end, bitsets of lengths pick the words that end where they should.
All words of a part are queries at once, as rows of a matrix.

The vocabulary is cut into parts by this: of two words at distance one, the shorter one having L
letters, either the first or the last ``h`` = L // 2 letters are equal. So each word goes to the groups of its
beginnings and endings of L // 2 and (L - 1) // 2 letters. A pair is counted in the group that
its shorter word's length names, and among endings only if the beginnings differ: once in all. Many
groups are packed into one index; a bitset of the group's members keeps them apart. A group of more than
``BLOCK`` words is dealt to blocks, and each pair of blocks is a group of its own, so tasks are bounded and no
pair is lost. Tasks put out one row a word, its number of near words and the best of them.

Words are counted over all texts: first within each text, then in each task, then by a shuffle.
Results are exact. A null text has no words; a null doc_id is written as nothing before the colon.
Repeated rows count as often as they stand. Equal counts: the smaller word in code-point order. Texts
without words or an empty table give an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, written

LEAST_LETTERS = 6
LEAST_SEEN = 5
#: A form is at least so many times as frequent as the word.
RATIO = 5
#: One occurrence in so many loses a letter.
LOSS = 199
BLOCK = 1024
#: Words that a task counts before it hands them on, and words and letters of one index.
COUNTED = 1 << 18
INDEXED, LETTERS = 1024, 1 << 20


def misspelt(base: int, run: str, loss: int = LOSS) -> str:
    """The run as it stands in the document whose id and colon have the checksum ``base``."""
    code = zlib.crc32(run.encode(), base)
    if code % loss:
        return run
    at = code % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, loss: int = LOSS, letters: int = LEAST_LETTERS, seen: int = LEAST_SEEN) -> DataFrame:
    """(word, n): lower-cased runs of letters with at least so many letters and occurrences.

    Only A-Z are lower-cased; a run is of A-Z, a-z and U+00C0 to U+00FF. A run loses a letter in the documents
    that the checksum of id and run picks.
    """
    runs = re.compile(f"[a-zÀ-ÿ]{{{letters},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                base = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                found = Counter(runs.findall(text.as_buffer().to_pybytes().lower().decode()))
                for word, n in found.items():
                    word = misspelt(base, word, loss)
                    if len(word) >= letters:
                        total[word] += n
                if len(total) > COUNTED:
                    yield rows()
                    total.clear()
        yield rows()

    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = map_texts(texts, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= seen)


# --- the index ----------------------------------------------------------------------------------


class PositionIndex:
    """Bitsets over a list of words: for each position and letter, and for each length."""

    def __init__(self, words: list[str]):
        self.lengths = np.array([len(w) for w in words], np.int64)
        most = int(self.lengths.max())
        codes = np.zeros((len(words), most + 1), np.int64)
        filled = np.arange(most + 1) < self.lengths[:, None]
        codes[filled] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        letters, numbers = np.unique(codes, return_inverse=True)  # letter 0 stands behind the end
        self.numbers = numbers.reshape(codes.shape)
        self.bits = np.stack([pack(self.numbers.T[at] == np.arange(len(letters))[:, None]) for at in range(most + 1)])
        self.end = {int(n): pack((self.lengths == n)[None])[0] for n in np.unique(self.lengths)}
        self.none = np.zeros(self.bits.shape[2], np.uint64)

    def near(self, queries: np.ndarray, length: int, half: int) -> tuple[np.ndarray, np.ndarray]:
        """(queries x words, packed): words at distance one, and words with the same first ``half`` letters.

        ``queries`` are rows of the index, all of ``length`` letters.
        """
        shape = len(queries), len(self.none)
        equal = np.full(shape, ~np.uint64(0))
        replaced, more, less = (np.zeros(shape, np.uint64) for _ in range(3))
        begins = equal
        for at in range(length):
            letter = self.numbers[queries, at]
            here = self.bits[at][letter]
            replaced = replaced & here | equal & ~here
            more = (more | equal) & (self.bits[at + 1][letter] if at + 1 < len(self.bits) else self.none)
            less = (less & self.bits[at - 1][letter] if at else less) | equal
            equal = equal & here
            if at + 1 == half:
                begins = equal
        size = lambda n: self.end.get(n, self.none)
        same = np.zeros(shape, np.uint64)
        if length // 2 == half:  # this word is the shorter one, or both are equally long
            same = replaced & size(length) | (more | equal) & size(length + 1)
        if (length - 1) // 2 == half:
            same = same | less & size(length - 1)
        return same, begins


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words, filled up with zeros."""
    out = np.zeros((len(bits), -(-bits.shape[1] // 64) * 8), np.uint8)
    packed = np.packbits(bits, axis=1, bitorder="little")
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def near_words(words: list[str], counts: np.ndarray, group: np.ndarray, half: np.ndarray, ending: np.ndarray, side: np.ndarray):
    """(row, number of near words, row of the best one) of the rows that have near words in their group.

    ``side`` is the block of a word where two blocks of a group meet, else -1.
    """
    order = np.array(sorted(range(len(words)), key=lambda i: (-counts[i], words[i])))
    words = [words[i] for i in order]
    group, half, ending, side = group[order], half[order], ending[order], side[order]
    index = PositionIndex(words)
    rows, numbers, best = [], [], []
    for length, h in sorted(set(zip(index.lengths.tolist(), half.tolist()))):
        queries = np.flatnonzero((index.lengths == length) & (half == h))
        near, begins = index.near(queries, length, h)
        near = np.where(ending[queries, None], near & ~begins, near)
        together = (group[queries, None] == group) & ((side[queries, None] < 0) | (side[queries, None] != side))
        near = near & pack(together)
        number = np.bitwise_count(near).sum(axis=1, dtype=np.int64)
        some = np.flatnonzero(number)
        first = np.unpackbits(near[some].view(np.uint8), axis=1, bitorder="little").argmax(axis=1)
        rows.append(order[queries[some]])
        numbers.append(number[some])
        best.append(order[first])
    return np.concatenate(rows), np.concatenate(numbers), np.concatenate(best)


# --- neighbours, forms and roots ----------------------------------------------------------------


def _fragments() -> Column:
    """The groups of a word: (half, whether an ending, letters)."""
    length = F.char_length("word")
    keys = []
    for half in (F.floor(length / 2), F.floor((length - 1) / 2)):
        half = half.cast("int")
        keys.append(F.struct(half.alias("half"), F.lit(False).alias("ending"), F.expr("word").substr(F.lit(1), half).alias("letters")))
        keys.append(F.struct(half.alias("half"), F.lit(True).alias("ending"), F.expr("word").substr(length - half + 1, half).alias("letters")))
    return F.array_distinct(F.array(*keys))


def neighbours(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, form_n, near) of the words (word, n) with near words: their number and the most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = batch.to_pydict()
            sizes = [len(m) for m in table["members"]]
            todo = sorted(range(len(sizes)), key=lambda i: (table["half"][i], sizes[i]))
            at = 0
            while at < len(todo):
                took, rows = [], 0
                while at < len(todo):
                    i = todo[at]
                    longest = 2 * table["half"][i] + 2
                    if took and (rows + sizes[i] > INDEXED or (rows + sizes[i]) * longest > LETTERS):
                        break
                    took.append(i)
                    rows += sizes[i]
                    at += 1
                members = [m for i in took for m in table["members"][i]]
                spread = lambda values: np.repeat(np.array(values), [sizes[i] for i in took])
                meeting = spread([table["low"][i] != table["high"][i] for i in took])
                words = [m["word"] for m in members]
                counts = np.array([m["n"] for m in members], np.int64)
                side = np.where(meeting, np.array([m["own"] for m in members]), -1)
                row, number, best = near_words(
                    words, counts, spread(took), spread([table["half"][i] for i in took]), spread([table["ending"][i] for i in took]), side
                )
                arrays = [pa.array([words[i] for i in row], pa.string()), pa.array(number), pa.array(counts[best])]
                arrays.append(pa.array([words[i] for i in best], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=["word", "n_near", "form_n", "near"])

    keys = vocabulary.select("word", "n", F.explode(_fragments()).alias("key")).select("word", "n", "key.*")
    names = ["half", "ending", "letters"]
    hot = keys.groupBy(*names).agg(F.count("*").alias("size")).where(F.col("size") > block)
    hot = written(hot.select(*names, F.ceil(F.col("size") / block).cast("int").alias("blocks")), "large_groups")
    members = F.collect_list(F.struct("word", "n", "own")).alias("members")
    zero = F.lit(0)
    cold = keys.join(hot, names, "left_anti").withColumn("own", zero).groupBy(*names).agg(members)
    cold = cold.select("half", "ending", zero.alias("low"), zero.alias("high"), "members")
    dealt = keys.join(hot, names).withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    split = dealt.groupBy(*names, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).agg(members)
    groups = cold.unionByName(split.select("half", "ending", "low", "high", "members")).where(F.size("members") > 1)
    found = map_texts(groups, run, "word string, n_near long, form_n long, near string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.near").alias("near")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that following (word, form) reaches; distances double each round."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        if now.join(on, "root", "left_semi").isEmpty():
            return now
        now = written(now.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "roots")


def variants(docs: DataFrame, ratio: int = RATIO, loss: int = LOSS, letters: int = LEAST_LETTERS, seen: int = LEAST_SEEN, block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the texts.

    ``form`` is the most frequent near word if it is at least ``ratio`` times as frequent, else null.
    ``letters`` must be 2 or more.
    """
    vocabulary = written(word_counts(docs, loss, letters, seen), "vocabulary")
    near = vocabulary.join(neighbours(vocabulary, block), "word", "left")
    chosen = F.col("form_n") >= ratio * F.col("n")
    near = near.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(chosen, F.col("near")).alias("form"), F.when(chosen, F.col("form_n")).alias("form_n"),
    )
    near = written(near, "near_words")
    found = near.join(roots(near.where("form IS NOT NULL")), "word", "left")
    return found.withColumn("root", F.coalesce("root", "word"))
