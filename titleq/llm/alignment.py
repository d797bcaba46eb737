"""Alignment of two tokenizers over the same texts, by byte offsets, as an Arrow pipeline.

Both tokenizers encode a blank and the text. A text is cut into units before each blank that follows
a character that isn't white space: no token of either tokenizer crosses such a cut, so a text's
tokens are those of its units. Units of a batch that aren't in the worker's bounded cache are encoded
at once by the libraries; all the rest works on whole columns of a batch. The units' token lists
are taken and flattened, parent indices name the document of each token, and cumulative sums of byte
lengths, less the sum at the document's start, give byte ends. (Document, end) is one key. A hash join of the two
token tables on it yields the links, and membership of an end among the other side's ends cuts both
token rows into the same groups. Links are counted by (document, id pair) with Table.group_by.

Spark sums these partial counts to the counts of id pairs in the corpus, takes each B id's highest,
and joins the counts to the documents' pairs again: pairs that hold more than a bounded share of all
rows meet a broadcast, the others a shuffle. Documents, counts and joins are tables, so tasks hold
one batch only, and a lost executor costs its tasks.

A text that is null or empty, or with a unit whose tokens' bytes aren't the unit's own, has no
tokens: zeros and an empty string. Repeated rows get equal results and count each time; a null
doc_id stays null. An empty table gives an empty result; columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.layout import split_lookup
from .common import byte_slices, map_texts, written

#: A blank with the white space and the letters behind it; white space other than a blank goes on.
UNITS = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")
MARK = "▁"
#: Units kept by a worker, their greatest length, and the characters encoded by one call.
CACHE, SHORT, BATCH = 1 << 17, 48, 1 << 16
#: Bytes of text that are aligned at once, or one longer text.
ALIGNED = 1 << 20
#: In a document's link, the bits below the pair of ids, for its number there.
COUNT_BITS = 31
#: Pairs that may be broadcast, of 24 bytes each: those that hold more than one row in so many.
HOT_PAIRS = 1 << 20


# --- tokens of units ----------------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary.

    Printable bytes stand for themselves; the others take the code points from 256 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenPair:
    """Both tokenizers, and the token lists of units seen so far."""

    def __init__(self, json_path: str, model_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(json_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode()
            for i, piece in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        ]
        if any(MARK in p.lstrip(MARK) for p in map(self.b.id_to_piece, range(len(self.b_bytes)))):
            raise ValueError("a piece has the blank's mark after another character, so texts can't be cut at blanks")
        self.widths = [pa.array(list(map(len, x)), pa.int64()) for x in (self.a_bytes, self.b_bytes)]
        self.names = [pa.array([str(i) for i in range(len(x))]) for x in (self.a_bytes, self.b_bytes)]
        self.known: dict[str, int] = {}
        self.lists = [pa.array([], pa.list_(pa.int32()))] * 2
        self.whole = np.zeros(0, bool)

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Token ids of A and of B for units, which start with a blank, and whether both give the unit's bytes."""
        a, b = [], []
        at = 0
        blank = self.b.encode("x ")[len(self.b.encode("x")) :]
        while at < len(units):
            end, weight = at, 0
            while end < len(units) and weight < BATCH:
                weight += len(units[end])
                end += 1
            part = units[at:end]
            a += [x.ids for x in self.a.encode_batch_fast(part, add_special_tokens=False)]
            found = self.b.encode([u[1:] for u in part], num_threads=1)  # B adds the blank again, but not to nothing
            b += [x if unit != " " else blank for unit, x in zip(part, found)]
            at = end
        join = b"".join
        same = [
            (raw := unit.encode()) == join([self.a_bytes[i] for i in x]) and raw == join([self.b_bytes[i] for i in y])
            for unit, x, y in zip(units, a, b)
        ]
        return a, b, same

    def tokens(self, split: list[list[str]]) -> tuple[pa.Array, list[pa.ListArray], np.ndarray]:
        """(place of each unit in the lists, lists of A and of B, whether the unit's bytes agree)."""
        flat = list(chain.from_iterable(split))
        new = list(set(flat).difference(self.known))
        a, b, same = self.encode(new)
        base = len(self.whole)
        lists = [pa.concat_arrays([old, pa.array(x, pa.list_(pa.int32()))]) for old, x in zip(self.lists, (a, b))]
        whole = np.concatenate([self.whole, np.array(same, bool)])
        self.known.update(zip(new, range(base, base + len(new))))
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        for unit in new:
            del self.known[unit]
        keep = [i for i, unit in enumerate(new) if len(unit) <= SHORT][: max(0, CACHE - base)]
        if keep:  # frequent units come early, so they are kept
            self.known.update((new[i], base + n) for n, i in enumerate(keep))
            rows = pa.array(np.array(keep, np.int64) + base)
            self.lists = [pa.concat_arrays([old, x.take(rows)]) for old, x in zip(self.lists, lists)]
            self.whole = np.concatenate([self.whole, whole[np.array(keep) + base]])
        return pa.array(at), lists, whole


def units_of(text: str) -> list[str]:
    """Units of a blank and the text; a text that starts with white space keeps it in its first unit."""
    return UNITS.findall(" " + text)


@lru_cache(maxsize=1)
def _worker_pair(json_path: str, model_path: str) -> TokenPair:
    """The tokenizers of a worker process, built once and not per task."""
    return TokenPair(json_path, model_path)


# --- alignment of a batch -----------------------------------------------------------------------


def segment_ends(widths: pa.Array, counts: np.ndarray) -> pa.Array:
    """Running sums of ``widths`` that start again in each segment, of so many values each."""
    if not len(widths):
        return pa.array([], pa.int64())
    sums = pc.cumulative_sum(widths)
    before = np.concatenate([[0], np.cumsum(counts)])[:-1]
    start = np.concatenate([[0], sums.to_numpy()])[before]
    return pc.subtract(sums, pa.array(np.repeat(start, counts)))


def _lists(flags: pa.Array, values: pa.Array, join: str) -> pa.Array:
    """Values joined to one string for each run that ends at a flag; the last flag is set."""
    ends = np.flatnonzero(flags.to_numpy(zero_copy_only=False)) + 1
    offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, values), join)


class Aligned:
    """Tokens, groups and links of the texts of one batch."""

    def __init__(self, pair: TokenPair, texts: list[str]):
        n = len(texts)
        split = [units_of(t) if t else [] for t in texts]
        place, lists, whole = pair.tokens(split)
        sizes = np.fromiter(map(len, split), np.int64, n)
        owner = np.repeat(np.arange(n), sizes)
        bad = np.bincount(owner, ~whole[place.to_numpy()], n) > 0
        self.keep = ~bad & (sizes > 0)
        kept = pa.array(self.keep[owner])
        place, owner = place.filter(kept), pa.array(owner).filter(kept)
        sides = []
        for all_lists, widths in zip(lists, pair.widths):
            mine = all_lists.take(place)
            ids = pc.list_flatten(mine)
            doc = owner.take(pc.list_parent_indices(mine))
            counts = np.bincount(doc.to_numpy(), minlength=n)
            end = segment_ends(widths.take(ids), counts)
            key = pc.add(pc.shift_left(doc, pa.scalar(40, pa.int64())), end)
            sides.append((ids, doc, key, counts))
        (a, _, a_key, self.n_a), (b, b_doc, b_key, self.n_b) = sides
        a_cut, b_cut = pc.is_in(a_key, value_set=b_key), pc.is_in(b_key, value_set=a_key)
        self.n_groups = np.bincount(b_doc.filter(b_cut).to_numpy(), minlength=n)
        # Equal bytes end together, so the last token of a document closes a group on both sides.
        strings = [_lists(cut, names.take(ids), ",") for cut, names, ids in ((a_cut, pair.names[0], a), (b_cut, pair.names[1], b))]
        groups = pc.binary_join_element_wise(*strings, "|")
        offsets = pa.array(np.concatenate([[0], np.cumsum(self.n_groups)]), pa.int32())
        self.groups = pc.binary_join(pa.ListArray.from_arrays(offsets, groups), ";")
        left = pa.table({"key": a_key, "a": a})
        right = pa.table({"key": b_key, "b": b, "doc": b_doc})
        links = left.join(right, "key", join_type="inner", use_threads=False)
        self.n_links = np.bincount(links["doc"].to_numpy(), minlength=n)
        code = pc.bit_wise_or(pc.shift_left(links["a"].cast(pa.int64()), pa.scalar(16, pa.int64())), links["b"].cast(pa.int64()))
        counted = pa.table({"doc": links["doc"], "pair": code}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
        counted = counted.sort_by("doc")
        packed = pc.bit_wise_or(pc.shift_left(counted["pair"], pa.scalar(COUNT_BITS, pa.int64())), counted["count_all"])
        per_doc = np.bincount(counted["doc"].to_numpy(), minlength=n)
        offsets = pa.array(np.concatenate([[0], np.cumsum(per_doc)]), pa.int32())
        self.links = pa.ListArray.from_arrays(offsets, packed.combine_chunks() if isinstance(packed, pa.ChunkedArray) else packed)


def aligned(docs: DataFrame, json_path: str, model_path: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups, links) of every row; to be stored, as rows are numbered by task.

    ``groups`` is the SHA-256 of the groups, ``links`` holds an id pair and its number in a long each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _worker_pair(json_path, model_path)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, last, data, bounds in byte_slices(batch.column(1), ALIGNED):
                raw = data.tobytes()
                got = Aligned(pair, [raw[a:b].decode() for a, b in zip(bounds[:-1], bounds[1:])])
                digests = [hashlib.sha256(s.as_buffer()).hexdigest() if k else "" for s, k in zip(got.groups, got.keep)]
                arrays = [pa.array(np.arange(number, number + last - first)), batch.column(0).slice(first, last - first)]
                arrays += [pa.array(x.astype(np.int64)) for x in (got.n_a, got.n_b, got.n_groups, got.n_links)]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array(digests, pa.string()), got.links],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"],
                )
                number += last - first

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    counts = "n_a long, n_b long, n_groups long, n_links long"
    return map_texts(texts, run, f"row long, doc_id {kind}, {counts}, groups string, links array<long>")


# --- counts over the corpus ---------------------------------------------------------------------


def alignment(docs: DataFrame, json_path: str, model_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    Tokenizer A is a byte-level one of the tokenizers library, B a sentencepiece model with a dummy
    blank; ids of A need 31 bits with 16 bits for B at most.
    """
    rows = written(aligned(docs, json_path, model_path), "aligned")
    links = rows.select("row", F.explode("links").alias("link")).select(
        "row", F.shiftright("link", COUNT_BITS).alias("pair"), F.col("link").bitwiseAND((1 << COUNT_BITS) - 1).alias("times")
    )
    counts = written(links.groupBy("pair").agg(F.sum("times").alias("n"), F.count("*").alias("docs")), "pair_counts")
    second = F.col("pair").bitwiseAND(0xFFFF)
    most = counts.groupBy(second.alias("second")).agg(F.max("n").alias("most"))
    scored = counts.withColumn("second", second).join(F.broadcast(most), "second")
    scored = scored.select("pair", F.col("n").alias("total"), (F.col("n") == F.col("most")).alias("best"))
    freq = counts.select("pair", F.col("docs").alias("n"))
    found = split_lookup(links, written(scored, "pair_scores"), "pair", freq, stored=True, parts=HOT_PAIRS)
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("total")).alias("count_sum")
    )
    out = rows.drop("links").join(sums, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), F.col("groups").alias("groups_sha256"),
    )
