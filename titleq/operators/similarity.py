"""Similarity of titles and descriptions.

All of it starts from one row per distinct word of each text, with the number of repetitions
(``side_words``). Texts are shuffled once by ``index`` and their words counted inside it; later groupings
by index and more columns reuse that layout. Store the words with ``session.written`` if several
scores are taken from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .layout import BROADCAST_BYTES, by_key, lookup, shuffle_width, split_lookup

BLOCK = 512
#: Words of a group of texts that share one copy of their vectors, where the table is too large for a broadcast.
GROUP_WORDS = 1 << 23
#: Words of a group for each vector of the table, at least: so all groups' copies of the table grow no faster than the words.
VECTOR_WORDS = 64
#: Neighbouring words of a key that travel in one row, at most.
PACK = 256
#: Share of a corpus, as one part of so many, beyond which a term's weight is broadcast: fewer terms than this, some 200 bytes each.
TERM_PARTS = BROADCAST_BYTES // 200
#: Words whose vectors are summed at once, so few that they stay in a core's cache.
PIECE = 1024


def _counted(products: DataFrame, sides: dict[str, Column]) -> DataFrame:
    """(index, runs): the distinct words of each side (token, side, n, first) as one array, in order; rows of an index together.

    A side without words leaves a null token at the end, so ``inline_outer`` adds no row to them; ``inline`` would compute the array
    again for a filter. Words are counted inside the rows of their index, which stream by sorted: a task holds the rows of one
    index, not a hash table of all its words.
    """
    rows = by_key(products.select("index", "title", "description")).select("index", *[c.alias(s) for s, c in sides.items()])
    texts = rows.groupBy("index").agg(F.collect_list(F.struct(*sides)).alias("texts"))

    def tokens(row: Column, side: str) -> Column:
        return F.coalesce(row[side], F.array().cast("array<string>"))

    def places(side: str) -> Column:
        def listed(row: Column) -> Column:
            return F.transform(
                tokens(row, side), lambda w, i: F.struct(w.alias("token"), F.lit(side).alias("side"), i.alias("first"))
            )

        return F.flatten(F.transform("texts", listed))

    def bound(value: Column, use) -> Column:
        """``use`` of a value that is computed once, however often it is named."""
        return F.element_at(F.transform(F.array(value), use), 1)

    def starts(sorted_: Column) -> Column:
        """Where the runs of equal words begin."""

        def begins(x: Column, i: Column) -> Column:
            before = F.get(sorted_, i - 1)
            return (i == 0) | (x["token"] != before["token"]) | (x["side"] != before["side"])

        at = F.transform(sorted_, lambda x, i: F.when(begins(x, i), i))
        return F.filter(at, lambda i: i.isNotNull())

    def runs(sorted_: Column) -> Column:
        def cut(ends: Column) -> Column:
            def one(i: Column, k: Column) -> Column:
                x, end = F.get(sorted_, i), F.coalesce(F.get(ends, k + 1), F.size(sorted_))
                return F.struct(
                    x["token"].alias("token"), x["side"].alias("side"), (end - i).cast("long").alias("n"), x["first"].alias("first")
                )

            return F.transform(ends, one)

        return bound(starts(sorted_), cut)

    kind = "array<struct<token:string,side:string,n:bigint,first:int>>"
    none = [
        F.when(
            F.exists("texts", lambda row: F.size(tokens(row, s)) == 0),  # noqa: B023
            F.array(F.struct(F.lit(None).cast("string"), F.lit(s), F.lit(0).cast("long"), F.lit(None).cast("int"))).cast(kind),
        ).otherwise(F.array().cast(kind))
        for s in sorted(sides)
    ]
    found = bound(F.sort_array(F.concat(*[places(s) for s in sides])), runs).cast(kind)
    return texts.select("index", F.concat(found, *none).alias("runs"))


def side_words(products: DataFrame, title: Column, description: Column) -> DataFrame:
    """(index, side, token, n, first): distinct words of both texts, repetitions, first place.

    A text without words leaves one row with a null token, so no index is lost.
    """
    words = _counted(products, {"t": title, "d": description}).select("index", F.inline_outer("runs"))
    return words.select("index", "side", "token", "n", "first")


def paired_words(products: DataFrame, title: Column, description: Column) -> DataFrame:
    """``paired`` of the side words, taken from the rows of each index as they stream by: store them, as they are read twice."""
    counted = _counted(products, {"t": title, "d": description})

    def pair(x: Column, i: Column) -> Column:
        """A word of both texts has two runs, its description's first."""
        title, before, after = x["side"] == "t", F.get("runs", i - 1), F.get("runs", i + 1)
        second = title & (i > 0) & before["token"].eqNullSafe(x["token"])
        shared = after.isNotNull() & after["token"].eqNullSafe(x["token"])
        n_t = F.when(title, x["n"]).when(shared, after["n"]).otherwise(0)
        n_d = F.when(title, 0).otherwise(x["n"])
        return F.when(~second, F.struct(x["token"].alias("token"), n_t.alias("n_t"), n_d.alias("n_d")))

    pairs = F.filter(F.transform("runs", pair), lambda x: x.isNotNull())
    return counted.select("index", F.inline_outer(pairs))


def known(words: DataFrame) -> DataFrame:
    """The rows that hold a word."""
    return words.where(F.col("token").isNotNull())


def paired(words: DataFrame) -> DataFrame:
    """(index, token, n_t, n_d): counts of every word in title and description.

    Taken before the side words are stored it needs no shuffle, but a hash table of a task's words; ``paired_words`` does without.
    The scores over whole texts and the corpus accept these rows in place of side words.
    """
    return words.groupBy("index", "token").agg(
        *[F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(f"n_{s}") for s in "td"]
    )


def _weighted_cosine(name: str) -> Column:
    """Cosine of the count vectors weighted by ``idf``; 0 if one side has no words."""
    t, d = F.col("n_t") * F.col("idf"), F.col("n_d") * F.col("idf")
    norm = F.sqrt(F.sum(t * t)) * F.sqrt(F.sum(d * d))
    return F.coalesce(F.try_divide(F.sum(t * d), norm), F.lit(0.0)).alias(name)


def tfidf_corpus(words: DataFrame, texts: Column, name: str = "tf_score") -> DataFrame:
    """TF-IDF cosine with frequencies over the whole corpus; ``texts`` is the number of texts.

    The counts are read for the dictionary and again for the lookup: ``words`` are stored pairs, or pairs are stored.
    """
    rows = words if "n_t" in words.columns else written(paired(words), "paired_words")
    seen = [(F.col(f"n_{s}") > 0).cast("long") for s in "td"]
    terms = known(rows).groupBy("token").agg(
        F.sum(seen[0] + seen[1]).alias("df"), F.count("*").alias("n")
    )
    terms = written(terms, "terms")
    idf = terms.select("token", (F.log((texts + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    found = split_lookup(
        rows, idf, "token", freq=terms.select("token", "n"), keep=True, stored=True, parts=TERM_PARTS
    )
    return found.groupBy("index").agg(_weighted_cosine(name))


def tfidf_pair(words: DataFrame, name: str = "tf_pair_score") -> DataFrame:
    """TF-IDF cosine with frequencies over just the two texts of the row."""
    df = (F.col("n_t") > 0).cast("int") + (F.col("n_d") > 0).cast("int")
    idf = F.when(F.col("token").isNotNull(), F.log(F.lit(3.0) / (df + 1)) + 1)
    rows = words if "n_t" in words.columns else paired(words)
    return rows.withColumn("idf", idf).groupBy("index").agg(_weighted_cosine(name))


def unit(vec: Column) -> Column:
    """Vector over its length; the zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x))
    # The one-element array binds the length, or it would be computed again for every cell.
    scaled = F.transform(
        F.array(norm), lambda n: F.when(n > 0, F.transform(vec, lambda x: x / n)).otherwise(vec)
    )
    return F.element_at(scaled, 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


class _Held:
    """The vectors of one group by ``vec_id``: sums over equal ids, and how many rows and cells are in them.

    ``parts`` is used up, so that no more than one copy of the vectors is held, in the type they came in; sums are doubles.
    If no id repeats, unit vectors are the vectors times ``scale``.
    """

    def __init__(self, parts: list[pa.RecordBatch], dim: int, columns: tuple[str, ...]):
        ids = pa.concat_arrays([p.column("vec_id") for p in parts]).dictionary_encode()
        kind = parts[0].schema.field("vec").type.value_type.to_pandas_dtype()
        x, full, at = np.empty((len(ids), dim), kind), None, 0
        parts.reverse()
        while parts:
            cells = parts.pop().column("vec").flatten()
            rows = slice(at, at + len(cells) // dim)
            if cells.null_count:
                full = np.ones(x.shape, bool) if full is None else full
                full[rows] = cells.is_valid().to_numpy(zero_copy_only=False).reshape(-1, dim)
                cells = pc.fill_null(cells, 0.0)
            x[rows] = cells.to_numpy(zero_copy_only=False).reshape(-1, dim)
            at = rows.stop
        places, many = ids.indices.to_numpy(), len(ids.dictionary)
        self.ids, self.scale = ids.dictionary, None
        self.rows, self.cells, self.sums = np.bincount(places, minlength=many).astype(float), full, {"vec": x}
        if "unit" in columns:
            norm = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=float))
            use = (norm > 0) | np.isnan(norm)
            use = use if full is None else use & full.all(axis=1)
            self.scale = 1 / np.where(use, norm, 1.0)
        if many < len(x):
            order = np.argsort(places, kind="stable")
            first = np.searchsorted(places[order], np.arange(many))
            total = lambda a: np.add.reduceat(a[order], first, axis=0, dtype=float)
            self.cells = None if full is None else total(full.astype(float))
            self.sums = {c: total(x if c == "vec" else x * self.scale[:, None]) for c in columns}
            self.scale = None
        if pa.types.is_integer(self.ids.type):
            numbers = self.ids.to_numpy()
            self.order = np.argsort(numbers)
            self.sorted = numbers[self.order]

    def weighted(self, column: str, ids: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The vectors or unit vectors of the ids, each times its number."""
        if column == "unit" and self.scale is not None:
            return self.sums["vec"][ids] * (times * self.scale[ids])[:, None]
        return self.sums[column][ids] * times[:, None]

    def places(self, ids: pa.Array) -> np.ndarray:
        """Where the ids are; -1 if they have no vector."""
        if not pa.types.is_integer(self.ids.type):
            return pc.fill_null(pc.index_in(ids, value_set=self.ids), -1).to_numpy()
        wanted = ids.to_numpy()
        at = np.searchsorted(self.sorted, wanted).clip(max=len(self.sorted) - 1)
        return np.where(self.sorted[at] == wanted, self.order[at], -1)


def _pack(key: str, amounts: list[str]):
    """Function over Arrow batches of words: neighbours of one key as one row of lists, no longer than ``PACK``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy()
            runs = np.append(np.flatnonzero(np.diff(code, prepend=-1)), len(code))
            first = np.concatenate([np.arange(a, b, PACK) for a, b in zip(runs[:-1], runs[1:])])
            ends = pa.array(np.append(first, len(code)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, batch.column(c)) for c in ("vec_id", *amounts)]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(first)), *lists], names=[key, "vec_ids", *amounts])

    return run


def _unpacked(batch: pa.RecordBatch, key: str, amounts: list[str]) -> pa.RecordBatch:
    """The words of packed rows, one row each."""
    parents = pc.list_parent_indices(batch.column("vec_ids"))
    flat = [batch.column(c).flatten() for c in ("vec_ids", *amounts)]
    return pa.RecordBatch.from_arrays([batch.column(key).take(parents), *flat], names=[key, "vec_id", *amounts])


def _group_sums(key: str, dim: int, columns: tuple[str, ...], suffixes: list[str]):
    """Function over Arrow batches of vectors and packed words sorted by group, kind and key: the weighted sums of each key."""
    many = len(suffixes)
    amounts = [f"_w{i}" for i in range(many)]

    def batch_of(keys: pa.Array, known: np.ndarray, used: np.ndarray, cells: dict, sums: dict) -> pa.RecordBatch:
        arrays, names = [keys], [key]
        ends = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * dim)
        for i, suffix in enumerate(suffixes):
            none = used[i] == 0
            arrays.append(pa.array(known[i].astype(np.int64), mask=none))
            names.append(f"known{suffix}")
            for c in columns:
                values = pa.array(sums[c][i].ravel(), mask=None if cells is None else (cells[i] == 0).ravel())
                lists = pa.ListArray.from_arrays(ends, values)
                arrays.append(pc.if_else(pa.array(none), pa.scalar(None, lists.type), lists) if none.any() else lists)
                names.append(f"{c}{suffix}")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def keyed_sums(held: _Held, batch: pa.RecordBatch) -> tuple | None:
        """(keys, known, used, cells, sums) of the words of a batch that have a vector; keys in order."""
        at = held.places(batch.column("vec_id"))
        found = np.flatnonzero(at >= 0)
        if not len(found):
            return None
        at, keys = at[found], batch.column(key).take(pa.array(found))
        code = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
        first = np.flatnonzero(np.diff(code, prepend=-1))
        place = np.cumsum(np.diff(code, prepend=-1) != 0) - 1
        known, used = np.zeros((2, many, len(first)))
        cells = None if held.cells is None else np.zeros((many, len(first), dim))
        sums = {c: np.zeros((many, len(first), dim)) for c in columns}
        for i in range(many):
            amount = batch.column(f"_w{i}").take(pa.array(found))
            use = np.flatnonzero(amount.is_valid().to_numpy(zero_copy_only=False))
            if not len(use):
                continue
            times, ids = pc.fill_null(amount, 0.0).to_numpy(zero_copy_only=False)[use], at[use]
            cuts = np.flatnonzero(np.diff(place[use], prepend=-1))
            keyed = place[use][cuts]
            total = lambda a: np.add.reduceat(a, cuts, axis=0)  # noqa: B023, E731
            used[i, keyed], known[i, keyed] = total(np.ones(len(use))), total(times * held.rows[ids])
            for c in columns:
                sums[c][i, keyed] = total(held.weighted(c, ids, times))
            if cells is not None:
                cells[i, keyed] = total(held.cells[ids].astype(float))
        return keys.take(pa.array(first)), known, used, cells, sums

    def joined(a: tuple, b: tuple) -> tuple:
        """Both results, the last key of the first being the first of the second."""
        def add(x, y):
            return np.concatenate([x[:, :-1], x[:, -1:] + y[:, :1], y[:, 1:]], axis=1)

        cells = None if a[3] is None else add(a[3], b[3])
        sums = {c: add(a[4][c], b[4][c]) for c in columns}
        return pa.concat_arrays([a[0], b[0].slice(1)]), add(a[1], b[1]), add(a[2], b[2]), cells, sums

    def part(a: tuple, low: int, high: int) -> tuple:
        cut = lambda x: x[:, low:high]
        return a[0].slice(low, high - low), cut(a[1]), cut(a[2]), None if a[3] is None else cut(a[3]), {c: cut(x) for c, x in a[4].items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, held, last = None, [], None, None
        for batch in batches:
            numbers = batch.column("_group").to_numpy().astype(np.int64) * 2 + batch.column("_kind").to_numpy()
            cuts = sorted({0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), *range(0, len(numbers), PIECE), len(numbers)})
            for low, high in zip(cuts[:-1], cuts[1:]):
                if low == high:
                    continue
                if group != numbers[low] // 2:
                    if last:
                        yield batch_of(*last)
                    group, parts, held, last = numbers[low] // 2, [], None, None
                packed = batch.slice(low, high - low)
                if numbers[low] % 2 == 0:
                    parts.append(packed.select(["vec_id", "vec"]))
                    continue
                if parts:
                    held, parts = _Held(parts, dim, columns), []
                if not held:
                    continue
                words = _unpacked(packed, key, amounts)
                for at in range(0, words.num_rows, PIECE):
                    now = keyed_sums(held, words.slice(at, PIECE))
                    if now is None:
                        continue
                    if last:
                        same = last[0][0].as_py() == now[0][0].as_py()
                        if same:
                            now = joined(last, now)
                        else:
                            yield batch_of(*last)
                    size = len(now[0])
                    if size > 1:
                        yield batch_of(*part(now, 0, size - 1))
                    last = part(now, size - 1, size)
        if last:
            yield batch_of(*last)

    return run


def group_count(words: int, vectors: int, width: int, cores: int) -> int:
    """Into how many groups the keys of so many words are dealt, each of which holds up to all vectors.

    A divisor or a multiple of the ``width`` partitions of ``by_key``: the words of one of its files lie in few groups.
    """
    least = max(cores, -(-words // max(GROUP_WORDS, VECTOR_WORDS * vectors)))
    return next((d for d in range(least, width) if width % d == 0), width * -(-least // width))


class WordVectors:
    """A stored table of word vectors: key column, ``vec`` of floats or doubles, size and dimension. Sums are doubles."""

    def __init__(self, table: DataFrame, key: Column, rows: int, dim: int):
        self.table, self.key, self.rows, self.dim = table, key, rows, dim

    def attach(self, words: DataFrame, *columns: str) -> DataFrame:
        """Rows with a known word and its ``vec`` and/or ``unit`` vector; others fall out."""
        table = self.table.withColumn("vec", F.col("vec").cast("array<double>"))
        if "unit" in columns:
            table = table.withColumn("unit", unit(F.col("vec")))
        keyed = words.withColumn("vec_id", self.key)
        row_bytes = 8 * self.dim * len(columns)
        return lookup(keyed, table.select("vec_id", *columns), "vec_id", self.rows, row_bytes)

    def small(self, *columns: str) -> bool:
        """Whether the columns of all vectors may be broadcast."""
        return self.rows * 8 * self.dim * len(columns) <= BROADCAST_BYTES

    def gathered(self, words: DataFrame, key: str, weights: dict[str, Column], columns: tuple[str, ...]) -> DataFrame:
        """(``key``, and for each weight its sum and the vector sums): one row per key with known words.

        Words don't carry their vectors through a shuffle. Keys are dealt to groups of about
        ``GROUP_WORDS`` words, more if the table is large; each group gets every vector that it needs once, in the
        table's own type, and its words read as a stream sorted by key, neighbours of a key packed into one row. A task
        holds the vectors that one group needs, each once. ``weights`` is suffix -> number of times a word counts,
        null for not at all; sums without a word or without a cell are null.
        """
        amounts = {f"_w{i}": c.cast("double") for i, c in enumerate(weights.values())}
        dealt = self.dealt(words.withColumn("vec_id", self.key).where("vec_id IS NOT NULL"), key, amounts)
        fields = [f"{key} {dict(words.dtypes)[key]}"]
        for suffix in weights:
            fields += [f"known{suffix} long", *[f"{c}{suffix} array<double>" for c in columns]]
        return dealt.mapInArrow(_group_sums(key, self.dim, columns, list(weights)), ", ".join(fields))

    def dealt(self, keyed: DataFrame, key: str, amounts: dict[str, Column]) -> DataFrame:
        """(_group, _kind, ``key``, vec_id, vec, vec_ids, and a list for each amount) by group, kind and key: the vectors that a group
        needs with kind 0, one row each, then its words with kind 1, neighbours of a key packed into a row."""
        rows = keyed.select(key, "vec_id", *[c.alias(a) for a, c in amounts.items()])
        kinds = dict(rows.dtypes)
        lists = [f"vec_ids array<{kinds['vec_id']}>", *[f"{a} array<{kinds[a]}>" for a in amounts]]
        rows = written(rows.mapInArrow(_pack(key, list(amounts)), ", ".join([f"{key} {kinds[key]}", *lists])), "keyed_words")
        many = rows.agg(F.sum(F.size("vec_ids"))).first()[0] or 0
        groups = group_count(many, self.rows, shuffle_width(keyed), keyed.sparkSession.sparkContext.defaultParallelism)
        rows = rows.withColumn("_group", F.pmod(F.hash(key), F.lit(groups)))
        size, last = F.size("vec"), F.col("vec")[self.dim - 1]
        cell = dict(self.table.dtypes)["vec"].removeprefix("array<").removesuffix(">")
        vec = (
            F.when(F.col("vec").isNull(), F.array_repeat(F.lit(None).cast(cell), self.dim))
            .when(size < self.dim, F.concat("vec", F.array_repeat(last, self.dim - size)))
            .otherwise(F.slice("vec", 1, self.dim))
        )
        table = self.table.select("vec_id", vec.alias("vec"))
        held = rows.select("_group", F.explode("vec_ids").alias("vec_id")).distinct().join(table, "vec_id")
        # Empty, not null: null lists are slow to send, as their ends are filled in again for each row.
        empty = {c: F.array().cast(kind) for c, kind in [f.split(" ") for f in lists]}
        due = rows.withColumns({"_kind": F.lit(1), "vec": F.array().cast(f"array<{cell}>")})
        return (
            held.withColumns({"_kind": F.lit(0), **empty})
            .unionByName(due, allowMissingColumns=True)
            .select("_group", "_kind", key, "vec_id", "vec", "vec_ids", *amounts)
            .repartitionById(groups, F.col("_group"))
            .sortWithinPartitions("_group", "_kind", key)
        )

    def summed(self, words: DataFrame, *by: str, columns: tuple[str, ...] = ("vec",)) -> DataFrame:
        """Sums of the vectors of the words, each times ``n``, and the number of known words."""
        if len(by) == 1 and not self.small(*columns):
            return self.gathered(words, by[0], {"": F.col("n")}, columns)
        found = self.attach(words.withColumn("_times", F.col("n").cast("double")), *columns)
        names = {c: [f"_{c}{i}" for i in range(self.dim)] for c in columns}
        cells = [
            F.sum(F.col(c)[i] * F.col("_times")).alias(name)
            for c in columns
            for i, name in enumerate(names[c])
        ]
        sums = found.groupBy(*by).agg(F.sum("n").alias("known"), *cells)
        return sums.select(*by, "known", *[F.array(*names[c]).alias(c) for c in columns])


def _side_sums(words: DataFrame, vectors: WordVectors, *columns: str) -> DataFrame:
    """One row per index with the vector sums of title (``_t``) and description (``_d``)."""
    pairs = "n_t" in words.columns
    if not vectors.small(*columns):
        n = {s: F.col(f"n_{s}") for s in "td"}
        times = {f"_{s}": F.when(n[s] > 0, n[s]) if pairs else F.when(F.col("side") == s, F.col("n")) for s in "td"}
        return vectors.gathered(known(words), "index", times, columns)
    if pairs:
        sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"n_{s}").alias("n")) for s in "td"])
        words = words.select("index", "token", F.inline(sides)).where("n > 0")
    sums = vectors.summed(known(words), "index", "side", columns=columns)
    return sums.groupBy("index").agg(
        *[
            F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}")
            for s in "td"
            for c in ("known", *columns)
        ]
    )


def _mean_pair_cosine() -> Column:
    """The mean of the cosines is the product of the mean unit vectors, so no pair is formed."""
    return dot(F.col("unit_t"), F.col("unit_d")) / (F.col("known_t") * F.col("known_d"))


def _mean_cosine() -> Column:
    t, d = F.col("vec_t"), F.col("vec_d")
    return F.try_divide(dot(t, d), F.sqrt(dot(t, t)) * F.sqrt(dot(d, d)))


def pair_mean(words: DataFrame, vectors: WordVectors, name: str = "w2v_score") -> DataFrame:
    """Mean cosine over all pairs of a title word and a description word.

    Rows with a side without known words fall out or are null.
    """
    sums = _side_sums(words, vectors, "unit")
    return sums.select("index", _mean_pair_cosine().alias(name))


def mean_vector_cosine(
    words: DataFrame, vectors: WordVectors, name: str = "sp_score"
) -> DataFrame:
    """Cosine of the mean word vectors of the two texts; null if one has no known word."""
    sums = _side_sums(words, vectors, "vec")
    return sums.select("index", _mean_cosine().alias(name))


def vector_scores(words: DataFrame, vectors: WordVectors) -> DataFrame:
    """Both vector scores, ``w2v_score`` and ``sp_score``, from one lookup of the words."""
    sums = _side_sums(words, vectors, "vec", "unit")
    return sums.select(
        "index", _mean_pair_cosine().alias("w2v_score"), _mean_cosine().alias("sp_score")
    )


def text_vector(texts: DataFrame, tokens: Column, vectors: WordVectors) -> DataFrame:
    """(index, known, vec): sum of the word vectors of each text; texts without one fall out."""
    words = (
        by_key(texts)
        .select("index", F.explode(tokens).alias("token"))
        .groupBy("index", "token")
        .agg(F.count("*").alias("n"))
    )
    return vectors.summed(words, "index")


def _runs(codes: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the runs of equal numbers."""
    ends = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
    return [x for x in zip(ends[:-1], ends[1:]) if x[0] < x[1]]


def by_group(batches: Iterator[pa.RecordBatch], key: str, hold, names: list[str]) -> Iterator[tuple[object, object, list]]:
    """(what ``hold`` makes of a group's vectors, a key as an array of one, arrays of its words by ``names``) from rows as ``dealt`` gives them.

    A group without vectors is held as None. A task holds the vectors of one group and the words of one key.
    """
    group, parts, held, last, words = None, [], None, None, []

    def done() -> tuple:
        return held, last, [pa.concat_arrays([w.column(c).flatten() for w in words]) for c in names]

    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column("_group").to_numpy().astype(np.int64) * 2 + batch.column("_kind").to_numpy()
        for low, high in _runs(codes):
            if group != codes[low] // 2:
                if words:
                    yield done()
                group, parts, held, last, words = codes[low] // 2, [], None, None, []
            rows = batch.slice(low, high - low)
            if codes[low] % 2 == 0:
                parts.append(rows.select(["vec_id", "vec"]))
                continue
            if parts:
                held, parts = hold(parts), []
            place = rows.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy()
            for first, end in _runs(place):
                now = rows.column(key).slice(first, 1)
                if words and not last.equals(now):
                    yield done()
                    words = []
                last = now
                words.append(rows.slice(first, end - first))
    if words:
        yield done()


class HeldRows:
    """The vectors of one group, every row of its own, in order of their ids; rows that are not whole are left out."""

    def __init__(self, parts: list[pa.RecordBatch], dim: int):
        ids = pa.concat_arrays([p.column("vec_id") for p in parts])
        cells = pa.concat_arrays([p.column("vec").flatten() for p in parts])
        whole = cells.is_valid().to_numpy(zero_copy_only=False).reshape(-1, dim).all(axis=1)
        x = pc.fill_null(cells, 0.0).to_numpy(zero_copy_only=False).reshape(-1, dim)
        order = pc.sort_indices(ids).to_numpy()
        order = order[whole[order]]
        ids = ids.take(pa.array(order)).dictionary_encode()
        self.x, self.ids = x[order], ids.dictionary
        self.first = np.searchsorted(ids.indices.to_numpy(), np.arange(len(self.ids) + 1))
        # Looked up for one key's words at a time, so a table of the ids is made once.
        self.sorted = self.ids.to_numpy() if pa.types.is_integer(self.ids.type) else None
        self.table = {x: i for i, x in enumerate(self.ids.to_pylist())} if self.sorted is None else None

    def places(self, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(word, row) of all rows of each word."""
        if self.sorted is None:
            at = np.array([self.table.get(x, -1) for x in ids.to_pylist()], int)
        elif not len(self.sorted):
            at = np.full(len(ids), -1)
        else:
            wanted = pc.fill_null(ids, 0).to_numpy()
            at = np.searchsorted(self.sorted, wanted).clip(max=len(self.sorted) - 1)
            at = np.where((self.sorted[at] == wanted) & ids.is_valid().to_numpy(zero_copy_only=False), at, -1)
        word = np.flatnonzero(at >= 0)
        first, many = self.first[at[word]], np.diff(self.first)[at[word]]
        ends = np.cumsum(many)
        return np.repeat(word, many), np.repeat(first - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)


class HeldUnits(HeldRows):
    """The same, to be read as unit vectors in doubles; the zero vector stays as it is."""

    def __init__(self, parts: list[pa.RecordBatch], dim: int):
        super().__init__(parts, dim)
        norm = np.sqrt(np.einsum("ij,ij->i", self.x, self.x, dtype=float))
        self.norm = np.where((norm > 0) | np.isnan(norm), norm, 1.0)

    def units(self, rows: np.ndarray) -> np.ndarray:
        return self.x[rows].astype(float) / self.norm[rows][:, None]


def _falling(x: np.ndarray, most: int) -> np.ndarray:
    """The largest of each row in falling order; NaN counts as largest, as in a sort of Spark."""
    if x.shape[1] > most:
        x = np.partition(x, x.shape[1] - most, axis=1)[:, -most:]
    return np.sort(x, axis=1)[:, ::-1]


def best_five(t: np.ndarray, t_n: np.ndarray, t_first: np.ndarray, d: np.ndarray, d_n: np.ndarray, title_len: int, block: int) -> np.ndarray:
    """The five values of ``top5_profile`` for the unit vectors of a title and a description, by blocks of words."""
    line = np.zeros(0)
    spread = np.repeat(np.arange(len(d)), np.minimum(d_n, 5))
    if len(t) and len(spread):
        blocks = []
        for i in range(0, len(t), block):
            top = np.zeros((len(t[i : i + block]), 0))
            for j in range(0, len(spread), 8 * block):
                top = _falling(np.concatenate([top, t[i : i + block] @ d[spread[j : j + 8 * block]].T], axis=1), 5)
            blocks.append(top)
        best, times = np.concatenate(blocks), np.minimum(t_n, 5)
        # A word may have several vectors: its five best are those under any of them.
        distinct, place = np.unique(np.stack([t_first, t_n]), axis=1, return_inverse=True)
        if distinct.shape[1] < len(best):
            rows = [_falling(best[place.ravel() == i].reshape(1, -1), 5)[0] for i in range(distinct.shape[1])]
            times = np.minimum(distinct[1], 5)
        else:
            rows = best
        if title_len >= 5:
            line = np.repeat([r.mean() for r in rows], times)
        else:
            line = np.concatenate([np.tile(r, n) for r, n in zip(rows, times)])
    return _falling(np.append(line, np.zeros(max(0, 5 - len(line))))[None], 5)[0]


def top5_profile(words: DataFrame, vectors: WordVectors) -> DataFrame:
    """(index, s1..s5): the five best similarities of the title with the description.

    With at least five title words every word counts by the mean of its five best; with fewer, all
    its similarities count. Missing values are 0.

    Words travel without their vectors: texts are dealt to groups, each of which gets the vectors that it needs once, and are
    read as a stream by index. A task holds one group's vectors, the words of one text, and the similarities of ``BLOCK`` title
    words with a few times as many words of the description, of which it keeps five per title word; word pairs are never rows.
    """
    dim, block = vectors.dim, BLOCK
    there = F.col("token").isNotNull()
    keyed = words.withColumn("vec_id", F.when(there, vectors.key))
    title = (F.col("side") == "t").alias("_title")
    dealt = vectors.dealt(keyed, "index", {"_title": title, "_n": F.col("n"), "_first": F.coalesce("first", F.lit(-1))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, found = [], []

        def rows() -> pa.RecordBatch:
            columns = [pa.array(c) for c in np.array(found, float).T]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), *columns], names=["index", "s1", "s2", "s3", "s4", "s5"])

        for held, key, (ids, *cells) in by_group(batches, "index", lambda parts: HeldUnits(parts, dim), ["vec_ids", "_title", "_n", "_first"]):
            side, n, first = (c.to_numpy(zero_copy_only=False) for c in cells)
            side = side.astype(bool)
            word, row = held.places(ids) if held else (np.zeros(0, int), np.zeros(0, int))
            t, d = np.flatnonzero(side[word]), np.flatnonzero(~side[word])
            units = [held.units(row[x]) if held else np.zeros((0, dim)) for x in (t, d)]
            keys.append(key)
            found.append(best_five(units[0], n[word[t]], first[word[t]], units[1], n[word[d]], int(n[side].sum()), block))
            if len(keys) == PIECE:
                yield rows()
                keys, found = [], []
        if keys:
            yield rows()

    kind = dict(words.dtypes)["index"]
    return dealt.mapInArrow(run, f"index {kind}, " + ", ".join(f"s{i} double" for i in range(1, 6)))
