"""Dictionary, bags of words and topics, all kept as tables.

A dictionary numbers the terms by falling frequency. A bag is rows (document, term number, count).
Topics are learnt by online variational inference: the topic-word weights are a table with one row per term,
which each round joins to the words of a mini-batch of documents. Tasks infer the topic shares of their documents,
the words' expected topics are summed by term, and the next weights are stored. The driver holds
no vocabulary, only a few numbers per topic.

Several models, here one per segment, are learnt in the same rounds; their rows carry ``model``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.evaluate import share
from ..operators.layout import BROADCAST_BYTES, order_index
from ..session import written

#: Settings of online inference: rounds, share of the documents in a round, and its weight in round t,
#: (DELAY + t) to the power -DECAY.
ROUNDS = 20
BATCH_SHARE = 0.05
DELAY, DECAY = 1024, 0.51
#: Size of the most frequent terms' weights of one model that a round broadcasts: all rounds together pass through the driver.
ROUND_BYTES = 8 << 20
#: A document's shares are final when they change by less on average, or after so many updates.
CHANGE, UPDATES = 1e-3, 100


# ---- dictionary and bags -------------------------------------------------------------------------


def term_totals(rows: DataFrame, tokens: str) -> DataFrame:
    """(term, n): occurrences of every term."""
    return rows.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def dictionary(rows: DataFrame, tokens: str) -> DataFrame:
    """(term, n, term_id): every term, numbered from 0 by falling frequency, equal ones by term; stored."""
    return order_index(term_totals(rows, tokens), [F.desc("n"), F.asc("term")], "term_id")


def frequent_first(rows: DataFrame, table: DataFrame, terms: int, row_bytes: int, key: str, on: list[str]) -> DataFrame:
    """Inner join of rows with a table whose ``key`` numbers terms by falling frequency.

    As many of the most frequent terms as fit a round's broadcast meet their rows by a broadcast, so hot words
    don't move; the rest, none of it hot, is joined by a shuffle. ``terms`` is the number of all terms.
    """
    limit = min(ROUND_BYTES, BROADCAST_BYTES) // row_bytes
    head = F.col(key) < limit
    found = rows.where(head).join(F.broadcast(table.where(head)), on)
    return found if terms <= limit else found.unionByName(rows.where(~head).join(table.where(~head), on))


def bags(rows: DataFrame, tokens: str, terms: DataFrame, *keep: str) -> DataFrame:
    """(``keep`` ..., term_id, n): distinct terms of each row with their counts.

    ``keep`` starts with the row's unique key. A word meets its number through the hot terms' broadcast or a shuffle
    by term; both sides keep words only, no texts.
    """
    words = rows.select(*keep, F.explode(tokens).alias("term")).groupBy(*keep, "term").agg(F.count("*").alias("n"))
    limit = BROADCAST_BYTES // 64
    numbers = terms.select("term", "term_id")
    head = numbers.where(F.col("term_id") < limit)
    out = words.join(F.broadcast(head), "term")
    if not terms.where(F.col("term_id") >= limit).isEmpty():
        rest = words.join(F.broadcast(head), "term", "left_anti")
        out = out.unionByName(rest.join(numbers.where(F.col("term_id") >= limit), "term"))
    return out.select(*keep, "term_id", "n")


# ---- inference -----------------------------------------------------------------------------------


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of the logarithm of the gamma function, for positive numbers."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(6):  # the asymptotic series is exact enough from 6 on
        small = x < 6
        out -= np.where(small, 1 / x, 0)
        x = np.where(small, x + 1, x)
    inverse = 1 / (x * x)
    series = inverse * (1 / 12 - inverse * (1 / 120 - inverse * (1 / 252 - inverse * (1 / 240 - inverse / 132))))
    return out + np.log(x) - 0.5 / x - series


def infer(owner: np.ndarray, n: np.ndarray, words: np.ndarray, docs: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(gamma, expected counts): topic weights of each document, and of each of its words.

    ``words`` holds exp(E[log beta]) of each row's term; ``owner`` is ascending. A document's result depends on its own
    rows alone.
    """
    k = words.shape[1]
    gamma = np.ones((docs, k))
    starts = np.searchsorted(owner, np.arange(docs))

    def shares(g: np.ndarray) -> np.ndarray:
        return np.exp(digamma(g) - digamma(g.sum(axis=1, keepdims=True)))

    active = np.arange(docs)
    rows = np.arange(len(owner))
    place = owner
    at = starts
    for _ in range(UPDATES):
        theta = shares(gamma[active])
        norm = np.einsum("ij,ij->i", theta[place], words[rows]) + 1e-100
        new = alpha + theta * np.add.reduceat(words[rows] * (n[rows] / norm)[:, None], at, axis=0)
        moved = np.abs(new - gamma[active]).mean(axis=1) >= CHANGE
        gamma[active] = new
        if not moved.all():
            kept = moved[place]
            rows = rows[kept]
            active = active[moved]
            if not len(active):
                break
            place = np.searchsorted(active, owner[rows])
            at = np.searchsorted(place, np.arange(len(active)))
    theta = shares(gamma)
    norm = np.einsum("ij,ij->i", theta[owner], words) + 1e-100
    return gamma, theta[owner] * words * (n / norm)[:, None]


def _grouped(batch: pa.RecordBatch, k: int):
    """(owner, terms, counts, exp(E[log beta])) of a batch of documents with their words and totals."""
    words = batch.column("words")
    inner = words.flatten()
    sizes = np.diff(words.offsets.to_numpy())
    owner = np.repeat(np.arange(len(sizes)), sizes)
    weights = inner.field("weights").flatten().to_numpy().reshape(-1, k)
    totals = batch.column("totals").flatten().to_numpy().reshape(-1, k)
    beta = np.exp(digamma(weights) - digamma(totals)[owner])
    return owner, inner.field("term_id").to_numpy(), inner.field("n").to_numpy().astype(float), beta


def _normal(*parts: Column) -> Column:
    """A standard normal number that depends on the parts alone."""
    unit = lambda name: (F.xxhash64(F.lit(name), *parts).bitwiseAND((1 << 52) - 1) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(unit("radius"))) * F.cos(2 * np.pi * unit("angle"))


class Topics:
    """Topic-word weights: ``table`` (model, term_id, weights array<double>) of ``k`` topics; stored.

    ``terms`` is the number of terms, whose numbers fall with frequency.
    """

    def __init__(self, table: DataFrame, k: int, terms: int):
        self.table, self.k, self.terms = table, k, terms

    def totals(self) -> DataFrame:
        """(model, totals): sums of the weights of each topic, one row per model."""
        cells = [F.sum(F.col("weights")[i]) for i in range(self.k)]
        return self.table.groupBy("model").agg(F.array(*cells).alias("totals"))

    def with_words(self, rows: DataFrame, key: str) -> DataFrame:
        """(model, key, words, totals): the words of each document with their weights."""
        found = frequent_first(rows, self.table, self.terms, 8 * self.k + 48, "term_id", ["model", "term_id"])
        listed = F.collect_list(F.struct("term_id", "n", "weights")).alias("words")
        return found.groupBy("model", key).agg(listed).join(F.broadcast(self.totals()), "model")

    def strongest(self, terms: DataFrame, most: int) -> DataFrame:
        """(model, topic, rank, term, weight): the terms of largest share of each topic; ties by number."""
        cells = self.table.select("model", "term_id", F.posexplode("weights").alias("topic", "weight"))
        order = Window.partitionBy("model", "topic").orderBy(F.desc("weight"), "term_id")
        best = cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
        best = best.join(F.broadcast(self.totals()), "model")
        # models x topics x most rows: the dictionary need not move for them.
        named = terms.select("term_id", "term").join(F.broadcast(best), "term_id")
        return named.select("model", "topic", "rank", "term", (F.col("weight") / F.col("totals")[F.col("topic")]).alias("weight"))

    def shares(self, rows: DataFrame, key: str, alpha: float | None = None) -> DataFrame:
        """(model, key, shares): the topic shares of each document with known words."""
        k, alpha = self.k, alpha or 1 / self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                owner, _, n, beta = _grouped(batch, k)
                gamma, _ = infer(owner, n, beta, batch.num_rows, alpha) if batch.num_rows else (np.zeros((0, k)), None)
                values = (gamma / gamma.sum(axis=1, keepdims=True)).ravel()
                ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * k)
                lists = pa.ListArray.from_arrays(ends, pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column("model"), batch.column(key), lists], names=["model", key, "shares"])

        kinds = dict(rows.dtypes)
        return self.with_words(rows, key).mapInArrow(run, f"model {kinds['model']}, {key} {kinds[key]}, shares array<double>")


def _expected(rows: DataFrame, topics: Topics, key: str, alpha: float) -> DataFrame:
    """(model, term_id, s0, s1, ...): expected counts of each term in each topic over the documents."""
    k = topics.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            owner, terms, n, beta = _grouped(batch, k)
            _, expected = infer(owner, n, beta, batch.num_rows, alpha)
            models = batch.column("model").dictionary_encode()
            code = models.indices.to_numpy()[owner].astype(np.int64) << 48 | terms
            order = np.argsort(code, kind="stable")
            distinct, first = np.unique(code[order], return_index=True)
            sums = np.add.reduceat(expected[order], first, axis=0)
            arrays = [models.dictionary.take(pa.array(distinct >> 48)), pa.array(distinct & (1 << 48) - 1)]
            yield pa.RecordBatch.from_arrays(
                [*arrays, *map(pa.array, sums.T.copy())], names=["model", "term_id", *(f"s{i}" for i in range(k))]
            )

    kind = dict(rows.dtypes)["model"]
    cells = ", ".join(f"s{i} double" for i in range(k))
    found = topics.with_words(rows, key).mapInArrow(run, f"model {kind}, term_id long, {cells}")
    return found.groupBy("model", "term_id").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])


def learn(
    rows: DataFrame, key: str, terms: int, k: int = 5, rounds: int = ROUNDS, batch_share: float = BATCH_SHARE, seed: int = 42
) -> Topics:
    """Topics of the bags (``key``, model, term_id, n), which should be stored.

    Prior weights are 1/k for documents and topics. First weights and the documents of a round depend on numbers,
    keys and the seed alone. A round without documents of a model leaves that model as it is. ``k`` is small: weights are one
    column per topic in the sums.
    """
    prior = 1 / k
    first = F.array(*[F.greatest(F.lit(0.01), 1 + 0.1 * _normal(F.col("term_id"), F.lit(i), F.lit(seed))) for i in range(k)])
    seen = rows.select("model", "term_id").distinct()
    topics = Topics(written(seen.withColumn("weights", first), "topic_words"), k, terms)

    def chosen(t: int) -> Column:
        return share(F.concat_ws(":", F.col(key).cast("string"), F.lit(f"round {seed} {t}"))) < batch_share

    docs = written(rows.groupBy("model", key).agg(F.lit(1).alias("one")), "documents")
    counts = [F.count("*").alias("all"), *[F.count_if(chosen(t)).alias(f"b{t}") for t in range(rounds)]]
    sizes = written(docs.groupBy("model").agg(*counts), "batch_sizes")  # one row per model
    for t in range(rounds):
        weight = (DELAY + t + 1) ** -DECAY
        expected = _expected(rows.where(chosen(t)), topics, key, prior)
        times = F.try_divide(F.col("all"), F.col(f"b{t}"))
        scale = sizes.select("model", times.alias("scale"))
        joined = topics.table.join(expected, ["model", "term_id"], "left").join(F.broadcast(scale), "model")
        cells = [
            (1 - weight) * F.col("weights")[i] + weight * (prior + F.col("scale") * F.coalesce(f"s{i}", F.lit(0.0)))
            for i in range(k)
        ]
        new = F.when(F.col("scale").isNull(), F.col("weights")).otherwise(F.array(*cells))
        topics = Topics(written(joined.select("model", "term_id", new.alias("weights")), "topic_words"), k, terms)
    return topics
