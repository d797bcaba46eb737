"""Benchmark decontamination: a prefix-filtered join of word shingles, verified word by word.

An item's windows are ``window`` consecutive words; a shorter item is one window. A window is a set
of positioned shingles of ``shingle`` words (of all its words, if it has fewer), and a document
holds it exactly where it holds all of them at the right distances. As the containment asked for is
1, one shingle, the rarest in the corpus, is the necessary prefix: only its occurrences propose
windows. A proposal must lie inside the document (position and length), and is verified by counting
the window's shingles at their positions, compared as whole strings.

Only DataFrame functions are used. The documents' shingles are streamed past the benchmark's, which
are broadcast while they fit 64 MB and met by a shuffled join beyond that; what matches is stored
once and serves the rarity counts, the proposals and the verification.

Null or empty texts have no words and are never contaminated; an item without words has no window.
Equal items count each with their own id, null ids of items are skipped in ``items`` lists but hit
words. Repeated documents are judged alike, each on its own row. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MISSING_ID, doc_key, fits_broadcast, text_key, written

WINDOW = 13
SHINGLE = 5
#: A word is a run of ASCII digits, lower-case ASCII letters and anything beyond ASCII.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words after lower-casing A-Z only; pure ASCII takes the faster way to the same result."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def _shingles(df: DataFrame, size: int, *keys: str) -> DataFrame:
    """One row (keys, pos, w0 .. w(size-1)) for each run of ``size`` words of the column ``words``."""
    n = F.size("words")
    parts = [F.sequence(F.lit(0), n - size).alias("pos")]
    parts += [F.slice("words", i + 1, n - (size - 1)).alias(f"w{i}") for i in range(size)]
    return df.where(n >= size).select(*keys, F.inline(F.arrays_zip(*parts)))


def _joined(size: int) -> Column:
    return F.concat_ws(" ", *[f"w{i}" for i in range(size)])


def item_windows(benchmark: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """(windows: win, item_id, len; parts: win, off, shingle, size; the sizes of shingles)."""
    items = benchmark.select(F.col("item_id"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    n = F.size("words")
    length = F.least(F.lit(window), n)
    windows = items.select(
        "item_id", F.explode(F.sequence(F.lit(0), n - length)).alias("at"), length.alias("len"), "words"
    ).select("item_id", "len", F.slice(F.col("words"), F.col("at") + 1, F.col("len")).alias("words"))
    # Equal windows are one, whatever the number of items that hold them.
    windows = windows.withColumn("win", F.concat_ws(" ", "words"))
    held = written(windows.groupBy("win", "len", "words").agg(F.collect_set("item_id").alias("items")), "windows")
    size = F.least(F.lit(shingle), F.col("len"))
    parts = held.select(
        "win", "len", F.explode(F.sequence(F.lit(0), F.col("len") - size)).alias("off"), size.alias("size"), "words"
    ).select("win", "len", "off", "size", F.array_join(F.slice(F.col("words"), F.col("off") + 1, F.col("size")), " ").alias("shingle"))
    sizes = sorted(r[0] for r in parts.select("size").distinct().collect())
    return held, parts, sizes


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE
) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated) for each row of ``docs``.

    ``items`` are the ids, sorted as strings, of items with a window in the text. A document is
    contaminated if at least a twentieth of its words is hit.
    """
    return _judged(docs, benchmark, window, shingle).drop("_id", "_row")


def _judged(docs: DataFrame, benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    row = text_key()
    held, parts, sizes = item_windows(benchmark, window, shingle)
    small = fits_broadcast(parts.count(), 400)
    hint = F.broadcast if small else (lambda df: df)
    texts = docs.select(
        doc_key().alias("_id"), row.alias("_row"), words(F.col("text")).alias("words")
    )

    # Occurrences of benchmark shingles: compared by hash first, then as strings.
    wanted = parts.select("size", "shingle").distinct()
    found = []
    for size in sizes:
        keys = wanted.where(F.col("size") == size).select(
            F.xxhash64(*[F.split("shingle", " ")[i] for i in range(size)]).alias("code"), "shingle"
        )
        runs = _shingles(texts, size, "_id", "_row").withColumn(
            "code", F.xxhash64(*[f"w{i}" for i in range(size)])
        )
        met = runs.join(hint(keys), "code").where(F.col("shingle") == _joined(size))
        found.append(met.select("_id", "_row", "pos", "shingle"))
    if found:
        seen = found[0]
        for more in found[1:]:
            seen = seen.unionByName(more)
    else:
        spark = docs.sparkSession
        seen = spark.createDataFrame([], "_id long, _row long, pos int, shingle string")
    seen = written(seen.distinct(), "occurrences")

    # The rarest shingle of a window proposes it; ties go to the earlier one.
    rarity = seen.groupBy("shingle").agg(F.count("*").alias("n"))
    ranked = parts.join(rarity, "shingle", "left").groupBy("win").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "shingle")).alias("rarest"),
        F.first("len").alias("len"), F.count("*").alias("shingles"),
    ).where("rarest.n > 0")
    prefix = ranked.select("win", "len", "shingles", "rarest.off", "rarest.shingle")
    lengths = docs.select(doc_key().alias("_id"), row.alias("_row"), F.size(words(F.col("text"))).cast("long").alias("n_words"), F.col("doc_id"))
    proposed = (
        seen.join(hint(prefix), "shingle")
        .select("_id", "_row", (F.col("pos") - F.col("off")).alias("at"), "win", "len", "shingles")
        .where("at >= 0")
    )
    wanted_at = proposed.join(hint(parts.select("win", "off", "shingle")), "win").select(
        "_id", "_row", "win", "len", "at", "shingles", (F.col("at") + F.col("off")).alias("pos"), "shingle"
    )
    hits = (
        wanted_at.join(seen, ["_id", "_row", "pos", "shingle"])
        .groupBy("_id", "_row", "win", "at", "len", "shingles")
        .agg(F.count("*").alias("n"))
        .where("n = shingles")
    )
    hits = written(hits.select("_id", "_row", "win", "at", "len"), "hits")
    covered = (
        hits.select("_id", "_row", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("len") - 1)).alias("pos"))
        .distinct().groupBy("_id", "_row").agg(F.count("*").alias("n_hit"))
    )
    items = (
        hits.select("_id", "_row", "win").distinct()
        .join(hint(held.select("win", F.explode("items").alias("item"))), "win")
        .select("_id", "_row", F.col("item").cast("string").alias("item")).distinct()
        .groupBy("_id", "_row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    judged = covered.join(items, ["_id", "_row"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return (
        lengths.join(judged, ["_id", "_row"], "left")
        .select("_id", "_row", "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE
) -> DataFrame:
    """``docs`` without the contaminated rows."""
    bad = _judged(docs, benchmark, window, shingle).where("contaminated").select(
        F.col("_id").alias("_bad_id"), F.col("_row").alias("_bad_row")
    ).distinct()
    return docs.join(bad, (doc_key() == bad["_bad_id"]) & (text_key() == bad["_bad_row"]), "left_anti")
