"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from . import alignment, anchors, decontam, golay, graph_index, hamming, lang_id, mixing, pieces, quality, spelling, token_count, url_filter
from .common import remainder, table


def hex64(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


@query("op1_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(3) == 1
    model = lang_id.fit(docs, ~held_out)
    return lang_id.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model, "doc_id", "held_out")


@query("op3_substring_dedup")
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.removals(table(spark, sf_dir, "documents")).drop("kept")


@query("op4_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = golay.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", hex64("fp").alias("fingerprint"), "component_id")


DECONTAMINATION = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT item_id, least(13, len(w)) AS l, array_to_string(w[s + 1 : s + least(13, len(w))], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS s FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM win),
runs AS (
  SELECT doc_id, s, l, array_to_string(w[s + 1 : s + l], ' ') AS win
  FROM (SELECT doc_id, w, l, unnest(range(0, len(w) - l + 1)) AS s FROM dw, lens WHERE len(w) >= l)),
hit AS (SELECT r.doc_id, r.s, r.l, win.item_id FROM runs r JOIN win ON r.win = win.win AND r.l = win.l),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM (SELECT DISTINCT doc_id, s, l FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query("op9_benchmark_decontamination", DECONTAMINATION)
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query("op5_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder(4) == 2
    found = quality.quality_scores(docs, labels.select("doc_id", F.col("quality").alias("label")), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


TOKEN_LIMIT = 2048


@query("op6_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query("op7_url_filters")
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(table(spark, sf_dir, "pages"))


@query("op8_sentencepiece")
def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op10_lm_scoring")
def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scores(table(spark, sf_dir, "documents"), remainder(7) == 2)


NEIGHBOURS = 20


@query("op2_nearest_neighbours")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph_index.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    graphs = graph_index.index(rows, NEIGHBOURS + 1)
    found = graph_index.nearest(graphs, rows.where(F.col("id") % 20 == 0), NEIGHBOURS)
    return found.withColumnRenamed("id", "vec_id")


@query("op11_minhash_near_dedup")
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.near_duplicates(table(spark, sf_dir, "documents"))


@query("op12_spelling_variants")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op13_tokenizer_alignment")
def tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.alignment(table(spark, sf_dir, "documents"), *paths)
