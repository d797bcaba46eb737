"""Splits, folds and metrics on a score by rule, so that every number can be checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, features, profile
from . import sql
from .catalog import labels, products, scored, table
from .registry import query

_SHARE = "(('0x' || substr(md5(index::VARCHAR), 1, 8))::BIGINT / 4294967296.0)"


@query(
    "eval_split",
    f"""WITH {sql.LABELS} SELECT index, concise, CASE WHEN {_SHARE} < 0.7 THEN 'train' ELSE 'test' END AS part
FROM lab""",
)
def _(spark, sf_dir):
    train, test = evaluate.split(labels(spark, sf_dir).select("index", "concise"))
    return train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test"))
    )


def _folds_sql(k: int) -> str:
    return f"""SELECT doc_id, (SELECT min(f) FROM range({k}) t(f) WHERE r < (f + 1) * (n // {k})
  + least(f + 1, n % {k}))::INTEGER AS fold
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, (SELECT count(*) FROM labels) AS n
  FROM labels)"""


for _name, _k in (("eval_kfold", 10), ("eval_kfold_5", 5)):

    @query(_name, _folds_sql(_k))
    def _(spark, sf_dir, k=_k):
        rows = table(spark, sf_dir, "labels").select("doc_id")
        return evaluate.with_folds(rows, k, "doc_id").select("doc_id", "fold")


@query(
    "eval_oversample",
    f"""WITH {sql.LABELS} SELECT index, concise,
  unnest(range(1, CASE WHEN concise = 0 THEN 11 ELSE 2 END))::INTEGER AS copy FROM lab""",
)
def _(spark, sf_dir):
    rows = labels(spark, sf_dir).select("index", "concise")
    return evaluate.oversample(rows, "concise").select("index", "concise", "copy")


@query(
    "agg_confusion",
    f"WITH {sql.SCORED} SELECT label, prediction, count(*) AS n FROM scored GROUP BY label, prediction",
)
def _(spark, sf_dir):
    return evaluate.confusion(scored(spark, sf_dir))


@query(
    "eval_accuracy",
    f"""WITH {sql.SCORED} SELECT round(avg((label = prediction)::INTEGER), 9) AS accuracy FROM scored""",
)
def _(spark, sf_dir):
    return scored(spark, sf_dir).agg(F.round(evaluate.accuracy(), 9).alias("accuracy"))


@query(
    "eval_rmse",
    f"""WITH {sql.SCORED} SELECT round(sqrt(avg((label - score) ** 2)), 9) AS rmse_score,
  round(sqrt(avg((label - prediction) ** 2)), 9) AS rmse_prediction FROM scored""",
)
def _(spark, sf_dir):
    return scored(spark, sf_dir).agg(
        F.round(evaluate.rmse("label", "score"), 9).alias("rmse_score"),
        F.round(evaluate.rmse("label", "prediction"), 9).alias("rmse_prediction"),
    )


@query(
    "eval_f1_macro",
    f"""WITH {sql.SCORED}, f AS (SELECT k, 2.0 * count(*) FILTER (label = k AND prediction = k)
    / (count(*) FILTER (label = k) + count(*) FILTER (prediction = k)) AS f1
  FROM scored, (VALUES (0), (1)) v(k) GROUP BY k)
SELECT round(avg(f1)::DOUBLE, 9) AS f1_macro FROM f""",
)
def _(spark, sf_dir):
    out = evaluate.f1_macro(scored(spark, sf_dir))
    return out.select(F.round("f1_macro", 9).alias("f1_macro"))


@query(
    "eval_auc",
    f"""WITH {sql.SCORED} SELECT round(avg(CASE WHEN a.score > b.score THEN 1.0
  WHEN a.score = b.score THEN 0.5 ELSE 0.0 END)::DOUBLE, 9) AS auc
FROM scored a, scored b WHERE a.label = 1 AND b.label = 0""",
)
def _(spark, sf_dir):
    out = evaluate.auc(scored(spark, sf_dir))
    return out.select(F.round("auc", 9).alias("auc"))


@query(
    "eval_threshold_sweep",
    f"""WITH {sql.SCORED}, s AS (SELECT {sql.SEG_A} AS seg_a, label, score, t AS threshold,
    CASE WHEN score > t THEN 1 ELSE 0 END AS p
  FROM scored, (VALUES (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)) v(t))
SELECT seg_a, threshold, count(*) AS n, round(avg((label = p)::INTEGER), 9) AS accuracy,
  round(avg(1 - p), 9) AS zero_share, round(sqrt(avg((label - score) ** 2)), 9) AS rmse,
  count(*) FILTER (label = 0 AND p = 0) AS tn, count(*) FILTER (label = 0 AND p = 1) AS fp,
  count(*) FILTER (label = 1 AND p = 0) AS fn, count(*) FILTER (label = 1 AND p = 1) AS tp
FROM s GROUP BY seg_a, threshold""",
)
def _(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("seg_a", features.in_segment_a())
    out = evaluate.threshold_sweep(rows, ["seg_a"])
    return out.withColumns({c: F.round(c, 9) for c in ("accuracy", "zero_share", "rmse")})


_OUTLIER = ("title_character_count", "nsw_tokens", "des_tokens")


@query(
    "ml_outlier_flag",
    f"""WITH {sql.CONCISE}, x AS (SELECT index, {sql.SEG_A} AS seg_a, {", ".join(_OUTLIER)}
  FROM concise_features),
  z AS (SELECT index, seg_a, {" + ".join(
      f"(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()) ** 2" for c in _OUTLIER)} AS d FROM x),
  r AS (SELECT index, seg_a, round(d, 6) AS distance FROM z),
  q AS (SELECT seg_a, quantile_cont(distance, 0.98) AS cut FROM r GROUP BY seg_a)
SELECT index, seg_a, distance, distance > cut AS outlier FROM r JOIN q USING (seg_a)""",
)
def _(spark, sf_dir):
    rows = features.concise_features(products(spark, sf_dir)).select(
        "index", features.in_segment_a().alias("seg_a"), *_OUTLIER
    )
    distance = sum(F.col(c) * F.col(c) for c in _OUTLIER)
    return outliers(
        profile.zscore(rows, _OUTLIER).select("index", "seg_a", F.round(distance, 6).alias("distance"))
    )


def outliers(rows, share: float = 0.02):
    """Rows whose distance lies above the (1 - share) quantile of their segment."""
    cut = evaluate.quantile(rows, "distance", "seg_a", 1 - share)
    # One row per segment: a broadcast of fixed size.
    marked = rows.join(F.broadcast(cut), "seg_a")
    return marked.select("index", "seg_a", "distance", (F.col("distance") > F.col("cut")).alias("outlier"))
