"""Training frames, splits, tuning and prediction frames.

Feature frames are numeric and narrow: they are written once to the shared folder, and all fits
and folds read that table instead of computing token features again. Splits and folds depend on
the row's key alone, so they do not change with the partitioning or between runs.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate, features
from ..schemas import CONCISE_FEATURES
from ..session import written

FOLDS = 3
SEED = 42
ROWS_PER_TASK = 50_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """A training frame written once, read in no more tasks than its rows are worth.

    Iterative fits start many jobs over the frame, so small frames are read by few tasks; large
    ones keep all their partitions.
    """
    kept = written(df, name)
    return kept.coalesce(max(1, kept.count() // ROWS_PER_TASK))


def assembled(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """``features`` and ``label``, both complete: rows with a null among them are refused."""
    joined = VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)
    return joined.withColumn("label", F.col(label).cast("double"))


def concise_frame(products: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled products with the nine features of the conciseness model, stored."""
    rows = features.concise_features(products).drop("title", "description")
    rows = stored(
        rows.join(labels, "index").select("index", "category_1", "concise", *CONCISE_FEATURES),
        "concise_frame",
    )
    return assembled(rows, CONCISE_FEATURES, "concise").select(
        "index", "category_1", "features", "label"
    )


def with_fold(df: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Fold number from a second hash of the key, independent of the train/test share."""
    mark = evaluate.share(F.concat(F.lit("fold"), F.col("index").cast("string")))
    return df.withColumn("fold", F.floor(mark * folds).cast("int"))


def cross_validated(
    estimator: Estimator, grid: list[dict], folds: int = FOLDS, parallelism: int = 4, evaluator=None
) -> CrossValidator:
    return CrossValidator(
        estimator=estimator,
        estimatorParamMaps=grid,
        evaluator=evaluator or BinaryClassificationEvaluator(),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
        seed=SEED,
    )


def train_validation(
    estimator: Estimator, grid: list[dict], ratio: float, evaluator=None, parallelism: int = 4
) -> TrainValidationSplit:
    return TrainValidationSplit(
        estimator=estimator,
        estimatorParamMaps=grid,
        evaluator=evaluator or BinaryClassificationEvaluator(),
        trainRatio=ratio,
        parallelism=parallelism,
        seed=SEED,
    )


def final_gbt() -> tuple[GBTClassifier, list[dict]]:
    """The final conciseness model: estimator and tuning grid."""
    gbt = GBTClassifier(maxIter=10, maxDepth=3, seed=SEED)
    grid = (
        ParamGridBuilder()
        .addGrid(gbt.maxBins, [32, 16])
        .addGrid(gbt.minInfoGain, [0.0, 2.0, 5.0])
        .build()
    )
    return gbt, grid


def fit_and_score(model, train: DataFrame, test: DataFrame) -> DataFrame:
    return model.fit(train).transform(test)


def per_category(
    df: DataFrame, names: Sequence[str], workers: int = 4, category: str = "category_1"
) -> DataFrame:
    """One tuned model per category; the scored test rows of all of them.

    The fits are separate Spark jobs submitted by a few threads. A category whose training rows
    have one class only gets that class as its prediction and is marked in ``model``; one without
    training rows gets null predictions.
    """
    df = with_fold(df)
    train, test = evaluate.split(df)
    counts = train.groupBy(category).agg(
        F.min("label").alias("low"), F.max("label").alias("high")
    )
    counts = counts.where(F.col(category).isin(list(names)))  # one row per model
    classes = {r[category]: (r["low"], r["high"]) for r in counts.collect()}

    def one(name: str) -> DataFrame:
        here = F.col(category) == name
        if name not in classes:
            nothing = F.lit(None).cast("double")
            return test.where(here).select(
                "index", category, "label", nothing.alias("prediction"), nothing.alias("p1"),
                F.lit("no training rows").alias("model"),
            )
        low, high = classes[name]
        if low == high:
            rows = test.where(here).withColumn("prediction", F.lit(low))
            return rows.select(
                "index", category, "label", "prediction", F.lit(low).alias("p1"),
                F.lit("single class").alias("model"),
            )
        gbt, grid = final_gbt()
        model = cross_validated(gbt, grid, parallelism=2).fit(train.where(here))
        rows = predictions(model.transform(test.where(here)), category)
        return rows.withColumn("model", F.lit("gbt"))

    with ThreadPoolExecutor(workers) as pool:
        parts = list(pool.map(one, names))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def predictions(scored: DataFrame, *more: str) -> DataFrame:
    """index, label, prediction and the probability of class 1."""
    return scored.select(
        "index", *more, "label", "prediction", F.round(vector_to_array("probability")[1], 9).alias("p1")
    )


def pipeline(*stages) -> Pipeline:
    return Pipeline(stages=list(stages))
