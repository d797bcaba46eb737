"""Estimators on the given tables. Most cannot be written in SQL; tests check their invariants."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    PCA,
    OneHotEncoder,
    StringIndexer,
    VectorAssembler,
    VectorIndexer,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, words
from ..functions.stems import snowball, stems
from ..models import boosting, grouped, network, outliers, tagger, topics, training, vectors
from ..operators import evaluate, features, lexicon, profile, similarity
from ..schemas import (
    CATEGORIES,
    CLARITY_FEATURES,
    CONCISE_FEATURES,
    COUNT_COLUMNS,
    EARLY_FEATURES,
    SCORE_COLUMNS,
)
from ..session import written
from . import sql
from .catalog import labels, products, word_vectors
from .registry import QUERIES, query
from .similarity_queries import clarity_frame

SEED = training.SEED


def concise_frame(spark, sf_dir) -> DataFrame:
    return training.concise_frame(products(spark, sf_dir), labels(spark, sf_dir))


def labelled_clarity(spark, sf_dir) -> DataFrame:
    """Labelled products with the clarity features, stored once."""
    rows = clarity_frame(spark, sf_dir).join(labels(spark, sf_dir), "index")
    seg = products(spark, sf_dir, False).select("index", features.in_segment_a().alias("seg_a"))
    return training.stored(rows.join(seg, "index"), "clarity_frame")


# ---- transformers -------------------------------------------------------------------------------


@query(
    "ml_count_vectorizer",
    f"""WITH {sql.TOKENS}, o AS (SELECT unnest(nsw) AS term FROM toks)
SELECT term, count(*) AS n FROM o GROUP BY term""",
)
def _(spark, sf_dir):
    rows = products(spark, sf_dir).select(text.useful_words(F.col("title")).alias("tokens"))
    return topics.term_totals(rows, "tokens")


@query(
    "ml_bag_of_words",
    f"""WITH {sql.TOKENS}, o AS (SELECT index, unnest(nsw) AS term FROM toks),
  d AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) - 1 AS term_id FROM o GROUP BY term)
SELECT index, term_id, count(*) AS n FROM o JOIN d USING (term) GROUP BY index, term_id""",
)
def _(spark, sf_dir):
    """Titles as sparse count vectors over a dictionary numbered by falling frequency."""
    rows = products(spark, sf_dir).select("index", text.useful_words(F.col("title")).alias("tokens"))
    return topics.bags(rows, "tokens", topics.dictionary(rows, "tokens"), "index")


@query(
    "ml_assemble",
    f"""WITH {sql.CONCISE}, {sql.LABELS} SELECT index, concise::DOUBLE AS label, {", ".join(
        f"{c}::DOUBLE AS {c}" for c in CONCISE_FEATURES)}
FROM concise_features JOIN lab USING (index)""",
)
def _(spark, sf_dir):
    rows = concise_frame(spark, sf_dir).withColumn("v", vector_to_array("features"))
    return rows.select(
        "index", "label", *[F.col("v")[i].alias(c) for i, c in enumerate(CONCISE_FEATURES)]
    )


@query(
    "ml_one_hot",
    f"""WITH {sql.PRODUCTS} SELECT index, {", ".join(
        f"(category_1 = {sql.quoted([c])})::INTEGER::DOUBLE AS is_{i}"
        for i, c in enumerate(sorted(CATEGORIES)))} FROM products""",
)
def _(spark, sf_dir):
    rows = products(spark, sf_dir, False).select("index", "category_1")
    number = StringIndexer(
        inputCol="category_1", outputCol="number", stringOrderType="alphabetAsc"
    )
    hot = OneHotEncoder(inputCol="number", outputCol="hot", dropLast=False)
    out = training.pipeline(number, hot).fit(rows).transform(rows)
    out = out.withColumn("v", vector_to_array("hot"))
    return out.select("index", *[F.col("v")[i].alias(f"is_{i}") for i in range(len(CATEGORIES))])


@query(
    "ml_indexers",
    f"""WITH {sql.CONCISE}, {sql.LABELS}, r AS (SELECT index, category_1, clarity, repeat_tokens
    FROM concise_features JOIN lab USING (index)),
  o AS (SELECT category_1, row_number() OVER (ORDER BY count(*) DESC, category_1) - 1 AS number
    FROM r GROUP BY category_1)
SELECT index, number::DOUBLE AS category_number, clarity::DOUBLE AS clarity_index,
  repeat_tokens::DOUBLE AS repeat_tokens FROM r JOIN o USING (category_1)""",
)
def _(spark, sf_dir):
    """Categories numbered by frequency; features of at most four values become categories."""
    rows = features.concise_features(products(spark, sf_dir)).join(labels(spark, sf_dir), "index")
    rows = VectorAssembler(inputCols=["clarity", "repeat_tokens"], outputCol="raw").transform(rows)
    rows = rows.select("index", "category_1", "raw")
    number = StringIndexer(inputCol="category_1", outputCol="category_number")
    index = VectorIndexer(inputCol="raw", outputCol="indexed", maxCategories=4)
    out = training.pipeline(number, index).fit(rows).transform(rows)
    out = out.withColumn("v", vector_to_array("indexed"))
    return out.select(
        "index",
        "category_number",
        F.col("v")[0].alias("clarity_index"),
        F.col("v")[1].alias("repeat_tokens"),
    )


_PCA_COLUMNS = [c for c in CLARITY_FEATURES if "topic" not in c and not c.endswith("_dup")]


@query("ml_pca")
def _(spark, sf_dir):
    rows = written(clarity_frame(spark, sf_dir), "clarity_frame")
    rows = VectorAssembler(inputCols=_PCA_COLUMNS, outputCol="features").transform(rows)
    out = PCA(k=10, inputCol="features", outputCol="pca").fit(rows).transform(rows)
    out = out.withColumn("v", vector_to_array("pca"))
    return out.select("index", *[F.round(F.col("v")[i], 6).alias(f"pc{i + 1}") for i in range(10)])


def _sentences(spark, sf_dir) -> DataFrame:
    both = F.concat(text.useful_words(F.col("title")), text.useful_words(text.text("description")))
    return products(spark, sf_dir).select("index", both.alias("tokens"))


@query("ml_word2vec")
def _(spark, sf_dir):
    trained = vectors.train(written(_sentences(spark, sf_dir), "sentences"), "tokens")
    return trained.words().select(
        F.col("term").alias("token"), F.size("vec").alias("dim"), F.round(vectors.norm(F.col("vec")), 6).alias("norm")
    )


@query("ml_word2vec_similarity")
def _(spark, sf_dir):
    """Word-pair mean similarity under vectors trained on the same texts."""
    trained = vectors.train(written(_sentences(spark, sf_dir), "sentences"), "tokens")
    stored = written(trained.words().select(F.col("term").alias("vec_id"), "vec"), "trained_vectors")
    table = similarity.WordVectors(stored, F.col("token"), stored.count(), trained.dim)
    pairs = similarity.side_words(
        products(spark, sf_dir, False),
        text.useful_words(F.col("title")),
        text.useful_words(text.text("description")),
    )
    return similarity.pair_mean(pairs, table).select(
        "index", F.round("w2v_score", 6).alias("w2v_score")
    )


@query("ml_doc_vectors")
def _(spark, sf_dir):
    """A vector per title, fitted against the context vectors of words seen at least five times; null
    for titles without such a word."""
    rows = products(spark, sf_dir).select("index", text.useful_words(F.col("title")).alias("tokens"))
    rows = written(rows, "titles")
    trained = vectors.train(rows, "tokens", dim=300, window=10, min_count=5, passes=10)
    fitted = vectors.document_vectors(rows, "index", "tokens", trained)
    norms = fitted.select("index", F.round(vectors.norm(F.col("vec")), 6).alias("norm"))
    return rows.select("index").join(norms, "index", "left")


def _topic_titles(spark, sf_dir) -> DataFrame:
    tokens = text.without(
        stems(text.useful_words(F.col("title")), snowball), words.TOPIC_STOP_WORDS
    )
    rows = products(spark, sf_dir).select(
        "index", features.in_segment_a().alias("seg_a"), tokens.alias("tokens")
    )
    return written(rows, "topic_titles")


def _segment_topics(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seg_a, topic, rank, term, weight): topics of both segments, learnt in the same rounds; and the titles' shares."""
    terms = topics.dictionary(rows, "tokens")
    rows = rows.withColumnRenamed("seg_a", "model")
    words = written(topics.bags(rows, "tokens", terms, "index", "model"), "bags")
    learnt = topics.learn(words, "index", terms.count())
    shares = learnt.shares(words, "index").withColumnRenamed("model", "seg_a")
    return learnt.strongest(terms, 30).withColumnRenamed("model", "seg_a"), shares


@query("ml_lda_topics")
def _(spark, sf_dir):
    out, _ = _segment_topics(_topic_titles(spark, sf_dir))
    return out.select("seg_a", "topic", "rank", "term", F.round("weight", 9).alias("weight"))


@query("ml_lda_shares")
def _(spark, sf_dir):
    """Topic shares of each title with words, under the topics of its own segment."""
    _, shares = _segment_topics(_topic_titles(spark, sf_dir))
    return shares.select("index", "seg_a", *[F.round(F.col("shares")[i], 6).alias(f"topic_{i}") for i in range(5)])


@query("ml_lda_overlap")
def _(spark, sf_dir):
    """Titles against the topics learnt on their own segment."""
    rows = _topic_titles(spark, sf_dir)
    learnt = written(_segment_topics(rows)[0], "topics")  # segments x topics x 30 rows
    parts = [
        lexicon.topic_overlap(
            rows.where(F.col("seg_a") == s), "tokens", lexicon.topic_lists(learnt.where(F.col("seg_a") == s))
        )
        for s in (True, False)
    ]
    return parts[0].unionByName(parts[1]).select("index", "seg_a", "max_words_topic", "topic_num")


def _fitted_tagger(spark, sf_dir):
    """Titles as tokens, stored, and the tagger fitted to them."""
    rows = written(tagger.tokens_of(products(spark, sf_dir), "title", "index"), "tokens")
    return rows, *tagger.fit(rows)


def _times(column: str, values: list[str]):
    """How many elements of an array are among the values."""
    return F.size(F.filter(column, lambda x: x.isin(values)))


@query("ml_hmm_tagger")
def _(spark, sf_dir):
    """Objective of the tagger before each round of its fit and at the end."""
    _, _, objective = _fitted_tagger(spark, sf_dir)
    return spark.createDataFrame(list(enumerate(objective)), "round int, objective double")


@query("feat_hmm_tags")
def _(spark, sf_dir):
    """Counts and shares of the tags that the fitted tagger gives to each title."""
    rows, model, _ = _fitted_tagger(spark, sf_dir)
    kinds = {"num": ["NUM"], "adj": ["ADJ"], "noun": ["NOUN"], "conj": ["SYM", "CCONJ"]}
    out = tagger.tagged(rows, model, "index")
    for kind, names in kinds.items():
        out = out.withColumn(f"count_{kind}", _times("tags", names))
        share = F.coalesce(F.try_divide(F.col(f"count_{kind}"), F.size("tags")), F.lit(0.0))
        out = out.withColumn(f"freq_{kind}", F.round(share, 9))
    return out.drop("tags")


@query("ml_gmm_two_class")
def _(spark, sf_dir):
    """Two clusters of the rest segment; the larger one in training counts as clear."""
    columns = [c for c in CLARITY_FEATURES if c != "w2v_score"]
    rows = labelled_clarity(spark, sf_dir).where(~F.col("seg_a"))
    rows = training.assembled(rows, columns, "clarity").select("index", "label", "features")
    train, test = evaluate.split(rows, 0.8)
    model = GaussianMixture(k=2, seed=SEED, predictionCol="cluster").fit(train)
    sizes = {r["cluster"]: r["count"] for r in model.transform(train).groupBy("cluster").count().collect()}
    ones = 1 if sizes.get(1, 0) > sizes.get(0, 0) else 0
    return model.transform(test).select(
        "index", "label", (F.col("cluster") == ones).cast("double").alias("prediction")
    )


def _standard_features(spark, sf_dir) -> DataFrame:
    """(index, seg_a, x): the token features of every product on one scale, stored."""
    columns = [c for c in CONCISE_FEATURES if c != "clarity"]
    rows = features.concise_features(products(spark, sf_dir)).select(
        "index", features.in_segment_a().alias("seg_a"), *columns
    )
    scaled = profile.zscore(written(rows, "concise_features"), columns)
    cells = [F.coalesce(F.col(c), F.lit(0.0)) for c in columns]
    return written(scaled.select("index", "seg_a", F.array(*cells).alias("x")), "standard_features")


def _flagged(rows: DataFrame, score) -> DataFrame:
    """Scores of a model per segment, and the rows beyond the 98 % quantile of their segment."""
    parts = [score(rows.where(F.col("seg_a") == segment)) for segment in (True, False)]
    scored = parts[0].unionByName(parts[1]).select("index", "seg_a", F.round("score", 9).alias("score"))
    scored = written(scored, "outlier_scores")
    cut = evaluate.quantile(scored, "score", "seg_a", 0.98)  # one row per segment
    marked = scored.join(F.broadcast(cut), "seg_a")
    return marked.select("index", "seg_a", "score", (F.col("score") > F.col("cut")).alias("outlier"))


@query("ml_isolation_forest")
def _(spark, sf_dir):
    """Products that an isolation forest of their segment sets apart."""

    def score(rows):
        return outliers.isolation_scores(rows, "x", outliers.forest(rows, "index", "x"), "index", "seg_a")

    return _flagged(_standard_features(spark, sf_dir), score)


@query("ml_local_outliers")
def _(spark, sf_dir):
    """Products whose neighbourhood in their segment is thinner than that of their neighbours."""

    def score(rows):
        return outliers.outlier_factors(rows, "x", outliers.density(rows, "index", "x"), "index", "seg_a")

    return _flagged(_standard_features(spark, sf_dir), score)


# ---- classifiers --------------------------------------------------------------------------------


@query("ml_logreg")
def _(spark, sf_dir):
    train, test = evaluate.split(training.with_fold(concise_frame(spark, sf_dir)), 0.8)
    lr = LogisticRegression(maxIter=10)
    grid = (
        ParamGridBuilder()
        .addGrid(lr.regParam, [0.1, 0.01])
        .addGrid(lr.fitIntercept, [False, True])
        .build()
    )
    return training.predictions(
        training.fit_and_score(training.cross_validated(lr, grid), train, test)
    )


@query("ml_dtree")
def _(spark, sf_dir):
    train, test = evaluate.split(training.with_fold(concise_frame(spark, sf_dir)), 0.8)
    tree = DecisionTreeClassifier(seed=SEED)
    grid = ParamGridBuilder().addGrid(tree.maxDepth, [2, 3, 5]).build()
    return training.predictions(
        training.fit_and_score(training.cross_validated(tree, grid), train, test)
    )


@query("ml_shared_errors")
def _(spark, sf_dir):
    """Wordy rows that a linear model and a tree both take for concise."""
    rows = concise_frame(spark, sf_dir)
    train, _ = evaluate.split(rows)
    wrong = []
    for model in (LogisticRegression(maxIter=10), DecisionTreeClassifier(seed=SEED)):
        scored = training.fit_and_score(model, train, rows)
        wrong.append(scored.filter("label == 0").filter("prediction == 1").select("index"))
    return wrong[0].join(wrong[1], "index", "inner")


@query("ml_gbt_total")
def _(spark, sf_dir):
    train, test = evaluate.split(training.with_fold(concise_frame(spark, sf_dir)))
    gbt, grid = training.final_gbt()
    return training.predictions(
        training.fit_and_score(training.cross_validated(gbt, grid), train, test)
    )


@query("ml_gbt_per_category")
def _(spark, sf_dir):
    return training.per_category(concise_frame(spark, sf_dir), CATEGORIES)


def _metrics(scored: DataFrame, *by: str) -> DataFrame:
    """Area under the ROC curve and counts of labels and predictions, per group if one is given."""
    rows = written(scored.where("prediction IS NOT NULL"), "predictions")
    y, p = F.col("label"), F.col("prediction")
    table = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.count_if((y == a) & (p == b)).alias(c) for c, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))],
    )
    areas = evaluate.auc(rows, score="p1", by=by)
    joined = table.join(areas, list(by), "left") if by else table.crossJoin(areas)  # one row each
    return joined.withColumn("auc", F.round("auc", 9))


@query("ml_gbt_total_metrics")
def _(spark, sf_dir):
    """How the tuned trees over all categories do on their test rows."""
    return _metrics(QUERIES["ml_gbt_total"](spark, sf_dir))


@query("ml_gbt_per_category_metrics")
def _(spark, sf_dir):
    """How the tuned trees of each category do on their test rows."""
    return _metrics(QUERIES["ml_gbt_per_category"](spark, sf_dir), "category_1")


#: Penalties and intercepts tried for each category's logistic regression.
_POINTS = [grouped.Point(penalty, intercept) for penalty in (0.1, 0.01) for intercept in (False, True)]


@query("ml_logreg_per_category")
def _(spark, sf_dir):
    """One tuned logistic regression per category, all of them fitted in the same scans."""
    rows = training.with_fold(concise_frame(spark, sf_dir))
    rows = rows.select("index", F.col("category_1").alias("group"), "fold", "label", vector_to_array("features").alias("x"))
    train, test = evaluate.split(training.stored(rows, "grouped_frame"))
    out = grouped.tuned(train, test, _POINTS, len(CONCISE_FEATURES), "index").withColumnRenamed("group", "category_1")
    return out.withColumn("p1", F.round("p1", 9))


@query("ml_logreg_per_category_metrics")
def _(spark, sf_dir):
    """How the logistic regression of each category does on its test rows."""
    return _metrics(QUERIES["ml_logreg_per_category"](spark, sf_dir), "category_1")


def _indexed(rows: DataFrame) -> list:
    """Stages that number the labels and find categorical features."""
    return [
        StringIndexer(inputCol="label", outputCol="indexedLabel").fit(rows),
        VectorIndexer(inputCol="features", outputCol="indexedFeatures", maxCategories=4).fit(rows),
    ]


@query("ml_gbt_indexed")
def _(spark, sf_dir):
    """Label and category indexers with boosted trees, one fit."""
    rows = concise_frame(spark, sf_dir)
    train, test = evaluate.split(rows)
    gbt = GBTClassifier(
        labelCol="indexedLabel", featuresCol="indexedFeatures", maxIter=10, seed=SEED
    )
    chain = training.pipeline(*_indexed(rows), gbt)
    return training.fit_and_score(chain, train, test).select(
        "index", "indexedLabel", "prediction",
        F.round(vector_to_array("probability")[1], 9).alias("p1"),
    )


@query("ml_gbt_grid")
def _(spark, sf_dir):
    """Boosted trees tuned over the larger grid by the area under the ROC curve."""
    train, test = evaluate.split(training.with_fold(concise_frame(spark, sf_dir)))
    gbt = GBTClassifier(maxIter=10, seed=SEED)
    grid = (
        ParamGridBuilder()
        .addGrid(gbt.maxBins, [32, 64, 16])
        .addGrid(gbt.maxDepth, [3, 5, 7])
        .addGrid(gbt.minInfoGain, [0.0, 2.0, 5.0])
        .build()
    )
    return training.predictions(
        training.fit_and_score(training.cross_validated(gbt, grid), train, test)
    )


@query("ml_linear_svc")
def _(spark, sf_dir):
    train, test = evaluate.split(concise_frame(spark, sf_dir))
    svc = LinearSVC(maxIter=10)
    grid = ParamGridBuilder().addGrid(svc.regParam, [0.1, 0.01]).build()
    accuracy = MulticlassClassificationEvaluator(metricName="accuracy")
    search = training.train_validation(svc, grid, 0.8, accuracy)
    return training.fit_and_score(search, train, test).select(
        "index", "label", "prediction",
        F.round(vector_to_array("rawPrediction")[1], 9).alias("margin"),
    )


@query("ml_tvs")
def _(spark, sf_dir):
    """Early features, logistic regression tuned on one train/validation split."""
    rows = features.concise_features(products(spark, sf_dir)).join(labels(spark, sf_dir), "index")
    rows = training.stored(rows.select("index", "concise", *EARLY_FEATURES), "early_frame")
    rows = training.assembled(rows, EARLY_FEATURES, "concise").select("index", "features", "label")
    lr = LogisticRegression(maxIter=10)
    grid = (
        ParamGridBuilder()
        .addGrid(lr.regParam, [0.1, 0.01])
        .addGrid(lr.fitIntercept, [False, True])
        .build()
    )
    return training.predictions(
        training.train_validation(lr, grid, 0.7).fit(rows).transform(rows)
    )


@query("ml_pca_logreg")
def _(spark, sf_dir):
    """Logistic regression on ten principal components of the clarity features."""
    rows = labelled_clarity(spark, sf_dir)
    rows = training.assembled(rows, _PCA_COLUMNS, "clarity").select("index", "features", "label")
    train, test = evaluate.split(rows, 0.8)
    lr = LogisticRegression(maxIter=30, featuresCol="pcaFeatures")
    grid = (
        ParamGridBuilder()
        .addGrid(lr.regParam, [0.1, 0.01])
        .addGrid(lr.fitIntercept, [False, True])
        .build()
    )
    pca = PCA(k=10, inputCol="features", outputCol="pcaFeatures").fit(rows)
    search = training.train_validation(lr, grid, 0.8)
    return training.predictions(search.fit(pca.transform(train)).transform(pca.transform(test)))


@query("ml_boosted_segments")
def _(spark, sf_dir):
    """Boosted trees per segment on the clarity features, with the threshold sweep of the scores."""
    columns = [c for c in CLARITY_FEATURES if c != "w2v_score"]
    rows = labelled_clarity(spark, sf_dir)
    rows = training.assembled(rows, columns, "clarity").select("index", "seg_a", "features", "label")
    train, test = evaluate.split(rows, 0.8)
    gbt = GBTClassifier(maxDepth=7, stepSize=0.5, maxIter=100, seed=SEED)
    return evaluate.threshold_sweep(_by_segment(gbt, train, test), ["seg_a"], score="p1")


@query("ml_second_order_segments")
def _(spark, sf_dir):
    """Second-order boosted trees per segment on the clarity features, with the threshold sweep of the scores."""
    columns = [c for c in CLARITY_FEATURES if c != "w2v_score"]
    rows = labelled_clarity(spark, sf_dir).select(
        "index", F.col("seg_a").alias("group"), F.col("clarity").cast("double").alias("label"), F.array(*columns).alias("x")
    )
    train, test = evaluate.split(training.stored(rows, "segment_frame"), 0.8)
    model = boosting.fit(train, len(columns))
    scored = written(boosting.scored(test, model, "index", "group", "label"), "predictions")
    return evaluate.threshold_sweep(scored.where("p1 IS NOT NULL").withColumnRenamed("group", "seg_a"), ["seg_a"], score="p1")


def _by_segment(estimator, train: DataFrame, test: DataFrame) -> DataFrame:
    """Scored test rows of one model per segment; the two fits are submitted together."""

    def one(segment: bool) -> DataFrame:
        here = F.col("seg_a") == segment
        return training.predictions(
            estimator.fit(train.where(here)).transform(test.where(here)), "seg_a"
        )

    with ThreadPoolExecutor(2) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, (True, False)))


@query("ml_logreg_segments")
def _(spark, sf_dir):
    """Logistic regression per segment on the clarity features, with the threshold sweep."""
    columns = [c for c in CLARITY_FEATURES if c != "w2v_score"]
    rows = training.assembled(labelled_clarity(spark, sf_dir), columns, "clarity")
    train, test = evaluate.split(rows.select("index", "seg_a", "features", "label"), 0.8)
    scored = _by_segment(LogisticRegression(), train, test)
    return evaluate.threshold_sweep(scored, ["seg_a"], score="p1")


@query("ml_random_forest")
def _(spark, sf_dir):
    """Segment of a product from its title vector, ten contiguous folds; every row is tested."""
    return over_folds(folded(_title_vectors(spark, sf_dir), 10), _forest(), probability=True)


@query("ml_random_forest_kfold")
def _(spark, sf_dir):
    """Fold metrics of the forest."""
    return _fold_metrics(over_folds(folded(_title_vectors(spark, sf_dir), 10), _forest()))


@query("ml_mlp")
def _(spark, sf_dir):
    """Segment of a product from its title vector, by a network with one hidden layer, ten contiguous
    folds; every row is tested."""
    return over_folds(folded(_title_vectors(spark, sf_dir), 10), _net(spark, sf_dir), probability=True)


@query("ml_mlp_kfold")
def _(spark, sf_dir):
    """Fold metrics of the network."""
    return _fold_metrics(over_folds(folded(_title_vectors(spark, sf_dir), 10), _net(spark, sf_dir)))


def _segment_a_network(spark, sf_dir) -> DataFrame:
    """Held-out rows of the clarity networks of the fashion and watches segment, ten contiguous folds."""
    columns = [c for c in CLARITY_FEATURES if c not in COUNT_COLUMNS + SCORE_COLUMNS]
    rows = labelled_clarity(spark, sf_dir).where("seg_a")
    rows = rows.select("index", F.col("clarity").cast("double").alias("label"), F.array(*columns).alias("x"))
    rows = training.stored(evaluate.with_folds(rows, 10, "index"), "segment_folds")
    fitted = network.fit(rows, len(columns), network.Settings(linear=True))
    return network.held_out(rows, fitted, "index")


@query("ml_clarity_network")
def _(spark, sf_dir):
    """Clarity of segment A by a network with a linear hidden layer; every row is tested."""
    return _segment_a_network(spark, sf_dir).withColumn("p1", F.round("p1", 9))


@query("ml_clarity_network_kfold")
def _(spark, sf_dir):
    """Fold metrics of the clarity network."""
    return _fold_metrics(_segment_a_network(spark, sf_dir))


def _forest() -> RandomForestClassifier:
    return RandomForestClassifier(featureSubsetStrategy="50", seed=SEED)


def _net(spark, sf_dir) -> MultilayerPerceptronClassifier:
    width = word_vectors(spark, sf_dir).dim
    return MultilayerPerceptronClassifier(layers=[width, (width + 2) // 2, 2], maxIter=50, seed=SEED)


def _title_vectors(spark, sf_dir) -> DataFrame:
    """(index, features, label): title vectors and the segment as the label, stored."""
    titles = products(spark, sf_dir, False).select("index", "title")
    sums = similarity.text_vector(
        titles, text.useful_words(F.col("title")), word_vectors(spark, sf_dir)
    )
    seg = products(spark, sf_dir, False).select(
        "index", features.in_segment_a().cast("double").alias("label")
    )
    rows = training.stored(sums.join(seg, "index").select("index", "vec", "label"), "title_vectors")
    return rows.select("index", array_to_vector("vec").alias("features"), "label")


def folded(rows: DataFrame, k: int) -> DataFrame:
    """Rows with contiguous folds, stored because every fit reads them again."""
    rows = evaluate.with_folds(rows.select("index", "features", "label"), k, "index")
    return training.stored(rows, "folds")


def over_folds(
    rows: DataFrame, estimator, workers: int = 3, prepare=lambda train: train, probability: bool = False
) -> DataFrame:
    """Scored rows of a k-fold run; ``rows`` carries ``fold``. Fits are submitted by few threads.

    ``prepare`` changes the training rows. A fold whose training rows have one class only predicts
    that class. ``probability`` adds that of class 1.
    """
    classes = rows.groupBy("fold").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    ends = {r["fold"]: (r["low"], r["high"]) for r in classes.collect()}  # k rows

    def one(f: int) -> DataFrame:
        test = rows.where(F.col("fold") == f)
        seen = [e for g, e in ends.items() if g != f]
        low, high = min(a for a, _ in seen), max(b for _, b in seen)
        if low == high:
            scored, p1 = test.withColumn("prediction", F.lit(low)), F.lit(low)
        else:
            scored = estimator.fit(prepare(rows.where(F.col("fold") != f))).transform(test)
            p1 = F.round(vector_to_array("probability")[1], 9) if probability else None
        more = [p1.alias("p1")] if probability else []
        return scored.select("index", "fold", "label", "prediction", *more)

    with ThreadPoolExecutor(workers) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, sorted(ends)))


def _fold_metrics(scored: DataFrame) -> DataFrame:
    y, p = F.col("label"), F.col("prediction")
    return scored.groupBy("fold").agg(
        F.count("*").alias("n"),
        F.round(evaluate.accuracy(), 9).alias("accuracy"),
        F.round(evaluate.rmse("label", "prediction"), 9).alias("rmse"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


@query("ml_logreg_kfold")
def _(spark, sf_dir):
    """Clarity of fashion titles from the five best word similarities, ten contiguous folds."""
    df = products(spark, sf_dir, False).where(F.col("category_1") == "Fashion")
    pairs = similarity.side_words(
        df, text.fold_tokens(F.col("title")), text.fold_tokens(text.text("description"))
    )
    profile = similarity.top5_profile(written(pairs, "side_words"), word_vectors(spark, sf_dir))
    columns = [f"s{i}" for i in range(1, 6)]
    rows = written(profile.join(labels(spark, sf_dir), "index").select("index", "clarity", *columns), "profile")
    rows = folded(training.assembled(rows, columns, "clarity"), 10)
    return _fold_metrics(over_folds(rows, LogisticRegression()))


@query("ml_svc_kfold")
def _(spark, sf_dir):
    """Clarity from title vectors by a support vector machine, five contiguous folds."""
    titles = products(spark, sf_dir, False).select("index", "title")
    sums = similarity.text_vector(titles, text.title_words(F.col("title")), word_vectors(spark, sf_dir))
    rows = written(sums.join(labels(spark, sf_dir), "index").select("index", "vec", "clarity"), "title_vectors")
    rows = rows.select(
        "index", array_to_vector("vec").alias("features"), F.col("clarity").cast("double").alias("label")
    )
    return _fold_metrics(over_folds(folded(rows, 5), LinearSVC()))


@query("ml_svc_oversampled")
def _(spark, sf_dir):
    """Clarity of the rest segment by a support vector machine, unclear rows ten times in training."""
    columns = [c for c in CLARITY_FEATURES if c not in COUNT_COLUMNS + SCORE_COLUMNS]
    rows = labelled_clarity(spark, sf_dir).where(~F.col("seg_a"))
    rows = training.assembled(rows, columns, "clarity").select("index", "features", "label")
    svc = LinearSVC()
    scored = over_folds(folded(rows, 10), svc, prepare=lambda train: evaluate.oversample(train, "label"))
    return _fold_metrics(scored)
