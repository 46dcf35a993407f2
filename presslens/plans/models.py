"""Classifier, topic-model and experiment jobs on MLlib (M1, M4-M7, M12,
M14, M15).

Features are built by Spark ML stages (tokeniser, CountVectorizer, IDF);
the reference's smoothed idf ln((1+n)/(1+df))+1 is Spark's idf plus one,
applied as an element-wise product with the fitted idf vector (its length
is the vocabulary size, a parameter).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes,
                                       RandomForestClassifier)
from pyspark.ml.feature import (CountVectorizerModel, ElementwiseProduct, HashingTF, IndexToString, Normalizer,
                                RegexTokenizer, StringIndexer)
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import online_lda, sparse_forest
from .features import TFIDF_TOKEN, classification_report, split_flag, tfidf_tokens

MODELS = ("logistic_regression", "naive_bayes", "random_forest")


def _word_counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, times, rows that have it) of a batch of token lists; its rows as those of a null word."""
    for part in parts:
        tokens = part.column(0)
        found = tokens.flatten().dictionary_encode()
        n, code = len(found.dictionary), np.asarray(found.indices, np.int64)
        row = np.repeat(np.arange(len(tokens)), np.asarray(tokens.value_lengths().fill_null(0)))
        in_row = np.sort(row * n + code)
        in_row = in_row[np.flatnonzero(np.r_[True, in_row[1:] != in_row[:-1]])] if len(in_row) else in_row
        yield pa.RecordBatch.from_arrays([
            pa.concat_arrays([found.dictionary.cast(pa.string()), pa.nulls(1, pa.string())]),
            pa.array(np.r_[np.bincount(code, minlength=n), len(tokens)].astype(np.int64)),
            pa.array(np.r_[np.bincount(in_row % max(n, 1), minlength=n), len(tokens)].astype(np.int64))],
            names=["word", "times", "df"])


def tfidf_features(df: DataFrame, text: str, max_features: int, out: str = "features") -> tuple[DataFrame, PipelineModel]:
    """M1 with ML stages: raw counts x (idf + 1), L2 rows. The ``max_features``
    words are those of the relational form, ties at the cut by word (the
    estimator of Spark leaves them to chance). One pass over the text gives the
    words, the rows that have them and the number of rows, as Spark's IDF counts them."""
    tok = RegexTokenizer(inputCol=text, outputCol="_tok", pattern=TFIDF_TOKEN, gaps=False, toLowercase=True)
    found = df.select(tfidf_tokens(text)).mapInArrow(_word_counts, "word string, times bigint, df bigint") \
        .groupBy("word").agg(F.sum("times").alias("times"), F.sum("df").alias("df")) \
        .orderBy(F.col("word").isNotNull(), F.desc("times"), "word").limit(max_features + 1).collect()
    if len(found) < 2:
        raise ValueError("no word to learn from")
    n, words = found[0]["df"], found[1:]
    cv = CountVectorizerModel.from_vocabulary([r["word"] for r in words], inputCol="_tok", outputCol="_tf")
    idf = [math.log((n + 1) / (r["df"] + 1)) + 1.0 for r in words]
    scale = ElementwiseProduct(scalingVec=DenseVector(idf), inputCol="_tf", outputCol="_w")
    norm = Normalizer(inputCol="_w", outputCol=out, p=2.0)
    model = PipelineModel(stages=[tok, cv, scale, norm])
    return model.transform(df).drop("_tok", "_tf", "_w"), model


#: Partitions of the rows that a logistic regression learns from, by core: each step adds up a gradient a partition.
GRADIENTS = 4


#: Random forest: as many trees as the reference's default, and MLlib's depth limit, as that has none.
TREES, DEPTH = 100, 30


def classifier(name: str, label: str = "label_idx", features: str = "features", seed: int = 42,
               trees: int = TREES, depth: int = DEPTH):
    if name == "logistic_regression":
        return LogisticRegression(featuresCol=features, labelCol=label, family="multinomial", maxIter=100)
    if name == "naive_bayes":
        return NaiveBayes(featuresCol=features, labelCol=label, modelType="multinomial")
    if name == "random_forest":
        return RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=trees, maxDepth=depth,
                                      maxMemoryInMB=512, seed=seed)
    raise ValueError(name)


def run_experiment(df: DataFrame, key: str, text: str, target: str, max_features: int, experiment: str,
                   models: Sequence[str] = MODELS, fit_on: str = "train", seed: int = 50,
                   options: dict[str, dict] | None = None) -> DataFrame:
    """M7: vectorise, split 80/20 by id hash, fit each model, predict the
    test part and report (M8). Returns the reports with experiment/model
    columns. ``fit_on='all'`` fits the vectoriser on all rows as the
    reference did; the default fits it on the training rows only."""
    options = options or {}
    base = df.filter(F.col(text).isNotNull() & F.col(target).isNotNull()).select(key, text, target) \
        .withColumn("_test", split_flag(key, seed))
    fit_rows = base if fit_on == "all" else base.filter(~F.col("_test"))
    _, vec = tfidf_features(fit_rows, text, max_features)
    feats = vec.transform(base)
    # labels are learnt from the training part alone; a test label that is not among them counts as a wrong row
    feats = materialize(feats.select(key, target, "features", "_test"))  # read by every model
    test = feats.filter(F.col("_test"))
    train = feats.filter(~F.col("_test"))
    indexer = StringIndexer(inputCol=target, outputCol="label_idx", handleInvalid="error").fit(train)
    train = indexer.transform(train)
    labels = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=indexer.labels)
    cores = df.sparkSession.sparkContext.defaultParallelism
    reports = []
    for name in models:
        if name == "random_forest":
            scored = sparse_forest.predict(
                train.select(target, "features", "label_idx").unionByName(
                    test.select(target, "features", F.lit(None).cast("double").alias("label_idx"))),
                "label_idx", "features", len(vec.stages[1].vocabulary), len(indexer.labels),
                **{"trees": TREES, "depth": DEPTH, **options.get(name, {})})
        else:
            rows = train.coalesce(GRADIENTS * cores) if name == "logistic_regression" else train
            scored = classifier(name, **options.get(name, {})).fit(rows).transform(test)
        pred = labels.transform(scored).select(F.col(target).alias("label"), F.col("predicted_label").alias("prediction"))
        reports.append(classification_report(pred).select(F.lit(experiment).alias("experiment"),
                                                          F.lit(name).alias("model"), "*"))
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


def model_comparison(reports: DataFrame) -> DataFrame:
    """Accuracy, macro f1 and weighted f1 by experiment and model."""
    return reports.groupBy("experiment", "model").agg(
        F.max(F.when(F.col("class") == "accuracy", F.col("f1_score"))).alias("accuracy"),
        F.max(F.when(F.col("class") == "macro avg", F.col("f1_score"))).alias("macro_f1"),
        F.max(F.when(F.col("class") == "weighted avg", F.col("f1_score"))).alias("weighted_f1"),
    )


def topic_model(docs: DataFrame, key: str, tokens: str, vocab: DataFrame, k: int = 50, passes: int = 2,
                top_terms: int = 50, seed: int = 42) -> DataFrame:
    """Online LDA over bags of words, every document read once a pass;
    the top terms of each topic as (topic, rank, token, weight).

    The vocabulary (M10) and the topics are model state bounded by M10's
    ``keep_n``, so they are read to the driver; documents stay distributed.
    """
    spark = docs.sparkSession
    words = [r["token"] for r in vocab.orderBy("token_id").select("token").collect()]
    rows = []
    if words:
        weights = online_lda.fit(online_lda.deal(docs, key, tokens, words, seed=seed), len(words), k, passes,
                                 seed=seed).weights
        weights = weights / weights.sum(0)
        for topic in range(k):
            best = np.argsort(-weights[:, topic], kind="stable")[:top_terms]
            rows += [(topic, rank, words[w], float(weights[w, topic])) for rank, w in enumerate(best.tolist())]
    return spark.createDataFrame(rows, "topic int, rank int, token string, weight double")


def feed_forward(df: DataFrame, key: str, text: str, target: str, num_features: int = 256,
                 hidden: Sequence[int] = (32,), seed: int = 42, max_iter: int = 50) -> DataFrame:
    """Hashed term features + multilayer perceptron, reported with
    M8 on the 20 % test split."""
    # staged: read by the indexer, in every step of the training and by the report
    base = materialize(df.filter(F.col(text).isNotNull() & F.col(target).isNotNull()).select(key, text, target)
                       .withColumn("_test", split_flag(key, seed)))
    train = base.filter(~F.col("_test"))
    indexer = StringIndexer(inputCol=target, outputCol="label_idx", handleInvalid="error").fit(train)
    tok = RegexTokenizer(inputCol=text, outputCol="_tok", pattern=TFIDF_TOKEN, gaps=False)
    tf = HashingTF(inputCol="_tok", outputCol="features", numFeatures=num_features)
    mlp = MultilayerPerceptronClassifier(layers=[num_features, *hidden, len(indexer.labels)], labelCol="label_idx",
                                         seed=seed, maxIter=max_iter)
    model = Pipeline(stages=[tok, tf, mlp]).fit(indexer.transform(train))
    back = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=indexer.labels)
    pred = back.transform(model.transform(base.filter(F.col("_test"))))  # every test row, known label or not
    return classification_report(pred.select(F.col(target).alias("label"), F.col("predicted_label").alias("prediction")))
