"""Invariants of the rows-only model jobs."""

import random

import numpy as np
import pytest
from pyspark.ml.clustering import LDA
from pyspark.ml.linalg import SparseVector
from pyspark.sql import Window
from pyspark.sql import functions as F

from presslens import fixtures as fx
from presslens.plans import features as FE
from presslens.plans import models as MO
from presslens.plans import online_lda
from presslens.plans import tokens as TK


def test_lda_topic_terms_sorted(spark, sf_dir):
    a = fx.articles(spark, sf_dir)
    vocab = TK.vocabulary(a, "article")
    docs = a.filter(F.col("article").isNotNull()).select("article_id", TK.token_column("article").alias("tokens"))
    terms = MO.topic_model(docs, "article_id", "tokens", vocab, k=5, passes=1, top_terms=10)
    w = Window.partitionBy("topic").orderBy("rank")
    bad = terms.withColumn("prev", F.lag("weight").over(w)).filter(F.col("prev") < F.col("weight")).count()
    assert bad == 0
    per_topic = {r["topic"]: (r["n"], r["lo"], r["hi"]) for r in
                 terms.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("lo"),
                                            F.max("rank").alias("hi")).collect()}
    assert sorted(per_topic) == list(range(5))
    assert all(v == (10, 0, 9) for v in per_topic.values())
    known = {r["token"] for r in vocab.collect()}
    assert all(r["token"] in known and 0 < r["weight"] <= 1 for r in terms.collect())


def _planted(n, rng, topics=4, words=40, size=30):
    """Documents of one or two of the planted topics; topic t favours words t * 10 .. t * 10 + 9."""
    docs = []
    for i in range(n):
        mine = rng.sample(range(topics), 1 + i % 2)
        docs.append([rng.randrange(words) if rng.random() < 0.1 else rng.choice(mine) * 10 + rng.randrange(10)
                     for _ in range(size)])
    return docs


def _held_out(docs, weights):
    """Mean log likelihood of each document's second half, its topics fitted to the first."""
    beta = weights / weights.sum(0)
    total = n = 0
    for ids in docs:
        theta = np.full(beta.shape[1], 1 / beta.shape[1])
        for _ in range(50):
            share = theta * beta[ids[::2]] + 1e-12
            theta = (share / share.sum(1, keepdims=True)).sum(0) + 0.1
            theta /= theta.sum()
        total += np.log(beta[ids[1::2]] @ theta).sum()
        n += len(ids[1::2])
    return total / n


def test_topic_model_reads_each_document_once_a_pass_and_fits_as_well_as_mllib(spark):
    rng = random.Random(11)
    train, test = _planted(600, rng), _planted(100, rng)
    rows = [(i, [f"w{w}" for w in ids] + ["unknown"]) for i, ids in enumerate(train)]
    rows += [(None, ["w1", "w2"]), (None, ["w3"]), (7, ["w4"]), (9000, []), (9001, None), (9002, ["unknown", None])]
    docs = spark.createDataFrame(rows, "id long, tokens array<string>").repartition(3)
    dealt = online_lda.deal(docs, "id", "tokens", [f"w{i}" for i in range(40)], batches=10)
    assert dealt.count() == 603 and dealt.select("batch").distinct().count() == 10
    got = online_lda.fit(dealt, 40, 4, 2, batches=10)
    assert got.read == [603, 603]
    vectors = spark.createDataFrame([(SparseVector(40, sorted({w: float(ids.count(w)) for w in ids}.items())),)
                                     for ids in train], ["features"])
    mllib = LDA(k=4, maxIter=20, subsamplingRate=0.1, optimizer="online", seed=42).fit(vectors)
    assert _held_out(test, got.weights) >= _held_out(test, mllib.topicsMatrix().toArray()) - 1e-9
    assert len({int(t) // 10 for t in got.weights.argmax(0)}) == 4  # every planted topic is found
    again = online_lda.fit(dealt, 40, 4, 2, batches=10)
    assert np.allclose(got.weights, again.weights, rtol=1e-6)


def test_expected_counts_match_a_plain_loop():
    rng = np.random.default_rng(3)
    topics = online_lda.expected_log(rng.gamma(100, 0.01, (12, 3)), 0)
    docs = [{0: 2.0, 5: 1.0}, {1: 1.0}, {0: 1.0, 2: 4.0, 11: 2.0}]
    doc, word, count = (np.array(c) for c in zip(*[(d, w, n) for d, ws in enumerate(docs) for w, n in ws.items()]))
    gamma, counts = online_lda.expect(doc, word, count, topics, 0.3)
    for d, ws in enumerate(docs):
        g = np.full(3, 0.3 + sum(ws.values()) / 3)
        for _ in range(online_lda.MOST_ROUNDS):
            theta = online_lda.expected_log(g[None], 1)[0]
            new = 0.3 + theta * sum(n * topics[w] / (theta @ topics[w]) for w, n in ws.items())
            still = np.abs(new - g).mean() < online_lda.TOLERANCE
            g = new
            if still:
                break
        assert np.allclose(gamma[d], g)
        assert np.allclose((counts * topics[word])[doc == d].sum(), sum(ws.values()))


def test_a_batch_lies_in_as_many_files_as_tasks_can_read(spark):
    """A step is worked on by every core, however small the batch's files and the number of shuffle partitions are."""
    docs = spark.range(4000).select("id", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(
        F.lit("w"), ((F.col("id") * 7 + i * i) % 40).cast("string"))).alias("tokens")).repartition(3)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    try:
        dealt = online_lda.deal(docs, "id", "tokens", [f"w{i}" for i in range(40)], batches=4)
        cores = spark.sparkContext.defaultParallelism
        for b in range(4):
            files = dealt.filter(F.col("batch") == b).groupBy(F.input_file_name()).count().collect()
            assert len(files) == cores and max(r["count"] for r in files) < 3 * 4000 / 4 / cores
        got = online_lda.fit(dealt, 40, 4, 1, batches=4)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert got.read == [4000] and dealt.count() == 4000


def test_sums_meet_by_block_of_cells():
    rng = np.random.default_rng(6)
    want, parts = np.zeros(3 * online_lda.CELLS), []
    for docs in (3, 0, 4):
        cell = np.sort(rng.choice(len(want), 500, replace=False))
        value = rng.random(500).astype(np.float32)
        want[cell] += value
        parts.append(online_lda._sums(cell, value, docs))
    parts.append(online_lda._sums(np.empty(0, np.int64), np.empty(0), 5))  # documents whose counts are next to nothing
    got, docs = np.zeros(len(want)), 0
    for part in online_lda._added(iter(parts)):
        docs += sum(part.column("docs").to_pylist())
        for cell, sums in online_lda._runs(part):
            got[cell] += sums
    assert docs == 12 and np.allclose(got, want, rtol=1e-6)
    assert list(online_lda._added(iter([]))) == []


def test_vocabulary_of_tokens_is_that_of_their_text(spark, sf_dir):
    a = fx.articles(spark, sf_dir)
    docs = a.filter(F.col("article").isNotNull()).select("article_id", TK.token_column("article").alias("tokens"))
    assert TK.token_vocabulary(docs, "tokens").collect() == TK.vocabulary(a, "article").collect()


def test_digamma():
    assert online_lda.digamma(np.array([1.0, 0.5, 10.0])) == pytest.approx(
        [-0.5772156649015329, -1.9635100260214235, 2.2517525890667211], abs=1e-9)


def test_topic_model_of_no_words(spark):
    docs = spark.createDataFrame([], "id long, tokens array<string>")
    vocab = spark.createDataFrame([], "token string, token_id long")
    assert MO.topic_model(docs, "id", "tokens", vocab, k=3).count() == 0
    one = spark.createDataFrame([("a", 0)], "token string, token_id long")
    assert MO.topic_model(docs, "id", "tokens", one, k=3).count() == 3  # topics of the prior alone


def test_experiment_report_shape(spark, sf_dir):
    from presslens.registry.q_models import model_input
    rep = MO.run_experiment(model_input(spark, sf_dir), "article_id", "title_clean", "simple_topic", 500,
                            "title_topic_tfidf_500", models=["naive_bayes"])
    rows = rep.collect()
    classes = [r for r in rows if r["class"] not in ("accuracy", "macro avg", "weighted avg")]
    assert {r["class"] for r in rows} >= {"accuracy", "macro avg", "weighted avg"}
    total = next(r["support"] for r in rows if r["class"] == "accuracy")
    assert sum(r["support"] for r in classes) == total
    assert all(0.0 <= (r["f1_score"] or 0.0) <= 1.0 for r in rows)


def test_reports_hold_no_class_that_does_not_exist(spark):
    """Labels of the training part alone can be predicted; unseen test labels count as wrong rows."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["red", "blue", "stone", "water"], k=6)), "ab"[i % 2]) for i in range(400)]
    test_ids = [i for i in range(400, 3000) if (i * 1103515245 + 12345 + 50) % 2 ** 31 % 100 < 20][:5]
    rows += [(i, "red water", "rare") for i in test_ids]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    rep = MO.run_experiment(df, "id", "text", "label", 100, "e", models=["logistic_regression", "naive_bayes"])
    for model in ("logistic_regression", "naive_bayes"):
        own = {r["class"]: r for r in rep.filter(F.col("model") == model).collect()}
        assert set(own) == {"a", "b", "rare", "accuracy", "macro avg", "weighted avg"}
        assert own["rare"]["support"] == 5 and own["rare"]["recall"] == 0.0
        assert own["accuracy"]["support"] == own["a"]["support"] + own["b"]["support"] + 5
    df42 = [i for i in range(400, 3000) if (i * 1103515245 + 12345 + 42) % 2 ** 31 % 100 < 20][:5]
    df = spark.createDataFrame(rows[:400] + [(i, "red water", "rare") for i in df42], "id long, text string, label string")
    own = {r["class"]: r for r in MO.feed_forward(df, "id", "text", "label", max_iter=5).collect()}
    assert own["rare"]["support"] == 5


def test_ml_and_relational_tfidf_agree(spark):
    rows = [(1, "aa bb aa cc"), (2, "bb dd"), (3, "cc cc bb aa"), (4, "zz")]
    df = spark.createDataFrame(rows, "id long, text string")
    want = {(r["id"], r["term"]): r["weight"] for r in FE.tfidf_relational(df, "id", "text", 100).collect()}
    feats, model = MO.tfidf_features(df, "text", 100)
    words = model.stages[1].vocabulary
    got = {(r["id"], words[i]): v for r in feats.select("id", "features").collect()
           for i, v in zip(r["features"].indices.tolist(), r["features"].values.tolist())}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_title_features_read_the_articles_once(spark, sf_dir):
    """The joined and cleaned input is a stage: what is read afterwards is not the tables."""
    from presslens.registry import q_models
    for name in ("m1_tfidf_ml_features", "m13_token_sequences"):
        got = getattr(q_models, name)(spark, sf_dir)
        assert got.inputFiles() and not any("documents.parquet" in f for f in got.inputFiles())


def test_words_and_their_rows_are_counted_in_one_pass(spark):
    """Words, their rows and the number of rows, rows without words included; weights are those of Spark's own IDF."""
    from pyspark.ml.feature import IDF, CountVectorizerModel, RegexTokenizer
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choice(["Aa", "bb", "cc", "dd", "\u00e9t\u00e9", "x", "\u0939\u093f\u0928"]) for _ in range(rng.randrange(9))))
            for i in range(300)] + [(300, ""), (301, "x")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    read = []
    kept = type(df).collect
    type(df).collect = lambda self: (read.append(self), kept(self))[1]
    try:
        feats, model = MO.tfidf_features(df, "text", 4)
    finally:
        type(df).collect = kept
    assert len(read) == 1 and set(read[0].columns) == {"word", "times", "df"}
    times = {}
    for _, text in rows:
        for w in text.lower().split():
            if len(w) > 1:
                times[w] = times.get(w, 0) + 1
    assert model.stages[1].vocabulary == sorted(times, key=lambda w: (-times[w], w.encode()))[:4]
    tok = RegexTokenizer(inputCol="text", outputCol="t", pattern=FE.TFIDF_TOKEN, gaps=False)
    cv = CountVectorizerModel.from_vocabulary(model.stages[1].vocabulary, inputCol="t", outputCol="v")
    spark_idf = IDF(inputCol="v", outputCol="i").fit(cv.transform(tok.transform(df))).idf.toArray() + 1
    assert np.allclose(model.stages[2].getScalingVec().toArray(), spark_idf, rtol=1e-14, atol=0)
    assert feats.count() == 302


def test_a_gradient_a_partition_are_few(spark, monkeypatch):
    """A logistic regression adds up as many gradients a step as there are cores, times a fixed number, not files."""
    seen = []
    fit = MO.LogisticRegression.fit
    monkeypatch.setattr(MO.LogisticRegression, "fit", lambda self, df, *a: (seen.append(df.rdd.getNumPartitions()), fit(self, df, *a))[1])
    monkeypatch.setattr(MO, "GRADIENTS", 1)
    rows = [(i, "red blue" if i % 2 else "green blue", "ab"[i % 2]) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, text string, label string").repartition(40)
    kept = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", 128 << 20)  # a partition a file
    try:
        got = MO.run_experiment(df, "id", "text", "label", 10, "e", models=["logistic_regression"])
        own = {r["class"]: r["f1_score"] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", kept)
    assert own["accuracy"] == 1.0 and seen == [spark.sparkContext.defaultParallelism]
