"""The embedding classifier over token sequences: gradients, data-parallel sums, whole passes, planted signal."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from presslens.plans import models as MO
from presslens.plans import sequence_model as SM


def _loss(network, row, token, label):
    pool, _ = SM.pooled(network, len(label), row, token)
    return -np.log(SM.probabilities(network, pool)[np.arange(len(label)), label]).sum()


def test_gradients_match_differences():
    network = SM.initial(7, 3, 4, seed=5)
    row, token = np.array([0, 0, 1, 1, 1, 3]), np.array([1, 2, 2, 2, 5, 6])  # row 2 has no token
    label = np.array([0, 2, 1, 1])
    loss, tokens, sums, dense, bias = SM.gradients(network, 4, row, token, label)
    assert loss == pytest.approx(_loss(network, row, token, label))
    embedding = np.zeros_like(network.embedding)
    embedding[tokens] = sums
    assert tokens.tolist() == [1, 2, 5, 6]
    for values, want in zip(network, (embedding, dense, bias)):
        for at in np.ndindex(values.shape):
            values[at] += 1e-6
            above = _loss(network, row, token, label)
            values[at] -= 2e-6
            below = _loss(network, row, token, label)
            values[at] += 1e-6
            assert (above - below) / 2e-6 == pytest.approx(want[at], abs=1e-6)


def _planted(n, seed):
    """One of 400 marker words, a hundred a class, among nine of 2000 words that say nothing."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        marker = rng.randrange(400)
        words = [f"m{marker}x"] + [f"w{rng.randrange(2000)}x" for _ in range(9)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), "abcd"[marker % 4]))
    return rows


def test_planted_markers_are_learned_better_than_by_hashed_terms(spark):
    df = spark.createDataFrame(_planted(8000, 1), "id long, text string, label string") \
        .withColumn("tokens", F.split("text", " "))
    def accuracy(report):
        return report.filter(F.col("class") == "accuracy").first()["f1_score"]
    own = accuracy(SM.sequence_classifier(df, "id", "tokens", "label"))
    hashed = accuracy(MO.feed_forward(df, "id", "text", "label"))
    assert own > 0.8 and own > hashed + 0.1


def test_every_row_is_read_once_a_pass_however_rows_are_spread(spark):
    rows = [(i, t.split(" "), c) for i, t, c in _planted(300, 2)]
    rows += [(None, ["m1x"], "a"), (None, ["m1x"], "a"), (7, ["m2x"], "c"), (301, [], "b"), (302, None, "a"),
             (303, ["m1x", None], None), (304, ["w1x", None, "w2x"], "d")]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, label string")
    is_test = SM.split_flag("id", 42)
    known = df.filter("tokens is not null and label is not null")
    fits = []
    for parts in (1, 5):
        dealt, labels = SM.deal(df.repartition(parts), "id", "tokens", "label", num_words=500, batches=3)
        fits.append(SM.fit(dealt, 500, len(labels), dim=4, passes=2, batches=3))
        n_test = dealt.filter(F.col("batch") == SM.TEST).count()
        assert n_test == known.filter(is_test).count()
        assert fits[-1].read == [dealt.count() - n_test] * 2
        assert fits[-1].loss[1] < fits[-1].loss[0]
    assert all(np.allclose(a, b, atol=1e-2) for a, b in zip(fits[0].network, fits[1].network))


def test_unknown_test_labels_count_and_no_training_row_is_an_error(spark):
    test = [i for i in range(1000) if (i * 1103515245 + 12345 + 42) % 2 ** 31 % 100 < 20][:5]
    rows = [(i, ["red" if i % 2 else "blue"], "ab"[i % 2]) for i in range(1000, 1200)]
    rows += [(i, ["red"], "rare") for i in test]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, label string")
    report = {r["class"]: r for r in SM.sequence_classifier(df, "id", "tokens", "label", num_words=10, dim=4).collect()}
    assert set(report) == {"a", "b", "rare", "accuracy", "macro avg", "weighted avg"}
    assert report["rare"]["support"] == 5 and report["rare"]["recall"] == 0 and report["a"]["recall"] == 1
    with pytest.raises(ValueError, match="no training row"):
        SM.sequence_classifier(df.limit(0), "id", "tokens", "label")
