"""The forest on sparse rows: splits against a plain search, classes against MLlib's forest."""

import math
import random

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import SparseVector, Vectors
from pyspark.sql import functions as F

from presslens.plans import models as MO
from presslens.plans import sparse_forest as SF


def _frame(spark, rows):
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType
    return spark.createDataFrame(rows, StructType([StructField("id", LongType()), StructField("label", DoubleType()),
                                                   StructField("features", VectorUDT())]))


def _gini_sum(counts):
    return sum(c * c for c in counts) / sum(counts)


def test_best_splits_match_a_plain_search(monkeypatch):
    rng = np.random.default_rng(5)
    size, classes, nodes, rows = 6, 3, 7, 400
    node, label = rng.integers(0, nodes, rows), rng.integers(0, classes, rows)
    bins = np.where(rng.random((rows, size)) < 0.6, 0, rng.integers(1, 5, (rows, size)))
    bins[node == 3] = 0  # a node that nothing splits
    whole = SF._sparse(np.array([[int(((node == v) & (label == c)).sum()) for c in range(classes)] for v in range(nodes)]))
    keys = [((node[r] * size + f) * SF.BINS + bins[r, f]) * classes + label[r]
            for r in range(rows) for f in range(size) if bins[r, f]]
    key, count = SF._added([np.array(keys)], [np.ones(len(keys), np.int64)])
    for dense in (1, SF.DENSE):
        monkeypatch.setattr(SF, "DENSE", dense)
        got = {int(v): (int(f), int(b), left.tolist()) for v, f, b, left in zip(*SF.best_splits(key, count, whole, size, classes))}
        assert set(got) == set(range(nodes)) - {3}
        for v, (f, b, left) in got.items():
            mine = node == v
            def fit(f, b):
                sides = [[int((mine & (label == c) & s).sum()) for c in range(classes)] for s in (bins[:, f] <= b, bins[:, f] > b)]
                return sum(map(_gini_sum, sides)) if all(map(sum, sides)) else -1, sides[0]
            best = max(fit(g, c)[0] for g in range(size) for c in range(5))
            assert math.isclose(fit(f, b)[0], best) and fit(f, b)[1] == left


def test_cuts_follow_the_values(spark):
    rows = [(i, 0.0, SparseVector(3, {0: 0.5} if i % 2 else {0: 0.5, 1: (i + 1) / 1000})) for i in range(1000)]
    got = SF.cuts(_frame(spark, rows), "features", 3)
    assert np.isinf(got[0]).all() and np.isinf(got[2]).all()  # one value, none
    inner = got[1][np.isfinite(got[1])]
    assert len(inner) == SF.BINS - 2
    sizes = np.diff(np.searchsorted([(i + 1) / 1000 for i in range(0, 1000, 2)], [0, *inner, 2]))
    assert sizes.min() >= 10 and sizes.max() <= 24  # 500 values in 31 bins


def _accuracy(pred):
    return pred.select(F.avg((F.col("prediction") == F.col("truth")).cast("double"))).first()[0]


def test_forest_is_as_good_as_mllib(spark, monkeypatch):
    """Words of the class among noise, dense and sparse rows, one row without words; trees in one group and in several."""
    rng = random.Random(2)
    rows = []
    for i in range(2000):
        c = rng.randrange(4)
        words = {rng.randrange(60): rng.random() for _ in range(8)}
        words.update({60 + c * 5 + rng.randrange(5): 0.2 + rng.random() for _ in range(2)})
        v = SparseVector(80, words)
        rows.append((i, float(c), Vectors.dense(v.toArray()) if i % 7 == 0 else v))
    rows.append((5000, 0.0, SparseVector(80, {})))
    df = _frame(spark, rows)
    train, test = df.filter("id % 5 > 0"), df.filter("id % 5 = 0").withColumnRenamed("label", "truth")
    model = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=20, maxDepth=12, seed=1).fit(train)
    mllib = _accuracy(model.transform(test))
    both = train.withColumn("truth", F.col("label")).unionByName(test.withColumn("label", F.lit(None).cast("double")))
    for most in (SF.ROW_TREES, 2001 * 10):
        monkeypatch.setattr(SF, "ROW_TREES", most)
        got = SF.predict(both, "label", "features", 80, 4, trees=20, depth=12).cache()
        assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in test.collect())
        assert _accuracy(got) > max(0.8, mllib - 0.04)


def test_forest_without_splits_predicts_the_largest_class(spark):
    rows = [(i, float(i % 3 == 0), SparseVector(2, {})) for i in range(90)]
    rows += [(100, None, SparseVector(2, {0: 1.0})), (101, None, SparseVector(2, {}))]
    for depth in (0, 3):
        got = SF.predict(_frame(spark, rows), "label", "features", 2, 2, trees=5, depth=depth).collect()
        assert {(r["id"], r["prediction"]) for r in got} == {(100, 0.0), (101, 0.0)}


def test_experiments_count_only_what_is_there(spark):
    """No row of the forest holds a number per feature: MLlib's forest is not used by the experiments."""
    rng = random.Random(4)
    rows = [(i, " ".join([f"{'ab'[i % 2]}{rng.randrange(4)}x", *(f"w{rng.randrange(300)}" for _ in range(6))]), "ab"[i % 2])
            for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    report = MO.run_experiment(df, "id", "text", "label", 400, "e", models=["random_forest"],
                               options={"random_forest": {"trees": 30, "depth": 20}})
    own = {r["class"]: r for r in report.collect()}
    assert set(own) == {"a", "b", "accuracy", "macro avg", "weighted avg"} and own["accuracy"]["f1_score"] > 0.85


def test_inputs_of_experiments_are_stages(spark, sf_dir, monkeypatch):
    """An experiment reads its input three times: authors' articles and balanced classes are joined once."""
    from presslens.registry import q_models
    seen = []
    monkeypatch.setattr(q_models.MO, "run_experiment", lambda df, *rest: seen.append(df))
    for name in ("m7_title_author", "m7_article_author", "m7_title_topic_balanced"):
        getattr(q_models, name)(spark, sf_dir)
        plan = seen[-1]._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and seen[-1].count() > 0


def test_offered_features_are_looked_up_as_they_are_tested():
    """Wide rows look up what their node is offered; it is what each non-zero feature's own test finds."""
    rng = np.random.default_rng(8)
    for size, rows, nodes in ((60, 2500, 9), (1, 5, 2)):
        offered = math.ceil(math.sqrt(size))
        units = [u for u in range(1, max(size, 2)) if math.gcd(u, size) == 1]
        mixed = rng.permutation(size).astype(np.uint32)
        step = np.r_[rng.choice(units, nodes), 0].astype(np.uint32)
        start = np.r_[rng.integers(0, size, nodes), size - 1].astype(np.uint32)
        bins = np.where(rng.random((rows, size)) < 0.5, 0, rng.integers(1, 32, (rows, size))).astype(np.uint8)
        own = rng.integers(-1, nodes, rows).astype(np.int32)
        got = SF._sought(own, bins, SF._inverses(mixed), step, start, offered)
        want = sorted((r, f, int(bins[r, f])) for r in range(rows) if own[r] >= 0 for f in range(size)
                      if bins[r, f] and (int(step[own[r]]) * int(mixed[f]) + int(start[own[r]])) % size < offered)
        assert sorted(zip(*(x.tolist() for x in got))) == want and want
    assert [len(x) for x in SF._sought(np.full(3, -1), bins[:3], SF._inverses(mixed), step, start, 1)] == [0, 0, 0]


def test_counts_of_a_level_are_sent_by_buckets_of_nodes(spark, monkeypatch):
    """The counts meet in a few rows of a task, not in a row each, and the splits hang on neither that nor the look-up."""
    rng = random.Random(4)
    rows = [(i, float(i % 3), SparseVector(64, {f: 1.0 + rng.random() for f in sorted(rng.sample(range(64), 30))}))
            for i in range(300)]
    state = SF._begin(SF._binned(_frame(spark, rows), "label", "features", SF.cuts(_frame(spark, rows), "features", 64), 3)
                      .coalesce(1), 5, 0, 1)
    whole = SF._sparse(SF._root_counts(state, 5, 3))
    want = SF._splits(state, [], whole, [1], 5, 64, 3).sort_by("node")
    monkeypatch.setattr(SF, "SENT", 100)
    again = SF._splits(state, [], whole, [1], 5, 64, 3).sort_by("node")
    assert want.num_rows == 5 and again.equals(want)
    for tree, feature, bin_ in zip(*(want.column(c).to_pylist() for c in ("node", "feature", "bin"))):
        assert 0 <= feature < 64 and 0 <= bin_ < SF.BINS - 1


def test_thick_and_thin_counts_split_alike(monkeypatch):
    """All cells of a feature laid out, or its counts alone: the same splits, whatever the share that tells them apart."""
    rng = np.random.default_rng(12)
    size, classes, nodes = 5, 7, 6
    key = np.unique(((rng.integers(0, nodes, 3000) * size + rng.integers(0, size, 3000) ** 2 // size) * SF.BINS
                     + 1 + rng.integers(0, 30, 3000) ** 2 // 30) * classes + rng.integers(0, classes, 3000))
    count = rng.integers(1, 5, len(key))
    held = np.zeros((nodes, classes), np.int64)
    np.add.at(held, (key // (size * SF.BINS * classes), key % classes), count)
    got = []
    for thick, cells in ((10 ** 9, SF.CELLS), (8, SF.CELLS), (8, 1), (1, SF.CELLS)):
        monkeypatch.setattr(SF, "THICK", thick)
        monkeypatch.setattr(SF, "CELLS", cells)
        got.append([x.tolist() for x in SF.best_splits(key, count, SF._sparse(held), size, classes)])
    assert len(got[0][0]) == nodes and all(g == got[0] for g in got)


def test_nodes_of_all_trees_are_looked_up_at_once():
    """What the nodes of all trees are offered is found for a block of rows together, runs that go round included."""
    rng = np.random.default_rng(9)
    size, rows, trees, nodes, offered = 50, 40, 6, 12, 8
    mixed = rng.permutation(size).astype(np.uint32)
    step = np.r_[rng.choice([1, 3, 7], nodes), 0].astype(np.uint32)
    start = np.r_[rng.integers(0, size, nodes), size - 1].astype(np.uint32)
    bins = np.where(rng.random((rows, size)) < 0.6, 0, rng.integers(1, 32, (rows, size))).astype(np.uint8)
    own = rng.integers(-1, nodes, (rows, trees)).astype(np.int32)
    want = sorted((r * trees + t, f, int(bins[r, f])) for r in range(rows) for t in range(trees) if own[r, t] >= 0
                  for f in range(size) if bins[r, f]
                  and (int(step[own[r, t]]) * int(mixed[f]) + int(start[own[r, t]])) % size < offered)
    for filled in (None, np.nonzero(bins)):
        got = SF._sought(own, bins, SF._inverses(mixed), step, start, offered, filled)
        assert sorted(zip(*(x.tolist() for x in got))) == want and want


def test_quantiles_are_those_of_spark(spark):
    rng = np.random.default_rng(10)
    for n in (1, 2, 500):
        value, count = np.unique(rng.random(n)), rng.integers(1, 9, n)
        df = spark.createDataFrame(list(zip(value.tolist(), count.tolist())), "v double, n int")
        at = ", ".join(str(i / (SF.BINS - 1)) for i in range(1, SF.BINS - 1))
        assert df.select(F.expr(f"percentile(v, array({at}), n)")).first()[0] == SF._quantiles(value, count).tolist()


def test_cells_of_a_feature_meet_in_few_rows(spark):
    """The cells of the values are sent by buckets of features, not in a row each."""
    rng = random.Random(6)
    rows = [(i, 0.0, SparseVector(40, {f: 0.01 + rng.random() for f in range(40)})) for i in range(400)]
    df, seen = _frame(spark, rows).coalesce(1), []
    kept = type(df).mapInArrow
    type(df).mapInArrow = lambda self, *a, **b: (seen.append(kept(self, *a, **b)), seen[-1])[1]
    try:
        got = SF.cuts(df, "features", 40)
    finally:
        type(df).mapInArrow = kept
    assert np.isfinite(got).all() and seen[0].count() <= 40
