"""Classifier over token sequences (M14 on M13): embedding table, mean
pooling, dense softmax layer.

Training is data-parallel. The sequences are staged once in a table
partitioned by mini-batch, dealt by a seeded hash of the key, so that a pass
reads every training row once. A step sends the parameters to the tasks, which
work out gradients in Arrow batches; these are added up by aggregation per
parameter row, and the driver takes an Adam step. The driver holds words x
``dim`` and classes x ``dim`` numbers (and Adam's two moments of each), which
are settings of the job, never rows.

Defined cases: a row without tokens pools to zero and gets the class of the
bias; rows of one key share a batch; a test label that no training row has
counts as a wrong row; without a training row there is nothing to fit
(ValueError).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, stage_path
from .features import SEQ_NUM_WORDS, classification_report, sequences, split_flag, word_index

DIM, PASSES, BATCHES, RATE = 32, 4, 8, 0.1
#: Adam's decay of the two moments, and the number that keeps its quotient finite.
FIRST, SECOND, TINY = 0.9, 0.999, 1e-8
#: Rows worked on at once in a task.
ROWS = 1 << 12
#: Folder of the test rows among those of the batches.
TEST = -1


class Network(NamedTuple):
    embedding: np.ndarray  # words x dim; row 0 is padding, never looked up
    dense: np.ndarray      # classes x dim
    bias: np.ndarray       # classes


class Trained(NamedTuple):
    network: Network
    read: list[int]     # rows read in each pass
    loss: list[float]   # mean loss of each pass


def initial(words: int, classes: int, dim: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    return Network(rng.normal(0, 0.1, (words, dim)), rng.normal(0, 0.1, (classes, dim)), np.zeros(classes))


def _chunks(part: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, row of each token, token) of the sequences, padding left out."""
    for lo in range(0, part.num_rows, ROWS):
        lists = part.column("ids").slice(lo, ROWS)
        ids = np.asarray(lists.flatten())
        row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
        yield slice(lo, lo + len(lists)), row[ids > 0], ids[ids > 0]


def _sums_by(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their rows of ``values``."""
    order = np.argsort(key, kind="stable")
    begins = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(key) else np.zeros(0, int)
    sums = np.add.reduceat(values[order], begins) if len(key) else np.zeros((0, values.shape[1]))
    return key[order][begins], sums


def pooled(network: Network, n: int, row: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean embedding of each of n rows, and one over its number of tokens (0 without any)."""
    size = np.bincount(row, minlength=n)
    share = np.divide(1.0, size, out=np.zeros(n), where=size > 0)
    out = np.zeros((n, network.embedding.shape[1]))
    at, sums = _sums_by(row, network.embedding[token])
    out[at] = sums
    return out * share[:, None], share


def probabilities(network: Network, pool: np.ndarray) -> np.ndarray:
    score = pool @ network.dense.T + network.bias
    score = np.exp(score - score.max(1, keepdims=True))
    return score / score.sum(1, keepdims=True)


def gradients(network: Network, n: int, row: np.ndarray, token: np.ndarray, label: np.ndarray):
    """Summed loss of n rows and its gradients: (loss, tokens, their embedding
    gradients, dense gradient, bias gradient)."""
    pool, share = pooled(network, n, row, token)
    p = probabilities(network, pool)
    at = np.arange(n)
    loss = -np.log(np.maximum(p[at, label], 1e-300)).sum()
    p[at, label] -= 1
    down = (p @ network.dense) * share[:, None]
    tokens, sums = _sums_by(token, down[row])
    return loss, tokens, sums, p.T @ pool, p.sum(0)


def fit(dealt: DataFrame, words: int, classes: int, dim: int = DIM, passes: int = PASSES, batches: int = BATCHES,
        rate: float = RATE, seed: int = 42) -> Trained:
    """Network over ``dealt`` rows (y int, ids array<int>, batch int)."""
    spark = dealt.sparkSession
    network = initial(words, classes, dim, seed)
    first, second = ([np.zeros_like(a) for a in network] for _ in range(2))
    names = [f"g{i}" for i in range(dim)]
    # parameter rows: token t is row t, class c is row -1 - c, which also bears its bias, rows and loss
    schema = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("rows", T.LongType()),
                           T.StructField("loss", T.DoubleType()), T.StructField("bias", T.DoubleType()),
                           *(T.StructField(g, T.FloatType()) for g in names)])
    sums = [F.sum(c).alias(c) for c in ("rows", "loss", "bias", *names)]
    read, losses, step = [], [], 0
    for _ in range(passes):
        read.append(0)
        losses.append(0.0)
        for b in range(batches):
            shared = spark.sparkContext.broadcast(Network(*(a.astype(np.float32) for a in network)))

            def summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                mine = shared.value
                embedding, dense, bias = (np.zeros(a.shape) for a in mine)
                rows, loss = np.zeros(classes, np.int64), 0.0
                for part in parts:
                    y = np.asarray(part.column("y"))
                    for span, row, token in _chunks(part):
                        label = y[span]
                        extra, tokens, grown, to_dense, to_bias = gradients(mine, len(label), row, token, label)
                        loss += extra
                        embedding[tokens] += grown
                        dense += to_dense
                        bias += to_bias
                        rows += np.bincount(label, minlength=classes)
                if rows.any():
                    at = np.flatnonzero(embedding.any(1))
                    blank = np.zeros(len(at))
                    values = np.vstack([dense, embedding[at]]).astype(np.float32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.r_[-1 - np.arange(classes), at], pa.int32()),
                         pa.array(np.r_[rows, blank.astype(np.int64)], pa.int64()),
                         pa.array(np.r_[loss, np.zeros(classes - 1), blank]), pa.array(np.r_[bias, blank]),
                         *(pa.array(values[:, i]) for i in range(dim))], names=schema.names)

            got = dealt.filter(F.col("batch") == b).select("y", "ids").mapInArrow(summed, schema) \
                .groupBy("at").agg(*sums).toArrow()
            shared.destroy()
            if not got.num_rows:
                continue
            at = np.asarray(got.column("at"))
            values = np.column_stack([np.asarray(got.column(g)) for g in names])
            n = int(np.asarray(got.column("rows")).sum())
            found = Network(*(np.zeros_like(a) for a in network))
            found.embedding[at[at >= 0]] = values[at >= 0] / n
            found.dense[-1 - at[at < 0]] = values[at < 0] / n
            found.bias[-1 - at[at < 0]] = np.asarray(got.column("bias"))[at < 0] / n
            read[-1] += n
            losses[-1] += float(np.asarray(got.column("loss")).sum())
            step += 1
            for a, g, m, v in zip(network, found, first, second):
                m += (1 - FIRST) * (g - m)
                v += (1 - SECOND) * (g * g - v)
                a -= rate * (m / (1 - FIRST ** step)) / (np.sqrt(v / (1 - SECOND ** step)) + TINY)
        losses[-1] /= max(read[-1], 1)
    return Trained(network, read, losses)


def predict(rows: DataFrame, network: Network, labels: list[str]) -> DataFrame:
    """(label, prediction) of every row of (label, ids)."""
    shared = rows.sparkSession.sparkContext.broadcast((Network(*(a.astype(np.float32) for a in network)), labels))

    def named(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, names = shared.value
        names = pa.array(names, pa.string())
        for part in parts:
            for span, row, token in _chunks(part):
                pool, _ = pooled(mine, span.stop - span.start, row, token)
                best = probabilities(mine, pool).argmax(1)
                yield pa.RecordBatch.from_arrays([part.column("label").slice(span.start, span.stop - span.start),
                                                  names.take(pa.array(best))], names=["label", "prediction"])

    return rows.select("label", "ids").mapInArrow(named, "label string, prediction string")


def deal(df: DataFrame, key: str, tokens: str, target: str, num_words: int = SEQ_NUM_WORDS, max_len: int = 20,
         batches: int = BATCHES, seed: int = 42) -> tuple[DataFrame, list[str]]:
    """Staged (label, y, ids, batch), a folder a batch, test rows (M2) in
    folder TEST, and the labels of the training rows by frequency. Vocabulary
    and labels come from the training rows alone."""
    spark = df.sparkSession
    base = materialize(df.filter(F.col(tokens).isNotNull() & F.col(target).isNotNull()).select(
        F.col(key).alias("_key"), F.col(tokens).alias("_tokens"), F.col(target).cast("string").alias("label"),
        split_flag(key, seed).alias("_test")))
    train = base.filter(~F.col("_test"))
    labels = [r["label"] for r in train.groupBy("label").count().orderBy(F.desc("count"), "label").collect()]
    if not labels:
        raise ValueError("no training row")
    seqs = sequences(base, "_key", "_tokens", word_index(train, "_tokens", num_words), max_len, carry=["label", "_test"])
    slices = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // batches)
    batch = F.when(F.col("_test"), F.lit(TEST)).otherwise(
        F.pmod(F.xxhash64(F.col("_key"), F.lit(seed)), F.lit(batches)).cast("int"))
    path = stage_path(spark)
    # a slice of a batch lies in one task, so that a batch has few files; a key of very many rows is spread
    seqs.select("label", (F.array_position(F.lit(labels), F.col("label")) - 1).cast("int").alias("y"),
                F.col("sequence").alias("ids"), batch.alias("batch"),
                F.pmod(F.xxhash64(F.col("_key"), F.spark_partition_id()), F.lit(slices)).alias("_slice")) \
        .repartition("batch", "_slice").drop("_slice").write.partitionBy("batch").parquet(path)
    return spark.read.schema("label string, y int, ids array<int>, batch int").parquet(path), labels


def sequence_classifier(df: DataFrame, key: str, tokens: str, target: str, num_words: int = SEQ_NUM_WORDS,
                        max_len: int = 20, dim: int = DIM, passes: int = PASSES, batches: int = BATCHES,
                        rate: float = RATE, seed: int = 42) -> DataFrame:
    """M14 on M13's sequences: report (M8) over every test row."""
    dealt, labels = deal(df, key, tokens, target, num_words, max_len, batches, seed)
    network = fit(dealt, num_words, len(labels), dim, passes, batches, rate, seed).network
    return classification_report(predict(dealt.filter(F.col("batch") == TEST), network, labels))
