"""Online topic model that reads every document once a pass.

Mini-batches are dealt without replacement by a seeded hash of the document's
key. The documents, as token ids, are staged once in a table partitioned by
batch, each batch in as many files as tasks can work on; a step reads its own
partition. There the E-step runs in Arrow batches, a task sends the expected
counts that are not next to nothing as runs of (cell, sum), which meet by block
of cells, and the driver takes a natural-gradient step on the topics (words x
topics, both parameters).

Defined cases: documents without a known token belong to no batch and change
nothing; of a null key all rows share a batch; an empty vocabulary gives no
topics. The rows of one key share a batch, whose weight follows its size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_path

#: Mini-batches a pass.
BATCHES = 20
#: A step's weight is (OFFSET + step) ** -DECAY, steps from 0.
OFFSET, DECAY = 2.0, 0.51
#: Per document: the mean change that ends the E-step, and its most rounds.
TOLERANCE, MOST_ROUNDS = 1e-3, 50
#: Distinct (document, token) pairs worked on at once: few, as every round reads their topics.
PAIRS = 1 << 15
#: Rows of a block of logarithms.
BLOCK = 1 << 12
#: Expected counts up to this are left out of a task's sums: beside a prior of 1 / topics they are below what a float holds.
NOTHING = 1e-13
#: Cells (word, topic) of a block of sums.
CELLS = 1 << 18


class Topics(NamedTuple):
    weights: np.ndarray  # words x topics
    read: list[int]      # documents read in each pass


def digamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: raised by 6 with the recurrence, then the asymptotic series."""
    x = np.asarray(x, np.float64)
    # 1/x + ... + 1/(x + 5) over one denominator, with y = x * (x + 5): y (y + 4) (y + 6)
    y = x * (x + 5)
    low = (2 * x + 5) * ((3 * y + 20) * y + 24) / (y * (y + 4) * (y + 6))
    x = x + 6
    inverse = 1 / (x * x)
    series = inverse * (1 / 12 - inverse * (1 / 120 - inverse * (1 / 252 - inverse * (1 / 240 - inverse / 132))))
    return np.log(x) - 0.5 / x - series - low


def expected_log(weights: np.ndarray, axis: int) -> np.ndarray:
    """exp(E[log p]) of Dirichlet weights along an axis, by blocks of rows."""
    whole = digamma(weights.sum(axis, keepdims=True))
    out = np.empty_like(weights)
    for lo in range(0, len(weights), BLOCK):
        rows = slice(lo, lo + BLOCK)
        out[rows] = np.exp(digamma(weights[rows]) - (whole if axis == 0 else whole[rows]))
    return out


def expect(doc: np.ndarray, word: np.ndarray, count: np.ndarray, topics: np.ndarray,
           alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """The documents' topic weights and each pair's expected topic counts, less the factor of ``topics``.
    Pairs are ordered by document, documents numbered from 0 without gaps."""
    n, k = int(doc[-1]) + 1, topics.shape[1]
    gamma = alpha + np.tile((np.bincount(doc, count, n) / k)[:, None], (1, k))
    at = topics[word].astype(np.float64)
    ends = np.searchsorted(doc, np.arange(n), "right").tolist()
    spans = list(zip([0, *ends[:-1]], ends))
    words, counts = ([x[lo:hi] for lo, hi in spans] for x in (at, count))
    live = np.arange(n)  # a document that stands still leaves, so that its result hangs on no other
    for _ in range(MOST_ROUNDS):
        old = gamma[live]
        theta = expected_log(old, 1)
        grown = np.empty_like(theta)
        for i, d in enumerate(live.tolist()):
            grown[i] = (counts[d] / (words[d] @ theta[i])) @ words[d]
        gamma[live] = alpha + theta * grown
        live = live[np.abs(gamma[live] - old).mean(1) >= TOLERANCE]
        if not len(live):
            break
    theta = expected_log(gamma, 1)[doc]
    return gamma, theta * (count / np.einsum("ij,ij->i", theta, at))[:, None]


def _pairs(tokens: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, token, count) of sorted, non-empty token lists, whole documents of about PAIRS pairs at a time."""
    sizes = np.asarray(tokens.value_lengths())
    ids = np.asarray(tokens.flatten())
    doc = np.repeat(np.arange(len(sizes)), sizes)
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (ids[1:] != ids[:-1])])
    count = np.diff(np.r_[new, len(ids)]).astype(np.float64)
    doc, ids = doc[new], ids[new]
    ends = np.searchsorted(doc, np.arange(len(sizes)), "right")
    lo = at = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, at + PAIRS, "right")))
        to = int(ends[hi - 1])
        yield doc[at:to] - lo, ids[at:to], count[at:to]
        lo, at = hi, to


def deal(docs: DataFrame, key: str, tokens: str, words: Sequence[str], batches: int = BATCHES,
         seed: int = 42) -> DataFrame:
    """Staged (ids, batch): the sorted ids (places in ``words``) of each document's known tokens, a folder a batch."""
    spark = docs.sparkSession
    slices = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // batches)
    rows = docs.filter(F.col(tokens).isNotNull()).select(
        F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(batches)).cast("int").alias("batch"),
        F.xxhash64(F.col(key), F.spark_partition_id()).alias("_slice"),
        F.col(tokens).cast("array<string>").alias("tokens"))
    shared = spark.sparkContext.broadcast(list(words))

    def numbered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        for part in parts:
            lists = part.column("tokens")
            ids = pa.compute.index_in(lists.flatten().cast(pa.string()), value_set=known, skip_nulls=True)
            ids = np.asarray(pa.compute.fill_null(ids, -1))
            doc = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))[ids >= 0]
            ids = ids[ids >= 0]
            ids = ids[np.lexsort((ids, doc))]
            size = np.bincount(doc, minlength=len(lists))
            kept = pa.array(np.flatnonzero(size))
            found = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size[size > 0])].astype(np.int32)),
                                             pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([found, part.column("batch").take(kept), part.column("_slice").take(kept)],
                                             names=["ids", "batch", "_slice"])

    path = stage_path(spark)
    # each task has a slice of every batch and writes it as a file; a key of very many rows is spread
    rows.mapInArrow(numbered, "ids array<int>, batch int, _slice bigint").repartition(slices, "_slice") \
        .drop("_slice").write.partitionBy("batch").parquet(path)
    return spark.read.schema("ids array<int>, batch int").parquet(path)


#: Sums of a block of cells: the number of documents (once a task), steps from cell to cell, floats.
SUMS = "block bigint, docs bigint, cells binary, sums binary"


def _sums(cell: np.ndarray, value: np.ndarray, docs: int) -> pa.RecordBatch:
    """SUMS of ascending cells; the first row has the number of documents."""
    block = cell // CELLS
    own, first = np.unique(block, return_index=True)
    if not len(own):
        own, first = np.zeros(1, np.int64), np.zeros(1, np.int64)
    parts = [slice(lo, hi) for lo, hi in zip(first, [*first[1:], len(cell)])]
    steps = [np.diff(cell[p], prepend=b * CELLS).astype(np.int32).tobytes() for b, p in zip(own.tolist(), parts)]
    return pa.RecordBatch.from_arrays(
        [pa.array(own, pa.int64()), pa.array([docs] + [0] * (len(own) - 1), pa.int64()), pa.array(steps, pa.binary()),
         pa.array([value[p].astype(np.float32).tobytes() for p in parts], pa.binary())], names=["block", "docs", "cells", "sums"])


def _runs(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(cells, sums) of each row of SUMS."""
    for block, cells, sums in zip(part.column("block").to_pylist(), part.column("cells"), part.column("sums")):
        yield (block * CELLS + np.cumsum(np.frombuffer(cells.as_buffer(), np.int32), dtype=np.int64),
               np.frombuffer(sums.as_buffer(), np.float32).astype(np.float64))


def _added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SUMS of whole blocks, each block once."""
    found, docs = {}, 0
    for part in parts:
        docs += pa.compute.sum(part.column("docs")).as_py() or 0
        for block, (cell, sums) in zip(part.column("block").to_pylist(), _runs(part)):
            found.setdefault(block, np.zeros(CELLS))[cell - block * CELLS] += sums
    for block, sums in found.items():
        cell = np.flatnonzero(sums)
        yield _sums(block * CELLS + cell, sums[cell], docs)
        docs = 0


def fit(dealt: DataFrame, words: int, k: int, passes: int, batches: int = BATCHES, seed: int = 42) -> Topics:
    """Topics over ``words`` token ids from dealt documents, each read once a pass."""
    spark = dealt.sparkSession
    total = dealt.count()
    prior = 1.0 / k
    weights = np.random.default_rng(seed).gamma(100.0, 0.01, (words, k))
    read, step = [], 0
    for _ in range(passes):
        read.append(0)
        for b in range(batches):
            topics = expected_log(weights, 0).astype(np.float32)
            shared = spark.sparkContext.broadcast(topics)

            def statistics(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                found, n = np.zeros((words, k)), 0
                for part in parts:
                    if not part.num_rows:
                        continue
                    n += part.num_rows
                    for doc, word, count in _pairs(part.column(0)):
                        _, counts = expect(doc, word, count, shared.value, prior)
                        order = np.argsort(word, kind="stable")
                        begins = np.flatnonzero(np.r_[True, np.diff(word[order]) != 0])
                        found[word[order][begins]] += np.add.reduceat(counts[order], begins)
                if n:
                    kept = found * shared.value > NOTHING
                    cell = np.flatnonzero(kept)
                    yield _sums(cell, found[kept], n)

            got = dealt.filter(F.col("batch") == b).select("ids").mapInArrow(statistics, SUMS).repartition("block") \
                .mapInArrow(_added, SUMS).toArrow()
            shared.destroy()
            n = int(pa.compute.sum(got.column("docs")).as_py() or 0)
            if n:
                read[-1] += n
                rate = (OFFSET + step) ** -DECAY
                weights *= 1 - rate
                weights += rate * prior
                for part in got.to_batches():
                    for cell, sums in _runs(part):
                        weights.ravel()[cell] += rate * total / n * sums * topics.ravel()[cell]
                step += 1
    return Topics(weights, read)
