"""Toxicity classifier: subword-bag embeddings averaged into a linear softmax.

A word (run of letters, lower case) is the mean of the embeddings of its
subwords: the word itself and its character 3- to 5-grams with word
boundaries, hashed into ``2 ** BITS`` buckets. A document is the mean of its
distinct words, each with the square root of its count as weight, and ``PAD``
neutral (zero) words; both keep texts of a few words, or of a few words over
and over, from scoring by chance. A linear softmax reads off the classes (Joulin et al. 2017; Bojanowski et al. 2017). Embeddings and softmax are trained jointly in numpy
with Adagrad. Unseen misspellings share n-grams with seen words.

Fitting uses at most about ``BOUND`` labelled rows of each class, counted after
the labels have met their texts, and of each text a window at a seeded place:
of ``FIT_CHARS`` characters, or of the half, quarter ... of that with which no
class has more than ``FIT_TOTAL``. That bounds the one training task; no text
is left out for its length. Rows are weighted back to the class shares of all
labelled ids. Scoring reads every whole text. As the mean and the
softmax are linear, an embedding enters a score through one number, so what is
sent to the tasks is one float per bucket (1 MiB) and a bias.

Defined cases: a text that is null or has no letter scores the share of label
1 among the labelled rows; without labelled rows of both classes every text
does (0 if there are none at all). Rows with a null label are not learned
from. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chars
from .sampling import label_counts, sample_per_label, window_of, window_size
from .util import field, giving_back, row_keyed, stage

BITS = 18
SIZES = (3, 4, 5)
DIM = 8
PAD = 24
#: Steps of Adagrad over mini-batches, in whole passes over the rows.
STEPS = 1800
RATE = 2.0
BATCH = 32
BOUND = 3000
FIT_CHARS = 16_384
FIT_TOTAL = 10 << 20
SEED = 7


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int32)


def _features(texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text: distinct buckets and their weights in the mean of the words."""
    for text in texts:
        words = chars.words_of([text])
        hashes = chars.word_hashes(words)
        part = np.sqrt(chars.times_in_text(words, hashes))
        kept = part > 0
        at, buckets = [np.flatnonzero(kept)], [_buckets(hashes[kept])]
        place_word = np.searchsorted(words.begin - 1, np.arange(len(words.letters)), "right") - 1
        for bucket, ok in chars.ngram_buckets(words, SIZES, BITS):
            where = np.flatnonzero(ok)
            where = where[kept[place_word[where]]]
            at.append(place_word[where])
            buckets.append(bucket[where])
        word, bucket = np.concatenate(at), np.concatenate(buckets)
        share = (part / np.maximum(np.bincount(word, minlength=len(part)), 1))[word] / (part.sum() + PAD)
        ids, inverse = np.unique(bucket, return_inverse=True)
        yield ids.astype(np.int32), np.bincount(inverse, share, len(ids)).astype(np.float32)


@dataclass
class Model:
    weight: np.ndarray  # per bucket, what it adds to the logit of label 1
    bias: float
    prior: float

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.weight):
            return out
        known = [t or "" for t in texts]
        for group in chars.groups(known):
            words = chars.words_of([known[i] for i in group])
            if not len(words.begin):
                continue
            total = np.zeros(len(words.letters), np.float32)
            count = np.zeros(len(words.letters), np.float32)
            for bucket, ok in chars.ngram_buckets(words, SIZES, BITS):
                total[:len(ok)] += self.weight[bucket] * ok
                count[:len(ok)] += ok
            hashes = chars.word_hashes(words)
            mean = (chars.per_word(words, total) + self.weight[_buckets(hashes)]) / (chars.per_word(words, count) + 1)
            part = np.sqrt(chars.times_in_text(words, hashes))
            n = np.bincount(words.text, part, len(group))
            logit = np.bincount(words.text, mean * part, len(group)) / (n + PAD) + self.bias
            score = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
            out[group] = np.where(n > 0, score, self.prior)
        return out


def train(ids: np.ndarray, shares: np.ndarray, sizes: np.ndarray, labels: np.ndarray, row_weight: np.ndarray,
          prior: float) -> Model:
    """Joint Adagrad on embeddings and softmax. Rows (``sizes`` buckets each, laid
    end to end) come in random order; each ``BATCH`` of them is a mini-batch."""
    rng = np.random.default_rng(SEED)
    used = np.flatnonzero(np.bincount(ids, minlength=1 << BITS))
    number = np.zeros(1 << BITS, np.int32)
    number[used] = np.arange(len(used))
    ids = number[ids]
    emb = rng.uniform(-1 / DIM, 1 / DIM, (len(used), DIM)).astype(np.float32)
    emb_sq = np.full((len(used), 1), 1e-8, np.float32)
    soft, bias = np.zeros((DIM, 2), np.float32), np.log(np.array([1 - prior, prior], np.float32))
    soft_sq, bias_sq = np.full((DIM, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    ends = np.cumsum(sizes)
    batches = []
    for k in range(0, len(sizes), BATCH):
        rows = slice(k, min(k + BATCH, len(sizes)))
        at = slice(ends[k] - sizes[k], ends[rows.stop - 1])
        by_id = np.argsort(ids[at], kind="stable").astype(np.int32)
        own, first = np.unique(ids[at][by_id], return_index=True)
        batches.append((rows, at, by_id, own, first))
    epochs = -(-STEPS // len(batches))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for b in rng.permutation(len(batches)):
            rows, at, by_id, own, first = batches[b]
            share = shares[at, None]
            doc = np.repeat(np.arange(len(sizes[rows])), sizes[rows])
            mean = np.add.reduceat(emb[ids[at]] * share, ends[rows] - sizes[rows] - at.start, axis=0)
            logit = mean @ soft + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(p)), labels[rows]] -= 1
            p *= row_weight[rows][:, None]
            d_emb = np.add.reduceat((p @ soft.T)[doc[by_id]] * share[by_id], first, axis=0)
            d_soft, d_bias = mean.T @ p, p.sum(0)
            emb_sq[own] += (d_emb ** 2).mean(1, keepdims=True)
            emb[own] -= rate * d_emb / np.sqrt(emb_sq[own])
            soft_sq += d_soft ** 2
            soft -= rate * d_soft / np.sqrt(soft_sq)
            bias_sq += d_bias ** 2
            bias -= rate * d_bias / np.sqrt(bias_sq)
    weight = np.zeros(1 << BITS, np.float32)
    weight[used] = emb @ (soft[:, 1] - soft[:, 0])
    return Model(weight, float(bias[1] - bias[0]), prior)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(_features(batch.column("text").to_pylist()))
        yield pa.RecordBatch.from_pydict({
            "place": batch.column("place"), "label": batch.column("label"),
            "ids": pa.array([f[0] for f in found], pa.list_(pa.int32())),
            "shares": pa.array([f[1] for f in found], pa.list_(pa.float32()))})


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from ``docs`` with a 0/1 label; ``learn`` (over the id column ``id``) says which ids may be learned from."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & F.col("id").isNotNull()).distinct()
    if learn is not None:
        known = known.filter(learn)
    counts = label_counts(known, "label")
    n = sum(counts.values())
    prior = counts.get(1, 0) / n if n else 0.0
    nothing = Model(np.zeros(0, np.float32), 0.0, prior)
    if len(counts) < 2:
        return nothing
    sample = sample_per_label(known, "label", counts, [F.col("id")], BOUND, SEED)  # 2 * BOUND narrow rows or so
    texts = row_keyed(docs).select("_fk", "_rx", field(id_col).alias("id"), field(text_col).cast("string").alias("text")).filter(
        F.length("text") > 0)
    place = [F.col("_fk"), F.col("_rx")]
    met = stage(texts.join(F.broadcast(sample), "id").select("_fk", "_rx", "label", window_of(F.col("text"), FIT_CHARS, place, SEED).alias("text")))
    # an id may have met very many documents
    thin = sample_per_label(met, "label", label_counts(met, "label"), place, BOUND, SEED + 2)
    size = window_size(thin, "text", "label", FIT_CHARS, FIT_TOTAL)
    text = window_of(F.col("text"), size, place, SEED + 3)
    rows = (thin.select(F.xxhash64(F.lit(SEED + 1), "text").alias("place"), "label", text.alias("text"))
            .mapInArrow(giving_back(_featured), "place long, label int, ids array<int>, shares array<float>"))
    # the sample is bounded, so one task can hold it; the driver gets the weights alone
    found = rows.repartition(1).sortWithinPartitions("place", "label").mapInArrow(giving_back(_trained(prior)), "weight binary, bias double").collect()
    return Model(np.frombuffer(bytes(found[0]["weight"]), np.float32), found[0]["bias"], prior) if found else nothing


def _trained(prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, shares, sizes, labels = [], [], [], []
        for batch in batches:
            rows = batch.filter(pa.compute.greater(pa.compute.list_value_length(batch.column("ids")), 0))
            sizes.append(pa.compute.list_value_length(rows.column("ids")).to_numpy().astype(np.int64))
            labels.append(rows.column("label").to_numpy())
            # copies, so that the batches can go
            ids.append(rows.column("ids").flatten().to_numpy().copy())
            shares.append(rows.column("shares").flatten().to_numpy().copy())
        if not sizes:
            return
        sizes, labels = np.concatenate(sizes), np.concatenate(labels)
        got = np.bincount(labels, minlength=2)
        if got.min() == 0:
            return
        per_class = np.array([1 - prior, prior]) * len(labels) / got
        flat = []
        for parts in (ids, shares):
            flat.append(np.concatenate(parts))
            parts.clear()
        pa.default_memory_pool().release_unused()
        model = train(flat.pop(0), flat.pop(0), sizes, labels, per_class[labels].astype(np.float32), prior)
        yield pa.RecordBatch.from_pydict({"weight": pa.array([model.weight.tobytes()], pa.binary()),
                                          "bias": pa.array([model.bias], pa.float64())})
    return run


def score(docs: DataFrame, model: Model, keep: Sequence[str], text_col: str = "text") -> DataFrame:
    """Per row: ``_row`` (a struct of the ``keep`` columns) and ``score``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept_text = list(keep).index(text_col) if text_col in keep else None

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("_row")
            texts = batch.column("_text") if kept_text is None else rows.field(kept_text)
            yield pa.RecordBatch.from_arrays([rows, pa.array(shared.value.score(texts.to_pylist()), pa.float64())],
                                             names=["_row", "score"])
            pa.default_memory_pool().release_unused()

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"),
                         *([F.col(text_col).cast("string").alias("_text")] if kept_text is None else []))
    return packed.mapInArrow(giving_back(scored), T.StructType([packed.schema["_row"], T.StructField("score", T.DoubleType())]))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    return score(docs, model, docs.columns, text_col).filter(F.col("score") < threshold).select("_row.*")
