"""Language identification with spans of mixed-language text.

1. A word's script (by the Unicode ranges below) narrows the languages that
   may have written it to those whose learned words use that script.
2. Every word gets a score per candidate language: the log-probability of its
   character 2- to 4-grams with word boundaries under the language's smoothed
   counts, hashed into ``2 ** BITS`` buckets.
3. Viterbi over the words of a text with a constant penalty for switching
   language labels every word; runs of one language are the spans.

A document's language is the one whose spans hold most letters (on a tie the
first by code point), its score the share of letters in them.

Counts are learned from about ``BOUND`` labelled texts of each language, of
longer ones a window of ``FIT_CHARS`` characters at a seeded place;
identification reads every whole text. The model
sent to the tasks has ``languages * 2 ** BITS`` floats; languages are the
distinct labels.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and
no spans; so is every text if nothing could be learned. A word in a script that
no language was seen with may belong to any. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chars
from .sampling import label_counts, sample_per_label, window_of
from .util import field, row_keyed

BITS = 16
SIZES = (2, 3, 4)
BOUND = 2000
FIT_CHARS = 16_384
SWITCH = 12.0
SMOOTH = 0.05
SCRIPT_SHARE = 0.001
SEED = 5
UNKNOWN = "und"

# First and last code points of the letters of some scripts.
SCRIPTS = (
    ("Latin", ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A))),
    ("Greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("Cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("Armenian", ((0x530, 0x58F),)),
    ("Hebrew", ((0x590, 0x5FF),)),
    ("Arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("Devanagari", ((0x900, 0x97F),)),
    ("Bengali", ((0x980, 0x9FF),)),
    ("Tamil", ((0xB80, 0xBFF),)),
    ("Thai", ((0xE00, 0xE7F),)),
    ("Georgian", ((0x10A0, 0x10FF),)),
    ("Hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("Kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF))),
    ("Han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))),
)


@lru_cache(1)
def _script_table() -> np.ndarray:
    """For each code point the number of its script, 0 if it is in none of SCRIPTS."""
    table = np.zeros(0x110000, np.uint8)
    for number, (_, ranges) in enumerate(SCRIPTS, 1):
        for first, last in ranges:
            table[first:last + 1] = number
    return table


def _word_scripts(words: chars.Words) -> np.ndarray:
    return _script_table()[words.letters[words.begin]]


@dataclass
class Model:
    langs: list[str]
    log_p: np.ndarray  # buckets x languages
    candidates: np.ndarray  # scripts x languages, whether a language uses the script

    def word_scores(self, words: chars.Words) -> np.ndarray:
        """words x languages; languages that a word's script rules out score far below the others."""
        total = np.zeros((len(words.letters), len(self.langs)), np.float32)
        for bucket, ok in chars.ngram_buckets(words, SIZES, BITS):
            ok = ok & (words.letters != 0)[1:len(ok) + 1]
            total[:len(ok)] += self.log_p[bucket] * ok[:, None]
        scores = chars.per_word(words, total) / len(SIZES)
        return scores + np.where(self.candidates[_word_scripts(words)], np.float32(0), np.float32(-1e4))


def viterbi(scores: np.ndarray, n_words: np.ndarray, penalty: float) -> np.ndarray:
    """Best language per word for texts laid end to end (``n_words`` each).

    All texts of the group step together: at step t those with more than t
    words. Ties prefer staying, then the lower language number.
    """
    first = np.cumsum(n_words) - n_words
    order = np.argsort(-n_words, kind="stable")
    first, length = first[order], n_words[order]
    steps = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(steps), "left")  # texts with more than t words
    came = np.zeros(len(scores), np.int16)  # best language of the word before, for those that switch
    stay = np.zeros(scores.shape, bool)
    best = scores[first[:alive[0]]] if steps else None
    tail = np.zeros(len(n_words), np.int64)
    label = np.zeros(len(scores), np.int16)
    for t in range(1, steps + 1):
        now = alive[t] if t < steps else 0
        if now < len(best):
            tail[now:len(best)] = best[now:].argmax(1)
            best = best[:now]
        if t == steps:
            break
        at = first[:now] + t
        top = best.argmax(1)
        switched = best[np.arange(now), top] - np.float32(penalty)
        came[at] = top
        stay[at] = best >= switched[:, None]
        best = np.maximum(best, switched[:, None]) + scores[at]
    for t in range(steps - 1, -1, -1):
        now = alive[t]
        at = first[:now] + t
        label[at] = tail[:now]
        tail[:now] = np.where(stay[at, tail[:now]], tail[:now], came[at])
    return label


def identify_texts(model: Model, texts: Sequence[str | None], penalty: float = SWITCH):
    """(language, score, spans) per text; spans are (language, first character, length)."""
    out: list[tuple[str, float, list[tuple[str, int, int]]]] = [(UNKNOWN, 0.0, [])] * len(texts)
    known = [t or "" for t in texts]
    for group in chars.groups(known) if model.langs else ():
        words = chars.words_of([known[i] for i in group])
        if not len(words.begin):
            continue
        n_words = np.bincount(words.text, minlength=len(group))
        label = viterbi(model.word_scores(words), n_words, penalty)
        size = words.end - words.begin
        held = np.zeros((len(group), len(model.langs)))
        np.add.at(held, (words.text, label), size)
        starts = np.flatnonzero(np.r_[True, (np.diff(label) != 0) | (np.diff(words.text) != 0)])
        stops = np.r_[starts[1:], len(label)] - 1
        span_text = words.text[starts]
        span_of = np.searchsorted(span_text, np.arange(len(group) + 1))
        span_lang = label[starts].tolist()
        span_at = (words.begin[starts] - words.text_at[span_text]).tolist()
        span_size = (words.end[stops] - words.begin[starts]).tolist()
        best, all_ = held.argmax(1), held.sum(1)
        for g in np.flatnonzero(n_words).tolist():
            out[group[g]] = (model.langs[best[g]], float(held[g, best[g]] / all_[g]),
                             [(model.langs[span_lang[k]], span_at[k], span_size[k])
                              for k in range(span_of[g], span_of[g + 1])])
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language of the partition: n-gram counts by bucket and words by script."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        texts = batch.column("text").to_pylist()
        langs = batch.column("lang").to_pylist()
        for lang in set(langs):
            grams, scripts = held.setdefault(lang, (np.zeros(1 << BITS, np.int64), np.zeros(len(SCRIPTS) + 1, np.int64)))
            own = [t for t, x in zip(texts, langs) if x == lang]
            for group in chars.groups(own):
                words = chars.words_of([own[i] for i in group])
                if not len(words.begin):
                    continue
                for bucket, ok in chars.ngram_buckets(words, SIZES, BITS):
                    ok = ok & (words.letters != 0)[1:len(ok) + 1]
                    grams += np.bincount(bucket[ok], minlength=1 << BITS)
                scripts += np.bincount(_word_scripts(words), minlength=len(SCRIPTS) + 1)
    for lang, (grams, scripts) in held.items():
        # places 0 .. 2 ** BITS - 1 are buckets, those after them scripts
        counts = np.r_[grams, scripts]
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()),
                                          "place": pa.array(at, pa.int32()), "n": pa.array(counts[at], pa.int64())})


def fit(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Model:
    """Learn from rows with a language; ``learn`` (over the id column ``id``) says which rows may be learned from."""
    rows = row_keyed(docs).select("_fk", "_rx", field(id_col).alias("id"), field(text_col).cast("string").alias("text"),
                                  field(lang_col).cast("string").alias("lang")).filter(F.col("lang").isNotNull())
    if learn is not None:
        rows = rows.filter(learn)
    counts = label_counts(rows, "lang")
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((0, 0), np.float32), np.zeros((0, 0), bool))
    place = [F.col("_fk"), F.col("_rx")]  # not the id: rows that share one must not come or go together
    sample = sample_per_label(rows, "lang", counts, place, BOUND, SEED).filter(F.length("text") > 0).select(
        window_of(F.col("text"), FIT_CHARS, place, SEED).alias("text"), "lang")
    found = (sample.mapInArrow(_counted, "lang string, place int, n long")
             .groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow())
    table = np.zeros(((1 << BITS) + len(SCRIPTS) + 1, len(langs)))
    number = {x: i for i, x in enumerate(langs)}
    table[found["place"].to_numpy(), [number[x] for x in found["lang"].to_pylist()]] = found["n"].to_numpy()
    grams, scripts = table[:1 << BITS], table[1 << BITS:]
    log_p = np.log((grams + SMOOTH) / (grams.sum(0) + SMOOTH * (1 << BITS)))
    candidates = scripts > SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
    candidates[~candidates.any(1)] = True
    return Model(langs, log_p.astype(np.float32), candidates)


SPANS = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("begin", T.IntegerType()),
                                  T.StructField("length", T.IntegerType())]))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
             penalty: float = SWITCH) -> DataFrame:
    """Per row: id, lang_pred, score and spans (language, first character, number of characters)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)])
    spans = pa.list_(pa.struct([("lang", pa.string()), ("begin", pa.int32()), ("length", pa.int32())]))

    def identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = identify_texts(shared.value, batch.column("text").to_pylist(), penalty)
            keys = ("lang", "begin", "length")
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
                pa.array([[dict(zip(keys, s)) for s in f[2]] for f in found], spans)], names=schema.names)

    return rows.mapInArrow(identified, schema).withColumnRenamed("id", id_col)
