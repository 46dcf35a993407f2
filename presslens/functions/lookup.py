"""Row-local look-ups in a word table.

A word list (valences, a vocabulary) is turned into one value: an array of
``BUCKETS`` hash buckets, each an array of (word, value) entries, computed by
a scalar subquery. A token then finds its value inside the row's expression:
no join, no exchange, no row key. The table must have word-list size, as it is
sent to every task whole (like any broadcast dimension); entries of one word
count as one (the least value).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def word_table(words: DataFrame, word: str, value: str | Column) -> Column:
    """Scalar subquery of the look-up value. Give it a column of its own
    before using it inside a lambda (subqueries can't stand there)."""
    v = F.col(value) if isinstance(value, str) else value
    entries = words.select(F.col(word).alias("w"), v.alias("v")).filter(F.col("w").isNotNull()) \
        .groupBy("w").agg(F.min("v").alias("v"))
    per_bucket = entries.groupBy(_bucket(F.col("w")).alias("b")).agg(F.collect_list(F.struct("w", "v")).alias("e"))
    filled = words.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(per_bucket, "b", "left")
    in_order = F.array_sort(F.collect_list(F.struct("b", "e")))
    return filled.agg(F.transform(in_order, lambda x: x["e"]).alias("t")).scalar()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once a row. An expression that a
    lambda only mentions would be evaluated again for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def look_up(table: Column, word: Column) -> Column:
    """Value of ``word`` in a ``word_table`` column; null if it has none."""
    hits = F.filter(F.get(table, _bucket(word)), lambda e: e["w"] == word)
    return F.get(hits, 0)["v"]


def look_up_all(table: Column, words: Column) -> Column:
    """Values of an array of words."""
    return let(table, lambda t: F.transform(words, lambda w: look_up(t, w)))


def _runs(s: Column) -> Column:
    n = F.size(s)
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at(s, i) != F.get(s, i - 2)))
    return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(
        F.element_at(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), n + 1) - i).alias("tf"))))


def token_counts(tokens: Column) -> Column:
    """Distinct tokens of an array without nulls with their counts, as an
    array of (term, tf), by run lengths over the sorted array."""
    none = F.array().cast("array<struct<term:string,tf:int>>")
    # sort_array compares strings themselves; array_sort would run a lambda for every comparison
    return let(F.sort_array(tokens), lambda s: F.when(F.size(s) > 0, _runs(s)).otherwise(none))
