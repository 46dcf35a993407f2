"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_counts(rows: DataFrame, label: str) -> dict:
    return {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}


def sample_per_label(rows: DataFrame, label: str, counts: dict, key: list[Column], bound: int, seed: int) -> DataFrame:
    """About ``bound`` rows of each label at most, all rows of a label with fewer.

    A row is chosen by a seeded hash of ``key`` against its label's rate, so
    the choice needs no sort or shuffle and is the same in every run.
    """
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11) / F.lit(float(1 << 53))
    chosen = F.lit(False)
    for value, n in sorted(counts.items(), key=str):
        chosen = chosen | ((F.col(label) == F.lit(value)) & (u < F.lit(min(1.0, bound / n))))
    return rows.filter(chosen)


def window_of(text: Column, size: int | Column, key: list[Column], seed: int) -> Column:
    """``text`` if it has at most ``size`` characters, else so many of them from a place chosen by a seeded hash of ``key``."""
    size = F.lit(size) if isinstance(size, int) else size
    begin = F.pmod(F.xxhash64(F.lit(seed), *key), F.greatest(F.length(text) - size + 1, F.lit(1)).cast("long"))
    return F.when(F.length(text) <= size, text).otherwise(F.substring(text, begin.cast("int") + 1, size.cast("int")))


def window_size(rows: DataFrame, text: str, label: str, largest: int, most: int) -> int:
    """The largest of ``largest``, half of it, a quarter of it ... with which no label's windows have more than ``most`` characters."""
    sizes = [largest >> k for k in range(largest.bit_length())]
    per_label = rows.groupBy(label).agg(*[F.sum(F.least(F.length(text), F.lit(s))).alias(str(s)) for s in sizes])
    sums = per_label.agg(*[F.max(str(s)).alias(str(s)) for s in sizes]).first()
    return next((s for s in sizes if (sums[str(s)] or 0) <= most), 1)
