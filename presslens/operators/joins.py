"""Join helpers (J1-J9) that need more than a one-line ``join``.

All are equi-joins; AQE picks the physical strategy from runtime statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contains_any(haystack: DataFrame, hay_col: str, needles: DataFrame, needle_col: str,
                 how: str = "left_anti") -> DataFrame:
    """Keep (``left_semi``) or drop (``left_anti``) rows whose
    ``hay_col`` contains, case-insensitively, any value of ``needle_col``.

    Every distinct haystack value is cut into its substrings of the lengths
    that occur among the needles, and these meet the needles in an equi-join:
    exact, at any number of needles, without a nested loop. Haystack values
    are names (short strings), so a value has a few dozen substrings a length.
    """
    n = needles.select(F.lower(F.col(needle_col)).alias("_needle")) \
        .filter(F.col("_needle").isNotNull() & (F.col("_needle") != "")).distinct()
    # at most one entry per length of a name
    lengths = n.agg(F.array_sort(F.collect_set(F.char_length("_needle"))).alias("l")).scalar()
    hay = haystack.select(F.col(hay_col).alias("_hay")).filter(F.col("_hay").isNotNull()).distinct()
    low = hay.select("_hay", F.lower("_hay").alias("_low"), F.explode(lengths).alias("_len")) \
        .filter(F.col("_len") <= F.char_length("_low"))
    subs = low.select("_hay", F.explode(F.transform(
        F.sequence(F.lit(1), F.char_length("_low") - F.col("_len") + 1),
        lambda i: F.col("_low").substr(i, F.col("_len")))).alias("_sub"))
    hits = subs.join(n, subs["_sub"] == n["_needle"], "left_semi").select("_hay").distinct()
    return haystack.join(hits, haystack[hay_col] == hits["_hay"], how)


def align(left: DataFrame, right: DataFrame, key: str, how: str = "full_outer") -> DataFrame:
    """Align two per-key distributions; the key is coalesced."""
    j = left.alias("l").join(right.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"), how)
    rest = [F.col(f"l.{c}") for c in left.columns if c != key] + \
           [F.col(f"r.{c}") for c in right.columns if c != key]
    return j.select(F.coalesce(F.col(f"l.{key}"), F.col(f"r.{key}")).alias(key), *rest)
