"""Aggregations, time buckets and ranking helpers (A*, G*, O*, W1).

All grouping keys are filtered to non-null first where the analysis drops
missing keys (pandas ``groupby``/``value_counts`` semantics, SURVEY §1.1).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import rank


def month_end(col: str | Column = "date") -> Column:
    """Monthly label as the last day of the month (pandas ``freq='M'``)."""
    return F.last_day(F.col(col) if isinstance(col, str) else col)


def non_null(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df if cond is None else df.filter(cond)


def with_share(df: DataFrame, count_col: str, out: str = "share", scale: float = 1.0) -> DataFrame:
    """Add ``count / sum(count)``; the total is a scalar subquery over the
    (aggregated, small) input, so no single-partition window is needed."""
    total = df.select(F.sum(count_col)).scalar()
    return df.withColumn(out, F.col(count_col) * F.lit(float(scale)) / total)


def value_counts(df: DataFrame, key: str | Sequence[str], normalize: bool = False, scale: float = 1.0,
                 count_name: str = "count", share_name: str = "share") -> DataFrame:
    """A1/A2: frequency of each non-null value (or value combination); with
    ``normalize`` the share of all non-null rows instead of the count."""
    keys = [key] if isinstance(key, str) else list(key)
    counts = non_null(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(count_name))
    if not normalize:
        return counts
    return with_share(counts, count_name, share_name, scale).drop(count_name)


def ordered_top(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """O2/O3: top-k rows by an explicit, tie-broken ordering."""
    return df.orderBy(*order).limit(k)


def mode_first_seen(df: DataFrame, key: str, value: str, position: str,
                    out: str = "mode") -> DataFrame:
    """Most frequent value per key; ties go to the earliest position.

    ``position`` orders occurrences (e.g. the lexicon order of a topic).
    One aggregate at (key, value) grain, then a per-key ranking of the
    aggregated rows (at most one row per distinct value).
    """
    counted = df.groupBy(key, value).agg(
        F.count(F.lit(1)).alias("_n"), F.min(position).alias("_first"))
    best = counted.groupBy(key).agg(
        F.max_by(F.col(value), F.struct(F.col("_n"), -F.col("_first"))).alias(out))
    return best


def weighted_mean(weight: str | Column, value: str | Column) -> Column:
    """sum(w*x)/sum(w); a missing x adds nothing to the numerator."""
    w = F.col(weight) if isinstance(weight, str) else weight
    x = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(w * x), F.lit(0.0)) / F.sum(w)


def month_calendar(df: DataFrame, date_col: str = "date", out: str = "date") -> DataFrame:
    """Every month end between the first and last month of ``date_col``.

    Built from one global min/max row; the sequence holds one element per
    month of the range, independent of the data volume.
    """
    bounds = df.agg(F.min(month_end(date_col)).alias("lo"), F.max(month_end(date_col)).alias("hi"))
    return bounds.select(
        F.explode(
            F.expr("transform(sequence(0, CAST(months_between(hi, lo) AS INT)), i -> last_day(add_months(lo, i)))")
        ).alias(out)
    ).filter(F.col(out).isNotNull())


def monthly_gap_filled(df: DataFrame, aggs: Sequence[Column], date_col: str = "date",
                       fill: dict | None = None, out: str = "date") -> DataFrame:
    """G1: month as the only key, empty months present (counts 0, means null)."""
    per_month = df.filter(F.col(date_col).isNotNull()).groupBy(month_end(date_col).alias(out)).agg(*aggs)
    cal = month_calendar(df, date_col, out)
    res = cal.join(per_month, out, "left")
    return res.fillna(fill) if fill else res


def first_appearance_ids(df: DataFrame, key: str, date_col: str = "date", tiebreak: str = "article_id",
                         out: str = "key_id") -> DataFrame:
    """Number keys 0.. in order of their first appearance in time.

    One row per distinct key (an aggregate) is numbered like G9, so no task
    ranks all keys.
    """
    firsts = non_null(df, [key]).groupBy(key).agg(
        F.min(F.struct(F.col(date_col).isNull().alias("undated"), F.col(date_col).alias("d"),
                       F.col(tiebreak).alias("t"))).alias("_first"))
    flat = firsts.select(key, F.col("_first.undated").alias("_u"), F.col("_first.d").alias("_d"), F.col("_first.t").alias("_t"))
    numbered = dense_row_number(flat, ["_u", "_d", "_t", key], out)
    return numbered.select(key, (F.col(out) - 1).cast("bigint").alias(out))


def range_numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str,
                   partitions: int | None = None) -> DataFrame:
    """Numbers 1..n in ``order`` within each ``group`` (all rows without one)
    and without a task that holds a whole group: rows are range-partitioned,
    numbered inside each partition and moved up by the rows of the group in
    earlier partitions.

    The partitioned rows are written once (``session.materialize``): the
    bounds of a range exchange are sampled, so two exchanges of the same rows
    may cut them differently, and both the numbers and the offsets must see
    the same cut.
    """
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    keys = ["_pid", *group]
    cut = materialize(df.repartitionByRange(n, *group, *order).withColumn("_pid", F.spark_partition_id()))
    sizes = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # a row per partition (and group)
    offsets = sizes.select(*keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"))
    local = cut.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return local.join(offsets, keys).withColumn(out, (F.col("_off") + F.col("_place")).cast("bigint")) \
        .drop("_pid", "_place", "_off")


def dense_row_number(df: DataFrame, order: Sequence[str], out: str = "row_id",
                     partitions: int | None = None) -> DataFrame:
    """Consecutive numbers 1..N in ``order`` without a single-partition window."""
    return range_numbered(df, [], order, out, partitions)


def _seeded(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows (all if there are fewer) by a seeded hash of ``key``;
    the same in every run and in any partitioning. Rows of one key are told
    apart by a hash of their columns. Nothing is sorted (``rank``)."""
    if n <= 0:
        return df.limit(0)
    columns = [c for c, t in df.dtypes if "map<" not in t and t != "variant"]
    row = F.lower(F.lpad(F.hex(F.xxhash64(*columns)), 16, "0"))
    return rank.first_by_hash(df, [(_seeded(key, seed), 32), (row, 16)], n)


def sample_fraction(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """About ``fraction`` of the rows by a seeded hash of ``key``."""
    h = F.conv(F.substring(_seeded(key, seed), 1, 13), 16, 10).cast("bigint")
    return df.filter(h < F.lit(fraction * 2.0 ** 52))


def pivot_values(df: DataFrame, col: str, most: int = 10_000) -> list[str]:
    """The columns that a pivot over ``col`` makes: its distinct values, in
    order. They become columns, so there can't be more than ``most``."""
    found = [r[0] for r in df.select(col).filter(F.col(col).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{col} has more than {most} values to make columns of")
    return sorted(found)


def hierarchy_counts(df: DataFrame, levels: Sequence[str], label: str | None = None) -> DataFrame:
    """Counts at every level of a hierarchy (``rollup``), with the
    label of a node when all its rows share one label."""
    base = non_null(df, list(levels))
    aggs = [F.count(F.lit(1)).alias("count")]
    if label:
        aggs += [F.countDistinct(label).alias("_nl"), F.max(label).alias("_l")]
    out = base.rollup(*levels).agg(*aggs, F.grouping_id().cast("bigint").alias("level"))
    out = out.filter(F.col("level") < (1 << len(levels)) - 1)  # drop the grand total
    if label:
        out = out.withColumn(label, F.when(F.col("_nl") == 1, F.col("_l"))).drop("_nl", "_l")
    return out


def mean_median(df: DataFrame, cols: Sequence[str], null_as: float | None = 0,
                approx: bool = False, accuracy: int = 10_000) -> DataFrame:
    """A4: mean and median of each column (nulls counted as ``null_as``).
    The median is exact, found by narrowing brackets (``rank.exact_medians``);
    ``approx=True`` takes the sketch's word for it."""
    named = df.select(*[(F.coalesce(F.col(c), F.lit(null_as)) if null_as is not None else F.col(c)).alias(c) for c in cols])
    if approx:
        return named.agg(*[x for c in cols for x in (
            F.avg(c).alias(f"{c}_mean"), F.percentile_approx(c, 0.5, accuracy).alias(f"{c}_median"))])
    named = materialize(named)
    medians = rank.exact_medians(named, cols)
    means = named.agg(*[F.avg(c).alias(f"{c}_mean") for c in cols])
    return means.select(*[x for c in cols for x in (
        f"{c}_mean", F.lit(medians[c]).cast("double").alias(f"{c}_median"))])


def distinct_count(col: str, approx: bool = False, rsd: float = 0.01) -> Column:
    """Exact distinct count, or HyperLogLog++ with relative error ``rsd``."""
    return F.approx_count_distinct(col, rsd) if approx else F.countDistinct(col)
