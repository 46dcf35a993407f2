"""Section and corpus summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stats import month_end, monthly_gap_filled, non_null, value_counts


def section_publication_spread(df: DataFrame) -> DataFrame:
    """Per section, distinct publications and whether it is shared
    across publications (A8)."""
    return non_null(df, ["section"]).groupBy("section").agg(
        F.countDistinct("publication").alias("publications")
    ).withColumn("cross_publication", F.col("publications") > 1)


def section_class_shares(df: DataFrame) -> DataFrame:
    """D15 (A16): article and section counts and article shares of
    cross-publication vs single-publication sections.

    One aggregate per section gives both its rows and its distinct
    publications; sections with zero non-null publications belong to
    neither class but count in the denominator, as in the analysis. The
    total is a window over the class table, which has at most 3 rows.
    """
    per_section = non_null(df, ["section"]).groupBy("section").agg(
        F.count(F.lit(1)).alias("_rows"), F.countDistinct("publication").alias("_pubs"))
    cls = F.when(F.col("_pubs") > 1, "cross").when(F.col("_pubs") == 1, "single")
    by_class = per_section.groupBy(cls.alias("section_class")).agg(
        F.count(F.lit(1)).alias("sections"), F.sum("_rows").alias("articles"))
    share = F.col("articles") / F.sum("articles").over(Window.partitionBy())
    return by_class.withColumn("article_share", share).filter(F.col("section_class").isNotNull())


def cross_section_publication_counts(df: DataFrame) -> DataFrame:
    """Article counts per (section, publication) for cross-publication
    sections (J4 semi join + A5)."""
    base = non_null(df, ["section"])
    cross = section_publication_spread(base).filter("cross_publication").select("section")
    return non_null(base.join(cross, "section", "left_semi"), ["publication"]) \
        .groupBy("section", "publication").agg(F.count("article").alias("article_count"))


def spike_sections(df: DataFrame, year: int, months: Sequence[int] = (5, 6, 7, 8)) -> DataFrame:
    """Sections seen in ``months`` of ``year`` but in none of its other
    months, with their count. One pass with conditional counts replaces
    the two frequency tables and the anti join."""
    in_spike = F.col("month").isin(*months)
    return (
        non_null(df.filter(F.col("year") == year), ["section"])
        .groupBy("section")
        .agg(F.count(F.when(in_spike, 1)).alias("count"),
             F.count(F.when(~in_spike, 1)).alias("_rest"))
        .filter((F.col("count") > 0) & (F.col("_rest") == 0))
        .drop("_rest")
    )


def spike_sections_anti(df: DataFrame, year: int, months: Sequence[int] = (5, 6, 7, 8)) -> DataFrame:
    """J5/U2 form of D16: spike-month frequency table anti-joined with the
    rest of the year's sections."""
    y = non_null(df.filter(F.col("year") == year), ["section"])
    spike = value_counts(y.filter(F.col("month").isin(*months)), "section")
    rest = y.filter(~F.col("month").isin(*months)).select("section")
    return spike.join(rest, "section", "left_anti")


def monthly_article_counts(df: DataFrame) -> DataFrame:
    """D17 (G1): non-null articles per month, empty months as 0."""
    return monthly_gap_filled(df, [F.count("article").alias("article_count")], fill={"article_count": 0})


def monthly_section_stats(df: DataFrame) -> DataFrame:
    """Sections per month (count and distinct), gap-filled."""
    return monthly_gap_filled(
        df, [F.count("section").alias("section_count"), F.countDistinct("section").alias("distinct_sections")],
        fill={"section_count": 0, "distinct_sections": 0})


def counts_by(df: DataFrame, key: str) -> DataFrame:
    """D17 (G4): frequency by year / day of month, key-ordered."""
    return value_counts(df, key).orderBy(key)


def publication_month_pivot(df: DataFrame, publications: Sequence[str] | None,
                            exclude_publication: str | None = None, exclude_year: int | None = None) -> DataFrame:
    """D17 (G5): monthly non-null article counts with one column per
    publication. Pass the values when known; otherwise Spark finds the
    distinct publications with one extra aggregate pass."""
    base = df
    if exclude_publication is not None:
        base = base.filter(~F.col("publication").eqNullSafe(exclude_publication))
    if exclude_year is not None:
        base = base.filter(~F.col("year").eqNullSafe(exclude_year))
    base = non_null(base, ["date", "publication"])
    values = list(publications) if publications is not None else None
    return base.groupBy(month_end("date").alias("date")).pivot("publication", values) \
        .agg(F.count("article"))
