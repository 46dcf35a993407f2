"""Author concentration, eligibility and group sentiment."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import contains_any
from ..operators.stats import month_end, non_null

# Generic author words and eligibility threshold.
GENERIC_AUTHOR_WORDS = ("staff", "media", "press", "network")
AUTHOR_MIN_ARTICLES = 100


def generic_author(col: str = "author", words: Sequence[str] = GENERIC_AUTHOR_WORDS):
    """P5: case-insensitive substring match of any generic word."""
    low = F.lower(F.col(col))
    return F.coalesce(reduce(or_, [low.contains(w.lower()) for w in words]), F.lit(False)) if words else F.lit(False)


def not_named_after_publication(author: str = "author", publication: str = "publication"):
    """The author's name does not contain its publication's name; a null
    on either side drops the row."""
    return ~F.lower(F.col(author)).contains(F.lower(F.col(publication)))


def dense_authors(df: DataFrame, digits: int | None = 3, min_ratio: float = 0.01) -> DataFrame:
    """Authors with more than one article in a publication whose share
    of that publication's articles exceeds ``min_ratio``.

    Publication totals (distinct authors, non-null articles) come from all
    rows; authors named after their publication are left out of the
    numerator only. With ``digits`` the numbers are rounded half-even
    before the ratio filter, as the analysis does.
    """
    per_author = (
        df.filter(not_named_after_publication())
        .groupBy("author", "publication")
        .agg(F.count("article").alias("articles_by_author_for_publication"))
        .filter(F.col("articles_by_author_for_publication") > 1)
    )
    per_pub = non_null(df, ["publication"]).groupBy("publication").agg(
        F.countDistinct("author").alias("authors_in_publication"),
        F.count("article").alias("articles_in_publication"),
    )
    ratio = F.col("articles_by_author_for_publication") / F.col("articles_in_publication")
    if digits is not None:
        ratio = F.bround(ratio, digits)
    out = per_author.join(per_pub, "publication", "left").withColumn("author_ratio_for_publication", ratio)
    return out.filter(F.col("author_ratio_for_publication") > min_ratio)


def eligible_authors(df: DataFrame, min_articles: int = AUTHOR_MIN_ARTICLES,
                     words: Sequence[str] = GENERIC_AUTHOR_WORDS) -> DataFrame:
    """(author, article_count) with more than ``min_articles`` rows, no
    generic word, and no publication name inside the author name."""
    counts = non_null(df, ["author"]).groupBy("author").agg(F.count(F.lit(1)).alias("article_count"))
    kept = counts.filter((F.col("article_count") > min_articles) & ~generic_author("author", words))
    return contains_any(kept, "author", df.select("publication"), "publication", how="left_anti")


def eligible_author_articles(df: DataFrame, authors: DataFrame) -> DataFrame:
    """D10 input: articles of eligible authors with a non-null article."""
    return df.join(authors.select("author"), "author", "left_semi").filter(F.col("article").isNotNull())


def distinct_authors_by(df: DataFrame, key: str) -> DataFrame:
    """Distinct eligible authors per publication / per topic."""
    return non_null(df, [key]).groupBy(key).agg(F.countDistinct("author").alias("authors"))


def articles_by_author_topic(df: DataFrame) -> DataFrame:
    """Articles per author x topic (A5)."""
    return non_null(df, ["author", "simple_topic"]).groupBy("author", "simple_topic") \
        .agg(F.count("article").alias("article"))


def monthly_sentiment_by(df: DataFrame, key: str, values: Sequence[str] | None = None,
                         score: str = "vader_compound_title") -> DataFrame:
    """Monthly mean score (and article count) per key, optionally for
    selected key values (G2)."""
    base = non_null(df, ["date", key])
    if values is not None:
        base = base.filter(F.col(key).isin(*values))
    return base.groupBy(month_end("date").alias("date"), key).agg(
        F.avg(score).alias("avg_sentiment"), F.count("article").alias("article_count"))


def _shown(x, digits: int):
    """Rounded half-even. Nine decimals first: means of the same rows, summed
    in another order, must not fall on either side of a half-way point."""
    return F.bround(F.bround(x, 9), digits)


def monthly_score_pivot(df: DataFrame, key: str, values: Sequence[str], score: str = "article_textblob_sentiment",
                        digits: int | None = 3) -> DataFrame:
    """D11 (G5): monthly mean score with a column per given value of ``key``."""
    base = non_null(df, ["date", key])
    mean = F.avg(score)
    out = base.groupBy(month_end("date").alias("date")).pivot(key, list(values)).agg(
        mean if digits is None else _shown(mean, digits))
    return out


def group_sentiment(df: DataFrame, key: str, text_score: str = "article_textblob_sentiment",
                    title_score: str = "vader_compound_title", min_articles: int | None = None,
                    digits: int | None = None) -> DataFrame:
    """D11 (A7 + A10): mean and sample std of both scores per key, rounded
    half-even to ``digits``; with ``min_articles`` only keys with more non-null
    articles are kept."""
    aggs = [
        F.avg(text_score).alias("article_mean"), F.stddev_samp(text_score).alias("article_std"),
        F.avg(title_score).alias("title_mean"), F.stddev_samp(title_score).alias("title_std"),
    ]
    if digits is not None:
        aggs = [_shown(a, digits).alias(n) for a, n in
                zip(aggs, ("article_mean", "article_std", "title_mean", "title_std"))]
    if min_articles is not None:
        aggs.append(F.count("article").alias("article_count"))
    out = non_null(df, [key]).groupBy(key).agg(*aggs)
    if min_articles is not None:
        out = out.filter(F.col("article_count") > min_articles)
    return out
