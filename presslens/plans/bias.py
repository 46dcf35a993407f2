"""Publication bias and sentiment comparisons.

D14 aggregates the article table exactly once, at the finest grain
(month, topic, publication), keeping sums and counts; the topic totals are
rolled up from that small result, so the fact table is shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stats import month_end, non_null, weighted_mean, with_share

SCORE = "vader_compound_title"


def bias_input(df: DataFrame, exclude_year: int | None = 2020) -> DataFrame:
    """Step 1: drop one year (null years are kept, pandas ``!=``) and rows
    without a section."""
    out = df
    if exclude_year is not None:
        out = out.filter(~F.col("year").eqNullSafe(exclude_year))
    if "section" in df.columns:
        out = out.filter(F.col("section").isNotNull())
    return out


def publication_topic_month(df: DataFrame, score: str = SCORE) -> DataFrame:
    """Finest grain (month, topic, publication): article count, score sum
    and score count. Rows with a null publication form their own group:
    they count towards the topic totals but never appear as a publication."""
    keyed = non_null(df.select(month_end("date").alias("date"), "simple_topic", "publication",
                               "article", F.col(score).alias("_s")),
                     ["date", "simple_topic"])
    return keyed.groupBy("date", "simple_topic", "publication").agg(
        F.count("article").alias("n_p"),
        F.sum("_s").alias("s_p"),
        F.count("_s").alias("c_p"),
    )


def bias_score(df: DataFrame, score: str = SCORE,
               grain: Sequence[str] = ("publication", "simple_topic", "date"),
               exclude_year: int | None = 2020, min_articles: int = 1) -> DataFrame:
    """Per (publication, topic, month) the weighted published ratio,
    weighted sentiment difference and their mean, the bias score.

    ``grain`` may be coarser than the natural (publication, topic, month)
    grain; weights are the publication's article counts. The article table
    is aggregated (and shuffled) once; both P and the topic totals T come
    from that result.
    """
    fine = publication_topic_month(bias_input(df, exclude_year), score)
    # topic totals T as a window over the fine aggregate: one row per
    # publication in each (month, topic) partition, so no second pass over
    # the articles and no join back
    tw = Window.partitionBy("date", "simple_topic")
    joined = (
        fine.select("*", F.sum("n_p").over(tw).alias("n_t"), F.sum("s_p").over(tw).alias("s_t"),
                    F.sum("c_p").over(tw).alias("c_t"))
        .filter(F.col("publication").isNotNull() & (F.col("n_p") > min_articles))
        .select(
            "publication", "simple_topic", "date", "n_p",
            (F.col("n_p") / F.col("n_t")).alias("published_ratio"),
            (F.col("s_p") / F.col("c_p") - F.col("s_t") / F.col("c_t")).alias("sentiment_ratio"),
        )
    )
    return joined.groupBy(*grain).agg(
        weighted_mean("n_p", "published_ratio").alias("weighted_avg_published_ratio"),
        weighted_mean("n_p", "sentiment_ratio").alias("weighted_avg_sentiment_ratio"),
    ).withColumn(
        "bias_score",
        (F.col("weighted_avg_published_ratio") + F.col("weighted_avg_sentiment_ratio")) / 2,
    )


def bias_series(scores: DataFrame) -> DataFrame:
    """D14 step 6: mean bias score by publication and month."""
    return scores.groupBy("publication", month_end("date").alias("date")).agg(
        F.avg("bias_score").alias("bias_score"))


def topic_sentiment_outliers(df: DataFrame, score: str = SCORE, threshold: float = 0.25,
                             exclude_year: int | None = 2020) -> DataFrame:
    """Mean title score per topic x publication with |mean| > threshold."""
    base = non_null(bias_input(df, exclude_year), ["simple_topic", "publication"])
    return (
        base.groupBy(F.col("simple_topic").alias("topic"), "publication")
        .agg(F.avg(score).alias("average_sentiment"))
        .filter((F.col("average_sentiment") < -threshold) | (F.col("average_sentiment") > threshold))
    )


def polarised(df: DataFrame, sign: str, pos: str = "vader_prob_positive_title",
              neg: str = "vader_prob_negative_title", neu: str = "vader_prob_neutral_title",
              cut: float = 0.5) -> DataFrame:
    """Titles dominated by one polarity and not neutral."""
    col = neg if sign == "negative" else pos
    return df.filter((F.col(col) > cut) & (F.col(neu) < cut))


def polarity_mode(df: DataFrame, mode: str = "title_only", text_score: str = "article_textblob_sentiment",
                  pos: str = "vader_prob_positive_title", neg: str = "vader_prob_negative_title",
                  neu: str = "vader_prob_neutral_title", title_cut: float = 0.5, text_cut: float = 0.15) -> DataFrame:
    """P10: polarised rows. The title model is sure if the positive or the
    negative share is over ``title_cut`` and the neutral one below it; the
    text model if the article's score is beyond ``text_cut`` on either side.
    ``strict`` asks for both, ``loose`` for either, ``title_only`` (P9) for
    the title."""
    title = ((F.col(pos) > title_cut) | (F.col(neg) > title_cut)) & (F.col(neu) < title_cut)
    text = (F.col(text_score) > text_cut) | (F.col(text_score) < -text_cut)
    modes = {"strict": title & text, "loose": title | text, "title_only": title}
    if mode not in modes:
        raise ValueError(mode)
    return df.filter(modes[mode])


def polarised_share_change(df: DataFrame, key: str = "publication",
                           pos: str = "vader_prob_positive_title", neg: str = "vader_prob_negative_title",
                           neu: str = "vader_prob_neutral_title", digits: int | None = None) -> DataFrame:
    """Share of each publication among polarised titles (negative or
    positive, P9) minus its share among all titles, aligned on the key.

    The two polarity sets are disjoint (the three shares sum to 1), so one
    OR filter replaces their union and a single aggregate gives both counts.
    A key without polarised titles has a null polarised share (outer align).
    With ``digits`` the shares and their difference are rounded half-even, as
    the analysis does before it keeps the risen ones (``> 0``).
    """
    cond = ((F.col(neg) > 0.5) | (F.col(pos) > 0.5)) & (F.col(neu) < 0.5)
    counts = non_null(df, [key]).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count(F.when(cond, 1)).alias("n_pol"),
    )
    shares = with_share(with_share(counts, "n_all", "full_ratio"), "n_pol", "_pol")
    pol = F.when(F.col("n_pol") > 0, F.col("_pol"))
    def shown(x):
        return x if digits is None else F.bround(x, digits)
    return shares.select(
        key, shown(F.col("full_ratio")).alias("full_ratio"), shown(pol).alias("polarized_ratio"),
        shown(pol - F.col("full_ratio")).alias("polarity_ratio_increase"),
    )
