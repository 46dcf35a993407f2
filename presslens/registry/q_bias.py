"""D12-D14 and the polarity predicates on the ``facts`` view."""

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..plans import bias
from ..plans import sentiment as SE
from ..plans import topics as TP
from ..sources.lexicon import read_lexicon
from . import q_topics as Q_TOPICS
from . import register
from .q_text import scored_cte

W = fx.sql_with


def _facts(spark, sf):
    return fx.facts(spark, sf).withColumnRenamed("score", bias.SCORE)


def _pol(spark, sf):
    return (fx.facts(spark, sf)
            .withColumnRenamed("pos", "vader_prob_positive_title")
            .withColumnRenamed("neg", "vader_prob_negative_title")
            .withColumnRenamed("neu", "vader_prob_neutral_title"))


D14_SQL = W("facts") + """,
base AS (SELECT last_day(date) AS m, simple_topic AS t, publication AS p, article, score FROM facts
         WHERE year IS DISTINCT FROM 2020 AND date IS NOT NULL AND simple_topic IS NOT NULL),
pt AS (SELECT m, t, p, count(article) AS n, avg(score) AS a FROM base WHERE p IS NOT NULL GROUP BY 1, 2, 3),
tt AS (SELECT m, t, count(article) AS n, avg(score) AS a FROM base GROUP BY 1, 2),
j AS (SELECT pt.p, pt.t, pt.m, pt.n, CAST(pt.n AS DOUBLE) / tt.n AS pr, pt.a - tt.a AS sr
      FROM pt LEFT JOIN tt ON pt.m = tt.m AND pt.t = tt.t WHERE pt.n > 1)
SELECT p AS publication, t AS simple_topic, m AS date,
       coalesce(sum(n * pr), 0) / sum(n) AS weighted_avg_published_ratio,
       coalesce(sum(n * sr), 0) / sum(n) AS weighted_avg_sentiment_ratio,
       (coalesce(sum(n * pr), 0) / sum(n) + coalesce(sum(n * sr), 0) / sum(n)) / 2 AS bias_score
FROM j GROUP BY 1, 2, 3
"""


@register("d14_bias_score", D14_SQL)
def d14_bias_score(spark, sf):
    return bias.bias_score(_facts(spark, sf))


@register("d14_bias_series", D14_SQL.replace(
    "SELECT p AS publication, t AS simple_topic, m AS date,",
    "SELECT publication, date, avg(bias_score) AS bias_score FROM (SELECT p AS publication, t AS simple_topic, m AS date,"
) + ") s GROUP BY 1, 2")
def d14_bias_series(spark, sf):
    return bias.bias_series(bias.bias_score(_facts(spark, sf)))


@register("d13_topic_sentiment_outliers", W("facts") + """
SELECT simple_topic AS topic, publication, avg(score) AS average_sentiment
FROM facts WHERE year IS DISTINCT FROM 2020 AND simple_topic IS NOT NULL AND publication IS NOT NULL
GROUP BY 1, 2 HAVING avg(score) < -0.25 OR avg(score) > 0.25
""")
def d13_topic_sentiment_outliers(spark, sf):
    return bias.topic_sentiment_outliers(_facts(spark, sf), threshold=0.25)


# The fixture's scores centre on 0, so the 0.25 band is empty there; the
# same job with a 0.01 band exercises the HAVING path on real groups.
@register("d13_topic_sentiment_outliers_band001", W("facts") + """
SELECT simple_topic AS topic, publication, avg(score) AS average_sentiment
FROM facts WHERE year IS DISTINCT FROM 2020 AND simple_topic IS NOT NULL AND publication IS NOT NULL
GROUP BY 1, 2 HAVING avg(score) < -0.01 OR avg(score) > 0.01
""")
def d13_topic_sentiment_outliers_band001(spark, sf):
    return bias.topic_sentiment_outliers(_facts(spark, sf), threshold=0.01)


@register("d12_polarised_share", W("facts") + """,
c AS (SELECT publication, count(*) AS n_all,
             count(CASE WHEN (neg > 0.5 OR pos > 0.5) AND neu < 0.5 THEN 1 END) AS n_pol
      FROM facts WHERE publication IS NOT NULL GROUP BY 1)
SELECT publication, CAST(n_all AS DOUBLE) / (SELECT sum(n_all) FROM c) AS full_ratio,
       CASE WHEN n_pol > 0 THEN CAST(n_pol AS DOUBLE) / (SELECT sum(n_pol) FROM c) END AS polarized_ratio,
       CASE WHEN n_pol > 0 THEN CAST(n_pol AS DOUBLE) / (SELECT sum(n_pol) FROM c) END
         - CAST(n_all AS DOUBLE) / (SELECT sum(n_all) FROM c) AS polarity_ratio_increase
FROM c
""")
def d12_polarised_share(spark, sf):
    return bias.polarised_share_change(_pol(spark, sf))


@register("p9_polarised_negative", W("facts") + """
SELECT article_id, publication, neg, neu FROM facts WHERE neg > 0.5 AND neu < 0.5
""")
def p9_polarised_negative(spark, sf):
    return bias.polarised(_pol(spark, sf), "negative").select(
        "article_id", "publication", F.col("vader_prob_negative_title").alias("neg"),
        F.col("vader_prob_neutral_title").alias("neu"))


TITLE_SURE = "((pos > 0.5 OR neg > 0.5) AND neu < 0.5)"
TEXT_SURE = "(score > 0.15 OR score < -0.15)"


def _mode(spark, sf, mode):
    return bias.polarity_mode(_pol(spark, sf).withColumn("article_textblob_sentiment", F.col("score")), mode).select(
        "article_id", "score")


@register("p10_polarity_strict", W("facts") + f"SELECT article_id, score FROM facts WHERE {TITLE_SURE} AND {TEXT_SURE}")
def p10_polarity_strict(spark, sf):
    return _mode(spark, sf, "strict")


@register("p10_polarity_loose", W("facts") + f"SELECT article_id, score FROM facts WHERE {TITLE_SURE} OR {TEXT_SURE}")
def p10_polarity_loose(spark, sf):
    return _mode(spark, sf, "loose")


@register("p10_polarity_title_only", W("facts") + f"SELECT article_id, score FROM facts WHERE {TITLE_SURE}")
def p10_polarity_title_only(spark, sf):
    return _mode(spark, sf, "title_only")


D12_SQL = """,
c AS (SELECT publication, count(*) AS n_all,
             count(CASE WHEN (neg > 0.5 OR pos > 0.5) AND neu < 0.5 THEN 1 END) AS n_pol
      FROM {src} WHERE publication IS NOT NULL GROUP BY 1),
sh AS (SELECT publication, CAST(n_all AS DOUBLE) / (SELECT sum(n_all) FROM c) AS full_ratio,
       CASE WHEN n_pol > 0 THEN CAST(n_pol AS DOUBLE) / (SELECT sum(n_pol) FROM c) END AS polarized_ratio FROM c)
"""


@register("d12_risen_share", W("facts") + D12_SQL.format(src="facts") + """
SELECT publication, round_even(full_ratio, 2) AS full_ratio, round_even(polarized_ratio, 2) AS polarized_ratio,
       round_even(polarized_ratio - full_ratio, 2) AS polarity_ratio_increase
FROM sh WHERE round_even(polarized_ratio - full_ratio, 2) > 0""")
def d12_risen_share(spark, sf):
    """Rounded to two digits, then the publications whose share has risen."""
    return bias.polarised_share_change(_pol(spark, sf), digits=2).filter(F.col("polarity_ratio_increase") > 0)


@register("d12_risen_share_four_digits", W("facts") + D12_SQL.format(src="facts") + """
SELECT publication, round_even(full_ratio, 4) AS full_ratio, round_even(polarized_ratio, 4) AS polarized_ratio,
       round_even(polarized_ratio - full_ratio, 4) AS polarity_ratio_increase
FROM sh WHERE round_even(polarized_ratio - full_ratio, 4) > 0""")
def d12_risen_share_four_digits(spark, sf):
    """The same with four digits, which the fixture's shares differ in."""
    return bias.polarised_share_change(_pol(spark, sf), digits=4).filter(F.col("polarity_ratio_increase") > 0)


# The jobs in a row, raw articles to bias scores: cleaned sections, topics, sentiment, bias.

def _chain(spark, sf):
    topics, _, _ = TP.topic_job(Q_TOPICS._norm(spark, sf), read_lexicon(spark), TP.places_from_tables(spark, sf))
    return SE.enrich_text(topics, SE.valence_table(spark))


def _chain_sql() -> str:
    return Q_TOPICS._topic_sql() + ", " + scored_cte("topics", "scored") + """,
facts AS (SELECT *, vader_compound_title AS score, vader_prob_positive_title AS pos,
                 vader_prob_negative_title AS neg, vader_prob_neutral_title AS neu FROM scored)
"""


@register("d14_bias_score_from_raw", lambda: _chain_sql() + D14_SQL.removeprefix(W("facts")))
def d14_bias_score_from_raw(spark, sf):
    return bias.bias_score(_chain(spark, sf))


@register("d13_topic_sentiment_from_raw", lambda: _chain_sql() + """
SELECT simple_topic AS topic, publication, avg(score) AS average_sentiment FROM facts
WHERE year IS DISTINCT FROM 2020 AND simple_topic IS NOT NULL AND publication IS NOT NULL
GROUP BY 1, 2 HAVING avg(score) < -0.25 OR avg(score) > 0.25""")
def d13_topic_sentiment_from_raw(spark, sf):
    return bias.topic_sentiment_outliers(_chain(spark, sf))


@register("d12_polarised_share_from_raw", lambda: _chain_sql() + D12_SQL.format(src="facts")
          + "SELECT *, polarized_ratio - full_ratio AS polarity_ratio_increase FROM sh")
def d12_polarised_share_from_raw(spark, sf):
    return bias.polarised_share_change(_chain(spark, sf))
