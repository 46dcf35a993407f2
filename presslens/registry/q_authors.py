"""Author jobs D8-D11 with J3, J4, J6 and A7 on the articles fixture."""

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import stats as S
from ..operators import clean as N
from ..operators.joins import contains_any
from ..plans import authors as AU
from ..plans import bias
from ..plans import sentiment as SE
from . import duck as D
from . import register
from .q_text import scored_cte

W = fx.sql_with
NORM = W("articles") + ", " + D.normalised_articles_cte() + "\n"
SELECT_TOPICS = ("1-URGENT", "3-MEDIUM")          # fixture topic values
SELECT_AUTHORS = ("Author 1", "Author 2", "Author 3")  # fixture author values
MIN_ARTICLES_FIXTURE = 10  # the fixture has ~25 articles per author; 100 keeps none


def _norm(spark, sf):
    return N.empty_to_null(N.text_null_fix(fx.articles(spark, sf)))


def _base(spark, sf):
    """Analysis input: year 2020 and rows without section dropped."""
    return bias.bias_input(_norm(spark, sf))


BASE = NORM + ", base AS (SELECT * FROM narticles WHERE year IS DISTINCT FROM 2020 AND section IS NOT NULL)\n"


def _round_filter_sql(digits: int | None) -> str:
    r = "CAST(a.n AS DOUBLE) / p.articles_in_publication"
    r = f"round_even({r}, {digits})" if digits is not None else r
    return NORM + f""",
a AS (SELECT author, publication, count(article) AS n FROM narticles
      WHERE NOT contains(lower(author), lower(publication)) GROUP BY 1, 2 HAVING count(article) > 1),
p AS (SELECT publication, count(DISTINCT author) AS authors_in_publication, count(article) AS articles_in_publication
      FROM narticles WHERE publication IS NOT NULL GROUP BY 1)
SELECT a.author, a.publication, a.n AS articles_by_author_for_publication, p.authors_in_publication,
       p.articles_in_publication, {r} AS author_ratio_for_publication
FROM a LEFT JOIN p USING (publication) WHERE {r} > 0.01"""


@register("d8_dense_authors", _round_filter_sql(3))
def d8_dense_authors(spark, sf):
    return AU.dense_authors(_norm(spark, sf), digits=3)


@register("j3_aggregate_join_aggregate", _round_filter_sql(None))
def j3_aggregate_join_aggregate(spark, sf):
    return AU.dense_authors(_norm(spark, sf), digits=None)


def _eligible_sql(threshold: int) -> str:
    return f"""el AS (SELECT author, count(*) AS article_count FROM base WHERE author IS NOT NULL GROUP BY 1
      HAVING count(*) > {threshold}),
eligible AS (SELECT * FROM el WHERE NOT regexp_matches(lower(author), 'staff|media|press|network')
      AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT publication FROM base WHERE publication IS NOT NULL
                                      AND publication <> '') p
                      WHERE contains(lower(el.author), lower(p.publication))))"""


@register("d9_eligible_authors", BASE + ", " + _eligible_sql(100) + "\nSELECT author, article_count FROM eligible")
def d9_eligible_authors(spark, sf):
    return AU.eligible_authors(_base(spark, sf))


@register("d9_eligible_authors_min10", BASE + ", " + _eligible_sql(MIN_ARTICLES_FIXTURE)
          + "\nSELECT author, article_count FROM eligible")
def d9_eligible_authors_min10(spark, sf):
    return AU.eligible_authors(_base(spark, sf), min_articles=MIN_ARTICLES_FIXTURE)


@register("j6_theta_anti_substring", BASE + """
SELECT DISTINCT author FROM base b WHERE author IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM (SELECT DISTINCT publication FROM base WHERE publication IS NOT NULL AND publication <> '') p
  WHERE contains(lower(b.author), lower(p.publication)))""")
def j6_theta_anti_substring(spark, sf):
    b = _base(spark, sf)
    authors = b.select("author").filter(F.col("author").isNotNull()).distinct()
    return contains_any(authors, "author", b.select("publication"), "publication", "left_anti")


@register("j6_theta_semi_substring", BASE + """
SELECT DISTINCT author FROM base b WHERE author IS NOT NULL AND EXISTS (
  SELECT 1 FROM (SELECT DISTINCT publication FROM base WHERE publication IS NOT NULL AND publication <> '') p
  WHERE contains(lower(b.author), lower(p.publication)))""")
def j6_theta_semi_substring(spark, sf):
    """The other side of j6: authors named after a publication."""
    b = _base(spark, sf)
    authors = b.select("author").filter(F.col("author").isNotNull()).distinct()
    return contains_any(authors, "author", b.select("publication"), "publication", "left_semi")


# ---- D10: views over eligible authors' articles -----------------------------

def _eligible_articles(spark, sf):
    base = SE.enrich_text(_base(spark, sf), SE.valence_table(spark))
    authors = AU.eligible_authors(base, min_articles=MIN_ARTICLES_FIXTURE)
    return AU.eligible_author_articles(base, authors)


def _ea_sql():
    return BASE + ", " + scored_cte("base", "sbase") + ", " + _eligible_sql(MIN_ARTICLES_FIXTURE).replace(
        "FROM base WHERE author", "FROM sbase WHERE author") + """,
ea AS (SELECT * FROM sbase WHERE author IN (SELECT author FROM eligible) AND article IS NOT NULL)
"""


@register("j4_left_semi_eligible", lambda: _ea_sql() + "SELECT article_id, author FROM ea")
def j4_left_semi_eligible(spark, sf):
    return _eligible_articles(spark, sf).select("article_id", "author")


@register("d10_authors_per_publication", lambda: _ea_sql()
          + "SELECT publication, count(DISTINCT author) AS authors FROM ea WHERE publication IS NOT NULL GROUP BY 1")
def d10_authors_per_publication(spark, sf):
    return AU.distinct_authors_by(_eligible_articles(spark, sf), "publication")


@register("d10_authors_per_topic", lambda: _ea_sql()
          + "SELECT simple_topic, count(DISTINCT author) AS authors FROM ea WHERE simple_topic IS NOT NULL GROUP BY 1")
def d10_authors_per_topic(spark, sf):
    return AU.distinct_authors_by(_eligible_articles(spark, sf), "simple_topic")


@register("d10_articles_by_author_topic", lambda: _ea_sql()
          + "SELECT author, simple_topic, count(article) AS article FROM ea WHERE simple_topic IS NOT NULL GROUP BY 1, 2")
def d10_articles_by_author_topic(spark, sf):
    return AU.articles_by_author_topic(_eligible_articles(spark, sf))


@register("d10_monthly_topic_sentiment", lambda: _ea_sql() + f"""
SELECT last_day(date) AS date, simple_topic, avg(vader_compound_title) AS avg_sentiment,
       count(article) AS article_count FROM ea
WHERE date IS NOT NULL AND simple_topic IN {SELECT_TOPICS!r} GROUP BY 1, 2""")
def d10_monthly_topic_sentiment(spark, sf):
    return AU.monthly_sentiment_by(_eligible_articles(spark, sf), "simple_topic", SELECT_TOPICS)


@register("d10_monthly_author_sentiment", lambda: _ea_sql() + f"""
SELECT last_day(date) AS date, author, avg(vader_compound_title) AS avg_sentiment,
       count(article) AS article_count FROM ea
WHERE date IS NOT NULL AND author IN {SELECT_AUTHORS!r} GROUP BY 1, 2""")
def d10_monthly_author_sentiment(spark, sf):
    return AU.monthly_sentiment_by(_eligible_articles(spark, sf), "author", SELECT_AUTHORS)


@register("d10_monthly_topic_of_selected_authors", lambda: _ea_sql() + f"""
SELECT last_day(date) AS date, simple_topic, avg(vader_compound_title) AS avg_sentiment,
       count(article) AS article_count FROM ea
WHERE date IS NOT NULL AND simple_topic IS NOT NULL AND author IN {SELECT_AUTHORS!r} GROUP BY 1, 2""")
def d10_monthly_topic_of_selected_authors(spark, sf):
    ea = _eligible_articles(spark, sf).filter(F.col("author").isin(*SELECT_AUTHORS))
    return AU.monthly_sentiment_by(ea, "simple_topic")


# ---- D11: group sentiment ---------------------------------------------------

def _scored_all(spark, sf):
    return SE.enrich_text(_norm(spark, sf), SE.valence_table(spark))


SCORED_ALL = lambda: NORM + ", " + scored_cte("narticles", "sall") + "\n"


@register("d11_publication_sentiment", lambda: SCORED_ALL() + """
SELECT publication, avg(article_textblob_sentiment) AS article_mean, stddev_samp(article_textblob_sentiment) AS article_std,
       avg(vader_compound_title) AS title_mean, stddev_samp(vader_compound_title) AS title_std
FROM sall WHERE publication IS NOT NULL GROUP BY 1""")
def d11_publication_sentiment(spark, sf):
    return AU.group_sentiment(_scored_all(spark, sf), "publication")


@register("d11_author_sentiment", lambda: SCORED_ALL() + """
SELECT author, avg(article_textblob_sentiment) AS article_mean, stddev_samp(article_textblob_sentiment) AS article_std,
       avg(vader_compound_title) AS title_mean, stddev_samp(vader_compound_title) AS title_std,
       count(article) AS article_count
FROM sall WHERE author IS NOT NULL GROUP BY 1 HAVING count(article) > 1""")
def d11_author_sentiment(spark, sf):
    return AU.group_sentiment(_scored_all(spark, sf), "author", min_articles=1)


@register("d11_author_sentiment_rounded", lambda: SCORED_ALL() + """
SELECT author, round_even(round_even(avg(article_textblob_sentiment), 9), 3) AS article_mean,
       round_even(round_even(stddev_samp(article_textblob_sentiment), 9), 3) AS article_std,
       round_even(round_even(avg(vader_compound_title), 9), 3) AS title_mean, round_even(round_even(stddev_samp(vader_compound_title), 9), 3) AS title_std,
       count(article) AS article_count
FROM sall WHERE author IS NOT NULL GROUP BY 1 HAVING count(article) > 1""")
def d11_author_sentiment_rounded(spark, sf):
    """As the analysis shows it: three digits before the count filter."""
    return AU.group_sentiment(_scored_all(spark, sf), "author", min_articles=1, digits=3)


ALL_PUBLICATIONS = tuple(f"src{i}" for i in range(20))  # those of the fixture


@register("g5_monthly_score_pivot", lambda: SCORED_ALL() + "SELECT last_day(date) AS date, " + ", ".join(
    f"round_even(round_even(avg(article_textblob_sentiment) FILTER (WHERE publication = '{p}'), 9), 3) AS {p}" for p in ALL_PUBLICATIONS)
    + " FROM sall WHERE date IS NOT NULL AND publication IS NOT NULL GROUP BY 1")
def g5_monthly_score_pivot(spark, sf):
    """Monthly mean article score, a column for every publication that there is."""
    scored = _scored_all(spark, sf)
    return AU.monthly_score_pivot(scored, "publication", S.pivot_values(scored.filter("date IS NOT NULL"), "publication"))


@register("g5_monthly_score_pivot_all", lambda: SCORED_ALL() + "SELECT last_day(date) AS date, " + ", ".join(
    f"round_even(round_even(avg(article_textblob_sentiment) FILTER (WHERE publication = '{p}'), 9), 3) AS {p}" for p in ALL_PUBLICATIONS)
    + " FROM sall WHERE date IS NOT NULL AND publication IS NOT NULL GROUP BY 1")
def g5_monthly_score_pivot_all(spark, sf):
    """The same with the publications of the fixture stated."""
    return AU.monthly_score_pivot(_scored_all(spark, sf), "publication", ALL_PUBLICATIONS)


@register("a7_mean_std_single_row", lambda: SCORED_ALL() + """
SELECT url, avg(vader_compound_title) AS title_mean, stddev_samp(vader_compound_title) AS title_std
FROM sall WHERE url IS NOT NULL GROUP BY 1""")
def a7_mean_std_single_row(spark, sf):
    """Sample std of a one-row group is null (A7 edge case)."""
    df = _scored_all(spark, sf)
    return df.filter(F.col("url").isNotNull()).groupBy("url").agg(
        F.avg("vader_compound_title").alias("title_mean"), F.stddev_samp("vader_compound_title").alias("title_std"))
