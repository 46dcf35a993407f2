"""Section and corpus summaries D15-D17 (with J5, U2, A16)."""

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import clean as N
from ..operators import stats as S
from ..plans import sections as SEC
from . import duck as D
from . import register

W = fx.sql_with
NORM = W("articles") + ", " + D.normalised_articles_cte() + "\n"
EDA = NORM + ", " + D.clean_sections_cte("narticles", "eda", case_first=False, generic=False) + "\n"
PIVOT_PUBLICATIONS = tuple(sorted(f"src{i}" for i in range(1, 20)))  # those of the fixture but src0
SPIKE_YEAR = 1996  # a year inside the fixture's date range


def _norm(spark, sf):
    return N.empty_to_null(N.text_null_fix(fx.articles(spark, sf)))


def _eda(spark, sf):
    return N.clean_sections(_norm(spark, sf), case_first=False, generic=None)


@register("d15_section_publication_spread", EDA + """
SELECT section, count(DISTINCT publication) AS publications, count(DISTINCT publication) > 1 AS cross_publication
FROM eda GROUP BY 1""")
def d15_section_publication_spread(spark, sf):
    return SEC.section_publication_spread(_eda(spark, sf))


@register("a16_section_class_shares", EDA + """,
s AS (SELECT section, count(*) AS r, count(DISTINCT publication) AS p FROM eda GROUP BY 1),
c AS (SELECT CASE WHEN p > 1 THEN 'cross' WHEN p = 1 THEN 'single' END AS section_class,
             count(*) AS sections, CAST(sum(r) AS BIGINT) AS articles FROM s GROUP BY 1)
SELECT section_class, sections, articles, CAST(articles AS DOUBLE) / (SELECT sum(articles) FROM c) AS article_share
FROM c WHERE section_class IS NOT NULL""")
def a16_section_class_shares(spark, sf):
    return SEC.section_class_shares(_eda(spark, sf))


@register("d15_cross_section_publication_counts", EDA + """,
cross_s AS (SELECT section FROM eda GROUP BY 1 HAVING count(DISTINCT publication) > 1)
SELECT section, publication, count(article) AS article_count FROM eda
WHERE section IN (SELECT section FROM cross_s) AND publication IS NOT NULL GROUP BY 1, 2""")
def d15_cross_section_publication_counts(spark, sf):
    return SEC.cross_section_publication_counts(_eda(spark, sf))


@register("d15_monthly_section_stats", EDA + """,
m AS (SELECT last_day(date) AS date, count(section) AS section_count, count(DISTINCT section) AS distinct_sections
      FROM eda WHERE date IS NOT NULL GROUP BY 1),
cal AS (SELECT last_day(CAST(d AS DATE)) AS date FROM (SELECT min(date) AS lo, max(date) AS hi FROM m),
        range(date_trunc('month', lo), hi + INTERVAL 1 DAY, INTERVAL 1 MONTH) t(d))
SELECT cal.date, coalesce(section_count, 0) AS section_count, coalesce(distinct_sections, 0) AS distinct_sections
FROM cal LEFT JOIN m USING (date)""")
def d15_monthly_section_stats(spark, sf):
    return SEC.monthly_section_stats(_eda(spark, sf))


def _spike_sql(src: str) -> str:
    return f"""
SELECT section, count(*) FILTER (WHERE month IN (5, 6, 7, 8)) AS count FROM {src}
WHERE year = {SPIKE_YEAR} AND section IS NOT NULL GROUP BY 1
HAVING count(*) FILTER (WHERE month IN (5, 6, 7, 8)) > 0 AND count(*) FILTER (WHERE month NOT IN (5, 6, 7, 8)) = 0"""


@register("d16_spike_sections", EDA + _spike_sql("eda"))
def d16_spike_sections(spark, sf):
    return SEC.spike_sections(_eda(spark, sf), SPIKE_YEAR)


@register("d16_spike_sections_uncleaned", NORM + _spike_sql("narticles"))
def d16_spike_sections_uncleaned(spark, sf):
    """Same job before the singleton nullify (planted one-off sections show)."""
    return SEC.spike_sections(_norm(spark, sf), SPIKE_YEAR)


@register("j5_left_anti_spike", NORM + f"""
SELECT section, count(*) AS count FROM narticles
WHERE year = {SPIKE_YEAR} AND month IN (5, 6, 7, 8) AND section IS NOT NULL
  AND section NOT IN (SELECT section FROM narticles WHERE year = {SPIKE_YEAR} AND month NOT IN (5, 6, 7, 8)
                      AND section IS NOT NULL)
GROUP BY 1""")
def j5_left_anti_spike(spark, sf):
    return SEC.spike_sections_anti(_norm(spark, sf), SPIKE_YEAR)


@register("d17_monthly_article_counts", NORM + """,
m AS (SELECT last_day(date) AS date, count(article) AS article_count FROM narticles WHERE date IS NOT NULL GROUP BY 1),
cal AS (SELECT last_day(CAST(d AS DATE)) AS date FROM (SELECT min(date) AS lo, max(date) AS hi FROM m),
        range(date_trunc('month', lo), hi + INTERVAL 1 DAY, INTERVAL 1 MONTH) t(d))
SELECT cal.date, coalesce(article_count, 0) AS article_count FROM cal LEFT JOIN m USING (date)""")
def d17_monthly_article_counts(spark, sf):
    return SEC.monthly_article_counts(_norm(spark, sf))


@register("d17_top_author_shares", NORM + """
SELECT author, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share FROM narticles
WHERE author IS NOT NULL GROUP BY 1 ORDER BY share DESC, author LIMIT 20""")
def d17_top_author_shares(spark, sf):
    return S.ordered_top(S.value_counts(_norm(spark, sf), "author", normalize=True),
                         [F.desc("share"), F.asc("author")], 20)


@register("d17_top_section_shares", NORM + """
SELECT section, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share FROM narticles
WHERE section IS NOT NULL GROUP BY 1 ORDER BY share DESC, section LIMIT 30""")
def d17_top_section_shares(spark, sf):
    return S.ordered_top(S.value_counts(_norm(spark, sf), "section", normalize=True),
                         [F.desc("share"), F.asc("section")], 30)


@register("d17_publication_pivot_filtered", NORM + """,
b AS (SELECT last_day(date) AS date, publication, count(article) AS n FROM narticles
      WHERE publication IS DISTINCT FROM 'src0' AND year IS DISTINCT FROM 1999 AND date IS NOT NULL
        AND publication IS NOT NULL GROUP BY 1, 2)
SELECT date, """ + ", ".join(f"max(n) FILTER (WHERE publication = '{p}') AS {p}" for p in PIVOT_PUBLICATIONS)
          + " FROM b GROUP BY 1")
def d17_publication_pivot_filtered(spark, sf):
    """A column for each publication that there is but the one left out."""
    base = _norm(spark, sf)
    kept = [p for p in S.pivot_values(base, "publication") if p != "src0"]
    return SEC.publication_month_pivot(base, kept, exclude_publication="src0", exclude_year=1999)
