"""Aggregations (A*), time grouping and reshape (G*), joins (J1-J8),
sort/limit (O*), set operations (U*) and W1 on the fixture views."""

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import text as X
from ..operators import stats as S
from ..operators.joins import align
from ..plans import bias
from . import duck as D
from . import register

W = fx.sql_with
A = fx.articles
FA = fx.facts
NORM = W("articles") + ", " + D.normalised_articles_cte() + "\n"


def _norm(spark, sf):
    from ..operators import clean as N
    return N.empty_to_null(N.text_null_fix(A(spark, sf)))


# ---- A ---------------------------------------------------------------------

@register("a1_value_counts", NORM + """
SELECT section, count(*) AS count FROM narticles WHERE section IS NOT NULL GROUP BY 1""")
def a1_value_counts(spark, sf):
    return S.value_counts(_norm(spark, sf), "section")


@register("a2_value_counts_share", NORM + """
SELECT publication, 100.0 * count(*) / sum(count(*)) OVER () AS share
FROM narticles WHERE publication IS NOT NULL GROUP BY 1""")
def a2_value_counts_share(spark, sf):
    return S.value_counts(_norm(spark, sf), "publication", normalize=True, scale=100.0)


@register("a3_global_sums", W("articles") + f"""
SELECT CAST(sum(length(title)) AS BIGINT) AS title_chars, CAST(sum(length(article)) AS BIGINT) AS article_chars,
       CAST(sum({D.word_count('title')}) AS BIGINT) AS title_words,
       CAST(sum({D.word_count('article')}) AS BIGINT) AS article_words FROM articles""")
def a3_global_sums(spark, sf):
    a = A(spark, sf)
    return a.agg(F.sum(X.char_count("title")).alias("title_chars"), F.sum(X.char_count("article")).alias("article_chars"),
                 F.sum(X.word_count("title")).alias("title_words"), F.sum(X.word_count("article")).alias("article_words"))


@register("a4_mean_median", W("articles") + f"""
SELECT avg(coalesce({D.word_count('title')}, 0)) AS title_mean, median(coalesce({D.word_count('title')}, 0)) AS title_median,
       avg(coalesce({D.word_count('article')}, 0)) AS article_mean,
       median(coalesce({D.word_count('article')}, 0)) AS article_median FROM articles""")
def a4_mean_median(spark, sf):
    a = A(spark, sf).select(X.word_count("title").alias("title"), X.word_count("article").alias("article"))
    return S.mean_median(a, ["title", "article"])


@register("a4_median_of_doubles", W("facts") + """
SELECT median(score) AS score_median, median(pos) AS pos_median, median(neg) AS neg_median FROM facts""")
def a4_median_of_doubles(spark, sf):
    """Nulls are left out."""
    medians = S.mean_median(FA(spark, sf), ["score", "pos", "neg"], null_as=None)
    return medians.select("score_median", "pos_median", "neg_median")


@register("a4_median_of_prices", "SELECT median(l_extendedprice) AS l_extendedprice_median, median(l_quantity) AS l_quantity_median FROM lineitem")
def a4_median_of_prices(spark, sf):
    rows = fx.table(spark, sf, "lineitem")
    return S.mean_median(rows, ["l_extendedprice", "l_quantity"], null_as=None).select("l_extendedprice_median", "l_quantity_median")


@register("a5_grouped_count_non_null", W("facts") + """
SELECT publication, simple_topic, count(article) AS article_count FROM facts
WHERE publication IS NOT NULL AND simple_topic IS NOT NULL GROUP BY 1, 2""")
def a5_grouped_count_non_null(spark, sf):
    return S.non_null(FA(spark, sf), ["publication", "simple_topic"]).groupBy("publication", "simple_topic") \
        .agg(F.count("article").alias("article_count"))


@register("a6_grouped_means", W("facts") + """
SELECT simple_topic, avg(score) AS score_mean, avg(pos) AS pos_mean, avg(neg) AS neg_mean FROM facts
WHERE simple_topic IS NOT NULL GROUP BY 1""")
def a6_grouped_means(spark, sf):
    return S.non_null(FA(spark, sf), ["simple_topic"]).groupBy("simple_topic").agg(
        F.avg("score").alias("score_mean"), F.avg("pos").alias("pos_mean"), F.avg("neg").alias("neg_mean"))


@register("a8_count_distinct", W("facts") + """
SELECT publication, count(DISTINCT author) AS authors FROM facts WHERE publication IS NOT NULL GROUP BY 1""")
def a8_count_distinct(spark, sf):
    return S.non_null(FA(spark, sf), ["publication"]).groupBy("publication") \
        .agg(F.countDistinct("author").alias("authors"))


@register("a9_global_max", W("articles") + "SELECT max(date) AS latest FROM articles")
def a9_global_max(spark, sf):
    return A(spark, sf).agg(F.max("date").alias("latest"))


@register("a10_having", W("facts") + """
SELECT author, count(article) AS article_count, avg(score) AS score_mean FROM facts
WHERE author IS NOT NULL GROUP BY 1 HAVING count(article) > 15""")
def a10_having(spark, sf):
    return S.non_null(FA(spark, sf), ["author"]).groupBy("author").agg(
        F.count("article").alias("article_count"), F.avg("score").alias("score_mean")) \
        .filter(F.col("article_count") > 15)


@register("a11_mode_first_seen", W("facts") + """,
c AS (SELECT author, simple_topic, count(*) AS n, min(article_id) AS first_pos FROM facts
      WHERE author IS NOT NULL AND simple_topic IS NOT NULL GROUP BY 1, 2)
SELECT author, arg_max(simple_topic, n * 10000000000 - first_pos) AS mode FROM c GROUP BY 1""")
def a11_mode_first_seen(spark, sf):
    f = S.non_null(FA(spark, sf), ["author", "simple_topic"])
    return S.mode_first_seen(f, "author", "simple_topic", "article_id")


@register("a12_weighted_mean_coarse", W("facts") + """,
base AS (SELECT last_day(date) AS m, simple_topic AS t, publication AS p, article, score FROM facts
         WHERE year IS DISTINCT FROM 2020 AND date IS NOT NULL AND simple_topic IS NOT NULL),
pt AS (SELECT m, t, p, count(article) AS n, avg(score) AS a FROM base WHERE p IS NOT NULL GROUP BY 1, 2, 3),
tt AS (SELECT m, t, count(article) AS n, avg(score) AS a FROM base GROUP BY 1, 2),
j AS (SELECT pt.p, pt.n, CAST(pt.n AS DOUBLE) / tt.n AS pr, pt.a - tt.a AS sr
      FROM pt LEFT JOIN tt ON pt.m = tt.m AND pt.t = tt.t WHERE pt.n > 1)
SELECT p AS publication, coalesce(sum(n * pr), 0) / sum(n) AS weighted_avg_published_ratio,
       coalesce(sum(n * sr), 0) / sum(n) AS weighted_avg_sentiment_ratio,
       (coalesce(sum(n * pr), 0) / sum(n) + coalesce(sum(n * sr), 0) / sum(n)) / 2 AS bias_score
FROM j GROUP BY 1""")
def a12_weighted_mean_coarse(spark, sf):
    return bias.bias_score(FA(spark, sf).withColumnRenamed("score", bias.SCORE), grain=("publication",))


@register("a14_row_column_counts", NORM + """
SELECT count(*) AS rows, count(section) AS with_section, count(DISTINCT section) AS sections FROM narticles""")
def a14_row_column_counts(spark, sf):
    return _norm(spark, sf).agg(F.count(F.lit(1)).alias("rows"), F.count("section").alias("with_section"),
                                F.countDistinct("section").alias("sections"))


@register("a15_hierarchy_rollup", NORM + """
SELECT publication, section, count(*) AS count,
       CAST(grouping(publication, section) AS BIGINT) AS level,
       CASE WHEN count(DISTINCT simple_topic) = 1 THEN max(simple_topic) END AS simple_topic
FROM narticles WHERE publication IS NOT NULL AND section IS NOT NULL
GROUP BY ROLLUP (publication, section) HAVING grouping(publication, section) < 3""")
def a15_hierarchy_rollup(spark, sf):
    return S.hierarchy_counts(_norm(spark, sf), ["publication", "section"], label="simple_topic")


# ---- G ---------------------------------------------------------------------

@register("g1_monthly_gap_filled", W("articles") + """,
m AS (SELECT last_day(date) AS date, count(article) AS article_count, avg(CAST(length(title) AS DOUBLE)) AS title_len
      FROM articles WHERE date IS NOT NULL GROUP BY 1),
cal AS (SELECT last_day(CAST(d AS DATE)) AS date FROM (SELECT min(date) AS lo, max(date) AS hi FROM m),
        range(date_trunc('month', lo), hi + INTERVAL 1 DAY, INTERVAL 1 MONTH) t(d))
SELECT cal.date, coalesce(m.article_count, 0) AS article_count, m.title_len FROM cal LEFT JOIN m USING (date)""")
def g1_monthly_gap_filled(spark, sf):
    return S.monthly_gap_filled(A(spark, sf), [F.count("article").alias("article_count"),
                                               F.avg(F.char_length("title")).alias("title_len")],
                                fill={"article_count": 0})


@register("g2_month_and_key", W("facts") + """
SELECT last_day(date) AS date, simple_topic, count(article) AS article_count, avg(score) AS avg_sentiment
FROM facts WHERE date IS NOT NULL AND simple_topic IS NOT NULL GROUP BY 1, 2""")
def g2_month_and_key(spark, sf):
    return S.non_null(FA(spark, sf), ["date", "simple_topic"]).groupBy(S.month_end("date").alias("date"), "simple_topic") \
        .agg(F.count("article").alias("article_count"), F.avg("score").alias("avg_sentiment"))


@register("g3_daily_mean", W("facts") + """
SELECT date, avg(score) AS score_mean FROM facts WHERE date IS NOT NULL GROUP BY 1""")
def g3_daily_mean(spark, sf):
    return S.non_null(FA(spark, sf), ["date"]).groupBy("date").agg(F.avg("score").alias("score_mean"))


@register("g4_counts_by_year", W("articles") + """
SELECT year, count(*) AS count FROM articles WHERE year IS NOT NULL GROUP BY 1 ORDER BY 1""")
def g4_counts_by_year(spark, sf):
    return S.value_counts(A(spark, sf), "year").orderBy("year")


@register("g4_counts_by_day", W("articles") + """
SELECT day, count(*) AS count FROM articles WHERE day IS NOT NULL GROUP BY 1 ORDER BY 1""")
def g4_counts_by_day(spark, sf):
    return S.value_counts(A(spark, sf), "day").orderBy("day")


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")  # fixed fixture values


@register("g5_pivot_publications", W("facts") + "SELECT last_day(date) AS date, " + ", ".join(
    f"CASE WHEN count(CASE WHEN publication = '{s}' THEN 1 END) > 0 "
    f"THEN count(CASE WHEN publication = '{s}' THEN article END) END AS {s}" for s in SEGMENTS)
    + " FROM facts WHERE date IS NOT NULL AND publication IS NOT NULL GROUP BY 1")
def g5_pivot_publications(spark, sf):
    from ..plans.sections import publication_month_pivot
    facts = FA(spark, sf)
    return publication_month_pivot(facts, S.pivot_values(facts, "publication"))


@register("g6_unpivot_scores", W("facts") + """,
m AS (SELECT last_day(date) AS date, avg(score) AS score, avg(pos) AS pos, avg(neg) AS neg FROM facts
      WHERE date IS NOT NULL GROUP BY 1)
SELECT date, series, value FROM m UNPIVOT (value FOR series IN (score, pos, neg))""")
def g6_unpivot_scores(spark, sf):
    m = S.non_null(FA(spark, sf), ["date"]).groupBy(S.month_end("date").alias("date")).agg(
        F.avg("score").alias("score"), F.avg("pos").alias("pos"), F.avg("neg").alias("neg"))
    return m.unpivot("date", ["score", "pos", "neg"], "series", "value")


@register("g7_transpose_summary", W("facts") + """,
m AS (SELECT publication, avg(pos) AS pos, avg(neg) AS neg FROM facts WHERE publication IS NOT NULL GROUP BY 1),
u AS (SELECT publication, stat, value FROM m UNPIVOT (value FOR stat IN (pos, neg)))
SELECT stat, """ + ", ".join(f"max(CASE WHEN publication = '{s}' THEN value END) AS {s}" for s in SEGMENTS)
    + " FROM u GROUP BY 1")
def g7_transpose_summary(spark, sf):
    m = S.non_null(FA(spark, sf), ["publication"]).groupBy("publication").agg(
        F.avg("pos").alias("pos"), F.avg("neg").alias("neg"))
    return m.unpivot("publication", ["pos", "neg"], "stat", "value") \
        .groupBy("stat").pivot("publication", S.pivot_values(m, "publication")).agg(F.max("value"))


@register("g9_dense_row_number", W("facts") + """
SELECT article_id, publication, score, CAST(row_number() OVER (ORDER BY date, article_id) AS BIGINT) AS row_id FROM facts""")
def g9_dense_row_number(spark, sf):
    return S.dense_row_number(FA(spark, sf), ["date", "article_id"]).select("article_id", "publication", "score", "row_id")


# ---- J ---------------------------------------------------------------------

@register("j1_left_join_multi_key", W("facts") + """,
p AS (SELECT last_day(date) AS date, simple_topic, publication, count(article) AS n_p FROM facts
      WHERE date IS NOT NULL AND simple_topic IS NOT NULL AND publication IS NOT NULL GROUP BY 1, 2, 3),
t AS (SELECT last_day(date) AS date, simple_topic, count(article) AS n_t FROM facts
      WHERE date IS NOT NULL AND simple_topic IS NOT NULL GROUP BY 1, 2)
SELECT p.date, p.simple_topic, p.publication, p.n_p, t.n_t FROM p LEFT JOIN t USING (date, simple_topic)""")
def j1_left_join_multi_key(spark, sf):
    f = S.non_null(FA(spark, sf), ["date", "simple_topic"]).withColumn("date", S.month_end("date"))
    p = f.filter(F.col("publication").isNotNull()).groupBy("date", "simple_topic", "publication") \
        .agg(F.count("article").alias("n_p"))
    t = f.groupBy("date", "simple_topic").agg(F.count("article").alias("n_t"))
    return p.join(t, ["date", "simple_topic"], "left")


@register("j7_full_outer_align", W("facts") + """,
a AS (SELECT publication, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS positive_share FROM facts
      WHERE publication IS NOT NULL AND score > 0.9 GROUP BY 1),
b AS (SELECT publication, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS negative_share FROM facts
      WHERE publication IS NOT NULL AND score < -0.99 AND year = 1995 GROUP BY 1)
SELECT coalesce(a.publication, b.publication) AS publication, positive_share, negative_share
FROM a FULL OUTER JOIN b ON a.publication = b.publication""")
def j7_full_outer_align(spark, sf):
    f = FA(spark, sf)
    a = S.value_counts(f.filter(F.col("score") > 0.9), "publication", normalize=True, share_name="positive_share")
    b = S.value_counts(f.filter((F.col("score") < -0.99) & (F.col("year") == 1995)), "publication",
                       normalize=True, share_name="negative_share")
    return align(a, b, "publication", "full_outer")


# ---- O ---------------------------------------------------------------------

@register("o1_sort_two_keys", W("facts") + """
SELECT article_id, date, score FROM facts ORDER BY date DESC, score ASC NULLS FIRST, article_id""")
def o1_sort_two_keys(spark, sf):
    return FA(spark, sf).select("article_id", "date", "score").orderBy(
        F.desc("date"), F.asc_nulls_first("score"), "article_id")


@register("o2_top_k", W("facts") + """
SELECT author, count(*) AS count FROM facts WHERE author IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def o2_top_k(spark, sf):
    return S.ordered_top(S.value_counts(FA(spark, sf), "author"), [F.desc("count"), F.asc("author")], 20)


@register("o3_bottom_k", W("facts") + """
SELECT author, count(*) AS count FROM facts WHERE author IS NOT NULL GROUP BY 1 ORDER BY 2, 1 LIMIT 30""")
def o3_bottom_k(spark, sf):
    return S.ordered_top(S.value_counts(FA(spark, sf), "author"), [F.asc("count"), F.asc("author")], 30)


@register("o5_hash_sample", W("facts") + "SELECT article_id FROM facts ORDER BY md5(article_id || ':42'), article_id LIMIT 50")
def o5_hash_sample(spark, sf):
    """Repeatable random n rows: order by a seeded hash of the id."""
    return S.sample_rows(FA(spark, sf), "article_id", 50).select("article_id")


@register("o6_fraction_sample", W("facts") + """
SELECT article_id FROM facts WHERE CAST('0x' || substr(md5(article_id || ':42'), 1, 13) AS BIGINT) < 0.1 * 4503599627370496""")
def o6_fraction_sample(spark, sf):
    return S.sample_fraction(FA(spark, sf), "article_id", 0.1).select("article_id")


@register("o6_sample_size", W("facts") + "SELECT article_id FROM facts ORDER BY md5(article_id || ':7'), article_id LIMIT 1000")
def o6_sample_size(spark, sf):
    """Exactly ``sample_size`` rows before training."""
    return S.sample_rows(FA(spark, sf), "article_id", 1000, seed=7).select("article_id")


@register("o6_large_sample", """
SELECT l_orderkey, l_linenumber FROM lineitem
ORDER BY md5(l_orderkey || '/' || l_linenumber || ':5') LIMIT (SELECT count(*) // 3 FROM lineitem)""")
def o6_large_sample(spark, sf):
    """A third of the rows, exactly, without a sort of them."""
    rows = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("/", "l_orderkey", "l_linenumber").alias("key"))
    return S.sample_rows(rows, "key", rows.count() // 3, seed=5).drop("key")


# ---- U ---------------------------------------------------------------------

@register("u1_union_all", W("facts") + """
SELECT article_id, 'positive' AS polarity FROM facts WHERE pos > 0.5 AND neu < 0.5
UNION ALL SELECT article_id, 'negative' AS polarity FROM facts WHERE neg > 0.5 AND neu < 0.5""")
def u1_union_all(spark, sf):
    f = FA(spark, sf)
    p = f.filter((F.col("pos") > 0.5) & (F.col("neu") < 0.5)).select("article_id", F.lit("positive").alias("polarity"))
    n = f.filter((F.col("neg") > 0.5) & (F.col("neu") < 0.5)).select("article_id", F.lit("negative").alias("polarity"))
    return p.unionByName(n)


@register("u2_key_difference", W("facts") + """
SELECT DISTINCT author FROM facts WHERE year = 1996 AND author IS NOT NULL
EXCEPT SELECT author FROM facts WHERE year = 1997""")
def u2_key_difference(spark, sf):
    f = FA(spark, sf)
    a = f.filter((F.col("year") == 1996) & F.col("author").isNotNull()).select("author")
    b = f.filter(F.col("year") == 1997).select("author")
    return a.join(b, a["author"].eqNullSafe(b["author"]), "left_anti").distinct()


@register("u3_distinct_by_key", W("facts") + """
SELECT publication, simple_topic, min(article_id) AS article_id FROM facts GROUP BY 1, 2""")
def u3_distinct_by_key(spark, sf):
    # dropDuplicates keeps an arbitrary row; the earliest id makes it repeatable
    f = FA(spark, sf)
    return f.groupBy("publication", "simple_topic").agg(F.min("article_id").alias("article_id"))


# ---- W ---------------------------------------------------------------------

@register("w1_first_appearance_ids", W("facts") + """,
f AS (SELECT simple_topic, min(date) AS d, arg_min(article_id, date) AS a FROM facts
      WHERE simple_topic IS NOT NULL GROUP BY 1)
SELECT simple_topic, CAST(row_number() OVER (ORDER BY d, a, simple_topic) - 1 AS BIGINT) AS key_id FROM f""")
def w1_first_appearance_ids(spark, sf):
    return S.first_appearance_ids(FA(spark, sf), "simple_topic")


@register("p12_label_rewrite", W("facts") + """,
f AS (SELECT simple_topic, min(date) AS d, arg_min(article_id, date) AS a FROM facts
      WHERE simple_topic IS NOT NULL GROUP BY 1),
ids AS (SELECT simple_topic, CAST(row_number() OVER (ORDER BY d, a, simple_topic) - 1 AS BIGINT) AS key_id FROM f)
SELECT article_id, key_id AS simple_topic_id FROM facts LEFT JOIN ids USING (simple_topic)""")
def p12_label_rewrite(spark, sf):
    f = FA(spark, sf)
    ids = S.first_appearance_ids(f, "simple_topic")
    # one row per label: AQE broadcasts it from its runtime size
    return f.join(ids, "simple_topic", "left").select(
        "article_id", F.col("key_id").alias("simple_topic_id"))


@register("j2_lookup_join", NORM + """,
f AS (SELECT publication, min(date) AS d, arg_min(article_id, date) AS a FROM narticles
      WHERE publication IS NOT NULL GROUP BY 1),
ids AS (SELECT publication, CAST(row_number() OVER (ORDER BY d, a, publication) - 1 AS BIGINT) AS key_id FROM f)
SELECT article_id, key_id AS publication_id FROM narticles LEFT JOIN ids USING (publication)""")
def j2_lookup_join(spark, sf):
    a = _norm(spark, sf)
    ids = S.first_appearance_ids(a, "publication")  # one row per publication
    return a.join(ids, "publication", "left").select("article_id", F.col("key_id").alias("publication_id"))


@register("j8_left_align", W("articles") + f""",
o AS (SELECT publication, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS all_share FROM articles
      WHERE publication IS NOT NULL GROUP BY 1),
n AS (SELECT publication, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS long_share FROM articles
      WHERE publication IS NOT NULL AND {D.word_count('title')} > 40 GROUP BY 1)
SELECT o.publication, all_share, long_share FROM o LEFT JOIN n USING (publication)""")
def j8_left_align(spark, sf):
    a = A(spark, sf)
    o = S.value_counts(a, "publication", normalize=True, share_name="all_share")
    n = S.value_counts(a.filter(X.word_count("title") > 40), "publication", normalize=True, share_name="long_share")
    return align(o, n, "publication", "left")


@register("a4_mean_median_approx")
def a4_mean_median_approx(spark, sf):
    """A4 with the mergeable quantile sketch instead of an exact median."""
    a = A(spark, sf).select(X.word_count("title").alias("title_words"), X.word_count("article").alias("article_words"))
    return S.mean_median(a, ["title_words", "article_words"], approx=True)


@register("a8_count_distinct_approx")
def a8_count_distinct_approx(spark, sf):
    """A8 with HyperLogLog++ (1 % relative error) for very many keys."""
    return S.non_null(FA(spark, sf), ["publication"]).groupBy("publication") \
        .agg(S.distinct_count("author", approx=True).alias("authors"))
