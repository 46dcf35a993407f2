"""Cleaning (N*), text functions (X*) and predicates (P*) on the fixtures."""

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import text as X
from ..functions.stopwords import english
from ..operators import clean as N
from ..plans.authors import generic_author, not_named_after_publication
from . import duck as D
from . import register

W = fx.sql_with
A = fx.articles
STR = D.ARTICLE_STRING_COLS


def _norm(spark, sf):
    """Articles after the ingest cleaning (N1 + N2)."""
    return N.empty_to_null(N.text_null_fix(A(spark, sf)))


NORM = W("articles") + ", " + D.normalised_articles_cte() + "\n"


# ---- N: cleaning -----------------------------------------------------------

@register("n1_text_null_fix", W("articles") + f"SELECT article_id, {D.text_null_fix(STR)} FROM articles")
def n1_text_null_fix(spark, sf):
    return N.text_null_fix(A(spark, sf), STR).select("article_id", *STR)


@register("n2_empty_to_null", W("articles") + """
SELECT article_id, nullif(title, '') AS title, nullif(section, '') AS section,
       CASE WHEN len(regexp_extract_all(coalesce(title, ''), '[0-9]+')) > 0
            THEN regexp_extract_all(title, '[0-9]+') END AS digits
FROM articles""")
def n2_empty_to_null(spark, sf):
    df = A(spark, sf).select("article_id", "title", "section",
                             F.regexp_extract_all(F.coalesce("title", F.lit("")), F.lit("[0-9]+"), 0).alias("digits"))
    return N.empty_to_null(df)


@register("n3_nan_to_null", W("facts") + """
SELECT publication, avg(CASE WHEN article_id % 7 = 0 THEN NULL ELSE score END) AS mean_score,
       count(CASE WHEN article_id % 7 = 0 THEN NULL ELSE score END) AS n_score
FROM facts WHERE publication IS NOT NULL GROUP BY 1""")
def n3_nan_to_null(spark, sf):
    # NaN planted on every 7th row; after N3 the mean skips it as pandas does
    df = fx.facts(spark, sf).withColumn(
        "score", F.when(F.col("article_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("score")))
    df = N.nan_to_null(df)
    return df.filter(F.col("publication").isNotNull()).groupBy("publication").agg(
        F.avg("score").alias("mean_score"), F.count("score").alias("n_score"))


@register("n4_canonical_array", W("articles") + f"""
SELECT article_id, array_to_string(list_sort(list_distinct({D.tokens('title')})), '|') AS tokens
FROM articles""")
def n4_canonical_array(spark, sf):
    return A(spark, sf).select("article_id", F.array_join(N.canonical_array(X.simple_tokens("title")), "|").alias("tokens"))


@register("n5_date_parse", W("articles") + """
SELECT article_id, CAST(strftime(date, '%Y-%m-%d') AS DATE) AS date,
       TRY_CAST(CASE WHEN article_id % 5 = 0 THEN 'not a date' ELSE strftime(date, '%Y-%m-%d') END AS DATE) AS parsed
FROM articles""")
def n5_date_parse(spark, sf):
    df = A(spark, sf).select("article_id", F.date_format("date", "yyyy-MM-dd").alias("s"))
    bad = F.when(F.col("article_id") % 5 == 0, F.lit("not a date")).otherwise(F.col("s"))
    return df.select("article_id", N.parse_date("s").alias("date"), N.parse_date(bad, "yyyy-MM-dd").alias("parsed"))


@register("n6_drop_nulls", NORM + "SELECT article_id FROM narticles WHERE title IS NOT NULL AND article IS NOT NULL "
          "AND simple_topic IS NOT NULL")
def n6_drop_nulls(spark, sf):
    return _norm(spark, sf).na.drop(subset=["title", "article", "simple_topic"]).select("article_id")


@register("n7_fill_nulls", NORM + """
SELECT article_id, coalesce(section, '') AS section, coalesce(year, 0) AS year,
       coalesce(publication IS NOT NULL, false) AS has_publication FROM narticles""")
def n7_fill_nulls(spark, sf):
    df = _norm(spark, sf).select("article_id", "section", "year",
                                 F.when(F.col("publication").isNotNull(), True).alias("has_publication"))
    return df.na.fill({"section": "", "year": 0, "has_publication": False})


@register("n8_opinion_prefix", NORM + """
SELECT article_id, CASE WHEN lower(section) LIKE 'opinion%' THEN 'Opinion' ELSE section END AS section
FROM narticles""")
def n8_opinion_prefix(spark, sf):
    return N.coalesce_prefix(_norm(spark, sf), "section").select("article_id", "section")


@register("n9_rare_global", NORM + """
SELECT article_id, CASE WHEN count(section) OVER (PARTITION BY section) = 1 THEN NULL ELSE section END AS section
FROM narticles""")
def n9_rare_global(spark, sf):
    return N.nullify_rare(_norm(spark, sf), "section", by=None).select("article_id", "section")


@register("n10_rare_per_year", NORM + """
SELECT article_id, CASE WHEN count(section) OVER (PARTITION BY section) = 1
                          OR (year IS NOT NULL AND count(section) OVER (PARTITION BY year, section) = 1)
                        THEN NULL ELSE section END AS section
FROM narticles""")
def n10_rare_per_year(spark, sf):
    return N.nullify_rare(_norm(spark, sf), "section", by="year").select("article_id", "section")


@register("n11_generic_filter", NORM + f"""
SELECT article_id, section FROM narticles
WHERE section IS NOT NULL AND section NOT IN ({', '.join(repr(g) for g in N.GENERIC_SECTIONS)})""")
def n11_generic_filter(spark, sf):
    df = _norm(spark, sf).filter(F.col("section").isNotNull())
    return N.drop_values(df, "section", N.GENERIC_SECTIONS).select("article_id", "section")


@register("n12_clean_sections", NORM + ", " + D.clean_sections_cte("narticles", "cleaned", True, True)
          + "\nSELECT article_id, section FROM cleaned")
def n12_clean_sections(spark, sf):
    return N.clean_sections(_norm(spark, sf), case_first=True).select("article_id", "section")


@register("n12_clean_sections_eda", NORM + ", " + D.clean_sections_cte("narticles", "cleaned", False, False)
          + "\nSELECT article_id, section FROM cleaned")
def n12_clean_sections_eda(spark, sf):
    return N.clean_sections(_norm(spark, sf), case_first=False, generic=None).select("article_id", "section")


# ---- X: scalar and text functions ------------------------------------------

@register("x1_word_count", W("articles") + f"""
SELECT article_id, {D.word_count('title')} AS title_word_count, {D.word_count('article')} AS article_word_count
FROM articles""")
def x1_word_count(spark, sf):
    return A(spark, sf).select("article_id", X.word_count("title").alias("title_word_count"),
                               X.word_count("article").alias("article_word_count"))


@register("x2_char_count", W("articles") + """
SELECT article_id, CAST(length(title) AS BIGINT) AS title_chars, CAST(length(article) AS BIGINT) AS article_chars
FROM articles""")
def x2_char_count(spark, sf):
    return A(spark, sf).select("article_id", X.char_count("title").alias("title_chars"),
                               X.char_count("article").alias("article_chars"))


@register("x3_lower_prefix_substring", W("articles") + """
SELECT article_id, lower(section) AS section_lower, starts_with(lower(section), 'opinion') AS is_opinion,
       substr(title, 1, 12) AS title_head FROM articles""")
def x3_lower_prefix_substring(spark, sf):
    return A(spark, sf).select("article_id", F.lower("section").alias("section_lower"),
                               F.lower("section").startswith("opinion").alias("is_opinion"),
                               F.substring("title", 1, 12).alias("title_head"))


@register("x4_title_case", W("articles") + f"""
SELECT DISTINCT section, {D.title_case('section')} AS section_title FROM articles WHERE section IS NOT NULL""")
def x4_title_case(spark, sf):
    return A(spark, sf).filter(F.col("section").isNotNull()).select(
        "section", X.title_case("section").alias("section_title")).distinct()


@register("x5_simple_tokens", W("articles") + f"""
SELECT article_id, array_to_string({D.tokens('title')}, ' ') AS title_tokens,
       CAST(len({D.tokens('article')}) AS BIGINT) AS article_tokens FROM articles""")
def x5_simple_tokens(spark, sf):
    return A(spark, sf).select("article_id", F.array_join(X.simple_tokens("title"), " ").alias("title_tokens"),
                               F.size(X.simple_tokens("article")).cast("bigint").alias("article_tokens"))


@register("x6_stop_words", lambda: W("articles") + f"""
SELECT article_id, CAST(len({D.drop_words(D.tokens('article'), english())}) AS BIGINT) AS content_tokens
FROM articles""")
def x6_stop_words(spark, sf):
    return A(spark, sf).select("article_id", F.size(X.remove_stop_words(X.simple_tokens("article")))
                               .cast("bigint").alias("content_tokens"))


NON_WORD_DUCK = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"


def _clean_text_duck(e):
    sw = D.lit_list(__import__("presslens.functions.stopwords", fromlist=["x"]).section_stop_words())
    toks = (f"list_filter(string_split_regex(trim(regexp_replace(lower({e}), '{NON_WORD_DUCK}', ' ', 'g')), "
            f"'\\s+'), lambda t: t <> '' AND NOT list_contains({sw}, t))")
    return f"array_to_string({D.singular_list(toks)}, ' ')"


@register("x7_clean_text", W("articles") + f"SELECT article_id, {_clean_text_duck('title')} AS title_clean "
          "FROM articles WHERE title IS NOT NULL")
def x7_clean_text(spark, sf):
    return A(spark, sf).filter(F.col("title").isNotNull()).select(
        "article_id", X.clean_text("title").alias("title_clean"))


@register("x8_singularize", W("articles") + f"""
SELECT article_id, array_to_string({D.singular_list(D.tokens('title'))}, ' ') AS title_singular FROM articles""")
def x8_singularize(spark, sf):
    return A(spark, sf).select("article_id", F.array_join(X.singularize_tokens(X.simple_tokens("title")), " ")
                               .alias("title_singular"))


LEMMAS = (("the", "le"), ("and", "et"), ("of", "de"))


@register("x8_lemma_table", W("articles") + """,
lem(form, lemma) AS (VALUES ('the', 'le'), ('and', 'et'), ('of', 'de'))
""" + f"""SELECT article_id, array_to_string(list_transform({D.tokens('title')},
    lambda t: coalesce((SELECT max(lemma) FROM lem WHERE form = t), t)), ' ') AS title_lemmas FROM articles
""".replace("coalesce((SELECT max(lemma) FROM lem WHERE form = t), t)",
            "CASE t WHEN 'the' THEN 'le' WHEN 'and' THEN 'et' WHEN 'of' THEN 'de' ELSE t END"))
def x8_lemma_table(spark, sf):
    """Lemmas from a (form, lemma) table instead of the suffix rules."""
    lemmas = spark.createDataFrame(LEMMAS, "form string, lemma string")
    return X.lemmatize(A(spark, sf), X.simple_tokens("title"), lemmas, "lemmas").select(
        "article_id", F.array_join("lemmas", " ").alias("title_lemmas"))


@register("x9_split_pieces", W("articles") + """
SELECT DISTINCT section, array_to_string(list_filter(string_split_regex(section, '[\\s-]+'), lambda p: p <> ''), '|')
       AS pieces FROM articles WHERE section IS NOT NULL""")
def x9_split_pieces(spark, sf):
    return A(spark, sf).filter(F.col("section").isNotNull()).select(
        "section", F.array_join(X.split_pieces("section"), "|").alias("pieces")).distinct()


@register("x10_round_half_even", W("facts") + """
SELECT article_id, round_even(score * 0.37, 3) AS score_r3 FROM facts""")
def x10_round_half_even(spark, sf):
    return fx.facts(spark, sf).select("article_id", X.round_half_even(F.col("score") * 0.37, 3).alias("score_r3"))


@register("x11_date_parts", W("articles") + """
SELECT article_id, CAST(year(date) AS BIGINT) AS year, CAST(month(date) AS BIGINT) AS month,
       CAST(day(date) AS BIGINT) AS day FROM articles""")
def x11_date_parts(spark, sf):
    return A(spark, sf).select("article_id", *X.date_parts("date"))


@register("x12_arithmetic", W("facts") + """
SELECT article_id, pos - neg AS polarity, (pos + neg) / 2 AS mean_pn,
       CASE WHEN neu = 0 THEN NULL ELSE pos / neu END AS pos_to_neu, pos * 100 AS pos_pct FROM facts""")
def x12_arithmetic(spark, sf):
    f = fx.facts(spark, sf)
    return f.select("article_id", (F.col("pos") - F.col("neg")).alias("polarity"),
                    ((F.col("pos") + F.col("neg")) / 2).alias("mean_pn"),
                    F.try_divide("pos", F.when(F.col("neu") != 0, F.col("neu"))).alias("pos_to_neu"),
                    (F.col("pos") * 100).alias("pos_pct"))


@register("x13_non_empty_list", W("articles") + f"""
SELECT article_id, coalesce(len(regexp_extract_all(title, '[0-9]+')) > 0, false) AS has_digits FROM articles""")
def x13_non_empty_list(spark, sf):
    df = A(spark, sf).select("article_id", F.when(F.col("title").isNotNull(),
                             F.regexp_extract_all("title", F.lit("[0-9]+"), 0)).alias("d"))
    return df.select("article_id", X.non_empty("d").alias("has_digits"))


# ---- P: projections and predicates -----------------------------------------

@register("p1_select_rename", W("articles") + """
SELECT article_id AS id, publication AS source, title AS headline FROM articles""")
def p1_select_rename(spark, sf):
    return A(spark, sf).select("article_id", "publication", "title").toDF("id", "source", "headline")


@register("p2_year_date_filter", W("facts") + """
SELECT article_id FROM facts WHERE year IS DISTINCT FROM 2000 AND date < DATE '2001-04-01'""")
def p2_year_date_filter(spark, sf):
    f = fx.facts(spark, sf)
    return f.filter(~F.col("year").eqNullSafe(2000) & (F.col("date") < F.lit("2001-04-01").cast("date"))) \
        .select("article_id")


@register("p3_compound_expression", W("facts") + """
SELECT article_id FROM facts
WHERE (score < -0.25 OR score > 0.25) AND NOT (publication = 'BUILDING') AND year >= 1996""")
def p3_compound_expression(spark, sf):
    return fx.facts(spark, sf).filter(
        "(score < -0.25 OR score > 0.25) AND NOT (publication = 'BUILDING') AND year >= 1996").select("article_id")


@register("p4_in_list", NORM + """
SELECT article_id, section FROM narticles
WHERE section IN ('politics', 'SPORTS', 'tech news') OR (section NOT IN ('Opinion', 'U.S.') AND year = 1999)""")
def p4_in_list(spark, sf):
    s = F.col("section")
    return _norm(spark, sf).filter(s.isin("politics", "SPORTS", "tech news")
                                   | (~s.isin("Opinion", "U.S.") & (F.col("year") == 1999))) \
        .select("article_id", "section")


@register("p5_generic_author", NORM + """
SELECT article_id, author FROM narticles WHERE regexp_matches(lower(author), 'staff|media|press|network')""")
def p5_generic_author(spark, sf):
    return _norm(spark, sf).filter(generic_author("author")).select("article_id", "author")


@register("p6_author_not_publication", NORM + """
SELECT article_id, author, publication FROM narticles WHERE NOT contains(lower(author), lower(publication))""")
def p6_author_not_publication(spark, sf):
    return _norm(spark, sf).filter(not_named_after_publication()).select("article_id", "author", "publication")


@register("p7_contains_dash", NORM + "SELECT article_id, section FROM narticles WHERE contains(section, '-')")
def p7_contains_dash(spark, sf):
    return _norm(spark, sf).filter(F.col("section").contains("-")).select("article_id", "section")


@register("p8_equality_lookup", NORM + "SELECT article_id, title FROM narticles WHERE section = 'health-care'")
def p8_equality_lookup(spark, sf):
    return _norm(spark, sf).filter(F.col("section") == "health-care").select("article_id", "title")


@register("p11_conditional_update", W("articles") + """
SELECT article_id, CASE WHEN author = 'None' OR author = 'News Staff' THEN NULL ELSE author END AS author
FROM articles""")
def p11_conditional_update(spark, sf):
    a = F.col("author")
    return A(spark, sf).withColumn("author", F.when(a.isin("None", "News Staff"), None).otherwise(a)) \
        .select("article_id", "author")
