"""Sentiment, enrichment and token jobs."""

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.stopwords import english
from ..plans import sentiment as SE
from ..plans import tokens as TK
from ..resources import VALENCE
from . import duck as D
from . import register

W = fx.sql_with
A = fx.articles

D3_COLS = ["title_word_count", "article_word_count", "title_textblob_sentiment", "article_textblob_sentiment",
           "vader_prob_positive_title", "vader_prob_negative_title", "vader_prob_neutral_title",
           "vader_compound_title"]


def valence_values_sql() -> str:
    vals = ", ".join(f"('{w}', {v!r})" for w, v in sorted(VALENCE.items()))
    return f"(VALUES {vals}) AS v(word, valence)"


def _neg_tokens(tok_list: str) -> str:
    """Tokens as (t, neg) structs: negated when one of the three preceding
    tokens is a negator (DuckDB list index is 1-based)."""
    from ..resources import NEGATORS
    negs = D.lit_list(NEGATORS)
    return (f"list_transform({tok_list}, lambda x, i: struct_pack(t := x, neg := "
            f"len(list_filter(({tok_list})[greatest(1, i - 3):i - 1], lambda y: list_contains({negs}, y))) > 0))")


def scored_cte(src: str = "articles", name: str = "scored", negate: bool = False) -> str:
    """D3 columns over ``src`` as CTEs; defines ``{name}`` = src + columns."""
    tt, ta = D.tokens("title"), D.tokens("article")
    if negate:
        # token lists first, so the per-token lambda slices a column instead of
        # re-tokenising the text for every token
        tk = f"""{name}_tl AS (SELECT article_id, {tt} AS l0, {ta} AS l1 FROM {src}),
{name}_tk0 AS (SELECT article_id, 0 AS f, unnest({_neg_tokens('l0')}) AS s FROM {name}_tl
        UNION ALL SELECT article_id, 1 AS f, unnest({_neg_tokens('l1')}) AS s FROM {name}_tl),
{name}_tk AS (SELECT article_id, f, s.t AS t, s.neg AS neg FROM {name}_tk0)"""
        val = "CASE WHEN neg THEN -v.valence ELSE v.valence END"
    else:
        tk = f"""{name}_tk AS (SELECT article_id, 0 AS f, unnest({tt}) AS t FROM {src}
        UNION ALL SELECT article_id, 1 AS f, unnest({ta}) AS t FROM {src})"""
        val = "v.valence"
    return f"""{tk},
{name}_v AS (SELECT {name}_tk.article_id, {name}_tk.f, {val} AS valence
      FROM {name}_tk JOIN {valence_values_sql()} ON {name}_tk.t = v.word),
{name}_m AS (SELECT article_id,
        sum(CASE WHEN f = 0 THEN valence END) AS s0, count(CASE WHEN f = 0 THEN valence END) AS c0,
        sum(CASE WHEN f = 0 AND valence > 0 THEN valence + 1 END) AS p0,
        sum(CASE WHEN f = 0 AND valence < 0 THEN -valence + 1 END) AS n0,
        count(CASE WHEN f = 0 AND valence <> 0 THEN 1 END) AS z0,
        sum(CASE WHEN f = 1 THEN valence END) AS s1, count(CASE WHEN f = 1 THEN valence END) AS c1
      FROM {name}_v GROUP BY 1),
{name}_x AS (SELECT a.*, coalesce(s0, 0) AS _s0, coalesce(c0, 0) AS _c0, coalesce(p0, 0) AS _p0,
        coalesce(n0, 0) AS _n0, len({tt}) - coalesce(z0, 0) AS _u0, coalesce(s1, 0) AS _s1, coalesce(c1, 0) AS _c1
      FROM {src} a LEFT JOIN {name}_m USING (article_id)),
{name} AS (SELECT * EXCLUDE (_s0, _c0, _p0, _n0, _u0, _s1, _c1),
  {D.word_count('title')} AS title_word_count, {D.word_count('article')} AS article_word_count,
  CASE WHEN title IS NOT NULL THEN CASE WHEN _c0 > 0 THEN _s0 / _c0 ELSE 0.0 END END AS title_textblob_sentiment,
  CASE WHEN article IS NOT NULL THEN CASE WHEN _c1 > 0 THEN _s1 / _c1 ELSE 0.0 END END AS article_textblob_sentiment,
  CASE WHEN title IS NOT NULL THEN CASE WHEN _p0 + _n0 + _u0 > 0 THEN _p0 / (_p0 + _n0 + _u0) ELSE 0.0 END END
    AS vader_prob_positive_title,
  CASE WHEN title IS NOT NULL THEN CASE WHEN _p0 + _n0 + _u0 > 0 THEN _n0 / (_p0 + _n0 + _u0) ELSE 0.0 END END
    AS vader_prob_negative_title,
  CASE WHEN title IS NOT NULL THEN CASE WHEN _p0 + _n0 + _u0 > 0 THEN _u0 / (_p0 + _n0 + _u0) ELSE 0.0 END END
    AS vader_prob_neutral_title,
  CASE WHEN title IS NOT NULL THEN _s0 / sqrt(_s0 * _s0 + 15) END AS vader_compound_title
  FROM {name}_x)"""


def enriched(spark, sf):
    return SE.enrich_text(A(spark, sf), SE.valence_table(spark))


@register("d3_text_enrichment", lambda: W("articles") + ", " + scored_cte()
          + "\nSELECT article_id, " + ", ".join(D3_COLS) + " FROM scored")
def d3_text_enrichment(spark, sf):
    return enriched(spark, sf).select("article_id", *D3_COLS)


@register("d2_lexicon_sentiment_title", lambda: W("articles") + ", " + scored_cte()
          + "\nSELECT article_id, title_textblob_sentiment, vader_compound_title FROM scored")
def d2_lexicon_sentiment_title(spark, sf):
    return enriched(spark, sf).select("article_id", "title_textblob_sentiment", "vader_compound_title")


@register("d2_negation_sentiment", lambda: W("articles") + ", " + scored_cte(negate=True)
          + "\nSELECT article_id, title_textblob_sentiment, vader_compound_title FROM scored")
def d2_negation_sentiment(spark, sf):
    """Negation variant (flip when one of three preceding tokens negates)."""
    return SE.enrich_text(A(spark, sf), SE.valence_table(spark), negate=True).select(
        "article_id", "title_textblob_sentiment", "vader_compound_title")


def _lda_tokens(e):
    return D.drop_words(D.tokens(e), english())


@register("d18_top_article_tokens", lambda: W("articles") + f"""
SELECT token, count(*) AS count FROM (SELECT unnest({_lda_tokens('article')}) AS token FROM articles
WHERE article IS NOT NULL) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def d18_top_article_tokens(spark, sf):
    return TK.token_frequencies(A(spark, sf), "article", 10)


@register("d18_top_title_tokens", lambda: W("articles") + f"""
SELECT token, count(*) AS count FROM (SELECT unnest({_lda_tokens('title')}) AS token FROM articles
WHERE title IS NOT NULL) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def d18_top_title_tokens(spark, sf):
    return TK.token_frequencies(A(spark, sf), "title", 10)


def _vocab_sql(keep_n: int = 100_000):
    return f"""dfreq AS (SELECT token, count(*) AS df FROM (SELECT article_id,
        unnest(list_distinct({_lda_tokens('article')})) AS token FROM articles WHERE article IS NOT NULL) GROUP BY 1),
vocab AS (SELECT token, df, CAST(row_number() OVER (ORDER BY df DESC, token) - 1 AS BIGINT) AS token_id FROM dfreq
      WHERE df >= 10 AND df <= (SELECT count(*) FROM articles WHERE article IS NOT NULL) * 0.1
      ORDER BY df DESC, token LIMIT {keep_n})"""


@register("m10_vocabulary", lambda: W("articles") + ", " + _vocab_sql() + "\nSELECT token, df, token_id FROM vocab")
def m10_vocabulary(spark, sf):
    return TK.vocabulary(A(spark, sf), "article")


@register("m10_vocabulary_top500", lambda: W("articles") + ", " + _vocab_sql(500) + "\nSELECT token, df, token_id FROM vocab")
def m10_vocabulary_top500(spark, sf):
    """The same with a ``keep_n`` that the fixture reaches."""
    return TK.vocabulary(A(spark, sf), "article", keep_n=500)


@register("m11_bag_of_words", lambda: W("articles") + ", " + _vocab_sql() + f"""
SELECT article_id, token_id, count(*) AS count FROM (SELECT article_id, unnest({_lda_tokens('article')}) AS token
FROM articles WHERE article IS NOT NULL) t JOIN vocab USING (token) GROUP BY 1, 2""")
def m11_bag_of_words(spark, sf):
    counted = TK.counted_documents(A(spark, sf), "article_id", "article")
    return TK.bag_of_words(counted, "article_id", TK.counted_vocabulary(counted))


@register("g8_explode_tokens", lambda: W("articles") + f"""
SELECT article_id, unnest({D.tokens('title')}) AS token FROM articles""")
def g8_explode_tokens(spark, sf):
    from ..functions.text import simple_tokens
    return A(spark, sf).select("article_id", F.explode(simple_tokens("title")).alias("token"))
