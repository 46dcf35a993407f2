"""Topic assignment and geography."""

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import clean as N
from ..plans import topics as TP
from ..resources import PLACE_NAMES
from ..sources.lexicon import lexicon_values_sql, read_lexicon
from . import duck as D
from . import register

W = fx.sql_with


def _norm(spark, sf):
    """The raw layer as the topic job reads it: ingest-cleaned articles."""
    return N.empty_to_null(N.text_null_fix(fx.articles(spark, sf)))


def _job(spark, sf):
    return TP.topic_job(_norm(spark, sf), read_lexicon(spark), TP.places_from_tables(spark, sf))


def _places_sql() -> str:
    own = ", ".join("('" + p.replace("'", "''") + "')" for p in PLACE_NAMES)
    return (f"places AS (SELECT DISTINCT lower(name) AS name FROM (SELECT n_name AS name FROM nation "
            f"UNION ALL SELECT r_name FROM region UNION ALL SELECT * FROM (VALUES {own}) o(name)))")


def _topic_sql(lexicon_filter: str = "") -> str:
    """D5 as CTEs: narticles -> cleaned -> geo -> nongeo -> sections -> topics."""
    singular_tokens = D.singular_list(D.tokens("section_clean"))
    return (W("articles") + ", " + D.normalised_articles_cte() + ",\n"
            + D.clean_sections_cte("narticles", "cleaned", True, True) + ",\n" + _places_sql() + f""",
lexicon AS (SELECT * FROM {lexicon_values_sql()} {lexicon_filter}),
dsec AS (SELECT DISTINCT section, list_filter(string_split_regex(section, '[\\s-]+'), lambda p: p <> '') AS pieces
         FROM cleaned),
pcs AS (SELECT section, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pos FROM dsec),
geo AS (SELECT section, list(piece ORDER BY pos) AS geo FROM pcs JOIN places ON lower(pcs.piece) = places.name
        GROUP BY 1),
geo2 AS (SELECT dsec.section, geo.geo, geo.geo IS NOT NULL AS is_geo FROM dsec LEFT JOIN geo USING (section)),
tagged AS (SELECT c.*, g.geo, coalesce(g.is_geo, false) AS is_geo FROM cleaned c LEFT JOIN geo2 g USING (section)),
nongeo AS (SELECT * EXCLUDE (geo, is_geo) FROM tagged WHERE NOT is_geo),
sec AS (SELECT section, count(*) AS article_count, {D.section_clean('section')} AS section_clean
        FROM nongeo WHERE section IS NOT NULL GROUP BY 1),
toks AS (SELECT section, {singular_tokens} AS tokens FROM sec WHERE section_clean IS NOT NULL),
terms AS (SELECT DISTINCT section, unnest(list_distinct(list_append(tokens, array_to_string(tokens, ' ')))) AS term
          FROM toks),
matches AS (SELECT DISTINCT t.section, l.topic, l.topic_pos, l.keyword_pos FROM terms t JOIN lexicon l
            ON (length(l.keyword) < 5 AND t.term = l.keyword)
            OR (length(l.keyword) >= 5 AND starts_with(t.term, l.keyword))),
per_topic AS (SELECT section, topic, topic_pos, count(*) AS n FROM matches GROUP BY 1, 2, 3),
best AS (SELECT section, arg_max(topic, n * 100000 - topic_pos) AS simple_topic FROM per_topic GROUP BY 1),
lists AS (SELECT section, string_agg(topic, '|' ORDER BY topic_pos, keyword_pos) AS simple_section_topics
          FROM matches GROUP BY 1),
sections AS (SELECT sec.*, lists.simple_section_topics, best.simple_topic FROM sec
             LEFT JOIN lists USING (section) LEFT JOIN best USING (section)),
topics AS (SELECT n.*, s.simple_topic FROM (SELECT * EXCLUDE (simple_topic) FROM nongeo) n
           LEFT JOIN sections s USING (section) WHERE s.simple_topic IS NOT NULL)
""")


@register("d1_section_topics", lambda: _topic_sql()
          + "SELECT section, article_count, section_clean, simple_section_topics, simple_topic FROM sections")
def d1_section_topics(spark, sf):
    _, sections, _ = _job(spark, sf)
    return sections.withColumn("simple_section_topics", F.array_join("simple_section_topics", "|"))


@register("j9_lexicon_match", lambda: _topic_sql() + "SELECT section, topic, keyword_pos FROM matches")
def j9_lexicon_match(spark, sf):
    from ..functions.text import section_clean
    cleaned = N.clean_sections(_norm(spark, sf))
    tagged = TP.tag_geography(cleaned, TP.geo_sections(cleaned, TP.places_from_tables(spark, sf)))
    secs = tagged.filter(~F.col("is_geo")).select("section").distinct() \
        .withColumn("section_clean", section_clean("section"))
    return TP.keyword_matches(TP.section_terms(secs), read_lexicon(spark)).select("section", "topic", "keyword_pos")


@register("d1_article_topics", lambda: _topic_sql() + "SELECT article_id, section, simple_topic FROM topics")
def d1_article_topics(spark, sf):
    out, _, _ = _job(spark, sf)
    return out.select("article_id", "section", "simple_topic")


@register("d5_topic_job", lambda: _topic_sql() + """
SELECT article_id, date, year, author, title, publication, section, simple_topic FROM topics""")
def d5_topic_job(spark, sf):
    out, _, _ = _job(spark, sf)
    return out.select("article_id", "date", "year", "author", "title", "publication", "section", "simple_topic")


@register("d4_geo_sections", lambda: _topic_sql()
          + "SELECT section, array_to_string(geo, '|') AS geo, is_geo FROM geo2")
def d4_geo_sections(spark, sf):
    cleaned = N.clean_sections(_norm(spark, sf))
    g = TP.geo_sections(cleaned, TP.places_from_tables(spark, sf))
    return g.withColumn("geo", F.array_join("geo", "|"))


@register("x13_is_geo_flag", lambda: _topic_sql() + "SELECT article_id, is_geo FROM tagged")
def x13_is_geo_flag(spark, sf):
    _, _, tagged = _job(spark, sf)
    return tagged.select("article_id", "is_geo")


@register("d6_sections_per_topic", lambda: _topic_sql()
          + "SELECT simple_topic, count(section) AS sections FROM sections WHERE simple_topic IS NOT NULL GROUP BY 1")
def d6_sections_per_topic(spark, sf):
    _, sections, _ = _job(spark, sf)
    return TP.sections_per_topic(sections)


@register("d6_topic_section_articles", lambda: _topic_sql()
          + "SELECT simple_topic, section, article_count FROM sections WHERE simple_topic IS NOT NULL")
def d6_topic_section_articles(spark, sf):
    _, sections, _ = _job(spark, sf)
    return TP.topic_section_articles(sections)


@register("d6_article_topic_shares", lambda: _topic_sql() + """
SELECT simple_topic, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share FROM topics GROUP BY 1""")
def d6_article_topic_shares(spark, sf):
    out, _, _ = _job(spark, sf)
    return TP.article_topic_shares(out)


@register("o4_unmapped_sections", lambda: _topic_sql() + """
SELECT section, article_count, section_clean FROM sections WHERE simple_topic IS NULL
ORDER BY article_count DESC, section LIMIT 10""")
def o4_unmapped_sections(spark, sf):
    _, sections, _ = _job(spark, sf)
    return TP.unmapped_sections(sections, 10)


D7_SQL = """,
old AS (SELECT publication, 100.0 * count(*) / sum(count(*)) OVER () AS old_pub_ratio FROM tagged
        WHERE publication IS NOT NULL GROUP BY 1),
new AS (SELECT publication, 100.0 * count(*) / sum(count(*)) OVER () AS new_pub_ratio FROM topics
        WHERE publication IS NOT NULL GROUP BY 1),
shift AS (SELECT old.publication, old_pub_ratio, new_pub_ratio, new_pub_ratio - old_pub_ratio AS ratio_pp
          FROM old LEFT JOIN new USING (publication))
"""


@register("d7_publication_shift", lambda: _topic_sql() + D7_SQL + "SELECT * FROM shift")
def d7_publication_shift(spark, sf):
    _, _, tagged = _job(spark, sf)
    return TP.publication_shift_flagged(tagged, ~F.col("is_geo") & F.col("simple_topic").isNotNull())


@register("a13_shift_std", lambda: _topic_sql() + D7_SQL + "SELECT stddev_samp(ratio_pp) AS ratio_pp_std FROM shift")
def a13_shift_std(spark, sf):
    _, _, tagged = _job(spark, sf)
    return TP.shift_std(TP.publication_shift_flagged(tagged, ~F.col("is_geo") & F.col("simple_topic").isNotNull()))


@register("s12_lexicon_keywords_used", lambda: _topic_sql() + """
SELECT l.topic, l.topic_pos, l.keyword, l.keyword_pos, count(m.section) AS sections
FROM lexicon l LEFT JOIN matches m ON l.topic_pos = m.topic_pos AND l.keyword_pos = m.keyword_pos GROUP BY 1, 2, 3, 4""")
def s12_lexicon_keywords_used(spark, sf):
    """Every row of the lexicon source with the number of sections that it matches."""
    lexicon = read_lexicon(spark)
    used = j9_lexicon_match(spark, sf).join(lexicon.select("topic", "topic_pos").distinct(), "topic") \
        .groupBy("topic_pos", "keyword_pos").agg(F.count("section").alias("sections"))
    return lexicon.join(used, ["topic_pos", "keyword_pos"], "left").fillna(0, ["sections"])


@register("o4_unmapped_sections_short_lexicon", lambda: _topic_sql("WHERE topic_pos < 3") + """
SELECT section, article_count, section_clean FROM sections WHERE simple_topic IS NULL
ORDER BY article_count DESC, section LIMIT 10""")
def o4_unmapped_sections_short_lexicon(spark, sf):
    """The same with three topics, which leave sections of the fixture unmapped."""
    lexicon = read_lexicon(spark).filter(F.col("topic_pos") < 3)
    _, sections, _ = TP.topic_job(_norm(spark, sf), lexicon, TP.places_from_tables(spark, sf))
    return TP.unmapped_sections(sections, 10)
