"""Section -> topic assignment, geography tagging, topic job.

Expensive text work runs on *distinct sections* only; the resulting
section dimension is joined back to the articles once. Keyword matching is
an equi-join (short keywords on the token, long keywords on a 5-character
prefix plus a ``startswith`` residual) against the lexicon, so no
Cartesian product and no Python in the row path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lookup import let
from ..functions.text import section_clean, simple_tokens, singularize, singularize_tokens, split_pieces, title_case
from ..operators.clean import GENERIC_SECTIONS, coalesce_prefix
from ..operators.stats import non_null, value_counts, with_share

SHORT_KEYWORD = 5  # keywords shorter than this match whole tokens only
PREFIX = 5


def section_terms(sections: DataFrame) -> DataFrame:
    """(section, term): singularised tokens of ``section_clean`` plus the
    whole singularised phrase."""
    toks = sections.filter(F.col("section_clean").isNotNull()).select(
        "section", singularize_tokens(simple_tokens("section_clean")).alias("tokens"))
    return toks.select("section", F.explode(F.array_distinct(
        F.concat("tokens", F.array(F.array_join("tokens", " "))))).alias("term"))


def keyword_matches(terms: DataFrame, lexicon: DataFrame, normalize_lexicon: bool = False) -> DataFrame:
    """Distinct (section, lexicon row) pairs under the D1 rules."""
    lex = lexicon
    if normalize_lexicon:
        lex = lex.withColumn("keyword", singularize(F.lower("keyword")))
    lex = lex.withColumn("_klen", F.char_length("keyword"))
    short = terms.join(lex.filter(F.col("_klen") < SHORT_KEYWORD), terms["term"] == lex["keyword"])
    t2 = terms.withColumn("_p", F.substring("term", 1, PREFIX))
    lx2 = lex.filter(F.col("_klen") >= SHORT_KEYWORD).withColumn("_kp", F.substring("keyword", 1, PREFIX))
    long = t2.join(lx2, (t2["_p"] == lx2["_kp"]) & t2["term"].startswith(lx2["keyword"]))
    cols = ["section", "topic", "topic_pos", "keyword_pos"]
    return short.select(*cols).unionByName(long.select(*cols)).distinct()


def section_topics(articles: DataFrame, lexicon: DataFrame, normalize_lexicon: bool = False) -> DataFrame:
    """D1 section dimension: (section, article_count, section_clean,
    simple_section_topics, simple_topic).

    Every matching lexicon row adds its topic once (duplicates in the
    lexicon count twice); the topic is the most frequent, ties going to
    the topic listed first.
    """
    counts = value_counts(articles, "section", count_name="article_count")
    return topics_for_sections(counts, lexicon, normalize_lexicon)


def topics_for_sections(counts: DataFrame, lexicon: DataFrame, normalize_lexicon: bool = False) -> DataFrame:
    """D1 on a table of distinct sections ``(section, article_count)``."""
    out = with_topics(counts, ["section"], lexicon, normalize_lexicon)
    return out.select("section", "article_count", "section_clean", "simple_section_topics", "simple_topic")


def with_topics(df: DataFrame, key: list[str], lexicon: DataFrame, normalize_lexicon: bool = False) -> DataFrame:
    """D1 on a small table with unique ``key`` columns and a section: adds
    section_clean, simple_section_topics and simple_topic.

    One chain without branches, so that the input is computed once: every term
    asks for itself (short keywords) and for its prefix (long ones)."""
    carried = [c for c in df.columns if c not in key] + ["section_clean"]
    terms = let(singularize_tokens(simple_tokens("section_clean")),
                lambda t: F.array_distinct(F.concat(t, F.array(F.array_join(t, " ")))))
    asks = F.flatten(F.transform(terms, lambda t: F.array(
        F.struct(F.lit(True).alias("short"), t.alias("ask"), t.alias("term")),
        F.struct(F.lit(False).alias("short"), F.substring(t, 1, PREFIX).alias("ask"), t.alias("term")))))
    asked = df.withColumn("section_clean", section_clean("section")).select("*", F.explode_outer(asks).alias("_a")) \
        .select(*key, *carried, "_a.*")
    keyword = singularize(F.lower("keyword")) if normalize_lexicon else F.col("keyword")
    lex = lexicon.select("topic", "topic_pos", "keyword_pos", keyword.alias("_keyword"))
    lex = lex.withColumn("_short", F.char_length("_keyword") < SHORT_KEYWORD)
    lex = lex.withColumn("_key", F.when(F.col("_short"), F.col("_keyword")).otherwise(F.substring("_keyword", 1, PREFIX)))
    found = asked.join(lex, (F.col("short") == F.col("_short")) & (F.col("ask") == F.col("_key"))
                       & F.col("term").startswith(F.col("_keyword")), "left")
    first = [F.first(c).alias(c) for c in carried]
    # a lexicon row counts once, however many terms match it
    per_topic = found.groupBy(*key, "topic", "topic_pos").agg(F.countDistinct("keyword_pos").alias("_n"), *first)
    row = F.when(F.col("topic").isNotNull(), F.struct("topic_pos", "_n", "topic"))
    topics = F.flatten(F.transform(F.array_sort(F.collect_list(row)),
                                   lambda x: F.array_repeat(x["topic"], x["_n"].cast("int"))))
    out = per_topic.groupBy(*key).agg(
        *first, topics.alias("_topics"), F.max_by("topic", F.struct(F.col("_n"), -F.col("topic_pos"))).alias("simple_topic"))
    return out.withColumn("simple_section_topics", F.when(F.size("_topics") > 0, F.col("_topics"))).drop("_topics")


def assign_topics(articles: DataFrame, sections: DataFrame) -> DataFrame:
    """Map the section dimension back to the articles (J2 look-up)."""
    return articles.join(sections.select("section", "simple_topic"), "section", "left")


def geo_sections(articles: DataFrame, places: DataFrame) -> DataFrame:
    """Per distinct section the pieces (split on whitespace and
    hyphens) that are place names, in order, else null; plus ``is_geo``."""
    return geo_for_sections(non_null(articles, ["section"]).select("section").distinct(), places)


def geo_for_sections(secs: DataFrame, places: DataFrame) -> DataFrame:
    """D4 on a table of distinct sections."""
    return tag_places(secs, "section", places)


def tag_places(df: DataFrame, section: str, places: DataFrame) -> DataFrame:
    """D4 on a table that has a section column: adds ``geo`` (pieces that
    are place names, in order, else null) and ``is_geo``. A row without a
    section is kept and not geo. The pieces of each section meet the gazetteer
    in one equi-join; only sections with a hit come back."""
    pieces = non_null(df, [section]).select(F.col(section).alias("_section"),
                                            F.posexplode(split_pieces(section)).alias("pos", "piece"))
    names = places.select(F.lower("name").alias("_name")).distinct()
    hits = pieces.join(names, F.lower("piece") == F.col("_name"))
    geo = hits.groupBy("_section").agg(F.transform(
        F.array_sort(F.collect_set(F.struct("pos", "piece"))), lambda x: x["piece"]).alias("geo"))
    return df.join(geo, F.col(section) == F.col("_section"), "left").drop("_section") \
        .withColumn("is_geo", F.col("geo").isNotNull())


def with_places(df: DataFrame, key: list[str], places: DataFrame) -> DataFrame:
    """D4 on a small table with unique ``key`` columns and a section: as
    ``tag_places``, in one chain without a second reading of the table."""
    carried = [c for c in df.columns if c not in key]
    pieces = df.select("*", F.posexplode_outer(split_pieces("section")).alias("_pos", "_piece"))
    names = places.select(F.lower("name").alias("_name")).distinct()
    hits = pieces.join(names, F.lower("_piece") == F.col("_name"), "left")
    hit = F.when(F.col("_name").isNotNull(), F.struct(F.col("_pos").alias("pos"), F.col("_piece").alias("piece")))
    found = hits.groupBy(*key).agg(*[F.first(c).alias(c) for c in carried], F.transform(
        F.array_sort(F.collect_list(hit)), lambda x: x["piece"]).alias("_geo"))
    geo = F.when(F.size("_geo") > 0, F.col("_geo"))
    return found.withColumn("geo", geo).withColumn("is_geo", geo.isNotNull()).drop("_geo")


def places_from_tables(spark, sf_dir: str, extra=None) -> DataFrame:
    """Gazetteer: nation and region names of the given tables plus our own
    place names."""
    from ..resources import PLACE_NAMES
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name"))
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_name").alias("name"))
    own = spark.createDataFrame([(p,) for p in (extra or PLACE_NAMES)], "name string")
    return nations.unionByName(regions).unionByName(own)


def tag_geography(articles: DataFrame, geo: DataFrame) -> DataFrame:
    """Map (geo, is_geo) back to the articles; no section -> not geo."""
    return articles.join(geo, "section", "left").withColumn("is_geo", F.coalesce("is_geo", F.lit(False)))


def section_mapping(articles: DataFrame, lexicon: DataFrame, places: DataFrame,
                    normalize_lexicon: bool = False) -> tuple[DataFrame, DataFrame]:
    """All section-level work of D5 on one small aggregate.

    The articles are reduced once to ``(year, raw section) -> rows``. N12
    (title case, opinion prefix, singleton rules, generic list), D4 and D1
    are then functions of that table only, giving a mapping
    ``(year, raw_section) -> section, geo, is_geo, simple_topic`` for the
    rows that survive cleaning, plus the section dimension of D1.
    """
    raw = articles.filter(F.col("section").isNotNull()).groupBy(
        "year", F.col("section").alias("raw_section")).agg(F.count(F.lit(1)).alias("n"))
    t = coalesce_prefix(raw.withColumn("section", title_case("raw_section")), "section")
    # singleton rules as windows over the small table (no join back)
    t = t.withColumn("n_by", F.sum("n").over(Window.partitionBy("year", "section"))) \
        .withColumn("n_all", F.sum("n").over(Window.partitionBy("section")))
    rare = (F.col("n_all") == 1) | (F.col("year").isNotNull() & (F.col("n_by") == 1))
    mapping = t.filter(~rare & ~F.col("section").isin(*GENERIC_SECTIONS)).drop("n_by", "n_all")
    key = ["year", "raw_section"]
    full = with_topics(with_places(mapping, key, places), key, lexicon, normalize_lexicon)
    topic = F.when(~F.col("is_geo"), F.col("simple_topic"))  # geography sections have none
    full = full.withColumn("simple_topic", topic)
    sections = full.filter(~F.col("is_geo")).groupBy("section").agg(
        F.sum("n").alias("article_count"), *[F.first(c).alias(c) for c in
                                             ("section_clean", "simple_section_topics", "simple_topic")])
    return full.select("year", "raw_section", "section", "geo", "is_geo", "simple_topic"), sections


def topic_job(articles: DataFrame, lexicon: DataFrame, places: DataFrame,
              normalize_lexicon: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """N12 -> D4 -> drop geo -> D1 -> drop rows without topic.

    Returns (topic articles, section dimension, cleaned and geo-tagged
    articles with their topic, before the geo/topic filters). The article rows meet the section mapping in one join (AQE
    broadcasts it when its runtime size is small); rows dropped by the
    cleaning have no partner in the mapping. Writing in 25 slices is
    ``sources.io.write_table``.
    """
    base = articles.drop("simple_topic") if "simple_topic" in articles.columns else articles
    full, sections = section_mapping(base, lexicon, places, normalize_lexicon)
    m = full.withColumnsRenamed({"year": "_my", "section": "_clean"})
    tagged = base.join(m, base["year"].eqNullSafe(m["_my"]) & (base["section"] == m["raw_section"])) \
        .withColumn("section", F.col("_clean")).drop("_my", "_clean", "raw_section")
    out = tagged.filter(~F.col("is_geo") & F.col("simple_topic").isNotNull()).drop("geo", "is_geo")
    return out, sections, tagged


def sections_per_topic(sections: DataFrame) -> DataFrame:
    """Number of sections captured by each topic."""
    return non_null(sections, ["simple_topic"]).groupBy("simple_topic").agg(F.count("section").alias("sections"))


def topic_section_articles(sections: DataFrame) -> DataFrame:
    """(topic, section, article_count) of mapped sections."""
    return non_null(sections, ["simple_topic"]).select("simple_topic", "section", "article_count")


def unmapped_sections(sections: DataFrame, k: int = 10) -> DataFrame:
    """The most frequent sections without a topic."""
    return sections.filter(F.col("simple_topic").isNull()) \
        .select("section", "article_count", "section_clean") \
        .orderBy(F.desc("article_count"), "section").limit(k)


def publication_shift(before: DataFrame, after: DataFrame, key: str = "publication") -> DataFrame:
    """Publication shares (in %) before and after filtering, aligned on
    the keys of the *before* distribution, and their difference in points."""
    old = value_counts(before, key, normalize=True, scale=100.0, share_name="old_pub_ratio")
    new = value_counts(after, key, normalize=True, scale=100.0, share_name="new_pub_ratio")
    return old.join(new, key, "left").withColumn("ratio_pp", F.col("new_pub_ratio") - F.col("old_pub_ratio"))


def publication_shift_flagged(tagged: DataFrame, kept: "F.Column", key: str = "publication") -> DataFrame:
    """D7 when the "after" rows are a flagged subset of the "before" rows:
    one aggregate with two counts instead of two passes."""
    counts = non_null(tagged, [key]).groupBy(key).agg(
        F.count(F.lit(1)).alias("_old"), F.count(F.when(kept, 1)).alias("_new"))
    # totals by a window over the aggregate, a row a publication: the input stands in the plan once
    every = Window.partitionBy()
    old = F.col("_old") * F.lit(100.0) / F.sum("_old").over(every)
    new = F.when(F.col("_new") > 0, F.col("_new") * F.lit(100.0) / F.sum("_new").over(every))
    shares = counts.select(key, old.alias("old_pub_ratio"), new.alias("new_pub_ratio"))
    return shares.withColumn("ratio_pp", F.col("new_pub_ratio") - F.col("old_pub_ratio"))


def shift_std(shift: DataFrame) -> DataFrame:
    """D7 (A13): sample std of the percentage-point change."""
    return shift.agg(F.stddev_samp("ratio_pp").alias("ratio_pp_std"))


def article_topic_shares(articles: DataFrame) -> DataFrame:
    """Share of articles per topic."""
    return with_share(value_counts(articles, "simple_topic"), "count", "share").drop("count")
