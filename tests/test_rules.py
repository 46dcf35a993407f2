"""Hand-written rows for the null/float rules and the
matching rules of D1, plus invariants of the rows-only jobs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from presslens.functions import text as X
from presslens.operators import clean as N
from presslens.operators import stats as S
from presslens.plans import authors as AU
from presslens.plans import features as FE
from presslens.plans import sentiment as SE
from presslens.plans import topics as TP

ART = "article_id long, date date, year long, month long, section string, publication string, author string, article string"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_title_case_python_style(spark):
    df = spark.createDataFrame([("u.s.",), ("tech-news",), ("what's up",), ("café SOCIETY",), (None,)], "s string")
    got = [r[0] for r in df.select(X.title_case("s")).collect()]
    assert got == ["U.S.", "Tech-News", "What'S Up", "Café Society", None]


def test_word_count_unicode_and_empty(spark):
    df = spark.createDataFrame([("a b c",), ("",), ("  ",), (None,)], "s string")
    assert [r[0] for r in df.select(X.word_count("s")).collect()] == [3, 0, 0, None]


def test_tokens_unicode_digits_and_length(spark):
    df = spark.createDataFrame([("Café 3D _x ab a abcdefghijklmnop élan",)], "s string")
    assert df.select(X.simple_tokens("s")).first()[0] == ["café", "ab", "élan"]


def test_singularize_rules(spark):
    words = ["stories", "boxes", "classes", "sports", "bus", "analysis", "days", "watches", "gas", "news"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(X.singularize("w")).collect()]
    assert got == ["story", "box", "class", "sport", "bus", "analysis", "day", "watch", "gas", "new"]


def test_text_null_fix_and_nan(spark):
    df = spark.createDataFrame([("NaN", float("nan")), ("None", 1.0), ("nano", 2.0)], "s string, x double")
    out = N.normalise_nulls(df).collect()
    assert [tuple(r) for r in out] == [(None, None), (None, 1.0), ("nano", 2.0)]


def test_rare_sections_per_year(spark):
    data = [
        (1, 2018, "Solo"),             # once overall -> null
        (2, 2018, "Twice"), (3, 2019, "Twice"),   # once in each year -> null both
        (4, 2018, "Pair"), (5, 2018, "Pair"),     # kept
        (6, None, "Pair"),             # null year: only the global rule applies -> kept
        (7, None, "Lonely"),           # null year, once overall -> null
    ]
    df = spark.createDataFrame(data, "article_id long, year long, section string")
    got = dict(rows(N.nullify_rare(df, "section", "year"), "article_id", "section"))
    assert got == {1: None, 2: None, 3: None, 4: "Pair", 5: "Pair", 6: "Pair", 7: None}


def test_gap_filled_months(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 5), "a"), (dt.date(2020, 3, 9), None)], "date date, article string")
    out = S.monthly_gap_filled(df, [F.count("article").alias("n")], fill={"n": 0})
    assert rows(out, "date", "n") == [(dt.date(2020, 1, 31), 1), (dt.date(2020, 2, 29), 0), (dt.date(2020, 3, 31), 0)]


def test_single_row_std_is_null(spark):
    df = spark.createDataFrame([("p", 0.5, 0.1, "x")], "publication string, article_textblob_sentiment double, "
                               "vader_compound_title double, article string")
    r = AU.group_sentiment(df, "publication").first()
    assert r["article_std"] is None and r["title_std"] is None


def test_round_then_filter(spark):
    # 3/300 = 0.01 -> not > 0.01 ; 4/300 = 0.0133 -> 0.013 kept ; unrounded 0.0104 would pass
    data = [(i, "p", "A", "x") for i in range(3)] + [(10 + i, "p", "B", "x") for i in range(4)] \
        + [(100 + i, "p", f"Z{i}", "x") for i in range(293)]
    df = spark.createDataFrame(data, "article_id long, publication string, author string, article string")
    got = {r["author"]: r["author_ratio_for_publication"] for r in AU.dense_authors(df, digits=3).collect()}
    assert got == {"B": 0.013}


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.125,), (0.135,)], "x double")
    assert [r[0] for r in df.select(X.round_half_even("x", 2)).collect()] == [0.12, 0.14]


LEX = [("Tech", 0, "tech", 0), ("Tech", 0, "internet", 1), ("Tech", 0, "internet", 2),
       ("Money", 1, "wall street", 0), ("Money", 1, "bank", 1), ("Money", 1, "business", 2),
       ("Art", 2, "art", 0), ("Art", 2, "design", 1), ("Style", 3, "design", 0), ("Caps", 4, "CEO", 0)]


def test_d1_rules(spark):
    lex = spark.createDataFrame(LEX, "topic string, topic_pos int, keyword string, keyword_pos int")
    arts = spark.createDataFrame(
        [(1, "Internet Banking"), (2, "Wall Street Journal"), (3, "Art & Design"), (4, "Designs"),
         (5, "Technology"), (6, "Startart"), (7, "CEO Corner"), (8, "Businesses"), (9, "News")],
        "article_id long, section string")
    secs = {r["section"]: (r["simple_section_topics"], r["simple_topic"])
            for r in TP.section_topics(arts, lex).collect()}
    # duplicate keyword counts twice; short keyword "bank" needs a whole token
    assert secs["Internet Banking"] == (["Tech", "Tech"], "Tech")
    # multi-word long keyword matches as a prefix of the phrase
    assert secs["Wall Street Journal"] == (["Money"], "Money")
    # tie between topics -> the earlier topic in the lexicon
    assert secs["Art & Design"] == (["Art", "Art", "Style"], "Art")
    assert secs["Designs"] == (["Art", "Style"], "Art")
    assert secs["Technology"] == (None, None)                 # "tech" is short: whole tokens only
    assert secs["Startart"] == (None, None)                   # short keyword never matches inside a token
    assert secs["CEO Corner"] == (None, None)                 # upper-case keyword never matches
    assert secs["Businesses"] == (["Money"], "Money")         # singularised token starts with keyword
    assert secs["News"] == (None, None)                       # stop word -> empty clean section


def test_balance_threshold_is_strict(spark):
    # largest class 100 -> t = 5; class with exactly 5 rows is dropped
    data = [(i, "big") for i in range(100)] + [(1000 + i, "mid") for i in range(6)] \
        + [(2000 + i, "edge") for i in range(5)]
    df = spark.createDataFrame(data, "id long, label string")
    out = FE.balance_classes(df, "label", "id")
    assert dict(rows(out.groupBy("label").count(), "label", "count")) == {"big": 5, "mid": 5}
    # draws come from the class itself
    assert rows(out.filter("label = 'mid'").filter("id < 1000 or id >= 2000"), "id") == []


def test_split_is_disjoint_exhaustive_repeatable(spark):
    df = spark.range(5000).withColumnRenamed("id", "article_id")
    a = df.withColumn("t", FE.split_flag("article_id"))
    b = df.withColumn("t", FE.split_flag("article_id"))
    assert a.exceptAll(b).count() == 0
    share = a.filter("t").count() / 5000
    assert 0.17 < share < 0.23


def test_sentiment_shares_sum_to_one_or_zero(spark, sf_dir):
    from presslens import fixtures as fx
    e = SE.enrich_text(fx.articles(spark, sf_dir), SE.valence_table(spark))
    s = F.col("vader_prob_positive_title") + F.col("vader_prob_negative_title") + F.col("vader_prob_neutral_title")
    bad = e.filter(F.col("title").isNotNull() & ~((F.abs(s - 1) < 1e-9) | (s == 0))).count()
    assert bad == 0
    assert e.filter(F.col("title").isNull() & F.col("vader_compound_title").isNotNull()).count() == 0


def test_empty_title_scores_zero(spark):
    df = spark.createDataFrame([(1, "", "x"), (2, None, None)], "article_id long, title string, article string")
    r = {x["article_id"]: x for x in SE.enrich_text(df, SE.valence_table(spark)).collect()}
    assert r[1]["vader_compound_title"] == 0.0 and r[1]["vader_prob_neutral_title"] == 0.0
    assert r[2]["vader_compound_title"] is None and r[2]["title_textblob_sentiment"] is None


def test_report_support_sums_to_rows(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "label string, prediction string")
    rep = {r["class"]: r for r in FE.classification_report(df).collect()}
    assert rep["c"]["precision"] == 0.0 and rep["c"]["recall"] == 0.0
    assert sum(rep[c]["support"] for c in "abc") == 4 == rep["accuracy"]["support"]
    assert rep["accuracy"]["f1_score"] == 0.5


def test_sequences_truncate_pre_and_pad_post(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["a", "zz"]), (3, [])], "k long, t array<string>")
    vocab = FE.word_index(df, "t", num_words=4)   # ids 2, 3 kept: a (2), then b (tie by word)
    out = dict(rows(FE.sequences(df, "k", "t", vocab, 3), "k", "sequence"))
    assert out == {1: [3, 1, 1], 2: [2, 1, 0], 3: [0, 0, 0]}


def test_dense_row_number_is_consecutive(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    out = S.dense_row_number(df, ["v"], partitions=7)
    assert rows(out, "v", "row_id") == [(i, i + 1) for i in range(1000)]


def test_theta_anti_join(spark):
    a = spark.createDataFrame([("CNN Staff",), ("Jane Doe",), ("Reuters Desk",), ("Bob",)], "author string")
    p = spark.createDataFrame([("cnn",), ("Reuters",), (None,), ("",)], "publication string")
    from presslens.operators.joins import contains_any
    got = sorted(r[0] for r in contains_any(a, "author", p, "publication").collect())
    assert got == ["Bob", "Jane Doe"]
    got = sorted(r[0] for r in contains_any(a, "author", p, "publication", "left_semi").collect())
    assert got == ["CNN Staff", "Reuters Desk"]
    assert contains_any(a, "author", p.limit(0), "publication").count() == 4


def test_numbers_on_wide_tables(spark, tmp_path):
    """All columns written out: the range cut that numbers the rows is the one that the offsets know."""
    df = spark.range(30_000, numPartitions=16).select(
        F.col("id"), (F.col("id") * 7919 % 30_011).alias("v"), F.md5(F.col("id").cast("string")).alias("payload"),
        (F.col("id") % 3).cast("string").alias("grp"))
    for n in (4, 16):
        path = f"{tmp_path}/dense{n}"
        S.dense_row_number(df, ["v"], partitions=n).write.parquet(path)
        out = spark.read.parquet(path)
        assert rows(out.orderBy("v"), "row_id") == [(i + 1,) for i in range(30_000)] or \
            [r["row_id"] for r in out.orderBy("v").collect()] == list(range(1, 30_001))
        path = f"{tmp_path}/group{n}"
        S.range_numbered(df, ["grp"], ["v"], "nr", partitions=n).write.parquet(path)
        for g in "012":
            own = [r["nr"] for r in spark.read.parquet(path).filter(F.col("grp") == g).orderBy("v").collect()]
            assert own == list(range(1, 10_001))


def test_balanced_classes_on_wide_tables(spark, tmp_path):
    df = spark.range(20_000, numPartitions=12).select(
        F.col("id"), F.when(F.col("id") % 2 == 0, "a").when(F.col("id") % 3 == 0, "b").otherwise("c").alias("label"),
        F.md5(F.col("id").cast("string")).alias("payload"))
    FE.balance_classes(df, "label", "id", fraction=0.3).write.parquet(f"{tmp_path}/balanced")
    got = dict(spark.read.parquet(f"{tmp_path}/balanced").groupBy("label").count().collect())
    assert got == {"a": 3000, "b": 3000, "c": 3000}


def test_geography_keeps_rows_without_section(spark):
    from presslens.plans import topics as TP
    df = spark.createDataFrame([(1, None), (2, "Paris news"), (3, "new-york Paris"), (4, "sport")], "id long, section string")
    places = spark.createDataFrame([("paris",), ("York",)], "name string")
    got = {r["id"]: (r["geo"], r["is_geo"]) for r in TP.tag_places(df, "section", places).collect()}
    assert got == {1: (None, False), 2: (["Paris"], True), 3: (["york", "Paris"], True), 4: (None, False)}


def test_token_counts_and_word_table(spark):
    from presslens.functions.lookup import look_up_all, token_counts, word_table
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None)], "id long, t array<string>")
    got = {r["id"]: r["c"] for r in df.select("id", token_counts(F.col("t")).alias("c")).collect()}
    assert [tuple(x) for x in got[1]] == [("a", 1), ("b", 2)] and got[2] == [] and not got[3]
    words = spark.createDataFrame([("b", 2.0), ("b", 3.0), (None, 1.0)], "w string, v double")
    out = df.withColumn("_w", word_table(words, "w", "v")).select("id", look_up_all(F.col("_w"), F.col("t")).alias("x"))
    assert {r["id"]: r["x"] for r in out.collect()} == {1: [2.0, None, 2.0], 2: [], 3: None}


def test_enrichment_runs_on_the_raw_schema(spark):
    from presslens.schema import RAW_SCHEMA
    row = {"title": "Good war, bad love", "article": "not good"}
    df = spark.createDataFrame([tuple(row.get(f.name) for f in RAW_SCHEMA.fields)], RAW_SCHEMA)
    out = SE.enrich_text(df, SE.valence_table(spark)).first()
    assert out["title_word_count"] == 4 and abs(out["title_textblob_sentiment"] - (1.9 - 2.9 - 2.5 + 3.2) / 4) < 1e-9


def test_polarity_modes(spark):
    from presslens.plans import bias
    names = "id long, vader_prob_positive_title double, vader_prob_negative_title double, " \
        "vader_prob_neutral_title double, article_textblob_sentiment double"
    df = spark.createDataFrame([(1, .6, .1, .3, .2), (2, .6, .1, .3, .1), (3, .2, .2, .6, -.2), (4, .2, .2, .6, .15),
                                (5, .5, .5, .0, .0)], names)
    got = {m: sorted(r["id"] for r in bias.polarity_mode(df, m).collect()) for m in ("strict", "loose", "title_only")}
    assert got == {"strict": [1], "loose": [1, 2, 3], "title_only": [1, 2]}
