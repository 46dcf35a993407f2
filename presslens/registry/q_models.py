"""Features, evaluation and model jobs."""

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import text as X
from ..operators import clean as N
from ..plans import authors as AU
from ..plans import features as FE
from ..plans import models as MO
from ..plans import sentiment as SE
from ..plans import sequence_model as SM
from ..plans import tokens as TK
from ..session import materialize
from . import duck as D
from . import register
from .q_clean import _clean_text_duck

W = fx.sql_with


def model_input(spark, sf):
    """Model input: ingest-cleaned articles with cleaned title and text,
    rows lacking either dropped (N6). The cleaner maps a non-null text to a
    non-null (possibly empty) string, so the drop tests the raw columns and
    an unused cleaned column is pruned from the plan."""
    a = N.empty_to_null(N.text_null_fix(fx.articles(spark, sf)))
    a = a.na.drop(subset=["title", "article"])
    return a.withColumns({"title_clean": X.clean_text("title"), "article_clean": X.clean_text("article")})


def staged_input(spark, sf, *cols):
    """The model input columns a job needs, cleaned once and written as a
    stage: feature building reads its input several times (vocabulary,
    weighting, counts), and every read would otherwise clean the text again."""
    return materialize(model_input(spark, sf).select("article_id", *cols))


def model_input_sql() -> str:
    return (W("articles") + ", " + D.normalised_articles_cte() + f""",
mi AS (SELECT * FROM (SELECT *, {_clean_text_duck('title')} AS title_clean, {_clean_text_duck('article')} AS article_clean
       FROM narticles) WHERE title_clean IS NOT NULL AND article_clean IS NOT NULL)
""")


@register("m1_tfidf_relational", lambda: model_input_sql() + """,
docs AS (SELECT article_id, list_filter(string_split(title_clean, ' '), lambda w: length(w) >= 2) AS toks FROM mi),
tf AS (SELECT article_id, term, count(*) AS tf FROM (SELECT article_id, unnest(toks) AS term FROM docs) GROUP BY 1, 2),
st AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY 1),
vocab AS (SELECT term, ln((1.0 + (SELECT count(*) FROM docs)) / (df + 1)) + 1 AS idf FROM st
          ORDER BY total DESC, term LIMIT 5000),
w AS (SELECT article_id, term, tf * idf AS w FROM tf JOIN vocab USING (term))
SELECT article_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY article_id)) AS weight FROM w""")
def m1_tfidf_relational(spark, sf):
    return FE.tfidf_relational(staged_input(spark, sf, "title_clean"), "article_id", "title_clean", 5000)


@register("m1_tfidf_ml_features")
def m1_tfidf_ml_features(spark, sf):
    """The same features through Spark ML stages (vectors)."""
    from pyspark.ml.functions import vector_to_array
    feats, _ = MO.tfidf_features(staged_input(spark, sf, "title_clean"), "title_clean", 5000)
    return feats.select("article_id", F.size(vector_to_array("features")).alias("dims"))


@register("m2_hash_split", W("articles") + """
SELECT article_id, ((article_id * 1103515245 + 12395) % 2147483648) % 100 < 20 AS is_test FROM articles""")
def m2_hash_split(spark, sf):
    return fx.articles(spark, sf).select("article_id", FE.split_flag("article_id").alias("is_test"))


@register("m2_random_split")
def m2_random_split(spark, sf):
    train, test = fx.articles(spark, sf).select("article_id").randomSplit([0.8, 0.2], seed=42)
    return test


M3_SIZES_SQL = """
WITH c AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1),
t AS (SELECT CAST(floor(max(n) * 0.05) AS BIGINT) AS t FROM c)
SELECT lang, (SELECT t FROM t) AS count FROM c WHERE n > (SELECT t FROM t)"""


def _balanced(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    return FE.balance_classes(docs, "lang", "doc_id")


@register("m3_class_balance_sizes", M3_SIZES_SQL)
def m3_class_balance_sizes(spark, sf):
    return _balanced(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("count"))


@register("m3_class_balance", """
WITH c AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1),
t AS (SELECT CAST(floor(max(n) * 0.05) AS BIGINT) AS t FROM c),
num AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents WHERE lang IS NOT NULL),
draws AS (SELECT lang, n, unnest(range(1, t + 1)) AS j FROM c, t WHERE n > t),
picks AS (SELECT lang, CAST('0x' || substr(md5(lang || ':' || j || ':42'), 1, 13) AS BIGINT) % n + 1 AS rn FROM draws)
SELECT doc_id, lang FROM picks JOIN num USING (lang, rn)""")
def m3_class_balance(spark, sf):
    return _balanced(spark, sf)


PRED_SQL = """pred AS (SELECT CASE WHEN l.toxic = 1 THEN 'toxic' ELSE CAST(l.quality AS VARCHAR) END AS label,
                  CAST(l.doc_id % 2 AS VARCHAR) AS prediction FROM labels l)"""


def _pred(spark, sf):
    l = spark.read.parquet(f"{sf}/labels.parquet")
    return l.select(F.when(F.col("toxic") == 1, "toxic").otherwise(F.col("quality").cast("string")).alias("label"),
                    (F.col("doc_id") % 2).cast("string").alias("prediction"))


REPORT_CTE = """
conf AS (SELECT label AS l, prediction AS p, count(*) AS n FROM pred GROUP BY 1, 2),
bl AS (SELECT l AS class, sum(n) AS support, sum(CASE WHEN l = p THEN n ELSE 0 END) AS tp FROM conf GROUP BY 1),
bp AS (SELECT p AS class, sum(n) AS predicted FROM conf GROUP BY 1),
cls AS (SELECT coalesce(bl.class, bp.class) AS class, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp,
               coalesce(predicted, 0) AS predicted FROM bl FULL OUTER JOIN bp ON bl.class = bp.class),
per AS (SELECT class, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0.0 END AS precision,
               CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS recall, support, tp FROM cls),
per2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END
               AS f1_score FROM per),
s AS (SELECT CAST(sum(tp) AS DOUBLE) / sum(support) AS acc, CAST(sum(support) AS BIGINT) AS total,
             avg(precision) AS mp, avg(recall) AS mr, avg(f1_score) AS mf,
             sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS wr,
             sum(f1_score * support) / sum(support) AS wf FROM per2),
report AS (
SELECT class, precision, recall, f1_score, CAST(support AS BIGINT) AS support FROM per2
UNION ALL SELECT 'accuracy', NULL, NULL, acc, total FROM s
UNION ALL SELECT 'macro avg', mp, mr, mf, total FROM s
UNION ALL SELECT 'weighted avg', wp, wr, wf, total FROM s)
"""
REPORT_SQL = "WITH " + PRED_SQL + "," + REPORT_CTE


@register("m8_classification_report", REPORT_SQL + "SELECT * FROM report")
def m8_classification_report(spark, sf):
    return FE.classification_report(_pred(spark, sf))


@register("m9_weighted_scores", REPORT_SQL + """
SELECT max(CASE WHEN class = 'accuracy' THEN f1_score END) AS accuracy,
       max(CASE WHEN class = 'weighted avg' THEN precision END) AS precision,
       max(CASE WHEN class = 'weighted avg' THEN recall END) AS recall,
       max(CASE WHEN class = 'weighted avg' THEN f1_score END) AS f1 FROM report""")
def m9_weighted_scores(spark, sf):
    return FE.weighted_scores(_pred(spark, sf))


@register("m13_token_sequences", lambda: model_input_sql() + """,
toks AS (SELECT article_id, list_filter(string_split(title_clean, ' '), lambda w: w <> '') AS t FROM mi),
freq AS (SELECT word, count(*) AS c FROM (SELECT unnest(t) AS word FROM toks) GROUP BY 1),
vocab AS (SELECT word, CAST(row_number() OVER (ORDER BY c DESC, word) + 1 AS INTEGER) AS id FROM freq
          ORDER BY c DESC, word LIMIT 9998),
ex AS (SELECT article_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM toks),
ids AS (SELECT article_id, list(coalesce(v.id, 1) ORDER BY pos) AS ids FROM ex LEFT JOIN vocab v USING (word)
        GROUP BY 1),
cut AS (SELECT toks.article_id, CASE WHEN len(ids) > 20 THEN ids[len(ids) - 19:] ELSE coalesce(ids, []) END AS ids
        FROM toks LEFT JOIN ids USING (article_id))
SELECT article_id, array_to_string(list_concat(ids, list_transform(range(20 - len(ids)), lambda x: 0)), ' ')
       AS sequence FROM cut""")
def m13_token_sequences(spark, sf):
    mi = staged_input(spark, sf, "title_clean").select("article_id", F.filter(
        F.split("title_clean", " "), lambda w: w != "").alias("t"))
    vocab = FE.word_index(mi, "t")
    return FE.sequences(mi, "article_id", "t", vocab, 20).select(
        "article_id", F.array_join("sequence", " ").alias("sequence"))


#: Trees grown no deeper than this in the registered reports: MLlib's limit of 30 is the library's default.
FOREST = {"random_forest": {"trees": 100, "depth": 30}}


def _experiment(spark, sf, models, text="title_clean", target="simple_topic", max_features=5000, name="title_topic"):
    return MO.run_experiment(staged_input(spark, sf, text, target), "article_id", text, target, max_features,
                             f"{name}_tfidf_{max_features}", models=models, options=FOREST)


def _naive_bayes_sql(columns: str, max_features: int = 5000) -> str:
    """TF-IDF rows of the titles, multinomial naive Bayes (add one) on the training part, report on the test part."""
    return model_input_sql() + f""",
docs AS (SELECT article_id, simple_topic AS label, list_filter(string_split(title_clean, ' '), lambda w: length(w) >= 2) AS t,
                {TEST_SQL} AS test FROM mi WHERE simple_topic IS NOT NULL),
tf AS (SELECT article_id, test, label, term, count(*) AS tf
       FROM (SELECT article_id, test, label, unnest(t) AS term FROM docs) GROUP BY ALL),
vocab AS (SELECT term, ln((1.0 + (SELECT count(*) FROM docs WHERE NOT test)) / (count(*) + 1)) + 1 AS idf
          FROM tf WHERE NOT test GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT {max_features}),
w AS (SELECT article_id, test, label, term, tf * idf AS w FROM tf JOIN vocab USING (term)),
x AS (SELECT article_id, test, label, term, w / sqrt(sum(w * w) OVER (PARTITION BY article_id)) AS x FROM w),
classes AS (SELECT label AS c, count(*) AS n FROM docs WHERE NOT test GROUP BY 1),
sums AS (SELECT label AS c, term, sum(x) AS s FROM x WHERE NOT test GROUP BY 1, 2),
mass AS (SELECT c, sum(s) AS t FROM sums GROUP BY 1),
fits AS (SELECT x.article_id, m.c, sum(x * (ln(coalesce(s, 0) + 1) - ln(t + (SELECT count(*) FROM vocab)))) AS fit
         FROM x CROSS JOIN mass m LEFT JOIN sums ON sums.c = m.c AND sums.term = x.term WHERE test GROUP BY 1, 2),
scores AS (SELECT d.article_id, d.label, k.c, k.n, coalesce(fit, 0) + ln(n + 1) AS score
           FROM docs d CROSS JOIN classes k LEFT JOIN fits f ON f.article_id = d.article_id AND f.c = k.c WHERE test),
pred AS (SELECT label, c AS prediction FROM scores
         QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY score DESC, n DESC, c) = 1),
""" + REPORT_CTE + f"SELECT 'title_topic_tfidf_{max_features}' AS experiment, 'naive_bayes' AS model, {columns} FROM report"


#: The test part of the experiments and that of the networks (M2's hash with their seeds).
TEST_SQL = "((article_id * 1103515245 + 12395) % 2147483648) % 100 < 20"
NETWORK_TEST_SQL = "((article_id * 1103515245 + 12387) % 2147483648) % 100 < 20"


@register("m4_naive_bayes", lambda: _naive_bayes_sql("*"))
def m4_naive_bayes(spark, sf):
    return _experiment(spark, sf, ["naive_bayes"])


@register("m5_logistic_regression")
def m5_logistic_regression(spark, sf):
    return _experiment(spark, sf, ["logistic_regression"])


@register("m6_random_forest")
def m6_random_forest(spark, sf):
    return _experiment(spark, sf, ["random_forest"])


@register("m7_experiment_runner")
def m7_experiment_runner(spark, sf):
    return _experiment(spark, sf, MO.MODELS, text="article_clean", max_features=10000, name="article_topic")


def _authors_input(spark, sf, text):
    """Articles of eligible authors (D9); the fixture reaches ten articles an author."""
    a = materialize(model_input(spark, sf).select("article_id", "author", "publication", "article", text))
    authors = AU.eligible_authors(a, min_articles=10)
    # a stage: an experiment reads its input three times
    return materialize(AU.eligible_author_articles(a, authors).select("article_id", text, "author"))


@register("m7_title_author")
def m7_title_author(spark, sf):
    return MO.run_experiment(_authors_input(spark, sf, "title_clean"), "article_id", "title_clean", "author", 10000,
                             "title_author_tfidf_10000")


@register("m7_article_author")
def m7_article_author(spark, sf):
    return MO.run_experiment(_authors_input(spark, sf, "article_clean"), "article_id", "article_clean", "author", 5000,
                             "article_author_tfidf_5000")


@register("m7_title_topic_balanced")
def m7_title_topic_balanced(spark, sf):
    """Classes resampled to 5 % of the largest (M3) before the split."""
    rows = materialize(FE.balance_classes(staged_input(spark, sf, "title_clean", "simple_topic"), "simple_topic", "article_id"))
    return MO.run_experiment(rows, "article_id", "title_clean", "simple_topic", 5000, "title_topic_tfidf_5p_5000")


def _support_sql(target: str, test: str) -> str:
    return model_input_sql() + f"""
SELECT {target} AS class, count(*) AS support FROM mi WHERE {target} IS NOT NULL AND {test} GROUP BY 1"""


def _support(report):
    """Classes and test rows of a report."""
    return report.filter(~F.col("class").isin("accuracy", "macro avg", "weighted avg")) \
        .select("class", "support").filter("support > 0")


@register("m7_report_support", lambda: _support_sql("simple_topic", TEST_SQL))
def m7_report_support(spark, sf):
    return _support(_experiment(spark, sf, ["naive_bayes"]))


@register("m5_report_support", lambda: _support_sql("simple_topic", TEST_SQL))
def m5_report_support(spark, sf):
    return _support(m5_logistic_regression(spark, sf))


@register("m6_report_support", lambda: _support_sql("simple_topic", TEST_SQL))
def m6_report_support(spark, sf):
    return _support(m6_random_forest(spark, sf))


@register("m15_comparison_naive_bayes", lambda: _naive_bayes_sql("""
max(CASE WHEN class = 'accuracy' THEN f1_score END) AS accuracy,
max(CASE WHEN class = 'macro avg' THEN f1_score END) AS macro_f1,
max(CASE WHEN class = 'weighted avg' THEN f1_score END) AS weighted_f1"""))
def m15_comparison_naive_bayes(spark, sf):
    return MO.model_comparison(m4_naive_bayes(spark, sf))


@register("m15_model_comparison")
def m15_model_comparison(spark, sf):
    return MO.model_comparison(_experiment(spark, sf, MO.MODELS))


@register("m12_topic_model")
def m12_topic_model(spark, sf):
    # staged as tokens: read for the vocabulary and for the documents
    docs = materialize(fx.articles(spark, sf).filter(F.col("article").isNotNull())
                       .select("article_id", TK.token_column("article").alias("tokens")))
    vocab = TK.token_vocabulary(docs, "tokens")
    return MO.topic_model(docs, "article_id", "tokens", vocab, k=50, passes=2, top_terms=50)


@register("m14_feed_forward")
def m14_feed_forward(spark, sf):
    return MO.feed_forward(model_input(spark, sf), "article_id", "title_clean", "simple_topic")


@register("m14_report_support", lambda: _support_sql("simple_topic", NETWORK_TEST_SQL))
def m14_report_support(spark, sf):
    return _support(m14_feed_forward(spark, sf))


@register("m14_sequence_classifier")
def m14_sequence_classifier(spark, sf):
    """Embeddings of the title's token sequence (M13), pooled, into a softmax layer."""
    rows = model_input(spark, sf).select("article_id", "simple_topic", F.filter(
        F.split("title_clean", " "), lambda w: w != "").alias("tokens"))
    return SM.sequence_classifier(rows, "article_id", "tokens", "simple_topic")


@register("m14_sequence_support", lambda: _support_sql("simple_topic", NETWORK_TEST_SQL))
def m14_sequence_support(spark, sf):
    return _support(m14_sequence_classifier(spark, sf))


def _title_length_scorer(pdf):
    """A user-supplied pandas scorer (F4 example)."""
    import pandas as pd
    return pd.DataFrame({"article_id": pdf["article_id"], "title_chars": pdf["title"].str.len().astype("Int64")})


@register("f4_user_scorer", W("articles") + "SELECT article_id, CAST(length(title) AS BIGINT) AS title_chars FROM articles")
def f4_user_scorer(spark, sf):
    return SE.score_with(fx.articles(spark, sf).select("article_id", "title"), _title_length_scorer,
                         "article_id long, title_chars long")
