"""Declared article schemas for the three catalog layers."""

from pyspark.sql import types as T

RAW_FIELDS = [
    ("date", T.DateType()),
    ("year", T.LongType()),
    ("month", T.LongType()),
    ("day", T.LongType()),
    ("author", T.StringType()),
    ("title", T.StringType()),
    ("article", T.StringType()),
    ("url", T.StringType()),
    ("section", T.StringType()),
    ("publication", T.StringType()),
]

TEXT_EDA_FIELDS = [
    ("title_word_count", T.LongType()),
    ("article_word_count", T.LongType()),
    ("title_textblob_sentiment", T.DoubleType()),
    ("article_textblob_sentiment", T.DoubleType()),
    ("vader_prob_positive_title", T.DoubleType()),
    ("vader_prob_negative_title", T.DoubleType()),
    ("vader_prob_neutral_title", T.DoubleType()),
    ("vader_compound_title", T.DoubleType()),
]

TOPIC_FIELDS = [("simple_topic", T.StringType())]


def _struct(fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


RAW_SCHEMA = _struct(RAW_FIELDS)
TEXT_EDA_SCHEMA = _struct(RAW_FIELDS + TEXT_EDA_FIELDS)
SIMPLE_TOPIC_SCHEMA = _struct(RAW_FIELDS + TEXT_EDA_FIELDS + TOPIC_FIELDS)

LAYER_SCHEMAS = {
    "raw": RAW_SCHEMA,
    "text_eda": TEXT_EDA_SCHEMA,
    "simple_topic": SIMPLE_TOPIC_SCHEMA,
}
