"""Token frequencies, vocabularies and bags of words.

Tokens are exploded in place; frequency tables are partial aggregates, so
a very frequent token never concentrates rows in one task before the
map-side combine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lookup import token_counts
from ..functions.text import remove_stop_words, simple_tokens
from ..operators.stats import with_share
from ..session import materialize


def token_column(text: str) -> "F.Column":
    """LDA preprocessing: X5 tokens without English stop words (no "news")."""
    return remove_stop_words(simple_tokens(F.col(text)))


def token_frequencies(df: DataFrame, text: str, k: int | None = 10) -> DataFrame:
    """Most frequent tokens of a text column (ties by token)."""
    freq = df.filter(F.col(text).isNotNull()).select(F.explode(token_column(text)).alias("token")) \
        .groupBy("token").agg(F.count(F.lit(1)).alias("count"))
    return freq.orderBy(F.desc("count"), "token").limit(k) if k else freq


def counted_documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, counts) for every document with a text: its tokens with their
    numbers, counted inside the row. Written as a stage, so that vocabulary
    and bags both read it and the text is tokenised once."""
    return materialize(df.filter(F.col(text).isNotNull())
                       .select(key, token_counts(token_column(text)).alias("counts")))


def document_frequency(df: DataFrame, text: str) -> DataFrame:
    """(token, df): number of documents containing each token. A document
    gives each of its tokens once; partial counts are all that is shuffled."""
    return df.filter(F.col(text).isNotNull()).select(F.explode(F.array_distinct(token_column(text))).alias("token")) \
        .groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def _numbered(freq: DataFrame, n_docs: "F.Column", no_below: int, no_above: float, keep_n: int) -> DataFrame:
    kept = freq.filter((F.col("df") >= no_below) & (F.col("df") <= n_docs * F.lit(no_above)))
    top = kept.orderBy(F.desc("df"), "token").limit(keep_n)
    # at most keep_n rows: the numbering window runs over a bounded table
    return top.withColumn("token_id", (F.row_number().over(Window.orderBy(F.desc("df"), "token")) - 1).cast("bigint"))


def vocabulary(df: DataFrame, text: str, no_below: int = 10, no_above: float = 0.1,
               keep_n: int = 100_000) -> DataFrame:
    """Tokens in at least ``no_below`` documents and at most a
    ``no_above`` fraction of them, the ``keep_n`` most frequent by
    document frequency; ids 0.. by (df desc, token). ``keep_n`` is the
    vocabulary size the job asks for, not a sample of the data."""
    n_docs = df.filter(F.col(text).isNotNull()).select(F.count(F.lit(1))).scalar()
    return _numbered(document_frequency(df, text), n_docs, no_below, no_above, keep_n)


def token_vocabulary(docs: DataFrame, tokens: str, no_below: int = 10, no_above: float = 0.1,
                     keep_n: int = 100_000) -> DataFrame:
    """M10 over documents that are token lists already."""
    freq = docs.select(F.explode(F.array_distinct(tokens)).alias("token")) \
        .groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return _numbered(freq, docs.select(F.count(F.lit(1))).scalar(), no_below, no_above, keep_n)


def counted_vocabulary(counted: DataFrame, no_below: int = 10, no_above: float = 0.1,
                       keep_n: int = 100_000) -> DataFrame:
    """M10 over ``counted_documents``."""
    freq = counted.select(F.explode("counts.term").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return _numbered(freq, counted.select(F.count(F.lit(1))).scalar(), no_below, no_above, keep_n)


def bag_of_words(counted: DataFrame, key: str, vocab: DataFrame) -> DataFrame:
    """(document, token_id, count) of ``counted_documents`` over the
    vocabulary, which is bounded by ``keep_n`` and broadcast. The documents
    are not shuffled."""
    vocab = F.broadcast(vocab.select("token", "token_id"))  # at most keep_n rows
    terms = counted.select(key, F.explode("counts").alias("t")) \
        .select(key, F.col("t.term").alias("token"), F.col("t.tf").cast("bigint").alias("count"))
    return terms.join(vocab, "token").select(key, "token_id", "count")


def token_shares(df: DataFrame, text: str) -> DataFrame:
    """Share of each token among all tokens (A2 over exploded tokens)."""
    return with_share(token_frequencies(df, text, None), "count", "share")
