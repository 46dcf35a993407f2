"""Lexicon sentiment and text enrichment.

The scores are defined over the tokens of one text and a valence table
``(word, valence)`` supplied as input (SURVEY §2.11.2):

* polarity = mean valence of the matched words (0 when none match);
* for titles also s = sum of valences, compound = s / sqrt(s^2 + 15),
  and the shares pos = sum(v+1 | v>0), neg = sum(|v|+1 | v<0), neu = number
  of tokens without (or with zero) valence, each over their total.

Null text gives null scores; a text without tokens gives 0 everywhere.
Plan: everything happens inside the row. Tokens look their valence up in the
word table (``functions.lookup``), so no text is shuffled, no row key is
needed and nothing runs before an action. The valence table has word-list size
and is sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lookup import let, look_up, look_up_all, word_table
from ..functions.text import simple_tokens, word_count
from ..resources import NEGATORS, VALENCE

COMPOUND_ALPHA = 15.0  # normalisation constant of the compound score


def valence_table(spark: SparkSession, valence: dict[str, float] | None = None) -> DataFrame:
    items = sorted((valence or VALENCE).items())
    return spark.createDataFrame(items, "word string, valence double")


def _valences(toks: Column, table: Column, negate: bool, negators: Iterable[str]) -> Column:
    """Valence of every token (null without one); with ``negate`` its sign is
    turned if one of the three tokens before it is a negator."""
    if not negate:
        return look_up_all(table, toks)
    negs = F.array(*[F.lit(w) for w in negators])

    def turned(all_: Column, words: Column) -> Column:
        return F.transform(all_, lambda t, i: F.when(
            F.arrays_overlap(F.slice(all_, F.greatest(F.lit(1), i - 2), F.least(F.lit(3), i)), negs),
            -look_up(words, t)).otherwise(look_up(words, t)))
    return let(table, lambda words: let(toks, lambda all_: turned(all_, words)))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _scores(p: str, with_shares: bool):
    """Scores of a text from its sums, named with prefix ``p``."""
    def scores(x: Column) -> Column:
        cols = [F.when(x["hits"] > 0, x["s"] / x["hits"]).otherwise(F.lit(0.0)).alias(f"{p}polarity")]
        if with_shares:
            neu = (x["n"] - x["valued"]).cast("double")
            total = x["pos"] + x["neg"] + neu
            cols += [F.when(total > 0, part / total).otherwise(F.lit(0.0)).alias(f"{p}{name}")
                     for name, part in (("pos", x["pos"]), ("neg", x["neg"]), ("neu", neu))]
            cols.append((x["s"] / F.sqrt(x["s"] * x["s"] + F.lit(COMPOUND_ALPHA))).alias(f"{p}compound"))
        return F.struct(*cols)
    return scores


def score_texts(df: DataFrame, texts: dict[str, str], valence: DataFrame,
                shares: Iterable[str] = (), negate: bool = False,
                negators: Iterable[str] = NEGATORS) -> DataFrame:
    """Score several text columns. ``texts`` maps an output prefix to a text
    column; prefixes in ``shares`` also get the pos/neg/neu shares and the
    compound score. Each text is tokenised once."""
    shares, negators = set(shares), tuple(negators)
    out = df.withColumn("_words", word_table(valence, "word", "valence"))
    for p, c in texts.items():
        toks = F.coalesce(simple_tokens(F.col(c)), F.array().cast("array<string>"))
        found = let(toks, lambda t: F.struct(F.size(t).alias("n"), F.filter(
            _valences(t, F.col("_words"), negate, negators), lambda v: v.isNotNull()).alias("v")))
        sums = let(found, lambda x: F.struct(
            x["n"].alias("n"), F.size(x["v"]).alias("hits"), _total(x["v"]).alias("s"),
            _total(F.transform(F.filter(x["v"], lambda v: v > 0), lambda v: v + 1)).alias("pos"),
            _total(F.transform(F.filter(x["v"], lambda v: v < 0), lambda v: 1 - v)).alias("neg"),
            F.size(F.filter(x["v"], lambda v: v != 0)).alias("valued")))

        out = out.withColumn("_scores", F.when(F.col(c).isNotNull(), let(sums, _scores(p, p in shares))))
        fields = ["polarity", *(("pos", "neg", "neu", "compound") if p in shares else ())]
        out = out.withColumns({f"{p}{f}": F.col("_scores").getField(f"{p}{f}") for f in fields}).drop("_scores")
    return out.drop("_words")


def enrich_text(df: DataFrame, valence: DataFrame, negate: bool = False) -> DataFrame:
    """D3: word counts and sentiment columns of the ``text_eda`` layer."""
    out = df.withColumns({"title_word_count": word_count("title"), "article_word_count": word_count("article")})
    out = score_texts(out, {"_t_": "title", "_a_": "article"}, valence, shares=["_t_"], negate=negate)
    return out.withColumnsRenamed({
        "_t_polarity": "title_textblob_sentiment",
        "_a_polarity": "article_textblob_sentiment",
        "_t_pos": "vader_prob_positive_title",
        "_t_neg": "vader_prob_negative_title",
        "_t_neu": "vader_prob_neutral_title",
        "_t_compound": "vader_compound_title",
    })


def score_with(df: DataFrame, fn, schema: str) -> DataFrame:
    """apply a user-supplied pandas scorer to Arrow batches of rows
    (``mapInPandas``); ``fn(pandas.DataFrame) -> pandas.DataFrame``."""
    def run(batches):
        for pdf in batches:
            yield fn(pdf)
    return df.mapInPandas(run, schema)
