"""Features and evaluation for the classifiers.

Everything is relational (explode, aggregate, join) so that it runs
distributed and can be checked against SQL; the MLlib estimators in
``models`` consume the same semantics through Spark's feature stages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lookup import let, look_up, look_up_all, token_counts, word_table
from ..operators.stats import range_numbered

# Fixed values of the modelling setup.
TFIDF_TOKEN = r"(?U)\b\w\w+\b"   # tokens of two or more word characters
TEST_PCT = 20
SPLIT_SEED = 50
BALANCE_FRACTION = 0.05
SEQ_NUM_WORDS = 10_000
OOV_ID = 1


def tfidf_tokens(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(F.lower(c), F.lit(TFIDF_TOKEN), 0)


def tfidf_relational(df: DataFrame, key: str, text: str, max_features: int) -> DataFrame:
    """M1: (key, term, weight) with raw term counts, smoothed idf
    ln((1+n)/(1+df))+1, L2-normalised per document, over the
    ``max_features`` terms with the largest corpus counts (ties by term).

    Terms are counted inside each document's row; only (term, partial counts)
    are shuffled for the vocabulary, which then comes back to the rows as a
    word table (at most ``max_features`` entries). Norms are sums inside the row.
    """
    docs = df.filter(F.col(text).isNotNull()).select(key, token_counts(tfidf_tokens(text)).alias("_tf"))
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    stats = docs.select(F.explode("_tf").alias("t")).groupBy("t.term").agg(
        F.sum("t.tf").alias("_total"), F.count(F.lit(1)).alias("df"))
    vocab = stats.orderBy(F.desc("_total"), "term").limit(max_features) \
        .select("term", (F.log((F.lit(1.0) + n_docs) / (F.col("df") + 1)) + 1).alias("idf"))
    weights = let(F.col("_idf"), lambda idf: F.filter(
        F.transform("_tf", lambda t: F.struct(t["term"].alias("term"), (t["tf"] * look_up(idf, t["term"])).alias("w"))),
        lambda x: x["w"].isNotNull()))
    normed = let(weights, lambda ws: let(
        F.sqrt(F.aggregate(ws, F.lit(0.0), lambda acc, x: acc + x["w"] * x["w"])),
        lambda norm: F.transform(ws, lambda x: F.struct(x["term"].alias("term"), (x["w"] / norm).alias("weight")))))
    return docs.withColumn("_idf", word_table(vocab, "term", "idf")).select(key, F.explode(normed).alias("t")) \
        .select(key, "t.term", "t.weight")


def split_flag(id_col: str, seed: int = SPLIT_SEED, test_pct: int = TEST_PCT) -> Column:
    """M2: repeatable hash split; True for the test part. Portable integer
    hash of the id, so the same split can be reproduced in SQL."""
    h = F.pmod(F.col(id_col) * F.lit(1103515245) + F.lit(12345 + seed), F.lit(2147483648))
    return F.pmod(h, F.lit(100)) < test_pct


#: Draws of a class that one row of the draw plan stands for.
DRAW_BLOCK = 10_000


def _draws(classes: DataFrame, label: str, t: Column, seed: int) -> DataFrame:
    """(label, row number) of t draws per class: blocks first, then the draws
    of each block, so no array grows with t. Draw j of class c is row
    ``h mod n + 1`` with h the first 52 bits of md5("c:j:seed")."""
    blocks = classes.withColumn("_t", t).filter(F.col("_t") > 0).select(label, "_n", "_t", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("_t") - 1) / DRAW_BLOCK))).alias("_block")).repartition(label, "_block")
    draws = blocks.select(label, "_n", F.explode(F.sequence(
        F.col("_block") * DRAW_BLOCK + 1, F.least(F.col("_t"), (F.col("_block") + 1) * DRAW_BLOCK))).alias("_draw"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(label).cast("string"), F.col("_draw").cast("string"),
                                             F.lit(str(seed)))), 1, 13), 16, 10).cast("bigint")
    return draws.select(label, (F.pmod(h, F.col("_n")) + 1).alias("_rn"))


def balance_classes(df: DataFrame, label: str, key: str, fraction: float = BALANCE_FRACTION,
                    seed: int = 42) -> DataFrame:
    """M3: t = int(fraction x largest class); classes with more than t rows
    are kept and each is resampled to exactly t rows with replacement.

    Rows are numbered by ``key`` within their class; draws and numbered rows
    meet in an equi-join on (class, row number), so a dominant class is spread
    over many tasks.
    """
    base = df.filter(F.col(label).isNotNull())
    counts = base.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    t = counts.select((F.max("_n") * F.lit(fraction)).cast("bigint")).scalar()
    kept = counts.withColumn("_cut", t).filter(F.col("_n") > F.col("_cut")).drop("_cut")
    numbered = range_numbered(base.join(kept.select(label), label, "left_semi"), [label], [key], "_rn")
    return numbered.join(_draws(kept, label, t, seed), [label, "_rn"]).drop("_rn")


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M8: per class precision, recall, f1 and support, plus accuracy,
    macro and weighted averages (0 where a ratio is undefined).

    One aggregate of (label, prediction) pairs; all further work runs on
    that confusion table, whose size is bounded by classes squared.
    """
    conf = pred.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    by_label = conf.groupBy(F.col("l").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    by_pred = conf.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("predicted"))
    cls = by_label.join(by_pred, "class", "full_outer").select(
        "class", F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("tp", F.lit(0)).alias("tp"),
        F.coalesce("predicted", F.lit(0)).alias("predicted"))
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    per = cls.select("class", p.alias("precision"), r.alias("recall"), "support", "tp")
    per = per.withColumn("f1_score", F.when(F.col("precision") + F.col("recall") > 0,
                                            2 * F.col("precision") * F.col("recall")
                                            / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0)))
    total = F.sum("support")
    summary = per.agg(
        (F.sum("tp") / total).alias("accuracy"), total.alias("total"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / total).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / total).alias("wr"),
        (F.sum(F.col("f1_score") * F.col("support")) / total).alias("wf"),
    )
    def row(name, prec, rec, f1):
        return F.struct(F.lit(name).alias("class"), prec.cast("double").alias("precision"),
                        rec.cast("double").alias("recall"), f1.cast("double").alias("f1_score"),
                        F.col("total").cast("bigint").alias("support"))
    rows = summary.select(F.explode(F.array(
        row("accuracy", F.lit(None), F.lit(None), F.col("accuracy")),
        row("macro avg", F.col("mp"), F.col("mr"), F.col("mf")),
        row("weighted avg", F.col("wp"), F.col("wr"), F.col("wf")),
    )).alias("r")).select("r.*")
    return per.select("class", "precision", "recall", "f1_score", F.col("support").cast("bigint")).unionByName(rows)


def weighted_scores(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M9: (accuracy, weighted precision, weighted recall, weighted f1)."""
    rep = classification_report(pred, label, prediction)
    return rep.agg(
        F.max(F.when(F.col("class") == "accuracy", F.col("f1_score"))).alias("accuracy"),
        F.max(F.when(F.col("class") == "weighted avg", F.col("precision"))).alias("precision"),
        F.max(F.when(F.col("class") == "weighted avg", F.col("recall"))).alias("recall"),
        F.max(F.when(F.col("class") == "weighted avg", F.col("f1_score"))).alias("f1"),
    )


def word_index(df: DataFrame, tokens: str, num_words: int = SEQ_NUM_WORDS) -> DataFrame:
    """M13 vocabulary: words by frequency (ties by word), ids from 2 (1 is
    out-of-vocabulary); ids below ``num_words`` are kept. The ranking runs
    on a top-k of the frequency table, bounded by ``num_words``."""
    freq = df.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("_c"))
    top = freq.orderBy(F.desc("_c"), "word").limit(max(num_words - 2, 0))
    return top.select("word", (F.row_number().over(Window.orderBy(F.desc("_c"), "word")) + 1).cast("int").alias("id"))


def sequences(df: DataFrame, key: str, tokens: str, vocab: DataFrame, max_len: int,
              carry: Sequence[str] = ()) -> DataFrame:
    """Token ids (1 for unknown words), the last ``max_len`` kept,
    zero-padded at the end to ``max_len``; columns to ``carry`` stay. The array is cut before the words
    are looked up; all inside the row (the vocabulary has ``num_words``
    entries at most)."""
    kept = F.when(F.size(tokens) > max_len, F.slice(tokens, -max_len, max_len)).otherwise(F.col(tokens))
    ids = F.transform(look_up_all(F.col("_vocab"), F.col("_kept")), lambda i: F.coalesce(i, F.lit(OOV_ID)))
    padded = F.concat("_ids", F.array_repeat(F.lit(0), F.lit(max_len) - F.size("_ids")))
    return (df.select(key, *carry, kept.alias("_kept")).withColumn("_vocab", word_table(vocab, "word", "id"))
            .select(key, *carry, ids.alias("_ids"))
            .select(key, *carry, F.coalesce(padded, F.array_repeat(F.lit(0), max_len)).alias("sequence")))
