"""Filter cascades, and rare values nullified without moving the rows."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from presslens.operators import clean as N
from presslens.operators import membership


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n_yes, n_no", [(0, 50), (50, 0), (3, 40_000), (2000, 2000), (20_000, 5)])
def test_cascade_is_exact(spark, n_yes, n_no):
    rows = [(f"v{i}", None if i % 7 == 0 else i % 3, i < n_yes) for i in range(n_yes + n_no)]
    classes = spark.createDataFrame(rows, "v string, g int, yes boolean")
    kept = membership.cascade(classes, ["v", "g"], "yes")
    assert classes.filter(kept != F.col("yes")).isEmpty()
    assert n_yes == 0 or membership.cascade(classes, ["v", "g"], "yes", most_bits=10) is None


@pytest.mark.parametrize("most_sent", [N.MOST_SENT, 0])
@pytest.mark.parametrize("by", ["year", None])
def test_rare_values_become_null(spark, by, most_sent):
    """By a broadcast and, where there are too many, by a shuffle: the same as plain counting."""
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b", "", f"s{i}", f"t{i % 900}"]), "text") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, year int, section string, kept string")
    every, in_year = Counter(r[2] for r in rows), Counter(r[1:3] for r in rows)
    got = N.nullify_rare(df, "section", by, most_sent=most_sent)
    assert got.columns == df.columns
    for r, (i, year, section, _) in zip(got.orderBy("id").collect(), rows):
        rare = every[section] == 1 or (by is not None and year is not None and in_year[year, section] == 1)
        assert r["section"] == (None if rare else section), (i, year, section)


def test_no_exchange_of_article_text(spark, sf_dir):
    """Only the kept values are sent, with any number of one-off sections."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("article_id"), (F.col("doc_id") % 5).alias("year"), F.col("text").alias("article"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("one off "), F.col("doc_id").cast("string"))).otherwise(F.col("source")).alias("section"))
    cleaned = N.clean_sections(rows)
    p = _plan(cleaned)
    assert p.count("Exchange") == p.count("BroadcastExchange") == 1 and "BroadcastHashJoin" in p
    assert 0 < cleaned.count() < rows.count()
