"""Driver contract: entry, queries and oracle keys."""

import re

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["publication", "simple_topic", "date", "weighted_avg_published_ratio",
                          "weighted_avg_sentiment_ratio", "bias_score"]
    assert df.count() > 100 and df.filter("bias_score IS NULL").isEmpty()


def test_oracles_have_queries():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    for name in qs:
        assert name == "pipeline" or re.fullmatch(r"[a-z]+\d+_[a-z0-9_]+", name), name


def test_survey_coverage():
    """Every operator id of SURVEY §2 has at least one registered query."""
    ids = {n.split("_")[0] for n in E.queries()}
    expected = (
        [f"s{i}" for i in range(1, 13)] + [f"n{i}" for i in range(1, 13)]
        + [f"p{i}" for i in range(1, 13)] + [f"j{i}" for i in range(1, 10)]
        + [f"a{i}" for i in range(1, 17)] + [f"g{i}" for i in range(1, 10)] + ["w1"]
        + [f"o{i}" for i in range(1, 7)] + ["u1", "u2", "u3"] + [f"x{i}" for i in range(1, 14)]
        + [f"d{i}" for i in range(1, 19) if i != 2] + ["d2"] + [f"m{i}" for i in range(1, 16)]
        + ["t1", "f4"]
    )
    missing = sorted(set(expected) - ids)
    assert not missing, missing
