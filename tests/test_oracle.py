"""Every query with an oracle matches DuckDB on the fixture data."""

import os

import pytest

import __spark_entry__ as E
from oracle_check import compare
from presslens import fixtures as fx
from presslens.sources import io as IO

SQL = {k: v for k, v in E.oracle_sql().items() if not k.startswith("op")}
QUERIES = {k: v for k, v in E.queries().items() if not k.startswith("op") and k != "pipeline"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, sf_dir, name):
    res = compare(spark, name, QUERIES[name], SQL[name], sf_dir)
    assert res["status"] == "ok", res


SUMMARIES = {"accuracy", "macro avg", "weighted avg"}
REPORTS = ["m4_naive_bayes", "m5_logistic_regression", "m6_random_forest", "m14_feed_forward"]


@pytest.mark.parametrize("name", REPORTS)
def test_reports_cover_every_test_row(spark, sf_dir, name):
    """Classes of the test part or of the training part, no other; supports add up; better than nothing."""
    rows = QUERIES[name](spark, sf_dir).collect()
    classes = {r["class"]: r for r in rows if r["class"] not in SUMMARIES}
    known = {r[0] for r in fx.articles(spark, sf_dir).select("simple_topic").distinct().collect()}
    assert set(classes) <= known and len(classes) == 5
    total = {r["support"] for r in rows if r["class"] in SUMMARIES}
    assert total == {sum(r["support"] for r in classes.values())}
    assert all(0 <= (r["f1_score"] or 0) <= 1 for r in rows) and max(r["recall"] for r in classes.values()) > 0


def test_topic_model_rows(spark, sf_dir):
    rows = QUERIES["m12_topic_model"](spark, sf_dir).collect()
    assert len(rows) == 50 * 50 and {r["topic"] for r in rows} == set(range(50))


@pytest.mark.parametrize("approx, exact, near", [("a4_mean_median_approx", "a4_mean_median", 0.02),
                                                 ("a8_count_distinct_approx", "a8_count_distinct", 0.05)])
def test_approximate_variants_are_near(spark, sf_dir, approx, exact, near):
    """The same rows; every number within ``near`` of the exact one."""
    def table(name):
        return sorted((tuple(r) for r in QUERIES[name](spark, sf_dir).collect()), key=str)
    got, want = table(approx), table(exact)
    assert len(got) == len(want) > 0
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or abs(x - y) <= near * max(1.0, abs(y))


def test_file_choice_and_inventory(spark, sf_dir):
    some = QUERIES["s4_limited_file_read"](spark, sf_dir).select("article_id").collect()
    assert 0 < len(some) < spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    listed = QUERIES["s8_file_inventory"](spark, sf_dir).collect()
    assert sorted(os.path.basename(r["path"]) for r in listed) == sorted(f for f in os.listdir(sf_dir) if f.endswith(".parquet"))
    assert all(r["length"] == os.path.getsize(f"{sf_dir}/{os.path.basename(r['path'])}") for r in listed)


def _files_read(df) -> list[int]:
    """Files that the scans of the executed plan have read."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        step = todo.pop()
        if step.nodeName() == "AdaptiveSparkPlan":
            todo.append(step.executedPlan())
        if step.nodeName().startswith("Scan"):
            found.append(step.metrics().apply("numFiles").value())
        todo += [step.children().apply(i) for i in range(step.children().size())]
    return found


def test_only_the_chosen_files_are_read(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(1000).repartition(10).write.parquet(path)
    for n, shuffle in ((3, False), (3, True), (1, True)):
        assert _files_read(IO.read_files(spark, path, n, shuffle)) == [n]
    assert _files_read(IO.read_files(spark, path, 99, True)) == [10] and IO.read_files(spark, path, 99).count() == 1000
    some = [IO.read_files(spark, path, 3, True, seed).select("_metadata.file_name").distinct().collect() for seed in (1, 1, 2, 3, 4)]
    assert sorted(some[0]) == sorted(some[1]) and any(sorted(x) != sorted(some[0]) for x in some[2:])
    assert IO.read_files(spark, path, 0).count() == 0


def test_random_split(spark, sf_dir):
    ids = [r[0] for r in QUERIES["m2_random_split"](spark, sf_dir).collect()]
    assert len(ids) == len(set(ids)) and 0.1 < len(ids) / 1000 < 0.3


def test_score_pivot_has_every_publication(spark, sf_dir):
    known = {r[0] for r in fx.articles(spark, sf_dir).select("publication").distinct().collect()} - {None, ""}
    assert set(QUERIES["g5_monthly_score_pivot_all"](spark, sf_dir).columns) == {"date"} | known


@pytest.mark.parametrize("name", ["m7_title_author", "m7_article_author", "m7_title_topic_balanced"])
def test_experiments_fit_every_model(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).filter("class = 'accuracy'").collect()
    assert sorted(r["model"] for r in got) == ["logistic_regression", "naive_bayes", "random_forest"]
