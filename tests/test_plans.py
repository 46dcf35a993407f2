"""Physical plan shape of the main jobs."""

import __spark_entry__ as E

Q = E.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_d1_d4_no_python_and_no_cartesian(spark, sf_dir):
    for name in ("d1_section_topics", "d4_geo_sections", "d3_text_enrichment"):
        p = plan(Q[name](spark, sf_dir))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_d14_shuffles_fact_table_once(spark, sf_dir):
    p = plan(Q["d14_bias_score"](spark, sf_dir))
    assert p.count("orders.parquet") == 1
    assert "SortMergeJoin" not in p


def test_scan_prunes_columns(spark, sf_dir):
    p = plan(Q["a9_global_max"](spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint>" in p or "ReadSchema: struct<doc_id:bigint,source" not in p


def test_j5_is_anti_join(spark, sf_dir):
    assert "LeftAnti" in plan(Q["j5_left_anti_spike"](spark, sf_dir))
