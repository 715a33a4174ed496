"""Physical plans: pruned scans, no nested loops, no row-at-a-time Python."""

import pytest

from loanforge.plans.catalog import all_queries

CHECKED = [
    "c1_missingness", "c10_class_distribution", "d4_left_join_suffix", "d5_join_report", "d7_as_of_month", "e2_stratified_split", "e3_split_stats",
    "g4_information_value", "g10_univariate_gini", "h3_ead_schedule", "h8_ecl_by_stage", "j6_auc_gini", "j15_heteroscedasticity", "j20_metric_table",
    "k3_top_drivers", "l3_all_scenarios", "m1_group_performance", "n4_evaluation_rules", "n8_validation_data_checks", "o1_section_chunks", "o4_keyword_rules",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_slow_operators(spark, sf, name):
    p = plan(all_queries()[name](spark, sf))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in p


def test_scan_reads_only_what_is_used(spark, sf):
    p = plan(all_queries()["j10_brier"](spark, sf))
    assert "o_orderpriority" not in p and "c_mktsegment" not in p and "o_orderdate" not in p


def test_chunking_has_no_shuffle(spark, sf):
    from loanforge.operators.documents import section_chunks
    from loanforge.sources.readers import load_table

    assert "Exchange" not in plan(section_chunks(load_table(spark, sf, "documents")))


def test_filter_reaches_the_scan(spark, sf):
    from pyspark.sql import functions as F

    from loanforge.operators.joins import JoinSpec, integrate
    from loanforge.sources.readers import load_table

    t = {n: load_table(spark, sf, n) for n in ("orders", "customer")}
    j = integrate(t["orders"], t, [JoinSpec("customer", "o_custkey", "c_custkey", "inner")]).where(F.col("c_acctbal") > 0).select("o_orderkey")
    assert "GreaterThan(c_acctbal,0.0)" in plan(j)
