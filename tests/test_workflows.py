"""The end-to-end jobs return readable reports."""

from loanforge import workflows as wf
from loanforge.operators import models as md
from loanforge.operators.joins import JoinSpec
from loanforge.plans.fixtures import feature_table, macro_series, scored_loans
from loanforge.plans.risk_queries import driver_table, formula_score
from loanforge.sources.readers import load_table


def read(reports):
    return {k: v.count() for k, v in reports.items()}


def test_profile(spark, sf):
    n = read(wf.profile_table(feature_table(spark, sf), ["key"]))
    assert n["preview"] == 10 and n["missingness"] == 15 and n["classes"] == 2 and "leakage" in n


def test_integration_with_macro(spark, sf):
    t = {n: load_table(spark, sf, n) for n in ("orders", "customer")}
    out = wf.integrate_sources(t["orders"], t, [JoinSpec("customer", "o_custkey", "c_custkey")], macro_series(spark, sf), ["avg_price"], "o_orderdate")
    assert out["table"].count() == t["orders"].count() and "macro_avg_price" in out["table"].columns
    assert out["report"].count() == 1


def test_train_evaluate_stress_validate(spark, sf):
    roles = md.Roles("y", ("key",), ("acctbal", "price"), ("segment",))
    model, reports = wf.train_and_evaluate(feature_table(spark, sf), roles, ts="ts")
    n = read(reports)
    assert n["metrics"] == 9 and n["threshold_sweep"] == 99 and n["stability"] == 4
    s = scored_loans(spark, sf)
    assert read(wf.stress_suite(driver_table(spark, sf), formula_score, scored=s))["scenarios"] == 3
    assert read(wf.validate_scores(s, "grp"))["groups"] == 5
    assert read(wf.explain_linear(s, "key", {"price": 1e-6, "acctbal": -1e-4}))["reasons"] == s.count()
