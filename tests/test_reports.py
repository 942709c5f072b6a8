"""Reports that earlier rounds lacked, on a few receipts."""

from tracequarry.plans import report
from tracequarry.sources.fixtures import receipts

SF = "/root/testdata/sf0.001"


def test_grid_years_and_domains(spark):
    rows = receipts(spark, SF).where("problem_id < 300").selectExpr("*", "CASE WHEN is_correct AND problem_id % 11 = 0 THEN 'sympy_symbolic' ELSE 'string_exact' END AS verification_method").cache()
    text = report.proxy_report(rows)
    assert text.count("\n| ") >= 6 * 4 + 6 and "auc_proxy" in text and "choke_factor" in text and "| 2048 |" in text
    assert "rescued" in report.evaluation_report(rows) and "Saved energy" in report.evaluation_report(rows)
    years = report.yearly_summary(rows, {1901: {"accuracy": 12.5, "mean_tokens": 77.0}})
    assert "| 1901 | 0 | 12.5 | 77.0 | given |" in years and years.count("measured") == rows.select("year").distinct().count()
    domains = report.domain_summary(rows, {"1-URGENT": "bypass"})
    assert "bypass" in domains and domains.count("| none |") == rows.select("category").distinct().count() - 1
    assert report.domain_summary(rows, {}).count("| none |") == rows.select("category").distinct().count()
