"""The report trains all targets together on the operator's own schedule."""

from gaugeline.queries import catalog

FOLDER = "/root/testdata/sf0.001"


def test_no_schedule_of_its_own(monkeypatch):
    asked = []
    monkeypatch.setattr(catalog, "_training_rows", lambda spark, folder: "rows")
    monkeypatch.setattr(catalog, "train_targets", lambda *a, **options: asked.append((a, options)) or ([], {}))
    monkeypatch.setattr(catalog, "metrics_report", lambda spark, models, failures: "report")
    assert catalog.QUERIES["model_report"](None, "folder") == "report"
    assert asked == [(("rows",), {"tiebreak": ["event_id"]})]


def test_a_whole_report(spark):
    """Every target gets a model or a reason, and its rows add up."""
    report = {r["target"]: r for r in catalog.QUERIES["model_report"](spark, FOLDER).collect()}
    assert len(report) == 11
    for r in report.values():
        if r["failure"] is None:
            assert r["mae_test"] > 0 and r["mae_validation"] > 0 and len(r["feature_cols"]) >= 8
            assert min(r["train_rows"], r["validation_rows"], r["test_rows"]) >= 5
    assert sum(r["failure"] is None for r in report.values()) >= 6
