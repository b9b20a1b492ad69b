import pytest
from pyspark.sql import functions as F

from credtrace.operators import detect
from credtrace.plans import pipeline, queries, serving, stores
from tests.cases import frame

SF = "/root/testdata/sf0.001"


def _scans(spark):
    zero = ["files_scanned", "total_lines", "findings_count", "critical", "high", "medium", "low", "candidates_found",
            "secrets_reconstructed"]
    return queries.runs(spark, SF).withColumns({c: F.lit(1) for c in zero} | {"risk_score": F.lit(40.0)})


def test_scan_rows_are_replaced_one_by_one(spark, tmp_path):
    scans, target = _scans(spark), str(tmp_path / "scans")
    serving.write_scans(scans, target)
    serving.write_scans(scans.filter("scan_id = 'scan-3'").withColumn("findings_count", F.lit(9)), target)
    stored = {r.scan_id: r.findings_count for r in serving.read_scans(spark, target).collect()}
    assert len(stored) == scans.count() and stored["scan-3"] == 9 and stored["scan-4"] == 1


def test_audit_is_not_doubled_by_a_retry(spark, tmp_path):
    events, target = serving.audit_events(_scans(spark)), str(tmp_path / "audit")
    serving.write_audit(events, target)
    serving.write_audit(events.filter("scan_id = 'scan-3'"), target)
    assert {r.action: r.n for r in serving.audit_counts(serving.read_audit(spark, target)).collect()} == {"scan_created": 25, "scan_completed": 22}


def test_a_write_that_ends_half_way_is_not_seen(spark, tmp_path):
    target, scans = str(tmp_path / "scans"), _scans(spark)
    with pytest.raises(FileNotFoundError):
        serving.read_scans(spark, target)
    serving.write_scans(scans, target)
    fails = F.udf(lambda x: 1 // (x - x), "int")
    with pytest.raises(Exception, match="ZeroDivisionError"):
        serving.write_scans(scans.withColumn("findings_count", fails("findings_count")), target)
    prepared = stores.prepare(scans.withColumn("findings_count", F.lit(7)), target)  # killed between its rows and its commit
    assert {r.findings_count for r in serving.read_scans(spark, target).collect()} == {1}
    stores.commit(spark, target, prepared)
    assert {r.findings_count for r in serving.read_scans(spark, target).collect()} == {7}
    assert stores.discard_superseded(spark, target) == 1 and serving.read_scans(spark, target).count() == 25


def test_one_scan_is_read_from_its_partition(spark, tmp_path):
    target = str(tmp_path / "scans")
    scans = _scans(spark).withColumn("scan_id", F.format_string("%03d", F.substring("scan_id", 6, 9).cast("int")))
    serving.write_scans(scans, target)
    one = serving.read_scans(spark, target, "007")
    assert [(r.scan_id, r.repository) for r in one.collect()] == [("007", "NATION_7")]
    assert "PartitionFilters: [isnotnull(scan" in one._jdf.queryExecution().executedPlan().toString()
    assert serving.read_scans(spark, target, "none").count() == 0


def _findings(spark, text):
    return serving.safe(pipeline.full_scan(frame(spark, {"a.py": text})))


TOKEN = "ghp_" + "A1b2" * 9


def test_a_clean_scan_clears_what_it_found(spark, tmp_path):
    target, scans = str(tmp_path / "findings"), frame(spark, {"a.py": ""}).select("scan_id")
    serving.write_findings(_findings(spark, f'key = "{TOKEN}"'), target, scans)
    assert serving.read_findings(spark, target).count() == 1
    serving.write_findings(_findings(spark, "key = 1"), target, scans)
    assert serving.read_findings(spark, target).count() == 0


def test_advisories_are_written_back(spark, tmp_path):
    target = str(tmp_path / "findings")
    serving.write_findings(_findings(spark, f'key = "{TOKEN}"'), target)
    answers = serving.read_findings(spark, target).select("finding_id", F.lit("EXPLANATION: why\nIMPACT: high\nREMEDIATION: rotate\nCONFIDENCE: x").alias("response"))
    serving.store_advisories(spark, answers, target)
    row = serving.read_findings(spark, target).first()
    assert (row.ai_explanation, row.ai_remediation, row.ai_analysis_status) == ("why", "rotate", "completed")


def test_no_raw_value_of_a_file_is_in_any_of_its_rows(spark):
    lines = ["import os", f'other = "ghp_{"Z9y8" * 9}"', 'v = os.environ.get("V")', "", "", "", "", f'key = "{TOKEN}"', "", "",
             f'near = "ghp_{"Q7w6" * 9}"', "", 'w = os.environ.get("W")']
    text = "\n".join(lines)
    files = frame(spark, {"a.py": text})
    raw = {r.value for r in detect.candidates(files).collect()}
    rows = [str(r) for r in serving.safe(pipeline.full_scan(files)).collect()]
    rows += [str(r) for r in serving.report_rows(serving.safe(pipeline.full_scan(files))).collect()]
    assert len(raw) == 3 and rows and not [v for v in raw for r in rows if v in r]


def test_history_orders_and_formats(spark):
    assert [r.scan_id for r in serving.recent_scans(_scans(spark), 2).collect()] == ["scan-24", "scan-23"]
    row = serving.history(_scans(spark)).filter("repository = 'NATION_0'").first()
    assert (row.duration, row.risk_score, row.date) == ("N/A", "40.0", "2024-01-01")
    totals = serving.portfolio_totals(_scans(spark)).first()
    assert (totals.total_scans, totals.completed_scans, totals.total_high) == (25, 22, 22)


def test_portfolio_of_nothing_is_zero(spark):
    totals = serving.portfolio_totals(_scans(spark).filter("false")).first()
    assert (totals.total_scans, totals.total_findings, totals.average_risk) == (0, 0, 0.0)
