"""Scans from a tree to their stored rows, with files that cannot be read and scans that fail."""

from pyspark.sql import functions as F

from credtrace.plans import pipeline, runs, serving, stores
from credtrace.sources import corpus
from tests.cases import CASES, frame

TOKEN = "ghp_" + "A1b2" * 9


def test_an_unreadable_file_is_a_row_and_the_scan_finishes(spark, tmp_path):
    root, folder = tmp_path / "tree", str(tmp_path / "store")
    (root / "sub").mkdir(parents=True)
    (root / "a.py").write_text(f'key = "{TOKEN}"')
    (root / "sub" / "gone.py").write_text("x = 1")
    (root / "sub" / "clean.py").write_text("y = 1\nz = 2")
    files = corpus.scan_tree(spark, str(root), "s1", "repo")
    (root / "sub" / "gone.py").unlink()  # listed, and not there when it is read
    assert runs.run(files, "s1", "repo", folder) == "completed"
    failed = stores.read(spark, f"{folder}/failures").collect()
    assert [(r.scan_id, r.file_path, r.stage) for r in failed] == [("s1", "sub/gone.py", "read")] and "No such file" in failed[0].message
    row = serving.read_scans(spark, f"{folder}/scans").first()
    assert (row.status, row.error, row.files_scanned, row.files_failed, row.total_lines, row.findings_count) == ("completed", "", 2, 1, 3, 1)
    assert [r.secret_type for r in serving.read_findings(spark, f"{folder}/findings").collect()] == ["GitHub Personal Access Token"]
    assert {r.action for r in serving.read_audit(spark, f"{folder}/audit").collect()} == {"scan_created", "scan_completed"}


def test_a_missing_root_is_a_failure(spark, tmp_path):
    folder = str(tmp_path / "store")
    assert runs.run_directory(spark, str(tmp_path / "nowhere"), "s2", "repo", folder) == "completed"
    assert stores.read(spark, f"{folder}/failures").count() == 1
    row = serving.read_scans(spark, f"{folder}/scans").first()
    assert (row.files_scanned, row.files_failed, row.findings_count) == (0, 1, 0)


def test_a_failed_scan_says_why_and_keeps_what_was_found(spark, tmp_path):
    folder = str(tmp_path / "store")
    assert runs.run(frame(spark, {"a.py": f'key = "{TOKEN}"'}), "s", "repo", folder) == "completed"
    broken = frame(spark, {"a.py": "x"}).withColumn("content", F.when(F.length("content") > 0, F.raise_error(F.lit("disk full"))))
    assert runs.run(broken, "s", "repo", folder) == "failed"
    row = serving.read_scans(spark, f"{folder}/scans").first()
    assert row.status == "failed" and "disk full" in row.error and row.findings_count == 0
    assert serving.read_findings(spark, f"{folder}/findings").count() == 1
    assert {r.action for r in serving.read_audit(spark, f"{folder}/audit").collect()} == {"scan_created"}


def test_stored_rows_are_those_of_the_scan(spark, tmp_path):
    folder, files = str(tmp_path / "store"), frame(spark)
    runs.run(files, "s", "repo", folder)
    want = serving.safe(pipeline.full_scan(files))
    stored = serving.read_findings(spark, f"{folder}/findings")
    columns = ["file_path", "finding_id", "masked_secret", "risk_score", "severity", "code_context", "propagation_path", "ord"]
    assert sorted(map(repr, stored.select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))
    row = serving.read_scans(spark, f"{folder}/scans").first()
    assert (row.files_scanned, row.findings_count) == (len(CASES), want.count())


def test_a_flat_directory_is_listed_in_pieces(spark, tmp_path, monkeypatch):
    for k in range(57):
        (tmp_path / f"f{k}.py").write_text("x = 1")
    monkeypatch.setattr(corpus, "ENTRIES", 10)
    import pandas as pd
    pieces = list(corpus._lister(str(tmp_path))([pd.DataFrame({"path": [str(tmp_path), str(tmp_path / "none")]})]))
    assert [len(p) for p in pieces] == [10, 10, 10, 10, 10, 7, 1] and pieces[-1]["error"].notna().all()
    assert corpus.scan_directory(spark, str(tmp_path), "s", "r").count() == 57
