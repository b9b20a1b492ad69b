"""A scan from its files to its stored rows: findings, figures, failures, events."""

from __future__ import annotations

import datetime
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credtrace.functions import catalog as C
from credtrace.plans import pipeline, serving, stores
from credtrace.sources import corpus

SCAN = "scan_id string, repository string, status string, scan_duration double, created_at timestamp, error string"
FIGURES = ("total_files", "total_lines", "total_bytes", *pipeline.COUNTS)


def failures(rows: DataFrame) -> DataFrame:
    """(scan_id, file_path, stage, message) of what could not be read, from the rows of ``pipeline.scan_rows``."""
    return rows.filter(F.col("file.error").isNotNull()).select("scan_id", "file_path", F.lit("read").alias("stage"), F.col("file.error").alias("message"))


def figures(rows: DataFrame) -> DataFrame:
    """Figures of scans from the rows of ``pipeline.scan_rows``; files that could not be read are counted apart."""
    files = rows.filter(F.col("file").isNotNull()).select("scan_id", "file_path", "file.*")
    read = pipeline.summed(files.filter("error IS NULL").select("*", "compared.*").drop("compared", "error"))
    failed = files.groupBy("scan_id").agg(F.count_if(F.col("error").isNotNull()).alias("files_failed"))
    # The scans of one run.
    return failed.join(read.drop("languages", *pipeline.COMPARED), "scan_id", "left").na.fill(0)


def run(files: DataFrame, scan_id: str, repository: str, folder: str, rules=C.DETECTION_RULES, allow_test_files: bool = False) -> str:
    """Scan ``files`` and store the scan below ``folder``: findings, failures, one scan row, events. Returns its status.

    The files are read once: the rows of that pass, without raw values, go to the shared folder, and all tables are made from these.
    A file that cannot be read is a failure row, the scan goes on. Where the scan itself fails, its row has the status failed and
    the error, and findings of an earlier run stay as they were.
    """
    spark, began = files.sparkSession, time.time()
    created = datetime.datetime.now(datetime.timezone.utc)
    one = lambda status, error: spark.createDataFrame([(scan_id, repository, status, time.time() - began, created, error)], SCAN)
    scan = spark.createDataFrame([(scan_id,)], "scan_id string")
    try:
        path = corpus.shared_folder(spark)
        safe_rows(files, rules, allow_test_files).write.parquet(path)
        rows = spark.read.parquet(path)
        serving.write_findings(rows.filter(F.col("finding_id").isNotNull()).drop("file"), f"{folder}/findings", scan)
        stores.write(failures(rows), f"{folder}/failures", scan)
        done = one("completed", "").join(figures(rows), "scan_id", "left").na.fill(0)
        status = "completed"
    except Exception as error:  # noqa: BLE001 - whatever it is, it belongs on the scan's row
        done, status = one("failed", str(error).splitlines()[0][:2000] if str(error) else type(error).__name__), "failed"
    zero = {c: F.lit(0).cast("bigint") for c in (*FIGURES, "files_failed") if c not in done.columns}
    done = done.withColumns(zero | ({"risk_score": F.lit(0.0)} if "risk_score" not in done.columns else {})).withColumnRenamed("total_files", "files_scanned")
    columns = ["scan_id", "repository", "status", "error", "scan_duration", "created_at", "files_failed", "files_scanned", *FIGURES[1:], "risk_score"]
    serving.write_scans(done.select(*columns), f"{folder}/scans")
    serving.write_audit(serving.audit_events(serving.read_scans(spark, f"{folder}/scans", scan_id)), f"{folder}/audit")
    return status


def safe_rows(files: DataFrame, rules=C.DETECTION_RULES, allow_test_files: bool = False) -> DataFrame:
    """The rows of ``pipeline.scan_rows`` without raw values."""
    rows = pipeline.scan_rows(files, rules, allow_test_files)
    return rows.select("file", *serving.safe_columns())


def run_directory(spark: SparkSession, root: str, scan_id: str, repository: str, folder: str, **limits) -> str:
    """``run`` over a directory tree; a directory that cannot be listed, the root too, is a failure row."""
    return run(corpus.scan_tree(spark, root, scan_id, repository, **limits), scan_id, repository, folder)
