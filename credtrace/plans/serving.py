"""What readers get: safe findings, scan history, portfolio figures, report and advisory rows, and the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credtrace.functions import catalog as C
from credtrace.functions import text as T
from credtrace.plans import stores

ADVISORY_FIELDS = ["explanation", "impact", "remediation", "confidence_assessment", "executive_summary"]
ARROW = " → "


@T.cached
def _safe_columns() -> list[Column]:
    fragments = F.transform("fragments", lambda g: F.struct(
        g["variable"].alias("variable"),
        F.when(g["resolved"], T.mask(g["value"])).otherwise("[DYNAMIC]").alias("value"),
        g["line"].alias("line"), g["resolved"].alias("resolved")))
    edges = F.transform(F.filter("nodes", lambda n: n["source"].isNotNull()), lambda n: F.struct(
        n["source"].alias("source"), n["target"].alias("target"), n["edge"].alias("type")))
    nodes = F.transform("nodes", lambda n: F.struct(
        n["variable"].alias("variable"), n["line"].alias("line"), n["operation"].alias("operation"),
        n["snippet"].alias("code_snippet")))
    return [
        F.col("scan_id"), F.col("repository"), F.col("finding_id"), F.col("secret_type"), F.col("file_path"),
        F.col("line_number"), F.col("code_context"), T.mask_value(F.col("secret"), F.col("extent")).alias("masked_secret"),
        F.col("methods").alias("detection_methods"), F.col("confidence"),
        F.bround("entropy_score", 3).alias("entropy_score"), F.col("status").alias("reconstruction_status"),
        F.coalesce(fragments, F.array()).alias("fragments"),
        F.coalesce(T.mask_value(F.col("rebuilt_value"), F.col("rebuilt_extent")), F.lit("")).alias("reconstructed_value_masked"),
        F.coalesce("path", F.array()).alias("propagation_path"),
        F.when(F.col("nodes").isNotNull(), F.struct(nodes.alias("nodes"), edges.alias("edges")))
        .alias("propagation_graph"),
        F.col("sink").alias("exposure_sink"), F.coalesce("sink.sink_type", F.lit("")).alias("exposure_type"),
        F.col("risk_score"), F.struct(
            F.col("detection_score").alias("detection_confidence"),
            F.col("sensitivity_score").alias("secret_sensitivity"), F.col("exposure_score").alias("exposure_severity"),
            F.col("propagation_score").alias("propagation_certainty"), F.col("risk_score").alias("total_score"),
            "severity", "explanation").alias("risk_breakdown"), F.col("severity"), F.col("ord")]


def safe_columns() -> list[Column]:
    return _safe_columns()


def safe(scored: DataFrame) -> DataFrame:
    """Findings without raw values: the only form that may be written or shown."""
    return scored.select(*_safe_columns())


# ---- advisory texts ----

def significant(findings: DataFrame, floor: float = 30.0) -> DataFrame:
    return findings.filter(F.col("risk_score") >= floor)


def advisory_worklist(findings: DataFrame, top: int = 10) -> DataFrame:
    """The findings worth an advisory: risk of at least 30, the ten riskiest of every scan.

    The rank filter becomes a group limit before the shuffle, so a scan sends at most ten rows per task.
    """
    order = Window.partitionBy("scan_id").orderBy(F.col("risk_score").desc(), "file_path", "ord")
    return significant(findings).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def advisory_payload(findings: DataFrame) -> DataFrame:
    """Masked fields and the first 300 characters of the redacted context, as one text per finding."""
    sink = F.col("exposure_sink")
    path = F.array_join("propagation_path", ARROW)
    line = lambda label, value: F.concat(F.lit(f"- {label}: "), value)
    payload = F.concat_ws(
        "\n", line("Secret Type", F.col("secret_type")), line("Severity", F.col("severity")),
        line("Risk Score", F.concat(F.format_string("%.1f", "risk_score"), F.lit("/100"))),
        line("Masked Secret", F.col("masked_secret")), line("File", F.col("file_path")),
        line("Line", F.col("line_number").cast("string")),
        line("Detection Methods", F.array_join("detection_methods", ", ")),
        line("Reconstruction Status", F.col("reconstruction_status")),
        line("Propagation Path", F.when(path == "", "None").otherwise(path)),
        line("Exposure Sink", F.coalesce(sink["sink_type"], F.lit("None identified"))),
        F.when(sink.isNotNull(), line("Exposure Description", sink["description"])),
        F.lit("Code context:"), F.substring("code_context", 1, 300))
    return findings.select("scan_id", "finding_id", payload.alias("payload"))


def split_response(responses: DataFrame) -> DataFrame:
    """Five sections of a response text by their headings, any case; an empty explanation takes the whole text."""
    heads = ["EXPLANATION", "IMPACT", "REMEDIATION", "CONFIDENCE", "EXECUTIVE_SUMMARY"]
    text = F.col("response")
    sections = {}
    for i, (head, field) in enumerate(zip(heads, ADVISORY_FIELDS)):
        stop = f"(?:{heads[i + 1]}:|$)" if i + 1 < len(heads) else "$"
        sections[field] = T.strip(F.regexp_extract(text, rf"(?is){head}:\s*(.*?){stop}", 1))
    out = responses.withColumns(sections)
    whole = F.when(F.col("explanation") == "", T.strip(text)).otherwise(F.col("explanation"))
    return out.withColumn("explanation", whole).drop("response")


def merge_advisories(findings: DataFrame, sections: DataFrame) -> DataFrame:
    """Advisory texts put onto their findings; the others stay pending."""
    texts = sections.select("finding_id", *[F.col(f).alias(f"ai_{f}") for f in ADVISORY_FIELDS],
                            F.lit("completed").alias("done"))
    joined = findings.join(texts, "finding_id", "left")
    return joined.withColumns(
        {f"ai_{f}": F.coalesce(f"ai_{f}", F.lit("")) for f in ADVISORY_FIELDS} | {
            "ai_analysis_status": F.coalesce("done", F.lit("pending"))}).drop("done")


# ---- scans ----

def scans(figures: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per scan from its figures and its run record (status, duration, created_at)."""
    return runs.join(figures, "scan_id").withColumnRenamed("total_files", "files_scanned")


def list_scans(scan_table: DataFrame) -> DataFrame:
    return scan_table.orderBy(F.col("created_at").desc(), "scan_id")


def scan_by_id(scan_table: DataFrame, scan_id: str) -> DataFrame:
    return scan_table.filter(F.col("scan_id") == scan_id)


def findings_of_scan(findings: DataFrame, scan_id: str) -> DataFrame:
    return findings.filter(F.col("scan_id") == scan_id).orderBy(F.col("risk_score").desc(), "file_path", "ord")


def finding_by_id(findings: DataFrame, finding_id: str) -> DataFrame:
    return findings.filter(F.col("finding_id") == finding_id)


def by_severity(findings: DataFrame, severity: str) -> DataFrame:
    return findings.filter(F.col("severity") == severity)


def portfolio_totals(scan_table: DataFrame) -> DataFrame:
    """Number of all scans; findings, severities and mean risk of the completed ones."""
    done = F.col("status") == "completed"
    total = lambda c: F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0))
    return scan_table.agg(
        F.count("*").alias("total_scans"), F.count_if(done).alias("completed_scans"),
        total("findings_count").alias("total_findings"), *[total(s.lower()).alias(f"total_{s.lower()}")
                                                           for s in C.SEVERITIES],
        F.coalesce(F.avg(F.when(done, F.col("risk_score"))), F.lit(0.0)).alias("average_risk"))


def severity_distribution(scan_table: DataFrame) -> DataFrame:
    """Severity totals as rows, zero levels left out."""
    totals = portfolio_totals(scan_table)
    pairs = ", ".join(f"'{s.capitalize()}', total_{s.lower()}" for s in C.SEVERITIES)
    return totals.selectExpr(f"stack({len(C.SEVERITIES)}, {pairs}) AS (name, value)").filter("value > 0")


def recent_scans(scan_table: DataFrame, n: int = 5) -> DataFrame:
    return list_scans(scan_table).limit(n)


def recent_risks(scan_table: DataFrame, n: int = 8) -> DataFrame:
    """Newest completed scans with their name cut to twelve characters."""
    newest = list_scans(scan_table.filter(F.col("status") == "completed")).limit(n)
    return newest.select("scan_id", F.substring("repository", 1, 12).alias("name"), F.col("risk_score").alias("risk"))


def history(scan_table: DataFrame) -> DataFrame:
    return scan_table.select(
        "repository", "status", "files_scanned", "findings_count", "critical", "high",
        F.format_string("%.1f", "risk_score").alias("risk_score"), "secrets_reconstructed",
        F.when(F.col("scan_duration") > 0, F.concat(F.format_string("%.1f", "scan_duration"), F.lit("s")))
        .otherwise("N/A").alias("duration"), F.to_date("created_at").cast("string").alias("date"))


# ---- reports ----

def report_header(scan_table: DataFrame) -> DataFrame:
    return scan_table.select(
        "scan_id", "repository", "status", F.col("findings_count").alias("total_findings"),
        F.format_string("%.1f/100", "risk_score").alias("average_risk_score"), "files_scanned",
        F.col("total_lines").alias("lines_analyzed"),
        F.when(F.col("scan_duration") > 0, F.format_string("%.2fs", "scan_duration")).otherwise("N/A")
        .alias("scan_duration"), "secrets_reconstructed", *[s.lower() for s in C.SEVERITIES])


@T.cached
def _report_lines() -> Column:
    def line(label: str, value: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), value.alias("value"))

    sink, status, path = F.col("exposure_sink"), F.col("reconstruction_status"), F.col("propagation_path")
    rebuilt = status != "NONE"
    always = [
        line("Finding", F.concat(F.col("secret_type"), F.lit(" ["), F.col("severity"), F.lit("]"))),
        line("File", F.col("file_path")), line("Line", F.col("line_number").cast("string")),
        line("Risk Score", F.format_string("%.1f/100", "risk_score")),
        line("Detection", F.array_join("detection_methods", ", ")), line("Masked Secret", F.col("masked_secret"))]
    fragment_lines = F.when(rebuilt, F.transform("fragments", lambda g: line("Fragment", F.concat(
        g["variable"], F.lit(": "), g["value"], F.lit(" (line "), g["line"].cast("string"), F.lit(")")))))
    some = [
        (rebuilt, "Reconstruction Status", status),
        (F.size(path) > 0, "Propagation Path", F.array_join(path, ARROW)),
        (sink.isNotNull(), "Exposure", F.concat(sink["sink_type"], F.lit(" ("), sink["risk_level"], F.lit(")"))),
        (sink.isNotNull(), "Exposure Description", sink["description"]),
        (F.col("ai_explanation") != "", "AI Analysis", F.substring("ai_explanation", 1, 500)),
        (F.col("ai_remediation") != "", "Remediation", F.substring("ai_remediation", 1, 500))]
    optional = [F.when(cond, line(label, value)) for cond, label, value in some]
    rows = F.concat(F.array(*always), F.array(optional[0]), F.coalesce(fragment_lines, F.array()), F.array(*optional[1:]))
    return F.filter(rows, lambda r: r.isNotNull())


def report_rows(findings: DataFrame) -> DataFrame:
    """The label and value lines of every finding's report entry, in order."""
    for column in ("ai_explanation", "ai_remediation"):
        if column not in findings.columns:
            findings = findings.withColumn(column, F.lit(""))
    return (findings.select("scan_id", "finding_id", F.posexplode(_report_lines()).alias("line_no", "r"))
            .select("scan_id", "finding_id", "line_no", "r.label", "r.value"))


# ---- sinks ----

PENDING = {f"ai_{f}": "" for f in ADVISORY_FIELDS} | {"ai_analysis_status": "pending"}


def write_findings(findings: DataFrame, path: str, covered: DataFrame | None = None) -> None:
    """Commit safe findings by scan, their advisory texts pending; a scan written again replaces its own findings only.

    ``covered`` has the scan_id of every scan that was run, so that one that finds nothing any more clears what it found before.
    """
    leaked = {"secret", "rebuilt_value", "known", "extent", "rebuilt_extent"} & set(findings.columns)
    if leaked:
        raise ValueError(f"raw values must not be written: {sorted(leaked)}")
    texts = {c: F.lit(v) for c, v in PENDING.items() if c not in findings.columns}
    stores.write(findings.withColumns(texts), path, covered)


def read_findings(spark: SparkSession, path: str, scan_id: str | None = None) -> DataFrame:
    return stores.read(spark, path, scan_id)


def write_scans(scan_table: DataFrame, path: str) -> None:
    stores.write(scan_table, path)


def read_scans(spark: SparkSession, path: str, scan_id: str | None = None) -> DataFrame:
    return stores.read(spark, path, scan_id)


def store_advisories(spark: SparkSession, responses: DataFrame, path: str) -> None:
    """Put advisory responses (finding_id, response) onto the stored findings of their scans, as a new version of these scans."""
    stored = stores.read(spark, path)
    touched = stored.join(responses.select("finding_id"), "finding_id", "left_semi").select("scan_id").distinct()
    rows = stored.join(touched, "scan_id", "left_semi")
    texts = split_response(responses).select("finding_id", *[F.col(f).alias(f"new_{f}") for f in ADVISORY_FIELDS], F.lit("completed").alias("new_status"))
    merged = rows.join(texts, "finding_id", "left").withColumns(
        {f"ai_{f}": F.coalesce(f"new_{f}", f"ai_{f}") for f in ADVISORY_FIELDS} | {"ai_analysis_status": F.coalesce("new_status", "ai_analysis_status")})
    stores.write(merged.select(*stored.columns), path)


def audit_events(scan_table: DataFrame) -> DataFrame:
    """A created event per scan and one for its completion; a failed scan carries its error on its own row (``scans``)."""
    event = lambda action, details: F.struct(F.lit(action).alias("action"), details.alias("details"))
    created = event("scan_created", F.concat(F.lit("Repository: "), F.col("repository")))
    done = event("scan_completed", F.concat(F.lit("Found "), F.col("findings_count").cast("string"), F.lit(" findings")))
    # Both come from one row, so that the figures of scans are made once.
    both = F.when(F.col("status") == "completed", F.array(created, done)).otherwise(F.array(created))
    return scan_table.select("scan_id", "created_at", F.explode(both).alias("e")).select(
        "e.action", "scan_id", "e.details", "created_at", F.lit("success").alias("status"))


def write_audit(events: DataFrame, path: str) -> None:
    """Commit events by scan. A retry replaces the events of its scans, so none is there twice."""
    stores.write(events, path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return stores.read(spark, path)


def audit_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("action").agg(F.count("*").alias("n"))
