"""Findings: merge of duplicate detections, risk score, severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credtrace.functions import catalog as C
from credtrace.functions import text as T

FILE = ["scan_id", "file_path"]


def merged(rows: Column) -> Column:
    """One finding per merge group of a file, from the array of its raw findings.

    ``ord`` is the order within the file, rebuilt values first; ties go to the lower ``ord``. The rows are sorted by group and each
    group is a slice, so nothing is shuffled: a finding never leaves its file.
    """
    def one(g: Column) -> Column:
        def first(where) -> Column:
            return F.try_element_at(F.filter(g, where), F.lit(1))

        def best(value, where, *order) -> Column:
            """Value of the row whose order is greatest; rows are told apart by ``ord`` at last."""
            ranked = F.transform(F.filter(g, where), lambda x: F.struct(*[o(x).alias(f"o{k}") for k, o in enumerate(order)], (-x["ord"]).alias("back"), x.alias("x")))
            return value(F.array_max(ranked)["x"])

        head = F.element_at(g, 1)
        has = lambda method: F.exists(g, lambda x: x["method"] == method)
        rebuilt = has("reconstruction")
        methods = F.filter(F.array(F.when(rebuilt, "reconstruction"), F.when(rebuilt, "dataflow"), F.when(has("regex"), "regex"),
                                   F.when(has("entropy"), "entropy")), lambda m: m.isNotNull())
        specific = first(lambda x: ~x["secret_type"].isin(C.GENERIC_TYPES))["secret_type"]
        return T.bind(first(lambda x: x["status"] != "NONE"), lambda rebuild: F.struct(
            head["group_key"].alias("group_key"), head["ord"].alias("ord"), head["secret"].alias("secret"), head["line_number"].alias("line_number"),
            F.coalesce(specific, head["secret_type"]).alias("secret_type"),
            F.array_max(F.transform(g, lambda x: x["confidence"])).alias("confidence"),
            F.array_max(F.transform(g, lambda x: x["entropy_score"])).alias("entropy_score"), methods.alias("methods"),
            F.coalesce(rebuild["status"], F.lit("NONE")).alias("status"), rebuild["fragments"].alias("fragments"),
            rebuild["secret"].alias("rebuilt_value"), head["extent"].alias("extent"), rebuild["extent"].alias("rebuilt_extent"),
            best(lambda x: x["nodes"], lambda x: x["nodes"].isNotNull(), lambda x: F.size(x["nodes"])).alias("nodes"),
            best(lambda x: x["sink"], lambda x: x["sink"].isNotNull(), lambda x: F.when(x["sink"]["risk_level"] == "HIGH", 1).otherwise(0)).alias("sink"),
            best(lambda x: x["line_number"], lambda x: x["context"].isNotNull(), lambda x: F.length(x["context"])).alias("context_line")))

    def groups(xs: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(xs)), lambda i: (i == 1) | (F.get(xs, i - 1)["k"] != F.get(xs, i - 2)["k"]))
        return T.bind(starts, lambda ss: F.transform(ss, lambda s, j: T.bind(
            F.transform(F.slice(xs, s, F.coalesce(F.get(ss, j + 1), F.size(xs) + 1) - s), lambda x: x["r"]), one)))

    ordered = F.array_sort(F.transform(rows, lambda r: F.struct(r["group_key"].alias("k"), r["ord"].alias("o"), r.alias("r"))))
    return F.when(F.size(rows) > 0, T.bind(ordered, groups))


def finding_id() -> Column:
    return F.substring(F.sha2(F.concat_ws("|", "scan_id", "file_path", F.col("ord").cast("string")), 256), 1, 16).alias("finding_id")


def _weight(column: Column, table: dict, default: int) -> Column:
    weights = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(weights, column), F.lit(float(default)))


def _shown(number: Column) -> Column:
    return number.cast("int").cast("string")


def scores(of, steps: Column) -> Column:
    """The four sub-scores, their sum, the severity and the explanation of a finding; ``of`` gives its columns by name, ``steps`` is its
    path.

    Rounding is half to even.
    """
    methods, status, sink = of("methods"), of("status"), of("sink")["sink_type"]
    n, entropy, length = F.size(methods), of("entropy_score"), F.coalesce(F.size(steps), F.lit(0))
    cap = F.lit(25.0)
    detection = F.least(cap, of("confidence") * cap)
    detection = F.when(n >= 3, F.least(cap, detection + 5)).when(n == 2, F.least(cap, detection + 3)).otherwise(detection)
    detection = F.when(entropy > 4.5, F.least(cap, detection + 2)).otherwise(detection)
    sensitivity = _weight(of("secret_type"), C.TYPE_WEIGHTS, C.DEFAULT_TYPE_WEIGHT)
    exposure = F.when(sink.isNull(), F.lit(float(C.NO_SINK_WEIGHT))).otherwise(
        _weight(sink, C.EXPOSURE_WEIGHTS, C.DEFAULT_EXPOSURE_WEIGHT))
    bonus = F.when(length > 1, F.least(F.lit(10), length * 2)).otherwise(0)
    propagation = F.least(cap, F.lit(5.0) + F.when(status == "FULL", 10).when(status == "PARTIAL", 5).otherwise(0) + bonus)

    def explained(p: Column) -> Column:
        # Fixed formats of the explanation.
        return F.concat_ws(
            " | ",
            F.when(n >= 3, F.concat(F.lit("Multi-method detection ("), F.array_join(methods, ", "),
                                    F.lit(") → boosted confidence"))),
            F.when(entropy > 4.5, F.concat(F.lit("High entropy ("), F.format_string("%.2f", entropy),
                                           F.lit(") supports authenticity"))),
            F.concat(F.lit("Secret type '"), of("secret_type"), F.lit("' sensitivity: "),
                     _shown(p["sensitivity_score"]), F.lit("/25")),
            F.when(sink.isNull(), F.lit("No identified exposure sink → minimal exposure risk")).otherwise(
                F.concat(F.lit("Exposure via '"), sink, F.lit("' → severity: "), _shown(p["exposure_score"]),
                         F.lit("/25"))),
            F.when(status == "FULL", F.lit("Fully reconstructed secret → high propagation certainty"))
            .when(status == "PARTIAL", F.lit("Partially reconstructed → moderate propagation certainty")),
            F.when(length > 1, F.concat(F.lit("Propagation path length "), length.cast("string"), F.lit(" → +"),
                                        bonus.cast("string"), F.lit(" certainty"))))

    def whole(p: Column) -> Column:
        risk = F.bround(p["detection_score"] + p["sensitivity_score"] + p["exposure_score"] + p["propagation_score"], 1)
        return T.bind(risk, lambda r: F.struct(
            *[p[c].alias(c) for c in SUB_SCORES], r.alias("risk_score"),
            F.when(r >= 80, "CRITICAL").when(r >= 60, "HIGH").when(r >= 30, "MEDIUM").otherwise("LOW").alias("severity"),
            explained(p).alias("explanation")))

    return T.bind(F.struct(*[x.alias(c) for x, c in zip((F.bround(detection, 1), sensitivity, exposure, propagation), SUB_SCORES)]), whole)


SUB_SCORES = ["detection_score", "sensitivity_score", "exposure_score", "propagation_score"]


def score_findings(findings: DataFrame) -> DataFrame:
    return findings.withColumn("s", scores(F.col, F.col("path"))).select("*", "s.*").drop("s")


def severity_counts(findings: DataFrame) -> DataFrame:
    """Findings, zero-filled severity counts and mean risk of every scan that has findings."""
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in C.SEVERITIES]
    return findings.groupBy("scan_id").agg(
        F.count("*").alias("findings_count"), *counts, F.bround(F.avg("risk_score"), 1).alias("risk_score"))
