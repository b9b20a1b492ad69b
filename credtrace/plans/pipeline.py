"""The full scan, the baseline scan and their comparison as one lazy plan each.

Shape of the full scan: one pass over the files does detection, reconstruction, dataflow, sinks and the merge of findings on the
file row; files without a secret leave that pass early. Nothing is shuffled between the files and the scored findings. The
figures of scans are sums of a few counters that the same pass gives for every file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credtrace import share_package
from credtrace.functions import catalog as C
from credtrace.functions import matcher, ropes
from credtrace.functions import text as T
from credtrace.operators import dataflow as D
from credtrace.operators import detect, findings, reconstruct, sinks
from credtrace.operators import statements as S
from credtrace.sources import corpus


#: Rebuilt values of a file come before its candidates in the order of findings.
FIRST_CANDIDATE = 1 << 32


#: Columns of a file that its counters need, whether it holds a secret or not.
LIGHT = ["scan_id", "file_path", "language", "size", "line_count"]


def secret_files(files: DataFrame, rules=C.DETECTION_RULES, allow_test_files: bool = False, every: bool = False) -> DataFrame:
    """Files that hold a candidate or a rebuilt secret, with both as arrays; with ``every`` the others too, without arrays.

    The outer explode of a zero- or one-element array is a barrier: a plain filter would be pushed below the
    detection and evaluate it twice.
    """
    scanned = reconstruct.with_reconstructions(detect.with_filtered(files, rules, allow_test_files))
    row = F.struct("repository", "language", "lines", "statements", "candidates", "raw_values", "secrets")
    kept = F.when((F.size("candidates") > 0) | (F.size("secrets") > 0), F.array(row))
    if every:
        rest = ["repository", "lines", "statements", "candidates", "raw_values", "secrets"]
        light = [*LIGHT, *(c for c in ("error",) if c in files.columns)]
        return scanned.select(*light, F.col("repository").alias("of"), F.explode_outer(kept).alias("f")).select(
            *light, F.col("of").alias("repository"), *[f"f.{c}" for c in rest[1:]])
    return (scanned.select("scan_id", "file_path", F.explode_outer(kept).alias("f"))
            .filter(F.col("f").isNotNull()).select("scan_id", "file_path", "f.*"))


@T.cached
def _seeds() -> Column:
    seeds = F.concat(
        F.transform("secrets", lambda r: F.struct(r["target"].alias("variable"), r["line_no"].cast("int").alias("line"),
                                                  r["value"].alias("value"))),
        F.transform(F.filter("candidates", lambda c: c["context_variable"] != ""),
                    lambda c: F.struct(c["context_variable"].alias("variable"), c["line_number"].alias("line"),
                                       c["value"].alias("value"))))

    def latest(rev: Column) -> Column:
        names = F.transform(rev, lambda s: s["variable"])
        return T.bind(names, lambda ns: F.filter(rev, lambda s, i: F.array_position(ns, s["variable"]) == i + 1))

    return F.reverse(T.bind(F.reverse(seeds), latest))


def with_seeds(found: DataFrame) -> DataFrame:
    """Secret variables of a file and the line each starts on; a later seed for a variable replaces an earlier one."""
    return found.withColumn("seeds", _seeds())


@T.cached
def _table() -> Column:
    return F.when(F.size("seeds") > 0, D.line_table(F.col("lines"))).otherwise(T.empty_array(D.LINES))


@T.cached
def _parsed() -> Column:
    language = F.col("language")
    return F.when((F.size("seeds") > 0) & S.is_python(language), D.parsed(F.coalesce(F.col("statements"), S.statement_array(F.col("lines"), language))))


@T.cached
def _facts() -> Column:
    python = S.is_python(F.col("language"))
    facts = F.when(python, D.statement_facts(F.col("parsed"))).otherwise(
        D.line_facts(F.col("table"), F.transform("seeds", lambda s: s["variable"])))
    return F.coalesce(D.numbered(facts, ~python), F.array())


@T.cached
def _walk() -> Column:
    return F.coalesce(D.numbered(D.sink_facts(F.col("parsed")), F.lit(False)), F.array())


def with_facts(found: DataFrame) -> DataFrame:
    """Facts of the files that have a seed: ``table`` for every language, statement facts for Python."""
    return (found.withColumn("table", _table()).withColumn("parsed", _parsed())
            .withColumn("facts", _facts()).withColumn("walk", _walk()).drop("parsed", "statements"))


@T.cached
def _reach_given() -> Column:
    return D.reach_given(F.col("seeds"), F.col("facts"), F.col("walk"), F.col("table"), ~S.is_python(F.col("language")))


@T.cached
def _sinks_of() -> Column:
    return F.struct(sinks.fact_sinks(F.col("facts")).alias("facts"), sinks.walk_sinks(F.col("walk")).alias("walk"),
                    sinks.call_sinks(F.col("table")).alias("calls"))


@T.cached
def _look_up_given() -> Column:
    variables = F.concat(F.transform("secrets", lambda r: r["target"]), F.transform("candidates", lambda c: c["context_variable"]))
    fragments = F.transform("candidates", lambda c: F.when((c["secret_type"] == "High Entropy String") & (F.length(c["value"]) >= 8), c["value"])
                            .otherwise(""))
    return F.struct(F.transform("seeds", lambda s: s["variable"]).alias("names"), variables.alias("wanted"), F.col("heads").alias("texts"),
                    fragments.alias("values"))


def _over_arrow(found: DataFrame, given: dict, functions: dict) -> DataFrame:
    """``found`` with the results of Arrow functions of the ``given`` columns, which are settled before and dropped after.

    Without the barriers the optimizer writes out the columns inside the call or pushes filters on its result below it.
    """
    share_package(found.sparkSession)
    ready = corpus.settled(found.withColumns(given))
    return corpus.settled(ready.withColumns({name: function(F.col(of)) for name, (function, of) in functions.items()}).drop(*given))


def with_reach(found: DataFrame, prefix: int = C.DEDUP_PREFIX) -> DataFrame:
    """``reach``: what each seed reaches, in one pass for all; ``heads``: the first rebuilt value of each merge group; ``looked_up``: the
    flow of each secret and candidate and the head that holds it, by number; ``sinks_of``: the sink that each fact and call is, looked
    at once."""
    return _over_arrow(found.withColumn("heads", _group_heads(prefix)), {"reach_given": _reach_given(), "look_up_given": _look_up_given()},
                       {"reach": (D.reach, "reach_given"), "looked_up": (matcher.look_ups, "look_up_given")}).withColumn("sinks_of", _sinks_of())


@T.cached
def _flows() -> Column:
    python = S.is_python(F.col("language"))
    missing = F.lit(None).cast("string")

    def origin(s: Column) -> Column:
        snippet = T.strip(F.element_at(F.col("lines"), s["line"]))
        return F.array(F.struct(
            s["variable"].alias("variable"), s["line"].alias("line"), F.lit("assignment").alias("operation"),
            snippet.alias("snippet"), missing.alias("source"), missing.alias("target"), missing.alias("edge"))).cast(D.NODES)

    def direct(s: Column, r: Column) -> Column:
        calls = F.col("sinks_of.calls")
        return T.bind(F.concat(sinks.statement_sinks(r["walk"], F.col("sinks_of.walk")), sinks.line_sinks(F.col("table"), calls, s["variable"], r["lines"]),
                               sinks.container_sinks(calls, r["boxed"])), sinks.unique_sinks)

    def flow(s: Column, r: Column) -> Column:
        reached = D.trace(F.col("facts"), r["hits"], ~python)
        return T.bind(F.struct(reached.alias("reached"), direct(s, r).alias("direct")), lambda x: T.bind(
            sinks.graph_sinks(x["reached"], F.col("sinks_of.facts")), lambda g: F.struct(
                s["variable"].alias("variable"), s["line"].alias("line"), s["value"].alias("value"),
                F.concat(origin(s), D.as_nodes(x["reached"])).alias("nodes"), x["direct"].alias("direct"), g.alias("from_graph"),
                sinks.best_of(x["direct"], g).alias("sink"))))

    return F.zip_with("seeds", "reach", flow)


def with_flows(found: DataFrame, prefix: int = C.DEDUP_PREFIX) -> DataFrame:
    """``flows``: per seed variable its graph nodes, its sinks and the sink that counts."""
    return with_reach(found, prefix).withColumn("flows", _flows()).drop("facts", "walk", "table", "reach", "sinks_of")


@T.cached
def _known() -> Column:
    fragments = F.flatten(F.transform("secrets", lambda r: F.transform(
        F.filter(r["fragments"], lambda g: g["resolved"] & (F.length(g["value"]) >= 4)), lambda g: g["value"])))
    return F.array_distinct(F.concat(F.col("raw_values"), F.transform("secrets", lambda r: r["value"]), fragments))


def with_redaction(found: DataFrame) -> DataFrame:
    """``clean``: the lines of the file without any raw value of it that must not leave it; contexts and snippets are cut from these.

    Candidates that the context filter drops are among these values: a real token may stand next to an environment look-up.
    """
    return _over_arrow(found, {"given": F.struct("lines", _known().alias("known"))}, {"clean": (matcher.redacted, "given")})


@T.cached
def _finding_rows(prefix: int) -> Column:
    def row(i: Column, place: Column, held, value, line, kind, method, confidence, entropy, status, fragments, extent, variable, context):
        return T.bind(F.get("flows", F.get("looked_up.at", place)), lambda x: F.struct(
            F.substring(F.coalesce(F.get("heads", held), value), 1, prefix).alias("group_key"),
            i.cast("long").alias("ord"), value.alias("secret"), line.cast("int").alias("line_number"),
            kind.alias("secret_type"), method.alias("method"), confidence.alias("confidence"),
            entropy.alias("entropy_score"), status.alias("status"), fragments.cast(reconstruct.FRAGMENTS).alias("fragments"),
            extent.cast(ropes.EXTENT).alias("extent"), variable.alias("variable"), context.alias("context"),
            x["nodes"].alias("nodes"), x["sink"].alias("sink")))

    def from_secret(r: Column, i: Column) -> Column:
        return row(i, i, F.lit(None).cast("int"), r["value"], r["line_no"], r["check"]["secret_type"], F.lit("reconstruction"),
                   r["check"]["confidence"], F.lit(0.0), r["status"], r["fragments"], r["extent"], r["target"],
                   T.line_window(F.col("lines"), r["line_no"]))

    def from_candidate(c: Column, i: Column) -> Column:
        return row(i.cast("long") + FIRST_CANDIDATE, F.size("secrets") + i, F.get("looked_up.held", i), c["value"], c["line_number"], c["secret_type"],
                   c["detection_method"], c["confidence"], c["entropy_score"], F.lit("NONE"), F.lit(None), F.lit(None), c["context_variable"],
                   c["code_context"])

    return F.concat(F.transform("secrets", from_secret), F.transform("candidates", from_candidate))


@T.cached
def _merged() -> Column:
    return findings.merged(F.col("rows"))


@T.cached
def _safe_code() -> list[Column]:
    """Context, nodes and sink of the finding ``r``, cut from the clean lines of its file."""
    clean, sink = F.col("clean"), F.col("r.sink")
    at = lambda line: T.strip(F.element_at(clean, line))
    return [F.transform("r.nodes", lambda n: n.withField("snippet", at(n["line"]))).alias("nodes"),
            F.when(sink.isNotNull(), sink.withField("code", at(sink["line"]))).alias("sink"),
            T.line_window(clean, F.col("r.context_line")).alias("code_context")]


def with_rows(found: DataFrame, prefix: int = C.DEDUP_PREFIX) -> DataFrame:
    """``rows``: the rebuilt secrets and candidates of a file with their flow and merge group, the first ``prefix`` characters."""
    return found.withColumn("rows", _finding_rows(prefix)).drop("looked_up", "heads")


def _each(found: DataFrame, column: str) -> DataFrame:
    return found.select("scan_id", "file_path", "repository", "clean", F.explode_outer(column).alias("r")).filter(F.col("r").isNotNull())


def raw_findings(found: DataFrame) -> DataFrame:
    """One row per rebuilt secret and per candidate with its flow, its merge group and redacted code."""
    rows = with_rows(found).withColumn("rows", F.transform("rows", lambda r: r.withField("context_line", r["line_number"])))
    return _each(rows, "rows").select(
        "scan_id", "file_path", "repository", *[f"r.{c}" for c in (
            "ord", "secret", "line_number", "secret_type", "method", "confidence", "entropy_score", "status", "fragments", "variable", "group_key")],
        *_safe_code())


@T.cached
def _merged_columns() -> list[Column]:
    """Columns of the finding ``r`` of a file."""
    return [*[F.col(f"r.{c}") for c in (
        "group_key", "ord", "secret", "line_number", "secret_type", "confidence", "entropy_score", "methods", "status", "fragments",
        "rebuilt_value", "extent", "rebuilt_extent")],
        *_safe_code(), F.transform("r.nodes", lambda n: n["variable"]).alias("path")]


def merged_findings(found: DataFrame, prefix: int = C.DEDUP_PREFIX) -> DataFrame:
    """One row per finding, merged within the file row."""
    return _each(with_rows(found, prefix).withColumn("merged", _merged()), "merged").select(
        "scan_id", "file_path", "repository", *_merged_columns()).withColumn("finding_id", findings.finding_id())


@T.cached
def _group_heads(prefix: int) -> Column:
    """The first rebuilt value of every merge group, in order; entropy fragments are looked up in these."""
    def firsts(values: Column) -> Column:
        prefixes = F.transform(values, lambda v: F.substring(v, 1, prefix))
        return T.bind(prefixes, lambda ps: F.filter(
            values, lambda v, i: F.array_position(ps, F.element_at(ps, i + 1)) == i + 1))
    return T.bind(F.transform("secrets", lambda r: r["value"]), firsts)


def flowing(files: DataFrame, rules=C.DETECTION_RULES, allow_test_files: bool = False, every: bool = False,
            prefix: int = C.DEDUP_PREFIX) -> DataFrame:
    return with_flows(with_facts(with_seeds(secret_files(files, rules, allow_test_files, every))), prefix)


def analysed(files: DataFrame, rules=C.DETECTION_RULES, allow_test_files: bool = False, prefix: int = C.DEDUP_PREFIX) -> DataFrame:
    return with_redaction(flowing(files, rules, allow_test_files, prefix=prefix))


def full_scan(files: DataFrame, rules=C.DETECTION_RULES, allow_test_files: bool = False, prefix: int = C.DEDUP_PREFIX) -> DataFrame:
    """Scored findings of the full pipeline over all of ``files``; limits belong to the source. ``secret`` and ``rebuilt_value`` are
    raw; see ``serving.safe``. A row of files is a file of its own. Secrets of a file that share their first ``prefix`` characters are
    one finding; a longer prefix tells apart what begins alike."""
    return findings.score_findings(merged_findings(analysed(files, rules, allow_test_files, prefix), prefix))


@T.cached
def _counters() -> list[Column]:
    """Counters of a file, 0 where it holds nothing."""
    zero = F.lit(0).cast("bigint")
    n = lambda xs: F.greatest(F.coalesce(F.size(xs).cast("bigint"), zero), zero)
    severity = lambda s: n(F.filter("scored", lambda x: x["severity"] == s)).alias(s.lower())
    risk = F.coalesce(F.aggregate("scored", F.lit(0.0), lambda a, x: a + x["risk_score"]), F.lit(0.0))

    def plain(rows: Column) -> Column:
        """Keys of the findings of the baseline: the first candidate of a line and prefix, then its merge prefix."""
        ordered = F.array_sort(F.transform(rows, lambda c, i: F.struct(
            c["line_number"].alias("line"), F.substring(c["value"], 1, C.BASELINE_PREFIX).alias("prefix"), i.alias("i"), c["value"].alias("value"))))
        return T.bind(ordered, lambda xs: F.array_distinct(F.transform(F.filter(xs, lambda x, i: (i == 0) | (
            F.get(xs, i - 1)["line"] != x["line"]) | (F.get(xs, i - 1)["prefix"] != x["prefix"])), lambda x: F.substring(x["value"], 1, C.DEDUP_PREFIX))))

    def compared(base: Column) -> Column:
        inside = lambda m: F.array_contains(base, m["group_key"])
        rebuilt = lambda m: m["status"] != "NONE"
        return F.struct(
            n(F.filter("merged", inside)).alias("found_by_both"), n(F.filter("merged", lambda m: ~inside(m))).alias("only_full"),
            n(F.array_except(base, F.transform("merged", lambda m: m["group_key"]))).alias("only_baseline"),
            n(F.filter("merged", rebuilt)).alias("rebuilt_full"), n(F.filter("merged", lambda m: rebuilt(m) & inside(m))).alias("rebuilt_baseline"))

    return [n(F.col("candidates")).alias("candidates_found"), n(F.col("secrets")).alias("secrets_reconstructed"),
            n(F.col("scored")).alias("findings_count"), *[severity(s) for s in C.SEVERITIES], risk.alias("risk_sum"),
            T.bind(plain(F.col("candidates")), compared).alias("compared")]


@T.cached
def _scored() -> Column:
    return F.transform("merged", lambda m: findings.scores(lambda c: m[c], m["nodes"]))


def _every_file(files: DataFrame, rules, allow_test_files: bool) -> DataFrame:
    found = with_rows(flowing(files, rules, allow_test_files, every=True)).withColumn("merged", _merged())
    return found.withColumn("scored", _scored())


def file_counters(files: DataFrame, rules=C.DETECTION_RULES, allow_test_files: bool = False) -> DataFrame:
    """One row per file, whether it holds a secret or not: language, bytes, lines and the counters of its findings."""
    return _every_file(files, rules, allow_test_files).select(*LIGHT, *_counters()).select("*", "compared.*").drop("compared")


def scan_rows(files: DataFrame, rules=C.DETECTION_RULES, allow_test_files: bool = False) -> DataFrame:
    """What one pass over the files gives, as rows: every finding, and on the first row of every file, with a finding or not, its
    counters (``file``) and its error, if it could not be read (column ``error``, if there is one). Findings are raw."""
    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    found = with_redaction(_every_file(files, rules, allow_test_files))
    counted = found.withColumn("counters", F.struct("language", "size", "line_count", error.alias("error"), *_counters())).select(
        "scan_id", "file_path", "repository", "clean", "counters", F.posexplode_outer("merged").alias("pos", "r"))
    first = F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, F.col("counters")).alias("file")
    return findings.score_findings(counted.select("scan_id", "file_path", "repository", first, *_merged_columns()).withColumn(
        "finding_id", F.when(F.col("ord").isNotNull(), findings.finding_id())))


COUNTS = ["candidates_found", "secrets_reconstructed", "findings_count", *[s.lower() for s in C.SEVERITIES]]
COMPARED = ["found_by_both", "only_full", "only_baseline", "rebuilt_full", "rebuilt_baseline"]


def scan_figures(files: DataFrame, rules=C.DETECTION_RULES, allow_test_files: bool = False) -> DataFrame:
    """All figures of every scan from one pass over its files; see ``summed``."""
    return summed(file_counters(files, rules, allow_test_files))


def summed(counters: DataFrame) -> DataFrame:
    """Figures of scans from the counters of their files: files, lines, bytes, languages, stage counts, findings, severities, mean
    risk, and what the baseline finds of them. Counters are added by language, then by scan."""
    sums = [*COUNTS, "risk_sum", *COMPARED]
    per_language = counters.groupBy("scan_id", "language").agg(
        F.count("*").alias("n"), F.sum("line_count").alias("lines"), F.sum("size").alias("bytes"), *[F.sum(c).alias(c) for c in sums])
    per_scan = per_language.groupBy("scan_id").agg(
        F.sum("n").alias("total_files"), F.sum("lines").alias("total_lines"), F.sum("bytes").alias("total_bytes"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "n")))).alias("languages"), *[F.sum(c).alias(c) for c in sums])
    mean = F.when(F.col("findings_count") > 0, F.bround(F.col("risk_sum") / F.col("findings_count"), 1)).otherwise(0.0)
    return per_scan.withColumn("risk_score", mean).drop("risk_sum")


def baseline_scan(files: DataFrame, rules=C.DETECTION_RULES, prefix: int = C.BASELINE_PREFIX) -> DataFrame:
    """Rules and entropy only: distinct by (file, line, first ``prefix`` characters), scored without sink or path."""
    rows = detect.filtered(files, rules)
    key = ["scan_id", "file_path", "line_number", "prefix"]
    picked = (rows.withColumn("prefix", F.substring("value", 1, prefix))
              .groupBy(*key).agg(F.first("repository").alias("repository"), F.min_by(
                  F.struct("ord", "value", "secret_type", "detection_method", "confidence", "entropy_score",
                           "code_context"), "ord").alias("c")))
    return findings.score_findings(picked.select(
        "scan_id", "file_path", "repository", "line_number", F.col("c.ord").alias("ord"),
        F.col("c.value").alias("secret"), "c.secret_type", F.array("c.detection_method").alias("methods"),
        "c.confidence", "c.entropy_score", F.lit("NONE").alias("status"), F.array().cast("array<string>").alias("path"),
        F.lit(None).cast(T.SINK_DDL).alias("sink"), "c.code_context"))


def compare_scans(full: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per scan: secrets both find, only the full scan finds, only the baseline finds."""
    prefix = F.substring("secret", 1, C.DEDUP_PREFIX).alias("key")
    a = full.select("scan_id", "file_path", F.col("group_key").alias("key"),
                    (F.col("status") != "NONE").alias("rebuilt")).distinct()
    b = baseline.select("scan_id", "file_path", prefix, F.lit(True).alias("in_baseline")).distinct()
    both = a.withColumn("in_full", F.lit(True)).join(b, ["scan_id", "file_path", "key"], "full_outer")
    f, l = F.col("in_full").isNotNull(), F.col("in_baseline").isNotNull()
    return both.groupBy("scan_id").agg(
        F.count_if(f & l).alias("found_by_both"), F.count_if(f & ~l).alias("only_full"),
        F.count_if(l & ~f).alias("only_baseline"),
        F.count_if(f & F.col("rebuilt")).alias("rebuilt_full"),
        F.count_if(l & F.col("rebuilt")).alias("rebuilt_baseline"))


def ablation(files: DataFrame, rules=C.DETECTION_RULES) -> DataFrame:
    """Per scan that has findings in either: ``compare_scans`` of the full and the baseline scan, from one pass over the files."""
    rows = file_counters(files, rules).groupBy("scan_id").agg(*[F.sum(c).alias(c) for c in COMPARED])
    return rows.filter(F.col("found_by_both") + F.col("only_full") + F.col("only_baseline") > 0)


def scan_summary(files: DataFrame, scored: DataFrame) -> DataFrame:
    """One row per scan: files, lines, findings, severities, mean risk; scans without findings keep zeros."""
    summary = corpus.file_summary(files)
    return (summary.join(findings.severity_counts(scored), "scan_id", "left")
            .na.fill(0, ["findings_count", "critical", "high", "medium", "low"]).na.fill(0.0, ["risk_score"]))


def stage_counts(files: DataFrame) -> DataFrame:
    """Per scan: candidates after the filter and validated rebuilt values, before merging."""
    found = secret_files(files)
    return found.groupBy("scan_id").agg(F.sum(F.size("candidates")).alias("candidates_found"),
                                        F.sum(F.size("secrets")).alias("secrets_reconstructed"))


def ranked(scored: DataFrame) -> DataFrame:
    """Findings of a scan by descending risk; ties by file and order within the file.

    A range-partitioned sort, so one huge scan is spread over tasks; a rank window per scan would not be. The sort looks at its rows
    twice, for the ranges and for the rows, so they are exchanged before: both looks read that exchange, the files are scanned once.
    """
    return scored.repartition("scan_id", "file_path").orderBy("scan_id", F.col("risk_score").desc(), "file_path", "ord")
