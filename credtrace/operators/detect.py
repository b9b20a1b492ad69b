"""Candidate detection: format rules, entropy, context filter.

Every step is a projection of the file row, so detection runs in the scan stage with no shuffle. The lines of a
file are split once, only lines that can match travel further, and a candidate carries its own seven-line window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credtrace.functions import catalog as C
from credtrace.functions import text as T

CANDIDATE = ("struct<value:string,line_number:int,column:int,secret_type:string,detection_method:string,"
             "confidence:double,entropy_score:double,context_variable:string,code_context:string>")
CANDIDATES = f"array<{CANDIDATE}>"


def with_lines(files: DataFrame) -> DataFrame:
    return files.withColumn("lines", F.split("content", "\n", -1))


def _matches(line: Column, rule) -> Column:
    """Whether a rule matches a line; a plain text search spares most lines the pattern."""
    found = line.rlike(rule[3])
    return F.contains(line, F.lit(rule[4])) & found if len(rule) > 4 else found


def _needs_quote(rule) -> bool:
    """True for the given rules whose every match holds a quote; a rule of one's own is never taken for one."""
    return rule in C.DETECTION_RULES and rule[0] in C.QUOTED_RULES


def hit_lines(lines: Column, rules=C.DETECTION_RULES) -> Column:
    """Lines that may hold a candidate, with their 1-based number: any quote, or a rule that needs none."""
    def may_hold(line: Column) -> Column:
        hit = line.rlike("[\"'`]")
        for rule in rules:
            if not _needs_quote(rule):
                hit = hit | _matches(line, rule)
        return hit

    numbered = F.transform(lines, lambda l, i: F.struct((i + 1).alias("n"), l.alias("line")))
    return F.filter(numbered, lambda x: may_hold(x["line"]))


def rule_candidates(hits: Column, lines: Column, rules=C.DETECTION_RULES) -> Column:
    """All non-overlapping matches of every rule, rule by rule, then by line and position.

    Spark has no function for match offsets: the pieces between the matches give them, because pieces and matches
    alternate and together make up the line.
    """
    def of(rule) -> Column:
        kind, confidence, group, pattern = rule[:4]
        return F.transform(F.filter(hits, lambda h: _matches(h["line"], rule)), lambda h: F.struct(
            F.lit(kind).alias("kind"), F.lit(float(confidence)).alias("confidence"), h["n"].alias("n"),
            h["line"].alias("line"), F.regexp_extract_all(h["line"], F.lit(pattern), F.lit(0)).alias("whole"),
            F.regexp_extract_all(h["line"], F.lit(pattern), F.lit(group)).alias("values"),
            F.split(h["line"], pattern, -1).alias("pieces")))

    def starts(m: Column) -> Column:
        """1-based column of every match, from running lengths of the pieces and matches before it."""
        zero = F.struct(F.lit(1).alias("at"), T.empty_array("array<int>").alias("all"))
        steps = F.zip_with(F.slice(m["pieces"], F.lit(1), F.size(m["whole"])), m["whole"], lambda piece, whole: F.struct(
            F.length(piece).alias("before"), F.length(whole).alias("own")))
        return F.aggregate(steps, zero, lambda acc, x: F.struct(
            (acc["at"] + x["before"] + x["own"]).alias("at"), F.array_append(acc["all"], acc["at"] + x["before"]).alias("all")),
            lambda acc: acc["all"])

    def rows(m: Column) -> Column:
        def of_line(line: Column) -> Column:
            def row(value: Column, i: Column) -> Column:
                return F.struct(
                    value.alias("value"), m["n"].alias("line_number"), F.element_at(line["starts"], i + 1).alias("column"),
                    T.provider_type(value, m["kind"]).alias("secret_type"), F.lit("regex").alias("detection_method"),
                    m["confidence"].alias("confidence"), F.lit(0.0).alias("entropy_score"),
                    line["variable"].alias("context_variable"), line["window"].alias("code_context"))
            return F.transform(m["values"], row)

        return T.bind(F.struct(starts(m).alias("starts"), T.assigned_variable(m["line"]).alias("variable"),
                               T.line_window(lines, m["n"]).alias("window")), of_line)

    return F.flatten(F.transform(F.concat(*[of(rule) for rule in rules]), rows)).cast(CANDIDATES)


def entropy_candidates(hits: Column, lines: Column, hex_threshold=C.HEX_THRESHOLD,
                       base64_threshold=C.BASE64_THRESHOLD, general_threshold=C.GENERAL_THRESHOLD,
                       min_length=C.MIN_LITERAL) -> Column:
    """Quoted literals whose entropy reaches the threshold of their character class."""
    code_lines = F.filter(hits, lambda h: h["line"].rlike(C.QUOTED_LITERAL) & ~T.is_comment_line(h["line"]))

    def measured(h: Column) -> Column:
        found = F.transform(
            F.regexp_extract_all(h["line"], F.lit(C.QUOTED_LITERAL), F.lit(1)),
            lambda v: F.struct(v.alias("value"), T.shannon_entropy(v).alias("entropy"),
                               T.entropy_threshold(v, hex_threshold, base64_threshold, general_threshold)
                               .alias("threshold")))
        return F.struct(h["n"].alias("n"), F.filter(found, lambda m: (m["entropy"] >= m["threshold"]) & (
            F.length(m["value"]) >= min_length)).alias("strong"))

    def of_line(x: Column) -> Column:
        """The window of a line and the keywords in it are looked at once, however many literals it holds."""
        def rows(window: Column) -> Column:
            return F.transform(x["strong"], lambda m: F.struct(
                m["value"].alias("value"), x["n"].alias("line_number"), F.lit(0).alias("column"),
                F.lit("High Entropy String").alias("secret_type"), F.lit("entropy").alias("detection_method"),
                T.entropy_confidence(m["entropy"], m["threshold"], window["keyword"]).alias("confidence"),
                m["entropy"].alias("entropy_score"), F.lit("").alias("context_variable"), window["text"].alias("code_context")))

        return T.bind(T.bind(T.line_window(lines, x["n"]), lambda text: F.struct(
            text.alias("text"), T.has_credential_keyword(text).alias("keyword"))), rows)

    held = F.filter(F.transform(code_lines, measured), lambda x: F.size(x["strong"]) > 0)
    return F.flatten(F.transform(held, of_line)).cast(CANDIDATES)


def filter_candidates(candidates: Column, path: Column, allow_test_files: bool = False) -> Column:
    """Drop placeholders and environment-sourced values, then weaken and drop by context."""
    def weighted(c: Column, doc: Column) -> Column:
        def confidence(name: Column) -> Column:
            after_doc = F.when(doc, c["confidence"] * F.lit(0.3)).otherwise(c["confidence"])
            after_test = after_doc if allow_test_files else (
                F.when(T.is_test_path(path), after_doc * F.lit(0.5)).otherwise(after_doc))
            final = F.when((name != "") & T.is_config_variable(name), after_test * F.lit(0.4)).otherwise(after_test)
            dropped = doc & (after_doc < F.lit(0.2))
            return (c.withField("confidence", F.when(dropped, F.lit(0.0)).otherwise(final))
                    .withField("context_variable", name))

        return T.bind(F.when(c["context_variable"] != "", c["context_variable"])
                      .otherwise(T.context_variable(c["code_context"], c["value"])), confidence)

    def by_line(numbers: Column) -> Column:
        """What the window of each line that holds candidates says, looked at once a line."""
        firsts = F.filter(candidates, lambda c, i: F.array_position(numbers, c["line_number"]) == i + 1)
        return F.transform(firsts, lambda c: F.struct(
            c["line_number"].alias("n"), T.is_environment_sourced(c["code_context"]).alias("environment"),
            T.is_documentation(c["code_context"]).alias("doc")))

    def kept(said: Column) -> Column:
        numbers = F.transform(said, lambda x: x["n"])

        def of(ns: Column) -> Column:
            def line(c: Column) -> Column:
                return F.element_at(said, F.array_position(ns, c["line_number"]).cast("int"))
            real = F.filter(candidates, lambda c: ~T.is_placeholder(c["value"]) & ~line(c)["environment"])
            return F.filter(F.transform(real, lambda c: weighted(c, line(c)["doc"])), lambda c: c["confidence"] >= F.lit(0.15))

        return T.bind(numbers, of)

    return T.bind(T.bind(F.transform(candidates, lambda c: c["line_number"]), by_line), kept)


@T.cached
def _hits(rules: tuple) -> Column:
    return hit_lines(F.col("lines"), rules)


@T.cached
def _candidates(rules: tuple) -> Column:
    return F.concat(rule_candidates(F.col("hits"), F.col("lines"), rules),
                    entropy_candidates(F.col("hits"), F.col("lines")))


@T.cached
def _filtered(allow_test_files: bool) -> Column:
    return filter_candidates(F.col("candidates"), F.col("file_path"), allow_test_files)


def with_candidates(files: DataFrame, rules=C.DETECTION_RULES) -> DataFrame:
    """``files`` plus ``lines`` and the raw ``candidates`` array, rules before entropy."""
    rules = tuple(tuple(r) for r in rules)
    hits = with_lines(files).withColumn("hits", _hits(rules))
    return hits.withColumn("candidates", _candidates(rules)).drop("hits")


def with_filtered(files: DataFrame, rules=C.DETECTION_RULES, allow_test_files: bool = False) -> DataFrame:
    """``candidates`` are what the filter keeps; ``raw_values`` are the values of all, for redaction."""
    return (with_candidates(files, rules).withColumn("raw_values", F.array_distinct(F.transform("candidates", lambda c: c["value"])))
            .withColumn("candidates", _filtered(allow_test_files)))


def exploded(files: DataFrame) -> DataFrame:
    """One row per candidate; ``ord`` keeps the order within the file.

    The outer form matters: for an inner explode Catalyst infers a size filter and pushes it below the
    projections, which would evaluate the whole detection twice.
    """
    return (files.select("scan_id", "repository", "file_path", F.posexplode_outer("candidates").alias("ord", "c"))
            .filter(F.col("ord").isNotNull()).select("scan_id", "repository", "file_path", "ord", "c.*"))


def candidates(files: DataFrame, rules=C.DETECTION_RULES) -> DataFrame:
    return exploded(with_candidates(files, rules))


def filtered(files: DataFrame, rules=C.DETECTION_RULES, allow_test_files: bool = False) -> DataFrame:
    return exploded(with_filtered(files, rules, allow_test_files))
