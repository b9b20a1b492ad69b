"""Reconstruction of values assembled from fragments: constant propagation over the statements of a file.

One fold over the statements keeps the last definition of every variable, so chains of any length resolve in a
single pass and nothing is joined or shuffled. Rules fixed here: look-up takes the
last definition before the use, an unresolved part adds nothing to the value, names and literals of ``+`` and of
``join`` are fragments, in templates only the interpolations are. Values are ropes (``functions/ropes.py``): one of any length
has its right length, entropy and type, the column ``value`` shows its first mebibyte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credtrace.functions import ropes
from credtrace.functions import text as T
from credtrace.operators import statements as S

PART = "struct<k:string,t:string,frag:boolean>"
PARTS = f"array<{PART}>"
FRAGMENTS = "array<struct<variable:string,value:string,line:int,resolved:boolean>>"
RECON = (f"struct<target:string,line_no:int,value:string,status:string,kind:string,statement:string,"
         f"fragments:{FRAGMENTS},extent:{ropes.EXTENT}>")

NAME_ONLY = rf"^{S.NAME}$"
LITERAL_ONLY = rf"^(?:[rRuUbB]{{0,2}}{S.STRING}\s*)++$"
# A value can only be assembled in a file that has one of these texts.
ASSEMBLY = r"\+|[fF][rR]?[\"']|\.format\(|\.join\(|b64decode|\$\{"


def _part(kind, text: Column, fragment) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("k"), text.alias("t"),
                    F.lit(fragment).alias("frag")).cast(PART)


def _operand(text: Column, deep: Column) -> Column:
    literal = text.rlike(LITERAL_ONLY) & ~(F.startswith(text, F.lit("`")) & F.contains(text, F.lit("${")))
    return (F.when(text.rlike(NAME_ONLY), _part("name", text, True))
            .when(literal, _part("lit", S.literal_value(text), True))
            .otherwise(_part("dyn", S.unfold(text, deep), True)))


def _template(body: Column, javascript: bool) -> Column:
    if javascript:
        tokens = F.regexp_extract_all(body, F.lit(r"\$\{[^{}]*\}|[^$]++|\$"), F.lit(0))
        hole, name = r"^\$\{.*\}$", rf"^\$\{{\s*({S.NAME})\s*\}}$"
    else:
        tokens = F.regexp_extract_all(body, F.lit(r"\{\{|\}\}|\{[^{}]*\}|[^{}]++"), F.lit(0))
        hole, name = r"^\{[^{].*\}$", rf"^\{{\s*({S.NAME})\s*(?:![rsa])?(?::[^{{}}]*)?\}}$"

    def piece(t: Column) -> Column:
        plain = t if javascript else F.when(t == "{{", "{").when(t == "}}", "}").otherwise(t)
        return (F.when(t.rlike(name), _part("name", F.regexp_extract(t, name, 1), True))
                .when(t.rlike(hole), _part("dyn", t, True))
                .otherwise(_part("lit", plain, False)))
    return F.transform(tokens, piece)


def _format(value: Column, deep: Column) -> Column:
    pattern = rf"^((?:[rRuU]?{S.STRING}))\.format\((.*)\)$"
    body = S.literal_value(F.regexp_extract(value, pattern, 1))
    tokens = F.regexp_extract_all(body, F.lit(r"\{\{|\}\}|\{[^{}]*\}|[^{}]++"), F.lit(0))
    auto = r"^\{(?::[^{}]*)?\}$"

    def fill(args: Column) -> Column:
        positional = F.filter(args, lambda a: ~a.rlike(rf"^{S.NAME}\s*=(?!=)"))

        def piece(t: Column, i: Column) -> Column:
            key = F.regexp_extract(t, r"^\{([A-Za-z0-9_]*)", 1)
            nth = F.size(F.filter(F.slice(tokens, F.lit(1), i + 1), lambda x: x.rlike(auto)))
            number = F.when(t.rlike(auto), nth).when(key.rlike("^[0-9]+$"), F.expr("1") + key.try_cast("int"))
            named = F.filter(args, lambda a: F.regexp_extract(a, rf"^({S.NAME})\s*=", 1) == key)
            chosen = F.coalesce(F.try_element_at(positional, number),
                                F.regexp_extract(F.try_element_at(named, F.lit(1)), r"=\s*(.*)$", 1))
            plain = F.when(t == "{{", "{").when(t == "}}", "}").otherwise(t)
            return (F.when(~t.rlike(r"^\{[^{]*\}$"), _part("lit", plain, False))
                    .when(chosen.isNull(), _part("dyn", t, True))
                    .otherwise(_operand(chosen, deep)))
        return F.transform(tokens, piece)

    return T.bind(S.split_items(F.regexp_extract(value, pattern, 2)), fill)


def _join(value: Column, deep: Column) -> Column:
    pattern = rf"^([rRuU]?{S.STRING})\.join\(\s*[(\[](.*)[)\]]\s*\)$"
    separator = S.literal_value(F.regexp_extract(value, pattern, 1))
    items = S.split_items(F.regexp_extract(value, pattern, 2))
    return F.flatten(F.transform(items, lambda t, i: F.when(
        i > 0, F.array(_part("lit", separator, False), _operand(t, deep))).otherwise(F.array(_operand(t, deep)))))


DECODE = r"^(?:base64\.)?b64decode\(\s*([^()]*?)\s*\)(?:\.decode\([^()]*\))?$"


def _concat_parts(value: Column, deep: Column) -> Column:
    return F.transform(F.transform(F.regexp_extract_all(value, F.lit(S.OPERAND), F.lit(0)), T.strip), lambda t: _operand(t, deep))


def is_concat(value: Column) -> Column:
    """A ``+`` chain at the top level and nothing that binds more loosely."""
    def check(rest: Column) -> Column:
        return (F.contains(rest, F.lit("+")) & ~rest.rlike(r"[,<>=|&^?:;]|\b(?:if|or|and|not|in|is|lambda|else|await|yield)\b")
                & ~rest.rlike(r"-[^+]*$"))
    return F.contains(value, F.lit("+")) & T.bind(F.regexp_replace(value, f"{S.PREFIXED}|{S.GROUP}", " "), check)


def parse_value(value: Column, language: Column, deep: Column) -> Column:
    """struct(kind, parts) of an assigned value; kind is name, literal, template, format, join, decode, concat or
    dynamic."""
    python = S.is_python(language)
    formatted = rf"^(?:[fF][rR]?|[rR][fF]){S.STRING}$"
    ticked = rf"^{S.TICK_STRING}$"

    def made(kind: str, parts: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), parts.cast(PARTS).alias("parts"))

    return (F.when(value.rlike(NAME_ONLY), made("name", F.array(_part("name", value, True))))
            .when(python & value.rlike(formatted), made("template", _template(S.literal_value(value), False)))
            .when(~python & value.rlike(ticked) & F.contains(value, F.lit("${")),
                  made("template", _template(S.literal_value(value), True)))
            .when(value.rlike(LITERAL_ONLY), made("literal", F.array(_part("lit", S.literal_value(value), True))))
            .when(F.contains(value, F.lit(".format(")) & value.rlike(rf"^[rRuU]?{S.STRING}\.format\(.*\)$"), made("format", _format(value, deep)))
            .when(F.contains(value, F.lit(".join(")) & value.rlike(rf"^[rRuU]?{S.STRING}\.join\(\s*[(\[].*[)\]]\s*\)$"), made("join", _join(value, deep)))
            .when(F.contains(value, F.lit("b64decode(")) & value.rlike(DECODE), made("decode", F.array(_operand(F.regexp_extract(value, DECODE, 1), deep))))
            .when(is_concat(value), made("concat", _concat_parts(value, deep)))
            .otherwise(made("dynamic", F.array())))


def definitions(statements: Column, language: Column) -> Column:
    """The single-name assignments of a file with their parsed values."""
    def one(s: Column) -> Column:
        return T.bind(S.assignment(s["text"], language), lambda a: F.struct(
            s["line_no"].alias("line_no"), S.unfold(s["text"], s["deep"]).alias("text"), a["target"].alias("target"),
            parse_value(a["value"], language, s["deep"]).alias("v")))
    return F.filter(F.transform(statements, one), lambda d: d["target"] != "")


def _reportable(d: Column) -> Column:
    kind, parts = d["v"]["kind"], d["v"]["parts"]
    return (kind == "decode") | (kind.isin("template", "format", "join", "concat") & (F.size(parts) >= 2)
                                 & F.exists(parts, lambda p: p["frag"]))


def resolve(defs: Column, keep_unread: bool = False) -> Column:
    """struct(symbols, recons): every definition's value and the rebuilt values, in statement order."""
    used = F.array_distinct(F.flatten(F.transform(
        defs, lambda d: F.transform(F.filter(d["v"]["parts"], lambda p: p["k"] == "name"), lambda p: p["t"]))))

    symbol = "array<struct<variable:string,value:string,line_no:int,kind:string>>"
    zero = F.struct(T.empty_array("array<string>").alias("names"), T.empty_array(f"array<{ropes.VALUE}>").alias("vals"),
                    T.empty_array("array<int>").alias("at"), T.empty_array(symbol).alias("symbols"),
                    T.empty_array(f"array<{RECON}>").alias("recons"))

    def step(acc: Column, d: Column) -> Column:
        kind = d["v"]["kind"]

        def look_up(p: Column) -> Column:
            # Definitions are prepended, so the first position found is the latest one.
            at = F.when(p["k"] == "name", F.array_position(acc["names"], p["t"])).otherwise(F.lit(0)).cast("int")
            found = F.when(at > 0, F.element_at(acc["vals"], at))
            value = F.when(p["k"] == "lit", ropes.plain(p["t"])).when(p["k"] == "name", found)
            line = F.when((p["k"] == "name") & (at > 0), F.element_at(acc["at"], at)).otherwise(d["line_no"])
            return F.struct(p["t"].alias("t"), p["k"].alias("k"), p["frag"].alias("frag"), value.alias("v"),
                            F.when(at > 0, F.size(acc["names"]) - at + 1).alias("ref"), line.alias("line"))

        def finish(parts: Column) -> Column:
            fragments = F.filter(parts, lambda p: p["frag"])
            resolved = F.size(F.filter(fragments, lambda p: p["v"].isNotNull()))

            def decoded(joined: Column) -> Column:
                raw = F.try_to_binary(ropes.whole(joined, acc["vals"]), F.lit("base64"))
                return T.bind(F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit("")), ropes.of_text)

            def with_value(value: Column) -> Column:
                status = (F.when((kind == "dynamic") | value.isNull(), "UNRESOLVED")
                          .when(resolved == F.size(fragments), "FULL")
                          .when(resolved > 0, "PARTIAL").otherwise("UNRESOLVED"))
                return T.bind(F.struct(value.alias("value"), status.alias("status")), commit)

            def commit(r: Column) -> Column:
                known = F.when(r["status"] == "FULL", r["value"])
                frags = F.transform(fragments, lambda p: F.struct(
                    F.when(p["k"] == "lit", F.lit("")).otherwise(p["t"]).alias("variable"),
                    p["v"]["text"].alias("value"), p["line"].cast("int").alias("line"),
                    p["v"].isNotNull().alias("resolved"))).cast(FRAGMENTS)
                recon = F.struct(d["target"].alias("target"), d["line_no"].alias("line_no"),
                                 F.coalesce(r["value"]["text"], F.lit("")).alias("value"), r["status"].alias("status"),
                                 kind.alias("kind"), d["text"].alias("statement"), frags.alias("fragments"),
                                 ropes.extent(r["value"]).alias("extent")).cast(RECON)
                entry = F.struct(d["target"].alias("variable"), known["text"].alias("value"),
                                 d["line_no"].cast("int").alias("line_no"), kind.alias("kind"))
                return F.struct(
                    F.array_prepend(acc["names"], d["target"]).alias("names"),
                    F.array_prepend(acc["vals"], known).alias("vals"),
                    F.array_prepend(acc["at"], d["line_no"].cast("int")).alias("at"),
                    F.when(known.isNotNull(), F.array_append(acc["symbols"], entry)).otherwise(acc["symbols"])
                    .alias("symbols"),
                    F.when(_reportable(d), F.array_append(acc["recons"], recon)).otherwise(acc["recons"])
                    .alias("recons"))

            present = F.transform(F.filter(parts, lambda p: p["v"].isNotNull()), lambda p: F.struct(p["ref"].alias("ref"), p["v"].alias("v")))
            joined = T.bind(present, ropes.joined)
            return T.bind(F.when(kind == "decode", T.bind(joined, decoded)).otherwise(joined), with_value)

        return T.bind(F.transform(d["v"]["parts"], look_up), finish)

    # Definitions nobody reads and that are no assembly themselves cannot change a result.
    relevant = defs if keep_unread else F.filter(defs, lambda d: F.array_contains(used, d["target"]) | _reportable(d))
    return T.bind(F.aggregate(relevant, zero, step), lambda a: F.struct(a["symbols"].alias("symbols"),
                                                                        a["recons"].alias("recons")))


@T.cached
def statements_column() -> Column:
    return S.statement_array(F.col("lines"), F.col("language"))


@T.cached
def definitions_column() -> Column:
    return definitions(F.col("statements"), F.col("language"))


@T.cached
def resolved_column(keep_unread: bool) -> Column:
    return resolve(F.col("defs"), keep_unread)


@T.cached
def checked_column() -> Column:
    """``recons`` with the verdict of the validator."""
    return F.transform("recons", lambda r: r.withField(
        "check", T.validate_reconstructed(r["value"], r["target"], r["statement"], r["status"], r["extent"])))


def with_reconstructions(files: DataFrame) -> DataFrame:
    """``files`` (with ``lines``) plus ``recons`` (all, with their check), ``secrets`` (those accepted) and ``statements``.

    Statements are only built for files whose text can assemble a value; they are null for the others.
    """
    possible = F.col("content").rlike(ASSEMBLY) & F.contains(F.col("content"), F.lit("="))
    return (files.withColumn("statements", F.when(possible, statements_column()))
            .withColumn("defs", definitions_column())
            .withColumn("recons", F.coalesce(resolved_column(False)["recons"], T.empty_array(f"array<{RECON}>")))
            .withColumn("recons", checked_column())
            .withColumn("secrets", F.filter("recons", lambda r: r["check"]["is_secret"]))
            .drop("defs"))


def _with_lines(files: DataFrame) -> DataFrame:
    return files.withColumn("lines", F.split("content", "\n", -1))


def reconstructions(files: DataFrame) -> DataFrame:
    """One row per rebuilt value with its validation."""
    return (with_reconstructions(_with_lines(files))
            .select("scan_id", "file_path", F.posexplode_outer("recons").alias("ord", "r"))
            .filter(F.col("ord").isNotNull())
            .select("scan_id", "file_path", "ord", "r.target", "r.line_no", "r.value", "r.status", "r.kind",
                    F.coalesce("r.extent.length", F.length("r.value").cast("bigint")).alias("length"),
                    F.coalesce("r.extent.entropy", T.shannon_entropy(F.col("r.value"))).alias("entropy"), "r.fragments", "r.check.is_secret", "r.check.confidence", "r.check.secret_type",
                    "r.check.reason"))


def symbols(files: DataFrame) -> DataFrame:
    """Every resolved definition: variable, value, line and how it was defined."""
    return (_with_lines(files).withColumn("statements", statements_column())
            .withColumn("defs", definitions_column())
            .withColumn("symbols", resolved_column(True)["symbols"])
            .select("scan_id", "file_path", F.explode_outer("symbols").alias("s"))
            .filter(F.col("s").isNotNull()).select("scan_id", "file_path", "s.*"))
