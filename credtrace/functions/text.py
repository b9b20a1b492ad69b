"""Column functions over strings. All of them stay on the JVM and take columns or lambda variables alike."""

from __future__ import annotations

import functools
import re

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from credtrace.functions import catalog as C

STRIP = " \t\r\n\f\x0b"


def cached(build):
    """Keep what ``build`` returns per argument tuple, for columns that depend on plain values only.

    The larger expressions here take thousands of calls into the JVM to put together; a column is not tied to a
    DataFrame, so it is built once per JVM and used in every plan.
    """
    store = {}

    @functools.wraps(build)
    def lookup(*args):
        key = (id(SparkContext._gateway), args)
        if key not in store:
            store[key] = build(*args)
        return store[key]

    return lookup


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; a local name inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(STRIP))


def any_of(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def contains_any(text: Column, words: list[str]) -> Column:
    return text.rlike(any_of(words))


def count_of(text: Column, characters: str) -> Column:
    """How many characters of a text are among the given ones."""
    out = F.length(text) * len(characters)
    for c in characters:
        out = out - F.length(F.replace(text, F.lit(c), F.lit("")))
    return out


def empty_array(ddl: str) -> Column:
    return F.array().cast(ddl)


def shannon_entropy(text: Column) -> Column:
    """Bits per character; 0 for the empty string."""
    def of(chars: Column) -> Column:
        n = F.length(text).cast("double")
        # Every character is counted by what is left without it, not one by one.
        shares = F.transform(chars, lambda ch: (n - F.length(F.replace(text, ch, F.lit("")))) / n)
        return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))

    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(F.abs(of(F.array_distinct(F.split(text, "")))))


def string_class(text: Column) -> Column:
    return (F.when(text.rlike("^[0-9a-fA-F]+$"), "hex")
            .when(text.rlike("^[A-Za-z0-9+/=_-]+$"), "base64")
            .otherwise("general"))


def entropy_threshold(text: Column, hex_threshold: float = C.HEX_THRESHOLD,
                      base64_threshold: float = C.BASE64_THRESHOLD,
                      general_threshold: float = C.GENERAL_THRESHOLD) -> Column:
    kind = string_class(text)
    return (F.when(kind == "hex", F.lit(hex_threshold)).when(kind == "base64", F.lit(base64_threshold))
            .otherwise(F.lit(general_threshold)))


def entropy_confidence(entropy: Column, threshold: Column, has_context: Column) -> Column:
    base = F.least(F.lit(0.4), (entropy - threshold) / F.lit(3.0))
    return (F.when(has_context, F.least(F.lit(0.85), base + F.lit(0.35)))
            .otherwise(F.least(F.lit(0.5), base)))


def is_comment_line(line: Column) -> Column:
    return line.rlike(rf"^{C.WS}*(?:#|//|\*)")


def has_credential_keyword(context: Column) -> Column:
    return contains_any(F.lower(context), C.CREDENTIAL_KEYWORDS)


def line_window(lines: Column, number: Column) -> Column:
    """The lines from three before to three after a 1-based line number, clipped to the file."""
    first = F.greatest(number - 3, F.lit(1))
    last = F.least(number + 3, F.size(lines))
    return F.array_join(F.slice(lines, first, last - first + 1), "\n")


def assigned_variable(line: Column) -> Column:
    return F.regexp_extract(line, C.ASSIGNED_VARIABLE, 1)


def middle_line(context: Column) -> Column:
    return bind(F.split(context, "\n", -1),
                lambda ls: F.element_at(ls, (F.floor(F.size(ls) / 2) + 1).cast("int")))


def context_variable(context: Column, value: Column) -> Column:
    """Variable assigned on the first context line that holds the value, else on the middle line."""
    def pick(ls: Column) -> Column:
        hits = F.filter(ls, lambda l: F.contains(l, value))
        return F.coalesce(F.try_element_at(hits, F.lit(1)),
                          F.element_at(ls, (F.floor(F.size(ls) / 2) + 1).cast("int")))
    return F.regexp_extract(bind(F.split(context, "\n", -1), pick), C.CONTEXT_VARIABLE, 1)


def provider_type(value: Column, default: Column) -> Column:
    out = None
    for prefixes, name in C.PROVIDER_PREFIXES:
        hit = F.startswith(value, F.lit(prefixes[0]))
        for p in prefixes[1:]:
            hit = hit | F.startswith(value, F.lit(p))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def is_placeholder(value: Column) -> Column:
    low = F.lower(strip(value))
    letters = F.replace(F.replace(value, F.lit("-"), F.lit("")), F.lit("_"), F.lit(""))
    return (low.isin(C.PLACEHOLDER_VALUES)
            | value.rlike(C.PLACEHOLDER_PREFIX)
            | contains_any(low, C.PLACEHOLDER_SUBSTRINGS)
            | value.rlike(r"^(.)\1{7,}$|^(.{1,3})\2{4,}$")
            | (F.size(F.array_distinct(F.split(letters, ""))) <= 2))


def is_environment_sourced(text: Column) -> Column:
    return text.rlike(C.ENVIRONMENT_SOURCE)


def is_documentation(context: Column) -> Column:
    def block_state(inside: Column, line: Column) -> Column:
        toggled = F.when(line.rlike("\"\"\"|'''"), ~inside).otherwise(inside)
        opened = toggled | F.contains(line, F.lit("/*"))
        return opened & ~F.contains(line, F.lit("*/"))

    middle = strip(middle_line(context))
    return (context.rlike(C.DOCUMENTATION_MARKER)
            | (middle.rlike("^(?:#|//)") & contains_any(F.lower(middle), C.DOCUMENTATION_WORDS))
            | F.aggregate(F.split(context, "\n", -1), F.lit(False), block_state))


def is_test_path(path: Column) -> Column:
    return contains_any(F.lower(path), C.TEST_PATH_PARTS)


def is_config_variable(name: Column) -> Column:
    return name.rlike(C.CONFIG_VARIABLE)


def mask(secret: Column, visible: int = 4) -> Column:
    n = F.length(secret)
    return (F.when(n <= 2 * visible, F.repeat(F.lit("*"), n))
            .otherwise(F.concat(F.substring(secret, 1, visible),
                                F.repeat(F.lit("*"), n - 2 * visible),
                                F.substring(secret, -visible, visible))))


def mask_value(secret: Column, extent: Column) -> Column:
    """The mask of a value; of one that is longer than its text the middle is told by its number of characters."""
    ends = F.concat(F.left(secret, F.lit(4)), F.lit("*{"), (extent["length"] - 8).cast("string"), F.lit("}"), F.right(extent["tail"], F.lit(4)))
    return F.when(extent.isNotNull(), ends).otherwise(mask(secret))


def reconstructed_type(value: Column) -> Column:
    out = None
    for pattern, name in C.RECONSTRUCTED_TYPES:
        out = F.when(value.rlike(pattern), name) if out is None else out.when(value.rlike(pattern), name)
    return out.otherwise(F.lit(C.RECONSTRUCTED_DEFAULT))


def validate_reconstructed(value: Column, target: Column, statement: Column, status: Column, extent: Column | None = None) -> Column:
    """struct(is_secret, confidence, secret_type, reason) for a rebuilt value.

    ``extent`` (``ropes.EXTENT``, or null) says of a longer value what its beginning, ``value``, does not. A value that repeats up to
    three characters has too little entropy already.
    """
    def of_all(part, whole):
        return part if extent is None else F.when(extent.isNotNull(), whole).otherwise(part)

    word = lambda k: F.get(extent["words"], k)
    kinds = reconstructed_type(value if extent is None else F.when(word(0), F.concat(value, F.lit(" mongodb"))).otherwise(value))
    plain_url = value.rlike(r"(?i)^https?://") & ~value.rlike(r"^[a-zA-Z]+://[^/@]*:[^/@]*@")
    placeholder = of_all(is_placeholder(value), value.rlike(C.PLACEHOLDER_PREFIX) | (word(1) if extent is not None else F.lit(False)))
    white = of_all(value.rlike(C.WS), extent["white"] if extent is not None else None)
    entropy = of_all(shannon_entropy(value), extent["entropy"] if extent is not None else None)

    def judged(kind: Column) -> Column:
        known = kind.isin(C.PROVIDER_TYPES)
        reason = (F.when(is_environment_sourced(statement), "environment source")
                  .when(status == "UNRESOLVED", "unresolved")
                  .when(F.length(value) < C.RECONSTRUCTED_MIN_LENGTH, "too short")
                  .when(entropy < C.RECONSTRUCTED_MIN_ENTROPY, "low entropy")
                  .when(white & ~known, "prose")
                  .when(plain_url, "plain url")
                  .when(placeholder, "placeholder")
                  .otherwise(F.lit("")))
        confidence = (F.when(known, F.lit(C.CONFIDENCE_PROVIDER))
                      .when(target.rlike(C.CREDENTIAL_TARGET), F.lit(C.CONFIDENCE_TARGET))
                      .otherwise(F.lit(C.CONFIDENCE_OTHER)))
        confidence = F.when(status == "PARTIAL", confidence * F.lit(C.PARTIAL_FACTOR)).otherwise(confidence)
        return bind(reason, lambda why: F.struct((why == "").alias("is_secret"), confidence.alias("confidence"), kind.alias("secret_type"),
                                                 why.alias("reason")))

    return bind(kinds, judged)


def matches_sink(function: Column, names: list[str]) -> Column:
    low = F.lower(function)
    names_low = sorted({n.lower() for n in names})
    tails = sorted({n.split(".")[-1] for n in names_low if "." in n})
    hit = low.rlike(rf"^(?:{any_of(names_low)})(?:\.|$)")
    if tails:
        hit = hit | (F.contains(low, F.lit(".")) & low.rlike(rf"(?:{any_of(tails)})$"))
    return hit


SINK_DDL = "struct<sink_type:string,risk_level:string,function:string,line:int,code:string,description:string>"


def sink(kind, risk: str, function: Column, line: Column, code: Column, description: Column) -> Column:
    return F.struct(F.lit(kind).alias("sink_type"), F.lit(risk).alias("risk_level"), function.alias("function"),
                    line.cast("int").alias("line"), code.alias("code"), description.alias("description")
                    ).cast(SINK_DDL)


def classify_sink(function: Column, line: Column, code: Column) -> Column:
    """Sink a call ends in, by function first and by authentication words in the code second; null for none."""
    out = None
    for kind, risk, names, before, after in C.SINK_CATALOG:
        made = sink(kind, risk, function, line, code, F.concat(F.lit(before), function, F.lit(after)))
        cond = matches_sink(function, names)
        out = F.when(cond, made) if out is None else out.when(cond, made)
    low = F.lower(code)
    word = F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in C.AUTH_KEYS])
    return out.when(contains_any(low, C.AUTH_KEYS),
                    sink(C.AUTH, "HIGH", function, line, code,
                         F.concat(F.lit("Secret used in authentication context ('"), word, F.lit("')"))))


def sink_priority(kind: Column) -> Column:
    out = None
    for name, rank in C.SINK_PRIORITY.items():
        out = F.when(kind == name, rank) if out is None else out.when(kind == name, rank)
    return out.otherwise(F.lit(0))


def best_sink(sinks: Column) -> Column:
    """The sink of highest priority in an array; the first one on a tie; null for an empty array."""
    ranked = F.transform(sinks, lambda s, i: F.struct(sink_priority(s["sink_type"]).alias("p"),
                                                      (-i).alias("i"), s.alias("s")))
    return F.array_max(ranked)["s"]
