"""Logical statements of a source file, as an array on the file row.

A statement starts on a line where no bracket, string block or line continuation is open. Only the starts are folded
out of the lines; the text of a statement is then one slice. Strings, brackets and operands are recognised with
possessive patterns, which the regex engine runs as loops, so long statements need no deep stack.

Brackets may nest to any depth: what lies below ``LEVEL`` of them is set aside before the patterns look at a statement, and put
back in the pieces that they find.

Known limits: several statements on one line, code behind a closing block string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credtrace.functions import text as T

NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"
BLOCK_STRING = r'"""(?s:.*?)"""' + r"|'''(?s:.*?)'''"
PLAIN_STRING = r'(?!""")"(?:[^"\\]++|\\.)*+"' + r"|(?!''')'(?:[^'\\]++|\\.)*+'"
TICK_STRING = r"`(?:[^`\\]++|\\.)*+`"
STRING = f"(?:{BLOCK_STRING}|{PLAIN_STRING}|{TICK_STRING})"
PREFIXED = f"(?:[rRbBuUfF]{{0,2}}{STRING})"


def _balanced(depth: int) -> str:
    inner = rf"[^()\[\]{{}}\"'`]++|{STRING}"
    group = rf"[(\[{{](?:{inner})*+[)\]}}]"
    for _ in range(depth - 1):
        group = rf"[(\[{{](?:{inner}|{group})*+[)\]}}]"
    return group


#: Levels of brackets that the patterns see; a statement with more has the rest set aside by ``folded``.
LEVEL = 4
GROUP = _balanced(LEVEL)
ITEM = rf"(?:[^,()\[\]{{}}\"'`]++|{STRING}|{GROUP})++"
OPERAND = rf"(?:[^+()\[\]{{}}\"'`]++|{STRING}|{GROUP})++"

PLAIN = r"[^()\[\]{}\"'`]"
OPENING = rf"{PLAIN}*+[(\[{{]"
CLOSING = rf"[)\]}}]{PLAIN}*+"
#: Strings, and whole runs of opening or of closing brackets with the text between them, so that the nesting costs no tokens.
TOKEN = rf"{STRING}|(?:{OPENING})++|(?:{CLOSING})++|{PLAIN}++|[\"'`]"
MARK = "\x01"
BLOCK = 128


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def _depths(deltas: Column) -> Column:
    """Running sums, by block sums and the sum within the block, so that no array grows step by step."""
    sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(deltas) - 1) / BLOCK).cast("int")), lambda b: _total(F.slice(deltas, b * BLOCK + 1, F.lit(BLOCK))))
    before = T.bind(sums, lambda ss: F.transform(ss, lambda _, b: _total(F.slice(ss, F.lit(1), b))))
    return T.bind(before, lambda bs: F.transform(deltas, lambda _, i: F.get(bs, F.floor(i / BLOCK).cast("int")) + _total(
        F.slice(deltas, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1))))


def _runs(text: Column) -> Column:
    """array<struct(t, delta, depth)>: the tokens of a text, the brackets that each opens less those it closes, and how many are open
    behind it."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    delta = lambda t: F.when(t.rlike("^[\"'`]"), 0).otherwise(T.count_of(t, "([{") - T.count_of(t, ")]}"))
    return T.bind(tokens, lambda ts: T.bind(F.transform(ts, delta), lambda ds: F.zip_with(
        F.zip_with(ts, ds, lambda t, d: F.struct(t.alias("t"), d.alias("delta"))), _depths(ds),
        lambda x, depth: F.struct(x["t"].alias("t"), x["delta"].alias("delta"), depth.alias("depth")))))


def _set_aside(runs: Column) -> Column:
    """struct(text, deep): what each bracket of level ``LEVEL`` holds as ``deep``, its number between marks in the text."""
    def halves(x: Column, pattern: str, first: Column, kinds: tuple[int, int]) -> Column:
        """A run cut behind its first brackets, with what the halves are: 1 ends with an opening, -1 begins with a closing bracket."""
        half = lambda xs, kind: F.struct(F.array_join(xs, "").alias("t"), F.lit(kind).alias("kind"))
        return T.bind(F.regexp_extract_all(x["t"], F.lit(pattern), F.lit(0)), lambda ps: F.array(
            half(F.slice(ps, F.lit(1), first), kinds[0]), half(F.slice(ps, first + 1, F.size(ps)), kinds[1])))

    def pieces_of(x: Column) -> Column:
        before = x["depth"] - x["delta"]
        return (F.when((before < LEVEL) & (x["depth"] >= LEVEL), halves(x, OPENING, LEVEL - before, (1, 0)))
                .when((before >= LEVEL) & (x["depth"] < LEVEL), halves(x, CLOSING, before - LEVEL, (0, -1)))
                .otherwise(F.array(F.struct(x["t"].alias("t"), F.lit(0).alias("kind")))))

    def cut(tokens: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(tokens))
        of_kind = lambda kind: F.filter(places, lambda i: F.element_at(tokens, i)["kind"] == kind)
        texts = F.transform(tokens, lambda x: x["t"])

        def build(x: Column) -> Column:
            end = lambda k: F.coalesce(F.get(x["closes"], k), F.size(tokens) + 1)
            start = lambda k: F.when(k == 0, 1).otherwise(end(k - 1))
            piece = lambda a, b: F.array_join(F.slice(x["texts"], a, F.greatest(b - a, F.lit(0))), "")
            kept = F.transform(x["opens"], lambda o, k: F.concat(piece(start(k), o + 1), F.lit(MARK), k.cast("string"), F.lit(MARK)))
            return F.struct(
                F.concat(F.array_join(kept, ""), piece(start(F.size(x["opens"])), F.size(tokens) + 1)).alias("text"),
                F.transform(x["opens"], lambda o, k: piece(o + 1, end(k))).alias("deep"))
        return T.bind(F.struct(of_kind(1).alias("opens"), of_kind(-1).alias("closes"), texts.alias("texts")), build)

    return T.bind(F.flatten(F.transform(runs, pieces_of)), cut)


def folded(text: Column) -> Column:
    """struct(text, deep): a statement whose brackets nest no deeper than ``LEVEL``; ``deep`` is empty for most."""
    plain = F.struct(text.alias("text"), T.empty_array("array<string>").alias("deep"))
    clean = F.replace(text, F.lit(MARK), F.lit(" "))
    # A run holds brackets of one direction only; unclosed ones alone are left where they are.
    brackets = lambda runs: _total(F.transform(runs, lambda x: F.abs(x["delta"])))
    return F.when(T.count_of(text, "([{") <= LEVEL, plain).otherwise(T.bind(_runs(clean), lambda runs: F.when(
        F.exists(runs, lambda x: x["depth"] > LEVEL) & (brackets(runs) > 2 * LEVEL), _set_aside(runs)).otherwise(plain)))


def unfold(piece: Column, deep: Column) -> Column:
    """A piece of a statement with what was set aside of it."""
    marked = rf"{MARK}[0-9]+{MARK}"
    tokens = F.regexp_extract_all(piece, F.lit(rf"{marked}|[^{MARK}]++|{MARK}"), F.lit(0))
    return F.when((F.size(deep) > 0) & F.contains(piece, F.lit(MARK)), F.array_join(F.transform(tokens, lambda t: F.when(
        t.rlike(f"^{marked}$"), F.get(deep, F.replace(t, F.lit(MARK), F.lit("")).try_cast("int"))).otherwise(t)), "")).otherwise(piece)


STATEMENT = "struct<line_no:int,snippet:string,text:string,deep:array<string>>"


def is_python(language: Column) -> Column:
    return language == "Python"


def _code_line(line: Column, python: Column) -> Column:
    """struct(text, opens, closes, delta, joins): comment-free text and what the line does to the open brackets."""
    hash_free = F.regexp_replace(line, rf"^((?:[^\"'`#]++|{STRING})*+)#.*$", "$1")
    slash_free = F.regexp_replace(line, rf"^((?:[^\"'`/]++|{STRING}|/(?!/))*+)//.*$", "$1")
    has = lambda t, word: F.contains(t, F.lit(word))
    text = F.when(python, F.when(has(line, "#"), hash_free).otherwise(line)).otherwise(F.when(has(line, "//"), slash_free).otherwise(line))

    def measured(t: Column) -> Column:
        # Complete strings go, the opening of a block string stays.
        bare = F.when(has(t, '"') | has(t, "'") | has(t, "`"), F.regexp_replace(
            t, rf"(?:{BLOCK_STRING})|(\"\"\"|''')|(?:{PLAIN_STRING}|{TICK_STRING})", "$1")).otherwise(t)

        def cut(b: Column) -> Column:
            return (F.when(python, F.when(has(b, '"""') | has(b, "'''"), F.regexp_replace(b, "(?:\"\"\"|''').*$", "")).otherwise(b))
                    .otherwise(F.when(has(b, "`") | has(b, "/*"), F.regexp_replace(b, r"(?:`|/\*(?!.*\*/)).*$", "")).otherwise(b)))

        def told(x: Column) -> Column:
            return F.struct(t.alias("text"), (x["head"] != x["bare"]).alias("opens"),
                            (T.count_of(x["head"], "([{") - T.count_of(x["head"], ")]}")).alias("delta"), t.rlike(r"\\$").alias("joins"))

        return T.bind(T.bind(bare, lambda b: F.struct(b.alias("bare"), cut(b).alias("head"))), told)

    return T.bind(text, measured)


def statement_array(lines: Column, language: Column) -> Column:
    python = is_python(language)
    numbered = F.transform(lines, lambda l, i: F.struct((i + 1).alias("n"), l.alias("line"),
                                                        _code_line(l, python).alias("c")))
    kept = F.filter(numbered, lambda x: T.strip(x["c"]["text"]) != "")

    def assemble(code: Column) -> Column:
        zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(False).alias("joined"),
                        F.lit(False).alias("block"), T.empty_array("array<int>").alias("starts"))

        def step(acc: Column, x: Column) -> Column:
            c = x["c"]
            fresh = (acc["depth"] <= 0) & ~acc["joined"] & ~acc["block"]
            depth = (F.when(acc["block"], acc["depth"])
                     .otherwise(F.greatest(F.when(fresh, F.lit(0)).otherwise(acc["depth"]) + c["delta"], F.lit(0))))
            return F.struct((acc["i"] + 1).alias("i"), depth.alias("depth"),
                            (~acc["block"] & c["joins"]).alias("joined"),
                            F.when(acc["block"], ~F.regexp(x["line"], F.when(python, F.lit("\"\"\"|'''"))
                                                           .otherwise(F.lit(r"`|\*/")))).otherwise(c["opens"])
                            .alias("block"),
                            F.when(fresh, F.array_append(acc["starts"], acc["i"] + 1)).otherwise(acc["starts"])
                            .alias("starts"))

        starts = F.aggregate(code, zero, step, lambda acc: acc["starts"])

        def build(ss: Column) -> Column:
            def one(s: Column, i: Column) -> Column:
                stop = F.coalesce(F.try_element_at(ss, i + 2), F.size(code) + 1)
                texts = F.transform(F.slice(code, s, stop - s),
                                    lambda x: F.regexp_replace(T.strip(x["c"]["text"]), r"\\$", ""))
                first = F.element_at(code, s)
                joined = T.strip(F.array_join(texts, " "))
                text = F.when(python, joined).otherwise(T.strip(F.regexp_replace(joined, ";$", "")))
                return T.bind(T.bind(text, folded), lambda f: F.struct(
                    first["n"].cast("int").alias("line_no"), T.strip(first["line"]).alias("snippet"), f["text"].alias("text"), f["deep"].alias("deep")))
            return F.transform(ss, one)

        return T.bind(starts, build)

    return F.filter(T.bind(kept, assemble), lambda s: s["text"].rlike(r"[=(]"))


def split_items(text: Column) -> Column:
    """Top-level comma-separated items."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(ITEM), F.lit(0)), T.strip), lambda t: t != "")


def unwrap(value: Column) -> Column:
    """Without one pair of round brackets around the whole value, unless they make a tuple."""
    def of(v: Column) -> Column:
        inner = T.strip(F.substring(v, F.lit(2), F.length(v) - 2))
        return F.when(F.startswith(v, F.lit("(")) & v.rlike(rf"^\((?:[^()\[\]{{}}\"'`]++|{STRING}|{GROUP})*+\)$") & (F.size(split_items(inner)) == 1),
                      inner).otherwise(v)
    return T.bind(value, of)


def assignment(text: Column, language: Column) -> Column:
    """struct(target, value); empty target when the statement is no single-name assignment."""
    python = is_python(language)
    py, js = rf"^({NAME})\s*=(?!=)\s*(\S.*)$", rf"^(?:(?:const|let|var|export)\s+)*({NAME})\s*(?::[^=]+)?=(?![=>])\s*(\S.*)$"
    return F.struct(
        F.when(python, F.regexp_extract(text, py, 1)).otherwise(F.regexp_extract(text, js, 1)).alias("target"),
        unwrap(F.when(python, F.regexp_extract(text, py, 2)).otherwise(F.regexp_extract(text, js, 2))).alias("value"))


def literal_value(text: Column) -> Column:
    """Content of one or more adjacent string literals, with the common escapes undone."""
    def body(s: Column) -> Column:
        t = F.regexp_replace(F.regexp_replace(s, r"^[A-Za-z]{0,2}(?:\"\"\"|'''|[\"'`])", ""), "(?:\"\"\"|'''|[\"'`])$", "")
        return F.when(s.rlike("^[A-Za-z]?[rR]"), t).otherwise(F.regexp_replace(t, r"\\([\"'`\\])", "$1"))
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(PREFIXED), F.lit(0)), body), "")


def strip_strings(expr: Column) -> Column:
    """Expression text with strings removed but interpolated expressions kept."""
    formatted = F.regexp_extract_all(expr, F.lit(rf"(?:[rR]?[fF][rR]?{STRING}|{TICK_STRING})"), F.lit(0))
    inner = F.transform(formatted, lambda s: F.array_join(F.regexp_extract_all(s, F.lit(r"\{([^{}]*)\}"), F.lit(1)), " "))
    return F.when(expr.rlike("[\"'`]"), F.concat(F.regexp_replace(expr, PREFIXED, " "), F.lit(" "), F.array_join(inner, " "))).otherwise(expr)


def names_in(expr: Column) -> Column:
    """Distinct variable names an expression mentions, left to right; attributes and keywords are not variables."""
    return F.array_distinct(F.regexp_extract_all(
        strip_strings(expr), F.lit(rf"(?<![A-Za-z0-9_.$])({NAME})(?!\s*=(?!=))"), F.lit(1)))
