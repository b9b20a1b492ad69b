"""Where a secret variable flows inside its file.

Facts say which names a place in the file reads and which names it taints. They come from logical statements for
Python and from single lines for every other language. Taint is then one pass over the facts of a file for all its secret
variables: a name is tainted only by facts after its source was, exactly in file order, and is never cleared.
Everything works on the file row, and only files with a secret get here. The pass looks names up in a dictionary, which Spark's
array functions do not have, and so runs over Arrow; it gets names and moments and gives back numbers of facts and lines.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from credtrace.functions import batches
from credtrace.functions import catalog as C
from credtrace.functions import text as T
from credtrace.operators import reconstruct as R
from credtrace.operators import statements as S

FACT = ("struct<line:int,snippet:string,op:string,srcs:array<string>,taints:array<string>,pre:string,post:string,"
        "target:string,edge:string>")
FACTS = f"array<{FACT}>"
LINE = ("struct<line:int,snippet:string,calls:array<struct<func:string,names:array<string>>>,"
        "pairs:array<struct<key:string,name:string>>,assigned:string,reads:array<string>,container:string>")
LINES = f"array<{LINE}>"

LEFT_SIDE = rf"(?:[A-Za-z0-9_$.,*\s]++|{S.STRING}|{S.GROUP})++=(?!=)\s*"
NOT_A_CALL = "(?!(?:return|assert|del|yield|raise|if|elif|while|not|lambda|await|import|from|global)\\b)"
CALL = rf"^{NOT_A_CALL}((?:.*\.)?)({S.NAME})\s*\(((?:[^()\[\]{{}}\"'`]++|{S.STRING}|{S.GROUP})*+)\)$"
CHAIN = rf"^(?:[A-Za-z0-9_$.]++|{S.STRING}|{S.GROUP})*+$"
KEYWORD = rf"^({S.NAME})\s*=(?!=)\s*(.*)$"
ENTRY = rf"^((?:[^:()\[\]{{}}\"'`]++|{S.STRING}|{S.GROUP})++):\s*(.*)$"


def _fact(line, snippet, op: str, srcs: Column, taints: Column, pre: Column, post: Column, target: Column,
          edge: str) -> Column:
    return F.struct(line.cast("int").alias("line"), snippet.alias("snippet"), F.lit(op).alias("op"),
                    srcs.alias("srcs"), taints.alias("taints"), pre.alias("pre"), post.alias("post"),
                    target.alias("target"), F.lit(edge).alias("edge")).cast(FACT)


def _no_names() -> Column:
    return T.empty_array("array<string>")


def _constant(text: Column) -> Column:
    """Text of a constant key, '' for anything that is not one."""
    t = T.strip(text)
    return (F.when(t.rlike(R.LITERAL_ONLY), S.literal_value(t))
            .when(t.rlike("^(?:[0-9]+|True|False|None)$"), t).otherwise(F.lit("")))


def parsed(statements: Column) -> Column:
    """Statements as struct(line, snippet, lefts, value, deep, call, entries): left sides, value, outermost call, dict."""
    def one(s: Column) -> Column:
        whole = rf"^((?:{LEFT_SIDE})+)(\S.*)$"
        left = F.when(F.contains(s["text"], F.lit("=")), F.regexp_extract(s["text"], whole, 1)).otherwise(F.lit(""))
        value = lambda left: S.unwrap(F.when(left != "", F.regexp_extract(s["text"], whole, 2)).otherwise(s["text"]))
        lefts = lambda left: F.when(left != "", F.filter(F.transform(F.split(left, "="), T.strip), lambda t: t != "")).otherwise(_no_names())
        names = lambda piece: S.names_in(S.unfold(piece, s["deep"]))

        def more(x: Column) -> Column:
            v = x["value"]
            called = F.when(F.contains(v, F.lit("(")) & F.contains(v, F.lit(")")) & v.rlike(CALL), F.regexp_extract(v, CALL, 1))
            owned = lambda prefix: F.struct(prefix.rlike(CHAIN).alias("is_call"), F.regexp_replace(prefix, r"\.$", "").alias("owner"),
                                            F.regexp_extract(v, CALL, 2).alias("name"))
            nothing = F.struct(F.lit(False).alias("is_call"), F.lit("").alias("owner"), F.lit("").alias("name"))
            return T.bind(T.bind(called, lambda p: F.when(p.isNotNull(), owned(p)).otherwise(nothing)), lambda c: of_call(x, c))

        def of_call(x: Column, c: Column) -> Column:
            v, is_call, owner, name = x["value"], c["is_call"], c["owner"], c["name"]
            dotted_owner = F.regexp_extract(owner, rf"(?:^|[)\]}}\"'`]\.)({S.NAME}(?:\.{S.NAME})*)$", 1)
            display = (F.when(owner == "", name)
                       .when(owner.rlike(rf"^{S.NAME}$"), F.concat(owner, F.lit("."), name))
                       .when(owner.rlike(rf"\.{S.NAME}$"), F.concat(F.lit("..."), name))
                       .otherwise(name))
            dotted = F.when(dotted_owner == "", name).otherwise(F.concat(dotted_owner, F.lit("."), name))
            items = F.when(is_call, S.split_items(F.regexp_extract(v, CALL, 3))).otherwise(_no_names())
            args = F.transform(items, lambda a: F.struct(
                F.when(F.startswith(a, F.lit("**")), F.lit("**kwargs")).otherwise(F.regexp_extract(a, KEYWORD, 1))
                .alias("key"),
                names(F.when(a.rlike(KEYWORD), F.regexp_extract(a, KEYWORD, 2)).otherwise(a)).alias("names")))
            entries = F.when(v.rlike(r"^\{.*\}$"), F.transform(
                F.filter(S.split_items(F.substring(v, F.lit(2), F.length(v) - 2)), lambda t: t.rlike(ENTRY)),
                lambda t: F.struct(_constant(F.regexp_extract(t, ENTRY, 1)).alias("key"),
                                   names(F.regexp_extract(t, ENTRY, 2)).alias("names"))))
            return F.struct(s["line_no"].alias("line"), s["snippet"].alias("snippet"), x["lefts"].alias("lefts"),
                            v.alias("value"), s["deep"].alias("deep"), is_call.alias("is_call"), display.alias("display"),
                            dotted.alias("dotted"), args.alias("args"),
                            F.coalesce(entries, F.array().cast("array<struct<key:string,names:array<string>>>"))
                            .alias("entries"))
        return T.bind(T.bind(left, lambda l: F.struct(value(l).alias("value"), lefts(l).alias("lefts"))), more)
    return F.transform(statements, one)


def statement_facts(items: Column) -> Column:
    """Facts of Python statements, in processing order: assignment, dict, subscript, concatenation, call arguments."""
    subscript = rf"^({S.NAME})\[(.*)\]$"

    def of(p: Column) -> Column:
        left = F.element_at(p["lefts"], 1)
        single = F.size(p["lefts"]) == 1
        named = single & left.rlike(R.NAME_ONLY)
        value, line, snippet = p["value"], p["line"], p["snippet"]
        nothing = T.empty_array(FACTS)
        plain_name = value.rlike(R.NAME_ONLY)

        assign = F.when(named & plain_name, F.array(_fact(
            line, snippet, "assignment", F.array(value), F.array(left), left, F.lit(""), left, "assignment")))
        entry = F.when(named, F.transform(
            F.filter(p["entries"], lambda e: F.size(e["names"]) > 0),
            lambda e: T.bind(F.when(e["key"] != "", F.concat(left, F.lit("."), e["key"]))
                             .otherwise(F.concat(left, F.lit("[?]"))),
                             lambda label: _fact(line, snippet, "dict_value", e["names"], F.array(left), label,
                                                 F.lit(""), label, "dict_insertion"))))
        container = F.regexp_extract(left, subscript, 1)
        key = _constant(F.regexp_extract(left, subscript, 2))
        slot = F.concat(container, F.lit("["), F.when(key == "", F.lit("?")).otherwise(key), F.lit("]"))
        stored = F.when(single & left.rlike(subscript) & plain_name, F.array(_fact(
            line, snippet, "subscript_assignment", F.array(value), F.array(container), slot, F.lit(""), slot,
            "subscript_assignment")))

        # A chain of sums is nested to the left, so a breadth-first look meets its operands in this order.
        def breadth_first(ops: Column) -> Column:
            n = F.size(ops)
            return F.concat(F.reverse(F.slice(ops, F.lit(3), F.greatest(n - 2, F.lit(0)))), F.slice(ops, 1, 2))

        operands = F.transform(F.regexp_extract_all(value, F.lit(S.OPERAND), F.lit(0)), lambda o: S.names_in(S.unfold(o, p["deep"])))
        sum_names = F.array_distinct(F.flatten(T.bind(operands, breadth_first)))
        joined = F.when(named & (p["is_call"] == F.lit(False)) & R.is_concat(value), T.bind(sum_names, lambda ns: F.when(
            F.size(ns) > 0, F.array(_fact(line, snippet, "concatenation", ns, F.array(left), left, F.lit(""), left,
                                          "concatenation"))).otherwise(nothing)))
        fn = p["display"]

        def passed(a: Column) -> Column:
            keyword = a["key"] != ""
            pre = F.when(keyword, F.concat(fn, F.lit("("), a["key"], F.lit("="))).otherwise(F.concat(fn, F.lit("(")))
            return F.struct(
                line.cast("int").alias("line"), snippet.alias("snippet"),
                F.when(keyword, "keyword_argument").otherwise("function_argument").alias("op"),
                a["names"].alias("srcs"), _no_names().alias("taints"), pre.alias("pre"), F.lit(")").alias("post"),
                F.concat(pre, F.lit(")")).alias("target"), F.lit("parameter_pass").alias("edge")).cast(FACT)

        # Positional arguments come before keyword arguments.
        used = F.filter(p["args"], lambda a: F.size(a["names"]) > 0)
        calls = F.when(p["is_call"], F.concat(
            F.transform(F.filter(used, lambda a: a["key"] == ""), passed),
            F.transform(F.filter(used, lambda a: a["key"] != ""), passed)))
        return F.concat(*[F.coalesce(x, nothing) for x in (assign, entry, stored, joined, calls)])

    return F.flatten(F.transform(items, of))


def sink_facts(items: Column) -> Column:
    """Facts of the wider walk for direct sinks: any assignment that mentions a tainted name taints its targets."""
    def of(p: Column) -> Column:
        line, snippet = p["line"], p["snippet"]
        targets = F.filter(p["lefts"], lambda t: t.rlike(R.NAME_ONLY))
        is_assign = F.size(p["lefts"]) > 0
        empty = F.lit("")
        mention = F.when(is_assign, F.array(_fact(line, snippet, "mention", S.names_in(S.unfold(p["value"], p["deep"])), targets, empty,
                                                  empty, empty, "")))
        fields = F.when(is_assign, F.transform(
            F.filter(p["entries"], lambda e: F.lower(e["key"]).isin(C.AUTH_KEYS)),
            lambda e: _fact(line, snippet, "auth", e["names"], targets, e["key"], empty, empty, "")))
        call = F.when(p["is_call"], F.array(_fact(
            line, snippet, "call", F.flatten(F.transform(p["args"], lambda a: a["names"])), _no_names(), p["dotted"],
            empty, empty, "")))
        return F.filter(F.concat(*[F.coalesce(x, T.empty_array(FACTS)) for x in (mention, fields, call)]),
                        lambda f: F.size(f["srcs"]) > 0)
    return F.flatten(F.transform(items, of))


TOKEN = f"{C.WORD}+"
LINE_CALL = rf"({TOKEN}(?:\.{TOKEN})*){C.WS}*\(([^)]*)\)"
LINE_PAIR = rf"[\"']([A-Za-z0-9_-]+)[\"']{C.WS}*:{C.WS}*({TOKEN})"
LINE_ASSIGN = rf"^{C.WS}*(?:(?:const|let|var|export){C.WS}+)?({TOKEN}){C.WS}*={C.WS}*(.*)$"
LINE_CONTAINER = rf"^{C.WS}*({TOKEN}){C.WS}*={C.WS}*\{{"


def line_table(lines: Column) -> Column:
    """Lines that call, pair or assign, with the words each of these holds."""
    numbered = F.filter(F.transform(lines, lambda l, i: F.struct((i + 1).alias("n"), l.alias("l"))),
                        lambda x: x["l"].rlike("[(:=]"))

    def one(x: Column) -> Column:
        line = x["l"]
        calls = F.zip_with(F.regexp_extract_all(line, F.lit(LINE_CALL), F.lit(1)),
                           F.regexp_extract_all(line, F.lit(LINE_CALL), F.lit(2)),
                           lambda f, a: F.struct(f.alias("func"), F.array_distinct(
                               F.regexp_extract_all(a, F.lit(TOKEN), F.lit(0))).alias("names")))
        pairs = F.zip_with(F.regexp_extract_all(line, F.lit(LINE_PAIR), F.lit(1)),
                           F.regexp_extract_all(line, F.lit(LINE_PAIR), F.lit(2)),
                           lambda k, v: F.struct(k.alias("key"), v.alias("name")))
        # A line without the sign that a pattern needs never meets it.
        has = lambda sign: F.contains(line, F.lit(sign))
        none = lambda fields: T.empty_array(f"array<struct<{fields}>>")
        return F.struct(
            x["n"].alias("line"), T.strip(line).alias("snippet"),
            F.when(has("(") & has(")"), calls).otherwise(none("func:string,names:array<string>")).alias("calls"),
            F.when(has(":"), pairs).otherwise(none("key:string,name:string")).alias("pairs"),
            F.when(has("="), F.regexp_extract(line, LINE_ASSIGN, 1)).otherwise(F.lit("")).alias("assigned"),
            F.when(has("="), F.array_distinct(F.regexp_extract_all(F.regexp_extract(line, LINE_ASSIGN, 2), F.lit(TOKEN), F.lit(0))))
            .otherwise(_no_names()).alias("reads"),
            F.when(has("=") & has("{"), F.regexp_extract(line, LINE_CONTAINER, 1)).otherwise(F.lit("")).alias("container"))

    return F.filter(F.transform(numbered, one).cast(LINES), lambda t: (F.size(t["calls"]) > 0)
                    | (F.size(t["pairs"]) > 0) | (t["assigned"] != ""))


def first_call(table_row: Column, name: Column) -> Column:
    """Function of the first call on a line whose arguments hold the word; null for none."""
    return F.try_element_at(F.filter(table_row["calls"], lambda c: F.array_contains(c["names"], name)), F.lit(1))["func"]


def line_facts(table: Column, seeds: Column) -> Column:
    """Facts of source lines for languages other than Python, one per line, word and kind."""
    possible = F.array_union(seeds, F.array_distinct(F.transform(table, lambda t: t["assigned"])))

    def of(t: Column) -> Column:
        known = F.filter(t["reads"], lambda w: F.array_contains(possible, w) & (w != t["assigned"]))
        assigned = F.transform(known, lambda w: _fact(t["line"], t["snippet"], "assignment", F.array(w),
                                                      F.array(t["assigned"]), t["assigned"], F.lit(""),
                                                      t["assigned"], "assignment"))
        words = F.filter(F.array_distinct(F.flatten(F.transform(t["calls"], lambda c: c["names"]))),
                         lambda w: F.array_contains(possible, w))
        passed = F.transform(words, lambda w: T.bind(first_call(t, w), lambda fn: _fact(
            t["line"], t["snippet"], "function_argument", F.array(w), _no_names(), F.concat(fn, F.lit("(")),
            F.lit(")"), F.concat(fn, F.lit("()")), "parameter_pass")))
        keyed = F.filter(t["pairs"], lambda q: q["key"].rlike(f"^{TOKEN}$") & F.array_contains(possible, q["name"]))
        first = F.filter(keyed, lambda q, i: F.array_position(F.transform(keyed, lambda z: z["name"]), q["name"]) == i + 1)
        inserted = F.transform(first, lambda q: T.bind(F.concat(F.lit("[dict]."), q["key"]), lambda label: _fact(
            t["line"], t["snippet"], "dict_value", F.array(q["name"]), _no_names(), label, F.lit(""), label,
            "dict_insertion")))
        return F.concat(assigned, passed, inserted)

    return F.when(F.size(table) > 0, F.flatten(F.transform(table, of))).otherwise(T.empty_array(FACTS))


def numbered(facts: Column, by_line) -> Column:
    """Facts with the moment they happen: their line, or their place in the statement order."""
    return F.transform(facts, lambda f, i: F.struct(F.when(by_line, f["line"]).otherwise(i + 1).alias("pos"),
                                                    f.alias("f")))


REACH = ("array<struct<hits:array<struct<fact:int,source:string,since:int>>,tainted:array<struct<name:string,time:int>>,walk:array<int>,"
         "lines:array<struct<line:int,call:int,pair:int>>,boxed:array<struct<line:int,call:int>>>>")


def spread(facts: list, seeds: list[tuple[str, int]]) -> tuple[list[list], list[dict]]:
    """Facts that each seed reaches, as (number, source, since), and the names it taints with their first moment.

    One pass over the facts for all seeds: every name knows which seeds taint it since when, so a fact costs as much as the
    seeds that reach it. A seed is looked for in the sources in their order; a moment counts only after the one before.
    """
    held, hits, tainted = {}, [[] for _ in seeds], [{name: start} for name, start in seeds]
    for seed, (name, start) in enumerate(seeds):
        held.setdefault(name, {})[seed] = start
    for number, (moment, sources, targets) in enumerate(facts):
        reached = {}
        for source in sources:
            for seed, since in held.get(source, {}).items():
                if since < moment and seed not in reached:
                    reached[seed] = source, since
        for seed in sorted(reached):
            hits[seed].append((number, *reached[seed]))
            for target in targets:
                if target not in tainted[seed]:
                    tainted[seed][target] = moment
                    held.setdefault(target, {})[seed] = moment
    return hits, tainted


def in_lines(table: list, names: list[str]) -> tuple[list[list], list[list]]:
    """For each name the lines that call with it or pair it, and the calls with a container that one line puts it into."""
    calls, pairs, boxes = {}, {}, {}
    for line, (arguments, keyed, container) in enumerate(table):
        for call, own in enumerate(arguments):
            for name in own:
                calls.setdefault(name, {}).setdefault(line, call)
        for pair, name in enumerate(keyed):
            pairs.setdefault(name, {}).setdefault(line, pair)
            if container:
                boxes.setdefault(name, set()).add(container)
    direct, boxed = [], []
    for name in names:
        own, fields = calls.get(name, {}), pairs.get(name, {})
        direct.append([(k, own.get(k, -1), fields.get(k, -1)) for k in sorted({*own, *fields})])
        held = sorted(boxes.get(name, ()))
        boxed.append([(line, call) for line, _, call in sorted((line, place, call) for place, c in enumerate(held) for line, call in calls.get(c, {}).items())])
    return direct, boxed


def _facts_of(facts: pa.Array) -> list[list]:
    offsets, x = batches.items(facts)
    return batches.cut(list(zip(batches.plain(x.field("pos")), batches.plain_lists(x.field("srcs")), batches.plain_lists(x.field("taints")))), offsets)


def _reached(files: pa.Array) -> pa.Array:
    at, s = batches.items(files.field("seeds"))
    seeds = batches.cut(list(zip(batches.plain(s.field("variable")), batches.plain(s.field("start")))), at)
    lines_at, t = batches.items(files.field("table"))
    calls_at, calls = batches.items(t.field("calls"))
    tables = batches.cut(list(zip(batches.cut(batches.plain_lists(calls), calls_at), batches.plain_lists(t.field("names")), batches.plain(t.field("container")))),
                         lines_at)
    hits, tainted, walks, lines, boxed = [], [], [], [], []
    for own, facts, walk, table in zip(seeds, _facts_of(files.field("facts")), _facts_of(files.field("walk")), tables):
        if own:
            of_facts, names = spread(facts, own)
            of_walk, _ = spread(walk, [(name, 0) for name, _ in own])
            of_lines, of_boxes = in_lines(table, [name for name, _ in own])
            hits += of_facts
            tainted += [list(n.items()) for n in names]
            walks += [[h[0] for h in w] for w in of_walk]
            lines += of_lines
            boxed += of_boxes
    number, text = pa.int32(), pa.string()
    return pa.ListArray.from_arrays(pa.array(at, number), pa.StructArray.from_arrays([
        batches.as_lists(hits, {"fact": number, "source": text, "since": number}), batches.as_lists(tainted, {"name": text, "time": number}),
        pa.ListArray.from_arrays(batches.offsets_of(walks), pa.array([k for w in walks for k in w], number)),
        batches.as_lists(lines, {"line": number, "call": number, "pair": number}), batches.as_lists(boxed, {"line": number, "call": number})],
        names=["hits", "tainted", "walk", "lines", "boxed"]))


def reached_by_file(files: pa.Array) -> pa.Array:
    """An Arrow batch of (seeds, facts, walk, table) rows as REACH rows, a struct for each seed."""
    number, text = pa.int32(), pa.string()
    entries = lambda **fields: pa.list_(pa.struct(list(fields.items())))
    return batches.joined([_reached(part) for part in batches.slices(files)], entries(
        hits=entries(fact=number, source=text, since=number), tainted=entries(name=text, time=number), walk=pa.list_(number),
        lines=entries(line=number, call=number, pair=number), boxed=entries(line=number, call=number)))


def reach_given(seeds: Column, facts: Column, walk: Column, table: Column, by_line: Column) -> Column:
    """What ``reach`` needs of a file: names and moments only."""
    moments = lambda xs: F.transform(xs, lambda x: F.struct(
        x["pos"].cast("int").alias("pos"), x["f"]["srcs"].alias("srcs"), x["f"]["taints"].alias("taints")))
    return F.struct(
        F.transform(seeds, lambda s: F.struct(s["variable"].alias("variable"), F.when(by_line, s["line"]).otherwise(0).alias("start"))).alias("seeds"),
        moments(facts).alias("facts"), moments(walk).alias("walk"), F.transform(table, lambda t: F.struct(
            F.transform(t["calls"], lambda c: c["names"]).alias("calls"), F.transform(t["pairs"], lambda q: q["name"]).alias("names"),
            t["container"].alias("container"))).alias("table"))


def reach(given: Column) -> Column:
    """For every seed what it reaches, by number: facts, walk facts, lines of the table."""
    def run(files: pa.Array) -> pa.Array:
        return reached_by_file(files)

    return F.arrow_udf(run, REACH)(given)


NODES = ("array<struct<variable:string,line:int,operation:string,snippet:string,source:string,target:string,"
         "edge:string>>")


def trace(facts: Column, hits: Column, by_line) -> Column:
    """Nodes of the facts that one seed reaches, in the order they are reached."""
    def node(h: Column) -> Column:
        def made(x: Column) -> Column:
            f, src = x["f"], h["source"]
            with_source = f["op"].isin("function_argument", "keyword_argument")
            rank = F.when(f["op"] == "assignment", 0).when(f["op"] == "function_argument", 1).otherwise(2)
            return F.struct(
                x["pos"].alias("pos"), F.when(by_line, h["since"]).otherwise(0).alias("since"),
                F.when(by_line, src).otherwise("").alias("by"), F.when(by_line, rank).otherwise(0).alias("rank"),
                F.when(with_source, F.concat(f["pre"], src, f["post"])).otherwise(f["pre"]).alias("variable"),
                f["line"].alias("line"), f["op"].alias("operation"), f["snippet"].alias("snippet"),
                src.alias("source"), f["target"].alias("target"), f["edge"].alias("edge"), h["fact"].alias("fact"))
        return T.bind(F.get(facts, h["fact"]), made)

    return F.array_sort(F.transform(hits, node))


def as_nodes(reached: Column) -> Column:
    return F.transform(reached, lambda r: F.struct(*[r[c].alias(c) for c in (
        "variable", "line", "operation", "snippet", "source", "target", "edge")])).cast(NODES)
