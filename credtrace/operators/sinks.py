"""Exposure sinks of a secret variable: from its propagation graph and straight from the code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credtrace.functions import catalog as C
from credtrace.functions import text as T
from credtrace.operators import dataflow as D

SINKS = f"array<{T.SINK_DDL}>"


def _known(sinks: Column) -> Column:
    return F.filter(sinks, lambda s: s.isNotNull())


def fact_sinks(facts: Column) -> Column:
    """For each fact the sink that a node of it is: arguments by function name, dict entries by authentication key."""
    def of(x: Column) -> Column:
        f = x["f"]
        function = F.regexp_extract(f["pre"], rf"^({D.TOKEN}(?:\.{D.TOKEN})*)\(", 1)
        key = F.lower(F.regexp_extract(f["pre"], rf"\.({D.TOKEN})$", 1))
        return (F.when(f["op"].isin("function_argument", "keyword_argument") & (function != ""), T.classify_sink(function, f["line"], f["snippet"]))
                .when((f["op"] == "dict_value") & key.isin(C.AUTH_KEYS),
                      T.sink(C.AUTH, "HIGH", f["pre"], f["line"], f["snippet"],
                             F.concat(F.lit("Secret assigned to authentication-related key '"), key, F.lit("'")))))
    return F.transform(facts, of).cast(SINKS)


def walk_sinks(facts: Column) -> Column:
    """For each fact of the wider walk over Python statements the sink that it is."""
    def of(x: Column) -> Column:
        f = x["f"]
        auth = T.sink(C.AUTH, "HIGH", F.concat(F.lit("dict['"), f["pre"], F.lit("']")), f["line"], f["snippet"],
                      F.concat(F.lit("Secret placed in authentication field '"), f["pre"], F.lit("'")))
        return F.when(f["op"] == "auth", auth).when(f["op"] != "mention", T.classify_sink(f["pre"], f["line"], f["snippet"]))
    return F.transform(facts, of).cast(SINKS)


def call_sinks(table: Column) -> Column:
    """For each line and call on it the sink that it is."""
    return F.transform(table, lambda t: F.transform(t["calls"], lambda c: T.classify_sink(c["func"], t["line"], t["snippet"]))).cast(f"array<{SINKS}>")


def graph_sinks(reached: Column, by_fact: Column) -> Column:
    """Sinks among the nodes of one seed."""
    return _known(F.transform(reached, lambda r: F.get(by_fact, r["fact"])))


def statement_sinks(walk: Column, by_fact: Column) -> Column:
    """Sinks that one seed reaches in the wider walk; ``walk`` has the numbers of its facts."""
    return _known(F.transform(walk, lambda k: F.get(by_fact, k)))


def line_sinks(table: Column, by_call: Column, variable: Column, lines: Column) -> Column:
    """Calls and authentication fields that hold the variable itself on one line, in any language."""
    def of(x: Column) -> Column:
        call = F.when(x["call"] >= 0, F.get(F.get(by_call, x["line"]), x["call"]))
        t = F.get(table, x["line"])
        key = F.when(x["pair"] >= 0, F.lower(F.get(t["pairs"], x["pair"])["key"]))
        field = F.when(key.isin(C.AUTH_KEYS), T.sink(
            C.AUTH, "HIGH", F.concat(F.lit("dict['"), key, F.lit("']")), t["line"], t["snippet"],
            F.concat(F.lit("Secret '"), variable, F.lit("' placed in authentication field '"), key, F.lit("'"))))
        return F.array(call, field)
    return _known(F.coalesce(F.flatten(F.transform(lines, of)), T.empty_array(SINKS)))


def container_sinks(by_call: Column, boxed: Column) -> Column:
    """Calls that get a one-line dict the variable was put into."""
    return _known(F.transform(boxed, lambda x: F.get(F.get(by_call, x["line"]), x["call"])))


def unique_sinks(sinks: Column) -> Column:
    """The first sink of every line and type."""
    keys = F.transform(sinks, lambda s: F.concat_ws(":", s["line"].cast("string"), s["sink_type"]))
    return T.bind(keys, lambda ks: F.filter(sinks, lambda s, i: F.array_position(ks, F.element_at(ks, i + 1)) == i + 1))


def best_of(direct: Column, from_graph: Column) -> Column:
    """Direct sinks come before the graph's best one; the highest priority wins, the first on a tie."""
    return T.best_sink(F.concat(direct, _known(F.array(T.best_sink(from_graph)))))
