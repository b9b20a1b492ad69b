"""Chat formatting: tool calls linked to their results, ordered, validated and serialised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from credtrace.llm.common import written

_MESSAGE = ("content string, tool_call_id string, tool_calls array<struct<id string, name string, arguments string, depends_on array<string>, "
            "function struct<name string, arguments string>>>")
_SCHEMA = "struct<properties: map<string,struct<type: string>>, required: array<string>>"
_DECLARED = f"tools array<struct<name: string, parameters: {_SCHEMA}, function: struct<name: string, parameters: {_SCHEMA}>>>"
_KINDS = ["object", "array", "string", "boolean", "null", "integer", "number"]
TOOLS = "name string, parameter string, type string, required boolean"


def variant(json: Column) -> Column:
    return F.try_parse_json(json)


def parsed(conversations: DataFrame) -> DataFrame:
    """Messages with their JSON body where the text is an object that holds a call or a result, else as plain text."""
    body = F.when(F.ltrim("text").startswith("{"), F.from_json("text", _MESSAGE))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", body.alias("body"))


def calls_of(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, slot, call_id, tool, arguments, depends_on, nth), nth among the calls that share an identifier."""
    calls = messages.where("role = 'assistant'").select("conv_id", "turn", F.posexplode("body.tool_calls").alias("slot", "c")).select(
        "conv_id", "turn", "slot", F.col("c.id").alias("call_id"), F.coalesce("c.name", "c.function.name").alias("tool"),
        F.coalesce("c.arguments", "c.function.arguments").alias("arguments"), F.col("c.depends_on").alias("depends_on"))
    # Calls without an identifier are not counted; a key of their own keeps those of a conversation apart.
    alone = F.when(F.col("call_id").isNull(), F.xxhash64("turn", "slot"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "call_id", alone).orderBy("turn", "slot", "tool", "arguments"))
    return calls.withColumn("nth", F.when(F.col("call_id").isNotNull(), nth))


def results_of(messages: DataFrame) -> DataFrame:
    results = messages.where("role = 'tool' AND body.tool_call_id IS NOT NULL").select(
        "conv_id", "turn", F.col("body.tool_call_id").alias("call_id"), F.col("body.content").alias("content"))
    return results.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "call_id").orderBy("turn", "content")))


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls and results joined by identifier; the n-th result of an identifier answers its n-th call."""
    c = calls.select(*[F.col(x).alias(f"c_{x}") for x in calls.columns])
    return c.join(results, F.col("c_conv_id").eqNullSafe(F.col("conv_id")) & (F.col("c_call_id") == F.col("call_id")) & (
        F.col("c_nth") == F.col("nth")), "full_outer").select(
        F.coalesce("c_conv_id", "conv_id").alias("conv_id"), F.coalesce("c_call_id", "call_id").alias("call_id"),
        F.col("c_turn").alias("call_turn"), F.col("c_slot").alias("slot"), F.col("c_tool").alias("tool"),
        F.col("c_arguments").alias("arguments"), F.col("c_depends_on").alias("depends_on"), F.coalesce("c_nth", "nth").alias("nth"),
        F.col("turn").alias("result_turn"), "content", F.col("call_id").isNotNull().alias("has_result"))


def ordered(pairs: DataFrame) -> DataFrame:
    """Adds order_turn and level: a call comes after the results it depends on, a result after its call.

    Rounds settle the calls all of whose dependencies are settled; calls that no round settles depend on each other in a
    circle and keep a null level. There are as many rounds as the longest chain, each one join on (conversation, call).
    """
    pairs = pairs.withColumn("waits_for", F.array_distinct(F.coalesce("depends_on", F.array().cast("array<string>"))))
    edges = pairs.where("call_turn IS NOT NULL AND size(waits_for) > 0").select(
        "conv_id", "call_id", "nth", "call_turn", F.explode("waits_for").alias("needs"))
    free = pairs.where("call_turn IS NOT NULL").select("conv_id", "call_id", "nth", "call_turn", "result_turn", "waits_for")
    if edges.isEmpty():
        settled = free.select("conv_id", "call_id", "nth", F.lit(0).alias("level"), F.col("call_turn").alias("order_turn"))
    else:
        known = free.groupBy("conv_id", F.col("call_id").alias("needs")).agg(F.max(F.greatest("call_turn", "result_turn")).alias("ready"))
        open_edges = written(edges.join(known, ["conv_id", "needs"]).select("conv_id", "call_id", "nth", "call_turn", "needs", "ready"))
        settled = written(free.join(open_edges, ["conv_id", "call_id", "nth"], "left_anti").select(
            "conv_id", "call_id", "nth", F.lit(0).alias("level"), F.col("call_turn").alias("order_turn")))
        while True:
            done = settled.groupBy("conv_id", F.col("call_id").alias("needs")).agg(F.max("level").alias("l"), F.max("order_turn").alias("o"))
            waiting = open_edges.join(settled.select("conv_id", "call_id", "nth"), ["conv_id", "call_id", "nth"], "left_anti")
            fresh = waiting.join(done, ["conv_id", "needs"], "left").groupBy("conv_id", "call_id", "nth").agg(
                F.count(F.lit(1)).alias("n"), F.count("l").alias("met"), (F.max("l") + 1).alias("level"),
                F.greatest(F.max("call_turn"), F.max("ready"), F.max("o")).alias("order_turn")).where("n = met")
            fresh = written(fresh.select("conv_id", "call_id", "nth", "level", "order_turn"))
            if fresh.isEmpty():
                break
            settled = written(settled.unionByName(fresh))
    s = settled.select(F.col("conv_id").alias("s_conv"), F.col("call_id").alias("s_call"), F.col("nth").alias("s_nth"), "level", "order_turn")
    return pairs.join(s, F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("call_id") == F.col("s_call")) & (F.col("nth") == F.col("s_nth")),
                      "left").drop("s_conv", "s_call", "s_nth").withColumns({
        "order_turn": F.coalesce("order_turn", "call_turn", "result_turn"),  # a call without an identifier is no one's dependency
        "level": F.when(F.col("call_id").isNull() & F.col("call_turn").isNotNull(), F.coalesce("level", F.lit(0))).otherwise(F.col("level"))})


def checked(pairs: DataFrame, tools: DataFrame) -> DataFrame:
    """Adds problems: what is wrong with a call's arguments under the tool's schema, sorted, empty for a valid call."""
    parameters = F.collect_set(F.when(F.col("parameter").isNotNull(), F.struct("parameter", "type", "required"))).alias("schema")
    own = [F.col("conv_id").alias("known_conv")] if "conv_id" in tools.columns else []
    schemas = tools.groupBy(F.col("name").alias("known_tool"), *own).agg(parameters)
    same = F.col("tool") == F.col("known_tool")
    if own:
        same = same & F.col("conv_id").eqNullSafe(F.col("known_conv"))
    given = F.try_variant_get(variant(F.col("arguments")), "$", "map<string,variant>")
    kinds = F.transform_values(given, lambda k, v: F.schema_of_variant(v))

    def kind(of: Column) -> Column:
        return (F.when(of.startswith("OBJECT"), "object").when(of.startswith("ARRAY"), "array").when(of == "STRING", "string")
                .when(of == "BOOLEAN", "boolean").when(of == "VOID", "null").when(of == "BIGINT", "integer").otherwise("number"))

    joined = pairs.join(schemas, same, "left").drop("known_conv").withColumn("given", kinds)
    missing = F.transform(F.filter("schema", lambda p: p["required"] & ~F.array_contains(F.map_keys("given"), p["parameter"])),
                          lambda p: F.concat(F.lit("missing "), p["parameter"]))
    named = F.transform("schema", lambda p: p["parameter"])
    stray = F.transform(F.array_except(F.map_keys("given"), named), lambda k: F.concat(F.lit("unknown "), k))
    wrong = F.transform(F.filter("schema", lambda p: F.array_contains(F.map_keys("given"), p["parameter"]) & (
        kind(F.try_element_at("given", p["parameter"])) != p["type"]) & ~((p["type"] == "number") & (
            kind(F.try_element_at("given", p["parameter"])) == "integer"))), lambda p: F.concat(F.lit("type of "), p["parameter"]))
    problems = (F.when(F.col("call_turn").isNull(), F.array(F.lit("result without call"))).when(F.col("tool").isNull(), F.array(F.lit("no tool")))
                .when(F.col("known_tool").isNull(), F.array(F.lit("unknown tool"))).when(F.col("given").isNull(), F.array(F.lit("arguments are no object")))
                .otherwise(F.sort_array(F.concat(missing, stray, wrong))))
    spoilt = F.col("arguments").isNotNull() & variant(F.col("arguments")).isNull()
    problems = F.when(spoilt, F.array_append(F.filter(problems, lambda p: p != "arguments are no object"), F.lit("arguments are no JSON"))).otherwise(problems)
    return joined.withColumn("problems", F.when(F.col("level").isNull() & F.col("call_turn").isNotNull(), F.array_append(
        problems, F.lit("circular"))).otherwise(problems)).drop("given", "schema", "known_tool")


def declared_tools(conversations: DataFrame) -> DataFrame:
    """``TOOLS`` with the ``conv_id`` that each holds in: what system messages declare, JSON objects with ``tools`` whose parameters are
    JSON schemas. A tool without parameters has one row without any; a type that is no single known one is not checked."""
    body = F.from_json("text", _DECLARED)
    declared = conversations.where((F.col("role") == "system") & F.ltrim("text").startswith("{")).select("conv_id", F.explode(body["tools"]).alias("t"))
    named = declared.select("conv_id", F.coalesce("t.name", "t.function.name").alias("name"), F.coalesce("t.parameters", "t.function.parameters").alias("p"))
    return named.where("name IS NOT NULL").select("conv_id", "name", "p.required", F.explode_outer("p.properties").alias("parameter", "of")).select(
        "conv_id", "name", "parameter", F.when(F.col("of.type").isin(_KINDS), F.col("of.type")).alias("type"),
        F.coalesce(F.array_contains("required", F.col("parameter")), F.lit(False)).alias("required"))


def no_tools(spark) -> DataFrame:
    return spark.createDataFrame([], TOOLS)


def format_chat(conversations: DataFrame, tools: DataFrame) -> DataFrame:
    """One row for each event of a conversation (message, call, result) with its canonical JSON.

    An assistant message whose text is a JSON object with ``tool_calls`` makes a row for each call (and one for its
    ``content``); a tool message with a ``tool_call_id`` makes a result. Sorting a conversation by (order_turn, level,
    slot, kind) gives the formatted order; rows, not conversations, are the unit, so one huge conversation is no single
    task. Canonical JSON has sorted keys, no blanks, and leaves nulls out; arguments are put into the same form. Arguments that are no JSON, or hold a key twice, are kept as they
    are in ``arguments_text``, and ``problems`` says so.

    Null or empty texts are messages without or with empty content; broken JSON is plain text; null conversation ids are
    a conversation of their own, whose calls depend on nothing; results without a call and calls without a result keep
    their rows, as do repeated rows; no rows give no rows; further columns are ignored. Output: conv_id, turn, order_turn,
    level, slot, kind, role, call_id, tool, is_linked, problems, json.
    """
    messages = parsed(conversations)
    is_call = F.coalesce((F.col("role") == "assistant") & (F.size("body.tool_calls") > 0), F.lit(False))
    is_result = F.coalesce((F.col("role") == "tool") & F.col("body.tool_call_id").isNotNull(), F.lit(False))
    said = F.when(is_call, F.col("body.content")).otherwise(F.col("text"))
    plain = messages.where(~is_result & ~(is_call & F.col("body.content").isNull())).select(
        "conv_id", "turn", F.col("turn").alias("order_turn"), F.lit(0).alias("level"), F.lit(-1).alias("slot"), F.lit("message").alias("kind"), "role",
        F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("tool"), F.lit(None).cast("boolean").alias("is_linked"),
        F.lit("").alias("problems"), F.to_json(F.struct(said.alias("content"), "role")).alias("json"))
    pairs = checked(ordered(linked(calls_of(messages), results_of(messages))), tools)
    pairs = pairs.withColumn("problems", F.array_join("problems", "; "))
    both = F.col("call_turn").isNotNull() & F.col("has_result")
    arguments = F.coalesce(variant(F.col("arguments")), F.when(F.col("arguments").isNull(), variant(F.lit("null"))))
    spoilt = F.when(variant(F.col("arguments")).isNull(), F.col("arguments"))
    calls = pairs.where("call_turn IS NOT NULL").select(
        "conv_id", F.col("call_turn").alias("turn"), "order_turn", "level", "slot", F.lit("call").alias("kind"), F.lit("assistant").alias("role"), "call_id",
        "tool", both.alias("is_linked"), "problems", F.to_json(F.struct(arguments.alias("arguments"), spoilt.alias("arguments_text"),
                                                                       F.col("call_id").alias("id"), F.col("tool").alias("name"))).alias("json"))
    results = pairs.where("has_result").select(
        "conv_id", F.col("result_turn").alias("turn"), F.greatest("order_turn", "result_turn").alias("order_turn"), "level",
        F.coalesce("slot", F.lit(0)).alias("slot"), F.lit("result").alias("kind"), F.lit("tool").alias("role"), "call_id", "tool", both.alias("is_linked"),
        "problems", F.to_json(F.struct("content", F.lit("tool").alias("role"), F.col("call_id").alias("tool_call_id"))).alias("json"))
    return plain.unionByName(calls).unionByName(results)
