"""Chat formatting, native: tool calls linked to results, ordered, validated and
serialised as canonical JSON (keys sorted, no blanks).

An assistant's text holds calls as <tool_call>{"id", "name", "arguments"}</tool_call>;
a turn of role "tool" is a result: {"tool_call_id", "content"}. A system turn can
declare its conversation's tools as <tools>[{"name", "parameters"}, ...]</tools>, where
parameters is a JSON schema (required; properties with their type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CALL = "struct<id:string,name:string,arguments:string>"
RESULT = "struct<tool_call_id:string,content:string>"
TOOL = "struct<required:array<string>,properties:map<string,struct<type:string>>>"
DECLARED = "array<struct<name:string,parameters:string>>"
NONE = "array<string>"


def quoted(c: Column) -> Column:
    """c as a JSON string; null as null."""
    made = F.to_json(F.struct(c.cast("string").alias("v")))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substring(made, F.lit(6), F.length(made) - 6))


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and without blanks; null where it is not JSON."""
    return F.to_json(F.try_parse_json(json))


def _fits(value: Column, kind: Column) -> Column:
    found = F.schema_of_variant(value)
    whole, number = found.isin("BIGINT", "TINYINT", "SMALLINT", "INT"), found.rlike("^(BIGINT|TINYINT|SMALLINT|INT|DOUBLE|FLOAT|DECIMAL)")
    return (
        F.when(kind == "string", found == "STRING").when(kind == "integer", whole | found.rlike(r"^DECIMAL\(\d+,0\)")).when(kind == "number", number)
        .when(kind == "boolean", found == "BOOLEAN").when(kind == "object", found.startswith("OBJECT")).when(kind == "array", found.startswith("ARRAY")).otherwise(True)
    )


def _hash(text: Column) -> Column:
    """Tells messages of one turn and role apart, and orders them."""
    return F.xxhash64(text)


def declared(messages: DataFrame) -> DataFrame:
    """d_conv, declared (name to schema): the tools that each conversation's system turns declare.

    Of equal names the least schema counts; what is not such a JSON list declares nothing.
    """
    found = messages.where((F.col("role") == "system") & F.contains("text", F.lit("<tools>"))).select("conv_id", F.substring_index(F.substring_index("text", "<tools>", -1), "</tools>", 1).alias("raw"))
    each = found.select("conv_id", F.explode(F.from_json("raw", DECLARED)).alias("t")).where("t.name is not null")
    each = each.groupBy("conv_id", "t.name").agg(F.min("t.parameters").alias("parameters")).select("conv_id", F.struct("name", F.from_json("parameters", TOOL).alias("tool")).alias("t"))
    return each.groupBy(F.col("conv_id").alias("d_conv")).agg(F.map_from_entries(F.collect_list("t")).alias("declared"))


def calls(messages: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """conv_id, turn, h, place, id, name, json, errors: every call of messages; h tells the messages of a turn apart.

    Arguments are validated against the tools that the conversation declares, else
    against tools (name, parameters), else not at all. errors lists, in order,
    unreadable, unknown_tool, not_an_object, missing:<argument> and type:<argument>.
    json is the call as canonical JSON.
    """
    pieces = F.split("text", "<tool_call>", -1)
    found = messages.where((F.col("role") == "assistant") & F.contains("text", F.lit("<tool_call>"))).select("conv_id", "turn", _hash(F.col("text")).alias("h"), F.posexplode(F.slice(pieces, F.lit(2), F.size(pieces))).alias("place", "piece"))
    at = ("conv_id", "turn", "h", "place")
    read = found.select(*at, F.substring_index("piece", "</tool_call>", 1).alias("raw"))
    read = read.select(*at, F.from_json("raw", CALL).alias("c"), canonical(F.col("raw")).isNull().alias("bad"))
    read = read.select(*at, "c.id", "c.name", F.coalesce("c.arguments", F.lit("{}")).alias("arguments"), "bad")
    own = declared(messages)
    read = read.withColumn("args", F.from_json("arguments", "map<string,variant>")).join(own, F.col("conv_id").eqNullSafe(F.col("d_conv")), "left")
    none = F.lit(None).cast(TOOL)
    if tools is not None:
        given = tools.groupBy(F.col("name").alias("t_name")).agg(F.min("parameters").alias("parameters")).select("t_name", F.from_json("parameters", TOOL).alias("given"))
        read = read.join(given, F.col("name") == F.col("t_name"), "left")
        known, tool = F.col("t_name").isNotNull(), F.col("given")
    else:
        known, tool = F.lit(True), none
    in_own = F.coalesce(F.map_contains_key("declared", F.coalesce("name", F.lit(""))), F.lit(False))
    read = read.withColumn("known", F.when(F.col("declared").isNull(), known).otherwise(in_own & F.col("name").isNotNull())).withColumn("tool", F.when(F.col("declared").isNull(), tool).when(in_own, F.try_element_at("declared", "name")).otherwise(none))
    empty = F.array().cast(NONE)
    missing = F.transform(F.filter(F.coalesce("tool.required", empty), lambda r: ~F.coalesce(F.map_contains_key("args", r), F.lit(False))), lambda r: F.concat(F.lit("missing:"), r))
    wrong = F.filter(F.array_sort(F.map_keys("args")), lambda k: ~F.coalesce(_fits(F.element_at("args", k), F.try_element_at("tool.properties", k)["type"]), F.lit(True)))
    wrong = F.transform(F.coalesce(wrong, empty), lambda k: F.concat(F.lit("type:"), k))
    checks = F.concat(F.array_compact(F.array(F.when(~F.col("known"), F.lit("unknown_tool")), F.when(F.col("args").isNull(), F.lit("not_an_object")))), missing, wrong)
    errors = F.when(F.col("bad"), F.array(F.lit("unreadable"))).otherwise(checks)
    json = F.concat(F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), quoted(F.col("arguments"))), F.lit(',"id":'), quoted(F.col("id")), F.lit(',"name":'), quoted(F.col("name")), F.lit("}"))
    return read.select(*at, "id", "name", json.alias("json"), errors.alias("errors"))


def format_chats(messages: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """conv_id, n_turns, n_calls, n_results, n_linked, errors, chat for each conversation.

    messages has conv_id, turn, role and text; other columns are not read. A
    result is joined by hash to the first call of its conversation with its
    identifier. Messages are in the topological order of these links that keeps
    closest to their turns (then role, then a hash of the text): a result that stands
    before its call comes just after the message with the call. errors lists call errors as
    <id>:<error>, duplicate:<id> for each identifier of several calls, unlinked:<id>
    for results without a call and unanswered:<id> for calls without a result,
    sorted. chat is canonical JSON: {"messages":[{"content","role","tool_call_id",
    "tool_calls"}, ...]}, the last two only where there are some.

    Null roles and texts are kept as null; a null conv_id is a conversation of
    its own. Repeated rows are repeated messages, whose calls share their
    identifiers. An empty table gives no rows. A conversation is one row of the
    result, so it has to fit into one.
    """
    rows = messages.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    found = calls(rows.distinct(), tools)
    place = lambda turn, role, h: F.struct(turn.alias("turn"), role.alias("role"), h.alias("h"))
    asked = place(F.col("turn"), F.lit("assistant"), F.col("h"))
    first = found.where("id is not null").groupBy("conv_id", "id").agg(F.min(asked).alias("call")).select(F.col("conv_id").alias("c_conv"), F.col("id").alias("c_id"), "call")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "json"))), lambda x: x["json"])
    issues = F.flatten(F.collect_list(F.transform("errors", lambda e: F.concat(F.coalesce("id", F.lit("?")), F.lit(":"), e))))
    made = found.groupBy("conv_id", "turn", "h").agg(listed.alias("calls"), issues.alias("issues"), F.collect_list("id").alias("ids")).select(F.col("conv_id").alias("m_conv"), F.col("turn").alias("m_turn"), F.col("h").alias("m_h"), "calls", "issues", "ids")
    result = F.when(F.col("role") == "tool", F.from_json("text", RESULT))
    typed = rows.withColumn("h", _hash(F.col("text"))).withColumn("result", result).withColumn("r_id", F.col("result.tool_call_id"))
    linked = typed.join(first, F.col("conv_id").eqNullSafe(F.col("c_conv")) & (F.col("r_id") == F.col("c_id")), "left")
    calling = (F.col("role") == "assistant") & F.contains("text", F.lit("<tool_call>"))
    joined = linked.join(made, F.col("conv_id").eqNullSafe(F.col("m_conv")) & F.col("turn").eqNullSafe(F.col("m_turn")) & (F.col("h") == F.col("m_h")) & calling, "left")
    content = F.when(F.col("r_id").isNotNull(), F.col("result.content")).when(F.col("calls").isNotNull(), F.btrim(F.regexp_replace("text", "(?s)<tool_call>.*?(</tool_call>|$)", ""))).otherwise(F.col("text"))
    line = F.concat(
        F.lit('{"content":'), quoted(content), F.lit(',"role":'), quoted(F.col("role")),
        F.when(F.col("r_id").isNotNull(), F.concat(F.lit(',"tool_call_id":'), quoted(F.col("r_id")))).otherwise(F.lit("")),
        F.when(F.col("calls").isNotNull(), F.concat(F.lit(',"tool_calls":['), F.array_join("calls", ","), F.lit("]"))).otherwise(F.lit("")),
        F.lit("}"),
    )
    own = place(F.col("turn"), F.col("role"), F.col("h"))
    # Links lead from calls to results alone, so this key sorts as repeatedly taking the first message whose call has been taken does.
    late = F.coalesce(F.col("call") > own, F.lit(False))
    order = F.struct(F.when(late, F.col("call")).otherwise(own).alias("at"), late.alias("moved"), own.alias("own"), line.alias("line"))
    empty = F.array().cast(NONE)
    chats = joined.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.sum(F.coalesce(F.array_size("calls"), F.lit(0)).cast("long")).alias("n_calls"),
        F.sum(F.when(F.col("role") == "tool", 1).otherwise(0)).alias("n_results"),
        F.count("c_id").alias("n_linked"),
        F.array_sort(F.collect_list(order)).alias("o"),
        F.flatten(F.collect_list("issues")).alias("issues"),
        F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"),
        F.collect_list("c_id").alias("answered"),
        F.collect_list(F.when((F.col("role") == "tool") & F.col("c_id").isNull(), F.coalesce("r_id", F.lit("?")))).alias("loose"),
    )
    tagged = lambda tag, ids: F.transform(ids, lambda i: F.concat(F.lit(tag), i))
    again = F.array_distinct(F.filter("ids", lambda x, i: x == F.get("ids", i - 1)))
    errors = F.array_sort(F.concat(F.coalesce("issues", empty), tagged("duplicate:", again), tagged("unlinked:", F.col("loose")), tagged("unanswered:", F.array_except("ids", "answered"))))
    chat = F.concat(F.lit('{"messages":['), F.array_join(F.transform("o", lambda x: x["line"]), ","), F.lit("]}"))
    return chats.select("conv_id", "n_turns", "n_calls", "n_results", "n_linked", errors.alias("errors"), chat.alias("chat"))
