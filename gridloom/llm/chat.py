"""Tool-call linking for chat data, on SQL functions only.

Calls and results meet in a hash join by (conversation, call id). Calls are ordered
topologically by level: the longest chain of calls they depend on. Chains of single
dependencies, however long, are resolved by pointer jumping, calls with several
dependencies by rounds over what the chains leave. Arguments are checked against tool
schemas and everything is serialised as canonical JSON (sorted keys, no spaces).

All joins are on (conversation, call id), so a conversation that holds a third of all
turns is dealt over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import cut

CALL = "array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>"
#: How JSON types may answer a schema's type names.
KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DECIMAL.*|DOUBLE", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def canonical(text: Column) -> Column:
    """Canonical JSON of a JSON text, null where it doesn't parse."""
    return F.to_json(F.try_parse_json(text))


def tool_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that are written in messages (conv_id, turn, role, text).

    An assistant's text {"tool_calls": [{"id", "name", "arguments", "depends_on"}]} holds
    calls; a tool's text {"tool_call_id", "content"} holds a result. Other texts hold none.
    """
    said = messages.filter((F.col("role") == "assistant") & F.contains("text", F.lit('"tool_calls"')))
    calls = said.select("conv_id", "turn", F.posexplode(F.from_json(F.get_json_object("text", "$.tool_calls"), CALL)).alias("place", "c"))
    calls = calls.select("conv_id", F.col("c.id").alias("call_id"), "turn", "place", F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.depends_on").alias("depends_on"))
    told = messages.filter((F.col("role") == "tool") & F.contains("text", F.lit('"tool_call_id"')))
    results = told.select("conv_id", F.get_json_object("text", "$.tool_call_id").alias("call_id"), "turn", F.get_json_object("text", "$.content").alias("content"))
    return calls, results


def _unique(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row of each (conv_id, call_id), the least by order, and how many there were."""
    rest = [c for c in rows.columns if c not in ("conv_id", "call_id")]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("r")
    return rows.groupBy("conv_id", "call_id").agg(first, F.count("*").alias("copies")).select("conv_id", "call_id", *[F.col(f"r.{c}").alias(c) for c in rest], "copies")


def _jumped(single: DataFrame) -> DataFrame:
    """conv_id, call_id, root, dist: where each chain of single dependencies ends; chains into a cycle are left out."""
    cur = cut(single.select("conv_id", "call_id", F.col("parent").alias("root"), F.lit(1).cast("bigint").alias("dist")))
    n = cur.count()
    for _ in range(max(1, n).bit_length() + 1):
        via = cur.select("conv_id", F.col("call_id").alias("root"), F.col("root").alias("next"), F.col("dist").alias("more"))
        joined = cur.join(via, ["conv_id", "root"], "left")
        cur = cut(joined.select("conv_id", "call_id", F.coalesce("next", "root").alias("root"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.col("next").isNotNull().alias("open")))
        if not cur.filter("open").limit(1).count():
            break
    return cur.filter("not open").select("conv_id", "call_id", "root", "dist")


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level of every call (conv_id, call_id, depends_on); null in or behind a cycle.

    A call without known dependencies has level 0, any other one more than the highest
    of its dependencies. Dependencies on unknown calls are ignored.
    """
    nodes = calls.select("conv_id", "call_id")
    edges = calls.select("conv_id", "call_id", F.explode(F.array_distinct("depends_on")).alias("parent"))
    known = nodes.select("conv_id", F.col("call_id").alias("parent"))
    edges = cut(edges.join(known, ["conv_id", "parent"], "left_semi").select("conv_id", "call_id", "parent"))
    degree = cut(edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("parent").alias("parent")))
    chains = _jumped(degree.filter("n = 1").select("conv_id", "call_id", "parent"))
    several = degree.filter("n > 1").select("conv_id", "call_id")
    roots = nodes.join(degree, ["conv_id", "call_id"], "left_anti")
    done = roots.withColumn("level", F.lit(0).cast("bigint"))
    inner = edges.join(several, ["conv_id", "call_id"], "left_semi")
    ends = chains.select("conv_id", F.col("call_id").alias("parent"), "root", "dist")
    inner = cut(inner.join(ends, ["conv_id", "parent"], "left").select("conv_id", "call_id", F.coalesce("root", "parent").alias("root"), F.coalesce("dist", F.lit(0)).alias("dist")))
    waiting = several
    while waiting.limit(1).count():
        ready = inner.join(waiting, ["conv_id", "call_id"], "left_semi").join(done.select("conv_id", F.col("call_id").alias("root"), "level"), ["conv_id", "root"], "left")
        new = ready.groupBy("conv_id", "call_id").agg(F.count_if(F.col("level").isNull()).alias("open"), F.max(F.col("level") + F.col("dist")).alias("top")).filter("open = 0")
        new = cut(new.select("conv_id", "call_id", (F.col("top") + 1).alias("level")))
        if not new.limit(1).count():
            break
        done = cut(done.unionByName(new))
        waiting = cut(waiting.join(new, ["conv_id", "call_id"], "left_anti"))
    along = chains.join(done.select("conv_id", F.col("call_id").alias("root"), "level"), ["conv_id", "root"])
    found = done.unionByName(along.select("conv_id", "call_id", (F.col("level") + F.col("dist")).alias("level")))
    return nodes.join(found, ["conv_id", "call_id"], "left")


def schema_table(spark: SparkSession, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """name and fields of tools given as {tool: {field: (type, required)}}."""
    rows = [(tool, [(f, KINDS[kind], need) for f, (kind, need) in fields.items()]) for tool, fields in schemas.items()]
    return spark.createDataFrame(rows, "name string, fields array<struct<field:string,kind:string,required:boolean>>")


def _errors() -> Column:
    given = F.col("_given")
    value = lambda f: F.try_element_at(given, f["field"])
    missing = F.transform(F.filter("fields", lambda f: f["required"] & value(f).isNull()), lambda f: F.concat(F.lit("missing "), f["field"]))
    wrong = F.filter("fields", lambda f: value(f).isNotNull() & ~F.rlike(F.schema_of_variant(value(f)), F.concat(F.lit("^("), f["kind"], F.lit(")$"))))
    unknown = F.array_except(F.map_keys(given), F.transform("fields", lambda f: f["field"]))
    listed = F.concat(missing, F.transform(wrong, lambda f: F.concat(F.lit("type of "), f["field"])), F.transform(unknown, lambda f: F.concat(F.lit("unknown "), f)))
    return F.when(F.col("fields").isNull(), F.array(F.lit("unknown tool"))).when(given.isNull(), F.array(F.lit("arguments are no object"))).otherwise(F.array_sort(listed))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Calls with their results, order, validity and canonical JSON.

    calls: conv_id, call_id, turn, place, name, arguments (JSON), depends_on; results:
    conv_id, call_id, turn, content. Returns conv_id, call_id, turn, result_turn, level,
    status, errors and json. status is linked, unanswered (no result) or orphan (a result
    without a call, all call columns null). Where an id repeats in a conversation, the
    least turn and place counts. Null ids link to nothing: such calls are unanswered, such
    results orphans. Arguments that are no JSON object are an error, not a failure.
    """
    calls = cut(_unique(calls, ["turn", "place"]))
    results = _unique(results, ["turn"]).select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content")
    ordered = calls.join(levels(calls), ["conv_id", "call_id"], "left")
    checked = ordered.join(schemas, "name", "left")
    plain = F.when(F.ltrim("arguments").startswith("{"), F.try_parse_json("arguments"))
    checked = checked.withColumn("_given", F.from_json(F.to_json(plain), "map<string,variant>")).withColumn("errors", _errors()).withColumn("args", F.to_json(plain))
    linked = checked.drop("fields", "_given", "arguments").join(results, ["conv_id", "call_id"], "full")
    status = F.when(F.col("turn").isNull(), "orphan").when(F.col("result_turn").isNull(), "unanswered").otherwise("linked")
    parts = [("arguments", F.coalesce("args", F.lit("null"))), ("depends_on", F.coalesce(F.to_json(F.array_sort("depends_on")), F.lit("[]")))]
    parts += [("id", _quoted("call_id")), ("level", F.coalesce(F.col("level").cast("string"), F.lit("null"))), ("name", _quoted("name")), ("result", _quoted("content"))]
    json = F.concat(F.lit("{"), *[x for i, (k, v) in enumerate(parts) for x in (F.lit(("," if i else "") + f'"{k}":'), v)], F.lit("}"))
    return linked.select("conv_id", "call_id", "turn", "result_turn", "level", status.alias("status"), F.coalesce("errors", F.expr("cast(array() as array<string>)")).alias("errors"), json.alias("json"))


def _quoted(name: str) -> Column:
    """A string as JSON, null as null."""
    whole = F.to_json(F.struct(F.col(name).alias("x")))
    return F.when(F.col(name).isNull(), F.lit("null")).otherwise(F.substr(whole, F.lit(6), F.char_length(whole) - 6))


def reply_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as calls: a user's turn calls `reply` with its text, the assistant's next turn is the result.

    A call depends on the call two turns before, where there is one. Rows with a null
    conv_id or turn are in no conversation; of rows that repeat a turn, the least text counts.
    """
    turns = messages.filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn", "role").agg(F.min("text").alias("text"))
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    users = turns.filter("role = 'user'")
    earlier = users.select("conv_id", (F.col("turn") + 2).alias("turn"), F.lit(True).alias("before"))
    asked = users.join(earlier, ["conv_id", "turn"], "left")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("bigint")
    calls = asked.select(
        "conv_id", name(F.col("turn")).alias("call_id"), "turn", F.lit(0).alias("place"), F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"), F.coalesce(words, F.lit(0).cast("bigint")).alias("words"))).alias("arguments"),
        F.when(F.col("before"), F.array(name(F.col("turn") - 2))).otherwise(F.expr("cast(array() as array<string>)")).alias("depends_on"),
    )
    results = turns.filter("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


REPLY_SCHEMA = {"reply": {"prompt": ("string", True), "words": ("integer", True)}}


def format_chat(messages: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]] | None = None) -> DataFrame:
    """Linked calls of messages (conv_id, turn, role, text): written tool calls and turns as reply calls.

    An empty table gives an empty result; a call's null prompt is a missing argument.
    """
    named, told = tool_messages(messages)
    calls, results = reply_calls(messages)
    table = schema_table(messages.sparkSession, REPLY_SCHEMA | (schemas or {}))
    return link_tool_calls(calls.unionByName(named), results.unionByName(told), table)
