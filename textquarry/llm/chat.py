"""Chat formatting with tool-call linking.

Input rows are messages (conv_id, turn, role, text) and, where a message calls a tool or answers a
call, the call's identifier, tool name and JSON arguments. One aggregation per identifier says which
call is its first and whether it is answered; calls and results are hash-joined with that index. In
the topological order (place, depth, kind, turn) a result follows its call, and a call that needs
another call's result follows that result. Arguments are validated against the tool's schema; each
message is serialised as canonical JSON: keys in order, no white space, nulls left out.

Rows stay rows: no conversation is gathered, so one that holds a third of all turns is spread like any
other. A message's place is a key, not a running number: the latest turn of a call and of the calls
that it depends on; depth is the number of those. Chains of calls are followed to their ends by
pointer doubling, however long; what runs into a circle is reported, not placed.

The plain conversations table has no tool calls. Its adapter reads each user turn as a call of the
tool `reply` with arguments {"question", "turn"} that needs the result of the call two turns before,
and an assistant turn as the result of the turn before it.

Defined results: one row in, one row out; null texts are null content, left out of the JSON; a null
identifier (in the adapter: a null conv_id or turn) links nothing; of repeated calls of one identifier,
identical ones too, the earliest is linked and the others are errors at their own turn; every result
of an identifier is linked to its call; results without a call are orphans, calls without a result are
open; texts may be of any length; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, table

#: name -> (JSON type, required, least, most): `least`/`most` bound a string's length or a number; None: no bound.
REPLY = {"question": ("string", True, 1, None), "turn": ("integer", True, 0, None)}
TOOLS = {"reply": REPLY}
_KINDS = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "FLOAT", "DECIMAL"], "boolean": ["BOOLEAN"]}


def canonical(column: str) -> Column:
    """A JSON text in canonical form, null if it is none or has a key twice."""
    return F.to_json(F.try_parse_json(column))


def argument_errors(arguments: Column, tool: Column, tools: dict = TOOLS) -> Column:
    """array<string> of what is wrong with the arguments under the tool's schema, in the schema's order."""
    value = F.try_parse_json(arguments)
    plain = F.from_json(F.to_json(value), "map<string,string>")
    cases = []
    for name, schema in tools.items():
        checks: list[Column] = []
        for key, (kind, required, least, most) in schema.items():
            got = F.try_variant_get(value, f"$.{key}", "variant")
            shape = F.regexp_extract(F.schema_of_variant(got), "^[A-Z]+", 0)
            absent = got.isNull() | (shape == "VOID")
            size = F.try_variant_get(value, f"$.{key}", "double") if kind in ("integer", "number") else F.length(F.try_variant_get(value, f"$.{key}", "string"))
            bounds = F.lit(False) if kind == "boolean" else (F.lit(False) if least is None else size < least) | (F.lit(False) if most is None else size > most)
            checks.append(F.when(absent, F.lit(f"missing `{key}`") if required else None).when(~shape.isin(_KINDS[kind]), F.lit(f"`{key}` must be {kind}")).when(bounds, F.lit(f"`{key}` out of bounds")))
        unknown = F.transform(F.array_sort(F.array_except(F.coalesce(F.map_keys(plain), F.array().cast("array<string>")), F.array(*map(F.lit, schema)))), lambda k: F.concat(F.lit("unknown `"), k, F.lit("`")))
        found = F.concat(F.filter(F.array(*checks), lambda e: e.isNotNull()), unknown)
        cases.append((name, F.when(plain.isNull(), F.array(F.lit("arguments are no JSON object"))).otherwise(found)))
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for name, errors in cases:
        out = out.when(tool == name, errors)
    return out.otherwise(F.array(F.lit("unknown tool")))


def _chains(calls: DataFrame) -> DataFrame:
    """(call_id, depth, place) of calls (call_id, turn, needs), one row each: the links to the chain's end and its latest turn, null where it runs into a circle.

    Each round doubles the links followed. A chain that ends has a call whose end is reached in the next
    round, so when a round reaches no end more, what is open is circular.
    """
    known = calls.select(F.col("call_id").alias("up"))
    now = durable(calls.join(known, F.col("needs") == F.col("up"), "left").select("call_id", "up", F.col("up").isNotNull().cast("int").alias("depth"), F.col("turn").alias("place")))
    open_, before = now.filter("up IS NOT NULL").count(), None
    while open_ and open_ != before:
        on = now.select(F.col("call_id").alias("_id"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("place").alias("_place"))
        now = durable(now.join(on, F.col("up") == F.col("_id"), "left").select("call_id", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.greatest("place", "_place").alias("place")))
        open_, before = now.filter("up IS NOT NULL").count(), open_
    ended = F.col("up").isNull()
    return now.select("call_id", F.when(ended, F.col("depth")).alias("depth"), F.when(ended, F.col("place")).alias("place"))


def _index(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(call_id, first, turn, needs, answered): one row per identifier; first: the row of its earliest call, null if it has none."""
    none = F.lit(None).cast("long")
    said = F.struct(F.col("turn").cast("long").alias("turn"), F.xxhash64("tool", "arguments", "needs").alias("h"), F.col("_row"), F.col("needs"))
    asks = calls.select("call_id", said.alias("call"), F.lit(False).alias("result"))
    answers = results.select("call_id", F.lit(None).cast(asks.schema["call"].dataType).alias("call"), F.lit(True).alias("result"))
    per = asks.unionByName(answers).filter("call_id IS NOT NULL").groupBy("call_id").agg(F.min("call").alias("call"), F.max("result").alias("answered"))
    return per.select("call_id", F.coalesce("call._row", none).alias("first"), "call.turn", "call.needs", "answered")


def _indexed(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Rows hash-joined with their identifier's row of the index, which is unique and narrow; rows without an identifier pass by."""
    joined = rows.filter("call_id IS NOT NULL").join(index.hint("shuffle_hash"), "call_id", "left")
    more = [F.lit(None).cast(f.dataType).alias(f.name) for f in index.schema if f.name != "call_id"]
    return joined.unionByName(rows.filter("call_id IS NULL").select("*", *more))


def linked(calls: DataFrame, results: DataFrame, tools: dict = TOOLS) -> tuple[DataFrame, DataFrame]:
    """Calls (call_id, turn, tool, arguments, needs) with errors, depth, place and whether they are answered; results with their call's place and depth.

    In the order (place, depth, kind, turn) a call comes after the result that it needs, even one of a later turn.

    `needs` is the identifier of the call whose result this call uses, or null.
    """
    calls = durable(calls.withColumn("_row", F.monotonically_increasing_id()))  # rows keep their numbers from here on
    index = durable(_index(calls, results))
    asked = index.filter("first IS NOT NULL")
    if asked.filter("needs IS NOT NULL").limit(1).count():
        places = _chains(asked.select("call_id", "turn", "needs"))
    else:
        places = asked.select("call_id", F.lit(0).alias("depth"), F.col("turn").alias("place"))
    index = durable(index.select("call_id", "first", "answered").join(places, "call_id", "left"))
    checked = _indexed(calls, index)
    repeated = F.col("call_id").isNotNull() & (F.col("_row") != F.col("first"))
    errors = F.concat(argument_errors(F.col("arguments"), F.col("tool"), tools), F.when(repeated, F.array(F.lit("repeated identifier"))).otherwise(F.array().cast("array<string>")))
    own = repeated | F.col("call_id").isNull()
    placed = {"place": F.when(own, F.col("turn")).otherwise(F.col("place")), "depth": F.when(own, F.lit(0)).otherwise(F.col("depth"))}
    made = checked.withColumns({"errors": errors, "answered": F.coalesce("answered", F.lit(False)) & ~repeated, **placed})
    return made.drop("_row", "first"), _indexed(results, index.drop("answered")).drop("first")


def message_json(role: Column, content: Column, call_id: Column, tool: Column | None = None, arguments: Column | None = None) -> Column:
    """The canonical JSON of one message; a call carries its tool and arguments, a result its call's identifier."""
    if tool is None:
        return F.to_json(F.struct(content.alias("content"), role.alias("role"), call_id.alias("tool_call_id")))
    call = F.struct(arguments.alias("arguments"), call_id.alias("id"), tool.alias("name"))
    return F.to_json(F.struct(content.alias("content"), role.alias("role"), F.array(call).alias("tool_calls")))


def op8_chat(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    named = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    asked = F.to_json(F.struct(F.col("text").alias("question"), F.col("turn").alias("turn")))
    calls = turns.filter("role = 'user'").select(named(F.col("turn")).alias("call_id"), "conv_id", "turn", "role", F.lit("reply").alias("tool"), asked.alias("arguments"), named(F.col("turn") - 2).alias("needs"))
    results = turns.filter("role = 'assistant'").select(named(F.col("turn") - 1).alias("call_id"), "conv_id", "turn", "role", "text")
    calls, results = linked(calls, results)
    none, zero = F.lit(None).cast("string"), F.lit(0)
    order = lambda kind: [F.coalesce("place", "turn").alias("place"), F.coalesce("depth", zero).alias("depth"), F.lit(kind).alias("kind")]
    a = calls.select("conv_id", "turn", "role", "call_id", F.when(F.col("answered"), "linked").otherwise("open").alias("link"), *order(0), F.array_join("errors", "; ").alias("errors"), message_json(F.col("role"), none, F.col("call_id"), F.col("tool"), canonical("arguments")).alias("message"))
    b = results.select("conv_id", "turn", "role", "call_id", F.when(F.col("place").isNotNull(), "linked").otherwise("orphan").alias("link"), *order(1), F.lit("").alias("errors"), message_json(F.col("role"), F.col("text"), F.col("call_id")).alias("message"))
    c = turns.filter("role IS NULL OR role NOT IN ('user', 'assistant')").select("conv_id", "turn", "role", none.alias("call_id"), F.lit("none").alias("link"), F.col("turn").alias("place"), zero.alias("depth"), zero.alias("kind"), F.lit("").alias("errors"), message_json(F.col("role"), F.col("text"), none).alias("message"))
    return a.unionByName(b).unionByName(c)


def _sql_json(value: str) -> str:
    return f"CAST(to_json({value}) AS VARCHAR)"


OP8_SQL = f"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations),
i AS (SELECT *, conv_id || ':' || turn AS call_id, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM t WHERE role = 'user'),
u AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS INTEGER) AS depth FROM i),
r AS (SELECT *, conv_id || ':' || (turn - 1) AS call_id FROM t WHERE role = 'assistant'),
j AS (SELECT *, concat('{{', CASE WHEN text IS NOT NULL THEN concat('"question":', {_sql_json('text')}, ',') ELSE '' END, '"turn":', turn, '}}') AS arguments FROM u)
SELECT conv_id, turn, role, call_id, CASE WHEN call_id IN (SELECT call_id FROM r) THEN 'linked' ELSE 'open' END AS link, turn AS place, depth, 0 AS kind,
       concat_ws('; ', CASE WHEN text IS NULL THEN 'missing `question`' WHEN length(text) < 1 THEN '`question` out of bounds' END, CASE WHEN turn < 0 THEN '`turn` out of bounds' END) AS errors,
       concat('{{"role":"user","tool_calls":[{{"arguments":', {_sql_json('arguments')}, ',"id":"', call_id, '","name":"reply"}}]}}') AS message
FROM j
UNION ALL
SELECT r.conv_id, r.turn, r.role, r.call_id, CASE WHEN u.turn IS NOT NULL THEN 'linked' ELSE 'orphan' END, coalesce(u.turn, r.turn), coalesce(u.depth, 0), 1, '',
       concat('{{', CASE WHEN r.text IS NOT NULL THEN concat('"content":', {_sql_json('r.text')}, ',') ELSE '' END, '"role":"assistant","tool_call_id":"', r.call_id, '"}}')
FROM r LEFT JOIN u ON u.call_id = r.call_id
UNION ALL
SELECT conv_id, turn, role, NULL, 'none', turn, 0, 0, '', concat('{{', concat_ws(',', CASE WHEN text IS NOT NULL THEN concat('"content":', {_sql_json('text')}) END, CASE WHEN role IS NOT NULL THEN concat('"role":', {_sql_json('role')}) END), '}}')
FROM t WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""
