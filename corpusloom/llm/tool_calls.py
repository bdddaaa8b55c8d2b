"""Tool-call linking and canonical chat records (operator 8). DataFrame and SQL functions only.

Calls and results are joined by identifier; a call may name the calls that must come before it (one, or an array), and its ordinal is the
length of the longest chain of them: calls with one predecessor are ordered by pointer doubling, those with several by rounds of
calls whose predecessors are all ordered. Arguments are checked against the schema of their tool; each record is serialised as JSON with
sorted keys and no white space. Numbers keep their kind, not their spelling: 1e2 is written 100.0, 1.50 is written 1.5, and 1 stays 1;
strings are escaped as little as JSON allows (quotes, backslashes and control characters), so \\u00e9 is written é.

Defined results: of calls (or results) that repeat an identifier the least counts, and copies tells how many there were; a
result without a call is an orphan; a call that must follow an unknown call stands first; calls in a cycle, or after one, get no ordinal; null
or malformed arguments are invalid and serialise as null; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Tools of chat turns: argument -> (JSON type, least, most); lengths for strings, values for integers. All are required.
CHAT_SCHEMAS = {"reply": {"prompt": ("string", 1, 1 << 20), "turn": ("integer", 0, 1 << 31)}}
JSON_TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"]}
KEEP_NULLS = {"ignoreNullFields": "false"}


def valid_arguments(name: Column, arguments: Column, schemas: dict) -> Column:
    """Whether the JSON object arguments has just the arguments of the tool's schema, in its types and bounds."""
    parsed = F.try_parse_json(arguments)
    out = F.lit(False)
    for tool, fields in schemas.items():
        ok = (F.json_object_keys(arguments).isNotNull()) & (F.size(F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, fields)))) == 0)
        for field, (kind, least, most) in fields.items():
            path = f"$.{field}"
            typed = F.regexp_extract(F.schema_of_variant(F.try_variant_get(parsed, path, "variant")), r"^\w+", 0).isin(JSON_TYPES[kind])
            if kind == "string":
                size = F.char_length(F.try_variant_get(parsed, path, "string"))
            else:
                size = F.try_variant_get(parsed, path, "double")
            ok = ok & F.coalesce(typed, F.lit(False)) & F.coalesce(size.between(least, most), F.lit(False))
        out = F.when(name == tool, F.coalesce(ok, F.lit(False))).otherwise(out)
    return out


def ordinals(calls: DataFrame, most_rounds: int = 40) -> DataFrame:
    """call_id and ordinal: the length of the longest chain of calls that must come before it; null for calls in a cycle or after one.

    calls: call_id (unique), after: the call before it, or an array of such. Calls with one predecessor jump, by pointer doubling, to the
    nearest call before them that has none or several; those with several are then ordered in rounds (Kahn), as many as the longest chain of such calls."""
    several, known = isinstance(calls.schema["after"].dataType, T.ArrayType), calls.select(F.col("call_id").alias("before"))
    if several:
        links = written(calls.select("call_id", F.explode("after").alias("before")).distinct().join(known, "before"), "links")
        counted = links.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.min("before").alias("one"))
        start = calls.select("call_id").join(counted, "call_id", "left").select("call_id", F.when(F.col("n") == 1, F.col("one")).alias("one"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("many"))
    else:
        start = calls.join(known, calls.after == known.before, "left").select("call_id", F.col("before").alias("one"), F.lit(False).alias("many"))
    single = F.col("one").isNotNull()
    now = written(start.select("call_id", F.coalesce("one", "call_id").alias("at"), single.cast("bigint").alias("steps"), (~single).alias("done"), "many"), "order")
    for _ in range(most_rounds):
        if now.where("not done").isEmpty():
            break
        ahead = now.select(F.col("call_id").alias("there"), F.col("at").alias("next"), F.col("steps").alias("more"), F.col("done").alias("ends"))
        moved = now.where("not done").join(ahead, F.col("at") == F.col("there")).select("call_id", F.col("next").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ends").alias("done"), "many")
        now = written(now.where("done").unionByName(moved), "order")
    placed = now.where("done").select("call_id", "at", "steps")
    if not several:  # every chain that ends hangs on a call without a predecessor
        return now.select("call_id", F.when(F.col("done"), F.col("steps")).alias("ordinal"))
    levels = written(now.where("done and steps = 0 and not many").select(F.col("call_id").alias("at"), F.lit(0).cast("bigint").alias("level")), "levels")
    waiting = now.where("many").select("call_id")
    if not waiting.isEmpty():
        # Each predecessor as the call that it hangs on and its distance; null where that can't be told for a cycle.
        edges = written(links.join(waiting, "call_id", "left_semi").join(placed.toDF("before", "at", "steps"), "before", "left").select("call_id", "at", (F.col("steps") + 1).alias("steps")), "edges")
        while True:
            ready = edges.join(levels, "at", "left").groupBy("call_id").agg(F.count_if(F.col("level").isNull()).alias("open"), F.max(F.col("level") + F.col("steps")).alias("level"))
            new = written(ready.where("open = 0").select(F.col("call_id").alias("at"), "level").join(levels.select("at"), "at", "left_anti"), "levels")
            if new.isEmpty():
                break
            levels = written(levels.unionByName(new), "levels")
    found = placed.join(levels, "at").select("call_id", (F.col("level") + F.col("steps")).alias("ordinal"))
    return calls.select("call_id").join(found, "call_id", "left")


def link(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """calls: call_id, after (a call_id or an array of such), name, arguments (JSON), conv_id, turn. results: call_id, content, conv_id, turn.

    One row per call and per orphaned result: conv_id, turn, call_id, kind, ordinal, linked, valid, copies, json."""
    once = calls.groupBy("call_id").agg(F.min(F.struct("conv_id", "turn", "name", "arguments", "after")).alias("c"), F.count(F.lit(1)).alias("copies")).select("call_id", "c.*", "copies")
    once = written(once, "calls")
    answers = results.groupBy("call_id").agg(F.min(F.struct("content", "conv_id", "turn")).alias("r"), F.count(F.lit(1)).alias("r_copies"))
    both = once.join(answers, "call_id", "full")
    ordered = both.join(ordinals(once.select("call_id", "after")), "call_id", "left")
    is_call = F.col("copies").isNotNull()
    valid = valid_arguments(F.col("name"), F.col("arguments"), schemas)
    call_json = F.to_json(
        F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), "name", "ordinal", F.col("r.content").alias("result"), F.col("valid")),
        KEEP_NULLS,
    )
    orphan_json = F.to_json(F.struct(F.col("r.content").alias("content"), F.col("call_id").alias("id")), KEEP_NULLS)
    return ordered.withColumn("valid", F.when(is_call, valid)).select(
        F.coalesce("conv_id", "r.conv_id").alias("conv_id"),
        F.coalesce("turn", "r.turn").alias("turn"),
        "call_id",
        F.when(is_call, "call").otherwise("orphan").alias("kind"),
        "ordinal",
        (is_call & F.col("r").isNotNull()).alias("linked"),
        "valid",
        F.coalesce("copies", "r_copies").alias("copies"),
        F.when(is_call, call_json).otherwise(orphan_json).alias("json"),
    )


def chat_records(conversations: DataFrame) -> DataFrame:
    """Each user turn as a call of the tool reply, which the next turn of the assistant answers and which follows the user's turn
    before; turns of other roles are context records."""
    key = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("known", F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    user, assistant = (F.coalesce(F.col("known") & (F.col("role") == r), F.lit(False)) for r in ("user", "assistant"))
    calls = rows.where(user).select(key(F.col("turn")).alias("call_id"), key(F.col("turn") - 2).alias("after"), F.lit("reply").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"), "turn")).alias("arguments"), "conv_id", "turn")
    results = rows.where(assistant).select(key(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"), "conv_id", "turn")
    context = rows.where(~user & ~assistant).groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    nothing = lambda kind: F.lit(None).cast(kind)
    others = context.select("conv_id", "turn", nothing("string").alias("call_id"), F.lit("context").alias("kind"), nothing("bigint").alias("ordinal"), F.lit(False).alias("linked"), nothing("boolean").alias("valid"), "copies", F.to_json(F.struct(F.col("text").alias("content"), "role"), KEEP_NULLS).alias("json"))
    return link(calls, results, CHAT_SCHEMAS).unionByName(others)


def op8_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_records(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP8_SQL = """
WITH rows_ AS (SELECT conv_id, turn, role, text, conv_id::VARCHAR || ':' || turn AS own, conv_id::VARCHAR || ':' || (turn - 1) AS before FROM conversations),
calls AS (SELECT own AS call_id, conv_id, turn, min(text) AS text, count(*) AS copies FROM rows_ WHERE role = 'user' GROUP BY ALL),
answers AS (SELECT before AS call_id, conv_id, turn, min(text) AS text, count(*) AS copies FROM rows_ WHERE role = 'assistant' GROUP BY ALL),
islands AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM calls),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, island ORDER BY turn) - 1 AS ordinal FROM islands)
SELECT c.conv_id, c.turn, c.call_id, 'call' AS kind, c.ordinal, a.call_id IS NOT NULL AS linked, length(c.text) BETWEEN 1 AND 1048576 AS valid, c.copies,
       json_object('arguments', json_object('prompt', c.text, 'turn', c.turn), 'id', c.call_id, 'name', 'reply', 'ordinal', c.ordinal, 'result', a.text,
                   'valid', length(c.text) BETWEEN 1 AND 1048576)::VARCHAR AS json
FROM ordered c LEFT JOIN answers a USING (call_id)
UNION ALL
SELECT a.conv_id, a.turn, a.call_id, 'orphan', NULL, false, NULL, a.copies, json_object('content', a.text, 'id', a.call_id)::VARCHAR
FROM answers a WHERE a.call_id NOT IN (SELECT call_id FROM calls)
UNION ALL
SELECT conv_id, turn, NULL, 'context', NULL, false, NULL, count(*), json_object('content', text, 'role', role)::VARCHAR
FROM conversations WHERE role NOT IN ('user', 'assistant') GROUP BY conv_id, turn, role, text
"""
