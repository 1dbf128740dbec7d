"""Operator 10: chat formatting with tool-call linking (native columns only).

Messages carry tool calls (call_id, tool, arguments as JSON) and tool results (result_of).
Results are joined to calls by identifier within a conversation. The order is topological:
calls that depend on other calls come after them, a linked result directly follows its call,
everything else keeps its turn. Arguments are checked against a schema per tool, compiled to
column expressions, and each message is written as canonical JSON: sorted keys, no spaces,
nulls left out.

One row per message, so a conversation of any length never meets in one task. Chains of
calls, the usual shape, are followed by pointers that double in each round, so a chain of n
calls takes about log2(n) rounds, and every pointer that has reached its end leaves the joins:
no join gathers a chain at its first call.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Rounds of placed calls that are gathered before they are written together.
MOST_LEVELS = 50
#: Turns of a conversation that are put in order within one task.
TURN_BLOCK = 1000
#: Columns of messages that are used; others may have any name.
MESSAGE = ("conv", "turn", "role", "text", "call_id", "tool", "arguments", "result_of")
_CYCLE = "tool calls depend on each other in a cycle"


def _runs(single: DataFrame) -> DataFrame:
    """Calls with one need, each pointing to the end of its run: the first call there that has no need or several.

    In: (conv, call, turn, needed, end_turn, ends), where ends says how many needs the needed
    call has and end_turn is its turn. Out: the same for the end of the run, with `far`, the
    edges between, and `late`, the latest turn of the calls passed.
    """
    columns = ("conv", "call", "turn", "needed", "end_turn", "ends", "far", "late")
    jumps = checkpointed(single.select(*columns[:6], F.lit(1).alias("far"), F.lit(None).cast("long").alias("late")))
    closed, going = [jumps.filter("ends <> 1")], jumps.filter("ends = 1")
    for _ in range(jumps.count().bit_length() + 1):
        if going.isEmpty():
            return reduce(DataFrame.union, closed)
        every = reduce(DataFrame.union, [*closed, going])
        on = every.select("conv", F.col("call").alias("needed"), F.col("needed").alias("next"), F.col("end_turn").alias("e"), F.col("ends").alias("k"), F.col("far").alias("more"), F.greatest("late", "turn").alias("passed"))
        moved = going.join(on, ["conv", "needed"]).select("conv", "call", "turn", F.col("next").alias("needed"), F.col("e").alias("end_turn"), F.col("k").alias("ends"), (F.col("far") + F.col("more")).alias("far"), F.greatest("late", "passed").alias("late"))
        moved = checkpointed(moved)
        closed, going = [*closed, moved.filter("ends <> 1")], moved.filter("ends = 1")
    if not going.isEmpty():
        raise ValueError(_CYCLE)
    return reduce(DataFrame.union, closed)


def _levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv, call, level, place): level is 0 for calls without dependencies, else one more than the highest of
    theirs; place is the latest turn of the call and of all that it needs, directly or not.

    Runs of calls with one need are cut short first. The rest are Kahn's rounds: each joins the
    open edges with the calls placed last round, so there are as many rounds as levels of calls
    with several needs. A round that places nothing shows a cycle, which is an error.
    """
    known = calls.select("conv", "call", F.col("call_turn").alias("turn"))
    edges = needs.select("conv", "call", "needed").distinct().join(known, ["conv", "call"], "left_semi")
    edges = checkpointed(edges.join(known.select("conv", F.col("call").alias("needed")), ["conv", "needed"], "left_semi").select("conv", "call", "needed"))
    counted = edges.groupBy("conv", "call").agg(F.count("*").alias("needs"), F.min("needed").alias("needed"))
    known = checkpointed(known.join(counted, ["conv", "call"], "left").withColumn("needs", F.coalesce("needs", F.lit(0))))
    ends = known.select("conv", F.col("call").alias("needed"), F.col("turn").alias("end_turn"), F.col("needs").alias("ends"))
    runs = checkpointed(_runs(known.filter("needs = 1").drop("needs").join(ends, ["conv", "needed"])))
    front = known.filter("needs = 0").select("conv", "call", F.lit(0).alias("level"), F.col("turn").alias("place"))
    placed = front.union(runs.filter("ends = 0").select("conv", "call", F.col("far").alias("level"), F.greatest("turn", "late", "end_turn").alias("place")))
    several = known.filter("needs > 1").select("conv", "call")
    if several.isEmpty():
        return placed
    open_edges = edges.join(several, ["conv", "call"], "left_semi").select("conv", "call", "needed", F.lit(1).alias("far"), F.lit(None).cast("long").alias("late"))
    open_edges = open_edges.union(runs.filter("ends > 1").select("conv", "call", "needed", "far", "late"))
    open_edges = checkpointed(open_edges.withColumns({"level": F.lit(None).cast("int"), "place": F.lit(None).cast("long")}))
    front = placed = checkpointed(placed)
    turns, gathered = known.select("conv", "call", "turn"), []
    while not open_edges.isEmpty():
        if front.isEmpty():
            raise ValueError(_CYCLE)
        hit = open_edges.join(front.select("conv", F.col("call").alias("needed"), F.col("level").alias("below"), F.col("place").alias("put")), ["conv", "needed"], "left")
        open_edges = checkpointed(hit.select("conv", "call", "needed", "far", "late", F.coalesce("level", F.col("below") + F.col("far")).alias("level"), F.coalesce("place", F.greatest("put", "late")).alias("place")))
        ready = open_edges.groupBy("conv", "call").agg(F.max("level").alias("level"), F.max("place").alias("place"), F.count_if(F.col("level").isNull()).alias("open")).filter("open = 0")
        front = checkpointed(ready.join(turns, ["conv", "call"]).select("conv", "call", "level", F.greatest("place", "turn").alias("place")))
        open_edges = checkpointed(open_edges.join(front, ["conv", "call"], "left_anti"))
        gathered.append(front)
        if len(gathered) >= MOST_LEVELS:
            placed, gathered = checkpointed(reduce(DataFrame.union, gathered, placed)), []
    return reduce(DataFrame.union, gathered, placed)


def _calls(messages: DataFrame) -> DataFrame:
    """(conv, call, call_turn): each call at its first turn."""
    return messages.filter(F.col("call_id").isNotNull()).groupBy("conv", F.col("call_id").alias("call")).agg(F.min("turn").alias("call_turn"))


def previous_calls(messages: DataFrame, *, block: int = TURN_BLOCK) -> DataFrame:
    """(conv, call, needed) for `link_tool_calls`: each call needs the one before it in its conversation, by turn, then id.

    Calls are ordered within blocks of `block` turns; the first of a block follows the last of
    the block before, which is looked up among one row per block. So a conversation with most
    of all rows is spread over many tasks. A call without a turn counts as the first.
    """
    calls = checkpointed(_calls(messages).filter("conv is not null").withColumn("block__", F.floor(F.coalesce("call_turn", F.lit(0)) / block)))
    here = Window.partitionBy("conv", "block__").orderBy(F.asc_nulls_first("call_turn"), "call")
    within = calls.select("conv", "block__", "call", F.lag("call").over(here).alias("needed"))
    last = calls.groupBy("conv", "block__").agg(F.max(F.struct("call_turn", "call")).alias("m"))
    last = last.select("conv", "block__", F.lag("m.call").over(Window.partitionBy("conv").orderBy("block__")).alias("carried"))
    return within.join(last, ["conv", "block__"]).select("conv", "call", F.coalesce("needed", "carried").alias("needed")).filter("needed is not null")


#: Keywords of schemas that are checked, and those that say nothing about values; any other is an error.
CHECKED = {"type", "enum", "properties", "required", "additionalProperties", "items", "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minItems", "maxItems"}
SILENT = {"title", "description", "default", "examples", "$schema", "$id", "$comment"}
_NUMBERS = ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL")
#: Digits that a number keeps.
_DIGITS = 38


def _refuse_unknown(schema: dict, path: str = "") -> None:
    """Errors for what isn't checked, before anything runs."""
    if not isinstance(schema, dict):
        raise ValueError(f"{path or 'schema'}: a schema must be an object")
    if unknown := sorted(set(schema) - CHECKED - SILENT):
        raise ValueError(f"{path or 'schema'}: unknown keywords {', '.join(unknown)}")
    kinds = schema.get("type", [])
    if wrong := [k for k in ([kinds] if isinstance(kinds, str) else kinds) if k not in _KINDS]:
        raise ValueError(f"{path or 'schema'}: unknown type {wrong[0]}")
    if any(isinstance(x, (dict, list)) for x in schema.get("enum", ())):
        raise ValueError(f"{path or 'schema'}: enum of objects or arrays")
    for name, part in schema.get("properties", {}).items():
        if "'" in name or "\\" in name:
            raise ValueError(f"{path}{name}: property names with quotes or backslashes")
        _refuse_unknown(part, f"{path}{name}.")
    for key in ("items", "additionalProperties"):
        if not isinstance(schema.get(key, True), bool):
            _refuse_unknown(schema[key], f"{path}{key}.")


#: Whether a value of a kind (as VARIANT names it) and with a number, if it is one, is of a JSON type.
_KINDS: dict[str, Callable[[Column, Column], Column]] = {
    "string": lambda kind, number: kind == "STRING",
    "boolean": lambda kind, number: kind == "BOOLEAN",
    "integer": lambda kind, number: (kind == "BIGINT") | (kind.isin(*_NUMBERS) & (number == F.floor(number))),
    "number": lambda kind, number: kind.isin(*_NUMBERS),
    "object": lambda kind, number: kind == "OBJECT",
    "array": lambda kind, number: kind == "ARRAY",
    "null": lambda kind, number: kind == "VOID",
}


def _equal(kind: Column, text: Column, number: Column, wanted: object) -> Column:
    """Whether a value is a constant of an enum."""
    if wanted is None:
        return kind == "VOID"
    if isinstance(wanted, bool):
        return (kind == "BOOLEAN") & (text == str(wanted).lower())
    if isinstance(wanted, str):
        return (kind == "STRING") & (text == wanted)
    return kind.isin(*_NUMBERS) & (number == F.lit(float(wanted)))


def _errors(value: Column, schema: dict, path: str) -> Column:
    """Array of error texts of a value, null where none applies; an absent value has none."""
    kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else list(kinds)
    # a JSON null counts as absent, unless null is a type here
    there = value.isNotNull() & ((kind != "VOID") | F.lit("null" in kinds))
    name = path or "value"
    found = []

    def add(wrong: Column, message: str) -> None:
        found.append(F.when(there & F.coalesce(wrong, F.lit(False)), F.lit(f"{name}: {message}")))

    if kinds:
        right = reduce(lambda a, b: a | b, (_KINDS[k](kind, number) for k in kinds))
        add(~F.coalesce(right, F.lit(False)), f"not {' or '.join(kinds)}")
    is_text, is_number, is_array, is_object = kind == "STRING", kind.isin(*_NUMBERS), kind == "ARRAY", kind == "OBJECT"
    items = F.try_variant_get(F.when(is_array, value), "$", "array<variant>")
    tests = {
        "minLength": lambda x: is_text & (F.length(text) < x), "maxLength": lambda x: is_text & (F.length(text) > x), "pattern": lambda x: is_text & ~text.rlike(x),
        "minimum": lambda x: is_number & (number < x), "maximum": lambda x: is_number & (number > x),
        "exclusiveMinimum": lambda x: is_number & (number <= x), "exclusiveMaximum": lambda x: is_number & (number >= x),
        "minItems": lambda x: is_array & (F.size(items) < x), "maxItems": lambda x: is_array & (F.size(items) > x),
        "enum": lambda x: ~reduce(lambda a, b: a | b, (F.coalesce(_equal(kind, text, number, w), F.lit(False)) for w in x), F.lit(False)),
    }
    for key, test in tests.items():
        if key in schema:
            add(test(schema[key]), key)
    parts = [F.array(*found).cast("array<string>")] if found else []
    none, inside = F.array().cast("array<string>"), f"{path}." if path else ""
    properties = schema.get("properties", {})
    for key in sorted(set(properties) | set(schema.get("required", ()))):
        part = F.try_variant_get(F.when(is_object, value), f"$['{key}']", "variant")
        if key in schema.get("required", ()):
            missing = is_object & (part.isNull() | (F.schema_of_variant(part) == "VOID") & F.lit("null" not in properties.get(key, {}).get("type", [])))
            parts.append(F.array(F.when(F.coalesce(missing, F.lit(False)), F.lit(f"{inside}{key}: missing"))))
        if key in properties:
            parts.append(_errors(part, properties[key], f"{inside}{key}"))
    more = schema.get("additionalProperties", True)
    if more is not True:
        others = F.map_filter(F.try_variant_get(F.when(is_object, value), "$", "map<string,variant>"), lambda k, _: ~k.isin(*properties) if properties else F.lit(True))
        if more is False:
            parts.append(F.transform(F.array_sort(F.map_keys(others)), lambda k: F.concat(F.lit(inside), k, F.lit(": not allowed"))))
        else:
            parts.append(F.flatten(F.transform(F.map_values(others), lambda v: _errors(v, more, f"{inside}*"))))
    if isinstance(schema.get("items"), dict):
        parts.append(F.flatten(F.transform(items, lambda v: _errors(v, schema["items"], f"{path}[]"))))
    return F.concat(*[F.coalesce(p, none) for p in parts]) if parts else none


def argument_errors(arguments: Column, schema: dict) -> Column:
    """Array of error texts of JSON arguments, which must be an object, against a JSON schema, at every depth.

    Keywords are those of CHECKED; those of SILENT are passed over, and any other is a
    ValueError. A number with no fraction is an integer. A JSON null counts as absent unless
    `null` is one of the types. Errors of array items are named path[], of additional
    properties path.*, each once. A number of more than 38 digits can't be kept as it is,
    which is an error too.
    """
    _refuse_unknown(schema)
    value = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    bare = F.regexp_replace(arguments, r'"(?:[^"\\]|\\.)*+"', "")
    long = is_object & F.regexp_replace(bare, r"(?<=[0-9])\.(?=[0-9])", "").rlike(f"[0-9]{{{_DIGITS + 1}}}")
    top = F.array(F.when(~is_object, F.lit("not an object")), F.when(long, F.lit(f"number of more than {_DIGITS} digits")))
    inside = _errors(F.when(is_object, value), {k: v for k, v in schema.items() if k != "type"}, "")
    return F.array_distinct(F.filter(F.concat(top, inside), lambda e: e.isNotNull()))


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON object text with keys in order and null fields left out; values are columns that hold JSON."""
    parts = [F.when(fields[k].isNotNull(), F.concat(F.lit(f'"{k}":'), fields[k])) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def quoted(text: Column) -> Column:
    """A JSON string; null stays null. to_json writes it as the one field of an object, which is cut away."""
    body = F.to_json(F.struct(text.cast("string").alias("v")))
    return F.when(text.isNotNull(), F.substring(body, F.lit(6), F.length(body) - 6))


def canonical_arguments(arguments: Column) -> Column:
    """JSON text with keys in order and no spaces, at every depth; text that is no JSON becomes a JSON string, null stays null.

    Numbers are written as VARIANT holds them: those of up to 38 digits with all their digits,
    longer ones rounded, which `argument_errors` reports.
    """
    return F.coalesce(F.to_json(F.try_parse_json(arguments)), quoted(arguments))


def link_tool_calls(messages: DataFrame, schemas: dict[str, dict], needs: DataFrame | None = None) -> DataFrame:
    """One row per message: conv, turn, seq_turn, seq_level, seq_call, seq_id, seq_kind, linked, valid, errors, json.

    messages: conv, turn (long), role, text, call_id, tool, arguments (JSON text), result_of;
    further columns may have any name and are left out. needs: (conv, call, needed)
    dependencies between calls; those of or on unknown calls don't count, and a cycle is an
    error. Order by (conv, seq_turn, seq_level, seq_call, seq_id, seq_kind, turn), nulls first:
    a call stands after all that it needs, directly or not, and its results right behind it,
    also where several calls share a turn (seq_id is the call's id). `linked` is null but for results (its call exists) and
    calls (a result exists); `valid` is null but for calls; an unknown tool is an error. Call
    ids that repeat within a conversation link to the first turn. Null ids link to nothing.
    Null texts are left out of the JSON; arguments that are no JSON are invalid and written as
    a JSON string. Repeated rows come out once each, an empty table gives no rows.
    """
    messages = messages.select(*MESSAGE)
    calls = _calls(messages)
    answered = messages.filter(F.col("result_of").isNotNull()).select("conv", F.col("result_of").alias("call"), F.lit(True).alias("answered")).distinct()
    if needs is not None:
        calls = checkpointed(calls)
        # a call never stands before one that it needs: it moves to the latest turn of all of those
        placed = calls.join(_levels(calls.filter("conv is not null"), needs), ["conv", "call"], "left")
        calls = placed.withColumns({"level": F.coalesce("level", F.lit(0)), "place": F.coalesce("place", "call_turn")})
    else:
        calls = calls.withColumns({"level": F.lit(0), "place": F.col("call_turn")})
    calls = calls.join(answered, ["conv", "call"], "left").withColumn("known", F.lit(True))
    # only calls and results go through the join: other messages have no key to be dealt by
    marked = messages.withColumn("call", F.coalesce("call_id", "result_of"))
    joined = marked.filter("call is not null").join(calls, ["conv", "call"], "left").unionByName(marked.filter("call is null"), allowMissingColumns=True)
    is_call, is_result = F.col("call_id").isNotNull(), F.col("call_id").isNull() & F.col("result_of").isNotNull()
    hit = F.col("known").isNotNull()
    unknown = F.array(F.lit("unknown tool"))
    checks = reduce(lambda out, name: F.when(F.col("tool") == name, argument_errors(F.col("arguments"), schemas[name])).otherwise(out), sorted(schemas), unknown)
    out = joined.withColumn("errors", F.when(is_call, checks))
    call_json = canonical_json({"arguments": canonical_arguments(F.col("arguments")), "id": quoted(F.col("call_id")), "name": quoted(F.col("tool"))})
    linked = F.when(is_call, F.coalesce("answered", F.lit(False))).when(is_result, hit)
    return out.select(
        "conv", "turn",
        F.when(hit, F.col("place")).otherwise(F.col("turn")).alias("seq_turn"),
        F.coalesce(F.when(hit, F.col("level")), F.lit(0)).alias("seq_level"),
        F.when(hit, F.col("call_turn")).otherwise(F.col("turn")).alias("seq_call"),
        F.when(hit, F.col("call")).alias("seq_id"),
        F.when(is_result & hit, F.lit(1)).otherwise(F.lit(0)).alias("seq_kind"),
        linked.alias("linked"),
        F.when(is_call, F.size("errors") == 0).alias("valid"),
        F.when(is_call, F.array_join("errors", "; ")).alias("errors"),
        canonical_json({
            "content": quoted(F.col("text")),
            "role": quoted(F.col("role")),
            "tool_call": F.when(is_call, call_json),
            "tool_call_id": F.when(is_result, quoted(F.col("result_of"))),
        }).alias("json"),
    )


#: Schema of the one tool of the conversations table: an answer to a user's turn.
REPLY = {"type": "object", "required": ["prompt", "turn"], "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 400}, "turn": {"type": "integer", "minimum": 0}}}


def turns_as_calls(conversations: DataFrame) -> DataFrame:
    """Messages for `link_tool_calls` from plain turns: a user's turn calls `reply` with its text,
    and an assistant's turn is the result of the call one turn before."""
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    name = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    return conversations.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text",
        F.when(user, name(F.col("turn"))).alias("call_id"),
        F.when(user, F.lit("reply")).alias("tool"),
        F.when(user, canonical_json({"prompt": quoted(F.col("text")), "turn": F.col("turn").cast("string")})).alias("arguments"),
        F.when(assistant, name(F.col("turn") - 1)).alias("result_of"),
    )
