"""Chains of tool calls, in which what is needed comes later, and longer than any count of rounds."""

import pytest
from meterlake.llm import chat
from pyspark.sql import functions as F

MESSAGES = "conv long, turn long, role string, text string, call_id string, tool string, arguments string, result_of string"
NEEDS = "conv long, call string, needed string"


def placed(spark, calls, needs):
    m = spark.createDataFrame([(1, turn, "assistant", None, call, "t", "{}", None) for call, turn in calls], MESSAGES)
    rows = chat.link_tool_calls(m, {"t": {}}, spark.createDataFrame([(1, *n) for n in needs], NEEDS)).collect()
    assert len(rows) == len(calls)
    name = {turn: call for call, turn in calls}
    return {name[r["turn"]]: (r["seq_turn"], r["seq_level"]) for r in rows}


def test_a_chain_moves_to_the_latest_turn_of_all(spark):
    got = placed(spark, [("a", 1), ("b", 2), ("c", 5)], [("a", "b"), ("b", "c")])
    assert got == {"a": (5, 2), "b": (5, 1), "c": (5, 0)}


def test_branches_and_chains(spark):
    calls = [("a", 1), ("b", 9), ("c", 3), ("d", 4), ("e", 2), ("f", 6)]
    needs = [("a", "b"), ("a", "c"), ("c", "d"), ("d", "e"), ("f", "a"), ("f", "e"), ("e", "unknown")]
    want_place, want_level, by = {}, {}, dict(calls)
    def walk(c):
        for n in [n for x, n in needs if x == c and n in by]:
            walk(n)
        below = [n for x, n in needs if x == c and n in by]
        want_level[c] = max((want_level[n] + 1 for n in below), default=0)
        want_place[c] = max([by[c], *(want_place[n] for n in below)])
    for c in by:
        walk(c)
    assert placed(spark, calls, needs) == {c: (want_place[c], want_level[c]) for c in by}


def test_a_chain_of_1500_calls(spark):
    calls = [(f"c{i}", i) for i in range(1500)]
    got = placed(spark, calls, [(f"c{i}", f"c{i - 1}") for i in range(1, 1500)])
    assert all(got[f"c{i}"] == (i, i) for i in range(1500))


def test_cycles_are_errors(spark):
    for needs in ([("a", "a")], [("a", "b"), ("b", "a")], [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")]):
        with pytest.raises(ValueError, match="cycle"):
            placed(spark, [("a", 1), ("b", 2), ("c", 5)], needs)


@pytest.mark.parametrize("alike", [False, True])
def test_random_graphs_are_ordered(spark, alike):
    """Every call after all that it needs, each result right behind its call, levels and places as by hand; with several calls a turn, too."""
    import random

    rng, calls, needs, rows = random.Random(3), [], [], []
    for conv in range(12):
        n = rng.randint(1, 14)
        turns = [rng.randrange(4) for _ in range(n)] if alike else rng.sample(range(2 * n), n)
        rank = rng.sample(range(n), n)
        calls += [(conv, f"c{i}", turns[i]) for i in range(n)]
        needs += [(conv, f"c{i}", f"c{j}") for i in range(n) for j in range(n) if rank[j] < rank[i] and rng.random() < (0.12, 0.5)[conv % 2]]
    rows = [(v, t, "assistant", c, c, "t", "{}", None) for v, c, t in calls] + [(v, 100 + t, "tool", c, None, None, None, c) for v, c, t in calls if int(c[1:]) % 3 or not alike]
    got = chat.link_tool_calls(spark.createDataFrame(rows, MESSAGES), {"t": {}}, spark.createDataFrame(needs + needs[:5], NEEDS)).collect()
    assert len(got) == len(rows)
    turn = {(v, c): t for v, c, t in calls}
    of = {k: [n for v, c, n in needs if (v, c) == k] for k in turn}

    def level(k):
        return max((level((k[0], n)) + 1 for n in of[k]), default=0)

    def place(k):
        return max([turn[k], *(place((k[0], n)) for n in of[k])])

    order = sorted(got, key=lambda r: (r["conv"], r["seq_turn"], r["seq_level"], r["seq_call"], r["seq_id"], r["seq_kind"], r["turn"]))
    seen = set()
    for at, r in enumerate(order):
        key = (r["conv"], r["seq_id"])
        assert (r["seq_level"], r["seq_turn"]) == (level(key), place(key))
        if r["turn"] < 100:
            assert {(key[0], n) for n in of[key]} <= seen
            seen.add(key)
        else:
            assert (order[at - 1]["conv"], order[at - 1]["seq_id"], order[at - 1]["turn"]) == (*key, turn[key])


def test_parallel_calls_of_one_turn(spark):
    rows = [(1, 0, "assistant", None, c, "t", "{}", None) for c in ("a", "b")] + [(1, n, "tool", "r", None, None, None, c) for n, c in ((1, "b"), (2, "a"))] + [(1, 0, "user", "hi", None, None, None, None)]
    got = chat.link_tool_calls(spark.createDataFrame(rows, MESSAGES), {"t": {}}).collect()
    order = sorted(got, key=lambda r: (r["seq_turn"], r["seq_level"], r["seq_call"], r["seq_id"] or "", r["seq_kind"], r["turn"]))
    assert [(r["seq_id"], r["seq_kind"]) for r in order] == [(None, 0), ("a", 0), ("a", 1), ("b", 0), ("b", 1)]


SCHEMA = {
    "type": "object", "title": "T", "required": ["q", "n"], "additionalProperties": False,
    "properties": {
        "q": {"type": "string", "pattern": "^[a-z]+$"}, "n": {"type": "integer", "exclusiveMinimum": 0, "exclusiveMaximum": 10}, "x": {"type": ["number", "null"]},
        "tags": {"type": "array", "items": {"type": "string", "maxLength": 2}, "minItems": 1, "maxItems": 2},
        "in": {"type": "object", "required": ["k"], "properties": {"k": {"enum": [1, "a", True, None]}}, "additionalProperties": {"type": "boolean"}},
    },
}


@pytest.mark.parametrize(("text", "want"), [
    ('{"q": "ab", "n": 1.0}', []), ('{"q": "ab", "n": 1}', []), ('{"q": "ab", "n": 1.5}', ["n: not integer"]), ('{"q": "A", "n": 0}', ["n: exclusiveMinimum", "q: pattern"]),
    ('{"n": null, "q": 1, "n2": 1}', ["n2: not allowed", "n: missing", "q: not string"]), ('{"q": "a", "n": 10}', ["n: exclusiveMaximum"]), ('{"q": "a", "n": 1e0, "x": null}', []),
    ('{"q": "a", "n": 1, "x": "y"}', ["x: not number or null"]), ('{"q": "a", "n": 1, "tags": []}', ["tags: minItems"]), ('{"q": "a", "n": 1, "tags": ["abc", 1, "abcd"]}', ["tags: maxItems", "tags[]: maxLength", "tags[]: not string"]),
    ('{"q": "a", "n": 1, "tags": {"0": "a"}}', ["tags: not array"]), ('{"q": "a", "n": 1, "in": {"k": 1.0, "more": true}}', []), ('{"q": "a", "n": 1, "in": {"k": "b", "more": 1}}', ["in.*: not boolean", "in.k: enum"]),
    ('{"q": "a", "n": 1, "in": {}}', ["in.k: missing"]), ('{"q": "a", "n": 1, "in": {"k": true}}', []), ("[1]", ["not an object"]), ("{bad", ["not an object"]), (None, ["not an object"]), ('{"q":"a","q":"b","n":1}', ["not an object"]),
    ('{"q": "a", "n": 1, "x": 12345678901234567890123456789012345678901234567890}', ["number of more than 38 digits"]), ('{"q": "a", "n": 1, "x": 1.5}', []),
])
def test_schemas_at_every_depth(spark, text, want):
    row = spark.createDataFrame([(text,)], "a string").select(chat.argument_errors(F.col("a"), SCHEMA).alias("e")).first()
    assert sorted(row["e"]) == sorted(want)


def test_a_number_in_a_string_may_be_long(spark):
    row = spark.createDataFrame([('{"a": "\\"' + "1" * 60 + '"}',)], "a string").select(chat.argument_errors(F.col("a"), {}).alias("e")).first()
    assert row["e"] == []


@pytest.mark.parametrize("schema", [{"oneOf": []}, {"properties": {"a": {"format": "date"}}}, {"items": {"type": "date"}}, {"properties": {"a'b": {}}}, {"properties": {"a": 1}}, {"enum": [{}]}])
def test_what_is_not_checked_is_refused(schema):
    with pytest.raises(ValueError):
        chat.argument_errors(F.lit("{}"), schema)


def test_long_numbers_keep_their_digits_or_are_invalid(spark):
    rows = [(1, t, "assistant", None, f"c{t}", "t", '{"x":' + "9" * digits + "}", None) for t, digits in ((0, 30), (1, 50))]
    got = {r["turn"]: r for r in chat.link_tool_calls(spark.createDataFrame(rows, MESSAGES), {"t": {}}).collect()}
    assert got[0]["valid"] and "9" * 30 in got[0]["json"]
    assert not got[1]["valid"] and got[1]["errors"] == "number of more than 38 digits"


def test_previous_calls_across_blocks(spark):
    rows = [(v, t, "assistant", None, f"c{t}", "t", "{}", None) for v in (1, 2) for t in range(0, 90, 2 + v) if not 30 < t < 60] + [(3, 5, "user", "no call", None, None, None, None)]
    got = {(r["conv"], r["call"]): r["needed"] for r in chat.previous_calls(spark.createDataFrame(rows, MESSAGES), block=10).collect()}
    turns = {v: [r[1] for r in rows if r[0] == v] for v in (1, 2)}
    want = {(v, f"c{b}"): f"c{a}" for v, x in turns.items() for a, b in zip(x, x[1:])}
    assert got == want


def test_working_names_bad_json_and_null_keys(spark):
    """Extra columns with names that are used inside, arguments that are no JSON, nested keys out of order, null conversations and turns."""
    rows = [(1, 0, "assistant", None, "a", "t", '{"y": [ {"d":1, "c":"ü"} ], "x":1}', None), (1, 1, "assistant", None, "b", "t", "{bad", None), (1, 2, "tool", "x", None, None, None, "a"),
            (1, None, "assistant", "", "n", "t", None, None), (None, 3, "assistant", None, "z", "t", "[1, 2]", None), (1, 2, "tool", "x", None, None, None, "a")]
    m = spark.createDataFrame(rows, MESSAGES)
    for name in ("level", "answered", "place", "call", "known", "call_turn", "errors", "needed", "turn__", "ends"):
        m = m.withColumn(name, m.role)
    for needs in (None, chat.previous_calls(m)):
        got = chat.link_tool_calls(m, {"t": {"properties": {"x": {"type": "integer"}}}}, needs).collect()
        assert len(got) == len(rows)
        by = {(r["conv"], r["turn"]): r for r in got}
        assert '"arguments":{"x":1,"y":[{"c":"ü","d":1}]}' in by[1, 0]["json"]
        assert '"arguments":"{bad"' in by[1, 1]["json"] and by[1, 1]["errors"] == "not an object"
        assert "arguments" not in by[1, None]["json"] and '"content":""' in by[1, None]["json"]
        assert by[None, 3]["seq_level"] == 0 and by[1, 2]["linked"]
    assert [by[1, t]["seq_level"] for t in (None, 0, 1)] == [0, 1, 2]
    assert chat.previous_calls(m.filter("false")).count() == 0
    assert chat.link_tool_calls(m.filter("false"), {}, chat.previous_calls(m.filter("false"))).count() == 0
