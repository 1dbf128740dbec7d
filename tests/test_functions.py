"""Column functions and operators on small rows: cost, names, strict JSON, times, folds."""

import random
from datetime import date

import pytest
from meterlake.functions import cost, names, prices, strict_json, times
from meterlake.operators import dedupe, incremental, registry, simplify, stats, turns
from meterlake.sources import lines as scan
from pyspark.sql import functions as F

COUNTERS = "provider_code string, model_code string, input_tokens long, cache_read_tokens long, cache_write_tokens long, output_tokens long, reasoning_tokens long"


def price_row(key, **p):
    return (key, *[p.get(c) for c in prices.PRICES])


def price_frame(spark, *rows):
    return spark.createDataFrame(list(rows), "price_key string, " + ", ".join(f"{c} double" for c in prices.PRICES))


@pytest.mark.parametrize(("agent", "row", "key", "price", "usd"), [
    ("codex", ("openai", "m", 250000, 50000, 0, 1000, 500), "openai/m", {"input": 1.0, "output": 2.0, "cache_read": 0.5, "input_200k": 3.0, "output_200k": 4.0, "cache_read_200k": 1.5}, 679000.0),
    ("gemini", ("google", "m", 250000, 50000, 0, 1000, 500), "m", {"input": 1.0, "output": 2.0, "cache_read": 0.5, "input_200k": 3.0, "output_200k": 4.0, "cache_read_200k": 1.5}, 681000.0),
    ("opencode", ("opencode", "m:free", 100, 20, 10, 10, 3), "opencode/m", {"input": 1.0, "output": 2.0, "cache_read": 0.5, "cache_write": 0.25}, 132.5),
    ("opencode", ("opencode", "m", 100, 20, 10, 10, 3), "opencode/m", {"input": 1.0, "output": 2.0, "cache_read": 0.5}, 140.0),
    ("opencode", ("lmstudio", "m", 100, 20, 10, 10, 3), "lmstudio/m", {"input": 1.0}, 0.0),
    ("claude", ("anthropic", "m", 100, 20, 10, 10, 3), "anthropic/m", {"input": 1.0, "output": 2.0, "cache_read": 0.5, "cache_write": 0.25}, 132.5),
    ("claude", ("anthropic", "claude-opus-4-7", 100, 20, 10, 10, 0), "claude-opus-4-6", {"input": 1.0, "output": 2.0, "cache_read": 0.5}, 140.0),
    ("claude", ("anthropic", "m", 150000, 40000, 20000, 0, 0), "anthropic/m", {"input": 1.0, "input_200k": 2.0}, 320000.0),
    ("pi", ("x", "none", 1, 1, 1, 1, 1), "y/z", {"input": 1.0}, 0.0),
])
def test_event_cost(spark, agent, row, key, price, usd):
    priced = prices.with_prices(spark.createDataFrame([row], COUNTERS), price_frame(spark, price_row(key, **price)), agent)
    assert priced.select(cost.event_cost(agent)).first()[0] == pytest.approx(usd)


def test_first_listed_key_counts_as_a_whole_row(spark):
    listed = price_frame(spark, price_row("anthropic/m", input=1.0), price_row("m", input=5.0, output=7.0))
    row = prices.with_prices(spark.createDataFrame([("anthropic", "m", 1, 0, 0, 1, 0)], COUNTERS), listed, "claude")
    assert row.select(cost.event_cost("claude")).first()[0] == 1.0


def test_codex_report(spark):
    events = spark.createDataFrame([("openai", "gpt-5", 100, 40, 0, 10, 5, "2026-02-15 12:00:00"), ("openai", "o3", 1, 0, 0, 1, 0, "2026-02-16 00:00:00")], COUNTERS + ", event_timestamp string").withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp"))
    listed = price_frame(spark, price_row("gpt-5", input=0.001, output=0.002, cache_read=0.0001))
    row = stats.usage_by(stats.priced_events(events, listed, "codex", until=date(2026, 2, 16)), "day", "model_code").collect()
    assert [(r["input_tokens"], r["cached_tokens"], r["output_tokens"], r["reasoning_tokens"], round(r["cost"], 9)) for r in row] == [(60, 40, 5, 5, 0.084)]
    since = stats.priced_events(events, listed, "codex", since=date(2026, 2, 16)).collect()
    assert [r["model_code"] for r in since] == ["o3"]


def test_names(spark):
    def one(f, *values):
        return spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(f(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]

    assert [one(names.strip_suffixes, x) for x in ("model:suffix:extra", "gpt-4-free", "model:", "")] == ["model", "gpt-4", "model", ""]
    assert [one(names.strip_free, x) for x in ("m:free-free", "m-free:x", "free")] == ["m", "m-free:x", "free"]
    keys = {("opencode", "gpt-5-free"): "openai/gpt-5", ("openrouter", "qwen/qwen3-coder:free"): "openrouter/qwen/qwen3-coder", ("opencode", "glm-5"): "opencode/glm-5", ("opencode", "minimax-m2.1-x"): "minimax/MiniMax-M2.1-x", ("opencode", "glm-4.7"): "openrouter/z-ai/glm-4.7", ("opencode", "grok-code"): "xai/grok-code-fast-1", ("z", "m"): "z/m"}
    assert {k: one(names.price_key_opencode, *k) for k in keys} == keys
    assert one(names.price_key_pi, "opencode", "glm-4.7:x") == "opencode/glm-4.7"
    uuid = "0b6d3f52-7d6e-4c0f-9a51-0f1c2d3e4f50"
    assert [one(names.uuid_text, x) for x in (uuid.upper(), "{" + uuid + "}", "urn:uuid:" + uuid, uuid.replace("-", ""), "x" + uuid[1:])] == [uuid] * 4 + [None]
    assert one(names.session_id_from_file, "/a/b_c_id9.jsonl") == "id9" and one(names.session_id_from_file, "/a_b/c.jsonl") is None
    assert one(names.cwd_from_parent, "/x/--home-a--/f.jsonl") == "/home/a" and one(names.cwd_from_parent, "/x/home/f.jsonl") is None
    assert one(lambda c: names.project_name(c, ["/r/one", "/r/two/"]), "file:///r/two/proj/s.jsonl") == "proj"


def test_strict_json(spark):
    docs = ["1", "true", "1.5", '"7"', '" 8 "', '"x"', "null", "{}", "12345678901234567890"]
    df = spark.createDataFrame([(i, '{"n":' + x + "}") for i, x in enumerate(docs)] + [(99, "{}"), (98, "{bad")], "i int, doc string")
    v = strict_json.parsed(F.col("doc"))
    got, error = strict_json.required_whole(v, "$.n", "n")
    maybe, wrong = strict_json.optional_whole(v, "$.n", "n", 0)
    rows = {r["i"]: r for r in df.select("i", got.alias("got"), error.isNotNull().alias("error"), maybe.alias("maybe"), wrong.isNotNull().alias("wrong"), strict_json.lenient_whole(v, "$.n").alias("lenient"), strict_json.whole(v, "$.n", booleans=True).alias("b")).collect()}
    assert [rows[i]["got"] for i in range(9)] == [1] + [None] * 8 and not rows[0]["error"] and all(rows[i]["error"] for i in (1, 2, 3, 6, 8, 99, 98))
    assert [rows[i]["wrong"] for i in (0, 1, 2, 3, 6, 8, 99)] == [False, True, True, True, False, True, False]
    assert [rows[i]["lenient"] for i in range(8)] == [1, 1, 1, 7, 8, 0, 0, 0] and rows[99]["lenient"] == 0 and rows[1]["b"] == 1


def test_times(spark):
    stamps = ["2026-01-01T05:00:00Z", "2026-01-01T05:00:00.5+02:00", "2026-01-01T05:00:00", "nope", None]
    df = spark.createDataFrame([(x,) for x in stamps], "x string")
    got = [r[0] for r in df.select(F.unix_millis(times.iso_instant(F.col("x")))).collect()]
    assert got == [1767243600000, 1767236400500, 1767243600000, None, None]
    assert df.select(F.year(times.iso_instant_or_oldest(F.col("x")))).collect()[3][0] == 1
    zoned = df.filter("x like '%Z'").select(times.iso_instant(F.col("x")).alias("t"))
    assert zoned.select(times.day_in_zone(zoned, "t", "America/New_York"), times.day_in_zone(zoned, "t", "America/Los_Angeles")).first()[:] == (date(2026, 1, 1), date(2025, 12, 31))


def test_fold_equals_the_loop(spark):
    rng, rows, want = random.Random(1), [], {}
    for key in range(400):
        kept, duplicates = None, 0
        for line in range(rng.randint(1, 6)):
            usage, final = rng.randint(0, 2), rng.random() < 0.5
            rows.append((key, line, usage, final))
            if kept is None or (usage != kept[1] and final):
                kept = (line, usage)
            else:
                duplicates += 1
        want[key] = (*kept, duplicates)
    df = spark.createDataFrame(rows, "key int, line int, usage int, final boolean")
    got = dedupe.fold_final(df, ["key"], "line", F.col("usage"), F.col("final")).collect()
    assert {r["key"]: (r["line"], r["usage"], r["duplicates"]) for r in got} == want


def test_prices_nested_and_flat(spark):
    nested = '{"p":{"id":"pp","models":{"m":{"cost":{"input":2,"output":4,"cache_read":0.5,"context_over_200k":{"input":8}},"limit":{"context":9}},"bad":3}},"q":{"id":5,"models":{"n":{}}},"r":1}'
    flat = '{"k":{"input_cost_per_token":0.25,"max_input_tokens":7},"bad":[]}'
    got = {r["price_key"]: r for df in (prices.flatten_prices(spark.createDataFrame([(d,)], "value string")) for d in (nested, flat)) for r in df.collect()}
    assert set(got) == {"pp/m", "q/n", "k"}
    assert (got["pp/m"]["input"], got["pp/m"]["input_200k"], got["pp/m"]["cache_write"], got["pp/m"]["context_limit"]) == (2e-6, 8e-6, None, 9)
    assert (got["k"]["input"], got["k"]["context_limit"], got["q/n"]["input"]) == (0.25, 7, None)


def test_raw_log(spark, tmp_path):
    objects = ['{\n  "a": 1\n}', '{\n  "b": {\n    "c": "x"\n  }\n}', '{\n"s": {"k": 1\n}\n}', '{\n  "d": 2\n}']
    (tmp_path / "t.log").write_text("\n".join(objects) + '\n{\n "open": 1')
    got = sorted(r["value"] for r in scan.concatenated_objects(spark, [str(tmp_path)]).select(F.to_json(F.try_parse_json("value")).alias("value")).collect())
    assert got == ['{"a":1}', '{"b":{"c":"x"}}', '{"d":2}', '{"s":{"k":1}}']


def test_line_numbers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x":1}\n\n[1]\n{bad\n{"x":2}\n')
    for whole in (True, False):
        rows = scan.json_lines(scan.lines(spark, [str(tmp_path)], whole_files=whole)).orderBy("line_number").collect()
        assert [(r["line_number"], r["malformed"]) for r in rows] == [(1, False), (3, True), (4, True), (5, False)]
    dated = spark.createDataFrame([("old", 1, '{"type":"session_meta","timestamp":"2026-01-01T23:00:00-09:00"}'), ("new", 1, '{"type":"session_meta","timestamp":"2026-01-03T00:00:00Z"}'), ("none", 1, "{}")], "file_path string, line_number long, value string")
    assert {r["file_path"] for r in scan.from_date(dated, date(2026, 1, 2)).collect()} == {"new", "none"}


def test_lenient_gemini(spark):
    rows = ['{"attributes":{"event.name":"gemini_cli.api_response","event.timestamp":"bad","input_token_count":"5"}}', "{oops", "[]", '{"attributes":{"event.name":"gemini_cli.api_request"}}']
    raw = spark.createDataFrame([("f", i + 1, x) for i, x in enumerate(rows)], "file_path string, line_number long, value string")
    got = scan.lenient_gemini(raw).drop("event_timestamp").collect()
    assert [(r["model_code"], r["input_tokens"], r["bad"]) for r in got] == [("unknown", 5, False), (None, None, True)]


def test_simplify(spark):
    full = {a: 1 for a in simplify.KEPT_ATTRIBUTES} | {"event.name": simplify.RESPONSE, "more": 2}
    import json

    lines = [{"record_type": simplify.METADATA}, {"attributes": full, "_body": {"t": 1}, "x": 1}, {"attributes": {"event.name": simplify.REQUEST}, "_body": 1}, {"attributes": {"event.name": simplify.RESPONSE}}, {"attributes": {"event.name": "other"}, "_body": 1}]
    df = spark.createDataFrame([("f", i + 1, json.dumps(x)) for i, x in enumerate(lines)], "file_path string, line_number long, value string")
    assert [simplify.simplified(df, n).count() for n in range(4)] == [5, 4, 3, 2]
    kept = json.loads(simplify.simplified(df, 3).filter("line_number > 1").first()["value"])
    assert set(kept) == {"attributes", "_body"} and tuple(kept["attributes"]) == simplify.KEPT_ATTRIBUTES
    assert simplify.misplaced_metadata(df).count() == 0
    late = df.withColumn("line_number", F.col("line_number") + 1)
    assert simplify.misplaced_metadata(late).count() == 1
    for level in range(4):
        with pytest.raises(Exception, match="metadata record after the first line at line 2"):
            simplify.simplified(late, level).select("value").collect()
    assert simplify.simplified(late.drop("line_number"), 1).count() == 4
    with pytest.raises(ValueError):
        simplify.simplified(df, 4)
    stamped = spark.createDataFrame([("f", i, '{"attributes":{"event.timestamp":"' + t + '"}}') for i, t in enumerate("bca")], "file_path string, line_number long, value string")
    assert simplify.largest_timestamp(stamped).first()["last"] == "c"
    assert simplify.tail_of(stamped, "a").count() == 2


def test_checkpoints_and_upsert(spark):
    rows = spark.createDataFrame([("s", None, 1), ("s", None, 2), ("s", "a", 1), ("t", None, 5)], "session string, agent string, n int")
    cp = incremental.checkpoints(rows.filter("n = 2"), ["session", "agent"], ["n"])
    for inclusive, want in ((True, 3), (False, 2)):
        assert incremental.after_checkpoint(rows, cp, ["session", "agent"], ["n"], inclusive=inclusive).count() == want
    old = spark.createDataFrame([(1, "a", "t1"), (2, "b", "t1")], "k int, v string, at string")
    new = spark.createDataFrame([(2, "c", "t2"), (3, "d", "t2"), (1, "a", "t2")], "k int, v string, at string")
    assert sorted(map(tuple, incremental.upsert(old, new, ["k"], ["v"], keep=("at",)).collect())) == [(1, "a", "t1"), (2, "c", "t1"), (3, "d", "t2")]
    assert sorted(r["k"] for r in incremental.changed_rows(old, new, ["k"], ["v"]).collect()) == [2, 3]


def test_registry_actions(spark):
    known = spark.createDataFrame([("p1", "/1", True), ("p2", "/2", True), ("p3", "/3", False), ("p4", "/4", True), ("p5", "/5", True)], "project_id string, path string, active boolean")
    found = spark.createDataFrame([("p1", "/1", False), ("p2", "/9", False), ("p3", "/3", False), ("p4", "/8", True), ("p6", "/5", False), ("p7", "/7", False)], "project_id string, path string, old_path_valid boolean")
    assert {r["project_id"]: r["action"] for r in registry.reconcile(found, known).collect()} == {"p1": "same", "p2": "moved", "p3": "reactivate", "p4": "conflict_old_path", "p6": "conflict_path", "p7": "new"}


def test_blocks(spark):
    minutes = [0, 10, 299, 301, 620, 1000]
    df = spark.createDataFrame([("k", m) for m in minutes], "k string, m int").withColumn("event_timestamp", F.timestamp_seconds(F.lit(1767225600 + 600) + F.col("m") * 60)).withColumns({"input_tokens": F.lit(1), "output_tokens": F.lit(2)})
    got = {r["m"]: r["b"] for r in stats.usage_blocks(df, "k").select("m", ((F.unix_seconds(F.col("block_start").cast("timestamp")) - 1767225600) / 60).cast("int").alias("b")).collect()}
    assert got == {0: 0, 10: 0, 299: 300, 301: 300, 620: 600, 1000: 960}
    rates = stats.burn_rate(stats.usage_blocks(df, "k"), "k", F.to_timestamp_ntz(F.lit("2026-01-01 17:00:00"))).collect()
    assert sum(r["active"] for r in rates) == 1


def test_empty_metric_summary(spark):
    got = turns.metric_summary(spark.createDataFrame([], "x long"), "x").first()
    assert (got["n"], got["mean"], got["p95"]) == (0, 0.0, 0.0)


def test_opened_objects_keep_the_kinds_of_their_fields(spark):
    from meterlake.functions.strict_json import given, kind, opened

    docs = ['{"a":1,"b.c":"x","m":{"u":{}}}', '{"a":null,"m":{"u":[1]}}', '{"m":3}', "[1]", "{broken"]
    rows = spark.createDataFrame(list(enumerate(docs)), "n int, doc string").select("n", F.try_parse_json("doc").alias("v"))
    got = opened(rows, "v", {"a": None, "b.c": None, "m": {"u": {"i": None}}})
    got = got.select("n", kind(F.col("a")), kind(F.col("`b.c`")), given(F.col("a"), "$"), F.col("m").isNotNull(), F.col("m.u").isNotNull())
    assert sorted(map(tuple, got.collect())) == [
        (0, "BIGINT", "STRING", True, True, True), (1, "VOID", None, False, True, False), *[(n, None, None, False, False, False) for n in (2, 3, 4)],
    ]
