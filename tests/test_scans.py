"""Ordered scans in ranges: same rows as plain Python, and no task with a whole log where one log has most rows."""

import json
import random
from datetime import datetime, timedelta

import pytest
from meterlake.operators import checks, dedupe, scans, stats, turns
from meterlake.sources import lines as scan
from pyspark.sql import functions as F

SCHEMA = "file string, line long, is_turn boolean, model string, total long, step long"


def log_rows(n=900, seed=7):
    """One file with nine tenths of the rows, one with no name, and some small ones; a turn spans many ranges."""
    rng = random.Random(seed)
    rows, lines = [], {}
    for _ in range(n):
        file = rng.choices(["hot", None, "a", "b"], [90, 3, 4, 3])[0]
        line = lines[file] = lines.get(file, 0) + rng.choice((1, 1, 1, 40))
        is_turn = rng.random() < (0.002 if file == "hot" and line > 300 else 0.1)
        rows.append((file, line, is_turn, rng.choice(("m1", "m2", None)) if is_turn else None, None if is_turn or rng.random() < 0.2 else rng.randint(0, 50), rng.randint(0, 5)))
    return rows


def by_file(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.fixture(scope="module", params=[10, 64, 10**6])
def width(request):
    return request.param


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame(log_rows(), SCHEMA).repartition(5).cache()


def test_order_checks(logs, width):
    rows = logs.filter("total is not null")
    got = dedupe.order_checks(rows, ["file"], "line", "total", [(F.col("total"), F.col("step"))], width=width).select("file", "line", "falls", "bad_delta").collect()
    want, falling = [], []
    for file, own in by_file([r for r in log_rows() if r[4] is not None]).items():
        for before, r in zip([None, *own], own, strict=False):
            want.append((file, r[1], before is not None and r[4] <= before[4], before is not None and r[4] - before[4] != r[5]))
            falling += [(file, r[1], before[4])] if before and r[4] <= before[4] else []
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    got = checks.not_rising(rows, ["file"], "line", "total", width=width).select("file", "line", "before").collect()
    assert sorted(map(tuple, got), key=key) == sorted(falling, key=key)
    got = checks.wrong_increment(rows, ["file"], "line", "total", "step", width=width).select("file", "line").collect()
    assert sorted(map(tuple, got), key=key) == sorted([w[:2] for w in want if w[3]], key=key)


def test_models_and_segments(logs, width):
    got = turns.attributed(turns.segments(logs, ["file"], "line", F.col("is_turn"), width=width), ["file"], "line", F.col("is_turn"), F.col("model"), "current", width=width)
    want = []
    for file, own in by_file(log_rows()).items():
        n, model = 0, "unset"
        for r in own:
            n, model = (n + 1, r[3]) if r[2] else (n, model)
            want.append((file, r[1], n, None if model == "unset" else model))
    assert sorted(map(tuple, got.select("file", "line", "segment", "current").collect()), key=key) == sorted(want, key=key)
    assert set(got.columns) == {*logs.columns, "segment", "current"}


def test_null_that_was_set_ends_the_value_before(spark):
    rows = [("f", 1, True, "m", None, 0), ("f", 50, True, None, None, 0), ("f", 99, False, None, 1, 0)]
    got = turns.attributed(spark.createDataFrame(rows, SCHEMA), ["file"], "line", F.col("is_turn"), F.col("model"), "current", width=10)
    assert {r["line"]: r["current"] for r in got.collect()} == {1: "m", 50: None, 99: None}


def test_boundaries(logs, width):
    got = turns.boundaries(turns.segments(logs, ["file"], "line", F.col("is_turn"), width=width), ["file"], "line", F.col("is_turn"), "total", width=width)
    want, longest = [], 0
    for file, own in by_file(log_rows()).items():
        starts = [i for i, r in enumerate(own) if r[2]]
        for n, (i, end) in enumerate(zip(starts, [*starts[1:], len(own)], strict=True), 1):
            above = [(r[4], r[1]) for r in own[:i] if not r[2] and r[4] is not None][-1:] or [(None, None)]
            inside = [(r[4], r[1]) for r in own[i:end] if not r[2] and r[4] is not None][:2]
            inside += [(None, None)] * (2 - len(inside))
            minus = lambda x, y: None if x is None or y is None else x - y
            longest = max(longest, own[end - 1][1] - own[i][1])
            want.append((file, n, own[i][1], *above[0], *inside[0], *inside[1], minus(inside[0][0], above[0][0]), minus(inside[1][0], inside[0][0])))
    assert longest > 3 * 64
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_first_id_names_the_whole_file(logs, width):
    got = turns.one_id_per_file(logs, ["file"], "line", F.when(F.col("total") == 7, F.concat(F.lit("s"), F.col("line").cast("string"))), width=width)
    want = []
    for file, own in by_file(log_rows()).items():
        first = next((f"s{r[1]}" for r in own if r[4] == 7), None)
        want += [(file, r[1], first) for r in own]
    assert sorted(map(tuple, got.select("file", "line", "session_id").collect()), key=key) == sorted(want, key=key)


def test_empty_logs(logs):
    none = logs.filter("false")
    assert dedupe.order_checks(none, ["file"], "line", "total", []).count() == 0
    assert turns.boundaries(turns.segments(none, ["file"], "line", F.col("is_turn")), ["file"], "line", F.col("is_turn"), "total").count() == 0


@pytest.mark.parametrize("scan", ["checks", "models", "segments", "session"])
def test_no_task_has_a_whole_log(spark, scan):
    """One of 40,000 rows in ten has another file: each task still gets less than a twentieth of the rows."""
    for k, v in {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.enabled": "false"}.items():
        spark.conf.set(k, v)
    try:
        n = 40_000
        rows = spark.range(n).select(F.when(F.col("id") % 10 == 0, F.col("id") % 30).otherwise(-1).alias("file"), F.col("id").alias("line"), F.col("id").alias("total"), (F.col("id") % 500 == 0).alias("is_turn"))
        made = {
            "checks": lambda: dedupe.order_checks(rows, ["file"], "line", "total", [], width=200),
            "models": lambda: turns.attributed(rows, ["file"], "line", F.col("is_turn"), F.col("total"), "current", width=200),
            "segments": lambda: turns.segments(rows, ["file"], "line", F.col("is_turn"), width=200),
            "session": lambda: turns.one_id_per_file(rows, ["file"], "line", F.col("total"), width=200),
        }[scan]()
        tasks = made.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("count"), F.max(F.hash(*made.columns))).collect()
        assert sum(r["count"] for r in tasks) == n and max(r["count"] for r in tasks) < n / 20
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def plain_blocks(times, hours=5):
    start, out = None, {}
    for t in sorted(times):
        if start is None or t >= start + timedelta(hours=hours):
            start = t.replace(minute=0, second=0)
        out[t] = start
    return out


@pytest.mark.parametrize("hours", [1, 5, 7])
def test_usage_blocks(spark, hours):
    """Ten years of use without a pause for one key, and random use with pauses for others."""
    rng = random.Random(hours)
    begin = datetime(2015, 1, 1, 3)
    rows = {"dense": [begin + timedelta(hours=h, minutes=7) for h in range(0, 87_600)]}
    for k in range(5):
        t, own = begin, []
        for _ in range(300):
            t += timedelta(minutes=rng.choice((1, 20, 59, 61, 240, 299, 301, 2000, 80_000)))
            own.append(t)
        rows[f"k{k}"] = own
    rows["old"] = [datetime(1969, 12, 31, 22, 30), datetime(1970, 1, 1, 2, 59), datetime(1970, 1, 1, 3, 1)]
    events = spark.createDataFrame([(k, t) for k, ts in rows.items() for t in ts], "who string, event_timestamp timestamp_ntz")
    got = {(r["who"], r["event_timestamp"]): r["block_start"] for r in stats.usage_blocks(events, "who", hours).collect()}
    assert got == {(k, t): s for k, ts in rows.items() for t, s in plain_blocks(ts, hours).items()}
    gaps = {(r["who"], r["gap_start"], r["gap_end"]) for r in stats.gap_blocks(events, "who", hours).collect()}
    want = {(k, a + timedelta(hours=hours), b) for k, ts in rows.items() for a, b in zip(sorted(ts), sorted(ts)[1:]) if b - a > timedelta(hours=hours)}  # noqa: B905
    assert gaps == want


@pytest.mark.parametrize("bins", [2, 7, 1024])
def test_order_statistics(spark, monkeypatch, bins):
    monkeypatch.setattr(turns, "BINS", bins)
    rng = random.Random(bins)
    values = [rng.choice((0.0, 1.5, -3.0, 1e9, rng.random(), rng.randint(-5, 5))) for _ in range(700)]
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    got = turns.order_statistics(rows.filter("x is not null"), "x", {0, 1, 349, 350, 698, 699}, min(values), max(values))
    assert got == {r: sorted(values)[r] for r in (0, 1, 349, 350, 698, 699)}
    exact = rows.agg(F.percentile("x", 0.5), F.percentile("x", 0.9), F.percentile("x", 0.95)).first()
    summary = turns.metric_summary(rows, "x").first()
    assert [summary[c] for c in ("median", "p90", "p95")] == pytest.approx(list(exact), abs=1e-9) and summary["n"] == 700
    assert tuple(turns.metric_summary(rows.filter("x > 1e10"), "x").first()) == (0, 0.0, 0.0, 0.0, 0.0, 0.0)


def test_floored_sums_cross_ranges(spark):
    draw = random.Random(5)
    logs = {k: [(i * 3 + draw.randint(0, 2), draw.choice((None, -4, -2, -1, 1, 2, 3))) for i in range(200)] for k in "ab"}
    rows = spark.createDataFrame([(k, n, v) for k, log in logs.items() for n, v in log], "k string, n long, v long").repartition(3)
    for width in (7, 100, 10_000):
        got = {(r["k"], r["n"]): r["d"] for r in scans.floored_sum(rows, ["k"], "n", F.col("v"), "d", width=width).collect()}
        for k, log in logs.items():
            depth = 0
            for n, v in log:
                depth = max(0, depth + (v or 0))
                assert got[k, n] == depth


def buffered(text):
    """Objects of a raw log, line by line: a line that is a closing brace ends an object if what was gathered parses."""
    found, lines = [], []
    for line in text.splitlines():
        lines.append(line)
        if line == "}":
            try:
                found.append(json.loads("\n".join(lines)))
                lines = []
            except ValueError:
                pass
    return found


def test_raw_objects_with_closing_lines_of_their_own(spark, tmp_path):
    draw = random.Random(8)

    def record(i):
        odd = draw.choice(['plain', 'a \\" quote {', '}]', '\\\\', '[[[', '\\n}\\n', ''])
        inner = draw.choice(['1', '{\n}', '{\n"x": {\n"y": [1, {\n}\n]\n}\n}', '[{\n"z": "}"\n}\n, 2]', '{\n"x": 1\n  }'])
        return f'{{\n"id": {i},\n"odd": "{odd}",\n"inner": {inner}\n}}\n'

    logs = ["".join(record(1000 * f + i) for i in range(120)) for f in range(3)]
    logs.append(record(9000) + record(9001).rstrip("\n"))  # no line break at the end
    for f, log in enumerate(logs):
        (tmp_path / f"{f}.log").write_text(log)
    want = sorted(r["id"] for log in logs for r in buffered(log))
    assert len(want) == 362
    for width in (5, 65_536):
        got = [json.loads(r["value"]) for r in scan.concatenated_objects(spark, [str(tmp_path)], width=width).collect()]
        assert sorted(r["id"] for r in got) == want
    by_id = {r["id"]: r for log in logs for r in buffered(log)}
    assert all(r == by_id[r["id"]] for r in got)


def test_an_unfinished_raw_object_ends_at_the_next_whole_one(spark, tmp_path):
    whole, nested = '{{\n"id": {0}\n}}\n', '{{\n"id": {0}, "v": {{\n"w": 1\n}}\n}}\n'
    log = nested.format(1) + '{\n"id": 2, "v": {\n"w": 1\n}\n' + nested.format(3) + whole.format(4) + nested.format(5) + "}\n" + nested.format(6) + '{\n"id": 7, "v": {\n}\n'
    (tmp_path / "t.log").write_text(log)
    got = scan.concatenated_objects(spark, [str(tmp_path)]).collect()
    assert sorted(json.loads(r["value"])["id"] for r in got) == [1, 4, 5, 6]


def test_a_users_logs_follow_its_own_events(spark, sf_dir, monkeypatch):
    """Users have fewer events than a log holds, so each has one log, though the ids of its events span many times that number."""
    from meterlake import queries

    opened, lines = [], queries.lines.lines

    def noted(spark, paths, **more):
        found = lines(spark, paths, **more)
        opened.extend(found.inputFiles())
        return found

    whole = sorted(map(tuple, queries.jsonl_scan_quarantine(spark, sf_dir).collect()))
    monkeypatch.setattr(queries, "LOG_EVENTS", 100)
    monkeypatch.setattr(queries.lines, "lines", noted)
    assert sorted(map(tuple, queries.jsonl_scan_quarantine(spark, sf_dir).collect())) == whole
    assert len(opened) == len(whole)
    monkeypatch.setattr(queries, "LOG_EVENTS", 10)
    assert sorted(map(tuple, queries.jsonl_scan_quarantine(spark, sf_dir).collect())) == whole
