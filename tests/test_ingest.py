"""Incremental ingestion end to end, on small logs: run, run again, append, run."""

import json
import sqlite3

import pytest
from meterlake.plans import ingest
from meterlake.plans.ingest import ingest_gemini, ingest_opencode, ingest_sessions
from meterlake.schemas import TABLES
from meterlake.sources.sqlite import opencode_tables
from meterlake.sources.warehouse import Warehouse, usage_events
from pyspark.sql import functions as F

SID = "0b6d3f52-7d6e-4c0f-9a51-0f1c2d3e4f50"


def write(path, *events):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a") as f:
        f.writelines((e if isinstance(e, str) else json.dumps(e)) + "\n" for e in events)


def counts(df):
    return {r["counter"]: r["value"] for r in df.collect()}


def claude(n, tokens=(100, 50), stop="end_turn", message=None, session="s1", **more):
    usage = {"input_tokens": tokens[0], "output_tokens": tokens[1]}
    return {"type": "assistant", "sessionId": session, "timestamp": f"2026-01-01T00:00:{n:02d}Z", "requestId": f"req-{message or n}", "cwd": "/w", "message": {"id": f"msg-{message or n}", "model": "claude-x", "stop_reason": stop, "usage": usage}, **more}


def test_claude_three_runs(spark, tmp_path):
    root, w = tmp_path / "logs", Warehouse(spark, str(tmp_path / "w"))
    log = root / "proj" / "s1.jsonl"
    write(log, claude(1), "", claude(2))
    got = counts(ingest_sessions(w, "claude", [str(root)]))
    assert (got["raw"], got["deduped"], got["ingested"]) == (2, 2, 1)
    got = counts(ingest_sessions(w, "claude", [str(root)]))
    assert (got["unchanged"], got["raw"]) == (1, 0)
    write(log, claude(3))
    got = counts(ingest_sessions(w, "claude", [str(root)]))
    assert (got["raw"], got["skipped"], got["deduped"]) == (3, 1, 2)
    assert w.read("claude_usage_events").count() == 3
    meta = w.read("claude_session_metadata").first()
    assert (meta["project_name"], meta["cwd"]) == ("proj", "/w")
    assert usage_events(w, "claude").agg(F.sum("input_tokens")).first()[0] == 300


def test_claude_duplicates(spark, tmp_path):
    """Equal tokens, partial after partial, and final after partial; one session each."""
    w, root = Warehouse(spark, str(tmp_path / "w")), tmp_path / "logs"
    write(root / "p/equal.jsonl", claude(1, message="a", session="equal"), claude(2, message="a", session="equal"))
    write(root / "p/partial.jsonl", claude(1, (100, 8), None, "a", "partial"), claude(2, (100, 168), None, "a", "partial"))
    write(root / "p/final.jsonl", claude(1, (100, 8), None, "a", "final"), claude(2, (100, 168), "tool_use", "a", "final"))
    got = counts(ingest_sessions(w, "claude", [str(root)]))
    assert (got["raw"], got["duplicates"]) == (6, 2)
    assert {r["session_id"]: r["output_tokens"] for r in w.read("claude_usage_events").collect()} == {"equal": 50, "partial": 8, "final": 168}


def test_claude_bad_file_is_rejected_alone(spark, tmp_path):
    w, root = Warehouse(spark, str(tmp_path / "w")), tmp_path / "logs"
    write(root / "p/good.jsonl", claude(1), {**claude(2), "speed": "fast"}, {**claude(3), "message": {"id": "m", "model": "<synthetic>", "usage": {}}})
    write(root / "p/bad.jsonl", claude(1, session="s2"), "{oops")
    write(root / "p/none.jsonl", {"type": "user"})
    got = counts(ingest_sessions(w, "claude", [str(root)]))
    assert (got["ingested"], got["failed"], got["parse_errors"], got["synthetic"]) == (1, 2, 2, 1)
    assert {r["model_code"] for r in w.read("claude_usage_events").collect()} == {"claude-x", "claude-x-fast"}
    assert w.read("claude_ingestion_files").count() == 1


def test_claude_files_of_one_session_in_rounds(spark, tmp_path):
    """A key in two files goes to the first path, and the later file only adds what is new."""
    w, root = Warehouse(spark, str(tmp_path / "w")), tmp_path / "logs"
    write(root / "p/a.jsonl", claude(1), claude(5))
    write(root / "p/b.jsonl", claude(3), claude(5, (7, 7)), claude(6))
    got = counts(ingest_sessions(w, "claude", [str(root)]))
    assert (got["raw"], got["skipped"]) == (5, 1)
    rows = {r["message_id"]: r["input_tokens"] for r in w.read("claude_usage_events").collect()}
    assert rows == {"msg-1": 100, "msg-5": 100, "msg-6": 100}


def snap(total, **more):
    return {"input_tokens": total, "cached_input_tokens": 0, "output_tokens": 0, "reasoning_output_tokens": 0, "total_tokens": total, **more}


def token(n, total, last):
    return {"type": "event_msg", "timestamp": f"2026-01-01T00:00:{n:02d}Z", "payload": {"type": "token_count", "info": {"total_token_usage": total, "last_token_usage": last}}}


META = {"type": "session_meta", "timestamp": "2026-01-01T00:00:00Z", "payload": {"id": SID, "cwd": "/w"}}


def turn(model):
    return {"type": "turn_context", "timestamp": "2026-01-01T00:00:00Z", "payload": {"model": model}}


def test_codex_three_runs(spark, tmp_path):
    root, w = tmp_path / "logs", Warehouse(spark, str(tmp_path / "w"))
    write(root / "a.jsonl", META, turn("gpt-5"), token(1, snap(10), snap(10)), token(2, snap(20), snap(10)))
    assert counts(ingest_sessions(w, "codex", [str(root)]))["deduped"] == 2
    assert counts(ingest_sessions(w, "codex", [str(root)]))["unchanged"] == 1
    write(root / "a.jsonl", turn("o3"), token(3, snap(20), snap(0)), token(4, snap(30), snap(10)))
    got = counts(ingest_sessions(w, "codex", [str(root)]))
    assert (got["raw"], got["skipped"], got["duplicates"], got["deduped"]) == (4, 1, 1, 2)
    rows = sorted((r["total_tokens_cumulative"], r["model_code"]) for r in w.read("codex_session_details").collect())
    assert rows == [(10, "gpt-5"), (20, "gpt-5"), (30, "o3")]


def test_codex_errors(spark, tmp_path):
    """One file per error; only the good one is stored."""
    w, root = Warehouse(spark, str(tmp_path / "w")), tmp_path / "logs"
    first = token(1, snap(10), snap(10))
    cases = {
        "conflict": [first, token(2, snap(10, output_tokens=1), snap(0))], "falls": [first, token(2, snap(9), snap(1))], "delta": [first, token(2, snap(18), snap(7))],
        "model": [turn(None), first], "type": [token(1, snap("x"), snap(10))], "good": [first, token(2, snap(10), snap(0)), token(3, snap(18), snap(8))],
    }
    for n, (name, rows) in enumerate(cases.items()):
        write(root / f"{name}.jsonl", {**META, "payload": {"id": f"{n}{SID[1:]}"}}, turn("m"), *rows)
    got = counts(ingest_sessions(w, "codex", [str(root)]))
    assert (got["parse_errors"], got["monotonicity_errors"], got["delta_errors"], got["failed"], got["ingested"], got["duplicates"]) == (3, 1, 1, 5, 1, 1)
    assert sorted(r["event_line_number"] for r in w.read("codex_session_details").collect()) == [3, 5]


def pi_row(n, **usage):
    return {"type": "message", "id": f"m{n}", "timestamp": f"2026-01-01T00:00:{n:02d}Z", "message": {"role": "assistant", "provider": "p", "model": "x", "usage": {"input": 1, "output": 2, **usage}}}


def test_pi_three_runs(spark, tmp_path):
    root, w = tmp_path / "logs", Warehouse(spark, str(tmp_path / "w"))
    log = root / "--home-alice-work--" / "2026_abc.jsonl"
    cost = {"input": 0.01, "output": 0.02, "cacheRead": 0.003, "cacheWrite": 0.004, "total": 0.037}
    write(log, {"type": "session", "id": "abc", "version": 3, "timestamp": "2026-01-01T00:00:00Z"}, pi_row(1, cost=cost), pi_row(2))
    assert counts(ingest_sessions(w, "pi", [str(root)]))["deduped"] == 2
    assert counts(ingest_sessions(w, "pi", [str(root)]))["unchanged"] == 1
    write(log, pi_row(3))
    got = counts(ingest_sessions(w, "pi", [str(root)]))
    assert (got["raw"], got["skipped"], got["deduped"]) == (3, 2, 1)
    rows = {r["message_id"]: r for r in w.read("pi_usage_events").collect()}
    assert len(rows) == 3
    assert [rows["m1"][f"pi_reported_cost_{k}_usd"] for k in ("input", "output", "cache_read", "cache_write", "total")] == [0.01, 0.02, 0.003, 0.004, 0.037]
    assert w.read("pi_session_metadata").first()["cwd"] == "/home/alice/work"


def test_pi_bad_rows_reject_the_file(spark, tmp_path):
    w, root = Warehouse(spark, str(tmp_path / "w")), tmp_path / "logs"
    bad = [pi_row(1, input=True), pi_row(1, totalTokens="x"), pi_row(1, cost=3), {**pi_row(1), "id": ""}, pi_row(2)]
    for n, row in enumerate(bad):
        write(root / f"--a--/x_s{n}.jsonl", {"type": "session", "id": f"s{n}", "version": 3, "timestamp": "2026-01-01T00:00:00Z"}, pi_row(2), row)
    write(root / "--a--/x_other.jsonl", {"type": "session", "id": "name", "version": 3, "timestamp": "2026-01-01T00:00:00Z"}, pi_row(2))
    got = counts(ingest_sessions(w, "pi", [str(root)]))
    assert (got["failed"], got["ingested"]) == (6, 0)


def gemini_row(minute, model, **more):
    return {"attributes": {"event.name": "gemini_cli.api_response", "event.timestamp": f"2026-01-01T00:{minute:02d}:00Z", "model": model, "input_token_count": 5, "cached_content_token_count": 1, "output_token_count": 2, "thoughts_token_count": 0, "total_token_count": 7, **more}}


HEAD = {"record_type": "gemini_cli.project_metadata", "schema_version": 1, "project_id": SID}


def test_gemini_three_runs(spark, tmp_path):
    w, log = Warehouse(spark, str(tmp_path / "w")), tmp_path / "t.jsonl"
    write(log, HEAD, gemini_row(0, "a"), gemini_row(1, "b"))
    assert counts(ingest_gemini(w, [str(log)]))["attempted"] == 2
    assert counts(ingest_gemini(w, [str(log)]))["unchanged"] == 1
    write(log, gemini_row(1, "c"))
    got = counts(ingest_gemini(w, [str(log)]))
    assert (got["total"], got["skipped"], got["attempted"]) == (3, 1, 2)
    assert w.read("gemini_usage_events").count() == 3
    source = w.read("gemini_ingestion_sources").first()
    assert (source["active"], source["last_ingested_model_code"]) == (True, "c")


def test_gemini_errors_fail_the_run(spark, tmp_path):
    w, log = Warehouse(spark, str(tmp_path / "w")), tmp_path / "t.jsonl"
    write(log, HEAD, gemini_row(3, "a"))
    ingest_gemini(w, [str(log)])
    log.unlink()
    write(log, HEAD, gemini_row(1, "a"), gemini_row(2, "a"))
    with pytest.raises(ValueError, match="rewritten"):
        ingest_gemini(w, [str(log)])
    twice, other = tmp_path / "u.jsonl", tmp_path / "v.jsonl"
    write(twice, {**HEAD, "project_id": SID.replace("0b", "1b")}, gemini_row(1, "a"), gemini_row(1, "a"))
    with pytest.raises(ValueError, match="duplicate"):
        ingest_gemini(w, [str(twice)])
    write(other, gemini_row(1, "a"))
    with pytest.raises(ValueError, match="project line"):
        ingest_gemini(w, [str(other)])
    assert w.read("gemini_usage_events").count() == 1


def opencode_store(path, *messages):
    with sqlite3.connect(path) as c:
        c.executescript("create table if not exists project(id text primary key, worktree text); create table if not exists session(id text primary key, project_id text, title text, directory text, version text); create table if not exists message(id text primary key, session_id text, time_created int, time_updated int, data text);")
        c.execute("insert or replace into project values('p', null)")
        c.execute("insert or replace into session values('s', 'p', 't', null, '1')")
        c.executemany("insert or replace into message values(?, ?, ?, ?, ?)", messages)


def oc(name, updated, tokens=1, session="s", **more):
    data = {"role": "assistant", "tokens": {"input": tokens, "output": 2, "reasoning": 0, "cache": {"read": 0, "write": 0}}, "providerID": "opencode", "modelID": "m", "cost": 0.5, **more}
    return (name, session, 1000, updated, json.dumps(data))


def test_opencode_increment_and_refresh(spark, tmp_path):
    w, db = Warehouse(spark, str(tmp_path / "w")), str(tmp_path / "store.db")
    opencode_store(db, oc("m1", 1000), oc("m2", 2000), oc("x", 1500, session="gone"), ("u", "s", 1, 1, '{"role":"user"}'))
    assert counts(ingest_opencode(w, *opencode_tables(spark, db)))["rows"] == 2
    got = counts(ingest_opencode(w, *opencode_tables(spark, db)))
    assert (got["rows"], got["fast_skip"]) == (0, 0)
    opencode_store(db, oc("m3", 3000))
    before = w._last()[1]["opencode_message_usage"]
    assert counts(ingest_opencode(w, *opencode_tables(spark, db)))["rows"] == 1
    assert len(set(w._last()[1]["opencode_message_usage"]) - set(before)) == 1  # the bucket of m3 is written, no other
    assert w.read("opencode_message_usage").count() == 3
    assert w.read("opencode_sessions").first()["session_directory"] == "None"
    opencode_store(db, oc("m1", 4000, 99))
    ingest_opencode(w, *opencode_tables(spark, db), full_refresh=True)
    row = w.read("opencode_message_usage").filter("message_id = 'm1'").first()
    assert (row["input_tokens"], row["source_time_updated_ms"], w.read("opencode_message_usage").count()) == (99, 4000, 3)
    opencode_store(db, ("bad", "s", 1, 9000, '{"role":"assistant","tokens":{"input":true}}'))
    with pytest.raises(ValueError, match="bad"):
        ingest_opencode(w, *opencode_tables(spark, db))


def test_compaction_keeps_rows(spark, tmp_path):
    root, w = tmp_path / "logs", Warehouse(spark, str(tmp_path / "w"))
    for n in range(3):
        write(root / f"p/s{n}.jsonl", claude(1, session=f"s{n}"))
        ingest_sessions(w, "claude", [str(root)])
    before = sorted(map(str, w.read("claude_usage_events").collect()))
    w.compact("claude_usage_events", 1, ["event_timestamp"])
    assert sorted(map(str, w.read("claude_usage_events").collect())) == before
    assert len(w.read("claude_usage_events").inputFiles()) == 1


def test_blank_logs_are_rejected_files(spark, tmp_path):
    """A log without any event is a failed file, alone or beside good ones, and doesn't hold up others."""
    w, root = Warehouse(spark, str(tmp_path / "w")), tmp_path / "logs"
    (root / "p").mkdir(parents=True)
    for name in ("blank", "other"):
        (root / f"p/{name}.jsonl").write_text("\n \n")
    got = counts(ingest_sessions(w, "claude", [str(root)]))
    assert (got["scanned"], got["failed"], got["parse_errors"], got["ingested"]) == (2, 2, 2, 0)
    write(root / "p/good.jsonl", claude(1))
    got = counts(ingest_sessions(w, "claude", [str(root)]))
    assert (got["scanned"], got["failed"], got["ingested"], got["deduped"]) == (3, 2, 1, 1)


def test_odd_paths_and_many_files(spark, tmp_path, monkeypatch):
    """Paths with blanks and pattern characters, in one read group and in several."""
    w, root = Warehouse(spark, str(tmp_path / "w")), tmp_path / "log s"
    write(root / "p [a]/s{1}.jsonl", claude(1))
    assert counts(ingest_sessions(w, "claude", [str(root)]))["ingested"] == 1
    monkeypatch.setattr(ingest, "MOST_PATHS", 0)
    monkeypatch.setattr(ingest, "FEW_SESSIONS", 0)
    write(root / "q/s2.jsonl", claude(2, session="s2"))
    got = counts(ingest_sessions(w, "claude", [str(root)]))
    assert (got["unchanged"], got["ingested"]) == (1, 1)
    assert w.read("claude_usage_events").count() == 2


def test_lines_are_numbered_across_splits(spark, tmp_path):
    from meterlake.sources import lines as scan

    text = [f"line {i}" if i % 3 else "" for i in range(500)]
    (tmp_path / "x.jsonl").write_text("\n".join(text) + "\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        rows = scan.lines(spark, [str(tmp_path)])
        assert [r["value"] for r in rows.orderBy("line_number").collect()] == text
        assert sorted(r["line_number"] for r in rows.collect()) == list(range(1, 501))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_a_commit_made_by_another_run_is_kept(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    row = spark.createDataFrame([("a", None, "x", 1)], "agent string, run_at timestamp, counter string, value long")
    w.commit({"ingest_runs": row})
    stale = w._last()
    w.commit({"ingest_runs": row})
    late = Warehouse(spark, w.path)
    late._last = lambda: stale
    with pytest.raises(Exception, match="(?i)exists"):
        late.commit({"ingest_runs": row})
    assert w.read("ingest_runs").count() == 2


def test_metadata_refresh_without_events(spark, tmp_path):
    """Session metadata of unchanged files is derived anew; events stay."""
    w, root = Warehouse(spark, str(tmp_path / "w")), tmp_path / "logs"
    write(root / "p/s1.jsonl", claude(1))
    ingest_sessions(w, "claude", [str(root)])
    stored = w.read("claude_session_metadata").withColumn("cwd", F.lit("/old"))
    w.commit(snapshots={"claude_session_metadata": stored})
    got = counts(ingest_sessions(w, "claude", [str(root)], refresh_metadata=True))
    assert (got["unchanged"], got["ingested"]) == (1, 0)
    assert w.read("claude_session_metadata").first()["cwd"] == "/w" and w.read("claude_usage_events").count() == 1


def test_read_groups_follow_paths_counts_and_bytes(spark, monkeypatch):
    files = [(f"f{i:03d}", 10 if i % 7 else 95) for i in range(50)]
    monkeypatch.setattr(ingest, "MOST_PATHS", 6)
    monkeypatch.setattr(ingest, "MOST_BYTES", 100)
    got = ingest.read_groups(spark.createDataFrame(files, "file_path string, file_size long").repartition(5), len(files)).orderBy("file_path").collect()
    count, size, want = 0, 0, []
    for _, n in files:
        want.append(count // 6 + size // 100)
        count, size = count + 1, size + n
    assert [r["read_group"] for r in got] == want and [(r["file_path"], r["file_size"]) for r in got] == files


def test_only_changed_files_are_opened_group_by_group(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "MOST_PATHS", 3)
    for i in range(12):
        write(tmp_path / f"logs/{i:02d}.jsonl", claude(i, session=f"s{i % 5}"))
    w = Warehouse(spark, str(tmp_path / "w"))
    first = counts(ingest.ingest_sessions(w, "claude", [str(tmp_path / "logs")]))
    assert (first["scanned"], first["ingested"]) == (12, 12) and w.read("claude_usage_events").count() == 12
    for i in range(0, 12, 2):
        write(tmp_path / f"logs/{i:02d}.jsonl", claude(i, session=f"s{i % 5}"), claude(i + 20, session=f"s{i % 5}"))
    opened, lines = [], ingest.scan.lines

    def noted(spark, paths, **more):
        found = lines(spark, paths, **more)
        opened.append(sorted(p[-8:] for p in found.inputFiles()))
        return found

    monkeypatch.setattr(ingest.scan, "lines", noted)
    again = counts(ingest.ingest_sessions(w, "claude", [str(tmp_path / "logs")]))
    assert (again["unchanged"], again["ingested"]) == (6, 6) and w.read("claude_usage_events").count() == 18
    assert opened == [["00.jsonl", "02.jsonl", "04.jsonl"], ["06.jsonl", "08.jsonl", "10.jsonl"]]


def test_largest_stored_time_comes_from_footers(spark, tmp_path, capsys):
    w = Warehouse(spark, str(tmp_path / "w"), buckets=2)
    assert w.largest("opencode_message_usage", "source_time_updated_ms") is None
    for times in ([(f"m{i}", 100 + i) for i in range(20)], [("m3", 500), ("m30", 7)]):
        rows = spark.createDataFrame(times, "message_id string, source_time_updated_ms long")
        for f in TABLES["opencode_message_usage"].schema:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        w.commit(changed={"opencode_message_usage": ingest._upserted(w, "opencode_message_usage", rows, ["session_id"])})
    assert w.largest("opencode_message_usage", "source_time_updated_ms") == 500
    w.footer_largest("opencode_message_usage", "source_time_updated_ms").explain("formatted")
    assert "PushedAggregation: [MAX(source_time_updated_ms)]" in capsys.readouterr().out


def test_gemini_logs_in_several_read_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "MOST_PATHS", 1)
    w = Warehouse(spark, str(tmp_path / "w"))
    for i in range(3):
        write(tmp_path / f"logs/{i}.jsonl", {**HEAD, "project_id": f"{SID[:-1]}{i}"}, gemini_row(0, "a"), gemini_row(i + 1, "b"))
    got = counts(ingest_gemini(w, [str(tmp_path / "logs")]))
    assert (got["files"], got["attempted"]) == (3, 6) and w.read("gemini_usage_events").count() == 6


@pytest.mark.parametrize("agent", ["claude", "gemini"])
def test_plans_of_a_run_hold_no_parsing(spark, tmp_path, monkeypatch, agent):
    """What a run commits is read from its stored steps, so its plans don't grow with the steps and the files before."""
    plans, commit = [], Warehouse.commit

    def noted(self, appends=None, snapshots=None, changed=None, sort=None):
        plans.extend(df._jdf.queryExecution().executedPlan().toString() for d in (appends, changed) for df in (d or {}).values())
        commit(self, appends, snapshots, changed, sort)

    monkeypatch.setattr(Warehouse, "commit", noted)
    w = Warehouse(spark, str(tmp_path / "w"))
    if agent == "claude":
        write(tmp_path / "logs/p/s1.jsonl", claude(1), claude(2))
        assert counts(ingest_sessions(w, "claude", [str(tmp_path / "logs")]))["deduped"] == 2
    else:
        write(tmp_path / "t.jsonl", HEAD, gemini_row(0, "a"))
        assert counts(ingest_gemini(w, [str(tmp_path / "t.jsonl")]))["attempted"] == 1
    assert plans and not any("parse_json" in p for p in plans)


def test_later_pi_logs_come_later_by_path(spark, sf_dir, monkeypatch):
    """Spark's file names hold a random part, so logs of two runs in one folder are in no order of their own."""
    from meterlake import agent_queries

    paths = []
    monkeypatch.setattr(agent_queries.fixtures, "write_logs", lambda rows, path, order: paths.append(path))
    monkeypatch.setattr(agent_queries, "ingest_sessions", lambda *a, **b: None)
    agent_queries._pi(spark, sf_dir)
    assert len(set(paths)) == 2 and paths == sorted(paths)
