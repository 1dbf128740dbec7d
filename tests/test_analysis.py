"""Turn analysis, CSV outputs and telemetry conversion."""

import csv
import json
import os

from meterlake.operators import sinks
from meterlake.plans import analysis
from meterlake.sources import lines as scan


def token(total):
    return {"type": "event_msg", "payload": {"type": "token_count", "info": None if total is None else {"total_token_usage": {"total_tokens": total}}}}


def turn(model):
    return {"type": "turn_context", "timestamp": "t", "payload": {"model": model}}


def test_turns_and_boundaries(spark, tmp_path):
    events = [token(5), turn("a"), token(5), token(5), token(9), token(None), token(True), turn(""), token(9), {"type": "session_meta", "payload": {"id": "s"}}]
    (tmp_path / "x.jsonl").write_text("{bad\n" + "\n".join(map(json.dumps, events)) + "\n")
    raw = scan.lines(spark, [str(tmp_path)])
    rows = analysis.turn_rows(raw)
    table = {r["turn_context_line"]: r for r in analysis.turn_table(rows).collect()}
    assert [(r["session_id"], r["model_code"], r["token_count_events_raw"], r["token_count_events_with_info"], r["token_count_events_deduped"]) for _, r in sorted(table.items())] == [("s", "a", 5, 4, 2), ("s", None, 1, 1, 1)]
    counters = analysis.analysis_counters(raw, rows).first()
    assert (counters["files_scanned"], counters["parse_errors"], counters["orphan_token_count_events"], counters["sessions_found"]) == (1, 1, 1, 1)
    sinks.write_csv(analysis.boundary_table(rows).orderBy("turn_context_line").coalesce(1), str(tmp_path / "csv"))
    with next((tmp_path / "csv").glob("part-*.csv")).open() as f:
        got = list(csv.DictReader(f))
    assert len(got[0]) == 13
    assert [(r["prev_total_tokens"], r["first_after_total_tokens"], r["second_after_total_tokens"], r["first_matches_previous"], r["second_is_new"]) for r in got] == [("5", "5", "5", "1", "0"), ("9", "9", "", "1", "0")]


def test_conversion_appends_what_is_new(spark, tmp_path):
    record = lambda at: json.dumps({"attributes": {"event.name": "gemini_cli.api_request", "event.timestamp": at}, "_body": {"x": 1}, "more": 1}, indent=2)
    (tmp_path / "raw").mkdir()
    log, out = tmp_path / "raw/t.log", str(tmp_path / "out")
    log.write_text(record("2026-01-01") + "\n" + record("2026-01-02") + "\n")
    assert analysis.convert_telemetry(spark, [str(tmp_path / "raw")], out, 2) == 2
    log.write_text(log.read_text() + record("2026-01-03") + "\n{\n")
    assert analysis.convert_telemetry(spark, [str(tmp_path / "raw")], out, 2) == 1
    got = sorted(r["value"] for r in spark.read.text(out).collect())
    assert len(got) == 3 and all(set(json.loads(x)) == {"attributes", "_body"} for x in got)


def test_conversion_reads_a_converted_file_once(spark, tmp_path):
    record = lambda at: json.dumps({"attributes": {"event.name": "gemini_cli.api_request", "event.timestamp": at}, "_body": {}}, indent=2) + "\n"
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    assert analysis.last_converted(spark, str(out)) is None
    (raw / "t.log").write_text(record("2026-01-01") + record("2026-01-02"))
    assert analysis.convert_telemetry(spark, [str(raw)], str(out)) == 2
    # lines that can't be read now, under the same sizes and times: the next run doesn't look at them
    old = sorted(p for p in out.glob("part-*") if p.stat().st_size)
    for p in old:
        state = p.stat()
        p.write_bytes(b"?" * state.st_size)
        os.utime(p, ns=(state.st_atime_ns, state.st_mtime_ns))
        (out / f".{p.name}.crc").unlink(missing_ok=True)
    (raw / "t.log").write_text((raw / "t.log").read_text() + record("2026-01-03"))
    assert analysis.convert_telemetry(spark, [str(raw)], str(out)) == 1
    assert analysis.last_converted(spark, str(out)) == "2026-01-03"
    # a run that died after its lines were added, and a file that is gone
    (out / "part-late.txt").write_text('{"attributes":{"event.timestamp":"2026-02-01"}}\n{"attributes":{}}\n')
    assert analysis.last_converted(spark, str(out)) == "2026-02-01"
    (out / "part-late.txt").unlink()
    assert analysis.last_converted(spark, str(out)) == "2026-01-03"
    assert spark.read.text(str(out)).count() == 3 - 2 + len(old)
