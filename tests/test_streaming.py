"""A stream over a log folder ingests new files once."""

import json

from meterlake.sources.warehouse import Warehouse
from meterlake.streaming.new_files import ingest_new_files


def test_new_files(spark, tmp_path):
    log, w = tmp_path / "logs/p/s1.jsonl", Warehouse(spark, str(tmp_path / "w"))
    log.parent.mkdir(parents=True)
    row = {"type": "assistant", "sessionId": "s1", "timestamp": "2026-01-01T00:00:01Z", "requestId": "r", "message": {"id": "m", "model": "x", "stop_reason": "end", "usage": {"input_tokens": 1, "output_tokens": 2}}}
    log.write_text(json.dumps(row) + "\n")
    for _ in range(2):
        ingest_new_files(w, "claude", str(tmp_path / "logs"), str(tmp_path / "cp")).awaitTermination()
        assert w.read("claude_usage_events").count() == 1
