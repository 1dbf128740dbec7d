"""Warehouse tables: columns, keys, and what a key conflict does (SNK-01)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Table:
    """A warehouse table. on_conflict: "ignore" keeps the stored row, "update" replaces it.

    "latest": rows are only added, and of one key the row of the last `ingested_at` counts.
    """

    ddl: str
    key: tuple[str, ...]
    on_conflict: str = "ignore"
    keep: tuple[str, ...] = ()

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)


_FILES = Table("session_file_path string, file_size_bytes long, file_mtime timestamp, ingested_at timestamp", ("session_file_path",), "latest")

TABLES: dict[str, Table] = {
    "claude_session_metadata": Table("session_id string, project_name string, slug string, cwd string, version string, session_file_path string, ingested_at timestamp", ("session_id",), "update"),
    "claude_usage_events": Table(
        "session_id string, message_id string, request_id string, event_timestamp timestamp, event_line_number long, model_code string, is_sidechain boolean, agent_id string, "
        "input_tokens long, output_tokens long, cache_creation_input_tokens long, cache_read_input_tokens long, ingested_at timestamp",
        ("session_id", "message_id", "request_id"),
    ),
    "claude_ingestion_files": _FILES,
    "codex_session_metadata": Table("session_id string, session_timestamp timestamp, cwd string, session_file_path string, ingested_at timestamp", ("session_id",), "update"),
    "codex_session_details": Table(
        "session_id string, event_timestamp timestamp, event_line_number long, model_code string, turn_id string, total_tokens_cumulative long, "
        "input_tokens long, cached_input_tokens long, output_tokens long, reasoning_output_tokens long, total_tokens long, ingested_at timestamp",
        ("session_id", "total_tokens_cumulative"),
    ),
    "codex_ingestion_files": _FILES,
    "opencode_sessions": Table(
        "session_id string, project_id string, project_worktree string, session_title string, session_directory string, session_version string, ingested_at timestamp, updated_at timestamp",
        ("session_id",), "update", ("ingested_at",),
    ),
    "opencode_message_usage": Table(
        "message_id string, session_id string, project_id string, message_created_at timestamp, message_completed_at timestamp, provider_code string, model_code string, agent string, mode string, finish_reason string, "
        "input_tokens long, output_tokens long, reasoning_tokens long, cache_read_tokens long, cache_write_tokens long, total_tokens long, cost_usd double, source_time_updated_ms long, ingested_at timestamp",
        ("message_id",), "update",
    ),
    "pi_session_metadata": Table("session_id string, session_version int, cwd string, session_started_at timestamp, session_file_path string, ingested_at timestamp", ("session_id",), "update"),
    "pi_usage_events": Table(
        "session_id string, message_id string, parent_id string, event_timestamp timestamp, event_line_number long, provider_code string, model_code string, stop_reason string, "
        "input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, total_tokens long, pi_reported_cost_input_usd double, pi_reported_cost_output_usd double, "
        "pi_reported_cost_cache_read_usd double, pi_reported_cost_cache_write_usd double, pi_reported_cost_total_usd double, ingested_at timestamp",
        ("session_id", "message_id"),
    ),
    "pi_ingestion_files": _FILES,
    "gemini_ingestion_sources": Table(
        "project_id string, jsonl_file_path string, active boolean, file_size_bytes long, file_mtime timestamp, last_ingested_event_timestamp timestamp, last_ingested_model_code string, created_at timestamp, updated_at timestamp",
        ("project_id",), "update", ("created_at",),
    ),
    "gemini_usage_events": Table(
        "project_id string, event_timestamp timestamp, model_code string, input_tokens long, cached_input_tokens long, output_tokens long, thoughts_tokens long, total_tokens long, ingested_at timestamp",
        ("project_id", "event_timestamp", "model_code"),
    ),
    "ingest_runs": Table("agent string, run_at timestamp, counter string, value long", ("agent", "run_at", "counter")),
}
