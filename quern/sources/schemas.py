"""Schemas of the record files."""

RESULT = (
    "status string, succeeded boolean, project_root string, scanned_files double, "
    "changes array<struct<rule_id: string, description: string, location: struct<file: string, line: long, column: long, symbol: string>, before: string, after: string, risk: string, deterministic: boolean>>, "
    "issues array<struct<issue_type: string, message: string, location: struct<file: string, line: long, column: long, symbol: string>, risk: string, migration_rule: string, affected_files: array<string>>>, "
    "validations array<struct<command: array<string>, returncode: int, duration_seconds: double, stdout: string, stderr: string, timed_out: boolean, passed: boolean>>, "
    "metrics struct<deterministic_changes: double, semantic_changes: double, validation_passed: double, validation_runs: double, detected_migration_targets: double, automatically_cleared_targets: double, changed_files: double, "
    "automatic_clearance_percent: double, validation_pass_rate_percent: double, duration_seconds: double, agent_iterations: double, agent_input_tokens: double, agent_output_tokens: double, estimated_cost_usd: double>"
)
MESSAGE = "id string, from_agent string, to_agent string, content string, summary string, message_type string, timestamp double, read boolean, metadata string"
TASK = "id string, title string, status string, assignee string, blocks array<string>, blocked_by array<string>"
SESSION_META = "id string, title string, summary string, message_count long, created_at timestamp, last_active timestamp"
TURN = "role string, content string, tool_uses array<struct<tool_use_id: string, tool_name: string, arguments: string>>, tool_results array<struct<tool_use_id: string, content: string, is_error: boolean>>"
