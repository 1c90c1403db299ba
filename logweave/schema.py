"""Schemas of the persisted tables."""

from __future__ import annotations

RECORD = """
    file_path string, source_file string, file string, line_no bigint,
    log_type string, pattern string, timestamp string, event_ts timestamp_ntz, event_date date,
    level string, user string, component string, message string, pid string,
    fields map<string,string>, extracted map<string,array<string>>,
    event_type string, severity string, template_group_id bigint
"""

# Groups with a record column of their own; all others go to ``fields``.
CORE_GROUPS = ("timestamp", "level", "user", "component", "message", "pid")

REGISTRY = """
    rel_path string, last_processed timestamp, size_bytes bigint, records_count bigint,
    log_type string, unmatched_lines bigint, needs_reprocessing boolean
"""

CLUSTER_GROUP = """
    origin string, group_id bigint, representative_cluster_id string, representative_template string,
    event_type string, severity string,
    member_cluster_ids array<struct<cluster_id:string,template:string,size:bigint>>,
    num_members bigint, total_size bigint
"""
