"""The event table's schema: 36 columns, four of them always there."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names of the event table.
TIMES = ["timestamp_utc"]
LONGS = ["source_line", "source_port", "dest_port", "logon_type", "process_id", "parent_process_id", "status_code"]
REQUIRED = ["timestamp_utc", "source_file", "source_line", "event_type"]
COLUMNS = [
    "timestamp_utc", "source_file", "source_line", "event_type", "event_id", "severity", "source_system", "source_ip", "source_port", "dest_ip", "dest_port", "username", "domain", "logon_type",
    "process_name", "process_id", "parent_process_name", "parent_process_id", "command_line", "parent_command_line", "file_path", "file_hash", "http_method", "uri", "query_string", "status_code",
    "user_agent", "referrer", "service_name", "service_path", "registry_key", "registry_value", "raw_payload", "parser_name", "parse_warnings", "description",
]


def _kind(name: str) -> T.DataType:
    return T.TimestampType() if name in TIMES else T.LongType() if name in LONGS else T.StringType()


EVENT_SCHEMA = T.StructType([T.StructField(c, _kind(c), c not in REQUIRED) for c in COLUMNS])
