"""Queries of the column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..adapters import SEC, security_events, table
from . import scalars as S


def _ev(f):
    return lambda spark, d: f(security_events(spark, d))


def _docs(f):
    return lambda spark, d: f(table(spark, d, "documents"))


def _in(values):
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


_ENT = "coalesce(list_sum(list_transform(list_distinct(string_split({0}, '')), lambda c: -(len(list_filter(string_split({0}, ''), lambda x: x = c)) / length({0})::DOUBLE) * log2(len(list_filter(string_split({0}, ''), lambda x: x = c)) / length({0})::DOUBLE))), 0)"
_TS = "strftime(timestamp_utc, '{}')"
_TS_FORMATS = [("%Y-%m-%dT%H:%M:%S", "yyyy-MM-dd'T'HH:mm:ss"), ("%Y/%m/%d %H:%M:%S", "yyyy/MM/dd HH:mm:ss"), ("%d/%b/%Y:%H:%M:%S +0000", "dd/MMM/yyyy:HH:mm:ss '+0000'")]


def _written(ev):
    """The event's time written in one of five ways, by row."""
    micros = F.unix_micros("timestamp_utc")
    ways = [F.date_format("timestamp_utc", f) for _, f in _TS_FORMATS] + [F.floor(micros / 1000000).cast("string"), ((F.floor(micros / 1000000) * 1000000) * 10 + F.lit(116444736000000000)).cast("string")]
    k = F.col("row_id") % 5
    return ev.withColumn("text", F.when(k == 0, ways[0]).when(k == 1, ways[1]).when(k == 2, ways[2]).when(k == 3, ways[3]).otherwise(ways[4]))


QUERIES = {
    "ip_class": _ev(lambda ev: ev.select("row_id", S.ip_class(F.col("dest_ip")).alias("dest_class"), S.ip_class(F.col("source_ip")).alias("source_class"))),
    "user_class": _ev(lambda ev: ev.select("row_id", S.user_class(F.concat(F.element_at(F.array(*map(F.lit, ["svc_", "CORP\\", "adm_admin", "HOST$", ""])), (F.col("row_id") % 5 + 1).cast("int")), F.when(F.col("row_id") % 5 == 3, "$").otherwise(F.col("username")))).alias("user_class"))),
    "proc_class": _ev(lambda ev: ev.select("row_id", S.proc_class(F.concat(F.lit("C:\\Windows\\System32\\"), F.upper("process_name"))).alias("process_class"))),
    "entity_tag": _ev(lambda ev: ev.select("row_id", S.ip_class(F.col("source_ip")).alias("source_ip_class"), S.ip_class(F.col("dest_ip")).alias("dest_ip_class"), S.user_class(F.col("username")).alias("username_class"), S.proc_class(F.col("process_name")).alias("process_class"), S.proc_class(F.col("parent_process_name")).alias("parent_process_class"))),
    "exe_basename": _ev(lambda ev: ev.select("row_id", S.exe_basename(F.col("file_path")).alias("name"))),
    "logon_type_name": _ev(lambda ev: ev.select("row_id", S.logon_type_name(F.col("logon_type")).alias("name"))),
    "event_summary": _ev(lambda ev: ev.select("row_id", S.event_summary(F.when(F.col("row_id") % 3 == 0, F.col("uri")), F.col("http_method"), F.when(F.col("row_id") % 4 != 1, F.col("process_name")), F.when(F.col("row_id") % 2 == 0, F.col("command_line")), F.col("event_type")).alias("summary"))),
    "hour_bucket": _ev(lambda ev: ev.select("row_id", F.date_format(F.date_trunc("hour", "timestamp_utc"), "yyyy-MM-dd HH:00").alias("hour"))),
    "shannon_entropy": _docs(lambda d: d.select("doc_id", F.round(S.entropy(F.col("text")), 6).alias("entropy"))),
    "norm_entropy": _ev(lambda ev: ev.select("row_id", F.round(S.norm_entropy(F.col("service_name")), 6).alias("entropy"))),
    "payload_format": _ev(lambda ev: ev.select("row_id", S.payload_format(F.element_at(F.array(F.lit('{"a": 1}'), F.concat(F.lit("user: "), F.col("username"), F.lit("\nx: 1")), F.concat(F.lit("a=1|b="), F.col("username")), F.col("command_line")), (F.col("row_id") % 4 + 1).cast("int"))).alias("format"))),
    "kv_parse": _ev(lambda ev: ev.withColumn("m", S.kv_parse(F.concat(F.lit("User = "), F.col("username"), F.lit("|ip="), F.col("source_ip"), F.lit("|junk|url=a=b")), r"\|", "=")).select("row_id", F.col("m")["User"].alias("user"), F.col("m")["ip"].alias("ip"), F.col("m")["url"].alias("url"), F.size("m").cast("long").alias("n"))),
    "ts_normalize": _ev(lambda ev: _written(ev).select("row_id", F.floor(F.unix_micros(S.timestamp_of(F.col("text"))) / 1000000).alias("seconds"))),
    "sev_http_status": _ev(lambda ev: ev.select("row_id", S.severity_of_status(F.col("status_code"), F.col("uri")).alias("severity"))),
    "severity_sort": _ev(lambda ev: ev.select("row_id", "severity", S.severity_rank(F.col("severity")).cast("long").alias("rank")).orderBy("rank", "row_id")),
    "url_host": lambda s, d: table(s, d, "pages").select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host")),
    "risk_score": _ev(lambda ev: ev.select("row_id", S.risk_score(F.col("k") % 9, F.col("k") % 3, F.col("k")).cast("long").alias("score"))),
    "host_from_file": _ev(lambda ev: ev.select("row_id", F.upper(F.regexp_extract(F.concat("source_system", F.lit("_Security_"), "source_file"), "^([A-Za-z0-9-]+)_", 1)).alias("host"))),
    "canonical_coalesce": _ev(lambda ev: ev.select("row_id", F.coalesce(F.when(F.col("row_id") % 3 == 0, F.col("command_line")), F.when(F.col("row_id") % 3 == 1, F.col("process_name")), F.col("service_name")).alias("command"))),
    "col_normalize": lambda s, d: table(s, d, "events").select(F.col("event_id").alias("raw_event_id"), F.col("ts").cast("timestamp").alias("timestamp_utc"), F.col("user_id").cast("string").alias("username"), F.coalesce(F.get_json_object("props", "$.none").try_cast("bigint"), F.lit(0)).alias("event_id")),
}

_IPC = "CASE WHEN {0} LIKE '127.%' THEN 'LOOPBACK' WHEN {0} LIKE '169.254.%' THEN 'LINK_LOCAL' WHEN {0} LIKE '10.%' OR {0} LIKE '192.168.%' OR regexp_matches({0}, '^172\\.(1[6-9]|2[0-9]|3[01])\\.') THEN 'INTERNAL' ELSE 'EXTERNAL' END"
_PC = "CASE WHEN {0} IN " + _in(rules.SYSTEM_PROCESSES) + " THEN 'SYSTEM_PROCESS' WHEN {0} IN " + _in(rules.WINDOWS_TOOLS) + " THEN 'WINDOWS_TOOL' WHEN {0} IN " + _in(rules.ATTACK_TOOLS) + " THEN 'KNOWN_ATTACK_TOOL' WHEN {0} IN " + _in(rules.WEB_SERVERS) + " THEN 'WEB_SERVER' ELSE 'UNKNOWN' END"

ORACLES = {
    "ip_class": f"WITH {SEC} SELECT row_id, {_IPC.format('dest_ip')} AS dest_class, {_IPC.format('source_ip')} AS source_class FROM sec",
    "user_class": f"WITH {SEC} SELECT row_id, CASE row_id % 5 WHEN 0 THEN 'SERVICE' WHEN 1 THEN 'USER' WHEN 2 THEN 'ADMIN' WHEN 3 THEN 'MACHINE' ELSE 'USER' END AS user_class FROM sec",
    "proc_class": f"WITH {SEC} SELECT row_id, {_PC.format('process_name')} AS process_class FROM sec",
    "entity_tag": f"WITH {SEC} SELECT row_id, {_IPC.format('source_ip')} AS source_ip_class, {_IPC.format('dest_ip')} AS dest_ip_class, 'USER' AS username_class, {_PC.format('process_name')} AS process_class, {_PC.format('parent_process_name')} AS parent_process_class FROM sec",
    "exe_basename": f"WITH {SEC} SELECT row_id, lower(regexp_extract(file_path, '[^\\\\/]*$', 0)) AS name FROM sec",
    "logon_type_name": f"WITH {SEC} SELECT row_id, CASE logon_type WHEN 3 THEN 'Network' WHEN 10 THEN 'RemoteInteractive' WHEN 2 THEN 'Interactive' ELSE 'Unknown(99)' END AS name FROM sec",
    "event_summary": f"WITH {SEC} SELECT row_id, CASE WHEN row_id % 3 = 0 THEN 'Web: ' || http_method || ' ' || uri WHEN row_id % 4 <> 1 AND row_id % 2 = 0 THEN 'Process: ' || process_name || ' | ' || left(command_line, 100) WHEN row_id % 4 <> 1 THEN 'Process: ' || process_name ELSE 'Event: ' || event_type END AS summary FROM sec",
    "hour_bucket": f"WITH {SEC} SELECT row_id, strftime(timestamp_utc, '%Y-%m-%d %H:00') AS hour FROM sec",
    "shannon_entropy": f"SELECT doc_id, round({_ENT.format('text')}, 6) AS entropy FROM documents",
    "norm_entropy": f"WITH {SEC} SELECT row_id, round(CASE WHEN len(list_distinct(string_split(service_name, ''))) <= 1 THEN 0 ELSE {_ENT.format('service_name')} / log2(len(list_distinct(string_split(service_name, '')))) END, 6) AS entropy FROM sec",
    "payload_format": f"WITH {SEC} SELECT row_id, CASE WHEN row_id % 4 = 0 THEN 'json' WHEN row_id % 4 = 1 THEN 'kv_newline' WHEN row_id % 4 = 2 THEN 'kv_pipe' WHEN command_line LIKE '%|%=%' THEN 'kv_pipe' ELSE 'raw' END AS format FROM sec",
    "kv_parse": f"WITH {SEC} SELECT row_id, username AS user, source_ip AS ip, 'a=b' AS url, CAST(3 AS BIGINT) AS n FROM sec",
    "ts_normalize": f"WITH {SEC} SELECT row_id, CAST(floor(epoch_us(timestamp_utc) / 1e6) AS BIGINT) AS seconds FROM sec",
    "sev_http_status": f"WITH {SEC} SELECT row_id, CASE WHEN regexp_matches(uri, '(?i)\\.\\./|cmd|shell|passwd|union|<script|exec') THEN 'high' WHEN status_code >= 500 THEN 'medium' WHEN status_code >= 400 THEN 'low' ELSE 'info' END AS severity FROM sec",
    "severity_sort": f"WITH {SEC} SELECT row_id, severity, CAST(CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END AS BIGINT) AS rank FROM sec ORDER BY rank, row_id",
    "url_host": "SELECT page_id, nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1), '') AS host FROM pages",
    "risk_score": f"WITH {SEC} SELECT row_id, CAST(least(100, CASE WHEN k % 9 > 5 THEN 50 WHEN k % 9 > 0 THEN 30 ELSE 0 END + CASE WHEN k % 3 > 0 THEN 10 ELSE 0 END + least(40, k // 2)) AS BIGINT) AS score FROM sec",
    "host_from_file": f"WITH {SEC} SELECT row_id, upper(source_system) AS host FROM sec",
    "canonical_coalesce": f"WITH {SEC} SELECT row_id, CASE row_id % 3 WHEN 0 THEN command_line WHEN 1 THEN process_name ELSE service_name END AS command FROM sec",
    "col_normalize": "SELECT event_id AS raw_event_id, ts AS timestamp_utc, CAST(user_id AS VARCHAR) AS username, CAST(0 AS BIGINT) AS event_id FROM events",
}
