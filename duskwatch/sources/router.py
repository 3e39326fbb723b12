"""Which format a file has, by a vote over its first lines, and the way of each file's lines to its normaliser.

A format is a name, a test of a file's head and a function from lines to events. Formats are asked in order and the first
that fits owns the file; a caller's own come first. Lines are written once, in one folder for each format, so that each
normaliser reads its own lines only and all lines are read once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..adapters import SEC, security_events
from ..store import stored
from . import headers, jsonlines, normalize
from .io import conform

HEAD_LINES, HEAD_CHARS = 20, 4096
#: Files whose formats are sent to all tasks; with more, they are joined by parts of files.
BROADCAST_FILES, PARTS = 1 << 18, 16

Lines = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Format:
    """``fits`` tests a head (name, ending, lines, first, text, magic); ``events`` takes (file, line_no, value), where it is there."""

    name: str
    fits: Callable[[], Column]
    events: Lines | None = None


def heads(lines: DataFrame) -> DataFrame:
    """(file, name, ending, lines, first, text, magic): what a file's first lines say, one row for each file."""
    own = lines.where(F.col("line_no") <= HEAD_LINES).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("line_no", "value"))).alias("l"))
    rows = F.transform("l", lambda x: F.btrim(x["value"]))
    name = F.lower(F.element_at(F.split("file", "/"), -1))
    magic = F.hex(F.substring(F.element_at("l", 1)["value"].cast("binary"), 1, 16))
    return own.select("file", name.alias("name"), F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("ending"), rows.alias("lines"), F.element_at(rows, 1).alias("first"), F.substring(F.concat_ws("\n", rows), 1, HEAD_CHARS).alias("text"), magic.alias("magic"))


def _any(pattern: str, n: int = HEAD_LINES) -> Column:
    return F.exists(F.slice("lines", 1, n), lambda x: x.rlike(pattern))


def _words(*words: str, least: int = 1, low: bool = False) -> Column:
    """Whether the head holds at least so many of the words."""
    text = F.lower("text") if low else F.col("text")
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: text.contains(w))) >= least


def _named(*parts: str) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.col("name").contains(p))


def _ending(*endings: str) -> Column:
    return F.col("ending").isin(*endings)


def _magic(*marks: str) -> Column:
    return F.exists(F.array(*map(F.lit, marks)), lambda m: F.col("magic").startswith(m))


def _key(*paths: str) -> Column:
    """Whether one of the JSON paths is there in the first line."""
    return F.coalesce(*[F.get_json_object("first", p) for p in paths]).isNotNull()


def by_line(norm: Lines) -> Lines:
    """A normaliser over (row_id, value) as one over lines: the row's id carries the line through it."""

    def run(lines: DataFrame) -> DataFrame:
        rows = lines.select(F.struct("file", "line_no", "value").alias("row_id"), "value")
        return norm(rows).select("*", F.col("row_id.file").alias("source_file"), F.col("row_id.line_no").alias("source_line"), F.col("row_id.value").alias("raw_payload"))

    return run


def cloud(kind: str) -> Lines:
    """Audit records of a cloud: a line is a record, a list of records, or an object that holds one under Records or value."""

    def run(rows: DataFrame) -> DataFrame:
        whole = F.try_parse_json("value")
        inside = F.coalesce(*[F.try_variant_get(whole, p, "array<variant>") for p in ("$.Records", "$.value", "$")], F.array(whole))
        return normalize.norm_cloud(rows.select("row_id", F.explode(F.transform(inside, lambda x: F.to_json(x))).alias("value")), *normalize.CLOUD[kind])

    return by_line(run)


# Names of columns in tables of events, by what they hold.
CSV_NAMES = {
    "timestamp_utc": ["timestamp", "time", "date", "datetime", "timecreated", "ts"], "source_ip": ["source_ip", "src_ip", "client_ip", "ip"], "dest_ip": ["dest_ip", "dst_ip", "destination_ip"],
    "username": ["username", "user", "account"], "process_name": ["process_name", "process", "image"], "event_type": ["event_type", "type", "event"],
}


def norm_csv_lines(lines: DataFrame) -> DataFrame:
    """Lines under the first line's names, with quoted cells; the first name of a list that the file has counts."""
    cells = lambda c: F.transform(F.split(c, ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1), lambda x: F.replace(F.regexp_replace(F.btrim(x), '^"|"$', ""), F.lit('""'), F.lit('"')))
    rows = headers.with_headers(lines, {"head": F.when(F.col("line_no") == 1, F.col("value"))}).where((F.col("line_no") > 1) & F.col("head").isNotNull() & (F.btrim("value") != ""))
    rows = rows.withColumns({"fields": F.transform(cells(F.col("head")), F.lower), "cells": cells(F.col("value"))})
    picked = {k: F.coalesce(*[F.nullif(headers.cell(n), F.lit("")) for n in names]) for k, names in CSV_NAMES.items()}
    picked["timestamp_utc"] = normalize.S.timestamp_of(picked["timestamp_utc"])
    return rows.select(F.col("file").alias("source_file"), F.col("line_no").alias("source_line"), F.col("value").alias("raw_payload"), *[c.alias(k) for k, c in picked.items()])


# What tells the formats apart.
FORMATS = [
    Format("evtx", lambda: _ending(".evtx") & _magic("456C6646696C65")),
    Format("pcap", lambda: _ending(".pcap", ".pcapng", ".cap") & (_magic("D4C3B2A1", "A1B2C3D4") | (F.col("first") == ""))),
    Format("registry", lambda: F.col("name").isin("sam", "security", "software", "system", "ntuser.dat", "usrclass.dat") | _magic("72656766")),
    Format("prefetch", lambda: _ending(".pf") & _magic("4D414D", "53434341")),
    Format("memory", lambda: _ending(".dmp", ".raw", ".vmem", ".mem", ".img")),
    Format("pe", lambda: _ending(".exe", ".dll", ".sys", ".scr") & _magic("4D5A")),
    Format("browser", lambda: F.col("name").isin("history", "places.sqlite", "history.db", "webdata") | (_ending(".sqlite", ".db") & _magic("53514C69746520666F726D61742033")) | (_ending(".csv", ".json") & _words("url", "visit_time", "visit_count", "http", "https", least=3, low=True))),
    Format("excel", lambda: _ending(".xlsx", ".xls")),
    Format("shimcache", lambda: _named("shimcache", "amcache", "appcompat") | _words("Last Modified", "LastModified", "Executed", "AppCompatCache", "AmcacheInventoryApplication", "InventoryApplicationFile", "ShimCache", least=2)),
    Format("defender", lambda: _named("defender", "mplog", "malware") | _words("Windows Defender", "Microsoft Defender", "MpCmdRun", "ThreatID", "MALWAREPROTECTION")),
    Format("suricata", lambda: _key("$.event_type") & _key("$.src_ip", "$.dest_ip", "$.flow_id", "$.alert"), by_line(normalize.norm_suricata)),
    Format("paloalto", lambda: F.exists(F.slice("lines", 1, 10), lambda x: F.upper(x).rlike("TRAFFIC|THREAT|SYSTEM|CONFIG|GLOBALPROTECT") & (F.size(F.split(x, ",")) > 20)), by_line(normalize.norm_paloalto)),
    Format("cisco_asa", lambda: _words("%ASA-"), by_line(normalize.norm_asa)),
    Format("windows_firewall", lambda: _named("firewall") | _words("#Software: Microsoft Windows Firewall") | (_words("#Fields:") & _words("action", low=True) & ~_words("Microsoft Internet Information Services", "cs-uri-stem", "sc-status", "cs-method")), headers.norm_winfw),
    Format("iis", lambda: _ending(".log") & _any("^#Software: Microsoft Internet Information Services|^#Fields:.*(s-ip|cs-uri-stem|sc-status)"), headers.norm_iis),
    Format("nginx", lambda: _ending(".log") & _named("nginx") & _any(r'^\S+\s+-\s+\S+\s+\[[^\]]+\]\s+"\S+\s+\S+\s+[^"]+"\s+\d+\s+\S+', 10), by_line(normalize.norm_access)),
    Format("apache", lambda: _ending(".log") & _any(r'^\S+\s+\S+\s+\S+\s+\[[^\]]+\]\s+"\S+\s+\S+\s+[^"]+"\s+\d+\s+\S+', 10), by_line(normalize.norm_access)),
    Format("haproxy", lambda: _words("haproxy", low=True) | _any(r"\S+/\S+\s+\d+/\d+/\d+/\d+/\d+\s+\d{3}"), by_line(normalize.norm_haproxy)),
    Format("squid", lambda: _any(r'^\d+\.\d+\s+\d+\s+\S+\s+\S+\s+\d+\s+\S+\s+\S+|^\S+\s+\S+\s+\S+\s+\[[^\]]+\]\s+"\S+\s+\S+\s+[^"]+"\s+\d+\s+\d+', 10), by_line(normalize.norm_squid)),
    Format("zeek", lambda: F.get(F.filter("lines", lambda x: x.startswith("#separator") | x.startswith("#fields") | ~x.startswith("#")), F.lit(0)).rlike("^#(separator|fields)"), headers.norm_zeek),
    Format("syslog", lambda: F.col("name").isin("syslog", "auth.log", "secure", "messages", "daemon.log", "kern.log", "cron.log", "maillog", "auth", "authlog") | _any(r"^\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+\S+?(?:\[\d+\])?:\s+|^<\d+>\d*\s*\S+\s+\S+\s+\S+\s+\S+\s+\S+\s+", 10), by_line(lambda x: normalize.norm_syslog(x, 2024))),
    Format("cloudtrail", lambda: _ending(".json") & _key("$.Records[0].eventSource") & _key("$.Records[0].eventName"), cloud("norm_cloudtrail")),
    Format("azure_ad", lambda: _ending(".json") & _key(*[f"{p}.{k}" for p in ("$[0]", "$.value[0]") for k in ("activityDisplayName", "operationType", "category")]), cloud("norm_azure_ad")),
    Format("gcp", lambda: _key("$.protoPayload", "$.logName", "$.resource.type"), cloud("norm_gcp")),
    Format("o365", lambda: _words("Workload", "RecordType", "UserType", "AzureActiveDirectory", "Exchange", "SharePoint", "Operation") & F.try_parse_json("first").isNotNull(), cloud("norm_o365")),
    Format("okta", lambda: _words("eventType", "actor", "client", "authenticationContext", "displayMessage", "outcome", "target", "transaction", "uuid", least=4), cloud("norm_okta")),
    Format("vpcflow", lambda: F.col("first").startswith("version account-id") | F.col("first").rlike(r"^[2-5](\s+\S+){13,}") | _key("$.srcaddr", "$.dstaddr", "$.srcport"), by_line(normalize.norm_vpcflow)),
    Format("jsonl", lambda: _ending(".jsonl", ".ndjson") | (_ending(".json") & F.try_parse_json("first").isNotNull() & F.try_parse_json(F.get("lines", F.lit(1))).isNotNull()), by_line(jsonlines.norm_jsonl)),
    Format("csv", lambda: _ending(".csv") & F.col("first").contains(","), norm_csv_lines),
]


def detect_format(lines: DataFrame, formats: list[Format]) -> DataFrame:
    """(file, format) of each file: the first format that fits its head, or ``unknown``."""
    out = F.lit("unknown")
    for f in reversed(formats):
        out = F.when(F.coalesce(f.fits(), F.lit(False)), f.name).otherwise(out)
    return heads(lines).select("file", out.alias("format"))


def tagged(lines: DataFrame, own: list[Format]) -> DataFrame:
    """``lines`` with their file's format, written in one folder for each. No file is one task: with few files their
    formats are broadcast, with many a file's lines are dealt to parts."""
    lines = stored(lines)
    found = stored(detect_format(lines, [*own, *FORMATS]))
    if found.count() <= BROADCAST_FILES:
        return stored(lines.join(F.broadcast(found), "file", "left").fillna("unknown", ["format"]), by="format")
    parts = found.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return stored(lines.withColumn("_part", F.pmod("line_no", F.lit(PARTS)).cast("int")).join(parts, ["file", "_part"], "left").drop("_part").fillna("unknown", ["format"]), by="format")


def routed(lines: DataFrame, own: list[Format] | None = None) -> tuple[DataFrame, DataFrame]:
    """Events of all files (the event schema, with the format as parser_name) and the lines that gave none.

    ``own`` are a caller's formats, asked before the built-in ones. A file's head decides for all its lines. Rejects are (file,
    line_no, format, value, reason); blank lines and comments of headed formats are no rejects.
    """
    own = own or []
    by_name = {f.name: f for f in [*FORMATS, *own]}
    rows = tagged(lines, own)
    present = [r.format for r in rows.select("format").distinct().collect()]  # one for each known format at most
    events, taken = [], []
    for name in sorted(present):
        if name in by_name and by_name[name].events:
            out = by_name[name].events(rows.where(F.col("format") == name).select("file", "line_no", "value"))
            kind = F.coalesce("event_type", F.lit(name)) if "event_type" in out.columns else F.lit(name)
            events.append(conform(out.withColumns({"event_type": kind, "parser_name": F.lit(name)})))
            taken.append(name)
    empty = conform(rows.limit(0).select(F.lit("").alias("event_type")))
    found = empty
    for e in events:
        found = found.unionByName(e)
    used = found.select(F.col("source_file").alias("file"), F.col("source_line").alias("line_no"), F.col("parser_name").alias("format"))
    silent = (F.btrim("value") == "") | (F.col("format").isin("iis", "windows_firewall", "zeek") & F.col("value").startswith("#")) | ((F.col("format") == "csv") & (F.col("line_no") == 1))
    reason = F.when(F.col("format") == "unknown", "unknown format").when(F.col("format").isin(taken), "no match").otherwise("no normaliser")
    rejects = rows.where(~silent).join(used, ["file", "line_no", "format"], "left_anti").select("file", "line_no", "format", "value", reason.alias("reason"))
    return found, rejects


# One line for each format that tells it, for the test events.
_COMBINED = '1.2.3.4 - bob [01/Jan/2024:00:00:00 +0000] "GET / HTTP/1.1" 200 5'
SAMPLES = [
    ("evtx", "a.evtx", "ElfFile"), ("registry", "hive", "regf"), ("prefetch", "a.pf", "MAM"), ("memory", "a.vmem", "x"), ("pe", "a.dll", "MZ"), ("browser", "h.csv", "url,visit_time,visit_count"), ("excel", "a.xlsx", "PK"),
    ("shimcache", "x.csv", "Path,LastModified,Executed"), ("defender", "y.txt", "Windows Defender"), ("suricata", "eve.json", '{"event_type":"alert","src_ip":"1.2.3.4"}'), ("paloalto", "pa.txt", "1,2,THREAT" + ",x" * 20), ("cisco_asa", "c.txt", "%ASA-4-106023: Deny"),
    ("windows_firewall", "pf.txt", "#Fields: date time action"), ("iis", "w.log", "#Fields: date cs-uri-stem"), ("nginx", "nginx.log", _COMBINED), ("apache", "acc.log", _COMBINED), ("haproxy", "lb.txt", "be/s1 0/0/1/2/3 200 9"), ("squid", "sq.txt", "1704067200.123 12 1.2.3.4 TCP_MISS/200 99 GET http://x/ -"),
    ("zeek", "conn.txt", "#separator \\x09"), ("syslog", "m.txt", "Jan  1 00:00:00 web sshd[1]: hello"), ("cloudtrail", "t.json", '{"Records":[{"eventSource":"s","eventName":"n"}]}'), ("azure_ad", "az.json", '[{"activityDisplayName":"x"}]'), ("gcp", "g.json", '{"logName":"x"}'),
    ("o365", "o.json", '{"Workload":"x"}'), ("okta", "ok.json", '{"eventType":1,"actor":1,"client":1,"outcome":1}'), ("vpcflow", "v.txt", "2 a e 1.2.3.4 5.6.7.8 1 2 6 1 1 1 2 ACCEPT OK"), ("jsonl", "j.jsonl", '{"a":1}'), ("csv", "z.csv", "a,b"), ("unknown", "n.txt", "nothing known"), ("pcap", "p.pcap", ""),
]


def sample_lines(ev: DataFrame) -> DataFrame:
    """Five files of each format; the lines after the first say nothing of it."""
    at = (F.col("row_id") % len(SAMPLES) + 1).cast("int")
    name = F.element_at(F.array(*[F.lit(n) for _, n, _ in SAMPLES]), at)
    text = F.element_at(F.array(*[F.lit(v) for _, _, v in SAMPLES]), at)
    rows = ev.select(F.concat(F.lit("/case/"), (F.col("user_id") % 5).cast("string"), F.lit("/"), name).alias("file"), "row_id", text.alias("first"))
    first = rows.groupBy("file").agg(F.first("first").alias("value")).select("file", F.lit(1).cast("long").alias("line_no"), "value")
    return first.unionByName(rows.select("file", (F.col("row_id") + 2).alias("line_no"), F.col("first").alias("value")))


#: A format of the caller's own: parts between bars.
OWN = Format("bars", lambda: _any(r"^OWN\|"), by_line(lambda x: normalize.parts(x, r"^OWN\|([^|]*)\|([^|]*)\|(.*)$", ["t", "source_ip", "description"]).select("row_id", normalize.S.timestamp_of(F.col("t")).alias("timestamp_utc"), "source_ip", "description", F.lit("Bars").alias("event_type"))))


#: Events of the eight files that are made together.
PER_FILE = 4000


def mixed_lines(ev: DataFrame) -> DataFrame:
    """A folder of seven formats with junk among the lines of two, and one file that nobody knows."""
    clock = F.date_format("timestamp_utc", "yyyy-MM-dd'T'HH:mm:ss")
    record = lambda who: F.struct(F.lit("iam").alias("eventSource"), F.lit(who).alias("eventName"), clock.alias("eventTime"), F.col("source_ip").alias("sourceIPAddress"))
    kinds = [
        ("access%d.log", normalize.LINES["access"]()), ("fw%d.txt", normalize.LINES["asa"]()), ("flow%d.txt", normalize.LINES["vpcflow"]()), ("eve%d.json", normalize.LINES["suricata"]()), ("trail%d.json", F.to_json(F.struct(F.array(record("CreateUser"), record("Read")).alias("Records")))),
        ("own%d.dat", F.concat_ws("|", F.lit("OWN"), clock, "source_ip", "command_line")), ("WEB0%d_u_ex.log", F.concat_ws(" ", F.date_format("timestamp_utc", "yyyy-MM-dd HH:mm:ss"), "source_ip", "http_method", "uri")), ("notes%d.txt", F.concat(F.lit("note "), "username")),
    ]
    which = F.col("row_id") % len(kinds)
    pick = lambda values: F.coalesce(*[F.when(which == i, v) for i, v in enumerate(values)])
    file = F.concat(F.lit("/case/"), pick([F.format_string(n, F.floor(F.col("row_id") / PER_FILE)) for n, _ in kinds]))
    value = F.when((which < 2) & (F.col("k") % 10 == 0), F.concat(F.lit("junk "), "username")).otherwise(pick([v for _, v in kinds]))
    rows = ev.select(file.alias("file"), (F.floor(F.col("row_id") % PER_FILE / len(kinds)) + 2).alias("line_no"), value.alias("value"))
    heads_ = rows.where(F.col("file").contains("u_ex")).select("file").distinct().select("file", F.lit(1).cast("long").alias("line_no"), F.lit("#Fields: date time c-ip cs-method cs-uri-stem").alias("value"))
    return rows.unionByName(heads_)


_EV = "source_line, timestamp_utc, event_type, source_ip, severity, parser_name"
_LINE = f"row_id // {PER_FILE}", f"row_id % {PER_FILE} // 8 + 2"
_FILE = f"'/case/{{}}' || {_LINE[0]} || '{{}}' AS source_file, {_LINE[1]} AS source_line, date_trunc('second', timestamp_utc) AS timestamp_utc"
_HIGH = "uri = '/a/../../etc/passwd'"
_STATUS = "CASE WHEN status_code >= 500 THEN 'medium' WHEN status_code >= 400 THEN 'low' ELSE 'info' END"
_WAY = [
    (0, ("access", ".log"), "'apache'", _STATUS, "apache", "AND k % 10 <> 0"),
    (1, ("fw", ".txt"), "CASE WHEN k % 3 = 0 THEN 'ASA_106023' ELSE 'ASA_302013' END", normalize.ASA_LEVEL, "cisco_asa", "AND k % 10 <> 0"),
    (2, ("flow", ".txt"), normalize.FLOW_TYPE, normalize.FLOW_LEVEL, "vpcflow", ""),
    (3, ("eve", ".json"), "'Suricata_alert'", "CASE k % 5 WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END", "suricata", ""),
    (4, ("trail", ".json"), "'CloudTrail_CreateUser'", "'high'", "cloudtrail", ""),
    (4, ("trail", ".json"), "'CloudTrail_Read'", "'info'", "cloudtrail", ""),
    (5, ("own", ".dat"), "'Bars'", "CAST(NULL AS VARCHAR)", "bars", ""),
    (6, ("WEB0", "_u_ex.log"), "'IIS'", f"CASE WHEN {_HIGH} THEN 'high' ELSE 'info' END", "iis", ""),
]
_NO_TIME = {1: "CAST(NULL AS TIMESTAMP)"}


def _way(i, file, kind, severity, parser, more) -> str:
    head = _FILE.format(*file)
    if i in _NO_TIME:
        head = head.replace("date_trunc('second', timestamp_utc) AS", f"{_NO_TIME[i]} AS")
    return f"SELECT {head}, {kind} AS event_type, source_ip, {severity} AS severity, '{parser}' AS parser_name FROM sec WHERE row_id % 8 = {i} {more}"


QUERIES = {
    "detect_format": lambda s, d: detect_format(sample_lines(security_events(s, d)), FORMATS),
    "normaliser_registry": lambda s, d: routed(mixed_lines(security_events(s, d)), [OWN])[0].select("source_file", "source_line", "timestamp_utc", "event_type", "source_ip", "severity", "parser_name"),
    "normaliser_rejects": lambda s, d: routed(mixed_lines(security_events(s, d)), [OWN])[1].select("file", "line_no", "format", "reason"),
}
ORACLES = {
    "detect_format": f"WITH t(i, format, name) AS (VALUES {', '.join(f'({i}, {f!r}, {n!r})' for i, (f, n, _) in enumerate(SAMPLES))}) SELECT DISTINCT '/case/' || user_id % 5 || '/' || name AS file, format FROM events JOIN t ON event_id % {len(SAMPLES)} = i",
    "normaliser_registry": f"WITH {SEC} " + " UNION ALL ".join(_way(*w) for w in _WAY),
    "normaliser_rejects": f"WITH {SEC} SELECT '/case/' || CASE row_id % 8 WHEN 0 THEN 'access' || {_LINE[0]} || '.log' ELSE 'fw' || {_LINE[0]} || '.txt' END AS file, {_LINE[1]} AS line_no, CASE row_id % 8 WHEN 0 THEN 'apache' ELSE 'cisco_asa' END AS format, 'no match' AS reason FROM sec WHERE row_id % 8 < 2 AND k % 10 = 0 "
    f"UNION ALL SELECT '/case/notes' || {_LINE[0]} || '.txt', {_LINE[1]}, 'unknown', 'unknown format' FROM sec WHERE row_id % 8 = 7",
}
