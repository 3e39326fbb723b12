"""Event columns from rows that other tools exported: Windows events, antivirus, execution cache, browser
history, change journal, memory and packet tools, scripts.

Each ``norm_*`` takes a table (row_id, value) of JSON, XML or text and gives event columns with the row's id.
Unreadable values give null columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..adapters import SEC, security_events
from ..functions import scalars as S

# Names of sensor events, classes of Windows events, antivirus events.
SENSOR_NAMES = {
    1: "ProcessCreate", 2: "FileCreateTime", 3: "NetworkConnect", 5: "ProcessTerminate", 6: "DriverLoad", 7: "ImageLoad", 8: "CreateRemoteThread", 9: "RawAccessRead", 10: "ProcessAccess",
    11: "FileCreate", 12: "RegistryCreate", 13: "RegistrySetValue", 14: "RegistryRename", 15: "FileCreateStreamHash", 17: "PipeCreate", 18: "PipeConnect", 22: "DNSQuery", 23: "FileDelete",
}
WINDOWS_KINDS = {
    ("Security", "Authentication"): [4624, 4625, 4634, 4647, 4648],
    ("Security", "Process"): [4688, 4689],
    ("System", "Service"): [7045, 7034, 7036, 4697],
    ("Security", "ScheduledTask"): [4698, 4699, 4700, 4701, 4702],
}
DEFENDER_EVENTS = {
    1000: ("Scan_Started", "info"), 1001: ("Scan_Completed", "info"), 1002: ("Scan_Cancelled", "low"), 1003: ("Scan_Paused", "info"), 1004: ("Scan_Resumed", "info"), 1005: ("Scan_Failed", "medium"),
    1006: ("Malware_Detected", "high"), 1007: ("Malware_Action_Taken", "high"), 1008: ("Malware_Action_Failed", "critical"), 1009: ("Restore_From_Quarantine", "medium"),
    1010: ("Malware_Not_Removed", "critical"), 1011: ("Quarantine_Item_Deleted", "low"), 1015: ("Behavior_Detected", "high"), 1116: ("Threat_Detected", "high"), 1117: ("Malware_Action_Taken", "high"),
    1118: ("Malware_Action_Failed", "critical"), 1119: ("Malware_Action_Critical_Failed", "critical"), 5000: ("RTP_Enabled", "info"), 5001: ("RTP_Disabled", "high"), 5004: ("RTP_Config_Changed", "medium"),
    5007: ("Exclusion_Changed", "medium"), 5008: ("Engine_Update_Failed", "medium"), 5010: ("Scan_Disabled", "high"), 5012: ("Virus_Scan_Disabled", "high"), 5013: ("Tamper_Protection", "high"),
}
CACHE_PATHS = [r"\\temp\\", r"\\tmp\\", r"\\users\\public\\", r"\\programdata\\", r"\\appdata\\local\\temp\\", r"\\downloads\\", r"\\recycle", "mimikatz", "procdump", "psexec", "cobalt", "beacon", "meterpreter"]
ODD_URLS = [r"pastebin\.", r"raw\.github", r"githubusercontent\.com/.*\.(exe|ps1|bat|vbs|dll)", r"bit\.ly", r"tinyurl\.com", "file://", r"\.onion", r"transfer\.sh", r"temp\.sh", r"wetransfer\.com", r"mega\.nz", r"sendspace\.com"]
#: Event column: keys of the payload, the first that is there counts.
PAYLOAD_KEYS = {
    "process_name": ["Image", "NewProcessName", "ProcessName"],
    "command_line": ["CommandLine", "ProcessCommandLine"],
    "parent_process_name": ["ParentImage", "ParentProcessName"],
    "username": ["TargetUserName", "SubjectUserName", "User"],
    "source_ip": ["SourceIp", "IpAddress", "SourceAddress"],
    "dest_ip": ["DestinationIp", "DestAddress"],
    "logon_type": ["LogonType"],
    "service_name": ["ServiceName"],
    "file_path": ["TargetFilename", "ObjectName"],
    "registry_key": ["TargetObject"],
    "process_id": ["NewProcessId", "ProcessId"],
    "parent_process_id": ["ParentProcessId"],
}


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: str = "info") -> Column:
    """The severity of the first (pattern, severity) that a text fits."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F  # F.when begins the chain
    for pattern, severity in rules:
        out = out.when(low.rlike(pattern), severity)
    return out.otherwise(otherwise)


def _lookup(maps: list[Column], keys: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(k)), F.lit("")) for k in keys for m in maps])


def _number(text: Column) -> Column:
    """Decimal, or hexadecimal behind 0x."""
    return F.when(text.rlike("(?i)^0x[0-9a-f]+$"), F.conv(F.substring(text, 3, 18), 16, 10)).otherwise(text).try_cast("bigint")


def payload_maps(value: Column) -> list[Column]:
    """Maps of a payload's fields: named data of EventData, its plain keys, and fields of the outer level."""
    data = F.from_json(value, "EventData struct<Data:array<struct<`@Name`:string,`#text`:string>>>")["EventData"]["Data"]
    named = F.map_from_entries(F.filter(F.transform(data, lambda d: F.struct(d["@Name"], d["#text"])), lambda d: d["@Name"].isNotNull()))
    return [named, F.from_json(F.get_json_object(value, "$.EventData"), "map<string,string>"), F.from_json(F.get_json_object(value, "$.UserData"), "map<string,string>"), F.from_json(value, "map<string,string>")]


def kv_pairs(value: Column) -> Column:
    """``Key: Value, Key: Value``, else ``K=V,K=V``, else the whole as ``_unparsed``."""
    text = F.trim(value)
    by = lambda sep, pattern: F.transform(F.split(text, pattern), lambda p: F.struct(F.trim(F.substring_index(p, sep, 1)).alias("k"), F.trim(F.substring(p, F.locate(sep, p) + 1, F.length(p))).alias("v")))
    colon = F.map_from_entries(by(":", r"\s*,\s*(?=[A-Za-z][A-Za-z0-9_]*\s*:)"))
    equal = F.map_from_entries(by("=", r",(?=[A-Z][A-Z0-9]*=)"))
    return F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9_]*\s*:\s*\S"), colon).when(text.rlike("^[^=]+=."), equal).when(text != "", F.create_map(F.lit("_unparsed"), text))


def route_payload(column: int, value: Column) -> Column:
    """(field, value) that a numbered payload column holds: a path, a number or pairs."""
    path = {3: "image_path", 4: "parent_image_path"}.get(column, f"PayloadData{column}_path")
    number = {1: "pid", 2: "ppid"}.get(column, f"PayloadData{column}_num")
    field = F.when(value.rlike(r"[\\/]"), path).when(value.rlike(r"^\d+$"), number).when(value.contains("="), "pairs")
    return F.when(field.isNotNull(), F.struct(field.alias("field"), value.alias("value")))


def windows_event_type(code: Column, channel: Column, provider: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in SENSOR_NAMES.items() for x in kv])
    sensor = F.lower(F.concat_ws(" ", channel, provider)).contains("sysmon")
    out = F.when(sensor & code.isNotNull(), F.concat(F.lit("Sysmon_"), code.cast("string"), F.lit("_"), F.coalesce(F.try_element_at(names, code.cast("int")), code.cast("string"))))
    for (log, kind), codes in WINDOWS_KINDS.items():
        out = out.when(code.isin(codes), F.concat(F.lit(f"{log}_"), code.cast("string"), F.lit(f"_{kind}")))
    return out.otherwise(F.coalesce(channel, F.lit("WindowsEvent")))


def _windows(df: DataFrame, code: Column, channel: Column, provider: Column, at: Column, host: Column, maps: list[Column]) -> DataFrame:
    """The maps become columns first: each payload is parsed once, however many fields are looked up in it."""
    df = df.select("row_id", code.alias("_code"), channel.alias("_channel"), provider.alias("_provider"), at.alias("_at"), host.alias("_host"), *[m.alias(f"_map{i}") for i, m in enumerate(maps)])
    own = [F.col(f"_map{i}") for i in range(len(maps))]
    fields = [(_number(_lookup(own, keys)) if name in ("process_id", "parent_process_id", "logon_type") else _lookup(own, keys)).alias(name) for name, keys in PAYLOAD_KEYS.items()]
    return df.select("row_id", S.timestamp_of(F.col("_at")).alias("timestamp_utc"), windows_event_type(F.col("_code"), F.col("_channel"), F.col("_provider")).alias("event_type"), F.col("_code").cast("string").alias("event_id"), F.col("_host").alias("source_system"), *fields)


def norm_winevent_rows(df: DataFrame) -> DataFrame:
    """Rows of a Windows-event export as JSON; its payload is JSON in a field, numbered columns add pairs."""
    own = df.withColumn("f", F.from_json("value", "map<string,string>"))
    at = lambda k: F.try_element_at("f", F.lit(k))
    maps = [*payload_maps(at("Payload")), *[kv_pairs(at(f"PayloadData{i}")) for i in range(1, 7)], F.col("f")]
    code = F.coalesce(at("EventId"), at("EventID")).try_cast("int")
    return _windows(own, code, F.coalesce(at("Channel"), at("LogName")), at("Provider"), at("TimeCreated"), at("Computer"), maps)


XML = "System struct<Provider:struct<_Name:string>,EventID:string,TimeCreated:struct<_SystemTime:string>,Computer:string,Channel:string>, EventData struct<Data:array<struct<_Name:string,_VALUE:string>>>"


def norm_winevent_xml(df: DataFrame) -> DataFrame:
    """Windows events as XML; leaves of UserData are named by the element above and their own."""
    own = df.withColumn("e", F.from_xml("value", XML))
    named = F.map_from_entries(F.filter(F.transform("e.EventData.Data", lambda d: F.struct(d["_Name"].alias("k"), d["_VALUE"].alias("v"))), lambda d: d["k"].isNotNull()))
    user = F.regexp_extract("value", r"(?s)<UserData>\s*<(\w+)[^>]*>(.*?)</UserData>", 2)
    leaves = F.regexp_extract_all(user, F.lit(r"<(\w+)>([^<>]*)</"), F.lit(1))
    plain = F.map_from_arrays(leaves, F.regexp_extract_all(user, F.lit(r"<(\w+)>([^<>]*)</"), F.lit(2)))
    return _windows(own, F.col("e.System.EventID").try_cast("int"), F.col("e.System.Channel"), F.col("e.System.Provider._Name"), F.col("e.System.TimeCreated._SystemTime"), F.col("e.System.Computer"), [named, plain])


def norm_defender(df: DataFrame) -> DataFrame:
    """Antivirus events as JSON with an event id, else log lines judged by their words."""
    spark = df.sparkSession
    known = F.broadcast(spark.createDataFrame([(c, n, s) for c, (n, s) in DEFENDER_EVENTS.items()], "code int, name string, known string"))
    own = df.withColumn("code", F.get_json_object("value", "$.EventID").try_cast("int")).join(known, "code", "left")
    words = first_match(F.col("value"), [("threat|malware|trojan|virus", "high"), ("warning|failed|error", "medium"), ("disabled", "high")])
    return own.select("row_id", F.when(F.col("name").isNotNull(), F.concat(F.lit("Defender_"), "name")).when(F.col("code").isNotNull(), F.concat(F.lit("Defender_Event_"), F.col("code").cast("string"))).otherwise("Defender_Log").alias("event_type"), F.when(F.col("code").isNotNull(), F.coalesce("known", F.lit("info"))).otherwise(words).alias("severity"), F.get_json_object("value", "$.Path").alias("file_path"))


def _json(*keys: str) -> Column:
    return F.coalesce(*[F.get_json_object("value", f"$['{k}']") for k in keys])


def norm_shimcache(df: DataFrame) -> DataFrame:
    """Execution-cache rows as JSON; suspicious places are high, what ran is low at least."""
    path = _json("Path", "path", "FilePath", "FullPath", "Name", "ApplicationName")
    at = _json("LastModified", "Last Modified", "ModifiedTime", "LastWriteTime")
    ran = F.lower(F.coalesce(_json("Executed", "executed"), F.lit(""))).isin("true", "yes", "1")
    severity = F.when(F.lower(path).rlike("|".join(CACHE_PATHS)), "high").when(ran, "low").otherwise("info")
    return df.where(path.isNotNull()).select("row_id", S.timestamp_of(at).alias("timestamp_utc"), F.lit("Shimcache").alias("event_type"), path.alias("file_path"), F.element_at(F.split(path, r"\\"), -1).alias("process_name"), severity.alias("severity"))


def norm_browser(df: DataFrame) -> DataFrame:
    """Browser history as JSON: microseconds since 1601 or since 1970, or a written time."""
    url, at = _json("url", "URL", "uri", "URI", "address", "link"), _json("visit_time", "timestamp", "time", "date", "last_visit")
    micros = at.try_cast("bigint")
    since_1601 = micros > 10_000_000_000_000_000
    when = F.when(since_1601, F.timestamp_micros(micros - 11_644_473_600_000_000)).when(micros.isNotNull(), F.timestamp_micros(micros)).otherwise(S.timestamp_of(at))
    kind = F.when(since_1601, "Browser_Chrome").when(micros.isNotNull(), "Browser_Firefox").otherwise("Browser")
    return df.where(url.isNotNull()).select("row_id", when.alias("timestamp_utc"), kind.alias("event_type"), url.alias("uri"), F.when(F.lower(url).rlike("|".join(ODD_URLS)), "medium").otherwise("info").alias("severity"))


# Reason bits of the change journal, and programs of the system that attackers use.
OVERWRITE, EXTEND, CREATE, DELETE, SECURITY, NEW_NAME = 0x1, 0x2, 0x100, 0x200, 0x800, 0x2000
JOURNAL_TOOLS = ["certutil", "bitsadmin", "mshta", "regsvr32", "rundll32", "wmic", "psexec", "powershell"]


def norm_usn(df: DataFrame) -> DataFrame:
    """Journal records (row_id, timestamp_utc, reason, file_path) to one event for each thing done; equal time, type and path once."""
    has = lambda bits: F.col("reason").bitwiseAND(F.lit(bits)) != 0
    worse = F.lower("file_path").rlike(r"\.(exe|dll|ps1|bat|vbs|aspx)$")
    tool = F.exists(F.array(*map(F.lit, JOURNAL_TOOLS)), lambda t: F.lower("file_path").contains(t))
    kinds = [(has(CREATE), "USN_FileCreated", F.when(worse, "medium").otherwise("info")), (has(DELETE), "USN_FileDeleted", F.lit("high")), (has(NEW_NAME), "USN_FileRenamed", F.lit("medium")), (has(SECURITY), "USN_SecurityChanged", F.lit("medium")), (has(OVERWRITE | EXTEND) & worse, "USN_FileModified", F.lit("medium")), (tool, "USN_LOLBin_Detected", F.lit("high"))]
    events = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("event_type"), s.alias("severity"))) for c, n, s in kinds]))
    out = df.select("row_id", "timestamp_utc", "file_path", F.explode(events).alias("e")).select("row_id", "timestamp_utc", "file_path", "e.*")
    return out.groupBy("timestamp_utc", "event_type", "file_path").agg(F.min("row_id").alias("row_id"), F.min("severity").alias("severity"))


def norm_packet_json(df: DataFrame) -> DataFrame:
    """Packets as JSON of layers whose fields are arrays: the first value counts; a later protocol names the event."""
    at = lambda k: F.get_json_object("value", f"$.layers['{k}'][0]")
    kind = F.when(at("smb2.cmd").isNotNull(), "SMB").when(at("kerberos.msg_type").isNotNull(), "Kerberos").when(at("tls.handshake.ja3").isNotNull(), "TLS").when(at("dns.qry.name").isNotNull(), "DNS").when(at("http.request.method").isNotNull(), "HTTP").when(at("udp.srcport").isNotNull(), "UDP").otherwise("TCP")
    return df.select("row_id", F.timestamp_micros((at("frame.time_epoch").try_cast("double") * 1_000_000).cast("long")).alias("timestamp_utc"), F.concat(F.lit("PCAP_"), kind).alias("event_type"), at("ip.src").alias("source_ip"), at("ip.dst").alias("dest_ip"), F.coalesce(at("tcp.dstport"), at("udp.dstport")).try_cast("bigint").alias("dest_port"), at("http.request.method").alias("http_method"), F.coalesce(at("http.request.uri"), at("dns.qry.name")).alias("uri"))


def _ev(f):
    return lambda s, d: f(security_events(s, d))


_AT = F.date_format
_PAYLOAD = {"Image": "process_name", "CommandLine": "command_line", "ParentImage": "parent_process_name", "TargetUserName": "username", "SourceIp": "source_ip", "DestinationIp": "dest_ip", "ServiceName": "service_name", "TargetFilename": "file_path", "TargetObject": "registry_key"}


def _channel() -> Column:
    return F.when(F.col("k") % 3 == 0, "Microsoft-Windows-Sysmon/Operational").when(F.col("k") % 3 == 1, "Security").otherwise("System")


def _data() -> list[tuple[str, Column]]:
    hexed = F.concat(F.lit("0x"), F.lower(F.hex("process_id")))
    return [*((k, F.col(c)) for k, c in _PAYLOAD.items()), ("ProcessId", F.when(F.col("k") % 2 == 0, hexed).otherwise(F.col("process_id").cast("string"))), ("LogonType", F.col("logon_type").cast("string"))]


def _event_rows(ev: DataFrame) -> DataFrame:
    """A third of the payloads as named data, a third as plain keys, a third with pairs in numbered columns."""
    named = F.to_json(F.struct(F.struct(F.array(*[F.struct(F.lit(k).alias("@Name"), c.alias("#text")) for k, c in _data()]).alias("Data")).alias("EventData")))
    plain = F.to_json(F.struct(F.struct(*[c.alias(k) for k, c in _data()]).alias("EventData")))
    rest = F.to_json(F.struct(F.struct(*[c.alias(k) for k, c in _data() if k not in ("TargetUserName", "LogonType")]).alias("EventData")))
    payload = F.when(F.col("row_id") % 3 == 0, named).when(F.col("row_id") % 3 == 1, plain).otherwise(rest)
    pairs = F.when(F.col("row_id") % 3 == 2, F.concat(F.lit("TargetUserName: "), "username", F.lit(", LogonType: "), F.col("logon_type").cast("string")))
    return ev.select("row_id", F.to_json(F.struct(F.col("event_code").cast("string").alias("EventId"), _channel().alias("Channel"), _AT("timestamp_utc", "yyyy-MM-dd'T'HH:mm:ss").alias("TimeCreated"), F.col("source_system").alias("Computer"), payload.alias("Payload"), pairs.alias("PayloadData1"))).alias("value"))


def _event_xml(ev: DataFrame) -> DataFrame:
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    data = F.concat(*[F.concat(F.lit(f'<Data Name="{k}">'), escaped(c), F.lit("</Data>")) for k, c in _data()])
    head = F.concat(F.lit('<Event><System><Provider Name="p"/><EventID>'), F.col("event_code").cast("string"), F.lit('</EventID><TimeCreated SystemTime="'), _AT("timestamp_utc", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('"/><Computer>'), "source_system", F.lit("</Computer><Channel>"), _channel(), F.lit("</Channel></System>"))
    return ev.select("row_id", F.concat(head, F.lit("<EventData>"), data, F.lit("</EventData></Event>")).alias("value"))


_WORDS = ["Threat found in x", "Scan failed", "Real-time disabled", "All fine", "Warning: old"]
_URLS = ["https://pastebin.com/x", "https://example.org/a", "http://bit.ly/q", "https://mega.nz/f", "http://intra.example.net/"]
_CACHED = ["C:\\Windows\\Temp\\a.exe", "C:\\Windows\\System32\\calc.exe", "C:\\Tools\\PsExec.exe", "C:\\Users\\Public\\b.exe", "C:\\Program Files\\x\\y.exe"]
_NAMES = ["report.docx", "evil.exe", "CERTUTIL.EXE-1234.pf", "shell.aspx", "notes.txt"]
_REASONS = [0x100, 0x200, 0x2000, 0x802, 0x101, 0x3, 0x80]


def _of(values: list, index: str = "row_id") -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(index) % len(values) + 1).cast("int"))


def _defender(ev: DataFrame) -> DataFrame:
    code = _of([*DEFENDER_EVENTS, 4242], "k")
    return norm_defender(ev.select("row_id", F.when(F.col("row_id") % 2 == 0, F.to_json(F.struct(code.alias("EventID"), F.col("file_path").alias("Path")))).otherwise(_of(_WORDS)).alias("value")))


def _browser(ev: DataFrame) -> DataFrame:
    micros = F.unix_micros("timestamp_utc")
    at = F.when(F.col("k") % 3 == 0, (micros + 11_644_473_600_000_000).cast("string")).when(F.col("k") % 3 == 1, micros.cast("string")).otherwise(_AT("timestamp_utc", "yyyy-MM-dd'T'HH:mm:ss"))
    return norm_browser(ev.select("row_id", F.to_json(F.struct(_of(_URLS).alias("url"), at.alias("visit_time"))).alias("value")))


def _packet(ev: DataFrame) -> DataFrame:
    one = lambda c: F.array(c.cast("string"))
    layers = F.struct(one(F.format_string("%.3f", F.unix_millis("timestamp_utc") / 1000)).alias("frame.time_epoch"), one(F.col("source_ip")).alias("ip.src"), one(F.col("dest_ip")).alias("ip.dst"), one(F.col("dest_port")).alias("tcp.dstport"), F.when(F.col("k") % 3 == 0, one(F.col("http_method"))).alias("http.request.method"), F.when(F.col("k") % 3 == 0, one(F.col("uri"))).alias("http.request.uri"), F.when(F.col("k") % 3 == 1, one(F.col("query_name"))).alias("dns.qry.name"))
    return norm_packet_json(ev.select("row_id", F.to_json(F.struct(layers.alias("layers"))).alias("value")))


def _payload_rows(ev: DataFrame) -> DataFrame:
    # columns of their own: each payload is parsed once, whatever number of fields is looked up
    own = _event_rows(ev).select("row_id", F.get_json_object("value", "$.Payload").alias("payload")).select("row_id", *[m.alias(f"map{i}") for i, m in enumerate(payload_maps(F.col("payload")))])
    return own.select("row_id", *[_lookup([F.col(f"map{i}") for i in range(4)], [k]).alias(k.lower()) for k in ("Image", "CommandLine", "ServiceName", "TargetObject")])


QUERIES = {
    "norm_winevent_rows": _ev(lambda ev: norm_winevent_rows(_event_rows(ev)).drop("parent_process_id")),
    "norm_winevent_xml": _ev(lambda ev: norm_winevent_xml(_event_xml(ev)).drop("parent_process_id")),
    "payload_normalize": _ev(_payload_rows),
    "payloaddata_kv": _ev(lambda ev: ev.select("row_id", kv_pairs(_of(["ProcessID: 21, User: bob, Path: C:\\a b\\c.exe", "MD5=aa,SHA256=bb", "plain words", "SourceIp: 10.0.0.9"]).alias("v")).alias("m")).select("row_id", F.explode("m").alias("field", "found"))),
    "payloaddata_route": _ev(lambda ev: ev.select("row_id", F.explode(F.array_compact(F.array(route_payload(1, F.col("process_id").cast("string")), route_payload(2, F.col("parent_process_id").cast("string")), route_payload(3, F.col("file_path")), route_payload(4, F.col("target_image")), route_payload(5, F.concat(F.lit("a="), "username")), route_payload(6, F.col("username"))))).alias("x")).select("row_id", "x.*")),
    "norm_defender": _ev(_defender),
    "norm_shimcache": _ev(lambda ev: norm_shimcache(ev.select("row_id", F.when(F.col("k") % 2 == 0, F.to_json(F.struct(_of(_CACHED).alias("Path"), _AT("timestamp_utc", "yyyy-MM-dd HH:mm:ss").alias("LastModified"), F.lit("Yes").alias("Executed")))).otherwise(F.to_json(F.struct(_of(_CACHED).alias("FullPath"), _AT("timestamp_utc", "yyyy-MM-dd HH:mm:ss").alias("LastWriteTime")))).alias("value")))),
    "norm_browser": _ev(_browser),
    "norm_usn": _ev(lambda ev: norm_usn(ev.select("row_id", F.date_trunc("hour", "timestamp_utc").alias("timestamp_utc"), _of(_REASONS, "k").alias("reason"), _of(_NAMES).alias("file_path")))),
    "norm_packet_json": _ev(_packet),
}

_HEAD = "date_trunc('second', timestamp_utc) AS timestamp_utc, CASE WHEN k % 3 = 0 THEN 'Sysmon_' || event_code || '_' || CASE event_code {} ELSE CAST(event_code AS VARCHAR) END {} ELSE CASE WHEN k % 3 = 1 THEN 'Security' ELSE 'System' END END AS event_type, CAST(event_code AS VARCHAR) AS event_id, source_system".format(
    " ".join(f"WHEN {c} THEN '{n}'" for c, n in SENSOR_NAMES.items()),
    " ".join(f"WHEN event_code IN ({', '.join(map(str, codes))}) THEN '{log}_' || event_code || '_{kind}'" for (log, kind), codes in WINDOWS_KINDS.items()),
)
_WIN = f"WITH {SEC} SELECT row_id, {_HEAD}, process_name, command_line, parent_process_name, username, source_ip, dest_ip, CAST(logon_type AS BIGINT) AS logon_type, service_name, file_path, registry_key, process_id FROM sec"
_list = lambda values, index="row_id": "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST({index} % {len(values)} + 1 AS INT)]"
_CODE = "[" + ", ".join(map(str, [*DEFENDER_EVENTS, 4242])) + f"][CAST(k % {len(DEFENDER_EVENTS) + 1} + 1 AS INT)]"
_USN = f"u AS (SELECT row_id, date_trunc('hour', timestamp_utc) AS timestamp_utc, {_list(_NAMES)} AS file_path, [{', '.join(map(str, _REASONS))}][CAST(k % {len(_REASONS)} + 1 AS INT)] AS reason FROM sec)"

ORACLES = {
    "norm_winevent_rows": _WIN,
    "norm_winevent_xml": _WIN,
    "payload_normalize": f"WITH {SEC} SELECT row_id, process_name AS image, command_line AS commandline, service_name AS servicename, registry_key AS targetobject FROM sec",
    "payloaddata_kv": f"WITH {SEC}, m(i, field, found) AS (VALUES (0, 'ProcessID', '21'), (0, 'User', 'bob'), (0, 'Path', 'C:\\a b\\c.exe'), (1, 'MD5', 'aa'), (1, 'SHA256', 'bb'), (2, '_unparsed', 'plain words'), (3, 'SourceIp', '10.0.0.9')) SELECT row_id, field, found FROM sec JOIN m ON row_id % 4 = i",
    "payloaddata_route": f"WITH {SEC} SELECT row_id, 'pid' AS field, CAST(process_id AS VARCHAR) AS value FROM sec UNION ALL SELECT row_id, 'ppid', CAST(parent_process_id AS VARCHAR) FROM sec UNION ALL SELECT row_id, 'image_path', file_path FROM sec UNION ALL SELECT row_id, 'parent_image_path', target_image FROM sec UNION ALL SELECT row_id, 'pairs', 'a=' || username FROM sec",
    "norm_defender": f"WITH {SEC}, x AS (SELECT row_id, CASE WHEN row_id % 2 = 0 THEN {_CODE} END AS code, {_list(_WORDS)} AS words, file_path AS f FROM sec) SELECT row_id, CASE code {' '.join(f'WHEN {c} THEN {chr(39)}Defender_{n}{chr(39)}' for c, (n, _) in DEFENDER_EVENTS.items())} WHEN 4242 THEN 'Defender_Event_4242' ELSE 'Defender_Log' END AS event_type, CASE WHEN code IS NULL THEN CASE words WHEN 'Threat found in x' THEN 'high' WHEN 'Scan failed' THEN 'medium' WHEN 'Real-time disabled' THEN 'high' WHEN 'All fine' THEN 'info' ELSE 'medium' END ELSE CASE code {' '.join(f'WHEN {c} THEN {chr(39)}{s}{chr(39)}' for c, (_, s) in DEFENDER_EVENTS.items())} ELSE 'info' END END AS severity, CASE WHEN code IS NOT NULL THEN f END AS file_path FROM x",
    "norm_shimcache": f"WITH {SEC} SELECT row_id, date_trunc('second', timestamp_utc) AS timestamp_utc, 'Shimcache' AS event_type, {_list(_CACHED)} AS file_path, {_list(['a.exe', 'calc.exe', 'PsExec.exe', 'b.exe', 'y.exe'])} AS process_name, CASE WHEN row_id % 5 IN (0, 2, 3) THEN 'high' WHEN k % 2 = 0 THEN 'low' ELSE 'info' END AS severity FROM sec",
    "norm_browser": f"WITH {SEC} SELECT row_id, CASE WHEN k % 3 = 2 THEN date_trunc('second', timestamp_utc) ELSE timestamp_utc END AS timestamp_utc, CASE k % 3 WHEN 0 THEN 'Browser_Chrome' WHEN 1 THEN 'Browser_Firefox' ELSE 'Browser' END AS event_type, {_list(_URLS)} AS uri, CASE WHEN row_id % 5 IN (0, 2, 3) THEN 'medium' ELSE 'info' END AS severity FROM sec",
    "norm_usn": f"WITH {SEC}, {_USN}, e AS (SELECT *, 'USN_FileCreated' AS event_type, CASE WHEN regexp_matches(file_path, '(exe|aspx)$') THEN 'medium' ELSE 'info' END AS severity FROM u WHERE reason & 256 <> 0 UNION ALL SELECT *, 'USN_FileDeleted', 'high' FROM u WHERE reason & 512 <> 0 UNION ALL SELECT *, 'USN_FileRenamed', 'medium' FROM u WHERE reason & 8192 <> 0 UNION ALL SELECT *, 'USN_SecurityChanged', 'medium' FROM u WHERE reason & 2048 <> 0 UNION ALL SELECT *, 'USN_FileModified', 'medium' FROM u WHERE reason & 3 <> 0 AND regexp_matches(file_path, '(exe|aspx)$') UNION ALL SELECT *, 'USN_LOLBin_Detected', 'high' FROM u WHERE file_path LIKE 'CERTUTIL%') SELECT timestamp_utc, event_type, file_path, min(row_id) AS row_id, min(severity) AS severity FROM e GROUP BY 1, 2, 3",
    "norm_packet_json": f"WITH {SEC} SELECT row_id, date_trunc('millisecond', timestamp_utc) AS timestamp_utc, CASE k % 3 WHEN 0 THEN 'PCAP_HTTP' WHEN 1 THEN 'PCAP_DNS' ELSE 'PCAP_TCP' END AS event_type, source_ip, dest_ip, CAST(dest_port AS BIGINT) AS dest_port, CASE WHEN k % 3 = 0 THEN http_method END AS http_method, CASE k % 3 WHEN 0 THEN uri WHEN 1 THEN query_name END AS uri FROM sec",
}
