"""Rows of memory tools as events: which key of a plugin's record fills which field is a table, not code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..adapters import SEC, security_events
from ..functions import scalars as S

_ADDRESSES = {"source_ip": "LocalAddr", "source_port": "LocalPort", "dest_ip": "ForeignAddr", "dest_port": "ForeignPort", "process_id": "PID"}
# The keys of each plugin's records by field, in the order in which they are asked (joined by |).
# The first plugin whose name is part of the record's counts.
PLUGINS: dict[str, dict[str, str]] = {
    "vadinfo": {"process_name": "ImageFileName|Process", "process_id": "PID"},
    "info": {"process_name": "Variable", "command_line": "Value"},
    "pslist": {"process_name": "ImageFileName|Name", "process_id": "PID", "parent_process_id": "PPID", "command_line": "CommandLine"},
    "pstree": {"process_name": "ImageFileName|Name", "process_id": "PID", "parent_process_id": "PPID", "command_line": "CommandLine"},
    "cmdline": {"process_name": "ImageFileName", "process_id": "PID", "command_line": "Args|CommandLine"},
    "netscan": {**_ADDRESSES, "process_name": "Owner"},
    "malfind": {"process_name": "ImageFileName|Process", "process_id": "PID"},
    "filescan": {"process_name": "Name", "command_line": "Name"},
    "dlllist": {"process_name": "ImageFileName", "process_id": "PID", "command_line": "Path|FullDllName"},
    "handles": {"process_name": "ImageFileName", "process_id": "PID"},
    "svcscan": {"process_name": "Name|ServiceName", "command_line": "Binary|ImagePath"},
    "netstat": {**_ADDRESSES, "process_name": "Owner"},
    "hivelist": {"process_name": "FileFullPath|Name"},
    "getsids": {"process_name": "ImageFileName", "process_id": "PID", "username": "SID|Name"},
    "envars": {"process_name": "ImageFileName", "process_id": "PID"},
    "userassist": {"process_name": "Path|Name"},
    "callbacks": {"process_name": "Module|Symbol"},
    "ssdt": {"process_name": "Symbol|Module"},
    "connscan": {**_ADDRESSES, "process_name": "Owner|ImageFileName"},
    "connections": {**_ADDRESSES, "process_name": "Owner|ImageFileName"},
    "ldrmodules": {"process_name": "ImageFileName", "process_id": "PID", "command_line": "MappedPath|BaseDllName"},
    "mutantscan": {"process_name": "Name|HandleValue"},
    "hashdump": {"process_name": "User|Name", "username": "User|Name"},
    "mftscan.ads": {},
    "mftscan.mftscan": {"process_name": "FileName|Name", "command_line": "FileName|Name"},
    "psxview": {"process_name": "ImageFileName|Name", "process_id": "PID"},
}
#: Fields that join two keys: plugin: (field, first, between, second).
JOINED = {"envars": ("command_line", "Variable", "=", "Value"), "mftscan.ads": ("process_name", "FileName|Record", ":", "ADS|Name")}
#: Severity of a plugin's rows, whatever they say.
ALWAYS = {"malfind": "high", "hashdump": "high", "mftscan.ads": "high", "callbacks": "medium", "ssdt": "medium"}
#: Keys that are true in harmless rows.
TRUE_KEYS = {"ldrmodules": ["InLoad", "InInit", "InMem"], "psxview": ["pslist", "psscan", "thrdproc", "csrss"]}
#: A key and what makes its value worth a severity: (key, pattern, severity).
TELLING = {"vadinfo": ("Protection", "(?i)execute.*write|write.*execute", "high"), "svcscan": ("State", "(?i)^(?!.*running)", "low")}
TIMES = {"mftscan.mftscan": ["Created", "Modified", "MFTAltered", "Accessed"]}
FIELDS = ["process_name", "process_id", "parent_process_id", "command_line", "source_ip", "source_port", "dest_ip", "dest_port", "username"]
_NUMBERS = ("process_id", "parent_process_id", "source_port", "dest_port")


def mappings(spark) -> DataFrame:
    """One row for each plugin: keys by field, joined fields, severities."""
    rows = []
    for name, keys in PLUGINS.items():
        field, first, between, second = JOINED.get(name, (None, None, None, None))
        key, pattern, severity = TELLING.get(name, (None, None, None))
        rows.append((name, {f: k.split("|") for f, k in keys.items()}, field, (first or "").split("|"), between, (second or "").split("|"), ALWAYS.get(name), TRUE_KEYS.get(name, []), key, pattern, severity, ["CreateTime", *TIMES.get(name, [])]))
    kind = "plugin string, keys map<string,array<string>>, joined string, first array<string>, between string, second array<string>, always string, true_keys array<string>, key string, pattern string, severity_of string, times array<string>"
    return F.broadcast(spark.createDataFrame(rows, kind))


def _of(keys: Column) -> Column:
    """The first value of the record among some keys."""
    return F.get(F.filter(F.transform(keys, lambda k: F.try_element_at("record", k)), lambda v: v.isNotNull() & (v != "")), F.lit(0))


def norm_memory_json(df: DataFrame) -> DataFrame:
    """Rows (row_id, value) of memory tools as JSON, with their plugin's name, as events. A plugin without a line in the table
    gives an event without fields; ``vadinfo`` is not taken for ``info``."""
    record = F.from_json("value", "map<string,string>")
    rows = df.select("row_id", "value", record.alias("record")).withColumn("name", F.try_element_at("record", F.lit("plugin"))).where("name IS NOT NULL")
    short, low = F.element_at(F.split("name", r"\."), -1), F.lower("name")
    plugin = F.get(F.filter(F.array(*map(F.lit, PLUGINS)), lambda p: low.contains(p)), F.lit(0))
    rows = rows.withColumn("plugin", plugin).join(mappings(df.sparkSession), "plugin", "left")
    pair = F.concat(F.coalesce(_of(F.col("first")), F.lit("")), F.col("between"), F.coalesce(_of(F.col("second")), F.lit("")))

    def field(name: str) -> Column:
        own = F.when(F.col("joined") == name, pair).otherwise(_of(F.try_element_at("keys", F.lit(name))))
        return (own.try_cast("bigint") if name in _NUMBERS else own).alias(name)

    hidden = F.exists("true_keys", lambda k: F.lower(F.coalesce(F.try_element_at("record", k), F.lit("true"))) == "false")
    telling = F.coalesce(F.expr("regexp_like(coalesce(try_element_at(record, key), ''), pattern)"), F.lit(False))
    severity = F.coalesce("always", F.when(hidden, "high"), F.when(telling, F.col("severity_of")), F.lit("info"))
    kind = F.concat(F.lit("Memory_"), F.when(F.col("plugin") == "info", "system_info").otherwise(short))
    return rows.select("row_id", S.timestamp_of(_of(F.col("times"))).alias("timestamp_utc"), kind.alias("event_type"), severity.alias("severity"), *map(field, FIELDS), F.col("value").alias("raw_payload"))


NAMES = [f"windows.{p}" if p not in ("hivelist", "userassist") else f"windows.registry.{p}" for p in PLUGINS if "." not in p] + ["windows.mftscan.ADS", "windows.mftscan.MFTScan", "windows.modscan"]


def memory_rows(ev: DataFrame) -> DataFrame:
    """Records of all plugins made from the test events; all have the same keys, of which each plugin reads its own."""
    text = lambda x: F.col(x).cast("string")
    keys = {
        "plugin": F.element_at(F.array(*map(F.lit, NAMES)), (F.col("row_id") % len(NAMES) + 1).cast("int")), "PID": text("process_id"), "PPID": text("parent_process_id"), "ImageFileName": F.when(F.col("k") % 5 != 0, F.col("process_name")), "Process": F.lit("proc"),
        "Name": F.concat(F.lit("n"), text("row_id")), "CommandLine": F.col("command_line"), "Args": F.when(F.col("k") % 2 == 0, F.lit("args")), "LocalAddr": F.col("source_ip"), "LocalPort": F.lit("99"), "ForeignAddr": F.col("dest_ip"), "ForeignPort": text("dest_port"), "Owner": F.lit("own"),
        "Protection": F.when(F.col("k") % 2 == 0, "PAGE_EXECUTE_READWRITE").otherwise("PAGE_READONLY"), "Path": F.col("file_path"), "Binary": F.lit("svc.exe"), "State": F.when(F.col("k") % 2 == 0, "SERVICE_RUNNING").otherwise("SERVICE_STOPPED"), "SID": F.lit("S-1-5"), "Variable": F.lit("VAR"), "Value": F.lit("val"),
        "Module": F.lit("mod"), "Symbol": F.lit("sym"), "MappedPath": F.lit("C:\\x.dll"), "InMem": (F.col("k") % 2 == 0).cast("string"), "psscan": (F.col("k") % 2 == 0).cast("string"), "User": F.col("username"), "ADS": F.lit("zone"), "FileName": F.lit("f.txt"), "FileFullPath": F.lit("\\hive"),
        "CreateTime": F.when(F.col("k") % 3 == 0, F.date_format("timestamp_utc", "yyyy-MM-dd'T'HH:mm:ss")), "Created": F.lit("2024-02-02T00:00:00"),
    }
    return ev.select("row_id", F.to_json(F.struct(*[c.alias(k) for k, c in keys.items()])).alias("value"))


def _in(*names: str) -> str:
    return f"p IN ({', '.join(repr(n) for n in names)})"


_IMAGE = "CASE WHEN k % 5 <> 0 THEN process_name END"
_NET = _in("netscan", "netstat", "connscan", "connections")
_PID = _in("vadinfo", "pslist", "pstree", "cmdline", "malfind", "dlllist", "handles", "getsids", "envars", "ldrmodules", "psxview", "netscan", "netstat", "connscan", "connections")
QUERIES = {"norm_memory_json": lambda s, d: norm_memory_json(memory_rows(security_events(s, d))).drop("raw_payload")}
ORACLES = {
    "norm_memory_json": f"WITH {SEC}, x AS (SELECT *, [{', '.join(repr(n.split('.')[-1]) for n in NAMES)}][CAST(row_id % {len(NAMES)} + 1 AS INT)] AS p FROM sec) SELECT row_id, "
    "CASE WHEN p = 'modscan' THEN NULL WHEN k % 3 = 0 THEN date_trunc('second', timestamp_utc) WHEN p = 'MFTScan' THEN TIMESTAMP '2024-02-02' END AS timestamp_utc, 'Memory_' || CASE p WHEN 'info' THEN 'system_info' ELSE p END AS event_type, "
    f"CASE WHEN {_in('malfind', 'hashdump', 'ADS')} THEN 'high' WHEN {_in('callbacks', 'ssdt')} THEN 'medium' WHEN {_in('ldrmodules', 'psxview')} AND k % 2 = 1 THEN 'high' WHEN p = 'vadinfo' AND k % 2 = 0 THEN 'high' WHEN p = 'svcscan' AND k % 2 = 1 THEN 'low' ELSE 'info' END AS severity, "
    f"CASE WHEN p = 'info' THEN 'VAR' WHEN {_NET} THEN 'own' WHEN {_in('filescan', 'svcscan', 'mutantscan')} THEN 'n' || row_id WHEN p = 'hivelist' THEN '\\hive' WHEN p = 'userassist' THEN file_path WHEN p = 'callbacks' THEN 'mod' WHEN p = 'ssdt' THEN 'sym' "
    f"WHEN p = 'hashdump' THEN username WHEN p = 'ADS' THEN 'f.txt:zone' WHEN p = 'MFTScan' THEN 'f.txt' WHEN {_in('pslist', 'pstree', 'psxview')} THEN coalesce({_IMAGE}, 'n' || row_id) WHEN {_in('vadinfo', 'malfind')} THEN coalesce({_IMAGE}, 'proc') WHEN p <> 'modscan' THEN {_IMAGE} END AS process_name, "
    f"CASE WHEN {_PID} THEN process_id END AS process_id, CASE WHEN {_in('pslist', 'pstree')} THEN parent_process_id END AS parent_process_id, "
    f"CASE WHEN p = 'info' THEN 'val' WHEN {_in('pslist', 'pstree')} THEN command_line WHEN p = 'cmdline' THEN CASE WHEN k % 2 = 0 THEN 'args' ELSE command_line END WHEN p = 'filescan' THEN 'n' || row_id WHEN p = 'dlllist' THEN file_path WHEN p = 'svcscan' THEN 'svc.exe' WHEN p = 'envars' THEN 'VAR=val' WHEN p = 'ldrmodules' THEN 'C:\\x.dll' WHEN p = 'MFTScan' THEN 'f.txt' END AS command_line, "
    f"CASE WHEN {_NET} THEN source_ip END AS source_ip, CASE WHEN {_NET} THEN CAST(99 AS BIGINT) END AS source_port, CASE WHEN {_NET} THEN dest_ip END AS dest_ip, CASE WHEN {_NET} THEN CAST(dest_port AS BIGINT) END AS dest_port, CASE p WHEN 'getsids' THEN 'S-1-5' WHEN 'hashdump' THEN username END AS username FROM x",
}
