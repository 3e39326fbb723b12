"""Scripts as events: values and behaviours with their first line, tools of the system, and what decoded parts name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..adapters import security_events
from ..functions import scalars as S
from ..operators.layers import decodings

# Values that scripts name: event type, pattern, severity.
VALUES = [
    ("Script_IOC_IP", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", "high"),
    ("Script_IOC_URL", r"(?i)https?://[^\s\"'<>\])]+", "high"),
    ("Script_IOC_Domain", r"(?i)\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:com|net|org|io|co|info|biz|ru|cn|xyz|top|tk|ml|ga|cf|pw|cc|ws|su|onion)\b", "medium"),
    ("Script_IOC_FilePath", r"[A-Za-z]:\\(?:[^\\/:*?\"<>|\r\n]+\\)*[^\\/:*?\"<>|\r\n]*|\\\\[^\\/:*?\"<>|\r\n]+\\[^\\/:*?\"<>|\r\n]+", "medium"),
    ("Script_IOC_Registry", r"(?i)(?:HKLM|HKCU|HKEY_LOCAL_MACHINE|HKEY_CURRENT_USER|HKCR|HKU)\\[^\s\"']+", "medium"),
    ("Script_ScheduledTask", r"(?i)schtasks.*?/tn\s+[\"']?([^\"'\s/]+)[\"']?", "critical"),
    ("Script_CertutilDecode", r"(?i)certutil.*?-decode\s+(\S+\s+\S+)", "critical"),
    ("Script_RARFile", r"[\w\s]+\.rar\b", "high"),
    ("Script_User_Account", r"(?i)C:\\Users\\([^\\]+)\\", "medium"),
]
#: Behaviours: pattern and technique.
BEHAVIOURS = {
    "encoded_command": (r"-(?:enc(?:oded)?(?:command)?|ec)\s+[A-Za-z0-9+/=]+", "T1059.001"), "bypass_execution_policy": (r"-(?:ex(?:ecution)?)?(?:p(?:olicy)?)\s*(?:bypass|unrestricted)", "T1059.001"), "hidden_window": (r"-(?:w(?:indow)?(?:style)?)\s*(?:hidden|1)", "T1564.003"),
    "no_profile": (r"-(?:nop(?:rofile)?)", None), "download_string": (r"(?:downloadstring|downloadfile|invoke-webrequest|wget|curl|iwr|irm|start-bitstransfer)", "T1105"), "invoke_expression": (r"(?:invoke-expression|iex)\s", "T1059.001"), "certutil_decode": (r"certutil.*-decode", "T1140"),
    "bitsadmin_transfer": (r"bitsadmin.*(?:/transfer|/download)", "T1105"), "scheduled_task": (r"schtasks\s*/create", "T1053.005"), "service_create": (r"sc\s+(?:create|config)", "T1543.003"), "wmi_process": (r"(?:wmic|get-wmiobject).*process.*(?:create|call)", "T1047"),
    "reflection_assembly": (r"\[reflection\.assembly\]::load", "T1620"), "mimikatz_patterns": (r"(?:sekurlsa|kerberos|lsadump|privilege::debug)", "T1003"), "credential_access": (r"(?:get-credential|convertto-securestring|system\.security\.cryptography)", "T1555"),
    "disable_defender": (r"(?:set-mppreference|disable-windowsoptionalfeature|remove-windowsdefender)", "T1562.001"), "amsi_bypass": (r"(?:amsiutils|amsiscanbuffer|amsicontext)", "T1562.001"), "shellcode": (r"(?:virtualalloc|virtualallocex|writeprocessmemory|createremotethread)", "T1055"),
    "event_log_clear": (r"(?:clear-eventlog|wevtutil\s+cl|remove-eventlog)", "T1070.001"),
}
#: Programs of the system that attackers use, and the technique that some of them tell.
TOOLS = [
    "powershell", "cmd", "wscript", "cscript", "mshta", "rundll32", "regsvr32", "certutil", "bitsadmin", "msiexec", "installutil", "regasm", "regsvcs", "msbuild", "cmstp", "wmic", "forfiles", "pcalua", "explorer", "control", "eventvwr", "dnscmd", "ftp", "replace", "expand", "extrac32",
    "makecab", "hh", "infdefaultinstall", "ieexec", "msconfig", "msdeploy", "msdt", "odbcconf", "pcwrun", "presentationhost", "rasautou", "register-cimprovider", "rpcping", "runscripthelper", "sfc", "syncappvpublishingserver", "tttracer", "verclsid", "wab", "xwizard", "bash", "diskshadow",
    "esentutl", "findstr", "gpscript", "mavinject", "nltest", "ntdsutil", "print", "pubprn", "sc", "scriptrunner",
]
TOOL_TECHNIQUES = {
    "powershell": "T1059.001", "cmd": "T1059.003", "wscript": "T1059.005", "cscript": "T1059.005", "mshta": "T1218.005", "rundll32": "T1218.011", "regsvr32": "T1218.010", "certutil": "T1140", "bitsadmin": "T1197", "msiexec": "T1218.007", "installutil": "T1218.004", "regasm": "T1218.009",
    "regsvcs": "T1218.009", "msbuild": "T1127.001", "cmstp": "T1218.003", "wmic": "T1047",
}
NO_USERS = ["public", "default", "all users", "default user"]
#: Decoding of decoded parts, at most.
ROUNDS = 3
_FOUND = "array<struct<event_type:string,value:string,severity:string,technique:string>>"


def _one(kind: Column, value: Column, severity: Column, technique: Column) -> Column:
    return F.struct(kind.alias("event_type"), value.alias("value"), severity.alias("severity"), technique.alias("technique"))


def _level(kind: str, severity: str, value: Column) -> Column:
    if kind == "Script_IOC_IP":
        return F.when(S.ip_class(value) == "EXTERNAL", "high").otherwise("medium")
    return F.when(F.lower(value) == "administrator", "high").otherwise(severity) if kind == "Script_User_Account" else F.lit(severity)


def _values(line: Column, kinds: list[tuple[str, str, str]]) -> list[Column]:
    def of(kind: str, pattern: str, severity: str) -> Column:
        group = 1 if kind in ("Script_ScheduledTask", "Script_CertutilDecode", "Script_User_Account") else 0
        return F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(group)), lambda v: _one(F.lit(kind), v, _level(kind, severity, v), F.lit(None).cast("string")))

    return [of(*k) for k in kinds]


def _behaviours(line: Column) -> Column:
    tests = []
    for name, (pattern, technique) in BEHAVIOURS.items():
        severity = "critical" if "bypass" in name or "mimikatz" in name else "high"
        tests.append(F.when(line.rlike(f"(?i){pattern}"), _one(F.lit(f"Script_Suspicious_{name}"), F.lit(name), F.lit(severity), F.lit(technique).cast("string"))))
    return F.array_compact(F.array(*tests))


def _tools(line: Column) -> Column:
    low, known = F.lower(line), F.create_map(*[F.lit(x) for kv in TOOL_TECHNIQUES.items() for x in kv])
    held = F.filter(F.array(*map(F.lit, TOOLS)), lambda t: low.contains(t))
    return F.transform(held, lambda t: _one(F.lit("Script_LOLBin"), t, F.lit("high"), F.try_element_at(known, t)))


def norm_script(df: DataFrame) -> DataFrame:
    """(row_id, event_type, value, severity, technique, line) of scripts (row_id, value): each value, behaviour and tool
    with its first line, from 1; what base64 and URL escapes hide is decoded, ``ROUNDS`` times at most, and new
    addresses and URLs in it have line 0 and are worse."""
    lines = df.select("row_id", F.posexplode(F.split("value", "\n")).alias("at", "text"))
    line = F.col("text")
    every = F.concat(*_values(line, VALUES), _behaviours(line), _tools(line)).cast(_FOUND)
    seen = lines.select("row_id", (F.col("at") + 1).cast("long").alias("line"), F.explode(every).alias("f")).select("row_id", "line", "f.*")
    seen = seen.where((F.col("event_type") != "Script_User_Account") | ~F.lower("value").isin(NO_USERS))
    own = seen.groupBy("row_id", "event_type", "value").agg(F.min(F.struct("line", "severity", "technique")).alias("m")).select("row_id", "event_type", "value", "m.severity", "m.technique", "m.line")

    step, hidden = lines.select("row_id", "text").where(F.size(decodings(line)) > 0), []
    for _ in range(ROUNDS):
        step = step.select("row_id", F.explode(decodings(F.col("text"))).alias("d")).select("row_id", F.col("d.text").alias("text")).distinct()
        hidden.append(step)
    texts = hidden[0]
    for more in hidden[1:]:
        texts = texts.unionByName(more)
    named = texts.select("row_id", F.explode(F.concat(*_values(F.col("text"), VALUES[:2])).cast(_FOUND)).alias("f")).select("row_id", "f.*").distinct()
    fresh = named.join(own.where(F.col("event_type").isin("Script_IOC_IP", "Script_IOC_URL")).select("row_id", "value"), ["row_id", "value"], "left_anti")
    worse = F.when(F.col("severity") == "high", "critical").otherwise("high")
    decoded = fresh.select("row_id", F.replace("event_type", F.lit("Script_"), F.lit("Script_Decoded_")).alias("event_type"), "value", worse.alias("severity"), "technique", F.lit(0).cast("long").alias("line"))
    return own.unionByName(decoded)


def scripts(ev: DataFrame) -> DataFrame:
    """Six kinds of scripts, each with the number of its event in it."""
    n = F.col("row_id").cast("string")
    bare = lambda c: F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"\s", "")
    hidden = F.concat(F.lit("get http://203.0.113.5/p"), n, F.lit(" from 10.9.8.7 or 10.1.2.3"))
    texts = [
        F.concat(F.lit("rem "), n, F.lit("\nping 10.1.2.3\nping 203.0.113.5\nping 10.1.2.3")),
        F.concat(F.lit("powershell -nop -w hidden -executionpolicy bypass\nIEX (x)\nhttp://a"), n, F.lit(".evil.xyz/q")),
        F.concat(F.lit("schtasks /create /tn \"up"), n, F.lit("\" /tr x\ncertutil -decode a.jpg b"), n, F.lit(".zip")),
        F.concat(F.lit("copy C:\\Users\\bob\\m"), n, F.lit(".rar\ncopy C:\\Users\\Public\\y\nreg add HKCU\\Run"), n),
        F.concat(F.lit("ping 10.1.2.3\nx = "), bare(F.concat(F.lit("y = "), bare(hidden)))),
        F.concat(F.lit("nothing of note "), n),
    ]
    return ev.select("row_id", F.element_at(F.array(*texts), (F.col("row_id") % len(texts) + 1).cast("int")).alias("value"))


# what those scripts hold, written out: kind of script, event type, value, severity, technique, line
_ROWS = [
    (0, "Script_IOC_IP", "'10.1.2.3'", "medium", None, 2), (0, "Script_IOC_IP", "'203.0.113.5'", "high", None, 3),
    (1, "Script_Suspicious_no_profile", "'no_profile'", "high", None, 1), (1, "Script_Suspicious_hidden_window", "'hidden_window'", "high", "T1564.003", 1), (1, "Script_Suspicious_bypass_execution_policy", "'bypass_execution_policy'", "critical", "T1059.001", 1),
    (1, "Script_Suspicious_invoke_expression", "'invoke_expression'", "high", "T1059.001", 2), (1, "Script_LOLBin", "'powershell'", "high", "T1059.001", 1), (1, "Script_IOC_URL", "'http://a' || row_id || '.evil.xyz/q'", "high", None, 3), (1, "Script_IOC_Domain", "'a' || row_id || '.evil.xyz'", "medium", None, 3),
    (2, "Script_Suspicious_scheduled_task", "'scheduled_task'", "high", "T1053.005", 1), (2, "Script_ScheduledTask", "'up' || row_id", "critical", None, 1), (2, "Script_Suspicious_certutil_decode", "'certutil_decode'", "high", "T1140", 2), (2, "Script_CertutilDecode", "'a.jpg b' || row_id || '.zip'", "critical", None, 2),
    (2, "Script_LOLBin", "'certutil'", "high", "T1140", 2), (2, "Script_LOLBin", "'sc'", "high", None, 1),
    (3, "Script_IOC_FilePath", "'C:\\Users\\bob\\m' || row_id || '.rar'", "medium", None, 1), (3, "Script_IOC_FilePath", "'C:\\Users\\Public\\y'", "medium", None, 2), (3, "Script_RARFile", "'m' || row_id || '.rar'", "high", None, 1), (3, "Script_User_Account", "'bob'", "medium", None, 1), (3, "Script_IOC_Registry", "'HKCU\\Run' || row_id", "medium", None, 3),
    (4, "Script_IOC_IP", "'10.1.2.3'", "medium", None, 1), (4, "Script_Decoded_IOC_IP", "'203.0.113.5'", "critical", None, 0), (4, "Script_Decoded_IOC_IP", "'10.9.8.7'", "high", None, 0), (4, "Script_Decoded_IOC_URL", "'http://203.0.113.5/p' || row_id", "critical", None, 0),
]
# base64 may hold the letters of a tool's name
_CODED = "lower('x = ' || to_base64(encode('y = ' || to_base64(encode('get http://203.0.113.5/p' || event_id || ' from 10.9.8.7 or 10.1.2.3')))))"
_TOOL_ROWS = ", ".join(f"('{t}', {repr(TOOL_TECHNIQUES[t]) if t in TOOL_TECHNIQUES else 'NULL'})" for t in TOOLS)
QUERIES = {"norm_script": lambda s, d: norm_script(scripts(security_events(s, d)))}
ORACLES = {
    "norm_script": f"WITH t(tool, technique) AS (VALUES {_TOOL_ROWS}) SELECT event_id AS row_id, 'Script_LOLBin' AS event_type, tool AS value, 'high' AS severity, CAST(technique AS VARCHAR) AS technique, CAST(2 AS BIGINT) AS line FROM events, t WHERE event_id % 6 = 4 AND contains({_CODED}, tool)"
    + "".join(f" UNION ALL SELECT event_id, '{t}', {v.replace('row_id', 'event_id')}, '{s}', {repr(q) if q else 'NULL'}, {n} FROM events WHERE event_id % 6 = {i}" for i, t, v, s, q, n in _ROWS)
}
