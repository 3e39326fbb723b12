"""Categories of findings with their kinds: credentials, lateral movement, persistence, network, logons, files, directory, web, PowerShell.

Each function takes events and gives one row for each finding (row_id, kind, and what is known of it). Columns that
a source doesn't have may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..adapters import SEC, security_events
from ..functions import scalars as S

# Words, ports, codes and attributes of the categories.
CREDENTIAL_WORDS = ["pd.exe", "pd64.exe", "procdump", "mimikatz", "sekurlsa", "lsass", "sam", "ntds", "-ma ", "-accepteula"]
CREDENTIAL_CODES = [4648, 4769, 4771, 4776]
LATERAL_PORTS = [445, 135, 139, 5985, 5986, 3389]
REMOTE_PARENTS = ["wmiprvse", "wsmprovhost", "winrshost"]
REMOTE_COMMANDS = ["invoke-wmiexec", "invoke-smbexec", "invoke-thehash"]
REGISTRY_WORDS = ["run", "services", "com\\", "shell"]
INSIDE = ["192.168.", "10.", "172.16.", "172.17.", "172.18.", "172.19.", "172.2", "172.3", "127.", "0.", "::"]
LOGON_CODES = [4624, 4625, 4648, 4672, 4769, 4771, 4776]
FILE_CODES = [11, 15, 23]
FILE_WORDS = ["temp", "public", "inetpub", "wwwroot", "uploads", ".dmp", ".ps1", ".aspx", ".exe", ".php", ".pdf", ".vbs", ".bat", ".cmd"]
DIRECTORY_CODES = [4662, 4663, 5136, 5137]
SENSITIVE_ATTRIBUTES = ["admincount", "serviceprincipalname", "msds-allowedtodelegateto", "msds-allowedtoactonbehalfofotheridentity", "useraccountcontrol", "member", "sidhistory", "primarygroupid"]
PAGES, SHELL_WORDS, COMMAND_KEYS = [".aspx", ".asp", ".php", ".jsp"], ["forbid", "shell", "cmd", "upload", "hack"], ["cmd=", "c=", "exec=", "command="]
SHARED_ENDINGS = [".aspx", ".asp", ".jsp", ".php", ".exe", ".dll", ".ps1", ".bat", ".cmd"]
POWERSHELL_CODES = [400, 403, 800, 4103, 4104]
POWERSHELL_WORDS = [
    "-enc", "-encodedcommand", "frombase64string", "downloadstring", "invoke-expression", "iex", "invoke-command", "net.webclient", "start-bitstransfer", "-windowstyle hidden", "-ep bypass", "-executionpolicy bypass",
    "bypass", "-nop", "-noni", "start-sleep", "sleep -s", "timeout /t", "get-clipboard", "set-clipboard",
]
TEXT = ["process_name", "parent_process_name", "command_line", "uri", "query_string", "file_path", "service_name", "registry_key", "target_image", "raw_payload"]


def _words(text: Column, words: list[str]) -> Column:
    return F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w)), F.lit(False))


def _text() -> Column:
    return F.lower(F.concat_ws(" ", *TEXT))


def _raw(key: str) -> Column:
    return F.get_json_object("raw_payload", f"$.{key}")


def _is(code: int | list[int]) -> Column:
    return F.coalesce(F.col("event_code").isin(code), F.lit(False))


def _typed(part: str) -> Column:
    return F.coalesce(F.lower("event_type").contains(part), F.lit(False))


def found(ev: DataFrame, kinds: dict[str, tuple[Column, Column]], *columns: str) -> DataFrame:
    """A row for each kind that an event is of: (test, what it shows). One pass, no join."""
    of = [F.when(test, F.struct(F.lit(k).alias("kind"), what.cast("string").alias("what"))) for k, (test, what) in kinds.items()]
    return ev.select("row_id", *columns, F.explode(F.array_compact(F.array(*of))).alias("x")).select("row_id", "x.kind", "x.what", *columns)


def credential_access(ev: DataFrame) -> DataFrame:
    """Dumping tools, logons with other credentials, access to the security process and hashes taken from memory."""
    hashes = F.concat_ws(":", _raw("rid"), _raw("lmhash"), _raw("nthash"))
    return found(ev, {"tool": (_words(_text(), CREDENTIAL_WORDS), F.col("command_line")), "auth": (_is(CREDENTIAL_CODES), F.col("event_code")), "lsass_access": (_is(10) & _text().contains("lsass"), F.col("process_name")), "hash_dump": (_typed("memory_hashdump"), hashes)})


def lateral_movement(ev: DataFrame) -> DataFrame:
    """Network logons, connections to ports of remote control, processes of remote parents and remote commands."""
    return found(
        ev,
        {
            "network_logon": (_is(4624) & (F.col("logon_type") == 3), F.col("source_ip")), "connection": (_is(3) & F.col("dest_port").isin(LATERAL_PORTS), F.col("dest_port")),
            "remote_child": (_words(F.lower("parent_process_name"), REMOTE_PARENTS), F.col("parent_process_name")), "remote_command": (_words(_text(), REMOTE_COMMANDS), F.col("command_line")),
        },
    )


def persistence(ev: DataFrame) -> DataFrame:
    """Services (those of random names apart), start entries of the registry, services seen in memory and tasks."""
    named = F.coalesce(_raw("service_name"), F.col("process_name"))
    return found(
        ev,
        {
            "service": (_is(7045), F.col("service_name")), "random_service": (_is(7045) & F.coalesce(F.col("service_name").rlike("^[A-Z]{15,}$"), F.lit(False)), F.col("service_name")), "registry": (_is(13) & _words(F.lower("registry_key"), REGISTRY_WORDS), F.col("registry_key")),
            "memory_service": (_typed("memory_svcscan"), F.concat_ws(" ", named, F.coalesce(_raw("binary_path"), F.col("command_line")))), "task": (_is(4698), F.col("command_line")),
        },
    )


def network(ev: DataFrame) -> DataFrame:
    """Connections, those to outside addresses once more, and names asked for."""
    outside = F.col("dest_ip").isNotNull() & (F.col("dest_ip") != "") & ~F.exists(F.array(*map(F.lit, INSIDE)), lambda p: F.col("dest_ip").startswith(p))
    linked = _is(3) | F.col("dest_ip").isNotNull()
    return found(ev, {"connection": (linked, F.col("dest_ip")), "external": (linked & outside, F.col("dest_ip")), "dns": (_is(22) | _typed("dns"), F.col("query_name"))}, "dest_port")


def auth_timeline(ev: DataFrame) -> DataFrame:
    """Logon events in order of time, with the name of their type and the number of such events of their user."""
    own = ev.where(_is(LOGON_CODES)).select("row_id", "timestamp_utc", "event_code", "username", F.when(F.col("logon_type").isNotNull(), S.logon_type_name(F.col("logon_type"))).alias("logon"))
    n = own.groupBy(F.col("username").alias("_user")).agg(F.count("*").alias("n"))
    return own.join(n, F.col("username").eqNullSafe(F.col("_user"))).drop("_user").orderBy("timestamp_utc", "row_id")


def file_operations(ev: DataFrame) -> DataFrame:
    """Files made, marked or deleted and files held open in memory, with what is suspicious about their place or a dump."""
    kinds = {"file": (_is(FILE_CODES), F.col("file_path")), "handle": (_typed("memory_handles") & (_raw("handle_type") == "File"), _raw("handle_name"))}
    rows = found(ev, kinds, "process_name").withColumnRenamed("what", "path")
    low = F.lower(F.coalesce("path", F.lit("")))
    return rows.withColumns({"suspicious": _words(low, FILE_WORDS), "dump": (F.col("kind") == "file") & low.contains(".dmp")})


def directory_changes(ev: DataFrame) -> DataFrame:
    """Changes of directory objects; those of sensitive attributes are high."""
    low = F.lower(F.coalesce("attribute", F.lit("")))
    return ev.where(_is(DIRECTORY_CODES)).select("row_id", "event_code", "attribute", F.when(_words(low, SENSITIVE_ATTRIBUTES), "HIGH").otherwise("MEDIUM").alias("level"))


def web_attacks(ev: DataFrame) -> DataFrame:
    """Pages that look like shells, commands in queries, shares connected to and files written over them."""
    uri, query, name = F.lower(F.coalesce("uri", F.lit(""))), F.lower(F.coalesce("query_string", F.lit(""))), _raw("filename")
    web = F.coalesce(F.col("http_method") != "", F.lit(False)) | (uri != "")
    shared = _typed("smb") & F.coalesce(F.col("raw_payload").rlike("tree_path|filename"), F.lit(False))
    written = shared & name.isNotNull() & (_raw("write_length").try_cast("bigint") > 0)
    ending = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"[^.](\.[^./\\]*)$", 1))
    return found(
        ev,
        {
            "webshell": (web & _words(uri, PAGES) & _words(uri, SHELL_WORDS), F.col("uri")), "command_query": (web & _words(query, COMMAND_KEYS), F.col("query_string")),
            "share_connect": (shared & _raw("tree_path").isNotNull(), _raw("tree_path")), "share_write": (written, name), "suspicious_write": (written & ending.isin(SHARED_ENDINGS), name),
        },
        "source_ip",
    )


def pivot(attacks: DataFrame) -> DataFrame:
    """One row: outside and inside addresses that reached shells, and whether there are both."""
    ips = attacks.where("kind = 'webshell' AND source_ip <> ''").groupBy("source_ip").count()
    inside = F.col("source_ip").rlike(r"^(192\.168\.|10\.|172\.)")
    return ips.agg(F.count_if(~inside).alias("external"), F.count_if(inside).alias("internal")).withColumn("pivot", (F.col("external") > 0) & (F.col("internal") > 0))


def powershell(ev: DataFrame) -> DataFrame:
    """Script events, and shell processes with an indicator; the first of the list that the content holds makes them high."""
    first = lambda text: F.get(F.filter(F.array(*map(F.lit, POWERSHELL_WORDS)), lambda w: text.contains(w)), F.lit(0))
    content, command = F.lower(F.coalesce(F.nullif("host_application", F.lit("")), F.nullif("script_block", F.lit("")), F.lit(""))), F.lower(F.coalesce("command_line", F.lit("")))
    started = F.lower(F.coalesce("process_name", F.lit(""))).contains("powershell") & first(command).isNotNull()
    rows = found(ev, {"script": (_is(POWERSHELL_CODES), first(content)), "process": (started, first(command))})
    return rows.select("row_id", "kind", F.col("what").alias("indicator"), F.when(F.col("what").isNotNull(), "HIGH").alias("severity"))


def filtered_connections(ev: DataFrame) -> DataFrame:
    """Distinct connections of the filtering platform with their protocol."""
    return ev.where(_is([5156, 5157])).select("source_ip", "dest_ip", "dest_port", "protocol").distinct()


#: Command lines, hosts and attributes that the test events take besides their own.
COMMANDS = ["whoami", "Invoke-WMIExec -Target x", "procdump64 -ma 588", "reg save HKLM\\SAM a", "dir"]
ATTRIBUTES = ["servicePrincipalName", "description", "adminCount", "member;range=0-10", "title"]
BLOCKS = ["Start-Sleep 9; x", "Get-Clipboard", "plain words", "timeout /t 9", "[Convert]::FromBase64String('x')"]


def _of(values: list[str], index: str = "k") -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(index) % len(values) + 1).cast("int"))


def category_events(s, d) -> DataFrame:
    """Test events with rows of memory tools and shares, attributes, scripts and addresses of both sides among them."""
    ev = security_events(s, d)
    part = F.col("row_id") % 40
    payload = {
        5: ("Memory_hashdump", F.struct(F.col("k").alias("rid"), F.lit("aa").alias("lmhash"), F.lit("bb").alias("nthash"))), 6: ("Memory_svcscan", F.struct(F.lit("Svc").alias("service_name"), F.lit("C:\\s.exe").alias("binary_path"))),
        7: ("Memory_handles", F.struct(F.when(F.col("k") % 2 == 0, "File").otherwise("Key").alias("handle_type"), F.lit("C:\\Data\\notes.txt").alias("handle_name"))),
        8: ("PCAP_SMB", F.struct(F.lit("\\\\srv\\c$").alias("tree_path"), F.when(F.col("k") % 2 == 0, "up.ASPX").otherwise("up.txt").alias("filename"), (F.col("k") % 3).alias("write_length"))),
    }
    kind, raw = F.col("event_type"), F.lit(None).cast("string")
    for i, (t, body) in payload.items():
        kind, raw = F.when(part == i, t).otherwise(kind), F.when(part == i, F.to_json(body)).otherwise(raw)
    more = {
        "event_type": kind, "raw_payload": raw, "attribute": F.when(F.col("k") % 7 > 0, _of(ATTRIBUTES)), "script_block": _of(BLOCKS), "host_application": F.when(F.col("k") % 4 == 0, "powershell -NoP"), "protocol": F.when(F.col("k") % 2 == 0, 6).otherwise(17),
        "source_ip": F.when(F.col("k") % 9 == 0, "203.0.113.80").otherwise(F.col("source_ip")), "parent_process_name": F.when(F.col("k") % 11 == 0, "WmiPrvSE.exe").otherwise(F.col("parent_process_name")), "command_line": F.when(F.col("row_id") % 3 == 0, _of(COMMANDS)).otherwise(F.col("command_line")),
    }
    return ev.withColumns(more)


def _ev(f):
    return lambda s, d: f(category_events(s, d))


# The same events for DuckDB, and the findings told by the values that the events take.
def _pick(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][CAST(k % {len(values)} + 1 AS INT)]"


_CAT = (
    SEC.replace("sec AS", "sec0 AS", 1) + ", sec AS (SELECT * REPLACE (CASE row_id % 40 WHEN 5 THEN 'Memory_hashdump' WHEN 6 THEN 'Memory_svcscan' WHEN 7 THEN 'Memory_handles' WHEN 8 THEN 'PCAP_SMB' ELSE event_type END AS event_type, CASE WHEN k % 9 = 0 THEN '203.0.113.80' ELSE source_ip END AS source_ip, "
    f"CASE WHEN k % 11 = 0 THEN 'WmiPrvSE.exe' ELSE parent_process_name END AS parent_process_name, CASE WHEN row_id % 3 = 0 THEN {_pick(COMMANDS)} ELSE command_line END AS command_line), row_id % 40 AS part, CASE WHEN k % 7 > 0 THEN {_pick(ATTRIBUTES)} END AS attribute, {_pick(BLOCKS)} AS block FROM sec0)"
)
_TOOL = "command_line IN ('procdump64 -ma 588', 'reg save HKLM\\SAM a', 'procdump.exe -accepteula -ma 588 lsass.dmp') OR process_name = 'mimikatz.exe' OR file_path = 'C:\\Temp\\lsass.dmp' OR target_image LIKE '%lsass.exe'"


def _rows(kinds: list[tuple[str, str, str]], more: str = "") -> str:
    return f"WITH {_CAT} " + " UNION ALL ".join(f"SELECT row_id, '{k}' AS kind, CAST({what} AS VARCHAR) AS what{more} FROM sec WHERE {test}" for k, test, what in kinds)


_OUT = "dest_ip IN ('198.51.100.7', '203.0.113.9')"
_FIRST = "CASE {} END"
QUERIES = {
    "fe_credential_access": _ev(credential_access), "fe_lateral_movement": _ev(lateral_movement), "fe_persistence": _ev(persistence), "fe_network": _ev(network), "fe_auth_timeline": _ev(auth_timeline), "fe_file_operations": _ev(file_operations),
    "fe_ad_changes": _ev(directory_changes), "fe_web_attacks": _ev(web_attacks), "web_pivot": _ev(lambda ev: pivot(web_attacks(ev))), "fe_powershell": _ev(powershell), "fe_wfp": _ev(filtered_connections),
}
_SHELLS = "uri IN ('/shell.aspx', '/cmd.aspx')"
_NAMED = "CASE logon_type WHEN 3 THEN 'Network' WHEN 10 THEN 'RemoteInteractive' WHEN 2 THEN 'Interactive' ELSE 'Unknown(99)' END"
ORACLES = {
    "fe_credential_access": _rows([("tool", f"({_TOOL})", "command_line"), ("auth", "event_code IN (4648, 4769, 4771, 4776)", "event_code"), ("lsass_access", "event_code = 10 AND (target_image LIKE '%lsass.exe' OR file_path LIKE '%lsass.dmp' OR command_line LIKE '%lsass.dmp')", "process_name"), ("hash_dump", "part = 5", "k || ':aa:bb'")]),
    "fe_lateral_movement": _rows([("network_logon", "event_code = 4624 AND logon_type = 3", "source_ip"), ("connection", "event_code = 3 AND dest_port IN (445, 3389)", "dest_port"), ("remote_child", "k % 11 = 0", "parent_process_name"), ("remote_command", "command_line LIKE 'Invoke-WMIExec%'", "command_line")]),
    "fe_persistence": _rows([("service", "event_code = 7045", "service_name"), ("random_service", "event_code = 7045 AND service_name IN ('XFBRJVUPQBBNMSAPIGNN', 'QWERTYUIOPASDFGH')", "service_name"), ("registry", "event_code = 13 AND registry_key NOT LIKE 'HKCU%'", "registry_key"), ("memory_service", "part = 6", "'Svc C:\\s.exe'"), ("task", "event_code = 4698", "command_line")]),
    "fe_network": _rows([("connection", "true", "dest_ip"), ("external", _OUT, "dest_ip"), ("dns", "event_code = 22", "query_name")], ", dest_port"),
    "fe_auth_timeline": f"WITH {_CAT}, a AS (SELECT row_id, timestamp_utc, event_code, username, {_NAMED} AS logon FROM sec WHERE event_code IN (4624, 4625, 4648, 4769, 4771, 4776)) SELECT *, count(*) OVER (PARTITION BY username) AS n FROM a",
    "fe_file_operations": f"WITH {_CAT} SELECT row_id, 'file' AS kind, file_path AS path, process_name, file_path NOT IN ('C:\\Data\\report.docx', 'C:\\Data\\a.locked') AS suspicious, file_path = 'C:\\Temp\\lsass.dmp' AS dump FROM sec WHERE event_code IN (11, 15, 23) UNION ALL SELECT row_id, 'handle', 'C:\\Data\\notes.txt', process_name, false, false FROM sec WHERE part = 7 AND k % 2 = 0",
    "fe_ad_changes": f"WITH {_CAT} SELECT row_id, event_code, attribute, CASE WHEN attribute IN ('servicePrincipalName', 'adminCount', 'member;range=0-10') THEN 'HIGH' ELSE 'MEDIUM' END AS level FROM sec WHERE event_code IN (4662, 5136)",
    "fe_web_attacks": _rows([("webshell", _SHELLS, "uri"), ("command_query", "query_string = 'cmd=whoami'", "query_string"), ("share_connect", "part = 8", "'\\\\srv\\c$'"), ("share_write", "part = 8 AND k % 3 > 0", "CASE WHEN k % 2 = 0 THEN 'up.ASPX' ELSE 'up.txt' END"), ("suspicious_write", "part = 8 AND k % 3 > 0 AND k % 2 = 0", "'up.ASPX'")], ", source_ip"),
    "web_pivot": f"WITH {_CAT}, p AS (SELECT DISTINCT source_ip FROM sec WHERE {_SHELLS}), n AS (SELECT count(*) FILTER (source_ip = '203.0.113.80') AS external, count(*) FILTER (source_ip <> '203.0.113.80') AS internal FROM p) SELECT *, external > 0 AND internal > 0 AS pivot FROM n",
    "fe_powershell": f"WITH {_CAT}, s AS (SELECT row_id, 'script' AS kind, CASE WHEN k % 4 = 0 THEN '-nop' WHEN block LIKE 'Start-Sleep%' THEN 'start-sleep' WHEN block = 'Get-Clipboard' THEN 'get-clipboard' WHEN block LIKE 'timeout%' THEN 'timeout /t' WHEN block LIKE '%FromBase64String%' THEN 'frombase64string' END AS indicator FROM sec WHERE event_code IN (400, 4104) "
    "UNION ALL SELECT row_id, 'process', CASE WHEN command_line LIKE '%-enc %' THEN '-enc' WHEN command_line LIKE 'Invoke-WMIExec%' THEN 'iex' ELSE 'downloadstring' END FROM sec WHERE process_name = 'powershell.exe' AND (command_line LIKE '%-enc %' OR command_line LIKE '%DownloadString%' OR command_line LIKE 'Invoke-WMIExec%')) SELECT row_id, kind, indicator, CASE WHEN indicator IS NOT NULL THEN 'HIGH' END AS severity FROM s",
    "fe_wfp": f"WITH {_CAT} SELECT DISTINCT source_ip, dest_ip, dest_port, CASE WHEN k % 2 = 0 THEN 6 ELSE 17 END AS protocol FROM sec WHERE event_code IN (5156, 5157)",
}
