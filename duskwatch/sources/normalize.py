"""Normalisation jobs: tables of raw lines or JSON texts to event columns, by expressions alone.

Each ``norm_*`` takes a table (row_id, value) and gives event columns with the row's id; lines that
don't match are left out (``rejects`` gives them).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..adapters import SEC, security_events, table
from ..functions import scalars as S
from .io import conform, scan_events

IP = r"(\d{1,3}(?:\.\d{1,3}){3})"


def parts(df: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Groups of a pattern as columns; empty and ``-`` become null; only lines that match stay."""
    cols = [F.nullif(F.nullif(F.regexp_extract("value", pattern, i + 1), F.lit("")), F.lit("-")).alias(n) for i, n in enumerate(names)]
    return df.where(F.col("value").rlike(pattern)).select("row_id", *cols)


def rejects(df: DataFrame, pattern: str) -> DataFrame:
    return df.where(~F.col("value").rlike(pattern) | F.col("value").isNull())


def _at(text: Column, fmt: str) -> Column:
    return F.try_to_timestamp(text, F.lit(fmt))


def status_severity(status: Column) -> Column:
    return F.when(status >= 500, "medium").when(status >= 400, "low").otherwise("info")


ACCESS = rf"^{IP} \S+ (\S+) \[([^\]]+)\] \"(\S+) ([^ ?\"]*)(?:\?([^ \"]*))? HTTP/[0-9.]+\" (\d{{3}}) \S+ \"([^\"]*)\" \"([^\"]*)\""


def norm_access(df: DataFrame) -> DataFrame:
    """Combined access log of Apache and nginx."""
    p = parts(df, ACCESS, ["source_ip", "username", "t", "http_method", "uri", "query_string", "s", "referrer", "user_agent"])
    status = F.col("s").try_cast("bigint")
    return p.select("row_id", _at(F.col("t"), "dd/MMM/yyyy:HH:mm:ss Z").alias("timestamp_utc"), "source_ip", "http_method", "uri", "query_string", status.alias("status_code"), "user_agent", status_severity(status).alias("severity"))


# What a message says, and its severity; the first that fits counts.
SYSLOG_SEVERITIES = [
    ("authentication failure", "medium"), ("failed password", "medium"), ("invalid user", "medium"), ("did not receive identification", "low"), ("break-in attempt", "high"), ("refused connect", "low"), ("accepted.*root", "medium"), (r"sudo:.*command", "low"),
    (r"su\[.*\].*to root", "medium"), ("new user", "medium"), ("useradd", "medium"), ("usermod", "medium"), ("userdel", "medium"), ("passwd.*changed", "medium"),
]
SYSLOG_USERS = [r"(?i)user[=:\s]+(\S+)", r"(?i)for\s+(?:user\s+)?(\S+)", r"(?i)user\s+'([^']+)'"]


def first_rule(text: Column, rules: list[tuple[str, str]], otherwise: str = "info") -> Column:
    """What the first pattern that a text fits says."""
    out = F.lit(otherwise)
    for pattern, value in reversed(rules):
        out = F.when(text.rlike(pattern), value).otherwise(out)
    return out


def norm_syslog(df: DataFrame, year: int) -> DataFrame:
    """RFC 3164 and RFC 5424 lines; the year of the first is given."""
    old = parts(df, r"^(?:<\d+>)?([A-Z][a-z]{2}\s+\d{1,2}\s+\d\d:\d\d:\d\d)\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+(.*)$", ["t", "source_system", "process_name", "pid", "m"]).withColumn("timestamp_utc", _at(F.concat(F.lit(f"{year} "), F.regexp_replace("t", r"\s+", " ")), "yyyy MMM d HH:mm:ss"))
    new = parts(df, r"^<\d+>\d*\s*(\d{4}-\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+\S+\s+(.*)$", ["t", "source_system", "process_name", "pid", "m"]).withColumn("timestamp_utc", S.timestamp_of(F.col("t")))
    both = old.unionByName(new)
    found = lambda p: F.nullif(F.regexp_extract("m", p, 1), F.lit(""))
    severity = first_rule(F.lower(F.coalesce("m", F.lit(""))), SYSLOG_SEVERITIES)
    return both.select("row_id", "timestamp_utc", "source_system", "process_name", F.col("pid").try_cast("bigint").alias("process_id"), F.coalesce(*map(found, SYSLOG_USERS)).alias("username"), found(rf"from\s+{IP}").alias("source_ip"), found(r"port\s+(\d+)").try_cast("bigint").alias("source_port"), severity.alias("severity"))



def norm_squid(df: DataFrame) -> DataFrame:
    """Proxy lines, native or in the common log form."""
    native = parts(df, r"^(\d+\.\d+)\s+\d+\s+(\S+)\s+(\S+)\s+\d+\s+(\S+)\s+(\S+)(?:\s+(\S+))?", ["t", "source_ip", "r", "http_method", "uri", "username"])
    native = native.withColumn("timestamp_utc", F.timestamp_micros(F.round(F.col("t").cast("decimal(20,6)") * 1_000_000).cast("bigint"))).withColumn("s", F.regexp_extract("r", r"/(\d+)", 1))
    common = parts(df, r'^(\S+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+[^"]+"\s+(\d+)\s+\d+', ["source_ip", "username", "t", "http_method", "uri", "s"])
    common = common.withColumn("timestamp_utc", _at(F.col("t"), "dd/MMM/yyyy:HH:mm:ss Z")).withColumn("r", F.col("s"))
    both = native.unionByName(common)
    bad = F.upper(F.coalesce("r", F.lit(""))).rlike("DENIED|BLOCKED") | F.lower(F.coalesce("uri", F.lit(""))).rlike(r"\.exe$|\.dll$|\.ps1$|\.bat$|pastebin\.|raw\.github|bit\.ly|tinyurl")
    return both.select("row_id", "timestamp_utc", "source_ip", "username", "http_method", "uri", F.col("s").try_cast("bigint").alias("status_code"), F.when(bad, "medium").otherwise("info").alias("severity"))



def norm_haproxy(df: DataFrame, year: int = 2024) -> DataFrame:
    """Load balancer lines behind a syslog head, else any with a client, a status and a request; the latter have no time."""
    full = r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d\d:\d\d:\d\d)\s+(\S+)\s+\S+\[\d+\]:\s+([\d.]+):(\d+)\s+\[[^\]]+\]\s+\S+\s+\S+/\S+\s+\S+\s+(\d{3})\s+.*\"(\S+)\s+(\S+)"
    simple = r"([\d.]+):(\d+).*?(\d{3}).*?(GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH)\s+(\S+)"
    whole = parts(df, full, ["t", "source_system", "source_ip", "port", "s", "http_method", "uri"]).withColumn("timestamp_utc", _at(F.concat(F.lit(f"{year} "), F.regexp_replace("t", r"\s+", " ")), "yyyy MMM d HH:mm:ss")).drop("t")
    other = parts(df.where(~F.col("value").rlike(full)), simple, ["source_ip", "port", "s", "http_method", "uri"])
    both = whole.unionByName(other, allowMissingColumns=True)
    status = F.col("s").try_cast("bigint")
    return both.select("row_id", "timestamp_utc", "source_system", "source_ip", F.col("port").try_cast("bigint").alias("source_port"), "http_method", "uri", status.alias("status_code"), status_severity(status).alias("severity"))



# Messages of interest: denials, failed logons, tunnels, threats.
ASA_MESSAGES = [
    "106001", "106006", "106007", "106014", "106015", "106023", "113004", "113005", "113012", "113015", "713228", "722051", "722037", "733100", "733101", "733102", "733103", "733104", "733105", "419001", "419002", "710003",
]


def norm_asa(df: DataFrame) -> DataFrame:
    """Firewall messages ``%ASA-level-id``: the two first addresses and ports; messages of interest are high."""
    p = parts(df, r"%ASA-(\d)-(\d{6}): (.*)$", ["level", "id", "m"])
    ips, ports = F.regexp_extract_all("m", F.lit(IP), F.lit(1)), F.regexp_extract_all("m", F.lit(r"/(\d+)"), F.lit(1))
    level = F.col("level").cast("int")
    severity = F.when(F.col("id").isin(ASA_MESSAGES), "high").when(level <= 2, "critical").when(level == 3, "high").when(level == 4, "medium").when(level == 5, "low").otherwise("info")
    return p.select("row_id", F.concat(F.lit("ASA_"), "id").alias("event_type"), F.get(ips, F.lit(0)).alias("source_ip"), F.get(ips, F.lit(1)).alias("dest_ip"), F.get(ports, F.lit(0)).try_cast("bigint").alias("source_port"), F.get(ports, F.lit(1)).try_cast("bigint").alias("dest_port"), severity.alias("severity"))



# Protocol numbers of flow logs.
PROTOCOLS = {"1": "ICMP", "6": "TCP", "17": "UDP", "47": "GRE", "50": "ESP"}


def norm_vpcflow(df: DataFrame) -> DataFrame:
    """Flow records as text or as JSON; rejected ones are medium, those without data low."""
    text = parts(df, rf"^[2-5] \S+ \S+ (\S+) (\S+) (\S+) (\S+) (\S+) \S+ \S+ (\S+) \S+ (\S+) (\S+)$", ["source_ip", "dest_ip", "sp", "dp", "proto", "t", "action", "state"])
    keys = {"source_ip": "srcaddr", "dest_ip": "dstaddr", "sp": "srcport", "dp": "dstport", "proto": "protocol", "t": "start", "action": "action", "state": "log-status"}
    record = df.where(F.col("value").startswith("{")).select("row_id", F.from_json("value", "map<string,string>").alias("j"))
    both = text.unionByName(record.select("row_id", *[F.try_element_at("j", F.lit(k)).alias(n) for n, k in keys.items()]))
    proto = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PROTOCOLS.items() for x in kv]), F.col("proto")), F.col("proto"))
    severity = F.when(F.upper("action") == "REJECT", "medium").when(F.upper("state").isin("NODATA", "SKIPDATA"), "low").otherwise("info")
    return both.select("row_id", F.timestamp_seconds(F.col("t").try_cast("bigint")).alias("timestamp_utc"), F.concat_ws("_", F.lit("VPCFlow"), "action", proto).alias("event_type"), "source_ip", "dest_ip", F.col("sp").try_cast("bigint").alias("source_port"), F.col("dp").try_cast("bigint").alias("dest_port"), severity.alias("severity"))



def norm_paloalto(df: DataFrame) -> DataFrame:
    """Comma-separated firewall lines: kind, first two addresses and first two ports by shape."""
    cells = F.split("value", ",")
    ips = F.filter(cells, lambda c: c.rlike(rf"^{IP}$"))
    ports = F.filter(cells, lambda c: c.rlike(r"^\d{1,5}$") & (c.try_cast("int") <= 65535))
    kind = F.get(F.filter(F.slice(cells, 1, 10), lambda c: c.isin("TRAFFIC", "THREAT", "SYSTEM", "CONFIG")), F.lit(0))
    threat = F.when(F.col("value").contains("critical"), "critical").when(F.col("value").contains("high"), "high").otherwise("info")
    return df.select("row_id", kind.alias("event_type"), F.get(ips, F.lit(0)).alias("source_ip"), F.get(ips, F.lit(1)).alias("dest_ip"), F.get(ports, F.lit(0)).cast("bigint").alias("source_port"), F.get(ports, F.lit(1)).cast("bigint").alias("dest_port"), threat.alias("severity"))


def field(*paths: str) -> Column:
    """The first of some JSON paths that holds a value."""
    return F.coalesce(*[F.get_json_object("value", p) for p in paths])


def norm_suricata(df: DataFrame) -> DataFrame:
    level = field("$.alert.severity").try_cast("int")
    return df.select("row_id", S.timestamp_of(field("$.timestamp")).alias("timestamp_utc"), F.concat(F.lit("Suricata_"), field("$.event_type")).alias("event_type"), field("$.src_ip").alias("source_ip"), field("$.dest_ip").alias("dest_ip"), field("$.dest_port").try_cast("bigint").alias("dest_port"), F.concat(F.lit("http://"), field("$.http.hostname"), field("$.http.url")).alias("uri"), F.when(level == 1, "high").when(level == 2, "medium").when(level == 3, "low").otherwise("info").alias("severity"))


# Risky operations of each source.
CLOUDTRAIL_RISKY = [
    "ConsoleLogin", "CreateUser", "CreateAccessKey", "DeleteTrail", "StopLogging", "PutBucketPolicy", "PutRolePolicy", "AttachUserPolicy", "AttachRolePolicy", "CreateRole", "AssumeRole", "GetSecretValue",
    "CreateKeyPair", "RunInstances", "CreateSecurityGroup", "AuthorizeSecurityGroupIngress", "ModifySnapshotAttribute", "CreateDBSnapshot", "ModifyDBSnapshotAttribute",
]
AZURE_RISKY = [
    "Add member to role", "Add owner to application", "Add owner to service principal", "Add app role assignment grant to user", "Consent to application", "Add delegated permission grant", "Add application credentials",
    "Update application - Certificates and secrets management", "Add service principal credentials", "Reset password", "Add user", "Delete user", "Hard delete user", "Update user", "Add member to group", "Add owner to group",
]
GCP_RISKY = ["SetIamPolicy", "CreateServiceAccount", "CreateServiceAccountKey", "CreateRole", "UpdateRole", "CreateInstance", "DeleteInstance", "CreateFirewallRule", "UpdateFirewallRule", "CreateBucket", "UpdateBucket", "CreateSecret", "AccessSecretVersion", "AddMember", "RemoveMember"]
O365_RISKY = [
    "UserLoggedIn", "UserLoginFailed", "ForeignRealmIndexLogonInitialAuthUsingADFSFederatedToken", "MailboxLogin", "MailItemsAccessed", "SendAs", "SendOnBehalf", "FileDownloaded", "FileSyncDownloadedFull", "FileAccessed",
    "Add-MailboxPermission", "Set-Mailbox", "New-InboxRule", "Set-InboxRule", "New-TransportRule", "Add member to role", "Add application", "Consent to application", "Add delegated permission grant",
    "Add app role assignment grant to user", "Add service principal credentials", "Update application", "Disable account", "Reset user password", "Set domain authentication", "Set federation settings on domain",
]
OKTA_RISKY = [
    "user.session.start", "user.authentication.sso", "user.authentication.auth_via_mfa", "user.account.lock", "user.account.unlock", "user.mfa.factor.deactivate", "user.mfa.factor.reset_all", "user.lifecycle.create",
    "user.lifecycle.delete.initiated", "user.lifecycle.suspend", "user.lifecycle.unsuspend", "user.lifecycle.activate", "user.lifecycle.deactivate", "group.user_membership.add", "group.user_membership.remove",
    "application.user_membership.add", "application.user_membership.remove", "policy.lifecycle.update", "policy.rule.update", "security.threat.detected", "security.password_spray.detected", "security.brute_force.detected",
    "system.api_token.create", "system.api_token.revoke",
]
#: Source: (risky names, whether a part of the name counts, what marks a failed call, whether a failure outweighs the name).
CLOUD_RULES = {
    "CloudTrail": (CLOUDTRAIL_RISKY, False, "^.+$", False),
    "AzureAD": (AZURE_RISKY, False, "^failure$", False),
    "GCP": (GCP_RISKY, True, "^0*[1-9][0-9]*$", True),
    "O365": (O365_RISKY, False, "(?i)^(failed|partialfailure)$", True),
    "Okta": (OKTA_RISKY, False, "(?i)^(failure|deny)$", True),
}


def norm_cloud(df: DataFrame, kind: str, name: tuple[str, ...], user: tuple[str, ...], ip: tuple[str, ...], error: tuple[str, ...], at: tuple[str, ...]) -> DataFrame:
    """One shape for audit logs: risky names are high, failed calls medium, by the rules of each source; names of failures in O365 are medium, what Okta calls a threat is high."""
    op = field(*name)
    names, part, mark, outweighs = CLOUD_RULES[kind]
    risky = F.exists(F.array(*map(F.lit, names)), lambda r: F.lower(op).contains(F.lower(r))) if part else op.isin(names)
    failed = F.coalesce(field(*error), F.lit("")).rlike(mark)
    first, second = ((failed, "medium"), (risky, "high")) if outweighs else ((risky, "high"), (failed, "medium"))
    severity = F.when(*first).when(*second).otherwise("info")
    if kind == "O365":
        severity = F.when((severity == "info") & op.rlike("Failed|Error"), "medium").otherwise(severity)
    if kind == "Okta":
        severity = F.when(F.coalesce(field("$.securityContext.isThreat"), F.lit("")) == "true", "high").otherwise(severity)
    return df.select("row_id", S.timestamp_of(field(*at)).alias("timestamp_utc"), F.concat(F.lit(kind + "_"), op).alias("event_type"), field(*user).alias("username"), field(*ip).alias("source_ip"), severity.alias("severity"))


CLOUD = {
    "norm_cloudtrail": ("CloudTrail", ("$.eventName",), ("$.userIdentity.userName", "$.userIdentity.principalId", "$.userIdentity.arn"), ("$.sourceIPAddress",), ("$.errorCode",), ("$.eventTime",)),
    "norm_azure_ad": ("AzureAD", ("$.activityDisplayName",), ("$.initiatedBy.user.userPrincipalName",), ("$.ipAddress",), ("$.result",), ("$.activityDateTime",)),
    "norm_gcp": ("GCP", ("$.protoPayload.methodName",), ("$.protoPayload.authenticationInfo.principalEmail",), ("$.protoPayload.requestMetadata.callerIp",), ("$.protoPayload.status.code",), ("$.timestamp",)),
    "norm_o365": ("O365", ("$.Operation",), ("$.UserId",), ("$.ClientIP",), ("$.ResultStatus",), ("$.CreationTime",)),
    "norm_okta": ("Okta", ("$.eventType",), ("$.actor.alternateId",), ("$.client.ipAddress",), ("$.outcome.result",), ("$.published",)),
}


def norm_csv(spark, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """Any CSV with a header: event columns by the first alias that the file has."""
    raw = spark.read.option("header", "true").csv(path)
    low = {c.lower().strip(): c for c in raw.columns}
    picked = {name: next((F.col(f"`{low[a]}`") for a in names if a in low), F.lit(None).cast("string")) for name, names in aliases.items()}
    return conform(raw.select(*[c.alias(n) for n, c in picked.items()], F.to_json(F.struct("*")).alias("raw_payload")))


def _clock(fmt: str) -> Column:
    return F.date_format("timestamp_utc", fmt)


LINES: dict[str, Callable[[], Column]] = {
    "access": lambda: F.format_string('%s - %s [%s] "%s %s?%s HTTP/1.1" %d 123 "-" "%s"', "source_ip", "username", _clock("dd/MMM/yyyy:HH:mm:ss +0000"), "http_method", "uri", F.replace("query_string", F.lit(" "), F.lit("+")), "status_code", "user_agent"),
    "syslog": lambda: F.concat(_clock("MMM d HH:mm:ss"), F.format_string(" %s sshd[%d]: ", "source_system", "process_id"), F.element_at(F.array(F.lit("Failed password for "), F.lit("POSSIBLE BREAK-IN ATTEMPT for "), F.lit("session opened for "), F.lit("Accepted key, root, for ")), (F.col("k") % 4 + 1).cast("int")), F.format_string("%s from %s port %d ssh2", "username", "source_ip", "dest_port")),
    "squid": lambda: F.when(F.col("k") % 2 == 0, F.format_string("%s 12 %s TCP_%s/%d 99 %s http://x%s %s -", F.format_string("%.3f", F.unix_millis("timestamp_utc") / 1000), "source_ip", F.when(F.col("k") % 4 == 0, "DENIED").otherwise("MISS"), "status_code", "http_method", "uri", "username")).otherwise(F.format_string('%s - %s [%s] "%s http://bit.ly%s HTTP/1.1" %d 99', "source_ip", "username", _clock("dd/MMM/yyyy:HH:mm:ss +0000"), "http_method", "uri", "status_code")),
    "haproxy": lambda: F.when(F.col("k") % 2 == 0, F.format_string('%s %s haproxy[1]: %s:%d [01/Jan/2024:00:00:00.000] fe be/s1 0/0/1/2/3 %d 99 - - ---- 1/1/0/0/0 0/0 "%s %s HTTP/1.1"', _clock("MMM d HH:mm:ss"), "source_system", "source_ip", "dest_port", "status_code", "http_method", "uri")).otherwise(F.format_string("from %s:%d - status %d POST %s", "source_ip", "dest_port", "status_code", "uri")),
    "asa": lambda: F.format_string("Jan 1 00:00:00 fw %%ASA-%d-%s: Built connection for outside:%s/%d to inside:%s/80", (F.col("k") % 8).cast("int"), F.when(F.col("k") % 3 == 0, "106023").otherwise("302013"), "source_ip", "dest_port", "dest_ip"),
    "vpcflow": lambda: F.when(F.col("k") % 5 == 0, F.to_json(F.struct(F.col("source_ip").alias("srcaddr"), F.col("dest_ip").alias("dstaddr"), F.col("dest_port").alias("srcport"), F.lit(80).alias("dstport"), F.lit("17").alias("protocol"), F.unix_seconds("timestamp_utc").alias("start"), F.lit("ACCEPT").alias("action"), F.lit("NODATA").alias("log-status")))).otherwise(F.format_string("2 acct eni %s %s %d 80 %d 1 1 %d 0 %s OK", "source_ip", "dest_ip", "dest_port", F.when(F.col("k") % 2 == 0, 6).otherwise(17), F.unix_seconds("timestamp_utc"), F.when(F.col("k") % 3 == 0, "REJECT").otherwise("ACCEPT"))),
    "paloalto": lambda: F.concat_ws(",", F.lit("x"), F.when(F.col("k") % 2 == 0, "THREAT").otherwise("TRAFFIC"), "source_ip", "dest_ip", F.col("dest_port").cast("string"), F.lit("80"), F.when(F.col("k") % 3 == 0, "high").otherwise("low")),
    "jsonl": lambda: F.to_json(F.struct(F.struct(_clock("yyyy-MM-dd'T'HH:mm:ss").alias("time"), F.col("event_type").alias("type")).alias("event"), F.col("username").alias("user"), "source_ip")),
    "suricata": lambda: F.to_json(F.struct(_clock("yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.lit("alert").alias("event_type"), F.col("source_ip").alias("src_ip"), "dest_ip", "dest_port", F.struct((F.col("k") % 5).alias("severity")).alias("alert"), F.struct(F.col("query_name").alias("hostname"), F.col("uri").alias("url")).alias("http"))),
}


def _lines(fmt: str):
    return lambda s, d: security_events(s, d).select("row_id", LINES[fmt]().alias("value"))


def _from(fmt: str, f):
    return lambda s, d: f(_lines(fmt)(s, d))


#: What the test events say: all risky names and two others, and a failure of each source.
CLOUD_NAMES = {kind: [*rule[0], "Read", "List"] for kind, rule in CLOUD_RULES.items()}
CLOUD_FAILURES = {"CloudTrail": "AccessDenied", "AzureAD": "failure", "GCP": "7", "O365": "Failed", "Okta": "FAILURE"}


def _cloud(name: str):
    kind, op, user, ip, error, at = CLOUD[name]

    def run(s, d):
        def build(leaves: dict[str, Column]) -> Column:
            groups: dict[str, dict] = {}
            for path, value in leaves.items():
                head, _, tail = path.partition(".")
                groups.setdefault(head, {})[tail] = value
            return F.struct(*[(sub[""] if "" in sub else build(sub)).alias(head) for head, sub in groups.items()])

        ev = security_events(s, d)
        risky = F.element_at(F.array(*map(F.lit, CLOUD_NAMES[kind])), (F.col("k") % len(CLOUD_NAMES[kind]) + 1).cast("int"))
        leaves = {op[0][2:]: risky, user[0][2:]: F.col("username"), ip[0][2:]: F.col("source_ip"), error[0][2:]: F.when(F.col("row_id") % 2 == 0, CLOUD_FAILURES[kind]).otherwise(""), at[0][2:]: _clock("yyyy-MM-dd'T'HH:mm:ss")}
        return norm_cloud(ev.select("row_id", F.to_json(build(leaves)).alias("value")), kind, op, user, ip, error, at)

    return run


def _cloud_sql(name: str) -> str:
    kind = CLOUD[name][0]
    n, names = len(CLOUD_NAMES[kind]), "[" + ", ".join(f"'{x}'" for x in CLOUD_NAMES[kind]) + "]"
    high, medium = f"WHEN k % {n} < {n - 2} THEN 'high'", "WHEN row_id % 2 = 0 THEN 'medium'"
    order = f"{medium} {high}" if kind in ("GCP", "O365", "Okta") else f"{high} {medium}"
    return f"WITH {SEC} SELECT row_id, date_trunc('second', timestamp_utc) AS timestamp_utc, '{kind}_' || {names}[CAST(k % {n} + 1 AS INT)] AS event_type, username, source_ip, CASE {order} ELSE 'info' END AS severity FROM sec"


_STATUS = "CASE WHEN status_code >= 500 THEN 'medium' WHEN status_code >= 400 THEN 'low' ELSE 'info' END"
#: Severity and type of the test lines, for DuckDB.
ASA_LEVEL = "CASE WHEN k % 3 = 0 THEN 'high' WHEN k % 8 <= 2 THEN 'critical' WHEN k % 8 = 3 THEN 'high' WHEN k % 8 = 4 THEN 'medium' WHEN k % 8 = 5 THEN 'low' ELSE 'info' END"
FLOW_TYPE = "'VPCFlow_' || CASE WHEN k % 5 = 0 THEN 'ACCEPT_UDP' ELSE CASE WHEN k % 3 = 0 THEN 'REJECT' ELSE 'ACCEPT' END || CASE WHEN k % 2 = 0 THEN '_TCP' ELSE '_UDP' END END"
FLOW_LEVEL = "CASE WHEN k % 5 = 0 THEN 'low' WHEN k % 3 = 0 THEN 'medium' ELSE 'info' END"
_SEC_TS = "date_trunc('second', timestamp_utc) AS timestamp_utc"

QUERIES = {
    "scan_events": lambda s, d: scan_events(s, f"{d}/events.parquet").groupBy(F.regexp_extract("_source_parquet", r"([a-z]+)[^/]*$", 1).isNotNull().alias("named")).agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("types")),
    "sink_events": lambda s, d: conform(security_events(s, d).drop("event_code", "user_id")).select("timestamp_utc", "source_file", "source_line", "event_type", "process_id", "command_line", "registry_value"),
    "union_sources": lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")).unionByName(table(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").cast("double").alias("balance")), allowMissingColumns=True),
    "norm_apache": _from("access", norm_access),
    "norm_nginx": _from("access", norm_access),
    "norm_syslog": _from("syslog", lambda x: norm_syslog(x, 2024)),
    "norm_squid": _from("squid", norm_squid),
    "norm_haproxy": _from("haproxy", norm_haproxy),
    "norm_cisco_asa": _from("asa", norm_asa),
    "norm_vpcflow": _from("vpcflow", norm_vpcflow),
    "norm_paloalto": _from("paloalto", norm_paloalto),
    "norm_suricata": _from("suricata", norm_suricata),
    **{name: _cloud(name) for name in CLOUD},
}
ORACLES = {
    "scan_events": "SELECT true AS named, count(*) AS n, count(DISTINCT event_type) AS types FROM events",
    "sink_events": f"WITH {SEC} SELECT timestamp_utc, source_file, CAST(NULL AS BIGINT) AS source_line, event_type, process_id, command_line, CAST(NULL AS VARCHAR) AS registry_value FROM sec",
    "union_sources": "SELECT c_custkey AS key, c_name AS name, CAST(NULL AS DOUBLE) AS balance FROM customer UNION ALL SELECT s_suppkey, NULL, CAST(s_acctbal AS DOUBLE) FROM supplier",
    "norm_apache": f"WITH {SEC} SELECT row_id, {_SEC_TS}, source_ip, http_method, uri, nullif(replace(query_string, ' ', '+'), '') AS query_string, CAST(status_code AS BIGINT) AS status_code, user_agent, {_STATUS} AS severity FROM sec",
    "norm_syslog": f"WITH {SEC} SELECT row_id, {_SEC_TS}, source_system, 'sshd' AS process_name, process_id, username, source_ip, CAST(dest_port AS BIGINT) AS source_port, ['medium', 'high', 'info', 'medium'][CAST(k % 4 + 1 AS INT)] AS severity FROM sec",
    "norm_squid": f"WITH {SEC} SELECT row_id, CASE WHEN k % 2 = 0 THEN date_trunc('millisecond', timestamp_utc) ELSE date_trunc('second', timestamp_utc) END AS timestamp_utc, source_ip, username, http_method, CASE WHEN k % 2 = 0 THEN 'http://x' ELSE 'http://bit.ly' END || uri AS uri, CAST(status_code AS BIGINT) AS status_code, CASE WHEN k % 4 = 2 THEN 'info' ELSE 'medium' END AS severity FROM sec",
    "norm_haproxy": f"WITH {SEC} SELECT row_id, CASE WHEN k % 2 = 0 THEN date_trunc('second', timestamp_utc) END AS timestamp_utc, CASE WHEN k % 2 = 0 THEN source_system END AS source_system, source_ip, CAST(dest_port AS BIGINT) AS source_port, CASE WHEN k % 2 = 0 THEN http_method ELSE 'POST' END AS http_method, uri, CAST(status_code AS BIGINT) AS status_code, {_STATUS} AS severity FROM sec",
    "norm_cisco_asa": f"WITH {SEC} SELECT row_id, CASE WHEN k % 3 = 0 THEN 'ASA_106023' ELSE 'ASA_302013' END AS event_type, source_ip, dest_ip, CAST(dest_port AS BIGINT) AS source_port, CAST(80 AS BIGINT) AS dest_port, {ASA_LEVEL} AS severity FROM sec",
    "norm_vpcflow": f"WITH {SEC} SELECT row_id, {_SEC_TS}, {FLOW_TYPE} AS event_type, source_ip, dest_ip, CAST(dest_port AS BIGINT) AS source_port, CAST(80 AS BIGINT) AS dest_port, {FLOW_LEVEL} AS severity FROM sec",
    "norm_paloalto": f"WITH {SEC} SELECT row_id, CASE WHEN k % 2 = 0 THEN 'THREAT' ELSE 'TRAFFIC' END AS event_type, source_ip, dest_ip, CAST(dest_port AS BIGINT) AS source_port, CAST(80 AS BIGINT) AS dest_port, CASE WHEN k % 3 = 0 THEN 'high' ELSE 'info' END AS severity FROM sec",
    "norm_suricata": f"WITH {SEC} SELECT row_id, {_SEC_TS}, 'Suricata_alert' AS event_type, source_ip, dest_ip, CAST(dest_port AS BIGINT) AS dest_port, 'http://' || query_name || uri AS uri, CASE k % 5 WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity FROM sec",
    **{name: _cloud_sql(name) for name in CLOUD},
}
ORACLES["norm_nginx"] = ORACLES["norm_apache"]
