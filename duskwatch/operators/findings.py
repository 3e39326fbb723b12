"""Findings: assembly, technique status, hypotheses, claims against events, packages and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..adapters import SEC, security_events, table
from ..functions import scalars as S
from . import detect, relate
from .indicators import TABLE as _IOC
from .indicators import indicator_events, ioc_table
from .search import found_in

# Trigger words of the hypotheses.
HYPOTHESES = {
    "Web Application Compromise": ["webshell", "cmd=", "exec=", "w3wp.exe", "cmd.exe", "iis"],
    "Credential Theft": ["lsass", "mimikatz", "sekurlsa", "procdump", "credential"],
    "Lateral Movement": ["psexec", "wmi", "winrm", "remote", "4648", "pass-the-hash"],
    "Persistence Mechanism": ["schtasks", "service", "7045", "run key", "registry", "startup"],
    "Internal Reconnaissance": ["whoami", "net user", "net group", "systeminfo", "ipconfig", "nltest"],
    "Data Exfiltration": ["compress", "archive", "zip", "rar", "upload", "transfer", "external"],
    "Defense Evasion": ["clear", "1102", "log", "disable", "tamper", "bypass"],
}
# Tactics of the techniques that signatures name, and the order of tactics.
TACTICS = {"T1003": "Credential Access", "T1003.001": "Credential Access", "T1003.002": "Credential Access", "T1003.003": "Credential Access", "T1047": "Execution", "T1021.002": "Lateral Movement", "T1505.003": "Persistence", "T1033": "Discovery", "T1016": "Discovery", "T1082": "Discovery", "T1057": "Discovery", "T1053.005": "Persistence", "T1547.001": "Persistence", "T1543.003": "Persistence", "T1070.001": "Defense Evasion", "T1070.006": "Defense Evasion", "T1059.001": "Execution", "T1105": "Command and Control"}
TACTIC_ORDER = ["Initial Access", "Execution", "Persistence", "Privilege Escalation", "Defense Evasion", "Credential Access", "Discovery", "Lateral Movement", "Collection", "Command and Control", "Exfiltration", "Impact"]
LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def matches(ev: DataFrame) -> DataFrame:
    return detect.rule_scan(ev, rules.SIGNATURES)


def indicators(ev: DataFrame) -> DataFrame:
    """Names of rules that matched and of event ids that occurred."""
    return matches(ev).select(F.col("rule").alias("name")).union(ev.select(F.concat(F.lit("event_"), F.col("event_code").cast("string")))).distinct()


def technique_status(found: DataFrame) -> DataFrame:
    """CONFIRMED with all required indicators, LIKELY with half of them, POSSIBLE with a supporting one."""
    rows = [(t, "required", i, len(req), n) for t, req, _ in rules.TECHNIQUES for i, alts in enumerate(req) for n in alts] + [(t, "supporting", 0, len(req), n) for t, req, sup in rules.TECHNIQUES for n in sup]
    r = found.sparkSession.createDataFrame(rows, "technique string, kind string, part int, parts int, name string")
    j = r.join(found.withColumn("hit", F.lit(1)), "name", "left")
    g = j.groupBy("technique", "parts").agg(F.countDistinct(F.when((F.col("kind") == "required") & (F.col("hit") == 1), F.col("part"))).alias("met"), F.max(F.when((F.col("kind") == "supporting") & (F.col("hit") == 1), 1).otherwise(0)).alias("support"))
    return g.select("technique", F.when(F.col("met") == F.col("parts"), "CONFIRMED").when(F.col("met") * 2 >= F.col("parts"), "LIKELY").when(F.col("support") == 1, "POSSIBLE").otherwise("NOT_DETECTED").alias("status"))


def attack_map(ev: DataFrame) -> DataFrame:
    """The first match of each technique, with its tactic."""
    w = W.partitionBy("technique").orderBy("row_id", "rule", "field")
    names = F.create_map(*[F.lit(x) for kv in TACTICS.items() for x in kv])
    return matches(ev).withColumn("nr", F.row_number().over(w)).where("nr = 1").select("technique", "row_id", "rule", F.coalesce(F.try_element_at(names, F.col("technique")), F.lit("Unknown")).alias("tactic"))


def strategy(ev: DataFrame) -> DataFrame:
    m = attack_map(ev)
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, TACTIC_ORDER)), F.col("tactic")), F.lit(0)), F.lit(99))
    return m.select("technique", "tactic", place.cast("long").alias("place")).withColumn("rank", F.row_number().over(W.orderBy("place", "technique")).cast("long"))  # a row for each technique


def hypotheses(ev: DataFrame) -> DataFrame:
    """Hypotheses by the number of their trigger words that occur in findings' texts."""
    text = matches(ev).select(F.lower("matched").alias("t")).distinct()
    hits = F.array_compact(F.array(*[F.when(F.col("t").contains(w), F.struct(F.lit(h).alias("hypothesis"), F.lit(w).alias("word"))) for h, ws in HYPOTHESES.items() for w in ws]))
    g = text.select(F.explode(hits).alias("x")).select("x.*").groupBy("hypothesis").agg(F.countDistinct("word").alias("n"))
    return g.withColumn("confidence", F.when(F.col("n") >= 3, "HIGH").when(F.col("n") >= 2, "MEDIUM").otherwise("LOW"))


def findings(ev: DataFrame) -> DataFrame:
    """Findings of six kinds under one schema: (kind, row_id, timestamp_utc, source_system, summary, severity)."""
    # the columns that a finding keeps travel in its row's id: nothing has to be fetched from the events again
    ev = ev.withColumn("row_id", F.struct("row_id", "timestamp_utc", "source_system"))

    def kind(name: str, df: DataFrame, summary: str, severity: str) -> DataFrame:
        return df.select(F.lit(name).alias("kind"), "row_id.*", F.expr(summary).alias("summary"), F.expr(severity).alias("severity"))

    parts = [
        kind("signature", matches(ev).where("severity IN ('HIGH', 'CRITICAL')"), "concat(rule, ': ', matched)", "severity"),
        kind("lolbin", detect.lolbins(ev), "concat(binary, ' ', indicator)", "severity"),
        kind("account", detect.account_mgmt(ev), "action", "severity"),
        kind("sensor", detect.sysmon_ext(ev), "action", "severity"),
        kind("web", detect.web_attacks(ev).where("family IS NOT NULL"), "family", "severity"),
        kind("cleared", ev.where("event_code IN (1102, 104)"), "'log cleared'", "'CRITICAL'"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def adjusted(df: DataFrame) -> DataFrame:
    """Confidence one level down for one piece of counter-evidence, two for more; unknown levels count as HIGH."""
    levels = F.array(*map(F.lit, LEVELS))
    at = F.coalesce(F.nullif(F.array_position(levels, F.col("confidence")), F.lit(0)), F.lit(3))
    return df.withColumn("adjusted", F.element_at(levels, F.greatest(F.lit(1), at - F.least(F.lit(2), F.col("counter"))).cast("int")))


def counter_evidence(ev: DataFrame, hits: DataFrame) -> DataFrame:
    """Reasons that speak against a hit: its user and its address were seen a day before it, a known service."""
    first_user = ev.groupBy("username").agg(F.min("timestamp_utc").alias("user_first"))
    first_ip = ev.groupBy("dest_ip").agg(F.min("timestamp_utc").alias("ip_first"))
    j = hits.join(first_user, "username", "left").join(first_ip, "dest_ip", "left")
    day = F.expr("INTERVAL 1 DAY")
    reasons = F.array_compact(F.array(F.when(F.col("user_first") < F.col("timestamp_utc") - day, "user known"), F.when(F.col("ip_first") < F.col("timestamp_utc") - day, "address known"), F.when(F.col("service_name").isin("Spooler", "WinDefend"), "known service")))
    return j.select("row_id", F.array_join(reasons, ",").alias("reasons"), F.size(reasons).cast("long").alias("counter"))


def merge_findings(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both sets; of two with the same row and pattern the one of the first set stays."""
    both = first.withColumn("rank", F.lit(1)).unionByName(second.withColumn("rank", F.lit(2)))
    w = W.partitionBy("row_id", "pattern").orderBy("rank")
    return both.withColumn("nr", F.row_number().over(w)).where("nr = 1").select("row_id", "pattern", F.col("rank").cast("long").alias("rank"))


def claims(s, d) -> DataFrame:
    """Claims made from orders: a user that may be unknown, a time near or far from an event, a file and a quote."""
    o = table(s, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("claim_id"), F.concat(F.lit("user"), (F.col("o_custkey") % 200).cast("string")).alias("entity"), (F.col("o_orderkey") % 10007).alias("event"),
        (F.col("o_custkey") % 5).alias("shift"), F.concat(F.lit("log"), (F.col("o_custkey") % 7).cast("string"), F.lit(".parquet")).alias("ref"), F.when(F.col("o_orderkey") % 3 == 0, "whoami /all").otherwise("no such words").alias("quote"),
    )


CHECKS = ("has_user", "has_time", "has_ref", "has_quote")


def claim_checks(s, d, names: tuple[str, ...] = CHECKS) -> DataFrame:
    """The named checks of each claim against the events: its user is there, an event lies within two seconds, its
    file is part of a file's name, its quote part of a command. Only what is asked for is joined."""
    ev, out = security_events(s, d), claims(s, d)
    if "has_user" in names:
        out = out.join(ev.select(F.col("username").alias("entity"), F.lit(True).alias("has_user")).distinct(), "entity", "left")
    if "has_time" in names:
        at = out.select("claim_id", "event", "shift").join(ev.select(F.col("row_id").alias("event"), "timestamp_utc"), "event")
        at = at.select("claim_id", (F.unix_micros("timestamp_utc") + F.col("shift") * 1_000_000).alias("m"))
        out = out.join(relate.any_near(at, ev.select(F.unix_micros("timestamp_utc").alias("m")), 2).select("claim_id", F.lit(True).alias("has_time")).distinct(), "claim_id", "left")
    for name, column, text in (("has_ref", "ref", "source_file"), ("has_quote", "quote", "command_line")):
        if name in names:
            held = found_in(out.select(F.col(column).alias("value")), ev.select(F.col(text).alias("text"))).select(F.col("value").alias(column), F.lit(True).alias(name)).distinct()
            out = out.join(held, column, "left")
    return out.select("claim_id", *[F.coalesce(x, F.lit(False)).alias(x) for x in names])


def claim_status(checks: DataFrame) -> DataFrame:
    n = sum((F.col(x).cast("int") for x in ("has_time", "has_ref", "has_quote")), F.col("has_user").cast("int"))
    return checks.withColumn("passed", n.cast("long")).select("claim_id", "passed", F.when(F.col("passed") == 4, "VERIFIED").when(F.col("passed") > 2, "PARTIAL").otherwise("UNVERIFIED").alias("status"))


def coverage(docs: DataFrame, key: list[tuple[str, str, list[str], int]]) -> DataFrame:
    """Points of an answer key: a finding counts if some document holds any, or all, of its terms."""
    low = F.lower("text")

    def held(mode: str, terms: list[str]):
        tests = [low.contains(t) for t in terms]
        out = tests[0]
        for t in tests[1:]:
            out = (out & t) if mode == "ALL" else (out | t)
        return out

    row = docs.agg(*[F.count_if(held(m, ts)).alias(f) for f, m, ts, _ in key])
    out = F.array(*[F.struct(F.lit(f).alias("finding"), F.col(f).alias("documents"), F.when(F.col(f) > 0, p).otherwise(0).cast("long").alias("points")) for f, _, _, p in key])
    return row.select(F.explode(out).alias("x")).select("x.*")


KEY = [("licence", "ANY", ["general public license", "all rights reserved"], 5), ("greeting", "ALL", ["the", "and"], 3), ("absent", "ANY", ["no such words here"], 2)]


def metrics(ev: DataFrame) -> DataFrame:
    return ev.agg(F.countDistinct("username").alias("users"), F.count_if(F.col("process_name").isin(rules.ATTACK_TOOLS)).alias("tools"), F.count_if(S.ip_class(F.col("dest_ip")) == "EXTERNAL").alias("outside"), F.count_if(F.col("severity") == "critical").alias("critical"))


def reputation(s, d) -> DataFrame:
    n = table(s, d, "supplier")
    return n.select(F.element_at(F.array(*map(F.lit, ["198.51.100.7", "203.0.113.9", "172.32.0.5"])), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("value"), (F.col("s_suppkey") % 9).alias("malicious"), (F.col("s_suppkey") % 3).alias("suspicious"), (F.col("s_suppkey") % 90).alias("confidence")).groupBy("value").agg(F.max("malicious").alias("malicious"), F.max("suspicious").alias("suspicious"), F.max("confidence").alias("confidence"))


def enrich(iocs: DataFrame, rep: DataFrame) -> DataFrame:
    j = iocs.join(rep, "value", "left")
    return j.select("kind", "value", F.coalesce(S.risk_score(F.col("malicious"), F.col("suspicious"), F.col("confidence")), F.lit(0)).cast("long").alias("score"))


def stix(iocs: DataFrame) -> DataFrame:
    """Indicators as pattern texts with a deterministic id; kinds without a pattern are dropped."""
    forms = {"ipv4": "[ipv4-addr:value = '%s']", "url": "[url:value = '%s']", "domain": "[domain-name:value = '%s']", "md5": "[file:hashes.MD5 = '%s']", "sha1": "[file:hashes.'SHA-1' = '%s']", "sha256": "[file:hashes.'SHA-256' = '%s']"}
    quoted, pattern = F.replace("value", F.lit("'"), F.lit("\\'")), F.lit(None).cast("string")
    for kind, form in forms.items():
        pattern = F.when(F.col("kind") == kind, F.format_string(form, quoted)).otherwise(pattern)
    level = F.when(F.col("risk").isin("CRITICAL", "HIGH"), 85).when(F.col("risk") == "MEDIUM", 65).otherwise(25)
    return iocs.select(F.concat(F.lit("indicator--"), F.substring(F.sha2("value", 256), 1, 32)).alias("id"), pattern.alias("pattern"), level.cast("long").alias("confidence")).where("pattern IS NOT NULL")


def sigma(found: DataFrame) -> DataFrame:
    """One rule text for each signature that matched."""
    g = found.groupBy("rule", "field", "severity").agg(F.min("matched").alias("sample"))
    return g.select("rule", F.format_string("title: %s\ndetection:\n  %s|contains: %s\nlevel: %s", "rule", "field", "sample", F.lower("severity")).alias("text"))


def _ev(f):
    return lambda s, d: f(security_events(s, d))


_M = "m AS (" + detect._sql_scan(rules.SIGNATURES) + ")"
_I = "i AS (SELECT DISTINCT rule AS name FROM m UNION SELECT 'event_' || event_code FROM sec)"
_TAC = "CASE technique " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TACTICS.items()) + " ELSE 'Unknown' END"
_PLACE = "CASE tactic " + " ".join(f"WHEN '{t}' THEN {i + 1}" for i, t in enumerate(TACTIC_ORDER)) + " ELSE 99 END"
_AM = f"am AS (SELECT technique, row_id, rule, {_TAC} AS tactic FROM (SELECT *, row_number() OVER (PARTITION BY technique ORDER BY row_id, rule, field) AS nr FROM m) WHERE nr = 1)"
_HY = " UNION ALL ".join(f"SELECT '{h}' AS hypothesis, '{w}' AS word FROM m WHERE contains(lower(matched), '{w}')" for h, ws in HYPOTHESES.items() for w in ws)
_C = "c AS (SELECT o_orderkey AS claim_id, 'user' || (o_custkey % 200) AS entity, o_orderkey % 10007 AS event, o_custkey % 5 AS shift, 'log' || (o_custkey % 7) || '.parquet' AS ref, CASE WHEN o_orderkey % 3 = 0 THEN 'whoami /all' ELSE 'no such words' END AS quote FROM orders)"
_CH = f"{_C}, tm AS (SELECT claim_id, epoch_us(timestamp_utc) + shift * 1000000 AS t FROM c JOIN sec ON row_id = event), nt AS (SELECT DISTINCT claim_id FROM tm JOIN sec ON epoch_us(timestamp_utc) BETWEEN t - 2000000 AND t + 2000000), ch AS (SELECT claim_id, entity IN (SELECT username FROM sec) AS has_user, claim_id IN (SELECT claim_id FROM nt) AS has_time, ref IN (SELECT source_file FROM sec) AS has_ref, quote IN (SELECT command_line FROM sec) AS has_quote FROM c)"
_FIND = f"fd AS (SELECT 'signature' AS kind, row_id, rule || ': ' || matched AS summary, severity FROM m WHERE severity IN ('HIGH', 'CRITICAL') UNION ALL SELECT 'lolbin', row_id, \"binary\" || ' ' || indicator, severity FROM ({detect.ORACLES['fe_lolbins']}) UNION ALL SELECT 'account', row_id, action, severity FROM ({detect.ORACLES['fe_account_mgmt']}) UNION ALL SELECT 'sensor', row_id, action, severity FROM ({detect.ORACLES['fe_sysmon_ext']}) UNION ALL SELECT 'web', row_id, family, severity FROM ({detect.ORACLES['fe_web_attack_rules']}) WHERE family IS NOT NULL UNION ALL SELECT 'cleared', row_id, 'log cleared', 'CRITICAL' FROM sec WHERE event_code IN (1102, 104)), ff AS (SELECT fd.*, timestamp_utc, source_system FROM fd JOIN sec USING (row_id))"
_RANK = "CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END"

QUERIES = {
    "union_indicators": _ev(indicators),
    "attack_detect": _ev(lambda ev: technique_status(indicators(ev))),
    "attack_map": _ev(attack_map),
    "tactic_order": _ev(lambda ev: strategy(ev).select("technique", "place")),
    "strategy_rank": _ev(lambda ev: strategy(ev).select("technique", "tactic", "rank")),
    "hypotheses": _ev(hypotheses),
    "findings_union": _ev(findings),
    "category_counts": _ev(lambda ev: findings(ev).groupBy("kind").agg(F.count("*").alias("n"))),
    "key_findings": _ev(lambda ev: findings(ev).select("kind", "row_id", F.substring("summary", 1, 100).alias("summary"), "severity", "timestamp_utc").orderBy(S.severity_rank(F.col("severity")), "timestamp_utc", "row_id", "kind", "summary").limit(20)),
    "adjust_confidence": _ev(lambda ev: adjusted(ev.select("row_id", F.upper("severity").alias("confidence"), (F.col("k") % 4).cast("int").alias("counter"))).select("row_id", "adjusted")),
    "counter_evidence": _ev(lambda ev: counter_evidence(ev, ev.where("event_code IN (7045, 1102, 4720, 4769)"))),
    "merge_findings": _ev(lambda ev: merge_findings(detect.triage(ev).where("priority < 3").select("row_id", "pattern"), detect.triage(ev).where("priority < 4").select("row_id", "pattern"))),
    "claim_timestamps": lambda s, d: claim_checks(s, d, ("has_time",)).select("claim_id", "has_time"),
    "claim_refs": lambda s, d: claim_checks(s, d, ("has_ref",)).select("claim_id", "has_ref"),
    "claim_status": lambda s, d: claim_status(claim_checks(s, d)),
    "claim_timeline": lambda s, d: claims(s, d).join(security_events(s, d).select(F.col("row_id").alias("event"), "timestamp_utc"), "event").select("claim_id", "timestamp_utc").orderBy("timestamp_utc", "claim_id").limit(20),
    "coverage_score": lambda s, d: coverage(table(s, d, "documents"), KEY),
    "exec_metrics": _ev(metrics),
    "ioc_enrich": lambda s, d: enrich(ioc_table(indicator_events(s, d)), reputation(s, d)),
    "sink_stix": lambda s, d: stix(ioc_table(indicator_events(s, d))),
    "sigma_rows": _ev(lambda ev: sigma(matches(ev))),
    "entropy_top": _ev(lambda ev: detect.high_entropy(ev).orderBy(F.desc("entropy"), "kind", "name").limit(100)),
}
ORACLES = {
    "union_indicators": f"WITH {SEC}, {_M}, {_I} SELECT name FROM i",
    "attack_detect": f"WITH {SEC}, {_M}, {_I} " + " UNION ALL ".join("SELECT '{}' AS technique, CASE {} ELSE {} END AS status".format(t, " ".join(f"WHEN EXISTS (SELECT 1 FROM i WHERE name IN ({', '.join(repr(x) for x in alts)})) THEN 'CONFIRMED'" for alts in req), f"CASE WHEN EXISTS (SELECT 1 FROM i WHERE name IN ({', '.join(repr(x) for x in sup)})) THEN 'POSSIBLE' ELSE 'NOT_DETECTED' END" if sup else "'NOT_DETECTED'") for t, req, sup in rules.TECHNIQUES),
    "attack_map": f"WITH {SEC}, {_M}, {_AM} SELECT * FROM am",
    "tactic_order": f"WITH {SEC}, {_M}, {_AM} SELECT technique, CAST({_PLACE} AS BIGINT) AS place FROM am",
    "strategy_rank": f"WITH {SEC}, {_M}, {_AM} SELECT technique, tactic, row_number() OVER (ORDER BY {_PLACE}, technique) AS rank FROM am",
    "hypotheses": f"WITH {SEC}, {_M}, h AS ({_HY}) SELECT hypothesis, count(DISTINCT word) AS n, CASE WHEN count(DISTINCT word) >= 3 THEN 'HIGH' WHEN count(DISTINCT word) >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM h GROUP BY 1",
    "findings_union": f"WITH {SEC}, {_M}, {_FIND} SELECT * FROM ff",
    "category_counts": f"WITH {SEC}, {_M}, {_FIND} SELECT kind, count(*) AS n FROM ff GROUP BY 1",
    "key_findings": f"WITH {SEC}, {_M}, {_FIND} SELECT kind, row_id, left(summary, 100) AS summary, severity, timestamp_utc FROM ff ORDER BY {_RANK}, timestamp_utc, row_id, kind, summary LIMIT 20",
    "adjust_confidence": f"WITH {SEC} SELECT row_id, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][CAST(greatest(1, CASE upper(severity) WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'CRITICAL' THEN 4 ELSE 3 END - least(2, k % 4)) AS INT)] AS adjusted FROM sec",
    "counter_evidence": f"WITH {SEC}, u AS (SELECT username, min(timestamp_utc) AS uf FROM sec GROUP BY 1), p AS (SELECT dest_ip, min(timestamp_utc) AS pf FROM sec GROUP BY 1), r AS (SELECT row_id, list_filter([CASE WHEN uf < timestamp_utc - INTERVAL 1 DAY THEN 'user known' END, CASE WHEN pf < timestamp_utc - INTERVAL 1 DAY THEN 'address known' END, CASE WHEN service_name IN ('Spooler', 'WinDefend') THEN 'known service' END], lambda x: x IS NOT NULL) AS l FROM sec JOIN u USING (username) JOIN p USING (dest_ip) WHERE event_code IN (7045, 1102, 4720, 4769)) SELECT row_id, array_to_string(l, ',') AS reasons, CAST(len(l) AS BIGINT) AS counter FROM r",
    "merge_findings": f"WITH {SEC}, {detect._T} SELECT row_id, pattern, CAST(CASE WHEN priority < 3 THEN 1 ELSE 2 END AS BIGINT) AS rank FROM f WHERE priority < 4",
    "claim_timestamps": f"WITH {SEC}, {_CH} SELECT claim_id, has_time FROM ch",
    "claim_refs": f"WITH {SEC}, {_CH} SELECT claim_id, has_ref FROM ch",
    "claim_status": f"WITH {SEC}, {_CH}, n AS (SELECT claim_id, CAST(has_user::INT + has_time::INT + has_ref::INT + has_quote::INT AS BIGINT) AS passed FROM ch) SELECT *, CASE WHEN passed = 4 THEN 'VERIFIED' WHEN passed > 2 THEN 'PARTIAL' ELSE 'UNVERIFIED' END AS status FROM n",
    "claim_timeline": f"WITH {SEC}, {_C} SELECT claim_id, timestamp_utc FROM c JOIN sec ON row_id = event ORDER BY timestamp_utc, claim_id LIMIT 20",
    "coverage_score": " UNION ALL ".join(f"SELECT '{f}' AS finding, count(*) FILTER ({(' AND ' if m == 'ALL' else ' OR ').join(f'contains(lower(text), {chr(39)}{t}{chr(39)})' for t in ts)}) AS documents, CAST(CASE WHEN count(*) FILTER ({(' AND ' if m == 'ALL' else ' OR ').join(f'contains(lower(text), {chr(39)}{t}{chr(39)})' for t in ts)}) > 0 THEN {p} ELSE 0 END AS BIGINT) AS points FROM documents" for f, m, ts, p in KEY),
    "exec_metrics": f"WITH {SEC} SELECT count(DISTINCT username) AS users, count(*) FILTER (process_name = 'mimikatz.exe') AS tools, count(*) FILTER (dest_ip IN ('198.51.100.7', '203.0.113.9', '172.32.0.5')) AS outside, count(*) FILTER (severity = 'critical') AS critical FROM sec",
    "ioc_enrich": f"WITH i AS ({_IOC}), r AS (SELECT ['198.51.100.7', '203.0.113.9', '172.32.0.5'][CAST(s_suppkey % 3 + 1 AS INT)] AS value, max(s_suppkey % 9) AS m, max(s_suppkey % 3) AS s, max(s_suppkey % 90) AS c FROM supplier GROUP BY 1) SELECT kind, value, CAST(coalesce(least(100, CASE WHEN m > 5 THEN 50 WHEN m > 0 THEN 30 ELSE 0 END + CASE WHEN s > 0 THEN 10 ELSE 0 END + least(40, c // 2)), 0) AS BIGINT) AS score FROM i LEFT JOIN r USING (value)",
    "sink_stix": f"WITH i AS ({_IOC}), f(kind, a) AS (VALUES ('ipv4', 'ipv4-addr:value'), ('url', 'url:value'), ('domain', 'domain-name:value'), ('md5', 'file:hashes.MD5')) SELECT 'indicator--' || left(sha256(value), 32) AS id, '[' || a || ' = ''' || replace(value, '''', '\\''') || ''']' AS pattern, CAST(CASE WHEN risk IN ('HIGH', 'CRITICAL') THEN 85 WHEN risk = 'MEDIUM' THEN 65 ELSE 25 END AS BIGINT) AS confidence FROM i JOIN f USING (kind)",
    "sigma_rows": f"WITH {SEC}, {_M} SELECT rule, 'title: ' || rule || chr(10) || 'detection:' || chr(10) || '  ' || field || '|contains: ' || min(matched) || chr(10) || 'level: ' || lower(severity) AS text FROM m GROUP BY rule, field, severity",
    "entropy_top": f"SELECT * FROM ({detect.ORACLES['high_entropy']}) ORDER BY entropy DESC, kind, name LIMIT 100",
}
