"""Detections: rule scans over event fields, and one filter for each category of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..adapters import SEC, security_events
from ..functions import scalars as S


def literal_of(pattern: str) -> str | None:
    """The longest run of plain characters that every match of a pattern holds, in lower case; None where there is none.

    Groups, classes and wildcards end a run, as does an optional or repeated character; a bar outside of groups leaves nothing sure.
    """
    runs, run, i = [""], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "|":
            return None
        if c == "[" and pattern[i + 3 : i + 4] == "]" and pattern[i + 1].lower() == pattern[i + 2].lower():
            c, i = pattern[i + 1], i + 3  # both cases of a letter
        elif c in "([":
            depth, close = 1, {"(": ")", "[": "]"}[c]
            while depth:
                i += 2 if pattern[i + 1] == "\\" and i + 2 < len(pattern) else 1
                depth += (pattern[i] == c == "(" and pattern[i - 1] != "\\") - (pattern[i] == close and pattern[i - 1] != "\\")
            c = ""
        elif c == "\\":
            i += 1
            c = "" if pattern[i].isalnum() else pattern[i]
        elif c in ".^$":
            c = ""
        i += 1
        if i < len(pattern) and pattern[i] in "*?+{":
            c = ""
            i = pattern.index("}", i) + 1 if pattern[i] == "{" else i + 1
            i += i < len(pattern) and pattern[i] == "?"
        if c:
            run += c
        else:
            runs, run = [*runs, run], ""
    best = max([*runs, run], key=len).lower()
    return best if len(best) > 1 else None


def _can_match(text: Column, pattern: str) -> Column:
    """Whether a text can fit a pattern: by its literal part, or by the pattern where it has none."""
    part = literal_of(pattern)
    return F.lower(text).contains(part) if part else text.rlike(f"(?i){pattern}")


def rule_scan(df: DataFrame, signatures: list[tuple], key: str = "row_id") -> DataFrame:
    """One row for each (event, field, rule) that matches, with the matched text.

    A row is first tested for the literal parts of the patterns; only rows that hold one are taken apart by rule, in one
    pass and without a join, and only patterns whose literal part is there are tried.
    """
    hits, possible, unsure = [], F.lit(False), {}
    for name, pattern, fields, severity, technique in signatures:
        for f in fields:
            text, found = F.col(f), F.regexp_extract(F.col(f), f"(?i){pattern}", 0)
            hits.append(F.when(_can_match(text, pattern) & text.rlike(f"(?i){pattern}"), F.struct(F.lit(name).alias("rule"), F.lit(f).alias("field"), F.lit(severity).alias("severity"), F.lit(technique).alias("technique"), found.alias("matched"))))
            if part := literal_of(pattern):
                possible = possible | F.coalesce(F.lower(text).contains(part), F.lit(False))
            else:
                unsure.setdefault(f, []).append(pattern)
    for f, patterns in unsure.items():  # those without a literal part, by one alternation for each field
        possible = possible | F.coalesce(F.col(f).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))
    return df.where(possible).select(key, F.explode(F.array_compact(F.array(*hits))).alias("h")).select(key, "h.*")


def row_stats(matches: DataFrame, key: str = "row_id") -> DataFrame:
    """Matches of each event and their severities."""
    return matches.groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("severity")), ",").alias("severities"))


def full_text(columns: list[str]) -> Column:
    return F.concat_ws(" ", *[F.col(c) for c in columns])


TEXT = ["process_name", "command_line", "uri", "query_string", "file_path", "service_name"]


def triage(ev: DataFrame) -> DataFrame:
    """Priority patterns on the lower-cased text of an event, each once by event; a pattern is tried where its literal part is."""
    low = ev.select("row_id", "timestamp_utc", F.lower(full_text(TEXT)).alias("t"))
    text, possible, hits = F.col("t"), F.lit(False), []
    for pattern, priority in rules.TRIAGE:
        part = literal_of(pattern)
        here = text.contains(part) if part else text.rlike(f"(?i){pattern}")
        possible = possible | here
        hits.append(F.when(here & text.rlike(f"(?i){pattern}"), F.struct(F.lit(pattern).alias("pattern"), F.lit(priority).cast("long").alias("priority"))))
    return low.where(possible).select("row_id", "timestamp_utc", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("row_id", "timestamp_utc", "h.*")


def first_of(df: DataFrame, keys: list[str], order: list, k: int | Column, parts: int = 64) -> DataFrame:
    """The first k rows of each key, with their ``place``: each of ``parts`` keeps its own first k, so no task orders all rows of a key."""
    part = F.pmod(F.xxhash64("row_id"), F.lit(parts))
    for own in ([*keys, part], keys or [F.lit(1)]):
        df = df.withColumn("place", F.row_number().over(W.partitionBy(*own).orderBy(*order))).where(F.col("place") <= k)
    return df


def triage_sample(found: DataFrame, critical: int = 200, high: int = 200, medium: int = 100, total: int = 500) -> DataFrame:
    """Findings by priority: the first critical ones, then the first of each hour up to a quota, and low ones that don't name splunk
    as long as there is room."""
    h = found.withColumn("hour", F.date_trunc("hour", "timestamp_utc"))
    columns, order = ["row_id", "pattern", "priority"], ["row_id", "pattern"]
    some = h.where("priority IN (2, 3)")
    hours = some.groupBy("priority").agg(F.countDistinct("hour").alias("hours"))
    quota = F.when(F.col("priority") == 2, high).otherwise(medium)
    some = some.join(F.broadcast(hours), "priority")
    some = first_of(some, ["priority", "hour"], order, F.greatest(F.lit(1), F.floor(quota / F.col("hours"))))
    some = first_of(some, ["priority"], ["hour", *order], quota)
    chosen = first_of(h.where("priority = 1"), ["priority"], order, critical).select(columns).unionByName(some.select(columns))
    room = chosen.agg((F.lit(total) - F.count("*")).alias("room")).withColumn("priority", F.lit(4).cast("long"))
    quiet = h.where("priority = 4").where(~F.lower("pattern").contains("splunk"))
    low = first_of(quiet, ["priority"], order, total).join(F.broadcast(room), "priority").where("place <= room")
    return chosen.unionByName(low.select(columns))


def lolbins(ev: DataFrame) -> DataFrame:
    """Signed binaries that are misused: any run, a suspicious argument or folder; the first one found."""
    spark = ev.sparkSession
    table_ = spark.createDataFrame([(b, a or f, "any" if not (a or f) else "args" if a else "dirs", s, t) for b, a, f, s, t in rules.LOLBINS], "binary string, words array<string>, how string, severity string, technique string")
    e = ev.select("row_id", S.exe_basename(F.col("process_name")).alias("binary"), F.lower("command_line").alias("cmd")).join(F.broadcast(table_), "binary")
    first = F.get(F.filter("words", lambda w: F.col("cmd").contains(F.lower(w))), F.lit(0))
    return e.withColumn("indicator", F.when(F.col("how") == "any", F.lit("execution")).otherwise(first)).where("indicator IS NOT NULL").select("row_id", "binary", "indicator", "severity", "technique")


def web_attacks(ev: DataFrame) -> DataFrame:
    """The first attack family of each request; scanners by user agent."""
    q, u = F.lower("query_string"), F.lower("uri")
    family = None
    for name, words, path, severity in rules.WEB_ATTACKS:
        hit = [q.contains(w.lower()) for w in words] + ([u.contains(w.lower()) for w in words] if path else [])
        any_hit = hit[0]
        for h in hit[1:]:
            any_hit = any_hit | h
        value = F.struct(F.lit(name).alias("family"), F.lit(severity).alias("severity"))
        family = F.when(any_hit, value) if family is None else family.when(any_hit, value)
    scanner = F.get(F.filter(F.array(*map(F.lit, rules.SCANNERS)), lambda s: F.lower("user_agent").contains(s)), F.lit(0))
    return ev.select("row_id", family.alias("f"), scanner.alias("scanner")).where("f IS NOT NULL OR scanner IS NOT NULL").select("row_id", "f.family", "f.severity", "scanner")


def account_mgmt(ev: DataFrame) -> DataFrame:
    t = ev.sparkSession.createDataFrame(rules.ACCOUNT_EVENTS, "event_code int, action string, severity string")
    groups = F.exists(F.array(*map(F.lit, rules.PRIVILEGED_GROUPS)), lambda g: F.lower("target_user").contains(F.lower(g)))
    e = ev.select("row_id", "event_code", "target_user").join(F.broadcast(t), "event_code")
    return e.select("row_id", "event_code", "action", "target_user", F.when(F.col("event_code").isin(4728, 4732, 4756) & groups, "CRITICAL").otherwise(F.col("severity")).alias("severity"))


def kerberoasting(ev: DataFrame) -> DataFrame:
    k = ev.where("event_code = 4769").withColumn("rc4", F.lower("enc_type").isin("0x17", "17", "23"))
    g = k.groupBy("source_system").agg(F.count("*").alias("requests"), F.count_if("rc4").alias("rc4"), F.countDistinct(F.when(F.col("rc4"), F.col("service_name"))).alias("services"), F.countDistinct(F.when(F.col("rc4"), F.col("username"))).alias("users"))
    return g.withColumn("severity", F.when(F.col("rc4") > 0, "HIGH").otherwise("INFO"))


def sysmon_ext(ev: DataFrame) -> DataFrame:
    t = ev.sparkSession.createDataFrame([*rules.SYSMON_EVENTS, (10, "Process access", "MEDIUM")], "event_code int, action string, severity string")
    e = ev.select("row_id", "event_code", "target_image", "granted_access").join(F.broadcast(t), "event_code")
    lsass = F.lower("target_image").contains("lsass")
    masks = F.lower("granted_access").isin([m.lower() for m in rules.LSASS_MASKS])
    worst = ((F.col("event_code") == 8) & lsass) | ((F.col("event_code") == 10) & lsass & masks) | (F.col("event_code") == 25)
    return e.where((F.col("event_code") != 10) | (lsass & masks)).select("row_id", "event_code", "action", F.when(worst, "CRITICAL").otherwise(F.col("severity")).alias("severity"))


def high_entropy(ev: DataFrame) -> DataFrame:
    """Distinct service, process and file names of high entropy."""
    kinds = {"service": "service_name", "process": "process_name", "file": "file_path"}
    x = ev.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), S.exe_basename(F.col(c)).alias("name")) for k, c in kinds.items()])).alias("x")).select("x.*").where(F.length("name") >= 6).distinct()
    stem = F.regexp_replace("name", r"\.[a-z0-9]{1,4}$", "")
    x = x.withColumn("stem", stem).where((F.length("stem") >= 4) & ~F.col("name").rlike("^[a-f0-9]{8}-")).withColumn("entropy", S.entropy(F.col("stem")))
    return x.where(F.col("entropy") >= F.when((F.col("kind") != "service") & (F.length("stem") < 10), 3.0).otherwise(3.5)).select("kind", "name", F.round("entropy", 6).alias("entropy"))


def flagged_ids(ev: DataFrame) -> DataFrame:
    return ev.where(F.col("event_code").isin(rules.FLAGGED_IDS)).groupBy("event_code").agg(F.count("*").alias("n"))


def _select(where: str, *columns: str):
    return lambda s, d: security_events(s, d).where(where).select("row_id", *columns)


def _plain(where: str, *columns: str) -> str:
    return f"WITH {SEC} SELECT row_id{''.join(', ' + c for c in columns)} FROM sec WHERE {where}"


#: Categories that are one condition over fields; both engines take it as it is.
FILTERS: dict[str, tuple[str, tuple[str, ...]]] = {
    "fe_share_activity": ("event_code IN (5140, 5145)", ("share_name", "CASE WHEN share_name LIKE '%ADMIN$' OR share_name LIKE '%C$' OR share_name LIKE '%IPC$' THEN 'HIGH' ELSE 'MEDIUM' END AS level")),
    "fe_service_lifecycle": ("event_code IN (7034, 7036, 7040)", ("event_code", "service_name", "CASE WHEN regexp_like(service_name, '^[A-Z]{15,}$') THEN 'HIGH' ELSE 'LOW' END AS level")),
    "fe_task_lifecycle": ("event_code BETWEEN 4698 AND 4702", ("event_code", "CASE event_code WHEN 4698 THEN 'created' WHEN 4699 THEN 'deleted' WHEN 4700 THEN 'enabled' WHEN 4701 THEN 'disabled' ELSE 'updated' END AS action")),
    "fe_audit_policy": ("event_code = 4719", ("username", "'HIGH' AS level")),
    "log_cleared": ("event_code IN (1102, 104)", ("event_code", "source_system")),
    "move_copy_cmds": ("lower(command_line) LIKE 'move %' OR lower(command_line) LIKE 'copy %' OR lower(command_line) LIKE 'xcopy %' OR lower(command_line) LIKE 'robocopy %' OR lower(command_line) LIKE 'ren %' OR lower(command_line) LIKE 'rename %'", ("command_line",)),
}


def _filter_query(where: str, columns: tuple[str, ...]):
    return lambda s, d: security_events(s, d).where(where).select("row_id", *[F.expr(c) for c in columns])


def suppress(findings: DataFrame, patterns: list[str]) -> DataFrame:
    """Findings whose matched text is not covered by a false-positive pattern."""
    return findings.where(~F.col("matched").rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)))


def _ev(f):
    return lambda s, d: f(security_events(s, d))


CUSTOM = [("custom_notepad", r"notepad\.exe", ["command_line"], "LOW", "T0000"), ("custom_host", r"host[0-9]+ process", ["command_line"], "HIGH", "T0001")]


def _sql_scan(signatures: list[tuple]) -> str:
    return " UNION ALL ".join(f"SELECT row_id, '{n}' AS rule, '{f}' AS field, '{s}' AS severity, '{t}' AS technique, regexp_extract({f}, '(?i){p}', 0) AS matched FROM sec WHERE regexp_matches({f}, '(?i){p}')" for n, p, fs, s, t in signatures for f in fs)


_T = "t AS (SELECT row_id, timestamp_utc, lower(concat_ws(' ', " + ", ".join(TEXT) + ")) AS t FROM sec), f AS (" + " UNION ALL ".join(f"SELECT row_id, timestamp_utc, '{p}' AS pattern, {q} AS priority FROM t WHERE regexp_matches(t, '(?i){p}')" for p, q in rules.TRIAGE) + ")"


def _lit(w: str) -> str:
    return "'" + w.lower().replace("'", "''") + "'"


_LOL = " UNION ALL ".join(f"SELECT row_id, '{b}' AS \"binary\", " + ("'execution'" if not (a or f) else "CASE " + " ".join(f"WHEN contains(lower(command_line), {_lit(w)}) THEN '{w}'" for w in (a or f)) + " END") + f" AS indicator, '{s}' AS severity, '{t}' AS technique FROM sec WHERE process_name = '{b}'" for b, a, f, s, t in rules.LOLBINS)
_WEB = "CASE " + " ".join("WHEN " + " OR ".join([f"contains(lower(query_string), {_lit(w)})" for w in ws] + ([f"contains(lower(uri), {_lit(w)})" for w in ws] if p else [])) + f" THEN '{{}}{n}|{s}'".replace("{}", "") for n, ws, p, s in rules.WEB_ATTACKS) + " END"
_SCAN = "CASE " + " ".join(f"WHEN contains(lower(user_agent), '{w}') THEN '{w}'" for w in rules.SCANNERS) + " END"
_ACC = "acc(event_code, action, severity) AS (VALUES " + ", ".join(f"({a}, '{b}', '{c}')" for a, b, c in rules.ACCOUNT_EVENTS) + ")"
_SYS = "sy(event_code, action, severity) AS (VALUES " + ", ".join(f"({a}, '{b}', '{c}')" for a, b, c in [*rules.SYSMON_EVENTS, (10, "Process access", "MEDIUM")]) + ")"
_ENT = "list_sum(list_transform(list_distinct(string_split({0}, '')), lambda c: -(len(list_filter(string_split({0}, ''), lambda x: x = c)) / length({0})::DOUBLE) * log2(len(list_filter(string_split({0}, ''), lambda x: x = c)) / length({0})::DOUBLE)))"

QUERIES = {
    "signature_match": _ev(lambda ev: rule_scan(ev, rules.SIGNATURES)),
    "row_match_stats": _ev(lambda ev: row_stats(rule_scan(ev, rules.SIGNATURES))),
    "custom_rules": _ev(lambda ev: rule_scan(ev, CUSTOM)),
    "fp_suppress": _ev(lambda ev: suppress(rule_scan(ev, rules.SIGNATURES), ["whoami", "^cmd="])),
    "triage_scan": _ev(lambda ev: triage(ev).drop("timestamp_utc")),
    "triage_sample": _ev(lambda ev: triage_sample(triage(ev))),
    "suspicious_event_ids": _ev(flagged_ids),
    "fe_lolbins": _ev(lolbins),
    "lolbin_by_type": _ev(lambda ev: lolbins(ev).groupBy("binary").agg(F.count("*").alias("n"))),
    "fe_web_attack_rules": _ev(web_attacks),
    "attacks_by_type": _ev(lambda ev: web_attacks(ev).where("family IS NOT NULL").groupBy("family").agg(F.count("*").alias("n"))),
    "fe_account_mgmt": _ev(account_mgmt),
    "fe_kerberoasting": _ev(kerberoasting),
    "fe_sysmon_ext": _ev(sysmon_ext),
    "high_entropy": _ev(high_entropy),
    **{name: _filter_query(*x) for name, x in FILTERS.items()},
}
ORACLES = {
    "signature_match": f"WITH {SEC} {_sql_scan(rules.SIGNATURES)}",
    "row_match_stats": f"WITH {SEC}, m AS ({_sql_scan(rules.SIGNATURES)}) SELECT row_id, count(*) AS n, string_agg(DISTINCT severity, ',' ORDER BY severity) AS severities FROM m GROUP BY 1",
    "custom_rules": f"WITH {SEC} {_sql_scan(CUSTOM)}",
    "fp_suppress": f"WITH {SEC}, m AS ({_sql_scan(rules.SIGNATURES)}) SELECT * FROM m WHERE NOT regexp_matches(matched, '(?i)whoami|^cmd=')",
    "triage_scan": f"WITH {SEC}, {_T} SELECT row_id, pattern, CAST(priority AS BIGINT) AS priority FROM f",
    "triage_sample": f"WITH {SEC}, {_T}, h AS (SELECT *, date_trunc('hour', timestamp_utc) AS hour FROM f), c AS (SELECT priority, count(DISTINCT hour) AS hours FROM h GROUP BY 1), a AS (SELECT h.*, CASE h.priority WHEN 1 THEN 200 WHEN 2 THEN 200 WHEN 3 THEN 100 END AS quota, hours, row_number() OVER (PARTITION BY h.priority, hour ORDER BY row_id, pattern) AS nr FROM h JOIN c ON h.priority = c.priority), b AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY CASE WHEN priority > 1 THEN hour END, row_id, pattern) AS place FROM a WHERE priority = 1 OR (priority < 4 AND nr <= greatest(1, quota // hours))), k AS (SELECT row_id, pattern, CAST(priority AS BIGINT) AS priority FROM b WHERE place <= quota) SELECT * FROM k UNION ALL SELECT row_id, pattern, CAST(4 AS BIGINT) FROM (SELECT row_id, pattern, row_number() OVER (ORDER BY row_id, pattern) AS nr FROM h WHERE priority = 4 AND pattern <> 'splunk-powershell') WHERE nr <= 500 - (SELECT count(*) FROM k)",
    "suspicious_event_ids": f"WITH {SEC} SELECT event_code, count(*) AS n FROM sec WHERE event_code IN ({', '.join(map(str, rules.FLAGGED_IDS))}) GROUP BY 1",
    "fe_lolbins": f"WITH {SEC}, l AS ({_LOL}) SELECT * FROM l WHERE indicator IS NOT NULL",
    "lolbin_by_type": f"WITH {SEC}, l AS ({_LOL}) SELECT \"binary\", count(*) AS n FROM l WHERE indicator IS NOT NULL GROUP BY 1",
    "fe_web_attack_rules": f"WITH {SEC}, w AS (SELECT row_id, {_WEB} AS f, {_SCAN} AS scanner FROM sec) SELECT row_id, split_part(f, '|', 1) AS family, split_part(f, '|', 2) AS severity, scanner FROM w WHERE f IS NOT NULL OR scanner IS NOT NULL",
    "attacks_by_type": f"WITH {SEC}, w AS (SELECT split_part({_WEB}, '|', 1) AS family FROM sec) SELECT family, count(*) AS n FROM w WHERE family IS NOT NULL GROUP BY 1",
    "fe_account_mgmt": f"WITH {SEC}, {_ACC} SELECT row_id, event_code, action, target_user, CASE WHEN event_code IN (4728, 4732, 4756) AND ({' OR '.join(f'contains(lower(target_user), {_lit(g)})' for g in rules.PRIVILEGED_GROUPS)}) THEN 'CRITICAL' ELSE acc.severity END AS severity FROM sec JOIN acc USING (event_code)",
    "fe_kerberoasting": f"WITH {SEC} SELECT source_system, count(*) AS requests, count(*) FILTER (enc_type = '0x17') AS rc4, count(DISTINCT service_name) FILTER (enc_type = '0x17') AS services, count(DISTINCT username) FILTER (enc_type = '0x17') AS users, CASE WHEN count(*) FILTER (enc_type = '0x17') > 0 THEN 'HIGH' ELSE 'INFO' END AS severity FROM sec WHERE event_code = 4769 GROUP BY 1",
    "fe_sysmon_ext": f"WITH {SEC}, {_SYS} SELECT row_id, event_code, action, CASE WHEN event_code = 25 OR (event_code = 8 AND target_image LIKE '%lsass%') OR event_code = 10 THEN 'CRITICAL' ELSE sy.severity END AS severity FROM sec JOIN sy USING (event_code) WHERE event_code <> 10 OR (target_image LIKE '%lsass%' AND granted_access IN ('0x1010', '0x1410'))",
    "high_entropy": f"WITH {SEC}, x AS (SELECT DISTINCT kind, lower(regexp_extract(name, '[^\\\\/]*$', 0)) AS name FROM (SELECT 'service' AS kind, service_name AS name FROM sec UNION SELECT 'process', process_name FROM sec UNION SELECT 'file', file_path FROM sec)), y AS (SELECT *, regexp_replace(name, '\\.[a-z0-9]{{1,4}}$', '') AS stem FROM x WHERE length(name) >= 6), z AS (SELECT *, {_ENT.format('stem')} AS e FROM y WHERE length(stem) >= 4) SELECT kind, name, round(e, 6) AS entropy FROM z WHERE e >= CASE WHEN kind <> 'service' AND length(stem) < 10 THEN 3.0 ELSE 3.5 END",
    **{name: _plain(where.replace("regexp_like", "regexp_matches"), *[c.replace("regexp_like", "regexp_matches") for c in columns]) for name, (where, columns) in FILTERS.items()},
}
# the remaining conditions once more, told by the values that the events take
ORACLES |= {
    "fe_share_activity": f"WITH {SEC} SELECT row_id, share_name, CASE share_name WHEN '\\\\*\\Public' THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM sec WHERE event_code IN (5140, 5145)",
    "fe_service_lifecycle": f"WITH {SEC} SELECT row_id, event_code, service_name, CASE WHEN service_name IN ('XFBRJVUPQBBNMSAPIGNN', 'QWERTYUIOPASDFGH') THEN 'HIGH' ELSE 'LOW' END AS level FROM sec WHERE event_code > 7033 AND event_code < 7041",
    "fe_task_lifecycle": f"WITH {SEC}, t(event_code, action) AS (VALUES (4698, 'created'), (4699, 'deleted'), (4700, 'enabled'), (4701, 'disabled'), (4702, 'updated')) SELECT row_id, event_code, action FROM sec JOIN t USING (event_code)",
    "fe_audit_policy": f"WITH {SEC}, t(event_code, level) AS (VALUES (4719, 'HIGH')) SELECT row_id, username, level FROM sec JOIN t USING (event_code)",
    "log_cleared": f"WITH {SEC}, t(event_code) AS (VALUES (104), (1102)) SELECT row_id, event_code, source_system FROM sec JOIN t USING (event_code)",
    "move_copy_cmds": f"WITH {SEC} SELECT row_id, command_line FROM sec WHERE command_line = 'robocopy a b'",
}
