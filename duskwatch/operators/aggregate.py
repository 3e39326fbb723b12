"""Event statistics: counts, spikes, rarity, volume, beacons, scans and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..adapters import PLANTED, SEC, page_hosts, planted_events, security_events
from ..functions import scalars as S


def type_counts(ev: DataFrame) -> DataFrame:
    """Number of events by type; fewer than three are rare."""
    return ev.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("rare", F.col("n") < 3)


def hourly(ev: DataFrame) -> DataFrame:
    return ev.groupBy(F.date_trunc("hour", "timestamp_utc").alias("hour")).agg(F.count("*").alias("n"))


def spikes_by_sigma(ev: DataFrame) -> DataFrame:
    """Hours of more than mean + 2 sigma events (population), with the distance in sigma."""
    h = hourly(ev)
    s = h.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("sigma"))
    return h.join(F.broadcast(s)).where("n > mean + 2 * sigma").select("hour", "n", F.round((F.col("n") - F.col("mean")) / F.col("sigma"), 2).alias("distance"))


def spikes_by_ratio(ev: DataFrame, k: int = 10) -> DataFrame:
    """The k fullest hours with more than twice the average."""
    h = hourly(ev)
    s = h.agg(F.avg("n").alias("mean"))
    return h.join(F.broadcast(s)).where("n > 2 * mean").select("hour", "n", F.round(F.col("n") / F.col("mean"), 2).alias("ratio")).orderBy(F.desc("n"), "hour").limit(k)


def bounds(ev: DataFrame) -> DataFrame:
    out = ev.agg(F.min("timestamp_utc").alias("first"), F.max("timestamp_utc").alias("last"), F.count("*").alias("n"))
    return out.withColumn("hours", F.round((F.unix_micros("last") - F.unix_micros("first")) / 3600e6, 4))


def entity_sets(ev: DataFrame, most: int = 100) -> DataFrame:
    """Distinct users, addresses, hosts and processes: how many, and the first ``most`` in order."""
    kinds = {"user": "username", "ip": "source_ip", "host": "source_system", "process": "process_name"}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in kinds.items()]))
    names = ev.select(pairs.alias("x")).select("x.*").where("name IS NOT NULL").distinct()
    # the first of each of 256 parts hold the first of all: no task orders all names of a kind
    part = W.partitionBy("kind", F.pmod(F.xxhash64("name"), F.lit(256))).orderBy("name")
    first = names.withColumn("at", F.row_number().over(part)).where(F.col("at") <= most).drop("at")
    first = first.withColumn("at", F.row_number().over(W.partitionBy("kind").orderBy("name"))).where(F.col("at") <= most)
    listed = first.groupBy("kind").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))
    return names.groupBy("kind").agg(F.count("*").alias("n")).join(listed, "kind")


def web_stats(ev: DataFrame) -> DataFrame:
    """Counts by method, the 20 most frequent status codes and paths and 10 agents, one table."""
    def top(kind: str, col, k: int) -> DataFrame:
        return ev.groupBy(col.alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(k).select(F.lit(kind).alias("kind"), "name", "n")

    return top("method", F.col("http_method"), 100).union(top("status", F.col("status_code").cast("string"), 20)).union(top("uri", F.substring_index("uri", "?", 1), 20)).union(top("agent", F.substring("user_agent", 1, 100), 10))


def id_volume(ev: DataFrame, known: DataFrame) -> DataFrame:
    """Event ids by host against their expected number: too many of MEDIUM or more, or any of HIGH or more."""
    n = ev.groupBy("source_system", F.col("event_code").alias("id")).agg(F.count("*").alias("n"))
    j = n.join(F.broadcast(known), "id")
    many = j.where("n > 2 * expected AND significance IN ('MEDIUM', 'HIGH', 'CRITICAL')").withColumn("flag", F.lit("volume"))
    high = j.where("significance IN ('HIGH', 'CRITICAL')").withColumn("flag", F.lit("significance"))
    return many.unionByName(high).select("source_system", "id", "n", "category", "flag")


RARE_COLUMNS = ["process_name", "parent_process_name", "username", "source_ip", "service_name", "uri", "command_line", "user_agent"]


def rare_values(ev: DataFrame, columns: list[str], median_over: float = 50, most: int = 3) -> DataFrame:
    """Values of a column seen ``most`` times at most where the column's median count is over a bound."""
    long = ev.select("timestamp_utc", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])).alias("x")).select("timestamp_utc", "x.*")
    n = long.where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"), F.min("timestamp_utc").alias("first"), F.max("timestamp_utc").alias("last"))
    mid = n.groupBy("column").agg(F.percentile("n", 0.5).alias("median"))
    return n.join(F.broadcast(mid), "column").where((F.col("median") > median_over) & (F.col("n") <= most)).select("column", "value", "n", "first", "last", F.round(F.col("median") / F.col("n"), 6).alias("score"))


def first_seen(ev: DataFrame) -> DataFrame:
    kinds = {"user": "username", "process": "process_name", "ip": "source_ip", "service": "service_name"}
    x = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in kinds.items()]))
    return ev.select("timestamp_utc", x.alias("x")).where("x.name IS NOT NULL").groupBy("x.kind", "x.name").agg(F.min("timestamp_utc").alias("first"))


def attack_window(ev: DataFrame, hits: DataFrame) -> DataFrame:
    """Entities first seen from half an hour before the first hit to the last one."""
    span = hits.agg((F.min("timestamp_utc") - F.expr("INTERVAL 30 MINUTES")).alias("begin"), F.max("timestamp_utc").alias("end"))
    return first_seen(ev).join(F.broadcast(span)).select("kind", "name", "first", F.col("first").between(F.col("begin"), F.col("end")).alias("inside"))


def conversations(net: DataFrame, k: int | None = 20) -> DataFrame:
    out = net.groupBy("source_ip", "dest_ip").agg(F.count("*").alias("n"), F.countDistinct("dest_port").alias("ports")).orderBy(F.desc("n"), "source_ip", "dest_ip")
    return out.limit(k) if k else out


def port_distribution(net: DataFrame, k: int = 20) -> DataFrame:
    return net.groupBy("dest_port").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dest_port").limit(k)


def port_scan(net: DataFrame, over: int = 20) -> DataFrame:
    return net.groupBy("source_ip", "dest_ip").agg(F.countDistinct("dest_port").alias("ports")).where(F.col("ports") > over)


def gaps(ev: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds since the previous event of the same key, in time order."""
    w = W.partitionBy(*keys).orderBy("timestamp_utc", "row_id")
    return ev.withColumn("gap", (F.unix_micros("timestamp_utc") - F.unix_micros(F.lag("timestamp_utc").over(w))) / 1e6)


def interval_stats(ev: DataFrame, keys: list[str]) -> DataFrame:
    g = gaps(ev, keys).groupBy(*keys)
    return g.agg(F.count("*").alias("events"), F.count(F.when(F.col("gap") > 0, 1)).alias("gaps"), F.avg(F.when(F.col("gap") > 0, F.col("gap"))).alias("mean"), F.stddev_pop(F.when(F.col("gap") > 0, F.col("gap"))).alias("sigma"))


def beacons(ev: DataFrame, keys: list[str], least: int, gaps_least: int, cv: float, mean_least: float = 0, mean_most: float = 1e18) -> DataFrame:
    """Keys whose events come at regular times: sigma / mean of the gaps below ``cv``."""
    s = interval_stats(ev, keys).where((F.col("events") >= least) & (F.col("gaps") >= gaps_least) & (F.col("mean") >= mean_least) & (F.col("mean") < mean_most) & (F.col("sigma") / F.col("mean") < cv))
    return s.select(*keys, "events", F.round("mean", 4).alias("mean"), F.round(1 - F.col("sigma") / F.col("mean"), 4).alias("regularity"))


def net_profile(net: DataFrame) -> DataFrame:
    """By process: addresses, ports, first and last time, and why its traffic is odd."""
    p = net.groupBy("process_name").agg(F.countDistinct("dest_ip").alias("ips"), F.countDistinct("dest_port").alias("ports"), F.min("timestamp_utc").alias("first"), F.max("timestamp_utc").alias("last"), F.max(F.when(S.ip_class(F.col("dest_ip")) == "EXTERNAL", 1).otherwise(0)).alias("out"))
    kind = S.proc_class(F.col("process_name"))
    return p.select("process_name", "ips", "ports", "first", "last", F.array_join(F.array_compact(F.array(F.when((kind == "SYSTEM_PROCESS") & (F.col("out") == 1), F.lit("system process outside")), F.when(kind == "KNOWN_ATTACK_TOOL", F.lit("attack tool")), F.when((kind == "WINDOWS_TOOL") & (F.col("out") == 1), F.lit("tool outside")))), ";").alias("reasons"))


def dga(names: DataFrame) -> DataFrame:
    """Distinct query names judged by their second-level label."""
    d = names.select("query_name").distinct().withColumn("parts", F.split(F.lower("query_name"), r"\.")).where(F.size("parts") >= 2)
    d = d.withColumn("sld", F.element_at("parts", -2)).where(~F.col("sld").isin("com", "net", "org", "edu", "gov", "co", "io"))
    letters = F.length(F.regexp_replace("sld", "[^\\p{L}]", ""))
    vowels = F.length(F.regexp_replace("sld", "[^aeiou]", ""))
    consonants, digits, n = letters - vowels, F.length(F.regexp_replace("sld", "[^0-9]", "")), F.length("sld")
    ratio = F.when((consonants > 0) & (vowels > 0), consonants / vowels)
    d = d.withColumn("entropy", S.entropy(F.col("sld")))
    marks = [F.col("entropy") > 3.5, n > 12, F.coalesce((ratio > 4) | (ratio < 0.25), F.lit(False)), digits > n * 0.3]
    count = sum((m.cast("int") for m in marks[1:]), marks[0].cast("int"))
    return d.select("query_name", "sld", F.round("entropy", 6).alias("entropy"), count.cast("long").alias("marks"), ((count >= 2) | (marks[0] & marks[1])).alias("suspect"))


def tunnel(names: DataFrame) -> DataFrame:
    """By base domain: long labels, volume, share of distinct labels and their mean entropy."""
    d = names.withColumn("parts", F.split("query_name", r"\.")).where(F.size("parts") >= 2)
    d = d.select(F.array_join(F.slice("parts", F.size("parts") - 1, F.lit(2)), ".").alias("base"), F.array_join(F.slice("parts", F.lit(1), F.size("parts") - 2), ".").alias("sub"))
    per = d.groupBy("base", "sub").agg(F.count("*").alias("n"))
    per = per.withColumn("e", F.when(F.col("sub") != "", S.entropy(F.col("sub"))))
    g = per.groupBy("base").agg(F.sum("n").alias("queries"), F.count(F.when(F.col("sub") != "", 1)).alias("subs"), F.sum(F.when(F.length("sub") > 50, F.col("n")).otherwise(0)).alias("long"), F.avg("e").alias("e"))
    marks = (F.col("long") > 0).cast("int") + (F.col("queries") > 50).cast("int") + ((F.col("queries") > 10) & (F.col("subs") / F.col("queries") > 0.8)).cast("int") + F.coalesce(F.col("e") > 4.0, F.lit(False)).cast("int")
    return g.withColumn("marks", marks.cast("long")).where("marks > 0").select("base", "queries", "subs", "marks", F.when(F.col("marks") >= 2, "HIGH").otherwise("MEDIUM").alias("severity"))


def web_bruteforce(web: DataFrame) -> DataFrame:
    hit = web.where(F.col("status_code").isin(401, 403)).groupBy("source_ip", "uri").agg(F.count("*").alias("n")).where("n > 10")
    return hit.withColumn("severity", F.when(F.col("n") > 50, "HIGH").otherwise("MEDIUM"))


def log_tampering(ev: DataFrame) -> DataFrame:
    """By source: few security or script events, cleared logs."""
    g = ev.groupBy("source_file").agg(F.count(F.when(F.col("event_code") >= 4600, 1)).alias("security"), F.count(F.when(F.col("event_code").isin(400, 4104), 1)).alias("script"), F.count(F.when(F.col("event_code").isin(1102, 104), 1)).alias("cleared"))
    return g.withColumn("tampered", (F.col("security") < 10) | (F.col("script") < 5) | (F.col("cleared") > 0))


def os_hints(ev: DataFrame) -> DataFrame:
    hint = F.when(F.col("file_path").rlike(r"^[A-Za-z]:\\"), "Windows").when(F.col("file_path").startswith("/"), "Unix")
    return ev.groupBy("source_system").agg(F.array_join(F.sort_array(F.collect_set(hint)), ",").alias("hints"))


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n"))


def known_ids(spark) -> DataFrame:
    return spark.createDataFrame(rules.EVENT_IDS, "id long, name string, category string, significance string, expected long")


def _q(f, *cols):
    return lambda spark, d: f(security_events(spark, d))


def _hosts(spark, d):
    return page_hosts(spark, d).select(F.try_parse_url("url", F.lit("HOST")).alias("query_name")).where("query_name IS NOT NULL")


_KNOWN = "known(id, name, category, significance, expected) AS (VALUES " + ", ".join(f"({i}, '{n}', '{c}', '{s}', {e})" for i, n, c, s, e in rules.EVENT_IDS) + ")"
_H = "h AS (SELECT date_trunc('hour', timestamp_utc) AS hour, count(*) AS n FROM sec GROUP BY 1)"
_ENT = "list_sum(list_transform(list_distinct(string_split({0}, '')), lambda c: -(len(list_filter(string_split({0}, ''), lambda x: x = c)) / length({0})::DOUBLE) * log2(len(list_filter(string_split({0}, ''), lambda x: x = c)) / length({0})::DOUBLE)))"
_HOSTS = "hosts AS (SELECT regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1) AS query_name FROM pages), q AS (SELECT query_name FROM hosts WHERE query_name <> '')"
_GAPS = "g AS (SELECT *, (epoch_us(timestamp_utc) - epoch_us(lag(timestamp_utc) OVER (PARTITION BY {0} ORDER BY timestamp_utc, row_id))) / 1e6 AS gap FROM sec{1}), s AS (SELECT {0}, count(*) AS events, count(*) FILTER (gap > 0) AS gaps, avg(gap) FILTER (gap > 0) AS mean, stddev_pop(gap) FILTER (gap > 0) AS sigma FROM g GROUP BY {0})"

QUERIES = {
    "event_type_dist": _q(type_counts),
    "hourly_spikes_sigma": _q(spikes_by_sigma),
    "hourly_spikes_ratio": _q(spikes_by_ratio),
    "timeline_bounds": _q(bounds),
    "entity_sets": _q(entity_sets),
    "os_indicators": _q(os_hints),
    "web_stats": _q(web_stats),
    "eventid_volume": lambda s, d: id_volume(security_events(s, d), known_ids(s)),
    "rare_values": lambda s, d: rare_values(security_events(s, d).withColumn("command_line", F.concat("command_line", F.when(F.col("row_id") % 2000 == 0, F.col("row_id").cast("string")).otherwise(""))), RARE_COLUMNS),
    "first_seen": _q(first_seen),
    "attack_window": lambda s, d: attack_window(security_events(s, d), security_events(s, d).where("command_line LIKE '%lsass%' AND event_code = 1")),
    "conversations": _q(conversations),
    "port_distribution": _q(port_distribution),
    "port_scan": lambda s, d: port_scan(planted_events(s, d), 20),
    "interval_stats": lambda s, d: interval_stats(security_events(s, d), ["username"]).select("username", "events", "gaps", F.round("mean", 4).alias("mean"), F.round("sigma", 4).alias("sigma")),
    "beacon_conn": lambda s, d: beacons(planted_events(s, d), ["source_ip", "dest_ip", "dest_port"], 5, 4, 0.1, 10),
    "beacon_process": lambda s, d: beacons(planted_events(s, d), ["process_name"], 5, 1, 0.3, 0, 1e9),
    "net_profile": _q(net_profile),
    "dns_dga": lambda s, d: dga(security_events(s, d).select("query_name").union(_hosts(s, d))),
    "dns_tunnel": lambda s, d: tunnel(security_events(s, d).select("query_name").union(_hosts(s, d))),
    "web_bruteforce": _q(web_bruteforce),
    "log_tampering": _q(log_tampering),
    "account_by_type": lambda s, d: counts_by(security_events(s, d).where(F.col("event_code").isin([x[0] for x in rules.ACCOUNT_EVENTS])), "event_code"),
    "events_by_user": lambda s, d: counts_by(security_events(s, d), "username"),
    "topk_counts": lambda s, d: counts_by(security_events(s, d), "process_name").orderBy(F.desc("n"), "name").limit(5),
}
ORACLES = {
    "event_type_dist": f"WITH {SEC} SELECT event_type, count(*) AS n, count(*) < 3 AS rare FROM sec GROUP BY 1",
    "hourly_spikes_sigma": f"WITH {SEC}, {_H}, s AS (SELECT avg(n) AS mean, stddev_pop(n) AS sigma FROM h) SELECT hour, n, round((n - mean) / sigma, 2) AS distance FROM h, s WHERE n > mean + 2 * sigma",
    "hourly_spikes_ratio": f"WITH {SEC}, {_H}, s AS (SELECT avg(n) AS mean FROM h) SELECT hour, n, round(n / mean, 2) AS ratio FROM h, s WHERE n > 2 * mean ORDER BY n DESC, hour LIMIT 10",
    "timeline_bounds": f"WITH {SEC} SELECT min(timestamp_utc) AS first, max(timestamp_utc) AS last, count(*) AS n, round((epoch_us(max(timestamp_utc)) - epoch_us(min(timestamp_utc))) / 3600e6, 4) AS hours FROM sec",
    "entity_sets": f"WITH {SEC}, x AS (SELECT DISTINCT 'user' AS kind, username AS name FROM sec UNION SELECT 'ip', source_ip FROM sec UNION SELECT 'host', source_system FROM sec UNION SELECT 'process', process_name FROM sec), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY name) AS rk FROM x) SELECT kind, count(*) AS n, string_agg(name, ',' ORDER BY name) FILTER (rk <= 100) AS names FROM r GROUP BY 1",
    "os_indicators": f"WITH {SEC} SELECT source_system, CASE WHEN bool_or(file_path LIKE 'C:%') THEN 'Windows' ELSE '' END AS hints FROM sec GROUP BY 1",
    "web_stats": f"WITH {SEC}, m AS (SELECT 'method' AS kind, http_method AS name, count(*) AS n FROM sec GROUP BY 2), s AS (SELECT 'status' AS kind, CAST(status_code AS VARCHAR) AS name, count(*) AS n FROM sec GROUP BY 2 ORDER BY n DESC, 2 LIMIT 20), u AS (SELECT 'uri' AS kind, split_part(uri, '?', 1) AS name, count(*) AS n FROM sec GROUP BY 2 ORDER BY n DESC, 2 LIMIT 20), a AS (SELECT 'agent' AS kind, left(user_agent, 100) AS name, count(*) AS n FROM sec GROUP BY 2 ORDER BY n DESC, 2 LIMIT 10) FROM m UNION ALL FROM s UNION ALL FROM u UNION ALL FROM a",
    "eventid_volume": f"WITH {SEC}, {_KNOWN}, c AS (SELECT source_system, event_code AS id, count(*) AS n FROM sec GROUP BY 1, 2), j AS (SELECT * FROM c JOIN known USING (id)) SELECT source_system, CAST(id AS BIGINT) AS id, n, category, 'volume' AS flag FROM j WHERE n > 2 * expected AND significance IN ('MEDIUM', 'HIGH', 'CRITICAL') UNION ALL SELECT source_system, CAST(id AS BIGINT), n, category, 'significance' FROM j WHERE significance IN ('HIGH', 'CRITICAL')",
    "rare_values": f"WITH {SEC}, e AS (SELECT * REPLACE (command_line || CASE WHEN row_id % 2000 = 0 THEN CAST(row_id AS VARCHAR) ELSE '' END AS command_line) FROM sec), l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, timestamp_utc FROM e" for c in RARE_COLUMNS) + "), n AS (SELECT \"column\", value, count(*) AS n, min(timestamp_utc) AS first, max(timestamp_utc) AS last FROM l GROUP BY 1, 2), m AS (SELECT \"column\", median(n) AS med FROM n GROUP BY 1) SELECT \"column\", value, n, first, last, round(med / n, 6) AS score FROM n JOIN m USING (\"column\") WHERE med > 50 AND n <= 3",
    "first_seen": f"WITH {SEC} SELECT kind, name, min(timestamp_utc) AS first FROM (SELECT 'user' AS kind, username AS name, timestamp_utc FROM sec UNION ALL SELECT 'process', process_name, timestamp_utc FROM sec UNION ALL SELECT 'ip', source_ip, timestamp_utc FROM sec UNION ALL SELECT 'service', service_name, timestamp_utc FROM sec) GROUP BY 1, 2",
    "attack_window": f"WITH {SEC}, w AS (SELECT min(timestamp_utc) - INTERVAL 30 MINUTE AS b, max(timestamp_utc) AS e FROM sec WHERE command_line LIKE '%lsass%' AND event_code = 1), f AS (SELECT kind, name, min(timestamp_utc) AS first FROM (SELECT 'user' AS kind, username AS name, timestamp_utc FROM sec UNION ALL SELECT 'process', process_name, timestamp_utc FROM sec UNION ALL SELECT 'ip', source_ip, timestamp_utc FROM sec UNION ALL SELECT 'service', service_name, timestamp_utc FROM sec) GROUP BY 1, 2) SELECT kind, name, first, first BETWEEN b AND e AS inside FROM f, w",
    "conversations": f"WITH {SEC} SELECT source_ip, dest_ip, count(*) AS n, count(DISTINCT dest_port) AS ports FROM sec GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20",
    "port_distribution": f"WITH {SEC} SELECT dest_port, count(*) AS n FROM sec GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20",
    "port_scan": f"WITH {PLANTED} SELECT source_ip, dest_ip, count(DISTINCT dest_port) AS ports FROM sec GROUP BY 1, 2 HAVING count(DISTINCT dest_port) > 20",
    "interval_stats": f"WITH {SEC}, {_GAPS.format('username', '')} SELECT username, events, gaps, round(mean, 4) AS mean, round(sigma, 4) AS sigma FROM s",
    "beacon_conn": f"WITH {PLANTED}, {_GAPS.format('source_ip, dest_ip, dest_port', '')} SELECT source_ip, dest_ip, dest_port, events, round(mean, 4) AS mean, round(1 - sigma / mean, 4) AS regularity FROM s WHERE events >= 5 AND gaps >= 4 AND mean >= 10 AND sigma / mean < 0.1",
    "beacon_process": f"WITH {PLANTED}, {_GAPS.format('process_name', '')} SELECT process_name, events, round(mean, 4) AS mean, round(1 - sigma / mean, 4) AS regularity FROM s WHERE events >= 5 AND gaps >= 1 AND mean < 1e9 AND sigma / mean < 0.3",
    "net_profile": f"WITH {SEC}, p AS (SELECT process_name, count(DISTINCT dest_ip) AS ips, count(DISTINCT dest_port) AS ports, min(timestamp_utc) AS first, max(timestamp_utc) AS last, bool_or(dest_ip IN ('198.51.100.7', '203.0.113.9', '172.32.0.5')) AS outside FROM sec GROUP BY 1) SELECT process_name, ips, ports, first, last, CASE WHEN process_name IN ('svchost.exe', 'explorer.exe') AND outside THEN 'system process outside' WHEN process_name = 'mimikatz.exe' THEN 'attack tool' WHEN process_name IN ('cmd.exe', 'powershell.exe', 'certutil.exe', 'rundll32.exe', 'net.exe', 'mshta.exe') AND outside THEN 'tool outside' ELSE '' END AS reasons FROM p",
    "dns_dga": f"WITH {SEC}, {_HOSTS}, d AS (SELECT DISTINCT query_name FROM (SELECT query_name FROM sec UNION ALL SELECT query_name FROM q)), p AS (SELECT query_name, string_split(lower(query_name), '.')[-2] AS sld FROM d WHERE len(string_split(query_name, '.')) >= 2), m AS (SELECT *, {_ENT.format('sld')} AS e, length(regexp_replace(sld, '[^aeiou]', '', 'g')) AS v, length(regexp_replace(sld, '[^\\p{{L}}]', '', 'g')) AS le, length(regexp_replace(sld, '[^0-9]', '', 'g')) AS di, length(sld) AS n FROM p WHERE sld NOT IN ('com', 'net', 'org', 'edu', 'gov', 'co', 'io')), c AS (SELECT *, (e > 3.5)::INT + (n > 12)::INT + (v > 0 AND le - v > 0 AND ((le - v) / v > 4 OR (le - v) / v < 0.25))::INT + (di > n * 0.3)::INT AS marks FROM m) SELECT query_name, sld, round(e, 6) AS entropy, CAST(marks AS BIGINT) AS marks, marks >= 2 OR (e > 3.5 AND n > 12) AS suspect FROM c",
    "dns_tunnel": f"WITH {SEC}, {_HOSTS}, d AS (SELECT string_split(query_name, '.') AS p FROM (SELECT query_name FROM sec UNION ALL SELECT query_name FROM q)), x AS (SELECT array_to_string(p[-2:], '.') AS base, array_to_string(p[1:len(p) - 2], '.') AS sub FROM d WHERE len(p) >= 2), pe AS (SELECT base, sub, count(*) AS n, CASE WHEN sub <> '' THEN {_ENT.format('sub')} END AS e FROM x GROUP BY base, sub), g AS (SELECT base, CAST(sum(n) AS BIGINT) AS queries, count(*) FILTER (sub <> '') AS subs, sum(CASE WHEN length(sub) > 50 THEN n ELSE 0 END) AS lng, avg(e) AS e FROM pe GROUP BY 1), m AS (SELECT *, (lng > 0)::INT + (queries > 50)::INT + (queries > 10 AND subs / queries > 0.8)::INT + coalesce(e > 4, false)::INT AS marks FROM g) SELECT base, queries, subs, CAST(marks AS BIGINT) AS marks, CASE WHEN marks >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM m WHERE marks > 0",
    "web_bruteforce": f"WITH {SEC} SELECT source_ip, uri, count(*) AS n, CASE WHEN count(*) > 50 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM sec WHERE status_code IN (401, 403) GROUP BY 1, 2 HAVING count(*) > 10",
    "log_tampering": f"WITH {SEC}, g AS (SELECT source_file, count(*) FILTER (event_code >= 4600) AS security, count(*) FILTER (event_code IN (400, 4104)) AS script, count(*) FILTER (event_code IN (1102, 104)) AS cleared FROM sec GROUP BY 1) SELECT *, security < 10 OR script < 5 OR cleared > 0 AS tampered FROM g",
    "account_by_type": f"WITH {SEC} SELECT event_code AS name, count(*) AS n FROM sec WHERE event_code IN ({', '.join(str(x[0]) for x in rules.ACCOUNT_EVENTS)}) GROUP BY 1",
    "events_by_user": f"WITH {SEC} SELECT username AS name, count(*) AS n FROM sec GROUP BY 1",
    "topk_counts": f"WITH {SEC} SELECT process_name AS name, count(*) AS n FROM sec GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5",
}
