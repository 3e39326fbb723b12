"""The indicator table: what events name in any of their fields and in what those hide, with its sources, times and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..adapters import SEC, security_events
from ..functions import scalars as S
from ..store import stored
from .layers import decodings
from .layers import indicators as inside

# Kinds of indicators, parts of domains that are of no interest, and processes that make an indicator worse.
KINDS = {
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "url": r"https?://[^\s<>\"]+", "domain": r"\b(?:[a-zA-Z0-9][-a-zA-Z0-9]*\.)+[a-zA-Z]{2,}\b", "md5": r"\b[a-fA-F0-9]{32}\b", "sha1": r"\b[a-fA-F0-9]{40}\b", "sha256": r"\b[a-fA-F0-9]{64}\b",
}
PLAIN_DOMAINS = ["localhost", "internal", ".local", "microsoft.com", "windows.com"]
SHELLS = ["cmd.exe", "powershell.exe", "w3wp.exe"]
FIELDS = ["source_ip", "dest_ip", "process_name", "parent_process_name", "command_line", "uri", "query_string", "user_agent", "service_name", "registry_key", "file_path"]
#: Sources that a row of the table names.
NAMED = 10


def _found(text: Column) -> Column:
    """(kind, value) of what a text names."""

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    return F.flatten(F.array(*[of(k, p) for k, p in KINDS.items()]))


def ioc_table(ev: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """(kind, value, first, last, sources, named, users, processes, risk) of the indicators of events.

    Each distinct text is searched once, whatever the number of its events, fields, users and processes. Indicators in
    decoded parts are high, those of shells too; with three sources they go one level up, to critical or from low to medium.
    """
    own = ev.select("timestamp_utc", "username", "process_name", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])).alias("x")).select("timestamp_utc", "username", "process_name", "x.*")
    texts = stored(own.where("text <> ''").groupBy("field", "text", "username", "process_name").agg(F.min("timestamp_utc").alias("first"), F.max("timestamp_utc").alias("last")))
    once = texts.select("text").distinct()
    plain = once.select("text", F.lit(False).alias("hidden"), F.explode(_found(F.col("text"))).alias("i"))
    urls, ips = inside(F.col("d.text"))[:2]
    both = F.concat(F.transform(ips, lambda v: F.struct(F.lit("ipv4").alias("kind"), v.alias("value"))), F.transform(urls, lambda v: F.struct(F.lit("url").alias("kind"), v.alias("value"))))
    decoded = once.select("text", F.explode(decodings(F.col("text"))).alias("d")).select("text", F.lit(True).alias("hidden"), F.explode(both).alias("i"))
    named = plain.unionByName(decoded).select("text", "hidden", "i.*")
    ordinary = F.exists(F.array(*map(F.lit, PLAIN_DOMAINS)), lambda p: F.lower("value").contains(p))
    named = named.where(F.when(F.col("kind") == "ipv4", S.ip_class(F.col("value")) == "EXTERNAL").when(F.col("kind") == "domain", ~ordinary).otherwise(True))
    rows = texts.join(named, "text").withColumn("field", F.when(F.col("hidden"), "decoded_content").otherwise(F.col("field")))
    # fields as bits: sets of names would leave the hash aggregation for sorted rows
    names = sorted([*fields, "decoded_content"])
    bit = F.element_at(F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(1 << i).cast("long"))]), F.col("field"))
    met = rows.groupBy("kind", "value", "username", "process_name").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.bit_or(bit).alias("bits"))
    g = met.groupBy("kind", "value").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.bit_or("bits").alias("bits"), F.countDistinct("username").alias("users"), F.countDistinct("process_name").alias("processes"),
        F.max(F.col("process_name").isin(SHELLS)).alias("shell"),
    )
    g = g.withColumn("fields", F.array_compact(F.array(*[F.when(F.col("bits").bitwiseAND(F.lit(1 << i).cast("long")) != 0, n) for i, n in enumerate(names)])))
    many, high = F.size("fields") >= 3, F.array_contains("fields", "decoded_content") | F.coalesce("shell", F.lit(False))
    risk = F.when(many & high, "CRITICAL").when(high, "HIGH").when(many, "MEDIUM").otherwise("LOW")
    return g.select("kind", "value", "first", "last", F.size("fields").cast("long").alias("sources"), F.array_join(F.slice("fields", 1, NAMED), ",").alias("named"), "users", "processes", risk.alias("risk"))


def indicator_events(s, d) -> DataFrame:
    """Test events of which some hide an address in base64 and some name it in another field."""
    ev = security_events(s, d)
    hidden = F.concat(F.lit("run "), F.regexp_replace(F.base64(F.encode(F.concat(F.lit("get http://198.51.100.77/x from 198.51.100.7 by "), F.col("row_id").cast("string")), "UTF-8")), r"\s", ""))
    return ev.withColumns({"command_line": F.when(F.col("row_id") % 50 == 0, hidden).otherwise(F.col("command_line")), "query_string": F.when(F.col("row_id") % 70 == 3, F.concat(F.lit("h=198.51.100.77&m=d41d8cd98f00b204e9800998ecf8427e&n="), F.col("username"))).otherwise(F.col("query_string"))})


_EVENTS = (
    SEC.replace("sec AS", "sec0 AS", 1) + ", sec AS (SELECT * REPLACE (CASE WHEN row_id % 50 = 0 THEN 'run ' || to_base64(encode('get http://198.51.100.77/x from 198.51.100.7 by ' || row_id)) ELSE command_line END AS command_line, CASE WHEN row_id % 70 = 3 THEN 'h=198.51.100.77&m=d41d8cd98f00b204e9800998ecf8427e&n=' || username ELSE query_string END AS query_string) FROM sec0)"
)
_HIDDEN = " UNION ALL SELECT timestamp_utc, username, process_name, 'decoded_content', unnest(['url', 'ipv4', 'ipv4']), unnest(['http://198.51.100.77/x', '198.51.100.77', '198.51.100.7']) FROM sec WHERE row_id % 50 = 0"


def table_sql(events: str, hidden: str = "") -> str:
    """The table for DuckDB, over events defined as ``sec`` and what is known to be hidden in them."""
    texts = " UNION ALL ".join(f"SELECT timestamp_utc, username, process_name, '{f}' AS field, {f} AS text FROM sec" for f in FIELDS)
    found = " UNION ALL ".join(f"SELECT timestamp_utc, username, process_name, field, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS value FROM t" for k, p in KINDS.items())
    return (
        f"WITH {events}, t AS ({texts}), x AS ({found}{hidden}), "
        "y AS (SELECT * FROM x WHERE CASE kind WHEN 'ipv4' THEN NOT regexp_matches(value, '^(10|127|0|192[.]168|169[.]254|172[.](1[6-9]|2[0-9]|3[01]))[.]') WHEN 'domain' THEN NOT regexp_matches(lower(value), 'localhost|internal|[.]local|microsoft[.]com|windows[.]com') ELSE true END), "
        "g AS (SELECT kind, value, min(timestamp_utc) AS first, max(timestamp_utc) AS last, count(DISTINCT field) AS sources, string_agg(DISTINCT field, ',' ORDER BY field) AS named, count(DISTINCT username) AS users, count(DISTINCT process_name) AS processes, bool_or(process_name IN ('cmd.exe', 'powershell.exe', 'w3wp.exe') OR field = 'decoded_content') AS high FROM y GROUP BY 1, 2) "
        "SELECT kind, value, first, last, sources, named, users, processes, CASE WHEN high AND sources >= 3 THEN 'CRITICAL' WHEN high THEN 'HIGH' WHEN sources >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM g"
    )


TABLE = table_sql(_EVENTS, _HIDDEN)


def _ev(f):
    return lambda s, d: f(ioc_table(indicator_events(s, d)))


QUERIES = {
    "ioc_table": _ev(lambda t: t),
    "ioc_by_type": _ev(lambda t: t.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("risk").isin("HIGH", "CRITICAL")).alias("high"))),
    "risk_sort": _ev(lambda t: t.select("kind", "value", "risk").orderBy(S.severity_rank(F.col("risk")), "value")),
}
ORACLES = {
    "ioc_table": TABLE,
    "ioc_by_type": f"SELECT kind, count(*) AS n, count(*) FILTER (risk IN ('HIGH', 'CRITICAL')) AS high FROM ({TABLE}) GROUP BY 1",
    "risk_sort": f"SELECT kind, value, risk FROM ({TABLE}) ORDER BY CASE risk WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END, value",
}
