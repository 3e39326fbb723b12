"""Logs whose columns are named by header lines inside the files: W3C web logs, tab-separated sensor logs, host firewall logs.

A header holds from its line to the next one of its file, and a file may change it at any line. Lines are taken in
ranges of a bounded number; inside a range a window carries the last header on, and a table with one row for each range
carries it over the ranges' borders. So no task sees a whole file, and lines are exchanged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..adapters import SEC, security_events

#: Lines of a range.
RANGE = 1 << 16


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, value) of text files, numbered from 1 by splits: no file is read by one task alone.

    A split's rows are numbered as they are read; the numbers of rows in the splits before are added.
    """
    meta = {"file": F.col("_metadata.file_path"), "_split": F.col("_metadata.file_block_start")}
    rows = spark.read.text(path).select(*[c.alias(n) for n, c in meta.items()], F.monotonically_increasing_id().alias("_at"), "value")
    splits = rows.groupBy("file", "_split").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("_split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(splits.withColumn("_before", before), ["file", "_split"]).select("file", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line_no"), "value")


def with_headers(lines: DataFrame, headers: dict[str, Column], size: int = RANGE) -> DataFrame:
    """``lines`` (file, line_no, value) with a column for each of ``headers``: its value in the last line of the file, up
    to and with this one, in which it is not null; null before the first such line."""
    rows = lines.withColumn("_range", F.floor(F.col("line_no") / size)).withColumns({f"_{n}": c for n, c in headers.items()})
    last = [F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.col("line_no"))).alias(f"_last_{n}") for n in headers]
    along = W.partitionBy("file").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carry = rows.groupBy("file", "_range").agg(*last).select("file", "_range", *[F.last(f"_last_{n}", ignorenulls=True).over(along).alias(f"_carry_{n}") for n in headers])
    inside = W.partitionBy("file", "_range").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(carry, ["file", "_range"])
    return out.select(*lines.columns, *[F.coalesce(F.last(f"_{n}", ignorenulls=True).over(inside), F.col(f"_carry_{n}")).alias(n) for n in headers])


def cell(name: str) -> Column:
    """The cell of a column by the names in ``fields``; of two columns of one name the last counts. Null where there is none."""
    at = F.size("fields") - F.array_position(F.reverse("fields"), name).cast("int")
    return F.get("cells", at)


def known(name: str, *unset: str) -> Column:
    return F.when(~cell(name).isin("", "-", *unset), cell(name))


def number(c: Column) -> Column:
    return c.try_cast("bigint")


def _w3c_fields() -> Column:
    return F.when(F.col("value").startswith("#Fields:"), F.filter(F.split(F.btrim(F.substring("value", 9, 1 << 20)), r"\s+"), lambda x: x != ""))


def _w3c_time() -> Column:
    return F.try_to_timestamp(F.concat_ws(" ", cell("date"), cell("time")), F.lit("yyyy-MM-dd HH:mm:ss"))


# What makes a requested address suspicious.
SUSPICIOUS_ADDRESS = [r"\.\.[\\/]", r"['\"].*(?:or|and).*['\"]", "<script", r"cmd\.exe|powershell", r"\.(?:asp|php|jsp)x?\?", r"union\s+select", r"exec\s*\("]


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def norm_iis(lines: DataFrame, size: int = RANGE) -> DataFrame:
    """W3C web server lines as events. Quoted cells hold blanks, two blanks an empty cell; missing cells are ``-``, further
    ones are dropped. Lines before the first header, comments and lines without a time are left out."""
    text = F.replace(F.btrim("value"), F.lit("  "), F.lit(" - "))
    cells = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r'(?:[^ "]++|"[^"]*+(?:"|$))++'), F.lit(0)), lambda x: F.replace(x, F.lit('"'), F.lit(""))), lambda x: x != "")
    rows = with_headers(lines, {"fields": _w3c_fields()}, size).where(~F.col("value").startswith("#") & (F.size("fields") > 0) & (F.btrim("value") != ""))
    rows = rows.withColumn("cells", cells).withColumn("cells", F.transform("fields", lambda f, i: F.coalesce(F.get("cells", i), F.lit("-"))))
    status, address = number(known("sc-status")), cell("cs-uri-stem")
    whole = F.lower(F.concat_ws("?", F.coalesce(address, F.lit("")), known("cs-uri-query")))
    severity = F.when(whole.rlike("|".join(f"(?:{p})" for p in SUSPICIOUS_ADDRESS)), "high").when(status.between(500, 599), "medium").when(status.between(400, 499), "low").otherwise("info")
    stem = F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1)
    prefix = F.upper(F.substring_index(stem, "_", 1))
    host = F.when(stem.contains("_") & ~prefix.isin("U", "EX", "EXTEND"), prefix).otherwise("WEBSERVER")
    return rows.select(
        _w3c_time().alias("timestamp_utc"), F.col("file").alias("source_file"), F.col("line_no").alias("source_line"), F.lit("IIS").alias("event_type"), severity.alias("severity"), host.alias("source_system"),
        known("c-ip").alias("source_ip"), number(known("c-port")).alias("source_port"), known("s-ip").alias("dest_ip"), number(known("s-port")).alias("dest_port"), known("cs-username").alias("username"),
        known("cs-method").alias("http_method"), F.when(F.coalesce(address, F.lit("")) != "-", F.coalesce(address, F.lit(""))).alias("uri"), known("cs-uri-query").alias("query_string"), status.alias("status_code"),
        _decoded(known("cs(User-Agent)")).alias("user_agent"), _decoded(known("cs(Referer)")).alias("referrer"), F.col("value").alias("raw_payload"),
    ).where("timestamp_utc IS NOT NULL")


def _separator() -> Column:
    word = F.regexp_extract("value", r"^#separator\s+(.*)$", 1)
    return F.when(F.col("value").startswith("#separator"), F.when(word == "", "\t").when(word.rlike(r"^\\x[0-9A-Fa-f]{1,4}$"), F.char(F.conv(F.substring(word, 3, 4), 16, 10).cast("int"))).otherwise(word))


def norm_zeek(lines: DataFrame, size: int = RANGE) -> DataFrame:
    """Sensor lines under ``#separator`` and ``#fields`` as events; the kind of log follows from the set of its columns.
    Lines whose number of cells is not that of the header, or without a time, are left out."""
    split = lambda c: F.split(c, F.concat(F.lit(r"\Q"), F.coalesce("separator", F.lit("\t")), F.lit(r"\E")))
    head = F.when(F.col("value").startswith("#fields"), F.col("value"))
    rows = with_headers(lines, {"separator": _separator(), "head": head}, size).where(~F.col("value").startswith("#") & F.col("head").isNotNull())
    names = split(F.col("head"))
    rows = rows.withColumns({"fields": F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0))), "cells": split(F.col("value"))}).where("size(fields) = size(cells)")
    has = lambda n: F.array_contains("fields", n)
    kind = F.when(has("query") & has("answers"), "dns").when(has("method") & has("uri"), "http").when(has("certificate") | has("validation_status"), "ssl").when(has("service") & has("duration"), "conn")
    kind = kind.when(has("user") & has("command"), "ftp").when(has("mailfrom"), "smtp").when(has("file_id"), "files").otherwise("unknown")
    own = lambda *ns: F.coalesce(*[known(n, "(empty)") for n in ns])
    time = F.timestamp_micros(F.round(cell("ts").try_cast("decimal(22,6)") * 1_000_000).cast("bigint"))
    return rows.select(
        time.alias("timestamp_utc"), F.col("file").alias("source_file"), F.col("line_no").alias("source_line"), F.concat(F.lit("Zeek_"), kind).alias("event_type"), F.lit("info").alias("severity"),
        own("id.orig_h", "src").alias("source_ip"), number(own("id.orig_p", "src_port")).alias("source_port"), own("id.resp_h", "dst").alias("dest_ip"), number(own("id.resp_p", "dst_port")).alias("dest_port"),
        own("method").alias("http_method"), own("query", "uri").alias("uri"), own("user_agent").alias("user_agent"), own("referrer").alias("referrer"), number(own("status_code")).alias("status_code"),
        own("user", "username").alias("username"), own("md5", "sha1", "sha256").alias("file_hash"), F.col("value").alias("raw_payload"),
    ).where("timestamp_utc IS NOT NULL")


def norm_winfw(lines: DataFrame, size: int = RANGE) -> DataFrame:
    """Host firewall lines as events; lines with fewer cells than the header, or without a time, are left out."""
    rows = with_headers(lines, {"fields": _w3c_fields()}, size).where(~F.btrim("value").startswith("#") & (F.size("fields") > 0))
    rows = rows.withColumn("cells", F.filter(F.split("value", r"\s+"), lambda x: x != "")).where("size(cells) >= size(fields)")
    action = F.upper(F.coalesce(cell("action"), F.lit("")))
    severity = F.when(action == "DROP", "medium").when((action == "ALLOW") & (F.upper(F.coalesce(cell("direction"), F.lit(""))) == "IN"), "low").otherwise("info")
    return rows.select(
        _w3c_time().alias("timestamp_utc"), F.col("file").alias("source_file"), F.col("line_no").alias("source_line"), F.concat_ws("_", F.lit("Firewall"), action, known("protocol")).alias("event_type"), severity.alias("severity"),
        known("src-ip").alias("source_ip"), number(known("src-port")).alias("source_port"), known("dst-ip").alias("dest_ip"), number(known("dst-port")).alias("dest_port"), known("path").alias("file_path"), F.col("value").alias("raw_payload"),
    ).where("timestamp_utc IS NOT NULL")


#: Rows after which the logs made from the test events change their header.
BLOCK = 500


def _log(ev: DataFrame, name: str, headers: list[list[str]], values: list[Column]) -> DataFrame:
    """A table of raw lines: five files, in each the headers in turn, every ``BLOCK`` events anew, and the events under them."""
    ev = ev.select("*", F.format_string(name, F.col("user_id") % 5).alias("file"), F.floor(F.col("row_id") / BLOCK).alias("block"))
    which = F.col("block") % len(headers)
    pick = lambda choices: F.coalesce(*[F.when(which == i, c) for i, c in enumerate(choices)])
    heads = ev.select("file", "block").distinct().select("file", (F.col("block") * BLOCK * 9).alias("line_no"), F.posexplode(pick([F.array(*map(F.lit, h)) for h in headers])).alias("p", "value"))
    data = ev.select("file", (F.col("row_id") * 9 + 8).alias("line_no"), pick(values).alias("value"))
    return heads.select("file", (F.col("line_no") + F.col("p")).alias("line_no"), "value").unionByName(data)


def iis_lines(ev: DataFrame) -> DataFrame:
    agent = F.when(F.col("k") % 3 == 0, F.concat(F.lit('"'), "user_agent", F.lit(' (Win NT)"'))).otherwise(F.concat("user_agent", F.lit("+(Win%20NT)")))
    query, clock = F.replace("query_string", F.lit(" "), F.lit("%20")), F.date_format("timestamp_utc", "yyyy-MM-dd HH:mm:ss")
    first = F.concat_ws(" ", clock, "source_ip", "http_method", "uri", query, agent, F.col("status_code").cast("string"))
    second = F.concat_ws(" ", clock, F.col("dest_port").cast("string"), F.col("status_code").cast("string"), "uri", query, "http_method", "source_ip", agent, "username", F.lit("further cells"))
    return _log(ev, "WEB0%d_u_ex240101.log", [["#Software: Microsoft Internet Information Services 10.0", "#Fields: date time c-ip cs-method cs-uri-stem cs-uri-query cs(User-Agent) sc-status"], ["#Fields: date time s-port sc-status cs-uri-stem cs-uri-query cs-method c-ip cs(User-Agent) cs-username"]], [first, second])


def zeek_lines(ev: DataFrame) -> DataFrame:
    clock, port = F.concat(F.unix_seconds("timestamp_utc").cast("string"), F.lit(".5")), F.col("dest_port").cast("string")
    dns = F.concat_ws("\t", clock, "source_ip", F.lit("53000"), "dest_ip", port, "query_name", F.lit("(empty)"))
    http = F.concat_ws(",", clock, "source_ip", F.lit("-"), "dest_ip", port, "http_method", "uri", "user_agent", F.col("status_code").cast("string"))
    conn = F.concat_ws("\t", clock, "source_ip", F.lit("-"), "dest_ip", port, F.lit("ssl"), F.when(F.col("k") % 4 == 0, F.lit("1.0\tone too many")).otherwise("1.0"))
    ends = "ts{0}id.orig_h{0}id.orig_p{0}id.resp_h{0}id.resp_p{0}"
    tab, comma = ends.format("\t"), ends.format(",")
    return _log(ev, "sensor%d.log", [["#separator \\x09", "#path\tdns", f"#fields\t{tab}query\tanswers"], ["#separator ,", f"#fields,{comma}method,uri,user_agent,status_code"], ["#separator \\x09", f"#fields\t{tab}service\tduration", "#types\ttime"]], [dns, http, conn])


def winfw_lines(ev: DataFrame) -> DataFrame:
    clock, action = F.date_format("timestamp_utc", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("k") % 2 == 0, "DROP").otherwise("ALLOW")
    port, way = F.col("dest_port").cast("string"), F.when(F.col("k") % 3 == 0, "RECEIVE").otherwise("SEND")
    first = F.concat_ws(" ", clock, action, F.lit("TCP"), "source_ip", "dest_ip", F.lit("-"), port, way)
    second = F.concat_ws("  ", clock, F.when(F.col("k") % 3 == 0, "IN").otherwise("OUT"), action, F.when(F.col("k") % 5 == 0, "-").otherwise("UDP"), "dest_ip", "source_ip", port)
    return _log(ev, "pfirewall%d.log", [["#Version: 1.5", "#Fields: date time action protocol src-ip dst-ip src-port dst-port path"], ["#Fields: date time direction action protocol dst-ip src-ip dst-port"]], [first, second])


_NAMES = "source_file, source_line"


def _from(lines, norm, *columns: str):
    """The registered form: small ranges, so that headers are carried over borders on the test tables too."""
    return lambda s, d: norm(lines(security_events(s, d)), 1 << 12).select("timestamp_utc", "source_file", "source_line", "event_type", "severity", *columns)


_HIGH = "uri = '/a/../../etc/passwd' OR query_string LIKE '%<script>%' OR (query_string <> '' AND uri IN ('/shell.aspx', '/login.php', '/cmd.aspx'))"
_BASE = f"date_trunc('second', timestamp_utc) AS timestamp_utc, '{{}}' || user_id % 5 || '{{}}' AS source_file, row_id * 9 + 8 AS source_line"
_TURN = f"(row_id // {BLOCK}) %"

QUERIES = {
    "norm_iis": _from(iis_lines, norm_iis, "source_system", "source_ip", "dest_port", "username", "http_method", "uri", "query_string", "status_code", "user_agent", "referrer"),
    "norm_zeek": _from(zeek_lines, norm_zeek, "source_ip", "source_port", "dest_ip", "dest_port", "http_method", "uri", "user_agent", "status_code"),
    "norm_winfw": _from(winfw_lines, norm_winfw, "source_ip", "source_port", "dest_ip", "dest_port", "file_path"),
}
ORACLES = {
    "norm_iis": f"WITH {SEC} SELECT {_BASE.format('WEB0', '_u_ex240101.log')}, 'IIS' AS event_type, CASE WHEN {_HIGH} THEN 'high' WHEN status_code >= 500 THEN 'medium' WHEN status_code >= 400 THEN 'low' ELSE 'info' END AS severity, "
    f"'WEB0' || user_id % 5 AS source_system, source_ip, CASE WHEN {_TURN} 2 = 1 THEN CAST(dest_port AS BIGINT) END AS dest_port, CASE WHEN {_TURN} 2 = 1 THEN username END AS username, http_method, uri, "
    "nullif(replace(query_string, ' ', '%20'), '') AS query_string, CAST(status_code AS BIGINT) AS status_code, user_agent || ' (Win NT)' AS user_agent, CAST(NULL AS VARCHAR) AS referrer FROM sec",
    "norm_zeek": f"WITH {SEC} SELECT date_trunc('second', timestamp_utc) + INTERVAL 500 MILLISECONDS AS timestamp_utc, 'sensor' || user_id % 5 || '.log' AS source_file, row_id * 9 + 8 AS source_line, 'Zeek_' || CASE {_TURN} 3 WHEN 0 THEN 'dns' WHEN 1 THEN 'http' ELSE 'conn' END AS event_type, 'info' AS severity, "
    f"source_ip, CASE WHEN {_TURN} 3 = 0 THEN CAST(53000 AS BIGINT) END AS source_port, dest_ip, CAST(dest_port AS BIGINT) AS dest_port, CASE WHEN {_TURN} 3 = 1 THEN http_method END AS http_method, CASE {_TURN} 3 WHEN 0 THEN query_name WHEN 1 THEN uri END AS uri, "
    f"CASE WHEN {_TURN} 3 = 1 THEN user_agent END AS user_agent, CASE WHEN {_TURN} 3 = 1 THEN CAST(status_code AS BIGINT) END AS status_code FROM sec WHERE {_TURN} 3 < 2 OR k % 4 <> 0",
    "norm_winfw": f"WITH {SEC} SELECT {_BASE.format('pfirewall', '.log')}, 'Firewall_' || CASE WHEN k % 2 = 0 THEN 'DROP' ELSE 'ALLOW' END || CASE WHEN {_TURN} 2 = 0 THEN '_TCP' WHEN k % 5 = 0 THEN '' ELSE '_UDP' END AS event_type, "
    f"CASE WHEN k % 2 = 0 THEN 'medium' WHEN {_TURN} 2 = 1 AND k % 3 = 0 THEN 'low' ELSE 'info' END AS severity, source_ip, CAST(NULL AS BIGINT) AS source_port, dest_ip, CAST(dest_port AS BIGINT) AS dest_port, CASE WHEN {_TURN} 2 = 0 THEN CASE WHEN k % 3 = 0 THEN 'RECEIVE' ELSE 'SEND' END END AS file_path FROM sec",
}
