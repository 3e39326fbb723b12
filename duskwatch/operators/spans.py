"""Indicators in strings, with their places: spans, what lies inside others, and first occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..adapters import table

# Kinds of indicators in the strings of a dump: pattern, severity, least length.
STRING_KINDS = {
    "ip_address": (r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|1?\d\d?)\b", "medium", 0),
    "url": (r"(?i)https?://[^\s<>\"'})\]]{1,500}", "high", 10),
    "domain": (r"(?i)\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:com|net|org|info|biz|ru|cn|tk|cc|pw|xyz|top|php)\b", "medium", 5),
    "php_path": (r"(?i)[a-z0-9./~_-]+\.php\b", "high", 5),
    "js_function": (r"(?i)\bfunction\s+([a-z_]\w{4,})\s*\(", "medium", 0),
    "exploit_api": (r"\butil\.printf\b|\bCollab\.collectEmailInfo\b|\bCollab\.getIcon\b|\bmedia\.newPlayer\b", "high", 0),
    "malware_keyword": (
        r"(?i)\b(?:emotet|trickbot|cobalt|mimikatz|meterpreter|covenant|empire|dridex|qbot|qakbot|icedid|bazarloader|ryuk|conti|lockbit|revil|sodinokibi|wannacry|petya|notpetya|zeus|kronos|ursnif|gozi|isfb|hancitor|poshc2|sliver)\b",
        "critical", 0,
    ),
}
PLAIN_ADDRESSES = ["0.0.0.0", "127.0.0.1", "255.255.255.255", "255.255.255.0", "255.0.0.0", "224.0.0.0"]
LOWERED = ("domain", "malware_keyword")


def spans(df: DataFrame, keys: list[str], text: str, kinds: dict[str, str]) -> DataFrame:
    """(keys..., kind, value, start, end) of all matches, places in characters from 0, end excluded.

    The parts between matches tell the places: a match begins after all parts and matches before it. Only matches and the
    lengths of parts are exchanged, never texts; a text with a million matches is summed up by one sorted pass.
    """

    def of(kind: str, pattern: str) -> Column:
        sizes = F.transform(F.split(text, pattern, -1), F.length)
        return F.struct(F.lit(kind).alias("kind"), F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("value"), sizes.alias("gap")).alias("parts"))

    found = df.select(*keys, F.explode(F.array(*[of(k, p) for k, p in kinds.items()])).alias("m")).where("size(m.parts) > 1")
    parts = found.select(*keys, "m.kind", F.posexplode("m.parts").alias("at", "p")).where("p.value IS NOT NULL").select(*keys, "kind", "at", "p.value", "p.gap")
    before = W.partitionBy(*keys, "kind").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(before)
    return parts.withColumn("end", end).select(*keys, "kind", "value", (F.col("end") - F.length("value")).alias("start"), "end")


def outside(found: DataFrame, keys: list[str], inner: str, outer: str) -> DataFrame:
    """``found`` without the spans of kind ``inner`` that lie in one of kind ``outer`` of the same text, by one sorted pass."""
    along = W.partitionBy(*keys).orderBy("start", F.when(F.col("kind") == outer, 0).otherwise(1)).rowsBetween(W.unboundedPreceding, W.currentRow)
    reach = F.max(F.when(F.col("kind") == outer, F.col("end"))).over(along)
    return found.withColumn("_reach", reach).where((F.col("kind") != inner) | F.col("_reach").isNull() | (F.col("end") > F.col("_reach"))).drop("_reach")


def string_indicators(df: DataFrame, file: str, text: str) -> DataFrame:
    """(file, kind, value, severity, line, start): the first place of each indicator of a file, by line and character.

    Lines under five characters are left out, domains inside a URL are no domains, plain addresses no indicators.
    """
    lines = df.select(file, F.posexplode(F.split(text, "\n")).alias("line", "_text")).where(F.length(F.btrim("_text", F.lit(" \t\r\x0b\f"))) >= 5)
    keys = [file, "line"]
    found = outside(spans(lines, keys, "_text", {k: p for k, (p, _, _) in STRING_KINDS.items()}), keys, "domain", "url")
    name = F.regexp_extract("value", STRING_KINDS["js_function"][0], 1)
    value = F.when(F.col("kind") == "js_function", name).when(F.col("kind").isin(*LOWERED), F.lower("value")).otherwise(F.col("value"))
    least, severity = F.lit(0), F.lit(None)
    for k, (_, s, n) in STRING_KINDS.items():
        least, severity = F.when(F.col("kind") == k, n).otherwise(least), F.when(F.col("kind") == k, s).otherwise(severity)
    found = found.withColumn("value", value).where((F.length("value") >= least) & ~((F.col("kind") == "ip_address") & F.col("value").isin(PLAIN_ADDRESSES)))
    first = found.groupBy(file, "kind", "value").agg(F.min(F.struct("line", "start")).alias("first"))
    return first.select(file, "kind", "value", severity.alias("severity"), (F.col("first.line") + 1).cast("long").alias("line"), F.col("first.start").cast("long").alias("start"))


def dumps(s, d) -> DataFrame:
    """Pages with lines as they stand in memory dumps."""
    n = F.col("page_id").cast("string")
    planted = F.concat_ws(
        "\n", F.lit("abc"), F.concat(F.lit("GET http://cc"), n, F.lit(".evil.top/in.php?x=far"), n, F.lit(".example.org and far"), n, F.lit(".example.org then 198.51.100."), (F.col("page_id") % 250).cast("string"), F.lit(" 127.0.0.1")),
        F.concat(F.lit("function decode"), n, F.lit(" (a) { util.printf(1) } Collab.getIcon")), F.concat(F.lit("C:\\tmp\\MIMIKATZ.exe emotet Emotet /~prod/b"), n, F.lit(".php")), F.concat(F.lit("again Emotet far"), n, F.lit(".example.org x.Example.ORG")),
    )
    return table(s, d, "pages").select("page_id", F.concat(planted, F.lit("\n"), F.col("html")).alias("text"))


# the planted lines' indicators, written out; the pages' own ones by their patterns with URLs blanked
_N = "CAST(page_id AS VARCHAR)"
_PLANTED = [
    ("ip_address", "'198.51.100.' || page_id % 250", "medium", 2, "73 + 3 * l"), ("url", "'http://cc' || n || '.evil.top/in.php?x=far' || n || '.example.org'", "high", 2, "4"), ("domain", "'far' || n || '.example.org'", "medium", 2, "52 + 2 * l"),
    ("php_path", "'//cc' || n || '.evil.top/in.php'", "high", 2, "9"), ("js_function", "'decode' || n", "medium", 3, "0"), ("exploit_api", "'util.printf'", "high", 3, "22 + l"), ("exploit_api", "'Collab.getIcon'", "high", 3, "39 + l"),
    ("malware_keyword", "'mimikatz'", "critical", 4, "7"), ("malware_keyword", "'emotet'", "critical", 4, "20"), ("php_path", "'/~prod/b' || n || '.php'", "high", 4, "34"), ("domain", "'b' || n || '.php'", "medium", 4, "41"), ("domain", "'x.example.org'", "medium", 5, "29 + l"),
]
_BLANKED = "list_reduce(list_prepend(t, list_transform(list_reverse_sort(list_transform(regexp_extract_all(t, '(?i)https?://[^\\s<>\"''})\\]]{1,500}'), lambda u: (length(u), u))), lambda p: p[2])), lambda a, u: replace(a, u, repeat(' ', length(u))))"
_OWN = (
    f"h AS (SELECT page_id, unnest(string_split(html, chr(10))) AS t, generate_subscripts(string_split(html, chr(10)), 1) + 5 AS line FROM pages), b AS (SELECT *, {_BLANKED} AS bare FROM h), "
    f"o AS (SELECT page_id, line, 'domain' AS kind, bare AS t, unnest(regexp_extract_all(bare, '{STRING_KINDS['domain'][0]}')) AS v FROM b UNION ALL SELECT page_id, line, 'ip_address', t, unnest(regexp_extract_all(t, '{STRING_KINDS['ip_address'][0]}')) FROM b "
    "UNION ALL SELECT page_id, line, 'url', t, unnest(regexp_extract_all(t, '(?i)https?://[^\\s<>\"''})\\]]{1,500}')) FROM b)"
)

QUERIES = {"scan_strings_iocs": lambda s, d: string_indicators(dumps(s, d), "page_id", "text")}
ORACLES = {
    "scan_strings_iocs": f"WITH n AS (SELECT page_id, {_N} AS n, length({_N}) AS l FROM pages), {_OWN} "
    + " UNION ALL ".join(f"SELECT page_id, '{k}' AS kind, {v} AS value, '{s}' AS severity, CAST({line} AS BIGINT) AS line, CAST({at} AS BIGINT) AS start FROM n" for k, v, s, line, at in _PLANTED)
    + " UNION ALL SELECT page_id, kind, CASE WHEN kind = 'domain' THEN lower(v) ELSE v END, CASE WHEN kind = 'url' THEN 'high' ELSE 'medium' END, min(line), arg_min(strpos(t, v) - 1, line) FROM o WHERE kind <> 'url' OR length(v) >= 10 GROUP BY 1, 2, 3, 4"
}
