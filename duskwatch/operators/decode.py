"""Decoders and indicator extraction, as columns over tables of texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..adapters import SEC, security_events, table
from ..functions import scalars as S


def b64(raw: Column) -> Column:
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(raw), r"\s", "")


def wide_text(raw: Column) -> Column:
    """UTF-16LE text; null for an odd number of bytes or surrogates."""
    return F.when((F.length(raw) % 2 == 0) & ~F.hex(raw).rlike("^(....)*..D[89A-F]"), F.decode(raw, "UTF-16LE"))


def has_nul(raw: Column) -> Column:
    return raw.cast("string").contains("\0")


def padded(text: Column) -> Column:
    bare = F.regexp_replace(text, "=+$", "")
    return F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), "=")


def b64_decode(text: Column) -> Column:
    """UTF-8 if valid, else UTF-16LE if it has NUL bytes; null if it is not base64 or not text."""
    read = lambda raw: F.when(has_nul(raw), wide_text(raw)).when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    return S.let(F.try_to_binary(S.let(text, padded), F.lit("base64")), read)


#: What is no letter, digit, mark or blank; ASCII is told first.
UNPRINTABLE = r"[^ -~\s\p{L}\p{N}\p{P}\p{S}]"


def printable(text: Column) -> Column:
    """Share of letters, digits, marks and blanks among the characters of a text."""
    return F.when(text.rlike(UNPRINTABLE), F.length(F.regexp_replace(text, UNPRINTABLE, "")) / F.length(text)).when(F.length(text) > 0, 1.0)


def b64_forms(text: Column) -> Column:
    """(form, decoded) of base64 as it stands, written backwards, or of UTF-16LE: the one with the most printable text, the first of equals.

    Each form is decoded once, and only if none before it is printable throughout.
    """
    def tried(form: str, place: int, t: Column, wide: bool) -> Column:
        read = lambda raw: wide_text(raw) if wide else F.when(F.is_valid_utf8(raw.cast("string")) & ~has_nul(raw), raw.cast("string"))
        told = lambda out: F.when(F.length(out) > 0, F.struct(printable(out).alias("share"), F.lit(-place).alias("place"), F.lit(form).alias("form"), out.alias("decoded")))
        return S.let(S.let(F.try_to_binary(S.let(t, padded), F.lit("base64")), read), told)

    def better(first: Column, rest: Column) -> Column:
        return S.let(first, lambda x: F.when(x["share"] == 1, x).otherwise(F.array_max(F.array_compact(F.array(x, rest)))))

    return S.let(text, lambda t: better(tried("direct", 0, t, False), better(tried("reversed", 1, F.reverse(F.regexp_replace(t, "^=+", "")), False), tried("wide", 2, t, True))))


def b64_candidates(df: DataFrame, key: str, column: str, least: int = 8) -> DataFrame:
    """Base64-shaped runs of a column that are not digests, ids or too short, with what they decode to."""
    runs = F.regexp_extract_all(F.col(column), F.lit("[A-Za-z0-9+/]{%d,}={0,2}" % least), F.lit(0))
    c = df.select(key, F.explode(F.array_distinct(runs)).alias("candidate"))
    c = c.where(~F.col("candidate").rlike("^([a-fA-F0-9]{32}|[a-fA-F0-9]{40}|[a-fA-F0-9]{64})$") & (F.length("candidate") % 4 == 0))
    return c.withColumn("decoded", b64_decode(F.col("candidate"))).where("decoded IS NOT NULL")


def url_decode(text: Column) -> Column:
    """One pass; a bare + stays as it is, a text with a bad escape is left as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def url_decode_n(text: Column, passes: int = 3) -> Column:
    for _ in range(passes):
        text = F.when(text.rlike("%[0-9A-Fa-f]{2}"), url_decode(text)).otherwise(text)
    return text


def ps_encoded(text: Column) -> Column:
    run = F.regexp_extract(text, r"(?i)(?:powershell|pwsh)(?:\.exe)?.*?\s-(?:encodedcommand|enc|ec|e)\s+([A-Za-z0-9+/=]+)", 1)
    raw = F.try_to_binary(padded(run), F.lit("base64"))
    return F.when(run != "", wide_text(raw))


def ps_command(text: Column) -> Column:
    run = F.regexp_extract(text, r"(?i)(?:powershell|pwsh)(?:\.exe)?.*?\s-c(?:ommand)?\s+(.+)$", 1)
    return F.when(run != "", run)


def hex_decode(text: Column) -> Column:
    """Bytes written as 4D_5A, \\x4d or 0x4d; null if there are none."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\\x|0x", ""), "[_ ,-]", "")
    return F.when(bare.rlike("^([0-9a-fA-F]{2})+$"), F.try_to_binary(bare, F.lit("hex")))


def strip_fillers(text: Column) -> Column:
    bare = F.translate(text, "`^#", "")
    return F.when((bare != text) & (F.length(bare) > 3), bare)


def concat_eval(text: Column) -> Column:
    """Quoted parts around + signs, joined."""
    whole = F.regexp_extract(text, r"(\"[^\"]*\"(?:\s*\+\s*\"[^\"]*\")+)", 1)
    return F.when(whole != "", F.array_join(F.regexp_extract_all(whole, F.lit('"([^"]*)"'), F.lit(1)), ""))


def charcode_decode(text: Column) -> Column:
    codes = F.regexp_extract_all(text, F.lit(r"(?i)(?:chr\(|\[char\])\s*([0-9]{1,3})"), F.lit(1))
    return F.when(F.size(codes) > 0, F.array_join(F.transform(codes, lambda c: F.char(c.cast("int"))), ""))


def obf_types(text: Column) -> Column:
    tests = {"base64": "[A-Za-z0-9+/]{40,}={0,2}", "charcode": r"(?i)chr\(|\[char\]|fromcharcode", "concat": r"\"\s*\+\s*\"", "escape": r"\\x[0-9a-fA-F]{2}", "filler": "[`^]", "reversed": r"(?i)strreverse|\[::-1\]", "url": "%[0-9A-Fa-f]{2}", "xor": r"(?i)-bxor|\^="}
    return F.array_join(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in tests.items()])), ",")


def script_type(name: Column, text: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    kinds = {"ps1": "powershell", "bat": "batch", "cmd": "batch", "vbs": "vbscript", "js": "javascript", "py": "python", "sh": "shell"}
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), ext)
    return F.coalesce(known, F.when(text.rlike(r"(?i)\$[a-z]+\s*=|invoke-"), "powershell").when(text.rlike(r"(?i)@echo|%[a-z]+%"), "batch").when(text.rlike(r"(?i)\bfunction\b|\bvar\b"), "javascript"), F.lit("unknown"))


def decoded_phase(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike("whoami|ipconfig|systeminfo|hostname"), "recon").when(low.rlike("mimikatz|lsass|procdump|password"), "credential").when(low.rlike("wmic|psexec|invoke-"), "lateral").when(low.rlike("net user|net group|dir |tasklist"), "discovery").when(low.rlike("cmd|powershell|download"), "execution").otherwise("other")


def text_iocs(df: DataFrame, key: str, column: str) -> DataFrame:
    """Distinct (key, kind, value): addresses outside private ranges, IPv6 addresses, URLs, digests, e-mail addresses, and
    domains but for well-known ones, names of files and what is as short as one."""

    def named(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    kinds = [named(k, F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(p), F.lit(0)))) for k, p in rules.IOC_PATTERNS.items()]
    out = df.select(key, F.explode(F.flatten(F.array(*kinds))).alias("x")).select(key, "x.*")
    low = F.lower("value")
    name, tld = F.substring_index(low, ".", 1), F.substring_index(low, ".", -1)
    short = (F.length(low) - F.length(F.replace(low, F.lit("."), F.lit(""))) == 1) & (F.length(low) < 20) & (F.length(name) < 12) & (F.length(tld) <= 4)
    no_domain = F.exists(F.array(*map(F.lit, rules.NO_DOMAINS)), lambda x: low.contains(x)) | tld.isin(rules.FILE_ENDINGS) | short
    return out.where(F.when(F.col("kind") == "ipv4", S.ip_class(F.col("value")) == "EXTERNAL").when(F.col("kind") == "domain", ~no_domain).otherwise(True))


def path_registry_iocs(ev: DataFrame) -> DataFrame:
    paths = ev.select(F.lit("path").alias("kind"), F.col("file_path").alias("value"), F.lower("file_path").rlike(r"\\(temp|public|appdata|downloads)\\").alias("suspicious"))
    keys = ev.select(F.lit("registry").alias("kind"), F.col("registry_key").alias("value"), F.lower("registry_key").rlike(r"currentversion\\run|\\services\\").alias("suspicious"))
    return paths.union(keys).where(F.col("value").rlike(r"^([A-Za-z]:\\|HK)")).distinct()


#: Line b of the table tells which bytes are printable after an exclusive or with b.
_PRINTABLE = np.isin(np.arange(256)[:, None] ^ np.arange(256)[None, :], [9, 10, 13, *range(32, 127)]).astype(np.int64)


def xor_bruteforce(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, byte, share, text) of the single-byte key with the most printable text over 0.7; the first of equals.

    The bytes of a row are counted once; a table of 256 x 256 then gives the share of every key.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, data in zip(batch[key], batch[column], strict=True):
                raw = np.frombuffer(data or b"", np.uint8)
                hits = _PRINTABLE @ np.bincount(raw, minlength=256)
                best = int(np.argmax(hits))
                if len(raw) and hits[best] > 0.7 * len(raw):
                    out.append((k, best, hits[best] / len(raw), (raw ^ np.uint8(best)).tobytes().decode("latin-1")))
            yield pd.DataFrame(out, columns=[key, "byte", "share", "text"])

    return df.select(key, column).mapInPandas(run, f"{key} long, byte int, share double, text string")


def expand_batch_variables(text: str, depth: int = 20) -> str:
    """``%VAR:~N,L%`` references of a batch script replaced by the parts of what ``set`` lines assign."""
    names: dict[str, str] = dict(re.findall(r"(?im)^\s*(?:@)?set\s+\"?(\w+)=([^\"\r\n]*)", text))
    names = {k.lower(): v for k, v in names.items()}

    def part(m: re.Match) -> str:
        value = names.get(m[1].lower())
        if value is None:
            return m[0]
        if m[2] is None:
            return value
        start = int(m[2])
        start = max(len(value) + start, 0) if start < 0 else start
        return value[start:] if m[3] is None else value[start : start + int(m[3])] if int(m[3]) >= 0 else value[start : int(m[3])]

    for _ in range(depth):
        done = re.sub(r"%(\w+)(?::~(-?\d+)(?:,(-?\d+))?)?%", part, text)
        if done == text:
            break
        text = done
    return text


def batch_var_expand(df: DataFrame, key: str, column: str) -> DataFrame:
    @F.pandas_udf("string")
    def expand(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: expand_batch_variables(t) if isinstance(t, str) else None)

    return df.select(key, expand(column).alias("expanded"))


def _ev(f):
    return lambda s, d: f(security_events(s, d))


def _turned(text: Column) -> Column:
    """Base64 of a text: for every third document as it is, backwards, and of UTF-16LE."""
    return F.when(F.col("doc_id") % 3 == 0, b64(F.encode(text, "UTF-8"))).when(F.col("doc_id") % 3 == 1, F.reverse(b64(F.encode(text, "UTF-8")))).otherwise(b64(F.encode(text, "UTF-16LE")))


def _lines(s, d):
    """Every line of every document."""
    return table(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


_L = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"
#: Letters outside ASCII are part of words, which DuckDB's \\b doesn't know.
_ASCII = "regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g')"
_IOC = " UNION ALL ".join(f"SELECT DISTINCT doc_id, '{k}' AS kind, unnest(regexp_extract_all({_ASCII if k == 'domain' else 'text'}, '{p.replace(chr(39), chr(39) * 2)}')) AS value FROM documents" for k, p in rules.IOC_PATTERNS.items())
_PRIVATE = "regexp_matches(value, '^(10\\.|127\\.|169\\.254\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|0\\.0\\.0\\.0$)')"
_PHASE = "CASE WHEN regexp_matches(lower(command_line), 'whoami|ipconfig|systeminfo|hostname') THEN 'recon' WHEN regexp_matches(lower(command_line), 'mimikatz|lsass|procdump|password') THEN 'credential' WHEN regexp_matches(lower(command_line), 'wmic|psexec|invoke-') THEN 'lateral' WHEN regexp_matches(lower(command_line), 'net user|net group|dir |tasklist') THEN 'discovery' WHEN regexp_matches(lower(command_line), 'cmd|powershell|download') THEN 'execution' ELSE 'other' END"

QUERIES = {
    "b64_decode": lambda s, d: _lines(s, d).select("doc_id", b64_decode(b64(F.encode("line", "UTF-8"))).alias("decoded"), b64_decode(b64(F.encode("line", "UTF-16LE"))).alias("wide")),
    "b64_find": lambda s, d: b64_candidates(_lines(s, d).withColumn("q", F.concat(F.lit("c="), b64(F.encode("line", "UTF-8")))), "doc_id", "q").select("doc_id", "candidate", F.col("decoded")),
    "b64_params": _ev(lambda ev: ev.select("row_id", F.regexp_extract(F.concat(F.lit("cmd="), b64(F.encode("command_line", "UTF-8"))), "(?i)(?:cmd|command|c|-enc|-encodedcommand)[= ]([A-Za-z0-9+/]+=*)", 1).alias("p")).select("row_id", b64_decode(F.col("p")).alias("decoded"))),
    "url_decode_n": lambda s, d: _lines(s, d).select("doc_id", url_decode_n(F.url_encode(F.replace(F.url_encode("line"), F.lit("+"), F.lit("%20")))).alias("decoded")),
    "ps_encoded": _ev(lambda ev: ev.select("row_id", ps_encoded(F.concat(F.lit("powershell.exe -nop -enc "), b64(F.encode("command_line", "UTF-16LE")))).alias("decoded"))),
    "ps_command": _ev(lambda ev: ev.select("row_id", ps_command(F.col("command_line")).alias("command"))),
    "hex_decode": lambda s, d: _lines(s, d).select("doc_id", hex_decode(F.regexp_replace(F.hex(F.encode("line", "UTF-8")), "(..)", "$1_")).cast("string").alias("decoded")),
    "strip_fillers": _ev(lambda ev: ev.select("row_id", strip_fillers(F.concat(F.lit("po`w^er"), F.col("command_line"))).alias("clean"))),
    "concat_eval": _ev(lambda ev: ev.select("row_id", concat_eval(F.concat(F.lit('x = "'), F.col("process_name"), F.lit('" + "'), F.col("username"), F.lit('"'))).alias("joined"))),
    "charcode_decode": _ev(lambda ev: ev.select("row_id", charcode_decode(F.concat(F.lit("chr("), (F.col("k") % 26 + 65).cast("string"), F.lit(") + [char]"), (F.col("k") % 10 + 48).cast("string"))).alias("text"))),
    "b64_reversed": lambda s, d: _lines(s, d).select("doc_id", b64_forms(_turned(F.concat(F.lit("powershell -command "), "line"))).alias("b")).select("doc_id", "b.form", "b.decoded"),
    "obf_types": _ev(lambda ev: ev.select("row_id", obf_types(F.col("command_line")).alias("types"))),
    "script_type": _ev(lambda ev: ev.select("row_id", script_type(F.concat(F.lit("x."), F.element_at(F.array(*map(F.lit, ["ps1", "bat", "txt", "js"])), (F.col("row_id") % 4 + 1).cast("int"))), F.col("command_line")).alias("type"))),
    "decoded_phase": _ev(lambda ev: ev.select("row_id", decoded_phase(F.col("command_line")).alias("phase"))),
    "text_iocs": lambda s, d: text_iocs(table(s, d, "documents"), "doc_id", "text"),
    "path_registry_iocs": _ev(path_registry_iocs),
    "xor_bruteforce": lambda s, d: xor_bruteforce(_lines(s, d).select("doc_id", F.encode("line", "UTF-8").alias("data")), "doc_id", "data"),
    "batch_var_expand": _ev(lambda ev: batch_var_expand(ev.select("row_id", F.concat(F.lit("set a="), F.col("process_name"), F.lit("\necho %a:~0,3%%a%")).alias("t")), "row_id", "t")),
}
ORACLES = {
    "b64_decode": f"WITH {_L} SELECT doc_id, line AS decoded, line AS wide FROM l",
    "ps_encoded": f"WITH {SEC} SELECT row_id, command_line AS decoded FROM sec",
    "b64_params": f"WITH {SEC} SELECT row_id, command_line AS decoded FROM sec",
    "url_decode_n": f"WITH {_L} SELECT doc_id, line AS decoded FROM l",
    "ps_command": f"WITH {SEC} SELECT row_id, nullif(regexp_extract(command_line, '(?i)(?:powershell|pwsh)(?:\\.exe)?.*?\\s-c(?:ommand)?\\s+(.+)$', 1), '') AS command FROM sec",
    "hex_decode": f"WITH {_L} SELECT doc_id, nullif(line, '') AS decoded FROM l",
    "strip_fillers": f"WITH {SEC} SELECT row_id, 'power' || replace(replace(replace(command_line, '`', ''), '^', ''), '#', '') AS clean FROM sec",
    "concat_eval": f"WITH {SEC} SELECT row_id, process_name || username AS joined FROM sec",
    "charcode_decode": f"WITH {SEC} SELECT row_id, chr(CAST(k % 26 + 65 AS INT)) || chr(CAST(k % 10 + 48 AS INT)) AS text FROM sec",
    "b64_reversed": f"WITH {_L} SELECT doc_id, ['direct', 'reversed', 'wide'][CAST(doc_id % 3 + 1 AS INT)] AS form, 'powershell -command ' || line AS decoded FROM l",
    "b64_find": f"WITH {_L} SELECT doc_id, to_base64(encode(line)) AS candidate, line AS decoded FROM l WHERE length(rtrim(to_base64(encode(line)), '=')) >= 8",
    "obf_types": f"WITH {SEC} SELECT row_id, CASE WHEN regexp_matches(command_line, '[`^]') THEN 'filler' ELSE '' END AS types FROM sec",
    "script_type": f"WITH {SEC} SELECT row_id, CASE row_id % 4 WHEN 0 THEN 'powershell' WHEN 1 THEN 'batch' WHEN 3 THEN 'javascript' ELSE CASE WHEN regexp_matches(command_line, '(?i)\\$[a-z]+\\s*=|invoke-') THEN 'powershell' WHEN regexp_matches(command_line, '(?i)@echo|%[a-z]+%') THEN 'batch' WHEN regexp_matches(command_line, '(?i)\\bfunction\\b|\\bvar\\b') THEN 'javascript' ELSE 'unknown' END END AS type FROM sec",
    "decoded_phase": f"WITH {SEC} SELECT row_id, {_PHASE} AS phase FROM sec",
    "text_iocs": f"SELECT * FROM ({_IOC}) WHERE CASE kind WHEN 'ipv4' THEN NOT {_PRIVATE} WHEN 'domain' THEN NOT regexp_matches(value, '(?i){'|'.join(re.escape(x) for x in rules.NO_DOMAINS)}|[.]({'|'.join(rules.FILE_ENDINGS)})$') AND NOT (length(value) < 20 AND regexp_matches(value, '^[^.]{{1,11}}[.][^.]{{1,4}}$')) ELSE true END",
    "path_registry_iocs": f"WITH {SEC} SELECT DISTINCT * FROM (SELECT 'path' AS kind, file_path AS value, regexp_matches(lower(file_path), '\\\\(temp|public|appdata|downloads)\\\\') AS suspicious FROM sec UNION ALL SELECT 'registry', registry_key, regexp_matches(lower(registry_key), 'currentversion\\\\run|\\\\services\\\\') FROM sec)",
    "batch_var_expand": f"WITH {SEC} SELECT row_id, 'set a=' || process_name || chr(10) || 'echo ' || left(process_name, 3) || process_name AS expanded FROM sec",
}
