"""Findings from exported rows of other tools, severities of single fields, process chains and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..adapters import SEC, security_events
from ..sources.exports import first_match
from ..store import stored
from . import relate
from .decode import b64, b64_candidates, b64_decode, charcode_decode, concat_eval, hex_decode, ps_encoded, strip_fillers, url_decode_n
from .search import found_in

# Registry places, programs and words that severities and findings go by.
PERSISTENCE = [
    r"\Microsoft\Windows\CurrentVersion\Run", r"\Microsoft\Windows\CurrentVersion\RunOnce", r"\Microsoft\Windows\CurrentVersion\RunServices", r"\Microsoft\Windows\CurrentVersion\RunServicesOnce",
    r"\Microsoft\Windows NT\CurrentVersion\Winlogon", r"\Microsoft\Windows\CurrentVersion\Explorer\Shell Folders", r"\Microsoft\Windows\CurrentVersion\Explorer\User Shell Folders",
    r"\Microsoft\Windows\CurrentVersion\Policies\Explorer\Run", r"\ControlSet001\Services", r"\ControlSet002\Services", r"\ControlSet001\Control\Session Manager",
]
ODD_VALUES = ["cmd.exe", "powershell", "mshta", "wscript", "cscript", "regsvr32", "rundll32", "msiexec"]
ATTACK_TOOLS = [
    "mimikatz", "procdump", "psexec", "wce", "pwdump", "lazagne", "rubeus", "sharphound", "bloodhound", "cobalt", "beacon", "meterpreter", "nc", "ncat", "certutil", "bitsadmin", "mshta", "regsvr32",
    "rundll32", "wmic", "cmstp", "msiexec", "installutil", "regasm", "regsvcs", "msconfig", "dnscmd",
]
RECON_TOOLS = ["whoami", "ipconfig", "netstat", "systeminfo", "tasklist", "net", "nltest"]
PACKERS = {"UPX": ["UPX0", "UPX1", "UPX2", ".UPX"], "MPRESS": [".MPRESS1", ".MPRESS2"], "ASPack": [".aspack", ".adata", ".ASPack"], "PECompact": ["PEC2", "PECompact2"], "Themida": [".themida"], "VMProtect": [".vmp0", ".vmp1", ".vmp2"], "Enigma": [".enigma1", ".enigma2"], "PETITE": [".petite"], "NSPack": [".nsp0", ".nsp1", ".nsp2"]}
VENDORS = ["microsoft", "adobe", "google", "oracle", "intel", "nvidia", "amd"]
EXPLOITS = [("util.printf", "CVE-2008-2992"), ("Collab.collectEmailInfo", "CVE-2007-5659"), ("Collab.getIcon", "CVE-2009-0927"), ("media.newPlayer", "CVE-2009-4324")]
STRING_KINDS = ["ip_address", "url", "domain", "php_path", "js_function", "exploit_api", "malware_keyword"]
PHASES = [
    ("reconnaissance", ["whoami", "ipconfig", "net user", "net localgroup", "nltest"]), ("credential_access", ["pd.exe", "procdump", "mimikatz", "lsass", "sekurlsa"]),
    ("lateral_movement", ["invoke-wmiexec", "invoke-smbexec", "-hash", "-target"]), ("discovery", ["tasklist", "netstat", "wmic process", "systeminfo", "dir"]), ("execution", ["cmd", "powershell", "execute"]),
]
CLAIM_PATTERNS = {
    "process": (r"(?i)\b([a-zA-Z0-9_\-]+\.exe)\b", True), "dll": (r"(?i)\b([a-zA-Z0-9_\-]+\.dll)\b", True), "path": (r"([A-Za-z]:\\[^\s\"'<>|*?]+|\\\\[^\s\"'<>|*?]+)", False),
    "ip": (r"\b((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))\b", False), "domain": (r"(?i)\b([a-zA-Z0-9][-a-zA-Z0-9]*\.(?:com|net|org|io|xyz|ru|cn|tk|top|info|biz|cc))\b", True),
}
BINARY_COMMANDS = [(r"bitsadmin.*(/transfer|/download)", "bitsadmin"), (r"certutil.*(-decode|-urlcache)", "certutil"), (r"powershell.*(-enc|-e\s|downloadstring|invoke-webrequest)", "powershell"), (r"schtasks.*/create", "schtasks")]


def has_any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))


def registry_severity(key: Column) -> Column:
    return F.when(has_any(F.upper(key), [p.upper() for p in PERSISTENCE]), "medium").when(F.upper(key).contains("\\SERVICES\\"), "low").otherwise("info")


def prefetch_name(file: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(file), r"\.PF$", ""), "-[^-]*$", "")


def program_severity(name: Column) -> Column:
    low = F.lower(name)
    return F.when(has_any(low, ATTACK_TOOLS), "high").when(F.exists(F.array(*map(F.lit, RECON_TOOLS)), lambda w: low.startswith(w)), "medium").otherwise("info")


def text_severity(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The severity of the first rule that a message, path or address fits."""
    return first_match(text, rules)


def pe_risk(sections: DataFrame) -> DataFrame:
    """Risk of each file from (file, section, entropy, vendor, signed): the first packer whose section names occur, else
    entropy over 7; a known vendor without a signature is masquerading."""
    name = F.lower("section")
    rank = F
    for i, marks in enumerate(PACKERS.values()):
        rank = rank.when(has_any(name, [m.lower() for m in marks]), i)
    known = has_any(F.lower("vendor"), VENDORS)
    g = sections.withColumn("rank", rank).groupBy("file").agg(F.min("rank").alias("rank"), F.max("entropy").alias("entropy"), F.bool_or(known & ~F.col("signed")).alias("masquerading"))
    packer = F.when(F.col("rank").isNotNull(), F.get(F.array(*map(F.lit, PACKERS)), F.col("rank"))).when(F.col("entropy") > 7, "Unknown (high entropy)")
    return g.select("file", packer.alias("packer"), "entropy", "masquerading", F.when(F.col("masquerading"), "high").when(packer.isNotNull(), "medium").otherwise("info").alias("severity"))


def memory_injections(rows: DataFrame) -> DataFrame:
    """From (row_id, event_type, raw_payload): injected code, modules missing from a loader list, alternate streams."""
    kind = F.lower("event_type")
    absent = [F.get_json_object("raw_payload", f"$.{k}") == "false" for k in ("in_load", "in_init", "in_mem")]
    gap = F.coalesce(absent[0], F.lit(False)) | F.coalesce(absent[1], F.lit(False)) | F.coalesce(absent[2], F.lit(False))
    found = F.when(kind.contains("memory_malfind"), "malfind").when(kind.contains("memory_ldrmodules") & gap, "ldr_injection").when(kind.contains("memory_mftscan"), "ads")
    return rows.select("row_id", found.alias("finding"), F.get_json_object("raw_payload", "$.protection").alias("protection")).where("finding IS NOT NULL")


def strings_iocs(rows: DataFrame) -> DataFrame:
    """Counts and distinct values of each of the seven kinds of strings."""
    s = rows.where(F.lower("event_type").contains("memory_strings_ioc")).select(F.get_json_object("raw_payload", "$.ioc_type").alias("kind"), F.get_json_object("raw_payload", "$.value").alias("value"))
    return s.where(F.col("kind").isin(STRING_KINDS)).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("value").alias("distinct_values"))


def exploit_cve(rows: DataFrame) -> DataFrame:
    """The first string of each exploit's call, if a PDF reader is seen anywhere in the case."""
    s = rows.where(F.lower("event_type").contains("memory_strings_ioc")).select("row_id", F.get_json_object("raw_payload", "$.value").alias("value"), F.coalesce(F.get_json_object("raw_payload", "$.context"), F.lit("")).alias("context"))
    reader = rows.where(F.lower("process_name").rlike("acro|reader|pdf")).select(F.lit(1).alias("one")).limit(1).union(s.where(F.lower("context").rlike("pdf|acro")).select(F.lit(1)).limit(1)).distinct()
    marks = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(c).alias("cve")) for p, c in EXPLOITS])
    hits = s.withColumn("x", F.explode(F.filter(marks, lambda m: F.col("value").contains(m["pattern"]) | F.col("context").contains(m["pattern"])))).withColumn("one", F.lit(1))
    return hits.join(F.broadcast(reader), "one", "left_semi").groupBy("x.cve", "x.pattern").agg(F.min(F.struct("row_id", "value")).alias("m")).select("cve", "pattern", "m.row_id", F.col("m.value").alias("matched_in"))


def system_profile(rows: DataFrame) -> DataFrame:
    """One row for each host: its variables turned to a profile name, architecture and build."""
    own = rows.where(F.lower("event_type").contains("memory_system_info")).select("source_system", "row_id", F.get_json_object("raw_payload", "$.variable").alias("name"), F.get_json_object("raw_payload", "$.value").alias("value"))
    last = lambda n: F.max_by(F.when(F.col("name") == n, F.col("value")), F.when(F.col("name") == n, F.col("row_id")))
    g = own.groupBy("source_system").agg(*[F.coalesce(last(n), F.lit("")).alias(a) for n, a in (("NTBuildLab", "lab"), ("NtMajorVersion", "major"), ("NtMinorVersion", "minor"), ("Is64Bit", "is64"))])
    low, version = F.lower("lab"), F.concat_ws(".", "major", "minor")
    arch = F.when(F.lower("is64") == "true", "x64").otherwise("x86")
    base = F.when(low == "", "").when(low.contains("win7sp1") | (low.contains("7601") & low.contains("sp1")), "Win7SP1").when(low.rlike("win7|7600"), "Win7SP0").when(low.rlike("win8|9200"), "Win8").when(low.contains("9600"), "Win8.1")
    base = base.when(version == "6.1", F.when(low.rlike("sp1|7601"), "Win7SP1").otherwise("Win7SP0")).when(version == "6.2", "Win8").when(version == "6.3", "Win8.1").when(F.col("major") == "10", "Win10").when(version == "5.1", "WinXPSP3").otherwise("")
    build = F.get(F.split("lab", r"\."), F.lit(1))
    return g.select("source_system", F.when(base == "", "").otherwise(F.concat(base, arch)).alias("profile"), arch.alias("architecture"), F.when(build.rlike(r"^\d+$"), build).otherwise("").alias("build_number"))


def hidden_processes(rows: DataFrame) -> DataFrame:
    kind = F.lower("event_type")
    hidden = kind.contains("memory_malfind") & (F.get_json_object("raw_payload", "$.hidden_process") == "true")
    return rows.select("row_id", F.when(kind.contains("memory_dkom_hidden"), "hidden").when(hidden, "malfind_hidden").alias("finding"), F.get_json_object("raw_payload", "$.pid").try_cast("bigint").alias("pid")).where("finding IS NOT NULL")


def exported(rows: DataFrame, kind: str, *fields: str) -> DataFrame:
    """Rows of one tool with the named fields of their payload."""
    return rows.where(F.lower("event_type").contains(kind)).select("row_id", *[F.get_json_object("raw_payload", f"$.{f}").alias(f) for f in fields])


def binary_iocs(strings: DataFrame) -> DataFrame:
    """Distinct addresses, URLs and commands in strings of raw images (file, value), with a severity for each."""
    runs = lambda p: F.regexp_extract_all("value", F.lit(p), F.lit(0))
    kinds = [("ip", runs(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b")), ("url", runs(r"https?://[^\s\"'<>]{10,}")), *((f"command:{tool}", runs("(?i)" + p)) for p, tool in BINARY_COMMANDS)]

    def tagged(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("found")))

    out = strings.select("file", F.explode(F.flatten(F.array(*[tagged(k, v) for k, v in kinds]))).alias("x")).select("file", "x.*").distinct()
    octets = F.transform(F.split("found", r"\."), lambda o: o.try_cast("int"))
    inside = F.col("found").rlike(r"^(10|127)\.|^192\.168\.|^172\.(1[6-9]|2\d|3[01])\.")
    valid = F.forall(octets, lambda o: o <= 255) & ~F.get(octets, F.lit(0)).isin(0, 255)
    return out.where((F.col("kind") != "ip") | valid).withColumn("severity", F.when(F.col("kind").startswith("command"), "critical").when((F.col("kind") == "ip") & inside, "medium").otherwise("high"))


def claim_iocs(claims: DataFrame) -> DataFrame:
    """Distinct (claim_id, kind, value) in claim texts: programs, libraries, paths, addresses, domains."""

    def tagged(kind: str, pattern: str, low: bool) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), (F.lower(v) if low else v).alias("value")))

    return claims.select("claim_id", F.explode(F.flatten(F.array(*[tagged(k, p, low) for k, (p, low) in CLAIM_PATTERNS.items()]))).alias("x")).select("claim_id", "x.*").distinct()


def phase(text: Column) -> Column:
    out = F
    for name, words in PHASES:
        out = out.when(has_any(F.lower(text), words), name)
    return out.otherwise("other")


def decoded_content(ev: DataFrame) -> DataFrame:
    """(row_id, source, decoded, phase): base64 in commands and queries, base64 behind URL escapes, encoded PowerShell."""
    plain = b64_candidates(ev.select("row_id", F.concat_ws(" ", "command_line", "query_string").alias("t")), "row_id", "t", 16).select("row_id", F.lit("base64").alias("source"), "decoded")
    unquoted = ev.where(F.col("query_string").contains("%")).select("row_id", url_decode_n(F.col("query_string"), 1).alias("t"), "query_string").where("t <> query_string")
    escaped = b64_candidates(unquoted, "row_id", "t", 16).select("row_id", F.lit("url_then_base64").alias("source"), "decoded")
    shell = ev.select("row_id", F.lit("powershell").alias("source"), ps_encoded(F.col("command_line")).alias("decoded")).where("decoded IS NOT NULL")
    return plain.unionByName(escaped).unionByName(shell).withColumn("phase", phase(F.col("decoded")))


def deobfuscated(ev: DataFrame, fields: list[str]) -> DataFrame:
    """(row_id, field, method, decoded) of text fields in hexadecimal, with filler characters, or in joined parts."""
    tries = lambda c: F.array(F.struct(F.lit("hex").alias("method"), F.when(F.length(c) >= 8, hex_decode(F.col(c)).cast("string")).alias("decoded")), F.struct(F.lit("filler").alias("method"), strip_fillers(F.col(c)).alias("decoded")), F.struct(F.lit("concat").alias("method"), concat_eval(F.col(c)).alias("decoded")))
    named = F.array(*[F.struct(F.lit(c).alias("field"), tries(c).alias("t")) for c in fields])
    return ev.select("row_id", F.explode(named).alias("n")).select("row_id", "n.field", F.explode("n.t").alias("t")).select("row_id", "field", "t.*").where("decoded IS NOT NULL")


def best_decoding(text: Column, rounds: int = 3) -> Column:
    """The result of the most certain decoder that works, decoded again up to ``rounds`` times; null if none does."""

    def once(t: Column) -> Column:
        codes = charcode_decode(t)
        base = F.when(t.rlike("^[A-Za-z0-9+/]{8,}={0,2}$") & (F.length(t) % 4 == 0), b64_decode(t))
        turned = F.when(t.rlike("^={1,2}[A-Za-z0-9+/]{7,}$"), b64_decode(F.reverse(t)))
        return F.coalesce(ps_encoded(t), base, turned, F.when(t.rlike(r"^(\\x[0-9a-fA-F]{2}|[0-9a-fA-F]{2}[_ ]){4,}"), hex_decode(t).cast("string")), F.when(codes != "", codes), concat_eval(t), F.when(t.rlike("%[0-9A-Fa-f]{2}"), F.nullif(url_decode_n(t, 1), t)))

    return F.nullif(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), text, lambda t, _: F.coalesce(once(t), t)), text)


def suspicious_chains(ev: DataFrame) -> DataFrame:
    """Scores and signs of evasion of suspicious parent-child pairs."""
    pairs = relate.classify(ev.where("event_code IN (1, 4688)").select("row_id", "command_line", F.col("parent_process_name").alias("parent"), F.col("process_name").alias("child"))).where("class LIKE '%SUSPICIOUS'")
    cmd, child = F.lower(F.coalesce("command_line", F.lit(""))), F.lower(F.coalesce("child", F.lit("")))
    points = lambda test, n: F.when(test, n).otherwise(0)
    score = points(F.col("class") == "HIGHLY_SUSPICIOUS", 10) + points(has_any(cmd, ["invoke-", "downloadstring", "iex", "-enc"]), 5) + points(has_any(cmd, ["http:", "https:", "ftp:", "//"]), 3) + points(has_any(cmd, ["mimikatz", "procdump", "psexec", "wmiexec", "smbexec"]), 10)
    away = ~cmd.contains("system32") & ~cmd.contains("syswow64")
    signs = F.array_compact(F.array(*[F.when(child.contains(n) & away, n) for n in ("svchost.exe", "csrss.exe", "lsass.exe", "services.exe")], F.when((F.length(child) <= 4) & ~child.isin("cmd", "sc", "at"), "short name")))
    return pairs.select("row_id", "parent", "child", "class", score.cast("long").alias("score"), F.array_join(signs, ",").alias("evasion"))


def descendants(ev: DataFrame, most: int = 10, levels: int = 64) -> DataFrame:
    """The first ``most`` descendants of each process, in the order of a walk that takes children by id.

    A path of ids, padded to equal width, sorts as the walk does; each round goes one level down until none is left. A row
    below level ``most`` has that many before it and can't be among the first.
    """
    e = stored(relate.edges(ev))
    step = e.select(F.col("parent_id").alias("id"), F.col("child_id").alias("at"), F.lpad(F.col("child_id").cast("string"), 19, "0").alias("path"), F.lit(1).alias("level"))
    out = step
    for level in range(2, min(levels, most) + 1):
        step = step.join(e.select(F.col("parent_id").alias("at"), "child_id"), "at").select("id", F.col("child_id").alias("at"), F.concat("path", F.lit("/"), F.lpad(F.col("child_id").cast("string"), 19, "0")).alias("path"), F.lit(level).alias("level"))
        # only what can still be among the first of its process goes on
        step = stored(step.withColumn("nr", F.row_number().over(W.partitionBy("id").orderBy("path"))).where(F.col("nr") <= most).drop("nr"))
        if step.isEmpty():
            break
        out = out.unionByName(step)
    w = W.partitionBy("id").orderBy("path")
    return out.withColumn("nr", F.row_number().over(w)).where(F.col("nr") <= most).select("id", F.col("at").alias("descendant"), F.col("level").cast("long").alias("level"), F.col("nr").cast("long").alias("nr"))


def lineage_file(findings: DataFrame, files: DataFrame) -> DataFrame:
    """For each finding (id, value), the first file event (other_id, file_path) whose file name contains the value.

    Few distinct values and file names are compared, then joined back to their rows by equality.
    """
    names = files.groupBy("file_path").agg(F.min("other_id").alias("other_id"))
    met = found_in(findings.select("value"), names.select(F.col("file_path").alias("text"))).join(names, F.col("text") == F.col("file_path"))
    first = met.groupBy("value").agg(F.min(F.struct("other_id", "file_path")).alias("m"))
    return findings.join(first, "value").select("id", "m.other_id", "m.file_path")


def lineage_auth(findings: DataFrame, links: DataFrame, within: float = 10) -> DataFrame:
    """For findings (id, text, host, ts) on logons, the first linked event (other_id, host, other_ts) within some seconds."""
    spoken = findings.where(F.lower("text").rlike("logon|auth|credential|lateral")).select("id", "host", "ts")
    met = relate.interval_join(spoken, links, ["host"], "ts", "other_ts", within, within).where(F.abs(F.unix_micros("ts") - F.unix_micros("other_ts")) < int(within * 1_000_000))
    return met.groupBy("id").agg(F.min("other_id").alias("other_id"))


def file_exec_link(files: DataFrame, starts: DataFrame) -> DataFrame:
    """For each written file (id, host, ts, file_path), the first later start (other_id, host, other_ts, image) of the same image on its host."""
    key = lambda c: F.lower(F.element_at(F.split(c, r"\\"), -1))
    f = files.select("host", key(F.col("file_path")).alias("image"), "ts", F.lit(0).alias("start"), "id")
    s = starts.select("host", key(F.col("image")).alias("image"), F.col("other_ts").alias("ts"), F.lit(1).alias("start"), F.col("other_id").alias("id"))
    # one sorted pass: the next start behind a write; starts of the same time come before it
    w = W.partitionBy("host", "image").orderBy(F.desc("ts"), "start", F.desc("id")).rowsBetween(W.unboundedPreceding, -1)
    both = f.unionByName(s).withColumn("other_id", F.last(F.when(F.col("start") == 1, F.col("id")), ignorenulls=True).over(w))
    return both.where("start = 0 AND other_id IS NOT NULL").select("id", "other_id", "image")


def eventid_db(ev: DataFrame) -> DataFrame:
    """Counts of known event ids beside their name, category, significance and expected volume."""
    known = F.broadcast(ev.sparkSession.createDataFrame(rules.EVENT_IDS, "event_code int, name string, category string, significance string, expected long"))
    return ev.groupBy("event_code").agg(F.count("*").alias("n")).join(known, "event_code").select("event_code", "name", "category", "significance", "expected", "n", (F.col("n") > F.col("expected")).alias("above"))


def coverage_gaps(parts: dict[str, DataFrame]) -> DataFrame:
    """A message for each result that is empty; one row of each is looked for."""
    out = None
    for message, df in parts.items():
        one = df.select(F.lit(1).alias("x")).limit(1).agg(F.count("*").alias("n")).where("n = 0").select(F.lit(message).alias("gap"))
        out = one if out is None else out.unionByName(one)
    return out


def col_inventory(df: DataFrame, by: str) -> DataFrame:
    """(file, column, kind, filled) of each column of the rows of each file: how many values it has."""
    names = [c for c in df.columns if c != by]
    g = df.groupBy(by).agg(*[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(names)])
    kinds = dict(df.dtypes)
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("kind"), F.col(f"_{i}").alias("filled")) for i, c in enumerate(names)])
    return g.select(by, F.explode(each).alias("x")).select(by, "x.*")


def profile_structure(lines: DataFrame) -> DataFrame:
    """Per file of (file, line_no, value): JSON, XML, CSV or text; a delimiter counts if the first ten lines have equally many."""
    head = F.col("line_no") < 10
    marks = {",": "csv", "\t": "tsv", "|": "pipe", ";": "semicolon"}
    counts = {m: F.length("value") - F.length(F.replace("value", F.lit(m), F.lit(""))) for m in marks}
    aggs = [F.min(F.when(head, c)).alias(f"lo{i}") for i, c in enumerate(counts.values())] + [F.max(F.when(head, c)).alias(f"hi{i}") for i, c in enumerate(counts.values())]
    g = lines.groupBy("file").agg(F.min_by("value", "line_no").alias("first"), F.count("*").alias("n_lines"), F.bool_or(F.col("value").rlike(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d")).alias("has_times"), F.bool_or(F.col("value").rlike(r"\b(?:\d{1,3}\.){3}\d{1,3}\b")).alias("has_ips"), *aggs)
    kind = F.when(F.ltrim("first").rlike(r"^[\[{]"), "json").when(F.ltrim("first").startswith("<"), "xml")
    for i, name in enumerate(marks.values()):
        kind = kind.when((F.col(f"lo{i}") > 0) & (F.col(f"lo{i}") == F.col(f"hi{i}")), name)
    return g.select("file", kind.otherwise("text").alias("kind"), "n_lines", "has_times", "has_ips")


def _ev(f):
    return lambda s, d: f(security_events(s, d))


def _of(values: list, index: str = "row_id") -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(index) % len(values) + 1).cast("int"))


KINDS = ["Memory_malfind", "Memory_ldrmodules", "Memory_mftscan", "Memory_dkom_hidden", "Memory_strings_ioc", "Memory_carved_file", "Memory_yara_match"]
APIS = ["util.printf(1)", "plain", "media.newPlayer(null)", "Collab.getIcon"]
SECTIONS = [".text", "UPX0", ".vmp1", ".data"]
MAKERS = ["Microsoft Corporation", "Acme", "Adobe Inc."]
VARIABLES = [("NTBuildLab", "7601.17514.amd64fre.win7sp1_rtm"), ("Is64Bit", "True"), ("NtMajorVersion", "6"), ("NtMinorVersion", "1")]
PREFETCHED = ["MIMIKATZ.EXE-12AB34CD.pf", "WHOAMI.EXE-00000001.pf", "NOTEPAD.EXE-99.pf", "NET1.EXE-5.pf"]
RULES = [("mimikatz|lsass", "critical"), ("http|download", "high"), ("net|reg", "medium")]


def exported_rows(ev: DataFrame) -> DataFrame:
    """Rows as memory and string tools export them, one for each event."""
    b = (F.col("k") % 2 == 0).cast("string")
    payload = F.to_json(F.struct(b.alias("in_load"), F.lit("true").alias("in_init"), b.alias("hidden_process"), F.col("process_id").alias("pid"), F.lit("PAGE_EXECUTE").alias("protection"), _of(STRING_KINDS, "k").alias("ioc_type"), F.concat(_of(APIS), F.lit(" "), F.col("k").cast("string")).alias("value"), F.lit("AcroRd32").alias("context"), F.md5("command_line").alias("sha256"), F.col("file_path").alias("rule")))
    return ev.select("row_id", "source_system", "process_name", _of(KINDS).alias("event_type"), payload.alias("raw_payload"))


def _profiles(ev: DataFrame) -> DataFrame:
    name, value = _of([n for n, _ in VARIABLES], "event_rank"), _of([v for _, v in VARIABLES], "event_rank")
    return system_profile(ev.withColumn("event_rank", F.col("row_id") + F.col("k")).select("row_id", "source_system", F.lit("Memory_system_info").alias("event_type"), F.to_json(F.struct(name.alias("variable"), value.alias("value"))).alias("raw_payload")))


def _encoded(ev: DataFrame) -> DataFrame:
    """A third of the commands in base64, a third escaped in the query, a third for PowerShell."""
    plain = b64(F.encode("command_line", "UTF-8"))
    turn = lambda i, c, other: F.when(F.col("row_id") % 3 == i, c).otherwise(other)
    return ev.where(F.length(plain) % 4 == 0).select("row_id", F.when(F.col("row_id") % 3 == 0, F.concat(F.lit("run "), plain)).when(F.col("row_id") % 3 == 2, F.concat(F.lit("powershell.exe -nop -enc "), b64(F.encode("command_line", "UTF-16LE")))).otherwise("none").alias("command_line"), turn(1, F.concat(F.lit("a%3A%20"), plain), F.lit("")).alias("query_string"))


def _layers(ev: DataFrame) -> DataFrame:
    one = b64(F.encode("command_line", "UTF-8"))
    t = F.when(F.col("row_id") % 4 == 0, one).when(F.col("row_id") % 4 == 1, b64(F.encode(one, "UTF-8"))).when(F.col("row_id") % 4 == 2, F.concat(F.lit('x = "'), "process_name", F.lit('" + "'), "username", F.lit('"'))).otherwise(F.lit("plain words"))
    return ev.select("row_id", best_decoding(t).alias("decoded")).where("decoded IS NOT NULL")


def _parts(ev: DataFrame) -> DataFrame:
    hexed = F.regexp_replace(F.hex(F.encode("username", "UTF-8")), "(..)", "$1_")
    e = ev.select("row_id", F.when(F.col("row_id") % 3 == 0, hexed).otherwise("zz").alias("uri"), F.when(F.col("row_id") % 3 == 1, F.concat(F.lit("po`wer"), "process_name")).otherwise("zz").alias("command_line"), F.when(F.col("row_id") % 3 == 2, F.concat(F.lit('"'), "process_name", F.lit('"+"'), "username", F.lit('"'))).otherwise("zz").alias("query_string"))
    return deobfuscated(e, ["uri", "command_line", "query_string"])


def _ids(where: str, *more: str):
    return lambda ev: ev.where(where).select(F.col("row_id").alias("id"), F.col("source_system").alias("host"), F.col("timestamp_utc").alias("ts"), *more)


QUERIES = {
    "sev_text_rules": _ev(lambda ev: ev.select("row_id", text_severity(F.col("command_line"), RULES).alias("severity"))),
    "sev_exe_name": _ev(lambda ev: ev.select("row_id", prefetch_name(_of(PREFETCHED)).alias("name"), program_severity(prefetch_name(_of(PREFETCHED))).alias("severity"))),
    "sev_registry_path": _ev(lambda ev: ev.select("row_id", F.when(has_any(F.lower("command_line"), ODD_VALUES), "high").otherwise(registry_severity(F.col("registry_key"))).alias("severity"))),
    "pe_risk": _ev(lambda ev: pe_risk(ev.select((F.col("row_id") % 997).alias("file"), _of(SECTIONS, "k").alias("section"), (F.col("k") % 75 / 10).alias("entropy"), F.element_at(F.array(*map(F.lit, MAKERS)), (F.col("row_id") % 997 % 3 + 1).cast("int")).alias("vendor"), (F.col("row_id") % 997 % 2 == 0).alias("signed")))),
    "fe_memory_injections": _ev(lambda ev: memory_injections(exported_rows(ev))),
    "fe_strings_iocs": _ev(lambda ev: strings_iocs(exported_rows(ev))),
    "fe_exploit_cve": _ev(lambda ev: exploit_cve(exported_rows(ev))),
    "fe_system_profile": _ev(_profiles),
    "fe_hidden_processes": _ev(lambda ev: hidden_processes(exported_rows(ev))),
    "fe_carved_files": _ev(lambda ev: exported(exported_rows(ev), "memory_carved_file", "sha256")),
    "fe_yara_matches": _ev(lambda ev: exported(exported_rows(ev), "memory_yara_match", "rule")),
    "scan_binary_iocs": _ev(lambda ev: binary_iocs(ev.select(F.col("source_file").alias("file"), F.concat_ws(" ", "command_line", "dest_ip").alias("value")))),
    "claim_iocs": _ev(lambda ev: claim_iocs(ev.select(F.col("row_id").alias("claim_id"), F.concat_ws(" ", "command_line", "file_path", "dest_ip", "query_name").alias("text")))),
    "fe_decoded_content": _ev(lambda ev: decoded_content(_encoded(ev))),
    "fe_deobfuscated": _ev(_parts),
    "deobf_best": _ev(_layers),
    "suspicious_chains": _ev(suspicious_chains),
    "descendants": _ev(descendants),
    "lineage_file": _ev(lambda ev: lineage_file(ev.select(F.col("row_id").alias("id"), F.element_at(F.split("command_line", " "), -1).alias("value")).where("length(value) >= 3"), ev.where("event_code = 11").select(F.col("row_id").alias("other_id"), "file_path"))),
    "lineage_auth": _ev(lambda ev: lineage_auth(_ids("event_code IN (4624, 4625, 4648)", F.lit("Logon seen").alias("text"))(ev), ev.where("logon_type = 3").select(F.col("row_id").alias("other_id"), F.col("source_system").alias("host"), F.col("timestamp_utc").alias("other_ts")))),
    "file_exec_link": _ev(lambda ev: file_exec_link(_ids("event_code IN (11, 15)", F.concat(F.lit("C:\\Temp\\"), "process_name").alias("file_path"))(ev), ev.where("event_code IN (1, 4688)").select(F.col("row_id").alias("other_id"), F.col("source_system").alias("host"), F.col("timestamp_utc").alias("other_ts"), F.col("process_name").alias("image")))),
    "eventid_db": _ev(eventid_db),
    "coverage_gaps": _ev(lambda ev: coverage_gaps({"No process trees built (missing Sysmon/Windows process events)": ev.where("event_code IN (1, 4688)"), "No encoded content decoded": ev.where("command_line LIKE '%FromBase64String%'"), "No cross-system correlations (single system or missing data)": ev.where("source_system = 'host99'"), "No network profiles (missing Sysmon EID 3)": ev.where("event_code = 3")})),
    "col_inventory": _ev(lambda ev: col_inventory(ev.select("source_file", "command_line", F.nullif("query_string", F.lit("")).alias("query_string"), "status_code", "value"), "source_file")),
    "profile_structure": _ev(lambda ev: profile_structure(ev.select(F.col("username").alias("file"), F.row_number().over(W.partitionBy("username").orderBy("row_id")).alias("nr"), "user_id", "dest_ip", "timestamp_utc").select("file", (F.col("nr") - 1).alias("line_no"), F.when(F.col("user_id") % 4 == 0, F.concat(F.lit('{"a": "'), "dest_ip", F.lit('"}'))).when(F.col("user_id") % 4 == 1, F.concat_ws(",", "dest_ip", F.date_format("timestamp_utc", "yyyy-MM-dd HH:mm"))).when(F.col("user_id") % 4 == 2, F.lit("<x/>")).otherwise("words only").alias("value")))),
    "except_events": _ev(lambda ev: ev.where("severity IN ('high', 'critical')").select("row_id").join(ev.where("command_line LIKE '%exe%'").select("row_id"), "row_id", "left_anti")),
}

_q = lambda text: "'" + text.replace("'", "''") + "'"
_list = lambda values, index="row_id": "[" + ", ".join(map(_q, values)) + f"][CAST({index} % {len(values)} + 1 AS INT)]"
_any = lambda text, words: "(" + " OR ".join(f"contains({text}, {_q(w)})" for w in words) + ")"
_KIND, _API = _list(KINDS), f"{_list(APIS)} || ' ' || k"
_PHASE = "CASE " + " ".join(f"WHEN {_any('lower(decoded)', words)} THEN {_q(n)}" for n, words in PHASES) + " ELSE 'other' END AS phase"
_CLAIM = " UNION ".join(f"SELECT claim_id, '{k}' AS kind, {'lower(v)' if low else 'v'} AS value FROM (SELECT claim_id, unnest(regexp_extract_all(text, {_q(p)}, 1)) AS v FROM c)" for k, (p, low) in CLAIM_PATTERNS.items())
_SPAWN = relate._CLS

ORACLES = {
    "sev_text_rules": f"WITH {SEC} SELECT row_id, CASE WHEN regexp_matches(lower(command_line), 'mimikatz|lsass') THEN 'critical' WHEN regexp_matches(lower(command_line), 'http|download') THEN 'high' WHEN regexp_matches(lower(command_line), 'net|reg') THEN 'medium' ELSE 'info' END AS severity FROM sec",
    "sev_exe_name": f"WITH {SEC} SELECT row_id, {_list(['MIMIKATZ.EXE', 'WHOAMI.EXE', 'NOTEPAD.EXE', 'NET1.EXE'])} AS name, {_list(['high', 'medium', 'info', 'medium'])} AS severity FROM sec",
    "sev_registry_path": f"WITH {SEC} SELECT row_id, CASE WHEN {_any('lower(command_line)', ODD_VALUES)} THEN 'high' WHEN registry_key LIKE '%Run%' THEN 'medium' WHEN registry_key LIKE '%Services%' THEN 'low' ELSE 'info' END AS severity FROM sec",
    "pe_risk": f"WITH {SEC}, x AS (SELECT row_id % 997 AS file, {_list(SECTIONS, 'k')} AS section, CAST(k % 75 AS DOUBLE) / 10 AS entropy, {_list(MAKERS, 'row_id % 997')} AS vendor, row_id % 997 % 2 = 0 AS signed FROM sec), g AS (SELECT file, bool_or(section = 'UPX0') AS upx, bool_or(section = '.vmp1') AS vmp, max(entropy) AS entropy, bool_or(vendor <> 'Acme' AND NOT signed) AS masquerading FROM x GROUP BY 1), p AS (SELECT file, CASE WHEN upx THEN 'UPX' WHEN vmp THEN 'VMProtect' WHEN entropy > 7 THEN 'Unknown (high entropy)' END AS packer, entropy, masquerading FROM g) SELECT *, CASE WHEN masquerading THEN 'high' WHEN packer IS NOT NULL THEN 'medium' ELSE 'info' END AS severity FROM p",
    "fe_memory_injections": f"WITH {SEC} SELECT row_id, CASE row_id % 7 WHEN 0 THEN 'malfind' WHEN 1 THEN 'ldr_injection' ELSE 'ads' END AS finding, 'PAGE_EXECUTE' AS protection FROM sec WHERE row_id % 7 IN (0, 2) OR (row_id % 7 = 1 AND k % 2 = 1)",
    "fe_strings_iocs": f"WITH {SEC} SELECT {_list(STRING_KINDS, 'k')} AS kind, count(*) AS n, count(DISTINCT {_API}) AS distinct_values FROM sec WHERE row_id % 7 = 4 GROUP BY 1",
    "fe_exploit_cve": f"WITH {SEC}, s AS (SELECT row_id, {_API} AS value FROM sec WHERE row_id % 7 = 4), e(pattern, cve) AS (VALUES {', '.join(f'({_q(p)}, {_q(c)})' for p, c in EXPLOITS)}) SELECT cve, pattern, min(row_id) AS row_id, arg_min(value, row_id) AS matched_in FROM s JOIN e ON contains(value, pattern) GROUP BY 1, 2",
    "fe_system_profile": f"WITH {SEC} SELECT source_system, CASE WHEN bool_or((row_id + k) % 4 = 0) THEN 'Win7SP1' WHEN bool_or((row_id + k) % 4 = 2) AND bool_or((row_id + k) % 4 = 3) THEN 'never' ELSE '' END || CASE WHEN NOT bool_or((row_id + k) % 4 = 0) THEN '' WHEN bool_or((row_id + k) % 4 = 1) THEN 'x64' ELSE 'x86' END AS profile, CASE WHEN bool_or((row_id + k) % 4 = 1) THEN 'x64' ELSE 'x86' END AS architecture, CASE WHEN bool_or((row_id + k) % 4 = 0) THEN '17514' ELSE '' END AS build_number FROM sec GROUP BY 1",
    "fe_hidden_processes": f"WITH {SEC} SELECT row_id, CASE WHEN row_id % 7 = 3 THEN 'hidden' ELSE 'malfind_hidden' END AS finding, process_id AS pid FROM sec WHERE row_id % 7 = 3 OR (row_id % 7 = 0 AND k % 2 = 0)",
    "fe_carved_files": f"WITH {SEC} SELECT row_id, md5(command_line) AS sha256 FROM sec WHERE row_id % 7 = 5",
    "fe_yara_matches": f"WITH {SEC} SELECT row_id, file_path AS rule FROM sec WHERE row_id % 7 = 6",
    "scan_binary_iocs": f"WITH {SEC}, t AS (SELECT source_file AS file, command_line || ' ' || dest_ip AS v FROM sec), x AS (SELECT DISTINCT file, 'ip' AS kind, unnest(regexp_extract_all(v, '\\b\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\b')) AS found FROM t UNION SELECT file, 'url', unnest(regexp_extract_all(v, 'https?://[^\\s\"''<>]{{10,}}')) FROM t" + "".join(f" UNION SELECT file, 'command:{tool}', unnest(regexp_extract_all(v, {_q('(?i)' + p)})) FROM t" for p, tool in BINARY_COMMANDS) + ") SELECT *, CASE WHEN kind LIKE 'command%' THEN 'critical' WHEN kind = 'ip' AND (found LIKE '10.%' OR found LIKE '192.168.%') THEN 'medium' ELSE 'high' END AS severity FROM x",
    "claim_iocs": f"WITH {SEC}, c AS (SELECT row_id AS claim_id, command_line || ' ' || file_path || ' ' || dest_ip || ' ' || query_name AS text FROM sec) SELECT * FROM ({_CLAIM})",
    "fe_decoded_content": f"WITH {SEC}, x AS (SELECT row_id, CASE row_id % 3 WHEN 0 THEN 'base64' WHEN 1 THEN 'url_then_base64' ELSE 'powershell' END AS source, command_line AS decoded FROM sec), y AS (SELECT * FROM x WHERE source = 'powershell' OR length(rtrim(to_base64(encode(decoded)), '=')) >= 16 UNION ALL SELECT row_id, 'base64', decoded FROM x WHERE source = 'powershell') SELECT row_id, source, decoded, {_PHASE} FROM y",
    "fe_deobfuscated": f"WITH {SEC} SELECT row_id, CASE row_id % 3 WHEN 0 THEN 'uri' WHEN 1 THEN 'command_line' ELSE 'query_string' END AS field, CASE row_id % 3 WHEN 0 THEN 'hex' WHEN 1 THEN 'filler' ELSE 'concat' END AS method, CASE row_id % 3 WHEN 0 THEN username WHEN 1 THEN 'power' || process_name ELSE process_name || username END AS decoded FROM sec",
    "deobf_best": f"WITH {SEC} SELECT row_id, CASE WHEN row_id % 4 = 2 THEN process_name || username WHEN contains(command_line, '-enc SQBFAFgA') THEN 'IEX' ELSE command_line END AS decoded FROM sec WHERE row_id % 4 < 3",
    "suspicious_chains": f"WITH {SEC}, x AS (SELECT row_id, parent_process_name AS parent, process_name AS child, lower(command_line) AS c FROM sec WHERE event_code IN (1, 4688)), y AS (SELECT *, {_SPAWN} AS class FROM x) SELECT row_id, parent, child, class, CAST(CASE WHEN class = 'HIGHLY_SUSPICIOUS' THEN 10 ELSE 0 END + CASE WHEN {_any('c', ['invoke-', 'downloadstring', 'iex', '-enc'])} THEN 5 ELSE 0 END + CASE WHEN {_any('c', ['http:', 'https:', 'ftp:', '//'])} THEN 3 ELSE 0 END + CASE WHEN {_any('c', ['mimikatz', 'procdump', 'psexec', 'wmiexec', 'smbexec'])} THEN 10 ELSE 0 END AS BIGINT) AS score, CASE WHEN child = 'svchost.exe' AND NOT contains(c, 'system32') THEN 'svchost.exe' ELSE '' END AS evasion FROM y WHERE class LIKE '%SUSPICIOUS'",
    "descendants": f"WITH RECURSIVE {SEC}, {relate._P}, d AS (SELECT parent_id AS id, child_id AS node, lpad(CAST(child_id AS VARCHAR), 19, '0') AS path, 1 AS level FROM e UNION ALL SELECT d.id, e.child_id, path || '/' || lpad(CAST(e.child_id AS VARCHAR), 19, '0'), level + 1 FROM d JOIN e ON e.parent_id = d.node), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY path) AS nr FROM d) SELECT id, node AS descendant, CAST(level AS BIGINT) AS level, nr FROM r WHERE nr <= 10",
    "lineage_file": f"WITH {SEC}, v AS (SELECT row_id AS id, list_last(string_split(command_line, ' ')) AS value FROM sec), f AS (SELECT file_path, min(row_id) AS other_id FROM sec WHERE event_code = 11 GROUP BY 1), m AS (SELECT value, min(other_id) AS other_id, arg_min(file_path, other_id) AS file_path FROM (SELECT DISTINCT value FROM v WHERE length(value) >= 3) JOIN f ON contains(lower(file_path), lower(value)) GROUP BY 1) SELECT id, other_id, file_path FROM v JOIN m USING (value)",
    "lineage_auth": f"WITH {SEC} SELECT h.row_id AS id, min(o.row_id) AS other_id FROM sec h JOIN sec o ON h.source_system = o.source_system AND o.logon_type = 3 AND abs(epoch_us(o.timestamp_utc) - epoch_us(h.timestamp_utc)) < 10000000 WHERE h.event_code IN (4624, 4625, 4648) GROUP BY 1",
    "file_exec_link": f"WITH {SEC}, s AS (SELECT f.row_id AS id, o.row_id AS other_id, f.process_name AS image, row_number() OVER (PARTITION BY f.row_id ORDER BY o.timestamp_utc, o.row_id) AS nr FROM sec f JOIN sec o ON f.source_system = o.source_system AND f.process_name = o.process_name AND o.event_code IN (1, 4688) AND o.timestamp_utc > f.timestamp_utc WHERE f.event_code IN (11, 15)) SELECT id, other_id, image FROM s WHERE nr = 1",
    "eventid_db": f"WITH {SEC}, t(event_code, name, category, significance, expected) AS (VALUES {', '.join(f'({c}, {_q(n)}, {_q(g)}, {_q(s)}, {e})' for c, n, g, s, e in rules.EVENT_IDS)}) SELECT event_code, name, category, significance, CAST(expected AS BIGINT) AS expected, count(*) AS n, count(*) > expected AS above FROM sec JOIN t USING (event_code) GROUP BY event_code, name, category, significance, expected",
    "coverage_gaps": f"WITH {SEC} SELECT 'No process trees built (missing Sysmon/Windows process events)' AS gap WHERE NOT EXISTS (SELECT 1 FROM sec WHERE event_code IN (1, 4688)) UNION ALL SELECT 'No encoded content decoded' WHERE NOT EXISTS (SELECT 1 FROM sec WHERE contains(command_line, 'FromBase64String')) UNION ALL SELECT 'No cross-system correlations (single system or missing data)' WHERE NOT EXISTS (SELECT 1 FROM sec WHERE source_system = 'host99') UNION ALL SELECT 'No network profiles (missing Sysmon EID 3)' WHERE NOT EXISTS (SELECT 1 FROM sec WHERE event_code = 3)",
    "col_inventory": f"WITH {SEC} " + " UNION ALL ".join(f"SELECT source_file, '{c}' AS \"column\", '{kind}' AS kind, count({value}) AS filled FROM sec GROUP BY 1" for c, kind, value in (("command_line", "string", "command_line"), ("query_string", "string", "nullif(query_string, '')"), ("status_code", "int", "status_code"), ("value", "double", "value"))),
    "profile_structure": f"WITH {SEC} SELECT username AS file, CASE user_id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'csv' WHEN 2 THEN 'xml' ELSE 'text' END AS kind, count(*) AS n_lines, user_id % 4 = 1 AS has_times, user_id % 4 <= 1 AS has_ips FROM sec GROUP BY username, user_id",
    "except_events": f"WITH {SEC} SELECT row_id FROM sec WHERE severity IN ('high', 'critical') EXCEPT SELECT row_id FROM sec WHERE contains(command_line, 'exe')",
}
