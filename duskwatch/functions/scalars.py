"""Column functions over events and texts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .. import rules


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often and wherever ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ip_number(ip: Column) -> Column:
    """Dotted quad as a number; null for anything else."""
    parts = F.split(ip, r"\.")
    number = sum((F.try_element_at(parts, F.lit(i + 1)).try_cast("bigint") * (256 ** (3 - i)) for i in range(1, 4)), F.try_element_at(parts, F.lit(1)).try_cast("bigint") * 256**3)
    octet = r"(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return F.when(ip.rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$"), number)


def _within(n: Column, a: int, b: int, bits: int) -> Column:
    low = a * 256**3 + b * 256**2
    return n.between(low, low + 2 ** (32 - bits) - 1)


def ip_class(ip: Column) -> Column:
    """LOOPBACK, LINK_LOCAL, UNSPECIFIED, INTERNAL, EXTERNAL or UNKNOWN, told in that order."""
    n = ip_number(ip)
    return (
        F.when(_within(n, 127, 0, 8) | (ip == "::1"), "LOOPBACK").when(_within(n, 169, 254, 16) | ip.rlike("(?i)^fe[89ab][0-9a-f]:"), "LINK_LOCAL")
        .when((n == 0) | (ip == "::"), "UNSPECIFIED").when(_within(n, 10, 0, 8) | _within(n, 172, 16, 12) | _within(n, 192, 168, 16) | ip.rlike("(?i)^f[cd][0-9a-f]{2}:"), "INTERNAL")
        .when(n.isNotNull() | ip.rlike("^[0-9a-fA-F:]*:[0-9a-fA-F:]+$"), "EXTERNAL").otherwise("UNKNOWN")
    )


def exe_basename(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"[\\/]"), -1))


def user_class(name: Column) -> Column:
    low = F.lower(name)
    bare = F.element_at(F.split(low, r"\\"), -1)
    return (
        F.when(name.isNull() | (name == ""), "UNKNOWN").when(low.isin(rules.SYSTEM_ACCOUNTS) | bare.isin(rules.SYSTEM_ACCOUNTS), "SYSTEM").when(low.endswith("$"), "MACHINE")
        .when(bare.startswith("svc_") | bare.startswith("service_"), "SERVICE").when(bare.contains("admin"), "ADMIN").otherwise("USER")
    )


def proc_class(name: Column) -> Column:
    base = exe_basename(name)
    return (
        F.when(base.isin(rules.SYSTEM_PROCESSES), "SYSTEM_PROCESS").when(base.isin(rules.WINDOWS_TOOLS), "WINDOWS_TOOL")
        .when(base.isin(rules.ATTACK_TOOLS), "KNOWN_ATTACK_TOOL").when(base.isin(rules.WEB_SERVERS), "WEB_SERVER").otherwise("UNKNOWN")
    )


def logon_type_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in rules.LOGON_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, code.cast("int")), F.concat(F.lit("Unknown("), code.cast("string"), F.lit(")")))


@F.pandas_udf(DoubleType())
def _entropy(texts: pd.Series) -> pd.Series:
    def of(text: str | None) -> float:
        if not text:
            return 0.0
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        # few codes are counted in place, texts with higher ones are sorted
        counts = np.bincount(codes) if codes.max() < 0x3000 else np.unique(codes, return_counts=True)[1]
        shares = counts[counts > 0] / len(codes)
        return float(-(shares * np.log2(shares)).sum()) + 0.0

    return texts.map(of)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits over the characters of a text; 0 for null and empty texts. Characters are counted in one pass."""
    return _entropy(text)


def norm_entropy(text: Column) -> Column:
    """Entropy over that of equally frequent characters; 0 with one distinct character or none."""
    n = F.size(F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")))
    return F.when(n <= 1, 0.0).otherwise(entropy(text) / F.log2(n.cast("double")))


def payload_format(text: Column) -> Column:
    bare = F.btrim(text)
    return (
        F.when(bare.startswith("{") | bare.startswith("["), "json").when(bare.contains("\n") & bare.contains(":"), "kv_newline")
        .when(bare.contains("|") & bare.contains("="), "kv_pipe").otherwise("raw")
    )


def kv_parse(text: Column, between: str, within: str) -> Column:
    """Map of ``key<within>value`` parts set apart by ``between``; parts without the sign are left out."""
    parts = F.filter(F.split(text, between), lambda p: p.contains(within))
    pairs = F.transform(parts, lambda p: F.struct(F.btrim(F.substring_index(p, within, 1)).alias("key"), F.btrim(F.substr(p, F.instr(p, within) + len(within))).alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda x: x["key"] != ""))


def event_summary(uri: Column, method: Column, process: Column, command: Column, event_type: Column) -> Column:
    """One line: web request, else process with command, else process, else the event's type."""
    return (
        F.when(uri.isNotNull(), F.concat(F.lit("Web: "), F.coalesce(method, F.lit("")), F.lit(" "), uri)).when(process.isNotNull() & command.isNotNull(), F.concat(F.lit("Process: "), process, F.lit(" | "), F.substring(command, 1, 100)))
        .when(process.isNotNull(), F.concat(F.lit("Process: "), process)).otherwise(F.concat(F.lit("Event: "), event_type))
    )


def severity_of_status(status: Column, uri: Column) -> Column:
    bad = uri.rlike(r"(?i)\.\./|cmd|shell|passwd|union|<script|exec")
    base = F.when(status >= 500, "medium").when(status >= 400, "low").otherwise("info")
    return F.when(bad, "high").otherwise(base)


def timestamp_of(text: Column) -> Column:
    """UTC time of ISO, US, EU, access-log, file-time, second or millisecond texts; null if none fits."""
    bare = F.btrim(text)
    digits = F.when(bare.rlike("^[0-9]+$"), bare.try_cast("bigint"))
    number = (
        F.when(F.length(bare) > 15, F.timestamp_micros(((digits - F.lit(116444736000000000)) / 10).cast("bigint")))
        .when(digits > 1000000000000, F.timestamp_millis(digits)).otherwise(F.timestamp_seconds(digits))
    )
    formats = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "dd/MMM/yyyy:HH:mm:ss Z"]
    return F.coalesce(F.when(digits.isNotNull(), number), *[F.try_to_timestamp(bare, F.lit(f)) for f in formats])


def refang(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("[.]"), F.lit(".")), F.lit("hxxp"), F.lit("http"))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in ("critical", "high", "medium", "low", "info")]), F.lower(severity))


def risk_score(malicious: Column, suspicious: Column, confidence: Column) -> Column:
    score = F.when(malicious > 5, 50).when(malicious > 0, 30).otherwise(0) + F.when(suspicious > 0, 10).otherwise(0) + F.least(F.lit(40), F.floor(confidence / 2).cast("int"))
    return F.least(F.lit(100), score)
