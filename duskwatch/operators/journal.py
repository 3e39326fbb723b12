"""The change journal of a volume: flags, renames, files that came and went, and bursts of changes.

Records are (file_reference, usn, timestamp_utc, reason, filename); the reason is a set of bits.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..adapters import table

# Reasons by bit, and what makes a name suspicious.
REASONS = {
    0x1: "DATA_OVERWRITE", 0x2: "DATA_EXTEND", 0x4: "DATA_TRUNCATION", 0x10: "NAMED_DATA_OVERWRITE", 0x20: "NAMED_DATA_EXTEND", 0x40: "NAMED_DATA_TRUNCATION", 0x100: "FILE_CREATE", 0x200: "FILE_DELETE", 0x400: "EA_CHANGE", 0x800: "SECURITY_CHANGE", 0x1000: "RENAME_OLD_NAME",
    0x2000: "RENAME_NEW_NAME", 0x4000: "INDEXABLE_CHANGE", 0x8000: "BASIC_INFO_CHANGE", 0x10000: "HARD_LINK_CHANGE", 0x20000: "COMPRESSION_CHANGE", 0x40000: "ENCRYPTION_CHANGE", 0x80000: "OBJECT_ID_CHANGE", 0x100000: "REPARSE_POINT_CHANGE", 0x200000: "STREAM_CHANGE", 0x80000000: "CLOSE",
}
CREATE, DELETE, OLD_NAME, NEW_NAME = 0x100, 0x200, 0x1000, 0x2000
ENDINGS = [".ps1", ".bat", ".cmd", ".vbs", ".js", ".exe", ".dll", ".rar", ".zip", ".jpg"]
NAMES = ["mimikatz", "psexec", "certutil", "bitsadmin", "winrar", "telegram", "amanwhogetsnorest", "whoisthebaba", "eventlog", "normal.zip"]


def has(bits: int) -> Column:
    return F.col("reason").bitwiseAND(F.lit(bits)) != 0


def reason_names(reason: Column) -> Column:
    """Names of the bits that are set, in the order of the bits, joined by commas."""
    return F.array_join(F.array_compact(F.array(*[F.when(reason.bitwiseAND(F.lit(b)) != 0, F.lit(n)) for b, n in REASONS.items()])), ",")


def suspicious(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return low.rlike("|".join(map(re.escape, NAMES)) + "|(?:" + "|".join(map(re.escape, ENDINGS)) + r")\z")  # one test: the name is worked out once


def renames(journal: DataFrame) -> DataFrame:
    """(file_reference, usn, old, new): the last old name of a file before each of its new names."""
    before = W.partitionBy("file_reference").orderBy("usn", "filename", "timestamp_utc").rowsBetween(W.unboundedPreceding, -1)
    j = journal.where(has(OLD_NAME | NEW_NAME)).withColumn("old", F.last(F.when(has(OLD_NAME), F.col("filename")), ignorenulls=True).over(before))
    return j.where(has(NEW_NAME) & F.col("old").isNotNull()).select("file_reference", "usn", "old", F.col("filename").alias("new"))


def staged_deletions(journal: DataFrame, within: float = 3600) -> DataFrame:
    """(usn, deleted_usn, name, seconds): creations of a suspicious name, and its first deletion after it if that comes within the time.

    Times are collapsed first, of a time's deletions the one of least usn stays. The next deletion lies in the creation's
    own slot of time, or is the first of the name's next slot, so no pairs are formed.
    """
    limit = int(within * 1_000_000)
    width = max(limit // 60, 1)
    some = journal.where(has(CREATE | DELETE) & suspicious(F.col("filename"))).select(F.lower("filename").alias("name"), F.unix_micros("timestamp_utc").alias("m"), "usn", "reason")
    some = some.withColumn("slot", ((F.col("m") - F.pmod("m", F.lit(width))) / width).cast("long"))
    times = some.groupBy("name", "slot", "m").agg(F.min(F.when(has(DELETE), F.struct("m", F.col("usn").alias("deleted_usn")))).alias("gone"), F.bool_or(has(CREATE)).alias("made"))
    along = W.partitionBy("name").orderBy("slot")
    slots = times.groupBy("name", "slot").agg(F.min("gone").alias("head"))
    slots = slots.select("name", "slot", F.first("head", ignorenulls=True).over(along.rowsBetween(1, W.unboundedFollowing)).alias("beyond"))
    down = W.partitionBy("name", "slot").orderBy(F.desc("m")).rowsBetween(W.unboundedPreceding, -1)  # later times come first
    found = times.withColumn("inside", F.last("gone", ignorenulls=True).over(down)).where("made").join(slots, ["name", "slot"])
    found = found.select("name", "m", F.coalesce("inside", "beyond").alias("next")).where(F.col("next.m") - F.col("m") < limit)
    near = some.where(has(CREATE)).select("usn", "name", "m").join(found, ["name", "m"])
    first = near.groupBy("usn").agg(F.min(F.struct(F.col("next.m").alias("gone"), F.col("next.deleted_usn").alias("deleted_usn"), "name", ((F.col("next.m") - F.col("m")) / 1e6).alias("seconds"))).alias("f"))
    return first.select("usn", "f.deleted_usn", "f.name", F.round("f.seconds", 6).alias("seconds"))


def rapid_operations(journal: DataFrame, least: int = 5, odd: int = 2) -> DataFrame:
    """(second, n, files, suspicious): seconds with so many changes and so many of suspicious names among them."""
    g = journal.groupBy(F.date_trunc("second", "timestamp_utc").alias("second")).agg(F.count("*").alias("n"), F.countDistinct("filename").alias("files"), F.count_if(suspicious(F.col("filename"))).alias("suspicious"))
    return g.where((F.col("n") >= least) & (F.col("suspicious") >= odd))


FILES = ["report.docx", "Mimikatz.log", "tool.EXE", "notes.txt", "photo.jpg", "data.bin"]


def records(s, d) -> DataFrame:
    """A journal made from the line items: a day of the table stands for a second."""
    bits = F.element_at(F.array(*[F.lit(b) for b in (0x100, 0x80000200, 0x1000, 0x2000, 0x80008102)]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    name = F.concat((F.col("l_partkey") % 50).cast("string"), F.element_at(F.array(*map(F.lit, FILES)), (F.col("l_partkey") % len(FILES) + 1).cast("int")))
    at = F.timestamp_micros(F.unix_date(F.col("l_shipdate").cast("date")).cast("long") * 1_000_000 + F.col("l_linenumber") * 1000)
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("file_reference"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("usn"), at.alias("timestamp_utc"), bits.cast("long").alias("reason"), name.alias("filename"))


_J = (
    "j AS (SELECT l_orderkey AS file_reference, l_orderkey * 8 + l_linenumber AS usn, make_timestamp(epoch_us(l_shipdate::TIMESTAMP) // 86400 + l_linenumber * 1000) AS ts, CAST(l_linenumber % 5 AS INT) AS kind, l_partkey % 50 || ['report.docx', 'Mimikatz.log', 'tool.EXE', 'notes.txt', 'photo.jpg', 'data.bin'][CAST(l_partkey % 6 + 1 AS INT)] AS filename, l_partkey % 6 IN (1, 2, 4) AS odd FROM lineitem)"
)
QUERIES = {
    "usn_reasons": lambda s, d: records(s, d).select("usn", reason_names(F.col("reason")).alias("reasons")),
    "usn_renames": lambda s, d: renames(records(s, d)),
    "usn_staged_delete": lambda s, d: staged_deletions(records(s, d)),
    "usn_rapid_ops": lambda s, d: rapid_operations(records(s, d)),
}
ORACLES = {
    "usn_reasons": f"WITH {_J} SELECT usn, ['FILE_CREATE', 'FILE_DELETE,CLOSE', 'RENAME_OLD_NAME', 'RENAME_NEW_NAME', 'DATA_EXTEND,FILE_CREATE,BASIC_INFO_CHANGE,CLOSE'][kind + 1] AS reasons FROM j",
    "usn_renames": f"WITH {_J}, r AS (SELECT *, last_value(CASE WHEN kind = 2 THEN filename END IGNORE NULLS) OVER (PARTITION BY file_reference ORDER BY usn, filename, ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM j) SELECT file_reference, usn, old, filename AS new FROM r WHERE kind = 3 AND old IS NOT NULL",
    "usn_staged_delete": f"WITH {_J}, x AS (SELECT a.usn, b.usn AS deleted_usn, lower(a.filename) AS name, round((epoch_us(b.ts) - epoch_us(a.ts)) / 1e6, 6) AS seconds, row_number() OVER (PARTITION BY a.usn ORDER BY b.ts, b.usn) AS nr FROM j a JOIN j b ON a.filename = b.filename AND a.kind IN (0, 4) AND b.kind = 1 AND a.odd AND b.ts > a.ts AND b.ts < a.ts + INTERVAL 1 HOUR) SELECT usn, deleted_usn, name, seconds FROM x WHERE nr = 1",
    "usn_rapid_ops": f"WITH {_J} SELECT date_trunc('second', ts) AS second, count(*) AS n, count(DISTINCT filename) AS files, count(*) FILTER (odd) AS suspicious FROM j GROUP BY 1 HAVING count(*) >= 5 AND count(*) FILTER (odd) >= 2",
}
