"""Packages of findings by domain: what each holds by source, its size in tokens, and a bounded summary of too large ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..store import stored
from . import categories, detect, indicators

#: Tokens of four characters that a package may have, and rows of each of its sources that a summary keeps.
MOST_TOKENS, SUMMARY = 150_000, 50
#: (package, source): (findings of the events, the columns that go into the package).
SOURCES: dict[tuple[str, str], tuple[Callable[[DataFrame], DataFrame], list[str]]] = {
    ("process_trees", "remote_children"): (lambda ev: categories.lateral_movement(ev).where("kind IN ('remote_child', 'remote_command')"), ["row_id", "kind", "what"]),
    ("file_operations", "files"): (categories.file_operations, ["row_id", "kind", "path", "process_name"]),
    ("persistence", "mechanisms"): (lambda ev: categories.persistence(ev).where("kind NOT LIKE '%service'"), ["row_id", "kind", "what"]),
    ("network", "connections"): (lambda ev: categories.network(ev).where("kind <> 'connection'"), ["row_id", "kind", "what", "dest_port"]),
    ("network", "indicators"): (lambda ev: indicators.ioc_table(ev).where("kind = 'ipv4'"), ["kind", "value", "risk"]),
    ("services", "services"): (lambda ev: categories.persistence(ev).where("kind LIKE '%service'"), ["row_id", "kind", "what"]),
    ("auth_lateral", "lateral_movement"): (categories.lateral_movement, ["row_id", "kind", "what"]),
    ("auth_lateral", "credentials"): (categories.credential_access, ["row_id", "kind", "what"]),
    ("cross_system", "directory"): (categories.directory_changes, ["row_id", "event_code", "attribute", "level"]),
    ("powershell", "scripts"): (categories.powershell, ["row_id", "kind", "indicator"]),
    ("anomalies", "entropy"): (detect.high_entropy, ["kind", "name"]),
}


def packages(ev: DataFrame) -> DataFrame:
    """(package, source, text) of all packages' rows: their columns joined by bars, nulls left out."""
    out = None
    for (package, source), (make, columns) in SOURCES.items():
        rows = make(ev).select(F.lit(package).alias("package"), F.lit(source).alias("source"), F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out


def sizes(rows: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    """(package, n, tokens, too_large) of packages' rows."""
    g = rows.groupBy("package").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    tokens = F.floor(F.col("chars") / 4)
    return g.select("package", "n", tokens.alias("tokens"), (tokens > most).alias("too_large"))


def bounded(rows: DataFrame, most: int = MOST_TOKENS, keep: int = SUMMARY, parts: int = 64) -> DataFrame:
    """All rows of packages that fit, and of too large ones the first ``keep`` of each source by their text: each of ``parts``
    keeps its own first ones, so no task orders a whole source. The rows are made once."""
    rows = stored(rows)
    large = F.broadcast(sizes(rows, most).select("package", "too_large"))  # a row for each package
    marked = rows.join(large, "package")
    cut = marked.where("too_large").withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parts)))
    for keys in (["package", "source", "part"], ["package", "source"]):
        cut = cut.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("text"))).where(F.col("place") <= keep)
    return marked.where("NOT too_large").select(rows.columns).unionByName(cut.select(rows.columns))


def _ev(f):
    return lambda s, d: f(packages(categories.category_events(s, d)))


_C = categories.ORACLES
_PLAIN = {
    ("process_trees", "remote_children"): (f"SELECT * FROM ({_C['fe_lateral_movement']}) WHERE kind LIKE 'remote%'", ["row_id", "kind", "what"]),
    ("file_operations", "files"): (_C["fe_file_operations"], ["row_id", "kind", "path", "process_name"]),
    ("persistence", "mechanisms"): (f"SELECT * FROM ({_C['fe_persistence']}) WHERE kind IN ('registry', 'task')", ["row_id", "kind", "what"]),
    ("network", "connections"): (f"SELECT * FROM ({_C['fe_network']}) WHERE kind IN ('external', 'dns')", ["row_id", "kind", "what", "dest_port"]),
    ("network", "indicators"): (f"SELECT * FROM ({indicators.table_sql(categories._CAT)}) WHERE kind = 'ipv4'", ["kind", "value", "risk"]),
    ("services", "services"): (f"SELECT * FROM ({_C['fe_persistence']}) WHERE kind NOT IN ('registry', 'task')", ["row_id", "kind", "what"]),
    ("auth_lateral", "lateral_movement"): (_C["fe_lateral_movement"], ["row_id", "kind", "what"]),
    ("auth_lateral", "credentials"): (_C["fe_credential_access"], ["row_id", "kind", "what"]),
    ("cross_system", "directory"): (_C["fe_ad_changes"], ["row_id", "event_code", "attribute", "level"]),
    ("powershell", "scripts"): (_C["fe_powershell"], ["row_id", "kind", "indicator"]),
    ("anomalies", "entropy"): (detect.ORACLES["high_entropy"], ["kind", "name"]),
}
_TEXT = " UNION ALL ".join(f"SELECT '{p}' AS package, '{s}' AS source, concat_ws('|', {', '.join(f'CAST({c} AS VARCHAR)' for c in columns)}) AS text FROM ({sql})" for (p, s), (sql, columns) in _PLAIN.items())
_SIZES = f"t AS ({_TEXT}), z AS (SELECT package, count(*) AS n, CAST(sum(length(text)) // 4 AS BIGINT) AS tokens FROM t GROUP BY 1)"

QUERIES = {
    "package_domains": _ev(lambda rows: rows.groupBy("package", "source").agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts"))),
    "size_check": _ev(lambda rows: sizes(rows)),
    "package_summary": _ev(lambda rows: bounded(rows, most=5_000).groupBy("package", "source").agg(F.count("*").alias("n"), F.min("text").alias("first"), F.max("text").alias("last"))),
}
ORACLES = {
    "package_domains": f"WITH t AS ({_TEXT}) SELECT package, source, count(*) AS n, count(DISTINCT text) AS texts FROM t GROUP BY 1, 2",
    "size_check": f"WITH {_SIZES} SELECT package, n, tokens, tokens > 150000 AS too_large FROM z",
    "package_summary": f"WITH {_SIZES}, k AS (SELECT t.*, tokens > 5000 AS large, row_number() OVER (PARTITION BY t.package, source ORDER BY text) AS nr FROM t JOIN z USING (package)) SELECT package, source, count(*) AS n, min(text) AS first, max(text) AS last FROM k WHERE NOT large OR nr <= 50 GROUP BY 1, 2",
}
