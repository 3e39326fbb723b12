"""Claims held against the events: entities, quotes, sets of references; and references between hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import SEC, security_events, table
from .search import found_in

#: Fields of an event that quotes are looked for in.
TEXTS = ["username", "source_ip", "dest_ip", "process_name", "parent_process_name", "command_line", "uri", "query_string", "user_agent", "service_name", "registry_key", "file_path", "source_file"]
QUOTES, SHORTEST = 5, 5


def entities_of(ev: DataFrame) -> DataFrame:
    """(kind, value) of what the events name, each once: hosts, users, processes and files in lower case, addresses as they are."""
    own = {"host": F.lower("source_system"), "user": F.lower("username"), "process": F.lower("process_name"), "file": F.lower("file_path"), "ip": F.col("source_ip"), "ip2": F.col("dest_ip")}
    rows = ev.select(F.explode(F.array(*[F.struct(F.lit(k.rstrip("2")).alias("kind"), c.alias("value")) for k, c in own.items()])).alias("e")).select("e.*")
    return rows.where("value <> ''").distinct()


def check_entities(claims: DataFrame, known: DataFrame) -> DataFrame:
    """(claim_id, entity, found) for each of a claim's ``affected_entities``: whether it is a host, user, process or
    address of the events, or part of a file's name."""
    asked = claims.select("claim_id", F.explode("affected_entities").alias("entity")).where("entity IS NOT NULL").distinct()
    named = asked.select("entity").distinct()
    same = known.where("kind <> 'file'").select("kind", "value")
    equal = named.join(same.where("kind = 'ip'").select(F.col("value").alias("entity")), "entity", "left_semi").union(named.join(same.where("kind <> 'ip'").select("value").distinct(), F.lower("entity") == F.col("value"), "left_semi"))
    files = found_in(named.join(equal, "entity", "left_anti").select(F.col("entity").alias("value")), known.where("kind = 'file'").select(F.col("value").alias("text"))).select(F.col("value").alias("entity"))
    hit = equal.union(files).distinct().withColumn("found", F.lit(True))
    return asked.join(hit, "entity", "left").select("claim_id", "entity", F.coalesce("found", F.lit(False)).alias("found"))


def check_quotes(claims: DataFrame, ev: DataFrame, most: int = QUOTES) -> DataFrame:
    """(claim_id, place, quote, found) for the first quotes in ``supporting_evidence``, those in double quotes before
    those in single ones; quotes under five characters take a place but are not looked for."""
    quotes = F.concat(F.regexp_extract_all("supporting_evidence", F.lit('"([^"]+)"'), F.lit(1)), F.regexp_extract_all("supporting_evidence", F.lit("'([^']+)'"), F.lit(1)))
    asked = claims.select("claim_id", F.posexplode(F.slice(quotes, 1, most)).alias("place", "quote")).where(F.length("quote") >= SHORTEST)
    texts = ev.select(F.explode(F.array_distinct(F.array(*TEXTS))).alias("text"))
    hit = found_in(asked.select(F.col("quote").alias("value")), texts).select(F.col("value").alias("quote"), F.lit(True).alias("found")).distinct()
    return asked.join(hit, "quote", "left").select("claim_id", (F.col("place") + 1).cast("long").alias("place"), "quote", F.coalesce("found", F.lit(False)).alias("found"))


def duplicates(claims: DataFrame) -> DataFrame:
    """(claim_id, first, n) of claims that share their set of references with others, whatever its order and repeats:
    the least claim of the group stands for it, so no pairs are formed. Claims without references have no duplicates."""
    refs = F.array_sort(F.array_distinct(F.transform("raw_evidence_refs", lambda r: F.to_json(r))))
    own = claims.where(F.size("raw_evidence_refs") > 0).select("claim_id", F.sha2(F.to_json(F.struct(refs.alias("r"))), 256).alias("refs"))
    groups = own.groupBy("refs").agg(F.min("claim_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return own.join(groups, "refs").select("claim_id", "first", "n")


def host_references(ev: DataFrame) -> DataFrame:
    """(source_system, target, kind, n): events of one host that reach for another: its address as their destination,
    else its name in their command.

    Events are counted by host, address and command before any join, and hosts are looked for in distinct commands.
    """
    own = ev.where("source_system IS NOT NULL").groupBy("source_system", "dest_ip", "command_line").agg(F.count("*").alias("n"))
    seen = ev.select(F.col("source_system").alias("target"), F.explode(F.array("source_ip", "dest_ip")).alias("dest_ip")).where("target IS NOT NULL AND dest_ip IS NOT NULL").distinct()
    by_address = own.groupBy("source_system", "dest_ip").agg(F.sum("n").alias("n")).join(seen, "dest_ip").where("source_system <> target").groupBy("source_system", "target").agg(F.sum("n").alias("n"))
    named = found_in(ev.select(F.col("source_system").alias("value")), ev.select(F.col("command_line").alias("text"))).select(F.col("value").alias("target"), F.col("text").alias("command_line"))
    by_name = own.join(named, "command_line").where("source_system <> target").join(seen, ["target", "dest_ip"], "left_anti").groupBy("source_system", "target").agg(F.sum("n").alias("n"))
    kinds = [by_address.withColumn("kind", F.lit("network_connection")), by_name.withColumn("kind", F.lit("command_reference"))]
    return kinds[0].unionByName(kinds[1]).select("source_system", "target", "kind", "n")


def claims(s, d) -> DataFrame:
    """Claims made from orders, with lists of entities, quotes in their evidence and references in any order."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    text = lambda x: x.cast("string")
    ref = lambda n: F.struct(F.concat(F.lit("log"), text(n), F.lit(".parquet")).alias("file"), F.lit("all").alias("filter"))
    refs = F.when(k % 2 == 0, F.array(ref(c % 7), ref(c % 5), ref(c % 7))).otherwise(F.array(ref(c % 5), ref(c % 7)))
    quoted = F.concat(F.lit("He ran 'HOAMI /a' and \"all\" then \"user"), text(c % 300), F.lit("\" \"\\Temp\\ev\" \"never seen "), text(k % 10), F.lit("\" \"a.exe a.exe\" \"further\" \"too late\""))
    return table(s, d, "orders").select(
        k.alias("claim_id"),
        F.array(F.concat(F.lit("User"), text(c % 200)), F.concat(F.lit("HOST"), text(c % 9)), F.concat(F.lit("10.0.0."), text(c % 30)), F.concat(F.lit("ublic\\"), F.when(k % 2 == 0, "X.").otherwise("y.")), F.lit("CMD.EXE")).alias("affected_entities"),
        F.when(k % 11 != 0, refs).otherwise(F.array().cast("array<struct<file:string,filter:string>>")).alias("raw_evidence_refs"),
        quoted.alias("supporting_evidence"),
    )


def crossing_events(s, d) -> DataFrame:
    """Test events of which some reach for other hosts by address or by name."""
    ev = security_events(s, d)
    host = F.concat(F.lit("\\\\HOST"), (F.col("k") % 9).cast("string"))
    dest = F.when(F.col("k") % 3 == 0, F.concat(F.lit("10.0.0."), (F.col("k") % 20).cast("string"))).when(F.col("k") % 3 == 1, F.concat(F.lit("172.16.0."), (F.col("user_id") % 7).cast("string")))
    return ev.withColumns({"dest_ip": dest, "command_line": F.when(F.col("row_id") % 4 == 0, F.concat("command_line", F.lit(" "), host)).otherwise(F.col("command_line"))})


_CLAIMS = (
    "c AS (SELECT o_orderkey AS claim_id, o_custkey AS c, o_orderkey AS k, ['User' || o_custkey % 200, 'HOST' || o_custkey % 9, '10.0.0.' || o_custkey % 30, 'ublic\\' || CASE WHEN o_orderkey % 2 = 0 THEN 'X.' ELSE 'y.' END, 'CMD.EXE'] AS es FROM orders)"
)
_QUOTE = "unnest([(2, 'user' || c % 300), (3, '\\Temp\\ev'), (4, 'never seen ' || k % 10), (5, 'a.exe a.exe')])"
_CROSS = (
    SEC.replace("sec AS", "sec0 AS", 1)
    + ", sec AS (SELECT * REPLACE (CASE k % 3 WHEN 0 THEN '10.0.0.' || k % 20 WHEN 1 THEN '172.16.0.' || user_id % 7 END AS dest_ip, CASE WHEN row_id % 4 = 0 THEN command_line || ' \\\\HOST' || k % 9 ELSE command_line END AS command_line) FROM sec0)"
)

QUERIES = {
    "claim_entities": lambda s, d: check_entities(claims(s, d), entities_of(security_events(s, d))),
    "claim_quotes": lambda s, d: check_quotes(claims(s, d), security_events(s, d)),
    "claim_duplicates": lambda s, d: duplicates(claims(s, d)),
    "xsys_refs": lambda s, d: host_references(crossing_events(s, d)),
}
ORACLES = {
    "claim_entities": f"WITH {SEC}, {_CLAIMS}, x AS (SELECT claim_id, unnest(es) AS entity FROM c), "
    "known AS (SELECT lower(source_system) AS v FROM sec UNION SELECT lower(username) FROM sec UNION SELECT lower(process_name) FROM sec), ip AS (SELECT source_ip AS v FROM sec UNION SELECT dest_ip FROM sec), fl AS (SELECT DISTINCT lower(file_path) AS v FROM sec), "
    "e AS (SELECT DISTINCT entity FROM x), y AS (SELECT entity, lower(entity) IN (SELECT v FROM known) OR entity IN (SELECT v FROM ip) OR EXISTS (SELECT 1 FROM fl WHERE contains(fl.v, lower(entity))) AS found FROM e) SELECT claim_id, entity, found FROM x JOIN y USING (entity)",
    "claim_quotes": f"WITH {SEC}, {_CLAIMS}, q AS (SELECT claim_id, {_QUOTE} AS q FROM c), u AS (SELECT DISTINCT q[2] AS quote FROM q), "
    f"t AS (SELECT DISTINCT lower(v) AS v FROM (SELECT unnest([{', '.join(TEXTS)}]) AS v FROM sec)), f AS (SELECT quote, EXISTS (SELECT 1 FROM t WHERE contains(t.v, lower(quote))) AS found FROM u) SELECT claim_id, CAST(q[1] AS BIGINT) AS place, quote, found FROM q JOIN f ON quote = q[2]",
    "claim_duplicates": f"WITH {_CLAIMS}, r AS (SELECT claim_id, least(c % 7, c % 5) || '-' || greatest(c % 7, c % 5) AS r FROM c WHERE k % 11 <> 0), g AS (SELECT r, min(claim_id) AS first, count(*) AS n FROM r GROUP BY 1 HAVING count(*) > 1) SELECT claim_id, first, n FROM r JOIN g USING (r)",
    "xsys_refs": f"WITH {_CROSS}, s AS (SELECT DISTINCT source_system AS target, source_ip AS ip FROM sec UNION SELECT DISTINCT source_system, dest_ip FROM sec WHERE dest_ip IS NOT NULL), h AS (SELECT DISTINCT source_system AS target FROM sec), "
    "p AS (SELECT row_id, source_system, h.target, EXISTS (SELECT 1 FROM s WHERE s.target = h.target AND s.ip = dest_ip) AS net, contains(lower(command_line), lower(h.target)) AS cmd FROM sec JOIN h ON source_system <> h.target) "
    "SELECT source_system, target, CASE WHEN net THEN 'network_connection' ELSE 'command_reference' END AS kind, count(*) AS n FROM p WHERE net OR cmd GROUP BY 1, 2, 3",
}
