"""JSON lines of unknown shape as events: known names are looked for at any depth."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..adapters import SEC, security_events
from ..functions import scalars as S
from ..functions.flatten import leaf_text
from ..store import stored

# Names of the time, at the top or in these objects, and of other fields at any depth, in the order in which they are taken.
TIMES = ["timestamp", "@timestamp", "time", "datetime", "date", "ts", "eventTime", "event_time", "created", "createdAt", "logged_at", "TimeCreated", "eventTimestamp"]
INSIDE = ["event", "data", "metadata"]
TYPES, INNER_TYPES = ["event_type", "eventType", "type", "action", "category"], ["type", "action", "category"]
NAMES = {
    "source_ip": ["source_ip", "src_ip", "srcip", "client_ip", "ip", "sourceAddress"], "dest_ip": ["dest_ip", "dst_ip", "dstip", "destination_ip", "destinationAddress"], "source_port": ["source_port", "src_port", "srcport"],
    "dest_port": ["dest_port", "dst_port", "dstport", "destination_port"], "username": ["user", "username", "user_name", "account", "principal"], "source_system": ["host", "hostname", "computer", "machine", "source_host"],
    "process_name": ["process", "process_name", "executable", "command"], "command_line": ["command_line", "cmdline", "args", "arguments"],
}
_NUMBERS = ("source_port", "dest_port")


def _time(text: Column) -> Column:
    """Seconds or, beyond 10^12, milliseconds since 1970, else a written time."""
    n = text.try_cast("decimal(20,6)")
    return F.when(n.isNotNull(), F.timestamp_micros((F.when(n > 10**12, n * 1000).otherwise(n * 1_000_000)).cast("bigint"))).otherwise(S.timestamp_of(text))


#: Levels of nesting that one pass over the rows takes; only rows with deeper objects go on to another pass.
LEVELS = 4
_MAP = "map<string,variant>"


def _first(m: Column, names: list[str], as_: Callable[[Column], Column]) -> Column:
    """The first of ``names`` whose text in the map ``m`` isn't empty and fits ``as_``."""
    texts = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.try_variant_get(F.try_element_at(m, n), "$", "string"))
    return F.get(F.filter(F.transform(F.filter(texts, lambda x: x != ""), as_), lambda x: x.isNotNull()), F.lit(0))


def _candidates(entry: Column) -> Column:
    """(field, place, depth, key, found) for each known name that a leaf has, alone or as a path joined by ``_``."""
    places = F.create_map(*[x for f, ns in NAMES.items() for i, n in enumerate(ns) for x in (F.lit(n), F.struct(F.lit(f).alias("field"), F.lit(i).alias("place")))])
    key = entry["key"]
    path, short, depth = F.replace(key, F.lit("."), F.lit("_")), F.substring_index(key, ".", -1), F.length(key) - F.length(F.replace(key, F.lit("."), F.lit("")))
    known = F.filter(F.transform(F.array_distinct(F.array(short, path)), lambda n: F.try_element_at(places, n)), lambda p: p.isNotNull())
    return F.transform(known, lambda p: F.struct(p["field"].alias("field"), p["place"].alias("place"), depth.alias("depth"), key.alias("key"), leaf_text(entry["v"]).alias("found")))


def _deeper(rows: DataFrame) -> DataFrame:
    """``rows`` with the objects of ``open`` taken apart: known leaves added to ``found``, objects in them left open."""
    inner = lambda o: F.transform(F.map_entries(o["m"]), lambda e: F.struct(F.concat_ws(".", o["key"], e["key"]).alias("key"), e["value"].alias("v"), F.try_variant_get(e["value"], "$", _MAP).alias("m")))
    rows = rows.withColumn("entries", F.flatten(F.transform("open", inner)))
    leaves = F.flatten(F.transform(F.filter("entries", lambda e: e["m"].isNull()), _candidates))
    objects = F.transform(F.filter("entries", lambda e: e["m"].isNotNull()), lambda e: F.struct(e["key"].alias("key"), e["m"].alias("m")))
    return rows.withColumns({"found": F.concat("found", F.filter(leaves, lambda c: c["found"] != "")), "open": objects}).drop("entries")


def _best(field: str) -> Column:
    return F.array_min(F.filter("found", lambda c: c["field"] == field))["found"]


def norm_jsonl(df: DataFrame) -> DataFrame:
    """Lines (row_id, value) that hold JSON objects, as events. Each line is parsed once and stays one row: its objects are
    taken apart level by level in place, and of its leaves only those with a known name, alone or as a path joined by ``_``, are
    kept, so nothing is exchanged. Of several the first name of the list counts, then the one least deep. A line that is no
    object has no time and so no row."""
    parsed = df.select("row_id", F.try_parse_json("value").alias("v"))
    maps = parsed.select("row_id", F.try_variant_get("v", "$", _MAP).alias("top"), *[F.try_variant_get("v", f"$['{i}']", _MAP).alias(i) for i in INSIDE])
    time = F.coalesce(*[_first(F.col(m), TIMES, _time) for m in ("top", *INSIDE)])
    kind = F.coalesce(_first(F.col("top"), TYPES, lambda x: x), _first(F.col("event"), INNER_TYPES, lambda x: x))
    rows = maps.select("row_id", time.alias("timestamp_utc"), F.concat_ws("_", F.lit("JSONL"), kind).alias("event_type"), F.col("top"))
    # a line without a time gets no row: nothing of it is taken apart
    rows = rows.select("row_id", "timestamp_utc", "event_type", F.when(F.col("timestamp_utc").isNotNull(), F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("top").alias("m")))).otherwise(F.array()).alias("open"), F.array().cast("array<struct<field:string,place:int,depth:int,key:string,found:string>>").alias("found"))
    done = []
    while True:
        for _ in range(LEVELS):
            rows = _deeper(rows)
        rows = stored(rows)
        done.append(rows.where("timestamp_utc IS NOT NULL AND size(open) = 0").drop("open"))
        rows = rows.where("size(open) > 0")
        if rows.isEmpty():
            break
    out = functools.reduce(DataFrame.unionByName, done)
    best = {f: _best(f) for f in NAMES}
    return out.select("row_id", "timestamp_utc", "event_type", *[(x.try_cast("bigint") if f in _NUMBERS else x).alias(f) for f, x in best.items()])


def lines(ev: DataFrame) -> DataFrame:
    """Four shapes of lines made from the test events, and one that is no object."""
    clock, c = F.date_format("timestamp_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col
    shapes = [
        F.to_json(F.struct(F.struct(clock.alias("createdAt"), c("event_type").alias("type")).alias("event"), c("username").alias("user"), F.struct(F.struct(c("source_ip").alias("ip"), c("dest_port").alias("dst_port")).alias("peer")).alias("net"))),
        F.to_json(F.struct(F.unix_millis("timestamp_utc").alias("ts"), c("event_type").alias("action"), F.struct(c("source_system").alias("name"), F.lit("x").alias("note")).alias("source"), F.struct(c("source_system").alias("host")).alias("source2"), c("command_line").alias("cmdline"))),
        F.to_json(F.struct(F.struct(F.unix_seconds("timestamp_utc").alias("eventTime")).alias("metadata"), F.struct(c("dest_ip").alias("ip")).alias("destination"), c("process_name").alias("executable"))),
        F.to_json(F.struct(F.lit("no time").alias("message"), c("username").alias("user"))),
        F.concat(F.lit("[1, "), c("row_id").cast("string"), F.lit("]")),
    ]
    return ev.select("row_id", F.element_at(F.array(*shapes), (F.col("row_id") % len(shapes) + 1).cast("int")).alias("value"))


def _case(**of: str) -> str:
    return "CASE row_id % 5 " + " ".join(f"WHEN {k[1:]} THEN {v}" for k, v in of.items()) + " END"


QUERIES = {"norm_jsonl": lambda s, d: norm_jsonl(lines(security_events(s, d)))}
ORACLES = {
    "norm_jsonl": f"WITH {SEC} SELECT row_id, CASE row_id % 5 WHEN 1 THEN date_trunc('millisecond', timestamp_utc) ELSE date_trunc('second', timestamp_utc) END AS timestamp_utc, 'JSONL' || CASE WHEN row_id % 5 < 2 THEN '_' || event_type ELSE '' END AS event_type, "
    f"{_case(_0='source_ip', _2='dest_ip')} AS source_ip, {_case(_2='dest_ip')} AS dest_ip, CAST(NULL AS BIGINT) AS source_port, {_case(_0='CAST(dest_port AS BIGINT)')} AS dest_port, {_case(_0='username')} AS username, {_case(_1='source_system')} AS source_system, "
    f"{_case(_2='process_name')} AS process_name, {_case(_1='command_line')} AS command_line FROM sec WHERE row_id % 5 < 3",
}
