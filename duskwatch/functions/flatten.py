"""Nested JSON texts as rows of dotted keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..adapters import SEC, security_events
from ..store import stored


def leaf_text(v: Column) -> Column:
    """A leaf as text: strings bare, lists joined by ``;``, other values as JSON writes them."""
    part = lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("null"))
    items = F.try_variant_get(v, "$", "array<variant>")
    return F.when(items.isNotNull(), F.array_join(F.transform(items, part), ";")).otherwise(F.try_variant_get(v, "$", "string"))


def flatten_json(df: DataFrame, text: str = "value") -> DataFrame:
    """The columns of ``df`` but ``text``, and (key, found) for each leaf of the object that ``text`` holds.

    Keys of nested objects are joined by dots, lists by ``;``; empty objects, texts that are no object or no JSON, and
    nulls give no rows. The keys need not be known: a frontier of objects is exploded level by level, and only objects
    go on to the next level, so a document of depth d takes part in d rounds.
    """
    spark = df.sparkSession
    others = [c for c in df.columns if c != text]
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    frontier = df.select(*others, F.lit(None).cast("string").alias("_path"), F.try_parse_json(text).alias("_v"))
    frontier = frontier.where(F.col("_v").isNotNull()).where(is_object(F.col("_v")))
    leaves = []
    while True:
        entries = frontier.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        level = entries.select(*others, F.concat_ws(".", "_path", "key").alias("_path"), F.col("value").alias("_v")).withColumn("_deeper", is_object(F.col("_v")))
        level = stored(level)
        leaves.append(level.where("NOT _deeper").select(*others, F.col("_path").alias("key"), leaf_text(F.col("_v")).alias("found")))
        frontier = level.where("_deeper").drop("_deeper")
        if frontier.isEmpty():
            break
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out


def payloads(ev: DataFrame) -> DataFrame:
    """JSON of five levels made from the test events; each fifth text is no object."""
    deep = F.struct(F.struct(F.struct(F.col("dest_ip").alias("ip"), F.col("dest_port").alias("port")).alias("to"), F.col("k").alias("k")).alias("net"), F.array(F.lit("a"), "service_name", F.lit("7")).alias("list"))
    user = F.struct(F.col("username").alias("name"), (F.col("k") % 2 == 0).alias("admin"))
    whole = F.to_json(F.struct(F.struct(deep.alias("deep"), user.alias("user")).alias("event"), F.col("value").cast("long").alias("amount"), F.array(F.struct(F.lit(1).alias("x"))).alias("objects")))
    text = F.when(F.col("row_id") % 5 == 0, F.concat(F.lit("not json "), "username")).when(F.col("row_id") % 5 == 1, F.concat(F.lit('{"only": "'), "username", F.lit('", "none": null, "empty": {}}'))).otherwise(whole)
    return ev.select("row_id", text.alias("value"))


_LEAVES = [
    ("event.deep.net.to.ip", "dest_ip"), ("event.deep.net.to.port", "CAST(dest_port AS VARCHAR)"), ("event.deep.net.k", "CAST(k AS VARCHAR)"), ("event.deep.list", "'a;' || service_name || ';7'"),
    ("event.user.name", "username"), ("event.user.admin", "CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END"), ("amount", "CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR)"), ("objects", "'{\"x\":1}'"),
]
QUERIES = {"json_flatten": lambda s, d: flatten_json(payloads(security_events(s, d)))}
ORACLES = {
    "json_flatten": f"WITH {SEC} SELECT row_id, 'only' AS key, username AS found FROM sec WHERE row_id % 5 = 1 UNION ALL SELECT row_id, 'none', NULL FROM sec WHERE row_id % 5 = 1"
    + "".join(f" UNION ALL SELECT row_id, '{k}', {v} FROM sec WHERE row_id % 5 > 1" for k, v in _LEAVES)
}
