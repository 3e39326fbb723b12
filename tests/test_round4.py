"""Findings of round 3: results by brute force, and that the work grows with the rows."""

import random

import pytest
from pyspark.sql import functions as F

from duskwatch.operators import relate

T0 = 1_704_067_200_000_000


def join_rows(df):
    """The rows that each join of a collected query gave."""
    found = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if "Join" in name:
            found.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.fixture(scope="module")
def crowd(spark):
    """Events of three hosts, many at equal times, some far away; every second one is a finding."""
    r = random.Random(5)
    rows = [(i, f"h{r.choice([0, 0, 0, 1, 2])}", T0 + r.choice([r.randrange(40) * 250_000, r.randrange(10**8), -r.randrange(7_000_000)])) for i in range(700)]
    rows += [(9_001, "h1", None), (9_002, None, T0)]
    ev = spark.createDataFrame(rows, "other_id long, host string, m long").select("other_id", "host", F.timestamp_micros("m").alias("other_ts"))
    hits = ev.where("other_id % 2 = 0").select(F.col("other_id").alias("id"), "host", F.col("other_ts").alias("ts"))
    return [x for x in rows if None not in x], hits, ev


def test_context_is_bounded(crowd):
    rows, hits, ev = crowd
    df = relate.context(hits, ev, 3, 4)
    got = sorted(map(tuple, df.collect()))
    want = []
    for i, h, t in (x for x in rows if x[0] % 2 == 0):
        for side in ("before", "after"):
            near = sorted((abs(u - t), j) for j, g, u in rows if g == h and j != i and abs(u - t) <= 3_000_000 and (u < t) == (side == "before"))
            want += [(i, side, j, n + 1) for n, (_, j) in enumerate(near[:4])]
    assert got == sorted(want)
    assert max(join_rows(df)) <= 350 * 2 * 5


def test_cross_system_is_bounded(crowd):
    rows, hits, ev = crowd
    df = relate.cross_system(hits, ev, 3, 4)
    got = sorted(map(tuple, df.collect()))
    want = []
    for i, h, t in (x for x in rows if x[0] % 2 == 0):
        near = sorted((abs(u - t), j) for j, g, u in rows if g != h and abs(u - t) <= 3_000_000)
        want += [(i, j) for _, j in near[:4]]
    assert got == sorted(want)
    assert max(join_rows(df)) <= 350 * 2 * 4


def test_nearest_is_bounded(crowd):
    rows, hits, ev = crowd
    df = relate.nearest(hits, ev, 3)
    got = sorted((r.id, r.host, r.other_id, r.delta) for r in df.collect())
    want = []
    for i, h, t in (x for x in rows if x[0] % 2 == 0):
        near = sorted((abs(u - t), j, u - t) for j, g, u in rows if g == h and abs(u - t) <= 3_000_000)
        want += [(i, h, near[0][1], round(near[0][2] / 1e6, 3))]
    assert got == sorted(want)
    assert max(join_rows(df)) <= 350 * 2


def test_base64_forms_are_decoded_once(spark):
    import base64

    from duskwatch.operators.decode import b64_forms

    text = "powershell -command whoami /all é"
    direct, wide = base64.b64encode(text.encode()).decode(), base64.b64encode(text.encode("utf-16-le")).decode()
    df = spark.createDataFrame([(0, direct), (1, direct[::-1]), (2, wide), (3, "no base64"), (4, None), (5, base64.b64encode(b"a\x01bcdef").decode())], "i int, t string").select("i", b64_forms(F.col("t")).alias("b"))
    got = {r.i: (r.b.form, r.b.decoded, r.b.share) if r.b else None for r in df.collect()}
    assert got[0] == ("direct", text, 1.0) and got[1] == ("reversed", text, 1.0) and got[2] == ("wide", text, 1.0)
    assert got[3] is None and got[4] is None and got[5] == ("direct", "a\x01bcdef", 6 / 7)
    assert df._jdf.queryExecution().analyzed().toString().count("try_to_binary") == 3


def test_entropy_of_many_characters(spark):
    import math
    import time

    from duskwatch.functions.scalars import entropy

    many = "".join(chr(0x3400 + i) for i in range(0x5000))
    df = spark.createDataFrame([(0, many), (1, "aab"), (2, ""), (3, None), (4, "a\U0001f600"), (5, "bbbb")], "i int, t string")
    began = time.time()
    got = {r.i: r.e for r in df.select("i", entropy(F.col("t")).alias("e")).collect()}
    assert time.time() - began < 30
    third = -(1 / 3 * math.log2(1 / 3) + 2 / 3 * math.log2(2 / 3))
    assert [round(got[i], 9) for i in range(6)] == [round(math.log2(0x5000), 9), round(third, 9), 0, 0, 1, 0]


def test_indicator_table_searches_each_text_once(spark):
    from duskwatch.operators.indicators import ioc_table

    fields = ["command_line", "uri", "file_path"]
    rows = [(T0 + i, f"u{i % 90}", "cmd.exe" if i % 7 == 0 else f"p{i % 11}.exe", "get http://198.51.100.7/a", "/x?h=198.51.100.7", "198.51.100.7" if i % 2 else "") for i in range(900)]
    ev = spark.createDataFrame(rows, "m long, username string, process_name string, command_line string, uri string, file_path string").withColumn("timestamp_utc", F.timestamp_micros("m"))
    df = ioc_table(ev, fields)
    got = {(r.kind, r.value): (r.sources, r.named, r.users, r.processes, r.risk) for r in df.collect()}
    assert got == {("ipv4", "198.51.100.7"): (3, "command_line,file_path,uri", 90, 12, "CRITICAL"), ("url", "http://198.51.100.7/a"): (1, "command_line", 90, 12, "HIGH")}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "username" not in next(line for line in plan.splitlines() if "Generate explode(flatten" in line)


def test_payloads_are_parsed_once(spark):
    from duskwatch.sources import exports

    plan = exports.QUERIES["payload_normalize"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") + plan.count("jsontostructs") <= 4


def test_package_rows_are_made_once(spark):
    from duskwatch.operators.packages import bounded

    rows = spark.range(300).select(F.lit("p").alias("package"), F.lit("s").alias("source"), F.format_string("%05d", "id").alias("text"))
    df = bounded(rows, most=10, keep=5)
    assert sorted(r.text for r in df.collect()) == [f"{i:05d}" for i in range(5)]
    assert "Range (" not in df._jdf.queryExecution().optimizedPlan().toString()
