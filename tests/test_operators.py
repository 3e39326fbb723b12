"""Literal rows, and plans without nested loops."""

from pyspark.sql import functions as F

from duskwatch.functions import scalars as S
from duskwatch.operators import aggregate, decode, detect, relate


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col(F.col("x"))).first()[0]


def test_scalars(spark):
    assert one(spark, S.logon_type_name, 10, "int") == "RemoteInteractive"
    assert one(spark, S.logon_type_name, 77, "int") == "Unknown(77)"
    for ip, kind in {"127.0.0.1": "LOOPBACK", "172.31.9.9": "INTERNAL", "172.32.0.1": "EXTERNAL", "169.254.1.1": "LINK_LOCAL", "0.0.0.0": "UNSPECIFIED", "300.1.1.1": "UNKNOWN", "::1": "LOOPBACK", "fd00::1": "INTERNAL", "x": "UNKNOWN"}.items():
        assert one(spark, S.ip_class, ip) == kind, ip
    assert one(spark, S.user_class, "CORP\\svc_sql") == "SERVICE"
    assert abs(one(spark, S.entropy, "aabb") - 1.0) < 1e-9
    assert one(spark, S.entropy, None) == 0.0


def test_decoders(spark):
    assert one(spark, decode.b64_decode, "d2hvYW1p") == "whoami"
    assert one(spark, decode.b64_decode, "d2hvYQ") == "whoa"
    assert bytes(one(spark, decode.hex_decode, "4D_5A_90_00")) == b"MZ\x90\x00"
    assert one(spark, decode.strip_fillers, "po`wer`sh`ell") == "powershell"
    assert one(spark, decode.concat_eval, '"Down" + "load" + "String"') == "DownloadString"
    assert one(spark, decode.url_decode_n, "a%252Bb+c") == "a+b+c"
    assert one(spark, decode.url_decode_n, "50%zz") == "50%zz"
    assert decode.expand_batch_variables("set a=hello\n%a:~1,3%%a:~-2%") == "set a=hello\nelllo"


def test_xor(spark):
    text = b"attack at dawn, bring the usual tools " * 3
    data = bytes(b ^ 0x5A for b in text)
    got = decode.xor_bruteforce(spark.createDataFrame([(1, bytearray(data))], "id long, data binary"), "id", "data").first()
    assert got.share > 0.7


def test_joins_have_no_nested_loop(spark):
    left = spark.range(100).select(F.col("id"), F.lit("h").alias("host"), F.timestamp_seconds(F.col("id") * 10).alias("ts"))
    right = left.select(F.col("id").alias("other_id"), "host", F.col("ts").alias("other_ts"))
    j = relate.interval_join(left, right, ["host"], "ts", "other_ts", 25, 10)
    want = sum(1 for a in range(100) for b in range(100) if -25 <= 10 * (b - a) <= 10)
    assert j.count() == want
    assert "NestedLoop" not in j._jdf.queryExecution().toString()


def test_any_near_forms_no_pairs(spark):
    rows = [0, 2_000_000, 5_000_000, 5_000_001, 9_999_999, 12_000_000, 12_000_001, -1, -2_000_001]
    others = [0, 7_000_000, 10_000_000, 10_000_000] * 50
    frame = lambda values: spark.createDataFrame([(v,) for v in values], "m long")
    got = relate.any_near(frame(rows), frame(others), 2)
    assert sorted(r.m for r in got.collect()) == sorted(m for m in rows if any(abs(m - o) <= 2_000_000 for o in others))
    assert got.count() == 7  # each row once, however many others are near


def test_sessions_keep_all_events_and_exact_gap(spark):
    rows = [(1, "a", "u", 0), (2, "a", "u", 1800), (3, "a", "u", 3601), (4, "a", "u", 9000)]
    ev = spark.createDataFrame(rows, "row_id long, source_system string, username string, t long").withColumn("timestamp_utc", F.timestamp_seconds("t"))
    got = {r.row_id: r.session for r in relate.sessions(ev, ["source_system", "username"]).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 3}


def test_forest_is_acyclic_and_complete(spark):
    nodes = spark.range(7)
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 6)], "child_id long, parent_id long")
    got = {r.id: (r.root, r.depth) for r in relate.forest(edges, nodes).collect()}
    assert got == {**{i: (0, i) for i in range(6)}, 6: (6, 0)}


def test_beacon_and_scan(spark):
    ev = spark.range(20).select(F.col("id").alias("row_id"), F.lit("a").alias("source_ip"), F.lit("b").alias("dest_ip"), F.col("id").alias("dest_port"), F.timestamp_seconds(F.col("id") * 60 + F.col("id") % 2).alias("timestamp_utc"))
    assert aggregate.beacons(ev, ["source_ip", "dest_ip"], 5, 4, 0.1, 10).count() == 1
    assert aggregate.port_scan(ev, 15).count() == 1


def test_rules(spark):
    ev = spark.createDataFrame([(1, "C:\\Windows\\System32\\certutil.exe", "certutil -urlcache x"), (2, "notepad.exe", None)], "row_id long, process_name string, command_line string")
    assert [tuple(r) for r in detect.lolbins(ev).collect()] == [(1, "certutil.exe", "-urlcache", "HIGH", "T1140")]
    assert detect.rule_scan(ev, [("r", "urlcache", ["command_line"], "HIGH", "T1")]).count() == 1
