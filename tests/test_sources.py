import hashlib

import pytest
from pyspark.sql import functions as F

from duskwatch.schema import EVENT_SCHEMA
from duskwatch.sources import io, normalize


def test_round_trip_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("a.log", 1, "x", "77")], "source_file string, source_line long, event_type string, process_id string")
    io.sink_events(df, str(tmp_path / "ev"))
    back = io.scan_events(spark, str(tmp_path / "ev"))
    assert back.columns == [*EVENT_SCHEMA.names, "_source_parquet"]
    assert back.first().process_id == 77
    known = io.manifest(spark, str(tmp_path / "ev"))
    assert io.verify_manifest(known, known).isEmpty()
    changed = known.withColumn("sha256", F.lit("0"))
    assert io.verify_manifest(changed, known).count() == known.count()
    assert io.verify_manifest(known, known.limit(0)).first().state == "missing"
    assert io.verify_manifest(known.limit(0), known).where("state <> 'added'").isEmpty()


def test_csv_and_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Time,User\n2024-01-01,bob\n")
    got = normalize.norm_csv(spark, str(tmp_path / "a.csv"), {"username": ["user"], "event_type": ["type"]}).first()
    assert (got.username, got.event_type) == ("bob", None) and "2024" in got.raw_payload
    lines = spark.createDataFrame([(1, "<34>1 2024-05-01T10:00:00Z web sshd 12 - - Failed password for root from 1.2.3.4 port 22"), (2, "junk")], "row_id long, value string")
    got = normalize.norm_syslog(lines, 2024).collect()
    assert len(got) == 1 and got[0].username == "root" and got[0].source_port == 22
    assert normalize.rejects(lines, "^<").first().value == "junk"


def test_manifest(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name, text in (("x.log", "one"), ("a/x.log", "two"), ("a/b/y", ""), ("a/big", "z" * 50)):
        (tmp_path / name).write_text(text)
    files = io.manifest(spark, str(tmp_path), largest=40)
    got = {r.path: (r.size, r.sha256) for r in files.collect()}
    assert got == {n: (len(t), hashlib.sha256(t.encode()).hexdigest() if len(t) <= 40 else None) for n, t in (("x.log", "one"), ("a/x.log", "two"), ("a/big", "z" * 50))}
    known = spark.createDataFrame([("x.log", 3, got["a/x.log"][1]), ("a/x.log", 3, got["a/x.log"][1]), ("gone", 1, "0"), ("a/big", 49, None), ("a/b/y", 0, None)], "path string, size long, sha256 string")
    assert sorted(tuple(r) for r in io.verify_manifest(known, files).collect()) == [("a/b/y", "missing"), ("a/big", "changed"), ("gone", "missing"), ("x.log", "changed")]


def test_long_files(spark, tmp_path):
    size = (1 << 30) + 1
    with open(tmp_path / "long", "wb") as f:
        f.truncate(size)
    sha, rest = hashlib.sha256(), size
    while rest:
        sha.update(bytes(step := min(rest, 1 << 20)))
        rest -= step
    (tmp_path / "short").write_text("one")
    files = io.manifest(spark, str(tmp_path))
    assert sorted((r.path, r.size, r.sha256) for r in files.collect()) == [("long", size, sha.hexdigest()), ("short", 3, hashlib.sha256(b"one").hexdigest())]
    known = files.withColumn("sha256", F.when(F.col("path") == "long", "0").otherwise(F.col("sha256")))
    assert [tuple(r) for r in io.verify_manifest(known, files).collect()] == [("long", "changed")]


def test_pieces_of_any_store(spark, tmp_path):
    names = ["plain", "a b%20.gz", "we[i]rd {a,b}*?\\x", "sub/ünder.log"]
    (tmp_path / "sub").mkdir()
    for i, name in enumerate(names):
        (tmp_path / name).write_bytes(bytes(range(256)) * (8000 * i + 1))
    want = {n: ((8000 * i + 1) * 256, hashlib.sha256(bytes(range(256)) * (8000 * i + 1)).hexdigest()) for i, n in enumerate(names)}
    spark._jsc.sc().hadoopConfiguration().set("fs.viewfs.mounttable.pieces.link./in", f"file://{tmp_path}")
    for path in (str(tmp_path), f"file://{tmp_path}", "viewfs://pieces/in"):
        for whole in (0, 5000):
            assert {r.path: (r.size, r.sha256) for r in io.manifest(spark, path, whole=whole).collect()} == want, (path, whole)
    assert sorted(io.manifest(spark, str(tmp_path), whole=0).collect()) == sorted(io.manifest(spark, str(tmp_path)).collect())
    assert {r.path: r.sha256 is None for r in io.manifest(spark, str(tmp_path), largest=3_000_000, whole=0).collect()} == {n: i > 1 for i, n in enumerate(names)}
    with pytest.raises(OSError, match="too early"):
        io._digest(iter([b"ab"]), 3)
    assert io._digest(iter([b"ab", b"cd"]), 3) == hashlib.sha256(b"abc").hexdigest()


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("ipv4", "1.2.3.4", 80), ("url", "http://x/,\"q\"", 10)], "kind string, value string, score int")
    io.sink_ioc_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", "true").option("escape", "\\").csv(str(tmp_path / "csv" / "all"))
    assert sorted((r.kind, r.value) for r in back.collect()) == [("ipv4", "1.2.3.4"), ("url", 'http://x/,"q"')]
    assert [r.value for r in spark.read.option("header", "true").csv(str(tmp_path / "csv" / "high")).collect()] == ["1.2.3.4"]
    io.sink_json(rows, str(tmp_path / "json"))
    assert sorted(r.value for r in spark.read.json(str(tmp_path / "json")).collect()) == ["1.2.3.4", 'http://x/,"q"']
