"""Literal rows through normalisers of exports, field severities, decoders and joins."""

import base64
import json

from pyspark.sql import functions as F

from duskwatch.operators import decode, exported, relate
from duskwatch.sources import exports


def rows(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "row_id long, value string")


def test_windows_rows(spark):
    payload = json.dumps({"EventData": {"Data": [{"@Name": "Image", "#text": "C:\\x\\cmd.exe"}, {"@Name": "ProcessId", "#text": "0x1f"}]}})
    value = json.dumps({"EventId": "1", "Channel": "Microsoft-Windows-Sysmon/Operational", "Payload": payload, "PayloadData1": "User: bob, LogonType: 3"})
    got = exports.norm_winevent_rows(rows(spark, value, "no json", None)).orderBy("row_id").collect()
    assert (got[0].event_type, got[0].process_name, got[0].process_id, got[0].username, got[0].logon_type) == ("Sysmon_1_ProcessCreate", "C:\\x\\cmd.exe", 31, "bob", 3)
    assert [r.event_type for r in got[1:]] == ["WindowsEvent"] * 2


def test_windows_xml(spark):
    xml = '<Event><System><Provider Name="p"/><EventID>1102</EventID><Channel>Security</Channel></System><UserData><LogFileCleared><SubjectUserName>eve</SubjectUserName></LogFileCleared></UserData></Event>'
    got = exports.norm_winevent_xml(rows(spark, xml)).first()
    assert (got.event_type, got.event_id, got.username) == ("Security", "1102", "eve")


def test_payload_pairs(spark):
    got = rows(spark, "A: 1, B: x y", "MD5=ab,SHA1=cd", "free text", "", None).select("row_id", exports.kv_pairs(F.col("value")).alias("m")).orderBy("row_id").collect()
    assert [r.m for r in got] == [{"A": "1", "B": "x y"}, {"MD5": "ab", "SHA1": "cd"}, {"_unparsed": "free text"}, None, None]


def test_severities(spark):
    got = rows(spark, "MIMIKATZ.EXE-11.pf", "WHOAMI.EXE-A-22.pf").select(exported.prefetch_name(F.col("value")).alias("n"), exported.program_severity(F.col("value")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("MIMIKATZ.EXE", "high"), ("WHOAMI.EXE-A", "medium")]
    got = rows(spark, "HKLM\\Software\\Microsoft\\Windows\\CurrentVersion\\RunOnce\\x", "HKLM\\System\\Services\\y", "HKCU\\z").select(exported.registry_severity(F.col("value"))).collect()
    assert [r[0] for r in got] == ["medium", "low", "info"]


def test_base64_forms(spark):
    text = "net user bob /add and more"
    plain, wide = base64.b64encode(text.encode()).decode(), base64.b64encode(text.encode("utf-16-le")).decode()
    got = rows(spark, plain, plain[::-1], wide, "!!", None).select(decode.b64_forms(F.col("value")).alias("b")).collect()
    assert [(r.b.form, r.b.decoded) for r in got[:3]] == [("direct", text), ("reversed", text), ("wide", text)] and got[3].b is None and got[4].b is None


def test_best_decoding(spark):
    twice = base64.b64encode(base64.b64encode(b"whoami /priv and so on")).decode()
    got = rows(spark, twice, "\\x77\\x68\\x6f\\x61\\x6d\\x69", '"who" + "ami"', "plain").select(exported.best_decoding(F.col("value"))).collect()
    assert [r[0] for r in got] == ["whoami /priv and so on", "whoami", "whoami", None]


def test_xor_finds_key_and_text(spark):
    text = b"attack at dawn, bring the usual tools"
    data = [(k, bytearray(b ^ k for b in text)) for k in (1, 0x5A, 0xFF)] + [(300, bytearray()), (301, None)]
    got = {r.id: r for r in decode.xor_bruteforce(spark.createDataFrame(data, "id long, data binary"), "id", "data").collect()}
    assert set(got) == {1, 0x5A, 0xFF}
    for k, r in got.items():
        shares = [sum(32 <= c < 127 or c in (9, 10, 13) for c in (b ^ j ^ k for b in text)) / len(text) for j in range(256)]
        assert r.share == max(shares) and r.byte == shares.index(max(shares)) and r.text == bytes(b ^ k ^ r.byte for b in text).decode("latin-1")


def test_bursts_pass_midnight(spark):
    at = ["2024-01-01 23:59:50", "2024-01-02 00:00:05", "2024-01-02 00:00:20", "2024-01-02 00:01:00", "2024-01-02 00:05:00", "2024-01-02 00:05:59", "2024-01-02 00:06:00"]
    hits = spark.createDataFrame([("h", t) for t in at], "source_system string, t string").withColumn("timestamp_utc", F.to_timestamp("t"))
    got = sorted((str(r.start)[11:19], r.n) for r in relate.bursts(hits).collect())
    assert got == [("00:05:00", 3), ("23:59:50", 3)]


def test_lineage_and_links(spark):
    found = spark.createDataFrame([(1, "evil"), (2, "zz"), (3, "")], "id long, value string")
    files = spark.createDataFrame([(7, "C:\\x\\EVIL.exe"), (9, "C:\\evil2")], "other_id long, file_path string")
    assert [tuple(r) for r in exported.lineage_file(found, files).collect()] == [(1, 7, "C:\\x\\EVIL.exe")]
    at = lambda df, c: df.withColumn(c, F.timestamp_seconds(c))
    written = at(spark.createDataFrame([(1, "h", 10, "C:\\t\\A.exe"), (2, "h", 50, "C:\\a.exe")], "id long, host string, ts long, file_path string"), "ts")
    starts = at(spark.createDataFrame([(5, "h", 10, "a.exe"), (6, "h", 30, "a.exe"), (7, "h", 40, "a.exe")], "other_id long, host string, other_ts long, image string"), "other_ts")
    assert [tuple(r) for r in exported.file_exec_link(written, starts).collect()] == [(1, 6, "a.exe")]


def test_exploits_need_a_reader(spark):
    kind = "row_id long, process_name string, event_type string, raw_payload string"
    hit = (1, "x.exe", "Memory_strings_ioc", json.dumps({"value": "this.media.newPlayer(null)", "context": ""}))
    assert exported.exploit_cve(spark.createDataFrame([hit], kind)).count() == 0
    with_reader = spark.createDataFrame([hit, (2, "AcroRd32.exe", "other", "{}")], kind)
    assert [r.cve for r in exported.exploit_cve(with_reader).collect()] == ["CVE-2009-4324"]


def test_gaps_in_coverage(spark):
    assert [r.gap for r in exported.coverage_gaps({"none": spark.range(0), "some": spark.range(3)}).collect()] == ["none"]
