"""Headers inside files, flattened JSON, process paths and bursts against literal rows and plain loops."""

import datetime
import random

from pyspark.sql import functions as F

from duskwatch.functions import flatten
from duskwatch.operators import claims, detect, journal, layers, processes, relate, search
from duskwatch.sources import headers

UTC = datetime.timezone.utc


def at(micros):
    return datetime.datetime.fromtimestamp(0, UTC) + datetime.timedelta(microseconds=micros)


def test_headers_of_files(spark, tmp_path):
    (tmp_path / "SRV9_u_ex24.log").write_text(
        "2024-01-01 00:00:00 before any header\n#Software: x\n#Fields: date time c-ip cs-uri-stem cs(User-Agent) sc-status\n"
        '2024-01-01 00:00:01 1.2.3.4 /a "my agent 1" 404\n2024-01-01 00:00:02 1.2.3.4  - 200\n\nno time here at all x\n'
        "#Fields: date time sc-status cs-uri-query cs-uri-stem\n2024-01-01 00:00:03 500 q=union%20select /b\n2024-01-01 00:00:04 200 q=cmd.exe /c extra cells\n2024-01-01 00:00:05\n"
    )
    (tmp_path / "u_ex25.log").write_text("#Fields: date time cs-uri-stem\n" + "".join(f"2024-01-01 00:00:{i:02d} /p{i}\n" for i in range(60)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")  # files are read in many splits
    try:
        lines = headers.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 3
        numbered = {(r.file.split("/")[-1], r.line_no): r.value for r in lines.collect()}
        for size in (2, 5, 1000):
            got = {(r.source_file.split("/")[-1], r.source_line): r for r in headers.norm_iis(lines, size).collect()}
            own = {n: r for (f, n), r in got.items() if f.startswith("SRV9")}
            assert sorted(own) == [4, 5, 9, 10, 11] and {r.source_system for r in own.values()} == {"SRV9"}
            assert (own[4].user_agent, own[4].status_code, own[4].severity, own[4].source_ip) == ("my agent 1", 404, "low", "1.2.3.4")
            assert (own[5].uri, own[5].user_agent, own[5].status_code) == (None, None, 200)
            assert (own[9].severity, own[9].source_ip, own[9].uri) == ("medium", None, "/b")
            assert (own[10].severity, own[10].query_string, own[11].status_code) == ("high", "q=cmd.exe", None)
            rest = {n: r.uri for (f, n), r in got.items() if f.startswith("u_")}
            assert rest == {i + 2: f"/p{i}" for i in range(60)} and {r.source_system for (f, _), r in got.items() if f.startswith("u_")} == {"WEBSERVER"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for f in tmp_path.iterdir():
        assert [numbered[f.name, i + 1] for i in range(len(f.read_text().splitlines()))] == f.read_text().splitlines()


def test_flatten(spark):
    rows = [(1, '{"a":{"b":{"c":{"d":{"e":5}}}},"l":[1,"x",null,{"k":2}],"n":null,"t":true,"s":"plain","o":{}}'), (2, "[1,2]"), (3, "junk"), (4, None), (5, '{"a.b":1,"x":[]}')]
    got = {(r.id, r.key): r.found for r in flatten.flatten_json(spark.createDataFrame(rows, "id long, value string")).collect()}
    assert got == {(1, "a.b.c.d.e"): "5", (1, "l"): '1;x;null;{"k":2}', (1, "n"): None, (1, "t"): "true", (1, "s"): "plain", (5, "a.b"): "1", (5, "x"): ""}


def event(i, pid, ppid, name, parent=None, command="", code=1, host="h"):
    return (i, host, datetime.datetime(2024, 1, 1, 0, 0, 0, tzinfo=UTC) + datetime.timedelta(seconds=10 * i), pid, ppid, code, name, parent, command, "u")


EVENT = "row_id long, source_system string, timestamp_utc timestamp, process_id long, parent_process_id long, event_code int, process_name string, parent_process_name string, command_line string, username string"


def test_process_paths(spark):
    rows = [
        event(1, 10, 1, "firefox.exe", "explorer.exe"),
        event(2, 11, 10, "AcroRd32.exe"),  # the parent's name comes from the forest
        event(3, 12, 11, "helper.exe"),
        event(4, 13, 12, "cmd.exe"),
        event(5, 14, 13, "whoami.exe"),
        event(6, 15, 1, "cmd.exe", "explorer.exe"),  # a shell outside any chain
        event(7, 16, 15, "whoami.exe"),
        event(8, 20, 2, "svchost.exe", "cmd.exe"),
        event(9, 21, 2, "svchost.exe", "services.exe"),
        event(10, 22, 3, "lsass.exe", "explorer.exe"),
        event(11, 23, 4, "calc.exe", "w3wp.exe", "procdump -ma 1"),
    ]
    got = {}
    for r in processes.process_findings(spark.createDataFrame(rows, EVENT)).collect():
        got.setdefault(r.id, set()).add(r.kind)
    assert got == {2: {"exploit"}, 3: {"exploit_descendant"}, 4: {"exploit_shell"}, 5: {"exploit_shell"}, 8: {"masquerading"}, 9: {"services_child"}, 10: {"masquerading", "credential"}, 11: {"w3wp_child", "credential"}}


def test_long_path(spark):
    """A path of 300 starts: the state at its end depends on its first two."""
    rows = [event(1, 1, 0, "winword.exe", "explorer.exe"), *[event(i, i, i - 1, "x.exe") for i in range(2, 300)], event(300, 300, 299, "cmd.exe")]
    got = {r.id: r.kind for r in processes.process_findings(spark.createDataFrame(rows, EVENT)).collect()}
    assert got[1] == "exploit" and got[300] == "exploit_shell" and all(got[i] == "exploit_descendant" for i in range(2, 300))


def greedy(times, width):
    out, start = [], None
    for t in sorted(times):
        if start is None or t - start > width:
            start, first = t, True
            out.append([t, t, 0])
        out[-1][1] = t
        out[-1][2] += 1
    return out


def test_bursts(spark):
    rng = random.Random(2)
    hits = {"a": [rng.randrange(0, 3_000_000_000) for _ in range(300)], "b": [i * 7_000_000 for i in range(500)], "c": [5, 5, 5, 60_000_005, 60_000_006, 120_000_006], "d": [3]}
    df = spark.createDataFrame([(h, at(t)) for h, ts in hits.items() for t in ts], "source_system string, timestamp_utc timestamp").repartition(3)
    got = sorted((r.source_system, int((r.start.astimezone(UTC) - at(0)) / datetime.timedelta(microseconds=1)), int((r.last.astimezone(UTC) - at(0)) / datetime.timedelta(microseconds=1)), r.n) for r in relate.bursts(df).collect())
    assert got == sorted((h, *g) for h, ts in hits.items() for g in greedy(ts, 60_000_000) if g[2] >= 3)


def test_burst_of_one_host(spark):
    """A run of 200,000 hits of one host without a pause."""
    df = spark.range(200_000).select(F.lit("h").alias("source_system"), F.timestamp_micros(F.col("id") * 1_100_000).alias("timestamp_utc"))
    got = relate.bursts(df).agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.max("n").alias("m")).first()
    assert (got.c, got.m) == (-(-200_000 // 55), 55) and got.n in (200_000, 200_000 - 200_000 % 55)


def test_search(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abAB.\\ ") for _ in range(rng.randrange(1, 40))) for _ in range(200)] + ["", None, "hot http://x", *[f"http://host{i}/p" for i in range(80)]]
    values = ["".join(rng.choice("abAB.\\ ") for _ in range(rng.randrange(1, 6))) for _ in range(40)] + ["", None, "http", "HOST7", "h", "tp:", "nowhere"]
    want = {(v, t) for v in values for t in texts if v and t and v.lower() in t.lower()}
    frame = lambda name, xs: spark.createDataFrame([(x,) for x in xs], f"{name} string")
    for bucket in (1 << 14, 7):  # with 7, the common parts are split
        assert {(r.value, r.text) for r in search.found_in(frame("value", values), frame("text", texts), bucket).collect()} == want
    assert search.found_in(frame("value", []), frame("text", texts)).isEmpty() and search.found_in(frame("value", values), frame("text", [])).isEmpty()


def test_claims(spark):
    schema = "claim_id long, affected_entities array<string>, supporting_evidence string, raw_evidence_refs array<struct<file:string,filter:string>>"
    a, b = ("f1", "x"), ("f2", None)
    df = spark.createDataFrame([(1, ["WEB01", "1.2.3.4", "emp\\e", "ghost"], "said 'calc' \"net user bob\" 'nothing here' \"abc\"", [a, b]), (2, [], None, [b, a, a]), (3, None, "", [a]), (4, ["x"], "no quotes", []), (5, ["x"], "", [b, a])], schema)
    ev = spark.createDataFrame([("web01", "u", "p.exe", "C:\\Temp\\evil", "1.2.3.4", None, "NET USER BOB /add")], "source_system string, username string, process_name string, file_path string, source_ip string, dest_ip string, command_line string")
    ev = ev.withColumns({c: F.lit(None).cast("string") for c in claims.TEXTS if c not in ev.columns})
    assert {(r.claim_id, r.entity): r.found for r in claims.check_entities(df, claims.entities_of(ev)).collect()} == {(1, "WEB01"): True, (1, "1.2.3.4"): True, (1, "emp\\e"): True, (1, "ghost"): False, (4, "x"): False, (5, "x"): False}
    assert sorted((r.claim_id, r.place, r.found) for r in claims.check_quotes(df, ev).collect()) == [(1, 1, True), (1, 4, False)]
    assert sorted((r.claim_id, r.first, r.n) for r in claims.duplicates(df).collect()) == [(1, 1, 3), (2, 1, 3), (5, 1, 3)]


def test_layers(spark):
    import base64
    from urllib.parse import quote

    inner = "whoami and password=x at http://1.2.3.4/a"
    wide = base64.b64encode(inner.encode("utf-16-le")).decode()
    outer = f"powershell -enc {wide} " + quote("a b/c?", safe="")
    twice = base64.b64encode(outer.encode()).decode()
    got = {r.text: r for r in layers.layers(spark.createDataFrame([("cmd", twice), ("cmd", twice), ("uri", "d41d8cd98f00b204e9800998ecf8427e"), ("x", None)], "source string, text string")).collect()}
    assert got[inner].chain == "Base64 UTF-8 > Base64 UTF-16LE" and got[inner].depth == 2 and got[inner].parent_id == got[outer].id and got[outer].parent_id == got[twice].id
    assert got[outer.replace("a%20b%2Fc%3F", "a b/c?")].chain == "Base64 UTF-8 > URL" and len(got) == 5
    row = layers.with_indicators(spark.createDataFrame([tuple(got[inner])], "id string, parent_id string, source string, depth int, chain string, text string")).first()
    assert (row.urls, row.ips, row.commands, row.credentials) == ("http://1.2.3.4/a", "1.2.3.4", "", True)


def test_journal(spark):
    rows = [
        (1, 1, 0, 0x1000, "a.txt"), (1, 2, 1, 0x2000, "b.exe"), (1, 3, 2, 0x2000, "c.txt"), (2, 4, 3, 0x2000, "never.old"),
        (3, 5, 10, 0x100, "Evil.EXE"), (3, 6, 11, 0x80000200, "evil.exe"), (4, 7, 20, 0x100, "x.dll"), (4, 8, 20 + 3600, 0x200, "x.dll"), (5, 9, 30, 0x100, "plain.doc"), (5, 10, 31, 0x200, "plain.doc"),
        *[(6, 20 + i, 50 + i / 10, 0x2, f"f{i}.jpg" if i < 2 else "n.txt") for i in range(5)], *[(7, 40 + i, 60.5 + i / 10, 0x2, "m.exe") for i in range(6)],
    ]
    df = spark.createDataFrame([(f, u, at(int(t * 1_000_000)), r, n) for f, u, t, r, n in rows], "file_reference long, usn long, timestamp_utc timestamp, reason long, filename string")
    assert sorted((r.usn, r.old, r.new) for r in journal.renames(df).collect()) == [(2, "a.txt", "b.exe"), (3, "a.txt", "c.txt")]
    assert [(r.usn, r.deleted_usn, r.name, r.seconds) for r in journal.staged_deletions(df).collect()] == [(5, 6, "evil.exe", 1.0)]
    assert sorted((r.n, r.files, r.suspicious) for r in journal.rapid_operations(df).collect()) == [(5, 1, 5), (5, 3, 2)]
    assert df.where("usn = 6").select(journal.reason_names(F.col("reason")).alias("r")).first().r == "FILE_DELETE,CLOSE"


def test_staged_deletions_form_no_pairs(spark):
    rows = [(i, i * 1000, 0x100 if i % 2 else 0x200, "A.exe" if i % 4 < 2 else "a.exe") for i in range(400)] + [(900, 7_000_000_000, 0x100, "b.dll"), (902, 7_000_000_000 + 3_599_999_999, 0x200, "b.dll"), (901, 7_000_000_000 + 3_599_999_999, 0x200, "b.dll"), (903, 0, 0x300, "c.bat"), (904, 1, 0x300, "c.bat")]
    df = spark.createDataFrame([(u, at(m), r, n) for u, m, r, n in rows], "usn long, timestamp_utc timestamp, reason long, filename string")
    done = journal.staged_deletions(df)
    want = sorted((i, i + 1, "a.exe", 0.001) for i in range(1, 399, 2)) + [(900, 901, "b.dll", 3599.999999), (903, 904, "c.bat", 0.000001)]
    assert sorted(tuple(r) for r in done.collect()) == want
    assert "sequence(" not in done._jdf.queryExecution().toString()  # no record is spread over slots to be paired with all others there


def test_literal_parts():
    import re

    from duskwatch import rules

    patterns = [p for p, _ in rules.TRIAGE] + [s[1] for s in rules.SIGNATURES]
    assert detect.literal_of(r"certutil.*-decode") == "certutil" and detect.literal_of("cmd=|exec=") is None and detect.literal_of(r"[a-z]{3,}") is None and detect.literal_of(r"ab?cde\.f+gh{2}i") == "cde."
    texts = ["certutil -x -DECODE", "procdump64.exe -ma lsass", "<SCRIPT", "..\\../", "net  user", "-enc x", "SELECT a FROM b WHERE c", "x.asp?", "reg save hklm\\sam", "A" * 20, "-w hidden", "cmd /c x", "wmic /node:a", "b374k.asp", "rar a -pX", "%2E%2e%2f", "../../", "touch a -t"]
    for p in patterns:
        for t in texts:
            if re.search(p, t, re.I) and (part := detect.literal_of(p)):
                assert part in t.lower(), (p, t, part)
