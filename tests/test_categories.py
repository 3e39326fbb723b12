"""Finding categories on literal rows."""

from pyspark.sql import functions as F

from duskwatch.operators import categories as C

COLUMNS = ["row_id long", "event_code int", "event_type string", "timestamp_utc timestamp", "username string", "logon_type int", "source_ip string", "dest_ip string", "dest_port int", "query_name string", "process_name string", "parent_process_name string", "command_line string", "uri string"]
COLUMNS += ["query_string string", "http_method string", "file_path string", "service_name string", "registry_key string", "target_image string", "raw_payload string", "attribute string", "script_block string", "host_application string", "protocol int"]


def events(spark, *rows):
    names = [c.split()[0] for c in COLUMNS]
    return spark.createDataFrame([tuple({"row_id": i, **r}.get(n) for n in names) for i, r in enumerate(rows)], ", ".join(COLUMNS))


def kinds(df):
    return sorted((r.row_id, r.kind) for r in df.collect())


def test_credentials(spark):
    ev = events(spark, {"command_line": "PROCDUMP -x"}, {"event_code": 4769}, {"event_code": 10, "target_image": "C:\\lsass.exe"}, {"event_type": "Memory_hashdump", "raw_payload": '{"rid":500,"nthash":"ab"}'}, {"event_code": 4624})
    got = C.credential_access(ev)
    assert kinds(got) == [(0, "tool"), (1, "auth"), (2, "lsass_access"), (2, "tool"), (3, "hash_dump")]
    assert got.where("kind = 'hash_dump'").first().what == "500:ab"


def test_lateral_and_persistence(spark):
    ev = events(spark, {"event_code": 4624, "logon_type": 3}, {"event_code": 4624, "logon_type": 10}, {"event_code": 3, "dest_port": 5985}, {"parent_process_name": "WmiPrvSE.exe"}, {"command_line": "Invoke-TheHash"})
    assert kinds(C.lateral_movement(ev)) == [(0, "network_logon"), (2, "connection"), (3, "remote_child"), (4, "remote_command")]
    ev = events(spark, {"event_code": 7045, "service_name": "XFBRJVUPQBBNMSAPIGNN"}, {"event_code": 7045, "service_name": "Spooler"}, {"event_code": 13, "registry_key": "HKLM\\CurrentVersion\\Run\\x"}, {"event_code": 13, "registry_key": "HKLM\\x"}, {"event_type": "Memory_svcscan", "process_name": "s"}, {"event_code": 4698})
    assert kinds(C.persistence(ev)) == [(0, "random_service"), (0, "service"), (1, "service"), (2, "registry"), (4, "memory_service"), (5, "task")]


def test_network_and_files(spark):
    ev = events(spark, {"dest_ip": "8.8.8.8"}, {"dest_ip": "10.1.1.1"}, {"event_code": 22, "query_name": "x.y"}, {"event_code": 3})
    assert kinds(C.network(ev)) == [(0, "connection"), (0, "external"), (1, "connection"), (2, "dns"), (3, "connection")]
    ev = events(spark, {"event_code": 11, "file_path": "C:\\Temp\\x.DMP"}, {"event_type": "Memory_handles", "raw_payload": '{"handle_type":"File","handle_name":"C:\\\\a.pdf"}'}, {"event_type": "Memory_handles", "raw_payload": '{"handle_type":"Key"}'}, {"event_code": 23, "file_path": None})
    assert sorted((r.row_id, r.kind, r.suspicious, r.dump) for r in C.file_operations(ev).collect()) == [(0, "file", True, True), (1, "handle", True, False), (3, "file", False, False)]


def test_web(spark):
    smb = '{"tree_path":"\\\\\\\\s\\\\c$","filename":"a.aspx","write_length":9}'
    ev = events(spark, {"uri": "/CMD.aspx", "source_ip": "10.0.0.1"}, {"uri": "/upload.php", "source_ip": "8.8.8.8"}, {"uri": "/x", "query_string": "exec=1"}, {"event_type": "PCAP_SMB", "raw_payload": smb}, {"event_type": "PCAP_SMB", "raw_payload": smb.replace("9}", "0}")}, {"uri": "/index.php"})
    got = C.web_attacks(ev)
    assert kinds(got) == [(0, "webshell"), (1, "webshell"), (2, "command_query"), (3, "share_connect"), (3, "share_write"), (3, "suspicious_write"), (4, "share_connect")]
    assert tuple(C.pivot(got).first()) == (1, 1, True)
    assert tuple(C.pivot(got.where("source_ip = '10.0.0.1'")).first()) == (0, 1, False)


def test_scripts_logons_directory(spark):
    ev = events(spark, {"event_code": 400, "host_application": "powershell -enc SQBF"}, {"event_code": 4104, "script_block": "fine"}, {"process_name": "PowerShell.exe", "command_line": "x -NoNi"}, {"process_name": "cmd.exe", "command_line": "-enc"})
    assert sorted((r.row_id, r.kind, r.indicator, r.severity) for r in C.powershell(ev).collect()) == [(0, "script", "-enc", "HIGH"), (1, "script", None, None), (2, "process", "-noni", "HIGH")]
    ev = events(spark, {"event_code": 4624, "logon_type": 10, "username": "a"}, {"event_code": 4625, "username": "a"}, {"event_code": 4634, "username": "a"}, {"event_code": 4672, "username": None})
    assert sorted((r.row_id, r.logon, r.n) for r in C.auth_timeline(ev).collect()) == [(0, "RemoteInteractive", 2), (1, None, 2), (3, None, 1)]
    ev = events(spark, {"event_code": 5136, "attribute": "servicePrincipalName"}, {"event_code": 5136, "attribute": None}, {"event_code": 4662, "attribute": "title"})
    assert [r.level for r in C.directory_changes(ev).orderBy("row_id").collect()] == ["HIGH", "MEDIUM", "MEDIUM"]
    assert C.filtered_connections(ev.withColumn("event_code", F.lit(5156))).count() == 1
