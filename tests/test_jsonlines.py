"""JSON lines as events: edge lines, any depth, and no exchange."""

from duskwatch.sources import jsonlines

LINES = [
    (1, '{"ts": 1700000000, "a": {"b": {"c": {"d": {"e": {"f": {"ip": "10.0.0.1"}}}}}}}'),  # deeper than one pass takes
    (2, '{"time": "", "event": {"date": "2024-01-02 03:04:05", "type": "x"}, "z": {"user": "deep"}, "username": "near"}'),
    (3, '{"ts": 1700000000000, "dst": {"ip": "1.1.1.1"}, "source": {"ip": "2.2.2.2", "port": "x"}, "args": ["a", 1, null], "src_port": "no", "dest.port": 7, "user": ""}'),
    (4, "[1, 2]"), (5, "no json"), (6, None), (7, '{"user": "no time"}'), (8, '"2024-01-02"'), (9, '{"ts": 1700000000, "host": null, "computer": {}, "event": "text"}'),
]


def test_norm_jsonl_edges_without_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = jsonlines.norm_jsonl(spark.createDataFrame(LINES, "row_id long, value string"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r.row_id: r for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "Join" not in plan
    assert sorted(got) == [1, 2, 3, 9]
    assert got[1].source_ip == "10.0.0.1" and got[1].event_type == "JSONL"
    assert (str(got[2].timestamp_utc), got[2].event_type, got[2].username) == ("2024-01-02 03:04:05", "JSONL_x", "deep")  # user stands before username
    assert (got[3].source_ip, got[3].command_line, got[3].source_port, got[3].dest_port, got[3].username) == ("2.2.2.2", "a;1;null", None, 7, None)  # source.ip joined is source_ip
    assert got[9].source_system is None
