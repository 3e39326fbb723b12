from duskwatch.adapters import security_events
from duskwatch.plans.triage import triage_run
from duskwatch.streaming import detections

SF = "/root/testdata/sf0.001"


def test_triage_run(spark):
    out = triage_run(security_events(spark, SF).limit(300))
    assert out["findings"].count() > 0 and out["techniques"].count() == 7


def test_streams(spark, tmp_path):
    security_events(spark, SF).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("hits", detections.signatures(stream), "append"), ("hours", detections.hourly_counts(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert spark.table("hits").count() == detections.signatures(security_events(spark, SF)).count()
    assert spark.table("hours").groupBy().sum("n").first()[0] == security_events(spark, SF).count()
