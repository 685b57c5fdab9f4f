import datetime as dt

from tidegauge.streaming import stream


def test_first_exposures_keep_the_earliest(spark, tmp_path):
    rows = [("u", dt.datetime(2025, 1, 2), "b"), ("v", dt.datetime(2025, 1, 1), "a")]
    schema = "unit_id string, ts timestamp, group_id string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("u", dt.datetime(2025, 1, 1), "a"), ("v", dt.datetime(2025, 1, 5), "c")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = stream.first_exposures(stream.read_events(spark, str(tmp_path / "in"), schema))
    q = s.writeStream.format("memory").outputMode("update").queryName("first_seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in spark.table("first_seen").collect():
        if r.unit_id not in last or r.revision > last[r.unit_id].revision:
            last[r.unit_id] = r
    assert {k: (v.group_id, v.first_exposure_ts) for k, v in last.items()} == {"u": ("a", dt.datetime(2025, 1, 1)), "v": ("a", dt.datetime(2025, 1, 1))}


def test_windows_and_sessions_start(spark, tmp_path):
    spark.createDataFrame([("u", dt.datetime(2025, 1, 1, h), "view", 1.0) for h in (1, 2, 9)], "unit_id string, ts timestamp, event string, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, f in (("roll", lambda e: stream.rolling_active(e, "view", 3)), ("sess", lambda e: stream.sessions(e, "2 hours"))):
        q = f(stream.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").outputMode("append").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
