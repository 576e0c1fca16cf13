"""Streams give what their batch forms give."""

import pandas as pd
from pyspark.sql import functions as F

from pagegauge.streaming import jobs


def test_quiet_sessions(spark, tmp_path):
    at = lambda ms: pd.Timestamp("2024-01-01") + pd.Timedelta(milliseconds=ms)
    events = [(at(0), 1, "request_started"), (at(10), 1, "request_finished"), (at(0), 2, "request_started"), (at(60_000), 3, "request_finished")]
    spark.createDataFrame(pd.DataFrame(events, columns=["ts", "session", "kind"])).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, session long, kind string").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = jobs.run_to_table(jobs.quiescence(stream), "append", str(tmp_path / "out"), None)
        got = {r.session: r.quiet for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got[1] is True and got[2] is False


def test_live_ledger(spark, tmp_path):
    rows = [(1, s, 0.0, 0.0, v, 0.0, 0.0) for s, v in enumerate((0.5, 0.4, 0.6))]
    kind = "series long, seq int, v1 double, v2 double, v3 double, v4 double, v5 double"
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "in"))
    jobs.live_ledger(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "t/ledger")).orderBy("seq").select("seq", "is_best", "regressed").collect()
    assert [tuple(r) for r in got] == [(0, True, False), (1, True, False), (2, False, True)]


def test_session_bursts(spark, tmp_path):
    base = spark.range(6).select((F.timestamp_seconds(F.col("id") * 100 + F.when(F.col("id") >= 3, 1000).otherwise(0))).alias("ts"), F.lit(1).cast("long").alias("session"), F.lit("x").alias("kind"))
    base.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, session long, kind string").parquet(str(tmp_path / "in"))
    out = jobs.run_to_table(jobs.session_bursts(stream, "2 minutes", "0 seconds"), "append", str(tmp_path / "out"), None)
    assert [r.n for r in out.collect()] == [3]
