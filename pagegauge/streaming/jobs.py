"""Structured Streaming forms of the telemetry operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.gates import iteration_ledger

KIND = {"view": "request_started", "click": "request_finished", "error": "request_failed", "purchase": "write_attempt"}
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def telemetry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, session, seq, kind, idem_key) from the event files of a folder, a file per trigger."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events*.parquet").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 4).parquet(sf_dir)
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in KIND.items() for x in kv])[F.col("event_type")], F.lit("external_read"))
    return raw.select("ts", F.col("user_id").alias("session"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("synthetic-"), F.floor("value").cast("string")).alias("idem_key"))


def bounded_counters(events: DataFrame, limit: int = 3) -> DataFrame:
    """(session, kind, total, truncated), updated as events arrive."""
    return events.groupBy("session", "kind").agg(F.count("*").alias("total")).withColumn("truncated", F.col("total") > limit)


def idempotent_intake(events: DataFrame, ttl: str = "3650 days") -> DataFrame:
    """(session, key_hash): one receipt per key however often it is retried within ``ttl``."""
    keyed = events.where("kind = 'write_attempt'").select("ts", "session", F.sha2("idem_key", 256).alias("key_hash"))
    return keyed.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["session", "key_hash"]).select("session", "key_hash")


def session_bursts(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(session, begin, end, n): bursts of activity that a quiet gap closes (gap form of the quiescence detector)."""
    rows = events.withWatermark("ts", late).groupBy("session", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select("session", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


class Quiet(StatefulProcessor):
    """A session is quiet when no request is open and nothing has happened for a while; otherwise it times out."""

    def __init__(self, quiet_ms: int = 150, timeout_ms: int = 2000) -> None:
        self.quiet_ms, self.timeout_ms = quiet_ms, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "open long, last long, first long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        open_, last, first = self.state.get() if self.state.exists() else (0, 0, -1)
        for frame in rows:
            for ts, kind in zip(frame["ts"], frame["kind"], strict=True):
                at = int(ts.timestamp() * 1000)
                open_ += {"request_started": 1, "request_finished": -1, "request_failed": -1}.get(kind, 0)
                last, first = max(last, at), at if first < 0 else min(first, at)
        self.state.update((open_, last, first))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(last + self.quiet_ms if open_ <= 0 else first + self.timeout_ms)
        yield pd.DataFrame({"session": pd.Series(dtype="int64"), "quiet": pd.Series(dtype="bool"), "open": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        open_, last, first = self.state.get()
        self.state.clear()
        yield pd.DataFrame({"session": [key[0]], "quiet": [open_ <= 0], "open": [open_]})

    def close(self) -> None:
        pass


def quiescence(events: DataFrame, quiet_ms: int = 150, timeout_ms: int = 2000, late: str = "1 second") -> DataFrame:
    """(session, quiet, open), by an open-request count and event-time timers (exact form)."""
    rows = events.withWatermark("ts", late).select("ts", "session", "kind")
    return rows.groupBy("session").transformWithStateInPandas(Quiet(quiet_ms, timeout_ms), "session long, quiet boolean, open long", "append", "eventTime")


def persistence_pairs(events: DataFrame, low: str = "1 minute", high: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(session, seq, later): states of a session after a delay, as a stream-stream interval join."""
    a = events.withWatermark("ts", late).select("session", "seq", "ts")
    b = events.withWatermark("ts", late).select(F.col("session").alias("s2"), F.col("seq").alias("later"), F.col("ts").alias("ts2"))
    return a.join(b, F.expr(f"session = s2 and ts2 between ts + interval {low} and ts + interval {high}")).select("session", "seq", "later")


def live_ledger(runs: DataFrame, path: str, checkpoint: str):
    """Query that keeps the best-so-far ledger of every series that a batch touches, one version per batch."""

    def update(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/runs/batch={batch_id}")
        touched = batch.select("series").distinct()
        known = spark.read.parquet(f"{path}/runs").drop("batch").join(touched, "series", "left_semi")
        iteration_ledger(known).write.mode("overwrite").parquet(f"{path}/ledger/batch={batch_id}")

    return runs.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, mode: str, path: str, keys: list[str] | None) -> DataFrame:
    """Run a stream over what is available and return its result; of updated rows the last of each key."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{path}/rows")
    if keys is None:
        return rows.drop("batch")
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("batch")))
    return rows.withColumn("rn", rn).where("rn = 1").drop("rn", "batch")
