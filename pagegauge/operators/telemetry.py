"""Telemetry of captures and sessions, in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

KINDS = ["request_started", "request_finished", "request_failed", "write_attempt", "external_read"]
TYPES = ["document", "stylesheet", "script", "image", "font", "media"]
#: Kinds of runtime attempts, and so the names of their gates.
ATTEMPTS = (
    "websocket beacon window_open popup download service_worker_registration external_fetch external_xhr webtransport "
    "websocket_stream rtc_peer_connection rtc_data_channel"
).split()
#: Events kept of each kind and session.
LIMITS = {"request_started": 5, "request_finished": 4, "request_failed": 2, "write_attempt": 3, "external_read": 2}


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def blocked_requests(events: DataFrame) -> DataFrame:
    """Requests that aren't read-only."""
    return events.where(~F.col("method").isin("GET", "HEAD", "OPTIONS")).select("session", "seq", "method", "kind")


def capturable_assets(events: DataFrame) -> DataFrame:
    """Events whose resource is captured: by type, or finished reads of scripts."""
    return events.where(F.col("resource_type").isin("stylesheet", "image", "font", "media") | ((F.col("kind") == "request_finished") & (F.col("resource_type") == "script"))).select("session", "seq", "resource_type")


def prohibited_reads(events: DataFrame, allow_assets: DataFrame) -> DataFrame:
    """External reads that a session's mode doesn't allow: assets only where it allows them (``session`` rows)."""
    reads = events.where("kind = 'external_read'")
    assets = F.col("resource_type").isin("font", "image", "media", "stylesheet")
    allowed = reads.where(assets).join(allow_assets.select("session").distinct(), "session", "left_semi").select("seq")
    return reads.join(allowed, "seq", "left_anti").select("session", "seq", "resource_type")


def telemetry_counts(events: DataFrame) -> DataFrame:
    """(session, <kind>..., failed_<type>...): counters of each session."""
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in KINDS]
    failed = [F.count_if((F.col("kind") == "request_failed") & (F.col("resource_type") == t) & (F.col("method") == "GET")).alias(f"failed_{t}") for t in TYPES]
    return events.groupBy("session").agg(*counts, *failed)


def attempt_gates(events: DataFrame) -> DataFrame:
    """(session, code, n): runtime attempts by kind; any of them fails its gate."""
    names = F.array(*[F.lit(f"{a}-attempt") for a in ATTEMPTS])
    return events.groupBy("session", F.element_at(names, F.col("attempt") + 1).alias("code")).agg(F.count("*").alias("n"))


def attribute_phase(events: DataFrame) -> DataFrame:
    """(session, seq, phase): the phase in force when an event happened, by the last phase row before or at it."""
    order = W.partitionBy("session").orderBy("ts", "seq")
    return events.select("session", "seq", F.coalesce(F.last("phase", ignorenulls=True).over(order), F.lit(-1)).alias("phase"))


def payload_equivalence(events: DataFrame) -> DataFrame:
    """(session, n_ui, n_retry, same): ordered digests of two phases' payloads compared."""
    p = attribute_phase(events).where("phase in (0, 1)").join(events.select("seq", "kind", "amount"), "seq")
    part = F.concat_ws(":", "kind", F.col("amount").cast("string"))
    digest = lambda ph: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("phase") == ph, F.struct("seq", part.alias("p"))))), lambda x: x["p"]), "|"), 256)
    out = p.groupBy("session").agg(F.count_if(F.col("phase") == 0).alias("n_ui"), F.count_if(F.col("phase") == 1).alias("n_retry"), (digest(0) == digest(1)).alias("same"))
    return out


def layout_stability(events: DataFrame) -> DataFrame:
    """(session, n, stable): whether there are four samples, of which the last three have the same layout."""
    rn = F.row_number().over(W.partitionBy("session").orderBy(F.desc("ts"), F.desc("seq")))
    last = events.withColumn("rn", rn).where("rn <= 4")
    return last.groupBy("session").agg(F.count("*").alias("n"), ((F.countDistinct(F.when(F.col("rn") <= 3, F.col("resource_type"))) == 1) & (F.count("*") == 4)).alias("stable"))


def retain_events(events: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """(session, seq, kind, total, truncated): the first events of each kind up to its limit, with the full count."""
    limits = limits or LIMITS
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("kind")]
    part = W.partitionBy("session", "kind")
    rows = events.withColumn("rn", F.row_number().over(part.orderBy("ts", "seq"))).withColumn("total", F.count("*").over(part))
    return rows.where(F.col("rn") <= limit).select("session", "seq", "kind", "total", (F.col("total") > limit).alias("truncated"))


def interaction_gates(events: DataFrame) -> DataFrame:
    """(session, n_writes, n_keys, n_failed, passed, failures): one write by hand and one retry with one key."""
    per = events.groupBy("session").agg(F.count_if(F.col("kind") == "write_attempt").alias("n_writes"), F.countDistinct(F.when(F.col("kind") == "write_attempt", F.col("idem_key"))).alias("n_keys"), F.count_if(F.col("kind") == "request_failed").alias("n_failed"))
    broken = F.array_compact(F.array(F.when(F.col("n_writes") != 2, "write_count"), F.when(F.col("n_keys") != 1, "key_count"), F.when(F.col("n_failed") > 0, "blocked")))
    return per.select("*", (F.size(broken) == 0).alias("passed"), F.array_join(broken, ",").alias("failures"))


def storage_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(session, added, changed): names that are new after an interaction, and whether any count differs."""
    names = lambda d, n: d.groupBy("session").agg(F.collect_set("resource_type").alias(f"{n}_names"), F.count("*").alias(f"{n}_count"))
    out = names(after, "a").join(names(before, "b"), "session", "left")
    added = F.array_sort(F.array_except("a_names", F.coalesce("b_names", F.array().cast("array<string>"))))
    return out.select("session", F.array_join(added, ",").alias("added"), (F.col("a_count") != F.coalesce("b_count", F.lit(0))).alias("changed"))


def lifecycle_balance(events: DataFrame, quiet_seconds: int = 300) -> DataFrame:
    """(session, started, finished, failed, quiet, balanced): all requests ended, none failed, and a quiet end."""
    per = events.groupBy("session").agg(*[F.count_if(F.col("kind") == f"request_{k}").alias(k) for k in ("started", "finished", "failed")], F.max("ts").alias("last"), F.max(F.when(F.col("kind").startswith("request"), F.col("ts"))).alias("last_request"))
    quiet = F.coalesce(F.floor(_micros("last") / 1000000) - F.floor(_micros("last_request") / 1000000) >= quiet_seconds, F.lit(True))
    return per.select("session", "started", "finished", "failed", quiet.alias("quiet"), ((F.col("started") == F.col("finished")) & (F.col("failed") == 0) & quiet).alias("balanced"))


def quiescence(events: DataFrame, gap_seconds: int = 300) -> DataFrame:
    """(session, burst, n, first, last): bursts of activity that a quiet gap ends."""
    order = W.partitionBy("session").orderBy("ts", "seq")
    new = F.coalesce((_micros("ts") - F.lag(_micros("ts")).over(order) > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    rows = events.withColumn("new", new).withColumn("burst", F.sum("new").over(order))
    return rows.groupBy("session", "burst").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def idempotent_receipts(events: DataFrame) -> DataFrame:
    """(session, key_hash, attempts, receipt): one receipt per key, the first attempt's, however often it is retried."""
    return events.where("kind = 'write_attempt'").groupBy("session", F.sha2("idem_key", 256).alias("key_hash")).agg(F.count("*").alias("attempts"), F.min_by("seq", F.struct("ts", "seq")).alias("receipt"))


def persistence_pairs(events: DataFrame, low_seconds: int = 60, high_seconds: int = 1800) -> DataFrame:
    """(session, seq, later, same): an event and the next states of its session after a delay, without a write between
    them. Session and number of writes are equi-keys;
    the interval is a residual condition."""
    # the writes up to an event, and before it
    write = (F.col("kind") == "write_attempt").cast("int")
    so_far = F.sum(write).over(W.partitionBy("session").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0))
    events = events.withColumn("writes", so_far).withColumn("before", F.col("writes") - write)
    a = events.select("session", "seq", "ts", "resource_type", "writes")
    b = events.select(F.col("session").alias("s2"), F.col("seq").alias("later"), F.col("ts").alias("ts2"), F.col("resource_type").alias("type2"), "before")
    delay = _micros("ts2") - _micros("ts")
    return a.join(b, (F.col("session") == F.col("s2")) & (F.col("writes") == F.col("before")) & delay.between(low_seconds * 1_000_000, high_seconds * 1_000_000)).select("session", "seq", "later", (F.col("resource_type") == F.col("type2")).alias("same"))
