"""A form filled in, sent and sent again: what page, server and audit log say of it, held against one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.expressions import codes, joined, origin

#: Codes of what must not happen at all, by kind of event.
EVENTS = {
    "blocked_write": "EXTERNAL_WRITE_BLOCKED",
    "blocked_private_read": "PRIVATE_DESTINATION_BLOCKED",
    "blocked_external_read": "EXTERNAL_READ_BLOCKED",
    "local_write": "UNEXPECTED_LOCAL_WRITE",
    "websocket": "WEBSOCKET_BLOCKED",
    "transport": "MODERN_TRANSPORT_BLOCKED",
}


def match_logs(writes: DataFrame, receipts: DataFrame) -> DataFrame:
    """(session, phase, url, n, write_seq, receipt_seq): the n-th write of a session, phase and address with its n-th
    receipt, one to one. Null on one side: a write that nobody answered, or a receipt that nobody asked for. A session
    is short (its log is capped where it is taken), so numbers come from a window over it. Nulls equal nulls. Both logs
    go through one shuffle and one sort by session; equal numbers of a key then follow one another there."""
    key = ["session", "phase", "url"]
    sides = [d.select(*key, F.lit(wrote).alias("wrote"), "seq") for d, wrote in ((writes, True), (receipts, False))]
    numbered = sides[0].unionByName(sides[1]).repartition(*key).withColumn("n", F.row_number().over(W.partitionBy(*key, "wrote").orderBy("seq")))
    of = lambda wrote: F.max(F.when(F.col("wrote") == wrote, F.col("seq")))
    return numbered.groupBy(*key, "n").agg(of(True).alias("write_seq"), of(False).alias("receipt_seq"))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def interaction_rollup(sessions: DataFrame, requests: DataFrame, receipts: DataFrame, payloads: DataFrame, audits: DataFrame, events: DataFrame) -> DataFrame:
    """(session, unanswered, unasked, passed, failures) of every session, failures in a fixed order.

    sessions (session, origin, endpoint, unfilled, has_submit, email_off, keeps_nothing): one row each. requests
    (session, seq, phase, method, url). receipts (session, seq, phase, url, status, content_type, id, well_formed,
    retained): phases submission, retry and lookup. payloads (session, seq, phase, metadata_digest, content_digest,
    canary, header, broken). audits (session, seq, attempts, receipts, keys, well_formed): the last counts. events
    (session, kind). ``unanswered`` and ``unasked`` are what is left when writes and receipts are matched one to one.

    Nulls: a missing log or value never passes a check that asks for it; rows without a session belong to none. Of
    several receipts or payloads in a phase the first counts, by seq. Every log is summed up by session before it is joined.
    """
    s = sessions.where("session is not null")
    writing = ~F.coalesce(F.upper("method"), F.lit("")).isin("GET", "HEAD", "OPTIONS")
    sent = requests.join(s.select("session", "origin", "endpoint").hint("merge"), "session")
    sent = sent.where(writing & (origin("url") == F.col("origin")) & (F.col("url") == F.col("endpoint")) & F.col("phase").isin("submission", "retry"))
    page = sent.groupBy("session").agg(F.count_if(F.col("phase") == "submission").alias("ui"), F.count("*").alias("writes"))

    at = receipts.join(s.select("session", "endpoint").hint("merge"), "session").where((F.col("phase") == "lookup") | (F.col("url") == F.col("endpoint")))
    valid = F.col("status").between(200, 299) & F.lower("content_type").contains("application/json") & F.col("well_formed")
    answer = F.struct("id", _yes(valid).alias("valid"), _yes(F.col("retained")).alias("retained"))
    first = {p: F.min_by(answer, F.when(F.col("phase") == p, F.col("seq"))).alias(p) for p in ("submission", "retry", "lookup")}
    server = at.groupBy("session").agg(*first.values())
    left_over = match_logs(sent.select("session", "phase", "url", "seq"), at.where("phase <> 'lookup'").select("session", "phase", "url", "seq"))
    left_over = left_over.groupBy("session").agg(F.count_if(F.col("receipt_seq").isNull()).alias("unanswered"), F.count_if(F.col("write_seq").isNull()).alias("unasked"))

    body = F.struct("metadata_digest", "content_digest", _yes(F.col("canary") & F.col("header")).alias("marked"))
    bodies = payloads.groupBy("session").agg(
        *[F.min_by(body, F.when((F.col("phase") == p) & ~_yes(F.col("broken")), F.col("seq"))).alias(f"{p}_body") for p in ("submission", "retry")],
        *[F.count_if((F.col("phase") == p) & ~_yes(F.col("broken"))).alias(f"{p}_bodies") for p in ("submission", "retry")],
        F.count_if(F.col("broken")).alias("broken"),
    )
    last = audits.groupBy("session").agg(F.max_by(F.struct("attempts", "receipts", "keys", "well_formed"), "seq").alias("audit"))
    kinds = [*EVENTS, "page_error", "tampering"]
    seen = events.groupBy("session").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])

    out = s
    for part in (page, server, left_over, bodies, last, seen):
        out = out.join(part.hint("merge"), "session", "left")
    out = out.fillna(0, ["ui", "writes", "unanswered", "unasked", "submission_bodies", "retry_bodies", "broken", *kinds])
    same = lambda n: _yes(F.col(f"submission_body.{n}") == F.col(f"retry_body.{n}"))
    kept = _yes(F.col("submission.retained")) | _yes(F.col("retry.retained")) | _yes(F.col("lookup.retained"))
    audited = (F.col("audit.attempts") == 2) & (F.col("audit.receipts") == 1) & (F.col("audit.keys") == 1) & F.col("audit.well_formed")
    failures = codes(
        {
            "REQUIRED_CONTROLS_UNFILLED": F.col("unfilled") > 0,
            "NO_VISIBLE_SUBMIT": ~_yes(F.col("has_submit")),
            "EXACTLY_ONE_UI_SUBMISSION_REQUIRED": F.col("ui") != 1,
            "IDEMPOTENT_RETRY_MISSING_OR_DUPLICATED": F.col("writes") != 2,
            "MULTIPART_PAYLOAD_PROOF_MISSING": (F.col("broken") > 0) | (F.col("submission_bodies") != 1) | (F.col("retry_bodies") != 1),
            "SYNTHETIC_PAYLOAD_CANARY_MISSING": ~(_yes(F.col("submission_body.marked")) & _yes(F.col("retry_body.marked"))),
            "UI_RETRY_MULTIPART_MISMATCH": ~(same("metadata_digest") & same("content_digest")),
            "INVALID_SUBMISSION_RECEIPT": ~_yes(F.col("submission.valid")),
            "INVALID_RETRY_RECEIPT": ~_yes(F.col("retry.valid")),
            "IDEMPOTENCY_RECEIPT_MISMATCH": ~_yes(F.col("submission.id") == F.col("retry.id")),
            "RECEIPT_LOOKUP_FAILED": ~(_yes(F.col("lookup.valid")) & _yes(F.col("lookup.id") == F.col("submission.id"))),
            "APPLICANT_VALUES_RETAINED": kept,
            "BACKEND_AUDIT_CONTRACT_FAILED": ~_yes(audited),
            **{code: F.col(kind) > 0 for kind, code in EVENTS.items()},
            "EMAIL_DEFAULT_NOT_DISABLED": ~_yes(F.col("email_off")),
            "MANIFEST_NON_RETENTION_NOT_DECLARED": ~_yes(F.col("keeps_nothing")),
            "PAGE_ERROR": F.col("page_error") > 0,
            "INTERACTION_NATIVE_API_TAMPERING": F.col("tampering") > 0,
        }
    )
    return out.select("session", "unanswered", "unasked", (F.size(failures) == 0).alias("passed"), joined(failures).alias("failures"))
