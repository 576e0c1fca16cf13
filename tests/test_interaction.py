"""Three logs of a session held against one another."""

from pagegauge.operators.interaction import interaction_rollup, match_logs

SESSIONS = "session long, origin string, endpoint string, unfilled long, has_submit boolean, email_off boolean, keeps_nothing boolean"
REQUESTS = "session long, seq long, phase string, method string, url string"
RECEIPTS = "session long, seq long, phase string, url string, status int, content_type string, id string, well_formed boolean, retained boolean"
PAYLOADS = "session long, seq long, phase string, metadata_digest string, content_digest string, canary boolean, header boolean, broken boolean"
AUDITS = "session long, seq long, attempts long, receipts long, keys long, well_formed boolean"
E = "https://a.example/s"


def logs(spark, **more):
    base = {
        "sessions": [(1, "https://a.example", E, 0, True, True, True)],
        "requests": [(1, 1, "submission", "POST", E), (1, 2, "retry", "POST", E), (1, 3, "submission", "POST", "https://b.example/s"), (None, 4, "submission", "POST", E)],
        "receipts": [(1, 1, "submission", E, 201, "application/json", "r", True, False), (1, 2, "retry", E, 200, "application/json", "r", True, False), (1, 3, "lookup", E + "/r", 200, "application/json", "r", True, False)],
        "payloads": [(1, 1, "submission", "m", "c", True, True, False), (1, 2, "retry", "m", "c", True, True, False)],
        "audits": [(1, 1, 1, 1, 1, True), (1, 2, 2, 1, 1, True)],
        "events": [(1, "focus")],
    }
    kinds = {"sessions": SESSIONS, "requests": REQUESTS, "receipts": RECEIPTS, "payloads": PAYLOADS, "audits": AUDITS, "events": "session long, kind string"}
    return [spark.createDataFrame(more.get(n, base[n]), kinds[n]) for n in base]


def result(spark, **more):
    return tuple(interaction_rollup(*logs(spark, **more)).first())[1:]


def test_clean(spark):
    assert result(spark) == (0, 0, True, "")


def test_repeated_receipt_and_lost_audit(spark):
    good = (1, 1, "submission", E, 201, "application/json", "r", True, False)
    rest = [(1, 2, "retry", E, 200, "application/json", "r", True, False), (1, 3, "lookup", E, 200, "application/json", "r", True, False)]
    assert result(spark, receipts=[good, (1, 9, *good[2:]), *rest]) == (0, 1, True, "")
    assert result(spark, receipts=[(1, 9, *good[2:]), (1, 1, "submission", E, 500, "application/json", "r", True, False), *rest])[3] == "INVALID_SUBMISSION_RECEIPT"
    assert result(spark, audits=[(1, 1, 1, 1, 1, True)])[3] == "BACKEND_AUDIT_CONTRACT_FAILED"
    assert result(spark, audits=[])[3] == "BACKEND_AUDIT_CONTRACT_FAILED"


def test_nothing_recorded(spark):
    got = result(spark, sessions=[(1, None, None, None, None, None, None)], requests=[], receipts=[], payloads=[], audits=[], events=[])
    assert got[:3] == (0, 0, False) and len(got[3].split(",")) == 13


def test_left_over_on_either_side(spark):
    kind = "session long, phase string, url string, seq long"
    writes = spark.createDataFrame([(1, "a", "u", 5), (1, "a", "u", 7), (1, "a", None, 8), (2, "a", "u", 1)], kind)
    receipts = spark.createDataFrame([(1, "a", "u", 1), (1, "a", None, 2), (3, "a", "u", 1)], kind)
    got = {(r.session, r.url, r.n, r.write_seq, r.receipt_seq) for r in match_logs(writes, receipts).collect()}
    assert got == {(1, "u", 1, 5, 1), (1, "u", 2, 7, None), (1, None, 1, 8, 2), (2, "u", 1, 1, None), (3, "u", 1, None, 1)}
