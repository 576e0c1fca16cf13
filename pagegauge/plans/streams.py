"""Queries on corpora and telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import extract as E
from ..operators import telemetry as L
from ..sources import readers
from ..streaming import jobs as S
from .fixtures import duck_with, spark_rows as rows


def contract_scan(s, d):
    """Contracts written as JSON from the given pages, then read with a fixed schema."""
    path = readers.shared_path(s, "contracts")
    links = E.extract_links(rows(s, d, "pages"))
    nodes = F.transform("links", lambda x: F.struct(F.lit("link").alias("role"), x["text"].alias("name"), F.create_map(F.lit("disabled"), F.lit("false"), F.lit("zzz"), F.lit("1")).alias("properties")))
    links.groupBy("page_id", "viewport").agg(F.array_sort(F.collect_list(F.struct("ordinal", "href", "text"))).alias("links")).withColumn("axNodes", nodes).write.json(path)
    return readers.load_contracts(s, path, multi_line=False)


def contracts(s, d):
    rows_ = contract_scan(s, d)
    return rows_.select("page_id", "viewport", F.posexplode("links").alias("ordinal", "l")).select("page_id", "viewport", F.col("ordinal").cast("long").alias("ordinal"), "l.href", "l.text")


def ax(s, d):
    out = E.ax_nodes(contract_scan(s, d))
    return out.withColumn("states", F.array_join(F.transform("states", lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))


def tokens(s, d):
    return rows(s, d, "benchmark").select(F.col("item_id").alias("token_id"), F.col("text").alias("token"))


def findings(s, d):
    return C.contamination_findings(rows(s, d, "files"), tokens(s, d))


def retention(s, d):
    e = rows(s, d, "telemetry")
    return C.retention_audit(e.select("seq", F.when(F.col("seq") % 3 == 0, F.concat(F.lit('{"idem_key": "'), F.col("idem_key"), F.lit('", "n": 1}'))).when(F.col("seq") % 3 == 1, F.concat(F.lit('{"note": "'), F.col("idem_key"), F.lit('"}'))).otherwise(F.lit('{"count": 2}')).alias("json")))


#: Documents with and without copy that discloses what they are.
DISCLOSED = "text || CASE doc_id % 5 WHEN 0 THEN ' This simulation is not the original website.' WHEN 1 THEN ' The official simulation.' WHEN 2 THEN ' A simulation.' WHEN 3 THEN ' A simulation, not the original, but genuine.' ELSE '' END"

QUERIES = {
    "contract_scan": contracts,
    "ax_nodes": ax,
    "redact_corpus": lambda s, d: C.redact_corpus(rows(s, d, "documents")),
    "pii_findings": lambda s, d: C.pii_findings(rows(s, d, "documents")),
    "credential_carriers": lambda s, d: C.credential_carriers(rows(s, d, "documents")),
    "disclosure_copy": lambda s, d: C.disclosure_copy(rows(s, d, "documents").withColumn("text", F.expr(DISCLOSED))),
    "sanitize_pages": lambda s, d: C.sanitize_pages(rows(s, d, "pages")),
    "sanitize_counts": lambda s, d: C.sanitize_counts(C.sanitize_pages(rows(s, d, "form_pages"))),
    "tree_digest": lambda s, d: C.tree_digest(rows(s, d, "files")),
    "evidence_inventory": lambda s, d: C.evidence_inventory(rows(s, d, "files"), 45, 16 << 20, 100 << 20, 4096),
    "verify_manifest": lambda s, d: C.verify_manifest(rows(s, d, "files"), rows(s, d, "files_actual")),
    "contamination_tokens": lambda s, d: C.contamination_tokens(rows(s, d, "files"), tokens(s, d)),
    "contamination_scan": lambda s, d: C.contamination_scan(rows(s, d, "files")),
    "contamination_findings": findings,
    "contamination_verdict": lambda s, d: C.contamination_verdict(rows(s, d, "files"), findings(s, d)),
    "retention_audit": retention,
    "blocked_requests": lambda s, d: L.blocked_requests(rows(s, d, "telemetry")),
    "capturable_assets": lambda s, d: L.capturable_assets(rows(s, d, "telemetry")),
    "prohibited_reads": lambda s, d: L.prohibited_reads(rows(s, d, "telemetry"), rows(s, d, "telemetry").where("session % 4 = 0")),
    "telemetry_counts": lambda s, d: L.telemetry_counts(rows(s, d, "telemetry")),
    "attempt_gates": lambda s, d: L.attempt_gates(rows(s, d, "telemetry")),
    "attribute_phase": lambda s, d: L.attribute_phase(rows(s, d, "telemetry")),
    "payload_equivalence": lambda s, d: L.payload_equivalence(rows(s, d, "telemetry")),
    "layout_stability": lambda s, d: L.layout_stability(rows(s, d, "telemetry")),
    "retain_events": lambda s, d: L.retain_events(rows(s, d, "telemetry")),
    "interaction_gates": lambda s, d: L.interaction_gates(rows(s, d, "telemetry")),
    "storage_delta": lambda s, d: L.storage_delta(rows(s, d, "telemetry").where("seq % 10 <> 0"), rows(s, d, "telemetry")),
    "lifecycle_balance": lambda s, d: L.lifecycle_balance(rows(s, d, "telemetry")),
    "quiescence": lambda s, d: L.quiescence(rows(s, d, "telemetry")),
    "idempotent_receipts": lambda s, d: L.idempotent_receipts(rows(s, d, "telemetry")),
    "persistence_pairs": lambda s, d: L.persistence_pairs(rows(s, d, "telemetry")),
    "stream_bounded_counters": lambda s, d: S.run_to_table(S.bounded_counters(S.telemetry_stream(s, d)), "update", readers.shared_path(s, "stream"), ["session", "kind"]),
    "stream_receipts": lambda s, d: S.run_to_table(S.idempotent_intake(S.telemetry_stream(s, d)), "append", readers.shared_path(s, "stream"), None),
}

_T = duck_with("telemetry")
_HITS, _x = [], "coalesce(text, '')"
for _name, _p, _to in C.REDACTIONS:
    _q = _p.replace("'", "''")
    _HITS.append(f"len(regexp_extract_all({_x}, '{_q}')) AS n_{_name}")
    _x = f"regexp_replace({_x}, '{_q}', '{_to.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2')}', 'g')"
_SAN, _h = [], "coalesce(html, '')"
for _name, _p, _to in C.SANITISE:
    _SAN.append(f"len(regexp_extract_all({_h}, '{_p}')) AS n_{_name}")
    _h = f"regexp_replace({_h}, '{_p}', '{_to}', 'g')"
_FLAGS = f"""[CASE WHEN lower(regexp_extract(path, '[.]([A-Za-z0-9]+)$', 1)) IN ({", ".join(f"'{e}'" for e in C.EXTENSIONS)}) THEN 'extension' END, CASE WHEN {" OR ".join(f"starts_with(hex(encode(content)), '{m}')" for m in C.MAGIC.values())} THEN 'signature' END,
  CASE WHEN contains(content, chr(0)) THEN 'nul_byte' END, CASE WHEN contains(content, 'data:image') THEN 'data_uri' END, CASE WHEN regexp_matches(content, 'iVBORw0KGgo|/9j/4AAQ|R0lGODlh') THEN 'base64_image' END, CASE WHEN strlen(content) > 5242880 THEN 'oversize' END,
  CASE WHEN len(regexp_extract_all(content, '[#*$%&|<>]')) > 20 THEN 'symbols' END, CASE WHEN len(list_filter(string_split(content, chr(10)), lambda l: length(l) >= 1000)) > 0 THEN 'long_line' END]"""
_PLAIN = C.DATA_URI.replace("*+", "*").replace("++", "+")
_WHEN = lambda c, kind, location, detail, n="1": f"CASE WHEN {c} THEN {{'kind': '{kind}', 'location': '{location}', 'detail': {detail}, 'n': {n}::BIGINT}} END"
_WHOLE = "regular AND n_bytes <= 5242880"
_MAGIC = "CASE " + " ".join(f"WHEN regexp_matches(head, '^{p}') THEN '{k}'" for k, p in C.SIGNATURES) + " END"
_CODE = "CASE " + " ".join(f"WHEN contains(content, '{p}') THEN '{p}'" for p in C.ENCODED) + " END"
_SCAN = f""", e AS (SELECT *, starts_with(mode, '100') AS regular, strlen(content)::BIGINT AS n_bytes, substr(hex(encode(content)), 1, 24) AS head, lower(regexp_extract(path, '{C.SUFFIX}', 1)) AS suffix
  FROM (SELECT tree, coalesce(path, '') AS path, coalesce(mode, '100644') AS mode, coalesce(content, '') AS content FROM files) WHERE NOT regexp_matches(path, '{C.SKIPPED}')),
  dirs AS (SELECT DISTINCT tree, array_to_string(p[1:i], '/') AS path, p[i] AS name FROM (SELECT tree, p, unnest(range(1, len(p))) AS i FROM (SELECT tree, string_split(path, '/') AS p FROM e))),
  k AS (SELECT item_id AS token_id, lower(text) AS token, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS c FROM benchmark WHERE length(text) >= 5),
  sought AS (SELECT tree, path, 'path' AS location, path AS t FROM dirs UNION SELECT tree, path, 'path', path FROM e UNION ALL SELECT tree, path, 'content', content FROM e WHERE {_WHOLE} AND path <> 'evals/targets.json'),
  low AS (SELECT tree, path, location, lower(t) AS t, regexp_replace(lower(t), '[^a-z0-9]+', '', 'g') AS c FROM sought),
  found AS (SELECT tree, path, f.kind AS kind, f.location AS location, f.detail AS detail, f.n AS n FROM (SELECT tree, path, unnest([
    {_WHEN("starts_with(mode, '120')", "symlink", "path", "''")}, {_WHEN("NOT regular AND NOT starts_with(mode, '120')", "unsupported-entry", "path", "mode")},
    {_WHEN("regular AND suffix IN (" + ", ".join(f"'{x}'" for x in C.ASSETS) + ")", "prohibited-asset-extension", "path", "suffix")}, {_WHEN("regular AND n_bytes > 5242880", "file-too-large", "content", "n_bytes::VARCHAR")},
    {_WHEN(f"{_WHOLE} AND length(head) >= 8 AND {_MAGIC} IS NOT NULL", "prohibited-binary-magic", "content", _MAGIC)}, {_WHEN(f"{_WHOLE} AND contains(content, chr(0))", "unexpected-binary-content", "content", "''")},
    {_WHEN(f"{_WHOLE} AND regexp_matches(content, '{_PLAIN}')", "embedded-image-data-uri", "content", "''", f"len(regexp_extract_all(content, '{_PLAIN}'))")}, {_WHEN(f"{_WHOLE} AND {_CODE} IS NOT NULL", "base64-image-signature", "content", _CODE)}]) AS f FROM e) WHERE f IS NOT NULL
  UNION ALL SELECT tree, path, 'benchmark-token', location, token_id::VARCHAR, 1 FROM low, k WHERE CASE WHEN k.c = '' THEN contains(low.t, k.token) ELSE contains(low.c, k.c) END
  UNION ALL SELECT tree, path, 'prohibited-generated-directory', 'path', '', 1 FROM dirs WHERE lower(name) IN ({", ".join(f"'{x}'" for x in C.GENERATED)}))"""
_PH = "SELECT session, seq, kind, amount, ts, coalesce(last_value(phase IGNORE NULLS) OVER (PARTITION BY session ORDER BY ts, seq), -1) AS phase FROM telemetry"
_DIRS = "SELECT DISTINCT tree, array_to_string(p[1:i], '/') AS path FROM (SELECT tree, p, unnest(range(1, len(p))) AS i FROM (SELECT tree, string_split(path, '/') AS p FROM {0}))"

ORACLES = {
    "contract_scan": duck_with("links") + "SELECT page_id, viewport, ordinal, href, text FROM links",
    "ax_nodes": duck_with("links") + "SELECT page_id, viewport, ordinal, 'link' AS role, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS name, 'disabled=false' AS states FROM links",
    "redact_corpus": f"SELECT doc_id, {', '.join(_HITS)}, {_x} AS redacted FROM documents",
    "pii_findings": f"""SELECT source, lang, kind, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_docs FROM (SELECT source, lang, unnest(['email', 'international_phone', 'formatted_phone']) AS kind, unnest([len(regexp_extract_all(text, '{C.EMAIL}')), len(regexp_extract_all(text, '{C.PHONE}')), len(regexp_extract_all(text, '{C.FORMATTED_PHONE}'))]) AS n FROM documents) WHERE n > 0 GROUP BY ALL""",
    "credential_carriers": """SELECT doc_id, lower(key) AS key, CAST(length(value) AS INTEGER) AS value_length, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{0}', 1)) AS key, unnest(regexp_extract_all(text, '{0}', 2)) AS value FROM documents) GROUP BY ALL""".format(C.CARRIER.replace("'", "''")),
    "disclosure_copy": f"SELECT *, has_notice AND negated AND NOT claims AS accepted FROM (SELECT doc_id, regexp_matches(t, '{C.NOTICE}') AS has_notice, regexp_matches(t, '{C.NEGATION}') AS negated, regexp_matches(regexp_replace(t, '{C.NEGATION}', ' ', 'g'), '{C.CLAIM}') AS claims FROM (SELECT doc_id, lower({DISCLOSED}) AS t FROM documents))",
    "sanitize_pages": f"SELECT page_id, {', '.join(_SAN)}, {_h} AS html FROM pages",
    "sanitize_counts": duck_with("form_pages") + f"SELECT step, count(*) FILTER (n > 0) AS n_pages, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest([{', '.join(repr(x[0]) for x in C.SANITISE)}]) AS step, unnest([{', '.join('n_' + x[0] for x in C.SANITISE)}]) AS n FROM (SELECT {', '.join(_SAN)} FROM form_pages)) GROUP BY step",
    "tree_digest": duck_with("files") + "SELECT tree, count(*) AS n_files, CAST(sum(strlen(content)) AS BIGINT) AS n_bytes, sha256(string_agg(line, chr(0) ORDER BY line)) AS digest FROM (SELECT tree, content, path || chr(0) || mode || chr(0) || sha256(content) AS line FROM files) GROUP BY tree",
    "evidence_inventory": duck_with("files") + "SELECT tree, n_files, n_bytes, n_text, n_omitted, concat_ws(',', CASE WHEN n_files > 45 THEN 'too_many_files' END, CASE WHEN largest > 16777216 THEN 'file_too_large' END, CASE WHEN n_bytes > 104857600 THEN 'total_too_large' END) AS violations FROM (SELECT tree, count(*) AS n_files, CAST(sum(strlen(content)) AS BIGINT) AS n_bytes, count(*) FILTER (strlen(content) <= 4096) AS n_text, count(*) FILTER (strlen(content) > 4096) AS n_omitted, max(strlen(content)) AS largest FROM files GROUP BY tree)",
    "verify_manifest": duck_with("files_actual") + f""", td AS ({_DIRS.format('files')}), ad AS ({_DIRS.format('files_actual')}) SELECT * FROM (SELECT coalesce(t.tree, a.tree) AS tree, coalesce(t.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'missing' WHEN t.path IS NULL THEN 'unexpected' WHEN sha256(t.content) <> sha256(a.content) THEN 'content' WHEN t.mode <> a.mode THEN 'mode' END AS problem
      FROM files t FULL OUTER JOIN files_actual a ON t.tree = a.tree AND t.path = a.path) WHERE problem IS NOT NULL UNION ALL SELECT tree, path, 'directory_missing' FROM (SELECT * FROM td EXCEPT SELECT * FROM ad) UNION ALL SELECT tree, path, 'directory_unexpected' FROM (SELECT * FROM ad EXCEPT SELECT * FROM td)""",
    "contamination_tokens": """WITH k AS (SELECT item_id AS token_id, lower(text) AS token, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS c FROM benchmark WHERE length(text) >= 5),
      p AS (SELECT doc_id, unnest([text, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt']) AS part FROM documents), f AS (SELECT doc_id, lower(part) AS t, regexp_replace(lower(part), '[^a-z0-9]+', '', 'g') AS c FROM p)
      SELECT DISTINCT doc_id, token_id FROM f, k WHERE CASE WHEN k.c = '' THEN contains(f.t, k.token) ELSE contains(f.c, k.c) END""",
    "contamination_scan": duck_with("files") + f"SELECT kind, count(*) AS n_files FROM (SELECT unnest({_FLAGS}) AS kind FROM files) WHERE kind IS NOT NULL GROUP BY kind",
    "contamination_findings": duck_with("files") + _SCAN + " SELECT * FROM found",
    "contamination_verdict": duck_with("files") + _SCAN + f""" SELECT *, n_findings = 0 AS passed FROM (SELECT tree, sum(f)::BIGINT AS n_files, sum(b)::BIGINT AS n_bytes, sum(n)::BIGINT AS n_findings FROM (
      SELECT tree, regular::BIGINT AS f, CASE WHEN {_WHOLE} THEN n_bytes ELSE 0 END AS b, 0 AS n FROM e UNION ALL SELECT tree, 0, 0, 0 FROM files UNION ALL SELECT tree, 0, 0, n FROM found) GROUP BY tree)""",
    "retention_audit": _T + """, j AS (SELECT seq, CASE seq % 3 WHEN 0 THEN '{"idem_key": "' || idem_key || '", "n": 1}' WHEN 1 THEN '{"note": "' || idem_key || '"}' ELSE '{"count": 2}' END AS json FROM telemetry)
      SELECT * FROM (SELECT seq, len(regexp_extract_all(json, 'synthetic-[0-9]+')) AS n_values, coalesce(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(json, '"([A-Za-z_]+)" *:', 1), lambda k: k IN ('value', 'text', 'idem_key', 'password')))), ','), '') AS keys FROM j) WHERE n_values > 0 OR keys <> ''""",
    "blocked_requests": _T + "SELECT session, seq, method, kind FROM telemetry WHERE method NOT IN ('GET', 'HEAD', 'OPTIONS')",
    "capturable_assets": _T + "SELECT session, seq, resource_type FROM telemetry WHERE resource_type IN ('stylesheet', 'image', 'font', 'media') OR kind = 'request_finished' AND resource_type = 'script'",
    "prohibited_reads": _T + "SELECT session, seq, resource_type FROM telemetry WHERE kind = 'external_read' AND NOT (resource_type IN ('font', 'image', 'media', 'stylesheet') AND session IN (SELECT session FROM telemetry WHERE session % 4 = 0))",
    "telemetry_counts": _T + "SELECT session, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in L.KINDS) + ", " + ", ".join(f"count(*) FILTER (kind = 'request_failed' AND resource_type = '{t}' AND method = 'GET') AS failed_{t}" for t in L.TYPES) + " FROM telemetry GROUP BY session",
    "attempt_gates": _T + f"SELECT session, [{', '.join(repr(a + '-attempt') for a in L.ATTEMPTS)}][attempt + 1] AS code, count(*) AS n FROM telemetry GROUP BY ALL",
    "attribute_phase": _T + f"SELECT session, seq, phase FROM ({_PH})",
    "payload_equivalence": _T + f"SELECT session, count(*) FILTER (phase = 0) AS n_ui, count(*) FILTER (phase = 1) AS n_retry, coalesce(string_agg(kind || ':' || amount, '|' ORDER BY seq) FILTER (phase = 0), '') = coalesce(string_agg(kind || ':' || amount, '|' ORDER BY seq) FILTER (phase = 1), '') AS same FROM ({_PH}) WHERE phase IN (0, 1) GROUP BY session",
    "layout_stability": _T + "SELECT session, count(*) AS n, count(DISTINCT resource_type) FILTER (rn <= 3) = 1 AND count(*) = 4 AS stable FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, seq DESC) AS rn FROM telemetry) WHERE rn <= 4 GROUP BY session",
    "retain_events": _T + f"SELECT session, seq, kind, total, total > lim AS truncated FROM (SELECT *, CASE kind {' '.join(f'WHEN {k!r} THEN {v}' for k, v in L.LIMITS.items())} END AS lim, row_number() OVER (PARTITION BY session, kind ORDER BY ts, seq) AS rn, count(*) OVER (PARTITION BY session, kind) AS total FROM telemetry) WHERE rn <= lim",
    "interaction_gates": _T + "SELECT *, failures = '' AS passed FROM (SELECT *, concat_ws(',', CASE WHEN n_writes <> 2 THEN 'write_count' END, CASE WHEN n_keys <> 1 THEN 'key_count' END, CASE WHEN n_failed > 0 THEN 'blocked' END) AS failures FROM (SELECT session, count(*) FILTER (kind = 'write_attempt') AS n_writes, count(DISTINCT idem_key) FILTER (kind = 'write_attempt') AS n_keys, count(*) FILTER (kind = 'request_failed') AS n_failed FROM telemetry GROUP BY session))",
    "storage_delta": _T + ", a AS (SELECT session, list(DISTINCT resource_type) AS n, count(*) AS c FROM telemetry GROUP BY 1), b AS (SELECT session, list(DISTINCT resource_type) AS n, count(*) AS c FROM telemetry WHERE seq % 10 <> 0 GROUP BY 1) SELECT a.session, coalesce(array_to_string(list_sort(list_filter(a.n, lambda x: NOT list_contains(coalesce(b.n, []), x))), ','), '') AS added, a.c <> coalesce(b.c, 0) AS changed FROM a LEFT JOIN b USING (session)",
    "lifecycle_balance": _T + "SELECT session, started, finished, failed, coalesce(CAST(floor(epoch(l)) AS BIGINT) - CAST(floor(epoch(r)) AS BIGINT) >= 300, true) AS quiet, started = finished AND failed = 0 AND coalesce(CAST(floor(epoch(l)) AS BIGINT) - CAST(floor(epoch(r)) AS BIGINT) >= 300, true) AS balanced FROM (SELECT session, count(*) FILTER (kind = 'request_started') AS started, count(*) FILTER (kind = 'request_finished') AS finished, count(*) FILTER (kind = 'request_failed') AS failed, max(ts) AS l, max(ts) FILTER (starts_with(kind, 'request')) AS r FROM telemetry GROUP BY session)",
    "quiescence": _T + "SELECT session, burst, count(*) AS n, min(ts) AS first, max(ts) AS last FROM (SELECT session, ts, CAST(sum(fresh) OVER (PARTITION BY session ORDER BY ts, seq) AS BIGINT) AS burst FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY session ORDER BY ts, seq)) <= 300000000 THEN 0 ELSE 1 END AS fresh FROM telemetry)) GROUP BY session, burst",
    "idempotent_receipts": _T + "SELECT session, sha256(idem_key) AS key_hash, count(*) AS attempts, first(seq ORDER BY ts, seq) AS receipt FROM telemetry WHERE kind = 'write_attempt' GROUP BY session, idem_key",
    "persistence_pairs": _T + ", t AS (SELECT *, sum((kind = 'write_attempt')::INT) OVER (PARTITION BY session ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS writes FROM telemetry) SELECT a.session, a.seq, b.seq AS later, a.resource_type = b.resource_type AS same FROM t a JOIN t b ON a.session = b.session AND a.writes = b.writes - (b.kind = 'write_attempt')::INT AND epoch_us(b.ts) - epoch_us(a.ts) BETWEEN 60000000 AND 1800000000",
    "stream_bounded_counters": _T + "SELECT session, kind, count(*) AS total, count(*) > 3 AS truncated FROM telemetry GROUP BY session, kind",
    "stream_receipts": _T + "SELECT DISTINCT session, sha256(idem_key) AS key_hash FROM telemetry WHERE kind = 'write_attempt'",
}
