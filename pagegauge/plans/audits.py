"""Queries on URLs, headers, forms and inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as E
from ..operators import geometry as M
from ..operators import urls as U
from .fixtures import duck_with, spark_rows as rows
from .scores import _sweep


def refs(s, d):
    return E.extract_links(rows(s, d, "pages")).select("page_id", F.when(F.col("ordinal") % 3 == 0, F.concat(F.lit("https://cdn.example.net"), F.col("href"), F.lit("#top"))).when(F.col("ordinal") % 3 == 1, F.concat(F.lit("https://other.example.org"), F.col("href"))).otherwise(F.col("href")).alias("target"))


def resources(s, d):
    return E.extract_links(rows(s, d, "pages")).where("page_id % 2 = 0").select(F.concat(F.lit("https://cdn.example.net"), F.col("href")).alias("url")).distinct()


def audit(s, d):
    a = rows(s, d, "audit_urls")
    r = rows(s, d, "rects")
    return U.integrity_audit(
        external_target=U.classify_targets(a).where("target <> 'same_origin'"),
        private_destination=U.private_destinations(a),
        credential_url=U.credential_url_audit(a),
        inventory_mismatch=U.reconcile_inventories(rows(s, d, "assets"), rows(s, d, "assets_graph"), rows(s, d, "assets_dom")),
        evidence_invalid=U.validate_evidence(rows(s, d, "evidence")),
        policy_weak=U.security_headers(rows(s, d, "headers")).where("not strict"),
        disclosure_not_persistent=U.disclosure_persistence(rows(s, d, "samples")).where("not persistent"),
        surface_covers_page=M.covered_pages(r),
    )


QUERIES = {
    "classify_targets": lambda s, d: U.classify_targets(rows(s, d, "audit_urls")),
    "private_destinations": lambda s, d: U.private_destinations(rows(s, d, "audit_urls")),
    "numeric_destinations": lambda s, d: U.private_destinations(rows(s, d, "numeric_urls")),
    "credential_url_audit": lambda s, d: U.credential_url_audit(rows(s, d, "audit_urls")),
    "reconcile_inventories": lambda s, d: U.reconcile_inventories(rows(s, d, "assets"), rows(s, d, "assets_graph"), rows(s, d, "assets_dom")),
    "external_assets": lambda s, d: U.external_assets(rows(s, d, "audit_urls"), rows(s, d, "audit_urls").where("page_id % 3 = 0"), rows(s, d, "pages").select("page_id", "url", F.lit("https://site.example.com").alias("allowed"))),
    "localize_refs": lambda s, d: U.localize_refs(refs(s, d), resources(s, d)),
    "security_headers": lambda s, d: U.security_headers(rows(s, d, "headers")),
    "validate_evidence": lambda s, d: U.validate_evidence(rows(s, d, "evidence")),
    "disclosure_persistence": lambda s, d: U.disclosure_persistence(rows(s, d, "samples")),
    "unsafe_forms": lambda s, d: U.unsafe_forms(rows(s, d, "controls")),
    "unsafe_hidden_values": lambda s, d: U.unsafe_hidden_values(rows(s, d, "controls")),
    "integrity_audit": audit,
}

_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([\\[][^\\]/?#]*[\\]]|[^/?#:@]+)', 1))"
_ORIGIN = f"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || {_HOST} || CASE WHEN regexp_extract(url, '^[A-Za-z]+://(?:[^/?#@]*@)?[^/?#:@]+(:[0-9]+)', 1) IN ('', ':80', ':443') THEN '' ELSE regexp_extract(url, '^[A-Za-z]+://(?:[^/?#@]*@)?[^/?#:@]+(:[0-9]+)', 1) END"
_TARGET = f"CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@') OR NOT regexp_matches(lower(url), '^https?://') THEN 'unsafe' WHEN {_ORIGIN} = 'https://site.example.com' THEN 'same_origin' ELSE 'external' END"
_RANGES = ", ".join(f"({i}, '{n}', {a}, {b})" for i, (n, a, b) in enumerate(U.reserved_ranges()))
_PRIVATE = f"""SELECT page_id, host, reason FROM (SELECT page_id, host, coalesce(r.name, CASE WHEN regexp_matches(host, '(^|[.])({"|".join(U.SUFFIXES)})$') THEN 'suffix' WHEN ip IS NULL AND NOT contains(host, '.') THEN 'dotless' END) AS reason
  FROM (SELECT *, CASE WHEN regexp_full_match(host, '([0-9]+[.]){{3}}[0-9]+') THEN (split_part(host, '.', 1)::BIGINT * 256 + split_part(host, '.', 2)::BIGINT) * 65536 + split_part(host, '.', 3)::BIGINT * 256 + split_part(host, '.', 4)::BIGINT END AS ip FROM (SELECT page_id, {_HOST} AS host FROM audit_urls)) h
  LEFT JOIN (VALUES {_RANGES}) AS r(i, name, a, b) ON ip BETWEEN a AND b) WHERE reason IS NOT NULL"""
_DEC = lambda c: f"url_decode(url_decode(url_decode(url_decode({c}))))"
_CAMEL = lambda c: f"regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
_IS = lambda c, pattern: "regexp_matches(" + c + ", '" + pattern.replace("'", "''") + "')"
_INNER = """list_filter(list_transform(regexp_extract_all(x.v, '{0}', 1), lambda y: regexp_replace(y, '[),.;]+$', '')), lambda y: regexp_matches(y, '(?i)^(?:https?:)?//[^/?#]'))""".format(U.EMBEDDED.replace("'", "''"))
_SEGMENT = f"""CASE WHEN {_IS("s", U.ENCODED)} OR length(s) > {U.LONGEST} THEN 'path_encoded' WHEN {_IS("s", U.EMAIL)} THEN 'email' WHEN {_IS("s", U.PHONE)} THEN 'phone' WHEN {_IS("s", U.JWT)} THEN 'path_jwt' WHEN {_IS("s", U.API_KEY)} THEN 'path_api_key'
  WHEN {_IS("s", U.INLINE)} AND NOT {_IS(f"regexp_extract(s, '{U.INLINE}', 1)", U.UUID)} THEN 'path_named' WHEN {_IS("s", U.MARKER)} AND length(coalesce(seg[i + 1], '')) >= 8 AND NOT {_IS("coalesce(seg[i + 1], '')", U.UUID)} THEN 'path_marker' END"""
_PARAM = f"""CASE WHEN {_IS("x.n", U.ENCODED)} OR {_IS(_CAMEL("x.n"), U.SENSITIVE)} THEN 'parameter' WHEN {_IS("x.v", U.ENCODED)} THEN 'value_encoded' WHEN x.l > {U.LONGEST} THEN 'value_long' WHEN {_IS(_CAMEL("x.v"), U.CARRIER)} THEN 'carrier'
  WHEN {_IS("x.v", U.EMAIL)} THEN 'email' WHEN {_IS("x.v", U.PHONE)} THEN 'phone' WHEN len({_INNER}) > {U.MOST} THEN 'too_many' WHEN level = 4 AND len({_INNER}) > 0 THEN 'too_deep' END"""
_CRED = f"""SELECT page_id, level, issue FROM (SELECT page_id, level, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@') THEN 'userinfo' ELSE coalesce(
    list_filter(list_transform(seg, lambda s, i: {_SEGMENT}), lambda z: z IS NOT NULL)[1], list_filter(list_transform(params, lambda x: {_PARAM}), lambda z: z IS NOT NULL)[1],
    CASE WHEN f <> '' AND ({_IS("f", U.ENCODED)} OR length(f) > {U.LONGEST} OR {_IS(_CAMEL("f"), U.CARRIER)} OR {_IS("f", U.EMAIL)} OR {_IS("f", U.PHONE)}) THEN 'fragment' END) END AS issue
  FROM (SELECT *, list_transform(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: {_DEC("s")}) AS seg, {_DEC("regexp_extract(url, '#(.*)$', 1)")} AS f FROM lv)) WHERE issue IS NOT NULL"""
_HALF = lambda c: f"replace({c}, '+', ' ')"
_PARAMS = f"""list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'), lambda p: p <> ''), lambda p: {{{{'n': {_DEC(_HALF("split_part(p, '=', 1)"))}, 'v': {_DEC(_HALF("CASE WHEN contains(p, '=') THEN substr(p, strpos(p, '=') + 1) ELSE '' END"))},
  'l': length(CASE WHEN contains(p, '=') THEN substr(p, strpos(p, '=') + 1) ELSE '' END)}}}})""".replace("{{", "{").replace("}}", "}")
_LEVELS = f""", lv(page_id, url, level, params) AS (SELECT page_id, url, 0, {_PARAMS} FROM audit_urls UNION ALL SELECT page_id, url, level, {_PARAMS} FROM (
  SELECT page_id, level, CASE WHEN starts_with(y, '//') THEN 'https:' || y ELSE y END AS url FROM (SELECT page_id, level + 1 AS level, unnest(flatten(list_transform(params, lambda x: {_INNER}))) AS y FROM lv WHERE level < 4)))"""
_SIDES = {"response": "assets", "graph": "assets_graph", "dom": "assets_dom"}
_RECON = " UNION ALL ".join(f"SELECT DISTINCT page_id, path, '{a}_not_{b}' AS reason FROM {_SIDES[a]} x WHERE NOT EXISTS (SELECT 1 FROM {_SIDES[b]} y WHERE y.page_id = x.page_id AND y.path = x.path)" for a in _SIDES for b in _SIDES if a != b)
_EVID = """SELECT page_id, violation FROM (SELECT page_id, unnest([CASE WHEN retained > lim THEN 'retained_over_limit' END, CASE WHEN NOT truncated AND retained <> total THEN 'retained_not_total' END, CASE WHEN truncated AND retained >= total THEN 'truncated_without_loss' END,
  CASE WHEN ratio IS NULL THEN 'ratio_missing' END, CASE WHEN ratio NOT BETWEEN 0 AND 1 THEN 'ratio_out_of_range' END, CASE WHEN viewport <> expected THEN 'viewport_mismatch' END]) AS violation FROM evidence) WHERE violation IS NOT NULL"""
_DIR = list(U.DIRECTIVES)
_ONCE = lambda d: f"coalesce(max(mode) FILTER (name = '{d}' AND n = 1), '')"
_STRICT = " AND ".join(
    [f"{_ONCE(d)} IN ('self', 'none')" for d in U.SELF_OR_NONE]
    + [f"{_ONCE(d)} = 'none'" for d in U.NONE]
    + [f"count(*) FILTER (name = '{d}' AND NOT (n = 1 AND mode IN ('self', 'none'))) = 0" for d in U.OPTIONAL]
)
_HEAD = f"""SELECT h.page_id, CASE WHEN upper(frame_options) IN ('DENY', 'SAMEORIGIN') THEN lower(frame_options) WHEN frame_options = '' THEN 'missing' ELSE 'other' END AS frame, has_refresh, coalesce(n_policies, 0) AS n_policies,
  {", ".join(f"coalesce({d.replace('-', '_')}, '') AS {d.replace('-', '_')}" for d in _DIR)}, coalesce(strict, false) AS strict, coalesce(duplicated, false) AS duplicated FROM headers h LEFT JOIN (
  SELECT page_id, count(*) AS n_policies, {", ".join(f"array_to_string(list_sort(list(DISTINCT {d.replace('-', '_')}) FILTER ({d.replace('-', '_')} IS NOT NULL)), ',') AS {d.replace('-', '_')}" for d in _DIR)},
  bool_or(strict) AS strict, bool_or(twice) AS duplicated FROM (
  SELECT page_id, policy, bool_or(n > 1) AS twice, {_STRICT} AS strict, {", ".join(f"max(mode) FILTER (name = '{d}') AS {d.replace('-', '_')}" for d in _DIR)} FROM (
  SELECT page_id, policy, name, count(*) AS n, arg_min(CASE value WHEN '''none''' THEN 'none' WHEN '''self''' THEN 'self' ELSE 'other' END, i) AS mode FROM (
  SELECT page_id, policy, i, regexp_extract(part, '^([a-z-]+)', 1) AS name, trim(regexp_replace(part, '^[a-z-]+', '')) AS value FROM (
  SELECT page_id, policy, unnest(range(len(ps))) AS i, trim(unnest(ps)) AS part FROM (SELECT page_id, policy, string_split(t, ';') AS ps FROM (SELECT page_id, unnest(range(len(cs))) AS policy, unnest(cs) AS t FROM (SELECT page_id, string_split(lower(csp), ',') AS cs FROM headers)))))
  WHERE name IN ({", ".join(f"'{d}'" for d in _DIR)}) GROUP BY page_id, policy, name) GROUP BY page_id, policy) GROUP BY page_id) p ON p.page_id = h.page_id"""
_DISC = """SELECT page_id, n_variants, 8 - n_variants AS missing, hidden, n_variants = 8 AND complete AND hidden = 0 AS persistent FROM (SELECT page_id, count(*) AS n_variants, count(*) FILTER (NOT shown) AS hidden, bool_and(n = 3) AS complete FROM
  (SELECT page_id, variant, count(*) AS n, bool_and(visible AND NOT occluded AND environment = variant) AS shown FROM samples GROUP BY page_id, variant) GROUP BY page_id)"""
_AUDIT = {
    "external_target": f"SELECT page_id FROM audit_urls WHERE {_TARGET} <> 'same_origin'", "private_destination": _PRIVATE, "credential_url": _CRED, "inventory_mismatch": _RECON, "evidence_invalid": _EVID,
    "policy_weak": f"SELECT * FROM ({_HEAD}) WHERE NOT strict", "disclosure_not_persistent": f"SELECT * FROM ({_DISC}) WHERE NOT persistent", "surface_covers_page": f"SELECT * FROM ({_sweep('rects')}) WHERE area / 2000000.0 >= 0.8",
}
_REFS = "SELECT page_id, CASE WHEN ordinal % 3 = 0 THEN 'https://cdn.example.net' || href || '#top' WHEN ordinal % 3 = 1 THEN 'https://other.example.org' || href ELSE href END AS target FROM links"

ORACLES = {
    "classify_targets": duck_with("audit_urls") + f"SELECT page_id, url, {_TARGET} AS target FROM audit_urls",
    "private_destinations": duck_with("audit_urls") + _PRIVATE,
    # Ranges are known from how the hosts are made.
    "numeric_destinations": duck_with("numeric_urls")
    + """, known(kind, reason) AS (VALUES (0, '127.0.0.0/8'), (1, '127.0.0.0/8'), (2, '127.0.0.0/8'), (3, '10.0.0.0/8'), (4, '192.168.0.0/16'), (7, '172.16.0.0/12'))
    SELECT page_id, lower(regexp_extract(url, '//([^:/]+)', 1)) AS host, reason FROM numeric_urls JOIN known ON kind = page_id % 8""",
    "credential_url_audit": duck_with("audit_urls") + _LEVELS + _CRED,
    "reconcile_inventories": duck_with("assets", "assets_graph", "assets_dom") + _RECON,
    "external_assets": duck_with("audit_urls") + f"SELECT DISTINCT page_id, url, {_TARGET} AS target FROM (SELECT page_id, url FROM audit_urls UNION SELECT page_id, url FROM pages)",
    "localize_refs": duck_with("links") + f""", res AS (SELECT DISTINCT 'https://cdn.example.net' || href AS url FROM links WHERE page_id % 2 = 0) SELECT page_id, target, coalesce(substr(sha256(a.url), 1, 20) || '.bin', substr(sha256(b.url), 1, 20) || '.bin', CASE WHEN regexp_matches(target, '^https?://') THEN 'data:,' ELSE target END) AS local
      FROM ({_REFS}) r LEFT JOIN res a ON a.url = target LEFT JOIN res b ON b.url = regexp_replace(target, '#.*$', '')""",
    "security_headers": duck_with("headers") + _HEAD,
    "validate_evidence": duck_with("evidence") + _EVID,
    "disclosure_persistence": duck_with("samples") + _DISC,
    "unsafe_forms": duck_with("controls") + """SELECT page_id, ordinal, reason FROM (SELECT page_id, ordinal, unnest([CASE WHEN regexp_extract(form_action, '^([a-z]+://[^/?#]*)', 1) <> 'https://shop.example.com' THEN 'origin' END, CASE WHEN regexp_extract(form_action, '^[a-z]+://[^/?#]*([^?#]*)', 1) <> '/submit' THEN 'path' END,
      CASE WHEN regexp_matches(form_action, '[?#]') THEN 'query_or_fragment' END, CASE WHEN form_method <> 'post' THEN 'method' END, CASE WHEN form_enctype NOT IN ('multipart/form-data', 'application/x-www-form-urlencoded') THEN 'enctype' END]) AS reason FROM controls) WHERE reason IS NOT NULL""",
    "unsafe_hidden_values": duck_with("controls") + "SELECT page_id, ordinal, name, value_length FROM controls WHERE type = 'hidden' AND value_length > 0 AND value_length <> 9",
    "integrity_audit": duck_with("audit_urls", "assets", "assets_graph", "assets_dom", "evidence", "headers", "samples", "rects") + _LEVELS + ", f AS (" + " UNION ALL ".join(f"SELECT page_id, '{k}' AS code, count(*) AS evidence_count FROM ({q}) GROUP BY page_id" for k, q in _AUDIT.items()) + ") SELECT *, count(*) OVER (PARTITION BY page_id) AS n_codes FROM f",
}
