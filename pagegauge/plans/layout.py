"""Queries on what elements inherit, on what style sheets pull in under budgets, and on interactions."""

from __future__ import annotations

from ..operators import closure as C
from ..operators import interaction as I
from ..operators import visibility as V
from ..sources.readers import cut
from .fixtures import duck_with, spark_rows as rows

FLOWS = ("flows", "flow_requests", "flow_receipts", "flow_payloads", "flow_audits", "flow_events")
BUDGET = {"max_resources": 4, "max_requests": 6, "max_bytes": 150, "max_total": 400}


def sheets(s, d):
    """Edges are derived, and both other inputs come from them, so they are written first."""
    edges = cut(rows(s, d, "css_edges"), "edges")
    files = rows(s, d, "css_files", css_edges=edges)
    seeds = edges.where("src = '/c0.css'").select("page_id", "src").distinct().selectExpr("page_id", "src AS url", "0L AS n", "10L AS bytes")
    return C.css_budget_closure(edges, files, seeds, **BUDGET)


QUERIES = {
    "element_visibility": lambda s, d: V.element_visibility(rows(s, d, "styled_nodes")),
    "text_contrast": lambda s, d: V.text_contrast(rows(s, d, "styled_nodes")),
    "css_budget_closure": sheets,
    "interaction_rollup": lambda s, d: I.interaction_rollup(*[rows(s, d, n) for n in FLOWS]),
    "write_receipts": lambda s, d: I.match_logs(rows(s, d, "flow_requests").where("method <> 'GET'"), rows(s, d, "flow_receipts")),
}


def _linear(c: str) -> str:
    return f"(CASE WHEN ({c}) / 255.0 <= 0.04045 THEN ({c}) / 255.0 / 12.92 ELSE pow((({c}) / 255.0 + 0.055) / 1.055, 2.4) END)"


def _light(r: str, g: str, b: str) -> str:
    return f"0.2126 * {_linear(r)} + 0.7152 * {_linear(g)} + 0.0722 * {_linear(b)}"


# The SQL goes down from the roots, an element from its parent, and knows what the styles mean from how they are made.
ORACLES = {
    "element_visibility": duck_with("styled_nodes")
    + """, n AS (SELECT *, rule IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 19) OR height_px = 0 AND rule IN (6, 10, 19) AS off, coalesce(opacity, 1.0::DOUBLE) AS o,
        NOT is_root AND k % 5 < 2 AS across, NOT is_root AND k % 7 = 0 AS down, node * 0 - 1e9::DOUBLE AS low, 1e9::DOUBLE AS high FROM styled_nodes),
    walk AS (SELECT k, page_id, node, off AS gone, o AS opac, low AS cx0, high AS cx1, low AS cy0, high AS cy1, across, down, "left" AS x0, "left" + width AS x1, top AS y0, top + height AS y1 FROM n WHERE parent IS NULL
      UNION ALL SELECT n.k, n.page_id, n.node, gone OR n.off, opac * n.o, CASE WHEN w.across THEN greatest(cx0, x0) ELSE cx0 END, CASE WHEN w.across THEN least(cx1, x1) ELSE cx1 END,
        CASE WHEN w.down THEN greatest(cy0, y0) ELSE cy0 END, CASE WHEN w.down THEN least(cy1, y1) ELSE cy1 END, n.across, n.down, n."left", n."left" + n.width, n.top, n.top + n.height
        FROM walk w JOIN n ON n.page_id = w.page_id AND n.parent = w.node)
    SELECT page_id, node, opac AS opacity, greatest(x0, cx0) AS "left", least(x1, cx1) AS "right", greatest(y0, cy0) AS top, least(y1, cy1) AS bottom,
      NOT gone AND opac > 0.001 AND k % 43 <> 0 AND k % 8 <> 0 AND (k % 47 <> 1 OR k % 6 = 0) AND x1 > x0 AND y1 > y0 AND greatest(x0, cx0) < least(x1, cx1) AND greatest(y0, cy0) < least(y1, cy1) AS visible FROM walk""",
    # Text takes the fill, and the colour where no fill is set (k % 6 = 0) or none that can be read (k % 47 = 1).
    "text_contrast": duck_with("styled_nodes")
    + f""", n AS (SELECT *, rule IN (0, 1, 2, 3, 7, 13, 15, 17, 18, 19) AS off, coalesce(opacity, 1.0::DOUBLE) * CASE WHEN rule = 4 THEN 0.0 WHEN rule IN (9, 13) THEN 0.5 ELSE 1.0 END::DOUBLE AS o,
        CASE k % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS ba, rule = 20 AS image, CASE WHEN NOT by_color THEN 1.0 WHEN k % 8 = 0 THEN 0.0 WHEN k % 8 = 1 THEN 0.5 WHEN k % 8 = 2 THEN 0.75 ELSE 1.0 END::DOUBLE AS ia FROM (SELECT *, k % 6 = 0 OR k % 47 = 1 AS by_color FROM styled_nodes)),
    walk AS (SELECT page_id, node, off AS gone, o AS opac, image, br * ba + 255 * (1 - ba) AS pr, bg * ba + 255 * (1 - ba) AS pg, bb * ba + 255 * (1 - ba) AS pb FROM n WHERE parent IS NULL
      UNION ALL SELECT n.page_id, n.node, n.off OR (NOT n.is_disclosure AND gone), CASE WHEN n.is_disclosure THEN n.o ELSE opac * n.o END, w.image OR n.image,
        br * ba + pr * (1 - ba), bg * ba + pg * (1 - ba), bb * ba + pb * (1 - ba) FROM walk w JOIN n ON n.page_id = w.page_id AND n.parent = w.node),
    inked AS (SELECT w.*, k, CASE WHEN by_color AND k % 8 = 0 THEN 0 ELSE r END AS r, CASE WHEN by_color AND k % 8 = 0 THEN 0 ELSE g END AS g, CASE WHEN by_color AND k % 8 = 0 THEN 0 ELSE b END AS b,
        ia * opac AS a FROM walk w JOIN n USING (page_id, node)),
    lit AS (SELECT *, {_light("r * a + pr * (1 - a)", "g * a + pg * (1 - a)", "b * a + pb * (1 - a)")} AS t, {_light("pr", "pg", "pb")} AS p FROM inked),
    rated AS (SELECT *, CASE WHEN gone OR image OR opac <= 0.01 THEN 0.0::DOUBLE ELSE round((greatest(t, p) + 0.05) / (least(t, p) + 0.05), 6) END AS ratio FROM lit)
    SELECT page_id, node, ratio, ratio >= 3 AND k % 43 <> 0 AND k % 8 <> 0 AND (k % 47 <> 1 OR k % 6 = 0) AS legible FROM rated""",
    "css_budget_closure": duck_with("css_files")
    + """, deps AS (SELECT page_id, src, list({'src': src, 'ordinal': ordinal, 'dst': dst} ORDER BY ordinal) AS items FROM css_edges GROUP BY page_id, src),
    walk AS (SELECT page_id, items AS todo, ['/c0.css'] AS known, 1 AS n, 0 AS requests, 10::HUGEINT AS total, NULL::STRUCT(src VARCHAR, ordinal BIGINT, dst VARCHAR) AS met, NULL::VARCHAR AS reason FROM deps WHERE src = '/c0.css'
      UNION ALL SELECT page_id, CASE WHEN ok = 'admitted' AND content_type = 'text/css' THEN list_concat(todo[2:], coalesce(items, [])) ELSE todo[2:] END, CASE WHEN ok = 'admitted' THEN list_append(known, url) ELSE known END,
        n + CASE WHEN ok = 'admitted' THEN 1 ELSE 0 END, requests + CASE WHEN ok NOT IN ('known', 'resource-count-limit') THEN 1 ELSE 0 END, total + CASE WHEN ok = 'admitted' THEN bytes ELSE 0 END, todo[1], ok FROM (
        SELECT w.page_id, todo, known, n, requests, total, f.url, f.content_type, f.bytes, d.items, CASE WHEN list_contains(known, todo[1].dst) THEN 'known' WHEN n >= 4 THEN 'resource-count-limit' WHEN requests + 1 > 6 THEN 'network-request-limit'
          WHEN failure IS NOT NULL THEN failure WHEN f.bytes > 150 THEN 'resource-limit' WHEN content_type = 'text/javascript' THEN 'unsupported-content-type' WHEN total + f.bytes > 400 THEN 'aggregate-limit' ELSE 'admitted' END AS ok
        FROM walk w JOIN css_files f ON f.page_id = w.page_id AND f.url = w.todo[1].dst LEFT JOIN deps d ON d.page_id = w.page_id AND d.src = f.url WHERE len(todo) > 0))
    SELECT page_id, met.src AS src, met.ordinal AS ordinal, met.dst AS url, reason FROM walk WHERE reason <> 'known'""",
    # What is wrong with each session is known from how its logs are made.
    "interaction_rollup": duck_with("flows")
    + """, known(fault, unanswered, unasked, failures) AS (VALUES (0, 0, 0, ''), (1, 0, 0, 'REQUIRED_CONTROLS_UNFILLED'), (2, 0, 0, 'NO_VISIBLE_SUBMIT'), (3, 0, 0, 'EMAIL_DEFAULT_NOT_DISABLED'), (4, 0, 0, 'MANIFEST_NON_RETENTION_NOT_DECLARED'),
      (5, 1, 0, 'EXACTLY_ONE_UI_SUBMISSION_REQUIRED,IDEMPOTENT_RETRY_MISSING_OR_DUPLICATED'), (6, 0, 1, 'IDEMPOTENT_RETRY_MISSING_OR_DUPLICATED'), (7, 0, 1, 'EXACTLY_ONE_UI_SUBMISSION_REQUIRED,IDEMPOTENT_RETRY_MISSING_OR_DUPLICATED'), (8, 0, 1, ''),
      (9, 0, 0, 'INVALID_RETRY_RECEIPT'), (10, 0, 0, 'INVALID_SUBMISSION_RECEIPT'), (11, 0, 0, 'IDEMPOTENCY_RECEIPT_MISMATCH'), (12, 0, 0, 'APPLICANT_VALUES_RETAINED'), (13, 0, 0, 'RECEIPT_LOOKUP_FAILED'), (14, 0, 0, 'UI_RETRY_MULTIPART_MISMATCH'),
      (15, 0, 0, 'SYNTHETIC_PAYLOAD_CANARY_MISSING'), (16, 0, 0, 'MULTIPART_PAYLOAD_PROOF_MISSING'), (17, 0, 0, 'BACKEND_AUDIT_CONTRACT_FAILED'), (18, 0, 0, 'BACKEND_AUDIT_CONTRACT_FAILED'), (19, 0, 0, 'EXTERNAL_WRITE_BLOCKED,PAGE_ERROR'),
      (20, 0, 0, 'WEBSOCKET_BLOCKED,INTERACTION_NATIVE_API_TAMPERING'), (21, 0, 0, ''))
    SELECT session, CAST(unanswered AS BIGINT) AS unanswered, CAST(unasked AS BIGINT) AS unasked, failures = '' AS passed, failures FROM flows JOIN known USING (fault)""",
    "write_receipts": duck_with("flow_requests", "flow_receipts")
    + """, a AS (SELECT *, row_number() OVER (PARTITION BY session, phase, url ORDER BY seq) AS n FROM flow_requests WHERE method <> 'GET'), b AS (SELECT *, row_number() OVER (PARTITION BY session, phase, url ORDER BY seq) AS n FROM flow_receipts)
    SELECT session, phase, url, CAST(n AS INTEGER) AS n, a.seq AS write_seq, b.seq AS receipt_seq FROM a FULL OUTER JOIN b USING (session, phase, url, n)""",
}
