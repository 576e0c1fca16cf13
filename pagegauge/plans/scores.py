"""Queries on gates, rasters and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import joined
from ..operators import gates as G
from ..operators import geometry as M
from ..operators import raster as R
from .fixtures import duck_with, spark_rows as rows


def limits(s, d):
    return G.resolve_gates(rows(s, d, "score_metrics"), rows(s, d, "gate_policy"), rows(s, d, "gate_override"))


def scores(s, d):
    return G.evaluate_gates(rows(s, d, "score_metrics"), limits(s, d), ("series", "run_id"))


def parts(s, d):
    """Parts of the runs of a series: page comparisons as scored, the others with a failure of their own."""
    score = scores(s, d).select("run_id", F.col("passed").alias("scored"), "failures")
    out = rows(s, d, "run_parts").join(score, "run_id")
    compared = F.col("part").isin("source_self", "candidate_self", "source_candidate")
    own = F.when(F.col("passed"), F.array().cast("array<string>")).otherwise(F.array("failure"))
    return out.select("series", "part", F.when(compared, F.col("scored")).otherwise(F.col("passed")).alias("passed"), F.when(compared, F.col("failures")).otherwise(own).alias("failures"))


def pairs(s, d):
    return R.pixel_pairs(rows(s, d, "raster_base"), rows(s, d, "raster_cand"))


def bands(s, d):
    return R.merge_bands(R.axis_counts(pairs(s, d)))


def elements(s, d):
    return rows(s, d, "rects").select((F.col("page_id") % 10).cast("int").alias("raster"), (F.col("page_id") * 100 + F.col("n")).alias("n"), (F.col("x") % 64).alias("x"), (F.col("y") % 64).alias("y"), F.least(F.col("w") % 20 + 1, F.lit(64)).alias("w"), F.least(F.col("h") % 20 + 1, F.lit(64)).alias("h"))


def tree(s, d):
    return rows(s, d, "nodes").where("parent is not null").select(F.col("parent").alias("src"), F.col("node").alias("dst"))


QUERIES = {
    "resolve_gates": limits,
    "evaluate_gates": lambda s, d: scores(s, d).select("run_id", "viewport", "passed", joined("failures").alias("failures")),
    "run_failure_codes": lambda s, d: G.run_failure_codes(parts(s, d), "series").withColumn("codes", joined("codes")),
    "case_result": lambda s, d: G.case_result(parts(s, d), "series"),
    "promotion_stage": lambda s, d: G.promotion_stage(rows(s, d, "score_metrics"), "series"),
    "iteration_ledger": lambda s, d: G.iteration_ledger(rows(s, d, "iterations")),
    "ledger_admit": lambda s, d: G.ledger_admit(rows(s, d, "iterations").select("series", "seq", "viewport"), rows(s, d, "iterations").where("run_id % 3 = 0").select("series"), "series"),
    "bind_cases": lambda s, d: G.bind_cases(rows(s, d, "iterations").select("run_id", "series", "viewport"), rows(s, d, "iterations").where("seq <= 1 or run_id % 50 = 0").select("series", "viewport")),
    "pixel_diff_strict": lambda s, d: R.pixel_metrics(pairs(s, d), "x between 10 and 19 and y < 8"),
    "pixel_diff_yiq": lambda s, d: R.pixel_metrics_yiq(pairs(s, d)),
    "pixel_diff_tolerant": lambda s, d: R.pixel_metrics_tolerant(pairs(s, d)),
    "diff_bbox": lambda s, d: R.diff_bbox(pairs(s, d)),
    "axis_counts": lambda s, d: R.axis_counts(pairs(s, d)),
    "merge_bands": lambda s, d: bands(s, d),
    "top_bands": lambda s, d: R.top_bands(bands(s, d)),
    "bands_to_elements": lambda s, d: R.bands_to_elements(bands(s, d), elements(s, d)),
    "union_area": lambda s, d: M.union_area(rows(s, d, "rects")),
    "grid_coverage": lambda s, d: M.grid_coverage(rows(s, d, "rects")),
    "max_surface": lambda s, d: M.max_surface(rows(s, d, "rects")),
    "mask_coverage": lambda s, d: M.mask_coverage(rows(s, d, "rects").where("kind = 'raster'"), rows(s, d, "rects_cand").where("kind = 'raster'")),
    "top_surfaces": lambda s, d: M.top_surfaces(rows(s, d, "rects"), 3),
    "duplicates": lambda s, d: M.duplicates(rows(s, d, "rects"), ["page_id", "x", "y"]),
    "distinct_sets": lambda s, d: M.distinct_sets(rows(s, d, "rects")),
    "admit_budget": lambda s, d: M.admit_budget(rows(s, d, "rects"), 60000, 120000, 4),
    "effective_visibility": lambda s, d: M.effective_visibility(rows(s, d, "nodes")),
    "contrast_audit": lambda s, d: M.contrast_audit(rows(s, d, "nodes")),
    "css_closure": lambda s, d: M.css_closure(tree(s, d), rows(s, d, "nodes").where("node % 50 = 1").select("node")),
}

_DEFAULTS = ", ".join(f"('{g}', {x})" for g, x in G.GATES.items())
_M = duck_with("score_metrics", "gate_policy", "gate_override", "run_parts") + f""", m AS (SELECT * FROM score_metrics),
  g AS (SELECT v.viewport, d.gate, CAST(coalesce(f.lim, o.lim, b.lim, d.lim) AS DOUBLE) AS lim FROM (SELECT DISTINCT viewport FROM m) v CROSS JOIN (VALUES {_DEFAULTS}) AS d(gate, lim) LEFT JOIN gate_override f ON f.gate = d.gate
    LEFT JOIN gate_policy b ON b.viewport IS NULL AND b.gate = d.gate LEFT JOIN gate_policy o ON o.viewport = v.viewport AND o.gate = d.gate),
  l AS (PIVOT g ON gate IN ({", ".join(f"'{g}'" for g in G.GATES)}) USING first(lim) GROUP BY viewport),
  sc AS (SELECT *, failures = '' AS passed FROM (SELECT m.series, m.run_id, m.viewport, concat_ws(',',
    CASE WHEN coalesce(baseline_tampering, 1) <> 0 THEN 'BASELINE_CAPTURE_API_TAMPERING' END,
    CASE WHEN coalesce(candidate_tampering, 1) <> 0 THEN 'CANDIDATE_CAPTURE_API_TAMPERING' END,
    CASE WHEN l.require_dimensions <> 0 AND NOT coalesce(dimensions_match, false) THEN 'DIMENSIONS' END,
    CASE WHEN m.tolerant IS NULL OR m.tolerant > l.tolerant THEN 'PIXEL_TOLERANT' END,
    CASE WHEN m.strict IS NULL OR m.strict > l.strict THEN 'PIXEL_STRICT' END,
    CASE WHEN l.require_stable <> 0 AND NOT coalesce(stable, false) THEN 'CANDIDATE_UNSTABLE' END,
    CASE WHEN m.masked_pixels > l.masked_pixels THEN 'MASKED_PIXELS' END,
    CASE WHEN m.critical_failures > l.critical_failures THEN 'CANDIDATE_CRITICAL_RESOURCE' END,
    CASE WHEN m.page_errors > l.page_errors THEN 'CANDIDATE_PAGE_ERROR' END,
    CASE WHEN m.console_errors > l.console_errors THEN 'CANDIDATE_CONSOLE_ERROR' END,
    CASE WHEN m.blocked_writes > l.blocked_writes THEN 'CANDIDATE_BLOCKED_WRITE_ATTEMPT' END,
    CASE WHEN m.blocked_private_reads > l.blocked_private_reads THEN 'CANDIDATE_BLOCKED_PRIVATE_READ_ATTEMPT' END,
    CASE WHEN m.unapproved > l.unapproved THEN 'SEMANTIC_UNAPPROVED' END,
    CASE WHEN retained <> reported THEN 'SEMANTIC_DETAILS_TRUNCATED' END) AS failures FROM m JOIN l ON l.viewport = m.viewport)),
  pt AS (SELECT r.series, r.part, CASE WHEN compared THEN sc.passed ELSE r.passed END AS passed, CASE WHEN compared THEN failures WHEN r.passed THEN '' ELSE r.failure END AS failures
    FROM (SELECT *, part IN ('source_self', 'candidate_self', 'source_candidate') AS compared FROM run_parts) r JOIN sc USING (run_id)),
  ok AS (SELECT series, {", ".join(f"coalesce(bool_and(passed) FILTER (part = '{p}'), false) AS {p}" for p in G.PARTS)}, coalesce(bool_and(passed) FILTER (part = 'command'), true) AS command FROM pt GROUP BY series),
  rc AS (SELECT series, CASE WHEN f = '' THEN NULL WHEN f = 'DIMENSIONS' THEN 'GEOMETRY' WHEN f LIKE 'PIXEL%' THEN 'CONTENT' WHEN f LIKE 'SEMANTIC%' THEN 'SEMANTICS' WHEN f = 'CANDIDATE_CRITICAL_RESOURCE' THEN 'ASSETS'
      WHEN f = 'CANDIDATE_UNSTABLE' THEN 'CAPTURE' ELSE 'TOOLING' END AS code FROM (SELECT series, unnest(string_split(failures, ',')) AS f FROM pt WHERE part = 'source_candidate')
    UNION ALL SELECT series, 'BACKEND' FROM pt WHERE part = 'interaction' AND NOT passed AND regexp_matches(upper(failures), 'SUBMISSION|RECEIPT|EMAIL|BACKEND|LOCAL')
    UNION ALL SELECT series, CASE WHEN NOT command THEN 'TOOLING' END FROM ok {"".join(f" UNION ALL SELECT series, CASE WHEN NOT {p} THEN '{c}' END FROM ok" for p, c in G.PARTS.items() if c)})"""
_PASS = " AND ".join([*G.PARTS, "command"])
_P = duck_with("raster_base", "raster_cand") + """, p AS (SELECT coalesce(b.raster, c.raster) AS raster, coalesce(b.y, c.y) AS y, coalesce(b.x, c.x) AS x, b.raster IS NULL OR c.raster IS NULL AS padded,
  coalesce(b.r, 1) AS br, coalesce(b.g, 2) AS bg, coalesce(b.b, 3) AS bb, coalesce(c.r, 1) AS cr, coalesce(c.g, 2) AS cg, coalesce(c.b, 3) AS cb FROM raster_base b FULL OUTER JOIN raster_cand c ON b.raster = c.raster AND b.y = c.y AND b.x = c.x),
  q AS (SELECT *, br <> cr OR bg <> cg OR bb <> cb AS changed FROM p)"""
_AXES = "SELECT raster, 'row' AS axis, y AS pos, count(*) AS n FROM q WHERE changed GROUP BY raster, y UNION ALL SELECT raster, 'column', x, count(*) FROM q WHERE changed GROUP BY raster, x"
_BANDS = f"""SELECT raster, axis, min(pos) AS start, max(pos) AS "end", CAST(sum(n) AS BIGINT) AS pixels, max(n) AS peak, max(pos) - min(pos) + 1 AS size FROM (SELECT *, sum(fresh) OVER (PARTITION BY raster, axis ORDER BY pos) AS band FROM
  (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY raster, axis ORDER BY pos) <= 4 THEN 0 ELSE 1 END AS fresh FROM ({_AXES}))) GROUP BY raster, axis, band"""
_Y = lambda c: "(" + " + ".join(f"{c[i]} * (p.b{ch} - p.c{ch})" for i, ch in enumerate("rgb")) + ")"
_YIQ = [_Y((0.29889531, 0.58662247, 0.11448223)), _Y((0.59597799, -0.27417610, -0.32180189)), _Y((0.21147017, -0.52261711, 0.31114694))]


def _sweep(src: str) -> str:
    return f"""SELECT page_id, CAST(sum((e2 - e) * greatest(0, y2 - greatest(y, coalesce(seen, y)))) AS BIGINT) AS area FROM (SELECT s.page_id, e, e2, y, y2, max(y2) OVER (PARTITION BY s.page_id, e ORDER BY y, y2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
      FROM (SELECT page_id, e, lead(e) OVER (PARTITION BY page_id ORDER BY e) AS e2 FROM (SELECT page_id, x AS e FROM {src} UNION SELECT page_id, x + w FROM {src})) s JOIN (SELECT page_id, x, x + w AS x2, y, y + h AS y2 FROM {src}) r ON r.page_id = s.page_id AND x <= e AND x2 >= e2) GROUP BY page_id"""


ORACLES = {
    "resolve_gates": _M + " SELECT * FROM g",
    "evaluate_gates": _M + " SELECT run_id, viewport, passed, failures FROM sc",
    "run_failure_codes": _M + f""" SELECT series, codes, {_PASS} AS passed FROM ok JOIN (SELECT series, coalesce(array_to_string(list_sort(list(DISTINCT code) FILTER (code IS NOT NULL)), ','), '') AS codes FROM rc GROUP BY series) USING (series)""",
    "case_result": _M + f" SELECT * EXCLUDE (command), {_PASS} AS accepted FROM ok",
    "promotion_stage": _M + " SELECT series, max(tolerant) AS worst, CASE WHEN max(tolerant) <= 0 THEN 'pixel_perfect' WHEN max(tolerant) <= 0.15 THEN 'near_exact' WHEN max(tolerant) <= 0.5 THEN 'typography' WHEN max(tolerant) <= 2 THEN 'geometry' WHEN max(tolerant) <= 5 THEN 'runnable' ELSE 'none' END AS stage FROM m GROUP BY series",
    "iteration_ledger": duck_with("iterations") + """, v AS (SELECT series, seq, [round(v1, 12), round(v2, 12), round(v3, 12), round(v4, 12), round(v5, 12)] AS v FROM iterations), b AS (SELECT a.series, a.seq, a.v, (SELECT min((o.v, o.seq)) FROM v o WHERE o.series = a.series AND o.seq < a.seq) AS best FROM v a)
      SELECT series, seq, CASE WHEN best IS NULL OR v < best[1] THEN seq ELSE best[2] END AS best_seq, best IS NULL OR v < best[1] AS is_best, best IS NOT NULL AND v > best[1] AS regressed FROM b""",
    "ledger_admit": duck_with("iterations") + " SELECT series, seq, viewport FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY seq) AS rn FROM iterations) WHERE rn = 1 AND series NOT IN (SELECT series FROM iterations WHERE run_id % 3 = 0)",
    "bind_cases": duck_with("iterations") + " SELECT i.run_id, i.series, i.viewport FROM iterations i JOIN (SELECT series, min(viewport) AS viewport FROM iterations WHERE seq <= 1 OR run_id % 50 = 0 GROUP BY series HAVING count(*) = 1) r ON r.series = i.series AND r.viewport = i.viewport",
    "pixel_diff_strict": _P + " SELECT *, 100.0::DOUBLE * n_changed / greatest(1, n_pixels - n_masked) AS percent FROM (SELECT raster, count(*) AS n_pixels, count(*) FILTER (padded) AS n_padded, count(*) FILTER (x BETWEEN 10 AND 19 AND y < 8) AS n_masked, count(*) FILTER (changed AND NOT (x BETWEEN 10 AND 19 AND y < 8)) AS n_changed FROM q GROUP BY raster)",
    "pixel_diff_yiq": _P + f" SELECT raster, count(*) FILTER (d > 352.15) AS n_over, 100.0::DOUBLE * count(*) FILTER (d > 352.15) / count(*) AS percent_over FROM (SELECT raster, 0.5053 * {_YIQ[0]} * {_YIQ[0]} + 0.299 * {_YIQ[1]} * {_YIQ[1]} + 0.1957 * {_YIQ[2]} * {_YIQ[2]} AS d FROM p) GROUP BY raster",
    "diff_bbox": _P + " SELECT raster, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM q WHERE changed GROUP BY raster",
    "axis_counts": _P + " " + _AXES,
    "merge_bands": _P + " " + _BANDS,
    "top_bands": _P + f" SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY raster, axis ORDER BY pixels DESC, start) AS INTEGER) AS rank FROM ({_BANDS})) WHERE rank <= 30",
    "bands_to_elements": _P.replace("WITH RECURSIVE ", duck_with("rects") + ", ", 1) + f""" SELECT raster, axis, start, "end", n, area, rank FROM (SELECT b.*, e.n, e.w * e.h AS area, CAST(row_number() OVER (PARTITION BY b.raster, b.axis, b.start ORDER BY e.w * e.h, e.n) AS INTEGER) AS rank FROM ({_BANDS}) b
      JOIN (SELECT page_id % 10 AS raster, page_id * 100 + n AS n, x % 64 AS x, y % 64 AS y, least(w % 20 + 1, 64) AS w, least(h % 20 + 1, 64) AS h FROM rects) e
      ON e.raster = b.raster AND CASE WHEN b.axis = 'row' THEN e.y ELSE e.x END <= b."end" AND CASE WHEN b.axis = 'row' THEN e.y + e.h - 1 ELSE e.x + e.w - 1 END >= b.start) WHERE rank <= 8""",
    "union_area": duck_with("rects") + f"SELECT page_id, area, area / 2000000.0::DOUBLE AS coverage, area / 2000000.0::DOUBLE >= 0.8 AS alarm FROM ({_sweep('rects')})",
    "grid_coverage": duck_with("rects") + f", c AS (SELECT page_id, x0 AS x, y0 AS y, least(256, x1) - x0 AS w, least(256, y1) - y0 AS h FROM (SELECT page_id, CAST(floor(x * 256 / 1000) AS BIGINT) AS x0, CAST(floor(y * 256 / 2000) AS BIGINT) AS y0, CAST(ceil((x + w) * 256 / 1000) AS BIGINT) AS x1, CAST(ceil((y + h) * 256 / 2000) AS BIGINT) AS y1 FROM rects)) SELECT page_id, area AS n_cells, area / 65536.0::DOUBLE AS coverage FROM ({_sweep('c')})",
    "max_surface": duck_with("rects") + "SELECT page_id, max(w * h / 2000000.0::DOUBLE) AS largest FROM rects GROUP BY page_id",
    "mask_coverage": duck_with("rects_cand") + f""", a AS (SELECT * FROM rects WHERE kind = 'raster'), b AS (SELECT * FROM rects_cand WHERE kind = 'raster'), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
      SELECT u.page_id, u.area AS either, coalesce(a.area, 0) + coalesce(b.area, 0) - u.area AS "both" FROM ({_sweep('u')}) u LEFT JOIN ({_sweep('a')}) a USING (page_id) LEFT JOIN ({_sweep('b')}) b USING (page_id)""",
    "top_surfaces": duck_with("rects") + "SELECT * FROM (SELECT page_id, n, w * h AS area, CAST(row_number() OVER (PARTITION BY page_id ORDER BY w * h DESC, n) AS INTEGER) AS rank FROM rects) WHERE rank <= 3",
    "duplicates": duck_with("rects") + "SELECT page_id, x, y, count(*) AS copies FROM rects GROUP BY page_id, x, y HAVING count(*) > 1",
    "distinct_sets": duck_with("rects") + "SELECT page_id, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, count(DISTINCT (w, h)) AS n_sizes FROM rects GROUP BY page_id",
    "admit_budget": duck_with("rects") + """, g AS (SELECT page_id, n, bytes, row_number() OVER (PARTITION BY page_id ORDER BY n) AS i FROM rects), walk AS (
      SELECT page_id, 0::BIGINT AS n, 0::BIGINT AS bytes, 0::BIGINT AS i, 0::BIGINT AS used, 0 AS taken, '' AS reason FROM (SELECT DISTINCT page_id FROM g)
      UNION ALL SELECT g.page_id, g.n, g.bytes, g.i, used + CASE WHEN g.bytes <= 60000 AND taken < 4 AND used + g.bytes <= 120000 THEN g.bytes ELSE 0 END, taken + CASE WHEN g.bytes <= 60000 AND taken < 4 AND used + g.bytes <= 120000 THEN 1 ELSE 0 END,
      CASE WHEN g.bytes > 60000 THEN 'too_large' WHEN taken >= 4 THEN 'too_many' WHEN used + g.bytes > 120000 THEN 'over_total' ELSE 'admitted' END FROM walk JOIN g ON g.page_id = walk.page_id AND g.i = walk.i + 1)
      SELECT page_id, n, bytes, reason FROM walk WHERE i > 0""",
    "effective_visibility": duck_with("nodes") + """, up(node, ancestor) AS (SELECT node, node FROM nodes UNION ALL SELECT up.node, n.parent FROM up JOIN nodes n ON n.node = up.ancestor WHERE n.parent IS NOT NULL AND n.parent IN (SELECT node FROM nodes))
      SELECT up.node, product(opacity) AS opacity, NOT bool_or(hidden) AND product(opacity) > 0.001 AND max(clip_from) < min(clip_to) AS visible FROM up JOIN nodes a ON a.node = up.ancestor GROUP BY up.node""",
    "css_closure": duck_with("nodes") + """, walk(node, depth) AS (SELECT node, 0 FROM nodes WHERE node % 50 = 1 UNION SELECT n.node, depth + 1 FROM walk JOIN nodes n ON n.parent = walk.node) SELECT node, min(depth) AS depth FROM walk GROUP BY node""",
    "contrast_audit": duck_with("nodes") + ", l AS (SELECT node, font_px, alpha, " + ", ".join(
        "0.2126 * lin({0}) + 0.7152 * lin({1}) + 0.0722 * lin({2}) AS {3}".format(*c) for c in (("fr * alpha + br * (1 - alpha)", "fg * alpha + bg * (1 - alpha)", "fb * alpha + bb * (1 - alpha)", "t"), ("br", "bg", "bb", "g"))
    ) + " FROM nodes) SELECT node, round((greatest(t, g) + 0.05) / (least(t, g) + 0.05), 6) AS ratio, font_px >= 8 AND round((greatest(t, g) + 0.05) / (least(t, g) + 0.05), 6) >= 3 AND alpha > 0 AS legible FROM l",
}
ORACLES["contrast_audit"] = __import__("re").sub(r"lin\(((?:[^()]|\([^()]*\))*)\)", r"(CASE WHEN (\1) / 255.0 <= 0.04045 THEN (\1) / 255.0 / 12.92 ELSE pow(((\1) / 255.0 + 0.055) / 1.055, 2.4) END)", ORACLES["contrast_audit"])
