"""Queries on extracted records and their diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import joined
from ..operators import diff as D
from ..operators import extract as E
from .fixtures import duck_with, spark_rows as rows

#: Names of controls, some with a submit word.
NAMED = "CASE l_partkey % 11 WHEN 0 THEN 'Send ' || name WHEN 1 THEN 'Apply' ELSE name END"

LINK_PROPS, CONTROL_PROPS, HEADING_PROPS = ["href"], ["type", "value_length", "required", "visible", "label", "n_options"], ["level", "text"]


#: As the pages of the fixture write them.
DEPENDENCY_PATTERNS = {
    "script": '<script src="([^"]*)"',
    "stylesheet": '<link rel="stylesheet" href="([^"]*)"',
    "image": '<img[^>]* src="([^"]*)"',
    "base": '<base href="([^"]*)"',
    "meta_refresh": '<meta http-equiv="refresh" content="([^"]*)"',
    "frame": '<iframe[^>]* src="([^"]*)"',
    "object": '<object[^>]* data="([^"]*)"',
}


def base_key(name):
    return {"links": D.link_base(), "controls": D.control_base(), "headings": D.heading_base()}[name]


def keyed(s, d, name):
    return D.assign_keys(rows(s, d, name), base_key(name))


def _diff(s, d, name, props):
    return D.capture_diff(rows(s, d, name), rows(s, d, f"{name}_cand"), base_key(name), props)


def mismatches(s, d):
    return D.flatten_mismatches(links=_diff(s, d, "links", LINK_PROPS), controls=_diff(s, d, "controls", CONTROL_PROPS), headings=_diff(s, d, "headings", HEADING_PROPS))


def shown(df, *names):
    for n in names or ("fields",):
        df = df.withColumn(n, joined(n))
    return df


def options(s, d, name):
    return E.option_classes(rows(s, d, name))


def crosscheck(s, d):
    a = E.tag_counts(rows(s, d, "pages")).select("page_id", "n_links", "n_headings")
    links = rows(s, d, "links_cand").groupBy("page_id").agg(F.count("*").alias("n_links"))
    heads = rows(s, d, "headings").groupBy("page_id").agg(F.count("*").alias("n_headings"))
    return D.inventory_crosscheck(a, links.join(heads, "page_id", "left").fillna(0), "page_id")


QUERIES = {
    "page_profile": lambda s, d: E.page_profile(rows(s, d, "pages")),
    "extract_links": lambda s, d: E.extract_links(rows(s, d, "rich_pages")),
    "extract_headings": lambda s, d: E.extract_headings(rows(s, d, "pages")),
    "extract_dependencies": lambda s, d: E.extract_dependencies(rows(s, d, "rich_pages")),
    "structural_inventory": lambda s, d: E.structural_inventory(rows(s, d, "rich_pages")),
    "tag_counts": lambda s, d: E.tag_counts(rows(s, d, "pages")),
    "css_dependencies": lambda s, d: E.css_dependencies(rows(s, d, "page_rows")),
    "generated_images": lambda s, d: E.generated_images(rows(s, d, "page_rows")),
    "url_provenance": lambda s, d: E.url_provenance(rows(s, d, "pages")),
    "extract_forms": lambda s, d: E.extract_forms(E.page_records(rows(s, d, "form_pages"))),
    "label_targets": lambda s, d: E.label_targets(E.page_records(rows(s, d, "form_pages"))),
    "surface_sources": lambda s, d: shown(E.surface_sources(E.page_records(rows(s, d, "form_pages"))), "sources"),
    "extract_controls": lambda s, d: rows(s, d, "controls").select("page_id", "ordinal", "name", "type", "value_length", D.F.when(D.F.col("value_length") > 0, True).otherwise(False).alias("value_present"), E.squeeze("label").alias("label"), _vc().alias("value_class")),
    "option_classes": lambda s, d: options(s, d, "controls"),
    "accessible_names": lambda s, d: E.accessible_names(rows(s, d, "controls")),
    "control_keys": lambda s, d: keyed(s, d, "controls").select("page_id", "viewport", "ordinal", "key"),
    "link_keys": lambda s, d: keyed(s, d, "links").select("page_id", "viewport", "ordinal", "key"),
    "links_diff": lambda s, d: shown(_diff(s, d, "links", LINK_PROPS)),
    "controls_diff": lambda s, d: shown(_diff(s, d, "controls", CONTROL_PROPS)),
    "headings_diff": lambda s, d: shown(_diff(s, d, "headings", HEADING_PROPS)),
    "options_diff": lambda s, d: D.options_diff(options(s, d, "controls"), options(s, d, "controls_cand")),
    "mask_diff": lambda s, d: D.mask_diff(rows(s, d, "rects"), rows(s, d, "rects_cand")),
    "mismatch_counts": lambda s, d: D.mismatch_counts(mismatches(s, d)),
    "critical_findings": lambda s, d: shown(D.critical_findings(mismatches(s, d))),
    "mismatch_preview": lambda s, d: shown(D.mismatch_preview(mismatches(s, d))),
    "retain_details": lambda s, d: shown(D.retain_details(mismatches(s, d), 2)),
    "apply_approvals": lambda s, d: shown(D.apply_approvals(mismatches(s, d), rows(s, d, "approvals")).fillna(-1, ["rule"]).fillna("", ["rationale"])),
    "admit_policy": lambda s, d: shown(D.admit_policy(D.apply_approvals(mismatches(s, d), rows(s, d, "approvals")).where("approved").select("rule", joined("fields").alias("fields"), "kind", "key", "rationale")), "violations"),
    "inventory_crosscheck": crosscheck,
    "primary_action": lambda s, d: D.primary_action(rows(s, d, "controls").withColumn("name", F.expr(NAMED))),
}


def _vc():
    from ..functions.expressions import value_class

    return value_class("value_length", "type")


def _keyed_sql(name: str, base: str) -> str:
    return f"SELECT *, {base} || '|#' || (row_number() OVER (PARTITION BY page_id, viewport, {base} ORDER BY ordinal) - 1) AS key FROM {name}"


_BASES = {"links": "trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'))", "controls": "type || '|' || name", "headings": "'h' || level"}


def _diff_sql(name: str, props: list[str]) -> str:
    fields = ", ".join(f"CASE WHEN b.{p} IS DISTINCT FROM c.{p} THEN '{p}' END" for p in props)
    return f"""SELECT * FROM (SELECT coalesce(b.page_id, c.page_id) AS page_id, coalesce(b.viewport, c.viewport) AS viewport, coalesce(b.key, c.key) AS key,
      CASE WHEN c.key IS NULL THEN 'missing' WHEN b.key IS NULL THEN 'extra' WHEN concat_ws(',', {fields}) <> '' THEN 'changed' END AS kind,
      CASE WHEN c.key IS NULL OR b.key IS NULL THEN '' ELSE concat_ws(',', {fields}) END AS fields
      FROM ({_keyed_sql(name, _BASES[name])}) b FULL OUTER JOIN ({_keyed_sql(name + "_cand", _BASES[name])}) c ON b.page_id = c.page_id AND b.viewport = c.viewport AND b.key = c.key) WHERE kind IS NOT NULL"""


_ALL = duck_with("links_cand", "controls_cand", "headings_cand", "approvals") + f""", mm AS (
  SELECT 'links' AS category, * FROM ({_diff_sql("links", LINK_PROPS)}) UNION ALL BY NAME SELECT 'controls' AS category, * FROM ({_diff_sql("controls", CONTROL_PROPS)})
  UNION ALL BY NAME SELECT 'headings' AS category, * FROM ({_diff_sql("headings", HEADING_PROPS)}))"""
_N = "count(*) AS n, count(*) FILTER (kind = 'missing') AS n_missing, count(*) FILTER (kind = 'extra') AS n_extra, count(*) FILTER (kind = 'changed') AS n_changed, count(*) > 200 AS truncated"
_OPT = "SELECT page_id, ordinal, pos, CAST(CASE WHEN pos = 0 THEN 0 ELSE value_length + pos END AS INTEGER) AS option_length FROM (SELECT *, unnest(range(n_options)) AS pos FROM {0})"
_APPROVED = "SELECT mm.*, r.rule, r.rationale, r.rule IS NOT NULL AS approved FROM mm LEFT JOIN (SELECT viewport, category, kind, key, fields, min(rule) AS rule, arg_min(rationale, rule) AS rationale FROM approvals GROUP BY ALL) r ON mm.viewport = r.viewport AND mm.category = r.category AND mm.kind = r.kind AND mm.key = r.key AND list_sort(string_split(mm.fields, ',')) = list_sort(string_split(r.fields, ','))".replace("arg_min(rationale, rule) AS rationale FROM approvals GROUP BY ALL", "arg_min(rationale, rule) AS rationale FROM approvals GROUP BY viewport, category, kind, key, fields")


def _attr(tag: str, name: str) -> str:
    """SQL for an attribute of a start tag; empty if it is missing."""
    return f"""regexp_replace(regexp_extract({tag}, '(?i)[ \\t\\n]{name} *= *("[^"]*"|''[^'']*''|[^ >"'']+)', 1), '^["'']|["'']$', '', 'g')"""


#: Addresses resolved against the page's; the extra pages hold no dot segments.
_SITE = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
_URL = f"""CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-z]+:)', 1) || href WHEN starts_with(href, '/') THEN {_SITE} || href
  ELSE {_SITE} || '/sub/' || href END"""
_ANCHORS = f""" SELECT page_id, 'default' AS viewport, ordinal, CASE WHEN named THEN NULL ELSE href END AS href, CASE WHEN named THEN '' ELSE {_URL} END AS url, text, aria_label, target, rel FROM (
  SELECT page_id, url, ordinal, NOT regexp_matches(tag, '(?i) href') AS named, {_attr("tag", "href")} AS href, trim(regexp_replace(regexp_replace(substr(m, length(tag) + 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS text,
    trim(regexp_replace({_attr("tag", "aria-label")}, ' +', ' ', 'g')) AS aria_label, {_attr("tag", "target")} AS target, {_attr("tag", "rel")} AS rel FROM (SELECT *, regexp_extract(m, '^<[^>]*>') AS tag FROM (
      SELECT page_id, url, unnest(l) AS m, unnest(range(len(l))) AS ordinal FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a [^>]*>.*?</a>') AS l FROM rich_pages))))"""
_UNSAFE = "regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') AND NOT regexp_matches(h, '^https?:') OR regexp_matches(h, '^https?://[^/?#]*@')"
_EXTERNAL = "regexp_matches(h, '^(https?:)?//') AND NOT regexp_matches(h, '^https?://[^/?#]*@') AND regexp_extract(h, '//([^/?#]*)', 1) <> regexp_extract(url, '//([^/?#]*)', 1)"


def _tags(pattern: str, where: str = "true", attr: str = "href") -> str:
    """SQL for the number of start tags of a page that meet a condition on an address ``h``."""
    return f"""(SELECT count(*) FROM (SELECT tag, {_attr("tag", attr)} AS h FROM (SELECT unnest(regexp_extract_all(html, '(?i)<(?:{pattern})(?:[ >][^>]*|)>')) AS tag)) WHERE {where})"""


_INVENTORY = " SELECT page_id, " + ", ".join(
    f"{sql} AS n_{name}"
    for name, sql in {
        "forms": _tags("form"),
        "unsafe_forms": _tags("form", "h <> '/api/applications' OR NOT regexp_matches(lower(tag), 'method=\"post\"')", "action"),
        "navigable_links": _tags("a|area", "regexp_matches(lower(tag), ' href')"),
        "external_links": _tags("a|area", _EXTERNAL),
        "unsafe_links": _tags("a|area", _UNSAFE),
        "scripts": _tags("script"),
        "inline_scripts": _tags("script", "NOT contains(tag, ' src=')"),
        "external_scripts": _tags("script", _EXTERNAL, "src"),
        "stylesheet_links": _tags("link", "contains(tag, 'rel=\"stylesheet\"')"),
        "external_stylesheets": _tags("link", f"contains(tag, 'rel=\"stylesheet\"') AND {_EXTERNAL}"),
        "base_elements": _tags("base"),
        "iframes": _tags("iframe"),
        "embedded_objects": _tags("object|embed"),
        "disclosures": "len(regexp_extract_all(html, '<[^>]* data-replica-disclosure'))",
        "meta_refreshes": _tags("meta", "contains(tag, 'http-equiv=\"refresh\"')"),
        "svg_elements": _tags("svg"),
        "svg_external_resources": _tags("use|feimage", "NOT starts_with(h, '#')", "(?:xlink:)?href"),
    }.items()
) + " FROM rich_pages"


def _decoded(text: str) -> str:
    """SQL for a text with the entities of the pages decoded; HTML reads these without a semicolon too."""
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
        text = f"regexp_replace({text}, '&{name};?', '{char}', 'g')"
    return text


ORACLES = {
    "page_profile": r"""SELECT page_id, """
    + _decoded("trim(regexp_extract(html, '<title>([^<]*)', 1))")
    + r""" AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract(html, '<meta charset="([^"]*)"', 1) AS declared_charset,
      length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script[^>]*>|<style\b[^>]*>.*?</style[^>]*>|<title\b[^>]*>.*?</title[^>]*>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS text_length FROM pages""",
    "extract_links": duck_with("rich_pages") + _ANCHORS,
    "extract_headings": r"""SELECT page_id, o AS ordinal, CAST(CASE WHEN a <> '' THEN a ELSE regexp_extract(m, '<h([1-6])', 1) END AS INTEGER) AS level, """
    + _decoded(r"trim(regexp_replace(regexp_extract(m, '>([^<]*)$', 1), '\s+', ' ', 'g'))")
    + r""" AS text
      FROM (SELECT page_id, o, m, regexp_extract(m, 'aria-level="([0-9]+)"', 1) AS a FROM (SELECT page_id, unnest(l) AS m, unnest(range(len(l))) AS o FROM (SELECT page_id, regexp_extract_all(html, '<h([1-6])([^>]*)>([^<]*)') AS l FROM pages)))""",
    "extract_dependencies": duck_with("rich_pages") + " UNION ALL ".join(f"SELECT page_id, '{k}' AS kind, unnest(range(len(l))) AS ordinal, unnest(l) AS target FROM (SELECT page_id, regexp_extract_all(html, '{p}', 1) AS l FROM rich_pages)" for k, p in DEPENDENCY_PATTERNS.items()),
    "structural_inventory": duck_with("rich_pages") + _INVENTORY,
    "tag_counts": "SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '{p}')) AS n_{k}" for k, p in E.TAGS.items()) + " FROM pages",
    "css_dependencies": duck_with("page_rows") + f"""SELECT DISTINCT page_id, trim(regexp_replace(url, '#.*$', '')) AS url FROM (SELECT page_id, unnest(list_concat(list_concat(regexp_extract_all(css, '{E.CSS_URL.replace("'", "''")}', 1), regexp_extract_all(css, '{E.CSS_IMPORT.replace("'", "''")}', 1)), regexp_extract_all(css, '{E.CSS_SET.replace("'", "''")}', 1))) AS url FROM page_rows)
      WHERE NOT starts_with(lower(url), 'data:') AND NOT starts_with(url, '#') AND trim(regexp_replace(url, '#.*$', '')) <> ''""",
    "generated_images": duck_with("page_rows") + f"""SELECT *, n_paints > 0 OR n_cross_fades > 0 OR n_gradients >= 2 OR n_stops >= 16 OR len > 512 AS complex FROM (SELECT page_id, length(css) AS len, len(regexp_extract_all(css, '{E.GRADIENT}')) AS n_gradients,
      len(regexp_extract_all(css, 'paint[(]')) AS n_paints, len(regexp_extract_all(css, 'cross-fade[(]')) AS n_cross_fades, len(regexp_extract_all(css, '(?:#[0-9a-fA-F]{{3,8}}|rgba?[(]|hsla?[(])')) AS n_stops FROM page_rows)""".replace("SELECT *, n_paints", "SELECT page_id, n_gradients, n_paints, n_cross_fades, n_stops, n_paints"),
    "url_provenance": r"""SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) || regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS location, sha256(url) AS sha256,
      coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda p: string_split(p, '=')[1]), lambda k: k <> ''))), ','), '') AS query_keys, contains(url, '#') AS has_fragment FROM pages""",
    "extract_forms": duck_with("form_pages") + """SELECT page_id, unnest(range(len(f))) AS ordinal, regexp_extract(unnest(f), 'method="([^"]*)"', 1) AS method, regexp_extract(unnest(f), 'action="([^"]*)"', 1) AS action, len(regexp_extract_all(unnest(f), '<(?:input|select|textarea|button)')) AS n_controls
      FROM (SELECT page_id, list_transform(list_filter(string_split(html, '<form '), lambda x: contains(x, '</form>')), lambda x: string_split(x, '</form>')[1]) AS f FROM form_pages)""",
    "label_targets": duck_with("form_pages") + """, l AS (SELECT page_id, html, unnest(range(len(m))) AS label_ordinal, unnest(m) AS body FROM (SELECT page_id, html, regexp_extract_all(html, '<label[^>]*>.*?</label>') AS m FROM form_pages))
      SELECT page_id, label_ordinal, trim(regexp_extract(body, '<label[^>]*>([^<]*)', 1)) AS text, len(regexp_extract_all(CASE WHEN contains(body, ' for="') THEN split_part(html, ' id="' || regexp_extract(body, ' for="([^"]*)"', 1) || '"', 1) ELSE split_part(html, body, 1) || '<input' END, '<(?:input|select|textarea|button)')) - 1 AS control_ordinal FROM l""",
    "surface_sources": duck_with("form_pages") + """SELECT page_id, 'raster' AS surface_kind, array_to_string(list_sort(list(DISTINCT src)), ',') AS sources, count(*) AS n FROM (SELECT page_id, unnest(list_concat(regexp_extract_all(html, '<img src="([^"]*)"', 1), regexp_extract_all(html, 'background-image:url[(]([^)]*)[)]', 1))) AS src FROM form_pages) GROUP BY page_id""",
    "extract_controls": duck_with("controls") + "SELECT page_id, ordinal, name, type, value_length, value_length > 0 AS value_present, trim(label) AS label, CASE WHEN value_length = 0 THEN 'empty' WHEN type IN ('checkbox', 'radio') THEN 'choice' WHEN value_length <= 8 THEN 'short' WHEN value_length <= 32 THEN 'medium' ELSE 'long' END AS value_class FROM controls",
    "option_classes": duck_with("controls") + f"SELECT page_id, ordinal, CAST(pos AS INTEGER) AS pos, option_length, CASE WHEN option_length = 0 THEN 'placeholder' WHEN option_length <= 8 THEN 'short' ELSE 'long' END AS option_class, pos % 3 = 2 AS disabled FROM ({_OPT.format('controls')})",
    "accessible_names": duck_with("controls") + "SELECT page_id, ordinal, CASE WHEN visible AND trim(label) <> '' THEN trim(label) ELSE type || ' ' || name END AS accessible_name FROM controls",
    "control_keys": duck_with("controls") + f"SELECT page_id, viewport, ordinal, key FROM ({_keyed_sql('controls', _BASES['controls'])})",
    "link_keys": duck_with("links") + f"SELECT page_id, viewport, ordinal, key FROM ({_keyed_sql('links', _BASES['links'])})",
    "links_diff": duck_with("links_cand") + _diff_sql("links", LINK_PROPS),
    "controls_diff": duck_with("controls_cand") + _diff_sql("controls", CONTROL_PROPS),
    "headings_diff": duck_with("headings_cand") + _diff_sql("headings", HEADING_PROPS),
    "options_diff": duck_with("controls_cand") + f"""SELECT page_id, ordinal, CAST(pos AS INTEGER) AS pos, coalesce(base_length, -1) AS base_length, coalesce(cand_length, -1) AS cand_length FROM (SELECT *, row_number() OVER (PARTITION BY page_id, ordinal ORDER BY pos) AS rn FROM (
      SELECT coalesce(b.page_id, c.page_id) AS page_id, coalesce(b.ordinal, c.ordinal) AS ordinal, coalesce(b.pos, c.pos) AS pos, b.option_length AS base_length, c.option_length AS cand_length
      FROM ({_OPT.format("controls")}) b FULL OUTER JOIN ({_OPT.format("controls_cand")}) c ON b.page_id = c.page_id AND b.ordinal = c.ordinal AND b.pos = c.pos) WHERE base_length IS DISTINCT FROM cand_length) WHERE rn <= 20""",
    "mask_diff": duck_with("rects_cand") + """SELECT b.page_id, b.kind, len(b.r) AS n_base, coalesce(len(c.r), 0) AS n_cand FROM (SELECT page_id, kind, list((n, x, y, w, h) ORDER BY n) AS r FROM rects GROUP BY ALL) b
      LEFT JOIN (SELECT page_id, kind, list((n, x, y, w, h) ORDER BY n) AS r FROM rects_cand GROUP BY ALL) c ON b.page_id = c.page_id AND b.kind = c.kind WHERE b.r IS DISTINCT FROM c.r""",
    "mismatch_counts": _ALL + f" SELECT page_id, viewport, category, {_N} FROM mm GROUP BY page_id, viewport, category UNION ALL SELECT page_id, viewport, 'total', {_N} FROM mm GROUP BY page_id, viewport",
    "critical_findings": _ALL + " SELECT * FROM mm WHERE kind IN ('missing', 'extra') OR list_has_any(string_split(fields, ','), " + str(D.IMPORTANT) + ")",
    "mismatch_preview": _ALL + " SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY page_id, viewport, category, kind ORDER BY key) AS rn FROM mm) WHERE rn <= CASE WHEN kind = 'changed' THEN 20 ELSE 10 END",
    "retain_details": _ALL + " SELECT * EXCLUDE (rn), total > 2 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY page_id, viewport, category, kind ORDER BY key) AS rn, count(*) OVER (PARTITION BY page_id, viewport, category, kind) AS total FROM mm) WHERE rn <= 2",
    "apply_approvals": _ALL + " SELECT * REPLACE (CAST(coalesce(rule, -1) AS INTEGER) AS rule, coalesce(rationale, '') AS rationale) FROM (" + _APPROVED + ")",
    "admit_policy": _ALL + f""" SELECT rule, violations FROM (SELECT rule, concat_ws(',', CASE WHEN fields NOT IN ('value_length', 'value_length,value_present', 'action', 'action,method', 'href', '') THEN 'unsafe_fields' END,
      CASE WHEN length(rationale) < 12 THEN 'short_rationale' END, CASE WHEN kind IN ('missing', 'extra') AND NOT starts_with(key, 'hidden') THEN 'unsafe_presence' END) AS violations FROM ({_APPROVED}) WHERE approved) WHERE violations <> ''""",
    "inventory_crosscheck": duck_with("links_cand", "headings") + """, a AS (SELECT page_id, len(regexp_extract_all(html, '<a ')) AS n_links, len(regexp_extract_all(html, '<h[1-6]')) AS n_headings FROM pages),
      l AS (SELECT page_id, count(*) AS n_links FROM links_cand GROUP BY 1), h AS (SELECT page_id, count(*) AS n_headings FROM headings GROUP BY 1)
      SELECT page_id, 'n_links' AS field, a.n_links AS count_a, l.n_links AS count_b FROM a JOIN l USING (page_id) WHERE a.n_links <> l.n_links
      UNION ALL SELECT page_id, 'n_headings', a.n_headings, coalesce(h.n_headings, 0) FROM a JOIN l USING (page_id) LEFT JOIN h USING (page_id) WHERE a.n_headings <> coalesce(h.n_headings, 0)""",
    "primary_action": duck_with("controls") + "SELECT page_id, ordinal, name FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY regexp_matches(lower(name), '" + D.SUBMIT_WORDS + "') DESC, ordinal) AS rn FROM (SELECT page_id, ordinal, visible, type, " + NAMED + " AS name FROM controls) WHERE visible AND type <> 'hidden') WHERE rn = 1",
}
