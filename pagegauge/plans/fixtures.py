"""Fixtures: rows that Spark and the SQL oracle derive alike from the given tables.

A fixture is one SQL text for both engines (or one for each, where they differ); ``{name}`` stands for a table or
another fixture.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TIES = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"
CONTROL = """lower(l_returnflag || l_linestatus) AS name, CASE l_suppkey % 4 WHEN 0 THEN 'checkbox' WHEN 1 THEN 'hidden' ELSE 'text' END AS type,
        cast(floor(l_quantity) AS int) AS value_length, l_discount > 0.05 AS required, l_tax < 0.06 AS visible, 'Label ' || cast(l_partkey % 17 AS string) AS label,
        cast(l_partkey % 5 AS int) AS n_options, CASE WHEN l_suppkey % 6 < 4 THEN 'post' ELSE 'get' END AS form_method,
        CASE l_suppkey % 6 WHEN 0 THEN 'https://shop.example.com/submit' WHEN 1 THEN 'https://shop.example.com/submit?x=1' WHEN 2 THEN 'https://evil.example.net/submit' ELSE 'https://shop.example.com/submit' END AS form_action,
        CASE WHEN l_suppkey % 6 = 3 THEN 'text/plain' ELSE 'multipart/form-data' END AS form_enctype, l_partkey, l_suppkey"""
A = '<a href="([^"]*)">([^<]*)</a>'

FIXTURES: dict[str, str | tuple[str, str]] = {
    "page_rows": """SELECT page_id, url, html, regexp_extract(html, '<style>([^<]*)</style>', 1) || CASE WHEN page_id % 4 = 0 THEN
        '@import "/s' || cast(page_id % 9 AS string) || '.css"; a{{background:url(/i' || cast(page_id % 7 AS string) || '.png)}}' ELSE '' END AS css FROM {pages}""",
    "form_pages": """SELECT page_id, url, html || '<form action="/submit/' || cast(page_id AS string) || '" method="post"><label for="a' || cast(page_id AS string) || '">Name</label><input id="a' || cast(page_id AS string)
        || '" name="n" type="text"><label>Size <select name="s"><option>small<option>large</select></label><img src="/i' || cast(page_id % 5 AS string) || '.png" style="background-image:url(/b.png)"></form>' AS html FROM {pages}""",
    "named_pages": """SELECT page_id, url, html || '<span id="w' || cast(page_id AS string) || '">Word ' || cast(page_id AS string) || '</span><span id=v' || cast(page_id AS string) || '>  Verb <b>' || cast(page_id % 7 AS string)
        || '</b></span><form action=/x><input aria-labelledby="w' || cast(page_id AS string) || ' none v' || cast(page_id AS string) || '"><label for=f' || cast(page_id AS string) || '>For ' || cast(page_id AS string)
        || '</label><input id="f' || cast(page_id AS string) || '" type=EMAIL><fieldset><legend>Legend ' || cast(page_id % 5 AS string) || '</legend><label>Around ' || cast(page_id AS string) || '<input type="radio" value=yes></label></fieldset><button>Go '
        || cast(page_id AS string) || '</button><select title="pick ' || cast(page_id AS string) || '"><option value="">-<option value="' || cast(page_id % 3 AS string) || '">n<option value="big ' || cast(page_id AS string) || '">Big '
        || cast(page_id AS string) || '<option disabled value=k' || cast(page_id AS string) || '>Other</select></form>' AS html FROM {pages}""",
    "rich_pages": """SELECT page_id, url, html || CASE page_id % 6
        WHEN 0 THEN '<a class="x" href="/deep/' || cast(page_id AS string) || '?q=1" rel="nofollow">  <b>Deep</b> page </a><a name="here">no address</a><iframe src="/f"></iframe><link rel="stylesheet" href="/s.css"><script src="https://cdn.example.net/x.js"></script>'
        WHEN 1 THEN '<a href=''https://other.example.net/y'' target=_blank aria-label=" Go  there ">Out <i>side</i></a><form action="/api/applications" method="POST"><input name="a"></form><form action="/other" method="post"></form><meta http-equiv="refresh" content="5">'
        WHEN 2 THEN '<a href="javascript:void(0)">Run</a><A HREF="mailto:a@example.com" data-n="1">Mail</A><object data="/o.bin"></object><embed src="/e"><svg><use href="#i"></use><use xlink:href="/sprite.svg#i"></use></svg>'
        WHEN 3 THEN '<a rel="me" href="//third.example.org/z#top"><span>Third</span></a><link rel="stylesheet" href="https://cdn.example.net/s.css"><p data-replica-disclosure>copy</p>'
        WHEN 4 THEN '<a href="https://user:pw@site.example.com/">Login</a><script src="/own.js"></script><form method="get"></form><img alt="" src="/i.png">'
        ELSE '<base href="/sub/"><a href="leaf?x=1">Leaf</a>' END AS html FROM {pages}""",
    "links": (
        f"""SELECT page_id, 'default' AS viewport, cast(pos AS bigint) AS ordinal, regexp_extract(col, '{A}', 1) AS href, regexp_extract(col, '{A}', 2) AS text
        FROM {{pages}} LATERAL VIEW posexplode(regexp_extract_all(html, '{A}', 0)) AS pos, col""",
        f"""SELECT page_id, 'default' AS viewport, o AS ordinal, regexp_extract(m, '{A}', 1) AS href, regexp_extract(m, '{A}', 2) AS text
        FROM (SELECT page_id, unnest(l) AS m, unnest(range(len(l))) AS o FROM (SELECT page_id, regexp_extract_all(html, '{A}', 0) AS l FROM {{pages}}))""",
    ),
    "links_cand": """SELECT page_id, viewport, ordinal, CASE WHEN page_id % 7 = 0 AND ordinal = 1 THEN href || '?v=2' ELSE href END AS href, text FROM {links} WHERE NOT (page_id % 5 = 0 AND ordinal = 3)
        UNION ALL SELECT page_id, viewport, max(ordinal) + 1, '/added', 'Added' FROM {links} WHERE page_id % 11 = 0 GROUP BY page_id, viewport""",
    "headings": "SELECT page_id, 'default' AS viewport, cast(0 AS bigint) AS ordinal, cast(1 AS int) AS level, regexp_extract(html, '<h1>([^<]*)', 1) AS text FROM {pages} WHERE regexp_extract(html, '<h1>([^<]*)', 0) <> ''",
    "headings_cand": "SELECT page_id, viewport, ordinal, level, CASE WHEN page_id % 13 = 0 THEN text || '!' ELSE text END AS text FROM {headings}",
    # Spark keeps the rows dealt by page from the numbering on
    "controls": (
        f"""SELECT page_id, 'default' AS viewport, ordinal, {CONTROL} FROM (SELECT *, cast(row_number() OVER (PARTITION BY page_id ORDER BY {TIES}) - 1 AS bigint) AS ordinal FROM (SELECT *, l_orderkey AS page_id FROM {{lineitem}}))""",
        f"""SELECT l_orderkey AS page_id, 'default' AS viewport, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY {TIES}) - 1 AS bigint) AS ordinal,
        {CONTROL} FROM {{lineitem}}""",
    ),
    "controls_cand": """SELECT page_id, viewport, ordinal, name, type, value_length + CASE WHEN l_partkey % 23 = 0 THEN 1 ELSE 0 END AS value_length,
        CASE WHEN l_suppkey % 19 = 0 THEN NOT required ELSE required END AS required, visible, label, n_options, form_method, form_action, form_enctype, l_partkey, l_suppkey
        FROM {controls} WHERE (l_partkey + l_suppkey) % 29 <> 0
        UNION ALL SELECT page_id, viewport, max(ordinal) + 1, 'extra', 'text', 0, false, true, 'Label x', 0, 'post', 'https://shop.example.com/submit', 'multipart/form-data', cast(0 AS bigint), cast(0 AS bigint)
        FROM {controls} WHERE page_id % 31 = 0 GROUP BY page_id, viewport""",
    "approvals": """SELECT cast(rule AS int) AS rule, viewport, category, kind, key, fields, rationale FROM (VALUES
        (0, 'default', 'controls', 'changed', 'text|af|#0', 'value_length', 'placeholder length differs by design'),
        (1, 'default', 'controls', 'changed', 'text|no|#0', 'value_length', 'placeholder length differs by design'),
        (2, 'default', 'controls', 'changed', 'text|no|#0', 'value_length', 'a later rule for the same key'),
        (3, 'default', 'controls', 'missing', 'hidden|no|#0', '', 'hidden field left out on purpose'),
        (4, 'default', 'controls', 'changed', 'text|rf|#0', 'required,value_length', 'two fields at once'),
        (5, 'default', 'controls', 'changed', 'checkbox|no|#0', 'required', 'short')) AS t(rule, viewport, category, kind, key, fields, rationale)""",
    "pixels": (
        """SELECT raster, y, cast(x AS int) AS x, cast((v % 256 + 256) % 256 AS int) AS v, vec_id FROM (
        SELECT cast(label AS int) AS raster, cast(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS int) AS y, vec_id, embedding FROM {embeddings})
        LATERAL VIEW posexplode(transform(embedding, e -> cast(floor((cast(e AS double) + 0.5) * 255) AS int))) AS x, v""",
        """SELECT raster, y, cast(x AS int) AS x, cast((v % 256 + 256) % 256 AS int) AS v, vec_id FROM (
        SELECT cast(label AS int) AS raster, cast(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS int) AS y, vec_id,
        unnest(range(len(embedding))) AS x, unnest(list_transform(embedding, lambda e: cast(floor((cast(e AS double) + 0.5) * 255) AS int))) AS v FROM {embeddings})""",
    ),
    "raster_base": "SELECT raster, y, x, v AS r, 255 - v AS g, v * 7 % 256 AS b, 255 AS a FROM {pixels}",
    "raster_cand": """SELECT raster, y, x, w AS r, 255 - w AS g, w * 7 % 256 AS b, 255 AS a FROM (
        SELECT raster, y, x, CASE WHEN (vec_id * 64 + x) % 17 = 0 THEN (v + 40) % 256 ELSE v END AS w, max(y) OVER (PARTITION BY raster) AS last FROM {pixels}) AS t
        WHERE NOT (raster % 3 = 0 AND y = last)""",
    "telemetry": """SELECT event_id AS seq, ts, user_id AS session, CASE event_type WHEN 'view' THEN 'request_started' WHEN 'click' THEN 'request_finished' WHEN 'error' THEN 'request_failed' WHEN 'purchase' THEN 'write_attempt' ELSE 'external_read' END AS kind,
        CASE WHEN event_type = 'purchase' THEN 'POST' WHEN event_id % 5 = 0 THEN 'HEAD' ELSE 'GET' END AS method,
        CASE event_id % 6 WHEN 0 THEN 'document' WHEN 1 THEN 'stylesheet' WHEN 2 THEN 'script' WHEN 3 THEN 'image' WHEN 4 THEN 'font' ELSE 'media' END AS resource_type,
        cast(event_id % 12 AS int) AS attempt, CASE WHEN event_type = 'signup' THEN cast(event_id % 4 AS int) END AS phase,
        'synthetic-' || cast(cast(floor(value) AS bigint) AS string) AS idem_key, cast(floor(value) AS bigint) AS amount, props FROM {events}""",
    "rects": f"""SELECT page_id, n, x, y, least(w, 1000 - x) AS w, least(h, 2000 - y) AS h, kind, bytes, partkey FROM (
        SELECT l_orderkey AS page_id, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY {TIES}) - 1 AS bigint) AS n,
        CASE WHEN l_orderkey % 50 = 0 AND l_linenumber = 1 THEN 0 ELSE l_partkey * 37 % 1000 END AS x, CASE WHEN l_orderkey % 50 = 0 AND l_linenumber = 1 THEN 0 ELSE l_suppkey * 91 % 2000 END AS y,
        CASE WHEN l_orderkey % 50 = 0 AND l_linenumber = 1 THEN 1000 ELSE 1 + l_partkey % 400 END AS w, CASE WHEN l_orderkey % 50 = 0 AND l_linenumber = 1 THEN 1700 ELSE 1 + cast(floor(l_quantity) AS bigint) * 8 END AS h,
        CASE WHEN l_linestatus = 'O' THEN 'raster' ELSE 'vector' END AS kind, cast(floor(l_extendedprice) AS bigint) AS bytes, l_partkey AS partkey FROM {{lineitem}}) AS t""",
    "rects_cand": "SELECT page_id, n, CASE WHEN partkey % 9 = 0 THEN x + 1 ELSE x END AS x, y, w, h, kind, bytes, partkey FROM {rects}",
    "files": "SELECT source AS tree, source || '/' || lang || '/' || cast(doc_id AS string) || '.txt' AS path, CASE WHEN doc_id % 10 = 0 THEN '100755' ELSE '100644' END AS mode, text AS content, doc_id FROM {documents}",
    "files_actual": """SELECT tree, path, CASE WHEN doc_id % 83 = 0 THEN '100600' ELSE mode END AS mode, CASE WHEN doc_id % 89 = 0 THEN content || '!' ELSE content END AS content, doc_id FROM {files} WHERE doc_id % 97 <> 0
        UNION ALL SELECT tree, tree || '/added.txt', '100644', 'added', cast(-1 AS bigint) FROM {files} GROUP BY tree""",
    "iterations": """SELECT o_custkey AS series, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS int) AS seq, o_orderkey AS run_id,
        CASE o_orderkey % 4 WHEN 0 THEN 'desktop' WHEN 1 THEN 'tablet' WHEN 2 THEN 'mobile' ELSE 'narrow' END AS viewport,
        CASE WHEN o_orderstatus <> 'F' THEN 1.0e0 ELSE 0.0e0 END AS v1, cast(o_orderkey % 5 AS double) AS v2, cast(floor(o_totalprice) AS bigint) % 1000 / 1000.0e0 AS v3,
        cast(floor(o_totalprice) AS bigint) % 700 / 1000.0e0 AS v4, cast(floor(o_totalprice) AS bigint) % 300 / 1000.0e0 AS v5 FROM {orders}""",
    "score_metrics": """SELECT series, seq, run_id, viewport, CASE WHEN run_id % 101 = 0 THEN cast(NULL AS double) ELSE v3 END AS tolerant, v4 * 3 AS strict, cast(v2 AS bigint) AS unapproved,
        CASE WHEN run_id % 61 = 0 THEN cast(NULL AS bigint) ELSE cast(run_id % 59 % 2 * (run_id % 7 % 2) * (run_id % 3 % 2) AS bigint) END AS baseline_tampering,
        CASE WHEN run_id % 53 = 0 THEN cast(2 AS bigint) ELSE cast(0 AS bigint) END AS candidate_tampering,
        CASE WHEN run_id % 47 = 0 THEN cast(NULL AS boolean) ELSE run_id % 13 <> 0 END AS dimensions_match, run_id % 17 <> 0 AS stable,
        cast(CASE WHEN run_id % 19 = 0 THEN 40 ELSE 0 END AS bigint) AS masked_pixels, cast(CASE WHEN run_id % 23 = 0 THEN 1 ELSE 0 END AS bigint) AS critical_failures,
        cast(CASE WHEN run_id % 29 = 0 THEN 3 ELSE 0 END AS bigint) AS page_errors, CASE WHEN run_id % 31 = 0 THEN cast(2 AS bigint) WHEN run_id % 37 = 0 THEN cast(NULL AS bigint) ELSE cast(0 AS bigint) END AS console_errors,
        cast(v1 AS bigint) AS blocked_writes, cast(CASE WHEN run_id % 41 = 0 THEN 1 ELSE 0 END AS bigint) AS blocked_private_reads,
        cast(v2 AS bigint) + 2 AS reported, cast(v2 AS bigint) + CASE WHEN run_id % 43 = 0 THEN 1 ELSE 2 END AS retained FROM {iterations}""",
    "gate_policy": """SELECT viewport, gate, cast(lim AS double) AS lim FROM (VALUES (cast(NULL AS string), 'strict', 1.5), ('mobile', 'tolerant', 0.4), ('narrow', 'unapproved', 2.0),
        ('tablet', 'require_dimensions', 0.0), ('desktop', 'require_stable', 0.0), (cast(NULL AS string), 'console_errors', 2.0)) AS t(viewport, gate, lim)""",
    "gate_override": "SELECT gate, cast(lim AS double) AS lim FROM (VALUES ('strict', 1.8)) AS t(gate, lim)",
    "run_parts": """SELECT series, run_id, CASE seq % 7 WHEN 1 THEN 'source_self' WHEN 2 THEN 'candidate_self' WHEN 3 THEN 'source_candidate' WHEN 4 THEN 'integrity' WHEN 5 THEN 'interaction' WHEN 6 THEN 'command' ELSE 'source_candidate' END AS part,
        CASE run_id % 3 WHEN 0 THEN 'SUBMISSION_COUNT' WHEN 1 THEN 'RETRY_COUNT' ELSE 'receipt_missing' END AS failure, run_id % 4 <> 0 AS passed FROM {iterations}""",
    "nodes": """SELECT p_partkey AS node, CASE WHEN p_partkey >= 4 THEN cast(floor(p_partkey / 4) AS bigint) END AS parent, p_size % 25 = 0 AS hidden,
        CASE p_partkey % 3 WHEN 0 THEN 1.0e0 WHEN 1 THEN 0.5e0 ELSE 0.25e0 END AS opacity, cast(p_size AS int) AS clip_from, cast(p_size + 30 + p_partkey % 40 AS int) AS clip_to,
        cast(p_partkey * 7 % 256 AS int) AS fr, cast(p_partkey * 13 % 256 AS int) AS fg, cast(p_size * 5 % 256 AS int) AS fb, cast(p_size * 11 % 256 AS int) AS br, cast(p_partkey * 3 % 256 AS int) AS bg, cast(p_partkey % 256 AS int) AS bb,
        cast(4 + p_size % 12 AS int) AS font_px, CASE p_partkey % 4 WHEN 0 THEN 1.0e0 WHEN 1 THEN 0.75e0 WHEN 2 THEN 0.5e0 ELSE 0.25e0 END AS alpha FROM {part}""",
    "audit_urls": """SELECT page_id, 'https://site.example.com' AS allowed, CASE page_id % 26
        WHEN 0 THEN 'https://site.example.com/plain/' || cast(page_id AS string) WHEN 1 THEN 'https://site.example.com/a?access_token=abc123456' WHEN 2 THEN 'https://cdn.example.net/a?%2570assword=secret99'
        WHEN 3 THEN 'https://site.example.com/password-reset/a1b2c3d4e5' WHEN 4 THEN 'https://site.example.com/invite/123e4567-e89b-12d3-a456-426614174000' WHEN 5 THEN 'https://api.example.org/sk-abcdefghijklmnopqrstuvwx/x'
        WHEN 6 THEN 'https://site.example.com/eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl' WHEN 7 THEN 'https://site.example.com/u/someone@example.com' WHEN 8 THEN 'https://site.example.com/call?phone=%2B1-555-010-9999'
        WHEN 9 THEN 'https://user:pw@site.example.com/' WHEN 10 THEN 'https://site.example.com/go?next=https%3A%2F%2Fother.example.com%2F%3Ftoken%3Dabcdefgh' WHEN 11 THEN 'http://10.1.2.' || cast(page_id % 250 AS string) || '/x'
        WHEN 12 THEN 'http://172.20.0.5:8080/x' WHEN 13 THEN 'http://127.0.0.1:3000/x' WHEN 14 THEN CASE page_id % 3 WHEN 0 THEN 'http://db.service.internal/x' WHEN 1 THEN 'http://192.88.99.7/x' ELSE 'http://abcdefgh.onion/x' END
        WHEN 15 THEN 'https://site.example.com/reset-password-token-abcdefghij' WHEN 16 THEN 'https://site.example.com/a?data=%7B%22accessToken%22%3A%22x%22%7D' WHEN 17 THEN 'https://site.example.com/a?u=//other.example.com/reset/abcdefgh12'
        WHEN 18 THEN 'https://site.example.com/a?text=see+(https%3A%2F%2Fx.example.com%2F%3Fpassword%3D1)%2C' WHEN 19 THEN 'https://site.example.com/a#access_token=abc' WHEN 20 THEN 'https://site.example.com/a?q=%2525252525252541'
        WHEN 21 THEN 'https://site.example.com/x/akiaabcdefghijkl12/y' WHEN 22 THEN 'https://site.example.com/a?q=5550109999x&gh_jid=12345'
        WHEN 23 THEN 'https://site.example.com/a?next=https%3A%2F%2Fa.example%2F%3Fnext%3Dhttps%253A%252F%252Fb.example%252Finvite%252Fabcdefgh1' WHEN 24 THEN 'https://site.example.com/a?mailTo=a@b.example' ELSE 'https://8.8.8.8/x?q=1#frag' END AS url FROM {pages}""",
    "headers": """SELECT page_id, CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'default-src ''self''; frame-ancestors ''none''' WHEN 2 THEN 'default-src ''none''; script-src ''self''; script-src ''none'''
        WHEN 3 THEN 'default-src https:; form-action ''self'', default-src ''none'';object-src ''none''' WHEN 4 THEN 'SCRIPT-SRC ''self'' https://cdn.example.net' ELSE 'base-uri ''none''; object-src ''none''; script-src ''self''; connect-src ''self''; form-action ''none''; frame-ancestors ''none''' || CASE page_id % 5 WHEN 0 THEN '; script-src-elem ''self''' WHEN 1 THEN '; script-src-attr https:' WHEN 2 THEN '; script-src ''self''' ELSE '' END END AS csp,
        CASE page_id % 4 WHEN 0 THEN 'DENY' WHEN 1 THEN 'sameorigin' WHEN 2 THEN 'ALLOW-FROM https://x.example' ELSE '' END AS frame_options, page_id % 9 = 0 AS has_refresh FROM {pages}""",
    "evidence": """SELECT page_id, cast(page_id % 40 AS bigint) AS total, cast(CASE WHEN page_id % 8 = 0 THEN page_id % 40 + 1 WHEN page_id % 40 > 30 THEN 30 ELSE page_id % 40 END AS bigint) AS retained, cast(30 AS bigint) AS lim,
        page_id % 40 > 30 AND page_id % 3 <> 0 AS truncated, CASE WHEN page_id % 17 = 0 THEN 1.5e0 WHEN page_id % 19 = 0 THEN NULL ELSE (page_id % 100) / 100.0e0 END AS ratio, CASE WHEN page_id % 23 = 0 THEN 'mobile' ELSE 'desktop' END AS viewport, 'desktop' AS expected FROM {pages}""",
    "assets": """SELECT page_id, '/a' || cast(page_id % 37 AS string) || '.css' AS path, url FROM {pages}""",
    "assets_graph": "SELECT page_id, path FROM {assets} WHERE page_id % 6 <> 0",
    "assets_dom": "SELECT page_id, CASE WHEN page_id % 10 = 0 THEN path || '.old' ELSE path END AS path FROM {assets}",
    "samples": """SELECT page_id, variant, instant, NOT (page_id % 7 = 0 AND instant = 2 AND variant = 3) AS visible, page_id % 11 = 0 AND variant = 5 AS occluded, variant AS environment FROM {pages},
        (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS v(variant), (VALUES (0), (1), (2)) AS i(instant) WHERE NOT (page_id % 9 = 0 AND variant = 6)""",
    "numeric_urls": """SELECT page_id, 'https://site.example.com' AS allowed, CASE page_id % 8 WHEN 0 THEN 'http://127.' || cast(page_id % 200 AS string) || '/' WHEN 1 THEN 'http://0177.0.0.' || cast(page_id % 200 + 8 AS string) || '/'
        WHEN 2 THEN 'http://0x7f.0.0.1/x' || cast(page_id AS string) WHEN 3 THEN 'http://' || cast(167772160 + page_id AS string) || ':8080/' WHEN 4 THEN 'http://0xC0A80' || cast(100 + page_id % 100 AS string) || '/'
        WHEN 5 THEN 'http://８.8.8.8/' WHEN 6 THEN 'http://134744' || cast(100 + page_id % 800 AS string) || '/' ELSE 'http://172.1060865/' END AS url FROM {pages}""",
    "attributes": """SELECT page_id, 'data-' || cast(page_id % 14 AS string) AS name, CASE page_id % 14
        WHEN 0 THEN '{{"a":{{"b":[{{"c":{{"d":{{"' || chr(92) || 'u0061piKey":' || cast(page_id AS string) || '}}}}}}]}}}}' WHEN 1 THEN '/p?next=https%3A%2F%2Fa.example%2F%3Fu%3Dx%253Dy%2526sessionId%253D' || cast(page_id AS string)
        WHEN 2 THEN 'see https://u:pw@h' || cast(page_id AS string) || '.example/x' WHEN 3 THEN 'Bearer abcdefgh' || cast(page_id AS string) WHEN 4 THEN '/x?y=1#client_secret=' || cast(page_id AS string)
        WHEN 5 THEN '[[[[[[[[' || cast(page_id AS string) || ']]]]]]]]' WHEN 6 THEN '[[[[[[[' || cast(page_id AS string) || ']]]]]]]' WHEN 7 THEN repeat('ab', 32768) || cast(page_id AS string)
        WHEN 8 THEN '%25252525252541' WHEN 9 THEN '{{token: ' || cast(page_id AS string) WHEN 10 THEN '{{"n":"' || cast(page_id AS string) || '","' || chr(92) || 'u0074oken":null}}'
        WHEN 11 THEN '{{"q":"%7B%22%5Cu006awt%22%3A' || cast(page_id AS string) || '%7D"}}' WHEN 12 THEN 'https://h.example:x' || cast(page_id AS string) || '/' ELSE 'size=' || cast(page_id AS string) || '&url=' || url END AS value FROM {pages}""",
    "styled_nodes": """SELECT *, cast(left_px AS double) AS left, cast(top_px AS double) AS top, cast(width_px AS double) AS width, cast(height_px AS double) AS height,
        rule = 0 AS hidden, CASE WHEN rule = 1 THEN 'none' ELSE 'block' END AS display, CASE WHEN rule = 2 THEN 'collapse' ELSE 'visible' END AS visibility,
        CASE WHEN rule = 3 THEN 'hidden' ELSE 'visible' END AS content_visibility,
        CASE rule WHEN 4 THEN 'blur(1px) opacity(0%)' WHEN 9 THEN 'opacity(50%)' WHEN 13 THEN 'opacity(.5) blur(3px)' WHEN 14 THEN 'blur(1.5px)' ELSE 'none' END AS filter,
        CASE rule WHEN 5 THEN 'rect(10px, 5px, 20px, 5px)' WHEN 21 THEN 'rect(0px, 50px, 20px, 0px)' ELSE 'auto' END AS clip,
        CASE rule WHEN 6 THEN 'inset(60% 5px 40%)' WHEN 7 THEN 'circle(0px at 50% 50%)' WHEN 8 THEN 'polygon(0 0, 0 0, 0  0)' WHEN 10 THEN 'inset(10% 5px round 3px)' WHEN 11 THEN 'circle(5px)' WHEN 12 THEN 'polygon(0 0, 5 0, 5 5)'
            WHEN 19 THEN 'inset(50%)' ELSE 'none' END AS clip_path,
        CASE rule WHEN 15 THEN 'matrix(0.4, 0, 0, 1, 0, 0)' WHEN 16 THEN 'matrix(1, 0, 0, 1, 5, 5)' WHEN 17 THEN 'matrix3d(1, 0, 0, 0, 0, 2e-1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)' ELSE 'none' END AS transform,
        CASE WHEN rule = 18 THEN 'url(m.png)' ELSE 'none' END AS mask_image, CASE WHEN rule = 20 THEN 'linear-gradient(red, blue)' ELSE 'none' END AS background_image,
        CASE k % 11 WHEN 0 THEN 0.5e0 WHEN 1 THEN cast(NULL AS double) ELSE 1.0e0 END AS opacity, node = 0 AS is_root, node % 9 = 3 AS is_disclosure,
        CASE k % 5 WHEN 0 THEN 'hidden' WHEN 1 THEN 'clip' ELSE 'visible' END AS overflow_x, CASE WHEN k % 7 = 0 THEN 'hidden' ELSE 'auto' END AS overflow_y,
        CASE WHEN k % 43 = 0 THEN 0.0e0 ELSE 12.0e0 END AS font_px,
        CASE k % 8 WHEN 0 THEN 'transparent' WHEN 1 THEN 'rgba(' || rgb || ', 0.5)' WHEN 2 THEN 'rgb(' || replace(rgb, ',', '') || ' / 75%)' ELSE 'rgb(' || rgb || ')' END AS color, CASE WHEN k % 6 = 0 THEN cast(NULL AS string) WHEN k % 47 = 1 THEN 'color(srgb 1 0 0 / 0)'
            ELSE 'rgb(' || rgb || ')' END AS fill_color,
        CASE k % 3 WHEN 0 THEN 'rgba(0, 0, 0, 0)' WHEN 1 THEN 'rgba(' || ground || ', 0.5)' ELSE 'rgb(' || ground || ')' END AS background_color FROM (
        SELECT k, page_id, node, parent, rule, p_size * 3 % 60 AS left_px, k * 3 % 80 AS top_px, 100 + k % 50 AS width_px, CASE WHEN k % 41 = 0 THEN 0 ELSE 90 + p_size % 40 END AS height_px, r, g, b, br, bg, bb,
            cast(r AS string) || ', ' || cast(g AS string) || ', ' || cast(b AS string) AS rgb, cast(br AS string) || ', ' || cast(bg AS string) || ', ' || cast(bb AS string) AS ground FROM (
        SELECT p_partkey AS k, p_partkey % 10 AS page_id, cast(floor(p_partkey / 10) AS bigint) AS node,
            CASE WHEN p_partkey < 10 THEN cast(NULL AS bigint) WHEN p_partkey % 10 = 0 THEN cast(floor(p_partkey / 10) AS bigint) - 1 ELSE cast(floor((floor(p_partkey / 10) - 1) / 4) AS bigint) END AS parent,
            (p_partkey * 7 + p_size) % 113 AS rule, p_size, p_partkey * 7 % 256 AS r, p_partkey * 13 % 256 AS g, p_size * 5 % 256 AS b, p_size * 11 % 256 AS br, p_partkey * 3 % 256 AS bg, p_partkey % 256 AS bb FROM {part}) AS t) AS u""",
    "flows": """SELECT o_orderkey AS session, o_orderkey % 22 AS fault, 'https://site.example.com' AS origin, 'https://site.example.com/api/applications' AS endpoint, cast(CASE WHEN o_orderkey % 22 = 1 THEN 2 ELSE 0 END AS bigint) AS unfilled,
        o_orderkey % 22 <> 2 AS has_submit, CASE WHEN o_orderkey % 22 = 3 THEN cast(NULL AS boolean) ELSE true END AS email_off, o_orderkey % 22 <> 4 AS keeps_nothing FROM {orders}""",
    "flow_requests": """SELECT session, seq, phase, method, CASE WHEN seq = 4 THEN endpoint || '/draft' ELSE endpoint END AS url FROM {flows},
        (VALUES (1, 'load', 'GET'), (2, 'submission', 'POST'), (3, 'submission', 'POST'), (4, 'submission', 'PUT'), (5, 'retry', 'POST'), (6, 'submission', 'HEAD')) AS v(seq, phase, method)
        WHERE NOT (seq = 3 AND fault <> 5) AND NOT (seq = 5 AND fault = 6) AND NOT (seq = 2 AND fault = 7)""",
    "flow_receipts": """SELECT session, seq, phase, CASE WHEN phase = 'lookup' THEN endpoint || '/r' ELSE endpoint END AS url, CASE WHEN fault = 9 AND phase = 'retry' THEN 409 ELSE 201 END AS status,
        CASE WHEN fault = 10 AND phase = 'submission' THEN 'text/html' ELSE 'Application/JSON; charset=utf-8' END AS content_type, CASE WHEN fault = 11 AND phase = 'retry' THEN 'other' ELSE 'r' || cast(session AS string) END AS id,
        true AS well_formed, fault = 12 AND phase = 'lookup' AS retained FROM {flows}, (VALUES (1, 'submission'), (2, 'submission'), (3, 'retry'), (4, 'lookup')) AS v(seq, phase)
        WHERE NOT (seq = 2 AND fault <> 8) AND NOT (fault = 13 AND phase = 'lookup')""",
    "flow_payloads": """SELECT session, seq, phase, 'm' AS metadata_digest, CASE WHEN fault = 14 THEN phase ELSE 'c' END AS content_digest, true AS canary, NOT (fault = 15 AND phase = 'retry') AS header, fault = 16 AND seq = 3 AS broken
        FROM {flows}, (VALUES (1, 'submission'), (2, 'retry'), (3, 'retry')) AS v(seq, phase) WHERE NOT (seq = 3 AND fault <> 16)""",
    "flow_audits": """SELECT session, seq, cast(CASE WHEN fault = 18 THEN 3 ELSE seq END AS bigint) AS attempts, cast(1 AS bigint) AS receipts, cast(1 AS bigint) AS keys, true AS well_formed FROM {flows}, (VALUES (1), (2)) AS v(seq) WHERE NOT (seq = 2 AND fault = 17)""",
    "flow_events": """SELECT session, kind FROM {flows}, (VALUES ('blocked_write', 19), ('page_error', 19), ('websocket', 20), ('websocket', 20), ('tampering', 20), ('focus', 0)) AS v(kind, f) WHERE f = fault""",
    "css_edges": """SELECT page_id, '/c' || cast(cast(floor(n / 2) AS bigint) AS string) || '.css' AS src, n AS ordinal, CASE partkey % 5 WHEN 0 THEN '/c' || cast(n % 4 AS string) || '.css' WHEN 1 THEN '/i' || cast(partkey % 3 AS string) || '.png'
        WHEN 2 THEN '/x.js' ELSE '/c' || cast(cast(floor(n / 2) AS bigint) + 1 AS string) || '.css' END AS dst FROM {rects}""",
    "css_files": """SELECT page_id, url, CASE WHEN url LIKE '%.css' THEN 'text/css' WHEN url LIKE '%.png' THEN 'image/png' ELSE 'text/javascript' END AS content_type, bytes,
        CASE WHEN bytes % 17 = 0 THEN 'dependency-fetch-failed' END AS failure FROM (SELECT page_id, dst AS url, sum(ordinal * 7 + 11) * (page_id % 13 + 1) AS bytes FROM (SELECT page_id, dst, cast(ordinal AS bigint) AS ordinal FROM {css_edges}) AS e GROUP BY page_id, dst) AS t""",
    "stored_records": """SELECT seq, CASE seq % 9 WHEN 0 THEN '{{"bodyBytes":' || cast(amount AS string) || ',"emailConfirmation":false,"p":' || props || '}}' WHEN 1 THEN '{{"a":[{{"b":{{"c":[{{"d":{{"fullName":' || props || '}}}}]}}}}]}}'
        WHEN 2 THEN '{{"note":"synthetic-RESUME.pdf","p":' || props WHEN 3 THEN '[{{"raw_body":{{"answers":[],"x":"synthetic.applicant@example.test"}}}},' || props || ']' WHEN 4 THEN '{{"x":"' || chr(92) || '"email' || chr(92) || '":1","k":' || props || '}}'
        WHEN 5 THEN cast(NULL AS string) WHEN 6 THEN props WHEN 7 THEN '"phone"' ELSE '{{"' || chr(92) || 'u0065mail":1,"t":"+15555550100"}}' END AS json FROM {telemetry}""",
}


def _needs(text: str) -> list[str]:
    return [f for _, f, _, _ in string.Formatter().parse(text) if f]


def _text(name: str, duck: bool) -> str:
    t = FIXTURES[name]
    return t if isinstance(t, str) else t[duck]


def spark_rows(spark: SparkSession, sf_dir: str, name: str, **made: DataFrame) -> DataFrame:
    """A given table or a fixture as a DataFrame; ``made`` are fixtures that are there already."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = _text(name, False)
    return spark.sql(text, **{n: made[n] if n in made else spark_rows(spark, sf_dir, n, **made) for n in _needs(text)})


def duck_with(*names: str) -> str:
    """``WITH`` clause that defines the fixtures (and what they need) for DuckDB."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in TABLES or name in order:
            return
        for n in _needs(_text(name, True)):
            add(n)
        order.append(name)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({_text(n, True).format(**{m: m for m in _needs(_text(n, True))})})" for n in order)
