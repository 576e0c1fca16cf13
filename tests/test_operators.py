"""Single operators on small inline rows."""

import pytest
from pyspark.sql import functions as F

from pagegauge.functions import expressions as X
from pagegauge.operators import corpus, diff, extract, gates, geometry, raster, telemetry, urls
from pagegauge.sources import readers


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def keyed(spark, items):
    df = spark.createDataFrame([(1, "default", i, n, v) for i, (n, v) in enumerate(items)], "page_id long, viewport string, ordinal long, name string, value int")
    return diff.assign_keys(df, F.col("name"))


def test_diff_of_equal_captures_is_empty(spark):
    a = keyed(spark, [("x", 1), ("x", 2), ("y", None)])
    assert diff.snapshot_diff(a, a, ["value"]).count() == 0


def test_diff_kinds_and_mirror(spark):
    a, b = keyed(spark, [("x", 1), ("x", 2), ("z", 3)]), keyed(spark, [("x", 1), ("x", 5), ("w", 3)])
    there = rows(diff.snapshot_diff(a, b, ["value"]).withColumn("fields", X.joined("fields")), "key", "kind", "fields")
    assert there == [("w|#0", "extra", ""), ("x|#1", "changed", "value"), ("z|#0", "missing", "")]
    back = rows(diff.snapshot_diff(b, a, ["value"]), "key", "kind")
    assert back == [("w|#0", "missing"), ("x|#1", "changed"), ("z|#0", "extra")]


def test_null_is_a_value_in_diffs(spark):
    a, b = keyed(spark, [("x", None)]), keyed(spark, [("x", 0)])
    assert rows(diff.snapshot_diff(a, b, ["value"]), "kind") == [("changed",)]
    assert diff.snapshot_diff(a, a, ["value"]).count() == 0


def test_approval_needs_the_exact_field_set(spark):
    m = spark.createDataFrame([("default", "controls", "changed", "k", ["b", "a"])], "viewport string, category string, kind string, key string, fields array<string>")
    rule = lambda i, f: (i, "default", "controls", "changed", "k", f, "because of a test")
    kind = "rule int, viewport string, category string, kind string, key string, fields string, rationale string"
    assert rows(diff.apply_approvals(m, spark.createDataFrame([rule(0, "a"), rule(2, "a,b"), rule(1, "b,a")], kind)), "approved", "rule") == [(True, 1)]
    assert rows(diff.apply_approvals(m, spark.createDataFrame([rule(0, "a")], kind)), "approved") == [(False,)]


def test_bands_map_to_the_element(spark):
    pixels = [(0, y, x, 0, 0, 0, 255) for y in range(8) for x in range(8)]
    kind = "raster int, y int, x int, r int, g int, b int, a int"
    base = spark.createDataFrame(pixels, kind)
    cand = spark.createDataFrame([(r, y, x, 255 if (x, y) in {(2, 3), (3, 3), (3, 4)} else 0, 0, 0, a) for r, y, x, *_, a in pixels], kind)
    pairs = raster.pixel_pairs(base, cand)
    assert rows(raster.pixel_metrics(pairs), "n_pixels", "n_changed", "n_padded") == [(64, 3, 0)]
    assert rows(raster.diff_bbox(pairs)) == [(0, 2, 3, 3, 4)]
    bands = raster.merge_bands(raster.axis_counts(pairs))
    assert rows(bands.where("axis = 'row'"), "start", "end", "pixels", "peak", "size") == [(3, 4, 3, 2, 2)]
    elements = spark.createDataFrame([(0, 7, 0, 3, 8, 2), (0, 8, 0, 6, 8, 2)], "raster int, n long, x int, y int, w int, h int")
    assert rows(raster.bands_to_elements(bands.where("axis = 'row'"), elements), "n", "area") == [(7, 16)]
    assert raster.axis_counts(raster.pixel_pairs(base, base)).count() == 0


def test_tolerant_metrics_match_without_tiles(spark):
    data = [(0, y, x, (x * y) % 250, (x + y) % 250, 10, 255) for y in range(150) for x in range(6)]
    kind = "raster int, y int, x int, r int, g int, b int, a int"
    pairs = raster.pixel_pairs(spark.createDataFrame(data, kind), spark.createDataFrame([(r, y, x, (c + 120 * ((x + y) % 7 == 0)) % 256, g, b, a) for r, y, x, c, g, b, a in data], kind))
    tiled = rows(raster.pixel_metrics_tolerant(pairs), "n_over", "n_anti_aliased")
    before, raster.TILE = raster.TILE, 10_000
    try:
        assert tiled == rows(raster.pixel_metrics_tolerant(pairs), "n_over", "n_anti_aliased")
    finally:
        raster.TILE = before
    assert sum(tiled[0]) == raster.pixel_metrics_yiq(pairs).first().n_over > 0


def test_union_area_counts_overlap_once(spark):
    kind = "page_id long, n long, x long, y long, w long, h long"
    r = spark.createDataFrame([(1, 0, 0, 0, 10, 10), (1, 1, 5, 5, 10, 10), (1, 2, 2, 2, 3, 3), (2, 0, 0, 0, 1000, 1700)], kind)
    assert rows(geometry.union_area(r), "page_id", "area", "alarm") == [(1, 175, False), (2, 1700000, True)]


def test_budget_is_greedy(spark):
    r = spark.createDataFrame([(1, 0, 60), (1, 1, 200), (1, 2, 50), (1, 3, 40), (1, 4, 1)], "page_id long, n long, bytes long")
    assert [x.reason for x in geometry.admit_budget(r, 100, 100, 2).orderBy("n").collect()] == ["admitted", "too_large", "over_total", "admitted", "too_many"]


def test_visibility_rolls_up(spark):
    kind = "node long, parent long, hidden boolean, opacity double, clip_from int, clip_to int"
    n = spark.createDataFrame([(1, None, False, 1.0, 0, 100), (2, 1, True, 1.0, 0, 100), (3, 2, False, 1.0, 0, 100), (4, 1, False, 0.0005, 0, 100), (5, 1, False, 1.0, 200, 300), (6, 1, False, 0.5, 10, 20)], kind)
    assert rows(geometry.effective_visibility(n), "node", "visible") == [(1, True), (2, False), (3, False), (4, False), (5, False), (6, True)]


def test_ledger(spark):
    kind = "series long, seq int, v1 double, v2 double, v3 double, v4 double, v5 double"
    it = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.5, 0.0, 0.0), (1, 2, 0.0, 0.0, 0.5 + 1e-14, 0.0, 0.0), (1, 3, 0.0, 0.0, 0.4, 9.0, 0.0), (1, 4, 1.0, 0.0, 0.0, 0.0, 0.0)], kind)
    assert rows(gates.iteration_ledger(it), "seq", "best_seq", "is_best", "regressed") == [(1, 1, True, False), (2, 1, False, False), (3, 3, True, False), (4, 3, False, True)]


@pytest.mark.parametrize(
    "url,issue",
    [
        ("https://a.example/x", None),
        ("https://u:p@a.example/", "userinfo"),
        ("https://a.example/?access_token=abc", "parameter"),
        ("https://a.example/?%2570assword=abc", "parameter"),
        ("https://a.example/?accessToken=abc", "parameter"),
        ("https://a.example/invite/123e4567-e89b-12d3-a456-426614174000", None),
        ("https://a.example/invite/abcdefgh1", "path_marker"),
        ("https://a.example/someone@example.com", "email"),
        ("https://a.example/?gh_jid=12345", None),
        (None, None),
        ("https://a.example/?csrfToken=1", "parameter"),
        ("https://a.example/?firstName=x", "parameter"),
        ("https://a.example/reset-password-token-abcdefghij", "path_named"),
        ("https://a.example/invite-123e4567-e89b-42d3-a456-426614174000", None),
        ("https://a.example/ghp_abcdefghijklmnop1234/x", "path_api_key"),
        ("https://a.example/token/abcdefgh1", None),
        ("https://a.example/?q=%257B%2522apiKey%2522%253A1%257D", "carrier"),
        ("https://a.example/?q=tokens%3D1", None),
        ("https://a.example/?q=%2B4912345678901", "phone"),
        ("https://a.example/?q=(030)+123-4567", "phone"),
        ("https://a.example/#session=1", "fragment"),
        ("https://a.example/#section", None),
        ("https://a.example/?q=%25252525252541", "value_encoded"),
        ("https://a.example/?u=" + "x" * 16385, "value_long"),
        ("https://a.example/?u=//b.example/", "too_deep"),
    ],
)
def test_credential_urls(spark, url, issue):
    got = urls.credential_url_audit(spark.createDataFrame([(1, url)], "page_id long, url string"), nested=0).collect()
    assert [r.issue for r in got] == ([issue] if issue else [])


def test_nested_credential_urls(spark):
    from urllib.parse import quote

    inner = "https://c.example/invite/abcdefgh1"
    for _ in range(2):
        inner = "https://b.example/?n=" + quote(inner, safe="")
    rows = [(1, inner), (2, "https://a.example/?t=see+(//x.example/magic/abcdefgh1),+or+https://y.example/;"), (3, "https://a.example/?t=" + "+//x.example/" * 51)]
    got = sorted(tuple(r) for r in urls.credential_url_audit(spark.createDataFrame(rows, "page_id long, url string")).collect())
    assert (1, 2, "path_marker") in got and (2, 1, "path_marker") in got and (3, 0, "too_many") in got and not [g for g in got if g[1] > 2]


@pytest.mark.parametrize("host,private", [("10.0.0.1", True), ("172.32.0.1", False), ("172.31.255.255", True), ("8.8.8.8", False), ("[::1]", True), ("[fd00::1]", True), ("printer", True), ("a.internal", True), ("example.com", False), ("999.1.1.1", False), ("192.88.99.1", True), ("x.onion", True), ("home.arpa", True), ("a.test", False), ("[2606:4700::1111]", False), ("[2606:4700:0:0:0:0:0:1111]:8080", False), ("[::ffff:10.0.0.1]", True), ("[::ffff:808:808]", False), ("[::ffff:c0a8:101]", True), ("[64:ff9b::1]", True), ("[100::5]", True), ("[100:0:0:1::5]", False), ("[2001:1ff::1]", True), ("[2001:200::1]", False), ("[2001:db8::1]", True), ("[2002::1]", True), ("[fec0::1]", True), ("[febf::1]", True), ("[fe00::1]", False), ("[ff02::1]", True), ("[::]", True), ("[fe80::1%25eth0]", True), ("a.corp.", True), ("127.1", True), ("0177.0.0.1", True), ("0x7f.0.0.1", True), ("0X7F000001", True), ("2130706433", True), ("1２7.0.0。1", True), ("010.8.8.8", False), ("10.0.0.0.1", False), ("08.1.1.1", False), ("10.16777216", False), ("10.1.65535", True), ("10.1.65536", False), ("0x", True), ("99999999999999999999.a", False), ("127.1.", True)])
def test_private_destinations(spark, host, private):
    df = spark.createDataFrame([(1, f"http://{host}/x")], "page_id long, url string")
    assert (urls.private_destinations(df).count() == 1) is private


def test_redaction(spark):
    text = 'password = "hunter22" Authorization: Basic abc123== mail a.b@example.com see https://x.example/?a=1 code error-17'
    out = corpus.redact_corpus(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert "hunter22" not in out[0].redacted and "abc123" not in out[0].redacted and "example.com" not in out[0].redacted and "error-17" in out[0].redacted
    assert out[1].redacted == ""
    nested = spark.createDataFrame([([("a@b.example.com",)], "a@b.example.com")], "x array<struct<y:string>>, code string")
    assert corpus.redact_strings(nested, ("code",)).first().asDict(True) == {"x": [{"y": "[email]"}], "code": "a@b.example.com"}


def test_phase_is_the_last_one_before(spark):
    e = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00", None), (1, 2, "2024-01-01 00:00:01", 3), (1, 3, "2024-01-01 00:00:02", None), (2, 4, "2024-01-01 00:00:03", None)], "session long, seq long, ts string, phase int")
    assert rows(telemetry.attribute_phase(e.withColumn("ts", F.to_timestamp("ts"))), "seq", "phase") == [(1, -1), (2, 3), (3, 3), (4, -1)]


def test_nested_records(spark):
    html = '<form action="/s" method="POST"><label for="i">Name</label><input id="i"><label>Size <select><option>s<option>m</select></label></form><img src="/a.png">'
    r = extract.page_records(spark.createDataFrame([(1, html), (2, None), (3, "<p>unclosed <b>")], "page_id long, html string"))
    assert rows(extract.extract_forms(r)) == [(1, 0, "post", "/s", 2)]
    assert rows(extract.label_targets(r), "label_ordinal", "control_ordinal") == [(0, 0), (1, 1)]
    assert rows(r.where("kind = 'option'"), "ordinal", "text") == [(0, "s"), (1, "m")]


def test_png_pixels(spark, tmp_path):
    import struct
    import zlib

    raw = b"".join(b"\0" + bytes([10 * y + x, 100, 200, 255] * 1) for y in range(2) for x in range(1))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 2, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    got = readers.load_pixels(spark, str(tmp_path))
    assert rows(got, "y", "x", "r", "g", "b", "a") == [(0, 0, 0, 100, 200, 255), (1, 0, 10, 100, 200, 255)]


def test_run_ids_are_written_once(spark, tmp_path):
    df = spark.range(3)
    readers.write_run(df, str(tmp_path / "t"), "r1")
    with pytest.raises(ValueError):
        readers.write_run(df, str(tmp_path / "t"), "r1")
    readers.write_run(df, str(tmp_path / "t"), "r2")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 6


def test_tree_scan_and_policy(spark, tmp_path):
    (tmp_path / "x" / ".git").mkdir(parents=True)
    (tmp_path / "x" / "a.txt").write_text("hi")
    (tmp_path / "x" / "big.txt").write_text("y" * 100)
    (tmp_path / "x" / ".git" / "h").write_text("no")
    got = rows(readers.scan_tree(spark, str(tmp_path / "x"), 50).select(F.element_at(F.split("path", "/"), -1).alias("f"), "oversize"))
    assert got == [("a.txt", False), ("big.txt", True)]
    (tmp_path / "p.json").write_text('{"schemaVersion": 1, "gates": {"strict": 1.5}, "viewports": {"m": {"tolerant": 0.4}}, "approvedSemanticMismatches": [{"viewport": "m", "category": "c", "kind": "k", "key": "x", "changeFields": ["a"], "rationale": "r"}]}')
    g, a = readers.load_policy(spark, str(tmp_path / "p.json"), ["strict", "tolerant"])
    assert rows(g.fillna("", ["viewport"])) == [("", "strict", 1.5), ("m", "tolerant", 0.4)] and a.count() == 1
    (tmp_path / "s.json").write_text('{"results": []}')
    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException):
        readers.load_summaries(spark, str(tmp_path / "s.json"), "results array<struct<a:int>>").collect()


def test_strict_policies(spark):
    base = "script-src 'self'; connect-src 'none'; form-action 'self'; object-src 'none'; frame-ancestors 'none'"
    cases = [(base, True), (base + "; script-src-elem 'self'", True), (base + "; script-src-attr https:", False), (base + "; object-src 'none'", False), (base.replace("object-src 'none'", "object-src 'self'"), False), ("default-src 'none'", False), ("default-src *, " + base, True), ("", False)]
    rows = [(i, csp, "DENY", False) for i, (csp, _) in enumerate(cases)]
    got = {r.page_id: r.strict for r in urls.security_headers(spark.createDataFrame(rows, "page_id long, csp string, frame_options string, has_refresh boolean")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_links_and_inventory(spark):
    html = """<base href="/d/"><p><a title='1' href='x?y=1#z'> One <b>bold</b>
      word</a><A HREF=//o.example.org/ REL=me target=_blank aria-label=" a  b "></A><a>none</a><a href="http://[bad">bad</a>
      <a href="https://u:p@h.example.com:443/">in</a><area href="ftp://h.example.com/"><script>'<a href="/no">no</a>'</script>
      <script src="https://h.example.com:443/s.js"></script><script src="//o.example.org/s.js"></script><LINK REL="preload StyleSheet" HREF="https://o.example.org/c.css">
      <form action="/api/applications" method=post></form><form action="/api/applications?x" method=post></form><form action="/api/applications" method=post target=_top></form>
      <svg><use href="#a"/><use xlink:href="/b.svg"/></svg><meta http-equiv=" Refresh "><i data-replica-disclosure></i><object></object><embed><iframe></iframe>"""
    pages = spark.createDataFrame([(1, "https://h.example.com/a/b", html), (2, None, None), (None, "", "")], "page_id long, url string, html string")
    got = [tuple(r) for r in extract.extract_links(pages).orderBy("ordinal").select("href", "url", "text", "aria_label", "target", "rel").collect()]
    assert got == [
        ("x?y=1#z", "https://h.example.com/d/x?y=1#z", "One bold word", "", "", ""),
        ("//o.example.org/", "https://o.example.org/", "", "a b", "_blank", "me"),
        (None, "", "none", "", "", ""),
        ("http://[bad", None, "bad", "", "", ""),
        ("https://u:p@h.example.com:443/", "https://u:p@h.example.com:443/", "in", "", "", ""),
    ]
    n = {r.page_id: {k[2:]: v for k, v in r.asDict().items() if k != "page_id"} for r in extract.structural_inventory(pages).collect()}
    assert set(n) == {1, 2, None} and not any(n[2].values()) and not any(n[None].values())
    assert n[1] == {
        "forms": 3, "unsafe_forms": 2, "navigable_links": 5, "external_links": 1, "unsafe_links": 3, "scripts": 3, "inline_scripts": 1, "external_scripts": 1, "stylesheet_links": 1, "external_stylesheets": 1,
        "base_elements": 1, "iframes": 1, "embedded_objects": 2, "disclosures": 1, "meta_refreshes": 1, "svg_elements": 1, "svg_external_resources": 1,
    }


def test_all_gates(spark):
    good = {
        "run_id": 0, "viewport": "m", "tolerant": 0.15, "strict": 2.0, "unapproved": 0, "baseline_tampering": 0, "candidate_tampering": 0, "dimensions_match": True, "stable": True, "masked_pixels": 0, "critical_failures": 0,
        "page_errors": None, "console_errors": 0, "blocked_writes": 0, "blocked_private_reads": 0, "reported": 3, "retained": 3,
    }
    kind = "run_id long, viewport string, tolerant double, strict double, unapproved long, baseline_tampering long, candidate_tampering long, dimensions_match boolean, stable boolean, masked_pixels long, critical_failures long, page_errors long, console_errors long, blocked_writes long, blocked_private_reads long, reported long, retained long"
    bad = [("baseline_tampering", None), ("candidate_tampering", 1), ("dimensions_match", None), ("tolerant", 0.16), ("strict", None), ("stable", False), ("masked_pixels", 1), ("critical_failures", 1), ("page_errors", 1), ("console_errors", 1), ("blocked_writes", 1), ("blocked_private_reads", 1), ("unapproved", 1), ("retained", 2)]
    data = [good] + [good | {"run_id": i + 1, k: v} for i, (k, v) in enumerate(bad)] + [good | {"run_id": 99, "viewport": "w", "dimensions_match": False, "strict": 3.0, "tolerant": 0.3}]
    metrics = spark.createDataFrame([tuple(r.values()) for r in data], kind)
    policy = spark.createDataFrame([(None, "strict", 2.0), ("w", "require_dimensions", 0.0), ("w", "tolerant", 0.2), ("w", "strict", 9.0)], "viewport string, gate string, lim double")
    limits = gates.resolve_gates(metrics, policy, spark.createDataFrame([("tolerant", 0.15)], "gate string, lim double"))
    got = {r.run_id: (r.passed, r.failures) for r in gates.evaluate_gates(metrics, limits).collect()}
    assert got.pop(0) == (True, []) and got.pop(99) == (False, ["PIXEL_TOLERANT"])
    assert [got[i + 1] for i in range(14)] == [(False, [c]) for c in gates.CODES]


def test_run_codes(spark):
    whole = [("source_self", True, []), ("candidate_self", True, []), ("source_candidate", True, []), ("integrity", True, []), ("interaction", True, [])]
    data = [("ok", *p) for p in whole] + [("ok", "command", True, None)] + [("short", *p) for p in whole[1:]]
    data += [("bad", "source_self", None, None), ("bad", "candidate_self", False, []), ("bad", "source_candidate", False, ["DIMENSIONS", "PIXEL_STRICT", "SEMANTIC_UNAPPROVED", "CANDIDATE_CRITICAL_RESOURCE", "CANDIDATE_PAGE_ERROR"])]
    data += [("bad", "integrity", False, []), ("bad", "interaction", False, ["email-missing"])] + [("tool", *p) for p in whole] + [("tool", "command", False, [])]
    parts = spark.createDataFrame(data, "run string, part string, passed boolean, failures array<string>")
    got = {r.run: (r.codes, r.passed) for r in gates.run_failure_codes(parts, "run").collect()}
    assert got == {
        "ok": ([], True),
        "short": (["SOURCE_UNSTABLE"], False),
        "tool": (["TOOLING"], False),
        "bad": (["ASSETS", "BACKEND", "CAPTURE", "CONTENT", "GEOMETRY", "INTERACTION", "SAFETY", "SEMANTICS", "SOURCE_UNSTABLE", "TOOLING"], False),
    }
    assert {r.run: r.accepted for r in gates.case_result(parts, "run").collect()} == {"ok": True, "short": False, "tool": False, "bad": False}
