"""Style values, what elements inherit, and budgets of a closure, against plain code."""

import random

import pytest
from pyspark.sql import functions as F

from pagegauge.functions import styles as S
from pagegauge.operators import visibility as V
from pagegauge.operators.closure import css_budget_closure

KIND = (
    "page_id long, node long, parent long, left double, top double, width double, height double, hidden boolean, display string, visibility string, content_visibility string, opacity double, "
    "filter string, clip string, clip_path string, transform string, mask_image string, background_image string, background_color string, overflow_x string, overflow_y string, is_root boolean, "
    "is_disclosure boolean, font_px double, color string, fill_color string"
)
NAMES = [c.split()[0] for c in KIND.split(", ")]
BASE = dict(page_id=1, parent=None, left=0.0, top=0.0, width=100.0, height=100.0, font_px=12.0, color="rgb(0, 0, 0)", fill_color="rgb(0, 0, 0)")


def elements(spark, *rows):
    return spark.createDataFrame([tuple({**BASE, **r}.get(n) for n in NAMES) for r in rows], KIND)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "text, alpha",
    [("transparent", 0.0), ("", 1.0), (None, 1.0), ("rgb(1, 2, 3)", 1.0), ("RGBA(1, 2, 3, .25)", 0.25), ("rgba(1, 2, 3, 50%)", 0.5), ("rgb(1 2 3 / 10%)", 0.1), ("color(srgb 1 0 0 / 0)", 0.0), ("red", 1.0)],
)
def test_alpha(spark, text, alpha):
    assert one(spark, S.color_alpha(F.lit(text))) == pytest.approx(alpha)


@pytest.mark.parametrize(
    "text, value",
    [
        ("rgb(1, 2, 3)", (1, 2, 3, 1)), ("rgb(100% 0% 50% / 25%)", (255, 0, 127.5, 0.25)), ("rgba(1, 2, 3, 7)", (1, 2, 3, 1)), ("rgba(1, 2, 3, -1)", (1, 2, 3, 0)),
        ("", (0, 0, 0, 0)), ("transparent", (0, 0, 0, 0)), ("hsl(1, 2%, 3%)", None), ("rgb(1, 2)", None),
    ],
)
def test_color(spark, text, value):
    got = one(spark, S.color(F.lit(text)))
    assert got is None if value is None else tuple(got) == pytest.approx(value)


@pytest.mark.parametrize(
    "text, sides",
    [
        ("inset(5px)", [5, 5, 5, 5]), ("inset(10% 5px)", [20, 5, 20, 5]), ("inset(1px 10% 3px)", [1, 10, 3, 10]), ("INSET(1px 2px 3px 4px round 9px)", [1, 2, 3, 4]),
        ("inset(calc(1px))", None), ("inset()", None), ("none", None), (None, None),
    ],
)
def test_inset(spark, text, sides):
    assert one(spark, S.inset(F.lit(text), F.lit(100.0), F.lit(200.0))) == sides


@pytest.mark.parametrize(
    "clip, path, gone",
    [
        ("rect(0px, 0px, 5px, 0px)", None, True), ("rect(5px 10px 5px 0px)", None, True), ("rect(0px, 9px, 9px, 0px)", None, False), ("auto", "inset(50%)", True), ("auto", "inset(49%)", False),
        (None, "circle(0)", True), (None, "ellipse(0px 0px at 1px 2px)", True), (None, "circle(0.5px)", False), (None, "polygon(1 1, 1  1)", True), (None, "polygon(1 1, 2 1)", False), (None, None, False),
    ],
)
def test_zero_clip(spark, clip, path, gone):
    assert one(spark, S.zero_clip(F.lit(clip), F.lit(path), F.lit(100.0), F.lit(200.0))) is gone


def test_filters_and_transforms(spark):
    assert one(spark, S.filter_opacity(F.lit("opacity(50%) blur(2px) opacity(.5)"))) == 0.25
    assert one(spark, S.blur(F.lit("blur(1px) blur(2.5px)"))) == 2.5 and one(spark, S.blur(F.lit(None))) == 0
    assert one(spark, S.least_scale(F.lit("matrix(0.3, 0.4, 0, 1, 9, 9)"))) == pytest.approx(0.5)
    assert one(spark, S.least_scale(F.lit("matrix3d(1, 0, 0, 0, 0, 2e-1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)"))) == pytest.approx(0.2)
    assert one(spark, S.least_scale(F.lit("none"))) == 1


def shown(df):
    return {r.node: r.visible for r in df.collect()}


def test_two_dimensions_clip(spark):
    out = V.element_visibility(
        elements(
            spark,
            dict(node=0, is_root=True, overflow_x="hidden", overflow_y="hidden", width=1.0, height=1.0),
            dict(node=1, parent=0, overflow_x="hidden", left=10.0, width=20.0),
            dict(node=2, parent=1, left=30.0),  # begins where the window ends
            dict(node=3, parent=1, left=25.0, top=500.0),  # below, but that axis isn't clipped
            dict(node=4, parent=1, overflow_y="clip", left=0.0, height=5.0),
            dict(node=5, parent=4, left=12.0, top=6.0),
            dict(node=6, parent=4, left=12.0, top=4.0),
            dict(node=7, parent=99),
            dict(node=8, parent=7, width=0.0),
        )
    )
    assert shown(out) == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False, 6: True, 7: True, 8: False}
    box = {r.node: (r.left, r.right, r.top, r.bottom) for r in out.collect()}
    assert box[6] == (12.0, 30.0, 4.0, 5.0) and box[3] == (25.0, 30.0, 500.0, 600.0)


@pytest.mark.parametrize(
    "style",
    [
        dict(hidden=True), dict(display="none"), dict(visibility="hidden"), dict(visibility="collapse"), dict(content_visibility="hidden"), dict(filter="blur(1px) opacity(0)"), dict(opacity=0.0),
        dict(clip="rect(0 0 0 0)"), dict(clip_path="inset(50%)"),
    ],
)
def test_hidden_by_the_chain(spark, style):
    out = V.element_visibility(elements(spark, dict(node=1), dict(node=2, parent=1, **style), dict(node=3, parent=2), dict(node=4, parent=3), dict(node=5, parent=1)))
    assert shown(out) == {1: True, 2: False, 3: False, 4: False, 5: True}


def test_own_text_only(spark):
    own = [dict(font_px=0.0), dict(font_px=None), dict(color="transparent"), dict(fill_color="rgb(1 1 1 / 0%)")]
    out = V.element_visibility(elements(spark, *[r for i, s in enumerate(own) for r in (dict(node=2 * i, **s), dict(node=2 * i + 1, parent=2 * i))]))
    assert shown(out) == {n: n % 2 == 1 for n in range(8)}


def test_depth_takes_few_joins(spark, monkeypatch):
    written = []
    plain = V.cut
    monkeypatch.setattr(V, "cut", lambda df, name: written.append(name) or plain(df, name))
    deep = spark.range(1000).select(F.lit(1).cast("long").alias("page_id"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    out = V.fold_ancestors(deep, F.struct(F.col("node").alias("total")), lambda a, b: F.struct((a["total"] + b["total"]).alias("total")))
    assert all(r.folded.total == r.node * (r.node + 1) // 2 for r in out.collect()) and out.count() == 1000
    assert len(written) <= 11  # the rows themselves, and ten joins


def test_cycles_raise(spark):
    ring = spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "page_id long, node long, parent long")
    with pytest.raises(ValueError):
        V.fold_ancestors(ring, F.struct("node"), lambda a, b: a, most=3)


def test_contrast_of_three_layers(spark):
    def light(rgb):
        return sum(w * (c / 255 / 12.92 if c / 255 <= 0.04045 else ((c / 255 + 0.055) / 1.055) ** 2.4) for w, c in zip((0.2126, 0.7152, 0.0722), rgb))

    layers = [(0, 0, 80, 1.0), (200, 10, 10, 0.5), (0, 250, 0, 0.25)]
    rows = [dict(node=i, parent=i - 1 if i else None, background_color=f"rgba({r}, {g}, {b}, {a})") for i, (r, g, b, a) in enumerate(layers)]
    rows[2] |= dict(color="rgb(255, 255, 255)", fill_color="rgb(255, 255, 255)", opacity=0.5, filter="opacity(80%)")
    got = {r.node: r.ratio for r in V.text_contrast(elements(spark, *rows)).collect()}
    back = (255, 255, 255)
    for r, g, b, a in layers:
        back = tuple(c * a + o * (1 - a) for c, o in zip((r, g, b), back))
    front = tuple(255 * 0.4 + o * 0.6 for o in back)
    high, low = max(light(front), light(back)), min(light(front), light(back))
    assert got[2] == pytest.approx((high + 0.05) / (low + 0.05), abs=1e-6)


def test_contrast_ends_with_the_disclosure(spark):
    rows = [dict(node=1, opacity=0.0), dict(node=2, parent=1, is_disclosure=True), dict(node=3, parent=2), dict(node=4, parent=3, filter="blur(2px)"), dict(node=5, parent=2, transform="matrix(0.4, 0, 0, 1, 0, 0)"),
            dict(node=6, parent=2, font_px=7.9), dict(node=7, parent=2, background_image="url(x)"), dict(node=8, parent=2, filter="blur(1.9px)"), dict(node=9, parent=2, color="color(srgb 0 0 0)", fill_color=None)]
    got = {r.node: (r.ratio, r.legible) for r in V.text_contrast(elements(spark, *rows)).collect()}
    assert got == {1: (0, False), 2: (21, True), 3: (21, True), 4: (0, False), 5: (0, False), 6: (21, False), 7: (0, False), 8: (21, True), 9: (0, False)}


def walk(edges, files, seeds, most, requests_most, item, total_most):
    """One page, one queue."""
    known, queue, n, requests, total, out = {u for u, _ in seeds}, [u for u, _ in seeds], len(seeds), 0, sum(b for _, b in seeds), []
    while queue:
        sheet = queue.pop(0)
        for i, dst in enumerate(edges.get(sheet, [])):
            if dst in known:
                continue
            if n >= most:
                out.append((sheet, i, dst, "resource-count-limit"))
                continue
            requests += 1
            kind, size, failure = files.get(dst, (None, 0, "dependency-fetch-failed"))
            why = "network-request-limit" if requests > requests_most else failure or ("resource-limit" if size > item else "unsupported-content-type" if kind == "text/plain" else "aggregate-limit" if total + size > total_most else "admitted")
            out.append((sheet, i, dst, why))
            if why == "admitted":
                n, total = n + 1, total + size
                known.add(dst)
                if kind == "text/css":
                    queue.append(dst)
    return out


def test_closure_equals_a_queue(spark):
    rng = random.Random(5)
    edges, files, seeds, want = [], [], [], []
    for page in range(40):
        names = [f"u{i}" for i in range(14)]
        graph = {u: [rng.choice(names) for _ in range(rng.randrange(6))] for u in names}
        given = {u: (rng.choice(["text/css", "text/css", "image/png", "text/plain"]), rng.randrange(1, 60), rng.choice([None] * 6 + ["private-destination"])) for u in names[:-1]}
        first = [(u, 5) for u in rng.sample(names, 2)]
        edges += [(page, u, i, v) for u, vs in graph.items() for i, v in enumerate(vs)]
        files += [(page, u, *f) for u, f in given.items()]
        seeds += [(page, u, i, b) for i, (u, b) in enumerate(first)]
        want += [(page, *r) for r in walk(graph, given, first, 8, 12, 50, 150)]
    args = (
        spark.createDataFrame(edges, "page_id long, src string, ordinal long, dst string").repartition(3),
        spark.createDataFrame(files, "page_id long, url string, content_type string, bytes long, failure string"),
        spark.createDataFrame(seeds, "page_id long, url string, n long, bytes long"),
    )
    out = css_budget_closure(*args, 8, 12, 50, 150)
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert {r[4] for r in want} >= {"admitted", "aggregate-limit", "network-request-limit", "resource-limit", "resource-count-limit", "unsupported-content-type", "dependency-fetch-failed", "private-destination"}
    assert css_budget_closure(args[0].limit(0), args[1], args[2], 8, 12, 50, 150).count() == 0
    for held in (0, 40):
        assert sorted(map(tuple, css_budget_closure(*args, 8, 12, 50, 150, held=held).collect())) == sorted(want)


def test_closure_reads_its_inputs_once_however_deep(spark, tmp_path):
    chain = spark.range(130).selectExpr("1L page_id", "cast(id as string) src", "0L ordinal", "cast(id + 1 as string) dst")
    files = chain.selectExpr("page_id", "dst url", "'text/css' content_type", "1L bytes", "null failure")
    seeds = spark.sql("SELECT 1L page_id, '0' url, cast(null as bigint) n, cast(null as bigint) bytes")
    out = css_budget_closure(chain, files, seeds, 999, 999, 9, 999, most=2)
    assert [(r.url, r.reason) for r in out.orderBy("page_id", F.col("url").cast("int")).collect()] == [(str(i), "admitted") for i in range(1, 131)]
    with pytest.raises(ValueError):
        css_budget_closure(chain, files, seeds, 999, 999, 9, 999, most=2, held=100)
