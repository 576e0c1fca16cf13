"""Elements, names by association, options and sanitising, on pages with mixed quoting and nesting."""

import re
from html.parser import HTMLParser

import pyarrow as pa
import pytest

from pagegauge.operators import markup
from pagegauge.sources import readers


def table(spark, *htmls):
    return spark.createDataFrame([(i, h) for i, h in enumerate(htmls)], "page_id long, html string")


def names(spark, html):
    rows = markup.control_names(markup.page_elements(table(spark, html))).orderBy("node").collect()
    return [(r.type, r.accessible_name) for r in rows], [r.question for r in rows]


def test_name_chain(spark):
    html = """
    <span id=b>second</span><span id='a'> first  <b>part</b></span><span id="a">shadowed</span>
    <input aria-label=' own  name ' aria-labelledby="a">
    <input type=TEXT aria-labelledby="b missing a">
    <label for='c'>By <i>id</i></label><label>Around <input id=c> it</label>
    <label>Only the first <input type=checkbox><input type=radio title="no label"></label>
    <button type=button> Press <b>me</b></button><input type=submit value='Send it'><button>Go</button>
    <textarea placeholder="  write   here "></textarea><select title=pick><option>x</select><input type=image alt=pic><input aria-labelledby="missing">
    """
    got, _ = names(spark, html)
    assert got == [("text", "own name"), ("text", "second first part"), ("text", "By id Around it"), ("checkbox", "Only the first"), ("radio", "no label"), ("button", "Press me"), ("submit", "Send it"), ("submit", "Go"), ("textarea", "write here"), ("select", "pick"), ("image", "pic"), ("text", "")]


def test_questions(spark):
    html = """<p id=q>Why?</p><div role=radiogroup aria-labelledby="nobody q"><fieldset><legend>inner</legend><input type=radio></fieldset></div>
    <fieldset><div><legend>not its own</legend></div><legend>Size <b>of</b> it</legend><div><input></div></fieldset><input>"""
    assert names(spark, html)[1] == ["Why?", "Size of it", ""]


def test_options(spark):
    html = "<select id=s><option value=''>-<option value='red '> Red<option VALUE=1>one<option value='a9f3' disabled>Blue<option>plain</select>"
    rows = markup.control_options(markup.page_elements(table(spark, html))).orderBy("place").collect()
    assert [(r.text, r.option_class, r.disabled, r.value_length) for r in rows] == [("-", "empty", False, 0), ("Red", "same-as-visible-text", False, 4), ("one", "common-enum", False, 1), ("Blue", "opaque", True, 4), ("plain", "same-as-visible-text", False, 5)]


def test_headings_dependencies_and_profile(spark):
    from pagegauge.operators import extract

    html = """<!DOCTYPE html><HTML lang='de-AT'><head><TITLE data-x=1> Two
    words &amp; more</TITLE><meta charset=utf-8><script>x = "<h1>no</h1>"</script><!-- <h2>no</h2> --></head>
    <h1>He <b>llo</b></h1><h2 class=x aria-level='4'> far </h2><div><h3><img alt="" src=/a.png></h3></div>
    <link href='/s.css' rel="alternate  StyleSheet"><script defer src=/x.js></script><iframe name=f src='/f'></iframe>
    <meta content='5' HTTP-EQUIV=refresh><object data=/o></object><base href=/b>text"""
    pages = table(spark, html, None)
    assert [tuple(r)[1:] for r in extract.extract_headings(pages).orderBy("ordinal").collect()] == [(0, 1, "He llo"), (1, 4, "far"), (2, 3, "")]
    found = {(r.kind, r.target) for r in extract.extract_dependencies(pages).collect()}
    assert found == {("image", "/a.png"), ("stylesheet", "/s.css"), ("script", "/x.js"), ("frame", "/f"), ("meta_refresh", "5"), ("object", "/o"), ("base", "/b")}
    rows = {r.page_id: tuple(r)[1:] for r in extract.page_profile(pages).collect()}
    assert rows == {0: ("Two words & more", "de-AT", "utf-8", len("He llo far text")), 1: ("", "", "", 0)}


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, html string")
    assert markup.control_names(markup.page_elements(none)).collect() == [] and markup.sanitize_html(none).collect() == []
    assert markup.page_elements(table(spark, None, "")).collect() == []


class Seen(HTMLParser):
    def __init__(self, html):
        super().__init__()
        self.tags, self.attributes, self.comments = [], [], 0
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.tags.append(tag)
        self.attributes += [(tag, k, v) for k, v in attrs]

    def handle_comment(self, data):
        self.comments += 1


ACTIVE = [
    "<script>alert(1)</script>", "<SCRIPT src=//e.com/x></SCRIPT >", "<script>a='</p>'; b='<b>'</script>", "<iframe src=//e.com><p>x</p></iframe>", "<object data=x><param name=y></object>", "<embed src='x'>", "<base href=//e.com>",
    "<p onclick='x()'>", "<p ONCLICK=x()>", '<p onclick="x()" id=k>', "<img src=x onerror=alert(1)>", "<svg/onload=alert(1)>", "<a href='//e.com'>x</a>", "<a href=javascript:x()>x</a>", "<area href=//e.com>",
    "<link href='//e.com' rel=preload>", "<link rel=stylesheet href=//e.com/x.css>", "<meta content='0;url=//e.com' HTTP-EQUIV=Refresh>", "<!-- c > d -->", "<!--[if IE]><script>x</script><![endif]-->", "<form action=//e.com method=get target=_blank>",
    "<button formaction=//e.com formtarget=x>", "<img srcset='//e.com/a 1x, //e.com/b 2x'>", "<div style=\"background:url('//e.com/x')\">", "<style>@import '//e.com'; p{background:u\\72l(//e.com)}</style>", "<image xlink:href='//e.com/x'>",
    "<svg><use xlink:href=//e.com#a></use></svg>", "<img src=' java\tscript:x()'>", "<![CDATA[<script>x</script>]]>", "<p data-x='{\"token\": \"abcdefgh\"}'>", "<p csrf-token=abcdefgh>", "<meta name=csrf content=abcdefgh>", "<iframe srcdoc='<script>x</script>'>",
]


@pytest.mark.parametrize("wrap", ["{}", "<div>{}<p>after", "<template>{}</template>"])
def test_nothing_active_is_left(spark, wrap):
    for r in markup.sanitize_html(table(spark, *[wrap.format(x) for x in ACTIVE])).collect():
        html = r.html
        seen = Seen(html)
        assert not set(seen.tags) & markup.REMOVED and not seen.comments, html
        assert "e.com" not in html and "abcdefgh" not in html and not re.search(r"script\s*:|\bon\w+=|alert", html), html
        assert all(k not in ("target", "formtarget", "ping") and not (t in ("a", "area") and k == "href") for t, k, _ in seen.attributes), html
        again = markup._Sanitiser({})
        again.feed(html)
        again.close()
        assert not set(Seen("".join(again.out)).tags) ^ set(seen.tags)


def test_values_and_approvals(spark):
    html = """<form method=post><input type=hidden name=h value='k9'><input name=f value="Jane Doe"><textarea name=t>my <b>life</b></textarea>
    <input type=checkbox value=x81><input type=radio value=yes><select name=s><option value=q7>Blue<option value=blue>Blue<option value=>-</select>
    <div contenteditable>draft <i>text</i></div></form><p>a &lt; b &amp; c</p>"""
    r = markup.sanitize_html(table(spark, html)).first()
    assert not re.search("k9|Jane|life|x81|q7|draft", r.html)
    assert 'value="yes"' in r.html and 'value="blue"' in r.html and "a &lt; b &amp; c" in r.html and "synthetic-local-option-0001" in r.html
    n = r.counters.asDict()
    assert {k: n[k] for k in ("hidden_values", "freeform_values", "choice_values", "option_values", "editable_values", "forms")} == {"hidden_values": 1, "freeform_values": 1, "choice_values": 1, "option_values": 1, "editable_values": 1, "forms": 1}
    assert [(a.category, a.key, a.fields) for a in r.approvals] == [
        ("forms", "form:#0", ["actionAttribute", "action"]), ("controls", "input:h#0", ["hiddenValueLength"]),
        ("controls", "input:f#1", ["valuePresent", "valueLength", "valueClassification", "valueFingerprint"]), ("controls", "select:s#5", ["optionsHash", "options"]),
    ]


def test_assets_take_the_place_of_addresses(spark):
    pages = spark.createDataFrame([(1, "<img src='//e.com/a.png'><img src=b.png><img src='#c'>", {"//e.com/a.png": "/assets/1.png"})], "page_id long, html string, assets map<string,string>")
    assert markup.sanitize_html(pages).first().html == '<img src="/assets/1.png"><img src="/unavailable"><img src="#c">'


def test_one_of_two_writers_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def write(n):
        try:
            readers.write_run(spark.range(n, n + 100).toDF("x"), str(tmp_path / "t"), "r")
            return n
        except ValueError:
            return None

    with ThreadPoolExecutor(4) as pool:
        won = [n for n in pool.map(write, [0, 1000, 2000, 3000]) if n is not None]
    assert len(won) == 1
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "t")).collect()) == list(range(won[0], won[0] + 100))


def test_a_failed_run_leaves_nothing_and_may_be_tried_again(spark, tmp_path):
    from pyspark.sql import functions as F

    bad = spark.range(10).select(F.raise_error(F.lit("no")).cast("long").alias("x"))
    with pytest.raises(Exception, match="no"):
        readers.write_run(bad, str(tmp_path / "t"), "r")
    readers.write_run(spark.range(3).toDF("x"), str(tmp_path / "t"), "r")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_names_and_options_parse_a_page_once(spark):
    rows = spark.createDataFrame([(1, '<label for=a>A</label><input id=a><select><option value=1>One</select>')], "page_id long, html string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    named = markup.control_names(markup.page_elements(rows))
    assert "MapIn" not in plan(named)
    assert [r.accessible_name for r in named.where("tag = 'input'").collect()] == ["A"]
    options = markup.control_options(markup.page_elements(rows, frozenset({"option"})))
    assert plan(options).count("MapInPandas") == 0
    assert [(r.text, r.option_class) for r in options.collect()] == [("One", "common-enum")]


def test_workers_hold_few_pages_at_once():
    batch = pa.RecordBatch.from_pydict({"html": ["x" * 400_000, None, "y" * 900_000, "z" * 5_000_000, "w"]})
    got = [[len(r["html"] or "") for r in part] for part in readers.slices([batch])]
    assert got == [[400_000, 0, 900_000], [5_000_000], [1]]
